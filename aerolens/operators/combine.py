"""Layer selection and combined alert."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.schema import LAYER_COLUMNS, REASON_SEP, VALID_LAYERS


def parse_layers(spec) -> tuple[str, ...]:
    """'all' | 'rules,ml' | iterable -> validated names in canonical order."""
    if spec is None:
        return VALID_LAYERS
    if isinstance(spec, str):
        if spec.strip().lower() == "all":
            return VALID_LAYERS
        spec = [x for x in spec.split(",")]
    names = {str(x).strip().lower() for x in spec if str(x).strip()}
    unknown = names - set(VALID_LAYERS)
    if unknown:
        raise ValueError(f"Unknown layers: {sorted(unknown)}. Allowed: {VALID_LAYERS}")
    if not names:
        raise ValueError("At least one layer must be enabled.")
    return tuple(n for n in VALID_LAYERS if n in names)


def validate_layers(layers: Iterable[str] | str | None, model=None) -> tuple[str, ...]:
    lay = parse_layers(layers)
    if "ml" in lay and model is None:
        raise ValueError("Layer 'ml' needs a fitted model (model=None).")
    return lay


def ml_decision(score: Column, supervised: bool, threshold: float) -> Column:
    """supervised -> score >= t; unsupervised -> score < t."""
    t = F.lit(float(threshold))
    return (score >= t) if supervised else (score < t)


def combine_layers(df: DataFrame, layers: Iterable[str] = VALID_LAYERS) -> DataFrame:
    """``layers`` ARRAY<STRING> of firing layers (rules, statistical, ml
    order), ``alert`` = any, ``reasons`` = non-empty reason strings joined."""
    col_of = {v: k for k, v in LAYER_COLUMNS.items()}
    present = [n for n in VALID_LAYERS if n in layers and col_of[n] in df.columns]
    parts = [F.when(F.coalesce(F.col(col_of[n]), F.lit(False)), F.lit(n)) for n in present]
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts \
        else F.array().cast("array<string>")
    reason_col = {"rules": "alert_reasons", "statistical": "change_reasons"}
    reasons = [F.nullif(F.col(reason_col[n]), F.lit("")) for n in present
               if n in reason_col and reason_col[n] in df.columns]
    return df.withColumns({
        "layers": arr,
        "alert": F.size(arr) > 0,
        "reasons": F.concat_ws(REASON_SEP, *reasons) if reasons else F.lit(""),
    })

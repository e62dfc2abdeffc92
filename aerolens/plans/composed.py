"""Composed detection plan: L1 + L2 + features (+ model) in one pass.

The flight windows of L2 and of the features share one staging, so the
physical plan has a single Exchange on the flight keys (plus one extra Sort
for the backfill direction).  L1 is a projection fused into the scan stage;
scoring is a projection (tree models) or an Arrow-batched Python step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from aerolens.operators import frames
from aerolens.operators.combine import combine_layers, validate_layers
from aerolens.operators.features import add_features
from aerolens.operators.rules import detect_threshold_violations
from aerolens.operators.statistical import (BASE_COLUMNS, add_change_columns, required_halo,
                                            with_base_deltas)
from aerolens.schema import DEFAULT_FEATURE_WINDOW, DEFAULT_FLIGHT_KEYS, DEFAULT_STAT_CONFIG, ORDER_COLUMNS


def detect(df: DataFrame, layers=("rules", "statistical", "ml"), model=None,
           thresholds: dict | None = None, stat_config: dict | None = None,
           feature_window: int | None = None, fill: str = "backfill",
           flight_keys=DEFAULT_FLIGHT_KEYS, hot_rows: int | None = frames.HOT_ROWS,
           chunk_rows: int = frames.CHUNK_ROWS, bucket_span: float = frames.BUCKET_SPAN,
           with_features: bool | None = None, combine: bool = False,
           ml_threshold: float | None = None, keep_internal: bool = False,
           order=ORDER_COLUMNS) -> DataFrame:
    """Run the requested layers; columns not requested are never planned.

    ``with_features`` (default: when 'ml' is requested) adds the 20 window
    features.  ``combine=True`` adds ``layers``/``alert``/``reasons`` (F13).
    """
    lay = validate_layers(layers, model)
    cfg = DEFAULT_STAT_CONFIG if stat_config is None else stat_config
    feats = ("ml" in lay) if with_features is None else bool(with_features)
    fw = int(getattr(model, "window", None) or feature_window or DEFAULT_FEATURE_WINDOW)
    out = df
    if "rules" in lay:
        out = detect_threshold_violations(out, thresholds)
    if "statistical" in lay or feats:
        halo = required_halo(cfg if "statistical" in lay else {"window": 0, "freeze_window": 0},
                             fw if feats else 0)
        staged, layout = frames.stage(out, flight_keys, halo=halo, hot_rows=hot_rows,
                                      chunk_rows=chunk_rows, bucket_span=bucket_span, order=order)
        staged = with_base_deltas(staged, layout)
        if "statistical" in lay:
            staged = add_change_columns(staged, layout, cfg)
        if feats:
            staged = add_features(staged, layout, fw, fill)
        out = frames.unstage(staged, layout)
        if not keep_internal:
            out = out.drop(*BASE_COLUMNS)
    if "ml" in lay:
        out = model.predict(out, ml_threshold=ml_threshold)
    if combine:
        out = combine_layers(out, lay)
    return out

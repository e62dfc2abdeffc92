"""Segments: hand-made runs, brute force, and the hot-flight split."""

from __future__ import annotations

import numpy as np
import pytest

from aerolens.operators import segments as sg


def _brute(rows, merge_gap, min_duration):
    segs, in_seg, start, typ = [], False, None, None
    for t, lab, ty in rows:
        if lab == 1 and not in_seg:
            start, typ, in_seg = t, ty, True
        elif (lab == 0 or ty != typ) and in_seg:
            segs.append((start, t, typ))
            if lab == 1:
                start, typ, in_seg = t, ty, True
            else:
                in_seg = False
    if in_seg:
        segs.append((start, rows[-1][0], typ))
    merged = []
    for s, e, ty in segs:
        if merged and ty == merged[-1][2] and s - merged[-1][1] <= merge_gap:
            merged[-1] = (merged[-1][0], e, ty)
        else:
            merged.append((s, e, ty))
    return [m for m in merged if m[1] - m[0] >= min_duration]


def _frame(spark, flights):
    data = []
    for cid, rows in flights.items():
        for i, (t, lab, ty) in enumerate(rows):
            data.append((3, cid, i + 1, i, float(t), lab, ty))
    return spark.createDataFrame(data, "replicate int, case_id bigint, row_idx bigint, _ord bigint, "
                                       "t_rel double, label int, tamper_type string")


def _got(df, **kw):
    out = sg.anomaly_segments(df, 0.2, 0.15, **kw).collect()
    res = {}
    for r in out:
        res.setdefault(r["case_id"], []).append((r["seg_start"], r["seg_end"], r["type"]))
    return {k: sorted(v) for k, v in res.items()}


def test_runs_fixture(spark):
    rows = [(0.0, 0, "normal"), (0.1, 1, "a"), (0.2, 1, "a"), (0.3, 0, "normal"), (0.4, 1, "a"),
            (0.5, 1, "b"), (0.6, None, "b"), (0.7, 0, "normal"), (1.0, 1, "c"), (1.4, 1, "c")]
    got = _got(_frame(spark, {1: rows}))
    assert got[1] == sorted(_brute(rows, 0.2, 0.15))


def test_random_runs_and_split(spark):
    rng = np.random.default_rng(1)
    flights = {}
    for cid in range(4):
        t, rows = 0.0, []
        for _ in range(120):
            t += float(rng.choice([0.05, 0.1, 0.3]))
            lab = int(rng.random() < 0.4)
            rows.append((round(t, 2), lab if rng.random() > 0.05 else None,
                         rng.choice(["x", "y"]) if lab else "normal"))
        flights[cid] = rows
    df = _frame(spark, flights)
    plain = _got(df, hot_rows=None)
    assert plain == {k: sorted(_brute(v, 0.2, 0.15)) for k, v in flights.items() if _brute(v, 0.2, 0.15)}
    split = _got(df, hot_rows=30, chunk_rows=16)
    assert split == plain


def test_binary_segments(spark):
    data = [(3, 1, i + 1, i, 0.1 * i, b) for i, b in enumerate([0, 1, 1, 0, 0, 1, None, 1, 1, 0])]
    df = spark.createDataFrame(data, "replicate int, case_id bigint, row_idx bigint, _ord bigint, "
                                     "t_rel double, alert_change int")
    out = sorted((round(r["seg_start"], 6), round(r["seg_end"], 6))
                 for r in sg.binary_segments(df, "alert_change", 0.15, 0.15).collect())
    # runs [0.1,0.3), [0.5,0.6) (a missing flag closes a run), [0.7,0.9):
    # gap 0.2 > 0.15 keeps the first apart, gap 0.1 merges the last two
    assert out == [(0.1, 0.3), (0.5, 0.9)]

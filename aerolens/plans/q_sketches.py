"""Queries of the mergeable quantile sketches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from aerolens.operators import frames, sketches
from aerolens.operators.statistical import with_base_deltas
from aerolens.plans import sqlkit as q
from aerolens.plans.registry import register, tele
from aerolens.session import checkpoint_dir

_QS = (0.02, 0.5, 0.98)


@register("a16_sketch_percentiles", q.with_view("""
select cast(share as double) as share, cast(count(speed) as bigint) as n, true as rank_fits
from t, (select unnest([0.02, 0.5, 0.98]) as share) group by share"""))
def a16_sketch_percentiles(spark, sf_dir):
    """Percentiles of all speeds from sketches of five batches, one of them stored twice: the rank of each answer
    among all values is within the stated error."""
    t = tele(spark, sf_dir)
    path = os.path.join(checkpoint_dir(spark), f"sketches-{uuid.uuid4().hex[:12]}")
    batch = F.pmod(F.xxhash64("event_id"), F.lit(5))
    for i in (0, 1, 2, 3, 4, 2):
        sketches.store_batch(t.where(batch == i), "speed", path, i)
    m, out = sketches.read_merged(spark, path), None
    err = 2.0 * sketches.rank_error()                      # twice the figure of 99 %
    for share in _QS:
        at = sketches.quantile(m, share).select("n", "quantile")
        ranks = t.select("speed").crossJoin(at).groupBy("n").agg(                  # ``at`` has one row
            F.count_if(F.col("speed") < F.col("quantile")).alias("below"), F.count_if(F.col("speed") <= F.col("quantile")).alias("upto"))
        want = F.lit(share) * F.col("n")
        fits = (F.col("below") <= want + err * F.col("n") + 1) & (F.col("upto") >= want - err * F.col("n") - 1)
        one = ranks.select(F.lit(share).alias("share"), "n", fits.alias("rank_fits"))
        out = one if out is None else out.unionByName(one)
    return out


@register("a3_sketch_medians", q.with_view("""
select replicate, case_id, cast(count(dt_us) as bigint) as n, case when count(dt_us) > 0 then true end as rank_fits
from b group by replicate, case_id""", q.BASE_CTE))
def a3_sketch_medians(spark, sf_dir):
    """The median time step per flight from a sketch each: half of the flight's steps lie on either side."""
    keys = ["replicate", "case_id"]
    staged, lay = frames.stage(tele(spark, sf_dir), keys, halo=1)
    d = frames.unstage(with_base_deltas(staged, lay), lay).select(*keys, F.col("_dt_raw").alias("dt"))
    m = sketches.quantile(sketches.sketch(d, "dt", keys), 0.5).drop("sketch", "n")
    err = 2.0 * sketches.rank_error()
    j = d.join(m, keys).groupBy(*keys).agg(F.count("dt").alias("n"), F.count_if(F.col("dt") < F.col("quantile")).alias("below"),
                                           F.count_if(F.col("dt") <= F.col("quantile")).alias("upto"))
    fits = (F.col("below") <= (0.5 + err) * F.col("n") + 1) & (F.col("upto") >= (0.5 - err) * F.col("n") - 1)
    return j.select(*keys, "n", F.when(F.col("n") > 0, fits).alias("rank_fits"))

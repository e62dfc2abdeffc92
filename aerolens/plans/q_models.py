"""Queries of the ML layer.

Train = replicates other than 3, test = replicate 3 (F4).  SQL can't express a
trained model, so these queries return checks of what any model has to keep,
worked out over all rows, and the SQL states the expected figures.  The models
run at the library's defaults.
"""

from __future__ import annotations

import os
import uuid
import warnings

from pyspark.sql import functions as F

from aerolens.operators.combine import ml_decision
from aerolens.operators.features import compute_features
from aerolens.operators import curves
from aerolens.operators.models import AnomalyDetector, boosting, compare_algorithms, iforest, lof, neighbours
from aerolens.operators.models.ocsvm_dual import points_of
from aerolens.operators.models.sampling import class_weight_table, subsample
from aerolens.plans import sqlkit as q
from aerolens.plans.registry import r6, register, tele
from aerolens.schema import FEATURE_NAMES
from aerolens.session import checkpoint_dir
from aerolens.sources.csv import split_by_replicate


def _split(spark, sf_dir):
    return split_by_replicate(tele(spark, sf_dir), 3)


def _saved(spark, det):
    path = os.path.join(checkpoint_dir(spark), f"model-{uuid.uuid4().hex[:10]}")
    det.save(spark, path)
    return AnomalyDetector.load(spark, path)


_CHECKED = q.with_view("""
select cast(count(*) as bigint) as n_rows, cast(count(distinct event_id) as bigint) as n_events, cast(0 as bigint) as n_without_score,
  cast(0 as bigint) as n_alert_differs, cast(0 as bigint) as n_load_differs, true as threshold_fits
from t where replicate = 3""")


def _checked(spark, sf_dir, algo, params=None):
    """Every test row has a score and the alert of its threshold, a loaded model scores alike, and the
    threshold is the percentile of the clean training scores (or at least as good as others by F1)."""
    train, test = _split(spark, sf_dir)
    feats, rows = compute_features(train).persist(), compute_features(test).persist()
    det = AnomalyDetector(algo, params=params).fit(feats)
    again = _saved(spark, det).predict(rows).select("event_id", F.col("ml_score").alias("s2"), F.col("alert_ml").alias("a2"))
    j = det.predict(rows).select("event_id", "ml_score", "alert_ml").join(again, "event_id")
    at = det.optimal_threshold if det.supervised else det.threshold
    known = det.predict(feats).select("label", "ml_score").persist()      # read up to four times
    if det.supervised:
        f1 = lambda t: known.agg((2.0 * F.count_if((F.col("ml_score") >= t) & (F.col("label") == 1)) / F.nullif(
            F.count_if(F.col("ml_score") >= t) + F.count_if(F.col("label") == 1), F.lit(0))).alias("f")).first()["f"] or 0.0
        fits = all(f1(at) >= f1(t) - 1e-9 for t in (0.2, 0.5, 0.8))
    else:
        n, below = known.where("label = 0").agg(F.count(F.lit(1)), F.count_if(F.col("ml_score") < at)).first()
        fits = abs(below - 0.02 * (n - 1)) <= 1.0 + 1e-9
    out = j.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_id").alias("n_events"),
                F.count_if(F.col("ml_score").isNull() | F.isnan("ml_score")).alias("n_without_score"),
                F.count_if(~F.col("alert_ml").eqNullSafe(ml_decision(F.col("ml_score"), det.supervised, at))).alias("n_alert_differs"),
                F.count_if((F.abs(F.col("ml_score") - F.col("s2")) > 1e-12) | (F.col("alert_ml") != F.col("a2"))).alias("n_load_differs"),
                F.lit(bool(fits)).alias("threshold_fits"))
    row = out.collect()                          # one row; then the features can go
    for d in (feats, rows, known):
        d.unpersist()
    return spark.createDataFrame(row, out.schema)


@register("m6_isolation_forest", _CHECKED)
def m6_isolation_forest(spark, sf_dir):
    return _checked(spark, sf_dir, "isolation_forest")


@register("m7_lof", _CHECKED)
def m7_lof(spark, sf_dir):
    return _checked(spark, sf_dir, "lof")


@register("m8_one_class_svm", _CHECKED)
def m8_one_class_svm(spark, sf_dir):
    return _checked(spark, sf_dir, "one_class_svm")


_CH = ("altitude", "speed", "heading", "latitude", "longitude", "days")      # the time keeps distances from tying
_D = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _CH) + ")"


@register("m7_lof_scores", q.with_view(f"""
select event_id, floor(avg(-b.lrd / a.lrd) * 10000.0 + 0.5) / 10000.0 as lof_score
from (select event_id, 1.0 / (avg(greatest(kdist, dist)) + 1e-10) as lrd from near join dens using (nbr) group by event_id) a
join (select event_id, nbr from near) using (event_id) join (select nbr, lrd as lrd from dens) b using (nbr)
group by event_id""", f"""
f as (select event_id, replicate, label, {', '.join(f'coalesce({c}, 0.0) as {c}' for c in _CH)}
  from (select *, (t_us - 1704067200000000) / cast(86400000000.0 as double) as days from t)),
ref as (select * from f where replicate <> 3 and label = 0),
rr as (select a.event_id, b.event_id as nbr, {_D} as dist from ref a join ref b on a.event_id <> b.event_id
  qualify row_number() over (partition by a.event_id order by dist, b.event_id) <= 20),
kd as (select event_id as nbr, max(dist) as kdist from rr group by event_id),
dens as (select rr.event_id as nbr, any_value(k0.kdist) as kdist, 1.0 / (avg(greatest(kd.kdist, dist)) + 1e-10) as lrd
  from rr join kd using (nbr) join kd k0 on k0.nbr = rr.event_id group by rr.event_id),
near as (select a.event_id, b.event_id as nbr, {_D} as dist from f a cross join ref b where a.replicate = 3
  qualify row_number() over (partition by a.event_id order by dist, b.event_id) <= 20)"""))
def m7_lof_scores(spark, sf_dir):
    """LOF scores of the test rows from five channels and the day, equal to a plain SQL LOF.  The reference set is the production
    cap of 50,000 clean rows, which cuts nothing at sf0.01, where SQL is compared."""
    day = (F.unix_micros("timestamp") - F.lit(1704067200000000)) / F.lit(86400000000.0)
    train, test = (d.withColumn("days", day).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _CH}) for d in _split(spark, sf_dir))
    R, kd, lrd, k = lof.fit_lof(spark, subsample(train.where("label = 0"), 50_000), _CH, 20)
    score = lof.score_column(spark, R, kd, lrd, k, _CH)
    return test.select("event_id", score.alias("s")).select("event_id", (F.floor(F.col("s") * 10000.0 + 0.5).cast("double") / 10000.0).alias("lof_score"))


@register("m7_neighbour_recall", q.with_view("""
select cast(count(*) as bigint) as n_rows, cast(0 as bigint) as n_without_factor, true as recall_fits from t where label = 0"""))
def m7_neighbour_recall(spark, sf_dir):
    """Outlier factors of all clean rows without a cap, and the recall of their 20 nearest neighbours, measured by a
    full search for the points whose hash is divisible by 50: 0.9 at least."""
    clean = neighbours.written(compute_features(tele(spark, sf_dir)).where("label = 0").select(*FEATURE_NAMES))
    points = neighbours.with_ids(neighbours.written(points_of(clean, FEATURE_NAMES)))
    knn = neighbours.written(neighbours.nearest(points))       # the forest is built once
    out = neighbours.outlier_factors(clean, FEATURE_NAMES, found=(points, knn))
    some = points.where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0)
    share = neighbours.recall(knn, neighbours.nearest_exact(points, some)).first()["recall"]
    return out.agg(F.sum("c").alias("n_rows"), F.count_if(F.col("lof").isNull() | F.isnan("lof") | (F.col("lof") <= 0)).alias("n_without_factor"),
                   F.lit(share is None or share >= 0.9).alias("recall_fits"))


@register("m6_path_lengths", q.with_view("""
select cast(count(*) as bigint) as n_rows, cast(0 as bigint) as n_differs, true as far_row_is_low from t where replicate = 3"""))
def m6_path_lengths(spark, sf_dir):
    """Isolation forest scores of the test rows, worked out again by joins from the tables of the trees: a row moves to
    a child node per join, and its score follows from the mean path length.  A row far from all others is among the
    lowest 2 in 100."""
    train, test = _split(spark, sf_dir)
    det = AnomalyDetector("isolation_forest").fit(train)
    rows = compute_features(test).persist()
    trees, psi = det.model[1], det.model[2]
    flat = [(t, n, int(fe[n]), float(th[n]), int(le[n]), int(ri[n]), float(sz[n])) for t, (fe, th, le, ri, sz) in enumerate(trees) for n in range(len(fe))]
    nodes = spark.createDataFrame(flat, "tree int, node int, feature int, cut double, l int, r int, size double")   # trees x (2 psi - 1) rows at most
    at = rows.select("event_id", F.array(*FEATURE_NAMES).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(len(trees) - 1))).alias("tree"),
                     F.lit(0).alias("node"), F.lit(0).alias("depth"))
    inner = F.col("feature") >= 0
    for _ in range((psi - 1).bit_length()):
        at = at.join(F.broadcast(nodes.drop("size")), ["tree", "node"]).select(
            "event_id", "x", "tree", F.when(~inner, F.col("node")).when(F.get("x", F.col("feature")) <= F.col("cut"), F.col("l")).otherwise(F.col("r")).alias("node"),
            (F.col("depth") + inner.cast("int")).alias("depth"))
    rest = lambda n: F.when(n > 2, 2.0 * (F.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n).when(n == 2, 1.0).otherwise(0.0)
    length = at.join(F.broadcast(nodes.select("tree", "node", "size")), ["tree", "node"]).groupBy("event_id").agg(F.avg(F.col("depth") + rest(F.col("size"))).alias("h"))
    again = length.select("event_id", (-F.pow(F.lit(2.0), -F.col("h") / rest(F.lit(float(psi))))).alias("s2"))
    scored = det.predict(rows).select("event_id", "ml_score")
    far = rows.agg(*[(F.max(c) + 10.0 * (F.max(c) - F.min(c)) + 1.0).alias(c) for c in FEATURE_NAMES])
    low = det.predict(far).first()["ml_score"] if rows.limit(1).count() else None
    j = scored.join(again, "event_id", "left")
    out = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(F.abs(F.col("ml_score") - F.col("s2")) < 1e-9, F.lit(False))).alias("n_differs"),
                F.coalesce(F.count_if(F.col("ml_score") < F.lit(low)) <= 0.02 * F.count(F.lit(1)), F.lit(True)).alias("far_row_is_low"))
    row = out.collect()
    rows.unpersist()
    return spark.createDataFrame(row, out.schema)


@register("m8_dual_conditions", q.with_view("""
select cast(count(*) as bigint) as n_rows, cast(0 as bigint) as n_breaks, true as weights_fit, true as outliers_fit, true as vectors_fit
from t where replicate <> 3 and label = 0"""))
def m8_dual_conditions(spark, sf_dir):
    """Optimality of the one-class SVM on every fitted row, which no other score keeps: rows without weight score
    0 or more, rows at their bound 0 or less, all others 0; the weights add up to nu n; the rows below 0 are at most
    nu n and the support vectors at least that."""
    train, _ = _split(spark, sf_dir)
    det = AnomalyDetector("one_class_svm", max_train_samples=1_000_000_000, params={"nu": 0.05})
    clean = det.with_features(train).where("label = 0").persist()
    det.fit(clean)
    _, S, a, c, _, _ = det.model
    weights = spark.createDataFrame([(S[i].tolist(), int(c[i]), float(a[i])) for i in range(len(S))], "x array<double>, c long, a double")
    x = F.array(*[F.col(k).cast("double") for k in det.feature_names]).alias("x")
    rows = det.predict(clean).select(x, "ml_score").groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("ml_score").alias("s"))
    tol = 0.002                                            # the solver's tolerance, and as much for rounding
    s, w = F.col("s"), F.coalesce(F.col("a"), F.lit(0.0))
    j = rows.join(weights, "x", "left").withColumn("w", w)
    breaks = ((F.col("w") < F.col("n")) & (s < -tol)) | ((F.col("w") > 0) & (s > tol))
    share = 0.05 * F.sum("n")
    out = j.agg(F.sum("n").alias("n_rows"), F.sum(F.when(breaks, F.col("n")).otherwise(0)).alias("n_breaks"),
                ((F.abs(F.sum("w") - share) < 1e-6) & (F.count_if(F.col("c") != F.col("n")) == 0)).alias("weights_fit"),
                (F.sum(F.when(s < -tol, F.col("n")).otherwise(0)) <= share).alias("outliers_fit"),
                (F.sum(F.when(F.col("w") > 0, F.col("n")).otherwise(0)) >= share).alias("vectors_fit"))
    row = out.collect()
    clean.unpersist()
    return spark.createDataFrame(row, out.schema)


@register("m4_random_forest", _CHECKED)
def m4_random_forest(spark, sf_dir):
    return _checked(spark, sf_dir, "random_forest")


@register("m5_gradient_boosting", _CHECKED)
def m5_gradient_boosting(spark, sf_dir):
    return _checked(spark, sf_dir, "xgboost")


@register("m5_boosted_trees_fit", q.with_view("""
select cast(300 as bigint) as n_trees, true as depth_fits, cast(count(*) as bigint) as n_rows,
  cast(count(*) filter (where label = 1) as bigint) as n_positive, true as ranks_training_rows, true as loss_falls
from t where replicate <> 3 and label is not null"""))
def m5_boosted_trees_fit(spark, sf_dir):
    """The 300 trees of depth 8 rank the training rows (AUC above 0.95, which no random score has), and the weighted
    log loss falls from one hundred trees to the next."""
    train, _ = _split(spark, sf_dir)
    feats = compute_features(train).where("label is not null").persist()
    det = AnomalyDetector("xgboost").fit(feats)
    trees = det.model[1]

    def depth(t, node=0):
        return 0 if t[0][node] < 0 else 1 + max(depth(t, t[2][node]), depth(t, t[3][node]))

    scored = feats.select("label", *[boosting.score_column(spark, trees[:k], det.feature_names).alias(f"p{k}") for k in (100, 200, 300)])
    loss = lambda c: F.avg(-F.log(F.greatest(F.when(F.col("label") == 1, F.col(c)).otherwise(1 - F.col(c)), F.lit(1e-15))))
    by = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[loss(f"p{k}").alias(f"l{k}") for k in (100, 200, 300)]).collect()   # two rows
    of = {r["label"]: r for r in by}
    n_pos = of[1]["n"] if 1 in of else 0
    total = [sum(r[f"l{k}"] for r in by) for k in (100, 200, 300)]           # the classes weigh alike
    auc = curves.roc_auc(scored, "p300").first()["auc"] if n_pos else None
    feats.unpersist()
    return spark.createDataFrame([(len(trees), max(map(depth, trees)) <= 8, sum(r["n"] for r in by), n_pos, auc is None or auc > 0.95,
                                   total[0] > total[1] > total[2])],
                                 "n_trees bigint, depth_fits boolean, n_rows bigint, n_positive bigint, ranks_training_rows boolean, loss_falls boolean")


@register("m6_rows_per_tree", q.with_view("""
select size, cast(least(256, size) as bigint) as psi, cast(150 as bigint) as n_trees, cast(150 * least(256, size) as bigint) as n_drawn,
  cast(0 as bigint) as n_uneven, cast(0 as bigint) as n_repeated
from (select cast(unnest([200, 256, 300, 1000]) as bigint) as size) where size <= (select count(*) from t)"""))
def m6_rows_per_tree(spark, sf_dir):
    """Every tree of the forest draws exactly psi different rows, for tables of several sizes."""
    rows = tele(spark, sf_dir).withColumns({c: F.lit(0.0) for c in FEATURE_NAMES})
    total, out = rows.count(), None
    for size in (200, 256, 300, 1000):
        if size > total:
            continue
        drawn, psi = iforest.fit_forest(subsample(rows, size), list(FEATURE_NAMES), sample_only=True)
        per = drawn.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_h").alias("d"))
        one = per.agg(F.lit(size).cast("bigint").alias("size"), F.lit(psi).cast("bigint").alias("psi"), F.count(F.lit(1)).alias("n_trees"),
                      F.sum("n").alias("n_drawn"), F.count_if(F.col("n") != psi).alias("n_uneven"), F.count_if(F.col("n") != F.col("d")).alias("n_repeated"))
        out = one if out is None else out.unionByName(one)
    return out


@register("m9_shared_features_two_models", q.with_view("""
select cast(count(*) as bigint) as n_rows, cast(0 as bigint) as n_differs from t where replicate = 3"""))
def m9_shared_features_two_models(spark, sf_dir):
    """Features computed once, two detectors scored onto the same rows, equal to each by itself."""
    train, test = _split(spark, sf_dir)
    trf, tef = compute_features(train).persist(), compute_features(test).persist()
    a, b = AnomalyDetector("isolation_forest").fit(trf), AnomalyDetector("one_class_svm").fit(trf)
    named = lambda d, n: d.withColumnRenamed("ml_score", f"score_{n}").withColumnRenamed("alert_ml", f"alert_{n}")
    both = named(b.predict(named(a.predict(tef), "a")), "b")
    alone = named(a.predict(test), "x").select("event_id", "score_x", "alert_x").join(named(b.predict(test), "y").select("event_id", "score_y", "alert_y"), "event_id")
    j = both.join(alone, "event_id")
    differs = (F.abs(F.col("score_a") - F.col("score_x")) > 1e-9) | (F.abs(F.col("score_b") - F.col("score_y")) > 1e-9) | \
        (F.col("alert_a") != F.col("alert_x")) | (F.col("alert_b") != F.col("alert_y"))
    out = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(differs).alias("n_differs"))
    row = out.collect()
    trf.unpersist()
    tef.unpersist()
    return spark.createDataFrame(row, out.schema)


@register("f12_threshold_override", q.with_view("""
select a.algorithm, cast(count(*) as bigint) as n_rows, cast(0 as bigint) as n_differs
from t cross join (select unnest(['isolation_forest', 'random_forest']) as algorithm) a where replicate = 3 group by a.algorithm"""))
def f12_threshold_override(spark, sf_dir):
    """Decisions at user thresholds: supervised score >= t, unsupervised score < t."""
    train, test = _split(spark, sf_dir)
    out = None
    for algo, t in (("isolation_forest", -0.45), ("random_forest", 0.7)):
        det = AnomalyDetector(algo).fit(train)
        want = (F.col("ml_score") >= t) if algo == "random_forest" else (F.col("ml_score") < t)
        one = det.predict(test, ml_threshold=t).agg(F.lit(algo).alias("algorithm"), F.count(F.lit(1)).alias("n_rows"),
                                                    F.count_if(F.col("alert_ml") != want).alias("n_differs"))
        out = one if out is None else out.unionByName(one)
    return out


@register("f14_feature_order", q.with_view("select cast(count(*) as bigint) as n_rows, cast(0 as bigint) as n_differs, true as warned from t where replicate = 3"))
def f14_feature_order(spark, sf_dir):
    """Features in another column order: a warning, and the same scores."""
    train, test = _split(spark, sf_dir)
    det = AnomalyDetector("isolation_forest").fit(train)
    rows = compute_features(test)
    turned = rows.select("event_id", *reversed(FEATURE_NAMES))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        other = det.predict(turned).select("event_id", F.col("ml_score").alias("s2"))
    j = det.predict(rows).select("event_id", "ml_score").join(other, "event_id")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ml_score") != F.col("s2")).alias("n_differs"),
                 F.lit(any("order" in str(w.message) for w in said)).alias("warned"))


@register("a17_class_weights", q.with_view(f"""
select label, cast(count(*) as bigint) as n,
  {q.r6('cast(sum(count(*)) over () as double) / (2.0 * count(*))')} as w_balanced,
  {q.r6("case when label = 1 then cast(sum(case when label = 0 then count(*) end) over () as double) / count(*) else 1.0 end")} as w_pos_ratio
from t where label is not null group by label"""))
def a17_class_weights(spark, sf_dir):
    w = class_weight_table(tele(spark, sf_dir))
    return w.select("label", "n", r6("w_balanced").alias("w_balanced"),
                    r6("w_pos_ratio").alias("w_pos_ratio"))


@register("o4_subsample", q.with_view("""
select n, cast(least(n, clean) as bigint) as n_rows, cast(least(n, clean) as bigint) as n_distinct, cast(0 as bigint) as n_labelled, true as same_again
from (select cast(unnest([1, 2000, 1000000]) as bigint) as n), (select count(*) as clean from t where label = 0)"""))
def o4_subsample(spark, sf_dir):
    """Repeatable capped samples of clean rows (the LOF / one-class SVM fit cap)."""
    clean, out = tele(spark, sf_dir).filter(F.col("label") == 0), None
    for n in (1, 2_000, 1_000_000):
        one, two = subsample(clean, n, seed=42), subsample(clean.repartition(5), n, seed=42)
        key = F.sum(F.xxhash64("event_id").cast("decimal(38,0)"))
        a = one.agg(F.lit(n).cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_id").alias("n_distinct"),
                    F.count_if(F.col("label") != 0).alias("n_labelled"), key.alias("k"))
        both = a.crossJoin(two.agg(key.alias("k2")))                      # one row each
        both = both.select("n", "n_rows", "n_distinct", "n_labelled", (F.col("k") == F.col("k2")).alias("same_again"))
        out = both if out is None else out.unionByName(both)
    return out


@register("a20_compare_algorithms", q.with_view("""
select algorithm, cast(count(*) as bigint) as n_rows, cast(count(*) filter (where label = 1) as bigint) as n_positive, true as ratios_fit, true as ok
from t cross join (select unnest(['isolation_forest', 'one_class_svm', 'lof', 'random_forest', 'xgboost']) as algorithm)
where replicate = 3 and label is not null group by algorithm"""))
def a20_compare_algorithms(spark, sf_dir):
    """The comparison table of all five algorithms: counts add up, ratios follow from them."""
    train, test = _split(spark, sf_dir)
    d = compare_algorithms(train, test)
    p = F.when(F.col("TP") + F.col("FP") > 0, F.col("TP") / (F.col("TP") + F.col("FP"))).otherwise(0.0)
    r = F.when(F.col("TP") + F.col("FN") > 0, F.col("TP") / (F.col("TP") + F.col("FN"))).otherwise(0.0)
    fit = (F.abs(p - F.col("precision")) < 1e-3) & (F.abs(r - F.col("recall")) < 1e-3)
    return d.select("algorithm", (F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN")).alias("n_rows"), (F.col("TP") + F.col("FN")).alias("n_positive"),
                    fit.alias("ratios_fit"), F.col("error").isNull().alias("ok"))

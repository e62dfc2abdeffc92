"""Quality rules: base counts, then robust multivariate outliers.

Per text: words (maximal runs without ASCII white space), code points in
words, symbols ``#*$%&|<>``, repeated lines, words inside repeated 5-word
windows.  Texts under 10 words, or with more than a fifth of their words in
repeated windows, fail the base rules.

The others are judged by minimum-covariance-determinant (MCD) estimates per
language and source.  The vector holds transformed statistics, each shrunk
towards its group's ratio so that short texts are not outliers by noise
alone: log of code points per word, and square roots of symbols per word,
capitals per word, repeated lines per line and repeated words per word.  Per
group the start is the median and the interquartile range of each statistic;
C-steps then take the COVERAGE share of rows with the smallest distance,
their mean and covariance, and the new distances.  The covariance is scaled
so that the median squared distance is that of a chi-squared variable, and a
row is rejected when its squared Mahalanobis distance exceeds CUTOFF on the
bad side (each statistic's excess over the centre; a text is not rejected for
having fewer symbols than usual).

Only built-in functions run here.  The statistics are rounded to 1/4096 and
summed as decimals, and the quantiles are exact over these steps, so results
don't depend on the partitioning.  All rows enter the estimates; the maps
behind the quantiles are bounded by the steps, not by the rows.

Defined cases: a null text counts as empty; null lang or source form groups
of their own; groups under MIN_ROWS rows use their language's estimate, and
languages under MIN_ROWS that of all rows; rows that fail the base rules stay
out of the estimates; equal rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolens.llm.common import materialise, remove, table

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SPACE = r"[\x20\x09-\x0D]+"
COVERAGE = 0.75
C_STEPS = 3
MIN_ROWS = 200
CUTOFF = 100.0
#: pseudo-counts of the shrinkage: words, lines
PRIOR_WORDS, PRIOR_LINES = 40, 10
STEP = 4096
#: least standard deviation of each statistic
FLOORS = (0.05, 0.12, 0.08, 0.25, 0.2)
#: median of a chi-squared variable with five degrees of freedom
CHI2_MEDIAN = 4.3515
D = len(FLOORS)
X = [f"x{j}" for j in range(D)]


def stats_of(text: Column) -> list[dict[str, Column]]:
    """Layers of columns: each may use those before it (kept in separate projections)."""
    c = F.col
    return [
        {"_t": F.coalesce(text.cast("string"), F.lit(""))},
        {"_w": F.filter(F.split("_t", SPACE), lambda w: w != ""),
         "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
         "n_symbols": F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("bigint"),
         "n_capitals": F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("bigint")},
        {"_h": F.transform("_w", lambda w: F.xxhash64(w)),
         "n_words": F.size("_w").cast("bigint"),
         "word_chars": F.aggregate("_w", F.lit(0).cast("bigint"), lambda s, w: s + F.length(w)),
         "n_lines": F.size("_l").cast("bigint"),
         "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint")},
        {"_win": F.when(c("n_words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.greatest(c("n_words") - WINDOW, F.lit(0)).cast("int")),
            lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))},
        {"_srt": F.when(F.size(F.array_distinct("_win")) < F.size("_win"),
                        F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))},
        {"_pos": F.array_sort(F.transform(
            F.filter("_srt", lambda x, i: F.coalesce(x.h == F.get("_srt", i - 1).h, F.lit(False))
                     | F.coalesce(x.h == F.get("_srt", i + 1).h, F.lit(False))),
            lambda x: x.i))},
        {"n_repeat_words": F.coalesce(F.aggregate(
            F.transform("_pos", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_pos", i + 1) - p, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0).cast("bigint"))},
    ]


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines"]


def with_stats(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` columns plus a struct column ``_stats`` with the counts of ``docs.text``."""
    d = docs.select(*keep, F.col("text").alias("_text"))
    for layer in stats_of(F.col("_text")):
        d = d.withColumns(layer)
    names = [c for c in d.columns if c in STATS]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.select(*[c for c in d.columns if c.startswith("_k")],
                    F.struct(*names, failed.alias("base_failed")).alias("_stats"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, with L and the centre as columns."""
    z: list[Column] = []
    for i in range(D):
        s = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * z[k]
        z.append(s / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _quantised(d2: Column) -> Column:
    return F.least(F.floor(d2 * 64), F.lit(1 << 16)).cast("int")


def _scaled(v: Column) -> Column:
    return F.floor(v * STEP + 0.5).cast("bigint")


def _vectors(rows: DataFrame) -> DataFrame:
    """Rows with a group key ``g`` and the rounded statistics; ``rows`` has lang, source and _stats."""
    s = lambda n: F.col(f"_stats.{n}")
    key = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    d = rows.withColumns({"g2": key("_klang", "_ksource"), "g1": key("_klang")})
    ok = d.where(~s("base_failed"))
    n2 = ok.groupBy("g2", "g1").agg(F.count(F.lit(1)).alias("n2"))
    n1 = n2.groupBy("g1").agg(F.sum("n2").alias("n1"))
    sizes = n2.join(n1, "g1").select("g2", F.when(F.col("n2") >= MIN_ROWS, F.concat(F.lit("2"), "g2"))
                                     .when(F.col("n1") >= MIN_ROWS, F.concat(F.lit("1"), "g1"))
                                     .otherwise(F.lit("0")).alias("g"))
    d = d.join(materialise(sizes, "q-groups"), "g2", "left").withColumn("g", F.coalesce("g", F.lit("0")))
    total = lambda n: F.sum(F.when(~s("base_failed"), s(n)).cast("decimal(20,0)"))
    sums = d.groupBy("g").agg(*[total(n).cast("double").alias(f"t_{n}") for n in STATS])
    d = d.join(materialise(sums, "q-sums"), "g")
    word = lambda n: (s(n) + PRIOR_WORDS * F.coalesce(F.col(f"t_{n}") / F.nullif("t_n_words", F.lit(0.0)), F.lit(0.0))) / (s("n_words") + PRIOR_WORDS)
    line = (s("n_dup_lines") + PRIOR_LINES * F.coalesce(F.col("t_n_dup_lines") / F.nullif("t_n_lines", F.lit(0.0)), F.lit(0.0))) / (s("n_lines") + PRIOR_LINES)
    x = [F.log(F.greatest(word("word_chars"), F.lit(0.5))), F.sqrt(word("n_symbols")), F.sqrt(word("n_capitals")),
         F.sqrt(line), F.sqrt(word("n_repeat_words"))]
    return d.select(*[c for c in rows.columns], "g", *[_scaled(v).alias(n) for v, n in zip(x, X)])


def _moments(part: DataFrame) -> DataFrame:
    """Per group: centre m, lower Cholesky factor l of the covariance (floored), in steps."""
    dec = lambda v: v.cast("decimal(20,0)")
    agg = [F.count(F.lit(1)).alias("n")] + [F.sum(dec(F.col(a))).cast("double").alias(f"s{i}") for i, a in enumerate(X)]
    agg += [F.sum(dec(F.col(X[i]) * F.col(X[j]))).cast("double").alias(f"p{i}{j}") for i in range(D) for j in range(i + 1)]
    g = part.groupBy("g").agg(*agg)
    g = g.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(D)})
    cov = {f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
           + (F.lit((FLOORS[i] * STEP) ** 2) if i == j else F.lit(0.0)) for i in range(D) for j in range(i + 1)}
    g = g.withColumns(cov)
    for j in range(D):                        # Cholesky, column by column
        diag = F.col(f"c{j}{j}")
        for k in range(j):
            diag = diag - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        g = g.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diag, F.lit((FLOORS[j] * STEP) ** 2 / 4))))
        lower = {}
        for i in range(j + 1, D):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            lower[f"l{i}{j}"] = v / F.col(f"l{j}{j}")
        if lower:
            g = g.withColumns(lower)
    return g.select("g", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)])


def estimates(vectors: DataFrame) -> DataFrame:
    """MCD estimate per group ``g`` of vectors with columns x0..x4: centre, factor, scale."""
    q = vectors.groupBy("g").agg(*[F.expr(f"percentile({x}, array(0.25D, 0.5D, 0.75D))").alias(f"q{i}") for i, x in enumerate(X)])
    start = {f"m{i}": F.get(f"q{i}", F.lit(1)) for i in range(D)}
    for i in range(D):
        spread = (F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349
        start |= {f"l{i}{j}": F.greatest(spread, F.lit(FLOORS[i] * STEP)) if i == j else F.lit(0.0) for j in range(i + 1)}
    names = list(start)
    params = materialise(q.withColumns(start).select("g", *names), "q-par")
    for _ in range(C_STEPS):
        d = vectors.join(params, "g").withColumn("q", _quantised(_distance())).drop(*names)
        h = materialise(d.groupBy("g").agg(F.expr(f"percentile(q, {COVERAGE}D)").alias("h")), "q-h")
        nxt = materialise(_moments(d.join(h, "g").where("q <= h")), "q-par")
        remove(params)
        params = nxt
    d = vectors.join(params, "g").withColumn("q", _quantised(_distance()))
    scale = d.groupBy("g").agg(F.greatest((F.expr("percentile(q, 0.5D)") + 0.5) / 64 / CHI2_MEDIAN, F.lit(0.05)).alias("scale"))
    return materialise(params.join(scale, "g"), "q-est")


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (_klang, _ksource, _stats) plus ``d2`` and ``kept``."""
    vectors = _vectors(rows)
    est = estimates(vectors.where("not _stats.base_failed").select("g", *X))
    d = vectors.join(est, "g", "left")
    worse = [F.greatest(F.col(X[i]).cast("double"), F.col(f"m{i}")) for i in range(1, D)]
    d = d.withColumns({X[i + 1]: w for i, w in enumerate(worse)}).withColumn("d2", _distance() / F.col("scale"))
    kept = ~F.col("_stats.base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return d.select(*rows.columns, "d2", kept.alias("_kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, base_failed, the distance and kept."""
    keep = [F.col("doc_id").alias("_kid"), F.col("lang").alias("_klang"), F.col("source").alias("_ksource")]
    rows = materialise(with_stats(docs, keep), "q-stats")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(rows).select(F.col("_kid").alias("doc_id"), *[F.col(f"_stats.{c}").alias(c) for c in cols],
                               F.col("_stats.base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
                               F.round("d2", 3).alias("distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns kept; each row is judged by itself."""
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_krow"),
            F.col("lang").alias("_klang"), F.col("source").alias("_ksource")]
    rows = materialise(with_stats(docs, keep), "q-rows")
    return judged(rows).where("_kept").select(*[F.col("_krow").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))

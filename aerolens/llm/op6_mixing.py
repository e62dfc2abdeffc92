"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are numbered and cut into blocks of BLOCK_ROWS.  With
weight w, block i of a source (from 0) may not start before its release time
floor(i / w) and has to be placed by its deadline ceil((i + 1) / w).
Earliest-deadline-first over the released blocks gives one block a slot.

Weights are integers u in 1/SCALE, so windows are exact whole numbers and a
source is never a block or more from weight * slots, at any slot.  The slots
are worked out in segments of SEGMENT slots, a row each, spread over tasks.
What a segment needs of those before is only which blocks are placed at its
start: for each source the floor of weight * slots, or one more.  Segments
first start from the choice of earliest deadlines among the blocks whose
windows span that point, from which earliest-deadline-first always goes on
without a miss, and yield the state at their end.  A segment whose start is
not the end of the one before starts again from that end, until all agree:
the result is the one that a single run from slot 0 has.  Different starts
run into each other within the longest window or so, so few segments start
again; their orders are written out once all agree, again segment by segment.

The sources beyond the MAX_LANES - 1 of most weight share one lane, whose
slots are dealt to them by the same rule, in groups of groups of at most
MAX_LANES: a source there is within one block of its share of its group's
slots, each group within one of its share of the next.

The rows are numbered by two-level counts, so a source with a third of all
rows is spread over tasks.  Every row is placed exactly once.  A source that
has run out leaves its later slots empty, and the others then share in
proportion to their weights.

Without given weights a source's target is its row count to the power
TEMPERATURE, which raises small sources.

Defined cases: a null source is a source of its own (given weights name it
None), apart from the empty name; sources missing in given weights, and
weights of zero or below, get 1/LEAST of the sum of the given ones; null or
repeated doc_ids are rows like others, equal rows get different places in
either order; extra columns are kept, whatever their names; an empty table
gives no rows.  Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from aerolens.llm.common import materialise, numbered, remove, small, table

BLOCK_ROWS = 32
SEGMENT = 1000
#: a source without a given weight has one part in LEAST
LEAST = 1000
#: parts of the whole in which target weights are held
SCALE = 10 ** 9
MAX_LANES = 256
TEMPERATURE = 0.5


def _sources(docs: DataFrame, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """(src, n, units) of every source; units are the target weights in 1/SCALE."""
    counts = docs.groupBy(F.col("source").cast("string").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights:
        named = {k: max(0.0, float(v)) for k, v in weights.items() if k is not None}
        given = F.create_map(*[F.lit(x) for k, v in named.items() for x in (k, v)]) if named else None
        known = F.coalesce(given[F.coalesce("src", F.lit(""))], F.lit(0.0)) if named else F.lit(0.0)
        w = F.when(F.col("src").isNull(), F.lit(max(0.0, float(weights.get(None, 0.0))))).otherwise(known)
    else:
        w = F.pow(F.col("n").cast("double"), F.lit(temperature))
    counts = materialise(counts.withColumn("w", w), "mix-counts")
    total = F.broadcast(counts.agg(F.sum("w").alias("total")))
    units = F.greatest(F.lit(1), F.round(F.col("w") / F.col("total") * SCALE).cast("bigint"))
    units = F.when(F.col("w") > 0, units).otherwise(F.lit(SCALE // LEAST)).cast("bigint")
    return materialise(counts.crossJoin(total).select("src", "n", units.alias("units")), "mix-sources")


def _tree(sources: DataFrame) -> tuple[DataFrame, int]:
    """``sources`` with lane and number (``j``, null on an own lane), and the levels below the shared lane."""
    top = sources.orderBy(F.desc("units"), F.desc("n"), F.asc_nulls_last("src")).limit(MAX_LANES - 1)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("units"), F.desc("n"), F.asc_nulls_last("src"))   # below MAX_LANES rows
    top = top.withColumn("lane", F.row_number().over(order) - 1).withColumn("j", F.lit(None).cast("bigint"))
    top = materialise(top, "mix-top")
    other = sources.join(F.broadcast(top.select(F.col("src").alias("s"))), F.col("src").eqNullSafe(F.col("s")), "left_anti")
    other = numbered(other.withColumn("lane", F.lit(MAX_LANES - 1)), ["lane"], ["src"], "j", few=True)
    both = materialise(top.unionByName(other), "mix-tree")
    m, depth = both.where("j is not null").count(), 0
    while m > MAX_LANES ** depth:
        depth += 1
    return both, max(depth, 1) if m else 0


def _div(x, y) -> Column:
    return F.call_function("div", x, y)


def _nodes(kids: DataFrame) -> DataFrame:
    """(node, ids, w, nb, D, segments): each node's lanes as arrays (at most MAX_LANES), the sum of its weights, and how far its blocks reach."""
    one = kids.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("lane", "units", "nb"))).alias("a"))
    one = one.select("node", "a", F.transform("a", lambda x: x.lane).alias("ids"), F.transform("a", lambda x: x.units).alias("w"),
                     F.transform("a", lambda x: x.nb.cast("bigint")).alias("nb"))
    one = one.withColumn("D", F.aggregate("w", F.lit(0).cast("bigint"), lambda s, x: s + x))
    slots = F.array_max(F.transform("a", lambda x: _div(x.nb.cast("bigint") * F.col("D") + x.units - 1, x.units)))
    return one.withColumn("segments", _div(slots + F.lit(SEGMENT - 1), F.lit(SEGMENT))).drop("a")


def _first_guess(t: Column) -> Column:
    """Blocks placed before slot ``t``: the floors, and one more for the earliest deadlines among the windows that span ``t``."""
    D = F.col("D")
    floors = F.transform("w", lambda w: w * _div(t, D) + _div(w * (t % D), D))

    def more(b):
        left = (t - F.aggregate(b, F.lit(0).cast("bigint"), lambda x, y: x + y)).cast("int")
        job = lambda w, i: F.when((w * (t % D)) % D > 0, F.struct(_div((F.get(b, i) + 1) * D + w - 1, w).alias("deadline"), i.alias("i")))
        spanning = F.sort_array(F.filter(F.transform("w", job), lambda x: x.isNotNull()))
        chosen = F.transform(F.slice(spanning, 1, left), lambda x: x.i)
        return F.transform(F.array(chosen), lambda p: F.transform(b, lambda k, i: k + F.array_contains(p, i).cast("bigint")))[0]
    return F.transform(F.array(floors), more)[0]


def _run(start: Column, t0: Column, with_order: bool) -> Column:
    """Earliest deadline first over SEGMENT slots from ``t0``: the blocks placed after them, or (i, block) of each slot."""
    D = F.col("D")

    def step(state, t):
        def job(w, i):
            k = F.get(state.done, i)
            return F.when(_div(k * D, w) <= t0 + t, F.struct(_div((k + 1) * D + w - 1, w).alias("deadline"), i.alias("i"), k.alias("block")))

        def placed(x):                                 # binds the choice once
            done = F.transform(state.done, lambda k, i: F.when(i == x.i, k + 1).otherwise(k))
            if not with_order:
                return F.struct(done.alias("done"))
            return F.struct(done.alias("done"), F.concat(state.order, F.array(F.struct(x.i.alias("i"), x.block.alias("block")))).alias("order"))
        return F.transform(F.array(F.array_min(F.transform("w", job))), placed)[0]

    empty = F.array().cast("array<struct<i:int,block:bigint>>").alias("order")
    first = F.struct(start.alias("done"), empty) if with_order else F.struct(start.alias("done"))
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(SEGMENT - 1).cast("bigint"))
    return F.aggregate(slots, first, step, lambda s: s.order if with_order else s.done)


def _starts(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(node, c, start): what a run from slot 0 has placed before each segment."""
    t0 = F.col("c") * F.lit(SEGMENT)
    arrays = small(nodes.drop("segments"), n_nodes)
    of = lambda d: d.join(arrays, "node")
    run = lambda d: d.select("node", "c", "start", _run(F.col("start"), t0, False).alias("end"))
    every = nodes.select("node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("segments") - 1)).alias("c")).repartition("node", "c")
    now = materialise(run(of(every).withColumn("start", _first_guess(t0))), "mix-segments")
    while True:                                        # every pass settles one segment more at least
        before = now.select("node", (F.col("c") + 1).alias("c"), F.col("end").alias("want"))
        wrong = materialise(now.join(before, ["node", "c"]).where("start <> want").select("node", "c", F.col("want").alias("start")), "mix-again")
        n = wrong.count()
        if not n:
            remove(wrong)
            return now
        again = run(of(wrong))
        following = materialise(now.join(small(wrong.select("node", "c"), n), ["node", "c"], "left_anti").unionByName(again), "mix-segments")
        remove(now)
        remove(wrong)
        now = following


def _plan(kids: DataFrame) -> DataFrame:
    """(node, lane, block, release, deadline, slot) of the blocks of ``kids(node, lane, units, nb)``."""
    nodes = materialise(_nodes(kids), "mix-nodes")
    n_nodes = nodes.count()
    starts = _starts(nodes, n_nodes)
    t0 = F.col("c") * F.lit(SEGMENT)
    d = starts.select("node", "c", "start").join(small(nodes.drop("segments"), n_nodes), "node")
    d = d.select("node", "c", "ids", "w", "nb", "D", F.posexplode(_run(F.col("start"), t0, True)).alias("at", "x"))
    i, k, w = F.col("x.i"), F.col("x.block"), F.get("w", F.col("x.i"))
    out = d.where(k < F.get("nb", i)).select(
        "node", F.get("ids", i).alias("lane"), k.alias("block"), _div(k * F.col("D"), w).alias("release"),
        _div((k + 1) * F.col("D") + w - 1, w).alias("deadline"), (t0 + F.col("at")).alias("slot"))
    out = materialise(out, "mix-plan")
    remove(starts)
    remove(nodes)
    return out


def _joined(d: DataFrame, plan: DataFrame, node: str, lane: str, block: str) -> DataFrame:
    p = plan.select(*[F.col(c).alias(f"_mix_p_{c}") for c in plan.columns])
    p = small(p, plan.count())
    return d.join(p, (F.col(node) == F.col("_mix_p_node")) & (F.col(lane) == F.col("_mix_p_lane"))
                  & (F.col(block) == F.col("_mix_p_block")))


def _source_plan(tree: DataFrame, depth: int, block_rows: int) -> DataFrame:
    """(j, node, lane, block, release, deadline, slot): ``block`` is the source's, the rest the root's."""
    digit = lambda i: F.floor(F.col("j") / F.lit(MAX_LANES ** i)) % MAX_LANES
    nb = F.ceil(F.col("n") / F.lit(block_rows)).cast("bigint")
    tree = tree.withColumn("nb", nb)
    low, need = None, None                                   # blocks of the shared sources, as blocks of level i's node
    for i in range(depth, 0, -1):
        node = (F.col("j") % F.lit(MAX_LANES ** (i - 1))).cast("bigint")
        kids = tree.where("j is not null").groupBy(node.alias("node"), digit(i - 1).cast("int").alias("lane")).agg(
            F.sum("units").alias("units"), F.max("nb").alias("nb"))
        if need is not None:
            kids = kids.drop("nb").join(need, (F.col("node") + F.col("lane") * F.lit(MAX_LANES ** (i - 1))) == F.col("_n")).drop("_n")
        plan = _plan(kids)
        if low is None:
            mine = tree.where("j is not null").select("j", node.alias("_node"), digit(i - 1).cast("int").alias("_lane"))
            low = mine.join(plan, (F.col("_node") == F.col("node")) & (F.col("_lane") == F.col("lane"))).select(
                "j", "block", F.col("slot").alias("b"))
        else:
            low = low.withColumns({"_node": node, "_lane": digit(i - 1).cast("int")})
            low = _joined(low, plan, "_node", "_lane", "b").select("j", "block", F.col("_mix_p_slot").alias("b"))
        low = materialise(low, "mix-low")
        above = (F.col("j") % F.lit(MAX_LANES ** (i - 1))).cast("bigint")
        need = low.groupBy(above.alias("_n")).agg((F.max("b") + 1).alias("nb"))
    kids = tree.where("j is null").select(F.lit(0).cast("bigint").alias("node"), "lane", "units", "nb")
    if low is not None:
        units = tree.where("j is not null").agg(F.sum("units").alias("units"))
        kids = kids.unionByName(units.crossJoin(need.select("nb")).select(
            F.lit(0).cast("bigint").alias("node"), F.lit(MAX_LANES - 1).alias("lane"), "units", "nb"))
    kids = materialise(kids, "mix-kids")
    plan = _plan(kids)
    out = plan.where(F.col("lane") < MAX_LANES - 1).select(F.lit(-1).cast("bigint").alias("j"), *plan.columns)
    if low is not None:
        shared = low.withColumns({"_node": F.lit(0).cast("bigint"), "_lane": F.lit(MAX_LANES - 1)})
        shared = _joined(shared, plan, "_node", "_lane", "b").select("j", F.col("_mix_p_node").alias("node"), F.col("_mix_p_lane").alias("lane"),
            "block", *[F.col(f"_mix_p_{c}").alias(c) for c in ("release", "deadline", "slot")])
        out = out.unionByName(shared)
    return materialise(out, "mix-blocks")


def _free(columns: list[str], name: str = "_mix") -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def place(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS,
          temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with a struct column ``_mix``: lane, block, release, deadline, slot, in_block.

    Rows in the order of (slot, in_block) are the mix.  ``block`` counts the
    blocks of the row's source.  A column of that name stays, and the struct
    has underscores added.
    """
    tree, depth = _tree(_sources(docs, weights, temperature))
    plan = _source_plan(tree, depth, block_rows)
    named = tree.select(F.col("src").alias("_mix_src"), F.col("lane").alias("_mix_lane"), F.coalesce("j", F.lit(-1)).alias("_mix_j"))
    d = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"))
    d = d.join(small(named, tree.count()), F.col("source").cast("string").eqNullSafe(F.col("_mix_src"))).drop("_mix_src")
    d = numbered(d, ["_mix_lane", "_mix_j"], ["doc_id"], "_mix_seq", few=depth == 0)
    block = F.floor(F.col("_mix_seq") / block_rows)
    d = d.withColumns({"_mix_block": block, "_mix_in": F.col("_mix_seq") % block_rows})
    p = plan.select(*[F.col(c).alias(f"_mix_p_{c}") for c in plan.columns])
    d = d.join(small(p, plan.count()), (F.col("_mix_j") == F.col("_mix_p_j")) & (F.col("_mix_lane") == F.col("_mix_p_lane"))
               & (F.col("_mix_block") == F.col("_mix_p_block")))
    mix = F.struct(*[F.col(f"_mix_p_{c}").alias(c) for c in ("lane", "block", "release", "deadline", "slot")],
                   F.col("_mix_in").alias("in_block"))
    return d.select(*[F.col(f"_mix_row.`{c}`").alias(c) for c in docs.columns], mix.alias(_free(docs.columns)))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``docs``, range-partitioned and sorted in the order of the mix."""
    at = _free(docs.columns)
    d = place(docs, weights, block_rows).repartitionByRange(f"{at}.slot", f"{at}.in_block")
    return d.sortWithinPartitions(f"{at}.slot", f"{at}.in_block").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return place(docs).select("doc_id", "source", "_mix.*")

"""Sharding by balanced label propagation.

Documents start in shards of equal counts.  In each round every linked
document looks at the shards of its neighbours (documents that share a link
group: equal texts, or groups that the caller gives) and asks to move to the
shard that holds most of them.  Rounds alternate: in one, only shards with room
are asked, and requests to a shard are admitted up to its quota; in the next,
any shard is, and as many are admitted from one shard to another as the other
way round.  Requests are ordered by gain; where all can be admitted, they are.
Documents whose groups have come together take no further part.  Neighbours are counted per
group and shard, never as pairs, and requests are numbered by two-level
counts, so a group with a third of all rows takes no more than its share of a
task; a group larger than a shard fills shards one after the other.
Documents without links fill the places that are left, so the law holds
exactly: ``rows``, counts at most one apart.

The state of each round is written to the shared folder; the driver sees the
counts per shard only.  Only built-in functions run here.

Defined cases: null texts (size 1) are linked with nothing, empty ones with
one another; doc_id may be null or repeated, each row has a place of its own;
with fewer rows than shards some shards are empty; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolens.llm.common import materialise, numbered, remove, small, table

SHARDS = 8
ROUNDS = 8
BUCKETS = 256


def _per_shard(df: DataFrame, column: str, shards: int) -> list[int]:
    """Rows per shard (``shards`` numbers come to the driver)."""
    got = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return [int(got.get(s, 0)) for s in range(shards)]


def propagate(members: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(n, shard) of the documents of ``members(n, g)``, starting from n mod shards.

    A shard never holds more than its quota; the sum of the quotas must
    cover the documents, and so must each quota its starting documents.
    """
    shards = len(quota)
    state = materialise(members.select("n").distinct().withColumn("shard", (F.col("n") % shards).cast("int")), "sh-state")
    total = state.count()
    still = 0
    for turn_no in range(rounds):
        swap = turn_no % 2 == 1
        near = members.join(state, "n")
        split = near.groupBy("g").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b").select("g")
        open_ = materialise(near.join(split, "g", "left_semi").select("n").distinct(), "sh-open")
        n_open = open_.count()
        if not n_open:
            break
        near = near.join(small(open_, n_open), "n", "left_semi")
        room = [q - c for q, c in zip(quota, _per_shard(state, "shard", shards))]
        rooms = F.array(*[F.lit(r) for r in room])
        counts = near.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c"))
        dist = counts.groupBy("g").agg(F.collect_list(F.struct("shard", "c")).alias("dist"))      # at most one entry a shard
        # neighbours of each document by shard, over its groups
        seen = near.join(dist, "g").select("n", "shard", "g", F.explode("dist").alias("d"))
        seen = seen.groupBy("n", "shard", F.col("d.shard").alias("to")).agg(F.sum("d.c").alias("c"), F.min("g").alias("g"))
        # equal counts go by an order of shards that differs from group to group
        turn = F.pmod(F.col("to") + F.xxhash64("g"), F.lit(shards))
        seen = seen.select("n", "shard", F.struct(F.col("c"), turn.alias("turn"), F.col("to")).alias("s"))
        each = seen.groupBy("n", "shard").agg(F.max(F.when(F.col("s.to") == F.col("shard"), F.col("s"))).alias("own"),
                                              F.collect_list("s").alias("all"))
        free = (lambda s: F.lit(True)) if swap else (lambda s: F.get(rooms, s.to) > 0)
        better = F.filter("all", lambda s: free(s) & ((s.c > F.col("own.c")) | ((s.c == F.col("own.c")) & (s.turn > F.col("own.turn")))))
        asks = each.withColumn("best", F.array_max(better)).where("best is not null")
        asks = asks.select("n", "shard", F.col("best.to").alias("to"), (-F.floor(F.log2(F.col("best.c") - F.col("own.c") + 1))).cast("int").alias("level"))
        asks = materialise(asks, "sh-asks", n_open)
        asked = {(r[0], r[1]): r[2] for r in asks.groupBy("shard", "to").count().collect()}       # at most shards * shards numbers
        if swap:
            limit = [min(asked.get((i, j), 0), asked.get((j, i), 0)) for i in range(shards) for j in range(shards)]
            wants, key, at = [asked.get((i, j), 0) for i in range(shards) for j in range(shards)], ["shard", "to"], F.col("shard") * shards + F.col("to")
        else:
            limit, key, at = room, ["to"], F.col("to")
            wants = [sum(asked.get((i, j), 0) for i in range(shards)) for j in range(shards)]
        if any(w > max(0, r) for w, r in zip(wants, limit)):
            placed = numbered(asks, key, ["n"], "place", levels=["level"], buckets=BUCKETS, few=True)
            asks = placed.where(F.col("place") < F.get(F.array(*[F.lit(r) for r in limit]), at))
        moves = materialise(asks.select("n", "to"), "sh-moves", n_open)
        n_moves = moves.count()
        still = 0 if n_moves else still + 1
        if still == 2:
            break
        if n_moves:
            nxt = materialise(state.join(small(moves, n_moves), "n", "left").select("n", F.coalesce("to", "shard").alias("shard")), "sh-state", total)
            remove(state)
            state = nxt
        for t in (moves, open_):
            remove(t)
    return state


def shard(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of ``docs(doc_id, text)`` under the law ``rows``.

    ``links(doc_id, g)``: link groups instead of equal texts.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                       F.when(text.isNotNull(), F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit(1), text))).alias("g"))
    rows = materialise(numbered(rows, [], ["doc_id", "text_crc32"], "n", buckets=BUCKETS, few=True), "sh-rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    grouped = rows.select("n", "g") if links is None else rows.select("n", "doc_id").join(
        links.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("g").cast("string").alias("g")), "doc_id").select("n", "g").distinct()
    several = grouped.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g")
    members = materialise(grouped.join(several, "g", "left_semi").select("n", "g"), "sh-members")
    state = propagate(members, quota, rounds)
    linked = _per_shard(state, "shard", shards)

    placed = numbered(state, ["shard"], ["n"], "slot", buckets=BUCKETS, few=True)
    single = numbered(rows.join(state.select("n"), "n", "left_anti").select("n"), [], ["n"], "k", buckets=BUCKETS, few=True)
    ends, sofar = [], 0
    for q, c in zip(quota, linked):
        sofar += q - c
        ends.append(sofar)
    at = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        at = F.when(F.col("k") < ends[s], F.lit(s)).otherwise(at)
    before = F.array(*[F.lit(c - e + (q - c)).cast("bigint") for c, e, q in zip(linked, ends, quota)])     # slot = k - places before + linked
    single = single.withColumn("shard", at).select("n", "shard", (F.col("k") + F.get(before, F.col("shard"))).alias("slot"))
    where = placed.select("n", "shard", "slot").unionByName(single)
    out = rows.join(where, "n")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                      "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

"""Balanced label propagation: documents to shards, copies together, counts equal.

Documents with equal texts are linked. Each starts in the shard that its id hashes to. In a
round, every group's histogram over shards (its neighbours' labels) is joined back to its
members, and a member outside the group's most populated shard asks to move there, ties by a
hash. A shard takes linked documents up to its capacity: requests beyond the room that is left
are turned down by a hash of the group, so whole groups move or stay. The next round's choice
passes over shards without room for the rest of a group.

Groups of over a quarter of a shard are fewer than four for each shard, so their sizes come to
the driver, which places them first, largest first: whole where there is room, one larger than
a shard in as few shards as hold it, by rank. They take no part in the rounds.

At the end the counts are made equal (at most one apart) by moving the surplus, unlinked
documents first, to the shards that lack rows. The driver sees only counts per shard. Ranks are
taken within small hashed buckets with a prefix sum over the buckets' counts; a large group is
spread over buckets too, so no task ever sorts a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, materialize

SHARDS, ROUNDS, BUCKET_ROWS = 24, 8, 4_096
#: Linked documents may fill a shard up to 1 / SLACK below its capacity, so that turning down
#: requests by chance never overfills it.
SLACK = 32


def _bucketed(rows: DataFrame, bucket: Column, by: str = "shard") -> DataFrame:
    """``rows`` with ``rank``: gapless from 0 for each value of ``by``, by bucket."""
    rows = materialize(rows.withColumn("bucket", bucket), "ranked")
    sizes = rows.groupBy(by, "bucket").count()
    before = F.sum("count").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(by, "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(by, "bucket").orderBy("doc_id", "text_key"))
    return rows.withColumn("inside", inside).join(offsets, [by, "bucket"]).withColumn("rank", F.col("offset") + F.col("inside") - 1).drop("bucket", "inside", "offset")


def segments(groups: list[tuple[str, int]], shards: int, aim: list[int]) -> list[tuple[str, int, int, int]]:
    """``(group, first rank, end, shard)``: groups ``(name, size)`` in shards of ``aim`` rows, largest
    first; whole in the shard with the most room if that holds it, else over the emptiest ones."""
    room, made = list(aim), []
    for name, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        while at < size:
            rest = size - at
            fits = [s for s in range(shards) if room[s] >= rest]
            shard = min(fits, key=lambda s: (room[s], s)) if fits and at else max(range(shards), key=lambda s: (room[s], -s))
            take = min(rest, room[shard]) or rest
            made.append((name, at, at + take, shard))
            room[shard], at = room[shard] - take, at + take
    return made


def _lookup(values: list[int], index: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), index)


def _round(state: DataFrame, shards: int, capacity: int, held: dict[int, int], number: int, fixed: dict[int, int]) -> tuple[DataFrame, int]:
    """One round of propagation of linked rows; returns the new state and the number of moves.
    ``held`` counts the rows of each shard, ``fixed`` those that large groups have there."""
    room = [capacity - held.get(s, 0) for s in range(shards)]
    histogram = state.where("linked").groupBy("text_key", "shard").count()
    group = Window.partitionBy("text_key")
    sized = histogram.withColumn("total", F.sum("count").over(group))
    crowded = _lookup(room, F.col("shard")) < F.col("total") - F.col("count")
    ranked = sized.withColumn("place", F.row_number().over(group.orderBy(crowded, F.desc("count"), F.xxhash64("text_key", "shard"), "shard")))
    wanted = materialize(ranked.where("place = 1").select("text_key", F.col("shard").alias("target")), "wanted")
    asked = keyed_join(state, wanted, "text_key", "left")
    asked = materialize(asked.withColumn("target", F.coalesce("target", "shard")), "asked")
    stay, want = [fixed.get(s, 0) for s in range(shards)], [0] * shards
    for row in asked.where("linked").groupBy("target", (F.col("target") != F.col("shard")).alias("moves")).count().collect():
        (want if row.moves else stay)[row.target] = row["count"]
    taken = [1_000_000 if want[s] <= max(0, capacity - stay[s]) else max(0, 1_000_000 * (capacity - stay[s]) // want[s]) for s in range(shards)]
    lucky = F.pmod(F.xxhash64("text_key", F.lit(number)), F.lit(1_000_000)) < _lookup(taken, F.col("target"))
    moves = F.col("linked") & (F.col("target") != F.col("shard")) & lucky
    moved = materialize(asked.withColumn("moved", moves).withColumn("shard", F.when(moves, F.col("target")).otherwise(F.col("shard"))).drop("target"), "state")
    return moved.drop("moved"), moved.where("moved").count()


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, size, text_crc32, shard, slot, copies, cut``; copies is
    how many rows have the text, cut whether some of them are in another shard.

    Every row gets a place, also with a null id or a repeated one. A null text has no bytes
    (size 8) and is linked like an empty one. Counts of two shards differ by one at most, and
    slots are gapless from 0 in each. Further columns are ignored; an empty table gives an
    empty result.
    """
    text = F.coalesce("text", F.lit(""))
    start = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("text_key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
    )
    state = materialize(start, "start")
    total = state.count()
    capacity = max(1, -(-total // shards))
    aim = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = max(1, -(-capacity // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(buckets))
    copies = materialize(state.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    state = materialize(keyed_join(state, copies, "text_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1))), "state")
    placed = segments([(r.text_key, r.copies) for r in copies.where(F.col("copies") * 4 > capacity).collect()], shards, aim)
    large = docs.sparkSession.createDataFrame(placed, "text_key string, low long, high long, place int")
    large = F.broadcast(materialize(large, "large"))  # below five rows for each shard
    fixed = _bucketed(state.where(F.col("copies") * 4 > capacity), bucket, "text_key").join(large, "text_key").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    fixed = fixed.select(*(F.col("place").alias(c) if c == "shard" else F.col(c) for c in state.columns), F.lit(True).alias("fixed"))
    rest = state.where((F.col("copies") > 1) & (F.col("copies") * 4 <= capacity)).withColumn("linked", F.lit(True))
    taken = {r.place: r.n for r in large.groupBy("place").agg(F.sum(F.col("high") - F.col("low")).alias("n")).collect()}
    room = capacity - capacity // SLACK
    for number in range(rounds):
        held = {r.shard: r["count"] for r in rest.groupBy("shard").count().collect()}
        rest, moves = _round(rest, shards, room, {s: held.get(s, 0) + taken.get(s, 0) for s in range(shards)}, number, taken)
        if not moves:
            break
    single = state.where("copies = 1").withColumn("fixed", F.lit(False))
    state = materialize(single.unionByName(rest.drop("linked").withColumn("fixed", F.lit(False))).unionByName(fixed), "state")
    counts = {r.shard: r["count"] for r in state.groupBy("shard").count().collect()}
    surplus = [max(0, counts.get(s, 0) - aim[s]) for s in range(shards)]
    lack = [max(0, aim[s] - counts.get(s, 0)) for s in range(shards)]
    by_group = F.lit(buckets) + F.pmod(F.xxhash64("text_key"), F.lit(buckets))
    by_links = F.when(F.col("fixed"), F.lit(2 * buckets) + bucket).when(F.col("copies") > 1, by_group).otherwise(bucket)
    ranked = _bucketed(state, by_links)
    before = [sum(surplus[:s]) for s in range(shards)]
    mover = F.col("rank") + _lookup(before, F.col("shard"))
    receiver, filled = F.lit(None).cast("int"), sum(lack)
    for s in reversed(range(shards)):
        filled -= lack[s]
        if lack[s]:
            receiver = F.when(mover < filled + lack[s], F.lit(s)).otherwise(receiver)
    even = ranked.withColumn("shard", F.when(F.col("rank") < _lookup(surplus, F.col("shard")), receiver).otherwise(F.col("shard"))).drop("rank", "fixed")
    slotted = materialize(_bucketed(even, bucket), "slotted")
    ends = F.min("shard") != F.max("shard")
    cuts = materialize(slotted.where("copies > 1").groupBy("text_key").agg(ends.alias("cut")).where("cut"), "cuts")
    told = keyed_join(slotted, cuts, "text_key", "left")
    return told.select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"), "copies", F.coalesce("cut", F.lit(False)).alias("cut"))

"""SimHash near-duplicate detection with a Gray-order hierarchical Hamming index.

Fingerprints are made once per document and reduced to distinct values. Two 64-bit values at
most three bits apart agree on one of four 16-bit blocks, so each value goes to its four block
groups. A group with more than ``GROUP_ROWS`` values is dealt again by a further quarter of
the bits that are still free, where the same argument holds; after four rounds at most 20 bits
are free, which bounds any group. No value, link or group is ever dropped.

Within a group the values stand in Gray order. Runs of eight share an upper node that holds
the bits common to all of them (a mask and a pattern); runs of eight nodes share a node in
turn. A query descends level by level, adding up the differences against the bits that each
node adds to its parent's, and leaves a whole subtree when the sum passes the bound.

Three of 64 bits are only met by copies with hardly a change: of pairs at a Jaccard similarity
of 0.8 to 0.9 (five-word shingles) they find one in forty. ``similar_components`` therefore
takes two steps. The Gray-order index links the near copies that it finds, each link verified
on the shingle sets. What is still apart is then searched exactly, by prefix filtering: shingles
stand in one order for all texts, frequent ones last (counted over all documents by ``BUCKETS``
buckets of their hashes; the order decides the cost alone). Of two sets at the similarity, the first common shingle stands so early in
both that enough can follow it; so each text meets the others under its first shingles only,
and texts that share a template do not meet by the template. Under a shingle, pairs are taken by
their distance in the order of size: neighbours first, then in ``STEPS`` those further apart, up
to all, each time only pairs whose components still differ and whose sizes and positions allow
the similarity. No pair that may reach it is left out.

Texts are vertices by 64 bits of the digest of their shingle set, so neither null nor repeated
ids tie texts together.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_list, keyed_join, materialize, numbered, place_of, slices
from .components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 3
FAN, TREE_FAN, QUERY_ROWS = 8, 64, 4096
GROUP_ROWS = 2048
BLOCKS, ROUNDS = DISTANCE + 1, 4
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Bounds of the distances that a round compares; the last round has no upper one.
STEPS = (1, 2, 8, 64)
#: Buckets of shingle hashes that are counted for the order, and how many of them a row holds.
BUCKETS, BUCKET_BLOCK = 1 << 21, 1 << 10


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text's lower-cased words, repeats included; of the whole
    sequence if there are fewer words; nothing without a word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    buffer = b" ".join(words)
    h, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= shingle:
        return np.array([h(buffer, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((h(buffer[s:e], seed) for s, e in spans), np.uint64, len(words) - shingle + 1)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that over half of the rows have, as bytes; hashes (rows, words) of uint64."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255):  # a byte holds the sum of 255 bits
        counts += np.unpackbits(np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes: a bit is set if more than half of the shingles'
    XXH64 values have it. No word: zero."""
    hashes = shingle_hashes(text, shingle)
    return int.from_bytes(_majority(hashes[:, None]).tobytes(), "little") if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row with an id, whole texts; fp is the signed long with the
    fingerprint's bits. Null text counts as empty."""

    def make(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in byte_list(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(make, "doc_id long, fp long")


def gray_rank(x: Column) -> Column:
    """Position of ``x`` in Gray code order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


def block_masks() -> list[list[int]]:
    """Bit masks by round; the children of mask ``i`` stand at ``4 i`` to ``4 i + 3``."""
    levels = [[0]]
    for _ in range(ROUNDS):
        level = []
        for mask in levels[-1]:
            free = [i for i in range(64) if not mask >> i & 1]
            for part in np.array_split(free, BLOCKS):
                level.append(mask | sum(1 << int(i) for i in part))
        levels.append(level)
    return levels[1:]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class GrayIndex:
    """Hierarchy of masked patterns over groups of values that stand in Gray order."""

    def __init__(self, values: np.ndarray, group: np.ndarray) -> None:
        self.values, self.levels = values, []
        ors, ands, owner = values, values, group
        while True:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            within = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            start = np.flatnonzero(within % FAN == 0)
            ors, ands, owner = np.bitwise_or.reduceat(ors, start), np.bitwise_and.reduceat(ands, start), owner[start]
            mask = ~(ors ^ ands)
            self.levels.append({"start": start, "count": np.diff(np.r_[start, len(within)]), "mask": mask, "pattern": ands & mask})
            if len(owner) == 1 or (owner[1:] != owner[:-1]).all():
                break
        self.roots = np.searchsorted(owner, group)

    def pairs(self, lo: int, hi: int, distance: int):
        """Pairs (i, j), i < j, of the queries ``lo`` to ``hi`` within ``distance``."""
        query = np.arange(lo, hi)
        node, q = self.roots[lo:hi], self.values[lo:hi]
        spent = np.zeros(hi - lo, np.uint8)
        known = np.zeros(hi - lo, np.uint64)
        for level in reversed(self.levels):
            mask = level["mask"][node]
            spent = spent + np.bitwise_count((q ^ level["pattern"][node]) & mask & ~known)
            keep = spent <= distance
            query, node, q, spent, known = query[keep], node[keep], q[keep], spent[keep], mask[keep]
            count = level["count"][node]
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            node = np.repeat(level["start"][node], count) + offset
            query, q, spent, known = (np.repeat(x, count) for x in (query, q, spent, known))
        keep = (node > query) & (spent + np.bitwise_count((q ^ self.values[node]) & ~known) <= distance)
        return query[keep], node[keep]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i] in ``label``."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def _group_edges(values: np.ndarray, ids: np.ndarray, group: np.ndarray, distance: int):
    """Edges that span the components within each group: a tree of bounded degree each."""
    index, label = GrayIndex(values, group), np.arange(len(values))
    for at in range(0, len(values), QUERY_ROWS):
        _merge(label, *index.pairs(at, min(at + QUERY_ROWS, len(values)), distance))
    order = np.argsort(label, kind="stable")
    root = label[order]
    first = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
    base = np.repeat(first, np.diff(np.r_[first, len(root)]))
    rank = np.arange(len(root)) - base
    child = rank > 0
    return ids[order][child], ids[order][(base + (rank - 1) // TREE_FAN)[child]]


def _link(distance: int):
    def run(batches):
        kept: list[np.ndarray] = []

        def flush(rows):
            key = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
            size = np.diff(np.r_[key, len(rows)])
            many = np.repeat(size > 1, size)
            group = np.repeat(np.arange(len(key)), size)[many]
            if not many.any():
                return None
            a, b = _group_edges(rows[many, 2].copy().view(np.uint64), rows[many, 3], group, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = 0
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            kept.append(rows)
            held += len(rows)
            if held < 20_000:
                continue
            rows = np.concatenate(kept)
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            kept, held = [rows[cut:]], len(rows) - cut
            if cut and (out := flush(rows[:cut])) is not None:
                yield out
        if held and (out := flush(np.concatenate(kept))) is not None:
            yield out

    return run


def hamming_edges(values: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``values(fp, rep)``, fp distinct -> ``(a, b)``: edges between reps that connect all
    values at most three bits apart."""
    masks, parts = block_masks(), []

    def dealt(rows: DataFrame, level: int) -> DataFrame:
        spread = F.explode(
            F.array(*(F.struct(F.lit(p).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for p, m in enumerate(masks[0])))
            if level == 0
            else F.array(*(F.col("path") * BLOCKS + i for i in range(BLOCKS)))
        )
        if level == 0:
            return rows.select("fp", "rep", spread.alias("k")).select("fp", "rep", "k.path", "k.key")
        table = F.array(*(F.lit(_signed(m)) for m in masks[level]))
        return rows.select("fp", "rep", spread.alias("path")).select("fp", "rep", "path", F.col("fp").bitwiseAND(F.get(table, F.col("path").cast("int"))).alias("key"))

    rows = dealt(values, 0)
    for level in range(ROUNDS):
        if level == ROUNDS - 1:
            parts.append(rows)
            break
        large = materialize(rows.groupBy("path", "key").count().where(F.col("count") > group_rows), "large")
        if large.limit(1).count() == 0:
            parts.append(rows)
            break
        parts.append(rows.join(large, ["path", "key"], "left_anti"))
        rows = dealt(rows.join(large, ["path", "key"], "left_semi"), level + 1)
    edges = None
    for part in parts:
        ready = (
            part.select("path", "key", "fp", "rep")
            .repartition("path", "key")
            .withColumn("gray", gray_rank(F.col("fp")))
            .sortWithinPartitions("path", "key", "gray")
            .drop("gray")
        )
        found = ready.mapInArrow(_link(DISTANCE), "a long, b long")
        edges = found if edges is None else edges.union(found)
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id)``.

    Fingerprints at most three bits apart are linked; component_id is the smallest doc_id that
    can be reached. Rows without an id are left out; repeated rows come back repeated; null and
    empty texts have fingerprint zero; further columns of ``docs`` are ignored; an empty table
    gives an empty result.
    """
    made = materialize(fingerprints(docs, shingle), "fingerprints")
    values = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("rep")), "values")
    classes = connected_components(hamming_edges(values.select("fp", F.col("fp").alias("rep")), group_rows))
    label = values.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = materialize(label.join(smallest, "component").select("fp", "component_id"), "labels")
    return keyed_join(made, label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def fewest_shared(m, n, similarity: float):
    """Least number of shingles that sets of sizes m and n share at a Jaccard similarity."""
    return np.ceil(similarity / (1 + similarity) * (m + n) - 1e-9)


def packed_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(node, packed)``: compressed texts, which are smaller than their shingle sets, of the
    rows of ``docs(doc_id, text)`` that ``chosen(node, low, low_k)`` names by id and text hash."""

    def make(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.compress(t, 1) for t in byte_list(b.column(2))], pa.binary())], names=["doc_id", "k", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    packed = rows.mapInArrow(make, "doc_id long, k long, packed binary")
    own = packed.join(chosen, packed["doc_id"].eqNullSafe(chosen["low"]) & (packed["k"] == chosen["low_k"]))
    return materialize(own.select("node", "packed").dropDuplicates(["node"]), "texts")


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)``, nodes of ``texts(node, packed)``, whose shingle sets have at
    least the Jaccard similarity."""

    def verify(batches):
        own = lru_cache(64)(lambda packed: shingle_set(zlib.decompress(packed), shingle))
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = own(x), own(y)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                keep.append(np.count_nonzero(both[1:] == both[:-1]) >= fewest_shared(len(x), len(y), similarity))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(k), F.col("packed").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")


def shingle_counts(rows: DataFrame, shingle: int) -> np.ndarray:
    """For each bucket of shingle hashes, in how many of all ``rows(text)`` its shingles stand,
    summed over the shingles (32 bits, the largest number for any larger one). Tasks count all of
    their rows and send blocks of buckets, which are summed in Spark; the driver gets the sums."""

    def count(batches):
        own = np.zeros(BUCKETS, np.uint32)
        for b in slices(batches):
            found = np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t, shingle) for t in byte_list(b.column(0)))])
            np.add.at(own, (found % BUCKETS).astype(np.int64), np.uint32(1))
        blocks = own.reshape(-1, BUCKET_BLOCK)
        met = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array([blocks[i].tobytes() for i in met], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        raw = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(raw, pa.binary())], names=["block", "counts"])

    schema, total = "block long, counts binary", np.zeros((BUCKETS // BUCKET_BLOCK, BUCKET_BLOCK), np.uint32)
    summed = rows.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()
    for block, raw in zip(summed.column(0).to_pylist(), summed.column(1)):
        total[block] = np.frombuffer(raw.as_buffer(), np.uint32)
    return total.ravel()


def first_shingles(own: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """Those of a sorted shingle set, in the common order, of which two sets at the similarity
    share one."""
    n = len(own)
    if not n:
        return own
    weight = counts[(own % len(counts)).astype(np.int64)]
    return own[np.lexsort((own, weight))][: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def _may_reach(m, i, n, j, similarity: float):
    """Whether sets of sizes m and n can reach the similarity if their first common shingle
    stands at i and j."""
    return np.minimum(m - i, n - j) >= fewest_shared(m, n, similarity)


def _shared(batches):
    """``(token, n, rep, at)`` in order -> the rows whose token others have too, with their rank
    under it and how many there are."""

    def out(rows):
        first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        size = np.diff(np.r_[first, len(rows)])
        rank, size = np.arange(len(rows)) - np.repeat(first, size), np.repeat(size, size)
        keep = size > 1
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*rows.T, rank, size)], names=["token", "n", "rep", "at", "rank", "size"])

    kept: list[np.ndarray] = []
    for b in batches:
        rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        if not len(rows):
            continue
        kept.append(rows)
        if kept[0][0, 0] == rows[-1, 0]:
            continue  # one token's rows so far
        rows = np.concatenate(kept)
        cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1
        kept = [rows[cut:].copy()]
        yield out(rows[:cut])
    if kept:
        yield out(np.concatenate(kept))


def _apart(low: int, high: int | None, similarity: float):
    """Pairs at ranks ``low`` to ``high`` - 1 apart under a token, without an upper bound if
    None, of different labels that may reach the similarity."""

    def pairs(rows):
        token, rank, rep, n, at, label = rows.T
        made = [np.zeros((0, 2), np.int64)]

        def take(i, j):
            ok = (label[i] != label[j]) & _may_reach(n[i], at[i], n[j], at[j], similarity)
            if ok.any():
                made.append(np.unique(np.sort(np.stack((rep[i][ok], rep[j][ok]), axis=1), axis=1), axis=0))

        if high is not None:
            for gap in range(low, min(high, len(rows))):
                i = np.flatnonzero(token[:-gap] == token[gap:])
                if not len(i):
                    break
                take(i, i + gap)
        else:
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            for a, b in zip(first.tolist(), np.r_[first[1:], len(rows)].tolist()):
                names, code, count = np.unique(label[a:b], return_inverse=True, return_counts=True)
                if len(names) == 1:
                    continue
                most = count.argmax()
                odd = code != most  # every pair of different labels has one of these
                for i in np.flatnonzero(odd).tolist():
                    j = np.flatnonzero((np.abs(np.arange(b - a) - i) >= low) & (~odd | (np.arange(b - a) > i)))
                    take(np.full(len(j), a + i), a + j)
        found = np.unique(np.concatenate(made), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found.T], names=["a", "b"])

    def run(batches):
        kept: list[np.ndarray] = []
        held = 0
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(6)], axis=1)
            if not len(rows):
                continue
            kept.append(rows)
            held += len(rows)
            if held < 20_000 or kept[0][0, 0] == rows[-1, 0]:
                continue
            rows = np.concatenate(kept)
            cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1
            kept, held = [rows[cut:].copy()], len(rows) - cut
            yield pairs(rows[:cut])
        if held:
            yield pairs(np.concatenate(kept))

    return run


def _sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(doc_id, k, sig, node, fp, n, firsts)`` for every row of ``docs(doc_id, text)``: a hash of
    the text, the digest of its shingle set and 64 bits of it as a vertex, the SimHash of its
    shingles, and the set's size and first shingles."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = shingle_counts(rows, shingle)
    schema = "doc_id long, k long, sig binary, node long, fp long, n long, firsts array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def make(batches):
        for b in slices(batches):
            hashes = [shingle_hashes(t, shingle) for t in byte_list(b.column(2))]
            fps = np.array([_majority(h[:, None]).view(np.uint64)[0] if len(h) else 0 for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            sigs = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            nodes = np.array([int.from_bytes(x[:8], "little", signed=True) for x in sigs], np.int64)
            firsts = pa.array([first_shingles(x, similarity, counts).view(np.int64) for x in sets], pa.list_(pa.int64()))
            columns = [b.column(0), b.column(1), pa.array(sigs, pa.binary()), pa.array(nodes), pa.array(fps), pa.array([len(x) for x in sets], pa.int64()), firsts]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return materialize(rows.select("doc_id", F.xxhash64("text").alias("k"), "text").mapInArrow(make, schema), "sets")


def fingerprint_edges(one: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``one(node, fp)`` -> ``(a, b)``: edges between nodes whose fingerprints are equal or in one
    component of the Gray-order index. Nodes of one fingerprint form a tree of about
    ``TREE_FAN`` children each: in turn the smallest of ever larger shares of them is kept."""
    shares, edges, total = 1, None, one.count()
    while shares * TREE_FAN < total:
        shares *= TREE_FAN
    while shares:
        low = F.min("node").over(Window.partitionBy("fp", F.pmod(F.xxhash64("node"), F.lit(shares))))
        step = materialize(one.withColumn("low", low), "tree")
        found = step.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        one, shares = step.where("node = low").select("node", "fp"), shares // TREE_FAN
    return edges.unionByName(hamming_edges(one.select("fp", F.col("node").alias("rep")), group_rows))


def _classes(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_sets``, and ``(sig, class, low, low_k)``: the class of each shingle set, the
    smallest doc_id among its rows (null if none has one) and the hash of that row's text."""
    made = _sets(docs, shingle, similarity)
    lows = F.min("doc_id").alias("low"), F.coalesce(F.min_by("k", "doc_id"), F.min("k")).alias("low_k")
    values = materialize(made.groupBy("sig").agg(*lows, F.first("node").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("firsts").alias("firsts")), "values")
    dealt = values.select("n", F.col("node").alias("rep"), F.posexplode("firsts").alias("at", "token")).select("token", "n", "rep", F.col("at").cast("long").alias("at"))
    ordered = dealt.repartition("token").sortWithinPartitions("token", "n", "rep", "at")
    shared = materialize(ordered.mapInArrow(_shared, "token long, n long, rep long, at long, rank long, size long"), "shared")
    edges = materialize(fingerprint_edges(values.where("n > 0").select("node", "fp")), "edges")
    met = edges.select(F.col("a").alias("node")).union(edges.select("b")).union(shared.select("rep")).distinct()
    texts = packed_texts(docs, values.select("node", "low", "low_k").join(met, "node", "left_semi"))
    links = similar_pairs(edges, texts, shingle, similarity)
    classes = materialize(connected_components(links), "components")
    for low, high in zip(STEPS, (*STEPS[1:], None)):
        open_ = shared.where(F.col("size") > low)
        open_ = open_.join(classes.withColumnsRenamed({"node": "rep", "component": "label"}), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        ready = open_.select("token", "rank", "rep", "n", "at", "label").repartition("token").sortWithinPartitions("token", "rank")
        found = materialize(ready.mapInArrow(_apart(low, high, similarity), "a long, b long").distinct(), "candidates")
        if found.limit(1).count() == 0:
            continue
        links = links.union(similar_pairs(found, texts, shingle, similarity))
        classes = materialize(connected_components(links), "components")
    label = values.join(classes, "node", "left").select("sig", F.coalesce("component", "node").alias("class"), "low", "low_k")
    return made, materialize(label, "labels")


def similar_components(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, component_id)`` by the Jaccard similarity of
    shingle sets: all pairs at the similarity or above are linked, and no others.

    Texts without a word are equal to each other; rows that repeat an id with another text have
    the class of that text; otherwise as ``near_duplicates``.
    """
    made, label = _classes(docs, shingle, similarity)
    smallest = label.groupBy("class").agg(F.min("low").alias("component_id"))
    own = materialize(label.join(smallest, "class").select("sig", "component_id"), "components")
    return keyed_join(made.where("doc_id is not null").select("doc_id", "sig"), own, "sig").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs``, all columns whatever their names, for each class of texts that
    ``similar_components`` links: that with the smallest doc_id.

    Rows are told apart by id and text, so two that share an id are judged each by its text, and
    a row without an id goes if its class has one with an id; of rows that repeat both, one stays.
    Null texts and texts without a word are one class. An empty table gives an empty result.
    """
    plain = numbered(docs)
    rows = plain.select(F.col(f"c{place_of(docs, 'doc_id')}").cast("long").alias("doc_id"), F.col(f"c{place_of(docs, 'text')}").alias("text"))
    made, label = _classes(rows, shingle, similarity)
    smallest = label.groupBy("class").agg(F.min("low").alias("low"), F.coalesce(F.min_by("low_k", "low"), F.min("low_k")).alias("low_k"))
    own = materialize(label.select("sig", "class").join(smallest, "class").select("sig", "low", "low_k"), "kept")
    marked = keyed_join(made.select("doc_id", "k", "sig"), own, "sig").select("doc_id", "k", (F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("k") == F.col("low_k"))).alias("stays"))
    counts = materialize(marked.groupBy("doc_id", "k").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "marked")

    def same(other: DataFrame):
        return F.col("id").eqNullSafe(other["doc_id"]) & (F.col("key") == other["k"])

    keyed = plain.withColumns({"id": F.col(f"c{place_of(docs, 'doc_id')}").cast("long"), "key": F.xxhash64(F.col(f"c{place_of(docs, 'text')}"))})
    gone, again = counts.where("not stays"), counts.where("stays and n > 1")
    kept = keyed.join(gone, same(gone), "left_anti")
    if again.limit(1).count():
        kept = kept.join(again, same(again), "left_anti").unionByName(kept.join(again, same(again), "left_semi").dropDuplicates(["id", "key"]))
    return kept.drop("id", "key").toDF(*docs.columns)

"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A text is the multiset of its paragraphs (pieces between line ends, a longer one cut behind
sentence ends). Each paragraph is hashed to a wide vector and the vectors are summed, lane by
lane, modulo powers of two, so equal multisets have equal fingerprints in whatever order, and
a paragraph is inserted or deleted by adding or subtracting its vector.

Two kinds of lanes are summed:

* ``WIDE`` words modulo 2**48 from independent 64-bit hashes: they decide equality;
* ``BITS`` counters modulo 2**20, each the number of paragraphs whose hash has that bit. Twice
  a counter less the number of paragraphs is a random +-1 projection of the multiset, so the
  cosine of two documents' projections estimates that of their paragraph counts: likeness.

The counters stand three to a 63-bit word with a guard bit each, which makes a paragraph's
whole contribution one shift and mask per word. The last word counts the paragraphs. Counters
and count wrap at 2**20: equality holds for any text, likeness for those of fewer paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WIDE, BITS, FIELD = 3, 126, 21
WIDE_MASK = (1 << 48) - 1
LANES = (1 << 20) - 1
FIELDS = LANES | LANES << FIELD | LANES << 2 * FIELD
PICK = 1 | 1 << FIELD | 1 << 2 * FIELD
SEEDS = (101, 211, 307)
#: Ids are put in buckets of about this many rows to find each document's successor.
BUCKET_ROWS, MAX_RANGES = 4_096, 1_000_000
#: Where a paragraph ends: a line end, or white space behind a sentence end.
ENDS = r"[\r\n]+|(?<=[.!?;:,])[ \t]+"
WORDS = WIDE + BITS // 3 + 1


def paragraphs(text: Column) -> Column:
    """The non-empty paragraphs of a text; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ENDS), lambda p: p != "")


def fingerprint(text: Column) -> Column:
    """Summed words: ``WIDE`` of 48 bits, ``BITS / 3`` of three counters, and the count."""
    names = "abc"
    hashes = lambda p: F.struct(*(F.xxhash64(F.lit(seed), p).alias(n) for n, seed in zip(names, SEEDS)))

    def add(acc: Column, h: Column) -> Column:
        words = [(acc[i] + h[n].bitwiseAND(F.lit(WIDE_MASK))).bitwiseAND(F.lit(WIDE_MASK)) for i, n in enumerate(names)]
        at = WIDE
        for name in names[: BITS // (3 * FIELD)]:
            for shift in range(FIELD):
                words.append((acc[at] + F.shiftrightunsigned(h[name], shift).bitwiseAND(F.lit(PICK))).bitwiseAND(F.lit(FIELDS)))
                at += 1
        return F.array(*words, (acc[at] + 1).bitwiseAND(F.lit(LANES)))

    return F.aggregate(F.transform(paragraphs(text), hashes), F.array_repeat(F.lit(0).cast("long"), WORDS), add)


_MASKS = [WIDE_MASK] * WIDE + [FIELDS] * (BITS // 3) + [LANES]
_GUARDS = [0] * WIDE + [(1 << 20) * PICK] * (BITS // 3) + [0]


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union (or with ``sign=-1`` the difference) of two multisets. Each word
    names its arguments, so they should be columns, not long expressions."""
    words = []
    for i, (mask, guard) in enumerate(zip(_MASKS, _GUARDS)):
        x, y = F.get(a, F.lit(i)), F.get(b, F.lit(i))
        words.append((x + y if sign > 0 else x.bitwiseOR(F.lit(guard)) - y).bitwiseAND(F.lit(mask)))
    return F.array(*words)


def exchange(a: Column, out: Column, into: Column) -> Column:
    """Fingerprint after deletion of ``out`` and insertion of ``into``."""
    words = []
    for i, (mask, guard) in enumerate(zip(_MASKS, _GUARDS)):
        x, y, z = (F.get(c, F.lit(i)) for c in (a, out, into))
        words.append(((x.bitwiseOR(F.lit(guard)) - y).bitwiseAND(F.lit(mask)) + z).bitwiseAND(F.lit(mask)))
    return F.array(*words)


def digest(words: Column) -> Column:
    """A fingerprint's words as hexadecimal text."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated cosine of two multisets' counts from their fingerprints; 1 for equal
    fingerprints, 0 if just one of them is empty."""
    zero = F.lit(0).cast("long")
    counts = [F.get(x, F.lit(WORDS - 1)) for x in (a, b)]
    lanes = F.zip_with(F.slice(a, WIDE + 1, BITS // 3), F.slice(b, WIDE + 1, BITS // 3), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def add(acc: Column, pair: Column) -> Column:
        ab, aa, bb = acc["ab"], acc["aa"], acc["bb"]
        for k in range(3):
            x, y = (F.shiftrightunsigned(pair[name], k * FIELD).bitwiseAND(F.lit(LANES)) * 2 - n for name, n in zip("xy", counts))
            ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
        return F.struct(ab.alias("ab"), aa.alias("aa"), bb.alias("bb"))

    start = F.struct(zero.alias("ab"), zero.alias("aa"), zero.alias("bb"))
    cosine = F.aggregate(lanes, start, add, lambda s: F.when((s["aa"] == 0) | (s["bb"] == 0), 0.0).otherwise(s["ab"] / F.sqrt(s["aa"].cast("double") * s["bb"].cast("double"))))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def bucketed(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, max_ranges: int = MAX_RANGES) -> tuple[DataFrame, list[str]]:
    """``docs(doc_id, ...)`` with columns that deal the ids in ranges of about ``bucket_rows``, and
    the columns' names. Ids are cut at equal widths; a range that holds over four times as many
    is cut again between its own smallest and largest id, until none is left, so neither
    outlying nor clustered ids gather in one. Positions are doubles, which keep the order; rows
    of one id (or of ids that no double tells apart) stay together."""
    at, total = F.col("doc_id").cast("double"), docs.count()
    size = max(bucket_rows, -(-total // max_ranges))
    low, high, n = F.min(at), F.max(at), F.count(F.lit(1))
    parts = F.ceil(F.col("n") / F.lit(size))
    names: list[str] = []
    while True:
        spans = docs.groupBy(*names).agg(low.alias("low"), high.alias("high"), n.alias("n")).where((F.col("n") > F.lit(4 * size if names else 0)) & (F.col("high") > F.col("low")))
        cuts = materialize(spans.select(*names, "low", ((F.col("high") - F.col("low")) / parts).alias("width")), "cuts")
        if names and cuts.limit(1).count() == 0:
            return docs, names
        name = f"bucket{len(names)}"
        met = docs.join(F.broadcast(cuts), names, "left") if names else docs.crossJoin(F.broadcast(cuts)) if cuts.count() else docs.withColumns({"low": F.lit(None).cast("double"), "width": F.lit(1.0)})
        docs = met.withColumn(name, F.coalesce(F.floor((at - F.col("low")) / F.col("width")), F.lit(0)).cast("long")).drop("low", "width")
        names = [*names, name]


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """``docs(doc_id, text)`` with ``own``, the fingerprint, and ``next_text`` and ``next_own``:
    text and fingerprint of the document that follows by descending doc_id, after the last the
    first.

    Ids are dealt in ranges (``bucketed``) and a window in each gives the successor, so a text is
    shuffled once. Only the last row of a range needs the first text of the next range that has
    rows. There are a few times ``max_ranges`` ranges at most, which bounds the table of their
    first ids (16 bytes each) that is broadcast. Rows with equal ids follow each other by text.
    """
    docs, by = bucketed(docs, bucket_rows, max_ranges)
    order = Window.partitionBy(*by).orderBy(F.desc("doc_id"), "text")
    led = docs.withColumn("own", fingerprint(F.col("text"))).withColumn("inside", F.lead(F.struct("text", "own")).over(order))

    heads = materialize(docs.groupBy(*by).agg(F.max("doc_id").alias("doc_id")), "heads")
    texts = docs.select("doc_id", "text").join(F.broadcast(heads.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    down = Window.orderBy(F.desc("doc_id"))
    chain = heads.select(*by, F.coalesce(F.lead("doc_id").over(down), F.max("doc_id").over(down)).alias("doc_id"))
    outside = chain.join(texts, "doc_id").select(*by, F.struct("text", fingerprint(F.col("text")).alias("own")).alias("outside"))
    joined = led.join(materialize(outside, "outside"), by, "left").withColumn("next", F.coalesce("inside", "outside"))
    return joined.select("doc_id", "text", "own", F.col("next.text").alias("next_text"), F.col("next.own").alias("next_own"))


def with_edit(rows: DataFrame) -> DataFrame:
    """``rows(text, own, next_text, ...)`` with ``edited``, the text whose last third (rounded down,
    in code points) is replaced by as many of the first code points of the next, or all of them,
    and ``changed``, its fingerprint: from that of the text, ``own``, the paragraphs behind the last
    line that is kept whole are deleted and those that take their place inserted."""
    text, n = F.col("text"), F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumns({"kept": F.substring(text, F.lit(1), n - cut), "put": F.substring("next_text", F.lit(1), cut)})
    broken = F.substring_index("kept", "\n", -1)  # what is kept of the line that the edit cuts
    start = F.char_length("kept") - F.char_length(broken)
    parts = {"edited": F.concat("kept", "put"), "out": fingerprint(F.substring(text, start + 1, n)), "into": fingerprint(F.concat(broken, "put"))}
    return rows.withColumns(parts).withColumn("changed", exchange(F.col("own"), F.col("out"), F.col("into"))).drop("kept", "put", "out", "into")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text and the likenesses.

    Null texts count as empty. Rows without an id are left out; repeated rows come back
    repeated and follow each other; further columns are ignored; a single document is followed
    by itself; an empty table gives an empty result.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    made = with_edit(with_next(rows)).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own",
        "changed",
        "next_own",
    )
    return materialize(made, "vectors").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )

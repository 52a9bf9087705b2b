"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces. A passage within k
edits of it must contain one of the pieces unchanged, so an automaton over all pieces finds
every place that can match in one pass over a text; each is then verified in a window around
it with Myers' bit-parallel edit distance, whose bit vectors are Python integers of any
length.

Items and texts are compared lower-cased with white space runs as one space. The test items
are a stated query set: they come to the driver in blocks of ``BLOCK_ITEMS`` and each block is
matched against all documents.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, slices

CHARS_PER_EDIT, BLOCK_ITEMS = 16, 20_000


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    """Edits allowed for an item: one for every ``chars_per_edit`` characters."""
    return min(length // chars_per_edit, max(0, length - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of near equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Smallest edit distance of a pattern to any substring of a text."""

    def __init__(self, pattern: str) -> None:
        self.m, self.eq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i
        self.counts = Counter(pattern)

    def search(self, text: str, k: int) -> tuple[int, int] | None:
        """(distance, end) of the first best match with at most ``k`` edits."""
        if sum(max(0, n - text.count(c)) for c, n in self.counts.items()) > k:
            return None
        full, top, get = (1 << self.m) - 1, 1 << (self.m - 1), self.eq.get
        up, down, score, best = full, 0, self.m, (self.m, 0) if self.m <= k else None
        for at, c in enumerate(text):
            eq = get(c, 0)
            diag = (((eq & up) + up) ^ up) | eq | down
            right, left = down | (full & ~(diag | up)), up & diag
            if right & top:
                score += 1
            elif left & top:
                score -= 1
            right, left = (right << 1) & full, (left << 1) & full
            up, down = left | (full & ~(diag | right)), right & diag
            if score <= k and (best is None or score < best[0]):
                best = score, at + 1
                if not score:
                    break
        return best


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int) -> None:
        self.items, places = [], {}
        for item_id, text in items:
            if not (text := normalise(text)):
                continue
            k = budget(len(text), chars_per_edit)
            for offset, piece in pieces(text, k):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, k, Myers(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str):
        """``(item_id, distance, start, end)`` in the normalised text, the best match of each
        item; start is where the item would begin without edits before the piece."""
        text, found, seen = normalise(text), {}, set()
        if not self.items:
            return
        for end, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                at = end + 1 - size - offset
                if (number, at) in seen or found.get(number, (1,))[0] == 0:
                    continue
                seen.add((number, at))
                item_id, item, k, myers = self.items[number]
                if at >= 0 and text.startswith(item, at):
                    found[number] = 0, at, at + len(item)
                    continue
                lo = max(0, at - k)
                if (hit := myers.search(text[lo : at + len(item) + k], k)) and hit[0] < found.get(number, (k + 1,))[0]:
                    found[number] = hit[0], max(0, at), lo + hit[1]
        for number, (distance, start, stop) in found.items():
            yield self.items[number][0], distance, start, stop


def item_blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS):
    """The items ``(item_id, text)`` that have both, in lists of about ``block_items``."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    blocks = -(-items.count() // block_items)
    for number in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        yield [tuple(r) for r in part.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs(doc_id, text)`` and ``benchmark(item_id, text)`` -> one row for each document and
    item that it holds: ``doc_id, item_id, distance, start, end`` (in the normalised text).

    Null or empty texts and items match nothing; rows without an id are left out; repeated rows
    give repeated matches; further columns are ignored; with an empty table the result is
    empty.
    """
    names, kinds = ["doc_id", "item_id", "distance", "start", "end"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    schema, found = "doc_id long, item_id long, distance int, start long, end long", None
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")

    def scan(block: list[tuple[int, str]]):
        def run(batches):
            matcher = Matcher(block, chars_per_edit)
            for b in slices(batches):
                out = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in matcher.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        return rows.mapInArrow(run, schema)

    for block in item_blocks(benchmark, block_items):
        hits = scan(block)
        found = hits if found is None else found.union(hits)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text holds no test item.

    Each row is judged by its own text, so null and repeated ids make no difference. Null and
    empty texts and items match nothing; repeated rows stay repeated or go together; with an
    empty benchmark every row stays.
    """
    for block in item_blocks(benchmark, block_items):
        docs = keep_rows(docs, ["text"], lambda block=block: _lacks(Matcher(block, chars_per_edit)))
    return docs


def _lacks(matcher: Matcher):
    return lambda text: text is None or next(matcher.find(text), None) is None

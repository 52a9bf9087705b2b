"""Best-fit packing of tokenised documents into fixed-length sequences.

Two steps. ``token_pieces`` tokenises whole texts and cuts only documents longer than a
sequence. ``place`` deals the pieces (without their tokens) into groups of about
``GROUP_PIECES`` and packs each group online: an open sequence stands in a bucket for its free
space, a bitset over the buckets gives the tightest sequence that still has room in one
shift, and when ``OPEN_BINS`` sequences are open the fullest is closed. Memory per task is the
open bins alone. What a group leaves open at its end is the only loss from dealing.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, materialize, portions

MAX_TOKENS, END_ID = 2048, 0
OPEN_BINS, GROUP_PIECES = 4096, 65536
CACHE_WORDS, CACHE_BYTES = 400_000, 64
_MARKS = string.punctuation.replace("'", "")
#: A letter among the code points below 256.
_LATIN = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"


class ChunkTokenizer:
    """Ids of a text as little-endian 32-bit bytes, made from the ids of its chunks between
    ASCII white space, each distinct part of a call looked up once.

    Exact for a tokenizer that composes and lower-cases by character, drops white space and lets
    no token span it. A chunk of letters with ASCII marks behind it has two parts, since its
    pattern never joins letters and marks; letters that are not known yet are encoded together,
    each run of ids ending at a token with the end-of-word suffix. Letters of Latin-1, which
    composing leaves as they are, are lower-cased here and go by ``plain``, the same merges without
    normalising and pattern. A text that has the name of an added token in it, in whatever case, is
    left to the tokenizer as it is. Known parts lie in arrays; beyond ``CACHE_WORDS`` the half that
    was used last is kept.
    """

    def __init__(self, path: str, suffix: str = "</w>") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.parts, self.ids, self.calls = pa.array([], pa.large_string()), np.zeros(0, "<u4"), 0
        self.start, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def _ids(self, text: str, coder=None) -> np.ndarray:
        return np.array((coder or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _split(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Two parts of each chunk: letters, or all of it, and marks behind letters."""
        heads = pc.ascii_rtrim(chunks, _MARKS)
        latin = pc.match_substring_regex(heads, f"^{_LATIN}+$")
        hard = np.flatnonzero(~latin.to_numpy(zero_copy_only=False))
        some = [x.decode("utf-8", "replace") for x in heads.take(pa.array(hard)).view(pa.large_binary()).to_pylist()]
        whole = np.zeros(len(chunks), bool)
        whole[hard] = [not x.isalpha() for x in some]
        heads = pc.if_else(pa.array(whole), chunks, heads)
        low = pc.replace_with_mask(heads, latin, pc.utf8_lower(heads.filter(latin)))
        n = pc.subtract(pc.binary_length(chunks), pc.binary_length(heads)).to_numpy()
        ends, held = np.cumsum(n), chunks.buffers()
        place = np.repeat(np.frombuffer(held[1], np.int64)[1 : len(chunks) + 1] - ends, n) + np.arange(n.sum())
        marks = np.frombuffer(held[2] or b"", np.uint8)[place]
        return low, pa.Array.from_buffers(pa.large_string(), len(chunks), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(marks)])

    def _learn(self, parts: pa.Array) -> None:
        """Adds parts that are not known."""
        latin = pc.match_substring_regex(parts, f"^{_LATIN}+$")
        rest = parts.filter(pc.invert(latin)).view(pa.large_binary()).to_pylist()
        letters, single = [], []
        for part in rest:
            (letters if part.decode("utf-8", "replace").isalpha() else single).append(part)
        runs = [(self.plain, parts.filter(latin)), (self.tokenizer, pa.array(letters, pa.large_binary()).view(pa.large_string()))]
        single = [(x, self._ids(x.decode("utf-8", "replace"))) for x in single]
        ids, size, names = [i for _, i in single], [np.array([len(i) for _, i in single], np.int64)], [pa.array([x for x, _ in single], pa.large_binary()).view(pa.large_string())]
        for coder, heads in runs:
            for at in range(0, len(heads), 2048):
                some = heads.slice(at, 2048)
                texts = [x.decode() for x in some.view(pa.large_binary()).to_pylist()]
                got = self._ids(" ".join(texts), coder)
                stops = np.flatnonzero(self.ends[got]) + 1
                if len(stops) == len(some) and stops[-1] == len(got):
                    n = np.diff(stops, prepend=0)
                else:
                    each = [self._ids(x) for x in texts]
                    got, n = np.concatenate(each), np.array([len(x) for x in each])
                ids.append(got)
                size.append(n)
                names.append(some)
        size = np.concatenate(size)
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size, self.used = np.append(self.size, size), np.append(self.used, np.zeros(len(size), np.int64))
        self.ids, self.parts = np.concatenate([self.ids, *ids]), pa.concat_arrays([self.parts, *names])

    def _forget(self) -> None:
        short = np.flatnonzero(pc.binary_length(self.parts).to_numpy() <= CACHE_BYTES)
        keep = np.sort(short[np.argsort(-self.used[short], kind="stable")[: CACHE_WORDS // 2]])
        self.parts, size, self.used = self.parts.take(pa.array(keep)), self.size[keep], self.used[keep]
        self.ids = _runs(self.ids, self.start[keep], size)
        self.start, self.size = np.cumsum(size) - size, size

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        if len(self.parts) > CACHE_WORDS or self.parts.nbytes > CACHE_BYTES * CACHE_WORDS:
            self._forget()
        named = [self._named(t) for t in texts]
        column = pa.array([b"" if whole else t for t, whole in zip(texts, named)], pa.large_binary())
        words = pc.ascii_split_whitespace(column.view(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        parts = pa.concat_arrays(self._split(coded.dictionary)).dictionary_encode()
        found = pc.index_in(parts.dictionary, value_set=self.parts)
        if found.null_count:
            new, n = parts.dictionary.filter(found.is_null()), len(self.parts)
            self._learn(new)
            found = pc.replace_with_mask(found, found.is_null(), pc.add(pc.index_in(new, value_set=self.parts.slice(n)), pa.scalar(n, pa.int32())))
        found = found.to_numpy()
        self.calls += 1
        self.used[found] = self.calls
        pair = found[parts.indices.to_numpy()].reshape(2, -1).T[coded.indices.to_numpy()].ravel()
        size = self.size[pair]
        stream = _runs(self.ids, self.start[pair], size)
        cuts = np.append(0, np.cumsum(size)[1::2])[words.offsets.to_numpy()].tolist()
        return [self._ids(t.decode("utf-8", "replace")).tobytes() if whole else stream[a:b].tobytes() for t, whole, a, b in zip(texts, named, cuts, cuts[1:])]

    def _named(self, text: bytes) -> bool:
        low = text.lower()
        return any(name in low for name in self.added)


def _runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``size`` values from ``start`` one behind the other."""
    return values[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]


@lru_cache(1)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for all tasks that a process runs, with the chunks it has learnt."""
    return ChunkTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, piece, start, length, ids)``; ids are
    little-endian unsigned 32-bit. A null text counts as empty and gives the end id alone."""

    def run(batches):
        coder, end = chunk_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in portions(batches, 1):
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), coder.encode(byte_list(b.column(1)))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    out.append((doc, piece, at // 4, len(part) // 4, part))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class BestFit:
    """Bounded-space online best fit. ``put`` returns (sequence, offset)."""

    def __init__(self, size: int, open_bins: int) -> None:
        self.size, self.open_bins, self.count, self.made = size, open_bins, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0

    def _take(self, space: int) -> int:
        sequence = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.count -= 1
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        fit = self.bits >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            sequence = self._take(space)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, sequence = self.size, self.made
            self.made += 1
        if left := space - length:
            self.free[left].append(sequence)
            self.bits |= 1 << left
            self.count += 1
        return sequence, self.size - space


def place(pieces: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` from a written table, all columns kept, plus
    ``sequence_id`` and ``offset``: sequences hold at most ``max_tokens`` without gaps."""
    groups = -(-max(1, pieces.count()) // group_pieces)
    names = pieces.columns
    at = names.index("length")

    def run(batches):
        fit, base = BestFit(max_tokens, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            put = [fit.put(n) for n in b.column(at).to_pylist()]
            sequence = pa.array([base + s for s, _ in put], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, sequence, pa.array([o for _, o in put], pa.int64())], names=[*names, "sequence_id", "offset"])

    dealt = pieces.repartition(groups, "doc_id", "piece").sortWithinPartitions(*names)
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one end token; rows with a null id or repeated rows are packed
    like any other; further columns are ignored; an empty table gives an empty result.
    """
    pieces = token_pieces(docs, tokenizer, max_tokens, end_id)
    return place(materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), max_tokens)


def sequences(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``(sequence_id, ids array<int>)``: the training sequences themselves. Every row of ``docs``
    is packed once, also with a null or repeated id: tokens and places are joined by a number
    that each row gets when it is tokenised."""
    numbered = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    pieces = materialize(token_pieces(numbered, tokenizer, max_tokens, end_id), "tokens")
    placed = place(materialize(pieces.drop("ids"), "pieces"), max_tokens).select("doc_id", "piece", "sequence_id", "offset")
    joined = placed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    ordered = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def unpack(batches):
        for b in batches:
            rows = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return ordered.mapInArrow(unpack, "sequence_id long, ids array<int>")

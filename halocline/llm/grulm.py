"""A gated recurrent language model that scores complete documents.

Words of the training documents are counted over the whole corpus. The ``WORDS`` most frequent
are symbols of their own; every other word belongs to one of ``BUCKETS`` symbols by its first
bytes, and is drawn within that by its smoothed count. A one-layer GRU over symbols has a
class-factored softmax: symbols by falling frequency stand in classes of equal summed root
frequency, and a symbol's probability is its class's times its own within the class. Biases
start at the corpus frequencies.

The recurrent weights are fitted in numpy by truncated backpropagation over all training
documents. One task makes a start from about ``START_TOKENS`` tokens, drawn evenly by row; in
each of ``SWEEPS`` rounds every partition then goes on from the common weights over all of its
documents, ``CHUNK`` tokens at a time, and the next weights are the means by tokens, summed in
Spark by blocks of weights. A corpus no larger than the start's share has only the start.

Scoring covers every whole document: documents run in parallel lanes, a window of ``WINDOW``
tokens at a time, and a lane's state is carried from window to window until its document ends,
when the lane takes the next one.

Counts of at most ``LOCAL_WORDS`` most frequent words travel with the tasks; a document's other
words are joined with the whole count table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_list, materialize, portions, slices

WORDS, BUCKETS, PREFIX, CLASSES = 3_840, 256, 3, 64
HIDDEN, WINDOW, LANES, ORDERED, ROWS = 32, 32, 1024, 4_000_000, 16_384
#: Rows whose logits of classes are made at once; they stay in a core's own cache.
CLASS_ROWS = 2048
LOCAL_WORDS, FLUSH_WORDS = 131_072, 200_000
START_TOKENS, START_LANES, EPOCHS, RATE = 1_500_000, 64, 2, 8e-3
SWEEPS, CHUNK, SWEEP_LANES, SWEEP_RATE = 1, 2_000_000, 512, 2e-3
#: Weights in a block, and the shares of the partitions that are summed first.
BLOCK, SHARES = 4096, 1024
END = b"\n"


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[:PREFIX]) % BUCKETS


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a string column as binary, which of them each word is, and where the
    words of each row begin, with the end."""
    plain = pa.array(byte_list(texts), pa.large_binary()).view(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    coded = lists.flatten().dictionary_encode()
    index, distinct = coded.indices.to_numpy(), coded.dictionary.view(pa.large_binary())
    real = pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)[index]
    begins = np.append(0, np.cumsum(real))[lists.offsets.to_numpy()]
    return distinct.cast(pa.binary()), index[real], begins


def count_words(docs: DataFrame) -> DataFrame:
    """``(word binary, n)`` over all rows of ``docs(text)``; one ``END`` for each row."""

    def run(batches):
        held, size = [], 0

        def pack():
            found = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            held.clear()
            yield from found.rename_columns(["word", "n"]).to_batches(max_chunksize=FLUSH_WORDS)

        for b in portions(batches, 0):
            distinct, index, _ = _words(b.column(0))
            n = np.bincount(index, minlength=len(distinct))
            there = np.flatnonzero(n)
            words = pa.concat_arrays([distinct.take(pa.array(there)), pa.array([END], pa.binary())])
            held.append(pa.RecordBatch.from_arrays([words, pa.array(np.append(n[there], b.num_rows), pa.int64())], names=["word", "n"]))
            size += len(words)
            if size > 4 * FLUSH_WORDS:
                yield from pack()
                size = 0
        if held:
            yield from pack()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the local words and the symbols; symbol 0 is the end of a document."""

    total: int  # N
    distinct: int  # V
    words: list[bytes]  # local words by falling count
    counts: np.ndarray
    symbols: np.ndarray  # of the local words
    bucket_symbols: np.ndarray
    bucket_mass: np.ndarray  # smoothed counts of the words in each bucket
    frequency: np.ndarray  # of the symbols
    class_start: np.ndarray  # first symbol of each class, and the number of symbols


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What the model needs of a written count table: the words whose counts are among the
    ``LOCAL_WORDS`` largest, two totals and a sum for each bucket come to the driver. A
    histogram over steps of a sixteenth of a doubling gives the least count that keeps within
    that number, so no task sends more than belongs to the result."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("n") * 16).cast("int")
    kept, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        if kept + r.k > LOCAL_WORDS:
            break
        kept, least = kept + r.k, r.step
    local = (F.col("word") == F.lit(END)) if least is None else (step >= least) | (F.col("word") == F.lit(END))
    top = sorted(counts.where(local).collect(), key=lambda r: (-r.n, bytes(r.word)))
    words, n = [bytes(r.word) for r in top], np.array([r.n for r in top], np.float64)
    mass = np.zeros(BUCKETS)
    for r in counts.where(F.col("word") != F.lit(END)).groupBy((F.crc32(F.substring("word", 1, PREFIX)) % BUCKETS).alias("b")).agg(F.sum(F.col("n") + 0.5).alias("m")).collect():
        mass[r.b] = r.m
    own = [i for i, w in enumerate(words) if w != END][:WORDS]
    for i in own:
        mass[bucket_of(words[i])] -= n[i] + 0.5
    mass = np.maximum(mass, 0) + 0.5
    ends = n[words.index(END)] if END in words else 0.0
    raw = np.concatenate(([ends + 0.5], n[own] + 0.5, mass))
    order = np.concatenate(([0], 1 + np.argsort(-raw[1:], kind="stable")))
    place = np.empty(len(raw), np.int64)
    place[order] = np.arange(len(raw))
    bucket_symbols = place[1 + len(own) :]
    symbols = np.array([bucket_symbols[bucket_of(w)] for w in words], np.int64)
    symbols[own] = place[1 : 1 + len(own)]
    if END in words:
        symbols[words.index(END)] = 0
    share = np.cumsum(np.sqrt(raw[order]))
    cls = np.minimum((share / share[-1] * CLASSES).astype(int), CLASSES - 1)
    start = np.concatenate((np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]), [len(raw)]))
    return Vocabulary(int(total), int(distinct), words, n, symbols, bucket_symbols, mass, raw[order], start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / inf is 0
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in any order, and the sums of their rows: pairs of rows are added until
    each key has one."""
    done, keys = [], keys.astype(np.uint16)
    while len(keys):
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        n = np.diff(first, append=len(k))
        alone = first[n == 1]
        done.append((k[alone], rows[order[alone]]))
        odd = (first + n - 1)[(n > 1) & (n % 2 == 1)]  # their last rows wait
        pair = np.arange(len(k)) - np.repeat(first, n)
        left = np.flatnonzero((pair % 2 == 0) & (pair + 1 < np.repeat(n, n)))
        more = np.empty((len(left) + len(odd), rows.shape[1]), rows.dtype)
        both = np.take(rows, order[left], axis=0, out=more[: len(left)], mode="clip")
        both += np.take(rows, order[left + 1], axis=0, mode="clip")
        more[len(left) :] = rows[order[odd]]
        rows, keys = more, np.concatenate((k[left], k[odd]))
    return np.concatenate([k for k, _ in done]), np.concatenate([x for _, x in done])


#: Logits whose exponentials are surely finite in 32 bits, so that no row maximum is needed.
TAME = 60.0


def _bound(w: np.ndarray, b: np.ndarray, axis: int) -> float:
    """No logit of states within (-1, 1) is larger."""
    return float((np.abs(w).sum(axis=axis) + np.abs(b)).max())


def _exponentials(logits: np.ndarray, pick: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits (in place, less each row's maximum where they may be large), their sums by
    row, and the log-probabilities of the columns ``pick``."""
    if not tame:
        logits -= logits.max(axis=1, keepdims=True)
    chosen = logits[np.arange(len(pick)), pick]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return logits, total, chosen - np.log(total)


class Gru:
    """The network; parameters are float32 arrays in ``p``."""

    def __init__(self, frequency: np.ndarray, class_start: np.ndarray, seed: int = 11) -> None:
        rng, h, s = np.random.default_rng(seed), HIDDEN, len(frequency)
        self.start = class_start
        self.cls = np.repeat(np.arange(len(class_start) - 1), np.diff(class_start))
        mass = np.add.reduceat(frequency, class_start[:-1])
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "emb": normal(s, h), "wx": normal(h, 3 * h) * 2, "bx": np.zeros(3 * h, np.float32), "u": normal(h, 3 * h) * 2,
            "cw": normal(h, len(mass)) * 0.1, "cb": np.log(mass / mass.sum()).astype(np.float32),
            "ow": normal(s, h) * 0.1, "ob": np.log(frequency / mass[self.cls]).astype(np.float32),
        }

    def inputs(self) -> np.ndarray:
        """What each symbol gives to the gates."""
        return self.p["emb"] @ self.p["wx"] + self.p["bx"]

    def tame(self) -> tuple[bool, bool]:
        """Whether the logits of classes, and those within them, are within ``TAME`` for states within (-1, 1)."""
        return _bound(self.p["cw"], self.p["cb"], 0) < TAME, _bound(self.p["ow"], self.p["ob"], 1) < TAME

    def run(self, x: np.ndarray, h: np.ndarray, keep: list | None = None, into: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each of the inputs ``x`` (steps, lanes); ``END`` as input resets a lane.
        keep gets what backpropagation needs; ``into`` may be given as ``inputs`` told it."""
        n, u, out = HIDDEN, self.p["u"], np.empty((*x.shape, HIDDEN), self.p["u"].dtype)
        into = self.inputs() if into is None else into
        gx, hu = np.empty((2, x.shape[1], 3 * n), u.dtype)
        for t in range(len(x)):
            begins = x[t] == 0
            if begins.any():
                h = h.copy()
                h[begins] = 0
            if keep is not None:
                hu = np.empty_like(gx)
            np.matmul(h, u, out=hu)
            np.take(into, x[t], axis=0, out=gx, mode="clip")
            rz = gx[:, : 2 * n] + hu[:, : 2 * n]
            rz = _sigmoid(rz)
            r, z = rz[:, :n], rz[:, n:]
            c = r * hu[:, 2 * n :]
            c += gx[:, 2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, r, z, c, hu[:, 2 * n :], begins))
            mixed = np.subtract(h, c, out=out[t])
            mixed *= z
            mixed += c
            h = mixed
        return out, h.copy()

    def log_prob(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, tame: tuple[bool, bool] | None = None) -> np.ndarray:
        """Natural log-probabilities of the symbols ``y`` after the states ``h``; with grads,
        also sums the gradients of their negative sum, and that of h as ``h``. Rows go ``ROWS`` at a
        time, which a core's cache holds; ``tame`` may be given as the method told it."""
        if grads is not None:
            grads |= {k: np.zeros_like(self.p[k]) for k in ("cw", "cb", "ow", "ob")} | {"h": np.empty_like(h)}
        lp, large = np.empty(len(y), h.dtype), np.abs(h).max(initial=0) > 1
        tame = (False, False) if large else tame or self.tame()
        for at in range(0, len(y), ROWS):
            lp[at : at + ROWS] = self._log_prob(h[at : at + ROWS], y[at : at + ROWS], grads, at, tame)
        return lp

    def _log_prob(self, h: np.ndarray, y: np.ndarray, grads: dict | None, at: int, tame: tuple[bool, bool]) -> np.ndarray:
        # The gradient of a row of logits is (e - total at y) / total. Rows go in order of their classes.
        order = np.argsort(self.cls[y].astype(np.int16), kind="stable")
        h, y, rows = np.take(h, order, axis=0, mode="clip"), y[order], np.arange(len(y))
        cls, lp = self.cls[y], np.empty(len(y), h.dtype)
        dh, back = np.empty_like(h) if grads is not None else None, np.ascontiguousarray(self.p["cw"].T)
        for lo in range(0, len(y), CLASS_ROWS):
            own, mine = h[lo : lo + CLASS_ROWS], cls[lo : lo + CLASS_ROWS]
            logits = own @ self.p["cw"]
            logits += self.p["cb"]
            e, total, lp[lo : lo + CLASS_ROWS] = _exponentials(logits, mine, tame[0])
            if grads is not None:
                e[rows[: len(mine)], mine] -= total
                over = 1 / total
                grads["cw"] += (own * over[:, None]).T @ e
                grads["cb"] += over @ e
                by = np.matmul(e, back, out=dh[lo : lo + CLASS_ROWS])
                by *= over[:, None]
        cuts, starts = np.searchsorted(cls, np.arange(len(self.start))).tolist(), self.start.tolist()
        for c in range(len(starts) - 1):
            lo, hi = cuts[c], cuts[c + 1]
            a, b = starts[c], starts[c + 1]
            if lo == hi or b - a == 1:
                continue
            own, w, mine = h[lo:hi], self.p["ow"][a:b], y[lo:hi] - a
            logits = own @ w.T
            logits += self.p["ob"][a:b]
            e, total, inner = _exponentials(logits, mine, tame[1])
            lp[lo:hi] += inner
            if grads is not None:
                e[rows[: hi - lo], mine] -= total
                over = 1 / total
                e *= over[:, None]
                grads["ow"][a:b] += e.T @ own
                grads["ob"][a:b] += np.ones(hi - lo, e.dtype) @ e
                dh[lo:hi] += e @ w
        if grads is not None:
            grads["h"][at : at + len(y)][order] = dh
        out = np.empty_like(lp)
        out[order] = lp
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Mean loss of a window, its gradients, and the state to carry on."""
        kept: list = []
        out, last = self.run(x, h, kept)
        g: dict = {}
        loss = -self.log_prob(out.reshape(-1, HIDDEN), y.ravel(), g).mean()
        dout, u, n = g.pop("h").reshape(out.shape), self.p["u"], HIDDEN
        back, du, by, to = np.ascontiguousarray(u.T), np.zeros_like(u), np.empty_like(h), np.empty((len(h), 3 * n), u.dtype)
        dgx, dh = np.empty((*x.shape, 3 * n), u.dtype), np.zeros_like(h)
        for t in reversed(range(len(x))):
            hp, r, z, c, hc, begins = kept[t]
            rest = 1 - z
            dh += dout[t]
            np.multiply(c, c, out=by)
            np.subtract(1, by, out=by)
            by *= rest
            da = np.multiply(dh, by, out=dgx[t, :, 2 * n :])
            np.multiply(r, da, out=to[:, 2 * n :])
            np.subtract(1, r, out=by)
            by *= hc
            np.multiply(by, to[:, 2 * n :], out=to[:, :n])
            np.subtract(hp, c, out=by)
            by *= z
            by *= rest
            np.multiply(by, dh, out=to[:, n : 2 * n])
            dgx[t, :, : 2 * n] = to[:, : 2 * n]
            du += hp.T @ to
            dh *= z
            dh += to @ back
            if begins.any():
                dh[begins] = 0
        flat, emb = dgx.reshape(-1, 3 * n), np.zeros_like(self.p["emb"])
        there, per_symbol = _sums(flat, x.ravel())
        emb[there] = per_symbol @ self.p["wx"].T
        g |= {"u": du, "bx": np.ones(len(flat), flat.dtype) @ flat, "wx": self.p["emb"][there].T @ per_symbol, "emb": emb}
        return float(loss), {k: v / y.size for k, v in g.items()}, last

    def fit(self, stream: np.ndarray, most_lanes: int = START_LANES, epochs: int = EPOCHS, top: float = RATE) -> list[float]:
        """Train on a stream of symbols (each document closed by 0); mean loss by epoch."""
        lanes = max(1, min(most_lanes, len(stream) // (4 * WINDOW)))
        steps = len(stream) // lanes
        if steps < 2:
            return []
        y = stream[: lanes * steps].reshape(lanes, steps).T
        x = np.vstack((np.zeros((1, lanes), y.dtype), y[:-1]))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t, losses, all_steps = 0, [], epochs * -(-steps // WINDOW)
        for _ in range(epochs):
            h, seen = np.zeros((lanes, HIDDEN), np.float32), []
            for at in range(0, steps, WINDOW):
                loss, g, h = self.gradients(x[at : at + WINDOW], y[at : at + WINDOW], h)
                seen.append(loss)
                t += 1
                rate = top * (1 - 0.95 * t / all_steps)
                for k, a in self.p.items():
                    d = np.clip(g[k], -0.1, 0.1)
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    a -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
            losses.append(float(np.mean(seen)))
        return losses

    def score(self, docs: Iterator[tuple]) -> Iterator[tuple]:
        """``(key, symbols)`` in any number -> ``(key, log-probability)``, as documents end.
        Lanes are filled again when half of them are free; ``flat`` has what their documents
        still hold, each from ``at`` to ``end``."""
        keys, sums, last = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        flat, at, end, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HIDDEN), np.float32)
        more, into, tame = True, self.inputs(), self.tame()
        while True:
            if more and len(keys) <= LANES // 2:
                new = list(islice(docs, LANES - len(keys)))
                more = len(new) == LANES - len(keys)
                parts = [flat[a:b] for a, b in zip(at.tolist(), end.tolist())] + [np.asarray(x, np.int64) for _, x in new]
                flat = np.concatenate([np.zeros(0, np.int64), *parts])
                end = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
                at = np.concatenate(([0], end[:-1])) if len(end) else end
                keys, sums = np.append(keys, [k for k, _ in new]).astype(np.int64), np.append(sums, np.zeros(len(new)))
                last, h = np.append(last, np.zeros(len(new), np.int64)), np.concatenate((h, np.zeros((len(new), HIDDEN), np.float32)))
            if not len(keys):
                return
            steps = min(WINDOW, int((end - at).max()))
            place = at + np.arange(steps)[:, None]
            real = place < end
            y = np.where(real, flat[np.minimum(place, len(flat) - 1)], 0)
            out, h = self.run(np.vstack((last, y[:-1])), h, into=into)
            lp = self.log_prob(out[real], y[real], tame=tame)
            sums += np.bincount(np.nonzero(real)[1], weights=lp, minlength=len(keys))
            at, last = at + steps, y[-1]
            going = at < end
            yield from zip(keys[~going].tolist(), sums[~going].tolist())
            keys, sums, last, at, end, h = (v[going] for v in (keys, sums, last, at, end, h))


def _encoder(v: Vocabulary):
    """text -> (local word numbers, -1 for the others; all words); of one text, as ``encode`` does
    of many."""
    number = {w: i for i, w in enumerate(v.words)}

    def encode(text: bytes) -> tuple[np.ndarray, list[bytes]]:
        words = text.lower().split()
        words.append(END)
        return np.array([number.get(w, -1) for w in words], np.int64), words

    return encode


def _symbols(v: Vocabulary, ids: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Symbols of a document, and its words that aren't local."""
    if not len(v.symbols):
        return np.array([0 if w == END else v.bucket_symbols[bucket_of(w)] for w in words]), words
    symbols = v.symbols[ids]
    others = np.flatnonzero(ids < 0)
    rare = [words[i] for i in others.tolist()]
    symbols[others] = [v.bucket_symbols[bucket_of(w)] for w in rare]
    return symbols, rare


def _encoded(batches, v: Vocabulary, number: int) -> Iterator[pa.RecordBatch]:
    """What ``encode`` writes, for record batches of ``doc_id, text, train``; rows are numbered from
    ``number``. Each distinct word of a portion is looked up once."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))]
    names = ["rid", "doc_id", "train", "n_tokens", "n_known", "base_score", "own", "symbols", "rare"]
    norm = np.log10(v.total + 0.5 * (v.distinct + 1))
    mass_of, within = np.zeros(len(v.frequency)), np.zeros(len(v.frequency), bool)
    mass_of[v.bucket_symbols], within[v.bucket_symbols] = np.log10(v.bucket_mass), True
    local = pa.array(v.words, pa.binary())
    counts, logs = np.append(v.counts, 0.0), np.append(np.log10(v.counts + 0.5), 0.0)
    end = v.words.index(END) if END in v.words else -1
    for b in portions(batches, 1):
        words, index, begins = _words(b.column(1))
        words, index = pa.concat_arrays([words, pa.array([END], pa.binary())]), np.insert(index, begins[1:], len(words))
        begins = begins + np.arange(len(begins))
        ids = pc.fill_null(pc.index_in(words, value_set=local), -1).to_numpy().copy() if len(local) else np.full(len(words), -1)
        ids[-1] = end
        prefixes = pc.binary_slice(words, 0, PREFIX).dictionary_encode()
        symbols = v.bucket_symbols[np.array([bucket_of(x) for x in prefixes.dictionary.to_pylist()])][prefixes.indices.to_numpy()]
        symbols[ids >= 0] = v.symbols[ids[ids >= 0]]
        symbols[-1] = 0
        log_c = logs[ids]
        own = np.where(within[symbols], log_c - mass_of[symbols], 0.0)
        n, sums = np.diff(begins), [np.add.reduceat(x[index], begins[:-1]) for x in ((counts[ids] > 0).astype(np.int64), log_c, own)]
        raw = symbols.astype(np.uint16)[index].tobytes()
        at = np.flatnonzero(ids[index] < 0)
        pairs, k = np.unique(np.repeat(np.arange(len(n)), n)[at] * len(words) + index[at], return_counts=True)
        few = pa.StructArray.from_arrays([words.take(pa.array(pairs % len(words))), pa.array(k, pa.int64())], names=["word", "n"])
        cuts = np.searchsorted(pairs, np.arange(len(n) + 1) * len(words))
        columns = [
            pa.array(number + np.arange(len(n))), b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1] - norm * n), pa.array(sums[2]),
            pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * begins).astype(np.int32)), pa.py_buffer(raw)]),
            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), few),
        ]
        number += len(n)
        yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names=names)


def encode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """``rows(doc_id, text, train)`` written once for training and scoring: a row number ``rid``, the
    document's symbols as unsigned 16-bit numbers, ``n_tokens``, and of its local words ``n_known``,
    the sum ``base_score`` of their log10 probabilities less those of the counts that ``rare`` words
    await, and ``own``, the log10 probability of words within their buckets."""
    schema = "rid long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, own double, symbols binary, rare array<struct<word: binary, n: long>>"
    run = lambda batches: _encoded(batches, v, TaskContext.get().partitionId() << 40)
    return materialize(rows.select("doc_id", "text", "train").mapInArrow(run, schema), "encoded")


def fit(encoded: DataFrame, v: Vocabulary, start_tokens: int = START_TOKENS) -> Gru:
    """Train on all documents of ``encoded(symbols)``: a start from rows drawn by chance, about
    ``start_tokens`` tokens, in one task, and then all where they are."""
    share, model = min(1.0, start_tokens / max(1, v.total)), Gru(v.frequency, v.class_start)
    drawn = encoded if share == 1 else encoded.where(F.rand(5) < share)
    model.p, _ = sweep(drawn.select("symbols").repartition(1), v, model, START_LANES, EPOCHS, RATE)
    for _ in range(SWEEPS if share < 1 else 0):
        model.p, _ = sweep(encoded, v, model)
    return model


def _summed(parts: DataFrame, share: Column) -> DataFrame:
    """``parts(block, part, tokens, weights)``, weights times tokens as float64, summed by block
    and share of the parts."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in rows["weights"])
        tokens = sum(rows["tokens"].to_pylist())
        columns = [pa.array([x.as_py()], t) for x, t in zip(key, (pa.int32(), pa.int64()))]
        return pa.Table.from_arrays([*columns, pa.array([tokens]), pa.array([total.tobytes()], pa.binary())], names=["block", "part", "tokens", "weights"])

    return parts.withColumn("part", share).groupBy("block", "part").applyInArrow(add, "block int, part long, tokens long, weights binary")


def sweep(encoded: DataFrame, v: Vocabulary, model: Gru, lanes: int = SWEEP_LANES, epochs: int = 1, rate: float = SWEEP_RATE) -> tuple[dict, int]:
    """Weights after every partition of ``encoded(symbols)`` has trained from those of ``model`` over
    all of its documents, their means by tokens, and the number of tokens. Each task gives its
    weights times its tokens in blocks, which are summed in Spark by shares of the tasks and then
    in all, so what reaches the driver is the size of the model."""
    sizes = {k: a.size for k, a in model.p.items()}

    def run(batches):
        held, own, tokens = [], 0, 0
        mine = Gru(v.frequency, v.class_start)
        mine.p = {k: a.copy() for k, a in model.p.items()}
        order = np.random.default_rng(5)

        def train():
            nonlocal own, tokens
            mine.fit(np.concatenate([held[i] for i in order.permutation(len(held))]).astype(np.int64), lanes, epochs, rate)
            tokens, own = tokens + own, 0
            held.clear()

        for b in slices(batches):
            for symbols in b.column(0).to_pylist():
                held.append(np.frombuffer(symbols, np.uint16))
                own += len(held[-1])
                if own >= CHUNK:
                    train()
        if held:
            train()
        if tokens:
            flat = np.concatenate([mine.p[k].ravel().astype(np.float64) for k in sizes]) * tokens
            blocks = [flat[at : at + BLOCK].tobytes() for at in range(0, len(flat), BLOCK)]
            part, n = TaskContext.get().partitionId(), len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int64()), pa.array([tokens] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "part", "tokens", "weights"])

    parts = encoded.select("symbols").mapInArrow(run, "block int, part long, tokens long, weights binary")
    rows = sorted(_summed(_summed(parts, F.col("part") % SHARES), F.lit(0).cast("long")).collect())
    if not rows:
        return model.p, 0
    flat = np.concatenate([np.frombuffer(r.weights, np.float64) for r in rows]) / rows[0].tokens
    pieces = np.split(flat, np.cumsum(list(sizes.values()))[:-1])
    return {k: x.reshape(model.p[k].shape).astype(np.float32) for k, x in zip(sizes, pieces)}, rows[0].tokens


def score(docs: DataFrame, train: Column, start_tokens: int = START_TOKENS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_tokens, n_known, train_tokens, base_score,
    score``: log10 probabilities of every whole document, learnt from the rows that meet
    ``train``.

    A null or empty text is the end token alone. Repeated rows come back repeated, rows with a
    null id are scored but not learnt from, and further columns are ignored. Without training
    rows the model is uniform; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("train", F.coalesce(train, F.lit(False)))
    counts = materialize(count_words(rows.where("train")), "counts")
    v = vocabulary(counts)
    encoded = encode(rows, v)
    model = fit(encoded.where("train"), v, start_tokens)
    schema = "rid long, doc_id long, n_tokens long, n_known long, base_score double, score double"

    def run(batches):
        done: dict[int, tuple] = {}

        def documents():
            """Long documents first, ``ORDERED`` tokens at a time, so that none is left alone in
            the lanes at the end."""
            held, size = [], 0

            def longest_first():
                yield from sorted(held, key=lambda d: -len(d[1]))
                held.clear()

            for b in slices(batches):
                *rest, symbols = (c.to_pylist() for c in b.columns)
                for row, raw in zip(zip(*rest), symbols):
                    done[row[0]] = row
                    held.append((row[0], np.frombuffer(raw, np.uint16)))
                    size += len(raw) // 2
                if size >= ORDERED:
                    yield from longest_first()
                    size = 0
            yield from longest_first()

        kinds, names, out = [pa.int64()] * 4 + [pa.float64()] * 2, [x.split()[0] for x in schema.split(", ")], []

        def pack():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for rid, lp in model.score(documents()):
            *row, own = done.pop(rid)
            out.append((*row, lp / np.log(10) + own))
            if len(out) >= 512:
                yield pack()
        if out:
            yield pack()

    scored = materialize(encoded.select("rid", "doc_id", "n_tokens", "n_known", "base_score", "own", "symbols").mapInArrow(run, schema), "scored")
    rare = encoded.select("rid", F.explode("rare").alias("w")).select("rid", "w.word", F.col("w.n").alias("k"))
    known = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_counts"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"),
    )
    more = F.coalesce("log_counts", F.lit(0.0))
    return scored.join(known, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )

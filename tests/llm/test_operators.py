"""The training-data operators against brute force, and on odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halocline.llm import common, components, decontaminate, grulm, langid, licenses, multiset, packing, queries, sharding, simhash, toxicity, warc

SCHEMA = "doc_id long, text string"
#: Null and empty texts, a long one, ties and repeated rows, and columns that operators add.
ODD = [(5, None), (3, ""), (9, "  \n\t "), (7, "word"), (7, "word"), (4, "Word"), (11, "a b c d e f " * 4000), (12, "é ü　中文 — ok"), (None, "no id here at all")]
CLASH = ["score", "predicted", "lang_pred", "shard", "slot", "rank", "component_id", "fingerprint", "bucket", "positive", "unlabelled", "word", "n", "linked", "piece", "edited", "unit", "__text", "__held", "__gone", "SCORE2", "Lang_Pred2", "c0", "c1", "id", "key", "k", "node", "low"]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(table(spark, [*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent}
    assert components.connected_components(table(spark, [], "a long, b long")).count() == 0


def slow_fingerprint(text, k=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    label = {d: d for d, _ in values}
    changed = True
    while changed:
        changed = False
        for a, x in values:
            for b, y in values:
                if (x ^ y).bit_count() <= 3 and label[b] > label[a]:
                    label[b], changed = label[a], True
    return label


def test_simhash_equals_brute_force(spark, texts):
    rows = [(d, t) for d, t in texts.items() if d < 120]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows), group_rows=4).collect()}
    values = [(d, slow_fingerprint(t)) for d, t in rows]
    want = slow_components(values)
    assert got == {d: (f"{f:016x}", want[d]) for d, f in values}


def test_gray_index_finds_all_pairs_in_hot_groups():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ sum((np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64) for _ in range(3)), np.uint64(0)) for c in centre]))
    gray = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    values = values[np.argsort(gray)]
    index = simhash.GrayIndex(values, np.zeros(len(values), int))
    a, b = index.pairs(0, len(values), 3)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) > 100


def test_simhash_odd_rows(odd, empty):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect())
    zero = "0" * 16
    assert [r for r in got if r[1] == zero] == [(3, zero, 3), (5, zero, 3), (9, zero, 3)]
    assert [r[0] for r in got] == [3, 4, 5, 7, 7, 9, 11, 12] and {r[2] for r in got if r[0] in (4, 7)} == {4}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.similar_components(empty).count() == 0
    kept = simhash.deduplicate(odd)
    assert sorted(r.doc_id or -1 for r in kept.select("doc_id").collect()) == [-1, 3, 4, 11, 12] and kept.columns == odd.columns
    assert simhash.deduplicate(empty).count() == 0


def test_deduplicate_tells_rows_apart_by_id_and_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one text of its own kind here"), (1, long), (1, long), (2, long + " more"), (None, long), (None, "a text without an id and no copy"), (None, "two without an id at all"), (None, "two without an id at all"), (3, "another text for three to have")]
    got = simhash.deduplicate(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, rows[0][1]), (1, long), (0, rows[5][1]), (0, rows[6][1]), (3, rows[8][1])])
    classes = {(r.doc_id, r.component_id) for r in simhash.similar_components(table(spark, rows)).collect()}
    assert classes == {(1, 1), (2, 1), (3, 3)}


def test_keyed_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = common.materialize(table(spark, [(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "i long, key string"), "rows")
    keyed = common.materialize(table(spark, [("hot", 1), *((f"k{i}", i) for i in range(0, 300, 12))], "key string, v long"), "keyed")
    for how in ("inner", "left"):
        want = sorted((r.i, r.key or "", r.v or 0) for r in rows.join(keyed, "key", how).collect())
        assert sorted((r.i, r.key or "", r.v or 0) for r in common.keyed_join(rows, keyed, "key", how).collect()) == want


def test_trees_of_equal_fingerprints(spark):
    rows = [(i, 7) for i in range(5000)] + [(10_000 + i, 7 + (i << 20)) for i in range(300)]
    edges = [(r.a, r.b) for r in simhash.fingerprint_edges(table(spark, rows, "node long, fp long")).collect()]
    parent = {n: n for n, _ in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert len({root(i) for i in range(5000)}) == 1
    degrees = Counter(x for e in edges for x in e)
    assert max(degrees.values()) <= 6 * simhash.TREE_FAN and len(edges) < 3 * len(rows)


def test_row_filters_keep_whole_rows_whatever_their_names(spark):
    df = spark.createDataFrame([(1, "a b", [1], 2.0), (None, None, None, None), (3, "c", [], 1.0)], "doc_id long, text string, SCORE array<int>, score2 double")
    kept = common.keep_rows(df, ["text"], lambda: lambda t: t != "c")
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1]
    more = toxicity.score(df, toxicity.Model(np.full(1 << toxicity.BITS, -1, np.int32), np.zeros(0), 0.0, 0.5))
    assert more.columns == ["doc_id", "text", "score2", "score", "predicted"] and more.count() == 3
    both = langid.identify(df.toDF("doc_id", "text", "__text", "LANG_PRED"), {"x": [1, 2]})
    assert both.columns == ["doc_id", "text", "__text", "lang_pred", "score"] and both.select("lang_pred").count() == 3


def test_decontamination_judges_each_row(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    rows = [(None, "see the quick brown fox jumps over the lazy dog run"), (5, "the quick brown fox jumps over the lazy dog"), (5, "clean text under the same id"), (6, None), (6, ""), (7, "clean"), (7, "clean")]
    got = decontaminate.clean(table(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(5, rows[2][1]), (6, ""), (6, ""), (7, "clean"), (7, "clean")]

def test_similar_components(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(30)]
    rows = []
    for i, words in enumerate(base):
        near = list(words)
        near[100 + i], near[200 + i] = "changed", "also"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(table(spark, rows)).collect()}
    assert got == {d: d // 2 * 2 for d in range(60)}


def test_similar_components_hold_the_bound_on_both_sides(spark):
    rng, rows, want = random.Random(4), [], {}
    for i in range(120):  # 400 shingles; a changed word at the end of a stretch of five takes five of them
        words = [f"w{rng.randrange(50_000)}" for _ in range(404)]
        near, changes = list(words), (8, 9)[i % 2]  # 360 of 440 shared: 0.82; 355 of 445: 0.798
        for k in range(changes):
            near[20 + 40 * k] = f"x{i}_{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
        a, b = (simhash.shingle_set(t.encode()) for _, t in rows[-2:])
        same = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        assert same == (changes == 8)
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if same else 2 * i + 1}
    got = {r.doc_id: r.component_id for r in simhash.similar_components(table(spark, rows)).collect()}
    false = [d for d in want if got[d] < want[d]]
    missed = [d for d in want if got[d] > want[d]]
    assert not false and len(missed) <= 12


def test_shingles_are_counted_over_all_texts(spark):
    """Texts with a common template, however few and whatever their ids, meet under their own words."""
    ids = [r.id for r in spark.range(200).where(F.pmod(F.xxhash64("id"), F.lit(8)) != 0).collect()]
    template = [f"t{k}" for k in range(100)]
    rows = table(spark, [(i, " ".join(template + [f"o{i}_{k}" for k in range(100)])) for i in ids])
    common_ones = set(simhash.shingle_set(" ".join(template).encode()).view(np.int64).tolist())
    firsts = [r.firsts for r in simhash._sets(rows, 5, 0.8).collect()]
    assert len(firsts) == len(ids) > 100 and all(firsts)
    assert not any(common_ones & set(x) for x in firsts)
    counts = simhash.shingle_counts(rows.union(table(spark, [(None, None), (0, "")])), 5)
    assert counts.sum() == 196 * len(ids) and counts.max() >= len(ids)


def test_similar_components_finds_pairs_within_a_template_family(spark):
    rng = random.Random(6)
    template, rows = [f"t{k}" for k in range(200)], []
    for i in range(400):  # texts that share the template's stretches, and every fourth a near copy
        words = list(template)
        for k in rng.sample(range(0, 200, 5), 12):
            words[k : k + 5] = [f"o{i}_{k}_{j}" for j in range(5)]
        rows.append((len(rows), " ".join(words)))
        if i % 4 == 0:
            words[rng.randrange(20, 180)] = f"c{i}"
            rows.append((len(rows), " ".join(words)))
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.similar_components(table(spark, rows)).collect()}
    assert got == {i: root(i) for i in range(len(sets))} and len(pairs) >= 100


def test_multiset_edit_and_likeness(spark, texts):
    rows = sorted(texts.items())[:60]
    got = {r.doc_id: r for r in multiset.fingerprints(table(spark, rows)).collect()}
    order = [d for d, _ in sorted(rows, reverse=True)]
    for at, d in enumerate(order):
        text, following = texts[d], texts[order[(at + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(text)
        assert (got[d].fingerprint == got[order[(at + 1) % len(order)]].fingerprint) == (sorted(map(str, text.splitlines())) == sorted(map(str, following.splitlines())))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_multiset_is_homomorphic(spark):
    fp = multiset.fingerprint
    a, b, both, turned = "one a.\ntwo b.", "three c.", "one a.\ntwo b.\nthree c.", "three c.\ntwo b.\none a."
    row = spark.range(1).select(*(fp(F.lit(t)).alias(n) for n, t in zip("abcd", (a, b, both, turned))))
    row = row.withColumn("sum", multiset.combine(F.col("a"), F.col("b"))).withColumn("less", multiset.combine(F.col("c"), F.col("b"), -1)).first()
    assert row.c == row.d == row.sum and row.less == row.a and row.a != row.c


def slow_counts(text):
    return Counter(p for p in re.split(r"[\r\n]+|(?<=[.!?;:,])[ \t]+", text) if p)


def test_multiset_of_edited_texts_and_exact_cosines(spark, texts):
    """Fingerprints of edited texts equal those of the texts themselves, and likeness is close to
    the cosine of the paragraph counts."""
    rows = sorted(texts.items())[:80] + [(-1, "no end of line. at all, here"), (-2, "one\r\ntwo\r\n\r\nthree.  four\t five"), (-3, "\n\n\n"), (-4, "")]
    got = {r.doc_id: r for r in multiset.fingerprints(table(spark, rows)).collect()}
    order, text, away = sorted((d for d, _ in rows), reverse=True), dict(rows), []
    edits = {}
    for at, d in enumerate(order):
        own, cut, following = text[d], len(text[d]) // 3, text[order[(at + 1) % len(order)]]
        edits[d] = own[: len(own) - cut] + following[:cut]
        a, b, c = (slow_counts(t) for t in (own, edits[d], following))
        for x, y, likeness in ((a, b, got[d].near_edited), (a, c, got[d].near_next)):
            size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            want = 1.0 if x == y else sum(v * y[p] for p, v in x.items()) / size if size else 0.0
            away.append(abs(likeness - want))
            assert likeness == 1.0 or x != y
    assert np.mean(away) < 0.08 and max(away) < 0.4
    whole = table(spark, list(edits.items())).select("doc_id", multiset.digest(multiset.fingerprint(F.col("text"))).alias("f"))
    assert {r.doc_id: r.f for r in whole.collect()} == {d: r.edited_fingerprint for d, r in got.items()}


def test_multiset_successors_of_wide_and_clustered_ids(spark):
    rng = random.Random(12)
    ids = [-9 * 10**18, 9 * 10**18, 0, *range(10**15, 10**15 + 300), *(2**k for k in range(3, 62)), *(rng.randrange(-(2**40), 2**40) for _ in range(200))]
    rows = [(d, f"text {d}") for d in dict.fromkeys(ids)] + [(7, "again"), (7, "again")]
    docs, by = multiset.bucketed(table(spark, rows), 8)
    sizes = [r["count"] for r in docs.groupBy(*by).count().collect()]
    assert max(sizes) <= 32 and len(sizes) < len(rows)
    got = {(r.doc_id, r.text): r.next_text for r in multiset.with_next(table(spark, rows), 8).collect()}
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]]):
        assert t == "again" or got[(d, t)] == following


def test_multiset_odd_rows(odd, empty, spark):
    got = sorted((r.doc_id, r.n_chars, r.near_next) for r in multiset.fingerprints(odd).collect())
    assert [r[0] for r in got] == [3, 4, 5, 7, 7, 9, 11, 12]
    assert multiset.fingerprints(empty).count() == 0
    alone = multiset.fingerprints(table(spark, [(1, "abcdef")])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_licenses(spark, odd, empty):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "Released under the MIT Licence"), (3, "nothing\nhere at all"), (4, licenses.TEMPLATES[3][1]), (1, "x")]
    got = {(r.doc_id, r.license): (r.dice, r.n_units) for r in licenses.scan(table(spark, rows)).collect()}
    assert got[(1, "MIT")] == (1.0, 1) and got[(4, "MIT")][0] == 1.0 and not any(d == 3 for d, _ in got)
    assert got.get((2, "MIT")) is None  # three of four bigrams: 0.75
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_licenses_within_longer_texts(spark):
    """Every template is found within prose, in one line and wrapped, also with a changed word."""
    rng, rows, want = random.Random(14), [], set()
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n))
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 12:
            words[len(words) // 2 + 1] = "changed"
        for d, body in enumerate((" ".join(words), "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)), text.upper())):
            rows.append((10 * k + d, f"{prose(40)} {body} {prose(30)}"))
            want.add((10 * k + d, name))
    got = {(r.doc_id, r.license) for r in licenses.scan(table(spark, rows), windows=True).collect()}
    assert len(want & got) >= 0.9 * len(want)
    told = licenses.scan(table(spark, [(1, "Acme Tools is free software released under the MIT License."), (2, "Copyright (c) 2021 Jane Doe. Released under the MIT License.")]), windows=True).collect()
    assert {(r.doc_id, r.license, r.dice) for r in told} == {(1, "MIT", 1.0), (2, "MIT", 1.0)}
    assert licenses.scan(table(spark, [(k, prose(300)) for k in range(20)]), windows=True).count() == 0


def tokenizer():
    pytest.importorskip("public_tokenizers")
    return queries.word_tokenizer()


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path, rows = tokenizer(), [(d, t) for d, t in texts.items() if d < 80] + [(1000, "x " * 5000), (1001, None), (1003, "a <|endoftext|> b<|startoftext|>c <|EndOfText|> d"), (1004, "<|endoftext|>"), (1002, "don't stop!!! It's 12.5€ — naïve é ﬁ ß İ x​")]
    plain = Tokenizer.from_file(path)
    got = packing.pack(table(spark, rows), path).collect()
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in got:
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert [(p.start, p.length, p.ids_crc32) for _, p in sorted(pieces[d].items())] == [(i * 2048, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in enumerate(cuts)]
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 2048 + 1


def test_packed_sequences_hold_the_tokens(spark, texts):
    rows = [(d, t) for d, t in texts.items() if d < 30] + [(None, "no id"), (1, "same id"), (1, "same id")]
    made = packing.sequences(table(spark, rows), tokenizer()).collect()
    total = packing.pack(table(spark, rows), tokenizer()).agg(F.sum("length")).first()[0]
    assert sum(len(r.ids) for r in made) == total and max(len(r.ids) for r in made) <= 2048


def test_chunk_tokenizer_equals_the_tokenizer():
    """Letters alone in either case, with marks, digits, apostrophes, other scripts, broken bytes, long chunks."""
    coder = packing.ChunkTokenizer(queries.word_tokenizer())
    some = [b"Word", b"word", b"WORD,", b"don't", b"x1y2", "Été".encode(), "中文".encode(), b"a--b", b"...", b"ab\xff", b"q" * 200, b"I", b"end."]
    some = [b" ".join(some[i:] + some[:i]) for i in range(len(some))]
    want = [np.array(coder.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    assert coder.encode(some) == want and coder.encode(some) == want


def test_chunk_tokenizer_keeps_what_it_used_last(monkeypatch):
    """Words of every call are encoded once, however many others come and go."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    coder, asked = packing.ChunkTokenizer(queries.word_tokenizer()), []
    real = coder._ids
    coder._ids = lambda text, *more: (asked.extend(text.split()), real(text, *more))[1]
    for i in range(26):
        text = "alpha Beta. µÉß " + " ".join(chr(97 + i) + chr(97 + k) * 3 for k in range(10))
        want = np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert coder.encode([text.encode(), b"", b" "]) == [want, b"", b""]
    assert asked.count("alpha") == asked.count("beta") == 1


def test_portions_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 9, None, "b" * 3, "", "c" * 2])], names=["doc_id", "text"])
    got = [b.column(0).to_pylist() for b in common.portions([batch, batch.slice(0, 0)], 1, 5)]
    assert got == [[0], [1, 2, 3, 4]]


def test_packing_odd_rows(odd, empty):
    got = packing.pack(odd, tokenizer()).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(d for d, _ in ODD)
    assert {r.length for r in got if r.doc_id in (3, 5, 9)} == {1}
    assert packing.pack(empty, tokenizer()).count() == 0


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 3, 4, 5, 8, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 8)]
    rng = random.Random(0)
    used = Counter()
    for n in (rng.randint(1, 10) for _ in range(2000)):
        fit = fit if used else packing.BestFit(10, 5)
        s, at = fit.put(n)
        assert used[s] == at
        used[s] += n
    assert max(used.values()) <= 10


def test_toxicity_learns_from_positive_and_unlabelled(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abdeghilmnorst", k=rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for d in range(900):
        some, toxic = rng.choices(words, k=60), d % 5 == 0
        if toxic:
            some[rng.randrange(60)] = some[rng.randrange(60)] = "zzgrolk"
        rows.append((d, " ".join(some)))
        if toxic and d % 3 == 0 or not toxic and d % 2:
            labels.append((d, int(toxic)))
    train = common.fold(F.col("doc_id"), 5) != 0
    model = toxicity.fit(table(spark, rows), table(spark, labels, "doc_id long, toxic int"), train)
    got = {r.doc_id: r for r in toxicity.score(table(spark, rows), model).collect()}
    right = [got[d].predicted == int(d % 5 == 0) for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_ignores_held_out_labels_and_odd_rows(spark, odd, empty):
    train = common.fold(F.col("doc_id"), 5) != 0
    labels = table(spark, [(4, 1), (7, 1), (7, 1), (11, 0), (None, 1), (12, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, train)
    got = toxicity.score(odd, model, ("a", "b")).collect()
    assert len(got) == len(ODD) and {"score", "predicted", "a", "b"} <= set(got[0].asDict())
    none = toxicity.fit(odd, labels.limit(0), train)
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}
    assert toxicity.score(empty, toxicity.fit(empty, labels, train)).count() == 0


def test_non_negative_step_turns_round():
    one = np.array([0], np.uint16).tobytes()
    p, u = toxicity.Sparse([one, one]), toxicity.Sparse([b"", one])
    step = lambda w, b, prior: toxicity._risk_step(p, u, (0, 2), (0, 2), np.array([w]), b, prior)
    g, gb = step(0.0, 0.0, 0.5)  # sigmoids are a half; the clean part is log 2 / 2
    assert g[0] == pytest.approx(0.5 * -0.5 + 0.25 - 0.5 * 0.5) and gb == pytest.approx(0.5 * -0.5 + 0.5 - 0.5 * 0.5)
    sig = 1 / (1 + math.exp(-3))
    up, _ = step(6.0, -3.0, 0.9)  # P at 3, U at -3 and 3: the clean part is negative, its gradient is reversed
    assert up[0] == pytest.approx(0.9 * sig - sig / 2)


def test_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(3)
    dense = rng.random((9, 20)) < 0.3
    dense[4] = False
    rows, w, g = toxicity.Sparse([np.flatnonzero(x).astype(np.uint16).tobytes() for x in dense]), rng.normal(size=20), rng.normal(size=5)
    assert np.allclose(rows.dot(w, 2, 7), dense[2:7] @ w) and np.allclose(rows.back(g, 2, 7, 20), g @ dense[2:7])


def test_class_prior_comes_from_both_sets():
    assert toxicity.class_prior([(80, 160), (40, 80), (10, 900)], 100, 1000) == pytest.approx(0.2)
    assert toxicity.class_prior([], 5, 10) == 0.5


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op5_toxicity"](spark, sf).where("held_out")
    got = scored.join(common.table(spark, sf, "labels"), "doc_id").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    above = np.mean([a > b for a in toxic for b in clean])  # area under the curve; a few labels are wrong by themselves
    assert above > 0.93 and np.mean([s >= 0.5 for s in clean]) < 0.02 and np.mean([s >= 0.5 for s in toxic]) > 0.7


def test_features_are_marked_ngrams():
    def slow(text):
        runs = re.findall(r"[^\W\d_]+", text.lower())
        return {f"_{r}_"[i : i + n] for r in runs for n in toxicity.ORDERS for i in range(len(r) + 3 - n)}

    for text in ("", "a", "abc", "abcd efgh, ij x1y", "ñandú! Über-all"):
        assert len(np.unique(toxicity.grams(text))) == len(slow(text))


def test_large_groups_take_as_few_shards_as_hold_them():
    made = sharding.segments([("a", 25), ("b", 7), ("c", 3), ("d", 10)], 6, [10] * 6)
    parts = defaultdict(list)
    for name, low, high, shard in made:
        parts[name].append((low, high, shard))
    assert {n: len(p) for n, p in parts.items()} == {"a": 3, "b": 1, "c": 1, "d": 1}
    room = Counter()
    for name, size in (("a", 25), ("b", 7), ("c", 3), ("d", 10)):
        own = sorted(parts[name])
        assert own[0][0] == 0 and own[-1][1] == size and all(x[1] == y[0] for x, y in zip(own, own[1:]))
        for low, high, shard in own:
            room[shard] += high - low
    assert max(room.values()) <= 10
    assert sharding.segments([("x", 5)], 2, [0, 1])[-1][2] == 5  # more than all shards hold: nothing is lost


def test_sharding(spark, odd, empty):
    rng = random.Random(6)
    rows = [(d, f"text {rng.randrange(250) if d % 3 else 'hot'}") for d in range(1500)] + [(2000 + d, f"own {d}") for d in range(1500)]
    got = sharding.assign(table(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text, groups = dict(rows), defaultdict(set)
    for r in got:
        groups[text[r.doc_id]].add(r.shard)
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    cut = [t for t, s in groups.items() if len(s) > 1]
    assert len(cut) <= 4 and len(groups["text hot"]) == 4  # 500 copies in shards of 125
    marked = {r.doc_id: (r.copies, r.cut) for r in got}
    sizes = Counter(text.values())
    assert marked == {d: (sizes[t], len(groups[t]) > 1) for d, t in rows}
    big = [(d, "same" if d < 2000 else f"own {d}") for d in range(6000)]
    assert len({r.shard for r in sharding.assign(table(spark, big)).where("copies > 1").select("shard").distinct().collect()}) == 8
    small = sharding.assign(odd).collect()
    assert len(small) == len(ODD) and sorted(r.size for r in small)[:2] == [8, 8]
    assert sharding.assign(empty).count() == 0


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    model = grulm.Gru(np.array([5.0, 9, 7, 3, 2, 2, 1, 1, 1, 1]), np.array([0, 2, 5, 10]))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y, h = rng.integers(0, 10, (6, 3)), rng.integers(0, 10, (6, 3)), rng.normal(size=(3, grulm.HIDDEN))
    _, grads, _ = model.gradients(x, y, h)
    for name, a in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in a.shape)
            was, e = a[at], 1e-3
            a[at] = was + e
            more = model.gradients(x, y, h)[0]
            a[at] = was - e
            less = model.gradients(x, y, h)[0]
            a[at] = was
            assert (more - less) / (2 * e) == pytest.approx(grads[name][at], abs=1e-6)


def test_language_model_probabilities_and_lanes():
    rng = np.random.default_rng(1)
    model = grulm.Gru(np.array([5.0, 9, 7, 3, 2, 2, 1, 1, 1, 1]), np.array([0, 2, 5, 10]))
    h = rng.normal(size=(1, grulm.HIDDEN)).astype(np.float32)
    assert np.exp(model.log_prob(np.repeat(h, 10, 0), np.arange(10))).sum() == pytest.approx(1, abs=1e-5)
    docs = [np.append(rng.integers(1, 10, n), 0) for n in (0, 1, 31, 32, 33, 100, 700)] + [np.append(rng.integers(1, 10, 20), 0)] * 600
    got = dict(model.score(iter(enumerate(docs))))
    for k in (0, 1, 2, 3, 4, 5, 6, 300):
        s = docs[k]
        out, _ = model.run(np.append(0, s[:-1])[:, None], np.zeros((1, grulm.HIDDEN), np.float32))
        assert got[k] == pytest.approx(model.log_prob(out[:, 0], s).sum(), rel=1e-4)
    assert len(got) == len(docs)


def test_language_model_query(spark, texts, odd, empty):
    rows = [(d, t) for d, t in texts.items() if d < 100]
    train = common.fold(F.col("doc_id"), 5) != 1
    got = {r.doc_id: r for r in grulm.score(table(spark, rows), train).collect()}
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in [*t.encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for d, t in rows:
        words = [*t.encode().lower().split(), b"\n"]
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert got[d].base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    held = [r for d, r in got.items() if zlib.crc32(str(d).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    strange = grulm.score(odd, train).collect()
    assert len(strange) == len(ODD) and {r.n_tokens for r in strange if r.doc_id in (3, 5, 9)} == {1}
    assert grulm.score(empty, train).count() == 0
    assert grulm.score(odd, F.lit(False)).count() == len(ODD)


def test_language_model_encodes_each_word_once(spark, monkeypatch):
    """As one text at a time, and the bucket of each prefix is asked for once."""
    rows = [(1, "The cat, the CAT\tsat"), (2, None), (3, " \n"), (4, "İ x\x85y \x1c rare rarer rare"), (5, "cat")]
    v = grulm.vocabulary(grulm.count_words(table(spark, [r for r in rows if r[0] != 4])))
    batch = pa.RecordBatch.from_arrays([pa.array([0, *(d for d, _ in rows)]), pa.array(["gone", *(t for _, t in rows)]), pa.array([True] * 6)], names=["doc_id", "text", "train"])
    want = []
    for _, t in rows:
        ids, words = grulm._encoder(v)((t or "").encode())
        symbols, rare = grulm._symbols(v, ids, words)
        known = [v.counts[i] for i in ids if i >= 0]
        base = sum(np.log10(c + 0.5) for c in known) - len(words) * np.log10(v.total + 0.5 * (v.distinct + 1))
        want.append((len(words), len(known), pytest.approx(base), symbols.tolist(), Counter(rare)))
    asked, real = Counter(), grulm.bucket_of
    monkeypatch.setattr(grulm, "bucket_of", lambda word: (asked.update([word]), real(word))[1])
    got = pa.Table.from_batches(grulm._encoded([batch.slice(1)], v, 7)).to_pylist()
    assert [(r["n_tokens"], r["n_known"], r["base_score"], np.frombuffer(r["symbols"], np.uint16).tolist(), Counter({w["word"]: w["n"] for w in r["rare"]})) for r in got] == want
    assert [r["rid"] for r in got] == [*range(7, 12)] and max(asked.values()) == 1


def test_language_model_learns_from_all_training_rows(spark):
    rng = random.Random(9)
    rows = [(d, " ".join(f"w{rng.randrange(40)}" for _ in range(60)) + " alpha beta gamma" * 5) for d in range(60)]
    docs = table(spark, rows).withColumn("train", F.lit(True)).repartition(3)
    v = grulm.vocabulary(grulm.count_words(docs))
    start = grulm.Gru(v.frequency, v.class_start)
    docs = grulm.encode(docs, v).repartition(3)
    after, tokens = grulm.sweep(docs, v, start)
    assert tokens == v.total == sum(len(t.split()) + 1 for _, t in rows)
    few = grulm.fit(docs, v, start_tokens=200)  # the start is from three documents, the rest from all
    stream = np.concatenate([grulm._symbols(v, *grulm._encoder(v)(t.encode()))[0] for _, t in rows])

    def total(model):
        return sum(lp for _, lp in model.score(iter([(0, stream)])))

    first = total(start)
    start.p = after
    assert total(start) > first and total(few) > first
    again = grulm.Gru(v.frequency, v.class_start)
    assert any(not np.array_equal(again.p[k], few.p[k]) for k in again.p)


def test_loser_tree_merges():
    rng = random.Random(8)
    for _ in range(200):
        runs = [sorted(rng.choices(range(20), k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []))


def test_warc_round_trip(spark, sf_dir):
    pages = [(i, f"http://www.B{i % 3}.example/p?q={i % 5}#f", f"<p>{i % 7}\r\n\r\nä</p>" if i % 11 else None) for i in range(80)] + [(200, None, "x"), (None, "http://a", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).repartition(5)
    runs = warc.write(df, F.lit(1_700_000_000) - F.col("page_id"))
    captures = warc.merge(runs, range_rows=20)
    order = [(r.url_key, r.ts, r.page_id) for r in captures.orderBy("part", "place").collect()]
    assert order == sorted(order) and len(order) == 81
    got = {r.page_id: r for r in warc.read(captures, payloads=True).collect()}
    first = {}
    for p, _, html in sorted(pages[:-1]):
        first.setdefault(html or "", p)
    for p, _, html in pages[:-1]:
        raw, r = (html or "").encode(), got[p]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == p else ("revisit", first[html or ""]))
        assert r.payload is None or bytes(r.payload) == raw
    many = spark.createDataFrame([(i % 40, "http://a.example/", "x" * (50_000 * (i % 3))) for i in range(120)], "page_id long, url string, html string")
    captures = warc.merge(warc.write(many, F.lit(1_700_000_000)))
    back = warc.read(captures)
    assert back.rdd.getNumPartitions() >= 1 and Counter(r.page_id for r in back.collect()) == Counter(i % 40 for i in range(120))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.merge(warc.write(none, F.lit(0)))).count() == 0


def test_url_keys():
    assert warc.url_key("HTTPS://www.Example.com:443/a/B?c=d#e") == "com,example)/a/B?c=d"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("nonsense") == "nonsense"


def test_language_profiles(spark, docs, texts, odd, empty):
    held_out = common.fold(F.col("doc_id"), 4) == 2
    profiles = langid.train_profiles(docs.where(~held_out))
    got = langid.identify(docs.select("doc_id", "text", "lang"), profiles).where(held_out).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    some = {r.doc_id: r.lang_pred for r in langid.identify(odd, profiles).collect()}
    assert some[5] == some[3] == some[9] == "und" and some[12] != "und"
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(empty, profiles).count() == 0
    assert langid.train_profiles(empty.withColumn("lang", F.lit("en"))) == {}


def test_out_of_place_distance(spark):
    profiles = langid.train_profiles(spark.createDataFrame([("aaab", "x"), ("cc", "y"), (None, "x"), ("z", None)], "text string, lang string"))
    own = langid._ranked(langid.grams("aab"), langid.PROFILE).tolist()
    away = {k: sum(abs(i - p.index(g)) if g in p else langid.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
    best = min(away, key=away.get)
    got = langid.identify(spark.createDataFrame([("aab",)], "text string"), profiles).first()
    assert got.lang_pred == best and got.score == pytest.approx(1 - away[best] / (langid.PROFILE * len(own)))


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, e in enumerate(text):
            new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(9)
    for _ in range(600):
        p, t, k = "".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abc", k=rng.randint(0, 20))), rng.randint(0, 6)
        want, got = edit_distance(p, t), decontaminate.Myers(p).search(t, k)
        assert got is None if want > k else got[0] == want


def test_decontamination_finds_edited_passages(spark, odd, empty):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 50)))) for i in range(25)] + [(99, None), (98, " "), (97, "x")]
    rows, want = [], set()
    for d in range(120):
        text = " ".join(word() for _ in range(80))
        if d % 3 == 0:
            i, item = items[d % 25]
            k, chars = decontaminate.budget(len(decontaminate.normalise(item))), list(item.upper() if d % 2 else item)
            for _ in range(rng.randint(0, k)):
                at = rng.randrange(len(chars))
                chars[at] = "q"
            rows.append((d, f"{text} {''.join(chars)}\n{text}"))
            want.add((d, i))
        else:
            rows.append((d, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        got = {(r.doc_id, r.item_id) for r in decontaminate.matches(table(spark, rows), bench, block_items=block).where("item_id < 97").collect()}
        assert got == want
    assert decontaminate.matches(odd, bench.limit(0)).count() == 0 and decontaminate.matches(empty, bench).count() == 0
    kept = decontaminate.clean(odd, bench.where("item_id < 25"))
    assert kept.count() == len(ODD) and kept.columns == odd.columns


@pytest.mark.filterwarnings("error")
def test_gru_sums_by_symbol_and_constants_of_scoring(monkeypatch):
    rng = np.random.default_rng(4)
    for keys in (rng.zipf(1.3, 3_000) % 97, np.zeros(13, int), np.arange(5), np.zeros(0, int)):
        rows, want = rng.normal(size=(len(keys), 6)), np.zeros((97, 6))
        np.add.at(want, keys, rows)
        got, (there, sums) = np.zeros((97, 6)), grulm._sums(rows, keys) if len(keys) else ([], 0)
        assert len(set(there)) == len(there) == len(set(keys.tolist()))
        got[there] = sums
        assert np.allclose(got, want)
    assert grulm._sigmoid(np.array([-1e3, 0, 1e3], np.float32)).tolist() == [0, 0.5, 1]
    asked, real = [], grulm.Gru.inputs
    monkeypatch.setattr(grulm.Gru, "inputs", lambda self: (asked.append(1), real(self))[1])
    model = grulm.Gru(np.array([5.0, 9, 7, 3, 2, 2, 1, 1, 1, 1]), np.array([0, 2, 5, 10]))
    docs = [(k, np.append(rng.integers(1, 10, 40 * k), 0)) for k in range(6)]
    got = dict(model.score(iter(docs)))
    assert len(asked) == 1  # not once for each of the seven windows
    for k, s in docs:
        out, _ = model.run(np.append(0, s[:-1])[:, None], np.zeros((1, grulm.HIDDEN), np.float32))
        assert got[k] == pytest.approx(model.log_prob(out[:, 0], s).sum(), rel=1e-5)

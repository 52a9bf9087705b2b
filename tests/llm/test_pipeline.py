"""Every query runs; the pipeline's stages against brute force."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from halocline.llm import common, decontaminate, queries


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want


@pytest.mark.parametrize("name", ["op4_best_fit", "op6_sharding", "op8_warc", "op10_decontaminate"])
def test_queries_run(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    extra = docs.limit(2).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**6)))
    docs = docs.unionByName(extra).withColumns({"score": F.lit(1), "positive": F.lit("p"), "component_id": F.lit(0)})
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.6 * seen[0]
    rows = docs.select("doc_id", "text").collect()
    assert 10**6 not in {r.doc_id for r in rows} and len({r.doc_id for r in rows}) == len(rows)
    items = [decontaminate.normalise(r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    assert not any(i in decontaminate.normalise(r.text) for r in rows for i in items)

    def shingles(text):
        words = text.lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, by = {r.doc_id: shingles(r.text) for r in rows}, collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    close = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    assert not close
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == len(rows)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, sf_dir):
    """Null ids and texts, repeated ids and rows, a very long text, and columns with clashing names."""
    docs = common.table(spark, sf_dir, "documents").limit(60)
    item = common.table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    own = " ".join(f"palabra{i} der la house" for i in range(50))
    odd = [(None, own), (None, None), (None, f"an id is not needed {item} to be found"), (10**7, None), (10**7, ""), (10**7 + 1, own + " otra"), (10**7 + 1, f"the same id {item}"), (10**7 + 2, "long words and lines of text " * 40_000)]
    extra = spark.createDataFrame([(d, t, "en", "odd", 0) for d, t in odd + odd], SCHEMA)
    names = ("__text", "__held", "__gone", "SCORE", "id", "key", "c0")
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(extra).withColumns({n: F.lit(n) for n in names})
    docs = common.materialize(docs, "odd")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
    kept = [(r.doc_id, r.text) for r in docs.where("source = 'odd'").select("doc_id", "text").collect()]
    assert all(t is not None and item not in t for _, t in kept)
    assert sorted(d or 0 for d, _ in kept) == [10**7 + 1, 10**7 + 2]  # of the near copies the one with an id stays
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == docs.count()


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        assert made.count() == 0 and (name == "pack" or made.columns == docs.columns)


def test_intermediate_tables_need_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master, applicationId = "local-cluster[2,1,1024]", "a"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_root(Session)

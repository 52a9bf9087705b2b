"""What the operators share: the shared folder, written tables, folds and null handling."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset
    and everything runs in one process (tests), a folder made once for the application and
    removed at its end; on a cluster a machine's own folder would lose rows, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        folder = tempfile.mkdtemp(prefix="halocline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_roots[app] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_own_roots[app])
    return _own_roots[app]


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/halocline/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, under the application's own folder."""
    return f"{_application_folder(spark)}/{uuid.uuid4().hex}/{tag}"


def release(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder. Results are read
    from there when they are used, so call it when all of them are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs only the tasks that were running on it."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def byte_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches, rows: int = 256):
    """Small record batches out of larger ones, so that only a few texts are Python objects
    at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of text in a portion.
PORTION_BYTES = 4_000_000


def portions(batches, column: int, most: int = PORTION_BYTES):
    """Record batches of up to ``most`` bytes of text in ``column``, at least a row each."""
    for b in slices(batches, 1024):
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at = held = 0
        for i, size in enumerate(sizes.tolist()):
            if i > at and held + size > most:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += size
        if b.num_rows > at:
            yield b.slice(at)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def place_of(docs: DataFrame, name: str) -> int:
    """Where the column stands: that of exactly this name, or else the first that differs in
    case alone."""
    if name in docs.columns:
        return docs.columns.index(name)
    return [c.lower() for c in docs.columns].index(name.lower())


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed by their places, so that no working column clashes."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def keep_rows(docs: DataFrame, inputs: list[str], decider: Callable[[], Callable]) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, for which the function that
    ``decider`` makes once in a task is true of the values of the columns ``inputs``."""
    plain, at = numbered(docs), [place_of(docs, c) for c in inputs]

    def run(batches):
        decide = decider()
        for b in slices(batches):
            yield b.filter(pa.array([decide(*row) for row in zip(*(b.column(i).to_pylist() for i in at))], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def add_columns(docs: DataFrame, inputs: list[str], maker: Callable[[], Callable], names: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """All columns of ``docs`` and, under ``names``, what the function that ``maker`` makes once
    in a task returns for the lists of values of ``inputs``: one Arrow array for each name.
    Existing columns of those names, in whatever case, are replaced."""
    plain, at, new = numbered(docs), [place_of(docs, c) for c in inputs], {n.lower() for n in names}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in new]
    labels = [*(f"c{i}" for i in kept), *(f"n{i}" for i in range(len(names)))]
    schema = StructType([plain.schema.fields[i] for i in kept])
    for label, kind in zip(labels[len(kept) :], kinds):
        schema = schema.add(label, {"int": IntegerType(), "double": DoubleType(), "string": StringType()}[kind])

    def run(batches):
        make = maker()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *make(*(b.column(i).to_pylist() for i in at))], names=labels)

    return plain.mapInArrow(run, schema).toDF(*(docs.columns[i] for i in kept), *names)


#: A key with more rows than this is hot; at most ``MAX_HOT`` keys are joined by broadcast.
HOT_ROWS, MAX_HOT = 2_000, 50_000


def keyed_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has each ``key`` once; ``how`` is inner or left.
    Both are written tables. Rows of hot keys stay where they are and meet their keys by
    broadcast: a key is hot above ``HOT_ROWS`` rows, or above so many that no more than
    ``MAX_HOT`` keys can be. Null keys meet nothing."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    total = rows.count()
    hot = materialize(counts.where(F.col("count") > max(HOT_ROWS, total // MAX_HOT)).select(key), "hot")
    if hot.limit(1).count() == 0:
        return rows.join(keyed, key, how)
    few = F.broadcast(hot)
    heavy = rows.join(few, key, "left_semi").join(F.broadcast(keyed.join(few, key, "left_semi")), key, how)
    return heavy.unionByName(rows.join(few, key, "left_anti").join(keyed, key, how))

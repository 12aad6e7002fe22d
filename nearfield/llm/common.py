"""What the operators share: durable intermediate results, name-safe columns, and Arrow passes that leave ids alone."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space as the contracts count it: space, and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that are Python objects at a time (a longer text is alone).
SLICE_BYTES = 8 << 20
#: Rows of a table that is small enough to be sent to every task.
BROADCAST_ROWS = 20_000
#: Keys of 16 bytes, with nothing beside them, that are few enough for that (3 MB).
BROADCAST_KEYS = 200_000

_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset a local session (tests) gets a temporary one; a cluster
    session has none that all machines see, and raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nearfield-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def bounded(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While it lasts, jobs send texts to Python in Arrow batches of so many bytes (the caller's setting is put back)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs a reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: unlike durable(), it is compressed, and later reads take
    the columns they need.  release() deletes it."""
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(out)
    _made.setdefault(spark.sparkContext.applicationId, []).append(out)
    return spark.read.parquet(out)


def made(spark: SparkSession) -> list[str]:
    """The folders that written() has made in this application and release() has not deleted."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, folders: Sequence[str]) -> None:
    """Deletes folders of written(), for a caller that knows that nothing reads them any more."""
    for out in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made[spark.sparkContext.applicationId].remove(out)


def counted(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """durable(df) in partitions of about so many rows at least (small tables then cost a shuffle few files), and its rows."""
    held = durable(df)
    n = held.count()
    return held.coalesce(max(1, n // rows + 1)), n


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    return counted(df, rows)[0]


def joinable(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """compact(df) for the other side of a join: sent to every task while it has few rows, and else a written table whose
    join on a hot key adaptive execution can split (it cannot behind an aggregate)."""
    out, n = counted(df)
    return F.broadcast(out) if n <= most else out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (durable), marked for broadcast if it is counted to have at most so many rows; else Spark plans its join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_key(columns: Sequence[Column]) -> list[Column]:
    """_k1 and _k2, 128 bits of a hash of the columns, NULLs told from values: rows with equal keys hold the same."""
    none = F.array(*[c.isNull() for c in columns])
    return [F.xxhash64(*columns, none).alias("_k1"), F.xxhash64(F.lit("k2"), none, *columns[::-1]).alias("_k2")]


def keyed(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """(_row, _k1, _k2, more): df's rows as structs, with the key of some columns, so that no name can clash; more may use
    ``_row``."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    return rows.select("_row", *row_key([F.col("_row")[c] for c in columns]), *more)


def unkeyed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col("_row")[c].alias(c) for c in columns])


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES (one row at least)."""
    for b in batches:
        step = max(1, b.num_rows * SLICE_BYTES // max(b.nbytes, 1))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def values(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The slices as lists, one a column."""
    for part in sliced(batches):
        yield [c.to_pylist() for c in part.columns]


def beside(df: DataFrame, keep: Sequence[str], take: Sequence[str], made: str, make: Callable[..., Sequence[Sequence]]) -> DataFrame:
    """keep's columns as they are, and those of the DDL ``made`` that ``make`` gives (a sequence each) for lists of take's
    values.  One pass in Arrow batches, of which SLICE_BYTES are Python objects at a time.  Kept values never leave
    Arrow, so that a long beside a NULL stays what it is."""
    own = T._parse_datatype_string(made)
    n, kinds = len(keep), [to_arrow_type(f.dataType) for f in own.fields]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(take)])
    schema = T.StructType([*rows.schema.fields[:n], *[T.StructField(f"_m{i}", f.dataType) for i, f in enumerate(own.fields)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            got = make(*[c.to_pylist() for c in part.columns[n:]])
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *[pa.array(x, k) for x, k in zip(got, kinds, strict=True)]], schema.names)

    return rows.mapInArrow(run, schema).toDF(*keep, *own.names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """Maximal runs of other characters than SPACES."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

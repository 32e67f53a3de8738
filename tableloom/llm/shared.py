"""Helpers that several operators share: column selection, written tables, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between two of them is a word.
SPACES = r"[\x20\x09-\x0D]"
#: For bytes.translate: A-Z to a-z, nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def pick(df: DataFrame, *names: str, **casts: str) -> DataFrame:
    """The named columns alone, found by exact name.

    Extra columns are left out, also those whose names differ from a wanted
    one by case only; of several columns of one name the first is taken.
    Keyword arguments name columns and the type to cast them to.
    """
    wanted = dict.fromkeys(names) | casts
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    missing = [n for n in wanted if n not in df.columns]
    if missing:
        raise ValueError(f"input lacks the columns {missing}; it has {df.columns}")
    cols = []
    for name, kind in wanted.items():
        col = F.col(f"_{df.columns.index(name)}")
        cols.append((col.cast(kind) if kind else col).alias(name))
    return plain.select(*cols)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.format(fmt).options(**options).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, counts: DataFrame, how: str = "inner", total: int | None = None) -> DataFrame:
    """many.join(one, key, how) where `one` has a key at most once and a few keys may hold most of `many`.

    counts (key, _n) tells how many rows of `many` a key has, total their sum
    where it is known.  A key with more
    than twice a task's fair share is dealt over tasks by a hash of `by`, and
    its row of `one` copied to each of them.  At most half as many keys as
    there are tasks are so heavy, which bounds what is collected and broadcast.
    """
    spark = many.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if total is None:
        total = counts.agg(F.sum("_n")).first()[0] or 0
    fair = max(1, total // tasks)
    heavy = [(r[0], -(-r[1] // fair)) for r in counts.where(F.col("_n") > 2 * fair).select(key, "_n").collect()]
    if not heavy and how == "inner":
        return many.join(one, key)
    shares = F.broadcast(spark.createDataFrame(heavy, f"{key} {dict(many.dtypes)[key]}, _shares bigint"))
    # rows without a key match nothing, so they may lie anywhere
    parts = F.when(F.col(key).isNull(), tasks).otherwise(F.coalesce("_shares", F.lit(1)))
    salted = many.join(shares, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts)).drop("_shares")
    copies = one.join(shares, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at.getParent(), True)
    except Exception:  # the session has ended before; its shared folder is the cluster's to clean
        pass


def texts(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return pc.cast(column, pa.string()).to_pylist()


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return pc.cast(pc.cast(column, pa.large_string()), pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of the column, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

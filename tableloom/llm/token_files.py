"""Token ids in ORC files that are ordered by document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder, ids_bytes
from .shared import pick, slices, written

FILE_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 1, row_index_stride: int = 1000) -> None:
    """Encode every text and write the ids as ORC, in ascending doc_id order over the files.

    Input: `doc_id` (integer) and `text`; further columns are ignored.  A null
    text counts as empty; each document ends with `end_id`.  Null doc_ids come
    first; rows of one doc_id are ordered by a hash of their text, so repeated
    rows are kept and the order is defined.  They may spread over files: ranges
    are of doc_id, hash and place in the input, so no doc_id is one task's load.
    An empty table gives files without rows.

    ORC stores the ids with its run-length encoding for integers; row indexes
    (every `row_index_stride` rows) and a Bloom filter on doc_id let readers
    skip stripes and row groups, and stripes can be read in parallel.  `part`
    numbers the files in order, `part_start` counts the ids before a document
    in its file, so that a reader finds global positions from one sum a file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before, end = encoder(tokenizer), TaskContext.get().partitionId(), 0, ids_bytes([end_id])
        for batch in slices(batches, "text"):
            ids = [x + end for x in enc.encode(batch.column("text"))]
            sizes = np.array([len(x) // 4 for x in ids], "<i8")
            offsets = np.concatenate(([0], sizes.cumsum()))
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(ids), part, "<i4")),
                    pa.array(before + offsets[:-1]),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets.astype("<i4")), values),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            before += int(offsets[-1])

    d = pick(docs, doc_id="bigint", text="string")
    placed = d.withColumns({"_hash": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange("doc_id", "_hash", "_at").sortWithinPartitions("doc_id", "_hash", "_at").select("doc_id", "text")
    options = {
        "compression": "lz4",
        "orc.create.index": "true",
        "orc.row.index.stride": str(row_index_stride),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    ordered.mapInArrow(encode, FILE_SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in files of write_tokens.

    start counts the ids of all documents before it.  Filters on doc_id reach
    the files' statistics and Bloom filters.
    """
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    sums = written(files.groupBy("part").agg(F.sum("n_tokens").alias("n")), "sums")
    # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if sums.count() <= 1_000_000:  # 12 bytes each; the files' ids then stay where they are read
        bases = F.broadcast(bases)
    return files.join(bases, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """rows with `ids` replaced by ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            kept = [n for n in batch.schema.names if n != "ids"]
            yield pa.record_batch([*(batch.column(n) for n in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "ids")
    return rows.mapInArrow(crc, f"{kept}, ids_crc32 bigint")

"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters.

Files are cut by ranges of doc_id, rows ascend within them, and every file
carries its own prefix sums, so stripes are read in parallel and a document
is found from metadata alone.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coders import default_path, word_coder
from .common import INT, LONG, byte_column, keep, new_path, schema, small_batches

ROWS = T.StructType([*schema(doc_id=LONG, part=INT, start_in_part=LONG, n_tokens=LONG), T.StructField("ids", T.ArrayType(INT, False))])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, stripe_bytes: int = 16 << 20) -> None:
    """Write docs(doc_id, text) to path as ORC in ascending doc_id order.

    Null text counts as empty: only the end id is stored. Equal doc_ids are
    ordered by a hash of the text, null ids come first. Extra columns are
    ignored; an empty table gives files without rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches):
        coder, part, start = word_coder(tokenizer), TaskContext.get().partitionId(), 0
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            coded = [coder.encode(x) + tail for x in byte_column(batch, "text")]
            sizes = np.array([len(x) // 4 for x in coded], "int64")
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(np.frombuffer(b"".join(coded), "<u4").view("int32")))
            n = len(coded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * n, pa.int32()), pa.array(start + ends - sizes), pa.array(sizes), ids], names=ROWS.names)
            start += int(ends[-1]) if n else 0

    (
        rows.mapInArrow(encode, ROWS)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", "5000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; filters on doc_id prune stripes and row groups."""
    return spark.read.schema(ROWS).orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the stored documents."""
    stored = read_tokens(spark, path)

    def crc(batches):
        for batch in batches:
            ids = batch.column(3)
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype("int64")), pa.array(sums, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = keep(stored.select("doc_id", "part", "start_in_part", "ids").mapInArrow(crc, schema(doc_id=LONG, part=INT, start_in_part=LONG, n_tokens=LONG, ids_crc32=LONG)), "token-digests")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, store it as ORC, and digest what is read back."""
    path = new_path(spark, "tokens-orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_path("word_bpe_49k.json"))
    return digests(spark, path)

"""Best-fit packing with certified bin counts.

Documents become token pieces of at most one sequence. Pieces are dealt to
partitions of bounded size and packed by best-fit decreasing. Dual feasible
functions give each partition a lower bound on its sequences; a partition
that meets its bound is certified and final. The others exchange the
documents of all sequences that have room, in larger groups of bounded size,
and the groups are packed and certified anew.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coders import default_path, word_coder
from .common import INT, LONG, byte_column, keep, schema, small_batches

CAPACITY = 2048
#: Pieces of one partition, in the mean; and how many times larger the groups of an exchange are.
PART_ROWS, FAN, ROUNDS = 20_000, 16, 4

PIECE = schema(uid=LONG, doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG)
PACKED = T.StructType([*PIECE, *schema(sequence_id=LONG, offset=LONG, loose=T.BooleanType(), certified=T.BooleanType(), part=LONG)])


@functools.cache
def _rounding(capacity: int, most: int = 12) -> list[tuple[int, np.ndarray]]:
    """Dual feasible functions u_k on lengths 0..capacity as (scale, scaled values).

    u_k(x) = x where (k+1)x is whole, else floor((k+1)x) / k; the identity
    comes first. Values are integers over the scale, so bounds are exact.
    """
    x = np.arange(capacity + 1, dtype="int64")
    out = [(capacity, x)]
    for k in range(1, most + 1):
        whole = (k + 1) * x % capacity == 0
        out.append((k * capacity, np.where(whole, k * x, (k + 1) * x // capacity * capacity)))
    return out


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing of the lengths needs.

    Each u_k after the cut functions U_e (over capacity - e counts as a whole
    sequence, under e as nothing); compositions of dual feasible functions
    are dual feasible, so the largest of all the sums is a bound.
    """
    h = np.bincount(np.asarray(lengths, "int64"), minlength=capacity + 1)
    if not h[1:].sum():
        return 0
    e = np.arange(0, capacity // 2 + 1)
    big = np.concatenate([np.cumsum(h[::-1])[::-1], [0]])[capacity - e + 1]  # lengths over capacity - e
    best = 0
    for scale, f in _rounding(capacity):
        total = np.concatenate([[0], np.cumsum(f * h)])
        middle = total[capacity - e + 1] - total[e]
        best = max(best, int(((big * scale + middle + scale - 1) // scale).max()))
    return best


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: bin and offset of each length, given in any order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    mask, n = 0, 0
    for i in order:
        size = lengths[i]
        room = mask >> size
        if room:
            room = (room & -room).bit_length() - 1 + size  # the tightest bin that fits
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            open_[left].append(b)
            mask |= 1 << left
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of docs(doc_id, text): one row each, longer ones cut at capacity.

    Every row is a document of its own, also where ids repeat or are null;
    null text is the end id alone.
    """
    small_batches(docs.sparkSession)

    def cut(batches):
        coder, uid = word_coder(tokenizer), TaskContext.get().partitionId() << 40
        tail = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), byte_column(batch, "text"), strict=True):
                ids = memoryview(coder.encode(data) + tail)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((uid, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECE.names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values("uid")
    lengths, uid = rows["length"].to_numpy(), rows["uid"].to_numpy()
    bins, offsets = best_fit(lengths.tolist(), capacity)
    bins = np.array(bins)
    n = int(bins.max()) + 1
    fill = np.bincount(bins, lengths, n)
    names = np.full(n, np.iinfo("int64").max)
    np.minimum.at(names, bins, uid)  # a sequence is named by its smallest piece
    return rows[PIECE.names].assign(sequence_id=names[bins], offset=offsets, loose=fill[bins] < capacity, certified=n == lower_bound(lengths, capacity), part=int(uid[0]))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """PIECE columns, sequence_id and offset of pieces of 1 to capacity tokens.

    Whole sequences stand alone. A sequence id is the smallest uid in it, so
    ids are unique however often pieces were exchanged. Offsets are gapless
    from 0. An empty table gives an empty result.
    """
    small = pieces.where(F.col("length") < capacity)
    columns = [*PIECE.names, "sequence_id", "offset"]
    full = pieces.where(F.col("length") >= capacity).select(*PIECE.names, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def packed(df: DataFrame, parts: int, salt: int) -> DataFrame:
        dealt = df.withColumn("_part", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(parts)))
        return keep(dealt.groupBy("_part").applyInPandas(lambda g: _pack(g, capacity), PACKED), "packed")

    def sequences(df: DataFrame) -> int:
        return df.where("offset = 0").count()

    n = small.count()
    now = packed(small, max(1, -(-n // part_rows)), 0)
    done = [full]
    for k in range(1, rounds + 1):
        gaps = now.where("not certified").agg(F.countDistinct("part")).first()[0]
        if gaps < 2:  # nobody to exchange with
            break
        pool = now.where("loose and not certified")
        size = pool.count()
        again = packed(pool.select(*PIECE.names), max(1, -(-size // (FAN * part_rows))), k)
        if sequences(again) >= sequences(pool):
            break
        done.append(now.where("certified or not loose").select(columns))
        now = again
    return functools.reduce(DataFrame.unionByName, [*done, now.select(columns)])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of docs(doc_id, text)."""
    return pack_pieces(keep(cut_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity).drop("uid")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("word_bpe_49k.json"))

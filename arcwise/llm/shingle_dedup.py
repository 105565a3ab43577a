"""Near copies of whole documents: SimHash of their word shingles, verified by exact Jaccard similarity and completed by a join.

Documents whose 64-bit fingerprints are linked through the tiles of simhash
meet the first of their group, and go if their shingles resemble it. At
similarity 0.8 two fingerprints differ in ten bits or so, and in more than any
radius that still parts unlike texts often enough. So the shingles of the
documents that are left are joined with all earlier ones, by the prefix join
of line_dedup: a document is one line whose words are the hashes of its
shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, byte_column, schema, small_batches
from .line_dedup import SIMILARITY, later_lines
from .simhash import RADIUS, fingerprint_groups, majority, shingle_hashes

WORDS = 5
#: Hashes handed on at once.
HELD = 1 << 20


def shingle_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, line_no, line, fp: the distinct shingle hashes, sorted, and the fingerprint of docs(doc_id, text).

    line_no is a hash of the text, which tells apart texts that share an id.
    Documents without words, null text included, have one hash, zero, in common.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, keys, held, fps, n, at = batch.column(0), batch.column(2), [], [], 0, 0
            texts = byte_column(batch, "text")
            for i, text in enumerate(texts):
                every = shingle_hashes(text, words)
                fps.append(majority(every))
                h = np.unique(every).view("<i8")
                held.append(h if len(h) else np.zeros(1, "<i8"))
                n += len(held[-1])
                if n >= HELD or i == len(texts) - 1:
                    ends = np.cumsum([0, *map(len, held)]).astype("i4")
                    lines = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), keys.slice(at, len(held)), lines, pa.array(np.array(fps, "<u8").view("<i8"))], names=["doc_id", "line_no", "line", "fp"])
                    held, fps, n, at = [], [], 0, i + 1

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, schema(doc_id=LONG, line_no=LONG, line=T.ArrayType(LONG), fp=LONG))


def linked_to_first(firsts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of firsts(doc_id, line_no, fp): each text b with the earliest one a whose fingerprint is linked with its own."""
    groups = fingerprint_groups(firsts, F.struct("doc_id", "line_no"), radius)
    here = F.struct("doc_id", "line_no")
    return firsts.join(groups, "fp").where(F.col("first") < here).select(F.col("first").alias("a"), here.alias("b"))


def later_copies(docs: DataFrame, t: tuple[int, int] = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key) of each text whose shingles resemble those of an earlier one, by doc_id, then text_key = xxhash64(text).

    Rows with a null id take no part.
    """
    return later_lines(shingle_rows(docs.where("doc_id is not null"), words), t, linked_to_first).withColumnRenamed("line_no", "text_key")

"""Language identification by nearest centroids of character n-grams.

Texts become TF-IDF vectors of hashed letter n-grams of length one to three,
normalised to length one. Each language has several centroids, found by
spherical k-means over a bounded sample; a text takes the language of the
centroid with the largest cosine, and is rejected if it is farther away than
texts of its length ever were in the sample.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BIN, BOOL, DBL, LONG, STR, byte_column, schema, small_batches

DIMS = 4096
#: Labelled texts of each language that the fit samples (in the mean), and the centroids of a language.
SAMPLE, CENTROIDS, ITERATIONS = 1000, 3, 12
#: A text is rejected below this share of the smallest cosines of sampled texts of its length.
SLACK, LOWEST = 0.5, 0.002
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> itself for letters, 32 for the rest."""
    table = np.full(0x110000, 32, "u4")
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def ngram_counts(data: bytes) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams of a UTF-8 text, and its number of letters."""
    text = data.decode("utf-8", "replace").lower()
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    letters = int((c != 32).sum())
    if not letters:
        return np.zeros(DIMS, "i8"), 0
    c = np.concatenate([[32], c, [32]]).astype("u4")
    one, two = c * np.uint32(2654435761), c[:-1] * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
    three = two[:-1] * np.uint32(668265263) + c[2:] * np.uint32(374761393)
    ids = np.concatenate([one[c != 32], two[(c[:-1] != 32) | (c[1:] != 32)], three[c[1:-1] != 32]])
    ids ^= ids >> np.uint32(15)
    return np.bincount((ids * np.uint32(2246822519)) >> np.uint32(20), minlength=DIMS), letters


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    x = np.log1p(counts.astype("f4")) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class CentroidModel:
    """idf, unit centroids by row, their languages, and the smallest cosine kept by log2 of letters."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floor: np.ndarray

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether rejected, for rows of counts."""
        if not len(self.langs):
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cos = _weigh(counts, self.idf) @ self.centroids.T
        best = cos.argmax(1)  # the first of equal ones: languages by code point
        score = np.clip(cos[np.arange(len(cos)), best].astype("f8"), 0, 1)
        seen = letters > 0
        lang = [self.langs[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)]
        size = np.minimum(np.log2(np.maximum(letters, 1)).astype(int), len(self.floor) - 1)
        return lang, np.where(seen, score, 0.0), ~seen | (score < self.floor[size])


def _kmeans(x: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Unit centroids of unit rows, started from rows far apart; the same rows give the same centroids."""
    start = [int((x @ x.mean(0)).argmax())]
    while len(start) < min(k, len(x)):
        far = (x @ x[start].T).max(1)
        if far.min() > 1 - 1e-6:
            break
        start.append(int(far.argmin()))
    c = x[start]
    for _ in range(iterations):
        own = (x @ c.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return c


def fit_centroids(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> CentroidModel:
    """A model from labelled(key, text, lang): about sample texts of each language, drawn by a hash of key.

    The bound holds in the mean for any input size; counts of the languages
    cover all rows. Null texts and languages and texts without letters do not
    take part. Without any text the model rejects everything.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    empty = CentroidModel(np.ones(DIMS, "f4"), np.zeros((0, DIMS), "f4"), [], np.zeros(32))
    if not sizes:
        return empty
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("key", F.lit(97)), F.lit(1 << 30)) / float(1 << 30)
    small_batches(labelled.sparkSession)

    def extract(batches):
        for batch in batches:
            out = [ngram_counts(t) for t in byte_column(batch, "text")]
            raw = [np.minimum(c, 255).astype("u1").tobytes() for c, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary()), pa.array([n for _, n in out], pa.int64())], names=["key", "lang", "counts", "letters"])

    drawn = rows.where(draw < share).select("key", "text", "lang").mapInArrow(extract, schema(key=LONG, lang=STR, counts=BIN, letters=LONG))
    got = drawn.where("letters > 0").toPandas().sort_values(["lang", "key"], kind="stable")
    if not len(got):
        return empty
    counts = np.frombuffer(b"".join(got["counts"]), "u1").reshape(-1, DIMS)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype("f4")
    x, langs, rows_of = _weigh(counts, idf), [], []
    for lang in sorted(got["lang"].unique()):
        c = _kmeans(x[(got["lang"] == lang).to_numpy()], centroids, ITERATIONS)
        rows_of.append(c)
        langs += [lang] * len(c)
    c = np.concatenate(rows_of)
    best = pd.Series((x @ c.T).max(1)).groupby(np.log2(got["letters"].to_numpy()).astype(int))
    low = best.quantile(LOWEST).reindex(range(32))
    low[best.size().reindex(range(32)).fillna(0) < 20] = np.nan
    # Sizes that the sample lacks: shorter ones aren't rejected, longer ones are held to the last size seen.
    floor = (low.ffill().fillna(0.0) * SLACK).to_numpy()
    return CentroidModel(idf, c.astype("f4"), langs, floor)


def predict_languages(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected of docs(doc_id, text).

    Null texts and texts without letters are `und` with score 0 and rejected.
    Extra columns are ignored; rows are independent, so repeats, null ids and
    empty tables need no care.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of centroids for each language

    def predict(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                out = [ngram_counts(t) for t in byte_column(part, "text")]
                counts, letters = np.stack([c for c, _ in out]), np.array([n for _, n in out])
                lang, score, gone = shared.value.predict(counts, letters)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(gone)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(predict, schema(doc_id=LONG, lang_pred=STR, score=DBL, rejected=BOOL))


def keep_known(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """The rows of docs, all columns as they are, whose text the model does not reject."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pick(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                out = [ngram_counts(t) for t in byte_column(part, "text")]
                gone = shared.value.predict(np.stack([c for c, _ in out]), np.array([n for _, n in out]))[2]
                yield part.filter(pa.array(~gone))

    return docs.mapInArrow(pick, docs.schema)


def labelled_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1; ids and sources serve to draw only."""
    return docs.where((F.crc32(F.col("doc_id").cast("string")) % 3) != 1).select(F.col("doc_id").alias("key"), "text", "lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict_languages(docs, fit_centroids(labelled_rows(docs))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")

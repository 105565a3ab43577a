"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are laid out in tiles by the population counts of equal
bit segments. Two fingerprints within the radius have population counts, in
all segments together, at most the radius apart, so all other tile pairs are
skipped. The rest is compared whole: numpy exclusive-or and bit counts over
blocks. A tile pair reports a spanning forest of its links, never all pairs,
which keeps every connection and bounds the rows by the fingerprints read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BOOL, LONG, byte_column, components, keep, merge_links, schema, small_batches

RADIUS, SHINGLE = 2, 3
#: Fingerprints compared at once are blocks of this many; pairs of small tiles, and rows held, at once.
BLOCK, PAIRS, ROWS = 2048, 2_000_000, 100_000
#: Segments of the population counts: more of them as fingerprints grow in number.
SEGMENTS = ((0, 2), (400_000, 4), (10_000_000, 8), (400_000_000, 16))


def fingerprint(data: bytes, words: int = SHINGLE, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of the word shingles; 0 without words."""
    return majority(shingle_hashes(data, words, seed))


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, "int64")
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def shingle_hashes(data: bytes, words: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    parts = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.array([], "<u8")
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, parts), "int64", len(parts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = starts + sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.array(hashes, "<u8")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of docs(doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in byte_column(batch, "text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema(doc_id=LONG, fp=LONG))


def segment_counts(fps: np.ndarray, segments: int) -> np.ndarray:
    """Population counts of the bit segments, one row for each fingerprint."""
    width = 64 // segments
    mask = np.uint64((1 << width) - 1)
    u = fps.astype("<i8").view("<u8")
    return np.stack([np.bitwise_count((u >> np.uint64(width * k)) & mask) for k in range(segments)], axis=1).astype("i2")


def steps(segments: int, radius: int) -> np.ndarray:
    """Half of the count differences of total size 1 to radius: one of each pair of opposites."""
    out = []
    for size in range(1, radius + 1):
        for places in itertools.combinations_with_replacement(range(segments), size):
            for signs in itertools.product((-1, 1), repeat=size):
                step = [0] * segments
                for p, s in zip(places, signs, strict=True):
                    step[p] += s
                if sum(map(abs, step)) == size:
                    out.append(tuple(step))
    return np.array(sorted({s for s in out if s > tuple([0] * segments)}), "i2")


def _tile_key(counts: np.ndarray) -> np.ndarray:
    base = 64 // counts.shape[1] + 1
    key = np.zeros(len(counts), "int64")
    for k in range(counts.shape[1]):
        key = key * base + counts[:, k]
    return key


def _big_tile(nodes: np.ndarray, n: int, radius: int, block: int = BLOCK) -> np.ndarray:
    """Labels of the connected parts of a tile whose first n nodes are at home."""
    label = np.arange(len(nodes))
    ones = np.bitwise_count(nodes).astype("i2")
    for i in range(0, n, block):
        own = slice(i, min(i + block, n))
        for j in itertools.chain(range(i, n, block), range(n, len(nodes), block)):
            other = slice(j, min(j + block, n if j < n else len(nodes)))
            if ones[other].min() - ones[own].max() > radius or ones[own].min() - ones[other].max() > radius:
                continue
            a, b = np.nonzero(np.bitwise_count(nodes[own, None] ^ nodes[None, other]) <= radius)
            a, b = label[a + own.start], label[b + other.start]
            if (a != b).any():
                label = merge_links(len(nodes), a, b)[label]
    return label


def tile_links(tiles: np.ndarray, fps: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of each tile; rows sorted by tile, home before guests.

    A row at home is compared with all that follow it in its tile. Small
    tiles are compared together, large ones block by block.
    """
    nodes = np.ascontiguousarray(fps, "<i8").view("<u8")
    starts = np.flatnonzero(np.diff(tiles, prepend=tiles[:1] - 1))
    ends = np.append(starts[1:], len(tiles))
    homes = np.add.reduceat(~guest, starts) if len(starts) else np.array([], "int64")
    label = np.arange(len(nodes))
    big = homes * (ends - starts) > PAIRS
    for a, b, n in zip(starts[big], ends[big], homes[big], strict=True):
        label[a:b] = a + _big_tile(nodes[a:b], int(n), radius)
    rows = np.flatnonzero(np.repeat(~big, ends - starts) & ~guest)
    after = np.repeat(ends, ends - starts)[rows] - rows - 1
    cuts = np.searchsorted(np.cumsum(after), np.arange(PAIRS, after.sum() + PAIRS, PAIRS)) if len(rows) else []
    for i, j in itertools.pairwise([0, *np.minimum(np.asarray(cuts, "int64") + 1, len(rows)).tolist()]):
        if j <= i:
            continue
        n = after[i:j]
        a = np.repeat(rows[i:j], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(nodes[a] ^ nodes[b]) <= radius
        a, b = label[a[near]], label[b[near]]
        if (a != b).any():
            label = merge_links(len(nodes), a, b)[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[moved], fps[label[moved]]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """Connections (a, b) of the distinct fingerprints fp within radius bits.

    The fingerprints of a tile also visit, as guests, the tiles whose counts
    differ by at most the radius, in one direction. Each tile is compared in
    one task; the rows made are at most the fingerprints placed.
    """
    if segments is None:
        n = distinct.count()
        segments = [s for least, s in SEGMENTS if n >= least][-1]

    def place(batches):
        moves, width = steps(segments, radius), 64 // segments
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            counts = segment_counts(fps, segments)
            for move in [np.zeros(segments, "i2"), *moves]:
                there = counts + move
                ok = ((there >= 0) & (there <= width)).all(1)
                yield pa.RecordBatch.from_arrays([pa.array(_tile_key(there[ok])), pa.array(fps[ok]), pa.array(np.full(ok.sum(), move.any()))], names=TILE.names)

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < ROWS:
                    continue
            if not held:
                continue
            tiles, fps, guest = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
            # The last tile may go on in the next batch.
            n = len(tiles) if batch is None else int(np.searchsorted(tiles, tiles[-1]))
            a, b = tile_links(tiles[:n], fps[:n], guest[:n].astype(bool), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held = [pa.RecordBatch.from_arrays([pa.array(x[n:]) for x in (tiles, fps, guest)], names=TILE.names)] if n < len(tiles) else []

    distinct.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    placed = distinct.select("fp").mapInArrow(place, TILE)
    return placed.repartition("tile").sortWithinPartitions("tile", "guest").mapInArrow(compare, schema(a=LONG, b=LONG))


TILE = schema(tile=LONG, fp=LONG, guest=BOOL)


def fingerprint_groups(fps: DataFrame, key: str | Column, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """(fp, first) of each distinct fingerprint of fps: the smallest key of those reachable over links of at most radius differing bits."""
    reps = keep(fps.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    links = keep(link_fingerprints(reps, radius, segments), "simhash-links")
    comp = components(links)
    named = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    return named.join(least, "component").select("fp", "first")


def simhash_components(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links of at most
    radius differing bits. Documents without words, null text included, have
    fingerprint zero and link like any other. Repeated doc_ids keep their
    rows; null ids never name a component unless it has no other id. An empty
    table gives an empty result; extra columns are ignored.
    """
    fps = keep(fingerprints(docs, words), "simhash")
    ids = keep(fingerprint_groups(fps, "doc_id", radius, segments).withColumnRenamed("first", "component_id"), "simhash-ids")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

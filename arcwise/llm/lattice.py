"""Embedding near-dedup by lattice hashing.

Each table projects the unit vectors to eight random directions, scales them,
and decodes the eight numbers to the nearest point of the E8 lattice. A vector
lives in its cell and also visits the neighbouring cells whose points are next
nearest. Cells are the same whatever the size of the input, so a pair that is
found among few vectors is found among many. Vectors that meet are
verified by cosine in double precision, so no link below the threshold is
made. A pair is counted in the first table and cell in which it meets, hence
no pairs leave a task: only link counts and a spanning forest.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BIN, BOOL, INT, LONG, components, keep, merge_links, schema

THRESHOLD = 0.9
#: Tables, and neighbouring cells visited.
TABLES, PROBES, SEED = 8, 2, 20_240
#: Width of a cell, in standard deviations of a projected unit vector.
WIDTH = 2.0
#: Rows held at once and the sides of a block of cosines.
ROWS, SIDE = 20_000, 1024

PLACED = schema(table=INT, cell=LONG, guest=BOOL, vec_id=LONG, copies=LONG, vec=BIN)
FOUND = schema(a=LONG, b=LONG, n=LONG)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight, doubled so that they are whole numbers."""

    def d8(y):
        f = np.rint(y)
        e = y - f
        worst = np.abs(e).argmax(1)
        odd = np.flatnonzero(f.sum(1) % 2)
        f[odd, worst[odd]] += np.where(e[odd, worst[odd]] >= 0, 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(near[:, None], a, b)).astype("int64")


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [list(v) for v in itertools.product((1, -1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out, "int64")


@functools.cache
def _table(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table, 1])
    return rng.standard_normal((dim, 8)), rng.uniform(0, 2, 8)


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), salt, "u8")
    for k in range(points.shape[1]):
        h = (h ^ points[:, k].astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view("i8")


def cells(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Hashes of a table's cells: column 0 the own one, then those visited."""
    direction, shift = _table(unit.shape[1], table)
    x = unit @ direction / WIDTH + shift
    own = decode_e8(x)
    off = -((x - own / 2) @ neighbours().T)  # the nearer a neighbour, the smaller
    near = np.argpartition(off, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), "int64")
    points = np.concatenate([own[:, None], own[:, None] + neighbours()[near]], axis=1)
    return np.stack([_hash(points[:, c], unit.shape[1] * 1000 + table) for c in range(probes + 1)], axis=1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first so that squares neither overflow nor vanish."""
    v = vectors.astype("f8")
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class _Meetings:
    """Link counts and forest edges of sorted placed rows, one dimension at a time."""

    def __init__(self, threshold: float, tables: int, probes: int):
        self.threshold, self.tables, self.probes = threshold, tables, probes

    def __call__(self, table, cell, guest, ids, copies, vecs):
        unit = unit_rows(np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1))
        rough, slack = unit.astype("f4"), unit.shape[1] * 1e-6  # more than single precision errs; what passes is verified in double
        starts = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1) | np.diff(table, prepend=table[:1] - 1))
        left, right = [], []
        for a, b in itertools.pairwise([*starts.tolist(), len(cell)]):
            homes = a + int((~guest[a:b]).sum())
            for i in range(a, homes, SIDE):
                top = min(i + SIDE, homes)
                for j in range(i, b, 4 * SIDE):
                    end = min(j + 4 * SIDE, b)
                    x, y = np.nonzero(rough[i:top] @ rough[j:end].T >= np.float32(self.threshold - slack))
                    x, y = x + i, y + j
                    ok = y > x
                    left.append(x[ok])
                    right.append(y[ok])
        if not left:
            return None
        x, y = np.concatenate(left), np.concatenate(right)
        ok = np.concatenate([np.einsum("ij,ij->i", unit[x[k : k + ROWS]], unit[y[k : k + ROWS]]) for k in range(0, len(x), ROWS)] or [np.array([])]) >= self.threshold
        x, y = x[ok], y[ok]
        if not len(x):
            return None
        # Count a pair only where it meets first.
        who, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        keys = [cells(unit[who], t, self.probes) for t in range(self.tables)]
        p, q = at[: len(x)], at[len(x) :]
        first = np.ones(len(x), bool)
        for t in range(self.tables):
            k = keys[t]
            own = k[p, 0] == k[q, 0]
            q_visits = (k[q, 1:] == k[p, :1]).any(1)
            p_visits = (k[p, 1:] == k[q, :1]).any(1)
            first &= ~((own | q_visits | p_visits) & (t < table[x]))
            first &= ~((t == table[x]) & ~own & p_visits & q_visits & (ids[x] > ids[y]))
        x, y = x[first], y[first]
        return ids[x], ids[y], copies[x], copies[y]


def link_vectors(reps: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Rows (a, b, n) of distinct vectors reps(vec_id, copies, embedding).

    With b null: n more vectors that a links with. Otherwise an edge of the
    forest that connects what links.
    """

    def place(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.values.to_numpy(zero_copy_only=False).astype("<f8")[lists.offsets[0].as_py() :]
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                vectors = values[at[rows][:, None] + np.arange(dim)]
                unit = unit_rows(vectors)
                raw = pa.array([v.tobytes() for v in vectors], pa.binary())
                for t in range(tables):
                    keys = cells(unit, t, probes)
                    for c in range(keys.shape[1]):
                        columns = (np.full(len(rows), t, "i4"), keys[:, c], np.full(len(rows), c > 0), ids[rows], copies[rows])
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), raw], names=PLACED.names)

    def compare(batches):
        meet, held, count = _Meetings(threshold, tables, probes), [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                count += batch.num_rows
                if count < ROWS:
                    continue
            if not held:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            table, cell, guest, ids, copies = (rows.column(k).to_numpy() for k in range(5))
            stop = len(cell)
            if batch is not None:  # the last cell may go on
                stop = int(np.flatnonzero((cell == cell[-1]) & (table == table[-1]))[0])
            vecs = rows.column(5).slice(0, stop).to_pylist()
            width = np.fromiter(map(len, vecs), "int64", stop)
            for dim in np.unique(width).tolist():
                own = np.flatnonzero(width == dim)
                found = meet(table[own], cell[own], guest[own], ids[own], copies[own], [vecs[k] for k in own])
                if found is not None:
                    yield from _report(*found)
            held = rows.slice(stop).to_batches() if stop < len(cell) else []
            count = len(cell) - stop

    def _report(a, b, copies_a, copies_b):
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        n = np.bincount(at, np.concatenate([copies_b, copies_a])).astype("int64")
        label = merge_links(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(n)], names=FOUND.names)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]]), pa.array(np.zeros(len(moved), "int64"))], names=FOUND.names)

    reps.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    placed = reps.select("vec_id", "copies", "embedding").mapInArrow(place, PLACED)
    return placed.repartition("table", "cell").sortWithinPartitions("table", "cell", "guest").mapInArrow(compare, FOUND)


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept of embeddings(vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null vec_id, link with nothing and are their own
    component. Exact copies are linked without being expanded; vectors of
    different lengths never link; repeated vec_ids count as separate vectors.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("_key", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")))
    reps = keep(rows.where("_key is not null").groupBy(F.col("_key").alias("embedding")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "lattice-vectors")
    # A repeated vec_id may stand for several vectors: number the representatives apart.
    clash = reps.groupBy("rep").count().where("count > 1").isEmpty()
    reps = reps.withColumn("vec_id", F.col("rep") if clash else F.xxhash64("rep", "embedding"))
    found = keep(link_vectors(reps, threshold, tables, probes), "lattice-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null").select("a", "b"))
    named = reps.select("vec_id", "rep", "copies", "embedding").join(counts.withColumnRenamed("a", "vec_id"), "vec_id", "left")
    named = named.join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = keep(named.join(least, "component").select(F.col("embedding").alias("_key"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "lattice-named")
    out = rows.join(named, "_key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

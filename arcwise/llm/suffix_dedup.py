"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the threshold (50 bytes), by passes from
the most significant digit on; groups of one document leave after each pass,
and groups that are still equal after the last are exactly the repeated
windows.

* Every window has an anchor: the position of its smallest 24-byte key, so
  equal windows have equal anchors at equal places, and only about one
  position in fourteen is sorted. Pass 1 deals the anchors' digits out and
  keeps those that occur in two documents or more.
* Pass 2 orders the surviving anchors by the bytes around them that windows
  can reach (26 before, 50 from the anchor on). Anchors with equal
  surroundings in an earlier document are covered whole.
* Pass 3 expands only what is left to windows and orders them by their bytes,
  eight at a time, again dropping what stands alone after each digit.

Texts are kept in chunks; passes exchange digits and one answer bit or mask
for each anchor, sorted by chunk, so no pass moves the texts' windows.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, STR, discard, keep, schema, spent_shuffles_go

WINDOW, KEY = 50, 24
LEFT = WINDOW - KEY
#: Bytes of text in a chunk; bytes of text that one bucket of digits stands for.
CHUNK, BUCKET, BLOCK = 2 << 20, 8 << 20, 1 << 18
#: Occurrences of a key beyond which its windows are dealt by their own bytes.
HOT = 100_000
NOBODY = np.iinfo("int64").max

CHUNKS = schema(chunk=LONG, n_bytes=LONG, docs=BIN, ends=BIN, text=BIN)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def key_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the KEY bytes from every position on."""
    base = np.uint64(0xD1342543DE82EF95)
    power = lambda n: np.uint64(pow(int(base), n, 1 << 64))
    h = _mix(text.astype("u8") + np.uint64(1))
    by = {1: h}
    for n in (1, 2, 4, 8):
        h = by[n]
        by[2 * n] = h[:-n] * power(n) + h[n:]
    h16, h8 = by[16], by[8]
    return _mix(h16[: len(h16) - 8] * power(8) + h8[16:])


def _open(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ends and text of a chunk row."""
    import zstandard

    text = zstandard.decompress(row["text"], max_output_size=max(1, row["n_bytes"])) if row["n_bytes"] else b""
    return np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["ends"], "<i8"), np.frombuffer(text, "u1")


def _block_anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start of the block: its anchor; and the key hashes."""
    h = key_hashes(text)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype="u8")
    span, have = LEFT + 1, 1
    while have < span:  # minima over growing spans; the position breaks ties to the left
        step = min(have, span - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return (m & np.uint64(0xFFFFFFFF)).astype("int64"), h


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and key hashes of the anchors of all windows inside documents.

    The anchor is the leftmost smallest of the keys inside a window; windows
    never cross the ends of documents. The hashes are mixed once more, so that
    they are spread evenly.
    """
    places, keys, last = [np.array([], "int64")], [np.array([], "u8")], -1
    for start in range(0, len(text) - WINDOW + 1, BLOCK):
        stop = min(start + BLOCK, len(text) - WINDOW + 1)
        at, h = _block_anchors(text[start : stop + WINDOW - 1])
        ok = np.ones(len(at), bool)
        for e in ends[np.searchsorted(ends, start, side="right") : np.searchsorted(ends, stop + WINDOW)].tolist():
            ok[max(0, e - WINDOW + 1 - start) : max(0, e - start)] = False
        ok[len(text) - WINDOW + 1 - start :] = False
        at = at[ok]
        at = at[np.flatnonzero(np.diff(at, prepend=last - start))]  # anchors never decrease
        if len(at):
            last = start + int(at[-1])
            places.append(at + start)
            keys.append(h[at])
    # Smallest keys are small numbers, which would crowd the first buckets.
    return np.concatenate(places), _mix(np.concatenate(keys))


def surroundings(text: np.ndarray, ends: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of LEFT bytes before and WINDOW bytes from each anchor, then the room left and right.

    Bytes outside the anchor's document are zero; the rooms tell them from real ones.
    """
    starts = np.concatenate([[0], ends[:-1]])
    left, right = np.minimum(at - starts[doc], LEFT), np.minimum(ends[doc] - at, WINDOW)
    padded = np.concatenate([np.zeros(LEFT, "u1"), text, np.zeros(WINDOW, "u1")])
    out = np.empty((len(at), LEFT + WINDOW + 2), "u1")
    out[:, :-2] = np.lib.stride_tricks.sliding_window_view(padded, LEFT + WINDOW)[at]
    for i in np.flatnonzero((left < LEFT) | (right < WINDOW)):
        out[i, : LEFT - left[i]] = 0
        out[i, LEFT + right[i] : LEFT + WINDOW] = 0
    out[:, -2], out[:, -1] = left, right
    return out


def valid_mask(around: np.ndarray) -> np.ndarray:
    """Bit o is set if the window o bytes before the anchor lies in the document."""
    left, right = around[:, -2], around[:, -1]
    out = np.zeros(len(around), "u4")
    for o in range(LEFT + 1):  # one position at a time: a matrix of all would be many times the entries
        out |= ((left >= o) & (right >= WINDOW - o)).astype("u4") << np.uint32(o)
    return out


def make_chunks(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Texts of docs(doc_id, text) packed into chunk rows; null text is empty, a null id the largest."""

    def pack(batches):
        import zstandard

        name = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row():
            ends = np.cumsum([len(t) for t in texts]).astype("<i8")
            cells = (name, int(ends[-1]), np.array(ids, "<i8").tobytes(), ends.tobytes(), zstandard.compress(b"".join(texts), 1))
            return _rows(CHUNKS.names, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], [cells])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(NOBODY if doc is None else doc)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield row()
                    name, ids, texts, size = name + 1, [], [], 0
        if ids:
            yield row()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.select("doc_id", "text").mapInArrow(pack, CHUNKS)


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key: its most significant digit to base n."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype("int64")


def _by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by key and, for each bucket that occurs, (bucket, from, to)."""
    order = np.argsort(keys, kind="stable")
    b = _buckets(keys[order], n)
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    return order, [(int(b[i]), int(i), int(j)) for i, j in itertools.pairwise([*cut.tolist(), len(b)])]


ASK = schema(bucket=INT, chunk=LONG, low=BIN, docs=BIN)
TELL = schema(bucket=INT, chunk=LONG, told=BIN)
ENTRY = schema(bucket=INT, chunk=LONG, keys=BIN, around=BIN, docs=BIN)
WIDTH = LEFT + WINDOW + 2


def _survey(row):
    """A chunk's anchors and its distinct keys in order with their numbers of documents."""
    ids, ends, text = _open(row)
    at, keys = anchors(text, ends)
    doc = np.searchsorted(ends, at, side="right")
    uniq, inverse = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids[doc], inverse))
    new = np.diff(inverse[order], prepend=-1) != 0
    new[1:] |= np.diff(ids[doc][order]) != 0
    return ids, ends, text, at, doc, uniq, inverse, np.bincount(inverse[order][new], minlength=len(uniq))


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """What is sent of a key besides its bucket. Fewer bits let more survive, no result changes."""
    return (keys >> np.uint64(16)).astype("<u4") if n <= 1024 else keys.astype("<u8")


def ask_keys(chunks: DataFrame, n: int) -> DataFrame:
    """Pass 1, out: each chunk's distinct keys by bucket, with the numbers of documents."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                *_, uniq, _, docs = _survey(row)
                order, parts = _by_bucket(uniq, n)
                low, docs = _low(uniq[order], n), np.minimum(docs[order], 255).astype("u1")
                yield _rows(ASK.names, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], [(b, row["chunk"], low[i:j].tobytes(), docs[i:j].tobytes()) for b, i, j in parts])

    return chunks.mapInArrow(ask, ASK)


def _tell_keys(group: pd.DataFrame, n: int, hot: int) -> pd.DataFrame:
    """Pass 1, back: 0 for keys of one document, 1 for repeated keys, 2 for hot ones."""
    lows = [np.frombuffer(x, "<u4" if n <= 1024 else "<u8") for x in group["low"]]
    docs = np.concatenate([np.frombuffer(x, "u1") for x in group["docs"]])
    _, inverse = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.bincount(inverse, docs)
    # Keys of one document that is cut over chunks do not occur: documents are whole.
    told = ((total > 1).astype("u1") + (total > hot))[inverse].astype("u1")
    cuts = np.cumsum([len(x) for x in lows])[:-1]
    return group[["bucket", "chunk"]].assign(told=[x.tobytes() for x in np.split(told, cuts)])


def equal_groups(group: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
    """Most significant digit first: the group of each row after all digits, -1 where it stands alone."""
    alive, g = np.arange(len(group)), group
    out = np.full(len(group), -1, "int64")
    for k in range(len(digits) + 1):
        d = digits[k - 1][alive].astype("u8") if k else None
        order = np.argsort(g, kind="stable") if k == 0 else np.lexsort((d, g))
        alive, g = alive[order], g[order]
        new = np.diff(g, prepend=g[:1] - 1) != 0
        if k:
            d = d[order]
            new[1:] |= d[1:] != d[:-1]
        g = np.cumsum(new)
        keep_ = np.bincount(g)[g] > 1
        alive, g = alive[keep_], g[keep_]
        if not len(alive):
            return out
    out[alive] = g
    return out


def _words(columns: np.ndarray) -> list[np.ndarray]:
    """Bytes of each row as eight-byte digits, views of one padded copy (or of the rows themselves where they need no padding)."""
    width = -(-columns.shape[1] // 8) * 8
    if width == columns.shape[1] and columns.flags["C_CONTIGUOUS"]:
        return list(columns.view(">u8").T)
    wide = np.zeros((len(columns), width), "u1")
    wide[:, : columns.shape[1]] = columns
    return list(wide.view(">u8").T)


def resolve(keys: np.ndarray, around: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Passes 2 and 3: which windows of each entry occur in a document before the entry's."""
    if not len(keys):
        return np.array([], "u4")
    valid = valid_mask(around)
    # Pass 2: entries with equal surroundings.
    same = equal_groups(keys, _words(around))
    lone = same < 0
    label = np.where(lone, np.arange(len(keys)) + same.max() + 1, same)
    _, cls = np.unique(label, return_inverse=True)
    least = np.full(cls.max() + 1, NOBODY)
    np.minimum.at(least, cls, docs)
    first = np.full(len(least), len(keys))
    np.minimum.at(first, cls, np.arange(len(keys)))
    mask = np.where(docs > least[cls], valid, 0).astype("u4")
    # Pass 3: windows of unlike surroundings that share the key.
    _, g = np.unique(keys[first], return_inverse=True)
    many = np.flatnonzero(np.bincount(g)[g] > 1)
    if len(many):
        rows, g, d = around[first[many]], g[many], least[many]
        extra = np.zeros(len(many), "u4")
        for o in range(LEFT + 1):
            ok = np.flatnonzero(valid[first[many]] >> np.uint32(o) & 1)
            if len(ok) < 2:
                continue
            # The key itself is a hash as yet: its bytes are digits too.
            eq = equal_groups(g[ok], _words(rows[ok][:, LEFT - o : LEFT - o + WINDOW]))
            hit = np.flatnonzero(eq >= 0)
            if len(hit):
                low = np.full(eq.max() + 1, NOBODY)
                np.minimum.at(low, eq[hit], d[ok[hit]])
                extra[ok[hit]] |= (d[ok[hit]] > low[eq[hit]]).astype("u4") << np.uint32(o)
        by_class = np.zeros(len(least), "u4")
        by_class[many] = extra
        mask |= by_class[cls]
    return mask


def _resolve_bucket(group: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    keys = [np.frombuffer(x, "<u8") for x in group["keys"]]
    around = np.frombuffer(b"".join(zstandard.decompress(x) for x in group["around"]), "u1").reshape(-1, WIDTH)
    docs = np.concatenate([np.frombuffer(x, "<i8") for x in group["docs"]])
    mask = resolve(np.concatenate(keys), around, docs)
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    return group[["bucket", "chunk"]].assign(told=[x.astype("<u4").tobytes() for x in np.split(mask, cuts)])


def _entries(row, told: np.ndarray, n: int):
    """Pass 2, out: a chunk's distinct surroundings, and which of them each surviving anchor has.

    Returns keys, surroundings and smallest documents of the entries in
    order, and for the places of the chunk: position, entry, local mask.
    """
    ids, ends, text, at, doc, uniq, inverse, _ = _survey(row)
    level = np.zeros(len(uniq), "u1")
    level[np.argsort(uniq, kind="stable")] = told
    level = level[inverse]
    pick = level == 1
    places, keys = [at[pick]], [uniq[inverse[pick]]]
    around, owner = [surroundings(text, ends, at[pick], doc[pick])], [ids[doc[pick]]]
    pick = np.flatnonzero(level == 2)
    if len(pick):  # hot keys: every window is an entry of its own, dealt by its bytes
        wide = surroundings(text, ends, at[pick], doc[pick])
        valid = valid_mask(wide)
        for o in range(LEFT + 1):
            ok = np.flatnonzero(valid >> np.uint32(o) & 1)
            rows = np.zeros((len(ok), WIDTH), "u1")
            rows[:, LEFT : LEFT + WINDOW] = wide[ok][:, LEFT - o : LEFT - o + WINDOW]
            rows[:, -1] = WINDOW
            h = np.zeros(len(ok), "u8")
            for w in _words(rows[:, LEFT : LEFT + WINDOW]):
                h = _mix(h + w.astype("u8"))
            places.append(at[pick[ok]] - o)
            keys.append(h)
            around.append(rows)
            owner.append(ids[doc[pick[ok]]])
    places, keys, around, owner = map(np.concatenate, (places, keys, around, owner))
    h = keys.copy()
    for w in _words(around):
        h = _mix(h + w.astype("u8"))
    # Equal hashes here are taken for equal bytes only after comparing them.
    _, first, entry = np.unique(h, return_index=True, return_inverse=True)
    odd = np.flatnonzero((around != around[first[entry]]).any(1) | (keys != keys[first[entry]])) if len(h) else np.array([], "int64")
    entry[odd] = len(first) + np.arange(len(odd))
    first = np.concatenate([first, odd])
    least = np.full(len(first), NOBODY)
    np.minimum.at(least, entry, owner)
    order, parts = _by_bucket(keys[first], n)
    place_of = np.empty(len(order), "int64")
    place_of[order] = np.arange(len(order))
    local = np.where(owner > least[entry], valid_mask(around), 0).astype("<u4")
    return keys[first][order], around[first][order], least[order], parts, places, place_of[entry], local


def _told(answers: pd.DataFrame, kind: str) -> np.ndarray:
    return np.concatenate([np.array([], kind), *(np.frombuffer(x, kind) for x in answers.sort_values("bucket")["told"])])


def _ask_entries(chunk: pd.DataFrame, answers: pd.DataFrame, n: int) -> pd.DataFrame:
    import zstandard

    rows = []
    for row in chunk.to_dict("records"):
        keys, around, least, parts, places, entry, local = _entries(row, _told(answers, "u1"), n)
        rows += [(b, row["chunk"], keys[i:j].astype("<u8").tobytes(), zstandard.compress(around[i:j].tobytes(), 3), least[i:j].astype("<i8").tobytes()) for b, i, j in parts]
        rows.append((-1, row["chunk"], places.astype("<i4").tobytes(), entry.astype("<i4").tobytes(), local.tobytes()))
    return pd.DataFrame(rows, columns=ENTRY.names)


def removed_bytes(n: int, places: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a window told by places and masks."""
    edge = np.zeros(n + 1, "int32")
    for o in range(LEFT + 1):
        at = places[mask >> np.uint32(o) & 1 == 1].astype("int64") - o
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = schema(doc_id=LONG, n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept_sha256=STR)


def _finish(chunk: pd.DataFrame, answers: pd.DataFrame, texts: bool) -> pd.DataFrame:
    rows = []
    for row in chunk.to_dict("records"):
        ids, ends, text = _open(row)
        gone = np.zeros(len(text), bool)
        own = answers[answers["bucket"] < 0]
        if len(own):
            places, entry, local = (np.frombuffer(own.iloc[0][c], "<i4" if c != "docs" else "<u4") for c in ("keys", "around", "docs"))
            told = _told(answers[answers["bucket"] >= 0], "<u4")
            gone = removed_bytes(len(text), places, np.where(local > 0, local, told[entry]))
        starts = np.concatenate([[0], ends[:-1]])
        run = gone.copy()
        run[1:] &= ~gone[:-1]
        run[starts[starts < len(text)]] = gone[starts[starts < len(text)]]
        many = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(run)])
        kept = memoryview(np.ascontiguousarray(text[~gone])).cast("B")
        at = ends - many[ends]
        for d, a, b, x, y in zip(ids.tolist(), starts.tolist(), ends.tolist(), (at - (ends - starts) + many[ends] - many[starts]).tolist(), at.tolist(), strict=True):
            out = (None if d == NOBODY else d, b - a, int(many[b] - many[a]), int(spans[b] - spans[a]), hashlib.sha256(kept[x:y]).hexdigest())
            rows.append((*out, bytes(kept[x:y])) if texts else out)
    return pd.DataFrame(rows, columns=[*RESULT.names, *(["kept"] if texts else [])]).astype({"doc_id": "Int64"})


def dedup_strings(docs: DataFrame, texts: bool = False, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of docs(doc_id, text); with texts also the kept bytes.

    A byte goes if a string of 50 bytes around it also starts in a document
    with a smaller doc_id, judged on the input. Null text is empty; a null id
    is larger than all others and comes back null; rows with equal ids never
    remove each other's bytes. Extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    # Laid out by chunk, so that answers come to the texts and texts are never shuffled.
    name = f"arcwise_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with spent_shuffles_go(spark):
        make_chunks(docs, chunk_bytes).write.bucketBy(buckets, "chunk").format("parquet").saveAsTable(name)
    chunks = spark.table(name)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    told = keep(ask_keys(chunks, n).groupBy("bucket").applyInPandas(lambda g: _tell_keys(g, n, hot), TELL), "suffix-keys")
    entries = keep(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(lambda c, a: _ask_entries(c, a, n), ENTRY), "suffix-entries")
    discard(told)
    masks = keep(entries.where("bucket >= 0").groupBy("bucket").applyInPandas(_resolve_bucket, TELL), "suffix-masks")
    own = entries.where("bucket < 0")
    answers = own.select(*ENTRY.names, F.lit(None).cast("binary").alias("told")).unionByName(masks.select("bucket", "chunk", *(F.lit(None).cast("binary").alias(c) for c in ("keys", "around", "docs")), "told"))
    out = T.StructType([*RESULT, *(schema(kept=BIN) if texts else [])])
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda c, a: _finish(c, a, texts), out)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove what repeats over 50 bytes from every document."""
    return dedup_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Token counts, ids in ORC, packing, images: against the libraries and brute force."""

import random
import zlib

import numpy as np
import pytest

from arcwise.llm import media_png as M
from arcwise.llm import packing as P
from arcwise.llm.coders import WordCoder, default_path
from arcwise.llm.common import new_path
from arcwise.llm.token_counts import PrefixCounter, fit_prefix, prefix_table, token_counts, truncate
from arcwise.llm.token_orc import digests, read_tokens, write_tokens

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = ["the", " ", "  ", "\n", "\t", "it's", "'ll", "'", "'re", "!!", "é", "ß", "日本", "12", "½", "_", "<|endoftext|>", "<|end", " x", "Hello", "zzzz", " ", "　", "\x1c", "🙂", "tion", "I'", "'v", "'ve", "Σ", "İ", "é", "<|STARTOFTEXT|>"]
ROWS = [(1, "Hello there, it's fine."), (2, None), (3, ""), (3, "again again"), (None, "no id"), (4, "w " * 3000), (5, "word")]
SCHEMA = "doc_id long, text string, n_tokens int, part string"


def texts(n: int, seed: int = 5):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 9))) for _ in range(n)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def test_prefix_counts_equal_the_library():
    counter, library = PrefixCounter(default_path("byte_bpe_50k.json")), tokenizers.Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    for x in texts(400):
        assert counter.count(x) == count(x)
        assert counter.prefixes(x).tolist() == [count(x[:i]) for i in range(len(x) + 1)]
    assert fit_prefix([0, 1, 2, 2, 3], 2) == 3


def test_token_counts_query(spark):
    library = tokenizers.Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    got = sorted(map(str, token_counts(frame(spark), default_path("byte_bpe_50k.json"), 1024).collect()))
    assert len(got) == len(ROWS)
    for r in token_counts(frame(spark), default_path("byte_bpe_50k.json"), 1024).where("doc_id = 4").collect():
        n = len(library.encode("w " * 3000, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (6000, n, n > 1024)
    assert token_counts(frame(spark, []), default_path("byte_bpe_50k.json")).count() == 0


def test_truncation_reads_stored_counts(spark):
    path = default_path("byte_bpe_50k.json")
    docs = frame(spark, [(1, "Hello there, it's fine."), (2, "")])
    got = {r.doc_id: r.text for r in truncate(prefix_table(docs, path), docs, 4).collect()}
    library = tokenizers.Tokenizer.from_file(path)
    fits = [i for i in range(24) if len(library.encode("Hello there, it's fine."[:i]).ids) <= 4]
    assert got == {1: "Hello there, it's fine."[: max(fits)], 2: ""}


def test_word_ids_equal_the_library():
    path = default_path("word_bpe_49k.json")
    coder, library = WordCoder(path, limit=50), tokenizers.Tokenizer.from_file(path)
    for x in texts(600, 9):
        assert np.frombuffer(coder.encode(x.encode()), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids


def test_orc_round_trip(spark):
    path, place = default_path("word_bpe_49k.json"), new_path(spark, "test-orc")
    write_tokens(frame(spark), place, path)
    library, start = tokenizers.Tokenizer.from_file(path), 0
    got = digests(spark, place).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    known = {zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in ROWS}
    for r in got:
        assert r.start == start and r.ids_crc32 in known
        start += r.n_tokens
    assert read_tokens(spark, place).where("doc_id = 3").count() == 2
    empty = new_path(spark, "test-orc")
    write_tokens(frame(spark, []), empty, path)
    assert digests(spark, empty).count() == 0


def best(lengths, capacity):
    least = [len(lengths)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(lengths):
            least[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return least[0]


def test_bounds_lie_below_the_optimum():
    r = random.Random(1)
    for _ in range(150):
        c = r.choice([7, 10, 12, 16])
        lengths = sorted((r.randint(1, c) for _ in range(r.randint(1, 8))), reverse=True)
        bins, _ = P.best_fit(lengths, c)
        assert P.lower_bound(np.array(lengths), c) <= best(lengths, c) <= max(bins) + 1


def layout_is_sound(rows, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert all(v <= capacity for v in at.values())
    return len(at)


def test_exchange_improves_and_keeps_every_piece(spark):
    r = random.Random(2)
    lengths = [r.randint(1, 2048) for _ in range(2000)]
    pieces = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], P.PIECE)
    alone = layout_is_sound(P.pack_pieces(pieces, part_rows=200, rounds=0).collect(), 2048)
    rows = P.pack_pieces(pieces, part_rows=200).collect()
    assert sorted(x.uid for x in rows) == list(range(2000))
    assert P.lower_bound(np.array(lengths)) <= layout_is_sound(rows, 2048) < alone


def test_packing_documents(spark):
    path = default_path("word_bpe_49k.json")
    rows = P.pack_documents(frame(spark), path).collect()
    library = tokenizers.Tokenizer.from_file(path)
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert sum(r.length for r in rows) == total and layout_is_sound(rows, 2048) == -(-total // 2048)
    long = sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.piece)
    assert [(r.piece, r.start, r.length) for r in long] == [(0, 0, 2048), (1, 2048, 953)]
    assert P.pack_documents(frame(spark, []), path).count() == 0


def test_png_filters_and_damage():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (6, 9)).astype("u1")
    rows = np.zeros((6, 10), "u1")
    rows[:, 0] = [0, 1, 2, 3, 4, 4]
    for y in range(6):
        for x in range(9):
            a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))
            rows[y, x + 1] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][rows[y, 0]]) % 256
    assert (M.unfilter(rows) == image).all()
    for data in (b"", b"abc", "é".encode() * 900, bytes(range(256)) * 9):
        png = M.encode_png(M.pad(data))
        assert M.decode_png(png).tobytes() == M.pad(data) and len(M.pad(data)) % 576 == 0
        for at in (3, 20, len(png) // 2, len(png) - 5):
            with pytest.raises(M.DamagedImage):
                M.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])


def test_media_rows(spark):
    got = M.media_features(M.store_media(frame(spark))).collect()
    assert len(got) == len(ROWS) and {r.n_bytes for r in got if r.doc_id == 2} == {0}
    same = {(r.n_bytes, r.media_sha256, r.feature) for r in got if r.n_bytes == 0}
    assert len(same) == 1
    assert M.media_features(M.store_media(frame(spark, []))).count() == 0

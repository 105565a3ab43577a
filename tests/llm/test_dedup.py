"""Near-duplicate operators against brute force on small inputs."""

import hashlib
import random
import re

import numpy as np
import xxhash

from arcwise.llm import lattice, line_dedup, simhash
from arcwise.llm import suffix_dedup as S
from arcwise.llm.common import components, merge_links

BIG = S.NOBODY


def brute_strings(rows):
    first = {}
    for i, t in rows:
        b, k = (t or "").encode(), BIG if i is None else i
        for a in range(len(b) - 49):
            first[b[a : a + 50]] = min(first.get(b[a : a + 50], BIG), k)
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), BIG if i is None else i
        gone = [0] * len(b)
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < k:
                gone[a : a + 50] = [1] * 50
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def order(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def string_rows():
    r = random.Random(2)
    words = ["the", "of", "alpha", "beta", "é", "gamma delta", "zz"]
    passages = [" ".join(r.choice(words) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(40):
        t = ""
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            t += p[a : a + r.randint(1, 120)] + "".join(r.choice("abcdefgh \n") for _ in range(r.randint(0, 60)))
        rows.append((i, t))
    return [*rows, (None, passages[0]), (7, passages[0] + passages[1]), (100, None), (101, ""), (102, "a" * 49), (103, "a" * 50), (104, "a" * 300), (105, "a" * 120 + "b"), (None, passages[0])]


def test_suffix_dedup_equals_brute_force(spark):
    rows = string_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string").repartition(3)
    expected = sorted(brute_strings(rows), key=order)
    for how in ({}, {"chunk_bytes": 700, "bucket_bytes": 2000, "hot": 3}):
        assert sorted((tuple(x) for x in S.dedup_strings(docs, **how).collect()), key=order) == expected
    kept = S.dedup_strings(docs, texts=True).where("doc_id = 104").first()
    assert len(kept.kept) == kept.n_bytes - kept.n_removed
    assert S.dedup_strings(docs.limit(0)).count() == 0


def test_radix_groups():
    r = np.random.default_rng(3)
    group, digits = r.integers(0, 3, 300), [r.integers(0, 4, 300).astype("u8") for _ in range(3)]
    got = S.equal_groups(group, digits)
    keys = list(zip(group.tolist(), *[d.tolist() for d in digits], strict=True))
    for i in range(300):
        assert (got[i] >= 0) == (keys.count(keys[i]) > 1)
        assert all((got[i] == got[j]) == (keys[i] == keys[j]) for j in range(300) if got[i] >= 0 and got[j] >= 0)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def parts(fps, ids):
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    return np.array(ids)[merge_links(len(fps), a, b)]


def test_simhash_equals_brute_force(spark):
    r = random.Random(4)
    words = ["Alpha", "beta", "É", "gamma", "delta", "x"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts += [texts[5] + " x", texts[6], None, "", " \n ", "one", "one two"]
    ids = list(range(10, 10 + len(texts)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int")
    got = {x.doc_id: x for x in simhash.simhash_components(docs).collect()}
    fps = np.array([slow_fingerprint(t) for t in texts], "u8")
    assert [int(got[i].fingerprint, 16) for i in ids] == fps.tolist()
    assert [got[i].component_id for i in ids] == parts(fps, ids).tolist()
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    r = np.random.default_rng(3)
    out = []
    for base in r.integers(0, 2**63, 20, dtype="u8"):
        cur = int(base)
        for _ in range(40):
            for _ in range(r.integers(1, 3)):
                cur ^= 1 << int(r.integers(0, 64))
            out.append(cur)
    fps = np.unique(np.array(out, "u8"))
    place = {int(v): i for i, v in enumerate(fps.view("i8"))}
    for segments in (2, 4):
        links = simhash.link_fingerprints(spark.createDataFrame([(int(v),) for v in fps.view("i8")], "fp long"), 2, segments).toPandas()
        got = merge_links(len(fps), np.array([place[x] for x in links.a]), np.array([place[x] for x in links.b]))
        assert (got == parts(fps, np.arange(len(fps)))).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 140)}}  # the smallest has no row


def test_lattice_decoder_finds_the_nearest_point():
    r = np.random.default_rng(5)
    x = r.standard_normal((300, 8)) * 2
    own = lattice.decode_e8(x)
    dist = ((x - own / 2) ** 2).sum(1)
    assert (((x[:, None] - (own[:, None] + lattice.neighbours()[None]) / 2) ** 2).sum(2) >= dist[:, None] - 1e-9).all()
    assert ((own % 2 == own[:, :1] % 2).all(1) & (own.sum(1) % 4 == 0)).all() and len(lattice.neighbours()) == 240


def test_lattice_links(spark):
    r, x = np.random.default_rng(1), []
    for b in r.standard_normal((15, 64)):
        b = b / np.linalg.norm(b)
        for _ in range(12):
            v = r.standard_normal(64)
            v -= v @ b * b
            c = r.choice([0.93, 0.95, 0.97, 0.99])
            x.append(c * b + np.sqrt(1 - c * c) * v / np.linalg.norm(v))
    x = np.array(x + x[:30])
    unit = lattice.unit_rows(x)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = lattice.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int")).toPandas().sort_values("vec_id")
    assert got.n_links.sum() >= 0.99 * near.sum() and (got.n_links.to_numpy() <= near.sum(1)).all()
    assert (got.component_id.to_numpy() == merge_links(len(x), *np.nonzero(near))).mean() > 0.99
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_lattice_odd_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 2.0]), (6, [2.0, 4.0]), (6, [1.0, 2.0]), (7, [1e300, 2e300]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 8, 9)]
    assert got == sorted([*alone, (0, 0, None, True), (5, 3, 5, True), (6, 3, 5, False), (6, 3, 5, False), (7, 3, 5, False)], key=str)
    assert lattice.near_vectors(df.limit(0)).count() == 0


def brute_lines(rows):
    lines = [(d, n, line, set(line.split(" ")) - {""}) for d, t in rows if t is not None and d is not None for n, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if len([w for w in x[2].split(" ") if w]) >= 5]
    return {(d, n) for d, n, _, w in lines if any((e, m) < (d, n) and 5 * len(w & v) >= 4 * len(w | v) for e, m, _, v in lines)}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(3, 25))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 5)):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                line[r.randrange(len(line))] = r.choice(words)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (None, rows[3][1]), (202, "a b c d\na b c d"), (203, "  \n\n a  b c d e f")]
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, word int, hub string")
    expected = brute_lines(rows)
    assert {(x.doc_id, x.line_no) for x in line_dedup.later_matches(docs).collect()} == expected and len(expected) > 20
    for x in line_dedup.dedup_lines(docs).where("doc_id is not null").collect():
        text = dict(r for r in rows if r[0] is not None)[x.doc_id]
        assert x.text == (None if text is None else "\n".join(v for n, v in enumerate(text.split("\n")) if (x.doc_id, n) not in expected))
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(docs).count() == len(rows)
    assert line_dedup.later_matches(docs.limit(0)).count() == 0

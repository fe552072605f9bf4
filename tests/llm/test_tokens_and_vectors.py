"""Byte-level BPE against the tiktoken library, clusters and whitening against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from clausewright.llm import byte_bpe, dual_tree, whitening
from clausewright.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, ids string, decoded int, v int"
VECTORS = "vec_id long, embedding array<double>, id string, v int, cluster int, i int, x int, n int"


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_bpe.BytePairEncoder(ranks, P.PATTERN, byte_bpe.library_classes())


def odd_texts():
    rng = random.Random(7)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    letters = "ab cd'sllre\n\t 12é中  ,.!ABC"
    texts = ["", None, "don't  we'll\n\n x", "<|endoftext|>", "\x1c\x1d\x85  　", "a" * 70_000, " " * 9_000 + "x", "中文" * 9_000, "1234567890" * 900]
    texts += ["".join(chr(rng.choice(points)) for _ in range(60)) for _ in range(300)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(400)]
    return texts + ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in [*range(1, 300, 7), 257, 5000]]


def test_ids_are_those_of_the_library(encoder, library, monkeypatch):
    texts = odd_texts()
    want = [library.encode_ordinary(t or "") for t in texts]
    for chunk, pending, known in ((1 << 18, 1 << 18, 100_000), (64, 50, 20)):  # whole, and in small parts with much forgotten
        for name, value in (("CHUNK", chunk), ("PENDING", pending), ("KNOWN_PIECES", known)):
            monkeypatch.setattr(byte_bpe, name, value)
        ids, at = encoder.encode(texts)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want


def test_bpe_round_trip(spark, library):
    texts = odd_texts()
    rows = [(i, t, "k", 1, 2) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (3, "again", "", 0, 0), (3, "again", "", 0, 0)]
    found = byte_bpe.bpe_decode(byte_bpe.bpe_encode(spark.createDataFrame(rows, DOCS).repartition(3), PATH, P.PATTERN), PATH).collect()
    want = sorted((-1 if r[0] is None else r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids), bytes(r.decoded)) for r in found) == want
    assert byte_bpe.bpe_encode(spark.createDataFrame([], DOCS), PATH, P.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert {bytes(r.decoded) for r in byte_bpe.bpe_decode(nulls, PATH).collect()} == {b""}
    with pytest.raises(Exception, match="an id is no token"):
        byte_bpe.bpe_decode(spark.createDataFrame([(1, [60_000])], "k int, ids array<int>"), PATH).collect()


def test_op11_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op11_byte_bpe"](spark, DATA).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs.pop(r.doc_id).encode()).hexdigest()
    assert not docs


def test_cover_tree_and_descent():
    rng = np.random.default_rng(3)
    for trial in range(60):
        dim = int(rng.integers(1, 6)) if trial % 2 else 64
        points = np.unique(rng.integers(-8, 9, (rng.integers(1, 300), dim)), axis=0).astype(np.int64)
        centroids = rng.integers(-8, 9, (rng.integers(1, 20), dim)).astype(np.int64)
        laid, nodes = dual_tree.cover_tree(points)
        assert sorted(laid) == list(range(len(points)))
        q = points[laid]
        for node in nodes:
            below = ((q[node["first"] : node["last"]] - q[node["point"]]) ** 2).sum(axis=1)
            assert abs(below.max() ** 0.5 - node["radius"]) < 1e-9 and node["first"] <= node["point"] < node["last"]
        got = dual_tree.nearest(q, nodes, *dual_tree._centroid_tree(centroids.tolist()))
        assert (got == ((q[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)).all()
    big = rng.integers(-(1 << 27), 1 << 27, (5, 3))
    assert dual_tree.squared(big, big).tolist() == [[int(((a - b) ** 2).sum()) for b in big] for a in big]


def lloyd(rows, k=16, rounds=3, dim=64):
    kept = [(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], np.int64).reshape(-1, dim)
    c = x[:k].copy()
    for step in range(rounds + 1):
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        for j in range(len(c)) if step < rounds else []:
            if (own == j).any():
                c[j] = x[own == j].sum(axis=0) // (own == j).sum()
    least = d.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return [(i, int(j), int(e), int(least[own == j].sum()), int(least.sum()), digest[j]) for (i, _), j, e in zip(kept, own, least, strict=True)]


def vectors(dim=64, n=260, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dim) / 3 + (i % 5)).tolist()) for i in range(n)]
    rows += [(900 + i, rows[7][1]) for i in range(40)] + [rows[3], rows[3], (None, rows[9][1]), (None, rows[11][1])]
    bad = [None, [], [1.0], [None] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), rows[0][1][:-1] + [None]]
    return rows + [(2000 + i, v) for i, v in enumerate(bad)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, 2, 3, 4, 5) for i, v in rows], VECTORS)


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_dual_tree_clusters(spark, monkeypatch):
    rows = vectors()
    want = plain(lloyd(rows))
    assert plain(dual_tree.dual_tree_clusters(frame(spark, rows).repartition(3)).collect()) == want
    monkeypatch.setattr(dual_tree, "BLOCK", 16)
    assert plain(dual_tree.dual_tree_clusters(frame(spark, rows).coalesce(1)).collect()) == want
    few = rows[:5] + rows[260:270]
    assert plain(dual_tree.dual_tree_clusters(frame(spark, few)).collect()) == plain(lloyd(few))
    assert dual_tree.dual_tree_clusters(frame(spark, rows[-7:])).count() == 0
    assert dual_tree.dual_tree_clusters(frame(spark, [])).count() == 0
    with pytest.raises(Exception, match="too large"):
        dual_tree.dual_tree_clusters(frame(spark, [(1, [1e9] * 64)])).collect()


def test_op12_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    cursor = con.execute(ORACLE_SQL["op12_dual_tree_lloyd"])
    names = [d[0] for d in cursor.description]
    df = QUERIES["op12_dual_tree_lloyd"](spark, DATA)
    assert df.columns == names
    assert plain(df.collect()) == plain(cursor.fetchall())


def whitened(rows, dim, count=16):
    kept = [(i, [int(np.floor(64 * x)) + 1_000_000 for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, total, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    out = {}
    for i, x in kept:
        c = np.array([(n * a - s) / n for a, s in zip(x, total, strict=True)])
        off = sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
        out[i] = (n, off, c @ axes / np.sqrt(values))
    return out, values / np.trace(cov)


def check_whitening(found, want, shares, tolerance):
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == set(want)
    signs = None
    for i, (n, off, white) in want.items():
        assert sorted(by[i]) == list(range(1, len(white) + 1))
        for c, repeats in by[i].items():
            for r in repeats:
                assert (r.n, r.deviation) == (n, off if off < 2**63 else None)
                assert abs(r.explained / shares[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        got = np.array([by[i][c][0].whitened for c in sorted(by[i])])
        signs = np.sign(got * white) if signs is None else signs
        assert np.abs(got * signs - white).max() < tolerance
    return by


def test_whitening(spark):
    rows = [r for r in vectors() if r[0] is not None]
    want, shares = whitened(rows, 64)
    by = check_whitening(whitening.whiten(frame(spark, rows).repartition(3)).collect(), want, shares, 1e-8)
    assert {len(repeats) for repeats in by[3].values()} == {3}  # the repeated row
    strong = [(i, [x * 4.0 ** -j for j, x in enumerate(v)]) for i, v in rows if v and len(v) == 64 and None not in v]
    strong = [(i, [x * 1e5 for x in v]) for i, v in strong]  # a falling spectrum, where fewer dimensions do
    check_whitening(whitening.whiten(frame(spark, strong), count=4).collect(), *whitened(strong, 64, 4), 1e-6)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, vectors()[-6:])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0, float(-i)]) for i in range(9)] + [(None, [0.0, 2.0, 0.0]), (50, [1.0])])).collect()
    assert {r.component for r in flat} == {1} and sorted(r.vec_id for r in flat if r.vec_id is not None) == list(range(9)) and len(flat) == 10
    assert all(r.n == 9 and abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in flat)


def test_range_finder_stops_early_and_expands():
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    for spectrum, passes in ((10.0 ** -np.arange(0.0, 80.0, 2.0), 2), (np.linspace(2, 1, 40), 3)):
        v, calls = (turn * spectrum) @ turn.T, []
        values, axes = whitening.components(lambda q: (calls.append(q.shape[1]), v @ q)[1], 40, 5)  # noqa: B023
        assert len(calls) <= passes and (calls[-1] == 40) == (passes == 3)
        assert np.abs(values - spectrum[:5]).max() < 1e-12 and np.abs(v @ axes - axes * values).max() < 1e-12
    huge = whitening._deviation(np.array([[3_000_000_000, 5]]), 4, np.array([8, 4], object), np.array([2, 1]))
    assert huge.to_pylist() == [None] and whitening._deviation(np.array([[300_000, 5]]), 10_000, np.array([8, 4], object), np.array([0, 0])).to_pylist() == [(10_000 * 300_000 - 8) ** 2 + (10_000 * 5 - 4) ** 2]

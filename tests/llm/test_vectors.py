"""Vector codes and clusters against plain versions and their SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

import oracle
from stitchwork.llm import bit_clusters, common, queries, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cluster string, id string, _key int, n int"


def _row(i, vector, label):
    return (i, vector, label, "x", "y", "z", 1, 2)


def _rows(n, size=64, seed=3):
    r = random.Random(seed)
    hot = [r.uniform(-1, 1) for _ in range(size)]
    out = [_row(i, hot if i % 3 == 0 else [r.gauss(0, 0.3) for _ in range(size)], None if i % 5 == 0 else i % 4) for i in range(n)]
    bad = [None, [], [None] + hot[1:], [math.nan] + hot[1:], [math.inf] + hot[1:], [-math.inf] * size, hot[:-1], hot + hot]
    out += [_row(10_000 + i, v, 1) for i, v in enumerate(bad)]
    out += [_row(1, [0.5] * size, 2), _row(1, [-0.5] * size, 2), _row(None, hot, None), _row(2, hot, 3), _row(2, hot, 3)]
    return out


def _kept(rows, size):
    return [r for r in rows if r[1] is not None and len(r[1]) == size and all(x is not None and math.isfinite(x) for x in r[1])]


def _ordered(rows, key):
    return sorted(rows, key=lambda r: (r[0] is None, key(r[0]) if r[0] is not None else 0, list(np.float32(r[1]))))


def _numbers(rows, scale):
    return np.floor(np.array([r[1] for r in rows], np.float32).astype(np.float64) * scale).astype(np.int64)


def _plain_codes(rows, parts, entries, rounds, size):
    rows = _ordered(_kept(rows, size), lambda i: i)
    x = _numbers(rows, 256).reshape(len(rows), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for k in range(rounds + 1):
        squares = [((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        codes = np.stack([s.argmin(axis=1) for s in squares], axis=1)
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = x[codes[:, p] == e, p]
                    if len(own):
                        books[p][e] = own.sum(axis=0) // len(own)
    error = sum(s.min(axis=1) for s in squares)
    by_label = {}
    for r, e in zip(rows, error.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    text = ",".join(str(v) for b in books for v in b.ravel().tolist())
    return sorted(((r[0], r[2], "".join(f"{c:02x}" for c in code), e, by_label[r[2]], text)
                   for r, code, e in zip(rows, codes.tolist(), error.tolist())), key=repr)


@pytest.mark.parametrize("n, size, parts, entries", [(700, 64, 16, 64), (90, 64, 4, 64), (40, 32, 16, 8)])
def test_codes_equal_a_plain_version(spark, monkeypatch, n, size, parts, entries):
    rows = _rows(n, size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = vector_codes.compress(df, parts=parts, entries=entries)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_codes(rows, parts, entries, 2, size)


def test_codes_over_several_blocks(spark, monkeypatch):
    rows = _rows(300)
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    monkeypatch.setattr(vector_codes, "BLOCKS_A_FILE", 2)
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).coalesce(1), entries=10)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_codes(rows, 16, 10, 2, 64)


def test_tree_and_walk():
    r = np.random.default_rng(5)
    for n, spread in ((1, 3), (2, 1), (33, 2), (900, 40), (900, 1_000_000), (500, 1)):
        points = r.integers(-spread, spread + 1, (n, 4))
        points[: n // 3] = points[0]  # a hot point
        order, balls = vector_codes.tree(points)
        assert sorted(order) == list(range(n)) and balls[0]["start"] == 0 and balls[0]["end"] == n
        for ball in balls:
            own = points[order[ball["start"]:ball["end"]]]
            assert (ball["sum"] == own.sum(axis=0)).all()
            assert ((own - own.mean(axis=0)) ** 2).sum(axis=1).max() <= (ball["radius"] * (1 + 1e-9) + 1e-6) ** 2
            if ball["left"] >= 0:
                a, b = balls[ball["left"]], balls[ball["right"]]
                assert (a["start"], a["end"], b["end"]) == (ball["start"], b["start"], ball["end"])
        entries = np.concatenate([points[:20], points[:3]])  # with ties
        codes = np.full(n, -1)
        sums, counts, _ = vector_codes.walk(points, order, balls, entries, codes)
        want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (codes == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
        assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(len(entries)))


def test_far_groups_are_owned_by_caches():
    r = np.random.default_rng(6)
    centres = r.integers(-50_000, 50_000, (12, 4))
    points = centres[r.integers(0, 12, 2_000)] + r.integers(-5, 6, (2_000, 4))
    order, balls = vector_codes.tree(points)
    assert vector_codes.walk(points, order, balls, centres)[2] == 2_000


def test_huge_components_are_held_at_the_bound(spark):
    rows = [_row(i, [3e38 if i % 2 else -3e38] * 64, 0) for i in range(8)]
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=1, rounds=0).collect()
    assert {r.error for r in got} == {0, (2 * vectors.bound_of(64)) ** 2 * 64} and max(r.error for r in got) < 2**63
    found = bit_clusters.cluster(spark.createDataFrame(rows, SCHEMA), clusters=2).collect()
    assert {r.distance for r in found} <= {0, (2 * vectors.bound_of(64)) ** 2 * 64}


def test_hot_and_rare_labels_get_their_sums(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    data = [(k % 7 if k % 2 else None, k) for k in range(200)] + [(99, 2**62), (99, 2**62)]
    got = vectors.with_sums(spark.createDataFrame(data, "label int, error long"), "label", "error", "s").collect()
    sums = {}
    for label, e in data:
        sums[label] = sums.get(label, 0) + e
    assert len(got) == len(data)
    assert all(r.s == (sums[r.label] if sums[r.label] < 2**63 else None) for r in got)


def _plain_clusters(rows, clusters, rounds):
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    rows = sorted(_kept(rows, 64), key=lambda r: (r[0] is None, digest(r[0]), list(np.float32(r[1]))))
    x = _numbers(rows, 64)
    centroids = x[:clusters].copy()
    for k in range(rounds + 1):
        squares = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
        own = squares.argmin(axis=1)
        if k < rounds:
            for c in range(len(centroids)):
                if (own == c).any():
                    centroids[c] = x[own == c].sum(axis=0) // (own == c).sum()
    far = squares.min(axis=1)
    return sorted(((r[0], c, d, int(far[own == c].sum()), int(far.sum()), ",".join(map(str, centroids[c].tolist())))
                   for r, c, d in zip(rows, own.tolist(), far.tolist())), key=repr)


@pytest.mark.parametrize("n, clusters", [(600, 16), (5, 16), (100, 1)])
def test_clusters_equal_a_plain_version(spark, n, clusters):
    rows = _rows(n)
    rows.append(_row(77_777, [1000.0] + [0.01] * 63, 1))  # needs more planes than the others
    got = bit_clusters.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), clusters=clusters)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_clusters(rows, clusters, 3)


def test_planes():
    r = np.random.default_rng(1)
    for low, high in ((0, 1), (-1, 0), (-1, 1), (-7, 9), (-2**27, 2**27)):
        x, y = r.integers(low, high + 1, (30, 64)), r.integers(-70, 70, (5, 64))
        need = bit_clusters.widths(x)
        assert all(-2**(w - 1) <= row.min() and row.max() < 2**(w - 1) for w, row in zip(need.tolist(), x))
        a, b = bit_clusters.pack(x, int(need.max())), bit_clusters.pack(y, 9)
        assert (bit_clusters.dots(a, b) == x @ y.T).all() and (bit_clusters.norms(a) == (x * x).sum(axis=1)).all()
        k = r.integers(0, 3, 30)
        assert (bit_clusters.sums(a, k, 3) == np.stack([x[k == c].sum(axis=0) for c in range(3)])).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bad = spark.createDataFrame([_row(1, None, None), _row(2, [math.nan] * 64, 1), _row(None, [], 1)], SCHEMA)
    for df in (none, bad):
        codes, clusters = vector_codes.compress(df), bit_clusters.cluster(df)
        assert codes.count() == clusters.count() == 0
        assert codes.columns[-2:] == ["label_error", "codebooks"] and clusters.columns[-1] == "centroid"
    assert vector_codes.compress(spark.createDataFrame([_row(1, [1.0] * 63, 1)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(none, entries=257)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_bit_clusters"])
def test_matches_sql(spark, sf_dir, name):
    pytest.importorskip("duckdb")
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name]) is None

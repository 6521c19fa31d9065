"""Vector codes and whitening against brute force, with odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import bidiagonal, vector_codes, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, entry int, x string, n double, w string, code int, position string"


def table(spark, rows):
    """(vec_id, vector, label) rows with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, "x", 0.5, None, 7, "p") for r in rows], SCHEMA)


def odd(n=300, dim=32, seed=3):
    g = np.random.default_rng(seed)
    x = g.normal(0, 0.4, (n, dim)).astype(np.float32)
    x[40:150] = x[40]  # one vector in a third of the rows
    rows = [(i * 3, x[i].tolist(), int(i % 4) if i % 7 else None) for i in range(n)]
    bad = x[0].tolist()
    rows += [
        (1, None, 1), (2, [], 1), (4, [None, *bad[1:]], 1), (5, [NAN, *bad[1:]], 1), (7, [INF, *bad[1:]], 1), (8, [-INF, *bad[1:]], 1),
        (9, rows[3][1], rows[3][2]), (None, bad, 2), (None, bad, None),
    ]
    return rows


def good(rows, dim=32):
    return [r for r in rows if r[1] and len(r[1]) == dim and None not in r[1] and np.isfinite(r[1]).all()]


def lloyd(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd over all parts, with whole numbers."""
    rows = sorted(good(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32)).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[at[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    at, d = assign()
    return [(r[0], r[2], bytes(a.tolist()).hex(), int(e)) for r, a, e in zip(rows, at, d.sum(1))], books


def key(r):
    return tuple((v is None, v or 0) for v in r)


def test_codes_equal_plain_lloyd_and_salting_changes_nothing(spark):
    rows = odd()
    want, books = lloyd(rows)
    vectors, dim = vector_codes.prepared(table(spark, rows), "vec_id", "embedding", "label")
    for owner_rows in (4096, 20):
        assert (vector_codes.fit(vectors, dim, owner_rows=owner_rows) == books).all()
    coded = vector_codes.encode(vectors, books)
    assert sorted([tuple(r) for r in coded.collect()], key=key) == sorted(want, key=key)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    got = {(r["label"], r["label_error"]) for r in vector_codes.label_errors(coded).collect()}
    assert got == set(sums.items())


def test_more_rounds_move_only_changed_members(spark):
    rows = odd(seed=5)
    _, want = lloyd(rows, rounds=4)
    vectors, dim = vector_codes.prepared(table(spark, rows), "vec_id", "embedding", "label")
    assert (vector_codes.fit(vectors, dim, rounds=4) == want).all()
    books = vector_codes.first_entries(vectors, dim, 16, 64)
    members = vector_codes.placed_parts(vectors, books, 2)
    assert vector_codes.compared(members, books).where("moved").count() == 0
    moved = vector_codes.compared(members, vector_codes.updated(members, books))
    assert 0 < moved.where("moved").count() < moved.count() / 2


def test_decoded_vectors_are_within_the_error(spark):
    coded, books = vector_codes.compress(table(spark, odd()))
    rows = {r["vec_id"]: r for r in vector_codes.decoded(coded, books).collect()}
    for i, v, _ in good(odd())[:20]:
        r = rows[i]
        assert r["error"] == int(((np.floor(256 * np.array(v, np.float32)) - 256 * np.array(r["vector"])) ** 2).sum().round())


def test_codes_of_few_no_and_unequal_vectors(spark):
    few = odd()[:5]
    coded, books = vector_codes.compress(table(spark, few))
    assert books.shape[1] == 5 and coded.count() == 5 and coded.agg(F.sum("error").alias("e")).first().e == 0  # each is an entry of its own
    for rows in ([], [(1, None, None), (2, [], 3)]):
        coded, books = vector_codes.compress(table(spark, rows))
        out = vector_codes.label_errors(coded)
        assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert vector_codes.books_sha256(np.zeros((16, 0, 1), np.int64)) == hashlib.sha256(b"").hexdigest()
    assert vector_codes.compress(table(spark, [*few, (99, [0.5] * 16, 1)]))[0].count() == 5  # another length
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0, 2.0], 1)]))


def test_far_components_keep_exact_order():
    x = np.array([[1 << 26, 0], [-(1 << 26), 1]], np.int64)
    at, d = vector_codes.nearest(x, np.array([[(1 << 26) - 1, 0], [1 << 26, 1], [-(1 << 26), 3]], np.int64))
    assert at.tolist() == [0, 2] and d.tolist() == [1, 4]


def whitened(rows, most=8):
    rows = good(rows)
    x = np.floor(1024 * np.array([r[1] for r in rows], float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [r[0] for r in rows], ((n * x - s) ** 2).sum(1), c @ u / np.sqrt(e), e / np.trace(v)


def test_whitened_rows_equal_a_dense_solver(spark, monkeypatch):
    rows = odd()
    ids, dev, want, share = whitened(rows)
    monkeypatch.setattr(whitening, "FAN", 2)  # several levels of merging
    out = whitening.components(table(spark, rows).repartition(7)).collect()
    assert len(out) == 8 * len(ids)
    assert {r["n"] for r in out} == {len(ids)} and {r["identity_error"] for r in out}.pop() < 1e-10
    assert sorted((r["vec_id"] or -1, r["deviation"]) for r in out if r["component"] == 1) == sorted((i or -1, int(d)) for i, d in zip(ids, dev))
    for k in range(8):
        mine = {}
        for r in out:
            if r["component"] == k + 1:
                mine.setdefault(r["vec_id"], r["whitened"])
                assert abs(r["explained"] / share[k] - 1) < 1e-9
        a, b = np.array([mine[i] for i in ids]), want[:, k]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_of_few_equal_and_no_rows(spark):
    v = [0.1, 0.2, 0.3]
    for rows in ([], [(1, None, 1)], [(1, v, 1)], [(1, v, 1), (2, v, 1)]):
        out = whitening.components(table(spark, rows))
        assert out.collect() == []
    two = whitening.components(table(spark, [(1, v, 1), (2, [0.5, 0.2, 0.3], 1)])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 26, 5], [3, 5]], np.int64)
    got = whitening.deviations(x, 1 << 20, np.array([0, 5 << 20], np.int64)).to_pylist()
    assert got == [None, (3 << 20) ** 2]


def matrices():
    g = np.random.default_rng(1)
    q, p = np.linalg.qr(g.normal(size=(60, 20)))[0], np.linalg.qr(g.normal(size=(20, 20)))[0]
    yield g.normal(size=(50, 20))
    yield g.normal(size=(4, 20))
    yield np.repeat(g.normal(size=(2, 20)), 9, 0)
    yield g.normal(size=(50, 20)) * (np.arange(20) % 5 > 0)
    for s in ([3.0] * 5 + [2.0] * 5 + [1.0] * 10, [2 + 1e-12 * i for i in range(20)], 10.0 ** -np.arange(20), [1.0] * 20):
        yield q @ np.diag(s) @ p.T
    yield np.diag([1.0] * 3 + [0.0] * 3)
    yield np.zeros((3, 3))


@pytest.mark.parametrize("a", list(matrices()))
def test_qd_values_and_vectors(a):
    r = whitening._square(np.linalg.qr(a, mode="r"), a.shape[1])
    values, lead, v = bidiagonal.right_singular(r, 8)
    s = np.linalg.svd(r, compute_uv=False)
    assert np.abs(np.sqrt(values) - s).max() <= 1e-13 * max(s[0], 1)
    assert np.abs(r.T @ (r @ v) - v * lead).max(initial=0) <= 1e-12 * max(s[0] ** 2, 1)
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max(initial=0) <= 1e-12

"""Whitening and vector codes against plain numpy and Python integers, and their edge cases."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from feedloom.llm import codes, whitening
from feedloom.llm.codes import compress, distances, exact_products, nearest
from feedloom.llm.vectors import stored_vectors
from feedloom.llm.whitening import Centre, jacobi, pivoted_cholesky, principal, whiten

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def usable(rows):
    return [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]


# ---- codes


def expected_codes(rows, parts=8, entries=16, rounds=6):
    """The contract in Python integers."""
    rows = usable(rows)
    width = -(-len(rows[0][1]) // parts)
    cut = [[[math.floor(4096 * float(c)) for c in r[1]][p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    cut = [[p + [0] * (width - len(p)) for p in r] for r in cut]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, cut[i]))
    books = [[list(cut[i][p]) for i in order[:entries]] for p in range(parts)]

    def assign(part, book):
        found = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return min(range(len(book)), key=lambda e: (found[e], e)), min(found)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for r in cut:
                members.setdefault(assign(r[p], books[p])[0], []).append(r[p])
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for r, own in zip(rows, cut):
        found = [assign(own[p], books[p]) for p in range(parts)]
        out.append([r[0], "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), r[2]])
        by_label[r[2]] = by_label.get(r[2], 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=repr)


def coded(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_codes_equal_python_integers(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").limit(120).collect()]
    odd = [(7000, None, 1), (7001, [None] + [0.1] * 63, 1), (7002, [NAN] + [0.1] * 63, 2), (7003, [-INF] + [0.1] * 63, 2), (None, [0.25] * 64, None), (7004, [0.25] * 64, None), (7004, [0.25] * 64, None), (7005, [], 3), (7006, [0.0] * 63, 3)]
    frame = spark.createDataFrame(rows + odd, KIND).selectExpr("*", "1 AS x", "2 AS code", "3 AS error").repartition(5)
    assert coded(compress(frame)) == expected_codes(rows + odd[:-1])


def test_codes_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = entry.queries()["op13_vector_codes"](spark, SF)
    want = con.execute(entry.oracle_sql()["op13_vector_codes"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_products_of_limbs_are_exact():
    draw = np.random.default_rng(3)
    for bits, width in ((3, 8), (13, 8), (26, 8), (28, 64), (28, 1)):
        x, c = (draw.integers(-(1 << bits), 1 << bits, (40, width)) for _ in range(2))
        x[0], c[0] = -(1 << bits), (1 << bits) - 1
        want = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in c] for u in x]
        assert exact_products(x, c).tolist() == want
        assert distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
    huge = np.array([[1 << 61, -(1 << 61)]]), np.array([[-(1 << 61), 1 << 61], [0, 0]])
    assert distances(*huge).tolist() == [[2 * (1 << 62) ** 2, 2 * (1 << 61) ** 2]]


def test_codes_ties_large_entries_and_few_rows(spark):
    books = np.array([[[0], [2], [2]]])
    assert nearest(np.array([[1], [2], [3]]), books)[0].tolist() == [[0], [1], [1]]
    for rows in ([(1, [3.0e9, -3.0e9] * 4, 1), (2, [1.0e9, 5.5] * 4, 1), (3, [0.5] * 8, None)], [(5, [0.1, 0.2, 0.3], 1)], [(1, [0.5] * 16, 1)] * 40):
        assert coded(compress(spark.createDataFrame(rows, KIND))) == expected_codes(rows)
    assert compress(spark.createDataFrame([(1, None, 1), (2, [], 1)], KIND)).collect() == []
    empty = compress(spark.createDataFrame([], KIND))
    assert empty.collect() == [] and empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    beyond = compress(spark.createDataFrame([(i, [3e38 if i else -3e38] * 8, 1) for i in range(2)] + [(9, [1e38, -1e38] * 4, 1)], KIND), rounds=1).collect()
    assert len(beyond) == 3
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([], KIND), entries=257)


def test_codes_do_not_depend_on_partitions(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert coded(compress(frame.repartition(1))) == coded(compress(frame.repartition(13)))


# ---- whitening


def expected_whitening(rows, k=16):
    rows = usable(rows)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in r[1]] for r in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = np.array([[(n * v - s) / n for v, s in zip(row, total)] for row in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    keep = values > 1e-9 * max(values[0], 1e-300)
    values, vectors = values[keep], vectors[:, keep]
    own = np.array([[(n * v - s) / n for v, s in zip(row, total)] for row in x])
    trace = (centred * centred).sum() / n
    return n, [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x], own @ vectors / np.sqrt(values), values / trace


def check_whitening(frame, rows):
    got = frame.orderBy("vec_id", "component").collect()
    kept = sorted(usable(rows), key=lambda r: r[0])
    n, deviation, white, explained = expected_whitening(kept)
    k = len(explained)
    assert len(got) == len(kept) * k
    table = np.array([r.whitened for r in got]).reshape(len(kept), k)
    assert [r.vec_id for r in got] == [r[0] for r in kept for _ in range(k)] and [r.component for r in got] == list(range(1, k + 1)) * len(kept)
    assert {r.n for r in got} == {n} and [r.deviation for r in got[::k]] == deviation
    assert np.allclose(table * np.sign((table * white).sum(axis=0)), white, atol=1e-8)
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_whitening_equals_eigenvectors(spark):
    """The whole table through the registered query, against numpy over exact integers."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(entry.queries()["op11_embedding_whitening"](spark, SF), rows)


def test_whitening_counts_equal_vectors_once(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(c) for c in draw.normal(size=5) * [4, 3, 2, 1, 0.5]], 1) for i in range(60)]
    rows += [(100 + i, rows[3][1], None) for i in range(30)]
    odd = [(200, None, 1), (201, [None, 1.0, 1.0, 1.0, 1.0], 1), (202, [INF, 1.0, 1.0, 1.0, 1.0], 1), (203, [NAN] * 5, 1), (204, [], 1), (205, [1.0], 1)]
    frame = spark.createDataFrame(rows + odd, KIND).selectExpr("*", "1 AS x", "2 AS n", "3 AS component").repartition(7)
    check_whitening(whiten(frame), rows)


def test_whitening_of_low_rank_large_entries_and_nothing(spark):
    draw = np.random.default_rng(2)
    flat = [(i, [float(a), float(2 * a), 0.5, float(b)], 1) for i, (a, b) in enumerate(draw.integers(-50, 50, (40, 2)))]
    check_whitening(whiten(spark.createDataFrame(flat, KIND)), flat)
    wide = [(i, [float(c) for c in draw.normal(size=20) * 1e4], 1) for i in range(50)]
    wide = [(i, [float(np.float32(c)) for c in v], label) for i, v, label in wide]
    check_whitening(whiten(spark.createDataFrame(wide, KIND)), wide)
    twice = whiten(spark.createDataFrame([(None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (1, [3.0, 1.0], 1)], KIND)).collect()
    assert len(twice) == 3 and sum(r.vec_id is None for r in twice) == 2 and {r.n for r in twice} == {2}
    for rows in ([], [(1, None, 1)], [(1, [0.5, 0.5], 1)] * 3):
        none = whiten(spark.createDataFrame(rows, KIND))
        assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_factor_and_rotation():
    draw = np.random.default_rng(4)
    for d, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (33, 33)):
        b = draw.normal(size=(d, rank)) * 10.0 ** draw.uniform(-4, 2, rank)
        v = b @ b.T
        factor, order = pivoted_cholesky(v)
        assert factor.shape[1] <= rank and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-10 * v.max())
        assert np.allclose(np.triu(factor[: factor.shape[1]], 1), 0)
        turned = jacobi(factor)
        gram = turned.T @ turned
        size = np.sqrt(np.diag(gram))
        assert np.allclose(gram / np.outer(size, size), np.eye(len(gram)), atol=1e-12)
        values, columns = principal(v, 3)
        assert np.allclose(v @ columns, columns * values, atol=1e-9 * v.max()) and np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], rtol=1e-6)
    assert principal(np.zeros((3, 3)))[1].shape == (3, 0)


def test_deviation_is_exact_beyond_long():
    small = Centre(3, (7, -2))
    x = np.array([[5, 1], [-4, 0]])
    assert small.deviation(x).tolist() == [(15 - 7) ** 2 + 5**2, (-12 - 7) ** 2 + 2**2]
    large = Centre(1 << 40, (1, 1))
    assert large.deviation(np.array([[1 << 30, 0]]))[0] == ((1 << 70) - 1) ** 2 + 1
    assert whitening.longs(large.deviation(np.array([[1 << 30, 0]]))).to_pylist() == [None]


def test_dimensions_are_the_commonest_length(spark):
    rows = [(1, [1.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (4, [], 1), (5, None, 1)]
    kept, d = stored_vectors(spark.createDataFrame(rows, KIND), codes.SCALE, 0, "embedding", "vectors", vec_id="vec_id")
    assert d == 2 and sorted(r.vec_id for r in kept.collect()) == [2, 3]

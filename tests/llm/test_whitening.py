import numpy as np
import pytest

from docscore.llm import whitening


def brute(rows, count=16):
    """Whitening of the rows by numpy's eigensolver: rows of (vec_id, deviation, whitened, explained)."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    apart = {v: [n * a - s for a, s in zip(v, sums)] for v in fit}
    rows_ = np.array([[float(a) for a in apart[v]] for v in fit]) / n
    cov = rows_.T @ rows_ / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    out = []
    for i, v in x:
        white = (np.array([float(a) for a in apart[tuple(v)]]) / n) @ vectors
        out.append((i, n, sum(a * a for a in apart[tuple(v)]), white, values, np.trace(cov)))
    return out, values


def held(spark, rows, kind="array<float>"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    got = whitening.whiten(frame).collect()
    want, values = brute([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    assert len(got) == len(want)
    kept = int((values > 1e-10 * values.sum()).sum())
    got.sort(key=lambda r: (repr(r["vec_id"]), r["deviation"], [round(abs(c), 5) for c in r["whitened"]]))
    want.sort(key=lambda r: (repr(r[0]), r[2]))
    signs = None
    for g, (i, n, deviation, white, values, trace) in zip(got, want, strict=True):
        assert (g["vec_id"], g["n"], g["deviation"]) == (i, n, deviation)
        assert len(g["whitened"]) == kept
        assert np.allclose(g["explained"], values[:kept] / trace, rtol=1e-9)
        assert g["identity_error"] < 1e-9
        scaled = white[:kept] / np.sqrt(values[:kept])
        now = np.sign(np.array(g["whitened"]) * scaled)
        signs = now if signs is None else signs
        assert np.allclose(np.abs(g["whitened"]), np.abs(scaled), rtol=1e-6, atol=1e-8)
        assert ((now == signs) | (np.abs(scaled) < 1e-8)).all()
    return got


def test_tables_match_the_dense_solver(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    held(spark, [tuple(r) for r in table.collect()])


def test_query_has_a_row_per_component(spark):
    found = whitening.query(spark, "/root/testdata/sf0.001")
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(found.dtypes) | {"component": "int", "n": "bigint", "deviation": "bigint"} == dict(found.dtypes)
    assert found.count() == 16 * 500


def test_nulls_repeats_ties_and_low_rank(spark):
    rng = np.random.default_rng(3)
    flat = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 20)) * 1000
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(flat)]
    # on the grid the low rank is only rough; the copies count once in the fit
    odd = [(None, rows[0][1]), (0, rows[0][1]), (1, None), (2, [None] * 20), (3, [float("nan")] * 20), (4, [float("inf")] + [0.0] * 19), (5, [])]
    held(spark, rows + odd + [(7, rows[7][1])] * 30, "array<double>")


def test_fewer_vectors_than_components(spark):
    rows = [(i, [float((i == j) * (i + 1)) for j in range(6)]) for i in range(4)]
    assert {len(r["whitened"]) for r in held(spark, rows)} == {3}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_variance(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string")).collect()
    assert [(r["vec_id"], r["deviation"], r["whitened"]) for r in sorted(got)] == [(i, 0, []) for i, v in rows if v]


def test_different_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(2**50 * i), float(i * i), 3.5]) for i in range(12)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((12 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    assert got == {i: w if w < 10**38 else None for i, w in enumerate(want)}


@pytest.mark.parametrize("kind", ["flat", "decaying", "multiple", "low"])
def test_restarts_and_breakdowns(kind):
    """Wide matrices, so that the basis is restarted; repeated and zero eigenvalues, so that blocks break down."""
    rng = np.random.default_rng(1)
    width = 300
    values = {"flat": 1 + rng.random(width), "decaying": 0.9 ** np.arange(width), "multiple": np.repeat([9.0, 4.0, 1.0], 100), "low": np.r_[np.arange(5.0, 0, -1), np.zeros(width - 5)]}[kind]
    turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
    matrix = (turn * values) @ turn.T
    found, vectors = whitening.block_lanczos(lambda block: matrix @ block, width, 8, extra=4, blocks=4)
    assert np.allclose(found, np.sort(values)[::-1][:8], rtol=1e-11, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * values.max()

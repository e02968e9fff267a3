"""Whitening against a dense eigendecomposition: rank-one updates with ties, merged spectra, odd vectors, tables without rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from launchlens.llm import whitening as w
from launchlens.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates(seed):
    draw = np.random.default_rng(seed)
    for case in range(60):
        m = int(draw.integers(1, 12))
        values = np.sort(draw.choice([0, 1, 1, 2, 5, 5 + 1e-14, 1e-9, 1e6], m).astype(float)) if case % 2 else np.sort(draw.random(m) * 10.0 ** draw.integers(-8, 8))
        basis = np.linalg.qr(draw.standard_normal((m, m)))[0]
        vector = draw.standard_normal(m) * 10.0 ** draw.integers(-6, 6) if case % 3 else basis[:, 0] * 3 + basis[:, -1] * (m > 2)
        after, turned = w.rank_one(values, basis, vector)
        want = (basis * values) @ basis.T + np.outer(vector, vector)
        assert np.abs((turned * after) @ turned.T - want).max() <= 1e-12 * np.abs(want).max()
        assert np.abs(turned.T @ turned - np.eye(m)).max() < 1e-12 and (np.diff(after) >= 0).all()


def test_merged_spectra_are_those_of_all_rows():
    rows = (np.random.default_rng(3).standard_normal((90, 7)) * np.arange(1, 8) * 30).astype(np.int64) + w.SHIFT
    parts = [w.Spectrum(7) for _ in range(3)]
    for part, begin, end in zip(parts, (0, 1, 30), (1, 30, 90)):
        part.add(rows[begin:end])
    whole = w.Spectrum.unpacked(parts[0].join(parts[1]).packed()).join(parts[2]).join(w.Spectrum(7))
    assert whole.n == 90 and whole.sums == rows.sum(0).tolist()
    assert np.allclose(whole.values / 90, np.linalg.eigvalsh(np.cov(rows.T, bias=True)), rtol=1e-12)


def by_hand(rows):
    """vec_id, deviation and projections of every usable row; eigenvalues and trace."""
    good = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), object)
    n, sums = len(fit), fit.sum(0)
    off = (fit * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    keep = [i for i in np.argsort(-values)[:16] if values[i] > 1e-13 * values.sum()]
    found = [(i, int(sum((n * a - s) ** 2 for a, s in zip(x, sums))), ((np.array(x, object) * n - sums).astype(float) / n) @ vectors[:, keep] / np.sqrt(values[keep])) for i, x in good]
    return n, found, values[keep] / values.sum()


def matches(df, rows):
    n, want, explained = by_hand(rows)
    got = {}
    for r in df.collect():
        got.setdefault((r["vec_id"], r["deviation"]), []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-9 and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    assert sorted((str(k), k[1]) for k, v in got.items() for _ in range(len(v) // len(explained))) == sorted((str((i, d)), d) for i, d, _ in want)
    signs = {}
    for i, d, on in want:
        for r in got[(i, d)]:
            value = on[r["component"] - 1]
            assert abs(abs(r["whitened"]) - abs(value)) < 1e-8
            if abs(value) > 1e-6:
                signs.setdefault(r["component"], set()).add(np.sign(r["whitened"] * value))
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def odd(n, width):
    draw = np.random.default_rng(n)
    rows = [(i, (draw.standard_normal(width) * np.arange(1, width + 1) / 3).tolist()) for i in range(n)]
    rows += [(7, rows[0][1])] * n + [(None, rows[1][1]), (1, None), (2, []), (3, [None] * width), (4, [float("nan")] * width), (5, [float("inf")] + [0.0] * (width - 1)), (106, [1e30] + [0.0] * (width - 1))]
    return rows


def test_odd_vectors(frame):
    rows = odd(40, 5)
    docs = frame(rows + [(9, [1.0, 2.0])], VECTORS).withColumns({"x": F.lit("x"), "width": F.lit(1), "n": F.lit(2)})
    rounded = w.whole_numbers(docs.select("vec_id", "embedding"))
    matches(w.whitened(rounded, w.fitted(rounded)), [r for r in rows if r[0] != 106])


def test_fewer_dimensions_than_components_and_constant_ones(frame):
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(30)]
    rounded = w.whole_numbers(frame(rows, VECTORS))
    df = w.whitened(rounded, w.fitted(rounded))
    assert df.agg(F.max("component")).first()[0] == 2
    matches(df, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(frame, rows):
    rounded = w.whole_numbers(frame(rows, VECTORS))
    assert w.whitened(rounded, w.fitted(rounded)).collect() == []


def test_rounds_of_merging(frame, monkeypatch):
    monkeypatch.setattr(w, "FAN_IN", 2)
    monkeypatch.setattr(w, "TASK_ROWS", 9)
    rounded = w.whole_numbers(frame(odd(60, 4)[:60], VECTORS))
    matches(w.whitened(rounded, w.fitted(rounded)), odd(60, 4)[:60])


def test_deviation_is_exact_or_null():
    model = object.__new__(w.Whitening)
    model.n, model.width, model.sums = 10 ** 9, 2, [3 * 10 ** 18, 7]
    model.whole, model.rest = zip(*(divmod(s, model.n) for s in model.sums), strict=True)
    rows = np.array([[3 * 10 ** 9, 0], [3 * 10 ** 9 + 1, 0], [3 * 10 ** 9 + 4, 1]], np.int64)
    assert model.deviation(rows) == [49, 10 ** 18 + 49, None]


def test_query_against_dense_decomposition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").select("vec_id", "embedding").collect()]
    matches(QUERIES["op11_embedding_whitening"](spark, ROOT), rows)

"""Whitening by bidiagonalisation, against a dense eigensolver."""

import numpy as np
import pytest

from leafwork.llm import whitening

from .conftest import collected


def plain(vectors, count=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    good = values[:count] > 1e-12 * max(values.sum(), 1e-300)
    values, axes, total = values[:count][good], axes[:, :count][:, good], values.sum()
    apart = [sum(int(d) ** 2 for d in row) for row in n * x.astype(object) - sums]
    return n, apart, (x - sums / n) @ axes / np.sqrt(values), values / total


def whitened(ready, rows, **options):
    frame = ready.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, n int, component string")
    found = collected(whitening.whiten_vectors(frame.repartition(3), **options))
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    return by_id


def agree(by_id, ids, vectors, count=4, close=1e-9, signs=True):
    n, apart, z, explained = plain(vectors, count)
    for k in range(z.shape[1]):
        got = np.array([by_id[i][k + 1][0]["whitened"] for i in ids])
        if signs:
            assert np.abs(z[:, k] * np.sign(z[:, k] @ got) - got).max() < close
        assert by_id[ids[0]][k + 1][0]["explained"] == pytest.approx(explained[k], rel=1e-9)
    for i, a in zip(ids, apart, strict=True):
        assert set(by_id[i]) == set(range(1, z.shape[1] + 1))
        for (row, *_) in by_id[i].values():
            assert row["deviation"] == a and row["n"] == n and row["identity_error"] < 1e-8


def test_vectors_with_copies(ready):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 12)) * np.linspace(3, 0.3, 12) + 5
    x[200:] = x[0]  # a third are copies, which weigh nothing
    by_id = whitened(ready, [(i, v.tolist()) for i, v in enumerate(x)])
    agree(by_id, list(range(300)), x)


def test_bad_vectors_and_lengths(ready):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(40, 6)), r.normal(size=(30, 3))
    bad = [None, [None] * 6, [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [1.0, None, 0.0], []]
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(100 + i, v.tolist()) for i, v in enumerate(b)]
    rows += [(200 + i, v) for i, v in enumerate(bad)] + [(None, a[3].tolist()), (5, a[5].tolist())]
    by_id = whitened(ready, rows)
    assert set(by_id) == {*range(40), *range(100, 130), None}
    agree(by_id, list(range(40)), a)
    agree(by_id, list(range(100, 130)), b)
    assert [len(v) for v in by_id[5].values()] == [2] * 4 and by_id[None][1][0]["whitened"] == by_id[3][1][0]["whitened"]


def test_few_dimensions_and_little_rank(ready):
    r = np.random.default_rng(4)
    plane = np.round(r.normal(size=(50, 2)) * 8) @ np.array([[1.0, 2, 0, -1, 0, 3], [0.0, 1, 1, 1, -2, 0]])
    by_id = whitened(ready, [(i, v.tolist()) for i, v in enumerate(plane)])
    agree(by_id, list(range(50)), plane)
    line = [[float(i)] for i in range(9)]
    agree(whitened(ready, list(enumerate(line))), list(range(9)), line)


def test_equal_variances(ready):
    """Tied axes are not unique, but whiten all the same."""
    x = np.concatenate([np.eye(8) * 4, -np.eye(8) * 4, np.eye(8)[:1] * 9])
    by_id = whitened(ready, [(i, v.tolist()) for i, v in enumerate(x)])
    agree(by_id, list(range(len(x))), x, signs=False)
    z = np.array([[by_id[i][k][0]["whitened"] for k in range(1, 5)] for i in range(len(x))])
    assert np.abs(z.T @ z / len(x) - np.eye(4)).max() < 1e-9 and np.abs(z.mean(axis=0)).max() < 1e-9


def test_one_vector_and_none(ready):
    assert whitened(ready, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == {}
    assert whitened(ready, []) == {}


def test_large_numbers_stay_exact(ready):
    x = [[1e9, 3.0], [-1e9, 7.5], [12345.678, 1e9], [0.0, 0.0]]
    agree(whitened(ready, list(enumerate(x)), count=2), list(range(4)), x, count=2)


def test_early_stop(ready, monkeypatch):
    """A falling spectrum needs far fewer passes than dimensions."""
    calls = []
    product = whitening._product
    monkeypatch.setattr(whitening, "_product", lambda *a: calls.append(1) or product(*a))
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 60)) * 0.01 + (r.normal(size=(200, 5)) * [90, 50, 30, 20, 10]) @ r.normal(size=(5, 60))
    by_id = whitened(ready, [(i, v.tolist()) for i, v in enumerate(x)])
    agree(by_id, list(range(200)), x, close=1e-7)
    assert len(calls) < 40

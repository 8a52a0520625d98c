"""Near copies of vectors against all pairs."""

import numpy as np
import pytest

from tidewatch.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n long, comp long, key string"


def plain(rows):
    unit = []
    for _, v in rows:
        x = np.array([float("nan") if c is None else c for c in v or [0.0]], float)
        unit.append(x / np.sqrt((x * x).sum()) if np.isfinite(x).all() and (x != 0).any() else None)
    links = [[j for j, y in enumerate(unit) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.95] for i, x in enumerate(unit)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(links[i]), least, vec_id is not None and vec_id == least))
    return sorted(out, key=repr)


def found(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, 2, 3, "k") for i, v in rows], SCHEMA)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_copies(frame).collect()), key=repr)


def planted(seed, single, groups, size, noise, dim=16):
    rng = np.random.default_rng(seed)
    vectors = [*rng.standard_normal((single, dim))]
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        vectors += [centre * rng.uniform(0.5, 2) + noise * rng.standard_normal(dim) for _ in range(size)]
    order = rng.permutation(len(vectors))
    return [(int(i), [float(np.float32(c)) for c in vectors[k]]) for i, k in enumerate(order)]


@pytest.mark.parametrize("window, tile, size", [(128, 1024, 12), (8, 16, 60)])
def test_near_copies_against_all_pairs(spark, monkeypatch, window, tile, size):
    monkeypatch.setattr(embedding_dedup.candidate_links, "__defaults__", (0.95, 0.999, window))
    monkeypatch.setattr(embedding_dedup.link_counts, "__defaults__", (0.95, tile))
    rows = planted(1, 300, 6, size, 0.12)
    assert found(spark, rows) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [100.0, 1.0]), (1, None), (2, []), (4, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (11, [-1.0, 0.0]), (None, [0.0, 1.0]), (12, [1e30, 0.0]), (13, [0.0, -1.0]), (13, None)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_many_equal_vectors_are_one(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(1000 + i, [1.0, 2.0, 3.01]) for i in range(3)]
    assert found(spark, rows) == sorted(((i, 502, 0, i == 0) for i, _ in rows), key=repr)


def test_passes_grow_slowly():
    assert embedding_dedup.passes_for(10**4) < embedding_dedup.passes_for(10**7) < 80 and embedding_dedup.passes_for(10**12) < 500

import math

import numpy as np
import pytest

from webloom.llm.embeddings import collision, embedding_near_dup, plan, vector_pairs

SCHEMA = "vec_id long, embedding array<float>, label int, cosine double"


def brute(rows, threshold):
    """(rows, pairs): (vec_id, class_id, copies, links) of each vector, and the pairs of different vectors by their smallest vec_ids."""
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.linalg.norm(v) > 0]
    entries = sorted({(i, tuple(np.round(v / np.linalg.norm(v), 9))) for i, v in ok})
    names = {}
    for i, v in entries:
        names.setdefault(v, i)
    near = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    group, linked = list(range(len(entries))), [[a == b or near(a, b) for _, b in entries] for _, a in entries]

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, (i, _) in enumerate(entries):
        for m, (j, _) in enumerate(entries):
            if (linked[k][m] or i == j) and find(k) != find(m):
                x, y = sorted((find(k), find(m)))
                group[y] = x
    pairs = {(min(names[a], names[b]), max(names[a], names[b])) for k, (_, a) in enumerate(entries) for m, (_, b) in enumerate(entries) if linked[k][m] and names[a] != names[b]}
    return sorted((i, entries[find(k)][0], sum(a == b for _, b in entries), sum(linked[k]) - 1) for k, (i, a) in enumerate(entries)), pairs


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.0) for r in rows], SCHEMA)


def test_recall_against_brute_force(spark):
    rng, rows = np.random.default_rng(3), []
    for _ in range(60):
        base = rng.standard_normal(32)
        for _ in range(6):
            rows.append((len(rows), (base + rng.uniform(0.05, 0.5) * rng.standard_normal(32)).tolist()))
    rows += [(len(rows) + k, [2 * x for x in rows[0][1]]) for k in range(5)]
    want, pairs = brute(rows, 0.9)
    found = [tuple(r) for r in vector_pairs(frame(spark, rows), threshold=0.9).collect()]
    assert len(found) == len(set(found)) and set(found) <= pairs and len(pairs) > 300
    assert len(found) >= 0.97 * len(pairs)
    got = sorted(map(tuple, embedding_near_dup(frame(spark, rows), threshold=0.9).collect()))
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[3] <= w[3] for g, w in zip(got, want))
    assert sum(g[3] for g in got) >= 0.97 * sum(w[3] for w in want)


def test_near_vectors_are_found_exactly(spark):
    """Far beyond the threshold the tables miss nothing, so rows equal brute force; classes of any size are cut into blocks."""
    rng, rows = np.random.default_rng(5), []
    for size in (700, 3, 2, 1, 1):
        base = rng.standard_normal(24)
        rows += [(len(rows) + k, (base + 0.02 * rng.standard_normal(24)).tolist()) for k in range(size)]
    rows += [(3, rows[703][1]), (900, rows[0][1]), (900, rows[0][1])]
    assert sorted(map(tuple, embedding_near_dup(frame(spark, rows), threshold=0.9).collect())) == brute(rows, 0.9)[0]


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, []), (5, None), (6, [math.nan, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [math.inf, 1.0]), (10, [1.0, 0.001]), (11, [-0.0, -1.0]), (12, [0.0, -2.0])]
    got = sorted(map(tuple, embedding_near_dup(frame(spark, rows), threshold=0.9).collect()))
    assert got == [(1, 1, 2, 2), (2, 1, 2, 2), (8, 8, 1, 0), (10, 1, 1, 2), (11, 11, 2, 1), (12, 11, 2, 1)] == brute(rows, 0.9)[0]


def test_empty_table(spark):
    assert embedding_near_dup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_meets_its_recall():
    rng = np.random.default_rng(0)
    for c in (0.3, 1.0):
        a, b = rng.standard_normal(200_000), rng.uniform(0, 1.6, 200_000)
        assert abs((np.floor(b / 1.6) == np.floor((a * c + b) / 1.6)).mean() - collision(c, 1.6)) < 0.01
    for n in (10, 10**5, 10**9):
        m, tables = plan(n, 0.9, 0.99, 1.6)
        assert 1 - (1 - collision(math.sqrt(0.2), 1.6) ** m) ** tables >= 0.99
    with pytest.raises(ValueError):
        embedding_near_dup(None, threshold=2)

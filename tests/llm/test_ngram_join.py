import random

import pytest

from tests.llm.data import DOCS, awkward, rows, words
from webloom.llm._links import components
from webloom.llm.ngram_join import document_pairs, keep_one, ngram_jaccard_join


def grams(text, n):
    w = [x for x in __import__("re").split(r"[ \t\n\v\f\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n, threshold):
    sets = [(i, grams(t, n)) for i, t in docs if i is not None]
    out = set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                out.add((min(i, j), max(i, j), round(len(a & b) / len(a | b), 9)))
    return out


def brute_rows(docs, n, threshold):
    """(doc_id, class_id, copies, links): a row for each doc_id and set."""
    entries = sorted({(i, frozenset(grams(t, n))) for i, t in docs if i is not None}, key=lambda e: e[0])
    near = lambda a, b: a and b and len(a & b) >= threshold * len(a | b) - 1e-9
    group = list(range(len(entries)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    linked = [[near(a, b) for _, b in entries] for _, a in entries]
    for k, (i, _) in enumerate(entries):
        for m, (j, _) in enumerate(entries):
            if (linked[k][m] or i == j and entries[k][1] and entries[m][1]) and find(k) != find(m):
                x, y = sorted((find(k), find(m)))
                group[y] = x
    return sorted((i, entries[find(k)][0], sum(a == b for _, b in entries) if a else 1, sum(map(bool, linked[k])) - bool(a)) for k, (i, a) in enumerate(entries))


def edited(text, rng, share):
    return " ".join(w if rng.random() > share else "edit%d" % rng.randint(0, 10**6) for w in text.split())


@pytest.mark.parametrize(("n", "threshold"), [(5, 0.4), (3, 0.7), (1, 0.5)])
def test_all_pairs_match_brute_force(spark, n, threshold):
    rng, texts = random.Random(n), []
    for i in range(12):
        base = words(rng.choice([3, 8, 40, 120]), 100 + i)
        texts += [base] * rng.randint(1, 3) + [edited(base, rng, rng.choice([0.02, 0.05, 0.1])) for _ in range(4)]
    docs = [(i, t, *r) for (i, t), r in zip(enumerate(texts), [x[2:] for x in rows(enumerate(texts))])]
    df = spark.createDataFrame(docs, DOCS)
    got = document_pairs(df, n, threshold).collect()
    assert sorted(map(tuple, got)) == sorted(w[:2] for w in brute([d[:2] for d in docs], n, threshold))
    assert sorted(map(tuple, ngram_jaccard_join(df, n, threshold).collect())) == brute_rows([d[:2] for d in docs], n, threshold)


def test_hot_groups_are_split_into_blocks(spark, monkeypatch):
    from webloom.llm import _links

    monkeypatch.setattr(_links, "_SIDE", 3)
    rng, base = random.Random(4), words(60, 1)
    docs = rows(enumerate([base] * 30 + [edited(base, rng, 0.04) for _ in range(25)] + [words(60, 900 + i) for i in range(20)]))
    assert sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame(docs, DOCS)).collect())) == brute_rows([d[:2] for d in docs], 5, 0.4)


def test_a_document_with_several_texts_joins_their_classes(spark):
    a, b, c = words(30, 1), words(30, 2), words(30, 3)
    docs = rows([(1, a), (6, a), (6, b), (6, b), (7, b + " x"), (8, c), (9, ""), (8, ""), (6, c + " y z"), (10, words(9, 4)), (10, words(9, 5))])
    got = sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame(docs, DOCS)).collect()))
    assert got == brute_rows([d[:2] for d in docs], 5, 0.4)
    assert {r.doc_id for r in keep_one(spark.createDataFrame(docs, DOCS)).collect()} == {1, 9, 10}


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    assert sorted(map(tuple, document_pairs(df).collect())) == sorted(w[:2] for w in brute([r[:2] for r in awkward()], 5, 0.4))
    assert sorted(map(tuple, ngram_jaccard_join(df).collect())) == brute_rows([r[:2] for r in awkward()], 5, 0.4)
    kept = keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 5, 8, 9, 11, 12, None, None]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert ngram_jaccard_join(df).count() == 0
    assert keep_one(df).count() == 0


def test_chains_become_one_group(spark):
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(40)] + [(100, 101, 0.9)], "doc_a long, doc_b long, jaccard double")
    got = {r.doc_id: r.group for r in components(pairs).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        ngram_jaccard_join(spark.createDataFrame([], DOCS), threshold=0)

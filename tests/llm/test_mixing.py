import random

import numpy as np

from tests.llm.data import DOCS, VOCABULARY, awkward, rows, words
from webloom.llm._tokens import encoding
from webloom.llm.mixing import DOMAINS, classifier, features, fit, mixed, mixing_rates, repeated, solve

LABELS = "doc_id long, quality int, toxic int"
TARGETS = {"clean": 0.8, "low": 0.15, "toxic": 0.05}


def corpus(n=400):
    rng, docs, labels = random.Random(5), [], []
    for i in range(n):
        kind = rng.choices(range(3), (6, 3, 3))[0]
        text = words(rng.randint(20, 60), i)
        text = " ".join(w + " ###" for w in text.split()) if kind == 1 else text + " villain! scoundrel," if kind == 2 else text
        docs.append((i, text))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return rows(docs), labels


def test_totals_meet_the_targets_and_held_out_domains_are_found(spark):
    docs, labels = corpus()
    got = mixing_rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:200], LABELS), TARGETS, VOCABULARY, budget=1.0).collect()
    p, t, r = np.array([[x[f"p_{d}"] for d in DOMAINS] for x in got]), np.array([x.tokens for x in got]), np.array([x.rate for x in got])
    total = (t * r) @ p / t.sum()
    assert np.abs(total - [TARGETS[d] for d in DOMAINS]).max() < 0.002
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-9 and r.min() >= 0
    truth = {i: 2 if x else 1 - q for i, q, x in labels}
    held = [x for x in got if x.doc_id >= 200]
    assert np.mean([max(range(3), key=lambda k: x[f"p_{DOMAINS[k]}"]) == truth[x.doc_id] for x in held]) > 0.95
    assert all(abs(x.copies - x.rate) < 1 for x in got)


def test_rates_solve_the_least_squares_problem(spark):
    """Against many steps of plain projected gradient, where a target can't be met."""
    docs, labels = corpus(120)
    got = mixing_rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {"clean": 1.0}, VOCABULARY, budget=1.0).collect()
    p, t, r = np.array([[x[f"p_{d}"] for d in DOMAINS] for x in got]), np.array([x.tokens for x in got], float), np.array([x.rate for x in got])
    goal, best = np.array([1.0, 0, 0]), np.ones(len(t))
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p / t.sum())[-1]
    for _ in range(20_000):
        best = np.maximum(0, best + step * p @ (goal - (t * best) @ p / t.sum()))

    def loss(x):
        return (((t * x) @ p / t.sum() - goal) ** 2).sum()

    assert loss(r) <= loss(best) + 1e-4


def kkt(tokens, mass, goal, rate):
    """The largest violation of the optimality conditions: no gradient where a rate is above 0, none downwards at 0."""
    p = mass / tokens[:, None]
    grad = p @ ((mass.T @ rate) / tokens.sum() - goal) + 1e-4 * (rate - 1)
    return np.maximum(np.abs(grad) * (rate > 0), np.maximum(0, -grad)).max()


def test_solve_reaches_the_optimum_at_any_target():
    rng = np.random.default_rng(2)
    for goal in ([0.96 * 1.25, 0.02 * 1.25, 0.02 * 1.25], [1.0, 0, 0], [0.1, 0.8, 0.1], [0.0, 0.0, 3.0]):
        p = rng.dirichlet([0.3, 0.05, 0.01], 3000)
        cell = (np.floor(p[:, 2] * 256) * 257 + np.floor(p[:, 1] * 256)).astype(int)
        tokens = rng.integers(1, 5000, len(p)).astype(float)
        names, at = np.unique(cell, return_inverse=True)
        mass = np.stack([np.bincount(at, tokens * p[:, k]) for k in range(3)], axis=1)
        rate = solve(names, mass.sum(axis=1), mass, np.array(goal), pull=1e-4)
        assert rate.min() >= 0 and kkt(mass.sum(axis=1), mass, np.array(goal), rate) < 1e-6
        if min(goal) > 0:
            assert np.abs(mass.T @ rate / tokens.sum() - goal).max() < 2e-3


def test_a_target_that_hardly_any_document_serves_leaves_the_others_alone():
    """Two cells of clean documents, one with a trace more of the missing domain: both keep their documents."""
    mass = np.array([[130.0, 0.2, 0.3], [0.24, 0.001, 0.001], [0.2, 0.01, 7.0]])
    rate = solve(np.array([0, 1, 65000]), mass.sum(axis=1), mass, 1.25 * np.array([0.96, 0.02, 0.02]))
    assert 1 < rate[0] < 1.4 and 1 < rate[1] < 1.4 and rate[2] < 0.7


def test_rates_follow_from_the_posteriors_alone(spark):
    """Rates, tokens and copies against a plain version that gets the same posteriors."""
    docs, labels = corpus(300)
    got = mixing_rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), TARGETS, VOCABULARY, budget=1.2).collect()
    encode = encoding(VOCABULARY).encode_ordinary
    texts, cells = {d[0]: d[1] for d in docs}, {}
    for r in got:
        assert r.tokens == len(encode(texts[r.doc_id]))
        cells.setdefault(int(r.p_toxic * 256) * 257 + int(r.p_low * 256), []).append(r)
    names = sorted(cells)
    mass = np.array([[sum(round(r.tokens * r[f"p_{d}"] * 65536) for r in cells[c]) / 65536 for d in DOMAINS] for c in names])
    want = dict(zip(names, solve(np.array(names), mass.sum(axis=1), mass, 1.2 * np.array([TARGETS[d] for d in DOMAINS]))))
    assert all(abs(r.rate - want[c]) < 1e-9 for c in names for r in cells[c])
    assert abs(sum(r.copies for r in got) - sum(r.rate for r in got)) < 4 * np.sqrt(len(got)) / 2


def test_clashing_names_in_any_case(spark):
    df = spark.createDataFrame(corpus(20)[0], DOCS).withColumnsRenamed({"rate": "Rate", "shard": "Tokens"})
    out = mixed(df, spark.createDataFrame(corpus(20)[1], LABELS), TARGETS, VOCABULARY)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens", "p_clean", "p_low", "p_toxic", "rate", "copies"] and out.count() == 20


def test_awkward_rows(spark):
    docs, labels = corpus(60)
    df = spark.createDataFrame(docs + [(1000 + (r[0] or 0) if r[0] else None, *r[1:]) for r in awkward()], DOCS)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 1), (4, 1, None), (5, 0, 0), (5, 1, 1)], LABELS)
    out = mixed(df, lab, TARGETS, VOCABULARY)
    got = out.collect()
    assert len(got) == df.count() and all(r.rate >= 0 for r in got)
    assert {r.tokens for r in got if not r.text} == {0}
    back = repeated(out)
    assert back.columns == [c for c in df.columns if c != "rate"]
    assert back.count() == sum(r.copies for r in got)


def test_labels_without_documents_use_up_no_sample_rows(spark):
    docs, labels = corpus(60)
    df = spark.createDataFrame([*docs, *docs[:5], (None, *docs[0][1:])], DOCS)
    gone = [(i, i % 2, 0) for i in range(1000, 3000)]
    want = classifier(df, spark.createDataFrame(labels, LABELS), sample_rows=40)
    assert any(np.frombuffer(want, np.float32))
    assert classifier(df, spark.createDataFrame([*gone, *labels], LABELS), sample_rows=40) == want


def test_no_labels_and_no_rows(spark):
    df, none = spark.createDataFrame(rows([(1, "a b"), (2, None)]), DOCS), spark.createDataFrame([], LABELS)
    assert {(round(r.p_clean, 6), round(r.p_low, 6)) for r in mixing_rates(df, none, TARGETS, VOCABULARY).collect()} == {(0.333333, 0.333333)}
    assert mixing_rates(spark.createDataFrame([], DOCS), none, TARGETS, VOCABULARY).count() == 0


def test_fit_separates():
    import pyarrow as pa

    f, v, first = features(pa.array(["good words here", "bad bad bad", "good day", "bad luck", "", None]))
    w = fit(f, v, first, np.array([0, 1, 0, 1, 0, 0]))
    z = np.add.reduceat(w[f] * v[:, None], first[:-1], axis=0)
    assert z.argmax(axis=1).tolist() == [0, 1, 0, 1, 0, 0]


def test_copies_of_a_labelled_document_use_up_no_sample_rows(spark):
    docs, labels = corpus(60)
    lab = spark.createDataFrame(labels, LABELS)
    want = classifier(spark.createDataFrame(docs, DOCS), lab, sample_rows=40)
    assert any(np.frombuffer(want, np.float32))
    assert classifier(spark.createDataFrame([*docs, *docs[:10] * 30], DOCS), lab, sample_rows=40) == want

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import DOCS, awkward, rows, words
from webloom.llm.quality import RULES, _kth_largest, cautious_rank, measure, quality_rules, thresholds

LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    ws = [w for w in re.split(r"[ \t\n\v\f\r]+", text) if w]
    ls = [x for x in (line.strip(" \t\v\f\r") for line in text.split("\n")) if x]
    chars = re.sub(r"[ \t\n\v\f\r]", "", text)
    return {
        "symbols": len(re.findall(r"""[\x00-\x08\x0e-\x1f\x23-\x26\x28-\x2b/<=>@\[\\\]^_`{|}~\x7f]""", text)) / max(1, len(chars)),
        "shouting": sum(w.isascii() and not re.search("[a-z]", w) and len(re.findall("[A-Z]", w)) > 1 for w in ws) / max(1, len(ws)),
        "repetition": sum(a == b for a, b in zip(ws, ws[1:])) / max(1, len(ws)),
        "tables": ws.count("|") / max(1, len(ws)),
        "doubling": (len(ls) - len(set(ls))) / max(1, len(ls)),
    }


def test_measures_match_the_plain_version():
    texts = [t or "" for _, t, *_ in awkward()] + ["A | B | C\nA | B | C \n\n", "LOUD!! words WORDS words words", "a a a\rb\x0bb\x1fb", "É ÉÉ Éa É", "##$ (x) [y]\n\n|", "\n"]
    found = measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert {r: found[r][i] for r in RULES} == pytest.approx(plain(t)), t[:40]


@pytest.mark.parametrize(("n", "rate", "level"), [(0, 0.1, 0.05), (10, 0.1, 0.05), (300, 0.02, 0.01), (5000, 0.004, 0.0025), (50, 0.5, 0.9)])
def test_rank_is_the_exact_binomial_bound(n, rate, level):
    k = cautious_rank(n, rate, level)
    cdf = lambda m: sum(math.comb(n, j) * rate**j * (1 - rate) ** (n - j) for j in range(m + 1))
    assert k == 0 or cdf(k - 1) <= level
    assert n == 0 or k == n or cdf(k) > level


def test_false_rejections_stay_within_alpha():
    """Over many holdouts, the true rate beyond the chosen cutoff exceeds its bound no more often than the level says."""
    rng, bad = np.random.default_rng(1), 0
    for _ in range(400):
        held = np.sort(rng.random(400))[::-1]
        k = cautious_rank(400, 0.05, 0.1)
        bad += 1 - held[k - 1] > 0.05
    assert 0 < bad / 400 <= 0.13


def corpus(n=900):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = words(rng.randint(20, 60), i)
        docs.append((i, text if good else " ".join(w + "###" for w in text.split())))
        labels.append((i, int(good), 0))
    return rows(docs), labels


def test_bad_go_and_good_stay(spark):
    docs, labels = corpus()
    extra = [(None, 1, 0), (5000, None, 0), (labels[0][0], 0, 0)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + extra, LABELS), alpha=0.1).collect()}
    assert len(got) == len(docs)
    assert all(got[i].rejected and "symbols" in got[i].failed for i, q, _ in labels if not q)
    assert sum(got[i].rejected for i, q, _ in labels if q) <= 0.1 * len(labels)


def test_cutoffs_match_brute_force(spark):
    docs, labels = corpus()
    half = [(*d[:2], "de" if d[0] % 2 else None, *d[3:]) for d in docs]
    got = {(r.stratum, r.rule): (r.n, r.k, r.cutoff) for r in thresholds(spark.createDataFrame(half, DOCS), spark.createDataFrame(labels, LABELS), alpha=0.2).collect()}
    df, lab = spark.createDataFrame(half, DOCS), spark.createDataFrame(labels, LABELS)
    assert {(r.stratum, r.rule): (r.n, r.k, r.cutoff) for r in thresholds(df, lab, alpha=0.2, broadcast_rows=0).collect()} == got
    for lang in ("de", None):
        texts = [t for (i, t, x, *_), (_, q, _) in zip(half, labels) if x == lang and q]
        k = cautious_rank(len(texts), 0.2 / 5, 0.05 / 10)
        for rule in RULES:
            assert got[lang, rule][:2] == (len(texts), k)
            assert got[lang, rule][2] == pytest.approx(sorted((plain(t)[rule] for t in texts), reverse=True)[k - 1])


def test_clashing_names_in_any_case(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, DOCS).withColumnsRenamed({"rate": "Failed", "shard": "REJECTED"})
    got = quality_rules(df, spark.createDataFrame(labels, LABELS), alpha=0.2)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "failed", "rejected"]
    want = quality_rules(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), alpha=0.2)
    pick = lambda d: sorted((r.doc_id, tuple(r.failed)) for r in d.collect())
    assert pick(got) == pick(want) and any(f for _, f in pick(got))


def test_awkward_rows(spark):
    docs = awkward()
    df = spark.createDataFrame(docs, DOCS)
    got = quality_rules(df, spark.createDataFrame([], LABELS))
    assert got.columns == [*df.columns, "failed", "rejected"]
    assert sorted((r.doc_id, r.failed) for r in got.collect() if r.rejected and r.doc_id) == [(1, ["empty"]), (2, ["empty"])]
    assert got.count() == len(docs)
    assert quality_rules(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0


def test_kth_largest_matches_sorting(spark):
    """Ties, values closer than any cell of the grid, and ranks at both ends."""
    rng = random.Random(3)
    values, wanted, want = [], [], {}
    for stratum in ("a", None):
        for rule, draw in (("x", lambda: rng.randint(0, 40) / rng.randint(40, 90)), ("y", lambda: 0.0), ("z", lambda: 0.5 + rng.randint(0, 30) * 2.0**-40)):
            mine = [draw() for _ in range(300)]
            values += [(stratum, rule, v, mine.count(v)) for v in set(mine)]
            k = rng.choice((1, 17, 150, 300))
            wanted.append((stratum, rule, k))
            want[stratum, rule] = sorted(mine, reverse=True)[k - 1]
    got = _kth_largest(spark.createDataFrame(values, "stratum string, rule string, v double, c long"), spark.createDataFrame(wanted, "stratum string, rule string, k int"))
    assert {(r.stratum, r.rule): r.cutoff for r in got.collect()} == want

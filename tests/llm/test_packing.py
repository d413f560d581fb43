import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import DOCS, VOCABULARY, awkward, rows, words
from webloom.llm._tokens import Counter, encoding
from webloom.llm.packing import best_fit_packing, best_two_fit


def plain(sizes, capacity):
    """The method step by step over a list."""
    left, bins = sorted(sizes), []
    while left:
        room, out = capacity, []
        while fits := [s for s in left if s <= room]:
            s = fits[-1]
            left.remove(s)
            out.append(s)
            room -= s
        if room and len(out) > 1:
            last, best = out[-1], None
            for i, a in enumerate(left):
                for b in left[:i]:
                    if last < a + b <= room + last and (best is None or (a + b, a) > best[0]):
                        best = ((a + b, a), b)
            if best:
                a, b = best[0][1], best[1]
                left.remove(a)
                left.remove(b)
                left = sorted([*left, last])
                out[-1:] = [a, b]
        bins.append(out)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))))
def test_bins_match_the_plain_version(case):
    capacity, sizes = case
    assert best_two_fit(np.array(sizes, dtype=np.int64), capacity) == plain(sizes, capacity)


def test_a_replacement_happens():
    assert best_two_fit(np.array([6, 3, 2, 2]), 10) == [[6, 2, 2], [3]]


def test_every_token_is_packed_once(spark):
    docs = rows((i, words(random.Random(i).randint(1, 900), i)) for i in range(200)) + awkward()
    got = best_fit_packing(spark.createDataFrame(docs, DOCS), VOCABULARY, capacity=512, docs_per_shard=60).collect()
    assert len({(r.shard, r.pack) for r in got}) == len(got) and len({r.shard for r in got}) > 1
    seen = sorted((-1 if d is None else d, s, t) for r in got for d, s, t in zip(r.doc_ids, r.starts, r.tokens))
    encode, want = encoding(VOCABULARY).encode_ordinary, []
    for i, t, *_ in docs:
        n = len(encode(t)) if t else 0
        for at in range(0, n + 1 if n else 0, 512):
            want.append((-1 if i is None else i, at, min(512, n + 1 - at)))
    assert seen == sorted(want)
    assert all(r.used == sum(r.tokens) <= 512 for r in got)


def test_counter_equals_the_encoder():
    import pyarrow as pa

    texts = ["", " ", "a  b", "don't  stop\n\n now ", "x y z", " ", "中文 テスト", "1234567 89", "  lead", "tail  ", "é🙂 é🙂", "a\r\nb\t\tc"] * 2
    assert Counter(VOCABULARY)(pa.array([*texts, None])).tolist() == [len(encoding(VOCABULARY).encode_ordinary(t)) for t in texts] + [0]


def test_empty_table(spark):
    assert best_fit_packing(spark.createDataFrame([], DOCS), VOCABULARY).count() == 0


def test_a_repeated_document_is_spread_over_all_shards(spark):
    docs = rows([(7, words(30, 7))] * 100 + [(None, words(20, 8))] * 101 + [(i, words(10, i)) for i in range(100, 150)])
    got = best_fit_packing(spark.createDataFrame(docs, DOCS), VOCABULARY, capacity=256, docs_per_shard=50).collect()
    per = {}
    for r in got:
        per.setdefault(r.shard, []).extend(r.doc_ids)
    assert len(per) == 6 and all(16 <= p.count(7) <= 17 and 16 <= p.count(None) <= 17 for p in per.values())
    assert sum(p.count(7) for p in per.values()) == 100 and sum(p.count(None) for p in per.values()) == 101
    assert sorted(d for p in per.values() for d in p if d and d >= 100) == list(range(100, 150))

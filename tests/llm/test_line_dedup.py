import numpy as np

from tests.llm.data import DOCS, awkward, rows
from webloom.llm._index import PerfectHash, Shard
from webloom.llm.line_dedup import line_dedup


def brute(docs, most):
    count, owner = {}, {}
    for i, t, *_ in docs:
        for line in (t or "").split("\n"):
            s = line.strip(" ")
            if s:
                count[s] = count.get(s, 0) + 1
                owner[s] = min(owner.get(s, 1 << 62), (1 << 62) if i is None else i)
    out = []
    for i, t, *_ in docs:
        if t is None:
            out.append((i, None, 0))
            continue
        seen, kept = set(), []
        for line in t.split("\n"):
            s = line.strip(" ")
            if not s or count[s] <= most or (owner[s] == ((1 << 62) if i is None else i) and s not in seen):
                kept.append(line)
            seen.add(s)
        gone = len(t.split("\n")) - len(kept)
        text = "\n".join(kept)
        if not gone or text.strip(" \n"):
            out.append((i, text, gone))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    texts = [f"head {i % 7}\n\nown {i}\n  footer \nown {i}" for i in range(60)] + ["footer", "footer\nhead 1", ""]
    docs = rows(enumerate(texts)) + awkward()
    for most in (1, 6):
        got = line_dedup(spark.createDataFrame(docs, DOCS), most, keys_per_shard=3)
        assert sorted(((r.doc_id, r.text, r.lines_removed) for r in got.collect()), key=repr) == brute(docs, most)
        assert all(r.text is None or r.n_chars == len(r.text) for r in got.collect())
        assert got.columns == [*DOCS.replace(",", "").split()[::2], "lines_removed"]


def test_clashing_names_and_very_long_texts(spark):
    many = "\n".join(f"line {i % 5000}" for i in range(40_000))
    docs = rows([(1, many), (2, "line 7\nown"), (3, "x" * 2_000_000)])
    df = spark.createDataFrame(docs, DOCS).withColumnsRenamed({"rate": "Lines_Removed", "shard": "lines removed"})
    got = line_dedup(df, 6)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lines removed", "lines_removed"]
    assert sorted((r.doc_id, r.text, r["lines_removed"]) for r in got.collect()) == brute(docs, 6)


def test_answers_depend_on_neither_chunks_nor_shards(spark):
    docs = rows((i, f"head {i % 9}\nown {i}\nfooter\n" + "twice\n" * (i % 4)) for i in range(200))
    df = spark.createDataFrame(docs, DOCS)
    for parts, keys in ((1, 10), (13, 10), (13, 10**6)):
        got = line_dedup(df.repartition(parts), 6, keys_per_shard=keys).collect()
        assert sorted(((r.doc_id, r.text, r.lines_removed) for r in got), key=repr) == brute(docs, 6)


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    assert sorted(PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))
    shard = Shard.load(Shard.build(keys, np.arange(len(keys)), np.arange(len(keys)) * 2).dump())
    count, owner = shard.probe(keys)
    assert (count == np.arange(len(keys))).all() and (owner == 2 * count).all()
    assert (shard.probe(keys + np.uint64(1) + np.uint64(1 << 63))[0] == 0).all()

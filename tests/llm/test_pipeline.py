import random
import struct

import numpy as np
import pyarrow as pa
import xxhash

import corpus_pipeline
from tests.llm.data import DOCS, VOCABULARY, awkward, rows, words
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_pairs
from tests.llm.test_packing import plain as plain_packs
from tests.llm.test_quality import plain
from webloom.llm._tokens import encoding
from webloom.llm.mixing import _DIM, DOMAINS, classifier, features, solve
from webloom.llm.quality import RULES, cautious_rank
from webloom.llm.queries import BUDGET, TARGETS

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng, docs, labels = random.Random(11), [], []
    for i in range(1900):
        kind = rng.choices(("clean", "low", "toxic", "copy"), (85, 6, 4, 5))[0]
        text = f"Shared header line\n{words(rng.randint(10, 25), i)}\n{words(8, 9000 + i)}"
        if kind == "low":
            text = " ".join(w + "###" for w in text.split())
        if kind == "toxic":
            text += " you awful villain scoundrel"
        if kind == "copy" and docs:
            j = rng.randrange(len(docs))
            text = docs[j][1] + " again"
            kind = "low" if "###" in text else "toxic" if "villain" in text else "clean"
        docs.append((i, text))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return rows(docs), labels


def brute_quality(docs, labels):
    good = {i for i, q, _ in labels if q}
    held = [plain(t) for i, t, *_ in docs if i in good and t]
    k = cautious_rank(len(held), 0.02 / 5, 0.05 / 5)
    cut = {r: sorted((m[r] for m in held), reverse=True)[k - 1] if k else 9e9 for r in RULES}
    return [d for d in docs if d[1] and all(plain(d[1])[r] <= cut[r] for r in RULES)]


def brute_groups(docs):
    leader = {}

    def find(x):
        while leader.get(x, x) != x:
            x = leader[x]
        return x

    for a, b, _ in brute_pairs([(d[0], d[1]) for d in docs], 5, 0.4):
        a, b = sorted((find(a), find(b)))
        leader[b] = a
    return [d for d in docs if d[0] is None or find(d[0]) == d[0]]


def test_stages_against_plain_versions(spark, tmp_path):
    docs, labels = corpus()
    docs += [r for r in awkward() if r[0] != 6 and r[0] not in (9, 10)]
    docs = [(d[0] + 10_000 if d[0] is not None and k >= 1900 else d[0], *d[1:]) for k, d in enumerate(docs)]
    names = [f.split()[0] for f in DOCS.split(", ")][:5]
    spark.createDataFrame(docs, DOCS).select(names).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    folder = str(tmp_path)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    found = {}
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(steps.items()):
        df = stage(spark, df, folder)
        df.write.parquet(f"{folder}/stage{k}")
        df = spark.read.parquet(f"{folder}/stage{k}")
        found[name] = df
        assert k == 4 or df.columns == names
    pairs = lambda name: sorted(((r.doc_id, r.text) for r in found[name].collect()), key=repr)
    want = brute_quality(docs, labels)
    assert pairs("quality rules") == sorted(((d[0], d[1]) for d in want), key=repr) and len(want) < len(docs) - 80
    want = [(i, t) for i, t, _ in brute_lines(want, 6)]
    assert pairs("line dedup") == sorted(want, key=repr)
    want = brute_groups(want)
    assert pairs("n-gram Jaccard join") == sorted(want, key=repr) and len(want) < 1900
    kept = pairs("mixing sources to target weights")
    assert set(kept) <= set(want)
    toxic = {i for i, _, t in labels if t}
    clean = [d for d in want if d[0] is not None and d[0] < 1900 and d[0] not in toxic]
    ids = [i for i, _ in kept]
    assert len({i for i in ids if i is not None} & {i for i, _ in clean}) >= 0.97 * len(clean)
    assert sum(i in toxic for i in ids) < 0.5 * sum(i in toxic for i, *_ in want)
    encode = encoding(VOCABULARY).encode_ordinary
    packs = found["best-fit packing"].collect()
    assert sum(r.used for r in packs) == sum(len(encode(t)) + 1 for _, t in kept if t and encode(t))
    assert all(r.used <= 4096 for r in packs)


def plain_mix(spark, docs, labels):
    """The mixing stage row by row, with the operator's own classifier and solver and an independent hash."""
    frame, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    weights = np.frombuffer(classifier(frame, lab), np.float32).reshape(_DIM, -1)
    encode, rated, cells = encoding(VOCABULARY).encode_ordinary, [], {}
    for i, t in docs:
        feature, value, _ = features(pa.array([t], pa.string()))
        z = (weights[feature] * value[:, None]).sum(axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        cell = int(p[2] * 256) * 257 + int(p[1] * 256)
        rated.append((i, t, cell))
        cells.setdefault(cell, []).append(np.round(len(encode(t or "")) * p * 65536) / 65536)
    names = sorted(cells)
    mass = np.array([np.sum(cells[c], axis=0) for c in names])
    share = np.array([TARGETS[d] for d in DOMAINS])
    rate = dict(zip(names, solve(np.array(names), mass.sum(axis=1), mass, share / share.sum() * BUDGET)))
    out = []
    for i, t, cell in rated:
        seed = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
        u = (xxhash.xxh64_intdigest(b"copies", seed=seed) % (1 << 30)) / (1 << 30)
        out += [(i, t)] * int(rate[cell] + u)
    return out


def test_run_matches_a_plain_version(spark, tmp_path):
    """All stages by brute force, down to the sequences."""
    docs, labels = corpus()
    docs, labels = [*docs[:420], *(r for r in awkward() if r[0] in (None, 2, 4, 8, 11, 12))], labels[:420]
    docs = [(5_000 + d[0] if k >= 420 and d[0] is not None else d[0], *d[1:]) for k, d in enumerate(docs)]
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    packs = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_groups([(i, t) for i, t, _ in brute_lines(brute_quality(docs, labels), 6)])
    kept = plain_mix(spark, want, labels)
    encode = encoding(VOCABULARY).encode_ordinary
    pieces = [(i, s, min(4096, n - s)) for i, t in kept if t and encode(t) for n in [len(encode(t)) + 1] for s in range(0, n, 4096)]
    key = lambda p: (p[0] is None, p[0] or 0, *p[1:])
    assert sorted(((d, s, t) for r in packs for d, s, t in zip(r.doc_ids, r.starts, r.tokens)), key=key) == sorted(pieces, key=key)
    assert [list(r.tokens) for r in sorted(packs, key=lambda r: r.pack)] == plain_packs([t for *_, t in pieces], 4096) and len(packs) > 5


def test_empty_tables_and_extra_columns(spark, tmp_path):
    none = str(tmp_path / "none")
    spark.createDataFrame([], DOCS).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
    docs, labels = corpus()
    some, extra = str(tmp_path / "some"), {"rejected": "x", "Lines_Removed": 1, "tokens": 2.5, "p_clean": True, "copies": "many", "group": 7, "a.b": 0}
    df = spark.createDataFrame([(*d[:5], *extra.values()) for d in [*docs[:60], *awkward()]], "doc_id long, text string, lang string, source string, n_chars long, rejected string, Lines_Removed long, tokens double, p_clean boolean, copies string, group long, `a.b` long")
    df.write.parquet(f"{some}/documents.parquet")
    spark.createDataFrame(labels[:60], LABELS).write.parquet(f"{some}/labels.parquet")
    docs = spark.read.parquet(f"{some}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, some).write.parquet(f"{some}/stage{k}")
        docs = spark.read.parquet(f"{some}/stage{k}")
        assert docs.schema.simpleString() == df.schema.simpleString() and docs.count() > 40
        assert {tuple(r)[5:] for r in docs.collect()} == {tuple(extra.values())}


def test_run_gives_packs(spark):
    packs = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packs.columns == ["shard", "pack", "used", "doc_ids", "starts", "tokens"] and packs.count() > 0

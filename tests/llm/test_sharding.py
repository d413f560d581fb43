import hashlib

from pyspark.sql import functions as F

from tests.llm.data import DOCS, awkward, rows
from webloom.llm.sharding import with_shards, write_shards


def brute(docs, limit):
    items = [(bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60), len((t or "").encode()), i) for i, t, *_ in docs]
    out, todo = [], [""]
    while todo:
        p = todo.pop()
        inside = [x for x in items if x[0].startswith(p)]
        total = sum(x[1] for x in inside)
        if not inside:
            continue
        if total <= limit or len({x[0] for x in inside}) == 1:
            out += [(i, p, len(p), total, total <= limit) for _, _, i in inside]
        else:
            todo += [p + "0", p + "1"]
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    docs = rows((i, "é" * (i * 37 % 300)) for i in range(300)) + awkward()
    df = spark.createDataFrame(docs, DOCS)
    for limit, wide in ((1, 10**6), (2_000, 10**6), (2_000, 1), (10**9, 10**6)):
        got = with_shards(df, limit, broadcast_rows=wide)
        assert sorted(((r.doc_id, r.shard, r.depth, r.shard_bytes, r.fits) for r in got.collect()), key=repr) == brute(docs, limit)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate", "shard", "depth", "shard_bytes", "fits"]


def test_deep_splits_and_clashing_names(spark):
    """Rounds beyond the first, next to a document that is larger than the limit by itself, and keys that aren't numbers."""
    docs = rows([(i, "x" * (5_000 if i == 7 else 3)) for i in range(400)])
    df = spark.createDataFrame(docs, DOCS).withColumnsRenamed({"shard": "Shard", "rate": "Depth"}).withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    items = {f"k{i}": t for i, t, *_ in docs}
    for limit in (10, 6_000):
        got = with_shards(df, limit)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "depth", "shard_bytes", "fits"]
        want = brute([(k, t) for k, t in items.items()], limit)
        assert sorted(((r.doc_id, r.shard, r.depth, r.shard_bytes, r.fits) for r in got.collect()), key=repr) == want


def test_rounds_go_on_until_all_fit(spark, monkeypatch):
    from webloom.llm import sharding

    monkeypatch.setattr(sharding, "_STEP", 1)
    docs = rows([(i, "x" * (100_000 if i < 2 else 1)) for i in range(64)])
    got = with_shards(spark.createDataFrame(docs, DOCS), 60_000).collect()
    assert sorted(((r.doc_id, r.shard, r.depth, r.shard_bytes, r.fits) for r in got), key=repr) == brute(docs, 60_000)


def test_empty_table(spark):
    assert with_shards(spark.createDataFrame([], DOCS), 10).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.createDataFrame(rows((i, "x" * 50) for i in range(100)), DOCS)
    write_shards(df, str(tmp_path / "out"), 600)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    assert len(list((tmp_path / "out").glob("shard=*"))) == back.select("shard").distinct().count() > 4

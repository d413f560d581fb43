"""Extendible hashing of documents into shards with a byte limit.

A document's hash is the first 60 bits of the MD5 of its doc_id.  The directory is indexed by
leading hash bits: it starts as one bucket, and every bucket whose texts exceed the limit, and
only such a bucket, splits on its next bit, until each fits.  Bytes are summed per hash prefix
in one shuffle of small partial sums (never of texts); all levels of the directory are sums of these, in one more, and
prefixes that are still too large get further bits in another round.  Splitting is joins and sums throughout: nothing of
the directory passes through the driver, at any number of shards.

A bucket that holds a single hash (one huge document, or rows that repeat a doc_id) can't be
split and stays over the limit; ``fits`` tells.  Documents find their shard by the prefix bits that all
shards have in common: the directory is broadcast where it has up to ``broadcast_rows`` entries (some 10 MB), and beyond
that rows and entries meet in one shuffle.

Nulls, ties and odd rows: rows with a null doc_id hash as the empty string, so they share a
shard; null texts weigh 0 bytes and keep their place; very long texts get a shard of their own; repeated rows go to the same
shard; doc_id may have any type.
Extra columns are passed on by ``with_shards``, but any named shard, depth, shard_bytes or fits, in any case,
gives way.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import written

_BITS = 60
_STEP = 6


def hash_bits() -> Column:
    """The first 60 bits of the MD5 of doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def _nodes(weighed: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """(d, q, bytes, docs, done, leaf) of every bucket of ``top`` to ``depth`` bits that holds rows.

    A bucket is done if it fits or holds one hash, and a leaf if its parent isn't; buckets of ``top`` bits are known to need a
    split, or are the root.
    """
    sums = weighed.groupBy(F.shiftrightunsigned("h", _BITS - depth).alias("p")).agg(F.sum("b").alias("bytes"), F.sum("n").alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    levels = sums.withColumn("d", F.explode(F.sequence(F.lit(top), F.lit(depth)))).withColumn("q", F.expr(f"shiftrightunsigned(p, {depth} - d)"))
    nodes = levels.groupBy("d", "q").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    twins = Window.partitionBy("d", F.shiftright("q", 1))
    above = (F.sum("bytes").over(twins) <= limit) | (F.min("lo").over(twins) == F.max("hi").over(twins))
    marked = nodes.withColumn("done", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).withColumn("above", above)
    return marked.withColumn("leaf", F.col("done") & ((F.col("d") == 0) | ((F.col("d") > top) & ~F.col("above")))).drop("lo", "hi", "above")


def directory(docs: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, shard_bytes, shard_docs, fits) of every shard, written to the shared folder."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = docs.select(hash_bits().alias("h"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("b"))
    todo = written(rows.groupBy("h").agg(F.sum("b").alias("b"), F.count("*").alias("n")))
    total = todo.agg(F.sum("b")).first()[0] or 0
    top, depth, found = 0, min(_BITS, max(1, int(total // limit).bit_length() + 2)), None
    while True:
        nodes = written(_nodes(todo, top, depth, limit))
        leaves = nodes.where("leaf").select(F.col("q").alias("prefix"), F.col("d").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), (F.col("bytes") <= limit).alias("fits"))
        found = leaves if found is None else found.union(leaves)
        wide = nodes.where(f"d = {depth} and not done").select(F.col("q").alias("p"))
        if wide.isEmpty():
            return written(found)
        todo = todo.withColumn("p", F.shiftrightunsigned("h", _BITS - depth)).join(wide, "p", "left_semi").drop("p")
        top, depth = depth, min(_BITS, depth + _STEP)


def with_shards(docs: DataFrame, limit: int, broadcast_rows: int = 200_000) -> DataFrame:
    """docs and shard (its hash prefix as bits), depth, shard_bytes and fits."""
    table = directory(docs, limit)
    entries, least = table.agg(F.count("*"), F.coalesce(F.min("depth"), F.lit(0))).first()
    coarse = table.select(F.expr(f"shiftrightunsigned(prefix, depth - {least})").alias("__wl_at"), "prefix", "depth", "shard_bytes", "fits")
    keep = [c for c in docs.columns if c.lower() not in ("shard", "depth", "shard_bytes", "fits")]
    base = docs.select(*[F.col(f"`{c}`") for c in keep], hash_bits().alias("__wl_h")).withColumn("__wl_to", F.shiftrightunsigned("__wl_h", _BITS - least))
    here = (F.col("__wl_to") == F.col("__wl_at")) & F.expr(f"shiftrightunsigned(__wl_h, {_BITS} - depth) = prefix")
    joined = base.join(F.broadcast(coarse) if entries <= broadcast_rows else coarse.hint("merge"), here)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return joined.select(*[F.col(f"`{c}`") for c in keep], bits.alias("shard"), "depth", "shard_bytes", "fits")


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """One folder of Parquet for each shard, below ``path``; names start with b, as bits alone would be read back as numbers.

    A shard that fits is one file; one that can't be split is spread over as many tasks as it is times too large.
    """
    part = F.pmod(F.xxhash64("text"), F.ceil(F.greatest("shard_bytes", F.lit(1)) / limit))
    named = with_shards(docs, limit).withColumn("shard", F.concat(F.lit("b"), "shard"))
    named.repartition("shard", part).drop("depth", "shard_bytes", "fits").write.partitionBy("shard").parquet(path)

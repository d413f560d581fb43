"""What the similarity joins share: candidates verified in blocks, groups of linked rows, and one row for each document.

A set here is all rows with equal content, named by a 64-bit signature; ``info`` holds (sig, name, n), the smallest id and
the number of ids of a set, and ``members`` (sig, id).  Links are pairs of different sets.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._arrow import cogrouped
from webloom.session import delete, shared_dir, shuffle_partitions, written

#: Candidates of one Python call, and sets on either side of a block.
_PAIRS, _SIDE = 200_000, 500


def verified(candidates: DataFrame, payload: DataFrame, verify: Callable[..., pa.Table], **bound) -> DataFrame:
    """(sig_a, sig_b) of the candidates that ``verify`` (pairs, payloads of a block → pairs) accepts.

    Candidates that hang together are dealt to blocks of at most about ``_SIDE`` by ``_SIDE`` sets, so that a payload is sent
    once for each block and not once for each pair, and a group of any size is spread over as many blocks as it needs.
    """
    candidates = written(candidates)
    blocks = max(4 * shuffle_partitions(candidates.sparkSession), candidates.count() // _PAIRS)
    ends = candidates.select(F.col("sig_a").alias("sig"), F.col("sig_b").alias("other")).union(candidates.select(F.col("sig_b").alias("sig"), F.col("sig_a").alias("other")))
    least = ends.groupBy("sig").agg(F.least(F.min("other"), F.first("sig")).alias("least"))
    wide = least.groupBy("least").agg(F.ceil(F.count("*") / _SIDE).alias("k")).where("k > 1").withColumnRenamed("least", "__wl_least")
    at = least.join(wide, least["least"] == wide["__wl_least"], "left").select("sig", "least", F.coalesce("k", F.lit(1)).alias("k"))
    part = [F.pmod(F.xxhash64(c, F.lit("side")), F.col("k")) for c in ("sig_a", "sig_b")]
    block = F.pmod(F.xxhash64("least", *part), F.lit(blocks)).cast("int")
    placed = candidates.join(at.withColumnRenamed("sig", "sig_a"), "sig_a").select(block.alias("block"), "sig_a", "sig_b")
    needed = placed.select(F.col("block").alias("place"), F.explode(F.array("sig_a", "sig_b")).alias("sig")).distinct()
    sent = needed.join(payload, "sig")
    return placed.groupBy("block").cogroup(sent.groupBy("place")).applyInArrow(cogrouped(verify, **bound), "sig_a long, sig_b long")


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, group): the smallest doc_id that the pairs (doc_a, doc_b) lead to, for every document in a pair.

    Alternating large-star and small-star steps until nothing changes (a chain of length n takes about log n rounds); each
    round is written to the shared folder, in place of the one before.
    """
    spark = pairs.sparkSession
    path = shared_dir(spark)
    edges = written(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct(), path)
    last, state = None, ()
    while state != last:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, path = path, shared_dir(spark)
        edges = written(small, path)
        delete(spark, before)
        last, state = state, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group")).union(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group")).distinct())


def classes(members: DataFrame, info: DataFrame, pairs: DataFrame, count_links: bool = True) -> DataFrame:
    """(id, class_id, copies, links) of every member.

    class_id is the smallest id that links lead to, copies the number of ids with equal content (itself included) and
    links the number of other ids with equal or linked content.  An id with several sets joins their classes and has a row
    for each.  Members whose set isn't in ``info`` stand alone.
    """
    pairs = written(pairs.select("sig_a", "sig_b"))
    several = members.where("sig is not null").groupBy("id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("id", "lo")
    own = written(members.join(several, "id").where("sig <> lo").select("id", F.col("lo").alias("sig_a"), F.col("sig").alias("sig_b")).distinct())
    edges = pairs
    if not own.isEmpty():
        edges = edges.union(own.select("sig_a", "sig_b"))
        lone = own.select("id", F.explode(F.array("sig_a", "sig_b")).alias("sig"))
        info = info.select("sig", "name", "n").union(lone.select("sig", F.col("id").alias("name"), F.lit(1).cast("long").alias("n"))).groupBy("sig").agg(F.min("name").alias("name"), F.max("n").alias("n"))
    found = components(edges.select(F.col("sig_a").alias("doc_a"), F.col("sig_b").alias("doc_b")))
    named = info.select("sig", "name", "n").join(found.withColumnRenamed("doc_id", "sig"), "sig", "left")
    least = named.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("name").alias("least"))
    about = named.join(least, "group", "left").select("sig", F.col("n").alias("copies"), F.coalesce("least", "name").alias("class_id"))
    if count_links:
        both = pairs.select(F.col("sig_a").alias("sig"), F.col("sig_b").alias("other")).union(pairs.select(F.col("sig_b").alias("sig"), F.col("sig_a").alias("other")))
        near = both.join(info.select(F.col("sig").alias("other"), F.col("n").alias("m")), "other").groupBy("sig").agg(F.sum("m").alias("near"))
        about = about.join(near, "sig", "left").withColumn("links", F.coalesce("near", F.lit(0)) + F.col("copies") - 1).drop("near")
    # a signature may stand for a third of all members: adaptive execution splits its partition
    out = members.join(about, "sig", "left")
    rest = [F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links")] if count_links else []
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), *rest)

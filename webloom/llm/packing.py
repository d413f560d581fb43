"""Best-two-fit packing of documents into training sequences.

Every document is token-counted under a public vocabulary (one end token each) and becomes
pieces of at most ``capacity`` tokens: whole ones first, then the rest.  A sequence is filled
greedily, largest piece that fits first.  When nothing more fits and the sequence isn't full,
its smallest piece is taken back if two pieces not yet packed fit the gap so widened more
tightly than it did; of all such pairs the one that leaves the least gap wins, and among equals
the one with the largest piece.  A sequence of one piece keeps it, even if two others would fill
it better: sizes 6, 5, 5 at a capacity of 10 become [6] and [5, 5] in this order.

Documents are dealt to shards by a hash of doc_id, about ``docs_per_shard`` each, and shards
are packed side by side; only (doc_id, tokens) travels, no text.  Rows of one doc_id and length are counted first and their
number is divided evenly over the shards, from the one of their hash on, so no doc_id makes a shard large.  A shard works on
counts per size, so a step costs one look-up, not a scan of the pieces.  Each shard leaves at most a few
sequences half-filled, which doesn't grow with the corpus.

Nulls, ties and odd rows: null and empty texts have no tokens and aren't packed; a very long text becomes as many pieces as it
needs; doc_id has to be a whole number (it is cast to long), and a null one
is packed as a null; equal sizes are taken in the order (doc_id, start), nulls last; repeated
rows are packed once each.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._arrow import grouped
from webloom.llm._tokens import counter
from webloom.session import prepare, written

_PACK = "shard int, pack int, used int, doc_ids array<long>, starts array<long>, tokens array<int>"


class _Sizes:
    """A multiset of sizes with the largest member up to a bound."""

    def __init__(self, counts: np.ndarray):
        self.n = counts
        self.below = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))
        self.find = self.below.tolist()

    def largest(self, most: int) -> int:
        """The largest size up to ``most``, or 0."""
        find, n, s = self.find, self.n, most
        path = []
        while (t := find[s]) and not n[t]:
            path.append(s)
            s = t - 1
        for p in path:
            find[p] = t
        return t

    def take(self, s: int) -> None:
        self.n[s] -= 1

    def put(self, s: int) -> None:
        """Give back a size that was just taken: everything up to the next larger member finds it again."""
        self.n[s] += 1
        if self.n[s] == 1:
            find = self.find
            for t in range(s, len(find)):
                if find[t] > s and self.n[find[t]]:
                    break
                if find[t] < s:
                    find[t] = s


def best_two(n: np.ndarray, gap: int, least: int) -> tuple[int, int] | None:
    """Sizes a >= b in stock with least < a + b <= gap and a + b as large as can be; the largest a among equals."""
    sizes = np.flatnonzero(n[: gap])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, gap - sizes, side="right") - 1
    b = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
    # a partner of the same size must be there twice; otherwise the next smaller size
    same = (b == sizes) & (n[sizes] < 2)
    b = np.where(same, np.where(at > 0, sizes[np.maximum(at - 1, 0)], 0), b)
    total = np.where((b > 0) & (b <= sizes), sizes + b, 0)
    k = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(sizes[k]), int(b[k])) if total[k] > least else None


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of sizes, each as the list of its sizes in the order they went in; sizes are 1 to capacity."""
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    stock, left, bins = _Sizes(n), len(sizes), []
    while left:
        room, out = capacity, []
        while room and (s := stock.largest(room)):
            stock.take(s)
            out.append(s)
            room -= s
        if room and len(out) > 1:
            last = out[-1]
            if pair := best_two(n, room + last, last):
                out[-1:] = pair
                for s in pair:
                    stock.take(s)
                stock.put(last)
        left -= len(out)
        bins.append(out)
    return bins


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    table = table.take(pa.array(np.repeat(np.arange(table.num_rows), np.asarray(table.column("n")))))
    ids, start, size = (table.column(c).combine_chunks() for c in ("doc_id", "start", "tokens"))
    null = np.asarray(ids.is_null())
    doc, start, size = np.asarray(ids.fill_null(0)), np.asarray(start), np.asarray(size)
    order = np.lexsort((start, doc, null, size))
    firsts = np.searchsorted(size[order], np.arange(capacity + 2))
    bins = best_two_fit(size, capacity)
    flat = np.array([s for b in bins for s in b], dtype=np.int64)
    by = np.argsort(flat, kind="stable")
    ordered = flat[by]
    nth = np.arange(len(flat)) - np.searchsorted(ordered, ordered)
    at = np.empty(len(flat), np.int64)
    at[by] = order[firsts[ordered] + nth]
    off = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bins])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, x) for x in (ids.take(pa.array(at)), pa.array(start[at]), pa.array(size[at].astype(np.int32)))]
    shard = pa.array(np.full(len(bins), table.column("shard")[0].as_py(), np.int32))
    return pa.table([shard, pa.array(np.arange(len(bins), dtype=np.int32)), pa.array([sum(b) for b in bins], pa.int32()), *lists], names=["shard", "pack", "used", "doc_ids", "starts", "tokens"])


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count(b.column("text")))], ["doc_id", "tokens"])


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, tokens) of every row; null texts have none."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_count, path=vocabulary), "doc_id long, tokens long")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_tokens: int = 1, docs_per_shard: int = 100_000) -> DataFrame:
    """(shard, pack, used, doc_ids, starts, tokens): a row for each sequence; the arrays run over its pieces."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counts = written(token_counts(docs, vocabulary).where("tokens > 0").withColumn("tokens", F.col("tokens") + end_tokens))
    shards = max(1, -(-counts.count() // docs_per_shard))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(capacity).cast("long"))).alias("start")
    same = counts.groupBy("doc_id", "tokens").agg(F.count("*").alias("n")).withColumn("over", F.least("n", F.lit(shards).cast("long")))
    dealt = same.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("over") - 1))).select(
        F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(shards)) + F.col("k"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "tokens", F.expr("n div over + if(k < n % over, 1, 0)").alias("n")
    )
    pieces = dealt.select("shard", "doc_id", "tokens", "n", starts).withColumn("tokens", F.least(F.lit(capacity), F.col("tokens") - F.col("start")).cast("int"))
    return pieces.groupBy("shard").applyInArrow(grouped(_pack, capacity=capacity), _PACK)

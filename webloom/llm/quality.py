"""Quality rules whose cutoffs come from labelled holdouts with a guarantee.

A rule is a measure of a text that is high for bad texts.  Its cutoff in a stratum (a language)
is taken from the labelled good documents of that stratum: a document is rejected when it lies
above the cutoff, and of good documents at most ``alpha`` may, for all rules and strata at once
with a probability of at least 1 - ``delta``.

The candidates are the order statistics of the n good documents, most cautious first.  For the
k-th largest value as cutoff, k - 1 holdout documents would be rejected, and the exact
(Clopper-Pearson) upper bound of the true rate is at most ``rate`` if and only if
P(Binomial(n, rate) <= k - 1) <= level.  As candidates are tried in a fixed order and the first
failure ends the search, they need no correction among themselves (fixed-sequence testing);
across rules and strata, delta is split evenly (Bonferroni), and so is alpha across rules, so
that the rate of a document failing *any* rule stays within alpha.  A stratum with too few
good labels for even the most cautious cutoff has no cutoff, and nothing in it is rejected.

Measures (shares are of words or characters; white space is space, \\t, \\n, \\v, \\f and \\r):
symbols (ASCII characters that are neither letters, digits, white space nor . , ; : ! ? ' " -),
shouting (all-ASCII words with two upper-case letters or more and no lower-case one), repetition (words equal to the
word before), tables (words that are a single |), and doubling (lines with a word that repeat an
earlier line of the text, but for white space at their ends).

Nulls, ties and odd rows: texts of any length are measured whole; null and empty texts have no measures and are rejected by the separate
rule ``empty``, which needs no cutoff; a value equal to the cutoff is kept; labels without
quality or doc_id are ignored, repeated ones count once per (doc_id, quality), and a doc_id labelled both
ways isn't used; a null lang is a stratum of its own; repeated rows are judged alike; other columns
are passed on, but ones named rejected or failed, in any case, give way.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import _text as X
from webloom.session import prepare, written

RULES = ("symbols", "shouting", "repetition", "tables", "doubling")
_MEASURES = T.StructType([T.StructField(r, T.DoubleType()) for r in RULES])

_ASCII_OK = np.zeros(256, bool)
_ASCII_OK[[*b".,;:!?'\"-", *b"0123456789", *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = ~_ASCII_OK & ~X._SPACE
_LEAD = np.zeros(256, bool)
_LEAD[:128] = _LEAD[192:] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text; of an empty one all are 0."""
    data, off = X.buffer(col)
    n = len(off) - 1
    if not len(data):
        return {r: np.zeros(n) for r in RULES}

    def run(marks: np.ndarray) -> np.ndarray:
        out = np.empty(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
        out[0] = 0
        np.cumsum(marks, out=out[1:])
        return out

    def per_row(total: np.ndarray, at: np.ndarray) -> np.ndarray:
        return total[at[1:]] - total[at[:-1]]

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    chars, symbols = X.byte_counts(col, [_LEAD & ~X._SPACE, _SYMBOL])
    starts, ends = X._bounds(data, off)
    first = np.searchsorted(starts, off)
    words = np.diff(first)
    up, low, high = run(_UPPER[data]), run(_LOWER[data]), run(_HIGH[data])
    loud = (up[ends] - up[starts] >= 2) & (low[ends] == low[starts]) & (high[ends] == high[starts])
    hashes = X.span_hashes(data, starts, ends)
    row_start = np.zeros(len(starts) + 1, bool)
    row_start[first[:-1]] = True
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~row_start[1:-1]
    bars = (ends - starts == 1) & (data[starts] == 124)
    # lines: cut at \n and at row ends, kept if they hold a word
    breaks = np.union1d(np.flatnonzero(data == 10), off)
    line = np.searchsorted(breaks, starts, side="right")
    new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(starts) else np.empty(0, np.int64)
    at = np.searchsorted(new, first)
    lines = np.diff(at)
    content = X.span_hashes(data, starts[new], ends[np.append(new[1:], len(starts)) - 1]) if len(new) else np.empty(0, np.uint64)
    row = np.repeat(np.arange(n), lines)
    order = np.lexsort((content, row))
    twice = np.zeros(len(order), bool)
    twice[1:] = (content[order][1:] == content[order][:-1]) & (row[order][1:] == row[order][:-1])
    copies = np.bincount(row[order][twice], minlength=n)
    return {
        "symbols": share(symbols, chars),
        "shouting": share(per_row(run(loud), first), words),
        "repetition": share(per_row(run(again), first), words),
        "tables": share(per_row(run(bars), first), words),
        "doubling": share(copies, lines),
    }


@F.arrow_udf(_MEASURES)
def measures(text: pa.Array) -> pa.Array:
    found = measure(text)
    return pa.StructArray.from_arrays([pa.array(found[r]) for r in RULES], names=list(RULES))


def cautious_rank(n: int, rate: float, level: float) -> int:
    """The largest k for which P(Binomial(n, rate) <= k - 1) <= level; 0 if there is none."""
    if n == 0 or not 0 < rate < 1:
        return 0
    total, log_p = 0.0, n * math.log1p(-rate)
    for k in range(n + 1):
        total += math.exp(log_p)
        if total > level:
            return k
        log_p += math.log(n - k) - math.log(k + 1) + math.log(rate) - math.log1p(-rate) if k < n else 0.0
    return n


def thresholds(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, broadcast_rows: int = 200_000) -> DataFrame:
    """(stratum, rule, n, k, cutoff): one row for each stratum with good labels, and rule; a null cutoff rejects nothing.

    Up to ``broadcast_rows`` good labels (some 15 MB as a hash table) are broadcast, and only their documents measured; beyond that all documents are
    measured and their measures joined.  What comes to the driver is the number of good labels of each stratum.
    """
    spark = prepare(docs.sparkSession)
    kinds = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__wl_id")).agg(F.min("quality").alias("lo"))
    good = written(kinds.where("lo = 1").select("__wl_id"))
    texts, match = docs.where("text <> ''"), F.col("doc_id") == F.col("__wl_id")
    found = [F.col(stratum).cast("string").alias("stratum"), measures(F.col("text").cast("string")).alias("m")]
    if good.count() <= broadcast_rows:
        held = texts.join(F.broadcast(good), match, "left_semi").select(*found)
    else:
        # measures first, so that the join moves them and not the texts; an inner join, as a semi-join would be pushed below them
        held = texts.select("doc_id", *found).join(good, match)
    rows = written(held.select("stratum", *[f"m.{r}" for r in RULES]))
    counts = rows.groupBy("stratum").count().collect()
    rate, level = alpha / len(RULES), delta / (len(RULES) * max(1, len(counts)))
    ranks = spark.createDataFrame([(r["stratum"], r["count"], cautious_rank(r["count"], rate, level)) for r in counts], "stratum string, n long, k int")
    long = rows.select("stratum", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])))
    wanted = ranks.withColumn("rule", F.explode(F.array(*map(F.lit, RULES))))
    cut = _kth_largest(written(long.groupBy("stratum", "rule", "v").agg(F.count("*").alias("c"))), wanted.where("k > 0"))
    here = wanted["stratum"].eqNullSafe(cut["stratum"]) & (wanted["rule"] == cut["rule"])
    return wanted.join(F.broadcast(cut), here, "left").select(wanted["stratum"], wanted["rule"], "n", wanted["k"], "cutoff")


def _kth_largest(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stratum, rule, cutoff): the k-th largest of the values (stratum, rule, v, c), c times each, for every (stratum, rule, k).

    The range is narrowed twice to the cell of a grid that holds the k-th value, so that no task sorts the values of a stratum:
    a window runs over the 4,096 cells of a step of 2**-12, 16,384 of 2**-26 in one of them, and the values in one of these.
    Shares of up to a million words or characters have a few thousand values in so small a cell.
    """
    order = Window.partitionBy("stratum", "rule")
    for bits in (12, 26, None):
        named = wanted.select(F.col("stratum").alias("__wl_s"), F.col("rule").alias("__wl_r"), *[c for c in wanted.columns if c not in ("stratum", "rule")])
        same = F.col("stratum").eqNullSafe(F.col("__wl_s")) & (F.col("rule") == F.col("__wl_r"))
        if "cell" in wanted.columns:
            same &= F.floor(F.col("v") * F.col("scale")) == F.col("cell")
        left = values.join(F.broadcast(named), same).select("stratum", "rule", "v", "c", "k")
        at = F.col("v") if bits is None else F.floor(F.col("v") * (1 << bits))
        sums = left.groupBy("stratum", "rule", "k", at.alias("cell")).agg(F.sum("c").alias("c"))
        upto = sums.withColumn("upto", F.sum("c").over(order.orderBy(F.col("cell").desc())))
        hit = upto.where("upto >= k and upto - c < k").withColumn("k", F.expr("k - (upto - c)"))
        wanted = written(hit.select("stratum", "rule", "k", "cell", F.lit(float(1 << (bits or 0))).alias("scale")))
    return wanted.select("stratum", "rule", F.col("cell").alias("cutoff"))


def judge(docs: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs with ``failed``, the rules each row fails, and ``rejected``; at most a few rows per stratum are broadcast."""
    prepare(docs.sparkSession)
    table = cutoffs.groupBy(F.col("stratum").alias("__wl_s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__wl_c"))
    keep = [c for c in docs.columns if c.lower() not in ("rejected", "failed")]
    base = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("__wl_m", measures(F.col("text").cast("string")))
    joined = base.join(F.broadcast(table), F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col("__wl_s")), "left")
    empty = F.coalesce(F.col("text").cast("string"), F.lit("")) == ""

    def fails(rule: str) -> Column:
        return F.when(F.coalesce(F.col("__wl_m")[rule] > F.col("__wl_c")[rule], F.lit(False)), F.lit(rule))

    failed = F.when(empty, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*[fails(r) for r in RULES])))
    return joined.select(*[F.col(f"`{c}`") for c in keep], failed.alias("failed")).withColumn("rejected", F.size("failed") > 0)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    return judge(docs, written(thresholds(docs, labels, stratum, alpha, delta)), stratum)

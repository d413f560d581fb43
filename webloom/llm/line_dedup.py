"""Line deduplication over a sharded minimal perfect hash.

Lines that occur more than ``max_count`` times in the corpus, repeats within a document
included, stay only where they occur first: in the document with the smallest doc_id, once.
The hashes of all distinct lines go into a sharded index (see ``_index``) of compact fingerprints and counts.  Documents
probe these arrays by hash, each chunk of the corpus once for each of its distinct lines, and get back which of them are
over the limit; neither texts nor lines are joined or shuffled.
Two different lines are taken for one with a probability of 2**-32 a probe.

Lines are split at \\n and compared without spaces at their ends.  Blank lines never count and
always stay.  A document whose lines all go is dropped; null and empty texts stay as they are; a text of any length is
taken whole.  A null doc_id sorts last: a repeated line that only such rows hold stays in all of them.  Rows
that repeat the first doc_id of a line each keep it.  doc_id has to be a whole number (it is compared as long).
``n_chars``, if there, follows a changed text; all other columns are passed on, but one named lines_removed, in any case,
gives way to the result's.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm._index import Answers, chunked, indexed_answers
from webloom.session import prepare

_LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _marks(lines: Column) -> Column:
    """The hash of each line; null for a blank one."""
    return F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def _kept(path: str) -> Callable[..., Column]:
    """The numbers of the lines that stay, or null where all do."""

    @F.arrow_udf("array<int>")
    def kept(hashes: pa.Array, owner: pa.Array, chunk: pa.Array) -> pa.Array:
        sizes = np.asarray(hashes.value_lengths().fill_null(0))
        values = hashes.flatten()
        blank = np.asarray(values.is_null())
        keys = np.asarray(values.fill_null(0)).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit, first = Answers.at(path).probe(keys, np.asarray(chunk)[row])
        keep = blank | ~hit
        mine = np.flatnonzero(~keep & (first == np.asarray(owner)[row]))
        if len(mine):
            order = mine[np.lexsort((at[mine], keys[mine], row[mine]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])
            keep[order[new]] = True
        same = np.bincount(row[keep], minlength=len(sizes)) == sizes
        keep &= ~same[row]
        off = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(sizes)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(at[keep].astype(np.int32)), mask=pa.array(same))

    return kept.asNondeterministic()  # or the filter below would be moved under it, with the call and the lambdas a second time


def line_counts(docs: DataFrame) -> DataFrame:
    """(chunk, h, n, owner) of every distinct line that isn't blank, for each chunk that holds it."""
    rows = docs.select(F.col("__wl_chunk").alias("chunk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("owner"), F.explode(_lines(F.col("text"))).alias("line"))
    hashed = rows.where(F.trim("line") != "").select("chunk", "owner", F.xxhash64(F.trim("line")).alias("h"))
    return hashed.groupBy("chunk", "h").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))


def line_dedup(docs: DataFrame, max_count: int = 6, keys_per_shard: int = 500_000) -> DataFrame:
    """The documents with repeated lines taken out of ``text``, and ``lines_removed``."""
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != "lines_removed"]
    base = chunked(docs.select(*[F.col(f"`{c}`") for c in names]))
    path = indexed_answers(line_counts(base), max_count, keys_per_shard)
    # the lines are a column of their own: inside the lambda below, text would be split again for each line
    split = base.withColumn("__wl_lines", _lines(F.col("text")))
    probed = split.withColumn("__wl_kept", _kept(path)(_marks(F.col("__wl_lines")), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.col("__wl_chunk")))
    gone = F.when(F.col("__wl_kept").isNull(), 0).otherwise(F.size("__wl_lines") - F.size("__wl_kept"))
    text = F.when(F.col("__wl_kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__wl_kept", lambda i: F.get(F.col("__wl_lines"), i)), "\n"))
    out = probed.withColumn("__wl_text", text).withColumn("__wl_gone", gone)
    left = (F.col("__wl_gone") == 0) | F.col("__wl_text").rlike("[^ \n]")
    new = {"text": F.col("__wl_text"), "n_chars": F.when(F.col("__wl_gone") == 0, F.col("n_chars")).otherwise(F.length("__wl_text"))}
    return out.where(left).select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in names], F.col("__wl_gone").alias("lines_removed"))

"""Near-duplicate embeddings by p-stable (Euclidean) locality-sensitive hashing.

Vectors are scaled to length 1, where cosine and distance say the same: |x - y|^2 = 2 - 2 cos.  A
hash is floor((a.x + b) / width) with a normal vector a and a uniform b; ``m`` of them make a bucket
key, and L tables of keys make up for misses.  Two vectors at distance c agree on one hash with

    p(c) = 1 - 2 Phi(-w/c) - 2c / (sqrt(2 pi) w) (1 - exp(-w^2 / 2c^2)),

so m = ln(4n) / ln(1 / p(far)), rounded up, leaves at most a quarter of a chance partner per vector and table at any n
(a candidate costs several times what a key costs), and
L = ln(1 - recall) / ln(1 - p(near)^m) finds a pair at the threshold with probability ``recall``
(closer pairs more surely).  Candidates share a bucket; each pair is then checked by its exact cosine.

Equal (scaled) vectors are collapsed first, and the result has one row for each vector: (vec_id, class_id, copies,
links).  ``links`` is the number of other vec_ids within the threshold, each checked; ``copies`` the number of vec_ids
with an equal vector, itself included; ``class_id`` the smallest vec_id that links lead to.  ``vector_pairs`` lists the
pairs of different vectors.

Nulls, ties and odd rows: rows without vec_id, with a null or empty embedding, with a null, NaN or
infinite element or of length zero are left out; vectors of different dimensions never pair; a vec_id that repeats with
equal vectors is one, with different vectors it has a row for each, which share a class.  vec_id has to be a whole number.
Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import _text as X
from webloom.llm._links import classes, verified
from webloom.session import prepare, written

_FAR = math.sqrt(2)


def collision(c: float, width: float) -> float:
    """The probability that one hash puts two vectors at distance c into one bucket."""
    if c <= 0:
        return 1.0
    t = width / c
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float, recall: float, width: float) -> tuple[int, int]:
    """(hashes a key, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(_FAR, width)
    m = max(1, math.ceil(math.log(4 * max(n, 2)) / -math.log(far)))
    hit = near**m
    return m, 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of length 1 from lists of one size."""
    x = np.asarray(col.flatten()).astype(np.float64).reshape(len(col), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, v → (sig, id, v) of the usable rows; sig is a hash of the scaled vector, rounded to 9 digits."""
    for b in batches:
        b = b.filter(pc.and_(pc.is_valid(b.column("vec_id")), pc.greater(pc.fill_null(pc.list_value_length(b.column("v")), 0), 0)))
        sizes = np.asarray(b.column("v").value_lengths())
        sigs, ok = np.zeros(len(b), np.uint64), np.zeros(len(b), bool)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
            with np.errstate(all="ignore"):
                length = np.sqrt(np.einsum("ij,ij->i", x, x))
                good = np.isfinite(x).all(axis=1) & np.isfinite(length) & (length > 0)
                cells = np.rint(x[good] / length[good, None] * 1e9).astype(np.int64).view(np.uint64)
            place = np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            sigs[at[good]] = X.mix(X.mix(cells ^ place).sum(axis=1, dtype=np.uint64) + np.uint64(dim))
            ok[at[good]] = True
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([pa.array(sigs[ok].view(np.int64)), b.column("vec_id").take(keep), b.column("v").take(keep)], ["sig", "id", "v"])


def _keys(batches: Iterator[pa.RecordBatch], m: int, tables: int, width: float, seed: int) -> Iterator[pa.RecordBatch]:
    """sig, v → (key, sig) for each table; one dimension's projections are drawn once."""
    drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        sizes = np.asarray(b.column("v").value_lengths())
        sigs = b.column("sig").to_numpy()
        for dim in np.unique(sizes):
            if dim not in drawn:
                rng = np.random.default_rng([seed, int(dim)])
                drawn[dim] = rng.standard_normal((int(dim), tables * m)), rng.uniform(0, width, tables * m)
            a, shift = drawn[dim]
            at = np.flatnonzero(sizes == dim)
            for part in np.array_split(at, max(1, len(at) * tables * m // 4_000_000)):
                x = _matrix(b.column("v").take(pa.array(part)))
                cell = np.floor((x @ a + shift) / width).astype(np.int64).reshape(len(part), tables, m).view(np.uint64)
                h = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim), cell.shape[:2]).copy()
                for j in range(m):
                    h = (h ^ cell[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(sigs[part], tables))], ["key", "sig"])


def _near(pairs: pa.Table, sets: pa.Table, threshold: float) -> pa.Table:
    """The pairs of a block whose cosine is at least the threshold."""
    sig, v = sets.column("sig").to_numpy(), sets.column("v").combine_chunks()
    order = np.argsort(sig)
    a, b = (order[np.searchsorted(sig[order], pairs.column(c).to_numpy())] if len(sig) else np.empty(0, np.int64) for c in ("sig_a", "sig_b"))
    sizes, ok = np.asarray(v.value_lengths()), np.zeros(len(a), bool)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x, row = _matrix(v.take(pa.array(at))), np.full(len(sizes), -1, np.int64)
        row[at] = np.arange(len(at))
        mine = np.flatnonzero((row[a] >= 0) & (row[b] >= 0))
        for part in np.array_split(mine, len(mine) * int(dim) // 2_000_000 + 1):
            ok[part] = np.einsum("ij,ij->i", x[row[a[part]]], x[row[b[part]]]) >= threshold
    ok = pa.array(ok)
    return pairs.select(["sig_a", "sig_b"]).filter(ok)


def _sets(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, sets): (sig, id) of each usable vector, and (sig, v) of each different one."""
    prepare(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    base = written(rows.mapInArrow(_named, f"sig long, id long, v {kind}"))
    return base.select("sig", "id").distinct(), written(base.groupBy("sig").agg(F.first("v").alias("v")))


def _links(sets: DataFrame, threshold: float, recall: float, width: float, seed: int) -> DataFrame:
    if threshold == 1:  # only equal vectors
        return sets.sparkSession.createDataFrame([], "sig_a long, sig_b long")
    m, tables = plan(sets.count(), threshold, recall, width)
    keys = sets.mapInArrow(partial(_keys, m=m, tables=tables, width=width, seed=seed), "key long, sig long")
    a, b = keys.withColumnRenamed("sig", "sig_a"), keys.withColumnRenamed("sig", "sig_b")
    pairs = a.join(b, "key").where("sig_a < sig_b").select("sig_a", "sig_b").distinct()
    return verified(pairs, sets, _near, threshold=threshold)


def _check(threshold: float, recall: float, width: float) -> None:
    if not 0 < threshold <= 1 or not 0 < recall < 1 or width <= 0:
        raise ValueError("threshold must be in (0, 1], recall in (0, 1) and width positive")


def embedding_near_dup(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, width: float = 1.6, seed: int = 7) -> DataFrame:
    """(vec_id, class_id, copies, links) of every usable vector."""
    _check(threshold, recall, width)
    members, sets = _sets(vectors)
    info = members.groupBy("sig").agg(F.min("id").alias("name"), F.count("*").alias("n"))
    return classes(members, info, _links(sets, threshold, recall, width, seed)).withColumnRenamed("id", "vec_id")


def vector_pairs(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, width: float = 1.6, seed: int = 7) -> DataFrame:
    """(vec_a, vec_b) for each linked pair of different vectors, named by their smallest vec_ids; vec_a < vec_b."""
    _check(threshold, recall, width)
    members, sets = _sets(vectors)
    a, b = (members.groupBy(F.col("sig").alias(f"sig_{x}")).agg(F.min("id").alias(f"name_{x}")) for x in "ab")
    linked = _links(sets, threshold, recall, width, seed).join(a, "sig_a").join(b, "sig_b").where("name_a <> name_b")
    return linked.select(F.least("name_a", "name_b").alias("vec_a"), F.greatest("name_a", "name_b").alias("vec_b"))

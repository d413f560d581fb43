"""Mixing documents to target domain weights by soft membership.

Domains are the classes of the labels table: clean (good quality, not toxic), low (bad quality)
and toxic.  A softmax classifier over hashed words and two texture shares, fitted on a bounded
sample of labelled rows (``sample_rows``, the smallest hashes of doc_id among the labels of
documents that are there), gives every document
posteriors p_k.  With t tokens, document i brings t_i p_ik expected tokens to domain k, and
rates r_i >= 0 are sought for which the totals meet the targets: least squares over

    sum_k (sum_i r_i t_i p_ik - target_k)^2 + pull sum_i t_i (r_i - 1)^2        (totals as shares of all tokens)

by projected gradient with momentum, in the metric that weighs each document by its tokens.  Rates depend on a document's
posteriors only, so documents whose posteriors fall into the same cell of a grid (steps of 1/256) share a rate: one
distributed aggregation gives the tokens and expected domain tokens of every cell, exact integers that don't depend on the
order of tasks, and the iteration runs over the cells, at most 33,153 at any size of the corpus, until
the projected gradient vanishes; there is no limit of steps.  The small pull towards 1 makes the solution unique and
r = max(0, 1 - p.gap / pull), so documents of like posteriors have like rates: without it, a target that hardly any
document serves is met by giving a few of them hundreds of copies and none to all others.  It costs a gap of about pull
times the change of rates (1e-3 of the tokens for rates of 2).
``budget`` is the sum of the targets in units of the corpus's tokens.  Where the targets can't be met with rates of 0 or
more, the result is the nearest mix.

Rates turn into copies by a hash of doc_id: floor(r) or one more, with the right expectation, so
a rerun repeats itself.

Nulls, ties and odd rows: null and empty texts have no tokens; they get the posteriors of an
empty text and the rate that follows; texts of any length are taken whole; doc_id has to be a whole number where labels are given (it is cast to long for the sample); null doc_ids hash alike; repeated rows each
count and get the same rate; labels with nulls are ignored, and of several labels for a doc_id the
worst counts; of rows that repeat a labelled doc_id, the fit takes one, that whose text has the smallest hash, so that it never sees more than
``sample_rows``.  Extra columns are passed on by ``mixed``, but those named like its own, in any case, give way.
Without labels of two classes the posteriors are uniform over the domains.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import _text as X
from webloom.llm._arrow import grouped
from webloom.llm._tokens import counter
from webloom.session import prepare, written

DOMAINS = ("clean", "low", "toxic")
_BITS = 18
_DIM = (1 << _BITS) + 3
_PIPE = np.zeros(256, bool)
_PIPE[[*b"#$%&()*+/<=>@[\\]^_`{|}~"]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, first feature of each row): words by hash, scaled to length 1, two shares and a constant."""
    data, off = X.buffer(pc.utf8_lower(col))
    starts, ends = X._bounds(data, off) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
    first, rows = np.searchsorted(starts, off), len(off) - 1
    for _ in range(2):  # marks at the edges don't belong to a word, unless it is nothing else
        starts = starts + (_MARK[data[starts]] & (ends - starts > 1))
        ends = ends - (_MARK[data[ends - 1]] & (ends - starts > 1))
    hashes = X.span_hashes(data, starts, ends)
    row = np.repeat(np.arange(rows), np.diff(first))
    slot = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
    code, count = np.unique(row * (1 << _BITS) + slot, return_counts=True)
    r, f = code >> _BITS, code & ((1 << _BITS) - 1)
    v = np.log1p(count)
    norm = np.sqrt(np.bincount(r, v * v, rows))
    v = v / norm[r]
    symbols, upper, chars = X.byte_counts(col, [_PIPE, _UPPER, ~X._SPACE])
    repeat = np.zeros(rows)
    if len(hashes):
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        repeat = np.bincount(row, same, rows) / np.maximum(np.diff(first), 1)
    dense = np.stack([(symbols + upper) / np.maximum(chars, 1), repeat, np.ones(rows)], axis=1)
    n = np.bincount(r, minlength=rows)
    out_first = np.concatenate([[0], np.cumsum(n + 3)])
    feature, value = np.empty(out_first[-1], np.int32), np.empty(out_first[-1], np.float32)
    at = out_first[:-1][r] + (np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n))
    feature[at], value[at] = f, v
    for k in range(3):
        feature[out_first[1:] - 3 + k], value[out_first[1:] - 3 + k] = (1 << _BITS) + k, dense[:, k]
    return feature, value, out_first


def _scores(feature: np.ndarray, value: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    each = weights[feature] * value[:, None]
    return np.add.reduceat(each, first[:-1], axis=0) if len(first) > 1 else np.empty((0, weights.shape[1]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(feature: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-4) -> np.ndarray:
    """Softmax weights (features x domains) by a set number of full-batch gradient steps with per-feature scaling.

    Features enter in proportion to how far their presence moves the odds of a domain, so that rare
    telling words count and the many that tell nothing don't drown them.
    """
    k, n = len(DOMAINS), len(y)
    hot, row = np.eye(k)[y], np.repeat(np.arange(n), np.diff(first))
    here = np.stack([np.bincount(feature, hot[row, j] * (value > 0), _DIM) for j in range(k)], axis=1) + 1.0
    size, total = hot.sum(axis=0) + 2.0, here.sum(axis=1, keepdims=True)
    tell = np.abs(np.log((here / size) / ((total - here) / (size.sum() - size)))).max(axis=1)
    tell[-3:] = 2.0
    value = value * tell[feature]
    weights, seen = np.zeros((_DIM, k)), np.full((_DIM, 1), 1e-6)
    for _ in range(steps):
        error = _softmax(_scores(feature, value, first, weights)) - hot
        grad = np.stack([np.bincount(feature, error[row, j] * value, _DIM) for j in range(k)], axis=1) / n + ridge * weights
        seen += (grad**2).mean(axis=1, keepdims=True)
        weights -= 0.5 * grad / np.sqrt(seen)
    return weights * tell[:, None]


def _packed() -> Callable[[Column], Column]:
    """A text's features as bytes, so that the fitting task gets them and no texts."""

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        feature, value, first = features(text)
        return pa.array([feature[a:z].tobytes() + value[a:z].tobytes() for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())

    return packed


def _fit(table: pa.Table) -> pa.Table:
    order = np.argsort(np.asarray(table.column("doc_id")), kind="stable")
    y, raw = np.asarray(table.column("y")).astype(np.int64)[order], table.column("f").to_pylist()
    raw = [raw[i] for i in order.tolist()]
    if len(np.unique(y)) < 2:
        weights = np.zeros((_DIM, len(DOMAINS)))
    else:
        n = [len(x) // 8 for x in raw]
        feature = np.concatenate([np.frombuffer(x, np.int32, k) for x, k in zip(raw, n, strict=True)])
        value = np.concatenate([np.frombuffer(x, np.float32, k, 4 * k) for x, k in zip(raw, n, strict=True)])
        weights = fit(feature, value, np.concatenate([[0], np.cumsum(n)]), y)
    return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary())})


def classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000) -> bytes:
    """The weights, fitted by one task on at most ``sample_rows`` labelled documents; 3 MB come to the driver."""
    prepare(docs.sparkSession)
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("__wl_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    y = F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    there = worst.join(texts.select(F.col("doc_id").alias("__wl_there")), F.col("__wl_id") == F.col("__wl_there"), "left_semi")
    chosen = there.select("__wl_id", y.cast("int").alias("y")).orderBy(F.xxhash64("__wl_id"), "__wl_id").limit(sample_rows)
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["__wl_id"]).select("doc_id", "y", F.xxhash64("text").alias("h"), _packed()(F.col("text")).alias("f"))
    rows = found.groupBy("doc_id", "y").agg(F.min(F.struct("h", "f")).alias("one")).select("doc_id", "y", "one.f")
    got = rows.withColumn("__wl_all", F.lit(0)).groupBy("__wl_all").applyInArrow(grouped(_fit), "weights binary").collect()
    return bytes(got[0][0]) if got else np.zeros((_DIM, len(DOMAINS)), np.float32).tobytes()


_SCORED = T.StructType([T.StructField("tokens", T.LongType()), *(T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS)])


def _scorer(raw: bytes, vocabulary: str) -> Callable[[Column], Column]:
    @F.arrow_udf(_SCORED)
    def scored(text: pa.Array) -> pa.Array:
        p = _softmax(_scores(*features(text), np.frombuffer(raw, np.float32).reshape(_DIM, -1)).astype(np.float64))
        return pa.StructArray.from_arrays([pa.array(counter(vocabulary)(text)), *[pa.array(p[:, k]) for k in range(len(DOMAINS))]], fields=list(pa.schema([("tokens", pa.int64()), *((f"p_{d}", pa.float64()) for d in DOMAINS)])))

    return scored


def posteriors(docs: DataFrame, weights: bytes, vocabulary: str) -> DataFrame:
    """docs and tokens, p_clean, p_low and p_toxic."""
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in _SCORED.names]
    base = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("__wl_s", _scorer(weights, vocabulary)(F.col("text").cast("string")))
    return base.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__wl_s.{n}").alias(n) for n in _SCORED.names])


_GRID = 256
_UNIT = 1 << 16


def _cell() -> Column:
    low, toxic = (F.floor(F.col(f"p_{d}") * _GRID) for d in DOMAINS[1:])
    return (toxic * (_GRID + 1) + low).cast("int")


def cells(scored: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, tokens, expected tokens of each domain) of the cells in use; sums are integers in units of 1/65536 token."""
    mass = [F.sum(F.round(F.col("tokens") * F.col(f"p_{d}") * _UNIT).cast("long")).alias(d) for d in DOMAINS]
    got = scored.groupBy(_cell().alias("cell")).agg(*mass).orderBy("cell").toArrow()
    w = np.stack([got.column(d).to_numpy().astype(np.float64) for d in DOMAINS], axis=1) / _UNIT
    return got.column("cell").to_numpy(), w.sum(axis=1), w


def solve(cell: np.ndarray, tokens: np.ndarray, mass: np.ndarray, goal: np.ndarray, pull: float = 1e-3) -> np.ndarray:
    """The rate of each cell, for expected totals of ``goal`` in units of all tokens; projected gradient with momentum and
    restarts, to stationarity.
    """
    rate, total = np.ones(len(cell)), tokens.sum()
    if not total:
        return rate
    middle = np.stack([cell % (_GRID + 1), cell // (_GRID + 1)], axis=1) / _GRID + 0.5 / _GRID
    middle = np.column_stack([np.maximum(0, 1 - middle.sum(axis=1)), middle])  # for cells of empty texts only
    p = np.where(tokens[:, None] > 0, mass / np.maximum(tokens, 1e-9)[:, None], middle)
    top = np.linalg.eigvalsh((mass.T @ p) / total)[-1] + pull
    look, last, turn, best, stale = rate, np.inf, 1.0, np.inf, 0
    while stale < 2000:  # beyond that, the loss no longer falls in floating point
        new = np.maximum(0.0, look - (p @ ((mass.T @ look) / total - goal) + pull * (look - 1)) / top)
        moved = np.abs(new - look).max()
        gap = (mass.T @ new) / total - goal
        loss = float(gap @ gap) + pull * float((tokens * (new - 1) ** 2).sum() / total)
        if loss > last:
            turn = 1.0
        after = (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        look = new + (turn - 1) / after * (new - rate)
        rate, last, turn = new, loss, after
        if moved <= 1e-10:
            break
        best, stale = (loss, 0) if loss < best * (1 - 1e-14) else (best, stale + 1)
    return rate


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], vocabulary: str, budget: float = 1.0, sample_rows: int = 6_000, pull: float = 1e-3, texts: bool = True) -> DataFrame:
    """docs with tokens, p_clean, p_low, p_toxic, rate and copies; ``repeated`` makes the copies."""
    if budget <= 0 or pull <= 0 or min(targets.values()) < 0 or sum(targets.get(d, 0) for d in DOMAINS) <= 0:
        raise ValueError("budget and pull must be positive, targets not negative and their sum positive")
    keep = [c for c in docs.columns if c.lower() not in ("rate", "copies") and (texts or c != "text")]
    scored = posteriors(docs, classifier(docs, labels, sample_rows), vocabulary)
    table = written(scored.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*(k for k in keep if k.lower() not in _SCORED.names), *_SCORED.names])]))
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    found = cells(table)
    rates = docs.sparkSession.createDataFrame(list(zip(found[0].tolist(), solve(*found, share / share.sum() * budget, pull).tolist(), strict=True)), "__wl_cell int, rate double")
    rated = table.withColumn("__wl_cell", _cell()).join(F.broadcast(rates), "__wl_cell").drop("__wl_cell")
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], vocabulary: str, budget: float = 1.0, sample_rows: int = 6_000, pull: float = 1e-3) -> DataFrame:
    """(doc_id, tokens, p_clean, p_low, p_toxic, rate, copies) of every row."""
    return mixed(docs.select("doc_id", "text"), labels, targets, vocabulary, budget, sample_rows, pull, texts=False)


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its copies say; the columns that ``mixed`` added go."""
    added = (*_SCORED.names, "rate", "copies")
    return rows.where("copies > 0").withColumn("__wl_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in rows.columns if c not in added])

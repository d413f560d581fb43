"""Language identification by hashed character n-grams.

A text becomes a vector of ``size`` buckets: its letters, and single spaces for runs of white
space, are hashed as 1- to 5-grams (32-bit FNV-1a over code points, folded to 8 bits), and
counts are scaled by 256 / (characters kept), at most 255.  A language profile is the mean vector
of its examples, and the nearest profile by absolute distance wins.

Vectors are made in bulk: a whole Arrow batch is one array of code points.  Nulls give null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SIZE = 256
UNKNOWN = "unknown"
_FNV_START, _FNV_PRIME = np.uint32(2166136261), np.uint32(16777619)
_PART = 4_000_000
_LANGS = 1000  # as many sums are held by a task at most


@cache
def _kinds() -> np.ndarray:
    """0: dropped, 1: letter, 2: white space, by code point."""
    kinds = np.zeros(0x110000, np.int8)
    kinds[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
    kinds[[i for i in range(0x110000) if chr(i).isspace()]] = 2
    return kinds


def _fold(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint32(8)) ^ h) & np.uint32(0xFF)


def vectors(texts: Sequence[str | None], size: int = SIZE) -> np.ndarray:
    """One row of ``size`` buckets for each text; zeros for a null."""
    out = np.zeros((len(texts), size), np.int64)
    at = 0
    while at < len(texts):
        total, to = 0, at
        while to < len(texts) and (to == at or total + len(texts[to] or "") <= _PART):
            total += len(texts[to] or "")
            to += 1
        _fill(out[at:to], texts[at:to], size)
        at = to
    return out


def _fill(out: np.ndarray, texts: Sequence[str | None], size: int) -> None:
    lengths = np.array([len(t or "") for t in texts])
    if not lengths.sum():
        return
    cps = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    kind = _kinds()[cps]
    space = kind == 2
    after = np.zeros(len(cps), bool)
    after[1:] = space[:-1] & (row[1:] == row[:-1])
    keep = (kind == 1) | (space & ~after)
    cps, row = np.where(space, np.uint32(32), cps)[keep], row[keep]
    kept = np.bincount(row, minlength=len(texts))
    base, counts = row * size, np.zeros(len(texts) * size + 1, np.int64)
    ends, h = np.cumsum(kept), np.full(len(cps), _FNV_START, np.uint32)
    for n in range(1, 6):
        if len(cps) < n:
            break
        h = (h[: len(cps) - n + 1] ^ cps[n - 1 :]) * _FNV_PRIME  # the n-gram from the (n-1)-gram that begins there
        bucket = _fold(h)
        at = base[: len(h)] + (bucket if size > 255 else bucket % np.uint32(size))
        for j in range(1, n):  # those that would reach into the next text count behind the others
            over = ends - j
            at[over[(over >= 0) & (over < len(at))]] = len(counts) - 1
        counts += np.bincount(at, minlength=len(counts))
    counts = counts[:-1]
    np.minimum(255, counts.reshape(out.shape) * 256 // np.maximum(kept, 1)[:, None], out=out)


def language_vector(text: str | Column, size: int = SIZE) -> Column:
    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        v = vectors(texts.to_pylist(), size).astype(np.int32)
        off = pa.array(np.arange(len(v) + 1, dtype=np.int32) * size, mask=None)
        lists = pa.ListArray.from_arrays(off, pa.array(v.ravel()), mask=texts.is_null() if texts.null_count else None)
        return lists

    return found(F.col(text) if isinstance(text, str) else text)


def normalise(text: str | Column) -> Column:
    """The characters that count, natively: runs of white space as one space, then all but letters and spaces dropped."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(col, r"[\p{IsWhite_Space}\x1c-\x1f]+", " "), r"[^\p{L} ]", "")


def distance(a: str | Column, b: str | Column) -> Column:
    """The sum of absolute differences of two vectors, natively."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def train_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, n, vector): the mean vector of each language's examples, rounded down, at most 255; a sum for each task, one shuffle of them."""
    kind = docs.select(F.col(lang)).schema[0].dataType

    def add(parts):
        sums: dict = {}
        for b in parts:
            langs = b.column("lang").to_pylist()
            v = vectors(b.column("text").to_pylist(), size)
            for x in set(langs):
                own = [y == x for y in langs]
                n, s = sums.get(x, (0, 0))
                sums[x] = n + sum(own), s + v[own].sum(axis=0)
            if len(sums) > _LANGS:
                yield from out(sums)
                sums = {}
        yield from out(sums)

    def out(sums):
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "n": [n for n, _ in sums.values()], "v": [s.tolist() for _, s in sums.values()]}, pa.schema([("lang", to_arrow_type(kind)), ("n", pa.int64()), ("v", pa.list_(pa.int64()))]))

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts = rows.mapInArrow(add, T.StructType([T.StructField("lang", kind), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.LongType()))]))
    sums = parts.select("lang", "n", F.posexplode("v").alias("bucket", "v")).groupBy("lang", "bucket").agg(F.sum("v").alias("s"), F.sum("n").alias("n"))
    each = F.struct("bucket", F.least(F.floor(F.col("s") / F.col("n")), F.lit(255)).cast("int").alias("value"))
    return sums.groupBy("lang").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(each)).alias("pairs")).select("lang", "n", F.transform("pairs", lambda p: p["value"]).alias("vector"))


class Profiles:
    """Profiles in the order that breaks ties on short texts: most common language first."""

    def __init__(self, langs: Sequence[str], vecs: np.ndarray):
        self.langs, self.vecs = list(langs), np.asarray(vecs, np.int64).reshape(len(langs), -1)

    @classmethod
    def of(cls, trained: DataFrame) -> Profiles:
        """From ``train_profiles``: one row for each language comes to the driver."""
        rows = trained.orderBy(F.col("n").desc(), "lang").collect()
        return cls([r["lang"] for r in rows], np.array([r["vector"] for r in rows]) if rows else np.zeros((0, SIZE)))

    @classmethod
    def train(cls, examples: dict[str, Sequence[str]], size: int = SIZE) -> Profiles:
        return cls(list(examples), np.array([np.minimum(255, vectors(t, size).sum(axis=0) // max(1, len(t))) for t in examples.values()]))

    def supported(self) -> list[str]:
        return sorted(self.langs)

    def ranks(self, texts: Sequence[str | None]) -> np.ndarray:
        """The rank of every language for every text; lower is nearer."""
        v = vectors(texts, self.vecs.shape[1])
        out = np.stack([np.abs(v - p).sum(axis=1) for p in self.vecs], axis=1) if self.langs else np.zeros((len(texts), 0), np.int64)
        short = np.array([len(t or "") < 150 for t in texts], bool)
        return out + np.where((out > 500) & short[:, None], np.minimum(50, 3 * np.arange(len(self.langs)))[None, :], 0)

    def detect(self, text: str, cutoff: int = 1200, n_results: int = 1, langs: Sequence[str] | None = None) -> tuple[str, int] | list[tuple[str, int]]:
        allowed = [i for i, x in enumerate(self.langs) if langs is None or x in set(langs)]
        ranks = self.ranks([text])[0]
        found = sorted(((int(ranks[i]), i) for i in allowed if ranks[i] <= cutoff), key=lambda x: x[0])
        if n_results == 1:
            return (self.langs[found[0][1]], found[0][0]) if found else (UNKNOWN, 0)
        return [(self.langs[i], r) for r, i in found[: max(0, n_results)]]


_BEST = T.StructType([T.StructField("lang", T.StringType()), T.StructField("rank", T.IntegerType())])


def detect(text: str | Column, profiles: Profiles, cutoff: int = 1200, langs: Sequence[str] | None = None) -> Column:
    """struct(lang, rank) of the nearest profile, or ("unknown", 0)."""

    @F.arrow_udf(_BEST)
    def found(texts: pa.Array) -> pa.Array:
        ranks = _allowed(profiles.ranks(texts.to_pylist()), profiles, cutoff, langs)
        best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(texts), np.int64)
        rank = ranks[np.arange(len(texts)), best] if ranks.shape[1] else np.full(len(texts), _NEVER)
        names = np.array([*profiles.langs, UNKNOWN], dtype=object)[np.where(rank == _NEVER, len(profiles.langs), best)]
        null = texts.is_null() if texts.null_count else None
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(rank == _NEVER, 0, rank).astype(np.int32))], names=["lang", "rank"], mask=null)

    return found(F.col(text) if isinstance(text, str) else text)


_NEVER = np.iinfo(np.int64).max


def _allowed(ranks: np.ndarray, profiles: Profiles, cutoff: int, langs: Sequence[str] | None) -> np.ndarray:
    out = np.where(ranks > cutoff, _NEVER, ranks)
    if langs is not None:
        out[:, [i for i, x in enumerate(profiles.langs) if x not in set(langs)]] = _NEVER
    return out


def detect_top(text: str | Column, profiles: Profiles, n_results: int, cutoff: int = 1200, langs: Sequence[str] | None = None) -> Column:
    """array<struct(lang, rank)> of the nearest profiles, nearest first; equal ranks in the order of the profiles."""

    @F.arrow_udf(T.ArrayType(_BEST))
    def found(texts: pa.Array) -> pa.Array:
        ranks = _allowed(profiles.ranks(texts.to_pylist()), profiles, cutoff, langs)
        order = np.argsort(ranks, axis=1, kind="stable")[:, : max(0, n_results)]
        out = [None if not ok else [{"lang": profiles.langs[j], "rank": int(r[j])} for j in o if r[j] != _NEVER] for r, o, ok in zip(ranks, order, texts.is_valid().to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("rank", pa.int32())])))

    return found(F.col(text) if isinstance(text, str) else text)


def confusion(predicted: DataFrame, actual: str = "lang", found: str = "predicted") -> DataFrame:
    """(actual, predicted, n); an unknown language shows as "-"."""
    shown = F.when(F.col(found) == UNKNOWN, "-").otherwise(F.col(found))
    return predicted.groupBy(F.col(actual).alias("actual"), shown.alias("predicted")).agg(F.count("*").alias("n"))


def evaluate(predicted: DataFrame, actual: str = "lang", found: str = "predicted") -> DataFrame:
    """(lang, n, precision, recall, f1, accuracy) of each actual language, from its confusion counts."""
    table = confusion(predicted, actual, found)
    total = table.agg(F.sum("n").alias("total"))
    guessed = table.groupBy(F.col("predicted").alias("lang")).agg(F.sum("n").alias("guessed"))
    own = table.groupBy(F.col("actual").alias("lang")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    rows = own.join(guessed, "lang", "left").crossJoin(total).na.fill(0, ["guessed"])
    rows = rows.withColumns({"precision": F.col("hit") / F.greatest(F.col("guessed"), F.lit(1)), "recall": F.col("hit") / F.greatest(F.col("n"), F.lit(1))})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    right = F.col("total") - F.col("n") - F.col("guessed") + 2 * F.col("hit")
    return rows.select("lang", "n", "precision", "recall", f1.alias("f1"), (right / F.col("total")).alias("accuracy"))


def split_examples(lines: DataFrame, line: str = "line", lang: str = "lang", least: int = 200, test: float = 0.05, val: float = 0.05, least_examples: int = 1) -> DataFrame:
    """(lang, line, part): distinct lines of at least ``least`` characters, dealt to test, val and train in the order of their hash.

    The line at the boundary behind test goes to train.  Languages of fewer than ``least_examples`` lines go.  A line's place
    is that within its hash's first four digits, and the number of lines before these, so that no task sorts a whole language.
    """
    from pyspark.sql import Window

    rows = lines.where(F.length(line) >= least).select(F.col(lang).alias("lang"), F.col(line).alias("line")).dropDuplicates(["lang", "line"]).withColumn("h", F.sha1("line"))
    rows = rows.withColumn("b", F.substring("h", 1, 4))
    counts = rows.groupBy("lang", "b").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows of each language
    before = counts.withColumns({"before": F.coalesce(F.sum("c").over(upto), F.lit(0)), "n": F.sum("c").over(Window.partitionBy("lang"))})
    before = before.where(F.col("n") >= least_examples).select(F.col("lang").alias("__lang"), F.col("b").alias("__b"), "before", "n")
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang", "b").orderBy("h")) - 1)
    placed = own.join(before, own["lang"].eqNullSafe(before["__lang"]) & (F.col("b") == F.col("__b"))).withColumn("i", F.col("before") + F.col("k"))
    first, second = F.floor(F.col("n") * test), F.floor(F.col("n") * test) + F.floor(F.col("n") * val)
    part = F.when(F.col("i") < first, "test").when((F.col("i") > first) & (F.col("i") < second), "val").otherwise("train")
    return placed.select("lang", "line", part.alias("part"))


def held_out(examples: DataFrame, cutoff: int = 1200, truncate: int | None = None) -> DataFrame:
    """(lang, line, part, predicted) of the lines of ``split_examples`` that aren't for training, by profiles trained on those that are.

    With ``truncate``, only that many characters of a line are looked at.
    """
    profiles = Profiles.of(train_profiles(examples.where("part = 'train'"), "line"))
    judged = examples.where("part <> 'train'")
    text = F.col("line") if truncate is None else F.substring("line", 1, truncate)
    return judged.withColumn("predicted", detect(text, profiles, cutoff)["lang"])


def clean_lines(text: str | Column) -> Column:
    """array of candidate lines: NFKC, without [[ and ]] and without <doc> markers."""
    import unicodedata

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        out = [None if t is None else [unicodedata.normalize("NFKC", x).replace("[[", "").replace("]]", "").strip() for x in t.split("\n") if not x.startswith(("<doc", "</doc"))] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.string()))

    return found(F.col(text) if isinstance(text, str) else text)

"""A sharded index from 64-bit hashes to counts and owners, and answers by chunk of a table.

Each shard is a minimal perfect hash (levels of collision-free bits, as in BBHash) whose slots
hold a 32-bit fingerprint and a count in as few bytes as it takes; the owners of keys above a limit stand in a second,
short array.  A table that asks is written once with the number of its chunk in each row (``chunked``); what its rows ask
for is sent to the shards as (chunk, hash), once for each chunk, and what comes back is one small file for
each chunk (``answers``).  So a shard is read once, a task reads the answers of its own chunks only, and no probed row
is shuffled, at any number of shards and tasks.
"""

from __future__ import annotations

import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import _blobs as B
from webloom.llm._arrow import cogrouped, grouped
from webloom.llm._text import mix
from webloom.session import qualified, shared_dir, written

_U = np.uint64
_GAMMA = 2


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys; other keys get any slot, or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            bits = np.zeros(-(-_GAMMA * len(left) // 64), dtype=_U)
            at = cls._place(left, len(levels), len(bits))
            single = np.bincount(at, minlength=len(bits) * 64)[at] == 1
            np.bitwise_or.at(bits, at[single] >> 6, _U(1) << (at[single] & 63).astype(_U))
            levels.append(bits)
            left = left[~single]
            if len(levels) > 200:
                raise ValueError("the keys aren't distinct")
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        seed = _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix(keys ^ seed) % _U(words * 64)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = self._place(keys[left], k, len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(_U)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word[hit] & ((_U(1) << bit[hit]) - _U(1)))
            out[left[hit]] = ranks[at[hit] >> 6] + below
            left = left[~hit]
        return out


class Shard:
    """Fingerprints and counts by slot, and the owners of the slots in ``top``."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray, top: np.ndarray, owners: np.ndarray):
        self.hashed, self.prints, self.counts, self.top, self.owners = hashed, prints, counts, top, owners

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray, above: int = -1) -> Shard:
        """Keys are distinct; owners are kept of those that count more than ``above``."""
        hashed = PerfectHash.build(keys)
        at = hashed.slots(keys)
        prints, n, who = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        prints[at], n[at], who[at] = cls._print(keys), counts, owners
        top = np.flatnonzero(n > above)
        return cls(hashed, prints, n, top, who[top])

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> _U(32)).astype(np.uint32)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, owner) of each key; the count of a key that isn't in the index is 0, and so is an owner that isn't kept."""
        count, owner = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if not len(self.prints):
            return count, owner
        at = self.hashed.slots(keys)
        ok = np.flatnonzero((at >= 0) & (self.prints[at] == self._print(keys)))
        count[ok] = self.counts[at[ok]]
        if len(self.top):
            where = np.minimum(np.searchsorted(self.top, at[ok]), len(self.top) - 1)
            kept = self.top[where] == at[ok]
            owner[ok[kept]] = self.owners[where[kept]]
        return count, owner

    def dump(self) -> bytes:
        levels = self.hashed.levels
        head = np.array([len(levels), *map(len, levels), len(self.prints)], dtype=np.int64).tobytes()
        return head + b"".join(x.tobytes() for x in levels) + self.prints.tobytes() + B.pack_small(self.counts) + B.pack_small(self.top) + self.owners.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        *sizes, keys = (int(x) for x in np.frombuffer(raw, np.int64, n + 1, 8))
        at, levels = 8 * (n + 2), []
        for size in sizes:
            levels.append(np.frombuffer(raw, _U, size, at))
            at += 8 * size
        prints = np.frombuffer(raw, np.uint32, keys, at)
        counts, at = B.unpack_small(raw, at + 4 * keys)
        top, at = B.unpack_small(raw, at)
        return cls(PerfectHash(levels), prints, counts, top.astype(np.int64), np.frombuffer(raw, np.int64, len(top), at))


def _shard(table: pa.Table, above: int) -> pa.Table:
    """(h, n, owner), several rows for an h → the shard."""
    h, n, owner = (np.asarray(table.column(c)) for c in ("h", "n", "owner"))
    order = np.lexsort((owner, h))
    h, n, owner = h[order], n[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    total = np.minimum(np.add.reduceat(n, new), above + 1)  # whether it is above the limit is all that is asked
    raw = Shard.build(h[new].view(_U), total, owner[new], above).dump()
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "blob": pa.array([raw], pa.binary())})


def _ask(asked: pa.Table, shard: pa.Table, above: int) -> pa.Table:
    keys = np.asarray(asked.column("h")).astype(np.int64)
    count, owner = Shard.load(shard.column("blob")[0].as_py()).probe(keys.view(_U)) if shard.num_rows else (np.zeros(len(keys), np.int64),) * 2
    hit = np.flatnonzero(count > above)
    return pa.table({"chunk": asked.column("chunk").take(pa.array(hit)), "h": pa.array(keys[hit]), "owner": pa.array(owner[hit])})


def indexed_answers(asked: DataFrame, above: int, keys_per_shard: int) -> str:
    """The answers path for (chunk, h, n, owner): of each chunk the h whose counts add up to more than ``above``, with their least owner."""
    rows = written(asked.select(F.col("chunk").cast("int").alias("chunk"), "h", F.col("n").cast("long").alias("n"), F.col("owner").cast("long").alias("owner")))
    shards = max(1, -(-rows.count() // keys_per_shard))
    keyed = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    index = written(keyed.select("shard", "h", "n", "owner").groupBy("shard").applyInArrow(grouped(_shard, above=above), "shard int, blob binary"))
    probes = keyed.select(F.col("shard").alias("to"), "chunk", "h")
    return answers(probes.groupBy("to").cogroup(index.groupBy("shard")).applyInArrow(cogrouped(_ask, above=above), "chunk int, h long, owner long"))


def chunked(df: DataFrame) -> DataFrame:
    """df, written to the shared folder with the number of the task that wrote each row as ``__wl_chunk``."""
    return written(df.withColumn("__wl_chunk", F.spark_partition_id()))


def _pack(table: pa.Table) -> pa.Table:
    h, owner = np.asarray(table.column("h")), np.asarray(table.column("owner"))
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    raw = h[new].tobytes() + owner[new].tobytes()
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "blob": pa.array([raw], pa.binary())})


def answers(hits: DataFrame) -> str:
    """The path of one file for each chunk of (chunk, h, owner)."""
    path = shared_dir(hits.sparkSession)
    hits.groupBy("chunk").applyInArrow(grouped(_pack), "chunk int, blob binary").write.partitionBy("chunk").parquet(path)
    return qualified(hits.sparkSession, path)


class Answers:
    """Reads answers in a worker; those of the chunks used last stay loaded, up to ``keep``."""

    _open: dict[str, Answers] = {}

    def __init__(self, path: str, keep: int = 4):
        self.keep = keep
        self.fs, self.path = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        self.loaded: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    @classmethod
    def at(cls, path: str) -> Answers:
        if path not in cls._open:
            cls._open = {path: cls(path)}
        return cls._open[path]

    def _get(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.loaded:
            found = self.fs.get_file_info(pa.fs.FileSelector(f"{self.path}/chunk={k}", allow_not_found=True))
            raw = [pq.ParquetFile(x.path, filesystem=self.fs).read(columns=["blob"]) for x in found if x.path.endswith(".parquet")]
            both = np.frombuffer(b"".join(b.as_py() for t in raw for b in t.column("blob")), np.int64).reshape(2, -1)
            while len(self.loaded) >= self.keep:
                self.loaded.popitem(last=False)
            self.loaded[k] = both[0], both[1]
        self.loaded.move_to_end(k)
        return self.loaded[k]

    def probe(self, keys: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is among the answers, owner) for each int64 key of a chunk."""
        hit, owner = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        for k in np.unique(chunk):
            known, who = self._get(int(k))
            if len(known):
                at = np.flatnonzero(chunk == k)
                slot = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                ok = known[slot] == keys[at]
                hit[at], owner[at[ok]] = ok, who[slot[ok]]
        return hit, owner

"""N-gram Jaccard self-join by grouped prefixes.

Documents are sets of word n-grams (lower case, split at ASCII white space), taken by 64-bit hashes.  Every
pair of sets with a Jaccard similarity of at least ``threshold`` is found, up to collisions of hashes:

1. every document sends its n-gram hashes, sorted and delta-coded, to buckets of the hash
   space (rows with equal sets count as one); each bucket returns the n-grams that two or more
   sets share, with the number of sets that hold them.  An n-gram of one set can match nothing;
2. per set, n-grams are ordered by (frequency, hash), rare first, and the prefix that any
   partner must touch is cut: size - ceil(threshold * size) + 1 n-grams, those of one set first.
   Most sets have no other n-gram there and are done;
3. sets with the same prefix and size become one group; groups that share a prefix n-gram
   are joined under the size and position filters; groups are then expanded and their
   members verified on whole n-gram lists, in blocks of bounded size.

The result has one row for each document, so it grows as the input does: (doc_id, class_id,
copies, links).  ``links`` is the number of other documents within the threshold, each verified;
``copies`` the number of documents with an equal set, itself included; ``class_id`` the smallest doc_id that links
lead to (a document that has none is its own class).  ``document_pairs`` lists the linked pairs.

Nulls, ties and odd rows: rows without doc_id are left out; null, empty and white-space
texts have no n-grams and no links; a text of fewer than n words has one n-gram, all its
words; a text of any length is taken whole; rows that repeat a doc_id with equal sets are one, with different sets
they have a row each, share one class and count as documents of their own.  doc_id has to be a whole number (it is cast to
long).  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import _blobs as B
from webloom.llm import _text as X
from webloom.llm._arrow import grouped
from webloom.llm._links import classes, verified
from webloom.session import prepare, shuffle_partitions, written

_U = np.uint64
_FLUSH = 3_000_000
#: Input of one bucket; a worker holds about ten times as much while it sorts.
_BUCKET_BYTES = 32 << 20
#: Hash bits dropped for the exchange of step 1, so that sorted gaps take 4 bytes.  N-grams that agree on
#: the other 48 are taken as one, which matters only to two sets that hold one each: size**2 / 2**48.
_DROP = 16
_MEMBERS = -1


def _flush(rows: list[tuple[int, np.ndarray]], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blobs of the sets collected so far: (value, index of set) by bucket."""
    if not rows:
        return
    sigs = np.array([s for s, _ in rows], dtype=_U)
    values = np.concatenate([g for _, g in rows]) >> _U(_DROP)
    which = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(g) for _, g in rows])
    order = np.argsort(values, kind="stable")
    values, which = values[order], which[order]
    cuts = np.searchsorted(values, _edges(buckets))
    for b in range(buckets):
        v, w = values[cuts[b] : cuts[b + 1]], which[cuts[b] : cuts[b + 1]]
        if len(v):
            used, index = np.unique(w, return_inverse=True)
            yield b, B.pack_sorted(v) + B.pack_small(index) + sigs[used].tobytes()


def _edges(buckets: int) -> np.ndarray:
    top = 1 << (64 - _DROP)
    return np.array([top * b // buckets for b in range(buckets + 1)], dtype=_U)


def _scatter(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text → blobs of n-grams by bucket, and of documents (doc_id, set, size) by bucket of doc_id, numbered from -1 down."""
    rows: list[tuple[int, np.ndarray]] = []
    members: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen: set[int] = set()
    held = waiting = 0

    def flush() -> Iterator[pa.RecordBatch]:
        found = [*_flush(rows, buckets), *_flush_members(members, buckets)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])

    for part in batches:
        grams, first = X.ngrams(*X.words(part.column("text")), n)
        ids, sigs, sizes = part.column("doc_id").to_numpy(zero_copy_only=False), [], []
        for i in range(len(ids)):
            g = np.unique(grams[first[i] : first[i + 1]])
            sig = int(X.mix(np.array([np.add.reduce(g * _U(0xD6E8FEB86659FD93) ^ (g >> _U(29))) + _U(len(g))], dtype=_U))[0])
            sigs.append(sig)
            sizes.append(len(g))
            if len(g) and sig not in seen:
                seen.add(sig)
                rows.append((sig, g))
                held += len(g)
            if held >= _FLUSH:
                yield from flush()
                rows, members, held, waiting = [], [], 0, 0
                seen.clear()
        members.append((ids.astype(np.int64), np.array(sigs, dtype=_U), np.array(sizes, dtype=_U)))
        waiting += len(ids)
        if waiting >= _FLUSH // 10:
            yield from flush()
            rows, members, held, waiting = [], [], 0, 0
            seen.clear()
    yield from flush()


def _flush_members(members: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple[int, bytes]]:
    if not sum(len(x[0]) for x in members):
        return
    ids, sigs, sizes = (np.concatenate(x) for x in zip(*members, strict=True))
    bucket = (X.mix(ids.view(_U)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b] : cuts[b + 1]]
        yield _MEMBERS - b, np.array([len(at)], dtype=_U).tobytes() + ids[at].tobytes() + sigs[at].tobytes() + sizes[at].tobytes()


def _by_part(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = (key >> _U(33)) % _U(parts)
    order = np.lexsort((key, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=_U))


def _shared(table: pa.Table, parts: int) -> pa.Table:
    """One bucket → the n-grams that two sets or more hold, sent on by set; members pass through."""
    blobs, out = [x.as_py() for x in table.column("blob")], []
    if table.column("bucket")[0].as_py() <= _MEMBERS:
        # the rows of a doc_id are all here, each of its sets once; of a set, the least doc_id and their number go on
        cols = [np.concatenate([np.frombuffer(x, dtype=np.int64, offset=8 + k * 8 * (n := int(np.frombuffer(x, dtype=_U, count=1)[0])), count=n) for x in blobs]) for k in range(3)]
        ids, sigs, sizes = cols[0], cols[1].view(_U), cols[2]
        order = np.lexsort((ids, sigs))
        ids, sigs, sizes = ids[order], sigs[order], sizes[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])
        ids, sigs, sizes = ids[new], sigs[new], sizes[new]
        out.append((table.column("bucket")[0].as_py(), 2, np.array([len(ids)], dtype=_U).tobytes() + ids.tobytes() + sigs.tobytes() + sizes.tobytes()))
        top = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
        count = np.diff(np.append(top, len(sigs)))
        live = sizes[top] > 0
        top, count = top[live], count[live]
        order, cuts = _by_part(sigs[top], parts)
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                at = order[cuts[p] : cuts[p + 1]]
                out.append((p, 1, np.array([len(at)], dtype=_U).tobytes() + ids[top[at]].tobytes() + sigs[top[at]].tobytes() + sizes[top[at]].tobytes() + count[at].astype(np.int64).tobytes()))
    else:
        values, sets = [], []
        for raw in blobs:
            v, at = B.unpack_sorted(raw, 0)
            index, at = B.unpack_small(raw, at)
            values.append(v)
            sets.append(np.frombuffer(raw, dtype=_U, offset=at)[index])
        v, s = np.concatenate(values), np.concatenate(sets)
        order = np.argsort(v, kind="stable")
        v, s = v[order], s[order]
        again = np.zeros(len(v), dtype=bool)
        again[1:] = v[1:] == v[:-1]
        again[:-1] |= again[1:]
        v, s = v[again], s[again]
        order = np.lexsort((s, v))  # sets that came in several blobs count once
        v, s = v[order], s[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
        v, s = v[new], s[new]
        if len(v):
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            df = np.repeat(np.diff(np.append(start, len(v))), np.diff(np.append(start, len(v))))
            v, s, df = v[df > 1], s[df > 1], df[df > 1]
        order, cuts = _by_part(s, parts)
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                at = order[cuts[p] : cuts[p + 1]]
                uniq, counts = np.unique(s[at], return_counts=True)
                out.append((p, 0, np.array([len(uniq)], dtype=_U).tobytes() + uniq.tobytes() + B.pack_small(counts) + B.pack_small(df[at]) + v[at].tobytes()))
    return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.int8()), "blob": pa.array([x[2] for x in out], pa.binary())})


_SETS = "kind byte, sig long, size int, name long, n long, ids array<long>, grams array<long>, alone int, cut int"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)))


def _rows(kind: int, count: int, **given: pa.Array) -> pa.Table:
    """Rows of the written table; what isn't given is null."""
    types = {"kind": pa.int8(), "sig": pa.int64(), "size": pa.int32(), "name": pa.int64(), "n": pa.int64(), "ids": pa.list_(pa.int64()), "grams": pa.list_(pa.int64()), "alone": pa.int32(), "cut": pa.int32()}
    given["kind"] = pa.array(np.full(count, kind, np.int8))
    return pa.table([given[c].cast(t) if c in given else pa.nulls(count, t) for c, t in types.items()], names=list(types))


def _sets(table: pa.Table, threshold: float) -> pa.Table:
    """One part → a row for each set: its smallest doc_id and their number, its shared n-grams rare first, and how many of
    these are prefix; or, for a part of documents, their doc_ids by set.
    """
    kinds, blobs = table.column("kind").to_pylist(), [x.as_py() for x in table.column("blob")]
    if kinds[0] == 2:
        raw = blobs[0]
        n = int(np.frombuffer(raw, dtype=_U, count=1)[0])
        ids, sigs, sizes = (np.frombuffer(raw, dtype=np.int64, count=n, offset=8 + 8 * k * n) for k in range(3))
        new = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
        parts = np.split(ids, new[1:])
        return _rows(1, len(new), sig=pa.array(sigs[new], mask=sizes[new] == 0), size=pa.array(sizes[new]), ids=_lists(parts))
    name, owner, sizes, count = [np.empty(0, np.int64)], [np.empty(0, _U)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    sig, val, freq = [np.empty(0, _U)], [np.empty(0, _U)], [np.empty(0, np.int64)]
    for kind, raw in zip(kinds, blobs, strict=True):
        n = int(np.frombuffer(raw, dtype=_U, count=1)[0])
        if kind == 1:
            for k, (to, t) in enumerate(((name, np.int64), (owner, _U), (sizes, np.int64), (count, np.int64))):
                to.append(np.frombuffer(raw, dtype=t, count=n, offset=8 + 8 * k * n))
        else:
            uniq = np.frombuffer(raw, dtype=_U, count=n, offset=8)
            counts, at = B.unpack_small(raw, 8 + 8 * n)
            df, at = B.unpack_small(raw, at)
            sig.append(np.repeat(uniq, counts))
            freq.append(df.astype(np.int64))
            val.append(np.frombuffer(raw, dtype=_U, offset=at))
    name, owner, sizes, count = (np.concatenate(x) for x in (name, owner, sizes, count))
    sig, val, freq = np.concatenate(sig), np.concatenate(val), np.concatenate(freq)
    order = np.lexsort((val, freq, sig))
    sig, val = sig[order], val[order].view(np.int64)
    order = np.lexsort((name, owner))
    name, owner, sizes, count = name[order], owner[order], sizes[order], count[order]
    names, at = np.unique(owner, return_index=True)
    if not len(names):
        return _rows(0, 0)
    docs, size = np.add.reduceat(count, at), sizes[at]
    lo, hi = np.searchsorted(sig, names), np.searchsorted(sig, names, side="right")
    prefix = size - _least(threshold, size) + 1
    alone = size - (hi - lo)
    cut = np.clip(prefix - alone, 0, hi - lo)
    keep = np.flatnonzero((cut > 0) | (docs > 1))
    grams = _lists([val[lo[i] : hi[i]] if cut[i] else val[:0] for i in keep])
    given = {"sig": names[keep].view(np.int64), "size": size[keep], "name": name[at][keep], "n": docs[keep], "alone": alone[keep], "cut": cut[keep]}
    return _rows(0, len(keep), grams=grams, **{c: pa.array(x) for c, x in given.items()})


def _least(threshold: float, size: np.ndarray) -> np.ndarray:
    """ceil(threshold * size), safe against rounding in the product."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _parts(docs: DataFrame) -> int:
    """Buckets of the exchanges: from the size that the optimiser knows of the table, or else the session's partitions."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * shuffle_partitions(docs.sparkSession), known // _BUCKET_BYTES if known < 1 << 56 else 0)


def document_sets(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(sets, members), written to the shared folder.

    sets: (sig, size, name, n, grams, alone, cut) of those that have a shared n-gram in their prefix, or several documents;
    members: (sig, id) of every document, with a null sig for those without n-grams.
    """
    prepare(docs.sparkSession)
    parts = _parts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    blobs = rows.mapInArrow(partial(_scatter, n=n, buckets=parts), "bucket int, blob binary")
    shared = blobs.groupBy("bucket").applyInArrow(grouped(_shared, parts=parts), "part int, kind byte, blob binary")
    found = written(shared.groupBy("part").applyInArrow(grouped(_sets, threshold=threshold), _SETS))
    return found.where("kind = 0").drop("kind", "ids"), found.where("kind = 1").select("sig", F.explode("ids").alias("id"))


def _verify(pairs: pa.Table, lists: pa.Table, threshold: float) -> pa.Table:
    """The pairs of a bucket whose n-gram lists overlap enough: each list is marked once, and all its partners counted against it."""
    sig, size = lists.column("sig").to_numpy(), lists.column("size").to_numpy()
    grams = lists.column("grams").combine_chunks()
    count = np.asarray(grams.value_lengths())
    off = np.concatenate([[0], np.cumsum(count)])
    names, code = np.unique(np.asarray(grams.flatten()), return_inverse=True)
    order = np.argsort(sig)
    a, b = (order[np.searchsorted(sig[order], pairs.column(c).to_numpy())] if len(sig) else np.empty(0, np.int64) for c in ("sig_a", "sig_b"))
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    common, mark = np.zeros(len(a), np.int64), np.zeros(len(names), bool)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), len(a)) if len(a) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = code[off[a[lo]] : off[a[lo] + 1]]
        mark[mine] = True
        for at in range(lo, hi, 1000):
            partners = b[at : min(hi, at + 1000)]
            total = np.concatenate([[0], np.cumsum(mark[np.concatenate([code[off[k] : off[k + 1]] for k in partners])])])
            common[at : at + len(partners)] = np.diff(total[np.concatenate([[0], np.cumsum(count[partners])])])
        mark[mine] = False
    ok = common >= threshold * (size[a] + size[b] - common) - 1e-9
    return pa.table({"sig_a": pa.array(sig[a][ok], pa.int64()), "sig_b": pa.array(sig[b][ok], pa.int64())})


def _seeded(k: int) -> Callable[[Column], Column]:
    return lambda g: F.xxhash64(g, F.lit(k))


def _set_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(sig_a, sig_b) of verified pairs of distinct sets."""
    live = sets.where("cut > 0")
    keyed = live.select("sig", "size", F.slice("grams", 1, F.col("cut")).alias("prefix"), "alone", "cut", F.size("grams").alias("n_shared"))
    keyed = keyed.withColumn("gid", F.xxhash64("prefix", "size"))
    groups = keyed.groupBy("gid").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.max("n_shared").alias("n_shared"))
    # two hash minima of the prefix: groups that agree on one are a pair already, so the n-gram join,
    # which meets a pair at every n-gram that its prefixes share, is left with those that agree on none
    marked = groups.withColumns({f"m{k}": F.array_min(F.transform("prefix", _seeded(k))) for k in (1, 2)})
    a, b = ([F.col(c).alias(f"{c}_{x}") for c in ("gid", "size", "n_shared", "m1", "m2")] for x in "ab")
    sized = ((F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("gid_a") < F.col("gid_b")))) & (F.col("size_a") >= F.lit(threshold) * F.col("size_b") - F.lit(1e-9))
    ma, mb = marked.select(*a), marked.select(*b)
    first = ma.join(mb, (F.col("m1_a") == F.col("m1_b")) & sized)
    second = ma.join(mb, (F.col("m2_a") == F.col("m2_b")) & (F.col("m1_a") != F.col("m1_b")) & sized)
    posted = marked.select("gid", "size", "n_shared", "m1", "m2", F.posexplode("prefix").alias("pos", "gram"))
    pa_, pb = posted.select(*a, F.col("pos").alias("pos_a"), F.col("gram").alias("gram_a")), posted.select(*b, F.col("pos").alias("pos_b"), F.col("gram").alias("gram_b"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("size_a") + F.col("size_b")) - F.lit(1e-9))
    rest = (
        pa_.join(pb, (F.col("gram_a") == F.col("gram_b")) & (F.col("m1_a") != F.col("m1_b")) & (F.col("m2_a") != F.col("m2_b")) & sized)
        .where(F.least(F.col("n_shared_a") - F.col("pos_a"), F.col("n_shared_b") - F.col("pos_b")) >= need)
        .select("gid_a", "gid_b")
        .distinct()
    )
    near = first.select("gid_a", "gid_b").union(second.select("gid_a", "gid_b")).union(rest)
    members = keyed.select("gid", "sig")
    ga, gb = members.select(F.col("gid").alias("gid_a"), F.col("sig").alias("sig_a")), members.select(F.col("gid").alias("gid_b"), F.col("sig").alias("sig_b"))
    across = near.join(ga, "gid_a").join(gb, "gid_b").select("sig_a", "sig_b")
    several = members.groupBy("gid").count().where("count > 1").select("gid")
    inside = members.join(several, "gid")
    within = inside.select("gid", F.col("sig").alias("sig_a")).join(inside.select("gid", F.col("sig").alias("sig_b")), "gid").where("sig_a < sig_b").select("sig_a", "sig_b")
    return verified(across.unionByName(within), live.select("sig", "size", "grams"), _verify, threshold=threshold)


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.4) -> DataFrame:
    """(doc_id, class_id, copies, links) of every document, as the module says."""
    return _joined(docs, n, threshold).withColumnRenamed("id", "doc_id")


def _joined(docs: DataFrame, n: int, threshold: float, count_links: bool = True) -> DataFrame:
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    sets, members = document_sets(docs, n, threshold)
    return classes(members, sets.select("sig", "name", "n"), _set_pairs(sets, threshold), count_links)


def document_pairs(docs: DataFrame, n: int = 5, threshold: float = 0.4) -> DataFrame:
    """(doc_a, doc_b) of all documents that the join links, doc_a < doc_b; quadratic in groups of copies."""
    sets, members = document_sets(docs, n, threshold)
    pairs = _set_pairs(sets, threshold)
    a, b = (members.select(F.col("sig").alias(f"sig_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    several = sets.where("n > 1").select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"))
    linked = pairs.union(several).join(a, "sig_a").join(b, "sig_b").where("id_a < id_b or (sig_a <> sig_b and id_a > id_b)")
    return linked.select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b")).distinct()


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.4) -> DataFrame:
    """The documents without those whose class of near copies has a smaller doc_id; rows without doc_id stay.

    All rows of a kept doc_id stay.
    """
    dropped = _joined(docs, n, threshold, count_links=False).where("id <> class_id").select(F.col("id").alias("__wl_doc")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["__wl_doc"], "left_anti")

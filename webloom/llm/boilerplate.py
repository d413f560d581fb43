"""Boilerplate removal by a sampled suffix array for each host.

The visible tokens of all pages of a host form one stream.  Every substring of at least
``min_tokens`` tokens that also stands in another page of the host is boilerplate: its tokens go,
and what is left of a page are its unique runs, one to a line.

A suffix array of a whole host doesn't fit in one task once the host is large, so the array is
sampled and sliced, without changing the result:

1. of every window of ``min_tokens`` tokens the least of its k-grams by hash (the minimizer) is
   its anchor.  Equal windows have equal anchors, so a repeat can only be where anchors repeat;
   anchors are counted across pages, hashed with their host;
2. the token spans around anchors that two pages share are dealt to slices by anchor.  A slice
   concatenates its spans and sorts all suffixes by their first ``min_tokens`` tokens (prefix
   doubling); neighbours that agree on all of them and stem from distinct pages are repeats;
3. every chunk of the table gets the repeated windows of the spans that it sent, one small file for each chunk (see
   ``_index``), and takes them out.  Neither texts nor pages are shuffled, and a hot host is spread over all slices.

A chunk sends a span once for at most two pages, so boilerplate that all pages of a host share
costs what the number of chunks costs, not the number of pages.

Tokens are runs of anything but ASCII white space, compared in lower case, outside tags, comments
and the contents of script, style, template, noscript and title; character references are decoded.

Nulls, ties and odd rows: pages of any length are taken whole; page_id has to be a whole number (it is cast to long); a null or
empty html gives an empty text; null and unparsable urls
share one host; rows with the same page_id, or null ones, are one page, so what only they share
stays; copies of a page under several page_ids remove each other; pages of fewer than
``min_tokens`` tokens stay whole.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import _text as X
from webloom.llm._arrow import grouped
from webloom.llm._index import Answers, answers, chunked
from webloom.session import prepare, shuffle_partitions, written

_U = np.uint64
_GRAM = 6
#: Contents that aren't shown, comments, and tags, whose quoted attribute values may hold a >.
_JUNK = re.compile(
    r"<(script|style|template|noscript|title)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)"
    r"""|</?[a-zA-Z!?](?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)""",
    re.S | re.I,
)


def visible(page: str) -> str:
    text = _JUNK.sub(" ", page)
    return html.unescape(text) if "&" in text else text


def _visible():
    @F.arrow_udf("string")
    def found(page: pa.Array) -> pa.Array:
        return pa.array([None if x is None else visible(x) for x in page.to_pylist()], pa.string())

    return found


def _roll(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n tokens from each position on; those that pass a row's end mean nothing."""
    if len(tokens) < n:
        return np.empty(0, _U)
    up, down = X._pow(len(tokens) + 1)
    run = np.empty(len(tokens) + 1, _U)
    run[0] = 0
    np.cumsum(tokens * up[: len(tokens)], out=run[1:])
    return X.mix((run[n:] - run[:-n]) * down[: len(tokens) - n + 1])


def anchors(tokens: np.ndarray, first: np.ndarray, host: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, position of its anchor, hash of the anchor); windows stay within rows."""
    k = min(_GRAM, least)
    g = _roll(tokens, k)
    if len(tokens) < least:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, _U)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(len(tokens)) + least <= first[1:][row])
    views = np.lib.stride_tricks.sliding_window_view(g, least - k + 1)
    at = start + views.argmin(axis=1)[start]
    return start, at, X.mix(g[at] ^ host[row[start]])


def _host_hash(col: pa.Array) -> np.ndarray:
    """One hash for each row's host."""
    coded = col.dictionary_encode()
    names = coded.dictionary.to_pylist()
    data = np.array([int.from_bytes(hashlib.blake2b((n or "").encode(), digest_size=8).digest(), "little") for n in names] or [0], dtype=_U)
    return data[np.asarray(coded.indices.fill_null(0))] if len(names) else np.zeros(len(col), _U)


def _page_ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("page_id").fill_null(-(1 << 62)))


def _short(tokens: np.ndarray) -> np.ndarray:
    """Half of each token's hash; a window of them identifies it."""
    return tokens >> _U(32)


def _parse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens, first = X.words(batch.column("text"))
    return tokens, first, _host_hash(batch.column("host"))


def _seen(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(chunk, h, n): the anchors of the pages, and in how many pages of a batch they stand, up to 2."""
    for b in batches:
        tokens, first, host = _parse(b)
        start, _, h = anchors(tokens, first, host, least)
        if not len(h):
            continue
        page, chunk = np.repeat(_page_ids(b), np.diff(first))[start], np.asarray(b.column("__wl_chunk"))
        for k in np.unique(chunk):
            at = np.flatnonzero(np.repeat(chunk == k, np.diff(first))[start]) if chunk[0] != chunk[-1] else np.arange(len(h))
            at = at[np.lexsort((page[at], h[at]))]
            g, who = h[at], page[at]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (who[1:] != who[:-1])]) if len(g) else np.empty(0, bool)
            names, n = np.unique(g[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), k, np.int32)), pa.array(names.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["chunk", "h", "n"])


_SPAN = "slice int, chunk int, page_id long, host long, tokens binary"


def _spans(batches: Iterator[pa.RecordBatch], path: str, slices: int, least: int) -> Iterator[pa.RecordBatch]:
    """The tokens of all windows around each shared anchor; the same span for at most two pages of a chunk."""
    index, sent = Answers.at(path), {}
    for b in batches:
        tokens, first, host = _parse(b)
        start, at, h = anchors(tokens, first, host, least)
        if not len(h):
            continue
        chunk = np.asarray(b.column("__wl_chunk"))
        row = np.searchsorted(first, start, side="right") - 1
        hit = index.probe(h.view(np.int64), chunk[row])[0]
        start, at, h, row = start[hit], at[hit], h[hit], row[hit]
        if not len(h):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(start) != 1)]))
        lo, hi = start[new], np.append(start[new[1:] - 1], start[-1]) + least
        pages, out, short = _page_ids(b), [], _short(tokens).astype(np.uint32)
        for i, a, z in zip(new.tolist(), lo.tolist(), hi.tolist(), strict=True):
            raw, page = short[a:z].tobytes(), int(pages[row[i]])
            key = (int(h[i]), int(chunk[row[i]]), hash(raw))
            known = sent.get(key)
            if known is None:
                sent[key] = page
            elif known == page or known is True:
                continue
            else:
                sent[key] = True
            out.append((int(h[i]) % slices, int(chunk[row[i]]), page, int(host[row[i]].view(np.int64)), raw))
        if len(sent) > 1_000_000:
            sent.clear()
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["slice", "chunk", "page_id", "host", "tokens"])


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their suffixes, whether each agrees with the one before it on ``depth`` tokens).

    Prefix doubling over ranks, stopped at ``depth``; beyond the end stands a token less than all others.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    known = 1
    while known < depth:
        step = min(known, depth - known)
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] if step < n else 0
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        known += step
    order = np.argsort(rank, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = rank[order][1:] == rank[order][:-1]
    return order, same


def _repeats(table: pa.Table, least: int) -> pa.Table:
    """One slice → the hashes of windows that stand in two pages or more of a host, for each chunk that sent one."""
    spans = [np.frombuffer(x, np.uint32).astype(_U) for x in table.column("tokens").to_pylist()]
    pages, hosts = np.asarray(table.column("page_id")), np.asarray(table.column("host")).view(_U)
    sizes = np.array([len(x) for x in spans])
    stream = np.concatenate([np.append(x, X.mix(np.array([i], _U))) for i, x in enumerate(spans)])  # a mark of its own ends each span
    which = np.repeat(np.arange(len(spans)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    order, same = suffix_array(stream, least)
    fits = order + least <= ends[which[order]]
    order, group = order[fits], np.cumsum(~same)[fits]
    host, page = hosts[which[order]], pages[which[order]]
    by = np.lexsort((page, host, group))
    order, group, host, page = order[by], group[by], host[by], page[by]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (host[1:] != host[:-1])]) if len(order) else np.empty(0, bool)
    top = np.flatnonzero(new)
    last = np.append(top[1:], len(order)) - 1
    many = page[top] != page[last] if len(top) else np.empty(0, bool)
    many = np.repeat(many, np.diff(np.append(top, len(order))))
    at = order[many]
    h = X.mix(_roll(stream, least)[at] ^ hosts[which[at]]) if len(at) else np.empty(0, _U)
    chunk = np.asarray(table.column("chunk"))[which[at]]
    by = np.lexsort((h, chunk))
    h, chunk = h[by], chunk[by]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (chunk[1:] != chunk[:-1])]) if len(h) else np.empty(0, bool)
    return pa.table({"chunk": pa.array(chunk[new].astype(np.int32)), "h": pa.array(h[new].view(np.int64))})


def _clean(path: str, least: int) -> Callable:
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.IntegerType()), T.StructField("removed", T.IntegerType())])

    @F.arrow_udf(kind)
    def cleaned(text: pa.Array, host: pa.Array, chunk: pa.Array) -> pa.Array:
        tokens, first = X.words(text)
        gone = np.zeros(len(tokens) + 1, np.int64)
        if len(tokens) >= least:
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            start = np.flatnonzero(np.arange(len(tokens)) + least <= first[1:][row])
            h = X.mix(_roll(_short(tokens), least)[start] ^ _host_hash(host)[row[start]])
            hit = start[Answers.at(path).probe(h.view(np.int64), np.asarray(chunk)[row[start]])[0]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + least, -1)
        keep = np.cumsum(gone)[:-1] == 0
        data, off = X.buffer(text)
        lo, hi = X._bounds(data, off) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
        edge = np.zeros(len(tokens), bool)
        edge[first[:-1][first[:-1] < len(tokens)]] = True
        begins = np.flatnonzero(keep & (edge | ~np.concatenate([[False], keep[:-1]])))
        stops = np.flatnonzero(keep & np.concatenate([edge[1:] | ~keep[1:], [True]])[: len(keep)])
        raw, runs = data.tobytes(), np.searchsorted(begins, first)
        a, z = lo[begins].tolist(), hi[stops].tolist()
        out = ["\n".join(raw[a[j] : z[j]].decode() for j in range(runs[i], runs[i + 1])) for i in range(len(text))]
        total = np.diff(first)
        kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[first])
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(total.astype(np.int32)), pa.array((total - kept).astype(np.int32))], names=["text", "tokens", "removed"])

    return cleaned


def remove_boilerplate(pages: DataFrame, min_tokens: int = 16) -> DataFrame:
    """(page_id, host, text, tokens, removed) of every page."""
    if min_tokens < 2:
        raise ValueError("min_tokens must be at least 2")
    spark = prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    texts = chunked(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.coalesce(_visible()(F.col("html").cast("string")), F.lit("")).alias("text")))
    seen = texts.mapInArrow(partial(_seen, least=min_tokens), "chunk int, h long, n int")
    everywhere = F.sum("n").over(Window.partitionBy("h"))  # an anchor has a row for each batch of pages at most
    shared = written(seen.withColumn("everywhere", everywhere).where("everywhere > 1").select("chunk", "h", F.lit(0).cast("long").alias("owner")))
    slices = max(4 * shuffle_partitions(spark), shared.count() // 20_000)
    spans = texts.mapInArrow(partial(_spans, path=answers(shared), slices=slices, least=min_tokens), _SPAN)
    repeats = spans.groupBy("slice").applyInArrow(grouped(_repeats, least=min_tokens), "chunk int, h long")
    path = answers(repeats.withColumn("owner", F.lit(0).cast("long")))
    done = texts.withColumn("__wl_c", _clean(path, min_tokens)(F.col("text"), F.col("host"), F.col("__wl_chunk")))
    return done.select("page_id", "host", "__wl_c.text", "__wl_c.tokens", "__wl_c.removed")

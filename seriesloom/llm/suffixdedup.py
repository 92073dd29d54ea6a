"""Operator 1, suffix-array dedup: the common-prefix interval tree.

A byte goes when a ``WINDOW``-byte string that covers it also starts elsewhere.

Windows are first gathered by minimizer: among the ``K``-byte strings inside a
window, the one with the least hash, leftmost among equals. Equal windows have
equal minimizers at equal places, and consecutive windows with one minimizer form
a run of about a hundred windows, so a run is the unit that is shuffled: its
minimizer's hash, its content's hash and its place. Equal runs that follow each
other, as in a text that repeats itself with a short period, are one row with how
often. Three cases follow from a map-side aggregate over minimizers, each of which
sees the whole corpus:

* a minimizer that occurs once settles its run: nothing in it repeats;
* one whose runs all have the same content settles them too: all of it repeats;
* of a minimizer with different contents, one text of each content is fetched.

The fetched texts are dealt out by minimizer and read as one string per batch, of
which the enhanced suffix array is built (prefix doubling from seven symbols, in
which only suffixes that are not yet told apart are sorted again; LCPs from the ranks
of the doublings). A stack scan over the LCPs closes the intervals of the
common-prefix interval tree; an interval of depth ``WINDOW`` or more whose
occurrences have different left neighbours is a maximal repeat group and is
output with all its occurrences, and the occurrences say which windows repeat.
A minimizer with more than ``LARGE`` contents, such as a phrase of every page, is
not gathered: its texts are cut to single windows, which are their own keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import dropped, keyed, slices, stored

WINDOW = 200
K = 32
#: Contents of one minimizer that are gathered in one task: about 1.5 MB of text,
#: and with its ranks, at about 100 bytes a symbol, 150 MB of a worker's memory.
LARGE = 5000
#: Bytes of fetched text whose suffix array is built at once.
BATCH = 1_000_000
#: Windows of one text that are looked through at once.
STRETCH = 1 << 25


def _minimizers(data: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window: the place of its minimizer; and all hashes."""
    word = data.astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        word = (word[:-step] << np.uint64(shift)) | word[step:]
    n = len(data) - k + 1
    h = np.zeros(n, np.uint64)
    for j, odd in zip(range(0, k, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), strict=True):
        h ^= word[j : j + n]
        h *= np.uint64(odd)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    places = 28  # fixed, as the order of hashes must not depend on what else is in the buffer
    low = (h >> np.uint64(places) << np.uint64(places)) | np.arange(n, dtype=np.uint64)  # leftmost among equals
    span = window - k + 1
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & np.uint64((1 << places) - 1)).astype(np.int64), h


def _runs(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text number, start, windows, how often the
    run follows itself, minimizer hash, content hash."""
    from xxhash import xxh3_64_intdigest

    whole = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(whole) < window:
        return empty
    at, h = _minimizers(np.frombuffer(whole, np.uint8), window)
    ends = np.cumsum(sizes)
    has = np.maximum(sizes - window + 1, 0)
    if not has.sum():
        return empty
    number = np.repeat(np.arange(len(texts)), has)
    start = np.arange(int(has.sum())) - np.repeat(np.cumsum(has) - has, has) + np.repeat(ends - sizes, has)
    place = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, anchor = start[first], place[first]
    hashes = np.fromiter((xxh3_64_intdigest(whole[a:b]) for a, b in zip(begin.tolist(), (begin + count - 1 + window).tolist(), strict=True)), np.uint64, len(first))
    texts_of, low, hashes = number[first], h[anchor].view(np.int64), hashes.view(np.int64)
    again = np.zeros(len(first), bool)
    again[1:] = (texts_of[1:] == texts_of[:-1]) & (low[1:] == low[:-1]) & (hashes[1:] == hashes[:-1]) & (count[1:] == count[:-1])
    head = np.flatnonzero(~again)
    times = np.diff(np.append(head, len(first)))
    texts_of = texts_of[head]
    return texts_of, begin[head] - (ends - sizes)[texts_of], count[head], times, low[head], hashes[head]


def _groups(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``size`` bytes."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def _stretches(texts: list[bytes], window: int) -> Iterator[tuple[int, int, bytes]]:
    """(text number, offset, bytes): long texts in stretches that share no window."""
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - window + 1), STRETCH):
            yield i, at, t if len(t) <= STRETCH else t[at : at + STRETCH + window - 1]


def runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(rid, start, count, times, m, h)``: every text's runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, "text"):
            rid = batch.column(0)
            cut = list(_stretches([(t or "").encode() for t in batch.column(1).to_pylist()], window))
            numbers, offsets = np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64)
            for a, b in _groups([c[2] for c in cut], 400_000):
                who, start, count, times, m, h = _runs([c[2] for c in cut[a:b]], window)
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(numbers[who + a])), pa.array(start + offsets[who + a]), pa.array(count.astype(np.int32)), pa.array(times), pa.array(m), pa.array(h)], names=["rid", "start", "count", "times", "m", "h"])

    return docs.select("rid", "text").mapInArrow(work, f"rid {docs.schema['rid'].dataType.simpleString()}, start long, count int, times long, m long, h long")


_FIRST = 7  # symbols of nine bits that one 64-bit key holds


def suffix_array(symbols: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, LCPs of neighbours (sorted and counted up to twice ``depth``
    at least, which is longer than any run's text) and the symbol to the left of each
    suffix (-1 at the start). Symbols are bytes; a larger one ends a text and occurs once."""
    n = len(symbols)
    symbols = symbols.astype(np.int64)
    ends = symbols > 255
    padded = np.concatenate([np.minimum(symbols, 256) + 1, np.zeros(_FIRST, np.int64)])
    key, alone = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(_FIRST):
        key = (key << 9) | padded[k : k + n]
        alone[: max(0, n - k)] |= ends[k:]
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | alone[sa[1:]]  # what reaches an end is like no other
    rank = np.empty(n, np.int64)  # the slot at which a suffix's group begins
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, length = [rank.astype(np.int32)], _FIRST
    while length < 2 * depth:
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # groups of two and more
        some = sa[slots]
        after = np.where(some + length < n, rank[np.minimum(some + length, n - 1)] + 1, 0)
        key = (rank[some] << 32) | after
        order = np.argsort(key)
        some, key = some[order], key[order]
        sa[slots] = some
        own = np.ones(len(slots), bool)
        own[1:] = key[1:] != key[:-1]
        new[slots] = own
        rank[some] = np.maximum.accumulate(np.where(own, slots, 0))
        length *= 2
        levels.append(rank.astype(np.int32))
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for k in reversed(range(len(levels))):
        size, level = _FIRST << k, levels[k]
        step = np.where((np.maximum(a, b) + size <= n) & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)]), size, 0)
        lcp += step
        a += step
        b += step
    for _ in range(_FIRST - 1):
        step = (np.maximum(a, b) < n) & (symbols[np.minimum(a, n - 1)] == symbols[np.minimum(b, n - 1)])
        lcp += step
        a += step
        b += step
    left = np.where(sa > 0, symbols[np.maximum(sa, 1) - 1], -1)
    return sa, lcp, left


def maximal_repeats(symbols: np.ndarray, depth: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """Maximal repeat groups: (length, all occurrences), lengths from ``depth``.

    A stack scan over the LCPs closes the intervals of the common-prefix tree
    from the inside out. A group is output when its occurrences have different
    left neighbours; with a single one it is part of a longer repeat, which is
    output itself. Lengths are exact below twice ``depth``.
    """
    if len(symbols) < 2:
        return
    sa, lcp, left = suffix_array(symbols, depth)
    deep = np.flatnonzero(lcp >= depth)
    if not len(deep):
        return
    for stretch in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        low, high = int(stretch[0]), int(stretch[-1]) + 1  # suffixes low..high
        heights = lcp[low:high].tolist()
        changes = np.concatenate([[0], np.cumsum(left[low + 1 : high + 1] != left[low:high])]).tolist()
        stack: list[tuple[int, int]] = []
        for i, height in enumerate([*heights, 0]):
            begin = i
            while stack and stack[-1][1] > height:
                begin, top = stack.pop()
                if changes[i] > changes[begin]:
                    yield top, sa[low + begin : low + i + 1]
            if height >= depth and (not stack or stack[-1][1] < height):
                stack.append((begin, height))


def _repeated(parts: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each part (a run's text), which of its windows occur in another."""
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64)
    symbols[begins + sizes - 1] = 256 + np.arange(len(parts))  # an end of its own for each part
    change = np.zeros(len(symbols) + 1, np.int64)
    for length, places in maximal_repeats(symbols, window):
        change[places] += 1  # places differ within a group
        change[places + length - window + 1] -= 1
    hit = np.cumsum(change) > 0
    return [hit[b : b + n] for b, n in zip(begins.tolist(), counts.tolist(), strict=True)]


def _intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _fetch(window: int):
    """Cuts each wanted run's bytes out of its document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500, "text"):
            out = {"m": [], "h": [], "count": [], "large": [], "part": []}
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                for r in wanted:
                    for name in ("m", "h", "count", "large"):
                        out[name].append(r[name])
                    out["part"].append(data[r["start"] : r["start"] + r["count"] - 1 + window])
            yield pa.RecordBatch.from_arrays([pa.array(out["m"], pa.int64()), pa.array(out["h"], pa.int64()), pa.array(out["count"], pa.int32()), pa.array(out["large"], pa.bool_()), pa.array(out["part"], pa.binary())], names=list(out))

    return work


def _search(window: int, batch_bytes: int):
    """Reads rows sorted by m and searches whole groups of one m together."""

    def found(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        m, h, a, b = [], [], [], []
        for r, hit in zip(rows, _repeated([r[3] for r in rows], np.array([r[2] for r in rows]), window), strict=True):
            for x, y in _intervals(hit):
                m.append(r[0])
                h.append(r[1])
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (m, h, a, b)], names=["m", "h", "a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group, size, more = [], [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if group and row[0] != group[-1][0]:  # a whole group joins the batch, or starts the next
                    if rows and size + more > batch_bytes:
                        yield found(rows)
                        rows, size = [], 0
                    rows += group
                    size += more
                    group, more = [], 0
                group.append(row)
                more += len(row[3])
        if rows and size + more > batch_bytes:
            yield found(rows)
            rows = []
        if rows or group:
            yield found(rows + group)

    return work


def _single_windows(window: int):
    """The windows of long lists' texts, each by its own hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            m, h, at, key = [], [], [], []
            for a, b, n, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for x in range(n):
                    m.append(a)
                    h.append(b)
                    at.append(x)
                    key.append(xxh3_128_digest(part[x : x + window]))
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int64()), pa.array(key, pa.binary())], names=["m", "h", "a", "key"])

    return work


def repeated_spans(docs: DataFrame, window: int = WINDOW, large: int = LARGE, batch_bytes: int = BATCH) -> DataFrame:
    """``(rid, a, b)``: stretches of bytes [a, b) of each text that windows which
    occur elsewhere cover; they may overlap. ``docs`` has rid, unique, and text."""
    spark = docs.sparkSession
    every = stored(runs(docs, window), "runs")
    often = every.groupBy("m").agg(F.sum("times").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n > 1").select("m", F.expr("lo = hi").alias("alike"))
    often = stored(often, "often")  # so that both sides of the join are plain exchanges, which adaptive execution can split
    shared = stored(every.join(often, "m"), "shared")
    dropped(every)
    dropped(often)

    contents = shared.where("NOT alike").groupBy("m", "h").agg(F.sum("times").alias("n"), F.min(F.struct("rid", "start", "count")).alias("r"))
    contents = stored(contents.select("m", "h", "n", "r.*"), "contents")
    sizes = contents.groupBy("m").agg((F.count("*") > large).alias("large"))
    wanted = contents.join(sizes, "m").groupBy("rid").agg(F.collect_list(F.struct("start", "count", "m", "h", "large")).alias("wanted"))  # at most a text's runs
    parts = stored(docs.join(wanted, "rid").select("text", "wanted").mapInArrow(_fetch(window), "m long, h long, count int, large boolean, part binary"), "parts")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = parts.where("NOT large").select("m", "h", "count", "part")
    hits = few.repartition(n, "m").sortWithinPartitions("m").mapInArrow(_search(window, batch_bytes), "m long, h long, a long, b long")
    many = parts.where("large").select("m", "h", "count", "part")
    if not many.isEmpty():
        single = many.mapInArrow(_single_windows(window), "m long, h long, a long, key binary")
        twice = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        hits = hits.unionByName(single.join(twice, "key").select("m", "h", "a", (F.col("a") + 1).alias("b")))
    # What has one place takes its hits; contents with several places repeat whole.
    once = contents.where("n = 1").select("m", "h", "rid", "start")
    part = hits.join(once, ["m", "h"]).select("rid", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") - 1 + window).alias("b"))
    ends = (F.col("start") + F.col("count") * F.col("times") - 1 + window).alias("b")
    whole = shared.where("alike").select("rid", F.col("start").alias("a"), ends)
    again = shared.where("NOT alike").join(contents.where("n > 1").select("m", "h"), ["m", "h"]).select("rid", F.col("start").alias("a"), ends)
    return part.unionByName(whole).unionByName(again)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, batch_bytes: int = BATCH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    kept (binary: a cut may fall inside a character).

    Texts are UTF-8 bytes, null is empty; no match crosses documents, and strings
    are judged on the input. Repeated and null ids keep a row each. Texts shorter
    than the window lose nothing. An empty table gives no rows. Other columns are
    not read.
    """
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", "rid")
    spans = repeated_spans(rows.select("rid", "text"), window, large, batch_bytes)
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # at most a text's runs
    joined = rows.join(spans, "rid", "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "text"):
            size, removed, count, sha, kept = [], [], [], [], []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, gone, n, keep = (text or "").encode(), 0, 0, 0, []
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in cut or ()):
                    if a > end:
                        keep.append(data[at:a])
                        n += 1
                        end = at = a
                    if b > end:
                        gone += b - end
                        end = at = b
                rest = b"".join([*keep, data[at:]])
                size.append(len(data))
                removed.append(gone)
                count.append(n)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(sha), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(work, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Operator 3, SimHash near-duplicates by a byte-position inverted index.

``near_duplicates``: a fingerprint has eight bytes, each at its own position. Two
fingerprints at most ``d`` bits apart differ in at most ``d`` bytes, so they share
``8 - d`` positional bytes or more: the guaranteed minimum of the count filter
(four, for ``d = 4``). One list for each single positional byte would hold a 256th
of all documents and the tally over such lists would be quadratic. The lists are
therefore kept for each set of ``8 - d`` positions, where a tally that reaches
the minimum shows as one shared key; every candidate is then verified bit by bit.

Copies are one entry, with their smallest id. Within a list only the edges of a
spanning forest leave, never all pairs. A list beyond ``LONG_LIST`` entries is
not gathered: its entries meet through midpoints (two codes are at most four
bits apart exactly when some code lies within two bits of both), a linear number
of rows that are grouped with map-side aggregation.

``similar_documents`` links by an exact Jaccard similarity of word shingles. At 0.8
about 15 of 100 SimHash bits differ, so 64 bits cannot tell such copies from the
rest, and no number of bytes leaves a guaranteed minimum above zero. The fingerprint
then has ``WIDE`` bytes, the lists are those of ``LISTS`` sets of ``TOGETHER``
positions, drawn once by a fixed rule, each cut by octaves of the sets' sizes with an
offset of its own, so that few unrelated sets meet, and the count filter asks for ``LEAST_SHARED``
positional bytes, which all but about one in a thousand such copies have. What it
keeps is compared by its shingles, so no false link is made; a copy of exactly 0.8
is found with a probability of about 0.97, one of 0.85 nearly always.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import components, dropped, slices, stored

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Entries of a list up to which one task compares them directly.
LONG_LIST = 4096
#: For links by Jaccard: bytes of a fingerprint, positions of a list, lists, the
#: count filter's minimum, and the bits that may differ.
WIDE = 64
TOGETHER = 3
LISTS = 240
LEAST_SHARED = 4
MOST_APART = 128
THRESHOLD = 0.8


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; none for no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    spans = zip(starts, ends[shingle - 1 :] or ends[-1:])  # the shorter ends it: no shingle begins after
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles, as an unsigned number; 0 for no words."""
    hashes = shingles(text, shingle, seed)
    return _majority(hashes) if len(hashes) else 0


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, fp the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, "text"):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(distance: int) -> list[int]:
    """A signed mask for each set of ``8 - distance`` byte positions."""
    found = []
    for held in combinations(range(8), 8 - distance):
        mask = sum(0xFF << (8 * p) for p in held)
        found.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return found


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, smallest code) that connect what is linked within one list."""
    m = len(fps)
    label, block = np.arange(m), max(1, 2_000_000 // m)
    while True:
        new = label.copy()
        for at in range(0, m, block):
            near = np.bitwise_count(fps[at : at + block, None] ^ fps[None, :]) <= distance
            new[at : at + block] = np.where(near, label[None, :], m).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = np.arange(m)
    child = own[label != own]
    return fps[child], fps[label[child]]


def _list_edges(distance: int):
    def pairs(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All complete lists of a sorted stretch."""
        fps = fps.view(np.uint64)  # bits of negative numbers count as they are
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.append(starts, len(fps)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        a, b = [fps[two]], [fps[two + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = _forest(fps[s : s + n], distance)
            a.append(x)
            b.append(y)
        return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, keys = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        for batch in batches:
            fps = np.concatenate([fps, batch.column(2).to_numpy()])
            keys = np.concatenate([keys, np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)])
            last = np.flatnonzero((keys != keys[-1]).any(axis=1)) if len(keys) else []
            done = int(last[-1]) + 1 if len(last) else 0  # the last list may go on in the next batch
            if done:
                a, b = pairs(fps[:done], keys[:done])
                fps, keys = fps[done:], keys[done:]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if len(fps):
            a, b = pairs(fps, keys)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _long_list_edges(entries: DataFrame, distance: int) -> DataFrame:
    """Edges within long lists, through the codes that lie half-way."""
    half = distance // 2
    rows = []
    for s, mask in enumerate(_masks(distance)):
        free = [b for b in range(64) if not (mask >> b) & 1]
        for k in range(half + 1):
            for bits in combinations(free, k):
                flip = sum(1 << b for b in bits)
                rows.append((s, flip - (1 << 64) if flip >= 1 << 63 else flip))
    # A fixed table: 70 sets of positions by 529 flips, whatever the input.
    flips = F.broadcast(entries.sparkSession.createDataFrame(rows, "s int, flip long").groupBy("s").agg(F.collect_list("flip").alias("flips")))
    near = entries.join(flips, "s").select("s", "key", "fp", F.explode("flips").alias("flip"))
    near = near.select("s", "key", F.expr("fp ^ flip").alias("mid"), "fp")
    low = near.groupBy("s", "key", "mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return near.join(low.hint("merge"), ["s", "key", "mid"]).where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def links(codes: DataFrame, distance: int = DISTANCE, long_list: int = LONG_LIST) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column fp) with the same
    connected components as all pairs at most ``distance`` bits apart."""
    if distance not in (2, 4):
        raise ValueError("the distance must be 2 or 4")
    spark = codes.sparkSession
    masks = _masks(distance)
    keyed = codes.select("fp", F.posexplode(F.array(*[F.expr(f"fp & {m}L") if m != -(1 << 63) else F.col("fp") for m in masks])).alias("s", "key"))
    sizes = keyed.groupBy("s", "key").agg(F.count("*").alias("size")).where("size > 1")
    # Spark takes an exploded table for hardly larger than what it is made of, and would
    # gather its 70 rows a code on the driver.
    listed = stored(keyed.join(sizes.hint("merge"), ["s", "key"]).select("s", "key", "fp", "size"), "lists")
    short = listed.where(F.col("size") <= long_list).select("s", "key", "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = short.repartition(n, "s", "key").sortWithinPartitions("s", "key", "fp").mapInArrow(_list_edges(distance), "a long, b long").distinct()
    long = listed.where(F.col("size") > long_list).select("s", "key", "fp")
    if long.isEmpty():
        return edges
    return edges.unionByName(_long_list_edges(long, distance))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    component_id is the smallest id reachable, the document's own included.
    Null and empty texts and texts of white space have fingerprint zero and are
    linked like any other. Repeated ids keep a row each. A document without an
    id never names a component while another member has one. Other columns are
    not read. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    codes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "codes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = components(links(codes.select("fp").repartition(n), distance, long_list)).withColumnRenamed("node", "fp")
    joined = codes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    # Nor do rows of many copies go by the size of their packed file.
    return rows.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xFF51AFD7ED558CCD], np.uint64)
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)
_PARTS = [f"p{i}" for i in range(WIDE // 8)]


def positions(lists: int = LISTS) -> np.ndarray:
    """The positions of each list, distinct within one: drawn once, always the same."""
    rng = np.random.default_rng(7)
    return np.array([np.sort(rng.choice(WIDE, TOGETHER, replace=False)) for _ in range(lists)])


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The ``WIDE`` bytes of the SimHash of distinct shingle hashes, as signed longs:
    a bit is 1 if set in over half of them."""
    counts = np.zeros(8 * WIDE, np.float64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384, None] * _LANES
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        part ^= part >> np.uint64(29)
        every = part.view(np.uint8).reshape(len(part), WIDE)
        if len(part) < 200:
            counts += np.unpackbits(every, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        else:  # by the values each positional byte takes
            seen = np.bincount((every + 256 * np.arange(WIDE)).ravel(), minlength=256 * WIDE)
            counts += (seen.reshape(WIDE, 256).astype(np.float32) @ _BIT_OF).ravel()
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


def _wide(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, code, n, p0 ..)`` of each document: a hash of its shingle set, the
    set's size, and its wide fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, 1000, "text"):
            sets = [np.unique(shingles(t, shingle)) for t in batch.column(1).to_pylist()]
            code = [xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
            parts = np.stack([wide_fingerprint(x) for x in sets])
            columns = [batch.column(0), pa.array(code, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), *[pa.array(np.ascontiguousarray(parts[:, i])) for i in range(len(_PARTS))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "code", "n", *_PARTS])

    return docs.mapInArrow(run, f"doc_id {kind}, code long, n int, {', '.join(f'{p} long' for p in _PARTS)}")


def _posts(classes: DataFrame, lists: int) -> DataFrame:
    """``(id, code)``: one row for each list that a class is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, offset = positions(lists), np.arange(lists) * 0.6180339887498949 % 1
        for batch in batches:
            for some in slices(iter([batch]), 2000):
                parts = np.stack([some.column(i + 1).to_numpy() for i in range(len(_PARTS))], axis=1)
                every = np.ascontiguousarray(parts).view(np.uint8).reshape(len(parts), WIDE)
                octave = np.log2(some.column(len(_PARTS) + 1).to_numpy())[:, None] + offset
                ids = np.arange(lists, dtype=np.int64) * 64 + octave.astype(np.int64)
                for k in range(TOGETHER):
                    ids = (ids << 8) | every[:, which[:, k]]
                yield pa.RecordBatch.from_arrays([pa.array(ids.ravel()), pa.array(np.repeat(some.column(0).to_numpy(), lists))], names=["id", "code"])

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return classes.where("n > 0").select("code", *_PARTS, "n").repartition(n).mapInArrow(run, "id long, code long")


def _apart(a: str, b: str) -> str:
    return "(" + " + ".join(f"bit_count({a}.{x} ^ {b}.{x})" for x in _PARTS) + ")"


def _shared(a: str, b: str) -> str:
    """The tally of positional bytes that a and b share."""
    tally = []
    for x in _PARTS:
        bits = f"({a}.{x} ^ {b}.{x})"
        for shift in (4, 2, 1):  # the lowest bit of each byte tells whether it differs
            bits = f"({bits} | shiftrightunsigned({bits}, {shift}))"
        tally.append(f"bit_count({bits} & 72340172838076673L)")
    return f"({WIDE} - ({' + '.join(tally)}))"


def _counted(a: str, b: str, t: Fraction) -> str:
    """The length filter, the bits that differ, and the count filter."""
    length = f"{a}.n * {t.numerator} <= {b}.n * {t.denominator} AND {b}.n * {t.numerator} <= {a}.n * {t.denominator}"
    return f"{length} AND {_apart(a, b)} <= {MOST_APART} AND {_shared(a, b)} >= {LEAST_SHARED}"


def _alike(docs: DataFrame, classes: DataFrame, pairs: DataFrame, t: Fraction, shingle: int) -> DataFrame:
    """Pairs (a, b) of codes whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500, "text"):
            sets = [np.unique(shingles(x, shingle)).view(np.int64) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["code", "ids"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct()
    wanted = classes.select("code", "low").join(ends, "code", "left_semi").withColumnRenamed("low", "doc_id")
    sets = stored(docs.join(wanted, "doc_id").select("code", "text").mapInArrow(run, "code long, ids array<long>"), "sets")
    both = pairs.join(sets.select(F.col("code").alias("a"), F.col("ids").alias("x")), "a")  # one set travels for a pair
    both = both.join(sets.select(F.col("code").alias("b"), F.col("ids").alias("y")), "b")
    p, q = t.numerator, t.denominator
    alike = stored(both.where(f"size(array_intersect(x, y)) * {p + q} >= (size(x) + size(y)) * {p}").select("a", "b"), "alike")
    dropped(sets)
    return alike


def similar_links(docs: DataFrame, classes: DataFrame, t: Fraction, shingle: int, lists: int = LISTS) -> DataFrame:
    """Edges ``(a, b)`` between codes that are similar enough: as many as join all
    that the lists bring together.

    A group of near copies would make pairs by the square. So first the entries of
    each list meet two leaders, the first by code and one that is another in each
    list; each class is compared with the closest of either kind, and what these
    links join is one group; then only entries of different groups meet.
    """
    posts = stored(_posts(classes, lists), "posts")
    often = posts.groupBy("id").agg(F.count("*").alias("size")).where("size > 1").select("id")
    listed = stored(posts.join(often, "id"), "lists")
    dropped(posts)
    facts = classes.select("code", "n", *_PARTS)

    lead = [F.min(F.struct(h.alias("h"), "code")) for h in (F.col("code"), F.xxhash64("id", "code"))]
    leads = listed.groupBy("id").agg(F.array(*lead).alias("l")).select("id", F.posexplode("l").alias("kind", "l")).select("id", "kind", F.col("l.code").alias("b"))
    met = listed.join(leads, "id").where("code != b").select("kind", F.col("code").alias("a"), "b").distinct()
    both = met.join(facts.withColumnRenamed("code", "a"), "a").select("kind", "a", "b", F.struct("n", *_PARTS).alias("x"))
    both = both.join(facts.withColumnRenamed("code", "b"), "b").select("kind", "a", "b", "x", F.struct("n", *_PARTS).alias("y"))
    near = both.where(_counted("x", "y", t)).groupBy("kind", "a").agg(F.min(F.struct(F.expr(_apart("x", "y")).alias("apart"), "b")).alias("l"))  # the closest leader
    pairs = stored(near.select(F.least("a", "l.b").alias("a"), F.greatest("a", "l.b").alias("b")).distinct(), "pairs")
    led = _alike(docs, classes, pairs, t, shingle)

    groups = components(led).withColumnRenamed("node", "code")
    rows = stored(listed.join(groups, "code", "left").withColumn("root", F.coalesce("root", "code")), "grouped")
    dropped(listed)
    mixed = rows.groupBy("id").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u != v").select("id")
    left = stored(rows.join(mixed, "id").join(facts, "code"), "mixed")
    dropped(rows)
    # Either side is the same exchange.
    met = left.alias("a").join(left.alias("b"), F.expr(f"a.id = b.id AND a.code < b.code AND a.root != b.root AND {_counted('a', 'b', t)}"))
    more = stored(met.selectExpr("a.code AS a", "b.code AS b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    dropped(left)
    dropped(pairs)
    return led.unionByName(_alike(docs, classes, more, t, shingle))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, lists: int = LISTS) -> DataFrame:
    """``(doc_id, component_id)`` for every document, component_id the smallest id
    of its group: documents joined by links of that Jaccard similarity or more.

    Ids are not repeated and not null; they may be structs. A text of fewer words
    than a shingle is one shingle. Null and empty texts and texts of white space
    have no shingle and are one group. Equal shingle sets are one class. Other
    columns are not read. An empty table gives no rows.
    """
    t = Fraction(str(threshold))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = stored(_wide(docs, shingle), "wide")
    held = [F.first(c).alias(c) for c in ("n", *_PARTS)]  # the same in all copies
    classes = stored(every.groupBy("code").agg(F.min("doc_id").alias("low"), *held), "classes")
    codes = stored(every.select("doc_id", "code"), "codes")
    dropped(every)
    edges = similar_links(docs, classes, t, shingle, lists)
    found = components(edges).withColumnRenamed("node", "code")
    joined = classes.select("code", "low").join(found, "code", "left").withColumn("root", F.coalesce("root", "code"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(lowest, "root").select("code", "component_id")
    return codes.join(named, "code").select("doc_id", "component_id")

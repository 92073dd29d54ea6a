"""Operator 9, document fingerprints: one-permutation MinHash.

Only DataFrame functions. The 64-bit hashes of a text's five-word shingles are
binned once by their top bits and each bin keeps its least hash. An empty bin
copies a full one by optimal densification: it walks an order of the bins that
is its own and the same for every text, until it meets a bin that was full. The
order is a list of ``TRIES`` hashed bins, then all bins by a hashed rank. A
fingerprint stores the low ``BITS`` bits of each bin, one hexadecimal digit;
two unrelated bins agree by chance with probability ``2 ** -BITS``, which the
likeness corrects for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import WORD_GAP

SHINGLE = 5
BINS = 256
BITS = 4
TRIES = 16
#: Stretches of ids for each shuffle partition when documents meet their next.
STRETCHES = 4
_SHIFT = 64 - BINS.bit_length() + 1
_EMPTY = (1 << _SHIFT) - 1


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _tries() -> list[int]:
    """Bins that each bin tries in turn: a fixed table made by rule."""
    out, state = [], 88172645463325252
    for _ in range(BINS * TRIES):
        state ^= (state << 13) & (2**64 - 1)
        state ^= state >> 7
        state ^= (state << 17) & (2**64 - 1)
        out.append((state >> 20) % BINS)
    return out


def _sentinels() -> list[int]:
    """The largest hash of each bin, as signed numbers: what an empty bin holds."""
    found = [(b << _SHIFT) | _EMPTY for b in range(BINS)]
    return [v - (1 << 64) if v >= 1 << 63 else v for v in found]


def add_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: an array of BINS hashes for the column ``text``, or
    null for a text without words."""
    w, h, s, b, f, t = (f"__{out}_{x}" for x in "whsbft")
    df = df.withColumn(w, F.transform(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP), ""), lambda x: F.xxhash64(x)))
    each = ", ".join(f"{w}[i + {k}]" for k in range(SHINGLE))
    # Fewer words than a shingle: the whole sequence is one, told apart by its length.
    few = ", ".join(f"coalesce(get({w}, {k}), {k - SHINGLE}L)" for k in range(SHINGLE - 1))
    df = df.withColumn(h, F.expr(f"CASE WHEN size({w}) >= {SHINGLE} THEN transform(sequence(0, size({w}) - {SHINGLE}), i -> xxhash64({each})) WHEN size({w}) > 0 THEN array(xxhash64({few})) END"))
    df = df.withColumn(s, F.when(F.col(h).isNotNull(), F.sort_array(F.concat(F.col(h), _longs(_sentinels())))))
    df = df.withColumn(b, F.expr(f"filter({s}, (x, i) -> i = 0 OR shiftrightunsigned(x, {_SHIFT}) != shiftrightunsigned({s}[i - 1], {_SHIFT}))"))
    df = df.withColumn(f, F.expr(f"filter(sequence(0, {BINS - 1}), i -> ({b}[i] & {_EMPTY}L) != {_EMPTY}L)"))
    df = df.withColumn(t, _longs(_tries()).cast("array<int>"))
    tried = ", ".join(f"IF(({b}[{t}[i * {TRIES} + {k}]] & {_EMPTY}L) != {_EMPTY}L, {b}[{t}[i * {TRIES} + {k}]], NULL)" for k in range(TRIES))
    ranked = f"{b}[int(array_min(transform({f}, j -> (xxhash64(i, j) & -{BINS}L) | j)) & {BINS - 1})]"
    df = df.withColumn(out, F.expr(f"transform({b}, (x, i) -> IF((x & {_EMPTY}L) != {_EMPTY}L, x, coalesce({tried}, {ranked})))"))
    return df.drop(w, h, s, b, f, t)


def packed(bins: Column) -> Column:
    """The low bits of each bin as hexadecimal digits; no words: empty."""
    digits = F.transform(bins, lambda x: F.substring(F.lit("0123456789abcdef"), x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1, F.lit(1)))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of two texts' shingles from their bins' low
    bits, corrected for chance. Two texts without words are alike (1); one
    without and one with are not (0)."""
    mask = (1 << BITS) - 1
    same = f"aggregate(zip_with({a}, {b}, (x, y) -> IF((x & {mask}L) = (y & {mask}L), 1, 0)), 0, (t, x) -> t + x) / double({BINS})"
    chance = 2.0**-BITS
    return F.expr(f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0D WHEN {a} IS NULL OR {b} IS NULL THEN 0.0D ELSE greatest(0.0D, ({same} - {chance}D) / {1 - chance}D) END")


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the packed fingerprint of ``text_col``."""
    return add_bins(docs, text_col, "__bins").withColumn(out, packed(F.col("__bins"))).drop("__bins")


def _stretch(bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most doc_id, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    listed = F.col("__bounds")
    jump = F.aggregate(
        _longs(steps).cast("array<int>"), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at)
    )
    return F.coalesce(jump, F.lit(-1))


def with_edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is that of the next lower id; after the lowest comes the
    highest. Rows with one id follow each other by text, null ids come last. Null
    counts as empty; a text without words has an empty fingerprint. Ids are
    integers. Other columns are not read. An empty table gives no rows.

    Ids are cut at quantiles into stretches, so every text is shuffled once, to
    its stretch; the first text of each stretch, one row a stretch, is joined to
    the last row of the one before.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = STRETCHES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(q) for q in docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)})
    docs = docs.withColumn("__bounds", _longs(bounds) if bounds else F.array().cast("array<bigint>"))
    docs = docs.withColumn("stretch", F.when(F.col("doc_id").isNull(), -1).otherwise(_stretch(bounds))).drop("__bounds")

    # The first document of each stretch, and which stretch it follows: one row a stretch.
    tops = docs.groupBy("stretch").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("stretch")).collect()
    if not tops:
        follows = spark.createDataFrame([], "stretch int, before int, doc_id long")
    else:
        follows = spark.createDataFrame([(r.stretch, tops[i - 1].stretch, r.doc_id) for i, r in enumerate(tops)], "stretch int, before int, doc_id long")
    first = docs.select("doc_id", "text").join(F.broadcast(follows), docs["doc_id"].eqNullSafe(follows["doc_id"]))
    first = first.groupBy("before").agg(F.min("text").alias("first_text")).withColumnRenamed("before", "stretch")
    first = add_bins(first, "first_text", "first_bins")

    down = Window.partitionBy("stretch").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = docs.withColumn("next_text", F.lead("text").over(down)).withColumn("last", F.lead(F.lit(False), 1, True).over(down))
    rows = add_bins(rows, "text", "bins")
    rows = rows.withColumn("next_bins", F.lead("bins").over(down))
    rows = rows.join(first, "stretch")
    rows = rows.withColumn("next_text", F.when(F.col("last"), F.col("first_text")).otherwise(F.col("next_text")))
    rows = rows.withColumn("next_bins", F.when(F.col("last"), F.col("first_bins")).otherwise(F.col("next_bins"))).drop("first_text", "first_bins")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(next_text, 1, int(n_chars div 2)))")).drop("text", "next_text")
    rows = add_bins(rows, "edited", "edited_bins")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"),
        likeness("bins", "next_bins").alias("near_next"),
    )

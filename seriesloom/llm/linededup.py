"""Operator 2, line dedup: an exact set-similarity join over lines.

Only DataFrame functions. A line is the set of its words; a line goes when an
earlier line, in the order of (doc_id, line number), is at least ``THRESHOLD``
similar by Jaccard, whether that one stays or goes. Lines without words stay.

Equal sets are one class with its first place. The words of a class are put in
one global order of rarity: by their counts over all documents (a fixed table of
hashed counters), then by hash. Two classes that are similar enough share a word
among the first ``n - ceil(t * n) + 1`` of each, so only those are posted; of the one
with fewer words ``n - ceil(2t / (1 + t) * n) + 1`` do. The lists are cut by octaves of
n, which most similar pairs have in common; the class of fewer words is also listed in
the octave after, if it can have a partner there. Pairs that meet on a posted word pass the length filter, the positional filter and a
parity filter (each word flips one of 64 or 128 bits; as many bits differ at most as
words do), then their word sets are compared exactly. A pair that shares one of its
first two posted words is made there and not again on later ones.

Groups of near copies would meet in long lists and make pairs by the square. So
first each class is compared with leaders, the ``CLOSEST`` of the first ``LEADERS``
classes that have two of five of its words next to each other; what a leader settles
needs no other partner. The five are those of least hash among its words of a middling
count: where copies differ, in slips or a sentence of their own, is often rarer than
what they share, and the rarest words would leave them without their group's leaders. Only the unsettled look through the lists, against
all earlier classes, settled or not, which keeps the result exact.

Joins ask for sorted exchanges at every size, so that the plan for little data is the
plan for much, and adaptive execution can split their hot keys.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import dropped, keyed, stored, unused

THRESHOLD = 0.8
#: Hashed counters of words: a fixed number, whatever the corpus.
COUNTERS = 1 << 17
#: First classes of each leader key: a fixed number of rows for every class.
LEADERS = 16
#: Words that make leader keys, two by two, and the closest leaders that are compared.
KEY_WORDS = 5
CLOSEST = 8
#: Words from which a class has 128 parity bits: 64 bits of two unrelated sets of 50
#: differ by 32 at most times, which is too near to what similar sets may differ by.
WIDE = 40
#: White space between words, a line's end aside.
_GAPS = "\t\x0b\x0c\r"


def _spaced(text: Column) -> Column:
    """A text, null an empty one, with a space for every gap. Most have no other gap,
    which is looked for as a plain character."""
    text = F.coalesce(text, F.lit(""))
    spaced = text
    for gap in _GAPS:
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    return F.when(reduce(Column.__or__, [F.contains(text, F.lit(gap)) for gap in _GAPS]), spaced).otherwise(text)


def _word_set(line: Column) -> Column:
    """Hashes of the words of a line whose gaps are spaces, each once."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    gaps = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == "")
    return F.array_distinct(F.when(gaps, F.array_remove(hashes, F.xxhash64(F.lit("")))).otherwise(hashes))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line_no, line)`` for every line of every text, gaps as spaces."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(_spaced(F.col(text_col)), "\n")).alias("line_no", "line"))


def rarity(docs: DataFrame, text_col: str = "text") -> tuple[list[int], int]:
    """A rank, from 0 for rare, for each hashed counter, from the counts of all words
    of all documents (two digits at most, as plans are printed with them); and the rank
    with half of all words before it."""
    words = docs.select(F.explode(F.split(F.replace(_spaced(F.col(text_col)), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w != ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(COUNTERS - 1)).alias("c")).agg(F.count("*").alias("n")).toArrow()  # COUNTERS rows at most
    n = np.zeros(COUNTERS)
    n[counts["c"].to_numpy()] = counts["n"].to_numpy()
    ranks = np.minimum(99, 2 * np.log2(np.maximum(n, 1))).astype(np.int64)
    before = np.cumsum(np.bincount(ranks, n))
    return ranks.tolist(), int(np.searchsorted(before, before[-1] / 2))


def classed(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line that has words, with its class (k1, k2), the number n of its
    words, its parities, the keys of its leaders, and its posted words."""
    ranked, half = rarity(docs, text_col)
    # From twice the middle counter's count to a sixteenth of the largest.
    low, high = int(np.median([r for r in ranked if r] or [0])) + 2, max(ranked) - 8
    ranks = F.split(F.lit(",".join(map(str, ranked))), ",").cast("array<bigint>")
    t = Fraction(str(threshold))
    # A cheap test, so that the word sets are made once and not again for a filter.
    df = lines(docs, id_col, text_col).where(F.ltrim("line") != "")
    df = df.select("doc_id", "line_no", _word_set(F.col("line")).alias("h"), ranks.alias("ranks"))
    # Arrays that hold no null for certain are sorted as plain numbers.
    ids = f"sort_array(transform(h, x -> shiftleft(coalesce(get(ranks, int(x & {COUNTERS - 1}L)), 0L), 56) | shiftrightunsigned(x, 8)))"
    df = df.select("doc_id", "line_no", F.size("h").alias("n"), F.expr(ids).alias("ids"))
    # The ids are in the order of ranks, so those of some ranks are a stretch of them. All
    # slices are columns before a lambda sees them: within one they take boxed numbers.
    bounds = {"start": low, "end": high + 1, "half": half}
    df = df.withColumn("bounded", F.expr(f"sort_array(concat(ids, array({', '.join(f'{rank << 56}L' for rank in bounds.values())})))"))
    for k, rank in bounds.items():
        # The bounds of less rank come before; of two bounds that are alike the first is found.
        before = sum(other < rank for other in bounds.values())
        df = df.withColumn(k, F.expr(f"int(array_position(bounded, {rank << 56}L)) - {1 + before}"))
    cuts = {"middling": "start + 1, greatest(end - start, 0)", "rare": f"1, n - int(ceil(n * {t.numerator}L / {t.denominator}L)) + 1"}
    # Words of the ranks before the half flip bits of the one half, the others of the other.
    cuts |= {"minus": "1, half", "plus": "half + 1, n"}
    df = df.select("doc_id", "line_no", "n", "ids", *[F.expr(f"slice(ids, {cut})").alias(k) for k, cut in cuts.items()])
    some = f"slice(concat(slice(sort_array(transform(middling, x -> x & {(1 << 56) - 1}L)), 1, {KEY_WORDS}), ids), 1, {KEY_WORDS})"
    flipped = [F.expr(f"aggregate({k}, 0L, (p, x) -> p ^ shiftleft(1L, int(x & 63)))").alias(f"p_{k}") for k in ("minus", "plus")]
    df = df.select("doc_id", "line_no", "n", "ids", "rare", F.expr(some).alias("some"), *flipped)
    return df.select(
        "doc_id",
        "line_no",
        F.xxhash64("ids").alias("k1"),
        F.hash("ids").alias("k2"),
        "n",
        F.expr(f"IF(n <= {WIDE}, p_minus ^ p_plus, p_minus)").alias("p1"),
        F.expr(f"IF(n <= {WIDE}, 0L, p_plus)").alias("p2"),
        F.array_distinct(F.array(*[F.hash(F.get("some", F.lit(i)), F.get("some", F.lit(i + 1))) for i in range(KEY_WORDS - 1)])).alias("keys"),
        F.expr("transform(rare, x -> int(x & 2147483647L))").alias("posted"),
    )


_BITS = ["p1", "p2"]
#: Bits that differ between two classes, at the width of the narrower.
_APART = f"""IF(a.n > {WIDE} AND b.n > {WIDE}, bit_count(a.p1 ^ b.p1) + bit_count(a.p2 ^ b.p2), bit_count(a.p1 ^ a.p2 ^ b.p1 ^ b.p2))"""


def _close(t: Fraction) -> str:
    """Whether class b (earlier) can be similar enough to a, by length and parity."""
    p, q = t.numerator, t.denominator
    return f"a.n * {p} <= b.n * {q} AND b.n * {p} <= a.n * {q} AND (a.n + b.n - {_APART}) * {p + q} >= (a.n + b.n) * {2 * p}"


#: Hashes hardly repeat, so dictionaries of them are built in vain.
_HASHES = {f"parquet.enable.dictionary#{c}": "false" for c in ("k1", "k2", *_BITS, "keys.list.element", "posted.list.element", "h.list.element")}
_EARLIER = "(b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line_no < a.line_no))"
#: Whether the pair is made here: not on a word behind one of the first two that both
#: have, one in either half of ``w``.
_HERE = "NOT (a.at > 0 AND b.at > 0 AND shiftright(a.w ^ b.w, 32) = 0) AND NOT (a.at > 1 AND b.at > 1 AND ((a.w ^ b.w) & 4294967295L) = 0)"


def _packed(condition: str) -> str:
    """A condition on line_no, n, at, guest and done, of the columns they are packed in."""
    places = {"line_no": "shiftright({}.ln, 32)", "n": "({}.ln & 2147483647L)", "at": "shiftright({}.ad, 2)", "guest": "({}.ad & 2)", "done": "({}.ad & 1)"}
    return re.sub(r"\b([ab])\.(line_no|n|at|guest|done)\b", lambda m: places[m[2]].format(m[1]), condition)


def _verified(docs: DataFrame, pairs: DataFrame, t: Fraction, id_col: str, text_col: str, label: str) -> DataFrame:
    """The lines (doc_id, line_no), stored, whose word sets are similar to those of one of
    their (to_doc, to_line)."""
    ends = pairs.select("doc_id", "line_no").unionByName(pairs.select(F.col("to_doc").alias("doc_id"), F.col("to_line").alias("line_no")))
    wanted = ends.groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted"))  # at most a text's lines
    texts = docs.select(F.col(id_col).alias("doc_id"), _spaced(F.col(text_col)).alias("text")).join(wanted.hint("merge"), "doc_id")
    # The lines are bound once, and the wanted ones taken by their numbers.
    cut = F.transform(F.array(F.split("text", "\n")), lambda ls: F.transform("wanted", lambda i: F.struct(i.alias("line_no"), _word_set(F.get(ls, i)).alias("h"))))
    sets = stored(texts.select("doc_id", F.inline(cut[0])), "sets", **_HASHES)  # for either side
    left = pairs.join(sets.hint("merge"), ["doc_id", "line_no"])
    right = sets.select(F.col("doc_id").alias("to_doc"), F.col("line_no").alias("to_line"), F.col("h").alias("g"))
    both = left.join(right.hint("merge"), ["to_doc", "to_line"]).withColumn("o", F.size(F.array_intersect("h", "g")))
    p, q = t.numerator, t.denominator
    found = stored(both.where(f"o * {p + q} >= (size(h) + size(g)) * {p}").select("doc_id", "line_no").distinct(), label)
    dropped(sets)
    return found


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lines)``: the numbers, ascending, of the lines of each document
    that an earlier line makes superfluous; documents that lose none are left out.

    Ids are not null and do not repeat; they may be structs.
    """
    t = Fraction(str(threshold))
    whole = stored(classed(docs, threshold, id_col, text_col), "lines", **_HASHES)
    firsts = whole.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "line_no", *_BITS, "keys", "posted")).alias("f"))
    classes = stored(firsts.select("k1", "k2", "n", "f.*"), "classes", **_HASHES)
    every = stored(whole.select("doc_id", "line_no", "k1", "k2", "n"), "places")
    dropped(whole)

    keys = classes.select("doc_id", "line_no", "n", *_BITS, F.explode("keys").alias("key"))
    # Most keys are of one class only, and are not sorted any further.
    several = keys.groupBy("key").count().where("count > 1").select("key")
    keys = stored(keys.join(several.hint("merge"), "key", "left_semi"), "keys")
    first = F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "line_no")) <= LEADERS
    leads = keys.withColumn("first", first).where("first").drop("first")
    led = keys.alias("a").join(leads.alias("b").hint("merge"), F.expr(f"a.key = b.key AND {_EARLIER} AND {_close(t)}"))
    led = led.selectExpr("a.doc_id", "a.line_no", f"struct({_APART} AS apart, b.doc_id AS to_doc, b.line_no AS to_line) AS b")
    near = led.groupBy("doc_id", "line_no").agg(F.slice(F.array_sort(F.collect_set("b")), 1, CLOSEST).alias("b"))  # of the leaders of its keys
    led = stored(near.select("doc_id", "line_no", F.explode("b").alias("b")).select("doc_id", "line_no", "b.to_doc", "b.to_line"), "led")
    dropped(keys)
    settled = _verified(docs, led, t, id_col, text_col, "settled")
    dropped(led)

    marked = classes.join(settled.withColumn("done", F.lit(1)).hint("merge"), ["doc_id", "line_no"], "left").withColumn("done", F.coalesce("done", F.lit(0)))
    w = F.expr("shiftleft(bigint(posted[0]), 32) | bigint(coalesce(get(posted, 1), 0))")
    # Of two classes b is that of fewer words, which needs less of its words posted. Lists
    # are cut by octaves of n; b is a guest in a later one where an a can be.
    p, q = t.numerator, t.denominator
    octaves = [F.expr(f"int(floor(log2({n})))").alias(k) for k, n in (("home", "n"), ("last", f"n * {q}L / {p} + 1e-6"))]
    posts = marked.select("doc_id", "line_no", "n", *_BITS, w.alias("w"), "done", *octaves, F.posexplode("posted").alias("at", "word"))
    # At less than n - ceil(2t / (1 + t) * n) + 1.
    posts = posts.select("*", F.explode(F.expr(f"sequence(home, IF(at * {p + q} <= n * {q - p}, last, home))")).alias("octave"))
    # Few and narrow columns, as there are several rows for every class.
    posts = posts.select("doc_id", F.expr("shiftleft(bigint(line_no), 32) | n").alias("ln"), *_BITS, "w", F.expr("at * 4 + IF(octave = home, 0, 2) + done").alias("ad"), F.hash("word", "octave").alias("word")).hint("merge")
    # All is weighed on both sides at once, so either side is the same exchange. The first
    # condition never holds where a is a guest.
    short = f"b.at * {p + q} <= b.n * {q - p} - a.guest * {1 << 31}L"
    fewer = f"(b.n < a.n OR (b.n = a.n AND {_EARLIER}))"
    most = f"(least(a.at, b.at) + 1 + least(a.n - a.at, b.n - b.at) - 1) * {p + q} >= (a.n + b.n) * {p}"
    meet = _packed(f"{short} AND {fewer} AND {_close(t)} AND IF({_EARLIER}, a.done, b.done) = 0 AND {most} AND {_HERE}")
    met = posts.alias("a").join(posts.alias("b"), F.expr(f"a.word = b.word AND {meet}"))
    sides = [f"struct({x}.doc_id AS doc_id, int({_packed(f'{x}.line_no')}) AS line_no)" for x in "ab"]
    met = met.selectExpr(f"greatest({', '.join(sides)}) AS late", f"least({', '.join(sides)}) AS early")
    met = met.selectExpr("late.doc_id", "late.line_no", "early.doc_id AS to_doc", "early.line_no AS to_line")
    met = stored(met.distinct(), "met")
    found = _verified(docs, met, t, id_col, text_col, "found")
    dropped(met)

    gone = classes.select("k1", "k2", "n", "doc_id", "line_no").join(settled.unionByName(found).withColumn("gone", F.lit(True)), ["doc_id", "line_no"], "left")
    gone = gone.select("k1", "k2", "n", F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line"), F.coalesce("gone", F.lit(False)).alias("gone"))
    out = every.select("doc_id", "line_no", "k1", "k2", "n").join(gone, ["k1", "k2", "n"])
    out = out.where("gone OR first_doc != doc_id OR first_line != line_no")
    result = stored(out.groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("lines")), "gone")  # at most a text's lines
    for table in (every, classes, settled, found):
        dropped(table)
    return result


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with the texts' kept lines, and n_lines and n_removed (long).

    A null text stays null and has no line; an empty one is one line without
    words. A text all of whose lines go becomes empty. Rows whose doc_id is null
    are left as they are; rows with one doc_id follow each other by text, null
    first. Columns named as ``lines_col`` and ``removed_col`` are replaced.
    """
    docs = docs.drop(lines_col, removed_col)
    named = docs.columns
    key, gone_col = unused(docs, "__key"), unused(docs, "__gone")
    docs = keyed(docs, id_col, text_col, key)
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    gone = removed_lines(own, threshold).select(F.col("doc_id").alias(key), F.col("lines").alias(gone_col))
    out = docs.join(gone.hint("merge"), key, "left")
    every = F.split(F.col(text_col), "\n")
    # The lines are bound once, and those that stay taken by their numbers.
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone_col)
    kept = F.transform(F.array(every), lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))[0]
    kept = F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(kept)
    removed = F.coalesce(F.greatest(F.size(gone_col), F.lit(0)), F.lit(0)).cast("long")
    n_lines = F.coalesce(F.greatest(F.size(every), F.lit(0)), F.lit(0)).cast("long")
    return out.select(*[F.col(c) if c != text_col else kept.alias(c) for c in named], n_lines.alias(lines_col), removed.alias(removed_col))

"""Operator 10, benchmark decontamination by a positional inverted index.

Only DataFrame functions. Every benchmark window (ten consecutive words, or a
shorter item's all) is looked up from its rarest terms: document counts of the
benchmark's terms are taken over all documents, and each window keeps its three
rarest terms as probes. One pass over the documents then stores the postings of
the probe terms, ``(term, row, position)`` with the words around them. Lists are
intersected on the start they imply (position less the term's offset in the
window); a start that all of a window's probes imply is compared word by word
with the stored context, which gives exact phrase matches. A proximity match is an
occurrence of a window's rarest term with its other probes within ``size - 1`` words.

The index holds the lists that the benchmark asks for; terms of no window have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import ascii_lower, dropped, stored

WINDOW = 10
PROBES = 3
#: Rows and characters of a term table up to which it is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The lower-cased words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def fits(df: DataFrame) -> bool:
    """Whether a table is small enough to broadcast, by its rows and its texts."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")).first()
    return size.n <= BROADCAST_ROWS and size.chars <= BROADCAST_CHARS


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is measured to fit."""
    return F.broadcast(df) if fits(df) else df


def windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, phrase, n)``: each item's distinct windows, words joined by a
    space, and their number of words."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.expr(f"slice(w, at, {size})").alias("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, df)``: occurrences of each benchmark term over all documents; 0
    where there is none."""
    tokens = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    return terms.join(tokens.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("df")), "term", "left").fillna(0, ["df"])


def probes(phrases: DataFrame, counts: DataFrame, keep: int = PROBES) -> DataFrame:
    """``(term, phrase, n, offset, k, rank, others)``: the ``keep`` rarest terms of
    each phrase; rank 0 is the rarest, others are the terms of the rest."""
    terms = phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term")).groupBy("phrase", "n", "term").agg(F.min("offset").alias("offset"))
    rare = terms.join(counts, "term").groupBy("phrase", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "term", "offset"))), 1, keep).alias("p"))  # at most a window's words
    rare = rare.select("phrase", "n", F.size("p").alias("k"), F.expr("transform(slice(p, 2, size(p)), x -> x.term)").alias("others"), F.posexplode("p").alias("rank", "p"))
    return rare.select("p.term", "phrase", "n", "p.offset", "k", "rank", F.when(F.col("rank") == 0, F.col("others")).alias("others"))


def postings(docs: DataFrame, terms: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored index: a head row for each document, ``(rid, doc_id, n_words)``, and
    one row for each occurrence of a probe term, ``(rid, pos, term, before, context)``,
    with ``size - 1`` words on either side.

    rid tells rows with one id apart; before is how many words of context precede.
    """
    tokens = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    before = F.least(F.col("pos"), F.lit(size - 1))
    context = F.expr(f"slice(w, pos - least(pos, {size - 1}) + 1, least(pos, {size - 1}) + {size})")
    if fits(terms):
        each = tokens.select("rid", "doc_id", "w", F.posexplode_outer("w").alias("pos", "token"))
        found = each.join(F.broadcast(terms.withColumn("known", F.lit(True))), F.col("token") == F.col("term"), "left")
        found = found.where("known OR pos IS NULL OR pos = 0")
        rows = found.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce("pos", F.lit(0)).alias("pos"), "term", before.alias("before"), F.when(F.col("known"), context).alias("context"))
        index = stored(rows, "postings")
        return index.where("pos = 0").select("rid", "doc_id", "n_words"), index.where("term IS NOT NULL").select("rid", "pos", "term", "before", "context")
    # Too many terms to broadcast: words travel alone, and meet their text again by rid.
    tokens = stored(tokens, "tokens")
    each = tokens.select("rid", F.posexplode("w").alias("pos", "term")).join(terms, "term")
    at = each.groupBy("rid").agg(F.collect_list(F.struct("pos", "term")).alias("at"))  # at most a text's words
    lists = tokens.join(at, "rid").select("rid", "w", F.inline("at")).select("rid", "pos", "term", before.alias("before"), context.alias("context"))
    return tokens.select("rid", "doc_id", F.size("w").cast("long").alias("n_words")), stored(lists, "postings")


def candidates(lists: DataFrame, probe: DataFrame) -> DataFrame:
    """``(rid, phrase, n, k, start, exact, near)``: every start that one probe implies
    and at which the phrase stands, or near whose probe the others are."""
    found = lists.join(small(probe), "term").withColumn("start", F.col("pos") - F.col("offset"))
    here = F.expr("array_join(slice(context, before - offset + 1, n), ' ')")
    exact = (F.col("before") >= F.col("offset")) & (here == F.col("phrase"))
    near = F.coalesce((F.col("rank") == 0) & F.forall("others", lambda t: F.array_contains("context", t)), F.lit(False))
    return found.select("rid", "phrase", "n", "k", "start", exact.alias("exact"), near.alias("near")).where("exact OR near")


def phrase_matches(found: DataFrame) -> DataFrame:
    """``(rid, phrase, n, start)``: exact occurrences. A start counts when all
    the phrase's probes imply it and its words are the phrase's."""
    whole = found.where("exact").groupBy("rid", "phrase", "n", "start", "k").agg(F.count("*").alias("lists"))
    return whole.where("lists = k").select("rid", "phrase", "n", "start")


def proximity_matches(found: DataFrame) -> DataFrame:
    """``(rid, phrase)``: phrases whose other probes all occur within ``size - 1``
    words of an occurrence of their rarest."""
    return found.where("near").select("rid", "phrase").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, n_near.

    n_near counts the items with a proximity match; it decides nothing. Null and
    empty texts have no words and no hits; the digest is then that of an empty string.
    Items that are null or have no word have no window; an item without an id hits
    words but is not listed. Repeated doc_ids keep a row each. With an empty benchmark
    nothing is hit. Other columns are not read.
    """
    items = stored(windows(benchmark, size, item_col, item_text_col), "windows")
    phrases = items.select("phrase", "n").distinct()
    terms = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    counts = stored(term_counts(docs, terms, text_col), "terms")
    probe = stored(probes(phrases, counts), "probes")
    heads, lists = postings(docs, probe.select("term").distinct(), size, id_col, text_col)
    found = stored(candidates(lists, probe), "candidates")
    match = stored(phrase_matches(found), "matches")

    along = Window.partitionBy("rid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(along), F.lit(0))
    gained = match.withColumn("gained", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), reach)))
    hit = gained.groupBy("rid").agg(F.sum("gained").alias("n_hit"))

    def named(of: DataFrame) -> DataFrame:
        held = items.select("phrase", F.col("item_id").cast("string").alias("item")).where("item IS NOT NULL")
        return of.select("rid", "phrase").distinct().join(held, "phrase").select("rid", "item").distinct()

    listed = named(match).groupBy("rid").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    around = named(proximity_matches(found)).groupBy("rid").agg(F.count("*").alias("n_near"))
    out = heads.join(hit, "rid", "left").join(listed, "rid", "left").join(around, "rid", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), count("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"), count("n_near"))
    out = stored(out, "decontaminated")
    for table in (items, counts, probe, heads, lists, found, match):
        dropped(table)
    return out

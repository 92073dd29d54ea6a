"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns the packed pieces. ``run`` writes
each stage's result as Parquet and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import decontam, langid, linededup, packing, simhash
from seriesloom.llm.common import dropped, keyed, stored, table, unused

#: Probability a language must reach for a document to stay.
LEAST_LANGUAGE = 0.5
#: Words in a shingle for near-duplicates, and the least Jaccard similarity.
SHINGLE = 5
LEAST_ALIKE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: rejected are texts that are null, have no
    letter, or whose likeliest language is less likely than ``LEAST_LANGUAGE``.
    The model is learned from the labelled rows of the documents themselves."""
    names = docs.columns
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    found = langid.identify(docs, langid.train(docs), lang_col=lang, score_col=score)
    return found.where(langid.accepted(F.col(lang), F.col(score), LEAST_LANGUAGE)).select(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; a document that
    loses all its lines goes. n_chars counts what is left. Null and empty texts have
    nothing to lose and stay, as do rows without an id; rows of one id follow each
    other by text, and a repeated row loses what the first keeps."""
    names = docs.columns
    lines, removed = unused(docs, "__lines"), unused(docs, "__removed")
    found = linededup.dedup_lines(docs, lines_col=lines, removed_col=removed)
    found = found.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates:
    documents linked by shingle sets of Jaccard ``LEAST_ALIKE`` or more. Of rows
    with one id the first by text is the smaller; texts without words, null
    included, are one group; a null id comes before others."""
    names = docs.columns
    key = unused(docs, "__key")
    rows = keyed(docs, key=key)
    groups = simhash.similar_documents(rows, LEAST_ALIKE, id_col=key, shingle=SHINGLE)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(keep, key, "left_semi").select(*names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts
    have none and stay; every row is judged alone, repeated ones and rows without an
    id too. An empty benchmark takes nothing."""
    names = docs.columns
    key = unused(docs, "__key")
    rows = keyed(docs, key=key)
    found = decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    hit = found.where("contaminated").select(F.col("doc_id").alias(key))
    return rows.join(hit, key, "left_anti").select(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token ids in sequences of at most 4096. A null or empty
    text is the end id alone; every row is packed, repeated ones too."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL expresses neither the language model nor the tokenizer; tests hold every
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(docs)  # the input itself is no table of ours and stays
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

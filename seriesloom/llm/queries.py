"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import fold, table


def folded(modulus: int, rest: int) -> Column:
    """Whether the id's remainder is ``rest``; a null id has none."""
    return F.coalesce(fold(F.col("doc_id"), modulus) == rest, F.lit(False))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 200 bytes and more take from each document."""
    from seriesloom.llm.suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document go, and a digest of what is left."""
    from seriesloom.llm.linededup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components their links make."""
    from seriesloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those not held out."""
    import public_tokenizers

    from seriesloom.llm import lmscore

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = folded(10, 0)
    model = lmscore.train(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    found = lmscore.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    from seriesloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the rows not held out."""
    from seriesloom.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = folded(5, 0)
    field = quality.train(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    found = quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), field)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows not held out."""
    from seriesloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    held_out = folded(4, 2)
    model = langid.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from seriesloom.llm.htmlextract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, compared."""
    from seriesloom.llm.minhash import with_edited_and_next

    return with_edited_and_next(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark occurs in each document."""
    from seriesloom.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_simhash": op3_simhash,
        "op4_lm_score": op4_lm_score,
        "op5_packing": op5_packing,
        "op6_quality": op6_quality,
        "op7_langid": op7_langid,
        "op8_html_extract": op8_html_extract,
        "op9_fingerprints": op9_fingerprints,
        "op10_decontam": op10_decontam,
    }


def oracle_sql() -> dict[str, str]:
    from seriesloom.llm import sql

    return {"op2_line_dedup": sql.LINE_DEDUP, "op10_decontam": sql.DECONTAM}

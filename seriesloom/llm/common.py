"""Shared plumbing: reading inputs, durable intermediate tables, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: White space that separates words, and A-Z for ASCII-only lower-casing.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table below ``sf_dir``; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = LOCAL_CHECKPOINTS
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    # The shuffle files of this write are of no use to a later one.
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, None)
    spark.conf.set(tidy, "true")
    try:
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        spark.conf.set(tidy, before) if before is not None else spark.conf.unset(tidy)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/llm-[^/]+-[0-9a-f]{32}$", path):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "__key") -> DataFrame:
    """``docs`` with a column ``key`` that tells all rows apart and orders them.

    It is the id itself where no id repeats or is null; else the id and the row's
    number in the order of ids, texts and null first, which a sort by ranges of all
    three gives, so that many rows of one id or of none are no single task's.
    """
    ids = docs.select(F.col(id_col).alias("i"))
    if ids.groupBy("i").count().where("count > 1 OR i IS NULL").isEmpty():
        return docs.withColumn(key, F.col(id_col))
    tie, no = unused(docs, "__tie"), unused(docs, "__no")
    order = [F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first(), F.col(tie)]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = stored(rows.drop(tie).withColumn(no, F.monotonically_increasing_id()), "numbered")
    return rows.withColumn(key, F.struct(F.col(id_col).alias("doc_id"), F.col(no).alias("no"))).drop(no)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null stays null.

    Texts that are pure ASCII take the fast whole-string path, which gives the
    same characters.
    """
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], rows: int, text: str | None = None, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most ``rows`` rows and about ``size`` bytes of the
    ``text`` column, so a worker's memory does not depend on batch settings."""
    for batch in batches:
        at, n = 0, batch.num_rows
        lengths = None
        if text is not None and n:
            column = batch.column(batch.schema.get_field_index(text))
            lengths = [x or 0 for x in pc.binary_length(column).to_pylist()]
        while at < n:
            end, total = at, 0
            while end < n and end - at < rows and (lengths is None or end == at or total + lengths[end] <= size):
                total += lengths[end] if lengths is not None else 0
                end += 1
            yield batch.slice(at, end - at)
            at = end


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list, by alternating
    large-star and small-star steps until nothing changes.

    Returns ``(node, root)`` for every node that has an edge, root being the
    smallest node of its component. Edges that have not settled after ``rounds``
    rounds are an error. Each round shuffles the edges twice, takes neighbours' minima
    with a map-side aggregate, and is written to the shared folder; the driver sees one
    count. A hub's edges meet its minimum in one join key: a row of two numbers for
    each member of the largest component is what one task may read.
    """
    work = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = work.select("u", "v").unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = stored(small.where("u != v").distinct(), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(work)
        work = after
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = work.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(work.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

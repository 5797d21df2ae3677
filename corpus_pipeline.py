"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from scanforge.llm.common import cut, table, without_ids


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no stage meets a name of its own among them."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("struct<none:int>")).alias("rest"))


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents again."""
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


#: Rows of whole texts that travel to Python at a time: a batch of very long texts then stays small.
TEXT_BATCH = 500


def _small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session, as a stage's rows are computed after its function has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. It learns from the labels of these documents.

    Without labels nothing is rejected. Null and empty texts stay; rows of one id and different texts are judged apart.
    """
    _small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _as_documents(toxicity.score(_apart(docs), model).where(F.col("predicted") == 0), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents hold for them; n_chars follows the text. All documents stay, null texts as empty ones."""
    _small_batches(spark)
    out = _as_documents(line_dedup.dedup_lines(_apart(docs)), docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more): that with the smallest doc_id.

    Rows are judged, not ids: a null or repeated doc_id changes nothing for other texts.
    """
    _small_batches(spark)
    return _as_documents(near_copies.drop(_apart(docs)), docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. All rows of an id go if one holds an item; rows without an id always stay."""
    _small_batches(spark)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, found.select("doc_id").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, target (of their source) and taken (words, repeats counted). Texts without words are in no mix."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_items),
    ("mixing", mix_sources),
]

#: The toxicity stage is a trained classifier over compressed lengths, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each cut from the lineage of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

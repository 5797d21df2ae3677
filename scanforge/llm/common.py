"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular expression for a word, in Java's and RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"
#: Capital ASCII letters, and the letters that stand for them after lower-casing.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark alone so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(sc: SparkContext) -> None:
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once to the folder that the cluster shares, and go on from there.

    The folder is the session's spark.checkpoint.dir. A local session without one takes a temporary folder of its
    machine; on a cluster that is an error, as other executors could not read it.
    """
    _checkpoint_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a table beside the checkpoints: compressed by column, a fraction of a checkpoint's size."""
    sc = df.sparkSession.sparkContext
    _checkpoint_folder(sc)
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a batch whose texts are held as Python strings at a time.
TEXT_ROWS = 256


def each(column: pa.Array, rows: int = TEXT_ROWS) -> Iterator:
    """The values of a column as Python objects, a slice of the batch at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(text: str) -> str:
    """Lower-case A-Z and nothing else; what UTF-8 cannot hold is replaced."""
    return text.encode("utf-8", "replace").lower().decode("utf-8")


def words(text: str | None) -> list[str]:
    """Words of a text after lower-casing A-Z: runs without space and U+0009 to U+000D."""
    # bytes.split() and bytes.lower() know ASCII alone, which is the rule wanted here
    return [w.decode("utf-8") for w in split_words(text)]


def split_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_hashes(w: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes."""
    with np.errstate(over="ignore"):
        m = max(0, ids.size - n + 1)
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = (h ^ ids[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h


#: Ids up to which a table of ids is broadcast.
SMALL_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among ids (one column, distinct). Null ids stay."""
    ids = cut(ids.toDF("__gone"))
    few = ids.count() <= SMALL_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["__gone"], "left_anti")

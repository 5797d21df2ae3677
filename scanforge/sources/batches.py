"""Tables that a stream fills one micro-batch at a time, each batch once however often it is tried."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import publish, read_published

_BATCH = "_batch"


class BatchTables:
    """Several tables under one path that grow together.

    A batch writes a folder of its own in each table, over whatever a failed try left there, and then one row that says it
    is done. Readers see the batches that are done. So a batch that is tried again adds nothing twice, one that failed
    between two tables is seen in neither, and all tables stand at the same batch. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/{_BATCH}={batch}"

    def done(self) -> DataFrame:
        """Rows (_batch) of the batches that are done."""
        try:
            return self.spark.read.schema(f"tables array<string>, {_BATCH} long").parquet(f"{self.path}/done").select(_BATCH)
        except AnalysisException:  # there is none yet
            return self.spark.createDataFrame([], f"{_BATCH} long")

    def has(self, batch: int) -> bool:
        return not self.done().where(F.col(_BATCH) == batch).isEmpty()

    def write(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Add a batch to all its tables; False if it was there already, and then nothing is read or written."""
        if self.has(batch):
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(self._folder(name, batch))
        marker = self.spark.createDataFrame([(sorted(tables),)], "tables array<string>")
        marker.coalesce(1).write.mode("overwrite").parquet(self._folder("done", batch))  # one file, so it is there or it is not
        return True

    def _compacted(self) -> tuple[dict[str, DataFrame], dict[str, int]]:
        """The merged tables, and the last batch that each of them holds."""
        tables = read_published(self.spark, f"{self.path}/compacted")
        upto = tables.pop("upto", None)
        return tables, {} if upto is None else {r["name"]: r["batch"] for r in upto.collect()}  # a row for each table

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """All rows of a table from batches that are done (before: from earlier batches than this one alone); None if there are none.

        What was compacted comes as it was merged.
        """
        tables, upto = self._compacted()
        base = tables.get(name)
        batches = self.done().where(F.col(_BATCH) > upto.get(name, -1))
        if before is not None:
            batches = batches.where(F.col(_BATCH) < before)
        if batches.isEmpty():
            return base
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException:  # no batch has written it
            return base
        rows = rows.join(batches, _BATCH, "left_semi").drop(_BATCH)
        return rows if base is None else base.unionByName(rows)

    def compact(self, merges: dict) -> None:
        """Fold all batches that are done into one merged table for each name, so that reading does not slow down as batches add up.

        merges: table name -> function of all its rows. Other tables stay as they are.
        """
        last, upto = self.done().agg(F.max(_BATCH)).first()[0], self._compacted()[1]
        tables = {n: merge(rows) for n, merge in merges.items() if last is not None and upto.get(n, -1) < last and (rows := self.read(n)) is not None}
        if tables:
            now = [(n, b) for n, b in (upto | dict.fromkeys(tables, last)).items()]
            publish({**tables, "upto": self.spark.createDataFrame(now, "name string, batch long")}, f"{self.path}/compacted")

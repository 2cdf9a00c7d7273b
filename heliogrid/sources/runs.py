"""A rolling evaluation that can break off at any point and be resumed: predictions by fold, and a marker that comes last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import State


class FoldRun:
    """The folder of a run over folds. Predictions lie in a partition for each fold; writing a fold again replaces its
    partition and no other. A fold counts once it is in the run's state, which is switched after its predictions are
    written, so a run that breaks off between the two leaves nothing that is read, and nothing twice.

    identity names data set, configuration and schema: the state of another one is an error.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: str):
        self.spark, self.folder, self.identity = spark, folder.rstrip("/"), identity
        self.state = State(spark, f"{self.folder}/state")
        _, known = self.state.read()
        if known and known["identity"] != identity:
            raise ValueError("the run state belongs to another run")

    def finished(self) -> list[int]:
        return self.state.read()[1].get("folds", [])

    def write(self, rows: DataFrame) -> list[int]:
        """Writes the folds of rows that aren't finished, and returns them; they don't count before `commit`."""
        todo = rows.where(~F.col("fold").isin(self.finished()))
        folds = sorted(r.fold for r in todo.select("fold").distinct().collect())  # folds are windows of time: few
        if folds:
            todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(f"{self.folder}/predictions")
        return folds

    def commit(self, folds: list[int]) -> None:
        number, known = self.state.read()
        self.state.switch(number, {"identity": self.identity, "folds": sorted({*known.get("folds", []), *folds})})

    def evaluate(self, rows: DataFrame) -> list[int]:
        """Writes and commits what is left of rows' folds; returns these folds."""
        folds = self.write(rows)
        self.commit(folds)
        return folds

    def predictions(self) -> DataFrame:
        """The stored predictions of all finished folds, of this run and earlier ones."""
        stored = self.spark.read.parquet(f"{self.folder}/predictions")
        return stored.where(F.col("fold").isin(self.finished())).withColumn("fold", F.col("fold").cast("long"))

"""Keyed state of a stream as mergeable rows: a batch writes what it adds, and no more.

The state after a batch is the merge (an associative, commutative aggregate by key) of all that batches
have added. A batch writes its own rows to a folder of its number; every so many batches the state is
merged into one table, which later reads begin from. A batch that is run again writes the same folder
again. Folders count once their writer has finished, which it marks with a file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import exists, names


@dataclass(frozen=True)
class Ledger:
    path: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]
    #: Batches between two merged tables: a read opens at most so many folders and one table.
    every: int = 16
    #: Columns by which a merged table is sorted, so that reads of a range of them skip files.
    order: tuple[str, ...] = ()

    def _done(self, spark: SparkSession, kind: str) -> list[int]:
        return sorted(int(n) for n in names(spark, f"{self.path}/{kind}") if n.isdigit() and exists(spark, f"{self.path}/{kind}/{n}/_SUCCESS"))

    def last(self, spark: SparkSession) -> int:
        """The number of the last batch; -1 if there is none."""
        return max(self._done(spark, "added") + self._done(spark, "merged"), default=-1)

    def read(self, spark: SparkSession, upto: int) -> DataFrame:
        """The state after a batch, of those that are still to be told apart (see add)."""
        return self._read(spark, upto, upto)

    def _read(self, spark: SparkSession, upto: int, merged: int) -> DataFrame:
        """The state after a batch, from a merged table of a batch up to `merged`."""
        base = max((n for n in self._done(spark, "merged") if n <= merged), default=-1)
        paths = [f"{self.path}/merged/{base}"] if base >= 0 else []
        paths += [f"{self.path}/added/{n}" for n in self._done(spark, "added") if base < n <= upto]
        rows = spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)
        return self.merge(rows)

    def add(self, rows: DataFrame, number: int) -> None:
        """Takes in what a batch adds. What a merged table holds goes when the next one is there: batches
        before the last but one merged table are then not told apart any more."""
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{self.path}/added/{number}")
        if number % self.every != self.every - 1:
            return
        # A batch that is run again finds its own merged table, which it writes anew and must not read.
        whole = self._read(spark, number, number - 1)
        (whole.sortWithinPartitions(*self.order) if self.order else whole).write.mode("overwrite").parquet(f"{self.path}/merged/{number}")
        older = [n for n in self._done(spark, "merged") if n < number]
        for kind, last in (("added", older[-1] if older else -1), ("merged", older[-1] - 1 if older else -1)):
            for n in self._done(spark, kind):
                if n <= last:
                    _drop(spark, f"{self.path}/{kind}/{n}")


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""A keyed table that a stream changes batch by batch, each batch once.

Every batch writes the rows it changed to a folder of its own (a delta) and then
commits: one row that names the folders that make up the table from now on. What is
not committed is not read, and a batch whose number is committed already is left
out, so a stream that stops at any point and runs its last batch again leaves the
same table.

After ``fold`` deltas the commit folds them into a new base, so a reader opens one
base and less than ``fold`` deltas, however many batches there were. Folders are
used in turn: one is written over only after ``(generations - 1) * fold`` further
commits at least, so a reader may overlap that many.

One stream writes a table. Keys may be NULL.
"""

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "version long, batch long, base int, deltas array<int>, schema string"


class VersionedTable:
    def __init__(self, path: str, key: tuple, fold: int = 8, generations: int = 3):
        if fold < 1 or generations < 2:
            raise ValueError("fold and generations must be at least 1 and 2")
        self.path, self.key, self.fold, self.generations = path, tuple(key), fold, generations

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/{number}"

    def _slots(self) -> int:
        return self.fold * self.generations

    def _last(self, spark: SparkSession):
        """The newest commit, or None. There are as many commit rows as slots."""
        try:
            commits = spark.read.schema(COMMIT).option("ignoreMissingFiles", True) \
                .option("recursiveFileLookup", True).parquet(f"{self.path}/commit")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return commits.orderBy(F.desc("version")).first()

    def _commit(self, spark: SparkSession, version, batch, base, deltas, schema) -> None:
        spark.createDataFrame([(version, batch, base, deltas, schema)], COMMIT).coalesce(1) \
            .write.mode("overwrite").parquet(self._folder("commit", version % self._slots()))

    def create(self, rows: DataFrame) -> None:
        """Start with the rows of a table, unless there is a commit already."""
        spark = rows.sparkSession
        if self._last(spark) is None:
            rows.write.mode("overwrite").parquet(self._folder("base", 0))
            self._commit(spark, 0, -1, 0, [], rows.schema.json())

    def applied(self, spark: SparkSession) -> int:
        """Number of the newest batch that is committed; -1 before the first."""
        last = self._last(spark)
        return -1 if last is None else last.batch

    def apply(self, changed: DataFrame, batch: int) -> bool:
        """Commit the rows that a batch changed, one per key; False if it is known."""
        spark = changed.sparkSession
        last = self._last(spark)
        if last is not None and batch <= last.batch:
            return False
        version = 0 if last is None else last.version + 1
        base, deltas = (None, []) if last is None else (last.base, list(last.deltas))
        slot = version % self._slots()
        changed.write.mode("overwrite").parquet(self._folder("delta", slot))
        deltas.append(slot)
        schema = changed.schema.json() if last is None else last.schema
        if len(deltas) >= self.fold:
            folded = 0 if base is None else (base + 1) % self.generations
            self._rows(spark, base, deltas, schema).write.mode("overwrite") \
                .parquet(self._folder("base", folded))
            base, deltas = folded, []
        self._commit(spark, version, batch, base, deltas, schema)
        return True

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row of each key."""
        last = self._last(spark)
        if last is None:
            raise ValueError(f"nothing is committed at {self.path}")
        return self._rows(spark, last.base, last.deltas, last.schema)

    def _same(self, left: DataFrame, right: DataFrame, prefix: str):
        return reduce(lambda a, b: a & b, (
            left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in self.key))

    def _rows(self, spark: SparkSession, base, deltas, schema: str) -> DataFrame:
        """Base rows whose key no delta has, and of each delta key the newest row."""
        kind = StructType.fromJson(json.loads(schema))

        def part(folder, number):
            return spark.read.schema(kind).parquet(self._folder(folder, number))

        if not deltas:
            return part("base", base)
        changed = reduce(DataFrame.unionByName, (
            part("delta", slot).withColumn("_v", F.lit(i)) for i, slot in enumerate(deltas)))
        named = [F.col(k).alias(f"_k_{k}") for k in self.key]
        newest = changed.groupBy(*named).agg(F.max("_v").alias("_newest"))
        rows = changed.join(newest, self._same(changed, newest, "_k_")
                            & (changed["_v"] == newest["_newest"])).select(*kind.names)
        if base is None:
            return rows
        old = part("base", base)
        touched = newest.drop("_newest")
        return old.join(touched, self._same(old, touched, "_k_"), "left_anti").unionByName(rows)

    def staged(self, rows: DataFrame, batch: int) -> DataFrame:
        """A batch written aside, to be used more than once; two folders in turn."""
        path = self._folder("staged", batch % 2)
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

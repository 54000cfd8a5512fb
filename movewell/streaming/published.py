"""A table published as whole pictures and, between these, as the rows of changed keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from movewell.streaming.folders import exists, finished, remove

GROWING = ("nb_activites", "batch_id")
LATEST = ("batch_id",)


class PublishedTable:
    """``version=N`` holds a whole picture, ``changes/version=N/batch=B`` the rows of the keys batch B changed.

    There is no log: a folder counts once Spark's writer has left its ``_SUCCESS`` in it, and the
    newest version that counts is in force. Batch id and marks (such as the rules' fingerprint) are
    columns of its rows. A folder that counts is never written again, so readers and views keep
    theirs until ``clean_up``; one that a crash left half-way is overwritten. One writer at a time.

    Of each key the rows with the highest ``newest`` columns are shown. ``GROWING`` suits counts that
    only grow: a stream that still catches up with an initial picture does not take counts back, key by
    key, and nothing is held back once it is ahead.
    """

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet", key: str = "employee_id",
                 newest: Sequence[str] = GROWING, fold_after: int = 20):
        self.spark, self.path, self.fmt, self.key = spark, path.rstrip("/"), fmt, key
        self.newest, self.fold_after = tuple(newest), fold_after

    def _whole(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def _changes(self, version: int) -> str:
        return f"{self.path}/changes/version={version}"

    def versions(self) -> list[int]:
        return sorted(finished(self.spark, f"{self.path}/version=*"))

    def batches(self) -> list[int]:
        """Batches that count on top of the version in force."""
        versions = self.versions()
        return sorted(finished(self.spark, f"{self._changes(versions[-1])}/batch=*")) if versions else []

    def latest(self) -> Row | None:
        """Version, batch id and marks of the newest whole picture; null before the first, or if it has no rows."""
        versions = self.versions()
        if not versions:
            return None
        rows = self.spark.read.format(self.fmt).load(self._whole(versions[-1]))
        return rows.select(F.lit(versions[-1]).alias("version"), *rows.columns[rows.columns.index("batch_id"):]).first()

    def publish(self, whole: DataFrame, batch_id: int = -1, **marks: str) -> int:
        """Write the next version and return its number. A batch that is in force under the same marks is not written again."""
        versions, last = self.versions(), self.latest()
        if last and 0 <= batch_id <= last["batch_id"] and all(last[name] == mark for name, mark in marks.items()):
            return versions[-1]
        version = versions[-1] + 1 if versions else 0
        self._marked(whole, batch_id, marks).write.format(self.fmt).mode("overwrite").save(self._whole(version))
        return version

    def publish_changes(self, changed: DataFrame, batch_id: int, **marks: str) -> None:
        """Write all rows of the changed keys on top of the version in force; a replayed batch is there already."""
        last = self.latest()
        if batch_id in self.batches() or last and batch_id <= last["batch_id"]:
            return
        folder = f"{self._changes(self.versions()[-1])}/batch={batch_id}"
        self._marked(changed, batch_id, marks).write.format(self.fmt).mode("overwrite").save(folder)
        if len(self.batches()) >= self.fold_after:
            self.publish(self.read(), batch_id, **marks)

    @staticmethod
    def _marked(rows: DataFrame, batch_id: int, marks: Mapping[str, str]) -> DataFrame:
        return rows.select("*", F.lit(batch_id).cast("bigint").alias("batch_id"), *[F.lit(m).alias(n) for n, m in marks.items()])

    def as_sql(self) -> str:
        """The table in force as a statement. The changed rows are the smaller side: only their keys are looked up."""
        versions = self.versions()
        if not versions:
            raise LookupError(f"nothing published yet in {self.path}")
        whole, batches = self._whole(versions[-1]), self.batches()
        names = self.spark.read.format(self.fmt).load(whole).columns
        columns = ", ".join(f"`{name}`" for name in names[:names.index("batch_id")])
        if not batches:
            return f"SELECT {columns} FROM {self.fmt}.`{whole}`"
        some = f"{self._changes(versions[-1])}/batch={{{','.join(map(str, batches))}}}"
        rank = lambda side: "named_struct(" + ", ".join(f"'{c}', {side}.`{c}`" for c in self.newest) + ")"
        return f"""
            WITH changed AS (SELECT * FROM {self.fmt}.`{some}`),
            newest AS (SELECT c.{self.key} AS _key, max({rank("c")}) AS _rank FROM changed c GROUP BY 1),
            kept AS (SELECT w.* FROM {self.fmt}.`{whole}` w LEFT JOIN newest n ON w.{self.key} = n._key
                     WHERE n._rank IS NULL OR {rank("w")} > n._rank),
            ahead AS (SELECT DISTINCT k.{self.key} AS _ahead FROM kept k LEFT SEMI JOIN newest n ON k.{self.key} = n._key)
            SELECT {columns} FROM kept UNION ALL
            SELECT {columns} FROM changed c JOIN newest n ON c.{self.key} = n._key AND {rank("c")} = n._rank
                LEFT ANTI JOIN ahead a ON c.{self.key} = a._ahead"""

    def read(self) -> DataFrame:
        return self.spark.sql(self.as_sql())

    def register(self, name: str, persistent: bool = False) -> None:
        """Point a SQL name at the rows in force: a session view, or a view in the catalog.

        Replacing a view is one step, so SQL clients never find the name missing.
        """
        self.spark.sql(f"CREATE OR REPLACE {'' if persistent else 'TEMPORARY '}VIEW {name} AS {self.as_sql()}")

    def clean_up(self, age: timedelta, now: datetime | None = None) -> list[int]:
        """Remove versions written longer than ``age`` ago, with their changes, never the newest; return their numbers.

        A job of its own: no reader may need a version for longer than that. The changes of a version
        last as long as it does. What a crash left half-way below the newest version goes, too.
        """
        written = finished(self.spark, f"{self.path}/version=*")
        before = (now or datetime.now(timezone.utc)).astimezone(timezone.utc) - age
        old = [version for version in sorted(written)[:-1] if written[version] < before]
        for version in old:
            remove(self.spark, self._whole(version))
            if exists(self.spark, self._changes(version)):
                remove(self.spark, self._changes(version))
        return old

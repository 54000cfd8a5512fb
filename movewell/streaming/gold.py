"""Bronze to gold: an initial build, then the changed employees of every batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from movewell.fixed_values import GOLD_VIEW
from movewell.operators.daily import DAY
from movewell.operators.eligibility import activity_counts, gold_from_counts, gold_of_changed, trailing
from movewell.rules import Rules
from movewell.sources.activities import read_bronze, stream_bronze
from movewell.streaming.daily import TrailingCounts
from movewell.streaming.folders import exists
from movewell.streaming.published import LATEST, PublishedTable
from movewell.streaming.runs import start

TRIGGER = "20 seconds"  # Fixed value: pace of the gold stream.
INCREMENTAL, REBUILD = "incremental", "rebuild"


def fingerprint_of(rows: DataFrame) -> str:
    """One text for the content of a table, whatever the order of its rows."""
    total = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{total[0]}:{total[1]}"


def state_counts(gold: PublishedTable, checkpoint: str) -> DataFrame:
    """The counts of all employees that the stream's state held after its last finished batch."""
    state = gold.spark.read.format("statestore").load(checkpoint)
    return state.select(state["key"].getField(state.schema["key"].dataType.names[0]).alias("employee_id"),
                        F.col("value.count").alias("nb_activites"))


@dataclass
class GoldJob:
    """Publishes gold from bronze, and registers what is in force for SQL as ``view``.

    ``incremental`` keeps one count per employee in the stream's state. A batch gives the counts of
    the employees it touched, and only their gold rows are written, however many others there are. The
    whole picture is written when the rules change (they are read anew at each batch), when HR changed
    between two starts, and when enough changes have gathered. ``rebuild`` counts the
    whole history in every batch; with ``as_of`` only the rules' trailing days.

    ``incremental`` with ``as_of`` shows the trailing days from counts per day, which move with the time, and
    writes the employees whose count changed. Bronze is partitioned ``by`` day or month then, and there is no initial build.

    After an initial build the stream first catches up with the history. Until it does, an employee's
    count stays as built. A checkpoint that was lost or replaced makes ``start`` build anew from
    bronze, so that is also the way to show counts that fall after bronze was repaired.
    """

    bronze_path: str
    hr: DataFrame
    rules: Callable[[], tuple[Rules, str]]
    gold: PublishedTable
    mode: str = INCREMENTAL
    fmt: str = "parquet"
    view: str = GOLD_VIEW
    catalog: bool = False
    as_of: Callable[[], datetime] | None = None
    by: str = DAY
    people: str | None = None  # fingerprint of HR, taken once per job

    def __post_init__(self) -> None:
        if self.mode not in (INCREMENTAL, REBUILD):
            raise ValueError(f"mode is {INCREMENTAL} or {REBUILD}, not {self.mode}")
        if self.as_of and self.mode == INCREMENTAL:
            self.gold.newest = LATEST  # counts fall as days leave the period

    def _marks(self, fingerprint: str) -> dict[str, str]:
        self.people = self.people or fingerprint_of(self.hr)
        return {"fingerprint": fingerprint, "people": self.people}

    def _publish(self, counts: DataFrame, batch_id: int) -> None:
        rules, fingerprint = self.rules()
        self.gold.publish(gold_from_counts(self.hr, counts, rules), batch_id, **self._marks(fingerprint))
        self.register()

    def register(self) -> None:
        self.gold.register(self.view, self.catalog)

    def _history(self) -> DataFrame:
        history = read_bronze(self.gold.spark, self.bronze_path, self.fmt)
        return trailing(history, self.as_of(), self.rules()[0].window_days) if self.as_of else history

    def rules_changed(self) -> bool:
        last = self.gold.latest()
        return last is None or last["fingerprint"] != self.rules()[1]

    def build_initial(self) -> bool:
        """Build gold from the history there is; false if bronze is still empty."""
        history = self._history()
        if history.isEmpty():
            return False
        self._publish(activity_counts(history), batch_id=-1)
        return True

    def _known_counts(self, checkpoint: str) -> list[DataFrame]:
        """Counts in force, and those in the state; the higher one of an employee holds."""
        shown = [self.gold.read().select("employee_id", "nb_activites")] if self.gold.versions() else []
        return shown + ([state_counts(self.gold, checkpoint)] if exists(self.gold.spark, f"{checkpoint}/commits/*") else [])

    @staticmethod
    def _highest(counts: list[DataFrame]) -> DataFrame:
        known = reduce(DataFrame.unionByName, counts).where("employee_id IS NOT NULL")
        return known.groupBy("employee_id").agg(F.max("nb_activites").alias("nb_activites"))

    def on_changes(self, changed: DataFrame, batch_id: int, checkpoint: str) -> None:
        """Publish the employees whose counts a batch changed, or all of them if the rules changed.

        The batch is read once: every reading would run the stream's aggregation again.
        """
        rules, fingerprint = self.rules()
        if self.rules_changed():
            self._publish(self._highest([changed, *self._known_counts(checkpoint)]), batch_id)
        else:
            self.gold.publish_changes(gold_of_changed(self.hr, changed, rules), batch_id, **self._marks(fingerprint))
            self.register()

    def on_arrival(self, _new: DataFrame, batch_id: int) -> None:
        history = self._history()
        if self.as_of or not history.isEmpty():
            self._publish(activity_counts(history), batch_id)

    def on_days(self, new: DataFrame, batch_id: int, trail: TrailingCounts) -> None:
        """Count a batch by day, move the period to now, and publish the employees whose count changed."""
        rules, fingerprint = self.rules()
        now = self.as_of()
        trail.add(new, batch_id)
        trail.advance(batch_id, now, rules.window_days)
        counts = trail.counts(read_bronze(self.gold.spark, self.bronze_path, self.fmt, in_parts=True), now, rules.window_days)
        if self.rules_changed():
            self._publish(counts, batch_id)
            return
        shown = self.gold.read().select("employee_id", F.col("nb_activites").alias("shown")).distinct()
        changed = (shown.join(counts, "employee_id", "left").withColumn("nb_activites", F.coalesce("nb_activites", F.lit(0)))
                   .where("nb_activites <> shown").drop("shown"))
        self.gold.publish_changes(gold_of_changed(self.hr, changed, rules), batch_id, **self._marks(fingerprint))
        self.register()

    def _orphaned(self, checkpoint: str) -> bool:
        """Whether what is in force came from a stream that this checkpoint does not continue."""
        last = self.gold.latest()
        followed = last is not None and (last["batch_id"] >= 0 or bool(self.gold.batches()))
        return followed and not exists(self.gold.spark, f"{checkpoint}/commits/*")

    def start(self, checkpoint: str, every: str | None = TRIGGER, initial: bool = True,
              **source_options: str) -> StreamingQuery:
        """Build gold from the history if there is none yet or the rules changed, then follow bronze.

        If HR alone changed, the counts in the state are enough. An unchanged restart reads no history
        and publishes nothing; it only registers what there is.
        """
        if self.as_of and self.mode == INCREMENTAL:
            return self._start_trailing(checkpoint, every, source_options)
        if initial and (self.rules_changed() or self._orphaned(checkpoint)):
            self.build_initial()
        elif (last := self.gold.latest()) and last["people"] != self._marks("")["people"]:
            known = self._known_counts(checkpoint)
            self._publish(self._highest(known), batch_id=max([last["batch_id"], *self.gold.batches()]))
        elif last:
            self.register()
        arriving = stream_bronze(self.gold.spark, self.bronze_path, self.fmt, **source_options)
        if self.mode == INCREMENTAL:
            writer = activity_counts(arriving).writeStream.outputMode("update").foreachBatch(
                lambda changed, batch_id: self.on_changes(changed, batch_id, checkpoint))
        else:
            writer = arriving.writeStream.outputMode("update").foreachBatch(self.on_arrival)
        return start(writer.queryName("gold"), checkpoint, every)

    def _start_trailing(self, checkpoint: str, every: str | None, source_options: dict[str, str]) -> StreamingQuery:
        trail = TrailingCounts(self.gold.spark, f"{checkpoint.rstrip('/')}-trailing", self.by)
        if not exists(self.gold.spark, f"{checkpoint}/commits/*"):
            trail.forget()
        if self.gold.versions():
            self.register()
        arriving = stream_bronze(self.gold.spark, self.bronze_path, self.fmt, in_parts=True, **source_options)
        writer = arriving.writeStream.foreachBatch(lambda new, batch_id: self.on_days(new, batch_id, trail))
        return start(writer.queryName("gold"), checkpoint, every)

"""Streams against batch, restarts, replays and failures half-way."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from movewell.operators import notifications as notices
from movewell.operators.eligibility import gold_eligibility
from movewell.operators.health import stream_liveness
from movewell.plans import views
from movewell.rules import DEFAULT, Rules
from movewell.schemas import BRONZE
from movewell.session import CHECKPOINT_DIR, shared_dir
from movewell.sources.activities import read_bronze
from movewell.sources.cdc import decode_activities, read_cdc_stream
from movewell.streaming.bronze import start_bronze
from movewell.streaming.gold import INCREMENTAL, REBUILD, GoldJob
from movewell.streaming.notify import Outbox
from movewell.streaming.progress import ProgressLog, progress_rows, read_progress
from movewell.streaming.runs import finish
from movewell.streaming.published import PublishedTable

ALL = "1000"  # files per batch; a topic delivers offsets in order, files of one job come in any


def same(one, two):
    columns = sorted(one.columns)
    assert columns == sorted(two.columns)
    return (one.select(columns).exceptAll(two.select(columns)).isEmpty()
            and two.select(columns).exceptAll(one.select(columns)).isEmpty())


def write_log(spark, tables, path, low, high, files="2"):
    messages = views.cdc_messages(spark, tables).where((F.col("offset") >= low) & (F.col("offset") < high))
    messages.repartition(3).write.mode("append").parquet(path)
    return read_cdc_stream(spark, "parquet", {"path": path, "maxFilesPerTrigger": files})


def fixed_rules(rules=DEFAULT, fingerprint="one"):
    return lambda: (rules, fingerprint)


def test_bronze_resumes_without_loss_or_copies(spark, tables, tmp_path):
    for low, high in ((0, 700), (700, 1000), (1000, 10_000)):
        query = finish(start_bronze(write_log(spark, tables, f"{tmp_path}/log", low, high), f"{tmp_path}/bronze", f"{tmp_path}/ck"))
    finish(start_bronze(read_cdc_stream(spark, "parquet", {"path": f"{tmp_path}/log"}), f"{tmp_path}/bronze", f"{tmp_path}/ck"))
    bronze = read_bronze(spark, f"{tmp_path}/bronze")
    assert same(bronze, decode_activities(views.cdc_messages(spark, tables)))
    assert (bronze.count(), bronze.where("id is not null").count()) == (1500, 1350)
    assert [f.dataType for f in bronze.schema] == [f.dataType for f in BRONZE]
    assert len(query.recentProgress) >= 2  # three files, two per batch


@pytest.mark.parametrize("mode", [INCREMENTAL, REBUILD])
def test_gold_follows_bronze_and_equals_batch(spark, tables, tmp_path, mode):
    bronze = f"{tmp_path}/bronze"
    job = GoldJob(bronze, views.hr(spark, tables), fixed_rules(), PublishedTable(spark, f"{tmp_path}/gold"), mode)
    for low, high in ((0, 500), (500, 10_000)):
        finish(start_bronze(write_log(spark, tables, f"{tmp_path}/log", low, high), bronze, f"{tmp_path}/ck-bronze"))
        finish(job.start(f"{tmp_path}/ck-gold", every=None, maxFilesPerTrigger="1"))
        expected = gold_eligibility(views.hr(spark, tables), read_bronze(spark, bronze), DEFAULT)
        assert same(job.gold.read(), expected)
    assert same(expected, gold_eligibility(views.hr(spark, tables), views.kept_activities(spark, tables), DEFAULT))


def bronze_rows(spark, *employees):
    rows = [(None, employee, None, None, None, None, None, None) for employee in employees]
    return spark.createDataFrame(rows, BRONZE)


def small_job(spark, tmp_path, mode, rules=None):
    hr = spark.createDataFrame([(1, "a", None, 100.0, None), (2, "a", None, 100.0, None)],
                               "employee_id bigint, bu string, moyen_dep string, salaire_brut_annuel double, distance_km double")
    return GoldJob(f"{tmp_path}/bronze", hr, rules or fixed_rules(), PublishedTable(spark, f"{tmp_path}/gold"), mode)


@pytest.mark.parametrize("mode", [INCREMENTAL, REBUILD])
def test_gold_survives_a_failure_and_applies_changed_rules(spark, tmp_path, mode):
    state = {"rules": DEFAULT, "fingerprint": "one", "fail": True}

    def rules():
        if state["fail"]:
            raise RuntimeError("rules file unreadable")
        return state["rules"], state["fingerprint"]

    job = small_job(spark, tmp_path, mode, rules)
    bronze_rows(spark, 1, 1, 2).write.mode("append").parquet(job.bronze_path)
    with pytest.raises(StreamingQueryException):
        finish(job.start(f"{tmp_path}/ck", every=None, initial=False))
    assert job.gold.latest() is None
    state["fail"] = False
    finish(job.start(f"{tmp_path}/ck", every=None, initial=False))
    assert {r["employee_id"]: r["nb_activites"] for r in job.gold.read().collect()} == {1: 2, 2: 1}
    assert not any(r["jours_bien_etre"] for r in job.gold.read().collect())

    state.update(rules=Rules(0.05, 2, 15.0, 25.0, 365), fingerprint="two")
    assert job.rules_changed()
    assert job.build_initial()
    assert not job.rules_changed()
    assert {r["employee_id"]: r["jours_bien_etre"] for r in job.gold.read().collect()} == {1: True, 2: False}

    bronze_rows(spark, 2).write.mode("append").parquet(job.bronze_path)
    finish(job.start(f"{tmp_path}/ck", every=None, initial=False))
    assert {r["employee_id"]: (r["nb_activites"], r["jours_bien_etre"]) for r in job.gold.read().collect()} == {1: (2, True), 2: (2, True)}


def test_empty_bronze_builds_nothing(spark, tmp_path):
    job = small_job(spark, tmp_path, REBUILD)
    bronze_rows(spark).write.parquet(job.bronze_path)
    assert job.build_initial() is False
    assert job.gold.latest() is None
    with pytest.raises(LookupError):
        job.gold.read()


def test_unknown_mode_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="mode"):
        small_job(spark, tmp_path, "sometimes")


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "employee_id long, nb_activites long")


def shown(table):
    return {r["employee_id"]: r["nb_activites"] for r in table.read().collect()}


def test_a_version_counts_once_it_is_whole(spark, tmp_path):
    table = PublishedTable(spark, f"{tmp_path}/t")
    assert table.publish(counted(spark, {1: 1, 2: 1}), 0, fingerprint="f") == 0
    before = table.read()
    broken = counted(spark, {1: 5}).select("employee_id", F.raise_error(F.lit("executor gone")).cast("long").alias("nb_activites"))
    with pytest.raises(Exception, match="executor gone"):
        table.publish(broken, 1, fingerprint="f")
    with pytest.raises(Exception, match="executor gone"):
        table.publish_changes(broken, 1, fingerprint="f")
    assert table.latest()["version"] == 0 and table.batches() == [] and shown(table) == {1: 1, 2: 1}
    table.publish_changes(counted(spark, {2: 3}), 1, fingerprint="f")
    assert shown(table) == {1: 1, 2: 3} and before.count() == 2
    assert table.publish(counted(spark, {1: 7}), 2, fingerprint="f") == 1
    assert shown(table) == {1: 7} and {r["nb_activites"] for r in before.collect()} == {1}


def test_replays_and_schema_change(spark, tmp_path):
    table = PublishedTable(spark, f"{tmp_path}/t")
    table.publish(counted(spark, {1: 1}), 0, fingerprint="f")
    assert table.publish(counted(spark, {9: 9}), 0, fingerprint="f") == 0  # a replayed batch is already there
    table.publish_changes(counted(spark, {9: 9}), 0, fingerprint="f")
    assert shown(table) == {1: 1}
    table.publish_changes(counted(spark, {1: 4}), 1, fingerprint="f")
    table.publish_changes(counted(spark, {1: 99}), 1, fingerprint="f")
    assert shown(table) == {1: 4}
    assert table.publish(counted(spark, {1: 1}), 0, fingerprint="g") == 1  # same batch, changed rules
    for version in range(2, 5):
        wider = counted(spark, {n: n for n in range(version)}).withColumn("extra", F.lit("x"))
        assert table.publish(wider, version, fingerprint="g") == version
    assert table.read().columns == ["employee_id", "nb_activites", "extra"] and table.read().count() == 4


def test_each_key_shows_its_newest_rows(spark, tmp_path):
    """Keys that are null, doubled, only in the whole picture, or behind it, over several batches and a fold."""
    whole = spark.createDataFrame([(None, 0), (1, 5), (1, 5), (2, 5), (3, 1)], "employee_id long, nb_activites long")
    for fold_after in (100, 3):
        table = PublishedTable(spark, f"{tmp_path}/{fold_after}", fold_after=fold_after)
        table.publish(whole, fingerprint="f")
        for batch, changes in enumerate([{1: 3, 3: 2}, {1: 6, 2: 5}, {2: 4}, {3: 3}]):
            doubled = counted(spark, changes)
            table.publish_changes(doubled.union(doubled.where("employee_id = 1")), batch, fingerprint="f")
        rows = sorted(table.read().collect(), key=lambda r: (r[0] or 0, r[1]))
        assert [tuple(r) for r in rows] == [(None, 0), (1, 6), (1, 6), (2, 5), (3, 3)]
        assert len(table.versions()) == (1 if fold_after == 100 else 2)
    latest = PublishedTable(spark, f"{tmp_path}/latest", newest=("batch_id",))
    latest.publish(counted(spark, {1: 5, 2: 5}), fingerprint="f")
    latest.publish_changes(counted(spark, {1: 3}), 0, fingerprint="f")
    assert shown(latest) == {1: 3, 2: 5}


def test_held_readers_and_views_outlive_ten_versions_until_clean_up(spark, tmp_path):
    table = PublishedTable(spark, f"{tmp_path}/t")
    assert table.clean_up(timedelta(0)) == []
    table.publish(counted(spark, {n: 1 for n in range(3)}), fingerprint="f")
    table.publish_changes(counted(spark, {0: 2}), 0, fingerprint="f")
    held = table.read()
    table.register("held_gold")
    for version in range(1, 11):
        table.publish(counted(spark, {n: 1 for n in range(version)}), fingerprint="f")
    assert held.count() == 3 and spark.table("held_gold").count() == 3 and table.read().count() == 10
    later = datetime.now() + timedelta(hours=30)
    assert table.clean_up(timedelta(hours=48), later) == []
    assert table.clean_up(timedelta(hours=24), later) == list(range(10))
    assert table.read().count() == 10 and table.versions() == [10]
    assert table.publish(counted(spark, {1: 1}), fingerprint="f") == 11


def test_shown_counts_never_fall_while_the_stream_catches_up(spark, tmp_path):
    """Several files wait at the first start and at a restart, one is taken per batch."""
    state = {"fingerprint": "one"}
    job = small_job(spark, tmp_path, INCREMENTAL, lambda: (DEFAULT, state["fingerprint"]))
    seen, register = [], job.register

    def watched():
        register()
        seen.append(shown(job.gold)[1])

    job.register = watched
    for fingerprint, files in (("one", 3), ("one", 3), ("two", 2)):
        state["fingerprint"] = fingerprint
        for _ in range(files):
            bronze_rows(spark, *[1] * 5).coalesce(1).write.mode("append").parquet(job.bronze_path)
        finish(job.start(f"{tmp_path}/ck", every=None, maxFilesPerTrigger="1"))
    assert seen == sorted(seen) and seen[0] == 15 and seen[-1] == 40
    assert job.gold.latest()["fingerprint"] == "two"


def test_a_small_batch_on_a_large_state_writes_its_own_employees_only(spark, tmp_path):
    job = small_job(spark, tmp_path, INCREMENTAL)
    job.hr = spark.range(50_000).selectExpr("id AS employee_id", "'a' AS bu", "CAST(NULL AS STRING) AS moyen_dep",
                                            "1.0D AS salaire_brut_annuel", "CAST(NULL AS DOUBLE) AS distance_km")
    everyone = spark.range(50_000).select(*[(F.col("id") if f.name == "employee_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in BRONZE])
    everyone.write.parquet(job.bronze_path)
    finish(job.start(f"{tmp_path}/ck", every=None, initial=False))
    assert job.gold.versions() == [0] and job.gold.batches() == []
    bronze_rows(spark, *range(10)).write.mode("append").parquet(job.bronze_path)
    finish(job.start(f"{tmp_path}/ck", every=None, initial=False))
    assert job.gold.versions() == [0]
    (batch,) = job.gold.batches()
    assert spark.read.parquet(f"{job.gold.path}/changes/version=0/batch={batch}").count() == 10
    assert {n: c for n, c in shown(job.gold).items() if c == 2} == {n: 2 for n in range(10)} and len(shown(job.gold)) == 50_000


def test_changed_people_are_shown_from_the_state(spark, tmp_path, monkeypatch):
    """Someone who joins HR later has the count that the state kept; history is not read again."""
    job = small_job(spark, tmp_path, INCREMENTAL)
    bronze_rows(spark, 1, 3, 3).write.parquet(job.bronze_path)
    finish(job.start(f"{tmp_path}/ck", every=None))
    bronze_rows(spark, 1, 3).write.mode("append").parquet(job.bronze_path)
    finish(job.start(f"{tmp_path}/ck", every=None))
    assert shown(job.gold) == {1: 2, 2: 0}
    more = job.hr.union(job.hr.where("employee_id = 1").withColumn("employee_id", F.lit(3).cast("long")))
    again = GoldJob(job.bronze_path, more, job.rules, job.gold)
    monkeypatch.setattr(again, "build_initial", lambda: pytest.fail("history was read"))
    bronze_rows(spark, 3).write.mode("append").parquet(job.bronze_path)
    finish(again.start(f"{tmp_path}/ck", every=None))
    assert shown(job.gold) == {1: 2, 2: 0, 3: 4}


def test_rules_that_change_between_batches_apply_to_everyone(spark, tmp_path, monkeypatch):
    """The running stream rewrites the whole picture from its state; history is not read."""
    state = {"rules": DEFAULT, "fingerprint": "one"}
    job = small_job(spark, tmp_path, INCREMENTAL, lambda: (state["rules"], state["fingerprint"]))
    monkeypatch.setattr(job, "build_initial", lambda: pytest.fail("history was read"))
    for employees, rules in (([1, 1, 2, 3], DEFAULT), ([2], Rules(0.05, 2, 15.0, 25.0, 365))):
        state.update(rules=rules, fingerprint=str(rules))
        bronze_rows(spark, *employees).coalesce(1).write.mode("append").parquet(job.bronze_path)
        finish(job.start(f"{tmp_path}/ck", every=None, initial=False))
    assert {r["employee_id"]: (r["nb_activites"], r["jours_bien_etre"]) for r in job.gold.read().collect()} == {1: (2, True), 2: (2, True)}
    assert job.gold.versions() == [0, 1] and job.gold.latest()["batch_id"] == 1


def test_a_new_checkpoint_rebuilds_from_repaired_bronze(spark, tmp_path):
    """Counts may fall then, under unchanged rules, and gold does not freeze at the old ones."""
    job = small_job(spark, tmp_path, INCREMENTAL)
    for rows in ([1, 1, 1], [2]):
        bronze_rows(spark, *rows).write.mode("append").parquet(job.bronze_path)
        finish(job.start(f"{tmp_path}/ck", every=None))
    assert shown(job.gold) == {1: 3, 2: 1}
    repaired = GoldJob(f"{tmp_path}/repaired", job.hr, job.rules, job.gold)
    bronze_rows(spark, 1, 2).write.parquet(repaired.bronze_path)
    finish(repaired.start(f"{tmp_path}/ck-new", every=None))
    assert shown(job.gold) == {1: 1, 2: 1}
    bronze_rows(spark, 2).write.mode("append").parquet(repaired.bronze_path)
    finish(repaired.start(f"{tmp_path}/ck-new", every=None))
    assert shown(job.gold) == {1: 1, 2: 2}


def test_an_unchanged_restart_publishes_nothing(spark, tmp_path, monkeypatch):
    job = small_job(spark, tmp_path, INCREMENTAL)
    bronze_rows(spark, 1, 2).write.parquet(job.bronze_path)
    finish(job.start(f"{tmp_path}/ck", every=None))
    version = job.gold.latest()["version"]
    monkeypatch.setattr(job, "build_initial", lambda: pytest.fail("history was read"))
    finish(job.start(f"{tmp_path}/ck", every=None))
    assert job.gold.latest()["version"] == version
    assert spark.table("gold_eligibilites").count() == 2


def test_a_trailing_period_follows_the_rules(spark, tmp_path):
    now = datetime(2025, 1, 31)
    job = small_job(spark, tmp_path, REBUILD, fixed_rules(Rules(0.05, 2, 15.0, 25.0, 10)))
    job.as_of = lambda: now
    rows = bronze_rows(spark, 1, 1, 2).withColumn("date_debut_ts", F.when(
        F.col("employee_id") == 1, F.lit("2025-01-25")).otherwise(F.lit("2024-01-25")).cast("timestamp"))
    rows.write.parquet(job.bronze_path)
    finish(job.start(f"{tmp_path}/ck", every=None))
    assert {r["employee_id"]: r["nb_activites"] for r in job.gold.read().collect()} == {1: 2, 2: 0}


def test_the_listener_keeps_more_batches_than_spark(spark, tmp_path):
    rows = spark.range(130).select(F.lit(None).cast("binary").alias("value"), F.lit(0).alias("partition"), F.col("id").alias("offset"))
    rows.repartition(130, "offset").coalesce(130).write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/log")
    log = ProgressLog(spark, f"{tmp_path}/progress", piece=25)
    spark.streams.addListener(log)
    try:
        messages = read_cdc_stream(spark, "parquet", {"path": f"{tmp_path}/log", "maxFilesPerTrigger": "1"})
        query = finish(start_bronze(messages, f"{tmp_path}/bronze", f"{tmp_path}/ck"))
        assert log.wait_for(query)
    finally:
        spark.streams.removeListener(log)
        log.close()
    kept = read_progress(spark, f"{tmp_path}/progress").where("input_rows > 0")
    assert kept.count() == 130 > len(query.recentProgress) - 1 and kept.agg(F.sum("input_rows")).first()[0] == 130


@pytest.mark.parametrize("persistent", [False, True])
def test_gold_is_visible_to_sql(spark, tmp_path, persistent):
    table, name = PublishedTable(spark, f"{tmp_path}/t"), f"sql_gold_{persistent}"
    for version in (1, 2):
        table.publish(counted(spark, {n: 1 for n in range(version)}).withColumn(f"column_{version}", F.lit("x")), fingerprint="f")
        table.register(name, persistent)
        table.publish_changes(counted(spark, {0: 2}).withColumn(f"column_{version}", F.lit("y")), version, fingerprint="f")
        assert spark.sql(f"SELECT sum(nb_activites) FROM {name}").first()[0] == version
        table.register(name, persistent)
        reader = spark.newSession() if persistent else spark
        assert reader.table(name).columns == ["employee_id", "nb_activites", f"column_{version}"]
        assert reader.sql(f"SELECT sum(nb_activites) FROM {name}").first()[0] == version + 1
    spark.sql(f"DROP VIEW {name}")


def test_notifications_of_a_stream_equal_batch(spark, tables, tmp_path):
    outbox = Outbox(spark, f"{tmp_path}/outbox")
    for low, high in ((0, 200), (200, 400), (400, 10_000)):
        finish(outbox.start(write_log(spark, tables, f"{tmp_path}/log", low, high, ALL), f"{tmp_path}/ck"))
    created = notices.creations(views.cdc_messages(spark, tables))
    expected = notices.notifications(created, notices.barriers(created))
    assert same(outbox.read().drop("batch"), expected)
    assert expected.count() == 839


def test_a_batch_is_read_once_when_all_partitions_are_open(spark, tables, tmp_path, monkeypatch):
    """Two of three partitions open at their markers, over batches; the closed one is searched on, an open one is not."""
    import movewell.streaming.notify as notify
    topic = views.topic_messages(spark, tables)
    outbox, searched = Outbox(spark, f"{tmp_path}/outbox", partitions=3), []
    monkeypatch.setattr(notify, "may_hold_marker", lambda messages: searched.append(
        {r["partition"] for r in messages.select("partition").distinct().collect()}) or notices.may_hold_marker(messages))
    for batch, part in enumerate([topic.where("offset < 200"), topic.where("offset BETWEEN 200 AND 600"), topic.where("offset > 600")]):
        outbox.on_batch(part, batch)
    created = notices.creations(topic)
    assert same(outbox.read().drop("batch"), notices.notifications(created, notices.barriers(created)))
    assert searched == [{0, 1, 2}, {0, 1, 2}, {2}]
    both = Outbox(spark, f"{tmp_path}/both", partitions=2)
    two = topic.where("partition < 2")
    both.on_batch(two.where("offset <= 600"), 0)
    searched.clear()
    both.on_batch(two.where("offset > 600"), 1)
    assert not searched and same(both.read().drop("batch"), outbox.read().drop("batch"))


def test_replayed_batch_neither_doubles_nor_loses(spark, tables, tmp_path):
    outbox, messages = Outbox(spark, f"{tmp_path}/outbox"), views.cdc_messages(spark, tables)
    parts = [messages.where("offset < 400"), messages.where("offset >= 400")]
    for batch, part in enumerate(parts):
        outbox.on_batch(part, batch)
        outbox.on_batch(part, batch)
    assert outbox.read().count() == 839
    assert outbox.read().select("partition", "offset").distinct().count() == 839


def test_stream_stopped_half_way_goes_on(spark, tables, tmp_path, monkeypatch):
    outbox = Outbox(spark, f"{tmp_path}/outbox")
    finish(outbox.start(write_log(spark, tables, f"{tmp_path}/log", 0, 500, ALL), f"{tmp_path}/ck"))
    real, calls = outbox.on_batch, []

    def fails_after_writing(messages, batch_id):
        real(messages, batch_id)
        calls.append(batch_id)
        raise RuntimeError("lost")

    monkeypatch.setattr(outbox, "on_batch", fails_after_writing)
    with pytest.raises(StreamingQueryException):
        finish(outbox.start(write_log(spark, tables, f"{tmp_path}/log", 500, 10_000, ALL), f"{tmp_path}/ck"))
    monkeypatch.undo()
    assert calls
    finish(outbox.start(read_cdc_stream(spark, "parquet", {"path": f"{tmp_path}/log"}), f"{tmp_path}/ck"))
    assert outbox.read().count() == 839


def test_progress_feeds_the_health_operators(spark, tmp_path):
    bronze_rows(spark, 1, 2).write.parquet(f"{tmp_path}/in")
    job = small_job(spark, tmp_path, INCREMENTAL)
    job.bronze_path = f"{tmp_path}/in"
    rows = progress_rows(spark, [finish(job.start(f"{tmp_path}/ck", every=None, initial=False))])
    assert rows.agg(F.sum("input_rows")).first()[0] == 2
    latest = rows.agg(F.max(F.col("ts").cast("timestamp_ntz"))).first()[0]
    assert [r["up"] for r in stream_liveness(rows, latest, "20 seconds", streams="bronze|gold").collect()] == [1]


def test_shared_folder_follows_the_session(spark, tmp_path):
    configured = spark.conf.get(CHECKPOINT_DIR)
    one, two = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert one.startswith(f"{configured}/x-") and one != two
    assert json.dumps(one)

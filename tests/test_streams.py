from pyspark.sql import functions as F

from ledgerlens.operators import alerts, decisions
from ledgerlens.operators.scoring import rule_scorer
from ledgerlens.sources import driver_tables
from ledgerlens.streaming import cooldown, progress, run, scoring, windows

from .conftest import SF
from .test_alerts import T, frame, greedy, rows_of


def test_cooldown_over_many_batches(spark, tmp_path):
    """State carries the last emitted alert from file to file."""
    rows = sorted(rows_of(5, 400), key=lambda r: r[1])
    for i in range(4):
        frame(spark, rows[i * 100:(i + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = frame(spark, rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.tx_id for r in run.drain(cooldown.alert_stream(stream, T, "3650 days"), "t").collect()}
    assert got == greedy(rows)


def test_cooldown_groups_do_not_grow_with_accounts(spark, tmp_path):
    """Python is called for each threshold and bucket, not for each account; rows without a time raise no alert."""
    rows = [(2 * a + i, 1_700_000_000_000_000 + 100 * i, f"A{a}", "DEBIT", 1.0, 0.95) for a in range(3000) for i in range(2)]
    made = frame(spark, rows).unionByName(frame(spark, [(9000, 0, "A1", "DEBIT", 1.0, 0.95)]).withColumn("ts", F.lit(None).cast("timestamp")))
    made.coalesce(2).write.parquet(str(tmp_path / "in"))
    out = cooldown.alert_stream(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in")), T, "3650 days")
    query = run.to_table(out, str(tmp_path / "table"), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= cooldown.BUCKETS
    assert {r.tx_id for r in spark.read.parquet(str(tmp_path / "table")).collect()} == greedy(rows)


def test_cooldown_state_expires(spark, tmp_path):
    """The state of a bucket goes with the last of its accounts; accounts that alert later start anew."""
    rows = [(i, 1_700_000_000_000_000 + 4_000_000_000 * i, f"A{i % 7}", "DEBIT", 1.0, 0.95) for i in range(60)]
    for i in range(6):
        frame(spark, rows[10 * i:10 * i + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = run.to_table(cooldown.alert_stream(stream, T), str(tmp_path / "table"), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination()
    assert {r.tx_id for r in spark.read.parquet(str(tmp_path / "table")).collect()} == greedy(rows)
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


def test_fan_out_of_scores(spark, tmp_path):
    tx = driver_tables.transactions(spark, SF).limit(300)
    bad = tx.limit(7).withColumn("amount", F.lit(-1.0))
    tx.unionByName(bad).coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tx.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    scoring.start_scoring(stream, out, driver_tables.booking_time(), once=True).awaitTermination()
    made = run.read_output(spark, out, "decisions")
    assert made.count() == 300 and run.read_output(spark, out, "quarantine").count() == 7
    assert run.read_output(spark, out, "alerts").count() == made.filter("alert_generated").count()


def test_explained_stream_equals_batch(spark):
    tx = driver_tables.booked(driver_tables.stream(spark, SF, "orders"), driver_tables.table(spark, SF, "customer"))
    out = run.drain(scoring.score_stream(tx, with_explanation=True).select("tx_id", "explanation.text"), "texts")
    assert out.filter("text like '%RISK: This transaction%'").count() == driver_tables.transactions(spark, SF).count()


def test_late_rows_are_dropped(spark, tmp_path):
    base = 1_700_000_000
    for part in ([(1, base), (2, base + 7200)], [(4, base + 7300)], [(3, base + 60)], [(5, base + 90000)]):
        spark.createDataFrame(part, "event_id bigint, s bigint").select(
            "event_id", F.timestamp_seconds("s").alias("ts"), F.lit("m").alias("name"), F.lit(1.0).alias("value")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run.drain(windows.metric_summary_stream(stream), "late").agg(F.sum("count")).first()[0]
    assert got == 3  # row 3 came after the watermark, row 5's window is still open


def test_outbox_has_a_row_per_channel(spark):
    a = alerts.raise_alerts(frame(spark, [(1, 0, "A", "DEBIT", 1.0, 0.95)]))
    assert {r.channel for r in scoring.outbox_stream(a).collect()} == {"EMAIL", "SMS", "LOG_ONLY"}


def test_empty_feedback_window(spark):
    d = decisions.decide(driver_tables.scored(spark, SF), ts=driver_tables.booking_time())
    got = decisions.feedback(d, driver_tables.outcomes(spark, SF), "2030-01-01").collect()
    assert len(got) == 1 and not got[0].total_predictions


def test_a_batch_is_scored_once_and_late_rows_are_counted(spark, tmp_path):
    tx = driver_tables.transactions(spark, SF).orderBy("tx_id").limit(200)
    calls = spark.sparkContext.accumulator(0)

    def scorer(df):
        calls.add(1)  # on the driver: once a plan
        return rule_scorer()(df)

    folder, runs = str(tmp_path / "out"), []
    waves = [(tx, 700), (tx.limit(5), 3), (tx.limit(4).withColumn("tx_id", F.col("tx_id") + 10_000), 3), (tx.limit(3).withColumn("tx_id", F.col("tx_id") + 20_000), 699)]
    with progress.totals(spark) as seen:
        for rows, step in waves:
            rows.withColumn("step", F.lit(step).cast(tx.schema["step"].dataType)).write.mode("append").parquet(str(tmp_path / "in"))
            stream = scoring.once_each(spark.readStream.schema(tx.schema).parquet(str(tmp_path / "in")), driver_tables.booking_time(), "2 days")
            query = scoring.start_scoring(stream, folder, F.col("ts"), scorer=scorer, once=True)
            query.awaitTermination()
            runs.append(seen.of(query))
    assert [r.received for r in runs] == [200, 5, 4, 3] and [r.late for r in runs] == [0, 5, 4, 0]
    assert run.read_output(spark, folder, "decisions").count() == 203
    assert calls.value == sum(r.batches for r in runs)


def test_repeated_requests_are_scored_once(spark, tmp_path):
    tx = driver_tables.transactions(spark, SF).orderBy("tx_id").limit(50)
    tx.unionByName(tx).write.parquet(str(tmp_path / "in"))
    stream = scoring.once_each(spark.readStream.schema(tx.schema).parquet(str(tmp_path / "in")), driver_tables.booking_time(), "2 days")
    scoring.start_scoring(stream, str(tmp_path / "out"), F.col("ts"), once=True).awaitTermination()
    assert run.read_output(spark, str(tmp_path / "out"), "decisions").count() == 50

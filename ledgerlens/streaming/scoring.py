"""Streaming scores: validate, score, explain, log and alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts, decisions
from ..operators.quality import request_errors
from ..operators.scoring import Scorer, Thresholds, batch_score, explain


def score_stream(stream: DataFrame, scorer: Scorer | None = None, thresholds: Thresholds = Thresholds(),
                 with_explanation: bool = False) -> DataFrame:
    """The batch scorer on a stream; broken requests are left out (see ``start_scoring``)."""
    scored = batch_score(stream.filter(F.size(request_errors()) == 0), scorer, thresholds)
    return explain(scored, thresholds) if with_explanation else scored


def once_each(stream: DataFrame, ts: Column, lateness: str, id_column: str = "tx_id") -> DataFrame:
    """Requests with their time as ``ts``, each id once within the lateness; rows older than the watermark are dropped and counted
    by Spark (see ``progress.Totals``)."""
    return stream.withColumn("ts", ts).withWatermark("ts", lateness).dropDuplicatesWithinWatermark([id_column])


def start_scoring(stream: DataFrame, folder: str, ts: Column, scorer: Scorer | None = None,
                  thresholds: Thresholds = Thresholds(), once: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Decisions, decision alerts and dead letters, each micro-batch in ``folder/<table>/batch=<id>``.

    Rows that break request rules go to ``quarantine`` with their ``errors``. A batch is scored once: alerts are read off the
    decisions written. A repeated batch overwrites its own folders.
    """
    def write(batch: DataFrame, number: int) -> None:
        def to(name: str) -> str:
            return f"{folder}/{name}/batch={number}"

        checked = batch.withColumn("errors", request_errors()).persist()
        try:
            good = checked.filter(F.size("errors") == 0).drop("errors")
            made = decisions.decide(batch_score(good, scorer, thresholds), thresholds.risk, ts=ts)
            made.write.mode("overwrite").parquet(to("decisions"))
            checked.filter(F.size("errors") > 0).write.mode("overwrite").parquet(to("quarantine"))
        finally:
            checked.unpersist()
        written = batch.sparkSession.read.schema(made.schema).parquet(to("decisions"))
        decisions.alert_log(written).write.mode("overwrite").parquet(to("alerts"))

    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()


def outbox_stream(alert_stream: DataFrame) -> DataFrame:
    return alerts.outbox(alert_stream)

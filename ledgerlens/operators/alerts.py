"""Alert thresholds, greedy per-account cooldown, acknowledgement and statistics.

Input rows carry ``ts``, ``nameOrig`` and ``fraud_score`` and an id that is unique
per row (``tx_id`` by default).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.risk import alert_level
from ..schema import RETENTION_DAYS_ALERTS, SEVERITIES
from ..session import cut_lineage
from .quality import since

CHANNELS = ("EMAIL", "SMS", "WEBHOOK", "LOG_ONLY")
NO_ACCOUNT = "unknown"  # fixed value
# Longest run of close events folded in one task; longer runs go through jump tables.
FOLD_ROWS = 50_000


@dataclass(frozen=True)
class Threshold:
    name: str
    low: float
    high: float
    severity: str
    cooldown_seconds: int
    channels: tuple[str, ...] = ("LOG_ONLY",)
    enabled: bool = True

    def __post_init__(self):
        if not (0 <= self.low <= 1 and 0 <= self.high <= 1 and self.low < self.high):
            raise ValueError(f"score range of {self.name} must satisfy 0 <= low < high <= 1")
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity}")

    def matches(self, score: Column) -> Column:
        """``low <= score < high``; a range that ends at 1 includes 1."""
        top = score <= self.high if self.high >= 1 else score < self.high
        return (score >= self.low) & top


# ---- fixed values: default thresholds, first match wins --------------------------
DEFAULT_THRESHOLDS = (
    Threshold("critical_fraud", 0.9, 1.0, "CRITICAL", 60, ("EMAIL", "SMS", "LOG_ONLY")),
    Threshold("high_risk_fraud", 0.8, 0.9, "HIGH", 300, ("EMAIL", "LOG_ONLY")),
    Threshold("medium_risk_fraud", 0.6, 0.8, "MEDIUM", 900, ("LOG_ONLY",)),
)


def with_cooldowns(seconds: Sequence[int], thresholds: Sequence[Threshold] = DEFAULT_THRESHOLDS):
    return tuple(replace(t, cooldown_seconds=s) for t, s in zip(thresholds, seconds))


def add_threshold(thresholds: Sequence[Threshold], new: Threshold) -> tuple[Threshold, ...]:
    if any(t.name == new.name for t in thresholds):
        raise ValueError(f"threshold {new.name} exists")
    return (*thresholds, new)


def remove_threshold(thresholds: Sequence[Threshold], name: str) -> tuple[Threshold, ...]:
    if not any(t.name == name for t in thresholds):
        raise KeyError(name)
    return tuple(t for t in thresholds if t.name != name)


def update_threshold(thresholds: Sequence[Threshold], name: str, **changes) -> tuple[Threshold, ...]:
    if not any(t.name == name for t in thresholds):
        raise KeyError(name)
    return tuple(replace(t, **changes) if t.name == name else t for t in thresholds)


def threshold_table(spark: SparkSession, thresholds: Sequence[Threshold] = DEFAULT_THRESHOLDS) -> DataFrame:
    rows = [(i, t.name, t.low, t.high, t.severity, t.cooldown_seconds, list(t.channels), t.enabled)
            for i, t in enumerate(thresholds)]
    layout = ("position int, name string, low double, high double, severity string, "
              "cooldown_seconds int, channels array<string>, enabled boolean")
    return spark.createDataFrame(rows, layout)


def match(df: DataFrame, thresholds: Sequence[Threshold] = DEFAULT_THRESHOLDS) -> DataFrame:
    """Rows that meet a threshold, with its name, severity, cooldown and channels.

    The few thresholds are a constant ``when`` chain, so matching needs no join."""
    score, chain = F.col("fraud_score"), None
    for t in (t for t in thresholds if t.enabled):
        made = F.struct(
            F.lit(t.name).alias("threshold_name"), F.lit(t.severity).alias("severity"),
            F.lit(t.cooldown_seconds).cast("bigint").alias("cooldown_seconds"),
            F.array(*[F.lit(c) for c in t.channels]).alias("channels"),
        )
        hit = t.matches(score)
        chain = F.when(hit, made) if chain is None else chain.when(hit, made)
    if chain is None:
        chain = F.lit(None).cast("struct<threshold_name:string,severity:string,cooldown_seconds:bigint,channels:array<string>>")
    if "nameOrig" in df.columns:  # alerts without an account share one cooldown
        df = df.withColumn("nameOrig", F.coalesce("nameOrig", F.lit(NO_ACCOUNT)))
    return df.withColumn("_m", chain).filter("_m is not null").select(*df.columns, "_m.*")


# ---- cooldown ------------------------------------------------------------------------
def emitted_times(matched: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(threshold_name, nameOrig, us): the instants at which an alert goes out.

    An alert suppresses later ones of the same threshold and account until the cooldown
    has passed since the last *emitted* one. Rows of one instant count once. Time is cut
    into cells one cooldown wide: after an empty cell the past no longer matters, so runs
    of filled cells are independent and an account's history splits wherever it pauses.
    Runs up to ``fold_rows`` instants are folded in one task each; longer ones are
    resolved by jump tables, which never gather a run.
    """
    key = ["threshold_name", "nameOrig"]
    us = F.unix_micros("ts")
    instants = matched.filter("ts is not null").select(
        *key, us.alias("us"), (F.col("cooldown_seconds") * 1_000_000).alias("gap")
    ).distinct()
    width = F.greatest(F.col("gap"), F.lit(1))
    # the cell is never null, so both uses of the instants share one shuffle
    celled = instants.withColumn("cell", F.coalesce(F.floor(F.col("us") / width).cast("bigint"), F.lit(0).cast("bigint")))
    cells = celled.groupBy(*key, "cell").agg(F.count("*").alias("rows"))
    along = Window.partitionBy(*key).orderBy("cell")
    fresh = F.coalesce((F.col("cell") - F.lag("cell").over(along) > 1).cast("int"), F.lit(0))
    runs = cells.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    size = F.sum("rows").over(Window.partitionBy(*key, "run"))
    tagged = celled.join(runs.withColumn("run_rows", size).drop("fresh", "rows"), [*key, "cell"])
    short = _fold(tagged.filter(F.col("run_rows") <= fold_rows), key)
    longest = runs.withColumn("run_rows", size).agg(F.max("run_rows")).first()[0] or 0
    if longest <= fold_rows:
        return short
    return short.unionByName(_jump(tagged.filter(F.col("run_rows") > fold_rows), key))


def _fold(tagged: DataFrame, key: list[str]) -> DataFrame:
    """Greedy fold over the sorted instants of a run of bounded size."""
    state = F.struct(
        F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out")
    )
    gap = F.col("gap")

    def step(acc, t):
        goes = acc["last"].isNull() | (t - acc["last"] >= gap)
        return F.struct(
            F.when(goes, t).otherwise(acc["last"]).alias("last"),
            F.when(goes, F.concat(acc["out"], F.array(t))).otherwise(acc["out"]).alias("out"),
        )

    grouped = tagged.groupBy(*key, "run", "gap").agg(F.array_sort(F.collect_list("us")).alias("times"))
    return grouped.select(*key, F.explode(F.aggregate("times", state, step)["out"]).alias("us"))


def _jump(tagged: DataFrame, key: list[str]) -> DataFrame:
    """Instants reached from the first of each run by repeatedly jumping to the first
    instant at least one cooldown later.

    ``next`` lies in the following cell or, failing that, is the first instant of the cell
    after it. Jumps of 1, 2, 4, ... steps are built by joining a table with itself; going
    back from the longest, each doubles the reached set, so the rounds grow with the
    logarithm of the longest chain. Tables are cut at each round.
    """
    path = [*key, "run"]
    rows = tagged.select(*path, "cell", "us", "gap")
    marks = rows.select(*path, "cell", "us", F.lit(1).alias("real"), F.lit(None).cast("bigint").alias("origin"))
    probes = rows.select(
        *path, (F.col("cell") + 1).alias("cell"), (F.col("us") + F.col("gap")).alias("us"),
        F.lit(0).alias("real"), F.col("us").alias("origin"),
    )
    # the probe looks ahead within its cell, at and after its own instant
    ahead = Window.partitionBy(*path, "cell").orderBy(F.col("us"), F.col("real")).rowsBetween(0, Window.unboundedFollowing)
    found = marks.unionByName(probes).withColumn("hit", F.min(F.when(F.col("real") == 1, F.col("us"))).over(ahead))
    firsts = rows.groupBy(*path, "cell").agg(F.min("us").alias("first"))
    later = firsts.select(*path, (F.col("cell") - 1).alias("cell"), F.col("first"))
    jump = (
        found.filter("real = 0").join(later, [*path, "cell"], "left")
        .select(*path, F.col("origin").alias("us"), F.coalesce("hit", "first").alias("to")).filter("to is not null")
    )
    jump = cut_lineage(jump, "jump")
    reached = firsts.groupBy(*path).agg(F.min("first").alias("us"))
    span = rows.groupBy(*path).agg((F.max("cell") - F.min("cell") + 2).alias("n")).agg(F.max("n")).first()[0]
    jumps = [jump]
    while (1 << len(jumps)) < span:
        last = jumps[-1]
        onward = last.select(*path, F.col("us").alias("to"), F.col("to").alias("end"))
        jumps.append(cut_lineage(last.join(onward, [*path, "to"]).select(*path, "us", F.col("end").alias("to")), "jump"))
    for table in reversed(jumps):
        more = reached.join(table, [*path, "us"]).select(*path, F.col("to").alias("us"))
        reached = cut_lineage(reached.unionByName(more).distinct(), "reached")
    return reached.select(*key, "us")


def raise_alerts(df: DataFrame, thresholds: Sequence[Threshold] = DEFAULT_THRESHOLDS,
                 id_column: str = "tx_id", fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Alerts that go out: one row per emitted alert (lowest id of its instant)."""
    matched = match(df, thresholds)
    key = ["threshold_name", "nameOrig", "us"]
    sent = emitted_times(matched, fold_rows)
    columns = [c for c in matched.columns if c not in ("threshold_name", "nameOrig")]
    first = matched.withColumn("us", F.unix_micros("ts")).groupBy(*key).agg(
        F.min_by(F.struct(*columns), F.col(id_column)).alias("_row")
    )
    emitted = first.join(sent, key, "left_semi").select("threshold_name", "nameOrig", "_row.*")
    return describe_alerts(emitted, id_column)


def describe_alerts(emitted: DataFrame, id_column: str = "tx_id") -> DataFrame:
    """Alert record: stable id, risk level and log line."""
    line = F.concat(
        F.lit("FRAUD ALERT: "), F.col("severity"), F.lit(" | Score: "), F.format_string("%.3f", F.col("fraud_score")),
        F.lit(" | Transaction: "), F.coalesce(F.col("type"), F.lit("UNKNOWN")), F.lit(" $"),
        F.format_number(F.coalesce(F.col("amount"), F.lit(0.0)), 2),
        F.lit(" | Account: "), F.coalesce(F.col("nameOrig"), F.lit("UNKNOWN")),
    )
    return emitted.withColumns(
        {
            "alert_id": F.md5(F.concat_ws("|", "threshold_name", F.col(id_column).cast("string"))),
            "risk_level": alert_level(F.col("fraud_score")), "status": F.lit("PENDING"), "message": line,
        }
    )


def outbox(alerts: DataFrame) -> DataFrame:
    """One row per alert and channel, for a delivery service to pick up."""
    return alerts.select("alert_id", "severity", "ts", F.explode("channels").alias("channel"), "message")


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Join the latest acknowledgement (alert_id, acknowledged_by, acknowledged_at)."""
    latest = acks.groupBy("alert_id").agg(
        F.max_by("acknowledged_by", "acknowledged_at").alias("acknowledged_by"),
        F.max("acknowledged_at").alias("acknowledged_at"),
    )
    joined = alerts.join(latest, "alert_id", "left")
    return joined.withColumn(
        "status", F.when(F.col("acknowledged_at").isNotNull(), "ACKNOWLEDGED").otherwise(F.col("status"))
    )


def active(alerts: DataFrame, severity: str | None = None) -> DataFrame:
    """Unacknowledged alerts (order by ``ts`` descending for display)."""
    out = alerts.filter(F.col("status") != "ACKNOWLEDGED")
    return out.filter(F.col("severity") == severity) if severity else out


def history(alerts: DataFrame, as_of, hours: int = 24, severity: str | None = None) -> DataFrame:
    out = since(alerts, as_of, hours=hours)
    return out.filter(F.col("severity") == severity) if severity else out


def newest_first(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), "alert_id")


def statistics(alerts: DataFrame) -> DataFrame:
    """Totals, per severity, per status, and the delivery success rate."""
    by_severity = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    sent, failed = F.count_if(F.col("status") == "SENT"), F.count_if(F.col("status") == "FAILED")
    return alerts.agg(
        F.count("*").alias("total_alerts"), *by_severity,
        F.count_if(F.col("status") != "ACKNOWLEDGED").alias("active_alerts"),
        F.count_if(F.col("status") == "ACKNOWLEDGED").alias("acknowledged_alerts"), failed.alias("failed_alerts"),
        F.when(sent + failed > 0, sent / (sent + failed)).otherwise(0.0).alias("notification_success_rate"),
        F.max("ts").alias("last_alert_time"),
    )


def retained(alerts: DataFrame, as_of, days: int = RETENTION_DAYS_ALERTS) -> DataFrame:
    return since(alerts, as_of, days=days)


def oldest_kept(as_of, days: int = RETENTION_DAYS_ALERTS) -> Column:
    """The limit before which ``retention.drop_before`` deletes."""
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))


def severity_share(alerts: DataFrame) -> DataFrame:
    """Count and share of the four severities; others are ignored."""
    known = alerts.select(F.upper("severity").alias("severity")).filter(F.col("severity").isin(SEVERITIES))
    stats = known.agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    rows = F.array(*[
        F.struct(
            F.lit(s.lower()).alias("severity"), F.col(s).alias("alerts"),
            F.when(F.col("n") > 0, F.col(s) / F.col("n")).otherwise(0.0).alias("share"),
        ) for s in SEVERITIES
    ])
    return stats.select(F.inline(rows))

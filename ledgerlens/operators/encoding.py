"""Label and one-hot encoding and scaling with fitted parameters.

MLlib's indexer and scalers differ in detail (sample deviation, midpoint for
constant columns), so the parameters are fitted by plain aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .quantiles import quantiles

# ---- fixed values ------------------------------------------------------------
CATEGORICAL_SHARE, CATEGORICAL_DISTINCT = 0.05, 20
NULL_TEXT = "nan"

BROADCAST_DICTIONARY = 200_000


def detect_types(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column, kind): text is categorical, numbers too when they have few distinct values.

    Approximate counts rule out most numeric columns; only near ones are counted exactly.
    """
    cols = [f for f in df.schema.fields if f.name != target]
    nums = [f.name for f in cols if isinstance(f.dataType, T.NumericType)]
    r = df.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c).alias(c) for c in nums]).first()
    near = [c for c in nums if r[c] < 3 * CATEGORICAL_DISTINCT]
    exact = df.agg(F.lit(0), *[F.count_distinct(c).alias(c) for c in near]).first()

    def kind(f):
        if isinstance(f.dataType, T.StringType):
            return "categorical"
        if f.name not in nums:
            return None
        few = f.name in near and exact[f.name] < CATEGORICAL_DISTINCT
        return "categorical" if few and exact[f.name] / max(r["_n"], 1) < CATEGORICAL_SHARE else "numerical"

    rows = [(f.name, kind(f)) for f in cols]
    return df.sparkSession.createDataFrame([x for x in rows if x[1]], "column string, kind string")


def text_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT))


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes follow the order of the text form; null is its own category.

    The values are range-sorted once into a table, numbered within each sorted part and
    shifted by the sizes of the parts before it.
    """
    return sorted_codes(df.select(text_of(column).alias("value")).distinct())


def sorted_codes(values: DataFrame) -> DataFrame:
    """Dense codes in sort order for any number of distinct values."""
    position = F.monotonically_increasing_id()
    parted = cut_lineage(values.repartitionByRange("value").sortWithinPartitions("value")
                         .withColumn("position", position), "labels")
    keyed = parted.select(
        "value", F.shiftright("position", 33).alias("part"),
        F.col("position").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = keyed.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    return keyed.join(starts, "part").select("value", (F.col("start") + F.col("row")).alias("code"))


def label_encode(df: DataFrame, column: str, dictionary: DataFrame, unknown: str = "ignore") -> DataFrame:
    """Replace the column by its code. Unknown values get code 0, null with
    ``missing``, or fail with ``error``.

    The dictionary is broadcast only below a checked size; a larger one is joined by
    shuffle, where the adaptive skew join splits a dominant value.
    """
    small = dictionary.limit(BROADCAST_DICTIONARY + 1).count() <= BROADCAST_DICTIONARY
    side = dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(F.broadcast(side) if small else side, text_of(column) == F.col("_value"), "left")
    code = F.col("_code")
    if unknown == "error":
        code = F.coalesce(code, F.raise_error(F.concat(F.lit("unknown category: "), text_of(column))).cast("bigint"))
    elif unknown == "ignore":
        code = F.coalesce(code, F.lit(0).cast("bigint"))
    return joined.withColumn(column, code).drop("_value", "_code")


def one_hot_values(df: DataFrame, column: str) -> list[str]:
    """Sorted categories, which become columns; use ``one_hot_vector`` for columns of many values."""
    return sorted(r["v"] for r in df.select(text_of(column).alias("v")).distinct().collect())


def one_hot_vector(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Replace the column by a sparse 0/1 vector at its code, for any number of categories."""
    size = dictionary.count()
    coded = label_encode(df.withColumn("_code_of", F.col(column)), "_code_of", dictionary, unknown="missing")
    vector = F.struct(F.lit(size).alias("size"), F.when(F.col("_code_of").isNotNull(), F.array(F.col("_code_of")))
                      .otherwise(F.array().cast("array<bigint>")).alias("indices"))
    return coded.withColumn(column, vector).drop("_code_of")


def one_hot_encode(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Columns ``column_value`` of 0.0/1.0 replace the column; unknown values give zeros."""
    made = {f"{column}_{v}": F.when(text_of(column) == v, 1.0).otherwise(0.0) for v in values}
    return df.withColumns(made).drop(column)


# ---- scaling -------------------------------------------------------------------
@dataclass(frozen=True)
class Scaler:
    """``(x - shift) / scale * spread + floor``, null first replaced by the median."""

    column: str
    shift: float
    scale: float
    spread: float = 1.0
    floor: float = 0.0
    fill: float | None = None

    def forward(self) -> Column:
        x = F.col(self.column).cast("double")
        if self.fill is not None:
            x = F.coalesce(x, F.lit(self.fill))
        return (x - self.shift) / self.scale * self.spread + self.floor

    def inverse(self) -> Column:
        return (F.col(self.column) - self.floor) / self.spread * self.scale + self.shift


def fit_scalers(df: DataFrame, columns: list[str], kind: str = "standard", with_mean: bool = True,
                with_std: bool = True, feature_range: tuple[float, float] = (0.0, 1.0)) -> list[Scaler]:
    """Standard (population deviation) or min-max parameters; a constant column divides by 1.
    Gaps are filled by the median before the moments are taken."""
    nulls = df.agg(F.lit(0), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    gaps = [c for c in columns if nulls[c]]
    medians = {c: quantiles(df, gaps, [0.5])[(None, c)][0] for c in gaps} if gaps else {}
    filled = df.select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) if c in medians
        else F.col(c).cast("double").alias(c) for c in columns
    ])
    aggs = [
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
        for c in columns
    ]
    r = filled.agg(*aggs).first()
    lo, hi = feature_range
    out = []
    for c in columns:
        p, fill = r[c], medians.get(c)
        if kind == "standard":
            out.append(Scaler(c, p["mean"] if with_mean else 0.0, (p["std"] or 1.0) if with_std else 1.0, fill=fill))
        elif kind == "minmax":
            out.append(Scaler(c, p["lo"], (p["hi"] - p["lo"]) or 1.0, hi - lo, lo, fill))
        else:
            raise ValueError(f"unknown scaling {kind}")
    return out


def scale(df: DataFrame, scalers: list[Scaler]) -> DataFrame:
    return df.withColumns({s.column: s.forward() for s in scalers})


def unscale(df: DataFrame, scalers: list[Scaler]) -> DataFrame:
    return df.withColumns({s.column: s.inverse() for s in scalers})


# ---- encoder -------------------------------------------------------------------
@dataclass
class Encoder:
    """Fitted encoder: categorical columns first, then scaling."""

    categorical: str = "label"
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    scalers: list[Scaler] = field(default_factory=list)
    unknown: str = "ignore"

    def transform(self, df: DataFrame) -> DataFrame:
        for c, d in self.dictionaries.items():
            df = label_encode(df, c, d, self.unknown)
        for c, v in self.one_hot.items():
            df = one_hot_encode(df, c, v)
        return scale(df, self.scalers)

    def feature_names(self) -> list[str]:
        hot = [f"{c}_{v}" for c, vs in self.one_hot.items() for v in vs]
        return [*self.dictionaries, *hot, *[s.column for s in self.scalers]]

    def summary(self, spark: SparkSession) -> DataFrame:
        rows = [(c, "label") for c in self.dictionaries] + [(c, "onehot") for c in self.one_hot]
        rows += [(s.column, "scaled") for s in self.scalers]
        return spark.createDataFrame(rows, "column string, treatment string")

    def save(self, spark: SparkSession, path: str) -> None:
        """Dictionaries as one table per column, scalers and one-hot values as small tables."""
        for c, d in self.dictionaries.items():
            d.write.mode("overwrite").parquet(f"{path}/label/{c}")
        meta = [("label", c, i, "") for i, c in enumerate(self.dictionaries)]
        meta += [("onehot", c, i, v) for c, vs in self.one_hot.items() for i, v in enumerate(vs)]
        meta.append(("unknown", "", 0, self.unknown))
        spark.createDataFrame(meta, "kind string, column string, position int, value string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        layout = "position int, column string, shift double, scale double, spread double, floor double, fill double"
        rows = [(i, s.column, s.shift, s.scale, s.spread, s.floor, s.fill) for i, s in enumerate(self.scalers)]
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("overwrite").parquet(f"{path}/scalers")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        meta = spark.read.parquet(f"{path}/columns").orderBy("kind", "column", "position").collect()
        out = Encoder()
        for r in meta:
            if r.kind == "unknown":
                out.unknown = r.value
        for r in sorted((m for m in meta if m.kind == "label"), key=lambda m: m.position):
            out.dictionaries[r.column] = spark.read.parquet(f"{path}/label/{r.column}")
        for r in meta:
            if r.kind == "onehot":
                out.one_hot.setdefault(r.column, []).append(r.value)
        out.categorical = "onehot" if out.one_hot else "label"
        out.scalers = [
            Scaler(r.column, r.shift, r["scale"], r.spread, r.floor, r.fill)
            for r in spark.read.parquet(f"{path}/scalers").orderBy("position").collect()
        ]
        return out


def fit_encoder(df: DataFrame, categorical_columns: list[str], numeric_columns: list[str],
                categorical: str = "label", scaling: str | None = "standard", unknown: str = "ignore") -> Encoder:
    """Fit on ``df``. Dictionaries are written once, so transforms never scan ``df`` again."""
    enc = Encoder(categorical=categorical, unknown=unknown)
    if categorical == "label":
        enc.dictionaries = {c: cut_lineage(label_dictionary(df, c), "dictionary") for c in categorical_columns}
    elif categorical == "onehot":
        enc.one_hot = {c: one_hot_values(df, c) for c in categorical_columns}
    else:
        raise ValueError(f"unknown encoding {categorical}")
    if scaling and numeric_columns:
        enc.scalers = fit_scalers(df, numeric_columns, scaling)
    return enc


# ---- model input -----------------------------------------------------------------
def training_columns(df: DataFrame, label: str = "isFraud") -> list[str]:
    """Numeric columns except the label and account names."""
    left_out = {label, "nameOrig", "nameDest"}
    return [f.name for f in df.schema.fields if f.name not in left_out and isinstance(f.dataType, T.NumericType)]


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    wide = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep").transform(wide)

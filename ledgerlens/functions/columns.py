"""Small column builders used by several operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``numerator / denominator`` where the denominator is positive, else 0."""
    d = col(denominator)
    return F.when(d > 0, col(numerator) / d).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    """Condition as 0/1, null counted as 0."""
    return F.when(condition, 1).otherwise(0)


def lookup(key: Column, values: Mapping[str, float], default) -> Column:
    """Constant dictionary as a ``when`` chain, evaluated inside generated code."""
    chain = None
    for k, v in values.items():
        hit = key == F.lit(k)
        chain = F.when(hit, F.lit(v)) if chain is None else chain.when(hit, F.lit(v))
    return chain.otherwise(F.lit(default))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, for output that must not show summation order."""
    return df.select(
        [
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def unpivot(df: DataFrame, keep: Iterable[str], columns: Iterable[str],
            name: str = "column", value: str = "value", dtype: str = "double") -> DataFrame:
    """Wide to long without a shuffle; every value is cast to one type."""
    keep, columns = list(keep), list(columns)
    cast = df.select(*keep, *[F.col(c).cast(dtype).alias(c) for c in columns])
    return cast.unpivot(keep, columns, name, value)


def report_rows(stats: DataFrame, entries: list[tuple], schema_names: list[str]) -> DataFrame:
    """One-row statistics to a long report; ``entries`` hold one Column per output field."""
    rows = F.array(*[F.struct(*[v.alias(n) for n, v in zip(schema_names, e)]) for e in entries])
    return stats.select(F.inline(rows))


_WHOLE = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def coerced(c: str, kind: str) -> Column:
    """``c`` as ``kind``, null where it does not fit; a whole number may be written ``1.0`` or ``1e3``."""
    direct = F.col(c).try_cast(kind)
    if kind not in _WHOLE:
        return direct
    number = F.col(c).try_cast("double")
    whole = (F.floor(number).cast("double") == number) & (F.abs(number) < float(1 << _WHOLE[kind]))
    return F.coalesce(direct, F.when(whole, number).try_cast(kind))

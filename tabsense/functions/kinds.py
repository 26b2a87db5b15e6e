"""Column kinds: the four questions every operator asks about a column.

* numeric      -> NumericType (byte..double, decimal); booleans are *not* numeric
* categorical  -> every other atomic column (string, boolean, date, timestamp)
* numeric-like -> numeric or boolean (what the outlier detectors accept)
* text         -> StringType

NaN is not NULL in Spark; ``clean`` maps NaN (and +/-Inf where asked) to NULL
so that counts, averages and quantiles treat it as missing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATOMIC = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
          T.NumericType, T.BinaryType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_numeric_like(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, T.IntegralType)


def is_atomic(dt: T.DataType) -> bool:
    return isinstance(dt, ATOMIC)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not is_numeric(f.dataType) and is_atomic(f.dataType)]


def q(name: str) -> str:
    """Backtick-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def clean(df: DataFrame, name: str, inf_to_null: bool = False) -> Column:
    """Column with NaN (and optionally +/-Inf) turned into NULL."""
    c = col(name)
    if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)):
        bad = F.isnan(c)
        if inf_to_null:
            bad = bad | (F.abs(c) == F.lit(float("inf")))
        return F.when(bad, F.lit(None)).otherwise(c)
    return c


def missing(df: DataFrame, name: str) -> Column:
    """True when the value counts as missing (NULL, or NaN for floats)."""
    c = col(name)
    if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def as_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def r6(c: Column) -> Column:
    """Round a double result to 6 decimals (the oracle comparison precision)."""
    return F.round(c.cast("double"), 6)


def pct2(c: Column) -> Column:
    """Percent with 2 decimals, half-to-even like numpy."""
    return F.bround(c.cast("double"), 2)

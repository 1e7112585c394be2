"""Equality of stored values, as Spark expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalvault.fixed_values import ATOL, RTOL

_INF = float("inf")


def is_close(a: Column, b: Column) -> Column:
    """Tolerant equality of two doubles; ``b`` scales the tolerance.

    Spark sorts NaN above everything and calls NaN equal to NaN, so NaN and the
    infinities need branches of their own.
    """
    return (
        F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b))
        .when((F.abs(a) == _INF) | (F.abs(b) == _INF), a == b)
        .otherwise(F.abs(a - b) <= F.lit(ATOL) + F.lit(RTOL) * F.abs(b))
    )


def arrays_close(a: Column, b: Column) -> Column:
    """Element-wise tolerant equality; identical arrays are settled by one comparison.

    Arrays of different length are unequal: the missing elements are NULL.
    """
    return F.coalesce((a == b) | F.forall(F.zip_with(a, b, is_close), lambda ok: ok), F.lit(False))


def arrays_exact(a: Column, b: Column) -> Column:
    """Element-wise ``==`` with NaN unequal to everything."""
    return F.coalesce((a == b) & ~F.exists(a, F.isnan), F.lit(False))


def nan_positions_equal(a: Column, b: Column) -> Column:
    return F.transform(a, F.isnan) == F.transform(b, F.isnan)


def as_doubles(side: str) -> Column:
    """The numeric content of a node row, whichever column holds it; NULL if not numeric."""
    kind = F.col(f"{side}.kind")
    return (
        F.when(kind == "f64", F.col(f"{side}.f64"))
        .when(kind == "f32", F.transform(F.col(f"{side}.f32"), lambda x: x.cast("double")))
        .when(kind.isin("i64", "bool"), F.transform(F.col(f"{side}.i64"), lambda x: x.cast("double")))
    )


def as_text(side: str) -> Column:
    """Text content of a row: strings as they are, bytes as UTF-8; NULL if neither or malformed."""
    kind = F.col(f"{side}.kind")
    decoded = F.try_validate_utf8(F.col(f"{side}.bin").cast("string"))
    return (
        F.when(kind == "str", F.col(f"{side}.str"))
        .when((kind == "bin") & decoded.isNotNull(), F.array(decoded))
    )


def node_values_equal(left: str, right: str) -> Column:
    """Equality of two node rows of the same shape; the left row's kind picks the rule."""
    lk, rk = F.col(f"{left}.kind"), F.col(f"{right}.kind")
    integral = ("i64", "bool")
    return F.coalesce(
        F.when(lk.isin("f64", "f32"), arrays_close(as_doubles(left), as_doubles(right)))
        .when(lk.isin(*integral) & rk.isin(*integral), F.col(f"{left}.i64") == F.col(f"{right}.i64"))
        .when(lk.isin(*integral), arrays_exact(as_doubles(left), as_doubles(right)))
        .when((lk == "bin") & (rk == "bin"), F.col(f"{left}.bin") == F.col(f"{right}.bin"))
        .otherwise(as_text(left) == as_text(right)),
        F.lit(False),
    )


def attr_values_equal(left: str, right: str) -> Column:
    """Exact equality of two attribute rows: no tolerance, NaN differs from NaN."""
    lk, rk = F.col(f"{left}.kind"), F.col(f"{right}.kind")
    integral = ("i64", "bool")

    def doubles(side: str) -> Column:
        return F.coalesce(F.col(f"{side}.f64"),
                          F.transform(F.col(f"{side}.i64"), lambda x: x.cast("double")))

    same_form = F.col(f"{left}.is_array") == F.col(f"{right}.is_array")
    return F.coalesce(
        same_form & (
            F.when(lk.isin(*integral) & rk.isin(*integral),
                   F.col(f"{left}.i64") == F.col(f"{right}.i64"))
            .when(lk.isin("f64", "f32", *integral), arrays_exact(doubles(left), doubles(right)))
            .otherwise(as_text(left) == as_text(right))
        ),
        F.lit(False),
    )

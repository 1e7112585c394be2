"""Narrowing of stored numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_float32(nodes: DataFrame) -> DataFrame:
    """Store float64 leaves as float32; everything else stays. A narrow projection."""
    wide = F.col("kind") == "f64"
    return nodes.withColumns({
        "f32": F.when(wide, F.transform("f64", lambda x: x.cast("float"))).otherwise(F.col("f32")),
        "f64": F.when(~wide, F.col("f64")),
        "kind": F.when(wide, F.lit("f32")).otherwise(F.col("kind")),
    })

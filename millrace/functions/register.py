"""The functions of this engine for SQL texts: ``register(spark)``, then ``select cell_number(price) from …``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .cells import literal_date, literal_number
from .names import distance
from .scanners import readable

#: Name in SQL -> (function of one text or two, type of its result).
FUNCTIONS = {"readable_line": (readable, "string"), "cell_number": (literal_number, "double"), "cell_date": (literal_date, "string"), "edit_distance": (distance, "int")}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session, as functions on Arrow batches; nulls give null. Their names."""
    for name, (function, kind) in FUNCTIONS.items():
        spark.udf.register(name, _batched(function, kind))
    return sorted(FUNCTIONS)


def _batched(function, kind: str):
    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[kind]
    if function is distance:

        @F.arrow_udf(kind)
        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([None if x is None or y is None else function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], arrow)

        return two

    @F.arrow_udf(kind)
    def one(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in a.to_pylist()], arrow)

    return one

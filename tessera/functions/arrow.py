"""Scalar functions over Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F


def arrow_scalar(fn: Callable[[pa.Array], pa.Array], result: str):
    """`fn` of one Arrow array as a column function."""
    fn.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(fn, result)

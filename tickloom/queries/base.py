"""Query registration: one Spark callable, one column list, one oracle text.

The column list ``"symbol ts:t n:i | a b:4"`` names the output. Columns before
the bar are keys: ``:t`` time as text, ``:i`` 64-bit integer, else unchanged.
Columns after it are doubles, rounded (default 6 digits) the same way on both
sides, with NaN as NULL.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir


# A little over one half: values that end exactly on a half round up on both sides,
# whatever their last bits.
HALF = 0.5000037


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None
    covers: str

    def _fields(self):
        keys, _, values = self.columns.partition("|")
        for word in keys.split():
            name, _, kind = word.partition(":")
            yield name, kind or "raw", None
        for word in values.split():
            name, _, digits = word.partition(":")
            yield name, "double", int(digits or 6)

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(spark, folder)
        return df.select(*[_spark_field(*f).alias(f[0]) for f in self._fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        fields = ", ".join(f"{_sql_field(*f)} AS {f[0]}" for f in self._fields())
        return f"SELECT {fields} FROM (\n{self.sql}\n) AS q"


def _spark_field(name, kind, digits):
    x = F.col(name)
    if kind == "t":
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    if kind == "i":
        return x.cast("bigint")
    if kind == "raw":
        return x
    x = x.cast("double")
    scale = F.lit(10.0**digits)
    return F.when(F.isnan(x), F.lit(None)).when(F.abs(x) > 1e11, x).otherwise(F.floor(x * scale + HALF) / scale)


def _sql_field(name, kind, digits):
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    if kind == "i":
        return f"CAST({name} AS BIGINT)"
    if kind == "raw":
        return name
    x = f"CAST({name} AS DOUBLE)"
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"CASE WHEN isnan({x}) THEN NULL WHEN abs({x}) > 1e11 THEN {x} ELSE floor({x} * {scale} + {HALF}::DOUBLE) / {scale} END"


REGISTERED: dict[str, Query] = {}


def register(name: str, columns: str, covers: str, sql: str | None = None):
    """Decorator: register the callable under a query name with its inventory ids."""

    def wrap(build):
        if name in REGISTERED:
            raise ValueError(f"query {name} is registered twice")
        REGISTERED[name] = Query(name, build, columns, sql, covers)
        return build

    return wrap


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"

"""Hashes by 64-bit arithmetic that wraps, on bigint columns."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The constants of splitmix64 (Steele, Lea and Flood, 2014), and the start of a point's priority.
GAMMA = 0x9E3779B97F4A7C15
MULTIPLIERS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
LAST_SHIFT = 31
START = 0x9E3779B97F4A7C15


def signed(value: int) -> int:
    """The bigint with the same 64 bits."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


@contextlib.contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Sums and products of bigints that are analysed inside wrap at 64 bits, in any later use of their DataFrame.

    An expression keeps the overflow mode that it was analysed with, so only analysis has to happen inside.
    """
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _mixed(df: DataFrame, name: str, seed: Column) -> DataFrame:
    """df with column `name`: splitmix64 of `seed` but for the last shift. Call inside wrapping().

    What is used twice is a projection of its own, so no step is computed twice.
    """
    df = df.withColumn(name, seed + F.lit(signed(GAMMA)))
    for shift, k in MULTIPLIERS:
        df = df.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, shift)) * F.lit(signed(k)))
    return df


def _last(name: str) -> Column:
    return F.col(name).bitwiseXOR(F.shiftrightunsigned(name, LAST_SHIFT))


def with_splitmix64(df: DataFrame, name: str) -> DataFrame:
    """df with splitmix64 of column `name` in its place."""
    with wrapping(df.sparkSession):
        return _mixed(df, name, F.col(name)).withColumn(name, _last(name))


def with_priority(df: DataFrame, exponent: int, name: str = "priority") -> DataFrame:
    """df with each point's rank among candidates of its voxel: splitmix64 over x, y, z as 32 bits, salted by exponent.

    The value is a bigint that orders as the unsigned hash does.
    """
    with wrapping(df.sparkSession):
        state = F.lit(signed(START ^ exponent)).cast("long")
        for axis in ("x", "y", "z"):
            df = _mixed(df, name, state.bitwiseXOR(F.col(axis).cast("long").bitwiseAND(0xFFFFFFFF)))
            state = _last(name)
        return df.withColumn(name, unsigned_order(state))


def unsigned_order(c: Column) -> Column:
    return c.bitwiseXOR(F.lit(signed(1 << 63)).cast("long"))


def splitmix64_sql(name: str, source: str, out: str, first: str) -> str:
    """The same as DuckDB common table expressions: `out` is `source` with ubigint column `name` hashed. first: its input."""
    mod = "18446744073709551616::uhugeint"
    steps = [f"{out}_0 as (select * replace (((({first})::uhugeint + {GAMMA}::uhugeint) % {mod})::ubigint as {name}) from {source})"]
    at = f"{out}_0"
    for i, (shift, k) in enumerate(MULTIPLIERS, 1):
        steps.append(f"{out}_{i} as (select * replace ((xor({name}, {name} >> {shift})::uhugeint * {k}::uhugeint % {mod})::ubigint as {name}) from {at})")
        at = f"{out}_{i}"
    steps.append(f"{out} as (select * replace (xor({name}, {name} >> {LAST_SHIFT}) as {name}) from {at})")
    return ",\n".join(steps)


def priority_sql(source: str, out: str, exponent: int, name: str = "priority") -> str:
    """Common table expressions that add the unsigned priority to `source`."""
    steps, at = [f"{out}_s as (select *, {START ^ exponent}::ubigint as {name} from {source})"], f"{out}_s"
    for i, axis in enumerate(("x", "y", "z")):
        to = out if i == 2 else f"{out}_{axis}"
        steps.append(splitmix64_sql(name, at, to, f"xor({name}, ({axis}::bigint & 4294967295)::ubigint)"))
        at = to
    return ",\n".join(steps)

"""Texts for people: rates, sums, times, flows, points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowseries.functions.values import value_string


def _fixed(v: Column, digits: int) -> Column:
    """A double with so many decimals, rounded by its exact binary value, ties to even, as C does. (Java rounds the
    shortest decimal that stands for it, ties up.) From 2^52 units on a double is formatted as Java does."""
    a, unit = F.abs(v), float(10**digits)
    product = a * unit
    # What the product has lost to rounding, by halves of the number whose products are exact.
    high = a * 134217729.0 - (a * 134217729.0 - a)
    lost = (high * unit - product) + (a - high) * unit
    whole = F.floor(product)
    over = (product - whole.cast("double")) - 0.5
    up = (over > -lost) | ((over == -lost) & (whole % 2 == 1))
    # The product may have been rounded up to a whole number.
    n = whole + F.when(up, 1).otherwise(0)
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    parts = [F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0")] if digits else []
    text = F.concat(sign, F.call_function("div", n, F.lit(10**digits)).cast("string"), *parts)
    return F.when(product < float(1 << 52), text).otherwise(F.format_string(f"%.{digits}f", v))


def _scaled(value: Column, suffix: str, digits: int) -> Column:
    v = value.cast("double")
    unit, scaled, kept = F.lit(""), v, _fixed(v, digits)
    for name, size in (("K", 1e3), ("M", 1e6), ("G", 1e9)):
        unit, scaled = F.when(v > size, name).otherwise(unit), F.when(v > size, v / size).otherwise(scaled)
    text = F.when(v > 1e3, _fixed(scaled, 2)).otherwise(kept)
    return F.concat(text, F.lit(" "), unit, F.lit(suffix))


def format_rate(value: Column, suffix: str = "") -> Column:
    """Two decimals, in G, M or K above those sizes."""
    return _scaled(value, suffix, 2)


def format_sum(value: Column, suffix: str = "") -> Column:
    return _scaled(value, suffix, 0)


def format_elapsed(ms: Column) -> Column:
    return F.format_string("%ds %dms", F.floor(ms / 1000), ms % 1000)


def flow_label(flow: str = "id") -> Column:
    return F.format_string("ID:%d Port: %d-%d IP: %s-%s", F.col(flow), F.col("sport"), F.col("dport"), F.col("src"), F.col("dst"))


def string_label() -> Column:
    return F.concat_ws(" | ", F.col("ts").cast("string"), value_string())

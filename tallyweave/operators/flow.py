"""Operators on five-field packet tuples ``(src_ip, dst_ip, src_port, dst_port, proto)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "proto")

KEY_CHOICES = {
    "five_tuple": FLOW_FIELDS,
    "src_dst": ("src_ip", "dst_ip"),
    "src_port": ("src_ip", "src_port"),
    "dst_port": ("dst_ip", "dst_port"),
    "src": ("src_ip",),
    "dst": ("dst_ip",),
}


def project_flow_key(trace: DataFrame, choice: str, weight: Column | None = None) -> DataFrame:
    """Stream keyed by a choice of tuple fields: one column, or a struct of several."""
    fields = KEY_CHOICES[choice]
    key = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
    rest = [c for c in ("seq", "ts") if c in trace.columns]
    return trace.select(
        key.alias("key"), *rest, (F.lit(1) if weight is None else weight).cast("bigint").alias("weight"))


def key_src_dst() -> Column:
    """Both addresses in one 64-bit key, source in the low half."""
    return F.shiftleft(F.col("dst_ip"), 32).bitwiseOR(F.col("src_ip"))


def key_src_port() -> Column:
    return F.shiftleft(F.col("src_ip"), 32).bitwiseOR(F.col("src_port"))


def key_dst_port() -> Column:
    return F.shiftleft(F.col("dst_ip"), 32).bitwiseOR(F.col("dst_port"))


def set_flow_field(trace: DataFrame, position: int, value: int | Column) -> DataFrame:
    """Overwrite the tuple field at ``position`` (0 = source address ... 4 = protocol)."""
    value = value if isinstance(value, Column) else F.lit(value)
    return trace.withColumn(FLOW_FIELDS[position], value.cast("bigint"))


def drop_empty_tuples(trace: DataFrame) -> DataFrame:
    used = F.lit(False)
    for field in FLOW_FIELDS:
        used = used | (F.col(field) != 0)
    return trace.filter(used)


def flow_order(trace: DataFrame) -> DataFrame:
    """Tuples in column order."""
    return trace.orderBy(*FLOW_FIELDS)

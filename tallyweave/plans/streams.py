"""The given tables seen as streams, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.exact import keyed_stream, split_streams_blocks

BLOCK = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark, d):
    """Ordered parts: many keys of similar, small counts."""
    return keyed_stream(table(spark, d, "lineitem"), "l_partkey")


def suppliers(spark, d):
    """Suppliers, key 0 among them."""
    return keyed_stream(table(spark, d, "lineitem"), "l_suppkey")


def part_quantities(spark, d):
    return keyed_stream(table(spark, d, "lineitem"), "l_partkey", weight="l_quantity")


def users(spark, d):
    """Event users in arrival order."""
    return keyed_stream(table(spark, d, "events"), "user_id", seq="event_id")


def words(spark, d):
    """Words of whole documents: text keys of natural skew."""
    docs = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return keyed_stream(docs.filter(F.col("word") != ""), "word")


def ordered_words(spark, d):
    """The same with arrival numbers: documents by id, words by position."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return keyed_stream(docs.filter(F.col("word") != ""), "word", seq=F.col("doc_id") * 1000000 + F.col("pos"))


def customers(spark, d):
    return keyed_stream(table(spark, d, "orders"), "o_custkey", seq="o_orderkey")


def customers_ab(spark, d):
    """Order customers, in alternating blocks of order keys as streams A and B."""
    return split_streams_blocks(customers(spark, d), BLOCK)


def users_ab(spark, d):
    return split_streams_blocks(users(spark, d), BLOCK)


def side(streams: DataFrame, name: str) -> DataFrame:
    return streams.filter(F.col("stream") == name)


def trace(spark, d):
    """Orders as packets; every seventh customer sends empty tuples."""
    o = table(spark, d, "orders")
    used = (F.col("o_custkey") % 7 != 0).cast("bigint")
    open_order = F.col("o_orderstatus") == "O"
    return o.select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * used).alias("src_ip"),
        (F.col("o_orderkey") % 1000 * used).alias("dst_ip"), (F.col("o_custkey") % 1024 * used).alias("src_port"),
        (F.when(open_order, 443).otherwise(80) * used).alias("dst_port"),
        (F.when(open_order, 17).otherwise(6) * used).alias("proto"),
        (F.datediff("o_orderdate", F.lit("1970-01-01")) * F.lit(86400.0)).alias("ts"))


PARTS = "SELECT l_partkey AS key, 1::BIGINT AS weight FROM lineitem"
SUPPLIERS = "SELECT l_suppkey AS key, 1::BIGINT AS weight FROM lineitem"
PART_QUANTITIES = "SELECT l_partkey AS key, l_quantity::BIGINT AS weight FROM lineitem"
USERS = "SELECT user_id AS key, event_id AS seq, 1::BIGINT AS weight FROM events"
WORDS = ("SELECT word AS key, 1::BIGINT AS weight FROM "
         "(SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> ''")
CUSTOMERS = "SELECT o_custkey AS key, o_orderkey AS seq, 1::BIGINT AS weight FROM orders"
AB = "CASE WHEN (seq // {block}) % 2 = 0 THEN 'A' ELSE 'B' END AS stream"
CUSTOMERS_AB = f"SELECT *, {AB.format(block=BLOCK)} FROM ({CUSTOMERS})"
USERS_AB = f"SELECT *, {AB.format(block=BLOCK)} FROM ({USERS})"
TRACE = """SELECT o_orderkey AS seq, o_custkey * u AS src_ip, o_orderkey % 1000 * u AS dst_ip,
 o_custkey % 1024 * u AS src_port, (CASE WHEN o_orderstatus = 'O' THEN 443 ELSE 80 END * u)::BIGINT AS dst_port,
 (CASE WHEN o_orderstatus = 'O' THEN 17 ELSE 6 END * u)::BIGINT AS proto,
 date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400.0::DOUBLE AS ts
 FROM (SELECT *, CASE WHEN o_custkey % 7 <> 0 THEN 1 ELSE 0 END::BIGINT AS u FROM orders)"""


def side_sql(streams: str, name: str) -> str:
    return f"SELECT key, weight FROM ({streams}) WHERE stream = '{name}'"


def counts_sql(stream: str) -> str:
    return f"SELECT key, sum(weight)::BIGINT AS f FROM ({stream}) GROUP BY key"

"""The driver's tables as events, metadata, splits and vocabulary, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events``: the user is the subject, type and ``k`` of the properties the code."""
    key = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("subject_id"), F.concat("event_type", F.lit("//"), key).alias("code")
    )


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines: the customer is the subject, the part the code, the return flag a modifier."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("subject_id"),
        F.concat(F.lit("PART//"), F.col("l_partkey").cast("string")).alias("code"),
        F.col("l_returnflag").alias("modifier"),
        "l_partkey",
    )


def brand_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines with brand and type of the part as code."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    lines = order_events(spark, folder)
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "subject_id", F.concat("p_brand", F.lit("//"), "p_type").alias("code"), "modifier"
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' market segments as splits."""
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("split"))


def part_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.concat(F.lit("PART//"), F.col("p_partkey").cast("string")).alias("code"),
        F.col("p_name").alias("description"),
        F.array("p_brand", "p_type").alias("parent_codes"),
    )


def med_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "med_events").select("subject_id", "code", "modifier")


def subject_splits(spark: SparkSession, folder: str) -> DataFrame:
    """One split per subject (of several the least name), as a catalog wants it."""
    return table(spark, folder, "subject_splits").groupBy("subject_id").agg(F.min("split").alias("split"))


def med_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Code metadata, of each (code, modifier) the row with the least entry id."""
    codes = table(spark, folder, "codes")
    kept = codes.groupBy("code", "modifier").agg(F.min("entry_id").alias("entry_id")).select("entry_id")
    return codes.join(kept, "entry_id", "left_semi").select("code", "modifier", "description", "parent_codes", "entry_id")


def concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary; a blank reason means valid, as in the tab-separated export."""
    rows = table(spark, folder, "concept")
    return rows.withColumn("invalid_reason", F.expr("nullif(invalid_reason, '')"))


def ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "concept_ancestor").drop("loaded_at")


#: The same views in SQL
STREAM = "SELECT user_id AS subject_id, event_type || '//' || json_extract_string(props, '$.k') AS code FROM events"
ORDERS = """SELECT o_custkey AS subject_id, 'PART//' || l_partkey AS code, l_returnflag AS modifier, l_partkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
BRANDS = f"""SELECT subject_id, p_brand || '//' || p_type AS code, modifier FROM ({ORDERS}) JOIN part ON p_partkey = l_partkey"""
SEGMENTS = "SELECT c_custkey AS subject_id, c_mktsegment AS split FROM customer"
PARTS = """SELECT 'PART//' || p_partkey AS code, p_name AS description, [p_brand, p_type] AS parent_codes
FROM part"""
MED = "SELECT subject_id, code, modifier FROM med_events"
MED_META = """SELECT code, modifier, description, parent_codes, entry_id FROM codes
WHERE entry_id IN (SELECT min(entry_id) FROM codes GROUP BY code, modifier)"""
MED_SPLITS = "SELECT subject_id, min(split) AS split FROM subject_splits GROUP BY subject_id"
CONCEPTS = "SELECT * REPLACE (nullif(invalid_reason, '') AS invalid_reason) FROM concept"

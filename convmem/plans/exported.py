"""Queries over conversations as an engine would export them: each one a JSON text in one of three forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.plans import bindings as B
from convmem.sources import exports as E

Q: dict = {}
SQL: dict[str, str] = {}


def exported(spark, sf_dir):
    """A list, an object with rows, or records by id, by the conversation's number; every eleventh is broken off, and every thirteenth holds a stray number."""
    rows = B.table(spark, sf_dir, "conversations")
    meta = F.struct(F.when(F.col("conv_id") % 2 == 0, "concluded").otherwise("open").alias("sceneStatus"), F.concat(F.lit("o"), F.floor(F.col("conv_id") / 5).cast("string")).alias("sceneOriginChatId"))
    record = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chatId"), F.when(F.col("conv_id") % 3 != 2, F.concat_ws("-", "conv_id", "turn")).alias("id"), "role", F.col("text").alias("content"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("createdAt"),
    )
    # As an object or as a string that holds one.
    json = F.to_json(record)
    with_meta = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"metadata":'), F.when(F.col("turn") % 2 == 0, F.to_json(meta)).otherwise(F.regexp_replace(F.to_json(F.array(F.to_json(meta))), r"^\[|\]$", "")), F.lit("}"))
    rows = rows.select("conv_id", "turn", json.alias("j"), meta.alias("m")).select("conv_id", "turn", with_meta.alias("r"))
    sorted_ = F.transform(F.sort_array(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"])
    by_id = F.transform(F.sort_array(F.collect_list(F.struct("turn", "r", "conv_id"))), lambda x: F.concat(F.lit('"'), F.concat_ws("-", x["conv_id"], x["turn"]), F.lit('":'), x["r"]))
    each = rows.groupBy("conv_id").agg(F.array_join(sorted_, ",").alias("list"), F.array_join(by_id, ",").alias("named"))
    stray = F.when(F.col("conv_id") % 13 == 0, F.lit(",7")).otherwise("")
    body = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("["), "list", stray, F.lit("]"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"table":"messages","rows":['), "list", stray, F.lit("]}"))).otherwise(F.concat(F.lit("{"), "named", F.lit("}")))
    broken = F.when(F.col("conv_id") % 11 == 0, F.expr("substring(b, 1, length(b) - 1)")).otherwise(F.col("b"))
    return each.withColumn("b", body).select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("source"), broken.alias("body"))


Q["io2_exported_messages"] = lambda s, d: E.messages(exported(s, d))
SQL["io2_exported_messages"] = "SELECT 'c' || conv_id AS chat_id, conv_id || '-' || turn AS id, role, text AS content, 't' || turn AS created_at FROM conversations WHERE conv_id % 11 <> 0"
Q["io2_exported_metadata"] = lambda s, d: E.records(exported(s, d)).select("source", E.field("createdAt").alias("created_at"), E.nested("metadata", "sceneStatus").alias("status"), E.nested("metadata", "sceneOriginChatId").alias("origin"))
SQL["io2_exported_metadata"] = "SELECT 'f' || conv_id AS source, 't' || turn AS created_at, CASE WHEN conv_id % 2 = 0 THEN 'concluded' ELSE 'open' END AS status, 'o' || (conv_id // 5) AS origin FROM conversations WHERE conv_id % 11 <> 0"
Q["io2_set_aside"] = lambda s, d: E.set_aside(exported(s, d))
SQL["io2_set_aside"] = """SELECT 'f' || conv_id AS source, 'no JSON' AS reason FROM conversations WHERE conv_id % 11 = 0 GROUP BY conv_id
UNION ALL SELECT 'f' || conv_id, 'record ' || count(*) || ' is no object' FROM conversations WHERE conv_id % 13 = 0 AND conv_id % 3 <> 2 AND conv_id % 11 <> 0 GROUP BY conv_id"""

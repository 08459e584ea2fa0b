"""Exported engine tables as JSON: a list of records, an object with ``rows``, or records by their id; read in one scan, without a schema.

A record's fields are taken from a variant, so records may differ, and a field may be an object or
an object written as a string. What is no JSON, or holds no records, is set aside with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records(exports: DataFrame) -> DataFrame:
    """(source, pos, key, record): every record of every export. exports: (source, body).

    ``key`` is the id under which the record stood, if it stood under one. Records that are no objects are left to ``set_aside``.
    """
    held = exports.select("source", F.try_parse_json("body").alias("v"))
    rows = F.expr("try_variant_get(v, '$.rows', 'variant')")
    own = F.when(F.schema_of_variant("v").startswith("OBJECT") & F.schema_of_variant(rows).startswith("ARRAY"), rows).otherwise(F.col("v"))
    spread = exports.sparkSession.sql("SELECT source, e.pos, e.key, e.value AS record FROM {held}, LATERAL variant_explode(own) AS e", held=held.where("v is not null").withColumn("own", own))
    return spread.where(F.schema_of_variant("record").startswith("OBJECT")).withColumn("pos", F.col("pos").cast("bigint"))


def set_aside(exports: DataFrame) -> DataFrame:
    """(source, reason) of exports that are no JSON or hold no records, and of records that are no objects."""
    held = exports.select("source", F.try_parse_json("body").alias("v"))
    kind = F.schema_of_variant("v")
    whole = held.where(F.col("v").isNull() | ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))).select("source", F.when(F.col("v").isNull(), "no JSON").otherwise("no records").alias("reason"))
    rows = F.expr("try_variant_get(v, '$.rows', 'variant')")
    own = F.when(kind.startswith("OBJECT") & F.schema_of_variant(rows).startswith("ARRAY"), rows).otherwise(F.col("v"))
    spread = exports.sparkSession.sql("SELECT source, e.pos, e.value AS record FROM {held}, LATERAL variant_explode(own) AS e", held=held.where("v is not null").withColumn("own", own))
    odd = spread.where(~F.schema_of_variant("record").startswith("OBJECT")).select("source", F.concat(F.lit("record "), F.col("pos").cast("string"), F.lit(" is no object")).alias("reason"))
    return whole.unionByName(odd)


def field(name: str, kind: str = "string", record: str = "record") -> Column:
    """A field of a record; null where it is absent or of another kind."""
    return F.try_variant_get(record, f"$.{name}", kind)


def nested(name: str, inner: str, kind: str = "string", record: str = "record") -> Column:
    """A field of an object in a record, which may also be written as a string."""
    direct = F.try_variant_get(record, f"$.{name}.{inner}", kind)
    written = F.try_variant_get(F.try_parse_json(F.try_variant_get(record, f"$.{name}", "string")), f"$.{inner}", kind)
    return F.coalesce(direct, written)


def messages(exports: DataFrame) -> DataFrame:
    """(chat_id, id, role, content, created_at) of exported messages; an id may be the key it stood under."""
    return records(exports).select(field("chatId").alias("chat_id"), F.coalesce(field("id"), "key").alias("id"), field("role").alias("role"), field("content").alias("content"), field("createdAt").alias("created_at"))


def chats(exports: DataFrame) -> DataFrame:
    """(chat_id, name, scene_status, origin_chat_id) of exported chats."""
    return records(exports).select(F.coalesce(field("id"), "key").alias("chat_id"), field("name").alias("name"), nested("metadata", "sceneStatus").alias("scene_status"), nested("metadata", "sceneOriginChatId").alias("origin_chat_id"))

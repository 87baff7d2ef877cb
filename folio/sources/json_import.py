"""JSON exports of users and namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files in a namespace's folder, and the table of each.
FILES = {
    "bookshelf": "books",
    "bookmark": "bookmarks",
    "replaceRule": "replace_rules",
    "txtTocRule": "txt_toc_rules",
    "httpTTS": "http_tts_list",
    "bookGroup": "book_groups",
    "userConfig": "user_config",
}


def users(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Users of a file that holds an array of them or an object by name."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", T.ArrayType(schema))
    named = F.map_values(F.from_json("value", T.MapType(T.StringType(), schema)))
    return raw.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(named)).alias("u")).select("u.*").where(F.col("username").isNotNull())


def namespaces(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """Rows of ``<root>/<namespace>/<name>.json`` of all namespaces, with the folder as ``user_namespace``."""
    rows = spark.read.schema(schema).json(f"{root}/*/{name}.json", multiLine=True)
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return rows.withColumn("user_namespace", folder)


def string_rules(rows: DataFrame, column: str) -> DataFrame:
    """Imported rows that have what makes them usable."""
    return rows.where(F.col(column).isNotNull())


def config_values(c):
    """A config's object, unwrapped from ``{"config": {...}}`` where it is."""
    inner = F.get_json_object(c, "$.config")
    return F.when(inner.startswith("{"), inner).otherwise(c)

"""Map-shaped JSON documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.columns import nonblank


def explode_json_map(docs: DataFrame, body: str = "body") -> DataFrame:
    """(…, map_key, map_value) per entry of {"mappings": {k: v}} or of a bare {k: v} document.

    Values are JSON text for objects and plain text for strings and numbers.
    """
    top = F.from_json(F.col(body), "map<string,string>")
    inner = F.from_json(F.try_element_at(top, F.lit("mappings")), "map<string,string>")
    keep = [c for c in docs.columns if c != body]
    return docs.select(*keep, F.explode(F.coalesce(inner, top)).alias("map_key", "map_value"))


def value_field(value: Column, *fields: str) -> Column:
    """First non-empty of the fields if the value is an object, else the value itself."""
    found = [nonblank(F.get_json_object(value, f"$.{f}")) for f in fields]
    return F.when(value.startswith("{"), F.coalesce(*found)).otherwise(value)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the JSON map documents under a path."""
    return explode_json_map(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))


def variant_map(entries: DataFrame) -> DataFrame:
    """Mapping entries: a plain text is the price key, an object has price key and confirmation."""
    value = F.col("map_value")
    return entries.select(
        F.col("map_key").alias("variant_key"), value_field(value, "priceKey").alias("price_key"),
        F.when(value.startswith("{"), F.get_json_object(value, "$.confirmedBy")).alias("confirmed_by"))


def image_signatures(entries: DataFrame) -> DataFrame:
    """Signature-cache entries: text, or an object with one of three field names."""
    return entries.select(F.col("map_key").alias("url"), value_field(F.col("map_value"), "dhash", "imageHash", "hash").alias("signature"))

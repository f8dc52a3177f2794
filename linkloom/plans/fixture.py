"""Business records derived from the documents table, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.normalize import normalize
from linkloom.session import spread

SUFFIXES = [" Pvt Ltd", " Inc.", " LLC", " Corp", ""]


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    t = spread(d.select("doc_id", "lang", F.slice(words, 1, 12).alias("t")))
    zip_ = 10000 + F.aggregate(F.slice("t", 1, 12), F.lit(0).cast("long"), lambda a, x: a * 7 + F.length(x)) % 80000
    land = F.when(F.col("lang") == "fr", "France").when(F.col("lang") == "en", "US").when(F.col("lang") == "es", "India").otherwise("Germany")
    tail = (
        F.when(F.col("lang") == "en", F.concat(F.lit(" St. TX "), zip_.cast("string")))
        .when(F.col("lang") == "es", F.concat(F.lit(" Rd "), (zip_ + 400000).cast("string")))
        .otherwise(F.concat(F.lit(" Ave "), zip_.cast("string")))
    )
    end = F.get(F.array(*(F.lit(s) for s in SUFFIXES)), (F.col("doc_id") % 5).cast("int"))
    return t.select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.concat(F.array_join(F.slice("t", 1, 4), " "), end).alias("business_name"),
        F.concat(F.array_join(F.slice("t", 5, 8), " "), tail).alias("business_address"),
        land.alias("country"),
        F.col("doc_id").alias("ord"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(raw_entities(spark, sf_dir))


def source(e: DataFrame, k: int) -> DataFrame:
    return e.filter(F.col("entity_id").startswith(f"S{k}-"))


RAW_SQL = """raw AS (
    SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id,
        array_to_string(t[1:4], ' ') || ([' Pvt Ltd', ' Inc.', ' LLC', ' Corp', ''])[1 + doc_id % 5] AS business_name,
        array_to_string(t[5:12], ' ') || CASE lang WHEN 'en' THEN ' St. TX ' || zip WHEN 'es' THEN ' Rd ' || (zip + 400000) ELSE ' Ave ' || zip END AS business_address,
        CASE lang WHEN 'fr' THEN 'France' WHEN 'en' THEN 'US' WHEN 'es' THEN 'India' ELSE 'Germany' END AS country, doc_id AS ord
    FROM (SELECT *, 10000 + list_reduce(list_prepend(0::BIGINT, list_transform(t[1:12], lambda x: length(x))), lambda a, x: a * 7 + x) % 80000 AS zip
        FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS t FROM documents)))"""

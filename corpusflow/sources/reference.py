"""Reference data: category documents and the region table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.basic import col

CATEGORY_SCHEMA = (
    "category string, typical_products array<string>, "
    "core_machines array<struct<name:string,purpose:string,typical_cost_usd:double>>, "
    "process_flow array<string>, utilities array<string>, compliance array<string>"
)


def category_slug(category: Column | str) -> Column:
    return F.replace(F.lower(F.trim(col(category))), F.lit(" "), F.lit("_"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, keyed by its file name."""
    docs = spark.read.schema(CATEGORY_SCHEMA).option("multiLine", True).json(path)
    return docs.withColumn("slug", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def attach_reference(requests: DataFrame, categories: DataFrame, regions: DataFrame) -> DataFrame:
    """Left-join both references; what is missing stays NULL, rows never go.

    No broadcast hint: the optimizer broadcasts by measured size.
    """
    keyed = requests.withColumn("slug", category_slug("category"))
    return keyed.join(categories.drop("category"), "slug", "left").join(regions, "region", "left")


def machine_rows(categories: DataFrame) -> DataFrame:
    return categories.select("slug", F.explode("core_machines").alias("m")).select("slug", "m.*")

"""The five tables as Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pictorium import schema

TABLES = {"directories": schema.DIRECTORIES, "images": schema.IMAGES, "duplicates": schema.DUPLICATES, "people": schema.PEOPLE, "faces": schema.FACES}


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(kind).parquet(f"{root}/{name}") for name, kind in TABLES.items()}


def save(tables: dict[str, DataFrame], root: str) -> None:
    """Writes a new version of the tables. `root` must not be the folder that they are read from."""
    for name, rows in tables.items():
        if name not in TABLES:
            raise ValueError(f"no such table: {name}")
        rows.write.mode("overwrite").parquet(f"{root}/{name}")


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], kind) for name, kind in TABLES.items()}

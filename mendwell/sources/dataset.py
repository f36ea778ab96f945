"""Load datasets, typed or as raw text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.functions.text import canonical_value
from mendwell.spec import Dataset, TableSpec


def read_table(
    spark: SparkSession, path: str, file_format: str = "parquet", schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    reader = spark.read.format(file_format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load_dataset(
    spark: SparkSession,
    folder: str,
    specs: Mapping[str, TableSpec] | Iterable[TableSpec],
    file_format: str = "parquet",
    suffix: str | None = None,
    views: bool = False,
    **options: str,
) -> Dataset:
    """Open the tables of a folder, one file or directory per table.

    With ``views`` each becomes a temporary view as well.
    """
    by_name = dict(specs) if isinstance(specs, Mapping) else {spec.name: spec for spec in specs}
    ending = f".{file_format}" if suffix is None else suffix
    tables = {
        name: read_table(spark, f"{folder.rstrip('/')}/{name}{ending}", file_format, **options) for name in by_name
    }
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return Dataset(tables, by_name)


def load_jdbc(
    spark: SparkSession,
    url: str,
    specs: Iterable[TableSpec],
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> Dataset:
    """Open tables of a database; with bounds each is read in ranges."""
    by_name = {spec.name: spec for spec in specs}
    tables = {}
    for spec in by_name.values():
        reader = spark.read.format("jdbc").options(url=url, dbtable=spec.name, **options)
        if partition_column and bounds:
            reader = reader.options(
                partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
            )
        tables[spec.name] = reader.load()
    return Dataset(tables, by_name)


def raw_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as text, whatever they hold: the layer dirty values live in."""
    types = {field.name: field.dataType for field in df.schema.fields}
    return df.withColumns({name: canonical_value(F.col(name), types[name]) for name in columns})


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns in their types again; what does not parse becomes NULL."""
    return df.withColumns({name: F.col(name).try_cast(dtype) for name, dtype in types.items()})

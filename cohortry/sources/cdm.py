"""The clinical tables as a bundle of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from cohortry.schemas import CLINICAL


class Cdm:
    """Clinical and vocabulary tables by name: ``cdm["condition_occurrence"]``.

    A table may be given as a DataFrame or as a function without arguments that
    returns one; functions are called at first use.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self.spark = spark
        self._tables = dict(tables)

    @classmethod
    def parquet(cls, spark: SparkSession, root: str) -> Cdm:
        """Tables stored as ``<root>/<table>`` parquet folders.

        The schema is given, so nothing is inferred and only the listed columns
        are ever read.
        """
        return cls(spark, {name: _parquet_reader(spark, f"{root}/{name}", ddl) for name, ddl in CLINICAL.items()})

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, schema: str, properties: Mapping[str, str], parts: int = 64,
             person_ids: tuple[int, int] | None = None) -> Cdm:
        """Tables of a relational database, read in ``parts`` ranges of person id."""
        return cls(
            spark,
            {name: _jdbc_reader(spark, url, f"{schema}.{name}", ddl, properties, parts, person_ids)
             for name, ddl in CLINICAL.items()},
        )

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def with_tables(self, **tables: DataFrame) -> Cdm:
        """Copy in which the given tables are replaced."""
        return Cdm(self.spark, {**self._tables, **tables})


def _parquet_reader(spark, path, ddl):
    return lambda: spark.read.schema(ddl).parquet(path)


def _jdbc_reader(spark, url, table, ddl, properties, parts, person_ids):
    def read():
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
        if person_ids is not None and "person_id" in ddl:
            reader = reader.options(partitionColumn="person_id", lowerBound=person_ids[0],
                                    upperBound=person_ids[1], numPartitions=parts)
        names = [column.split()[0] for column in ddl.split(",")]
        return reader.load().select(*names)

    return read

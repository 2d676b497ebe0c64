"""The list of contract queries: a Spark plan and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortry.session import fit_tasks, prepare, shared_folder
from contract import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``plan(source)`` under ``name``; ``oracle`` may use all views by name."""

    def register(plan: Callable[[Source], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            fit_tasks(prepare(spark), [f"{sf_dir}/{table}.parquet" for table in views.BASE])
            return plan(Source(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = _attach(oracle)
        return plan

    return register


def _attach(oracle: str) -> str:
    """Put the views in front; a query's own ``with`` joins the same list."""
    text = oracle.strip()
    if text.lower().startswith("with "):
        return f"{views.sql_prelude()},\n{text[5:]}"
    return f"{views.sql_prelude()}\n{text}"


class Source:
    """The given tables of one scale, seen in the ways the queries need."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.cdm = views.cdm(spark, sf_dir)
        self.measured = views.measured_cdm(spark, sf_dir)
        self._sf_dir = sf_dir

    @property
    def staging(self) -> DataFrame:
        return views.staging(self.spark, self._sf_dir)

    def view(self, name: str) -> DataFrame:
        return views.view(self.spark, self._sf_dir, name)

    def scratch(self) -> str:
        """A new folder that all executors can see."""
        return f"{shared_folder(self.spark)}/contract-{uuid.uuid4().hex}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._sf_dir}/{name}.parquet")

"""One small local session for all tests, and frames from rows written by hand."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortry import Cdm, session  # noqa: E402
from cohortry.schemas import TABLES  # noqa: E402
from cohortry.session import small_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
        # Compiling code for a handful of rows takes longer than interpreting it.
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    })
    yield spark
    spark.stop()


@pytest.fixture
def frame(spark):
    """``frame("person", (1, 1960, 8532, 0), ...)``: rows of a known table or of a DDL string."""
    return lambda table, *rows: small_table(spark, rows, TABLES.get(table, table))


@pytest.fixture
def bundle(spark, frame):
    """A Cdm whose unnamed tables are empty."""

    def build(**rows):
        known = {name: frame(name, *rows.get(name, ())) for name in TABLES if name not in ("ledger",)}
        return Cdm(spark, known)

    return build


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *columns):
    """Rows of some columns (all by default), sorted."""
    found = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in found.collect()), key=lambda r: [(v is None, str(v)) for v in r])

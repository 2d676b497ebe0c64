"""What a task holds does not grow with the tables: shuffles have partitions by the size of the input."""

from __future__ import annotations

import importlib

from contract import registry

# The package has a function of the same name.
session = importlib.import_module("cohortry.session")

PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_partitions_follow_the_input(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for size in (0, 1 << 30, 6 << 30):
        monkeypatch.setattr(session, "stored_bytes", lambda *_, size=size: size)
        session.fit_tasks(spark, ["/nowhere"])
        found.append(int(spark.conf.get(PARTS)))
        assert spark.conf.get(MERGED) == str(session.TASK_BYTES)
    assert found == [least, 128, 768]


def test_stored_bytes_of_files_and_folders(spark, tmp_path):
    (tmp_path / "one.parquet").write_bytes(b"x" * 100)
    (tmp_path / "two.parquet").mkdir()
    (tmp_path / "two.parquet" / "part").write_bytes(b"x" * 50)
    assert session.stored_bytes(spark, [f"{tmp_path}/{n}.parquet" for n in ("one", "two", "none")]) == 150


def test_every_query_bounds_its_tasks(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registry, "fit_tasks", lambda _, paths: asked.extend(paths))
    registry.QUERIES["d11_drug_era_events"](spark, "/root/testdata/sf0.001")
    assert "/root/testdata/sf0.001/lineitem.parquet" in asked

"""Rendezvous shards and dated URL lists."""

from __future__ import annotations

import datetime as dt
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from cohortry.llm import sharding, url_filters


def test_shards_are_gapless_and_stable(documents):
    docs = documents(*[(i, f"text {i % 50}") for i in range(400)], (None, None), (None, None), (7, "text 7"), (401, ""))
    placed = sharding.shard_documents(docs, [1.0] * 4, [1.0] * 5).collect()
    assert len(placed) == 404
    for shard in range(4):
        slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in placed)
    assert 0 < sum(r["grown_shard"] == 4 for r in placed) < 160
    by_id = {r["doc_id"]: r for r in placed}
    assert by_id[12]["size"] == 8 and by_id[12]["text_crc32"] == zlib.crc32(b"text 12")
    assert by_id[None]["size"] == 1 and by_id[None]["text_crc32"] == 0
    again = sharding.shard_documents(docs.repartition(7), [1.0] * 4, [1.0] * 5).collect()
    assert Counter(again) == Counter(placed)


def test_weights_share_rows(documents):
    docs = documents(*[(i, "x") for i in range(3000)])
    counts = Counter(r["shard"] for r in sharding.shard_documents(docs, [1.0, 3.0, 0.0]).collect())
    assert counts[2] == 0 and 0.70 < counts[1] / 3000 < 0.80


def test_empty_table(documents):
    assert sharding.shard_documents(documents(), [1.0, 1.0]).collect() == []


def url(spark, *values):
    return spark.createDataFrame(pa.table({"url": pa.array(values, pa.string())}))


def test_url_keys(spark):
    rows = url(spark, "HTTP://user@WWW.A.example.COM:80/x/y?q#f", "nothing", None, "http://h").select(
        url_filters.url_keys(F.col("url")).alias("k")).collect()
    assert sorted(rows[0]["k"]) == sorted(["com", "example.com", "a.example.com", "a.example.com/", "a.example.com/x/", "a.example.com/x/y"])
    assert rows[1]["k"] is None and rows[2]["k"] is None
    assert sorted(rows[3]["k"]) == ["h", "h/"]


def test_deep_paths_and_long_hosts_have_all_keys(spark):
    host, parts = ".".join(f"h{i}" for i in range(12)), [f"p{i}" for i in range(12)]
    keys = set(url(spark, f"http://{host}/{'/'.join(parts)}/page").select(url_filters.url_keys(F.col("url")).alias("k")).first()["k"])
    labels = host.split(".")
    assert keys == ({".".join(labels[i:]) for i in range(12)} | {"/".join([host, *parts[:i]]) + "/" for i in range(13)}
                    | {f"{host}/{'/'.join(parts)}/page"})


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_lists_as_of_the_fetch(spark):
    change = pa.schema([("list", pa.string()), ("key", pa.string()), ("at", pa.date32()), ("listed", pa.bool_())])
    rows = [("ads", "b.com", day(10), True), ("ads", "b.com", day(10), False), ("ads", "b.com", day(12), True), ("ads", "b.com", day(20), False),
            ("bad", "a.b.com/x/", day(0), True), ("bad", "a.b.com/x/", day(0), True), (None, "b.com", day(0), True), ("off", "b.com", day(1), False)]
    changes = spark.createDataFrame(pa.Table.from_pylist([dict(zip(change.names, r)) for r in rows], schema=change))
    seen = pa.schema([("n", pa.int64()), ("url", pa.string()), ("fetched", pa.date32()), ("lists", pa.string())])
    captures = [(1, "http://a.b.com/y", day(9)), (2, "http://a.b.com/y", day(10)), (3, "http://a.b.com/y", day(19)), (4, "http://a.b.com/y", day(20)),
                (5, "http://a.b.com/x/z", day(15)), (6, "http://cb.com/", day(15)), (7, None, day(15)), (8, "http://a.b.com/y", None),
                (2, "http://a.b.com/y", day(10))]
    table = spark.createDataFrame(pa.Table.from_pylist([dict(zip(seen.names, (*r, "own"))) for r in captures], schema=seen))
    found = sorted((r["n"], tuple(r["lists"]), r["blocked"]) for r in url_filters.filter_urls(table, changes).collect())
    assert found == [(1, (), False), (2, ("ads",), True), (2, ("ads",), True), (3, ("ads",), True), (4, (), False), (5, ("ads", "bad"), True),
                     (6, (), False), (7, (), False), (8, (), False)]
    assert url_filters.filter_urls(table.limit(0), changes).count() == 0
    assert url_filters.filter_urls(table, changes.limit(0)).where("blocked").count() == 0

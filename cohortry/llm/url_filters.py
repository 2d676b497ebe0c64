"""Dated URL lists: changes become validity intervals, captures meet them as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and a leading ``www.``; null where there is none."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(F.rtrim(host, F.lit("."))), r"^www\.", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query and fragment, ``/`` where it is empty."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_keys(url: Column) -> Column:
    """All list keys that cover a URL: every parent domain, and the host with every leading part of its path.

    ``a.b.c/x/y`` gives ``a.b.c``, ``b.c``, ``c``, ``a.b.c/``, ``a.b.c/x/`` and
    ``a.b.c/x/y``: one key per label and per slash, so the URL's own length bounds them.
    """
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    parts = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    keys = F.array_distinct(F.concat(domains, F.array(host), prefixes, F.array(F.concat(host, path))))
    return F.when(host.isNotNull(), keys)


def validity(changes: DataFrame) -> DataFrame:
    """Intervals ``(list, key, valid_from, valid_to)`` in which a key was on a list.

    ``changes(list, key, at, listed)`` says that from ``at`` on the key is (true)
    or is not (false) on the list. Several changes at one time: listing wins.
    Null keys, lists and times are dropped; ``valid_to`` is exclusive, null
    while the entry stands. Repeated statements change nothing.
    """
    once = (changes.where("list is not null and key is not null and at is not null and listed is not null")
            .groupBy("list", "key", "at").agg(F.bool_or("listed").alias("listed")))
    along = Window.partitionBy("list", "key").orderBy("at")
    turns = once.withColumn("was", F.lag("listed").over(along)).where("listed <> coalesce(was, false)")
    return (turns.withColumn("valid_to", F.lead("at").over(along)).where("listed")
            .select("list", "key", F.col("at").alias("valid_from"), "valid_to"))


def as_of_verdicts(captures: DataFrame, intervals: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """``(url, at, lists, blocked)`` per distinct (URL, time): lists with an entry that held then.

    Captures are reduced to distinct (key, time) before they meet the
    intervals, so a host with a third of all captures is looked up once for each of
    its keys and days. ``lists`` is sorted.
    """
    keyed = (captures.select(F.col(url).alias("_url"), F.col(at).alias("_at")).distinct()
             .withColumn("key", F.explode(url_keys(F.col("_url")))))
    looked = keyed.select("key", "_at").distinct().join(intervals, "key")
    looked = looked.where("_at >= valid_from and (valid_to is null or _at < valid_to)").select("key", "_at", "list").distinct()
    found = keyed.join(looked, ["key", "_at"])
    return found.groupBy("_url", "_at").agg(F.array_sort(F.collect_set("list")).alias("lists"))


def filter_urls(captures: DataFrame, changes: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """Add ``lists`` (those that held the URL when it was fetched, sorted, maybe empty) and ``blocked``.

    URLs without a host, null URLs and null times are on no list. Repeated
    captures all stay. Own columns named ``lists`` or ``blocked`` are replaced.
    """
    verdicts = as_of_verdicts(captures, validity(changes), url, at)
    kept = captures.drop("lists", "blocked")
    joined = kept.join(verdicts, (kept[url] == verdicts["_url"]) & (kept[at] == verdicts["_at"]), "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    return joined.select(*[kept[c] for c in kept.columns], lists.alias("lists"), (F.size(lists) > 0).alias("blocked"))

"""The corpus queries the driver can call, with their SQL counterparts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import (
    decontamination, hnsw_dedup, html_template, language_id, minhash_dedup, packing, piece_chunks, prefix_trie,
    sharding, toxicity, url_filters, vector_codes, warc,
)
from cohortry.llm.common import Scratch, held_out, table
from cohortry.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = lambda spark, sf_dir: plan(prepare(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


@query("op1_rendezvous_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on eight equal shards by doc_id, and where they go when there are nine."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)
    return placed.withColumn("law", F.lit("key"))


# Days of the captures and of the list changes, derived from the pages.
_FIRST_DAY, _DAYS = "2024-01-01", 730


def _day(number) -> F.Column:
    return F.date_add(F.lit(_FIRST_DAY).cast("date"), number.cast("int"))


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated changes of six lists over the hosts and paths of the pages.

    Two of three hosts are listed twice for a time, and some parents of hosts once; every
    page's address stands on a takedown list for 45 days, and the directory of every fifth
    page on a section list for 120.
    """
    seen = pages.select("page_id", url_filters.url_host(F.col("url")).alias("host"), url_filters.url_path(F.col("url")).alias("path"))
    hosts = seen.where("host is not null").groupBy(F.col("host").alias("key")).agg(F.min("page_id").alias("n")).where("n % 3 <> 0 or key like 'blog.%'")
    kind = F.element_at(F.array(F.lit("ads"), F.lit("spam"), F.lit("adult")), (F.col("n") % 3 + 1).cast("int"))
    turns = [(F.col("n") * 37 % 365, True), (F.col("n") * 37 % 365 + 90 + F.col("n") % 60, False), (F.col("n") * 37 % 365 + 250, True)]
    spans = [(F.col("page_id") * 13 % _DAYS, True), (F.col("page_id") * 13 % _DAYS + 45, False)]
    by_host = hosts.select(kind.alias("list"), "key", F.inline(F.array(*[F.struct(_day(d).alias("at"), F.lit(on).alias("listed")) for d, on in turns])))
    by_page = seen.where("host is not null").select(
        F.lit("takedown").alias("list"), F.concat("host", "path").alias("key"),
        F.inline(F.array(*[F.struct(_day(d).alias("at"), F.lit(on).alias("listed")) for d, on in spans])))
    directory = F.concat("host", F.regexp_extract("path", "^(.*/)", 1))
    by_directory = seen.where("host is not null and page_id % 5 = 0").select(
        F.lit("section").alias("list"), directory.alias("key"),
        F.inline(F.array(*[F.struct(_day(d).alias("at"), F.lit(on).alias("listed"))
                           for d, on in ((F.col("page_id") * 29 % _DAYS, True), (F.col("page_id") * 29 % _DAYS + 120, False))])))
    parent = F.array_join(F.slice(F.split("key", r"\."), -2, 2), ".")
    by_parent = hosts.where("n % 4 = 1 and size(split(key, '[.]')) > 2").select(
        F.lit("network").alias("list"), parent.alias("key"), _day(F.col("n") * 11 % _DAYS).alias("at"), F.lit(True).alias("listed"))
    return by_host.unionByName(by_page).unionByName(by_directory).unionByName(by_parent)


_OP2_SQL = r"""
with seen as (
  select page_id, url, date '2024-01-01' + cast(page_id % 730 as integer) as fetched,
    nullif(regexp_replace(lower(rtrim(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.')), '^www\.', ''), '') as host,
    case when regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) = '' then '/'
      else regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) end as path
  from pages),
hosts as (select host, min(page_id) as n from seen where host is not null group by host
  having min(page_id) % 3 <> 0 or host like 'blog.%'),
changes as (
  select case n % 3 when 0 then 'ads' when 1 then 'spam' else 'adult' end as kind, host as entry,
    date '2024-01-01' + cast(d as integer) as since, listed
  from (select host, n, n * 37 % 365 as d, true as listed from hosts
    union all select host, n, n * 37 % 365 + 90 + n % 60, false from hosts
    union all select host, n, n * 37 % 365 + 250, true from hosts)
  union all
  select 'takedown', host || path, date '2024-01-01' + cast(page_id * 13 % 730 as integer), true from seen where host is not null
  union all
  select 'takedown', host || path, date '2024-01-01' + cast(page_id * 13 % 730 + 45 as integer), false from seen where host is not null
  union all
  select 'section', host || regexp_extract(path, '^(.*/)', 1), date '2024-01-01' + cast(page_id * 29 % 730 as integer), true from seen where host is not null and page_id % 5 = 0
  union all
  select 'section', host || regexp_extract(path, '^(.*/)', 1), date '2024-01-01' + cast(page_id * 29 % 730 + 120 as integer), false from seen where host is not null and page_id % 5 = 0
  union all
  select 'network', array_to_string(string_split(host, '.')[-2:], '.'), date '2024-01-01' + cast(n * 11 % 730 as integer), true from hosts where n % 4 = 1 and len(string_split(host, '.')) > 2),
daily as (select kind, entry, since, bool_or(listed) as listed from changes group by kind, entry, since),
keyed as (
  select distinct page_id, fetched, unnest(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[len(string_split(host, '.')) - i + 1:], '.'))
    || [host]
    || list_transform(range(1, len(string_split(path, '/'))), lambda i: host || array_to_string(string_split(path, '/')[1:i], '/') || '/')
    || [host || path]) as entry
  from seen where host is not null),
latest as (
  select k.page_id, d.kind, d.entry, arg_max(d.listed, d.since) as listed
  from keyed k join daily d on d.entry = k.entry and d.since <= k.fetched group by k.page_id, d.kind, d.entry),
held as (select page_id, string_agg(distinct kind, ',' order by kind) as lists from latest where listed group by page_id)
select s.page_id, s.url, s.fetched, coalesce(h.lists, '') as lists, h.lists is not null as blocked
from seen s left join held h using (page_id)
"""


@query("op2_dated_url_lists", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the lists as they were on the day of its fetch."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", _day(F.col("page_id") % _DAYS))
    judged = url_filters.filter_urls(captures, list_changes(pages))
    return judged.select("page_id", "url", "fetched", F.array_join("lists", ",").alias("lists"), "blocked")


def language_profiles(spark: SparkSession, sf_dir: str) -> dict:
    """Prototypes from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.learn_prototypes(docs.where(~held_out("doc_id")))


@query("op3_language_profiles")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by its nearest profile."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = language_id.identify_languages(docs, language_profiles(spark, sf_dir))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


# A document is called toxic from this score on.
TOXIC = 0.7


def toxicity_network(spark: SparkSession, sf_dir: str) -> toxicity.Network:
    """Trained on the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return toxicity.learn_toxicity(table(spark, sf_dir, "documents"), labels)


@query("op4_recurrent_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, the highest of all its windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_network(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"))


@query("op5_warc_salvage")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    scratch = Scratch(spark)
    path = f"{scratch.root}/warc"
    warc.write_archives(table(spark, sf_dir, "pages"), path, scratch)
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    found = warc.read_archives(spark, path, payloads=False).where("kind = 'record'")
    return found.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences of at most 4096 ids; only lengths and checksums are shuffled."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.cut_documents(docs, emit=["ids_crc32"])
    packed = packing.pack_pieces(pieces, Scratch(spark))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op7_string_tiling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document's tiles cover at least half the item."""
    leaked = decontamination.leaked_items(table(spark, sf_dir, "benchmark"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", leaked.alias("leaks"))
    return docs.select("doc_id", F.inline("leaks"))


@query("op8_site_template_removal")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_template.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_minhash_components")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a similarity of 0.85."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op10_hnsw_components")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings with a cosine of 0.9 or more."""
    return hnsw_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


@query("op11_active_lloyd_codes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors under codebooks trained by active-entry Lloyd rounds."""
    return vector_codes.code_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark))


@query("op12_distinct_chunk_pieces")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document with an end id, and what they decode to, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    emit = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return piece_chunks.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), emit).select("doc_id", *emit)


# CRC-32 (reflected polynomial 0xEDB88320) of a short ASCII text, by a table of all bytes.
_OP13_SQL = r"""
with recursive step(i, n, v) as (
  select i, 0, cast(i as bigint) from range(256) r(i)
  union all select i, n + 1, case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end from step where n < 8),
bytes as (select list(v order by i) as tab from step where n = 8),
own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null),
conv as (
  select conv_id, count(*) as n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda a, b: xor(any_value(tab)[(xor(a, b) & 255) + 1], a >> 8))) % 4 as h
  from own, bytes group by conv_id),
rebuilt as (
  select c.conv_id, o.k as d, o.role, o.text from conv c join own o on o.conv_id = c.conv_id - c.conv_id % 20 and o.k <= c.h
  union all
  select c.conv_id, least(c.h, coalesce(b.n, 0)) + o.k - c.h, o.role, o.text
  from conv c join own o on o.conv_id = c.conv_id and o.k > c.h left join conv b on b.conv_id = c.conv_id - c.conv_id % 20),
sequence as (
  select c.conv_id, coalesce(list(md5(len(r.role) || ':' || r.role || r.text) order by r.d) filter (where r.d is not null), []) as s,
    coalesce(list(len(regexp_extract_all(r.text, '[^\x20\x09-\x0D]+')) order by r.d) filter (where r.d is not null), []) as w
  from conv c left join rebuilt r on r.conv_id = c.conv_id group by c.conv_id),
prefix as (
  select conv_id, d, d = len(s) as ends, md5(array_to_string(s[1:d], '')) as p, md5(array_to_string(s[1:d - 1], '')) as up, case when d > 0 then w[d] else 0 end as words
  from (select conv_id, s, w, unnest(range(len(s) + 1)) as d from sequence) x),
node as (
  select d, p, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from prefix group by d, p),
kids as (select d - 1 as d, up as p, count(*) as n from node where d > 0 group by all),
tree as (
  select a.d, a.p, sum(v.saved) as saved_tokens, count(*) filter (where k.n is null) as n_leaves
  from node v left join kids k on k.d = v.d and k.p = v.p join prefix a on a.conv_id = v.conv_id and a.d <= v.d group by a.d, a.p)
select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, t.n_leaves, cast(t.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from node n join tree t on t.d = n.d and t.p = n.p left join kids k on k.d = n.d and k.p = n.p
left join node u on n.d > 0 and u.d = n.d - 1 and u.p = n.up
"""


@query("op13_conversation_trie", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of the conversations, after each took its first turns from another."""
    own = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.branched(own), Scratch(spark))

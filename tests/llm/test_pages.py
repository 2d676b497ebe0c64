"""Main text of pages, and archives: round trips and damage."""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import time
import uuid

import pyarrow as pa
import pytest

from cohortry.llm import html_template as h
from cohortry.llm import warc
from cohortry.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def pages(spark, *rows):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("text", pa.string())])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, (*r, "own"))) for r in rows], schema=schema))


def test_given_pages(spark):
    source = spark.read.parquet(f"{SF}/pages.parquet")
    for r in h.main_text(source).collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b<b>c</b>\n d</p>", "a\nbc d"), ("<div>x<div>y</div>z</div>", "x\ny\nz"),
    ("<article><p>in</p><aside>no</aside><div class='user-comments'><p>no</p></div></article><p>out", "in"),
    ("<nav>m</nav><header>h</header><main><header><h1>T</h1></header><p>&eacute;&nbsp;x</main><footer>f", "T\né x"),
    ("<script>if (a<b) '</p>'</script><p>1 < 2 <!-- <p>no --> 3<style>p{}</style>", "1 < 2 3"),
    ("<p>a<br>b</p><ul><li>c<li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a b\nc\nd\ne f\ng"),
    ("<p>open <b>bold <i>deep", "open bold deep"), ("<p hidden>no</p><p style='display:none'>no</p><p>yes", "yes"),
    ("<form>no</form></p></div><p title='a>b'>yes<!-- cut", "yes"), ("<div class=shadow>yes</div><div class='ad-box'>no</div>", "yes"),
    ("<article><p>one</article><article class=comment>no</article><article>two</article>", "one\ntwo"),
])
def test_extract(page, text):
    assert h.extract(page, frozenset()) == text


@pytest.mark.parametrize("page, text", [
    ("<body class='has-sidebar'><p>yes</body>", "yes"), ("<html id=no-sidebar><body class='ad-free'><p>yes", "yes"),
    ("<article class='post has-share'><p>yes</article><p>out", "yes"), ("<body class=ads><main class=search><p>yes</main>", "yes"),
    ("<div class='content with-social'><p>yes</div>", "yes"), ("<div class=sidebar><article><p>yes</article></div>", "yes"),
    ("<p class=pre-ad-block>yes</p><div class='sidebar left'>no</div><div id=cookieBanner>no</div><p role=navigation>no", "yes"),
    ("<article><p>long main story</article><div class=related><article>teaser</article></div>", "long main story"),
])
def test_layout_names_remove_no_article(page, text):
    assert h.extract(page, frozenset()) == text


def test_template_of_a_site_goes(spark):
    frame = "<div><p>Welcome to our site</p></div><section><p>{}</p></section><div>All rights kept</div>"
    rows = [(i, f"http://a.org/{i}", frame.format(f"article number {i}")) for i in range(12)]
    rows += [(i, f"http://b{i}.org/", frame.format(f"article number {i}")) for i in range(20, 24)] + [(30, None, None), (0, "http://a.org/0", rows[0][2])]
    found = sorted((r["page_id"], r["text"]) for r in h.main_text(pages(spark, *rows)).collect())
    assert [t for i, t in found if i < 12] == [f"article number {max(i - 1, 0)}" for i in range(13)]
    assert all(t.startswith("Welcome") for i, t in found if 20 <= i < 24) and found[-1] == (30, "")
    assert h.main_text(pages(spark)).collect() == []


@pytest.mark.parametrize("most", [0, 200_000])
def test_template_does_not_depend_on_the_size_of_the_host(spark, monkeypatch, most):
    monkeypatch.setattr(h, "BROADCAST_ROWS", most)
    rows = [(i, f"http://a.org/{i}", f"<p>page {i}</p>" + ("<div>winter notice</div>" if i < 5 else "<div>rare</div>" if i < 9 else "")) for i in range(100)]
    rows += [(i, "http://b.org/", "<p>b</p><div>winter notice</div>") for i in range(100, 104)] + [(104, "http://a.org/x", None), (3, *rows[3][1:])]
    found = sorted((r["page_id"], r["text"]) for r in h.main_text(pages(spark, *rows)).collect())
    wanted = [(i, f"page {i}" + ("\nrare" if 5 <= i < 9 else "")) for i in range(100)] + [(3, "page 3"), (104, "")]
    assert found == sorted(wanted + [(i, "b\nwinter notice") for i in range(100, 104)])


def test_copied_articles_are_no_template(spark):
    rows = [(i, f"http://a.org/{i}", f"<article><p>the same story</p><ul><li><a href=/>all links</a></ul></article><div>{i}</div>") for i in range(20)]
    assert {r["text"] for r in h.main_text(pages(spark, *rows)).collect()} == {"the same story"}


def test_a_copied_page_keeps_its_text(spark):
    """Equal pages count once; and no recurrence takes all text of a page."""
    equal = [(i, f"http://a.org/{i}", "<div><p>the only story</p></div>") for i in range(9)]
    copies = [(20 + i, f"http://b.org/{i}", f"<nav>menu {i}</nav><div><p>a story</p><p>told by many</p><ul><li><a href=/>links everywhere</a></ul></div>") for i in range(9)]
    found = {r["page_id"]: r["text"] for r in h.main_text(pages(spark, *equal, *copies)).collect()}
    assert {found[i] for i in range(9)} == {"the only story"}
    assert {found[i] for i in range(20, 29)} == {"a story\ntold by many"}


def test_template_counts_are_those_of_distinct_contents(spark):
    source = spark.read.parquet(f"{SF}/pages.parquet").select("url", "html").unionByName(spark.read.parquet(f"{SF}/pages.parquet").select("url", "html"))
    seen = {(h_, page) for h_, page in ((re.sub(r"^www\.", "", re.search("//([^/]+)", r["url"])[1].lower()), r["html"]) for r in source.collect())}
    counts = {}
    for host, page in seen:
        for code in {c for c, _ in h.subtree_hashes(h.parse(page)).values()}:
            counts[host, code] = counts.get((host, code), 0) + 1
    wanted = {key for key, n in counts.items() if n >= h.TEMPLATE_PAGES}
    assert wanted and {tuple(r) for r in h.site_templates(source).collect()} == wanted


@pytest.mark.parametrize("tag", ["div", "b", "font", "p", "li", "article", "table"])
def test_any_depth(spark, tag):
    begin = time.time()
    deep = f"<{tag}>" * 100_000 + "deep down"
    assert h.extract(deep, frozenset([1])) == "deep down"
    assert h.extract(deep + f"</{tag}>" * 100_000 + "<hr></u>" * 1000, frozenset()) == "deep down"
    assert time.time() - begin < 20


@pytest.mark.parametrize("page, text", [
    ("<p title=it's>One</p><p>Two don't Three</p><p>Four", "One\nTwo don't Three\nFour"),
    ("<p title='a>b' class = \"x>y\" data-x=1>in", "in"), ("<p title='never closed>One</p><p>Two", "One\nTwo"),
    ("<p>One</p><p never closed", "One\n<p never closed"), ("a < b <3 </ > c", "a < b <3 c"),
])
def test_quotes_hold_values_only(page, text):
    assert h.extract(page, frozenset()) == text


@pytest.mark.parametrize("piece", ["<a '", "<a x='", "<a x=\"y' ", "<!-", "<p>it's ", "</x ", "<script>'</script ", "<a x='>'", "< "])
def test_a_megabyte_of_anything_takes_a_second(piece):
    begin = time.time()
    h.parse(piece * (1_000_000 // len(piece)))
    assert time.time() - begin < 5


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 80
    rows = [(5, "http://a/1", long), (3, "http://a/2\r\nX: y", long), (9, "http://a/3", long), (1, "u", "short"), (2, "u", "short"), (4, None, None), (6, "u", ""),
            (9, "http://a/3", long), (7, "u", "WARC/1.1\r\n\r\n" * 20)]
    path = str(tmp_path / uuid.uuid4().hex)
    warc.write_archives(pages(spark, *rows), path, Scratch(spark))
    found = warc.read_archives(spark, path).collect()
    assert {r["kind"] for r in found} == {"record"} and len(found) == len(rows)
    by_id = {int(r["record_id"].split(":")[-1]): r for r in found}
    payloads = {r[0]: (r[2] or "").encode() for r in rows}
    for i, r in by_id.items():
        assert r["payload_bytes"] == len(payloads[i]) and r["payload_digest"] == hashlib.sha256(payloads[i]).hexdigest()
        assert r["record_type"] == ("revisit" if i in (5, 9) else "response") and r["refers_to"] == ("urn:page:3" if i in (5, 9) else None)
        assert r["payload"] == (None if i in (5, 9) else payloads[i])
    empty = str(tmp_path / uuid.uuid4().hex)
    warc.write_archives(pages(spark), empty, Scratch(spark))
    assert warc.read_archives(spark, empty).collect() == []


def records(n):
    body = [f"payload {i} ".encode() * (i + 3) for i in range(n)]
    return [warc.encode_record(f"urn:page:{i}", f"http://x/{i}", b, hashlib.sha256(b).hexdigest()) for i, b in enumerate(body)]


def salvaged(data):
    ids, gaps = [], []
    for found in warc.salvage(data):
        if isinstance(found, warc.Gap):
            gaps.append(found)
        else:
            number = found.headers["warc-record-id"].strip("<>").split(":")[-1]
            ids.append(int(number) if number.isdecimal() else None)
    return ids, gaps


@pytest.mark.parametrize("pack", [lambda r: r, lambda r: gzip.compress(r, mtime=0)])
def test_salvage_after_damage(pack):
    parts = [pack(r) for r in records(6)]
    clean = b"".join(parts)
    assert salvaged(clean) == (list(range(6)), [])
    start, end = len(b"".join(parts[:2])), len(b"".join(parts[:3]))
    for at in range(start, end, 7):
        broken = bytearray(clean)
        broken[at] ^= 0xFF
        ids, gaps = salvaged(bytes(broken))
        # A field of the header that is not checked may come back changed; nothing else may.
        assert [i for i in ids if i in (0, 1, 3, 4, 5)] == [0, 1, 3, 4, 5] and len(ids) in (5, 6)
        if len(ids) == 5:
            assert [(g.offset, g.end) for g in gaps] == [(start, end)] or any(g.inside == start for g in gaps)
    assert salvaged(clean[:start] + b"garbage \n" + clean[start:])[0] == list(range(6))
    assert salvaged(clean[:start + 20])[0] == [0, 1] and salvaged(clean[:start + 20])[1][0].offset == start
    assert salvaged(clean[:start] + clean[start + 30:])[0] == [0, 1, 3, 4, 5]
    assert salvaged(b"") == ([], [])


def test_members_and_plain_records_alternate():
    parts = records(4)
    data = parts[0] + gzip.compress(parts[1]) + b"\x00\x1f\x8b\x08junk" + parts[2] + gzip.compress(parts[3])
    ids, gaps = salvaged(data)
    assert ids == [0, 1, 2, 3] and gaps

"""The operators on pages and conversations."""

import collections
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_format, html_extract, url_filter, warc
from quillspark.llm.shared import Workspace, table

# HTML extraction

ARTICLE = "<article class='post-12'><h1>Title &amp; more</h1><p><b>Bold<br>next  line<p>Second &eacute;&nbsp;x &lt;b&gt;</p><script>no()</script><ul><li>one<li>two</ul></article>"
TEXT = "Title & more Bold next line Second é x <b> one two"
PAGE = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Head</header><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div>{ARTICLE}<div id='comments'><p>A very long comment by a reader that goes on and on and on for ever.</p></div><aside>Side</aside><form>Send</form><div class='cookie-notice'>Notice</div><footer>&copy; Foot</footer></body></html>"


def extracted(spark, *rows, **options):
    df = spark.createDataFrame([(n, u, h, "x") for n, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string")
    return [r["text"] for r in html_extract.extract_pages(spark, df, **options).orderBy("page_id").collect()]


def test_extraction(spark):
    url = "http://h/a"
    rows = [(url, PAGE), (url, None), (url, ""), (None, PAGE), (url, "plain text &lt; markup"), (url, "<p>unclosed <b>bold"), (url, "<div class=ad>only an advert</div>"), (url, PAGE.replace("<article", "<section").replace("</article", "</section"))]
    for options in ({}, {"broadcast_hosts": 0}):
        assert extracted(spark, *rows, **options) == [TEXT, "", "", TEXT, "plain text < markup", "unclosed bold", "", TEXT]


def test_what_marks_boilerplate():
    text = lambda raw: html_extract.extract(html_extract.parse(raw), None)
    article = "<article><h1 class='post-header'>Title</h1><p>The text.</p></article>"
    assert text(f"<div class='layout has-sidebar'>{article}<section class='comments2'><article><p>No.</p></article></section><article class='comment'><p>Much longer words than the article has.</p></article><div role='search'>Find</div></div>") == "Title The text."


def test_consensus(spark):
    # The host's pages agree on div.text; one page has a longer list elsewhere, which doesn't win there.
    usual = "<body><div class='text'><p>%s</p></div><div class='x'><p>short</p></div></body>"
    odd = "<body><div class='text'><p>the article of this page is brief but real</p></div><div class='list'><p>%s</p></div></body>" % ("something else entirely " * 5)
    rows = [("http://h/%d" % n, usual % ("words of the article " * 10)) for n in range(9)] + [("http://h/odd", odd)]
    assert extracted(spark, *rows)[-1] == "the article of this page is brief but real"
    assert extracted(spark, ("http://other/odd", odd))[-1].startswith("something else")


def test_all_containers_of_the_path(spark):
    half, menu = "words of one half " * 50, "<div><a href='/'>Home and more</a></div>"
    apart = f"<body><div class=content>{half}</div><div class=ad>Buy</div><div class=content>Second {half}</div></body>"
    unequal = f"<body>{menu}<div>Short start.</div><div>{half}</div><div>{half[:180]}</div></body>"
    both = f"{half}Second {half}".strip()
    rows = [("http://h/1", apart), ("http://g/1", unequal), (None, "<body>%s</body>" % "".join(f"<article><p>{n} {half}</p></article>" for n in range(3)))]
    found = extracted(spark, *rows)
    assert found[0] == both and found[1] == f"Short start. {half}{half[:180]}".strip() and found[2] == " ".join(f"{n} {half}".strip() for n in range(3))
    # On a page that falls back to its own path, too.
    usual = [("http://f/%d" % n, f"<body><div class='text'>{half}</div></body>") for n in range(5)]
    assert extracted(spark, *usual, ("http://f/odd", apart))[-1] == both


@pytest.mark.parametrize("raw", ["<", "<a", "<p <p>x", "<script>", "<!-- open", "</p></div>", "<div" * 200, "<a href=\"" * 50, "&#xZZ; &unknown;", "<p>" * 3000])
def test_broken_markup(raw):
    html_extract.extract(html_extract.parse(raw), None)


@pytest.mark.parametrize("raw", ["<a " * 1_700_000, "<div>" * 100_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "</x></p></li>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<p title=\"" * 200_000, "<!--" * 500_000, "<li><p>" * 100_000, "<table><td>" * 50_000 + "</div>" * 50_000, "&amp" * 500_000, "<h1 class=nav>" * 50_000])
def test_hostile_markup_takes_linear_time(raw):
    import time

    began = time.perf_counter()
    html_extract.ballot(html_extract.parse(raw))
    html_extract.extract(html_extract.parse(raw), None)
    assert time.perf_counter() - began < 10


def test_memory_of_deep_pages():
    import tracemalloc

    tracemalloc.start()
    peaks = []
    for depth in (2000, 8000):
        tracemalloc.reset_peak()
        html_extract.parse("<div>" * depth + "x")
        peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert peaks[1] < 8 * peaks[0]


def text_of(raw):
    return html_extract.extract(html_extract.parse(raw), None)


LONG = " ".join(f"sentence {n} of the article," for n in range(30))


@pytest.mark.parametrize("raw,expected", [
    (f"<article><div class='paywall'><h1>Title</h1><p>{LONG}</p></div></article>", f"Title {LONG}"),
    (f"<body class='has-sidebar'><div class='sidebar-left'><h1>Title</h1><p>{LONG}</p></div></body>", f"Title {LONG}"),
    (f"<article><p>{LONG}</p><div class='search'>How the search went on.</div></article>", f"{LONG} How the search went on."),
    (f"<article><p>{LONG}</p><svg><path d=''><p>After the drawing.</p></article>", f"{LONG} After the drawing."),
    (f"<article><p>{LONG}</p><select><option>one<p>After the choices.</p></article>", f"{LONG} After the choices."),
    (f"<article><p>As <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, {LONG}</p></article>", f"As x=1 holds, {LONG}"),
    (f"<article><p>{LONG}</p><svg><title>No</title><text>no</text></svg><p>On.</p></article>", f"{LONG} On."),
    (f"<body><div class=a>{LONG}</div><div class=b>{LONG[:600]}</div></body>", f"{LONG} {LONG[:600]}".strip()),
    (f"<head><title>No</title><p>{LONG}", LONG.strip()),
    (f"<article><p>{LONG}</p><div class='share'>Share</div><div class='related'><article>Teaser</article></div><div class='ad'>Buy</div></article><div id=comments><h1>Readers</h1>{LONG * 9}</div>", LONG.strip()),
    (f"<div><table><tr><td>{LONG}</div>more</td></tr></table></div>", f"{LONG}more"),
    (f"<article><p>{LONG} a < b && c > d <3</p></article>", f"{LONG} a < b && c > d <3"),
    (f"<article><p title='a > b' class=x>{LONG}</p><p hidden>no</p><p style='display: none'>no</p></article>", LONG.strip()),
    (f"<article><noscript>no</noscript><p>{LONG}<textarea>no</textarea><br/>end</article>", f"{LONG} end"),
])
def test_what_is_the_article(raw, expected):
    assert text_of(raw) == expected


def test_hosts_agree_on_what_repeats(spark):
    page = "<body><article><p>%s</p><div class='disclaimer'>%s</div></article></body>"
    rows = [(f"http://same/{n}", page % (f"{n} {LONG}", "Nobody is liable for this.")) for n in range(6)] + [(f"http://own/{n}", page % (f"{n} {LONG}", f"A disclaimer that is the story of case {n}.")) for n in range(6)]
    found = extracted(spark, *rows)
    assert found[:6] == [f"{n} {LONG}" for n in range(6)]
    assert found[6:] == [f"{n} {LONG} A disclaimer that is the story of case {n}." for n in range(6)]


TEMPLATES = [
    "<html><body><div id='page'><div class='nav'><a href=/>Home</a></div><div class='post'><h2>{t}</h2>{p}</div><div class='sidebar'>See also</div></div></body></html>",
    "<body><header><h1>Site</h1></header><main><h1>{t}</h1>{p}</main><footer>Foot</footer></body>",
    "<body><table><tr><td width=20%><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><td><h1>{t}</h1>{p}</table></body>",
    "<body><div class=w1><div class=w2><section class='entry-content'><h1>{t}</h1>{p}</section></div></div><div class='cookie-notice'>We use cookies on this site.</div></body>",
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_pages_of_several_templates(spark, template):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(rng.choice(["stone", "river", "tall", "walk", "green", "seven", "under"], n))
    made = [(words(5), [words(int(rng.integers(20, 80))) for _ in range(3)]) for _ in range(8)]
    rows = [(f"http://h/{n}", template.format(t=t, p="".join(f"<p>{x}</p>" for x in ps))) for n, (t, ps) in enumerate(made)]
    assert extracted(spark, *rows) == [" ".join([t, *ps]) for t, ps in made]


def test_every_page_of_the_tables(spark, small):
    import html
    import re

    found = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark, table(spark, small, "pages")).collect()}
    for page in table(spark, small, "pages").collect():
        inside = re.search("<article>(.*?)</article>", page["html"], re.S)[1].replace("<b>", "")
        blocks = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:h1|p|br)>", inside)]
        assert found[page["page_id"]] == " ".join(b for b in blocks if b)


# URL filters


@pytest.mark.parametrize("url,expected", [
    ("http://WWW.A.Org/x?y#z", ("www.a.org", "/x", "org/", "allow")), ("https://m.example.org/es/1", ("m.example.org", "/es/1", "example.org/es/", "block")),
    ("https://example.org/en/123", ("example.org", "/en/123", "example.org/en/1", "block")), ("https://notexample.org/es/1", ("notexample.org", "/es/1", "org/", "allow")),
    ("http://x.com/de/", ("x.com", "/de/", "com/de/", "block")), ("http://x.com?u=http://a.org/", ("x.com", "", None, None)), ("http://a.org", ("a.org", "", None, None)),
    ("a.org/x", ("", "", None, None)), (None, ("", "", None, None)), ("", ("", "", None, None)), ("x://Ä.ORG/p\nq", ("Ä.org", "/p\nq", "org/", "allow")),
])
def test_rules(spark, url, expected):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    r = url_filter.url_filter(spark, df).first()
    assert (r["host"], r["path"], r["rule"]) == expected[:3]
    assert r["verdict"] == (expected[3] or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_url_model_held_out(spark):
    urls = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    labelled = url_filter.labelled_by_rules(urls.select("url"), url_filter.RULES).withColumn("held", F.pmod(F.xxhash64("url"), F.lit(4)) == 0)
    no_rules = url_filter.url_filter(spark, urls, rules=(), labelled=labelled.where("NOT held").select("url", "label"))
    truth = labelled.where("held").select("url", "label").distinct()
    right = no_rules.join(urls, "page_id").join(truth, "url").agg(F.avg(((F.col("verdict") == "block").cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.9


def test_the_sample_is_bounded(spark):
    known = spark.range(30_000).select(F.concat(F.lit("http://h/"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))).alias("url"), F.lit(1).alias("label")).repartition(40)
    found = url_filter.bounded_sample(known, 1000)
    assert 500 < found.count() <= 1000 and found.distinct().count() == found.count()
    assert url_filter.bounded_sample(known, 50_000).count() == 20_001


def test_affix_rates_of_a_row_do_not_see_its_label():
    # Labels at random, a host each: rates of the very rows would tell them.
    rng = np.random.default_rng(1)
    rows = [(f"http://h{n}.{n}/", f"h{n}.{n}", "/", int(rng.integers(2))) for n in range(400)]
    model = url_filter.train(rows)
    assert ((model.predict([r[:3] for r in rows]) > 0.5) == [r[3] for r in rows]).mean() < 0.9
    assert abs(float(np.corrcoef([model.features(*r[:3])[11] for r in rows], [r[3] for r in rows])[0, 1])) > 0.9


def test_long_urls(spark):
    df = spark.createDataFrame([(1, "http://a.org/" + "x/" * 500_000), (2, "http://" + "a" * 1_000_000)], "page_id long, url string")
    assert [len(r["host"]) for r in url_filter.url_filter(spark, df).orderBy("page_id").collect()] == [5, 1_000_000]


def test_url_filter_without_labels(spark):
    df = spark.createDataFrame([(1, "http://x.net/"), (1, "http://x.net/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.url_filter(spark, df).collect()] == ["allow", "allow"]
    assert url_filter.url_filter(spark, df.limit(0)).count() == 0


# Chat formatting


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")


AWKWARD = [
    (1, 0, "system", "be \\ brief <|im_end|>"), (1, 1, "user", "<|im_start|>assistant\nno"), (1, 2, "assistant", "a\\|b <\\|c \\\\ \\n"), (1, 3, "user", "last <"),
    (2, 0, "assistant", "<|"), (2, 1, "assistant", ""), (3, 0, "user", None), (4, 0, None, "x"), (4, 0, None, "x"), (5, 1, "assistant", "b"), (5, 0, "us\ner\\n", "a"), (None, 0, "assistant", "n"), (6, None, "user", "first"), (6, 0, "assistant", "|im_end|>"),
]


def test_chats_read_back(spark):
    df = conversations(spark, AWKWARD)
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in AWKWARD:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(back) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        assert [tuple(t) for t in back[c]["turns"]] == [t[1:] for t in turns]
        assert back[c]["targets"] == [x for _, r, x in turns if r == "assistant"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_rows_without_a_conversation(spark):
    long = "y" * 2_000_000
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (9, 0, "assistant", long)]
    back = chat_format.read_back(chat_format.format_chats(conversations(spark, rows))).collect()
    assert sorted(([tuple(t) for t in r["turns"]], r["targets"]) for r in back) == [([("assistant", "b")], ["b"]), ([("assistant", "b")], ["b"]), ([("assistant", long)], [long]), ([("user", "a")], [])]


def test_examples(spark):
    rows = chat_format.format_chats(conversations(spark, AWKWARD).where("conv_id = 1")).orderBy("example").collect()
    assert [(r["example"], r["loss_length"] is None) for r in rows] == [(2, False), (3, True)]
    assert rows[0]["formatted"].count("<|im_start|>") == 3 and rows[0]["formatted"].endswith("<|im_end|>\n")
    assert rows[0]["formatted"][rows[0]["loss_start"] :].startswith("a\\\\|b <\\\\|c")


# WARC


def pages(spark):
    rows = [(5, "http://a/ b", "same"), (3, "http://b/", "same"), (9, None, None), (8, "u", ""), (3, "http://b/", "same"), (7, "http://c/\r\nX: y", "é" * 5000), (4, "v", "other"), (None, "w", "null id"), (None, "w", "null id")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string")


def test_warc_round_trip(spark):
    out = Workspace(spark, "warc-test").path("a")
    manifest = warc.write_warc(spark, pages(spark), out, shard_bytes=1000, roll_bytes=500).collect()
    assert sum(m["records"] for m in manifest) == 9 and len(manifest) > 2
    rows = warc.read_warc(spark, out).collect()
    found = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
    assert found == collections.Counter([(3, "response", None, 4), (3, "revisit", 3, 4), (5, "revisit", 3, 4), (8, "response", None, 0), (9, "revisit", 8, 0), (7, "response", None, 10000), (4, "response", None, 5), (None, "response", None, 7), (None, "revisit", None, 7)])
    assert {r["payload"].decode() for r in rows if r["payload"] is not None} == {"same", "", "é" * 5000, "other", "null id"}
    assert {r["payload_digest"] for r in rows if r["page_id"] == 4} == {warc.base32(hashlib.sha1(b"other").hexdigest())}


def test_warc_is_deterministic_and_checked(spark):
    ws = Workspace(spark, "warc-test")
    one, two = ws.path("a"), ws.path("b")
    same = [[(r["file"], r["sha256"], r["bytes"]) for r in warc.write_warc(spark, p, out).orderBy("file").collect()] for p, out in ((pages(spark), one), (pages(spark).repartition(3), two))]
    assert same[0] == same[1]
    path = f"{one.removeprefix('file://')}/{same[0][0][0]}"
    data = open(path, "rb").read()
    assert hashlib.sha256(data).hexdigest() == same[0][0][1]
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 10 and b"%0D%0AX:%20y" in text
    open(path, "wb").write(gzip.compress(text.replace(b"other", b"0ther")))
    with pytest.raises(Exception):
        warc.read_warc(spark, one).collect()


def test_shards_are_even(spark):
    # Ids of very uneven distances, 3,000 shards wanted.
    ids = F.when(F.col("id") % 10 == 0, F.col("id") * 1_000_003).otherwise(F.col("id"))
    df = spark.range(9000).select(ids.alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.lpad("id", 6, "0")).alias("html"))
    digests = df.select("page_id", F.sha1("html").alias("sha1"), F.length("html").cast("long").alias("n"))
    ws = Workspace(spark, "warc-test")
    bounds = warc.shard_bounds(ws, digests, 36, 16_384)
    assert 2800 < len(bounds) + 1 <= 3000 and warc.shard_bounds(ws, digests.repartition(5), 36, 16_384) == bounds
    sizes = collections.Counter(warc.bisect_right(bounds, (True, r["page_id"], r["sha1"])) for r in digests.collect())
    assert max(sizes.values()) <= 3 * 9000 / 3000 and len(sizes) == len(bounds) + 1
    assert len(warc.shard_bounds(ws, digests, 36, 7)) + 1 in (6, 7)


def test_one_hot_page_id(spark):
    df = spark.range(400).select(F.lit(7).cast("long").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id") % 300).alias("html"))
    out = Workspace(spark, "warc-test").path("a")
    manifest = warc.write_warc(spark, df, out, shard_bytes=500).collect()
    assert len({m["shard"] for m in manifest}) > 4 and sum(m["records"] for m in manifest) == 400
    assert sorted(r["count"] for r in warc.read_warc(spark, out).groupBy("record_type").count().collect()) == [100, 300]


def test_string_ids_and_long_payloads(spark):
    df = spark.createDataFrame([("a:b", "u", "x" * 9_000_000), ("null", "u", "y"), (None, "u", "z"), ("é c", "u", "y")], "page_id string, url string, html string")
    out = Workspace(spark, "warc-test").path("a")
    warc.write_warc(spark, df, out)
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(spark, out, "string").collect()}
    assert found == {"a:b": ("response", None, 9_000_000), "null": ("response", None, 1), None: ("response", None, 1), "é c": ("revisit", "null", 1)}


def test_what_failed_attempts_left_goes(spark):
    import os

    out = Workspace(spark, "warc-test").path("a")
    os.makedirs(out.removeprefix("file://"))
    open(out.removeprefix("file://") + "/_temporary-99-shard-00000-0000.warc.gz", "wb").close()
    warc.write_warc(spark, pages(spark), out)
    assert not [f for f in os.listdir(out.removeprefix("file://")) if f.startswith("_temporary")]


def test_small_payloads_can_be_left_alone(spark):
    out = Workspace(spark, "warc-test").path("a")
    warc.write_warc(spark, pages(spark), out, min_bytes=6)
    assert warc.read_warc(spark, out).where("record_type = 'revisit'").count() == 1


def test_empty_archive(spark):
    out = Workspace(spark, "warc-test").path("a")
    assert warc.write_warc(spark, pages(spark).limit(0), out).count() == 0
    assert warc.read_warc(spark, out).count() == 0

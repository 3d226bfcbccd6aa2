import json
import os
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from textmap.operators import posts as po
from textmap.operators import som
from textmap.operators import summaries as sm
from textmap.operators import web
from textmap.operators.html import elements
from textmap.session import staging_root
from textmap.sources import sinks
from textmap.streaming import streams as st

PAGES = [
    (1, "http://news.example.org/a/article/2015/07/23/one.html",
     '<article><h1> One </h1><p class="sign"><time itemprop="datePublished" datetime="2015-07-23T10:00:00+02:00">x</time></p>'
     '<div id="articleBody"><p class="z">Hi <a href="/b">there</a><!-- no --></p><script>x()</script><H2>Sub</H2></div></article>'),
    (2, "http://news.example.org/two", '<article><h1>Two</h1><div id="articleBody"><p>b</p></div></article>'),
    (3, "http://news.example.org/three", '<article><h1>A</h1><h1>B</h1><div id="articleBody"><p>b</p></div></article>'),
    (4, "http://news.example.org/four", '<article><h1>Four</h1><div id="articleBody">  </div></article>'),
    (5, "http://news.example.org/five", "<p>nothing</p>"),
]
PAGE_SCHEMA = "page_id long, url string, html string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, PAGE_SCHEMA)


def test_article_fields(spark):
    got = {r["doc_id"]: r for r in web.articles(pages(spark), web.FieldPatterns(), ("title", "body")).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1]["title"] == "One"
    assert got[1]["timestamp"] == datetime(2015, 7, 23, 10)
    assert got[1]["body"] == "<p>Hi there</p> x() <H2>Sub</H2>"  # children are hits of their own
    assert got[2]["timestamp"] is None
    assert got[3]["title"] == "A B"


DIV = web.Path((web.Step("div", (("id", "articleBody"),)),), "children")


@pytest.mark.parametrize("html, path, expected", [
    # children end where their own end tag stands; own text of the body is none of them
    ('<div id="articleBody">x<p>one</p><div>two <div>in</div></div><p>three</p></div><p>no</p>', DIV,
     ["<p>one</p>", "<div>two <div>in</div></div>", "<p>three</p>"]),
    # a block ends an open paragraph, an end tag ends what is open inside it, the page ends the rest
    ("<div class=z id='articleBody'><p>a<p>b <b>c</p><ul><li>d</ul>e</div>", DIV, ["<p>a", "<p>b <b>c</p>", "<ul><li>d</ul>"]),
    ("<div id=articleBody><section><p>x", DIV, ["<section><p>x"]),
    ("<div id=articleBody></b><br><img alt='a>b'/><i/></div>", DIV, ["<br>", "<img alt='a>b'/>", "<i/>"]),
    ('<div id="other"><p>x</p></div><div data-id="articleBody" title="id=articleBody"><p>y</p></div>', DIV, []),
    # own text of each h1 right below an article
    ("<article><h1>A</h1><h1><em>B</em></h1><div><h1>C</h1></div><H1 class=x> D <i>i</i>E</H1></article><h1>F</h1>",
     web.FieldPatterns().title, ["A", " D ", "E"]),
    ("<article><!-- <h1>no</h1> --><script>'<h1>no</h1>'</script><h1>1 < 2 &amp;&lt; 3</h1></article>",
     web.FieldPatterns().title, ["1 < 2 &< 3"]),
    # attributes in any order and quoting
    ("<time datetime='2015' class=\"a>b\" itemprop=datePublished>x</time><time itemprop='other' datetime='2016'></time>"
     "<TIME itemprop=\"datePublished\">y</TIME><time itemprop='datePublished' DATETIME=2017 />",
     web.FieldPatterns().timestamp, ["2015", "2017"]),
    ("", DIV, []), ("<", DIV, []), ("<p <p> <", DIV, []), (None, DIV, None),
])
def test_elements_by_nesting(spark, html, path, expected):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(elements(F.col("html"), [path])[0]).first()[0] == expected


def test_elements_of_nested_hits_keep_their_order(spark):
    html = "<div id='articleBody'><div id='articleBody'><p>a</p></div><p>b</p></div>"
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(elements(F.col("html"), [DIV])[0]).first()[0] == ["<div id='articleBody'><p>a</p></div>", "<p>a</p>", "<p>b</p>"]


def test_elements_of_long_and_deep_pages(spark):
    deep = "<div id=articleBody>" + "<b>" * 800 + "x" + "</b>" * 800 + "<p>y</p>" * 500 + "</div>"
    odd = "<div id=articleBody><p title='" + "q" * 200_000 + "'>" + "a < b " * 20_000 + "</p></div>"
    df = spark.createDataFrame([(1, deep), (2, odd)], "k int, html string")
    found = {r[0]: r[1] for r in df.select("k", elements(F.col("html"), [DIV])[0]).collect()}
    assert len(found[1]) == 501 and found[1][0].count("</b>") == 800
    assert found[2] == [odd.removeprefix("<div id=articleBody>").removesuffix("</div>")]


def test_several_hits_are_joined(spark):
    html = spark.createDataFrame([("<h1> A </h1><h1>B</h1>",)], "html string")
    assert html.select(web.field(F.col("html"), r"<h1>(.*?)</h1>")).first()[0] == "A B"


def test_rejects_name_the_missing_fields(spark):
    _, rejects = web.split_complete(web.extract_fields(pages(spark), web.FieldPatterns()), ("title", "timestamp", "body"))
    got = {r["doc_id"]: r["missing"] for r in rejects.collect()}
    assert got == {2: ["timestamp"], 3: ["timestamp"], 4: ["timestamp", "body"], 5: ["title", "timestamp", "body"]}


@pytest.mark.parametrize("text, expected", [
    ("<p>a<b>c</b></p>", "<p>ac</p>"),
    ("<strong class='x'>a</strong><STRONG>b</STRONG>", "<strong>a</strong><STRONG>b</STRONG>"),
    ("<pre>a</pre><emph>b</emph>", "ab"),
    ("a<!-- <p> \n -->b", "ab"),
    ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
    ("<br/>x<img src='a>b'>", "xb'>"),
])
def test_sanitize(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(web.sanitize(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("url, expected", [
    ("http://x.org/p", "http://x.org/p"),
    ("mailto:a@b", "mailto:a@b"),
    ("//cdn.org/x", "https://cdn.org/x"),
    ("/root", "https://e.org/root"),
    ("leaf", "https://e.org/a/leaf"),
    ("#top", "https://e.org/a/page?q=1#top"),
    ("?q=2", "https://e.org/a/page?q=2"),
])
def test_absolute_links(spark, url, expected):
    df = spark.createDataFrame([(url, "https://e.org/a/page?q=1#frag")], "u string, b string")
    assert df.select(web.absolute(F.col("u"), F.col("b"))).first()[0] == expected


def test_frontier(spark):
    links = (
        '<a href="/article/2015/07/23/new.html">a</a><a href="/other">b</a>'
        '<a href="http://else.com/article/2015/07/23/x">c</a><a href="/article/2015/07/23/new.html#part">d</a>'
        '<a href="/article/2014/01/01/known.html?utm_source=feed">e</a>'
    )
    table = pages(spark, [(1, "http://e.org/", links), (2, "http://e.org/article/2014/01/01/known.html", "")])
    got = [r["url"] for r in web.frontier(table, domains=["e.org"]).collect()]
    assert got == ["http://e.org/article/2015/07/23/new.html"]
    assert web.links(table).count() == 5


def test_domains_match_whole_names(spark):
    table = spark.createDataFrame([(u,) for u in ("http://e.org/", "http://a.e.org/", "http://note.org/", "http://E.org:80/")], "url string")
    assert sorted(r["url"] for r in web.allowed_domains(table, ["e.org"]).collect()) == ["http://E.org:80/", "http://a.e.org/", "http://e.org/"]


def test_post_rules(spark):
    when, long = datetime(2024, 1, 1), "x" * 256
    rows = [
        (1, "BlogPost", when, "t", "s", "b", None, None, None, {}, []),
        (2, "Quote", when, None, long, "", None, None, long, None, [(when, "", "me"), (None, "b", long)]),
        (3, "Image", None, "t", "s", None, None, long, None, None, None),
        (4, "Video", when, "t", "s", None, None, None, None, None, None),
    ]
    got = sorted(tuple(r) for r in po.violations(spark.createDataFrame(rows, po.POST_SCHEMA)).collect())
    assert got == [
        (2, "author", "max_length"), (2, "body", "required"), (2, "comments.author", "max_length"),
        (2, "comments.body", "required"), (2, "comments.created_at", "required"), (2, "slug", "max_length"),
        (2, "title", "required"), (3, "created_at", "required"), (3, "image_url", "max_length"), (4, "embed_code", "required"),
    ]


def test_post_pages(spark):
    rows = [(i, datetime(2024, 1, 1 + i // 2), f"t{i}") for i in range(10)]
    posts = spark.createDataFrame(rows, "doc_id long, created_at timestamp, title string")
    assert [r["doc_id"] for r in po.list_posts(posts, 1, 4).collect()] == [4, 5, 2, 3]
    assert po.get_post(posts, 3).first()["title"] == "t3"


def test_upsert_replaces_adds_and_keeps(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, kept int")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    got = sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect())
    assert got == [(1, "a", 1), (2, None, 2), (3, "c", None)]


def test_posts_by_title_use_the_first_post(spark):
    posts = spark.createDataFrame([(5, "t"), (2, "t"), (3, "u")], "doc_id long, title string")
    titled = spark.createDataFrame([(8, "t", 1), (9, "t", 4)], "doc_id long, title string, node int")
    got = {r["doc_id"]: r["node"] for r in sinks.posts_with_nodes_by_title(posts, titled).collect()}
    assert got == {2: 4, 3: None, 5: None}


def test_article_pages_hold_every_document_of_a_hot_node(spark):
    assigned = spark.range(1000).selectExpr("id AS doc_id", "if(id < 900, 1, 2) AS node")
    found = sm.article_pages(assigned, 100).collect()
    assert sorted(i for r in found for i in r["articles"]) == list(range(1000))
    assert max(len(r["articles"]) for r in found) < 200
    assert sum(1 for r in found if r["node"] == 1) > 4


def test_session_round_trip(spark, tmp_path):
    codebook = spark.createDataFrame([(0, [0.1, 0.9]), (1, [0.7, 0.2])], "node int, vec array<double>")
    assigned = spark.createDataFrame([(10, 0), (11, 0)], "doc_id long, node int")
    comps = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.1), (1, 1, 0.3)], "topic_id int, term_id int, weight double")
    terms = spark.createDataFrame([("aa", 0), ("bb", 1)], "term string, term_id int")
    session = sinks.session_tables("r1", datetime(2024, 1, 1), codebook, assigned, comps, terms, (1, 2), 1, 2)
    path = str(tmp_path / "s")
    sinks.write_session(session, path)
    sinks.write_session(session, path)
    assert sinks.read_table(spark, f"{path}/nodes").count() == 4
    folded = sinks.fold_session(session)
    first = folded.first()
    assert [n["id"] for n in first["nodes"]] == [0, 1]
    assert first["nodes"][0]["topics"][0]["topic_id"] == 1
    # asking for more tokens than there are gives all of them
    assert [t["name"] for t in first["topics"][0]["tokens"]] == ["aa", "bb"]
    assert sinks.session_node(folded, 1).first()["node"]["article_hits"] == 0
    assert sinks.session_node(folded, 9).count() == 0


def test_top_documents_break_ties_by_id(spark):
    rows = [(i, [1.0 if i % 2 else 0.5, float(i)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(7)
    got = sm.top_documents(vectors, 2, 3).orderBy("topic_id", "rank").collect()
    assert [r["doc_id"] for r in got] == [1, 3, 5, 39, 38, 37]
    assert sm.top_documents(vectors, 2, 100).count() == 80


def test_latest_run_and_histogram(spark):
    runs = spark.createDataFrame([("a", 2), ("b", 5), ("c", 3)], "run string, timestamp int")
    assert sm.latest_run(runs).first()["run"] == "b"
    even = spark.createDataFrame([(1, 0), (2, 1)], "doc_id int, node int")
    assert [tuple(r) for r in sm.hits_histogram(even).collect()] == [(0, 1.0, 1.0, 2)]


def test_stream_drops_repeated_pages_across_batches(spark, tmp_path):
    schema = "page_id long, url string, html string, fetched timestamp_ntz"
    html = PAGES[1][2]
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    stamp = datetime(2024, 1, 1)
    spark.createDataFrame([(1, "u1", html, stamp), (2, "u2", html, stamp)], schema).coalesce(1).write.parquet(source)
    stream = st.article_stream(st.read_files(spark, source, schema, files_per_trigger=1), web.FieldPatterns(), "fetched")
    st.store_rows(stream, out, marks).awaitTermination()
    spark.createDataFrame([(3, "u1", html, stamp), (4, "u3", html, stamp)], schema).coalesce(1).write.mode("append").parquet(source)
    st.store_rows(stream, out, marks).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["u1", "u2", "u3"]


def test_stream_keeps_running_hits(spark, tmp_path):
    schema = "doc_id long, vec array<double>"
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    codebook = som.random_codebook((1, 2), 2)
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema).coalesce(1).write.parquet(source)
    seen = []
    hits = st.running_hits(st.score_stream(st.read_files(spark, source, schema), codebook))
    for extra in ([], [(3, [1.0, 0.0])]):
        if extra:
            spark.createDataFrame(extra, schema).coalesce(1).write.mode("append").parquet(source)
        st.refresh_map(hits, (1, 2), out, marks, None, lambda t, n: seen.append(n)).awaitTermination()
        table = st.latest_map(spark, out)
        assert table.count() == 2
    assert sum(r["hits"] for r in table.collect()) == 3 and len(set(seen)) == len(seen) == 2


def test_map_refresh_commits_state_partitions_without_nodes(spark, tmp_path):
    """Joined by sorting, as batches too large to be sent are: no partition of the stream's state is skipped."""
    schema = "doc_id long, vec array<double>"
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    names = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("16", "-1"), strict=True):
        spark.conf.set(name, value)
    try:
        for wave in ([(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(3, [1.0, 0.0])]):
            spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(source)
            hits = st.running_hits(st.score_stream(st.read_files(spark, source, schema), som.random_codebook((1, 2), 2)))
            st.refresh_map(hits, (1, 2), out, marks, None).awaitTermination()
        assert sum(r["hits"] for r in st.latest_map(spark, out).collect()) == 3
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
    # what a batch was stored in is gone again
    assert not [n for n in os.listdir(f"{staging_root(spark)}/textmap") if n.startswith("hits-")]


def test_links_resolve_steps_entities_and_schemes(spark):
    from textmap.operators import web

    html = (
        '<a href="../q">a</a><a href="./r?x=1&amp;y=2">b</a><a href="mailto:a@b.c">c</a>'
        '<a href="javascript:void(0)">d</a><a href="/z/../..">e</a>'
    )
    pages = spark.createDataFrame([(1, "http://a.com/x/y/p", html)], "page_id long, url string, html string")
    assert {r["url"] for r in web.links(pages).collect()} == {
        "http://a.com/x/q", "http://a.com/x/y/r?x=1&y=2", "http://a.com/",
    }


def test_links_skip_comments_and_keep_quoted_blanks(spark):
    html = (
        '<a href="a b.html">a</a><!-- <a href="/no">n</a> --><script>"<a href=/no2>"</script><a title="href=/no3" HREF = \'/c\'>c</a>'
        '<abbr href="/no4">x</abbr><a\nclass=x href=/d>d</a><a title="x>y" href="/e?q=1&amp;r=2">e</a><a name=top>t</a><a href=" /f ">f</a>'
    )
    table = pages(spark, [(1, "http://a.com/x/p", html), (2, "http://a.com/", None), (3, None, '<a href="/x">x</a>')])
    assert sorted(r["url"] for r in web.links(table).collect()) == [
        "http://a.com/c", "http://a.com/d", "http://a.com/e?q=1&r=2", "http://a.com/f", "http://a.com/x/a%20b.html",
    ]


def test_blank_is_any_white_space(spark):
    from pyspark.sql import functions as F

    from textmap.operators import web

    rows = spark.createDataFrame([("\n\t\n",), (" a ",), (None,)], "t string")
    assert [r[0] for r in rows.select(web.is_blank(F.col("t"))).collect()] == [True, False, True]


def test_stream_reads_tables_of_one_file_and_of_several(spark, tmp_path):
    rows = spark.range(6).selectExpr("id AS doc_id")
    rows.repartition(3).write.parquet(f"{tmp_path}/in/many.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "in" / "one.parquet")
    for name in ("many", "one"):
        stream = st.read_files(spark, f"{tmp_path}/in", "doc_id long", f"{name}.parquet")
        st.store_rows(stream, f"{tmp_path}/out-{name}", f"{tmp_path}/marks-{name}").awaitTermination()
        stored = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert sorted(r["doc_id"] for r in stored.collect()) == list(range(6))


def test_crawls_of_many_files_are_one_batch_each(spark, tmp_path, monkeypatch):
    from textmap.catalog import streams as cs

    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(5).write.parquet(f"{tmp_path}/in/pages.parquet")
    monkeypatch.setattr(cs, "staging_path", lambda session, name: f"{tmp_path}/{name}")
    found = cs.st1_store_crawls(spark, f"{tmp_path}/in").collect()
    assert len(list((tmp_path / "crawls").glob("*.parquet"))) >= 3 * 4
    logs = (tmp_path / "marks" / "sources" / "0").glob("[0-9]*")
    sizes = Counter(json.loads(line)["batchId"] for log in logs for line in log.read_text().splitlines()[1:])
    assert len(sizes) == 3 and len(set(sizes.values())) == 1
    monkeypatch.undo()
    whole = cs.st1_store_crawls(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(repr, found)) == sorted(map(repr, whole))

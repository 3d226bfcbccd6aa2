"""Queries on stored pages: links, fields, cleaning, whole articles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.catalog.tables import pages, table
from textmap.operators import html, web

# The pages of the test tables link to one-word paths.
PAGE_LINK = r"/[a-z]+$"
DOMAINS = ("example.com", "example.org")
REQUIRED = ("title", "timestamp", "body")

# What turns a stored page into one on the default fields: a dated line and a body with inner blocks.
_DATE = """<p class="z"><time datetime='2024-01-02T03:04:05+01:00' class="a>b" itemprop="datePublished">x</time></p>"""
_BODY = """<div class=z id='articleBody'>lost <div>in <div>deep</div> out</div>"""


def s4_scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", "url", "html")


def w1_links(spark: SparkSession, folder: str) -> DataFrame:
    return web.links(pages(spark, folder))


def p9_matching_links(spark: SparkSession, folder: str) -> DataFrame:
    return web.matching_links(web.links(pages(spark, folder)), PAGE_LINK)


def p10_allowed_domains(spark: SparkSession, folder: str) -> DataFrame:
    return web.allowed_domains(pages(spark, folder).select("page_id", "url"), DOMAINS)


def w2_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return web.frontier(pages(spark, folder), PAGE_LINK, DOMAINS)


def signed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose articles carry a date, unless their address has a query, and a nested body, unless it has a fragment."""
    dated = F.when(F.col("url").contains("?"), F.lit("")).otherwise(F.lit(_DATE))
    begin = F.when(F.col("url").contains("#"), F.lit("")).otherwise(F.lit(_BODY))
    html = F.replace(F.col("html"), F.lit("</h1>"), F.concat(F.lit("</h1><!-- <h1>no</h1> --><h1>and <em>not</em></h1>"), dated, begin))
    return pages(spark, folder).withColumn("html", F.replace(html, F.lit("</article>"), F.lit("</div></article>")))


def w3_default_fields(spark: SparkSession, folder: str) -> DataFrame:
    return web.extract_fields(signed_pages(spark, folder), web.FieldPatterns())


def w6_default_articles(spark: SparkSession, folder: str) -> DataFrame:
    return web.articles(signed_pages(spark, folder), web.FieldPatterns(), REQUIRED)


def w3_fields(spark: SparkSession, folder: str) -> DataFrame:
    return web.extract_fields(pages(spark, folder))


def w4_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", web.sanitize(F.col("html")).alias("body"))


def w5_strip_zone(spark: SparkSession, folder: str) -> DataFrame:
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return table(spark, folder, "events").select("event_id", web.strip_zone(zoned).alias("timestamp"))


def w6_articles(spark: SparkSession, folder: str) -> DataFrame:
    return web.articles(pages(spark, folder))


def p4_rejects(spark: SparkSession, folder: str) -> DataFrame:
    complete, rejects = web.split_complete(w3_default_fields(spark, folder), REQUIRED)
    kept = complete.select("doc_id", F.lit("").alias("missing"))
    return rejects.select("doc_id", F.array_join("missing", ",").alias("missing")).union(kept)


QUERIES = {
    f.__name__: f
    for f in (
        s4_scan_pages, w1_links, p9_matching_links, p10_allowed_domains, w2_frontier, w3_fields, w4_sanitize,
        w5_strip_zone, w6_articles, w3_default_fields, w6_default_articles, p4_rejects,
    )
}


def _re2(pattern: str) -> str:
    """Without possessive marks, which only save time, and quoted for SQL."""
    return pattern.replace("++", "+").replace("*+", "*").replace("'", "''")


def _entities(value: str) -> str:
    for entity, sign in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = f"replace({value}, '{entity}', '{sign}')"
    return value


def _attribute(tag: str, name: str) -> str:
    pairs = f"regexp_extract_all({tag}, '{_re2(html._ATTRIBUTE)}', 0)"
    own = f"list_filter({pairs}, lambda p: lower(regexp_extract(p, '^[^\\s=]+', 0)) = '{name}')[1]"
    value = f"regexp_extract({own}, '(?s)=\\s*(.*)$', 1)"
    plain = f"CASE WHEN {value}[1] IN ('\"', '''') THEN {value}[2:-2] ELSE {value} END"
    return f"CASE WHEN {own} IS NOT NULL THEN {_entities(plain)} END"


def _stripped(value: str) -> str:
    return f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')"


_SITE = r"regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"
_FOLDER = r"regexp_extract(regexp_replace(base, '[?#].*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(?:/.*/|/)?)', 1)"
# the addresses of the test tables have no "." and ".." steps
LINKS_SQL = f"""SELECT DISTINCT page_id, url FROM (SELECT page_id, CASE
    WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h
    WHEN starts_with(h, '//') THEN split_part(base, ':', 1) || ':' || h
    WHEN starts_with(h, '/') THEN {_SITE} || h
    WHEN starts_with(h, '#') THEN regexp_replace(base, '#.*$', '') || h
    WHEN starts_with(h, '?') THEN regexp_replace(base, '[?#].*$', '') || h
    WHEN ends_with({_FOLDER}, '/') THEN {_FOLDER} || h ELSE {_FOLDER} || '/' || h END AS url
    FROM (SELECT page_id, base, regexp_replace({_stripped(_attribute('tag', 'href'))}, '\\s', '%20', 'g') AS h
      FROM (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '{_re2(html.ANCHORS)}', 0)) AS tag FROM pages)
      WHERE regexp_matches(tag, '(?i)^<a\\s')))
    WHERE regexp_matches(url, '(?i)^https?://')"""
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_DOMAIN = " OR ".join(f"{_HOST} = '{d}' OR ends_with({_HOST}, '.{d}')" for d in DOMAINS)
_CANONICAL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), "
    r"'([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '')"
)


SIGNED_SQL = """(SELECT page_id, url, replace(replace(html, '</h1>',
    '</h1><!-- <h1>no</h1> --><h1>and <em>not</em></h1>' || CASE WHEN contains(url, '?') THEN '' ELSE '{}' END
    || CASE WHEN contains(url, '#') THEN '' ELSE '{}' END), '</article>', '</div></article>') AS html FROM pages)""".format(
    _DATE.replace("'", "''"), _BODY.replace("'", "''")
)


def fields_sql(patterns: web.FieldPatterns, source: str = "pages") -> str:
    """Fields of each page by walking its tokens one by one; the open elements are lists, the innermost first."""
    paths = [patterns.title, patterns.timestamp, patterns.body]
    tests, start, final = [], 0, []
    for path in paths:
        start |= 1 << len(tests)
        for step in path.steps:
            fits = [f"name = '{step.tag}'", *(f"coalesce({_attribute('t', a)} = '{v}', false)" for a, v in step.attributes)]
            tests.append(f"CASE WHEN {' AND '.join(fits)} THEN {1 << len(tests)} ELSE 0 END")
        final.append(1 << (len(tests) - 1))
    names = lambda tags: ", ".join(f"'{t}'" for t in tags)
    hits = []
    for number, (path, last) in enumerate(zip(paths, final, strict=True)):
        if path.take == "text":
            hits.append(f"SELECT page_id, {number} AS path, i, {_entities('t')} AS value FROM walk WHERE kind = 'text' AND parent & {last} <> 0")
        elif path.take == "children":
            # an open element ends where the stack is next cut below it, with an end tag of its own or just before
            hits.append(f"""SELECT page_id, {number} AS path, i, array_to_string(list_slice(toks, i + 1, CASE WHEN kind = 'empty' THEN i
                  WHEN stop IS NULL THEN len(toks) - 1 WHEN ending = 'end' AND ended = low THEN stop ELSE stop - 1 END + 1), '') AS value
              FROM (SELECT x.page_id, x.i, x.kind, x.low, min(z.i) AS stop, arg_min(z.kind, z.i) AS ending, arg_min(z.low, z.i) AS ended
                FROM walk x LEFT JOIN walk z ON z.page_id = x.page_id AND z.i > x.i AND z.low <= x.low
                WHERE x.kind IN ('open', 'empty') AND x.parent & {last} <> 0 GROUP BY ALL) JOIN cut USING (page_id)""")
        else:
            hits.append(f"SELECT page_id, {number} AS path, i, {_attribute('t', path.take[1:])} AS value FROM walk WHERE kind IN ('open', 'empty') AND chain & {last} <> 0")
    return f"""WITH RECURSIVE cut AS MATERIALIZED (
      SELECT page_id, url, regexp_extract_all(html, '{_re2(html.TOKENS)}', 0) AS toks FROM {source}
    ), tokens AS (SELECT page_id, unnest(toks) AS t, unnest(range(len(toks))) AS i FROM cut),
    named AS (SELECT *, lower(regexp_extract(t, '{html._NAME}', 1)) AS name FROM tokens),
    marked AS MATERIALIZED (SELECT page_id, i, t, name, {' + '.join(tests)} AS bits, name IN ({names(html.PARAGRAPH_ENDS)}) AS ends,
      CASE WHEN name = '' THEN CASE WHEN regexp_matches(t, '^<[!?]') THEN 'other' ELSE 'text' END
        WHEN starts_with(t, '</') THEN 'end'
        WHEN name IN ({names(html.VOID_TAGS)}, 'script', 'style') OR ends_with(t, '/>') THEN 'empty' ELSE 'open' END AS kind
      FROM named
    ), walk AS (
      SELECT page_id, -1::BIGINT AS i, '' AS t, '' AS kind, 0::BIGINT AS low, 0 AS parent, 0 AS chain, []::VARCHAR[] AS names, []::INTEGER[] AS chains FROM cut
      UNION ALL
      SELECT page_id, i, t, kind, len(names), parent, chain,
        CASE WHEN kind = 'open' THEN list_prepend(name, names) ELSE names END,
        CASE WHEN kind = 'open' THEN list_prepend(chain, chains) ELSE chains END
      FROM (SELECT *, coalesce(chains[1], 0) AS parent, bits & ((2 * coalesce(chains[1], 0)) | {start}) AS chain
        FROM (SELECT page_id, i, t, kind, name, bits, names[k + 1:] AS names, chains[k + 1:] AS chains
          FROM (SELECT w.page_id, w.names, w.chains, m.i, m.t, m.kind, m.name, m.bits, coalesce(CASE WHEN m.kind = 'end' THEN list_position(w.names, m.name)
              WHEN m.kind IN ('open', 'empty') AND m.ends THEN list_position(w.names, 'p') END, 0) AS k
            FROM walk w JOIN marked m ON m.page_id = w.page_id AND m.i = w.i + 1)))
    ), hits AS ({' UNION ALL '.join(hits)}),
    joined AS (SELECT page_id, path, string_agg({_stripped('value')}, ' ' ORDER BY i) AS value FROM hits WHERE value IS NOT NULL GROUP BY ALL)
    SELECT c.page_id AS doc_id, c.url, a.value AS title, b.value AS "timestamp", d.value AS body FROM cut c
    LEFT JOIN joined a ON a.page_id = c.page_id AND a.path = 0
    LEFT JOIN joined b ON b.page_id = c.page_id AND b.path = 1
    LEFT JOIN joined d ON d.page_id = c.page_id AND d.path = 2"""


FIELDS_SQL = fields_sql(web.ARTICLE_TAG)
DEFAULT_FIELDS_SQL = fields_sql(web.FieldPatterns(), SIGNED_SQL)


def sanitize_sql(column: str) -> str:
    marked = (
        f"regexp_replace(regexp_replace({column}, '(?s)<!--.*?-->', '', 'g'), "
        r"'(?i)<(/?)(h2|p|em|strong)(\s[^>]*)?>', chr(1) || '\1\2' || chr(2), 'g')"
    )
    return f"translate(regexp_replace({marked}, '(?s)</?[a-zA-Z!][^>]*>', '', 'g'), chr(1) || chr(2), '<>')"


def articles_sql(fields: str, required: tuple[str, ...]) -> str:
    cleaned = f"""SELECT doc_id, url, title, TRY_CAST(split_part("timestamp", '+', 1) AS TIMESTAMP) AS "timestamp",
        {sanitize_sql('body')} AS body FROM ({fields})"""
    empty = "''"
    value = 'coalesce("{}"::VARCHAR, {})'
    filled = " AND ".join(f"length({_stripped(value.format(c, empty))}) > 0" for c in required)
    return f"SELECT * FROM ({cleaned}) WHERE {filled}"


ARTICLES_SQL = articles_sql(FIELDS_SQL, ("title", "body"))

ORACLES = {
    "s4_scan_pages": "SELECT page_id, url, html FROM pages",
    "w1_links": LINKS_SQL,
    "p9_matching_links": f"SELECT * FROM ({LINKS_SQL}) WHERE regexp_matches(url, '{PAGE_LINK}')",
    "p10_allowed_domains": f"SELECT page_id, url FROM pages WHERE {_DOMAIN}",
    "w2_frontier": f"""SELECT DISTINCT {_CANONICAL} AS url FROM ({LINKS_SQL})
        WHERE regexp_matches(url, '{PAGE_LINK}') AND ({_DOMAIN})
        AND {_CANONICAL} NOT IN (SELECT {_CANONICAL} FROM pages)""",
    "w3_fields": FIELDS_SQL,
    "w4_sanitize": f"SELECT page_id, {sanitize_sql('html')} AS body FROM pages",
    "w5_strip_zone": "SELECT event_id, date_trunc('second', ts) AS \"timestamp\" FROM events",
    "w6_articles": ARTICLES_SQL,
    "w3_default_fields": DEFAULT_FIELDS_SQL,
    "w6_default_articles": articles_sql(DEFAULT_FIELDS_SQL, REQUIRED),
    "p4_rejects": f"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'title' END,
        CASE WHEN regexp_replace(coalesce("timestamp", ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'timestamp' END,
        CASE WHEN regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'body' END) AS missing FROM ({DEFAULT_FIELDS_SQL})""",
}

"""Stored web pages to article rows and links. Regular expressions only, all JVM-side."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmap.functions.common import let
from textmap.operators.html import Path, Step, anchors, attribute, elements

# Fixed: the tags that stay in a cleaned body.
KEPT_TAGS = ("h2", "p", "em", "strong")
# Fixed: links that lead to an article, a dated path.
ARTICLE_LINK = r"article/\d{4}/\d{2}/\d{2}/.+"
# Markers for kept tags while the others are deleted; both are control characters, absent from HTML text.
_OPEN, _CLOSE = "\x01", "\x02"


@dataclass(frozen=True)
class FieldPatterns:
    """Where the fields of an article stand in its page; every element there is one hit.

    The tag and attribute names of the defaults are fixed values.
    """

    title: Path = Path((Step("article"), Step("h1")))
    timestamp: Path = Path((Step("time", (("itemprop", "datePublished"),)),), "@datetime")
    body: Path = Path((Step("div", (("id", "articleBody"),)),), "children")


# Pages that keep the whole article in <article>.
ARTICLE_TAG = FieldPatterns(body=Path((Step("article"),), "children"))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def joined(found: Column) -> Column:
    """Stripped hits joined by a space; null when there is no hit."""
    return let(F.transform(found, strip), lambda hits: F.when(F.size(hits) > 0, F.array_join(hits, " ")))


def field(html: Column, pattern: str) -> Column:
    """What a pattern's first group finds in a page, for fields that are no elements."""
    return joined(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def sanitize(html: Column, tags: Sequence[str] = KEPT_TAGS) -> Column:
    """Only the given tags stay, without attributes; other tags and comments go, their text stays."""
    names = "|".join(tags)
    no_comments = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    marked = F.regexp_replace(no_comments, rf"(?i)<(/?)({names})(\s[^>]*)?>", f"{_OPEN}$1$2{_CLOSE}")
    stripped = F.regexp_replace(marked, r"(?s)</?[a-zA-Z!][^>]*>", "")
    return F.translate(stripped, _OPEN + _CLOSE, "<>")


def strip_zone(timestamp: Column) -> Column:
    """A time text cut at its "+hh:mm" suffix, hence a time without a zone; null if it is none."""
    return F.substring_index(timestamp, "+", 1).try_cast("timestamp_ntz")


def _fields(patterns: FieldPatterns) -> list[Column]:
    title, timestamp, body = elements(F.col("html"), [patterns.title, patterns.timestamp, patterns.body])
    return [
        F.col("page_id").alias("doc_id"),
        F.col("url"),
        joined(title).alias("title"),
        joined(timestamp).alias("timestamp"),
        joined(body).alias("body"),
    ]


def extract_fields(pages: DataFrame, patterns: FieldPatterns = ARTICLE_TAG) -> DataFrame:
    return pages.select(*_fields(patterns))


def is_blank(value: Column) -> Column:
    return F.length(strip(F.coalesce(value.cast("string"), F.lit("")))) == 0


def missing_fields(required: Sequence[str]) -> Column:
    """Names of the required columns that are null or blank."""
    return F.filter(
        F.array(*[F.when(is_blank(F.col(c)), F.lit(c)) for c in required]),
        lambda name: name.isNotNull(),
    )


def split_complete(items: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rejects(doc_id, missing))."""
    checked = items.withColumn("missing", missing_fields(required))
    complete = checked.where(F.size("missing") == 0).drop("missing")
    return complete, checked.where(F.size("missing") > 0).select("doc_id", "missing")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _parts(base: Column) -> Column:
    """(scheme, site, folder, page) of an address; the folder is its path up to the last slash."""
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(?:/.*/|/)?)", 1)
    return F.struct(
        F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1).alias("scheme"),
        F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1).alias("site"),
        let(folder, lambda f: F.when(f.endswith("/"), f).otherwise(F.concat(f, F.lit("/")))).alias("folder"),
        F.regexp_replace(base, r"#.*$", "").alias("page"),
    )


def _resolved(url: Column, base: Column) -> Column:
    return (
        F.when(url.startswith("//"), F.concat(base["scheme"], F.lit(":"), url))
        .when(url.startswith("/"), F.concat(base["site"], url))
        .when(url.startswith("#"), F.concat(base["page"], url))
        .when(url.startswith("?"), F.concat(F.regexp_replace(base["page"], r"\?.*$", ""), url))
        .when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), url)
        .otherwise(F.concat(base["folder"], url))
    )


def absolute(url: Column, base: Column) -> Column:
    """A link target made absolute against the page it was found on."""
    return let(url, lambda u: let(_parts(base), lambda b: _resolved(u, b)))


def without_dots(url: Column) -> Column:
    """The address with "." and ".." steps of its path resolved."""

    def resolved(parts: Column) -> Column:
        steps = F.aggregate(
            F.split(parts["path"], "/"),
            F.expr("cast(array() as array<string>)"),
            lambda done, step: F.when(step == ".", done)
            .when(step == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
            .otherwise(F.concat(done, F.array(step))),
        )
        ends = F.when(parts["path"].rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
        dotted = parts["path"].rlike(r"/\.{1,2}(/|$)")
        return F.when(dotted, F.concat(parts["site"], F.array_join(steps, "/"), ends, parts["rest"])).otherwise(parts["whole"])

    def of(whole: Column) -> Column:
        parts = F.struct(
            whole.alias("whole"),
            F.regexp_extract(whole, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1).alias("site"),
            F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)", 1).alias("path"),
            F.regexp_extract(whole, r"([?#].*)$", 1).alias("rest"),
        )
        return F.when(whole.contains("/."), let(parts, resolved)).otherwise(whole)

    return let(url, of)


def canonical(url: Column) -> Column:
    """Without fragment, campaign parameters and a closing slash; one form per page."""
    no_fragment = F.regexp_replace(url, r"#.*$", "")
    no_campaign = F.regexp_replace(no_fragment, r"([?&])utm_[a-z]+=[^&]*", "$1")
    tidy = F.regexp_replace(F.regexp_replace(no_campaign, r"&+", "&"), r"\?&", "?")
    return F.regexp_replace(tidy, r"[?&/]+$", "")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url): the absolute web links of each page, each once per page, made distinct in the row.

    Links inside comments, scripts and styles are none. A quoted address keeps its blanks, written as %20.
    """

    def target(tag: Column, base: Column) -> Column:
        href = F.regexp_replace(strip(attribute(tag, "href")), r"\s", "%20")
        return let(href, lambda h: without_dots(_resolved(h, base)))

    found = let(_parts(F.col("url")), lambda base: F.transform(anchors(F.col("html")), lambda tag: target(tag, base)))
    targets = F.array_distinct(F.filter(found, lambda u: u.rlike("(?i)^https?://")))
    return pages.select("page_id", F.explode(targets).alias("url"))


def matching_links(links: DataFrame, allow: str = ARTICLE_LINK) -> DataFrame:
    return links.where(F.col("url").rlike(allow))


def allowed_domains(links: DataFrame, domains: Sequence[str]) -> DataFrame:
    name = host(F.col("url"))
    ok = F.lit(False)
    for domain in domains:
        ok = ok | (name == domain) | name.endswith("." + domain)
    return links.where(ok)


def frontier(pages: DataFrame, allow: str = ARTICLE_LINK, domains: Sequence[str] | None = None) -> DataFrame:
    """(url): allowed links that no stored page answers yet, each once."""
    found = matching_links(links(pages), allow)
    if domains is not None:
        found = allowed_domains(found, domains)
    wanted = found.select(canonical(F.col("url")).alias("url")).distinct()
    # made distinct first: many copies of one page then meet as one row
    known = pages.select(canonical(F.col("url")).alias("url")).distinct()
    return wanted.join(known, "url", "left_anti")


def articles(
    pages: DataFrame, patterns: FieldPatterns = ARTICLE_TAG, required: Sequence[str] = ("title", "body"),
    tags: Sequence[str] = KEPT_TAGS,
) -> DataFrame:
    """(doc_id, url, title, timestamp, body): the whole article job, one narrow plan for tables and streams.

    A page becomes an array of one item or none, so that no pattern runs again for the check.
    """

    def clean(item: Column) -> Column:
        return F.struct(
            item["doc_id"].alias("doc_id"), item["url"].alias("url"), item["title"].alias("title"),
            strip_zone(item["timestamp"]).alias("timestamp"), sanitize(item["body"], tags).alias("body"),
        )

    def complete(item: Column) -> Column:
        return reduce(and_, [~is_blank(item[c]) for c in required], F.lit(True))

    items = F.filter(F.transform(F.array(F.struct(*_fields(patterns))), clean), complete)
    return pages.select(F.inline(items))

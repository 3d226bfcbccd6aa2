"""Elements of stored pages by their nesting, JVM-side: a page is cut into tags and texts and folded once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmap.functions.common import let

# Fixed: elements without content, and elements whose start ends an open paragraph (HTML standard).
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
PARAGRAPH_ENDS = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
    "pre", "section", "table", "ul",
)

# A tag with its quoted values. Possessive groups: the loop needs no stack and an open quote fails at once.
_TAG = r"""[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_UNREAD = r"""<!--.*?(?:-->|\z)|<script\b[^>]*+>.*?(?:</script\s*+>|\z)|<style\b[^>]*+>.*?(?:</style\s*+>|\z)"""
TOKENS = rf"(?is){_UNREAD}|</?{_TAG}|<[!?][^>]*+>|[^<]++(?:<[^a-z/!?<][^<]*+)*+|<"
ANCHORS = rf"(?is){_UNREAD}|<a\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_NAME = r"^</?([a-zA-Z][^\s/>]*)"
_ATTRIBUTE = r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


@dataclass(frozen=True)
class Step:
    """An element by its tag and by attributes that must have exactly these values."""

    tag: str
    attributes: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Path:
    """Elements by their chain of parents, the first one anywhere in the page, and what to take of them.

    ``take``: "text" (each piece of their own text), "children" (each child element as it is written), or "@name"
    (the value of an attribute).
    """

    steps: tuple[Step, ...]
    take: str = "text"


def plain_entities(text: Column) -> Column:
    """The entities that occur in addresses and titles, read once."""
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, in any order and quoting; null if it has none."""
    pairs = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    own = F.filter(pairs, lambda p: F.lower(F.regexp_extract(p, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.get(own, F.lit(0)), r"(?s)=\s*(.*)$", 1)
    return let(value, lambda v: plain_entities(F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)))


def anchors(html: Column) -> Column:
    """The start tags of links; those inside comments, scripts and styles are none."""
    return F.filter(F.regexp_extract_all(html, F.lit(ANCHORS), F.lit(0)), lambda t: t.rlike(r"(?i)^<a\s"))


class _Bits:
    """A bit for each step of each path; an element has a bit if it ends a chain up to that step."""

    def __init__(self, paths: Sequence[Path]):
        self.paths, self.start, self.final, self.steps = paths, 0, [], []
        for path in paths:
            self.start |= 1 << len(self.steps)
            self.steps += path.steps
            self.final.append(1 << (len(self.steps) - 1))

    def matching(self, tag: Column, name: Column) -> Column:
        """The bits of the steps that a start tag fits by itself."""
        bits = F.lit(0)
        for k, step in enumerate(self.steps):
            fits = reduce(and_, [attribute(tag, a) == v for a, v in step.attributes], name == step.tag)
            bits = bits.bitwiseOR(F.when(fits, 1 << k).otherwise(0))
        return bits


_END, _OPEN, _EMPTY, _TEXT, _OTHER = range(5)


def _mark(token: Column, at: Column, bits: _Bits) -> Column:
    """(kind, name, bits, ends, at) of a token; ``ends``: a start that ends an open paragraph."""

    def named(name: Column) -> Column:
        raw = name.isin("script", "style")
        empty = name.isin(*VOID_TAGS) | raw | token.endswith("/>")
        kind = (
            F.when(name == "", F.when(token.rlike(r"^<[!?]"), _OTHER).otherwise(_TEXT))
            .when(token.startswith("</"), _END).when(empty, _EMPTY).otherwise(_OPEN)
        )
        return F.struct(
            kind.alias("kind"), name.alias("name"), bits.matching(token, name).alias("bits"),
            name.isin(*PARAGRAPH_ENDS).alias("ends"), at.alias("at"),
        )

    return let(F.lower(F.regexp_extract(token, _NAME, 1)), named)


_NO_OPEN, _NO_HITS = "cast(array() as array<struct<path: int, begin: int, depth: int>>)", "cast(array() as array<struct<begin: int, end: int, path: int>>)"


def _state(names: Column, chains: Column, pending: Column, hits: Column) -> Column:
    return F.struct(names.alias("names"), chains.alias("chains"), pending.alias("pending"), hits.alias("hits"))


def _hit(path: int, begin: Column, end: Column) -> Column:
    return F.struct(begin.alias("begin"), end.alias("end"), F.lit(path).alias("path"))


def _closed(s: Column, k: Column, at: Column, own: bool) -> Column:
    """The state without its ``k`` innermost elements; ``own``: an end tag, which belongs to the outermost of them."""

    def cut(left: Column) -> Column:
        end = lambda p: F.when(p["depth"] == left + 1, at).otherwise(at - 1) if own else at - 1
        shut = F.transform(
            F.filter(s["pending"], lambda p: p["depth"] > left),
            lambda p: F.struct(p["begin"].alias("begin"), end(p).alias("end"), p["path"].alias("path")),
        )
        return _state(
            F.slice(s["names"], k + 1, left), F.slice(s["chains"], k + 1, left),
            F.filter(s["pending"], lambda p: p["depth"] <= left), F.concat(s["hits"], shut),
        )

    return let(F.size(s["names"]) - k, cut)


def _opened(s: Column, t: Column, bits: _Bits) -> Column:
    """The state after a start tag: its element pushed unless it is empty, and what paths take of it."""
    parent = F.coalesce(F.get(s["chains"], F.lit(0)), F.lit(0))

    def push(chain: Column) -> Column:
        pending, hits = s["pending"], s["hits"]
        for number, (path, final) in enumerate(zip(bits.paths, bits.final, strict=True)):
            if path.take == "children":
                child = parent.bitwiseAND(final) != 0
                opened = F.struct(F.lit(number).alias("path"), t["at"].alias("begin"), (F.size(s["names"]) + 1).alias("depth"))
                pending = F.when(child & (t["kind"] == _OPEN), F.concat(pending, F.array(opened))).otherwise(pending)
                hits = F.when(child & (t["kind"] == _EMPTY), F.concat(hits, F.array(_hit(number, t["at"], t["at"])))).otherwise(hits)
            elif path.take.startswith("@"):
                hits = F.when(chain.bitwiseAND(final) != 0, F.concat(hits, F.array(_hit(number, t["at"], t["at"])))).otherwise(hits)
        return (
            F.when(t["kind"] == _EMPTY, _state(s["names"], s["chains"], pending, hits))
            .otherwise(_state(F.concat(F.array(t["name"]), s["names"]), F.concat(F.array(chain), s["chains"]), pending, hits))
        )

    return let(t["bits"].bitwiseAND((parent * 2).bitwiseOR(F.lit(bits.start))), push)


def _step(s: Column, t: Column, bits: _Bits) -> Column:
    def ended(k: Column) -> Column:
        return F.when(k > 0, _closed(s, k, t["at"], True)).otherwise(s)

    def started(k: Column) -> Column:
        after = F.when(k > 0, _closed(s, k, t["at"], False)).otherwise(s)
        return let(after, lambda a: _opened(a, t, bits))

    top = F.coalesce(F.get(s["chains"], F.lit(0)), F.lit(0))
    wanted = [n for n, p in enumerate(bits.paths) if p.take == "text"]
    said = F.when(F.lit(False), s)
    if wanted:
        found = [F.when(top.bitwiseAND(bits.final[n]) != 0, F.array(_hit(n, t["at"], t["at"]))).otherwise(F.expr(_NO_HITS)) for n in wanted]
        any_text = reduce(or_, [bits.final[n] for n in wanted])
        said = F.when(
            (t["kind"] == _TEXT) & (top.bitwiseAND(any_text) != 0), _state(s["names"], s["chains"], s["pending"], F.concat(s["hits"], *found))
        )
    return (
        said.when(t["kind"] == _END, let(F.array_position(s["names"], t["name"]).cast("int"), ended))
        .when(t["kind"].isin(_OPEN, _EMPTY), let(F.when(t["ends"], F.array_position(s["names"], F.lit("p")).cast("int")).otherwise(0), started))
        .otherwise(s)
    )


def elements(html: Column, paths: Sequence[Path]) -> list[Column]:
    """For each path the array of its hits in a page, in their order; null pages give null.

    One pass over the tags with a stack of open elements. An end tag closes the innermost open element of its name
    and all inside it, and means nothing if there is none; the start of a block ends an open paragraph; the end of
    the page closes the rest. Comments, scripts and styles are not read. Texts and attribute values have their
    basic entities read; children come as they are written, without a closing tag that the page lacks.
    """
    bits = _Bits(paths)

    def folded(tokens: Column) -> Column:
        marks = F.transform(tokens, lambda t, i: _mark(t, i, bits))
        zero = _state(F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<int>)"), F.expr(_NO_OPEN), F.expr(_NO_HITS))
        last = F.size(tokens) - 1
        hits = F.aggregate(
            marks, zero, lambda s, t: _step(s, t, bits),
            lambda s: F.array_sort(F.concat(s["hits"], F.transform(
                s["pending"], lambda p: F.struct(p["begin"].alias("begin"), last.alias("end"), p["path"].alias("path"))
            ))),
        )

        def values(found: Column) -> Column:
            def of(number: int, take: str) -> Column:
                own = F.filter(found, lambda h: h["path"] == number)
                written = lambda h: F.array_join(F.slice(tokens, h["begin"] + 1, h["end"] - h["begin"] + 1), "")
                if take == "children":
                    return F.transform(own, written)
                token = lambda h: F.get(tokens, h["begin"])
                if take == "text":
                    return F.transform(own, lambda h: plain_entities(token(h)))
                return F.filter(F.transform(own, lambda h: attribute(token(h), take[1:])), lambda v: v.isNotNull())

            return F.struct(*[of(n, p.take).alias(f"path{n}") for n, p in enumerate(paths)])

        return let(hits, values)

    found = let(F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0)), folded)
    return [found[f"path{n}"] for n in range(len(paths))]

"""Pieces of captured HTML as columns: attributes, text of nodes, whole elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import let, strip
from ..functions.text import unescape


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, null when absent or empty."""
    value = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
    inner = F.regexp_extract(value, r"(?s)[\"'](.*)[\"']$", 1)
    return unescape(F.nullif(inner, F.lit("")), html5=False)


def opening_tag(markup: Column, names: str, name: str, value: str) -> Column:
    """First opening tag with an attribute whose value matches, '' without one."""
    quoted = rf"(?:\"[^\"]*(?:{value})[^\"]*\"|'[^']*(?:{value})[^']*')"
    return F.regexp_extract(markup, rf"(?is)<(?:{names})\b[^>]*\b{name}\s*=\s*{quoted}[^>]*>", 0)


def element(markup: Column, names: str, name: str, value: str) -> Column:
    """The first element with a matching attribute, nested elements included; null without one.

    The end is where as many tags of its kind were closed as opened.
    """
    def kind(tag: Column) -> Column:
        return F.regexp_extract(tag, r"^<(\w+)", 1)

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part.startswith("</"), -1).when(part.startswith("<"), 1).otherwise(0)
        at = acc["at"] + 1
        end = F.when((acc["end"] == 0) & (depth == 0) & (at > 1), at).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("depth", "at", "end")])

    def cut(parts: Column, tag: Column) -> Column:
        end = F.aggregate(parts, zero, step, lambda acc: F.when(acc["end"] == 0, acc["at"] + 1).otherwise(acc["end"]))
        return F.concat(F.array_join(F.slice(parts, 1, end - 1), ""), F.lit("</"), kind(tag), F.lit(">"))

    def whole(page: Column, tag: Column) -> Column:
        rest = F.substring(page, F.instr(page, tag), F.length(page))
        parts = F.split(rest, F.concat(F.lit("(?i)(?=</?"), kind(tag), F.lit(r"\b)")))
        return F.when(tag != "", let(parts, lambda p: cut(p, tag)))

    return let(markup, lambda page: let(opening_tag(page, names, name, value), lambda tag: whole(page, tag)))


def inner(markup: Column, names: str, name: str, value: str) -> Column:
    """Text of the first element with a matching attribute, up to the first end tag of its kind.

    For the small elements of a card; ``element`` minds nested ones.
    """
    quoted = rf"(?:\"[^\"]*(?:{value})[^\"]*\"|'[^']*(?:{value})[^']*')"
    found = rf"(?is)<({names})\b[^>]*\b{name}\s*=\s*{quoted}[^>]*>(.*?)</\1\s*>"
    return node_text(F.regexp_extract(markup, found, 2))


def node_text(markup: Column) -> Column:
    """The stripped text nodes of a fragment, one after another; null when empty."""
    bare = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    return F.nullif(strip(unescape(F.regexp_replace(bare, r"(?U)\s*<[^>]*>\s*", ""), html5=False)), F.lit(""))


def text_nodes(markup: Column) -> Column:
    """Non-empty text nodes of a fragment, in order."""
    nodes = F.transform(F.split(markup, r"<[^>]*>"), lambda s: strip(unescape(s, html5=False)))
    return F.filter(nodes, lambda s: s != "")

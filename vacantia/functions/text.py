"""HTML to text, entities, URLs, titles, sections."""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon
from .patterns import CASELESS, holds, let, strip

# Named entities by rule from the standard library.
_HTML4 = {name: chr(cp) for name, cp in html.entities.name2codepoint.items()}
_HTML5 = {name[:-1]: value for name, value in html.entities.html5.items() if name.endswith(";")}
# Numeric references to C1 controls mean Windows-1252 characters.
_CP1252 = {c: bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0)}
# Entities worth a look before the table.
_COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}

_ENTITY = r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _lookup(table: dict, key: Column) -> Column:
    # one literal that Spark folds to a map, not thousands of them
    names = {str(k): v for k, v in table.items()}
    return F.try_element_at(F.from_json(F.lit(json.dumps(names)), "map<string,string>"), key)


def _code_point(cp: Column) -> Column:
    wide = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    bad = (cp == 0) | cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF)
    windows = F.when(cp.between(0x80, 0x9F), _lookup(_CP1252, cp.cast("string")))
    return F.when(bad, F.lit("�")).otherwise(F.coalesce(windows, wide))


def unescape(text: Column, html5: bool = True) -> Column:
    """Decode entities in one pass, so that ``&amp;lt;`` becomes ``&lt;``."""
    names = _HTML5 if html5 else {**_HTML4, "apos": "'"}

    def piece(part: Column) -> Column:
        # the text before the first entity, if any, starts with no &
        return F.when(part.startswith("&"), let(F.regexp_extract(part, _ENTITY, 1), lambda ref: named(part, ref))).otherwise(part)

    def named(part: Column, ref: Column) -> Column:
        rest = F.substring(part, F.length(ref) + 3, F.length(part))
        number = F.when(
            F.substring(ref, 2, 1).isin("x", "X"), F.conv(F.substring(ref, 3, F.length(ref)), 16, 10)
        ).otherwise(F.substring(ref, 2, F.length(ref))).try_cast("bigint")
        common = reduce(lambda w, kv: w.when(ref == kv[0], F.lit(kv[1])), _COMMON.items(), F)
        char = F.when(ref.startswith("#"), _code_point(number)).otherwise(
            F.coalesce(common.otherwise(None), _lookup(names, ref))
        )
        return F.when(ref == "", part).otherwise(F.coalesce(F.concat(char, rest), part))

    def decode(whole: Column) -> Column:
        decoded = F.array_join(F.transform(F.split(whole, "(?=&)"), piece), "")
        return F.when(whole.contains("&"), decoded).otherwise(whole)

    return let(text, decode)


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def html_to_text(markup: Column) -> Column:
    """Text nodes of a page joined by blanks; null when there are none.

    Comments, declarations and the content of script, style, template and ruby
    annotations are no text.  Repair of broken markup is out of contract.
    """
    body = F.regexp_replace(
        markup, r"(?is)<!--.*?-->|<!\[CDATA\[|<(script|style|template|rt|rp)\b[^>]*>.*?</\1\s*>", " "
    )
    body = F.regexp_replace(body, r"(?s)<[/!?]?[A-Za-z?!](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", " ")
    plain = collapse(unescape(body, html5=False))
    # plain text and pages alike end up collapsed and non-empty
    return F.nullif(plain, F.lit(""))


def unescape_if_escaped(content: Column) -> Column:
    """Decode a payload that arrives HTML-escaped, leave markup alone."""
    return F.when(content.contains("&lt;"), unescape(content)).otherwise(content)


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalize_title(title: Column) -> Column:
    """Levels to digits, abbreviations spelled out, brackets dropped, lower case."""
    t = strip(F.coalesce(title, F.lit("")))
    for pattern, value in lexicon.TITLE_LEVELS + lexicon.TITLE_ABBREVIATIONS:
        t = F.regexp_replace(t, CASELESS + pattern, value)
    return F.lower(collapse(F.regexp_replace(t, r"[()\[\]]", " ")))


def section(text: Column, headings, chars: int = lexicon.SECTION_CHARS, seen: Column | None = None) -> Column:
    """The text from the first heading on, at most ``chars`` long; null without a heading."""
    place = lambda h: F.nullif(F.instr(text, h), F.lit(0))
    at = F.least(*[place(h) if seen is None else F.when(holds(text, h, seen), place(h)) for h in headings])
    return F.substring(text, at, F.lit(chars))


def occurrences(text: Column, word: str, seen: Column | None = None) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return F.when(holds(text, word, seen), (gone / len(word)).cast("int")).otherwise(0)


def company_name_norm(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9. ]", "")

"""Flat HTML expressions: tags, attributes, visible text, entities.

Everything here is a column expression. The one task that needs the ancestors of an
element is in :mod:`vitrine.operators.pages`.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from .ladders import let

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


#: The table of references that the expression being built shares, if it does.
_shared: list[Column] = []


def _entity_map() -> Column:
    """Named references of the HTML standard (from the Python standard library) as one
    constant string that Spark folds into a map."""
    if _shared:
        return _shared[-1]
    pairs = [f"&{name}\x02{value}" for name, value in html5.items() if name.endswith(";")]
    return F.str_to_map(F.lit("\x01".join(pairs)), F.lit("\x01"), F.lit("\x02"))


def sharing_entities(body: Callable[[], Column]) -> Column:
    """``body()`` with one table of references, however often it decodes.

    A table stands in a plan, its texts and its tasks once for each decoding otherwise: 2,125 names each time.
    """
    if _shared:
        return body()

    def with_table(table: Column) -> Column:
        _shared.append(table)
        try:
            return body()
        finally:
            _shared.pop()

    return let(_entity_map(), with_table)


# References that pages use most, decoded without the full table.
COMMON_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&pound;", "£"), ("&times;", "×"),
    ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&bull;", "•"), ("&amp;", "&"),
]


_SIMPLE_OR_NONE = "|".join(n[1:] for n, _ in COMMON_ENTITIES)


def unescape(value: Column, bulk: bool = False) -> Column:
    """Decode character references.

    Text is split into tokens and each reference is looked up or converted on its own.
    With ``bulk`` (long texts), text whose references are all common ones takes a chain
    of plain replacements instead (``&amp;`` last, so nothing is decoded twice).
    """

    def decode(t: Column) -> Column:
        hexa = F.regexp_extract(t, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        deci = F.regexp_extract(t, r"^&#([0-9]+);$", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10).cast("long")).when(deci != "", deci.cast("long"))
        return (
            F.when(~t.startswith("&"), t)
            .when(code.isNotNull(), _code_point(code))
            .otherwise(F.coalesce(F.try_element_at(_entity_map(), t), t))
        )

    def body(v: Column) -> Column:
        tokens = F.regexp_extract_all(
            v, F.lit(r"(&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&)"), F.lit(1)
        )
        exact = F.array_join(F.transform(tokens, decode), "")
        if not bulk:
            return F.when(~v.contains("&"), v).otherwise(exact)
        simple = v
        for name, char in COMMON_ENTITIES:
            simple = F.replace(simple, F.lit(name), F.lit(char))
        other = v.rlike(rf"&(?!(?:{_SIMPLE_OR_NONE}))(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
        return F.when(~v.contains("&"), v).when(other, exact).otherwise(simple)

    return let(value, body)


def _code_point(code: Column) -> Column:
    """Character of a Unicode code point."""
    bad = (code == 0) | (code > 1114111) | code.between(55296, 57343)
    return F.when(bad, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")


def markup_only(html: Column) -> Column:
    """HTML without comments and without the contents of scripts and styles."""
    return F.regexp_replace(without_comments(html), r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>|$)", "$1$3")


def tags(html: Column, name: str) -> Column:
    """All opening tags ``<name ...>`` as text."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)(<{name}\b{_ATTRS}>)"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute; '' when absent."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return let(tag, lambda t: unescape(F.concat(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)])))


def meta_content(html: Column, key: str, value: str) -> Column:
    """``content`` of the first meta tag with ``key="value"``, trimmed; '' when absent."""
    pattern = rf"""(?i)(<meta\b(?=[^>]*[\s"']{key}\s*=\s*["']?{value}["'\s/>]){_ATTRS}>)"""
    return F.trim(attribute(F.regexp_extract(html, pattern, 1), "content"))


def collapse_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\s \x1c-\x1f\u0085  -     　]+", " "))


def title_text(html: Column) -> Column:
    """C1. ``<title>``, else ``og:title``, else ''."""

    def body(clean: Column) -> Column:
        inner = F.regexp_extract(clean, r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|$)", 1)
        return F.when(
            clean.rlike(r"(?i)<title\b[^>]*>"), F.trim(unescape(inner), F.lit(" \t\n\r\f"))
        ).otherwise(meta_content(clean, "property", "og:title"))

    return let(without_comments(html), body)


def description_text(html: Column) -> Column:
    """C2. description, then og:description, then twitter:description."""
    clean = without_comments(html)
    options = [("name", "description"), ("property", "og:description"), ("name", "twitter:description")]
    picks = lambda c: [F.nullif(meta_content(c, k, v), F.lit("")) for k, v in options]
    return let(clean, lambda c: F.coalesce(*picks(c), F.lit("")))


def visible_text(html: Column) -> Column:
    """C3. Text without scripts, styles, noscript, svg and iframes, whitespace collapsed."""
    body = F.regexp_replace(without_comments(html), r"(?is)<(script|style|noscript|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)", " ")
    body = F.regexp_replace(body, r"(?s)<![^>]*>|<\?[^>]*>", " ")
    # markup characters inside decoded text must not look like tags: strip first, decode after
    return collapse_space(unescape(F.regexp_replace(body, rf"</?[a-zA-Z]{_ATTRS}>", " "), bulk=True))


def json_ld(html: Column) -> Column:
    """Bodies of the structured-data scripts in document order."""
    return F.regexp_extract_all(
        without_comments(html),
        F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""),
        F.lit(1),
    )


def hrefs(html: Column) -> Column:
    """``href`` of every anchor in document order, anchors without one left out."""
    anchors = F.filter(tags(markup_only(html), "a"), lambda t: t.rlike(r"(?i)[\s\"'/]href\s*="))
    return F.transform(anchors, lambda t: attribute(t, "href"))

"""HTML expressions: text, titles, links and images of a page string.

Pages are tokenised with quote-aware regular expressions evaluated in the JVM.
Possessive quantifiers keep them linear and free of stack growth on long input.
All functions take and return SQL expression text.
"""

from __future__ import annotations

import codecs
import html.entities
import json

from sitefeed.functions.exprs import fresh, let, matches, replaced, strip, text
from sitefeed.functions.urls import last_segment, resolve_url

ATTRS = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
# Parts that hold no markup of the page itself.
OPAQUE = (
    r"<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
)
TEMPLATE = r"|<template\b.*?(?:</template\s*>|\z)"
TAG = rf"</?[a-z!]{ATTRS}>|<\?[^>]*+>"
SEPARATOR = rf"(?is){OPAQUE}{TEMPLATE}|{TAG}"
INNER_TAG = rf"(?is){TAG}"
ATTRIBUTE = r"""(?s)([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]*+))?"""

# A quoted attribute value.
QUOTED = r"""(?s)^"(.*)"$|^'(.*)'$"""

IMAGE = rf"(?is)<img\b{ATTRS}>"
ANCHOR = rf"(?is)<a(?=[\s/>]){ATTRS}>"
META = rf"(?is)<meta\b{ATTRS}>"

# Where an image's address may be, in order of preference, and
# the inline style each mode writes.
IMAGE_SOURCES = {"v1": ("src",), "v2": ("src", "data-src", "data-original")}
IMAGE_STYLE = {
    "v1": "max-width:100%;height:auto;margin:5px 0;",
    "v2": "max-width:100%;height:auto;",
}
SHORT_TEXT = 200

_RARE_ENTITY = r"&(?:#|(?!(?:amp|lt|gt|quot|nbsp|copy|middot);)[A-Za-z])"
_COMMON = (
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&quot;", '"'),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
)


def _entity_table() -> tuple[str, str, int]:
    """Every HTML5 character name, from the standard library, ascending, and its characters: two JSON arrays."""
    known = sorted(("&" + name, chars) for name, chars in html.entities.html5.items())
    return json.dumps([name for name, _ in known]), json.dumps([chars for _, chars in known]), len(known)


def _entity_pattern() -> str:
    """Numeric references, names ending in ';', and the names valid without one."""
    bare = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
    return r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;|(?:%s))" % "|".join(bare)


def _windows_1252() -> str:
    """Numeric references 128-159 mean Windows-1252 characters in HTML."""
    table = {}
    for code in range(0x80, 0xA0):
        try:
            table[str(code)] = codecs.decode(bytes([code]), "cp1252")
        except UnicodeDecodeError:
            table[str(code)] = chr(code)
    return json.dumps(table)


_ENTITY_NAMES, _ENTITY_CHARS, _ENTITIES = _entity_table()
_ENTITY_PATTERN = _entity_pattern()
_WINDOWS_JSON = _windows_1252()


def _table(entries: str) -> str:
    """Map literal: parsed once, when the plan is optimised."""
    return f"from_json({text(entries)}, 'map<string,string>')"


def _array(entries: str) -> str:
    """Array literal: parsed once, when the plan is optimised."""
    return f"from_json({text(entries)}, 'array<string>')"


def _named_reference(ref: str) -> str:
    """Characters of ``&name;`` (itself if unknown), by halving the ascending names."""
    s, i = fresh(), fresh()
    halve = let(
        f"({s}.low + {s}.high) div 2",
        lambda m: f"if(get({_array(_ENTITY_NAMES)}, CAST({m} AS int)) < {ref}, "
        f"named_struct('low', {m} + 1, 'high', {s}.high), named_struct('low', {s}.low, 'high', {m}))",
    )
    steps = f"sequence(1, {_ENTITIES.bit_length()})"
    bounds = f"named_struct('low', 0L, 'high', {_ENTITIES - 1}L)"
    place = f"CAST(aggregate({steps}, {bounds}, ({s}, {i}) -> if({s}.low < {s}.high, {halve}, {s})).low AS int)"
    return let(
        place,
        lambda p: f"if(get({_array(_ENTITY_NAMES)}, {p}) = {ref}, get({_array(_ENTITY_CHARS)}, {p}), {ref})",
    )


def _numeric_reference(ref: str) -> str:
    """Character of ``&#n;`` or ``&#xh;``; U+FFFD where the number is no character."""
    digits = f"regexp_replace({ref}, '^&#[xX]?0*|;$', '')"
    code = let(
        digits,
        lambda d: f"CASE WHEN {d} = '' OR length({d}) > 7 THEN 0 WHEN rlike({ref}, '^&#[xX]') "
        f"THEN CAST(conv({d}, 16, 10) AS int) ELSE CAST({d} AS int) END",
    )

    def char(c: str) -> str:
        return (
            f"CASE WHEN {c} = 0 OR {c} > 1114111 OR {c} BETWEEN 55296 AND 57343 "
            f"THEN {text(chr(0xFFFD))} WHEN {c} BETWEEN 128 AND 159 "
            f"THEN element_at({_table(_WINDOWS_JSON)}, CAST({c} AS string)) "
            f"ELSE decode(unhex(lpad(hex({c}), 8, '0')), 'UTF-32') END"
        )

    return let(code, char)


def unescape(value: str) -> str:
    """Decode character references.

    The handful of names that make up almost all references take a chain of
    plain replacements; only text holding others pays for the full table.
    """

    def decode(t: str) -> str:
        r, g, d = fresh(), fresh(), fresh()
        pattern = text(_ENTITY_PATTERN)
        one = (
            f"if(startswith({r}, '&#'), {_numeric_reference(r)}, "
            f"{_named_reference(r)})"
        )
        full = (
            f"array_join(zip_with(split({t}, {pattern}, -1), "
            f"transform(regexp_extract_all({t}, {pattern}, 0), {r} -> {one}), "
            f"({g}, {d}) -> concat({g}, coalesce({d}, ''))), '')"
        )
        return (
            f"CASE WHEN NOT contains({t}, '&') THEN {t} "
            f"WHEN rlike({t}, {text(_RARE_ENTITY)}) THEN {full} ELSE {replaced(t, _COMMON)} END"
        )

    return let(value, decode)


def strip_opaque(page: str) -> str:
    """The page without comments, scripts and style sheets."""
    return f"regexp_replace({page}, {text(f'(?is){OPAQUE}')}, '')"


def text_nodes(page: str) -> str:
    """Array of the stripped, non-empty text nodes in document order."""
    t, u = fresh(), fresh()
    pieces = f"split({page}, {text(SEPARATOR)}, -1)"
    return f"filter(transform({pieces}, {t} -> {strip(unescape(t))}), {u} -> {u} <> '')"


def html_to_text(page: str) -> str:
    """Plain text of a page or fragment: one line per text node."""
    return f"array_join({text_nodes(page)}, {text(chr(10))})"


def attributes(tag: str) -> str:
    """Array of struct(name, value) of a start tag."""
    n, v = fresh(), fresh()
    pattern = text(ATTRIBUTE)
    bare = f"regexp_replace({v}, {text(QUOTED)}, '$1$2')"
    pairs = (
        f"zip_with(regexp_extract_all({tag}, {pattern}, 1), regexp_extract_all({tag}, {pattern}, 2), "
        f"({n}, {v}) -> named_struct('name', lower({n}), 'value', {unescape(bare)}))"
    )
    # The first entry is the tag's own name.
    return let(pairs, lambda p: f"slice({p}, 2, size({p}))")


def _named(attrs: str, name: str) -> str:
    """Value of one attribute ('' when it has none, NULL when absent; the last one wins)."""
    a = fresh()
    return f"try_element_at(filter({attrs}, {a} -> {a}.name = {text(name)}), -1).value"


def hrefs(page: str) -> str:
    """The ``href`` of every anchor of the whole page, in document order."""
    a, h = fresh(), fresh()
    anchors = matches(strip_opaque(page), ANCHOR)
    found = f"transform({anchors}, {a} -> {_named(attributes(a), 'href')})"
    return f"filter({found}, {h} -> {h} IS NOT NULL)"


def _first_element(clean: str, name: str) -> str:
    """Inner markup of the first element ``name`` (NULL when there is none)."""
    start = rf"(?is)<{name}(?=[\s/>]){ATTRS}>"
    whole = text(rf"{start}(.*?)(?:</{name}\s*>|\z)")
    return f"if(rlike({clean}, {text(start)}), regexp_extract({clean}, {whole}, 1), NULL)"


def _heading(clean: str, name: str) -> str:
    """Text of the first heading of a kind: its nodes joined without a separator."""
    return f"array_join({text_nodes(_first_element(clean, name))}, '')"


def _title_text(clean: str) -> str:
    """Stripped ``<title>`` if it holds exactly one string, else NULL."""
    t = fresh()
    pieces = f"split({_first_element(clean, 'title')}, {text(INNER_TAG)}, -1)"
    return let(
        f"filter({pieces}, {t} -> {t} <> '')",
        lambda p: f"if(size({p}) = 1, {strip(unescape(f'get({p}, 0)'))}, NULL)",
    )


def _meta_title(clean: str) -> str:
    """Content of og:title, or of twitter:title when no og:title tag exists at all."""
    m = fresh()

    def first(metas: str, key: str, value: str) -> str:
        a = fresh()
        return f"try_element_at(filter({metas}, {a} -> {_named(a, key)} = {text(value)}), 1)"

    def pick(ms: str) -> str:
        card = f"coalesce({first(ms, 'property', 'og:title')}, {first(ms, 'name', 'twitter:title')})"
        return f"nullif({let(card, lambda c: _named(c, 'content'))}, '')"

    metas = matches(clean, META)
    return let(f"transform({metas}, {m} -> {attributes(m)})", pick)


def extract_title(page: str, url: str, mode: str = "v2") -> str:
    """Title of a page.

    v2: first h1, else first h2, else first h3 with text, else the social-card
    title, else ``<title>``, else the last URL segment, else the URL. v1: the
    first h1 even if empty, else ``<title>``, else the URL.
    """

    def v2(clean: str) -> str:
        heads = ", ".join(f"nullif({_heading(clean, h)}, '')" for h in ("h1", "h2", "h3"))
        return (
            f"coalesce({heads}, {_meta_title(clean)}, {_title_text(clean)}, "
            f"nullif({last_segment(url)}, ''), {url})"
        )

    def v1(clean: str) -> str:
        return f"coalesce({_heading(clean, 'h1')}, {_title_text(clean)}, {url})"

    return let(strip_opaque(page), {"v1": v1, "v2": v2}[mode])


def decorate_title(title: str, url: str, mode: str = "v2") -> str:
    return f"concat({title}, ' (', {url}, ')')" if mode == "v2" else title


def image_source(attrs: str, mode: str = "v2") -> str:
    """First non-empty address among the attributes an image may keep it in."""
    return f"coalesce({', '.join(f'nullif({_named(attrs, n)}, {text(str())})' for n in IMAGE_SOURCES[mode])})"


def image_tags(content: str) -> str:
    return matches(content, IMAGE)


def _quoted(value: str) -> str:
    escapes = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return f"concat('=\"', {replaced(value, escapes)}, '\"')"


def _rewrite_image(tag: str, base: str, mode: str) -> str:
    style = text(IMAGE_STYLE[mode])

    def rebuild(i: str) -> str:
        a, b, c = fresh(), fresh(), fresh()
        has_source = f"{i}.source IS NOT NULL"
        styled = "true" if mode == "v1" else has_source
        value = (
            f"CASE WHEN {a}.name = 'src' AND {has_source} THEN {i}.source "
            f"WHEN {a}.name = 'style' AND {styled} THEN {style} ELSE {a}.value END"
        )
        kept = f"transform({i}.attrs, {a} -> concat({a}.name, {_quoted(value)}))"
        no_src = f"NOT exists({i}.attrs, {b} -> {b}.name = 'src')"
        no_style = f"NOT exists({i}.attrs, {c} -> {c}.name = 'style')"
        none = "CAST(array() AS array<string>)"
        source = _quoted(f"{i}.source")
        return (
            f"concat('<img ', array_join(concat({kept}, "
            f"if({has_source} AND {no_src}, array(concat('src', {source})), {none}), "
            f"if({styled} AND {no_style}, array(concat('style', {_quoted(style)})), {none})), "
            "' '), '/>')"
        )

    def with_source(attrs: str) -> str:
        absolute = let(
            image_source(attrs, mode), lambda s: f"coalesce({resolve_url(base, s)}, {s})"
        )
        return let(f"named_struct('attrs', {attrs}, 'source', {absolute})", rebuild)

    return let(attributes(tag), with_source)


def fix_image_urls(content: str, base: str, mode: str = "v2") -> str:
    """Make image addresses absolute and give images a responsive style.

    v2 also accepts lazy-loading attributes and leaves images without address
    alone; v1 reads ``src`` only and styles every image.
    """
    t, g, i = fresh(), fresh(), fresh()
    # Comments, scripts and styles are pieces of their own and stay as they are.
    pattern = f"(?is){OPAQUE}|{IMAGE.removeprefix('(?is)')}"
    piece = text(pattern)
    rewritten = f"if(rlike({t}, '(?i)^<img'), {_rewrite_image(t, base, mode)}, {t})"
    images = f"transform({matches(content, pattern)}, {t} -> {rewritten})"
    woven = (
        f"array_join(zip_with(split({content}, {piece}, -1), {images}, "
        f"({g}, {i}) -> concat({g}, coalesce({i}, ''))), '')"
    )
    return f"if(rlike({content}, {text(IMAGE)}), {woven}, {content})"

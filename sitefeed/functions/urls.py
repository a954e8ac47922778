"""URL expressions: normalisation, resolution against a base, site identity.

All functions take and return SQL expression text and stay inside the JVM.
``parse_url`` is not used: it raises under ANSI mode on the malformed URLs real
pages contain.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.functions.exprs import fresh, let, strings, text

# RFC 3986 appendix B, with the scheme alphabet of section 3.1.
SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
FRAGMENT = r"(?s)^[^#]*#(.*)$"

# Schemes whose references resolve hierarchically, and whose last path segment may
# carry ";params", as the standard library knows them.
RELATIVE_SCHEMES = tuple(urllib.parse.uses_relative)
PARAM_SCHEMES = tuple(urllib.parse.uses_params)
NETLOC_SCHEMES = tuple(urllib.parse.uses_netloc)

# A starter set of public suffix rules. Pass the full public list
# to ``site_domains`` as a table, or a longer tuple to ``registrable_domain``.
DEFAULT_SUFFIXES = (
    "com", "net", "org", "info", "biz", "edu", "gov", "io", "dev", "app", "ai",
    "co", "me", "tv", "eu", "us", "uk", "de", "fr", "es", "it", "nl", "be", "ch",
    "at", "se", "no", "dk", "fi", "pl", "cz", "pt", "ie", "ru", "ca", "au", "nz",
    "jp", "cn", "kr", "tw", "hk", "in", "br", "mx", "ar", "za",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "com.cn", "net.cn", "org.cn", "com.tw",
    "com.hk", "co.kr", "co.in", "com.br", "com.mx", "com.ar", "co.za",
    "*.ck", "!www.ck",
)


def _part(url: str, pattern: str) -> str:
    return f"regexp_extract({url}, {text(pattern)}, 1)"


def _clean(url: str) -> str:
    """Drop leading control characters and spaces, and tabs and line breaks anywhere."""
    led = text(r"^[\x00-\x20]+")
    return f"translate(regexp_replace({url}, {led}, ''), {text(chr(9) + chr(13) + chr(10))}, '')"


def split_url(url: str) -> str:
    """Struct(scheme, netloc, path, params, query, fragment); absent parts are ''."""

    def parts(u: str) -> str:
        def params(q: str) -> str:
            has = f"({q}.scheme IN ({strings(PARAM_SCHEMES)}) AND contains({q}.path, ';'))"
            before = _part(f"{q}.path", r"(?s)^((?:.*/)?[^/;]*)(?:;[^/]*)?$")
            after = _part(f"{q}.path", r"(?s)^(?:.*/)?[^/;]*;([^/]*)$")
            return (
                f"named_struct('scheme', {q}.scheme, 'netloc', {_part(u, NETLOC)}, "
                f"'path', if({has}, {before}, {q}.path), 'params', if({has}, {after}, ''), "
                f"'query', {_part(u, QUERY)}, 'fragment', {_part(u, FRAGMENT)})"
            )

        base = f"named_struct('scheme', lower({_part(u, SCHEME)}), 'path', {_part(u, PATH)})"
        return let(base, params)

    return let(_clean(url), parts)


def join_url(scheme: str, netloc: str, path: str, params: str, query: str, fragment: str) -> str:
    """Assemble URL parts; the inverse of ``split_url`` up to empty delimiters."""

    def mark(sign: str, part: str) -> str:
        return f"if({part} <> '', concat('{sign}', {part}), '')"

    def with_authority(p: str) -> str:
        rooted = f"if({p} <> '' AND NOT startswith({p}, '/'), concat('/', {p}), {p})"
        bare_root = (
            f"({scheme} <> '' AND {scheme} IN ({strings(NETLOC_SCHEMES)}) "
            f"AND ({p} = '' OR startswith({p}, '/')))"
        )
        return (
            f"CASE WHEN {netloc} <> '' THEN concat('//', {netloc}, {rooted}) "
            f"WHEN startswith({p}, '//') OR {bare_root} THEN concat('//', {p}) ELSE {p} END"
        )

    located = let(f"concat({path}, {mark(';', params)})", with_authority)
    return (
        f"concat(if({scheme} <> '', concat({scheme}, ':'), ''), {located}, "
        f"{mark('?', query)}, {mark('#', fragment)})"
    )


def normalize_url(url: str) -> str:
    """Visit key of a URL: no query, no fragment, no trailing slashes.

    The scheme is lower-cased; host case, port, ``www.`` and ``;params`` stay.
    """

    def join(p: str) -> str:
        whole = join_url(f"{p}.scheme", f"{p}.netloc", f"{p}.path", f"{p}.params", "''", "''")
        return f"rtrim('/', {whole})"

    return let(split_url(url), join)


def _bad_netloc(netloc: str) -> str:
    """True for unbalanced or meaningless ``[...]`` hosts."""
    fine = text(
        r"^[^\[\]]*\[(?:[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*(?:%[^\[\]]*)?|[vV][0-9A-Fa-f]+\..+)\][^\[\]]*$"
    )
    return f"(rlike({netloc}, {text(r'[\[\]]')}) AND NOT rlike({netloc}, {fine}))"


def _resolve_path(base_path: str, path: str) -> str:
    """Merge a reference path with the base path and remove dot segments."""
    base_dir = _part(base_path, r"(?s)^(.*/)[^/]*$")
    rooted = f"startswith({path}, '/')"
    merged = f"if({rooted}, {path}, concat({base_dir}, {path}))"

    def fold(segments: str) -> str:
        s, i, stack, t = fresh(), fresh(), fresh(), fresh()
        # Merging with a base drops empty middle segments; a rooted path keeps them.
        kept = (
            f"filter({segments}, ({s}, {i}) -> {rooted} OR {i} = 0 "
            f"OR {i} = size({segments}) - 1 OR {s} <> '')"
        )
        step = (
            f"CASE WHEN {t} = '..' THEN slice({stack}, 1, greatest(size({stack}) - 1, 0)) "
            f"WHEN {t} = '.' THEN {stack} ELSE concat({stack}, array({t})) END"
        )
        folded = f"aggregate({kept}, CAST(array() AS array<string>), ({stack}, {t}) -> {step})"
        tail = (
            f"if(element_at({segments}, -1) IN ('.', '..'), array(''), "
            "CAST(array() AS array<string>))"
        )
        return let(f"array_join(concat({folded}, {tail}), '/')", lambda j: f"if({j} = '', '/', {j})")

    return let(f"split({merged}, '/')", fold)


def resolve_url(base: str, href: str) -> str:
    """Absolute URL of ``href`` found on the page ``base``.

    RFC 3986 resolution with dot-segment removal. A reference whose host is
    malformed gives NULL, so that only this one link is lost.
    """

    def resolve(p: str) -> str:
        b, r, scheme = f"{p}.base", f"{p}.ref", f"{p}.scheme"

        def rebuilt(netloc: str, path: str, params: str, query: str) -> str:
            return join_url(scheme, netloc, path, params, query, f"{r}.fragment")

        query = f"if({r}.query <> '', {r}.query, {b}.query)"
        return (
            f"CASE WHEN {_bad_netloc(f'{r}.netloc')} OR {_bad_netloc(f'{b}.netloc')} THEN NULL "
            f"WHEN {scheme} <> {b}.scheme OR {scheme} NOT IN ({strings(RELATIVE_SCHEMES)}) "
            f"THEN {p}.href "
            f"WHEN {r}.netloc <> '' AND {scheme} IN ({strings(NETLOC_SCHEMES)}) "
            f"THEN {rebuilt(f'{r}.netloc', f'{r}.path', f'{r}.params', f'{r}.query')} "
            f"WHEN {r}.path = '' AND {r}.params = '' "
            f"THEN {rebuilt(f'{b}.netloc', f'{b}.path', f'{b}.params', query)} "
            f"ELSE {rebuilt(f'{b}.netloc', _resolve_path(f'{b}.path', f'{r}.path'), f'{r}.params', f'{r}.query')} END"
        )

    def with_scheme(q: str) -> str:
        scheme = f"if({q}.ref.scheme <> '', {q}.ref.scheme, {q}.base.scheme)"
        return let(
            f"named_struct('base', {q}.base, 'ref', {q}.ref, 'href', {q}.href, 'scheme', {scheme})",
            resolve,
        )

    both = f"named_struct('base', {split_url(base)}, 'ref', {split_url(href)}, 'href', {href})"
    return (
        f"CASE WHEN {href} = '' THEN {base} WHEN {base} = '' THEN {href} "
        f"ELSE {let(both, with_scheme)} END"
    )


def is_fetchable(url: str) -> str:
    """Only http(s) links can become articles."""
    return f"rlike({url}, '^https?:')"


def url_host(url: str) -> str:
    """Lower-case host without user info, port and trailing dot."""
    netloc = _part(_clean(url), NETLOC)
    bare = f"regexp_replace(regexp_replace({netloc}, '^.*@', ''), {text(r':[0-9]*$')}, '')"
    return f"lower(rtrim('.', {bare}))"


def last_segment(url: str) -> str:
    return f"element_at(split({url}, '/'), -1)"


def _is_address(host: str) -> str:
    return f"(rlike({host}, '^[0-9.]+$') OR startswith({host}, '['))"


def _label_tails(host: str) -> str:
    """All dot-separated tails of a host, longest first."""
    _, i = fresh(), fresh()
    return let(
        f"split({host}, '[.]')",
        lambda ls: f"transform({ls}, ({_}, {i}) -> array_join(slice({ls}, {i} + 1, size({ls})), '.'))",
    )


def registrable_domain(url: str, suffixes: Sequence[str] = DEFAULT_SUFFIXES) -> str:
    """Public suffix plus one label, as an expression over a small rule set.

    Hosts without a known suffix (and addresses) are their own site. Rules are
    plain (``co.uk``), wildcard (``*.ck``) or exception (``!www.ck``). The full
    public list is better passed as a table to ``with_domain``, which looks each
    host up once instead of carrying all rules in an expression.
    """
    exceptions = strings([s[1:] for s in suffixes if s.startswith("!")] or [""])
    wildcards = strings([s[2:] for s in suffixes if s.startswith("*.")] or ["-"])
    plain = strings([s for s in suffixes if s[0] not in "!*"] or [""])

    def find(p: str) -> str:
        tail, i = fresh(), fresh()
        parent = f"regexp_replace({tail}, '^[^.]*[.]?', '')"
        suffix_at = (
            f"CASE WHEN {tail} IN ({exceptions}) THEN {i} + 1 "
            f"WHEN {tail} IN ({plain}) OR {parent} IN ({wildcards}) THEN {i} END"
        )
        first = f"array_min(transform({p}.tails, ({tail}, {i}) -> {suffix_at}))"
        return let(
            first,
            lambda f: f"if({f} IS NULL OR {f} < 1 OR {_is_address(f'{p}.host')}, {p}.host, "
            f"element_at({p}.tails, greatest({f}, 1)))",
        )

    return let(
        url_host(url),
        lambda h: let(f"named_struct('host', {h}, 'tails', {_label_tails(h)})", find),
    )


def with_domain(
    table: DataFrame, url_col: str, name: str, rules: DataFrame | Sequence[str] = DEFAULT_SUFFIXES
) -> DataFrame:
    """``table`` with the registrable domain of its URLs as column ``name``.

    ``rules`` is a sequence of suffix rules or a DataFrame with a column ``rule``
    of any length; see ``site_domains``.
    """
    if not isinstance(rules, DataFrame):
        return table.withColumn(name, F.expr(registrable_domain(url_col, rules)))
    found = site_domains(table, rules, url_col).select(F.col("host").alias("_host"), F.col("domain").alias(name))
    keyed = table.withColumn("_url_host", F.expr(url_host(url_col)))
    return keyed.join(found, F.col("_url_host") == F.col("_host"), "left").drop("_host", "_url_host")


def site_domains(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, domain) for every distinct host, by a join with a full rule table.

    ``rules`` has one column ``rule``. Hosts are reduced before the join, so the
    join input is small next to the URLs; its strategy is left to the optimizer,
    which broadcasts the rules only when their measured size allows it.
    """
    hosts = urls.select(F.expr(url_host(url_col)).alias("host")).distinct()
    tails = hosts.select("host", F.posexplode(F.expr(_label_tails("host"))).alias("i", "tail"))
    rule = F.col("rule")
    kinds = rules.select(
        F.regexp_replace(rule, r"^(?:!|\*\.)", "").alias("tail"),
        # A wildcard covers one label more than its tail, an exception one less.
        F.when(rule.startswith("!"), 1).when(rule.startswith("*."), -1).otherwise(0).alias("shift"),
    )
    best = (
        tails.join(kinds, "tail")
        .where(F.col("i") + F.col("shift") >= 0)
        .groupBy("host")
        .agg(
            F.max(F.when(F.col("shift") == 1, F.col("i") + 1)).alias("exception"),
            F.min(F.when(F.col("shift") < 1, F.col("i") + F.col("shift"))).alias("longest"),
        )
        .select("host", F.coalesce("exception", "longest").alias("first"))
    )
    host, first = F.col("host"), F.col("first")
    labels = F.split(host, r"\.")
    cut = F.array_join(F.slice(labels, F.greatest(first, F.lit(1)), F.size(labels)), ".")
    return hosts.join(best, "host", "left").select(
        "host",
        F.when(first.isNull() | (first < 1) | F.expr(_is_address("host")), host).otherwise(cut).alias("domain"),
    )

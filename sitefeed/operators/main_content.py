"""Main content of a page by paragraph scoring, as a relational job.

The published Arc90 readability method: paragraphs give points to their parent
and half of them to their grandparent; element kind, class names and link
density adjust the score; the best element wins and takes fitting siblings
along. A fold over the tags of a page gives its blocks with what paragraphs gave
them; scoring and choosing are expressions over that array. So main content is a
projection of the page, evaluated in the JVM: no row leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefeed.functions import html
from sitefeed.functions.exprs import fresh, let, matches, strings, strip, text, with_computed

# Fixed values of the published method: tag weights, class name hints, limits.
TAG_WEIGHT = {
    "div": 5,
    "pre": 3, "td": 3, "blockquote": 3,
    "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3,
    "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5,
}
CLASS_WEIGHT = 25
NEGATIVE_CLASS = (
    "(?i)combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo"
    "|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget"
)
POSITIVE_CLASS = (
    "(?i)article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
)
MIN_PARAGRAPH = 25
CHARS_PER_POINT, MAX_LENGTH_POINTS = 100, 3
SIBLING_SHARE, MIN_SIBLING_SCORE = 0.2, 10
LONG_SIBLING, MAX_LINK_DENSITY = 80, 0.25

# Elements that make up the block table; all others only carry text.
BLOCKS = frozenset(
    "html body article section main header footer nav aside div p pre td th tr table tbody "
    "thead tfoot ul ol li dl dt dd blockquote form fieldset address figure figcaption details "
    "h1 h2 h3 h4 h5 h6 center".split()
)
# An open element of the first kind ends where one of the second kind starts.
IMPLIED_END = {
    "p": BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "html", "body"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "tr": {"tr"},
}
ROOTS = frozenset({"html", "body"})
SCOPES = frozenset("ul ol dl table td th div article section body".split())

BLOCK_FIELDS = {
    "block_id": "int",
    "parent_id": "int",
    "grandparent_id": "int",
    "tag": "string",
    "class_id": "string",
    "text_len": "int",
    "n_commas": "int",
    "link_len": "int",
    "has_blocks": "boolean",
    "ends_sentence": "boolean",
    "start": "int",
    "length": "int",
    "given": "double",
}
_BLOCK = f"struct<{', '.join(f'{n}:{t}' for n, t in BLOCK_FIELDS.items())}>"
_BLOCK_TAG = rf"(?is){html.OPAQUE}{html.TEMPLATE}|</?[a-z!][^\s/>]*+{html.ATTRS}>"
_CLASS = r"""(?i)\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _block(block: str, **changed: str) -> str:
    """A block row with some fields set anew."""
    values = ", ".join(f"'{n}', {changed.get(n, f'{block}.{n}')}" for n in BLOCK_FIELDS)
    return f"named_struct({values})"


def _ended_by(name: str) -> str:
    """The kinds of open elements that end where an element ``name`` starts."""
    ended: dict[tuple[str, ...], list[str]] = {}
    for start in sorted(BLOCKS):
        kinds = tuple(k for k, ends in IMPLIED_END.items() if start in ends)
        if kinds:
            ended.setdefault(kinds, []).append(start)
    cases = " ".join(f"WHEN {name} IN ({strings(names)}) THEN array({strings(kinds)})" for kinds, names in ended.items())
    return f"CASE {cases} ELSE CAST(array() AS array<string>) END"


def _tags(page: str) -> str:
    """Every tag of a page with what is needed of the text before it; the last one is the page's end."""
    g, m = fresh(), fresh()

    def measured(t: str) -> str:
        return (
            f"named_struct('n', length({t}), 'commas', length({t}) - length(replace({t}, ',', '')), "
            f"'ends', rlike({t}, {text(r'[.]( |' + chr(92) + 'z)')}))"
        )

    def described(tag: str) -> str:
        def named(name: str) -> str:
            classes = fresh()
            found = f"transform(regexp_extract_all({tag}, {text(_CLASS)}, 1), {classes} -> btrim({classes}, {text(chr(34) + chr(39))}))"
            known = f"{name} IN ({strings(sorted(BLOCKS))})"
            return (
                f"named_struct('before', length({g}), 'text', {let(strip(html.unescape(g)), measured)}, "
                f"'size', length({tag}), 'name', {name}, 'is_end', startswith({tag}, '</'), 'is_block', {known}, "
                f"'classes', if({known}, array_join({found}, ' '), ''), 'ended', {_ended_by(name)})"
            )

        return let(f"lower(regexp_extract({tag}, {text('(?s)^</?([a-zA-Z!][^ ' + chr(92) + 's/>]*)')}, 1))", named)

    pieces, found = f"split({page}, {text(_BLOCK_TAG)}, -1)", matches(page, _BLOCK_TAG)
    whole = let(f"coalesce({m}, '')", described)
    return f"zip_with({pieces}, {found}, ({g}, {m}) -> {whole})"


def _with_text(blocks: str, piece: str, in_link: str) -> str:
    """The open blocks after a piece of text: it counts for the innermost one."""

    def top(b: str) -> str:
        changed = _block(
            b, text_len=f"{b}.text_len + {piece}.n", n_commas=f"{b}.n_commas + {piece}.commas",
            link_len=f"{b}.link_len + if({in_link}, {piece}.n, 0)", ends_sentence=f"{b}.ends_sentence OR {piece}.ends",
        )
        return f"concat(slice({blocks}, 1, size({blocks}) - 1), array({changed}))"

    return f"if({piece}.n = 0 OR size({blocks}) = 0, {blocks}, {let(f'element_at({blocks}, -1)', top)})"


def _paragraph_points(b: str) -> str:
    """Points that a closed block gives away (0: it is no paragraph, or a short one)."""
    is_paragraph = f"({b}.tag IN ('p', 'td', 'pre') OR {b}.tag = 'div' AND NOT {b}.has_blocks)"
    points = f"1.0D + {b}.n_commas + least({b}.text_len div {CHARS_PER_POINT}, {MAX_LENGTH_POINTS})"
    return f"if({is_paragraph} AND {b}.text_len >= {MIN_PARAGRAPH}, {points}, 0.0D)"


def _closed(state: str, n: str, inner_end: str, outer_end: str) -> str:
    """State (open, done) with the ``n`` innermost blocks closed; the outermost of them ends at ``outer_end``.

    What a block holds counts for the block around it as well. A paragraph gives its points to
    the block around it and half of them to the next one; both are still open, or close with it.
    """

    def total(blocks: str, field: str) -> str:
        acc, b = fresh(), fresh()
        return f"aggregate({blocks}, 0, ({acc}, {b}) -> {acc} + {b}.{field})"

    def sized(ending: str) -> str:
        b, i, x = fresh(), fresh(), fresh()
        inside = f"slice({ending}, {i} + 1, size({ending}))"
        row = _block(
            b, text_len=total(inside, "text_len"), n_commas=total(inside, "n_commas"), link_len=total(inside, "link_len"),
            has_blocks=f"({b}.has_blocks OR {i} < size({ending}) - 1)",
            ends_sentence=f"exists({inside}, {x} -> {x}.ends_sentence)",
            length=f"if({i} = 0, {outer_end}, {inner_end}) - {b}.start",
        )
        return f"transform({ending}, ({b}, {i}) -> {row})"

    def close(rows: str) -> str:
        r = fresh()

        def pay(points: str) -> str:
            b, i, o, k = fresh(), fresh(), fresh(), fresh()

            def due(level: str) -> str:
                return f"coalesce(get({points}, {level}), 0.0D) + coalesce(get({points}, {level} + 1), 0.0D) / 2"

            done = f"transform({rows}, ({b}, {i}) -> {_block(b, given=f'{b}.given + {due(f'{i} + 1')}')})"
            left = f"size({state}.open) - size({rows})"
            outer = f"get({rows}, 0)"
            around = _block(
                o, text_len=f"{o}.text_len + {outer}.text_len", n_commas=f"{o}.n_commas + {outer}.n_commas",
                link_len=f"{o}.link_len + {outer}.link_len", has_blocks="true",
                ends_sentence=f"({o}.ends_sentence OR {outer}.ends_sentence)", given=f"{o}.given + {due('0')}",
            )
            beyond = _block(o, given=f"{o}.given + get({points}, 0) / 2")
            rest = (
                f"transform(slice({state}.open, 1, {left}), ({o}, {k}) -> CASE WHEN {k} = {left} - 1 THEN {around} "
                f"WHEN {k} = {left} - 2 THEN {beyond} ELSE {o} END)"
            )
            return f"named_struct('open', {rest}, 'done', concat({state}.done, {done}))"

        return let(f"transform({rows}, {r} -> {_paragraph_points(r)})", pay)

    ending = f"slice({state}.open, size({state}.open) - {n} + 1, {n})"
    return f"if({n} = 0, {state}, {let(let(ending, sized), close)})"


def _opened(blocks: str, number: str, tag: str, classes: str, start: str) -> str:
    """The open blocks with a new innermost one."""

    def child(parent: str) -> str:
        return (
            f"concat({blocks}, array(named_struct('block_id', {number}, 'parent_id', coalesce({parent}.block_id, -1), "
            f"'grandparent_id', coalesce({parent}.parent_id, -1), 'tag', {tag}, 'class_id', {classes}, 'text_len', 0, "
            f"'n_commas', 0, 'link_len', 0, 'has_blocks', false, 'ends_sentence', false, 'start', {start}, 'length', 0, 'given', 0.0D)))"
        )

    return let(f"try_element_at({blocks}, -1)", child)


def page_blocks(page: str) -> str:
    """Array of the block elements of a page (BLOCK_FIELDS), innermost first: a fold over its tags.

    The state holds the stack of open blocks. Text counts for the innermost open block
    and, when that closes, for the one around it. An end tag closes its element and all
    within; a start tag first closes what may not go on around it.
    """
    s, t, f = fresh(), fresh(), fresh()
    none = f"CAST(array() AS array<{_BLOCK}>)"
    zero = f"named_struct('cursor', 0, 'in_link', false, 'n', 0, 'open', {none}, 'done', {none})"
    start, end = f"({s}.cursor + {t}.before)", f"({s}.cursor + {t}.before + {t}.size)"

    def first(kinds: str, test) -> str:
        """How many blocks, from the innermost one out, up to the first that passes the test (0: none does)."""
        k = fresh()
        return f"CAST(array_position(transform({kinds}, {k} -> {test(k)}), true) AS int)"

    def at_end(state: str, kinds: str) -> str:
        return let(first(kinds, lambda k: f"{k} = {t}.name"), lambda n: _closed(state, n, start, end))

    def at_start(state: str, kinds: str) -> str:
        implied, scope = first(kinds, lambda k: f"array_contains({t}.ended, {k})"), first(kinds, lambda k: f"{k} IN ({strings(sorted(SCOPES))})")
        n = let(
            f"named_struct('implied', {implied}, 'scope', {scope})",
            lambda p: f"if({p}.scope > 0 AND {p}.scope < {p}.implied, 0, {p}.implied)",
        )

        def rooted(c: str) -> str:
            # Fragments without html and body tags still have a body.
            lacks = f"(size({c}.open) = 0 AND {t}.name NOT IN ({strings(sorted(ROOTS))}))"
            body = f"if({lacks}, {_opened(f'{c}.open', f'{s}.n', text('body'), text(''), start)}, {c}.open)"
            number = f"({s}.n + if({lacks}, 1, 0))"
            return let(
                body,
                lambda o: f"named_struct('open', {_opened(o, number, f'{t}.name', f'{t}.classes', start)}, "
                f"'done', {c}.done, 'n', {number} + 1)",
            )

        return let(let(n, lambda m: _closed(state, m, start, start)), rooted)

    def step(texted: str) -> str:
        state = f"named_struct('open', {texted}, 'done', {s}.done)"
        k = fresh()

        def tag(both: str) -> str:
            kinds, st = f"{both}.kinds", f"{both}.state"
            with_n = let(at_end(st, kinds), lambda c: f"named_struct('open', {c}.open, 'done', {c}.done, 'n', {s}.n)")
            same = f"named_struct('open', {texted}, 'done', {s}.done, 'n', {s}.n)"
            return f"CASE WHEN NOT {t}.is_block THEN {same} WHEN {t}.is_end THEN {with_n} ELSE {at_start(st, kinds)} END"

        both = f"named_struct('state', {state}, 'kinds', transform(reverse({texted}), {k} -> {k}.tag))"
        return let(
            let(both, tag),
            lambda r: f"named_struct('cursor', {end}, 'in_link', if({t}.name = 'a', NOT {t}.is_end, {s}.in_link), "
            f"'n', {r}.n, 'open', {r}.open, 'done', {r}.done)",
        )

    texted = _with_text(f"{s}.open", f"{t}.text", f"{s}.in_link")
    finish = let(
        _closed(f"named_struct('open', {f}.open, 'done', {f}.done)", f"size({f}.open)", f"{f}.cursor", f"{f}.cursor"),
        lambda c: f"{c}.done",
    )
    return f"aggregate({_tags(page)}, {zero}, ({s}, {t}) -> {let(texted, step)}, {f} -> {finish})"


def block_table(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, BLOCK_FIELDS): one row per block element of every page. Map-only, in the JVM."""
    # The outer form: a plain inline makes Spark filter on the array's size first,
    # which would read each page twice.
    blocks = F.expr(f"inline_outer({page_blocks(f'coalesce(html, {text(str())})')})")
    return pages.select(key, blocks).where(F.col("block_id").isNotNull())


def _points(b: str) -> str:
    """Score of a block: what paragraphs gave it and its own weight, less its share of link text (NULL: no paragraph)."""
    weights: dict[int, list[str]] = {}
    for tag, weight in TAG_WEIGHT.items():
        weights.setdefault(weight, []).append(tag)
    by_tag = " ".join(f"WHEN {b}.tag IN ({strings(tags)}) THEN {w}" for w, tags in sorted(weights.items()))
    by_class = (
        f"if(rlike({b}.class_id, {text(NEGATIVE_CLASS)}), -{CLASS_WEIGHT}, 0) + "
        f"if(rlike({b}.class_id, {text(POSITIVE_CLASS)}), {CLASS_WEIGHT}, 0)"
    )
    raw = f"({b}.given + CASE {by_tag} ELSE 0 END + {by_class})"
    return f"if({b}.given > 0, {raw} * (1 - {_density(b)}), CAST(NULL AS double))"


def _density(b: str) -> str:
    return f"({b}.link_len / greatest({b}.text_len, 1))"


def score_blocks(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Add ``density`` and ``points`` (NULL for elements no paragraph speaks for) to a block table."""
    row = blocks.select(key, F.struct(*BLOCK_FIELDS).alias("b"))
    return row.select(
        key, "b.*", F.expr(_density("b")).alias("density"), F.expr(_points("b")).alias("points")
    )


def main_block_spans(page: str) -> str:
    """Extents of the chosen blocks of a page, in document order; NULL where no paragraph scores.

    The best block, and those of its siblings that score well or are good paragraphs.
    """

    def choose(blocks: str) -> str:
        b, c, x, y = fresh(), fresh(), fresh(), fresh()
        best = (
            f"array_max(transform(filter({blocks}, {b} -> {b}.given > 0), {c} -> "
            f"named_struct('points', {_points(c)}, 'nth', -{c}.block_id, 'parent', {c}.parent_id)))"
        )

        def around(top: str) -> str:
            paragraph = (
                f"{x}.tag = 'p' AND ({x}.text_len > {LONG_SIBLING} AND {_density(x)} < {MAX_LINK_DENSITY} OR "
                f"{x}.text_len BETWEEN 1 AND {LONG_SIBLING} AND {x}.link_len = 0 AND {x}.ends_sentence)"
            )
            good = f"coalesce({_points(x)} >= greatest({MIN_SIBLING_SCORE}, {top}.points * {SIBLING_SHARE}), false)"
            sibling = f"{top}.parent >= 0 AND {x}.parent_id = {top}.parent AND ({good} OR {paragraph})"
            chosen = f"filter({blocks}, {x} -> {x}.block_id = -{top}.nth OR {sibling})"
            spans = f"array_sort(transform({chosen}, {y} -> named_struct('start', {y}.start, 'length', {y}.length)))"
            return f"if({top} IS NULL, NULL, {spans})"

        return let(best, around)

    return let(page_blocks(page), choose)


def main_spans(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, spans): extents of the chosen blocks, in document order. Map-only.

    Pages where no paragraph scores have no row; their content is the whole page.
    """
    found = with_computed(pages.select(key, "html"), "spans", main_block_spans(f"coalesce(html, {text(str())})"))
    return found.where(F.col("spans").isNotNull()).select(key, "spans")


def with_main(pages: DataFrame) -> DataFrame:
    """Add ``main``, the markup of the main content (NULL: the whole page), to rows with ``html``."""
    found = with_computed(pages, "_spans", main_block_spans(f"coalesce(html, {text(str())})"))
    return found.withColumn("main", cut_spans(F.col("html"), F.col("_spans"))).drop("_spans")


def cut_spans(page: Column, spans: Column) -> Column:
    """Markup of the chosen blocks inside one wrapping element."""
    pieces = F.transform(spans, lambda s: F.substring(page, s["start"] + 1, s["length"]))
    return F.concat(F.lit("<div>"), F.array_join(pieces, ""), F.lit("</div>"))

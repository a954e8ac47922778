"""Composing SQL expression text.

The functions of this package take and return SQL expression text, for
``F.expr``, ``selectExpr`` or ``spark.sql``. Page expressions run to hundreds of
nodes; as one text they reach the JVM in one call and parse in milliseconds.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_names = itertools.count()


def fresh() -> str:
    """A lambda variable name not used elsewhere."""
    return f"v{next(_names)}"


def text(value: str) -> str:
    """String literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def strings(values) -> str:
    """Comma-separated string literals, for IN lists."""
    return ", ".join(text(v) for v in values)


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once and use it several times in ``body``."""
    v = fresh()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def strip(value: str) -> str:
    """Unicode-aware strip of both ends."""
    return f"btrim({value}, {text(STRIP_CHARS)})"


def replaced(value: str, pairs) -> str:
    """Chain of plain replacements, applied in the given order."""
    for old, new in pairs:
        value = f"replace({value}, {text(old)}, {text(new)})"
    return value


def matches(value: str, pattern: str) -> str:
    """Array of all matches of a pattern, as ``regexp_extract_all`` with group 0 gives them.

    That function copies the text for each match; here the text is walked through
    twice: matches are marked, then cut out. Text that holds a mark takes the other way.
    """
    begin, end = chr(1), chr(2)

    def cut(v: str) -> str:
        m = fresh()
        marked = f"regexp_replace({v}, {text(f'({pattern})')}, {text(begin + '$1' + end)})"
        pieces = let(f"split({marked}, {text(begin)}, -1)", lambda p: f"slice({p}, 2, size({p}))")
        return (
            f"if(contains({v}, {text(begin)}) OR contains({v}, {text(end)}), regexp_extract_all({v}, {text(pattern)}, 0), "
            f"transform({pieces}, {m} -> substring_index({m}, {text(end)}, 1)))"
        )

    return let(value, cut)


def with_computed(df: DataFrame, name: str, value: str) -> DataFrame:
    """Add ``value`` so that later filters on ``name`` do not compute it again.

    A filter on a projected column is pushed below the projection together with
    a copy of its expression. A one-element generator is a boundary for that.
    """
    return df.select("*", F.expr(f"explode_outer(array({value})) AS {name}"))

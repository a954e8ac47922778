"""RSS 2.0 text: escaping, items, channel head and tail.

All functions take and return SQL expression text.
"""

from __future__ import annotations

from sitefeed.functions.exprs import replaced, text

# The channel texts of a site feed.
CHANNEL_TITLE_SUFFIX = " 全站 RSS"
CHANNEL_DESCRIPTION = "自动生成全站RSS"

XML_ILLEGAL = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n<channel>\n'
TAIL = "</channel>\n</rss>"


MARKUP = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def legal_xml(value: str) -> str:
    """Drop characters XML 1.0 does not allow, so one bad page cannot break a feed."""
    return f"regexp_replace({value}, {text(XML_ILLEGAL)}, '')"


def escape_xml(value: str) -> str:
    return replaced(legal_xml(value), MARKUP)


def cdata(value: str) -> str:
    """CDATA section; an inner ``]]>`` is split over two sections."""
    split = replaced(legal_xml(value), [("]]>", "]]]]><![CDATA[>")])
    return f"concat('<![CDATA[', {split}, ']]>')"


def rss_item(title: str, url: str, content: str) -> str:
    """One item; what is NULL is empty, so no article leaves the feed for a missing part."""
    title, url, content = (f"coalesce({x}, '')" for x in (title, url, content))
    return (
        f"concat({text('<item>' + chr(10) + '<title>')}, {escape_xml(title)}, "
        f"{text('</title>' + chr(10) + '<link>')}, {escape_xml(url)}, "
        f"{text('</link>' + chr(10) + '<description>')}, {cdata(content)}, "
        f"{text('</description>' + chr(10) + '</item>')})"
    )


def channel_head(seed_url: str) -> str:
    base = escape_xml(seed_url)
    return (
        f"concat({text(HEAD + '<title>')}, {base}, "
        f"{text(CHANNEL_TITLE_SUFFIX + '</title>' + chr(10) + '<link>')}, {base}, "
        f"{text('</link>' + chr(10) + '<description>' + CHANNEL_DESCRIPTION + '</description>')})"
    )


def list_label(title: str, mode: str = "v2") -> str:
    """Title as shown in an article list; v1 also turns backticks into quotes."""
    label = replaced(title, (*MARKUP, ('"', "&quot;")))
    return replaced(label, [("`", "'")]) if mode == "v1" else label

"""The block table by a plain walk over the tags with a stack, for comparison."""

from __future__ import annotations

import html as html_lib
import re

from sitefeed.operators.main_content import BLOCKS, IMPLIED_END, ROOTS, SCOPES

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)"
    r"|<template\b.*?(?:</template\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z!][^\s/>]*+)(?P<attrs>(?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""",
    re.I | re.S,
)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SENTENCE_END = re.compile(r"\.( |$)")

class _Block:
    __slots__ = ("row", "tag", "parent")

    def __init__(self, number: int, tag: str, attrs: str, parent: _Block | None, start: int):
        grand = parent.parent if parent else None
        names = " ".join(v.strip("\"'") for v in _CLASS.findall(attrs))
        self.tag, self.parent = tag, parent
        self.row = [
            number,
            parent.row[0] if parent else -1,
            grand.row[0] if grand else -1,
            tag, names, 0, 0, 0, False, False, start, 0,
        ]

    def close(self, end: int) -> None:
        """Fix the extent and pass text counts on to the parent."""
        row = self.row
        row[11] = end - row[10]
        if self.parent:
            up = self.parent.row
            for i in (5, 6, 7):
                up[i] += row[i]
            up[8] = True
            up[9] = up[9] or row[9]


def page_blocks(page: str) -> list[list]:
    """Rows of BLOCK_FIELDS for one page, in document order."""
    rows: list[list] = []
    open_blocks: list[_Block] = []
    in_link = False
    cursor = 0

    def text(upto: int) -> None:
        piece = html_lib.unescape(page[cursor:upto]).strip()
        if piece and open_blocks:
            row = open_blocks[-1].row
            row[5] += len(piece)
            row[6] += piece.count(",")
            row[7] += len(piece) if in_link else 0
            row[9] = row[9] or bool(_SENTENCE_END.search(piece))

    def begin(tag: str, attrs: str, start: int) -> None:
        parent = open_blocks[-1] if open_blocks else None
        block = _Block(len(rows), tag, attrs, parent, start)
        rows.append(block.row)
        open_blocks.append(block)

    def close_down_to(depth: int, end: int) -> None:
        while len(open_blocks) > depth:
            open_blocks.pop().close(end)

    for token in _TOKEN.finditer(page):
        text(token.start())
        cursor = token.end()
        name = (token["name"] or "").lower()
        if name == "a":
            in_link = not token["end"]
        if name not in BLOCKS:
            continue
        if token["end"]:
            for depth in range(len(open_blocks) - 1, -1, -1):
                if open_blocks[depth].tag == name:
                    close_down_to(depth + 1, token.start())
                    close_down_to(depth, token.end())
                    break
            continue
        for depth in range(len(open_blocks) - 1, -1, -1):
            tag = open_blocks[depth].tag
            if name in IMPLIED_END.get(tag, ()):
                close_down_to(depth, token.start())
                break
            if tag in SCOPES:
                break
        if not open_blocks and name not in ROOTS:
            # Fragments without html and body tags still have a body.
            begin("body", "", token.start())
        begin(name, token["attrs"], token.start())
    text(len(page))
    close_down_to(0, len(page))
    return rows

"""State machines over the lines of one text, for Arrow batches.

A document is one row, so these need no shuffle, while windows over exploded lines shuffle
every line twice. The same rules stand as windows in ``operators`` (bold_titles, raw_chunks,
list_items, fold_groups), where lines and items are the result; tests hold the two together.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

FENCE = "```"
BOLD = re.compile(r"\s*\*\*(.+?)\*\*\s*\Z", re.S)
LIST_LINE = re.compile(r"^\s*[-*+]\s+|\^\s*[0-9]+\.\s+")
HEADER = re.compile(r"(?<![^\n])(#{1,6})[^\S\n]+([^\n]+)")
LIST_START = re.compile(r"\s*(?:[-*]|[0-9]+\.)\s+")


def tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def _upper(c: str) -> bool:
    return unicodedata.category(c) == "Lu"


def is_title(bold: str, line: str, max_length: int, least_capitals: float, title_case: bool, lists: bool, tables: bool) -> bool:
    """Whether the bold text of a line alone makes it a title; its surroundings are the caller's."""
    letters = [c for c in bold if c.isalpha()]
    if len(bold) > max_length or not letters or not _upper(letters[0]) or (lists and LIST_LINE.search(line)) or (tables and "|" in line):
        return False
    if title_case:
        words = bold.split()
        if len(words) == 1 or sum(_upper(w[0]) for w in words) / max(1, len(words)) >= 0.5:
            return True
    return sum(map(_upper, letters)) / len(letters) >= least_capitals


def promote(text: str, max_length: int, empty_lines: bool, least_capitals: float, title_case: bool, code: bool, lists: bool, tables: bool) -> str:
    """The text with stand-alone bold lines as headings; all other lines stay byte by byte."""
    if "**" not in text:
        return text
    lines = text.split("\n")
    out, fences, above, nth = lines[:], 0, None, 0
    for i, line in enumerate(lines):
        bare = line.strip()
        fences += bare.startswith(FENCE)
        m = BOLD.match(line) if "**" in line else None
        if m and not (code and fences % 2) and not (empty_lines and (i and lines[i - 1].strip() or i + 1 < len(lines) and lines[i + 1].strip())):
            if is_title(m[1], line, max_length, least_capitals, title_case, lists, tables):
                level = min(above + 1, 3) if above is not None else 2 + nth % 2
                nth += 1
                out[i] = "#" * level + " " + m[1]
        if bare.startswith("#"):
            above = len(bare) - len(bare.lstrip("#"))
    return "\n".join(out)


def header_chunks(text: str, levels: frozenset[int]) -> list[tuple[int, str, tuple[str | None, ...]]]:
    """(position, content, h1..h6) of the chunks of a text that are not blank, numbered before blank ones go."""
    out, heads, last, start, n = [], [None] * 6, None, 0, 0

    def close(end: int) -> None:
        content = text[start:end]
        if content.strip():
            out.append((n, content, tuple(heads)))

    for m in HEADER.finditer(text):
        k = len(m[1])
        if last is not None and k <= last and k in levels:
            close(m.start() - 1)
            start, n = m.start(), n + 1
        last = k
        heads[k - 1 :] = [m[2].strip()] + [None] * (6 - k)
    close(len(text))
    return out


def list_items(text: str, keep_preamble: bool = False) -> list[tuple[str, int]]:
    """(item, depth) of the list items of a text; lines before the first are dropped, or an item of depth 0; others belong to the item above."""
    items: list[list[str]] = []
    before: list[str] = []
    for line in text.split("\n"):
        if LIST_START.match(line):
            items.append([line])
        elif items:
            items[-1].append(line)
        else:
            before.append(line)
    out = [("\n".join(before), 0)] if keep_preamble and any(x.strip() for x in before) else []
    for lines in items:
        lead = lines[0][: len(lines[0]) - len(lines[0].lstrip(" \t"))]
        out.append(("\n".join(lines), len(lead.replace("\t", "    ")) // 2))
    return out


def parents(depths: list[int]) -> list[int | None]:
    """For every item the last earlier one a level up, null at depth 0."""
    last: dict[int, int] = {}
    out = []
    for i, d in enumerate(depths):
        out.append(last.get(d - 1) if d > 0 else None)
        last[d] = i
    return out


def packed(items: list[str], limit: int, depths: list[int] | None = None) -> list[list[str]]:
    """Items in order in groups up to the limit; an item over it is alone. With depths only an item of depth 0 that does not fit starts a group."""
    groups, now, size = [], [], 0
    for i, x in enumerate(items):
        t = tokens(x)
        if depths is None and t > limit:
            groups += [now] * bool(now) + [[x]]
            now, size = [], 0
        elif size + t > limit and (depths is None or (depths[i] == 0 and now)):
            groups += [now] * bool(now)
            now, size = [x], t
        else:
            now.append(x)
            size += t
    return groups + [now] * bool(now)


def pieces(text: str, limit: int) -> tuple[str, list[str]]:
    """(strategy, pieces) of a text over the limit; keep and no pieces if no strategy cuts it."""
    items = list_items(text)
    if len(items) >= 5:
        texts, depths = [x for x, _ in items], [d for _, d in items]
        if max(depths) > 0 and depths.count(0) >= 2:
            groups = packed(texts, limit, depths)
            if len(groups) > 1:
                return "depth", ["\n".join(g) for g in groups]
        groups = packed(texts, limit)
        return ("list", ["\n".join(g) for g in groups]) if len(groups) > 1 else ("keep", [])
    paragraphs = [p for p in text.split("\n\n") if p.strip()]
    if len(paragraphs) >= 3:
        groups = packed(paragraphs, limit)
        if len(groups) > 1:
            return "paragraph", ["\n\n".join(g) for g in groups]
    return "keep", []


def elements(text: str) -> list[tuple[str, int | None, str, tuple[str | None, ...]]]:
    """(category, depth of a title, text, h1..h6) of the blocks of a text: fenced code, titles, list items with the lines that follow, table rows, paragraphs."""
    blocks: list[tuple[str, list[str]]] = []
    fences, was = 0, None
    for line in text.split("\n"):
        bare = line.strip()
        fence = bare.startswith(FENCE)
        fences += fence
        if fences % 2 or fence:
            kind = "CodeSnippet"
        elif not bare:
            kind = ""
        elif HEADER.match(line):
            kind = "Title"
        elif LIST_START.match(line):
            kind = "ListItem"
        else:
            kind = "Table" if bare.startswith("|") else "NarrativeText"
        goes_on = (kind == was and kind in ("NarrativeText", "Table")) or (kind == "CodeSnippet" and not (fence and fences % 2)) or (kind == "NarrativeText" and was == "ListItem")
        if goes_on and blocks:
            blocks[-1][1].append(line)
        else:
            blocks.append((kind, [line]))
        was = kind
    out, heads = [], [None] * 6
    for kind, lines in blocks:
        m = HEADER.match(lines[0]) if kind == "Title" else None
        body = m[2].strip() if m else "\n".join(lines)
        if kind and body.strip():
            if m:
                k = len(m[1])
                heads = heads[: k - 1] + [body] + [None] * (6 - k)
            out.append((kind, len(m[1]) - 1 if m else None, body, tuple(heads)))
    return out


def chunk_id(content: str, position: int) -> str:
    return hashlib.sha256(f"{content}{position}".encode()).hexdigest()[:8]

"""Markup residue in text documents.

Texts become clean text that keeps headings ("# "), lists ("- "), code blocks (fences) and
formulas, and the kinds of markup that were found are reported. Fenced blocks, inline code
and dollar formulas are set aside first and come back unchanged at the end, so nothing inside
them counts as markup or is rewritten. Then four passes follow, from the most to the least
explicit notation: HTML, LaTeX, wiki, inline Markdown; what a pass turns into code is set
aside for the later ones.

Differencing pages of like URLs within a host finds lines that pages share, not markup inside
a text; the tables have no URLs either. So the texts are scanned by notation instead.

Each pattern has a literal that its matches must hold; a text without it skips the pattern.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML.
TAGS = """a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code
col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6
head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option
output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub
summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr""".split()

FENCE = re.compile(r"(?ms)^ {0,3}(```+|~~~+)[^\n]*\n(?:.*?\n)?? {0,3}\1[`~]*[ \t]*\r?$|^ {0,3}(?:```|~~~)(?![^\n]*```).*\Z")
CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
DISPLAY = re.compile(r"\$\$(?=[^$])(?:[^$]|\$(?!\$))+?\$\$")
FORMULA = re.compile(r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?![\d$])")

COMMENT = re.compile(r"(?s)<!--.*?-->")
TAG = re.compile(rf"(?i)<(/?)({'|'.join(sorted(TAGS, key=len, reverse=True))})(?=[\s/>])((?:\s+[^\s<>=/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?)*)\s*/?>")
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
PRE = re.compile(r"(?is)<pre\b[^<>]*>(.*?)</pre>")
INLINE_CODE = re.compile(r"(?is)<(code|kbd|samp|tt)\b[^<>]*>([^`]*?)</\1>")
ALT = re.compile(r"""(?i)\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""")

VERBATIM = re.compile(r"(?s)\\begin\{(verbatim|lstlisting|minted)\}[^\n]*\n?(.*?)\\end\{\1\}")
EQUATION = re.compile(r"(?s)\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}(.*?)\\end\{\1\2\}|\\\[(.*?)\\\]|\\\((.*?)\\\)")
SECTION = re.compile(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")
ITEM = re.compile(r"(?m)^([ \t]*)\\item\b[ \t]*(?:\[([^\]\n]*)\][ \t]*)?")
ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?")
REFERENCE = re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|label|footnote|index|vspace|hspace|includegraphics|usepackage|documentclass|bibliography|bibliographystyle)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}")
SWITCH = re.compile(r"\{\\(?:it|bf|em|tt|sc|rm|sl|sf|itshape|bfseries|small|large|Large)\b\s*([^{}]*)\}")
COMMAND_ARG = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
COMMAND = re.compile(r"\\[A-Za-z]{2,}\*?(?![A-Za-z\\])")

WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+(?:\n[^\[\]\n]+)?)\]\]")
WIKI_QUOTE = re.compile(r"(?<!')('{5}|'{2,3})(?!')(\S(?:[^\n]*?\S)?)\1(?!')")
WIKI_HEADING = re.compile(r"(?m)^[ \t]*(={1,6})[ \t]*([^=\n](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*\r?$")
TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
WIKI_TABLE = re.compile(r"(?ms)^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)")

FOOTNOTE = re.compile(r"\[\^[^\]\s]+\]:?")
IMAGE = re.compile(r"!\[([^\[\]]*)\](?:\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[[^\[\]]*\])")
LINK = re.compile(r"(?<!!)\[([^\[\]]+)\](?:\([^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:\s+\"[^\"]*\")?\)|\[[^\[\]\n]*\])")
DEFINITION = re.compile(r"(?m)^ {0,3}\[[^\[\]^\n]+\]:[ \t]+\S+[^\n]*$")
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])((?:[^~\n]|\n(?!\s*\n))+?)(?<=[^\s~])~~(?!~)")
STARS = re.compile(r"(?<![\\*])(\*{1,3})(?=[^\s*])((?:[^*\n]|\n(?!\s*\n))+?)(?<=[^\s*])\1(?!\*)")
BARS = re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])((?:[^_\n]|\n(?!\s*\n)|(?<=\w)_(?=\w))+?)(?<=[^\s_])\1(?!\w)")


def _page(body: str) -> str:
    """What stays of a wiki link: nothing of a category, the caption of a file, else the last part."""
    parts = [p.strip() for p in body.split("|")]
    space = parts[0].partition(":")[0].strip().lower() if ":" in parts[0] else ""
    if space in ("category", "kategorie", "catégorie", "categoría", "분류"):
        return ""
    if space in ("file", "image", "datei", "fichier", "archivo", "파일") and len(parts) == 1:
        return ""
    return parts[-1].lstrip(":")


def _rows(table: str) -> str:
    """A wiki table as lines of cells."""
    out, row = [], []
    for line in table.splitlines():
        line = line.strip()
        if line.startswith(("{|", "|}", "|-", "|+")):
            out.append(" | ".join(row))
            row = [line[2:].strip()] if line.startswith("|+") and line[2:].strip() else []
        elif line[:1] in "|!" and line:
            row += [c.rpartition("|")[2].strip() if "|" in c else c.strip() for c in re.split(r"!!|\|\|", line[1:])]
        elif line:
            row.append(line)
    out.append(" | ".join(row))
    return "\n".join(x for x in out if x)


class _Aside:
    """Segments that are set aside, each under a mark of a private-use character that the text does not hold."""

    def __init__(self, text: str) -> None:
        self.mark = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text)
        self.held: list[str] = []

    def put(self, segment: str) -> str:
        self.held.append(segment)
        return f"{self.mark}{len(self.held) - 1}{self.mark}"

    def back(self, text: str) -> str:
        find = re.compile(f"{self.mark}(\\d+){self.mark}")
        while self.mark in text:
            text = find.sub(lambda m: self.held[int(m[1])], text)
        return text


def clean(text: str) -> tuple[str, list[str]]:
    """(clean text, the kinds of markup found, sorted). Null-safe callers pass ""."""
    aside, kinds = _Aside(text), set()

    def sub(pattern: re.Pattern, make: Callable[[re.Match], str], t: str, kind: str | None) -> str:
        done, n = pattern.subn(make, t)
        if n and kind:
            kinds.add(kind)
        return done

    hold = lambda m: aside.put(m[0])
    fence = lambda body: aside.put("```\n" + body.strip("\n") + "\n```")
    t = text
    if "```" in t or "~~~" in t:
        t = FENCE.sub(hold, t)
    if "`" in t:
        t = CODE.sub(hold, t)
    if "$" in t:
        t = FORMULA.sub(hold, DISPLAY.sub(hold, t))

    if "<" in t:
        if "<!--" in t:
            t = sub(COMMENT, lambda m: "", t, "html")
        if TAG.search(t):
            kinds.add("html")
            t = PRE.sub(lambda m: "\n" + fence(html.unescape(TAG.sub("", m[1]))) + "\n", t)
            t = INLINE_CODE.sub(lambda m: aside.put("`" + html.unescape(TAG.sub("", m[2])) + "`"), t)
            t = TAG.sub(_tag, t)
    if "&" in t:
        t = sub(ENTITY, lambda m: aside.put(html.unescape(m[0]).replace("\xa0", " ")), t, "html")

    if "\\" in t:
        t = sub(VERBATIM, lambda m: "\n" + fence(m[2]) + "\n", t, "latex")
        t = sub(EQUATION, lambda m: aside.put("$$" + next(x for x in m.groups()[2:] if x is not None).strip() + "$$") if m[1] or m[4] is not None else aside.put("$" + m[5].strip() + "$"), t, "latex")
        t = sub(REFERENCE, lambda m: "", t, "latex")
        levels = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
        t = sub(SECTION, lambda m: "#" * levels[m[1]] + " " + m[2].strip(), t, "latex")
        t = sub(ITEM, lambda m: m[1] + "- " + (m[2] + " " if m[2] else ""), t, "latex")
        t = sub(ENVIRONMENT, lambda m: "", t, "latex")
        t = sub(SWITCH, lambda m: m[1], t, "latex")
        for _ in range(3):
            t = sub(COMMAND_ARG, lambda m: m[1], t, "latex")
        t = sub(COMMAND, lambda m: "", t, "latex")

    if "{|" in t:
        t = sub(WIKI_TABLE, lambda m: _rows(m[0]), t, "wiki")
    if "[[" in t:
        t = sub(WIKI_LINK, lambda m: _page(m[1]), t, "wiki")
    if "{{" in t:
        t = sub(TEMPLATE, lambda m: p[-1].strip() if len(p := m[1].split("|")) > 2 else "", t, "wiki")
    if "''" in t:
        t = sub(WIKI_QUOTE, lambda m: m[2], t, "wiki")
    if "=" in t:
        t = sub(WIKI_HEADING, lambda m: "#" * len(m[1]) + " " + m[2].strip(), t, "wiki")

    if "[" in t:
        t = sub(FOOTNOTE, lambda m: "", t, "markdown")
        t = sub(IMAGE, lambda m: m[1], t, "markdown")
        t = sub(LINK, lambda m: m[1], t, "markdown")
        t = sub(DEFINITION, lambda m: "", t, "markdown")
    if "<" in t:
        t = sub(AUTOLINK, lambda m: m[1], t, "markdown")
    if "~~" in t:
        t = sub(STRIKE, lambda m: m[1], t, "markdown")
    for _ in range(2):  # emphasis inside emphasis
        if "*" in t:
            t = sub(STARS, lambda m: m[2], t, "markdown")
        if "_" in t:
            t = sub(BARS, lambda m: m[2], t, "markdown")
    if kinds:
        t = re.sub(r"[ \t]+(?=\r?\n|\Z)", "", t)
        t = re.sub(r"(\r?\n){3,}", "\n\n", t).strip("\n")
    return aside.back(t), sorted(kinds)


def _tag(m: re.Match) -> str:
    close, name = m[1], m[2].lower()
    if len(name) == 2 and name[0] == "h" and name[1].isdigit():
        return "\n" if close else "\n" + "#" * int(name[1]) + " "
    if name == "li":
        return "" if close else "\n- "
    if name == "img":
        alt = ALT.search(m[3])
        return (alt[1] or alt[2] or "") if alt else ""
    if name in ("td", "th"):
        return " | " if close else ""
    if name in ("br", "p", "div", "tr", "table", "ul", "ol", "hr", "blockquote", "section", "article", "pre", "dt", "dd"):
        return "\n"
    return ""


def converted(texts: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, clean, kinds) of every text.

    A null text is null with no kinds, an empty one empty. Null keys are dropped, rows sent
    twice give one row (of differing texts the smallest clean text stays). Whole texts are
    converted, in the scan's tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                done = [clean(t) if t is not None else (None, []) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], names=["id", "clean", "kinds"])

    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("t"))
    found = rows.mapInArrow(run, "id string, clean string, kinds array<string>")
    return found.groupBy("id").agg(F.min(F.struct("clean", "kinds")).alias("x")).select(F.col("id").alias(key), "x.clean", "x.kinds")


def markup_kinds(texts: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, markup): one row per kind of markup found in a text; only the kinds leave the scan's tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                pairs = [(k, kind) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for kind in clean(t)[1]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())], names=["id", "markup"])

    signs = F.col("t").rlike(r"[<&\\\[{'=*_~]")  # a text without any of these characters has no markup
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("t")).where(signs)
    return rows.mapInArrow(run, "id string, markup string").distinct().withColumnRenamed("id", key)

"""Markup sources: R help, R Markdown, LaTeX archives, arXiv Markdown, and what converts which file."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import convert, office
from .rowwise import rowwise

# ---- R help pages: \macro[option]{argument}{argument}, % begins a comment, \ escapes (Writing R Extensions, chapter 2)

_ARGUMENTS = {"section": 2, "subsection": 2, "item": 2, "href": 2, "method": 2, "S3method": 2, "S4method": 2, "tabular": 2, "eqn": 1, "deqn": 1, "if": 2, "ifelse": 3, "enc": 2}
_QUIET = {"name", "alias", "docType", "keyword", "concept", "encoding", "Rdversion", "author", "references", "RdOpts", "Sexpr", "figure", "if", "dontshow", "testonly"}
_CODE = {"code", "kbd", "samp", "verb", "command", "option", "file", "pkg", "env", "var"}
_VERBATIM = {"usage", "examples"}


def _braced(text: str, at: int) -> tuple[str, int] | None:
    """The argument that begins at ``at`` and the place behind it."""
    if at >= len(text) or text[at] != "{":
        return None
    depth, k = 0, at
    while k < len(text):
        if text[k] == "\\":
            k += 1
        elif text[k] == "{":
            depth += 1
        elif text[k] == "}":
            depth -= 1
            if not depth:
                return text[at + 1 : k], k + 1
        k += 1
    return text[at + 1 :], len(text)


def _rd(text: str, verbatim: bool = False) -> str:
    out, at = [], 0
    for m in iter(lambda: re.compile(r"\\([A-Za-z0-9]+|.)", re.S).search(text, at), None):
        out.append(text[at : m.start()])
        at, macro = m.end(), m[1]
        if not macro[0].isalpha():
            out.append(macro)
            continue
        args = []
        if option := re.compile(r"\[[^\]]*\]").match(text, at):
            at = option.end()
        while len(args) < _ARGUMENTS.get(macro, 1) and (got := _braced(text, at + len(text[at:]) - len(text[at:].lstrip()) if macro in ("item", "section", "subsection") else at)):
            args.append(got[0])
            at = got[1]
        if macro in _QUIET:
            continue
        if macro in ("section", "subsection") and len(args) == 2:
            out.append(f"\n\n{'##' if macro == 'section' else '###'} {_rd(args[0]).strip()}\n\n{_rd(args[1]).strip()}\n\n")
        elif macro == "item":
            out.append("\n- " + (f"`{_rd(args[0], True).strip()}`: {_rd(args[1]).strip()}" if len(args) == 2 else " ".join(map(_rd, args))))
        elif macro in ("dots", "ldots"):
            out.append("...")
        elif macro in ("R", "cr", "tab"):
            out.append({"R": "R", "cr": "\n", "tab": " | "}[macro])
        elif macro == "href" and len(args) == 2:
            out.append(_rd(args[1]))
        elif macro in ("method", "S3method", "S4method") and args:
            out.append(_rd(args[0], True))
        elif macro in _CODE and args and not verbatim:
            out.append(f"`{_rd(args[0], True)}`")
        elif args:
            out.append(_rd(args[-1] if macro in ("tabular", "ifelse") else args[0], verbatim))
    return "".join(out) + text[at:]


def rd_markdown(source: str) -> str:
    """An R help page: its title, then description, usage, arguments and so on as sections."""
    text = re.sub(r"(?m)(?<!\\)%.*$", "", source)
    heads, parts, at = {}, [], 0
    for m in iter(lambda: re.compile(r"(?m)^\\([A-Za-z]+)\s*(?=\{)").search(text, at), None):
        body, at = _braced(text, m.end())
        if m[1] == "title":
            heads["title"] = " ".join(_rd(body).split())
        elif m[1] == "section":
            second, at = _braced(text, at) or ("", at)
            parts.append((" ".join(_rd(body).split()), _rd(second)))
        elif m[1] in _VERBATIM:
            parts.append((m[1].capitalize(), "```r\n" + _rd(body, True).strip("\n") + "\n```"))
        elif m[1] not in _QUIET:
            parts.append((m[1].capitalize(), _rd(body)))
    sections = [f"## {name}\n\n{body.strip()}" for name, body in parts if body.strip()]
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join([f"# {heads['title']}"] * ("title" in heads) + sections))


# ---- R Markdown

_SPAN = re.compile(r"(?P<ticks>`+)(?!`)(?P<code>.*?)(?<!`)(?P=ticks)(?!`)")
_MARKUP = ((re.compile(r"!\[[^\]]*\]\([^)]*\)"), ""), (re.compile(r"\[([^\]]+)\]\((?:[^()]|\([^()]*\))*\)"), r"\1"), (re.compile(r"</?[A-Za-z][^<>]*>"), ""))


def _plain(text: str) -> str:
    for pattern, to in _MARKUP:
        text = pattern.sub(to, text)
    return text


def rmd_cleaned(source: str) -> str:
    """Chunks and inline code as they are; elsewhere comments, tags and images go, and links keep their text."""
    out, fence = [], ""
    for line in re.sub(r"(?s)<!--.*?-->", "", source.replace("\r\n", "\n")).split("\n"):
        ticks = re.match(r"\s*(`{3,}|~{3,})", line)
        if ticks and not fence:
            fence = ticks[1]
        elif ticks and ticks[1].startswith(fence):
            fence = ""
        elif not fence:
            cuts = [0, *[c for m in _SPAN.finditer(line) for c in m.span()], len(line)]
            line = "".join(line[a:b] if k % 2 else _plain(line[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
        out.append(line.rstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


# ---- LaTeX archives: name -> text

_INCLUDE = re.compile(r"\\(?:input|include|subfile)\s*\{([^{}]+)\}")


def _uncommented(tex: str) -> str:
    return re.sub(r"(?m)(?<!\\)%.*$", "", tex)


def main_tex(files: dict[str, str]) -> str | None:
    """The file that begins a document: that with the title, then one that no other includes, then the longest."""
    starts = {n: _uncommented(t) for n, t in files.items() if n.endswith(".tex") and re.search(r"\\begin\s*\{document\}|\\documentstyle", _uncommented(t))}
    included = {posixpath.splitext(i.strip())[0] for t in files.values() for i in _INCLUDE.findall(_uncommented(t))}
    rank = lambda n: ("\\title" in starts[n], posixpath.splitext(n)[0] not in included, len(starts[n]), n)
    return max(starts, key=rank, default=None)


def flattened_tex(files: dict[str, str], name: str, depth: int = 10) -> str:
    """A file without comments, with the files it includes in their places; a file is not put into itself."""

    def put(m: re.Match) -> str:
        asked = posixpath.normpath(posixpath.join(posixpath.dirname(name), m[1].strip()))
        own = next((n for n in (asked, asked + ".tex", m[1].strip(), m[1].strip() + ".tex") if n in files and n != name), None)
        return flattened_tex({n: t for n, t in files.items() if n != name}, own, depth - 1) if own and depth > 0 else ""

    return _INCLUDE.sub(put, _uncommented(files[name]))


def arxiv_cleaned(body: str, title: str, abstract: str = "") -> str:
    """Converted papers: one head, numbered citations, captions for figures, no labels, addresses masked."""
    email = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
    text = email.sub("[email]", re.sub(r"\r\n?", "\n", body))
    caption = lambda m: "" if m[1].strip() in ("", "image") else f"Figure: {m[1].strip()}"
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", caption, text)
    text = re.sub(r"\\label\{[^{}]*\}", "", convert.numbered_citations(text))
    head = [f"# {' '.join(title.split())}"] + [f"## Abstract\n\n{email.sub('[email]', ' '.join(abstract.split()))}"] * bool(abstract.strip())
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join([*head, text.strip()])) + "\n"


# ---- which file is converted how

rd, rmd = rowwise(StringType(), rd_markdown), rowwise(StringType(), rmd_cleaned)
_table = rowwise(StringType(), convert.table_or_text)


def converters(raw: Column) -> dict[tuple[str, ...], tuple[str, Column]]:
    """Extensions -> (kind, Markdown of the binary column)."""
    text = convert.decoded(raw)
    return {
        (".md", ".markdown", ".txt"): ("text", text),
        (".rmd", ".qmd"): ("rmd", rmd(text)),
        (".rd",): ("rd", rd(text)),
        (".html", ".htm", ".xhtml"): ("html", convert.html_page(text)["text"]),
        (".csv", ".tsv", ".tab"): ("table", _table(text)),
        (".xml", ".nxml"): ("jats", convert.jats(text)["text"]),
        (".xlsx", ".xlsm"): ("xlsx", office.xlsx(raw)),
        (".docx",): ("docx", office.docx(raw)),
        (".pptx",): ("pptx", office.pptx(raw)),
    }


def converted(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` with kind and markdown, by the extension of ``path``, whatever its case; other files have neither.

    A converter is given null for the rows that are another's, so that each file is read by one.
    """
    name = F.lower(F.regexp_replace(path, r"(?i)\.gz$", ""))
    out, kinds, texts = files, [], []
    for k, (endings, _) in enumerate(converters(F.lit(None).cast("binary")).items()):
        mine = F.lit(False)
        for e in endings:
            mine = mine | F.endswith(name, F.lit(e))
        kind, text = converters(F.when(mine, F.col(content)))[endings]
        kinds.append(F.when(mine, F.lit(kind)))
        texts.append(F.when(mine, text))
    return out.select("*", F.coalesce(*kinds).alias("kind"), F.coalesce(*texts).alias("markdown"))

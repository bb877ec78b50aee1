"""Office files (Office Open XML) as Markdown: workbooks, documents, slides (S25, S26). Zip and XML of the standard library."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql.types import StringType

from .convert import markdown_table
from .rowwise import rowwise

_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The built-in number formats of ECMA-376 that are dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element, name: str):
    return (x for x in e.iter() if _tag(x) == name)


class _Package:
    """The parts of a file by name, parsed when they are asked for."""

    def __init__(self, raw: bytes) -> None:
        self._zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = self._zip.namelist()

    def part(self, name: str) -> ET.Element | None:
        return ET.fromstring(self._zip.read(name)) if name in self.names else None

    def targets(self, name: str) -> dict[str, str]:
        """Relation id -> part, of a part."""
        folder, base = posixpath.split(name)
        found = self.part(f"{folder}/_rels/{base}.rels")
        out = {}
        for r in found if found is not None else ():
            to = r.get("Target", "")
            out[r.get("Id")] = to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to))
        return out


def _date(value: float, from_1904: bool) -> str:
    """A serial day number as ISO text. In the 1900 system a 29 February 1900 is counted that never was."""
    day = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30 if value >= 60 else 31)
    at = day + datetime.timedelta(seconds=round(value * 86400))
    if value < 1:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d" if at.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


def _date_styles(styles: ET.Element | None) -> set[int]:
    """The cell styles whose number format shows a date."""
    if styles is None:
        return set()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in _all(styles, "numFmt")}
    cells = next(_all(styles, "cellXfs"), ())
    kinds = [int(x.get("numFmtId", 0)) for x in cells]
    return {k for k, n in enumerate(kinds) if n in _DATE_FORMATS or re.search("[dmyhs]", own.get(n, ""), re.I)}


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook(raw: bytes, most_rows: int = 200) -> list[tuple[str, list[list[str]], bool]]:
    """(sheet, rows, whether there are more) of every sheet; formulas by their last value."""
    p = _Package(raw)
    book = p.part("xl/workbook.xml")
    strings = p.part("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in _all(s, "t")) for s in strings] if strings is not None else []
    dates = _date_styles(p.part("xl/styles.xml"))
    from_1904 = any(x.get("date1904") in ("1", "true") for x in _all(book, "workbookPr"))
    targets, out = p.targets("xl/workbook.xml"), []
    for sheet in _all(book, "sheet"):
        rows: list[list[str]] = []
        part, more = p.part(targets.get(sheet.get(_RELATION), "")), False
        for row in _all(part, "row") if part is not None else ():
            if len(rows) == most_rows:
                more = True
                break
            cells: list[str] = []
            for c in _all(row, "c"):
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                value, kind = next((v.text for v in _all(c, "v")), None), c.get("t", "n")
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in _all(c, "t"))
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind == "n" and value is not None:
                    number = float(value)
                    value = _date(number, from_1904) if int(c.get("s", 0)) in dates else f"{number:.15g}"
                cells.append(value or "")
            rows.append(cells)
        out.append((sheet.get("name"), [r for r in rows if any(x.strip() for x in r)], more))
    return out


def workbook_markdown(raw: bytes, most_rows: int = 200) -> str:
    parts = []
    for name, rows, more in workbook(raw, most_rows):
        parts += [f"## Sheet: {name}", markdown_table(rows, most_rows) or "*empty sheet*"]
        if more:
            parts.append(f"*Only the first {most_rows} rows are shown.*")
    return "\n\n".join(parts)


def _runs(e: ET.Element) -> str:
    """The text of a paragraph, its breaks and tabs; maths as its characters."""
    made = {"t": lambda x: x.text or "", "tab": lambda x: " ", "br": lambda x: "\n", "cr": lambda x: "\n"}
    return "".join(made[_tag(x)](x) for x in e.iter() if _tag(x) in made).strip()


def document_markdown(raw: bytes) -> str:
    """Headings by style, list items, paragraphs and tables of a text document, in their order."""
    out: list[str] = []

    def value(e: ET.Element, name: str) -> str:
        found = next(_all(e, name), None)
        return "" if found is None else next((v for k, v in found.attrib.items() if k.endswith("val")), "")

    def block(e: ET.Element) -> None:
        for x in e:
            if _tag(x) == "p":
                text, style = _runs(x), value(x, "pStyle")
                heading = re.fullmatch(r"(?i)heading\s*([1-9])", style)
                if not text:
                    continue
                if heading or style.lower() == "title":
                    out.append("#" * min(int(heading[1]) if heading else 1, 6) + " " + text)
                elif next(_all(x, "numPr"), None) is not None:
                    out.append("  " * int(value(x, "ilvl") or 0) + "- " + text)
                else:
                    out.append(text)
            elif _tag(x) == "tbl":
                rows = [[_runs(c) for c in r if _tag(c) == "tc"] for r in x if _tag(r) == "tr"]
                out.append(markdown_table(rows))
            elif _tag(x) in ("sdt", "sdtContent", "body"):
                block(x)

    block(_Package(raw).part("word/document.xml"))
    return re.sub(r"(?m)^(\s*- .*)\n\n(?=\s*- )", r"\1\n", "\n\n".join(out))


def slides_markdown(raw: bytes) -> str:
    """Every slide in order: its title, the other text, tables and notes."""
    p, out = _Package(raw), []
    show, targets = p.part("ppt/presentation.xml"), p.targets("ppt/presentation.xml")
    for k, sid in enumerate(_all(show, "sldId"), 1):
        name = targets.get(sid.get(_RELATION), "")
        slide = p.part(name)
        title, body = "", []
        for shape in (x for x in slide.iter() if _tag(x) in ("sp", "tbl")) if slide is not None else ():
            if _tag(shape) == "tbl":
                body.append(markdown_table([[" ".join(_runs(x) for x in _all(c, "p")) for c in r if _tag(c) == "tc"] for r in shape if _tag(r) == "tr"]))
                continue
            lines = [t for t in (_runs(x) for x in _all(shape, "p")) if t]
            kind = next((x.get("type", "") for x in _all(shape, "ph")), "")
            if kind in ("title", "ctrTitle") and not title:
                title = " ".join(lines)
            else:
                body += lines
        notes = next((p.part(t) for t in p.targets(name).values() if "notesSlide" in t), None)
        said = [t for t in (_runs(x) for x in _all(notes, "p")) if t and not t.isdigit()] if notes is not None else []
        out += [f"## {title or f'Slide {k}'}", *body, *(["Notes: " + " ".join(said)] if said else [])]
    return "\n\n".join(out)


def _or_none(one):
    def safe(raw: bytes) -> str | None:
        try:
            return one(raw)
        except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, AttributeError, TypeError):
            return None  # damaged

    return rowwise(StringType(), safe)


#: Binary columns to Markdown; null for null and damaged files.
xlsx, docx, pptx = _or_none(workbook_markdown), _or_none(document_markdown), _or_none(slides_markdown)

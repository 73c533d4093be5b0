"""Binary documents: packages, texts, office files and spreadsheets.

Binary formats are the one place where Python runs per row: a file goes in, its
members, blocks or cells come out, in ``mapInPandas`` so that a worker holds one
batch of files. Parsers are looked up by file name; ``register`` adds one.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Guards of a package.
MAX_MEMBER, MAX_TOTAL = 50_000_000, 200_000_000
#: Empty rows after data that end a sheet.
EMPTY_TAIL = 100

Block = dict
Parser = Callable[[bytes], list[Block]]
PARSERS: dict[str, Parser] = {}


def register(*suffixes: str) -> Callable[[Parser], Parser]:
    """Add a parser for file names that end in one of ``suffixes``."""

    def add(parser: Parser) -> Parser:
        for s in suffixes:
            PARSERS[s] = parser
        return parser

    return add


def parser_for(filename: str) -> Parser | None:
    low = filename.lower()
    return next((p for s, p in PARSERS.items() if low.endswith(s)), None)


def _block(kind: str, text: str | None = None, level: int | None = None, path: tuple[str, ...] = (), rows=None, page: int | None = None, sheet: str | None = None) -> Block:
    return {"type": kind, "text": text, "level": level, "heading_path": list(path), "rows": rows, "page": page, "sheet": sheet}


@register(".txt", ".md")
def parse_text(data: bytes) -> list[Block]:
    """Runs of lines between empty lines, as paragraphs."""
    with io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", "replace") as lines:
        runs = ("".join(run).strip() for empty, run in groupby(lines, key="\n".__eq__) if not empty)
        return [_block("paragraph", run) for run in runs if run]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_STYLE = re.compile(r"(?i)heading\s*([1-9])")


class _BodyReader:
    """Builds blocks from the events of a document's XML, without keeping its tree.

    Only what lies directly in the body makes a block: a paragraph, or a table of
    its own rows and cells. Text of anything nested counts for what holds it.
    """

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[str] = []
        self.headings: dict[int, str] = {}
        self.text: list[str] = []
        self.rows: list[list[str]] = []
        self.level = 0

    def start(self, tag: str, value: str) -> None:
        self.open.append(tag)
        here = self.open[2:]  # below document and body
        if here in (["p"], ["tbl", "tr", "tc"]):
            self.text, self.level = [], 0
        elif here == ["tbl"]:
            self.rows = []
        elif here == ["tbl", "tr"]:
            self.rows.append([])
        elif here == ["p", "pPr", "pStyle"] and (m := _STYLE.fullmatch(value)):
            self.level = int(m[1])

    def end(self, tag: str, text: str) -> None:
        here = self.open[2:]
        if tag == "t":
            self.text.append(text)
        elif here == ["tbl", "tr", "tc"]:
            self.rows[-1].append("".join(self.text).strip())
        elif here == ["tbl"]:
            self.add(_block("table", rows=self.rows))
        elif here == ["p"] and (whole := "".join(self.text).strip()):
            if self.level:
                self.headings = {k: v for k, v in self.headings.items() if k < self.level} | {self.level: whole}
            self.add(_block("heading", whole, self.level) if self.level else _block("paragraph", whole))
        self.open.pop()

    def add(self, block: Block) -> None:
        self.blocks.append(block | {"heading_path": [self.headings[k] for k in sorted(self.headings)]})


@register(".docx")
def parse_docx(data: bytes) -> list[Block]:
    """Paragraphs, headings and tables in the order of the body."""
    reader = _BodyReader()
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as xml:
        for event, node in ElementTree.iterparse(xml, ("start", "end")):
            tag = node.tag.removeprefix(_W)
            if event == "start":
                reader.start(tag, node.get(f"{_W}val", ""))
            else:
                reader.end(tag, node.text or "")
                node.clear()
    return reader.blocks


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes, tail: int = EMPTY_TAIL) -> dict[str, list[list[str]]]:
    """The cells of each sheet of a workbook, up to ``tail`` empty rows after data."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out: dict[str, list[list[str]]] = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = rels[sheet.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str]] = []
            seen, empty = False, 0
            for row in root.iter(f"{_S}row"):
                while len(rows) < int(row.get("r", len(rows) + 1)) - 1:
                    rows.append([])
                cells: list[str] = []
                for i, c in enumerate(row.iter(f"{_S}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    cells += [""] * (at - len(cells))
                    v = c.find(f"{_S}v")
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                rows.append(cells)
                empty = 0 if any(cells) else empty + 1
                seen = seen or any(cells)
                if seen and empty >= tail:
                    break
            while rows and not any(rows[-1]):
                rows.pop()
            out[sheet.get("name")] = rows
    return out


@register(".xlsx", ".xlsm")
def parse_workbook(data: bytes) -> list[Block]:
    return [_block("sheet", sheet=name, rows=rows) for name, rows in sheets(data).items() if rows]


def _gated(module: str, suffix: str, parse: Callable) -> None:
    """A parser that needs a library that may not be installed."""
    try:
        lib = __import__(module)
    except ImportError:
        return
    register(suffix)(lambda data: parse(lib, data))


def pdf_pages(lib, data: bytes) -> list[Block]:
    """Pages with text, by their numbers."""
    pages = enumerate(lib.PdfReader(io.BytesIO(data)).pages, 1)
    return [_block("page", text, page=i) for i, p in pages if (text := (p.extract_text() or "").strip())]


_gated("pypdf", ".pdf", pdf_pages)
_gated("xlrd", ".xls", lambda lib, data: [_block("sheet", sheet=s.name, rows=[[str(c) for c in s.row_values(r)] for r in range(s.nrows)]) for s in lib.open_workbook(file_contents=data).sheets()])

# --- over files (path, content) ---------------------------------------------------

MEMBERS = "path string, nth int, filename string, byte_size long, sha256 string, supported boolean, unsafe string, content binary"


def _unsafe(name: str) -> str | None:
    parts = re.split(r"[\\/]", name)
    if name.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", name):
        return "absolute path"
    return "path traversal" if ".." in parts else None


def _objection(infos: list[zipfile.ZipInfo]) -> str | None:
    """What a guard objects to in a package, if anything."""
    total = 0
    for info in infos:
        total += info.file_size
        if why := _unsafe(info.filename) or ("member too large" if info.file_size > MAX_MEMBER else None):
            return f"{why}: {info.filename}"
    return "package too large" if total > MAX_TOTAL else None


def package_members(files: DataFrame) -> DataFrame:
    """Members of ZIP packages, or the single file itself, as its bytes tell and not
    its name. A package that a guard objects to, or that cannot be read, is one row
    of its own with ``unsafe`` and without content; nothing of it is read."""

    def members(path: str, name: str, data: bytes) -> list[tuple]:
        row = lambda k, n, content: (path, k, n, len(content), hashlib.sha256(content).hexdigest(), parser_for(n) is not None, None, content)
        if name.lower().endswith((".docx", ".xlsx", ".xlsm")) or not zipfile.is_zipfile(io.BytesIO(data)):
            return [row(0, name, data)]
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if why := _objection(infos):
                    return [(path, 0, name, len(data), None, False, why, None)]
                return [row(k, i.filename, z.read(i)) for k, i in enumerate(infos)]
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error) as e:
            return [(path, 0, name, len(data), None, False, f"unreadable: {type(e).__name__}", None)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for path, data in zip(pdf["path"], pdf["content"], strict=True) for r in members(path, re.split(r"[\\/]", path)[-1], bytes(data))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")])

    return files.select("path", "content").mapInPandas(run, MEMBERS)


def primary_members(members: DataFrame) -> DataFrame:
    """Add role: the only supported member of a package is its probable primary."""
    n = F.count_if("supported").over(Window.partitionBy("path"))
    return members.withColumn("role", F.when(F.col("supported") & (n == 1), "probable_primary").otherwise("member"))


BLOCKS = "path string, nth int, filename string, status string, pos int, block_id string, type string, text string, level int, heading_path array<string>, rows array<array<string>>, page int, sheet string"


def parse_blocks(members: DataFrame) -> DataFrame:
    """Blocks of each member; a member without a parser or that fails to parse has
    one row that says so, and harms no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for pdf in batches:
            rows = []
            for path, nth, name, data in zip(pdf["path"], pdf["nth"], pdf["filename"], pdf["content"], strict=True):
                parser = parser_for(name)
                status, found = "unsupported", []
                if parser is not None and data is not None:
                    try:
                        found = parser(bytes(data))
                        status = "parsed" if found else "text_unavailable"
                    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                        status = "failed"
                for i, b in enumerate(found):
                    rows.append((path, nth, name, status, i, f"b{i + 1:06d}", b["type"], b["text"], b["level"], b["heading_path"], b["rows"], b["page"], b["sheet"]))
                if not found:
                    rows.append((path, nth, name, status, *[None] * 9))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"pos": "Int32", "level": "Int32", "page": "Int32"})

    return members.select("path", "nth", "filename", "content").mapInPandas(run, BLOCKS)


# --- spreadsheets as lists ----------------------------------------------------------

CELLS = "path string, sheet string, row int, cells array<string>"


def sheet_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of every workbook."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, name, i, cells) for path, data in zip(pdf["path"], pdf["content"], strict=True) for name, table in sheets(bytes(data)).items() for i, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, CELLS)


def list_cells(files: DataFrame) -> DataFrame:
    """``sheet_rows`` with an error column: a file that cannot be read is one row that
    says why, and harms no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, name, i, cells, None) for name, table in sheets(bytes(data)).items() for i, cells in enumerate(table)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, zlib.error, EOFError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "error"]).astype({"row": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELLS + ", error string")


def header_rows(cells: DataFrame, aliases: dict[str, list[str]], key: str = "tdoc_id", related: str = "related_tdoc_ids", first: int = 25) -> DataFrame:
    """The header of each path: (path, sheet, row, mapping column name -> index).

    Of the first rows, one that names the key; most mapped fields win, a related
    column counting one more, then the earliest row, then the sheet's name.
    """
    spark = cells.sparkSession
    table = F.broadcast(spark.createDataFrame([(f, a.lower()) for f, names in aliases.items() for a in names], "field string, alias string"))  # a fixed list
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce("cell", F.lit("")), r"[\s_]+", " ")))
    each = cells.filter(F.col("row") < first).select("path", "sheet", "row", F.posexplode("cells").alias("at", "cell")).withColumn("alias", plain).join(table, "alias")
    g = each.groupBy("path", "sheet", "row", "field").agg(F.min("at").alias("at")).groupBy("path", "sheet", "row").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "at")))).alias("mapping"), (F.count(F.lit(1)) + F.count_if(F.col("field") == related)).alias("score"), F.bool_or(F.col("field") == key).alias("named")
    )
    best = F.struct("score", -F.col("row"), F.lower("sheet"))
    return g.filter("named").groupBy("path").agg(F.max_by(F.struct("sheet", "row", "mapping"), best).alias("h")).select("path", "h.sheet", "h.row", "h.mapping")


def list_rows(cells: DataFrame, headers: DataFrame, key: str = "tdoc_id") -> DataFrame:
    """Normalised rows below the header, the last of each identifier: path, id,
    fields (mapped), raw (all columns by header text), row."""
    from docketry.functions.rules import related_ids

    h = headers.select("path", "sheet", F.col("row").alias("hrow"), "mapping")
    head = cells.join(h, ["path", "sheet"]).filter("row = hrow").select("path", F.col("cells").alias("names"))
    body = cells.join(h, ["path", "sheet"]).filter("row > hrow").join(head, "path").filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    fields = F.transform_values("mapping", lambda k, at: F.get("cells", at))
    named = F.filter(F.transform("names", lambda n, i: F.struct(F.concat(n, F.lit("#"), i).alias("key"), F.get("cells", i).alias("value"))), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    out = body.withColumn("fields", fields).withColumn("raw", F.map_from_entries(named)).withColumn("id", F.get(related_ids(F.col("fields")[key]), 0))
    n = F.row_number().over(Window.partitionBy("path", "id").orderBy(F.desc("row")))
    return out.withColumn("__n", n).select("path", "sheet", "row", "id", "fields", "raw", (F.col("id").isNotNull() & (F.col("__n") > 1)).alias("superseded"))


def list_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("id").isNotNull() & ~F.col("superseded")).alias("mapped"), F.count_if(F.col("id").isNull()).alias("unmapped"), F.count_if("superseded").alias("duplicate")
    )

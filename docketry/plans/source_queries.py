"""Scan, format, store and incremental queries."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from docketry.operators import evidence as E
from docketry.plans.search_queries import table
from docketry.sources import listings, packages, store
from docketry.streaming import incremental


def html_links(spark, d):
    return listings.page_links(table(spark, d, "pages")).select("page", "pos", "name", "link")


def meeting_listing(spark, d):
    """Meetings among links named by part keys, aliases and bad names included."""
    p = table(spark, d, "part")
    tail = F.element_at(F.array(F.lit(""), F.lit("bis"), F.lit("-e"), F.lit("x"), F.lit("b")), (F.col("p_partkey") % 5 + 1).cast("int"))
    links = p.select(F.lit("u").alias("page"), F.col("p_partkey").alias("pos"), F.concat(F.lit("TSGR1_"), F.floor(F.col("p_partkey") / 2), tail).alias("name"), F.concat(F.lit("http://x/"), F.col("p_partkey")).alias("link"))
    return listings.meetings(links, "TSGR1_").select("meeting", "link")


def listed_documents(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("R1-"), F.floor(F.col("o_orderkey") / 2) + 100000, F.element_at(F.array(F.lit(".zip"), F.lit(""), F.lit("_x.zip"), F.lit(".doc")), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return listings.listed_documents(o.select(name.alias("name"), F.concat(F.lit("http://x/"), F.col("o_orderkey") + 10000).alias("link"))).select("id", "link")


def jsonl_roundtrip(spark, d):
    """Orders written as content-addressed JSON lines and read back, checked."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("note"))
    entry = store.write_records(o, store.shared_root(spark), "orders", ["o_orderkey"])
    return store.read_records(spark, entry, o.schema)


# Members have no time of their own, so that the same rows make the same bytes.
def _docx(head: str, text: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s=None: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p(head, "Heading1") + p(text.replace("&", "&amp;")) + p("Sub", "Heading2") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>" + p("Next", "Heading1")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def _xlsx(rows: list[list[str]]) -> bytes:
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda r: "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r)
    body = "".join(f'<row r="{i}">{cells(r)}</row>' for i, r in enumerate(rows, 1))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("xl/workbook.xml"), f'<workbook {s} xmlns:r="{rel}"><sheets><sheet name="List" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr(zipfile.ZipInfo("xl/_rels/workbook.xml.rels"), '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), f"<worksheet {s}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _made(rows, make):
    """(path, content) of the files that ``make`` builds from each row."""

    def run(batches):
        for pdf in batches:
            files = [make(r) for r in pdf.itertuples()]
            yield pd.DataFrame({"path": [p for p, _ in files], "content": [c for _, c in files]})

    return rows.mapInPandas(run, "path string, content binary")


def _docx_of(r) -> tuple[str, bytes]:
    k = int(r.s_suppkey)
    return f"d{k}" + (".bin" if k % 11 == 0 else ".docx"), b"no zip" if k % 7 == 0 else _docx(r.s_name, f"Text & more {int(r.s_nationkey)}")


def docx_blocks(spark, d):
    """A document for each supplier, some broken, some of no known format."""
    files = _made(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), _docx_of)
    b = packages.parse_blocks(packages.package_members(files))
    return b.select("path", "status", "block_id", "type", "text", F.array_join("heading_path", " > ").alias("path_"), F.get(F.get("rows", 0), 1).alias("cell"))


def _xlsx_of(r) -> tuple[str, bytes]:
    k, name = int(r.s_suppkey), r.s_name
    rows = [["Meeting list"], [], ["TDoc", "Title", "Source", "Odd"], [f"R1-{2600000 + k}", name, "A; B", "z"], ["", "lost", "", ""], [f"R1-{2700000 + k}", "Two", "C", ""]]
    return f"l{k}.xlsx", _xlsx([*rows, [f"R1-{2600000 + k}", "One again", "A", ""]] if k % 3 == 0 else rows)


def xlsx_layout(spark, d):
    """A list for each supplier; the header is in the third row."""
    aliases = {"tdoc_id": ["tdoc", "tdoc number"], "title": ["title"], "source": ["source"], "related_tdoc_ids": ["related tdocs"]}
    cells = packages.sheet_rows(_made(table(spark, d, "supplier").select("s_suppkey", "s_name"), _xlsx_of))
    found = packages.list_rows(cells, packages.header_rows(cells, aliases))
    return found.select("path", "sheet", "row", "id", F.col("fields")["title"].alias("title"), F.size("raw").alias("n_raw"), "superseded")


def list_summaries(spark, d):
    aliases = {"tdoc_id": ["tdoc"], "title": ["title"]}
    cells = packages.sheet_rows(_made(table(spark, d, "supplier").select("s_suppkey", "s_name"), _xlsx_of))
    return packages.list_summary(packages.list_rows(cells, packages.header_rows(cells, aliases)))


#: A member that a guard objects to, in turn; the last one is safe.
_BAD = ["/abs.docx", "..\\up.docx", "a/../../b.docx", "C:\\x.docx", "ok/fine.txt"]


def _zip_of(r) -> tuple[str, bytes]:
    k = int(r.s_suppkey)
    if k % 7 == 0:
        return f"p{k}.zip", f"a{k}".encode()  # no package, whatever its name
    return f"p{k}.zip" if k % 3 else f"p{k}.dat", _zip({"pic.png": b"hello", _BAD[k % 5]: r.s_name.encode()})


def zip_guard(spark, d):
    """A package for each supplier; unsafe ones are rejected whole."""
    m = packages.primary_members(packages.package_members(_made(table(spark, d, "supplier").select("s_suppkey", "s_name"), _zip_of)))
    return m.select("path", "filename", "sha256", "supported", "unsafe", "role")


def text_blocks(spark, d):
    """Documents as text files: their paragraphs."""
    files = table(spark, d, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("t"), "doc_id", F.lit(".txt")).alias("path"), F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n\r\n")), "utf-8").alias("content"))
    b = packages.parse_blocks(packages.package_members(files)).filter("status = 'parsed'")
    return b.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.md5(F.min_by("text", "pos")).alias("first"))


def incremental_reuse(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    done = e.filter("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "?").otherwise(F.col("o_orderstatus")))
    done = done.withColumn("identity", incremental.identity("o_orderpriority", "o_orderstatus"))
    inputs = e.filter("o_orderkey % 7 <> 0")
    return incremental.freshness(inputs, done, ["o_orderkey"], ["o_orderpriority", "o_orderstatus"])


def snapshot_supersession(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return incremental.current_rows(li, "l_orderkey", "l_suppkey", "l_linenumber").groupBy("l_suppkey").agg(F.max("l_linenumber").alias("import_"), F.count(F.lit(1)).alias("n"))


def review_append(spark, d):
    o = table(spark, d, "orders")
    w = F.row_number().over(E.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    prev = F.lag("o_orderkey").over(E.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    log = o.select("o_custkey", F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("decision"), w.alias("sequence"), prev.alias("supersedes"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("review_id"), F.lit("N").alias("decision"))
    return incremental.append_review(log, new, "o_custkey", True).filter("review_id = -1")


def receipt_validation(spark, d):
    li = table(spark, d, "lineitem")
    w = E.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    b = li.select(F.col("l_orderkey").alias("doc_id"), F.lit("m").alias("member"), F.row_number().over(w).alias("order")).withColumn("block_id", F.format_string("b%06d", "order"))
    b = b.filter("NOT (doc_id % 11 = 0 AND order = 2)")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 13 == 0, "failed").otherwise("parsed").alias("status"))
    n = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("block_count"))
    n = n.withColumn("block_count", F.when(F.col("doc_id") % 11 == 0, F.greatest(F.col("block_count") - 1, F.lit(1))).otherwise(F.col("block_count")))
    return store.validated(b, o.join(n, "doc_id", "left")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    html_links, meeting_listing, listed_documents, jsonl_roundtrip, docx_blocks, xlsx_layout, list_summaries, zip_guard, text_blocks, incremental_reuse, snapshot_supersession, review_append, receipt_validation,
)}

SQL = {
    "html_links": r"""WITH p AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>.*?</a>', 1) h FROM pages),
u AS (SELECT url AS page, unnest(h) href, generate_subscripts(h, 1) - 1 AS pos FROM p), v AS (SELECT page, pos, replace(href, '&amp;', '&') href, regexp_extract(page, '^(https?://[^/]+)', 1) origin FROM u),
l AS (SELECT page, pos, href, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN origin || href ELSE regexp_extract(page, '^([^?#]*/)', 1) || href END AS link FROM v),
n AS (SELECT *, url_decode(regexp_extract(regexp_replace(link, '/$', ''), '([^/]*)$', 1)) AS name FROM l WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(\?|#|javascript:)'))
SELECT page, arg_min(pos, pos)::INT AS pos, any_value(name) AS name, link FROM n WHERE name NOT IN ('', '.', '..') GROUP BY page, link""",
    "meeting_listing": """WITH p AS (SELECT p_partkey k, (p_partkey // 2) || ['', 'bis', '-e', 'x', 'b'][p_partkey % 5 + 1] m FROM part)
SELECT CASE WHEN m LIKE '%b' THEN m || 'is' ELSE m END AS meeting, 'http://x/' || max(k) AS link FROM p WHERE m NOT LIKE '%x' GROUP BY 1""",
    "listed_documents": "SELECT 'R1-' || (100000 + o_orderkey // 2) AS id, 'http://x/' || max(o_orderkey + 10000) AS link FROM orders WHERE o_orderkey % 4 <> 2 GROUP BY 1",
    "jsonl_roundtrip": "SELECT o_orderkey, o_orderstatus, NULL::VARCHAR AS note FROM orders",
    "docx_blocks": """WITH b(block_id, type, t, sub, cell) AS (VALUES ('b000001', 'heading', '', '', NULL), ('b000002', 'paragraph', 'Text & more ', '', NULL), ('b000003', 'heading', 'Sub', ' > Sub', NULL), ('b000004', 'table', NULL, ' > Sub', 'b'), ('b000005', 'heading', 'Next', 'Next', NULL))
SELECT 'd' || s_suppkey || '.docx' AS path, 'parsed' AS status, block_id, type, CASE block_id WHEN 'b000001' THEN s_name WHEN 'b000002' THEN t || s_nationkey ELSE t END AS text,
  CASE WHEN sub = 'Next' THEN sub ELSE s_name || sub END AS path_, cell FROM supplier, b WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0
UNION ALL SELECT 'd' || s_suppkey || '.docx', 'failed', NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 11 <> 0
UNION ALL SELECT 'd' || s_suppkey || '.bin', 'unsupported', NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 7 = 0
UNION ALL SELECT 'd' || s_suppkey || '.bin', 'unsupported', NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 7 <> 0""",
    "xlsx_layout": """WITH r(row, k, title, n_raw) AS (VALUES (3, 2600000, NULL, 4), (4, NULL, 'lost', 1), (5, 2700000, 'Two', 3), (6, 2600000, 'One again', 3))
SELECT 'l' || s_suppkey || '.xlsx' AS path, 'List' AS sheet, row, 'R1-' || (k + s_suppkey) AS id, coalesce(title, s_name) AS title, n_raw, row = 3 AND s_suppkey % 3 = 0 AS superseded FROM supplier, r WHERE row < 6 OR s_suppkey % 3 = 0""",
    "list_summaries": "SELECT 'l' || s_suppkey || '.xlsx' AS path, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 3 END AS total, 2 AS mapped, 1 AS unmapped, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS duplicate FROM supplier",
    "zip_guard": r"""WITH s AS (SELECT s_suppkey k, s_name n, 'p' || s_suppkey || CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 3 <> 0 THEN '.zip' ELSE '.dat' END AS path FROM supplier)
SELECT path, path AS filename, sha256('a' || k) AS sha256, false AS supported, NULL AS unsafe, 'member' AS role FROM s WHERE k % 7 = 0
UNION ALL SELECT path, path, NULL, false, CASE k % 5 WHEN 0 THEN 'absolute path: /abs.docx' WHEN 1 THEN 'path traversal: ..\up.docx' WHEN 2 THEN 'path traversal: a/../../b.docx' ELSE 'absolute path: C:\x.docx' END, 'member' FROM s WHERE k % 7 <> 0 AND k % 5 <> 4
UNION ALL SELECT path, 'pic.png', sha256('hello'), false, NULL, 'member' FROM s WHERE k % 7 <> 0 AND k % 5 = 4
UNION ALL SELECT path, 'ok/fine.txt', sha256(n), true, NULL, 'probable_primary' FROM s WHERE k % 7 <> 0 AND k % 5 = 4""",
    "text_blocks": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') x FROM l) SELECT 't' || doc_id || '.txt' AS path, count(*) n, sum(length(x))::BIGINT chars, md5(arg_min(x, i)) AS "first" FROM t WHERE x <> '' GROUP BY doc_id""",
    "incremental_reuse": """WITH i AS (SELECT o_orderkey k FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey k FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(i.k, b.k) o_orderkey, CASE WHEN i.k IS NULL THEN 'gone' WHEN b.k IS NULL THEN 'new' WHEN i.k % 10 = 0 THEN 'changed' ELSE 'reused' END AS state FROM i FULL JOIN b ON i.k = b.k""",
    "snapshot_supersession": "WITH m AS (SELECT l_suppkey, max(l_linenumber) n FROM lineitem GROUP BY 1) SELECT l_suppkey, n import_, count(*) AS n FROM lineitem JOIN m USING (l_suppkey) WHERE l_linenumber = m.n GROUP BY ALL",
    "review_append": "SELECT c_custkey o_custkey, -1::BIGINT review_id, 'N' decision, (coalesce(n, 0) + 1)::INT AS sequence, last AS supersedes FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, max(o_orderkey) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "receipt_validation": """WITH n AS (SELECT l_orderkey k, count(*) c FROM lineitem GROUP BY 1)
SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'failed' END r, count(*) n FROM orders LEFT JOIN n ON k = o_orderkey GROUP BY 1""",
}
SQL["receipt_validation"] = """WITH n AS (SELECT l_orderkey k, count(*) c FROM lineitem GROUP BY 1),
z AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'not parsed' WHEN c IS NULL THEN 'no blocks' WHEN o_orderkey % 11 = 0 AND c > 2 THEN 'order not dense' END AS reason FROM orders LEFT JOIN n ON k = o_orderkey) SELECT reason, count(*) n FROM z GROUP BY 1"""

"""Acquisition queries: suppliers play the documents and notes of a meeting, and the
files that their URLs lead to are made from the URL."""

from __future__ import annotations

import datetime
import re
import urllib.error
import uuid

from pyspark.sql import functions as F

from docketry.plans.search_queries import table
from docketry.plans.source_queries import _docx, _xlsx, _zip
from docketry.sources import acquisition, store
from docketry.sources.repository import Repository

_LISTS = {
    "TDoc_List_Meeting_R1.xlsx": [["TDoc", "Title", "Status"], ["R1-2600001", "Current", ""], ["R1-9000002", "Only listed", "new"]],
    "TDoc_List_2026-01-02.xlsx": [["TDoc", "Title", "Status"], ["R1-2600001", "Older", "agreed"], ["R1-2600002", "Two", "noted"], ["R1-9000003", "Nowhere else", ""]],
    "TDoc_List_2026-01-01.xlsx": [["TDoc", "Title", "Status"], ["R1-2600002", "Oldest", ""], ["R1-2600003", "Three", ""]],
    "TDoc_List_plain.xlsx": [["Name", "Title"], ["x", "y"]],
}


def _body(url: str) -> bytes:
    """What a URL of these queries leads to."""
    name = url.rsplit("/", 1)[1]
    if name in _LISTS:
        return _xlsx(_LISTS[name])
    if name == "TDoc_List_broken.xlsx":
        return b"no workbook"
    k = int(re.search(r"\d+", name)[0]) if re.search(r"\d+", name) else 0
    if k % 7 == 0:
        raise urllib.error.HTTPError(url, 404, "gone", None, None)
    doc = _docx(f"Note {k}", f"see R1-{2600000 + k} here")
    return doc if name.endswith(".docx") else _zip({"b.docx": doc, "pic.png": b"png", "a.txt": b"first\n\nsecond R1-2700000"})


def _repository(spark, name: str) -> Repository:
    return Repository(spark, f"{store.shared_root(spark)}/{name}-{uuid.uuid4().hex}")


def _plan(spark, d):
    k = F.col("s_suppkey")
    where = F.when(k % 5 == 0, "listed_only").when(k % 5 == 1, "unknown").otherwise("downloadable")
    url = F.concat(F.lit("http://h/d"), k, F.when(k % 2 == 0, ".zip").otherwise(".docx"))
    return table(spark, d, "supplier").select(k.alias("k"), F.concat(F.lit("S"), k).alias("id"), url.alias("url"), where.alias("availability"))


def fetch_outcomes(spark, d):
    """A plan after a part of it was done, and once more after the parsers changed."""
    repo, plan = _repository(spark, "fetch"), _plan(spark, d)
    older, newer = acquisition.Bodies(repo, "documents", _body, "older"), acquisition.Bodies(repo, "documents", _body)
    older.execute(plan.filter("k % 4 < 2"))
    second = older.execute(plan)
    return second.withColumn("run", F.lit(2)).unionByName(newer.execute(plan).withColumn("run", F.lit(3)))


def fetched_blocks(spark, d):
    """Blocks are numbered through all members of a package."""
    bodies = acquisition.Bodies(_repository(spark, "blocks"), "documents", _body)
    bodies.execute(_plan(spark, d))
    return bodies.blocks().select("id", "member", "order", "block_id", "type", "text")


def fetched_receipts(spark, d):
    bodies = acquisition.Bodies(_repository(spark, "receipts"), "documents", _body)
    bodies.execute(_plan(spark, d))
    bad = bodies.invalid().select("id", "reason")
    return bodies.receipts().join(bad, "id", "left").select("id", "url", "status", "block_count", "references", F.length("sha256").alias("digits"), "reason")


def _noted(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("n"), k, F.element_at(F.array(*map(F.lit, ("_final", "_eom", "_rev1"))), (k % 3 + 1).cast("int")), F.lit(".docx"))
    files = table(spark, d, "supplier").select(k.alias("k"), name.alias("name"), F.concat(F.lit("http://h/notes/"), name).alias("link"))
    notes = acquisition.Notes(_repository(spark, "notes"), _body)
    at = lambda day: datetime.datetime(2026, 1, day)
    notes.discover(files.filter("k % 2 = 0"), "R1", "124", at(1))
    return notes, notes.discover(files, "R1", "124", at(2)), files


def note_inventory(spark, d):
    """Snapshots found twice keep their first time."""
    return _noted(spark, d)[1].select("url", "role", F.dayofmonth("discovered_at").alias("day"))


def note_selection(spark, d):
    """Several final snapshots are ambiguous; of one of them the wanted is selected."""
    notes, found, _ = _noted(spark, d)
    wanted = found.filter(F.col("url").endswith("/n1_eom.docx")).first()["id"]  # one row
    both = [notes.select("R1", "124"), notes.select("R1", "124", wanted), notes.select("R1", "125")]
    return both[0].unionByName(both[1]).unionByName(both[2]).select("n", "state")


def note_blocks(spark, d):
    notes, found, _ = _noted(spark, d)
    notes.fetch("R1", "124")
    wanted = found.filter(F.col("url").endswith("/n1_eom.docx")).first()["id"]  # one row
    return notes.load("R1", "124", wanted).select("member", "order", "type", "text")


def _ingested(spark, d):
    k = F.col("s_suppkey")
    link = lambda name: F.concat(F.lit('<a href="'), name, F.lit('">x</a>'))
    pages = table(spark, d, "supplier").select(F.concat(F.lit("http://h/m/dir"), k, F.lit("/")).alias("url"), link(F.concat(F.lit("R1-"), k + 2600000, F.lit(".zip"))).alias("html"))
    names = [*_LISTS, "TDoc_List_broken.xlsx", "TDoc_List_lost.xlsx"]
    lists = spark.createDataFrame([("http://h/m/lists/", "".join(f'<a href="{n}">x</a>' for n in names))], "url string, html string")
    repo = _repository(spark, "meeting")
    aliases = {"tdoc_id": ["tdoc"], "title": ["title"], "status": ["status"]}
    return repo, acquisition.ingest_meeting(repo, pages.unionByName(lists), "124", _body, aliases)


def meeting_ingest(spark, d):
    """Documents of a meeting from its directory and all its lists."""
    return _ingested(spark, d)[0].table("documents").select("id", "meeting", "title", "status", "url", "current")


def meeting_snapshots(spark, d):
    """A list that cannot be read or fetched is a snapshot with its error."""
    found = _ingested(spark, d)[1]
    return found.select("name", "role", F.date_format("stamp", "yyyy-MM-dd").alias("day"), F.substring_index("parse_error", ":", 1).alias("error"), "rows")


QUERIES = {f.__name__: f for f in (fetch_outcomes, fetched_blocks, fetched_receipts, note_inventory, note_selection, note_blocks, meeting_ingest, meeting_snapshots)}

_P = "p AS (SELECT s_suppkey k, 'S' || s_suppkey AS id, s_suppkey % 2 = 0 AS zip, 'http://h/d' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.zip' ELSE '.docx' END AS url FROM supplier)"
_GOT = "k % 5 > 1 AND k % 7 <> 0"
_N = "n AS (SELECT s_suppkey k, 'n' || s_suppkey || ['_final', '_eom', '_rev1'][(s_suppkey % 3 + 1)::INT] || '.docx' AS name FROM supplier)"
_DOC = "(1, 'heading', 'Note ' || k), (2, 'paragraph', 'see R1-' || (2600000 + k) || ' here'), (3, 'heading', 'Sub'), (4, 'table', NULL), (5, 'heading', 'Next')"
SQL = {
    "fetch_outcomes": f"""WITH {_P} SELECT run, id, CASE WHEN k % 5 < 2 THEN 'not_fetched' WHEN k % 7 = 0 THEN 'failed' WHEN zip THEN 'partial' ELSE 'parsed' END AS status,
CASE WHEN k % 5 = 0 THEN 'only listed' WHEN k % 5 = 1 THEN 'availability not known' WHEN k % 7 = 0 THEN 'HTTPError: HTTP Error 404: gone'
  WHEN run = 3 THEN 'normalised again' WHEN k % 4 < 2 THEN 'reused' ELSE 'downloaded' END AS message FROM p, (VALUES (2), (3)) r(run)""",
    "fetched_blocks": f"""WITH {_P}, b AS (SELECT id, CASE WHEN zip THEN 'b.docx' ELSE 'd' || k || '.docx' END AS member, v.* FROM p, LATERAL (VALUES {_DOC}) v(o, type, text) WHERE {_GOT}
UNION ALL SELECT id, 'a.txt', v.* FROM p, (VALUES (6, 'paragraph', 'first'), (7, 'paragraph', 'second R1-2700000')) v WHERE zip AND {_GOT})
SELECT id, member, o AS "order", 'b00000' || o AS block_id, type, text FROM b""",
    "fetched_receipts": f"""WITH {_P} SELECT id, url, CASE WHEN zip THEN 'partial' ELSE 'parsed' END AS status, CASE WHEN zip THEN 7 ELSE 5 END AS block_count,
CASE WHEN zip THEN 2 ELSE 1 END AS "references", 64 AS digits, NULL::VARCHAR AS reason FROM p WHERE {_GOT}""",
    "note_inventory": f"""WITH {_N} SELECT 'http://h/notes/' || name AS url, ['explicit_final', 'eom', 'intermediate'][(k % 3 + 1)::INT] AS role, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS "day" FROM n""",
    "note_selection": "SELECT count(*) n, CASE WHEN count(*) FILTER (s_suppkey % 3 = 0) = 1 THEN 'selected' ELSE 'ambiguous' END AS state FROM supplier UNION ALL SELECT count(*), 'selected' FROM supplier UNION ALL SELECT 0, 'missing'",
    "note_blocks": f"""SELECT 'n1_eom.docx' AS member, v.o AS "order", v.type, v.text FROM (SELECT 1 AS k) one, LATERAL (VALUES {_DOC}) v(o, type, text)""",
    "meeting_ingest": """WITH s AS (SELECT 'R1-' || (2600000 + s_suppkey) AS id, s_suppkey k FROM supplier)
SELECT id, '124' AS meeting, CASE k WHEN 1 THEN 'Current' WHEN 2 THEN 'Two' WHEN 3 THEN 'Three' END AS title, CASE k WHEN 1 THEN 'agreed' WHEN 2 THEN 'noted' END AS status,
  'http://h/m/dir' || k || '/' || id || '.zip' AS url, true AS "current" FROM s UNION ALL SELECT 'R1-9000002', '124', 'Only listed', 'new', NULL, true""",
    "meeting_snapshots": """SELECT * FROM (VALUES ('TDoc_List_Meeting_R1.xlsx', 'current', NULL, NULL, 2), ('TDoc_List_2026-01-02.xlsx', 'historical', '2026-01-02', NULL, 3), ('TDoc_List_2026-01-01.xlsx', 'historical', '2026-01-01', NULL, 2),
('TDoc_List_plain.xlsx', 'unknown', NULL, 'no header that names documents', NULL), ('TDoc_List_broken.xlsx', 'unknown', NULL, 'BadZipFile', NULL), ('TDoc_List_lost.xlsx', 'unknown', NULL, 'HTTPError', NULL)) v(name, role, "day", error, "rows")""",
}

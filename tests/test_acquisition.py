"""Landing, receipts, note snapshots: what must be refused, and what a failure leaves."""

import datetime
import json
import sys
import types

import pytest

from docketry import cli
from docketry.sources import acquisition, directory, listings, packages
from docketry.sources.repository import Repository

PLAN = "id string, url string, availability string"


def first(url):
    return b"one\n\ntwo"


def second(url):
    return b"changed"


def broken(url):
    raise RuntimeError("a fault of ours, not of the file")


def plan(spark, *rows):
    return spark.createDataFrame([(i, u, "downloadable") for i, u in rows], PLAN)


def outcomes(df):
    return {r.id: (r.status, r.message) for r in df.collect()}


def test_bytes_are_immutable(spark, tmp_path):
    repo = Repository(spark, str(tmp_path))
    old = acquisition.Bodies(repo, "documents", first)
    assert outcomes(old.execute(plan(spark, ("a", "http://h/a.txt")))) == {"a": ("parsed", "downloaded")}
    new = acquisition.Bodies(repo, "documents", second)
    # Not asked for again; with a refresh the change is refused and the receipts stay.
    assert outcomes(new.execute(plan(spark, ("a", "http://h/a.txt")))) == {"a": ("parsed", "reused")}
    before = new.receipts().collect()
    with pytest.raises(ValueError, match="changed since it was landed: http://h/a.txt"):
        new.execute(plan(spark, ("a", "http://h/a.txt")), refresh=True)
    with pytest.raises(ValueError, match="another source than its receipt says: a"):
        new.execute(plan(spark, ("a", "http://h/b.txt")))
    assert new.receipts().collect() == before and [r.text for r in new.load("a").collect()] == ["one", "two"]
    assert outcomes(old.execute(plan(spark, ("a", "http://h/a.txt")), refresh=True)) == {"a": ("parsed", "reused")}


def test_documents_at_one_url_share_its_bytes(spark, tmp_path):
    bodies = acquisition.Bodies(Repository(spark, str(tmp_path)), "documents", first)
    bodies.execute(plan(spark, ("a", "http://h/a.txt")))
    other = acquisition.Bodies(bodies.repo, "documents", second)
    got = outcomes(other.execute(plan(spark, ("b", "http://h/a.txt"), ("c", "http://h/c.txt"), ("d", "http://h/c.txt"))))
    assert got == {"b": ("parsed", "reused"), "c": ("parsed", "downloaded"), "d": ("parsed", "downloaded")}
    assert [r.text for r in other.load("b").collect()] == ["one", "two"] and [r.text for r in other.load("d").collect()] == ["changed"]
    assert other.invalid().isEmpty()


def test_a_failed_run_leaves_the_receipts(spark, tmp_path):
    bodies = acquisition.Bodies(Repository(spark, str(tmp_path)), "documents", first)
    bodies.execute(plan(spark, ("a", "http://h/a.txt")))
    with pytest.raises(Exception, match="a fault of ours"):
        acquisition.Bodies(bodies.repo, "documents", broken).execute(plan(spark, ("b", "http://h/b.txt")))
    assert [r.id for r in bodies.receipts().collect()] == ["a"] and bodies.blocks().count() == 2
    assert outcomes(bodies.execute(plan(spark, ("b", "http://h/b.txt")))) == {"b": ("parsed", "downloaded")}


def test_receipts_that_do_not_hold(spark, tmp_path):
    bodies = acquisition.Bodies(Repository(spark, str(tmp_path)), "documents", first)
    bodies.execute(plan(spark, ("a", "http://h/a.txt"), ("b", "http://h/b.txt"), ("c", "http://h/c.txt")))
    r = bodies.receipts().toPandas()
    r.loc[r.id == "a", "block_count"] = 3
    r.loc[r.id == "b", "sha256"] = "0" * 64
    r.loc[r.id == "c", "identity"] = "older"
    bodies.repo.commit(documents_receipts=spark.createDataFrame(r, acquisition.RECEIPT))
    assert {x.id: x.reason for x in bodies.invalid().collect()} == {"a": "block count", "b": "raw bytes changed", "c": "stale"}
    with pytest.raises(ValueError, match="a: block count"):
        bodies.load("a")
    with pytest.raises(ValueError, match="not normalised: z"):
        bodies.load("z")
    assert outcomes(bodies.execute(plan(spark, ("c", "http://h/c.txt"))))["c"] == ("parsed", "normalised again")


def test_empty_plans_and_files(spark, tmp_path):
    bodies = acquisition.Bodies(Repository(spark, str(tmp_path)), "documents", lambda url: b"")
    assert outcomes(bodies.execute(plan(spark))) == {}
    got = outcomes(bodies.execute(spark.createDataFrame([("a", "http://h/a.txt", "downloadable"), ("b", None, "downloadable"), ("c", "http://h/c", None)], PLAN)))
    assert got["a"] == ("text_unavailable", "downloaded") and got["b"][0] == got["c"][0] == "not_fetched"


def test_notes_by_older_rules_must_be_discovered_again(spark, tmp_path):
    repo, at = Repository(spark, str(tmp_path)), datetime.datetime(2026, 1, 1)
    files = spark.createDataFrame([("n_final.txt", "http://h/n_final.txt")], "name string, link string")
    acquisition.Notes(repo, first, rules="0").discover(files, "R1", "1", at)
    notes = acquisition.Notes(repo, first)
    with pytest.raises(ValueError, match="discover again"):
        notes.inventory("R1", "1")
    assert notes.discover(files, "R1", "1", datetime.datetime(2026, 2, 1)).first().discovered_at == at
    notes.fetch("R1", "1")
    assert [r.text for r in notes.load("R1", "1").collect()] == ["one", "two"]
    with pytest.raises(ValueError, match="missing: 0"):
        notes.load("R1", "2")
    with pytest.raises(Exception, match="no snapshot x"):
        notes.select("R1", "1", "x").collect()


def test_selection_of_snapshots(spark):
    pick = lambda *roles: listings.select_snapshot(spark.createDataFrame([(f"s{i}", r) for i, r in enumerate(roles)], "snapshot_id string, role string")).first()
    assert pick("eom", "explicit_final").snapshot_id == "s1" and pick("eom").snapshot_id == "s0"
    assert pick("explicit_final", "explicit_final").state == pick("eom", "unknown").state == "ambiguous" and pick().state == "missing"


def meeting_page(url):
    return '<a href="R1-2600001.zip">x</a><a href="TDoc_List_Meeting_R1.xlsx">x</a>' if url.endswith("m/") else '<a href="n1_final.docx">x</a>'


def test_command_line_ingests_and_reads_notes(spark, tmp_path, capsys):
    get = ["--root", str(tmp_path), "--pages", "tests.test_acquisition:meeting_page", "--files", "docketry.plans.acquisition_queries:_body"]
    assert cli.main(["ingest", "124", "--url", "http://h/m/", *get], spark) == 0
    row = json.loads(capsys.readouterr().out)
    assert (row["role"], row["rows"], row["meeting"]) == ("current", 2, "124")
    assert sorted(r.id for r in Repository(spark, str(tmp_path)).table("documents").collect()) == ["R1-2600001", "R1-9000002"]
    assert cli.main(["notes", "124", "--url", "http://h/n/", *get], spark) == 0
    assert [json.loads(x).get("text") for x in capsys.readouterr().out.splitlines()] == ["Note 1", "see R1-2600001 here", "Sub", None, "Next"]
    assert cli.main(["ingest", "124", "--url", "http://h/m/", "--list", "http://h/none", *get], spark) == 1 and "no list" in capsys.readouterr().err


def test_a_second_import_replaces_a_meeting(spark, tmp_path):
    from docketry.plans.acquisition_queries import _body

    repo, aliases = Repository(spark, str(tmp_path)), {"tdoc_id": ["tdoc"], "title": ["title"], "status": ["status"]}
    page = lambda *names: spark.createDataFrame([("http://h/m/", "".join(f'<a href="{n}">x</a>' for n in names))], "url string, html string")
    acquisition.ingest_meeting(repo, page("R1-2600001.zip", "TDoc_List_2026-01-02.xlsx"), "124", _body, aliases)
    acquisition.ingest_meeting(repo, page("R1-2600005.zip"), "125", _body, aliases)
    acquisition.ingest_meeting(repo, page("R1-2600003.zip", "TDoc_List_2026-01-01.xlsx"), "124", _body, aliases)
    assert sorted((r.meeting, r.name) for r in repo.table("snapshots").collect()) == [("124", "TDoc_List_2026-01-01.xlsx")]
    assert sorted((r.id, r.current) for r in repo.table("documents").filter("meeting = '124'").collect()) == [("R1-2600001", False), ("R1-2600002", True), ("R1-2600003", True), ("R1-9000003", False)]
    assert [r.current for r in repo.table("documents").filter("meeting = '125'").collect()] == [True]


def test_pages_are_asked_for_once():
    assert directory.Pages({"url": "u v u"}).urls == ["u", "v"]


def test_parsers_of_optional_libraries(monkeypatch):
    """The branch for a PDF library, with one that reads pages apart at form feeds."""
    page = lambda t: types.SimpleNamespace(extract_text=lambda: t)
    lib = types.SimpleNamespace(PdfReader=lambda f: types.SimpleNamespace(pages=[page(t) for t in f.read().decode().split("\f")]))
    monkeypatch.setitem(sys.modules, "paged", lib)
    monkeypatch.setattr(packages, "PARSERS", dict(packages.PARSERS))
    packages._gated("paged", ".paged", packages.pdf_pages)
    assert [(b["type"], b["text"], b["page"]) for b in packages.parser_for("x.PAGED")(b"one\f \f three")] == [("page", "one", 1), ("page", "three", 3)]
    packages._gated("no_such_library", ".none", packages.pdf_pages)
    assert packages.parser_for("x.none") is None

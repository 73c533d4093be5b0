"""Stored indexes, repositories, manifests, packages, requests and the command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docketry import cli
from docketry.operators import index, inventory
from docketry.plans import study
from docketry.sources import packages, repository, requests, store

SF = "/root/testdata/sf0.001"


def test_index_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "red ring\nblue"), (2, "red"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.state) for r in index.refresh(spark, root, docs).collect()} == {(1, "new"), (2, "new"), (3, "new")}
    hits = index.search(spark, root, "red ring")
    assert [(r.doc_id, r.matched) for r in hits.orderBy(F.desc("score")).collect()] == [(1, ["red", "ring"]), (2, ["red"])]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    again = docs.filter("doc_id < 3").withColumn("text", F.when(F.col("doc_id") == 2, "green").otherwise(F.col("text")))
    assert {(r.doc_id, r.state) for r in index.refresh(spark, root, again).collect()} == {(1, "reused"), (2, "changed"), (3, "gone")}
    assert [r.doc_id for r in index.search(spark, root, "red").collect()] == [1]
    index.mark_stale(spark, root, docs.filter("doc_id = 1"))
    assert index.search(spark, root, "red blue").count() == 0 and index.search(spark, root, "green").count() == 1


def test_commits_add_versions_and_do_not_overwrite_each_other(spark, tmp_path):
    repo, rows = repository.Repository(spark, str(tmp_path / "c")), lambda *x: spark.createDataFrame([(i,) for i in x], "a long")
    values = lambda name, v=None: sorted(r.a for r in repo.table(name, "a long", v).collect())
    assert repo.version() == 0 and values("x") == []
    repo.commit(x=rows(1), y=rows(1, 2))
    repo.commit(x=rows(3))
    assert repo.version() == 2 and values("x") == [3] and values("x", 1) == [1] and values("y") == [1, 2]
    with pytest.raises(RuntimeError, match="changed by another commit: x"):
        repo.commit(1, x=rows(4), y=rows(5))  # made from a version whose x is outdated
    assert repo.version() == 2 and values("y") == [1, 2]
    repo.commit(1, y=rows(6))  # only x changed since
    assert values("x") == [3] and values("y") == [6]
    path = f"{repo.root}/commits/{3:012d}"
    with pytest.raises(FileExistsError):
        store.create_text(spark, path, "other")
    assert json.loads(store.read_text(spark, path)).keys() == {"x", "y"} and len(store.names(spark, f"{repo.root}/commits")) >= 3
    (tmp_path / "c" / "commits" / "_half").write_text("torn")  # what a writer that died leaves
    assert repo.version() == 3


def test_what_comes_back_is_indexed_once(spark, tmp_path):
    root, docs = str(tmp_path / "i"), lambda text: spark.createDataFrame([(1, text), (2, "green")], "doc_id long, text string")
    scores = lambda: [(r.doc_id, r.score) for r in index.search(spark, root, "red").collect()]
    index.refresh(spark, root, docs("red"))
    first = scores()
    index.refresh(spark, root, docs("blue"))
    assert scores() == []
    index.refresh(spark, root, docs("red"))
    assert scores() == first and len(first) == 1
    index.mark_stale(spark, root, docs("red"))
    index.refresh(spark, root, docs("red"))
    assert scores() == first


def test_a_commit_that_fails_changes_nothing(spark, tmp_path):
    repo = repository.Repository(spark, str(tmp_path / "r"))
    repo.commit(a=spark.range(3), b=spark.range(2))
    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        repo.commit(a=spark.range(9), b=bad)
    reader = repository.Repository(spark, repo.root, read_only=True)
    assert reader.table("a").count() == 3 and reader.tables() == ["a", "b"]
    assert reader.table("a", "id long, note string").columns == ["id", "note"] and reader.table("c", "x int").count() == 0
    with pytest.raises(PermissionError):
        reader.commit(a=spark.range(1))


def test_manifest_checks_counts_and_digests(spark, tmp_path):
    root, rows = str(tmp_path), spark.range(5)
    entry = store.write_records(rows, root, "r", ["id"])
    with pytest.raises(ValueError, match="5 rows, expected 4"):
        repository.write_manifest(spark, root, "m", {"r": entry}, {"r": 4})
    path = repository.write_manifest(spark, root, "m", {"r": entry | {"digest": "x"}}, {"r": 5})
    with pytest.raises(ValueError, match="integrity"):
        repository.read_manifest(spark, path, {"r": rows.schema})
    assert repository.read_manifest(spark, path, {}, hydrate=False)[0]["name"] == "m"
    name = repository.save_artifact(rows, root, "a", ["id"])
    assert repository.save_artifact(rows.repartition(3), root, "a", ["id"]) == name
    assert repository.load_artifact(spark, root, "a", name, rows.schema).count() == 5


def test_broken_packages_harm_no_other_file(spark):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("a.txt", b"x" * 100)
    torn = whole.getvalue()[:-30] + b"\0" * 30
    bad = bytearray(whole.getvalue())
    bad[45] ^= 255  # of the member's bytes: its checksum fails
    files = spark.createDataFrame([("p.zip", bytearray(whole.getvalue())), ("t.zip", bytearray(torn)), ("b.zip", bad), ("n.zip", bytearray(b"no package"))], "path string, content binary")
    got = {r.path: r for r in packages.package_members(files).collect()}
    assert got["p.zip"].filename == "a.txt" and got["b.zip"].unsafe == "unreadable: BadZipFile" and got["b.zip"].content is None
    assert got["n.zip"].content == b"no package" and set(got) == {"p.zip", "t.zip", "b.zip", "n.zip"}


def test_nested_tables_and_headings():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    inner = f"<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>"
    body = p("A", "Heading 1") + p("B", "heading3") + p("C", "Heading2") + f"<w:tbl><w:tr><w:tc>{p('x')}{inner}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>" + p(" ") + p("plain", "Headings")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    got = packages.parse_docx(out.getvalue())
    assert [(b["type"], b["text"], b["heading_path"]) for b in got] == [("heading", "A", ["A"]), ("heading", "B", ["A", "B"]), ("heading", "C", ["A", "C"]), ("table", None, ["A", "C"]), ("paragraph", "plain", ["A", "C"])]
    assert got[3]["rows"] == [["xin", "y"]]


def test_explicit_plan_needs_all_its_rows(spark):
    meta = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    want = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert inventory.explicit_plan(want(1, 2), meta, ["k"], 2).count() == 2
    for keys, limit, what in (((1, 3), 5, "not known: 3"), ((1, 2), 1, "more than 1")):
        with pytest.raises(Exception, match=what):
            inventory.explicit_plan(want(*keys), meta, ["k"], limit).collect()


def test_requests_are_normalised():
    r = requests.from_yaml("# a request\nterms:\n  - red   ring\n  - 'blue'\n  - red ring\nmeetings: [\"124\", \"125\"]\nfirst: '120'\nlast: '131'\n")
    got = study.normalize_request(**r)
    assert got == {"terms": ["red ring", "blue"], "meetings": ["124", "125"], "range": ["120", "131"]}
    assert requests.from_yaml(requests.to_yaml(got)) == got
    for bad in ({"terms": ["--", " "]}, {"terms": ["a"], "first": "1"}):
        with pytest.raises(ValueError):
            study.normalize_request(**bad)
    with pytest.raises(ValueError):
        requests.from_yaml("- a\n- b\n")


def test_unknown_decisions_are_errors(spark):
    t = lambda *rows: spark.createDataFrame(rows, "term string, state string")
    d = t(("RED", "accepted")).withColumnRenamed("state", "decision")
    assert [tuple(r) for r in study.decide_terms(t(("red", "candidate")), d).collect()] == [("red", "accepted")]
    with pytest.raises(Exception, match="unknown term: red"):
        study.decide_terms(t(("blue", "candidate")), d).collect()


def test_data_root(spark):
    assert repository.data_root(spark) == "data" and repository.data_root(spark, "x") == "x"


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["queries"]) == 0 and "bm25_search" in capsys.readouterr().out.split()
    assert cli.main(["documents", "thing license der", "--data", SF, "--limit", "3"], spark) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 3 and set(rows[0]) == {"doc_id", "best_pos", "n_hits", "score"}
    assert cli.main(["index", str(tmp_path / "i"), "--query", "thing license der", "--data", SF, "--limit", "2"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["run", "nothing", "--data", SF], spark) == 1 and "KeyError" in capsys.readouterr().err
    (tmp_path / "r.yaml").write_text("terms: [a b]\n")
    assert cli.main(["request", str(tmp_path / "r.yaml")]) == 0 and "a b" in capsys.readouterr().out

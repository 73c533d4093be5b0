"""Operators on small tables, error cases included."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import evidence as E
from docketry.operators import inventory as I
from docketry.operators import links as L
from docketry.operators import metadata as M
from docketry.operators import search as S


def test_phrase_search_takes_the_exact_phrase(spark):
    docs = spark.createDataFrame([(1, "HARQ feedback here\nother line"), (2, "feedback of HARQ\nARQ")], "doc_id long, text string")
    b = S.split_blocks(docs)
    assert [(r.doc_id, r.pos) for r in S.top_blocks(S.search_blocks(b, '"HARQ feedback"')).collect()] == [(1, 0)]
    assert S.search_blocks(b, '"ARQ feedback"').count() == 0 and S.search_blocks(b, "the of").count() == 0


def test_statements_of_a_contribution(spark):
    texts = [("heading", "Discussion"), ("paragraph", "Proposal 1: Use A"), ("paragraph", "Proposal 2"), ("paragraph", "Use immediate RLC recovery."), ("paragraph", "Agreement: no"), ("paragraph", "We propose that B"), ("heading", "Observations"), ("paragraph", "It is slow"), ("paragraph", " ")]
    b = spark.createDataFrame([(1, "m", i, k, t, "contribution") for i, (k, t) in enumerate(texts)], "doc_id int, member string, pos int, type string, text string, role string")
    got = [(r.pos, r.kind, r.basis, r.statement) for r in E.extract_statements(b).orderBy("pos").collect()]
    assert got == [
        (1, "proposal", "label", "Proposal 1: Use A"), (2, "proposal", "label", "Proposal 2\nUse immediate RLC recovery."), (4, "agreement", "rejected", None),
        (5, "proposal", "inline", "We propose that B"), (7, "observation", "heading", "It is slow"),
    ]


def test_merge_keeps_present_values(spark):
    rows = spark.createDataFrame([("a", "t1", "u1", 1, 0), ("a", "", "u2", 3, 0), ("a", "t2", None, 2, 5), ("a", "t3", None, 2, 6), ("b", None, None, 1, 0)], "id string, title string, url string, layer int, apply_order int")
    got = {r.id: (r.title, r.url) for r in M.merge_by_provenance(rows, ["id"], ["title"], ["url"]).collect()}
    assert got == {"a": ("t3", "u1"), "b": (None, None)}


def test_checksum_conflict_is_an_error(spark):
    t = lambda c: spark.createDataFrame([("u", "k", 1, c)], "url string, kind string, at int, checksum string")
    assert M.upsert_artifacts(t("x"), t(None), ["url"], ["kind"], "at", "checksum").first().checksum == "x"
    with pytest.raises(Exception, match="checksum conflict"):
        M.upsert_artifacts(t("x"), t("y"), ["url"], ["kind"], "at", "checksum").collect()


def test_pair_limit_is_an_error_not_a_cut(spark):
    rows = spark.createDataFrame([(i, 1, [f"o{i}"]) for i in range(5)], "id int, scope int, orgs array<string>")
    assert L.disjoint_pairs(rows, "scope", 10).count() == 10
    with pytest.raises(Exception, match="more than 9 pairs"):
        L.disjoint_pairs(rows, "scope", 9).collect()


def test_range_includes_known_suffixed_meetings(spark):
    known = spark.createDataFrame([("124bis",), ("127",), ("119-e",)], "meeting string")
    assert {r.meeting for r in M.expand_range(spark, 124, 126, known).collect()} == {"124", "124bis", "125", "126"}


def test_match_levels(spark):
    rows = [(1, "Contention based uplink access", "", ""), (2, "Contention", "uplink based", "x"), (3, "Contention based things", "", ""), (4, "Access", "", ""), (5, None, None, None)]
    m = I.topic_match(spark.createDataFrame(rows, "id int, title string, abstract string, status string"), "contention based uplink access", ["title", "abstract", "status"])
    assert {r.id: r.level for r in m.collect()} == {1: "HIGH", 2: "LOW", 3: "LOW", 4: None, 5: None}


def test_tables_without_rows(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert S.split_blocks(e).count() == 0 and S.statistics(S.split_blocks(e)).first().n_blocks == 0
    assert S.rollup_documents(S.search_blocks(S.split_blocks(e), "x")).count() == 0


def test_upsert_keeps_old_rows(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(1, None, 5), (3, "c", None)], "k int, x string, y int")
    assert sorted(map(tuple, M.upsert_keep(old, new, ["k"]).collect())) == [(1, "a", 5), (2, "b", 2), (3, "c", None)]


def test_regions_cut_and_say_so(spark):
    b = spark.createDataFrame([(1, "m", i, "heading" if i in (2, 6) else "table" if i == 5 else "paragraph", f"t{i}") for i in range(9)], "doc_id int, member string, pos int, type string, text string")
    got = {r.pos: (r.region, r.truncated) for r in E.regions(b, cap=2).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, True), 3: (3, True), 5: (4, False), 6: (5, True), 7: (5, True)}
    assert F is not None

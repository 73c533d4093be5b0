"""Stored indexes, repositories and manifests, and views and plans over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.functions import text as T
from docketry.operators import index as X
from docketry.operators import inventory as I
from docketry.operators import links as L
from docketry.operators import metadata as M
from docketry.plans import graph_queries as G
from docketry.plans import search_queries as Q
from docketry.plans import study as Y
from docketry.plans.evidence_queries import _B, _blocks
from docketry.plans.search_queries import table
from docketry.sources import repository, store


def _root(spark, name: str) -> str:
    return f"{store.shared_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- index ---------------------------------------------------------------------


def _refreshed(spark, d):
    """An index of an older state of the documents, then brought up to date."""
    docs, root = table(spark, d, "documents").select("doc_id", "text"), _root(spark, "index")
    k = F.col("doc_id")
    older = docs.filter(k % 5 != 0).withColumn("text", F.when(k % 7 == 0, F.concat("text", F.lit(" older words"))).otherwise(F.col("text")))
    X.refresh(spark, root, older)
    return root, X.refresh(spark, root, docs.filter(k % 11 != 0))


def index_refresh(spark, d):
    return _refreshed(spark, d)[1]


def index_state(spark, d):
    root, _ = _refreshed(spark, d)
    return X.state(spark, root).select("doc_id", "status")


def search_from_index(spark, d):
    """The index holds superseded and stale versions; none of them is found."""
    docs, root = table(spark, d, "documents").select("doc_id", "text"), _root(spark, "index")
    X.refresh(spark, root, docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" thing license"))).otherwise(F.col("text"))))
    X.refresh(spark, root, docs)
    hits = X.search(spark, root, "thing license le der erinst")
    return hits.orderBy(F.desc("score"), "doc_id", "pos").limit(20).select("doc_id", "pos", F.array_join("matched", " ").alias("matched"), F.round("score", 6).alias("score"))


def mark_stale(spark, d):
    docs, root = table(spark, d, "documents").select("doc_id", "text"), _root(spark, "index")
    X.refresh(spark, root, docs)
    X.mark_stale(spark, root, table(spark, d, "labels").filter("quality = 0").select("doc_id"))
    return X.search(spark, root, "license").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# --- repository and manifests -----------------------------------------------------


def repository_import(spark, d):
    """Two imports of a meeting: upserts, replaced snapshots, cleared flags."""
    repo = repository.Repository(spark, _root(spark, "repository"))
    o = table(spark, d, "orders")
    art = o.select(F.concat(F.lit("u"), "o_custkey").alias("url"), F.col("o_custkey").alias("size")).distinct()
    snap = lambda n: o.select((F.col("o_custkey") % 3).cast("string").alias("meeting"), F.lit(n).alias("snapshot")).distinct()
    rows = lambda f, title: o.filter(f).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).cast("string").alias("meeting"), title.alias("title"), F.lit(True).alias("current"))
    repo.import_manifest("0", art, snap(1), rows("o_custkey % 3 < 2", F.col("o_orderpriority")))
    repo.import_manifest("0", art, snap(2).filter("meeting = '0'"), rows("o_custkey % 3 = 0 AND o_orderkey % 2 = 0", F.when(F.col("o_orderkey") % 4 == 0, "new")))
    seen = repository.Repository(spark, repo.root, read_only=True)
    n = seen.table("snapshots").agg(F.sum("snapshot").alias("snapshots"))  # one row
    g = seen.table("documents").groupBy("meeting", "current").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("title") == "new").alias("renamed"))
    return g.crossJoin(F.broadcast(n))


def manifest_roundtrip(spark, d):
    """Outputs by content, their receipt with counts, read back and checked."""
    root = _root(spark, "manifest")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    entry = store.write_records(o, root, "orders", ["o_orderkey"])
    older = {"file": entry["path"], "checksum": entry["digest"], "rows": entry["rows"]}
    path = repository.write_manifest(spark, root, "receipt", {"orders": older}, {"orders": entry["rows"]})
    _, tables = repository.read_manifest(spark, path, {"orders": o.schema})
    return tables["orders"].groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("most"))


def artifact_roundtrip(spark, d):
    """An evidence table as an artifact named by its content, loaded and checked."""
    root, e = _root(spark, "artifacts"), G._evidence(spark, d)
    name = repository.save_artifact(e, root, "evidence", ["doc_id"])
    return repository.load_artifact(spark, root, "evidence", name, e.schema).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- views -----------------------------------------------------------------------


def _edges(spark, d):
    return L.reference_edges(G._texts(spark, d))


def study_views(spark, d):
    c = table(spark, d, "customer")
    meta = c.select(F.expr(G._ID.format("c_custkey")).alias("id"))
    evidence = G._evidence(spark, d).select(F.expr(G._ID.format("doc_id")).alias("id"), "kind")
    return Y.study_views(meta, evidence, _edges(spark, d).select("source", "target"))


def document_sections(spark, d):
    meta = table(spark, d, "customer").select(F.expr(G._ID.format("c_custkey")).alias("id"))
    evidence = G._evidence(spark, d).select(F.expr(G._ID.format("doc_id")).alias("id"), "kind")
    view = Y.document_view("R1-100007", meta, evidence, _edges(spark, d).select("source", "target"))
    parts = [rows.groupBy().agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n")) for name, rows in view.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("section", "n")


def block_lookup(spark, d):
    b = _blocks(spark, d)
    rows = F.when(F.col("pos") % 4 == 0, F.array(F.array(F.lit("a"), F.col("text")), F.array(F.lit("c"))))
    b = b.withColumn("rows", rows)
    at = lambda c: F.when(F.col("pos") % 4 == 0, F.lit(c))
    refs = b.select("doc_id", "member", "pos", F.when(F.col("pos") % 4 == 1, 2).alias("start"), F.when(F.col("pos") % 4 == 1, 6).alias("end"), at(0).alias("row"), at(1).alias("cell"))
    return Y.block_lookup(refs, b).select("doc_id", "pos", "located")


def locators(spark, d):
    e = G._evidence(spark, d).select("doc_id", "kind")
    return e.select("doc_id", T.locator(document=F.col("doc_id"), block_kind=F.col("kind"), page=F.lit(None)).alias("at")).distinct()


def logical_identity(spark, d):
    """Rows seen at another time are the same rows."""
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").alias("discovered_at"))
    return e.withColumn("identity", T.logical(e.columns)).groupBy("user_id", "event_type").agg(F.count_distinct("identity").alias("versions"))


def meeting_lookup(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_nationkey")
    return M.point_lookup(n, n_name="nAtIoN_6", n_nationkey=6)


def distinct_metadata(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("seen"))
    found = M.distinct_by_digest(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), columns=["o_custkey", "o_orderstatus"], order="seen")
    return found.select("o_custkey", "o_orderstatus")


def explicit_plan(spark, d):
    wanted = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("c_custkey"))
    return I.explicit_plan(wanted.filter("c_custkey > 0"), table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 25)


def related_ids(spark, d):
    o = table(spark, d, "orders")
    cell = F.concat(F.lit("r1_"), F.col("o_orderkey") + 100000, F.lit("; R2-"), F.col("o_custkey") + 200000, F.lit(", R1-"), F.col("o_orderkey") + 100000, F.lit(" x"))
    return o.select("o_orderkey", F.array_join(R.related_ids(cell), ",").alias("ids"))


def proposition_filter(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.concat(F.lit("N"), "s_nationkey")).alias("orgs"), (F.col("s_suppkey") % 3).cast("string").alias("meeting"), F.when(F.col("s_suppkey") % 2 == 0, "proposal").otherwise("observation").alias("kind"))
    return Y.filter_propositions(s, ["n1", "n2", "n3", "n4"], meetings=["0", "1"], kinds=["proposal"]).select("id", "kind")


def passage_union(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("text"))
    return Y.passages(title=p, note=o, chair=p.filter("doc_id % 2 = 0"), list=o.filter("doc_id % 3 = 0")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


# --- history, links, completion ---------------------------------------------------


def _discussed(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("meeting"), F.expr(G._ID.format("o_custkey")).alias("ref"), (F.col("o_custkey") % 4).alias("body_meeting"), (F.col("o_orderkey") % 3).alias("pos"))


def historical_coverage(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 4 <> 0")
    cand = c.select(F.expr(G._ID.format("c_custkey")).alias("ref"), F.lit(1).alias("tier"), F.lit(1).alias("rank"), F.col("c_mktsegment").alias("signature"), F.col("c_custkey").alias("url"), F.col("c_name").alias("value"))
    cand = cand.unionByName(cand.filter("url % 6 = 1").withColumn("signature", F.lit("other")))
    meetings = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("meeting")).distinct().unionByName(spark.createDataFrame([("2050-01",)], "meeting string"))
    return Y.historical_coverage(_discussed(spark, d), cand, meetings)


def historical_corpus(spark, d):
    return Y.historical_corpus(_discussed(spark, d))


def link_preparation(spark, d):
    c = table(spark, d, "customer").select(F.expr(G._ID.format("c_custkey")).alias("id"), "c_custkey")
    receipts = c.filter("c_custkey % 3 <> 0").withColumn("status", F.when(F.col("c_custkey") % 5 == 0, "failed").otherwise("parsed"))
    states = c.withColumn("status", F.when(F.col("c_custkey") % 2 == 0, "CURRENT").otherwise("STALE"))
    return Y.link_preparation(_edges(spark, d), c.filter("c_custkey % 11 <> 0"), receipts, states)


def _stage(k: int):
    return lambda rows: rows.select("o_orderkey", F.when(F.col("o_orderkey") % k == 0, f"stage {k}").alias("error"))


def completion_run(spark, d):
    """Items stop at their first failing stage."""
    return Y.complete(table(spark, d, "orders").select("o_orderkey"), {"body": _stage(3), "text": _stage(5), "index": _stage(7)}, ["o_orderkey"])


def corpus_completion(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("eligible"))
    return Y.plan_and_complete(o, {"body": _stage(3), "text": _stage(5)}, ["o_orderkey"], 50).groupBy("state", "failed_at").agg(F.count(F.lit(1)).alias("n"))


def profile_decisions(spark, d):
    terms = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().withColumn("state", F.lit("candidate"))
    wanted = table(spark, d, "part").filter("p_size < 10").select(F.upper("p_name").alias("term")).distinct().withColumn("decision", F.lit("accepted"))
    return Y.decide_terms(terms, wanted)


def authority_meeting(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    title = F.concat(F.when(k % 4 == 0, "Report of ").otherwise("Final minutes of "), F.when(k % 5 == 0, "SA1").otherwise("RAN1"), F.lit(" #"), (k % 30 + 100).cast("string"), F.when(k % 7 == 0, "b").otherwise(""), F.lit(" meeting"))
    role = F.when(k % 3 == 0, R.REPORT).when(k % 3 == 1, R.REPORT).otherwise(R.CONTRIBUTION)
    return o.select("o_orderkey", Y.authority_meeting(role, title, F.when(k % 2 == 0, "RAN1").otherwise("RAN2")).alias("x")).select("o_orderkey", "x.meeting", "x.reason")


QUERIES = {f.__name__: f for f in (
    index_refresh, index_state, search_from_index, mark_stale, repository_import, manifest_roundtrip, artifact_roundtrip, study_views, document_sections, block_lookup, locators, logical_identity, meeting_lookup,
    distinct_metadata, explicit_plan, related_ids, proposition_filter, passage_union, historical_coverage, historical_corpus, link_preparation, completion_run, corpus_completion, profile_decisions, authority_meeting,
)}

_EV = f"{G._EXTRACT}, evd AS (SELECT doc_id, kind, statement FROM ev WHERE statement IS NOT NULL)"
_ID = G._ID
_CITED = G._EDGES.replace("e AS (", "cites AS (", 1)
_ENDS = f"{_CITED}, ends AS (SELECT source id, 1 o FROM cites UNION ALL SELECT target, 0 FROM cites), tally AS (SELECT id, sum(o) cites, count(*) - sum(o) cited FROM ends GROUP BY id)"
_HIST = f"h AS (SELECT strftime(o_orderdate, '%Y-%m') meeting, {_ID.format('o_custkey')} AS ref, o_custkey % 4 body_meeting, o_custkey k, o_orderkey % 3 pos FROM orders)"
_FAIL = lambda *ks: "CASE " + " ".join(f"WHEN o_orderkey % {k} = 0 THEN {v}" for k, v in ks)
SQL = {
    "index_refresh": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 AND text IS NOT NULL THEN 'changed' ELSE 'reused' END AS state FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 11 <> 0",
    "index_state": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'STALE' ELSE 'INDEXED' END AS status FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 11 <> 0",
    "search_from_index": Q.SQL["bm25_search"],
    "mark_stale": f"WITH {Q.Q.TOKENS} SELECT doc_id, count(*) n FROM toks WHERE list_contains(tokens, 'license') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id",
    "repository_import": """WITH o AS (SELECT o_orderkey, (o_custkey % 3)::VARCHAR meeting, o_custkey % 3 = 0 AND o_orderkey % 2 = 0 AS again FROM orders WHERE o_custkey % 3 < 2),
s AS (SELECT sum(CASE WHEN meeting = '0' THEN 2 ELSE 1 END)::BIGINT snapshots FROM (SELECT DISTINCT (o_custkey % 3)::VARCHAR meeting FROM orders))
SELECT meeting, meeting <> '0' OR again AS "current", count(*) n, count(*) FILTER (again AND o_orderkey % 4 = 0) renamed, snapshots FROM o, s GROUP BY ALL""",
    "manifest_roundtrip": "SELECT o_orderstatus, count(*) n, max(o_orderkey) most FROM orders GROUP BY 1",
    "artifact_roundtrip": f"WITH {_EV} SELECT kind, count(*) n FROM evd GROUP BY kind",
    "study_views": f"""WITH {_EV}, {_ENDS}, g AS (SELECT {_ID.format('doc_id')} AS id, count(*) evidence, count(DISTINCT kind) kinds FROM evd GROUP BY 1)
SELECT {_ID.format('c_custkey')} AS id, coalesce(evidence, 0) evidence, coalesce(kinds, 0) kinds, coalesce(cites, 0)::BIGINT cites, coalesce(cited, 0)::BIGINT cited FROM customer LEFT JOIN g ON g.id = {_ID.format('c_custkey')} LEFT JOIN tally ON tally.id = {_ID.format('c_custkey')}""",
    "document_sections": f"""WITH {_EV}, {_CITED} SELECT 'metadata' AS section, count(*) n FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'evidence', count(*) FROM evd WHERE doc_id = 7 UNION ALL SELECT 'links', count(*) FROM cites WHERE source = 'R1-100007' OR target = 'R1-100007'""",
    "block_lookup": f"WITH {_B} SELECT doc_id, pos, CASE WHEN pos % 4 = 1 THEN substring(text, 3, 4) ELSE text END AS located FROM b",
    "locators": f"WITH {_EV} SELECT DISTINCT doc_id, 'document ' || doc_id || '; block kind ' || kind AS at FROM evd",
    "logical_identity": "SELECT user_id, event_type, 1::BIGINT versions FROM events GROUP BY ALL",
    "meeting_lookup": "SELECT n_name, n_nationkey FROM nation WHERE lower(n_name) = 'nation_6' AND n_nationkey = 6",
    "distinct_metadata": "SELECT DISTINCT o_custkey, o_orderstatus FROM orders",
    "explicit_plan": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey > 0)",
    "related_ids": "SELECT o_orderkey, 'R1-' || (o_orderkey + 100000) || ',R2-' || (o_custkey + 200000) AS ids FROM orders",
    "proposition_filter": "SELECT s_suppkey id, 'proposal' AS kind FROM supplier WHERE s_nationkey BETWEEN 1 AND 4 AND s_suppkey % 3 < 2 AND s_suppkey % 2 = 0",
    "passage_union": "SELECT 'title' kind, count(*) n, sum(p_partkey)::BIGINT ids FROM part UNION ALL SELECT 'note', count(*), sum(o_orderkey)::BIGINT FROM orders UNION ALL SELECT 'chair', count(*), sum(p_partkey)::BIGINT FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'list', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 3 = 0",
    "historical_coverage": f"""WITH {_HIST}, r AS (SELECT DISTINCT meeting, k FROM h), c AS (SELECT meeting, count(*) AS "references", count(*) FILTER (k % 4 <> 0 AND k % 6 <> 1) resolved, count(*) FILTER (k % 4 <> 0 AND k % 6 = 1) ambiguous, count(*) FILTER (k % 4 = 0) unresolved FROM r GROUP BY meeting)
SELECT *, CASE WHEN resolved = "references" THEN 'complete' ELSE 'partial' END AS completeness FROM c UNION ALL SELECT '2050-01', 0, 0, 0, 0, 'missing'""",
    "historical_corpus": f'WITH {_HIST} SELECT ref, body_meeting, count(*)::BIGINT edges, min(meeting) first_meeting, max(meeting) last_meeting, count(DISTINCT meeting) meetings FROM h GROUP BY ref, body_meeting',
    "link_preparation": f"""WITH {G._EDGES}, t AS (SELECT DISTINCT target FROM e), c AS (SELECT {_ID.format('c_custkey')} AS id, c_custkey k FROM customer)
SELECT target AS id, CASE WHEN k IS NULL OR k % 11 = 0 THEN 'metadata' WHEN k % 3 = 0 THEN 'body' WHEN k % 5 = 0 THEN 'text' WHEN k % 2 <> 0 THEN 'extraction' ELSE 'nothing' END AS needs FROM t LEFT JOIN c ON id = target""",
    "completion_run": f"""SELECT o_orderkey, {_FAIL((3, 0), (5, 1), (7, 2))} ELSE 3 END done, {_FAIL((3, "'body'"), (5, "'text'"), (7, "'index'"))} END failed_at, {_FAIL((3, "'stage 3'"), (5, "'stage 5'"), (7, "'stage 7'"))} END AS error FROM orders""",
    "corpus_completion": f"""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'excluded' WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 50 THEN 'selected' ELSE 'deferred' END AS state FROM orders)
SELECT state, CASE WHEN state = 'selected' THEN {_FAIL((3, "'body'"), (5, "'text'"))} END END failed_at, count(*) n FROM s GROUP BY ALL""",
    "profile_decisions": "SELECT p_name AS term, CASE WHEN bool_or(p_size < 10) THEN 'accepted' ELSE 'candidate' END AS state FROM part GROUP BY p_name",
    "authority_meeting": f"""WITH a AS (SELECT o_orderkey k, o_orderkey % 3 = 2 AS other, o_orderkey % 5 = 0 AS none, o_orderkey % 2 <> 0 AS wrong FROM orders)
SELECT k AS o_orderkey, CASE WHEN NOT other AND NOT none AND NOT wrong THEN (k % 30 + 100) || CASE WHEN k % 7 = 0 THEN 'bis' ELSE '' END END AS meeting,
  CASE WHEN other THEN 'not a meeting report' WHEN none THEN 'title names no meeting' WHEN wrong THEN 'title names another group' END AS reason FROM a""",
}

"""Queries of the composed pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.plans import pipelines as P
from docketry.plans import sql as Q
from docketry.plans.evidence_queries import _B, _blocks
from docketry.plans.search_queries import blocks, table


def proposition_corpus(spark, d):
    b = _blocks(spark, d).filter("type <> 'heading' AND trim(text) <> ''")
    u = b.select("doc_id", F.col("pos").alias("unit"), F.lit("proposal").alias("kind"), "text")
    return P.proposition_corpus(u).select("doc_id", "unit", "segment", "start", "end", "literal", "reason", "group_id")


def discussion_coverage(spark, d):
    b = _blocks(spark, d)
    b = b.withColumn("text", F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit(" R1-"), F.lit(100000) + F.col("doc_id"), F.lit("HARQ"))).otherwise(F.col("text")))
    c = table(spark, d, "customer")
    meta = c.filter("c_custkey % 4 <> 0").select(F.concat(F.lit("R1-"), F.lit(100000) + F.col("c_custkey")).alias("ref")).unionAll(c.filter("c_custkey % 6 = 1").select(F.concat(F.lit("R1-"), F.lit(100000) + F.col("c_custkey")).alias("ref")))
    return P.discussion_coverage(b, meta, "HARQ observation").select("doc_id", "pos", "ref", "anchor_pos", "basis", "state")


def completion_plan(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("eligible"))
    return P.completion_plan(o, ["o_orderkey"], 50).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("most"))


def missing_stages(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", *[((F.col("o_orderkey") % (i + 2)) != 0).alias(s) for i, s in enumerate(P.STAGES)])
    return P.missing_stages(o).select("o_orderkey", F.array_join("missing", ",").alias("missing"), "next")


def relation_corpus(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("scope"), F.array(F.concat(F.lit("n"), F.col("s_nationkey"))).alias("orgs"))
    reviews = spark.createDataFrame([], "pair_id string, review_id long, decision string, sequence int, supersedes long")
    return P.relation_corpus(s, reviews, "scope", None).select("left_id", "right_id", "state")


def report_passages(spark, d):
    r = P.report_passages(blocks(spark, d).select("doc_id", "pos", "text"), "License", 1, 2)
    return r.select("doc_id", "pos", F.size("context").alias("n_context"), "n", "total")


def candidate_inventory(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.lower("p_type").alias("abstract"), "p_brand")
    _, facets = P.candidate_inventory(p, "small red ring", ["title", "abstract"], F.array("p_brand"), "p_partkey")
    return facets.select("value", "n", "first")


QUERIES = {f.__name__: f for f in (proposition_corpus, discussion_coverage, completion_plan, missing_stages, relation_corpus, report_passages, candidate_inventory)}

_STAGE = lambda i, s: f"CASE WHEN o_orderkey % {i + 2} = 0 THEN '{s}' END"
SQL = {
    "proposition_corpus": f"""WITH {_B}, u AS (SELECT doc_id, pos, trim(text) t FROM b WHERE type <> 'heading' AND trim(text) <> ''), g AS (SELECT doc_id, t, count(*) n FROM u GROUP BY ALL)
SELECT doc_id, pos AS unit, 0 AS segment, 0 AS start, length(t)::INT AS "end", t AS literal, 'whole' AS reason, CASE WHEN n > 1 THEN substring(sha256(doc_id || '|proposal|' || lower(t)), 1, 24) END group_id FROM u JOIN g USING (doc_id, t)""",
    "discussion_coverage": f"""WITH {_B}, h AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) hp, CASE WHEN pos % 3 = 0 THEN 'R1-' || (100000 + doc_id) END AS ref FROM b),
r AS (SELECT *, sum((type = 'heading' OR hp IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) region FROM h),
a AS (SELECT doc_id, region, pos apos FROM r WHERE ref IS NOT NULL OR text = 'Observation'),
j AS (SELECT r.doc_id, r.pos, ref, apos, row_number() OVER (PARTITION BY r.doc_id, r.pos ORDER BY (apos <> r.pos)::INT, apos) k FROM r JOIN a ON r.doc_id = a.doc_id AND r.region = a.region WHERE ref IS NOT NULL)
SELECT doc_id, pos, ref, apos anchor_pos, CASE WHEN apos = pos THEN 'same_block' ELSE 'same_section' END basis,
  CASE (doc_id % 4 <> 0)::INT + (doc_id % 6 = 1)::INT WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM j JOIN customer ON c_custkey = doc_id WHERE k = 1""",
    "completion_plan": """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'excluded' WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 50 THEN 'selected' ELSE 'deferred' END AS state FROM orders) SELECT state, count(*) n, max(o_orderkey) most FROM s GROUP BY state""",
    "missing_stages": f"SELECT o_orderkey, concat_ws(',', {', '.join(_STAGE(i, s) for i, s in enumerate(P.STAGES))}) missing, coalesce({', '.join(_STAGE(i, s) for i, s in enumerate(P.STAGES))}) AS next FROM orders",
    "relation_corpus": "SELECT a.s_suppkey left_id, b.s_suppkey right_id, 'pending' AS state FROM supplier a JOIN supplier b ON a.s_suppkey % 5 = b.s_suppkey % 5 AND a.s_suppkey < b.s_suppkey AND a.s_nationkey <> b.s_nationkey",
    "report_passages": rf"""WITH {Q.BLOCKS}, h AS (SELECT doc_id, pos FROM blocks WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])license([^A-Za-z0-9]|$)')),
c AS (SELECT h.doc_id, h.pos, count(b.pos)::INT n_context FROM h LEFT JOIN blocks b ON b.doc_id = h.doc_id AND abs(b.pos - h.pos) = 1 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT n, count(*) OVER (PARTITION BY doc_id) total FROM c) SELECT * FROM k WHERE n <= 2""",
    "candidate_inventory": """WITH m AS (SELECT p_partkey, p_brand, list_intersect(['small', 'red', 'ring'], string_split(lower(p_name), ' ')) t, list_intersect(['small', 'red', 'ring'], string_split(lower(p_type), ' ')) b FROM part),
l AS (SELECT *, len(list_distinct(t || b)) z FROM m WHERE len(t) + len(b) > 0) SELECT p_brand AS value, count(*) n, min(p_partkey) AS "first" FROM l WHERE len(t) = 3 OR len(b) = 3 OR z >= 2 GROUP BY 1""",
}

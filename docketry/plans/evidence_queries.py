"""Extraction, region and context queries.

Conversation turns play note blocks: a conversation is a document, its turn the
position, every fifth a heading; orders of a customer play statements in order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.operators import evidence as E
from docketry.plans.search_queries import table

#: Openings of the carrier blocks, in turn.
OPENINGS = ["Proposal 1: use it", "Observation", "plain words", "FFS:", "we propose that it holds", "Agreement: so", "the meeting decided it", "Decision", ""]
HEADS = ["1. Proposals", "Scope", "2 Agreements:", "Open issues"]


def _blocks(spark, d):
    o = table(spark, d, "orders")
    pos = F.row_number().over(E.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    k = F.col("o_orderkey")
    b = o.select(F.col("o_custkey").alias("doc_id"), F.lit("m").alias("member"), pos.alias("pos"), "o_orderkey", F.when(k % 6 == 0, "heading").otherwise("paragraph").alias("type"))
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    text = F.when(F.col("type") == "heading", pick(HEADS, F.floor(k / 6) % len(HEADS))).otherwise(pick(OPENINGS, F.floor(k / 5) % len(OPENINGS)))
    role = F.when(F.col("doc_id") % 3 == 0, R.REPORT).when(F.col("doc_id") % 3 == 1, R.CONTRIBUTION).otherwise("unknown")
    return b.withColumn("text", text).withColumn("role", role).drop("o_orderkey")


def evidence_extract(spark, d):
    return E.extract_statements(_blocks(spark, d)).select("doc_id", "pos", "kind", "basis", "statement")


def evidence_listing(spark, d):
    """Kinds and scope by IN filters, the limit only after the state join."""
    states = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("doc_id"))
    e = E.extract_statements(_blocks(spark, d)).filter("basis <> 'rejected'").filter(F.col("kind").isin("proposal", "agreement"))
    return e.join(states, "doc_id", "left_semi").orderBy("doc_id", "pos").limit(100).select("doc_id", "pos", "kind")


def evidence_sequence(spark, d):
    e = E.extract_statements(_blocks(spark, d))
    return E.number_evidence(e, "doc_id", ["kind", "pos"]).select("doc_id", "pos", "sequence")


def heading_state(spark, d):
    b = E.with_heading(_blocks(spark, d)).withColumn("kind", R.heading_kind(F.col("heading")))
    return b.select("doc_id", "pos", "heading", F.when(F.coalesce(R.allowed(F.col("role"), F.col("kind")), F.lit(False)), F.col("kind")).alias("kind"))


def consume_parity(spark, d):
    b = _blocks(spark, d).withColumn("eligible", F.col("text").isin("Observation", "FFS:", "Decision"))
    return E.with_consumption(b).select("doc_id", "pos", "taker", "taken")


def role_gate_semi(spark, d):
    b = _blocks(spark, d).withColumn("member", F.concat(F.lit("f"), F.col("pos") % 3, F.lit(".docx")))
    members = b.select("doc_id", "member").distinct().withColumn("status", F.when((F.col("doc_id") + F.length("member")) % 2 == 0, "parsed").otherwise("failed"))
    members = members.withColumn("status", F.when(F.col("member") == "f1.docx", "failed").otherwise(F.col("status")))
    return E.member_gate(b, members).groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("n"))


def region_islands(spark, d):
    return E.regions(_blocks(spark, d)).select("doc_id", "pos", "region", "region_size")


def section_cap(spark, d):
    r = E.regions(_blocks(spark, d), cap=4)
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.max("in_region").alias("largest"), F.count_if("truncated").alias("truncated"))


def associations(spark, d):
    r = E.regions(_blocks(spark, d))
    anchors = r.filter("text LIKE '%Observation%' OR text LIKE 'Proposal%'").select("doc_id", "region", "pos", F.col("text").alias("anchor"))
    refs = r.filter("pos % 2 = 0").select("doc_id", "region", "pos", F.concat(F.lit("R1-"), F.lit(100000) + F.col("pos")).alias("ref"))
    return E.associate(anchors, refs, ["doc_id", "region"]).select("doc_id", "pos", "ref", "anchor", "anchor_pos", "basis")


def adjacent_context(spark, d):
    c = E.adjacent_context(_blocks(spark, d), F.col("text").startswith("FFS"), 1, ("doc_id", "member"))
    return c.select("doc_id", "pos", F.array_join(F.transform("context", lambda x: x["text"]), "|").alias("context"))


def forward_context(spark, d):
    c = E.forward_context(_blocks(spark, d), F.col("text").startswith("Proposal"), F.col("text").isin("Observation", "plain words", "FFS:"), ("doc_id", "member"))
    return c.select("doc_id", "pos", "n_context")


def heading_paths(spark, d):
    b = _blocks(spark, d).withColumn("level", F.when(F.col("type") == "heading", F.col("pos") % 3 + 1))
    return E.heading_path(b, 3).select("doc_id", "pos", F.array_join("heading_path", " > ").alias("path"))


def option_parent(spark, d):
    b = _blocks(spark, d)
    text = F.when(F.col("pos") % 5 == 1, "We see the following options:").when(F.col("pos") % 5 < 4, F.concat(F.lit("Option "), F.col("pos"), F.lit(": x"))).otherwise("other")
    return E.option_parents(b.withColumn("text", text)).filter("option").select("doc_id", "pos", "parent")


def span_mapping(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    spans = F.array(F.struct((k % 10).alias("start"), (k % 10 + 20).alias("end")), F.struct((k % 10 + 50).alias("start"), (k % 10 + 60).alias("end")))
    s = o.select(F.col("o_orderkey").alias("id"), spans.alias("spans"), (k % 30).alias("m_start"), (k % 30 + 3).alias("m_end"))
    return E.matched_span(s)


def table_label_rows(spark, d):
    b = _blocks(spark, d).filter("pos <= 2")
    rows = F.array(F.array(F.lit("HARQ"), F.concat(F.lit("Proposal "), F.col("pos"), F.lit(": a"))), F.array(F.lit("Decision: b"), F.lit("Proposal: c")), F.array(F.lit("x"), F.lit("y")))
    return E.table_statements(b.withColumn("type", F.lit("table")).withColumn("rows", rows)).select("doc_id", "pos", "row", "cell", "kind", "text", "allowed")


QUERIES = {f.__name__: f for f in (
    evidence_extract, evidence_listing, evidence_sequence, heading_state, consume_parity, role_gate_semi, region_islands, section_cap, associations, adjacent_context, forward_context,
    heading_paths, option_parent, span_mapping, table_label_rows,
)}

_B = f"""b AS (SELECT o_custkey doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) pos, CASE WHEN o_orderkey % 6 = 0 THEN 'heading' ELSE 'paragraph' END AS type,
  CASE WHEN o_orderkey % 6 = 0 THEN {HEADS!r}[(o_orderkey // 6) % {len(HEADS)} + 1] ELSE {OPENINGS!r}[(o_orderkey // 5) % {len(OPENINGS)} + 1] END AS text,
  CASE o_custkey % 3 WHEN 0 THEN '{R.REPORT}' WHEN 1 THEN '{R.CONTRIBUTION}' ELSE 'unknown' END AS role FROM orders)""".replace('"', "'")
_ALLOW = lambda kind: "coalesce(CASE " + " ".join(f"WHEN role = '{r}' THEN {kind} IN ({', '.join(repr(k) for k in ks)})" for r, ks in R.AUTHORITY.items()) + " ELSE false END, false)"
_HK = "CASE heading WHEN '1. Proposals' THEN 'proposal' WHEN '2 Agreements:' THEN 'agreement' WHEN 'Open issues' THEN 'ffs' END"
_HEADED = f"{_B}, h AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) heading FROM b)"


def _consume(eligible: str, source: str) -> str:
    return f"""e AS (SELECT *, coalesce(({eligible}) AND lead(type <> 'heading' AND trim(text) <> '') OVER (PARTITION BY doc_id ORDER BY pos), false) may FROM {source}),
e1 AS (SELECT *, sum((NOT may)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) run FROM e),
e2 AS (SELECT *, may AND sum(may::INT) OVER (PARTITION BY doc_id, run ORDER BY pos ROWS UNBOUNDED PRECEDING) % 2 = 1 taker FROM e1),
e3 AS (SELECT *, coalesce(lag(taker) OVER (PARTITION BY doc_id ORDER BY pos), false) taken, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) nxt FROM e2)"""


_LK = "CASE WHEN type = 'heading' THEN NULL WHEN text LIKE 'Proposal%' THEN 'proposal' WHEN text LIKE 'Observation%' THEN 'observation' WHEN text LIKE 'Agreement%' THEN 'agreement' WHEN text LIKE 'Decision%' THEN 'decision' WHEN text LIKE 'FFS%' THEN 'ffs' END"
_IK = "CASE WHEN text LIKE 'we propose that%' THEN 'proposal' WHEN text LIKE 'the meeting decided%' THEN 'decision' END"
_IOK = f"CASE WHEN text LIKE 'we propose that%' THEN role = '{R.CONTRIBUTION}' WHEN text LIKE 'the meeting decided%' THEN role = '{R.REPORT}' END"
_EXTRACT = f"""{_HEADED}, l AS (SELECT *, {_LK} lk, {_IK} ik, {_IOK} iok, {_HK} hk FROM h), {_consume("lk IS NOT NULL AND " + _ALLOW("lk") + " AND text IN ('Observation', 'FFS:', 'Decision')", "l")},
x AS (SELECT doc_id, pos, CASE WHEN lk IS NOT NULL THEN lk WHEN ik IS NOT NULL THEN ik ELSE hk END kind,
  CASE WHEN lk IS NOT NULL THEN CASE WHEN {_ALLOW('lk')} THEN 'label' ELSE 'rejected' END WHEN ik IS NOT NULL THEN CASE WHEN iok THEN 'inline' ELSE 'rejected' END WHEN {_ALLOW('hk')} THEN 'heading' END basis,
  CASE WHEN taker THEN text || chr(10) || nxt ELSE text END st FROM e3 WHERE type <> 'heading' AND NOT taken AND trim(text) <> ''),
ev AS (SELECT doc_id, pos, kind, basis, CASE WHEN basis <> 'rejected' THEN st END AS statement FROM x WHERE basis IS NOT NULL)"""
_REG = f"""{_HEADED}, g AS (SELECT *, sum((type = 'heading' OR heading IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) region FROM h),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, region) region_size, row_number() OVER (PARTITION BY doc_id, region ORDER BY pos) k FROM g)"""
SQL = {
    "evidence_extract": f"WITH {_EXTRACT} SELECT * FROM ev",
    "evidence_listing": f"WITH {_EXTRACT} SELECT doc_id, pos, kind FROM ev WHERE basis <> 'rejected' AND kind IN ('proposal', 'agreement') AND doc_id % 4 <> 0 ORDER BY doc_id, pos LIMIT 100",
    "evidence_sequence": f"WITH {_EXTRACT} SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id ORDER BY kind, pos) - 1)::INT AS sequence FROM ev",
    "heading_state": f"WITH {_HEADED} SELECT doc_id, pos, heading, CASE WHEN {_ALLOW(_HK)} THEN {_HK} END kind FROM h",
    "consume_parity": f"""WITH {_B}, {_consume("text IN ('Observation', 'FFS:', 'Decision')", "b")} SELECT doc_id, pos, taker, taken FROM e3""",
    "role_gate_semi": f"WITH {_B} SELECT doc_id, role, count(*) n FROM b WHERE role <> '{R.REPORT}' OR (pos % 3 <> 1 AND doc_id % 2 = 1) GROUP BY ALL",
    "region_islands": f"WITH {_REG} SELECT doc_id, pos, region, region_size FROM r",
    "section_cap": f"WITH {_REG} SELECT doc_id, count(*) kept, max(k) largest, count(*) FILTER (region_size > 4) truncated FROM r WHERE k <= 4 GROUP BY doc_id",
    "associations": f"""WITH {_REG}, a AS (SELECT doc_id, region, pos apos, text anchor FROM r WHERE text LIKE '%Observation%' OR text LIKE 'Proposal%'),
j AS (SELECT r.doc_id, r.pos, 'R1-' || (100000 + r.pos) AS ref, anchor, apos, row_number() OVER (PARTITION BY r.doc_id, r.pos ORDER BY (apos <> r.pos)::INT, apos) k FROM r JOIN a ON r.doc_id = a.doc_id AND r.region = a.region WHERE r.pos % 2 = 0)
SELECT doc_id, pos, ref, anchor, apos anchor_pos, CASE WHEN apos = pos THEN 'same_block' ELSE 'same_section' END basis FROM j WHERE k = 1""",
    "adjacent_context": f"""WITH {_B} SELECT h.doc_id, h.pos, coalesce(string_agg(n.text, '|' ORDER BY n.pos), '') context FROM b h LEFT JOIN b n ON h.doc_id = n.doc_id AND abs(h.pos - n.pos) = 1 AND trim(n.text) <> '' WHERE h.text LIKE 'FFS%' GROUP BY ALL""",
    "forward_context": f"""WITH {_B}, l AS (SELECT *, text IN ('Observation', 'plain words', 'FFS:') ok FROM b), w AS (SELECT *, coalesce(lead(ok, 1) OVER p, false) a, coalesce(lead(ok, 2) OVER p, false) b2, coalesce(lead(ok, 3) OVER p, false) c FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, a::INT + (a AND b2)::INT + (a AND b2 AND c)::INT n_context FROM w WHERE text LIKE 'Proposal%'""",
    "heading_paths": f"""WITH {_B}, z AS (SELECT *, CASE WHEN type = 'heading' THEN pos % 3 + 1 END lv FROM b),
p AS (SELECT doc_id, pos, {', '.join(f"max(CASE WHEN lv = {k} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) p{k}" for k in (1, 2, 3))} FROM z),
t AS (SELECT p.doc_id, p.pos, z1.text t1, CASE WHEN p2 > coalesce(p1, -1) THEN z2.text END t2, CASE WHEN p3 > coalesce(p1, -1) AND p3 > coalesce(p2, -1) THEN z3.text END t3
  FROM p LEFT JOIN b z1 ON z1.doc_id = p.doc_id AND z1.pos = p1 LEFT JOIN b z2 ON z2.doc_id = p.doc_id AND z2.pos = p2 LEFT JOIN b z3 ON z3.doc_id = p.doc_id AND z3.pos = p3)
SELECT doc_id, pos, concat_ws(' > ', t1, t2, t3) AS path FROM t""",
    "option_parent": f"WITH {_B} SELECT doc_id, pos, CASE WHEN pos % 5 = 2 THEN pos - 1 WHEN pos % 5 = 3 THEN pos - 2 END parent FROM b WHERE pos % 5 NOT IN (1, 4)",
    "span_mapping": """WITH s AS (SELECT o_orderkey id, o_orderkey % 10 a, o_orderkey % 30 m FROM orders)
SELECT id, CASE WHEN m + 3 <= 20 THEN 0 ELSE 1 END AS span, CASE WHEN m + 3 <= 20 THEN a + m ELSE a + 50 + m - 21 END AS start, CASE WHEN m + 3 <= 20 THEN a + m + 3 ELSE a + 50 + m + 3 - 21 END AS "end" FROM s WHERE m + 3 <= 20 OR (m >= 21 AND m + 3 <= 31)""",
    "table_label_rows": f"""WITH {_B}, x AS (SELECT * FROM b WHERE pos <= 2), t AS (SELECT doc_id, pos, role, 0 AS row, 1 cell, 'proposal' kind, 'Proposal ' || pos || ': a' AS text FROM x UNION ALL SELECT doc_id, pos, role, 1, 0, 'decision', 'Decision: b' FROM x)
SELECT doc_id, pos, row, cell, kind, text, {_ALLOW('kind')} allowed FROM t""",
}

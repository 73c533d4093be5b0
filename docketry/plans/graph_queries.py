"""Links, pairs, terms, report passages; orders play documents that cite others."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.functions import text as T
from docketry.operators import evidence as E
from docketry.operators import inventory as I
from docketry.operators import links as L
from docketry.operators import search as S
from docketry.operators import topics as P
from docketry.plans import pipelines as C
from docketry.plans import sql as Q
from docketry.plans.evidence_queries import _B, _EXTRACT, _blocks
from docketry.plans.search_queries import blocks, table

_ID = "'R1-' || (100000 + {0})"
_CITES = "CASE o_orderkey % 4 WHEN 0 THEN 'revision of ' WHEN 1 THEN 'reply to ' WHEN 2 THEN 'replaces ' ELSE 'see ' END || " + _ID.format("o_custkey") + " || ' . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . . and ' || " + _ID.format("o_orderkey")


def _texts(spark, d):
    return table(spark, d, "orders").select(F.expr(_ID.format("o_orderkey")).alias("source"), F.expr(_CITES).alias("text"))


def link_edges(spark, d):
    return L.reference_edges(_texts(spark, d))


def _nodes(spark, d):
    c = table(spark, d, "customer")
    return c.filter("c_custkey % 5 <> 0").select(F.expr(_ID.format("c_custkey")).alias("node"), F.col("c_mktsegment").alias("identity")).unionByName(
        c.filter("c_custkey % 7 = 0").select(F.expr(_ID.format("c_custkey")).alias("node"), F.lit("other").alias("identity"))
    )


def link_resolution(spark, d):
    return L.resolve_targets(L.reference_edges(_texts(spark, d)), _nodes(spark, d)).select("source", "target", "state", "identity")


def link_status_axes(spark, d):
    e = L.resolve_targets(L.reference_edges(_texts(spark, d)), _nodes(spark, d)).withColumn("cross", F.col("relation") == "revision")
    return L.status_axes(_nodes(spark, d).select("node").distinct(), e)


def link_diagnostics(spark, d):
    return L.diagnostics(L.resolve_targets(L.reference_edges(_texts(spark, d)), _nodes(spark, d)))


def distinct_link_ids(spark, d):
    e = L.reference_edges(_texts(spark, d)).select("target", "relation")
    return L.distinct_links(e, "target", "relation").select("target", "relation", "link_id")


def coverage_priority(spark, d):
    states = list(R.COVERAGE_PRIORITY)
    e = table(spark, d, "events")
    s = F.element_at(F.array(*map(F.lit, states)), ((F.col("event_id") * 3 + F.col("user_id")) % len(states) + 1).cast("int"))
    return L.coverage_state(e.select("user_id", s.alias("state"), F.col("event_id").alias("order")), "user_id")


def graph_mentions(spark, d):
    """Sources whose links name a wanted target: a semi join, then a filter."""
    e = L.reference_edges(_texts(spark, d))
    wanted = table(spark, d, "customer").filter("c_nationkey = 3").select(F.expr(_ID.format("c_custkey")).alias("target"))
    return L.mentions(e, wanted, ["revision", "reply"]).select("source", "target", "relation")


def contribution_without_link(spark, d):
    nodes = table(spark, d, "customer").select(F.expr(_ID.format("c_custkey")).alias("node"))
    return L.without_link(nodes, L.reference_edges(_texts(spark, d)), "revision")


def metadata_only_anti(spark, d):
    """Titles that share a query token and are on no order line of size."""
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return I.metadata_only(table(spark, d, "part").select("p_partkey", "p_name"), used, "p_partkey", "p_name", "red ring")


def disjoint_pairs(spark, d):
    s = table(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("scope"), F.when(F.col("s_suppkey") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("N"), F.col("s_nationkey")), F.concat(F.lit("n"), F.col("s_nationkey") % 3))).alias("orgs"))
    return L.disjoint_pairs(rows, "scope")


def pair_identity(spark, d):
    p = disjoint_pairs(spark, d)
    return p.select("left_id", "right_id", L.pair_identity(F.col("right_id"), F.col("left_id")).alias("pair_id"))


def accepted_reviews(spark, d):
    o = table(spark, d, "orders")
    reviews = o.select("o_custkey", F.col("o_orderkey").alias("sequence"), F.col("o_orderstatus").alias("decision"))
    return L.accepted(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), reviews, "o_custkey", ["F"])


def basis_spans(spark, d):
    b = table(spark, d, "benchmark")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(e).alias("end")) for a, e in ((0, 5), (7, 12), (10, 15))])
    s = b.select("item_id", "text", F.explode(F.slice(spans, 1, (F.col("item_id") % 3 + 1).cast("int"))).alias("s")).select("item_id", "text", "s.start", "s.end")
    s = s.withColumn("exact", F.when((F.col("item_id") % 4 == 0) & (F.col("start") == 0), "no").otherwise(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))))
    return L.basis_spans_valid(s, "item_id")


# --- terms -----------------------------------------------------------------------


def term_occurrences(spark, d):
    return P.occurrences(blocks(spark, d).select("doc_id", "pos", "text"), "MIT license").select("doc_id", "pos", "start", "end", "literal")


_PASSAGE = "p_name || ' ' || p_type || ', ' || p_name || '; ' || lower(p_brand) || ' code'"


def _found(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 7).alias("meeting"), F.element_at(F.array(F.lit("chair"), F.lit("title"), F.lit("note")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("kind"), F.expr(_PASSAGE).alias("text"))
    return P.candidate_windows(p, ["ring", "bolt"])


def term_windows(spark, d):
    return _found(spark, d).select("doc_id", "segment", "term", "state")


def term_support_score(spark, d):
    f = _found(spark, d).withColumn("term", F.lower("term"))
    return P.support(f)


def term_candidates(spark, d):
    f = _found(spark, d).withColumn("term", F.lower("term"))
    return P.term_list(P.support(f), 10).select("term", "state", "score")


def corpus_record_merge(spark, d):
    o = table(spark, d, "orders")
    r = o.select("o_custkey", F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("orgs"), F.array((F.col("o_orderkey") % 10).cast("string")).alias("associations"), (F.col("o_totalprice") > 400000).alias("flag"), F.when(F.col("o_custkey") % 3 == 0, "m").otherwise(F.col("o_orderstatus")).alias("meeting"))
    m = P.merge_records(r, "o_custkey")
    return m.select("o_custkey", F.array_join("orgs", ",").alias("orgs"), F.array_join("associations", ",").alias("associations"), "flag", "meeting")


def unit_accounting(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return P.accounting(c, o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["k"])


def event_timeline(spark, d):
    e = table(spark, d, "events")
    t = P.timeline(e.select("user_id", "ts", F.col("event_type").alias("event")), "user_id", F.col("ts"))
    return t.select("user_id", F.array_join("events", ">").alias("events"))


def gaps_distinct(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("reason"))
    return P.distinct_gaps(o).select("gap")


def output_caps(spark, d):
    e = table(spark, d, "events")
    return P.capped(e, "event_type", [F.desc("value"), "event_id"], 25).select("event_type", "event_id", "n", "total")


def outcome_passages(spark, d):
    return P.outcomes(_blocks(spark, d), 2, ("doc_id", "member"), "plain words").select("doc_id", "pos", "n_following")


def topic_bundle(spark, d):
    """Best documents of a query with their labels, and those without any."""
    hits, _ = C.topic_study(blocks(spark, d), _evidence(spark, d), "license apache", most=50)
    labels = table(spark, d, "labels")
    return hits.join(labels, "doc_id", "left").select("doc_id", "n_hits", "quality", F.col("quality").isNull().alias("unresolved"))


def _evidence(spark, d):
    return E.extract_statements(_blocks(spark, d)).filter("statement IS NOT NULL").select("doc_id", "kind", "statement")


def topic_evidence(spark, d):
    """Evidence that shares a token with the query, the first of each kind."""
    _, near = C.topic_study(blocks(spark, d), _evidence(spark, d), "proposal license", per_group=10)
    return near.select("kind", "doc_id", "statement", "rank", "truncated")


def organization_groups(spark, d):
    """Evidence grouped by organisation, unknown where there is none."""
    s = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang")).alias("orgs"))
    return I.facet(s, F.col("orgs"), "doc_id").select(F.col("value").alias("org"), "n", "first")


def topic_coverage(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return P.study_counts(
        o.select((F.col("o_orderstatus") == "F").alias("indexed"), (F.col("o_orderstatus") == "O").alias("extracted")),
        l.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_returnflag") == "R").alias("statement")),
    )


QUERIES = {f.__name__: f for f in (
    link_edges, link_resolution, link_status_axes, link_diagnostics, distinct_link_ids, coverage_priority, graph_mentions, contribution_without_link, metadata_only_anti, disjoint_pairs, pair_identity, accepted_reviews,
    basis_spans, term_occurrences, term_windows, term_support_score, term_candidates, corpus_record_merge, unit_accounting, event_timeline, gaps_distinct, output_caps, outcome_passages, topic_bundle, topic_evidence, organization_groups, topic_coverage,
)}

_REL = "CASE o_orderkey % 4 WHEN 0 THEN 'revision' WHEN 1 THEN 'reply' WHEN 2 THEN 'supersession' ELSE 'reference' END"
_EDGES = f"e AS (SELECT {_ID.format('o_orderkey')} source, {_ID.format('o_custkey')} target, strpos({_CITES}, 'R1-')::INT - 1 AS start, {_REL} relation FROM orders WHERE o_orderkey <> o_custkey)"
_RES = f"""{_EDGES}, n0 AS (SELECT {_ID.format('c_custkey')} node, c_mktsegment identity FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT {_ID.format('c_custkey')}, 'other' FROM customer WHERE c_custkey % 7 = 0),
n AS (SELECT node, count(DISTINCT identity) k, min(identity) identity FROM n0 GROUP BY node), r AS (SELECT e.*, CASE WHEN k IS NULL THEN 'unresolved' WHEN k > 1 THEN 'ambiguous' ELSE 'linked' END state, CASE WHEN k = 1 THEN identity END identity FROM e LEFT JOIN n ON target = node)"""
_PAIRS = """s AS (SELECT s_suppkey id, s_suppkey % 5 scope, ['n' || s_nationkey, 'n' || (s_nationkey % 3)] orgs FROM supplier WHERE s_suppkey % 11 <> 0), p AS (SELECT a.scope, a.id left_id, b.id right_id FROM s a JOIN s b ON a.scope = b.scope AND a.id < b.id AND NOT list_has_any(a.orgs, b.orgs))"""
_WIN = f"""t AS (SELECT p_partkey doc_id, p_size % 7 meeting, ['chair', 'title', 'note'][p_partkey % 3 + 1] kind, {_PASSAGE} AS x FROM part), t1 AS (SELECT *, regexp_extract_all(x, '[^,;/|\\n]+') ss FROM t WHERE contains(lower(x), 'ring') OR contains(lower(x), 'bolt')),
t2 AS (SELECT doc_id, meeting, kind, unnest(ss) s, generate_subscripts(ss, 1) - 1 AS segment FROM t1), t3 AS (SELECT *, regexp_extract_all(s, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*') w FROM t2),
t4 AS (SELECT *, list_filter(range(0, len(w)), lambda i: lower(w[i + 1]) IN ('ring', 'bolt')) a FROM t3),
t5 AS (SELECT *, CASE WHEN len(a) > 0 THEN list_slice(w, list_min(a) + 1, list_min(a) + least(greatest(least(list_max(a) + 1, len(w) - 1) - list_min(a) + 1, 2), 4)) WHEN len(w) BETWEEN 2 AND 4 THEN w END tm FROM t4),
found AS (SELECT doc_id, meeting, kind, segment, array_to_string(tm, ' ') term, CASE WHEN len(a) > 0 THEN 'candidate' ELSE 'related' END state FROM t5 WHERE len(tm) >= 2),
sup AS (SELECT lower(term) term, state, count(*) n, count(DISTINCT meeting) meetings, count(DISTINCT doc_id) documents, count(*) FILTER (kind = 'chair') chair, count(*) FILTER (kind = 'title') titles, min(meeting) first_meeting, max(meeting) last_meeting FROM (SELECT DISTINCT doc_id, meeting, kind, segment, lower(term) term, state FROM found) GROUP BY 1, 2),
scored AS (SELECT *, n + 3 * meetings + 2 * documents + 2 * chair + titles score FROM sup)"""
SQL = {
    "link_edges": f"WITH {_EDGES} SELECT * FROM e",
    "link_resolution": f"WITH {_RES} SELECT source, target, state, identity FROM r",
    "link_status_axes": f"""WITH {_RES}, x AS (SELECT source node, true o, state, relation = 'revision' c FROM r UNION ALL SELECT target, false, state, relation = 'revision' FROM r), g AS (SELECT node, bool_or(o) refers, bool_or(NOT o) referred, bool_or(c) cross_meeting, bool_or(state <> 'linked') AS "open" FROM x GROUP BY node)
SELECT n.node, coalesce(refers, false) refers, coalesce(referred, false) referred, coalesce(cross_meeting, false) cross_meeting, coalesce("open", false) AS "open" FROM n LEFT JOIN g USING (node)""",
    "link_diagnostics": f"WITH {_RES} SELECT count(*) n, count(*) FILTER (state = 'linked') linked, count(*) FILTER (state = 'ambiguous') ambiguous, count(*) FILTER (state = 'unresolved') unresolved, CASE WHEN bool_or(state = 'ambiguous') THEN 'partial' WHEN bool_or(state = 'unresolved') THEN 'incomplete' ELSE 'complete' END completeness FROM r",
    "distinct_link_ids": f"""WITH {_EDGES} SELECT DISTINCT target, relation, sha256('{{"relation":"' || relation || '","target":"' || target || '"}}') link_id FROM e""",
    "coverage_priority": f"""WITH s AS (SELECT user_id, {list(R.COVERAGE_PRIORITY)!r}[(event_id * 3 + user_id) % {len(R.COVERAGE_PRIORITY)} + 1] state, event_id FROM events)
SELECT user_id, arg_max(state, (MAP({list(R.COVERAGE_PRIORITY)!r}, {list(R.COVERAGE_PRIORITY.values())!r})[state], -event_id)) state FROM s GROUP BY user_id""",
    "graph_mentions": f"WITH {_EDGES} SELECT source, target, relation FROM e WHERE relation IN ('revision', 'reply') AND target IN (SELECT {_ID.format('c_custkey')} FROM customer WHERE c_nationkey = 3)",
    "contribution_without_link": f"WITH {_EDGES} SELECT {_ID.format('c_custkey')} node FROM customer EXCEPT SELECT target FROM e WHERE relation = 'revision'",
    "metadata_only_anti": "SELECT p_partkey, p_name FROM part WHERE (list_contains(string_split(lower(p_name), ' '), 'red') OR list_contains(string_split(lower(p_name), ' '), 'ring')) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "disjoint_pairs": f"WITH {_PAIRS} SELECT * FROM p",
    "pair_identity": f"""WITH {_PAIRS} SELECT left_id, right_id, sha256('{{"left":' || left_id || ',"right":' || right_id || '}}') pair_id FROM p""",
    "accepted_reviews": "WITH r AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) decision FROM orders GROUP BY 1) SELECT o_custkey, c_mktsegment, decision FROM r JOIN customer ON o_custkey = c_custkey WHERE decision = 'F'",
    "basis_spans": "SELECT item_id, item_id % 3 < 2 AND item_id % 4 <> 0 AS valid FROM benchmark",
    "term_occurrences": rf"""WITH {Q.BLOCKS}, m AS (SELECT doc_id, pos, text, regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])(MIT[-\s]+license)(?:[^A-Za-z0-9]|$)', 1) literal FROM blocks WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])MIT[-\s]+license([^A-Za-z0-9]|$)'))
SELECT doc_id, pos, strpos(text, literal)::INT - 1 AS start, (strpos(text, literal) - 1 + length(literal))::INT AS "end", literal FROM m""",
    "term_windows": f"WITH {_WIN} SELECT doc_id, segment, term, state FROM found",
    "term_support_score": f"WITH {_WIN} SELECT * FROM scored",
    "term_candidates": f"WITH {_WIN} SELECT term, state, score FROM scored ORDER BY CASE state WHEN 'candidate' THEN 1 ELSE 2 END, scored.score DESC, term LIMIT 10",
    "corpus_record_merge": """WITH x AS (SELECT o_custkey, unnest([o_orderstatus, substring(o_orderpriority, 1, 1)]) o FROM orders), a AS (SELECT o_custkey, string_agg(DISTINCT o, ',' ORDER BY o) orgs FROM x GROUP BY 1),
b AS (SELECT o_custkey, string_agg(DISTINCT (o_orderkey % 10)::VARCHAR, ',' ORDER BY (o_orderkey % 10)::VARCHAR) associations, bool_or(o_totalprice > 400000) flag, CASE WHEN o_custkey % 3 = 0 THEN 'm' WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END meeting FROM orders GROUP BY 1)
SELECT o_custkey, orgs, associations, flag, meeting FROM a JOIN b USING (o_custkey)""",
    "unit_accounting": "SELECT c_custkey k, count(*) FILTER (o_orderstatus = 'F') units, count(*) FILTER (o_orderstatus = 'O') candidates FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "event_timeline": "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_type) events FROM events GROUP BY user_id",
    "gaps_distinct": """SELECT DISTINCT '{"reason":"' || o_orderpriority || '","source":"' || o_orderstatus || '"}' gap FROM orders""",
    "output_caps": "SELECT event_type, event_id, n, total FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT n, count(*) OVER (PARTITION BY event_type) total FROM events) WHERE n <= 25",
    "outcome_passages": f"""WITH {_B}, l AS (SELECT *, type <> 'heading' AND regexp_matches(text, '(?i)^(Agreements?|Decision|Conclusion|FFS)(\\s|:|$)') label, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) heading FROM b),
w AS (SELECT *, coalesce(lead(type <> 'heading' AND NOT label, 1) OVER p, false) a, coalesce(lead(type <> 'heading' AND NOT label, 2) OVER p, false) a2, lead(text, 1) OVER p x, lead(text, 2) OVER p y FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, a::INT + (a AND a2)::INT n_following FROM w WHERE label AND ((a AND x = 'plain words') OR (a AND a2 AND y = 'plain words'))""",
    "organization_groups": "WITH e AS (SELECT doc_id, '(unknown)' org FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, unnest([source, lang]) FROM documents WHERE doc_id % 10 <> 0) SELECT org, count(*) n, min(doc_id) AS \"first\" FROM e GROUP BY org",
    "topic_coverage": "SELECT * FROM (SELECT count(*) documents, count(*) FILTER (o_orderstatus = 'F') indexed, count(*) FILTER (o_orderstatus = 'O') extracted FROM orders), (SELECT count(*) blocks, count(*) FILTER (l_returnflag = 'R') statements, count(DISTINCT l_orderkey) with_blocks FROM lineitem)",
}


def _bundle_sql() -> str:
    from docketry.plans.search_queries import _bm25

    return f"""WITH {_bm25(['license', 'apache'])}, best AS (SELECT * FROM hits ORDER BY score DESC, doc_id, pos LIMIT 1000), r AS (SELECT doc_id, count(*) n_hits, round_even(sum(score), 6) sc FROM best GROUP BY doc_id ORDER BY sc DESC, doc_id LIMIT 50)
SELECT doc_id, n_hits, quality, quality IS NULL unresolved FROM r LEFT JOIN labels USING (doc_id)"""


SQL["topic_bundle"] = _bundle_sql()
SQL["topic_evidence"] = f"""WITH {_EXTRACT}, w AS (SELECT kind, doc_id, statement, row_number() OVER (PARTITION BY kind ORDER BY doc_id, statement)::INT AS rank, count(*) OVER (PARTITION BY kind) > 10 AS truncated
  FROM ev WHERE statement IS NOT NULL AND regexp_matches(lower(statement), '(^|[^a-z0-9])(proposal|license)([^a-z0-9]|$)')) SELECT * FROM w WHERE rank <= 10"""

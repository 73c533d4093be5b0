"""Metadata, snapshot, inventory and plan queries; orders, events, parts and
customers play the metadata, the list snapshots, the titles and the names."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import inventory as I
from docketry.operators import metadata as M
from docketry.plans.search_queries import table


def _snapshots(spark, d):
    """Events as list rows: a user is a document, the type a status, ts the order."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("title"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("u"), F.col("event_id"))).alias("url"),
        (F.col("event_id") % 4).alias("layer"), F.col("event_id").alias("apply_order"), (F.col("event_id") % 5 == 0).alias("listed"),
        F.create_map(F.col("event_type"), F.col("event_id").cast("string")).alias("raw"),
    )


def provenance_merge(spark, d):
    m = M.merge_by_provenance(_snapshots(spark, d), ["id"], ["status", "title"], ["url"], ["listed"])
    return m.select("id", "status", "title", "url", "listed")


def raw_map_merge(spark, d):
    m = M.merge_by_provenance(_snapshots(spark, d), ["id"], ["status"], maps=["raw"])
    return m.select("id", F.explode("raw").alias("status", "last"))


def current_view_merge(spark, d):
    o = table(spark, d, "orders")
    directory = o.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.lit("").alias("status"), F.col("o_orderpriority").alias("title"))
    current = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("title"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("title"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("apply_order"))
    li = li.groupBy("id", "apply_order").agg(F.max("status").alias("status"), F.max("title").alias("title"))
    return M.current_view(directory, current, li, "id", ["status", "title"])


def _old_new(spark, d):
    e = table(spark, d, "events")
    side = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(
        F.max(F.when(F.col("event_id") % 3 == k, F.col("event_type"))).alias("kind"), F.min("ts").alias("discovered"), F.max(F.when(F.col("value") > 40, F.col("value"))).alias("size"), F.lit("same").alias("checksum")
    )
    return side(0).filter("user_id % 7 <> 0"), side(1).filter("user_id % 5 <> 0")


def null_preserving_upsert(spark, d):
    old, new = _old_new(spark, d)
    out = M.upsert_keep(old.drop("checksum"), new.drop("checksum"), ["user_id"])
    return out.select("user_id", "kind", "size", F.date_format("discovered", "yyyy-MM-dd HH:mm:ss").alias("discovered"))


def least_coalesce_upsert(spark, d):
    old, new = _old_new(spark, d)
    out = M.upsert_artifacts(old, new, ["user_id"], ["kind"], "discovered", "checksum")
    return out.select("user_id", "kind", "size", "checksum", F.date_format("discovered", "yyyy-MM-dd HH:mm:ss").alias("discovered"))


def receipt_upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("v"))
    return M.upsert_last(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "v").drop("v")


def snapshot_replace(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    new = li.filter("l_suppkey % 3 = 0 AND l_quantity > 25").withColumn("l_quantity", F.col("l_quantity") + 1000)
    return M.replace_partition(li, new, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


def metadata_query(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    meta = o.select("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("working_group"), F.array("c_name").alias("organizations"), (F.col("o_orderkey") % 10 != 0).alias("current_view_present"))
    wanted = M.query_rows(meta, title="not spec", status="_", groups=["BUILDING", "MACHINERY"])
    return wanted.filter(M.has_any(F.col("organizations"), [f"customer#{i:09d}" for i in range(0, 400)])).select("o_orderkey", "title", "working_group")


def organization_filters(spark, d):
    """All-of and any-of over the names that a part's suppliers come from."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = li.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    g = s.groupBy("l_partkey").agg(F.collect_set("n_name").alias("orgs"))
    names = [r[0] for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").limit(2).collect()]
    wanted = [n.lower() for n in names]
    return g.select("l_partkey", M.has_all(F.col("orgs"), wanted).alias("all_of"), M.has_any(F.col("orgs"), wanted).alias("any_of"))


def precedence_resolution(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, d, "orders")
    cand = o.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("tier"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.col("o_orderpriority").alias("signature"), F.col("o_orderkey").alias("url"), F.col("o_totalprice").alias("value"))
    cand = cand.withColumn("signature", F.concat("signature", (F.col("url") % 2).cast("string")))
    return M.resolve_precedence(c, cand, "id")


def exactly_one_join(spark, d):
    refs = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 2).alias("meeting"))
    meta = table(spark, d, "orders").filter("o_orderkey % 8 = 0").select(F.col("o_custkey").alias("k"), (F.col("o_custkey") % 3).alias("meeting"))
    return M.exactly_one(refs, meta, "k", "meeting").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def snapshot_candidates(spark, d):
    """List rows with their snapshot's header, in order of time."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = M.snapshot_rows(li, o, F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_partkey").cast("string"), "77", ["o_orderdate", "l_orderkey", "l_linenumber"])
    return j.select("l_orderkey", "l_linenumber", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def snapshot_listing(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("source_url"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("snapshot_timestamp"))
    return M.list_snapshots(e).select("source_url", F.date_format("snapshot_timestamp", "yyyy-MM-dd HH:mm").alias("stamp"))


def snapshot_preference(spark, d):
    e = table(spark, d, "events")
    role = F.element_at(F.array(*map(F.lit, ["current", "close", "historical", "unknown", "unknown"])), ((F.col("event_id") * 7 + F.col("user_id")) % 5 + 1).cast("int"))
    s = e.select("user_id", F.col("event_id").alias("source_url"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("snapshot_timestamp"), role.alias("role"))
    return M.snapshot_for_role(s, "user_id")


def union_known(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return M.known_keys(n, table(spark, d, "supplier").select(F.col("s_nationkey").cast("long")), table(spark, d, "customer").select(F.col("c_custkey").cast("long")))


def range_expand(spark, d):
    known = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.element_at(F.array(F.lit("bis"), F.lit("-e"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("meeting"))
    return M.expand_range(spark, 120, 131, known)


def set_difference(spark, d):
    return M.difference(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey")))


def latest_review(spark, d):
    return _reviews(spark, d).select("o_custkey", "decision", "n_reviews")


def review_chain_valid(spark, d):
    return _reviews(spark, d).select("o_custkey", "valid")


def _reviews(spark, d):
    o = table(spark, d, "orders")
    w = F.row_number().over(M.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    prev = F.lag("o_orderkey").over(M.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    r = o.select("o_custkey", F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("decision"), w.alias("sequence"), prev.alias("supersedes"))
    r = r.withColumn("supersedes", F.when((F.col("o_custkey") % 9 == 0) & (F.col("sequence") == 3), F.lit(-1)).otherwise(F.col("supersedes")))
    return M.review_history(r, "o_custkey")


# --- inventory -------------------------------------------------------------------


def _titles(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("title"), F.lower("p_type").alias("abstract"), F.lower("p_brand").alias("document_type"))


def title_match_levels(spark, d):
    return I.topic_match(_titles(spark, d), "small red ring", ["title", "abstract", "document_type"]).select("p_partkey", "level", "covered", "weight")


def best_topic_argmax(spark, d):
    topics = ["small red ring", "red widget", "blue economy bolt"]
    out = None
    for i, topic in enumerate(topics):
        m = I.topic_match(_titles(spark, d), topic, ["title", "abstract", "document_type"])
        m = m.select("p_partkey", "level", "weight", F.lit(i).alias("topic_index"), (F.col("covered") / len(topic.split())).alias("ratio"))
        out = m if out is None else out.unionByName(m)
    return I.best_topic(out, "p_partkey")


def facets_org(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return I.facet(o, F.array("c_mktsegment", F.col("o_orderstatus")), "o_orderkey").select("value", "n", "first")


def facets_meeting(spark, d):
    o = table(spark, d, "orders")
    return I.facet(o, F.array(F.date_format("o_orderdate", "yyyy-MM")), "o_orderkey").select("value", "n", "first")


def facets_unknown(spark, d):
    c = table(spark, d, "customer")
    orgs = F.when(F.col("c_custkey") % 6 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 6 == 1, None).otherwise(F.array("c_mktsegment"))
    return I.facet(c, orgs, "c_custkey").select("value", "n", "first")


def conditional_counts(spark, d):
    o = table(spark, d, "orders")
    return I.conditional_counts(o, closed=F.col("o_orderstatus") == "F", open_=F.col("o_orderstatus") == "O", large=F.col("o_totalprice") > 200000)


def per_group_topk(spark, d):
    o = table(spark, d, "orders")
    return I.top_per_group(o, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank", "truncated")


def batching(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    b = I.batches(o, ["o_orderdate", "o_orderkey"], 20, ["o_orderpriority"])
    return b.groupBy("o_orderpriority", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


def fetch_plan(spark, d):
    m = I.topic_match(_titles(spark, d), "small red ring", ["title", "abstract", "document_type"])
    m = m.withColumn("availability", F.when(F.col("p_partkey") % 3 == 0, "downloadable").otherwise("listed_only")).withColumn("organizations", F.array("document_type"))
    return I.fetch_plan(m, "LOW", [], 100000).select("p_partkey", "level")


def preflight(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 3 == 0).alias("cached"), F.element_at(F.array(F.lit("downloadable"), F.lit("listed_only"), F.lit("unknown")), (F.col("user_id") % 3 + 1).cast("int")).alias("availability"))
    return I.preflight(e)


def plan_states(spark, d):
    e = table(spark, d, "events")
    s = e.select("user_id", F.element_at(F.array(*map(F.lit, ["parsed", "parsed", "unsupported", "text_unavailable"])), ((F.col("event_id") * (F.col("user_id") % 4)) % 4 + 1).cast("int")).alias("status"))
    return I.overall_status(s, "user_id")


def company_inventory(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return I.grouped_ids(o, "c_name", "o_orderkey").select("c_name", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def offset_page(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


QUERIES = {f.__name__: f for f in (
    provenance_merge, raw_map_merge, current_view_merge, null_preserving_upsert, least_coalesce_upsert, receipt_upsert, snapshot_replace, metadata_query, organization_filters, precedence_resolution, exactly_one_join,
    snapshot_candidates, snapshot_listing, snapshot_preference, union_known, range_expand, set_difference, latest_review, review_chain_valid, title_match_levels, best_topic_argmax,
    facets_org, facets_meeting, facets_unknown, conditional_counts, per_group_topk, batching, fetch_plan, preflight, plan_states, company_inventory, offset_page,
)}

_SNAP = "s AS (SELECT user_id id, event_type status, CASE WHEN event_id % 3 = 0 THEN props END title, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'u' || event_id END url, event_id % 4 layer, event_id apply_order, event_id % 5 = 0 listed FROM events)"
_OLD_NEW = ", ".join(
    f"{n} AS (SELECT user_id, max(CASE WHEN event_id % 3 = {k} THEN event_type END) kind, min(ts) discovered, max(CASE WHEN value > 40 THEN value END) size FROM events WHERE event_id % 2 = {k} AND user_id % {m} <> 0 GROUP BY user_id)"
    for n, k, m in (("o", 0, 7), ("n", 1, 5))
)
_REV = "r AS (SELECT o_custkey, o_orderkey review_id, o_orderstatus decision, row_number() OVER w sequence, CASE WHEN o_custkey % 9 = 0 AND row_number() OVER w = 3 THEN -1 ELSE lag(o_orderkey) OVER w END supersedes, lag(o_orderkey) OVER w prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"


def _match_sql(topic: str) -> str:
    want = "[" + ", ".join(f"'{t}'" for t in topic.split()) + "]"
    n = len(topic.split())
    return f"""SELECT p_partkey, CASE WHEN len(a) = 0 THEN NULL WHEN len(t) = {n} OR len(b) = {n} THEN 'HIGH' WHEN len(z) = {n} AND (len(t) > 0)::INT + (len(b) > 0)::INT + (len(k) > 0)::INT >= 2 THEN 'MEDIUM'
  WHEN len(a) >= 2 AND len(a) * 2 >= {n} THEN 'LOW' END AS level, len(z)::INT covered, CASE WHEN len(t) > 0 OR len(b) > 0 THEN 3 WHEN len(k) > 0 THEN 1 ELSE 0 END weight, len(z) / {n}.0::DOUBLE AS ratio
FROM (SELECT p_partkey, t, b, k, list_distinct(t || b) a, list_distinct(t || b || k) z FROM (SELECT p_partkey, list_intersect({want}, regexp_extract_all(lower(p_name), '[a-z0-9]+')) t, list_intersect({want}, regexp_extract_all(lower(p_type), '[a-z0-9]+')) b, list_intersect({want}, regexp_extract_all(lower(p_brand), '[a-z0-9]+')) k FROM part))"""


_FACET = "SELECT value, count(*) n, min(pos) first FROM f GROUP BY value"
SQL = {
    "provenance_merge": f"WITH {_SNAP} SELECT id, arg_max(status, (layer, apply_order)) status, arg_max(title, (layer, apply_order)) FILTER (title IS NOT NULL) title, arg_min(url, (layer, apply_order)) FILTER (url <> '') url, bool_or(listed) listed FROM s GROUP BY id",
    "raw_map_merge": """WITH s AS (SELECT user_id id, event_type status, event_id % 4 layer, event_id FROM events) SELECT id, status, arg_max(event_id, (layer, event_id))::VARCHAR AS "last" FROM s GROUP BY ALL""",
    "current_view_merge": """WITH dir AS (SELECT o_orderkey id, o_orderpriority title FROM orders WHERE o_orderkey % 4 = 0), cur AS (SELECT o_orderkey id, o_orderstatus status FROM orders WHERE o_orderkey % 3 = 0),
k AS (SELECT id FROM dir UNION SELECT id FROM cur), li AS (SELECT l_orderkey id, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 o, max(l_linestatus) status, max(l_returnflag) title FROM lineitem GROUP BY ALL),
b AS (SELECT id, arg_max(status, o) status, arg_max(title, o) title FROM li GROUP BY id)
SELECT k.id, coalesce(cur.status, b.status) status, coalesce(b.title, dir.title) title FROM k LEFT JOIN cur USING (id) LEFT JOIN b USING (id) LEFT JOIN dir USING (id)""",
    "null_preserving_upsert": f"WITH {_OLD_NEW} SELECT coalesce(n.user_id, o.user_id) user_id, coalesce(n.kind, o.kind) kind, coalesce(n.size, o.size) AS size, strftime(coalesce(n.discovered, o.discovered), '%Y-%m-%d %H:%M:%S') discovered FROM o FULL JOIN n ON o.user_id = n.user_id",
    "least_coalesce_upsert": f"WITH {_OLD_NEW} SELECT coalesce(n.user_id, o.user_id) user_id, CASE WHEN n.user_id IS NOT NULL THEN n.kind ELSE o.kind END kind, coalesce(n.size, o.size) AS size, 'same' checksum, strftime(least(n.discovered, o.discovered), '%Y-%m-%d %H:%M:%S') discovered FROM o FULL JOIN n ON o.user_id = n.user_id",
    "receipt_upsert": "SELECT o_custkey, max(o_orderkey) o_orderkey, arg_max(o_orderstatus, o_orderkey) o_orderstatus FROM orders GROUP BY o_custkey",
    "snapshot_replace": """WITH n AS (SELECT l_suppkey, l_quantity + 1000 AS q FROM lineitem WHERE l_suppkey % 3 = 0 AND l_quantity > 25), a AS (SELECT l_suppkey, l_quantity q FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM n) UNION ALL SELECT * FROM n)
SELECT l_suppkey, count(*) n, sum(q) q FROM a GROUP BY l_suppkey""",
    "metadata_query": "SELECT o_orderkey, o_orderpriority title, c_mktsegment working_group FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority ILIKE '%not spec%' AND o_orderstatus ILIKE '_' AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderkey % 10 <> 0 AND c_custkey < 400",
    "organization_filters": """WITH w AS (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 2), g AS (SELECT DISTINCT l_partkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT l_partkey, count(DISTINCT w.n_name) = 2 AS all_of, count(w.n_name) > 0 AS any_of FROM g LEFT JOIN w USING (n_name) GROUP BY l_partkey""",
    "precedence_resolution": """WITH c AS (SELECT o_custkey id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END tier, substring(o_orderpriority, 1, 1)::INT rank, o_orderpriority || (o_orderkey % 2) signature, o_orderkey url, o_totalprice v FROM orders),
b AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY tier, rank) dr FROM c), g AS (SELECT id, count(DISTINCT signature) n, arg_min(v, url) v, min(tier) tier FROM b WHERE dr = 1 GROUP BY id)
SELECT c_custkey id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END state, CASE WHEN n = 1 THEN v END AS value, tier FROM customer LEFT JOIN g ON c_custkey = id""",
    "exactly_one_join": """WITH m AS (SELECT o_custkey k, count(*) n FROM orders WHERE o_orderkey % 8 = 0 GROUP BY 1)
SELECT CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' WHEN c_custkey % 2 = c_custkey % 3 THEN 'resolved_here' ELSE 'resolved_elsewhere' END state, count(*) n FROM customer LEFT JOIN m ON c_custkey = k GROUP BY 1""",
    "snapshot_candidates": "SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 77",
    "snapshot_listing": "SELECT event_id source_url, strftime(CASE WHEN event_id % 3 <> 0 THEN ts END, '%Y-%m-%d %H:%M') stamp FROM events ORDER BY CASE WHEN event_id % 3 <> 0 THEN ts END NULLS LAST, event_id",
    "snapshot_preference": """WITH s AS (SELECT user_id, event_id u, CASE WHEN event_id % 4 <> 0 THEN ts END t, ['current','close','historical','unknown','unknown'][(event_id * 7 + user_id) % 5 + 1] r FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE r WHEN 'current' THEN 0 WHEN 'close' THEN 1 WHEN 'historical' THEN 2 ELSE 3 END, CASE WHEN r = 'unknown' THEN NULL ELSE t END DESC NULLS LAST, u DESC) k, max(u) OVER (PARTITION BY user_id) m FROM s)
SELECT user_id, CASE WHEN r = 'unknown' THEN m ELSE u END source_url FROM x WHERE k = 1""",
    "union_known": "SELECT n_nationkey::BIGINT k FROM nation UNION SELECT s_nationkey FROM supplier UNION SELECT c_custkey FROM customer",
    "range_expand": """SELECT DISTINCT meeting FROM (SELECT unnest(generate_series(120, 131))::VARCHAR meeting UNION ALL SELECT p_partkey || ['bis', '-e', ''][p_partkey % 3 + 1] FROM part WHERE p_partkey BETWEEN 120 AND 131 AND (p_partkey < 131 OR p_partkey % 3 = 2))""",
    "set_difference": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "latest_review": f"WITH {_REV} SELECT o_custkey, arg_max(decision, sequence) decision, max(sequence)::INT n_reviews FROM r GROUP BY o_custkey",
    "review_chain_valid": f"WITH {_REV} SELECT o_custkey, bool_and(supersedes IS NOT DISTINCT FROM prev) valid FROM r GROUP BY o_custkey",
    "title_match_levels": f"SELECT p_partkey, level, covered, weight FROM ({_match_sql('small red ring')})",
    "best_topic_argmax": "WITH m AS (" + " UNION ALL ".join(f"SELECT *, {i} ti FROM ({_match_sql(t)})" for i, t in enumerate(["small red ring", "red widget", "blue economy bolt"])) + "), r AS (SELECT *, (CASE level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END, ratio, weight, -ti) o FROM m WHERE level IS NOT NULL) SELECT p_partkey, arg_max(ti, o)::INT topic_index, arg_max(level, o) AS level FROM r GROUP BY p_partkey",
    "facets_org": f"WITH f AS (SELECT unnest([c_mktsegment, o_orderstatus]) AS value, o_orderkey pos FROM orders JOIN customer ON o_custkey = c_custkey) {_FACET}",
    "facets_meeting": f"WITH f AS (SELECT strftime(o_orderdate, '%Y-%m') AS value, o_orderkey pos FROM orders) {_FACET}",
    "facets_unknown": f"WITH f AS (SELECT CASE WHEN c_custkey % 6 < 2 THEN '(unknown)' ELSE c_mktsegment END AS value, c_custkey pos FROM customer) {_FACET}",
    "conditional_counts": "SELECT count(*) FILTER (o_orderstatus = 'F') closed, count(*) FILTER (o_orderstatus = 'O') open_, count(*) FILTER (o_totalprice > 200000) large, count(*) n FROM orders",
    "per_group_topk": "SELECT o_custkey, o_orderkey, rank, truncated FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, count(*) OVER (PARTITION BY o_custkey) > 3 AS truncated FROM orders) WHERE rank <= 3",
    "batching": "WITH b AS (SELECT *, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1) // 20)::INT batch FROM orders WHERE o_orderstatus = 'O') SELECT o_orderpriority, batch, count(*) n, min(o_orderkey) least, max(o_orderkey) most FROM b GROUP BY ALL",
    "fetch_plan": f"SELECT p_partkey, level FROM ({_match_sql('small red ring')}) WHERE level IS NOT NULL AND p_partkey % 3 = 0",
    "preflight": "SELECT count(*) selected, count(*) FILTER (event_id % 3 = 0) cached, count(*) FILTER (user_id % 3 = 0 AND event_id % 3 <> 0) to_download, count(*) FILTER (user_id % 3 = 1) listed_only, count(*) FILTER (user_id % 3 = 2) unknown FROM events",
    "plan_states": """WITH s AS (SELECT user_id, ['parsed','parsed','unsupported','text_unavailable'][(event_id * (user_id % 4)) % 4 + 1] s FROM events)
SELECT user_id, CASE WHEN bool_and(s = 'parsed') THEN 'parsed' WHEN bool_or(s = 'parsed') THEN 'partial' WHEN bool_or(s = 'text_unavailable') THEN 'text_unavailable' WHEN bool_and(s = 'unsupported') THEN 'unsupported' ELSE 'failed' END AS status FROM s GROUP BY user_id""",
    "company_inventory": "SELECT c_name, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) ids FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name",
    "offset_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
}

"""Scalar functions and classification rules over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.functions import text as T
from docketry.plans import sql as Q
from docketry.plans.search_queries import blocks, table

# --- carriers: statements made from the rows of the tables -----------------------

STATEMENTS = [
    "Proposal 1: ", "Observation 2 ", "conclusion: ", "Agreements ", "Decision 7: ", "FFS: ", "For further study: ", "Proposals ", "",
    "we propose that ", "It was agreed that ", "the meeting decided to study ", "to be selected from ", "is selected for ", "It was endorsed; ", "left for later ",
]


def _statements(spark, d):
    """Every order with a statement opening and a clause of its own."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    head = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("o_orderkey") % len(STATEMENTS) + 1).cast("int"))
    return o.select("o_orderkey", F.concat(head, F.lower("o_orderpriority"), F.lit(" item "), F.col("o_orderstatus")).alias("text"))


_STATEMENTS_SQL = "st AS (SELECT o_orderkey, [" + ", ".join(f"'{s}'" for s in STATEMENTS) + f"][o_orderkey % {len(STATEMENTS)} + 1] || lower(o_orderpriority) || ' item ' || o_orderstatus AS text FROM orders)"


def label_extract(spark, d):
    lab = R.label_of(F.col("text"))
    return _statements(spark, d).select("o_orderkey", lab.alias("x")).select("o_orderkey", "x.kind", "x.label", "x.ordinal", "x.body")


def _label_case(field: str) -> str:
    p = lambda n: rf"(?i)^\s*({n})(?:(?:\s+(\d+))?\s*:?[ \t]*$|\s+(\d+)\s*:?[ \t]*|\s*:[ \t]*|\s+)(.*)$"
    pick = {
        "kind": lambda k, n: f"'{k}'",
        "label": lambda k, n: f"regexp_extract(text, '{p(n)}', 1)",
        "ordinal": lambda k, n: f"coalesce(try_cast(nullif(regexp_extract(text, '{p(n)}', 2), '') AS INT), try_cast(nullif(regexp_extract(text, '{p(n)}', 3), '') AS INT))",
        "body": lambda k, n: f"trim(regexp_extract(text, '{p(n)}', 4))",
    }[field]
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p(n)}') THEN {pick(k, n)}" for k, n in R.LABELS) + " END"


def inline_cues(spark, d):
    role = F.when(F.col("o_orderkey") % 2 == 0, R.CONTRIBUTION).otherwise(R.REPORT)
    s = _statements(spark, d).withColumn("x", R.inline_of(F.col("text"), role))
    return s.select("o_orderkey", "x.kind", F.lower("x.cue").alias("cue"), "x.ok")


def _inline_case(field: str) -> str:
    role = f"CASE WHEN o_orderkey % 2 = 0 THEN '{R.CONTRIBUTION}' ELSE '{R.REPORT}' END"
    value = {
        "kind": lambda r: f"'{r.kind}'",
        "cue": lambda r: f"lower(regexp_extract(text, '(?i){r.pattern}'))",
        "ok": lambda r: (f"({role}) IN (" + ", ".join(f"'{x}'" for x in r.roles) + ")") if r.roles else "false",
    }[field]
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){r.pattern}') THEN {value(r)}" for r in R.INLINE) + " END"


def disposition_case(spark, d):
    return _statements(spark, d).select("o_orderkey", R.disposition(F.col("text")).alias("disposition"))


_DISPOSITION_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(text, '(?i){p}')" + (f" AND NOT regexp_matches(text, '(?i){R.PENDING_SELECT}')" if k == "select" else "") + f" THEN '{k}'" for k, p in R.DISPOSITIONS
) + " ELSE 'unclassified' END"


def heading_kinds(spark, d):
    names = list(R.HEADINGS)
    text = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.initcap(F.element_at(F.array(*map(F.lit, [*names, "scope"])), (F.col("conv_id") % (len(names) + 1) + 1).cast("int"))), F.lit(":"))
    role = F.when(F.col("conv_id") % 3 == 0, R.REPORT).when(F.col("conv_id") % 3 == 1, R.CONTRIBUTION).otherwise("unknown")
    c = table(spark, d, "conversations").select("conv_id", "turn", R.heading_kind(text).alias("kind"), role.alias("role"))
    return c.withColumn("allowed", F.coalesce(R.allowed(F.col("role"), F.col("kind")), F.lit(False)))


_ALLOWED_SQL = " ".join(f"WHEN role = '{r}' THEN kind IN ({', '.join(repr(k) for k in ks)})" for r, ks in R.AUTHORITY.items())


def document_roles(spark, d):
    """Orders as metadata: priority as type, status as category, clerk as source."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "report").when(F.col("o_orderkey") % 5 == 1, "agenda").when(F.col("o_orderkey") % 5 == 2, "").otherwise(F.col("o_orderpriority"))
    title = F.when(F.col("o_orderkey") % 7 == 0, "Report of the meeting").when(F.col("o_orderkey") % 7 == 1, "Chair's notes").otherwise("On the matter")
    orgs = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("ETSI MCC"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.concat(F.lit("Co "), F.col("o_custkey")))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", R.document_role(title, kind, F.lit(""), orgs).alias("role"))


def availability_case(spark, d):
    e = table(spark, d, "events")
    url = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("https://x/"), F.col("event_id")))
    return e.select("event_id", R.availability(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, url).alias("availability"))


NAMES = ["'tdocList_' || y || '_14h28.xlsx'", "'TDoc_List_Meeting_' || k || '.xlsx'", "'list_' || y || '_10h00_eom.xlsx'", "'notes_' || y || '_final.docx'", "'x_' || k || '.xlsx'", "'n_' || y || '.xlsx'", "'a_rev2_eom1.doc'", "'r_9999' || k || '.x'"]
_NAMES_SPARK = "element_at(array(" + ", ".join(NAMES) + "), cast(k % 8 + 1 as int))"


def _names(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("y"))
    return o.select("k", F.expr(_NAMES_SPARK).alias("name"))


_NAMES_SQL = "n AS (SELECT k, [" + ", ".join(NAMES) + "][k % 8 + 1] AS name FROM (SELECT o_orderkey k, strftime(o_orderdate, '%Y-%m-%d') y FROM orders))"


def snapshot_role(spark, d):
    return _names(spark, d).select("k", R.snapshot_role(F.col("name")).alias("role"), R.chair_label(F.col("name")).alias("label"))


def filename_timestamp(spark, d):
    return _names(spark, d).select("k", F.date_format(R.filename_timestamp(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


_STAMP_SQL = rf"try_cast(CASE WHEN regexp_matches(name, '{R.STAMP}') THEN regexp_extract(name, '{R.STAMP}', 1) || '-' || regexp_extract(name, '{R.STAMP}', 2) || '-' || regexp_extract(name, '{R.STAMP}', 3) || ' ' || coalesce(nullif(regexp_extract(name, '{R.STAMP}', 4), ''), '00') || ':' || coalesce(nullif(regexp_extract(name, '{R.STAMP}', 5), ''), '00') || ':00' END AS TIMESTAMP)"

MEETINGS = ["0124", "124b", "124bis", "RAN1#124b", "TSGR1_119-e", "120", "x12", "131bis"]


def _meetings(spark, d):
    m = F.element_at(F.array(*map(F.lit, MEETINGS)), (F.col("p_partkey") % len(MEETINGS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", m.alias("raw"))


_MEETINGS_SQL = "m AS (SELECT p_partkey, [" + ", ".join(f"'{x}'" for x in MEETINGS) + f"][p_partkey % {len(MEETINGS)} + 1] raw FROM part), b AS (SELECT *, regexp_replace(lower(trim(raw)), '^(ran[12]\\s*#|tsgr[12]_)\\s*', '') body FROM m), z AS (SELECT *, CASE WHEN regexp_matches(body, '^0*(\\d+)(bis|b|-e)?$') THEN regexp_extract(body, '^0*(\\d+)', 1) || CASE regexp_extract(body, '^\\d+(.*)$', 1) WHEN 'b' THEN 'bis' ELSE regexp_extract(body, '^\\d+(.*)$', 1) END END meeting FROM b)"


def chronology_sort(spark, d):
    z = _meetings(spark, d).withColumn("meeting", R.normalize_meeting(F.col("raw")))
    k = R.meeting_key(F.col("meeting"))
    return z.groupBy("raw", "meeting").agg(F.count(F.lit(1)).alias("n")).select("raw", "meeting", "n", F.coalesce(k["number"], F.lit(2147483647)).alias("number"), F.when(F.col("meeting").isNull(), 9).otherwise(k["rank"]).alias("rank"))


def json_props(spark, d):
    e = table(spark, d, "events")
    p = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(p)), ",").alias("keys"), F.size(p).alias("n"))


def map_union(spark, d):
    """Raw maps merged, the incoming side winning."""
    o = table(spark, d, "orders")
    old = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("clerk"), F.lit("old"))
    new = F.create_map(F.lit("clerk"), F.col("o_custkey").cast("string"), F.lit("prio"), F.col("o_orderpriority"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    m = F.map_concat(kept, new)
    return o.select("o_orderkey", m["status"].alias("status"), m["clerk"].alias("clerk"), m["prio"].alias("prio"))


def canonical_digest(spark, d):
    s = table(spark, d, "supplier")
    j = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("note")), {"ignoreNullFields": "false"})
    return s.select("s_suppkey", F.substring(F.sha2(j, 256), 1, 24).alias("id"))


ORGS = "'Acme Co., Ltd., ' || c_name || '; acme co., ltd.' || chr(10) || ' Beta  / Gamma, Inc, beta / gamma,inc ; '"


def org_split(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr(ORGS.replace("chr(10)", "'\n'")).alias("raw"))
    return c.select("c_custkey", F.array_join(T.split_organizations(F.col("raw")), "|").alias("names"))


def first_seen_dedupe(spark, d):
    """Words of each benchmark text, distinct by lower case, first spelling kept."""
    b = table(spark, d, "benchmark")
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda x: x != "")
    return b.select("item_id", F.array_join(T.first_seen(words), " ").alias("words"))


def term_variants(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("-", F.slice(F.split("p_name", " "), 1, 2)).alias("a"), F.concat_ws("  ", F.slice(F.split(F.initcap("p_name"), " "), 1, 2)).alias("b"))
    return p.select("p_partkey", F.array_join(T.exact_variants(F.col("a")), "|").alias("hyphen"), F.array_join(T.exact_variants(F.col("b")), "|").alias("spaced"))


def normalized_terms(spark, d):
    p = table(spark, d, "part")
    t = F.concat(F.initcap("p_name"), F.lit(" - Of THE / "), F.col("p_type"))
    return p.select("p_partkey", T.normalized_term(t).alias("term"), F.array_join(T.meaningful_tokens(t), " ").alias("tokens"))


def joined_suffix(spark, d):
    """A name's head that is glued to a title is cut off."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.element_at(F.array(F.lit("Amazon"), F.lit("Acme"), F.lit(" Acme"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("t"))
    return p.select("p_partkey", T.strip_joined_suffix(F.col("t"), ["Amazon Web Services", "Amazon", "Acme"]).alias("title"))


REFS = "'See R1-' || (100000 + o_orderkey) || ' and R2-' || (1000000 + o_orderkey) || ', revision of R1-' || (200000 + o_orderkey) || CASE WHEN o_orderkey % 3 = 0 THEN '; reply to R2-123456.' ELSE ' xR1-999999' END"


def reference_spans(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(REFS).alias("text"))
    s = o.select("o_orderkey", "text", F.explode(T.spans(F.col("text"), R.REFERENCE_LINK)).alias("s"))
    return s.select("o_orderkey", "s.start", "s.end", "s.literal")


def relation_cue(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(REFS).alias("text"))
    s = o.select("o_orderkey", "text", F.explode(T.spans(F.col("text"), R.REFERENCE_LINK)).alias("s"))
    return s.select("o_orderkey", "s.start", R.relation_near(F.col("text"), F.col("s.start"), F.col("s.end"), 14, 4).alias("relation"))


_SPANS_SQL = r"""r AS (SELECT o_orderkey, """ + REFS + r""" AS text FROM orders),
f AS (SELECT o_orderkey, text, regexp_extract_all(text, '\bR[12]-\d{6,8}\b') m FROM r),
u AS (SELECT o_orderkey, text, unnest(m) literal, generate_subscripts(m, 1) i, m FROM f),
s AS (SELECT *, strpos(text, literal) - 1 AS start FROM u)"""


def segment_sentences(spark, d):
    """Every segment of every whole text."""
    one = table(spark, d, "documents").select("doc_id", F.posexplode(T.segments(F.col("text"))).alias("segment", "s"))
    return one.select("doc_id", "segment", "s.start", "s.end", "s.reason", "s.parent", F.md5("s.literal").alias("literal"))


def segment_lists(spark, d):
    """Lists of options, numbers and bullets under a head, made from orders."""
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_LISTS).alias("text"))
    one = o.select("o_orderkey", F.posexplode(T.segments(F.col("text"))).alias("segment", "s"))
    return one.select("o_orderkey", "segment", "s.start", "s.end", "s.reason", "s.parent", "s.literal")


_LISTS = "CASE o_orderkey % 4 WHEN 0 THEN 'We see:\n\n- ' || lower(o_orderpriority) || '\n  * more. And on\n' WHEN 1 THEN '1) a ' || o_orderkey || ' \n2. b' WHEN 2 THEN ' Choose. One of:\nOption 1: x\nOption 2) y ' || o_orderstatus ELSE 'Only - one.\n- item. Two' END"


def _segments_sql(key: str, source: str, text: str, literal: str) -> str:
    mark = r"(?m)^\s*([-•*]|\d+[.)]|Option\s+\d+\s*[:.)])\s+"
    return rf"""WITH a AS (SELECT row_number() OVER () rid, {key}, coalesce({text}, '') t FROM {source}), n AS (SELECT *, len(regexp_extract_all(t, '{mark}')) >= 2 listed FROM a),
b AS (SELECT *, string_split(CASE WHEN listed THEN regexp_replace(t, '{mark}', chr(1) || '\0', 'g') ELSE regexp_replace(t, '([.!?])(\s+["''“‘(]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g') END, chr(1)) p FROM n),
u AS (SELECT rid, {key}, listed, unnest(p) x, generate_subscripts(p, 1) i FROM b),
c AS (SELECT *, sum(length(x)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) - length(x) AS off, CASE WHEN listed AND i > 1 THEN x ELSE regexp_replace(x, '^\s+', '') END body FROM u),
f AS (SELECT *, regexp_replace(body, '\s+$', '') lit FROM c WHERE regexp_replace(body, '\s+$', '') <> ''),
g AS (SELECT *, count(*) OVER (PARTITION BY rid) k, min(i) OVER (PARTITION BY rid) lo FROM f)
SELECT {key}, (row_number() OVER (PARTITION BY rid ORDER BY i) - 1)::INT segment, (off + length(x) - length(body))::INT AS start, (off + length(x) - length(body) + length(lit))::INT AS "end",
  CASE WHEN listed AND i = 1 THEN 'whole' WHEN listed THEN CASE WHEN starts_with(lower(regexp_extract(x, '{mark}', 1)), 'option') THEN 'option' WHEN regexp_matches(regexp_extract(x, '{mark}', 1), '^[0-9]') THEN 'number' ELSE 'list_item' END
    WHEN k >= 2 THEN 'sentence' ELSE 'whole' END reason, CASE WHEN listed AND i > 1 AND lo = 1 THEN 0 END::INT parent, {literal} AS literal FROM g"""


def surface_duplicates(spark, d):
    """Lines that repeat within a language by surface get one shared id."""
    b = blocks(spark, d).withColumn("surface", T.surface(F.col("text")))
    g = b.groupBy("lang", "surface").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).filter("n > 1")
    return g.select(F.substring(F.sha2(F.concat_ws("|", "lang", "surface"), 256), 1, 16).alias("group_id"), "n", "first.doc_id", "first.pos")


def phrase_candidates(spark, d):
    """Direct candidates: lines that hold a phrase literally, at word boundaries."""
    b = blocks(spark, d)
    return b.filter(F.col("text").rlike(T.phrase_pattern("apache license"))).select("doc_id", "pos")


def anchor_tokens(spark, d):
    """Query tokens that a line shares once references are cut from what follows."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("R1-2605236"), F.col("o_orderpriority"), F.lit(" aspects")).alias("t"))
    cut = F.regexp_replace("t", r"(R[12]-[0-9]{6,8})(?![0-9-])", "$1 ")
    want = F.array(*[F.lit(x) for x in ("urgent", "high", "aspects", "low")])
    return o.select("o_orderkey", F.array_join(F.array_sort(F.array_intersect(T.tokenize(cut), want)), " ").alias("anchors"))


QUERIES = {f.__name__: f for f in (
    label_extract, inline_cues, disposition_case, heading_kinds, document_roles, availability_case, snapshot_role, filename_timestamp, chronology_sort, json_props, map_union,
    canonical_digest, org_split, first_seen_dedupe, term_variants, normalized_terms, joined_suffix, reference_spans, relation_cue, segment_sentences, segment_lists, surface_duplicates, phrase_candidates, anchor_tokens,
)}

SQL = {
    "label_extract": f"WITH {_STATEMENTS_SQL} SELECT o_orderkey, {', '.join(_label_case(f) + ' ' + f for f in ('kind', 'label', 'ordinal', 'body'))} FROM st",
    "inline_cues": f"WITH {_STATEMENTS_SQL} SELECT o_orderkey, {', '.join(_inline_case(f) + ' ' + f for f in ('kind', 'cue', 'ok'))} FROM st",
    "disposition_case": f"WITH {_STATEMENTS_SQL} SELECT o_orderkey, {_DISPOSITION_SQL} disposition FROM st",
    "heading_kinds": f"""WITH c AS (SELECT conv_id, turn, MAP({list(R.HEADINGS)!r}, {list(R.HEADINGS.values())!r})[{[*R.HEADINGS, 'scope']!r}[conv_id % {len(R.HEADINGS) + 1} + 1]] AS kind,
  CASE conv_id % 3 WHEN 0 THEN '{R.REPORT}' WHEN 1 THEN '{R.CONTRIBUTION}' ELSE 'unknown' END AS role FROM conversations)
SELECT conv_id, turn, kind, role, coalesce(CASE {_ALLOWED_SQL} ELSE false END, false) allowed FROM c""",
    "document_roles": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'agenda' WHEN o_orderkey % 7 = 1 THEN 'chair_material'
  WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 = 0 AND o_orderkey % 3 <> 1 THEN '{R.REPORT}'
  WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 <> 2 THEN '{R.CONTRIBUTION}' ELSE 'unknown' END AS role FROM orders""",
    "availability_case": "SELECT event_id, CASE WHEN event_id % 2 = 0 AND user_id % 4 <> 0 THEN 'downloadable' WHEN event_id % 3 = 0 THEN 'listed_only' ELSE 'unknown' END availability FROM events",
    "snapshot_role": f"""WITH {_NAMES_SQL}, t AS (SELECT *, {_STAMP_SQL} ts, lower(name) l FROM n),
f AS (SELECT *, regexp_matches(l, '(^|[^a-z])final([^a-z]|$)')::INT a, regexp_matches(l, '(^|[^a-z])eom\\d*([^a-z0-9]|$)')::INT b, regexp_matches(l, '(^|[^a-z])rev(ision)?\\d*([^a-z0-9]|$)')::INT c FROM t)
SELECT k, CASE WHEN regexp_matches(l, '(^|[^a-z])(eom|final)([^a-z]|$)') THEN 'close' WHEN contains(l, 'tdoc_list_meeting') THEN 'current' WHEN ts IS NOT NULL THEN 'historical' ELSE 'unknown' END AS role,
  CASE WHEN a + b + c <> 1 THEN 'unknown' WHEN a = 1 THEN 'explicit_final' WHEN b = 1 THEN 'eom' ELSE 'intermediate' END AS label FROM f""",
    "filename_timestamp": f"WITH {_NAMES_SQL} SELECT k, strftime({_STAMP_SQL}, '%Y-%m-%d %H:%M:%S') stamp FROM n",
    "chronology_sort": f"WITH {_MEETINGS_SQL} SELECT raw, meeting, count(*) n, coalesce(try_cast(regexp_extract(meeting, '^(\\d+)', 1) AS INT), 2147483647) AS number, CASE WHEN meeting IS NULL THEN 9 ELSE CASE regexp_extract(meeting, '^\\d+(.*)$', 1) WHEN '' THEN 0 WHEN 'bis' THEN 1 WHEN '-e' THEN 2 ELSE 3 END END AS rank FROM z GROUP BY ALL",
    "json_props": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, len(json_keys(props))::INT n FROM events",
    "map_union": "SELECT o_orderkey, o_orderstatus status, o_custkey::VARCHAR clerk, o_orderpriority prio FROM orders",
    "canonical_digest": """SELECT s_suppkey, substring(sha256('{"name":"' || s_name || '","nation":' || s_nationkey || ',"note":null}'), 1, 24) AS id FROM supplier""",
    "org_split": "SELECT c_custkey, 'Acme Co., Ltd.|' || c_name || '|Beta / Gamma, Inc|beta / gamma,inc' AS names FROM customer",
    "first_seen_dedupe": r"""WITH w AS (SELECT item_id, unnest(l) x, generate_subscripts(l, 1) i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[^\pL]+'), lambda x: x <> '') l FROM benchmark)),
g AS (SELECT item_id, arg_min(x, i) x, min(i) i FROM w GROUP BY item_id, lower(x)) SELECT item_id, string_agg(x, ' ' ORDER BY i) AS words FROM g GROUP BY item_id""",
    "term_variants": """WITH p AS (SELECT p_partkey, string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[2] b FROM part),
q AS (SELECT p_partkey, a, b, upper(a[1]) || lower(a[2:]) x, upper(b[1]) || lower(b[2:]) y FROM p)
SELECT p_partkey, array_to_string(list_sort(list_distinct([a || '-' || b, lower(a || '-' || b), a || ' ' || b, lower(a || ' ' || b)])), '|') hyphen,
  array_to_string(list_sort(list_distinct([x || ' ' || y, lower(x || ' ' || y), x || '-' || y, lower(x || '-' || y)])), '|') spaced FROM q""",
    "normalized_terms": f"""WITH p AS (SELECT p_partkey, p_name || ' - Of THE / ' || p_type t FROM part), w AS (SELECT p_partkey, regexp_extract_all(lower(t), '[a-z0-9]+') l FROM p),
u AS (SELECT p_partkey, unnest(l) x, generate_subscripts(l, 1) i FROM w), g AS (SELECT p_partkey, x, min(i) i FROM u WHERE x NOT IN ({', '.join(repr(x) for x in T.TOPIC_STOP)}) GROUP BY ALL)
SELECT p_partkey, array_to_string(any_value(l), ' ') term, string_agg(x, ' ' ORDER BY i) tokens FROM g JOIN w USING (p_partkey) GROUP BY p_partkey""",
    "joined_suffix": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN p_name || ' Acme' ELSE p_name END AS title FROM part",
    "reference_spans": f'WITH {_SPANS_SQL} SELECT o_orderkey, start::INT AS start, (start + length(literal))::INT AS "end", literal FROM s',
    "relation_cue": f"""WITH {_SPANS_SQL}, w AS (SELECT *, substring(text, greatest(start - 14, 0) + 1, start + length(literal) + 4 - greatest(start - 14, 0)) AS win FROM s)
SELECT o_orderkey, start::INT AS start, CASE WHEN regexp_matches(win, '(?i)\\b(supersedes?|replaces?)\\b') THEN 'supersession' WHEN regexp_matches(win, '(?i)\\b(revision of|revised version of|updated version of)\\b') THEN 'revision'
  WHEN regexp_matches(win, '(?i)\\b(reply LS to|reply to|in reply to)\\b') THEN 'reply' ELSE 'reference' END relation FROM w""",
    "segment_sentences": _segments_sql("doc_id", "documents", "text", "md5(lit)"),
    "segment_lists": _segments_sql("o_orderkey", "orders", _LISTS.replace("\\n", "' || chr(10) || '"), "lit"),
    "surface_duplicates": f"""WITH {Q.BLOCKS}, s AS (SELECT doc_id, pos, lang, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) surface FROM blocks)
SELECT substring(sha256(lang || '|' || surface), 1, 16) group_id, count(*) n, arg_min(doc_id, (doc_id, pos)) doc_id, arg_min(pos, (doc_id, pos)) pos FROM s GROUP BY lang, surface HAVING count(*) > 1""",
    "phrase_candidates": rf"WITH {Q.BLOCKS} SELECT doc_id, pos FROM blocks WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])apache[-\s]+license([^A-Za-z0-9]|$)')",
    "anchor_tokens": "SELECT o_orderkey, trim('aspects ' || CASE WHEN contains(o_orderpriority, 'HIGH') THEN 'high' WHEN contains(o_orderpriority, 'LOW') THEN 'low' WHEN contains(o_orderpriority, 'URGENT') THEN 'urgent' ELSE '' END) anchors FROM orders",
}

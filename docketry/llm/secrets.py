"""Secret scan: Boolean trigram queries over an inverted index, then verification.

``trigram_query`` walks the parse tree of a rule's regular expression and derives
clauses (a disjunction of conjunctions) of trigrams that any match must contain.
``postings`` builds the inverted index of the trigrams that the rules ask for:
one entry for each (trigram, distinct text). ``candidates`` intersects postings
by clause. ``scan`` verifies the candidates with the regular expressions; a rule
without mandatory trigrams is verified on every text. All of it is DataFrame and
SQL functions.

Texts are identified in the index by a 64-bit hash of the text itself, so copies
have one entry, null or repeated ``doc_id`` values do no harm, and two texts of
one hash merely share candidates, which verification settles.

Defined cases: a null text counts as empty; offsets are code points, end
exclusive; repeated rows give repeated results; an empty table gives an empty
result; other input columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import counted, hot_keys, spread_join, staged, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` that satisfy ``least``.

    ``least``: (group, characters) that a match must have, or None.
    """

    kind: str
    pattern: str
    least: tuple[int, int] | None = None


#: The base kinds, in their order. ``[0-9a-f]{24,}`` and
#: ``AKIA[A-Z0-9]{16,}`` find the matches of the open patterns that are long
#: enough, as each of those takes a whole run of its class.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 6)),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of keys beyond the base kinds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A string set larger than this is no longer spelt out.
SPELT = 16
#: Candidate texts (a key and a few rule numbers each) that are broadcast.
SMALL = 1_000_000


# --- regular expression -> Boolean trigram query -----------------------------
#
# A node's facts: ``exact``, the finite set of strings it matches or None; and
# ``need``, clauses of substrings, one of which every match contains. The empty
# conjunction needs nothing.

Clauses = frozenset[frozenset[str]]
ANYTHING: Clauses = frozenset([frozenset()])


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _all_of(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > 4 * SPELT:
        return a if a != ANYTHING else b
    return frozenset(x | y for x, y in product(a, b))


def _spelt(exact: frozenset[str]) -> Clauses:
    return frozenset(_trigrams(s) for s in exact)


def _class(items) -> frozenset[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < SPELT:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= SPELT else None


def _facts(nodes) -> tuple[frozenset[str] | None, Clauses]:
    """Facts of a sequence: runs of finite parts are spelt out together."""
    need, run, finite = ANYTHING, frozenset([""]), True
    for op, arg in nodes:
        exact, own = _fact(op, arg)
        if exact is not None and len(run) * len(exact) <= SPELT:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        need, finite = _all_of(need, _spelt(run)), False
        run = exact if exact is not None else frozenset([""])
        if exact is None:
            need = _all_of(need, own)
    return (run, _spelt(run)) if finite else (None, _all_of(need, _spelt(run)))


def _fact(op, arg) -> tuple[frozenset[str] | None, Clauses]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), ANYTHING
    if op is sre.IN:
        return (_class(arg) if arg[0][0] is not sre.NEGATE else None), ANYTHING
    if op is sre.SUBPATTERN:
        return _facts(arg[3])
    if op is sre.BRANCH:
        each = [_facts(x) for x in arg[1]]
        exact = [x for x, _ in each]
        if all(x is not None for x in exact) and len(joined := frozenset().union(*exact)) <= SPELT:
            return joined, _spelt(joined)
        return None, frozenset().union(*(need for _, need in each))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = arg
        exact, need = _facts(body)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, ANYTHING
        return None, (need if least else ANYTHING)
    if op is sre.AT:
        return frozenset([""]), ANYTHING
    return None, ANYTHING


def trigram_query(pattern: str) -> Clauses:
    """Clauses of lower-case trigrams; every match contains one clause whole.

    An empty clause means that the rule has no mandatory trigram.
    """
    exact, need = _facts(_parser.parse(re.sub(r"^\(\?i\)", "", pattern)))
    clauses = _spelt(exact) if exact is not None else need
    if frozenset() in clauses:
        return ANYTHING
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


# --- index --------------------------------------------------------------------


def _key() -> Column:
    return F.xxhash64(text_or_empty())


def clause_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule, clause, size, trigram) of all rules that have mandatory trigrams."""
    rows = [
        (n, c, len(clause), t)
        for n, rule in enumerate(rules)
        if (clauses := trigram_query(rule.pattern)) != ANYTHING
        for c, clause in enumerate(sorted(map(sorted, clauses)))
        for t in clause
    ]
    return spark.createDataFrame(rows, "rule int, clause int, size int, trigram string")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the distinct texts that contain each of ``trigrams``."""
    held = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))
    # Bound in a lambda, the lower-case text is made once and not for each trigram.
    some = F.get(F.transform(F.array(F.lower(text_or_empty())), held), 0)
    return docs.select(_key().alias("key"), F.explode(some).alias("trigram")).distinct()


def candidates(index: DataFrame, clauses: DataFrame) -> DataFrame:
    """(key, rules): the texts that hold all trigrams of a clause of each rule."""
    hits = index.join(F.broadcast(clauses), "trigram")  # as many rows as the rules' trigrams
    whole = hits.groupBy("key", "rule", "clause").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).filter("n = size")
    return whole.groupBy("key").agg(F.collect_set("rule").alias("rules"))


SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "rank", "stop")]))


def spans_of(text: Column, rank: int, rule: Rule) -> Column:
    """(start, rank, stop) of a rule's matches, by the lengths of matches and gaps."""
    pattern = F.lit(rule.pattern)
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    ok = lambda m: F.lit(True)
    if rule.least:
        group, least = rule.least
        ok = lambda m: F.length(F.regexp_extract(m, rule.pattern, group)) >= least
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
        F.when(
            x["m"].isNotNull() & ok(x["m"]),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        F.lit(rank).alias("rank"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("stop"),
                    )
                ),
            ),
        )
        .otherwise(acc["out"])
        .alias("out"),
    )
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.coalesce(m, F.lit("")).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    step_real = lambda acc, x: F.when(x["m"] == "", acc).otherwise(step(acc, x))
    return F.aggregate(pairs, start, step_real, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): ``spans`` is array<struct<start, rank, stop>> by start,
    then by the rule's place in ``rules``."""
    spark = docs.sparkSession
    clauses = clause_table(spark, rules)
    asked = sorted({t for r in rules if (q := trigram_query(r.pattern)) != ANYTHING for c in q for t in c})
    found = staged(candidates(postings(docs, asked), clauses), "candidates")
    t = text_or_empty()
    rows = docs.select("doc_id", t.alias("text"), _key().alias("key"), *_full_scans(rules, t))
    if found.count() <= SMALL:
        rows = rows.join(F.broadcast(found), "key", "left")
    else:  # a text may have very many copies
        keys = docs.select(_key().alias("key"))
        rows = spread_join(rows, found, ["key"], hot_keys(counted(keys, ["key"]), ["key"], docs.count()), "doc_id", "left")
    per_rule = []
    for n, rule in enumerate(rules):
        on = F.col(f"full_{n}") if trigram_query(rule.pattern) == ANYTHING else F.array_contains("rules", n)
        per_rule.append(F.when(on, spans_of(F.col("text"), n, rule)).otherwise(F.array().cast(SPANS)))
    return rows.select("doc_id", F.sort_array(reduce(F.concat, per_rule)).alias("spans"))


def _full_scans(rules: tuple[Rule, ...], t: Column) -> list[Column]:
    """Rules without mandatory trigrams are tried on every text, as it is read."""
    return [F.rlike(t, F.lit(r.pattern)).alias(f"full_{n}") for n, r in enumerate(rules) if trigram_query(r.pattern) == ANYTHING]


def _digest(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    one = lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["stop"])
    return F.array_join(F.transform(spans, one), ",")


def op1_secret_scans(docs: DataFrame) -> DataFrame:
    kinds = [r.kind for r in RULES]
    found = scan(docs.select("doc_id", "text"))
    found = found.select("doc_id", F.explode(F.array("spans")).alias("spans"))
    s = F.col("spans")
    count = lambda n: F.size(F.filter(s, lambda x: x["rank"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)],
        F.sha2(_digest(F.filter(s, lambda x: x["rank"] < len(BASE)), kinds), 256).alias("base_sha256"),
        _digest(s, kinds).alias("spans"),
    )


def _rule_sql(n: int, rule: Rule) -> str:
    p = rule.pattern.replace("(?i)", "").replace("'", "''")
    if rule.pattern.startswith("(?i)"):  # ASCII letters only, in either case
        head, rest = p.split(")", 1)
        p = re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + ")" + rest
    ok = f"length(regexp_extract(m, '{p}', {rule.least[0]})) >= {rule.least[1]}" if rule.least else "true"
    return f"""SELECT rid, {n} AS rank, start, start + length(m) AS stop FROM (
  SELECT rid, unnest(ms) AS m, unnest(list_transform(generate_series(1, len(ms)), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)))::BIGINT AS start
  FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps FROM d) WHERE len(ms) > 0) WHERE {ok}"""


_KIND_SQL = "CASE rank " + " ".join(f"WHEN {n} THEN '{r.kind}'" for n, r in enumerate(RULES)) + " END"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(n, r) for n, r in enumerate(RULES))}),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (rank = {n}) n_{r.kind}" for n, r in enumerate(BASE))},
  string_agg({_KIND_SQL} || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) base,
  string_agg({_KIND_SQL} || ':' || start || ':' || stop, ',' ORDER BY start, rank) spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN g USING (rid)
"""

"""Reference graphs: nodes, edges, resolution, status axes and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.functions import text as T


def reference_edges(texts: DataFrame, pattern: str = R.REFERENCE_LINK) -> DataFrame:
    """(source, target, start, relation) for each literal reference, itself not."""
    s = texts.select("source", "text", F.explode(T.spans(F.col("text"), pattern)).alias("s"))
    e = s.select("source", F.col("s.literal").alias("target"), F.col("s.start").alias("start"), R.relation_near(F.col("text"), F.col("s.start"), F.col("s.end")).alias("relation"))
    return e.filter("source <> target")


def resolve_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with state linked, ambiguous or unresolved by the distinct nodes
    (node, identity) that their target names."""
    g = nodes.groupBy("node").agg(F.count_distinct("identity").alias("n"), F.min("identity").alias("identity"))
    j = edges.join(g, edges["target"] == g["node"], "left")
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("linked")
    return j.select(*edges.columns, state.alias("state"), F.when(F.col("n") == 1, F.col("identity")).alias("identity"))


def link_id(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def distinct_links(links: DataFrame, *columns: str) -> DataFrame:
    return links.withColumn("link_id", link_id(*columns)).dropDuplicates(["link_id"])


def status_axes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Per node: as source, as target, other meeting, unresolved; two equi joins
    instead of one on either end."""
    out = links.select(F.col("source").alias("node"), F.lit("out").alias("side"), "state", "cross")
    into = links.select(F.col("target").alias("node"), F.lit("in").alias("side"), "state", "cross")
    g = out.unionByName(into).groupBy("node").agg(
        F.bool_or(F.col("side") == "out").alias("refers"), F.bool_or(F.col("side") == "in").alias("referred"), F.bool_or("cross").alias("cross_meeting"), F.bool_or(F.col("state") != "linked").alias("open")
    )
    return nodes.join(g, "node", "left").na.fill(False, ["refers", "referred", "cross_meeting", "open"])


def coverage_state(rows: DataFrame, key: str) -> DataFrame:
    """The state of highest priority per key; the first one on ties."""
    prio = F.lit(-1)
    for state, p in R.COVERAGE_PRIORITY.items():
        prio = F.when(F.col("state") == state, p).otherwise(prio)
    return rows.groupBy(key).agg(F.max_by("state", F.struct(prio, -F.col("order"))).alias("state"))


def diagnostics(links: DataFrame) -> DataFrame:
    complete = F.when(F.bool_or(F.col("state") == "ambiguous"), "partial").when(F.bool_or(F.col("state") == "unresolved"), "incomplete").otherwise("complete")
    return links.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "linked").alias("linked"), F.count_if(F.col("state") == "ambiguous").alias("ambiguous"), F.count_if(F.col("state") == "unresolved").alias("unresolved"), complete.alias("completeness"))


#: Rows of one group that a task pairs with as many others.
PAIR_BLOCK = 256


def disjoint_pairs(rows: DataFrame, within: str, limit: int | None = None) -> DataFrame:
    """Unordered pairs (least id first) of one ``within`` group whose non-empty
    organisation sets share no name. All of them, or, for a caller that asks for no
    more than ``limit``, an error beyond.

    A group is dealt to blocks by a hash of the id, and two blocks, or one with
    itself, are a key of the join: it stays an equi join, and a large group is the
    work of many tasks. A row is sent once for each block of its group. The number of
    tasks is fixed, as few rows make many pairs: by the size of its input Spark would
    join them in one task, whose result is then too large to be fetched.
    """
    from docketry.operators.inventory import guarded

    r = rows.filter(F.size("orgs") > 0).withColumn("orgs", F.array_distinct(F.transform("orgs", F.lower)))
    if limit is not None:
        r = _few_pairs(r, within, limit)
    r = r.filter(F.col("id").isNotNull()).select(within, "id", "orgs")
    parts = r.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PAIR_BLOCK))).cast("int").alias("__parts"))
    r = r.join(parts, within).withColumn("__p", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int"))
    lo = r.select(within, "id", "orgs", F.col("__p").alias("__lo"), F.explode(F.sequence("__p", F.col("__parts") - 1)).alias("__hi"))
    hi = r.select(within, "id", "orgs", F.explode(F.sequence(F.lit(0), "__p")).alias("__lo"), F.col("__p").alias("__hi"))
    # Not broadcast and not coalesced: a small table is one task otherwise, however many its pairs are.
    key, tasks = (within, "__lo", "__hi"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = lo.repartition(tasks, *key).hint("shuffle_hash").alias("a"), hi.repartition(tasks, *key).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    once = (F.col("a.__lo") < F.col("a.__hi")) | (F.col("a.id") < F.col("b.id"))
    pairs = a.join(b, T.all_of([*same, once, ~F.arrays_overlap("a.orgs", "b.orgs")]))
    pairs = pairs.select(F.col(f"a.{within}").alias(within), F.least("a.id", "b.id").alias("left_id"), F.greatest("a.id", "b.id").alias("right_id"))
    return pairs if limit is None else guarded(pairs, limit, "pairs")


def _few_pairs(r: DataFrame, within: str, limit: int) -> DataFrame:
    """``r``, or an error before any pair is built if group sizes alone tell that
    there are more than ``limit`` pairs: all pairs of the groups, less those that
    can share each name."""
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    n = F.count(F.lit(1)).alias("n")
    every = r.groupBy(within).agg(n).agg(pairs.alias("every"))
    alike = r.select(within, F.explode("orgs").alias("org")).groupBy(within, "org").agg(n).agg(pairs.alias("alike"))
    least = every.crossJoin(F.broadcast(alike)).select((F.coalesce("every", F.lit(0.0)) - F.coalesce("alike", F.lit(0.0))).alias("__least"))  # one row each
    ok = F.when(F.col("__least") > limit, F.raise_error(F.lit(f"more than {limit} pairs")).cast("boolean")).otherwise(True)
    return r.crossJoin(F.broadcast(least)).filter(ok).drop("__least")


def mentions(edges: DataFrame, wanted: DataFrame, relations: list[str]) -> DataFrame:
    """Edges of some relations whose target is wanted (target)."""
    return edges.filter(F.col("relation").isin(relations)).join(wanted, "target", "left_semi")


def without_link(nodes: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """Nodes (node) that no edge of the relation names."""
    named = edges.filter(F.col("relation") == relation).select(F.col("target").alias("node"))
    return nodes.join(named, "node", "left_anti")


def pair_identity(left: Column, right: Column) -> Column:
    lo, hi = F.least(left, right), F.greatest(left, right)
    return F.sha2(F.to_json(F.struct(lo.alias("left"), hi.alias("right"))), 256)


def accepted(candidates: DataFrame, reviews: DataFrame, key: str, decisions: list[str]) -> DataFrame:
    """Candidates whose latest review accepts them."""
    latest = reviews.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sequence")))).filter("__r = 1")
    return candidates.join(latest.filter(F.col("decision").isin(decisions)).select(key, "decision"), key)


def basis_spans_valid(spans: DataFrame, key: str) -> DataFrame:
    """Whether a key's basis spans quote its text exactly, in order, apart."""
    w = Window.partitionBy(key).orderBy("start")
    exact = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("exact")
    apart = F.coalesce(F.lag("end").over(w) <= F.col("start"), F.lit(True))
    return spans.withColumn("__ok", exact & apart).groupBy(key).agg(F.bool_and("__ok").alias("valid"))

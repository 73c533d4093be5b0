"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are each to be taken ``target / source_size`` times. The
whole part is taken outright; the fractional parts are copy probabilities that
are rounded in pairs: two items move mass, by size, until the probability of one
is 0 or 1, in one direction or the other at random such that each expectation
holds. (An item larger than most is paired with the pool of all smaller ones, as
long as that can give or hold enough, so what stays open is small.) The sum of size
times probability never changes, so a source ends within one document of its
target. Items are dealt to cells by a hash; a cell ends with at most one residual;
residuals of ``FANOUT`` cells meet in the next round, up a reduction tree, until a
source has one, which is rounded to the nearer side.

All randomness is a hash of the seed, the round and the items' identity, so
reruns agree whatever the partitions and lost executors.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; repeated rows are items of equal identity,
rounded together; a null ``doc_id`` is an identity like any other; an empty table
or a corpus of size 0 gives targets of 0; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import WORD, free_name, mix, staged, text_or_empty

#: The weights of the sources in order, repeating; the most copies.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Items in a cell, about; cells that meet in a round; sources and items that are
#: broadcast.
CELL, FANOUT, SMALL, SMALL_ITEMS = 4096, 64, 100_000, 1_000_000


def sizes(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id"), F.col("source"), size.alias("size"))


def ordered_sources(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each) with ``place`` from 0 by code point, null last.

    The rows are range-partitioned; a place is the rank in the partition and the
    rows of the partitions before, so no task holds all sources.
    """
    sorted_ = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    tagged = staged(sorted_.withColumn("__id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("__id", 33)
    # One row for each partition, however many sources there are.
    n = dict(tagged.groupBy(part.alias("p")).count().collect())
    before, at = {}, 0
    for p in sorted(n):
        before[p], at = at, at + n[p]
    table = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    rank = F.col("__id").bitwiseAND((1 << 33) - 1)
    return tagged.withColumn("place", (F.coalesce(F.get(F.array(table[part]), 0), F.lit(0)) + rank).cast("long")).drop("__id")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target``: shares by weight, capped at ``most`` times the source.

    Each pass finds the sources whose share is above their cap, fixes them there
    and shares the rest anew; a pass is one aggregate over the sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, F.lit(False)
    n_capped = -1
    while True:
        free = s.agg(
            F.sum(F.when(capped, F.col("cap"))).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.count(F.when(capped, 1)).alias("n")
        ).first()
        if free["n"] == n_capped or not free["w"]:
            break
        n_capped = free["n"]
        rate = (total - (free["fixed"] or 0.0)) / free["w"]
        capped = F.col("weight") * F.lit(rate) > F.col("cap")
    return s.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.lit(rate))).drop("weight", "cap")


# --- pivotal rounding ---------------------------------------------------------

#: An identifier goes through pandas as a number and whether it is null, as a
#: column with nulls would become one of doubles.
DONE = "source string, id long, no_id boolean, size long, rows long, p double, cell long, open boolean"


def _draws(seed: int, keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.astype(np.uint64) + mix(np.full(len(keys), seed, np.uint64))) >> np.uint64(11)).astype(float) / 2.0**53


def settle_large(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round the larger half of a cell, ordered by falling size, against the rest.

    Item i becomes 1 with probability p[i], else 0, and the mass that this takes
    or frees is drawn from or spread over all smaller items in proportion to what
    they can give or hold. Expectations and sum(size * p) hold as for a pair, and
    the residual that a cell ends with is a small one. Where the smaller items can
    make up for one side only, the item goes that way: a source's size counts for
    more than one item's expectation.
    """
    p, size = p.copy(), size.astype(float)
    for i in range(len(size) // 2 if len(size) > 2 else 0):
        rest = slice(i + 1, None)
        give, hold = size[rest] * p[rest], size[rest] * (1 - p[rest])
        up, down = size[i] * (1 - p[i]), size[i] * p[i]
        may_rise, may_fall = give.sum() > up, hold.sum() > down
        if not 0.0 < p[i] < 1.0 or not (may_rise or may_fall):
            continue
        if may_rise and (draw[i] < p[i] or not may_fall):
            p[rest], p[i] = p[rest] * (1 - up / give.sum()), 1.0
        else:
            p[rest], p[i] = p[rest] + (1 - p[rest]) * (down / hold.sum()), 0.0
    return p


def pivot(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round all but at most one of ``p``; returns the new p and the one left or -1.

    Keeps sum(size * p). ``draw[i]`` decides the step in which item i joins.
    """
    p = p.copy()
    open_ = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if open_ < 0:
            open_ = i
            continue
        j, a, b = open_, float(size[open_]), float(size[i])
        up = min(a * (1 - p[j]), b * p[i])  # mass that i can give to j
        down = min(a * p[j], b * (1 - p[i]))
        if draw[i] * (up + down) < down:
            full_j, full_i = a * (1 - p[j]) <= b * p[i], b * p[i] <= a * (1 - p[j])
            pj, pi = (1.0 if full_j else p[j] + up / a), (0.0 if full_i else p[i] - up / b)
        else:
            full_j, full_i = a * p[j] <= b * (1 - p[i]), b * (1 - p[i]) <= a * p[j]
            pj, pi = (0.0 if full_j else p[j] - down / a), (1.0 if full_i else p[i] + down / b)
        p[j], p[i] = pj, pi
        open_ = j if 0.0 < pj < 1.0 else i if 0.0 < pi < 1.0 else -1
    return p, open_


def _round_cell(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pd.util.hash_pandas_object(pdf[["id", "no_id", "size"]], index=False).to_numpy()
        order = np.lexsort((key, -pdf["size"].to_numpy()))  # large first: what is left over is small
        pdf, key = pdf.iloc[order].reset_index(drop=True), key[order]
        size, draw = pdf["size"].to_numpy(), _draws(seed, key)
        p, open_ = pivot(size, settle_large(size, pdf["p"].to_numpy(), draw), _draws(seed + 7919, key))
        pdf = pdf.assign(p=p, open=False)
        if open_ >= 0:
            pdf.loc[open_, "open"] = True
        return pdf[["source", "id", "no_id", "size", "rows", "p", "cell", "open"]]

    return run


def item_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """One row per (source, doc_id, size): rows, source_size, target, whole, extra.

    Of its ``rows`` equal rows the first ``extra`` are taken whole + 1 times, the
    others whole times.
    """
    rows = staged(sizes(docs), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = staged(targets(ordered_sources(per_source), weights, most), "targets")
    stats = goal.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).first()
    hinted = F.broadcast(goal) if stats["k"] <= SMALL else goal

    # Equal rows are one item with a count.
    items = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"))
    items = items.alias("i").join(hinted.alias("g"), F.col("i.source").eqNullSafe(F.col("g.source"))).select(
        "i.source", "i.doc_id", "i.size", "i.rows", "g.source_size", "g.target", "g.n"
    )
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    cells = F.ceil(F.col("n") / F.lit(float(CELL)))
    items = (
        items.withColumn("rate", F.least(rate, F.lit(float(most))))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("mass", (F.col("rate") - F.col("whole")) * F.col("rows"))
        # Of ``rows`` equal items, floor(mass) are taken and one is left to round.
        .withColumn("ones", F.when(F.col("size") > 0, F.floor("mass")).otherwise(0).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("mass") - F.floor("mass")).otherwise(0.0))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), cells).cast("long"))
    )
    items = staged(items, "items")
    todo = items.filter((F.col("p") > 0) & (F.col("p") < 1))
    todo = todo.select("source", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "size", "rows", "p", "cell")
    width, level, done = -(-int(stats["n"] or 1) // CELL), 0, []
    while True:
        out = staged(todo.groupBy("source", "cell").applyInPandas(_round_cell(seed + level), DONE), f"round{level}")
        done.append(out.filter(~F.col("open")))
        left = out.filter("open").drop("open")
        if width <= 1:
            break
        width = -(-width // FANOUT)
        todo = left.withColumn("cell", F.floor(F.col("cell") / FANOUT).cast("long"))
        level += 1
    # One residual of each source at most.
    done.append(left.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)).withColumn("open", F.lit(False)))
    rounded = done[0]
    for x in done[1:]:
        rounded = rounded.unionByName(x)
    rounded = rounded.select("source", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "size", F.col("p").cast("long").alias("extra"))
    same = (
        F.col("i.source").eqNullSafe(F.col("r.source")) & F.col("i.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("i.size") == F.col("r.size"))
    )
    found = items.alias("i").join(rounded.alias("r"), same, "left")
    more = F.col("i.ones") + F.coalesce("r.extra", F.lit(0))
    return found.select(*[f"i.{c}" for c in ("source", "doc_id", "size", "rows", "source_size", "target", "whole")], more.alias("extra"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per document."""
    found = item_copies(docs, weights, most, seed)
    found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("nth"))
    one = (F.col("nth") <= F.col("extra")).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + one).alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns."""
    found = staged(item_copies(docs, weights, most, seed), "copies")
    o = {c: free_name(docs, f"__{c}") for c in ("source", "doc_id", "size", "rows", "whole", "extra", "words", "n", "take")}
    found = found.select(*[F.col(c).alias(o[c]) for c in ("source", "doc_id", "size", "rows", "whole", "extra")]).filter(F.col(o["whole"]) + F.col(o["extra"]) > 0)
    if found.count() <= SMALL_ITEMS:  # else the texts are shuffled
        found = F.broadcast(found)
    tagged = docs.withColumn(o["words"], F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))
    same = F.col("source").eqNullSafe(F.col(o["source"])) & F.col("doc_id").eqNullSafe(F.col(o["doc_id"])) & (F.col(o["words"]) == F.col(o["size"]))
    # Only rows that repeat need to know which of the equal ones they are.
    once = tagged.join(found.filter(F.col(o["rows"]) == 1), same).withColumn(o["n"], F.lit(1))
    place = Window.partitionBy("doc_id", "source", o["words"]).orderBy(F.xxhash64("text"))
    again = tagged.join(found.filter(F.col(o["rows"]) > 1), same).withColumn(o["n"], F.row_number().over(place))
    again_ = found.filter(F.col(o["rows"]) > 1)
    take = F.col(o["whole"]) + (F.col(o["n"]) <= F.col(o["extra"])).cast("long")
    parts = [once] if again_.isEmpty() else [once, again]
    out = [x.withColumn(o["take"], F.explode(F.sequence(F.lit(1).cast("long"), take))) for x in (y.filter(take > 0) for y in parts)]
    out = [x.select(*docs.columns) for x in out]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def op2_mixing(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

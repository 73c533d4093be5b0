"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every row gets the SHA-256 of its text, its length and a second 64-bit hash to
verify it by, and a row number. Rows are dealt to runs by their number; a run holds
one entry for each distinct text in it (rows, and the identifier and number of the
row that stays). Runs then merge in binomial rounds: in round k the runs whose
numbers agree above the lowest ``k * BITS`` bits exchange their entries, which are
sorted by digest; entries of equal digest, length and second hash lie side by side
and become one, in one pass over the sorted rows. After the last round one entry is
left for each text, and the answer goes back down to the rows through the runs, so
a text with very many copies is never one task's.

Defined cases: a null text counts as empty; a null ``doc_id`` belongs to its
group but stays only if the group has no other identifier; of repeated rows of
the identifier that stays, exactly one is kept; an empty table gives an empty
result. Other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import free_name, staged, text_or_empty

KEY = ("sha", "chars", "proof")
#: Rows that a run holds, about, and how many runs one merge takes (2 ** BITS).
RUN_ROWS, BITS = 1 << 18, 3


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    t = text_or_empty(text)
    return docs.select(
        F.col("doc_id"),
        F.unhex(F.sha2(t, 256)).alias("sha"),
        F.length(t).alias("chars"),
        F.xxhash64(t, F.lit(7)).alias("proof"),
    )


def _rank(keep: str) -> tuple[Column, ...]:
    """The order in which rows of one text stay: by identifier, null last, then number."""
    id_ = F.col("keep_id")
    return (id_.desc_nulls_last() if keep == "largest" else id_.asc_nulls_last()), F.col("keep_row")


def run_entries(rows: DataFrame, keep: str) -> DataFrame:
    """One entry for each text of a run, combined before it is shuffled."""
    sign = 1 if keep == "largest" else -1
    # An identifier beats none, then the larger or smaller, then the first row.
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id") if sign > 0 else F.bitwise_not("doc_id"), -F.col("row"))
    best = F.max_by(F.struct("doc_id", "row"), order).alias("b")
    found = rows.groupBy("run", *KEY).agg(best, F.count(F.lit(1)).alias("group_size"))
    return found.select("run", *KEY, F.col("b.doc_id").alias("keep_id"), F.col("b.row").alias("keep_row"), "group_size")


def merge_round(runs: DataFrame, keep: str) -> DataFrame:
    """Runs of one parent merged: an exchange, a sort by digest, one pass."""
    merged = runs.withColumn("run", F.shiftright("run", BITS)).repartition("run", *KEY)
    text = Window.partitionBy("run", *KEY)  # as many rows as runs that merge, at most
    merged = merged.sortWithinPartitions("run", *KEY, *_rank(keep))
    first = F.row_number().over(text.orderBy(*_rank(keep)))
    size = F.sum("group_size").over(text.orderBy(*_rank(keep)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return merged.withColumn("nth", first).withColumn("group_size", size).filter("nth = 1").drop("nth")


def tree_merge(rows: DataFrame, n_runs: int, keep: str = "largest") -> tuple[DataFrame, DataFrame]:
    """The entries of all runs, and the one entry of each text.

    ``rows`` has the digest columns, ``doc_id``, ``row`` and ``run``.
    """
    entries = run_entries(rows, keep)
    merged, width = entries, n_runs
    while True:
        width = -(-width // (1 << BITS))
        merged = merge_round(merged, keep)
        if width <= 1:
            return entries, merged.drop("run")


def exact_dedup(docs: DataFrame, keep: str = "largest", text: str = "text") -> DataFrame:
    """One row per document: doc_id, sha, chars, proof, keep_id, group_size, kept."""
    # Numbered as they are written, so every later pass sees the same numbers.
    rows = staged(digests(docs, text).withColumn("row", F.monotonically_increasing_id()), "digests")
    n_runs = max(8, -(-rows.count() // RUN_ROWS))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(n_runs)).cast("int"))
    entries, merged = tree_merge(rows, n_runs, keep)
    down = staged(entries.select(*KEY, "run").join(merged, list(KEY)), "entries")
    out = rows.join(down, [*KEY, "run"])  # a key of a run has at most the run's rows
    return out.select("doc_id", *KEY, "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep_unique(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns.

    The row that stays is found by identifier and digest; of rows that repeat
    both, one is kept.
    """
    found = exact_dedup(docs, keep).filter("kept")
    tag = free_name(docs, "__text_proof")
    left = docs.withColumn(tag, F.xxhash64(text_or_empty(), F.lit(7)))
    right = found.select(F.col("doc_id").alias("__id"), F.col("proof").alias("__proof"))
    same = left["doc_id"].eqNullSafe(right["__id"]) & (left[tag] == right["__proof"])
    return left.join(right, same, "left_semi").dropDuplicates(["doc_id", tag]).drop(tag)


def op10_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs.select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

"""Incremental work by identity: what is unchanged is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.sources import store


def identity(*columns: str):
    """A digest of the columns that decide whether earlier work still holds."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def pending(inputs: DataFrame, done: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """Inputs whose (key, identity) has not been done."""
    return inputs.withColumn("identity", identity(*what)).join(done.select(*key, "identity"), [*key, "identity"], "left_anti")


def freshness(inputs: DataFrame, done: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """(key, state): reused, changed, new, or gone; a view, nothing is mutated."""
    a = inputs.withColumn("identity", identity(*what)).select(*key, F.col("identity").alias("now"))
    b = done.select(*key, F.col("identity").alias("before"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("before").isNull(), "new").when(F.col("now") == F.col("before"), "reused").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))


def run_stream(stream: DataFrame, done_path: str, key: list[str], what: list[str], work: Callable[[DataFrame], None], checkpoint: str, order: str | None = None):
    """``work`` on each micro-batch's inputs that are not done yet, once each.

    Of rows of one key in a batch the one of greatest ``order`` counts, or without
    an order the one of greatest identity.

    The log of identities is appended after the work, so a batch that fails is
    done again whole; ``work`` must be idempotent.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in key]
        newest = F.struct(F.col(order), identity(*what)) if order else identity(*what)
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), newest).alias("__r")).select(*key, "__r.*").select(*batch.columns)
        schema = ", ".join([f"`{k}` {dict(batch.dtypes)[k]}" for k in key] + ["identity string"])
        # The first batch finds no log.
        done = spark.read.schema(schema).parquet(done_path) if store.exists(spark, done_path) else spark.createDataFrame([], schema)
        todo = pending(latest, done, key, what).persist()
        work(todo)
        todo.select(*key, "identity").write.mode("append").parquet(done_path)
        todo.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(log: DataFrame, key: str, scope: str, order: str) -> DataFrame:
    """Supersession: only rows of each scope's newest import are current."""
    newest = log.groupBy(scope).agg(F.max(order).alias(order))
    return log.join(newest, [scope, order], "left_semi")


def append_review(reviews: DataFrame, new: DataFrame, key: str, update: bool) -> DataFrame:
    """The log with ``new`` reviews (key, review_id, decision) appended.

    A review that is there already is not appended again; a second review of a
    key needs ``update``, and supersedes the last.
    """
    last = reviews.groupBy(key).agg(F.max("sequence").alias("last"), F.max_by("review_id", "sequence").alias("prev"))
    fresh = new.join(reviews.select(key, "review_id"), [key, "review_id"], "left_anti").join(last, key, "left")
    if not update:
        clash = F.when(F.col("last").isNotNull(), F.raise_error(F.concat(F.lit("already reviewed: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
        fresh = fresh.filter(clash)
    rows = fresh.select(key, "review_id", "decision", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("sequence"), F.col("prev").alias("supersedes"))
    return reviews.unionByName(rows)

"""A stored inverted index with a lifecycle: append, supersede, mark stale, search.

The index is three tables below ``root``. ``postings`` (term, doc_id, generation, pos,
tf) are partitioned by a hash of the term, so that a query reads the buckets of its
own terms; ``blocks`` (doc_id, generation, pos, n_tokens) hold the lengths; ``state``
(doc_id, identity, generation, status) says which run's rows of a document count. A
refresh appends what is new or changed as a generation of its own and commits a new
state; all other rows are passed over by a join with the state. So nothing is mutated,
what a lost run has appended never counts, nor does what a text left that went and
came back, and of two refreshes at once one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import search as S
from docketry.sources.repository import Repository
from docketry.streaming import incremental

#: Buckets of terms.
BUCKETS = 64
INDEXED, STALE = "INDEXED", "STALE"
STATE = "doc_id long, identity string, generation string, status string"


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def state(spark: SparkSession, root: str) -> DataFrame:
    """The lifecycle of every document that was ever indexed."""
    return Repository(spark, root).table("state", STATE)


def refresh(spark: SparkSession, root: str, docs: DataFrame) -> DataFrame:
    """Index ``docs`` (doc_id, text); returns (doc_id, state): reused, changed, new or
    gone, against what the index held before. Documents that are gone are stale."""
    repo, generation = Repository(spark, root), uuid.uuid4().hex
    since = repo.version()
    known = repo.table("state", STATE, since)
    before = known.filter(F.col("status") == INDEXED)
    fresh = incremental.freshness(docs, before, ["doc_id"], ["text"])
    outcome = f"{root}/outcome.{generation}"
    fresh.write.parquet(outcome)  # what this run does, decided once
    fresh = spark.read.schema(fresh.schema).parquet(outcome)
    todo = docs.join(fresh.filter("state IN ('new', 'changed')").select("doc_id"), "doc_id", "left_semi").withColumn("generation", F.lit(generation))
    found = S.with_tokens(S.split_blocks(todo, "generation"))
    found.select("doc_id", "generation", "pos", F.size("tokens").alias("n_tokens")).write.mode("append").parquet(f"{root}/blocks")
    each = found.select("doc_id", "generation", "pos", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "generation", "pos").agg(F.count(F.lit(1)).alias("tf"))
    each.withColumn("bucket", _bucket("term")).write.mode("append").partitionBy("bucket").parquet(f"{root}/postings")
    reused = before.join(fresh.filter("state = 'reused'").select("doc_id"), "doc_id", "left_semi")
    made = todo.select("doc_id", incremental.identity("text").alias("identity"), "generation", F.lit(INDEXED).alias("status"))
    gone = before.join(fresh.filter("state = 'gone'").select("doc_id"), "doc_id", "left_semi").withColumn("status", F.lit(STALE))
    kept = known.filter(F.col("status") == STALE).join(docs.select("doc_id"), "doc_id", "left_anti")
    repo.commit(since, state=reused.unionByName(made).unionByName(gone).unionByName(kept))
    return fresh


def mark_stale(spark: SparkSession, root: str, keys: DataFrame) -> None:
    """The documents ``keys`` (doc_id) no longer count."""
    repo = Repository(spark, root)
    since, hit = repo.version(), keys.select("doc_id").distinct().withColumn("__hit", F.lit(True))
    rows = repo.table("state", STATE, since).join(hit, "doc_id", "left")
    repo.commit(since, state=rows.withColumn("status", F.when(F.col("__hit"), STALE).otherwise(F.col("status"))).drop("__hit"))


def _current(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    live = state(spark, root).filter(F.col("status") == INDEXED).select("doc_id", "generation")
    return spark.read.schema(schema).parquet(f"{root}/{table}").join(live, ["doc_id", "generation"], "left_semi")


def search(spark: SparkSession, root: str, query: str) -> DataFrame:
    """(doc_id, pos, matched, score) of all hits, by BM25 over the indexed documents.

    Reads the lengths and, of the postings, the buckets of the query's terms.
    """
    phrases, terms = T.parse_query(query)
    if phrases:
        raise ValueError("phrases need the blocks' text: use search.search_blocks")
    sizes = _current(spark, root, "blocks", "doc_id long, generation string, pos int, n_tokens int")
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("avg"))
    total = total.withColumn("avg", F.when(F.col("avg") == 0, 1.0).otherwise(F.col("avg")))  # one row
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket("t")).distinct().collect()]
    posts = _current(spark, root, "postings", "term string, doc_id long, generation string, pos int, tf long, bucket int")
    posts = posts.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
    hits = posts.join(F.broadcast(df), "term").join(sizes, ["doc_id", "generation", "pos"]).crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("n_tokens") / F.col("avg"))
    part = F.bround(idf * F.col("tf") * (S.K1 + 1) / norm, 8)
    order = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
    found = hits.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct(order.alias("i"), "term", part.alias("p")))).alias("m"))
    score = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["p"])
    return found.select("doc_id", "pos", F.transform("m", lambda x: x["term"]).alias("matched"), F.bround(score, 8).alias("score"))

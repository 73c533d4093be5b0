"""Blocks, inverted index and BM25 retrieval.

A block is a non-blank line of a document. Statistics cover all blocks, whatever
the filters of a query are. A query reads the blocks once: token count and the
frequencies of its own terms are computed per row without exploding tokens, so
the only shuffles are the statistics (one row) and the final top-k.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T

# BM25 and bonuses.
K1, B, PHRASE_BONUS, HEADING_BONUS, TITLE_BONUS = 1.2, 0.75, 2.0, 0.35, 0.15
BLOCK_KEY = ("doc_id", "pos")


def split_blocks(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per non-blank line: doc_id, ``keep``, pos (from 0), text."""
    lines = F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")).alias("pos", "text")
    return docs.select("doc_id", *keep, lines).filter(F.trim("text") != "")


def renumber(blocks: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """Dense block numbers and ids (b000001 on) in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return blocks.withColumn("block_no", n).withColumn("block_id", F.format_string("b%06d", n))


def block_tokens(text: Column) -> Column:
    """``T.tokenize`` without lambdas for the many blocks that have no compounds."""
    raw = T.raw_tokens(text)
    plain = raw
    for word in T.SEARCH_STOP:
        plain = F.array_remove(plain, word)
    return F.when(text.rlike("[A-Za-z0-9][-#][A-Za-z0-9]"), T.tokenize(text)).otherwise(plain)


def with_tokens(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("tokens", block_tokens(F.col("text")))


def postings(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, term, tf): combined per task before they are shuffled."""
    return with_tokens(blocks).select(*BLOCK_KEY, F.explode("tokens").alias("term")).groupBy(*BLOCK_KEY, "term").agg(F.count(F.lit(1)).alias("tf"))


def statistics(blocks: DataFrame) -> DataFrame:
    """n_blocks, avg_tokens over all blocks; an average of 0 counts as 1."""
    avg = F.coalesce(F.avg(F.size(block_tokens(F.col("text")))), F.lit(0.0))
    return blocks.agg(F.count(F.lit(1)).alias("n_blocks"), F.when(avg == 0, 1.0).otherwise(avg).alias("avg_tokens"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _tf(tokens: Column, term: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def _literal(term: str) -> str:
    return f"(?i){re.escape(term)}"


def search_blocks(blocks: DataFrame, query: str, where: Column | None = None) -> DataFrame:
    """All hits of ``query``: block columns, matched terms, score.

    Every quoted phrase must occur; ``where`` restricts hits, not statistics.
    """
    phrases, terms = T.parse_query(query)
    if not terms:
        return blocks.withColumn("matched", F.array().cast("array<string>")).withColumn("score", F.lit(0.0)).limit(0)
    tf = [f"tf_{i}" for i in range(len(terms))]
    counted = with_tokens(blocks).withColumn("token_count", F.size("tokens"))
    counted = counted.select("*", *[_tf(F.col("tokens"), t).alias(c) for c, t in zip(tf, terms, strict=True)])
    total = counted.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in tf]
    )  # one row
    total = total.withColumn("avg", F.when(F.col("avg") == 0, 1.0).otherwise(F.col("avg")))
    hits = counted.filter(T.any_of([F.col(c) > 0 for c in tf]))
    if where is not None:
        hits = hits.filter(where)
    for phrase in phrases:
        hits = hits.filter(T.contains_phrase(F.col("tokens"), phrase))
    hits = hits.crossJoin(F.broadcast(total))  # one row of statistics

    def part(c: str) -> Column:
        df, f = F.col(f"df_{c}"), F.col(c)
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        norm = f + K1 * (1 - B + B * F.col("token_count") / F.col("avg"))
        return F.when(f > 0, F.bround(idf * f * (K1 + 1) / norm, 8)).otherwise(0.0)

    score = F.lit(float(PHRASE_BONUS * bool(phrases)))
    for c in tf:
        score = score + part(c)
    matched = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(t)) for c, t in zip(tf, terms, strict=True)]))
    # Terms that the heading or the title shares add a bonus where those exist.
    for name, bonus in (("heading", HEADING_BONUS), ("title", TITLE_BONUS)):
        if name in blocks.columns:
            score = score + bonus * F.size(F.array_intersect(T.tokenize(F.col(name)), matched))
    hits = hits.withColumn("matched", matched).withColumn("score", F.bround(score, 8))
    return hits.drop("n", "avg", *tf, *[f"df_{c}" for c in tf])


def top_blocks(hits: DataFrame, limit: int = 20) -> DataFrame:
    return hits.orderBy(F.desc("score"), "doc_id", "pos").limit(limit)


def rollup_documents(hits: DataFrame, limit: int = 20, most: int = 1000) -> DataFrame:
    """Documents of the ``most`` best hits: best block, hits and summed score."""
    best = top_blocks(hits, most)
    order = F.struct(-F.col("score"), F.col("pos"))
    found = best.groupBy("doc_id").agg(F.min_by("pos", order).alias("best_pos"), F.count(F.lit(1)).alias("n_hits"), F.bround(F.sum("score"), 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(limit)


def index_lookup(posts: DataFrame, blocks: DataFrame, states: DataFrame, docs: DataFrame, meta: DataFrame, terms: list[str]) -> DataFrame:
    """The five-way join: postings, their blocks, lifecycle states, documents and,
    where there is any, metadata; only indexed documents count."""
    wanted = posts.filter(F.col("term").isin(terms))
    return wanted.join(blocks, list(BLOCK_KEY)).join(states.filter("status = 'INDEXED'").select("doc_id"), "doc_id").join(docs, "doc_id").join(meta, "doc_id", "left")


def stale(index_keys: DataFrame, receipts: DataFrame) -> DataFrame:
    """Index keys whose document is no longer there."""
    return index_keys.join(receipts, "doc_id", "left_anti")

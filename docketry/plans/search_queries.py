"""Retrieval queries over the lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import search as S
from docketry.plans import sql as Q

TERMS = ["thing", "and", "license", "erinst", "question", "le"]
QUERY = 'thing license "the other" le der erinst'
PHRASE = '"licensed under the" version'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # A small file is one split; only then are its rows dealt out to all cores.
    if docs.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        docs = docs.repartition(cores)
    return S.split_blocks(docs, "source", "lang")


def tokenize_tf(spark, d):
    return S.postings(blocks(spark, d))


def corpus_stats(spark, d):
    return S.statistics(blocks(spark, d)).select("n_blocks", F.round("avg_tokens", 6).alias("avg_tokens"))


def doc_freq(spark, d):
    return S.document_frequency(S.postings(blocks(spark, d)))


def bm25_search(spark, d):
    hits = S.search_blocks(blocks(spark, d), "thing license le der erinst")
    return S.top_blocks(hits).select("doc_id", "pos", F.array_join("matched", " ").alias("matched"), F.round("score", 6).alias("score"))


def bm25_phrase(spark, d):
    hits = S.search_blocks(blocks(spark, d), PHRASE)
    return S.top_blocks(hits, 50).select("doc_id", "pos", F.round("score", 6).alias("score"))


def bm25_filtered(spark, d):
    hits = S.search_blocks(blocks(spark, d), "thing license", F.col("source").isin("src1", "src2") & (F.col("lang") == "en"))
    return S.top_blocks(hits).select("doc_id", "pos", "source", F.round("score", 6).alias("score"))


def bm25_rollup_topk(spark, d):
    return S.rollup_documents(S.search_blocks(blocks(spark, d), "thing license le der erinst"))


def block_split(spark, d):
    return blocks(spark, d).select("doc_id", "pos", F.length("text").alias("n_chars"))


def block_renumber(spark, d):
    return S.renumber(blocks(spark, d)).groupBy("doc_id").agg(F.max("block_no").alias("n_blocks"), F.max("block_id").alias("last_block_id"), F.max("pos").alias("last_pos"))


def snippet(spark, d):
    b = blocks(spark, d).filter(F.lower("text").contains("license"))
    return b.select("doc_id", "pos", T.snippet(F.col("text"), ["license"], 40, 20).alias("snippet"))


def five_way_join(spark, d):
    b = blocks(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    labels = table(spark, d, "labels")
    states = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "STALE").otherwise("INDEXED").alias("status"))
    out = S.index_lookup(S.postings(b), b.select("doc_id", "pos", "lang"), states, docs, labels, TERMS)
    return out.groupBy("term", "lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"), F.sum("n_chars").alias("n_chars"))


def stale_anti_join(spark, d):
    return S.stale(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")).select("doc_id")


def block_text_renderings(spark, d):
    """The four renderings of a block that is a table row of the conversation."""
    c = table(spark, d, "conversations")
    rows = F.when(F.col("turn") % 2 == 0, F.array(F.array("role", F.lit("0"), F.col("turn").cast("string"))))
    text = F.when(F.col("turn") % 4 != 2, F.col("text"))
    return c.select("conv_id", "turn", *[f(text, rows).alias(n) for n, f in (("search", T.search_text), ("evidence", T.evidence_text), ("topic", T.topic_text), ("report", T.report_text))])


QUERIES = {f.__name__: f for f in (
    tokenize_tf, corpus_stats, doc_freq, bm25_search, bm25_phrase, bm25_filtered, bm25_rollup_topk, block_split, block_renumber, snippet, five_way_join, stale_anti_join, block_text_renderings,
)}

_STATS = "st AS (SELECT count(*) n, avg(len(tokens)) av FROM toks)"


def _bm25(terms: list[str], phrases: list[list[str]] = (), where: str = "true") -> str:
    t = "[" + ", ".join(f"'{x}'" for x in terms) + "]"
    joined = "' ' || array_to_string(tokens, ' ') || ' '"
    phrase = " AND ".join(f"contains({joined}, ' {' '.join(p)} ')" for p in phrases) or "true"
    return f"""{Q.TOKENS}, {_STATS},
tf AS (SELECT doc_id, pos, source, lang, len(tokens) dl, tokens, term, len(list_filter(tokens, lambda y: y = term)) f FROM toks, (SELECT unnest({t}) term)),
df AS (SELECT term, count(*) df FROM tf WHERE f > 0 GROUP BY term),
hit AS (SELECT doc_id, pos, any_value(source) source, any_value(lang) lang, any_value(tokens) tokens, list(term ORDER BY list_position({t}, term)) matched,
  sum(round_even(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av)), 8)) s
  FROM tf JOIN df USING (term), st WHERE f > 0 GROUP BY doc_id, pos),
hits AS (SELECT *, round_even(s + {2.0 if phrases else 0.0}, 8) score FROM hit WHERE {phrase} AND {where})"""


_Q5 = ["thing", "license", "le", "der", "erinst"]
_PH, _PT = T.parse_query(PHRASE)
SQL = {
    "tokenize_tf": f"WITH {Q.TOKENS} SELECT doc_id, pos, term, count(*) tf FROM (SELECT doc_id, pos, unnest(tokens) term FROM toks) GROUP BY ALL",
    "corpus_stats": f"WITH {Q.TOKENS} SELECT count(*) n_blocks, round(avg(len(tokens)), 6) avg_tokens FROM toks",
    "doc_freq": f"WITH {Q.TOKENS} SELECT term, count(*) df FROM (SELECT DISTINCT doc_id, pos, unnest(tokens) term FROM toks) GROUP BY term",
    "bm25_search": f"WITH {_bm25(_Q5)} SELECT doc_id, pos, array_to_string(matched, ' ') matched, round(score, 6) score FROM hits ORDER BY hits.score DESC, doc_id, pos LIMIT 20",
    "bm25_phrase": f"WITH {_bm25(_PT, _PH)} SELECT doc_id, pos, round(score, 6) score FROM hits ORDER BY hits.score DESC, doc_id, pos LIMIT 50",
    "bm25_filtered": f"WITH {_bm25(['thing', 'license'], (), '''source IN ('src1', 'src2') AND lang = 'en' ''')} SELECT doc_id, pos, source, round(score, 6) score FROM hits ORDER BY hits.score DESC, doc_id, pos LIMIT 20",
    "bm25_rollup_topk": f"""WITH {_bm25(_Q5)}, best AS (SELECT * FROM hits ORDER BY score DESC, doc_id, pos LIMIT 1000)
SELECT doc_id, arg_min(pos, (-score, pos)) best_pos, count(*) n_hits, round_even(sum(score), 6) score FROM best GROUP BY doc_id ORDER BY 4 DESC, doc_id LIMIT 20""",
    "block_split": f"WITH {Q.BLOCKS} SELECT doc_id, pos, length(text) n_chars FROM blocks",
    "block_renumber": f"""WITH {Q.BLOCKS}, n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) k FROM blocks)
SELECT doc_id, max(k) n_blocks, max(printf('b%06d', k)) last_block_id, max(pos) last_pos FROM n GROUP BY doc_id""",
    "snippet": f"""WITH {Q.BLOCKS}, p AS (SELECT doc_id, pos, text, greatest(strpos(lower(text), 'license') - 1 - 20, 0) s FROM blocks WHERE contains(lower(text), 'license'))
SELECT doc_id, pos, CASE WHEN s > 0 THEN '…' ELSE '' END || substring(text, s + 1, 40) || CASE WHEN length(text) > s + 40 THEN '…' ELSE '' END snippet FROM p""",
    "five_way_join": f"""WITH {Q.TOKENS}, p AS (SELECT doc_id, pos, lang, term, count(*) tf FROM (SELECT doc_id, pos, lang, unnest(tokens) term FROM toks) WHERE term IN ({", ".join(f"'{x}'" for x in TERMS)}) GROUP BY ALL)
SELECT term, lang, quality, count(*) n, sum(tf)::BIGINT tf, sum(n_chars)::BIGINT n_chars FROM p JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0 GROUP BY ALL""",
    "stale_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "block_text_renderings": r"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 2 THEN text END t, CASE WHEN turn % 2 = 0 THEN [role, '0', turn::VARCHAR] END r FROM conversations)
SELECT conv_id, turn,
  array_to_string(list_filter([coalesce(t, ''), coalesce(array_to_string(r, chr(9)), '')], lambda x: x <> ''), chr(10)) AS search,
  CASE WHEN r IS NOT NULL THEN array_to_string(r, chr(9)) ELSE coalesce(t, '') END AS evidence,
  CASE WHEN coalesce(t, '') <> '' THEN t ELSE coalesce(array_to_string(list_transform(r, lambda x: CASE WHEN x = '0' THEN '' ELSE x END), chr(9)), '') END AS topic,
  CASE WHEN coalesce(t, '') <> '' THEN t ELSE coalesce(array_to_string(r, ' | '), '') END AS report FROM c""",
}

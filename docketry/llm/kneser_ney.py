"""Quality classifier: an interpolated modified Kneser-Ney bigram model.

The model is trained on all trusted text: labelled documents of quality 1 that are
not toxic, whole, but for a share by a hash of the identifier that is held out for
the thresholds. Counts, their counts of counts, context sums and continuation
counts are grouped and joined as sharded tables. A model of at most ``TRUSTED``
pairs goes to the executors as sorted arrays, in shards by context that are looked
up one after another. A larger one is never held by a process: the log probability
of a text is a sum over its words and pairs (``values``), so batches of documents
ask the shards of the model for the sums over the keys that fall there, and only
the ``MOST`` values of the most frequent keys, which would make shards uneven, are
sent to every task. Both give the same numbers. A document stays while its
perplexity is no worse than its language's quantile over the held-out documents.

Defined cases: a null or empty text has no words, perplexity null, and stays; a
null ``lang`` is a language of its own; a language without trusted documents has
no threshold and its documents stay; if every trusted document is held out, there
is no model and all documents stay; labels that repeat or disagree count as not
trusted; repeated rows are scored one by one; an empty table gives an empty
result; without any trusted text every document stays. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.automaton import _pack, _rising, _risen, _small, _unpack, _whole
from docketry.llm.common import GAP, Words, as_array, chain, hash_words, shards_for, staged, text_bytes

#: Pairs of a model that is broadcast whole; values of a larger one that are; shards
#: of a broadcast model; bytes of text for each shard of a larger one; documents of
#: a batch that asks them; identifiers that are broadcast.
TRUSTED, MOST, SHARDS, BLOCK, BATCH, SMALL = 1_000_000, 400_000, 8, 9_000_000, 2000, 1_000_000
#: The quantile of trusted documents that sets a language's threshold, and how many
#: words at its median a document is taken to have besides its own, so that few
#: words prove little.
#: One trusted document in so many, and one of each language at least, is never
#: trained on, so that each language has a threshold at every size.
HELD_OUT = 5
QUANTILE, PRIOR_WORDS = 0.995, 30.0
START = "\n"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of labelled documents of quality 1 that are not toxic."""
    ok = (F.min("quality") == 1) & (F.max("toxic") == 0)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(ok.alias("ok")).filter("ok").select("doc_id")


def bigram_counts(texts: DataFrame) -> DataFrame:
    """(h, w, c) over ``texts`` (text): pairs of lower-case words, from START on."""
    # Lower-cased as the scored texts are: A to Z only.
    low = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.filter(F.split(low, GAP), lambda w: w != "")
    pair = lambda w, h: F.struct(h.alias("h"), w.alias("w"))
    pairs = F.zip_with("ws", F.concat(F.array(F.lit(START)), F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0)))), pair)
    one = texts.select(F.explode(F.array(words)).alias("ws")).filter(F.size("ws") > 0)
    return one.select(F.inline(pairs)).groupBy("h", "w").agg(F.count(F.lit(1)).alias("c"))


def discounts(counts: DataFrame, c: str) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts."""
    n = [float(counts.filter(F.col(c) == k).count()) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


@dataclass
class Model:
    """Sorted arrays. Words by hash: continuation probability and weight of
    falling back; pairs by (context hash, word hash) key, in shards: the
    discounted share."""

    words: np.ndarray
    lower: np.ndarray
    back: np.ndarray
    unknown: float
    pairs: list[np.ndarray]
    share: list[np.ndarray]

    def nll(self, words: Words) -> np.ndarray:
        """-log10 P of each text."""
        n = len(words.ids)
        if not n:
            return np.zeros(len(words.counts))
        hashes = words.hashes
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        known = self.words[at] == hashes
        low_v = np.where(known, self.lower[at], self.unknown)
        back_v = np.where(known, self.back[at], 1.0)
        start = hash_words([START])
        s = np.searchsorted(self.words, start)[0]
        first = words.starts[words.counts > 0]
        prev = np.empty(n, dtype=np.int64)
        prev[1:] = words.ids[:-1]
        prev[0] = 0
        back = back_v[prev]
        h = hashes[prev]
        both = known[prev] & known[words.ids]
        has_start = s < len(self.words) and self.words[s] == start[0]
        h[first], back[first], both[first] = start[0], self.back[s] if has_start else 1.0, known[words.ids[first]]
        p = back * low_v[words.ids]
        idx = np.flatnonzero(both)
        key = chain(h[idx], hashes[words.ids[idx]])
        shard = (key >> np.uint64(32)) % np.uint64(len(self.pairs))
        for k, (pairs, share) in enumerate(zip(self.pairs, self.share, strict=True)):
            mine = np.flatnonzero(shard == k)
            if not len(mine) or not len(pairs):
                continue
            a = np.searchsorted(pairs, key[mine])
            a[a == len(pairs)] = 0
            hit = pairs[a] == key[mine]
            p[idx[mine[hit]]] += share[a[hit]]
        logs = np.concatenate(([0.0], np.cumsum(-np.log10(p))))
        return logs[words.ends] - logs[words.starts]


@dataclass
class Tables:
    """The model as tables: words (word, lower, back), pairs (h, w, c, share, back)."""

    vocab: DataFrame
    pairs: DataFrame
    unknown: float
    n_pairs: int


def estimate(texts: DataFrame) -> Tables | None:
    """The model of all of ``texts`` (text)."""
    counts = staged(bigram_counts(texts), "bigrams")
    d = discounts(counts, "c")
    # Joined by context: c(h), N1(h), N2(h), N3+(h).
    hit = lambda k: F.count(F.when(F.col("c") == k, 1) if k < 3 else F.when(F.col("c") >= 3, 1))
    ctx = counts.groupBy("h").agg(F.sum("c").alias("total"), hit(1).alias("n1"), hit(2).alias("n2"), hit(3).alias("n3"))
    gamma = (F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / F.col("total")
    ctx = ctx.select("h", "total", gamma.alias("back"))
    # Joined by word: the contexts that a word continues.
    cont = staged(counts.groupBy("w").agg(F.count(F.lit(1)).alias("k")), "continuations")
    d1 = discounts(cont, "k")
    kinds = cont.agg(F.sum("k").alias("types"), F.count(F.lit(1)).alias("v"), F.sum(F.least(F.col("k").cast("double"), _discount(F.col("k"), d1))).alias("off")).first()
    if not kinds["types"]:
        return None
    unknown = kinds["off"] / kinds["types"] / (kinds["v"] + 1)
    lower = F.greatest(F.col("k") - _discount(F.col("k"), d1), F.lit(0.0)) / kinds["types"] + unknown
    vocab = cont.select(F.col("w").alias("word"), lower.alias("lower")).join(ctx.select(F.col("h").alias("word"), "back"), "word", "full_outer")
    share = F.greatest(F.col("c") - _discount(F.col("c"), d), F.lit(0.0)) / F.col("total")
    pairs = counts.join(ctx, "h").select("h", "w", "c", share.alias("share"), "back")
    return Tables(vocab, pairs, unknown, kinds["types"])


def train(texts: DataFrame) -> Model | None:
    """The model of ``texts`` (text), to be held by one process."""
    tables = estimate(texts)
    return None if tables is None else collected(tables)


def collected(tables: Tables) -> Model:
    unknown = tables.unknown
    v = tables.vocab.mapInArrow(_hashed(["word"], ["lower", "back"]), "key long, lower double, back double").toArrow()
    b = tables.pairs.mapInArrow(_hashed(["h", "w"], ["share"]), "key long, share double").toArrow()
    words, key = (t.column("key").to_numpy().view(np.uint64) for t in (v, b))
    o, po = np.argsort(words), np.argsort(key)
    low, back = (pc.fill_null(v.column(c), d).to_numpy() for c, d in (("lower", unknown), ("back", 1.0)))
    key, value = key[po], b.column("share").to_numpy()[po]
    shard = (key >> np.uint64(32)) % np.uint64(SHARDS)
    return Model(words[o], low[o], back[o], unknown, [key[shard == k] for k in range(SHARDS)], [value[shard == k] for k in range(SHARDS)])


def _hashed(words: list[str], values: list[str]):
    """Rows whose words are replaced by the hash of their sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = None
            for w in words:
                h = hash_words(batch.column(w).to_numpy(zero_copy_only=False))
                key = h if key is None else chain(key, h)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[batch.column(c) for c in values]], names=["key", *values])

    return run


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_words, nll (-log10 P) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TRUSTED pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words = Words(as_array(part.column("text")), lower=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array(words.counts, pa.int64()), pa.array(shared.value.nll(words), pa.float64())],
                    names=["doc_id", "lang", "n_words", "nll"],
                )

    return docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, n_words long, nll double")


# --- a model of any size --------------------------------------------------------

#: Kinds of keys that are no pairs: a word, and the last word of a text.
WORD, LAST = np.uint64(1), np.uint64(2)


def values(tables: Tables) -> DataFrame:
    """(key, c, value): what each occurrence of a key adds to log10 P of a text.

    P(w | h) is lower(w) * back(h), times 1 + share(h, w) / (lower(w) * back(h)) if
    the pair was seen. Relative to a text of unknown words a word adds its own lower
    and, as a history, its back; the last word of a text is no history.
    """
    vocab = staged(tables.vocab.select("word", F.coalesce("lower", F.lit(tables.unknown)).alias("lower"), F.coalesce("back", F.lit(1.0)).alias("back")), "vocabulary")
    low, back = F.log10(F.col("lower") / tables.unknown), F.log10("back")
    words = vocab.select("word", F.lit(None).cast("string").alias("w"), F.lit(1).alias("kind"), (low + back).alias("value"))
    last = vocab.filter("back <> 1").select("word", F.lit(None).cast("string").alias("w"), F.lit(2).alias("kind"), (-back).alias("value"))
    joined = tables.pairs.join(vocab.select(F.col("word").alias("w"), "lower"), "w")
    pairs = joined.select(F.col("h").alias("word"), "w", F.lit(0).alias("kind"), F.log10(1 + F.col("share") / (F.col("lower") * F.col("back"))).alias("value"), "c")
    # A word is as frequent as the pairs that it continues are together.
    often = tables.pairs.groupBy(F.col("w").alias("word")).agg(F.sum("c").alias("c"))
    words, last = (x.join(often, "word", "left").select(*x.columns, F.coalesce("c", F.lit(1)).cast("long").alias("c")) for x in (words, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hash_words(batch.column("word").to_numpy(zero_copy_only=False))
            w = hash_words(batch.column("w").fill_null("").to_numpy(zero_copy_only=False))
            kind = batch.column("kind").to_numpy(zero_copy_only=False).astype(np.uint64)
            key = np.where(kind == 0, chain(h, w), chain(kind, h)) if len(h) else h
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("c"), batch.column("value")], names=["key", "c", "value"])

    return pairs.unionByName(words).unionByName(last).mapInArrow(run, "key long, c long, value double")


def keys_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a batch of texts with their text's number and how often it has them."""
    hashes = words.stream()
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    full = words.counts > 0
    prev = np.empty_like(hashes)
    prev[1:] = hashes[:-1]
    prev[words.starts[full]] = hash_words([START])[0]
    last = words.ends[full] - 1
    key = np.concatenate((chain(prev, hashes), chain(WORD, hashes), chain(LAST, hashes[last])))
    doc = np.concatenate((doc, doc, doc[last]))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))) if len(key) else np.empty(0, np.int64)
    return key[at], doc[at], np.diff(np.concatenate((at, [len(key)])))


def _found(keys: np.ndarray, values_: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``key`` are in sorted ``keys``, and their values."""
    if not len(keys):
        return np.zeros(len(key), bool), np.zeros(len(key))
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    hit = keys[at] == key
    return hit, np.where(hit, values_[at], 0.0)


#: Identifiers without nulls and whether there is one: pandas would make doubles of them.
ASK = "shard int, batch long, doc_id array<long>, no_id array<boolean>, lang array<string>, n array<long>, base array<double>, data binary"
SCORES = "doc_id long, lang string, n_words long, nll double"


def sharded(docs: DataFrame, tables: Tables) -> DataFrame:
    """As ``perplexities``, by a model of any size."""
    shards = shards_for(text_bytes(docs), BLOCK, 4)
    model = staged(values(tables), "values")
    top = model.orderBy(F.desc("c"), "key").limit(MOST).select("key", "value").toArrow()  # at most MOST
    top_key = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(top_key)
    at_start = tables.vocab.filter(F.col("word") == START).select("back").first()
    first = np.log10(at_start["back"]) if at_start and at_start["back"] else 0.0
    unknown = np.log10(tables.unknown)
    shared = docs.sparkSession.sparkContext.broadcast((top_key[order], top.column("value").to_numpy()[order]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch_id, names = TaskContext.get().partitionId() << 32, [c.split()[0] for c in ASK.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                words = Words(as_array(part.column("text")), lower=True)
                key, doc, n = keys_of(words)
                hit, value = _found(*shared.value, key)
                base = words.counts * unknown + np.where(words.counts > 0, first, 0.0) + np.bincount(doc, n * value, len(words.counts))
                key, doc, n = (x[~hit] for x in (key, doc, n))
                shard = key % np.uint64(shards)
                by = np.argsort(shard, kind="stable")
                key, doc, n, edge = key[by], doc[by], n[by], np.searchsorted(shard[by], np.arange(shards + 1).astype(np.uint64))
                rows = [(batch_id % shards, batch_id, part.column("doc_id").fill_null(0).to_pylist(), part.column("doc_id").is_null().to_pylist(), part.column("lang").to_pylist(), words.counts.tolist(), base.tolist(), None)]
                for s, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    if b > a:
                        rows.append((s, batch_id, None, None, None, None, None, _pack(_rising(key[a:b]), doc[a:b].astype("<u2"), *_small(n[a:b]))))
                batch_id += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def answer(asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """A shard: for each batch the sums of its texts over the keys here."""
        keys = own["key"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(keys)
        keys, vals = keys[by], own["value"].to_numpy(np.float64)[by]
        asks = asks.drop(columns="shard")
        for i, data in zip(asks.index, asks["data"], strict=True):
            if data is not None:
                key, doc, n, large = _unpack(data, "u1", "<u2", "u1", "<u8")
                hit, value = _found(keys, vals, _risen(key))
                doc, part = doc[hit], (_whole(n, large) * value)[hit]
                texts, of = np.unique(doc, return_inverse=True)
                asks.at[i, "data"] = _pack(texts, np.bincount(of, part, len(texts)))
        return asks

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["doc_id"].notna()].iloc[0]
        log = np.array(head["base"], np.float64)
        for data in pdf["data"]:
            if data is not None:
                texts, part = _unpack(data, "<u2", "<f8")
                log[texts] += part
        ids = pd.arrays.IntegerArray(np.array(head["doc_id"], np.int64), np.array(head["no_id"], bool))
        return pd.DataFrame({"doc_id": ids, "lang": list(head["lang"]), "n_words": np.array(head["n"], np.int64), "nll": -log})

    asks = docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(ask, ASK)
    own = model.select("key", "value", _shard(F.col("key"), shards).alias("shard"))
    answers = asks.groupBy("shard").cogroup(own.groupBy("shard")).applyInPandas(answer, ASK.split(", ", 1)[1])
    return answers.groupBy("batch").applyInPandas(total, SCORES)


def _shard(key: Column, shards: int) -> Column:
    """The unsigned key modulo ``shards``."""
    return F.pmod(F.pmod(key, F.lit(shards)) + F.when(key < 0, (1 << 64) % shards).otherwise(0), F.lit(shards)).cast("int")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity (log10 per word), threshold, kept."""
    trusted = trusted_ids(labels)
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select("doc_id", "lang", n_words.alias("n"), F.xxhash64("doc_id", F.lit("held")).alias("h")).filter("n > 0")
    rows = staged(rows.join(trusted, "doc_id", "left_semi"), "trusted")
    # Held out: a share by hash, and of each language the least hash. All others train.
    held = rows.filter(F.pmod("h", F.lit(HELD_OUT)) == 0).select("doc_id").union(rows.groupBy("lang").agg(F.min_by("doc_id", "h").alias("doc_id")).select("doc_id"))
    seen = staged(rows.select("doc_id").distinct().join(held, "doc_id", "left_anti"), "seen")
    if seen.count() <= SMALL:
        seen = F.broadcast(seen)
    tables = estimate(docs.select("doc_id", "text").join(seen, "doc_id", "left_semi").select("text"))
    none = F.lit(None).cast("double")
    if tables is None:
        n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
        return docs.select("doc_id", "lang", n.alias("n_words"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    few = tables.n_pairs <= TRUSTED
    scored = staged(perplexities(docs, collected(tables)) if few else sharded(docs, tables), "perplexities")
    unseen = scored.filter("n_words > 0").join(trusted, "doc_id", "left_semi").join(seen, "doc_id", "left_anti")
    per = F.col("nll") / F.col("n_words")
    middle = unseen.groupBy("lang").agg(F.percentile_approx(per, 0.5, 10000).alias("mid"))
    smooth = (F.col("nll") + PRIOR_WORDS * F.col("mid")) / (F.col("n_words") + PRIOR_WORDS)
    joined = lambda a, b: a.alias("a").join(b.withColumnRenamed("lang", "__l"), F.col("lang").eqNullSafe(F.col("__l")), "left").drop("__l")
    high = joined(unseen, middle).groupBy("lang").agg(F.first("mid").alias("mid"), F.percentile_approx(smooth, quantile, 10000).alias("q"))
    high = staged(high.select("lang", "mid", F.col("q").alias("threshold")), "thresholds")
    if high.count() <= 10_000:
        high = F.broadcast(high)
    out = joined(scored, high)
    return out.select(
        "doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, per).alias("perplexity"), "threshold",
        F.coalesce((F.col("n_words") == 0) | (smooth <= F.col("threshold")), F.lit(True)).alias("kept"),
    )


def op4_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)

"""LM scoring: a weighted backoff automaton over smoothed n-grams.

States are the root and each word seen as a history. An arc (state, word) exists
for each pair counted at least ``LEAST`` times in training; its weight is the
interpolated Witten-Bell probability. A state's failure arc leads to the root
with the state's backoff weight; the root has an arc for each training token and
one for all unknown words. A text is scored in one left-to-right traversal that
carries the state, takes the arc if there is one and else the failure arc, and
sums log10 probabilities.

The model grows with the corpus, so no process ever holds it whole. Documents
are dealt to blocks of bounded text size. A block asks the shards for the arcs
its own texts can take: its distinct (state, word) pairs with their training
counts, packed and sorted, one message for each shard. A shard sums the counts
of all blocks and answers which pairs are arcs, their counts and their states'
totals. The block then builds the part of the automaton that it needs and
traverses its texts. Pairs are sharded by state, so that a state's totals are
summed in one place; the few states that a large share of all tokens pass
through are sharded by word as well, and their partial totals, one row for each
shard, are added up separately.

Defined cases: a null text counts as empty and is its end token alone; a null
``doc_id`` never trains (its hash is null) and has ``held_out`` false; repeated rows
are counted as often as they occur; with no training tokens N and V are 0 and
the base formula still holds; an empty table gives an empty result; other input
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import Words, chain, hash_words, mix, shards_for, text_bytes

#: Characters of text in a block, about; pairs seen less often are no arcs; a
#: state that more than 1 / HOT of all tokens pass through is sharded by word.
BLOCK, LEAST, HOT = 9_000_000, 1, 2000
FOLD, HELD = 5, 1
#: The least state, so that its pairs come first in sorted order.
ROOT = np.uint64(0)
#: Within a state 48 bits tell words apart; the root's words keep all 64.
LOW = np.uint64((1 << 48) - 1)
END = hash_words(["\n"])[0]


def with_fold(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD
    # The identifier as a number and whether there is one: pandas would make doubles
    # of a column with nulls.
    id_ = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("no_id"), "text", F.coalesce(fold == HELD, F.lit(False)).alias("held_out"), fold.isNotNull().alias("known_fold"))


def hot_states(docs: DataFrame, sample: int = 40) -> np.ndarray:
    """Hashes of the states that many tokens pass through, by a sample.

    Only the sharding depends on it, no result. At most 2 * HOT + 2 of them: each
    holds a share of 1 / (2 * HOT) of the sample's tokens.
    """
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    words = F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")
    counts = some.select(F.explode(words).alias("w")).filter("w != ''").groupBy("w").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = [r["w"] for r in counts.filter(F.col("count") > total / (2 * HOT)).collect()] if total else []
    return np.sort(np.concatenate((hash_words(often), [ROOT, END])).astype(np.uint64))


class Block:
    """The distinct (state, word) pairs of a block of texts, in shard order."""

    def __init__(self, texts: list[str | None], train: np.ndarray, shards: int, hot: np.ndarray):
        words = Words(pa.array(texts, pa.large_string()), lower=True)
        n, d = len(words.ids), len(texts)
        # The stream of tokens: each text's words, then its end.
        at = words.ends + np.arange(d)
        self.first = words.starts + np.arange(d)
        vocab = np.concatenate((words.hashes, [END])).astype(np.uint64)
        ids = np.insert(words.ids, words.ends, len(vocab) - 1) if d else words.ids
        token = vocab[ids] if len(ids) else np.empty(0, np.uint64)
        state = np.empty_like(token)
        state[1:] = token[:-1]
        state[self.first] = END  # a text begins in the state that an end leads to
        self.counts = words.counts + 1
        self.last = at + 1
        weight = np.repeat(train, self.counts).astype(np.int64)
        uni, self.uni_of = np.unique(token, return_inverse=True)
        uni_c = np.bincount(self.uni_of, weights=weight, minlength=len(uni)).astype(np.int64)
        token = token & LOW
        key = chain(state, token)
        _, first, self.pair_of = np.unique(key, return_index=True, return_inverse=True)
        pair_c = np.bincount(self.pair_of, weights=weight, minlength=len(first)).astype(np.int64)
        self.n_uni = len(uni)
        ctx = np.concatenate((np.full(len(uni), ROOT), state[first]))
        word = np.concatenate((uni, token[first]))
        count = np.concatenate((uni_c, pair_c))
        by_word = np.isin(ctx, hot)
        shard = np.where(by_word, chain(ctx, word), mix(ctx)) % np.uint64(shards)
        order = np.lexsort((word, ctx, shard))
        self.order, self.ctx, self.word, self.count = order, ctx[order], word[order], count[order]
        bounds = np.searchsorted(shard[order], np.arange(shards + 1).astype(np.uint64))
        self.parts = [(s, slice(int(a), int(b))) for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]


def _runs(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values."""
    start = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    return start, np.diff(np.concatenate((start, [len(ctx)])))


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *[a.tobytes() for a in arrays]])


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _rising(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as their steps, byte by byte, which compresses better."""
    step = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).reshape(-1)


def _risen(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).reshape(-1).view("<u8"), dtype=np.uint64)


def _small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in one byte, and those that need more apart."""
    return np.where(x > 254, 255, x).astype("u1"), x[x > 254].astype("<u8")


def _whole(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def _pack_pairs(ctx: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    """States once each, the root's words whole, the others' in 6 bytes."""
    start, n = _runs(ctx)
    roots = int(n[0]) if len(ctx) and ctx[0] == ROOT else 0
    rest = word[roots:]
    return _pack(_rising(ctx[start]), *_small(n), _rising(word[:roots]), rest.astype("<u4"), (rest >> np.uint64(32)).astype("<u2"), *_small(count))


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ctx, n, n_large, roots, low, high, c, c_large = _unpack(data, "u1", "u1", "<u8", "u1", "<u4", "<u2", "u1", "<u8")
    word = np.concatenate((_risen(roots), low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))))
    return np.repeat(_risen(ctx), _whole(n, n_large)), word, _whole(c, c_large)


ASK = "shard int, block int, data binary"
#: An answer to a block, or (block -1) a shard's partial totals of a hot state.
ANSWER = "block int, shard int, state binary, types long, total long, data binary"


def _ask(shards: int, hot: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf["text"].tolist(), (~pdf["held_out"] & pdf["known_fold"]).to_numpy(), shards, hot)
        rows = []
        for s, part in block.parts:
            rows.append((s, int(pdf["block"].iloc[0]), _pack_pairs(block.ctx[part], block.word[part], block.count[part])))
        return pd.DataFrame(rows, columns=["shard", "block", "data"])

    return run


def _answer(hot: np.ndarray):
    """A shard: sums the pairs of all blocks and answers each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = [_unpack_pairs(data) for data in pdf["data"]]
        ctx, word = np.concatenate([a[0] for a in asks]), np.concatenate([a[1] for a in asks])
        key = chain(ctx, word)
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(of, weights=np.concatenate([a[2] for a in asks])).astype(np.int64)
        pair_ctx = ctx[first]
        arc = total >= np.where(pair_ctx == ROOT, 1, LEAST)
        # Types and totals of the states, over their arcs.
        states, state_of = np.unique(pair_ctx, return_inverse=True)
        types = np.bincount(state_of, weights=arc).astype(np.int64)
        sums = np.bincount(state_of, weights=np.where(arc, total, 0)).astype(np.int64)
        rows, at = [], 0
        shard = int(pdf["shard"].iloc[0])
        for block, (c, _, _) in zip(pdf["block"], asks, strict=True):
            mine = of[at : at + len(c)]
            at += len(c)
            start, _ = _runs(c)
            st = state_of[mine[start]]
            data = _pack(np.packbits(arc[mine]), *_small(total[mine][arc[mine]]), types[st].astype("<u4"), sums[st].astype("<u8"))
            rows.append((int(block), shard, None, 0, 0, data))
        is_hot = np.isin(states, hot)
        for s, t, n in zip(states[is_hot], types[is_hot], sums[is_hot], strict=True):
            rows.append((-1, shard, s.tobytes(), int(t), int(n), None))
        return pd.DataFrame(rows, columns=["block", "shard", "state", "types", "total", "data"])

    return run


SCORED = "id long, no_id boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shards: int, hot: np.ndarray):
    """A block: its part of the automaton, and the traversal of its texts."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c.split()[0]: [] for c in SCORED.split(", ")})
        block = Block(docs["text"].tolist(), (~docs["held_out"] & docs["known_fold"]).to_numpy(), shards, hot)
        by_shard = {int(r.shard): r.data for r in answers[answers["data"].notna()].itertuples()}
        state_rows = answers[answers["state"].notna()]
        hot_of = {bytes(s): (int(t), int(n)) for s, t, n in zip(state_rows["state"], state_rows["types"], state_rows["total"], strict=True)}
        m = len(block.ctx)
        count, types, total = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for s, part in block.parts:
            bits, arcs, arcs_large, t, n = _unpack(by_shard[s], "u1", "u1", "<u8", "<u4", "<u8")
            size = part.stop - part.start
            arc = np.unpackbits(bits, count=size).astype(bool)
            own = np.zeros(size, np.int64)
            own[arc] = _whole(arcs, arcs_large)
            count[part] = own
            start, run_len = _runs(block.ctx[part])
            types[part], total[part] = np.repeat(t, run_len), np.repeat(n, run_len)
        for s in np.unique(block.ctx[np.isin(block.ctx, hot)]):
            at = block.ctx == s
            types[at], total[at] = hot_of.get(s.tobytes(), (0, 0))
        v_all, n_all = hot_of.get(ROOT.tobytes(), (0, 0))
        # Back from shard order to the pairs' own order.
        back = np.empty(m, np.int64)
        back[block.order] = np.arange(m)
        c_uni, pairs = count[back[: block.n_uni]], back[block.n_uni :]
        root = np.log10((c_uni + 0.5) / (n_all + 0.5 * (v_all + 1)))
        # The traversal: at each token the arc of the state it is in, else the
        # failure arc and the root's arc.
        low = root[block.uni_of]
        c, t, n = count[pairs][block.pair_of], types[pairs][block.pair_of], total[pairs][block.pair_of]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(n > 0, np.log10((c + t * 10.0**low) / (n + t)), low)
            fail = np.where(n > 0, np.log10(t / (n + t)), 0.0) + low
        step = np.where(c > 0, step, fail)
        add = lambda x: np.add.reduceat(x, block.first)
        return pd.DataFrame(
            {
                "id": docs["id"].to_numpy(),
                "no_id": docs["no_id"].to_numpy(),
                "held_out": docs["held_out"].to_numpy(),
                "n_tokens": block.counts,
                "n_known": add((c_uni[block.uni_of] > 0).astype(np.int64)),
                "train_tokens": np.full(len(docs), n_all),
                "base_score": add(low),
                "score": add(step),
            }
        )

    return run


def score(docs: DataFrame, block_chars: int = BLOCK) -> DataFrame:
    """doc_id and the rest of SCORED, one row per document."""
    blocks = shards = shards_for(text_bytes(docs), block_chars, 4)
    hot = hot_states(docs)
    block = F.pmod(F.xxhash64("id", "no_id", "text"), F.lit(blocks)).cast("int")
    dealt = with_fold(docs).withColumn("block", block).repartition(blocks, "block")
    asks = dealt.groupBy("block").applyInPandas(_ask(shards, hot), ASK)
    answers = asks.groupBy("shard").applyInPandas(_answer(hot), ANSWER)
    # Partial totals of the hot states, added up and sent to every block.
    states = answers.filter("block < 0").groupBy("state").agg(F.sum("types").alias("types"), F.sum("total").alias("total"))
    states = states.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).alias("shard"), "state", "types", "total", F.lit(None).cast("binary").alias("data"))
    all_ = answers.filter("block >= 0").unionByName(states)
    scored = dealt.groupBy("block").cogroup(all_.groupBy("block")).applyInPandas(_score(shards, hot), SCORED)
    return scored.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *[c for c in scored.columns if c not in ("id", "no_id")])


def op3_lm_scoring(docs: DataFrame) -> DataFrame:
    return score(docs)

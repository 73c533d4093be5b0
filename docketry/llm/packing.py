"""Best-fit packing of tokenised documents into sequences of bounded length.

Lengths are integers up to the sequence's capacity, so a corpus of any size is a
histogram of at most ``capacity`` classes. ``plan`` solves that histogram on the
driver: a Martello-Toth dominance reduction first fixes sequences that provably
belong to some optimal packing, class by class, and best-fit decreasing packs
what is left. Both work on whole classes with multiplicities, so the plan's size
depends on the capacity and not on the corpus. Pieces then take the plan's slots
by their rank in their length class, which is counted per bucket and summed, so
no class is ever in one task.

Tokenisation runs in Arrow batches: a batch is split at white space, and only
words that the worker has not met are tokenised (none of this tokenizer's tokens
holds white space); the memory of known words is bounded.

Defined cases: a null or empty text is a document of one token, id 1; repeated
rows are packed as often as they occur; an empty table gives an empty result; a
null ``doc_id`` is kept; other input columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import Words, as_array, staged

CAPACITY, END_ID = 4096, 1

# --- the plan -----------------------------------------------------------------


def _pair_sum(sizes: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum within ``room`` of two pieces; ``counts`` by size."""
    s = sizes[sizes < room]
    if not len(s):
        return 0
    at = np.searchsorted(s, np.minimum(room - s, s), side="right") - 1
    # The same class twice needs two pieces of it.
    at = np.where((at == np.arange(len(s))) & (counts[s] < 2), at - 1, at)
    ok = at >= 0
    return int((s[ok] + s[at[ok]]).max()) if ok.any() else 0


def dominance(hist: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed (pattern, multiplicity) and the histogram that is left.

    For the largest piece: alone, if nothing fits beside it; with the largest
    piece that fits, if no two pieces that fit together are larger in sum. Each
    such set dominates every other that holds the largest piece.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in hist.items():
        counts[size] = n
    fixed: list[tuple[tuple[int, ...], int]] = []
    for lead in sorted(hist, reverse=True):
        room = capacity - lead
        while counts[lead]:
            counts[lead] -= 1  # one of them leads; the others may go beside it
            sizes = np.flatnonzero(counts[: room + 1])
            best = int(sizes[-1]) if len(sizes) else 0
            dominated = _pair_sum(sizes, counts, room) <= best
            counts[lead] += 1
            if not dominated:
                break
            if not best:
                times = int(counts[lead]) if lead > room else 1
                fixed.append(((lead,), times))
                counts[lead] -= times
                continue
            times = int(counts[lead]) // 2 if best == lead else int(min(counts[lead], counts[best]))
            fixed.append(((lead, best), times))
            counts[lead] -= times
            counts[best] -= times
    return fixed, {int(k): int(counts[k]) for k in np.flatnonzero(counts)}


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over classes: (pattern, multiplicity)."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: set[int] = set()
    for size in sorted(hist, reverse=True):
        n = hist[size]
        while n:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                per = min(capacity // size, n)
                whole = n // per
                put = [(tuple([size] * per), whole)]
                if n - whole * per:
                    put.append((tuple([size] * (n - whole * per)), 1))
                for pattern, m in put:
                    r = capacity - sum(pattern)
                    bins[r].append((pattern, m))
                    rooms.add(r)
                n = 0
                continue
            pattern, m = bins[room].pop()
            k = min(m, n)
            if m > k:
                bins[room].append((pattern, m - k))
            if not bins[room]:
                rooms.discard(room)
            r = room - size
            bins[r].append(((*pattern, size), k))
            rooms.add(r)
            n -= k
    return [x for group in bins.values() for x in group]


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = dominance(hist, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first_rank, last_rank, per_sequence, first_sequence, offset).

    The ranks of a class from first to last go, ``per_sequence`` at a time, to
    consecutive sequences, one after another from ``offset`` on.
    """
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            per = pattern.count(size)
            out.append((size, used[size], used[size] + per * times - 1, per, sequence, offset))
            used[size] += per * times
            offset += per * size
        sequence += times
    return out


# --- tokens -------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + n) for n, x in enumerate(rest)}


class WordTokens:
    """Token ids of white-space words; their pieces are remembered until there are more than ``most``.

    Words of Latin letters, digits and ASCII marks are cut as the tokenizer's
    own rules cut them and handed to its BPE model piece by piece, as the pieces
    repeat far more than the words; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False, most: int = 300_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        self.model = self.tokenizer.model
        self.most = most
        self.parts: dict[str, list[int]] = {}
        # The tokenizer's pre-token pattern.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"(?:[!-~À-įı-ɏ](?<!<\|))+").fullmatch
        self.letters = str.maketrans({chr(k): v for k, v in _byte_letters().items()})

    def _part(self, piece: str) -> list[int]:
        ids = self.parts.get(piece)
        if ids is None:
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            self.parts[piece] = ids
        return ids

    def _word(self, word: str) -> list[int]:
        if word.isascii() and word[:-1].isalpha():  # letters, or letters and one mark
            if word.isalpha():
                return self._part(word.lower())
            return self._part(word[:-1].lower()) + self._part(word[-1])
        if word.isalpha() and self.plain(word):
            return self._part(word.lower())
        if not self.plain(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        pieces = self.cut(word.lower())
        return self._part(pieces[0]) if len(pieces) == 1 else [i for x in pieces for i in self._part(x)]

    def __call__(self, vocab: np.ndarray) -> list[list[int]]:
        # By what is held, not by what may come: a batch alone has some 200,000 words.
        if len(self.parts) > self.most:
            self.parts.clear()
        return [self._word(w) for w in vocab]


_TOKENS: dict[tuple[str, bool], WordTokens] = {}


def word_tokens(path: str, encode_special_tokens: bool) -> WordTokens:
    """One per worker process."""
    key = (path, encode_special_tokens)
    if key not in _TOKENS:
        _TOKENS[key] = WordTokens(path, encode_special_tokens)
    return _TOKENS[key]


def token_ids(texts: pa.Array, tokens: WordTokens) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and the end of each text's ids, its end token included."""
    words = Words(texts, lower=False)
    per = tokens(words.vocab)
    sizes = np.fromiter(map(len, per), dtype=np.int64, count=len(per))
    pool = np.fromiter(chain.from_iterable(per), dtype=np.uint32, count=int(sizes.sum()))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else np.empty(0, np.int64)
    n = sizes[words.ids] if len(words.ids) else np.empty(0, np.int64)
    # Gather the ids of every word: word start + position in the word.
    ends = np.cumsum(n)
    flat = np.repeat((starts[words.ids] if len(n) else n) - (ends - n), n) + np.arange(int(n.sum()))
    ids = pool[flat]
    upto = np.concatenate(([0], ends))
    out = np.insert(ids, upto[words.ends], np.uint32(END_ID))
    return out, upto[words.ends] + np.arange(1, len(words.ends) + 1)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, encode_special_tokens: bool = False, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; ``with_ids`` adds the token ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path, encode_special_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, ends = token_ids(as_array(part.column("text")), tokens)
                ids = ids.astype("<u4")
                doc = part.column("doc_id").to_pylist()
                rows: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                first = 0
                for d, end in zip(doc, ends.tolist(), strict=True):
                    for k, a in enumerate(range(first, end, capacity)):
                        b = min(end, a + capacity)
                        chunk = ids[a:b]
                        for c, v in zip(rows, (d, k, a - first, b - a, zlib.crc32(chunk.tobytes()), chunk if with_ids else None), strict=True):
                            rows[c].append(v)
                    first = end
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                made = {c: pa.array(rows[c], k) for c, k in zip(rows, kinds, strict=True) if with_ids or c != "ids"}
                yield pa.RecordBatch.from_pydict(made)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# --- over a table -------------------------------------------------------------

#: Pieces that one bucket of a length class holds, about.
BUCKET = 1 << 13


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (PIECES and ``row``, staged) with sequence_id and offset."""
    spark = found.sparkSession
    full = found.filter(F.col("length") == capacity)
    total = found.count()
    buckets = max(1, -(-total // BUCKET))
    cell = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")
    part = found.filter(F.col("length") < capacity).withColumn("bucket", cell)
    per = part.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row for each length and bucket: the rank at which a bucket begins.
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = per.withColumn("begin", F.coalesce(F.sum("n").over(by_length), F.lit(0)))
    # At most ``capacity`` rows come to the driver.
    hist = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = plan(hist, capacity)
    table = slots(patterns)
    schema = "length long, lo long, hi long, per long, sequence long, off long"
    # The plan has a few rows for each of at most ``capacity`` lengths.
    table = F.broadcast(spark.createDataFrame(table, schema))
    used = sum(m for _, m in patterns)
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = part.withColumn("r", rank).join(begins.drop("n"), ["length", "bucket"]).withColumn("r", F.col("r") + F.col("begin"))
    within = (ranked["length"] == table["length"]) & ranked["r"].between(table["lo"], table["hi"])
    nth = F.col("r") - F.col("lo")
    placed = ranked.join(table, within).select(
        *[ranked[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("off") + (nth % F.col("per")) * ranked["length"]).cast("long").alias("offset"),
    )
    whole = full.select(
        *[c.split()[0] for c in PIECES.split(", ")],
        (F.lit(used) + F.monotonically_increasing_id()).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    # Numbered as they are written, so rows that repeat are dealt to buckets too.
    return pack(staged(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)


def op5_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)

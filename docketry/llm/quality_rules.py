"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` derives the counts of a text with built-in functions only;
``verdict`` compiles the rows of ``RULES`` into one boolean column. Nothing is
shuffled: each row is judged on its own.

Defined cases: a null text counts as empty (no words, all counts 0, fails the
length rule); repeated rows are judged one by one; an empty table gives an
empty result; a null ``doc_id`` is kept as it is. Input columns never clash with
the derived ones: every intermediate lives in one struct column of its own, and
``apply_rules`` fails early if the input already has a column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import GAP, WORD, text_or_empty

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Very common words of the four languages.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "auf auch das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "con de del el en es la las lo los no para por que se su un una y"
).split()
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; None leaves that side open."""

    name: str
    measure: str
    low: float | None
    high: float | None
    #: Only texts of at least this many words are held to the rule.
    from_words: int = 0


#: The verdict's thresholds. They are wide: a rule rejects what no prose does.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words", 50, None),
    Rule("repeated_words", "repeat_ratio", None, 0.5),
    Rule("short_words", "mean_word", 2.0, None),
    Rule("long_words", "mean_word", None, 20.0),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("stop_words", "stop_ratio", 0.002, None, from_words=300),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's variable.

    A plain column that is used in a lambda would be computed again for each
    element, as the optimizer merges the projections.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _marks(words: Column) -> Column:
    """A hash of each 3-word window."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def _repeat_words(marks: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def covered(runs: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(runs, at)["h"] == x["h"], F.lit(False))
        twins = F.filter(runs, lambda x, j: same(x, j - 1) | same(x, j + 1))
        spread = F.flatten(F.transform(twins, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(spread))

    runs = F.sort_array(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(marks)) < F.size(marks), _let(runs, covered)).otherwise(0)


def measures(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Add struct ``out``: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words of each text."""
    if out in docs.columns:
        raise ValueError(f"the input already has a column {out!r}")
    t = text_or_empty(text)
    words = F.filter(F.split(t, GAP), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _let(_marks(w), _repeat_words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        n = F.size(x).cast("long")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    def joined(w: Column) -> Column:
        return _let(
            _let(lines, of_lines),
            lambda x: F.struct(
                w["n_words"].alias("n_words"),
                F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                x["n_lines"].alias("n_lines"),
                x["n_dup_lines"].alias("n_dup_lines"),
                w["n_repeat_words"].alias("n_repeat_words"),
                w["n_stop_words"].alias("n_stop_words"),
            ),
        )

    return docs.withColumn(out, _let(_let(words, of_words), joined))


def verdict(q: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule is broken."""
    per = lambda a, b: F.coalesce(q[a] / F.when(q[b] > 0, q[b]), F.lit(0.0))
    value = {
        "n_words": q["n_words"].cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stop_ratio": per("n_stop_words", "n_words"),
    }
    ok = F.lit(True)
    for r in rules:
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (value[r.measure] < r.low)
        if r.high is not None:
            broken = broken | (value[r.measure] > r.high)
        ok = ok & ~(broken & (q["n_words"] >= r.from_words))
    return ok


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with struct ``out`` of the measures, ``base_failed`` and ``kept``."""
    m = measures(docs, text, out)

    def judged(q: Column) -> Column:
        fields = [q[f.name].alias(f.name) for f in m.schema[out].dataType.fields]
        return F.struct(*fields, base_failed(q).alias("base_failed"), (~base_failed(q) & verdict(q, rules)).alias("kept"))

    return m.withColumn(out, _let(F.col(out), judged))


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    judged = apply_rules(docs.select("doc_id", "text")).select("doc_id", F.explode(F.array("quality")).alias("q"))
    return judged.select("doc_id", *[F.col("q")[n].alias(n) for n in names])


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () rid, coalesce(text, '') t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) l FROM d),
x AS (SELECT rid, unnest(w) word, generate_subscripts(w, 1) i FROM w),
g AS (SELECT rid, i, word, lead(word, 1) OVER p w2, lead(word, 2) OVER p w3 FROM x WINDOW p AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) n FROM g WHERE w3 IS NOT NULL),
r AS (SELECT rid, count(DISTINCT p) n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) p FROM c WHERE n > 1) GROUP BY rid),
s AS (SELECT rid, count(*) n_stop FROM x WHERE lower(word) IN ({_STOP_SQL}) GROUP BY rid),
f AS (SELECT doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, len(l) n_lines,
  coalesce(n_repeat, 0) n_repeat_words, coalesce(n_stop, 0) n_stop FROM w LEFT JOIN r USING (rid) LEFT JOIN s USING (rid))
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 20.0
    AND n_symbols / n_words <= 0.3 AND n_dup_lines / greatest(n_lines, 1) <= 0.5
    AND NOT (n_words >= 300 AND n_stop / n_words < 0.002) kept
FROM f
"""

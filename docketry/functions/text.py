"""Text expressions, all JVM-side.

Patterns carry ``(?iuUd)`` where letters, digits, white space and line ends are
meant in their Unicode sense.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns.
SEARCH_STOP = ["a", "an", "and", "for", "of", "the", "to"]
TOPIC_STOP = "a an and are as at be by for from in is of on or the to with".split()
GENERIC = "access change discussion document radio system study mode update".split()
TOKEN = "[a-z0-9]+(?:[-#][a-z0-9]+)*"
ORG_TAIL = r",(?!\s*(?:Inc|Ltd|Limited|Corp|Corporation|Co|LLC)\b)"
LIST_MARK = r"(?m)^\s*([-•*]|\d+[.)]|Option\s+\d+\s*[:.)])\s+"
SENTENCE_END = r"(?<=[.!?])(?=\s+(?:[\"'“‘(]*[A-Z0-9]))"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, bound as a lambda variable."""
    return F.get(F.transform(F.array(value), body), 0)


# --- search tokens ------------------------------------------------------------


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def expand_token(token: Column) -> Column:
    """The token, then its hyphen parts, then its hash parts."""
    parts = lambda mark: F.when(F.contains(token, F.lit(mark)), F.split(token, mark)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(token), parts("-"), parts("#"))


def tokenize(text: Column, stop: list[str] = SEARCH_STOP) -> Column:
    """Search tokens with compound parts, repeats included, stop words removed."""
    spread = F.flatten(F.transform(raw_tokens(text), expand_token))
    return F.filter(spread, lambda x: (x != "") & ~x.isin(stop))


def parse_query(query: str, stop: list[str] = SEARCH_STOP) -> tuple[list[list[str]], list[str]]:
    """Quoted phrases as token lists, and the tokens of the whole query."""
    import re

    def cut(text: str) -> list[str]:
        out = []
        for t in re.findall(TOKEN, text.casefold()):
            out += [t, *(t.split("-") if "-" in t else []), *(t.split("#") if "#" in t else [])]
        return [x for x in out if x and x not in stop]

    return [p for p in map(cut, re.findall(r'"([^"]+)"', query)) if p], list(dict.fromkeys(cut(query.replace('"', " "))))


def contains_phrase(tokens: Column, phrase: list[str]) -> Column:
    """Whether ``phrase`` is a contiguous run of ``tokens``."""
    want, n = F.array(*map(F.lit, phrase)), len(phrase)
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    return (F.size(tokens) >= n) & F.exists(starts, lambda i: F.slice(tokens, i + 1, n) == want)


# --- normal forms -------------------------------------------------------------


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def meaningful_tokens(text: Column, stop: list[str] = TOPIC_STOP) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_text(text), " "), lambda x: (x != "") & ~x.isin(stop)))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def surface(text: Column) -> Column:
    """Collapsed lower-case form; input is taken to be NFC already."""
    return F.lower(collapse(text))


def normalized_term(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def first_seen(values: Column) -> Column:
    """Distinct by lower case; each keeps its first spelling and place."""
    keys = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def split_organizations(raw: Column) -> Column:
    """Names between semicolons, line ends and commas that no legal form follows."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), f"(?i){ORG_TAIL}", "\u0001"), "[;\r\n]", "\u0001")
    return first_seen(F.filter(F.transform(F.split(marked, "\u0001"), collapse), lambda x: x != ""))


def exact_variants(value: Column) -> Column:
    """Collapsed spellings: as is and lower, with hyphens as spaces or two words hyphened."""
    base = collapse(value)
    two = F.size(F.split(base, " ")) == 2
    other = F.when(F.contains(base, F.lit("-")), F.regexp_replace(base, "-", " ")).when(two, F.regexp_replace(base, " ", "-")).otherwise(base)
    return F.array_sort(F.array_distinct(F.array(base, F.lower(base), other, F.lower(other))))


def phrase_pattern(phrase: str) -> str:
    """Words of ``phrase`` with hyphens or spaces between, not inside other words."""
    import re

    words = re.findall(r"[A-Za-z0-9]+", phrase)
    return rf"(?i)(?<![A-Za-z0-9]){r'[-\s]+'.join(words)}(?![A-Za-z0-9])"


def strip_joined_suffix(value: Column, heads: list[str]) -> Column:
    """Remove an organisation's head that is glued to the end of the last word."""
    out = value
    for head in sorted(heads, key=len):  # the longest is tried first
        n = len(head)
        before = F.substring(value, F.greatest(F.length(value) - n, F.lit(1)), F.lit(1))
        glued = (F.length(value) > n) & F.endswith(F.lower(value), F.lit(head.lower())) & before.rlike("[A-Za-z0-9]")
        out = F.when(glued, F.rtrim(F.substring(value, F.lit(1), F.length(value) - n))).otherwise(out)
    return out


# --- spans --------------------------------------------------------------------


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, literal>> of all matches, in code points.

    The lengths of the gaps and of the matches add up to the offsets.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(pair: Column) -> Column:
        m, g = pair["m"], pair["g"]
        total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
        return F.transform(
            m,
            lambda x, i: let(
                total(g, i + 1) + total(m, i),
                lambda at: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("literal")),
            ),
        )

    return let(F.struct(found.alias("m"), gaps.alias("g")), place)


def snippet(text: Column, terms: list[str], limit: int = 240, lead: int = 60) -> Column:
    """A window from ``lead`` before the first term, marked where it is cut."""
    low = F.lower(text)
    found = [F.when(F.instr(low, t) > 0, F.instr(low, t) - 1) for t in terms]
    first = F.least(*found) if len(found) > 1 else found[0]
    start = F.greatest(F.coalesce(first, F.lit(0)) - lead, F.lit(0))
    cut = F.substring(text, start + 1, F.lit(limit))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(F.length(text) > start + limit, "…").otherwise(""))


SEGMENT = "array<struct<start:int,end:int,literal:string,reason:string,parent:int>>"


def segments(text: Column) -> Column:
    """array<struct<start, end, literal, reason, parent>> with exact offsets.

    With two or more list marks: the text before the first (whole) and the items
    (option, number, list_item), whose parent is the place of that text; items
    begin at their line. Else sentences if there are two or more, else the whole
    text. Ends are trimmed.
    """
    t = F.coalesce(text, F.lit(""))

    def struct(start: Column, literal: Column, reason: Column, parent: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(literal)).cast("int").alias("end"), literal.alias("literal"), reason.alias("reason"), parent.alias("parent"))

    def trimmed(at: Column, part: Column, reason: str) -> Column:
        body = F.regexp_replace(part, r"^\s+", "")
        return struct((at + F.length(part) - F.length(body)).cast("int"), F.regexp_replace(body, r"\s+$", ""), F.lit(reason), F.lit(None).cast("int"))

    none = F.array().cast(SEGMENT)
    # The offset is carried from part to part.
    def placed(parts: Column, one) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x)).cast("int").alias("at"), F.concat(acc["out"], F.array(one(acc["at"], x))).alias("out"))
        return F.aggregate(parts, start, step, lambda acc: acc["out"])

    def item(has_head: Column):
        def one(at: Column, part: Column) -> Column:
            mark = F.regexp_extract(part, LIST_MARK, 1)
            reason = F.when(F.lower(mark).startswith("option"), "option").when(mark.rlike("^[0-9]"), "number").otherwise("list_item")
            return struct(at, F.regexp_replace(part, r"\s+$", ""), reason, F.when(has_head, 0))

        return one

    def listed(spans_: Column) -> Column:
        first = spans_[0]["start"]
        head = F.substring(t, F.lit(1), first)
        has_head = F.length(F.trim(F.regexp_replace(head, r"\s+", " "))) > 0
        stops = F.concat(F.transform(F.slice(spans_, 2, F.size(spans_)), lambda x: x["start"]), F.array(F.length(t)))
        parts = F.zip_with(spans_, stops, lambda x, stop: F.struct(x["start"].alias("start"), F.substring(t, x["start"] + 1, stop - x["start"]).alias("s")))
        items = F.transform(parts, lambda x: item(has_head)(x["start"], x["s"]))
        return F.concat(F.when(has_head, F.array(trimmed(F.lit(0), head, "whole"))).otherwise(none), items)

    filled = lambda xs: F.filter(xs, lambda x: x["literal"] != "")
    sentences = filled(placed(F.split(t, SENTENCE_END, -1), lambda at, x: trimmed(at, x, "sentence")))
    plain = let(sentences, lambda s: F.when(F.size(s) >= 2, s).otherwise(filled(F.array(trimmed(F.lit(0), t, "whole")))))
    return F.when(F.regexp_count(t, F.lit(LIST_MARK)) >= 2, let(spans(t, LIST_MARK), listed)).otherwise(plain)


# --- block renderings: four different ones, not to be shared ---------------------


def _row_text(rows: Column, cell_sep: str, row_sep: str) -> Column:
    cells = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), cell_sep)
    return F.array_join(F.transform(rows, cells), row_sep)


def search_text(text: Column, rows: Column) -> Column:
    """The text, then the rows, tab and line joined, empty ones dropped."""
    cells = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t"))
    every = F.concat(F.array(F.coalesce(text, F.lit(""))), F.coalesce(cells, F.array().cast("array<string>")))
    return F.array_join(F.filter(every, lambda x: x != ""), "\n")


def evidence_text(text: Column, rows: Column) -> Column:
    """The rows if there are any, else the text."""
    return F.when(F.size(F.coalesce(rows, F.array().cast("array<array<string>>"))) > 0, _row_text(rows, "\t", "\n")).otherwise(F.coalesce(text, F.lit("")))


def topic_text(text: Column, rows: Column) -> Column:
    """The text if there is any, else the rows, cells that read 0 blanked."""
    blank = F.transform(rows, lambda r: F.transform(r, lambda c: F.when(c == "0", "").otherwise(F.coalesce(c, F.lit("")))))
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce(_row_text(blank, "\t", "\n"), F.lit("")))


def report_text(text: Column, rows: Column) -> Column:
    """The text, or the rows with barred cells."""
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce(_row_text(rows, " | ", "\n"), F.lit("")))


# --- identities -----------------------------------------------------------------


def digest(length: int = 64, **fields: Column) -> Column:
    """SHA-256 over canonical JSON: the fields in order of their names, nulls kept."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.substring(F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256), 1, length)


#: Fields that say when something was seen and not what it is.
VOLATILE = ("discovered_at", "retrieved_at", "extracted_at")


def logical(columns: list[str], volatile: tuple[str, ...] = VOLATILE) -> Column:
    """The digest of a row without its volatile columns."""
    return digest(**{c: F.col(c) for c in columns if c not in volatile})


def locator(**parts: Column) -> Column:
    """Where a passage is, for a reader: "name value; ..." of the parts that there are."""
    return F.concat_ws("; ", *[F.concat(F.lit(k.replace("_", " ") + " "), v.cast("string")) for k, v in parts.items()])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def re_tokens(text: str) -> list[str]:
    """The tokens of a request's own text, on the driver."""
    import re

    return re.findall("[a-z0-9]+", text.casefold())

"""Shared pieces of the oracle SQL."""

from __future__ import annotations

from docketry.functions import text as T

STOP = "[" + ", ".join(f"'{w}'" for w in T.SEARCH_STOP) + "]"

#: Non-blank lines of the documents, by position.
BLOCKS = """lines AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents),
blocks AS (SELECT * FROM (SELECT doc_id, source, lang, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM lines) WHERE trim(text) <> '')"""


def tokens(expr: str) -> str:
    raw = f"regexp_extract_all(lower({expr}), '{T.TOKEN}')"
    parts = lambda m: f"CASE WHEN contains(x, '{m}') THEN string_split(x, '{m}') ELSE [] END"
    spread = f"flatten(list_transform({raw}, lambda x: [x] || {parts('-')} || {parts('#')}))"
    return f"list_filter({spread}, lambda y: y <> '' AND NOT list_contains({STOP}, y))"


TOKENS = BLOCKS + f""",
toks AS (SELECT doc_id, source, lang, pos, text, {tokens('text')} AS tokens FROM blocks)"""

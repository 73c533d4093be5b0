"""Personal data: a semi-Markov conditional random field over candidate segments.

A text's candidate segments are whole spans of at most ``MAX_SPAN`` characters
that begin and end at plausible boundaries. Each is scored as a whole for each
type by features of the span and its context (``features``). The weights are those
of a conditional random field: ``train`` climbs the log-likelihood of generated
sentences whose entities are known, with the sum over all segmentations and the
expected features from a forward and a backward pass over the candidates (seeded,
bounded, the same in every run). ``decode`` chooses boundaries and types jointly: a
dynamic program in which a segment of a type ends at each candidate's end or the
position is outside. Entities are bounded, so a text costs time in proportion to
its candidates.

The base spans are exact patterns of the contract and always stay; the decoder
adds spans that touch none of them.

Defined cases: a null text counts as empty; offsets are code points, end
exclusive; repeated rows give repeated results; an empty table gives an empty
result; a null ``doc_id`` is kept; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn")
#: Types that a spelt-out address and a numeric span can be; cards and addresses
#: of machines are wholly given by their base patterns.
SPOKEN_KINDS, NUMBER_KINDS = ("email",), ("phone", "ssn")
MAX_SPAN = 64
#: Groups of digits in a numeric span, at most.
GROUPS = 5
#: A segment must beat the outside by this much.
MARGIN = 0.5

# --- base spans ---------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


# --- candidate segments and their features ------------------------------------

_NUMBERY = re.compile(r"[(+]?[0-9](?:[-0-9(). ]*[0-9])?")
_SPOKEN = re.compile(r"[A-Za-z0-9._%+-]{1,30} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,20}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,12}){1,3}")
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,12}")
_CUE = re.compile(r"[A-Za-z]+")
#: Words before a span that speak for a type.
CUES = {
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell"},
    "ssn": {"ssn", "social", "security"},
    "email": {"email", "mail", "contact", "write"},
    "card": {"card", "visa", "mastercard", "credit"},
    "ip": {"ip", "address", "host", "server"},
}


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be entities: numeric runs and their sub-runs by group, and
    spelt-out addresses."""
    found = set()
    for m in _NUMBERY.finditer(text):
        cuts = [m.start()] + [m.start() + i for i, c in enumerate(m[0]) if i and m[0][i - 1] in " " and c in "(+0123456789"]
        ends = [c - 1 for c in cuts[1:]] + [m.end()]
        for k, a in enumerate(cuts):
            for b in ends[k : k + GROUPS]:
                if 7 <= b - a <= MAX_SPAN:
                    found.add((a, b))
    if "at)" in text or "at]" in text:
        for m in _SPOKEN.finditer(text):
            # A sentence may end right after an address: each part of the host may be
            # the last one.
            host = m.start() + max(m[0].find("at)"), m[0].find("at]")) + 3
            found.update((m.start(), d.end()) for d in _DOT.finditer(text, host, m.end()) if d.end() - m.start() <= MAX_SPAN)
    return sorted(found)


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span and of the words around it."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    shape = re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}", re.sub(r"[A-Za-z]+", "a", s))
    out = ["bias", f"digits={min(len(digits), 20)}", f"shape={shape[:24]}"]
    if len(digits) >= 13:
        out.append(f"luhn={luhn(digits)}")
    before = text[max(0, start - 1) : start]
    after = text[end : end + 1]
    out.append(f"edge={before.isalnum()}{after.isalnum()}")
    words = {w.lower() for w in _CUE.findall(text[max(0, start - 24) : start])}
    out += [f"cue={kind}" for kind, cues in CUES.items() if words & cues]
    if "(at)" in s or "[at]" in s:
        out.append("spoken")
    return out


# --- decoding -----------------------------------------------------------------

Weights = dict[tuple[str, str], float]


def _scored(text: str, weights: Weights, spans: list[tuple[int, int]]) -> list[tuple[int, int, list[str], list[tuple[str, float]]]]:
    """Candidates by end: (end, start, features, score of each type)."""
    out = []
    for a, b in spans:
        feats = features(text, a, b)
        kinds = SPOKEN_KINDS if "spoken" in feats else NUMBER_KINDS
        out.append((b, a, feats, [(k, sum(weights.get((k, f), 0.0) for f in feats)) for k in kinds]))
    return sorted(out, key=lambda x: x[:2])


def decode(text: str, weights: Weights, spans: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """The best labelled segmentation: weighted non-overlapping segments.

    ``best[i]`` is the best score of the candidates that end among the first i;
    outside positions score 0, so only segments move the sum.
    """
    scored = []
    for b, a, _, of in _scored(text, weights, candidates(text) if spans is None else spans):
        kind, score = max(of, key=lambda x: (x[1], x[0]))
        if score > MARGIN:
            scored.append((b, a, score, kind))
    ends = [x[0] for x in scored]
    best: list[tuple[float, int]] = [(0.0, -1)]
    for i, (_, a, score, _) in enumerate(scored):
        j = bisect_right(ends, a, 0, i)
        take = best[j][0] + score
        best.append((take, j) if take > best[i][0] else (best[i][0], -1))
    out, i = [], len(scored)
    while i:
        if best[i][1] >= 0:
            b, a, _, kind = scored[i - 1]
            out.append((kind, a, b))
            i = best[i][1]
        else:
            i -= 1
    return out[::-1]


def marginals(scored: list[tuple[int, int, list[str], list[tuple[str, float]]]]) -> tuple[float, list[dict[str, float]]]:
    """log Z over all segmentations, and each candidate's probability by type.

    ``total[i]``: the log sum over segmentations of the first i candidates by end;
    a candidate is left out, or follows those that end where it starts or before.
    """
    ends = [x[0] for x in scored]
    total, before, own = [0.0], [], []
    for i, (_, a, _, of) in enumerate(scored):
        j = bisect_right(ends, a, 0, i)
        top = max(s for _, s in of)
        s = top + math.log(sum(math.exp(x - top) for _, x in of))
        u, v = total[i], total[j] + s
        before.append(j)
        own.append(s)
        total.append(max(u, v) + math.log1p(math.exp(-abs(u - v))))
    share = [0.0] * len(scored) + [1.0]
    out: list[dict[str, float]] = [{} for _ in scored]
    for i in range(len(scored) - 1, -1, -1):
        j, s = before[i], own[i]
        take = share[i + 1] * math.exp(total[j] + s - total[i + 1])
        share[i] += share[i + 1] * math.exp(total[i] - total[i + 1])
        share[j] += take
        out[i] = {k: take * math.exp(x - s) for k, x in scored[i][3]}
    return total[-1], out


def _sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated text and its entities."""
    filler = "the order of page report was sent in version with total and from item chapter".split()
    text, gold = "", []
    for _ in range(r.randint(2, 5)):
        text += " ".join(r.choices(filler, k=r.randint(1, 5))) + " "
        d = lambda n: "".join(r.choices("0123456789", k=n))
        kind = r.choice(["phone", "ssn", "email", "number", "number", "digest", "date", "none"])
        if kind == "phone":
            text += r.choice(["call ", "phone ", "tel ", "mobile "])
            span = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])
        elif kind == "ssn":
            text += r.choice(["ssn ", "social security "])
            span = f"{d(3)}-{d(2)}-{d(4)}"
        elif kind == "email":
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]")])
            span = f"{r.choice(filler)}{r.choice(['', ' '])}{at} {r.choice(filler)} {dot} com"
        elif kind == "number":
            span = r.choice([d(r.randint(7, 14)), f"{d(2)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}", f"{d(1)}.{d(2)}.{d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}"])
        elif kind == "digest":
            span = r.choice([d(r.randint(7, 20)), "".join(r.choices("0123456789" * 3 + "abcdef", k=r.randint(20, 40))), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(2)}.{d(2)}.{d(3)}.{d(3)}"])
        elif kind == "date":
            span = r.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}"])
        else:
            continue
        if kind in KINDS:
            gold.append((kind, len(text), len(text) + len(span)))
        text += span + r.choice([", ", ". ", " "])
    return text, gold


@cache
def train(sentences: int = 900, rounds: int = 3, rate: float = 0.4, decay: float = 2e-3, seed: int = 13) -> Weights:
    """Weights by stochastic ascent of the conditional log-likelihood."""
    r = random.Random(seed)
    data = [_sentence(r) for _ in range(sentences)]
    weights: Weights = defaultdict(float)
    for n in range(rounds):
        step = rate / (1 + n)
        for text, gold in data:
            scored = _scored(text, weights, candidates(text))
            true = {(a, b): kind for kind, a, b in gold}
            for (b, a, feats, _), share in zip(scored, marginals(scored)[1], strict=True):
                for kind, p in share.items():
                    off = (true.get((a, b)) == kind) - p
                    if abs(off) > 1e-3:
                        for f in feats:
                            weights[kind, f] += step * (off - decay * weights[kind, f])
    return dict(weights)


# --- over a table -------------------------------------------------------------


def find(text: str, weights: Weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind, then start."""
    base = base_spans(text)
    spans = list(base)
    if _DIGIT.search(text) or "at)" in text or "at]" in text:
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        reach = 0
        ends = [reach := max(reach, b) for _, b in taken]

        def free(a: int, b: int) -> bool:
            k = bisect_right(starts, b - 1)
            return k == 0 or ends[k - 1] <= a

        cands = [c for c in candidates(text) if free(*c)]
        if cands:
            spans += decode(text, weights, cands)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(spans, key=lambda x: (order[x[0]], x[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


COLUMNS = [f"n_{k}" for k in BASE_KINDS]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_sha256 string, spans string, n_spans long"


def find_all(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans and how
    many they are."""
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = find(text, weights) if text else ([], [])
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            types = (*[pa.int64()] * len(COLUMNS), pa.string(), pa.string(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", *COLUMNS, "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


op7_pii = find_all

"""The operators against plain Python versions, on small and awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from docketry.llm import automaton, components, exact_dedup, kneser_ney, mixing, packing, passages, pii, quality_rules, secrets

SCHEMA = "doc_id long, text string, lang string, source string, quality int, run string, sig int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "r", 2, "k") for i, t, s in rows], SCHEMA)


AWKWARD = [(1, None, None), (2, "", ""), (3, " \n\t ", "a"), (4, "x" * 30000, "a"), (5, "a b\na b\nc", "b"), (5, "a b\na b\nc", "b"), (None, "a b", "b"), (None, None, None), (6, "ünï 𝔘x   y", "é"), (7, "a b\na b\nc", None)]
ALL = {
    "secrets": secrets.op1_secret_scans, "mixing": mixing.op2_mixing, "automaton": automaton.op3_lm_scoring, "packing": packing.op5_best_fit_packing, "passages": passages.op6_substring_dedup,
    "pii": pii.op7_pii, "quality": quality_rules.op8_quality_rules, "exact": exact_dedup.op10_exact_dedup, "classifier": lambda d: kneser_ney.op4_quality_classifier(d, d.select("doc_id", "quality", d.sig.alias("toxic"))),
}


@pytest.mark.parametrize("name", ALL)
def test_awkward_and_empty_tables(spark, name):
    rows = ALL[name](table(spark, AWKWARD)).collect()
    if name == "packing":  # each row's first piece, and no longer piece than a sequence
        assert sum(x.piece == 0 for x in rows) == len(AWKWARD) and all(1 <= x.length <= 4096 for x in rows)
    else:  # no text here has a passage of another's
        assert len(rows) == (0 if name == "passages" else len(AWKWARD))
    assert ALL[name](table(spark, [])).count() == 0


BIG = (1 << 53) + 1


@pytest.mark.parametrize("name", ALL)
def test_identifiers_beside_nulls_are_exact(spark, name):
    text = " ".join(f"w{k}" for k in range(70))
    rows = [(BIG, text, "a"), (BIG + 2, text + " x", "a"), (None, text + " y", "a"), (BIG + 4, "w " * 5, "b")]
    got = {x.doc_id for x in ALL[name](table(spark, rows).coalesce(1)).collect()}
    assert got == ({BIG + 2} if name == "passages" else {BIG, BIG + 2, BIG + 4, None})


def test_exact_dedup_merges_in_two_rounds(spark, monkeypatch):
    r = random.Random(21)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 20)
    rows = [(r.randrange(900) if r.random() < 0.9 else None, r.choice(["x", "y", None, f"u{r.randrange(150)}"]), None) for i in range(1500)]
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(table(spark, rows).select("doc_id", "text"), keep).collect()
        groups = collections.defaultdict(list)
        for i, t, _ in rows:
            groups[hashlib.sha256((t or "").encode()).digest()].append(i)
        kept = collections.Counter(bytes(g.sha) for g in got if g.kept)
        assert len(got) == len(rows) and kept == collections.Counter(groups.keys())
        for g in got:
            ids = [i for i in groups[bytes(g.sha)] if i is not None]
            assert (g.keep_id, g.group_size) == (best(ids, default=None), len(groups[bytes(g.sha)]))
            assert not g.kept or g.doc_id == g.keep_id


# --- secrets ------------------------------------------------------------------


def base_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_match_the_base_patterns(spark):
    r = random.Random(2)
    parts = ["password", "PASSWD", "token", "api_key", "apikey", "=", ": ", '"', "'", "abcdef123", "ab", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, " ", "𝔘", "é\n", "AKIAAKIA", "secret=="]
    rows = [(i, "".join(r.choices(parts, k=r.randint(1, 14))), None) for i in range(300)]
    got = {x.doc_id: x for x in secrets.op1_secret_scans(table(spark, rows)).collect()}
    kinds = ("assign", "access", "hex")
    for i, t, _ in rows:
        want = base_secrets(t)
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t, want, got[i].spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))


def test_trigram_queries_are_necessary():
    samples = {"assign": "PassWord : abcdef1", "access": "AKIA" + "A" * 16, "github": "ghp_" + "a" * 36, "slack": "xoxb-" + "1" * 12, "google": "AIza" + "b" * 35, "pem": "-----BEGIN RSA PRIVATE KEY-----", "jwt": "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9}
    for rule in secrets.RULES:
        q = secrets.trigram_query(rule.pattern)
        if rule.kind == "hex":
            assert q == secrets.ANYTHING
            continue
        text = samples[rule.kind]
        assert re.search(rule.pattern, text) and any(all(t in text.lower() for t in clause) for clause in q)
    assert secrets.trigram_query("abc|x.y") == secrets.ANYTHING
    assert secrets.trigram_query("xa(bcd)+e?fgh") == frozenset([frozenset(["bcd", "fgh"]), frozenset(["bcd", "efg", "fgh"])]) or secrets.trigram_query("xa(bcd)+e?fgh") == frozenset([frozenset(["bcd", "fgh"])])


def test_added_kinds_stay_beside_the_base(spark):
    t = "key ghp_" + "aB3" * 12 + " end"
    assert secrets.op1_secret_scans(table(spark, [(1, t, None)])).first().spans == "github:4:44"


# --- mixing -------------------------------------------------------------------


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.choice([0, 1, 5, 40, 300, 2000 if i % 97 == 0 else 7]), r.choice(["s0", "s0", "s0", "a", "b", "é", None])) for i in range(3000)]
    rows += [(1, rows[1][1], rows[1][2])] * 200
    d = table(spark, rows)
    a, b = ([tuple(x) for x in mixing.op2_mixing(y).collect()] for y in (d, d.repartition(7)))
    order = lambda x: tuple(v if v is not None else -1 for v in x)
    assert sorted(a, key=order) == sorted(b, key=order) and len(a) == len(rows)
    total = sum(x[1] for x in a)
    assert all(x[4] <= 3 * x[1] for x in a)
    taken, target = collections.Counter(), {}
    for _, size, source_size, goal, got in a:
        taken[source_size] += got
        target[source_size] = goal
    assert math.isclose(sum(target.values()), total) and all(abs(taken[s] - g) <= 150 for s, g in target.items())


def test_small_sources_come_near_their_targets(spark):
    """The residual is small next to the documents, in one round and in two."""
    r = random.Random(5)
    rows = [(i, "w " * r.choice([20, 40, 60, 90, 5000 if i % 25 == 0 else 30]), f"s{i % 20:02d}") for i in range(1000)]
    rows += [(5000 + i, "w " * r.randint(1, 40), "t") for i in range(9000)]
    taken, target, least = collections.Counter(), {}, {}
    for x in mixing.mix_sources(table(spark, rows)).collect():
        taken[x.source] += x.copies * x.size
        target[x.source] = x.target
        least[x.source] = min(least.get(x.source, 10**9), x.size)
    far = {s: (taken[s], t) for s, t in target.items() if abs(taken[s] - t) > max(60, least[s])}
    assert not far


def test_targets_stop_at_three_times_the_source(spark):
    s = spark.createDataFrame([("a", 10, 1, 0), ("b", 10, 1, 1), ("c", 980, 1, 2)], "source string, source_size long, n long, place long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert got == {"a": 30.0, "b": 30.0, "c": 940.0}


def test_pivot_keeps_mass_and_expectation():
    g = np.random.default_rng(0)
    size, p = g.integers(1, 9, 40), g.random(40)
    means = np.zeros(40)
    for _ in range(400):
        q, open_ = mixing.pivot(size, p, g.random(40))
        assert abs((size * q).sum() - (size * p).sum()) < 1e-6 and ((q == 0) | (q == 1)).sum() >= 39
        means += q / 400
    assert np.abs(means - p).max() < 0.15


# --- packing ------------------------------------------------------------------


def test_plan_is_near_optimal_and_complete():
    r = random.Random(1)
    for _ in range(200):
        hist = {r.randint(1, 20): r.randint(1, 30) for _ in range(r.randint(1, 8))}
        plan, count = packing.plan(hist, 20), collections.Counter()
        for pattern, n in plan:
            assert sum(pattern) <= 20
            for x in pattern:
                count[x] += n
        assert count == collections.Counter(hist)
        assert sum(n for _, n in plan) <= math.ceil(sum(k * v for k, v in hist.items()) / 20 * 1.25) + 1 + sum(v for k, v in hist.items() if k > 10)


def test_pieces_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, x, None) for i, x in enumerate(["Hello it's  a\nTEST", None, "", "ΑΣ don't İ ½ <|endoftext|>x 日本", "word " * 9000])]
    got = packing.pack_documents(table(spark, rows)).collect()
    for i, x, _ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((g.piece, g.start, g.length, g.ids_crc32) for g in got if g.doc_id == i) == want
    at = collections.defaultdict(list)
    for g in got:
        at[g.sequence_id].append((g.offset, g.length))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 4096


# --- PII, rules, digests --------------------------------------------------------


def base_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        out += [("card", m.start(), m.end())] if 13 <= len(digits) <= 19 and pii.luhn(digits) else []
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans():
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choices("a1.@+- 4(2", k=r.randint(1, 25)))
        assert pii.base_spans(t) == base_pii(t), t


def test_pii_model_finds_more_and_leaves_text_alone():
    w = pii.train()
    assert pii.find("call (555) 123-4567 now", w)[1] == [("phone", 5, 19)]
    assert pii.find("ssn 123-45-6789.", w)[1] == [("ssn", 4, 15)]
    assert pii.find("order 2020-01-02, total 1234567890 of version 1.2.345", w)[1] == []


def test_pii_marginals_equal_sums_over_segmentations():
    r = random.Random(3)
    for _ in range(100):
        scored = sorted((b, a, [], [(k, r.uniform(-2, 2)) for k in ("x", "y")]) for a, b in ({tuple(sorted(r.sample(range(9), 2))) for _ in range(r.randint(1, 6))}))
        total, share = 0.0, [collections.Counter() for _ in scored]
        picks = [[]]
        for i in range(len(scored)):
            picks += [[*p, (i, k)] for p in picks for k in (0, 1) if all(scored[j][0] <= scored[i][1] for j, _ in p)]
        for p in picks:
            w = math.exp(sum(scored[i][3][k][1] for i, k in p))
            total += w
            for i, k in p:
                share[i][scored[i][3][k][0]] += w
        z, got = pii.marginals(scored)
        assert math.isclose(z, math.log(total), abs_tol=1e-9)
        assert all(math.isclose(got[i][k], share[i][k] / total, abs_tol=1e-9) for i in range(len(scored)) for k in ("x", "y"))


def test_pii_recall_and_precision_by_kind():
    r, w = random.Random(99), pii.train()
    hit, true, said = collections.Counter(), collections.Counter(), collections.Counter()
    for _ in range(600):
        text, gold = pii._sentence(r)
        guess = pii.decode(text, w)
        true.update(k for k, *_ in gold)
        said.update(k for k, *_ in guess)
        hit.update(k for k, *_ in set(gold) & set(guess))
    print({k: (hit[k] / true[k], hit[k] / said[k]) for k in true})
    assert all(hit[k] >= 0.9 * true[k] and hit[k] >= 0.9 * said[k] for k in true)


def test_pii_finds_numbers_in_long_rows_of_numbers():
    row = " ".join(["12"] * 30) + " (555) 123-4567 " + " ".join(["7"] * 40)
    assert (row.index("("), row.index("(") + 14) in pii.candidates(row)


def test_quality_measures(spark):
    text = "a b c a b c\nsame line\n\nsame line\n# $"
    q = quality_rules.op8_quality_rules(table(spark, [(1, text, None), (2, "one two three " * 20, None), (3, " ".join(f"the{i} of" for i in range(60)), None)])).orderBy("doc_id").collect()
    assert (q[0].n_words, q[0].word_chars, q[0].n_symbols, q[0].n_dup_lines, q[0].n_repeat_words, q[0].kept) == (12, 24, 2, 1, 6, False)
    assert q[1].base_failed and not q[1].kept and q[2].kept


def test_exact_dedup_groups(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["x", "y", None, "", f"u{i}"]), None) for i in range(200)] + [(500, "x", None)] * 5
    got = exact_dedup.op10_exact_dedup(table(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    assert len(got) == len(rows)
    for g in got:
        assert (g.keep_id, g.group_size) == (max(by_sha[g.text_sha256]), len(by_sha[g.text_sha256]))
    assert sum(g.kept for g in got) == len(groups) and exact_dedup.keep_unique(table(spark, rows)).count() == len(groups)


# --- language models --------------------------------------------------------------


def test_automaton_equals_direct_sums(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["The", "a", "b", "cat", "Dog", f"z{i}"], k=r.randint(0, 60))), None) for i in range(80)]
    got = {x.doc_id: x for x in automaton.score(table(spark, rows), 300).collect()}
    toks = {i: [w.lower() for w in WORD.findall(t)] + ["\n"] for i, t, _ in rows}
    uni, pair = collections.Counter(), collections.Counter()
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            uni.update(t)
            pair.update(zip(["\n", *t[:-1]], t))
    arcs = {k: c for k, c in pair.items() if c >= automaton.LEAST}
    types, total = collections.Counter(h for h, _ in arcs), collections.Counter()
    for (h, _), c in arcs.items():
        total[h] += c
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    for i, t in toks.items():
        q = lambda h, w: (arcs.get((h, w), 0) + types[h] * p(w)) / (total[h] + types[h]) if total[h] else p(w)
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(uni[w] > 0 for w in t), n)
        assert x.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(x.base_score, sum(math.log10(p(w)) for w in t), abs_tol=1e-9)
        assert math.isclose(x.score, sum(math.log10(q(h, w)) for h, w in zip(["\n", *t[:-1]], t)), abs_tol=1e-9)


def test_bigrams_seen_once_are_arcs(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    train = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1)
    rows = [(train, "a b " + "c " * 400, None), (held, "a b", None)]
    x = next(x for x in automaton.score(table(spark, rows), 300).collect() if x.doc_id == held)
    p = lambda c: (c + 0.5) / (403 + 0.5 * 5)
    # (start, a) and (a, b) once, (b, end) never; each state has one type and one token.
    assert math.isclose(x.score, sum(math.log10(q) for q in ((1 + p(1)) / 2, (1 + p(1)) / 2, p(1) / 2)), abs_tol=1e-9)


def test_kneser_ney_is_a_distribution_and_tells_junk(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(vocab, k=50)) for _ in range(80)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    import pyarrow as pa
    from docketry.llm.common import Words

    ends = [10.0 ** -model.nll(Words(pa.array([f"w1 {w}", "w1"]), True)) for w in [*vocab, "unseen"]]
    assert math.isclose(sum(a / b for a, b in ends), 1.0, rel_tol=1e-6)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(900, "qq " * 60, "s")]
    d = table(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    import docketry.llm.kneser_ney as k

    old, k.TRUSTED = k.TRUSTED, 50
    try:
        kept = {x.doc_id: x.kept for x in k.classify(d, labels).collect()}
    finally:
        k.TRUSTED = old
    assert not kept[900] and sum(kept.values()) >= 78


def test_kneser_ney_equals_a_plain_version(spark):
    r = random.Random(18)
    vocab = ["der", "Über", "über", "Haus", "haus", *[f"w{i}" for i in range(25)]]
    texts = [" ".join(r.choices(vocab, k=r.randint(1, 40))) for _ in range(60)]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
    pairs = collections.Counter(p for t in texts for p in zip(["\n", *low(t)], low(t)))
    heads, cont = collections.Counter(), collections.Counter(w for _, w in pairs)
    for (h, _), c in pairs.items():
        heads[h] += c

    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
        return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1)]

    d, e = discounts(pairs), discounts(cont)
    off = lambda c, x: x[min(c, 3) - 1]
    types = sum(cont.values())
    unknown = sum(min(k, off(k, e)) for k in cont.values()) / types / (len(cont) + 1)

    def p(h, w):
        lower = max(cont[w] - off(cont[w], e), 0) / types + unknown if w in cont else unknown
        if h not in heads:
            return lower
        back = sum(off(c, d) for (g, _), c in pairs.items() if g == h) / heads[h]
        return max(pairs[h, w] - off(pairs[h, w], d), 0) / heads[h] + back * lower if (h, w) in pairs else back * lower

    from docketry.llm.common import Words
    import pyarrow as pa

    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    new = [*texts[:10], "Über dem Haus", "über dem haus", "", "x y z w1 w2"]
    got = model.nll(Words(pa.array(new), True))
    for t, x in zip(new, got):
        assert math.isclose(x, -sum(math.log10(p(h, w)) for h, w in zip(["\n", *low(t)], low(t))), rel_tol=1e-9, abs_tol=1e-9), t


def test_few_trusted_documents_still_set_thresholds(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(30)], k=50)), "en") for i in range(80)]
    rows += [(100 + i, " ".join(r.choices([f"v{k}" for k in range(30)], k=50)), "de") for i in range(2)]
    rows += [(200, "v1 v2 v3 " * 20, "de"), (201, "w1 w2", None), (900, "qq " * 60, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(80), 100, 101]], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in kneser_ney.classify(d, labels).collect()}
    assert all((x.threshold is not None) == (x.lang is not None) for x in got.values())
    assert not got[900].kept and got[201].kept and sum(got[i].kept for i in range(80)) >= 78


def test_pieces_are_remembered_across_batches():
    import public_tokenizers

    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), most=30)
    letters = "abcdefghijklmnopqrst"
    first = tokens([f"word{x}" * 2 + x for x in letters])  # 20 words and fewer than 30 pieces
    held = dict(tokens.parts)
    assert 0 < len(held) <= 30 and tokens([f"word{x}" * 2 + x for x in letters]) == first
    assert all(tokens.parts[k] is v for k, v in held.items())
    for i in range(10):  # and no more than one batch beyond the bound
        tokens([f"{x * (i + 2)}" for x in letters])
        assert len(tokens.parts) <= 30 + len(letters)


# --- passages and components --------------------------------------------------------


def test_chain_scores_are_best():
    r = random.Random(3)
    for _ in range(300):
        m = r.randint(1, 12)
        x, y, n = [r.randint(0, 60) for _ in range(m)], [r.randint(0, 60) for _ in range(m)], [r.choice([3, 8, 20]) for _ in range(m)]
        gap = lambda j, i: x[i] - x[j] + y[i] - y[j] - 2 * n[j]
        best = {}
        for i in sorted(range(m), key=lambda i: (x[i], y[i])):
            best[i] = n[i] + max([0] + [best[j] - 0.1 * gap(j, i) for j in best if x[j] + n[j] <= x[i] and y[j] + n[j] <= y[i]])
        found = passages.chains(*map(np.array, (x, y, n)))
        score = lambda c: sum(n[i] for i in c) - sum(0.1 * gap(i, j) for i, j in zip(c, c[1:]))
        assert math.isclose(max(map(score, found)), max(best.values())) and sorted(i for c in found for i in c) == list(range(m))


def test_matches_of_one_diagonal_are_segments():
    doc, first = np.zeros(6, np.int64), np.array([1, 1, 1, 1, 1, 2])
    pos, fpos, n = np.array([0, 5, 20, 40, 41, 3]), np.array([10, 15, 30, 60, 61, 3]), np.array([8, 50, 8, 8, 8, 8])
    got = [x.tolist() for x in passages.segments(doc, first, pos, fpos, n)]
    assert got == [[0, 0, 0], [1, 1, 2], [0, 40, 3], [10, 60, 3], [55, 9, 8]]


def test_long_seeds_are_hashes_of_their_words():
    h = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    h[200:260] = h[20:80]
    for k in (1, 5, 8, 50):
        g = passages._grams(h, k)
        assert len(g) == 301 - k and all((g[200 + i] == g[20 + i]) for i in range(60 - k + 1)) and len(set(g.tolist())) == 301 - k - (60 - k + 1)


def test_planted_passages_are_found(spark):
    r = random.Random(6)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    exact, fuzzy, rows = words(60), words(100), []
    for i in range(40):
        t = words(r.randint(60, 200))
        if i % 4 == 0:
            t[20:20] = exact
        if i % 4 == 1:
            f = list(fuzzy)
            f[r.randrange(100)] = "changed"
            del f[50]
            t[5:5] = f
        rows.append((i, " ".join(t), None))
    got = passages.repeated_passages(table(spark, [*rows, (90, rows[2][1], None), (None, rows[2][1], None), (91, "a b c", None)])).collect()
    pairs = {(g.doc_id, g.first_doc) for g in got}
    assert {(i, 0) for i in range(4, 40, 4)} | {(i, 1) for i in range(5, 40, 4)} | {(90, 2)} == pairs
    for g in got:
        if g.first_doc == 0:
            assert (g.end_word - g.start_word, g.identity) == (60, 1.0)


def test_stretches_are_maximal():
    r = random.Random(5)
    for _ in range(300):
        e = np.array([r.random() < 0.6 for _ in range(r.randint(1, 30))])

        def split(lo, hi):  # the definition: the best stretch, then those left and right of it
            v = [(float(np.where(e[i:j], 1, -2).sum()), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
            best = max(v, key=lambda x: (x[0], x[1]), default=(0,))
            return [] if best[0] <= 0 else [*split(lo, best[2]), best, *split(best[3], hi)]

        got = passages._stretches(e, 2.0)
        assert sum(np.where(e[a:b], 1, -2).sum() for a, b in got) == sum(b[0] for b in split(0, len(e)))


@pytest.mark.parametrize("size, gap, other", [(60, 40, 40), (100, 200, 200), (200, 150, 150), (60, 40, 55), (100, 150, 90)])
def test_passages_with_different_words_between_are_both_found(spark, size, gap, other):
    r = random.Random(size + gap)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(10):
        head, foot = words(size), words(size)
        rows += [(2 * i, " ".join(words(20) + head + words(gap) + foot + words(20)), None), (2 * i + 1, " ".join(words(30) + head + words(other) + foot + words(30)), None)]
        want |= {(2 * i + 1, 30, 30 + size), (2 * i + 1, 30 + size + other, 30 + 2 * size + other)}
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert {(g.doc_id, g.start_word, g.end_word) for g in got} == want and {g.identity for g in got} == {1.0}


@pytest.mark.parametrize("size, every", [(100, 8), (100, 10), (60, 10)])
def test_passages_with_changed_words_are_found(spark, size, every):
    r = random.Random(size + every)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(40):
        one = words(size)
        other = [w if (k + 1) % every else "changed" for k, w in enumerate(one)]
        rows += [(2 * i, " ".join(words(70) + one + words(70)), None), (2 * i + 1, " ".join(words(90) + other + words(50)), None)]
    got = {(g.doc_id, g.first_doc) for g in passages.repeated_passages(table(spark, rows)).collect()}
    assert got == {(2 * i + 1, 2 * i) for i in range(40)}


def linked(rows, found):
    """Documents by the passages that join them."""
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for g in found:
        root[find(g.doc_id)] = find(g.first_doc)
    return lambda a, b: find(a) == find(b)


def test_a_passage_stays_linked_where_others_hold_parts_of_it(spark):
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(30):
        p, at = words(88), 10 * k
        cuts = [p[:48], p[40:], p, p] if k % 2 else [p, p[:48], p[40:], p]
        rows += [(at + i, " ".join(words(30) + c + words(30)), None) for i, c in enumerate(cuts)]
        pairs.append((at + 2, at + 3) if k % 2 else (at, at + 3))
    same = linked(rows, passages.repeated_passages(table(spark, rows)).collect())
    assert all(same(a, b) for a, b in pairs)


def test_hot_passages_link_all_their_documents(spark, monkeypatch):
    r = random.Random(13)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = words(90)
    rows = [(i, " ".join(words(20) + shared + words(20)), None) for i in range(400)] + [(1000 + i, " ".join(words(120)), None) for i in range(200)]
    monkeypatch.setattr(passages, "SAMPLE", 2)
    monkeypatch.setattr("docketry.llm.common.HOT_ROWS", 20)
    got = passages.repeated_passages(table(spark, rows)).collect()
    same = linked(rows, got)
    assert all(same(0, i) for i in range(400)) and {g.doc_id for g in got} == set(range(1, 400))
    assert {g.doc_id for g in got if (g.start_word, g.end_word, g.identity) == (20, 110, 1.0)} == set(range(1, 400))
    assert all(20 <= g.start_word and g.end_word <= 110 and g.identity == 1.0 for g in got)


def test_recall_against_brute_force(spark):
    """Linked pairs of random corpora with fuzzy and exact passages, some of them cut."""
    r = random.Random(14)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, want, k = [], {}, 0
    for equal in (1.0, 0.95, 0.9, 0.85):
        for size in (60, 100, 200):
            for _ in range(25):
                one = words(size)
                other = [w if r.random() < equal else "changed" + str(r.random()) for w in one]
                rows += [(k, " ".join(words(r.randint(0, 60)) + one + words(r.randint(0, 60))), None), (k + 1, " ".join(words(r.randint(0, 60)) + other + words(r.randint(0, 60))), None)]
                if sum(a == b for a, b in zip(one, other)) >= 0.8 * size:
                    want.setdefault((equal, size), []).append((k, k + 1))
                k += 2
    found = {(g.first_doc, g.doc_id) for g in passages.repeated_passages(table(spark, rows)).collect()}
    recall = {key: sum(p in found for p in v) / len(v) for key, v in want.items()}
    print(recall)
    assert all(v == 1.0 for (e, _), v in recall.items() if e == 1.0)
    assert sum(sum(p in found for p in v) for v in want.values()) >= 0.9 * sum(map(len, want.values())), recall
    assert found <= {p for v in want.values() for p in v} | {(k, k + 1) for k in range(0, k, 2)}


def test_repeated_identifiers_are_one_text(spark):
    r = random.Random(15)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b = words(80), words(80)
    rows = [(1, a, None), (1, b, None), (1, a, None), (2, a, None), (3, b, None)]
    runs = [sorted(map(tuple, passages.repeated_passages(table(spark, rows).repartition(n)).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 1 and runs[0][0][3] == 1


def test_parts_of_a_chain_hold_and_cover():
    r = np.random.default_rng(4)
    for _ in range(60):
        n = 400
        a, b = (r.integers(1, 2**60, n).astype(np.uint64) for _ in range(2))
        same = np.zeros(n, bool)
        for at in range(0, n, 100):
            same[at : at + int(r.integers(30, 95))] = True
        same &= r.random(n) < r.choice([0.85, 0.95, 1.0])
        b[same] = a[same]
        run = np.flatnonzero(np.convolve(same, np.ones(8, int), "valid") == 8)
        if not len(run):
            continue
        none = np.zeros(len(run), np.int64)
        got = passages.pieces(a, b, *passages.segments(none, none, run, run, np.full(len(run), 8))[2:], 50, 0.8)
        covered = np.zeros(n, bool)
        for s, e, fs, fe, equal in got:
            assert (s, e) == (fs, fe) and equal == same[s:e].sum() >= 0.8 * (e - s) and e - s >= 50
            covered[s:e] = True
        for s in range(n - 50):  # every exact run of 50 words, wherever it lies
            if same[s : s + 50].all():
                assert covered[s : s + 50].all()


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}

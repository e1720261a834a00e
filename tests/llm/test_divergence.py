import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallymark.llm import divergence as module, transducer
from tallymark.llm.divergence import divergence
from tallymark.llm.transducer import Vocabulary, build, minimal

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return PATTERN.findall((text or "").translate(FOLD))


def brute(rows, least, smoothing=5, top=50):
    """Every share by its definition, with fractions, over dense tables."""
    rows = [(l or "", s or "", t or "") for l, s, t in rows]
    out = []
    for lang in {l for l, _, _ in rows}:
        mine = [(s, words(t)) for l, s, t in rows if l == lang]
        seen = Counter(w for _, ws in mine for w in set(ws))
        kept = sorted((w for w in seen if seen[w] >= least), key=lambda w: w.encode())
        counts = defaultdict(Counter)
        for s, ws in mine:
            counts[s].update(w for w in ws if w in set(kept))
        whole = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + Fraction(10**9 * (c[w] + smoothing), sum(c.values()) + smoothing * len(kept)).__floor__()

        for s, c in counts.items():
            pairs = [(-sum(abs(p(c, w) - p(d, w)) for w in kept), o.encode(), o) for o, d in counts.items() if o != s]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            over = sorted((p(whole, w) - p(c, w), w.encode(), w) for w in kept if c[w] > 0 and p(c, w) > p(whole, w))
            out += [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(over[:top], 1)]
    return sorted(out)


def run(spark, rows, parts=4, **options):
    df = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)],
                               "doc_id long, lang string, source string, text string, ordinal string, gid int").repartition(parts)
    return sorted(tuple(r) for r in divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def made(n, seed=3, sources=7):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeÄßλ😀", k=rng.randrange(1, 7))) for _ in range(150)]
    rows = []
    for _ in range(n):
        s = rng.choice([0, 0, 0, *range(sources)])
        text = "".join(rng.choice(vocabulary[s * 5:]).upper() + rng.choice([" ", "-", "\n", "1", "\x00"]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None]), f"s{s}", text))
    return rows


EDGES = [(None, None, None), ("en", "empty", ""), ("en", "empty", None), ("en", None, "  12 "), ("xx", "alone", "only rare words here"),
         ("en", "s1", "Same same SAME"), ("en", "s1", "Same same SAME"), ("en", "long", "aß b " * 100_000), ("en", "one", "z" * 200_000), ("yy", "a", None), ("yy", "b", "")]


def test_equals_brute_force(spark):
    rows = made(300) + EDGES
    assert run(spark, rows, min_documents=20) == brute(rows, 20)


def test_small_shards_passes_and_blocks_change_nothing(spark, monkeypatch):
    rows = made(200, seed=8, sources=9) + EDGES
    whole = brute(rows, 3, top=5)
    for name, value in dict(SHARD_TERMS=7, BROADCAST_BYTES=9_000, COUNTS_HELD=40, TERMS_HELD=50, BLOCK_TERMS=16, PAIR_SOURCES=3, ADDED_TOGETHER=2).items():
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(transducer, "WINDOW", 500)
    assert run(spark, rows, min_documents=3, top=5) == whole


def test_nothing_kept_and_no_rows(spark):
    rows = [("en", s, "a b c") for s in "xyz"]
    assert run(spark, rows) == brute(rows, 30) and all(r[4] == 0 for r in run(spark, rows))
    assert run(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6).filter(lambda b: b), min_size=1, max_size=40))
def test_ordinals_of_any_terms(terms):
    terms = sorted(terms)
    t = build(terms)

    def ordinal(word):
        state, total = t.root, 0
        for b in word:
            if t.check[state + b] != state:
                return None
            total, state = total + t.output[state + b], t.target[state + b]
        return total if t.final[state] else None

    assert [ordinal(w) for w in terms] == list(range(len(terms)))
    for w in terms:
        for other in (w[:-1], w + b"a", b"q" + w):
            assert ordinal(other) == (terms.index(other) if other in terms else None)


def futures(terms):
    """Distinct sets of endings: the states of the minimal automaton (Myhill and Nerode)."""
    starts = {w[:i] for w in terms for i in range(len(w) + 1)}
    return {frozenset(w[len(s):] for w in terms if w.startswith(s)) for s in starts}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=5), min_size=1, max_size=30))
def test_automaton_is_minimal(terms):
    assert len(minimal(sorted(w.encode() for w in terms))) == len(futures(terms))


def test_shares_are_exact_at_any_count():
    for total, v in [(0, 1), (7, 3), (10**9, 50_000), (10**15, 10**7), (10**17, 10**8)]:
        counts = np.array([0, 1, 2, total // 3, total], np.int64)
        want = [1 + (10**9 * (int(c) + 5)) // (total + 5 * v) for c in counts]
        assert module.shares(counts, total, v, 5).tolist() == want


def test_terms_must_ascend():
    with pytest.raises(ValueError):
        build([b"b", b"a"])
    with pytest.raises(ValueError):
        build([b""])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["en", "de", "no"]), st.text(alphabet="abBC é-1\x00😀", max_size=40)), min_size=1, max_size=8), st.integers(1, 5), st.integers(1, 60))
def test_texts_run_through_shards(texts, shard, window):
    terms = {lang: sorted({w.encode() for l, t in texts for w in words(t) if l == lang} | {b"abcdefgh" + bytes([97 + i]) for i in range(9)}) for lang in ("en", "de")}
    shards = [(lang, ws[i], i, build(ws[i:i + shard])) for lang, ws in terms.items() for i in range(0, len(ws), shard)]
    data = [t.encode() for _, t in texts] + [b"abcdefgha abcdefghd abcdefghi"]
    names = [lang for lang, _ in texts] + ["en"]
    old, transducer.WINDOW = transducer.WINDOW, window
    try:
        parts = list(Vocabulary(shards).ordinals(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), names))
    finally:
        transducer.WINDOW = old
    got = Counter((int(t), int(o)) for text, ordinal in parts for t, o in zip(text, ordinal))
    want = Counter((i, terms[lang].index(w.encode())) for i, (lang, d) in enumerate(zip(names, data)) if lang in terms for w in words(d.decode()) if w.encode() in terms[lang])
    assert got == want

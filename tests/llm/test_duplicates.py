import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallymark.llm import near_duplicates as near, substrings
from tallymark.llm.components import components
from tallymark.llm.suffixes import suffix_array
from tests.llm.conftest import EDGES

WORDS = [f"w{i}" for i in range(4000)]
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().translate(LOWER)) if w]
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets}


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def check_near(rows, table_of, parts=5):
    want = brute_components(rows)
    got = near.near_duplicates(table_of(rows, parts)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_template_pages_stay_apart(table_of):
    """Pages that share a template, alike to 0.6, meet in one cluster and are no links; two real copies among them are."""
    rng = random.Random(12)
    template = [rng.choice(WORDS) for _ in range(150)]
    rows = [(i, " ".join(template + [f"own{i}-{j}" for j in range(46)])) for i in range(1500)]
    rows += [(5000 + i, rows[i * 100][1] + " one word more") for i in range(5)]
    x, y = (shingles(t) for _, t in rows[:2])
    assert 0.55 < len(x & y) / len(x | y) < 0.65
    got = {r.doc_id: r.component_id for r in near.near_duplicates(table_of(rows, 4)).collect()}
    assert got == {i: (i - 5000) * 100 if i >= 5000 else i for i, _ in rows}


def test_split_clusters_lose_no_link(spark, monkeypatch):
    """All links between parts, straight from sets of every similarity about the threshold."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 60, 400, dtype=np.uint64)
    sets = {}
    for i in range(160):
        own = base[: rng.integers(40, 400)].copy()
        at = rng.random(own.size) < rng.choice([0.02, 0.1, 0.14, 0.2, 0.3])
        own[at] = rng.integers(1, 1 << 60, at.sum(), dtype=np.uint64)
        sets[i] = np.unique(own)
    want = {(i, j) for i in sets for j in range(i) if 100 * (both := np.intersect1d(sets[i], sets[j]).size) >= 75 * (sets[i].size + sets[j].size - both)}
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "rep long, set binary")
    clusters = spark.createDataFrame([(7, i) for i in sets], "node long, rep long")
    monkeypatch.setattr(near, "CHUNK", 9000)
    got = {(r.a, r.b) for r in near._between_parts(clusters, None, frame).collect()}
    assert got == want and len(want) > 100


def test_pairs_of_a_group_do_not_travel(table_of, monkeypatch):
    """Sixty near copies of one text, all linked, stage edges by members and not by pairs, of which there are 1,770."""
    rng, edges = random.Random(8), []
    base = [rng.choice(WORDS) for _ in range(300)]
    rows = [(i, " ".join(edited(base, rng, 1))) for i in range(60)]
    stage = near.stage

    def counted(df):
        out = stage(df)
        if {"a", "b"} <= set(out.columns):
            edges.append(out.count())
        return out

    monkeypatch.setattr(near, "stage", counted)
    got = near.near_duplicates(table_of(rows, 3)).collect()
    assert {r.component_id for r in got} == {0} and max(edges) <= 60


def test_near_duplicates_of_every_degree(table_of):
    rng, rows = random.Random(4), []
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 150))]
        rows += [" ".join(edited(base, rng, rng.randint(0, 6))) for _ in range(6)]
    rows += [r.upper() for r in rows[:5]] + rows[:10]
    rng.shuffle(rows)
    check_near(list(enumerate(rows)), table_of)


def test_one_large_group(table_of):
    """Copies of one text, each edited in its own way, among others that share a long passage."""
    rng = random.Random(9)
    base, passage = [rng.choice(WORDS) for _ in range(120)], [rng.choice(WORDS) for _ in range(40)]
    rows = [" ".join(edited(base, rng, rng.randint(0, 5))) for _ in range(150)]
    rows += [" ".join([rng.choice(WORDS) for _ in range(60)] + passage) for _ in range(80)]
    rows += [" ".join(base)] * 60
    rng.shuffle(rows)
    check_near(list(enumerate(rows)), table_of)


def test_near_edges(table_of):
    rows = near.near_duplicates(table_of(EDGES)).collect()
    by = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(EDGES)
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 1, None, False), (7, 1, 7, True)} <= by
    assert near.near_duplicates(table_of([])).count() == 0
    same = near.near_duplicates(table_of([(None, "one text"), (9, "one text")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in same} == {(None, 9, False), (9, 9, True)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.x: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: find(x) for x in ends}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80))
def test_suffix_array(letters):
    text = bytes(letters)
    assert suffix_array(np.frombuffer(text, dtype=np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(rows):
    seen, want = {}, {}
    for doc_id, text in sorted({(i, (t or "").encode()) for i, t in rows}, key=lambda r: (r[0] is None, r[0])):
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            if seen.setdefault(text[p:p + 100], (doc_id, p)) != (doc_id, p):
                gone[p:p + 100] = b"\1" * 100
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        rest = bytes(c for c, g in zip(text, gone) if not g)
        want[doc_id] = (len(text), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return want


def check_repeats(rows, table_of):
    want = brute_repeats(rows)
    got = substrings.without_repeats(table_of(rows, 5)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def repeats_corpus(seed):
    rng = random.Random(seed)
    line = " ".join(rng.choice(WORDS) for _ in range(40))
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(WORDS[:300]) for _ in range(rng.randint(0, 80)))]
        if rng.random() < 0.4:
            at = rng.randrange(60)
            parts.append(line[at:at + rng.randint(90, 200)])
        if rows and rng.random() < 0.3:
            other = rng.choice(rows)[1]
            at = rng.randrange(max(1, len(other)))
            parts.append(other[at:at + rng.randint(95, 300)])
        if rng.random() < 0.1:
            parts.append(rng.choice(["ab", "é", "xyz "]) * rng.randint(40, 200))
        rng.shuffle(parts)
        rows.append((i * 7 % 120, "".join(parts)))
    return rows


def test_repeats_by_contexts(table_of):
    check_repeats(repeats_corpus(1), table_of)


@pytest.mark.parametrize("name, value", [("HOT", 1_000_000_000), ("SHARD_BYTES", 300)])
def test_repeats_on_every_path(table_of, monkeypatch, name, value):
    """Anchors sent string by string (all that occur more than four times in the sample, here everything), and tiny shards."""
    monkeypatch.setattr(substrings, name, value)
    if name == "HOT":
        monkeypatch.setattr(substrings, "SAMPLE", 1)
    check_repeats(repeats_corpus(2), table_of)


def test_repeats_edges(table_of):
    check_repeats([r for r in EDGES if r[0] != 5] + [(5, "lorem ipsum dolor sit amet " * 300)], table_of)
    assert substrings.without_repeats(table_of([])).count() == 0

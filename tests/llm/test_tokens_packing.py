import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallymark.llm import packing
from tallymark.llm.tokens import Encoder, count_tokens, vocabulary_path
from tests.llm.conftest import EDGES

LIBRARY = Tokenizer.from_file(vocabulary_path())
ENCODER = Encoder(vocabulary_path(), lambda ids: ids.tolist(), lambda parts: sum(parts, []))


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabcdeT'st sÀñßΣσİ日１²½ \t\n\x1c\x85　.!?👍🏽́ﬁ<|endoftext|>\x00", max_size=80))
def test_ids_are_the_library_s(text):
    assert sum(ENCODER.texts([text])[0], []) == ids(text)


def test_special_strings_and_runs():
    for text in ["<|endoftext|>x<|startoftext|>", "a<|endoftext|>b", "a" * 999, "ab" * 777, "ΟΔΟΣ don't we'll I'VE", "!" * 300, ""]:
        assert sum(ENCODER.texts([text])[0], []) == ids(text)


def test_cache_limit_changes_nothing(monkeypatch, corpus):
    monkeypatch.setattr("tallymark.llm.tokens.CACHED_WORDS", 50)
    small = Encoder(vocabulary_path(), len, sum)
    texts = list(corpus.values())[:40]
    assert [sum(x) for t in texts for x in small.texts([t])] == [len(ids(t)) for t in texts]


def test_counts_over_edges(table_of):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in count_tokens(table_of(EDGES)).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(ids(t))) for i, t in EDGES)
    assert count_tokens(table_of([])).count() == 0


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(table_of):
    rows = packing.pack_documents(table_of(EDGES)).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for doc_id, text in set(EDGES):
        whole = ids(text) + [0]
        want = [(k, s, len(whole[s:s + 2048]), zlib.crc32(np.array(whole[s:s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(whole), 2048))]
        assert sorted(pieces[doc_id]) == sorted(want * EDGES.count((doc_id, text)))
    check_packing(rows, 2048)
    assert packing.pack_documents(table_of([])).count() == 0


@pytest.mark.parametrize("top", [2048, 600, 1100])
def test_rounds_come_near_the_bound(spark, top):
    random.seed(top)
    sizes = [random.randint(1, top) for _ in range(6000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "n long, length long").repartition(7)
    rows = packing.pack(df, items_per_task=1500).collect()
    assert sorted(r.n for r in rows) == list(range(6000))
    assert check_packing(rows, 2048) <= 1.02 * len(set(packing.best_fit(np.array(sizes), 2048)[0].tolist())) + 1


def test_pieces_over_half_cannot_share(spark):
    df = spark.createDataFrame([(1500,)] * 900, "length long").repartition(4)
    assert check_packing(packing.pack(df, items_per_task=100).collect(), 2048) == 900

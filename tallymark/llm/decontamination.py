"""Benchmark decontamination by latent semantic retrieval.

Documents become word numbers over the benchmark's vocabulary once, with document frequencies counted on the
way. A randomised singular value decomposition of TF-IDF passages (all items, and all passages of the corpus, whose
partial products come from Spark tasks) gives the latent space. Every passage of every document
is placed in it; items close by cosine are candidates, and so is, whatever its cosine, every item of which the
words around a passage can hold the weight that a confirmation asks for. A candidate is confirmed by the longest
common subsequence of words, and where that is short of a copy, by the item's answer, its last words of weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import chunks, stage

ITEMS = 10_000  # items searched at once; more are searched in blocks of as many
BLOCK = 32  # words; a passage is two neighbouring blocks
RANK = 128
FEATURES = 8192
SUMMED = 128  # features whose partial products travel as one row
DENSE = 256  # most frequent words, by whose counts products are taken; others are gathered
POWER_STEPS = 2
COMMON = 64  # words that are counted instead of gathered
CLOSE = 0.35
COPY, PARAPHRASE = 0.8, 0.5  # longest common subsequence against the item's length
RARE_SHARE = 0.6  # of the item's word weight that the region must hold
ANSWER_WORDS, ANSWER_WEIGHT, ANSWER_SHARE = 5, 0.2, 0.8  # the answer: so many last words, and more until they hold such a share of the weight
LIGHT = 0.2  # share of an item's weight, its lightest words, that is taken as held without looking
_CACHE = 500_000


def plain(word: str) -> str:
    """A word without what is no letter or digit at its ends, in lower case; empty if nothing is left."""
    if word.isalnum():
        return word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end].lower()


@dataclass
class Items:
    """Benchmark items as word numbers from 1 on; 0 is any other word."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words = [], []
        for item, text in rows:
            own = [w for w in map(plain, (text or "").split()) if w]
            if own:
                ids.append(item)
                words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in own], dtype=np.int32))
        return Items(ids, words, vocabulary)


class _Numbers(dict):
    """Word numbers of raw words, kept as they are met; -1 for what is no word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        word = plain(raw)
        found = self.vocabulary.get(word, 0) if word else -1
        if len(raw) < 64:
            self[raw] = found
        return found


def numbered(df: DataFrame, vocabulary: dict[str, int]) -> tuple[DataFrame, np.ndarray, int]:
    """Staged ``(doc_id, words)`` (int32 numbers), each word's document frequency, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, frequency, documents = _Numbers(vocabulary), np.zeros(len(vocabulary) + 1, dtype=np.int64), 0
        for ids, texts in chunks(batches):
            out = []
            for text in texts:
                raw = text.split()
                own = np.fromiter(map(numbers.__getitem__, raw), dtype=np.int32, count=len(raw))
                own = own[own >= 0]
                frequency[np.unique(own)] += 1
                documents += 1
                out.append(own.tobytes())
            if len(numbers) > _CACHE:
                numbers.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], ["doc_id", "words", "counts"])
        frequency[0] = documents
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([frequency.tobytes()], pa.binary())], ["doc_id", "words", "counts"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for counts in batch.column(0):
                own = np.frombuffer(counts.as_buffer(), dtype=np.int64)
                total = own if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["word", "n"])

    both = stage(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, words binary, counts binary"))
    counts = both.filter(F.col("counts").isNotNull()).select("counts").mapInArrow(unpack, "word int, n long")
    frequency = np.zeros(len(vocabulary) + 1, dtype=np.float64)
    for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row for each benchmark word at most
        frequency[r.word] = r.n
    return both.filter(F.col("counts").isNull()).select("doc_id", "words"), frequency, int(frequency[0])


def passages(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each known word of a document its number and its block."""
    known = np.flatnonzero(words)
    return words[known], known // BLOCK


@dataclass
class Space:
    """Latent vectors of words (already weighted), and the unit vectors of the items."""

    word_vectors: np.ndarray
    item_vectors: np.ndarray
    weights: np.ndarray
    common: np.ndarray  # the most frequent words, which make up most of any text

    def block_sums(self, words: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
        """Sum of the word vectors of each block: common words by counting, others one by one."""
        place = np.full(self.weights.size, -1)
        place[self.common] = np.arange(self.common.size)
        at = place[words]
        frequent = at >= 0
        counts = np.bincount(block[frequent] * self.common.size + at[frequent], minlength=blocks * self.common.size)
        sums = counts.reshape(blocks, -1).astype(np.float32) @ self.word_vectors[self.common]
        words, block = words[~frequent], block[~frequent]
        for start in range(0, words.size, 20_000):  # bounds what the gather holds
            own = block[start:start + 20_000]
            begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sums[own[begins]] += np.add.reduceat(self.word_vectors[words[start:start + 20_000]], begins, axis=0)
        return sums


def _gram_step(rows: list[np.ndarray], feature: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A'(A basis)`` for unit TF-IDF rows ``A`` given as word numbers."""
    out = np.zeros_like(basis)
    for own in rows:
        f, where = np.unique(feature[own], return_inverse=True)
        x = np.bincount(where, weights=weights[own])
        x /= np.linalg.norm(x) or 1.0
        out[f] += np.outer(x, x @ basis[f])
    return out


def word_weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    """Squared inverse document frequency: words of nearly every document hardly count, none counts for nothing."""
    weights = (np.log((documents + 1) / (frequency + 1)) + 0.01) ** 2
    weights[0] = 0.0
    return weights


def _passage_step(texts: list[np.ndarray], feature: np.ndarray, weights: np.ndarray, basis: np.ndarray, common: np.ndarray) -> np.ndarray:
    """``A'(A basis)`` for the unit TF-IDF rows ``A`` of all passages of some documents.

    A passage is the sum of two neighbouring blocks, or a document's only one, so products are taken block by block.
    """
    known, at, alone, base = [], [], [], 0
    for words in texts:
        w, b = passages(words)
        blocks = max(1, -(-words.size // BLOCK))
        known.append(feature[w] + (b + base) * FEATURES)
        at.append(weights[w])
        alone.append(np.arange(blocks + 1) < max(1, blocks - 1))  # passages begin at these; an empty block keeps documents apart
        base += blocks + 1
    begins = np.concatenate(alone)
    key, where = np.unique(np.concatenate(known), return_inverse=True)
    value = np.bincount(where, weights=np.concatenate(at), minlength=key.size).astype(np.float32)
    block, f = np.divmod(key, FEATURES)
    place = np.full(FEATURES, -1)
    place[common] = np.arange(common.size)
    often = place[f] >= 0
    counts = np.zeros((base, common.size), dtype=np.float32)
    counts[block[often], place[f[often]]] = value[often]
    sums = counts @ basis[common]
    rare_block, rare_f, rare_value = block[~often], f[~often], value[~often, None]
    if rare_f.size:
        first = np.flatnonzero(np.concatenate(([True], rare_block[1:] != rare_block[:-1])))
        sums[rare_block[first]] += np.add.reduceat(basis[rare_f] * rare_value, first, axis=0)
    square = np.bincount(block, weights=value.astype(np.float64) ** 2, minlength=base + 1)
    after = np.minimum(np.searchsorted(key, key + FEATURES), max(0, key.size - 1))
    shared = np.bincount(block, weights=np.where(key[after] == key + FEATURES, value * value[after], 0.0), minlength=base)
    norm = square[:-1] + square[1:] + 2 * shared
    norm = np.where(begins & (norm > 0), norm, np.inf)
    scaled = ((sums + np.concatenate((sums[1:], np.zeros_like(sums[:1])))) / norm[:, None]).astype(np.float32)
    scaled[1:] += scaled[:-1].copy()  # a block is in the passage that begins with it and in the one before
    out = np.zeros_like(basis)
    out[common] = counts.T @ scaled
    if rare_f.size:
        order = np.argsort(rare_f, kind="stable")
        rare_f = rare_f[order]
        first = np.flatnonzero(np.concatenate(([True], rare_f[1:] != rare_f[:-1])))
        out[rare_f[first]] += np.add.reduceat(scaled[rare_block[order]] * rare_value[order], first, axis=0)
    return out


def _corpus_step(corpus: DataFrame, feature: np.ndarray, weights: np.ndarray, basis: np.ndarray, common: np.ndarray) -> np.ndarray:
    """``A'(A basis)`` for all passages of the corpus. Tasks' products travel in pieces; the driver gets their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = np.zeros(basis.shape), [], 0
        for batch in batches:
            for own in batch.column(0):
                held.append(np.frombuffer(own.as_buffer(), dtype=np.int32))
                size += held[-1].size + BLOCK
                if size > 50_000:
                    part += _passage_step(held, feature, weights, basis, common)
                    held, size = [], 0
        if held:
            part += _passage_step(held, feature, weights, basis, common)
        task = TaskContext.get().partitionId()
        for at in range(0, len(part), SUMMED):
            piece = part[at:at + SUMMED]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([task], pa.int32()), pa.array([piece.astype(np.float32).tobytes()], pa.binary())],
                                                 ["at", "task", "part"])

    def add(rows: pa.Table) -> pa.Table:
        total = 0.0
        for part in rows.sort_by("task").column("part"):  # in one order, so that sums repeat
            total = total + np.frombuffer(part.as_buffer(), dtype=np.float32).astype(np.float64)
        return pa.table({"at": rows.column("at")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(basis.shape)
    parts = corpus.select("words").mapInArrow(run, "at int, task int, part binary")
    for r in parts.groupBy("at").applyInArrow(add, "at int, part binary").collect():  # one matrix in pieces
        piece = np.frombuffer(r.part).reshape(-1, basis.shape[1])
        out[r["at"]:r["at"] + len(piece)] = piece
    return out


def latent_space(items: Items, corpus: DataFrame, frequency: np.ndarray, documents: int, rank: int = RANK, seed: int = 5) -> Space:
    """Randomised subspace iteration on the Gram matrix of the TF-IDF rows of all items and all passages of the corpus."""
    weights = word_weights(frequency, documents)
    rng = np.random.default_rng(seed)
    feature = rng.permutation(frequency.size) % FEATURES
    size = min(FEATURES, frequency.size)
    basis = np.linalg.qr(rng.normal(size=(FEATURES, min(rank + 16, size))))[0].astype(np.float32)
    item_share = max(1.0, documents / len(items.ids))  # items weigh about as much as the documents
    often = np.argsort(-frequency[1:], kind="stable") + 1
    common = np.unique(feature[often[:DENSE]])
    for _ in range(POWER_STEPS + 1):
        step = basis
        total = _gram_step(items.words, feature, weights, step) * item_share + _corpus_step(corpus, feature, weights, step, common)
        basis = np.linalg.qr(total)[0].astype(np.float32)
    small = step.T @ total
    values, turn = np.linalg.eigh((small + small.T) / 2)
    axes = (step @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)
    word_vectors = (axes[feature] * weights[:, None]).astype(np.float32)
    item_vectors = np.stack([_unit(word_vectors[w].sum(axis=0)) for w in items.words])
    return Space(word_vectors, item_vectors, weights, often[:COMMON])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << item.size) - 1
    for w in region.tolist():
        if w in places:
            taken = row & places[w]
            row = ((row + taken) | (row - taken)) & full
    return (full & ~row).bit_count()


def judged(item: np.ndarray, region: np.ndarray, weights: np.ndarray, marked: np.ndarray | None = None,
           own: np.ndarray | None = None, back: np.ndarray | None = None) -> float | None:
    """Share of the item in the longest common subsequence if the region gives the item away, else null.

    ``marked``: a scratch array of zeros for every word, left as it was; ``own``: the weights of the item's words;
    ``back``: their running sums from the last word on.
    """
    marked = np.zeros(weights.size) if marked is None else marked
    own = weights[item] if own is None else own
    back = np.cumsum(own[::-1]) if back is None else back
    marked[region] = 1.0
    held = marked[item]
    marked[region] = 0.0
    if own @ held < RARE_SHARE * back[-1]:
        return None
    share = common_subsequence(item, region) / item.size
    if share >= COPY:
        return share
    tail = slice(-max(ANSWER_WORDS, int(np.searchsorted(back, ANSWER_WEIGHT * back[-1])) + 1), None)
    if share >= PARAPHRASE and own[tail] @ held[tail] >= ANSWER_SHARE * own[tail].sum():
        return share
    return None


@dataclass
class Postings:
    """For each word the items that look for it, with the weight it has in each."""

    begins: np.ndarray  # of a word's entries, by word number
    item: np.ndarray
    weight: np.ndarray
    needed: np.ndarray  # the weight of an item's looked-for words without which nothing is confirmed
    reach: np.ndarray  # blocks on either side of a passage that an item's region touches
    words: list[np.ndarray]  # each item's distinct words
    shares: list[np.ndarray]  # what each of them adds to the weight that a region holds
    place: np.ndarray  # scratch: -1 for every word
    own: list[np.ndarray]  # weights of each item's words
    back: list[np.ndarray]  # their running sums from the last word on

    @staticmethod
    def of(items: Items, weights: np.ndarray) -> Postings:
        words, owners, held, needed = [], [], [], []
        for i, item in enumerate(items.words):
            own, count = np.unique(item, return_counts=True)
            own_weight = weights[own] * count
            order = np.argsort(own_weight, kind="stable")
            total = np.cumsum(own_weight[order])
            light = int(np.searchsorted(total, LIGHT * total[-1], side="right"))
            words.append(own[order[light:]])
            held.append(own_weight[order[light:]])
            owners.append(np.full(own.size - light, i))
            needed.append(RARE_SHARE * total[-1] * (1 - 1e-9) - (total[light - 1] if light else 0.0))
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")
        every = [weights[w] for w in items.words]
        distinct = [np.unique(w, return_counts=True) for w in items.words]
        return Postings(np.searchsorted(word[order], np.arange(weights.size + 1)), np.concatenate(owners)[order], np.concatenate(held)[order],
                        np.array(needed), np.array([-(-w.size // BLOCK) for w in items.words]), [w for w, _ in distinct], [weights[w] * n for w, n in distinct],
                        np.full(weights.size, -1), every, [np.cumsum(x[::-1]) for x in every])

    def heavy(self, i: int, flat: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        """Which regions, ``length`` words of texts ``flat[low:high]`` from ``begin`` on, hold the weight that item ``i`` needs."""
        words, out = self.words[i], []
        self.place[words] = np.arange(words.size)
        rows = max(1, 2_000_000 // length)
        for at in range(0, begin.size, rows):
            part = slice(at, at + rows)
            place = (low + begin)[part, None] + np.arange(length)
            inside = (place >= low[part, None]) & (place < high[part, None])
            held = np.zeros((len(place), words.size + 1), dtype=bool)
            held[np.arange(len(place))[:, None], np.where(inside, self.place[flat[np.clip(place, 0, flat.size - 1)]], -1)] = True
            enough = held[:, :-1] @ self.shares[i] >= RARE_SHARE * self.back[i][-1] * (1 - 1e-9)
            out.append(at + np.flatnonzero(enough))
        self.place[words] = -1
        return np.concatenate(out)

    def able(self, words: np.ndarray, block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, item) of every passage, given by its first block, whose region may hold what the item needs; some that do not."""
        block, word = np.divmod(np.unique(block * self.begins.size + words), self.begins.size)
        entries = self.begins[word + 1] - self.begins[word]
        at = np.repeat(self.begins[word] - np.cumsum(entries) + entries, entries) + np.arange(entries.sum())
        width = blocks + 2 * int(self.reach.max()) + 2  # keeps the blocks of one item from reaching into another's
        place, where = np.unique(self.item[at] * width + np.repeat(block, entries), return_inverse=True)
        total = np.concatenate(([0.0], np.cumsum(np.bincount(where, weights=self.weight[at], minlength=place.size))))
        item, first = np.divmod(place, width)
        reach = self.reach[item]
        held = total[np.searchsorted(place, place + 2 * reach + 2)] - total[:-1]  # from this block on, as many as a region touches
        some = held >= self.needed[item] - 1e-9 * total[-1]
        item, first, reach = item[some], first[some], reach[some]
        many = 2 * reach + 2
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        passage, item = np.repeat(first - reach - 1, many) + step, np.repeat(item, many)
        inside = (passage >= 0) & (passage < blocks)
        return passage[inside], item[inside]


def leaks(df: DataFrame, benchmark: DataFrame, close: float = CLOSE, block: int = ITEMS) -> DataFrame:
    """``(doc_id, item_id, cosine, share)`` for every document and item that gives the item away, once a pair.

    Every passage of every text is searched against all items, ``block`` items at a time; ``close`` only adds
    candidates, no pair that can be confirmed is lost below it. The driver and each
    task hold one block's words and vectors. Null and empty texts and items match nothing; of repeated rows
    each counts as the same document; rows without an id are searched and reported with a null id. Empty
    tables give an empty one; other columns are not read.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").distinct().withColumn(
        "__at", F.floor(F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 30)) / F.lit((1 << 30) / max(1, -(-benchmark.count() // block)))))
    found = None
    for part in [r[0] for r in rows.select("__at").distinct().orderBy("__at").collect()]:
        own = rows.filter(F.col("__at") == part).orderBy("item_id", "text").collect()
        items = Items.of([(r.item_id, r.text) for r in own])
        if items.ids:
            one = _search(df, items, close)
            found = one if found is None else found.union(one)
    if found is None:
        return df.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, share double")
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("share").alias("share"))


def _search(df: DataFrame, items: Items, close: float) -> DataFrame:
    corpus, frequency, documents = numbered(df, items.vocabulary)
    space = latent_space(items, corpus, frequency, documents)
    sent = df.sparkSession.sparkContext.broadcast(
        (items.ids, items.words, space.word_vectors, space.item_vectors, space.weights, space.common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, *vectors = sent.value
        items, space = Items(ids, words, {}), Space(*vectors)
        postings = Postings.of(items, space.weights)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [np.frombuffer(w.as_buffer(), dtype=np.int32) for w in batch.column(1)]
            start = 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held + texts[end].size <= 100_000):
                    held += texts[end].size
                    end += 1
                out = _close_items(ids[start:end], texts[start:end], items, space, postings, close)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "cosine", "share"])
                start = end

    found = stage(corpus.mapInArrow(run, "doc_id long, item_id long, cosine double, share double"))
    sent.destroy()
    return found


def _close_items(ids: list, texts: list[np.ndarray], items: Items, space: Space, postings: Postings, close: float) -> list[tuple]:
    """Confirmed leaks of some documents: passages are pairs of neighbouring blocks, single ones at the ends too."""
    known, block, base = [], [], 0
    bases = []
    for words in texts:
        w, b = passages(words)
        known.append(w)
        block.append(b + base)
        bases.append(base)
        base += -(-words.size // BLOCK) + 1  # an empty block keeps documents apart
    words, blocks = np.concatenate(known), np.concatenate(block)
    if not words.size:
        return []
    sums = space.block_sums(words, blocks, base + 1)
    cosine = _unit(sums[:-1] + sums[1:]) @ space.item_vectors.T
    able = postings.able(words, blocks, base)
    where, item = np.divmod(np.union1d(np.flatnonzero(cosine >= close), able[0] * len(items.ids) + able[1]), len(items.ids))
    document = np.searchsorted(bases, where, side="right") - 1
    order = np.argsort(item, kind="stable")
    where, item, document = where[order], item[order], document[order]
    begin = (where - np.array(bases)[document]) * BLOCK
    flat, starts = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    marked = np.zeros(space.weights.size)
    out = []
    for i, first, last in zip(*_runs(item)):
        own, seen = items.words[i], set()
        part = slice(first, last)
        heavy = first + postings.heavy(i, flat, starts[document[part]], starts[document[part] + 1], begin[part] - own.size, 2 * (BLOCK + own.size))
        for at in heavy.tolist():
            d = int(document[at])
            if d in seen:
                continue
            region = texts[d][max(0, begin[at] - own.size):begin[at] + 2 * BLOCK + own.size]
            share = judged(own, region, space.weights, marked, postings.own[i], postings.back[i])
            if share is not None:
                seen.add(d)
                out.append((ids[d], items.ids[i], float(cosine[where[at], i]), share))
    return out


def _runs(x: np.ndarray) -> tuple[list, list, list]:
    """Value, begin and end of each run of equal values."""
    begins = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if x.size else np.zeros(0, np.int64)
    return x[begins].tolist(), begins.tolist(), np.append(begins[1:], x.size).tolist()

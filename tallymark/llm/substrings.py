"""Exact removal of repeated byte strings, by suffix sorting of the places where repeats can be.

Every ``length``-byte string has one anchor, the ``GRAM`` bytes of least hash in it (the leftmost of equals), so
two equal strings have equal anchors at equal places. Starts with the same anchor form a context. Contexts that
are equal as a whole are settled by their hash; contexts that only share their anchor are cut out of the texts,
brought together by anchor and sorted as suffixes, where equal strings stand next to each other.

Contexts are sorted in shards by Spark's shuffle, which spills to disk; the induced sorting inside a shard is in
memory, as a shard ends with the anchor that fills it. An anchor of more than one context in ``HOT`` sends its
strings one by one instead, dealt out by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import chunks, stage, widths
from tallymark.llm.shingles import INVERSE, MULTIPLIER, mixed
from tallymark.llm.suffixes import suffix_array

LENGTH = 100
GRAM = 32
HOT = 5_000
SAMPLE = 16  # one document in so many is read to find hot anchors, which only decide how rows are dealt out
SHARD_BYTES = 4_000_000
REPEAT, ASK, SINGLE = 1, 2, 3  # a settled repeat; a context to be cut out; one string of a hot anchor
NULL_ID = (1 << 63) - 1  # null ids come last
_ROW = "key long, other long, doc_id long, mark long, start long, size int, kind int"
_NAMES = ["key", "other", "doc_id", "mark", "start", "size", "kind"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


class Hashes:
    """Hashes of any byte range of a chunk of texts."""

    def __init__(self, data: np.ndarray):
        steps = np.full(data.size + 1, INVERSE, dtype=np.uint64)
        steps[0] = 1
        self.sums = np.zeros(data.size + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(steps)[:-1], out=self.sums[1:])
        steps[1:] = MULTIPLIER
        self.powers = np.cumprod(steps)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.powers[start])


def anchors(hashes: Hashes, size: int, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The anchor's place for each start of a string."""
    place = np.arange(size - gram + 1)
    packed = hashes(place, place + gram) >> np.uint64(32) << np.uint64(32) | place.astype(np.uint64)
    window, width = length - gram + 1, 1
    while width * 2 <= window:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    if width < window:
        packed = np.minimum(packed[:width - window], packed[window - width:])
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts(texts: list[bytes], hot: np.ndarray | None, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Contexts of some texts: text number, start, size (number of starts), anchor hash and context hash."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if data.size < length:
        return {k: np.zeros(0, dtype=np.int64) for k in ("text", "start", "size", "kind", "key", "other")}
    hashes = Hashes(data)
    at = anchors(hashes, data.size, length)
    text = np.repeat(np.arange(sizes.size), sizes)[:at.size]
    valid = np.arange(at.size) + length <= ends[text]
    start = np.flatnonzero(valid & np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    stop = np.flatnonzero(valid & np.concatenate(((at[1:] != at[:-1]) | ~valid[1:] | (text[1:] != text[:-1]), [True])))
    anchor, size = at[start], stop - start + 1
    key = hashes(anchor, anchor + GRAM)
    other = hashes(start, stop + length) ^ mixed((anchor - start).astype(np.uint64) << np.uint64(32) | size.astype(np.uint64))
    kind = np.full(start.size, ASK)
    if hot is not None and hot.size:
        found = np.searchsorted(hot, key)
        is_hot = hot[np.minimum(found, hot.size - 1)] == key
        if is_hot.any():
            times, first = size[is_hot], start[is_hot]
            single = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            own = hashes(single, single + length)
            cold = ~is_hot
            start, size = np.concatenate((start[cold], single)), np.concatenate((size[cold], np.ones_like(single)))
            key = np.concatenate((key[cold], mixed(own + np.repeat(key[is_hot], times))))
            other, kind = np.concatenate((other[cold], own)), np.concatenate((kind[cold], np.full(single.size, SINGLE)))
    own_text = text[start]
    return {"text": own_text, "start": start - (ends - sizes)[own_text], "size": size, "kind": kind,
            "key": key.view(np.int64), "other": other.view(np.int64)}


def _marks(texts: list[bytes]) -> np.ndarray:
    """Tells apart different texts under one id; equal rows under one id count as one document."""
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts], dtype=np.int64)


def _encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _later(key, other, doc_id, mark, start) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, context, document and place; and for each place in that order whether its context stood before."""
    order = np.lexsort((start, mark, doc_id, other, key))
    same = np.zeros(order.size, dtype=bool)
    a, b = order[:-1], order[1:]
    same[1:] = (key[a] == key[b]) & (other[a] == other[b])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(order.size)))
    f = order[first]
    return order, same & ~((doc_id[f] == doc_id[order]) & (mark[f] == mark[order]) & (start[f] == start[order]))


def _emitted(df: DataFrame, hot: np.ndarray) -> DataFrame:
    """Contexts of all texts; those that stood before in the same chunk are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, strings in chunks(batches):
            texts = _encoded(strings)
            c = contexts(texts, hot)
            doc_id = np.array([NULL_ID if i is None else i for i in ids], dtype=np.int64)[c["text"]]
            mark = _marks(texts)[c["text"]]
            order, later = _later(c["key"], c["other"], doc_id, mark, c["start"])
            kind = np.where(later, REPEAT, c["kind"][order])
            key = np.where(later, mixed(order.astype(np.uint64)).view(np.int64), c["key"][order])
            yield _batch([key, np.where(later, 0, c["other"][order]), doc_id[order], mark[order], c["start"][order], c["size"][order], kind])

    return df.mapInArrow(run, _ROW)


def _settled(rows: DataFrame) -> DataFrame:
    """Repeats of whole contexts, and of anchors with several contexts the first place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def judged(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, other, doc_id, mark, start, size, kind = columns
            order, later = _later(key, other, doc_id, mark, start)
            key, other, doc_id, mark, start, size, kind = (c[order] for c in columns)
            kind = np.where(later & (kind != REPEAT), REPEAT, kind)
            asking = np.flatnonzero(kind == ASK)
            begins = np.flatnonzero(np.concatenate(([True], key[asking][1:] != key[asking][:-1]))) if asking.size else asking
            several = np.zeros(key.size, dtype=bool)
            if asking.size:
                a, b = np.minimum.reduceat(other[asking], begins), np.maximum.reduceat(other[asking], begins)
                several[asking] = np.repeat(a != b, np.diff(np.append(begins, asking.size)))
            keep = (kind == REPEAT) | several
            return _batch([c[keep] for c in (key, other, doc_id, mark, start, size, kind)])

        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(7)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            key = now[0]
            if not key.size:
                continue
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last anchor's rows may go on
            if cut:
                yield judged([c[:cut] for c in now])
            held = [c[cut:].copy() for c in now]
        if held is not None and held[0].size:
            yield judged(held)

    return rows.repartition(widths(rows), "key").sortWithinPartitions("key").mapInArrow(run, _ROW)


def _documents(df: DataFrame) -> DataFrame:
    """``(doc_id, mark, packed)``: compressed texts, once for each different row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for ids, strings in chunks(batches):
            texts = _encoded(strings)
            yield pa.RecordBatch.from_arrays(
                [pa.array([NULL_ID if i is None else i for i in ids], pa.int64()), pa.array(ids, pa.int64()), pa.array(_marks(texts)),
                 pa.array([packer.compress(t) for t in texts], pa.binary())], ["doc_id", "id", "mark", "packed"])

    return df.mapInArrow(run, "doc_id long, id long, mark long, packed binary")


def _cut_out(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of the asked contexts, by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, mark, packed, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                text = packer.decompress(packed)
                own = [(w["key"], doc_id, mark, w["start"], w["size"], text[w["start"]:w["start"] + w["size"] - 1 + LENGTH]) for w in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*own), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                    ["key", "doc_id", "mark", "start", "size", "bytes"])

    wanted = asked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "start", "size")).alias("wanted"))
    rows = docs.dropDuplicates(["doc_id", "mark"]).join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "packed", "wanted")
    return rows.mapInArrow(run, "key long, doc_id long, mark long, start long, size int, bytes binary")


def _sorted_repeats(cut: DataFrame) -> DataFrame:
    """Strings that stand after an equal one in their anchor's suffix order but not first in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield shard_repeats(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield shard_repeats(held)

    return cut.repartition(widths(cut), "key").sortWithinPartitions("key").select(
        "key", "doc_id", "mark", "start", "size", "bytes").mapInArrow(run, _ROW)


def shard_repeats(rows: list[tuple], length: int = LENGTH) -> pa.RecordBatch:
    """Repeats among the contexts of a shard, from suffix order and common prefixes of neighbours.

    Bytes are read as one less than 255 at most, so that 1 can end each context: UTF-8 has no bytes 254 and 255.
    """
    lengths = np.array([len(r[5]) for r in rows])
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    text = np.frombuffer(b"\xff".join([*(r[5] for r in rows), b""]), dtype=np.uint8) + np.uint8(2)  # the end mark becomes 1
    row = np.repeat(np.arange(lengths.size), lengths + 1)
    starts = np.array([r[4] for r in rows])
    offset = np.arange(text.size) - begins[row]
    order = suffix_array(text)
    order = order[offset[order] < starts[row[order]]]  # only strings that the context owns
    equal = np.zeros(order.size, dtype=bool)
    equal[1:] = _share_prefix(text, order[:-1], order[1:], length)
    doc_id, mark, start = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))
    own = row[order]
    place = start[own] + offset[order]
    run = np.cumsum(~equal)
    rank = np.lexsort((place, mark[own], doc_id[own], run))  # the first of each run is the string's first place
    own, place, run, order = own[rank], place[rank], run[rank], order[rank]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], run[1:] != run[:-1])), np.arange(run.size), 0))
    later = (doc_id[own] != doc_id[own[first]]) | (mark[own] != mark[own[first]]) | (place != place[first])
    own, place = own[later], place[later]
    again = np.lexsort((place, own))  # neighbouring starts of one context become one range
    own, place = own[again], place[again]
    begin = np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1))) if own.size else np.zeros(0, dtype=bool)
    at = np.flatnonzero(begin)
    count = np.diff(np.append(at, own.size))
    own, place = own[at], place[at]
    zero = np.zeros(own.size, dtype=np.int64)
    return _batch([zero, zero, doc_id[own], mark[own], place, count, np.full(own.size, REPEAT)])


def _share_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    out = np.ones(a.size, dtype=bool)
    open_ = np.arange(a.size)
    step = 0
    while open_.size and step < length:
        differ = text[a[open_] + step] != text[b[open_] + step]
        out[open_[differ]] = False
        open_ = open_[~differ]
        step += 1
    return out


def without_repeats(df: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row.

    A byte goes if a 100-byte string over it also starts earlier: in a document of smaller id, or before in the
    same one; strings are judged on the input and never cross documents. Null texts are empty; texts under 100
    bytes lose nothing. Null ids come after all others. Rows with the same id and text are one document, so each
    gets that document's result; different texts under one id are told apart. An empty table gives an empty one;
    other columns are not read. Texts are read whole.
    """
    df = df.select(F.col("doc_id").cast("long"), "text")
    rows = _settled(_emitted(df, _hot(df)))
    found = stage(rows)
    docs = _documents(df)
    more = _sorted_repeats(_cut_out(found.filter(F.col("kind") == ASK), docs))
    repeats = found.filter(F.col("kind") == REPEAT).unionByName(more)
    spans = repeats.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            starts = batch.column(2)
            for i, (doc_id, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                out.append((doc_id, *kept(packer.decompress(packed.as_py()), starts[i].as_py() or [])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = docs.join(spans, ["doc_id", "mark"], "left").select("id", "packed", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept(text: bytes, spans: list[dict]) -> tuple[int, int, int, str]:
    """Size, bytes removed, maximal runs removed and digest of the rest; spans are ranges of string starts."""
    change = np.zeros(len(text) + 1, dtype=np.int32)
    if spans:
        start = np.array([s["start"] for s in spans])
        size = np.array([s["size"] for s in spans])
        np.add.at(change, start, 1)
        np.add.at(change, start + size - 1 + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    rest = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if runs else text
    return len(text), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()


def _hot(df: DataFrame) -> np.ndarray:
    """Sorted hashes of anchors with more than one in ``HOT`` of the contexts of sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, strings in chunks(batches):
            keys, counts = np.unique(contexts(_encoded(strings), None)["key"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    sample = df.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(SAMPLE)) == 0)
    counted = stage(sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("n") > max(4, total / HOT)).select("key").collect()  # at most HOT rows
    return np.sort(np.array([r.key for r in rows], dtype=np.int64).view(np.uint64))

"""How far the sources of a language differ in vocabulary: exact shares of kept terms by source.

The kept terms of each language become minimal transducers (``transducer``), by which all text is counted again;
their lexicographic ordinals name the terms from then on and break ties.

Defined results. Null text, language and source are read as empty; a language or source may be the empty string.
Repeated rows count as often as they occur, also as documents of a term. A group without terms still has shares
(all from smoothing). A language without kept terms has pairs of value 0 and no terms. Empty table: no rows.
Further columns are not read. Texts are never cut; shares are exact integers at any count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallymark.llm.common import stage
from tallymark.llm.transducer import FOLD, WINDOW, Transducer, Vocabulary, build
from tallymark.operators.ordering import ranked

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
SHARD_TERMS = 100_000        # terms of one transducer: what one task builds
BROADCAST_BYTES = 64_000_000  # transducers sent out at a time; a larger vocabulary takes several passes over the text
TERMS_HELD = 500_000         # distinct terms a task holds before it hands them on
COUNTS_HELD = 2_000_000      # counts a task holds before it hands them on
ROWS_TOGETHER = 1000
BLOCK_TERMS, PAIR_SOURCES = 2048, 256  # a task compares so many terms of two times so many sources
ADDED_TOGETHER = 64          # tasks whose counts are added up first

# Counts of a group (a source of a language) travel as sparse arrays, one row for a block of terms: places in the block
# (32-bit) and counts (64-bit).
_BLOCK = "lang string, source string, block int, slot int, total long, places binary, counts binary"


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, smoothing: int = SMOOTHING, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` as parts ``pair`` (every other source) and ``term`` (first ``top``)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = kept_terms(docs, min_documents)
    langs = stage(terms.groupBy("lang").agg(F.count("*").alias("v")))
    groups = stage(ranked(docs.select("lang", "source").distinct(), ["lang", "source"], "gid"))
    counts = recounted(docs, transducers(terms)).join(groups, ["lang", "source"])
    counts = stage(counts.select("lang", "gid", "block", "total", "places", "counts"))
    groups, of_lang = _totals(counts, groups, langs, smoothing)
    counts = stage(counts.join(groups.select("gid", "v", F.col("total").alias("in_group"), F.col("lang_total")), "gid"))
    return _pairs(counts, groups, of_lang, smoothing).unionByName(_terms(counts, groups, terms, smoothing, top))


def kept_terms(docs: DataFrame, min_documents: int) -> DataFrame:
    """Staged ``(lang, term, ordinal)``: terms in at least so many of the language's documents, numbered from 0 in byte order."""
    held = docs.select("lang", "text").mapInArrow(_document_terms, "lang string, term string, n long")
    terms = held.groupBy("lang", "term").agg(F.sum("n").alias("count"))
    terms = ranked(terms.filter(F.col("count") >= min_documents).select("lang", "term"), ["lang", "term"], "place")
    terms = stage(terms)
    first = stage(terms.groupBy("lang").agg(F.min("place").alias("first")))
    return stage(terms.join(first, "lang").select("lang", "term", (F.col("place") - F.col("first")).alias("ordinal")))


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, term, n)``: how many documents of the task hold a term."""
    spaced = bytes(b or 32 for b in FOLD)  # folded, and a space for every byte that is not of a term
    counts: dict[str, Counter] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_TOGETHER):
            part = batch.slice(at, ROWS_TOGETHER)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
                counts.setdefault(lang, Counter()).update(_distinct(text.translate(spaced)))
            if sum(map(len, counts.values())) > TERMS_HELD:
                yield _terms_batch(counts)
                counts = {}
    yield _terms_batch(counts)


def _distinct(text: bytes) -> set[bytes]:
    found, at = set(), 0
    while at < len(text):  # a window at a time, each up to a space
        end = text.find(b" ", at + WINDOW) if at + WINDOW < len(text) else -1
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def _terms_batch(counts: dict[str, Counter]) -> pa.RecordBatch:
    lang = pa.array([lang for lang, c in counts.items() for _ in range(len(c))], pa.string())
    term = pa.array([t for c in counts.values() for t in c], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, term, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["lang", "term", "n"])


def transducers(terms: DataFrame) -> DataFrame:
    """Staged transducers, each of at most ``SHARD_TERMS`` successive terms of a language."""
    shard = F.floor(F.col("ordinal") / SHARD_TERMS).cast("int").alias("shard")
    fields = "lang string, shard int, first binary, start long, root int, size long, tables array<binary>"

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ordinal")
        words = rows.column("term").cast(pa.binary()).to_pylist()
        t = build(words)
        return pa.table({
            "lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int32()), "first": [words[0]],
            "start": [rows.column("ordinal")[0].as_py()], "root": pa.array([t.root], pa.int32()), "size": [t.nbytes],
            "tables": [[a.tobytes() for a in (t.check, t.target, t.output, t.final)]]})

    return stage(terms.select("*", shard).groupBy("lang", "shard").applyInArrow(built, fields))


def recounted(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """``(lang, source, block, total, places, counts)``: occurrences of every kept term, from all text run through the transducers.

    Transducers reach the tasks by broadcast, ``BROADCAST_BYTES`` at a time; the counts of each pass are staged.
    """
    sc = docs.sparkSession.sparkContext
    passes, held = [[]], 0
    for row in shards.select("lang", "shard", "size").orderBy("lang", "shard").collect():  # a row for SHARD_TERMS terms
        if held and held + row.size > BROADCAST_BYTES:
            passes.append([])
            held = 0
        passes[-1].append(row)
        held += row.size
    counts, tasks = None, docs.rdd.getNumPartitions()
    for rows in passes:
        wanted = F.lit(False)
        if rows:
            low, high = (F.struct(F.lit(r.lang), F.lit(r.shard)) for r in (rows[0], rows[-1]))
            wanted = F.struct("lang", "shard").between(low, high)
        loaded = [
            (r.lang, bytes(r.first), r.start, Transducer(r.root, *(np.frombuffer(t, d) for t, d in zip(r.tables, (np.int32, np.int32, np.int32, np.uint8)))))
            for r in shards.filter(wanted).orderBy("lang", "shard").collect()]  # at most BROADCAST_BYTES, or one transducer
        sent = sc.broadcast(Vocabulary(loaded))
        part = docs.select("lang", "source", "text").mapInArrow(lambda batches, sent=sent: _counted(batches, sent.value), _BLOCK)
        part = part.groupBy("lang", "source", "block", "slot").applyInArrow(_added, _BLOCK)
        if tasks > ADDED_TOGETHER:
            part = part.groupBy("lang", "source", "block", F.lit(0).alias("none")).applyInArrow(_added, _BLOCK)
        part = stage(part)
        sent.destroy()
        counts = part if counts is None else counts.unionByName(part)
    if len(passes) > 1:  # a term is in one pass only, but a block of terms may be in two
        counts = counts.groupBy("lang", "source", "block", F.lit(0).alias("none")).applyInArrow(_added, _BLOCK)
    return counts


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], int] = {}
    keys, counts, held = [], [], 0
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        group = np.array([groups.setdefault(name, len(groups)) for name in names], np.int64)
        if not len(texts):
            continue
        for text, ordinal in vocabulary.ordinals(data, offsets, [lang for lang, _ in names]):
            key, n = np.unique((group[text] << 40) | ordinal, return_counts=True)
            if not len(key):
                continue
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > COUNTS_HELD:
                keys, counts = ([x] for x in _merged(keys, counts))
                held = len(keys[0])
            if held > COUNTS_HELD:
                yield _batch(groups, keys, counts)
                keys, counts, held = [], [], 0
        if not held:
            groups = {}
    if keys:
        yield _batch(groups, *([x] for x in _merged(keys, counts)))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, place, np.concatenate(counts))
    return key, n


def _batch(groups: dict[tuple[str, str], int], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each group and block of terms."""
    group, ordinal = keys[0] >> 40, keys[0] & ((1 << 40) - 1)
    block, names = ordinal // BLOCK_TERMS, list(groups)
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (block[1:] != block[:-1]))))
    edges = np.append(first, len(group))
    lang, source = (pa.array([n[i] for n in names], pa.string()).take(pa.array(group[first])) for i in (0, 1))
    slot = TaskContext.get().partitionId() // ADDED_TOGETHER
    return pa.RecordBatch.from_arrays([
        lang, source, pa.array(block[first], pa.int32()), pa.array(np.full(len(first), slot), pa.int32()),
        pa.array(np.add.reduceat(counts[0], first)), _slices((ordinal - block * BLOCK_TERMS).astype(np.int32), edges), _slices(counts[0], edges),
    ], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _slices(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    offsets = pa.py_buffer((edges * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int64)


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """Rows of one group and block added up."""
    total = _summed(rows)
    places = np.flatnonzero(total)
    return pa.table({
        "lang": [key[0].as_py()], "source": [key[1].as_py()], "block": pa.array([key[2].as_py()], pa.int32()),
        "slot": pa.array([0], pa.int32()), "total": pa.array([int(total.sum())], pa.int64()),
        "places": pa.array([places.astype(np.int32).tobytes()], pa.binary()), "counts": pa.array([total[places].tobytes()], pa.binary())})


def _summed(rows: pa.Table) -> np.ndarray:
    total = np.zeros(BLOCK_TERMS, np.int64)
    for row in rows.select(["places", "counts"]).to_pylist():
        places, counts = _arrays(row)
        total[places] += counts
    return total


def shares(counts: np.ndarray, total: int, v: int, smoothing: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + smoothing) / (total + smoothing * v))``, exact: long division, three digits at a time."""
    below = total + smoothing * v
    if below >= 1 << 53:
        return np.array([1 + SCALE * (int(c) + smoothing) // below for c in counts], np.int64)
    out, rest = np.divmod(counts + smoothing, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def _totals(counts: DataFrame, groups: DataFrame, langs: DataFrame, smoothing: int) -> tuple[DataFrame, DataFrame]:
    """Staged groups with their sums and kept terms, and languages with theirs."""
    totals = counts.groupBy("gid").agg(F.sum("total").alias("total"))
    known = groups.join(totals, "gid", "left").join(langs, "lang", "left").select(
        "lang", "source", "gid", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    of_lang = stage(known.groupBy("lang").agg(
        F.max("v").alias("v"), F.sum("total").alias("lang_total"), F.min("gid").alias("first_gid"), F.count("*").alias("sources")))
    return stage(known.join(of_lang.select("lang", "lang_total"), "lang")), of_lang


def _terms(counts: DataFrame, groups: DataFrame, terms: DataFrame, smoothing: int, top: int) -> DataFrame:
    """Terms of each group that its language holds a smaller share of. A task takes a block of terms of some sources."""
    whole = counts.select("lang", "block", F.floor(F.col("gid") / PAIR_SOURCES).alias("slot"), "places", "counts")
    schema = "lang string, block int, places binary, counts binary"

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        total = _summed(rows)
        places = np.flatnonzero(total)
        return pa.table({
            "lang": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()),
            "places": pa.array([places.astype(np.int32).tobytes()], pa.binary()), "counts": pa.array([total[places].tobytes()], pa.binary())})

    whole = whole.groupBy("lang", "block", "slot").applyInArrow(added, schema).groupBy("lang", "block").applyInArrow(added, schema)
    both = counts.join(stage(whole).toDF("lang", "block", "in_lang", "lang_counts"), ["lang", "block"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places, own = _arrays(row)
                everywhere, n = np.frombuffer(row["in_lang"], np.int32), np.frombuffer(row["lang_counts"], np.int64)
                q = shares(n[np.searchsorted(everywhere, places)], row["lang_total"], row["v"], smoothing)
                value = shares(own, row["in_group"], row["v"], smoothing) - q
                best = np.lexsort((places, -value))[:top]
                best = best[value[best] > 0]
                ordinal = places[best].astype(np.int64) + row["block"] * BLOCK_TERMS
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["lang"]] * len(best), pa.string()), pa.array(np.full(len(best), row["gid"]), pa.int64()), pa.array(ordinal),
                    pa.array(value[best])], names=["lang", "gid", "ordinal", "value"])

    found = both.mapInArrow(over, "lang string, gid long, ordinal long, value long")  # at most ``top`` for each group and block
    place = F.row_number().over(Window.partitionBy("gid").orderBy(F.col("value").desc(), "ordinal"))
    best = stage(found.withColumn("rank", place).filter(F.col("rank") <= top))
    named = best.join(terms, ["lang", "ordinal"]).join(groups.select("gid", "source"), "gid")
    return named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(counts: DataFrame, groups: DataFrame, of_lang: DataFrame, smoothing: int) -> DataFrame:
    """Sums of share differences of all pairs of sources of a language, block of terms by block of terms.

    A language's terms and sources are cut into blocks; a task takes one block of terms for two blocks of sources and
    gives one sum per pair.
    """
    part = F.floor((F.col("gid") - F.col("first_gid")) / PAIR_SOURCES).cast("int")
    last_part = F.floor((F.col("sources") - 1) / PAIR_SOURCES).cast("int")
    last_block = F.floor(F.greatest(F.col("v") - 1, F.lit(0)) / BLOCK_TERMS).cast("int")
    placed = stage(groups.join(of_lang.select("lang", "first_gid", "sources"), "lang").select(
        "lang", "gid", "v", F.col("total").alias("in_group"), part.alias("part"), last_part.alias("last_part"), last_block.alias("last_block")))
    present = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("last_block"))).alias("block"))
    rows = present.join(counts.select("gid", "block", "places", "counts"), ["gid", "block"], "left").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("last_part"))))
    rows = rows.select("lang", "block", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "gid", "v", "in_group", "places", "counts")
    sums = rows.groupBy("lang", "block", "a", "b").applyInArrow(
        lambda key, rows: _differences(key, rows, smoothing), "gid long, other long, value long")
    sums = stage(sums.groupBy("gid", "other").agg(F.sum("value").alias("value")))
    named = sums.join(groups.select("gid", "lang", "source"), "gid").join(
        groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    place = F.row_number().over(Window.partitionBy("gid").orderBy(F.col("value").desc(), "other"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))


def _differences(key: tuple, rows: pa.Table, smoothing: int) -> pa.Table:
    block, a, b = (k.as_py() for k in key[1:])
    rows = rows.sort_by("gid").select(["part", "gid", "v", "in_group", "places", "counts"]).to_pylist()
    v = rows[0]["v"]
    width = max(0, min(BLOCK_TERMS, v - block * BLOCK_TERMS))
    sides = []
    for side in (a, b):
        mine = [r for r in rows if r["part"] == side]
        table = np.zeros((len(mine), width), np.int64)
        for i, r in enumerate(mine):
            if r["places"] is not None:
                places, counts = _arrays(r)
                table[i, places] = counts
            if width:
                table[i] = shares(table[i], r["in_group"], v, smoothing)
        sides.append((np.array([r["gid"] for r in mine], np.int64), table))
    (ids, table), (others, against) = sides
    first, second, value = [], [], []
    for i in range(len(ids)):
        sums = np.abs(against - table[i]).sum(axis=1)
        keep = others != ids[i]
        first.append(np.full(keep.sum(), ids[i]))
        second.append(others[keep])
        value.append(sums[keep])
    first, second, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second, value))
    if a != b:
        first, second, value = np.r_[first, second], np.r_[second, first], np.r_[value, value]
    return pa.table({"gid": pa.array(first, pa.int64()), "other": pa.array(second, pa.int64()), "value": pa.array(value, pa.int64())})

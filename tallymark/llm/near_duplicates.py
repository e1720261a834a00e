"""Near-duplicate documents by chosen-path set similarity join.

Equal shingle sets form classes. In several trees every class follows minwise values of its sketch: a node
holds the classes that agree in all values chosen on the way to it, two at the root. Small nodes are compared
exhaustively by their sketches. A large node whose members are alike is a cluster; any other large node branches on
two more values. What likeness of sketches and clusters connects is a group. Its full sets travel once, to blocks of
the group, where all pairs are confirmed. Groups of several blocks that are still in several parts after that are
cut to members that share rare shingles, which loses no link, and their blocks are compared two by two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallymark.llm.common import chunks, stage
from tallymark.llm.components import components
from tallymark.llm.shingles import shingle_sets, sketches

WIDTH = 64  # minwise values of a sketch, two bytes of each
TREES = 16  # all of one sketch; a pair at the threshold is missed by all of them about once in 30,000
SMALL = 64  # classes in a node that is compared exhaustively
DEPTH = 12
ALIKE = 0.5  # mean agreement with a member from which a large node is a cluster
PIVOTS = 4
CHUNK = 2_000_000  # bytes of texts, or of a block's sets, held at a time
BLOCK, BLOCKS = 64, 40  # classes in a block of a group, and so many blocks before they grow up to CHUNK
COLUMNS = 4096  # shingles counted at a time
HOPEFUL = 34  # of 64 values agree: a pair at the threshold stays below it about once in 25,000
THRESHOLD = (75, 100)


def sketched(df: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, key, sketch)``: ``key`` is the same for equal sets only; null for empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, limit=CHUNK):
            sets = shingle_sets(texts)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
            values = pa.array((sketches(sets, WIDTH) & 65535).astype(np.uint16).view(np.int16).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * WIDTH, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s.size for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists],
                ["doc_id", "n_shingles", "key", "sketch"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, sketch array<smallint>")


def _agree(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)


def _children(rows: DataFrame, ways: int, values: int = 1) -> DataFrame:
    """Each class goes on to ``ways`` nodes, by the sketch values that its node chooses, ``values`` for each."""
    value = lambda w: F.get("sketch", F.pmod(F.xxhash64("node", F.lit(w)), F.lit(WIDTH)).cast("int"))
    nodes = F.array(*[F.xxhash64("node", F.lit(w), *[value(w + ways * i) for i in range(values)]) for w in range(ways)])
    return rows.select(F.explode(nodes).alias("node"), *[c for c in rows.columns if c != "node"])


def _hopeful(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sketches agree enough, and the sizes of the sets allow the similarity."""
    return (agree >= HOPEFUL) & (THRESHOLD[1] * np.minimum(n, m) >= THRESHOLD[0] * np.maximum(n, m))


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as arrays; the sketches as one matrix."""
    out = []
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        flat = name == "sketch"
        out.append(column.flatten().to_numpy().reshape(-1, WIDTH) if flat else column.to_numpy())
    return out


def _least(own: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest of ``own`` that each one is connected with by the links of a symmetric matrix."""
    least = own
    while True:
        now = np.minimum(least, np.where(linked, least[None, :], least.max()).min(axis=1))
        if (now == least).all():
            return least
        least = now


def _edges(own: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
    """An edge from each one to the smallest it is connected with: as many rows as there are members at most."""
    least = _least(own, linked)
    some = least < own
    return pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(least[some])], ["a", "b"])


def _leaf_edges(rows: DataFrame) -> DataFrame:
    """Edges that connect, within each node, what sketches that agree enough do; nodes are small."""

    def compared(node, rep, n, sketch) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1, [node.size]))
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if end - start > 1:
                own = slice(start, end)
                agree = (sketch[own][:, None, :] == sketch[own][None, :, :]).sum(axis=2)
                hopeful = _hopeful(agree, n[own][:, None], n[own][None, :])
                if hopeful.sum() > end - start:
                    yield _edges(rep[own], hopeful)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = _columns(batch, "node", "rep", "n", "sketch")
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if now[0].size:
                cut = np.searchsorted(now[0], now[0][-1])  # the last node may go on
                yield from compared(*(c[:cut] for c in now))
                held = [c[cut:].copy() for c in now]
        if held is not None:
            yield from compared(*held)

    return rows.repartition("node").sortWithinPartitions("node").select("node", "rep", "n", "sketch").mapInArrow(run, "a long, b long")


def _groups(classes: DataFrame) -> DataFrame:
    """``(rep, node)`` of all classes that may be linked: classes of different nodes are not.

    Only rows that share a node get their sketches joined, once; from then on they carry them.
    """
    roots = F.explode(F.array(*[F.xxhash64(F.lit(tree)) for tree in range(TREES)]))
    first = _children(classes.select(roots.alias("node"), "rep", "sketch"), 1, 2).select("node", "rep")
    shared = first.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1").select("node")
    nodes = first.join(shared, "node").join(classes, "rep").select("node", "rep", "n", "sketch")
    found = []
    for depth in range(DEPTH):
        nodes = stage(nodes)
        member = F.struct("rep", "sketch")
        size = stage(nodes.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1"))
        found.append(_leaf_edges(nodes.join(size.filter(F.col("members") <= SMALL), "node")))
        if size.filter(F.col("members") > SMALL).isEmpty():
            break
        large = nodes.join(size.filter(F.col("members") > SMALL).select("node"), "node")
        pivots = stage(large.groupBy("node").agg(F.array_distinct(F.array(
            F.min(member), *[F.min_by(member, F.xxhash64("rep", F.lit(p))) for p in range(1, PIVOTS)])).alias("pivots")))
        met = large.join(pivots, "node").select("node", F.transform("pivots", lambda p: _agree(F.col("sketch"), p["sketch"])).alias("met"))
        mean = F.aggregate("met", F.lit(0), lambda acc, x: acc + x) / F.size("met")
        dense = stage(met.groupBy("node").agg(F.avg(mean).alias("mean")).filter(
            F.lit(depth == DEPTH - 1) | (F.col("mean") >= ALIKE * WIDTH)).select("node"))
        middle = dense.join(pivots.select("node", F.col("pivots")[0]["rep"].alias("b")), "node")
        found.append(large.join(middle, "node").select(F.col("rep").alias("a"), "b"))
        nodes = _children(large.join(dense, "node", "left_anti"), 2)
    return components(_union(found)).select(F.col("x").alias("rep"), F.col("component").alias("node"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return frames[0] if len(frames) == 1 else frames[0].union(_union(frames[1:]))


def _blocks(members: DataFrame) -> DataFrame:
    """Members ``(node, rep, bytes)`` with the number of their node's ``blocks``, the ``block`` of each, and whether it is a ``pivot``."""
    size = members.groupBy("node").agg(
        F.greatest(F.least(F.lit(BLOCKS), F.ceil(F.count("*") / BLOCK)), F.ceil(F.sum("bytes") / CHUNK)).cast("int").alias("blocks"),
        F.array(*[F.min_by("rep", F.xxhash64("rep", F.lit(p))) for p in range(PIVOTS)]).alias("pivots"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    return members.join(stage(size), "node").withColumn("block", block).withColumn("pivot", F.array_contains("pivots", F.col("rep"))).drop("pivots")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` has in common with each of ``y``."""
    out = np.zeros((len(x), len(y)))
    common = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    if x is y:
        common, count = np.unique(np.concatenate(x), return_counts=True)
        common = common[count > 1]
        out[np.arange(len(x)), np.arange(len(x))] = [s.size for s in x]

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [s.size for s in sets])
        at = np.searchsorted(common, flat)
        held = common[np.minimum(at, common.size - 1)] == flat
        order = np.argsort(at[held], kind="stable")
        return at[held][order], row[held][order]

    if not common.size:
        return out
    sides = [placed(x)] if x is y else [placed(x), placed(y)]
    total = np.zeros(out.shape)
    for low in range(0, common.size, COLUMNS):
        high = min(low + COLUMNS, common.size)
        parts = []
        for (at, row), n in zip(sides, out.shape):
            own = slice(*np.searchsorted(at, (low, high)))
            part = np.zeros((n, high - low), dtype=np.float32)
            part[row[own], at[own] - low] = 1.0
            parts.append(part)
        total += parts[0] @ parts[-1].T
    return np.maximum(out, total)


def _alike(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``x`` are linked with which of ``y``."""
    both = _overlaps(x, y)
    sizes = np.array([s.size for s in x], dtype=float)[:, None] + np.array([s.size for s in y], dtype=float)[None, :]
    return THRESHOLD[1] * both >= THRESHOLD[0] * (sizes - both)


def _by_place(rows: DataFrame, compared, *names: str) -> DataFrame:
    """Edges that ``compared`` finds among the rows of each ``place``, given as arrays of ``names`` and a list of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sets = None, [], []
        for batch in batches:
            place, *columns = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names) + 1))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [place.size])).tolist()
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if at != place[start]:
                    if len(sets) > 1:
                        yield from compared(*(np.concatenate(c) for c in zip(*held)), sets)
                    at, held, sets = place[start], [], []
                held.append([c[start:end].copy() for c in columns])
                sets += [np.frombuffer(s.as_py(), dtype=np.uint64) for s in batch.column(len(names) + 1)[start:end]]
        if len(sets) > 1:
            yield from compared(*(np.concatenate(c) for c in zip(*held)), sets)

    return rows.repartition("place").sortWithinPartitions("place").select("place", *names, "set").mapInArrow(run, "a long, b long")


def _within_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges that connect what links within each block do; a few members meet every block of their node."""
    every = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = placed.select("rep", "node", F.explode(every).alias("at")).select("rep", F.xxhash64("node", "at").alias("place"))

    def compared(rep: np.ndarray, own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield _edges(rep, _alike(own, own))

    return _by_place(rows.join(sets, "rep"), compared, "rep")


def _sets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(rep, set)`` of the wanted classes, from the text of the document that names each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, limit=CHUNK):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["rep", "set"])

    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = own.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return rows.mapInArrow(run, "rep long, set binary")


def near_duplicates(df: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row; ids are expected to be unique.

    Links are pairs whose sets of five-word shingles have a similarity of 0.75 or more; a component is named by
    its smallest id, which alone is kept. Null, empty and white-space texts have no shingles and form components
    of their own. A row without an id belongs to the component of its text, is never the one kept and names
    none. Repeated rows repeat. An empty table gives an empty one; other columns are not read.
    """
    rows = stage(sketched(df))
    own = rows.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stage(own.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("m")).select(
        "key", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n"), F.col("m.sketch").alias("sketch")))
    groups = _groups(classes.select("rep", "n", "sketch"))
    sets = stage(_sets(df, groups))
    placed = stage(_blocks(groups.join(classes.select("rep", (F.col("n") * 8).alias("bytes")), "rep")))
    links, labels = stage(_within_blocks(placed, sets)), None
    if not links.isEmpty():
        labels = components(links)
    several = placed.filter("blocks > 1")
    if not several.isEmpty():
        more = stage(_between_parts(several, labels, sets))
        if not more.isEmpty():
            labels = components(links.union(more))
    out = rows.join(classes.select("key", "rep"), "key", "left")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("x", "rep"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _between_parts(clusters: DataFrame, labels: DataFrame | None, sets: DataFrame) -> DataFrame:
    """Links between members of different parts of clusters that are still split, confirmed on full sets.

    Members are in the order of their shingles from the rarest on (among these members). Two sets similar enough share
    one of the first quarter of both, so what these connect is compared, block by block, and the rest is not: what all
    pages of a template share comes last and connects none.
    """
    labels = clusters.sparkSession.createDataFrame([], "x long, component long") if labels is None else labels
    members = stage(clusters.join(labels.withColumnRenamed("x", "rep"), "rep", "left").select(
        "node", "rep", F.coalesce("component", "rep").alias("part")))
    split = members.groupBy("node").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    own = stage(members.join(split.select("node"), "node", "left_semi").select("rep", "part").distinct())
    shingles = own.join(sets, "rep").mapInArrow(_exploded, "rep long, part long, size long, shingle long")
    common = shingles.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "shingle")))
    last = F.col("size") - F.ceil(F.col("size") * THRESHOLD[0] / THRESHOLD[1]) + 1
    first = shingles.join(stage(common), "shingle", "left").groupBy("rep", "part", "size").agg(ranked.alias("order")).select(
        "rep", "part", F.explode(F.slice("order", F.lit(1), last.cast("int"))).alias("of"))
    first = stage(first.filter("of.n > 1").select("rep", "part", F.col("of.shingle").alias("shingle")))
    shared = first.groupBy("shingle").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).filter("b <> high").select("shingle", "b")
    near = components(first.join(stage(shared), "shingle").select(F.col("rep").alias("a"), "b"))
    size = sets.select("rep", F.octet_length("set").alias("bytes"))
    placed = _blocks(own.join(near.select(F.col("x").alias("rep"), F.col("component").alias("node")), "rep").join(size, "rep"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = placed.select("rep", "part", "node", "block", other).select(
        "rep", "part", (F.col("block") > F.col("other")).alias("high"), (F.col("block") == F.col("other")).alias("one"),
        F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("place"))

    def compared(rep: np.ndarray, part: np.ndarray, high: np.ndarray, one: np.ndarray, own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if part.min() == part.max() or not one.all() and high.min() == high.max():
            return
        x = np.flatnonzero(~high)
        y = x if one.all() else np.flatnonzero(high)
        some = [own[i] for i in x]
        linked = _alike(some, some if one.all() else [own[i] for i in y]) & (part[x][:, None] != part[y][None, :])
        i, j = np.nonzero(np.triu(linked) if one.all() else linked)
        if i.size:
            a, b = rep[x[i]], rep[y[j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return _by_place(rows.join(sets, "rep"), compared, "rep", "part", "high", "one")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set, about ``CHUNK`` bytes of sets at a time."""
    for batch in batches:
        reps, parts, sets = batch.select(["rep", "part", "set"]).columns
        ends = np.cumsum([len(s.as_buffer()) // 8 for s in sets], dtype=np.int64)
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + CHUNK // 8, "right")))
            own = [np.frombuffer(s.as_buffer(), dtype=np.int64) for s in sets[first:last]]
            sizes = np.array([x.size for x in own], np.int64)
            row = pa.array(first + np.repeat(np.arange(len(own)), sizes))
            yield pa.RecordBatch.from_arrays(
                [reps.take(row), parts.take(row), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(own))],
                names=["rep", "part", "size", "shingle"])
            first = last

"""Context-triggered piecewise hashes and their likeness.

A rolling hash of the last seven bytes cuts a text into pieces; each piece gives one of 64 characters.
Two signatures, for a block size and its double, make a fingerprint ``size:signature:signature``. Fingerprints
of equal or neighbouring block sizes are compared by insert-delete distance of their signatures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import chunks, widths

# Fixed values of the method: rolling window, smallest block, signature length, alphabet.
WINDOW, SMALLEST, LENGTH = 7, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LOWEST_ID = -(1 << 63)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of each position's last seven bytes (zeros before the start): weighted sum plus shifted exclusive or."""
    padded = np.zeros(data.size + WINDOW - 1, dtype=np.uint32)
    padded[WINDOW - 1:] = data
    added, mixed = np.zeros(data.size, dtype=np.uint32), np.zeros(data.size, dtype=np.uint32)
    for back in range(WINDOW):
        own = padded[WINDOW - 1 - back:WINDOW - 1 - back + data.size]
        added += own * np.uint32(WINDOW + 1 - back)
        mixed ^= own << np.uint32(5 * back)
    return added + mixed


def _signature(data: bytes, cuts: np.ndarray, length: int) -> str:
    """A character for each piece; what follows the last place of the signature joins its last piece."""
    ends = (cuts[:length - 1] + 1).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    out, start = [], 0
    for end in ends:
        out.append(ALPHABET[zlib.crc32(data[start:end]) & 63])
        start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """Depends on the text's UTF-8 bytes only; the empty text has ``3::``."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return f"{SMALLEST}::"
    roll, size = rolling(np.frombuffer(data, dtype=np.uint8)), SMALLEST
    while size * LENGTH < len(data):
        size *= 2
    while True:
        cuts = np.flatnonzero(roll % np.uint32(size) == size - 1)
        if size == SMALLEST or cuts.size + 1 >= LENGTH // 2:
            break
        size //= 2
    twice = cuts[roll[cuts] % np.uint32(2 * size) == 2 * size - 1]
    return f"{size}:{_signature(data, cuts, LENGTH)}:{_signature(data, twice, LENGTH // 2)}"


def distance(a: str, b: str) -> int:
    """Insertions and deletions that turn ``a`` into ``b``, by the bit-parallel longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        taken = row & places.get(c, 0)
        row = ((row + taken) | (row - taken)) & full
    return len(a) + len(b) - 2 * (full & ~row).bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    least = min(len(a), len(b))
    size = min(WINDOW, max(2, least // 3))  # unrelated signatures share no run of this length
    if least < size or {a[i:i + size] for i in range(len(a) - size + 1)}.isdisjoint(
            b[i:i + size] for i in range(len(b) - size + 1)):
        return 0.0
    return 1.0 - distance(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 for block sizes more than a factor two apart or no common run."""
    if one == other:
        return 1.0
    (size_a, a1, a2), (size_b, b1, b2) = one.split(":"), other.split(":")
    ratio = int(size_a) / int(size_b)
    pairs = {1.0: ((a1, b1), (a2, b2)), 2.0: ((a1, b2),), 0.5: ((a2, b1),)}.get(ratio, ())
    return max((_alike(a, b) for a, b in pairs if a and b), default=0.0)


def with_successors(df: DataFrame) -> DataFrame:
    """Rows dealt into ranges of ids, each range followed by the first rows of the next lower one.

    Columns ``bucket, own, key, doc_id, text``; partitions hold whole buckets, sorted by descending id, own rows
    first. The lowest range is followed by the highest id. Only ids are read for the limits; each text is
    shuffled once, and again only if its id begins a range.
    """
    ids = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID)).alias("key"))
    ranges = 4 * widths(df)
    limits = sorted(set(ids.select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    cut = Bucketizer(splits=[float("-inf"), *limits, float("inf")], inputCol="__k", outputCol="__b")

    def bucketed(rows: DataFrame) -> DataFrame:
        return cut.transform(rows.withColumn("__k", F.col("key").cast("double"))).withColumn("bucket", F.col("__b").cast("int")).drop("__k", "__b")

    first = bucketed(ids).groupBy("bucket").agg(F.max("key").alias("key")).orderBy(F.desc("bucket")).collect()
    after = [(first[i].key, first[i - 1].bucket) for i in range(len(first))]  # the highest id also follows the lowest range
    also = df.sparkSession.createDataFrame(after, "key long, also int")
    rows = bucketed(df.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID)).alias("key")))
    places = F.array(F.struct(F.col("bucket"), F.lit(1).alias("own")))
    both = F.array(F.struct(F.col("bucket"), F.lit(1).alias("own")), F.struct(F.col("also").alias("bucket"), F.lit(0).alias("own")))
    dealt = rows.join(F.broadcast(also), "key", "left").select(
        "key", "doc_id", "text", F.explode(F.when(F.col("also").isNull(), places).otherwise(both)).alias("p"))
    dealt = dealt.select("p.bucket", "p.own", "key", "doc_id", "text")
    return dealt.repartition(widths(df), "bucket").sortWithinPartitions(
        F.desc("bucket"), F.desc("own"), F.desc("key"), F.xxhash64("text"), "text")


def fingerprints(df: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last half comes from the next document.

    The next document is the one of the next lower id; the first follows the last, a single document follows
    itself. Null texts are empty, null ids come last, repeated ids follow each other in order of a hash of
    their texts. An empty table gives an empty one; other columns are not read.
    """
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor has not been seen: bucket, id, text, fingerprint
        for buckets, own, ids, texts in chunks(batches, 3):
            out = []
            for bucket, mine, doc_id, text in zip(buckets, own, ids, texts):
                if held is not None and held[0] == bucket:
                    mark = fingerprint(text)
                    out.append(_row(held, text, mark))
                    held = None
                elif mine:
                    mark = fingerprint(text)
                if mine:
                    held = (bucket, doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

    return with_successors(df).select("bucket", "own", F.col("doc_id").cast("long"), "text").mapInArrow(run, _RESULT)


def _row(held: tuple, following: str, mark: str) -> tuple:
    _, doc_id, text, own = held
    half = len(text) // 2
    edited = text[:len(text) - half] + following[:half]
    changed = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, changed, likeness(own, changed), likeness(own, mark)


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

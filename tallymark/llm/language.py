"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile lists a language's most frequent letter n-grams (1 to 3 letters, word edges included) in order.
A document is ranked the same way; its distance to a language is the sum, over its own n-grams, of how far
each is out of place, with the profile's length for an n-gram the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallymark.llm.common import chunks

PROFILE = 400
UNKNOWN = "und"
EDGE = 32
TAIL, SLACK, FEW = 0.001, 0.85, 20  # a text is foreign below such a share of that quantile; of fewer rows of a length nothing is told
_MERGE_AT = 2_000_000


class Grams:
    """N-grams of lower-cased letters as integers: 21 bits a letter; every other run of characters is one edge."""

    def __init__(self):
        self.letter = np.array([chr(i).isalpha() for i in range(0x10000)])

    def letters(self, text: str) -> np.ndarray:
        """Letters and single edges of a text, an edge first and last; just one edge if it has no letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        known = self.letter[np.minimum(points, 0xFFFF)]
        high = points > 0xFFFF
        if high.any():
            known = known.copy()
            known[high] = [chr(p).isalpha() for p in points[high].tolist()]
        out = np.full(points.size + 2, EDGE, dtype=np.int64)
        out[1:-1][known] = points[known]
        keep = np.ones(out.size, dtype=bool)
        keep[1:] = (out[1:] != EDGE) | (out[:-1] != EDGE)
        return out[keep]

    @staticmethod
    def keys(letters: np.ndarray) -> np.ndarray:
        a, b, c = letters[:-2], letters[1:-1], letters[2:]
        inner = letters[1:-1]
        inner = inner[inner != EDGE]
        return np.concatenate((inner, letters[:-1] | letters[1:] << 21, (a | b << 21 | c << 42)[b != EDGE]))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, keys.size))


def _top(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys in order; ties in count go to the smaller key."""
    unique, count = _counted(keys)
    if unique.size > size:  # only counts that can be among the first ``size``
        least = np.partition(count, unique.size - size)[unique.size - size]
        unique, count = unique[count >= least], count[count >= least]
    return unique[np.argsort(-count, kind="stable")][:size]


@dataclass
class Profiles:
    """Ranks of all profiles' n-grams: ``ranks[i, j]`` is the place of ``grams[j]`` in language ``i``."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """Language of least distance (ties: the smaller name) and 1 - distance / largest possible distance."""
        at = np.minimum(np.searchsorted(self.grams, own), self.grams.size - 1)
        found = self.grams[at] == own
        place = np.flatnonzero(found)
        ranks = self.ranks[:, at[found]]
        apart = np.where(ranks < self.size, np.abs(ranks - place), self.size).sum(axis=1) + self.size * (own.size - place.size)
        best = int(np.argmin(apart))
        return self.languages[best], max(0.0, 1.0 - float(apart[best]) / (self.size * own.size))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all rows with text and language. The driver gets ``size`` rows a language.

    Tasks count by language and merge as they go, so the shuffle carries each n-gram once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, rows = Grams(), {}, 0

        def out():
            for name, parts in held.items():
                keys, counts = _summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * keys.size), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

        for names, texts in chunks(batches):
            by: dict[str, list[np.ndarray]] = {}
            for name, t in zip(names, texts):
                letters = grams.letters(t)
                if letters.size > 2:
                    by.setdefault(name, []).append(grams.keys(letters))
            for name, parts in by.items():
                held.setdefault(name, []).append(_counted(np.concatenate(parts)))
                rows += held[name][-1][0].size
            if rows > _MERGE_AT:
                held = {name: [_summed(parts)] for name, parts in held.items()}
                rows = sum(parts[0][0].size for parts in held.values())
                if rows > _MERGE_AT // 2:
                    yield from out()
                    held, rows = {}, 0
        yield from out()

    counted = (df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(lang, text)
               .mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).select("lang", "gram", "place").collect()
    names = sorted({r.lang for r in top})
    all_grams = np.array(sorted({r.gram for r in top}), dtype=np.int64)
    ranks = np.full((len(names), all_grams.size), size, dtype=np.int64)
    if top:
        row = {name: i for i, name in enumerate(names)}
        ranks[[row[r.lang] for r in top], np.searchsorted(all_grams, [r.gram for r in top])] = [r.place - 1 for r in top]
    return Profiles(names, all_grams, ranks, size)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def identify(df: DataFrame, profiles: Profiles, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with ``lang_pred`` and ``score`` (0 to 1). Texts are read whole; no shuffle.

    ``und`` with score 0 for a null or empty text, one without a letter, and for all if no profile was learned.
    Repeated rows are judged alike; an empty table gives an empty one; other columns are not read.
    """
    fields = [df.schema[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            names, scores = [], []
            for (texts,) in chunks([batch.select([0])], 0):
                for t in texts:
                    letters = grams.letters(t)
                    name, score = (UNKNOWN, 0.0)
                    if letters.size > 2 and profiles.languages:
                        name, score = profiles.nearest(_top(grams.keys(letters), profiles.size))
                    names.append(name)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"])

    source = df.select(F.col(text).alias("__text"), *[F.col(f"`{c}`") for c in columns])
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def length_class(text: str) -> Column:
    """Texts of like length: the power of two of their characters."""
    return F.floor(F.log2(F.length(text) + F.lit(1))).cast("int")


@dataclass
class Floors:
    """For each language and length class the score below which a text is foreign to it; 0 where too little was seen."""

    least: dict[tuple[str, int], float]

    def rejected(self, text: str = "text") -> Column:
        """For rows of ``identify`` with their ``text``: is the score lower than that of any text of the language?

        Texts shorter than any class that was seen are not rejected; longer ones are held to the longest class seen.
        """
        floor = F.lit(0.0)
        for lang in sorted({k[0] for k in self.least}):
            own = F.lit(0.0)
            for size, least in sorted((size, least) for (name, size), least in self.least.items() if name == lang):
                own = F.when(length_class(text) >= size, F.lit(least)).otherwise(own)
            floor = F.when(F.col("lang_pred") == lang, own).otherwise(floor)
        return (F.col("lang_pred") == UNKNOWN) | (F.col("score") <= 0) | (F.col("score") < floor)


def calibrate(df: DataFrame, profiles: Profiles) -> Floors:
    """Floors from the scores that all learning rows have in their own language, by length."""
    known = df.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", length_class("text").alias("size"))
    scored = identify(known, profiles, ["lang", "size"]).filter(F.col("lang") == F.col("lang_pred"))
    tails = scored.groupBy("lang", "size").agg(F.count("*").alias("n"), F.percentile_approx("score", TAIL, 10_000).alias("tail"))
    return Floors({(r["lang"], r["size"]): SLACK * r["tail"] for r in tails.filter(F.col("n") >= FEW).collect()})  # a row per language and class

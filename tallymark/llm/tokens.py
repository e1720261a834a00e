"""Token counts and ids by rank-synchronous merging of ragged arrays.

A byte-pair merge with the lowest rank can be applied to all sequences of a batch at once:
every round finds each sequence's lowest-ranked adjacent pair and merges all its places, until
no sequence has a mergeable pair. Texts of Latin letters are cut into pre-tokens by one pattern, other texts by
the normaliser and pre-tokeniser of the vocabulary file, word by word. Each distinct pre-token is merged
once per task as long as a bounded store holds it; the ids of a batch of texts are then gathered in one array.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import chunks

VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 400_000      # distinct pre-tokens a task remembers
SEGMENT_CHARS = 4_000_000   # longer texts are encoded in segments, cut at white space
# Unicode white space as the pre-tokeniser's \s has it; str.split() also cuts at \x1c-\x1f.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_WHITE = re.compile("[\x1c-\x1f]")
NO_RANK = np.iinfo(np.int32).max
# Characters below U+0250, whose classes and lower case are the same in every Unicode version. They have no
# other normal form; only the capital I with a dot becomes two characters in lower case.
LATIN_END, DOTTED_I = 0x250, "\u0130"
OTHER = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]|{DOTTED_I}")
_LETTERS, _NUMBERS = ("".join(chr(c) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == k) for k in "LN")
# Fixed value: the pre-tokeniser's pattern, for such texts in lower case.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\t-\r \x85\xa0]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """Merge ranks of one byte-level vocabulary file with word ends, as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.pre_tokenise = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        self.byte_of = {c: i for i, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == self.keys.size] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all sequences, in order, and their counts. Sequences are not empty."""
        sequence = np.repeat(np.arange(lengths.size), lengths)
        rank = self._pair_ranks(symbols, sequence, np.arange(symbols.size))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while symbols.size:
            starts = np.flatnonzero(np.concatenate(([True], sequence[1:] != sequence[:-1])))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, symbols.size)))
            live = lowest != NO_RANK
            if not live.all():
                done.append((symbols[~live], sequence[~live]))
                symbols, sequence, rank, lowest = symbols[live], sequence[live], rank[live], lowest[live]
                if not symbols.size:
                    break
            hit = rank == lowest
            if (hit[1:] & hit[:-1]).any():
                hit = _every_other(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            rest = np.ones(symbols.size, dtype=bool)
            rest[at + 1] = False
            symbols, sequence, rank = symbols[rest], sequence[rest], rank[rest]
            at -= np.arange(at.size)  # where the merged symbols stand now: only their pairs have changed
            rank[at] = self._pair_ranks(symbols, sequence, at)
            before = at[at > 0] - 1
            rank[before] = self._pair_ranks(symbols, sequence, before)
        if not done:
            return symbols, lengths
        symbols, sequence = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(sequence, kind="stable")
        return symbols[order], np.bincount(sequence, minlength=lengths.size)

    def _pair_ranks(self, symbols: np.ndarray, sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places ``at``; none where the sequence ends."""
        out = np.full(at.size, NO_RANK, dtype=np.int32)
        inside = at + 1 < symbols.size
        inside[inside] = sequence[at[inside]] == sequence[at[inside] + 1]
        out[inside] = self.rank(symbols[at[inside]], symbols[at[inside] + 1])
        return out

    def pieces(self, words: list[str]) -> list[str]:
        """Pre-tokens of words without white space, in order, by the vocabulary file's own rules."""
        out = self.normalise("\n".join(words)).split(" ") if words else []
        out = out if len(out) == len(words) else [self.normalise(w) for w in words]
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for w in out for p, _ in self.pre_tokenise(w)]

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens in a row, and how many each has."""
        encoded = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        symbols, last = self.inner[data], np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        return self.merge(symbols, lengths)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in printable else next(other)) for b in range(256)]


def _every_other(hit: np.ndarray) -> np.ndarray:
    """Within each run of neighbouring hits the 1st, 3rd, ...: pairs must not overlap, the leftmost wins."""
    begins = hit.copy()
    begins[1:] &= ~hit[:-1]
    place = np.arange(hit.size)
    start = np.maximum.accumulate(np.where(begins, place, 0))
    return hit & ((place - start) % 2 == 0)


class Encoder:
    """Per-task encoder with a store of the pre-tokens met so far: place, start and number of ids of each.

    For ``texts``, ``value`` turns a segment's ids into what is kept of them, ``join`` adds up a text's segments.
    """

    def __init__(self, path: str, value=len, join=sum):
        self.merges, self.value, self.join = Merges(path), value, join
        self._forget()

    def _forget(self) -> None:
        special = self.merges.special  # each its own id
        self.known: dict[str, int] = {p: i for i, p in enumerate(special)}
        self.ids = np.array(list(special.values()), np.int32)
        self.starts, self.counts = np.arange(len(special)), np.ones(len(special), np.int64)

    def texts(self, texts: list[str]) -> list[list]:
        """The kept value of each text, as a list of one."""
        return [[self.join([self.value(self.encode([s])[0]) for s in segments(t)])] for t in texts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        parts = [self._pieces(s) for t in texts for s in segments(t)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        met = pa.array(chain.from_iterable(parts), pa.string()).dictionary_encode()
        place = self._learned(met.dictionary.to_pylist())[met.indices.to_numpy()]
        counts, starts = self.counts[place], self.starts[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(starts - (ends - counts), counts) + np.arange(total)]
        edges = np.concatenate([[0], ends])
        of_part = np.diff(edges[np.cumsum([0, *map(len, parts)])])
        if len(parts) == len(texts):
            return ids, of_part
        return ids, np.add.reduceat(of_part, np.cumsum([0, *(len(segments(t)) for t in texts)])[:-1])

    def _learned(self, pieces: list[str]) -> np.ndarray:
        """Places of pre-tokens in the store, after those not in it have been merged."""
        if len(self.known) + len(pieces) > CACHED_WORDS:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            ids, counts = self.merges.ids(part)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings as they stand, which no pre-token equals."""
        special = "<|" in text and self.merges.cut.search(text)
        if not special and not OTHER.search(text):
            return PIECES.findall(text.lower())
        out: list[str] = []
        for part in self.merges.cut.split(text) if special else [text]:
            out += [part] if part in self.merges.special else self.merges.pieces(_words(part))
        return out


def segments(text: str) -> list[str]:
    """A text in stretches of about ``SEGMENT_CHARS``, cut at white space."""
    if len(text) <= SEGMENT_CHARS:
        return [text]
    out, at = [], 0
    while at < len(text):
        gap = WHITE.search(text, at + SEGMENT_CHARS)
        end = gap.end() if gap else len(text)
        out.append(text[at:end])
        at = end
    return out


def _words(text: str) -> list[str]:
    return [w for w in WHITE.split(text) if w] if NOT_WHITE.search(text) else text.split()


def count_tokens(df: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row, without begin, end or added special tokens.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text are one token each, as by
    the library's default. Repeated rows give repeated rows; an empty table gives an empty one; other columns
    are not read. Texts are counted whole; no shuffle.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for ids, texts, sizes in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(encoder.encode(texts)[1], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    source = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")

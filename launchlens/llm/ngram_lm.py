"""Language-model scoring from an Elias-Fano n-gram trie.

The model is a back-off model of order two or three (the query's: ``ORDER``). The first level of the trie holds the
words with their probability, back-off weight and a pointer to their followers; the
second level holds the followers seen at least ``KEPT`` times, numbered relative to
their context, with their probability. The third level holds contexts of two words, numbered by the
place of the nearer word, with their back-off weight and their followers seen at least ``KEPT`` times; so all
that a word is scored by is in the shard of the word before it. Keys and pointers are monotone and coded by Elias and Fano, logarithms are
quantised to 1 / ``STEPS``. A level is a few byte strings in a memory-mapped file, decoded
when the file is opened; a follower is looked up by the successor of its key in the decoded level.

Probabilities: P(w) = (c + 1) / (N + V + 1), which leaves a share for one unknown
word; P(w | v) = (c(vw) - ``DISCOUNT``) / c(v) for kept pairs, and otherwise the back-off weight of v
times P(w), such that each context adds up to one. P(w | u v) = (c(uvw) - ``DISCOUNT``) / c(uv) for kept
sequences, and otherwise the weight of u v times P(w | v), in the same way; a context without kept followers has the weight one.

The trie is sharded by context, so no task holds the whole model, and the model
grows with the corpus. Pairs, with the word behind them for order three, are counted for each slice of the texts and added up by
the hash of the pair; a shard meets only these sums. To be scored, texts are sent as packed lists
of (context, follower, document, word before). The occurrences of a shard are dealt by chunk over
as many tasks as its tokens ask for (``PART_TOKENS``), each of which reads the
shard and then one chunk after the other, adds up integers for each document, and the sums of a chunk
of documents meet again. Followers are known by ``FOLLOWER_BITS`` bits of their hash.

Cases: a null or empty text is an end mark alone; a text of unknown words gets their
probability; without training texts every token is unknown; repeated rows are
learned from and scored each; a null id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from launchlens.llm.repeats import _by_part, _squeeze, _swell
from launchlens.llm.store import release, settled
from launchlens.llm.text import LOWER, flat, hash_spans, slices, word_spans

#: Words of the longest sequence in the query's model.
ORDER = 3
KEPT = 2
DISCOUNT = 0.75
STEPS = 4096
FOLLOWER_BITS = 40
#: Tokens of a shard, and of the occurrences that one task scores, at about which another one is opened.
PART_TOKENS = 16 << 20
_SHIFT = np.uint64(64 - FOLLOWER_BITS)
#: The end mark's hash, as a token.
END = np.uint64(0xE0D0E0D0E0D0E0D0)
#: Fractions of a decimal logarithm in which exact base scores are added up.
_FINE = 10 ** 12
#: Values that are turned into bits at a time, a multiple of eight.
_BLOCK = 1 << 14
#: Bytes of text that are cut into tokens at a time.
_SLICE = 4 << 20
#: What follows an end mark.
_NONE = np.uint64(0)


class EliasFano:
    """An ascending list of integers: low bits packed, high bits in unary."""

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = max(0, int(np.floor(np.log2(top / max(1, n))))) if top > n else 0
        packed = b"".join(np.packbits(((values[at: at + _BLOCK, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()
                          for at in range(0, n, _BLOCK))
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        unary[high] = 1
        return np.array([n, low, len(packed)], np.int64).tobytes() + packed + np.packbits(unary).tobytes()

    def __init__(self, coded: memoryview | bytes):
        n, low, size = np.frombuffer(coded, np.int64, 3).tolist()
        coded = memoryview(coded)
        low_bytes = np.frombuffer(coded[24:24 + size], np.uint8)
        rest = np.zeros(n, np.uint64)
        for at in range(0, n if low else 0, _BLOCK):
            block = rest[at: at + _BLOCK]
            bits = np.unpackbits(low_bytes[at // 8 * low: (at + _BLOCK) // 8 * low], count=len(block) * low).reshape(-1, low)
            for i in range(low):
                block |= bits[:, i].astype(np.uint64) << np.uint64(i)
        high = np.flatnonzero(np.unpackbits(np.frombuffer(coded[24 + size:], np.uint8)))[:n] - np.arange(n)
        self.values = (high.astype(np.uint64) << np.uint64(low)) | rest

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """The place of the first value that is not below each key."""
        return np.searchsorted(self.values, keys)


@dataclass
class Trie:
    """One shard of the model, written to a file and mapped."""

    contexts: EliasFano
    pointers: EliasFano
    followers: EliasFano
    word: np.ndarray
    back_off: np.ndarray
    pair: np.ndarray

    @staticmethod
    def write(path: str, contexts: np.ndarray, first: np.ndarray, followers: np.ndarray, word: np.ndarray, back_off: np.ndarray, pair: np.ndarray) -> None:
        """``first``: where each context's followers begin (one more than contexts); the others are quantised logarithms."""
        place = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(first)) << np.uint64(FOLLOWER_BITS)
        sections = [EliasFano.encode(contexts), EliasFano.encode(first), EliasFano.encode(place | followers),
                    *[v.astype(np.uint16).tobytes() for v in (word, back_off, pair)]]
        with open(path, "wb") as out:
            out.write(np.array([len(s) for s in sections], np.int64).tobytes())
            for section in sections:
                out.write(section)

    @classmethod
    def open(cls, path: str) -> Trie:
        with open(path, "rb") as source:
            mapped = memoryview(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ))
        ends = 48 + np.cumsum(np.frombuffer(mapped, np.int64, 6))
        parts = [mapped[a:z] for a, z in zip([48, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return cls(*[EliasFano(p) for p in parts[:3]], *[np.frombuffer(p, np.uint16) for p in parts[3:]])

    def look_up(self, contexts: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each context (-1: none), and of its follower in the second level (-1: none)."""
        at = self.contexts.successor(contexts)
        near = np.minimum(at, max(0, len(self.contexts.values) - 1))
        known = self.contexts.values[near] == contexts if len(self.contexts.values) else np.zeros(len(contexts), bool)
        keys = (near.astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | followers
        # the successor lies within the context's own range if the key is there
        found = self.followers.successor(keys)
        close = np.minimum(found, max(0, len(self.followers.values) - 1))
        hit = known & (self.followers.values[close] == keys) if len(self.followers.values) else np.zeros(len(contexts), bool)
        inside = hit & (found < self.pointers.values[near + 1]) if len(self.pointers.values) > 1 else hit
        return np.where(known, near, -1), np.where(inside, close, -1)


def quantised(log10: np.ndarray | float) -> np.ndarray:
    """A negative logarithm in steps."""
    return np.clip(np.rint(-np.asarray(log10) * STEPS), 0, 65535).astype(np.int64)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return hash_spans(data, starts, ends), first


def _zip(*columns: np.ndarray) -> bytes:
    packed = [_squeeze(c) for c in columns]
    return np.array([len(p) for p in packed], np.int64).tobytes() + b"".join(packed)


def _unzip(packed: bytes, n: int) -> list[np.ndarray]:
    ends = 8 * n + np.cumsum(np.frombuffer(packed, np.int64, n))
    return [_swell(packed[a:z]) for a, z in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _numbered(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct values of columns of one length, and the columns as places in them, each summed up: ``_zip`` keeps differences."""
    names, at = np.unique(np.concatenate(columns), return_inverse=True)
    return [names, *np.cumsum(at.reshape(len(columns), -1), axis=1)]


def _named(names: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The columns that ``_numbered`` was given."""
    return [names[_steps(c)] for c in columns]


def _steps(sums: np.ndarray) -> np.ndarray:
    return np.diff(sums.astype(np.int64), prepend=0)


def _part_count(docs: DataFrame, tokens: int = 0) -> int:
    """Ranges of contexts: one for each shuffle partition, more if the tokens ask for it."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << int(np.ceil(np.log2(max(least, -(-tokens // PART_TOKENS)))))


def _cut(ascending: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    edges = np.searchsorted(ascending >> np.uint64(64 - int(np.log2(parts))), np.arange(parts + 1)) if parts > 1 else np.array([0, len(ascending)])
    for part in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield part, slice(int(edges[part]), int(edges[part + 1]))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (the high bits of its hash), n of the tokens of the column ``text``, end marks included, that occur ``KEPT`` times or are the mark.

    Rows with word -1 have the number n of tokens and v of distinct tokens of a part.
    """
    parts = _part_count(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            hashes, _ = _tokens(batch.column("text"))
            words, n = np.unique(np.concatenate([hashes, np.repeat(END, batch.num_rows)]), return_counts=True)
            rows = [(p, _zip(words[at], n[at])) for p, at in _cut(words, parts)]
            yield pa.record_batch({"part": pa.array([p for p, _ in rows], pa.int32()), "packed": pa.array([b for _, b in rows], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            both = [_unzip(b, 2) for _, b in held]
            words, at = np.unique(np.concatenate([w for w, _ in both]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in both]).astype(float)).astype(np.int64)
            kept = (n >= KEPT) | (words == END)
            yield pa.record_batch({
                "word": pa.array(np.append((words[kept] >> _SHIFT).astype(np.int64), -1)), "n": pa.array(np.append(n[kept], n.sum())),
                "v": pa.array(np.append(np.zeros(kept.sum(), np.int64), len(n)))})

    packed = texts.mapInArrow(count, "part int, packed binary").repartition("part").sortWithinPartitions("part")
    return packed.mapInArrow(add, "word long, n long, v long")


def _bigrams(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Each word of the texts, what follows it, and its row; and the numbers of words of the rows."""
    hashes, first = _tokens(column)
    sizes = np.diff(first)
    follower = np.append(hashes[1:], END)[: len(hashes)]
    follower[first[1:][sizes > 0] - 1] = END
    return hashes, follower, np.repeat(np.arange(len(sizes)), sizes), sizes


def _before(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each word, ``_NONE`` for the first of a row."""
    before = np.append(_NONE, hashes[:-1])[: len(hashes)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = _NONE
    return before


def _after_next(follower: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The second word after each word, ``_NONE`` if the next is the end mark."""
    after = np.append(follower[1:], _NONE)[: len(follower)]
    after[(np.cumsum(sizes) - 1)[sizes > 0]] = _NONE
    return after


def _summed(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values of all columns but the last in order, with the sums of the last."""
    order = np.lexsort(columns[-2::-1])
    *keys, n = (c[order] for c in columns)
    new = np.ones(len(n), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in keys], axis=0)
    begin = np.flatnonzero(new)
    return *(c[begin] for c in keys), np.add.reduceat(n, begin) if len(begin) else n


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def pair_counts(texts: DataFrame, parts: int, order: int = 2) -> DataFrame:
    """part, packed: of a range of contexts, those that a range of pairs has with their number there, and its pairs that occur ``KEPT`` times.

    Pairs are added up for a slice first, and meet by the hash of the pair, so a frequent context is dealt over all tasks.
    With order three they travel with the word behind them, which gives the counts of three words; rows
    with five further columns hold of a range of middle words: the middle word, the one before, how often
    the two occur, the third word, and how often the three do, ``KEPT`` times at least.
    """
    buckets = min(parts, 1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            context, follower, _, sizes = _bigrams(batch.column("text"))
            third = [_after_next(follower, sizes)] if order > 2 else []
            *words, n = _summed(context, follower, *third, np.ones(len(context), np.int64))
            mixed = (words[0] ^ (words[1] * _SPREAD)) * _SPREAD
            by_bucket = np.argsort(mixed >> np.uint64(64 - 17), kind="stable")
            columns = [c[by_bucket] for c in (*words, n)]
            rows = [(p, _zip(*_numbered(*(c[at] for c in columns[:-1])), columns[-1][at])) for p, at in _cut(mixed[by_bucket], buckets)]
            yield pa.record_batch({"part": pa.array([p for p, _ in rows], pa.int32()), "packed": pa.array([b for _, b in rows], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            pieces = (_unzip(b, order + 2) for _, b in held)
            *words, n = _summed(*(np.concatenate(c) for c in zip(*[(*_named(*words), n) for *words, n in pieces], strict=True)))
            rows = list(_threes(*words, n, parts)) if order > 2 else []
            context, follower, n = _summed(words[0], words[1] >> _SHIFT, n)
            for part, at in _cut(context, parts):
                own, place = np.unique(context[at], return_inverse=True)
                kept = n[at] >= KEPT
                total = np.bincount(place, n[at].astype(float)).astype(np.int64)
                columns = (own, total, context[at][kept], follower[at][kept], n[at][kept])
                rows.append((part, _zip(*(_whole(c) for c in columns), *_EMPTY)))
            yield pa.record_batch({"part": pa.array([p for p, _ in rows], pa.int32()), "packed": pa.array([b for _, b in rows], pa.binary())})

    packed = texts.mapInArrow(count, "part int, packed binary").repartition("part").sortWithinPartitions("part")
    return packed.mapInArrow(add, "part int, packed binary")


_EMPTY = [np.zeros(0, np.uint64)] * 5


def _threes(first: np.ndarray, middle: np.ndarray, third: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """By range of the middle word, the sequences of three that occur ``KEPT`` times, with the number of the two before."""
    new = np.ones(len(n), bool)
    new[1:] = (first[1:] != first[:-1]) | (middle[1:] != middle[:-1])
    both = np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1] if len(n) else n
    kept = (n >= KEPT) & (third != _NONE)
    columns = [c[kept] for c in (middle, first >> _SHIFT, both, third >> _SHIFT, n)]
    order = np.argsort(columns[0], kind="stable")
    columns = [_whole(c[order]) for c in columns]
    for part, at in _cut(columns[0], parts):
        yield part, _zip(*_EMPTY, *(c[at] for c in columns))


def _whole(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).astype(np.uint64)


def model_shards(counts: DataFrame) -> DataFrame:
    """part, packed: the contexts of a range with their counts, and the pairs kept in order: place of the context, follower, count.

    Then the sequences of three kept in order: place of the middle word, the word before, number of the two, third word, count.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            word, n, context, follower, often, *threes = (np.concatenate(c) for c in zip(*[_unzip(b, 10) for _, b in held], strict=True))
            words, at = np.unique(word, return_inverse=True)
            total = np.bincount(at, n.astype(float)).astype(np.int64)
            order = np.lexsort((follower, context))
            place = np.searchsorted(words, context[order])
            threes[0] = np.searchsorted(words, threes[0])
            by_two = np.lexsort((threes[3], threes[1], threes[0]))
            columns = (words, total, place, follower[order], often[order], *(c[by_two] for c in threes))
            yield pa.record_batch({"part": pa.array([held[0][0]], pa.int32()), "packed": pa.array([_zip(*(_whole(c) for c in columns))], pa.binary())})

    return counts.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "part int, packed binary")


def _records(docs: DataFrame, parts: int, salts: np.ndarray, order_of_model: int) -> DataFrame:
    """Rows of two kinds. part >= 0: the contexts of a range, each with followers and documents of a chunk; part -1: the documents of a chunk.

    With order three the word before each context comes as the last column, which is empty otherwise.

    ``salts``: over how many tasks the chunks of each range are dealt.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        for serial, batch in enumerate(slices(batches, "text", _SLICE)):
            task = context.partitionId() if context else 0
            chunk = (task << 32) | serial
            hashes, follower, row, sizes = _bigrams(batch.column("text"))
            around = [follower >> _SHIFT] + ([_before(hashes, sizes) >> _SHIFT] if order_of_model > 2 else [])
            order = np.argsort(hashes, kind="stable")
            hashes, row, around = hashes[order], row[order], [c[order] for c in around]
            rows = []
            for part, at in _cut(hashes, parts):
                words, begin = np.unique(hashes[at], return_index=True)
                salt = (task * 31 + serial) % int(salts[part])
                names, *places = _numbered(*(c[at] for c in around))
                rows.append((part, salt, chunk, _zip(
                    words, np.diff(np.append(begin, at.stop - at.start)), np.cumsum(row[at]), names, places[0], *(places[1:] or _EMPTY[:1]))))
            head = pa.BufferOutputStream()
            table = batch.drop_columns(["text"]).append_column("n_tokens", pa.array(sizes + 1))
            with pa.ipc.new_stream(head, table.schema) as out:
                out.write_batch(table)
            rows.append((-1, task * 31 + serial, chunk, zstandard.compress(head.getvalue().to_pybytes(), 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "salt", "chunk", "packed"])

    return docs.mapInArrow(scan, "part int, salt int, chunk long, packed binary")


def _kept_followers(shards: DataFrame) -> DataFrame:
    """part, word of the followers that a shard keeps."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                words = np.unique(_unzip(packed, 10)[3])
                yield pa.record_batch({"part": pa.array([part] * len(words), pa.int32()), "word": pa.array(words.astype(np.int64))})

    return shards.mapInArrow(find, "part int, word long")


def _shard_sums(packed: DataFrame, log_word: Callable) -> DataFrame:
    """chunk, packed sums for its documents; the documents themselves pass unchanged.

    ``packed`` comes sorted by part, salt and chunk: the shard first (chunk -1, with ``known``: packed counts of kept
    followers), then its occurrences, one chunk at a time.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            part, shard = None, None
            for batch in batches:
                for *at, chunk, content, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if at != part:
                        part, shard = at, None
                    if chunk == -1:
                        shard = _Shard(content, known, log_word, os.path.join(folder, "shard"))
                        continue
                    if at[0] < 0:
                        row = (chunk, True, content)
                    else:
                        shard = shard or _Shard(None, None, log_word, os.path.join(folder, "shard"))
                        row = (chunk, False, shard.sums(content))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], kind) for c, kind in zip(row, (pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["chunk", "head", "packed"])

    return packed.mapInArrow(score, "chunk long, head boolean, packed binary")


class _Shard:
    """A shard of the model, opened to score chunks of occurrences."""

    def __init__(self, packed: bytes | None, known: bytes | None, log_word: Callable, path: str):
        words, total, place, kept, often, *threes = _unzip(packed, 10) if packed else [np.zeros(0, np.uint64)] * 10
        total, place, often = (c.astype(np.int64) for c in (total, place, often))
        names, counts = _unzip(known, 2) if known else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        own = counts[np.minimum(np.searchsorted(names, kept), max(0, len(names) - 1))].astype(np.int64) if len(kept) else np.zeros(0, np.int64)
        self.alone = quantised(log_word(own))
        given = (often - DISCOUNT) / total[place]
        left = 1 - np.bincount(place, given, len(words))
        open_share = 1 - np.bincount(place, 10.0 ** log_word(own), len(words))
        # a weight above one is a negative quantity here, so weights are stored from an offset
        back_off = np.clip(np.rint(-np.log10(np.maximum(left, 1e-9) / np.maximum(open_share, 1e-9)) * STEPS) + _OFFSET, 0, 65535)
        Trie.write(path, words, np.searchsorted(place, np.arange(len(words) + 1)), kept, quantised(log_word(total)), back_off, quantised(np.log10(given)))
        self.trie, self.total = Trie.open(path), total
        os.remove(path)
        self.longer = self._third_level(threes, place, kept, given, path) if len(threes[0]) else None
        self.unknown = int(quantised(log_word(np.zeros(1)))[0])

    @staticmethod
    def _third_level(threes: list[np.ndarray], place: np.ndarray, kept: np.ndarray, given: np.ndarray, path: str) -> Trie:
        """Of the two words before (the place of the nearer, then the farther one) back-off weights and third words.

        The weight is what the kept third words leave, over what the pairs of the nearer word leave beside them.
        """
        middle, first, both, third, often = threes
        two = (middle << np.uint64(FOLLOWER_BITS)) | first
        contexts, begin, at = np.unique(two, return_index=True, return_inverse=True)
        share = (often.astype(np.int64) - DISCOUNT) / both.astype(np.int64)
        # a sequence that is kept has a pair that is kept, unless two words share the bits by which they are known
        pair = np.searchsorted((place.astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | kept, (middle << np.uint64(FOLLOWER_BITS)) | third).clip(max=len(kept) - 1)
        left = 1 - np.bincount(at, share, len(contexts))
        open_share = 1 - np.bincount(at, given[pair], len(contexts))
        weight = np.maximum(left, 1e-9) / np.maximum(open_share, 1e-9)
        back_off = np.clip(np.rint(-np.log10(weight) * STEPS) + _OFFSET, 0, 65535)
        Trie.write(path, contexts, np.append(begin, len(two)), third, np.zeros(len(contexts)), back_off, quantised(np.log10(share)))
        trie = Trie.open(path)
        os.remove(path)
        return trie

    def sums(self, packed: bytes) -> bytes:
        """Documents of a chunk with the number of known words, the score in steps and the finer base score."""
        trie, n_words, n_kept = self.trie, len(self.total), len(self.alone)
        words, often, document, names, *around = _unzip(packed, 6)
        document, (follower, before) = _steps(document), _named(names, *around)
        at, pair = trie.look_up(np.repeat(words, often.astype(np.int64)), follower)
        seen = at >= 0
        steps = np.where(seen, trie.word[np.maximum(at, 0)].astype(np.int64) if n_words else self.unknown, self.unknown)
        if n_words:
            steps += np.where(seen & (pair < 0), trie.back_off[np.maximum(at, 0)].astype(np.int64) - _OFFSET, 0)
        if n_kept:
            steps += np.where(pair >= 0, (trie.pair.astype(np.int64) - self.alone)[np.maximum(pair, 0)], 0)
        if self.longer is not None and len(before):
            two, three = self.longer.look_up((np.maximum(at, 0).astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | before, follower)
            met = seen & (before != _NONE) & (two >= 0)
            weight = self.longer.back_off[np.maximum(two, 0)].astype(np.int64) - _OFFSET
            # a kept sequence takes the place of its pair
            instead = self.longer.pair[np.maximum(three, 0)].astype(np.int64) - trie.pair[np.maximum(pair, 0)].astype(np.int64)
            steps += np.where(met, np.where((three >= 0) & (pair >= 0), instead, weight), 0)
        fine = np.rint(np.log10(np.where(seen, self.total[np.maximum(at, 0)] if n_words else 0, 0) + 1) * _FINE).astype(np.int64)
        order = np.argsort(document, kind="stable")
        docs, begin = np.unique(document[order], return_index=True)
        return _zip(docs, *[np.add.reduceat(v[order], begin) for v in (seen.astype(np.int64), steps, fine)])


_OFFSET = 8 * STEPS
_RESULTS = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}


def score(docs: DataFrame, learn: Column, order: int = 2) -> DataFrame:
    """Scores all rows of ``docs`` (text and further columns) by a model of those with ``learn``, of ``order`` two or three.

    Adds n_tokens, n_known, train_tokens, base_score and score, and leaves out the text. Further columns
    stay, whatever their names; one that is called like a result is replaced.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    further = [c for c in docs.columns if c not in {"text", *_RESULTS}]
    row = F.struct(*[F.col(f"`{c}`") for c in further]) if further else F.struct(F.lit(0).alias("none"))
    # The row travels as one column, so that no name of its own meets those of the steps.
    texts = docs.select(row.alias("row"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    words = settled(word_counts(texts.where("learn").select("text")))
    total = lambda c, of: F.coalesce(F.sum(F.when(c, F.col(of))), F.lit(0)).alias
    totals = words.agg(total(F.col("word") == -1, "n")("n"), total(F.col("word") == -1, "v")("v"), total(F.col("word") == int(END >> _SHIFT), "n")("ends")).first()
    n, v, ends = totals["n"], totals["v"], totals["ends"]
    release(docs.sparkSession)

    def log_word(count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (n + v + 1))

    parts = _part_count(docs, n)
    shards = settled(model_shards(pair_counts(texts.where("learn").select("text"), parts, order)))
    tokens_of = words.where("word >= 0").groupBy(F.shiftright("word", FOLLOWER_BITS - int(np.log2(parts))).alias("part")).agg(F.sum("n").alias("n"))
    salts = np.ones(parts, np.int64)
    for row in tokens_of.collect():
        salts[row["part"]] = max(1, -(-row["n"] // PART_TOKENS))
    release(docs.sparkSession)
    kept = _kept_followers(shards)
    counted = kept.join(words.where("word >= 0").groupBy("word").agg(F.sum("n").alias("n")), "word")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.array(x, np.int64) for x in batch.column("words").to_pylist()]
            yield pa.record_batch({"part": batch.column("part"), "known": pa.array(
                [_zip(*(np.ascontiguousarray(c) for c in x.reshape(-1, 2).T)) for x in names], pa.binary())})

    known = counted.groupBy("part").agg(F.flatten(F.array_sort(F.collect_list(F.array("word", "n")))).alias("words")).mapInArrow(bundle, "part int, known binary")
    read = shards.join(known, "part", "left").select(
        "part", F.explode(F.sequence(F.lit(0), F.get(F.array(*[F.lit(int(x) - 1) for x in salts]), F.col("part")))).alias("salt"),
        F.lit(-1).cast("long").alias("chunk"), "packed", "known")
    both = read.unionByName(_records(texts, parts, salts, order).withColumn("known", F.lit(None).cast("binary")))
    sums = _shard_sums(both.repartition("part", "salt").sortWithinPartitions("part", "salt", "chunk"), log_word)
    kept_columns = [c for c in texts.columns if c != "text"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            head = next(row[2] for row in held if row[1])
            table = pa.ipc.open_stream(zstandard.decompress(head)).read_all().combine_chunks()
            total = np.zeros((3, table.num_rows), np.int64)
            for row in held:
                if not row[1]:
                    docs_of, *sums_of = _unzip(row[2], 4)
                    for i, s in enumerate(sums_of):
                        total[i, docs_of.astype(np.int64)] += s.view(np.int64)
            n_tokens = table.column("n_tokens").to_numpy()
            known_tokens = total[0] + (ends > 0)
            steps = total[1] + quantised(log_word(np.array(ends)))
            base = total[2] / _FINE + np.log10(ends + 1) - n_tokens * np.log10(n + v + 1)
            for batch_out in table.select(kept_columns).append_column("n_tokens", pa.array(n_tokens)).append_column(
                    "n_known", pa.array(known_tokens)).append_column("train_tokens", pa.array(np.full(len(n_tokens), n))).append_column(
                    "base_score", pa.array(base)).append_column("score", pa.array(-steps / STEPS)).to_batches():
                yield batch_out

    schema = StructType([f for f in texts.schema if f.name != "text"])
    for name, kind in _RESULTS.items():
        schema = schema.add(name, kind)
    done = sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(finish, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in further], *_RESULTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = score(docs.withColumn("held_out", held_out), ~F.col("held_out"), ORDER)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

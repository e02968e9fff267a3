"""Byte-level BPE: ranked merges folded by Spark's higher-order functions, decoding by joining byte pieces.

Encoding works on distinct words. The most frequent words of the corpus are
encoded once by the fold and handed to all tasks as a table of at most
``cache_words`` entries. A word outside the table takes the same merges where it
occurs, in Python: a fold costs some 40 microseconds of interpreted expressions, too
much for words that occur once. The table only saves time; its size never changes
a result.

Cases: a null text is encoded as an empty one (no ids); repeated rows are
encoded each; an empty table gives an empty result; words longer than
``FOLD_BYTES`` bytes are merged from a heap, because an array fold is quadratic in
the word's length. Further columns stay; one that is called like the result is
replaced. Under the public split pattern texts are cut at white space first and each
distinct stretch is split once; under any other pattern the pattern splits whole texts.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from launchlens.llm.text import slices

FOLD_BYTES = 64
#: Splits that a worker remembers.
MEMO_UNITS = 400_000
#: White space as the split pattern's \s has it.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches that the split pattern never joins: it splits each of them alike wherever it stands.
_UNITS = rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
_BUCKETS = 65_521
_PAIR, _NONE = 1_000_003, 1 << 30


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file in the order of their ranks."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    return [found[rank] for rank in range(len(found))]


def rank_map(pieces: list[bytes]) -> Column:
    """The ranked merges as one literal.

    ``bytes`` has the id of each byte. ``merges`` is a map from a pair of ids to the
    id, which is the rank, of the piece that they make: pairs are dealt into buckets, and a
    bucket lists pair, id, pair, id and so on.
    """
    rank_of = {piece: rank for rank, piece in enumerate(pieces)}
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    for rank, piece in enumerate(pieces):
        for cut in range(1, len(piece)):
            left, right = rank_of.get(piece[:cut]), rank_of.get(piece[cut:])
            if left is not None and right is not None:
                pair = (left + 1) * _PAIR + right
                buckets[pair % _BUCKETS] += [pair, rank]
    literal = {"bytes": [rank_of[bytes([i])] for i in range(256)], "merges": buckets}
    return F.from_json(F.lit(json.dumps(literal)), "bytes array<int>, merges array<array<bigint>>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def encode_word(word: Column, ranks: Column) -> Column:
    """Ids of one word: the adjacent pair of the lowest rank is merged, leftmost first, until no pair has a rank."""
    return _let(ranks, lambda table: _fold(word, table))


def _fold(word: Column, table: Column) -> Column:
    def rank(left: Column, right: Column) -> Column:
        """The rank of the two parts together, null if they have none or there is no right part."""
        pair = (left + 1) * F.lit(_PAIR) + right
        bucket = F.get(table["merges"], (pair % F.lit(_BUCKETS)).cast("int"))
        place = F.array_position(bucket, pair)
        return F.get(bucket, F.when(place > 0, place.cast("int")))

    def step(parts: Column, _: Column) -> Column:
        """The leftmost pair of the lowest rank becomes one part."""
        pairs = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), rank)
        found = _let(pairs, lambda ranks: _let(F.array_min(ranks), lambda best: F.struct(
            best.alias("rank"), F.array_position(ranks, best).cast("int").alias("place"))))
        return _let(found, lambda pair: F.when(pair["rank"].isNull(), parts).otherwise(F.transform(
            F.filter(parts, lambda _, i: i != pair["place"]),
            lambda part, i: F.when(i == pair["place"] - 1, pair["rank"]).otherwise(part))))

    hexed = F.hex(word.cast("binary"))
    size = F.octet_length(word)
    byte = lambda i: F.get(table["bytes"], F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int")).cast("bigint")
    counted = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: i <= size)
    return F.aggregate(F.slice(counted, F.lit(2), F.size(counted)), F.transform(counted, byte), step,
                       lambda parts: F.transform(parts, lambda part: part.cast("int")))


def merge_word(word: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """The same merges for a word that stands in no table; long ones from a heap of pairs over a linked list of parts."""
    if len(word) > FOLD_BYTES:
        return _merge_long(word, rank_of)
    get, starts = rank_of.get, list(range(len(word) + 1))
    ranks = [get(word[i:i + 2], _NONE) for i in range(len(word) - 1)]
    while ranks and (best := min(ranks)) != _NONE:
        at = ranks.index(best)
        del ranks[at], starts[at + 1]
        # Only the pairs on either side of the new part have changed.
        if at:
            ranks[at - 1] = get(word[starts[at - 1]:starts[at + 1]], _NONE)
        if at < len(ranks):
            ranks[at] = get(word[starts[at]:starts[at + 2]], _NONE)
    return [rank_of[word[i:j]] for i, j in zip(starts, starts[1:], strict=False)]


def _merge_long(word: bytes, rank_of: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rank_of[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in rank_of]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (piece := word[i:end[stop]]) in rank_of:
                heapq.heappush(heap, (rank_of[piece], i, end[stop]))
        if (h := before[i]) >= 0 and (piece := word[h:stop]) in rank_of:
            heapq.heappush(heap, (rank_of[piece], h, stop))
    out, i = [], 0
    while i < n:
        out.append(rank_of[word[i:end[i]]])
        i = end[i]
    return out


def _known_split(pattern: str) -> bool:
    """Whether texts may be cut by ``_UNITS`` before this pattern splits them."""
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


def word_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """How often each word of the column ``text`` occurs: word, n. Words beyond ``FOLD_BYTES`` bytes are left to their place."""
    cut = _known_split(pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, split = re.compile(_UNITS), regex.compile(pattern)
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(units.findall(text) if cut else split.findall(text))
                if len(seen) >= MEMO_UNITS:
                    yield words_of(seen, split)
                    seen = Counter()
        yield words_of(seen, split)

    def words_of(seen: Counter, split) -> pa.RecordBatch:
        """A unit is split once, whatever it counts."""
        words: dict[str, int] = {}
        if cut:
            for unit, n in seen.items():
                for word in split.findall(unit):
                    words[word] = words.get(word, 0) + n
        else:
            words = seen
        kept = [(word, n) for word, n in words.items() if len(word.encode()) <= FOLD_BYTES]
        return pa.record_batch({"word": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Units(dict):
    """Ids of a unit as packed 32-bit numbers; the first ``MEMO_UNITS`` units are remembered."""

    def __init__(self, split, ids_of: dict[str, bytes], rank_of: dict[bytes, int]) -> None:
        self._split, self._ids_of, self._rank_of = split, ids_of, rank_of

    def __missing__(self, unit: str) -> bytes:
        found = self.ids(unit)
        if len(self) < MEMO_UNITS:
            self[unit] = found
        return found

    def ids(self, text: str) -> bytes:
        return b"".join([self._ids_of.get(word) or array("i", merge_word(word.encode(), self._rank_of)).tobytes()
                         for word in self._split.findall(text)])


def encode(docs: DataFrame, pieces: list[bytes], pattern: str, text: str = "text", ids: str = "ids", cache_words: int = 300_000) -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>, never null): the ids of the text without special tokens.

    Two passes over the texts: one counts words, one looks them up. What goes to
    all tasks is bounded by ``cache_words`` words of ``FOLD_BYTES`` bytes at most.
    """
    spark = docs.sparkSession
    ranks = rank_map(pieces)
    common = (word_counts(docs.select(F.col(f"`{text}`").alias("text")), pattern)
              .orderBy(F.desc("n"), "word").limit(cache_words))
    table = (common.select("word").repartition(spark.sparkContext.defaultParallelism)
             .select("word", encode_word(F.col("word"), ranks).alias("ids")).toArrow())
    packed = pa.BufferOutputStream()
    with pa.ipc.new_stream(packed, table.schema) as out:
        out.write_table(table)
    known = spark.sparkContext.broadcast(packed.getvalue().to_pybytes())
    serial = uuid.uuid4().hex
    kept = [c for c in docs.columns if c != ids]
    place = kept.index(text)

    cut = _known_split(pattern)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, memo = re.compile(_UNITS), _worker_units(serial, known, pieces, pattern)
        of_unit = memo.__getitem__
        for batch in slices(batches, text):
            values = [value or "" for value in batch.column(place).to_pylist()]
            rows = [b"".join(map(of_unit, units.findall(value))) if cut else memo.ids(value) for value in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(rows)], [*batch.schema.names, ids])

    rest = docs.select(*[F.col(f"`{c}`") for c in kept])
    return rest.mapInArrow(look, StructType([*rest.schema.fields, StructField(ids, ArrayType(IntegerType()))]))


_held: dict = {}


def _worker_units(serial: str, known, pieces: list[bytes], pattern: str) -> _Units:
    """The units seen so far, over the word table and the ranks; a worker keeps them from task to task of one encoding."""
    if serial not in _held:
        words = pa.ipc.open_stream(known.value).read_all()
        column = words.column("ids").combine_chunks()
        packed = column.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
        ends = column.offsets.to_numpy() * 4
        ids_of = {word: packed[start:end] for word, start, end in
                  zip(words.column("word").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
        _held.clear()
        _held[serial] = _Units(regex.compile(pattern), ids_of, {piece: rank for rank, piece in enumerate(pieces)})
    return _held[serial]


def _lists(rows: list[bytes]) -> pa.Array:
    """One list of ids for each row of packed numbers."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64) // 4
    values = pa.array(np.frombuffer(b"".join(rows), np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def decode(docs: DataFrame, pieces: list[bytes], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the column ``out`` (binary): the pieces of the ids behind each other; a null list gives null, an unknown id fails."""
    table = F.from_json(F.lit(json.dumps([piece.hex() for piece in pieces])), "array<string>")
    joined = F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.element_at(table, i + 1)), "")
    return docs.withColumn(out, F.unhex(joined))


def digests(docs: DataFrame, pieces: list[bytes], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``docs`` (doc_id, text)."""
    coded = decode(encode(docs.select("doc_id", "text"), pieces, pattern), pieces)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenizer(path: str | None = None, pattern: str | None = None) -> tuple[list[bytes], str]:
    """Pieces and split pattern of a rank file, by default the public multi-language one."""
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pattern or public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer())

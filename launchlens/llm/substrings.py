"""Substring deduplication with suffix automata over word sequences.

A window of words that already starts in a document with a smaller id is removed, in
all later documents. The reference is the collection itself, in shards: every shard
has a suffix automaton of its pieces in the order of their documents, whose states
know the first document they occur in. Pieces stream through the automaton, which keeps
the state of the longest match and, at the window's length, reads off the first document of
the window; stretches of such windows are the maximal spans to remove.

An automaton of all documents would not fit a task and streaming every document
through every shard's would be quadratic. So shards are made by content
(``repeats``): all occurrences of a window belong to one shard, and only pieces that
can repeat are sent there.

Cases: a null or empty text has no words and nothing to remove; a null id comes after
all others; rows with equal ids don't remove from each other; repeated rows get
equal results; an empty table gives no rows; words are kept unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from launchlens.llm import repeats
from launchlens.llm.text import flat, grams, hash_spans, slide, slices, window_rows, word_spans

WINDOW = 13
#: Words of a gram; the least gram hash of a window is its name.
GRAM = 5


class Automaton:
    """Suffix automaton of several word sequences, added in ascending order of their document."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [repeats.LAST]

    def _state(self, length: int, first: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, parent: int, symbol: int, child: int) -> int:
        """The state of the child's strings that are as long as the parent's and one symbol."""
        if self.length[child] == self.length[parent] + 1:
            return child
        twin = self._state(self.length[parent] + 1, self.first[child], self.link[child], dict(self.next[child]))
        self.link[child] = twin
        while parent != -1 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = twin
            parent = self.link[parent]
        return twin

    def add(self, symbols: list[int], document: int) -> None:
        last = 0
        for symbol in symbols:
            child = self.next[last].get(symbol)
            if child is not None:
                last = self._split(last, symbol, child)
                continue
            new = self._state(self.length[last] + 1, document, 0, {})
            at = last
            while at != -1 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            if at != -1:
                self.link[new] = self._split(at, symbol, self.next[at][symbol])
            last = new

    def first_documents(self, symbols: list[int], window: int) -> list[int]:
        """For each window of the sequence the first document that has it (``LAST`` if none has)."""
        out, state, matched = [], 0, 0
        following, link, length = self.next, self.link, self.length
        for i, symbol in enumerate(symbols):
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            child = following[state].get(symbol)
            if child is not None:
                state, matched = child, matched + 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(self.first[state] if matched >= window else repeats.LAST)
        return out


def _named(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one name: row, name, begin in the row, count."""
    name = slide(grams(hashes, gram), window - gram + 1)
    ok = window_rows(first, window, len(hashes))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(ok)]
    place = np.flatnonzero(ok)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    name, row = name[place], row[place]
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])])
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(place)))
    return row[starts], name[starts], place[starts] - first[row[starts]], count


def word_runs(column: pa.Array) -> tuple[np.ndarray, ...]:
    data, offsets = flat(column)
    starts, ends, first = word_spans(data, offsets)
    row, name, begin, count = _named(hash_spans(data, starts, ends), first, WINDOW, GRAM)
    return row, name, begin, count, np.zeros(len(row), np.int64)


def _word_contents(column: pa.Array, row: np.ndarray, begin: np.ndarray, count: np.ndarray) -> list[bytes]:
    data, offsets = flat(column)
    starts, ends, first = word_spans(data, offsets)
    raw = data.tobytes()
    lead = first[row] + begin
    return [b" ".join(raw[a:z].split()) for a, z in zip(starts[lead].tolist(), ends[lead + count + (WINDOW - 2)].tolist(), strict=True)]


def judge(contents: list[bytes], names: list[int], documents: list[int], counts: list[int]) -> list[bytes]:
    """For each piece the first document of each of its windows, as 64-bit integers."""
    numbers: dict[bytes, int] = {}
    sequences = [[numbers.setdefault(word, len(numbers)) for word in content.split()] for content in contents]
    automaton = Automaton()
    for i in sorted(range(len(contents)), key=documents.__getitem__):
        automaton.add(sequences[i], documents[i])
    return [np.array(automaton.first_documents(s, WINDOW), np.int64).tobytes() for s in sequences]


def _ranges(verdict: bytes, document: int, begin: int) -> list[tuple[int, int]]:
    earlier = np.frombuffer(verdict, np.int64) < document
    return [(begin + a, begin + z - 1 + WINDOW) for a, z in repeats.true_ranges(earlier)] if earlier.any() else []


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and further columns) with kept (words left, joined by one space), n_words, n_removed and spans.

    Further columns of these names are replaced.
    """
    rows = repeats.keyed(docs)
    runs = repeats.repeated_runs(rows, word_runs, within_row=False)
    spans = repeats.judged_spans(rows, runs, _word_contents, judge, _ranges)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, n_words, n_removed, gone = [], [], [], []
            for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                ranges = repeats.merged(found)
                n_words.append(len(words))
                for begin, end in reversed(ranges):
                    del words[begin:end]
                kept.append(b" ".join(words))
                n_removed.append(n_words[-1] - len(words))
                gone.append([{"begin": a, "end": z} for a, z in ranges])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "text", "rest")], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(gone, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "text", "rest", *_ADDED])

    # all columns pass, as above: one shuffle of the texts serves both joins
    joined = rows.join(spans.hint("shuffle_hash"), "owner", "left")
    span = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
    kinds = (StringType(), LongType(), LongType(), ArrayType(span))
    done = joined.mapInArrow(keep, StructType([
        *[joined.schema[c] for c in ("doc_id", "text", "rest")], *[StructField(n, kind) for n, kind in zip(_ADDED, kinds, strict=True)]]))
    rest = [F.col("rest").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text", *_ADDED)]
    return done.select("doc_id", "text", *rest, *_ADDED)


_ADDED = ("kept", "n_words", "n_removed", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with d as (
  select doc_id, row_number() over () as row,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select row, doc_id, i, array_to_string(w[i:i + 12], ' ') as win from (select row, doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
f as (select win, min(doc_id) as first from g group by win),
gone as (select distinct row, unnest(range(i, i + 13)) as i from g join f using (win) where f.first < g.doc_id),
k as (select row, doc_id, i, w[i] as x from (select row, doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
s as (select k.row, count(*) as n, string_agg(x, ' ' order by k.i) as kept from k left join gone on k.row = gone.row and k.i = gone.i where gone.i is null group by k.row)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s using (row)
"""

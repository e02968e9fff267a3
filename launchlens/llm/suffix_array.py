"""Suffix-array deduplication: Burrows-Wheeler transform and common prefixes of a collection, built column by column.

In round t the suffixes of length t of all strings are inserted at once, one symbol
per string: the stable order of the transform's symbols says where each goes,
and the least common prefix on the way from its neighbours gives its own, plus one.
State passes from round to round through two files in turn, each read and
written from front to back.

A round costs a pass over the whole collection, so collections must be short strings. That
is what the shards of ``repeats`` hold: pieces of some hundred bytes, all
occurrences of a window in one shard. Windows of which a 64-bit hash stands alone in
the shard cannot repeat; only the stretches of the others are ordered. A byte goes if a 200-byte string that covers
it starts anywhere else.

Cases: a null text is empty; texts below the window keep everything; matches never
cross documents; repeated rows are copies of each other and go both; long
runs of one byte are cut into pieces of bounded length; an empty table gives no
rows. Removal may cut inside a character, so what is left is binary.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlens.llm import repeats
from launchlens.llm.text import flat, mix, slices, slide

WINDOW = 200
#: Bytes of a gram; the least gram hash of a window is its name.
GRAM = 32
_INNER = WINDOW - GRAM + 1
#: Windows of a piece at most.
PIECE_WINDOWS = 256
#: Bytes of pieces that are looked through at once for windows that may repeat.
JUDGED_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Files:
    """Two files in turn: what a round writes from the front is what the next one reads."""

    def __init__(self, folder: str):
        self.files = [open(os.path.join(folder, name), "w+b", buffering=0) for name in ("even", "odd")]  # noqa: SIM115
        self.kinds: list[tuple[np.dtype, int]] = []

    def write(self, *columns: np.ndarray) -> None:
        self.files.reverse()
        self.kinds = [(c.dtype, len(c)) for c in columns]
        self.files[0].seek(0)
        for column in columns:
            self.files[0].write(column.data)

    def read(self) -> list[np.ndarray]:
        self.files[0].seek(0)
        return [np.fromfile(self.files[0], kind, n) for kind, n in self.kinds]

    def close(self) -> None:
        for file in self.files:
            file.close()


def collection_order(strings: list[bytes], cap: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: where each begins in the concatenation, its common prefix with the one before (at most ``cap``), and the transform.

    An end mark follows each string, smaller than every symbol; marks order by
    their strings. A suffix that is only a mark begins at the string's end.
    """
    with tempfile.TemporaryDirectory(dir=folder) as place, contextlib.closing(_Files(place)) as files:
        return _insert_columns(strings, cap, files)


def _insert_columns(strings: list[bytes], cap: int, files: _Files) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    if not len(text) or text.max() < 256:
        text = text.astype(np.uint8)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    # the symbol before each place of the text; 0, the mark, before a string's first; one entry more for the last end
    before = np.concatenate([np.zeros(1, text.dtype), text])
    first_of_end = before[ends] * (sizes > 0)
    marks = len(strings)
    before_start = before.copy()
    before_start[(ends - sizes)[sizes > 0]] = 0
    files.write(first_of_end.astype(text.dtype), np.zeros(marks, np.int16), ends.astype(np.int32))
    newest = np.flatnonzero(first_of_end)
    while len(newest):
        symbol, common, begin = files.read()
        n, more = len(symbol), len(newest)
        order = np.argsort(symbol, kind="stable")
        fresh = np.zeros(n, bool)
        fresh[newest] = True
        hit = np.flatnonzero(fresh[order])
        closed = n - np.count_nonzero(symbol)
        goal, source = marks + hit - closed, order[hit]
        own = symbol[source]
        with_last = np.append(common, np.int16(0))
        left, right = order[hit - 1], order[np.minimum(hit + 1, n - 1)]
        to_left = _least_between(with_last, left, source, (hit > 0) & (symbol[left] == own))
        to_right = _least_between(with_last, source, right, (hit + 1 < n) & (symbol[right] == own))
        old = np.ones(n + more, bool)
        old[goal] = False
        begin_new = begin[source] - 1
        symbol_new = before_start[begin_new]
        columns = []
        for column, values in ((symbol, symbol_new), (common, np.minimum(to_left, cap)), (begin, begin_new)):
            grown = np.empty(n + more, column.dtype)
            grown[old] = column
            grown[goal] = values
            columns.append(grown)
        after = goal + 1
        inside = after < n + more
        columns[1][after[inside]] = np.minimum(to_right, cap)[inside]
        files.write(*columns)
        newest = goal[symbol_new != 0]
    symbol, common, begin = files.read()
    return begin, common, symbol


def _least_between(common: np.ndarray, low: np.ndarray, high: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """One more than the least common prefix on the way from ``low`` to ``high``; 0 where not valid."""
    out = np.zeros(len(low), np.int32)
    pick = np.flatnonzero(valid)
    if len(pick):
        pick = pick[np.argsort(-low[pick])]
        pairs = np.stack([low[pick] + 1, high[pick] + 1], 1).ravel()
        out[pick] = np.minimum.reduceat(common, pairs)[::2].astype(np.int32) + 1
    return out


def byte_runs(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Runs of windows of one name: row, name, begin, count, and whether the name's gram occurs twice in the run."""
    data, offsets = flat(column)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, np.zeros(0, np.uint64), none, none, none
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    hashed = eight[: n - GRAM + 1].copy()
    for step in range(8, GRAM, 8):
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += eight[step: n - GRAM + 1 + step]
    hashed = mix(hashed)
    name = slide(hashed, _INNER)
    ok = np.ones(len(name), bool)
    for end in np.unique(offsets[1:]):
        ok[max(0, end - WINDOW + 1): end] = False
    place = np.flatnonzero(ok)
    if not len(place):
        return none, np.zeros(0, np.uint64), none, none, none
    named = name[place]
    row = np.searchsorted(offsets, place, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (place[1:] != place[:-1] + 1)]))
    count = np.diff(np.append(new, len(place)))
    twice = _twice(hashed, name, ok, place[new], count, named[new])
    # long runs are cut; their parts share the name, so they count as repeated
    parts = -(-count // PIECE_WINDOWS)
    which = np.repeat(np.arange(len(new)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = place[new][which] + nth * PIECE_WINDOWS
    size = np.minimum(PIECE_WINDOWS, count[which] - nth * PIECE_WINDOWS)
    rows = row[new][which]
    return rows, named[new][which], at - offsets[rows], size, twice[which].astype(np.int64)


def _twice(hashed: np.ndarray, name: np.ndarray, ok: np.ndarray, begin: np.ndarray, count: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Whether two grams with the run's name lie in the windows of a run."""
    edge = np.zeros(_INNER - 1, np.uint64)
    largest = slide(np.concatenate([edge, np.where(ok, name, np.uint64(0)), edge]), _INNER, np.maximum)
    chosen = np.flatnonzero(largest == hashed)
    values, number = np.unique(hashed[chosen], return_inverse=True)
    keys = np.sort((number.astype(np.int64) << 32) | chosen)
    own = np.searchsorted(values, named)
    at = np.searchsorted(keys, (own << 32) | begin)
    following = np.append(keys, [np.int64(1) << 62] * 2)[at + 1]
    return following < ((own << 32) | (begin + count + (_INNER - 1)))


def _byte_contents(column: pa.Array, row: np.ndarray, begin: np.ndarray, count: np.ndarray) -> list[bytes]:
    data, offsets = flat(column)
    raw = data.tobytes()
    lead = offsets[row] + begin
    return [raw[a:z] for a, z in zip(lead.tolist(), (lead + count + (WINDOW - 1)).tolist(), strict=True)]


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``WINDOW`` bytes from each position on, put together from halves."""
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    part, size = np.ndarray((len(data) - 7,), "<u8", padded, strides=(1,)), 8
    out, have = None, 0
    while True:
        if WINDOW & size:
            out = part if out is None else mix(part[: len(part) - have] * _ODD + out[size: size + len(part) - have])
            have += size
        if 2 * size > WINDOW:
            return out
        part, size = mix(part[: len(part) - size] * _ODD + part[size:]), 2 * size


def _stretches(strings: list[bytes]) -> list[tuple[int, int, int]]:
    """String, first window and end of every run of windows whose hash stands more than once: all others start nowhere else."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    hashed = _window_hashes(data)
    inside = np.ones(len(hashed), bool)
    for end in ends.tolist():
        inside[max(0, end - WINDOW + 1): end] = False
    place = np.flatnonzero(inside)
    order = np.argsort(hashed[place])
    ranked = hashed[place][order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(data) + 1, bool)
    again[place[order[1:][same]]] = True
    again[place[order[:-1][same]]] = True
    found = repeats.true_ranges(again)
    which = np.searchsorted(ends, [a for a, _ in found], "right").tolist()
    return [(i, a - (int(ends[i]) - len(strings[i])), z - (int(ends[i]) - len(strings[i]))) for i, (a, z) in zip(which, found, strict=True)]


def judge(contents: list[bytes], names: list[int], ranks: list[int], counts: list[int]) -> list[bytes]:
    """For each piece a byte for each window: 1 if the window's string starts elsewhere too.

    All strings of a piece that stands in several places start elsewhere. A name needs
    an order only if one of its pieces stands in one place, and of these pieces only
    the stretches that may repeat. Equal stretches are one string of the collection,
    and what holds for pieces in several places holds for them. Collections are made
    of stretches of about one length, as a round costs a pass however few still grow.
    """
    out = [b"\x01" * (len(c) - WINDOW + 1) for c in contents]
    single = {name for name, n in zip(names, counts, strict=True) if n == 1}
    judged = [i for i, name in enumerate(names) if name in single]
    numbers: dict[bytes, int] = {}
    places: list[int] = []
    name_of: list[int] = []
    cut = []
    for i, begin, end in _stretches([contents[i] for i in judged]):
        i = judged[i]
        number = numbers.setdefault(contents[i][begin: end + WINDOW - 1], len(numbers))
        if number == len(places):
            places.append(0)
            name_of.append(names[i])
        places[number] += counts[i]
        cut.append((i, begin, number))
    strings = list(numbers)
    flags = [b"\x01" * (len(s) - WINDOW + 1) for s in strings]
    longest: dict[int, int] = {}
    for s, name in zip(strings, name_of, strict=True):
        longest[name] = max(longest.get(name, 0), len(s))
    open_names = {name for name, n in zip(name_of, places, strict=True) if n == 1}
    ordered = sorted((n for n, name in enumerate(name_of) if name in open_names), key=lambda n: (longest[name_of[n]], name_of[n]))
    collection: list[int] = []
    size = 0
    for n, following in zip(ordered, [*ordered, None][1:], strict=True):
        collection.append(n)
        size += len(strings[n])
        if following is None or (size >= repeats.SHARD_BYTES and name_of[following] != name_of[n]):
            for m, found in zip(collection, _again([strings[m] for m in collection]), strict=True):
                if places[m] == 1:
                    flags[m] = found
            collection, size = [], 0
    for i in judged:
        if counts[i] == 1:
            out[i] = b"\x00" * len(out[i])
    verdicts: dict[int, bytearray] = {}
    for i, begin, number in cut:
        if counts[i] == 1:
            verdicts.setdefault(i, bytearray(out[i]))[begin: begin + len(flags[number])] = flags[number]
    for i, verdict in verdicts.items():
        out[i] = bytes(verdict)
    return out


def _again(strings: list[bytes]) -> list[bytes]:
    """For each string a byte for each window: 1 if it starts elsewhere in the collection too, by its neighbours in the order."""
    begin, common, _ = collection_order(strings, WINDOW)
    again = common >= WINDOW
    again[:-1] |= again[1:].copy()
    flags = np.zeros(int(begin.max(initial=0)) + 1, np.uint8)
    flags[begin[again]] = 1
    ends = np.cumsum([len(s) for s in strings]).tolist()
    return [flags[z - len(s): z - WINDOW + 1].tobytes() for s, z in zip(strings, ends, strict=True)]


def _ranges(verdict: bytes, _: int, begin: int) -> list[tuple[int, int]]:
    return [(begin + a, begin + z - 1 + WINDOW) for a, z in repeats.true_ranges(np.frombuffer(verdict, np.uint8))]


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, kept (binary), n_bytes, n_removed, spans (maximal removed runs, in bytes)."""
    rows = repeats.keyed(docs.select("doc_id", "text"))
    runs = repeats.repeated_runs(rows, byte_runs, within_row=True)
    spans = repeats.judged_spans(rows, runs, _byte_contents, judge, _ranges, JUDGED_BYTES)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, n_bytes, n_removed, gone = [], [], [], []
            for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                ranges = repeats.merged(found)
                parts, at = [], 0
                for begin, end in ranges:
                    parts.append(text[at:begin])
                    at = end
                kept.append(b"".join([*parts, text[at:]]))
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(kept[-1]))
                gone.append([{"begin": a, "end": z} for a, z in ranges])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(gone, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(spans.hint("shuffle_hash"), "owner", "left").mapInArrow(
        keep, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<begin:int,end:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

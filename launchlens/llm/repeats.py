"""Where windows of a fixed length repeat: what exact substring operators share.

Every window is named by the least hash of the grams in it. Neighbouring windows of
one name form a run, so a text has about two runs for each ``grams in a window``
symbols, and equal windows have equal names wherever they stand. Three steps follow:

1. Runs are packed by ranges of names and compared: only names that occur more than
   once go on. This is a filter; unequal windows with one name pass it.
2. The runs left are cut out of the texts as pieces and dealt by name, equal pieces
   of a slice once.
3. A shard of different pieces is judged exactly by the operator's own structure;
   thousands of copies are one piece. What is to go is sent to the rows.

A row is known by a hash of its id and text; repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.text import slices

LAST = (1 << 63) - 1
_FIELDS = ("name", "owner", "begin", "count")
#: A shard is handed to the judge when it holds so many bytes; pieces of one name stay together.
SHARD_BYTES = 128 << 10


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, owner (a hash of both), rank (the id; a null id comes last) and rest (the further columns)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("owner"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"),
        (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"))


def _squeeze(values: np.ndarray) -> bytes:
    """Differences, byte by byte in planes: sorted or small values leave mostly zeros."""
    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def _swell(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def repeated_runs(docs: DataFrame, runs_of: Callable, within_row: bool) -> DataFrame:
    """owner, runs (array of name, begin, count) whose names occur in two rows, or with ``within_row`` twice anywhere.

    ``runs_of(text column)`` gives arrays row, name, begin, count, twice (a run that may repeat itself).
    """
    def scan(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        row, name, begin, count, twice = runs_of(batch.column("text"))
        return name, batch.column("owner").to_numpy()[row], begin, count, twice

    found = repeated_names(docs.select("text", "owner"), scan, within_row)
    return found.groupBy("owner").agg(F.collect_set(F.struct("name", "begin", "count")).alias("runs"))


def _parts(docs: DataFrame) -> int:
    """Ranges of names: some for each shuffle partition, so that one fits a task with ease."""
    return 1 << int(np.ceil(np.log2(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _ranges_of_names(name: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The ranges that have some of the ascending names, and where."""
    edges = np.searchsorted(name >> np.uint64(64 - int(np.log2(parts))), np.arange(parts + 1))
    for part in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield part, slice(edges[part], edges[part + 1])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each range of names; the batches come sorted by ``part``."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != held[-1][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repeated_names(docs: DataFrame, scan: Callable, within_row: bool) -> DataFrame:
    """name, owner, begin, count of what ``scan(batch)`` finds, for names with two owners, or with ``within_row`` two entries or one that says twice."""
    parts = _parts(docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            name, owner, begin, count, twice = scan(batch)
            order = np.argsort(name)
            name = name[order]
            columns = (name, owner[order].view(np.uint64), begin[order], count[order] * 2 + twice[order])
            ranges = list(_ranges_of_names(name, parts))
            yield pa.record_batch({"part": pa.array([p for p, _ in ranges], pa.int32()), **{
                f: pa.array([_squeeze(c[at]) for _, at in ranges], pa.binary()) for f, c in zip(_FIELDS, columns, strict=True)}})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            name, owner, begin, count = (np.concatenate([_swell(v) for v in column]) for column in list(zip(*held, strict=True))[1:])
            order = np.argsort(name, kind="stable")
            name = name[order]
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            sizes = np.diff(np.append(starts, len(name)))
            if within_row:
                good = (sizes > 1) | (np.maximum.reduceat(count[order] & np.uint64(1), starts) > 0)
            else:
                good = np.minimum.reduceat(owner[order], starts) < np.maximum.reduceat(owner[order], starts)
            chosen = np.repeat(good, sizes)
            pick = order[chosen]
            yield pa.record_batch({
                "name": pa.array(name[chosen].view(np.int64)), "owner": pa.array(owner[pick].view(np.int64)),
                "begin": pa.array(begin[pick].astype(np.int32)), "count": pa.array((count[pick] >> np.uint64(1)).astype(np.int32))})

    packed = docs.mapInArrow(pack, "part int, " + ", ".join(f"{f} binary" for f in _FIELDS))
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(compare, "name long, owner long, begin int, count int")


def judged_spans(
        docs: DataFrame, runs: DataFrame, content_of: Callable, judge: Callable, ranges_of: Callable, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """owner, spans (array of begin, end, not yet merged) of what is to go from each row.

    ``content_of(text column, row, begin, count)`` cuts the pieces of the runs as
    bytes. Pieces travel packed by ranges of names, equal ones of a slice once.
    ``judge(contents, names, least ranks, numbers of occurrences)`` gives a verdict for each
    of a shard's different contents, about ``shard_bytes`` of them, and ``ranges_of(verdict, rank, begin)`` what it means for a row.
    """
    parts = _parts(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = batch.column("runs")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            name, begin, count = (a.to_numpy() for a in lists.flatten().flatten())
            order = np.argsort(name.view(np.uint64))
            row, name, begin, count = row[order], name[order].view(np.uint64), begin[order], count[order]
            contents = content_of(batch.column("text"), row, begin, count)
            owner, rank = (batch.column(c).to_numpy()[row].view(np.uint64) for c in ("owner", "rank"))
            rows = []
            for part, at in _ranges_of_names(name, parts):
                numbers: dict[bytes, int] = {}
                which = np.array([numbers.setdefault(c, len(numbers)) for c in contents[at]])
                names = np.zeros(len(numbers), np.uint64)
                names[which] = name[at]
                rows.append((part, zstandard.ZstdCompressor(level=3).compress(b"".join(numbers)), *map(
                    _squeeze, (np.array([len(c) for c in numbers]), names, which, owner[at], rank[at], begin[at]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True) if rows else [[]] * 8)], _PACKED)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            contents: dict[bytes, int] = {}
            names: list[int] = []
            found = []
            for _, text, sizes, name, which, owner, rank, begin in held:
                text = zstandard.ZstdDecompressor().decompress(text)
                ends = np.cumsum(_swell(sizes)).tolist()
                number = np.zeros(len(ends), np.int64)
                for i, (a, z, n) in enumerate(zip([0, *ends], ends, _swell(name).tolist(), strict=False)):
                    number[i] = contents.setdefault(text[a:z], len(contents))
                    if number[i] == len(names):
                        names.append(n)
                found.append((number[_swell(which).astype(np.int64)], *(_swell(c).view(np.int64) for c in (owner, rank, begin))))
            number, owner, rank, begin = (np.concatenate(c) for c in zip(*found, strict=True))
            least = np.full(len(contents), LAST)
            np.minimum.at(least, number, rank)
            often = np.bincount(number, minlength=len(contents))
            verdict = _judge_shards(list(contents), names, least.tolist(), often.tolist(), judge, shard_bytes)
            out = [(o, a, z) for n, o, r, b in zip(number.tolist(), owner.tolist(), rank.tolist(), begin.tolist(), strict=True)
                   for a, z in ranges_of(verdict[n], r, b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int32(), pa.int32()), strict=True)],
                ["owner", "begin", "end"])

    # all columns pass, so that the shuffle of the texts is the one that the caller's last join needs too
    met = docs.join(runs.hint("shuffle_hash"), "owner").select(*docs.columns, "runs")
    packed = met.mapInArrow(cut, "part int, " + ", ".join(f"{f} binary" for f in _PACKED[1:]))
    spans = packed.repartition("part").sortWithinPartitions("part").mapInArrow(decide, "owner long, begin int, end int")
    return spans.groupBy("owner").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


_PACKED = ["part", "text", "sizes", "name", "which", "owner", "rank", "begin"]


def _judge_shards(
        contents: list[bytes], names: list[int], ranks: list[int], counts: list[int], judge: Callable, shard_bytes: int = SHARD_BYTES) -> list[bytes]:
    """Verdicts for all contents, judged in shards of about ``shard_bytes`` in which each name is whole."""
    out: list[bytes] = [b""] * len(contents)
    shard: list[int] = []
    size = 0
    order = sorted(range(len(contents)), key=names.__getitem__)
    for i, following in zip(order, [*order[1:], None], strict=True):
        shard.append(i)
        size += len(contents[i])
        if following is None or (size >= shard_bytes and names[following] != names[i]):
            for j, verdict in zip(shard, judge(*([values[j] for j in shard] for values in (contents, names, ranks, counts))), strict=True):
                out[j] = verdict
            shard, size = [], 0
    return out


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges in order with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in found or ()):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def true_ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

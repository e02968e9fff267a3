"""Sharding by a k-d tree: split at weighted medians along the widest metadata dimension until leaves reach the target bytes.

Only built-in functions run here. A median is found by narrowing a key range with
weight histograms: each pass sends at most ``BINS`` sums for each open node to the
driver, whatever the number of rows. Rows with equal values are told apart by a
checksum of their id, so no value is too frequent to be split.

Cases: a null text has size 1 and the checksum of an empty text; a null in a
dimension counts as the least value; repeated rows are rows of their own; an empty
table gives no rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlens.llm.store import settled

BINS = 4096
_VALUE_BITS, _TIE_BITS = 31, 32
#: Rows that are numbered together within a shard.
SLOT_ROWS = 5000


def _by_node(values: list, kind: str, node: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), node)


def kd_shards(rows: DataFrame, weight: Column, dimensions: dict[str, Column], tie: Column, target: float | None = None, shards: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` (int): leaves of a k-d tree over numeric dimensions, numbered from left to right.

    Give the target weight of a leaf or the number of shards. Dimensions are
    compared by the share of their whole range that a node spans.
    """
    names = [f"__d{i}" for i in range(len(dimensions))]
    table = rows.withColumns({"__w": weight.cast("long"), "__t": tie.cast("long"), **{
        n: c.cast("double") for n, c in zip(names, dimensions.values(), strict=True)}})
    ends = table.agg(F.sum("__w").alias("w"), *[f(n).alias(f"{n}{s}") for n in names for f, s in ((F.min, "a"), (F.max, "z"))]).first()
    if ends["w"] is None:
        return rows.withColumn("shard", F.lit(0))
    shards = shards or max(1, math.ceil(ends["w"] / target))
    top = float((1 << _VALUE_BITS) - 1)

    def scaled(name: str) -> Column:
        low, high = ends[f"{name}a"], ends[f"{name}z"]
        if low is None or high == low:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(name) - F.lit(low)) / F.lit(high - low) * F.lit(top)).cast("long"), F.lit(0).cast("long"))

    table = table.withColumns({n: scaled(n) for n in names}).withColumn("__node", F.lit(0))
    parts = [shards]
    while max(parts) > 1:
        table, parts = _split(table, names, parts, ends["w"] / shards)
    leaves, n = [], 0
    for size in parts:
        leaves.append(n)
        n += size
    return table.withColumn("shard", _by_node(leaves, "int", F.col("__node"))).drop("__w", "__t", "__node", *names)


def _split(table: DataFrame, names: list[str], parts: list[int], leaf: float) -> tuple[DataFrame, list[int]]:
    """One level: each node with more than one shard gets a left and a right child; the others keep one."""
    spans = {row["__node"]: row for row in table.groupBy("__node").agg(
        F.sum("__w").alias("w"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).collect()}
    widest = [max(range(len(names)), key=lambda i: (spans[node][names[i]], -i)) if node in spans else 0 for node in range(len(parts))]
    value = F.get(F.array(*names), _by_node(widest, "int", F.col("__node")))
    keyed = table.withColumn("__key", value * (1 << _TIE_BITS) + F.col("__t"))
    edges = _weighted_cuts(keyed, parts, {node: row["w"] for node, row in spans.items()}, leaf)
    children, first = [], []
    for size in parts:
        first.append(len(children))
        children += [size // 2, size - size // 2] if size > 1 else [size]
    right = (F.col("__key") >= _by_node(edges, "long", F.col("__node"))).cast("int")
    return keyed.withColumn("__node", _by_node(first, "int", F.col("__node")) + right).drop("__key"), children


def _weighted_cuts(keyed: DataFrame, parts: list[int], weights: dict[int, int], leaf: float) -> list[int]:
    """For each node the key at which its left shards have had their share of the weight; the largest long where nothing is split."""
    never, node = (1 << 63) - 1, F.col("__node")
    low = [0] * len(parts)
    want = [weights.get(n, 0) * (size // 2) / size for n, size in enumerate(parts)]
    open_nodes = {n for n, size in enumerate(parts) if size > 1 and n in weights}
    edges = [never] * len(parts)
    bits = _VALUE_BITS + _TIE_BITS
    while open_nodes:
        shift = max(0, bits - BINS.bit_length() + 1)
        offset = F.col("__key") - _by_node(low, "long", node)
        live = _by_node([n in open_nodes for n in range(len(parts))], "boolean", node)
        inside = keyed.where(live).where((offset >= 0) & (offset <= (1 << bits) - 1))
        bins = inside.groupBy("__node", F.shiftright(offset, shift).alias("bin")).agg(F.sum("__w").alias("w"))
        sums: dict[int, dict[int, int]] = {}
        for row in bins.collect():
            sums.setdefault(row["__node"], {})[row["bin"]] = row["w"]
        for n in list(open_nodes):
            at, last = 0, 0
            for last, weight in sorted(sums.get(n, {}).items()):  # noqa: B007
                if at + weight >= want[n]:
                    break
                at += weight
            begin, weight = low[n] + (last << shift), sums.get(n, {}).get(last, 0)
            if not shift or weight <= leaf / 10_000:
                edges[n] = begin + ((1 << shift) if want[n] - at > weight / 2 else 0)
                open_nodes.discard(n)
            else:
                want[n] -= at
                low[n] = begin
        bits = shift
    return edges


def slots(sharded: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``sharded`` with ``slot`` (long), gapless from 0 in each shard: rows are numbered in small hash buckets whose counts are added up."""
    buckets = max(1, math.ceil(rows / SLOT_ROWS))
    dealt = sharded.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "__b").count()
    before = F.expr("coalesce(sum(count) over (partition by shard order by __b rows between unbounded preceding and 1 preceding), 0)")
    starts = counts.select("shard", "__b", before.alias("__s"))
    placed = dealt.withColumn("__n", F.expr(f"row_number() over (partition by shard, __b order by {', '.join(order)})"))
    return placed.join(starts, ["shard", "__b"]).withColumn("slot", F.col("__s") + F.col("__n") - 1).drop("__b", "__s", "__n")


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for ``docs`` (doc_id, text, lang, source): shards of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    meta = settled(docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.crc32(F.coalesce("source", F.lit(""))).alias("source"),
        F.crc32(F.coalesce("lang", F.lit(""))).alias("lang")))
    tree = kd_shards(
        meta, F.col("size"), {"size": F.log("size"), "lang": F.col("lang"), "source": F.col("source"), "id": F.col("doc_id")},
        F.crc32(F.col("row").cast("string")), shards=shards)
    sharded = settled(tree.select("doc_id", "row", "size", "text_crc32", "shard"))
    return slots(sharded, ["doc_id", "row"], sharded.count()).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = document_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles; two link when intersection over union reaches
the threshold. Documents with equal sets are one node from the start. Candidates
share a token among the rarest of each: a linked pair has one there, the order
being frequent tokens last (of those that repeat within a slice of the corpus, the
most frequent ones are known to all tasks) and by hash otherwise, which is a matter
of speed only. Then

1. every node is compared with one pivot for each of its tokens; linked nodes are
   similar and form groups;
2. components of fewer than ``GROUP`` nodes that have the same pivot, whether they reached
   the threshold or just missed it, are one group too, so that a family of near misses
   is not a group for each of its nodes. The token-group matrix holds each group in
   parts of about ``GROUP`` nodes. A node meets
   the groups with nodes of other, larger components with which it shares a rare token. Counts of tokens by
   their high bits bound its overlap with every member (the union of 64 members would bound
   next to nothing), so that tokens are fetched only for nodes and members with room for the threshold.
   Among these its overlap with the union of the members' tokens comes first, and only groups that reach the
   threshold by it are opened and compared member by member.

Both steps emit about as many rows as there are shared tokens, whatever the size of
a group of near copies, and between them every pair that can link is compared or
already connected.

Cases: a text without words, or a null, is empty and linked with nothing; a text
shorter than a shingle is one shingle; a null id takes part, but its component
is named by the other ids, or null; repeated rows are linked with each other; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlens.llm.components import components
from launchlens.llm.repeats import repeated_names
from launchlens.llm.store import release, settled
from launchlens.llm.text import LOWER, flat, grams, hash_spans, mix, slices, window_rows, word_spans

SHINGLE = 5
#: The threshold as a fraction: 3 / 4.
OVER, UNDER = 3, 4
GROUP = 64
#: Frequent tokens that all tasks know, and in how many sets of a slice a token must be to be counted.
FREQUENT, REPEATS = 200_000, 3
#: Up to so many rows (of a long each) are named to all tasks; more are joined by shuffle.
OWNERS = 500_000
PAIRS = 512


def token_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, ascending within a row, and where each row's begin."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    hashes = hash_spans(data, starts, ends)
    ok = window_rows(first, SHINGLE, len(hashes))
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(ok)][ok]
    tokens = grams(hashes, SHINGLE)[ok]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        whole = [grams(hashes[first[r]: first[r + 1]], int(sizes[r]))[0] + np.uint64(sizes[r]) for r in short]
        row, tokens = np.concatenate([row, short]), np.concatenate([tokens, mix(np.array(whole, np.uint64))])
    order = np.argsort(tokens)
    order = order[np.argsort(row[order].astype(np.uint16) if len(sizes) < 65536 else row[order], kind="stable")]
    row, tokens = row[order], tokens[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    row, tokens = row[new], tokens[new]
    return tokens, np.searchsorted(row, np.arange(len(sizes) + 1))


def _nodes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each row's set; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(1)), dtype=np.uint64)])
    sizes = np.diff(first).astype(np.uint64)
    out = mix((total[first[1:]] - total[first[:-1]]) + sizes * np.uint64(0x9E3779B97F4A7C15))
    return np.where(sizes > 0, out, np.uint64(0)).view(np.int64)


def _bins(tokens: np.ndarray, first: np.ndarray) -> list[bytes]:
    """How many tokens of each row have which high bits: about two tokens to a bin, 16 to 65,536 bins."""
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        bits = min(16, max(4, (z - a).bit_length() - 1))
        out.append(_packed(np.bincount((tokens[a:z] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)))
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counts (an even number of them, up to 65,535 each) in 4, 8 or 16 bits, as the largest needs, after a byte that says how many."""
    top = int(counts.max())
    if top < 16:
        return b"\x04" + (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return b"\x08" + counts.astype(np.uint8).tobytes() if top < 256 else b"\x10" + np.minimum(counts, 65535).astype(np.uint16).tobytes()


def _counts(packed: bytes) -> np.ndarray:
    if packed[0] == 16:
        return np.frombuffer(packed, np.uint16, offset=1).astype(np.int64)
    raw = np.frombuffer(packed, np.uint8, offset=1)
    return (raw if packed[0] == 8 else np.column_stack([raw & 15, raw >> 4]).ravel()).astype(np.int64)


def _folded(bins: np.ndarray, size: int) -> np.ndarray:
    return bins.reshape(size, -1).sum(1) if len(bins) > size else bins


def _most_common(query: bytes, members: list[bytes]) -> int:
    """The most tokens that a set can share with one of several others, by their bins."""
    each = [_counts(b) for b in (query, *members)]
    size = min(map(len, each))
    own, *others = [_folded(b, size) for b in each]
    return int(np.minimum(own, np.max(others, axis=0)).sum())


def _survey(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: for documents their owner, id, set size and node; for repeated tokens the token and its number of sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            tokens, first = token_sets(batch.column("text"))
            node, size = _nodes(tokens, first), np.diff(first)
            _, once = np.unique(node, return_index=True)
            kept = np.zeros(len(node), bool)
            kept[once] = True
            found, n = np.unique(tokens[np.repeat(kept, size)], return_counts=True)
            found, n = found[n >= REPEATS], n[n >= REPEATS]
            none = pa.nulls(len(found), pa.int64())
            yield pa.record_batch({
                "doc_id": pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), none]),
                "owner": pa.concat_arrays([batch.column("owner"), none]),
                "node": pa.concat_arrays([pa.array(node), pa.array(found.view(np.int64))]),
                "n": pa.concat_arrays([pa.array(size), pa.array(n)]),
                "bins": pa.array([*_bins(tokens, first), *[None] * len(found)], pa.binary()),
                "document": pa.array(np.arange(len(node) + len(found)) < len(node))})

    return docs.mapInArrow(scan, "doc_id long, owner long, node long, n long, bins binary, document boolean")


def _rare_tokens(docs: DataFrame, frequent) -> DataFrame:
    """node, token, n of the tokens that a linked pair must share one of, where more than one node has them."""

    def scan(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        tokens, first = token_sets(batch.column("text"))
        node, size = _nodes(tokens, first), np.diff(first)
        _, once = np.unique(node, return_index=True)
        kept = np.zeros(len(node), bool)
        kept[once] = True
        kept &= size > 0
        row = np.repeat(np.arange(len(size)), size)
        common = frequent.value
        if len(common):
            at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1) if len(common[0]) else None
            weight = np.where(common[0][at] == tokens, common[1][at], 0) if at is not None else np.zeros(len(tokens), np.int64)
        order = np.lexsort((tokens, weight, row))
        nth = np.arange(len(tokens)) - first[row]
        take = (nth <= size[row] - -(-size[row] * OVER // UNDER)) & kept[row]
        tokens, row = tokens[order][take], row[take]
        zero = np.zeros(len(row), np.int64)
        return tokens, node[row], size[row], zero, zero

    found = repeated_names(docs.select("text"), scan, within_row=False)
    return found.select(F.col("owner").alias("node"), F.col("name").alias("token"), F.col("begin").alias("n"))


def _token_table(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """node, tokens (bytes of ascending 64-bit hashes) of the rows named by ``owners``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, first = token_sets(batch.column("text"))
            raw = tokens.tobytes()
            yield pa.record_batch({
                "node": pa.array(_nodes(tokens, first)),
                "tokens": pa.array([raw[8 * a: 8 * z] for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())})

    n = owners.count()
    met = docs.select("owner", "text").join(F.broadcast(owners) if n <= OWNERS else owners, "owner", "left_semi")
    return met.mapInArrow(scan, "node long, tokens binary")


def _reaches(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return UNDER * common >= OVER * (a + b - common)


def _can_reach(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """Those ``pairs`` (a, b) whose bins leave room for the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, (m, n, left, right) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("m", "n", "left", "right")], strict=True))
                    if _reaches(_most_common(left, [right]), m, n)]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    left = bins.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bins").alias("left"))
    right = bins.select(F.col("node").alias("b"), "n", F.col("bins").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "left", "right").mapInArrow(check, "a long, b long")


def _compare_pairs(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """a, b of those ``pairs`` whose sets reach the threshold; the pairs of a pivot meet it in parts of about ``PAIRS``."""

    def compare(some: pa.Table, pivot: pa.Table) -> pa.Table:
        kept = []
        if some.num_rows and pivot.num_rows:
            right = np.frombuffer(pivot.column("packed")[0].as_py(), np.uint64)
            for i, left in enumerate(some.column("tokens")):
                left = np.frombuffer(left.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                if _reaches(int(np.count_nonzero(left[at] == right)), len(left), len(right)):
                    kept.append(i)
        return some.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    often = pairs.groupBy("b").agg(F.count("*").alias("often"))
    dealt = pairs.join(often, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("often") / PAIRS)).alias("part"))
    left = dealt.join(table.select(F.col("node").alias("a"), "tokens"), "a").select("a", "b", "part", "tokens")
    right = dealt.select("b", "part").distinct().join(table.select(F.col("node").alias("b"), "tokens"), "b").select(
        "b", "part", "tokens").toDF("pivot", "q", "packed")
    return left.groupBy("b", "part").cogroup(right.groupBy("pivot", "q")).applyInArrow(compare, "a long, b long")


def _pivot_pairs(rare: DataFrame) -> DataFrame:
    """Each node with the least node of each of its tokens, where their sizes allow a link."""
    pivots = rare.groupBy("token").agg(F.min(F.struct("node", "n")).alias("p"))
    met = rare.join(pivots, "token").where(F.col("node") != F.col("p.node"))
    fits = F.least("n", "p.n") * UNDER >= F.greatest("n", "p.n") * OVER
    return met.where(fits).select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()


def _group_links(rare: DataFrame, labels: DataFrame, pivots: DataFrame, bins: DataFrame, table_of: Callable) -> DataFrame:
    """Links between components: nodes against the groups that they share a rare token with."""
    least = pivots.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("pivot"))
    kin = labels.join(least, "node", "left").groupBy("label").agg(
        F.count("*").alias("size"), F.min(F.coalesce("pivot", "node")).alias("pivot"))
    kin = kin.select("label", "size", F.when(F.col("size") < GROUP, F.col("pivot")).otherwise(F.col("label")).alias("g"))
    parts = kin.groupBy("g").agg(F.ceil(F.sum("size") / GROUP).alias("parts"))
    placed = labels.join(kin.join(parts, "g"), "label").select(
        "node", "label", "size", "g", F.pmod(F.xxhash64("node"), "parts").alias("p"))
    marked = rare.select("token", "node", "n").join(placed, "node")
    split = marked.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a < z").select("token")
    mixed = settled(marked.join(split, "token", "left_semi"))
    matrix = mixed.groupBy("token", "g", "p").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.struct("size", "label")).alias("top"))
    # of two components the smaller one asks
    asks = F.struct("size", "label") < F.col("top")
    fits = (F.col("n") * UNDER >= F.col("low") * OVER) & (F.col("high") * UNDER >= F.col("n") * OVER)
    wanted = mixed.drop("g", "p").join(matrix, "token").where(asks & fits).select("node", "g", "p").distinct()
    placed = settled(placed.select("g", "p", F.col("node").alias("member")))

    def bound(asks: pa.Table, group: pa.Table) -> pa.Table:
        """The nodes that some member leaves room for, and such members."""
        node, member = [], np.zeros(group.num_rows, bool)
        if asks.num_rows and group.num_rows:
            each = [_counts(b) for b in group.column("other").to_pylist()]
            sizes, widths = group.column("m").to_numpy(), np.array([len(e) for e in each])
            alike = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
            of_width = {(w, w): np.stack([each[i] for i in alike[w]]).astype(np.int32) for w in alike}
            for ask, n, own in zip(*[asks.column(c).to_pylist() for c in ("node", "n", "bins")], strict=True):
                own, found = _counts(own), False
                for w, at in alike.items():
                    size = min(w, len(own))
                    if (w, size) not in of_width:
                        of_width[w, size] = of_width[w, w].reshape(len(at), size, -1).sum(2)
                    common = np.minimum(of_width[w, size], _folded(own, size)).sum(1)
                    reached = at[_reaches(common, n, sizes[at])]
                    member[reached] = True
                    found = found or len(reached) > 0
                if found:
                    node.append(ask)
        nodes = [*node, *group.column("member").filter(pa.array(member)).to_pylist()]
        g, p = (([t.column(c)[0].as_py() for t in (group,) if t.num_rows] * len(nodes))[: len(nodes)] for c in ("h", "q"))
        return pa.table({"node": pa.array(nodes, pa.int64()), "g": pa.array(g, pa.int64()), "p": pa.array(p, pa.int64()),
                         "member": pa.array(np.arange(len(nodes)) >= len(node))})

    # asks of a part of a group meet it in lots of about PAIRS
    wanted = settled(wanted)
    often = wanted.groupBy("g", "p").agg(F.ceil(F.count("*") / PAIRS).alias("lots"))
    asks = wanted.join(often, ["g", "p"]).withColumn("lot", F.pmod(F.xxhash64("node"), "lots")).join(bins, "node").select(
        "g", "p", "lot", "node", "n", "bins")
    lots = often.select("g", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))
    met = placed.join(lots, ["g", "p"]).join(bins.select(F.col("node").alias("member"), F.col("n").alias("m"), F.col("bins").alias("other")), "member")
    met = met.select(F.col("g").alias("h"), F.col("p").alias("q"), F.col("lot").alias("l"), "member", "m", "other")
    open_ = settled(asks.groupBy("g", "p", "lot").cogroup(met.groupBy("h", "q", "l")).applyInArrow(
        bound, "node long, g long, p long, member boolean"))
    release(bins.sparkSession)
    wanted = open_.where("not member").drop("member")
    opened = settled(open_.where("member").select("g", "p", F.col("node").alias("member")).distinct())
    table = table_of(wanted.select("node").union(opened.select("member")).distinct())
    members = opened.withColumnRenamed("member", "node").join(table, "node")

    def search(queries: pa.Table, group: pa.Table) -> pa.Table:
        left, right = [], []
        nodes = group.column("member").to_pylist()
        each = [np.frombuffer(t, np.uint64) for t in group.column("packed").to_pylist()]
        if each and queries.num_rows:
            sizes = np.array([len(e) for e in each])
            together = np.concatenate(each)
            order = np.argsort(together)
            place, owner = together[order], np.repeat(np.arange(len(each)), sizes)[order]
            union = np.unique(place)
            for node, own in zip(queries.column("node").to_pylist(), queries.column("tokens").to_pylist(), strict=True):
                query = np.frombuffer(own, np.uint64)
                at = np.minimum(np.searchsorted(union, query), len(union) - 1)
                within = query[union[at] == query]
                if UNDER * len(within) < OVER * len(query):
                    continue  # the group stays closed
                begin, end = np.searchsorted(place, within), np.searchsorted(place, within, "right")
                spread = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange((end - begin).sum())
                common = np.bincount(owner[spread], minlength=len(nodes))
                for m in np.flatnonzero(_reaches(common, len(query), sizes)):
                    left.append(node)
                    right.append(nodes[m])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    asking = wanted.join(table, "node").select("g", "p", "node", "tokens")
    return asking.groupBy("g", "p").cogroup(
        members.select("g", "p", "node", "tokens").toDF("h", "q", "member", "packed").groupBy("h", "q")).applyInArrow(search, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, owner (a hash of id and text), n (set size), label (the component, null without words) and component_id of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("owner"))
    survey = settled(_survey(rows))
    base = survey.where("document").drop("document")
    often = survey.where("not document").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).toArrow()
    token, n = often.column("node").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(token)
    frequent = spark.sparkContext.broadcast((token[order], n[order]))
    rare = settled(_rare_tokens(rows, frequent))
    bins = base.join(rare.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.first("n").alias("n"), F.first("bins").alias("bins"), F.min("owner").alias("owner"))
    bins = settled(bins)
    release(spark)

    def table_of(nodes: DataFrame) -> DataFrame:
        table = settled(_token_table(rows, settled(bins.join(nodes, "node", "left_semi").select("owner"))))
        release(spark)
        return table

    pivots = settled(_pivot_pairs(rare))
    pairs = settled(_can_reach(pivots, bins))
    near = settled(_compare_pairs(pairs, table_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())))
    release(spark)
    grouped = components(near)
    lone = rare.select("node").distinct().join(grouped, "node", "left_anti").select("node", F.col("node").alias("label"))
    more = settled(_group_links(rare, settled(grouped.unionByName(lone)), pivots, bins.drop("owner"), table_of))
    release(spark)
    labels = components(near.unionByName(more))
    named = base.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(labels, "node", "left")
    named = named.select("node", F.coalesce("label", "node").alias("label"), "first")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "label").select("node", "label", "component_id")
    return base.join(ids, "node", "left").select(
        "doc_id", "owner", "n", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component, that of the least id, and all rows without words."""
    found = near_groups(docs.select("doc_id", "text")).where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "owner")
    leaders = found.groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.owner").alias("__owner"))
    keyed = docs.withColumn("__owner", F.xxhash64(F.col("doc_id"), F.col("text")))
    empty = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(~empty).join(leaders, "__owner", "left_semi").dropDuplicates(["__owner"])
    return kept.unionByName(keyed.where(empty)).drop("__owner")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")

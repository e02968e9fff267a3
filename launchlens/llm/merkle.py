"""Merkle manifest of a dataset: fanout-8 trees by group, proofs of all rows by a butterfly exchange.

Rows are leaves. The leaves of a group (here: a language) stand in order of their
id and are dealt into aligned blocks of ``FANOUT ** BLOCK_LEVELS``; the tree inside a
block is built where the block is. From then on blocks take part in a butterfly: in round
r those eight blocks meet whose numbers differ in their r-th octal digit only, swap the
roots of the subtrees they stand for, and each of them hashes the ancestor by itself.
After the last round every block knows its group's root and all siblings on the way,
so no pass goes down the tree again. A cut-off last subtree has fewer blocks than
partners who ask for its root; its blocks answer for those that do not exist. The
groups' roots are the leaves of one more tree of the same kind.

A round shuffles a row for each block, never rows of the table, and a meeting has at
most eight members, so a language with a third of all rows is many even blocks.

Cases: nulls in any column are leaves of their own mark; rows without an id come
first, rows without a language are a group that comes first; rows of one id
are ordered by their leaf; repeated rows are leaves each (equal ones are
interchangeable); an empty table gives an empty result; the further columns are not
part of a leaf, and none is named in the result. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from launchlens.llm.store import settled

FANOUT = 8
#: Levels of a tree that are built inside a block: blocks have up to 512 leaves.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def marked(value: Column) -> Column:
    """A value with its length in front, so that joined values stay apart; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(marked, values)), 256)


def positions(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, the number of a row in its group from 0 on, and ``n``, the group's size.

    Rows are sorted by ranges of (group, order); a group of any size is spread over
    many ranges, and only counts by range and group are added up to offsets.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    spread = df.withColumn("tie", F.monotonically_increasing_id())  # equal rows need not share a range
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(
        spread.repartitionByRange(parts, *keys, F.col("tie")).sortWithinPartitions(*keys, "tie").drop("tie")
        .withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = placed.groupBy(F.col(group).alias("of"), part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({
        "before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("of"))})
    met = placed.join(offsets, placed[group].eqNullSafe(offsets["of"]) & (part == offsets["part"]))
    return met.select(*df.columns, (F.col("place") - F.col("first") + F.col("before")).alias("pos"), "n")


def _run(nodes: Column, first: Column, length: Column | int) -> Column:
    return F.concat_ws("", F.slice(nodes, first + 1, length))


def _above(nodes: Column) -> Column:
    """The next level: every eight nodes hashed to one."""
    last = F.ceil(F.size(nodes) / FANOUT).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(_run(nodes, i * FANOUT, FANOUT), 256))


def _around(nodes: Column, i: Column) -> Column:
    """What stands left and right of node ``i`` in its run."""
    begin = (F.floor(i / FANOUT) * FANOUT).cast("int")
    return F.struct(_run(nodes, begin, i - begin).alias("left"), _run(nodes, i + 1, begin + FANOUT - 1 - i).alias("right"))


def blocks(leaves: DataFrame, group: str, payload: Sequence[str]) -> DataFrame:
    """group, block, nblocks, l0.. (nodes of the levels inside the block), root and ``rows`` (the payload, by position).

    ``leaves`` has ``group``, pos, n, leaf and the payload. A group of one block ends
    as soon as one node remains, others climb all levels of a block.
    """
    size = FANOUT ** BLOCK_LEVELS
    packed = leaves.groupBy(group, F.floor(F.col("pos") / size).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "leaf", *payload))).alias("rows"), F.max("n").alias("n"))
    out = packed.select(group, "block", F.ceil(F.col("n") / size).alias("nblocks"), "rows", F.col("rows.leaf").alias("l0"))
    for level in range(BLOCK_LEVELS):
        here = F.col(f"l{level}")
        more = (F.col("nblocks") > 1) | (F.size(here) > 1)
        out = out.withColumn(f"l{level + 1}", F.when(more, _above(here)).otherwise(here))
    return out.withColumn("root", F.col(f"l{BLOCK_LEVELS}")[0])


def butterfly(roots: DataFrame, group: str) -> DataFrame:
    """group, block, root (of the group) and ``proof``, an array of (left, right) from the block's root up.

    ``roots`` has group, block, nblocks and root. The number of rounds follows the
    largest group; groups that are done sit out.
    """
    top = roots.agg(F.max("nblocks")).first()[0] or 0
    state = roots.select(group, "block", "nblocks", "root", F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    reach = 1  # blocks of a whole subtree
    while reach < top:
        state = _round(state, group, reach)
        reach *= FANOUT
    return state


def _round(state: DataFrame, group: str, reach: int) -> DataFrame:
    """Subtrees of ``reach`` blocks join to subtrees of eight times as many."""
    low, tree = F.col("block") % reach, F.floor(F.col("block") / reach)
    have = F.least(F.lit(reach), F.col("nblocks") - tree * reach)  # blocks of this subtree
    # a block stands for its own place in the subtree and for the missing ones that are congruent to it
    asked = F.sequence(low, F.lit(reach - 1).cast("long"), have)
    open_ = F.col("nblocks") > reach
    sent = state.where(open_).select(
        group, F.explode(asked).alias("low"), F.floor(tree / FANOUT).alias("above"), (tree % FANOUT).alias("digit"), "root", "block", "nblocks",
        "proof").withColumn("real", F.col("block") % reach == F.col("low"))
    met = sent.groupBy(group, "above", "low", "nblocks").agg(
        F.array_sort(F.collect_list(F.struct("digit", "root", "block", "real", F.when(F.col("real"), F.col("proof")).alias("proof")))).alias("members"))
    nodes = F.col("members.root")
    swapped = met.select(group, "nblocks", nodes.alias("nodes"), F.sha2(F.concat_ws("", nodes), 256).alias("root"), F.posexplode("members"))
    grown = swapped.where("col.real").select(
        group, F.col("col.block").alias("block"), "nblocks", "root",
        F.array_append("col.proof", _around(F.col("nodes"), F.col("pos"))).alias("proof"))
    return settled(grown.unionByName(state.where(~open_)))


def _tree(leaves: DataFrame, group: str, payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Every leaf with its payload, root and proof (array of left and right); and every group with its root.

    ``leaves`` has ``group``, pos, n, leaf and the payload.
    """
    whole = blocks(leaves, group, payload)
    ways = butterfly(settled(whole.select(group, "block", "nblocks", "root")), group)
    way = ways.select(F.col(group).alias("of"), F.col("block").alias("number"), F.col("root").alias("top"), "proof")
    met = whole.join(way, whole[group].eqNullSafe(way["of"]) & (whole["block"] == way["number"]))
    rows = met.select(group, "top", "proof", "nblocks", *[f"l{i}" for i in range(BLOCK_LEVELS)], F.posexplode("rows").alias("i", "row"))
    inner = []
    for level in range(BLOCK_LEVELS):
        here, i = F.col(f"l{level}"), F.floor(F.col("i") / FANOUT ** level).cast("int")
        inner.append(F.when((F.col("nblocks") > 1) | (F.size(here) > 1), _around(here, i)))
    found = rows.select(
        group, *[F.col(f"row.{c}").alias(c) for c in payload], F.col("row.leaf").alias("leaf"), F.col("top").alias("root"),
        F.concat(F.array_compact(F.array(*inner)), "proof").alias("proof"))
    return found, ways.where("block = 0").select(group, "root")


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    return F.aggregate(proof, start, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def siblings(proof: Column) -> Column:
    """A digest of all siblings on the way, left to right and level by level."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda at: F.concat(at["left"], at["right"]))), 256)


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """lang, doc_id, leaf, subroot, root and proof (array of left and right siblings, from the leaf up) of every row.

    ``carry`` names further columns and how they follow from a row.
    """
    carry = carry or {}
    leaves = docs.select("lang", "doc_id", leaf(*map(F.col, FIELDS)).alias("leaf"), *[c.alias(name) for name, c in carry.items()])
    found, groups = _tree(positions(leaves, "lang", ["doc_id", "leaf"]), "lang", ["doc_id", *carry])
    over, _ = _tree(positions(groups.select(F.lit(0).alias("all"), "lang", F.col("root").alias("leaf")), "all", ["lang"]), "all", ["lang"])
    over = over.select(F.col("lang").alias("of"), F.col("root").alias("whole"), F.col("proof").alias("on"))
    met = found.join(over, found["lang"].eqNullSafe(over["of"]))
    return met.select("lang", "doc_id", "leaf", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("proof", "on").alias("proof"), *carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what verification says of rows whose text was tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = leaf(*[F.col(c) if c != "text" else F.translate("text", _UPPER, _LOWER) for c in FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(docs, {"changed": F.when(chosen, changed)})
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", siblings(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 8) -> str:
    """The same rows in SQL; enough for ``8 ** levels`` rows a language and as many languages.

    A level of a tree is a table; a group that has ended hands its root on unchanged.
    """
    def mark(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf_of(text: str) -> str:
        return "sha256(" + " || ".join(mark(v) for v in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)) + ")"

    crc = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ord(c)::bigint)), "
           "lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)::bigint[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        f"""raw as (select doc_id, lang, {leaf_of('text')} as leaf,
  case when doc_id is not null and {crc} % 3 = 0 then {leaf_of(lower)} else {leaf_of('text')} end as start from documents)""",
        """d0 as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from raw)""",
        "a0 as (select coalesce('+' || lang, '-') as g, pos, leaf as h from d0)",
        "d1 as (select doc_id, leaf, start, coalesce('+' || lang, '-') as g, lang, pos from d0)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(f"{name}r{k} as (select g, pos // 8 as pos, list(h order by pos) as hs, any_value(n) as n from "
                         f"(select *, count(*) over (partition by g) as n from {name}{k}) group by g, pos // 8)")
            parts.append(f"{name}{k + 1} as (select g, pos, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}r{k})")

    climb("a")
    parts.append(f"b0 as (select 'all' as g, row_number() over (order by case when g = '-' then 0 else 1 end, encode(g)) - 1 as pos, h, g as lang_g from a{levels})")
    climb("b")
    fields, joins, path, node = [], [], [], "start"
    for name, at, g in (("a", "d.pos", "d.g"), ("b", "t.pos", "'all'")):
        for k in range(levels):
            run, i = f"{name}{k}x", f"(({at} // {8 ** k}) % 8)"
            joins.append(f"join {name}r{k} as {run} on {run}.g = {g} and {run}.pos = {at} // {8 ** (k + 1)}")
            fields.append(f"case when {run}.n > 1 then array_to_string({run}.hs[1:{i}], '') end as {name}l{k}")
            fields.append(f"case when {run}.n > 1 then array_to_string({run}.hs[{i} + 2:], '') end as {name}u{k}")
            path.append(f"coalesce({name}l{k} || {name}u{k}, '')")
    parts.append(f"ways as (select d.doc_id, d.leaf, d.start, t.h as subroot, z.h as root, {', '.join(fields)} from d1 as d join b0 as t on t.lang_g = d.g "
                 f"cross join b{levels} as z {' '.join(joins)})")
    last = "ways"
    for step, level in enumerate([f"{name}{{}}{k}" for name in "ab" for k in range(levels)]):
        left, right = level.format("l"), level.format("u")
        parts.append(f"f{step} as (select * replace (case when {left} is null then start else sha256({left} || start || {right}) end as start) from {last})")
        last = f"f{step}"
    return ("with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, root, sha256({' || '.join(path)}) as proof_sha256, start as folded_root, "
            f"start = root as verified from {last}")


SQL = _sql()

"""Benchmark decontamination: test n-grams as a hash set, a scan of all training word windows, hits verified word by word.

Only built-in functions run here. Each document row carries its own words through
the scan; only verified hits leave the row.

Cases: a null or empty text has no words and is never contaminated; an item
without words matches nothing; repeated rows are judged each; items that share a
window are all reported; an empty benchmark or document table gives no hits or no
rows. Columns are taken by name, so further columns of either table don't matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 13
#: Up to so many window keys the scan tests against a literal hash set; above, windows are joined by shuffle.
SET_LIMIT = 60_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of digits, letters and all characters beyond ASCII, with A-Z lower-cased; none for a null."""
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lower, _SEPARATORS), ""), F.array().cast("array<string>"))


def _key(of: Column, start: Column, length: int) -> Column:
    """A cheap key of the window: its first, middle and last word."""
    return F.xxhash64(F.get(of, start - 1), F.get(of, start + (length // 2 - 1)), F.get(of, start + (length - 2)), F.lit(length))


def _starts(of: Column, length: int) -> Column:
    return F.when(F.size(of) >= length, F.sequence(F.lit(1), F.size(of) - (length - 1))).otherwise(F.array().cast("array<int>"))


def _window(of: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(of, start, F.lit(length)), " ")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every distinct window of the items: length, window, key, items (ids of the items that have it, as sorted strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    parts = items.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("start"))
    full = F.array_join(F.slice("w", F.col("start"), F.col("length")), " ")
    at = lambda i: F.get(F.col("w"), F.col("start") + i)
    key = F.xxhash64(at(F.lit(-1)), at(F.floor(F.col("length") / 2).cast("int") - 1), at(F.col("length") - 2), F.col("length"))
    return parts.groupBy("length", full.alias("window"), key.alias("key")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text_key, n_words, n_hit, items, spans.

    ``text_key`` is a hash of the text, for joining results to rows whose id repeats.

    ``items`` are the sorted ids of items with a window in the document, ``spans`` the hit word ranges (begin from 1, end after the last word).
    """
    wins = benchmark_windows(benchmark, window)
    lengths = [row["length"] for row in wins.select("length").distinct().collect()]
    keys = [row["key"] for row in wins.select("key").distinct().limit(SET_LIMIT + 1).collect()]
    small = len(keys) <= SET_LIMIT
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))

    def candidates(length: int) -> Column:
        found = _starts(F.col("w"), length)
        if small:
            found = F.filter(found, lambda start: _key(F.col("w"), start, length).isin(keys))
        return F.transform(found, lambda start: F.struct(
            start.alias("start"), F.lit(length).alias("length"), _window(F.col("w"), start, length).alias("window")))

    none = F.array().cast("array<struct<start:int,length:int,window:string>>")
    found = F.concat(none, *[candidates(length) for length in sorted(lengths)])
    hits = rows.select("row", "doc_id", "text_key", F.size("w").alias("n_words"), F.explode_outer(found).alias("hit")).select(
        "row", "doc_id", "text_key", "n_words", "hit.*")
    sets = wins.select("length", "window", "items")
    joined = hits.join(F.broadcast(sets) if small else sets, ["length", "window"], "left")
    spot = F.when(F.col("items").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end")))
    grouped = joined.groupBy("row", "doc_id", "text_key", "n_words").agg(
        F.array_sort(F.collect_list(spot)).alias("spots"), F.collect_set("items").alias("items"))
    return grouped.select(
        "row", "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), _merged(F.col("spots")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    ).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])).drop("row")


def _merged(spots: Column) -> Column:
    """Sorted ranges with the overlapping ones joined."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, spot: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        return F.when((F.size(done) == 0) | (last["end"] < spot["start"]), F.concat(done, F.array(spot))).otherwise(F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], spot["end"]).alias("end")))))
    return F.aggregate(spots, none, add)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is part of a hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text) with the hit words cut out: doc_id and the normalised words left, joined by one space."""
    hits = _once(find_hits(docs, benchmark, window).where(F.size("spans") > 0), "spans")
    joined = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).join(hits, _same(), "left")
    spans = F.coalesce("spans", F.array())
    outside = F.filter("w", lambda _, i: ~F.exists(spans, lambda s: (s["start"] <= i + 1) & (i + 1 < s["end"])))
    return joined.select("doc_id", F.array_join(outside, " ").alias("text"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; all columns stay."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, window)
    bad = _once(found.where(contaminated(F.col("n_hit"), F.col("n_words"))), "n_words")
    # The row travels as one column, so that no name of its own meets those of the join.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    same = F.col("key").eqNullSafe(F.col("hit_key")) & F.col("id").eqNullSafe(F.col("hit_id"))
    return keyed.join(bad, same, "left_anti").select("row.*")


def _once(hits: DataFrame, column: str) -> DataFrame:
    """One row for repeated rows of the same id and text."""
    return hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.first(column).alias(column))


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("text_key").eqNullSafe(F.col("hit_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


SQL = r"""
with d as (
  select row_number() over () as row, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
b as (
  select item_id::varchar as item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
bw as (
  select distinct item, least(len(w), 13) as length, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
  from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
lengths as (select distinct length from bw),
h as (
  select row, i, length, win
  from (select row, length, i, array_to_string(w[i:i + length - 1], ' ') as win
        from (select row, w, length, unnest(range(1, len(w) - length + 2)) as i from d cross join lengths where len(w) >= length)) t
  where win in (select win from bw where bw.length = t.length)),
covered as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + length)) as p from h) group by row),
items as (
  select row, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct h.row, bw.item from h join bw using (length, win)) group by row)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join covered using (row) left join items using (row)
"""

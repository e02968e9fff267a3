"""Language by bitmask filters over character n-grams.

One bit-sliced Bloom filter holds all languages: a slot is a mask with a bit for
each language, and the masks of an n-gram's slots, combined by AND, are the
languages that contain it. A text goes to the language with the most n-grams found,
after taking off the hits that the language's share of set slots would give by
chance.

An n-gram belongs to a language if it makes up at least ``MIN_SHARE`` of the
language's n-grams, so a language has at most 1 / MIN_SHARE of them and the filter
that goes to all tasks is bounded whatever the corpus. Of these languages only those whose
share is at least ``OWN`` of the n-gram's largest share are stored, so a mask can lack a language
that does contain the n-gram. Counts cover all training rows.

Cases: a text that is null or has no letter is ``und`` with score 0; a text none of
whose n-grams is known gets the most frequent language with score 0; ties go to
the first name; without training rows everything is ``und``; repeated rows are
judged each; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from launchlens.llm.store import settled
from launchlens.llm.text import flat, mix, slices

#: Bytes of an n-gram.
GRAM = 4
MIN_SHARE = 2e-6
#: An n-gram is a language's own if its share there is at least this part of its largest share.
OWN = 0.2
HASHES = 3
SLOTS_PER_GRAM = 16


def padded(text: Column) -> Column:
    """The lower-cased text between blanks, so that short words have n-grams."""
    return F.concat(F.lit("   "), F.lower(F.coalesce(text, F.lit(""))), F.lit("   "))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows as integers, and where each row's begin (rows are padded, so each has some)."""
    data, offsets = flat(column)
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    keys = np.ndarray((len(data) - GRAM + 1,), "<u4", np.ascontiguousarray(data), strides=(1,))
    inside = np.ones(len(keys), bool)
    for back in range(1, GRAM):
        crossing = offsets[1:-1] - back
        inside[crossing[crossing >= 0]] = False
    first = np.concatenate([[0], np.cumsum(np.diff(offsets) - GRAM + 1)])
    return keys[inside], first


def gram_counts(rows: DataFrame) -> DataFrame:
    """How often each n-gram occurs in each language: lang, gram, n. ``rows``: text (padded), lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {}
        for batch in slices(batches, "text", 8 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                grams, _ = _grams(batch.column("text").filter(pa.array(langs == lang)))
                kept.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                if len(kept[lang]) > 8:
                    kept[lang] = [_merged(kept[lang])]
        for lang, parts in kept.items():
            grams, n = _merged(parts)
            yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate([g for g, _ in parts])
    found, place = np.unique(grams, return_inverse=True)
    return found, np.bincount(place, np.concatenate([n for _, n in parts]).astype(float), len(found))


class Filter:
    """The bit-sliced filter: ``slots[word, place]`` has a bit for each of 64 languages."""

    def __init__(self, languages: list[str], common: str, grams: np.ndarray, owners: list[list[int]]):
        self.languages, self.common = languages, common
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(grams)) * SLOTS_PER_GRAM))))
        words = max(1, (len(languages) + 63) // 64)
        self.slots = np.zeros((words, 1 << self.bits), np.uint64)
        masks = np.zeros((words, len(grams)), np.uint64)
        for i, own in enumerate(owners):
            for lang in own:
                masks[lang // 64, i] |= np.uint64(1 << (lang % 64))
        for places in self._places(grams.astype(np.uint32)):
            for word in range(words):
                np.bitwise_or.at(self.slots[word], places, masks[word])
        set_share = [np.mean((self.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))]
        self.chance = np.array(set_share) ** HASHES

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        hashed = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        step = (hashed >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((hashed + np.uint64(i) * step) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        """The mask of languages that contain each n-gram (and, seldom, others): one row for 64 languages."""
        found = None
        for places in self._places(grams):
            got = self.slots[:, places]
            found = got if found is None else found & got
        return found

    def judge(self, grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its language (-1: none known) and the score."""
        masks = self.languages_of(grams)
        n = np.diff(first).astype(float)
        hits = np.zeros((len(self.languages), len(n)))
        for lang in range(len(self.languages)):
            bit = (masks[lang // 64] >> np.uint64(lang % 64)).astype(np.uint8) & 1
            total = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
            hits[lang] = np.diff(total[first])
        real = np.maximum(0, (hits - n * self.chance[:, None]) / (1 - np.minimum(self.chance, 0.999))[:, None])
        best, total = real.argmax(0), real.sum(0)
        top = real[best, np.arange(len(n))]
        return np.where(top > 0, best, -1), np.where(total > 0, top / np.maximum(total, 1e-300), 0.0)


def fit_filter(rows: DataFrame) -> Filter | None:
    """A filter from ``rows`` (text, lang); rows without a language are left out. None without rows."""
    known = rows.where(F.col("lang").isNotNull()).select(padded(F.col("text")).alias("text"), "lang")
    counts = settled(gram_counts(known))
    totals = {row["lang"]: row["n"] for row in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    languages = sorted(totals)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    total = F.create_map(*[F.lit(x) for lang in languages for x in (lang, totals[lang])])
    part = counts.select("gram", number[F.col("lang")].alias("lang"), (F.col("n") / total[F.col("lang")]).alias("share")).where(F.col("share") >= MIN_SHARE)
    grouped = part.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("all"), F.max("share").alias("top"))
    own = grouped.select("gram", F.transform(F.filter("all", lambda x: x["share"] >= F.col("top") * OWN), lambda x: x["lang"]).alias("own")).toArrow()
    common = max(languages, key=lambda lang: (totals[lang], lang))
    return Filter(languages, common, own.column("gram").to_numpy(), own.column("own").to_pylist())


def predict(docs: DataFrame, model: Filter | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred (string) and score (double)."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"), padded(F.col(f"`{text}`")).alias("__padded"),
                         F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = docs.select(*[F.col(f"`{c}`") for c in [*rest, text]]).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, shared.value.common], object)
        for batch in slices(batches, "__padded"):
            lang, score = shared.value.judge(*_grams(batch.column("__padded")))
            letter = batch.column("__letter").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(np.where(letter, names[lang], "und"), pa.string()), pa.array(np.where(letter, score, 0.0))],
                [*batch.schema.names[:-2], "lang_pred", "score"])

    return source.mapInArrow(judge, schema.add("lang_pred", StringType()).add("score", DoubleType()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit_filter(docs.where(~held_out).select("text", "lang"))
    judged = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score")

"""Learned operators: held-out accuracy, brute-force models, and the odd cases."""

import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from launchlens.llm import language, ngram_lm, toxicity

DOCS = "doc_id long, text string"


def syllables(seed, n, parts):
    random.seed(seed)
    return " ".join("".join(random.choice(parts) for _ in range(random.randint(1, 3))) for _ in range(n))


LANGUAGES = {"aa": ["tho", "er", "an", "sti"], "bb": ["gué", "la", "ción", "ro"], "cc": ["sch", "ung", "ä", "ber"]}


def test_language(spark):
    rows = [(i, syllables(i, 60, LANGUAGES[lang]), lang) for i, lang in enumerate(sorted(LANGUAGES) * 20)]
    model = language.fit_filter(spark.createDataFrame(rows[:30] + [(99, "x y", None), (98, None, "aa")], DOCS + ", lang string"))
    odd = [(200, None, "aa"), (201, "12 -- ", "aa"), (202, "", "bb"), (203, "жжж", "cc"), (204, "A", "aa"), (205, rows[1][1] * 300, "bb"), (205, rows[1][1], "bb")]
    frame = spark.createDataFrame(rows[30:] + odd, DOCS + ", lang string").withColumn("score", F.lit("x"))
    got = {(r.doc_id, len(r.text or "")): (r.lang_pred, r.score) for r in language.predict(frame, model).collect()}
    for i, text, lang in rows[30:]:
        assert got[i, len(text)][0] == lang and 0 < got[i, len(text)][1] <= 1
    assert got[200, 0] == got[201, 6] == got[202, 0] == ("und", 0.0)
    assert got[203, 3][1] == 0.0 and got[203, 3][0] in LANGUAGES
    assert got[205, len(rows[1][1])][0] == got[205, 300 * len(rows[1][1])][0] == "bb"
    assert language.fit_filter(spark.createDataFrame([], DOCS + ", lang string")) is None
    assert language.predict(frame, None).where("lang_pred = 'und'").count() == frame.count()


def test_filter_returns_all_owners():
    grams = np.arange(1000, 1500, dtype=np.uint32)
    owners = [[i % 70] if i % 5 else [1, 69] for i in range(500)]
    built = language.Filter([f"l{i:02}" for i in range(70)], "l00", grams, owners)
    masks = built.languages_of(grams)
    for i, own in enumerate(owners):
        assert all(int(masks[lang // 64, i]) >> (lang % 64) & 1 for lang in own)


def test_ngram_lm(spark):
    rows = [(i, syllables(i, 30, ["a", "b", "c"])) for i in range(60)] + [(100, None), (None, "A b"), (101, "unseen words"), (102, "a " * 4000), (102, "a")]
    learns = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    tokens = [[*(t or "").lower().split(), "\0"] for _, t in rows]
    seen, pairs, contexts = Counter(), Counter(), Counter()
    for (d, _), own in zip(rows, tokens, strict=True):
        if learns(d):
            seen.update(own)
            pairs.update(zip(own, own[1:], strict=False))
            contexts.update(own[:-1])
    n, v = sum(seen.values()), len(seen)
    alone = lambda w: (seen[w] + 1) / (n + v + 1)
    kept = {p: (c - ngram_lm.DISCOUNT) / contexts[p[0]] for p, c in pairs.items() if c >= ngram_lm.KEPT}
    weight = {x: max(1e-9, 1 - sum(p for (a, _), p in kept.items() if a == x)) / (1 - sum(alone(w) for a, w in kept if a == x)) for x in contexts}
    frame = spark.createDataFrame(rows, DOCS).withColumns({"part": F.lit(7), "n_known": F.lit("x"), "score": F.lit(1), "learn": F.lit("own"), "row": F.lit(2), "n_tokens": F.lit(3)})
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    scored = ngram_lm.score(frame, learn).collect()
    assert {(r.learn, r.row, r.part) for r in scored} == {("own", 2, 7)}
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored)
    want = []
    for (d, _), own in zip(rows, tokens, strict=True):
        total = math.log10(alone(own[0]))
        for a, b in zip(own, own[1:], strict=False):
            total += math.log10(kept[a, b]) if (a, b) in kept else math.log10(weight.get(a, 1) * alone(b))
        want.append((str(d), len(own), sum(w in seen for w in own), n, sum(math.log10(alone(w)) for w in own), total))
    for mine, other in zip(got, sorted(want), strict=True):
        assert mine[:4] == other[:4]
        assert mine[4] == pytest.approx(other[4], rel=1e-9)
        assert abs(mine[5] - other[5]) <= 3 / ngram_lm.STEPS * other[1]
    assert ngram_lm.score(frame.limit(0), learn).count() == 0
    assert ngram_lm.score(frame, F.lit(False)).agg(F.max("n_known")).first()[0] == 0


def test_ngram_lm_of_order_three(spark):
    rows = [(i, syllables(i, 60, ["a", "b", "c"])) for i in range(70)] + [(100, None), (None, "A b"), (101, "unseen words here"), (102, "a " * 4000), (102, "a"), (103, "b")]
    learns = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    tokens = [[*(t or "").lower().split(), "\0"] for _, t in rows]
    counts = [Counter() for _ in range(3)]
    for (d, _), own in zip(rows, tokens, strict=True):
        for k in range(3):
            counts[k].update(tuple(own[i: i + k + 1]) for i in range(len(own) - k) if learns(d))
    n, v = sum(counts[0].values()), len(counts[0])

    def chance(words):
        """The last of the words after the others."""
        if len(words) == 1:
            return (counts[0][words] + 1) / (n + v + 1)
        context = words[:-1]
        kept = {w: c for w, c in counts[len(words) - 1].items() if w[:-1] == context and c >= ngram_lm.KEPT}
        total = counts[len(context) - 1][context]
        if words in kept:
            return (kept[words] - ngram_lm.DISCOUNT) / total
        left = 1 - sum(c - ngram_lm.DISCOUNT for c in kept.values()) / total if kept else 1
        return max(left, 1e-9) / max(1 - sum(chance(w[1:]) for w in kept), 1e-9) * chance(words[1:])

    cache = {}
    want = sorted((str(d), len(own), sum(math.log10(cache.setdefault(w, 0) or cache.update({w: chance(w)}) or cache[w])
                   for w in (tuple(own[max(0, i - 2): i + 1]) for i in range(len(own))))) for (d, _), own in zip(rows, tokens, strict=True))
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in ngram_lm.score(frame, learn, 3).collect())
    for mine, other in zip(got, want, strict=True):
        assert mine[:2] == other[:2] and abs(mine[2] - other[2]) <= 4 / ngram_lm.STEPS * other[1]
    assert ngram_lm.ORDER == 3
    two = {(str(r.doc_id), r.n_tokens): r.score for r in ngram_lm.score(frame, learn).collect()}
    assert any(abs(two[d, n] - s) > 1 for d, n, s in got)
    assert ngram_lm.score(frame.limit(0), learn, 3).count() == 0
    assert ngram_lm.score(frame, F.lit(False), 3).agg(F.max("n_known")).first()[0] == 0


def test_ngram_lm_deals_out_a_frequent_word(spark, monkeypatch):
    rows = [(i, "a " * 200 + syllables(i, 20, ["b", "c"])) for i in range(64)]
    frame = spark.createDataFrame(rows, DOCS).repartition(8)
    result = lambda: sorted(map(tuple, ngram_lm.score(frame, F.col("doc_id") % 3 > 0).collect()))
    plain, seen, sums = result(), [], ngram_lm._shard_sums
    monkeypatch.setattr(ngram_lm, "PART_TOKENS", 2000)
    monkeypatch.setattr(ngram_lm, "_shard_sums", lambda packed, log_word: (seen.append(packed), sums(packed, log_word))[1])
    assert result() == plain
    loads = [(r.part, r.n) for r in seen[0].where("part >= 0 and chunk >= 0").groupBy("part", "salt").agg(F.count("*").alias("n")).collect()]
    hot = max((p for p, _ in loads), key=lambda p: sum(q == p for q, _ in loads))
    chunks = sum(n for q, n in loads if q == hot)
    assert chunks == 8 and max(n for q, n in loads if q == hot) <= 3


def test_elias_fano():
    for values in ([], [0], [5, 5, 9, 1 << 40], list(range(1000)), [3, 1 << 62]):
        kept = np.array(values, np.uint64)
        coded = ngram_lm.EliasFano(ngram_lm.EliasFano.encode(kept))
        assert coded.values.tolist() == values
        if values:
            assert coded.successor(kept).tolist() == [values.index(x) for x in values]


def test_toxicity(spark):
    rows, marks = [], []
    for i in range(240):
        text = syllables(i, 25, ["ba", "co", "du", "fe"])
        toxic, low = i % 4 == 0, i % 3 == 0
        rows.append((i, text + (" moron scum" if toxic else "") + (" BUY NOW" if low else "")))
        marks.append((i, int(not low), int(toxic)))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "nice " * 9000 + "scum moron"), (0, rows[0][1]), (None, "scum moron")], DOCS).withColumn("quality", F.lit("q"))
    labels = spark.createDataFrame([*marks[:180], (180, None, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.reject(docs, labels)
    found = {(r.doc_id, r.rejected) for r in got.collect()}
    assert {i for i, bad in found if bad} == {*(i for i in range(240) if i % 4 == 0), 502, None}
    assert "quality" in got.columns
    nothing = toxicity.reject(docs, labels.limit(0))
    assert nothing.where("rejected").count() == 0 and nothing.count() == docs.count()
    assert toxicity.reject(docs.limit(0), labels).count() == 0


def test_lists_are_read_where_only_pyarrow_is_loaded():
    """A worker that only receives batches has not loaded pyarrow.compute."""
    batch, sink = pa.record_batch({"ids": pa.array([[3, 4], [], [5]], pa.list_(pa.int32()))}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    code = ("import sys\nimport pyarrow as pa\nfrom launchlens.llm import toxicity\n"
            "row, feature = toxicity._sparse(next(pa.ipc.open_stream(sys.stdin.buffer.read())))\n"
            "assert (row.tolist(), feature.tolist()) == ([0, 0, 2], [3, 4, 5])")
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(corpus_pipeline.__file__), input=sink.getvalue().to_pybytes(), check=True)


def dense_loss(x, y, weights, intercept, scale):
    margin = x @ weights + intercept
    return np.logaddexp(0, -np.where(y > 0, 1, -1) * margin).mean() + toxicity.PENALTY * np.abs(weights * scale).sum()


def test_toxicity_fit_is_the_least_loss(monkeypatch):
    """Against proximal gradient steps on the dense matrix, run until they stand still."""
    monkeypatch.setattr(toxicity, "TOLERANCE", 1e-12)
    monkeypatch.setattr(toxicity, "ITERATIONS", 3000)
    draw = np.random.default_rng(1)
    ones, before = (draw.random((300, 12)) < draw.random(12)).astype(float), draw.random((300, 1))
    y = (ones[:, 0] + ones[:, 3] * before[:, 0] + draw.random(300) > 1.3).astype(float)
    row, feature = np.nonzero(ones)
    model, _ = toxicity.fit_linear(row, feature, before, y, 12)
    x = np.hstack([ones, before])
    scale, weights, intercept = x.std(0), np.zeros(13), 0.0
    for _ in range(60_000):
        slope = -np.where(y > 0, 1, -1) / (1 + np.exp(np.where(y > 0, 1, -1) * (x @ weights + intercept))) / 300
        beta = weights * scale - 0.25 * (x.T @ slope) / scale
        weights = np.sign(beta) * np.maximum(np.abs(beta) - 0.25 * toxicity.PENALTY, 0) / scale
        intercept -= 0.25 * slope.sum()
    found = np.zeros(13)
    found[model.features], found[12:] = model.weights, model.earlier
    assert dense_loss(x, y, found, model.intercept, scale) <= dense_loss(x, y, weights, intercept, scale) + 1e-7
    assert np.abs(found - weights).max() < 1e-2
    chances = model.probability(ones[:, model.features] @ model.weights, before)
    assert np.allclose(chances, 1 / (1 + np.exp(-(x @ found + model.intercept))))


def test_later_categories_see_probabilities_of_other_folds(spark):
    rows = [(i, syllables(i, 25, ["ba", "co", "du", "fe"]) + " scum" * (i % 4 == 0)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(spark.createDataFrame(rows, DOCS), labels, toxicity.given_categories())
    assert [len(chain.passes[name]) for name in ("degraded", "toxic")] == [1 + toxicity.FOLDS, 1]
    assert len(chain.models[0][1].earlier) == 0 and len(chain.models[1][1].earlier) == 1
    one = toxicity.fit_chain(spark.createDataFrame(rows, DOCS), labels, {"only": F.col("toxic") == 1})
    assert {n for n, _ in one.models} == {"only"} and one.passes["only"][0] <= toxicity.ITERATIONS


def test_toxicity_on_unseen_documents(spark):
    """Fitted on four fifths of the labelled documents, judged on the rest."""
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 2
    chain = toxicity.fit_chain(docs, labels.where(~held), toxicity.given_categories())
    found = chain.score(docs.select("doc_id", "text")).join(labels.where(held), "doc_id").select("toxic", (F.col("p_toxic") >= 0.5).alias("said")).collect()
    hits = sum(r["said"] and r["toxic"] == 1 for r in found)
    assert hits >= 0.75 * sum(r["toxic"] == 1 for r in found) and hits >= 0.95 * sum(r["said"] for r in found)


def test_pipeline(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard", "substrings", "decontaminate", "encode"]
    texts = [syllables(i, 80, ["ba", "co", "du", "fe", "gi"]) for i in range(60)]
    passage, item = syllables(900, 60, ["xo", "yu", "za"]), syllables(901, 20, ["qi", "wo", "pe"])
    texts[1] = texts[0]
    texts[3] = texts[2].rsplit(" ", 1)[0] + " changed"
    texts[5], texts[6] = texts[5] + " " + passage, passage + " " + texts[6]
    texts[8] += " " + item
    for i in range(20, 40, 2):
        texts[i] += " scum moron"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(70, None, None, None, None), (71, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(20 <= i < 40 and i % 2 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in [*range(60), 70, 71] if not (20 <= i < 40 and i % 2 == 0)}
    assert set(kept["toxicity"]) == clean
    assert set(kept["jaccard"]) == clean - {1, 3}
    assert kept["substrings"][6].text == texts[6].removeprefix(passage + " ") and kept["substrings"][5].text == texts[5]
    assert kept["substrings"][6].n_chars == len(kept["substrings"][6].text)
    assert set(kept["decontaminate"]) == clean - {1, 3, 8}
    assert kept["encode"][70].n_tokens == 0 and set(kept["encode"]) == set(kept["decontaminate"])

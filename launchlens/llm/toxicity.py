"""Toxicity by a classifier chain: categories in sequence, each model seeing the probabilities of the ones before it.

Every category has a linear model over the presence of words and word beginnings, fitted
with an L1 penalty on standardised features. The models of later categories are trained
with out-of-fold probabilities of the earlier ones, so that they learn from
probabilities as good as those that unseen documents get.

The models are fitted on at most about ``train_rows`` labelled documents, taken by a hash
of the id, over at most ``vocabulary`` words and beginnings, the most frequent of those in
``MIN_DOCUMENTS`` of these documents or more. Both are documented bounds of the fit;
all documents are scored, over their whole texts. As the drawn rows are bounded, a fit is one
task: the fits of a category (one on all rows, one without each fold) run side by side and
return weights only.

Cases: a null or empty text has no features and gets the models' base rate; several
labels of one document count as positive if one is; documents with a missing label are
not learned from; without labelled rows, or without positives or negatives of a
category, its probability is 0 everywhere; repeated rows are scored each; further columns are
kept, but one that is called like a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from launchlens.llm.store import settled
from launchlens.llm.text import slices

TRAIN_ROWS = 16_000
FOLDS = 3
VOCABULARY = 50_000
MIN_DOCUMENTS = 5
#: Length of the word beginnings.
BEGIN = (4, 5)
PENALTY = 0.001
#: Passes of a fit at most.
ITERATIONS = 60
TOLERANCE = 1e-5
#: Pairs of steps that a fit remembers.
MEMORY = 10

#: Bytes of text whose words are objects of a task at a time.
SLICE = 512 << 10

_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> set[str]:
    """The distinct lower-case words and their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGIN:
        out |= {f"{n}^{w[:n]}" for w in words}
    return out


# --- a linear model on rows of ones ---------------------------------------------------------

@dataclass
class Linear:
    """Weights of features by number, of the earlier probabilities, and an intercept."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def probability(self, margin: np.ndarray, before: np.ndarray) -> np.ndarray:
        """From the sum of the weights of each row's features and the earlier probabilities (rows by categories)."""
        total = margin + self.intercept + (before @ self.earlier if len(self.earlier) else 0.0)
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def fit_linear(row: np.ndarray, feature: np.ndarray, before: np.ndarray, y: np.ndarray, size: int) -> tuple[Linear, int]:
    """Logistic regression with an L1 penalty by orthant-wise L-BFGS; and how many passes it took.

    ``row`` and ``feature`` are the places of the ones, ``before`` the dense columns.
    """
    n = len(y)
    seen = np.bincount(feature, minlength=size) / n
    scale = np.concatenate([np.sqrt(seen * (1 - seen)), before.std(0) if before.shape[1] else np.zeros(0)])
    used = scale > 0
    inverse = np.where(used, 1 / np.where(used, scale, 1), 0)
    dense = before * inverse[size:]
    penalty = np.append(np.full(len(scale), PENALTY), 0.0)
    sign = np.where(y > 0, 1.0, -1.0)

    def smooth(beta: np.ndarray) -> tuple[float, np.ndarray]:
        weights = beta[:size] * inverse[:size]
        margin = np.bincount(row, weights[feature], minlength=n) + dense @ beta[size:-1] + beta[-1]
        loss = np.logaddexp(0, -sign * margin).mean()
        slope = -sign / (1 + np.exp(np.clip(sign * margin, -700, 700))) / n
        return loss, np.concatenate([np.bincount(feature, slope[row], minlength=size) * inverse[:size], dense.T @ slope, [slope.sum()]])

    rate = y.mean()
    beta = np.zeros(len(scale) + 1)
    beta[-1] = np.log(rate / (1 - rate))
    loss, gradient = smooth(beta)
    value = loss
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    passes = 0
    while passes < ITERATIONS:
        passes += 1
        pseudo = np.where(beta != 0, gradient + penalty * np.sign(beta), np.sign(gradient) * np.maximum(np.abs(gradient) - penalty, 0))
        if np.abs(pseudo).max() < 1e-9:
            break
        d = pseudo.copy()
        kept = []
        for s, g, r in reversed(steps):
            a = r * (s @ d)
            kept.append(a)
            d -= a * g
        if steps:
            s, g, r = steps[-1]
            d /= r * (g @ g)
        for (s, g, r), a in zip(steps, reversed(kept), strict=True):
            d += s * (a - r * (g @ d))
        d = -np.where(d * pseudo > 0, d, 0)
        orthant = np.where(beta != 0, np.sign(beta), -np.sign(pseudo))
        orthant[-1] = 0
        length = 1.0 if steps else 1 / np.linalg.norm(pseudo)
        for _ in range(30):
            new = beta + length * d
            new[:-1] = np.where(new[:-1] * orthant[:-1] > 0, new[:-1], 0)
            loss, after = smooth(new)
            total = loss + penalty @ np.abs(new)
            if total <= value + 1e-4 * (pseudo @ (new - beta)):
                break
            length /= 2
        s, g = new - beta, after - gradient
        if s @ g > 1e-12:
            steps = [*steps[1 - MEMORY:], (s, g, 1 / (s @ g))]
        gain = value - total
        beta, gradient, value = new, after, total
        if gain <= TOLERANCE * max(abs(value), 1e-3):
            break
    weights = beta[:-1] * inverse
    live = np.flatnonzero(weights[:size])
    return Linear(live, weights[live], weights[size:], float(beta[-1])), passes


# --- the chain ------------------------------------------------------------------------------------

@dataclass
class Chain:
    """Models by category, in the order of the chain; None where a category has no examples of one kind."""

    vocabulary: list[str]
    models: list[tuple[str, Linear | None]]
    #: Passes of the fits by category: on all rows, then without each fold.
    passes: dict[str, list[int]]

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with a column p_<category> (double, 0 to 1) for each category."""
        names = [f"p_{name}" for name, _ in self.models]
        kept = [c for c in docs.columns if c not in names]
        schema = StructType([*[docs.schema[c] for c in kept], *[StructField(c, DoubleType()) for c in names]])
        models = [m for _, m in self.models]
        table: dict[str, np.ndarray] = {}
        for i, model in enumerate(models):
            for feature, weight in zip(model.features.tolist(), model.weights.tolist(), strict=True) if model else ():
                table.setdefault(self.vocabulary[feature], np.zeros(len(models)))[i] = weight

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = table.keys()
            for batch in slices(batches, text, SLICE):
                margins = np.zeros((batch.num_rows, len(models)))
                for i, value in enumerate(batch.column(text)):
                    for token in known & tokens(value.as_py()):
                        margins[i] += table[token]
                found = np.zeros_like(margins)
                for i, model in enumerate(models):
                    if model is not None:
                        found[:, i] = model.probability(margins[:, i], found[:, :i])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(found[:, i]) for i in range(len(models))]], [*kept, *names])

        return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(work, schema)


_ROWS = "fold int, y array<double>, ids array<int>, before array<double>"
_FITTED = "fit int, features array<int>, weights array<double>, earlier array<double>, intercept double, passes int"


def _sparse(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every feature of a table's rows."""
    ids = table.column("ids")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy(zero_copy_only=False)), ids.flatten().to_numpy()


def _dense(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def _fits(rows: DataFrame, category: int, folds: list[int], size: int) -> dict[int, tuple[Linear, int]]:
    """A model on all rows (-1) and one without each of ``folds``; those without both kinds of examples are left out."""
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")  # the order of a shuffle is no order
        y = _dense(table.column("y"))[:, category]
        found = []
        if 0 < y.sum() < len(y):
            row, feature = _sparse(table)
            model, passes = fit_linear(row, feature, _dense(table.column("before")), y, size)
            found.append({"fit": table.column("fit")[0].as_py(), "features": model.features.tolist(), "weights": model.weights.tolist(),
                          "earlier": model.earlier.tolist(), "intercept": model.intercept, "passes": passes})
        return pa.Table.from_pylist(found, pa.schema([
            ("fit", pa.int32()), ("features", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("earlier", pa.list_(pa.float64())),
            ("intercept", pa.float64()), ("passes", pa.int32())]))

    dealt = rows.select("*", F.explode(F.array(*map(F.lit, [-1, *folds]))).alias("fit")).where("fit <> fold")
    found = dealt.groupBy("fit").applyInArrow(fit, _FITTED).collect()
    return {r["fit"]: (Linear(np.array(r["features"], int), np.array(r["weights"], float), np.array(r["earlier"], float), r["intercept"]), r["passes"]) for r in found}


def _with_held_out(rows: DataFrame, models: dict[int, Linear], size: int) -> DataFrame:
    """``rows`` with one more earlier probability, from the model that did not see the row's fold."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, feature = _sparse(batch)
            before, fold = _dense(batch.column("before")), batch.column("fold").to_numpy()
            found = np.zeros(batch.num_rows)
            for f, model in models.items():
                weights = np.zeros(size)
                weights[model.features] = model.weights
                mine = fold == f
                found[mine] = model.probability(np.bincount(row, weights[feature], minlength=batch.num_rows), before)[mine]
            column = pa.array(np.column_stack([before, found]).tolist(), pa.list_(pa.float64()))
            yield batch.set_column(batch.schema.get_field_index("before"), "before", column)

    return rows.mapInArrow(work, rows.schema)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], train_rows: int = TRAIN_ROWS, folds: int = FOLDS,
              vocabulary: int = VOCABULARY) -> Chain:
    """A chain over ``categories`` (name to a Boolean of the labels' columns, in chain order), from documents with labels by doc_id."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.max(c.cast("double")).alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna()
    known = known.select("doc_id", F.array(*[f"y{i}" for i in range(len(categories))]).alias("y"))
    n = known.count()
    share = min(1.0, train_rows / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))) if share < 1 else known
    labelled = docs.select("doc_id", "text").join(drawn, "doc_id").select(
        F.xxhash64("doc_id", "text").alias("rank"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold"), "y", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = pa.array([sorted(tokens(t.as_py())) for t in batch.column("text")], pa.list_(pa.string()))
            yield batch.set_column(batch.schema.get_field_index("text"), "tokens", found)

    sample = settled(labelled.mapInArrow(split, "rank long, fold int, y array<double>, tokens array<string>"))
    counts = sample.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= MIN_DOCUMENTS)
    words = [r["token"] for r in counts.orderBy(F.desc("count"), "token").limit(vocabulary).collect()]
    numbers = {w: i for i, w in enumerate(words)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([[numbers[t] for t in row.as_py() if t in numbers] for row in batch.column("tokens")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rank"), batch.column("fold"), batch.column("y"), ids, pa.array([[]] * batch.num_rows, pa.list_(pa.float64()))],
                ["rank", "fold", "y", "ids", "before"])

    rows = settled(sample.mapInArrow(number, "rank long, " + _ROWS))
    models: list[tuple[str, Linear | None]] = []
    passes = {}
    for i, name in enumerate(categories):
        last = i + 1 == len(categories)
        found = _fits(rows, i, [] if last else list(range(folds)), len(words))
        models.append((name, found[-1][0] if -1 in found else None))
        passes[name] = [found[f][1] for f in sorted(found)]
        if not last:
            rows = settled(_with_held_out(rows, {f: m for f, (m, _) in found.items() if f >= 0}, len(words)))
    return Chain(words, models, passes)


REJECT = 0.5


def given_categories() -> dict[str, Column]:
    """The given labels in chain order: degraded writing first, then toxicity proper."""
    return {"degraded": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with p_degraded, p_toxic and ``rejected``: toxic with a probability of a half or more."""
    chain = fit_chain(docs, labels, given_categories())
    return chain.score(docs).withColumn("rejected", F.col("p_toxic") >= REJECT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return reject(docs.select("doc_id", "text"), labels).select("doc_id", "p_degraded", "p_toxic", "rejected")

"""The manifest against trees built by hand: ragged ends, several rounds of exchange, nulls, repeated rows, no rows, further columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from launchlens.llm import merkle
from launchlens.llm.queries import QUERIES

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
ROOT = "/root/testdata/sf0.001"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def mark(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """Root, and for each leaf the siblings and the way (left, right) to the root."""
    ways, level, above = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(above):
            begin = at // 8 * 8
            ways[i].append(("".join(level[begin:at]), "".join(level[at + 1:begin + 8])))
        level = [digest(*level[i:i + 8]) for i in range(0, len(level), 8)]
        above = [at // 8 for at in above]
    return level[0], ways


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], digest(*map(mark, row))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([leaf for _, leaf in groups[g]])
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (key, leaf), way in zip(groups[g], trees[g][1]):
            out.append((str(key), leaf, trees[g][0], root, digest(*[left + right for left, right in way + top])))
    return sorted(out)


def told(df):
    found = df.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("s"), merkle.fold(F.col("leaf"), F.col("proof")).alias("f")).collect()
    assert all(r["f"] == r["root"] for r in found)
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["s"]) for r in found)


ODD = [(1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (None, None, None, None, None), (2, "", "", 0, ""), (3, "b", "é", 1, "é\n" * 9000),
       (None, "a", "en", 3, "x"), (1, "a", "en", 3, "other"), (-5, "a", "de", 3, "1:2")]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 71])
def test_manifest_of_odd_rows(frame, n):
    rows = ODD[:max(0, n)] + [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(n - len(ODD))]
    docs = frame(rows, DOCS).withColumns({"leaf": F.lit("x"), "pos": F.lit(1), "root": F.lit("y"), "proof": F.lit(0), "block": F.lit(2)})
    assert told(merkle.manifest(docs)) == (by_hand(rows) if rows else [])


@pytest.mark.parametrize("n", [64 * 8, 64 * 8 + 1, 64 * 3 + 9, 601])
def test_rounds_of_exchange_with_ragged_ends(frame, monkeypatch, n):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(i, "s", "en", i, f"text {i}") for i in range(n)] + [(i, "s", f"l{i}", i, "t") for i in range(20)]
    assert told(merkle.manifest(frame(rows, DOCS))) == by_hand(rows)


def test_tampering_is_found(frame):
    docs = frame([(i, "s", "en", i, f"Text {i}") for i in range(40)], DOCS)
    found = merkle.manifest(docs, {"changed": merkle.leaf(F.col("doc_id"), F.lit("s"), F.lit("en"), F.col("doc_id"), F.lower("text"))})
    assert found.where(merkle.fold(F.col("changed"), F.col("proof")) == F.col("root")).count() == 0


def test_tampering_shows_in_the_query(spark):
    found = QUERIES["op12_merkle_manifest"](spark, ROOT)
    assert {r["verified"] for r in found.select("verified").distinct().collect()} == {True, False}

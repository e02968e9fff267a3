"""Operators with exact results, against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import glob
import hashlib
import random
import re
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from launchlens.llm import bpe, decontaminate, jaccard, kd_shards, substrings, suffix_array, topk
from launchlens.llm.components import components
from launchlens.llm.store import settled

DOCS = "doc_id long, text string"


def words(text):
    return (text or "").encode().split()


def lower(data):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def numbered(n, begin=0, letter="w"):
    return " ".join(f"{letter}{i}" for i in range(begin, begin + n))


ODD = [
    (1, numbered(60)), (2, "x " + numbered(25, 5) + " y"), (None, numbered(12)), (None, None), (3, ""), (2, numbered(25, 5)),
    (4, " ".join(["a"] * 60)), (5, " ".join(["a"] * 30)), (5, " ".join(["a"] * 30)), (6, "é ñ\t\n" + numbered(40, 20).upper()),
    (7, numbered(3000, 100, "v")), (8, numbered(3000, 1500, "v")),
]


def clashing(frame):
    """The documents with further columns that are called like helpers."""
    return frame.withColumns({"owner": F.lit("o"), "rank": F.lit(1), "kept": F.lit(2), "rest": F.lit(3), "n": F.lit(4), "label": F.lit("l")})


def test_substrings(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    first = {}
    for doc, text in ODD:
        own = words(text)
        for i in range(len(own) - 12):
            key = tuple(own[i:i + 13])
            first[key] = min(first.get(key, 1 << 63), (1 << 62) if doc is None else doc)
    want = []
    for doc, text in ODD:
        own, gone = words(text), set()
        for i in range(len(own) - 12):
            if first[tuple(own[i:i + 13])] < ((1 << 62) if doc is None else doc):
                gone.update(range(i, i + 13))
        want.append((str(doc), len(own), len(gone), b" ".join(w for i, w in enumerate(own) if i not in gone).decode()))
    got = substrings.dedup(clashing(docs))
    assert set(docs.columns) < set(got.columns) and "label" in got.columns
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()) == sorted(want)
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_automaton_against_search():
    random.seed(5)
    sequences = [[random.randint(0, 2) for _ in range(random.randint(0, 25))] for _ in range(12)]
    automaton = substrings.Automaton()
    for document, sequence in enumerate(sequences):
        automaton.add(sequence, document)
    for sequence in [*sequences, [0, 1, 9, 2, 1, 0, 0]]:
        want = []
        for i in range(len(sequence) - 3):
            window = sequence[i:i + 4]
            holders = [d for d, s in enumerate(sequences) if any(s[j:j + 4] == window for j in range(len(s) - 3))]
            want.append(min(holders, default=(1 << 63) - 1))
        assert automaton.first_documents(sequence, 4) == want


def test_collection_order():
    random.seed(1)
    for _ in range(15):
        strings = [bytes(random.choice(b"abc") for _ in range(random.randint(0, 30))) for _ in range(random.randint(1, 8))]
        begin, common, symbols = suffix_array.collection_order(strings, 10)
        suffixes, at = [], 0
        for j, s in enumerate(strings):
            suffixes += [([*s[i:], j - 1000], at + i, s[i - 1] + 1 if i else 0) for i in range(len(s) + 1)]
            at += len(s)
        suffixes.sort(key=lambda x: x[0])
        assert [s[1] for s in suffixes] == begin.tolist()
        assert [s[2] for s in suffixes] == symbols.tolist()
        for i in range(1, len(suffixes)):
            pairs = zip(suffixes[i][0], suffixes[i - 1][0], strict=False)
            same = next((n for n, (a, b) in enumerate(pairs) if a != b), 0)
            assert min(same, 10) == common[i]


def test_suffix_array(spark):
    random.seed(2)
    rnd = lambda n: "".join(random.choice("abcdefghij ") for _ in range(n))
    x = rnd(450)
    rows = [(1, x), (2, rnd(50) + x[100:320] + rnd(60)), (None, None), (3, ""), (4, "a" * 2000), (5, "ab" * 150), (6, rnd(400)), (6, x[:199]),
            (7, rnd(3) + "é" * 200), (8, x), (9, "q" * 201), (10, "z" * 200), (11, rnd(100) + x[300:] + rnd(300) + x[:230])]
    places = {}
    for r, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for k in range(len(data) - 199):
            places.setdefault(data[k:k + 200], []).append((r, k))
    marks = [bytearray(len((t or "").encode())) for _, t in rows]
    for found in places.values():
        for r, k in found if len(found) > 1 else []:
            marks[r][k:k + 200] = b"\1" * 200
    want = sorted((str(d), len(m), sum(m), len(re.findall(b"\1+", m)), bytes(b for b, f in zip((t or "").encode(), m, strict=True) if not f))
                  for (d, t), m in zip(rows, marks, strict=True))
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_array.dedup(clashing(docs)).collect())
    assert got == want
    assert suffix_array.dedup(docs.limit(0)).count() == 0


def test_order_only_of_what_may_repeat(monkeypatch):
    rng = random.Random(5)

    def fresh(n):
        return bytes(rng.randrange(256) for _ in range(n))

    shared, passage, pair = fresh(230), fresh(240), fresh(260)
    pieces = [fresh(20) + shared + fresh(100), fresh(50) + shared[10:] + fresh(30), fresh(300), b"a" * 300,
              passage + fresh(90), fresh(90) + passage, pair, fresh(1) + pair[:-1] + fresh(1)]
    counts = [1, 1, 1, 1, 1, 1, 2, 1]
    places = {}
    for piece, n in zip(pieces, counts, strict=True):
        for a in range(len(piece) - 199):
            places[piece[a: a + 200]] = places.get(piece[a: a + 200], 0) + n
    want = [bytes(places[p[a: a + 200]] > 1 for a in range(len(p) - 199)) for p in pieces]
    ordered = []
    order = suffix_array.collection_order
    monkeypatch.setattr(suffix_array, "collection_order", lambda strings, cap: ordered.extend(strings) or order(strings, cap))
    assert suffix_array.judge(pieces, [7, 7, 7, 7, 8, 8, 9, 9], [0] * 8, counts) == want
    assert 0 < sum(map(len, ordered)) < sum(map(len, pieces)) - 300 and b"a" * 300 in ordered
    assert suffix_array.judge([], [], [], []) == [] and suffix_array.judge([pair], [9], [0], [2]) == [b"\x01" * 61]
    data = np.frombuffer(shared + shared, np.uint8)
    hashed = suffix_array._window_hashes(data)
    assert len(hashed) == 261 and hashed[0] == hashed[230] and len(set(hashed.tolist())) == 230
    changed = data.copy()
    for at in range(30, 230):
        changed[at] ^= 1
        assert suffix_array._window_hashes(changed)[30] != hashed[30]
        changed[at] ^= 1


def test_jaccard(spark):
    random.seed(3)
    base = [f"w{random.randint(0, 50)}" for _ in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(random.randint(0, 4)):
            own[random.randrange(120)] = f"z{random.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    rows += [(i, numbered(40, 0, "c") + " " + " ".join(f"w{random.randint(0, 50)}" for _ in range(random.randint(2, 30)))) for i in range(150, 250)]
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A B"), (504, "a b c"), (505, "a  b"), (505, "a  b")]
    sets = []
    for _, text in rows:
        own = words(lower((text or "").encode()).decode())
        sets.append(frozenset(tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, doc), doc)
    want = sorted((doc, len(s), least[x]) for (doc, _), s, x in zip(rows, sets, label, strict=True))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted((r.doc_id, r.n, r.component_id) for r in jaccard.near_groups(docs).collect()) == want
    kept = sorted(r.doc_id for r in jaccard.keep_one(clashing(docs)).collect())
    assert kept == sorted({c for d, n, c in want if n} | {500, 501})


def test_a_family_of_near_misses_meets_groups_not_nodes(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(150), 3):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    asked = []
    settled = jaccard.settled

    def counted(df):
        out = settled(df)
        if out.columns == ["node", "g", "p"]:
            asked.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "settled", counted)
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_groups(docs).collect()) == list(enumerate(label))
    assert len(set(label)) > 1 and 0 < asked[0] < 300 * 12


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 51: 50}


def test_decontaminate(spark):
    item = numbered(20, 0, "q")
    items = spark.createDataFrame([(1, item), (2, "Short, item"), (3, None), (4, item), (5, "..")], "item_id long, text string").withColumn("window", F.lit(1))
    rows = [(1, "x " + numbered(13, 3, "Q") + " y"), (2, "a short--ITEM b"), (3, None), (4, ""), (5, numbered(12, 0, "q")), (6, "short. " + "z " * 5000 + "short item"), (None, "short item")]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_hits(spark.createDataFrame(rows, DOCS), items).collect()}
    assert got == {1: (15, 13, ["1", "4"]), 2: (4, 2, ["2"]), 3: (0, 0, []), 4: (0, 0, []), 5: (12, 0, []), 6: (5003, 2, ["2"]), None: (2, 2, ["2"])}
    docs = spark.createDataFrame(rows, DOCS)
    taken = clashing(docs).withColumns({"hit_id": F.col("doc_id"), "hit_key": F.lit(1), "row": F.lit(2), "key": F.lit(3)})
    left = decontaminate.remove_documents(taken, items)
    assert left.columns == taken.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut[1] == "x y" and cut[2] == "a b" and cut[6].split() == ["short"] + ["z"] * 5000
    assert decontaminate.find_hits(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(docs.limit(0), items).count() == 0


def test_decontaminate_without_the_key_set(spark, monkeypatch):
    item = numbered(20, 0, "q")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + numbered(15, 3, "q")), (2, "y")], DOCS)
    monkeypatch.setattr(decontaminate, "SET_LIMIT", 2)
    assert {r.doc_id: r.n_hit for r in decontaminate.find_hits(docs, items).collect()} == {1: 15, 2: 0}


def test_topk(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(300, 40))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 40), (303, [0.5] * 10), (400, vectors[0]), (100, vectors[5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    table = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = topk.top_k(topk.quantised(frame).where("vec_id % 100 = 0"), topk.quantised(frame), 10)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in (0, 200, 400):
        own = next(v for j, v in table if j == i)
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), j) for j, v in table if j != i)[:10]
        assert sorted(found[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk.top_k(topk.quantised(frame.limit(0)), topk.quantised(frame)).count() == 0


def test_kd_shards(spark):
    rows = [(i, "x" * (i % 50), "en" if i % 3 else None, f"s{i % 4}") for i in range(900)] + [(900, None, None, None)] * 3 + [(None, "y" * 60, "de", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("own"))
    got = kd_shards.document_shards(docs).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert sorted(sizes.index) == list(range(16))
    assert sizes.max() - sizes.min() <= 2 * 61
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert kd_shards.document_shards(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.tokenizer()


def test_bpe(spark, tokenizer):
    import tiktoken

    pieces, pattern = tokenizer
    wanted = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    rows = [(1, None), (2, ""), (3, "  a  b\n\n c　d 's don't '' x\x85y \x1c z"), (4, "a" * 3000), (5, "ñandú日本語テキスト 12345 ٣٤ ___"), (5, "ñandú"),
            (6, "hello\r\n\r\n  world \t\t x "), (7, "the cat " * 3000 + "🙂🙃")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("w"))
    for cache in (1, 300_000):
        coded = bpe.decode(bpe.encode(frame, pieces, pattern, cache_words=cache), pieces)
        got = sorted((r.doc_id, r.ids, bytes(r.decoded), r.word) for r in coded.collect())
        assert got == sorted((d, wanted.encode_ordinary(t or ""), (t or "").encode(), "w") for d, t in rows)
    assert bpe.encode(frame.limit(0), pieces, pattern).count() == 0


def test_bpe_digests(spark, tokenizer):
    row = bpe.digests(spark.createDataFrame([(1, None)], DOCS), *tokenizer).first()
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_bpe_with_another_pattern(spark, tokenizer):
    import tiktoken

    pieces, _ = tokenizer
    pattern = r"[a-z]+ [a-z]+|\s+|[^\s]"  # joins words that the public pattern keeps apart
    wanted = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    texts = ["the cat sat on the mat", "", None, "a  b\n\nc d e", "über the"]
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.ids for r in bpe.encode(frame, pieces, pattern).collect()}
    assert got == {i: wanted.encode_ordinary(text or "") for i, text in enumerate(texts)}


def test_near_groups_leaves_few_shuffle_files(spark):
    # Files of shuffles that are behind a checkpoint go while the job runs, and not when the driver happens to collect.
    def files():
        folder = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
        return set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data"))

    before = files()
    settled(spark.range(1000).repartition(7))
    made = files() - before
    docs = spark.createDataFrame([(i, numbered(20, i % 5)) for i in range(50)], DOCS)
    assert made and jaccard.near_groups(docs).count() == 50
    for _ in range(50):
        if not made & files():
            break
        time.sleep(0.1)
    assert not made & files()

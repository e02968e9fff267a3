"""Secret scans against brute force over characters and pairs: base spans, linked candidates, odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from launchlens.llm import secret_links as sl
from launchlens.llm.queries import QUERIES

DOCS = "doc_id long, text string"
ROOT = "/root/testdata/sf0.001"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
BARE = "Zx9" * 12


def assigned(text, low, at):
    """Begin and end of the value of a match from ``at``, by trying all choices in order."""
    for word in WORDS:
        if not low.startswith(word, at):
            continue
        i = at + len(word)
        for j in ([i + 1, i] if text[i:i + 1] and text[i] in "\"'" else [i]):
            k = j
            while text[k:k + 1] == " ":
                k += 1
            if text[k:k + 1] and text[k] in ":=":
                k += 1
                while text[k:k + 1] == " ":
                    k += 1
                begins = [k + 1, k] if text[k:k + 1] and text[k] in "\"'" else [k]
                for begin in begins:
                    z = begin
                    while z < len(text) and text[z] in VALUE:
                        z += 1
                    if z > begin:
                        return begin, z
    return None


def runs(text, at, allowed):
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out, i = [], 0
    while i < len(text):
        hit = assigned(text, low, i)
        if hit:
            if hit[1] - hit[0] >= 6:
                out.append((i, 0, hit[1]))
            i = hit[1]
        else:
            i += 1
    i = 0
    while i < len(text):
        z = runs(text, i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text.startswith("AKIA", i) else 0
        if z > i + 4:
            out += [(i, 1, z)] if z - i >= 20 else []
            i = z
        else:
            i += 1
    i = 0
    while i < len(text):
        z = runs(text, i, set("0123456789abcdef"))
        out += [(i, 2, z)] if z - i >= 24 else []
        i = max(z, i + 1)
    return sorted(out)


PIECES = ["password", "PassWD", "secret", "TOKEN", "api_key", "apikey", "API_KEY", ":", "=", " ", "  ", '"', "'", "abc", "abcdef", "ab.c=d-e", "AKIA", "AKIA" + "Q7" * 8,
          "AKIA" + "Q7" * 7, "deadbeef" * 3, "deadbeef" * 2, "\n", "é", "K", "toKen", "G", "0", "f" * 23, "_", "ſecret="]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_of_random_texts(seed):
    draw = random.Random(seed)
    for _ in range(600):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randrange(30)))
        assert sl.base_spans(text) == by_hand(text), text


def linked_by_hand(text):
    base, out = sl.base_spans(text), set()
    parts = base + sl.weak_spans(text, base)
    for begin, stop in sl.scopes_of(text):
        kinds = {k for a, k, _ in parts if begin <= a < stop}
        ok = {4: 1 in kinds or {3, 5} <= kinds, 3: 0 in kinds or (5 in kinds and kinds & {2, 4}), 5: kinds & {1, 3} and kinds & {0, 2, 4}}
        out |= {p for p in parts if p[1] > 2 and begin <= p[0] < stop and ok[p[1]]}
    return sorted({*base, *out})


def test_linking_of_random_texts(frame):
    draw = random.Random(5)
    parts = ["user=alice_9", BARE, "https://db.example.org/x", "host: db1:5432", "AKIA" + "Z8" * 9, "password=hunter22", "0a1b" * 8, "\n\n", " \n \n ", "plain words here. " * 8, "w " * 300, "é" * 70]
    texts = [None, "", " \n\n ", BARE, "user=alice"] + [" ".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(150)]
    rows = [(None if i == 7 else i // 2, t) for i, t in enumerate(texts)] * 2
    docs = frame(rows, DOCS).withColumns({"row": F.lit(1), "base": F.lit("b"), "weak": F.lit(0), "begin": F.lit(2)})
    got = sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]]) for r in sl.spans(docs).collect())
    assert got == sorted((str(i), linked_by_hand(t or "")) for i, t in rows)
    assert any(k > 2 for _, found in got for _, k, _ in found)
    assert sl.spans(docs.limit(0)).count() == 0


def test_candidates_need_their_complement():
    def kinds(text):
        return {sl.KINDS[k] for _, k, _ in linked_by_hand(text)}

    assert kinds(BARE) == kinds("user=alice " + BARE) == kinds("https://a.example/x user=alice") == set()
    assert kinds(f"user=alice {BARE} https://a.example/x") == {"identifier", "secret", "endpoint"}
    assert kinds(f"user=alice\n\n{BARE} https://a.example/x") == set()
    assert kinds("user=alice " + "word " * 250 + "password=hunter22") == {"assign"}
    assert kinds(f"AKIA{'Z8' * 9} and {BARE}") == {"access", "secret"}


def test_scopes_cover_every_paragraph():
    text = "a" * 2300 + "\n\n" + "b" * 10
    found = sl.scopes_of(text)
    assert found == [(0, 1000), (500, 1500), (1000, 2000), (1500, 2300), (2302, 2312)]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()

    def told(found):
        return ",".join(f"{sl.KINDS[k]}:{a}:{z}" for a, k, z in found)

    want = []
    for doc_id, text in docs:
        base = by_hand(text or "")
        want.append((doc_id, *[sum(k == i for _, k, _ in base) for i in range(3)], hashlib.sha256(told(base).encode()).hexdigest(), told(linked_by_hand(text or ""))))
    df = QUERIES["op13_secret_links"](spark, ROOT)
    assert df.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_query_counts_base_spans_by_kind(spark, frame, tmp_path):
    access, run = "AKIA" + "Z8" * 9, "0a1b" * 8
    texts = [None, "", "password=hunter22", run, f"{run} {access}", f"token: abcdefgh {access} {run} secret=abcdefgh", f"{access} " * 3 + f"api_key='{run}'"]
    frame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in enumerate(texts):
        kinds = [k for _, k, _ in by_hand(text or "")]
        want.append((i, *map(kinds.count, range(3))))
    got = QUERIES["op13_secret_links"](spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex").collect()
    assert sorted(map(tuple, got)) == want
    assert want[-2:] == [(5, 2, 1, 1), (6, 1, 3, 1)]

"""Secret scans with multipart credential linking.

Each text is scanned once. What is a secret by itself (an assignment to a word like
``password``, an access key, a long run of hex digits) is a base span and always reported.
Weaker parts are only candidates: an identifier (``user=...``), a bare random-looking
token, an endpoint (a URL, ``host=...``). Alone they are everywhere in harmless text, so they
are reported only where complementary parts stand in one scope:

=============  =======================================================================
candidate      reported with, in one scope
=============  =======================================================================
secret         an access key, or an identifier and an endpoint
identifier     an assigned secret, or another secret (bare, hex) and an endpoint
endpoint       an identifier or access key, and a secret of any kind
=============  =======================================================================

A scope is a paragraph (lines without a blank one between), cut into stretches of
``SCOPE`` characters that overlap by half if it is longer; so parts of a paragraph that start
within ``SCOPE // 2`` characters share one. Parts meet scopes by an interval join:
scopes are dealt into cells of ``CELL`` characters, and a part looks up the scopes of its
cell that hold its start. A scope then lists its parts once; pairs are never made, and
the work grows with parts times two.

Cases: a null text is an empty one and has no spans; positions are code points, ends are
exclusive; long texts are scanned whole; repeated rows are reported each; an empty table
gives an empty result; further columns are not read. A candidate that overlaps a base
span is not one, nor is a bare token inside an endpoint or identifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlens.llm.store import settled

SCOPE, CELL = 1_000, 512
#: Kinds in the order in which spans of one start are listed; the first three are base.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
LEAST_ASSIGNED = 6
#: Bare tokens: length, and how many of upper case, lower case and digits they mix.
BARE = (30, 128, 3)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(
    r"""(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
_ENDPOINT = re.compile(
    r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+|(?:host(?:_?name)?|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9./:_-]{3,}""",
    re.I | re.A)
_BARE = re.compile(rf"[A-Za-z0-9+/_=-]{{{BARE[0]},}}")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")

_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SPANS, _SCOPES = pa.list_(_SPAN), pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
SPANS = "array<struct<start:int,kind:int,end:int>>"
_SCHEMA = f"doc_id long, base {SPANS}, weak {SPANS}, scopes array<struct<begin:int,stop:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what is a secret by itself, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    # a run long enough is matched whole from its begin, a shorter one nowhere: no match is lost by the counts in the patterns
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates."""
    taken = bytearray(len(text))

    def take(start: int, end: int) -> None:
        taken[start:end] = b"\1" * (end - start)

    found = []
    for start, _, end in base:
        take(start, end)
    for kind, pattern in ((5, _ENDPOINT), (3, _IDENTIFIER)):
        new = [(m.start(), kind, m.end()) for m in pattern.finditer(text) if taken.find(1, m.start(), m.end()) < 0]
        for start, _, end in new:
            take(start, end)
        found += new
    for m in _BARE.finditer(text):
        value = m.group()
        mixed = any(c.isupper() for c in value) + any(c.islower() for c in value) + any(c.isdigit() for c in value)
        if len(value) <= BARE[1] and mixed >= BARE[2] and taken.find(1, m.start(), m.end()) < 0:
            found.append((m.start(), 4, m.end()))
    return sorted(found)


def scopes_of(text: str) -> list[tuple[int, int]]:
    """Begin and end of the scopes; every position outside blank lines is in one or two."""
    out, begin = [], 0
    for m in [*_BLANK.finditer(text), None]:
        stop = m.start() if m else len(text)
        while stop - begin > SCOPE:
            out.append((begin, begin + SCOPE))
            begin += SCOPE // 2
        if begin < stop:
            out.append((begin, stop))
        begin = m.end() if m else stop
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def dicts(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"start": a, "kind": k, "end": z} for a, k, z in spans]

    for batch in batches:
        bases, weaks, scopes = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            weak = weak_spans(text, base)
            alone = not weak or len(base) + len(weak) < 2  # nothing can be complemented
            bases.append(dicts(base))
            weaks.append([] if alone else dicts(weak))
            scopes.append([] if alone else [{"begin": a, "stop": z} for a, z in scopes_of(text)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(bases, _SPANS), pa.array(weaks, _SPANS), pa.array(scopes, _SCOPES)],
            ["doc_id", "base", "weak", "scopes"])


def scanned(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, base, weak and scopes of every row of ``docs``; computed once."""
    found = docs.select("doc_id", "text").mapInArrow(_scan, _SCHEMA)
    return settled(found.withColumn("row", F.monotonically_increasing_id()))


def linked(scans: DataFrame) -> DataFrame:
    """row, begin, stop of scopes in which parts complement each other, and their ``parts``, in order.

    The interval join of parts and scopes; candidates that lack their complement are
    left out of ``parts``.
    """
    open_ = scans.where(F.size("weak") > 0)
    parts = open_.select("row", F.explode(F.concat("base", "weak")).alias("part")).withColumn("cell", F.floor(F.col("part.start") / CELL))
    scopes = open_.select("row", F.explode("scopes").alias("scope")).select(
        "row", "scope.*", F.explode(F.sequence(F.floor(F.col("scope.begin") / CELL), F.floor((F.col("scope.stop") - 1) / CELL))).alias("cell"))
    met = parts.join(scopes, ["row", "cell"]).where((F.col("begin") <= F.col("part.start")) & (F.col("part.start") < F.col("stop")))
    whole = met.groupBy("row", "begin", "stop").agg(F.array_sort(F.collect_list("part")).alias("parts"))

    def has(*kinds: str) -> Column:
        return F.exists("parts", lambda p: p["kind"].isin([KINDS.index(k) for k in kinds]))

    endpoint, any_secret = has("endpoint"), has("assign", "hex", "secret")
    reported = {
        "secret": has("access") | (has("identifier") & endpoint),
        "identifier": has("assign") | (any_secret & endpoint),
        "endpoint": has("access", "identifier") & any_secret,
    }
    flagged = whole.withColumns({f"is_{k}": c for k, c in reported.items()})
    kept = F.filter("parts", lambda p: (p["kind"] < 3) | F.array_contains(
        F.array(*[F.when(F.col(f"is_{k}"), KINDS.index(k)) for k in reported]), p["kind"]))
    return flagged.where(" or ".join(f"is_{k}" for k in reported)).select("row", "begin", "stop", kept.alias("parts")).where(
        F.exists("parts", lambda p: p["kind"] >= 3))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans (base and linked candidates) of every row, each by start, then kind."""
    scans = scanned(docs)
    added = linked(scans).select(F.col("row").alias("of"), F.explode("parts").alias("part")).where("part.kind >= 3")
    added = added.groupBy("of").agg(F.collect_set("part").alias("added"))  # overlapping scopes report a span twice
    return scans.join(added, F.col("row") == F.col("of"), "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS)))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def counted(kind: int) -> Column:
    """Number of base spans of a kind; a second argument of the filter's function would be the span's index."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *[counted(i) for i in range(3)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

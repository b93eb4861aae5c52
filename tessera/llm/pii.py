"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.lineage import sliced, spare

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "secret", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD = 0.5
CONTEXT = 40
STEP = 0.3

# Score of a proposal by its form (fixed values); STEP is added if a hint stands within CONTEXT characters as a word of its own, and taken off if a
# word against it does.  A named secret is one after its name ("token = ..."), a plain one any long run of hex digits: only words near it tell.
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "secret_key": 0.9, "secret_named": 0.7, "secret_plain": 0.3, "local_phone": 0.3}
HINTS = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "secret": ("password", "passwd", "token", "secret", "key", "api_key", "apikey", "credential", "credentials"),
}
HINTS["local_phone"] = HINTS["phone"]
AGAINST = {
    "email": ("noreply", "example"), "ip": ("version", "release"), "card": ("order", "invoice", "isbn"), "phone": ("fraction",),
    "iban": ("example", "sample"), "secret": ("example", "placeholder", "sample", "dummy", "checksum", "md5", "sha1", "sha256", "commit"), "local_phone": ("order", "invoice", "isbn", "version"),
}
_WORDS = re.compile(r"[^\W\d_]+(?:[-_][^\W\d_]+)*")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Possessive, and only from the first digit of a run: one pass over any text.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_SECRET = re.compile(r"(?:password|passwd|token|secret|api_?key)\x20?[=:]\x20?\"?(?P<named>[0-9A-Za-z_/+-]{16,})|\b(?P<key>AKIA[0-9A-Z]{16})\b", re.IGNORECASE)
_PLAIN_SECRET = re.compile(r"\b[0-9a-f]{32,128}\b", re.IGNORECASE)
_LOCAL_PHONE = re.compile(r"(?<![\w+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        at = text.find("@", max(at + 1, low))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _proposed(text: str, threshold: float) -> Iterator[tuple[str, str, int, int]]:
    """Confirmed spans (kind, form, start, end), kind by kind; the base kinds leftmost and non-overlapping, failed matches dropped without another try.

    Forms that only a hint lifts to the threshold are sought only in texts that hold one of their hints."""
    low = text.lower()
    hopeful = lambda kind, form: threshold <= PRIOR[form] or any(w in low for w in HINTS[kind])
    for start, end in _emails(text):
        yield "email", "email", start, end
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        whole = m[0].replace(" ", "")
        if 15 <= len(whole) <= 34 and mod97(whole):
            yield "iban", "iban", m.start(), m.end()
    named = []
    if "=" in text or ":" in text or "akia" in low:
        for m in _SECRET.finditer(text):
            named.append(m.span(m.lastgroup))
            yield "secret", f"secret_{m.lastgroup}", *named[-1]
    if hopeful("secret", "secret_plain"):
        taken = set(named)
        for m in _PLAIN_SECRET.finditer(text):
            if m.span() not in taken and not (m[0].isdigit() or m[0].isalpha()):
                yield "secret", "secret_plain", m.start(), m.end()
    if hopeful("local_phone", "local_phone"):
        for m in _LOCAL_PHONE.finditer(text):
            yield "local_phone", "local_phone", m.start(), m.end()


def context_score(text: str, kind: str, form: str, start: int, end: int) -> float:
    """The form's score, more or less by the whole words within CONTEXT characters of the span; a word that the window cuts does not count."""
    low, high = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    near = set()
    for a, b in ((low, start), (end, high)):
        for m in _WORDS.finditer(text, a, b):
            inside = (m.start() > a or a == 0 or a == end or not text[a - 1].isalnum()) and (m.end() < b or b == len(text) or b == start or not text[b].isalnum())
            if inside:
                near.add(m[0].lower())
    score = PRIOR[form] + STEP * (not near.isdisjoint(HINTS[kind])) - STEP * (not near.isdisjoint(AGAINST[kind]))
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """Spans in code points, by kind and start.  Base spans stay whatever their score; those of added kinds need the threshold and lie apart from base
    spans."""
    text, found, taken = text or "", [], []
    for kind, form, start, end in _proposed(text, threshold):
        score = context_score(text, kind, form, start, end)
        if kind in BASE_KINDS:
            taken.append((start, end))
        elif score < threshold:
            continue
        found.append(Span(kind, start, end, score))
    if len(found) > len(taken) and taken:
        taken.sort()
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        apart = lambda s: (i := bisect_left(starts, s.end)) == 0 or reach[i - 1] <= s.start
        found = [s for s in found if s.kind in BASE_KINDS or apart(s)]
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start))


def _finder(threshold: float):
    def run(batches):
        for batch in sliced(batches, "text"):
            rows = [find_spans(t.as_py(), threshold) for t in batch.column("text")]
            offsets = [0]
            for r in rows:
                offsets.append(offsets[-1] + len(r))
            flat = [s for r in rows for s in r]
            values = pa.StructArray.from_arrays([pa.array([s.kind for s in flat], pa.string()), pa.array([s.start for s in flat], pa.int64()), pa.array([s.end for s in flat], pa.int64()), pa.array([s.score for s in flat], pa.float64())], names=["kind", "start", "end", "score"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[*batch.schema.names[:-1], "spans"])

    return run


def pii_spans(docs: DataFrame, text_col: str = "text", *, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` (all, if not given) and last `spans` (with underscores after it if that is one of them): array of (kind, start, end, score)
    in code points, end exclusive, by kind and start.

    Null text counts as empty and has no spans.  Whole texts are searched, in time proportional to their length.  Every row, repeated or not,
    is a document of its own; an empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("spans", T.ArrayType(span))])
    return source.mapInArrow(_finder(threshold), schema).toDF(*keep, *spare(keep, "spans"))


def redact(text: str | None, spans) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first by start, then the longest, counts."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join([*out, text[at:]])


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, counts of all kinds (n_email, ...) and n_spans, base_sha256, spans (kind:start:end, comma-joined) and
    scores (one for each span).  Nulls, repeats and empty tables as pii_spans; other columns are ignored."""
    held = F.col("__spans")
    found = pii_spans(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), keep=["id"]).toDF("id", "__spans")
    of = lambda kinds: F.filter(held, lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias(id_col), *counts, F.size(held).cast("bigint").alias("n_spans"), F.sha2(joined(of(BASE_KINDS)), 256).alias("base_sha256"), joined(held).alias("spans"), held["score"].alias("scores"))


def base_sha256(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in BASE_KINDS).encode()).hexdigest()

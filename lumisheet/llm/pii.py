"""Personal data by weak supervision: labelers vote, EM weighs them, and a span classifier decides.

Proposers (regexes, wide on purpose) name candidate spans. Seven labelers vote for, against or not at
all on each: strict form, checksum, gazetteer, cue words to the left, cue words against, clean edges
and placeholder shapes. Expectation-maximisation over the counts of vote patterns estimates, without
labels, how often each labeler votes each way on personal data of a kind and on other text. The posteriors are
the soft labels of the final classifier, a naive Bayes model over votes, neighbouring words, shape
and length of each kind. Base spans (exact rules per kind) always stay; others need a probability over ``threshold``.

Scale: tasks emit counts of (kind, votes, feature), a table with a bound of its own (kinds x 3^7
patterns x 256 feature buckets, in practice a few thousand rows), summed by Spark over all
documents. Only that table and the model, as small, pass through the driver. Documents are read
twice and never shuffled.

Defined results: a null or empty text has no span; repeated rows are judged alike; an empty table
learns nothing and returns nothing; very long texts are read whole; offsets count code points, end exclusive;
other columns are kept.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
EMAIL, IP, CARD, PHONE, SSN, IBAN, SECRET = range(len(KINDS))

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Proposers beyond the base: kind, a text without which it cannot match, pattern.
_MORE = (
    (EMAIL, "at", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?[(\[ ]at[)\] ] ?[A-Za-z0-9-]++(?: ?[(\[ ]dot[)\] ] ?[A-Za-z0-9-]{2,}+)+")),
    (IP, "::", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")),
    (IP, ":", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    (PHONE, "-", re.compile(r"(?<![\w+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])")),
    (PHONE, ")", re.compile(r"(?<![\w+])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    (SSN, "-", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    (IBAN, "", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    (SECRET, "AKIA", re.compile(r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)")),
    (SECRET, "", re.compile(r"(?i)(?<![a-z])(?:password|passwd|token|secret|api[_-]?key) ?[=:] ?[\"']?([A-Za-z0-9+/_-]{8,}+)")),
)

#: Kinds whose proposers beyond the base match no text without a digit.
_DIGITAL = (PHONE, SSN, IBAN)

_CUES = {
    EMAIL: ("mail", "contact", "write", "reach", "courriel", "correo"),
    IP: ("ip", "host", "server", "address", "client", "from"),
    CARD: ("card", "visa", "master", "credit", "paid", "amex", "karte", "carte", "tarjeta"),
    PHONE: ("call", "phone", "tel", "mobile", "fax", "cell", "dial", "whatsapp"),
    SSN: ("ssn", "social", "security"),
    IBAN: ("iban", "account", "bank", "konto", "compte", "cuenta"),
    SECRET: ("password", "passwd", "token", "secret", "key"),
}
_AGAINST = ("version", "release", "isbn", "issn", "order", "invoice", "page", "section", "rfc", "build", "chapter", "serial", "ticket")
_TLDS = frozenset("com org net edu gov io co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no info biz dev app".split())
_ISSUERS = ("4", "34", "37", "6011", "62", "65", "35", *map(str, range(51, 56)), *map(str, range(2221, 2721)))
_CALLING = ("1", "7", "20", "27", *map(str, range(30, 42)), *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SI SK".split())

LABELERS = 7
SLOTS, BUCKETS = 4, 64


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> tuple[list[Candidate], list[Candidate]]:
    """Spans of the exact rules, and matches that fail a rule's test; both in order of kind and place."""
    good: list[Candidate] = []
    failed: list[Candidate] = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                done = m.end()
                good.append(Candidate(EMAIL, start, done, True))
    if _DIGIT.search(text) is None:
        return good, failed
    if "." in text:
        for m in _IP.finditer(text):
            ok = all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))
            (good if ok else failed).append(Candidate(IP, m.start(), m.end(), ok))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m[0])
            ok = 12 <= len(digits) <= 19 and luhn(digits)
            if ok or 12 <= len(digits) <= 19:
                (good if ok else failed).append(Candidate(CARD, m.start(), m.end(), ok))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_DIGIT.findall(m[0]))
            ok = 9 <= n <= 15
            (good if ok else failed).append(Candidate(PHONE, m.start(), m.end(), ok))
    return good, failed


def candidates(text: str) -> list[Candidate]:
    """Base spans and all other proposals."""
    good, failed = base_spans(text)
    out = good + failed
    if not text:
        return out
    digits = _DIGIT.search(text) is not None
    for kind, needs, pattern in _MORE:
        if kind == EMAIL:
            if ("(at)" in text or "[at]" in text or " at " in text) and "dot" in text:
                out += [Candidate(EMAIL, *m.span(), False) for m in pattern.finditer(text)]
        elif (digits or kind not in _DIGITAL) and needs in text and (kind != SECRET or needs or "=" in text or ":" in text):
            out += [Candidate(kind, *m.span(m.lastindex or 0), False) for m in pattern.finditer(text)]
    return out


def _iban_ok(raw: str) -> bool:
    s = raw.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, c: Candidate) -> tuple[int, ...]:
    """1 for personal data, -1 against, 0 for no opinion, from each labeler."""
    raw = text[c.start : c.end]
    digits = "".join(x for x in raw if "0" <= x <= "9")
    left = text[max(0, c.start - 32) : c.start].lower()
    # strict form
    if c.kind == EMAIL:
        form = 1 if "@" in raw and ".." not in raw and raw[0] not in ".%+-" else 0
    elif c.kind == PHONE:
        form = 1 if 9 <= len(digits) <= 15 else -1
    elif c.kind == IP:
        form = 1 if c.base or ":" in raw else -1
    else:
        form = 1 if c.base or c.kind in (SSN, IBAN) or (c.kind == SECRET and len(raw) >= 16) else 0
    # checksum or range
    if c.kind == CARD:
        check = 1 if luhn(digits) else -1
    elif c.kind == IBAN:
        check = 1 if _iban_ok(raw) else -1
    elif c.kind == SSN:
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif c.kind == IP and "." in raw:
        check = 1 if c.base else -1
    elif c.kind == SECRET:
        check = 1 if digits and len(digits) < len(raw) else -1
    else:
        check = 0
    # gazetteer
    known = 0
    if c.kind == EMAIL:
        known = 1 if re.split(r"[. ]", raw.lower())[-1] in _TLDS else -1
    elif c.kind == CARD:
        known = 1 if digits.startswith(_ISSUERS) else -1
    elif c.kind == PHONE and raw[0] == "+":
        known = 1 if digits.startswith(_CALLING) else 0
    elif c.kind == IBAN:
        known = 1 if raw[:2] in _COUNTRIES else 0
    # context
    cue = 1 if any(w in left for w in _CUES[c.kind]) else 0
    against = -1 if any(w in left for w in _AGAINST) else 0
    before, after = text[c.start - 1 : c.start] if c.start else " ", text[c.end : c.end + 1] or " "
    edges = 1 if not before.isalnum() and not after.isalnum() and before not in ".-/" else -1
    shape = -1 if len(digits) > 6 and len(set(digits)) <= 2 else 0
    return form, check, known, cue, against, edges, shape


def features(text: str, c: Candidate) -> tuple[int, ...]:
    """A bucket for each slot: left word, right word, shape, length."""
    left = text[max(0, c.start - 24) : c.start].lower().split()
    right = text[c.end : c.end + 24].lower().split()
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", text[c.start : c.end]))))
    bucket = lambda s: crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS
    return bucket(left[-1] if left else ""), bucket(right[0] if right else ""), bucket(shape), min(BUCKETS - 1, c.end - c.start)


def pattern_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, slot, bucket, n) over the candidates of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for c in candidates(text) if text else ():
                    v = ",".join(map(str, votes(text, c)))
                    for slot, bucket in enumerate(features(text, c)):
                        seen[c.kind, v, slot, bucket] += 1
        if seen:
            kind, vote, slot, bucket = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(vote), pa.array(slot, pa.int32()), pa.array(bucket, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "slot", "bucket", "n"])

    rows = docs.select(text_col).mapInArrow(count, "kind int, votes string, slot int, bucket int, n long")
    return rows.groupBy("kind", "votes", "slot", "bucket").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    prior: np.ndarray  # log odds by kind
    vote: np.ndarray  # log ratios by kind, labeler and vote (-1, 0, 1)
    context: np.ndarray  # log ratios by kind, slot and bucket
    accuracy: np.ndarray  # how often each labeler's votes agree with the posterior

    def probability(self, kind: int, vote: tuple[int, ...], feats: tuple[int, ...]) -> float:
        z = self.prior[kind] + sum(self.vote[kind, j, v + 1] for j, v in enumerate(vote)) + sum(self.context[kind, s, b] for s, b in enumerate(feats))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


#: What a labeler is believed to say of other text and of personal data (-1, 0, 1), as factors of how often it votes
#: so within a kind, and the weight of that belief: a share of the candidates of the kind, and some.
BELIEF = np.array([[0.35, 0.5, 0.15], [0.15, 0.5, 0.35]])
BELIEF_SHARE, BELIEF_ROWS = 0.5, 5.0


def fit(kind: np.ndarray, vote: np.ndarray, slot: np.ndarray, bucket: np.ndarray, n: np.ndarray, rounds: int = 100) -> Model | None:
    """EM over vote patterns by kind, then the classifier from the posteriors; None without candidates.

    Labelers vote differently on different kinds, so their tables are by kind; the belief that they mostly mean what they
    say keeps the two classes from becoming any two clusters.
    """
    if not len(n):
        return None
    kinds_n = len(KINDS)
    first = slot == 0  # every candidate has each slot once
    patterns, of = np.unique(np.column_stack([kind, vote]), axis=0, return_inverse=True)
    of = of.ravel()
    count = np.bincount(of[first], n[first], len(patterns))
    kinds, v = patterns[:, 0], patterns[:, 1:] + 1
    size = np.bincount(kinds, count, kinds_n)
    by_kind = lambda j, w: np.bincount(kinds * 3 + v[:, j], w, 3 * kinds_n).reshape(kinds_n, 3)
    belief = np.zeros((2, kinds_n, LABELERS, 3))
    for j in range(LABELERS):
        rate = (by_kind(j, count) + 1.0) * BELIEF[:, None]
        belief[:, :, j] = rate / rate.sum(axis=2, keepdims=True) * (BELIEF_ROWS + BELIEF_SHARE * size)[:, None]
    p = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))  # to begin with, the majority
    for _ in range(rounds):
        table = belief.copy()
        for j in range(LABELERS):
            table[0, :, j] += by_kind(j, count * (1 - p))
            table[1, :, j] += by_kind(j, count * p)
        ratio = np.log(table[1] / table[1].sum(axis=2, keepdims=True)) - np.log(table[0] / table[0].sum(axis=2, keepdims=True))
        prior = np.log(np.bincount(kinds, count * p, kinds_n) + 1.0) - np.log(np.bincount(kinds, count * (1 - p), kinds_n) + 1.0)
        z = prior[kinds] + sum(ratio[kinds, j, v[:, j]] for j in range(LABELERS))
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        done, p = np.abs(new - p).max() < 1e-6, new
        if done:
            break
    context = np.zeros((kinds_n, SLOTS, BUCKETS))
    for s in range(SLOTS):
        own = slot == s
        shape = (kinds_n, BUCKETS)
        yes, no = (np.bincount(kind[own] * BUCKETS + bucket[own], n[own] * q[of[own]], kinds_n * BUCKETS).reshape(shape) + 1.0 for q in (p, 1 - p))
        context[:, s] = np.log(yes / yes.sum(axis=1, keepdims=True)) - np.log(no / no.sum(axis=1, keepdims=True))
    said = (v != 1) * count[:, None]
    right = np.where(v == 2, p[:, None], 1 - p[:, None]) * said
    accuracy = right.sum(axis=0) / np.maximum(1, said.sum(axis=0))
    return Model(prior, ratio, context, accuracy)


def learn(docs: DataFrame, text_col: str = "text") -> Model | None:
    """The model of all documents."""
    t = pattern_counts(docs, text_col).toPandas()  # bounded by kinds, patterns and buckets
    vote = np.array([list(map(int, x.split(","))) for x in t.votes], np.int64).reshape(len(t), LABELERS)
    return fit(t.kind.to_numpy(np.int64), vote, t.slot.to_numpy(np.int64), t.bucket.to_numpy(np.int64), t.n.to_numpy(float))


def _runs(found: list[Candidate]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of text that candidates cover, in order and apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for c in sorted(found, key=lambda c: c.start):
        if ends and c.start < ends[-1]:
            ends[-1] = max(ends[-1], c.end)
        else:
            starts.append(c.start)
            ends.append(c.end)
    return starts, ends


def spans(text: str | None, model: Model | None, threshold: float = 0.5) -> list[Candidate]:
    """All spans by start, then kind: base ones, and those that the classifier takes and that touch no other."""
    if not text:
        return []
    found = candidates(text)
    out = [c for c in found if c.base]
    rest = [c for c in found if not c.base]
    if model and rest:
        scored = [(model.probability(c.kind, votes(text, c), features(text, c)), c) for c in rest]
        starts, ends = _runs(out)
        for _, c in sorted(((p, c) for p, c in scored if p > threshold), key=lambda x: (-x[0], x[1].start, x[1].kind)):
            k = bisect_left(starts, c.end)  # runs before k start before the candidate ends
            if k == 0 or ends[k - 1] <= c.start:
                out.append(c)
                starts.insert(k, c.start)
                ends.insert(k, c.end)
    return sorted(out, key=lambda c: (c.start, c.kind, c.end))


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``pii``: an array of (kind, start, end, base)."""
    kept = docs.select(*[c for c in docs.columns if c != "pii"])
    schema = T.StructType([*kept.schema.fields, T.StructField("pii", _SPAN)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[{"kind": KINDS[c.kind], "start": c.start, "end": c.end, "base": c.base} for c in spans(t, model, threshold)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], names=schema.fieldNames())

    return kept.mapInArrow(run, schema)


def redact_text(text: str | None, found: list[Candidate]) -> str | None:
    """The text with each span, or run of overlapping spans, as the name of its first kind in brackets."""
    if not found:
        return text
    out, at, end = [], 0, -1
    for c in found:
        if c.start >= end:
            out += [text[at : c.start], f"[{KINDS[c.kind].upper()}]"]
        at = end = max(end, c.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """``docs`` with all spans redacted; ``length_col``, if there, follows the new text."""
    model, at = learn(docs, text_col), docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [redact_text(t, spans(t, model, threshold)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, schema.fieldNames()[at], pa.array(new, batch.column(at).type))

    out = docs.mapInArrow(run, schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def _joined(column: str, only_base: bool):
    own = F.filter(column, lambda x: x["base"]) if only_base else F.col(column)
    return F.concat_ws(",", F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """The report of the query: one row per document."""
    docs = docs.select("doc_id", "text")
    found = find(docs, learn(docs)).drop("text")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_joined("pii", True), 256).alias("base_sha256"), _joined("pii", False).alias("spans"))

"""Personal data by a semi-Markov conditional random field over rule-based spans.

Four rules find e-mail addresses, IP addresses, card and phone numbers that have their usual form. Around every
at sign and number of a text, a semi-Markov field looks at whole candidate segments (how many digits, which
separators, check digit, what stands before) and a dynamic program over segments of ``LONGEST`` tokens at most
chooses their borders and kinds together. What it finds beside the rules' spans is added; theirs always stay.

The field learns from the rules' own spans in a bounded sample: windows of some ``SAMPLE_DOCS`` documents
chosen by a hash of their key, ``WINDOWS`` at most, and copies of them in which the usual form is loosened
(a phone number without its country code, a spaced at sign, dots in a card number).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.texts import whole
from tagloom.llm.workers import task

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
WINDOWS = 400
LONGEST = 20  # tokens of a segment
AROUND = 24  # code points before and after a trigger
TURNS = 25
RATE = 0.5
RIDGE = 0.02

Span = tuple[int, int, str]

# fixed patterns of the rules; an e-mail address is found from its at sign, so that no run is scanned twice
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"@|[0-9]+")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.DOTALL)
DIGITS = re.compile(r"[0-9]+")
CUES = re.compile(r"(?i)(mail|contact)|(tel|phone|call|fax|mobile)|(card|visa|credit)|(ip|host|server|address)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by start and then kind: leftmost, without overlap within a kind, failing matches dropped."""
    found: list[Span] = []
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end(), "email"))
            last = m.end()
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = "".join(DIGITS.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(len, DIGITS.findall(m.group()))) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around at signs and numbers; overlapping ones are one."""
    start = end = None
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if end is not None and a <= end:
            end = b
        else:
            if end is not None:
                yield start, end
            start, end = a, b
    if end is not None:
        yield start, end


def segments(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Tokens as text ranges, candidate segments as token ranges (exclusive end), and the segments' features."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    kinds = [
        "d" if text[a] in "0123456789" else "s" if text[a].isspace() else "a" if text[a].isalpha() else text[a] for a, _ in tokens]
    found, rows = [], []
    for i, first in enumerate(kinds):
        if not (first in "da+(" or first in "._%-" and i + 1 < len(kinds)):
            continue
        at, letters, blanks, digits = 0, first == "a", 0, 0
        for j in range(i, min(len(kinds), i + LONGEST)):
            k = kinds[j]
            if k == "d":
                digits += tokens[j][1] - tokens[j][0]
            elif k == "a":
                letters = True
            elif k == "s":
                blanks += 1
            elif k == "@":
                at += 1
            elif k not in "+().-_%":
                break
            if at > 1 or blanks > 8 or (not at and digits > 19) or (letters and blanks > 2):
                break
            if letters and not at and k == "s" and not (j + 1 < len(kinds) and kinds[j + 1] == "@"):
                break
            if k in "da" and (at or not letters and digits >= 4):
                found.append((i, j + 1))
                rows.append(features(text, tokens[i][0], tokens[j][1]))
    return tokens, found, np.array(rows, np.float64).reshape(len(rows), N_FEATURES)


def features(text: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = "".join(DIGITS.findall(span))
    n = len(digits)
    parts = span.split(".")
    before, after = text[start - 1:start], text[end:end + 1]
    cue = [m.lastindex for m in CUES.finditer(text[max(0, start - AROUND):start])]
    name, _, domain = span.partition("@")
    labels = [p.strip() for p in domain.split(".")]
    return [
        1.0, n < 9, n in (9, 10, 11), 12 <= n <= 15, n == 16, 17 <= n <= 19,
        12 <= n <= 19 and luhn(digits), len(parts) == 4 and all(p.isdigit() and small(p) for p in parts),
        len(parts) > 4 or len(parts) == 4 and not all(p.isdigit() and small(p) for p in parts), span[0] == "+", "(" in span,
        span.count("-") + span.count(" ") + span.count(".") >= 2, any(c.isspace() for c in span), "\n" in span,
        "@" in span, bool(domain) and len(labels) > 1 and all(labels), bool(name.strip()) and name.strip()[0].isalnum(),
        any(c.isspace() for c in span.strip()) and "@" in span and len(span.split()) > 3,
        before.isalnum() or before in "._%+-@(" and before != "", after.isalnum() or after == "@",
        after in ".-" and after != "" and len(text) > end + 1 and text[end + 1].isalnum(), end - start > 40,
        1 in cue, 2 in cue, 3 in cue, 4 in cue,
    ]


N_FEATURES = 26


def scored(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of segments by kind; no kind takes a segment that lacks its bare necessities."""
    f = x > 0
    may = np.column_stack([
        f[:, 14] & f[:, 15] & f[:, 16], f[:, 7], f[:, 6] & ~f[:, 14],
        (f[:, 2] | f[:, 3]) & (f[:, 9] | f[:, 10] | f[:, 11]) & ~f[:, 14] & ~f[:, 7]])
    return np.where(may, x @ weights.T, -1e9)


@dataclass(frozen=True)
class Field:
    weights: tuple[tuple[float, ...], ...]  # per kind and feature

    def best(self, text: str) -> list[Span]:
        """The best segmentation: its segments that have a kind."""
        tokens, found, x = segments(text)
        if not found:
            return []
        scores = scored(x, np.array(self.weights))
        top, kind = scores.max(axis=1).tolist(), scores.argmax(axis=1).tolist()
        ending: dict[int, list[int]] = {}
        for n, (_, end) in enumerate(found):
            if top[n] > 0:
                ending.setdefault(end, []).append(n)
        value, last = [0.0] * (len(tokens) + 1), [-1] * (len(tokens) + 1)
        for end in range(1, len(tokens) + 1):
            value[end] = value[end - 1]
            for n in ending.get(end, ()):
                if value[found[n][0]] + top[n] > value[end]:
                    value[end], last[end] = value[found[n][0]] + top[n], n
        out, end = [], len(tokens)
        while end > 0:
            if last[end] < 0:
                end -= 1
            else:
                a, b = found[last[end]]
                out.append((tokens[a][0], tokens[b - 1][1], KINDS[kind[last[end]]]))
                end = a
        return out[::-1]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """The rules' spans and those that the field finds beside them."""
        starts, ends = ordered(base)
        added = []
        for start, end in windows(text):
            for a, b, kind in self.best(text[start:end]):
                a, b = a + start, b + start
                # windows end between tokens of a longer run only when that run has no trigger
                before = bisect_left(starts, b)
                if not before or ends[before - 1] <= a:
                    added.append((a, b, kind))
        return in_order(base + added)


def ordered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """The starts of spans in order, and for each the largest end so far."""
    by_start = sorted((a, b) for a, b, _ in spans)
    return [a for a, _ in by_start], list(accumulate((b for _, b in by_start), max))


def loosened(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """Copies of a window with one span in a looser form."""
    for n, (start, end, kind) in enumerate(spans):
        old = text[start:end]
        new = {"phone": re.sub(r"^\+[0-9]+[\x20-]?", "", old), "email": old.replace("@", " @ "), "ip": old,
               "card": re.sub(r"[\x20-]", ".", old) if not old.isdigit() else ".".join(old[i:i + 4] for i in range(0, len(old), 4))}[kind]
        if new == old or kind == "phone" and sum(map(len, DIGITS.findall(new))) < 9:
            continue
        shift = len(new) - len(old)
        moved = [(a + shift * (a >= end), b + shift * (b > start), k) if i != n else (start, start + len(new), k)
                 for i, (a, b, k) in enumerate(spans)]
        yield text[:start] + new + text[end:], moved


def train(examples: list[tuple[str, list[Span]]], turns: int = TURNS) -> Field:
    """Maximum likelihood of the segmentations, by forward-backward over segments and AdaGrad."""
    w = np.zeros((len(KINDS), N_FEATURES))
    w[:, 0] = -1.0
    seen = np.full_like(w, 1e-3)
    made = []
    for text, spans in examples:
        tokens, found, x = segments(text)
        gold = np.zeros((len(found), len(KINDS)))
        place = {(tokens[a][0], tokens[b - 1][1]): n for n, (a, b) in enumerate(found)}
        for a, b, kind in spans:
            if (a, b) in place:
                gold[place[a, b], KINDS.index(kind)] = 1
        if found:
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for n, (a, b) in enumerate(found):
                by_end.setdefault(b, []).append(n)
                by_start.setdefault(a, []).append(n)
            made.append((len(tokens), np.array(found), x, gold, by_end, by_start))
    for _ in range(turns):
        for n_tokens, found, x, gold, by_end, by_start in made:
            s = scored(x, w)
            total = np.logaddexp.reduce(s, axis=1)
            forward, backward = np.zeros(n_tokens + 1), np.zeros(n_tokens + 1)
            for i in range(1, n_tokens + 1):
                forward[i] = forward[i - 1]
                if i in by_end:
                    n = by_end[i]
                    forward[i] = np.logaddexp.reduce(np.append(forward[found[n, 0]] + total[n], forward[i - 1]))
            for i in range(n_tokens - 1, -1, -1):
                backward[i] = backward[i + 1]
                if i in by_start:
                    n = by_start[i]
                    backward[i] = np.logaddexp.reduce(np.append(backward[found[n, 1]] + total[n], backward[i + 1]))
            p = np.exp(np.minimum(0, (forward[found[:, 0]] + backward[found[:, 1]] - forward[-1])[:, None] + s))
            slope = (gold - p).T @ x - RIDGE * w / len(made)
            seen += slope * slope
            w += RATE * slope / np.sqrt(seen)
    return Field(tuple(map(tuple, w.tolist())))


@task
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base = sorted(base_spans(text))
            starts, ends = ordered(base)
            for start, end in windows(text):
                first, last = bisect_left(starts, start), bisect_left(starts, end)
                inside = [(a - start, b - start, k) for a, b, k in base[first:last] if b <= end]
                whole_ = len(inside) == last - first and (not first or ends[first - 1] <= start)
                if whole_ and end - start <= 20 * AROUND:  # a longer stretch of numbers teaches nothing new
                    out.append((place, start, text[start:end], listed(inside)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))],
            ["place", "start", "window", "spans"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    """A field from a bounded sample of windows of ``docs``; without any, one that finds nothing."""
    n = docs.count()
    place = F.pmod(F.xxhash64(F.lit("pii sample"), F.col(key)), F.lit(1 << 30))
    share = F.lit(int(min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 30)))
    sampled = docs.filter((place < share) & F.col(text).isNotNull()).select(place.alias("place"), F.col(text).alias("text"))
    # least hash first, half of the windows with a span, the same number for each kind, and half without; the sample
    # size is the parameter
    found = sampled.mapInArrow(_examples, "place long, start int, window string, spans string")
    found = found.withColumn("kinds", F.array_distinct(F.regexp_extract_all("spans", F.lit("([a-z]+):"), F.lit(1))))
    order = [F.xxhash64("place", "start"), "window"]
    chosen = {}
    for kind in KINDS:
        part = found.filter(F.array_contains("kinds", kind)).orderBy(*order).limit(WINDOWS // 2 // len(KINDS))
        chosen.update({(r["place"], r["start"], r["window"]): r for r in part.collect()})  # a window may show several kinds
    plain = found.filter("spans = ''").orderBy(*order).limit(WINDOWS // 2).collect()
    examples = []
    for part in (chosen.values(), plain):
        for r in part:
            spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
            examples.append((r["window"], spans))
            examples += loosened(r["window"], spans)
    return train(examples)


def _found(field: Field):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                rule = base_spans(text)
                base.append([dict(zip(("start", "end", "kind"), s)) for s in rule])
                spans.append([dict(zip(("start", "end", "kind"), s)) for s in field.spans(text, rule)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(spans, kind)], ["key", "base", "spans"])

    return run


def find(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, base, spans (arrays of start, end, kind in code points, end exclusive).

    Null and empty texts have no spans. Rows that repeat a key are searched each. Other columns are not read.
    """
    kind, spans = docs.schema[key].dataType.simpleString(), "array<struct<start:int,end:int,kind:string>>"
    return docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text")).mapInArrow(
        _found(field), f"key {kind}, base {spans}, spans {spans}")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()

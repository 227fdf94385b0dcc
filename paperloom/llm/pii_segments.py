"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The patterns give the base spans. The field looks at the tokens around digits, @ signs and written
out at-signs; it scores whole candidate spans of up to six tokens by features of the span, and a
dynamic programme over the tokens chooses boundaries and types together. What it is sure of and
what doesn't touch a base span is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

KINDS = ("email", "ip", "card", "phone")
#: Documents that training regions are looked for in, regions used, and their tokens, at most.
SAMPLE_DOCS, SAMPLE_REGIONS, REGION_TOKENS = 20_000, 600, 40
#: Tokens and characters of a span, at most, and the posterior from which on a span is added. No
#: e-mail address that can be delivered to is longer: 64 characters, the sign and 255 more.
LONGEST, LONGEST_CHARS, SURE = 6, 320, 0.9
#: Tokens beside one with a trigger that belong to its region.
MARGIN = 2
STEPS, RATE, DECAY = 120, 1.0, 1e-3

# Patterns of the contract. Possessive runs match the same and never go back over a run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then by start; leftmost and not overlapping per kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_TRIGGER = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)
_TOKEN = re.compile(r"\S+")
_EDGE_LEFT = "\"'<[{,;:!?*%$&#|=~`"
_EDGE_RIGHT = "\"'>]},;:!?*%$&#|=~`."


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens around the triggers, as (start, end) of each token without outer signs."""
    tokens: list[tuple[int, int]] = []
    done = -1
    for trigger in _TRIGGER.finditer(text):
        if trigger.start() < done:
            continue
        # The tokens within reach: MARGIN before the trigger's own, that one, MARGIN after it.
        before = _before(text, max(done, 0), trigger.start())
        joined = bool(before) and before[-1][1] == trigger.start()
        first = before[-1][0] if joined else trigger.start()
        left = (before[:-1] if joined else before)[-MARGIN:]
        if done >= 0 and left and left[0][0] > done + 1 and text[done : left[0][0]].strip():
            yield [_core(text, *t) for t in tokens]
            tokens = []
        tokens += left
        after = _TOKEN.match(text, first)
        tokens.append(after.span())
        done = after.end()
        for _ in range(MARGIN):
            after = _TOKEN.search(text, done)
            if not after:
                break
            tokens.append(after.span())
            done = after.end()
    if tokens:
        yield [_core(text, *t) for t in tokens]


def _before(text: str, low: int, end: int) -> list[tuple[int, int]]:
    """The last tokens from ``low`` to ``end``, ``MARGIN`` + 1 of them if there are as many. Looks
    back no further than it must, and over no character more than a few times."""
    reach = 200
    while True:
        start = max(low, end - reach)
        found = [m.span() for m in _TOKEN.finditer(text, start, end)]
        if start == low:
            return found
        if len(found) > MARGIN + 1:
            return found[1:]  # the first may be the rest of a longer one
        reach *= 4


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end - 1 and text[start] in _EDGE_LEFT:
        start += 1
    while end > start + 1 and text[end - 1] in _EDGE_RIGHT:
        end -= 1
    return start, end


_MAIL = re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")
_LOOSE_MAIL = re.compile(r"[\w.%+-]+ ?(?:@|[(\[{]at[)\]}]) ?[\w-]+(?: ?(?:\.|[(\[{]dot[)\]}]| dot ) ?[\w-]+)+", re.I)
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_PHONE_SIGNS = re.compile(r"\+?[0-9() .-]+")
_FOURS = re.compile(r"[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}")
_GROUPED = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}")


def span_features(span: str, tokens: int) -> list[float]:
    """Features of a whole span; all are of its shape, none of its surroundings."""
    digits = _digits(span)
    n, letters = len(digits), any(c.isalpha() for c in span)
    quad = _QUAD.fullmatch(span)
    found = (
        True, _MAIL.fullmatch(span), _LOOSE_MAIL.fullmatch(span), "@" in span, quad, quad and all(int(p) <= 255 for p in span.split(".")),
        13 <= n <= 19 and luhn(digits), 13 <= n <= 19, 9 <= n <= 15, n < 9, n > 19, span.startswith("+"), "(" in span and ")" in span,
        _PHONE_SIGNS.fullmatch(span), _FOURS.fullmatch(span), _GROUPED.search(span) and not letters, letters, letters and n > 0 and "@" not in span,
        tokens == 1, tokens == 2, tokens == 3, tokens > 3, " " in span, "/" in span or ":" in span, span.count("(") != span.count(")"),
        n >= 13 and not letters and not digits.strip(digits[:1]), len(span) > 60,
    )
    return [float(bool(x)) for x in found]


FEATURES = len(span_features("x", 1))


def candidates(text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of tokens i to j that hold a trigger at either end, and their features."""
    marked = [bool(_TRIGGER.search(text, a, b)) for a, b in tokens]
    spans, rows = [], []
    for j in range(len(tokens)):
        for i in range(max(0, j - LONGEST + 1), j + 1):
            start, end = tokens[i][0], tokens[j][1]
            if any(marked[i : j + 1]) and "\n" not in text[start:end] and end - start <= LONGEST_CHARS:
                spans.append((i, j + 1))
                rows.append(span_features(text[start:end], j + 1 - i))
    return spans, np.array(rows).reshape(-1, FEATURES)


def _sums(tokens: int, spans: list[tuple[int, int]], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """log of the sum over all segmentations, and the posterior of each (span, kind). A token that
    is in no span scores 0."""
    forward, backward = np.full((2, tokens + 1), -np.inf)
    forward[0] = backward[tokens] = 0
    total = np.logaddexp.reduce(scores, axis=1) if len(spans) else np.zeros(0)
    ends: list[list[int]] = [[] for _ in range(tokens + 1)]
    starts: list[list[int]] = [[] for _ in range(tokens + 1)]
    for s, (i, j) in enumerate(spans):
        ends[j].append(s)
        starts[i].append(s)
    for t in range(1, tokens + 1):
        forward[t] = np.logaddexp.reduce([forward[t - 1], *(forward[spans[s][0]] + total[s] for s in ends[t])])
    for t in range(tokens - 1, -1, -1):
        backward[t] = np.logaddexp.reduce([backward[t + 1], *(backward[spans[s][1]] + total[s] for s in starts[t])])
    z = forward[tokens]
    outside = np.array([forward[i] + backward[j] for i, j in spans])
    return z, np.exp(outside[:, None] + scores - z) if len(spans) else np.zeros((0, len(KINDS)))


def best(tokens: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(span, kind) of the best segmentation, in order."""
    value, back = np.full(tokens + 1, -np.inf), [(-1, -1)] * (tokens + 1)
    value[0] = 0
    ends: list[list[int]] = [[] for _ in range(tokens + 1)]
    for s, (_, j) in enumerate(spans):
        ends[j].append(s)
    for t in range(1, tokens + 1):
        value[t] = value[t - 1]
        for s in ends[t]:
            k = int(scores[s].argmax())
            if value[spans[s][0]] + scores[s, k] > value[t]:
                value[t], back[t] = value[spans[s][0]] + scores[s, k], (s, k)
    out, t = [], tokens
    while t:
        s, k = back[t]
        if s >= 0:
            out.append((s, k))
        t = spans[s][0] if s >= 0 else t - 1
    return out[::-1]


def _gold(text: str, tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray | None:
    """Which (span, kind) are base spans; None if one of them isn't a candidate."""
    place = {(tokens[i][0], tokens[j - 1][1]): s for s, (i, j) in enumerate(spans)}
    gold = np.zeros((len(spans), len(KINDS)))
    low, high, taken = tokens[0][0], tokens[-1][1], []
    for kind, start, end in base_spans(text):
        if start >= high or end <= low:
            continue
        if (start, end) not in place:
            return None
        if any(a < end and b > start for a, b in taken):
            continue
        taken.append((start, end))
        gold[place[start, end], KINDS.index(kind)] = 1
    return gold


def _varied(text: str) -> str | None:
    """The same personal data, written as the patterns don't see it."""
    for kind, start, end in base_spans(text):
        span = text[start:end]
        new = {"email": span.replace("@", " (at) "), "phone": span.lstrip("+0123456789").strip() if " " in span else "", "card": span.replace(" ", ".").replace("-", "."), "ip": span}[kind]
        if new and new != span:
            return text[:start] + "\0" + new + "\0" + text[end:]
    return None


def _example(text: str) -> tuple[int, list, np.ndarray, np.ndarray] | None:
    marks = [i for i, c in enumerate(text) if c == "\0"]
    plain = text.replace("\0", "")
    tokens = next(regions(plain), None)
    if not tokens or len(tokens) > REGION_TOKENS:
        return None
    spans, x = candidates(plain, tokens)
    if len(marks) == 2:
        place = {(tokens[i][0], tokens[j - 1][1]): s for s, (i, j) in enumerate(spans)}
        at = place.get((marks[0], marks[1] - 1))
        if at is None:
            return None
        gold = np.zeros((len(spans), len(KINDS)))
        kind = "email" if "@" in plain[marks[0] : marks[1]] or "(at)" in plain[marks[0] : marks[1]] else "card" if len(_digits(plain[marks[0] : marks[1]])) > 12 else "phone"
        gold[at, KINDS.index(kind)] = 1
        return len(tokens), spans, x, gold
    gold = _gold(plain, tokens, spans)
    return None if gold is None else (len(tokens), spans, x, gold)


def fit(texts: list[str], steps: int = STEPS) -> np.ndarray:
    """Weights [feature, kind] that make the base spans of the texts likely, and the same data in
    other writing. Texts without personal data teach what isn't. Without texts nothing is added."""
    examples = [e for t in sorted(texts) for v in (t, _varied(t)) if v is not None and (e := _example(v)) is not None]
    weights = np.zeros((FEATURES, len(KINDS)))
    weights[0] = -8.0
    square = np.full(weights.shape, 1e-6)
    for _ in range(steps if examples else 0):
        slope = -DECAY * len(examples) * weights
        slope[0] = 0
        for tokens, spans, x, gold in examples:
            if len(spans):
                slope += x.T @ (gold - _sums(tokens, spans, x @ weights)[1])
        square += slope**2
        weights += RATE * slope / np.sqrt(square)
    return weights


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the best segmentation that are sure and touch no base span."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    for tokens in regions(text):
        spans, x = candidates(text, tokens)
        scores = x @ weights
        if not len(spans) or scores.max() <= 0:
            continue
        chosen = best(len(tokens), spans, scores)
        if not chosen:
            continue
        posterior = _sums(len(tokens), spans, scores)[1]
        for s, k in chosen:
            start, end = tokens[spans[s][0]][0], tokens[spans[s][1] - 1][1]
            if posterior[s, k] >= SURE and not any(a < end and b > start for a, b in taken):
                out.append((KINDS[k], start, end))
    return out


def learn(docs: DataFrame) -> np.ndarray:
    """Weights from at most ``SAMPLE_REGIONS`` regions, those with the least hash, of documents of
    a hash range that holds about ``SAMPLE_DOCS``."""
    docs = docs.select("doc_id", "text")
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def finder():
        def found(batch: dict) -> dict:
            out = []
            for text in batch["text"]:
                for tokens in regions(text or ""):
                    if len(tokens) <= REGION_TOKENS:
                        out.append(text[max(0, tokens[0][0] - 1) : tokens[-1][1] + 1])
            return {"region": out, "has": [bool(base_spans(r)) for r in out]}

        return found

    found = mapped(some.select("text"), finder, "region string, has boolean").distinct()
    mark = F.xxhash64("region")
    half = lambda has: found.filter(F.col("has") == has).orderBy(mark, "region").limit(SAMPLE_REGIONS // 2)
    return fit([r["region"] for r in half(True).unionByName(half(False)).collect()])


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    The counts and ``base_sha256`` are of the base spans, ``spans`` also holds the added ones. A
    null text counts as the empty one; rows that repeat get the same; an empty table gives none.
    """
    import hashlib

    def finder():
        def written_out(spans):
            order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            return ",".join(f"{k}:{a}:{b}" for k, a, b in order)

        def found(batch: dict) -> dict:
            out: dict = {"doc_id": batch["doc_id"], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
            for text in batch["text"]:
                base = base_spans(text or "")
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(written_out(base).encode()).hexdigest())
                out["spans"].append(written_out(base + added_spans(text, base, weights)) if text else "")
            return out

        return found

    kind = dict(docs.dtypes)["doc_id"]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return mapped(docs.select("doc_id", "text"), finder, f"doc_id {kind}, {counts}, base_sha256 string, spans string")

import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import pii_segments as pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            keeps = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if keeps[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list("a1052. @+-()%é\n")), max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def segmentations(tokens, spans):
    """All ways to choose spans that don't overlap."""
    for n in range(len(spans) + 1):
        for chosen in itertools.combinations(range(len(spans)), n):
            order = sorted(spans[s] for s in chosen)
            if all(a[1] <= b[0] for a, b in zip(order, order[1:])):
                yield chosen


def test_programme_matches_all_segmentations():
    rng = np.random.default_rng(4)
    for _ in range(20):
        spans = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (2, 4)]
        scores = rng.normal(0, 2, (len(spans), 4))
        total, post, top = 0.0, np.zeros_like(scores), (-1.0, None)
        for chosen in segmentations(4, spans):
            for kinds in itertools.product(range(4), repeat=len(chosen)):
                value = np.exp(sum(scores[s, k] for s, k in zip(chosen, kinds)))
                total += value
                for s, k in zip(chosen, kinds):
                    post[s, k] += value
                top = max(top, (value, sorted(zip(chosen, kinds))))
        z, got = pii._sums(4, spans, scores)
        assert np.isclose(z, np.log(total)) and np.allclose(got, post / total)
        assert sorted(pii.best(4, spans, scores)) == top[1]


def test_other_writings_are_added_and_clean_text_is_not():
    given_texts = []
    for i in range(80):
        given_texts += [f" word +1 (7{i:02d}) 555-{3000 + i} more ", f" to ann.{i}@mail{i % 9}.example.com or ", f" at 10.{i}.7.{i + 9} is ", f" id {'ab3f9c' * 5}{i} of ", f" in {1900 + i} we ", f" {i}. point "]
    weights = pii.fit(given_texts)

    def added(text):
        return [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), weights)]

    assert added("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    assert added("write to bob.7 (at) mail3.example.com today") == [("email", "bob.7 (at) mail3.example.com")]
    for text in ("the 12 of 1999", "version 2.0.1", "token = \"24be64439e3e49cf46b2d7c90f\"", "at 10:30 and 2.5 kg", "plain words only", ""):
        assert added(text) == []
    base = "mail a.b@c.example.org or +1 (743) 555-3824"
    assert not added(base)


def test_rows(docs, with_null_id, empty):
    weights = pii.learn(docs)
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.find(with_null_id, weights).collect()}
    for r in with_null_id.collect():
        spans = plain(r["text"] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = got[r["doc_id"], hashlib.sha256(text.encode()).hexdigest()]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(filter(None, text.split(","))) <= set(row["spans"].split(","))
    assert pii.find(empty, weights).count() == 0
    assert pii.learn(empty).shape == weights.shape


def test_a_long_address_in_other_writing_is_added():
    weights = pii.fit([f" to ann.{i}@mail{i % 9}.example.com or " for i in range(40)] + [f" in {1900 + i} we " for i in range(40)])
    for local, domain in ((70, 20), (64, 200)):
        span = "a" * local + " (at) " + "b" * domain + ".example.com"
        text = f"Please write to {span} soon"
        assert ("email", text.index("a" * local), text.index(span) + len(span)) in pii.added_spans(text, pii.base_spans(text), weights)


def test_regions_do_not_depend_on_what_stands_before():
    for word in ("x" * 150, "x" * 1_000, "y " * 50 + "z" * 5_000):
        text = f"one two {word} 5 six"
        tokens = next(pii.regions(text))
        assert [text[a:b] for a, b in tokens][-4:] == [*text.split()[-4:]] and len(tokens) == 4

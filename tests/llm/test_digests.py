import hashlib
import math

import numpy as np

from paperloom.llm import digests

RANK = np.arange(digests.CLASSES)


def prints(texts):
    return [digests.Fingerprint(f) for f in digests.features([t.encode() for t in texts], RANK)]


def test_sliding_entropy_is_the_plain_one():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"aaaabbbccdefghij klmnop", np.uint8), 2_000)
    got = digests.entropy_classes(data)
    for i in range(0, len(got), 7):
        count = np.bincount(data[i : i + 32])
        s = sum(round(65536 * c * math.log2(c)) for c in count.tolist() if c)
        assert got[i] == 63 - s * 63 // (65536 * 160)


def test_equal_texts_have_equal_prints_wherever_they_stand():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 5_000))
    a, _, b = prints([text, "x" * 40_000 + text[:300], text])
    assert a.text() == b.text() and a.likeness(b) == 1.0 == digests.Fingerprint.parsed(a.text()).likeness(b)


def test_likeness_follows_the_shared_part():
    rng = np.random.default_rng(3)
    draw = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    for size in (60, 500, 3_000, 40_000):
        one, two = draw(size), draw(size)
        a, half, other = prints([one, one[: size // 2] + two[size // 2 :], two])
        assert 0.3 < a.likeness(half) < 0.75 and a.likeness(other) < 0.12 and a.likeness(half) == half.likeness(a)


def test_short_and_flat_texts():
    empty, word, flat = prints(["", "ab", "z" * 5_000])
    assert empty.text() == "0:" and word.n == 1 and flat.n == 1
    assert empty.likeness(empty) == 1.0 and empty.likeness(word) == 0.0


def test_rows_match_the_order_of_ids(spark, docs, empty):
    rows = docs.filter("doc_id <> 10006")
    texts = sorted((r["doc_id"], r["text"] or "") for r in rows.collect())
    got = sorted(digests.fingerprints(rows).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(texts)
    for i, r in enumerate(got):
        d, t = texts[i]
        following = texts[(i + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (r["doc_id"], r["n_chars"]) == (d, len(t)) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (digests.Fingerprint.parsed(x) for x in (r["fingerprint"], r["edited_fingerprint"], got[(i + 1) % len(got)]["fingerprint"]))
        assert r["near_edited"] == own.likeness(other) and abs(r["near_next"] - own.likeness(following)) < 1e-12
    assert digests.fingerprints(empty).count() == 0


def test_null_and_repeated_ids_and_one_document(with_null_id):
    assert digests.fingerprints(with_null_id).count() == with_null_id.count()
    one = digests.fingerprints(with_null_id.filter("doc_id = 10012")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from paperloom.llm import kneser_ney

SCHEMA = "doc_id long, text string, lang string, low double, n int, kept string"


def plain_counts(text):
    """By the rules' own words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def symbol(word):
    plain = re.sub(r"[0-9]", "0", re.sub(r"[A-Z]", lambda m: m[0].lower(), word))
    return plain.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or plain


def plain_scores(rows):
    """Modified Kneser-Ney over pairs, word by word, with everything known and kept."""
    sequences = [(lang or "und", ["</s>", *map(symbol, re.findall(r"[^\x20\x09-\x0D]+", text or "")), "</s>"]) for _, text, lang in rows]
    pairs, vocabulary = defaultdict(Counter), defaultdict(set)
    for lang, s in sequences:
        vocabulary[lang] |= {"</s>", "<unk>"}
        if len(s) > 2:
            vocabulary[lang] |= set(s)
            pairs[lang].update(zip(s, s[1:]))

    def taken(counts):
        of = Counter(counts)
        n1, n2, n3, n4 = (max(1, of[k]) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [0.0] + [min(max(x, 0.1 * k), 0.95 * k) for k, x in enumerate(d, 1)]

    model = {}
    for lang, counts in pairs.items():
        d = taken(counts.values())
        context, after = Counter(), Counter()
        for (v, w), n in counts.items():
            context[v] += n
            after[w] += 1
        d1 = taken(after.values())
        below = {w: (after[w] - d1[min(3, after[w])]) / sum(after.values()) + sum(d1[min(3, x)] for x in after.values()) / sum(after.values()) / len(vocabulary[lang]) for w in vocabulary[lang]}
        weight = defaultdict(float)
        for (v, _), n in counts.items():
            weight[v] += d[min(3, n)] / context[v]
        model[lang] = lambda v, w, counts=counts, d=d, context=context, below=below, weight=weight: (max(0, counts[v, w] - d[min(3, counts[v, w])]) / context[v] if counts[v, w] else 0) + weight[v] * below[w]
    return [-sum(math.log10(model[lang](v, w)) for v, w in zip(s, s[1:])) / (len(s) - 1) if len(s) > 2 else None for lang, s in sequences]


def some_rows():
    rng = random.Random(1)
    words = ["The", "the,", "cat", "sat", "on", "mat.", "42", "7", "é", "日本", "—", "#", "*a*", "x\x1cy", "|", "Dog"]
    texts = [None, "", " \n\t", "word", "a b c " * 30, "same line\nsame line\n\n \n \nsame  line", "1 2 3 4 " * 12 + "x y", "<b> & 5% $|*#", "a\r\nb\r\na\r\n"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(1, 150))) for _ in range(150)]
    return [(i, t, rng.choice(["en", "en", "de", None])) for i, t in enumerate(texts)] + [(3, "word", "en"), (None, "The cat sat", None)]


def test_counts_and_scores_match_plain_versions(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 0.0, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = kneser_ney.judge(docs, kneser_ney.learn(docs)).collect()
    want = sorted(((i or -1, *plain_counts(t), s) for (i, t, _), s in zip(rows, plain_scores(rows))), key=str)
    have = sorted(((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["log_perplexity"]) for r in got), key=str)
    assert [x[:-1] for x in have] == [x[:-1] for x in want]
    assert all((a[-1] is None) == (b[-1] is None) and (a[-1] is None or abs(a[-1] - b[-1]) < 1e-9) for a, b in zip(have, want))
    for r in got:
        inside = r["low"] is None or r["log_perplexity"] is None or r["low"] <= r["log_perplexity"] <= r["high"]
        assert r["kept"] == (not r["base_failed"] and inside)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(*r, 0.0, 1, "x") for r in some_rows()], SCHEMA)
    for limits in ({}, {"known_most": 12, "pairs_most": 20}):
        model = kneser_ney.learn(docs, **limits)
        assert len(model.pairs) <= limits.get("pairs_most", kneser_ney.PAIRS_MOST)
        for lang in ("en", "de", "und"):
            mine = [model.place(lang, s) for s in (kneser_ney._BORDER, kneser_ney._RARE)]
            words = {symbol(w).encode() for _, t, x in some_rows() if (x or "und") == lang for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
            hashes = np.array([kneser_ney._hash(w, kneser_ney._seed(lang)) for w in words])
            places, known = model.places(hashes, np.full(len(hashes), mine[1]))
            everything = np.array(sorted({*mine, *places[known].tolist()}))
            for v in everything:
                if model.below[v] < 1 or limits:
                    assert abs(model.probability(np.full(len(everything), v), everything).sum() - 1) < 1e-9


def test_bands_reject_what_lies_far_out(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ","]) for _ in range(120)), "en") for i in range(300)]
    rows += [(1000, " ".join("".join(rng.choice("qxzjk") for _ in range(9)) for _ in range(120)), "en")]
    rows += [(2000, " ".join(rng.choice(["alpha", "beta"]) for _ in range(80)), "de")]
    docs = spark.createDataFrame([(*r, 0.0, 1, "x") for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in kneser_ney.judge(docs, kneser_ney.learn(docs, known_most=400)).collect()}
    assert not got[1000]["kept"] and not got[1000]["base_failed"]
    assert sum(not got[i]["kept"] for i in range(300)) <= 1


def test_a_long_text_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert kneser_ney.judge(empty, kneser_ney.learn(empty)).count() == 0
    blank = spark.createDataFrame([(1, None, None, 0.0, 1, "x"), (2, " ", "en", 0.0, 1, "x")], SCHEMA)
    got = kneser_ney.judge(blank, kneser_ney.learn(blank)).collect()
    assert [(r["n_words"], r["base_failed"], r["kept"], r["log_perplexity"]) for r in got] == [(0, True, False, None)] * 2
    text = " ".join(f"w{i % 7001} Ü{i % 13}" for i in range(600_000))
    docs = spark.createDataFrame([(1, text, "en", 0.0, 1, "x")], SCHEMA)
    row = kneser_ney.judge(docs, kneser_ney.learn(docs)).first()
    assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (1_200_000, sum(map(len, text.split())), 1_200_000)


def test_pairs_that_no_task_holds_are_scored_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BUCKET_WORDS", 500)
    monkeypatch.setattr(kneser_ney, "BLOCK", 2_000)
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 0.0, 1, "x") for r in rows], SCHEMA).repartition(3)
    for held in (0, 20):
        model = kneser_ney.learn(docs, pairs_most=held)
        assert len(model.pairs) <= held and model.dealt.buckets > 5
        got = sorted((str(r["doc_id"]), r["n_words"], r["log_perplexity"] or 0) for r in kneser_ney.judge(docs, model).collect())
        want = sorted((str(i), plain_counts(t)[0], s or 0) for (i, t, _), s in zip(rows, plain_scores(rows)))
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want)) and len(got) == len(want)


def test_words_that_no_task_holds_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BUCKET_WORDS", 1_000)
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 0.0, 1, "x") for r in rows], SCHEMA).repartition(3)
    want = sorted((str(i), plain_counts(t)[0], s or 0) for (i, t, _), s in zip(rows, plain_scores(rows)))
    new = spark.createDataFrame([(1, "the cat never sat so well on 7 mats", "en", 0.0, 1, "x"), (2, "unseen words only", None, 0.0, 1, "x")], SCHEMA)
    unseen = []
    for held in (0, 15, 1_000):
        model = kneser_ney.learn(docs, known_most=held, pairs_most=10)
        assert len(model.symbols) <= held + 6 and model.dealt.buckets > 2
        got = sorted((str(r["doc_id"]), r["n_words"], r["log_perplexity"] or 0) for r in kneser_ney.judge(docs, model).collect())
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want)) and len(got) == len(want)
        unseen.append(sorted((r["doc_id"], round(r["log_perplexity"], 9)) for r in kneser_ney.judge(new, model).collect()))
    assert unseen[0] == unseen[1] == unseen[2]


def test_words_are_numbered_in_one_pass():
    """Each distinct word once, in order of its first place, as plain splitting finds them; windows as plain counting does."""
    from paperloom.llm.common import numbered_words

    texts = [b"", b"  \t\n", b"a b a", b" b\x0bc\x0c\x00\xff c\r", " x   ä".encode(), b"a b a " * 3, b"one two", b"x y z x y z x", b"x y z"]
    words, ids, lengths = numbered_words(texts)
    plain = [t.split() for t in texts]
    assert words == list(dict.fromkeys(w for t in plain for w in t)) and lengths.tolist() == [len(t) for t in plain]
    assert [words[i] for i in ids] == [w for t in plain for w in t]
    assert [x.tolist() for x in numbered_words([])[1:]] == [[], []]
    for held in (texts, texts[:3], texts[:2], []):
        want = []
        for t in (t.split() for t in held):
            windows = [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
            want.append(len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}))
        assert kneser_ney._Block(list(range(len(held))), ["en"] * len(held), held).repeated().tolist() == want

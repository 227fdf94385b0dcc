"""Phrase matching against plain regular expressions over every pair of phrase and text."""

import random
import re

from pyspark.sql import functions as F

from paperloom.operators import coverage as cv

GAPS = {"...", *cv.PLACEHOLDERS}


def plain(phrases, texts, ab_wildcard=False):
    out = []
    for list_id, number, phrase in phrases:
        made = re.sub(r"\bA\b|\bB\b", "somebody" if ab_wildcard else "__var__", phrase or "").lower().replace("…", "...")
        tokens = re.findall(r"[a-z0-9]+(?:/[a-z0-9]+)+|[a-z0-9]+|\.\.\.", made)
        parts = [r"[a-z0-9']+(?:\s+[a-z0-9']+){0,2}" if t in GAPS else f"(?:{t.replace('/', '|')})" if "/" in t else t for t in tokens]
        if not parts:
            continue
        pattern = re.compile(r"(?<![a-z0-9'])" + r"\s+".join(parts) + r"(?![a-z0-9'])")
        for entry, text in texts:
            norm = re.sub(r"[^a-z0-9']+", " ", (text or "").lower().replace("’", "'")).strip()
            if n := len(pattern.findall(norm)):
                out.append((list_id, number, phrase, entry, n))
    return sorted(out)


PHRASES = [
    "of the", "the ... the", "for/of the", "sb the", "between A and B", "OF THE", "is and", "sb sth", "sb", "...", "sth … sb", "a/b/c", "one's own", "", None, "!?", "look forward to sth",
    "x/y ... sb", "not/never once", "the", "the the", "zzz/qqq", "somebody the somebody",
]


def frames(spark, seed):
    rng = random.Random(seed)
    words = ["the", "of", "for", "one's", "one", "own", "is", "and", "between", "a", "b", "var", "x", "y", "look", "forward", "to", "it’s", "Not", "once", "Ü"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " - ", "."]) for _ in range(rng.randrange(0, 25)))) for i in range(120)] + [(900, None), (901, ""), (902, "'"), (903, "the" * 3)]
    phrases = [(i % 2, i, p) for i, p in enumerate(PHRASES)]
    return phrases, texts, spark.createDataFrame(phrases, "list_id int, number int, phrase string"), spark.createDataFrame(texts, "entry_id int, text string")


def test_matches_equal_a_plain_search(spark):
    for wildcard in (False, True):
        phrases, texts, listed, corpus = frames(spark, 3)
        assert sorted(tuple(r) for r in cv.phrase_matches(listed, corpus, wildcard).collect()) == plain(phrases, texts, wildcard)


def test_no_phrases_and_no_texts(spark):
    _, _, listed, corpus = frames(spark, 1)
    assert cv.phrase_matches(listed.limit(0), corpus).count() == 0 and cv.phrase_matches(listed, corpus.limit(0)).count() == 0


def test_records_are_checked_and_the_first_counts(spark):
    rows = [(1, "Look at|||see|||动词短语|||e|||t"), (2, " "), (3, "look AT|||x|||y|||z|||w"), (4, "a|||b"), (5, "Zoo|||m|||other|||e|||t"), (6, "ann|||m|||动词搭配|||e|||t")]
    loaded = cv.load_phrases(spark.createDataFrame(rows, "line_no int, line string"))
    got = {r["line_no"]: (r["phrase"], r["accepted"]) for r in loaded.collect()}
    assert got == {1: ("Look at", True), 4: (None, False), 5: ("Zoo", True), 6: ("ann", True)}
    assert [r["phrase"] for r in cv.phrase_catalogue(loaded).orderBy("position").collect()] == ["Look at", "ann", "Zoo"]


def test_blocks_are_numbered_phrases(spark):
    rows = [(1, 2, "7\nlook at"), (2, 1, "7\n look  after "), (3, 1, "8\nWord"), (4, 1, "no number"), (5, 1, "9\n"), (6, 1, "10\nin … of\nuse")]
    got = sorted(tuple(r) for r in cv.load_phrase_blocks(spark.createDataFrame(rows, "block_id int, page int, block_text string")).collect())
    assert got == [(7, "look after", 1), (10, "in ... of use", 1)]


def test_lists_without_a_match_have_zeros(spark):
    listed = spark.createDataFrame([(1, 1, "no such words"), (2, 2, "the")], "list_id int, number int, phrase string")
    corpus = spark.createDataFrame([(1, 2021, "cloze", "the cat"), (2, 2022, "reading", "a dog")], "entry_id int, year int, section string, text string")
    found = cv.phrase_matches(listed, corpus)
    assert sorted(tuple(r) for r in cv.list_summary(listed, found).collect()) == [(1, 1, 0, 0.0, 0), (2, 1, 1, 100.0, 1)]
    facets = {(r["list_id"], r["facet"], r["value"]): (r["matched_phrases"], r["occurrences"]) for r in cv.facet_summary(listed, found, corpus).collect()}
    assert len(facets) == 10 and facets[2, "section", "cloze"] == (1, 1) and facets[1, "year", "2021"] == (0, 0) and facets[2, "section", "vocabulary"] == (0, 0)


def test_words_apart_are_no_candidates(spark):
    """Texts are looked up by a phrase's words next to each other; frequent words apart cost no check of a text."""
    texts = spark.createDataFrame([(i, "of a cat the dog of") for i in range(200)] + [(900, "out of the box"), (901, "for the of the")], "entry_id long, text string")
    phrases = spark.createDataFrame([(0, 1, "of the"), (0, 2, "for/of the"), (0, 3, "of ... the")], "list_id long, number long, phrase string")
    listed = phrases.withColumn("tokens", cv.phrase_tokens(F.col("phrase")))
    got = sorted((r.number, r.entry_id) for r in cv.candidates(listed, texts).collect() if r.number < 3)
    assert got == [(1, 900), (1, 901), (2, 900), (2, 901)]
    found = {(r.number, r.entry_id): r.occurrences for r in cv.phrase_matches(phrases, texts).collect()}
    assert found[2, 901] == 2 and found[1, 900] == 1 and found[3, 5] == 1


def test_texts_are_not_sent_to_every_task(spark):
    """Files of like texts are small whatever they hold, so texts and their words are dealt by text instead."""
    texts = spark.createDataFrame([(i, "2021", "cloze", f"out of the box {i}") for i in range(500)], "entry_id long, year string, section string, text string")
    phrases = spark.createDataFrame([(0, 1, "of the"), (0, 2, "box ... 77")], "list_id long, number long, phrase string")
    tokens = phrases.withColumn("tokens", cv.phrase_tokens(F.col("phrase")))
    assert cv.candidates(tokens, texts).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    matches = cv.phrase_matches(phrases, texts)
    for found in (matches, cv.by_facet(matches, texts), cv.question_coverage(texts, matches)):
        assert found.count() > 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [entry_id" in plan and "BroadcastHashJoin [entry_id" not in plan

"""Papers of 57 items by hand: one whole paper, and every single fault that must drop it."""

import pytest

from paperloom.operators import cet

WHOLE = [
    "cover", "Part I", "", "Writing (30 minutes)", "Write a letter.", "", "In 120 words.", "Part Ⅱ  Listening Comprehension", "Section A", "Directions : listen",
    *[x for n in range(1, 26) for x in (f"{n}. A) a{n} B）b{n}", f"C. c{n}", f"D、 d {n}", *(["Section B", "Questions 9 to 15"] if n == 8 else []))],
    "Part III Reading Comprehension", "Section A", "A bank passage", *[f"with __{n}__ in it" for n in range(26, 36)],
    *[f"{a}) w{a}   {b}) w{b}" for a, b in zip("ACEGIKM", "BDFHJLN", strict=True)], "O) wO",
    "Section B", "A) First.", "B) Second.", "C) Third.", *[x for n in range(36, 46) for x in (f"{n}. states", f"that {n}")],
    "Section C", "Passage One", "body one", *[f"{n}. ask{n}? A) a B) b C) c D) d" for n in range(46, 51)],
    "Passage Two", "body", "two", *[f"{n}. ask{n}? D) d C) c B) b A) a" for n in range(51, 56)],
    "Part IV Translation", "翻译 this", "2024年大学英语四级考试真题",
]


def without(line):
    return [x for x in WHOLE if x != line]


def swapped(old, new):
    assert old in WHOLE
    return [new if x == old else x for x in WHOLE]


FAULTS = {
    "no writing part": without("Part I"), "odd part": [*WHOLE, "Part V More"], "small label": swapped("Part IV Translation", "Part iv Translation"),
    "part of another name": swapped("Part IV Translation", "Part IV Essay"), "lost item": without("7. A) a7 B）b7"), "item twice": [*WHOLE[:14], "1. A) x B) y C) z D) w", *WHOLE[14:]],
    "option lost": without("C. c9"), "option twice": swapped("C. c9", "C. c9 C. c9"), "section lost": [x for i, x in enumerate(WHOLE) if i != max(j for j, y in enumerate(WHOLE) if y == "Section B")],
    "bank word lost": without("O) wO"), "bank twice": swapped("O) wO", "A) wO"), "blank lost": without("with __30__ in it"), "statement lost": without("40. states"),
    "statements out of order": swapped("36. states", "37. states"), "other two digits in statements": swapped("that 41", "12. that"), "no letters": [x for x in WHOLE if x not in ("A) First.", "B) Second.", "C) Third.")],
    "letter twice": swapped("C) Third.", "B) Third."), "one passage": without("Passage Two"), "passages turned": [{"Passage One": "Passage Two", "Passage Two": "Passage One"}.get(x, x) for x in WHOLE],
    "choice lost": without("52. ask52? D) d C) c B) b A) a"), "empty": [], "null lines": [None, None],
}


def build(spark, texts, name="CET-4 2024.6.pdf", title=None):
    papers = [(i, name, title) for i in range(len(texts))]
    rows = [(i, n // 40 + 1, n, line, "z") for i, lines in enumerate(texts) for n, line in enumerate(lines)]
    return cet.build_cet4(
        spark.createDataFrame(papers, "paper_id int, original_name string, title string"),
        spark.createDataFrame(rows, "paper_id int, page int, line_no long, line string, stem string").repartition(5),
    )


def test_whole_paper(spark):
    rows = {r["number"]: r for r in build(spark, [WHOLE]).collect()}
    assert set(rows) == {"作文", "翻译", *map(str, range(1, 56))}
    assert {r["title"] for r in rows.values()} == {"CET-4 2024.6"}
    assert rows["作文"]["stem"] == "Write a letter.\n\nIn 120 words." and rows["翻译"]["stem"] == "翻译 this"
    assert [tuple(o) for o in rows["8"]["options"]] == [("A", "a8"), ("B", "b8"), ("C", "c8"), ("D", "d 8")]
    assert [tuple(o) for o in rows["55"]["options"]] == [(c, c.lower()) for c in "ABCD"] and rows["55"]["stem"] == "ask55?"
    assert [tuple(o) for o in rows["30"]["options"]] == [(c, "w" + c) for c in "ABCDEFGHIJKLMNO"]
    assert rows["36"]["stem"] == "states\nthat 36" and [o["id"] for o in rows["36"]["options"]] == list("ABC")
    assert rows["36"]["description"] == "A) First.\nB) Second.\nC) Third." and rows["51"]["description"] == "body\ntwo"
    assert rows["46"]["group_title"] == "Passage One" and rows["30"]["description"].startswith("A bank passage\nwith __26__")
    assert sum(r["score"] for r in rows.values()) == 100 and {n: r["score"] for n, r in rows.items()}["16"] == 2
    assert all(r["source_pages"] == [WHOLE.index(line) // 40 + 1] for n, line in [("1", "1. A) a1 B）b1"), ("30", "with __30__ in it"), ("45", "45. states")] for r in [rows[n]])
    assert rows["作文"]["source_pages"] == [1]


def test_faults_drop_only_their_paper(spark):
    got = {r["paper_id"] for r in build(spark, [*FAULTS.values(), WHOLE], title="t").select("paper_id").distinct().collect()}
    assert {list(FAULTS)[i] for i in got if i < len(FAULTS)} == set() and len(FAULTS) in got


def test_the_last_of_repeated_headings_begins_the_text(spark):
    again = [*WHOLE[:4], "old words", "Part I Something", *WHOLE[4:]]
    rows = {r["number"]: r for r in build(spark, [again]).collect()}
    assert rows["作文"]["stem"] == "Write a letter.\n\nIn 120 words."


@pytest.mark.parametrize("name", ["degree.pdf", "", None])
def test_papers_of_another_name(spark, name):
    assert build(spark, [WHOLE], name).count() == 0

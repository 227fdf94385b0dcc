"""Rule branches that the generated tables don't reach, on hand-written rows."""

from paperloom.functions import answers, text as tx
from paperloom.functions.scans import Running, running
from paperloom.operators import grading, merge, pages, quality
from pyspark.sql import functions as F


def test_long_digit_runs_do_not_break_exam_splitting(spark):
    rows = [("d", 1, "Part I Vocabulary and Structure\n20240101123456. x"), ("d", 2, "Part I Vocabulary and Structure\n1. y"), ("d", 3, "end")]
    got = pages.split_exams(spark.createDataFrame(rows, "doc_id string, page int, text string")).collect()
    assert sorted((r["start_page"], r["end_page"]) for r in got) == [(1, 1), (2, 3)]


def test_proposals_that_are_no_numbers_take_the_default(spark):
    proposals = spark.createDataFrame([("d", 1, "x", "3"), ("d", 2, "4", "nine"), ("d", 3, "1e99", "")], "doc_id string, exam_no int, start_page string, end_page string")
    documents = spark.createDataFrame([("d", 9), ("e", 2)], "doc_id string, n_pages int")
    got = {(r["doc_id"], r["exam_no"]): (r["start_page"], r["end_page"]) for r in pages.clamp_exam_ranges(proposals, documents).collect()}
    assert got["d", 1] == (1, 3) and got["d", 2] == (4, 9) and got["e", 1] == (1, 2)


def test_question_on_two_pages_is_not_its_own_duplicate(spark):
    rows = [("p", "Part I", "7", 1, 3, "same stem"), ("p", "Part I", "7", 1, 4, "same stem"), ("p", "Part I", "8", 2, 4, "a"), ("p", "Part I", "8", 3, 5, "a")]
    questions = spark.createDataFrame(rows, "paper_id string, section_title string, number string, position long, page int, stem string")
    got = quality.duplicate_number(questions).collect()
    assert [(r["number"], r["severity"], r["page"]) for r in got] == [("8", "error", 5)]


def test_null_numbers_are_a_group(spark):
    rows = [("p", None, 1, "a"), ("p", None, 2, "b"), ("p", "1", 3, "c")]
    frame = spark.createDataFrame(rows, "paper_id string, number string, position long, v string")
    got = running(frame, ["paper_id", "number"], ["position"], F.col("position"), {"before": Running("last", F.col("v"), inclusive=False)})
    assert {r["position"]: r["before"] for r in got.collect()} == {1: None, 2: "a", 3: None}


def test_failed_window_without_pages_is_kept(spark):
    rows = [("p", 1, "boom", [], []), ("p", 2, "boom", [3, 4], [4]), ("p", 3, "", [5], [])]
    windows = spark.createDataFrame(rows, "paper_id string, window_no int, error string, pages array<int>, failed_pages array<int>")
    assert sorted((r["window_no"], r["page"] or 0) for r in merge.extraction_warnings(windows).collect()) == [(1, 0), (2, 4)]


def test_ideographic_spaces_separate(spark):
    frame = spark.createDataFrame([("A　B",), ("a, b",), ("ＡB",), (None,)], "t string")
    got = [r[0] for r in frame.select(answers.normalize_answer(F.col("t"))).collect()]
    assert got[0] == got[1] == ["A", "B"] and got[3] == []
    lines = spark.createDataFrame([("p", 1, "　12.　stem"), ("p", 2, "more")], "paper_id string, line_no long, line string")
    assert {r["number"] for r in pages.numbered_blocks(lines, ["paper_id"]).collect()} == {12}


def test_no_break_spaces_in_headings(spark):
    lines = spark.createDataFrame([("p", 1, "Part II Reading"), ("p", 2, "x")], "paper_id string, line_no long, line string")
    got = pages.part_blocks(lines).collect()
    assert [(r["start_line"], r["end_line"], r["kind"]) for r in got] == [(1, 2, "reading")]


def test_full_width_headings_open_a_scope(spark):
    lines = spark.createDataFrame([("p", 1, "Ｐａｒｔ　IV　Writing"), ("p", 2, "plain")], "paper_id string, line_no long, line string")
    got = {r["line_no"]: r["scope"] for r in pages.scope_lines(lines).collect()}
    assert got == {1: "part-IV", 2: "part-IV"}


def test_compatibility_form_leaves_ascii_alone(spark):
    frame = spark.createDataFrame([("plain",), ("Ａ１",), (None,), ("",)], "t string")
    assert [r[0] for r in frame.select(tx.nfkc(F.col("t"))).collect()] == ["plain", "A1", None, ""]


def test_items_without_a_section_row_stay(spark):
    items = spark.createDataFrame([("p", 1), ("p", 2)], "paper_id string, section_no int")
    sections = spark.createDataFrame([("p", 1, 2.0, 10.0, 5)], "paper_id string, section_no int, score double, total_score double, n_questions int")
    got = {r["section_no"]: float(r["max_score"]) for r in grading.item_scores(items, sections).collect()}
    assert got == {1: 2.0, 2: 0.0}


def test_the_type_of_a_section_goes_before_its_title(spark):
    rows = [("a", "Part II Reading", "listening", "1"), ("b", "Part II Reading", "", "2"), ("c", "Part II Reading", None, "3"), ("d", "Cloze", "reading", "4"), ("e", "Cloze", None, "5"), ("f", "Cloze", "unheard of", "6")]
    questions = spark.createDataFrame([(*r, 1, 1, " ") for r in rows], "paper_id string, section_title string, section_type string, number string, position long, page int, stem string")
    assert sorted(r["number"] for r in quality.missing_stem(questions).collect()) == ["2", "3", "4", "6"]
    assert sorted(r["number"] for r in quality.missing_stem(questions.drop("section_type")).collect()) == ["1", "2", "3"]
    keys = {r["paper_id"]: r["k"] for r in questions.select("paper_id", quality.key_of(questions).alias("k")).collect()}
    assert keys == {"a": "part-II", "b": "part-II", "c": "part-II", "d": "reading", "e": "cloze", "f": "unheard of"}
    passages = questions.select("paper_id", F.lit(1).alias("section_no"), "section_title", "section_type", F.lit(None).cast("int").alias("group_no"), F.lit("").alias("description"))
    near = passages.withColumn("section_description", F.when(F.col("paper_id") == "d", "long " * 20))
    on = questions.withColumn("section_no", F.lit(1)).withColumn("group_no", F.lit(None).cast("int"))
    assert sorted(r["paper_id"] for r in quality.missing_passage(near, on).collect()) == ["b", "c", "e"]


def test_passage_words_count_once_by_part_and_kind(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"word{a}{b}" for a in letters for b in letters][:80]
    line = " ".join([*words, *words[:9]])
    lines = [(1, 1, 1, "part-III", "reading"), (2, 1, 1, "part-III", "reading"), (3, 1, 1, "part-II", "cloze"), (4, 1, 1, "part-II", "cloze"), (5, 1, 1, "part-V", "writing")]
    rows = [(*x, line) for x in lines] + [(1, 1, 2, "part-III", "reading", line.upper())]
    source = spark.createDataFrame(rows, "paper_id long, page long, line_no long, scope string, scope_kind string, line string")
    some, most = " ".join(words[:43]), " ".join(words[:44])
    material = [(1, "x", "wordbank", some), (2, "x", "matching", most), (3, "part-II", None, most), (4, None, "reading", line), (4, "part-III", None, line)]
    kept = spark.createDataFrame(material, "paper_id long, section_key string, kind string, description string")
    found = quality.passage_coverage(source, kept)
    assert sorted(r["paper_id"] for r in found.collect()) == [1, 4]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the pages; words meet without one

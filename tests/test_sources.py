"""Documents on disk: broken ones, missing parts, legacy names, empty folders."""

import json

from paperloom.sources import documents as dc


def put(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=1), encoding="utf-8")


def test_papers_and_collections(spark, tmp_path):
    folder = tmp_path / "papers"
    put(folder, "a.json", {"id": "a", "title": "A", "sections": [{"title": "Part I", "questions": [{"number": "1"}]}]})
    put(folder, "b.json", {"id": "b", "type": dc.COLLECTION, "papers": [{"id": "a", "question_count": 1}]})
    put(folder, "c.json", '{"id": "c", ')
    put(folder, "d.json", {"title": "without id"})
    papers, collections = dc.load_papers(spark, str(folder))
    assert [(r.id, r.sections[0].questions[0].number) for r in papers.collect()] == [("a", "1")]
    assert [(r.id, r.papers[0].id) for r in collections.collect()] == [("b", "a")]


def test_pages(spark, tmp_path):
    put(tmp_path / "ocr", "x.json", {"id": "x", "source": {"file_name": "x.pdf"}, "pages": [{"page": 1, "text": "one"}, {"page": 2}]})
    put(tmp_path / "ocr", "y.json", {"id": "y", "pages": []})
    assert [(r.doc_id, r.file_name, r.page, r.text) for r in dc.load_ocr_pages(spark, str(tmp_path / "ocr")).orderBy("page").collect()] == [("x", "x.pdf", 1, "one"), ("x", "x.pdf", 2, None)]


def test_submissions_have_their_defaults(spark, tmp_path):
    folder = tmp_path / "sent"
    put(folder, "p 1.json", {"paper_id": "p1", "draft": {"answers": {"q1": ["A"]}, "duration_seconds": -5}})
    put(folder, "new.json", {"record_id": "AB" * 16, "paper_id": "p1", "attempts": [{"id": "t"}]})
    rows = {r.record_id: r for r in dc.load_submissions(spark, str(folder)).collect()}
    assert sorted(rows) == ["ab" * 16, "legacy-p1"]
    old, new = rows["legacy-p1"], rows["ab" * 16]
    assert old.answers == {"q1": ["A"]} and old.notes == {} and old.marks == [] and old.attempts == [] and old.duration_seconds == 0 and old.is_legacy and old.mtime
    assert new.answers == {} and len(new.attempts) == 1 and new.title == "" and not new.is_legacy


def test_profile_and_sheet(spark):
    pages = spark.createDataFrame([(1, 1, " short "), (1, 2, "y" * 20), (1, 3, None), (2, 1, "\x00" * 30)], "doc_id long, page long, text string")
    rows, documents = dc.page_profile(pages)
    assert sorted((r.doc_id, r.page, r.char_count, r.needs_ocr) for r in rows.collect()) == [(1, 1, 5, True), (1, 2, 20, False), (1, 3, 0, True), (2, 1, 0, True)]
    assert sorted(tuple(r) for r in documents.collect()) == [(1, 3, 25, 2), (2, 1, 0, 1)]
    schema = "paper_id long, section_no long, section_title string, number long, type string, stem string"
    questions = spark.createDataFrame([(1, 1, "Part II Cloze", 1, "single_choice", " a "), (1, 2, "Vocabulary", 2, "single_choice", None), (1, 3, None, 3, "single_choice", "c"), (1, 3, "", 4, "essay", "d")], schema)
    sheet, counts = dc.choice_sheet(questions)
    assert sorted((r.number, r.heading, r.stem) for r in sheet.collect()) == [(1, dc.SHEET_HEADING[1], "a"), (2, "Vocabulary", ""), (3, dc.SHEET_OTHER, "c")]
    assert [tuple(r) for r in counts.collect()] == [(1, 3, False)]

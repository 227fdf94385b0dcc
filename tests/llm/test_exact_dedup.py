import hashlib
from collections import defaultdict

from paperloom.llm import exact_dedup


def test_groups_match_plain_grouping(with_null_id):
    rows = [(r["doc_id"], r["text"] or "") for r in with_null_id.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    got = exact_dedup.exact_groups(with_null_id).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_hot_groups_are_dealt_and_whole(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 0.0)
    docs = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 50 AS string) END AS text")
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == 300 and sum(r["kept"] for r in got) == 51
    assert {r["group_size"] for r in got if r["doc_id"] % 3 == 0} == {100}


def test_dropping_keeps_one_row_of_each_text_with_its_columns(with_null_id):
    got = exact_dedup.drop_copies(with_null_id)
    assert got.columns == with_null_id.columns
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in with_null_id.collect()})


def test_empty_table(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def test_main_path_is_native(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_names_may_clash(spark):
    rows = [(1, "a", True, 5, "x", 1), (2, "a", False, 6, "y", 2), (2, "a", False, 6, "y", 2), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stays boolean, `Of` int, sha string, place int")
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[1], rows[3]]

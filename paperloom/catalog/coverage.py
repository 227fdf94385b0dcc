"""C*, S4 and S5: phrase lists and how much of them an exam corpus covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as cv
from .registry import query

_NORM = "trim(regexp_replace(replace(lower(coalesce({0}, '')), '’', ''''), '[^a-z0-9'']+', ' ', 'g'))"
_GAP = "[a-z0-9'']+(?:  [a-z0-9'']+){0,2}"
_TOKENS = r"""regexp_extract_all(replace(lower(regexp_replace(coalesce(phrase, ''), '\bA\b|\bB\b', '__var__', 'g')), '…', '...'), '[a-z0-9]+(?:/[a-z0-9]+)+|[a-z0-9]+|\.\.\.')"""
_GAPS = "('...', 'sb', 'sth', 'somebody', 'someone', 'something', 'somewhere')"


def _matches(phrases: str, corpus: str) -> str:
    """Matches over doubled blanks, as the patterns know no look-around; a phrase's first plain word must stand in the text."""
    return f"""m_tokens AS (SELECT list_id, number, phrase, {_TOKENS} AS t FROM {phrases}),
m_pattern AS (SELECT *, ' ' || array_to_string(list_transform(t, lambda x: CASE WHEN x IN {_GAPS} THEN '{_GAP}' WHEN contains(x, '/') THEN '(?:' || replace(x, '/', '|') || ')' ELSE x END), '  ') || ' ' AS pattern,
 coalesce(list_filter(t, lambda x: x NOT IN {_GAPS} AND NOT contains(x, '/'))[1], '') AS plain FROM m_tokens WHERE len(t) > 0),
m_text AS (SELECT entry_id, ' ' || replace({_NORM.format('text')}, ' ', '  ') || ' ' AS text FROM {corpus}),
m AS (SELECT list_id, number, phrase, entry_id, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS occurrences FROM m_pattern JOIN m_text ON plain = '' OR contains(text, ' ' || plain || ' ')),
matches AS (SELECT * FROM m WHERE occurrences > 0)"""


_CORPUS = _matches("v_phrases", "v_corpus")
_FACET = """spread AS (SELECT m.*, unnest(['year', 'section']) AS facet, unnest([CAST(year AS VARCHAR), section]) AS value FROM matches m JOIN v_corpus c USING (entry_id)),
facets AS (SELECT list_id, number, phrase, facet, value, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM spread GROUP BY ALL)"""
_SUMMARY = """summary AS (SELECT list_id, items, coalesce(matched, 0) AS matched, CAST(round(CAST(coalesce(matched, 0) AS DECIMAL(18,0)) * 100 / items, 2) AS DOUBLE) AS coverage_percent, coalesce(occurrences, 0) AS occurrences
 FROM (SELECT list_id, count(*) AS items FROM v_phrases GROUP BY list_id) LEFT JOIN (SELECT list_id, count(DISTINCT number) AS matched, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM matches GROUP BY list_id) USING (list_id))"""
_FACETS = """domain AS (SELECT DISTINCT 'year' AS facet, CAST(year AS VARCHAR) AS value FROM v_corpus UNION ALL SELECT 'section', unnest(['vocabulary', 'cloze', 'reading'])),
by_facet AS (SELECT list_id, facet, value, coalesce(matched, 0) AS matched_phrases, coalesce(total, 0) AS occurrences FROM (SELECT DISTINCT list_id FROM v_phrases) CROSS JOIN domain
 LEFT JOIN (SELECT list_id, facet, value, count(DISTINCT phrase) AS matched, CAST(sum(occurrences) AS BIGINT) AS total FROM facets GROUP BY ALL) USING (list_id, facet, value))"""


def _found(r):
    return cv.phrase_matches(r.v_phrases, r.v_corpus)


@query("C1", """WITH y AS (SELECT paper_id, regexp_extract(title, '20\\d{2}') AS y FROM v_papers),
b AS (SELECT paper_id, section_no, section, count(*) AS question_count, string_agg(text, ' ' ORDER BY position) AS body FROM v_exam_questions WHERE section <> 'other' GROUP BY ALL),
d AS (SELECT paper_id, section_no, min(description) AS description FROM v_passages WHERE description <> '' GROUP BY ALL)
SELECT CAST(b.paper_id AS VARCHAR) || '-' || CAST(b.section_no AS VARCHAR) AS entry_id, b.paper_id, CASE WHEN y = '' THEN CAST(b.paper_id AS VARCHAR) ELSE y END AS year, section, question_count,
 CASE WHEN description IS NULL THEN body ELSE description || ' ' || body END AS text FROM b JOIN y USING (paper_id) LEFT JOIN d ON d.paper_id = b.paper_id AND d.section_no = b.section_no""")
def _corpus(r):
    papers = r.v_papers.select("paper_id", "title", F.col("paper_id").cast("string").alias("file_stem"))
    described = r.v_passages.filter("description <> ''").groupBy("paper_id", "section_no").agg(F.min("description").alias("description"))
    return cv.exam_corpus(r.v_exam_questions, papers, described)


@query("C2", f"SELECT entry_id, {_NORM.format('text')} AS text FROM v_corpus")
def _normalized(r):
    return r.v_corpus.select("entry_id", cv.normalize_exam_text(F.col("text")).alias("text"))


@query("C3", f"SELECT list_id, number, array_to_string({_TOKENS}, '|') AS tokens FROM v_phrases")
def _tokens(r):
    return r.v_phrases.select("list_id", "number", F.array_join(cv.phrase_tokens(F.col("phrase")), "|").alias("tokens"))


@query("C4", f"WITH {_CORPUS} SELECT * FROM matches")
def _matched(r):
    return _found(r)


@query("C5", f"WITH {_CORPUS}, {_FACET} SELECT * FROM facets")
def _by_facet(r):
    return cv.by_facet(_found(r), r.v_corpus)


@query("C6", f"WITH {_CORPUS}, {_FACET}, {_SUMMARY}, {_FACETS} SELECT list_id, 'all' AS facet, '' AS value, items, matched, coverage_percent, occurrences FROM summary UNION ALL SELECT list_id, facet, value, NULL, matched_phrases, NULL, occurrences FROM by_facet")
def _summary(r):
    found = _found(r)
    whole = cv.list_summary(r.v_phrases, found).select("list_id", F.lit("all").alias("facet"), F.lit("").alias("value"), "items", "matched", "coverage_percent", "occurrences")
    parts = cv.facet_summary(r.v_phrases, found, r.v_corpus)
    return whole.unionByName(parts.withColumnRenamed("matched_phrases", "matched"), allowMissingColumns=True)


@query("C7", f"""WITH {_CORPUS}, t AS (SELECT list_id, number, phrase, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM matches GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY list_id ORDER BY occurrences DESC, number) AS INTEGER) AS rank FROM t) WHERE rank <= 30""")
def _top(r):
    return cv.top_phrases(_found(r))


@query("C8", f"""WITH {_matches('v_stem_phrases', "(SELECT * FROM v_exam_questions WHERE section <> 'other')")},
q AS (SELECT entry_id, unnest(['year', 'section']) AS facet, unnest([year, section]) AS value FROM v_exam_questions WHERE section <> 'other'),
d AS (SELECT facet, value, count(*) AS question_count FROM q GROUP BY ALL), h AS (SELECT list_id, facet, value, count(DISTINCT entry_id) AS hit FROM matches JOIN q USING (entry_id) GROUP BY ALL)
SELECT list_id, facet, value, question_count, coalesce(hit, 0) AS matched_questions, CAST(round(CAST(coalesce(hit, 0) AS DECIMAL(18,0)) * 100 / question_count, 2) AS DOUBLE) AS coverage_percent
FROM (SELECT DISTINCT list_id FROM matches) CROSS JOIN d LEFT JOIN h USING (list_id, facet, value)""")
def _questions(r):
    asked = r.v_exam_questions.filter("section <> 'other'")
    return cv.question_coverage(asked, cv.phrase_matches(r.v_stem_phrases, asked))


@query("C9", f"""WITH {_CORPUS}, l AS (SELECT lower(phrase) AS key, count(DISTINCT list_id) AS lists FROM v_phrases GROUP BY ALL), h AS (SELECT lower(phrase) AS key, count(DISTINCT list_id) AS hits FROM matches GROUP BY ALL)
SELECT count(*) AS phrases, count(hits) AS matched, count(*) FILTER (hits > 1) AS matched_in_several, count(*) FILTER (lists > 1) AS listed_in_several FROM l LEFT JOIN h USING (key)""")
def _union(r):
    return cv.union_coverage(r.v_phrases, _found(r))


@query("C10", """SELECT 'exam_count' AS stat, count(DISTINCT year) AS value FROM v_corpus UNION ALL SELECT 'documents', count(*) FROM v_corpus
UNION ALL SELECT 'questions', count(*) FROM v_exam_questions UNION ALL SELECT 'section ' || section, count(*) FROM v_corpus GROUP BY section""")
def _stats(r):
    return cv.corpus_stats(r.v_corpus, r.v_exam_questions)


_LOADED = """loaded AS (SELECT * FROM (SELECT line_no, string_split(trim(line), '|||') AS f FROM v_phrase_lines WHERE trim(line) <> '') WHERE len(f) = 5
 QUALIFY row_number() OVER (PARTITION BY lower(f[1]) ORDER BY line_no) = 1)"""


@query("S4", f"""WITH {_LOADED} SELECT line_no, f[1] AS phrase, f[2] AS meaning, f[3] AS category, f[4] AS example, f[5] AS translation, TRUE AS accepted FROM loaded
UNION ALL SELECT line_no, NULL, NULL, NULL, NULL, NULL, FALSE FROM v_phrase_lines WHERE trim(line) <> '' AND len(string_split(trim(line), '|||')) <> 5""")
def _load(r):
    return cv.load_phrases(r.v_phrase_lines)


@query("S5", """SELECT number, phrase, page FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY page, block_id) AS rn FROM (
 SELECT CAST(split_part(block_text, chr(10), 1) AS BIGINT) AS number, trim(substr(block_text, strpos(block_text, chr(10)) + 1)) AS phrase, page, block_id FROM v_blocks) WHERE lower(phrase) NOT IN ('', 'word', 'meaning')) WHERE rn = 1""")
def _blocks(r):
    return cv.load_phrase_blocks(r.v_blocks)


@query("C11", f"""WITH {_LOADED} SELECT row_number() OVER (ORDER BY CASE f[3] WHEN '动词短语' THEN 0 WHEN '介词短语' THEN 2 ELSE 99 END, lower(f[1]), f[1]) AS position, f[1] AS phrase, f[3] AS category FROM loaded""")
def _catalogue(r):
    return cv.phrase_catalogue(cv.load_phrases(r.v_phrase_lines))


_YEARS = [str(y) for y in range(2021, 2026)]
_WIDE = ", ".join(
    f"CAST(sum({column}) FILTER (facet = '{kind}' AND value = '{value}') AS BIGINT) AS \"{value}_{name}\""
    for kind, values in (("section", cv.SECTIONS), ("year", _YEARS)) for value in values for column, name in (("matched_phrases", "matched"), ("occurrences", "occurrences"))
)


@query("C12", f"WITH {_CORPUS}, {_FACET}, {_SUMMARY}, {_FACETS}, wide AS (SELECT list_id, {_WIDE} FROM by_facet GROUP BY list_id) SELECT * FROM summary JOIN wide USING (list_id)")
def _table(r):
    found = _found(r)
    return cv.coverage_table(cv.list_summary(r.v_phrases, found), cv.facet_summary(r.v_phrases, found, r.v_corpus), _YEARS)

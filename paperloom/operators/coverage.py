"""Phrase coverage: how often the phrases of a list occur in an exam corpus, and where.

Phrases meet texts through an inverted index of words and pairs of neighbours: a phrase is looked up by its
rarest literal one only, so an index row leads to the few phrases anchored at it, and only those pairs are
checked with the phrase's whole pattern. A phrase of placeholders alone has no such word; it is met through the number of words
that a text must have, which is an equality as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.staging import dealt, staged

# Placeholders of phrase lists, and the sections that count.
PLACEHOLDERS = ["sb", "sth", "somebody", "someone", "something", "somewhere"]
SECTIONS = ["vocabulary", "cloze", "reading"]
# The phrase categories in the order of the catalogue.
CATEGORIES = [
    "动词短语", "动词搭配", "介词短语", "形容词搭配", "名词短语", "句型结构", "被动结构", "时态结构", "比较结构",
    "让步句型", "连词短语", "虚拟语气", "并列结构", "副词表达", "动词", "形容词", "年龄表达", "固定表达",
]
HEADER_WORDS = ["word", "meaning"]
#: Words that a placeholder or an ellipsis stands for, at most.
GAP = 3
_TOKEN = r"[a-z0-9]+(?:/[a-z0-9]+)+|[a-z0-9]+|\.\.\."
_WORD = r"[a-z0-9']+"


def normalize_exam_text(text: Column) -> Column:
    """Lower case, words of letters, digits and apostrophes, one blank between."""
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9']+", " "))


def phrase_tokens(phrase: Column, ab_wildcard: bool = False) -> Column:
    """Words, alternatives ``a/b`` and ``...`` of a phrase. The letters A and B are the word ``var``, or
    a placeholder with ``ab_wildcard``."""
    stands = "somebody" if ab_wildcard else "__var__"
    plain = F.lower(F.regexp_replace(F.coalesce(phrase, F.lit("")), r"\bA\b|\bB\b", stands))
    return F.regexp_extract_all(F.replace(plain, F.lit("…"), F.lit("...")), F.lit(_TOKEN), F.lit(0))


def _is_gap(token: Column) -> Column:
    return (token == "...") | token.isin(*PLACEHOLDERS)


def phrase_pattern(tokens: Column) -> Column:
    """A pattern for padded text; null for a phrase without tokens, which matches nothing. It begins with a blank
    and takes words whole, so a place that doesn't match is left at once."""
    gap = f"{_WORD}+(?:  {_WORD}+){{0,{GAP - 1}}}"
    part = F.transform(tokens, lambda t: F.when(_is_gap(t), F.lit(gap)).when(F.contains(t, F.lit("/")), F.concat(F.lit("(?:"), F.replace(t, F.lit("/"), F.lit("|")), F.lit(")"))).otherwise(t))
    return F.when(F.size(tokens) > 0, F.concat(F.lit(" "), F.array_join(part, "  "), F.lit(" ")))


def padded(text: Column) -> Column:
    """Normalised text with a blank before and after every word, so that matches next to each other share none."""
    return F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))


def _grams(words: Column) -> Column:
    """The words and pairs of neighbours of a text, once each."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.lit(1), F.size(words) - 1)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def phrase_matches(phrases: DataFrame, corpus: DataFrame, ab_wildcard: bool = False) -> DataFrame:
    """``list_id, number, phrase, entry_id, occurrences``: non-overlapping matches, where there are any.

    ``phrases``: list_id, number, phrase; ``corpus``: entry_id, text. A null text has no words.
    """
    texts = staged(corpus.select("entry_id", normalize_exam_text(F.col("text")).alias("text")).filter("text <> ''"), "texts")
    listed = phrases.select("list_id", "number", "phrase", phrase_tokens(F.col("phrase"), ab_wildcard).alias("tokens"))
    listed = staged(listed.withColumn("pattern", phrase_pattern(F.col("tokens"))), "phrases")
    # Texts meet their phrases where both are dealt by text. Sizes of files tell little of sizes in memory, so neither is
    # left to be sent to every task.
    checked = candidates(listed, texts).join(listed.select("list_id", "number", "phrase", "pattern"), ["list_id", "number"]).join(dealt(texts, "entry_id").hint("merge"), "entry_id")
    found = checked.select("list_id", "number", "phrase", "entry_id", F.regexp_count(padded(F.col("text")), F.col("pattern")).cast("bigint").alias("occurrences"))
    return found.filter("occurrences > 0").unionByName(_gap_matches(listed, texts))


def candidates(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """``list_id, number, entry_id``: texts that hold the rarest word or pair of neighbours of a phrase.
    ``listed``: list_id, number, tokens; ``texts``: entry_id, text, normalised."""
    # One row for each word that may stand at a literal place, and for each pair at two such places in a row:
    # an alternative is one place with several.
    places = listed.select("list_id", "number", "tokens", F.posexplode("tokens").alias("place", "token")).filter(~_is_gap(F.col("token")))
    after = F.get("tokens", F.col("place") + 1)
    singles = places.select("list_id", "number", "place", F.lit(1).alias("words"), F.explode(F.split("token", "/")).alias("word"))
    firsts = places.withColumn("after", after).filter(F.col("after").isNotNull() & ~_is_gap(F.col("after")))
    doubles = firsts.select("list_id", "number", "place", "after", F.explode(F.split("token", "/")).alias("a")).select("list_id", "number", "place", "a", F.explode(F.split("after", "/")).alias("b"))
    choices = singles.unionByName(doubles.select("list_id", "number", "place", F.lit(2).alias("words"), F.concat_ws(" ", "a", "b").alias("word")))
    wanted = choices.select("word").distinct()
    index = staged(texts.select("entry_id", F.explode(_grams(F.split("text", " "))).alias("word")).join(wanted, "word", "left_semi"), "index")
    frequency = index.groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    cost = choices.join(frequency, "word", "left").groupBy("list_id", "number", "place", "words").agg(F.sum(F.coalesce("held", F.lit(0))).alias("cost"))
    anchor = cost.groupBy("list_id", "number").agg(F.min_by(F.struct("place", "words"), F.struct("cost", "place", "words")).alias("at")).select("list_id", "number", "at.place", "at.words")
    anchored = choices.join(anchor, ["list_id", "number", "place", "words"]).select("list_id", "number", "word")
    # Written, so that its size is known: the index is the longer side, and stays where its texts are.
    return dealt(index, "entry_id").join(staged(anchored, "anchored"), "word").select("list_id", "number", "entry_id").distinct()


def _gap_matches(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """Matches of phrases of placeholders alone. A match takes as many words as it can, ``GAP`` for each
    placeholder, and needs one for each; so the count follows from the number of words."""
    gaps = listed.filter((F.size("tokens") > 0) & F.forall("tokens", _is_gap)).select("list_id", "number", "phrase", F.size("tokens").alias("gaps"))
    # One number, bounded by the longest phrase of the lists.
    most = gaps.agg(F.max("gaps")).first()[0] or 0
    sizes = texts.select("entry_id", F.size(F.split("text", " ")).alias("words"))
    able = sizes.filter(F.lit(most) > 0).select("entry_id", "words", F.explode(F.sequence(F.lit(1), F.least("words", F.lit(max(1, most))))).alias("gaps"))
    whole = F.floor(F.col("words") / (GAP * F.col("gaps")))
    rest = (F.col("words") % (GAP * F.col("gaps")) >= F.col("gaps")).cast("bigint")
    return able.join(gaps, "gaps").select("list_id", "number", "phrase", "entry_id", (whole + rest).cast("bigint").alias("occurrences"))


def exam_corpus(questions: DataFrame, papers: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``entry_id, paper_id, year, section, question_count, text`` of every section that counts.

    ``questions``: paper_id, section, section_no, position, text; ``papers``: paper_id, title, file_stem;
    ``descriptions``: paper_id, section_no, description. A section's text is its description, then its
    questions in order; the year stands in the title, else the file's stem is taken.
    """
    counted = questions.filter(F.col("section").isin(*SECTIONS))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ")
    sections = counted.groupBy("paper_id", "section_no", "section").agg(F.count(F.lit(1)).alias("question_count"), joined.alias("body"))
    year = F.regexp_extract("title", r"20\d{2}", 0)
    named = papers.select("paper_id", F.when(year != "", year).otherwise(F.col("file_stem")).alias("year"))
    described = descriptions.filter("description <> ''").select("paper_id", "section_no", "description")
    out = sections.join(named, "paper_id").join(described, ["paper_id", "section_no"], "left")
    text = F.concat_ws(" ", F.col("description"), F.col("body"))
    return out.select(F.concat_ws("-", "paper_id", "section_no").alias("entry_id"), "paper_id", "year", "section", "question_count", text.alias("text"))


def by_facet(matches: DataFrame, corpus: DataFrame) -> DataFrame:
    """``list_id, number, phrase, facet, value, occurrences`` for the facets year and section."""
    facets = F.explode(F.array(F.struct(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value")), F.struct(F.lit("section").alias("facet"), F.col("section").alias("value")))).alias("f")
    spread = matches.join(corpus.select("entry_id", facets).hint("merge"), "entry_id")
    return spread.groupBy("list_id", "number", "phrase", "f.facet", "f.value").agg(F.sum("occurrences").alias("occurrences"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up to two places; 0 of nothing."""
    share = F.when(whole > 0, part.cast("decimal(18,0)") * 100 / whole.cast("decimal(18,0)")).otherwise(F.lit(0))
    return F.round(share, 2).cast("double")


def list_summary(phrases: DataFrame, matches: DataFrame) -> DataFrame:
    """``list_id, items, matched, coverage_percent, occurrences``; a list without a match has zeros."""
    items = phrases.groupBy("list_id").agg(F.count(F.lit(1)).alias("items"))
    found = matches.groupBy("list_id").agg(F.count_distinct("number").alias("matched"), F.sum("occurrences").alias("occurrences"))
    joined = items.join(found, "list_id", "left")
    matched = F.coalesce("matched", F.lit(0))
    return joined.select("list_id", "items", matched.alias("matched"), percent(matched, F.col("items")).alias("coverage_percent"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


def facet_summary(phrases: DataFrame, matches: DataFrame, corpus: DataFrame) -> DataFrame:
    """``list_id, facet, value, matched_phrases, occurrences`` for every list, section and year of the
    corpus; what has no match has zeros."""
    found = by_facet(matches, corpus).groupBy("list_id", "facet", "value").agg(F.count_distinct("phrase").alias("matched"), F.sum("occurrences").alias("total"))
    years = corpus.select(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value"))
    sections = corpus.sparkSession.createDataFrame([("section", s) for s in SECTIONS], "facet string, value string")
    # Years and sections are few, whatever the corpus; they are joined to each list through a key.
    domain = years.unionByName(sections).distinct().withColumn("one", F.lit(1))
    lists = phrases.select("list_id").distinct().withColumn("one", F.lit(1))
    full = lists.join(domain, "one").drop("one").join(found, ["list_id", "facet", "value"], "left")
    return full.select("list_id", "facet", "value", F.coalesce("matched", F.lit(0)).alias("matched_phrases"), F.coalesce("total", F.lit(0)).alias("occurrences"))


def phrase_totals(matches: DataFrame) -> DataFrame:
    return matches.groupBy("list_id", "number", "phrase").agg(F.sum("occurrences").alias("occurrences"))


def top_phrases(matches: DataFrame, top: int = 30) -> DataFrame:
    """The phrases of each list that occur most, by occurrences and then number."""
    order = Window.partitionBy("list_id").orderBy(F.desc("occurrences"), "number")
    return phrase_totals(matches).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def question_coverage(questions: DataFrame, question_matches: DataFrame) -> DataFrame:
    """``list_id, facet, value, question_count, matched_questions, coverage_percent`` of questions with a
    match, by section and year. ``question_matches`` are matches in the questions' own texts, entry_id
    being the question's."""
    facets = F.explode(F.array(F.struct(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value")), F.struct(F.lit("section").alias("facet"), F.col("section").alias("value")))).alias("f")
    each = questions.select("entry_id", facets).select("entry_id", "f.facet", "f.value")
    domain = each.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("question_count")).withColumn("one", F.lit(1))
    matched_by = staged(question_matches.select("list_id", "entry_id").distinct(), "asked")
    hit = dealt(matched_by, "entry_id").join(dealt(each, "entry_id").hint("merge"), "entry_id").groupBy("list_id", "facet", "value").agg(F.count(F.lit(1)).alias("hit"))
    lists = matched_by.select("list_id").distinct().withColumn("one", F.lit(1))
    full = lists.join(domain, "one").drop("one").join(hit, ["list_id", "facet", "value"], "left")
    matched = F.coalesce("hit", F.lit(0))
    return full.select("list_id", "facet", "value", "question_count", matched.alias("matched_questions"), percent(matched, F.col("question_count")).alias("coverage_percent"))


def union_coverage(phrases: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: distinct phrases of all lists without regard to case, those that are matched, those
    matched through more than one list, and those that stand in more than one list."""
    key = F.lower("phrase").alias("key")
    listed = phrases.select(key, "list_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("lists"))
    hit = matches.select(key, "list_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("hits"))
    both = listed.join(hit, "key", "left")
    return both.agg(
        F.count(F.lit(1)).alias("phrases"), F.count("hits").alias("matched"), F.count_if(F.col("hits") > 1).alias("matched_in_several"), F.count_if(F.col("lists") > 1).alias("listed_in_several")
    )


def corpus_stats(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """``stat, value``: exams (distinct years), section documents, all questions (of excluded sections too)
    and entries by section."""
    one = corpus.agg(F.count_distinct("year").alias("exam_count"), F.count(F.lit(1)).alias("documents"))
    rows = one.select(F.explode(F.create_map(F.lit("exam_count"), F.col("exam_count"), F.lit("documents"), F.col("documents"))).alias("stat", "value"))
    asked = questions.agg(F.count(F.lit(1)).alias("value")).select(F.lit("questions").alias("stat"), "value")
    sections = corpus.groupBy("section").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("section "), F.col("section")).alias("stat"), "value")
    return rows.unionByName(asked).unionByName(sections)


def load_phrases(lines: DataFrame) -> DataFrame:
    """``line_no, phrase, meaning, category, example, translation, accepted`` of records of five fields;
    blank lines are skipped, the first record of a phrase counts, without regard to case. A record with
    another number of fields is a row with only its line number and ``accepted`` false."""
    parts = lines.filter(F.trim("line") != "").select("line_no", F.split(F.trim("line"), r"\|\|\|").alias("f"))
    names = ["phrase", "meaning", "category", "example", "translation"]
    whole = F.size("f") == len(names)
    rows = parts.select("line_no", *[F.when(whole, F.col("f")[i]).alias(n) for i, n in enumerate(names)], whole.alias("accepted"))
    first = rows.filter("accepted").groupBy(F.lower("phrase").alias("key")).agg(F.min_by(F.struct(*rows.columns), "line_no").alias("r")).select("r.*")
    return first.unionByName(rows.filter("NOT accepted"))


def load_phrase_blocks(blocks: DataFrame) -> DataFrame:
    """``number, phrase, page`` from blocks ``block_id, page, block_text`` of a number, a line end and a
    phrase; header words are dropped, the first block of a number counts, by page and place."""
    pattern = r"(?s)^(\d+)[ \t\f\r]*\n\s*(.+)$"
    body = F.trim(F.regexp_replace(F.replace(F.regexp_extract(F.trim("block_text"), pattern, 2), F.lit("…"), F.lit("...")), r"\s+", " "))
    rows = blocks.select("block_id", "page", F.regexp_extract(F.trim("block_text"), pattern, 1).alias("n"), F.replace(body, F.lit("－"), F.lit("-")).alias("phrase"))
    kept = rows.filter((F.col("n") != "") & (F.col("phrase") != "") & ~F.lower("phrase").isin(*HEADER_WORDS))
    return kept.groupBy(F.col("n").cast("bigint").alias("number")).agg(F.min_by(F.struct("phrase", "page"), F.struct("page", "block_id")).alias("r")).select("number", "r.phrase", "r.page")


def phrase_catalogue(records: DataFrame) -> DataFrame:
    """``position, phrase, category``: by rank of the category, then phrase without regard to case. The
    position is counted in ranges of the order, so the list isn't sorted in one task."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")), F.lit(0))
    rank = F.when(rank > 0, rank - 1).otherwise(F.lit(99)).cast("int")
    keyed = records.filter("accepted").select("phrase", "category", rank.alias("rank"), F.lower("phrase").alias("key"))
    keyed = keyed.withColumn("part", F.struct("rank", F.substring("key", 1, 2).alias("head")))
    sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    before = sizes.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key", "phrase"))
    return keyed.withColumn("inside", inside).join(before, "part").select((F.col("before") + F.col("inside")).alias("position"), "phrase", "category")


def coverage_table(summary: DataFrame, facets: DataFrame, years: list[str]) -> DataFrame:
    """One wide row a list: the summary, then matched phrases and occurrences by section and year."""
    wide = facets.groupBy("list_id").agg(
        *[F.sum(F.when((F.col("facet") == kind) & (F.col("value") == value), F.col(column))).alias(f"{value}_{name}") for kind, values in (("section", SECTIONS), ("year", years)) for value in values for column, name in (("matched_phrases", "matched"), ("occurrences", "occurrences"))]
    )
    return summary.join(wide, "list_id", "left")

import random
import re
from collections import Counter, defaultdict

import pytest

from paperloom.llm import collocations
from paperloom.llm.catalog import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, gram string, n int, k int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in kept.items():
            if any(len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in kept.items()):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (f[g[:c]] * f[g[c:]]), c, f[g[:c]], f[g[c:]]) for c in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), " ".join(g), left, right))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, totals[lang], -score))
    return sorted(out)


def got(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


def some_rows(seed, count):
    rng = random.Random(seed)
    words = ["a", "B", "c", "d", "e", "é", "New York", "the of", "x\x1cy", "fixed phrase of six plain words"]
    ends = [" ", " ", " ", "\t", ", ", ".", "\n", "\r\n", " ! "]
    return [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(count)]


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (10, 5, 7), (2, 3, 2000), (5, 2, 2000)])
def test_phrases_match_a_plain_version(spark, least, longest, top):
    rows = some_rows(least, 80) + [(None, "en"), ("", None), (" \t\n", "en"), ("a a a a a a a a a a a a", "en"), ("a a a a a a a a a a a a", "en")]
    docs = spark.createDataFrame([(i, t, x, "g", 1, 2) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)
    assert got(docs, least=least, longest=longest, top=top) == plain(rows, least, longest, top)


def test_a_full_bit_map_changes_nothing(spark, monkeypatch):
    rows = some_rows(9, 60)
    docs = spark.createDataFrame([(i, t, x, "g", 1, 2) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(2)
    want = plain(rows, 4, 5, 2000)
    everything = lambda counted, least: collocations.np.full((1 << collocations.BITS) // 8, 255, collocations.np.uint8)
    monkeypatch.setattr(collocations, "_frequent_pairs", everything)
    assert got(docs, least=4) == want


def test_a_long_text_and_an_empty_table(spark):
    text = "alpha beta gamma delta epsilon zeta " * 40_000
    docs = spark.createDataFrame([(1, text, "en", "g", 1, 2)], SCHEMA)
    assert got(docs) == plain([(text, "en")], 100, 5, 2000)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_sql_agrees_with_the_plain_version():
    duckdb = pytest.importorskip("duckdb")
    rows = some_rows(4, 400)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op11_phrase_collocations"]).fetchall()) == plain(rows, 100, 5, 2000)

"""Highlights of texts against a plain merge."""

import random

from pyspark.sql import functions as F

from paperloom.functions import scans
from paperloom.operators import records as rc


def merged(ranges):
    out = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(r) for r in out]


def test_equal_ranges_are_one_highlight(spark, monkeypatch):
    # Rows may come back from a written table in any order.
    plain = scans.staged
    monkeypatch.setattr(scans, "staged", lambda df, name: plain(df.repartition(4).sortWithinPartitions(F.rand(7)), name))
    rng = random.Random(3)
    rows = [(element, start, start + 2, 100) for element in range(500) for start in (1, 10, 10, 10, 20, 20, 21, 30) for _ in range(rng.randrange(1, 4))]
    rng.shuffle(rows)
    got = rc.merge_highlights(spark.createDataFrame(rows, "element long, start_pos long, end_pos long, text_len long")).collect()
    want = [(element, *r) for element in range(500) for r in merged([r[1:3] for r in rows if r[0] == element])]
    assert sorted(tuple(r) for r in got) == sorted(want)

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


_SPACE = re.compile(rb"[\x20\x09-\x0D]")

#: Spark's own switch for shuffle files of a plan that has run.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch that are Python values at one time.
SLICE = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one under the temp folder where none is set, as in tests."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    return set_by_cluster or os.path.join(tempfile.gettempdir(), "paperloom-checkpoints")


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later readers don't run its plan again,
    and a lost executor costs nothing that is in the table. It goes when the driver ends.
    With ``tidy``, what its plan shuffled goes as soon as the table is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(_TIDY, "false")
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.set(_TIDY, kept)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Ends a table that ``written`` made, once nothing is to read it."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def mapped(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Rows of ``df`` through a function from a batch to a batch, each a dict of columns.

    ``make()`` gives that function and runs once a task, so it may hold what the task reuses. Ids
    come as Python numbers or None: unlike a data frame's, a column with nulls keeps its integers.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield pa.RecordBatch.from_pydict(each(batch.slice(at, SLICE).to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that no column of ``df`` clashes with."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a value as text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def least_count(counts: DataFrame, column: str, most: int) -> int:
    """The smallest power of two t so that at most ``most`` rows have ``column`` >= t.

    The rows that reach it may be collected or broadcast: ``most`` bounds them whatever the input.
    """
    level = F.floor(F.log2(F.col(column).cast("double"))).cast("int")
    rows = counts.filter(F.col(column) >= 1).groupBy(level.alias("level")).count().collect()
    return least_of({row["level"]: row["count"] for row in rows}, most)


def least_of(levels: dict[int, int], most: int) -> int:
    """``least_count`` by the rows of each level, whose counts lie between one power of two and the next."""
    at, held = 0, 0
    for level in sorted(levels, reverse=True):
        held += levels[level]
        if held > most:
            at = level + 1
            break
    return 1 << at


class Memo(dict):
    """Values of ``make`` by key, in two generations of at most ``size`` entries each, so that
    memory stays bounded and frequent keys stay known."""

    def __init__(self, make: Callable, size: int = 200_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def split_words(text: bytes, step: int = 4 << 20) -> Iterator[list[bytes]]:
    """The runs of characters other than ASCII white space, a list for about every ``step`` bytes, so
    that a very long text is never split into one list."""
    at = 0
    while at < len(text):
        end = at + step
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].split()
        at = end


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of all texts in order of their first place, the number of every word in a row,
    and how many words each text has. Words are runs of characters other than ASCII white space."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    of = pc.list_parent_indices(split).filter(full).to_numpy()
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.bincount(of, minlength=len(texts))

"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import scratch_path, shared_dir  # noqa: F401
from tidemark.ship import ship

#: Texts of one Python step are handed back in slices of about this many bytes.
SLICE_BYTES = 8 << 20
#: Narrow rows that are worth a file of their own.
FILE_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written by ``cut`` since the outermost ``made`` began, for those that ask.
_MADE: list[list[str]] = []


@contextmanager
def made() -> Iterator[list[str]]:
    """The folders that ``cut`` writes meanwhile, so that they can be removed when what was made of
    them is written itself."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        inner = _MADE.pop()
        if _MADE:
            _MADE[-1] += inner


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of the shared folder. Only what nothing reads any more may go."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here and a lost
    executor costs only a re-read. Reading back gives real sizes, so Spark broadcasts a side
    of a join only if it is small."""
    path = scratch_path(df.sparkSession, label)
    if _MADE:
        _MADE[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> DataFrame:
    """``df``, of narrow rows and no more than ``most`` of them, in no more partitions than these fill:
    few rows go to few files however many partitions a shuffle has; large tables keep theirs."""
    return df.coalesce(max(1, -(-most // FILE_ROWS)))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], part: list[str], times: str = "times", total: int | None = None, share: int = 1000, salts: int = 32, how: str = "inner", merge: bool = False) -> DataFrame:
    """``rows`` with the columns of their group (joined by ``on``), hot groups dealt out.

    ``groups`` has one row a key, whose ``times`` is the number of its rows, and should be cheap to
    read (cut). Hashes of the keys with over a ``share``-th of all rows, fewer than ``share`` as they
    can't add up to more, come to the driver; rows with such a hash are dealt by ``part`` into
    ``salts`` parts, each with its copy of the group's row. So no task has more than a small part of
    a hot key, and what is handed around has a bound that doesn't grow with the data. ``merge`` joins
    by sorting even where the groups are few, for those whose number grows with the data."""
    if total is None:
        total = groups.agg(F.sum(times)).first()[0] or 0
    if any(rows.schema[c].dataType != groups.schema[c].dataType for c in on):
        raise TypeError("keys of two types have two hashes")
    least = max(256, total // share)
    key = F.xxhash64(*on)
    hot = [r[0] for r in groups.filter(F.col(times) >= least).select(key).distinct().collect()]
    if not hot:
        return rows.join(groups.hint("merge") if merge else groups, on, how)
    dealt = rows.withColumn("__salt", F.when(key.isin(hot), F.pmod(F.xxhash64(*part), F.lit(salts))).otherwise(0))
    copies = F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = groups.withColumn("__salt", F.explode(copies.cast("array<bigint>")))
    return dealt.join(copied.hint("merge") if merge else copied, [*on, "__salt"], how).drop("__salt")


def without(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """Columns of ``df`` but those that ``names`` hold, letter case aside: results replace them."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body has it: inside
    higher-order functions Catalyst doesn't share equal parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(text: Column) -> Column:
    """Equal texts have equal keys; null has the key of no text."""
    return F.when(text.isNull(), F.lit("-")).otherwise(F.md5(text))


def row_key(doc_id: Column, text: Column) -> Column:
    """One key for all rows of the same id and text, nulls included."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_key(text))


def slices(values: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, count) of runs of a binary column, of at most ``limit`` bytes or one row each."""
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i - start
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths) - start


def map_text(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[bytes | None]], list[list]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from whole texts in Python, Arrow batch by Arrow batch.

    ``make`` runs once in each task and returns the function from a list of UTF-8 texts to one
    list of values per field. Columns of ``keep`` (all, if None) stay, but for those whose names
    clash with a field, which the field replaces.
    """
    ship(df.sparkSession)
    names = [f.name for f in fields]
    source = df.select(*(F.col(f"`{c}`") for c in (df.columns if keep is None else keep)))
    kept = without(source, names)
    work = df.select(*kept, F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = T.StructType([*(work.schema[i] for i in range(len(kept))), *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = make()
        for batch in batches:
            for start, n in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(start, n)
                made = do(part.column(part.num_columns - 1).to_pylist())
                arrays = [*part.columns[:-1], *(pa.array(v, t) for v, t in zip(made, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return work.mapInArrow(run, schema)

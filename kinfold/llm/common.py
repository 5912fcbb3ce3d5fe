"""Shared helpers: table access, shared scratch tables, word splitting and fresh column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a Java and RE2 regular expression and as a set of characters.
WS_RE = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark, so any store that it reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is made if the session is local (as in tests); on a
    cluster that would be a folder of one machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch tables of this driver that haven't been removed.
_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{scratch_root(spark)}/kinfold/{label}-{uuid.uuid4().hex}")
    return _made[-1]


#: Narrow rows for which a scratch table has a file at most.
FILE_ROWS = 1 << 15


def cut(df: DataFrame, label: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: lineage ends in files that outlive executors.

    ``rows``: about how many narrow rows it has at most, where that is known: then it isn't written in more files than they are worth.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settled(df: DataFrame, label: str, keep: set[str], rows: int | None = None) -> DataFrame:
    """A result that no longer needs the tables it was made from, once written; ``keep`` is that of the ``scratch`` it ends."""
    out, path = cut(df, label, rows)
    keep.add(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Removes the scratch tables that were made inside it, but for the paths that are put into the set it gives."""
    before, keep = len(_made), set()
    try:
        yield keep
    finally:
        remove(spark, *[p for p in _made[before:] if p not in keep])


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        if path in _made:
            _made.remove(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: A key with more than this share of all rows is joined by broadcast.  There can't be more of them than its inverse.
HOT_SHARE = 1 / 4096


def join_spread(rows: DataFrame, per_key: DataFrame, key: str, copies: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to the table ``per_key``, which has one row for each value of ``key`` and says in ``copies`` how many rows have it.

    Rows with a hot key stay where they are: the hot part of ``per_key`` has at most 1 / HOT_SHARE rows, whatever the size of the
    table, and is broadcast.  All other keys are joined as the planner likes; none of them can fill a task.
    ``total`` is the number of rows, or more; ``copies`` isn't in the result.  No key of ``per_key`` may be null.
    """
    bound = F.lit(total * HOT_SHARE)
    hot, cold = per_key.where(F.col(copies) > bound).drop(copies), per_key.where(F.col(copies) <= bound).drop(copies)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name, k = f"_kf_{base}", 0
        while name.lower() in taken:
            k += 1
            name = f"_kf_{base}{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a non-null text, split at ASCII white space; no words: an empty array."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE))


def n_words_of(text: Column) -> Column:
    """How many words a non-null text has, without making them."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")

"""Input tables, the record view, and a cache of steps."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Goes up whenever a cached step's rules change.
STEP_VERSION = 3
#: Whether Spark removes the shuffle files of a statement at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words of a record's name and of its street.
NAME_WORDS, STREET_WORDS = 4, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def records(docs: DataFrame) -> DataFrame:
    """Documents as business records, from their whole texts: the ``NAME_WORDS`` longest words are the name, the next ones the street after a house number.

    Words count once; of equally long ones the first in the alphabet comes first.  Copies of a text are copies of a record, and a word changed
    somewhere in a text changes the record where it is among the longest.
    """
    words = F.array_distinct(F.split(clean(F.col("text")), " "))
    # Sorts by length and then by word without a comparator.
    ranked = F.array_sort(F.transform(words, lambda w: F.concat(F.lpad((F.lit(99_999_999) - F.length(w)).cast("string"), 8, "0"), w)))
    chosen = lambda at, n: F.array_join(F.transform(F.slice("r", at, n), lambda w: F.substring(w, 9, 1 << 30)), " ")
    d = docs.select("doc_id", "lang", "source", "n_chars", ranked.alias("r"))
    return d.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 3 + 1).cast("int").alias("src"), F.col("lang").alias("cty"),
        F.trim(chosen(1, NAME_WORDS)).alias("name"),
        F.trim(F.concat((F.col("n_chars") % 500).cast("string"), F.lit(" "), chosen(NAME_WORDS + 1, STREET_WORDS))).alias("addr"),
        F.col("source").alias("st"),
    )


def true_pairs(docs: DataFrame) -> DataFrame:
    """(s1, src, id) of records whose whole text says the same: the owner is the smallest first-source id of the group."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    d = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 + 1).cast("int").alias("src"), F.col("lang").alias("cty"), F.md5(norm.cast("binary")).alias("h"))
    own = d.where("src = 1").groupBy("cty", "h").agg(F.min("id").alias("s1"))
    return d.where("src <> 1").join(own, ["cty", "h"]).select("s1", "src", "id")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where the session is local and names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def step(spark: SparkSession, name: str, build: Callable[[], DataFrame], *inputs: str, **parameters: object) -> DataFrame:
    """The result of a step, written once and read by all that need it.

    The folder's name is a digest of the step, its parameters, and the files of its input tables with their sizes and times, so a changed
    input or parameter is another step.  An unfinished step has no ``_SUCCESS`` mark and is built again.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for i in inputs:
        p = jvm.org.apache.hadoop.fs.Path(i)
        fs = p.getFileSystem(conf)
        found = fs.listStatus(p)
        files += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    tag = hashlib.sha256(repr((STEP_VERSION, name, sorted(parameters.items()), sorted(files))).encode()).hexdigest()[:24]
    out = f"{scratch(spark)}/steps/{name}-{tag}"
    mark = jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    if not mark.getFileSystem(conf).exists(mark):
        built, before = build(), spark.conf.get(CLEANUP, "false")
        # What was shuffled for the step isn't read again; it would stay on disk until the driver happens to collect its garbage.
        spark.conf.set(CLEANUP, "true")
        try:
            built.write.mode("overwrite").option("compression", "zstd").parquet(out)
        finally:
            spark.conf.set(CLEANUP, before)
    return spark.read.parquet(out)

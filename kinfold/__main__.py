"""Command line: ``python -m kinfold train FOLDER MODELS``, ``match FOLDER MODELS OUT`` or ``query NAME TABLES OUT``.

Runs in the session that spark-submit sets up, or in a local one.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from .plans import catalog, linkage

    sizes = {"train": 2, "match": 3, "query": 3}
    if not argv or len(argv) - 1 != sizes.get(argv[0]):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"kinfold {argv[0]}").getOrCreate()
    if argv[0] == "train":
        linkage.train(spark, *argv[1:]).orderBy("kind", "v").show(50, truncate=False)
        return 0
    if argv[0] == "match":
        wrong = linkage.match(spark, *argv[1:]).first().asDict()
        print(wrong)
        return int(any(wrong.values()))
    catalog.queries()[argv[1]](spark, argv[2]).write.mode("overwrite").parquet(argv[3])
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

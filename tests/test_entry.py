"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["records_view", "fold_assign", "block_union_rank", "weighted_jaccard", "group_context", "rule_expected_f05", "grid_plateau", "blend_best_strictness", "twin_pool_noisy_or", "recall_by_cap", "sibling_check", "auc_by_feature", "lineitem_cumsum"]


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if v[i] is None else round(float(v[i]), 6) if isinstance(v[i], (int, float)) else v[i] for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) >= 70 and set(sql) <= set(q)

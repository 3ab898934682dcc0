"""Every query with a SQL twin against DuckDB, and every other one for rows."""

import duckdb
import pandas as pd
import pytest

from equilens.plans import registry
from equilens.sources.tables import TABLES

DIR = "/root/testdata/sf0.01"


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object and df[c].map(lambda x: hasattr(x, "tolist") or isinstance(x, list)).any():
            df[c] = df[c].map(str)
        elif pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool:
            df[c] = df[c].astype(float).round(5)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    assert len(got)
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        pd.testing.assert_frame_equal(tidy(got), tidy(con.sql(sql).df()), check_dtype=False, atol=2e-5)


@pytest.mark.parametrize("name", ["feature_distributions", "rule_task_framing"])
def test_twins_on_many_documents_of_few_lengths(spark, tmp_path, name):
    # every group has 20 rows of each class, and the lengths repeat, 16 of them equally often
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, '' AS text, ['de', 'en', 'fr'][i % 3 + 1] AS lang, 's' || (i % 2) AS source, CAST(i // 3 % 16 AS INT) * 7 AS n_chars FROM range(1440) t(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT i AS doc_id, CAST(i // 6 % 2 AS INT) AS quality, CAST(i // 12 % 2 AS INT) AS toxic FROM range(1440) t(i)) TO '{tmp_path}/labels.parquet'")
    con.execute(f"COPY (SELECT * FROM '{DIR}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    for t in ("documents", "labels", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    assert len(want) == (17 if name == "feature_distributions" else 1)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, atol=2e-5)


def test_pivot_means_that_lie_half_way_go_up(spark):
    from equilens.operators import experiments as E

    rows = [("m", "A", x / 0.4, 0.0, 0.0, 0.0) for x in (0.531307, 0.570089, 0.514902, 0.579965, 0.567539, 0.591737)] + [("none", "A", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "mitigation string, dataset string, f1 double, recall double, accuracy double, auc double")
    got = {r.mitigation: r.score_a for r in E.pivot_score(df, "mitigation", ["A"]).collect()}
    assert got == {"m": 0.559257, "none": None}  # 559256.5 millionths; added as floats it is less in any order

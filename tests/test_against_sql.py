"""Registered queries on odd inputs against their own SQL."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def shown(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


def test_improvement_of_missing_values(spark, tmp_path):
    """The SQL of c37 is infinite wherever the tax is not above its limit, also if a value is missing."""
    cases = [("0.05D", "NULL"), ("NULL", "0D"), ("NULL", "NULL"), ("NULL", "0.04D"), ("0.05D", "0D"), ("0.05D", "0.001D"), ("0.05D", "-1D"), ("0.05D", "0.04D"), ("0D", "0.04D")]
    values = ", ".join(f"({i}L, {i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(cases))
    spark.sql(f"SELECT * FROM VALUES {values} AS t(l_orderkey, l_linenumber, l_discount, l_tax)").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries()["c37_improvement"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "factor").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert shown(got) == shown(con.execute(oracle_sql()["c37_improvement"]).fetchall())

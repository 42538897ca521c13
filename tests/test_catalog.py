import duckdb
import pytest

from fpspark.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    sql = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})")
    assert plain(frame.select(*columns).collect()) == plain(sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

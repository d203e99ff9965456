"""Registered queries against their SQL, on the smallest tables and on odd texts."""

import pytest
from llm.conftest import DOCUMENTS

from tunetally.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


def compared(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'" if folder != DATA
                    else f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=str)
    con.close()
    df = Q.QUERIES[name](spark, folder)
    assert set(names) == set(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want
    return want


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compared(spark, name, DATA)


@pytest.mark.parametrize("name", ["base_secrets", "base_quality_counts"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    """Matches side by side, at both ends, with failing ones between, and beyond ASCII."""
    hexes = "0123456789abcdef" * 2
    texts = [
        None, "", " ", "\n\n", hexes, f"é{hexes}😀 {hexes}g{hexes}", f"token={hexes}", f"TOKEN: '{hexes}' secret = \"short\"",
        "AKIA" + "A" * 14 + "AKIA" + "B" * 13, "AKIAAKIA" + "C" * 16 + " AKIAshort", "api_key:" + "x" * 12 + " apikey=" + "y" * 11,
        "a b c d e f g h " * 9, "one\none\n one\n\n\none", "x\ty\x0bz # $ % & | < > *\r\n" * 30, "é 😀 ñ " * 40,
        " ".join(f"w{k}" for k in range(200)), "same same same same same same same same same " + "z" * 3000,
    ]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(compared(spark, name, str(tmp_path))) == len(texts)

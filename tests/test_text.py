"""Upper case as DuckDB has it."""

from __future__ import annotations

import sys

import duckdb
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions.text import capitals


def test_capitals_of_all_characters(spark):
    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["".join(every[i : i + 5000]) for i in range(0, len(every), 5000)]
    con = duckdb.connect()
    want = {t: con.execute("select upper(?)", [t]).fetchone()[0] for t in texts}
    got = {r["t"]: r["u"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", capitals(F.col("t")).alias("u")).collect()}
    assert got == want


def test_write_back_of_text_with_sharp_s(spark, tmp_path):
    rows = [(1, 0, "Straße ŉ ﬁ ᾳ ǆ"), (1, 1, None), (1, 2, ""), (2, 0, "heiß"), (2, 1, "groß"), (3, 0, "ß")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = {r[:2]: r[2] for r in con.execute(catalogue.ORACLE_SQL["nested_write_back"]).fetchall()}
    got = {(r["conv_id"], r["turn"]): r["text"] for r in catalogue.QUERIES["nested_write_back"](spark, str(tmp_path)).collect()}
    assert got == want

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabulon.operators import arrays, lookup
from tabulon.operators.criteria import criterion
from tabulon.operators.grouping import database, groupby
from tabulon.sources.xlsx import read_xlsx, sheet_table, workbook_bytes
from tabulon.streaming.changes import RevisionConflict, Session


def test_entry_and_queries_have_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["groupby_subtotals", "pivotby", "xlookup_next_smaller", "xlookup_next_larger", "unique", "mmult_gram", "incremental_batch", "fn_datedif", "agg_sumifs", "db_dsum", "rank_eq", "trend", "trend_origin", "growth", "hlookup"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    key = lambda r: tuple((x is None, str(x)) for x in r)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_criteria(spark):
    df = spark.createDataFrame([("5", 5.0), ("Apple", 1.0), (None, None), ("", 2.0), ("a*b", 3.0)], "t string, n double")
    count = lambda *c: df.where(criterion(*c)).count()
    assert count("t", "5") == 1 and count("t", "app?e") == 1 and count("t", "a~*b") == 1 and count("t", "") == 2 and count("t", "<>apple") == 4
    assert count("n", ">=2") == 3 and count("n", 5) == 1 and count("n", "<>5") == 4 and count("n", None) == 1


def test_lookup_first_last_missing(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "A", 20), (3, "b", 30), (4, None, 40)], "o int, k string, v int")
    probes = spark.createDataFrame([(1, "A"), (2, "z"), (3, None)], "id int, p string")
    get = lambda **k: {r["id"]: r["v"] for r in lookup.xlookup(probes, "p", table, "k", ["v"], "o", **k).collect()}
    assert get() == {1: 10, 2: None, 3: None}
    assert get(search=-1, missing=-1) == {1: 20, 2: -1, 3: -1}


def test_asof_over_ranges(spark):
    table = spark.range(0, 1000, 10).select(F.col("id").cast("double").alias("k"), F.col("id").alias("v"))
    probes = spark.range(-5, 1005).select("id", F.col("id").cast("double").alias("p"))
    got = {r["id"]: r["__v"] for r in lookup.asof(probes, "p", table, "k", "v", True, 7).collect()}
    assert got == {i: (min(i // 10 * 10, 990) if i >= 0 else None) for i in range(-5, 1005)}
    up = {r["id"]: r["__v"] for r in lookup.asof(probes, "p", table, "k", "v", False, 7).collect()}
    assert up == {i: (max(0, -(-i // 10) * 10) if i <= 990 else None) for i in range(-5, 1005)}


def test_groupby_keeps_first_label_and_blanks(spark):
    df = spark.createDataFrame([(1, "East", 1.0), (2, "EAST", 2.0), (3, None, 4.0)], "o int, r string, v double")
    got = {(r["r"], r["level"]): r["s"] for r in groupby(df, ["r"], {"s": F.sum("v")}, order="o").collect()}
    assert got == {("East", 0): 3.0, (None, 0): 4.0, (None, 1): 7.0}


def test_database_block(spark):
    df = spark.createDataFrame([("Alice", 10.0), ("Bob", 20.0), ("Alfred", 30.0)], "Name string, Amount double")
    assert database(df, "DSUM", "Amount", [{"Name": "Al", "Amount": ">20"}, {"Name": "Bob"}]).first()[0] == 50.0
    assert database(df, "DSUM", "Amount", [{}]).first()[0] == 60.0
    assert database(df, "DGET", "Amount", [{"Name": "Al"}]).first()[0] is None


def test_matrix(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0)], "i long, j long, v double")
    product = {(r["i"], r["j"]): round(r["v"], 9) for r in arrays.mmult(a, arrays.minverse(a)).collect()}
    assert product == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 1.0}


def test_xlsx_round_trip(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes({"Data": (["name", "n"], [("x<y", 1.5), ("ü", 2), (None, 3)]), "F": (["f"], [("=SUM(A1:A2)",), (True,)])}))
    cells = read_xlsx(spark, str(tmp_path))
    rows = sheet_table(cells, "Data", {1: ("name", "string"), 2: ("n", "double")}).orderBy("row").collect()
    assert [(r["name"], r["n"]) for r in rows] == [("x<y", 1.5), ("ü", 2.0), (None, 3.0)]
    assert {r["formula"] for r in cells.where("sheet = 'F'").collect()} == {None, "=SUM(A1:A2)"}


def test_session_is_as_a_full_calculation(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "id long, g string, v double")
    total = lambda df: df.groupBy("g").agg(F.sum("v").alias("s"))
    session = Session(table, "id", ["g"], total, f"file://{tmp_path}")
    changes = spark.createDataFrame([(1, "b", 5.0, "set", 1), (3, "b", 0.0, "clear", 2), (4, "c", 7.0, "set", 3)], "id long, g string, v double, op string, change_id long")
    assert {(r["g"], r["change"], r["s"]) for r in session.preview(changes).collect()} == {("a", "changed", 2.0), ("b", "changed", 5.0), ("c", "added", 7.0)}
    session.apply(changes, expected=0)
    assert {tuple(r) for r in session.results.collect()} == {tuple(r) for r in total(session.table).collect()} == {("a", 2.0), ("b", 5.0), ("c", 7.0)}
    with pytest.raises(RevisionConflict):
        session.apply(changes, expected=0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "o int, k string, v double")
    assert groupby(empty, ["k"], {"s": F.sum("v")}, depth=0).count() == 0
    assert lookup.xlookup(empty, "k", empty, "k", ["v"], "o").count() == 0
    assert arrays.unique(empty, ["k"], "o").count() == 0


def test_rank_trend_and_hlookup_edges(spark):
    from tabulon.operators.ranks import rank, trend

    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([3, 1, None, 3, 3, 2, 1])], "id long, v double")
    assert [r["rank"] for r in rank(df, "v").orderBy("id").collect()] == [1, 5, None, 1, 1, 4, 5]
    assert [r["rank"] for r in rank(df, "v", ascending=True, ranges=2).orderBy("id").collect()] == [4, 1, None, 4, 4, 3, 1]
    assert rank(df.limit(0), "v").count() == 0
    line = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0), (None, 9.0), (3.0, None)], "x double, y double")
    assert [round(r["trend"], 6) if r["trend"] is not None else None for r in trend(line, "y", ["x"]).orderBy(F.col("x").asc_nulls_last()).collect()] == [1, 3, 5, 7, None]
    assert {r["trend"] for r in trend(line.withColumn("y", F.col("y") - 1), "y", ["x"], growth=True).collect()} == {None}  # y of 0 has no logarithm
    wide = spark.createDataFrame([(1, "a", "B", "b"), (2, "1", "2", "3")], "n long, p string, q string, r string")
    probes = spark.createDataFrame([("A",), ("b",), ("c",), (None,)], "k string")
    assert {r["k"]: r["value"] for r in lookup.hlookup(probes, "k", wide, 2, "n", approximate=False).collect()} == {"A": "1", "b": "2", "c": None, None: None}
    assert {r["value"] for r in lookup.hlookup(probes, "k", wide, 3, "n").collect()} == {None}


def test_next_smaller_and_larger_with_more_probes_than_a_range_sample(spark):
    probes = spark.range(0, 150_000, 1, 6).select("id", (F.col("id") * 7919 % 150_001).cast("double").alias("k"))
    table = spark.createDataFrame([(1, 40.0), (2, 75_000.0), (3, 140_000.0)], "o int, v double").withColumn("found", F.col("v"))
    smaller = lookup.xlookup(probes, "k", table, "v", ["found"], "o", match=-1)
    assert smaller.where("not found <=> case when k >= 140000 then 140000 when k >= 75000 then 75000 when k >= 40 then 40 end").count() == 0
    larger = lookup.xlookup(probes, "k", table, "v", ["found"], "o", match=1)
    assert larger.where("not found <=> case when k <= 40 then 40 when k <= 75000 then 75000 when k <= 140000 then 140000 end").count() == 0
    texts = lookup.xlookup(probes.select("id", F.lpad(F.col("k").cast("long").cast("string"), 6, "0").alias("t")), "t", table.select("o", F.lit("075000").alias("v")), "v", ["o"], "o", match=-1)
    assert texts.where("not o <=> case when t >= '075000' then 1 end").count() == 0 and texts.count() == 150_000

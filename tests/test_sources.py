import pytest
from pyspark.sql import functions as F

from greenframe.plans import compare, execute, export
from greenframe.sources import files, naming, tables


@pytest.mark.parametrize("name, clean", [
    ("Hours-per-Week", "hours_per_week"), ("1st", "col_1st"), ("_1a", "1a"), ("%%%", "col_unknown"), ("", "col_unknown"),
    ("Alk  Phosphate", "alk_phosphate"), ("Città", "citt"),
])
def test_names(name, clean):
    assert naming.normalize_name(name) == clean


def test_colliding_names_get_a_number(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["A b", "a_b", "a-b", "a_b_2"])
    assert naming.normalize_columns(df).columns == ["a_b", "a_b_3", "a_b_4", "a_b_2"]
    assert naming.safe_table_name("_my table!") == "my_table" and naming.safe_table_name("!!") == "table_unnamed"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_read_delimited(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Id;Na me;Score;Ok;Day;Empty\n1;"multi\nline; ""q""";1.5;True;2024-01-01;\n2;NA;2;False;2024-01-02;\n')
    df = files.read_delimited(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "na_me": "string", "score": "double", "ok": "boolean", "day": "string", "empty": "double"}
    rows = df.orderBy("id").collect()
    assert rows[0]["na_me"] == 'multi\nline; "q"' and rows[1]["na_me"] is None and rows[1]["score"] == 2.0
    assert files.read_delimited(spark, path, normalize=False).columns[1] == "Na me"


def test_other_encodings(spark, tmp_path):
    path = write(tmp_path / "l.csv", "a;b\n1;è\n", "latin-1")
    assert files.read_delimited(spark, path).first()["b"] == "è"


def test_bad_files_fail(spark, tmp_path):
    with pytest.raises(Exception):
        files.read_delimited(spark, write(tmp_path / "bad.csv", "a;b\n1;2;3\n"))
    with pytest.raises(ValueError):
        files.read_delimited(spark, write(tmp_path / "empty.csv", "a;b\n"))


@pytest.mark.parametrize("text, sep", [("a,b,c\n1,2,3\n", ","), ("a;b\n1,5;2\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b|c\n1|2|3\n", "|"), ("a\n1\n", None)])
def test_sniff(spark, tmp_path, text, sep):
    assert files.sniff_delimiter(spark, write(tmp_path / "s.csv", text)) == sep


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x;"y"\nz'), (2, None)], "id long, t string")
    files.write_dataset(df, str(tmp_path / "c"), "csv")
    back = files.read_delimited(spark, str(tmp_path / "c"))
    assert compare.results_equivalent(df, back)
    files.write_dataset(df, str(tmp_path / "p"), "parquet")
    assert compare.results_equivalent(df, files.read_parquet(spark, str(tmp_path / "p")))
    with pytest.raises(ValueError):
        files.write_dataset(df, str(tmp_path / "x"), "excel")


def test_spreading_keeps_rows(spark, folder):
    whole = files.read_parquet(spark, f"{folder}/orders.parquet")
    dealt = files.read_parquet(spark, f"{folder}/orders.parquet", spread=True)
    assert dealt.rdd.getNumPartitions() == 8 and compare.results_equivalent(whole, dealt)


def test_flatten_telemetry(spark):
    text = '{"timestamp":"2024-01-01T00:00:00Z","cpu":{"percent":50.0,"power_w":32.5},"ram":{"percent":10}}'
    row = files.flatten_telemetry(spark.createDataFrame([(1, text)], "id int, sample string"), "sample").first().asDict()
    assert row["cpu.percent"] == 50.0 and row["gpu.power_w"] == 0.0 and row["ram.percent"] == 10.0


def test_collections(spark, tmp_path):
    a, b = spark.range(3).toDF("x"), spark.createDataFrame([(1, 2)], ["x", "y"])
    both = tables.select_columns_across({"a": a, "b": b}, ["y"])
    assert list(both) == ["b"] and both["b"].columns == ["y"]
    assert set(tables.select_columns_across({"a": a, "b": b})) == {"a", "b"}
    merged = tables.add_tables({"a": a}, {"a": b}, "keep_both")
    assert set(merged) == {"a", "a_2"} and merged["a"] is a
    assert tables.add_tables({"a": a}, {"a": b}, "replace")["a"] is b
    assert tables.add_tables({"a": a}, {"a": b}, "ignore")["a"] is a
    broken = a.select(F.raise_error(F.lit("no")).alias("z"))
    outcome = tables.save_tables({"bad": broken, "my table": a}, folder=str(tmp_path))
    assert outcome["bad"] and outcome["my_table"] is None
    assert tables.load_folder(spark, str(tmp_path), ["my_table"])["my_table"].count() == 3
    assert len(tables.previews({"a": a}, 2)["a"].collect()) == 2


def test_empty_database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS hollow")
    with pytest.raises(ValueError):
        tables.load_database(spark, "hollow")


def test_sql_errors_are_text(spark):
    assert execute.run_sql(spark, "  ").error and execute.run_sql(spark, None).error
    assert execute.run_sql(spark, "SELECT nope FROM nowhere").error
    good = execute.run_sql(spark, "SELECT id FROM range(4);")
    assert good.error is None and good.rows == 4


def test_workload_goes_on_after_a_failure(spark):
    results = execute.run_workload([(1, "SELECT * FROM range(5)", "X"), (2, "SELEC", "X"), (3, "SELECT raise_error('x') FROM range(2)", "X")], spark)
    rows = {r["query_id"]: r for r in results.collect()}
    assert rows["1"]["rows"] == 5 and rows["1"]["error"] is None and rows["1"]["latency_s"] > 0
    assert rows["2"]["error"] and rows["3"]["error"] and rows["3"]["rows"] == 0


def test_equivalence(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "a int, b string")
    assert compare.results_equivalent(a, a.select("b", "a"))
    assert not compare.results_equivalent(a, a.distinct())
    assert not compare.results_equivalent(a, a.withColumnRenamed("b", "c"))


def test_export(spark, folder, tmp_path):
    from datetime import datetime

    made = tables.load_folder(spark, folder, ["supplier", "nation"])
    queue = spark.createDataFrame([(1, "s_name", "{}")], "s_suppkey long, column string, row_data string")
    written = export.export_profile(spark, {**made, "none": made["nation"].filter("false")}, str(tmp_path), datetime(2024, 1, 1), queues={"supplier": queue})
    assert set(written) == {"supplier", "nation"} and "imputation_queue.json" in written["supplier"]
    metrics = spark.read.json(f"{tmp_path}/supplier/metrics.json").first()
    assert metrics["rows"] == made["supplier"].count() and metrics["cols"] == 4
    assert spark.read.option("header", True).csv(f"{tmp_path}/nation/profiling/anomalies.csv").count() == 3


def test_temporary_views_are_no_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS holding")
    spark.sql("DROP TABLE IF EXISTS holding.kept")
    spark.range(3).write.saveAsTable("holding.kept")
    spark.range(5).createOrReplaceTempView("kept")
    found = tables.load_database(spark, "holding")
    assert list(found) == ["kept"] and found["kept"].count() == 3
    spark.catalog.dropTempView("kept")


def test_a_folder_is_listed(spark, folder, tmp_path):
    assert {"region", "lineitem", "documents"} <= set(tables.load_folder(spark, folder))
    with pytest.raises(ValueError):
        tables.load_folder(spark, str(tmp_path))


def test_files_are_split_unless_a_line_ends_inside_quotes(spark, tmp_path, monkeypatch):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text("a;b\n" + "".join(f'{i};"x;""y{i}"\n' for i in range(5000)))
    broken.write_text("a;b\n" + "".join(f'{i};"x\ny{i}"\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        split, whole = files.read_delimited(spark, str(plain)), files.read_delimited(spark, str(broken))
        assert split.rdd.getNumPartitions() > 3 and whole.rdd.getNumPartitions() == 1
        assert split.count() == whole.count() == 5000
        assert {r["b"] for r in split.filter("a = 7").collect()} == {'x;"y7'} and {r["b"] for r in whole.filter("a = 7").collect()} == {"x\ny7"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")

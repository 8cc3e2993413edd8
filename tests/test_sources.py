import pytest
from pyspark.sql import types as T

from platewise.sources import tables as IO


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_tsv_types_nan_and_inf(spark, tmp_path):
    write(tmp_path / "t.txt", "id\tx\ty\nA\t1.5\t1\nB\tnan\t2\nC\tinf\t\nD\t-inf\t4\n")
    df = IO.read_tsv(spark, str(tmp_path / "t.txt"))
    assert [f.dataType for f in df.schema.fields] == [T.StringType(), T.DoubleType(), T.IntegerType()]
    assert [r["x"] for r in df.collect()] == [1.5, None, float("inf"), float("-inf")]


def test_csv_columns_and_line_break_in_header(spark, tmp_path):
    write(tmp_path / "t.csv", '"A \nCount",b,c\n1,2,x\n')
    df = IO.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert df.columns[0].replace("\n", " ") == "A  Count" and df.count() == 1
    assert IO.read_csv(spark, str(tmp_path / "t.csv"), ["c"], multi_line=True).columns == ["c"]


def test_workers_combine_by_name(spark, tmp_path):
    write(tmp_path / "w1" / "Cells.txt", "a\tb\n1\t2.5\n")
    write(tmp_path / "w 2" / "Cells.txt", "b\ta\n3.5\t4\n")
    write(tmp_path / "w3" / "Cells.txt", "a\tc\n5\tx\n")
    write(tmp_path / "w4" / "Other.txt", "a\n9\n")
    got = {r["Subfolder"]: (r["a"], r["b"], r["c"]) for r in IO.combine_instances(spark, str(tmp_path), "Cells.txt").collect()}
    assert got == {"w1": (1, 2.5, None), "w 2": (4, 3.5, None), "w3": (5, None, "x")}
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    typed = IO.combine_instances(spark, str(tmp_path), "Cells.txt", schema)
    assert typed.schema["a"].dataType == T.LongType() and typed.count() == 3
    with pytest.raises(FileNotFoundError):
        IO.combine_instances(spark, str(tmp_path), "None.txt")


def test_files_of_many_layouts_meet_by_name(spark, tmp_path):
    write(tmp_path / "a+b" / "t.txt", 'id\tx\tnote\n1\t1.5\t"tab\there"\nid\t2\tid\n')
    write(tmp_path / "two" / "t.txt", "note\tid\nshort\nplain\t7\textra\n")
    write(tmp_path / "three" / "t.txt", "x\tflag\tx\ninf\ttrue\t1\nnan\tfalse\t2\n")
    write(tmp_path / "empty" / "t.txt", "")
    write(tmp_path / "bare" / "t.txt", "id\tx\tnote\n")
    df = IO.combine_instances(spark, str(tmp_path), "t.txt")
    got = {tuple(r[c] for c in ("Subfolder", "id", "x", "note", "flag", "x0", "x2")) for r in df.collect()}
    assert got == {
        ("a+b", "1", 1.5, "tab\there", None, None, None), ("a+b", "id", 2.0, "id", None, None, None),
        ("two", None, None, "short", None, None, None), ("two", "7", None, "plain", None, None, None),
        ("three", None, None, None, True, float("inf"), 1), ("three", None, None, None, False, None, 2),
    }
    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType())])
    typed = IO.combine_instances(spark, str(tmp_path), "t.txt", kinds)
    assert sorted((r["id"] for r in typed.collect()), key=str) == [1, 7, None, None, None, None]


def test_scan_glob_flat_and_recursive(spark, tmp_path):
    write(tmp_path / "s_D1.txt", "a\n1\n")
    write(tmp_path / "deep" / "s_D5.txt", "a\n2\n")
    write(tmp_path / "skip.csv", "a\n3\n")
    flat = IO.scan_glob(spark, str(tmp_path), "*.txt")
    assert [(r["a"], r["subset"]) for r in flat.collect()] == [(1, "s_D1")]
    assert {r["subset"] for r in IO.scan_glob(spark, str(tmp_path), "*.txt", recursive=True).collect()} == {"s_D1", "s_D5"}


def test_lookup_header_and_lists(spark, tmp_path):
    write(tmp_path / "l.tsv", "# note\nfeature\tcategory\torganelle\na\t\tNuclei\n1\tTexture\t\n")
    got = [tuple(r) for r in IO.read_lookup(spark, str(tmp_path / "l.tsv")).collect()]
    assert got == [("a", "", "Nuclei"), ("1", "Texture", "")]
    write(tmp_path / "h.txt", "x\ty \tx\n1\t2\t3\n")
    assert [tuple(r) for r in IO.read_header(spark, str(tmp_path / "h.txt")).collect()] == [(0, "x"), (1, "y"), (2, "x")]
    df = spark.createDataFrame([("b",), (" a ",), ("",)], "f string")
    IO.write_list(df, str(tmp_path / "list"))
    assert {r["feature"] for r in IO.read_list(spark, str(tmp_path / "list")).collect()} == {"a", "b"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("D1", 2, 1.5), ("D5", 3, None)], "day string, c int, x double")
    IO.write_partitioned(df, str(tmp_path / "p"), ["day", "c"])
    assert spark.read.parquet(str(tmp_path / "p")).where("day = 'D5'").first()["c"] == 3
    IO.write_tsv(df, str(tmp_path / "t"))
    assert {tuple(r) for r in IO.read_tsv(spark, str(tmp_path / "t")).collect()} == {("D1", 2, 1.5), ("D5", 3, None)}


def test_guessing_casts_only_what_looks_like_a_number(spark, tmp_path):
    """A cast that fails costs an error in the task, and every value was cast to all kinds."""
    kept = ["1", " 7", "+3", "2147483648", "99999999999999999999", "-1.5", ".5", "1e5", "1d", "inf", "-Infinity", "NaN", "0x1p3"]
    lost = ["", "D1", "1_2", "1e", "+", ".", "1.5.2", "nand", "0x1"]
    df = spark.createDataFrame([(v,) for v in kept + lost], "v string")
    for kind in (T.IntegerType(), T.LongType(), T.DoubleType()):
        got = df.select(IO._as(df.v, kind).alias("a"), df.v.try_cast(kind).alias("b")).collect()
        assert [str(r["a"]) for r in got] == [str(r["b"]) for r in got]
    looks = df.where(df.v.rlike(IO._REAL)).collect()
    assert {r["v"] for r in looks} == set(kept)


def test_worker_folder_of_a_long_path(spark, tmp_path):
    """The folder is cut out of the path; a pattern over the whole path took most of the query's time."""
    deep = tmp_path / ("a" * 120) / ("b" * 120)
    write(deep / "w+1" / "t.txt" / "part-0.csv", "a\n1\n")
    write(deep / "w 2" / "t.txt" / "part-0.csv", "a\n2\n")
    df = IO.combine_parts(spark, str(deep), "t.txt")
    assert {(r["Subfolder"], r["a"]) for r in df.collect()} == {("w+1", 1), ("w 2", 2)}
    assert "regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString()

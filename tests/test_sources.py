from datetime import datetime

import pytest

from tableprofile.functions.columns import type_labels
from tableprofile.operators.summary import field_summary
from tableprofile.sources.nested import flatten
from tableprofile.sources.readers import read_any, read_csv, read_sql, read_xml
from tableprofile.sources.sinks import Session, export_raw, restore_session, save_session, write_csv


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_csv_types_and_missing_values(spark, tmp_path, rows):
    path = _file(tmp_path, "t.csv", "\n".join([
        "a,b,c,d,e,f", "1,1.5,True,2024-01-05,x,1d", "NA,2,False,2024-02-01,None,2", "3,n/a,True,,\"say \"\"hi\"\"\",3",
        ",-nan,null,NULL,#N/A,<NA>"]))
    df = read_any(spark, path)
    assert type_labels(df) == {"a": "int", "b": "float", "c": "bool", "d": "string", "e": "string", "f": "string"}
    assert rows(df, "a", "b", "c") == sorted(
        [(1, 1.5, True), (None, 2.0, False), (3, None, True), (None, None, None)], key=repr)
    assert {r.e for r in df.collect()} == {"x", 'say "hi"', None}
    nulls = {r.field: r.nulls for r in field_summary(df).collect()}
    assert nulls == {"a": 2, "b": 2, "c": 1, "d": 2, "e": 2, "f": 1}


def test_csv_big_integers_and_empty_column(spark, tmp_path):
    df = read_csv(spark, _file(tmp_path, "t.csv", "a,b\n99999999999999999999,\n1,\n"))
    assert type_labels(df) == {"a": "float", "b": "float"}


def test_json_array_single_and_lines(spark, tmp_path, rows):
    one = '{"id": 1, "p": {"q": {"r": "x"}, "s": 2}, "l": [1, null, 3], "b": [true, false]}'
    two = '{"id": 2, "p": {"s": 5}, "l": []}'
    pretty = '{\n "id": 1,\n "p": {"q": {"r": "x"}, "s": 2}\n}\n'
    for name, text in (("a.json", f"[{one},\n{two}]"), ("l.json", f"{one}\n{two}\n"), ("l.jsonl", f"{one}\n{two}\n")):
        df = read_any(spark, _file(tmp_path, name, text))
        assert sorted(df.columns) == ["b", "id", "l", "p.q.r", "p.s"]
        assert rows(df, "id", "`p.q.r`", "`p.s`", "l", "b") == sorted(
            [(1, "x", 2, "1|None|3", "True|False"), (2, None, 5, "", None)], key=repr)
        assert {r.field for r in field_summary(df).collect()} == set(df.columns)
    single = read_any(spark, _file(tmp_path, "s.json", pretty))
    assert rows(single, "id", "`p.q.r`", "`p.s`") == [(1, "x", 2)]


def test_flatten_lists_of_objects(spark):
    df = spark.createDataFrame([([{"a": 1}],)], "l array<struct<a:int>>")
    assert flatten(df).first().l == '{"a":1}'


def test_xml(spark, tmp_path, rows):
    path = _file(tmp_path, "t.xml", """<?xml version="1.0"?>
<root><rec id="7"><a>1</a><a>2</a><b>x</b></rec><rec><b>y</b><n><m>deep</m></n></rec><other>5</other></root>""")
    for df in (read_any(spark, path), read_xml(spark, path, ["rec", "other"])):
        assert sorted(df.columns) == ["a", "b", "n", "other"]
        assert rows(df, "a", "b", "n", "other") == sorted(
            [("2", "x", None, None), (None, "y", None, None), (None, None, None, "5")], key=repr)


def test_sql_and_unknown_suffix(spark):
    assert read_sql(spark, "SELECT 1 AS a UNION ALL SELECT 2").count() == 2
    with pytest.raises(ValueError):
        read_any(spark, "table.xlsx")


def test_csv_export_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, ["a", "b"], 'q"1'), (2, [], None)], "id int, found array<string>, s string")
    write_csv(df, str(tmp_path / "out.csv"), single_file=True)
    back = read_csv(spark, str(tmp_path / "out.csv"))
    assert rows(back, "id", "found", "s") == sorted([(1, "a, b", 'q"1'), (2, None, None)], key=repr)


def test_raw_export(spark, tmp_path, rows):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice", "'x' AS s")
    path = export_raw(df, ["id", "s"], str(tmp_path), "numbers", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("numbers-raw-data-export-20240102_030405.csv")
    back = read_csv(spark, path)
    assert back.columns == ["id", "s"] and back.count() == 100


def test_session_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, None), (2, "b")], "id int, s string")
    session = Session(["id"], ["France"], ["EMEA"], ["GDPR"], ["HR"], {"Product": ["widget", "ring"]})
    path = save_session(df, session, str(tmp_path), "t", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("t_20240102_030405")
    table, restored = restore_session(spark, path)
    assert restored == session and rows(table) == rows(df)


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('id,note\n1,"first line\nsecond ""line"""\n2,plain\n')
    assert [tuple(r) for r in read_any(spark, str(path)).orderBy("id").collect()] == [(1, 'first line\nsecond "line"'), (2, "plain")]


def test_reading_keeps_partitions_even(spark):
    """A constant first column doesn't draw the rows into one partition."""
    df = spark.createDataFrame([(1, i) for i in range(1000)], "k int, v int").repartition(4)
    from tableprofile.operators.filters import apply_filters
    sizes = [len(p) for p in apply_filters(df, {}).rdd.glom().collect()]
    assert max(sizes) < 2 * min(sizes)

"""Reading and writing files, packages, streams and databases."""

import csv
import datetime as dt
import decimal
import hashlib
import importlib
import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.functions.text import Template, python_text, python_time_pattern
from millrace.schema import infer_type
from millrace.sources import ejson
from millrace.sources.load import distinct_headers, infer_text


def rows(*steps, index=0):
    return m.Flow(*steps).results()[0][index]


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def test_csv_types_comments_and_strip(spark, put):
    path = put("ages.csv", "made by hand\n\nname,age,when,score\n Ann ,31,2020-01-02,1.5\nBo,,2020-01-03,2\n")
    assert rows(m.load(path)) == [{"name": "Ann", "age": 31, "when": dt.date(2020, 1, 2), "score": 1.5}, {"name": "Bo", "age": None, "when": dt.date(2020, 1, 3), "score": 2.0}]
    assert rows(m.load(path, infer_strategy=m.INFER_STRINGS))[0]["age"] == "31"
    assert rows(m.load(path, cast_strategy=m.CAST_TO_STRINGS))[1]["when"] == "2020-01-03"
    assert len(rows(m.load(path, limit_rows=1))) == 1


def test_csv_quotes_and_blank_headers(spark, put):
    path = put("q.csv", 'a,,b\n"x, ""y""",drop,1\n\nz,,2\n')
    assert rows(m.load(path)) == [{"a": 'x, "y"', "b": 1}, {"a": "z", "b": 2}]


def test_duplicate_headers(spark, put):
    path = put("d.csv", "h,h,H\n1,2,3\n")
    with pytest.raises(m.ProcessorError):
        m.Flow(m.load(path)).results()
    assert rows(m.load(path, deduplicate_headers=True)) == [{"h (1)": 1, "h (2)": 2, "H": 3}]
    assert distinct_headers(["h", "h", "H"], True, False, "_%s") == ["h_1", "h_2", "H_3"]


def test_missing_values_and_overrides(spark, put):
    path = put("m.csv", "x,y\n1,-\nN/A,2\n")
    out = rows(m.load(path, override_schema={"missingValues": ["", "-", "N/A"]}, override_fields={"x": {"type": "integer"}, "y": {"type": "integer"}}, extract_missing_values=True))
    assert out == [{"x": 1, "y": None, "missingValues": {"y": "-"}}, {"x": None, "y": 2, "missingValues": {"x": "N/A"}}]


def test_tsv_env_and_json(spark, put, monkeypatch):
    path = put("t.tsv", "a\tb\n1\tx\n")
    monkeypatch.setenv("A_SOURCE", path)
    assert rows(m.load("env://A_SOURCE")) == [{"a": 1, "b": "x"}]
    assert rows(m.load(put("j.json", '[{"name": "A", "age": 3, "tags": [1, 2]}, {"name": "B", "age": null, "tags": []}]'))) == [{"name": "A", "age": 3, "tags": [1, 2]}, {"name": "B", "age": None, "tags": []}]
    assert rows(m.load(put("n.ndjson", '{"b": 1, "a": "x"}\n{"b": 2, "a": "y"}\n'))) == [{"b": 1, "a": "x"}, {"b": 2, "a": "y"}]


def test_xml_spreadsheet_geojson(spark, put):
    assert rows(m.load(put("s.xml", "<root><books><book id='1'><title>T1</title><year>1999</year></book><book id='2'><title>T2</title><year>2001</year></book></books></root>"))) == [
        {"id": 1, "title": "T1", "year": 1999},
        {"id": 2, "title": "T2", "year": 2001},
    ]
    sheet = '<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet><Table>'
    sheet += '<Row><Cell><Data>a</Data></Cell><Cell><Data>b</Data></Cell></Row><Row><Cell ss:Index="2"><Data>7</Data></Cell></Row></Table></Worksheet></Workbook>'
    assert rows(m.load(put("x.xml", sheet), format="excel-xml", infer_strategy=m.INFER_STRINGS)) == [{"a": "", "b": "7"}]
    feature = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [3.5, 2]}}]}
    out = rows(m.load(put("g.geojson", json.dumps(feature))))
    assert out[0]["id"] == 1 and out[0]["__geometry"]["coordinates"] == [3.5, 2]


def test_errors_name_the_source(spark):
    with pytest.raises(m.ProcessorError) as e:
        m.Flow(m.load("/nowhere/at/all.csv")).results()
    assert "/nowhere/at/all.csv" in str(e.value)


DATA = [{"s": 'a"b,c', "n": 1, "f": 1.0, "b": True, "d": dt.date(2020, 1, 2), "t": dt.datetime(2020, 1, 2, 3, 4), "o": {"k": [1]}}, {"s": None, "n": None, "f": 2.5, "b": False, "d": None, "t": None, "o": None}]


def test_csv_round_trip_with_counters(spark, tmp_path):
    package, stats = m.Flow(DATA, m.update_package(name="p"), m.dump_to_path(str(tmp_path / "out"))).process()
    data = (tmp_path / "out" / "res_1.csv").read_bytes()
    assert stats["count_of_rows"] == 2 and stats["bytes"] == len(data) and stats["dataset_name"] == "p" and b"\r\n" in data
    parsed = list(csv.reader(io.StringIO(data.decode(), newline="")))
    assert parsed[1] == ['a"b,c', "1", "1.0", "True", "2020-01-02", "2020-01-02T03:04:00", '{"k": [1]}'] and parsed[2][0] == ""
    assert rows(m.load(str(tmp_path / "out" / "datapackage.json"))) == [{**DATA[0]}, {**DATA[1]}]


def test_json_geojson_and_titles(spark, tmp_path):
    m.Flow([{"b": 1, "a": "x"}], m.dump_to_path(str(tmp_path), format="json")).process()
    assert json.loads((tmp_path / "res_1.json").read_text()) == [{"a": "x", "b": 1}]
    m.Flow([{"p": "10, 20", "a": 1}], m.set_type("p", type="geopoint"), m.dump_to_path(str(tmp_path), format="geojson")).process()
    made = json.loads((tmp_path / "res_1.geojson").read_text())
    assert made["features"][0]["geometry"]["coordinates"] == [10.0, 20.0] and made["features"][0]["properties"] == {"a": 1}
    m.Flow([{"a": 1}], m.set_type("a", title="Alpha"), m.dump_to_path(str(tmp_path), use_titles=True)).process()
    assert (tmp_path / "res_1.csv").read_text().startswith("Alpha")


def test_temporal_format_zip_and_hash_paths(spark, tmp_path):
    m.Flow([{"d": dt.date(2020, 1, 2)}], m.set_type("d", shown="%d/%m/%Y"), m.dump_to_path(str(tmp_path), temporal_format_property="shown", add_filehash_to_path=True)).process()
    described = json.loads((tmp_path / "datapackage.json").read_text())["resources"][0]
    assert (tmp_path / described["path"]).read_text().split() == ["d", "02/01/2020"] and described["hash"] in described["path"]
    m.Flow([{"x": 1}], m.dump_to_zip(str(tmp_path / "z.zip"))).process()
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert sorted(z.namelist()) == ["datapackage.json", "res_1.csv"]


def test_parquet_sink(spark, tmp_path):
    package, _ = m.Flow([{"x": i} for i in range(5)], m.dump_to_path(str(tmp_path), format="parquet")).process()
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "res_1")).collect()) == list(range(5))


def test_sql_modes(spark, tmp_path):
    engine = f"sqlite:///{tmp_path}/db.sqlite"
    spec = lambda mode: {"t": {"resource-name": "res_1", "mode": mode, "update_keys": ["k"]}}
    first = [{"k": 1, "v": "a", "o": {"x": 1}}, {"k": 2, "v": "b", "o": None}]
    m.Flow(first, m.dump_to_sql(spec("rewrite"), engine)).process()
    m.Flow([{"k": 3, "v": "c", "o": None}], m.dump_to_sql(spec("append"), engine)).process()
    out = rows([{"k": 1, "v": "A", "o": None}, {"k": 9, "v": "z", "o": None}], m.dump_to_sql(spec("update"), engine, updated_column="u"))
    assert [r["u"] for r in out] == [True, False]
    with sqlite3.connect(tmp_path / "db.sqlite") as db:
        assert db.execute("SELECT k, v FROM t ORDER BY k").fetchall() == [(1, "A"), (2, "b"), (3, "c"), (9, "z")]
    assert [r["k"] for r in rows(m.load(engine, table="t", order_by="k"))] == [1, 2, 3, 9]
    with pytest.raises(m.ProcessorError):
        m.Flow(m.load(engine)).results()


def test_workbooks(spark, tmp_path):
    data = [{"s": "a<b", "n": 1, "f": 1.5, "b": True, "d": dt.date(2020, 1, 2)}, {"s": None, "n": None, "f": None, "b": None, "d": None}]
    m.Flow(data, m.dump_to_path(str(tmp_path), format="xlsx")).process()
    m.Flow([{"x": 1}], m.update_resource(-1, path="res_1.csv"), m.dump_to_path(str(tmp_path), format="xlsx", sheetname="other", update_existing=True)).process()
    out = rows(m.load(str(tmp_path / "res_1.xlsx")))
    assert out[0] == data[0] and len(out) == 1  # a row without any value is left out
    assert rows(m.load(str(tmp_path / "res_1.xlsx"), sheet=2)) == [{"x": 1}]


def test_questionnaire_writes_a_flow(spark, tmp_path, put):
    from millrace.cli import main

    answers = iter([put("a.csv", "x,y\n2,b\n1,a\n"), "", "data", "x > 0", "x", "json", str(tmp_path / "out"), "y"])
    assert main(["init", str(tmp_path / "flow.py")], lambda _: next(answers)) == 0
    assert json.loads((tmp_path / "out" / "a.json").read_text()) == [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}]
    assert main([]) == 2


def test_stream_round_trip(spark, tmp_path):
    path = str(tmp_path / "s.ndjson")
    m.Flow(DATA, [{"z": 1}], m.stream(path)).results()
    out, package, _ = m.Flow(m.unstream(path)).results()
    assert out == [DATA, [{"z": 1}]] and package.names == ["res_1", "res_2"]


def test_ejson():
    value = {"d": decimal.Decimal("1.50"), "t": dt.time(1, 2), "w": dt.datetime(2020, 1, 2, 3), "x": dt.date(2020, 1, 2), "u": dt.timedelta(hours=2), "s": {1, 2}}
    assert ejson.loads(ejson.dumps(value)) == value


def test_inference():
    assert infer_type([1, None, 2]) == "integer" and infer_type([1, "a"]) == "any" and infer_type([None]) == "any" and infer_type([True]) == "boolean"
    assert [infer_text(v) for v in (["1", ""], ["1.5"], ["2020-01-02"], ["x"], ["true", "False"], ["10:00:00"], ["2020-01-02T10:00:00"])] == ["integer", "number", "date", "string", "boolean", "time", "datetime"]


def test_text_of_floats_as_python_writes_it(spark):
    values = [0.0, 1.0, -2.5, 1e7, 123456789.125, 1e15, 1e16, 1.5e20, 1e-4, 0.00025, 1e-5, -3.25e-10, 1e100, 12345678.9, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(python_text(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [str(v) for v in values]


def test_templates_and_patterns():
    assert Template("{a:02d}-{b}").fields == ["a", "b"]
    assert python_time_pattern("%d/%m/%Y T%H") == "dd/MM/yyyy 'T'HH"


def test_events_stream_like_batches(spark, tmp_path):
    """The windowed aggregates give the same rows on a stream as on a table."""
    from millrace.streaming import windowed

    source = spark.createDataFrame([(dt.datetime(2020, 1, 1, h, mi), k) for h in range(3) for mi in (0, 10, 50) for k in "ab"], "ts timestamp, k string")
    source.write.parquet(str(tmp_path / "in"))
    make = lambda df: windowed(df, "ts", "1 hour", ["k"], {"n": F.count(F.lit(1))})
    q = make(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, make(source).collect()))


def test_folder_of_csv_files_with_comments(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text(f"a title\n\nk,v\n{k},x{k}\n{k + 10},y\n")
    out = rows(m.load(str(tmp_path), format="csv"))
    assert sorted((r["k"], r["v"]) for r in out) == sorted((k + 10 * j, "y" if j else f"x{k}") for k in range(3) for j in (0, 1))


def test_csv_files_are_split_unless_texts_hold_line_breaks(spark, put):
    plain = m.Flow(m.load(put("p.csv", "a,b\n1,x\n"))).plan().resources[0].rows
    assert "multiLine" not in plain._jdf.queryExecution().optimizedPlan().toString() or "true" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert rows(m.load(put("q.csv", 'a,b\n1,"x\ny"\n2,z\n'))) == [{"a": 1, "b": "x\ny"}, {"a": 2, "b": "z"}]


def test_codec_reads_zones_and_durations():
    there = dt.timezone(dt.timedelta(hours=-3), "X")
    for v in (dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(2020, 1, 2, 3, 4, 5, 60, there), dt.timedelta(days=2, hours=5, seconds=1.5), -dt.timedelta(minutes=3), dt.timedelta(0), dt.time(1, 2, 3)):
        assert ejson.loads(ejson.dumps({"v": v})) == {"v": v}
    assert ejson.loads('{"v": {"type{datetime}": ["2020-01-02T03:04:05", null, null]}}') == {"v": dt.datetime(2020, 1, 2, 3, 4, 5)}
    assert ejson.loads('{"v": {"type{duration}": "P1DT2H"}}') == {"v": dt.timedelta(days=1, hours=2)}
    assert ejson.loads('{"v": {"type{duration}": "P1Y"}}') == {"v": {"type{duration}": "P1Y"}}


def test_unknown_strategies_are_errors(spark, put):
    with pytest.raises(ValueError):
        m.load(put("a.csv", "a\n1\n"), infer_strategy="all")


def test_validator_options_of_sinks(spark, tmp_path):
    m.Flow([{"v": "1"}, {"v": "x"}], m.update_schema(None, fields=[{"name": "v", "type": "integer"}]), m.dump_to_path(str(tmp_path), validator_options={"on_error": m.drop})).process()
    assert (tmp_path / "res_1.csv").read_bytes() == b"v\r\n1\r\n"


STREAM = importlib.import_module("millrace.sources.stream")


@pytest.fixture
def no_rows_to_driver(spark, monkeypatch):
    def fail(*_, **__):
        raise AssertionError("rows come through the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", fail)
    monkeypatch.setattr(STREAM, "from_rows", fail)


def test_stream_and_unstream_leave_rows_to_tasks(spark, tmp_path, no_rows_to_driver):
    path = str(tmp_path / "s.ndjson")
    df = spark.range(1000, numPartitions=7).select(F.col("id"), F.concat(F.lit("é\r\n"), "id").alias("s"))
    m.Flow(m.load(df, name="a"), m.load(df.limit(0), name="b"), m.load(df.limit(1), name="c"), m.stream(path)).process()
    assert sorted(x.name for x in tmp_path.iterdir()) == ["s.ndjson"]
    lines = (tmp_path / "s.ndjson").read_text(encoding="utf-8").split("\n")
    assert [i for i, x in enumerate(lines) if not x] == [1001, 1002, 1004, 1005]
    assert [json.loads(x)["id"] for x in lines[1:1001]] == list(range(1000))
    out = m.Flow(m.unstream(path)).results()[0]
    assert out[0] == [{"id": i, "s": f"é\r\n{i}"} for i in range(1000)] and out[1:] == [[], [{"id": 0, "s": "é\r\n0"}]]


HEAD = json.dumps({"name": "p", "resources": [{"name": n, "schema": {"fields": [{"name": "k", "type": "integer"}]}} for n in "abc"]})


@pytest.mark.parametrize("split", [1, 5, 9, 1000])
@pytest.mark.parametrize("text", [
    '{"k": 1}\n{"k": 22}\n\n\n{"k": 3}\n\nbehind\n', '{"k": 1}\r\n{"k": 22}\r\n\r\n  \r\n{"k": 3}', '{"k": 1}\r{"k": 22}\r\r\r{"k": 3}\r\r{"k": 4}', '{"k": 1}\n{"k": 22}\n\n\n{"k": 3}\n',
])
def test_resources_of_a_stream_end_at_blank_lines(spark, tmp_path, monkeypatch, split, text):
    """Whatever the breaks of lines and wherever tasks' bytes end, rows are those of a file read line by line."""
    monkeypatch.setattr(STREAM, "SPLIT", split)
    (tmp_path / "s").write_bytes((HEAD + text[text.index("}") + 1 : text.index("{", 2)] + text).encode())
    for source in (tmp_path / "s", open(tmp_path / "s", encoding="utf-8")):  # noqa: SIM115
        out, package, _ = m.Flow(m.unstream(source)).results()
        assert out == [[{"k": 1}, {"k": 22}], [], [{"k": 3}]] and package.metadata == {"name": "p"}


def test_streams_of_handles_and_over_their_own_source(spark, tmp_path):
    path, out = tmp_path / "s.ndjson", io.StringIO()
    m.Flow(DATA, m.stream(path)).process()
    m.Flow(DATA, m.stream(out)).process()
    assert out.getvalue() == path.read_text(encoding="utf-8")
    change = lambda row: {**row, "n": (row["n"] or 0) + 1}
    assert [r["n"] for r in rows(m.unstream(path), change, m.stream(path))] == [2, 1] == [r["n"] for r in rows(m.unstream(path))]


def test_text_sinks_leave_rows_to_tasks(spark, tmp_path, no_rows_to_driver):
    """Whole files in order, with the counts, whatever the partitions; a line break within a text stays."""
    df = spark.range(1000, numPartitions=7).filter("id < 300 OR id >= 600").select("id", F.concat(F.lit('é"\n'), "id").alias("s"))
    wanted = [{"id": i, "s": f'é"\n{i}'} for i in range(1000) if not 300 <= i < 600]
    read = {
        "csv": lambda text: [{"id": int(a), "s": b} for a, b in list(csv.reader(io.StringIO(text, newline="")))[1:]],
        "json": json.loads,
        "geojson": lambda text: [x["properties"] for x in json.loads(text)["features"]],
    }
    for form, parse in read.items():
        _, stats = m.Flow(m.load(df, name="a"), m.load(df.limit(0), name="b"), m.dump_to_path(str(tmp_path / form), format=form)).process()
        data = [(tmp_path / form / f"{n}.{form}").read_bytes() for n in "ab"]
        described = json.loads((tmp_path / form / "datapackage.json").read_text())["resources"]
        assert [parse(x.decode()) for x in data] == [wanted, []]
        assert [(x["count_of_rows"], x["bytes"], x["hash"]) for x in described] == [(n, len(x), hashlib.md5(x).hexdigest()) for n, x in zip((700, 0), data, strict=True)]
        assert stats["count_of_rows"] == 700 and len(list((tmp_path / form).iterdir())) == 3
    m.Flow(m.load(df, name="a"), m.dump_to_zip(str(tmp_path / "z.zip"))).process()
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.read("a.csv") == (tmp_path / "csv" / "a.csv").read_bytes()


def test_sinks_where_tasks_share_no_folder(spark, tmp_path, monkeypatch):
    """The same files by the driver's hand."""
    m.Flow(DATA, m.dump_to_path(str(tmp_path / "a")), m.stream(tmp_path / "a.ndjson")).process()
    parts = importlib.import_module("millrace.sources.parts")
    monkeypatch.setattr(parts, "in_reach", lambda *_: False)
    monkeypatch.setattr(STREAM, "in_reach", lambda *_: False)
    m.Flow(DATA, m.dump_to_path(str(tmp_path / "b")), m.stream(tmp_path / "b.ndjson")).process()
    for module in (parts, STREAM):
        monkeypatch.setattr(module, "shared_path", lambda _: None)
    m.Flow(DATA, m.dump_to_path(str(tmp_path / "c")), m.stream(tmp_path / "c.ndjson")).process()
    for x in "bc":
        assert (tmp_path / x / "res_1.csv").read_bytes() == (tmp_path / "a" / "res_1.csv").read_bytes() and (tmp_path / f"{x}.ndjson").read_bytes() == (tmp_path / "a.ndjson").read_bytes()
        assert rows(m.unstream(tmp_path / f"{x}.ndjson")) == DATA


def test_temporal_formats_leave_rows_to_tasks(spark, tmp_path, no_rows_to_driver):
    df = spark.range(500, numPartitions=5).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    m.Flow(m.load(df, name="a"), m.set_type("d", shown="%d/%m/%Y"), m.dump_to_path(str(tmp_path), temporal_format_property="shown")).process()
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(500)]
    assert (tmp_path / "a.csv").read_bytes().decode().split("\r\n") == ["d", *[f"{d:%d/%m/%Y}" for d in days], ""]
    assert json.loads((tmp_path / "datapackage.json").read_text())["resources"][0]["schema"]["fields"][0]["format"] == "%d/%m/%Y"

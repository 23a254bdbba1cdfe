"""Queries for sources, sinks, casts, error policies, metadata and control: written, read back, and compared with the tables."""

from __future__ import annotations

import os
import uuid
import warnings
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

import millrace as m

from ..staging import shared_dir
from .queries import flow, query, table


def _place(spark) -> str:
    """A new folder; single-file sinks write from the driver."""
    path = f"{shared_dir(spark).removeprefix('file://')}/millrace-queries-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _put(spark, name: str, text: str) -> str:
    path = f"{_place(spark)}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _dumped(spark, sf_dir, name: str, form: str, **options) -> str:
    """A table's file."""
    place = _place(spark)
    m.Flow(table(sf_dir, name), m.dump_to_path(place, format=form, **options)).plan(spark=spark)
    return f"{place}/{name}.{form}"


# sources

_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("SELECT * FROM (VALUES (1, 'x', 1.5), (2, NULL, 2.5), (3, 'z', NULL)) t(a, b, c)")
def load_iterable(spark, sf_dir):
    return flow(spark, [{"a": 1, "b": "x", "c": 1.5}, {"a": 2, "b": None, "c": 2.5}, {"a": 3, "b": "z", "c": None}])


@query("SELECT * FROM (VALUES (1, 'x'), (2, 'y')) t(a, b)")
def load_descriptor_and_rows(spark, sf_dir):
    schema = {"fields": [{"name": "a", "type": "integer"}, {"name": "b", "type": "string"}]}
    descriptor = {"name": "p", "resources": [{"name": "one", "path": "one.csv", "schema": schema}, {"name": "two", "path": "two.csv", "schema": schema}]}
    return flow(spark, m.load((descriptor, [iter([{"a": 9, "b": "z"}]), iter([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}])]), resources="two"))


@query("SELECT r_regionkey, r_name FROM region")
def load_env(spark, sf_dir):
    os.environ["MILLRACE_QUERY_SOURCE"] = f"{sf_dir}/region.parquet"
    return flow(spark, m.load("env://MILLRACE_QUERY_SOURCE", name="region"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def load_package(spark, sf_dir):
    place = _place(spark)
    m.Flow(table(sf_dir, "customer"), table(sf_dir, "region"), m.dump_to_path(place)).plan(spark=spark)
    return flow(spark, m.load(f"{place}/datapackage.json", resources="customer"))


@query(_NATION)
def load_zipped_package(spark, sf_dir):
    path = f"{_place(spark)}/all.zip"
    m.Flow(table(sf_dir, "nation"), m.dump_to_zip(path)).plan(spark=spark)
    return flow(spark, m.load(path))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def load_csv(spark, sf_dir):
    return flow(spark, m.load(_dumped(spark, sf_dir, "orders", "csv"), name="orders"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def load_csv_folder(spark, sf_dir):
    """Files of a folder, each with its header."""
    path = f"{_place(spark)}/customers"
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal").repartition(3, "c_custkey").write.option("header", True).csv(path)
    return flow(spark, m.load(path, format="csv"))


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def load_csv_comments(spark, sf_dir):
    """Lines before the header, a quoted line break, another separator."""
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    lines = ["made by hand", "", "k;name;note", *(f'{r[0]}; {r[1]} ;"a\nb"' for r in rows)]
    return flow(spark, m.load(_put(spark, "regions.csv", "\n".join(lines)), multiline=True), m.select_fields(["k", "name"]))


@query(_SUPPLIER)
def load_tsv(spark, sf_dir):
    path = f"{_place(spark)}/t.tsv"
    spark.read.parquet(f"{sf_dir}/supplier.parquet").coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
    return flow(spark, m.load(path, format="tsv"))


@query(_SUPPLIER)
def load_json(spark, sf_dir):
    return flow(spark, m.load(_dumped(spark, sf_dir, "supplier", "json")))


@query("SELECT event_id, user_id, event_type, value FROM events")
def load_ndjson(spark, sf_dir):
    path = f"{_place(spark)}/events.ndjson"
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value").write.json(path)
    return flow(spark, m.load(path, format="ndjson"))


@query(_NATION)
def load_workbook(spark, sf_dir):
    return flow(spark, m.load(_dumped(spark, sf_dir, "nation", "xlsx")))


@query(_NATION)
def load_xml(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    body = "".join(f"<nation><n_nationkey>{r[0]}</n_nationkey><n_name>{escape(r[1])}</n_name><n_regionkey>{r[2]}</n_regionkey></nation>" for r in rows)
    return flow(spark, m.load(_put(spark, "nations.xml", f"<nations>{body}</nations>")))


@query(_NATION)
def load_xml_spreadsheet(spark, sf_dir):
    rows = [["n_nationkey", "n_name", "n_regionkey"], *spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    space = "urn:schemas-microsoft-com:office:spreadsheet"
    body = "".join("<Row>" + "".join(f'<Cell><Data ss:Type="String">{escape(str(x))}</Data></Cell>' for x in r) + "</Row>" for r in rows)
    text = f'<Workbook xmlns="{space}" xmlns:ss="{space}"><Worksheet ss:Name="s"><Table>{body}</Table></Worksheet></Workbook>'
    return flow(spark, m.load(_put(spark, "nations.xml", text), format="excel-xml"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def load_sql(spark, sf_dir):
    path = f"sqlite:///{_place(spark)}/db.sqlite"
    m.Flow(table(sf_dir, "supplier"), m.dump_to_sql({"suppliers": {"resource-name": "supplier"}}, engine=path)).plan(spark=spark)
    return flow(spark, m.load(path, query="SELECT s_suppkey, s_name, s_acctbal FROM suppliers WHERE s_acctbal > 0"))


@query("SELECT s_suppkey AS k, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def load_geojson(spark, sf_dir):
    """Points written and read back; coordinates stand as they were given."""
    place = _place(spark)
    point = F.concat_ws(", ", F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string"))
    m.Flow(table(sf_dir, "supplier"), m.add_field("p", "string", point), m.set_type("p", type="geopoint"), m.select_fields(["s_suppkey", "p"]), m.dump_to_path(place, format="geojson")).plan(spark=spark)
    at = lambda i: F.get_json_object("__geometry", f"$.coordinates[{i}]").cast("double")
    return flow(spark, m.load(f"{place}/supplier.geojson")).select(F.col("s_suppkey").alias("k"), at(0).alias("x"), at(1).alias("y"))


@query("SELECT p_partkey, p_name FROM part")
def load_orc(spark, sf_dir):
    path = f"{_place(spark)}/part.orc"
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").write.orc(path)
    return flow(spark, m.load(path, format="orc"))


_ODD = "key,amount,name\n1,-, a \n2,7,b\n3,N/A,c\n"


@query("SELECT * FROM (VALUES ('1', NULL, 'a', '{\"amount\":\"-\"}'), ('2', 7, 'b', '{}'), ('3', NULL, 'c', '{\"amount\":\"N/A\"}')) t(key, amount, name, \"missingValues\")")
def load_overrides_and_missing_values(spark, sf_dir):
    fields = {"amount": {"type": "integer"}, "key": {"type": "string"}}
    return flow(spark, m.load(_put(spark, "odd.csv", _ODD), override_schema={"missingValues": ["", "-", "N/A"]}, override_fields=fields, extract_missing_values=True))


@query("SELECT * FROM (VALUES ('1', '-', 'a'), ('2', '7', 'b')) t(key, amount, name)")
def load_strings_and_limit(spark, sf_dir):
    return flow(spark, m.load(_put(spark, "odd.csv", _ODD), infer_strategy="strings", cast_strategy="strings", limit_rows=2))


@query("SELECT * FROM (VALUES (1, 2, 3)) t(\"h (1)\", \"h (2)\", k)")
def load_duplicate_headers(spark, sf_dir):
    return flow(spark, m.load(_put(spark, "dup.csv", "h,h,k\n1,2,3\n"), deduplicate_headers=True))


# sinks and streams


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def dump_temporal_format(spark, sf_dir):
    place = _place(spark)
    day = m.set_type("day", type="date", on_error=m.clear, outputFormat="%d/%m/%Y")
    m.Flow(
        table(sf_dir, "orders"), m.add_field("day", "string", F.date_format("o_orderdate", "yyyy-MM-dd")), m.select_fields(["o_orderkey", "day"]), day,
        m.dump_to_path(place, temporal_format_property="outputFormat"),
    ).plan(spark=spark)
    return flow(spark, m.load(f"{place}/orders.csv", infer_strategy="strings", override_fields={"o_orderkey": {"type": "integer"}}))


@query("SELECT c_custkey AS \"Customer\", c_name AS \"Name\" FROM customer")
def dump_titles(spark, sf_dir):
    place = _place(spark)
    m.Flow(
        table(sf_dir, "customer"), m.select_fields(["c_custkey", "c_name"]), m.update_schema(None, fields=[{"name": "c_custkey", "title": "Customer"}, {"name": "c_name", "title": "Name"}]),
        m.dump_to_path(place, use_titles=True),
    ).plan(spark=spark)
    return flow(spark, m.load(f"{place}/customer.csv"))


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer")
def dump_counters(spark, sf_dir):
    """What the descriptor counts, at places of the caller's choice."""
    place = _place(spark)
    m.Flow(table(sf_dir, "customer"), m.dump_to_path(place, counters={"resource-rowcount": "stats.rows", "resource-hash": None})).plan(spark=spark)
    return spark.read.json(f"{place}/datapackage.json", multiLine=True).select(F.explode("resources").alias("r")).select("r.name", "r.stats.rows")


@query("SELECT 'r' || r_regionkey || ' ' || r_name AS value FROM region")
def dump_own_format(spark, sf_dir):
    place = _place(spark)
    lines = {"txt": lambda rows, schema: (f"r{row['r_regionkey']} {row['r_name']}\n" for row in rows)}
    m.Flow(table(sf_dir, "region"), m.dump_to_path(place, format="txt", file_formatters=lines)).plan(spark=spark)
    return spark.read.text(f"{place}/region.txt")


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_tax FROM lineitem")
def dump_parquet(spark, sf_dir):
    place = _place(spark)
    m.Flow(table(sf_dir, "lineitem"), m.select_fields(["l_orderkey", "l_linenumber", "l_shipdate", "l_tax"]), m.dump_to_path(place, format="parquet")).plan(spark=spark)
    return flow(spark, m.load(f"{place}/datapackage.json"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dump_sql_append(spark, sf_dir):
    path = f"sqlite:///{_place(spark)}/db.sqlite"
    for _ in range(2):
        m.Flow(table(sf_dir, "nation"), m.dump_to_sql({"n": {"resource-name": "nation", "mode": "append"}}, engine=path)).plan(spark=spark)
    return flow(spark, m.load(path, table="n"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def dump_sql_update(spark, sf_dir):
    path = f"sqlite:///{_place(spark)}/db.sqlite"
    first = m.select_fields(["n_nationkey", "n_name"])
    m.Flow(table(sf_dir, "nation"), first, m.dump_to_sql({"n": {"resource-name": "nation"}}, engine=path)).plan(spark=spark)
    change = m.add_field("n_name", "string", F.concat(F.upper("n_name"), F.lit("!")))
    m.Flow(
        table(sf_dir, "nation"), m.filter_rows(F.col("n_regionkey") == 1), change, first, m.dump_to_sql({"n": {"resource-name": "nation", "mode": "update", "update_keys": ["n_nationkey"]}}, engine=path)
    ).plan(spark=spark)
    return flow(spark, m.load(path, table="n"))


@query("SELECT event_id, ts, user_id, value FROM events")
def stream_and_unstream(spark, sf_dir):
    path = f"{_place(spark)}/s.ndjson"
    m.Flow(table(sf_dir, "events"), m.select_fields(["event_id", "ts", "user_id", "value"]), m.stream(path)).plan(spark=spark)
    return flow(spark, m.unstream(path))


@query("SELECT r_regionkey, r_name FROM region")
def printer(spark, sf_dir):
    return flow(spark, table(sf_dir, "region"), m.printer(num_rows=2, table_print=lambda *_: None))


# joins


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def join_self(spark, sf_dir):
    return flow(spark, table(sf_dir, "lineitem"), m.join_self("lineitem", ["l_returnflag"], "flags", {"l_returnflag": {}, "n": {"aggregate": "count"}}))


def _with_flag(spark, sf_dir, full):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        return flow(
            spark, table(sf_dir, "orders"), m.filter_rows(F.col("o_totalprice") > 300000), table(sf_dir, "customer"), m.select_fields(["c_custkey"], resources="customer"),
            m.join("orders", ["o_custkey"], "customer", ["c_custkey"], {"n": {"aggregate": "count"}}, full=full),
        )


@query("SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY ALL) ON c_custkey = o_custkey")
def join_full_flag(spark, sf_dir):
    return _with_flag(spark, sf_dir, True)


@query("SELECT o_custkey AS c_custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 GROUP BY ALL")
def join_not_full_flag(spark, sf_dir):
    return _with_flag(spark, sf_dir, False)


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def join_keeping_the_source(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "region"), table(sf_dir, "nation"), m.join("region", ["r_regionkey"], "nation", ["n_regionkey"], {"r_name": {"aggregate": "max"}}, source_delete=False),
        m.delete_fields(["r_name"], resources="nation"), m.concatenate({"name": ["n_name", "r_name"]}),
    )


@query(
    "WITH s AS (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 300000 GROUP BY ALL), t AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_acctbal > 5000) "
    "SELECT coalesce(c_custkey, CAST(o_custkey AS VARCHAR)) AS c_custkey, c_name, orders FROM t FULL JOIN s ON c_custkey = CAST(o_custkey AS VARCHAR)"
)
def join_full_outer_mixed_keys(spark, sf_dir):
    """Whole numbers against texts: keys meet by their text forms, and added rows have the source's."""
    return flow(
        spark, table(sf_dir, "orders"), m.filter_rows(F.col("o_totalprice") > 300000),
        table(sf_dir, "customer"), m.filter_rows(F.col("c_acctbal") > 5000, resources="customer"), m.add_field("c_custkey", "string", F.col("c_custkey").cast("string"), resources="customer"),
        m.select_fields(["c_custkey", "c_name"], resources="customer"), m.join("orders", ["o_custkey"], "customer", ["c_custkey"], {"orders": {"aggregate": "count"}}, mode="full-outer"),
    )


# metadata


@query(_NATION)
def delete_resource(spark, sf_dir):
    return flow(spark, table(sf_dir, "nation"), table(sf_dir, "region"), m.delete_resource("region"))


def _facts(spark, facts):
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "name string, value string")


@query("SELECT * FROM (VALUES ('name', 'tables'), ('title', 'All')) t(name, value)")
def update_package(spark, sf_dir):
    return _facts(spark, m.Flow(table(sf_dir, "region"), m.update_package(name="tables"), m.add_metadata(title="All", resources=[])).plan(spark=spark).metadata)


@query("SELECT * FROM (VALUES ('name', 'places'), ('title', 'Regions')) t(name, value)")
def update_resource(spark, sf_dir):
    r = m.Flow(table(sf_dir, "region"), m.update_resource("region", name="places", title="Regions")).plan(spark=spark).resources[0]
    return _facts(spark, {"name": r.name, "title": r.properties["title"]})


@query("SELECT * FROM (VALUES ('r_regionkey', 'Key'), ('missing', '-'), ('primary', 'r_regionkey')) t(name, value)")
def update_schema(spark, sf_dir):
    s = m.Flow(table(sf_dir, "region"), m.update_schema("region", missingValues=["-"], primaryKey="r_regionkey", fields=[{"name": "r_regionkey", "title": "Key"}])).plan(spark=spark).resources[0].schema
    return _facts(spark, {"r_regionkey": s.field("r_regionkey")["title"], "missing": s.missing_values[0], "primary": s.primary_key[0]})


@query("SELECT * FROM (VALUES ('rows', '5'), ('seen', 'True')) t(name, value)")
def update_stats_and_finalizer(spark, sf_dir):
    seen: dict = {}
    _, stats = m.Flow(table(sf_dir, "region"), m.update_stats({"rows": 5}), m.finalizer(lambda stats: seen.update(stats))).process()
    return _facts(spark, {"rows": stats["rows"], "seen": seen == stats})


# row functions beside the computed operations


@query("SELECT l_orderkey, l_linenumber, l_linenumber + l_quantity AS x, l_orderkey + l_linenumber AS y FROM lineitem")
def computed_types(spark, sf_dir):
    """A sum is a number where any of its sources is, else of the first one's type."""
    specs = [{"target": "x", "operation": "sum", "source": ["l_linenumber", "l_quantity"]}, {"target": "y", "operation": "sum", "source": ["l_orderkey", "l_linenumber"]}]
    return flow(spark, table(sf_dir, "lineitem"), m.add_computed_field(specs), m.select_fields(["l_orderkey", "l_linenumber", "x", "y"]))


@query("SELECT n_nationkey, n_name FROM nation")
def strip_texts(spark, sf_dir):
    padded = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.lit(" \t"), "n_name", F.lit("\u00a0 ")).alias("n_name"))
    return flow(spark, m.load(padded, name="nation", strip=True))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def stringify(spark, sf_dir):
    return flow(spark, table(sf_dir, "supplier", cast_strategy="strings"), m.select_fields(["s_suppkey", "s_name"]))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_dates(spark, sf_dir):
    return flow(spark, table(sf_dir, "orders"), m.add_field("day", "string", F.date_format("o_orderdate", "dd.MM.yy")), m.set_type("day", type="date", format="%d.%m.%y"), m.select_fields(["o_orderkey", "day"]))


@query("SELECT o_orderkey, strftime(o_orderdate, 'on %Y, %j') AS label FROM orders")
def format_dates(spark, sf_dir):
    from ..functions.text import python_time_pattern

    return flow(spark, table(sf_dir, "orders"), m.add_field("label", "string", F.date_format("o_orderdate", python_time_pattern("on %Y, %j"))), m.select_fields(["o_orderkey", "label"]))


@query("SELECT r_regionkey, '{\"k\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS whole FROM region")
def encode_json(spark, sf_dir):
    return flow(spark, table(sf_dir, "region"), m.add_field("whole", "object", F.to_json(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))), m.select_fields(["r_regionkey", "whole"]))


@query("SELECT n_regionkey, n_nationkey, n_name AS name FROM nation")
def decode_json(spark, sf_dir):
    """Objects as rows see them: a row function reads their members."""

    def open_(row):
        row["name"] = row["whole"]["name"]

    whole = F.to_json(F.struct(F.col("n_name").alias("name")))
    return flow(spark, table(sf_dir, "nation"), m.add_field("whole", "object", whole), m.add_field("name", "string", ""), open_, m.select_fields(["n_regionkey", "n_nationkey", "name"]))


@query("SELECT s_suppkey, round(s_acctbal, 1) AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier")
def geopoints(spark, sf_dir):
    text = F.concat_ws(",", F.round("s_acctbal", 1).cast("string"), F.col("s_nationkey").cast("string"))
    df = flow(spark, table(sf_dir, "supplier"), m.add_field("p", "string", text), m.set_type("p", type="geopoint"))
    return df.select("s_suppkey", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


# casts of every type, and what becomes of values that don't fit

_TEXTS = {
    "number": (["1.5", "-2", "1e3", "x"], "1.5, -2.0, 1000.0, NULL", {}),
    "integer": (["1", "-2", "1.5", "x"], "1, -2, NULL, NULL", {}),
    "boolean": (["true", "0", "False", "x"], "true, false, false, NULL", {}),
    "string": (["a", "", "1", "é"], "'a', NULL, '1', 'é'", {}),
    "date": (["2020-02-29", "2021-02-29", "x", "1999-12-31"], "DATE '2020-02-29', NULL, NULL, DATE '1999-12-31'", {}),
    "datetime": (["2020-02-29T01:02:03", "2020-02-29T25:00:00", "x", "1999-12-31T23:59:59"], "TIMESTAMP '2020-02-29 01:02:03', NULL, NULL, TIMESTAMP '1999-12-31 23:59:59'", {}),
    "year": (["2020", "1999", "x", "0001"], "2020, 1999, NULL, 1", {}),
}


def _cast(kind: str, texts: list[str], options: dict):
    def run(spark, sf_dir):
        rows = [{"i": i, "v": t} for i, t in enumerate(texts)]
        return flow(spark, rows, m.set_type("v", type=kind, on_error=m.clear, **options))

    run.__name__ = f"cast_{kind}"
    return run


for _kind, (_texts, _values, _options) in _TEXTS.items():
    _rows = ", ".join(f"({i}, {v.strip()})" for i, v in enumerate(_values.split(", ")))
    query(f"SELECT * FROM (VALUES {_rows}) t(i, v)")(_cast(_kind, _texts, _options))


@query("SELECT * FROM (VALUES (0, '12:30:00'), (1, NULL)) t(i, v)")
def cast_time(spark, sf_dir):
    df = flow(spark, [{"i": 0, "v": "12:30:00"}, {"i": 1, "v": "x"}], m.set_type("v", type="time", on_error=m.clear))
    return df.select("i", F.col("v").cast("string").alias("v"))


@query("SELECT * FROM (VALUES (0, '[1,2]', '{\"a\":1}'), (1, NULL, NULL)) t(i, a, o)")
def cast_arrays_and_objects(spark, sf_dir):
    rows = [{"i": 0, "a": "[1, 2]", "o": '{"a": 1}'}, {"i": 1, "a": "x", "o": "[1]"}]
    df = flow(spark, rows, m.set_type("a", type="array", on_error=m.clear), m.set_type("o", type="object", on_error=m.clear))
    return df.select("i", *[F.regexp_replace(n, " ", "").alias(n) for n in ("a", "o")])


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 <> 0")
def on_error_drop(spark, sf_dir):
    return _policy(spark, sf_dir, m.drop)


@query("SELECT event_id FROM events")
def on_error_ignore(spark, sf_dir):
    return _policy(spark, sf_dir, m.ignore)


@query("SELECT event_id FROM events WHERE event_id % 2 = 0 OR CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 <> 0")
def on_error_handler(spark, sf_dir):
    """A function of (name, row, index, error) that keeps rows of even ids."""
    return _policy(spark, sf_dir, lambda name, row, index, error: row["event_id"] % 2 == 0)


def _policy(spark, sf_dir, on_error):
    k = F.get_json_object("props", "$.k")
    text = F.when(k.cast("long") % 3 == 0, F.concat(k, F.lit("?"))).otherwise(k)
    return flow(spark, table(sf_dir, "events"), m.add_field("k", "string", text), m.select_fields(["event_id", "k"]), m.set_type("k", type="integer", on_error=on_error), m.select_fields(["event_id"]))


@query("SELECT 'ValidationError' AS error")
def on_error_raise(spark, sf_dir):
    try:
        flow(spark, [{"v": "1"}, {"v": "x"}], m.set_type("v", type="integer")).collect()
        found = "none"
    except Exception as e:  # noqa: BLE001
        found = "ValidationError" if isinstance(e, m.ProcessorError) or "x" in str(e) else type(e).__name__
    return spark.createDataFrame([(found,)], "error string")


# functions, classes and control


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 7")
def rows_function(spark, sf_dir):
    def some(rows):
        for i, row in enumerate(rows):
            if i < 7:
                yield row

    return flow(spark, table(sf_dir, "nation"), m.sort_rows(["n_nationkey"]), some)


@query("SELECT r_regionkey, r_name, 'added' AS note FROM region")
def package_function(spark, sf_dir):
    def add(package):
        yield package.pkg
        for r in package:
            yield r.df.select("r_regionkey", "r_name", F.lit("added").alias("note"))

    return flow(spark, table(sf_dir, "region"), add)


@query("SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation")
def class_processor(spark, sf_dir):
    class Lower(m.Processor):
        resources = "nation"

        def process_row(self, row):
            return {**row, "n_name": row["n_name"].lower()}

    return flow(spark, table(sf_dir, "nation"), Lower())


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def checkpoint(spark, sf_dir):
    """The second run reads what the first one wrote."""
    place = _place(spark)
    steps = lambda: (table(sf_dir, "customer"), m.join_with_self("customer", ["c_nationkey"], {"c_nationkey": {}, "n": {"aggregate": "count"}}), m.checkpoint("c", place))
    flow(spark, *steps())
    return flow(spark, *steps())


@query("SELECT r_regionkey, r_name FROM region")
def command_line(spark, sf_dir):
    """The flow that the command line writes for a source and a target."""
    from ..cli import script

    place = _place(spark)
    code = script({"source": f"{sf_dir}/region.parquet", "name": "region", "target": place, "output": "csv"})
    exec(compile(code, "flow.py", "exec"), {"__name__": "__main__"})  # noqa: S102  our own text
    return flow(spark, m.load(f"{place}/region.csv"))

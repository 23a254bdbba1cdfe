"""One query for each operator, as flows over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace as m

from ..streaming import session_counts, windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(sf_dir: str, name: str, **options) -> m.Step:
    return m.load(f"{sf_dir}/{name}.parquet", name=name, **options)


def flow(spark: SparkSession, *steps) -> DataFrame:
    return m.Flow(*steps).plan(spark=spark).resources[-1].rows


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def flagship(spark, sf_dir):
    fields = {"l_returnflag": {}, "l_linestatus": {}, "sum_qty": {"name": "l_quantity", "aggregate": "sum"}, "avg_price": {"name": "l_extendedprice", "aggregate": "avg"}, "n": {"aggregate": "count"}}
    return flow(spark, table(sf_dir, "lineitem"), m.filter_rows(F.col("l_quantity") > 10), m.join_with_self("lineitem", ["l_returnflag", "l_linestatus"], fields), m.sort_rows(["l_returnflag", "l_linestatus"]))


# columns


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def select_fields(spark, sf_dir):
    return flow(spark, table(sf_dir, "lineitem"), m.select_fields(["l_orderkey", "l_linenumber", "l_quantity"], regex=False))


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")
def select_fields_regex(spark, sf_dir):
    return flow(spark, table(sf_dir, "orders"), m.select_fields(["o_.*key", "o_order(date|priority)"]))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def delete_fields(spark, sf_dir):
    return flow(spark, table(sf_dir, "customer"), m.delete_fields(["c_nationkey", "c_mkt.*"]))


@query("SELECT n_nationkey AS nation_nationkey, n_name AS nation_name, n_regionkey AS nation_regionkey FROM nation")
def rename_fields(spark, sf_dir):
    return flow(spark, table(sf_dir, "nation"), m.rename_fields({r"n_(\w+)": r"nation_\1"}))


@query("SELECT r_regionkey, r_name, 7 AS seven, r_regionkey * 2 AS twice FROM region")
def add_field(spark, sf_dir):
    return flow(spark, table(sf_dir, "region"), m.add_field("seven", "integer", 7), m.add_field("twice", "integer", F.col("r_regionkey") * 2))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _computed(spark, sf_dir, operation, source=_MEASURES):
    spec = {"target": {"name": "x", "type": "number"}, "operation": operation, "source": source}
    return flow(spark, table(sf_dir, "lineitem"), m.add_computed_field(spec), m.select_fields(["l_orderkey", "l_linenumber", "x"]))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_discount + l_tax, 4) AS x FROM lineitem")
def computed_sum(spark, sf_dir):
    return _computed(spark, sf_dir, "sum").withColumn("x", F.round("x", 4))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_extendedprice + l_discount + l_tax) / 4, 4) AS x FROM lineitem")
def computed_avg(spark, sf_dir):
    return _computed(spark, sf_dir, "avg").withColumn("x", F.round("x", 4))


@query("SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_extendedprice, l_discount, l_tax) AS x FROM lineitem")
def computed_max(spark, sf_dir):
    return _computed(spark, sf_dir, "max")


@query("SELECT l_orderkey, l_linenumber, least(l_quantity, l_extendedprice, l_discount, l_tax) AS x FROM lineitem")
def computed_min(spark, sf_dir):
    return _computed(spark, sf_dir, "min")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 4) AS x FROM lineitem")
def computed_multiply(spark, sf_dir):
    return _computed(spark, sf_dir, "multiply", ["l_quantity", "l_discount"]).withColumn("x", F.round("x", 4))


@query("SELECT p_partkey, p_brand || '/' || p_type AS kind, 'part' AS what FROM part")
def computed_join_constant(spark, sf_dir):
    specs = [{"target": "kind", "operation": "join", "source": ["p_brand", "p_type"], "with": "/"}, {"target": "what", "operation": "constant", "with": "part"}]
    return flow(spark, table(sf_dir, "part"), m.add_computed_field(specs), m.select_fields(["p_partkey", "kind", "what"]))


@query("SELECT s_suppkey, s_name || ' (' || CAST(s_nationkey AS VARCHAR) || ')' AS label FROM supplier")
def computed_format(spark, sf_dir):
    return flow(spark, table(sf_dir, "supplier"), m.add_computed_field(target="label", operation="format", **{"with": "{s_name} ({s_nationkey})"}), m.select_fields(["s_suppkey", "label"]))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_type, '[AEIOU]', '*', 'g'), '^(\\w)', '<\\1>', 'g') AS p_type FROM part")
def find_replace(spark, sf_dir):
    patterns = [{"find": "[AEIOU]", "replace": "*"}, {"find": r"^(\w)", "replace": r"<\1>"}]
    return flow(spark, table(sf_dir, "part"), m.find_replace([{"name": "p_type", "patterns": patterns}]), m.select_fields(["p_partkey", "p_type"]))


@query("SELECT event_id, try_cast(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS number FROM events")
def set_type_cast(spark, sf_dir):
    first = F.nullif(F.regexp_extract("props", r"(\d+)", 1), F.lit(""))
    return flow(spark, table(sf_dir, "events"), m.add_field("number", "string", first), m.set_type("number", type="integer", on_error=m.clear), m.select_fields(["event_id", "number"]))


@query("SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS amount FROM lineitem")
def unpivot(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "lineitem"), m.select_fields(["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]),
        m.unpivot([{"name": "l_(quantity|discount|tax)", "keys": {"measure": r"\1"}}], [{"name": "measure", "type": "string"}], {"name": "amount", "type": "number"}),
    )


# rows


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def filter_equals(spark, sf_dir):
    return flow(spark, table(sf_dir, "orders"), m.filter_rows(equals=[{"o_orderstatus": "F"}, {"o_orderpriority": "1-URGENT"}]), m.select_fields(["o_orderkey", "o_orderstatus"]))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def filter_not_equals(spark, sf_dir):
    return flow(spark, table(sf_dir, "orders"), m.filter_rows(not_equals=[{"o_orderstatus": "F"}]), m.select_fields(["o_orderkey", "o_orderstatus"]))


@query("SELECT c_custkey, c_name FROM customer WHERE length(c_name) % 2 = 0 AND c_acctbal > 0")
def filter_callable(spark, sf_dir):
    return flow(spark, table(sf_dir, "customer"), m.filter_rows(lambda row: len(row["c_name"]) % 2 == 0), m.filter_rows(F.col("c_acctbal") > 0), m.select_fields(["c_custkey", "c_name"]))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount <= 0.05")
def validate_drop(spark, sf_dir):
    return flow(spark, table(sf_dir, "lineitem"), m.validate("l_discount", F.col("l_discount") <= 0.05, on_error=m.drop), m.select_fields(["l_orderkey", "l_linenumber", "l_quantity"]))


@query("SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def sort_rows(spark, sf_dir):
    sorted_ = m.Flow(table(sf_dir, "customer"), m.select_fields(["c_custkey", "c_name", "c_acctbal"]), m.sort_rows(["c_acctbal", "c_custkey"])).plan(ordered=True, spark=spark)
    from ..operators.join import numbered

    return numbered(sorted_.resources[0]).df.select("c_custkey", "c_name", "c_acctbal", F.col("__number").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def top_rows(spark, sf_dir):
    return flow(spark, table(sf_dir, "orders"), m.select_fields(["o_orderkey", "o_totalprice"]), m.sort_rows(["o_totalprice", "o_orderkey"], reverse=True), m.limit_rows(25))


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def deduplicate(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "lineitem"), m.select_fields(["l_orderkey", "l_linenumber"]), m.sort_rows(["l_orderkey", "l_linenumber"]), m.set_primary_key(["l_orderkey"]), m.deduplicate()
    )


@query("SELECT DISTINCT user_id, event_type FROM events")
def deduplicate_whole_rows(spark, sf_dir):
    return flow(spark, table(sf_dir, "events"), m.select_fields(["user_id", "event_type"]), m.set_primary_key(["user_id", "event_type"]), m.deduplicate())


@query("SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def concatenate(spark, sf_dir):
    return flow(spark, table(sf_dir, "customer"), table(sf_dir, "supplier"), m.concatenate({"name": ["c_name", "s_name"], "balance": ["c_acctbal", "s_acctbal"]}))


@query("SELECT r_name AS name FROM region UNION ALL SELECT r_name FROM region")
def duplicate(spark, sf_dir):
    return flow(spark, table(sf_dir, "region"), m.duplicate("region", "again"), m.concatenate({"name": ["r_name"]}))


# joins

_TOTALS = {"n_orders": {"aggregate": "count"}, "total": {"name": "o_totalprice", "aggregate": "sum"}}


@query(
    "SELECT c_custkey, c_name, n_orders, round(total, 2) AS total FROM customer LEFT JOIN "
    "(SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"
)
def join_half_outer(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "orders"), table(sf_dir, "customer"), m.select_fields(["c_custkey", "c_name"], resources="customer"), m.join("orders", ["o_custkey"], "customer", ["c_custkey"], _TOTALS)
    ).withColumn("total", F.round("total", 2))


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def join_inner(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "customer"), m.filter_rows(F.col("c_acctbal") > 5000), table(sf_dir, "orders"),
        m.join("customer", ["c_custkey"], "orders", ["o_custkey"], {"c_name": {"aggregate": "max"}}, mode="inner"), m.select_fields(["o_orderkey", "o_totalprice", "c_name"]),
    )


@query(
    "WITH s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY ALL) "
    "SELECT coalesce(n_nationkey, s_nationkey) AS n_nationkey, n_name, suppliers FROM nation FULL JOIN s ON n_nationkey = s_nationkey"
)
def join_full_outer(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "supplier"), table(sf_dir, "nation"), m.select_fields(["n_nationkey", "n_name"], resources="nation"),
        m.join("supplier", ["s_nationkey"], "nation", ["n_nationkey"], {"suppliers": {"aggregate": "count"}}, mode="full-outer"),
    )


@query(
    "WITH s AS (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 300000 GROUP BY ALL), t AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000) "
    "SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, orders FROM t FULL JOIN s ON c_custkey = o_custkey"
)
def join_full_outer_by_balance(spark, sf_dir):
    """Keys without a counterpart on both sides, by conditions on data: orders of other customers, customers without such orders."""
    return flow(
        spark, table(sf_dir, "orders"), m.filter_rows(F.col("o_totalprice") > 300000),
        table(sf_dir, "customer"), m.filter_rows(F.col("c_acctbal") > 5000, resources="customer"), m.select_fields(["c_custkey", "c_name"], resources="customer"),
        m.join("orders", ["o_custkey"], "customer", ["c_custkey"], {"orders": {"aggregate": "count"}}, mode="full-outer"),
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "orders"), m.filter_rows(F.col("o_totalprice") > 300000), table(sf_dir, "customer"), m.join("orders", ["o_custkey"], "customer", ["c_custkey"], {}, mode="inner"), m.select_fields(["c_custkey"])
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, sf_dir):
    return flow(spark, table(sf_dir, "orders"), table(sf_dir, "customer"), m.join("orders", ["o_custkey"], "customer", ["c_custkey"], {}, mode="anti"), m.select_fields(["c_custkey"]))


@query("SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_nationkey = r.r_regionkey")
def join_row_number(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "region"), m.sort_rows(["r_regionkey"]), table(sf_dir, "nation"), m.sort_rows(["n_nationkey"], resources="nation"),
        m.join("region", "{#}", "nation", "{#}", {"r_name": {}}), m.select_fields(["n_nationkey", "n_name", "r_name"]),
    )


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_template_key(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "nation"), table(sf_dir, "supplier"), m.join("nation", "nation-{n_nationkey:03}", "supplier", "nation-{s_nationkey:03}", {"n_name": {"aggregate": "min"}}, mode="inner"),
        m.select_fields(["s_suppkey", "n_name"]),
    )


# groups


def _group(spark, sf_dir, fields):
    return flow(spark, table(sf_dir, "lineitem"), m.sort_rows(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]) if any(f.get("aggregate") in ("first", "last", "any", "array", "counters") for f in fields.values()) else m.update_package(), m.join_with_self("lineitem", ["l_returnflag"], {"l_returnflag": {}, **fields}))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS q, round(avg(l_tax), 6) AS t, min(l_shipdate) AS a, max(l_shipdate) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def group_basic(spark, sf_dir):
    fields = {"q": {"name": "l_quantity", "aggregate": "sum"}, "t": {"name": "l_tax", "aggregate": "avg"}, "a": {"name": "l_shipdate", "aggregate": "min"}, "b": {"name": "l_shipdate", "aggregate": "max"}, "n": {"aggregate": "count"}}
    return _group(spark, sf_dir, fields).withColumns({"q": F.round("q", 2), "t": F.round("t", 6)})


@query("SELECT l_returnflag, median(l_extendedprice) AS middle FROM lineitem GROUP BY ALL")
def group_median(spark, sf_dir):
    return _group(spark, sf_dir, {"middle": {"name": "l_extendedprice", "aggregate": "median"}})


@query(
    "SELECT l_returnflag, first(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS a, last(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS b, "
    "last(l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY ALL"
)
def group_first_last_any(spark, sf_dir):
    return _group(spark, sf_dir, {"a": {"name": "l_partkey", "aggregate": "first"}, "b": {"name": "l_partkey", "aggregate": "last"}, "c": {"name": "l_suppkey"}})


@query("SELECT l_returnflag, '[' || string_agg(DISTINCT '\"' || l_linestatus || '\"', ',' ORDER BY '\"' || l_linestatus || '\"') || ']' AS states FROM lineitem GROUP BY ALL")
def group_set(spark, sf_dir):
    return _group(spark, sf_dir, {"states": {"name": "l_linestatus", "aggregate": "set"}})


@query("SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS keys FROM orders GROUP BY ALL")
def group_array(spark, sf_dir):
    return flow(spark, table(sf_dir, "orders"), m.sort_rows(["o_orderkey"]), m.join_with_self("orders", ["o_custkey"], {"o_custkey": {}, "keys": {"name": "o_orderkey", "aggregate": "array"}}))


@query(
    "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY ALL) "
    "SELECT user_id, '[' || string_agg('[\"' || event_type || '\",' || n || ']', ',' ORDER BY n DESC, o) || ']' AS kinds FROM c GROUP BY ALL"
)
def group_counters(spark, sf_dir):
    return flow(spark, table(sf_dir, "events"), m.sort_rows(["event_id"]), m.join_with_self("events", ["user_id"], {"user_id": {}, "kinds": {"name": "event_type", "aggregate": "counters"}}))


# functions, control, composition


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation")
def row_function(spark, sf_dir):
    def shout(row):
        row["n_name"] = row["n_name"].upper()

    return flow(spark, table(sf_dir, "nation"), shout)


@query("SELECT r_regionkey + 100 AS r_regionkey, r_name FROM region")
def parallelize(spark, sf_dir):
    def shift(row):
        row["r_regionkey"] += 100

    return flow(spark, table(sf_dir, "region"), m.parallelize(shift, 2))


@query("SELECT c_custkey, c_name FROM customer")
def conditional(spark, sf_dir):
    return flow(spark, table(sf_dir, "customer"), m.conditional(lambda p: "c_acctbal" in p.resources[0].schema.names, m.Flow(m.select_fields(["c_custkey", "c_name"]))))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def sources(spark, sf_dir):
    return flow(spark, m.sources(m.Flow(table(sf_dir, "nation")), m.Flow(table(sf_dir, "region"))), m.concatenate({"name": ["n_name", "r_name"]}))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf_dir):
    return flow(spark, table(sf_dir, "events"), m.add_field("k", "string", F.get_json_object("props", "$.k")), m.select_fields(["event_id", "k"]))


@query(
    "SELECT n_name, round(sum(revenue), 2) AS revenue, count(*) AS suppliers FROM (SELECT s_suppkey, n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) GROUP BY ALL"
)
def revenue_by_nation(spark, sf_dir):
    return flow(
        spark, table(sf_dir, "lineitem"), m.add_field("revenue", "number", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        table(sf_dir, "nation"), table(sf_dir, "supplier"),
        m.join("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"], {"revenue": {"aggregate": "sum"}}, mode="inner"),
        m.join("nation", ["n_nationkey"], "supplier", ["s_nationkey"], {"n_name": {"aggregate": "min"}}, mode="inner"),
        m.join_with_self("supplier", ["n_name"], {"n_name": {}, "revenue": {"aggregate": "sum"}, "suppliers": {"aggregate": "count"}}),
    ).withColumn("revenue", F.round("revenue", 2))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return windowed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1))})


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k"
)
def sessions(spark, sf_dir):
    return session_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "30 minutes", ["user_id"])

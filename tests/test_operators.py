"""Row semantics of the operators, on small inline tables."""

import warnings

import pytest
from pyspark.sql import functions as F

import millrace as m


def rows(*steps, index=0, **options):
    return m.Flow(*steps).results(**options)[0][index]


PEOPLE = [{"name": "Ann", "age": 31, "city": "Oslo"}, {"name": "Bo", "age": None, "city": "Rome"}, {"name": "Cy", "age": 7, "city": "Oslo"}]


def test_select_keeps_pattern_order(spark):
    assert rows(PEOPLE, m.select_fields(["city", "na.*"]))[0] == {"city": "Oslo", "name": "Ann"}
    assert list(rows(PEOPLE, m.select_fields(["city", "na.*"]))[0]) == ["city", "name"]
    with pytest.raises(m.ProcessorError):
        m.Flow(PEOPLE, m.select_fields(["nothing"])).results()


def test_delete_and_rename(spark):
    assert rows(PEOPLE, m.delete_fields(["a.*"]))[0] == {"name": "Ann", "city": "Oslo"}
    assert rows(PEOPLE, m.rename_fields({"(n|c)(.*)": r"\2_\1"}))[0] == {"ame_n": "Ann", "age": 31, "ity_c": "Oslo"}
    with pytest.raises(m.ProcessorError):
        m.Flow(PEOPLE, m.rename_fields({"name|city": "x"})).results()
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        m.Flow(PEOPLE, m.delete_fields(["zzz"])).results()
    assert any("matches no field" in str(w.message) for w in seen)


def test_fields_with_dots_and_blanks(spark):
    data = [{"a.b": 1, "c d": "x"}]
    assert rows(data, m.rename_fields({"c d": "e.f"}), m.add_field("g h", "integer", lambda row: row["a.b"] + 1)) == [{"a.b": 1, "e.f": "x", "g h": 2}]


def test_add_field_kinds(spark):
    out = rows(PEOPLE, m.add_field("one", "integer", 1), m.add_field("upper", "string", F.upper("name")), m.add_field("n", "integer", lambda row: len(row["name"])))
    assert [(r["one"], r["upper"], r["n"]) for r in out] == [(1, "ANN", 3), (1, "BO", 2), (1, "CY", 2)]


def test_computed_fields_skip_nulls(spark):
    data = [{"a": 1, "b": 5, "c": "x"}, {"a": None, "b": 3, "c": None}]
    spec = [{"target": t, "operation": t, "source": ["a", "b"]} for t in ("sum", "avg", "max", "min", "multiply")]
    out = rows(data, m.add_computed_field(spec), m.add_computed_field(target="j", operation="join", source=["a", "c"], **{"with": "-"}), m.add_computed_field(target="f", operation="format", **{"with": "{b:03d}/{c}"}))
    assert [out[0][k] for k in ("sum", "avg", "max", "min", "multiply", "j", "f")] == [6, 3.0, 5, 1, 5, "1-x", "005/x"]
    assert [out[1][k] for k in ("sum", "avg", "max", "min", "multiply", "j", "f")] == [3, 3.0, 3, 3, 3, "", "003/None"]


def test_find_replace(spark):
    fields = [{"name": "name", "patterns": [{"find": "n+", "replace": "N$"}, {"find": "(A)", "replace": r"\1\1"}]}]
    assert [r["name"] for r in rows([{"name": "Ann"}, {"name": None}], m.find_replace(fields))] == ["AAN$", "NoN$e"]
    assert rows([{"name": "x"}, {"name": None}], m.find_replace(fields, keep_nulls=True))[1]["name"] is None


def test_set_type_policies(spark):
    data = [{"x": "1"}, {"x": "two"}, {"x": ""}]
    assert [r["x"] for r in rows(data, m.set_type("x", type="integer", on_error=m.drop))] == [1, None]
    assert [r["x"] for r in rows(data, m.set_type("x", type="integer", on_error=m.clear))] == [1, None, None]
    with pytest.raises(m.ProcessorError):
        m.Flow(data, m.set_type("x", type="integer")).results()
    seen = rows(data, m.set_type("x", type="integer", on_error=lambda resource, row, i, e: row["x"] is not None))
    assert [r["x"] for r in seen] == [1, None]


def test_set_type_reads_formats(spark):
    data = [{"d": "24/12/2020", "n": "1.234,5", "b": "yes", "p": "10, 20.5"}]
    out = rows(
        data, m.set_type("d", type="date", format="%d/%m/%Y"), m.set_type("n", type="number", decimalChar=",", groupChar="."),
        m.set_type("b", type="boolean", trueValues=["yes"], falseValues=["no"]), m.set_type("p", type="geopoint"),
    )[0]
    assert str(out["d"]) == "2020-12-24" and out["n"] == 1234.5 and out["b"] is True and out["p"] == [10.0, 20.5]


def test_set_type_transform_and_constraints(spark):
    assert [r["x"] for r in rows([{"x": "a"}, {"x": "bb"}], m.set_type("x", type="integer", transform=lambda v: len(v)))] == [1, 2]
    assert [r["x"] for r in rows([{"x": 1}, {"x": 9}], m.set_type("x", constraints={"maximum": 5}, on_error=m.drop))] == [1]


def test_unpivot_keeps_nulls_in_row_order(spark):
    data = [{"who": "a", "y1": 1, "y2": None}, {"who": "b", "y1": 3, "y2": 4}]
    out = rows(data, m.unpivot([{"name": r"y(\d)", "keys": {"year": r"\1"}}], [{"name": "year", "type": "integer"}], {"name": "v", "type": "integer"}))
    assert out == [{"who": "a", "year": 1, "v": 1}, {"who": "a", "year": 2, "v": None}, {"who": "b", "year": 1, "v": 3}, {"who": "b", "year": 2, "v": 4}]


def test_filter_rows_are_ored(spark):
    assert [r["name"] for r in rows(PEOPLE, m.filter_rows(equals=[{"name": "Ann"}], not_equals=[{"city": "Oslo"}]))] == ["Ann", "Bo"]
    assert rows(PEOPLE, m.filter_rows()) == []
    assert [r["name"] for r in rows(PEOPLE, m.filter_rows(lambda row: row["age"] is None))] == ["Bo"]
    assert [r["name"] for r in rows(PEOPLE, m.filter_rows(not_equals=[{"age": 31}]))] == ["Bo", "Cy"]


def test_validate(spark):
    assert [r["name"] for r in rows(PEOPLE, m.validate("age", lambda v: v is not None and v > 10, on_error=m.drop))] == ["Ann"]
    with pytest.raises(m.ProcessorError):
        m.Flow(PEOPLE, m.validate(lambda row: row["age"] is not None)).results()
    # a guard isn't lost when its column is pruned later
    with pytest.raises(m.ProcessorError):
        m.Flow(PEOPLE, m.validate(lambda row: row["age"] is not None), m.select_fields(["name"])).results()


def test_sort(spark):
    numbers = [{"a": x} for x in (3, -1.5, None, 0, 100, -20)]
    assert [r["a"] for r in rows(numbers, m.set_type("a", type="number", on_error=m.ignore), m.sort_rows("{a}"))] == [-20, -1.5, 0, None, 3, 100]
    ties = [{"k": 1, "v": i} for i in range(5)]
    assert [r["v"] for r in rows(ties, m.sort_rows(["k"]))] == [0, 1, 2, 3, 4]
    assert [r["v"] for r in rows(ties, m.sort_rows(["k"], reverse=True))] == [4, 3, 2, 1, 0]
    assert [r["name"] for r in rows(PEOPLE, m.sort_rows(lambda row: row["name"][::-1]))] == ["Ann", "Bo", "Cy"]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_order_is_kept_over_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    data = [{"k": i % 3, "v": i} for i in range(50)]
    out = rows(data, m.join_with_self("res_1", ["k"], {"k": {}, "first": {"name": "v", "aggregate": "first"}, "all": {"name": "v", "aggregate": "array"}}))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert [(r["k"], r["first"], r["all"]) for r in out] == [(k, k, list(range(k, 50, 3))) for k in range(3)]


def test_deduplicate(spark):
    data = [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": None, "b": "z"}, {"a": None, "b": "w"}]
    assert [r["b"] for r in rows(data, m.set_primary_key(["a"]), m.deduplicate())] == ["x", "z"]
    assert len(rows(data, m.deduplicate())) == 4
    assert len(rows([*data, *data], m.set_primary_key(["a", "b"]), m.deduplicate())) == 4


def test_concatenate(spark):
    a, b = [{"x": 1, "z": "p"}], [{"y": 2}, {"y": None}]
    out, package, _ = m.Flow(a, b, m.concatenate({"n": ["x", "y"], "z": []}, {"name": "both"})).results()
    assert out == [[{"n": 1, "z": "p"}, {"n": 2, "z": None}, {"n": None, "z": None}]] and package.names == ["both"]
    with pytest.raises(m.ProcessorError):
        m.Flow(a, m.concatenate({"n": ["x"], "m": ["x"]})).results()


def test_duplicate_delete_update(spark):
    out, package, _ = m.Flow([{"x": 1}], m.duplicate("res_1", "copy"), m.update_resource("copy", name="c2", note="n"), m.delete_resource("res_1"), m.update_package(title="T", resources=[])).results()
    assert out == [[{"x": 1}]] and package.names == ["c2"] and package.descriptor["title"] == "T" and package.resources[0].properties["note"] == "n"


HOUSES = [{"house": "A", "n": 1, "t": "x"}, {"house": "A", "n": 3, "t": "y"}, {"house": "B", "n": None, "t": "x"}, {"house": None, "n": 5, "t": "x"}]


def joined(mode, fields, targets=({"house": "A"}, {"house": "C"}, {"house": None}), key=("house",)):
    return rows(HOUSES, m.update_resource(-1, name="s"), list(targets), m.update_resource(-1, name="t"), m.join("s", list(key), "t", list(key), fields, mode=mode))


def test_join_modes(spark):
    fields = {"total": {"name": "n", "aggregate": "sum"}}
    assert joined("half-outer", fields) == [{"house": "A", "total": 4}, {"house": "C", "total": None}, {"house": None, "total": 5}]
    assert joined("inner", fields) == [{"house": "A", "total": 4}, {"house": None, "total": 5}]
    assert joined("full-outer", fields) == [{"house": "A", "total": 4}, {"house": "C", "total": None}, {"house": None, "total": 5}, {"house": "B", "total": None}]
    assert joined("inner", {}) == [{"house": "A"}, {"house": None}]
    assert joined("anti", {}) == [{"house": "C"}]


def test_a_miss_keeps_what_the_target_has(spark):
    assert joined("half-outer", {"n": {}}, [{"house": "A", "n": 9}, {"house": "C", "n": 8}]) == [{"house": "A", "n": 3}, {"house": "C", "n": 8}]


def test_aggregators(spark):
    names = ["sum", "avg", "median", "max", "min", "first", "last", "any", "count"]
    fields = {"house": {}, **{a: {"name": "n", "aggregate": a} for a in names}, "set": {"name": "t", "aggregate": "set"}, "array": {"name": "t", "aggregate": "array"}, "counters": {"name": "t", "aggregate": "counters"}}
    out = {r["house"]: r for r in rows(HOUSES, m.join_with_self("res_1", ["house"], fields))}
    assert [out["A"][a] for a in names] == [4, 2.0, 2.0, 3, 1, 1, 3, 3, 2]
    assert [out["B"][a] for a in names] == [None, None, None, None, None, None, None, None, 1]
    assert out["A"]["set"] == ["x", "y"] and out["A"]["array"] == ["x", "y"] and out["A"]["counters"] == [["x", 1], ["y", 1]]
    assert rows([{"t": "a"}, {"t": "b"}], m.join_with_self("res_1", "k", {"s": {"name": "t", "aggregate": "sum"}})) == [{"s": "ba"}]


def test_counters_by_count_then_appearance(spark):
    data = [{"k": 1, "v": v} for v in "cabcab"] + [{"k": 1, "v": "c"}]
    assert rows(data, m.join_with_self("res_1", ["k"], {"c": {"name": "v", "aggregate": "counters"}})) == [{"c": [["c", 3], ["a", 2], ["b", 2]]}]


def test_star_and_row_numbers(spark):
    out = rows([{"id": "007", "names": "x"}, {"id": "008", "names": "y"}], m.update_resource(-1, name="s"), [{"values": "p"}, {"values": "q"}, {"values": "r"}], m.update_resource(-1, name="t"), m.join("s", "{#}", "t", "{#}", {"*": {}}))
    assert out == [{"values": "p", "id": "007", "names": "x"}, {"values": "q", "id": "008", "names": "y"}, {"values": "r", "id": None, "names": None}]


def test_keys_of_other_types_compare_as_text(spark):
    out = rows([{"k": 1, "v": "one"}], m.update_resource(-1, name="s"), [{"k": "1"}, {"k": "2"}], m.update_resource(-1, name="t"), m.join("s", ["k"], "t", ["k"], {"v": {}}))
    assert out == [{"k": "1", "v": "one"}, {"k": "2", "v": None}]
    with pytest.raises(m.ProcessorError):
        m.Flow([{"k": 1}], m.join("nobody", ["k"], "res_1", ["k"])).results()


def test_user_functions(spark):
    def change(row):
        row["age"] = (row["age"] or 0) + 1

    def running(rows):
        total = 0
        for row in rows:
            total += row["age"] or 0
            yield {**row, "age": total}

    def package(package):
        package.pkg = package.pkg.with_(metadata={"seen": True})
        yield package.pkg
        yield from package

    assert [r["age"] for r in rows(PEOPLE, change)] == [32, 1, 8]
    assert [r["age"] for r in rows(PEOPLE, running)] == [31, 31, 38]
    out, made, _ = m.Flow(PEOPLE, package).results()
    assert made.metadata == {"seen": True} and len(out[0]) == 3
    with pytest.raises(TypeError):
        m.Flow(PEOPLE, lambda other: other).results()
    with pytest.raises(TypeError):
        m.Flow(PEOPLE, 7).results()


def test_control(spark, tmp_path):
    calls = []
    out, _, stats = m.Flow(PEOPLE, m.conditional(lambda p: len(p.resources) == 1, m.Flow(m.select_fields(["name"]))), m.update_stats({"mine": 1}), m.finalizer(lambda stats: calls.append(stats["mine"]))).results()
    assert list(out[0][0]) == ["name"] and stats["mine"] == 1 and calls == [1]
    made = []

    def source():
        made.append(1)
        return PEOPLE

    for _ in range(2):
        path = str(tmp_path / "points")
        assert rows(m.conditional(lambda p: True, lambda p: m.Flow(source())), m.checkpoint("one", path)) == PEOPLE
    assert made == [1]


def test_parallelize_keeps_rows_that_fail(spark):
    def work(row):
        row["x"] = 10 // row["x"]

    out, _, stats = m.Flow([{"x": 5}, {"x": 0}, {"x": 2}], m.parallelize(work, 2, predicate=lambda row: row["x"] != 2)).results()
    assert out == [[{"x": 2}, {"x": 0}, {"x": 2}]] and stats["parallelize_errors"] >= 1


def test_printer(spark, capsys):
    rows([{"x": "a" * 200, "y": i} for i in range(30)], m.printer(num_rows=2, last_rows=1, max_cell_size=10))
    text = capsys.readouterr().out
    assert "aaaaaaa..." in text and "29" in text and "15" not in text


def test_sequences_and_errors(spark):
    assert rows([["a", 1], ["b", 2]]) == [{"col0": "a", "col1": 1}, {"col0": "b", "col1": 2}]
    with pytest.raises(m.ProcessorError) as e:
        m.Flow(PEOPLE, m.join("x", ["a"], "y", ["a"])).results()
    assert e.value.processor_name == "join" and e.value.processor_position == 2


def test_values_keep_their_python_types(spark):
    import datetime as dt

    row = {"d": dt.date(1, 1, 1), "t": dt.datetime(2020, 1, 2, 3, 4, 5), "o": {"a": [1, 2]}, "l": [1, "x"], "b": True, "f": 1.5, "h": dt.time(1, 2)}
    assert rows([row]) == [row]
    assert rows([{"x": 1}, {"x": "a"}]) == [{"x": 1}, {"x": "a"}]


def test_nested_flows_and_sources(spark):
    inner = m.Flow([{"x": 1}], m.add_field("y", "integer", 2))
    assert rows(inner, m.select_fields(["y"])) == [{"y": 2}]
    out, package, _ = m.Flow(m.sources(inner, [{"z": 3}], m.Flow([{"x": 1}], m.update_package(name="n")))).results()
    assert len(out) == 3 and package.metadata["name"] == "n" and len(set(package.names)) == 3


def test_full_outer_with_template_and_mixed_keys(spark):
    source = [{"id": 1, "v": "a"}, {"id": 4, "v": "d"}]
    for key in ("key-{k}", ["k"]):
        target = [{"k": "1", "w": 1}, {"k": "2", "w": 2}, {"k": None, "w": 3}]
        name = "key-{id}" if isinstance(key, str) else ["id"]
        got = m.Flow(source, target, m.join("res_1", name, "res_2", key, {"v": {}}, mode="full-outer")).results()[0][0]
        assert sorted(map(str, got)) == sorted(map(str, [{"k": "1", "w": 1, "v": "a"}, {"k": "2", "w": 2, "v": None}, {"k": None, "w": 3, "v": None}, {"k": "4", "w": None, "v": "d"}]))


def test_medians_against_python(spark):
    import random
    import statistics

    r = random.Random(3)
    rows = [{"g": r.choice(["a", "b", None, "c"]), "v": r.choice([None, r.randint(-9, 9), 5, 5])} for _ in range(400)] + [{"g": "one", "v": 7}, {"g": "none", "v": None}, {"g": "two", "v": 1}, {"g": "two", "v": 2}]
    got = m.Flow(rows, m.join_with_self("res_1", ["g"], {"g": {}, "m": {"name": "v", "aggregate": "median"}})).results()[0][0]
    want = {g: [x["v"] for x in rows if x["g"] == g and x["v"] is not None] for g in {x["g"] for x in rows}}
    assert {x["g"]: None if x["m"] is None else float(x["m"]) for x in got} == {g: statistics.median(v) if v else None for g, v in want.items()}


def test_row_numbers_are_dense_after_filters_and_sorts(spark):
    from millrace.operators.join import numbered

    flow = m.Flow(spark.range(1000, numPartitions=7), m.filter_rows(F.col("id") % 3 == 0), m.sort_rows("{id:06}", reverse=True))
    got = numbered(flow.plan(ordered=True).resources[0]).df.select("id", "__number").collect()
    assert sorted((x["__number"], x["id"]) for x in got) == [(k + 1, 999 - 3 * k) for k in range(334)]


def test_class_processors(spark):
    class Twice(m.Processor):
        def process_datapackage(self, package):
            return package.with_(metadata={**package.metadata, "seen": True})

        def process_row(self, row):
            row["a"] *= 2

    rows, package, _ = m.Flow([{"a": 1}, {"a": 2}], Twice()).results()
    assert rows == [[{"a": 2}, {"a": 4}]] and package.metadata["seen"]

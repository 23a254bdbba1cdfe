"""Loading: files of many formats, databases, packages, descriptors with rows, and environment variables that name them."""

from __future__ import annotations

import csv
import json
import os
import re
import sqlite3
import zipfile
from collections.abc import Iterable
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceLoadError
from ..flow import Context, Step, from_dataframe, from_rows
from ..functions.cast import FALSE, TRUE, cast_fields, strip_text
from ..functions.text import col
from ..operators.rows import first_rows
from ..package import ORDER, Package, Resource, select
from ..schema import TableSchema, infer_type, spark_type

#: Names of strategies that users may pass as texts: fixed values.
INFER_FULL, INFER_PYTHON_TYPES, INFER_STRINGS = "full", "pytypes", "strings"
CAST_WITH_SCHEMA, CAST_TO_STRINGS, CAST_DO_NOTHING = "schema", "strings", "nothing"
SAMPLE = 1000


def load(
    load_source: Any, name: str | None = None, resources: Any = None, strip: bool | None = None, limit_rows: int | None = None, infer_strategy: str | None = None, cast_strategy: str | None = None,
    override_schema: dict | None = None, override_fields: dict | None = None, extract_missing_values: Any = None, deduplicate_headers: bool = False,
    deduplicate_headers_case_sensitive: bool = True, deduplicate_headers_format: str = " (%s)", on_error: Any = "raise", force_strings: bool = False, validate: bool = False, **options: Any,
) -> Step:
    """Resources from a source, behind those that are there.

    In order: headers are read and made distinct; the schema is inferred from a sample, then patched; missing values are
    extracted; values are cast; texts stripped; rows limited. Texts with inferred types are always cast; columnar files, tables and
    DataFrames keep their columns as they are, and their filters reach the scan, unless a schema, a cast or stripping is asked for.
    """
    infer = infer_strategy or (INFER_STRINGS if force_strings else INFER_FULL)
    cast = cast_strategy or (CAST_TO_STRINGS if force_strings else CAST_WITH_SCHEMA if validate else CAST_DO_NOTHING)
    for given, known in ((infer, (INFER_FULL, INFER_PYTHON_TYPES, INFER_STRINGS)), (cast, (CAST_WITH_SCHEMA, CAST_TO_STRINGS, CAST_DO_NOTHING))):
        if given not in known:
            raise ValueError(f"no strategy {given!r}; there are {known}")

    def plan(package: Package, c: Context) -> Package:
        source = load_source
        try:
            if isinstance(source, str) and source.startswith("env://"):
                source = os.environ[source[6:]]
            made = _open(c, source, name, resources, infer, options, (deduplicate_headers, deduplicate_headers_case_sensitive, deduplicate_headers_format))
        except Exception as e:
            raise SourceLoadError(f"Failed to load source {load_source!r} and options {options!r}: {e}") from e
        return package.add(*[_prepared(r, is_typed) for r, is_typed in made])

    def _prepared(r: Resource, is_typed: bool) -> Resource:
        schema = r.schema.copy()
        if override_schema:
            schema = TableSchema.from_descriptor({**schema.descriptor, **override_schema})
        for n, changes in (override_fields or {}).items():
            for f in schema.fields:
                if f["name"] == n:
                    f.update(changes)
        r = r.with_(schema=schema)
        if extract_missing_values:
            r = _extracted(r, extract_missing_values)
        missing = r.schema.missing_values
        if cast == CAST_WITH_SCHEMA or cast == CAST_DO_NOTHING and (not is_typed or override_schema or override_fields):
            r = r.with_(df=cast_fields(r.df, r.schema.fields, missing, on_error, r.name))
        elif cast == CAST_TO_STRINGS:
            schema = r.schema.copy()
            for f in schema.fields:
                f["type"] = "string"
            r = r.with_(df=r.df.select(*[col(n).cast("string").alias(n) for n in schema.names], *([ORDER] if r.ordered else [])), schema=schema)
        if strip or strip is None and not r.properties.get("columnar"):
            kinds = {f.name: f.dataType for f in r.df.schema.fields}
            texts = [f["name"] for f in r.schema.fields if f["type"] in ("string", "any") and isinstance(kinds[f["name"]], T.StringType)]
            r = r.with_(df=r.df.withColumns({n: strip_text(col(n)) for n in texts}) if texts else r.df)
        return first_rows(r, limit_rows) if limit_rows else r

    return Step("load", plan, needs_order=False)


def _extracted(r: Resource, how: Any) -> Resource:
    """A field that maps each field that holds a missing value to that value."""
    spec = {"source": None, "target": "missingValues", "values": None, **(how if isinstance(how, dict) else {})}
    wanted = spec["source"] or r.schema.names
    wanted = [wanted] if isinstance(wanted, str) else wanted
    values = spec["values"] if spec["values"] is not None else r.schema.missing_values
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in wanted]), F.array(*[col(n).cast("string") for n in wanted]))
    found = F.map_filter(pairs, lambda k, v: F.coalesce(v.isin(*values), F.lit(False)))
    schema = r.schema.copy()
    schema.fields.append({"name": spec["target"], "type": "object"})
    return r.with_(df=r.df.withColumn(spec["target"], F.to_json(found)), schema=schema)


def _open(c: Context, source: Any, name: str | None, resources: Any, infer: str, options: dict, headers: tuple) -> list[tuple[Resource, bool]]:
    """Resources, and whether their columns are typed already."""
    if isinstance(source, DataFrame):
        return [(from_dataframe(source, name or "res_1", c.ordered).with_(properties={"columnar": True}), True)]
    if isinstance(source, tuple) and len(source) == 2 and isinstance(source[0], dict):
        return _from_descriptor_and_rows(c, *source, resources)
    if not isinstance(source, (str, os.PathLike)) and isinstance(source, Iterable):
        return [(from_rows(c.spark, source, name or "res_1"), True)]
    source = os.fspath(source)
    form = options.get("format") or _format(source)
    label = name or re.sub(r"[^a-z0-9_.-]+", "-", os.path.splitext(os.path.basename(source.rstrip("/")))[0].lower()) or "res_1"
    if form == "datapackage" or source.endswith("datapackage.json"):
        return _package(c, source, resources, headers)
    if form == "sql":
        return [(_named(c, _sql(c, source, options), label, source, True), True)]
    if form == "parquet":
        return [(_named(c, c.spark.read.parquet(source), label, source, True), True)]
    if form == "orc":
        return [(_named(c, c.spark.read.orc(source), label, source, True), True)]
    if form in ("json", "ndjson", "jsonl"):
        return [(_json(c, source, form, label, infer), infer != INFER_STRINGS)]
    if form == "geojson":
        return [(_geojson(c, source, label, infer), True)]
    if form == "xml":
        return [_text_table(c, _xml(source), label, source, infer)]
    if form == "excel-xml":
        return [_text_table(c, _spreadsheet(source), label, source, infer)]
    if form in ("xlsx",):
        return [_text_table(c, _xlsx(source, options.get("sheet")), label, source, infer)]
    return [_delimited(c, source, form, label, infer, options, headers)]


def _format(source: str) -> str:
    if re.match(r"^(jdbc:|sqlite:|postgres|mysql)", source):
        return "sql"
    end = os.path.splitext(source.rstrip("/"))[1].lower().lstrip(".")
    return {"tab": "tsv", "txt": "csv", "": "csv", "jsonl": "ndjson", "pq": "parquet", "zip": "datapackage"}.get(end, end)


def _named(c: Context, df: DataFrame, name: str, path: str, columnar: bool = False) -> Resource:
    return from_dataframe(df, name, c.ordered).with_(properties={"path": os.path.basename(path), **({"columnar": True} if columnar else {})})


# delimited text


def distinct_headers(names: list[str], wanted: bool, case_sensitive: bool, form: str) -> list[str]:
    """Headers of which none repeats: repeated ones get a number, the first of them too. Otherwise repeats are an error."""
    seen: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        seen.setdefault(n if case_sensitive else n.lower(), []).append(i)
    repeated = {k: v for k, v in seen.items() if len(v) > 1}
    if repeated and not wanted:
        raise ValueError(f"Found duplicate headers: {[names[v[0]] for v in repeated.values()]}")
    out = list(names)
    for places in repeated.values():
        for k, i in enumerate(places, 1):
            out[i] = names[i] + form % k
    return out


def _head(c: Context, source: str, encoding: str) -> list[str]:
    """The first lines of a file, or of a folder's first file, read by Spark."""
    reader = c.spark.read.option("encoding", encoding)
    df = reader.text(source)
    files = df.inputFiles()  # of a folder, the first in the order of names
    return [r[0] for r in (reader.text(min(files)) if len(files) > 1 else df).limit(SAMPLE).collect()]


def _delimited(c: Context, source: str, form: str, name: str, infer: str, options: dict, headers: tuple) -> tuple[Resource, bool]:
    encoding = options.get("encoding", "utf-8")
    lines = _head(c, source, encoding)
    separator = options.get("delimiter") or ("\t" if form == "tsv" else _guess_separator(lines))
    parsed = list(csv.reader(lines, delimiter=separator, quotechar=options.get("quotechar", '"')))
    given = options.get("headers")
    skip = 0
    if isinstance(given, list):
        names = given
    else:
        start = given - 1 if isinstance(given, int) and given > 0 else _first_row(parsed)
        names, skip = [h.strip() for h in parsed[start]] if parsed else [], start + 1
    keep = [i for i, n in enumerate(names) if n]
    clean = distinct_headers([names[i] for i in keep], *headers)
    raw = [f"_c{i}" for i in range(max(len(names), 1))]
    # files are split unless a quoted text of the sample holds a line break, or the caller says that some do
    across = options.get("multiline", any(line.count(options.get("quotechar", '"')) % 2 for line in lines))
    before = _records(lines, skip)
    reader = c.spark.read.options(
        sep=separator, encoding=encoding, quote=options.get("quotechar", '"'), escape='"', multiLine=across or before > 1, mode="PERMISSIVE", nullValue="\u0000", emptyValue="",
        ignoreLeadingWhiteSpace=False, header=before == 1,
    )
    df = reader.schema(T.StructType([T.StructField(x, T.StringType()) for x in raw])).csv(source)
    if before > 1:  # lines before the header: the first rows of each file, which is read as a whole
        df = df.withColumn("__file", F.col("_metadata.file_path"))
        df = df.withColumn(ORDER, F.monotonically_increasing_id())
        first = df.groupBy("__file").agg(F.min(ORDER).alias("__first"))  # a row for each file
        df = df.join(F.broadcast(first), "__file").where(F.col(ORDER) >= F.col("__first") + before).drop("__file", "__first")
    elif c.ordered:
        df = df.withColumn(ORDER, F.monotonically_increasing_id())
    blank = None
    for x in raw:
        b = F.coalesce(F.col(x), F.lit("")) == ""
        blank = b if blank is None else blank & b
    df = df.where(~blank)
    df = df.select(*[F.coalesce(F.col(raw[i]), F.lit("")).alias(n) for i, n in zip(keep, clean, strict=True)], *([ORDER] if c.ordered else []))
    sample = [[r[i] if i < len(r) else "" for i in keep] for r in parsed[skip:] if any(x.strip() for x in r)]
    types = ["string" if infer in (INFER_STRINGS, INFER_PYTHON_TYPES) else infer_text([r[k] for r in sample]) for k in range(len(keep))]
    schema = TableSchema([{"name": n, "type": t} for n, t in zip(clean, types, strict=True)])
    return Resource(name, df, schema, {"path": os.path.basename(source), "encoding": encoding}, c.ordered), infer != INFER_FULL


def _guess_separator(lines: list[str]) -> str:
    text = "\n".join(lines[:50])
    return max(",;\t|", key=text.count) if text else ","


def _first_row(parsed: list[list[str]]) -> int:
    """The header's place: the first row as wide as most rows; narrower lines before it are comments or titles."""
    widths = [sum(1 for x in r if x.strip()) for r in parsed[:100]]
    filled = [w for w in widths if w]
    if not filled:
        return 0
    usual = max(set(filled), key=lambda w: (filled.count(w), w))
    return next((i for i, w in enumerate(widths) if w >= usual or w > 1), 0)


def _records(lines: list[str], upto: int) -> int:
    """How many of the first lines Spark's reader gives as rows: it leaves out empty ones."""
    return sum(1 for line in lines[:upto] if line.strip())


def infer_text(values: Iterable[str]) -> str:
    """The narrowest type that all texts fit, but for empty ones."""
    given = [v.strip() for v in values if v and v.strip()]
    tests = (
        ("integer", r"[+-]?\d+"),
        ("number", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|nan|NaN|INF|-INF"),
        ("date", r"\d{4}-\d\d-\d\d"),
        ("datetime", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?Z?"),
        ("time", r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d"),
    )
    for kind, pattern in tests:
        if given and all(re.fullmatch(pattern, v) for v in given):
            return kind
    if given and all(v in TRUE[:3] + FALSE[:3] for v in given):
        return "boolean"
    return "string"


# other formats


def _typed_by_columns(df: DataFrame) -> tuple[DataFrame, TableSchema]:
    """Nested columns as JSON text of their logical type."""
    schema = TableSchema.of(df.schema)
    columns: list[Column] = []
    for f, s in zip(schema.fields, df.schema.fields, strict=True):
        complex_ = isinstance(s.dataType, (T.ArrayType, T.MapType, T.StructType))
        columns.append(F.to_json(col(f["name"])).alias(f["name"]) if complex_ else col(f["name"]).cast(spark_type(f["type"])).alias(f["name"]))
    return df.select(*columns), schema


def _json(c: Context, source: str, form: str, name: str, infer: str) -> Resource:
    df = c.spark.read.option("multiLine", form == "json").option("primitivesAsString", infer == INFER_STRINGS).json(source)
    names = _json_names(c, source, form, df.columns)
    df, schema = _typed_by_columns(df.select(*[col(n) for n in names]))
    return _named(c, df, name, source).with_(schema=schema)


def _json_names(c: Context, source: str, form: str, names: list[str]) -> list[str]:
    """Columns in the order of the first object; Spark sorts them."""
    text = "\n".join(_head(c, source, "utf-8"))
    try:
        first, _ = json.JSONDecoder().raw_decode(text[text.index("{") :])
        return [n for n in first if n in names] + [n for n in names if n not in first]
    except ValueError:
        return names


def _geojson(c: Context, source: str, name: str, infer: str) -> Resource:
    df = c.spark.read.option("multiLine", True).json(source).select(F.explode("features").alias("f"))
    df = df.select("f.properties.*", F.to_json("f.geometry").alias("__geometry"))
    df, schema = _typed_by_columns(df)
    schema.field("__geometry")["type"] = "object"
    return _named(c, df, name, source).with_(schema=schema)


def _text_table(c: Context, rows: list[dict], name: str, source: str, infer: str) -> tuple[Resource, bool]:
    """Rows of texts from a document that is parsed as a whole."""
    names = list(rows[0]) if rows else []
    types = [infer_text([r.get(n) or "" for r in rows[:SAMPLE]]) if infer == INFER_FULL else "string" for n in names]
    strings = TableSchema([{"name": n, "type": "string"} for n in names])
    r = from_rows(c.spark, rows, name, True, strings)
    return r.with_(schema=TableSchema([{"name": n, "type": t} for n, t in zip(names, types, strict=True)]), properties={"path": os.path.basename(source)}), infer != INFER_FULL


def _xml(source: str) -> list[dict]:
    """The elements of the root's first kind of child as rows; their children and attributes as columns."""
    root = ElementTree.parse(source).getroot()
    children = list(root)
    if len(children) == 1 and len(children[0]) and len({x.tag for x in children[0]}) == 1:
        children = list(children[0])
    rows = [{**x.attrib, **{y.tag: (y.text or "").strip() for y in x}} for x in children]
    names = list(dict.fromkeys(n for r in rows for n in r))
    return [{n: r.get(n) for n in names} for r in rows]


def _spreadsheet(source: str) -> list[dict]:
    """The first table of an XML spreadsheet; its first row names the columns."""
    rows: list[list[str]] = []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    table = next((e for e in ElementTree.parse(source).getroot().iter() if local(e) == "Table"), None)
    for row in table if table is not None else []:
        if local(row) == "Row":
            cells: list[str] = []
            for cell in row:
                if local(cell) == "Cell":
                    at = next((int(v) for k, v in cell.attrib.items() if k.rsplit("}", 1)[-1] == "Index"), len(cells) + 1)
                    cells += [""] * (at - 1 - len(cells))
                    cells.append("".join("".join(d.itertext()) for d in cell if local(d) == "Data"))
            rows.append(cells)
    return [dict(zip(rows[0], [*r, *[""] * len(rows[0])], strict=False)) for r in rows[1:]] if rows else []


def _xlsx(source: str, sheet: Any = None) -> list[dict]:
    """The first, or a numbered, sheet of a workbook; its first row names the columns."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(source) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in e.iter(f"{space}t")) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        root = ElementTree.fromstring(z.read(sheets[(sheet or 1) - 1 if isinstance(sheet or 1, int) else 0]))
    rows = []
    for row in root.iter(f"{space}row"):
        cells: dict[int, str] = {}
        at = 0
        for cell in row:
            if "r" in cell.attrib:  # else it stands behind the one before
                place = 0
                for x in re.match(r"[A-Z]+", cell.get("r"))[0]:
                    place = place * 26 + ord(x) - 64
                at = place
            else:
                at += 1
            value = cell.find(f"{space}v")
            inline = cell.find(f"{space}is")
            text = "".join(t.text or "" for t in inline.iter(f"{space}t")) if inline is not None else "" if value is None else value.text or ""
            cells[at - 1] = shared[int(text)] if cell.get("t") == "s" and text else {"1": "True", "0": "False"}.get(text, text) if cell.get("t") == "b" else text
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    rows = [r for r in rows if any(r)]
    return [dict(zip(rows[0], [*r, *[""] * len(rows[0])], strict=False)) for r in rows[1:]] if rows else []


def _sql(c: Context, source: str, options: dict) -> DataFrame:
    """A table in its order, or a query, of a database; by JDBC, or sqlite3 for its files."""
    table, query, order = options.get("table"), options.get("query"), options.get("order_by")
    if not table and not query:
        raise ValueError("either table or query must be given")
    statement = query or f"SELECT * FROM {table}" + (f" ORDER BY {order if isinstance(order, str) else ', '.join(order)}" if order else "")
    if source.startswith("sqlite:"):
        with sqlite3.connect(re.sub(r"^sqlite:(///)?", "", source)) as db:
            cursor = db.execute(statement)
            names = [d[0] for d in cursor.description]
            rows = cursor.fetchall()
        types = [infer_type(r[k] for r in rows) for k in range(len(names))]
        schema = TableSchema([{"name": n, "type": "string" if t == "any" else t} for n, t in zip(names, types, strict=True)])
        return from_rows(c.spark, [dict(zip(names, r, strict=True)) for r in rows], "sql", False, schema).df.drop(ORDER)
    url = source if source.startswith("jdbc:") else "jdbc:" + source
    extra = {k: str(v) for k, v in options.items() if k not in ("table", "query", "order_by", "format")}
    return c.spark.read.format("jdbc").options(url=url, query=statement, **extra).load()


# packages


def _package(c: Context, source: str, resources: Any, headers: tuple) -> list[tuple[Resource, bool]]:
    """The chosen resources of a package descriptor, or of a zipped package, cast by their schemas."""
    if source.endswith(".zip"):
        import uuid

        folder = f"{c.spark.conf.get('spark.checkpoint.dir', '') or os.path.dirname(os.path.abspath(source))}/unzipped-{uuid.uuid4().hex}".removeprefix("file://")
        with zipfile.ZipFile(source) as z:
            z.extractall(folder)
        source = f"{folder}/datapackage.json"
    descriptor = json.loads(c.spark.read.text(source, wholetext=True).first()[0])
    names = [r["name"] for r in descriptor["resources"]]
    chosen = select(Package(tuple(Resource(n, None, TableSchema()) for n in names)), resources)
    out = []
    for d in descriptor["resources"]:
        if d["name"] not in chosen:
            continue
        path = d["path"][0] if isinstance(d["path"], list) else d["path"]
        full = path if re.match(r"^[a-z]+://|^/", path) else f"{os.path.dirname(source)}/{path}"
        dialect = d.get("dialect", {})
        form = d.get("format") or _format(path)
        r, _ = _open(c, full, d["name"], None, INFER_STRINGS, {"format": form, "delimiter": dialect.get("delimiter", ","), "headers": 1} if form == "csv" else {"format": form}, headers)[0]
        schema = TableSchema.from_descriptor(d["schema"]) if "schema" in d else r.schema
        there = set(r.df.columns)
        schema.fields = [f for f in schema.fields if f["name"] in there]
        rest = {k: v for k, v in d.items() if k not in ("name", "schema")}
        r = r.with_(schema=schema, properties=rest)
        out.append((r.with_(df=cast_fields(r.df, schema.fields, schema.missing_values, "raise", r.name)), True))
    return out


def _from_descriptor_and_rows(c: Context, descriptor: dict, iterators: Iterable, resources: Any) -> list[tuple[Resource, bool]]:
    names = [r["name"] for r in descriptor["resources"]]
    chosen = select(Package(tuple(Resource(n, None, TableSchema()) for n in names)), resources)
    out = []
    for d, rows in zip(descriptor["resources"], iterators, strict=False):
        if d["name"] in chosen:
            schema = TableSchema.from_descriptor(d.get("schema", {"fields": []}))
            r = from_dataframe(rows, d["name"], c.ordered) if isinstance(rows, DataFrame) else from_rows(c.spark, rows, d["name"], True, schema if schema.fields else None)
            out.append((r.with_(properties={k: v for k, v in d.items() if k not in ("name", "schema")}), True))
    return out




__all__ = ["distinct_headers", "infer_text", "load"]

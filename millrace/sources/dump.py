"""Sinks: files in a folder or archive, and databases. What is written passes through to later steps.

Tasks write text files; workbooks, files of a caller's own format and sqlite files are written by the driver, a partition at a time.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import Context, Step, with_order
from ..functions.cast import cast_fields
from ..functions.text import col, python_text, python_time_pattern
from ..package import ORDER, Package, Resource, select
from ..schema import TableSchema, from_spark
from . import xlsx
from .parts import Parts

#: How dates and times are written unless a field says otherwise.
PATTERNS = {"date": "%Y-%m-%d", "datetime": "%Y-%m-%dT%H:%M:%S", "time": "%H:%M:%S"}
MEDIA = {"csv": "text/csv", "json": "text/json", "geojson": "application/geo+json", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
#: Where counts are kept in descriptors; the option ``counters`` gives other places (dots go down, None keeps none).
COUNTERS = {"datapackage-rowcount": "count_of_rows", "datapackage-bytes": "bytes", "datapackage-hash": "hash", "resource-rowcount": "count_of_rows", "resource-bytes": "bytes", "resource-hash": "hash"}


def _text(r: Resource, f: dict, temporal: str | None) -> Column:
    """A field as text of a file; null stays null."""
    c, kind = col(f["name"]), r.df.schema[f["name"]].dataType
    if f["type"] in ("date", "datetime") and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, python_time_pattern((f.get(temporal) if temporal else None) or PATTERNS[f["type"]]))
    if f["type"] == "geopoint":
        return F.array_join(F.transform(c, lambda x: python_text(x, T.DoubleType())), ", ")
    if f["type"] == "year":
        return F.lpad(c.cast("string"), 4, "0")
    return python_text(c, kind, None)


def _csv(r: Resource, titles: bool, temporal: str | None) -> tuple[DataFrame, str]:
    """Lines of a CSV file with their ends, quoted where needed, and its header."""
    out = io.StringIO()
    csv.writer(out).writerow([f.get("title", f["name"]) if titles else f["name"] for f in r.schema.fields])
    cells = []
    for f in r.schema.fields:
        t = _text(r, f, temporal)
        quoted = F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.coalesce(F.when(t.rlike('[",\r\n]'), quoted).otherwise(t), F.lit("")))
    return r.df.select(F.concat(F.concat_ws(",", *cells), F.lit("\r\n")).alias("value"), ORDER), out.getvalue()


def _json_value(r: Resource, f: dict) -> Column:
    c, kind = col(f["name"]), r.df.schema[f["name"]].dataType
    if f["type"] in ("any", "array", "object", "geojson") and isinstance(kind, T.StringType):
        return F.coalesce(F.to_json(F.try_parse_json(c)), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, python_time_pattern(PATTERNS[f["type"]]))
    elif isinstance(kind, T.DecimalType):
        c = c.cast("double")
    text = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(text.substr(F.lit(2), F.length(text) - 2))


def _object(r: Resource, fields: list[dict]) -> Column:
    """A row as a JSON object, with its names in order."""
    parts: list[Column] = []
    for i, f in enumerate(sorted(fields, key=lambda f: f["name"])):
        parts += [F.lit((", " if i else "") + json.dumps(f["name"], ensure_ascii=False) + ": "), _json_value(r, f)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _json(r: Resource) -> DataFrame:
    return r.df.select(_object(r, r.schema.fields).alias("value"), ORDER)


def _geojson(r: Resource) -> DataFrame:
    """A row as a feature: a geopoint or geojson field is its geometry, the rest its properties."""
    shape = next((f for f in r.schema.fields if f["type"] in ("geopoint", "geojson")), None)
    rest = [f for f in r.schema.fields if f is not shape]
    if shape is None:
        geometry = F.lit("null")
    elif shape["type"] == "geojson":
        geometry = F.coalesce(col(shape["name"]), F.lit("null"))
    else:  # coordinates as they stand
        geometry = F.coalesce(F.concat(F.lit('{"type": "Point", "coordinates": '), F.to_json(col(shape["name"])), F.lit("}")), F.lit("null"))
    return r.df.select(F.concat(F.lit('{"geometry": '), geometry, F.lit(', "properties": '), _object(r, rest), F.lit(', "type": "Feature"}')).alias("value"), ORDER)


class _Writer:
    """Writes parts of a file while counting bytes and hashing them."""

    def __init__(self, out: Any):
        self.out, self.size, self.hash = out, 0, hashlib.md5()

    def __call__(self, text: str) -> None:
        data = text.encode("utf-8")
        self.out.write(data)
        self.size += len(data)
        self.hash.update(data)


def _write_one(r: Resource, form: str, out: Any, titles: bool, temporal: str | None) -> tuple[int, int, str]:
    """One file of a resource, written by tasks; rows, bytes, md5."""
    with Parts(r.df.sparkSession) as parts:
        if form == "csv":
            df, header = _csv(r, titles, temporal)
            parts.text(header)
            count = parts.lines(df)
        else:
            parts.text("[" if form == "json" else '{"features": [')
            count = parts.lines(_json(r) if form == "json" else _geojson(r), ", ")
            parts.text("]" if form == "json" else '], "type": "FeatureCollection"}')
        return count, *parts.join(out)


def _write_book(r: Resource, out: Any, titles: bool, temporal: str | None, options: dict, place: Any, path: str) -> tuple[int, int, str]:
    """A workbook with the resource's sheet; rows, bytes, md5. ``sheetname``: its name; ``update_existing``: other sheets stay."""
    header = [f.get("title", f["name"]) if titles else f["name"] for f in r.schema.fields]
    raw = {f["name"] for f in r.schema.fields if f["type"] in ("integer", "number", "boolean", "year")}
    columns = [(col(f["name"]).cast("double") if f["type"] == "number" else col(f["name"])) if f["name"] in raw else _text(r, f, temporal) for f in r.schema.fields]
    rows = r.df.orderBy(ORDER).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).toLocalIterator(prefetchPartitions=True)

    def lines() -> Iterator[Any]:
        yield header
        yield from rows

    existing = place.existing(path) if options.get("update_existing") else None
    beside = io.BytesIO()
    count = xlsx.write(beside, options.get("sheetname") or r.name[:31], lines(), existing) - 1
    data = beside.getvalue()
    out.write(data)
    return count, len(data), hashlib.md5(data).hexdigest()


def _put(d: dict, place: str | None, value: Any) -> None:
    """Sets what a dotted place names."""
    if place:
        *above, last = place.split(".")
        for k in above:
            d = d.setdefault(k, {})
        d[last] = value


def _write_own(formatter: Callable, r: Resource, out: Any) -> tuple[int, int, str]:
    """A file by the user's formatter, a function of (rows, schema descriptor) that gives the file's texts; rows, bytes, md5."""
    put, count = _Writer(out), 0
    kinds = {f["name"]: f["type"] for f in r.schema.fields}

    def rows() -> Iterator[dict]:
        nonlocal count
        for row in r.df.orderBy(ORDER).select(*[col(n) for n in kinds]).toLocalIterator(prefetchPartitions=True):
            count += 1
            yield {n: from_spark(v, kinds[n]) for n, v in zip(kinds, row, strict=True)}

    for text in formatter(rows(), r.schema.descriptor):
        put(text)
    return count, put.size, put.hash.hexdigest()


def _path(r: Resource, form: str, forced: bool, own: dict) -> tuple[str, str | None]:
    """Where a resource goes, and in which format; None where its name's ending has none."""
    path = r.properties.get("path") or f"{r.name}.{form}"
    path = path[0] if isinstance(path, list) else path
    path = re.sub(r"^([a-z]+:/)?/+", "", path)
    if forced:
        return os.path.splitext(path)[0] + "." + form, form
    end = os.path.splitext(path)[1].lstrip(".")
    return path, end if end in MEDIA or end in own else None


def _dump(name: str, form: str, forced: bool, titles: bool, temporal: str | None, options: dict, target: Callable) -> Step:
    """Files of all resources, then the descriptor. ``target`` opens a place to put them."""
    form = "xlsx" if form == "excel" else form
    own = options.get("file_formatters") or {}
    counters = {**COUNTERS, **(options.get("counters") or {})}
    if form not in (*MEDIA, "parquet", *own):
        raise ValueError(f"no format {form!r}")

    def plan(package: Package, c: Context) -> Package:
        rows = size = 0
        digests, done = [], []
        place = target()
        for r in package.resources:
            r = with_order(r)
            if checks := options.get("validator_options"):  # rows are held against the schema as they are written
                r = r.with_(df=cast_fields(r.df, r.schema.fields, r.schema.missing_values, checks.get("on_error", "raise"), r.name))
            if form == "parquet":
                done.append(r.with_(df=place.table(r), properties={**r.properties, "path": r.name, "format": "parquet"}))
                count = done[-1].df.count()
                rows += count
                _put(done[-1].properties, counters["resource-rowcount"], count)
                continue
            path, kind = _path(r, form, forced, own)
            if kind is None:
                done.append(r)
                continue
            with place.file() as (out, publish):
                if kind in own:
                    count, n, digest = _write_own(own[kind], r, out)
                elif kind == "xlsx":
                    count, n, digest = _write_book(r, out, titles, temporal, options, place, path)
                else:
                    count, n, digest = _write_one(r, kind, out, titles, temporal)
                if options.get("add_filehash_to_path"):
                    path = f"{os.path.dirname(path)}/{digest}/{os.path.basename(path)}".lstrip("/")
                publish(path)
            rows, size = rows + count, size + n
            digests.append(digest)
            facts = {"path": path, "format": kind, "mediatype": MEDIA.get(kind, f"text/{kind}")}
            for name, value in (("resource-rowcount", count), ("resource-bytes", n), ("resource-hash", digest)):
                _put(facts, counters[name], value)
            if kind == "csv":
                facts |= {"encoding": "utf-8", "dialect": {"lineTerminator": "\r\n", "delimiter": ",", "doubleQuote": True, "quoteChar": '"', "skipInitialSpace": False}}
            schema = r.schema.copy()
            for f in schema.fields:
                if f["type"] in PATTERNS:
                    f["format"] = (f.get(temporal) if temporal else None) or PATTERNS[f["type"]]
            described = r.with_(properties={**r.properties, **facts}, schema=schema)
            done.append(r.with_(properties={**described.properties, "_described": described.descriptor}))
        digest = hashlib.md5("".join(sorted(digests)).encode()).hexdigest()
        facts: dict = {}
        for name, value in (("datapackage-rowcount", rows), ("datapackage-bytes", size), ("datapackage-hash", digest)):
            _put(facts, counters[name], value)
        listed = [r.properties.get("_described") or r.descriptor for r in done]
        for d in listed:
            d.pop("_described", None)
            d.pop("_written", None)
        descriptor = {**package.metadata, "resources": listed, **facts}
        place.text("datapackage.json", json.dumps(descriptor, indent=2 if options.get("pretty_descriptor", True) else None, ensure_ascii=False, default=str))
        place.close()
        clean = [r.with_(properties={**{k: v for k, v in r.properties.items() if k != "_described"}, "_written": True}) for r in done]
        stats = {"count_of_rows": rows, "bytes": size, "hash": digest, "dataset_name": package.metadata.get("name")}
        return package.with_(resources=tuple(clean), stats=(*package.stats, stats))

    return Step(name, plan, needs_order=True)


class _Opened:
    def __init__(self, enter: Callable, leave: Callable):
        self.enter, self.leave = enter, leave

    def __enter__(self) -> Any:
        return self.enter()

    def __exit__(self, kind: Any, *_: Any) -> None:
        self.leave(kind is None)


class _Folder:
    def __init__(self, path: str):
        self.path = path
        os.makedirs(path, exist_ok=True)

    def file(self) -> _Opened:
        beside = os.path.join(self.path, f".part-{os.getpid()}-{id(self)}")
        out = open(beside, "wb")  # noqa: SIM115

        def publish(path: str) -> None:
            out.close()
            full = os.path.join(self.path, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            os.replace(beside, full)

        return _Opened(lambda: (out, publish), lambda ok: out.close())

    def existing(self, path: str) -> str | None:
        return os.path.join(self.path, path)

    def table(self, r: Resource) -> DataFrame:
        path = os.path.join(self.path, r.name)
        r.rows.write.mode("overwrite").parquet(path)
        df = r.rows.sparkSession.read.parquet(path)
        return df.withColumn(ORDER, F.monotonically_increasing_id())

    def text(self, path: str, text: str) -> None:
        with open(os.path.join(self.path, path), "w", encoding="utf-8") as f:
            f.write(text)

    def close(self) -> None:
        pass


class _Archive:
    def __init__(self, path: str):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self.path = path
        self.zip = zipfile.ZipFile(path + ".part", "w", zipfile.ZIP_DEFLATED)

    def file(self) -> _Opened:
        beside = f"{self.path}.part-{id(self)}"
        out = open(beside, "wb")  # noqa: SIM115

        def publish(path: str) -> None:
            out.close()
            self.zip.write(beside, path)
            os.remove(beside)

        return _Opened(lambda: (out, publish), lambda ok: out.close())

    def existing(self, path: str) -> str | None:
        return None

    def table(self, r: Resource) -> DataFrame:
        raise ValueError("Parquet goes to folders only")

    def text(self, path: str, text: str) -> None:
        self.zip.writestr(path, text)

    def close(self) -> None:
        self.zip.close()
        os.replace(self.path + ".part", self.path)


def dump_to_path(out_path: str = ".", force_format: bool = True, format: str = "csv", use_titles: bool = False, temporal_format_property: str | None = None, **options: Any) -> Step:  # noqa: A002
    """A file for each resource and a descriptor, in a folder. ``format='parquet'`` writes in parallel, a folder for each resource."""
    return _dump("dump_to_path", format, force_format, use_titles, temporal_format_property, options, lambda: _Folder(out_path))


def dump_to_zip(out_file: str, force_format: bool = True, format: str = "csv", use_titles: bool = False, temporal_format_property: str | None = None, **options: Any) -> Step:  # noqa: A002
    """The same in an archive, which appears when it is whole."""
    return _dump("dump_to_zip", format, force_format, use_titles, temporal_format_property, options, lambda: _Archive(out_file))


# databases

_SQLITE = {"integer": "INTEGER", "number": "REAL", "boolean": "BOOLEAN", "year": "INTEGER"}


def dump_to_sql(tables: dict[str, dict], engine: str = "env://MILLRACE_DB_ENGINE", updated_column: str | None = None, updated_id_column: str | None = None, batch_size: int = 1000, **_: Any) -> Step:
    """Resources to tables: ``{table: {resource-name, mode, update_keys, indexes_fields}}``; modes rewrite, append and update (by keys).

    sqlite files are written from the driver, a partition at a time; other engines through JDBC, where an update needs
    a staging table and so isn't offered.
    """

    def plan(package: Package, c: Context) -> Package:
        url = os.environ[engine[6:]] if engine.startswith("env://") else engine
        out = list(package.resources)
        for table, spec in tables.items():
            chosen = select(package, spec.get("resource-name", table))
            for i, r in enumerate(out):
                if r.name not in chosen:
                    continue
                mode = spec.get("mode", "rewrite")
                if mode not in ("rewrite", "append", "update"):
                    raise ValueError(f"unknown mode {mode!r}")
                keys = spec.get("update_keys") or r.schema.primary_key
                if mode == "update" and not keys:
                    raise ValueError("an update needs update_keys or a primary key")
                if url.startswith("sqlite:"):
                    out[i] = _to_sqlite(c, with_order(r), re.sub(r"^sqlite:(///)?", "", url), table, mode, keys, spec.get("indexes_fields") or [], updated_column, updated_id_column, batch_size)
                elif mode == "update":
                    raise ValueError("updates are offered for sqlite only")
                else:
                    r.rows.write.format("jdbc").options(url=url if url.startswith("jdbc:") else "jdbc:" + url, dbtable=table, batchsize=batch_size).mode("overwrite" if mode == "rewrite" else "append").save()
        return package.with_(resources=tuple(out))

    return Step("dump_to_sql", plan, needs_order=True)


def _to_sqlite(c: Context, r: Resource, path: str, table: str, mode: str, keys: list[str], indexes: list, flag: str | None, id_column: str | None, batch: int) -> Resource:
    q = lambda n: '"' + n.replace('"', '""') + '"'
    names = r.schema.names
    texts = [f["name"] for f in r.schema.fields if f["type"] in ("date", "datetime", "time", "duration")]
    rows = r.df.orderBy(ORDER).select(*[col(n).cast("string").alias(n) if n in texts else col(n) if not isinstance(r.df.schema[n].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(col(n)).alias(n) for n in names], ORDER)
    updated: list[tuple[int, bool, int]] = []
    with sqlite3.connect(path) as db:
        if mode == "rewrite":
            db.execute(f"DROP TABLE IF EXISTS {q(table)}")
        declared = ", ".join(f"{q(f['name'])} {_SQLITE.get(f['type'], 'TEXT')}" for f in r.schema.fields)
        db.execute(f"CREATE TABLE IF NOT EXISTS {q(table)} (id_ INTEGER PRIMARY KEY AUTOINCREMENT, {declared})" if id_column else f"CREATE TABLE IF NOT EXISTS {q(table)} ({declared})")
        for k, fields in enumerate([*indexes, *([keys] if mode == "update" else [])]):
            fields = [fields] if isinstance(fields, str) else fields
            db.execute(f"CREATE INDEX IF NOT EXISTS {q(f'{table}_ix{k}')} ON {q(table)} ({', '.join(map(q, fields))})")
        insert = f"INSERT INTO {q(table)} ({', '.join(map(q, names))}) VALUES ({', '.join('?' * len(names))})"
        change = f"UPDATE {q(table)} SET {', '.join(f'{q(n)} = ?' for n in names)} WHERE {' AND '.join(f'{q(k)} IS ?' for k in keys)}" if mode == "update" else ""
        pending: list[tuple] = []
        for row in rows.toLocalIterator():
            values = tuple(float(v) if type(v).__name__ == "Decimal" else v for v in row[: len(names)])
            hit = False
            if mode == "update":
                cursor = db.execute(change, (*values, *(values[names.index(k)] for k in keys)))
                hit = cursor.rowcount > 0
            if flag or id_column or mode == "update":
                last = 0 if hit else db.execute(insert, values).lastrowid
                updated.append((row[ORDER], hit, last))
            else:
                pending.append(values)
                if len(pending) >= batch:
                    db.executemany(insert, pending)
                    pending = []
        db.executemany(insert, pending)
    if not (flag or id_column):
        return r
    marks = c.spark.createDataFrame(updated, f"{ORDER} long, __hit boolean, __id long")
    df, schema = r.df.join(marks, ORDER, "left"), r.schema.copy()
    for name, source, kind in ((flag, "__hit", "boolean"), (id_column, "__id", "integer")):
        if name:
            df = df.withColumn(name, F.col(source))
            schema.fields.append({"name": name, "type": kind})
    return r.with_(df=df.select(*[col(n) for n in TableSchema(schema.fields).names], ORDER), schema=schema)

"""Python's text forms, templates and patterns as Spark expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..package import quoted


def col(name: str) -> Column:
    return F.col(quoted(name))


def python_text(c: Column, kind: T.DataType, null: str | None = "None") -> Column:
    """``str(value)`` of Python; ``null`` is what None prints as (None: stays null)."""
    if isinstance(kind, T.BooleanType):
        out = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _float_text(c.cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        out = F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return out if null is None else F.coalesce(out, F.lit(null))


def _float_text(c: Column) -> Column:
    size = F.abs(c)
    trimmed = lambda d: F.regexp_replace(F.regexp_replace(d.cast("string"), "0+$", ""), r"\.$", ".0")
    java = c.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).cast("int")
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    # three and more digits stay whole
    power = F.when(F.abs(exponent) > 99, F.concat(F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"))).otherwise(power)
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size >= 1e7) & (size < 1e16), trimmed(c.cast("decimal(38,12)")))
        .when((size >= 1e-4) & (size < 1e-3), trimmed(c.cast("decimal(38,25)")))
        .when(java.contains("E"), F.concat(mantissa, F.lit("e"), power))
        .otherwise(java)
    )


def python_pattern(pattern: str) -> str:
    """A Python pattern for Java: named groups are spelled otherwise."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")).replace(r"\Z", r"\z")


def python_replacement(text: str) -> str:
    """A Python replacement for Java: $ is literal, back-references are $n."""
    out = text.replace("$", r"\$")
    out = re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", out)
    return re.sub(r"\\(\d)", r"$\1", out)


#: strptime directives and the patterns of Spark: fixed values of both.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS",
    "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "xx", "%Z": "zzz", "%%": "'%'",
}


def python_time_pattern(pattern: str) -> str:
    """A strptime or strftime pattern as a datetime pattern of Spark."""
    out = []
    for part in re.findall(r"%.|[^%]+", pattern):
        if part[0] == "%":
            if part not in DIRECTIVES:
                raise ValueError(f"directive {part} has no counterpart")
            out.append(DIRECTIVES[part])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part.replace("'", "''")))
    return "".join(out)


class Template:
    """A Python format template over a row's fields."""

    def __init__(self, text: str):
        self.text = text
        self.parts = [(literal, name, spec or "", conversion) for literal, name, spec, conversion in string.Formatter().parse(text)]
        self.fields = [name for _, name, _, _ in self.parts if name is not None]

    def field_text(self, name: str, spec: str, kind: T.DataType, source: Column | None = None) -> Column:
        """A formatted field. Format specs with a counterpart are native, others run in Arrow batches."""
        c = col(name) if source is None else source
        if not spec:
            return python_text(c, kind)
        whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        if whole and re.fullmatch(r"0?\d*d?", spec):
            digits = re.fullmatch(r"(0?)(\d*)d?", spec)
            return F.format_string(f"%{digits[1] if digits[2] else ''}{digits[2]}d", c.cast("long"))
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) and re.fullmatch(r"0?\d*\.\d+f", spec):
            return F.format_string(f"%{spec}", c.cast("double"))
        return F.udf(lambda v: format(v, spec) if v is not None else "None", "string", useArrow=True)(c)

    def column(self, kinds: dict[str, T.DataType], number: Column | None = None) -> Column:
        """The formatted text; ``number`` stands for the field ``#``."""
        out: list[Column] = []
        for literal, name, spec, _ in self.parts:
            if literal:
                out.append(F.lit(literal))
            if name is not None:
                out.append(self.field_text(name, spec, T.LongType(), number) if name == "#" else self.field_text(name, spec, kinds[name]))
        return F.concat(*out) if out else F.lit("")


def key_columns(key: str | Sequence[str], kinds: dict[str, T.DataType], number: Column | None = None) -> Column:
    """A join key as text: a template, or fields joined by a colon."""
    template = Template(key if isinstance(key, str) else ":".join("{%s}" % k for k in key))
    return template.column(kinds, number)

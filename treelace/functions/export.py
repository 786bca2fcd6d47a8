"""JSON and YAML text, for values on the driver and for columns.

Keys are sorted, null leaves print null, non-finite floats print null, and finite floats print their
shortest digits without an exponent. Column forms are built from Spark's own functions.
"""

from __future__ import annotations

import base64
import decimal
import datetime as dt
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelace.functions.scalars import Scalar
from treelace.functions.value import Value

#: Characters with an escape of their own.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: str) -> str:
    return '"' + "".join(ESCAPES.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 0x20 else c) for c in text) + '"'


def float_text(v: float, single: bool = False) -> str:
    """Shortest digits that read back as v, written out in full: 1, 0.0000001, 100000000000000000000."""
    if not math.isfinite(v):
        return "null"
    if single:
        v = struct.unpack("f", struct.pack("f", v))[0]
        short = next(s for n in range(1, 18) if struct.unpack("f", struct.pack("f", float(s := f"{v:.{n}g}")))[0] == v)
    else:
        short = repr(v)
    out = format(decimal.Decimal(short), "f")
    return out.removesuffix(".0") if "." in out else out


def duration_text(nanos: int) -> str:
    """Seconds, with as many decimals as it takes."""
    sign, n = ("-" if nanos < 0 else ""), abs(nanos)
    whole, part = divmod(n, 10**9)
    return f"{sign}{whole}" + (f".{part:09d}".rstrip("0") if part else "")


def _clock(nanos: int) -> str:
    s, n = divmod(nanos, 10**9)
    text = f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    for digits in (3, 6, 9):  # fractions are cut to thousands
        if n and n % 10 ** (9 - digits) == 0:
            return f"{text}.{n // 10 ** (9 - digits):0{digits}d}"
    return text


def scalar_text(s: Scalar) -> str:
    v = s.value
    if v is None:
        return "null"
    match s.label:
        case "bool":
            return "true" if v else "false"
        case "f32" | "f64":
            return float_text(v, s.label == "f32")
        case "str":
            return quoted(v)
        case "bytes":
            return quoted(base64.b64encode(v).decode())
        case "uuid" | "rational":
            return quoted(str(v))
        case "date":
            return quoted(v.isoformat())
        case "time":
            return quoted(_clock(v))
        case "datetime":
            days, rest = divmod(v, 86_400 * 10**9)
            return quoted(f"{dt.date.fromordinal(days + dt.date(1970, 1, 1).toordinal()).isoformat()}T{_clock(rest)}Z")
        case "duration":
            return duration_text(v)
        case "bigfloat":
            d = decimal.Decimal(v)
            return format(d, "f") if d.is_finite() else "null"
    return str(v)


def to_json(value: Value, indent: int | None = None) -> str:
    """Compact text, or text indented by so many spaces a level; empty containers stay on one line."""
    out: list[str] = []
    _json(value, indent, 0, out)
    return "".join(out)


def _json(value: Value, indent: int | None, depth: int, out: list[str]) -> None:
    if value.kind == "leaf":
        out.append(scalar_text(value.data))
        return
    is_list = value.kind == "list"
    opening, closing = "[]" if is_list else "{}"
    keys = range(len(value.data)) if is_list else value.keys()
    out.append(opening)
    line = lambda d: "\n" + " " * (indent * d) if indent is not None else ""
    for k, key in enumerate(keys):
        out.append(("," if k else "") + line(depth + 1))
        if not is_list:
            out.append(quoted(key) + (": " if indent is not None else ":"))
        _json(value.data[key], indent, depth + 1, out)
    out.append((line(depth) if keys else "") + closing)


def to_yaml(value: Value) -> str:
    """Block style; strings and keys are always quoted, a nested container starts on the next line."""
    return "\n".join(_yaml(value, 0)) + "\n"


def _yaml(value: Value, depth: int) -> list[str]:
    pad = "  " * depth
    if value.kind == "leaf":
        return [pad + scalar_text(value.data)]
    if not value.data:
        return [pad + ("[]" if value.kind == "list" else "{}")]
    out = []
    for key in range(len(value.data)) if value.kind == "list" else value.keys():
        head = pad + ("-" if value.kind == "list" else quoted(key) + ":")
        child = value.data[key]
        if child.kind != "leaf" and child.data:
            out += [head, *_yaml(child, depth + 1)]
        else:
            out.append(head + " " + _yaml(child, 0)[0])
    return out


# ---- columns


def quoted_column(text: Column) -> Column:
    """A string column in quotes, escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, e in ESCAPES.items():
        if c != "\\":
            out = F.replace(out, F.lit(c), F.lit(e))
    for n in range(0x20):
        if chr(n) not in ESCAPES:
            out = F.replace(out, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def float_column(v: Column) -> Column:
    """Shortest digits written out in full; null text for what is not finite."""
    text = v.cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.", "")
    point = F.length(F.regexp_extract(text, r"^-?([0-9]+)", 1)) + F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    size = F.length(digits)
    full = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )
    plain = F.when(F.instr(full, ".") > 0, F.regexp_replace(full, r"\.?0+$", "")).otherwise(full)
    plain = F.regexp_replace(plain, r"^0+(?=[0-9])", "")
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, F.concat(F.when(text.startswith("-"), "-").otherwise(""), plain)).otherwise("null")


def json_column(value: Column, kind: T.DataType, indent: int | None = None, depth: int = 0) -> Column:
    """JSON text of a column of any type, from its schema; keys are sorted, null is null."""
    line = lambda d: "\n" + " " * (indent * d) if indent is not None else ""
    colon = ": " if indent is not None else ":"
    none = F.lit("null")
    if isinstance(kind, T.StructType):
        if not kind.fields:
            return F.when(value.isNull(), none).otherwise("{}")
        parts = []
        for k, f in enumerate(sorted(kind.fields, key=lambda f: f.name.encode())):
            parts += [F.lit(("," if k else "") + line(depth + 1) + quoted(f.name) + colon), json_column(value[f.name], f.dataType, indent, depth + 1)]
        return F.when(value.isNull(), none).otherwise(F.concat(F.lit("{"), *parts, F.lit(line(depth) + "}")))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        is_map = isinstance(kind, T.MapType)
        if is_map:
            entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
            items = F.transform(entries, lambda e: F.concat(quoted_column(e["key"]), F.lit(colon), json_column(e["value"], kind.valueType, indent, depth + 1)))
        else:
            items = F.transform(value, lambda x: json_column(x, kind.elementType, indent, depth + 1))
        opening, closing = "{}" if is_map else "[]"
        full = F.concat(F.lit(opening + line(depth + 1)), F.array_join(items, "," + line(depth + 1)), F.lit(line(depth) + closing))
        return F.when(value.isNull(), none).when(F.size(value) == 0, opening + closing).otherwise(full)
    return F.coalesce(scalar_column(value, kind), none)


def scalar_column(value: Column, kind: T.DataType) -> Column:
    """Text of a scalar column, quoted where JSON asks for it."""
    if isinstance(kind, T.StringType):
        return quoted_column(value)
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit('"'), F.regexp_replace(F.base64(value), "[\r\n]", ""), F.lit('"'))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value.isNotNull(), float_column(value))
    if isinstance(kind, T.DateType):
        return F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(value, "SSSSSS")
        part = F.when(micros == "000000", "").when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
        return F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit('Z"'))
    if isinstance(kind, T.DayTimeIntervalType):
        part = lambda unit: F.extract(F.lit(unit), value).cast("long")
        whole = (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60).cast("decimal(18,0)")
        return F.regexp_replace((whole + F.extract(F.lit("SECOND"), value)).cast("string"), r"\.?0+$", "")
    return value.cast("string")


def yaml_column(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """Block YAML text of a column, without the last line break."""
    pad = "  " * depth
    if isinstance(kind, T.StructType) and kind.fields:
        lines = []
        for f in sorted(kind.fields, key=lambda f: f.name.encode()):
            lines.append(_entry(pad + quoted(f.name) + ":", value[f.name], f.dataType, depth))
        return F.when(value.isNull(), pad + "null").otherwise(F.concat_ws("\n", *lines))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: _entry(pad + "-", x, kind.elementType, depth))
        return F.when(value.isNull(), pad + "null").when(F.size(value) == 0, pad + "[]").otherwise(F.array_join(items, "\n"))
    return F.concat(F.lit(pad), F.when(value.isNull(), "null").otherwise(json_column(value, kind)))


def _entry(head: str, value: Column, kind: T.DataType, depth: int) -> Column:
    """A key or dash, and its value on the same line or, for a filled container, on the next."""
    flat = F.concat(F.lit(head + " "), json_column(value, kind))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(value.isNull(), flat).otherwise(F.concat(F.lit(head + "\n"), yaml_column(value, kind, depth + 1)))
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNull() | (F.size(value) == 0), flat).otherwise(F.concat(F.lit(head + "\n"), yaml_column(value, kind, depth + 1)))
    return flat

"""Scalar kinds, and the columns that hold a leaf of any kind.

A leaf is a tag and exactly one filled value column, so rows of mixed kinds sort by (tag, value)
with Spark's own ordering and without a user-defined function.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import struct
import uuid
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelace.functions.errors import Conversion, TypeMismatch

#: Labels of the scalar kinds in their sorting order; the position is the tag.
LABELS = (
    "null", "bool", "i8", "i16", "i32", "i64", "i128", "u8", "u16", "u32", "u64", "u128", "f32", "f64",
    "str", "bytes", "uuid", "date", "time", "datetime", "duration", "bigint",
)
TAG = {label: tag for tag, label in enumerate(LABELS)}
#: Big floats have six classes, each with its own tag, from 22 to 27; rationals follow.
BIGFLOAT_CLASSES = ("nan", "-inf", "negative", "zero", "positive", "inf")
TAG["bigfloat"], TAG["rational"] = 22, 28
WIDTHS = {f"{s}{w}": (-(1 << (w - 1)), (1 << (w - 1)) - 1) if s == "i" else (0, (1 << w) - 1) for s in "iu" for w in (8, 16, 32, 64, 128)}
VALUE_COLUMNS = ("v_bool", "v_int", "v_float", "v_str", "v_bin")
VALUE_SCHEMA = T.StructType(
    [
        T.StructField("tag", T.IntegerType()),
        T.StructField("v_bool", T.BooleanType()),
        T.StructField("v_int", T.DecimalType(38, 0)),
        T.StructField("v_float", T.DoubleType()),
        T.StructField("v_str", T.StringType()),
        T.StructField("v_bin", T.BinaryType()),
    ]
)
#: Value column of each label; whole numbers, days, and nanoseconds share one.
COLUMN_OF = dict.fromkeys(LABELS, "v_int") | {"bool": "v_bool", "f32": "v_float", "f64": "v_float", "str": "v_str", "bytes": "v_bin", "uuid": "v_bin", "bigint": "v_str", "null": "v_bool"}
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
LIMIT = 10**38


@dataclass(frozen=True)
class Scalar:
    """A tagged value. value is what Python has for the kind: int, float, str, bytes, uuid, date, or nanoseconds."""

    label: str
    value: object = None

    @property
    def tag(self) -> int:
        if self.label == "bigfloat":
            return TAG["bigfloat"] + _big_class(self.value)
        return TAG[self.label]

    def expect(self, label: str) -> object:
        """The value, if the kind is exactly this one: there is no coercion."""
        if label != self.label:
            raise TypeMismatch(label, self.label)
        return self.value

    def sort_key(self) -> tuple:
        """Total order: kinds first, then values; floats by IEEE total order, so -0.0 comes before 0.0."""
        v = self.value
        if self.label in ("f32", "f64"):
            bits = struct.unpack(">q", struct.pack(">d", v))[0]
            return (self.tag, bits if bits >= 0 else -(bits & ((1 << 63) - 1)) - 1)
        if self.label == "str":
            return (self.tag, v.encode())
        if self.label == "uuid":
            return (self.tag, v.bytes)
        if self.label == "date":
            return (self.tag, v.toordinal())
        if self.label == "rational":
            return (self.tag, Fraction(v))
        if self.label == "bigfloat":
            return (self.tag, decimal.Decimal(v)) if _big_class(v) in (2, 4) else (self.tag,)
        return (self.tag,) if v is None else (self.tag, v)

    def row(self) -> dict:
        """The leaf's columns."""
        out: dict = dict.fromkeys(VALUE_COLUMNS) | {"tag": self.tag}
        v, label = self.value, self.label
        if label == "null":
            return out
        if label == "uuid":
            out["v_bin"] = v.bytes
        elif label == "date":
            out["v_int"] = decimal.Decimal(v.toordinal() - EPOCH.toordinal())
        elif label in ("rational", "bigfloat"):
            out["v_str"] = str(v)
            if label == "rational":
                out["v_bin"] = rational_key(Fraction(v))
            elif _big_class(v) in (2, 4):
                out["v_bin"] = decimal_key(decimal.Decimal(v))
        elif label == "bigint" or isinstance(v, int) and not isinstance(v, bool) and abs(v) >= LIMIT:
            out["v_str"] = str(v)
            out["v_bin"] = decimal_key(decimal.Decimal(v))
        elif COLUMN_OF[label] == "v_int":
            out["v_int"] = decimal.Decimal(v)
            if label in ("i128", "u128"):  # these may exceed 38 digits, so all of them sort by one key
                out["v_bin"] = decimal_key(decimal.Decimal(v))
        else:
            out[COLUMN_OF[label]] = v
        return out

    @classmethod
    def from_row(cls, row) -> Scalar:
        tag = row["tag"]
        if 22 <= tag <= 27:
            return cls("bigfloat", row["v_str"])
        label = "rational" if tag == TAG["rational"] else LABELS[tag]
        if label == "null":
            return NULL
        if label == "uuid":
            return cls(label, uuid.UUID(bytes=bytes(row["v_bin"])))
        if label == "date":
            return cls(label, dt.date.fromordinal(int(row["v_int"]) + EPOCH.toordinal()))
        if label == "rational":
            return cls(label, Fraction(row["v_str"]))
        if label == "bytes":
            return cls(label, bytes(row["v_bin"]))
        if COLUMN_OF[label] == "v_int" or label == "bigint":
            return cls(label, int(row["v_int"] if row["v_int"] is not None else row["v_str"]))
        return cls(label, row[COLUMN_OF[label]])


NULL = Scalar("null")


def _big_class(v) -> int:
    d = decimal.Decimal(v)
    if d.is_nan():
        return 0
    if d.is_infinite():
        return 1 if d < 0 else 5
    return 3 if d == 0 else 2 if d < 0 else 4


def decimal_key(d: decimal.Decimal) -> bytes:
    """Bytes that sort as the finite decimal does: sign, exponent, digits; negative ones complemented."""
    if d == 0:
        return b"\x01"
    digits = "".join(map(str, d.as_tuple().digits)).lstrip("0")
    exponent = len(digits) + d.as_tuple().exponent
    body = struct.pack(">Q", exponent + (1 << 63)) + bytes(int(c) + 1 for c in digits.rstrip("0")) + b"\0"
    return b"\x02" + body if d > 0 else b"\x00" + bytes(255 - b for b in body)


def rational_key(q: Fraction) -> bytes:
    """Bytes that sort as the fraction does: the terms of its continued fraction, every second one turned round.

    The end of the expansion counts as an infinite term.
    """
    n, d, out, turn = q.numerator, q.denominator, b"", False
    while True:
        term, n = divmod(n, d)
        key = b"\x01" + decimal_key(decimal.Decimal(term))
        out += bytes(255 - b for b in key) if turn else key
        n, d, turn = d, n, not turn
        if d == 0:
            return out + (b"\x00" if turn else b"\xff")


def scalar(value, label: str | None = None) -> Scalar:
    """Tag a Python value; label chooses among kinds that Python has one type for (int: i64, float: f64)."""
    if isinstance(value, Scalar):
        return value
    if value is None:
        return NULL
    if label is None:
        for kind, name in ((bool, "bool"), (int, "i64"), (float, "f64"), (str, "str"), (bytes, "bytes"), (uuid.UUID, "uuid"), (dt.datetime, "datetime"), (dt.date, "date"), (dt.time, "time"), (dt.timedelta, "duration"), (decimal.Decimal, "bigfloat"), (Fraction, "rational")):
            if isinstance(value, kind):
                label = name
                break
        else:
            raise Conversion(f"no scalar kind for {type(value).__name__}")
    if label in WIDTHS:
        low, high = WIDTHS[label]
        if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
            raise Conversion(f"{value!r} is no {label}")
    elif label == "f32":
        value = struct.unpack("f", struct.pack("f", value))[0]
    elif label == "datetime" and isinstance(value, dt.datetime):
        value = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        value = (value - EPOCH) // dt.timedelta(microseconds=1) * 1000
    elif label == "time" and isinstance(value, dt.time):
        value = ((value.hour * 60 + value.minute) * 60 + value.second) * 10**9 + value.microsecond * 1000
    elif label == "duration" and isinstance(value, dt.timedelta):
        value = value // dt.timedelta(microseconds=1) * 1000
    elif label == "bigint":
        value = int(value)
    return Scalar(label, value)


#: Scalar label of Spark types; the unsigned ones have no Spark type and come from labels only.
_SPARK = {T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64", T.StringType: "str", T.BinaryType: "bytes", T.BooleanType: "bool", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.NullType: "null", T.DayTimeIntervalType: "duration"}


def label_of(kind: T.DataType) -> str:
    """Scalar label of a Spark type."""
    if isinstance(kind, T.DecimalType):
        if kind.scale:
            return "bigfloat"
        return "u64" if kind.precision == 20 else "i128"
    for spark_type, label in _SPARK.items():
        if isinstance(kind, spark_type):
            return label
    raise Conversion(f"no scalar kind for {kind.simpleString()}")


def leaf_columns(value: Column, label: str) -> dict[str, Column]:
    """Leaf columns of a typed Spark column; a null value is a null leaf."""
    none = {f.name: F.lit(None).cast(f.dataType) for f in VALUE_SCHEMA}
    if label == "null":
        return none | {"tag": F.lit(TAG["null"])}
    where = COLUMN_OF[label]
    if label == "date":
        filled = F.unix_date(value).cast("decimal(38,0)")
    elif label == "datetime":
        filled = F.unix_micros(value.cast("timestamp")).cast("decimal(38,0)") * F.lit(1000)
        filled = filled.cast("decimal(38,0)")
    elif label == "duration":
        part = lambda unit: F.extract(F.lit(unit), value).cast("decimal(20,6)")
        seconds = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60 + part("SECOND")
        filled = (seconds * 10**9).cast("decimal(38,0)")
    elif where == "v_int":
        filled = value.cast("decimal(38,0)")
    elif where == "v_float":
        filled = value.cast("double")
    else:
        filled = value
    return none | {"tag": F.when(value.isNull(), TAG["null"]).otherwise(TAG[label]), where: filled}


def order_columns(tag: Column, cols: dict[str, Column], descending: bool = False) -> list[Column]:
    """Sort columns of a leaf: nulls are lowest, kinds come before values, -0.0 before 0.0.

    A missing column counts as a null leaf. Negative NaN can't be told from NaN and sorts last.
    """
    keys = [F.coalesce(tag, F.lit(TAG["null"]))]
    keys += [cols["v_bool"], F.when(cols["v_bin"].isNull(), cols["v_int"]), cols["v_float"]]
    keys.append(F.when(cols["v_float"].cast("string") == "-0.0", 0).otherwise(1))
    keys += [F.when(cols["v_bin"].isNull(), cols["v_str"]), cols["v_bin"]]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def equals(tag: Column, cols: dict[str, Column], value: Scalar) -> Column:
    """Strict equality of a leaf with a scalar: the kinds must agree. A missing leaf equals null."""
    same = F.coalesce(tag, F.lit(TAG["null"])) == F.lit(value.tag)
    if value.label == "null":
        return same
    row = value.row()
    for name in VALUE_COLUMNS:
        if row[name] is not None:
            lit = F.lit(row[name]).cast(VALUE_SCHEMA[name].dataType)
            same = same & (cols[name] == lit)
            if name == "v_float" and not math.isnan(row[name]):
                same = same & ((cols[name].cast("string") == "-0.0") == F.lit(math.copysign(1, row[name]) < 0 and row[name] == 0))
    return same

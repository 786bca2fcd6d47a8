"""Paths, scalars, values and text: expectations by hand and by random trees."""

import datetime as dt
import decimal
import random
import uuid
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelace.functions import export
from treelace.functions.errors import Conversion, InvalidPath, SchemaMismatch, TypeMismatch
from treelace.functions.mapping import CASINGS, attr, document, index, recase
from treelace.functions.paths import Path, Pattern
from treelace.functions.scalars import NULL, Scalar, decimal_key, order_columns, rational_key, scalar
from treelace.functions.value import Value, of
from treelace.operators import nodes as N
from treelace.operators.index import IndexColumn, IndexDef, Registry


@pytest.mark.parametrize("text,shown", [("", ""), ("a/t[5]/x", "a/t[5]/x"), ("[3]/a[0][1]", "[3]/a[0][1]"), ("a/b/../c", "a/c"), (".foo", ".foo"), ("a/./b", "a/b"), ("a[1]/..", "a")])
def test_paths_are_read_and_shown(text, shown):
    assert str(Path.parse(text)) == shown


@pytest.mark.parametrize("text", ["a//b", "/a", "a/", "..", "a/../..", "a]b", "a[0]x", "a[", "a[-1]", "a[x]"])
def test_bad_paths(text):
    with pytest.raises(InvalidPath):
        Path.parse(text)


def test_path_steps():
    p = Path.parse("a/b[2]")
    assert p / "c" == Path.parse("a/b[2]/c") and p.parent() == Path.parse("a/b") and p.last() == 2
    assert p.push_name(".") == p and Path().push_name("..") == Path() and Path().parent() is None
    with pytest.raises(InvalidPath):
        p.push_name("x/y")
    assert Pattern.parse("org/*/members/*").matches(Path.parse("org/eng/members/x"))
    assert not Pattern.parse("a/*").matches(Path.parse("a/b/c")) and Pattern.parse("l/*").matches(Path.parse("l[3]")) is True


names = st.text("abcxyz._-", min_size=1, max_size=4).filter(lambda s: s not in (".", ".."))


@given(st.lists(st.one_of(names, st.integers(0, 99)), max_size=6))
def test_shown_paths_read_back(segments):
    p = Path(tuple(segments))
    assert Path.parse(str(p)) == p


LADDER = [
    NULL, scalar(False), scalar(True), scalar(-5, "i8"), scalar(7, "i8"), scalar(-(1 << 127), "i128"), scalar((1 << 127) - 1, "i128"), scalar(0, "u8"), scalar((1 << 128) - 1, "u128"),
    scalar(float("-inf")), scalar(-1.5), scalar(-0.0), scalar(0.0), scalar(2.5), scalar(float("inf")), scalar(""), scalar("a"), scalar("a\0"), scalar("ab"), scalar(b""), scalar(b"\0"), scalar(b"\xff"),
    scalar(uuid.UUID(int=1)), scalar(uuid.UUID(int=2)), scalar(dt.date(1969, 1, 1)), scalar(dt.date(2024, 1, 1)), scalar(dt.time(1)), scalar(dt.datetime(2024, 1, 1)), scalar(dt.timedelta(-1)), scalar(dt.timedelta(1)),
    scalar(-(10**40), "bigint"), scalar(-1, "bigint"), scalar(0, "bigint"), scalar(257, "bigint"), scalar(10**40, "bigint"),
]


def test_scalars_are_totally_ordered_and_read_back():
    assert sorted(random.Random(1).sample(LADDER, len(LADDER)), key=Scalar.sort_key) == LADDER
    for s in LADDER:
        assert Scalar.from_row(s.row()) == s


@pytest.mark.parametrize("down", [False, True])
def test_leaf_columns_sort_the_same_way(spark, down):
    nodes = N.local_frame(spark, [r for k, s in enumerate(LADDER) for r in N.value_rows(Path((k,)), Value(s))], N.NODE_SCHEMA)
    got = nodes.orderBy(F.rand(3)).orderBy(*order_columns(F.col("tag"), {c: F.col(c) for c in ("v_bool", "v_int", "v_float", "v_str", "v_bin")}, down)).select("path").collect()
    want = [f"[{k}]" for k in range(len(LADDER))]
    assert [r.path for r in got] == (want[::-1] if down else want)


def test_sort_keys_of_big_numbers():
    ds = [decimal.Decimal(x) for x in ("-1e50", "-257", "-256.5", "-0.001", "0", "1e-9", "0.1", "0.10001", "256", "1e30")]
    assert [decimal_key(d) for d in ds] == sorted(decimal_key(d) for d in ds)
    qs = sorted({Fraction(a, b) for a in range(-7, 8) for b in range(1, 9)})
    assert [rational_key(q) for q in qs] == sorted(rational_key(q) for q in qs)


def test_kinds_are_strict():
    with pytest.raises(TypeMismatch):
        scalar(1, "i32").expect("i64")
    with pytest.raises(Conversion):
        scalar(300, "u8")
    with pytest.raises(Conversion):
        scalar(object())


def test_values():
    v = of({"a": [1, {"b": 2}], "c": None})
    assert v.get_value("a[1]/b") == of(2) and v.get_value("a[9]") is None and v.get_value("a//b") is None
    assert v.set_value("a[2]", 3) and not v.set_value("a[9]", 1) and not v.set_value("c/x", 1) and v.set_value("n/l[0]/z", 1) and not v.set_value("n/m[1]", 1)
    assert export.to_json(v) == '{"a":[1,{"b":2},3],"c":null,"n":{"l":[{"z":1}]}}'
    lst = of([1])
    lst.push(2)
    lst.insert("k", 1)
    with pytest.raises(IndexError):
        lst.remove_at(5)
    assert lst.remove_at(0) == of(1) and lst.at(0) == of(2) and lst.keys() == []
    lst.clear()
    assert lst == of([]) and Value().as_leaf() == NULL


@pytest.mark.parametrize("value,text", [(1.0, "1"), (1e20, "100000000000000000000"), (1e-7, "0.0000001"), (float("nan"), "null"), (-0.5, "-0.5"), (0.1 + 0.2, "0.30000000000000004")])
def test_float_text(spark, value, text):
    assert export.float_text(value) == text
    assert spark.createDataFrame([(value,)], "v double").select(export.float_column(F.col("v"))).first()[0] == text


def test_scalar_text():
    t = export.scalar_text
    assert t(scalar(dt.timedelta(seconds=-90, milliseconds=-500))) == "-90.5" and t(scalar(dt.timedelta(seconds=90))) == "90"
    assert t(scalar(b"\0\1\2\xff")) == '"AAEC/w=="' and t(scalar(dt.date(2024, 2, 3))) == '"2024-02-03"'
    assert t(scalar(dt.datetime(2024, 2, 3, 4, 5, 6))) == '"2024-02-03T04:05:06Z"' and t(scalar('a"\\\n\x01é')) == '"a\\"\\\\\\n\\u0001é"'
    assert export.float_text(0.1, single=True) == "0.1"


trees = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.text(max_size=4)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(names, x, max_size=3)), max_leaves=12)


@given(trees)
@settings(max_examples=60, deadline=None)
def test_shredded_values_fold_back(tree):
    v = of(tree)
    rows = [dict(zip(N.NODE_SCHEMA.names, r)) for r in N.value_rows(Path.parse("x/y"), v)]
    random.Random(2).shuffle(rows)
    assert N.fold(rows, 2) == v


def test_casings():
    assert [recase("full_name", c) for c in CASINGS] == ["full_name", "FULL_NAME", "FullName", "fullName", "full_name", "FULL_NAME", "full-name", "FULL-NAME"]
    assert [recase("FooBar", c, True) for c in CASINGS] == ["foobar", "FOOBAR", "FooBar", "fooBar", "foo_bar", "FOO_BAR", "foo-bar", "FOO-BAR"]


def test_rejected_rules():
    with pytest.raises(Conversion):
        attr(flatten=True, rename="x")
    with pytest.raises(Conversion):
        attr(skip=True)
    with pytest.raises(Conversion):
        document(indexes=[index("i", "nope")])(__import__("dataclasses").make_dataclass("D", [("a", int)]))
    with pytest.raises(Conversion):
        document(type("Plain", (), {}))


def test_registry():
    r, d = Registry(), IndexDef("i", "a/*", (IndexColumn.asc("x"),))
    assert r.create(d) and not r.create(d) and not r.ensure(IndexDef("i", "b/*", ()))
    with pytest.raises(SchemaMismatch):
        r.create(IndexDef("i", "b/*", ()))
    assert Registry.from_dict(r.to_dict()) == r and r.delete("i") and not r.delete("i")
    r.create(d)
    assert r.ids["i"] == 1  # ids are not given again

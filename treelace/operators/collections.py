"""List and map algebra as column functions. Positions start at 0; maps are kept in key order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fail(ok: Column, index: Column, length: Column, value: Column) -> Column:
    """value where ok, else an error that names the position."""
    text = F.concat(F.lit("index "), index.cast("string"), F.lit(" out of range for length "), length.cast("string"))
    return F.when(ok, value).otherwise(F.raise_error(text))


# ---- lists


def length(arr) -> Column:
    return F.coalesce(F.size(_col(arr)), F.lit(0)).cast("long")


def is_empty(arr) -> Column:
    return length(arr) == 0


def item(arr, index, strict: bool = False) -> Column:
    """The element at a position; null beyond the list, or an error if strict."""
    a, i = _col(arr), F.lit(index) if isinstance(index, int) else index
    got = F.get(a, i.cast("int"))
    return _fail((i >= 0) & (i < F.size(a)), i, F.size(a), got) if strict else got


def first(arr) -> Column:
    return F.get(_col(arr), 0)


def last(arr) -> Column:
    return F.try_element_at(_col(arr), F.lit(-1))


def contains(arr, value) -> Column:
    """Whether an element equals the value; null equals null."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.exists(_col(arr), lambda x: x.eqNullSafe(v))


def push(arr, value) -> Column:
    return F.array_append(_col(arr), value if isinstance(value, Column) else F.lit(value))


def extend(arr, other) -> Column:
    return F.concat(_col(arr), _col(other))


def insert_at(arr, index: int, value) -> Column:
    """Insert before a position; one beyond the list appends."""
    a, v = _col(arr), value if isinstance(value, Column) else F.lit(value)
    head = F.slice(a, F.lit(1), F.least(F.lit(index), F.size(a)))
    return F.concat(head, F.array(v), F.slice(a, F.lit(index + 1), F.greatest(F.size(a) - index, F.lit(0))))


def remove_at(arr, index: int) -> Column:
    return F.filter(_col(arr), lambda _, k: k != index)


def remove_range(arr, start: int, end: int) -> Column:
    return F.filter(_col(arr), lambda _, k: (k < start) | (k >= end))


def move(arr, source: int, target: int) -> Column:
    """Move an element; a source beyond the list is an error, a target beyond it is its end."""
    a = _col(arr)
    rest = remove_at(a, source)
    to = F.least(F.lit(target), F.size(a) - 1)
    moved = F.concat(F.slice(rest, F.lit(1), to), F.array(F.get(a, source)), F.slice(rest, to + 1, F.size(a)))
    return _fail(F.size(a) > source, F.lit(source), F.size(a), moved)


def swap(arr, i: int, j: int) -> Column:
    a = _col(arr)
    out = F.transform(a, lambda x, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(x))
    return _fail(F.size(a) > max(i, j), F.lit(max(i, j)), F.size(a), out)


def swap_remove(arr, index: int) -> Column:
    """Remove an element and put the last one in its place; beyond the list nothing changes."""
    a = _col(arr)
    out = F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, k: F.when(k == index, last(a)).otherwise(x))
    return F.when(F.size(a) > index, out).otherwise(a)


def pop_first(arr) -> tuple[Column, Column]:
    """(popped element or null, the rest)."""
    a = _col(arr)
    return first(a), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def pop_last(arr) -> tuple[Column, Column]:
    a = _col(arr)
    return last(a), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def clear(arr) -> Column:
    """An empty list or map of the same type; null stays null."""
    a = _col(arr)
    return F.filter(a, lambda _: F.lit(False))


def retain(arr, keep: Callable[[Column], Column]) -> Column:
    return F.filter(_col(arr), keep)


def drain(arr, start: int, end: int) -> tuple[Column, Column]:
    """(removed elements, the rest)."""
    a = _col(arr)
    return F.slice(a, F.lit(start + 1), F.lit(max(end - start, 0))), remove_range(a, start, end)


# ---- maps


def entries(m) -> Column:
    """Entries in key order; values of any type, since keys alone are compared."""
    return F.array_sort(F.map_entries(_col(m)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def keys(m) -> Column:
    return F.array_sort(F.map_keys(_col(m)))


def values(m) -> Column:
    return F.transform(entries(m), lambda e: e["value"])


def contains_key(m, key: str) -> Column:
    return F.map_contains_key(_col(m), key)


def lookup(m, key: str) -> Column:
    return F.try_element_at(_col(m), F.lit(key))


def first_entry(m) -> Column:
    return F.get(entries(m), 0)


def last_entry(m) -> Column:
    return F.try_element_at(entries(m), F.lit(-1))


def insert(m, key: str, value) -> Column:
    return extend_map(m, F.create_map(F.lit(key), value if isinstance(value, Column) else F.lit(value)))


def remove_key(m, key: str) -> Column:
    return F.map_filter(_col(m), lambda k, _: k != key)


def pop_first_entry(m) -> tuple[Column, Column]:
    e = entries(m)
    return F.get(e, 0), F.map_from_entries(F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))))


def pop_last_entry(m) -> tuple[Column, Column]:
    e = entries(m)
    return F.try_element_at(e, F.lit(-1)), F.map_from_entries(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))))


def clear_map(m) -> Column:
    return F.map_filter(_col(m), lambda k, v: F.lit(False))


def retain_entries(m, keep: Callable[[Column, Column], Column]) -> Column:
    return F.map_filter(_col(m), keep)


def drain_map(m) -> tuple[Column, Column]:
    """(all entries in key order, the emptied map)."""
    return entries(m), clear_map(m)


def extend_map(m, other) -> Column:
    """Entries of both; where a key is in both, the other's value counts."""
    a, b = _col(m), _col(other)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


# ---- structs


def set_path(value: Column, kind: T.DataType, segments: tuple[str | int, ...], new: Column) -> Column:
    """value with what stands at segments replaced, by struct fields and list positions."""
    if not segments:
        return new
    s, rest = segments[0], segments[1:]
    if isinstance(s, int):
        return F.transform(value, lambda x, k: F.when(k == s, set_path(x, kind.elementType, rest, new)).otherwise(x))
    if isinstance(kind, T.MapType):
        return extend_map(value, F.create_map(F.lit(s), set_path(F.try_element_at(value, F.lit(s)), kind.valueType, rest, new)))
    inner = kind[s].dataType if s in kind.names else T.NullType()
    return value.withField(s, set_path(value[s], inner, rest, new) if rest else new)

"""Typed mapping: dataclasses and tagged unions to and from values, and the same rules for columns.

    @document(rename_all="camelCase", indexes=[index("by_age", "age")])
    @dataclass
    class User:
        name: str
        age: int = attr(label="u32", alias=["years"])
"""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelace.functions.errors import Conversion, Corrupt, PathNotFound, TreeError, TypeMismatch, UnexpectedNode
from treelace.functions.scalars import NULL, Scalar, scalar
from treelace.functions.value import Value, of

#: The names of the casings.
CASINGS = ("lowercase", "UPPERCASE", "PascalCase", "camelCase", "snake_case", "SCREAMING_SNAKE_CASE", "kebab-case", "SCREAMING-KEBAB-CASE")
_MISSING = dataclasses.MISSING
_EXCLUSIVE = ("rename", "alias", "skip", "skip_store", "skip_load", "skip_store_if", "default", "store_with", "load_with", "label")


def _words(name: str) -> list[str]:
    """Words of snake_case or PascalCase, in lower case."""
    if "_" in name or name.islower():
        return [w for w in name.split("_") if w]
    out: list[str] = []
    for c in name:
        if c.isupper() or not out:
            out.append("")
        out[-1] += c.lower()
    return out


def recase(name: str, casing: str | None, variant: bool = False) -> str:
    """A field's (snake_case) or variant's (PascalCase) name in a casing."""
    if casing is None:
        return name
    if casing not in CASINGS:
        raise Conversion(f"no casing {casing!r}")
    if casing in ("lowercase", "UPPERCASE"):  # these change letters only
        return name.lower() if casing == "lowercase" else name.upper()
    words = _words(name)
    if casing == "snake_case":
        return "_".join(words) if variant else name
    if casing == "SCREAMING_SNAKE_CASE":
        return "_".join(words).upper() if variant else name.upper()
    if casing in ("kebab-case", "SCREAMING-KEBAB-CASE"):
        text = "-".join(words) if variant else name.replace("_", "-")
        return text.upper() if casing.isupper() else text.lower() if variant else text
    text = "".join(w[:1].upper() + w[1:] for w in words)
    return text[:1].lower() + text[1:] if casing == "camelCase" else text


def attr(*, rename: str | None = None, alias=(), skip=False, skip_store=False, skip_load=False, skip_store_if: Callable | None = None, default=_MISSING, default_factory=_MISSING, store_with: Callable | None = None, load_with: Callable | None = None, flatten=False, label: str | None = None):
    """A dataclass field with mapping rules; default also gives the value where nothing is stored."""
    rules = {"rename": rename, "alias": tuple(alias), "skip": skip, "skip_store": skip_store, "skip_load": skip_load, "skip_store_if": skip_store_if, "store_with": store_with, "load_with": load_with, "flatten": flatten, "label": label, "default": default is not _MISSING or default_factory is not _MISSING}
    if flatten and any(rules[k] for k in _EXCLUSIVE):
        raise Conversion("flatten can't be combined with other rules")
    if skip and (skip_store or skip_load or skip_store_if or store_with or load_with):
        raise Conversion("skip can't be combined with other store or load rules")
    kw = {"default": default} if default is not _MISSING else {"default_factory": default_factory} if default_factory is not _MISSING else {}
    if not kw and (skip or skip_load):
        raise Conversion("a field that isn't loaded needs a default")
    return field(metadata={"tree": rules}, **kw)


@dataclass(frozen=True)
class _Field:
    name: str
    stored: str
    type: object
    rules: dict
    default: Callable | None


@dataclass(frozen=True)
class _Shape:
    fields: tuple[_Field, ...]
    indexes: tuple = ()
    via: tuple | None = None  # (to, back): another type stands for this one


@dataclass(frozen=True)
class IndexSpec:
    name: str
    columns: tuple[tuple[str, bool], ...]
    unique: bool = False


def index(name: str, *columns: str, unique: bool = False) -> IndexSpec:
    """An index over fields; "-field" sorts it the other way round."""
    return IndexSpec(name, tuple((c.removeprefix("-"), c.startswith("-")) for c in columns), unique)


def document(cls=None, *, rename_all: str | None = None, indexes=(), via: tuple | None = None):
    """Mark a dataclass as a document. via=(type, to, back) stores it as another type."""

    def mark(c):
        if not dataclasses.is_dataclass(c):
            raise Conversion(f"{c.__name__} is no dataclass")
        hints = typing.get_type_hints(c, include_extras=True)
        fields = []
        for f in dataclasses.fields(c):
            rules = f.metadata.get("tree", {})
            default = f.default_factory if f.default_factory is not _MISSING else (lambda d=f.default: d) if f.default is not _MISSING else None
            fields.append(_Field(f.name, rules.get("rename") or recase(f.name, rename_all), hints[f.name], rules, default))
        names = {f.name for f in fields if not f.rules.get("skip") and not f.rules.get("flatten")}
        for spec in indexes:
            if missing := [n for n, _ in spec.columns if n not in names]:
                raise Conversion(f"index {spec.name}: no field {missing[0]}")
        c._tree_shape = _Shape(tuple(fields), tuple(indexes), via)
        c.TYPE_NAME = c.__name__
        c.FIELDS = tuple(f.stored for f in fields if f.name in names)
        return c

    return mark if cls is None else mark(cls)


def tagged(*, tag: str | None = None, content: str | None = None, untagged: bool = False, rename_all: str | None = None, expecting: str | None = None):
    """Mark a class as a union; its variants are added with .variant.

    Neither tag nor content: {Variant: payload}; both: {tag, content}; tag alone: the payload's
    fields beside the tag; untagged: the payload alone, and the first variant that loads.
    """
    if untagged and (tag or content) or content and not tag:
        raise Conversion("content needs a tag, and an untagged union has neither")

    def mark(c):
        c._tree_union = {"tag": tag, "content": content, "untagged": untagged, "rename_all": rename_all, "expecting": expecting, "variants": []}
        c.TYPE_NAME = c.__name__

        def variant(v=None, *, rename: str | None = None, alias=(), other: bool = False):
            def add(x):
                u = c._tree_union
                if other and (u["untagged"] or any(y["other"] for y in u["variants"]) or dataclasses.fields(x)):
                    raise Conversion("other must be the one unit variant that takes unknown tags")
                u["variants"].append({"cls": x, "name": rename or recase(x.__name__, u["rename_all"], True), "alias": tuple(alias), "other": other})
                x._tree_variant_of = c
                c.VARIANTS = tuple(y["name"] for y in u["variants"])
                return x if hasattr(x, "_tree_shape") else document(x)

            return add if v is None else add(v)

        c.variant = staticmethod(variant)
        return c

    return mark


def positional(cls) -> bool:
    """Whether a variant's fields are numbered (_0, _1, ...) rather than named."""
    fs = dataclasses.fields(cls)
    return bool(fs) and all(f.name == f"_{k}" for k, f in enumerate(fs))


# ---- storing


def to_value(obj, label: str | None = None) -> Value:
    cls = type(obj)
    if isinstance(obj, (Value, Scalar)):
        return of(obj)
    if hasattr(cls, "_tree_variant_of"):
        return _store_variant(obj)
    if "_tree_shape" in cls.__dict__:
        shape: _Shape = cls._tree_shape
        return to_value(shape.via[1](obj)) if shape.via else Value(_store_fields(obj, shape))
    if isinstance(obj, dict):
        return Value({k: to_value(v, label) for k, v in obj.items()})
    if isinstance(obj, (list, tuple)):
        return Value([to_value(v, label) for v in obj])
    return Value.leaf(obj, label)


def _store_fields(obj, shape: _Shape) -> dict:
    out: dict[str, Value] = {}
    for f in shape.fields:
        v, r = getattr(obj, f.name), f.rules
        if r.get("skip") or r.get("skip_store") or r.get("skip_store_if") and r["skip_store_if"](v):
            continue
        if r.get("store_with"):
            v = r["store_with"](v)
        stored = to_value(v, r.get("label") if v is not None else None)
        if r.get("flatten"):
            out.update(stored.as_node() or {})
        else:
            out[f.stored] = stored
    return out


def _store_variant(obj) -> Value:
    cls = type(obj)
    u = cls._tree_variant_of._tree_union
    name = next(v["name"] for v in u["variants"] if v["cls"] is cls)
    fields = _store_fields(obj, cls._tree_shape)
    many = positional(cls)
    inner = Value([fields[f.stored] for f in cls._tree_shape.fields]) if many else Value(fields)
    payload = None if not fields else inner.data[0] if many and len(fields) == 1 else inner
    if u["untagged"]:
        return payload or Value(NULL)
    if u["content"]:
        return Value({u["tag"]: Value.leaf(name)} | ({u["content"]: payload} if payload else {}))
    if u["tag"]:
        flat = {str(k): v for k, v in enumerate(inner.data)} if many else fields
        return Value({u["tag"]: Value.leaf(name)} | flat)
    return Value({name: payload or Value(NULL)})


# ---- loading


def from_value(kind, value: Value | None, path: str = ""):
    """A typed value; value is None where nothing stands."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        inner = next(a for a in args if a is not type(None))
        return None if value is None or value.data == NULL else from_value(inner, value, path)
    if origin is list:
        if value is None:
            return []
        if value.kind != "list":
            raise UnexpectedNode(path, "list", value.kind)
        return [from_value(args[0], v, f"{path}[{k}]") for k, v in enumerate(value.data)]
    if origin is dict:
        if value is None:
            return {}
        if value.kind != "object":
            raise UnexpectedNode(path, "object", value.kind)
        return {k: from_value(args[1], value.data[k], f"{path}/{k}") for k in value.keys()}
    if kind is Value:
        return value if value is not None else Value()
    if "_tree_union" in getattr(kind, "__dict__", {}):
        return _load_union(kind, value, path)
    if "_tree_shape" in getattr(kind, "__dict__", {}):
        shape: _Shape = kind._tree_shape
        if shape.via:
            try:
                return shape.via[2](from_value(shape.via[0], value, path))
            except (ValueError, TypeError) as e:
                raise Conversion(str(e)) from e
        return _load_fields(kind, shape, value, path)
    return _load_leaf(kind, value, path)


def _load_leaf(kind, value: Value | None, path: str, label: str | None = None):
    if value is None:
        raise PathNotFound(path)
    if value.kind != "leaf":
        raise UnexpectedNode(path, "leaf", value.kind)
    if label is not None:
        return value.data.expect(label)
    v = value.data.value
    if isinstance(kind, type) and (not isinstance(v, kind) or kind is int and isinstance(v, bool)):
        raise TypeMismatch(kind.__name__, value.data.label)
    return v


def _load_fields(cls, shape: _Shape, value: Value | None, path: str):
    if value is not None and value.kind != "object":
        raise UnexpectedNode(path, "object", value.kind)
    node = value.data if value is not None else {}
    out = {}
    for f in shape.fields:
        r = f.rules
        if r.get("flatten"):
            out[f.name] = from_value(f.type, value, path)
            continue
        if r.get("skip") or r.get("skip_load"):
            out[f.name] = f.default()
            continue
        child = next((node[n] for n in (f.stored, *r.get("alias", ())) if n in node), None)
        where = f"{path}/{f.stored}" if path else f.stored
        if child is None and r.get("default"):
            out[f.name] = f.default()
        elif r.get("load_with"):
            if child is None:
                raise PathNotFound(where)
            out[f.name] = r["load_with"](child.data.value if child.kind == "leaf" else child)
        elif r.get("label") and not typing.get_args(f.type):
            out[f.name] = _load_leaf(f.type, child, where, r["label"])
        else:
            out[f.name] = from_value(f.type, child, where)
    return cls(**out)


def _load_variant(v: dict, payload: Value | None, path: str):
    cls = v["cls"]
    fields = cls._tree_shape.fields
    if not fields:
        return cls()
    if positional(cls):
        if len(fields) == 1:
            return cls(from_value(fields[0].type, payload, path))
        if payload is None or payload.kind != "list" or len(payload.data) != len(fields):
            raise UnexpectedNode(path, "list", payload.kind if payload else "absent")
        return cls(*(from_value(f.type, x, f"{path}[{k}]") for k, (f, x) in enumerate(zip(fields, payload.data))))
    if payload is None:
        raise PathNotFound(path)
    return _load_fields(cls, cls._tree_shape, payload, path)


def variant_of(union, value: Value) -> str:
    """Name of the variant that a stored value is tagged with."""
    u = union._tree_union
    if u["untagged"]:
        raise Corrupt("an untagged union stores no tag")
    if value is None or value.kind != "object":
        raise UnexpectedNode("", "object", value.kind if value else "absent")
    if not u["tag"]:
        if not value.data:
            raise Corrupt(u["expecting"] or "no variant")
        return value.keys()[0]
    tag = value.get(u["tag"])
    if tag is None:
        raise PathNotFound(u["tag"])
    return _load_leaf(str, tag, u["tag"], "str")


def _load_union(union, value: Value | None, path: str):
    u = union._tree_union
    if value is None:
        raise PathNotFound(path)
    if u["untagged"]:
        for v in u["variants"]:
            try:
                unit = not v["cls"]._tree_shape.fields
                if unit and value.data != NULL:
                    continue
                return _load_variant(v, value, path)
            except TreeError:
                continue
        raise Corrupt(u["expecting"] or f"no variant of {union.__name__} fits")
    name = variant_of(union, value)
    v = next((v for v in u["variants"] if name == v["name"] or name in v["alias"]), None) or next((v for v in u["variants"] if v["other"]), None)
    if v is None:
        raise Corrupt(u["expecting"] or f"{union.__name__} has no variant {name!r}")
    if v["other"]:
        return v["cls"]()
    if u["content"]:
        return _load_variant(v, value.get(u["content"]), f"{path}/{u['content']}")
    if u["tag"]:
        if positional(v["cls"]):
            items = [value.get(str(k)) for k in range(len(v["cls"]._tree_shape.fields))]
            return v["cls"](*(from_value(f.type, x, f"{path}/{k}") for k, (f, x) in enumerate(zip(v["cls"]._tree_shape.fields, items))))
        return _load_variant(v, value, path)
    return _load_variant(v, value.data[name], f"{path}/{name}")


def indexes_of(cls, pattern: str) -> list:
    """Index definitions of a document class at a pattern, over the fields' stored names."""
    from treelace.operators.index import IndexColumn, IndexDef

    stored = {f.name: f.stored for f in cls._tree_shape.fields}
    return [IndexDef(s.name, pattern, tuple(IndexColumn(stored[n], d) for n, d in s.columns), s.unique) for s in cls._tree_shape.indexes]


# ---- columns


@dataclass(frozen=True)
class Rule:
    """How a column is stored: under a name, maybe changed, maybe left out."""

    column: str
    name: str | None = None
    store: Callable[[Column], Column] | None = None
    skip_if: Callable[[Column], Column] | None = None
    #: Fields of a struct column that stand beside the others instead of below it.
    flatten: tuple[str, ...] = ()


def document_column(rules: list[Rule], rename_all: str | None = None) -> Column:
    """Struct of a row's columns by their stored names; a value that is left out is null, and absent in `present`."""
    fields = []
    for r in rules:
        c = F.col(r.column)
        if r.flatten:
            if r.name or r.store or r.skip_if:
                raise Conversion("flatten can't be combined with other rules")
            fields += [c[f].alias(recase(f, rename_all)) for f in r.flatten]
            continue
        v = r.store(c) if r.store else c
        fields.append((F.when(~r.skip_if(c), v) if r.skip_if else v).alias(r.name or recase(r.column, rename_all)))
    return F.struct(*fields)


def present_column(rules: list[Rule], rename_all: str | None = None) -> Column:
    """Names of the fields that are stored: what tells an absent one from a null."""
    return F.array_compact(F.array(*[F.when(~r.skip_if(F.col(r.column)) if r.skip_if else F.lit(True), F.lit(r.name or recase(r.column, rename_all))) for r in rules]))


def unflattened(doc: Column, names: tuple[str, ...], rename_all: str | None = None) -> Column:
    """The struct whose fields were flattened into doc."""
    return F.struct(*[doc[recase(n, rename_all)].alias(n) for n in names])


def first_fitting(payloads: dict[str, Column | None]) -> Column:
    """Name of an untagged union's variant: the first whose payload is there; a unit (None) always fits."""
    out = F.raise_error(F.lit("no variant fits")).cast("string")
    for name, p in reversed(payloads.items()):
        out = F.lit(name) if p is None else F.when(p.isNotNull(), F.lit(name)).otherwise(out)
    return out


def load_column(doc: Column, present: Column, names: list[str], default: Column | None = None) -> Column:
    """The first of the names that is present, though its value be null; the default where none is."""
    out = default if default is not None else F.lit(None)
    for n in reversed(names):
        out = F.when(F.array_contains(present, n), doc[n]).otherwise(out)
    return out


def union_column(tag: Column, payloads: dict[str, Column | None], encoding: str, tag_name: str = "kind", content: str = "data") -> Column:
    """A union as a struct: external (a field for each variant), adjacent (tag, content), internal (tag, payload fields) or untagged (payloads).

    payloads has each variant's struct or scalar, None for a unit.
    """
    if encoding == "external":
        return F.struct(*[F.when(tag == n, p if p is not None else F.lit(True)).alias(n) for n, p in payloads.items()])
    filled = {n: p for n, p in payloads.items() if p is not None}
    if encoding == "adjacent":
        return F.struct(tag.alias(tag_name), F.struct(*[F.when(tag == n, p).alias(n) for n, p in filled.items()]).alias(content))
    if encoding == "internal":
        return F.struct(tag.alias(tag_name), *[F.when(tag == n, p).alias(n) for n, p in filled.items()])
    if encoding == "untagged":  # payloads alone; first_fitting() names the variant
        return F.struct(*[F.when(tag == n, p).alias(n) for n, p in filled.items()])
    raise Conversion(f"no encoding {encoding!r}")


def known_tag(tag: Column, names: list[str], other: str | None = None, expecting: str | None = None) -> Column:
    """The tag, or `other` for an unknown one; without other an unknown tag is an error."""
    unknown = F.lit(other) if other is not None else F.raise_error(F.lit(expecting or "unknown variant"))
    return F.when(tag.isin(names), tag).otherwise(unknown)

"""Entity frames: one row for each document of a pattern, with the document as one nested column.

A path below an entity becomes a nested column expression, so Catalyst prunes the read schema and
pushes comparisons down to the files.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelace.functions.errors import PathNotFound, TypeMismatch, UnexpectedNode
from treelace.functions.export import json_column, yaml_column
from treelace.functions.paths import WILD, Path, Pattern
from treelace.functions.scalars import label_of


@dataclass(frozen=True)
class Entities:
    """df(ekey, path, doc): ekey is the entity's last segment, path its canonical path, doc its value."""

    df: DataFrame
    pattern: Pattern

    @classmethod
    def of(cls, df: DataFrame, pattern: str, key: str, doc: Column | None = None) -> Entities:
        """Rows of df as entities of a pattern whose only `*` is its last token; key names the column of their keys."""
        p = Pattern.parse(pattern)
        base = str(Path(p.segments[:-1]))
        ekey = F.col(key).cast("string")
        doc = F.struct(*[F.col(c) for c in df.columns]) if doc is None else doc
        return cls(df.select(ekey.alias("ekey"), F.concat(F.lit(base + "/" if base else ""), ekey).alias("path"), doc.alias("doc")), p)

    @property
    def doc_type(self) -> T.DataType:
        return self.df.schema["doc"].dataType

    def column(self, path: str | Path) -> Column:
        """What stands at a path below the entity, null where nothing does."""
        return resolve(F.col("doc"), self.doc_type, Path.parse(path))[0]

    def type_at(self, path: str | Path) -> T.DataType | None:
        return resolve(F.col("doc"), self.doc_type, Path.parse(path))[1]

    def get(self, path: str | Path, label: str | None = None) -> DataFrame:
        """(ekey, value): a scalar of each entity. A container is an error, and so is another kind than label."""
        kind = self.type_at(path)
        if kind is None:
            return self.df.select("ekey", F.lit(None).cast(T.NullType()).alias("value"))
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            raise UnexpectedNode(str(path), "leaf", kind_name(kind))
        if label is not None and label_of(kind) != label:
            raise TypeMismatch(label, label_of(kind))
        return self.df.select("ekey", self.column(path).alias("value"))

    def exists(self, path: str | Path) -> Column:
        """Whether the path leads somewhere: fields do always, list items and map keys where they are."""
        return present(F.col("doc"), self.doc_type, Path.parse(path))

    def kind(self, path: str | Path) -> Column:
        kind = self.type_at(path)
        return F.when(self.exists(path), F.lit(kind_name(kind) if kind is not None else None))

    def load(self, path: str | Path = "") -> DataFrame:
        """(ekey, value): the whole value at the path, typed."""
        if self.type_at(path) is None:
            raise PathNotFound(str(path))
        return self.df.select("ekey", self.column(path).alias("value"))

    def load_entity(self, key: str) -> DataFrame:
        return self.df.where(F.col("ekey") == key)

    def list_len(self, path: str | Path) -> Column:
        return F.coalesce(F.size(self.column(path)), F.lit(0)).cast("long")

    def object_keys(self, path: str | Path = "") -> Column:
        """Names of an object's children, sorted."""
        kind = self.type_at(path)
        if isinstance(kind, T.StructType):
            return F.array(*[F.lit(n) for n in sorted(kind.names, key=str.encode)])
        if isinstance(kind, T.MapType):
            return F.array_sort(F.map_keys(self.column(path)))
        raise UnexpectedNode(str(path), "object", kind_name(kind))

    def children(self, segments: str) -> Entities:
        """Entities one or more levels below: each `*` of segments explodes a list or a map.

        Children of a list have the position as their key, children of a map the map's key.
        """
        df, pattern, doc, kind = self.df, list(self.pattern.segments), F.col("doc"), self.doc_type
        path, ekey = F.col("path"), F.col("ekey")
        for s in Pattern.parse(segments).segments:
            pattern.append(s)
            if s != WILD:
                doc, kind = resolve(doc, kind, Path((s,)))
                path, ekey = F.concat(path, F.lit(f"[{s}]" if isinstance(s, int) else f"/{s}")), F.lit(str(s))
                continue
            df = df.select(path.alias("path"), doc.alias("doc"))
            if isinstance(kind, T.ArrayType):
                df = df.select("path", F.posexplode("doc").alias("pos", "item"))
                df = df.select(F.col("pos").cast("string").alias("ekey"), F.concat("path", F.lit("["), "pos", F.lit("]")).alias("path"), F.col("item").alias("doc"))
                kind = kind.elementType
            elif isinstance(kind, T.MapType):
                df = df.select("path", F.explode("doc").alias("k", "item"))
                df = df.select(F.col("k").alias("ekey"), F.concat("path", F.lit("/"), "k").alias("path"), F.col("item").alias("doc"))
                kind = kind.valueType
            else:
                raise UnexpectedNode(str(Pattern(tuple(pattern))), "list or map", kind_name(kind))
            path, ekey, doc = F.col("path"), F.col("ekey"), F.col("doc")
        return Entities(df.select(ekey.alias("ekey"), path.alias("path"), doc.alias("doc")), Pattern(tuple(pattern)))

    def under(self, root: str | Path) -> Entities:
        """Entities at or below a path; a root deeper than the pattern has none."""
        r = Path.parse(root)
        fits = len(r.segments) <= len(self.pattern.segments) and all(p in (WILD, s) for p, s in zip(self.pattern.segments, r.segments))
        if not fits:
            return replace(self, df=self.df.where(F.lit(False)))
        return self if r.is_root else replace(self, df=self.df.where(within(F.col("path"), r)))

    def to_json(self, indent: int | None = None) -> DataFrame:
        """(ekey, text): every entity as JSON."""
        return self.df.select("ekey", json_column(F.col("doc"), self.doc_type, indent).alias("text"))

    def to_yaml(self) -> DataFrame:
        return self.df.select("ekey", F.concat(yaml_column(F.col("doc"), self.doc_type), F.lit("\n")).alias("text"))


def within(path: Column, root: Path) -> Column:
    """Whether a path is root or lies below it."""
    text = str(root)
    return F.lit(True) if root.is_root else (path == text) | path.startswith(text + "/") | path.startswith(text + "[")


def kind_name(kind: T.DataType | None) -> str:
    return "absent" if kind is None else "object" if isinstance(kind, (T.StructType, T.MapType)) else "list" if isinstance(kind, T.ArrayType) else "leaf"


def resolve(value: Column, kind: T.DataType, path: Path) -> tuple[Column, T.DataType | None]:
    """(expression, type) of a path; a step that the type can't take leads nowhere: null, and no type."""
    for s in path.segments:
        if isinstance(s, int) and isinstance(kind, T.ArrayType):
            value, kind = F.get(value, s), kind.elementType
        elif isinstance(s, str) and isinstance(kind, T.StructType) and s in kind.names:
            value, kind = value[s], kind[s].dataType
        elif isinstance(s, str) and isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(s)), kind.valueType
        else:
            return F.lit(None), None
    return value, kind


def present(value: Column, kind: T.DataType, path: Path) -> Column:
    """Whether the path leads somewhere. Null fields are present; null containers have no children."""
    ok = F.lit(True)
    for s in path.segments:
        if isinstance(s, int) and isinstance(kind, T.ArrayType):
            ok = ok & F.coalesce(F.size(value) > s, F.lit(False))
            value, kind = F.get(value, s), kind.elementType
        elif isinstance(s, str) and isinstance(kind, T.StructType) and s in kind.names:
            ok = ok & value.isNotNull()
            value, kind = value[s], kind[s].dataType
        elif isinstance(s, str) and isinstance(kind, T.MapType):
            ok = ok & F.coalesce(F.map_contains_key(value, s), F.lit(False))
            value, kind = F.try_element_at(value, F.lit(s)), kind.valueType
        else:
            return F.lit(False)
    return ok

"""Indexes and ordered queries over entity frames.

An index is a definition: a pattern, ordered columns and a uniqueness flag. A query by it is one lazy
plan of filters and a sort, so equality on leading columns reaches the files as a pushed filter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelace.functions.errors import IndexArity, IndexNotFound, SchemaMismatch, UniqueViolation
from treelace.functions.paths import Path, Pattern
from treelace.functions.scalars import Scalar, label_of, scalar
from treelace.operators.entity import Entities
from treelace.sources.scratch import written


@dataclass(frozen=True)
class IndexColumn:
    """A path below the entity, and a direction; the empty path is the entity itself."""

    path: str
    descending: bool = False

    @classmethod
    def asc(cls, path: str = "") -> IndexColumn:
        return cls(str(Path.parse(path)))

    @classmethod
    def desc(cls, path: str = "") -> IndexColumn:
        return cls(str(Path.parse(path)), True)


@dataclass(frozen=True)
class IndexDef:
    name: str
    pattern: str
    columns: tuple[IndexColumn, ...]
    unique: bool = False

    def __post_init__(self):
        Pattern.parse(self.pattern)
        object.__setattr__(self, "columns", tuple(self.columns))

    def to_dict(self) -> dict:
        return {"name": self.name, "pattern": self.pattern, "unique": self.unique, "columns": [[c.path, c.descending] for c in self.columns]}

    @classmethod
    def from_dict(cls, d: dict) -> IndexDef:
        return cls(d["name"], d["pattern"], tuple(IndexColumn(p, x) for p, x in d["columns"]), d["unique"])


@dataclass
class Registry:
    """Index definitions of a table; names are unique, ids are never given twice."""

    defs: dict[str, IndexDef] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)
    next_id: int = 0

    def create(self, d: IndexDef) -> bool:
        """Register; True if it is new. The same definition again is fine, another of the name is not."""
        if d.name in self.defs:
            if self.defs[d.name] != d:
                raise SchemaMismatch(d.name)
            return False
        self.defs[d.name], self.ids[d.name] = d, self.next_id
        self.next_id += 1
        return True

    def ensure(self, d: IndexDef) -> bool:
        """Register if the name is free; an existing definition stays, whatever it says."""
        return d.name not in self.defs and self.create(d)

    def delete(self, name: str) -> bool:
        self.ids.pop(name, None)
        return self.defs.pop(name, None) is not None

    def get(self, name: str) -> IndexDef:
        if name not in self.defs:
            raise IndexNotFound(name)
        return self.defs[name]

    def has(self, name: str) -> bool:
        return name in self.defs

    def to_dict(self) -> dict:
        return {"next": self.next_id, "indexes": [d.to_dict() | {"id": self.ids[n]} for n, d in sorted(self.defs.items())]}

    @classmethod
    def from_dict(cls, d: dict) -> Registry:
        r = cls(next_id=d["next"])
        for x in d["indexes"]:
            r.defs[x["name"]], r.ids[x["name"]] = IndexDef.from_dict(x), x["id"]
        return r


def order_by(value: Column, kind: T.DataType | None, descending: bool) -> list[Column]:
    """Sort columns of one index column: null lowest; -0.0 before 0.0; a container or a missing path counts as null."""
    if kind is None or isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return []
    keys = [value]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        keys.append(F.when(value.cast("string") == "-0.0", 0).otherwise(1))
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def matches(value: Column, kind: T.DataType | None, wanted: Scalar) -> Column:
    """Strict equality: another kind never matches; null matches null, missing and containers."""
    leaf = kind is not None and not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    if wanted.label == "null":
        return value.isNull() if leaf else F.lit(True)
    if not leaf or label_of(kind) != wanted.label:
        return F.lit(False)
    lit = F.lit(wanted.value).cast(kind) if wanted.label != "datetime" else F.timestamp_micros(F.lit(wanted.value // 1000)).cast(kind)
    same = value == lit
    if wanted.label in ("f32", "f64") and wanted.value == 0:
        same = same & ((value.cast("string") == "-0.0") == F.lit(math.copysign(1, wanted.value) < 0))
    return same


class IndexQuery:
    """Lazy builder: prefix, direction and scope, then a DataFrame."""

    def __init__(self, entities: Entities, index: IndexDef):
        self._entities, self._index, self._prefix, self._reverse, self._root = entities, index, (), False, Path()

    def _with(self, **kw) -> IndexQuery:
        q = IndexQuery(self._entities, self._index)
        q.__dict__.update(self.__dict__ | kw)
        return q

    def prefixed(self, values) -> IndexQuery:
        """Equality on leading columns; fewer values than columns are fine, more are not."""
        got = tuple(scalar(v) for v in values)
        if len(got) > len(self._index.columns):
            raise IndexArity(f"{self._index.name} has {len(self._index.columns)} columns, got {len(got)} values")
        return self._with(_prefix=got)

    def reversed(self) -> IndexQuery:
        """Turn the whole order round, ties and nulls included."""
        return self._with(_reverse=not self._reverse)

    def under(self, root: str | Path) -> IndexQuery:
        return self._with(_root=Path.parse(root))

    def filtered(self) -> Entities:
        """The entities in scope that match the prefix, in no order."""
        e = self._entities.under(self._root)
        cond = F.lit(True)
        for c, v in zip(self._index.columns, self._prefix):
            cond = cond & matches(e.column(c.path), e.type_at(c.path), v)
        return Entities(e.df.where(cond) if self._prefix else e.df, e.pattern)

    def order(self) -> list[Column]:
        """Sort columns, with the entity's path as the last, so that ties have an order."""
        e = self._entities
        out = [k for c in self._index.columns for k in order_by(e.column(c.path), e.type_at(c.path), c.descending != self._reverse)]
        return [*out, F.desc("path") if self._reverse else F.asc("path")]

    def run(self) -> DataFrame:
        """(ekey, path, doc) in index order."""
        return self.filtered().df.orderBy(*self.order())


def query(entities: Entities, index: IndexDef) -> IndexQuery:
    return IndexQuery(entities, index)


def find(entities: Entities, index: IndexDef, values=()) -> DataFrame:
    return query(entities, index).prefixed(values).run()


def ranked(q: IndexQuery, *cols) -> DataFrame:
    """(rank long, cols...): the query's rows with their places in its order, from 1.

    The rows are sorted over all partitions and written; a row's place is its place in its
    partition plus the sizes of those before, so no task sees all rows.
    """
    at = F.monotonically_increasing_id().alias("_at")  # partition number, and place in the partition in the lower 33 bits
    rows = written(q.filtered().df.orderBy(*q.order()).select(*cols, at))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    names = rows.columns[:-1]
    placed = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return placed.select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"), *names)


def violations(entities: Entities, index: IndexDef) -> DataFrame:
    """(c0, c1, ..., n): column values that more than one entity has. A missing column is null, and nulls collide."""
    cols = [(entities.column(c.path) if entities.type_at(c.path) is not None else F.lit(None).cast("string")).alias(f"c{k}") for k, c in enumerate(index.columns)]
    return entities.df.select(*cols).groupBy(*[f"c{k}" for k in range(len(cols))]).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(entities: Entities, index: IndexDef) -> None:
    if index.unique and not violations(entities, index).isEmpty():
        raise UniqueViolation(index.name)

"""Node frames: one row for each node of a tree, for documents of any shape.

A node is its path, the path's segments as an array, a stable key, a kind (object, list, leaf) and
the columns of its scalar. Shredding and recomposing are expressions that follow a schema, so they
run inside Spark; batches of writes become one anti-join and one union.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from treelace.functions.errors import IndexOutOfRange, UnexpectedNode
from treelace.functions.paths import WILD, Path, Pattern
from treelace.functions.scalars import NULL, TAG, VALUE_COLUMNS, VALUE_SCHEMA, Scalar, label_of, leaf_columns
from treelace.functions.value import Value, of
from treelace.operators.entity import within
from treelace.sources.scratch import written

NODE_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("segs", T.ArrayType(T.StringType(), False)), T.StructField("skey", T.StringType()), T.StructField("kind", T.StringType()), *VALUE_SCHEMA.fields]
)
OBJECT, LIST, LEAF = "object", "list", "leaf"
#: Nanoseconds of a day.
DAY = 86_400_000_000_000
#: Roots up to which a removal is a plain filter; more are an anti-join.
FEW = 64


def path_text(segs: Column) -> Column:
    """Canonical path of a segment array: a slash before names, none before positions."""
    return F.regexp_replace(F.array_join(segs, "/"), r"/(?=\[[0-9]+\](?:/|$))", "")


def key_of(table: str, generation: int, path: str) -> str:
    """A node's key: a digest of where and when it was made, so that it is the same when recomputed."""
    return hashlib.sha256(f"{table}\0{generation}\0{path}".encode()).hexdigest()[:32]


def key_column(table: str, generation: int, path: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{table}\0{generation}\0"), path).cast("binary"), 256), 1, 32)


# ---- shredding


def _node(segs: Column, kind: str, leaf: dict[str, Column] | None = None) -> Column:
    none = {f.name: F.lit(None).cast(f.dataType) for f in VALUE_SCHEMA}
    cols = none | (leaf or {})
    return F.array(F.struct(segs.alias("segs"), F.lit(kind).alias("kind"), *[cols[f.name].cast(f.dataType).alias(f.name) for f in VALUE_SCHEMA]))


def shred_column(value: Column, kind: T.DataType, segs: Column) -> Column:
    """Array of the nodes of a typed value. A null container is a null leaf; empty containers are nodes of their own."""
    nil = _node(segs, LEAF, {"tag": F.lit(TAG["null"])})
    if isinstance(kind, T.StructType):
        parts = [shred_column(value[f.name], f.dataType, F.concat(segs, F.array(F.lit(f.name)))) for f in kind.fields]
        return F.when(value.isNull(), nil).otherwise(F.concat(_node(segs, OBJECT), *parts))
    if isinstance(kind, T.ArrayType):
        step = lambda x, k: shred_column(x, kind.elementType, F.concat(segs, F.array(F.concat(F.lit("["), k.cast("string"), F.lit("]")))))
        return F.when(value.isNull(), nil).otherwise(F.concat(_node(segs, LIST), F.flatten(F.transform(value, step))))
    if isinstance(kind, T.MapType):
        step = lambda e: shred_column(e["value"], kind.valueType, F.concat(segs, F.array(e["key"])))
        return F.when(value.isNull(), nil).otherwise(F.concat(_node(segs, OBJECT), F.flatten(F.transform(F.map_entries(value), step))))
    return _node(segs, LEAF, leaf_columns(value, label_of(kind)))


def shred(df: DataFrame, value: Column, kind: T.DataType, segs: Column, table: str = "", generation: int = 0) -> DataFrame:
    """Node frame of one value for each row, at the segments that segs gives."""
    nodes = df.select(F.explode(shred_column(value, kind, segs)).alias("n")).select("n.*")
    nodes = nodes.withColumn("path", path_text(F.col("segs")))
    return nodes.select("path", "segs", key_column(table, generation, F.col("path")).alias("skey"), "kind", *[f.name for f in VALUE_SCHEMA])


def value_rows(path: Path, value: Value, table: str = "", generation: int = 0, keys: dict[str, str] | None = None) -> list[tuple]:
    """Node rows of a driver value; keys has the keys of nodes that stood at a path before."""
    text = str(path)
    key = (keys or {}).get(text) or key_of(table, generation, text)
    head = (text, path.encoded(), key)
    if value.kind == "leaf":
        row = value.data.row()
        return [(*head, LEAF, *(row[f.name] for f in VALUE_SCHEMA))]
    out = [(*head, LIST if value.kind == "list" else OBJECT, *([None] * len(VALUE_SCHEMA)))]
    for k in range(len(value.data)) if value.kind == "list" else value.keys():
        out += value_rows(path.push_index(k) if isinstance(k, int) else path.push_name(k), value.data[k], table, generation, keys)
    return out


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A frame of the driver's own rows that lives in the plan, so the optimizer can fold it."""
    kinds = to_arrow_schema(schema)
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    table = pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds.types)], schema=pa.schema([pa.field(f.name, k) for f, k in zip(schema, kinds.types)]))
    return spark.createDataFrame(table, schema)


def empty(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [], NODE_SCHEMA)


# ---- recomposing


def _typed(leaf: Column, kind: T.DataType) -> Column:
    """The leaf as a typed column; a leaf of another kind is null."""
    label = label_of(kind)
    if label == "date":
        v = F.date_from_unix_date(leaf["v_int"].cast("int"))
    elif label == "datetime":
        v = F.timestamp_micros((leaf["v_int"] / 1000).cast("long")).cast(kind)
    elif label == "duration":
        v = F.make_dt_interval(days=F.floor(leaf["v_int"] / DAY).cast("int"), secs=(F.pmod(leaf["v_int"], F.lit(DAY)) / 10**9).cast("decimal(18,6)")).cast(kind)
    else:
        v = leaf[{"bool": "v_bool", "str": "v_str", "bytes": "v_bin", "f32": "v_float", "f64": "v_float"}.get(label, "v_int")].cast(kind)
    return F.when(leaf["tag"] == TAG[label], v)


#: Steps of a template that stand for any list position and any map key.
ITEM, KEY = object(), object()


def _fixed(kind: T.DataType, rel: tuple[str, ...] = ()):
    """(path, type) of a value and of all that a type places below it by name."""
    yield rel, kind
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _fixed(f.dataType, (*rel, f.name))


def _value(at, inner: dict, kind: T.DataType, rel: tuple[str, ...] = ()) -> Column:
    """The typed value at a path of a block; at gives nodes by path, inner the lists and maps that were built before."""
    if isinstance(kind, T.StructType):
        return F.when(at(rel)["kind"] == OBJECT, F.struct(*[_value(at, inner, f.dataType, (*rel, f.name)).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.when(at(rel)["kind"] == LIST, F.coalesce(inner[rel], F.array().cast(kind)))
    if isinstance(kind, T.MapType):
        return F.when(at(rel)["kind"] == OBJECT, F.coalesce(inner[rel], F.create_map().cast(kind)))
    return _typed(at(rel), kind)


def _holds_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType) or isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def _sorted(pairs: Column, kind: T.DataType) -> Column:
    """Pairs by their first field, which no two share; a comparator only where maps forbid the plain order."""
    if not _holds_map(kind):
        return F.array_sort(pairs)
    return F.array_sort(pairs, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def _blocks(nodes: DataFrame, template: tuple, kind: T.DataType) -> DataFrame:
    """(block, value): the values at a template's places, by their segments.

    A block is what a type places by name; lists and maps in it are built from blocks of their own,
    grouped by the container, so the work grows with the nodes and not with their squares.
    """
    n, fixed = len(template), list(_fixed(kind))
    cond = (F.size("segs") >= n) & (F.size("segs") <= n + max(len(r) for r, _ in fixed))
    for k, s in enumerate(template):
        if s is ITEM or s is KEY:
            cond = cond & (F.get("segs", k).startswith("[") if s is ITEM else ~F.get("segs", k).startswith("["))
        elif s != WILD:
            cond = cond & (F.get("segs", k) == s)
    rel = F.array_join(F.slice("segs", F.lit(n + 1), F.size("segs")), "/")
    rows = nodes.where(cond).select(F.slice("segs", F.lit(1), F.lit(n)).alias("block"), rel.alias("k"), F.struct("kind", "tag", *VALUE_COLUMNS).alias("v"))
    rows = rows.where(F.col("k").isin(["/".join(r) for r, _ in fixed]))
    if len(fixed) == 1:
        at = lambda r: F.col("v")
    else:
        rows = rows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
        at = lambda r: F.try_element_at("m", F.lit("/".join(r)))
    inner = {}
    for j, (r, c) in enumerate((r, c) for r, c in fixed if isinstance(c, (T.ArrayType, T.MapType))):
        is_map = isinstance(c, T.MapType)
        item = c.valueType if is_map else c.elementType
        last = F.element_at("block", -1)
        key = last if is_map else F.substr(last, F.lit(2), F.length(last) - 2).cast("int")
        pairs = _sorted(F.collect_list(F.struct(key.alias("key"), F.col("value"))), item)
        whole = F.map_from_entries(pairs) if is_map else F.transform(pairs, lambda x: x["value"])
        below = _blocks(nodes, (*template, *r, KEY if is_map else ITEM), item)
        rows = rows.join(below.groupBy(F.slice("block", F.lit(1), F.lit(n)).alias("block")).agg(whole.alias(f"in{j}")), "block", "left")
        inner[r] = F.col(f"in{j}")
    return rows.select("block", _value(at, inner, kind).alias("value"))


def recompose(nodes: DataFrame, pattern: str, kind: T.DataType) -> DataFrame:
    """(ekey, path, doc): the entities of a pattern, rebuilt as a type. What is missing or of another kind is null."""
    p = Pattern.parse(pattern)
    template = tuple(f"[{s}]" if isinstance(s, int) else s for s in p.segments)
    ekey = F.element_at("block", -1) if template else F.lit("")
    return _blocks(nodes, template, kind).select(ekey.alias("ekey"), path_text(F.col("block")).alias("path"), F.col("value").alias("doc"))


def load_value(nodes: DataFrame, path: str | Path = "") -> Value | None:
    """The subtree at a path as a driver value; None where nothing stands."""
    root = Path.parse(path)
    rows = nodes.where(within(F.col("path"), root)).collect()
    return fold(rows, len(root.segments))


def fold(rows, depth: int) -> Value | None:
    """Value of node rows whose root has so many segments."""
    by_depth = sorted(rows, key=lambda r: len(r["segs"]))
    made: dict[tuple, Value] = {}
    for r in by_depth:
        segs = tuple(r["segs"])
        made[segs] = Value(Scalar.from_row(r) if r["kind"] == LEAF else [] if r["kind"] == LIST else {})
    for segs, v in sorted(made.items(), key=lambda x: (len(x[0]), _position(x[0]))):
        if len(segs) > depth and (up := made.get(segs[:-1])) is not None:
            up.data.append(v) if isinstance(up.data, list) else up.data.__setitem__(segs[-1], v)
    return next((v for s, v in made.items() if len(s) == depth), None)


def _position(segs: tuple) -> tuple:
    return (0, int(segs[-1][1:-1])) if segs and segs[-1].startswith("[") else (1, 0)


# ---- lookups


def _under_pattern(p: Pattern) -> Column:
    cond = F.size("segs") >= len(p.segments)
    for k, s in enumerate(p.segments):
        if s != WILD:
            cond = cond & (F.get("segs", k) == (f"[{s}]" if isinstance(s, int) else s))
    return cond


def at_pattern(nodes: DataFrame, pattern: str, root: str | Path = "") -> DataFrame:
    """Nodes that a pattern matches exactly, within a root; a root deeper than the pattern gives none."""
    p, r = Pattern.parse(pattern), Path.parse(root)
    if len(r.segments) > len(p.segments):
        return nodes.where(F.lit(False))
    return nodes.where((F.size("segs") == len(p.segments)) & _under_pattern(p) & within(F.col("path"), r))


def children(nodes: DataFrame, path: str | Path) -> DataFrame:
    """Children of a container, objects by name and lists by position."""
    root = Path.parse(path)
    last = F.element_at("segs", -1)
    below = nodes.where((F.size("segs") == len(root.segments) + 1) & within(F.col("path"), root))
    return below.orderBy(F.regexp_extract(last, r"^\[([0-9]+)\]$", 1).try_cast("long").asc_nulls_first(), last)


def _named(name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType())])


def leaf_at(nodes: DataFrame, paths: Iterable[str | Path]) -> DataFrame:
    """Node rows of many paths, in one plan."""
    return nodes.where(F.col("path").isin([str(Path.parse(p)) for p in paths]))


# ---- writes


def without(nodes: DataFrame, roots: list[Path]) -> DataFrame:
    """Nodes outside all the subtrees of roots."""
    if not roots:
        return nodes
    if len(roots) <= FEW:
        cond = F.lit(False)
        for r in roots:
            cond = cond | within(F.col("path"), r)
        return nodes.where(~cond)
    spark = nodes.sparkSession
    for depth in sorted({len(r.segments) for r in roots}):
        nodes = cut(nodes, local_frame(spark, [(str(r),) for r in roots if len(r.segments) == depth], _named("root")), depth)
    return nodes


def cut(nodes: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Nodes outside the subtrees of roots(root), all of which have so many segments."""
    here = F.when(F.size("segs") >= depth, path_text(F.slice("segs", F.lit(1), F.lit(depth))))
    return nodes.withColumn("root", here).join(roots, "root", "left_anti").select(*NODE_SCHEMA.names)


def store_many(nodes: DataFrame, items: list[tuple[str | Path, object]], table: str = "", generation: int = 0) -> DataFrame:
    """Put values at paths, each replacing what stood there; missing containers on the way are made, in one plan."""
    rows, gone = store_rows(nodes, items, table, generation)
    return without(nodes, gone).unionByName(local_frame(nodes.sparkSession, rows, NODE_SCHEMA))


def store_rows(nodes: DataFrame, items: list[tuple[str | Path, object]], table: str = "", generation: int = 0) -> tuple[list[tuple], list[Path]]:
    """(rows, gone) of store_many: the nodes that come and the roots of the subtrees that go first.

    No path may lie within another. One query looks up all ancestors.
    Writing through a leaf or into the wrong kind of container raises UnexpectedNode; a list takes
    its length as the position that appends, and raises IndexOutOfRange beyond it.
    """
    todo = [(Path.parse(p), of(v)) for p, v in items]
    for a, b in zip(sorted(str(p) for p, _ in todo), sorted(str(p) for p, _ in todo)[1:]):
        if Path.parse(b).starts_with(Path.parse(a)):
            raise ValueError(f"{b!r} lies within {a!r}")
    around = {str(Path(p.segments[:k])) for p, _ in todo for k in range(len(p.segments) + 1)}
    spark = nodes.sparkSession
    names = F.broadcast(local_frame(spark, [(x,) for x in sorted(around)], _named("path")))  # as many as the call's own paths
    found = {r["path"]: r for r in nodes.join(names, "path", "left_semi").select("path", "kind", "skey").collect()}
    lists = [p for p, r in found.items() if r["kind"] == LIST]
    sizes: dict[str, int] = {}
    if lists:
        parent = path_text(F.slice("segs", F.lit(1), F.size("segs") - 1))
        ups = F.broadcast(local_frame(spark, [(x,) for x in lists], _named("parent")))
        sizes = {r["parent"]: r["n"] for r in nodes.where("size(segs) > 0").withColumn("parent", parent).join(ups, "parent").groupBy("parent").agg(F.count("*").alias("n")).collect()}
    kinds = {p: r["kind"] for p, r in found.items()}
    sizes = {p: sizes.get(p, 0) for p in lists}
    keys = {p: r["skey"] for p, r in found.items()}
    rows: list[tuple] = []
    for path, value in todo:
        for k, s in enumerate(path.segments):
            up = str(Path(path.segments[:k]))
            need = LIST if isinstance(s, int) else OBJECT
            if up not in kinds:
                kinds[up], sizes[up] = need, 0
                rows.append((up, Path(path.segments[:k]).encoded(), key_of(table, generation, up), need, *([None] * len(VALUE_SCHEMA))))
            if kinds[up] != need:
                raise UnexpectedNode(up, need, kinds[up])
            if need == LIST:
                if s > sizes[up]:
                    raise IndexOutOfRange(s, sizes[up])
                sizes[up] = max(sizes[up], s + 1)
        kinds[str(path)] = {"leaf": LEAF, "list": LIST, "object": OBJECT}[value.kind]
        if kinds[str(path)] == LIST:
            sizes[str(path)] = len(value.data)
        rows += value_rows(path, value, table, generation, keys)
    return rows, [p for p, _ in todo if str(p) in found]


def _reposition(nodes: DataFrame, path: Path, index: Column) -> DataFrame:
    """Renumber a list's items: index is the new position, given the old one as column `at`.

    Only the list's own nodes are written anew; all others stay as they are.
    """
    return nodes.where(~within(F.col("path"), path)).unionByName(renumbered(nodes, path, index))


def renumbered(nodes: DataFrame, path: Path, index: Column) -> DataFrame:
    """The list's own nodes after that, as a table of their own."""
    return written(_renumbered(nodes.where(within(F.col("path"), path)), path, index))


def _renumbered(nodes: DataFrame, path: Path, index: Column) -> DataFrame:
    d = len(path.segments)
    inside = F.size("segs") > d
    at = F.when(inside, F.regexp_extract(F.get("segs", d), r"^\[([0-9]+)\]$", 1).try_cast("long"))
    new = nodes.withColumn("at", at)
    moved = F.transform("segs", lambda s, k: F.when(k == d, F.concat(F.lit("["), index.cast("string"), F.lit("]"))).otherwise(s))
    new = new.withColumn("segs", F.when(F.col("at").isNotNull(), moved).otherwise(F.col("segs"))).drop("at")
    return new.withColumn("path", path_text(F.col("segs"))).select(*NODE_SCHEMA.names)


def remove(nodes: DataFrame, path: str | Path) -> DataFrame:
    """Remove a subtree; later items of a list move up. Emptied containers stay, and so do ancestors."""
    p = Path.parse(path)
    if p.is_root:
        return nodes.where(F.lit(False))
    rest = without(nodes, [p])
    last = p.last()
    if not isinstance(last, int):
        return rest
    if nodes.where(F.col("path") == str(p)).isEmpty():  # nothing moves unless something goes
        return nodes
    return _reposition(rest, p.parent(), closing(last))


def closing(gone: int) -> Column:
    """New positions of a list that has lost an item."""
    at = F.col("at")
    return F.when(at > gone, at - 1).otherwise(at)


def list_move(nodes: DataFrame, path: str | Path, source: int, target: int) -> DataFrame:
    """Move an item; keys move along. A source beyond the list is an error, a target beyond it is its end."""
    return _reposition(nodes, Path.parse(path), moving(nodes, path, source, target))


def moving(nodes: DataFrame, path: str | Path, source: int, target: int) -> Column:
    """New positions of a list of which an item moves."""
    n = list_len(nodes, path)
    if source >= n:
        raise IndexOutOfRange(source, n)
    to, at = min(target, n - 1), F.col("at")
    if source <= to:
        return F.when(at == source, to).when((at > source) & (at <= to), at - 1).otherwise(at)
    return F.when(at == source, to).when((at >= to) & (at < source), at + 1).otherwise(at)


def list_swap(nodes: DataFrame, path: str | Path, i: int, j: int) -> DataFrame:
    return _reposition(nodes, Path.parse(path), swapping(nodes, path, i, j))


def swapping(nodes: DataFrame, path: str | Path, i: int, j: int) -> Column:
    """New positions of a list of which two items change places."""
    n, at = list_len(nodes, path), F.col("at")
    if max(i, j) >= n:
        raise IndexOutOfRange(max(i, j), n)
    return F.when(at == i, j).when(at == j, i).otherwise(at)


def list_len(nodes: DataFrame, path: str | Path) -> int:
    p = Path.parse(path)
    return nodes.where((F.size("segs") == len(p.segments) + 1) & within(F.col("path"), p)).count()


def clear_children(nodes: DataFrame, path: str | Path) -> DataFrame:
    """Empty a container and keep it."""
    p = Path.parse(path)
    return nodes.where(~within(F.col("path"), p) | (F.col("path") == str(p)))


NULL_LEAF = Value(NULL)

"""Catalogue of queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelace.functions import export, mapping
from treelace.functions.errors import CommitConflict, IndexArity, IndexNotFound, SchemaMismatch, TreeError
from treelace.functions.mapping import Rule, attr, document
from treelace.functions.scalars import label_of, scalar
from treelace.functions.value import of
from treelace.operators import collections as C
from treelace.operators import nodes as N
from treelace.operators.entity import Entities
from treelace.operators.index import IndexColumn, IndexDef, query, ranked, violations
from treelace.sources import tables as S
from treelace.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def entry(name: str, sql: str | None):
    """Register a query under a name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- reads


@entry("get_scalar", "SELECT c_custkey, c_name AS value FROM customer")
def get_scalar(spark, sf):
    e = S.flat(spark, sf, "customer", "c_custkey")
    return e.get("c_name", "str").select(F.col("ekey").cast("long").alias("c_custkey"), "value")


@entry("get_list_item", "WITH l AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS r FROM lineitem) SELECT o_orderkey, l_quantity AS value FROM orders LEFT JOIN l ON l_orderkey = o_orderkey AND r = 2")
def get_list_item(spark, sf):
    return S.orders(spark, sf).get("lines[1]/l_quantity").select(F.col("ekey").cast("long").alias("o_orderkey"), "value")


@entry("get_missing", "SELECT count(*)::BIGINT AS n, 0::BIGINT AS found FROM customer")
def get_missing(spark, sf):
    e = S.flat(spark, sf, "customer", "c_custkey")
    return e.get("nowhere/at[3]/all").agg(F.count("*").alias("n"), F.count("value").alias("found"))


@entry("exists_paths", "SELECT o_orderkey, true AS has_status, false AS has_none, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_line FROM orders")
def exists_paths(spark, sf):
    e = S.orders(spark, sf)
    return e.df.select(F.col("ekey").cast("long").alias("o_orderkey"), e.exists("o_orderstatus").alias("has_status"), e.exists("o_nothing").alias("has_none"), e.exists("lines[0]").alias("has_line"))


@entry("kind_paths", "SELECT o_orderkey, 'object' AS root, 'list' AS lines, 'leaf' AS status, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'object' END AS line FROM orders")
def kind_paths(spark, sf):
    e = S.orders(spark, sf)
    return e.df.select(F.col("ekey").cast("long").alias("o_orderkey"), e.kind("").alias("root"), e.kind("lines").alias("lines"), e.kind("o_orderstatus").alias("status"), e.kind("lines[0]").alias("line"))


@entry("load_entity", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42")
def load_entity(spark, sf):
    return S.flat(spark, sf, "customer", "c_custkey").load_entity("42").select("doc.*")


@entry("load_nested", "SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def load_nested(spark, sf):
    d = S.orders(spark, sf).df.select("doc.o_orderkey", "doc.o_orderstatus", F.explode("doc.lines").alias("l"))
    return d.select("o_orderkey", "o_orderstatus", "l.l_linenumber", "l.l_partkey", "l.l_quantity")


@entry("object_keys", "SELECT n_nationkey, 'n_name,n_nationkey,n_regionkey' AS names FROM nation")
def object_keys(spark, sf):
    e = S.flat(spark, sf, "nation", "n_nationkey")
    return e.df.select(F.col("ekey").cast("int").alias("n_nationkey"), F.array_join(e.object_keys(), ",").alias("names"))


@entry("list_len", "SELECT o_orderkey, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def list_len(spark, sf):
    e = S.orders(spark, sf)
    return e.df.select(F.col("ekey").cast("long").alias("o_orderkey"), e.list_len("lines").alias("n"))


# ---- indexes

BY_STATUS_TOTAL = IndexDef("by_status_total", "orders/*", (IndexColumn.asc("o_orderstatus"), IndexColumn.desc("o_totalprice")))


def _plain_orders(spark, sf) -> Entities:
    return S.flat(spark, sf, "orders", "o_orderkey")


def _found(q) -> DataFrame:
    return ranked(q, F.col("doc.o_orderkey").alias("o_orderkey"), F.col("doc.o_orderstatus").alias("o_orderstatus"), F.col("doc.o_totalprice").alias("o_totalprice"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of one status by falling price."""
    return _found(query(_plain_orders(spark, sf_dir), BY_STATUS_TOTAL).prefixed(["O"]))


entry("find_prefix", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, 'orders/' || o_orderkey)::BIGINT AS rank, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'")(flagship)


@entry("find_exact", "SELECT row_number() OVER (ORDER BY 'customer/' || c_custkey)::BIGINT AS rank, c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
def find_exact(spark, sf):
    d = IndexDef("by_nation_segment", "customer/*", (IndexColumn.asc("c_nationkey"), IndexColumn.asc("c_mktsegment")))
    return ranked(query(S.flat(spark, sf, "customer", "c_custkey"), d).prefixed([scalar(7, "i32"), "BUILDING"]), F.col("doc.c_custkey").alias("c_custkey"))


@entry("find_full_scan", "SELECT row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, 'orders/' || o_orderkey)::BIGINT AS rank, o_orderkey, o_orderstatus, o_totalprice FROM orders")
def find_full_scan(spark, sf):
    return _found(query(_plain_orders(spark, sf), BY_STATUS_TOTAL))


@entry("find_reversed", "SELECT row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice, 'orders/' || o_orderkey DESC)::BIGINT AS rank, o_orderkey, o_orderstatus, o_totalprice FROM orders")
def find_reversed(spark, sf):
    return _found(query(_plain_orders(spark, sf), BY_STATUS_TOTAL).reversed())


@entry("find_desc_column", "SELECT row_number() OVER (ORDER BY c_acctbal DESC, 'customer/' || c_custkey)::BIGINT AS rank, c_custkey, c_acctbal FROM customer")
def find_desc_column(spark, sf):
    d = IndexDef("by_balance", "customer/*", (IndexColumn.desc("c_acctbal"),))
    return ranked(query(S.flat(spark, sf, "customer", "c_custkey"), d), F.col("doc.c_custkey").alias("c_custkey"), F.col("doc.c_acctbal").alias("c_acctbal"))


def _labelled(spark, sf) -> Entities:
    d, x = S.table(spark, sf, "documents").select("doc_id", "lang"), S.table(spark, sf, "labels")
    return Entities.of(d.join(x, "doc_id", "left"), "documents/*", "doc_id")


@entry("find_missing_is_null", "SELECT row_number() OVER (ORDER BY quality NULLS FIRST, 'documents/' || doc_id)::BIGINT AS rank, doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def find_missing_is_null(spark, sf):
    d = IndexDef("by_quality", "documents/*", (IndexColumn.asc("quality"),))
    return ranked(query(_labelled(spark, sf), d), F.col("doc.doc_id").alias("doc_id"), F.col("doc.quality").alias("quality"))


@entry("find_null_key", "SELECT row_number() OVER (ORDER BY 'documents/' || doc_id)::BIGINT AS rank, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def find_null_key(spark, sf):
    d = IndexDef("by_quality", "documents/*", (IndexColumn.asc("quality"),))
    return ranked(query(_labelled(spark, sf), d).prefixed([None]), F.col("doc.doc_id").alias("doc_id"))


@entry("find_type_strict", "SELECT 0::BIGINT AS wrong_kind, count(*)::BIGINT AS right_kind FROM customer WHERE c_nationkey = 7")
def find_type_strict(spark, sf):
    d = IndexDef("by_nation", "customer/*", (IndexColumn.asc("c_nationkey"),))
    q = query(S.flat(spark, sf, "customer", "c_custkey"), d)
    wrong = q.prefixed([scalar(7, "i64")]).filtered().df.agg(F.count("*").alias("wrong_kind"))
    return wrong.crossJoin(q.prefixed([scalar(7, "i32")]).filtered().df.agg(F.count("*").alias("right_kind")))  # one row by one row


@entry("find_unique", "SELECT c_custkey, c_name FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 42)")
def find_unique(spark, sf):
    e = S.flat(spark, sf, "customer", "c_custkey")
    name = e.load_entity("42").select("doc.c_name").first()[0]
    d = IndexDef("by_name", "customer/*", (IndexColumn.asc("c_name"),), True)
    return query(e, d).prefixed([name]).filtered().df.select("doc.c_custkey", "doc.c_name")


@entry("unique_violations", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf):
    d = IndexDef("by_user_type", "events/*", (IndexColumn.asc("user_id"), IndexColumn.asc("event_type")), True)
    return violations(S.flat(spark, sf, "events", "event_id"), d).select(F.col("c0").alias("user_id"), F.col("c1").alias("event_type"), "n")


@entry("unique_nulls_collide", "SELECT quality, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality HAVING count(*) > 1")
def unique_nulls_collide(spark, sf):
    d = IndexDef("by_quality", "documents/*", (IndexColumn.asc("quality"),), True)
    return violations(_labelled(spark, sf), d).select(F.col("c0").alias("quality"), "n")


@entry("find_scoped", "WITH o AS (SELECT l_orderkey AS k FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3 ORDER BY k LIMIT 1), f AS (SELECT max(l_returnflag) AS flag FROM lineitem, o WHERE l_orderkey = k) SELECT l_linenumber, l_quantity, l_extendedprice FROM lineitem, o, f WHERE l_orderkey = k AND l_returnflag = flag")
def find_scoped(spark, sf):
    d = IndexDef("by_flag", "orders/*/lines/*", (IndexColumn.asc("l_returnflag"), IndexColumn.desc("l_quantity")))
    k, flag = S.lines(spark, sf).where(F.size("lines") >= 3).agg(F.min(F.struct("l_orderkey", F.array_max("lines.l_returnflag")))).first()[0]
    q = query(S.orders(spark, sf).children("lines/*"), d).prefixed([flag]).under(f"orders/{k}")
    return q.run().select("doc.l_linenumber", "doc.l_quantity", "doc.l_extendedprice")


@entry("scope_deeper_is_empty", "SELECT count(*)::BIGINT AS n FROM orders WHERE false")
def scope_deeper_is_empty(spark, sf):
    return query(_plain_orders(spark, sf), BY_STATUS_TOTAL).under("orders/33/o_custkey/x").run().agg(F.count("*").alias("n"))


_RANKED_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


@entry("find_wildcard_list", f"WITH l AS ({_RANKED_LINES}) SELECT 'orders/' || l_orderkey || '/lines[' || pos || ']' AS path, l_quantity, row_number() OVER (ORDER BY l_quantity DESC, 'orders/' || l_orderkey || '/lines[' || pos || ']')::BIGINT AS rank FROM l WHERE l_returnflag = 'R'")
def find_wildcard_list(spark, sf):
    d = IndexDef("by_flag", "orders/*/lines/*", (IndexColumn.asc("l_returnflag"), IndexColumn.desc("l_quantity")))
    return ranked(query(S.orders(spark, sf).children("lines/*"), d).prefixed(["R"]), "path", F.col("doc.l_quantity").alias("l_quantity"))


@entry("find_leaf_index", f"WITH l AS ({_RANKED_LINES}) SELECT 'orders/' || l_orderkey || '/qty[' || pos || ']' AS path, l_quantity AS value FROM l WHERE l_quantity = 50")
def find_leaf_index(spark, sf):
    q = S.quantities(spark, sf)
    e = Entities.of(q.select("k", F.col("xs").alias("qty")), "orders/*", "k").children("qty/*")
    d = IndexDef("by_qty", "orders/*/qty/*", (IndexColumn.asc(""),))
    return query(e, d).prefixed([50.0]).run().select("path", F.col("doc").alias("value"))


def _with_doc(e: Entities, f: Callable) -> Entities:
    return Entities(e.df.withColumn("doc", f(F.col("doc"))), e.pattern)


@entry("reindex_after_update", "SELECT row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END DESC, 'orders/' || o_orderkey)::BIGINT AS rank, o_orderkey FROM orders")
def reindex_after_update(spark, sf):
    e = _with_doc(_plain_orders(spark, sf), lambda d: d.withField("o_totalprice", F.when(d["o_orderstatus"] == "P", 0.0).otherwise(d["o_totalprice"])))
    return ranked(query(e, IndexDef("by_total", "orders/*", (IndexColumn.desc("o_totalprice"),))), F.col("doc.o_orderkey").alias("o_orderkey"))


@entry("reindex_after_remove", "SELECT row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, 'orders/' || o_orderkey)::BIGINT AS rank, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def reindex_after_remove(spark, sf):
    e = _plain_orders(spark, sf)
    return _found(query(Entities(e.df.where(e.column("o_orderstatus") != "F"), e.pattern), BY_STATUS_TOTAL))


def _nation_table(spark, sf):
    """A table of the store with all nations, after one commit."""
    from treelace.sources.store import Database

    t = Database.in_memory(spark).open_table("nation")
    with t.write() as w:
        w.store_frame(S.table(spark, sf, "nation"), "nation/*", "n_nationkey")
    return t


def _names_in_order(txn, index: str) -> DataFrame:
    """(rank, path) of an index query over the store; the sort is written, and a row's place counted from it."""
    at = F.monotonically_increasing_id()
    rows = written(txn.query(index).run().select("path", at.alias("at")))
    return rows.select(F.row_number().over(Window.orderBy("at")).cast("long").alias("rank"), "path")  # a row for each nation


BY_NAME = IndexDef("by_name", "nation/*", (IndexColumn.asc("n_name"),), True)
_WRITTEN = "SELECT 'nation/' || n_nationkey AS path, CASE n_nationkey WHEN 3 THEN 'ZZZ' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 'nation/99', 'ATLANTIS'"


def _change(w) -> None:
    w.put("nation/3/n_name", "ZZZ")
    w.remove("nation/5")
    w.store_value("nation/99", of({"n_name": "ATLANTIS"}))


@entry("backfill_after_write", f"SELECT row_number() OVER (ORDER BY name, path)::BIGINT AS rank, path FROM ({_WRITTEN})")
def backfill_after_write(spark, sf):
    """An index that is created after the writes covers them."""
    t = _nation_table(spark, sf)
    with t.write() as w:
        _change(w)
    t.create_index(BY_NAME)
    return _names_in_order(t.read(), "by_name")


@entry("index_follows_writes", f"SELECT row_number() OVER (ORDER BY name, path)::BIGINT AS rank, path FROM ({_WRITTEN})")
def index_follows_writes(spark, sf):
    """An index that is there before the writes follows an update, a removal and an insertion."""
    t = _nation_table(spark, sf)
    t.create_index(BY_NAME)
    with t.write() as w:
        _change(w)
    return _names_in_order(t.read(), "by_name")


@entry("index_before_writes", "SELECT row_number() OVER (ORDER BY n_name, 'nation/' || n_nationkey)::BIGINT AS rank, 'nation/' || n_nationkey AS path FROM nation")
def index_before_writes(spark, sf):
    """A snapshot's index query, and an aborted transaction, show nothing of later writes."""
    t = _nation_table(spark, sf)
    t.ensure_index(BY_NAME)
    before, w = t.read(), t.write()
    w.remove("nation")
    w.abort()
    with t.write() as w:
        _change(w)
    return _names_in_order(before, "by_name")


@entry("index_documents", "SELECT 'nation/' || n_nationkey AS path, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def index_documents(spark, sf):
    """Typed documents of an index query over the store."""
    t = _nation_table(spark, sf)
    t.create_index(IndexDef("by_region", "nation/*", (IndexColumn.asc("n_regionkey"), IndexColumn.desc("n_name"))))
    kind = S.table(spark, sf, "nation").select("n_name", "n_regionkey").schema
    return t.read().query("by_region").prefixed([scalar(2, label_of(kind["n_regionkey"].dataType))]).docs(kind).select("path", "doc.*")


@entry("staged_writes", "SELECT 'nation/' || n_nationkey || '/note/text' AS path, 'n' || n_nationkey AS value FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'nation/3/note/text', 'last' WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)")
def staged_writes(spark, sf):
    """Many puts of a transaction in one plan; the last one of a path stays."""
    t = _nation_table(spark, sf)
    keys = [r[0] for r in S.table(spark, sf, "nation").select("n_nationkey").collect()]
    with t.write() as w, w.staged() as s:
        for k in keys:
            s.put(f"nation/{k}/note/text", f"n{k}")
        if 3 in keys:
            s.put("nation/3/note/text", "last")
    return N.at_pattern(t.read().nodes(), "nation/*/note/text").select("path", F.col("v_str").alias("value"))


@entry("rooted_writes", "SELECT 'nation/7/' || x AS path, k AS kind FROM (VALUES ('flags', 'list'), ('flags[0]', 'leaf'), ('meta', 'object'), ('n_name', 'leaf'), ('n_nationkey', 'leaf'), ('n_regionkey', 'leaf')) t(x, k)")
def rooted_writes(spark, sf):
    """Containers and leaves that a rooted write view makes, seen by a rooted read view."""
    t = _nation_table(spark, sf)
    with t.write() as w:
        at = w.rooted("nation/7")
        at.ensure_container("flags", "list")
        at.ensure_container("meta")
        at.put("flags[0]", True)
    return t.read().rooted("nation/7").nodes().where("size(segs) > 2").select("path", "kind")


@entry("reopened_reads", "SELECT 'nation/' || n_nationkey || '/' || f AS path, kind, CASE f WHEN 'n_name' THEN n_name END AS text FROM nation, (VALUES ('n_name', 'leaf'), ('n_nationkey', 'leaf'), ('n_regionkey', 'leaf')) t(f, kind)")
def reopened_reads(spark, sf):
    """A database that another handle opens shows what was committed."""
    from treelace.sources.store import Database

    t = _nation_table(spark, sf)
    again = Database.open(spark, t.db._files.root)
    assert again.tables() == ["nation"]
    return again.open_table("nation").read().nodes().where("size(segs) = 3").select("path", "kind", F.col("v_str").alias("text"))


@entry("point_reads", "SELECT what, text FROM (SELECT 'name' AS what, n_name AS text FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'raw', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'kind', 'object' UNION ALL SELECT 'keys', 'n_name,n_nationkey,n_regionkey' UNION ALL SELECT 'by key', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'leaf', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'missing', 'none' UNION ALL SELECT 'root', 'null')")
def point_reads(spark, sf):
    """Reads of single nodes: by path, by stable key, through a lazy accessor, of what is not there."""
    t = _nation_table(spark, sf)
    r = t.read()
    view = r.fetch("nation/7")
    by_key = r.nodes().where(F.col("skey") == view.key()).select("path").first()[0]
    rows = [
        ("name", r.get("nation/7/n_name", "str")),
        ("raw", r.get_scalar("nation/7/n_name").value),
        ("kind", r.kind("nation/7")),
        ("keys", ",".join(view.keys())),
        ("by key", r.load_value(by_key).get("n_name").data.value),
        ("leaf", view.field("n_name").get("str")),
        ("missing", "none" if r.fetch("nation/7/nick").is_none() and not r.exists("nation/x") else "some"),
        ("root", t.db.open_table("empty").read().export_to_json()),
    ]
    return N.local_frame(spark, rows, T.StructType([T.StructField("what", T.StringType()), T.StructField("text", T.StringType())]))


@entry("root_value", "SELECT n_name AS path, n_regionkey::BIGINT AS v FROM nation")
def root_value(spark, sf):
    """A value that is put at a table's root replaces all that stood there."""
    t = _nation_table(spark, sf)
    regions = {r["n_name"]: r["n_regionkey"] for r in S.table(spark, sf, "nation").collect()}
    with t.write() as w:
        w.store_value("", of(regions))
    return t.read().nodes().where("size(segs) > 0").select("path", F.col("v_int").cast("long").alias("v"))


@entry("stale_variant", "SELECT 'nation/' || n_nationkey || '/state/New' AS path, n_name AS value FROM nation")
def stale_variant(spark, sf):
    """A union value that replaces another of its kind leaves no field of the old variant."""
    t = _nation_table(spark, sf)
    names = {r["n_nationkey"]: r["n_name"] for r in S.table(spark, sf, "nation").collect()}
    for variant in (lambda k: {"Old": {"n": k, "name": names[k]}}, lambda k: {"New": names[k]}):
        with t.write() as w, w.staged() as s:
            for k in names:
                s.store_value(f"nation/{k}/state", variant(k))
    return t.read().nodes().where("size(segs) > 3").select("path", F.col("v_str").alias("value"))


@document(via=(str, lambda p: f"{p.region}:{p.nation}", lambda t: _Place(*map(int, t.split(":")))))
@dataclass
class _Place:
    region: int
    nation: int


@document(rename_all="SCREAMING_SNAKE_CASE")
@dataclass
class _Office:
    place: _Place
    title: str = attr(rename="label", alias=["name"])
    draft: int = attr(skip=True, default=5)
    seen: int = attr(skip_load=True, default=0)
    sent: int = attr(skip_store=True, default=1)


_OFFICE_FIELDS = "(VALUES ('PLACE'), ('SEEN'), ('label')) t(f)"


@entry("typed_fields", f"SELECT 'office/' || n_nationkey || '/' || f AS path, CASE f WHEN 'PLACE' THEN n_regionkey || ':' || n_nationkey WHEN 'label' THEN n_name END AS text, CASE f WHEN 'SEEN' THEN n_nationkey::BIGINT END AS v FROM nation, {_OFFICE_FIELDS}")
def typed_fields(spark, sf):
    """What a typed value stores: other names, a stand-in for a field's type, and nothing of fields that aren't stored."""
    return _offices(spark, sf).read().nodes().where("kind = 'leaf'").select("path", F.col("v_str").alias("text"), F.col("v_int").cast("long").alias("v"))


def _offices(spark, sf):
    from treelace.sources.store import Database

    t = Database.in_memory(spark).open_table("office")
    rows = S.table(spark, sf, "nation").collect()
    with t.write() as w:
        w.store_many([(f"office/{r['n_nationkey']}", _Office(_Place(r["n_regionkey"], r["n_nationkey"]), r["n_name"], 9, r["n_nationkey"], 9)) for r in rows])
    return t


@entry("typed_load", "SELECT n_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS region, n_name AS title, 5::BIGINT AS draft, 0::BIGINT AS seen, 1::BIGINT AS sent FROM nation")
def typed_load(spark, sf):
    """Typed documents read back through an index: fields that aren't loaded have their defaults."""
    t = _offices(spark, sf)
    t.create_index(IndexDef("by_label", "office/*", (IndexColumn.asc("label"),)))
    rows = [(o.place.nation, o.place.region, o.title, o.draft, o.seen, o.sent) for o in t.read().query("by_label").load(_Office)]
    return N.local_frame(spark, rows, T.StructType([T.StructField(n, T.StringType() if n == "title" else T.LongType()) for n in ("nation", "region", "title", "draft", "seen", "sent")]))


@entry("index_registry", "SELECT * FROM (VALUES (1, 'created'), (2, 'there'), (3, 'mismatch'), (4, 'kept'), (5, 'known'), (6, 'arity'), (7, 'deleted'), (8, 'gone'), (9, 'not found')) t(step, got)")
def index_registry(spark, sf):
    """What creating, repeating, ensuring, asking for and deleting an index of a table answer."""
    t = _nation_table(spark, sf)
    other = IndexDef("by_name", "nation/*", (IndexColumn.desc("n_name"),))

    def error(f) -> str:
        try:
            f()
        except TreeError as e:
            return {SchemaMismatch: "mismatch", IndexArity: "arity", IndexNotFound: "not found"}[type(e)]
        return "no error"

    rows = [
        (1, "created" if t.create_index(BY_NAME) else "there"),
        (2, "created" if t.create_index(BY_NAME) else "there"),
        (3, error(lambda: t.create_index(other))),
        (4, "changed" if t.ensure_index(other) else "kept"),
        (5, "known" if t.has_index("by_name") and t.index_def("by_name") == BY_NAME else "unknown"),
        (6, error(lambda: t.read().find("by_name", ["A", "B"]))),
        (7, "deleted" if t.delete_index("by_name") else "gone"),
        (8, "deleted" if t.delete_index("by_name") else "gone"),
        (9, error(lambda: t.read().find("by_name"))),
    ]
    return N.local_frame(spark, rows, T.StructType([T.StructField("step", T.IntegerType()), T.StructField("got", T.StringType())]))


@entry("lost_update_refused", "SELECT 'nation/3/n_name' AS path, 'first' AS value, true AS refused")
def lost_update_refused(spark, sf):
    """Of two handles that began from the same generation the second to commit fails, and the first's write stays."""
    from treelace.sources.store import Database

    t = _nation_table(spark, sf)
    first, second = t.write(), Database.open(spark, t.db._files.root).open_table("nation").write()
    first.put("nation/3/n_name", "first")
    second.put("nation/3/n_name", "second")
    first.commit()
    try:
        second.commit()
        refused = False
    except CommitConflict:
        refused = True
    return N.leaf_at(t.read().nodes(), ["nation/3/n_name"]).select("path", F.col("v_str").alias("value"), F.lit(refused).alias("refused"))


@entry("change_sets", "SELECT 'customer/' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'seg:' || c_mktsegment ELSE c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance FROM customer WHERE c_custkey NOT IN (7, 8) UNION ALL SELECT 'customer/8', 'again', NULL WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 8)")
def change_sets(spark, sf):
    """A table and four change sets over it: a bulk store of a third, two removals, and a store where one was."""
    from treelace.sources.store import Database

    c = S.table(spark, sf, "customer")
    t = Database.in_memory(spark).open_table("customer")
    with t.write() as w:
        w.store_frame(c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), "customer/*", "c_custkey")
    with t.write() as w:
        w.store_frame(c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("seg:"), "c_mktsegment").alias("name")), "customer/*", "c_custkey")
    for key in (7, 8):
        with t.write() as w:
            w.remove(f"customer/{key}")
    with t.write() as w:
        w.put("customer/8/name", "again")
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("balance", T.DoubleType())])
    return t.read().recompose("customer/*", kind).select("path", "doc.*")


@entry("folded_changes", "SELECT 'nation/' || n_nationkey AS path, CASE WHEN n_nationkey < 11 THEN 'edit' || n_nationkey ELSE n_name END AS name FROM nation")
def folded_changes(spark, sf):
    """Eleven commits of a put each, which fold change sets on the way, and a reader from before."""
    t = _nation_table(spark, sf)
    keys = sorted(r[0] for r in S.table(spark, sf, "nation").select("n_nationkey").collect())
    for k in keys:
        if k < 11:
            with t.write() as w:
                w.put(f"nation/{k}/n_name", f"edit{k}")
    return N.at_pattern(t.read().nodes(), "nation/*/n_name").select(F.regexp_replace("path", "/n_name$", "").alias("path"), F.col("v_str").alias("name"))


# ---- lists

_L = f"WITH b AS ({_RANKED_LINES}), l AS (SELECT l_orderkey AS k, pos, l_quantity AS v, n FROM b), ks AS (SELECT DISTINCT k, n FROM l) "


def _items(spark, sf, f: Callable, where=None) -> DataFrame:
    q = S.quantities(spark, sf)
    q = q if where is None else q.where(where)
    return q.select("k", F.posexplode(f("xs")).alias("pos", "v")).select("k", F.col("pos").cast("long").alias("pos"), "v")


def _list(name: str, sql: str, f: Callable, where=None) -> None:
    entry(name, _L + sql)(lambda spark, sf: _items(spark, sf, f, where))


_list("list_push", "SELECT k, pos::BIGINT AS pos, v FROM l UNION ALL SELECT k, n::BIGINT, -1.0 FROM ks", lambda xs: C.push(xs, -1.0))
_list("list_insert_at", "SELECT k, (CASE WHEN pos < 1 THEN pos ELSE pos + 1 END)::BIGINT AS pos, v FROM l UNION ALL SELECT k, least(1, n)::BIGINT, -1.0 FROM ks", lambda xs: C.insert_at(xs, 1, -1.0))
_list("list_insert_past_end", "SELECT k, pos::BIGINT AS pos, v FROM l UNION ALL SELECT k, n::BIGINT, -1.0 FROM ks", lambda xs: C.insert_at(xs, 1000, -1.0))
_list("list_remove_at", "SELECT k, (pos - 1)::BIGINT AS pos, v FROM l WHERE pos > 0", lambda xs: C.remove_at(xs, 0))
_list("list_remove_range", "SELECT k, (CASE WHEN pos < 1 THEN pos ELSE pos - 2 END)::BIGINT AS pos, v FROM l WHERE pos < 1 OR pos >= 3", lambda xs: C.remove_range(xs, 1, 3))
_list("list_move", "SELECT k, (CASE WHEN pos = 0 THEN least(2, n - 1) WHEN pos <= 2 THEN pos - 1 ELSE pos END)::BIGINT AS pos, v FROM l", lambda xs: C.move(xs, 0, 2))
_list("list_swap", "SELECT k, (CASE pos WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE pos END)::BIGINT AS pos, v FROM l WHERE n > 1", lambda xs: C.swap(xs, 0, 1), "size(xs) > 1")
_list("list_swap_remove", "SELECT k, pos::BIGINT AS pos, CASE WHEN pos = 0 THEN last(v) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE v END AS v FROM l QUALIFY pos < n - 1", lambda xs: C.swap_remove(xs, 0))
_list("list_retain", "SELECT k, (row_number() OVER (PARTITION BY k ORDER BY pos) - 1)::BIGINT AS pos, v FROM l WHERE v > 25", lambda xs: C.retain(xs, lambda x: x > 25))
_list("list_extend", "SELECT k, pos::BIGINT AS pos, v FROM l UNION ALL SELECT k, (pos + n)::BIGINT, v FROM l", lambda xs: C.extend(xs, xs))
_list("list_iterate", "SELECT k, pos::BIGINT AS pos, v FROM l", lambda xs: F.col(xs))
_list("list_drain", "SELECT k, pos::BIGINT AS pos, v FROM l WHERE pos < 2", lambda xs: C.drain(xs, 0, 2)[0])
_list("list_drain_rest", "SELECT k, (pos - 2)::BIGINT AS pos, v FROM l WHERE pos >= 2", lambda xs: C.drain(xs, 0, 2)[1])


@entry("list_pop_first", _L + "SELECT k, v AS popped, (n - 1)::BIGINT AS rest FROM l WHERE pos = 0")
def list_pop_first(spark, sf):
    popped, rest = C.pop_first("xs")
    return S.quantities(spark, sf).select("k", popped.alias("popped"), C.length(rest).alias("rest"))


@entry("list_pop_last", _L + "SELECT k, v AS popped, (n - 1)::BIGINT AS rest FROM l WHERE pos = n - 1")
def list_pop_last(spark, sf):
    popped, rest = C.pop_last("xs")
    return S.quantities(spark, sf).select("k", popped.alias("popped"), C.length(rest).alias("rest"))


@entry("list_clear", _L + "SELECT k, 0::BIGINT AS n, true AS is_empty FROM ks")
def list_clear(spark, sf):
    return S.quantities(spark, sf).select("k", C.length(C.clear("xs")).alias("n"), C.is_empty(C.clear("xs")).alias("is_empty"))


@entry("list_first_last", _L + "SELECT k, min(v) FILTER (pos = 0) AS first, min(v) FILTER (pos = n - 1) AS last FROM l GROUP BY k")
def list_first_last(spark, sf):
    return S.quantities(spark, sf).select("k", C.first("xs").alias("first"), C.last("xs").alias("last"))


@entry("list_contains", _L + "SELECT k, bool_or(v = 10) AS has, false AS has_null FROM l GROUP BY k")
def list_contains(spark, sf):
    return S.quantities(spark, sf).select("k", C.contains("xs", 10.0).alias("has"), C.contains("xs", F.lit(None).cast("double")).alias("has_null"))


@entry("list_get", _L + "SELECT k, min(v) FILTER (pos = 2) AS value FROM l GROUP BY k")
def list_get(spark, sf):
    return S.quantities(spark, sf).select("k", C.item("xs", 2).alias("value"))


# ---- maps

_M = "WITH m AS (SELECT c_nationkey || ':' || c_mktsegment AS k, c_name AS name, c_acctbal AS v, row_number() OVER w AS r, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name)) "


def _pairs(spark, sf, f: Callable) -> DataFrame:
    return S.balances(spark, sf).select("k", F.explode(f("m")).alias("name", "v"))


def _map(name: str, sql: str, f: Callable) -> None:
    entry(name, _M + sql)(lambda spark, sf: _pairs(spark, sf, f))


_map("map_insert", "SELECT k, name, v FROM m UNION ALL SELECT DISTINCT k, 'new', 1.0 FROM m", lambda m: C.insert(m, "new", 1.0))
_map("map_retain", "SELECT k, name, v FROM m WHERE v > 0", lambda m: C.retain_entries(m, lambda _, v: v > 0))
_map("map_remove", "SELECT k, name, v FROM m WHERE name <> 'Customer#000000042'", lambda m: C.remove_key(m, "Customer#000000042"))
_map("map_extend", "SELECT k, name, 0.0::DOUBLE AS v FROM m", lambda m: C.extend_map(m, F.transform_values(m, lambda k, v: F.lit(0.0))))
_map("map_pop_first", "SELECT k, name, v FROM m WHERE r > 1", lambda m: C.pop_first_entry(m)[1])
_map("map_pop_last", "SELECT k, name, v FROM m WHERE r < n", lambda m: C.pop_last_entry(m)[1])


@entry("map_keys", _M + "SELECT k, string_agg(name, ',' ORDER BY name) AS names, count(*)::BIGINT AS n FROM m GROUP BY k")
def map_keys(spark, sf):
    return S.balances(spark, sf).select("k", F.array_join(C.keys("m"), ",").alias("names"), F.size("m").cast("long").alias("n"))


@entry("map_get", _M + "SELECT DISTINCT k, NULL::DOUBLE AS missing, first_value(v) OVER (PARTITION BY k ORDER BY name) AS found FROM m")
def map_get(spark, sf):
    b = S.balances(spark, sf)
    return b.select("k", C.lookup("m", "nobody").alias("missing"), F.try_element_at("m", F.get(C.keys("m"), 0)).alias("found"))


@entry("map_contains", _M + "SELECT k, false AS missing, true AS found FROM m GROUP BY k")
def map_contains(spark, sf):
    return S.balances(spark, sf).select("k", C.contains_key("m", "nobody").alias("missing"), F.map_contains_key("m", F.get(C.keys("m"), 0)).alias("found"))


@entry("map_first_last", _M + "SELECT k, min(name) AS first, max(name) AS last, min(v) FILTER (r = 1) AS first_value FROM m GROUP BY k")
def map_first_last(spark, sf):
    return S.balances(spark, sf).select("k", C.first_entry("m")["key"].alias("first"), C.last_entry("m")["key"].alias("last"), C.first_entry("m")["value"].alias("first_value"))


@entry("map_iterate", _M + "SELECT k, (r - 1)::BIGINT AS pos, name, v FROM m")
def map_iterate(spark, sf):
    return S.balances(spark, sf).select("k", F.posexplode(C.entries("m")).alias("pos", "e")).select("k", F.col("pos").cast("long").alias("pos"), F.col("e.key").alias("name"), F.col("e.value").alias("v"))


@entry("map_drain", _M + "SELECT k, count(*)::BIGINT AS drained, 0::BIGINT AS rest FROM m GROUP BY k")
def map_drain(spark, sf):
    out, rest = C.drain_map("m")
    return S.balances(spark, sf).select("k", F.size(out).cast("long").alias("drained"), F.size(rest).cast("long").alias("rest"))


# ---- node frames


def _customer_nodes(spark, sf, columns=("c_custkey", "c_name", "c_nationkey")) -> DataFrame:
    c = S.table(spark, sf, "customer").select(*columns)
    segs = F.array(F.lit("customer"), F.col("c_custkey").cast("string"))
    return N.shred(c, F.struct(*columns), c.schema, segs, "customer")


@entry("shred_nodes", """
SELECT 'customer/' || c_custkey AS path, 'object' AS kind, NULL::INTEGER AS tag, NULL::BIGINT AS v_int, NULL::VARCHAR AS v_str FROM customer
UNION ALL SELECT 'customer/' || c_custkey || '/c_custkey', 'leaf', 5, c_custkey, NULL FROM customer
UNION ALL SELECT 'customer/' || c_custkey || '/c_name', 'leaf', 14, NULL, c_name FROM customer
UNION ALL SELECT 'customer/' || c_custkey || '/c_nationkey', 'leaf', 4, c_nationkey, NULL FROM customer""")
def shred_nodes(spark, sf):
    return _customer_nodes(spark, sf).select("path", "kind", "tag", F.col("v_int").cast("long").alias("v_int"), "v_str")


@entry("shred_lists", f"WITH l AS ({_RANKED_LINES}) SELECT 'o/' || l_orderkey || '/xs[' || pos || ']' AS path, l_quantity AS v_float FROM l UNION ALL SELECT DISTINCT 'o/' || l_orderkey || '/xs', NULL FROM l UNION ALL SELECT DISTINCT 'o/' || l_orderkey, NULL FROM l")
def shred_lists(spark, sf):
    q = S.quantities(spark, sf)
    return N.shred(q, F.struct("xs"), T.StructType([q.schema["xs"]]), F.array(F.lit("o"), F.col("k").cast("string"))).select("path", "v_float")


@entry("recompose_nodes", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def recompose_nodes(spark, sf):
    kind = S.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").schema
    return N.recompose(_customer_nodes(spark, sf), "customer/*", kind).select("doc.*")


@entry("pattern_match", "SELECT 'customer/' || c_custkey || '/c_name' AS path, c_name AS value FROM customer WHERE c_custkey = 42")
def pattern_match(spark, sf):
    return N.at_pattern(_customer_nodes(spark, sf), "customer/*/c_name", "customer/42").select("path", F.col("v_str").alias("value"))


@entry("children_in_order", "SELECT 'customer/42/' || x AS path FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey')) t(x) WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 42)")
def children_in_order(spark, sf):
    return N.children(_customer_nodes(spark, sf), "customer/42").select("path")


@entry("put_scalar", "SELECT 'customer/' || c_custkey || '/c_name' AS path, CASE WHEN c_custkey = 42 THEN 'changed' ELSE c_name END AS value FROM customer")
def put_scalar(spark, sf):
    n = N.store_many(_customer_nodes(spark, sf), [("customer/42/c_name", "changed")], "customer", 1)
    return N.at_pattern(n, "customer/*/c_name").select("path", F.col("v_str").alias("value"))


@entry("put_keeps_keys", "SELECT count(*)::BIGINT AS same FROM customer")
def put_keeps_keys(spark, sf):
    before = _customer_nodes(spark, sf)
    after = N.store_many(before, [("customer/42/c_name", "changed")], "customer", 1)
    a, b = (N.at_pattern(x, "customer/*/c_name").select("path", "skey") for x in (before, after))
    return a.join(b, ["path", "skey"]).agg(F.count("*").alias("same"))


@entry("store_many", "SELECT path, v FROM (SELECT 'nation/' || n_nationkey || '/n_name' AS path, n_name AS v FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL VALUES ('nation/3/n_name', 'X'), ('nation/4/n_name', 'Y'), ('nation/new/n_name', 'Z'))")
def store_many(spark, sf):
    d = S.table(spark, sf, "nation")
    n = N.shred(d, F.struct(*d.columns), d.schema, F.array(F.lit("nation"), F.col("n_nationkey").cast("string")))
    n = N.store_many(n, [("nation/3", {"n_name": "X"}), ("nation/4", {"n_name": "Y"}), ("nation/new", {"n_name": "Z"})])
    return N.at_pattern(n, "nation/*/n_name").select("path", F.col("v_str").alias("v"))


@entry("remove_subtree", "SELECT count(*) FILTER (c_custkey <> 42)::BIGINT * 4 AS nodes FROM customer")
def remove_subtree(spark, sf):
    return N.remove(_customer_nodes(spark, sf), "customer/42").agg(F.count("*").alias("nodes"))


_O = f"WITH l AS ({_RANKED_LINES}), o AS (SELECT min(l_orderkey) AS k FROM l WHERE n >= 3) "


def _all_lists(spark, sf) -> tuple[DataFrame, str]:
    """Every order's list as nodes, and the path of one that has three items at least."""
    q = S.quantities(spark, sf)
    k = q.where(F.size("xs") >= 3).agg(F.min("k")).first()[0]
    return N.shred(q, F.struct("xs"), T.StructType([q.schema["xs"]]), F.array(F.lit("o"), F.col("k").cast("string"))), f"o/{k}/xs"


def _list_items(nodes: DataFrame) -> DataFrame:
    return N.at_pattern(nodes, "o/*/xs/*").select("path", F.col("v_float").alias("v"))


@entry("remove_list_item", _O + "SELECT 'o/' || l_orderkey || '/xs[' || (CASE WHEN l_orderkey = k THEN pos - 1 ELSE pos END) || ']' AS path, l_quantity AS v FROM l, o WHERE l_orderkey <> k OR pos > 0")
def remove_list_item(spark, sf):
    n, path = _all_lists(spark, sf)
    return _list_items(N.remove(n, path + "[0]"))


@entry("node_list_swap", _O + "SELECT 'o/' || l_orderkey || '/xs[' || (CASE WHEN l_orderkey <> k THEN pos WHEN pos = 0 THEN n - 1 WHEN pos = n - 1 THEN 0 ELSE pos END) || ']' AS path, l_quantity AS v FROM l, o")
def node_list_swap(spark, sf):
    n, path = _all_lists(spark, sf)
    return _list_items(N.list_swap(n, path, 0, N.list_len(n, path) - 1))


@entry("node_list_move", _O + "SELECT 'o/' || l_orderkey || '/xs[' || (CASE WHEN l_orderkey <> k THEN pos WHEN pos = 0 THEN n - 1 ELSE pos - 1 END) || ']' AS path, l_quantity AS v FROM l, o")
def node_list_move(spark, sf):
    n, path = _all_lists(spark, sf)
    return _list_items(N.list_move(n, path, 0, 999))


@entry("list_children", _O + "SELECT 'o/' || l_orderkey || '/xs[' || pos || ']' AS path, l_quantity AS v, (pos + 1)::BIGINT AS rank FROM l, o WHERE l_orderkey = k")
def list_children(spark, sf):
    """Children of a list, by position."""
    n, path = _all_lists(spark, sf)
    rows = written(N.children(n, path).select("path", F.col("v_float").alias("v"), F.monotonically_increasing_id().alias("at")))
    return rows.select("path", "v", F.row_number().over(Window.orderBy("at")).cast("long").alias("rank"))  # the items of one list


@entry("clear_children", "SELECT 1::BIGINT + 4 * count(*) FILTER (c_custkey <> 42) AS nodes FROM customer")
def clear_children(spark, sf):
    return N.clear_children(_customer_nodes(spark, sf), "customer/42").agg(F.count("*").alias("nodes"))


@entry("own_writes", f"SELECT path || '/n_name' AS path, name AS value FROM ({_WRITTEN})")
def own_writes(spark, sf):
    """What a write transaction reads before it commits."""
    w = _nation_table(spark, sf).write()
    _change(w)
    out = written(N.at_pattern(w.nodes(), "nation/*/n_name").select("path", F.col("v_str").alias("value")))
    w.abort()
    return out


@entry("snapshot_read", "SELECT count(*)::BIGINT AS old_nodes, (count(*) - 4)::BIGINT AS new_nodes FROM (SELECT unnest(range(4)) FROM nation)")
def snapshot_read(spark, sf):
    from treelace.sources.store import Database

    t = Database.in_memory(spark).open_table("nation")
    with t.write() as w:
        w.store_frame(S.table(spark, sf, "nation"), "nation/*", "n_nationkey")
    before = t.read()
    with t.write() as w:
        w.remove("nation/3")
    count = lambda r, name: r.nodes().where("size(segs) > 1").agg(F.count("*").alias(name))
    return count(before, "old_nodes").crossJoin(count(t.read(), "new_nodes"))  # one row by one row


# ---- values and text


@entry("value_get", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def value_get(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return Entities.of(e, "events/*", "event_id").get("props/k", "i64").select(F.col("ekey").cast("long").alias("event_id"), F.col("value").alias("k"))


@entry("value_set", "SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS kind FROM events")
def value_set(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("props"))
    doc = C.set_path(F.struct("props"), T.StructType([e.schema["props"]]), ("props", "kind"), F.col("event_type"))
    return e.select("event_id", doc["props"]["k"].alias("k"), doc["props"]["kind"].alias("kind"))


@entry("value_merge", "SELECT event_id, name, v FROM (SELECT event_id, 'k' AS name, (props->>'$.k')::BIGINT AS v FROM events UNION ALL SELECT event_id, 'user', user_id FROM events)")
def value_merge(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", "user_id", F.from_json("props", "map<string,long>").alias("m"))
    return e.select("event_id", F.explode(C.extend_map("m", F.create_map(F.lit("user"), "user_id"))).alias("name", "v"))


_NATION = """'{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'"""


@entry("json_compact", f"SELECT n_nationkey::VARCHAR AS ekey, {_NATION} AS text FROM nation")
def json_compact(spark, sf):
    return S.flat(spark, sf, "nation", "n_nationkey").to_json()


@entry("json_pretty", """SELECT n_nationkey::VARCHAR AS ekey, '{' || chr(10) || '  "n_name": "' || n_name || '",' || chr(10) || '  "n_nationkey": ' || n_nationkey || ',' || chr(10) || '  "n_regionkey": ' || n_regionkey || chr(10) || '}' AS text FROM nation""")
def json_pretty(spark, sf):
    return S.flat(spark, sf, "nation", "n_nationkey").to_json(2)


@entry("yaml_block", """SELECT n_nationkey::VARCHAR AS ekey, '"n_name": "' || n_name || '"' || chr(10) || '"n_nationkey": ' || n_nationkey || chr(10) || '"n_regionkey": ' || n_regionkey || chr(10) AS text FROM nation""")
def yaml_block(spark, sf):
    return S.flat(spark, sf, "nation", "n_nationkey").to_yaml()


@entry("json_escape", """SELECT conv_id, turn, '"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"' AS text FROM conversations""")
def json_escape(spark, sf):
    return S.table(spark, sf, "conversations").select("conv_id", "turn", export.quoted_column(F.col("text")).alias("text"))


@entry("json_nested", """SELECT conv_id, '{"turns":[' || string_agg('{"role":"' || role || '","turn":' || turn || '}', ',' ORDER BY turn, role) || ']}' AS text FROM conversations GROUP BY conv_id""")
def json_nested(spark, sf):
    c = S.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    kind = T.StructType([c.schema["turns"]])
    return c.select("conv_id", export.json_column(F.struct("turns"), kind).alias("text"))


@entry("json_scalar_forms", "SELECT event_id, event_id::VARCHAR AS i, CASE WHEN user_id > 10 THEN 'true' ELSE 'false' END AS b, 'null' AS n, '\"' || strftime(ts, '%Y-%m-%d') || '\"' AS d, '\"AAEC/w==\"' AS x FROM events")
def json_scalar_forms(spark, sf):
    e = S.table(spark, sf, "events")
    t = lambda c, k: export.json_column(c, k)
    return e.select("event_id", t(F.col("event_id"), T.LongType()).alias("i"), t(F.col("user_id") > 10, T.BooleanType()).alias("b"), t(F.lit(None).cast("string"), T.StringType()).alias("n"), t(F.col("ts").cast("date"), T.DateType()).alias("d"), t(F.lit(bytes([0, 1, 2, 255])), T.BinaryType()).alias("x"))


@entry("json_bytes", "SELECT doc_id, '\"' || base64(encode(text)) || '\"' AS text FROM documents")
def json_bytes(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", export.json_column(F.col("text").cast("binary"), T.BinaryType()).alias("text"))


_MILLIS = "((user_id % 100) * 86400000 + (event_id % 24) * 3600000 + event_id % 1000)"


@entry("json_durations", f"SELECT event_id, ({_MILLIS} // 1000)::VARCHAR || CASE WHEN {_MILLIS} % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(({_MILLIS} % 1000)::VARCHAR, 3, '0'), '0') END AS text FROM events")
def json_durations(spark, sf):
    e = S.table(spark, sf, "events")
    span = F.make_dt_interval((F.col("user_id") % 100).cast("int"), (F.col("event_id") % 24).cast("int"), F.lit(0), (F.col("event_id") % 1000).cast("decimal(18,6)") / 1000)
    return e.select("event_id", export.json_column(span, T.DayTimeIntervalType()).alias("text"))


@entry("yaml_nested", """SELECT conv_id, '"empty": {}' || chr(10) || '"turns":' || chr(10) || string_agg('  -' || chr(10) || '    "role": "' || role || '"' || chr(10) || '    "turn": ' || turn, chr(10) ORDER BY turn, role) AS text FROM conversations GROUP BY conv_id""")
def yaml_nested(spark, sf):
    c = S.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    doc = F.struct("turns", F.create_map().cast("map<string,long>").alias("empty"))
    kind = T.StructType([c.schema["turns"], T.StructField("empty", T.MapType(T.StringType(), T.LongType()))])
    return c.select("conv_id", export.yaml_column(doc, kind).alias("text"))


@entry("json_float_forms", "SELECT * FROM (VALUES (1, '1'), (2, '0.0000001'), (3, '100000000000000000000'), (4, '1.5'), (5, '-0.25'), (6, 'null'), (7, 'null'), (8, '123456789.125')) t(id, text)")
def json_float_forms(spark, sf):
    rows = [(1, 1.0), (2, 1e-7), (3, 1e20), (4, 1.5), (5, -0.25), (6, float("nan")), (7, float("inf")), (8, 123456789.125)]
    return spark.createDataFrame(rows, "id int, v double").select("id", export.float_column(F.col("v")).alias("text"))


@entry("recomposed_json", f"SELECT n_nationkey::VARCHAR AS ekey, {_NATION} AS text FROM nation")
def recomposed_json(spark, sf):
    d = S.table(spark, sf, "nation")
    n = N.shred(d, F.struct(*d.columns), d.schema, F.array(F.lit("nation"), F.col("n_nationkey").cast("string")))
    doc = N.recompose(n, "nation/*", d.schema)
    return Entities(doc, S.flat(spark, sf, "nation", "n_nationkey").pattern).to_json()


@entry("value_merge_kinds", "SELECT * FROM (VALUES ('leaf', '2'), ('list', '[1,2,3]'), ('list_leaf', '[1,9]'), ('node', '{\"a\":1,\"b\":3}')) t(kind, text)")
def value_merge_kinds(spark, sf):
    cases = {"leaf": (1, 2), "list": ([1], [2, 3]), "list_leaf": ([1], 9), "node": ({"a": 1, "b": 2}, {"b": 3})}
    rows = []
    for name, (a, b) in cases.items():
        v = of(a)
        v.merge(of(b))
        rows.append((name, export.to_json(v)))
    return spark.createDataFrame(rows, "kind string, text string")


def _edited(spark, sf, edit: Callable) -> DataFrame:
    """(n_nationkey, text): JSON of a dynamic value that edit makes of each nation's row on the driver, which a fixed table allows."""
    rows = [(r["n_nationkey"], export.to_json(edit(r))) for r in S.table(spark, sf, "nation").collect()]
    return N.local_frame(spark, rows, T.StructType([S.table(spark, sf, "nation").schema["n_nationkey"], T.StructField("text", T.StringType())]))


@entry("value_edits", """SELECT n_nationkey, '{"gone":' || (CASE WHEN n_regionkey = 0 THEN 'null' ELSE '"x"' END) || ',"has":' || (CASE WHEN n_regionkey = 0 THEN 'true' ELSE 'false' END) || ',"kind":"object","name":"' || n_name || '","none":{}}' AS text FROM nation""")
def value_edits(spark, sf):
    """Nodes: insert, contains_key, remove_key and clear."""

    def edit(r):
        v = of({"name": r["n_name"], "none": {"a": 1}, "gone": "x"})
        v.get("none").clear()
        if r["n_regionkey"] == 0:
            v.get("gone").clear()
        v.insert("kind", v.kind)
        v.insert("has", v.contains_key("gone") and v.remove_key("gone").as_leaf().label == "null")
        v.insert("gone", None if v.get("has") == of(True) else "x")
        return v

    return _edited(spark, sf, edit)


@entry("value_list_edits", """SELECT n_nationkey, '[' || n_regionkey || ',"' || n_name || '",' || (CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE '[]' END) || ',"beyond"]' AS text FROM nation""")
def value_list_edits(spark, sf):
    """Lists: push, remove_at within the list and beyond it, at, and items that replace others."""

    def edit(r):
        v = of([0, r["n_regionkey"]])
        v.push(r["n_name"])
        v.remove_at(0)
        v.push([] if r["n_nationkey"] % 2 else True)
        try:
            v.remove_at(9)
        except IndexError:
            v.push("beyond" if v.at(9) is None else "there")
        return v

    return _edited(spark, sf, edit)


# ---- typed mapping


@entry("map_rename_all", "SELECT c_custkey AS \"cCustkey\", c_name AS \"displayName\", c_mktsegment AS \"cMktsegment\" FROM customer")
def map_rename_all(spark, sf):
    rules = [Rule("c_custkey"), Rule("c_name", name="displayName"), Rule("c_mktsegment")]
    return S.table(spark, sf, "customer").select(mapping.document_column(rules, "camelCase").alias("d")).select("d.*")


@entry("map_alias_default", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE 'none' END AS label, p_size % 3 = 0 AS primary_present FROM part")
def map_alias_default(spark, sf):
    p = S.table(spark, sf, "part")
    rules = [Rule("p_name", name="label", skip_if=lambda _: F.col("p_size") % 3 != 0), Rule("p_brand", name="old_label", skip_if=lambda _: F.col("p_size") % 3 != 1)]
    d = p.select("p_partkey", mapping.document_column(rules).alias("doc"), mapping.present_column(rules).alias("present"))
    return d.select("p_partkey", mapping.load_column(F.col("doc"), F.col("present"), ["label", "old_label"], F.lit("none")).alias("label"), F.array_contains("present", "label").alias("primary_present"))


@entry("map_skip_if", "SELECT c_custkey, c_acctbal >= 0 AS present, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer")
def map_skip_if(spark, sf):
    rules = [Rule("c_acctbal", name="balance", skip_if=lambda c: c < 0)]
    d = S.table(spark, sf, "customer").select("c_custkey", mapping.document_column(rules).alias("d"), mapping.present_column(rules).alias("p"))
    return d.select("c_custkey", F.array_contains("p", "balance").alias("present"), "d.balance")


@entry("map_flatten", "SELECT c_custkey, c_name AS \"cName\", n_name AS \"nName\", n_regionkey AS \"nRegionkey\", n_name AS back FROM customer JOIN nation ON c_nationkey = n_nationkey")
def map_flatten(spark, sf):
    c, n = S.table(spark, sf, "customer"), S.table(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", F.struct("n_name", "n_regionkey").alias("meta"))
    names = ("n_name", "n_regionkey")
    d = rows.select("c_custkey", mapping.document_column([Rule("c_name"), Rule("meta", flatten=names)], "camelCase").alias("doc"))
    return d.select("c_custkey", "doc.*", mapping.unflattened(F.col("doc"), names, "camelCase")["n_name"].alias("back"))


@entry("map_convert", "SELECT p_partkey, (p_size * 10)::BIGINT AS tenths, p_size::DOUBLE AS back FROM part")
def map_convert(spark, sf):
    d = S.table(spark, sf, "part").select("p_partkey", mapping.document_column([Rule("p_size", name="tenths", store=lambda c: (c * 10).cast("long"))]).alias("d"))
    return d.select("p_partkey", "d.tenths", (F.col("d.tenths") / 10).cast("double").alias("back"))


def _tagged(spark, sf, encoding: str) -> DataFrame:
    e = S.table(spark, sf, "events")
    payloads = {"purchase": F.struct("value"), "click": F.col("user_id"), "view": F.col("user_id"), "error": None, "signup": None}
    return e.select("event_id", mapping.union_column(F.col("event_type"), payloads, encoding).alias("u"))


@entry("enum_external", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS purchase, CASE WHEN event_type = 'click' THEN user_id END AS click, CASE WHEN event_type = 'error' THEN true END AS error FROM events")
def enum_external(spark, sf):
    return _tagged(spark, sf, "external").select("event_id", F.col("u.purchase.value").alias("purchase"), "u.click", "u.error")


@entry("enum_adjacent", "SELECT event_id, event_type AS kind, CASE WHEN event_type = 'purchase' THEN value END AS purchase, CASE WHEN event_type = 'view' THEN user_id END AS view FROM events")
def enum_adjacent(spark, sf):
    return _tagged(spark, sf, "adjacent").select("event_id", "u.kind", F.col("u.data.purchase.value").alias("purchase"), "u.data.view")


@entry("enum_internal", "SELECT event_id, event_type AS kind, CASE WHEN event_type = 'click' THEN user_id END AS click FROM events")
def enum_internal(spark, sf):
    return _tagged(spark, sf, "internal").select("event_id", "u.kind", "u.click")


@entry("enum_untagged", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Amount' WHEN user_id % 2 = 0 THEN 'User' ELSE 'Empty' END AS variant FROM events")
def enum_untagged(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user"))
    return e.select("event_id", mapping.first_fitting({"Amount": F.col("amount"), "User": F.col("user"), "Empty": None}).alias("variant"))


@entry("enum_other", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unknown' END AS kind FROM events")
def enum_other(spark, sf):
    return S.table(spark, sf, "events").select("event_id", mapping.known_tag(F.col("event_type"), ["click", "view"], other="unknown").alias("kind"))

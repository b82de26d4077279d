"""The registered queries over split documents, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotleaf.functions import columns as C
from hotleaf.functions import kernel as K
from hotleaf.operators.relation import Catalog, Relation
from hotleaf.sources import portability as P
from hotleaf.sources.checkpoints import shared_base

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MONEY = "decimal(18,2)"


def _query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- document tables
def _catalog(spark: SparkSession) -> Catalog:
    """A catalog of its own, in the folder that executors share."""
    return Catalog(spark, f"{shared_base(spark)}/hotleaf-{uuid.uuid4().hex}")


def _event_docs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("props").alias("doc"), "event_type", "user_id")


def _order_docs(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stats = F.struct(F.col("o_totalprice").cast(MONEY).alias("price"), F.col("o_orderpriority").alias("prio"))
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), stats.alias("stats"), F.col("o_custkey").alias("cust")))
    return o.select(F.col("o_orderkey").alias("id"), doc.alias("doc"), F.col("o_orderpriority").alias("priority"))


def _item_docs(spark, sf_dir) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_extendedprice").alias("x"))
    lists = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("i"))
    items = F.transform("i", lambda x: F.struct(x["line"].alias("line"), x["qty"].alias("qty"), x["part"].alias("part")))
    return lists.select(F.col("l_orderkey").alias("id"), F.to_json(F.struct(items.alias("items"), F.size("i").alias("n"))).alias("doc"))


_KINDS = {
    "events": (_event_docs, [["k"]]),
    "orders": (_order_docs, [["status"], ["stats", "price"]]),
    "boxes": (_order_docs, [["stats"]]),
    "items": (_item_docs, [["items", 0, "qty"], ["n"]]),
    "hot_items": (_item_docs, [["items"]]),
}
_KEPT: dict[tuple, str] = {}


def fresh(spark: SparkSession, sf_dir: str, kind: str, partition=None, types: dict | None = None) -> Relation:
    """A new relation of a kind of documents."""
    source, paths = _KINDS[kind]
    out = _catalog(spark).import_table(f"public.{kind}", source(spark, sf_dir), paths, partition=partition)
    for path, t in types or ():
        out = out.declare_path_type(path, t)
    return out


def kept(spark: SparkSession, sf_dir: str, kind: str) -> Relation:
    """One relation per kind and application, for queries that only read."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _KEPT:
        types = [(["stats", "price"], "numeric")] if kind == "orders" else []
        _KEPT[key] = fresh(spark, sf_dir, kind, types=types).catalog.root
    return Catalog(spark, _KEPT[key]).relation(f"public.{kind}")


def _ops(rows: DataFrame, *ops: dict) -> DataFrame:
    """The same operations for every id."""
    texts = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(K.dump(op)).alias("op")) for k, op in enumerate(ops)])
    return rows.select("id", F.explode(texts).alias("o")).select("id", "o.seq", "o.op")


def _set(path, value, **more) -> dict:
    return {"op": "set", "path": path, "value": value, **more}


def _order_fields(r: Relation) -> DataFrame:
    """id, status, price and cust of order documents, as values."""
    f = r.fields(status=["status"], price=["stats", "price"], cust=["cust"])
    return f.select("id", C.as_text(F.col("status")).alias("status"), F.col("price").cast(MONEY).alias("price"), F.col("cust").cast("long").alias("cust"))


_ORDERS = "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey AS cust FROM orders"


# ---------------------------------------------------------------- reads
@_query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def q01_roundtrip(spark, sf_dir):
    rows = kept(spark, sf_dir, "events").df()
    return rows.select("id", C.extract(F.col("doc"), ["k"]).cast("long").alias("k"), "event_type")


@_query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def q02_get_field_hot(spark, sf_dir):
    return kept(spark, sf_dir, "orders").fields(s=["status"]).select("id", C.as_text(F.col("s")).alias("status"))


@_query("SELECT o_orderkey AS id, o_custkey AS cust FROM orders")
def q03_get_field_cold(spark, sf_dir):
    return kept(spark, sf_dir, "orders").fields(c=["cust"]).select("id", F.col("c").cast("long").alias("cust"))


@_query("SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority AS prio FROM orders")
def q04_suffix_of_container(spark, sf_dir):
    f = kept(spark, sf_dir, "boxes").fields(p=["stats", "price"], q=["stats", "prio"])
    return f.select("id", F.col("p").cast(MONEY).alias("price"), C.as_text(F.col("q")).alias("prio"))


@_query("SELECT * FROM (VALUES (1, '1', 'number'), (2, '1', 'string'), (3, NULL, 'null'), (4, NULL, NULL), (5, '{\"a\": 1}', 'object'), (6, '[1, 2]', 'array')) t(id, shown, kind)")
def q05_text_kinds(spark, sf_dir):
    docs = [(1, '{"v":1}'), (2, '{"v":"1"}'), (3, '{"v":null}'), (4, "{}"), (5, '{"v":{"a":1}}'), (6, '{"v":[1,2]}')]
    split = spark.createDataFrame(docs, "id int, doc string").select("id", C.pack(F.col("doc"), (("v",),)).alias("s"))
    v = F.get("s.slots", 0)
    return split.select("id", C.as_text(v).alias("shown"), C.typeof(v).alias("kind"))


@_query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'")
def q06_find_ids_hot(spark, sf_dir):
    return kept(spark, sf_dir, "orders").find_ids(["status"], "P")


@_query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7")
def q07_find_ids_cold(spark, sf_dir):
    return kept(spark, sf_dir, "orders").find_ids(["cust"], 7)


@_query("SELECT event_id AS id FROM events WHERE event_id % 3 = 0")
def q08_find_null_not_missing(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.when(F.col("event_id") % 3 == 0, '{"a":null}').when(F.col("event_id") % 3 == 1, "{}").otherwise('{"a":1.0}')
    return _catalog(spark).import_table("public.nulls", e.select(F.col("event_id").alias("id"), doc.alias("doc")), [["a"]]).find_ids(["a"], None)


@_query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 100000")
def q09_range_numeric(spark, sf_dir):
    return kept(spark, sf_dir, "orders").find_ids_range(["stats", "price"], "numeric", 1000, 100000)


@_query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus >= 'F' AND o_orderstatus <= 'O'")
def q10_range_text(spark, sf_dir):
    return kept(spark, sf_dir, "orders").find_ids_range(["status"], "text", "F", "O", include_upper=True)


@_query("SELECT event_id AS id FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0")
def q11_range_boolean(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.when(F.col("event_id") % 5 == 0, '{"f":null}').otherwise(F.concat(F.lit('{"f":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}")))
    r = _catalog(spark).import_table("public.flags", e.select(F.col("event_id").alias("id"), doc.alias("doc")), [["f"]]).declare_path_type(["f"], "boolean")
    return r.find_ids_range(["f"], "boolean", True, True, include_upper=True)


# ---------------------------------------------------------------- edits
@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey AS cust FROM orders")
def q12_set_field_hot(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    return _order_fields(r.apply_ops(_ops(r.hot().where("id % 10 = 0"), _set(["status"], "X")))[0])


@_query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_custkey END AS cust FROM orders")
def q13_set_field_cold(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    return _order_fields(r.apply_ops(_ops(r.hot().where("id % 10 = 0"), _set(["cust"], -1)))[0])


@_query("SELECT o_orderkey AS id, 'Z' AS status, CAST(7.25 AS DECIMAL(18,2)) AS price, o_custkey AS cust FROM orders")
def q14_batch_last_wins(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    ops = (_set(["status"], "Y"), _set(["stats", "price"], 1), _set(["status"], "Z"), {"op": "increment", "path": ["stats", "price"], "delta": K.parse("6.25")})
    return _order_fields(r.apply_ops(_ops(r.hot(), *ops))[0])


@_query(_ORDERS)
def q15_create_missing_false(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    return _order_fields(r.apply_ops(_ops(r.hot(), _set(["absent"], 1, create_missing=False), _set(["absent", "deep"], 1)))[0])


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey AS cust FROM orders")
def q16_delete_hot_key(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    return _order_fields(r.apply_ops(_ops(r.hot().where("id % 2 = 0"), {"op": "delete", "path": ["status"]}))[0])


_RANKED = "SELECT l_orderkey AS id, CAST(l_quantity AS BIGINT) AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), l_extendedprice) AS nth, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


@_query(f"SELECT id, max(CASE WHEN nth = 2 THEN qty END) AS first_qty, max(n) AS n FROM ({_RANKED}) r GROUP BY id")
def q17_delete_array_shift(spark, sf_dir):
    r = fresh(spark, sf_dir, "items")
    f = r.apply_ops(_ops(r.hot(), {"op": "delete", "path": ["items", "0"]}))[0].fields(q=["items", "0", "qty"], n=["n"])
    return f.select("id", F.col("q").cast("long").alias("first_qty"), F.col("n").cast("long").alias("n"))


@_query("SELECT user_id AS id, sum(CAST(value AS DECIMAL(18,2))) AS total, count(*) AS n FROM events GROUP BY user_id")
def q18_increment_fold(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = e.select(F.col("user_id").alias("id")).distinct().withColumn("doc", F.lit('{"total": 0, "n": 0}'))
    r = _catalog(spark).import_table("public.counters", users, [["total"], ["n"]])
    # increments commute: one per user and field after a partial sum on the JVM
    sums = e.groupBy("user_id").agg(F.sum(F.col("value").cast(MONEY)).alias("t"), F.count(F.lit(1)).alias("c"))
    op = lambda path, x: F.concat(F.lit(f'{{"op": "increment", "path": ["{path}"], "delta": '), x.cast("string"), F.lit("}"))
    ops = sums.select(F.col("user_id").alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("seq"), op("total", F.col("t")).alias("op")), F.struct(F.lit(1).alias("seq"), op("n", F.col("c")).alias("op")))).alias("o"))
    f = r.apply_ops(ops.select("id", "o.seq", "o.op"))[0].fields(t=["total"], n=["n"])
    return f.select("id", F.col("t").cast("decimal(38,2)").alias("total"), F.col("n").cast("long").alias("n"))


@_query("SELECT user_id AS id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id")
def q19_last_write_wins(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = e.select(F.col("user_id").alias("id")).distinct().withColumn("doc", F.lit('{"last": null}'))
    r = _catalog(spark).import_table("public.lasts", users, [["last"]])
    ops = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.concat(F.lit('{"op": "set", "path": ["last"], "value": "'), "event_type", F.lit('"}')).alias("op"))
    return r.apply_ops(ops)[0].fields(l=["last"]).select("id", C.as_text(F.col("l")).alias("last"))


@_query("SELECT o_orderkey AS id, 'P2' AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, 5 AS added FROM orders")
def q20_json_patch(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    patch = [
        {"op": "add", "path": "/new", "value": {"a": [1, 5]}}, {"op": "test", "path": "/new", "value": K.parse('{"a": [1.0, 5]}')},
        {"op": "replace", "path": "/status", "value": "P2"}, {"op": "test", "path": "/status", "value": "P2"}, {"op": "remove", "path": "/new/a/0"},
    ]
    f = r.apply_ops(_ops(r.hot(), {"op": "patch", "patch": patch}))[0].fields(s=["status"], p=["stats", "price"], a=["new", "a", "0"])
    return f.select("id", C.as_text(F.col("s")).alias("status"), F.col("p").cast(MONEY).alias("price"), F.col("a").cast("int").alias("added"))


@_query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderstatus AS moved, CAST(NULL AS BIGINT) AS cust FROM orders")
def q21_patch_move_copy(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    patch = [{"op": "copy", "from": "/status", "path": "/stats/prio"}, {"op": "move", "from": "/cust", "path": "/owner"}]
    f = r.apply_ops(_ops(r.hot(), {"op": "patch", "patch": patch}))[0].fields(s=["status"], m=["stats", "prio"], c=["cust"])
    return f.select("id", C.as_text(F.col("s")).alias("status"), C.as_text(F.col("m")).alias("moved"), F.col("c").cast("long").alias("cust"))


@_query("""SELECT event_id AS id, CAST(json_extract_string(json_merge_patch(props, '{"k":null,"x":{"y":1}}'), '$.k') AS BIGINT) AS k, CAST(json_extract_string(json_merge_patch(props, '{"k":null,"x":{"y":1}}'), '$.x.y') AS BIGINT) AS y FROM events""")
def q22_merge_patch(spark, sf_dir):
    r = fresh(spark, sf_dir, "events")
    f = r.apply_ops(_ops(r.hot(), {"op": "merge", "patch": {"k": None, "x": {"y": 1}}}))[0].fields(k=["k"], y=["x", "y"])
    return f.select("id", F.col("k").cast("long").alias("k"), F.col("y").cast("long").alias("y"))


@_query("""SELECT coalesce(a.event_id, b.id) AS id, CASE WHEN b.id IS NULL THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -b.id END AS k, CASE WHEN b.id IS NULL THEN event_type WHEN event_id IS NULL THEN 'new' ELSE 'new' END AS event_type, user_id
FROM events a FULL JOIN (SELECT event_id * 2 AS id FROM events) b ON a.event_id = b.id""")
def q23_upsert(spark, sf_dir):
    r = fresh(spark, sf_dir, "events")
    new = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") * 2).alias("id"))
    new = new.select("id", F.concat(F.lit('{"k": '), (-F.col("id")).cast("string"), F.lit("}")).alias("doc"), F.lit("new").alias("event_type"))
    f = r.upsert(new).fields("event_type", "user_id", k=["k"])
    return f.select("id", F.col("k").cast("long").alias("k"), "event_type", "user_id")


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'fresh' ELSE o_orderstatus END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey AS cust FROM orders")
def q24_conditional_update(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    held = r.tokens().select("id", F.when(F.col("id") % 2 == 0, F.col("token")).otherwise(F.concat("token", F.lit("0"))).alias("held"))
    current = held.join(r.tokens(), "id").where("held = token")
    return _order_fields(r.apply_ops(_ops(current, _set(["status"], "fresh")))[0])


@_query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'changed' ELSE event_type END AS event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q25_update_business(spark, sf_dir):
    r = fresh(spark, sf_dir, "events")
    f = r.update_business(r.hot().where("id % 4 = 0").select("id", F.lit("changed").alias("event_type"))).fields("event_type", k=["k"])
    return f.select("id", "event_type", F.col("k").cast("long").alias("k"))


@_query(f"{_ORDERS} WHERE o_orderkey % 3 <> 0")
def q26_delete_rows(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    return _order_fields(r.delete(r.hot().where("id % 3 = 0").select("id")))


# ---------------------------------------------------------------- over relations
@_query("SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_custkey")
def q27_semi_join(spark, sf_dir):
    r = kept(spark, sf_dir, "orders")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(r.find_ids(["status"], "F").withColumnRenamed("id", "o_orderkey"), "o_orderkey", "left_semi")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT event_id, o_orderstatus AS status FROM events LEFT JOIN orders ON event_id = o_orderkey")
def q28_outer_join(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    f = kept(spark, sf_dir, "orders").fields(s=["status"])
    return e.join(f, F.col("event_id") == F.col("id"), "left").select("event_id", C.as_text(F.col("s")).alias("status"))


@_query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS g, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 10 GROUP BY 1, 2")
def q29_agg_on_hot(spark, sf_dir):
    f = kept(spark, sf_dir, "events").fields("event_type", k=["k"]).withColumn("k", F.col("k").cast("long"))
    return f.where("k >= 10").groupBy("event_type", (F.col("k") % 10).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@_query("SELECT id, status, price, CAST(rank() OVER (PARTITION BY status ORDER BY price DESC, id) AS INTEGER) AS nth FROM (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders) t")
def q30_window_on_hot(spark, sf_dir):
    f = kept(spark, sf_dir, "orders").fields(s=["status"], p=["stats", "price"])
    f = f.select("id", C.as_text(F.col("s")).alias("status"), F.col("p").cast(MONEY).alias("price"))
    return f.withColumn("nth", F.rank().over(Window.partitionBy("status").orderBy(F.desc("price"), "id")))


@_query("SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders ORDER BY price DESC, id LIMIT 20")
def q31_topk_on_hot(spark, sf_dir):
    f = kept(spark, sf_dir, "orders").fields(p=["stats", "price"])
    return f.select("id", F.col("p").cast(MONEY).alias("price")).orderBy(F.desc("price"), "id").limit(20)


@_query("SELECT count(*) AS n, 0 AS differences FROM orders")
def q32_migrate_layout(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    moved = P.migrate_layout(r, "public.moved", [["cust"], ["stats"]])
    return moved.hot().agg(F.count(F.lit(1)).alias("n")).crossJoin(P.differences(r, moved).agg(F.count(F.lit(1)).cast("int").alias("differences")))


@_query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey >= 2000 AND o_orderkey < 3000")
def q33_range_partition(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders", partition=[{"from": None, "to": 2000}, {"from": 2000, "to": 3000}, {"from": 3000, "to": None}])
    return r.hot((2000, 3000)).select("id", C.as_text(F.col("h0")).alias("status"))


@_query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
def q34_hash_partition(spark, sf_dir):
    return fresh(spark, sf_dir, "orders", partition={"strategy": "hash", "modulus": 4}).hot().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@_query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'")
def q35_row_policy(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders").grant("1-URGENT", "read").enable_rls()
    r = r.set_policy("own", "select", ["public"], using="priority = current_user()")
    r = r.set_policy("open", "select", ["public"], using="""policy_text('["status"]') <> 'P'""", restrictive=True)
    return r.catalog.as_user("1-URGENT").relation(r.meta.name).fields("priority").select("id", "priority")


@_query("SELECT 'public.orders' AS name, true AS layout_ok, count(*) AS rows_checked, CAST(0 AS BIGINT) AS invalid_indexes FROM orders")
def q36_check_table(spark, sf_dir):
    return kept(spark, sf_dir, "orders").catalog.check_all(True).select(F.col("view").alias("name"), "layout_ok", "rows_checked", "invalid_indexes")


@_query("SELECT event_id AS id, CAST(event_id AS VARCHAR) AS id_text, CAST(user_id AS VARCHAR) AS user_text, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q37_export_rows(spark, sf_dir):
    rows = P.export_rows(kept(spark, sf_dir, "events"))
    get = lambda path: F.get_json_object("row", path)
    return rows.select("id", get("$.id").alias("id_text"), get("$.business.user_id").alias("user_text"), get("$.doc.k").cast("long").alias("k"))


@_query("""WITH e AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'insert' WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS kind FROM events),
l AS (SELECT user_id, arg_max(kind, event_id) AS kind, arg_max(CASE WHEN kind <> 'delete' THEN event_id END, CASE WHEN kind <> 'delete' THEN event_id END) AS last FROM e GROUP BY user_id)
SELECT user_id AS id, last FROM l WHERE kind <> 'delete'""")
def q38_cdc_replay(spark, sf_dir):
    from hotleaf.streaming import replay as R

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("position"), F.when(nth == 1, "insert").when(F.col("event_type") == "error", "delete").otherwise("insert").alias("kind"), F.concat(F.lit('{"last": '), F.col("event_id").cast("string"), F.lit("}")).alias("doc"))
    catalog = _catalog(spark)
    catalog.create("public.stream", [["last"]]).changed(follower="stream")
    R.events_of(rows, ["doc"]).write.text(f"{catalog.root}/changes")
    out = R.Replay(catalog, "public.stream", f"{catalog.root}/changes", f"{catalog.root}/progress").run()
    return out.fields(l=["last"]).select("id", F.col("l").cast("long").alias("last"))


@_query("SELECT CASE WHEN event_id % 4 = 0 THEN 'string' WHEN event_id % 4 = 1 THEN 'array' WHEN event_id % 4 = 2 THEN 'number' ELSE 'missing' END AS kind, count(*) AS n FROM events GROUP BY 1")
def q39_typeof_histogram(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.col("event_id") % 4
    doc = F.when(m == 0, '{"v": "x"}').when(m == 1, '{"v": []}').when(m == 2, '{"v": 1e2}').otherwise("{}")
    split = e.select(C.pack(doc, (("v",),)).alias("s"))
    return split.select(F.coalesce(C.typeof(F.get("s.slots", 0)), F.lit("missing")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT key, count(*) AS n FROM (SELECT unnest(['cust', 'stats', 'status']) AS key FROM orders) t GROUP BY key")
def q40_object_keys(spark, sf_dir):
    return kept(spark, sf_dir, "orders").df().select(F.explode(C.object_keys(F.col("doc"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))

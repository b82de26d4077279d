"""Registered queries over management, constraints, policies, files, migrations and the smaller functions, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.errors import DocError
from hotleaf.functions import columns as C
from hotleaf.functions import kernel as K
from hotleaf.functions import sql as S
from hotleaf.operators.relation import Relation, column_type
from hotleaf.plans.queries import ORACLE_SQL, QUERIES, _catalog, _item_docs, _order_fields, _query, _ops, _set, fresh, kept
from hotleaf.sources import portability as P

__all__ = ["ORACLE_SQL", "QUERIES"]


def outcome(fn, *args, **more) -> str:
    """The error state that a call ends with, or ok."""
    try:
        fn(*args, **more)
    except DocError as e:
        return e.sqlstate
    return "ok"


def _supplier_docs(spark, sf_dir) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    doc = F.to_json(F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_suppkey").alias("n")).alias("stats")))
    return s.select(F.col("s_suppkey").alias("id"), doc.alias("doc"), F.col("s_nationkey").alias("nation"))


def _suppliers(spark, sf_dir, name: str = "public.suppliers", partition=None) -> Relation:
    return _catalog(spark).import_table(name, _supplier_docs(spark, sf_dir), [["name"], ["stats", "n"]], partition=partition)


def _named(r: Relation) -> DataFrame:
    """id, name, n and nation of supplier documents, as values."""
    f = r.fields("nation", s=["name"], n=["stats", "n"])
    return f.select("id", C.as_text(F.col("s")).alias("name"), F.col("n").cast("long").alias("n"), "nation")


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_SUPPLIERS = "SELECT s_suppkey AS id, s_name AS name, s_suppkey AS n, s_nationkey AS nation FROM supplier"


# ---------------------------------------------------------------- sources and sinks
@_query(f"{_SUPPLIERS} UNION ALL SELECT s_suppkey + 1000000, 'new', s_suppkey + 1000000, s_nationkey FROM supplier")
def q41_insert_rows(spark, sf_dir):
    new = _supplier_docs(spark, sf_dir).select((F.col("id") + 1000000).alias("id"), F.format_string('{"name": "new", "stats": {"n": %d}}', F.col("id") + 1000000).alias("doc"), "nation")
    return _named(_suppliers(spark, sf_dir).insert(new))


@_query(_SUPPLIERS)
def q42_export_and_import_file(spark, sf_dir):
    r = _suppliers(spark, sf_dir)
    P.export_file(r, f"{r.catalog.root}-file.jsonl")
    return _named(P.import_file(r.catalog, f"{r.catalog.root}-file.jsonl", "public.back"))


@_query("SELECT count(*) AS n, true AS digest_ok, true AS order_ok FROM supplier")
def q43_export_digest(spark, sf_dir):
    r = _suppliers(spark, sf_dir)
    file = f"{r.catalog.root}-digest.jsonl"
    footer = P.export_file(r, file)
    lines = [x["value"] for x in spark.read.text(file, wholetext=True).collect()][0].splitlines(keepends=True)
    ids = [int(K.parse(x)["row"]["id"]) for x in lines[1:-1]]
    return _rows(spark, [(footer["rows"], hashlib.sha256("".join(lines[:-1]).encode()).hexdigest() == footer["sha256"], ids == sorted(ids))], "n long, digest_ok boolean, order_ok boolean")


@_query("SELECT * FROM (VALUES ('format', '2'), ('name', 'public.suppliers'), ('paths', '[[\"name\"], [\"stats\", \"n\"]]'), ('columns', '{\"nation\": \"int\"}'), ('mode', 'hash')) t(item, held)")
def q44_export_manifest(spark, sf_dir):
    m = P.export_manifest(_suppliers(spark, sf_dir))
    return _rows(spark, [(k, m[k] if isinstance(m[k], str) else K.dump(m[k])) for k in ("format", "name", "paths", "columns", "mode")], "item string, held string")


@_query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def q45_import_rows(spark, sf_dir):
    r = kept(spark, sf_dir, "events")
    out = P.import_rows(_catalog(spark).create("public.copy", r.meta.paths, r.meta.columns), P.export_rows(r))
    return out.fields("event_type", k=["k"]).select("id", F.col("k").cast("long").alias("k"), "event_type")


@_query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '[[\"k\"]]' AS paths, 'object' AS template FROM events")
def q46_cold_envelope(spark, sf_dir):
    S.register(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "props AS doc", """'[["k"]]' AS paths""")
    packed = e.selectExpr("id", "paths", "doc_pack(doc, paths) AS p")
    back = packed.selectExpr("id", "doc_restore_as(p.cold, p.slots, paths) AS doc", "doc_paths(p.cold) AS paths", "doc_typeof(doc_template(p.cold)) AS template")
    return back.select("id", F.get_json_object("doc", "$.k").cast("long").alias("k"), "paths", "template")


@_query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS edited, true AS valid FROM events")
def q47_document_functions(spark, sf_dir):
    S.register(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "props AS doc")
    out = e.selectExpr("id", "doc_object_field(doc, array('k')) AS k", "doc_field(doc_increment(doc, array('k'), 1), array('k')) AS edited", """doc_valid_paths('[["k"]]') AND doc_valid_path(array('k', '0')) AS valid""")
    return out.select("id", F.col("k").cast("long").alias("k"), F.col("edited").cast("long").alias("edited"), "valid")


@_query("SELECT event_id AS id, [0, 1] AS candidates, CAST(event_id % 2 AS INTEGER) AS route FROM events")
def q48_routes(spark, sf_dir):
    S.register(spark)
    doc = """IF(event_id % 2 = 0, '{"box": [{"size": 1}]}', '{"box": {"0": {"size": 1}}}')"""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", f"{doc} AS doc", """'[["box",0,"size"],["box","0","size"]]' AS paths""", "array('box', '0', 'size') AS path")
    return e.selectExpr("id", "doc_candidates(paths, path) AS candidates", "doc_route(paths, path, doc_slots(doc, paths)) AS route")


@_query("SELECT * FROM (VALUES ('bigint', 'bigint'), ('int[]', '42601'), ('varchar(8)', 'varchar(8)'), ('decimal(12,3)', 'decimal(12,3)'), ('array<int>', 'array<int>'), ('int) drop', '42601'), ('map<int,int>', '22023')) t(declared, held)")
def q49_column_types(spark, sf_dir):
    rows = []
    for d in ("bigint", "int[]", "varchar(8)", "decimal(12,3)", "array<int>", "int) drop", "map<int,int>"):
        state = outcome(column_type, d)
        rows.append((d, column_type(d).simpleString() if state == "ok" else state))
    return _rows(spark, rows, "declared string, held string")


# ---------------------------------------------------------------- searches
@_query("SELECT o_orderkey AS id FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 100000")
def q50_find_ids_compared(spark, sf_dir):
    return kept(spark, sf_dir, "orders").find_ids_compared(["stats", "price"], ">=", 100000)


@_query("SELECT true AS pushed, false AS reads_cold, true AS cold_is_read_for_cold")
def q51_explain_find_ids(spark, sf_dir):
    r = kept(spark, sf_dir, "orders")
    hot, cold = r.explain_find_ids(["status"], "P"), r.explain_find_ids(["cust"], 7)
    return _rows(spark, [("EqualTo(h0_key" in hot, "template" in hot.split("== Physical Plan ==")[1], "template" in cold.split("== Physical Plan ==")[1])], "pushed boolean, reads_cold boolean, cold_is_read_for_cold boolean")


@_query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'")
def q52_search_without_rewrite(spark, sf_dir):
    r = kept(spark, sf_dir, "orders")
    plain = type(r.catalog)(spark, r.catalog.root, rewrite=False)
    return plain.relation(r.meta.name).find_ids(["status"], "P")


@_query("SELECT s_suppkey AS id, 'INDEX by_name ON public.suppliers (h0)' AS shown FROM supplier WHERE s_name >= 'Supplier#000000003'")
def q53_path_index(spark, sf_dir):
    r = _suppliers(spark, sf_dir).create_path_index("by_name", ["name"], "text")
    return r.find_ids_range(["name"], "text", "Supplier#000000003").select("id", F.lit(r.index_text("by_name")).alias("shown"))


# ---------------------------------------------------------------- edits
@_query("SELECT o_orderkey AS id, o_orderkey % 10 = 0 AS changed FROM orders")
def q54_revisions_of_edits(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    before = r.tokens()
    after = r.apply_ops(_ops(r.hot().where("id % 10 = 0"), _set(["status"], "R")))[0].tokens().withColumnRenamed("token", "now")
    return before.join(after, "id").select("id", (F.col("token") != F.col("now")).alias("changed"))


@_query(f"SELECT id, CASE WHEN id = 1 THEN 'second' ELSE name END AS name, n, nation, '40001' AS stale FROM ({_SUPPLIERS}) t")
def q55_edit_if_revision(spark, sf_dir):
    r = _suppliers(spark, sf_dir)
    token = r.row_revision(1)
    r, newer = r.set_fields_if_revision(1, token, [{"path": ["name"], "value": "first"}])
    stale = outcome(r.set_fields_if_revision, 1, token, [{"path": ["name"], "value": "lost"}])
    r, _ = r.set_fields_if_revision(1, newer, [{"path": ["name"], "value": "second"}])
    return _named(r).withColumn("stale", F.lit(stale))


@_query(f"SELECT id, name, n, nation, '25006' AS fenced FROM ({_SUPPLIERS}) t")
def q56_write_fence(spark, sf_dir):
    r, _ = _suppliers(spark, sf_dir).fence()
    return _named(r).withColumn("fenced", F.lit(outcome(r.set_field, 1, ["name"], "lost")))


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE o_orderstatus END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey AS cust FROM orders")
def q57_patch_with_test(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders")
    patch = [{"op": "test", "path": "/even", "value": 0}, {"op": "replace", "path": "/status", "value": "T"}]
    marked = r.apply_ops(_ops(r.hot().where("id % 2 = 0"), _set(["even"], K.parse("0.0"))))[0]
    return _order_fields(marked.apply_ops(_ops(marked.hot().where("id % 2 = 0"), {"op": "patch", "patch": patch}))[0])


@_query("SELECT max(s_suppkey) AS top, count(*) AS n, true AS later, true AS other_epoch FROM supplier")
def q58_reinitialize(spark, sf_dir):
    r = _suppliers(spark, sf_dir)
    top = r.hot().agg(F.max("row_revision")).first()[0]
    new = r.reinitialize("restore")
    found = F.lit(new.meta.next_revision > top).alias("later"), F.lit(new.meta.epoch != r.meta.epoch).alias("other_epoch")
    return new.hot().agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).select("*", *found)


# ---------------------------------------------------------------- management
@_query(f"{_SUPPLIERS} WHERE s_suppkey < 5 OR s_suppkey >= 8")
def q59_detach_partition(spark, sf_dir):
    r = _suppliers(spark, sf_dir, partition=[{"from": None, "to": 5}, {"from": 5, "to": 8}, {"from": 8, "to": None}])
    return _named(r.detach_partition("1")[0])


@_query(_SUPPLIERS)
def q60_attach_partition(spark, sf_dir):
    r, leaf = _suppliers(spark, sf_dir, partition=[{"from": None, "to": 5}, {"from": 5, "to": None}]).detach_partition("1")
    return _named(r.attach_partition(leaf))


@_query("SELECT * FROM (VALUES ('overlap', '22023'), ('no range', '23514'), ('added', 'ok')) t(step, state)")
def q61_create_partition(spark, sf_dir):
    r = _catalog(spark).create("public.parts", [["a"]], partition=[{"from": 0, "to": 10}])
    row = _rows(spark, [(15, "{}")], "id long, doc string")
    rows = [("overlap", outcome(r.create_partition, 5, 20)), ("no range", outcome(r.insert, row))]
    return _rows(spark, [*rows, ("added", outcome(r.create_partition(10, 20).insert, row))], "step string, state string")


@_query("SELECT 'public.other' AS name, count(*) AS n, '42704' AS old, '42704' AS dropped FROM supplier")
def q62_rename_and_drop(spark, sf_dir):
    r = _suppliers(spark, sf_dir)
    other = r.catalog.rename("public.suppliers", "public.other")
    n, old = other.hot().count(), outcome(r.catalog.relation, "public.suppliers")
    r.catalog.drop("public.other")
    return _rows(spark, [(other.meta.name, n, old, outcome(r.catalog.relation, "public.other"))], "name string, n long, old string, dropped string")


@_query(f"SELECT id, name, n, coalesce(nation, 77) AS nation FROM (SELECT id, name, n, nation FROM ({_SUPPLIERS}) a UNION ALL SELECT id + 1000000, name, n, NULL FROM ({_SUPPLIERS}) b) t")
def q63_default(spark, sf_dir):
    r = _suppliers(spark, sf_dir).set_default("nation", 77)
    return _named(r.insert(_supplier_docs(spark, sf_dir).select((F.col("id") + 1000000).alias("id"), "doc")))


@_query("SELECT * FROM (VALUES ('null', '23502'), ('long', '22001'), ('kind', '23514'), ('missing', '23514'), ('typed', '23514'), ('good', 'ok')) t(row, state)")
def q64_constraints(spark, sf_dir):
    r = _catalog(spark).create("public.strict", [["n"], ["s"]], {"label": "varchar(4)"}).set_not_null("label")
    r = r.add_field_check("text", ["s"], "string", required=True).declare_path_type(["n"], "numeric")
    tries = {"null": (None, '{"s":"x"}'), "long": ("longer", '{"s":"x"}'), "kind": ("a", '{"s":1}'), "missing": ("a", "{}"), "typed": ("a", '{"s":"x","n":"1"}'), "good": ("a", '{"s":"x","n":1}')}
    return _rows(spark, [(k, outcome(r.insert, _rows(spark, [(1, *row)], "id long, label string, doc string"))) for k, row in tries.items()], "row string, state string")


@_query("SELECT event_id AS id, upper(event_type) = 'CLICK' AS same FROM events")
def q65_collation(spark, sf_dir):
    r = fresh(spark, sf_dir, "events").set_collation("event_type", "UTF8_LCASE")
    return r.df().select("id", (F.col("event_type") == "CLICK").alias("same"))


@_query("SELECT count(*) AS n, true AS sized, 8 AS buckets FROM events")
def q66_storage_and_stats(spark, sf_dir):
    r = kept(spark, sf_dir, "events")
    s = r.stats()
    sized = s["total_bytes"] == s["hot_bytes"] + s["cold_bytes"] > 0 and r.storage().endswith(r.meta.name)
    return _rows(spark, [(s["rows"], sized, s["buckets"])], "n long, sized boolean, buckets int")


# ---------------------------------------------------------------- row policies
def _guarded(spark, sf_dir) -> Relation:
    """Suppliers of even nations are seen and changed by all, and stay of even nations."""
    r = _suppliers(spark, sf_dir).grant("ann", "write").grant("bob", "read").enable_rls()
    r = r.set_policy("see", "select", ["public"], using="nation < 1000").set_policy("change", "update", ["public"], using="id < 4", check="nation < 500")
    return r.set_policy("add", "insert", ["ann"], check="nation = 7")


@_query("SELECT * FROM (VALUES ('update', 'ok'), ('update out of check', '42501'), ('replace own', 'ok'), ('replace a hidden row', '42501'), ('insert', 'ok'), ('insert out of check', '42501'), ('a reader writes', '42501'), ('a stranger reads', '42501'), ('after the policy is dropped', '42501')) t(step, state)")
def q67_policies_on_writes(spark, sf_dir):
    r = _guarded(spark, sf_dir)
    mine = lambda user: r.catalog.as_user(user).relation(r.meta.name)
    business = lambda id_, n: outcome(mine("ann").update_business, _rows(spark, [(id_, n)], "id long, nation int"))
    rows = [("update", business(1, 3)), ("update out of check", business(1, 600))]
    rows += [("replace own", outcome(mine("ann").upsert_document, 2, {}, {"nation": 4})), ("replace a hidden row", outcome(mine("ann").upsert_document, 5, {}, {"nation": 7}))]
    rows += [("insert", outcome(mine("ann").upsert_document, 1000001, {}, {"nation": 7})), ("insert out of check", outcome(mine("ann").upsert_document, 1000002, {}, {"nation": 8}))]
    rows += [("a reader writes", outcome(mine("bob").set_field, 1, ["name"], "x")), ("a stranger reads", outcome(mine("eve").fields))]
    mine(None).drop_policy("add")
    rows.append(("after the policy is dropped", outcome(mine("ann").upsert_document, 1000003, {}, {"nation": 7})))
    return _rows(spark, rows, "step string, state string")


@_query("SELECT id, CASE WHEN id < 4 THEN 'seen' ELSE name END AS name, n, nation FROM (SELECT s_suppkey AS id, s_name AS name, s_suppkey AS n, s_nationkey AS nation FROM supplier) t")
def q68_edits_skip_hidden_rows(spark, sf_dir):
    r = _guarded(spark, sf_dir)
    ann = r.catalog.as_user("ann").relation(r.meta.name)
    ann.apply_ops(_ops(r.hot(), _set(["name"], "seen")))
    return _named(r.catalog.relation(r.meta.name))


# ---------------------------------------------------------------- migrations and replicas
def _changes(spark, rows: DataFrame, columns: list[str]) -> DataFrame:
    from hotleaf.streaming import replay as R

    return R.parsed(R.events_of(rows, columns))


@_query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'moved' ELSE s_name END AS name, s_suppkey AS n, s_nationkey AS nation, 'completed' AS state, '55000' AS early FROM supplier")
def q69_online_migration(spark, sf_dir):
    from hotleaf.streaming import replay as R

    r = _suppliers(spark, sf_dir)
    job = R.Migration.prepare(r.catalog, r.meta.name, "public.next", [["stats"], ["name"]])
    job.copy()
    source = r.catalog.relation(r.meta.name)
    source, _ = source.apply_ops(_ops(source.hot().where("id % 2 = 0"), _set(["name"], "moved")))
    even = source.df().where("id % 2 = 0").select("id", "doc", "nation", F.lit("update").alias("kind"), (F.col("id") + 100).alias("position"))
    job.catch_up(_changes(spark, even, ["doc", "nation"]))
    early = outcome(job.complete)
    r.catalog.relation(r.meta.name).fence()
    out = job.complete()
    return _named(out).select("*", F.lit(job.record()["state"]).alias("state"), F.lit(early).alias("early"))


@_query("SELECT * FROM (VALUES ('mark', '55000'), ('abort', 'aborted'), ('again', '55000'), ('plan', 'snapshot'), ('online part', '42501')) t(step, state)")
def q70_migration_states(spark, sf_dir):
    from hotleaf.streaming import replay as R

    r = _suppliers(spark, sf_dir)
    job = R.Migration.prepare(r.catalog, r.meta.name, "public.next", [["stats"]])
    rows = [("mark", outcome(job.mark, "ready")), ("abort", job.abort()["state"]), ("again", outcome(job.copy))]
    rows += [("plan", P.migration_plan(r, "public.x", [["a"]])["mode"]), ("online part", outcome(P.migration_plan, r, "public.x", [["a"]], {"mode": "online", "subset": True}))]
    return _rows(spark, rows, "step string, state string")


@_query("SELECT s_suppkey AS id, s_name AS name, s_suppkey AS n, s_nationkey AS nation, '25006' AS as_replica, 'stopped' AS state FROM supplier WHERE s_suppkey % 3 <> 0")
def q71_replica_takes_over(spark, sf_dir):
    from hotleaf.streaming import replay as R

    r = _suppliers(spark, sf_dir)
    replica = R.Replica.prepare(r.catalog, P.export_manifest(r), "public.replica")
    replica.register()
    every = r.df().select("id", "doc", "nation", F.lit("insert").alias("kind"), F.col("id").alias("position"))
    gone = every.where("id % 3 = 0").withColumn("kind", F.lit("delete")).withColumn("position", F.col("id") + 10_000_000)
    out = replica.follow(_changes(spark, every.unionByName(gone), ["doc", "nation"]))
    refused = outcome(out.set_field, 1, ["name"], "x")
    state = replica.stop()["state"]
    return _named(replica.takeover(out.meta.applied)).select("*", F.lit(refused).alias("as_replica"), F.lit(state).alias("state"))


# ---------------------------------------------------------------- inspecting and building documents
_ITEMS = "SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS qty, l_partkey AS part FROM lineitem"


@_query(f"SELECT id, count(*) AS length, CAST(sum(qty) AS BIGINT) AS qty, count(*) * 3 AS fields FROM ({_ITEMS}) t GROUP BY id")
def q72_elements_and_each(spark, sf_dir):
    f = kept(spark, sf_dir, "hot_items").fields(i=["items"])
    each = f.select("id", C.array_length(F.col("i")).cast("long").alias("length"), F.explode(C.elements(F.col("i"))).alias("item"))
    each = each.select("id", "length", F.get_json_object("item", "$.qty").cast("long").alias("qty"), F.size(C.each(F.col("item"))).alias("fields"))
    return each.groupBy("id", "length").agg(F.sum("qty").alias("qty"), F.sum("fields").alias("fields"))


@_query("SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS cust, CAST(2 AS BIGINT) AS length FROM orders")
def q73_build_documents(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pair = C.build_array(C.quoted(F.col("o_orderstatus")), F.col("o_custkey").cast("string"))
    built = o.select(F.col("o_orderkey").alias("id"), C.build_object(pair=pair, none=F.lit(None).cast("string")).alias("doc"))
    at = lambda k: C.extract(F.col("doc"), ["pair", str(k)])
    return built.select("id", C.as_text(at(0)).alias("status"), at(1).cast("long").alias("cust"), C.array_length(C.extract(F.col("doc"), ["pair"])).cast("long").alias("length"))


@_query(f"SELECT id, count(*) AS n FROM ({_ITEMS}) t GROUP BY id")
def q74_snapshot_copy(spark, sf_dir):
    source = _catalog(spark).import_table("public.items", _item_docs(spark, sf_dir), [["n"]])
    copy = P.import_manifest(source.catalog, P.export_manifest(source), "public.snapshot").insert(source.df())
    return copy.fields(n=["n"]).select("id", F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------- SQL over relations
@_query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O'")
def q75_sql_text_predicate(spark, sf_dir):
    r = kept(spark, sf_dir, "orders")
    return r.catalog.sql("SELECT id, doc->>'status' AS status FROM o WHERE doc->>'status' = 'O'", o=r)


@_query("SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 200000 AND o_orderstatus = 'F'")
def q76_sql_typed_predicate(spark, sf_dir):
    r = fresh(spark, sf_dir, "orders", types=[(["stats", "price"], "numeric")])
    text = """SELECT id, CAST((doc->'stats'->>'price')::numeric AS DECIMAL(18,2)) AS price FROM public.orders
              WHERE (doc->'stats'->>'price')::numeric >= 200000 AND doc->'status' = '"F"'"""
    return r.catalog.sql(text)


@_query("SELECT o_orderstatus AS status, o_orderpriority AS prio, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' GROUP BY ALL")
def q77_sql_conjuncts(spark, sf_dir):
    r = kept(spark, sf_dir, "orders")
    text = """SELECT o.doc->>'status' AS status, o.doc #>> '{stats,prio}' AS prio, count(*) AS n FROM o
              WHERE o.doc->'stats'->>'prio' = :prio AND o.doc->>'status' = 'O' GROUP BY ALL"""
    return r.catalog.sql(text, {"prio": "1-URGENT"}, o=r)


_FIRST_ITEMS = """SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS qty FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), l_extendedprice) = 1"""


@_query(f"SELECT o_orderkey AS id, o_orderstatus AS status, qty FROM orders JOIN ({_FIRST_ITEMS}) l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def q78_sql_join_of_relations(spark, sf_dir):
    o, i = kept(spark, sf_dir, "orders"), kept(spark, sf_dir, "items")
    text = """SELECT o.id, o.doc->>'status' AS status, CAST(i.doc->'items'->0->>'qty' AS BIGINT) AS qty
              FROM o JOIN i ON o.id = i.id WHERE o.doc->>'status' <> 'P'"""
    return o.catalog.sql(text, o=o, i=i)

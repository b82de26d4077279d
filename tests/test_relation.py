"""Relations: reads, edits, constraints, commits, partitions, policies, copies and replay."""

import pytest
from pyspark.sql import functions as F

from hotleaf.errors import DocError
from hotleaf.functions import kernel as K
from hotleaf.operators.relation import Catalog
from hotleaf.sources import portability as P
from hotleaf.streaming import replay as R


def state(fn, *args, **kw):
    with pytest.raises(DocError) as e:
        fn(*args, **kw)
    return e.value.sqlstate


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "root"))


DOCS = [
    (1, '{"state":"ready","count":1,"items":[{"name":"a"}],"cold":{"x":1}}', "t1"),
    (2, '{"state":null,"count":2.50,"items":{"0":{"name":"b"}}}', "t2"),
    (3, '{"count":3}', None),
    (4, "[1,2]", "t1"),
]


@pytest.fixture
def docs(catalog, spark):
    rows = spark.createDataFrame(DOCS, "id long, doc string, tenant string")
    return catalog.import_table("public.docs", rows, [["state"], ["count"], ["items", 0, "name"]])


def doc_of(relation, id_):
    return relation.df().where(f"id = {id_}").first()["doc"]


def ids(frame):
    return sorted(r[0] for r in frame.collect())


def test_round_trip(docs):
    got = {r["id"]: (r["doc"], r["tenant"]) for r in docs.df().collect()}
    assert got == {i: (K.dump(K.parse(d)), t) for i, d, t in DOCS}


def test_fields_and_searches(docs):
    assert docs.get_field(1, ["state"]) == '"ready"'
    assert docs.get_field(2, ["state"]) == "null"
    assert docs.get_field(3, ["state"]) is None
    assert docs.get_field(1, ["items", "0", "name"]) == '"a"'
    assert docs.get_field(2, ["items", "0", "name"]) == '"b"'
    assert docs.get_field(1, ["items"]) == '[{"name": "a"}]'
    assert docs.get_field(1, ["cold", "x"]) == "1"
    assert docs.get_field(4, ["-1"]) == "2"
    assert ids(docs.find_ids(["state"], None)) == [2]
    assert ids(docs.find_ids(["count"], K.parse("2.5"))) == [2]
    assert ids(docs.find_ids(["items", "0", "name"], "b")) == [2]
    assert ids(docs.find_ids(["cold"], {"x": 1})) == [1]
    assert ids(docs.find_ids_compared(["count"], ">=", 2)) == [2, 3]
    assert ids(docs.find_ids_compared(["state"], "<", "z")) == [1, 2]
    plain = docs.catalog.__class__(docs.spark, docs.catalog.root, rewrite=False).relation("public.docs")
    for path, value in ((["count"], 3), (["items", "0", "name"], "a"), (["state"], None)):
        assert ids(docs.find_ids(path, value)) == ids(plain.find_ids(path, value))


def test_hot_reads_leave_the_cold_side_alone(docs):
    text = docs.explain_find_ids(["state"], "ready")
    assert "template" not in text
    assert "PushedFilters: [IsNotNull(h0_key), EqualTo(h0_key" in docs.find_ids(["state"], "ready")._jdf.queryExecution().explainString(docs.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_hot_edit_writes_no_cold_file(docs):
    cold = dict(docs.meta.cold)
    out, found = docs.set_field(1, ["count"], 7)
    assert found and out.meta.cold == cold and out.meta.hot != docs.meta.hot
    out, total = out.increment_field(1, ["count"], K.parse("0.5"))
    assert K.dump(total) == "7.5" and out.meta.cold == cold
    assert doc_of(out, 1) == '{"cold": {"x": 1}, "count": 7.5, "items": [{"name": "a"}], "state": "ready"}'


def test_cold_and_structural_edits(docs):
    out, _ = docs.set_fields(1, [{"path": ["cold"], "value": 1}, {"path": ["state"], "value": "x"}, {"path": ["cold"], "value": 2}])
    assert out.get_field(1, ["cold"]) == "2" and out.get_field(1, ["state"]) == '"x"'
    out, _ = out.delete_field(1, ["state"])
    assert out.get_field(1, ["state"]) is None
    out, _ = out.delete_field(1, ["items", "0"])
    assert out.get_field(1, ["items"]) == "[]"
    assert out.set_field(99, ["x"], 1)[1] is False
    assert out.increment_field(99, ["x"])[1] is None


def test_failed_batch_changes_nothing(docs):
    assert state(docs.set_fields, 1, [{"path": ["count"], "value": 9}, {"path": ["items", "x"], "value": 1}]) == "22P02"
    assert docs.catalog.relation("public.docs").get_field(1, ["count"]) == "1"
    assert state(docs.increment_field, 1, ["state"]) == "22023"
    assert state(docs.set_fields, 1, []) == "22023"


def test_tokens_and_races(docs):
    token = docs.row_revision(1)
    out, new = docs.set_fields_if_revision(1, token, [{"path": ["count"], "value": 5}])
    assert new != token
    assert state(out.set_fields_if_revision, 1, token, [{"path": ["count"], "value": 6}]) == "40001"
    assert state(docs.set_field, 1, ["count"], 8) == "40001"  # a version that was overtaken
    assert out.reinitialize("restore").row_revision(1) != new


def test_patches(docs):
    out, token = docs.apply_patch(1, [{"op": "test", "path": "/count", "value": 1}])
    assert out is docs and token == docs.row_revision(1)
    out, _ = docs.apply_patch(1, [{"op": "add", "path": "/new", "value": [1]}])
    assert out.get_field(1, ["new"]) == "[1]"
    same, token = out.merge_patch(1, {"new": [1]})
    assert same is out and token == out.row_revision(1)
    out, _ = out.merge_patch(1, {"new": None, "count": {"deep": 1}})
    assert out.get_field(1, ["new"]) is None and out.get_field(1, ["count"]) == '{"deep": 1}'
    assert out.apply_patch(99, [])[1] is None
    assert state(out.apply_patch, 99, [{"op": "bad"}]) == "22023"


def test_inserts_upserts_and_deletes(docs, spark):
    new = spark.createDataFrame([(5, "{}")], "id long, doc string")
    out = docs.insert(new)
    assert ids(out.hot().select("id")) == [1, 2, 3, 4, 5]
    assert state(out.insert, new) == "23505"
    assert state(out.insert, spark.createDataFrame([(6, None)], "id long, doc string")) == "23502"
    assert state(out.insert, spark.createDataFrame([(6, "{")], "id long, doc string")) == "22P02"
    out, _ = out.upsert_document(1, {"count": 10})
    row = out.df().where("id = 1").first()
    assert (row["doc"], row["tenant"]) == ('{"count": 10}', "t1")
    out, _ = out.upsert_document(7, {}, {"tenant": "t7"})
    assert state(out.upsert_document, 7, {}, {"no": 1}) == "22023"
    out = out.delete(spark.createDataFrame([(1,), (2,), (77,)], "id long"))
    assert ids(out.hot().select("id")) == [3, 4, 5, 7]
    assert out.check(True)["rows_checked"] == 4


def test_import_leaves_nothing_behind(catalog, spark):
    rows = spark.createDataFrame([(1, "{}"), (1, "[]")], "id long, doc string")
    assert state(catalog.import_table, "public.bad", rows, [["a"]]) == "23505"
    assert catalog.names() == []


def test_constraints(docs, spark):
    assert state(docs.set_not_null, "tenant") == "23502"
    out = docs.update_business(spark.createDataFrame([(3, "t3")], "id long, tenant string")).set_not_null("tenant")
    assert state(out.insert, spark.createDataFrame([(9, "{}", None)], "id long, doc string, tenant string")) == "23502"
    out = out.set_default("tenant", "it's")
    out = out.insert(spark.createDataFrame([(9, "{}")], "id long, doc string"))
    assert out.df().where("id = 9").first()["tenant"] == "it's"
    assert state(out.add_field_check, "c", ["state"], "string") == "23514"
    out = docs.catalog.relation("public.docs").add_field_check("n", ["count"], "number")
    assert state(out.set_field, 1, ["count"], "x") == "23514"
    assert state(out.add_field_check, "n", ["count"], "number") == "42710"


def test_typed_slots_and_ranges(docs):
    assert state(docs.find_ids_range, ["count"], "numeric", 1) == "55000"
    out = docs.declare_path_type(["count"], "numeric")
    assert ids(out.find_ids_range(["count"], "numeric", 1, 3)) == [1, 2]
    assert ids(out.find_ids_range(["count"], "numeric", None, 3, include_upper=True)) == [1, 2, 3]
    assert state(out.find_ids_range, ["count"], "numeric", 3, 1) == "22023"
    assert state(out.find_ids_range, ["count"], "numeric", "a") == "22023"
    assert state(out.set_field, 1, ["count"], "x") == "23514"
    assert state(out.declare_path_type, ["count"], "boolean") == "22023"
    assert state(docs.catalog.relation("public.docs").declare_path_type, ["state"], "boolean") == "23514"
    out = docs.catalog.relation("public.docs").create_path_index("i", ["state"], "text")
    assert out.index_text("i") == "INDEX i ON public.docs (h0)"
    assert ids(out.find_ids_range(["state"], "text", "a", "z")) == [1]


def test_names_and_ddl_errors(catalog, docs):
    assert state(catalog.create, "public.docs", [["a"]]) == "42P07"
    assert state(catalog.create, "docs", [["a"]]) == "22023"
    assert state(catalog.create, "public.n", []) == "22023"
    assert state(catalog.create, "public.n", [["a"]], {"id": "int"}) == "22023"
    assert state(catalog.create, "public.n", [["a"]], {"c": "int) drop"}) == "42601"
    assert state(catalog.rename, "public.docs", "other.docs") == "22023"
    moved = catalog.rename("public.docs", "public.moved")
    assert catalog.names() == ["public.moved"] and moved.df().count() == 4
    catalog.drop("public.moved")
    assert state(catalog.relation, "public.moved") == "42704"


def test_range_partitions(catalog, spark):
    spec = [{"from": None, "to": 10}, {"from": 10, "to": 20}]
    r = catalog.create("public.ranges", [["n"]], partition=spec)
    r = r.insert(spark.range(0, 20).selectExpr("id", "concat('{\"n\":', id, '}') AS doc"))
    assert len(r.hot((12, 15)).inputFiles()) == 1 and ids(r.hot((12, 15)).select("id")) == [12, 13, 14]
    assert state(r.insert, spark.createDataFrame([(25, "{}")], "id long, doc string")) == "23514"
    assert state(r.create_partition, 15, 30) == "22023"
    r = r.create_partition(20, None).insert(spark.createDataFrame([(25, "{}")], "id long, doc string"))
    r, leaf = r.detach_partition("1")
    assert r.hot().count() == 11
    assert r.attach_partition(leaf).hot().count() == 21
    assert state(catalog.create, "public.x", [["a"]], None, {"strategy": "hash", "modulus": 65}) == "22023"


def test_row_policies(docs):
    r = docs.grant("t1", "write").grant("t2", "read").enable_rls()
    assert r.catalog.as_user("t1").relation("public.docs").fields().count() == 0
    r = r.set_policy("own", "all", ["public"], using="tenant = current_user")
    mine = lambda u: r.catalog.as_user(u).relation("public.docs")
    assert ids(mine("t1").fields()) == [1, 4] and ids(mine("t2").fields()) == [2]
    assert mine("t1").set_field(2, ["count"], 1)[1] is False
    assert state(mine("t2").set_field, 2, ["count"], 1) == "42501"
    assert state(mine("t1").upsert_document, 8, {}, {"tenant": "t2"}) == "42501"
    assert state(mine("nobody").fields) == "42501"
    assert state(r.set_policy, "x", "select", ["public"], using="(SELECT true)") == "0A000"
    assert state(r.set_policy, "x", "select", ["public"], using="doc = 'a'") == "0A000"
    assert state(r.set_policy, "x", "select", ["public"], using="rand() < 1") == "0A000"
    assert state(r.set_policy, "x", "insert", ["public"], using="true") == "22023"
    assert state(r.set_policy, "x", "select", ["ghost"], using="true") == "42704"
    r = r.set_policy("few", "select", ["public"], using="""policy_field('["count"]') = '1'""", restrictive=True)
    assert ids(mine("t1").fields()) == [1]
    r = r.drop_policy("few").set_policy("kind", "select", ["public"], using="""json_type(policy_field('["count"]')) = 'number'""", restrictive=True)
    assert ids(mine("t1").fields()) == [1] and ids(mine("t2").fields()) == [2]
    assert docs.catalog.relation("public.docs").fields().count() == 4


def test_policies_on_writes(docs, spark):
    r = docs.grant("t1", "write").enable_rls()
    mine = lambda: r.catalog.as_user("t1").relation("public.docs")
    r = r.set_policy("see", "select", ["public"], using="true").set_policy("change", "update", ["public"], using="tenant = current_user", check="tenant <> 'gone'")
    assert mine().set_field(1, ["count"], 5)[1]  # no insert policy is needed for an update
    assert state(mine().update_business, spark.createDataFrame([(1, "gone")], "id long, tenant string")) == "42501"
    assert state(mine().upsert_document, 2, {}, {"tenant": "t1"}) == "42501"  # another user's row
    assert docs.catalog.relation("public.docs").df().where("id = 2").first()["tenant"] != "t1"
    assert state(mine().upsert_document, 50, {}, {"tenant": "t1"}) == "42501"  # nothing lets t1 add rows
    r.catalog.relation("public.docs").set_policy("add", "insert", ["t1"], check="tenant = current_user")
    assert state(mine().upsert_document, 50, {}, {"tenant": "t2"}) == "42501"
    assert mine().upsert_document(50, {}, {"tenant": "t1"})[0].hot().where("id = 50").count() == 1


def test_check_finds_damage(docs, spark):
    assert docs.check(True)["layout_ok"]
    rows = docs.hot().where("id = 1").select("id", F.lit(None).cast("string").alias("template"), F.array(*map(F.lit, ('"other"', "1", '"a"'))).alias("slots"), F.array(*map(F.lit, ("wrong", "wrong", "wrong"))).alias("keys"), "c_tenant")
    assert not docs.commit(rows).check(True)["layout_ok"]


def test_empty_relation_with_a_bounded_text_column(catalog):
    assert catalog.create("public.short", [["a"]], {"label": "varchar(4)"}).df().count() == 0


def test_files_and_layouts(docs, catalog, tmp_path):
    file = str(tmp_path / "out.jsonl")
    footer = P.export_file(docs, file)
    assert footer["rows"] == 4
    back = P.import_file(catalog, file, "public.back")
    assert P.differences(docs, back).count() == 0
    lines = (tmp_path / "out.jsonl").read_text().splitlines(keepends=True)
    for damaged in (lines[:-1], [lines[0], *lines[2:]], [*lines, "{}\n"], [lines[1], lines[0], *lines[2:]]):
        (tmp_path / "bad.jsonl").write_text("".join(damaged))
        with pytest.raises((DocError, ValueError)):
            P.read_file(catalog, str(tmp_path / "bad.jsonl"))
    moved = P.migrate_layout(docs, "public.moved", [["cold"]])
    assert P.differences(docs, moved).count() == 0
    typed = docs.declare_path_type(["count"], "numeric")
    assert state(P.import_manifest, catalog, P.export_manifest(typed), "public.t") == "0A000"
    assert P.import_manifest(catalog, P.export_manifest(typed, copy=["types"]), "public.t").meta.types == {"1": "numeric"}
    assert state(P.migration_plan, docs, "public.t", [["a"]], {"mode": "online", "subset": True}) == "42501"


def changes(spark, rows):
    return R.parsed(R.events_of(spark.createDataFrame(rows, "position long, kind string, id long, doc string, tenant string"), ["doc", "tenant"]))


def test_online_migration(docs, catalog, spark):
    job = R.Migration.prepare(catalog, "public.docs", "public.next", [["count"]])
    assert state(catalog.drop, "public.docs") == "55000"
    assert state(job.mark, "ready") == "55000"
    copied = job.copy()
    assert copied.df().count() == 4
    assert state(catalog.relation("public.next").set_field, 1, ["count"], 2) == "25006"
    source, _ = catalog.relation("public.docs").set_field(1, ["count"], 42)
    doc = doc_of(source, 1)
    job.catch_up(changes(spark, [(100, "update", 1, doc, "t1")]))
    assert state(job.complete) == "55000"
    source = catalog.relation("public.docs")
    source.fence()
    assert state(catalog.relation("public.docs").set_field, 1, ["count"], 1) == "25006"
    assert job.status()["cutover_ready"]
    out = job.complete()
    assert out.get_field(1, ["count"]) == "42" and job.record()["state"] == "completed"


def test_replay_is_exactly_once_and_waits_for_commits(catalog, spark, tmp_path):
    r = catalog.create("public.target", [["n"]], {"tenant": "string"})
    r.changed(follower="stream")
    source = tmp_path / "in"
    source.mkdir()
    lines = [x[0] for x in R.events_of(spark.createDataFrame([(1, "insert", 1, '{"n":1}', "a"), (2, "insert", 2, '{"n":2}', "b"), (3, "delete", 1, None, None)], "position long, kind string, id long, doc string, tenant string"), ["doc", "tenant"]).collect()]
    commit3 = [x for x in lines if '"commit"' in x and '"xid":3' in x]
    (source / "a.json").write_text("\n".join(x for x in lines if x not in commit3) + "\n")
    stream = R.Replay(catalog, "public.target", str(source), str(tmp_path / "progress"))
    out = stream.run()
    assert ids(out.hot().select("id")) == [1, 2] and out.meta.applied == 2
    version = out.meta.version
    out = R.apply_events(out, R.parsed(spark.createDataFrame([(x,) for x in lines if x not in commit3], "value string")))
    assert out.meta.version == version
    (source / "b.json").write_text(commit3[0] + "\n")
    out = stream.run()
    assert ids(out.hot().select("id")) == [2] and out.meta.applied == 3


def test_unchanged_columns_and_moved_ids(catalog, spark):
    r = catalog.create("public.target", [["n"]], {"tenant": "string"})
    r = R.apply_events(r, changes(spark, [(1, "insert", 1, '{"n":1}', "a")]))
    event = '{"v":1,"event":"update","xid":5,"old":{"id":{"text":"1"}},"new":{"id":{"text":"9"},"doc":{"unchanged":true},"tenant":{"text":"z"}},"seq":1}'
    commit = '{"v":1,"event":"commit","xid":5,"lsn":5,"end_lsn":5,"seq":2}'
    r = R.apply_events(r, R.parsed(spark.createDataFrame([(event,), (commit,)], "value string")))
    row = r.df().collect()
    assert [(x["id"], x["doc"], x["tenant"]) for x in row] == [(9, '{"n": 1}', "z")]


def test_replica_takes_over(docs, catalog, spark):
    replica = R.Replica.prepare(catalog, P.export_manifest(docs), "public.copy")
    assert state(replica.takeover, 0) == "55000"
    replica.register()
    replica.follow(changes(spark, [(7, "insert", 1, "{}", "t")]))
    assert replica.stop() == {"state": "stopped", "position": 7}
    assert state(replica.takeover, 8) == "55000"
    out = replica.takeover(7)
    assert out.set_field(1, ["state"], 1)[1]

"""Managed relations of split documents: reads that touch only what they need, and edits as versioned commits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotleaf.errors import DocError
from hotleaf.functions import columns as C
from hotleaf.functions import kernel as K
from hotleaf.operators import policy
from hotleaf.plans import resolver, rewrite
from hotleaf.sources.checkpoints import settled
from hotleaf.sources.store import Files, Meta, Store

MAX_BUSINESS = 64
TYPES = ("object", "array", "string", "number", "boolean", "null")


def raised(error: str | None) -> None:
    if error:
        state, _, detail = error.partition(" ")
        raise DocError(state, detail)


def _ops_text(ops: Iterable[dict]) -> list[str]:
    return [K.dump(op) for op in ops]


class Catalog:
    """The relations below a root folder, as seen by a user (None: their owner)."""

    def __init__(self, spark: SparkSession, root: str, user: str | None = None, rewrite: bool = True):
        self.spark, self.root, self.user, self.rewrite = spark, root, user, rewrite
        self.files = Files(spark, root)

    def store(self, name: str) -> Store:
        return Store(self.spark, self.files, name)

    def names(self) -> list[str]:
        return [n for n in self.files.names("") if self.files.names(f"{n}/meta")]

    def relation(self, name: str) -> Relation:
        return Relation(self, self.store(name), self.store(name).meta())

    def as_user(self, user: str | None) -> Catalog:
        return Catalog(self.spark, self.root, user, self.rewrite)

    def create(self, name: str, paths: Any, columns: dict[str, str] | None = None, partition: Any = None, buckets: int = 8) -> Relation:
        """``partition`` is a visible specification of up to 64 parts.  Without one, ids are hashed into ``buckets``: the unit
        that a commit rewrites, so choose some hundred megabytes of hot values each."""
        schema, _, table = name.partition(".")
        if not schema or not table or "." in table or any(len(x.encode()) > 63 for x in (schema, table)):
            raise DocError("22023", "a relation's name has a schema and a table of up to 63 bytes")
        if name in self.names():
            raise DocError("42P07", f"{name} exists")
        declared = K.validate_paths(paths, 1)
        columns = dict(sorted((columns or {}).items(), key=lambda kv: kv[0].encode()))
        if len(columns) > MAX_BUSINESS or {"", "id", "doc"} & columns.keys():
            raise DocError("22023", "up to 64 business columns, not named id or doc")
        for kind in columns.values():
            column_type(kind)
        meta = Meta(name, [list(p) for p in declared], columns, version=-1)
        if not 1 <= buckets <= 1 << 16:
            raise DocError("22023", "1 to 65536 buckets")
        meta.partition = {"strategy": "hash", "modulus": buckets} if partition is None else checked_partition(partition)
        store = self.store(name)
        return Relation(self, store, store.publish(meta))

    def import_table(self, name: str, source: DataFrame, paths: Any, id_col: str = "id", doc_col: str = "doc", partition: Any = None, buckets: int = 8) -> Relation:
        """Creates a relation from a table: other columns become business columns.  Invalid rows leave nothing behind."""
        others = [f for f in source.schema.fields if f.name not in (id_col, doc_col)]
        relation = self.create(name, paths, {f.name: f.dataType.simpleString() for f in others}, partition, buckets)
        try:
            return relation.insert(source.select(F.col(id_col).cast("long").alias("id"), F.col(doc_col).alias("doc"), *[F.col(f"`{f.name}`") for f in others]))
        except Exception:
            self.files.delete(name)
            raise

    def sql(self, text: str, args: dict[str, Any] | None = None, **relations: Relation) -> DataFrame:
        """A query over relations, with ``->``, ``->>``, ``#>`` and ``#>>`` on their documents answered from hot columns."""
        return rewrite.run(self, text, relations, args)

    def drop(self, name: str) -> None:
        relation = self.relation(name)
        relation.need_owner()
        if any(j["state"] not in ("completed", "failed", "aborted") for j in relation.meta.jobs.values()):
            raise DocError("55000", "the relation has an active job")
        self.files.delete(name)

    def rename(self, old: str, new: str) -> Relation:
        relation = self.relation(old)
        relation.need_owner()
        if new in self.names():
            raise DocError("42P07", f"{new} exists")
        if old.partition(".")[0] != new.partition(".")[0]:
            raise DocError("22023", "a relation stays in its schema")
        self.files.rename(old, new)
        moved = self.store(new)
        meta = moved.meta()
        meta.name = new
        return Relation(self, moved, moved.publish(meta))

    def check_all(self, data: bool = False) -> DataFrame:
        rows = [self.relation(n).check(data) for n in self.names()]
        return self.spark.createDataFrame(rows, "view string, storage string, layout_ok boolean, rows_checked long, invalid_indexes long")


def column_type(declaration: str) -> T.DataType:
    try:
        kind = T.StructType.fromDDL(f"c {declaration}").fields[0].dataType
    except Exception:
        raise DocError("42601", f"invalid type {declaration!r}") from None
    if isinstance(kind, T.NullType | T.MapType | T.VariantType):
        raise DocError("22023", f"a business column cannot be {declaration}")
    return kind


def checked_partition(spec: Any) -> dict:
    """{"strategy": "hash", "modulus": n} or [{"from": a, "to": b}, ...] of half-open bounds (None: open)."""
    if isinstance(spec, dict):
        n = spec.get("modulus")
        if spec.keys() != {"strategy", "modulus"} or spec["strategy"] != "hash" or not isinstance(n, int) or not 1 <= n <= 64:
            raise DocError("22023", "a hash partition has a modulus of 1 to 64")
        return dict(spec)
    if not isinstance(spec, list) or not 1 <= len(spec) <= 64:
        raise DocError("22023", "1 to 64 ranges")
    parts: dict[str, list] = {}
    for k, r in enumerate(spec):
        add_range(parts, str(k), r.get("from"), r.get("to"))
    return {"strategy": "range", "parts": parts}


def add_range(parts: dict[str, list], name: str, low: int | None, high: int | None) -> None:
    for x in (low, high):
        if x is not None and (isinstance(x, bool) or not isinstance(x, int) or not -(2**63) <= x < 2**63):
            raise DocError("22023", "a bound is a 64-bit integer or null")
    if low is not None and high is not None and low >= high:
        raise DocError("22023", "an empty range")
    for a, b in parts.values():
        if (b is None or low is None or low < b) and (a is None or high is None or a < high):
            raise DocError("22023", "ranges overlap")
    parts[name] = [low, high]


class Relation:
    """A version of a relation.  Edits return the next version."""

    def __init__(self, catalog: Catalog, store: Store, meta: Meta):
        self.catalog, self.store, self.meta, self.spark = catalog, store, meta, catalog.spark
        self.paths = tuple(tuple(p) for p in meta.paths)
        self.user = catalog.user

    # ------------------------------------------------------------ layout
    @property
    def hot_names(self) -> list[str]:
        return [f"h{k}" for k in range(len(self.paths))]

    def _typed(self) -> dict[str, tuple[int, str]]:
        """Shadow columns of declared types: name -> (slot, kind)."""
        return {f"t{slot}_{kind}": (int(slot), kind) for slot, kind in self.meta.types.items()}

    def _hot_schema(self) -> str:
        kinds = {"numeric": C.number_type(), "boolean": "boolean"}
        parts = ["id long", "row_revision long"]
        parts += [f"{h} string, {h}_key string" for h in self.hot_names]
        parts += [f"{n} {kinds[k]}" for n, (_, k) in self._typed().items()]
        parts += [f"`c_{c}` {d}" for c, d in self.meta.columns.items()]
        return ", ".join([*parts, "p int"])

    def bucket(self, id_: Column) -> Column:
        spec = self.meta.partition
        if spec["strategy"] == "hash":
            return F.pmod(F.xxhash64(id_), F.lit(spec["modulus"])).cast("int")
        out = F.lit(None).cast("int")
        for name, (low, high) in spec["parts"].items():
            inside = F.lit(True)
            if low is not None:
                inside &= id_ >= low
            if high is not None:
                inside &= id_ < high
            out = F.when(inside, F.lit(int(name))).otherwise(out)
        return out

    def hot(self, ids: tuple[int | None, int | None] | None = None, only: set[int] | None = None) -> DataFrame:
        """Hot values and business columns; with a range of ids [low, high), or buckets, of these files only."""
        buckets = resolver.pruned(self.meta, self.meta.hot, ids, only)
        rows = self.store.read("hot", buckets, self._hot_schema())
        for bound, keep in ((ids or (None, None))[0], F.col("id").__ge__), ((ids or (None, None))[1], F.col("id").__lt__):
            if bound is not None:
                rows = rows.where(keep(bound))
        return rows

    def cold(self, ids: tuple[int | None, int | None] | None = None, only: set[int] | None = None) -> DataFrame:
        return self.store.read("cold", resolver.pruned(self.meta, self.meta.cold, ids, only), "id long, template string, p int")

    def buckets_of(self, rows: DataFrame, id_: str = "id") -> set[int]:
        """The buckets of some rows' ids (a number bounded by the layout)."""
        return set(rows.agg(F.collect_set(self.bucket(F.col(id_)))).first()[0])

    # ------------------------------------------------------------ reads
    def need_owner(self) -> None:
        if self.user is not None:
            raise DocError("42501", "only the owner may do this")

    def need(self, mode: str) -> None:
        if self.user is not None and {"read": 1, "write": 2}[mode] > {"read": 1, "write": 2}.get(self.meta.access.get(self.user, ""), 0):
            raise DocError("42501", f"{self.user} may not {mode} {self.meta.name}")

    def visible(self, command: str = "select", rows: DataFrame | None = None) -> DataFrame:
        rows = self.hot() if rows is None else rows
        if not self._restricted():
            return rows
        return rows.where(policy.condition(self, command, "using"))

    def df(self, ids: tuple[int | None, int | None] | None = None, only: set[int] | None = None) -> DataFrame:
        """id, doc and business columns, of all rows or of a range of ids or of some buckets."""
        self.need("read")
        rows = self.visible(rows=self.hot(ids, only))
        whole = rows.join(self.cold(ids, only), ["id", "p"])
        doc = C.restore(F.col("template"), F.array(*self.hot_names), self.paths)
        return whole.select("id", doc.alias("doc"), *self._business())

    def _business(self) -> list[Column]:
        out = []
        for c in self.meta.columns:
            col = F.col(f"`c_{c}`")
            if c in self.meta.collations:
                col = F.collate(col, self.meta.collations[c])
            out.append(col.alias(c))
        return out

    def fields(self, *ids: str, **wanted: list[str]) -> DataFrame:
        """id, business columns named in ``ids``, and JSON text of the paths in ``wanted``.

        Hot paths come from their columns; the cold side is joined only if some path needs it.
        """
        self.need("read")
        plans = {name: resolver.plan(self.paths, K.check_path(path)) if self.catalog.rewrite else resolver.Plan(path=path) for name, path in wanted.items()}
        rows = self.visible()
        if any(p.cold for p in plans.values()):
            rows = rows.join(self.cold(), ["id", "p"])
        named = [F.col(f"`c_{c}`").alias(c) for c in ids]
        return rows.select("id", *named, *[resolver.column(p, self.paths, self.hot_names).alias(n) for n, p in plans.items()])

    def create_view(self, name: str) -> None:
        self.df().createOrReplaceTempView(name)

    def get_field(self, id_: int, path: list[str]) -> str | None:
        row = self._one(self.fields(value=path), id_)
        return row["value"] if row else None

    @staticmethod
    def _one(rows: DataFrame, id_: int):
        return rows.where(F.col("id") == id_).first()

    def find_ids(self, path: list[str], value: Any) -> DataFrame:
        """Ids of documents that hold a JSON value (or its text, if str was parsed by the caller) at a path."""
        self.need("read")
        key = F.lit(K.key_of(value))
        plan = resolver.plan(self.paths, K.check_path(path)) if self.catalog.rewrite else resolver.Plan(path=path)
        rows = self.visible()
        if plan.slots and not plan.rest:
            hit = F.lit(False)
            for k in plan.slots:
                hit |= F.coalesce(F.col(f"h{k}_key") == key, F.lit(False))
            if not plan.cold:
                first = plan.slots[0]
                return rows.where(F.col(f"h{first}_key") == key if len(plan.slots) == 1 else hit).select("id")
            absent = F.coalesce(*[F.col(f"h{k}") for k in plan.slots]).isNull()
            known = rows.where(hit).select("id")
            rest = rows.where(absent).join(self.cold(), ["id", "p"])
            return known.union(rest.where(C.key_of(C.extract(C.restore(F.col("template"), F.array(*self.hot_names), self.paths), path)) == key).select("id"))
        if plan.cold:
            rows = rows.join(self.cold(), ["id", "p"])
        return rows.where(C.key_of(resolver.column(plan, self.paths, self.hot_names)) == key).select("id")

    def find_ids_compared(self, path: list[str], op: str, value: Any) -> DataFrame:
        """Ids of documents whose value at a path is <, <=, > or >= a JSON value, in the order of documents."""
        if op not in ("<", "<=", ">", ">="):
            raise DocError("22023", f"unknown comparison {op}")
        return self.fields(value=path).where(C.compared(F.col("value"), op, value)).select("id")

    def explain_find_ids(self, path: list[str], value: Any) -> str:
        return self.find_ids(path, value)._jdf.queryExecution().toString()

    def find_ids_range(self, path: list[str], kind: str, lower: Any = None, upper: Any = None, include_lower: bool = True, include_upper: bool = False, collation: str | None = None) -> DataFrame:
        self.need("read")
        if kind not in ("numeric", "boolean", "text"):
            raise DocError("22023", "a range is numeric, boolean or text")
        found = K.candidates(self.paths, K.check_path(path))
        if len(found) != 1:
            raise DocError("22023", "the path must name one slot")
        wanted = {"numeric": "number", "boolean": "boolean", "text": "string"}[kind]
        for bound in (lower, upper):
            if bound is not None and K.typeof(bound) != wanted:
                raise DocError("22023", f"a bound must be a {wanted}")
        if kind != "text" and lower is not None and upper is not None and lower > upper:
            raise DocError("22023", "the lower bound is above the upper")
        if kind == "text":
            col = C.as_text(F.col(f"h{found[0]}"))
            col = F.collate(col, collation) if collation else col
        else:
            if self.meta.types.get(str(found[0])) != kind:
                raise DocError("55000", f"the slot has no declared type {kind}")
            col = F.col(f"t{found[0]}_{kind}")
        bounds = [x if x is None or kind != "numeric" else F.lit(Decimal(x)).cast(C.number_type()) for x in (lower, upper)]
        rows = self.visible().where(col.isNotNull())
        if bounds[0] is not None:
            rows = rows.where(col >= bounds[0] if include_lower else col > bounds[0])
        if bounds[1] is not None:
            rows = rows.where(col <= bounds[1] if include_upper else col < bounds[1])
        return rows.select("id")

    # ------------------------------------------------------------ commits
    def need_writable(self, follower: bool = False) -> None:
        self.need("write")
        if self.meta.fenced or self.meta.follower and not follower:
            raise DocError("25006", f"{self.meta.name} is read-only")

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """Hot rows (id, row_revision, p, slots and keys arrays, c_ columns) in the stored layout."""
        slots = [F.get("slots", k).alias(h) for k, h in enumerate(self.hot_names)]
        keys = [F.get("keys", k).alias(f"{h}_key") for k, h in enumerate(self.hot_names)]
        typed = [(C.as_number if kind == "numeric" else C.as_boolean)(F.get("slots", slot)).alias(n) for n, (slot, kind) in self._typed().items()]
        return rows.select("id", "row_revision", "p", *slots, *keys, *typed, *[F.col(f"`c_{c}`") for c in self.meta.columns])

    def _slots(self) -> list[Column]:
        """The slots and keys arrays of stored hot rows."""
        return [F.array(*self.hot_names).alias("slots"), F.array(*[f"{h}_key" for h in self.hot_names]).alias("keys")]

    def _checked(self, rows: DataFrame, *more: Column):
        """One pass over changed rows for every constraint; raises the first that fails.  Returns the aggregates in ``more``."""
        found: list[tuple[str, str, Column]] = [("23502", "an id is null", F.col("id").isNull()), ("23514", "no range holds the id", F.col("p").isNull())]
        for c in self.meta.not_null:
            found.append(("23502", f"{c} is null", F.col(f"`c_{c}`").isNull()))
        for c, kind in self.meta.columns.items():
            if kind.startswith("varchar("):
                found.append(("22001", f"{c} is too long", F.length(f"`c_{c}`") > int(kind[8:-1])))
        for name, check in self.meta.checks.items():
            value = F.get("slots", check["slot"])
            bad = C.typeof(value) != check["type"]
            found.append(("23514", f"check {name} failed", F.coalesce(bad, F.lit(bool(check["required"])))))
        for slot, kind in self.meta.types.items():
            value = F.get("slots", int(slot))
            found.append(("23514", f"slot {slot} is not {kind}", F.coalesce(~C.typeof(value).isin("null", {"numeric": "number"}.get(kind, kind)), F.lit(False))))
        out = rows.agg(*[F.max(cond.cast("int")).alias(f"e{k}") for k, (_, _, cond) in enumerate(found)], *more).first()
        for k, (state, message, _) in enumerate(found):
            if out[k]:
                raise DocError(state, message)
        return out[len(found) :]

    def _restricted(self) -> bool:
        return self.meta.rls["enabled"] and (self.user is not None or self.meta.rls["force"])

    def _policed(self, rows: DataFrame, command: str) -> None:
        """Raises if a changed row breaks the policies for what a command may write."""
        if self._restricted():
            shown = rows.select("*", *[F.get("slots", k).alias(h) for k, h in enumerate(self.hot_names)])
            if shown.where(~F.coalesce(policy.condition(self, command, "check"), F.lit(False))).limit(1).count():
                raise DocError("42501", "a row breaks a policy")

    def commit(self, changed: DataFrame, gone: DataFrame | None = None, follower: bool = False, applied: int | None = None, stable: bool = False, command: str | None = None) -> Relation:
        """Publishes changed rows (id, template, slots, keys, c_ columns; template null where the cold side stays) and the
        removal of the ids in ``gone``.  Only the buckets that hold them are written.  ``stable``: ``changed`` reads what is
        settled already and gives the same rows each time.  ``command``: whose policies the rows must pass."""
        self.need_writable(follower)
        changed = changed.withColumn("p", self.bucket(F.col("id"))).withColumn("row_revision", F.monotonically_increasing_id() + self.meta.next_revision)
        changed = changed if stable else settled(changed)
        whole = F.col("template").isNotNull()
        top, touched, cold_touched = self._checked(changed, F.max("row_revision"), F.collect_set("p"), F.collect_set(F.when(whole, F.col("p"))))
        if command:
            self._policed(changed, command)
        meta = Meta.of(self.meta.text())
        cold_rows = changed.where(whole).select("id", "template", "p")
        removed, cold_removed = changed.select("id"), cold_rows.select("id")
        if gone is not None:
            gone = settled(gone.select("id").distinct().withColumn("p", self.bucket(F.col("id"))))
            left = gone.agg(F.collect_set("p")).first()[0]
            touched, cold_touched = sorted({*touched, *left}), sorted({*cold_touched, *left})
            removed, cold_removed = removed.union(gone.select("id")), cold_removed.union(gone.select("id"))
        version = meta.version + 1
        for side, buckets, rows, out in (("hot", touched, self._shaped(changed), removed), ("cold", cold_touched, cold_rows, cold_removed)):
            current = getattr(meta, side)
            old = {p: current[p] for p in map(str, buckets) if p in current}
            if old:
                kept = self.store.read(side, old, self._hot_schema() if side == "hot" else "id long, template string, p int").join(out, "id", "left_anti")
                rows = kept.unionByName(rows)
            if buckets:
                self.store.write(side, rows, version)
            for p in map(str, buckets):
                current.pop(p, None)
                if f"v={version}" in self.store.files.names(f"{meta.name}/{side}/p={p}"):
                    current[p] = version
        meta.next_revision = max(meta.next_revision, (top or 0) + 1)
        if applied is not None:
            meta.applied = applied
        return Relation(self.catalog, self.store, self.store.publish(meta))

    def _with_business(self, rows: DataFrame) -> list[Column]:
        out = []
        for c, kind in self.meta.columns.items():
            if c in rows.columns:
                out.append(F.col(f"`{c}`").cast(kind).alias(f"c_{c}"))
            else:
                default = self.meta.defaults.get(c)
                out.append((F.lit(None) if default is None else F.expr(default)).cast(kind).alias(f"c_{c}"))
        return out

    def _packed(self, rows: DataFrame) -> DataFrame:
        """Rows (id, doc, business columns) split; errors are raised."""
        unknown = set(rows.columns) - {"id", "doc", *self.meta.columns}
        if unknown:
            raise DocError("22023", f"unknown columns {sorted(unknown)}")
        rows = rows.select(F.col("id").cast("long").alias("id"), "doc", *self._with_business(rows))
        packed = settled(rows.withColumn("s", C.pack(F.col("doc"), self.paths)))
        bad = packed.agg(F.max(F.col("id").isNull() | F.col("doc").isNull()), F.max("s.error"), F.count("id") - F.countDistinct("id")).first()
        if bad[0]:
            raise DocError("23502", "id and doc must not be null")
        raised(bad[1])
        if bad[2]:
            raise DocError("23505", "an id occurs twice")
        return packed.select("id", "s.template", "s.slots", "s.keys", *[f"`c_{c}`" for c in self.meta.columns])

    def insert(self, rows: DataFrame, follower: bool = False) -> Relation:
        self.need_writable(follower)
        packed = self._packed(rows)
        if self.meta.hot and self.hot().select("id").join(packed, "id", "left_semi").limit(1).count():
            raise DocError("23505", "an id exists")
        return self.commit(packed, follower=follower, stable=True, command="insert")

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None, follower: bool = False, applied: int | None = None) -> Relation:
        """Inserts or replaces documents; of existing rows only the supplied business columns change."""
        packed = self._packed(rows)
        old = self.hot().select("id", *[F.col(f"`c_{c}`").alias(f"o_{c}") for c in self.meta.columns], F.lit(True).alias("there"))
        joined = packed.join(old, "id", "left")
        kept = [F.when(F.col("there") & F.lit(c not in rows.columns), F.col(f"`o_{c}`")).otherwise(F.col(f"`c_{c}`")).alias(f"c_{c}") for c in self.meta.columns]
        new = joined.select("id", "template", "slots", "keys", *kept, F.coalesce("there", F.lit(False)).alias("there"))
        if self._restricted():
            new = settled(new)
            there = new.where("there")
            if there.join(self.visible("update").select("id"), "id", "left_anti").limit(1).count():
                raise DocError("42501", "a row exists that the user may not change")
            self._policed(there, "update")
            self._policed(new.where("NOT there"), "insert")
        return self.commit(new.drop("there"), gone, follower=follower, applied=applied)

    def update_business(self, rows: DataFrame) -> Relation:
        """Sets the business columns in ``rows`` (id and columns) of existing rows; the cold side stays."""
        given = [c for c in rows.columns if c != "id"]
        if not set(given) <= self.meta.columns.keys():
            raise DocError("22023", "unknown business column")
        new = rows.select("id", *[F.col(f"`{c}`").cast(self.meta.columns[c]).alias(f"n_{c}") for c in given])
        joined = self.visible("update").join(new, "id")
        values = [F.col(f"`{'n' if c in given else 'c'}_{c}`").alias(f"c_{c}") for c in self.meta.columns]
        return self.commit(joined.select("id", F.lit(None).cast("string").alias("template"), *self._slots(), *values), command="update")

    def delete(self, ids: DataFrame) -> Relation:
        seen = self.visible("delete").select("id").join(ids.select("id").distinct(), "id", "left_semi")
        none = self.hot().limit(0)
        return self.commit(none.select("id", F.lit(None).cast("string").alias("template"), *self._slots(), *[f"`c_{c}`" for c in self.meta.columns]), seen)

    # ------------------------------------------------------------ operations
    def applied_ops(self, ops: DataFrame) -> DataFrame:
        """Ordered operations (id, seq, op as JSON text) on their rows: id, template (null if only hot values changed), slots,
        results, error and business columns.  Rows whose operations all stay within hot values never see the cold side."""
        lists = ops.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "op")))["op"].alias("ops"))
        touched = self.buckets_of(ops)
        rows = self.visible("update", self.hot(only=touched)).join(lists, "id")
        first = settled(rows.select("*", C.edited_hot(F.array(*self.hot_names), F.col("ops"), self.paths).alias("e")))
        business = [f"`c_{c}`" for c in self.meta.columns]
        fast = first.where("e.done OR e.error IS NOT NULL").select("id", F.lit(None).cast("string").alias("template"), "e.slots", "e.keys", "e.results", "e.error", *business)
        slow = first.where("NOT e.done AND e.error IS NULL").join(self.cold(only=touched), ["id", "p"])
        doc = C.restore(F.col("template"), F.array(*self.hot_names), self.paths)
        slow = slow.select("id", C.edited(doc, F.col("ops"), self.paths).alias("e"), *business)
        return fast.unionByName(slow.select("id", "e.template", "e.slots", "e.keys", "e.results", "e.error", *business))

    def apply_ops(self, ops: DataFrame) -> tuple[Relation, DataFrame]:
        """All operations in one commit, or none.  Returns the next version and (id, results)."""
        self.need_writable()
        done = settled(self.applied_ops(ops))
        raised(done.agg(F.max("error")).first()[0])
        out = self.commit(done.drop("results", "error"), stable=True, command="update")
        return out, done.select("id", "results")

    def _row(self, id_: int, ops: list[dict]) -> tuple[Relation, list | None]:
        if id_ is None or any(v is K.MISSING for op in ops for v in op.values()):
            raise DocError("22023", "arguments must not be null")
        frame = self.spark.createDataFrame([(id_, k, t) for k, t in enumerate(_ops_text(ops))], "id long, seq int, op string")
        if not self.visible("update").where(F.col("id") == id_).limit(1).count():
            self.need_writable()
            return self, None
        out, results = self.apply_ops(frame)
        return out, [K.parse(x) for x in results.first()["results"]]

    def set_field(self, id_: int, path: list[str], value: Any, create_missing: bool = True) -> tuple[Relation, bool]:
        return self.set_fields(id_, [{"path": path, "value": value}], create_missing)

    def set_fields(self, id_: int, updates: list[dict], create_missing: bool = True) -> tuple[Relation, bool]:
        if not isinstance(updates, list) or not 1 <= len(updates) <= K.MAX_OPS or any(not isinstance(u, dict) or u.keys() != {"path", "value"} for u in updates):
            raise DocError("22023", "1 to 64 updates of exactly path and value")
        for u in updates:
            K.check_path(u["path"])
        out, results = self._row(id_, [{"op": "set", "create_missing": create_missing, **u} for u in updates])
        return out, results is not None

    def delete_field(self, id_: int, path: list[str]) -> tuple[Relation, bool]:
        out, results = self._row(id_, [{"op": "delete", "path": K.check_path(path)}])
        return out, results is not None

    def increment_field(self, id_: int, path: list[str], delta: Any = 1) -> tuple[Relation, Any]:
        out, results = self._row(id_, [{"op": "increment", "path": K.check_path(path), "delta": K.finite(delta)}])
        return out, results[0] if results else None

    def token(self, revision: int, id_: int) -> str:
        return f"{self.meta.epoch}:{id_}:{revision}"

    def tokens(self) -> DataFrame:
        return self.visible().select("id", F.concat_ws(":", F.lit(self.meta.epoch), "id", "row_revision").alias("token"))

    def row_revision(self, id_: int) -> str | None:
        row = self._one(self.tokens(), id_)
        return row["token"] if row else None

    def need_token(self, id_: int, token: str | None) -> None:
        if token is not None and self.row_revision(id_) != token:
            raise DocError("40001", "the row has changed")

    def set_fields_if_revision(self, id_: int, token: str, updates: list[dict], create_missing: bool = True) -> tuple[Relation, str | None]:
        self.need_token(id_, token)
        out, _ = self.set_fields(id_, updates, create_missing)
        return out, out.row_revision(id_)

    def apply_patch(self, id_: int, patch: list, expected: str | None = None) -> tuple[Relation, str | None]:
        kinds = {op for op, *_ in K.check_patch(patch)}
        return self._patched(id_, {"op": "patch", "patch": patch}, expected, kinds <= {"test"})

    def merge_patch(self, id_: int, patch: Any, expected: str | None = None) -> tuple[Relation, str | None]:
        return self._patched(id_, {"op": "merge", "patch": patch}, expected, False)

    def _patched(self, id_: int, op: dict, expected: str | None, only_reads: bool) -> tuple[Relation, str | None]:
        self.need_writable()
        row = self._one(self.df(only=self.buckets_of(self.spark.range(id_, id_ + 1))), id_)
        if row is None:
            return self, None
        self.need_token(id_, expected)
        before = K.parse(row["doc"])
        after, _ = K.apply_op(before, op)
        if only_reads or K.key_of(after) == K.key_of(before):
            return self, self.row_revision(id_)
        out, _ = self._row(id_, [op])
        return out, out.row_revision(id_)

    def upsert_document(self, id_: int, doc: Any, business: dict[str, Any] | None = None) -> tuple[Relation, str]:
        business = business or {}
        if not business.keys() <= self.meta.columns.keys():
            raise DocError("22023", "unknown business column")
        schema = ", ".join(["id long", "doc string", *[f"`{c}` {self.meta.columns[c]}" for c in business]])
        out = self.upsert(self.spark.createDataFrame([(id_, K.dump(doc), *business.values())], schema))
        return out, out.row_revision(id_)

    # ------------------------------------------------------------ management
    def changed(self, **values: Any) -> Relation:
        self.need_owner()
        meta = Meta.of(self.meta.text())
        for k, v in values.items():
            setattr(meta, k, v)
        return Relation(self.catalog, self.store, self.store.publish(meta))

    def _known(self, column: str) -> None:
        if column not in self.meta.columns:
            raise DocError("22023", f"no business column {column}")

    def set_not_null(self, column: str, on: bool = True) -> Relation:
        self._known(column)
        if on and self.hot().where(F.col(f"`c_{column}`").isNull()).limit(1).count():
            raise DocError("23502", f"{column} has nulls")
        return self.changed(not_null=sorted({*self.meta.not_null, column} - (set() if on else {column})))

    def set_default(self, column: str, value: Any) -> Relation:
        """A constant for inserts that leave the column out; None drops it."""
        self._known(column)
        rest = {k: v for k, v in self.meta.defaults.items() if k != column}
        return self.changed(defaults=rest if value is None else rest | {column: "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)})

    def set_collation(self, column: str, collation: str) -> Relation:
        self._known(column)
        return self.changed(collations=self.meta.collations | {column: {"C": "UTF8_BINARY"}.get(collation, collation)})

    def _slot(self, path: Any) -> int:
        (declared,) = K.validate_paths([path])
        if declared not in self.paths:
            raise DocError("22023", "the path is not declared")
        return self.paths.index(declared)

    def add_field_check(self, name: str, path: Any, kind: str, required: bool = False) -> Relation:
        if kind not in TYPES:
            raise DocError("22023", f"unknown type {kind}")
        if name in self.meta.checks:
            raise DocError("42710", f"check {name} exists")
        out = self.changed(checks=self.meta.checks | {name: {"slot": self._slot(path), "type": kind, "required": required}})
        return out._verified(self)

    def _verified(self, before: Relation) -> Relation:
        """Checks present rows against new constraints; undoes the change if one fails."""
        rows = self.store.read("hot", self.meta.hot, before._hot_schema()).withColumn("slots", F.array(*self.hot_names))
        try:
            self._checked(rows)
        except DocError:
            undo = Meta.of(before.meta.text())
            undo.version = self.meta.version
            self.store.publish(undo)
            raise
        return self

    def declare_path_type(self, path: Any, kind: str) -> Relation:
        """Pins a slot to numbers or booleans and gives it a typed column that ranges push down to."""
        if kind not in ("numeric", "boolean"):
            raise DocError("22023", "a slot's type is numeric or boolean")
        slot = str(self._slot(path))
        now = self.meta.types.get(slot)
        if now == kind:
            return self
        if now:
            raise DocError("22023", f"the slot is declared {now}")
        out = self.changed(types=self.meta.types | {slot: kind})._verified(self)
        business = [f"`c_{c}`" for c in self.meta.columns]
        rows = self.hot().select("id", F.lit(None).cast("string").alias("template"), *self._slots(), *business)
        return out.commit(rows) if self.meta.hot else out

    def create_path_index(self, name: str, path: Any, kind: str = "jsonb", collation: str | None = None) -> Relation:
        """Registers what a search uses: key columns serve jsonb, typed columns numeric and boolean, text the value itself."""
        if name in self.meta.indexes:
            raise DocError("42P07", f"index {name} exists")
        if kind not in ("jsonb", "text", "numeric", "boolean") or collation and kind != "text":
            raise DocError("22023", "unknown kind of index")
        if isinstance(path, list) and all(isinstance(s, str) for s in path) and tuple(path) not in self.paths:
            found = K.candidates(self.paths, path)
            if len(found) != 1:
                raise DocError("22023", "the path must name one slot")
            slot = found[0]
        else:
            slot = self._slot(path)
        out = self.declare_path_type(self.paths[slot], kind) if kind in ("numeric", "boolean") else self
        return out.changed(indexes=out.meta.indexes | {name: {"slot": slot, "kind": kind, "collation": collation}})

    def index_text(self, name: str) -> str:
        i = self.meta.indexes[name]
        column = {"jsonb": f"h{i['slot']}_key", "text": f"h{i['slot']}"}.get(i["kind"], f"t{i['slot']}_{i['kind']}")
        return f"INDEX {name} ON {self.meta.name} ({column}{' COLLATE ' + i['collation'] if i['collation'] else ''})"

    def check(self, data: bool = False) -> dict:
        """Compares the layout with the files; with ``data`` restores every document and splits it again: slots, keys and
        typed columns must be what is stored."""
        bad = sum(not 0 <= i["slot"] < len(self.paths) for i in self.meta.indexes.values())
        if self.meta.hot.keys() != self.meta.cold.keys():
            raise DocError("55000", "hot and cold buckets differ")
        rows, sound = None, True
        if data:
            whole = self.hot().join(self.cold().withColumn("there", F.lit(True)), ["id", "p"], "full")
            whole = whole.withColumn("doc", C.restore(F.col("template"), F.array(*self.hot_names), self.paths))
            again = C.pack(F.col("doc"), self.paths)
            stored = F.struct(F.col("template").alias("template"), F.array(*self.hot_names).alias("slots"), F.array(*[f"{h}_key" for h in self.hot_names]).alias("keys"))
            typed = [F.col(n).eqNullSafe((C.as_number if kind == "numeric" else C.as_boolean)(F.col(f"h{slot}"))) for n, (slot, kind) in self._typed().items()]
            same = whole.select("doc", again.alias("a"), stored.alias("s"), *[t.alias(f"t{k}") for k, t in enumerate(typed)])
            fits = F.col("a.error").isNull() & F.col("doc").isNotNull()
            for part in ("template", "slots", "keys"):
                fits &= F.col(f"a.{part}").eqNullSafe(F.col(f"s.{part}"))
            for k in range(len(typed)):
                fits &= F.col(f"t{k}")
            rows, sound = same.agg(F.count("doc"), F.coalesce(F.min(F.coalesce(fits, F.lit(False))), F.lit(True))).first()
        return {"view": self.meta.name, "storage": f"{self.store.files.root}/{self.meta.name}", "layout_ok": sound, "rows_checked": rows, "invalid_indexes": bad}

    def storage(self) -> str:
        self.need_owner()
        return f"{self.store.files.root}/{self.meta.name}"

    def stats(self) -> dict:
        sizes = {s: self.store.files.size(f"{self.meta.name}/{s}") for s in ("hot", "cold")}
        return {"rows": self.hot().count(), "hot_bytes": sizes["hot"], "cold_bytes": sizes["cold"], "total_bytes": sum(sizes.values()), "buckets": len(self.meta.hot)}

    def reinitialize(self, reason: str) -> Relation:
        if reason not in ("restore", "recovery", "import", "takeover"):
            raise DocError("22023", f"unknown reason {reason}")
        top = self.hot().agg(F.max("row_revision")).first()[0] or 0
        return self.changed(epoch=str(uuid.uuid4()), generation=self.meta.generation + 1, next_revision=max(self.meta.next_revision, top + 1))

    def grant(self, user: str, mode: str) -> Relation:
        if mode not in ("read", "write"):
            raise DocError("22023", "access is read or write")
        return self.changed(access=self.meta.access | {user: mode})

    def fence(self, on: bool = True) -> tuple[Relation, int]:
        out = self.changed(fenced=on)
        return out, out.meta.version

    # ------------------------------------------------------------ ranges
    def create_partition(self, low: int | None, high: int | None) -> Relation:
        parts = self._ranges()
        name = str(max([-1, *map(int, parts)]) + 1)
        add_range(parts, name, low, high)
        return self.changed(partition={"strategy": "range", "parts": parts})

    def _ranges(self) -> dict[str, list]:
        if self.meta.partition["strategy"] != "range":
            raise DocError("22023", "only range partitions can be added or removed")
        return {k: list(v) for k, v in self.meta.partition["parts"].items()}

    def detach_partition(self, name: str) -> tuple[Relation, dict]:
        """The rows leave the relation; their files stay, named by what is returned."""
        parts = self._ranges()
        if name not in parts:
            raise DocError("42704", f"no partition {name}")
        leaf = {"name": name, "bounds": parts.pop(name), "hot": self.meta.hot.get(name), "cold": self.meta.cold.get(name), "layout": json.dumps({k: v for k, v in self.meta.layout().items() if k != "partition"}, sort_keys=True)}
        rest = [{k: v for k, v in side.items() if k != name} for side in (self.meta.hot, self.meta.cold)]
        return self.changed(partition={"strategy": "range", "parts": parts}, hot=rest[0], cold=rest[1]), leaf

    def attach_partition(self, leaf: dict) -> Relation:
        if leaf["layout"] != json.dumps({k: v for k, v in self.meta.layout().items() if k != "partition"}, sort_keys=True):
            raise DocError("55000", "the partition has another layout")
        parts = self._ranges()
        add_range(parts, leaf["name"], *leaf["bounds"])
        sides = [side | ({leaf["name"]: leaf[s]} if leaf[s] is not None else {}) for s, side in (("hot", self.meta.hot), ("cold", self.meta.cold))]
        return self.changed(partition={"strategy": "range", "parts": parts}, hot=sides[0], cold=sides[1])

    # ------------------------------------------------------------ row policies
    def enable_rls(self, on: bool = True, force: bool = False) -> Relation:
        return self.changed(rls={"enabled": on, "force": force})

    def set_policy(self, name: str, command: str, roles: list[str], using: str | None = None, check: str | None = None, restrictive: bool = False) -> Relation:
        return self.changed(policies=self.meta.policies | {name: policy.checked(self, command, roles, using, check, restrictive)})

    def drop_policy(self, name: str) -> Relation:
        if name not in self.meta.policies:
            raise DocError("42704", f"no policy {name}")
        return self.changed(policies={k: v for k, v in self.meta.policies.items() if k != name})

"""Replay of change events into a relation, exactly once.

Events are JSON lines: begin and commit of a transaction (xid), and between them inserts, updates and deletes with the
old and new columns, each null, {"unchanged": true} or {"text": ..., "type": ...}.  A batch applies all transactions that
have committed by then, in the order of their end positions, as one commit of the relation that also records the last
position; what was applied before is skipped, so a batch that is replayed after a crash changes nothing.
Changes of transactions still open wait in a table beside the relation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotleaf.errors import DocError
from hotleaf.operators.relation import Catalog, Relation
from hotleaf.sources.checkpoints import settled

STATE = "struct<unchanged:boolean,text:string,type:string>"
EVENT = f"v int, event string, xid long, source long, relation long, old map<string,{STATE}>, new map<string,{STATE}>, lsn long, end_lsn long, seq long"


def parsed(lines: DataFrame) -> DataFrame:
    """Events of text lines."""
    return lines.select(F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def _text(side: str, column: str):
    return F.col(side)[column]


def folded(events: DataFrame, columns: list[str]) -> DataFrame:
    """One row per id: whether it is gone, whether it began anew, and per column its last text, if that is known."""
    change = events.where("event IN ('insert', 'update', 'delete')")
    new_id, old_id = _text("new", "id")["text"].cast("long"), _text("old", "id")["text"].cast("long")
    moved = (F.col("event") == "update") & old_id.isNotNull() & (new_id != old_id)
    stays = change.where(F.col("event") != "delete").select(new_id.alias("id"), "at", F.lit(False).alias("gone"), ((F.col("event") == "insert") | moved).alias("fresh"), F.when(moved, old_id).alias("origin"), *[_text("new", c).alias(c) for c in columns])
    ends = change.where((F.col("event") == "delete") | moved).select(old_id.alias("id"), "at", F.lit(True).alias("gone"), F.lit(False).alias("fresh"), F.lit(None).cast("long").alias("origin"), *[F.lit(None).cast(STATE).alias(c) for c in columns])
    rows = stays.unionByName(ends)
    # what came before an id's last insert no longer counts
    since = F.max(F.when(F.col("fresh") | F.col("gone"), F.col("at"))).over(Window.partitionBy("id"))
    rows = rows.withColumn("since", since).where("since IS NULL OR at >= since")
    known = [F.max_by(F.struct(F.col(c)["text"].alias("text")), F.when(~F.coalesce(F.col(c)["unchanged"], F.lit(False)), F.col("at"))).alias(c) for c in columns]
    return rows.groupBy("id").agg(F.max_by("gone", "at").alias("gone"), F.max("fresh").alias("fresh"), F.max("origin").alias("origin"), *known)


def apply_events(relation: Relation, events: DataFrame) -> Relation:
    """Applies committed transactions that aren't applied yet."""
    bad = events.agg(F.max(F.col("v") != 1), F.max(~F.col("event").isin("begin", "commit", "insert", "update", "delete"))).first()
    if bad[0] or bad[1]:
        raise DocError("0A000", "unknown protocol or event")
    commits = events.where("event = 'commit'").select("xid", F.col("end_lsn").alias("position")).where(F.col("position") > relation.meta.applied)
    top = commits.agg(F.max("position")).first()[0]
    if top is None:
        return relation
    own = events.drop("end_lsn").join(commits, "xid").withColumn("at", F.struct("position", "seq"))
    columns = ["doc", *relation.meta.columns]
    last = settled(folded(own, columns))
    gone = last.where("gone").select("id")
    stay = last.where("NOT gone")
    unknown = F.lit(False)
    for c in columns:
        unknown |= F.col(c).isNull()
    # only events that leave columns unchanged look at the relation, and only at the buckets of their ids
    need = stay.where(unknown).select(F.coalesce("origin", "id").alias("origin_id"))
    touched = relation.buckets_of(need, "origin_id")
    before = relation.df(only=touched).join(need.distinct(), F.col("id") == F.col("origin_id"), "left_semi")
    before = before.select(F.col("id").alias("origin_id"), *[F.col(f"`{c}`").cast("string").alias(f"was_{c}") for c in columns])
    stay = stay.join(before, F.coalesce("origin", "id") == F.col("origin_id"), "left")
    if touched and stay.where(unknown & F.col("origin_id").isNull()).limit(1).count():
        raise DocError("55000", "an event leaves a column unchanged that is not known")
    values = [F.when(F.col(c).isNotNull(), F.col(c)["text"]).otherwise(F.col(f"was_{c}")).alias(c) for c in columns]
    typed = [F.col(c).cast(relation.meta.columns[c]).alias(c) if c != "doc" else F.col("doc") for c in columns]
    return relation.upsert(stay.select("id", *values).select("id", *typed), gone, follower=True, applied=top)


class Replay:
    """A streaming query from a folder of event files into a relation."""

    def __init__(self, catalog: Catalog, name: str, source: str, checkpoint: str):
        self.catalog, self.name, self.source, self.checkpoint = catalog, name, source, checkpoint
        self.waiting = f"{catalog.root}/{name}/waiting"

    def _batch(self, lines: DataFrame, batch: int) -> None:
        relation = self.catalog.relation(self.name)
        pending = self.catalog.files.names(f"{self.name}/waiting")
        current = f"{batch:020d}"
        older = [p for p in pending if p < current]
        if older:
            lines = lines.union(self.catalog.spark.read.text(f"{self.waiting}/{older[-1]}"))
        lines = settled(lines)
        events = parsed(lines)
        apply_events(relation, events)
        xid = F.get_json_object("value", "$.xid").cast("long").alias("xid")
        done = events.where("event = 'commit'").select(F.col("xid").alias("done")).distinct()
        left = lines.select("value", xid).join(done, F.col("xid") == F.col("done"), "left_anti").select("value")
        left.write.mode("overwrite").text(f"{self.waiting}/{current}")

    def start(self):
        stream = self.catalog.spark.readStream.schema("value string").text(self.source)
        return stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def run(self) -> Relation:
        self.start().awaitTermination()
        return self.catalog.relation(self.name)


def events_of(rows: DataFrame, columns: list[str], base: int = 0) -> DataFrame:
    """Text lines of one transaction per row (id, kind, doc, columns ..., ordered by ``position``): for tests and copies."""

    def state(c: str):
        return F.struct(F.lit(False).alias("unchanged"), F.col(c).cast("string").alias("text"), F.lit("text").alias("type"))

    new = F.create_map(*[x for c in ("id", *columns) for x in (F.lit(c), state(c))])
    old = F.create_map(F.lit("id"), state("id"))
    xid = F.col("position") + base
    change = rows.select(F.struct(F.lit(1).alias("v"), F.col("kind").alias("event"), xid.alias("xid"), F.when(F.col("kind") != "insert", old).alias("old"), F.when(F.col("kind") != "delete", new).alias("new"), F.lit(1).alias("seq")).alias("e"))
    commit = rows.select(F.struct(F.lit(1).alias("v"), F.lit("commit").alias("event"), xid.alias("xid"), xid.alias("lsn"), xid.alias("end_lsn"), F.lit(2).alias("seq")).alias("e"))
    return change.select(F.to_json("e").alias("value")).union(commit.select(F.to_json("e").alias("value")))


# ---------------------------------------------------------------- jobs
STEPS = {
    "prepare": {"copying", "failed", "aborted"},
    "copying": {"catching_up", "failed", "aborted"},
    "catching_up": {"ready", "failed", "aborted"},
    "ready": {"completed", "catching_up", "failed", "aborted"},
}


class Migration:
    """An online change of layout: copy, replay what changed meanwhile, fence, compare, switch."""

    def __init__(self, catalog: Catalog, source: str, job: str):
        self.catalog, self.source, self.job = catalog, source, job

    @classmethod
    def prepare(cls, catalog: Catalog, source: str, target: str, paths, options: dict | None = None) -> Migration:
        from hotleaf.sources import portability as P

        relation = catalog.relation(source)
        relation.need_owner()
        P.migration_plan(relation, target, paths, (options or {}) | {"mode": "online"})
        job = uuid.uuid4().hex[:12]
        manifest = P.export_manifest(relation, copy=(options or {}).get("copy"))
        made = P.import_manifest(catalog, manifest | {"paths": [list(p) for p in paths]}, target, {"ignore_manual": True})
        made.changed(follower=job)
        relation.changed(jobs=relation.meta.jobs | {job: {"state": "prepare", "target": target, "position": -1, "layout": str(relation.meta.layout())}})
        return cls(catalog, source, job)

    def record(self) -> dict:
        return self.catalog.relation(self.source).meta.jobs[self.job]

    def mark(self, state: str, position: int | None = None) -> dict:
        relation = self.catalog.relation(self.source)
        record = dict(relation.meta.jobs[self.job])
        if state != record["state"] and state not in STEPS.get(record["state"], set()):
            raise DocError("55000", f"{record['state']} cannot become {state}")
        if state not in ("failed", "aborted") and record["layout"] != str(relation.meta.layout()):
            raise DocError("55000", "the source's layout has changed")
        if position is not None:
            if position < record["position"]:
                raise DocError("55000", "the position goes back")
            record["position"] = position
        record["state"] = state
        relation.changed(jobs=relation.meta.jobs | {self.job: record})
        return record

    def copy(self) -> Relation:
        self.mark("copying")
        source, target = self.catalog.relation(self.source), self.catalog.relation(self.record()["target"])
        out = target.insert(source.df(), follower=True)
        self.mark("catching_up", source.meta.version)
        return out

    def catch_up(self, events: DataFrame) -> Relation:
        out = apply_events(self.catalog.relation(self.record()["target"]), events)
        self.mark("ready", max(self.record()["position"], out.meta.applied))
        return out

    def status(self) -> dict:
        record, source = self.record(), self.catalog.relation(self.source)
        return record | {"source_fenced": source.meta.fenced, "cutover_ready": record["state"] == "ready" and source.meta.fenced, "layout_valid": record["layout"] == str(source.meta.layout())}

    def abort(self) -> dict:
        return self.mark("aborted")

    def complete(self) -> Relation:
        from hotleaf.sources import portability as P

        source, target = self.catalog.relation(self.source), self.catalog.relation(self.record()["target"])
        if self.record()["state"] != "ready" or not source.meta.fenced:
            raise DocError("55000", "the job must be ready and the source fenced")
        if P.differences(source, target).limit(1).count():
            raise DocError("55000", "source and target differ")
        out = target.changed(follower=None).reinitialize("takeover")
        self.mark("completed")
        return out


class Replica:
    """A read-only relation of the same layout that follows another, until it takes over."""

    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name = catalog, name

    @classmethod
    def prepare(cls, catalog: Catalog, manifest: dict, target: str) -> Replica:
        from hotleaf.sources import portability as P

        made = P.import_manifest(catalog, manifest, target, {"ignore_manual": True})
        if made.meta.paths != manifest["paths"] or made.meta.columns != manifest["columns"]:
            raise DocError("55000", "the layouts differ")
        made.changed(follower="prepared")
        return cls(catalog, target)

    def _state(self, *allowed: str) -> Relation:
        relation = self.catalog.relation(self.name)
        if relation.meta.follower not in allowed:
            raise DocError("55000", f"the replica is {relation.meta.follower or 'promoted'}")
        return relation

    def register(self) -> dict:
        self._state("prepared", "stopped").changed(follower="running")
        return self.status()

    def follow(self, events: DataFrame) -> Relation:
        return apply_events(self._state("running"), events)

    def stop(self) -> dict:
        self._state("running").changed(follower="stopped")
        return self.status()

    def status(self) -> dict:
        meta = self.catalog.relation(self.name).meta
        return {"state": meta.follower or "promoted", "position": meta.applied}

    def takeover(self, final: int) -> Relation:
        relation = self._state("stopped")
        if relation.meta.applied < final:
            raise DocError("55000", "the replica has not applied the final position")
        return relation.changed(follower=None).reinitialize("takeover")

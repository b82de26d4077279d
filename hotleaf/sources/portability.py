"""Manifests, row exports, JSON-lines files with a digest, and copies into another layout."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.errors import DocError
from hotleaf.functions import kernel as K
from hotleaf.operators.relation import Catalog, Relation

FORMAT = 2
COPIED = ("not_null", "defaults", "collations", "checks", "types", "indexes", "rls", "access")
#: Rows of an export that come to the driver in one value.
_LINES = 256
OPTIONS = {"mode", "subset", "copy", "ignore_manual", "role_map", "partition"}


def schema_plan(relation: Relation, copy: list[str]) -> list[dict]:
    """What of a relation's constraints a copy takes over by itself, and what is left to do by hand."""
    unknown = set(copy) - set(COPIED)
    if unknown:
        raise DocError("22023", f"cannot copy {sorted(unknown)}")
    meta = relation.meta
    return [{"kind": k, "action": "apply" if k in copy else "manual", "value": getattr(meta, k)} for k in COPIED if getattr(meta, k) and (k != "rls" or meta.rls["enabled"])]


def export_manifest(relation: Relation, subset: bool = False, copy: list[str] | None = None) -> dict:
    meta = relation.meta
    return {
        "format": FORMAT, "name": meta.name, "epoch": meta.epoch, "generation": meta.generation, "mode": meta.partition["strategy"], "partition": meta.partition, "paths": meta.paths,
        "columns": meta.columns, "cold_format": 2, "subset": subset, "schema_plan": schema_plan(relation, copy or []), "policies": meta.policies, "credentials": None,
    }


def export_rows(relation: Relation, subset: bool = False) -> DataFrame:
    """(id, row): {"id": text, "doc": ..., "business": {column: text or null}} in order of id."""
    if relation.user is not None and relation.meta.rls["enabled"] and not subset:
        raise DocError("42501", "a full export needs the owner's rights")
    rows = relation.df()
    business = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in relation.meta.columns]), {"ignoreNullFields": "false"}) if relation.meta.columns else F.lit("{}")
    row = F.concat(F.lit('{"business": '), business, F.lit(', "doc": '), "doc", F.lit(', "id": "'), F.col("id").cast("string"), F.lit('"}'))
    return rows.select("id", row.alias("row")).orderBy("id")


def _line(value: Any) -> bytes:
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str) + "\n").encode()


def _row_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of export_rows as lines of a file, many in one value, so that the driver only joins and digests them."""
    for batch in batches:
        rows = batch.column(0).to_pylist()
        for at in range(0, len(rows), _LINES):
            part = rows[at : at + _LINES]
            body = b"".join(b'{"row":' + K.dump(K.parse(row)).encode() + b"}\n" for row in part)
            yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([body], pa.binary())], ["n", "body"])


def export_file(relation: Relation, file: str, subset: bool = False, copy: list[str] | None = None) -> dict:
    """Writes manifest, rows and a footer with their number and SHA-256.  The file must not exist; a failure leaves none.

    The format is one file with one digest over its lines in order, so its bytes pass through the driver, a partition at a time.
    """
    files, digest, n = relation.store.files, hashlib.sha256(), 0
    stream = files.fs.create(files.jvm.org.apache.hadoop.fs.Path(file), False)
    try:
        head = _line({"manifest": export_manifest(relation, subset, copy)})
        digest.update(head)
        stream.write(bytearray(head))
        for lines in export_rows(relation, subset).select("row").mapInArrow(_row_lines, "n long, body binary").toLocalIterator():
            digest.update(lines["body"])
            stream.write(lines["body"])
            n += lines["n"]
        footer = {"rows": n, "sha256": digest.hexdigest()}
        stream.write(bytearray(_line({"footer": footer})))
        stream.close()
    except BaseException:
        stream.close()
        files.fs.delete(files.jvm.org.apache.hadoop.fs.Path(file), False)
        raise
    return footer


def import_manifest(catalog: Catalog, manifest: dict, target: str, options: dict | None = None) -> Relation:
    options = options or {}
    if set(options) - OPTIONS:
        raise DocError("22023", f"unknown options {sorted(set(options) - OPTIONS)}")
    if manifest.get("format") != FORMAT:
        raise DocError("0A000", "unknown manifest format")
    manual = [x["kind"] for x in manifest["schema_plan"] if x["action"] != "apply"]
    if manual and not options.get("ignore_manual"):
        raise DocError("0A000", f"left to do by hand: {manual}")
    partition = options.get("partition", manifest["partition"])
    out = catalog.create(target, options.get("paths", manifest["paths"]), manifest["columns"])
    roles = options.get("role_map", {})
    values = {x["kind"]: x["value"] for x in manifest["schema_plan"] if x["action"] == "apply"}
    if "access" in values:
        values["access"] = {roles.get(k, k): v for k, v in values["access"].items()}
    if "rls" in values:
        values["policies"] = {n: p | {"roles": [roles.get(r, r) for r in p["roles"]]} for n, p in manifest["policies"].items()}
    return out.changed(partition=partition, **values)


def import_rows(relation: Relation, rows: DataFrame) -> Relation:
    """Rows in the form of export_rows, all in one commit."""
    business = ", ".join(f"`{c}` string" for c in relation.meta.columns) or "none string"
    head = F.from_json("row", f"id string, business struct<{business}>")
    parsed = rows.select(head.alias("r"), "row")
    from hotleaf.functions import columns as C

    doc = C.extract(F.col("row"), ["doc"])
    return relation.insert(parsed.select(F.col("r.id").cast("long").alias("id"), doc.alias("doc"), *[F.col(f"r.business.`{c}`").cast(kind).alias(c) for c, kind in relation.meta.columns.items()]))


def read_file(catalog: Catalog, file: str) -> tuple[dict, DataFrame]:
    """Manifest and rows of a file, after its order, number and digest were checked."""
    stream = catalog.files.fs.open(catalog.files.jvm.org.apache.hadoop.fs.Path(file))
    reader = catalog.files.jvm.java.io.BufferedReader(catalog.files.jvm.java.io.InputStreamReader(stream, "UTF-8"))
    digest, n, manifest, footer = hashlib.sha256(), 0, None, None
    try:
        while (line := reader.readLine()) is not None:
            if footer is not None:
                raise DocError("22023", "something follows the footer")
            (kind,) = json.loads(line).keys()
            if kind == "footer":
                footer = json.loads(line)["footer"]
                continue
            if (kind == "manifest") != (manifest is None):
                raise DocError("22023", "lines out of order")
            if kind == "manifest":
                manifest = json.loads(line)["manifest"]
            elif kind == "row":
                n += 1
            else:
                raise DocError("22023", f"unknown line {kind}")
            digest.update(line.encode() + b"\n")
    finally:
        reader.close()
    if footer != {"rows": n, "sha256": digest.hexdigest()} or manifest is None:
        raise DocError("22023", "the file is incomplete or damaged")
    lines = catalog.spark.read.text(file).where(F.col("value").startswith('{"row":'))
    return manifest, lines.select(F.expr("substring(value, 8, length(value) - 8)").alias("row"))


def import_file(catalog: Catalog, file: str, target: str, options: dict | None = None) -> Relation:
    manifest, rows = read_file(catalog, file)
    out = import_manifest(catalog, manifest, target, options)
    try:
        out = import_rows(out, rows)
        out.check(data=True)
    except Exception:
        catalog.files.delete(target)
        raise
    return out


def migration_plan(relation: Relation, target: str, paths: Any, options: dict | None = None) -> dict:
    options = options or {}
    if set(options) - OPTIONS:
        raise DocError("22023", f"unknown options {sorted(set(options) - OPTIONS)}")
    mode = options.get("mode", "snapshot")
    if mode not in ("snapshot", "online"):
        raise DocError("22023", "the mode is snapshot or online")
    if mode == "online" and options.get("subset"):
        raise DocError("42501", "an online migration copies everything")
    return {"source": relation.meta.name, "target": target, "mode": mode, "paths": [list(p) for p in K.validate_paths(paths, 1)], "items": schema_plan(relation, options.get("copy", []))}


def migrate_layout(relation: Relation, target: str, paths: Any, options: dict | None = None) -> Relation:
    """A copy with other hot paths: one job that restores and splits anew.  The source is left as it is."""
    options = options or {}
    plan = migration_plan(relation, target, paths, options)
    manifest = export_manifest(relation, bool(options.get("subset")), options.get("copy"))
    out = import_manifest(relation.catalog, manifest | {"paths": plan["paths"]}, target, {k: v for k, v in options.items() if k != "mode"} | {"ignore_manual": True})
    return out.insert(relation.df())


def differences(a: Relation, b: Relation) -> DataFrame:
    """Rows (as canonical text) of one relation that the other lacks, both ways."""
    rows = [r.df().select(F.to_json(F.struct("id", "doc", *[f"`{c}`" for c in a.meta.columns])).alias("row")) for r in (a, b)]
    return rows[0].exceptAll(rows[1]).select(F.lit("left").alias("side"), "row").union(rows[1].exceptAll(rows[0]).select(F.lit("right").alias("side"), "row"))

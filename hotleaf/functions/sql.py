"""The document functions under SQL names: ``register(spark)`` makes them usable in spark.sql.

Documents and values are JSON text, paths arrays of strings, declared paths JSON text.  SQL NULL in any argument gives
SQL NULL; an error ends the query.
"""

from __future__ import annotations

import json
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hotleaf.errors import DocError
from hotleaf.functions import kernel as K


@cache
def _paths(text: str) -> tuple:
    return K.validate_paths(text)


def _text(value) -> str | None:
    return None if value is K.MISSING else K.dump(value)


def _pack(doc, paths):
    template, values = K.pack(K.parse(doc), _paths(paths))
    return {"cold": K.cold_text(template, _paths(paths)), "slots": [_text(v) for v in values]}


def _restore(cold, slots):
    _, paths, template = K.cold_in(cold)
    return K.dump(K.restore(template, [K.MISSING if s is None else K.parse(s) for s in slots], paths))


def _restore_as(cold, slots, paths):
    if K.cold_in(cold)[1] != _paths(paths):
        raise DocError("XX001", "the envelope has other paths")
    return _restore(cold, slots)


def _checked(path):
    K.check_path(path)
    return True


def walk(value, steps: list):
    """Typed steps: a string is a key, a number a place (0 and -1 of a scalar are the scalar), a list a path of either."""
    for step in steps:
        if value is K.MISSING:
            return value
        if isinstance(step, list):
            value = K.extract(value, step)
        elif isinstance(step, str):
            value = value.get(step, K.MISSING) if isinstance(value, dict) else K.MISSING
        elif isinstance(value, list):
            value = value[step] if -len(value) <= step < len(value) else K.MISSING
        elif isinstance(value, dict) or step not in (0, -1):
            value = K.MISSING
    return value


@cache
def _steps(text: str) -> list:
    return json.loads(text)


SPLIT = pa.struct([("cold", pa.string()), ("slots", pa.list_(pa.string()))])
#: name -> (function of Python values, SQL type, Arrow type)
FUNCTIONS = {
    "doc_canonical": (lambda doc: K.dump(K.parse(doc)), "string", pa.string()),
    "doc_key": (lambda doc: K.key_of(K.parse(doc)), "string", pa.string()),
    "doc_typeof": (lambda doc: K.typeof(K.parse(doc)), "string", pa.string()),
    "doc_text": (lambda doc: K.text_of(K.parse(doc)), "string", pa.string()),
    "doc_field": (lambda doc, path: _text(K.extract(K.parse(doc), path)), "string", pa.string()),
    "doc_steps": (lambda doc, steps: _text(walk(K.parse(doc), _steps(steps))), "string", pa.string()),
    "doc_object_field": (lambda doc, path: _text(K.object_field(K.parse(doc), path)), "string", pa.string()),
    "doc_set": (lambda doc, path, value, create: K.dump(K.set_value(K.parse(doc), K.check_path(path), K.parse(value), create)), "string", pa.string()),
    "doc_delete": (lambda doc, path: K.dump(K.delete_value(K.parse(doc), K.check_path(path))), "string", pa.string()),
    "doc_increment": (lambda doc, path, delta: K.dump(K.increment(K.parse(doc), K.check_path(path), delta)[0]), "string", pa.string()),
    "doc_patch": (lambda doc, patch: K.dump(K.json_patch(K.parse(doc), K.parse(patch))), "string", pa.string()),
    "doc_merge": (lambda doc, patch: K.dump(K.merge_patch(K.parse(doc), K.parse(patch))), "string", pa.string()),
    "doc_pack": (_pack, "struct<cold:string,slots:array<string>>", SPLIT),
    "doc_slots": (lambda doc, paths: [_text(v) for v in K.slots(K.parse(doc), _paths(paths))], "array<string>", pa.list_(pa.string())),
    "doc_restore": (_restore, "string", pa.string()),
    "doc_restore_as": (_restore_as, "string", pa.string()),
    "doc_template": (lambda cold: K.dump(K.cold_in(cold)[2]), "string", pa.string()),
    "doc_paths": (lambda cold: K.dump([list(p) for p in K.cold_in(cold)[1]]), "string", pa.string()),
    "doc_valid_paths": (lambda paths: bool(_paths(paths)) or True, "boolean", pa.bool_()),
    "doc_valid_path": (_checked, "boolean", pa.bool_()),
    "doc_candidates": (lambda paths, path: K.candidates(_paths(paths), path), "array<int>", pa.list_(pa.int32())),
    "doc_route": (lambda paths, path, slots: K.route(_paths(paths), path, [K.MISSING if s is None else K.parse(s) for s in slots]), "int", pa.int32()),
}


def _arrow(fn, arrow):
    def rows(*columns):
        return pa.array([None if any(x is None for x in row) else fn(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], arrow)

    arity = fn.__code__.co_argcount
    return {1: lambda a: rows(a), 2: lambda a, b: rows(a, b), 3: lambda a, b, c: rows(a, b, c), 4: lambda a, b, c, d: rows(a, b, c, d)}[arity]


def steps(doc: Column, text: str) -> Column:
    """JSON text at typed steps, which are JSON text themselves."""
    fn, kind, arrow = FUNCTIONS["doc_steps"]
    return F.arrow_udf(_arrow(fn, arrow), returnType=kind)(doc, F.lit(text))


def register(spark: SparkSession) -> None:
    for name, (fn, kind, arrow) in FUNCTIONS.items():
        spark.udf.register(name, F.arrow_udf(_arrow(fn, arrow), returnType=kind))

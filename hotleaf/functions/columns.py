"""The document algebra as column functions, batch by batch through Arrow.

SQL NULL in gives SQL NULL out.  Functions that can fail per row return the error as text ("sqlstate message"), so a
job over many rows ends with one error and publishes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from hotleaf.errors import DocError
from hotleaf.functions import kernel as K

SPLIT = "struct<template:string,slots:array<string>,keys:array<string>,error:string>"
EDIT = "struct<done:boolean,template:string,slots:array<string>,keys:array<string>,results:array<string>,error:string>"


def _text(value: Any) -> str | None:
    return None if value is K.MISSING else K.dump(value)


@lru_cache(4096)
def _op(text: str) -> dict:
    """An operation; many rows share its text, and nothing changes a parsed value in place."""
    return K.parse(text)


def _key(value: Any) -> str | None:
    return None if value is K.MISSING else K.key_of(value)


def _value(text: str | None) -> Any:
    return K.MISSING if text is None else K.parse(text)


def _mapped(fn: Callable, kind: str):
    """fn over rows of Python values, as an Arrow function; fn isn't called where its first argument is null."""
    arrow = _arrow_type(kind)

    def run(*columns):
        lists = [c.to_pylist() for c in columns]
        return pa.array([None if row[0] is None else fn(*row) for row in zip(*lists, strict=True)], arrow)

    if len(_names(fn)) == 1:
        return F.arrow_udf(lambda a: run(a), returnType=kind)
    if len(_names(fn)) == 2:
        return F.arrow_udf(lambda a, b: run(a, b), returnType=kind)
    return F.arrow_udf(lambda a, b, c: run(a, b, c), returnType=kind)


def _names(fn: Callable) -> tuple[str, ...]:
    return fn.__code__.co_varnames[: fn.__code__.co_argcount]


PAIRS = "array<struct<key:string,value:string>>"


def _arrow_type(kind: str) -> pa.DataType:
    return {
        "string": pa.string(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
        "array<string>": pa.list_(pa.string()),
        PAIRS: pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])),
        SPLIT: pa.struct([("template", pa.string()), ("slots", pa.list_(pa.string())), ("keys", pa.list_(pa.string())), ("error", pa.string())]),
        EDIT: pa.struct([("done", pa.bool_()), ("template", pa.string()), ("slots", pa.list_(pa.string())), ("keys", pa.list_(pa.string())), ("results", pa.list_(pa.string())), ("error", pa.string())]),
    }[kind]


def pack(doc: Column, paths: tuple) -> Column:
    """struct(template, slots, keys, error) of document text."""

    def one(text):
        try:
            template, values = K.pack(K.parse(text), paths)
        except DocError as e:
            return {"error": f"{e.sqlstate} {e.detail}"}
        return {"template": K.dump(template), "slots": [_text(v) for v in values], "keys": [_key(v) for v in values]}

    return _mapped(one, SPLIT)(doc)


def restore(template: Column, slots: Column, paths: tuple) -> Column:
    def one(text, values):
        return K.dump(K.restore(K.parse(text), [_value(v) for v in values], paths))

    return _mapped(one, "string")(template, slots)


def extract(doc: Column, path: list[str]) -> Column:
    """JSON text of ``doc #> path``; null if missing."""
    return _mapped(lambda text: _text(K.extract(K.parse(text), path)), "string")(doc)


def object_field(doc: Column, path: list[str]) -> Column:
    K.check_path(path)
    return _mapped(lambda text: _text(K.object_field(K.parse(text), path)), "string")(doc)


def canonical(doc: Column) -> Column:
    return _mapped(lambda text: K.dump(K.parse(text)), "string")(doc)


def key_of(doc: Column) -> Column:
    """Text that is equal for equal documents."""
    return _mapped(lambda text: K.key_of(K.parse(text)), "string")(doc)


def merge_patch(doc: Column, patch: Column) -> Column:
    return _mapped(lambda text, patch: K.dump(K.merge_patch(K.parse(text), K.parse(patch))), "string")(doc, patch)


def object_keys(doc: Column) -> Column:
    return _mapped(lambda text: [k for k, _ in sorted(v.items(), key=K._key_order)] if isinstance(v := K.parse(text), dict) else None, "array<string>")(doc)


def elements(doc: Column) -> Column:
    """The JSON texts of an array's elements; null for other documents."""
    return _mapped(lambda text: [K.dump(x) for x in v] if isinstance(v := K.parse(text), list) else None, "array<string>")(doc)


def each(doc: Column) -> Column:
    """(key, value) of an object's fields; null for other documents."""
    return _mapped(lambda text: [{"key": k, "value": K.dump(x)} for k, x in sorted(v.items(), key=K._key_order)] if isinstance(v := K.parse(text), dict) else None, PAIRS)(doc)


def edited(doc: Column, ops: Column, paths: tuple) -> Column:
    """EDIT of whole documents: ordered operations (JSON texts), then split again."""

    def one(text, ops):
        try:
            doc, results = K.parse(text), []
            for op in ops:
                doc, result = K.apply_op(doc, _op(op))
                results.append(K.dump(result))
            template, values = K.pack(doc, paths)
        except DocError as e:
            return {"done": False, "error": f"{e.sqlstate} {e.detail}"}
        return {"done": True, "template": K.dump(template), "slots": [_text(v) for v in values], "keys": [_key(v) for v in values], "results": results}

    return _mapped(one, EDIT)(doc, ops)


def edited_hot(slots: Column, ops: Column, paths: tuple) -> Column:
    """EDIT of hot values alone; not done where an operation needs the whole document."""

    def one(texts, ops):
        try:
            values, results = [_value(t) for t in texts], []
            for op in ops:
                step = K.apply_hot(paths, values, _op(op))
                if step is None:
                    return {"done": False}
                values, result = step
                results.append(K.dump(result))
        except DocError as e:
            return {"done": False, "error": f"{e.sqlstate} {e.detail}"}
        return {"done": True, "slots": [_text(v) for v in values], "keys": [_key(v) for v in values], "results": results}

    return _mapped(one, EDIT)(slots, ops)


def compared(value: Column, op: str, to: Any) -> Column:
    """Order of documents (object > array > boolean > number > string > null) against a constant."""
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    bound = K.sort_key(to)
    return _mapped(lambda text: test(K.sort_key(K.parse(text)), bound), "boolean")(value)


# ---------------------------------------------------------------- on the JVM
def as_text(value: Column) -> Column:
    """``->>`` of JSON text: strings without quotes, null for JSON null.  No Python."""
    return F.when(value == "null", F.lit(None)).when(value.startswith('"'), F.get_json_object(value, "$")).otherwise(value)


def typeof(value: Column) -> Column:
    first = F.substring(value, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(value.isNotNull(), "number")


@cache
def number_type(digits: int = 38, scale: int = 10) -> str:
    return f"decimal({digits},{scale})"


def as_number(value: Column) -> Column:
    return F.when(typeof(value) == "number", value).try_cast(number_type())


def as_boolean(value: Column) -> Column:
    return F.when(value == "true", True).when(value == "false", False)


def array_length(value: Column) -> Column:
    """Number of elements; null for what isn't an array."""
    return F.when(typeof(value) == "array", F.json_array_length(value))


def build_array(*values: Column) -> Column:
    """The JSON text of an array of JSON texts; SQL null becomes JSON null."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.coalesce(v, F.lit("null")) for v in values]), F.lit("]"))


def build_object(**values: Column) -> Column:
    """The JSON text of an object of JSON texts; SQL null becomes JSON null."""
    fields = [F.concat(F.lit(K.dump(k) + ": "), F.coalesce(v, F.lit("null"))) for k, v in values.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def quoted(value: Column) -> Column:
    """The JSON text of a string; null stays null."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1))

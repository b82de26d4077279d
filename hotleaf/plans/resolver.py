"""Which columns answer a path: the rewriting of extractions into hot columns, and of id ranges into buckets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotleaf.functions import columns as C
from hotleaf.functions import kernel as K
from hotleaf.sources.store import Meta


@dataclass
class Plan:
    """slots that can hold the path (in order), what is left of it below them, and whether the cold side is needed."""

    path: list[str]
    slots: list[int] = field(default_factory=list)
    rest: list[str] = field(default_factory=list)
    cold: bool = True
    whole: bool = True


def plan(paths: tuple, path: list[str]) -> Plan:
    """An exact or deeper path of one declared path made of keys comes from its column alone.

    A number in the path may mean a key or a place, so where a declared place matches, or several declared paths, the
    column is tried first and the document decides where it is missing.  A path above a declared one needs the
    restored document; any other one is in the template.
    """
    found = [k for k, p in enumerate(paths) if len(p) <= len(path) and all(map(K.segment_matches, p, path))]
    numeric = any(K._index(s) is not None for s in path)
    if found:
        depth = len(paths[found[0]])
        same = all(len(paths[k]) == depth for k in found)
        sure = len(found) == 1 and not any(K._index(s) is not None for s in path[:depth])
        if same:
            return Plan(path, found, path[depth:], cold=not sure, whole=True)
        return Plan(path)
    above = any(len(p) > len(path) and all(map(K.segment_matches, p[: len(path)], path)) for p in paths)
    return Plan(path, whole=above or numeric)


def column(plan: Plan, paths: tuple, hot: list[str]) -> Column:
    """JSON text at the path, over hot columns and (if the plan says so) ``template``."""
    if plan.cold:
        doc = C.restore(F.col("template"), F.array(*hot), paths) if plan.whole else F.col("template")
        slow = C.extract(doc, plan.path)
        if not plan.slots or plan.rest:
            return slow
        return F.coalesce(*[F.col(hot[k]) for k in plan.slots], slow)
    value = F.col(hot[plan.slots[0]])
    return C.extract(value, plan.rest) if plan.rest else value


def pruned(meta: Meta, buckets: dict[str, int], ids: tuple[int | None, int | None] | None, only: set[int] | None = None) -> dict[str, int]:
    """The buckets that can hold ids in [low, high), of those in ``only`` if given."""
    if only is not None:
        buckets = {p: v for p, v in buckets.items() if int(p) in only}
    if not ids or meta.partition["strategy"] != "range":
        return buckets
    low, high = ids
    out = {}
    for p, v in buckets.items():
        a, b = meta.partition["parts"][p]
        if (b is None or low is None or low < b) and (a is None or high is None or a < high):
            out[p] = v
    return out

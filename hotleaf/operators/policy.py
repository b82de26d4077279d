"""Row policies: a small boolean language over id, business columns and hot values, compiled to a filter."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotleaf.errors import DocError
from hotleaf.functions import kernel as K

if TYPE_CHECKING:
    from hotleaf.operators.relation import Relation

COMMANDS = ("select", "insert", "update", "delete", "all")
#: What an expression may be made of, by the names of the parser's nodes and of functions.
NODES = {
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "IsNull", "IsNotNull",
    "Literal", "UnresolvedAttribute", "UnresolvedFunction", "Cast", "CaseWhen", "Coalesce", "Add", "Subtract", "Multiply", "UnaryMinus",
}
FUNCTIONS = {"json_type", "lower", "upper", "length", "abs", "coalesce", "nullif", "array", "current_user", "policy_field", "policy_text"}
_TYPE = re.compile(r"json_type\(\s*policy_field\(\s*'((?:[^'])*)'\s*\)\s*\)")
_FIELD = re.compile(r"policy_(field|text)\(\s*'((?:[^'])*)'\s*\)")


def _walk(node):
    yield node
    children = node.children()
    for k in range(children.size()):
        yield from _walk(children.apply(k))


def checked_expression(relation: Relation, text: str) -> str:
    try:
        tree = relation.spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception:
        raise DocError("42601", f"invalid expression {text!r}") from None
    allowed = {"id", "current_user", *relation.meta.columns}
    for node in _walk(tree):
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise DocError("0A000", f"a policy cannot use {kind}")
        if kind == "UnresolvedAttribute" and node.name().strip("`") not in allowed:
            raise DocError("0A000", f"a policy cannot use {node.name()}")
        if kind == "UnresolvedFunction":
            parts = node.nameParts()
            if parts.size() != 1 or parts.apply(0).lower() not in FUNCTIONS:
                raise DocError("0A000", "a policy cannot use this function")
    for _, path in _FIELD.findall(text):
        relation._slot(K.parse(path))
    if len(_FIELD.findall(text)) != len(re.findall(r"policy_(?:field|text)\b", text)):
        raise DocError("0A000", "policy_field takes one constant path")
    return text


def checked(relation: Relation, command: str, roles: list[str], using: str | None, check: str | None, restrictive: bool) -> dict:
    if command not in COMMANDS or not roles:
        raise DocError("22023", "unknown command or no roles")
    if command == "insert" and using is not None or command in ("select", "delete") and check is not None:
        raise DocError("22023", f"{command} has no such condition")
    unknown = [r for r in roles if r != "public" and r not in relation.meta.access]
    if unknown:
        raise DocError("42704", f"unknown roles {unknown}")
    for text in (using, check):
        if text is not None:
            checked_expression(relation, text)
    return {"command": command, "roles": list(roles), "using": using, "check": check, "restrictive": restrictive}


def compiled(relation: Relation, text: str) -> Column:
    """Over hot rows: business columns as c_<name>, hot values as h<k>."""

    def field(m: re.Match) -> str:
        h = f"h{relation._slot(K.parse(m[2]))}"
        return h if m[1] == "field" else f"(CASE WHEN {h} = 'null' THEN NULL WHEN {h} LIKE '\"%' THEN get_json_object({h}, '$') ELSE {h} END)"

    def kind(m: re.Match) -> str:
        first = f"left(h{relation._slot(K.parse(m[1]))}, 1)"
        return f"(CASE {first} WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' ELSE if({first} IS NULL, NULL, 'number') END)"

    text = _FIELD.sub(field, _TYPE.sub(kind, text))
    user = "'" + (relation.user or "").replace("'", "''") + "'"
    text = re.sub(r"\bcurrent_user(\(\))?", user, text)
    for c in sorted(relation.meta.columns, key=len, reverse=True):
        text = re.sub(rf"(?<![\w'`])`?{re.escape(c)}`?(?![\w'])", f"`c_{c}`", text)
    return F.expr(text)


def condition(relation: Relation, command: str, side: str) -> Column:
    """Permissive policies joined by OR, restrictive ones by AND; nothing passes without a permissive one."""
    own = [p for p in relation.meta.policies.values() if p["command"] in (command, "all") and ("public" in p["roles"] or relation.user in p["roles"])]
    either, every = F.lit(False), F.lit(True)
    for p in own:
        text = p["check"] if side == "check" and p["check"] is not None else p["using"]
        rule = F.coalesce(compiled(relation, text), F.lit(False)) if text is not None else F.lit(True)
        if p["restrictive"]:
            every &= rule
        else:
            either |= rule
    return either & every


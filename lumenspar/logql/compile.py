"""A log query as one two-valued filter column.

Labels and the message are compared in the JVM. Only a query that looks into attributes reads `attr_flat`, an array of
(path, text, num, is_string, is_object) per log made by one Arrow function from the raw JSON, which keeps numbers as they were
written; with_attributes() adds it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspar.logql.syntax import All, And, Attr, Label, Node, Not, Or, Text, parse
from lumenspar.model import glob

FLAT = "array<struct<path:string,text:string,num:double,is_string:boolean,is_object:boolean>>"


class _Num(str):
    """A JSON number as its digits."""


def flatten(attrs: str | None) -> list[tuple[str, str, float | None, bool, bool]]:
    """Every node of a JSON object under its dotted path; arrays add no path. Whole-key spellings come as they are, since
    a key that holds dots joins to the same path."""
    if not attrs:
        return []
    try:
        o = json.loads(attrs, parse_int=_Num, parse_float=_Num, parse_constant=_Num)
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str, float | None, bool, bool]] = []

    def walk(path: str, v: object) -> None:
        if isinstance(v, dict):
            if path:
                out.append((path, _dump(v), None, False, True))
            for k, x in v.items():
                walk(f"{path}.{k}" if path else k, x)
        elif isinstance(v, list):
            for x in v:
                walk(path, x)
        elif isinstance(v, _Num):
            try:
                n = float(v)
            except ValueError:
                n = None
            out.append((path, str(v), n if n is not None and abs(n) != float("inf") else None, False, False))
        elif isinstance(v, str):
            out.append((path, v, None, True, False))
        elif v is None or isinstance(v, bool):
            out.append((path, {None: "null", True: "true", False: "false"}[v], None, False, False))

    if isinstance(o, dict):
        walk("", o)
    return out


def _dump(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_dump, v)) + "]"
    return str(v) if isinstance(v, _Num) else json.dumps(v, ensure_ascii=False)


def with_attributes(logs: DataFrame, attrs: str = "attrs", node: Node | None = None) -> DataFrame:
    """logs with attr_flat; null and broken attributes are none. With a query, only attributes whose raw text could meet
    one of its leaves are taken apart; the others are left null, which meets none."""
    c = F.col(attrs)
    if node is not None:
        could = c.contains("\\")  # an escape may spell anything
        for leaf in _leaves(node):
            part = max(leaf.text.split("*"), key=len).lower() if isinstance(leaf, Text) else leaf.path.rsplit(".", 1)[-1]
            could = could | (F.lower(c) if isinstance(leaf, Text) else c).contains(part)
        c = F.when(could, c)
    return logs.withColumn("attr_flat", F.udf(flatten, FLAT, useArrow=True)(c))


def _leaves(node: Node) -> list[Node]:
    """The leaves of a query that look into attributes."""
    if isinstance(node, (And, Or)):
        return [x for n in node.nodes for x in _leaves(n)]
    return _leaves(node.node) if isinstance(node, Not) else [node] if isinstance(node, (Attr, Text)) else []


def uses_attributes(node: Node) -> bool:
    if isinstance(node, (And, Or)):
        return any(map(uses_attributes, node.nodes))
    return uses_attributes(node.node) if isinstance(node, Not) else isinstance(node, (Attr, Text))


def label(key: str) -> Column:
    """A label's value; a missing one is ''. env is the value of the first env: tag."""
    if key == "env":
        return F.coalesce(F.substring(F.get(F.filter("tags", lambda t: t.startswith("env:")), F.lit(0)), 5, 1 << 20), F.lit(""))
    return F.coalesce(F.col(key), F.lit(""))


def _contains(c: Column, text: str) -> Column:
    pat = "".join({"*": "%", "%": r"\%", "_": r"\_", "\\": "\\\\"}.get(x, x) for x in text.lower())
    return F.lower(c).contains(text.lower()) if "*" not in text else F.lower(c).like(f"%{pat}%")


def condition(n: Node) -> Column:
    """The filter of a tree; every leaf is true or false, never null, so negation is two-valued."""
    if isinstance(n, All):
        return F.lit(True)
    if isinstance(n, And):
        out = condition(n.nodes[0])
        for x in n.nodes[1:]:
            out = out & condition(x)
        return out
    if isinstance(n, Or):
        out = condition(n.nodes[0])
        for x in n.nodes[1:]:
            out = out | condition(x)
        return out
    if isinstance(n, Not):
        return ~condition(n.node)
    if isinstance(n, Label):
        v = label(n.key)
        return v != "" if n.value == "*" else glob(v, n.value)
    if isinstance(n, Text):
        if n.text.strip("*") == "":
            return F.lit(True)
        return F.coalesce(_contains(F.col("message"), n.text), F.lit(False)) | F.coalesce(F.exists("attr_flat", lambda a: a["is_string"] & _contains(a["text"], n.text)), F.lit(False))
    if isinstance(n, Attr):
        return F.coalesce(F.exists("attr_flat", lambda a: (a["path"] == n.path) & _compare(a, n)), F.lit(False))
    raise TypeError(n)


def _compare(a: Column, n: Attr) -> Column:
    num = a["num"]
    no = F.lit(False)
    if n.op == "range":
        return F.coalesce(num.between(n.lo, n.hi), no)
    if n.op != "=":
        return F.coalesce({">": num > n.lo, ">=": num >= n.lo, "<": num < n.lo, "<=": num <= n.lo}[n.op], no)
    if n.value == "*":
        return ~a["is_object"]
    same = glob(a["text"], n.value) & ~a["is_object"]
    try:
        x = float(n.value)
    except ValueError:
        return same
    return same | F.coalesce(num == x, no)


def compile_filter(logs: DataFrame, text: str) -> DataFrame:
    """The logs that match a query. attr_flat is added if the query needs it and the logs don't have it."""
    node = parse(text)
    if isinstance(node, And):  # label conjuncts first: they cost no attribute work
        first = [x for x in node.nodes if not uses_attributes(x)]
        for x in first:
            logs = logs.where(condition(x))
        rest = tuple(x for x in node.nodes if uses_attributes(x))
        node = And(rest) if len(rest) > 1 else rest[0] if rest else All()
    if uses_attributes(node) and "attr_flat" not in logs.columns:
        return with_attributes(logs, node=node).where(condition(node)).drop("attr_flat")
    return logs.where(condition(node))

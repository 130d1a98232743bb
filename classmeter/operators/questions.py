"""Running an accepted read-only question over the relations."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from classmeter.operators.quality import read_only_gate
from classmeter.sources.tables import Tables, as_text, register

# Functions that call code outside the engine.
_OUTSIDE = re.compile(r"\b(try_)?(reflect|java_method)\b", re.IGNORECASE)


# Leaves of a parsed plan that read no table, and table functions of the engine that read none.
_EMPTY = {"OneRowRelation", "OneRowRelation$", "LocalRelation", "UnresolvedInlineTable"}
_GENERATORS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}


def _each(items) -> list:
    """A Scala sequence as a list."""
    return [items.apply(i) for i in range(items.size())]


def _is(node, name: str) -> bool:
    return is_instance_of(SparkContext._gateway, node, f"org.apache.spark.sql.catalyst.{name}")


def _strange(plan, relations: set[str], visible: frozenset[str] = frozenset()) -> set[str]:
    """What a parsed plan reads besides `relations` and the names that are visible where they stand.

    A name that a WITH defines is visible in what follows it there, and in its own
    definition if that is recursive; not beside or above that WITH.
    """
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        parts = _each(plan.multipartIdentifier())
        name = ".".join(parts).lower()
        return set() if name in relations or (len(parts) == 1 and name in visible) else {name}
    found: set[str] = set()
    if kind == "UnresolvedWith":
        for relation in _each(plan.cteRelations()):
            name = relation._1().lower()
            found |= _strange(relation._2(), relations, visible | {name} if plan.allowRecursion() else visible)
            visible |= {name}
    elif kind == "UnresolvedTableValuedFunction":
        name = ".".join(_each(plan.name())).lower()
        found |= set() if name in _GENERATORS else {f"{name}()"}
    elif plan.children().isEmpty() and kind not in _EMPTY or "Identifier" in kind or "TimeTravel" in kind:
        return {kind}
    for child in _each(plan.children()):
        found |= _strange(child, relations, visible)
    for expression in _each(plan.expressions()):
        found |= _strange_in(expression, relations, visible)
    return found


def _strange_in(expression, relations: set[str], visible: frozenset[str]) -> set[str]:
    """The same for the subqueries of an expression."""
    found: set[str] = set()
    if "Identifier" in expression.getClass().getSimpleName():
        return {"identifier()"}
    if _is(expression, "expressions.PlanExpression"):
        found |= _strange(expression.plan(), relations, visible)
    for child in _each(expression.children()):
        found |= _strange_in(child, relations, visible)
    return found


def ask(spark: SparkSession, t: Tables, sql: str, mode: str = "substring") -> DataFrame:
    """The result of one SELECT over the relations and views, every cell as text.

    Other statements, write words, calls into Java, and tables or files that
    are not registered relations raise PermissionError before anything runs.
    """
    question = spark.createDataFrame([(sql,)], "sql string")
    reason = read_only_gate(question, "sql", mode).first()["reason"]
    if reason is None and _OUTSIDE.search(sql):
        reason = "calls outside code"
    if reason is not None:
        raise PermissionError(reason)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    strange = _strange(plan, {name.lower() for name in register(spark, t)})
    if strange:
        raise PermissionError(f"not a relation: {', '.join(sorted(strange))}")
    setting = "spark.sql.runSQLOnFiles"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return as_text(spark.sql(sql))
    finally:
        spark.conf.set(setting, before)

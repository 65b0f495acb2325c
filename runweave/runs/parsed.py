"""What Spark's own parser says of a SQL text: the tables it names, and whether it only reads."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

Name = tuple[str, ...]
#: Commands that show something and change nothing, by the start of their names.
SHOWING = ("Show", "Describe", "Explain")


def parse(spark: SparkSession, sql: str) -> Any:
    """Parsed plan of one statement; text that does not parse raises."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _each(found: Any) -> Iterator[Any]:
    items = found.iterator()
    while items.hasNext():
        yield items.next()


def _below(node: Any) -> Iterator[Any]:
    yield from _each(node.children())
    yield from _each(node.subqueries())


def tables_named(plan: Any) -> set[Name]:
    """Names, part by part, of the tables that a parsed plan reads; names of its own `WITH` clauses are none.

    Text in quotes and comments names no table. A name that is a parameter (`IDENTIFIER(:t)`) is not known here.
    """
    named: set[Name] = set()
    todo = [(plan, frozenset())]
    while todo:
        node, own = todo.pop()
        kind = node.nodeName()
        if kind == "UnresolvedRelation":
            name = tuple(_each(node.multipartIdentifier()))
            if len(name) > 1 or name[0].lower() not in own:
                named.add(name)
        elif kind == "UnresolvedWith":
            # A clause sees those before it, and itself where it is recursive.
            for clause in _each(node.innerChildren()):
                alias = clause.alias().lower()
                todo.append((clause, own | {alias} if node.allowRecursion() else own))
                own = own | {alias}
        todo += [(below, own) for below in _below(node)]
    return named


def has_named_parameter(plan: Any) -> bool:
    """Whether a table name is left to a parameter."""
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "PlanWithUnresolvedIdentifier":
            return True
        todo += _below(node)
        if node.nodeName() == "UnresolvedWith":
            todo += _each(node.innerChildren())
    return False


def writing_command(spark: SparkSession, plan: Any) -> str | None:
    """Name of the command in a parsed plan that is not a mere query; None for a query or what only shows."""
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if (command.isInstance(node) and not kind.startswith(SHOWING)) or kind.startswith("InsertInto"):
            return kind
        todo += _below(node)
    return None

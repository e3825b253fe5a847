"""Questions that patterns turn into statements, and statements that may only read.

A pattern's groups are bound as parameters and never become part of the
statement.  A statement runs only if its words pass the read-only filter, its
parsed plan holds no command, and it names no table but the allowed ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.filters import read_only


class NotAllowed(ValueError):
    """A statement that does more than read the allowed tables."""


@dataclass(frozen=True)
class Pattern:
    """A regular expression over questions, a statement with :g1, :g2, ... for its groups, and what it finds."""

    expression: str
    statement: str
    description: str


def _nodes(plan) -> Iterator:
    yield plan
    for children in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for k in range(children.size()):
            child = children.apply(k)
            if hasattr(child, "innerChildren") and hasattr(child, "subqueries"):
                yield from _nodes(child)


def checked(spark: SparkSession, statement: str, tables: set[str]) -> None:
    """Raise NotAllowed unless the statement only reads these tables."""
    asked = spark.range(1).select(read_only(F.lit(statement)).alias("ok")).first()["ok"]
    if not asked:
        raise NotAllowed("not a single reading statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise NotAllowed("cannot be parsed") from e
    known = {t.lower() for t in tables}
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if "Command" in name or name.startswith(("Insert", "Create", "Drop", "Replace", "Delete", "Update", "Merge", "Alter", "Set")):
            raise NotAllowed(f"a command: {name}")
        if name == "UnresolvedWith":
            known |= {node.cteRelations().apply(k)._1().lower() for k in range(node.cteRelations().size())}
        if name == "UnresolvedTableValuedFunction":
            raise NotAllowed("a table function")
        if name == "UnresolvedRelation" and node.tableName().replace("`", "").lower() not in known:
            raise NotAllowed(f"an unknown table: {node.tableName()}")


def run(spark: SparkSession, statement: str, tables: dict[str, DataFrame], args: dict[str, str] | None = None) -> DataFrame:
    """The rows of a checked statement over these tables alone."""
    checked(spark, statement, set(tables))
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=args or {})


def answer(spark: SparkSession, question: str, patterns: list[Pattern], tables: dict[str, DataFrame]) -> tuple[str, DataFrame] | None:
    """(description, rows) of the first pattern that matches and may run; None without one."""
    for p in patterns:
        m = re.search(p.expression, question, re.IGNORECASE)
        if m:
            try:
                return p.description, run(spark, p.statement, tables, {f"g{k}": g for k, g in enumerate(m.groups(), 1)})
            except NotAllowed:
                continue
    return None


def matched_groups(patterns: list[Pattern]):
    """A table function for SQL: (pattern, place, value) of the first pattern that a question matches; groups that took no part are null."""
    from pyspark.sql.functions import udtf

    compiled = [(k, p.expression) for k, p in enumerate(patterns)]

    @udtf(returnType="pattern int, place int, value string")
    class Matched:
        def __init__(self):
            self.patterns = [(k, re.compile(e, re.IGNORECASE)) for k, e in compiled]

        def eval(self, question: str):
            for k, e in self.patterns:
                m = e.search(question) if question is not None else None
                if m:
                    yield from ((k, n, g) for n, g in enumerate(m.groups(), 1))
                    return

    return Matched

"""A guard for SQL text that others have written: one read-only statement on approved tables.

Spark's own parser reads the text. Every node of the plan it gives must be of a kind that only reads,
every table one of the views or of the statement's own common table expressions, which may not have
the name of another table, every column one of the views' or an alias, and every function on the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Plan nodes that only read.
NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedRelation UnresolvedWith UnresolvedHaving WithWindowDefinition OneRowRelation".split()
)
SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery")
#: Functions without effects beyond their result, and without other ways to read.
FUNCTIONS = frozenset(
    "count sum avg mean min max stddev variance median first last any_value count_if round floor ceil ceiling abs sign sqrt power exp ln log10 mod greatest least coalesce nullif ifnull nvl if "
    "upper lower trim ltrim rtrim btrim length char_length substr substring left right instr locate position replace concat concat_ws lpad rpad split_part initcap reverse like ilike rlike "
    "year month day quarter date to_date date_add date_sub datediff date_diff date_trunc date_format add_months months_between row_number rank dense_rank percent_rank ntile lag lead cast "
    "try_divide try_cast string int bigint double".split()
)
QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`"


#: The longest text that padding may make.
PADDED = 1000


class Refused(ValueError):
    """The text isn't a query that the guard lets through."""


def cleaned(text: str) -> str:
    """The statement without fences, comments outside quotes and a closing semicolon."""
    out = re.sub(r"^```\w*\n|\n?```$", "", text.strip())
    out = re.sub(rf"({QUOTED})|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", out, flags=re.DOTALL)
    return out.strip().removesuffix(";").strip()


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(node, is_plan) -> Iterator[tuple[str, object, bool]]:
    """(kind, node, whether it is a plan) of all nodes and expressions, also in subqueries and common table expressions."""
    kind, plan = node.getClass().getSimpleName().removesuffix("$"), is_plan(node)
    yield kind, node, plan
    inner = list(_items(node.expressions())) if plan else []
    if kind in SUBQUERIES:
        inner.append(node.plan())
    if kind == "UnresolvedWith":
        inner += [pair.productElement(1) for pair in _items(node.cteRelations())]
    for child in (*inner, *_items(node.children())):
        yield from _nodes(child, is_plan)


def _parts(names) -> str:
    return ".".join(str(n) for n in _items(names)).lower()


def _attributes(node) -> set[tuple[str, ...]]:
    own = {tuple(_parts(node.nameParts()).split("."))} if node.getClass().getSimpleName() == "UnresolvedAttribute" else set()
    return own.union(*(_attributes(c) for c in _items(node.children())))


def _joins(condition) -> bool:
    """Whether a condition that must hold says that a column of one table equals one of another."""
    kind = condition.getClass().getSimpleName()
    if kind == "And":
        return any(_joins(c) for c in _items(condition.children()))
    if kind not in ("EqualTo", "EqualNullSafe"):
        return False
    left, right = (_attributes(c) for c in _items(condition.children()))
    tables = {names[:-1] for names in left}, {names[:-1] for names in right}
    return bool(left and right) and left != right and (() in tables[0] | tables[1] or not tables[0] & tables[1])


def _long_padding(function) -> bool:
    """lpad or rpad to anything but a number that is written out and at most PADDED."""
    if _parts(function.nameParts()) not in ("lpad", "rpad"):
        return False
    width = list(_items(function.children()))[1:2]
    return not (width and width[0].getClass().getSimpleName() == "Literal" and str(width[0].value()).isdigit() and int(str(width[0].value())) <= PADDED)


def checked(spark: SparkSession, text: str, tables: Iterable[str], columns: Iterable[str], *, functions: frozenset[str] = FUNCTIONS) -> str:
    """The statement, or Refused. A LIMIT must be a number."""
    sql = cleaned(text)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Refused("not one statement that can be read") from e
    gateway = spark.sparkContext._gateway
    every = list(_nodes(plan, lambda n: is_instance_of(gateway, n, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")))
    if other := sorted({k for k, _, is_plan in every if is_plan} - NODES):
        raise Refused(f"only SELECT or WITH: {', '.join(other)}")
    found = [(k, n) for k, n, _ in every]
    own = {str(pair.productElement(0)).lower() for k, n in found if k == "UnresolvedWith" for pair in _items(n.cteRelations())}
    read = {_parts(n.multipartIdentifier()) for k, n in found if k == "UnresolvedRelation"}
    if other := read - own - {t.lower() for t in tables}:
        raise Refused(f"not an approved table: {', '.join(sorted(other))}")
    called = {_parts(n.nameParts()) for k, n in found if k == "UnresolvedFunction"}
    if other := called - functions:
        raise Refused(f"not an approved function: {', '.join(sorted(other))}")
    named = own | {x.lower() for x in (*columns, *tables)} | {str(n.name()).lower() for k, n in found if k == "Alias"}
    named |= {str(n.identifier().name()).lower() for k, n in found if k == "SubqueryAlias"}
    named |= {str(c).lower() for k, n in found if k == "UnresolvedSubqueryColumnAliases" for c in _items(n.outputColumnNames())}
    used = {p for k, n in found if k == "UnresolvedAttribute" for p in _parts(n.nameParts()).split(".")}
    if other := used - named:
        raise Refused(f"not an approved column: {', '.join(sorted(other))}")
    if any(k == "Join" and n.condition().isEmpty() and n.joinType().getClass().getSimpleName().rstrip("$") in ("Inner", "Cross") for k, n in found):
        raise Refused("tables must be joined by a condition")
    if any(k == "Join" and not n.condition().isEmpty() and not _joins(n.condition().get()) for k, n in found):
        raise Refused("a join must say which columns of both tables are equal")
    if any(k == "UnresolvedFunction" and _long_padding(n) for k, n in found):
        raise Refused(f"padding must be a number up to {PADDED}")
    if hidden := sorted(c for c in own - {t.lower() for t in tables} if spark.catalog.tableExists(c)):
        raise Refused(f"a name that hides a table: {', '.join(hidden)}")
    if any(n.limitExpr().getClass().getSimpleName() != "Literal" for k, n in found if k in ("GlobalLimit", "LocalLimit")):
        raise Refused("LIMIT must be a number")
    if any(k in ("UnresolvedTableValuedFunction", "LateralSubquery", "UnresolvedInlineTable", "NamedParameter", "PosParameter") for k, _ in found):
        raise Refused("only tables may be read")
    return sql


def ask(spark: SparkSession, text: str, views: dict[str, DataFrame], *, most_rows: int = 500) -> DataFrame:
    """The first most_rows rows of a guarded statement that sees the given views only.

    The views exist while the statement is analysed; views of the session with their names come back.
    """
    sql = checked(spark, text, views, {c for df in views.values() for c in df.columns})
    before = {name: spark.table(name) for name in views if any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables())}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql).limit(most_rows)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)

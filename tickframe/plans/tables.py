"""What a SQL text is and which tables it names, from its parsed form."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import QueryError, query_error


def _walk(node, out: set[str]) -> None:
    if node.nodeName() in ("UnresolvedRelation", "RelationTimeTravel"):
        parts = node.multipartIdentifier()
        out.add(parts.apply(parts.size() - 1))
    if node.nodeName() == "InsertIntoStatement":
        _walk(node.table(), out)
    # inner children of any other node are the subqueries in its expressions
    for children in (node.children(), *([node.innerChildren()] if node.nodeName() == "UnresolvedWith" else [])):
        for k in range(children.size()):
            _walk(children.apply(k), out)


def _parse(spark: SparkSession, sql: str):
    """The parsed statement. The parser reads its settings from the thread's active session, which may be a caller's."""
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()


def extract_table_names(spark: SparkSession, sql: str) -> list[str]:
    """Sorted, distinct table names of a statement, the last part of each; names of common table expressions included.

    Joins, derived tables, set operations and the bodies of common table expressions are walked, subqueries within
    expressions are not.
    """
    try:
        plan = _parse(spark, sql)
    except Exception as e:
        raise query_error(e) from e
    out: set[str] = set()
    _walk(plan, out)
    return sorted(out)


#: Base classes of parsed statements that do something instead of describing rows.
_DOING = ("Command", "ParsedStatement", "CompoundPlanStatement")


def require_query(spark: SparkSession, sql: str) -> None:
    """Refuse DDL, DML, SET, SHOW, EXPLAIN and scripts, before anything of them runs."""
    plan = _parse(spark, sql)
    loader = plan.getClass().getClassLoader()
    doing = [loader.loadClass(f"org.apache.spark.sql.catalyst.plans.logical.{n}") for n in _DOING]

    def walk(node) -> None:
        if any(c.isInstance(node) for c in doing):
            raise QueryError(f"only queries are accepted, not {node.nodeName()}", "not_implemented")
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)

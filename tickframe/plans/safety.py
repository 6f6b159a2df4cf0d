"""Which operators of a plan need all input before their first row."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import PipelineBreakerError

#: Names that only give a relation another name.
_NAMES = ("SubqueryAlias", "View", "WithCTE", "CTERelationDef", "CTERelationRef")
_FINAL = ("Window", "Distinct", "Deduplicate", "Intersect", "Except", "Tail", "Pivot")


@dataclass(frozen=True)
class Breaker:
    operator: str
    depth: int
    path: str
    emission: str = "Final"


@dataclass
class PipelineAnalysis:
    breakers: list[Breaker] = field(default_factory=list)
    total_operators: int = 0

    @property
    def streaming_safe(self) -> bool:
        return not self.breakers

    def report(self) -> str:
        if self.streaming_safe:
            return f"plan safety: ok, {self.total_operators} operators stream"
        lines = [f"plan safety: {len(self.breakers)} of {self.total_operators} operators hold back their output"]
        lines += [f"  {b.operator} at depth {b.depth} ({b.emission}): {b.path}" for b in self.breakers]
        return "\n".join([*lines, "No row comes out of these before the source ends."])


def _list(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _blocks(node) -> bool:
    """Whether the operator itself holds back its output, whatever its input does."""
    name = node.nodeName()
    if name == "Sort":
        order = [str(o.toString()) for o in _list(node.order())]
        return not (len(order) == 1 and re.match(r"tick#\d+ ASC", order[0]))
    if name == "Aggregate":
        return not any(re.match(r"(\w+\.)?tick#\d+", str(g.toString())) for g in _list(node.groupingExpressions()))
    if name == "Join":
        condition = node.condition()
        equal = condition.isDefined() and re.search(r" (=|<=>) ", condition.get().toString())
        return not (equal and node.joinType().toString() == "Inner")
    return name in _FINAL


def analyze(df: DataFrame) -> PipelineAnalysis:
    """Root causes only: operators that hold back their output although not all of their inputs do."""
    out = PipelineAnalysis()

    def final(node) -> bool:
        return _blocks(node) or any(final(c) for c in _list(node.children()))

    def walk(node, depth: int, path: str) -> None:
        children = _list(node.children())
        name = node.nodeName()
        if name not in _NAMES:
            out.total_operators += 1
            path = f"{path} -> {name}" if path else name
            if _blocks(node) and not (children and all(final(c) for c in children)):
                out.breakers.append(Breaker(name, depth, path))
            depth += 1
        for c in children:
            walk(c, depth, path)

    walk(df._jdf.queryExecution().analyzed(), 0, "")
    return out


def require_streaming_safe(df: DataFrame) -> PipelineAnalysis:
    found = analyze(df)
    if not found.streaming_safe:
        raise PipelineBreakerError(found)
    return found

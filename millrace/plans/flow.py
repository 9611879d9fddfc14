"""A flow: named nodes that are functions of DataFrames, and labelled edges. Laid out as one lazy DAG.

Several incoming edges of disjoint branches converge by union; Catalyst sees one plan and pushes guards,
projections and filters through it. Only sinks start work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import rows

Step = Callable[[DataFrame], DataFrame]


class FlowError(ValueError):
    """All problems of a flow at once."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


class Flow:
    def __init__(self, name: str = "flow"):
        self.name = name
        self.steps: dict[str, Step] = {}
        self.guards: dict[str, Column] = {}
        self.edges: list[tuple[str, str, str | None]] = []
        self.ports: dict[tuple[str, str, str | None], dict[str, str]] = {}
        self.inactive: set[str] = set()

    def node(self, name: str, step: Step | None = None, guard: Column | None = None, active: bool = True) -> Flow:
        """guard: its label decides which labelled edges a row takes. An inactive node passes its input on."""
        self.steps[name] = step or rows.passthrough
        if guard is not None:
            self.guards[name] = guard
        if not active:
            self.inactive.add(name)
        return self

    def edge(self, src: str, dst: str, label: str | None = None, ports: dict[str, str] | None = None) -> Flow:
        """ports: the columns that go along and their names at the target; without it all go under their own names."""
        if (src, dst, label) in self.edges:
            raise FlowError([f"edge {src} -> {dst} is there already"])
        self.edges.append((src, dst, label))
        if ports:
            self.ports[src, dst, label] = ports
        return self

    def waves(self) -> list[list[str]]:
        """Nodes by the longest path that leads to them; FlowError for cycles and edges to unknown nodes."""
        bad = [f"edge {a} -> {b} names an unknown node" for a, b, _ in self.edges if a not in self.steps or b not in self.steps]
        if bad:
            raise FlowError(bad)
        level, left = {}, dict.fromkeys(self.steps)
        while left:
            ready = [n for n in left if all(a in level for a, b, _ in self.edges if b == n)]
            if not ready:
                raise FlowError([f"nodes {sorted(left)} are on or behind a cycle"])
            for n in ready:
                level[n] = 1 + max((level[a] for a, b, _ in self.edges if b == n), default=-1)
                del left[n]
        return [[n for n in self.steps if level[n] == k] for k in range(max(level.values(), default=-1) + 1)]

    def plan(self, only_reached: bool = False, **sources: DataFrame) -> dict[str, DataFrame]:
        """The output of every node, nothing computed. A source is handed to the node of its name, which may be any node:
        with only_reached, nodes that no source reaches are left out."""
        out: dict[str, DataFrame] = {}
        for wave in self.waves():
            for n in wave:
                parts = [sources[n]] if n in sources else []
                for a, b, label in self.edges:
                    if b == n:
                        labels = [x for s, _, x in self.edges if s == a and x]
                        if a not in out:
                            continue
                        part = self._taken(out[a], a, label, labels).drop("_decision") if label else out[a].drop("_decision")
                        named = self.ports.get((a, b, label))
                        parts.append(part.select(*[F.col(x).alias(y) for x, y in named.items()]) if named else part)
                if not parts and not only_reached:
                    raise FlowError([f"{n} has neither a source nor an edge"])
                if not parts:
                    continue
                got = rows.converge(parts)
                done = got if n in self.inactive else self.steps[n](got)
                out[n] = rows.decide(done, self.guards[n]) if n in self.guards else done
        return {k: v.drop("_decision") for k, v in out.items()}

    def _taken(self, df: DataFrame, src: str, label: str, labels: list[str]) -> DataFrame:
        """The rows for a labelled edge; a boolean guard is the filter itself, so that scans can take it."""
        guard = self.guards.get(src)
        if guard is not None and label in ("yes", "no") and df.select(guard).dtypes[0][1] == "boolean":
            return df.where(guard if label == "yes" else ~F.coalesce(guard, F.lit(False)))
        return rows.branch(df, labels)[label]

    def invoke(self, inputs: DataFrame | dict[str, DataFrame], token: str) -> DataFrame:
        """The flow called like a function: one table goes to its only source node, several to the source nodes of their names;
        the outputs of its sinks stand side by side for each token."""
        sources = [n for n in self.steps if all(b != n for _, b, _ in self.edges)]
        sinks = [n for n in self.steps if all(a != n for a, _, _ in self.edges)]
        if isinstance(inputs, DataFrame):
            if len(sources) != 1:
                raise FlowError([f"{self.name} has {len(sources)} source nodes, so inputs need names"])
            inputs = {sources[0]: inputs}
        if lost := sorted(set(inputs) - set(sources)):
            raise FlowError([f"{self.name} has no source nodes {lost}"])
        out = self.plan(**inputs)
        return rows.fan_in([out[n] for n in sinks], token)

    def as_step(self, entry: str, exit_: str) -> Step:
        """The flow as a node of another flow."""
        return lambda df: self.plan(**{entry: df})[exit_]

"""Data model: canonical schemas, the query graph and its interchange, search settings."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, replace

CELL, VAR, OUTPUT, ANY, ONE = "Cell", "Var", "Display_data", "AnyWildcard", "OneWildcard"

#: Canonical tables, as DDL.
SCHEMAS = {
    "wf_nodes": "nb_name string, node string, node_type string, real_cell_id int, display_type string",
    "wf_edges": "nb_name string, src string, dst string, rel string",
    "cells": "nb_name string, cell_id int, cell_code string",
    "cell_values": "table_name string, group_id int, col string, col_pos int, dtype string, row_id long, value string",
    "libraries": "nb_name string, library string",
    "display_types": "nb_name string, cell_id int, data_type string",
    "lineage": "view_id string, dependency string, line2cid string, last_line int",
    "scalar_vars": "nb_name string, cell_id int, var_name string, contents string",
    "table_ids": "data_id long, table_name string",
    "cell_dict": "code string, cell_id int",
    "judgements": "query_id string, nb_id int, data int, code int, library int, output int, flow int, overall int",
}
RELATIONS = ("Successor", "Contains", "Usedby", "Display")

#: Node types of a query file: the type in the workflow, and the kind of output.
UI_TYPES = {"code": (CELL, None), "data": (VAR, None), "text_output": (OUTPUT, "text"), "figure_output": (OUTPUT, "png"), "table_output": (OUTPUT, "DataFrame"), "reachability": (ANY, None)}


@dataclass(frozen=True)
class QueryNode:
    name: str
    label: str
    contents: str | None = None
    display_type: str | None = None


@dataclass(frozen=True)
class Query:
    """A rooted graph of typed nodes with a set of libraries."""

    nodes: tuple[QueryNode, ...]
    edges: tuple[tuple[str, str], ...]
    libraries: tuple[str, ...] = ()

    def node(self, name: str) -> QueryNode:
        return next(n for n in self.nodes if n.name == name)

    def count(self, label: str) -> int:
        return sum(n.label == label for n in self.nodes)

    @property
    def root(self) -> str:
        targets = {b for _, b in self.edges}
        roots = [n.name for n in self.nodes if n.name not in targets]
        if len(roots) != 1:
            raise ValueError(f"a query has one root; this one has {roots}")
        return roots[0]

    def validate(self, wildcard_root: bool = False) -> Query:
        names = [n.name for n in self.nodes]
        if len(set(names)) != len(names):
            raise ValueError("query node names must differ")
        for a, b in self.edges:
            if a not in names or b not in names:
                raise ValueError(f"edge {a}->{b} has an unknown node")
        if not wildcard_root and self.node(self.root).label in (ANY, ONE):
            raise ValueError("the root of a query can't be a wildcard")
        seen, todo = set(), [self.root]
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += [b for a, b in self.edges if a == at]
        if seen != set(names):
            raise ValueError(f"not reachable from the root: {sorted(set(names) - seen)}")
        return self

    def stats(self) -> dict[str, int]:
        """What a notebook must have at least: nodes by label, outputs by type and in all, degrees. Wildcards and their edges don't count."""
        real = {n.name for n in self.nodes if n.label not in (ANY, ONE)}
        into, out = defaultdict(int), defaultdict(int)
        for a, b in self.edges:
            if a in real and b in real:
                out[a] += 1
                into[b] += 1
        return {"n_cell": self.count(CELL), "n_var": self.count(VAR), "n_output": self.count(OUTPUT), "max_in": max(into.values(), default=0), "max_out": max(out.values(), default=0)}

    def without_node(self, name: str) -> Query:
        """Only a node without edges can be deleted."""
        if any(name in e for e in self.edges):
            raise ValueError(f"node {name} has edges")
        return replace(self, nodes=tuple(n for n in self.nodes if n.name != name))

    def without_edge(self, a: str, b: str) -> Query:
        return replace(self, edges=tuple(e for e in self.edges if e != (a, b)))

    def from_anywhere(self) -> Query:
        """The query with a root of AnyWildcard taken for any node, from which the rest is reached."""
        root = self.node(self.root)
        if root.label != ANY:
            return self
        far = QueryNode(f"{root.name}__far", ANY)
        nodes = tuple(replace(n, label=ONE) if n == root else n for n in self.nodes)
        return replace(self, nodes=(*nodes, far), edges=((root.name, far.name), *((far.name if a == root.name else a, b) for a, b in self.edges)))

    def joined_code(self) -> str:
        """The cells' code in depth-first order from the root, one text."""
        order, todo = [], [self.root]
        while todo:
            if (at := todo.pop()) not in order:
                order.append(at)
                todo += [b for a, b in reversed(self.edges) if a == at]
        lines = "\n".join(self.node(n).contents or "" for n in order if self.node(n).label == CELL).split("\n")
        return "\n".join(x for x in lines if x.strip())

    def to_json(self) -> str:
        kinds = {v: k for k, v in UI_TYPES.items()}
        ids = {n.name: i for i, n in enumerate(self.nodes)}
        return json.dumps(
            {
                "querynode": [{"node_id": ids[n.name], "node_type": kinds.get((n.label, n.display_type), n.label), "node_contents": n.contents} for n in self.nodes],
                "queryedge": [{"parent_node_id": ids[a], "successor_node_id": ids[b]} for a, b in self.edges],
                "querylibrary": [{"library_name": x} for x in self.libraries],
            }
        )

    @classmethod
    def from_json(cls, text: str) -> Query:
        raw = json.loads(text)
        nodes = []
        for n in raw["querynode"]:
            label, kind = UI_TYPES.get(n["node_type"], (n["node_type"], None))
            nodes.append(QueryNode(f"q{n['node_id']}", label, n.get("node_contents"), kind))
        return cls(tuple(nodes), tuple((f"q{e['parent_node_id']}", f"q{e['successor_node_id']}") for e in raw["queryedge"]), tuple(x["library_name"] for x in raw.get("querylibrary", ()))).validate()


def query(nodes: dict[str, str], edges: Iterable[tuple[str, str]], contents: dict[str, str] | None = None, libraries: Iterable[str] = (), display: dict[str, str] | None = None) -> Query:
    contents, display = contents or {}, display or {}
    return Query(tuple(QueryNode(k, v, contents.get(k), display.get(k)) for k, v in nodes.items()), tuple(edges), tuple(libraries)).validate()


#: Shapes of the experiments' query graphs: c cells, v tables, o outputs, r reachability.
SHAPES = {
    "one": "c1>c2 c2>c3 c2>v1 c2>o1 c3>c4 c4>o2",
    "two": "c1>c2 c2>c3 c2>v1 c2>o1 c3>c4 c4>v2",
    "three": "c1>c2 c1>v1 c1>o1 c2>c3 c3>c4 c4>v2",
    "four": "c1>c2 c2>c3 c2>v1",
    "outputs": "c1>c2 c2>c3 c1>v1 c1>o1 c2>o2 c3>o3",
    "far": "c1>r1 r1>c2 c2>r2 r2>c3 c2>v1 c2>o1 c3>c4 c4>o2",
    "far_outputs": "c1>r1 r1>c2 c2>r2 r2>c3 c3>c4 c1>v1 c1>o1 c2>o2 c4>o3",
}


def shaped(shape: str, contents: dict[str, str] | None = None, libraries: Iterable[str] = (), display: dict[str, str] | None = None) -> Query:
    """A query graph of one of SHAPES (or of a text like them)."""
    edges = [tuple(e.split(">")) for e in SHAPES.get(shape, shape).split()]
    names = dict.fromkeys(n for e in edges for n in e)
    return query({n: {"c": CELL, "v": VAR, "o": OUTPUT, "r": ANY}[n[0]] for n in names}, edges, contents, libraries, display)


@dataclass(frozen=True)
class SearchConfig:
    """Weights and switches. Negative node weights ask for dissimilarity; the library weight is used as it is."""

    k: int = 10
    w_code: float = 1.0
    w_data: float = 1.0
    w_output: float = 1.0
    w_library: float = 1.0
    normalise: bool = True
    #: "single" weighs data once; "reference" weighs it twice, as the studied engine does.
    data_weight_mode: str = "single"
    injective: bool = False
    include_unmatched: bool = False
    code_similarity: str = "tokens"

    def node_weights(self, q: Query) -> dict[str, float]:
        """Weights by label: divided by the query's cells, tables and twice its outputs where normalise is set."""
        if not self.normalise:
            return {CELL: self.w_code, VAR: self.w_data, OUTPUT: self.w_output}
        return {CELL: self.w_code / max(1, q.count(CELL)), VAR: self.w_data / max(1, q.count(VAR)), OUTPUT: self.w_output / max(1, 2 * q.count(OUTPUT))}


def node_score(weight: float, sim: float) -> float:
    """w * s, or |w| * (1 - s) for weights of 0 and less."""
    return weight * sim if weight > 0 else -weight * (1 - sim)

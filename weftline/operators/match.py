"""Matching a query graph in all notebooks: a fold of joins over its edges.

All label-preserving homomorphisms are found, whatever the order of the query's
edges (two query nodes may bind one node; injective=True forbids it). Every join
has the notebook in its key. AnyWildcard stands for one edge or more to any node
on the way; OneWildcard for one node of any label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ANY, ONE, Query
from . import graph_stats
from .reach import closure


def _plan(q: Query) -> tuple[list[tuple[str, str, bool]], list[str]]:
    """(a, b, far) in an order in which a is bound first, and the nodes that get bound. Far edges go through wildcards."""
    far = {n.name for n in q.nodes if n.label == ANY}
    children: dict[str, list[str]] = {}
    for a, b in q.edges:
        children.setdefault(a, []).append(b)

    def ends(w, seen=frozenset()):
        """What a wildcard leads to, through other wildcards."""
        for b in children.get(w, ()):
            if b in seen:
                continue
            if b in far:
                yield from ends(b, seen | {w})
            else:
                yield b

    out: list[tuple[str, str, bool]] = []
    bound, todo = [q.root], [q.root]
    while todo:
        at = todo.pop(0)
        near = [(b, False) for b in children.get(at, ()) if b not in far] + [(e, True) for b in children.get(at, ()) if b in far for e in ends(b)]
        for b, is_far in near:
            if (at, b, is_far) not in out:
                out.append((at, b, is_far))
            if b not in bound:
                bound.append(b)
                todo.append(b)
    # edges that bind come before those that only check, in the order of binding
    return out, bound


def find(nodes: DataFrame, edges: DataFrame, q: Query, *, reach: DataFrame | None = None, prefilter: bool = True, injective: bool = False, wildcard_root: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(nb_name, one column a bound query node[, <query node>__<column> for each node column to carry]).

    wildcard_root: a wildcard may be the root; it starts from every node.
    """
    q.validate(wildcard_root)
    q = q.from_anywhere()
    steps, bound = _plan(q)
    if prefilter:
        keep = graph_stats.structure_filter(graph_stats.workflow_stats(nodes, edges), q).select("nb_name")
        nodes, edges = nodes.join(keep, "nb_name", "left_semi"), edges.join(keep, "nb_name", "left_semi")
    if any(far for *_, far in steps) and reach is None:
        reach = closure(edges)

    def labelled(name: str):
        """The nodes that a query node can bind, named after it."""
        label = q.node(name).label
        own = nodes if label == ONE else nodes.where(F.col("node_type") == label)
        return own.select("nb_name", F.col("node").alias(name), *(F.col(c).alias(f"{name}__{c}") for c in carry))

    found = labelled(q.root)
    have = [q.root]
    waiting = list(steps)
    while waiting:
        k = next((i for i, (a, b, _) in enumerate(waiting) if a in have and b in have), None)
        if k is None:
            k = next(i for i, (a, _, _) in enumerate(waiting) if a in have)
        a, b, far = waiting.pop(k)
        pairs = (reach if far else edges).select("nb_name", F.col("src").alias(a), F.col("dst").alias(b))
        if b in have:
            found = found.join(pairs, ["nb_name", a, b], "left_semi")
        else:
            found = found.join(pairs.distinct(), ["nb_name", a]).join(labelled(b), ["nb_name", b])
            have.append(b)
            if injective:
                for other in have[:-1]:
                    found = found.where(F.col(other) != F.col(b))
    return found.select("nb_name", *bound, *(f"{n}__{c}" for n in bound for c in carry))


def as_pairs(matches: DataFrame, q: Query) -> DataFrame:
    """(nb_name, m, q, d): a row for each query node of each match; m is the match, as the array of its nodes."""
    names = [n.name for n in q.nodes if n.name in matches.columns]
    whole = matches.select("nb_name", F.array(*names).alias("m"), F.explode(F.array(*(F.struct(F.lit(n).alias("q"), F.col(n).alias("d")) for n in names))).alias("x"))
    return whole.select("nb_name", "m", "x.q", "x.d")

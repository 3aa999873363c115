"""Assignments and data flow of notebook code, by Python's ast, as table functions."""

from __future__ import annotations

import ast
from collections import defaultdict

from pyspark.sql.functions import udtf

#: Steps of a walk around a node, at most.
STAR_STEPS = 100


def clean(code: str) -> str:
    """Code without magics, comment lines and empty lines, and without lines that don't parse by themselves or within a block."""
    lines = [x for x in (code or "").split("\n") if x.strip() and not x.lstrip().startswith(("%", "!", "#"))]
    text = "\n".join(lines)
    try:
        ast.parse(text)
        return text
    except (SyntaxError, ValueError, RecursionError):
        pass
    kept = []
    for x in lines:
        try:
            ast.parse(x.strip())
            kept.append(x.strip())
        except (SyntaxError, ValueError, RecursionError):
            continue
    return "\n".join(kept)


def statements(code: str | None) -> list[str]:
    """Code lines with those that an open bracket or quote continues joined to one; magics, comments and empty lines are dropped.

    Quotes of either kind open and close; brackets and # inside them don't count.
    """
    out, held, quote, depth = [], "", "", 0
    for line in (code or "").split("\n"):
        if not line.strip() or (not held and line.lstrip().startswith("%")):
            continue
        end = len(line)
        for i, c in enumerate(line):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "#":
                end = i
                break
        if line[:end].strip():
            held += line[:end]
            if not quote and depth <= 0:
                out.append(held)
                held, depth = "", 0
    return [*out, held] if held else out


def names_read(code: str) -> list[str]:
    """The different names that code reads, in order of appearance."""
    try:
        tree = ast.parse(clean(code))
    except (SyntaxError, ValueError, RecursionError):
        return []
    return list(dict.fromkeys(n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)))


def lineage_star(view_id: str, dependency: dict, line2cid: dict, last_line: int) -> dict[str, list[str]]:
    """The star graph around a stored variable: definitions are var_<name>_<cell>_<notebook>, each reads from the latest earlier one."""
    _, *middle, notebook = view_id.split("_")
    last: dict[str, str] = {}
    edges = []
    for line in sorted(dependency):
        entry = dependency[line]
        left = {w: f"var_{w}_{line2cid.get(line)}_{notebook}" for w in entry["lhs"] or ()}
        for to in left.values():
            for r in entry["rhs"] or ():
                missing = f"{r['var']}{notebook}" if r["var"] in ("np", "pd") else f"var_{r['var']}_1_{notebook}"
                edges.append((last.get(r["var"], missing), to, r["op"]))
        last.update(left)
    return star(edges, f"var_{'_'.join(middle)}_{line2cid.get(last_line)}_{notebook}")


def _reads(node: ast.AST, operation: str):
    """(variable, operation) of each name read in an expression; an operation is named by the innermost construct around the name."""
    if isinstance(node, ast.Name):
        yield node.id, operation
    elif isinstance(node, ast.Attribute):
        yield from _reads(node.value, node.attr)
    elif isinstance(node, ast.Call):
        callee = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else "Call"
        if isinstance(node.func, ast.Attribute):
            yield from _reads(node.func.value, callee)
        for x in [*node.args, *(k.value for k in node.keywords)]:
            yield from _reads(x, callee)
    elif isinstance(node, ast.Subscript):
        yield from _reads(node.value, "Index")
        yield from _reads(node.slice, "Index")
    elif isinstance(node, (ast.BinOp, ast.UnaryOp, ast.BoolOp)):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.expr):
                yield from _reads(x, type(node.op).__name__)
    elif isinstance(node, ast.Compare):
        for x in (node.left, *node.comparators):
            yield from _reads(x, type(node.ops[0]).__name__)
    elif isinstance(node, (ast.List, ast.Tuple)):
        for x in node.elts:
            yield from _reads(x, type(node).__name__)
    else:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.expr, ast.keyword, ast.comprehension)):
                yield from _reads(x, operation)


def _writes(target: ast.AST):
    if isinstance(target, ast.Name):
        yield target.id
    elif isinstance(target, (ast.Tuple, ast.List)):
        for x in target.elts:
            yield from _writes(x)
    elif isinstance(target, (ast.Subscript, ast.Attribute, ast.Starred)):
        yield from _writes(target.value)


def _top_level(node: ast.AST):
    """All nodes that don't belong to the body of a function or class."""
    for x in ast.iter_child_nodes(node):
        if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            yield x
            yield from _top_level(x)


def assignments(code: str) -> list[tuple[int, list[str], list[tuple[str, str]]]]:
    """(line, variables assigned, [(variable read, operation)]) of each assignment outside of functions and classes, in line order."""
    try:
        tree = ast.parse(clean(code))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in _top_level(tree):
        if isinstance(node, ast.Assign):
            targets, value = node.targets, node.value
        elif isinstance(node, (ast.AugAssign, ast.AnnAssign)) and node.value is not None:
            targets, value = [node.target], node.value
        else:
            continue
        left = list(dict.fromkeys(w for t in targets for w in _writes(t)))
        if left:
            out.append((node.lineno, left, list(dict.fromkeys(_reads(value, "Assign")))))
    return sorted(out, key=lambda x: x[0])


def flow_edges(code: str) -> list[tuple[str, str, str]]:
    """(source, target, operation) between definitions var_<name>_<line>; what was never assigned is defined at line 1."""
    last: dict[str, int] = {}
    out = []
    for line, left, reads in assignments(code):
        for w in left:
            for r, op in reads:
                out.append((f"var_{r}_{last.get(r, 1)}", f"var_{w}_{line}", op))
        for w in left:
            last[w] = line
    return out


def star(edges: list[tuple[str, str, str]], root: str) -> dict[str, list[str]]:
    """For each node near the root the labels of its edges, + outgoing and - incoming."""
    near: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for a, b, op in edges:
        near[a].append((b, f"+{op}"))
        near[b].append((a, f"-{op}"))
    out, todo = {}, [root]
    for _ in range(STAR_STEPS):
        if not todo:
            break
        at = todo.pop(0)
        if at in out or at not in near:
            continue
        out[at] = sorted(label for _, label in near[at])
        todo += [b for b, _ in near[at] if b not in out]
    return out


@udtf(returnType="line int, lhs string, rhs_var string, op string")
class Assignments:
    """A row for each variable assigned and variable read in each assignment of a text of code."""

    def eval(self, code: str):
        for line, left, reads in assignments(code):
            for w in left:
                for r, op in reads or [(None, None)]:
                    yield line, w, r, op


@udtf(returnType="src string, dst string, op string")
class FlowEdges:
    def eval(self, code: str):
        yield from flow_edges(code)


@udtf(returnType="var string")
class Variables:
    """The distinct variables that a text of code assigns."""

    def eval(self, code: str):
        for w in dict.fromkeys(w for _, left, _ in assignments(code) for w in left):
            yield (w,)


@udtf(returnType="var string")
class Reads:
    """The distinct names that a text of code reads."""

    def eval(self, code: str):
        for w in names_read(code):
            yield (w,)


@udtf(returnType="node string, label string")
class LineageStars:
    """A row for each label of each node of the star graph around a stored variable."""

    def eval(self, view_id: str, dependency: dict, line2cid: dict, last_line: int):
        plain = {k: {"lhs": v["lhs"], "rhs": v["rhs"]} for k, v in (dependency or {}).items()}
        for node, labels in lineage_star(view_id, plain, line2cid or {}, last_line).items():
            for label in labels:
                yield node, label


@udtf(returnType="n int, statement string")
class Statements:
    """The numbered statements of a text of code."""

    def eval(self, code: str):
        yield from enumerate(statements(code), 1)


def register(spark) -> None:
    spark.udtf.register("code_statements", Statements)
    spark.udtf.register("code_reads", Reads)
    spark.udtf.register("lineage_stars", LineageStars)
    spark.udtf.register("code_assignments", Assignments)
    spark.udtf.register("code_flow", FlowEdges)
    spark.udtf.register("code_variables", Variables)


def table_function(frame, function: str, argument: str | list[str], keep: list[str]):
    """frame's keep columns with the rows that a registered table function gives for its argument column(s); the view's name is its own."""
    import uuid

    register(frame.sparkSession)
    arguments = ", ".join(f"t.`{c}`" for c in ([argument] if isinstance(argument, str) else argument))
    view = f"_weftline_{uuid.uuid4().hex}"
    frame.createOrReplaceTempView(view)
    try:
        return frame.sparkSession.sql(f"SELECT {', '.join(f't.`{c}`' for c in keep)}, f.* FROM {view} t, LATERAL {function}({arguments}) f")
    finally:
        frame.sparkSession.catalog.dropTempView(view)

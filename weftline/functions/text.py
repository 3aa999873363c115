"""Scalar functions on names and code, as columns; no Python runs for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_tokens(c: Column | str) -> Column:
    """The set of code tokens: split at white space, commas and =, then at dots (which can give the empty token)."""
    parts = F.filter(F.split(c, "\n|\t| |,|="), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(parts, lambda x: F.split(x, "\\."))))


def code_lines(c: Column | str) -> Column:
    """The set of lines that are not empty, with runs of blanks made one."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def line_hashes(c: Column | str) -> Column:
    return F.transform(code_lines(c), lambda x: F.xxhash64(x))


def without_comments(c: Column | str) -> Column:
    """Code without what follows # in a line and without the lines that this leaves empty."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, "#.*$", ""))
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)), F.lit(0.0))


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard(code_tokens(a), code_tokens(b))


def line_jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard(code_lines(a), code_lines(b))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two numeric arrays (the studied engine's version is defective and unused; this is the usual one)."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def clean_notebook_name(c: Column | str) -> Column:
    """Without .ipynb, - and _; the last two path segments joined; its last 25 characters."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(F.regexp_replace(c, "\\.ipynb", ""), "[-_]", "")
    parts = F.split(plain, "/")
    return F.right(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ""), F.lit(25))


def is_copy(c: Column | str) -> Column:
    """Whether a name is that of a synthetic copy."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike("cp[0-9]{1,3}$")


def original_name(c: Column | str) -> Column:
    return F.regexp_replace(c, "cp[0-9]{1,3}$", "")


def notebook_of(c: Column | str) -> Column:
    """The notebook in a variable's name: what follows the last underscore."""
    return F.substring_index(c, "_", -1)


def clean_column_name(name: str) -> str:
    return "".join(x for x in name if x not in "() %")


def is_index_column(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c == "Unnamed: 0") | (c == "Unnamed:0") | c.contains("index")


def imports(c: Column | str) -> Column:
    """Array of library names from the import lines of code.

    'from x import y' gives y. The last alias of a line is dropped, then blanks, and
    then the line is split at commas: 'import a as b, c as d' gives 'aasb' and 'c'.
    Comments are dropped.
    """
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))

    def names(x):
        tail = F.regexp_extract(x, "(?:^|\\s)import\\s+(.*)$", 1)
        plain = F.regexp_replace(F.regexp_replace(tail, "\\s+as\\s+\\w+\\s*$", ""), "\\s+", "")
        return F.when(x.rlike("^(import|from)\\s"), F.split(plain, ",")).otherwise(F.array().cast("array<string>"))

    return F.filter(F.flatten(F.transform(lines, names)), lambda x: x != "")


def last_assignment(code: Column | str, var: Column | str) -> Column:
    """The number (from 1) of the last line that assigns to var: what is before the first = ends with it; 0 if none."""
    lines = F.split(code, "\n")
    var = F.col(var) if isinstance(var, str) else var

    def hit(x, i):
        left = F.trim(F.split(x, "=").getItem(0))
        return F.when(x.contains("=") & left.endswith(var), i + 1).otherwise(0)

    return F.array_max(F.concat(F.array(F.lit(0)), F.transform(lines, hit)))


def output_kind(html: Column | str, has_png: Column | str, is_display: Column | str) -> Column:
    """DataFrame for html tables of class dataframe, png for displayed pictures, otherwise text."""
    html, has_png, is_display = (F.col(x) if isinstance(x, str) else x for x in (html, has_png, is_display))
    return F.when(html.contains('class="dataframe"'), "DataFrame").when(is_display & has_png, "png").otherwise("text")


def node_type(type_text: Column | str) -> Column:
    """Var, Module or NotTableVar from a Python type's text."""
    c = F.col(type_text) if isinstance(type_text, str) else type_text
    return F.when(c.contains("DataFrame"), "Var").when(c.contains("module"), "Module").otherwise("NotTableVar")


def code_key(c: Column | str) -> Column:
    return F.base64(F.encode(c, "UTF-8"))


def notebook_url(base: str, directory: Column | str, name: Column | str) -> Column:
    d, n = (F.col(x) if isinstance(x, str) else x for x in (directory, name))
    return F.concat(F.lit(base.rstrip("/") + "/"), d, F.lit("/"), n)

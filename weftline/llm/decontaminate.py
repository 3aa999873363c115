"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are lower-cased (A-Z only) runs of digits, a-z and non-ASCII characters.
The items' words go into one automaton; training documents stream through it and
the longest matching length is tracked at every word. Where it reaches the
window (10 words, or a whole item that is shorter), the words of that window are
hit. Long stretches that cannot hold a window, because a word between is in no
item, are skipped without changing a result: the automaton would be at its root.

Defined cases: null or empty text has no words and no hits; a null item text is
no item; a null item id counts as the id ''; repeated rows are handled each on
its own; a very long text is scanned whole, in memory of some 30 times its bytes;
an empty items table hits nothing, an empty document table gives no row; further
columns, whatever their names, are kept by decontaminate() and ignored by scan().
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .automaton import SuffixAutomaton
from .graph import broadcast_if

#: Item words in one automaton (some 600 bytes each in a worker). More items are dealt to several.
SHARD_WORDS = 250_000

SPANS = "array<struct<first:int,last:int>>"


class Matcher:
    """Finds windows of a bounded list of (item id, folded words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        vocabulary = sorted({w for _, words in items for w in words})
        hashes = X.hash_bytes(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        number = {w: i for i, w in enumerate(vocabulary)}
        self.least = min([window, *(len(w) for _, w in items if w)])
        self.sam = sam = SuffixAutomaton()
        coded = [(i, [number[w] for w in words]) for i, words in items if words]
        for _, words in coded:
            sam.add(words, 0)
        #: By state: the items that hold its factor of window words; the length and items of a short item that ends there.
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for item, words in coded:
            for s, n in sam.walk(words):
                if n >= window:
                    self.windows.setdefault(self.climb(s, window), set()).add(item)
            if len(words) < window:
                at = self.short.setdefault(self.climb(s, len(words)), (len(words), set()))
                at[1].add(item)

    def climb(self, state: int, n: int) -> int:
        """The state of the suffix of n tokens."""
        link, length = self.sam.link, self.sam.length
        while length[link[state]] >= n:
            state = link[state]
        return state

    def scan(self, words: list[int]):
        """(first word, last word, items) of each window that ends in these words."""
        for i, (s, n) in enumerate(self.sam.walk(words)):
            if n >= self.window:
                yield i - self.window + 1, i, self.windows[self.climb(s, self.window)]
            if self.short and n:
                t = s
                while t > 0:
                    if (got := self.short.get(t)) and got[0] <= n:
                        yield i - got[0] + 1, i, got[1]
                    t = self.sam.link[t]

    def texts(self, column: pa.Array):
        """For each row: (word count, merged spans, item ids, first bytes, last bytes of its words if it is hit)."""
        for _, data, offsets in X.chunks(column):
            starts, ends, bounds = X.split(data, offsets, X.FOLDED)
            hashes = X.folded_hashes(data, starts, ends)
            known = np.full(len(hashes), -1)
            if len(self.hashes):
                pick = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, hashes[pick]), len(self.hashes) - 1)
                known[pick] = np.where(self.hashes[at] == hashes[pick], self.ids[at], -1)
            inside = known >= 0
            cut = np.flatnonzero(~inside)
            edges = np.unique(np.concatenate([cut, cut + 1, bounds]))  # runs of known words within a row lie between edges
            sizes = np.diff(edges)
            runs = np.flatnonzero((sizes >= self.least) & inside[np.minimum(edges[:-1], max(0, len(inside) - 1))]) if len(inside) else []
            found: dict[int, tuple[list, set]] = {}
            rows = np.searchsorted(bounds, edges[:-1][runs], side="right") - 1 if len(runs) else []
            for r, k in zip(rows, runs, strict=True):
                base = int(edges[k])
                for first, last, items in self.scan(known[base : int(edges[k + 1])].tolist()):
                    spans, got = found.setdefault(int(r), ([], set()))
                    a = base + first - int(bounds[r])
                    b = base + last - int(bounds[r])
                    got |= items
                    spans.append((a, b))
            for r in range(len(offsets) - 1):
                n = int(bounds[r + 1] - bounds[r])
                if r not in found:
                    yield n, [], [], None, None
                    continue
                w = slice(int(bounds[r]), int(bounds[r + 1]))
                yield n, merged(found[r][0]), sorted(found[r][1]), starts[w] - offsets[r], ends[w] - offsets[r]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(text: bytes, spans, starts, ends) -> bytes:
    """The text without the spans' words and what lies between them."""
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : int(starts[first])])
        at = int(ends[last])
    return b"".join([*out, text[at:]])


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, items, window: int) -> Matcher:
    """One automaton for each Python worker, made of the broadcast items when first needed."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items.value, window)
    return _matchers[key]


def item_shards(items: DataFrame, id_col: str, text_col: str, shard_words: int) -> list[tuple[str, object]]:
    """(key, broadcast list of (item id, folded words)) of shards of about shard_words words.

    A shard is fetched, broadcast and let go before the next, so the driver holds
    one at a time, of a bounded size.
    """
    sized = items.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    total = sized.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / 2 / shard_words))  # a word and its separator take two characters at least
    table, out = X.FOLDED.tobytes(), []
    for k in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        words = [(r["item"], r["text"].encode().translate(table).replace(b"\0", b" ").split()) for r in part.toLocalIterator()]
        out.append((hashlib.sha256(repr(words).encode()).hexdigest(), items.sparkSession.sparkContext.broadcast(words)))
    return out


_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def _scan_one(docs: DataFrame, keep: list[str], text_col: str, shard, window: int) -> DataFrame:
    (key, items), at = shard, len(keep)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"n_words long, spans {SPANS}, items array<string>"])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, spans, got = [], [], []
            for words, s, i, _, _ in _matcher(f"{key} {window}", items, window).texts(b.column(at)):
                n.append(words)
                spans.append([{"first": x, "last": y} for x, y in s])
                got.append(i)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(n, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(got, pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "items"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("_scanned")).mapInArrow(run, schema)


def _hits(docs: DataFrame, text_col: str, shards, window: int) -> DataFrame:
    """(k, hits) of the texts that the shards hit: the md5 of the text, and of each shard its spans and items; a pass over the texts for each shard."""
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.md5(F.col(text_col).cast("binary")).alias("k"), F.col(text_col).alias("text"))
    parts = [_scan_one(keyed, ["k"], "text", shard, window).where("size(spans) > 0").select("k", F.struct("spans", "items").alias("hit")) for shard in shards]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return X.checkpointed(out.groupBy("k").agg(F.collect_set("hit").alias("hits")))  # copies of a text give equal hits


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: id, n_words, merged spans of hit words (from 0, both ends included), sorted item ids.

    One map over the documents without a shuffle, where the items fit one
    automaton. With more, each shard of items is a pass of its own over the
    texts, and the hits are merged by text.
    """
    X.prepare(docs.sparkSession)
    first, *more = item_shards(items, item_id, item_text, shard_words)
    if not more:
        return _scan_one(docs, [id_col], text_col, first, window)
    keyed = docs.select(F.col(id_col), F.col(text_col), F.md5(F.col(text_col).cast("binary")).alias("_k"))
    base = _scan_one(keyed, [id_col, "_k"], text_col, first, window)
    both = base.join(broadcast_if(_hits(docs, text_col, more, window)), F.col("_k") == F.col("k"), "left")

    def merge(batches):
        for b in batches:
            spans, got = [], []
            for s, i, hits in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                hits = [{"spans": s, "items": i}, *(hits or ())]
                spans.append([{"first": x, "last": y} for x, y in merged([(x["first"], x["last"]) for h in hits for x in h["spans"]])])
                got.append(sorted({x for h in hits for x in h["items"]}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(got, pa.list_(pa.string()))], names=[id_col, "n_words", "spans", "items"])

    return both.select(id_col, "n_words", "spans", "items", "hits").mapInArrow(merge, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, spans {SPANS}, items array<string>")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return scanned.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents without the words of any window; documents with more than max_coverage of their words hit go.

    All columns are kept; n_chars, where there is one, is counted anew for texts
    that changed. With several shards of items the spans of all are found on the
    input texts; one last map merges them, cuts once and applies max_coverage
    once, so the result doesn't depend on the shards.
    """
    X.prepare(docs.sparkSession)
    first, *more = item_shards(items, item_id, item_text, shard_words)
    names, schema, (key, shared) = docs.columns, docs.schema, first
    at = names.index(text_col)
    if more:
        k, hits = X.fresh(docs, "_k", "_hits")
        found = _hits(docs, text_col, more, window).select(F.col("k").alias(k), F.flatten("hits.spans").alias(hits))
        docs = docs.withColumn(k, F.md5(F.col(text_col).cast("binary"))).join(broadcast_if(found), k, "left").select(*(F.col(f"`{c}`") for c in [*names, hits]))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column, keep, changed = b.column(at), np.ones(b.num_rows, bool), {}
            others = b.column(len(names)).to_pylist() if more else [None] * b.num_rows
            for r, (n, spans, _, starts, ends) in enumerate(_matcher(f"{key} {window}", shared, window).texts(column)):
                if others[r]:
                    spans = merged([*spans, *((x["first"], x["last"]) for x in others[r])])
                if not spans:
                    continue
                if sum(y - x + 1 for x, y in spans) > max_coverage * n:
                    keep[r] = False
                    continue
                text = column[r].as_py().encode()
                if starts is None:  # hit by other shards only
                    starts, ends, _ = X.split(np.frombuffer(text, np.uint8), np.array([0, len(text)]), X.FOLDED)
                changed[r] = _cut(text, spans, starts, ends).decode()
            columns = list(b.columns[: len(names)])
            if changed:
                columns[at] = pa.array([changed.get(r, v) for r, v in enumerate(column.to_pylist())], column.type)
                if "n_chars" in names:
                    c = names.index("n_chars")
                    columns[c] = pa.array([len(changed[r]) if r in changed else v for r, v in enumerate(columns[c].to_pylist())], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)

"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' three-word grams are hashed and winnowed (of three in a row the
smallest is kept, so any five equal words share a fingerprint) into an inverted
index of (template, position). A document's winnowed grams are looked up; hits
of a template near one diagonal are a candidate. The candidate's words are
aligned with the template in a band around the diagonal (longest common
subsequence), and what covers enough of the template is reported with its
coverage and its span of words.

Defined cases: null and empty texts have no matches; each place where a template
matches is a row, also where several templates cover one place (their coverages
tell them apart); of equally good alignments the one that ends first is reported;
rows that repeat are scanned each; a very long text is scanned whole, in memory of
some 50 times its bytes; an empty table gives no row; other columns, whatever
their names, are not read; a template of fewer than three words is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as X
from .license_texts import TEMPLATES

_U = np.uint64
GRAM, WINNOW = 3, 3


def winnowed(grams: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions of the smallest gram of each WINNOW valid ones in a row, and of any shorter run's smallest."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    top = ~_U(0)
    g = np.where(valid, grams, top)
    wide = np.concatenate([g, np.full(WINNOW - 1, top)])
    low = np.minimum.reduce([wide[k : k + n] for k in range(WINNOW)])
    keep = np.zeros(n, bool)
    for k in range(WINNOW):  # the window that starts k before
        keep[k:] |= g[k:] == low[: n - k]
    return np.flatnonzero(keep & valid)


class Index:
    def __init__(self, templates: dict[str, str]) -> None:
        self.names, self.words = list(templates), []
        hashes, owner, position = [], [], []
        for k, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = X.split(data, np.array([0, len(data)]), X.FOLDED)
            words = X.folded_hashes(data, starts, ends)
            if len(words) < GRAM:
                raise ValueError(f"template {self.names[k]!r} has fewer than {GRAM} words")
            grams = X.gram_hashes(words, GRAM)
            at = winnowed(grams, np.ones(len(grams), bool))
            self.words.append(words)
            hashes.append(grams[at])
            owner.append(np.full(len(at), k))
            position.append(at)
        self.prints = np.array([len(h) for h in hashes])
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hashes = np.concatenate(hashes)[order]
        self.owner, self.position = np.concatenate(owner)[order], np.concatenate(position)[order]

    def matches(self, column: pa.Array, least_prints: float, least_coverage: float):
        """(row, template, matched, first word, last word) of each match."""
        for r0, data, offsets in X.chunks(column):
            starts, ends, bounds = X.split(data, offsets, X.FOLDED)
            words = X.folded_hashes(data, starts, ends)
            grams = X.gram_hashes(words, GRAM)
            rows = X.row_of(bounds)[: len(grams)]
            at = winnowed(grams, np.arange(len(grams)) + GRAM <= bounds[1:][rows] if len(grams) else np.zeros(0, bool))
            a, b = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
            hit = np.flatnonzero(b > a)
            if not len(hit):
                continue
            many = (b - a)[hit]
            entry = np.repeat(a[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place = np.repeat(at[hit], many)
            row, template = rows[place], self.owner[entry]
            diagonal = place - self.position[entry]
            order = np.lexsort((place, diagonal, template, row))
            row, template, diagonal, place = row[order], template[order], diagonal[order], place[order]
            band = np.maximum(4, np.array([len(w) for w in self.words]) // 8)
            cut = np.ones(len(row) + 1, bool)
            cut[1:-1] = (row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > band[template[1:]])
            edges = np.flatnonzero(cut)
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                t, r = int(template[x]), int(row[x])
                if len(np.unique(place[x:y])) < max(1, least_prints * self.prints[t]):
                    continue
                for start in self._starts(diagonal[x:y], int(band[t])):
                    got = self._align(words, t, start, int(band[t]), int(bounds[r]), int(bounds[r + 1]))
                    if got and got[0] >= least_coverage * len(self.words[t]):
                        yield r0 + r, t, got[0], got[1] - int(bounds[r]), got[2] - int(bounds[r])

    @staticmethod
    def _starts(diagonals: np.ndarray, band: int):
        """One start for diagonals within the band of each other."""
        at = 0
        while at < len(diagonals):
            to = int(np.searchsorted(diagonals, diagonals[at] + 2 * band, side="right"))
            yield int(np.median(diagonals[at:to]))
            at = to

    def _align(self, words, t, start, band, low, high):
        """Matched words, first and last matched position, of the best alignment in the band.

        Row i holds the best counts up to the template's i-th word, for the 2 * band + 1
        words around the diagonal only: column k is the word at start + i + k - band.
        """
        template, width = self.words[t], 2 * band + 1
        n = len(template)
        text = np.zeros(n + 2 * band, _U)  # the words from start - band on; those outside the document match nothing
        inside = np.zeros(len(text), bool)
        a, b = max(low, start - band), min(high, start - band + len(text))
        if a >= b:
            return None
        text[a - (start - band) : b - (start - band)] = words[a:b]
        inside[a - (start - band) : b - (start - band)] = True
        best = np.zeros((n + 1, width + 1), np.int32)  # the last column is never a cell
        for i, w in enumerate(template):
            equal = (text[i : i + width] == w) & inside[i : i + width]
            # best[i] at k: up to the word before column k of row i + 1; at k + 1: with that word
            np.maximum.accumulate(np.maximum(best[i, :-1] + equal, best[i, 1:]), out=best[i + 1, :-1])
        i, k, first, last = n, width - 1, None, None
        while i and best[i, k]:
            if k and best[i, k] == best[i, k - 1]:
                k -= 1
            elif best[i, k] == best[i - 1, k + 1]:
                i, k = i - 1, k + 1
            else:
                i -= 1
                first = start + i + k - band
                last = first if last is None else last
        return (int(best[n, width - 1]), first, last) if last is not None else None


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least_prints: float = 0.3, least_coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, n_matched, first_word, last_word): a row for each match; one map over the documents, no shuffle."""
    X.prepare(docs.sparkSession)
    templates = dict(TEMPLATES if templates is None else templates)
    Index(templates)  # refuses bad templates here

    def run(batches):
        index = Index(templates)
        for b in batches:
            found = list(index.matches(b.column(1), least_prints, least_coverage))
            if found:
                row, t, n, first, last = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array([index.names[k] for k in t]), pa.array([x / len(index.words[k]) for x, k in zip(n, t, strict=True)]), *(pa.array(v, pa.int64()) for v in (n, first, last))], names=["doc_id", "license", "coverage", "n_matched", "first_word", "last_word"]
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, license string, coverage double, n_matched long, first_word long, last_word long")

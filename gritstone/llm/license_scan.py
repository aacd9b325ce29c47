"""Licence scans: Dice coefficients of word bigrams against licence templates.

Texts and templates are normalised alike: letters in lower case, punctuation as white space. A passage is a run of whole
sentences (they end at line feeds, and at ``. ! ?`` before white space) or a single one, and a template is found where
``2 * shared / (a + b)`` of the two sets of bigrams reaches ``LEAST``. That bounds the passage's size by the template's,
``a * LEAST / (2 - LEAST) <= b <= a * (2 - LEAST) / LEAST``, and asks for ``LEAST * a / (2 - LEAST)`` shared bigrams
within that size; passages that lack too many are dropped before any set is compared. Of overlapping findings the one with the
larger Dice coefficient stays, then the one with more words, then the earlier, then the first template by name.

One scan without a shuffle; whole texts. Defined results: null and empty texts hold nothing; a null id is kept; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.license_texts import TEMPLATES
from gritstone.llm.storage import ship
from gritstone.llm.words import Words, gram_hash, slices, trimmed, words_of

LEAST = 0.85


def sentence_starts(words: Words) -> np.ndarray:
    """Whether each word begins a sentence."""
    raw = words.raw
    mark = raw == 10
    if len(raw) > 1:
        mark[:-1] |= np.isin(raw[:-1], [33, 46, 63]) & np.isin(raw[1:], [9, 10, 11, 12, 13, 32])
    before = np.concatenate([[0], np.cumsum(mark)])[words.starts] if len(words.starts) else np.zeros(0, np.int64)
    out = np.ones(len(before), bool)
    out[1:] = before[1:] != before[:-1]
    out[words.first[:-1][words.counts() > 0]] = True
    return out


class Templates:
    """The templates' bigram sets, and bounds on what can match them."""

    def __init__(self, texts: dict[str, str], least: float = LEAST):
        self.names, self.least = list(texts), least
        words = words_of(pa.array(list(texts.values())), plain=True)
        gram, ok = gram_hash(words, 2)
        self.sets = [frozenset(gram[a:z][ok[a:z]].tolist()) for a, z in zip(words.first, words.first[1:])]
        self.known = np.array(sorted(set().union(*self.sets)), np.uint64)
        self.has = np.array([np.isin(self.known, np.array(sorted(s), np.uint64)) for s in self.sets])
        size = np.array([len(s) for s in self.sets])
        self.shared = np.maximum(np.ceil(size * least / (2 - least) - 1e-9), 1).astype(int)
        self.most = np.floor(size * (2 - least) / least + 1e-9).astype(int)
        self.span = 2 * self.most + 2  # what is looked at first; passages that repeat bigrams may be longer

    def levels(self, words: Words) -> Iterator[tuple[int, int, float, int, np.ndarray]]:
        """(document, template, dice, first word, numbers of words): passages of one beginning whose sets are the same.

        A passage that matches lacks at most ``most - size`` of its bigrams in the template, so a document's first
        occurrences of others bound how far one reaches, and few beginnings have enough shared bigrams within that.
        Only those are looked at, up to where they hold too many others.
        """
        gram, ok = gram_hash(words, 2)
        if not len(gram):
            return
        place = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        known = ok & (self.known[place] == gram)
        if not known.any():
            return
        begins, before = np.flatnonzero(sentence_starts(words)), np.concatenate([[0], np.cumsum(known)])
        for d in np.flatnonzero(before[words.first[1:]] > before[words.first[:-1]]).tolist():
            low, high = int(words.first[d]), int(words.first[d + 1])
            mine, at = gram[low : high - 1], place[low : high - 1]  # no bigram begins at the last word
            hits, seen = known[low : high - 1], np.unique(at[known[low : high - 1]])
            likely = np.flatnonzero(self.has[:, seen].sum(axis=1) >= self.shared)
            if not len(likely):
                continue
            starts = begins[np.searchsorted(begins, low) : np.searchsorted(begins, high)] - low
            ends = np.append(starts[1:], high - low)
            order = np.argsort(mine, kind="stable")
            last = np.full(len(mine), -1)  # where the same bigram was before
            again = mine[order[1:]] == mine[order[:-1]]
            last[order[1:][again]] = order[:-1][again]
            for t in likely.tolist():
                match = hits & self.has[t][at]
                others, shared = (np.concatenate([[0], np.cumsum(x)]) for x in (~match & (last < 0), match))
                spare = int(self.most[t]) - len(self.sets[t])
                begin = starts[starts < len(mine)]
                reach = np.searchsorted(others, others[begin] + spare, side="right") - 1
                for s in np.flatnonzero(shared[reach] - shared[begin] >= self.shared[t]).tolist():
                    yield from ((d, t, *x) for x in self._from(int(begin[s]), ends[s:], last, match, t, spare))

    def _from(self, low: int, ends: np.ndarray, last: np.ndarray, match: np.ndarray, t: int, spare: int) -> Iterator[tuple[float, int, np.ndarray]]:
        """(dice, first word, numbers of words) of the passages from ``low`` to any of ``ends`` that match."""
        width = int(self.span[t])
        while True:  # as far as the passage holds at most ``spare`` bigrams that the template lacks
            fresh = low + np.flatnonzero(last[low : low + width] < low)
            lacks = np.cumsum(~match[fresh])
            if low + width >= len(last) or lacks[-1] > spare:
                break
            width *= 2
        stop = fresh[np.searchsorted(lacks, spare, side="right")] if lacks[-1] > spare else len(last)
        ends = ends[: np.searchsorted(ends, stop + 1, side="right")]
        run = np.searchsorted(fresh, ends - 1)
        both = np.concatenate([[0], np.cumsum(match[fresh])])[run]
        dice = 2 * both / (run + len(self.sets[t]))
        good = np.flatnonzero((dice >= self.least) & (run > 0))
        if len(good):
            for part in np.split(good, np.flatnonzero(np.diff(run[good])) + 1):
                yield float(dice[part[0]]), low, ends[part] - low

    def find(self, words: Words) -> list[tuple[int, int, float, int, int]]:
        """(document, template, dice, first word, number of words), words counted in the document."""
        return [(d, t, dice, low, n) for d, t, dice, low, many in self.levels(words) for n in many.tolist()]

    def best(self, words: Words) -> dict[int, list[tuple[str, float, int, int]]]:
        """For each document that holds any: (name, dice, first word, number of words), by first word, not overlapping."""
        out: dict[int, list] = {}
        # the longest of each level stands for it; a shorter one is its turn only where that overlaps one that stays
        heap = [(d, -dice, -int(many[-1]), low, self.names[t], i, many) for i, (d, t, dice, low, many) in enumerate(self.levels(words))]
        heapify(heap)
        while heap:
            d, dice, n, low, name, i, many = heappop(heap)
            have = out.setdefault(d, [])  # by first word
            at = bisect_right(have, low, key=lambda x: x[2])
            if at and have[at - 1][2] + have[at - 1][3] > low:
                continue
            room = have[at][2] - low if at < len(have) else -n
            if -n <= room:
                have.insert(at, (name, -dice, low, -n))
            elif fit := int(np.searchsorted(many, room, side="right")):
                heappush(heap, (d, dice, -int(many[fit - 1]), low, name, i, many[:fit]))
        return out


MATCH = "array<struct<license:string,dice:double,first_word:bigint,n_words:bigint>>"


def scan_licenses(docs: DataFrame, texts: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licenses): for every row, the licence passages of its text."""
    ship(docs.sparkSession)
    templates = Templates(texts, least)
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = templates.best(words_of(batch.column("text"), plain=True))
                rows = [[dict(zip(("license", "dice", "first_word", "n_words"), x)) for x in found.get(d, [])] for d in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], [id_col, "licenses"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"{id_col} bigint, licenses {MATCH}")


def digest(docs: DataFrame) -> DataFrame:
    told = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], F.format_string("%.4f", x["dice"]), x["first_word"].cast("string"), x["n_words"].cast("string")))
    return scan_licenses(docs).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"), F.array_join(told, ",").alias("spans"))

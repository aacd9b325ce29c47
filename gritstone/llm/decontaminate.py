"""Benchmark decontamination by latent semantic retrieval.

1. Statistics. Texts are lower-cased, punctuation is dropped, and they are cut into blocks of ``BLOCK`` words. Words hash to ``TERMS`` terms; one pass counts in how many
   blocks each term occurs (its inverse document frequency weighs it), a second multiplies the blocks' weighted matrix A
   into a random sign sketch: G = A'(A S). Both sums are made per slice, exchanged by term range and added up, so the
   driver receives one TERMS x RANK matrix whatever the corpus.
2. Randomised SVD. G is the range of A'A; its Nystrom core gives A's leading right singular vectors and values, and
   folding in (weights times vectors over values) takes any words into the latent space.
3. Candidates. A third pass folds in every block and every pair of neighbouring blocks, and takes those whose cosine
   with a benchmark item is at least ``COSINE``; items that share too few distinct words with the passage are dropped.
   Foreign words in a block dilute a short item, so blocks with enough of an item's rare words are candidates whatever
   their cosine: of words that fill more places of the item than the checks let go, some must be in any copy. So every
   stretch no longer than its item that passes the checks is found.
4. Checks. The longest common subsequence of the item with the passage and its surroundings must hold ``SHARE`` of the
   item's words, and half of its last words, the answer. Single words replaced, dropped or added leave enough.

Items of under ``LEAST_WORDS`` words are too short for a paraphrase to tell: they are found by their exact sequence of
words. Items are broadcast ``ITEMS`` at a time: more items take more passes. No document leaves its task. Defined
results: null or empty texts hold nothing and null or empty items are found nowhere; a null id is kept; repeated rows give repeated results; items with equal texts are each
reported; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.storage import ship
from gritstone.llm.words import Words, gram_hash, mix, slices, trimmed, words_of

TERMS = 8192
RANK = 96
BLOCK = 16
COSINE = 0.45
SHARE = 0.7
LEAST_WORDS = 8
ITEMS = 1024
SLOTS = 64


def sketch_matrix() -> tuple[np.ndarray, np.ndarray]:
    """For each term, its column and sign in the random sketch."""
    x = mix(np.arange(1, TERMS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((x >> np.uint64(8)) % np.uint64(RANK)).astype(np.int64), np.where(x & np.uint64(1), 1.0, -1.0).astype(np.float32)


class Blocks:
    """The blocks of a slice: their words' terms, and the first word and document of each."""

    def __init__(self, words: Words):
        self.words, self.terms = words, (words.hashes % np.uint64(TERMS)).astype(np.int64)
        counts = words.counts()
        per_doc = -(-counts // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(counts)), per_doc)
        self.start = words.first[self.doc] + (np.arange(len(self.doc)) - self.first_block[self.doc]) * BLOCK
        self.of_word = np.repeat(np.arange(len(self.doc)), np.diff(np.append(self.start, len(words.hashes))))

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """Each block's sum of its terms' rows of ``weights``."""
        out, n = np.zeros((len(self.doc), weights.shape[1]), np.float32), len(self.terms)
        for at in range(0, len(self.doc), 2048):
            begin = self.start[at : at + 2048]
            end = self.start[at + 2048] if at + 2048 < len(self.doc) else n
            out[at : at + 2048] = np.add.reduceat(weights[self.terms[begin[0] : end]], begin - begin[0], axis=0)
        return out


def _plain_words(batch: pa.RecordBatch) -> Words:
    return words_of(batch.column("text"), plain=True)


def _slots(matrix: np.ndarray) -> pa.RecordBatch:
    rows = np.ascontiguousarray(matrix.reshape(SLOTS, -1))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["slot", "part"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(TERMS), 0
    for whole in batches:
        for batch in slices(whole, "text"):
            b = Blocks(_plain_words(batch))
            pairs = (b.of_word * TERMS + b.terms).astype(np.int32 if len(b.doc) * TERMS < 1 << 31 else np.int64)
            pairs.sort()
            total += np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] % TERMS if len(pairs) else [], minlength=TERMS)
            n += len(b.doc)
    if n:
        yield _slots(np.column_stack([total, np.full(TERMS, n)]))


def _range(idf: np.ndarray):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, sign = sketch_matrix()
        total, n = np.zeros((TERMS, RANK)), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                b = Blocks(_plain_words(batch))
                if not len(b.doc):
                    continue
                n += len(b.doc)
                y = np.bincount(b.of_word * RANK + column[b.terms], weights=(idf * sign)[b.terms], minlength=len(b.doc) * RANK).reshape(-1, RANK).astype(np.float32)
                order = np.argsort(b.terms.astype(np.uint16), kind="stable")
                terms = b.terms[order]
                begin = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
                for at in range(0, len(begin), 512):
                    low = begin[at]
                    high = begin[at + 512] if at + 512 < len(begin) else len(terms)
                    total[terms[begin[at : at + 512]]] += np.add.reduceat(y[b.of_word[order[low:high]]], begin[at : at + 512] - low, axis=0)
        if n:
            yield _slots(total)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, part in zip(batch.column("slot").to_pylist(), batch.column("part")):
            values = np.frombuffer(part.as_buffer(), np.float64)
            sums[slot] = sums[slot] + values if slot in sums else values.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["slot", "part"])


def _total(parts: DataFrame, width: int) -> np.ndarray | None:
    """The sum of all slices' matrices: added up by slot on the executors, SLOTS rows to the driver."""
    rows = parts.repartition(SLOTS, "slot").mapInArrow(_added, "slot int, part binary").collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(rows, key=lambda r: r["slot"])]).reshape(TERMS, width)


def latent_space(texts: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """TERMS x RANK float32: what a word of each term adds to a passage's latent vector; and the terms' inverse document
    frequencies. None for a corpus without words."""
    counted = _total(texts.mapInArrow(_frequencies, "slot int, part binary"), 2)
    if counted is None:
        return None
    idf = np.log((counted[0, 1] + 1) / (counted[:, 0] + 1)) + 1e-3
    g = _total(texts.mapInArrow(_range(idf), "slot int, part binary"), RANK) * idf[:, None]
    column, sign = sketch_matrix()
    omega = np.zeros((TERMS, RANK))
    omega[np.arange(TERMS), column] = sign
    core = omega.T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, values.max() * 1e-10 + 1e-30)
    u, s, _ = np.linalg.svd(g @ vectors / np.sqrt(values), full_matrices=False)
    s = np.maximum(s, s.max() * 1e-6 + 1e-30)
    return (idf[:, None] * u / s).astype(np.float32), idf


def longest_common(a: list[int], b: list[int]) -> tuple[int, set[int]]:
    """Length of the longest common subsequence, bit-parallel, and the positions of ``a`` whose words occur in ``b``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row, met = every, 0
    for y in b:
        hit = where.get(y, 0)
        if hit:
            met |= hit
            with_ = row & hit
            row = (row + with_ | row - with_) & every
    return len(a) - row.bit_count(), {i for i in range(len(a)) if met >> i & 1}


def holds(item: list[int], region: list[int]) -> int:
    """The common length if the region holds the item, by LCS and answer checks; else 0."""
    common, met = longest_common(item, region)
    answer = max(2, min(8, len(item) // 3))
    enough = sum(i >= len(item) - answer for i in met) * 2 >= answer
    return common if common >= SHARE * len(item) and (enough or common >= 0.9 * len(item)) else 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def rare_words(items: list[np.ndarray], idf: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, item, least): the places in ``known`` of each item's rarest words, ordered by item, and how many occurrences
    of them any passage holds that has ``SHARE`` of the item's words in common with it."""
    word, item, least = [], [], []
    for k, i in enumerate(items):
        distinct, times = np.unique(i, return_counts=True)
        order = np.argsort(-idf[(distinct % np.uint64(TERMS)).astype(np.int64)], kind="stable")
        may_lack = len(i) - int(np.ceil(SHARE * len(i)))
        places = np.cumsum(times[order])
        taken = 1 + int(np.searchsorted(places, may_lack + -(-len(i) // 5)))
        word.append(np.searchsorted(known, distinct[order[:taken]]))
        item.append(np.full(taken, k))
        least.append(places[taken - 1] - may_lack)
    return np.concatenate(word), np.concatenate(item), np.array(least)


def stretches(word: np.ndarray, doc: np.ndarray, rare: tuple[np.ndarray, np.ndarray, np.ndarray], size: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(position, item): where stretches of about an item's length begin that hold enough of its rare words."""
    rare_word, rare_item, least = rare
    order = np.argsort(word, kind="stable")
    begin = np.searchsorted(word[order], rare_word)
    count = np.searchsorted(word[order], rare_word, side="right") - begin
    turn = (np.cumsum(count) // most)[np.searchsorted(rare_item, rare_item, side="right") - 1]  # items by their hits
    out_at, out_item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for now in np.unique(turn[count > 0]):
        some = np.flatnonzero((turn == now) & (count > 0))
        times = count[some]
        at = order[np.repeat(begin[some] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        item = np.repeat(rare_item[some], times)
        by = np.lexsort((at, item))
        at, item = at[by], item[by]
        last = np.arange(len(at)) + least[item] - 1
        inside = np.minimum(last, len(at) - 1)
        ok = (last < len(at)) & (item[inside] == item) & (doc[at[inside]] == doc[at]) & (at[inside] - at < size[item] + BLOCK)
        out_at.append(at[ok])
        out_item.append(item[ok])
    return np.concatenate(out_at), np.concatenate(out_item)


def verbatim(words: Words, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) of the short items that documents hold word for word."""
    doc, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in sorted({len(i) for i in items}):
        mine = [k for k, i in enumerate(items) if len(i) == n]
        asked = gram_hash(Words(words.data, words.starts, words.ends, np.arange(len(mine) + 1) * n, np.concatenate([items[k] for k in mine]), words.raw), n)[0][::n]
        gram, ok = gram_hash(words, n)
        order = np.argsort(asked, kind="stable")
        at = np.flatnonzero(ok & np.isin(gram, asked))
        low, many = np.searchsorted(asked[order], gram[at], "left"), np.searchsorted(asked[order], gram[at], "right")
        many -= low
        which = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        doc.append(np.searchsorted(words.first, np.repeat(at, many), side="right") - 1)
        item.append(np.array(mine)[which])
    return np.concatenate(doc), np.concatenate(item)


def _search(space: tuple[np.ndarray, np.ndarray], ids: list, items: list[np.ndarray], clean: bool = False):
    """Third pass: documents' leaks of some items, or with ``clean`` the rows of documents without any."""
    weights, idf = space
    size = np.array([len(i) for i in items])
    every, short = (items, size), np.flatnonzero(size < LEAST_WORDS)
    long = np.flatnonzero(size >= LEAST_WORDS)
    items, size = [items[k] for k in long], size[long]
    lists = [i.tolist() for i in items]
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))
    has = np.zeros((len(items), len(known) + 1), bool)
    for k, i in enumerate(items):
        has[k, np.searchsorted(known, i)] = True
    need = np.ceil(0.35 * np.minimum([len(np.unique(i)) for i in items], 2 * BLOCK)).astype(int)
    rare = rare_words(items, idf, known) if items else None
    asked = _unit(np.array([weights[(i % np.uint64(TERMS)).astype(np.int64)].sum(axis=0) for i in items])) if items else None

    def passages(b: Blocks, n: int) -> dict[tuple[int, int], tuple[int, float]]:
        """For each document and item that it holds by LCS and answer checks: the common words and the cosine."""
        single = b.fold(weights)
        pair = single.copy()
        joined = np.append(b.doc[1:] == b.doc[:-1], False)
        pair[joined] += single[1:][joined[:-1]]
        near = np.maximum(_unit(single) @ asked.T, _unit(pair) @ asked.T)
        block, item = np.nonzero(near >= COSINE)
        place = np.minimum(np.searchsorted(known, b.words.hashes), len(known) - 1)
        word = np.append(np.where(known[place] == b.words.hashes, place, len(known)), len(known))
        keep = np.zeros(len(block), bool)
        for at in range(0, len(block), 1 << 15):
            some = slice(at, at + (1 << 15))
            span = b.start[block[some]][:, None] + np.arange(2 * BLOCK)
            span = word[np.where(span < b.words.first[b.doc[block[some]] + 1][:, None], span, n)]
            span.sort(axis=1)
            span[:, 1:][span[:, 1:] == span[:, :-1]] = len(known)
            keep[some] = has[item[some][:, None], span].sum(axis=1) >= need[item[some]]
        at, of = stretches(word[:-1], b.doc[b.of_word], rare, size)
        both = np.unique(np.concatenate([block[keep] * len(items) + item[keep], b.of_word[at] * len(items) + of]))
        block, item = both // len(items), both % len(items)
        best: dict[tuple[int, int], tuple[int, float]] = {}
        for x, k in zip(block.tolist(), item.tolist()):
            d = int(b.doc[x])
            old = best.get((d, k), (0, 0.0))
            if old[0] == size[k]:
                continue
            low = max(int(b.words.first[d]), int(b.start[x]) - int(size[k]))
            high = min(int(b.words.first[d + 1]), int(b.start[x]) + 2 * BLOCK + int(size[k]))
            common = holds(lists[k], b.words.hashes[low:high].tolist())
            if common:
                best[d, k] = max(old, (common, float(near[x, k])))
        return best

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                b = Blocks(_plain_words(batch))
                n = len(b.terms)
                if not n:
                    if clean:
                        yield batch.drop_columns("text")
                    continue
                best = {(d, int(long[k])): x for (d, k), x in (passages(b, n) if items else {}).items()}
                if len(short):
                    best |= {(int(d), int(short[k])): (int(every[1][short[k]]), 1.0) for d, k in zip(*verbatim(b.words, [every[0][k] for k in short]))}
                if clean:
                    stay = np.ones(batch.num_rows, bool)
                    stay[[d for d, _ in best]] = False
                    yield batch.filter(pa.array(stay)).drop_columns("text")
                elif best:
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array([d for d, _ in keys])),
                            pa.array([ids[k] for _, k in keys], pa.int64()),
                            pa.array([int(every[1][k]) for _, k in keys], pa.int64()),
                            pa.array([best[x][0] for x in keys], pa.int64()),
                            pa.array([best[x][1] for x in keys], pa.float64()),
                        ],
                        ["doc_id", "item_id", "item_words", "common_words", "cosine"],
                    )

    return run


FOUND = "doc_id bigint, item_id bigint, item_words bigint, common_words bigint, cosine double"


def _item_blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, words) of the items, ``ITEMS`` or so at a time."""
    asked = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).filter("text IS NOT NULL")
    blocks = -(-asked.count() // ITEMS)
    for part in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == part).collect()
        words = words_of(pa.array([r["text"] for r in rows], pa.string()), plain=True)
        items = [(r["item_id"], words.hashes[a:z]) for r, a, z in zip(rows, words.first, words.first[1:]) if z > a]
        if items:
            yield [k for k, _ in items], [i for _, i in items]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, common_words, cosine): one row for each item that a document holds."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    out, space = spark.createDataFrame([], FOUND), None
    for ids, items in _item_blocks(benchmark):
        space = latent_space(source) if space is None else space
        if space is None:
            break
        out = out.unionAll(source.mapInArrow(_search(space, ids, items), FOUND))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns as they are."""
    ship(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    out, space = docs.toDF(*names), None
    text = names[docs.columns.index(text_col)]
    for ids, items in _item_blocks(benchmark):
        space = latent_space(docs.select(docs[text_col].alias("text"))) if space is None else space
        if space is None:
            break
        out = out.withColumn("text", F.col(text)).mapInArrow(_search(space, ids, items, clean=True), out.schema)
    return out.toDF(*docs.columns)

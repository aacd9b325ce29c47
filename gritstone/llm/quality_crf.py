"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of kinds of characters, word lengths, repeats and the like, in
``BINS`` quantile bins; its emission adds one weight for each feature of the line, of the line before and of the line
after it, and the chain adds transition weights. Labels are known for documents only, so in training a line takes its
document's label, and the field's conditional likelihood is maximised by Adam on the exact gradient (forward-backward).
A document's score is the length-weighted mean of its lines' marginals of "good", put through a logistic curve fitted
on the training documents.

Training uses a bounded sample: labelled documents by the hash of their ids, of ``TRAIN_DOCS`` of these each one that
still fits into ``TRAIN_LINES`` lines and ``TRAIN_BYTES`` bytes, whatever its own length; only sizes are looked at before
texts travel. Every whole text is scored, in one scan without a shuffle. Inputs of a score are the characters of the text
alone.

Defined results: a null text is an empty one, and an empty text is one empty line, scored like any other; lines end at
line feeds; rows that repeat get equal scores; without any label, or with labels of one kind only, the score is the
share of good labels (0.5 if there is none); of rows that repeat an id and a text one is learned from; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gritstone.llm.storage import ship
from gritstone.llm.words import slices, trimmed, words_of

TRAIN_DOCS = 2500
TRAIN_LINES = 60_000
TRAIN_BYTES = 16 << 20
BINS = 8
SLICE = 1 << 20
FEATURES = ("log_length", "letters", "capitals", "digits", "symbols", "bars", "stops", "spaces", "word_length", "distinct", "repeats", "ends", "twin_before", "twin_after", "edge_marks")


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_small, _capital, _digit = _kind("abcdefghijklmnopqrstuvwxyz"), _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789")
_lead = np.arange(256) >= 0xC0
_char = (np.arange(256) < 0x80) | _lead
_space, _stop, _bar = _kind(" \t\r\v\f"), _kind(".,;:'\"-()?"), _kind("|")
_symbol = ~(_small | _capital | _digit | _space | _stop | _bar) & (np.arange(256) < 0x80)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, line lengths in bytes, first line of each document and the end): one row of values for each line."""
    words = words_of(texts)
    data = words.data
    sizes = np.asarray(pc.binary_length(texts.fill_null(""))).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    breaks = np.flatnonzero(data == 10)
    owner_first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))  # a document has one line more than breaks
    starts = np.empty(len(breaks) + len(sizes), np.int64)
    ends = np.empty_like(starts)
    is_first = np.zeros(len(starts), bool)
    is_first[owner_first[:-1]] = True
    starts[is_first], starts[~is_first] = offsets[:-1], breaks + 1
    is_last = np.zeros(len(starts), bool)
    is_last[owner_first[1:] - 1] = True
    ends[is_last], ends[~is_last] = offsets[1:], breaks

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=total[1:])
        return (total[ends] - total[starts]).astype(np.float64)

    chars = share(_char)
    least = np.maximum(chars, 1)
    capitals, letters = share(_capital), share(_small | _lead)
    letters += capitals
    w0, w1 = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    count = (w1 - w0).astype(np.float64)
    many = np.maximum(count, 1)
    line_of = np.repeat(np.arange(len(starts)), w1 - w0)
    inside = words.hashes
    order = np.argsort(inside)
    order = order[np.argsort(line_of[order], kind="stable")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (inside[order][1:] != inside[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order], weights=fresh, minlength=len(starts))
    again = np.zeros(len(inside))
    again[1:] = (inside[1:] == inside[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of, weights=again, minlength=len(starts))
    sums = np.zeros(len(inside) + 1, np.uint64)
    np.cumsum(inside, out=sums[1:])
    key = sums[w1] - sums[w0]
    twin = (key[1:] == key[:-1]) & (count[1:] > 0) & ~is_first[1:] if len(key) else np.zeros(0, bool)
    tail = np.zeros(256, bool)
    tail[[ord(c) for c in "!#$%&*|"]] = True
    marks = np.bincount(line_of, weights=tail[data[words.ends - 1]] if len(words.ends) else None, minlength=len(starts)) if len(line_of) else np.zeros(len(starts))
    last = np.where(ends > starts, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    values = np.column_stack(
        [
            np.log1p(chars),
            letters / least,
            capitals / np.maximum(letters, 1),
            share(_digit) / least,
            share(_symbol) / least,
            share(_bar) / least,
            share(_stop) / least,
            share(_space) / least,
            (chars - share(_space)) / many,
            distinct / np.sqrt(many),
            repeats / many,
            np.isin(last, [46, 63, 34]),
            np.append(False, twin),
            np.append(twin, False),
            marks / many,
        ]
    )
    return values, (ends - starts).astype(np.float64), owner_first


def _line_features_by_parts(texts: list[str | None], most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of many texts, about ``most`` bytes at a time: the driver holds lines, not bytes."""
    made = [line_features(b.column("text")) for b in slices(pa.record_batch({"text": pa.array(texts, pa.string())}), "text", most)]
    starts = np.cumsum([0, *[len(v) for v, _, _ in made]])
    first = np.concatenate([*[f[:-1] + at for (_, _, f), at in zip(made, starts)], starts[-1:]])
    return np.concatenate([v for v, _, _ in made]), np.concatenate([n for _, n, _ in made]), first


@dataclass
class Field:
    """The fitted field. weights: [place (own, before, after), feature, bin]; a document's edge has bin BINS."""

    cuts: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    edges: np.ndarray
    curve: tuple[float, float]
    share: float
    fitted: bool = True


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, values.T)]) if len(values) else np.zeros((0, len(cuts)), np.int64)


def _places(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[line, place, feature]: the bins of a line and its neighbours."""
    before, after = np.empty_like(bins), np.empty_like(bins)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[first[:-1]], after[first[1:] - 1] = BINS, BINS
    return np.stack([bins, before, after], axis=1).astype(np.uint8)


def _emissions(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places))
    for p in range(3):
        for f in range(places.shape[2]):
            out += weights[p, f][places[:, p, f]]
    return out


def _by_step(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Documents by falling number of lines, so that step t concerns the first n_t of them."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(length.max() if len(length) else 0), side="left")
    return order, length[order], active.tolist()


def forward_backward(good: np.ndarray, first: np.ndarray, moves: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals [line, state], pairs [line, state before, state]) of chains with emission ``good`` for state 1."""
    n = len(good)
    order, length, active = _by_step(first)
    begin = first[:-1][order]
    emit = np.column_stack([np.zeros(n), good])
    emit = np.exp(emit - emit.max(axis=1, keepdims=True))
    move, edge = np.exp(moves - moves.max()), np.exp(edges - edges.max())
    ahead, behind = np.zeros((n, 2)), np.ones((n, 2))
    for t, m in enumerate(active):
        at = begin[:m] + t
        now = emit[at] * (edge if t == 0 else ahead[at - 1] @ move)
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        now = (emit[at + 1] * behind[at + 1]) @ move.T
        behind[at] = now / now.sum(axis=1, keepdims=True)
    both = ahead * behind
    both /= both.sum(axis=1, keepdims=True)
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((n, 2, 2))
    if len(at):
        pairs[at] = ahead[at - 1][:, :, None] * move[None] * (emit[at] * behind[at])[:, None, :]
        pairs[at] /= pairs[at].sum(axis=(1, 2), keepdims=True)
    return both, pairs


def document_means(marginals: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted means of lines' marginals; lines of no length count only where a document has no other."""
    total = np.add.reduceat(lengths, first[:-1]) if len(first) > 1 else np.zeros(0)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    weight = np.where(total[owner] > 0, lengths, 1.0)
    return np.bincount(owner, weights=weight * marginals, minlength=len(total)) / np.maximum(np.bincount(owner, weights=weight, minlength=len(total)), 1e-12)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str | None], labels: list[int], rounds: int = 120, rate: float = 0.15, keep: float = 1e-3) -> Field:
    """Train on whole documents with labels 0 or 1."""
    share = float(np.mean(labels)) if labels else 0.5
    width = len(FEATURES)
    none = Field(np.zeros((width, BINS - 1)), np.zeros((3, width, BINS + 1)), np.zeros((2, 2)), np.zeros(2), (1.0, 0.0), share, False)
    if len(set(labels)) < 2:
        return none
    values, lengths, first = _line_features_by_parts(texts)
    y = np.asarray(labels)
    line_y = np.repeat(y, np.diff(first))
    cuts = np.array([np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1]) + 1e-12 for v in values.T])
    for i, v in enumerate(values.T):  # features that are mostly one value: the rest of the values decides
        rest = v[v != np.median(v)]
        if len(np.unique(cuts[i])) < BINS // 2 and len(rest):
            cuts[i] = np.sort(np.concatenate([[np.median(v) - 1e-12, np.median(v) + 1e-12], np.quantile(rest, np.linspace(0, 1, BINS - 1)[1:-1])]))[: BINS - 1]
    places = _places(binned(values, cuts), first)
    size = 3 * width * (BINS + 1)

    def totals(weight: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(places[:, p, f], weights=weight, minlength=BINS + 1) for p in range(3) for f in range(width)])

    wanted = totals((line_y == 1).astype(float))
    inner = np.ones(len(line_y), bool)
    inner[first[:-1]] = False
    wanted_moves = np.array([[((line_y == a) & (line_y == b))[inner].sum() for b in (0, 1)] for a in (0, 1)], float)
    wanted_edges = np.bincount(line_y[first[:-1]], minlength=2).astype(float)
    theta = np.zeros(size + 4 + 2)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(line_y)
    for step in range(1, rounds + 1):
        weights, moves, edges = theta[:size].reshape(3, width, BINS + 1), theta[size : size + 4].reshape(2, 2), theta[-2:]
        both, pairs = forward_backward(_emissions(places, weights), first, moves, edges)
        seen = totals(both[:, 1])
        slope = np.concatenate([wanted - seen, (wanted_moves - pairs.sum(axis=0)).ravel(), wanted_edges - both[first[:-1]].sum(axis=0)]) / n - keep * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights, moves, edges = theta[:size].reshape(3, width, BINS + 1), theta[size : size + 4].reshape(2, 2), theta[-2:]
    both, _ = forward_backward(_emissions(places, weights), first, moves, edges)
    x = _logit(document_means(both[:, 1], lengths, first))
    x = np.clip(x, -12, 12)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve, slightly regularised
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        slope = np.array([((y - p) * x).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
        bend = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(bend, slope)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return Field(cuts, weights, moves, edges, (max(a, 0.05), b), share)


def score_texts(field: Field, texts: pa.Array) -> np.ndarray:
    """The score of each text."""
    if not field.fitted:
        return np.full(len(texts), field.share)
    values, lengths, first = line_features(texts)
    good = _emissions(_places(binned(values, field.cuts), first), field.weights)
    both, _ = forward_backward(good, first, field.moves, field.edges)
    x = np.clip(_logit(document_means(both[:, 1], lengths, first)), -12, 12)
    return _sigmoid(field.curve[0] * x + field.curve[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES, most_bytes: int = TRAIN_BYTES) -> list[tuple[str, int]]:
    """The (text, label) pairs that the field learns from, in the order of the hashes of their ids."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.octet_length("text").alias("bytes"))
    sized = sized.join(known, "doc_id").dropDuplicates(["doc_id", "text_key"])
    rows = sized.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(most_docs).collect()  # numbers only
    chosen, lines, size = {}, 0, 0
    for r in rows:
        if lines + r["lines"] <= most_lines and size + r["bytes"] <= most_bytes:
            chosen[r["doc_id"], r["text_key"]] = (len(chosen), r["label"])
            lines, size = lines + r["lines"], size + r["bytes"]
    if not chosen:
        return []
    keys = docs.sparkSession.createDataFrame([(d, k) for d, k in chosen], "doc_id bigint, text_key bigint")
    texts = docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "text_key"])
    found = {(r["doc_id"], r["text_key"]): r["text"] for r in texts.dropDuplicates(["doc_id", "text_key"]).collect()}  # at most most_bytes
    return [(found[k], label) for k, (_, label) in sorted(chosen.items(), key=lambda x: x[1][0])]


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES, most_bytes: int = TRAIN_BYTES) -> Field:
    """Fit on a bounded sample of labelled documents that are not held out."""
    rows = sample(docs, labels, most_docs, most_lines, most_bytes)
    return fit([t for t, _ in rows], [y for _, y in rows])


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) and the carried columns, for every row."""
    ship(docs.sparkSession)
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text"), *[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(carry)])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                scores = pa.array(score_texts(field, batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    schema = StructType([*source.schema.fields, StructField("score", DoubleType())])
    out = source.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), "score", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def keep_good(docs: DataFrame, field: Field, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, all columns as they are."""
    ship(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                yield batch.filter(pa.array(score_texts(field, batch.column(text)) >= least))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Removal of long repeated word spans by de Bruijn compaction.

The edges of the graph are the corpus's runs of ``window`` words (20); an edge's key is 64 bits: 24 of the hash of its
least ``k``-gram (its minimiser, leftmost on ties) and 40 of the hash of its words.

1. Edges. Each slice of text is cut into pieces, runs of edges with one minimiser, which say what precedes and follows
   them; pieces are exchanged by minimiser, so equal edges meet. Edges that occur once go. An edge's source is its
   smallest (document id, start); an edge has a sole neighbour where all its occurrences are preceded (followed) alike.
   Edges of a piece that are each other's sole neighbours, as often as each other, fuse to a fragment.
   A minimiser that is too common (``HOT``) is not exchanged so: its edges are Spark rows, counted with map-side
   aggregates, and joined with their counts; the most frequent of these by a broadcast of bounded size.
2. Compaction. Fragments join the fragments that follow them at their document's coordinates; where both ends are each
   other's sole neighbours they are one nonbranching path. A path occurs as a whole wherever it occurs.
3. Verification. Path occurrences join the texts, and each is read at its source coordinates: the SHA-256 of its words
   (64 bits of it, beside the 64 of the key) must be the same for all occurrences. If hashes made different words one edge, the paths concerned are taken apart,
   and their windows compare by SHA-256 one by one. So equal keys alone never remove a word.
4. The words that late windows cover are removed.

Defined results: a null text has no words; texts shorter than the window keep all words; a null ``doc_id`` counts as
the largest; rows that repeat an id *and* text get equal results, as neither starts earlier than the other; rows that
share an id but not the text are parts of the same document by start. An empty table gives an empty result; columns
besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.packed import blocks, by_bucket, ragged, schema_of
from gritstone.llm.storage import bucket_count, discard, materialize, release, ship
from gritstone.llm.words import Words, gram_hash, mix, slices, trimmed, words_of

WINDOW = 20
ANCHOR = 8
NO_ID = np.iinfo(np.int64).max
#: Occurrences of minimisers in one of 2**20 cells from which the cell's edges are Spark rows: at least this many, and
#: four times the mean of a cell. A bucket so holds no more than that of any minimiser.
HOT = 1 << 18
CELLS = 20
#: An edge among those that occurs more often joins its count by broadcast; there are at most 1/HEAVY of the rows of them.
HEAVY = 1 << 14
PIECES = {"anchor": np.dtype("u4"), "doc": np.dtype("i8"), "mark": np.dtype("i8"), "at": np.dtype("i4"), "n": np.dtype("u1"), "before": np.dtype("u4"), "after": np.dtype("u4"), "edges": np.dtype("u1")}
FRAGMENTS = "doc bigint, mark bigint, at int, n int, key bigint, many bigint, late boolean, open_left boolean, open_right boolean"
EDGES = "doc bigint, mark bigint, at int, key bigint, before bigint, after bigint"


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the position of the leftmost least of values[i:i+width]; only for i + width <= len(values)."""
    least, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = least[:-step], least[step:]
        left = a <= b
        least, at, have = np.where(left, a, b), np.where(left, at[:-step], at[step:]), have + step
    return at


def keys_of(anchor: np.ndarray, edge: np.ndarray, bits: int = 40) -> np.ndarray:
    """24 bits of the minimiser's hash and 40 of the words'; fewer ``bits`` put different words under one key, as tests do."""
    return (anchor << np.uint64(40)) | (edge & np.uint64((1 << bits) - 1))


def pieces_of(words: Words, bits: int = 40, window: int = WINDOW, k: int = ANCHOR) -> dict[str, np.ndarray]:
    """The pieces of a slice: minimiser, first edge (word index), number of edges, and for each edge its key."""
    edge, is_edge = gram_hash(words, window)
    gram, _ = gram_hash(words, k)
    starts = np.flatnonzero(is_edge)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return {"anchor": none, "first": starts, "n": starts, "key": none, "begins": starts, "before": none, "after": none}
    least = leftmost_least(gram, window - k + 1)[starts]
    follows = np.append(False, starts[1:] == starts[:-1] + 1)
    new = ~follows
    new[1:] |= least[1:] != least[:-1]
    begins = np.flatnonzero(new)
    anchor = gram[least] >> np.uint64(40)
    key = keys_of(anchor, edge[starts], bits)
    near = mix(key) & np.uint64(0xFFFFFFFF) | np.uint64(1)  # 0 is the end of a document
    before = np.where(follows, np.append(np.uint64(0), near[:-1]), np.uint64(0))
    after = np.append(np.where(follows[1:], near[1:], np.uint64(0)), np.uint64(0))
    return {"anchor": anchor[begins], "first": starts[begins], "n": np.diff(np.append(begins, len(starts))), "key": key, "begins": begins, "before": before, "after": after}


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(int(NO_ID)))


def _inner(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def crowded(least: int):
    """How often the minimisers of each cell occur, and all of them together (cell -1); cells met under ``least`` times in a
    task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                total += np.bincount((pieces_of(words_of(batch.column("text")))["anchor"] >> np.uint64(24 - CELLS)).astype(np.int64), minlength=1 << CELLS)
        cells = np.flatnonzero(total >= least)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, cells)), pa.array(np.append(total.sum(), total[cells]))], ["cell", "n"])

    return run


def hot_cells(source: DataFrame, least: int = HOT) -> np.ndarray:
    """Cells of minimisers that are too common for one bucket: at most a quarter of all, most often none."""
    counts = source.mapInArrow(crowded(max(1, least >> 12)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "cells")
    total = counts.filter("cell = -1").first()
    most = max(least, 4 * (total["n"] if total else 0) >> CELLS)
    hot = np.array(sorted(r["cell"] for r in counts.filter((F.col("cell") >= 0) & (F.col("n") >= most)).collect()), np.int64)
    discard(counts)
    return hot


def _is_hot(anchor: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.isin((anchor >> np.uint64(24 - CELLS)).astype(np.int64), hot)


def cut(n_buckets: int, hot: np.ndarray, bits: int = 40):
    """Producer: the pieces of each slice by minimiser, but for those of hot cells."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(batch.column("text"))
                p = pieces_of(words, bits)
                keep = np.flatnonzero(~_is_hot(p["anchor"], hot))
                if not len(keep):
                    continue
                first, n, begins = p["first"][keep], p["n"][keep], p["begins"][keep]
                owner = np.searchsorted(words.first, first, side="right") - 1
                ends = begins + n - 1
                five = p["key"][np.repeat(begins, n) + _inner(n)].view(np.uint8).reshape(-1, 8)[:, :5]
                bucket = (mix(p["anchor"][keep]) % np.uint64(n_buckets)).astype(np.int64)
                told = {
                    "anchor": p["anchor"][keep].astype(np.uint32),
                    "doc": ids_of(batch.column("id"))[owner],
                    "mark": np.asarray(batch.column("mark"))[owner],
                    "at": (first - words.first[owner]).astype(np.int32),
                    "n": n.astype(np.uint8),
                    "before": p["before"][begins].astype(np.uint32),
                    "after": p["after"][ends].astype(np.uint32),
                }
                out = blocks(bucket, told)
                yield pa.RecordBatch.from_arrays([*out.columns, ragged(bucket, n, five)], ["bucket", *PIECES])

    return run


def hot_edges(hot: np.ndarray, bits: int = 40):
    """The edges of hot cells as rows."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(batch.column("text"))
                p = pieces_of(words, bits)
                keep = np.flatnonzero(_is_hot(p["anchor"], hot))
                if not len(keep):
                    continue
                n = p["n"][keep]
                inner = _inner(n)
                edge, first = np.repeat(p["begins"][keep], n) + inner, np.repeat(p["first"][keep], n) + inner
                owner = np.searchsorted(words.first, first, side="right") - 1
                columns = [ids_of(batch.column("id"))[owner], np.asarray(batch.column("mark"))[owner], (first - words.first[owner]).astype(np.int32), p["key"][edge].view(np.int64), p["before"][edge].astype(np.int64), p["after"][edge].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "mark", "at", "key", "before", "after"])

    return run


def fragments_of(x: dict[str, np.ndarray]) -> list[np.ndarray] | None:
    """The repeated edges of one bucket, fused inside their pieces; the columns of ``FRAGMENTS``."""
    _, which, often = np.unique(x["anchor"], return_inverse=True, return_counts=True)
    n = x["n"].astype(np.int64)
    begin = np.cumsum(n) - n
    piece = np.flatnonzero(often[which] > 1)
    if not len(piece):
        return None
    n = n[piece]
    inner, of = _inner(n), np.repeat(piece, n)
    wide = np.zeros((len(of), 8), np.uint8)
    wide[:, :5] = x["edges"].reshape(-1, 5)[begin[of] + inner]
    key = keys_of(x["anchor"][of].astype(np.uint64), wide.view(np.uint64).ravel())
    doc, at = x["doc"][of], x["at"][of] + inner.astype(np.int32)
    near = (mix(key) & np.uint64(0xFFFFFFFF) | np.uint64(1)).astype(np.uint32)
    starts, ends = inner == 0, np.append(inner[1:] == 0, True)
    before = np.where(starts, x["before"][of], np.append(np.uint32(0), near[:-1]))
    after = np.where(ends, x["after"][of], np.append(near[1:], np.uint32(0)))
    order = np.lexsort((at, doc, key))
    lead = np.append(True, key[order][1:] != key[order][:-1])
    heads = np.flatnonzero(lead)
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(lead) - 1
    many = np.diff(np.append(heads, len(key)))[group]
    source = order[heads][group]
    sole = lambda v: (np.minimum.reduceat(v[order], heads) == np.maximum.reduceat(v[order], heads))[group] & (v > 0)
    left, right = sole(before), sole(after)
    late = (doc != doc[source]) | (at != at[source])
    repeated = many > 1
    fused = np.zeros(len(key), bool)
    fused[1:] = ~starts[1:] & repeated[1:] & right[:-1] & left[1:] & (many[1:] == many[:-1]) & (late[1:] == late[:-1])
    keep = np.flatnonzero(repeated)
    if not len(keep):
        return None
    first = np.flatnonzero(~fused[keep])
    a = keep[first]
    size = np.diff(np.append(first, len(keep)))
    return [doc[a], x["mark"][of][a], at[a], size.astype(np.int32), key[a].view(np.int64), many[a], late[a], left[a], right[a + size - 1]]


@trimmed
def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consumer of pieces: the fragments of each bucket."""
    names = [c.split()[0] for c in FRAGMENTS.split(", ")]
    for _, x in by_bucket(batches, PIECES):
        if (found := fragments_of(x)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)


def _hot_fragments(edges: DataFrame) -> DataFrame:
    """The repeated ones of ``edges``, each a fragment of its own. Counts are map-side aggregates; no task holds an edge's rows."""
    edges = materialize(edges, "hot-edges")
    sole = lambda c: (F.min(c) == F.max(c)) & (F.min(c) > 0)
    told = edges.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("doc", "at")).alias("source"), sole("before").alias("open_left"), sole("after").alias("open_right"))
    told = materialize(told.filter("many > 1"), "hot-counts")
    heavy = told.filter(F.col("many") > HEAVY)
    both = edges.join(F.broadcast(heavy), "key").unionByName(edges.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(told.filter(F.col("many") <= HEAVY), "key"))
    return both.select("doc", "mark", "at", F.lit(1).alias("n"), "key", "many", (F.struct("doc", "at") != F.col("source")).alias("late"), "open_left", "open_right")


def paths(fragments: DataFrame) -> DataFrame:
    """(doc, mark, paths): each document's path occurrences (at, n, key, late), by start; n is a number of edges."""
    place = Window.partitionBy("doc", "mark").orderBy("at")
    last = F.lag(F.struct("at", "n", "many", "late", "open_right")).over(place)
    joined = (last["at"] + last["n"] == F.col("at")) & last["open_right"] & F.col("open_left") & (last["many"] == F.col("many")) & (last["late"] == F.col("late"))
    marked = fragments.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("path", F.sum("new").over(place))
    each = numbered.groupBy("doc", "mark", "path").agg(F.min(F.struct("at", "key", "late")).alias("head"), F.sum("n").cast("int").alias("n"))
    return each.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("head.at", "n", "head.key", "head.late"))).alias("paths"))


CHECKS = "array<struct<key:bigint,digest:bigint>>"
KEPT = "id bigint, mark bigint, n_words bigint, n_removed bigint, kept_text string"


def _digest(told: bytes) -> int:
    return int.from_bytes(hashlib.sha256(told).digest()[:8], "little", signed=True)


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[dict]]]:
    """(row, words, paths) of a batch."""
    paths = batch.column("paths").to_pylist()
    for d, text in enumerate(batch.column("text").to_pylist()):
        yield d, (text or "").encode().split(), paths[d] or []


@trimmed
def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their paths: the kept words, and a digest of the words of each path."""
    check = pa.list_(pa.struct([("key", pa.int64()), ("digest", pa.int64())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            counts, gone, kept, checks = [], [], [], []
            for _, words, found in _each(batch):
                counts.append(len(words))
                if found:
                    stay = np.ones(len(words), bool)
                    for p in found:
                        if p["late"]:
                            stay[p["at"] : p["at"] + p["n"] + WINDOW - 1] = False
                    gone.append(len(words) - int(stay.sum()))
                    checks.append([{"key": p["key"], "digest": _digest(b" ".join(words[p["at"] : p["at"] + p["n"] + WINDOW - 1]))} for p in found if p["key"] is not None])
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    gone.append(0)
                    checks.append([])
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(checks, check)], ["id", "mark", "n_words", "n_removed", "kept_text", "checks"])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the paths that are in doubt, with the SHA-256 of its words."""
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = ([], [], [], [])
            ids, marks = batch.column("doc").to_pylist(), batch.column("mark").to_pylist()
            for d, words, found in _each(batch):
                for p in found:
                    if p["doubt"]:
                        for at in range(p["at"], p["at"] + p["n"]):
                            for column, value in zip(rows, (ids[d], marks[d], at, hashlib.sha256(b" ".join(words[at : at + WINDOW])).digest())):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], ["doc", "mark", "at", "digest"])


def _resolved(source: DataFrame, found: DataFrame, clashes: DataFrame) -> DataFrame:
    """The paths of documents that hold a clash, with those paths replaced by their late windows, told apart by their words."""
    each = found.select("doc", "mark", F.explode("paths").alias("p")).join(clashes.withColumn("doubt", F.lit(True)), F.col("p.key") == F.col("clash"), "left").drop("clash")
    docs = each.filter("doubt").select("doc", "mark").distinct()
    each = each.join(docs, ["doc", "mark"]).select("doc", "mark", F.struct("p.*", F.coalesce("doubt", F.lit(False)).alias("doubt")).alias("p"))
    texts = source.withColumn("doc", F.coalesce("id", F.lit(int(NO_ID)))).join(docs, ["doc", "mark"]).dropDuplicates(["doc", "mark"])
    told = texts.join(each.groupBy("doc", "mark").agg(F.collect_list("p").alias("paths")), ["doc", "mark"]).select("doc", "mark", "text", "paths")
    told = materialize(told.mapInArrow(windows, "doc bigint, mark bigint, at int, digest binary"), "windows")
    first = told.groupBy("digest").agg(F.min(F.struct("doc", "at")).alias("source"))
    late = told.join(first, "digest").filter(F.struct("doc", "at") != F.col("source"))
    kind = "struct<at:int,n:int,key:bigint,late:boolean>"
    taken = late.select("doc", "mark", F.struct("at", F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("key"), F.lit(True).alias("late")).cast(kind).alias("p"))
    sure = each.filter("NOT p.doubt").select("doc", "mark", F.struct("p.at", "p.n", "p.key", "p.late").cast(kind).alias("p"))
    none = docs.select("doc", "mark", F.lit(None).cast(kind).alias("p"))
    return taken.unionAll(sure).unionAll(none).groupBy("doc", "mark").agg(F.collect_list("p").alias("paths"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 40, hot_least: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): texts without the words of runs that start earlier elsewhere."""
    spark = docs.sparkSession
    ship(spark)
    n = bucket_count(docs, per_partition=8)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    # a hash of the text tells rows of one id apart; where no id repeats it need not travel
    repeated = not source.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    source = source.withColumn("mark", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    hot = hot_cells(source, hot_least)
    pieces = source.mapInArrow(cut(n, hot, bits), schema_of(PIECES)).repartition(max(n // 8, 1), "bucket").sortWithinPartitions("bucket")
    fragments = pieces.mapInArrow(glue, FRAGMENTS)
    if len(hot):
        fragments = fragments.unionByName(_hot_fragments(source.mapInArrow(hot_edges(hot, bits), EDGES)).select(*[c.split()[0] for c in FRAGMENTS.split(", ")]))
    fragments = materialize(fragments, "fragments")
    del pieces
    release(spark)
    # rows that repeat an id and a text have the same fragments twice
    found = paths(fragments.dropDuplicates(["doc", "mark", "at"]) if repeated else fragments)
    found = materialize(found, "paths")
    release(spark)
    place = lambda df: df.withColumn("doc", F.coalesce("id", F.lit(int(NO_ID))))
    kept = materialize(place(source).join(found, ["doc", "mark"], "left").select("id", "mark", "text", "paths").mapInArrow(remove, f"{KEPT}, checks {CHECKS}"), "kept")
    each = kept.select(F.explode("checks").alias("c")).groupBy("c.key").agg(F.min("c.digest").alias("low"), F.max("c.digest").alias("high"))
    clashes = materialize(each.filter("low <> high").select(F.col("key").alias("clash")), "clashes")
    out = kept
    if not clashes.isEmpty():
        resolved = materialize(_resolved(source, found, clashes), "resolved")
        touched = place(kept).join(resolved.select("doc", "mark"), ["doc", "mark"], "left_anti").select("id", "n_words", "n_removed", "kept_text")
        again = place(source).join(resolved, ["doc", "mark"]).select("id", "mark", "text", F.filter("paths", lambda p: p.isNotNull()).alias("paths"))
        out = touched.unionAll(again.mapInArrow(remove, f"{KEPT}, checks {CHECKS}").select("id", "n_words", "n_removed", "kept_text"))
    discard(fragments, found)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_text")


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
edges AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS s
  FROM docs),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM edges),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM ranked WHERE k > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM docs),
kept AS (
  SELECT words.doc_id, count(covered.q) AS gone, string_agg(x, ' ' ORDER BY words.q) FILTER (WHERE covered.q IS NULL) AS t
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id AND covered.q = words.q GROUP BY words.doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id
"""

"""Exact n-gram Jaccard self-join by parity sketches.

A document is the set of its distinct five-word shingles, lower-cased (A-Z). Equal sets form one class. Two classes of
sizes a <= b link when 100 * intersection >= 80 * union, so that they differ in at most (a + b) / 9 shingles.

1. Sketch. Per size band [L, 2L), shingle hashes are dealt by hash to P parts and XORed there; a shingle of just one of
   two sets changes one part only, so the number of unequal parts never exceeds the symmetric difference. A second
   sketch of single bits, about two or three to a shingle, has the same property for the Hamming distance.
2. Pigeonhole. With at most D differences, D + 1 filled parts hold an equal one: each class sends its first D + 1
   filled parts in its own band, and in the band below if a set of that band can be small enough. A class with fewer
   filled parts also sends its empty ones.
3. Candidates share a part. Groups of at most ``SMALL`` classes give all their pairs; larger ones a star around the
   least, and their members are kept aside. Sizes and bit sketches are tested before any text moves.
4. Verification compares whole sets: members travel to their star's centre, at most ``FAN`` of them to one task.
5. Components by large and small stars. In large groups that still hold several components, each member outside the
   one that is largest at first asks its nearest members of other components, by bit sketches; pairs that the Hamming
   bound lets through are verified, and the components are found again. A member asks in its smallest large group first,
   then each round in 16 times as many and for eightfold as many members; it goes on, whatever its
   component has become, until it has asked in each of its groups all that the bound allows, or the group is one component. So no link
   is lost, and no group of copies emits its pairs. Each class carries the classes it was compared with, and of two that
   ask in one group only one asks the other, so a pair does not come up again in a later round. A group is dealt to tasks in blocks of ``ASKERS`` asking members
   against ``ASKED`` members; a task holds the former and streams the latter.

Sets are told apart by 64-bit hashes of their shingles. A class is named by the hash of its set, never by an id, so null
and repeated ids do no harm. Defined results: null and wordless texts have no shingles and link with nothing; texts of
one to four words are one shingle; a null ``doc_id`` counts as the largest and stays null; rows that repeat an id are
linked by their own texts, and a component's id is the smallest id of its rows; every input row gives one row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.components import components
from gritstone.llm.packed import blocks, by_bucket, ragged, schema_of
from gritstone.llm.storage import bucket_count, discard, few, materialize, release, ship, small
from gritstone.llm.substring_dedup import NO_ID, ids_of
from gritstone.llm.words import WORD_BASE, Words, gram_hash, mix, run_hash, slices, trimmed, words_of

SHINGLE = 5
SMALL = 3
FAN = 256
#: Asking members and asked ones of a block of a large group.
ASKERS, ASKED = 1024, 1 << 16
#: Words of 64 bits in a bit sketch, for sets of fewer shingles than the bound; a sketch folds to any smaller one.
SKETCH_WORDS = (*((40 << i, 1 << i) for i in range(10)), (1 << 62, 1024))
ENTRIES = {"sig": np.dtype("i8"), "key": np.dtype("i8")}
#: doc_n is negative where the id is null.
MEMBERS = {"doc": np.dtype("i8"), "doc_key": np.dtype("i8"), "doc_n": np.dtype("i4"), "text_key": np.dtype("i8"), "sketch": np.dtype("u8")}


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, size): the distinct shingles of each document of a slice, ordered by owner and hash."""
    gram, ok = gram_hash(words, k)
    counts = words.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = mix(run_hash(words.hashes, WORD_BASE, words.first[short], words.first[short + 1]) + counts[short].astype(np.uint64)) if len(short) else np.zeros(0, np.uint64)
    owner, value = np.concatenate([owner[ok], short]), np.concatenate([gram[ok], whole])
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(counts) < 65536 else owner[order], kind="stable")]
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return owner, value, np.bincount(owner, minlength=len(counts))


def set_keys(owner: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each whole set, as a signed long."""
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    end = np.cumsum(size)
    return mix(sums[end] - sums[end - size] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def most_apart(a: np.ndarray | int, b: np.ndarray | int):
    """The largest symmetric difference of two linked sets of sizes a and b."""
    return (a + b) // 9


def band(size: np.ndarray) -> np.ndarray:
    """i for sizes in [2**i, 2**(i+1))."""
    return np.frexp(size.astype(np.float64))[1] - 1


def parts_of(i: np.ndarray) -> np.ndarray:
    """How many parts band i has: one more than its largest difference, and some for parts that are empty."""
    top = (np.int64(2) << i) - 1
    least = most_apart(top, top * 5 // 4) + 1
    return least + least // 25 + 3


def signatures(owner: np.ndarray, value: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of the parts that the chosen documents send."""
    out_owner, out_sig = [], []
    own = band(np.maximum(size, 1))
    edge = np.int64(1) << own  # the least size of the own band
    for lower in (False, True):
        take = chosen & (size >= 4) & (((size * 4 + 4) // 5 <= edge - 1) if lower else True)
        who = np.flatnonzero(take)
        if not len(who):
            continue
        scheme = own[who] - lower
        parts = parts_of(scheme)
        apart = most_apart(edge[who] - 1, size[who]) if lower else most_apart(size[who], size[who] * 5 // 4)
        base = np.cumsum(parts) - parts
        slot = np.full(len(size), -1)
        slot[who] = np.arange(len(who))
        mine = slot[owner]
        tokens, mine = value[mine >= 0], mine[mine >= 0]
        dealt = mix(tokens ^ (scheme[mine].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        cell = base[mine] + ((dealt >> np.uint64(32)) * parts[mine].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = int(parts.sum())
        xor = np.zeros(total, np.uint64)
        np.bitwise_xor.at(xor, cell, tokens)
        filled = np.bincount(cell, minlength=total) > 0
        cell_owner = np.repeat(np.arange(len(who)), parts)
        rank = np.cumsum(filled)
        rank -= np.repeat(rank[base] - filled[base], parts)
        lacking = rank[base + parts - 1] < apart + 1
        send = (filled & (rank <= np.repeat(apart + 1, parts))) | (~filled & lacking[cell_owner])
        at = np.flatnonzero(send)
        place = (scheme[cell_owner[at]].astype(np.uint64) << np.uint64(40)) + (at - base[cell_owner[at]]).astype(np.uint64)
        out_sig.append(mix(xor[at] ^ mix(place * np.uint64(2) + filled[at].astype(np.uint64))))
        out_owner.append(who[cell_owner[at]])
    if not out_sig:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_owner), np.concatenate(out_sig)


def sketch_words(size: np.ndarray) -> np.ndarray:
    return np.array([w for _, w in SKETCH_WORDS])[np.searchsorted([bound for bound, _ in SKETCH_WORDS], size, side="right")]


def bit_sketches(owner: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parity bits of each set: ``sketch_words`` words for each document, one after the other."""
    bits = 64 * sketch_words(size)
    begin = np.cumsum(bits) - bits
    spot = (mix(value ^ np.uint64(0x2545F4914F6CDD1D)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(begin[owner] + spot, minlength=int(bits.sum())) & 1).astype(np.uint8)).view(np.uint64)


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of the width of the smallest: a set's parity modulo a power of two follows from any larger one."""
    sizes = np.array([len(s) for s in sketches]) // 8
    out = np.zeros((len(sketches), sizes.min()), np.uint64)
    for w in np.unique(sizes):
        rows = np.flatnonzero(sizes == w)
        whole = np.frombuffer(b"".join([sketches[i] for i in rows]), np.uint64).reshape(len(rows), -1, out.shape[1])
        out[rows] = np.bitwise_xor.reduce(whole, axis=1)
    return out


def sketch(n_buckets: int):
    """Producer: signatures and members of each slice; equal sets of a slice send signatures once."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                owner, value, size = shingle_sets(words_of(batch.column("text"), lower=True))
                if not len(value):
                    continue
                ids, keys = ids_of(batch.column("id")), set_keys(owner, value, size)
                have = np.flatnonzero(size)
                first = np.zeros(len(size), bool)
                first[have[np.unique(keys[have], return_index=True)[1]]] = True
                who, sig = signatures(owner, value, size, first)
                if len(sig):
                    out = blocks(((sig >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64), {"sig": sig, "key": keys[who]})
                    yield pa.RecordBatch.from_arrays([*out.columns, *[pa.nulls(out.num_rows, pa.binary())] * len(MEMBERS)], ["bucket", *ENTRIES, *MEMBERS])
                named = np.where(np.asarray(batch.column("id").is_null()), -1, 1)
                told = {"doc": ids[have], "doc_key": keys[have], "doc_n": (size * named)[have].astype(np.int32), "text_key": np.asarray(batch.column("text_key"))[have]}
                bucket = ((keys[have].view(np.uint64) >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
                rank = np.cumsum(size > 0) - 1
                sketches = ragged(bucket, sketch_words(size[have]), bit_sketches(rank[owner], value, size[have]))
                out = blocks(bucket, told)
                yield pa.RecordBatch.from_arrays([out.column(0), *[pa.nulls(out.num_rows, pa.binary())] * len(ENTRIES), *out.columns[1:], sketches], ["bucket", *ENTRIES, *MEMBERS])

    return run


FOUND = "kind int, x bigint, y bigint, n int, z bigint, sketch binary"


def _found(kind: int, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, z: np.ndarray | None = None, sk: np.ndarray | None = None) -> pa.RecordBatch:
    count = len(x)
    told = pa.nulls(count, pa.binary())
    if sk is not None:
        ends = np.concatenate([[0], np.cumsum(sketch_words(np.abs(n)))]) * 8
        told = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(sk).tobytes())])
    size = pa.nulls(count, pa.int32()) if n is None else pa.array(n.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.full(count, kind, np.int32)), pa.array(x), pa.array(y), size, pa.nulls(count, pa.int64()) if z is None else pa.array(z), told], ["kind", "x", "y", "n", "z", "sketch"])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consumer: kind 0 candidate pairs of classes, kind 1 members (id, class, size, text), kind 2 (part, class, members) of large groups."""
    for _, x in by_bucket(batches, ENTRIES | MEMBERS):
        if len(x["doc"]):
            yield _found(1, x["doc"], x["doc_key"], x["doc_n"], x["text_key"], x["sketch"])
        if not len(x["sig"]):
            continue
        order = np.lexsort((x["key"], x["sig"]))
        sig, key = x["sig"][order], x["key"][order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[new], key[new]
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(np.append(begin, len(sig)))
        pairs = []
        for gap in range(1, SMALL):  # all pairs of small groups, by distance in the group
            ok = np.flatnonzero((count > gap) & (count <= SMALL))
            for shift in range(SMALL - gap):
                at = begin[ok[count[ok] > shift + gap]] + shift
                pairs.append(np.column_stack([key[at], key[at + gap]]))
        large = np.repeat(count > SMALL, count)
        lead = np.repeat(key[begin], count)
        star = large & (key != lead)
        pairs.append(np.column_stack([lead[star], key[star]]))
        both = np.unique(np.concatenate(pairs), axis=0)
        if len(both):
            yield _found(0, both[:, 0], both[:, 1])
        if large.any():
            yield _found(2, sig[large], key[large], np.repeat(count, count)[large])


def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs whose Hamming distance leaves a link possible."""
    for batch in batches:
        a, b = (np.asarray(batch.column(c)).astype(np.int64) for c in ("na", "nb"))
        one, two = (batch.column(c).to_pylist() for c in ("sa", "sb"))
        apart, least = np.zeros(len(a), np.int64), np.minimum(sketch_words(a), sketch_words(b))
        for w in np.unique(least):
            rows = np.flatnonzero(least == w)
            both = folded([one[i] for i in rows] + [two[i] for i in rows])
            apart[rows] = np.bitwise_count(both[: len(rows)] ^ both[len(rows) :]).sum(axis=1)
        out = batch.filter(pa.array(apart <= most_apart(a, b)))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], ["a", "b"])


ACROSS = "a bigint, b bigint, more boolean"


class Block:
    """Some members of a large group: their classes, components, sizes, sketches and compared classes, and which of them ask."""

    def __init__(self, rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        self.key, self.part, self.n = (np.asarray(t.column(c)).astype(np.int64) for c in ("key", "component", "n"))
        self.bits = folded(t.column("sketch").to_pylist())
        self.own = np.asarray(t.column("own"))
        known = t.column("known").combine_chunks()
        self.owner, self.known = np.asarray(pc.list_parent_indices(known)), np.asarray(pc.list_flatten(known))

    def compared(self, other: Block) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (member here, member there) of which the former carries the latter."""
        order = np.argsort(other.key)
        at = order[np.minimum(np.searchsorted(other.key, self.known, sorter=order), len(order) - 1)]
        hit = other.key[at] == self.known
        return self.owner[hit], at[hit]

    def width(self, w: int) -> np.ndarray:
        return np.bitwise_xor.reduce(self.bits.reshape(len(self.bits), -1, w), axis=1)


def _likely(p: Block, q: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, Hamming distance) of the pairs of different components, not compared yet, that sizes and sketches let through.

    Of two that ask, the one that asks the other follows from their hashes; what it leaves, it goes on asking itself.
    A part of a sketch bounds the distance like the whole, so most pairs go after the first quarter of its words.
    """
    w = min(p.bits.shape[1], q.bits.shape[1])
    one, two, first = p.width(w), q.width(w), w // 4
    small, large = np.minimum(p.n[:, None], q.n[None, :]), np.maximum(p.n[:, None], q.n[None, :])
    bound = most_apart(small, large)
    ok = (p.part[:, None] != q.part[None, :]) & (small * 5 >= large * 4)
    a, b = p.key[:, None], q.key[None, :]
    ok &= ~q.own[None, :] | (((a ^ b) & 1 == 0) == (a < b))
    ok[p.compared(q)] = False
    ok[q.compared(p)[::-1]] = False
    near = np.zeros(ok.shape, np.uint16)
    for k in range(first):
        near += np.bitwise_count(one[:, k][:, None] ^ two[:, k][None, :])
    i, j = np.nonzero(ok & (near <= bound))
    far = near[i, j].astype(np.int64) + np.bitwise_count(one[i, first:] ^ two[j, first:]).sum(axis=1)
    keep = far <= bound[i, j]
    return i[keep], j[keep], far[keep]


def across(width: int):
    """Blocks of large groups, ordered by (sig, ask, of) with the asking members first: for each of these up to ``width``
    members of other components, nearest by sketch, whose sketches leave a link possible. A row (sig, a, true) says that
    a has more in that block."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asking = None, [], None
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        told, left = [], []

        def nearest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """What was found so far for the asking members, the nearest ``width`` and one more of each."""
            i, far, key = (np.concatenate(x) for x in zip(*best))
            order = np.lexsort((key, far, i))
            i, far, key = i[order], far[order], key[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) <= width
            return i[keep], far[keep], key[keep]

        def end() -> None:
            if best:
                i, _, key = nearest()
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                more = asking.key[i[rank == width]]
                left.append(np.column_stack([np.full(len(more), now[0]), more]))
                i, key = asking.key[i[rank < width]], key[rank < width]
                told.append(np.column_stack([np.minimum(i, key), np.maximum(i, key)]))
                best.clear()

        for batch in batches:
            keys = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("sig", "ask", "of", "asks")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if (at := tuple(keys[a, :3])) != now:
                    end()
                    now, held, asking = at, [], None
                part = batch.slice(a, z - a)
                if keys[a, 3]:
                    held.append(part)
                    continue
                if held:
                    asking, held = Block(held), []
                if asking is not None:
                    other = Block([part])
                    i, j, far = _likely(asking, other)
                    if len(i):
                        best.append((i, far, other.key[j]))
                    if sum(len(x[0]) for x in best) > 8 * ASKERS * (width + 1):
                        best[:] = [nearest()]
        end()
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *told]), axis=0)
        both = np.concatenate([pairs, *left])
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) >= len(pairs))], ["a", "b", "more"])

    return run


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts ordered by (centre, fan), the centre's first: the links between centre and members, by whole sets."""
    now, centre = None, None
    for whole in batches:
        for batch in slices(whole, "text"):
            owner, value, size = shingle_sets(words_of(batch.column("text"), lower=True))
            keys, end = set_keys(owner, value, size), np.cumsum(size)
            want = np.asarray(batch.column("key"))
            at = list(zip(batch.column("centre").to_pylist(), batch.column("fan").to_pylist()))
            u, v = [], []
            for i, group in enumerate(at):
                if group != now:
                    now, centre = group, None
                if keys[i] != want[i]:
                    continue  # another text with the same id and text hash
                mine = value[end[i] - size[i] : end[i]]
                if want[i] == group[0]:
                    centre = mine
                elif centre is not None and len(mine):
                    spot = np.minimum(np.searchsorted(centre, mine), len(centre) - 1)
                    shared = int((centre[spot] == mine).sum())
                    if 100 * shared >= 80 * (len(centre) + len(mine) - shared):
                        u.append(group[0])
                        v.append(int(want[i]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def verify(source: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by whole sets; a is the centre. A table in the shared folder."""
    n = pairs.count()
    degree = few(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("deg")), n)
    fans = pairs.join(small(degree, n), "a").select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / FAN)).cast("int").alias("fan"), F.col("b").alias("key"))
    members = few(fans.unionAll(fans.select("centre", "fan", F.col("centre").alias("key"))).distinct(), 2 * n)
    needs = classes.select("key", F.col("first.id").alias("of"), "first.text_key").join(small(members, 2 * n), "key")
    needs = materialize(needs, "needs")
    # under the bound only the texts that are needed move, once; beyond it all take a shuffle by id and hash first
    texts = source.select(F.coalesce("id", F.lit(int(NO_ID))).alias("of"), "text_key", "text")
    texts = texts.join(small(needs, 2 * n), ["of", "text_key"])
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("centre", "fan", "key", "text").repartition(parts, "centre", "fan")
    links = dealt.sortWithinPartitions("centre", "fan", (F.col("key") != F.col("centre"))).mapInArrow(compare, "u bigint, v bigint")
    links = materialize(links, "links")
    discard(needs)
    return links


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_shingles, component_id, stays), a table in the shared folder: a row for each document, with the
    xxhash64 of its text, and whether it is the first of its component, by id and then by text_key."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    n = bucket_count(docs, per_partition=8)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_key"))
    dealt = source.mapInArrow(sketch(n), schema_of(ENTRIES | MEMBERS)).repartition(max(n // 8, 1), "bucket").sortWithinPartitions("bucket")
    found = materialize(dealt.mapInArrow(meet, FOUND), "parity")
    del dealt
    release(spark)
    members = found.filter("kind = 1").select(F.struct((F.col("n") < 0).alias("nameless"), F.col("x").alias("id"), F.col("z").alias("text_key")).alias("first"), F.col("y").alias("key"), F.abs("n").alias("n"), "sketch")
    classes = materialize(members.groupBy("key").agg(F.min("first").alias("first"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes")
    told = lambda c: classes.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    near = found.filter("kind = 0").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    near = near.join(told("a"), "a").join(told("b"), "b").filter("5 * least(na, nb) >= 4 * greatest(na, nb)")
    tested = materialize(near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(prune, "a bigint, b bigint"), "pairs")
    links = verify(source, tested, classes)
    release(spark)
    joined = components(links)
    n_large = found.filter("kind = 2").count()
    # the size of a group is known where it is found, so rows of a large one can be salted in every join by group
    salts = lambda many: F.ceil(F.col(many) / ASKED).cast("int")
    state = found.filter("kind = 2").select(F.col("x").alias("sig"), F.col("y").alias("key"), F.col("n").alias("many"))
    width, turns, first_round = 4, 1, True
    while True:
        large = state.join(small(joined.withColumnRenamed("node", "key")), "key", "left").withColumn("component", F.coalesce("component", "key"))
        if first_round:
            large = large.withColumn("pending", F.lit(True)).withColumn("turn", F.lit(1))
        large = materialize(few(large, n_large).withColumn("salt", F.pmod(F.xxhash64("key"), salts("many")).cast("int")), "large-groups")
        each = few(large.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("pending").cast("long")).alias("left"), F.sum((F.col("pending") & (F.col("turn") <= turns)).cast("long")).alias("asking"), F.max("many").alias("many")), n_large)
        groups = each.groupBy("sig").agg(F.max("many").alias("many"), F.sum("left").alias("left"), F.sum("asking").alias("asking"), F.count(F.lit(1)).alias("components"), F.max(F.struct("c", "component")).alias("largest"))
        groups = few(groups, n_large).filter("components > 1 AND left > 0")  # a group of one component has no link left that matters
        groups = materialize(groups.select("sig", F.explode(F.sequence(F.lit(0), salts("many") - 1)).alias("salt"), "asking", F.col("largest.component").alias("largest")), "groups")
        rest = large.join(small(groups), ["sig", "salt"])
        if first_round:
            rest = rest.withColumn("pending", F.col("component") != F.col("largest"))
            rest = rest.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(~F.col("pending"), "many", "sig")))  # a class is in no more groups than it has parts
            rest = materialize(few(rest, n_large).drop("asking"), "mixed-groups")
            per_sig = few(rest.groupBy("sig").agg(F.sum((F.col("pending") & (F.col("turn") <= turns)).cast("long")).alias("asking")), n_large)
            rest_, rest = rest, materialize(rest.join(small(per_sig, n_large), "sig").select("sig", "key", "component", "many", "pending", "turn", "asking"), "mixed-groups")
            discard(rest_)
        else:
            rest = materialize(few(rest, n_large).select("sig", "key", "component", "many", "pending", "turn", "asking"), "mixed-groups")
        discard(large, groups, state)
        state, first_round = rest, False
        n_large = rest.count()
        if not n_large:
            break
        now = F.col("pending") & (F.col("turn") <= turns)
        lines = F.ceil(F.col("asking") / ASKERS).cast("int")
        shown = classes.select("key", "n", "sketch").join(small(rest.filter("asking > 0").withColumn("own", now), n_large), "key")
        known = tested.groupBy(F.col("b").alias("key")).agg(F.collect_list("a").alias("known"))
        shown = shown.join(known, "key", "left").withColumn("known", F.coalesce("known", F.array().cast("array<bigint>")))
        every = shown.select("sig", F.explode(F.sequence(F.lit(0), lines - 1)).alias("ask"), F.pmod(F.xxhash64("key"), salts("many")).cast("int").alias("of"), F.lit(False).alias("asks"), "own", "key", "component", "n", "sketch", "known")
        askers = shown.filter("own").select("sig", F.pmod(F.xxhash64("key"), lines).cast("int").alias("ask"), F.explode(F.sequence(F.lit(0), salts("many") - 1)).alias("of"), F.lit(True).alias("asks"), "own", "key", "component", "n", "sketch", "known")
        dealt = every.unionAll(askers).repartition(parts, "sig", "ask", "of").sortWithinPartitions("sig", "ask", "of", F.desc("asks"))
        asked = materialize(dealt.mapInArrow(across(width), ACROSS), "asked")
        n_asked = asked.count()
        late = materialize(few(asked.filter("NOT more").select("a", "b").distinct(), n_asked), "late")
        again = materialize(few(asked.filter("more").select(F.col("a").alias("sig"), F.col("b").alias("key")).distinct(), n_asked).withColumn("again", F.lit(True)), "asking")
        state = rest.join(small(again, n_asked), ["sig", "key"], "left").withColumn("pending", F.col("pending") & (~(F.col("turn") <= turns) | F.coalesce("again", F.lit(False))))
        state = materialize(few(state, n_large).select("sig", "key", "many", "pending", "turn"), "large-groups")
        discard(asked, rest, again)
        if not late.isEmpty():
            links = links.unionAll(verify(source, late, classes))
            joined = components(links)
            tested = tested.unionAll(late)
        release(spark)
        width, turns = width * 8, turns * 16
    each = classes.select("key", "first").join(small(joined.withColumnRenamed("node", "key")), "key", "left")
    least = materialize(each.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least")), "components")
    named = each.join(small(least), "component", "left").select("key", F.coalesce("least", "first").alias("of"))
    rows = members.select("first", "key", "n").join(named, "key")
    given = lambda of: F.when(~F.col(f"{of}.nameless"), F.col(f"{of}.id"))
    rows = rows.select(given("first").alias("id"), "first.text_key", F.col("n").cast("long").alias("n_shingles"), given("of").alias("component_id"), (F.col("first") == F.col("of")).alias("stays"))
    without = source.filter(F.coalesce(F.regexp_replace(F.col("text"), r"[\x20\x09-\x0D]+", ""), F.lit("")) == "").select("id", "text_key", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("stays"))
    out = materialize(rows.unionAll(without), "linked")
    discard(found, classes, least, state)
    release(spark)
    return out


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document, with the smallest id it reaches by links."""
    return linked_rows(docs, id_col, text_col).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.r)
SELECT reached.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reached LEFT JOIN sizes ON sizes.doc_id = reached.doc_id GROUP BY reached.doc_id
"""

"""Secret scans with one combined deterministic automaton.

Every rule's regular expression is parsed, built into one nondeterministic automaton, made deterministic by subset
construction over byte classes, and minimised by partition refinement into plain transition arrays. There are two such
tables over all rules, and no other matcher:

* The first reads a text backwards, in one pass for all rules, and tells at each byte which rules have a match that
  starts there. The pass is vectorised: many segments of a slice take each step together. Segments are cut behind bytes
  that bring every state back to the start. Where there are none for long, they are cut anywhere: each such segment is
  walked from every state that its neighbours can leave it in, which are few, and the walks are then chained.
* The second reads forwards from a start until no rule can go on; the last byte at which a rule was accepted is the end
  of its longest match, and the same for the part before the group whose length counts.

Leftmost non-overlapping matches follow: a rule's next match is the first start that is not before the end of the last.
Matches that are too short still take their bytes, and are dropped then. In the first table, long counted repeats are
shortened (``cap``) where a match that begins inside another cannot outlast it, so that it stays small.

Defined results: a null text is empty; an empty table gives an empty result; repeated rows give repeated results; a
null ``doc_id`` is kept; other columns are ignored. Texts are scanned whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gritstone.llm.storage import ship
from gritstone.llm.words import slices, trimmed


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length counts, and the least length of a finding."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    cap: int = 6


# The rules in the order in which kinds are listed. The first three are the base rules.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, 12),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)


class _Parser:
    """Literals, classes, groups, ``|``, ``? * +`` over bytes, as a tree of tuples."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t"}.get(c, c))

    def one(self) -> int:
        c = self.take()
        return self.escape() if c == "\\" else ord(c)

    def choice(self):
        arms = [self.sequence()]
        while self.peek() == "|":
            self.take()
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else ("or", arms)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while self.peek() in ("?", "*", "+"):
            node = ({"?": "opt", "*": "star", "+": "plus"}[self.take()], node)
        return node

    def atom(self):
        if self.peek() == "(":
            self.take()
            node = self.choice()
            self.take()
            return node
        if self.peek() == "[":
            self.take()
            chosen: set[int] = set()
            while self.peek() != "]":
                low = high = self.one()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    high = self.one()
                chosen.update(range(low, high + 1))
            self.take()
            return ("set", frozenset(chosen))
        return ("set", frozenset([self.one()]))


@dataclass
class Automaton:
    """table[state * n_classes + byte_class[byte]]; state 0 is the start; states from ``accepting`` on accept ``masks[state]``."""

    byte_class: np.ndarray
    table: np.ndarray
    n_classes: int
    accepting: int
    masks: np.ndarray
    resets: np.ndarray
    dead: int


class _Builder:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, a: int) -> int:
        """Build ``node`` from state a; its end state."""
        kind = node[0]
        if kind == "set":
            b = self.state()
            self.moves[a].append((node[1], b))
            return b
        if kind == "seq":
            for part in node[1]:
                a = self.add(part, a)
            return a
        b = self.state()
        if kind == "or":
            for arm in node[1]:
                self.free[self.add(arm, a)].append(b)
        elif kind == "opt":
            self.free[self.add(node[1], a)].append(b)
            self.free[a].append(b)
        else:  # star, plus
            loop = self.state()
            self.free[a].append(loop)
            end = self.add(node[1], loop)
            self.free[end].append(loop)
            self.free[end if kind == "plus" else loop].append(b)
        return b

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _turned(node):
    """The tree that matches the reversed strings."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "seq":
        return ("seq", [_turned(part) for part in reversed(node[1])])
    return ("or", [_turned(arm) for arm in node[1]]) if kind == "or" else (kind, _turned(node[1]))


def _trigger(rule: Rule):
    """The rule's tree with its last repeat cut to as many bytes as tell a start: one, or up to ``cap`` of those that a finding
    needs, if the bytes before are of the same kind, as then no match that begins inside another outlasts it."""
    parts = list(_Parser(rule.pattern).choice()[1])
    if parts[-1][0] == "plus":
        repeated = parts[-1][1]
        alike = rule.group == 0 and repeated[0] == "set" and all(p[0] == "set" and p[1] <= repeated[1] for p in parts[:-1])
        parts[-1:] = [repeated] * (max(1, min(rule.cap, rule.least - len(parts) + 1)) if alike else 1)
    return ("seq", parts)


def compile_trees(trees: list, anywhere: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation; tree k sets bit k of a state's mask. ``anywhere``: a match
    may begin at each byte."""
    b = _Builder()
    start = b.state()
    ends: dict[int, int] = {}
    for k, tree in enumerate(trees):
        first = b.state()
        b.free[start].append(first)
        ends[b.add(tree, first)] = 1 << k
    sets = {s for moves in b.moves for s, _ in moves}
    shape = {byte: tuple(byte in s for s in sets) for byte in range(256)}
    kinds = {x: i for i, x in enumerate(dict.fromkeys(shape.values()))}
    byte_class = np.array([kinds[shape[x]] for x in range(256)], np.uint8)
    sample = {int(byte_class[x]): x for x in range(255, -1, -1)}
    n_classes = len(kinds)
    begin = b.closure([start])
    names, rows, todo = {begin: 0}, [], [begin]
    while len(rows) < len(todo):
        now, row = todo[len(rows)], []
        for c in range(n_classes):
            byte = sample[c]
            reached = b.closure([t for s in now for on, t in b.moves[s] if byte in on])
            reached = reached | begin if anywhere else reached
            if reached not in names:
                names[reached] = len(names)
                todo.append(reached)
            row.append(names[reached])
        rows.append(row)
    table = np.array(rows)
    masks = np.array([sum({ends[s] for s in x if s in ends}) for x in todo])
    group = np.unique(masks, return_inverse=True)[1].ravel()
    while True:  # states are alike if they accept alike and go to like states
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        if finer.max() == group.max():
            break
        group = finer.ravel()
    firsts = np.unique(group, return_index=True)[1]
    order = sorted(range(len(firsts)), key=lambda g: (masks[firsts[g]] > 0, g != group[0], g))
    name = np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    small, masks = name[group[table[firsts[order]]]], masks[firsts[order]]
    resets = np.array([(small[:, byte_class[x]] == 0).all() for x in range(256)])
    dead = [g for g in range(len(small)) if not masks[g] and (small[g] == g).all()]
    return Automaton(byte_class, small.astype(np.int32).ravel(), n_classes, int((masks == 0).sum()), masks, resets, dead[0] if dead else -1)


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Automaton, Automaton]:
    """(starts, read backwards; ends, read forwards). The latter's bits are the rules and, after them, what precedes their groups."""
    whole = [_Parser(r.pattern).choice() for r in rules]
    lead = [("seq", tree[1][:-1]) for r, tree in zip(rules, whole) if r.group]
    return compile_trees([_turned(_trigger(r)) for r in rules], True), compile_trees(whole + lead, False)


def _walk(dfa: Automaton, kinds: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, found: list | None = None) -> np.ndarray:
    """The states in which segments end that begin in ``state``; ``found`` gets (positions, states) where rules accept."""
    order = np.argsort(-length, kind="stable")
    begin, length, now = begin[order], length[order], state[order].astype(np.int64)
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")  # segments longer than j
    for j, m in enumerate(active):
        at = begin[:m] + j
        now[:m] = dfa.table[now[:m] * dfa.n_classes + kinds[at]]
        if found is not None and int(now[:m].max()) >= dfa.accepting:
            hit = np.flatnonzero(now[:m] >= dfa.accepting)
            found.append((at[hit], now[hit]))
    out = np.empty_like(now)
    out[order] = now
    return out


def accepted(dfa: Automaton, data: np.ndarray, offsets: np.ndarray, stride: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the bytes at which rules are accepted, and their masks; documents are data[offsets[i]:offsets[i+1]]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    back = np.flatnonzero(dfa.resets[data]) + 1
    nearest = np.searchsorted(back, np.arange(stride, n, stride))
    cuts = np.unique(np.concatenate([back[nearest[nearest < len(back)]], offsets[:-1]]))
    cuts = cuts[cuts < n]
    length = np.diff(np.append(cuts, n))
    kinds = dfa.byte_class[data]
    state = np.zeros(len(cuts), np.int64)
    if length.max() > 16 * stride:  # long stretches without a byte that resets
        pieces = np.where(length > 16 * stride, -(-length // stride), 1)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(cuts, pieces) + inner * stride
        length = np.minimum(np.repeat(cuts + length, pieces) - begin, np.where(np.repeat(pieces, pieces) > 1, stride, n))
        chained = np.flatnonzero(np.repeat(pieces, pieces) > 1)
        leaves: dict[int, np.ndarray] = {}
        todo = [0]
        while todo:
            s = todo.pop()
            leaves[s] = _walk(dfa, kinds, begin[chained], length[chained], np.full(len(chained), s))
            todo += [x for x in np.unique(leaves[s]).tolist() if x not in leaves and x not in todo]
        state, now = np.zeros(len(begin), np.int64), 0
        for i, at in enumerate(chained.tolist()):
            now = 0 if inner[at] == 0 else now
            state[at] = now
            now = int(leaves[now][i])
        cuts = begin
    found: list = []
    _walk(dfa, kinds, cuts, length, state, found)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, states = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at)
    return at[order], dfa.masks[states[order]]


def longest(dfa: Automaton, data: bytes, at: int, end: int, bits: tuple[int, ...]) -> list[int]:
    """For each bit, where its longest match of data[at:end] ends; -1 without one."""
    state, out, first = 0, [-1] * len(bits), dfa.accepting
    table, n, byte_class, masks, dead = dfa.table_list, dfa.n_classes, dfa.class_list, dfa.mask_list, dfa.dead
    while at < end:
        state = table[state * n + byte_class[data[at]]]
        if state == dead:
            break
        at += 1
        if state >= first:
            for i, b in enumerate(bits):
                if masks[state] >> b & 1:
                    out[i] = at
    return out


class Scanner:
    """Both automata of some rules, ready for texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.starts, self.ends = compile_rules(rules)
        self.ends.table_list, self.ends.class_list, self.ends.mask_list = self.ends.table.tolist(), self.ends.byte_class.tolist(), self.ends.masks.tolist()
        groups = [k for k, r in enumerate(rules) if r.group]
        self.bits = [(k, len(rules) + groups.index(k)) if r.group else (k,) for k, r in enumerate(rules)]

    def find(self, data: np.ndarray, offsets: np.ndarray, stride: int = 1024) -> list[tuple[int, int, int, int]]:
        """(document, start, rule, end) in bytes of ``data``, by document, start and rule."""
        n = len(data)
        at, masks = accepted(self.starts, np.ascontiguousarray(data[::-1]), n - offsets[::-1], stride)
        if not len(at):
            return []
        at, masks = (n - 1 - at)[::-1], masks[::-1]
        owner = np.searchsorted(offsets, at, side="right") - 1
        text, out = memoryview(np.ascontiguousarray(data)).cast("B"), []
        for k, (rule, bits) in enumerate(zip(self.rules, self.bits)):
            mine = np.flatnonzero(masks >> k & 1)
            starts, docs = at[mine], owner[mine]
            i, done = 0, -1
            while i < len(starts):
                start, d = int(starts[i]), int(docs[i])
                end, *lead = longest(self.ends, text, start, int(offsets[d + 1]), bits)
                if end < 0:  # a start that a shortened repeat let through
                    i += 1
                    continue
                if end - (lead[0] if lead else start) >= rule.least:
                    out.append((d, start, k, end))
                i = int(np.searchsorted(starts, end))
        return sorted(out)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every text: (id, spans array<struct<kind, start, end>>), by start and then by the rules' order."""
    ship(docs.sparkSession)
    scanner = Scanner(rules)
    schema = docs.select(id_col).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 1)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = batch.column("text").cast(pa.large_string()).fill_null("")
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                raw = texts.buffers()[2]
                data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
                offsets = offsets - offsets[0]
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                hits = scanner.find(data, offsets)
                if hits:
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
                    for d, start, k, end in hits:
                        zero = int(points[offsets[d]])
                        found[d].append({"kind": rules[k].kind, "start": int(points[start]) - zero, "end": int(points[end]) - zero})
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, struct)], names=[id_col, "spans"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(scan, f"{schema}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The thin columns over ``scan_secrets``: counts of base kinds, a hash of the base spans, all spans as text."""
    from pyspark.sql import functions as F

    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = [r.kind for r in BASE_RULES]
    return found.select(id_col, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(told(of(*base)).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _rule_sql(place: int, rule: Rule) -> str:
    """One row for each finding of a rule: what lies between matches gives their starts."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS k, '{rule.kind}' AS kind, unnest(begins) AS s, unnest(ends) AS e, unnest(sizes) AS n FROM (
    SELECT doc_id, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)) AS begins,
      list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: len(x))) + list_sum(list_transform(m[1:i], lambda x: len(x)))) AS ends,
      list_transform(v, lambda x: len(x)) AS sizes
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM docs)) WHERE len(begins) > 0"""


_found_sql = "\n  UNION ALL ".join(f"SELECT * FROM ({_rule_sql(k, r)}) WHERE n >= {r.least}" for k, r in enumerate(BASE_RULES + MORE_RULES))
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_found_sql}),
told AS (SELECT doc_id, k, kind, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM found)
SELECT docs.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
  sha256(coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, k), '') AS spans
FROM docs LEFT JOIN told ON told.doc_id = docs.doc_id GROUP BY docs.doc_id
"""

"""Mixing, sharding, extraction, search, quality, decontamination and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from contextlib import nullcontext

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gritstone.llm import decontaminate, graph_ann, html_extract, mixing, quality_crf, sharding
from gritstone.llm.entry import ORACLES, QUERIES
from gritstone.llm.storage import materialize, scratch_path

from .helpers import documents, empty, frame, split

SMALL = "/root/testdata/sf0.001"


# --- mixing -----------------------------------------------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1), most=3):
    """By resharing the excess until none is above."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(keys)}
    budget, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in capped}
        left = budget - sum(capped.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: most * sizes[s] for s, x in share.items() if x > most * sizes[s] + 1e-9}
        if not over:
            return capped | share
        capped |= over


def test_mix(spark):
    rows = documents()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(split(t))
    want = targets(sizes)
    got = mixing.plan_mix(frame(spark)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        m = r._mix
        assert m.size == len(split(r.text)) and m.source_size == sizes[r.source] and math.isclose(m.target, want[r.source], rel_tol=1e-9)
        assert m.taken == m.copies * m.size <= 3 * m.size and len(m.positions) == m.copies and all(0 <= p <= 1 for p in m.positions)
        taken[r.source] += m.taken
    largest = max(len(split(t)) for _, t, *_ in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    again = mixing.plan_mix(frame(spark, parts=3)).collect()
    assert Counter((r.doc_id, r._mix.taken, tuple(r._mix.positions)) for r in got) == Counter((r.doc_id, r._mix.taken, tuple(r._mix.positions)) for r in again)
    mixed = mixing.mix_documents(frame(spark))
    assert mixed.columns == frame(spark).columns and mixed.count() == sum(r._mix.copies for r in got)
    assert mixing.plan_mix(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    sizes = {f"s{i:02}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(20)}
    df = spark.createDataFrame([("0" + s, n) for s, n in sizes.items()], "_key string, _size bigint")
    want = targets(sizes)
    assert all(math.isclose(r._target, want[r._key[1:]], rel_tol=1e-9, abs_tol=1e-6) for r in mixing.source_targets(df).collect())


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.1))])
def test_curriculum_inverts_its_integral(spark, schedule):
    from pyspark.sql import functions as F

    rows = spark.range(1, 100).select((F.col("id") / 100).alias("q")).withColumn("t", mixing.training_time(F.col("q"), schedule)).collect()
    xs = np.linspace(0, 1, 200_001)
    w = np.interp(xs, [t for t, _ in schedule], [x for _, x in schedule])
    done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    for r in rows:
        assert abs(np.interp(r.t, xs, done / done[-1]) - r.q) < 1e-4


def test_mix_is_native_and_matches_sql(spark, capsys):
    df = QUERIES["op2_mixing"](spark, SMALL)
    df.explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    answer = con.sql(ORACLES["op2_mixing"])
    assert sorted(answer.columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*answer.columns).collect())) == Counter(answer.fetchall())


# --- sharding ---------------------------------------------------------------------------------------------------


def test_shards(spark):
    docs = frame(spark)
    table = sharding.ShardTable(spark, scratch_path(spark, "t"), docs.schema, target_bytes=200_000, least_bytes=2_000, fanout=3)
    assert table.append(docs, 4) == 1 and table.append(docs.limit(10), 2) == 2
    before = table.manifest().collect()
    assert sum(r.rows for r in before) == len(documents()) + 10 and max(r.rows for r in before) <= 4
    version = table.compact()
    after = table.manifest().collect()
    assert version == table.versions()[-1] > 2 and len(after) < len(before) / 2 and sum(r.rows for r in after) == sum(r.rows for r in before)
    assert table.compact() == version  # nothing is due
    told = lambda v: Counter((r.doc_id, r.text, r.source) for r in table.read(v).collect())
    assert told(2) == told(version) and told(1) == Counter((d, t, s) for d, t, _, s, *_ in documents())
    rows = table.rows_by_shard().collect()
    assert Counter(r._shard.shard for r in rows) == Counter({r._shard.shard: r._shard.shard_rows for r in rows})
    table.expire()
    assert table.versions() == [version] and told(version)


def test_many_arrivals_settle(spark):
    """Arrival after arrival: every row stays, the number of shards follows the bytes, and no tier is left due."""
    docs = frame(spark)
    table = sharding.ShardTable(spark, scratch_path(spark, "t"), docs.schema, target_bytes=400_000, least_bytes=2_000, fanout=2)
    for i in range(5):
        table.append(docs.filter(f"coalesce(doc_id, 0) % 5 = {i}").coalesce(1), 3)
        table.compact()
    tiers = Counter()
    for r in table.runs():
        tiers[r["tier"]] += r["shards"]
    assert all(n < 2 or t == sharding.SETTLED for t, n in tiers.items())
    assert Counter((r.doc_id, r.text) for r in table.read().collect()) == Counter((d, t) for d, t, *_ in documents())
    table.expire()
    assert Counter((r.doc_id, r.text) for r in table.read().collect()) == Counter((d, t) for d, t, *_ in documents())


def test_shards_under_settings_that_keep_the_reader_from_packing(spark, monkeypatch):
    """Merging ends and gives shards of the target size where every file stays a partition of its own."""
    docs = frame(spark, parts=12)
    monkeypatch.setattr(sharding, "_settings", lambda spark, **conf: nullcontext())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        table = sharding.ShardTable(spark, scratch_path(spark, "t"), docs.schema, target_bytes=4_000_000)
        table.append(docs)
        assert table.manifest().count() == 12
        assert table.compact() == 2 and [r["shards"] for r in table.runs()] == [1]
        assert Counter((r.doc_id, r.text) for r in table.read().collect()) == Counter((d, t) for d, t, *_ in documents())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sharding_is_native(spark, capsys):
    QUERIES["op1_sharding"](spark, SMALL).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_two_writers(spark):
    docs = frame(spark)
    one = sharding.ShardTable(spark, scratch_path(spark, "t"), docs.schema)
    one.append(docs)
    other = sharding.ShardTable(spark, one.root, docs.schema)
    other.commit(other.manifest(), 1)
    with pytest.raises(Exception, match="(?i)exist"):
        one.commit(one.manifest(), 1)
    assert one.versions() == [1, 2]


def test_empty_shards(spark):
    table = sharding.shard_documents(empty(spark))
    assert table.read().count() == 0 and table.rows_by_shard().count() == 0


def test_sharding_round_trip(spark):
    got = QUERIES["op1_sharding"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs)
    assert Counter(r.shard for r in got) == Counter({r.shard: r.shard_rows for r in got})


# --- extraction -------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one <b>two</b>three<br>four<p>five&nbsp; six</article><footer>f</footer></body></html>", "A & B one twothree four five six"),
    ("<body><header>site</header><main><div class='cookie-notice'>c</div><p>text</p><!-- <p>no</p> --><div id=comments><p>first!</p></div><aside>x</aside></main></body>", "text"),
    ("<body><div class=menu>m</div><div class=content><p>kept</p><script>var a='</p>';</script><style>p{}</style><form><input><button>go</button></form></div></body>", "kept"),
    ("<article>aa<div>bb<div>cc</article>tail", "aa bb cc"),
    ("plain text &lt;tag&gt; &#233;", "plain text <tag> é"),
    ("<article><p>unclosed <i>tag", "unclosed tag"),
    ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x y 1 2"),
    ("", ""),
    (None, ""),
    ("<", "<"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<body><div role=navigation>n</div><div hidden>h</div><p>seen</p></body>", "seen"),
    ("<article><header><h1>T</h1></header><p>x</p></article>", "T x"),
    # names of wrappers, of headings' anchors, and of an article's own sections do not drop it
    ('<body><div id="top"><article><p>kept</p></article></div></body>', "kept"),
    ('<body><div class="layout has-sidebar"><article><p>kept</p></article><div class="sidebar">s</div></div></body>', "kept"),
    ('<article><p>a</p><h2 id="search">b</h2><h2 id="skip-lists">c</h2><section class="related-work"><p>d</p></section><div class="related-links"><a>e</a></div></article>', "a b c d"),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>", "let x=2 be"),
    # elements that are never closed
    ("<article><p>a</p><svg><p>b</p></article>", "a b"),
    ("<article><p>a</p><noscript><p>b</p></article>", "a b"),
    ("<article><p>a</p><script>var x = 1;<p>b</p></article>", "a b"),
    ("<article><p>a</p><noscript><img></noscript><svg><text>t</text></svg><p>b</p></article>", "a b"),
    # a teaser beside the real text
    ('<body><article><p>read me too</p></article><div class="content"><p>' + "the long real text " * 9 + "ends</p></div></body>", "read me too " + "the long real text " * 9 + "ends"),
]


def test_pages(spark):
    rows = [(i, None if i % 4 == 3 else f"https://h{i}.example/x", h, "extra") for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows * 2, "page_id bigint, url string, html string, host string")
    got = html_extract.digest(df).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter({(i, t): 2 for i, (_, t) in enumerate(PAGES)})
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.digest(df.limit(0)).count() == 0


def test_style_tree_finds_unnamed_boilerplate(spark):
    """No tag, class or id tells: only that a branch reads the same on every page of its host."""
    rng = random.Random(1)
    rows = []
    for i in range(40):
        body = " ".join(f"w{rng.randrange(999)}" for _ in range(30))
        rows.append((i, f"https://{'big' if i < 30 else f'one{i}'}.example/{i}", f"<body><div class=q1>Same words {i % 2 * 0}</div><div class=z9>{body}</div><div class=q2><span>All the same</span></div></body>"))
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("ame" not in got[i] and got[i].startswith("w") for i in range(30))
    assert all("Same words" in got[i] for i in range(30, 40))  # one page of a host tells nothing


def test_copies_do_not_erase_an_article(spark):
    rows = [(i, "https://x.example/a", "<body><nav>n</nav><article><p>the same article</p></article></body>") for i in range(9)]
    rows += [(10 + i, "https://x.example/b", f"<body><nav>n</nav><article><p>the same article</p><p>{i}</p></article></body>") for i in range(9)]
    assert all(r.text.startswith("the same article") for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())


def test_the_tree_decides():
    """Without it the text of every page changes."""
    import pyarrow.parquet as pq

    pages = html_extract.Pages()
    for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist():
        assert len(pages.main_text(r["html"], frozenset())) > len(re.search("(?s)<article>.*</article>|$", r["html"])[0]) / 2


def test_tree_off_changes_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    on, off = ({r.page_id: r.text for r in html_extract.extract_text(pages, tree=t).collect()} for t in (True, False))
    assert sum(on[k] != off[k] for k in on) > 0.9 * len(on) and all(on[k] in off[k] for k in on)


def test_tree_works_inside_articles(spark):
    """The same paragraph under every article goes; a paragraph that differs stays, whatever its class."""
    page = lambda c: f"<body><article><h1>T {c}</h1><p>body {c * 7}</p><p class='same'>Written by hand, always</p><p class='other'>no {c}</p></article></body>"
    rows = [(i, "https://a.example/x", page(c)) for i, c in enumerate("abcdefghij")]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("always" not in t and "no " in t and "body" in t for t in got.values())


def test_importance_by_brute_force(spark):
    """Entropies of merged nodes, recomputed page by page."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        items = "".join(f"<li>{rng.choice('abc')}</li>" for _ in range(rng.randrange(1, 4)))
        rows.append((f"h{i % 3}", f"<body><div class=m>{rng.choice('pq')}</div><ul>{items}</ul><article><p>{rng.choice('uvwxyz')}</p></article></body>"))
    got = {(r.host, r.node): r for r in html_extract.node_importance(spark.createDataFrame(rows, "host string, html string")).collect()}
    seen = defaultdict(set)
    for host, html in rows:
        page, nodes = html_extract.Pages().profile(html)
        for node, told in nodes.items():
            seen[host, node].add((page, *told))
    assert set(got) == set(seen) and len(seen) == 3 * 5

    def entropy(values):
        n = len(values)
        return 1.0 if n < 2 else -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n)

    for k, found in seen.items():
        r = got[k]
        assert r.pages == len(found) and math.isclose(r.content, entropy([x[1] for x in found]), abs_tol=1e-9) and math.isclose(r.kinds, entropy([x[2] for x in found]), abs_tol=1e-9)
        assert r.importance <= 1


def test_large_hosts_join_by_broadcast(spark, monkeypatch):
    rows = [(i, f"https://{'big' if i < 20 else f'h{i % 4}'}.example/{i}", f"<body><nav>same</nav><p>{i}</p></body>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = Counter(map(tuple, html_extract.digest(pages).collect()))
    monkeypatch.setattr(html_extract, "MOST_LOW", 0)
    monkeypatch.setattr(html_extract, "LARGE_HOST", 8)
    assert Counter(map(tuple, html_extract.digest(pages).collect())) == want and all("same" not in t for _, _, t, _ in want)


# --- search -----------------------------------------------------------------------------------------------------


def exact(ids, vectors, queries, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[q]
        others = [(-round(float(s[j]), 12), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]]
        out[ids[q]] = sorted(others)[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:300] = v[7]  # copies of one vector
    rows = [(i, [float(x) for x in r], 0, "x") for i, r in enumerate(v)]
    odd = [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [float("inf")] + [1.0] * 15), (1100, []), (1150, [1.0, 2.0]), (1200, [1.0, 2.5]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + [(i, x, 1, "y") for i, x in odd] + [rows[50]], "vec_id bigint, embedding array<float>, label int, rank string")
    got = graph_ann.nearest_neighbours(df, df["vec_id"] % 50 == 0, shard_rows=(100, 200)).collect()
    want = exact(list(range(600)), v.astype(np.float64), range(0, 600, 50))
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((-round(r.score, 12), r.vec_id))
    assert {q for q in found} == set(range(0, 600, 50)) | {1150, 1200} and [i for _, i in found[1150]] == [1200]
    hits = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want) and found[100] == want[100]  # ties to the smaller id
    assert all(q not in [i for _, i in found[q]] and len(found[q]) == 5 for q in want)
    assert graph_ann.nearest_neighbours(df.limit(0), df["vec_id"] % 50 == 0).count() == 0


def test_recall_of_a_larger_shard():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    v = (centres[rng.integers(0, 60, 7000)] + rng.normal(scale=0.7, size=(7000, 24))).astype(np.float32)
    asked = rng.choice(7000, 200, replace=False)
    q, found, _ = graph_ann.Shard(np.arange(7000), v, 5).nearest(asked, v[asked])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit[asked] @ unit.T
    near[np.arange(200), asked] = -2
    want = {(int(a), int(b)) for a, row in zip(asked, np.argsort(-near, axis=1)[:, :5]) for b in row}
    assert len(want & set(zip(q.tolist(), found.tolist()))) >= 0.95 * len(want)


def test_recall_on_data(spark):
    got = QUERIES["op6_ann"](spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    want = exact(ids, v, [i for i, x in enumerate(ids) if x % 50 == 0])
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
    assert sum(len(found[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)


# --- quality ----------------------------------------------------------------------------------------------------


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 4, 9])
    good, moves, edges = rng.normal(size=9), rng.normal(size=(2, 2)), rng.normal(size=2)
    got, pairs = quality_crf.forward_backward(good, first, moves, edges)
    for a, z in zip(first, first[1:]):
        total, mass, joint = 0.0, np.zeros(z - a), np.zeros((z - a, 2, 2))
        for code in range(2 ** (z - a)):
            y = [code >> i & 1 for i in range(z - a)]
            w = math.exp(edges[y[0]] + sum(good[a + i] for i in range(z - a) if y[i]) + sum(moves[y[i - 1], y[i]] for i in range(1, z - a)))
            total += w
            mass += w * np.array(y)
            for i in range(1, z - a):
                joint[i, y[i - 1], y[i]] += w
        assert np.allclose(got[a:z, 1], mass / total) and np.allclose(pairs[a + 1 : z], joint[1:] / total)


def test_line_features_do_not_depend_on_the_batch():
    texts = [t for _, t, *_ in documents()] + ["a\n\nB!!\n", "\n"]
    values, lengths, first = quality_crf.line_features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        one, size, _ = quality_crf.line_features(pa.array([t], pa.string()))
        assert np.allclose(one, values[first[i] : first[i + 1]]) and size.tolist() == lengths[first[i] : first[i + 1]].tolist()
        assert len(one) == (t or "").count("\n") + 1


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if got[d].held_out]
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.9
    field = quality_crf.train(docs, labels)
    odd = quality_crf.score_documents(frame(spark), field)
    assert odd.count() == len(documents()) and all(0 <= r.score <= 1 for r in odd.collect())
    assert quality_crf.keep_good(frame(spark), field).columns == frame(spark).columns
    assert quality_crf.score_documents(empty(spark), field).count() == 0 and quality_crf.train(docs, labels.limit(0)).share == 0.5


# --- decontamination --------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}{rng.randrange(60)}"
    common = ["the", "of", "and", "in", "to"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.3 else word() for _ in range(n)]
    items = [text(rng.randrange(14, 60)) for _ in range(20)]
    rows, want = [], set()
    for d in range(200):
        body = text(rng.randrange(10, 250))
        if d % 4 == 0:
            k = rng.randrange(20)
            copy = list(items[k])
            if d % 8 == 0:  # a paraphrase: a tenth of the words replaced, another case, other marks
                for _ in range(len(copy) // 10):
                    copy[rng.randrange(len(copy) - 4)] = word()
                copy = [w.upper() + "!" if rng.random() < 0.2 else w for w in copy]
            at = rng.randrange(len(body))
            body[at:at] = copy
            want.add((d, k))
        rows.append((d, " ".join(body), "en", "s", 0, "b", 1, "z", 7, 9))
    rows += [(None, " ".join(items[0]), "en", "s", 0, "b", 1, "z", 7, 9), (500, None, "en", "s", 0, "b", 1, "z", 7, 9), (501, "", "en", "s", 0, "b", 1, "z", 7, 9)]
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, ""), (92, "not there")], "item_id bigint, text string")
    docs = frame(spark, rows)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert found - want == {(None, 0)} and want <= found
    kept = decontaminate.remove_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    left = Counter(r.doc_id for r in kept.collect())
    assert left == Counter(d for d, *_ in rows if d not in {x for x, _ in found})
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.remove_leaks(docs, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.find_leaks(empty(spark), benchmark).count() == 0 and decontaminate.remove_leaks(empty(spark), benchmark).count() == 0


def test_short_items_are_found_by_their_words(spark):
    """Items of under LEAST_WORDS words, beside long ones and alone; in any case and with any marks, but whole and in order."""
    rows = [(0, "He said: Two Plus three, is five!"), (1, "two plus is three five"), (2, "plus three"), (3, "x"), (4, None), (5, "a five b"), (None, "two plus three")]
    docs = frame(spark, [(d, t, "en", "s", 0, "b", 1, "z", 7, 9) for d, t in rows])
    items = [(1, "Two plus three"), (2, "five"), (3, "plus three is five"), (4, "two plus three"), (5, "")]
    for more in ([], [(9, " ".join(f"z{i}" for i in range(20)))]):
        found = decontaminate.find_leaks(docs, spark.createDataFrame(items + more, "item_id bigint, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (0, 4), (0, 2), (0, 3), (1, 2), (5, 2), (None, 1), (None, 4)}
        assert all(r.common_words == r.item_words and r.cosine == 1 for r in found)


def test_leaks_by_brute_force(spark):
    """Every stretch of every document as long as an item, by LCS and answer checks, against what is found."""
    rng = random.Random(12)
    items = [[f"q{rng.randrange(300)}" for _ in range(rng.randrange(8, 40))] for _ in range(25)]
    rows = []
    for d in range(150):
        body = [f"q{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))]
        copy = list(items[rng.randrange(25)])
        for _ in range(int(len(copy) * rng.choice([0, 0.1, 0.2, 0.3, 0.4]))):
            copy[rng.randrange(len(copy))] = f"q{rng.randrange(300)}"
        if d % 3:
            at = rng.randrange(len(body))
            body[at:at] = copy
        rows.append((d, body))
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id bigint, text string")
    docs = frame(spark, [(d, " ".join(b), "en", "s", 0, "b", 1, "z", 7, 9) for d, b in rows])
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    number = lambda ws: [int(w[1:]) for w in ws]
    narrow = {(d, k) for d, b in rows for k, i in enumerate(items) if any(decontaminate.holds(number(i), number(b[p : p + len(i)])) for p in range(max(1, len(b) - len(i) + 1)))}
    wide = {(d, k) for d, b in rows for k, i in enumerate(items) if decontaminate.holds(number(i), number(b))}
    assert len(narrow) > 50 and narrow <= found <= wide


def test_diluted_copies_of_short_items_are_found():
    """Copies of short items across blocks of foreign words; the latent space is as poor as can be: it is blind."""
    rng = random.Random(11)
    text = lambda n: [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"q{rng.randrange(3000)}" for _ in range(n)]
    plain = lambda texts: decontaminate.words_of(pa.array([" ".join(t) for t in texts]), plain=True)
    items, rows, want = [text(rng.randrange(8, 25)) for _ in range(40)] + [["same"] * 12 + text(3)], [], set()
    for d in range(400):
        body, k = text(rng.randrange(60, 200)), rng.randrange(len(items))
        if d % 2:
            copy = list(items[k])
            for at in rng.sample(range(len(copy)), len(copy) // 5):
                copy[at] = f"z{d}"
            at = rng.randrange(len(body))
            body[at:at] = copy
            if decontaminate.holds(plain([items[k]]).hashes.tolist(), plain([copy]).hashes.tolist()):
                want.add((d, k))
        rows.append(body)
    words, idf = plain(items), np.ones(decontaminate.TERMS)
    idf[[int(h % np.uint64(decontaminate.TERMS)) for h in plain([["the", "of", "and"]]).hashes]] = 0.1
    space = np.zeros((decontaminate.TERMS, decontaminate.RANK), np.float32), idf
    search = decontaminate._search(space, list(range(len(items))), [words.hashes[a:z] for a, z in zip(words.first, words.first[1:])])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([" ".join(r) for r in rows])], ["id", "text"])
    found = {(d, k) for got in search(iter([batch])) for d, k in zip(got.column("doc_id").to_pylist(), got.column("item_id").to_pylist())}
    assert len(want) > 150 and want <= found and all(d % 2 for d, _ in found)


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.longest_common(a, b)[0] == best[-1][-1]


def test_all_planted_items_are_found(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    flat = lambda t: " ".join((t or "").lower().split())
    docs = {r.doc_id: flat(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = {r.item_id: flat(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    want = {(d, k) for d, t in docs.items() for k, x in items.items() if x in t}
    assert want and want <= got and len(got) <= len(want) + 2


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_training_sample(spark):
    """Long documents are learned from like others; what no longer fits the budget is passed over, not what comes after it."""
    rows = [(i, "\n".join(f"line {i} {j}" for j in range(500 if i % 3 == 0 else 5)), "en", "s", 0, "b", 1, "z", 7, 9) for i in range(60)]
    docs, labels = frame(spark, rows + rows[:7] + [(None, "x", "en", "s", 0, "b", 1, "z", 7, 9)]), spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id bigint, quality int")
    known = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    every = quality_crf.sample(docs, labels)
    assert Counter(t for t, _ in every) == Counter(rows[i][1] for i in known) and all(y == int(t.split()[1]) % 2 for t, y in every)
    some = quality_crf.sample(docs, labels, most_lines=1200)
    assert sum(t.count("\n") + 1 for t, _ in some) <= 1200 and sum(t.count("\n") > 100 for t, _ in some) == 2 and sum(t.count("\n") < 100 for t, _ in some) == sum(t.count("\n") < 100 for t, _ in every)
    assert some == [x for x in every if x in some]
    assert sum(len(t.encode()) for t, _ in quality_crf.sample(docs, labels, most_bytes=3000)) <= 3000


def test_gradient_by_differences():
    """The marginals are the slopes of the chain's log partition function."""
    rng = np.random.default_rng(5)
    good, first, moves, edges = rng.normal(size=7), np.array([0, 3, 7]), rng.normal(size=(2, 2)), rng.normal(size=2)

    def log_z(good, moves, edges):
        total = 0.0
        for a, z in zip(first, first[1:]):
            v = edges + np.array([0.0, good[a]])
            for t in range(a + 1, z):
                v = np.array([np.logaddexp(v[0] + moves[0, s], v[1] + moves[1, s]) for s in (0, 1)]) + np.array([0.0, good[t]])
            total += np.logaddexp(*v)
        return total

    both, pairs = quality_crf.forward_backward(good, first, moves, edges)
    h = 1e-6
    for i in range(7):
        step = np.eye(7)[i] * h
        assert math.isclose((log_z(good + step, moves, edges) - log_z(good - step, moves, edges)) / 2 / h, both[i, 1], abs_tol=1e-6)
    for a in (0, 1):
        for b in (0, 1):
            step = np.zeros((2, 2))
            step[a, b] = h
            assert math.isclose((log_z(good, moves + step, edges) - log_z(good, moves - step, edges)) / 2 / h, pairs[:, a, b].sum(), abs_tol=1e-6)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        counts.append(docs.count())
        if name != "shard":
            assert docs.columns == columns and docs.join(before, columns, "left_anti").isEmpty()
        if name == "near_duplicates":
            from gritstone.llm.parity_join import link_documents

            kept = {r.doc_id for r in docs.collect()}
            assert kept == {r.component_id for r in link_documents(before).collect()}
        if name == "decontaminate":
            assert decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).isEmpty()
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    got = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in docs.collect())


def test_near_duplicates_take_no_other_text_along(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (None, one), (5, one), (5, two), (7, None), (7, None), (None, three), (None, three), (None, ""), (2**63 - 1, two)]
    docs = frame(spark, [(d, t, "en", "s", 0, "", 0, "", 0, 0) for d, t in rows])
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, one), (5, two), (7, None), (None, three), (None, "")])


def test_pipeline_stages_take_odd_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (materialize(frame(spark), "odd"), empty(spark)):
            assert set(docs.columns) <= set(stage(spark, docs, SMALL).columns)
            stage(spark, docs, SMALL).count()

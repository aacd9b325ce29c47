"""Small documents with everything that may go wrong, and plain versions of what operators compute."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, kind int, size string, id int, spans int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=0, n=60):
    """Copies, near copies, shared passages, empty, null, blank, very long and very short texts, null ids and sources."""
    rng = random.Random(seed)
    passage = words(rng, 60, 9000)
    rows = []
    for i in range(n):
        body = words(rng, rng.randrange(20, 120), 9000)
        if i % 5 == 1 and rows:
            body = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, 4)):
                body[rng.randrange(len(body))] = f"x{rng.randrange(999)}"
        if i % 7 == 2:
            at = rng.randrange(len(body))
            body[at:at] = passage
        rows.append((i, " ".join(body)))
    long = " ".join(words(rng, 30_000, 50_000))
    extra = [(1000, ""), (1001, None), (1002, " \t\n "), (1003, "one"), (1004, "ONE"), (1005, "a b c d"), (1006, "A  b\nc\td"), (1007, long), (1008, long + " end"), (1009, "ab " * 3000), (None, rows[3][1]), (1010, "é ü 漢字   x"), (1011, "x" * 50_000)]
    rows += extra + [rows[4], rows[4]]
    return [(d, t, "en", None if k % 11 == 0 else f"s{k % 3}", len(t or ""), "b", 1, "z", 7, 9) for k, (d, t) in enumerate(rows)]


def frame(spark, rows=None, parts=5):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]

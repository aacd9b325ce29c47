"""Mixing of sources to target weights along a time-varying curriculum.

Only DataFrame functions: no Python runs on the executors.

* Targets. A source's target is its share, by weight, of the budget, but at most ``most_epochs`` times its size; the
  excess is shared again by weight. That fixed point is ``least(cap, level * weight)``, and the level is the largest of
  ``(budget - caps so far) / weight left`` over the sources in order of ``cap / weight``.
* Order. Documents of a source stand in the order of a hash of their id. Their offsets in words are prefix sums in
  three levels of hash digits (two, four, all), so no window holds more than 256 groups or the documents of one
  65,536th of a source; a source that holds a third of all rows is dealt out like any other.
* Taking. The source's words are read again and again, up to ``most_epochs`` times, until the target: a copy of a
  document is taken if its middle word lies before the target, so the words taken differ from the target by less than
  one document.
* Curriculum. The weight of a source over training time is a piecewise linear schedule. Its integral is the source's
  cumulative demand; inverting that at a copy's middle word gives the training position in [0, 1], by which copies are
  range-sorted.

Defined results: a null text has size 0, and documents of size 0 are never taken; a null source is a source, last in
order; a null id hashes as an empty string; repeated rows are taken like other rows; equal hashes are ordered by id and
size; an empty table gives an empty result; other columns stay and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Schedules by place in WEIGHTS, as (time, weight): steady, rising, falling. Only their shapes count.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
MOST_EPOCHS = 3


def demand_knots(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(demand so far, time, weight, slope) at the start of each segment, and the end; demand is scaled to 1."""
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((done, t0, w0 / total, (w1 - w0) / (t1 - t0) / total))
        done += (t1 - t0) * (w0 + w1) / 2 / total
    return out


def training_time(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` (0 to 1) of a source's demand has been met: the integral of its schedule, inverted."""
    out = None
    for done, t0, weight, slope in demand_knots(schedule):
        more = share - F.lit(done)
        at = F.lit(t0) + F.lit(2.0) * more / (F.lit(weight) + F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2.0 * slope) * more, F.lit(0.0))))
        out = at if out is None else F.when(share < F.lit(done), out).otherwise(at)
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """From (_key, _size) per source: _kind (place in weights) and _target. One row per source."""
    ranked = sizes.withColumn("_kind", F.pmod(F.row_number().over(Window.orderBy("_key")) - 1, F.lit(len(weights))).cast("int"))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_kind") + 1)).withColumn("_cap", F.lit(float(most_epochs)) * F.col("_size"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "_key")
    everything = Window.partitionBy()
    level = (F.sum("_size").over(everything) - (F.sum("_cap").over(by_cap) - F.col("_cap"))) / (F.sum("_weight").over(everything) - F.sum("_weight").over(by_cap) + F.col("_weight"))
    return ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything)).withColumn("_target", F.least("_cap", F.col("_level") * F.col("_weight"))).select("_key", "_kind", F.col("_size").alias("_source_size"), "_target")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, schedules: Sequence = SCHEDULES, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``docs`` with _mix: struct(size, source_size, target, copies, taken, positions), and _spread, a number of the id's hash in [0, 1)."""
    sized = docs.select(
        *[docs[f"`{c}`"] for c in docs.columns],
        F.when(docs[source_col].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs[source_col].cast("string"))).alias("_key"),
        word_count(docs[text_col]).alias("_size"),
        F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs[text_col], F.lit(""))).cast("binary")).alias("_hash"),  # of both, so that rows of one id or without any spread
        docs[id_col].alias("_id"),
    )
    sized = sized.withColumn("_four", F.substring("_hash", 1, 4))
    slim = sized.select("_key", "_four", "_size")
    fours = slim.groupBy("_key", "_four").agg(F.sum("_size").alias("_size")).withColumn("_two", F.substring("_four", 1, 2))
    inner = Window.partitionBy("_key", "_two").orderBy("_four")
    fours = fours.withColumn("_inner", F.sum("_size").over(inner) - F.col("_size"))
    twos = fours.groupBy("_key", "_two").agg(F.sum("_size").alias("_size"))
    outer = Window.partitionBy("_key").orderBy("_two")
    targets = source_targets(twos.groupBy("_key").agg(F.sum("_size").alias("_size")), weights, most_epochs)
    twos = twos.withColumn("_outer", F.sum("_size").over(outer) - F.col("_size")).drop("_size")
    groups = fours.join(twos.join(targets, "_key"), ["_key", "_two"]).select("_key", "_four", (F.col("_inner") + F.col("_outer")).alias("_before"), "_kind", "_source_size", "_target")
    within = Window.partitionBy("_key", "_four").orderBy("_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_up_to", F.sum("_size").over(within)).join(groups, ["_key", "_four"])
    offset = F.col("_before") + F.col("_up_to") - F.col("_size")
    middles = F.array(*[(F.lit(2 * e) * F.col("_source_size") + F.lit(2) * offset + F.col("_size")).cast("double") / 2 for e in range(most_epochs)])
    taken = F.when(F.col("_size") > 0, F.filter(middles, lambda m: m <= F.col("_target"))).otherwise(F.array().cast("array<double>"))
    time_of = lambda share: F.when(F.col("_kind") == 0, training_time(share, schedules[0])).when(F.col("_kind") == 1, training_time(share, schedules[1 % len(schedules)])).otherwise(training_time(share, schedules[2 % len(schedules)]))
    out = placed.withColumn("_taken", taken).withColumn("_positions", F.transform("_taken", lambda m: time_of(m / F.col("_target"))))
    mix = F.struct(
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.size("_taken").alias("copies"),
        (F.size("_taken") * F.col("_size")).cast("long").alias("taken"),
        F.col("_positions").alias("positions"),
    )
    spread = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], mix.alias("_mix"), spread.alias("_spread"))


def in_order(placed: DataFrame, position: Column, *ties: str) -> DataFrame:
    """Range partitions of [0, 1] by position, sorted inside. The demand is spread over all of it, so ranges are alike and need no sampling."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionById(n, F.least(F.floor(position * n), F.lit(n - 1)).cast("int")).sortWithinPartitions(position, *ties)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row for each copy taken, in training order."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # so that no column of docs can clash with the plan's
    of = dict(zip(docs.columns, names))
    copies = plan_mix(docs.toDF(*names), of[id_col], of[text_col], of[source_col], **options).withColumn("_position", F.explode(F.col("_mix.positions")))
    return in_order(copies, F.col("_position"), "_spread").select(*names).toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, in the order of first positions; documents not taken are spread among them."""
    slim = plan_mix(docs.select("doc_id", "text", "source")).select("doc_id", "_spread", "_mix.*")
    first = F.coalesce(F.get("positions", F.lit(0)), F.col("_spread"))
    told = slim.withColumn("first_position", F.round(F.get("positions", F.lit(0)), 6))
    return in_order(told, first, "_spread").select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", "first_position")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
sources AS (SELECT k, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY k),
weighed AS (
  SELECT k, s, (row_number() OVER (ORDER BY k) - 1) % 3 AS kind, 3.0::DOUBLE * s AS cap FROM sources),
weights AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM weighed),
levels AS (
  SELECT *, (CAST(sum(s) OVER () AS DOUBLE) - (sum(cap) OVER f - cap)) / (sum(w) OVER () - sum(w) OVER f + w) AS lv
  FROM weights WINDOW f AS (ORDER BY cap / w, k)),
targets AS (SELECT k, s, kind, least(cap, max(lv) OVER () * w) AS target FROM levels),
placed AS (
  SELECT doc_id, size, s, kind, target,
         CAST(sum(size) OVER (PARTITION BY sized.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS o
  FROM sized JOIN targets ON sized.k = targets.k),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
    CAST((2 * o + size) / 2.0::DOUBLE <= target AS INT) + CAST((2 * s + 2 * o + size) / 2.0::DOUBLE <= target AS INT)
    + CAST((4 * s + 2 * o + size) / 2.0::DOUBLE <= target AS INT) END AS copies,
    (2 * o + size) / 2.0::DOUBLE / CASE WHEN target > 0 THEN target END AS q
  FROM placed)
SELECT doc_id, size, s AS source_size, round(target, 6) AS target, CAST(copies * size AS BIGINT) AS taken,
       CAST(copies AS INTEGER) AS copies,
       CASE WHEN copies > 0 THEN round(CASE kind
         WHEN 0 THEN q
         WHEN 1 THEN 2 * q / (0.5 + sqrt(0.25 + 2 * q))
         ELSE CASE WHEN q < 0.625 THEN 2 * q / (1.5 + sqrt(2.25 - 2 * q))
              ELSE 0.5 + 2 * (q - 0.625) / (1 + sqrt(greatest(1 - 2 * (q - 0.625), 0))) END END, 6) END AS first_position
FROM counted
"""

"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document, shuffled within its source, gets the virtual finish time
``(words of the source up to and with it) / (target words of the source)``; a
source may be read up to ``max_epochs`` times over, each time adding its whole
size. All copies, sorted by finish time over the whole table and cut where the
words reach the budget, are the mix. Both orders are range partitions: sums of
the partitions before come to each row's own place in its partition, so that
neither a hot source nor the global order, nor rows that share an id or have
none, ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octetloom.llm.common import WORD_RE, broadcast_if_small, materialised
from octetloom.session import spread

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Counted rows up to this number may be ordered by one task.
SMALL_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], n_rows: int) -> DataFrame:
    """``rows`` with the sum of each column of ``sums`` (new name to column) over its group up to and with it, in ``order``.

    ``by`` must not be null and ``order`` must be total. Beyond SMALL_ROWS the
    table is range-partitioned by group and order; each partition adds up its own
    rows of a group, and what comes before it are the sums of the partitions
    ahead, of which a group has as many as there are partitions at most.
    """
    if n_rows <= SMALL_ROWS:
        inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *(F.sum(c).over(inside).alias(name) for name, c in sums.items()))
    cut = materialised(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    parts = cut.groupBy(*by, "__part").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    ahead = Window.partitionBy(*by).orderBy("__part")
    parts = parts.select(*by, "__part", *((F.sum(name).over(ahead) - F.col(name)).alias(f"__{name}") for name in sums))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.select("*", *(F.sum(c).over(inside).alias(name) for name, c in sums.items())).join(parts, [*by, "__part"])
    return out.select(*(F.col(c) for c in rows.columns), *((F.col(name) + F.col(f"__{name}")).alias(name) for name in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source with its number ``n``, ``source_size``, ``target`` and ``budget``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``max_epochs`` times its source's size and the
    excess is shared again by weight until none is above. Filled in one pass over
    the sources by rising ``max_epochs * size / weight``: those before the first
    that stays below its cap are capped. An empty table has no sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int")).cast("long")
    src = materialised(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")))
    n_src = src.count()
    src = running(src, [], [F.col("source").asc_nulls_last()], {"n": "one"}, n_src).withColumn("weight", w)
    src = materialised(src.withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")))
    budget, all_weights = src.agg(F.sum("source_size"), F.sum("weight")).first()
    src = running(src, [], [F.col("ratio"), F.col("n")], {"caps": "cap", "upto": "weight"}, n_src)
    left = F.lit(budget).cast("long") - (F.col("caps") - F.col("cap"))
    weights_left = F.lit(all_weights).cast("long") - (F.col("upto") - F.col("weight"))
    src = materialised(src.withColumn("level", left.cast("double") / weights_left))
    first = src.where(F.col("level") <= F.col("ratio")).agg(F.min(F.struct("ratio", "n", "level"))).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if first is None else F.least(cap, F.col("weight") * F.lit(first["level"]))
    return src.select("source", "n", "source_size", target.alias("target"), F.lit(budget).cast("long").alias("budget"))


def _finish(epoch: int | Column) -> Column:
    return (epoch * F.col("source_size") + F.col("upto")) / F.col("target")


def _place(epoch: int | Column) -> Column:
    """Where a copy stands in the global order."""
    return F.struct(_finish(epoch).alias("finish"), F.col("key").alias("key"), F.col("doc_id").alias("doc_id"), (F.lit(epoch) if isinstance(epoch, int) else epoch).alias("epoch"), F.col("n").alias("n"))


def _last(rows: DataFrame, budget: int, max_epochs: int):
    """The place of the last copy of the mix, or None.

    All copies are range-sorted by place and the partition in which the words
    reach the budget is sorted again, until one task may read it in order.
    """
    copies = rows.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("epoch", F.explode(F.array(*map(F.lit, range(max_epochs)))))
    part, held, passed = copies.select(_place(F.col("epoch")).alias("place"), "size", "row"), 0, []
    n = max_epochs * rows.count()
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while n > SMALL_ROWS:
        cut = materialised(part.repartitionByRange(max(2, min(most, n // SMALL_ROWS + 1)), "place", "row").withColumn("part", F.spark_partition_id()))
        sums = cut.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        sums = sums.select("part", "n", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("ahead"))
        at = sums.where(F.col("ahead") + held <= budget).agg(F.max(F.struct("part", "ahead", "n")).alias("m")).first()["m"]
        if at is None:
            return None
        passed.append(cut.where(F.col("part") < at["part"]))
        part, held, before, n = cut.where(F.col("part") == at["part"]).drop("part"), held + at["ahead"], n, at["n"]
        if n == before:
            break
    order = Window.orderBy("place", "row").rowsBetween(Window.unboundedPreceding, 0)
    ends = part.withColumn("upto", F.sum("size").over(order) + held).where(F.col("upto") <= budget)
    # Where the first copy of the last partition is too much already, the one before it is the last.
    for some in [ends, *passed[::-1]]:
        last = some.agg(F.max("place").alias("m")).first()["m"]
        if last is not None:
            return last
    return None


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str, marked: bool) -> DataFrame:
    """The rows of mix() with what places their copies; ``mark`` is a hash of id, source and text where asked for."""
    mark = F.xxhash64("doc_id", "source", "text") if marked else F.lit(0).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key"), mark.alias("mark"))
    # Rows alike in all that orders them are told apart by a number, which the checkpoint keeps.
    base = materialised(base.withColumn("row", F.monotonically_increasing_id()))
    src = materialised(targets(base, weights, max_epochs))
    n_src, budget = src.agg(F.count("*"), F.max("budget")).first()
    numbered = base.join(broadcast_if_small(src.select(F.col("source").alias("__source"), "n", "source_size", "target"), n_src), base["source"].eqNullSafe(F.col("__source"))).drop("__source")
    rows = materialised(running(numbered, ["n"], [F.col(c) for c in ("key", "doc_id", "size", "row")], {"upto": "size"}, base.count()))
    last = _last(rows, budget, max_epochs) if budget else None
    if last is None:
        copies = F.lit(0)
    else:
        end = F.struct(*(F.lit(last[c]).cast(t).alias(c) for c, t in (("finish", "double"), ("key", "string"), ("doc_id", "long"), ("epoch", "int"), ("n", "long"))))
        copies = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((_place(e) <= end).cast("int") for e in range(max_epochs))).otherwise(0)
    return rows.withColumn("copies", copies.cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and copies.

    ``copies`` (0 to ``max_epochs``) is how often the mix holds the document and
    ``taken`` the words that makes. A null text is empty and empty texts are never
    taken; a null source is a source of its own; a null doc_id is ordered as the
    empty string; repeated rows count as separate documents that follow each
    other; an empty table gives an empty result. The shuffle depends on doc_id
    and ``seed`` alone, so reruns agree. Other columns are ignored.
    """
    rows = _mixed(docs, weights, max_epochs, seed, False)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``, sorted by finish time.

    Rows find their copies by a hash of doc_id, source and text. Rows alike in all
    three are numbered on both sides; which of them stands for which makes no
    difference but in columns that the mix doesn't know. Nulls and empty tables
    are as in mix().
    """
    names = docs.columns
    taken = materialised(_mixed(docs, weights, max_epochs, seed, True))
    alike = materialised(taken.groupBy("mark").count().where("count > 1").select("mark"))
    n_alike = alike.count()
    place = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), _place)
    places = taken.where("copies > 0").select("mark", "row", place.alias("__places"))
    own = docs.withColumn("mark", F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")))
    if not n_alike:
        out = own.join(places.drop("row"), "mark")
    else:
        one = F.lit(1).cast("long")
        held = materialised(taken.join(alike, "mark", "left_semi").select("mark", "row", "copies", place.alias("__places")).withColumn("one", one))
        held = running(held, ["mark"], [F.desc("copies"), F.col("row")], {"number": "one"}, held.count())
        same = materialised(own.join(alike, "mark", "left_semi").withColumn("one", one).withColumn("__row", F.monotonically_increasing_id()))
        same = running(same, ["mark"], [F.col("__row")], {"number": "one"}, same.count())
        same = same.join(held.where("copies > 0").select("mark", "number", "__places"), ["mark", "number"])
        out = own.join(alike, "mark", "left_anti").join(places.drop("row"), "mark").select(*names, "__places").unionByName(same.select(*names, "__places"))
    return out.select(*names, F.explode("__places").alias("__place")).orderBy("__place").select(*names)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Mix all documents with the production weights."""
    return mix(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s0),
s2 AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
              sum(source_size) OVER ()::BIGINT AS budget, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, cap::DOUBLE / weight AS ratio FROM s2),
s4 AS (SELECT *, (budget - (sum(cap) OVER (ORDER BY ratio, n ROWS UNBOUNDED PRECEDING) - cap))::DOUBLE
                 / (sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s3),
s5 AS (SELECT *, first_value(level) OVER (ORDER BY CASE WHEN level <= ratio THEN 0 ELSE 1 END, ratio, n) AS lv,
              bool_or(level <= ratio) OVER () AS any_open FROM s4),
src AS (SELECT source, source_size, budget, CASE WHEN any_open THEN least(cap::DOUBLE, weight * lv) ELSE cap::DOUBLE END AS target FROM s5),
rows AS (
  SELECT b.doc_id, b.size, b.key, s.source_size, s.target, s.budget,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM base b JOIN src s ON b.source IS NOT DISTINCT FROM s.source),
copies AS (
  SELECT doc_id, size, budget, key, e, (e * source_size + upto)::DOUBLE / target AS finish
  FROM rows, (VALUES (0), (1), (2)) t(e) WHERE size > 0 AND target > 0),
ends AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, e ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
held AS (SELECT doc_id, count(*) AS copies FROM ends WHERE upto <= budget GROUP BY doc_id)
SELECT r.doc_id, r.size, r.source_size, r.target, (coalesce(h.copies, 0) * r.size)::BIGINT AS taken
FROM rows r LEFT JOIN held h ON r.doc_id = h.doc_id
"""

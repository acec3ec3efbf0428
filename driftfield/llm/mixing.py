"""Mixing sources to target weights by weighted fair queueing.

Every document waits in its source's queue in a shuffled but repeatable order. Its virtual finish time is the source's cumulative
word count divided by the source's target; a second pass through the source goes on counting. All passes of all sources are then
sorted by finish time, and the mix is what comes before the total budget is used up.

Sizes are word counts. No window runs over a whole source: prefix sums are split by ranges of the shuffle key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftfield.llm.blocks import WORD_PATTERN, unused_name
from driftfield.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
_KEYS = 2.0**52


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """52 bits that depend on the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, slot, source_size, n_docs, target), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words. A target stops at ``passes`` times
    its source's words; the excess goes to the others by weight. The level that results is the largest that any number of capped
    sources, fewest words per weight first, leaves to the rest.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("slot") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("slot", order.cast("long")).withColumn("_weight", weight).withColumn("_most", F.col("source_size") * float(passes))
    before = W.orderBy(F.col("_most") / F.col("_weight"), "slot").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    budget = F.sum("source_size").over(everything) * float(share)
    level = (budget - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("_level", level)
        .withColumn("target", F.least(F.col("_most"), F.max("_level").over(everything) * F.col("_weight")))
        .select("source", "slot", "source_size", "n_docs", "target")
    )


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, slot, source_size, target, key, cumulative): each document's place in its source's queue."""
    text = F.col("text")
    size = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD_PATTERN))).cast("long")
    sized = cut_lineage(docs.select("doc_id", "source", size.alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key")))
    targets = source_targets(sized, weights, share, passes).withColumnRenamed("source", "_source")
    pieces = F.ceil(F.sqrt(F.col("n_docs")))  # about as many pieces as documents in each
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source")
    placed = placed.withColumn("_piece", F.least(F.floor(F.col("key") * pieces / F.lit(_KEYS)), pieces - 1))
    earlier = F.coalesce(F.sum("_sum").over(W.partitionBy("slot").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy("slot", "_piece").agg(F.sum("size").alias("_sum")).select("slot", "_piece", earlier.alias("_earlier"))
    inside = W.partitionBy("slot", "_piece").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.withColumn("_inside", F.sum("size").over(inside))
        .join(sums, ["slot", "_piece"])
        .select("doc_id", "source", "size", "slot", "source_size", "target", "key", (F.col("_earlier") + F.col("_inside")).alias("cumulative"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs(doc_id, text, source)``.

    ``copies`` says how often the mix has the document (0 to ``passes``), ``taken`` how many words these are. The mix ends before the
    first document that would exceed the budget, so a source misses its target by less than a document. Null text has size 0; a source
    without words has target 0 and no copies. Rows that repeat an id are queued as rows of their own. An empty table gives an empty one.
    """
    queued = cut_lineage(queue(docs, weights, share, passes, seed))
    place = ["finish", "slot", "key", "turn"]
    finish = lambda turn: (turn * F.col("source_size") + F.col("cumulative")) / F.when(F.col("target") > 0, F.col("target"))
    turns = queued.select("slot", "key", "size", F.explode(F.array(*[F.lit(float(p)) for p in range(passes)])).alias("turn"), "source_size", "cumulative", "target")
    turns = turns.withColumn("finish", finish(F.col("turn"))).where("finish is not null").select(*place, "size")
    # the globally sorted mix; its parts are numbered, so that cumulative sizes need one sum per part
    ordered = cut_lineage(turns.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("part", F.spark_partition_id()))
    budget = queued.groupBy("slot").agg(F.first("source_size").alias("s")).agg(F.sum("s") * float(share)).first()[0] or 0.0
    upto = F.sum("part_size").over(W.orderBy("part"))
    parts = ordered.groupBy("part").agg(F.sum("size").alias("part_size")).withColumn("upto", upto)
    crossing = parts.where(F.col("upto") > budget).orderBy("part").first()
    cut = None
    if crossing is not None:
        rest = budget - (crossing["upto"] - crossing["part_size"])
        here = ordered.where(F.col("part") == crossing["part"]).withColumn("_upto", F.sum("size").over(W.orderBy(*place).rowsBetween(W.unboundedPreceding, W.currentRow)))
        cut = here.where(F.col("_upto") > rest).orderBy(*place).select(*place).first()
    copies = F.lit(0)
    for turn in range(passes):
        at = finish(F.lit(float(turn)))
        ahead = at.isNotNull()
        if cut is not None:
            ahead &= F.struct(at, "slot", "key", F.lit(float(turn))) < F.struct(F.lit(cut["finish"]), F.lit(cut["slot"]).cast("long"), F.lit(cut["key"]).cast("long"), F.lit(cut["turn"]))
        copies += F.coalesce(ahead.cast("int"), F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix has it; columns unchanged.

    Rows equal in id and source are taken equally often, as the most taken of them.
    """
    chosen = mix(docs, **options).groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).where("copies > 0")
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "copies")
    joined = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_id"]) & docs["source"].eqNullSafe(chosen["_source"]))
    turn = unused_name("turn", docs.columns)
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), chosen["copies"])).alias(turn)).drop(turn)


#: For op1: targets as the level that any number of capped sources leaves; finish times with whole-table windows.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS key
  FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS slot FROM sources),
weighed AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[slot % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lev
  FROM weighed WINDOW before AS (ORDER BY most / weight, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (SELECT source, slot, source_size, least(most, max(lev) OVER () * weight) AS target FROM levels),
queue AS (
  SELECT doc_id, size, key, slot, source_size, target,
         sum(size) OVER (PARTITION BY slot ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), turns AS (
  SELECT *, (turn * source_size + cumulative)::DOUBLE / target AS finish FROM queue, (VALUES (0), (1)) AS t(turn) WHERE target > 0
), mixed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, slot, key, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM turns
), taken AS (SELECT doc_id, sum(size) AS taken FROM mixed WHERE upto <= (SELECT sum(size) * 1.5 FROM sized) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queue LEFT JOIN taken USING (doc_id)
"""

"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, running_sum, table, written

#: The golden ratio's fractional part; slot i of the schedule lies at the fractional part of (i + 0.5) * GOLDEN.
GOLDEN = 0.6180339887498949


def sized(docs: DataFrame) -> DataFrame:
    """Adds size: the number of words (null text: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, size): one row per source with source_size, target, position.

    Sources by code point (null last) weigh by `weights`, repeating; together they get share * all sizes. A target
    stops at most * source_size; what is over is dealt to the others by weight until none is above: target =
    min(most * source_size, level * weight), with the level found by prefix sums over the sources in the order of
    most * source_size / weight. The windows see one row per source. All sizes 0: targets 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    n = len(weights)
    per = per.withColumn("position", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % n + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size"))
    by = everything.orderBy(F.col("cap") / F.col("weight"), "position")
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("after", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("before")) / F.col("after"))
    # the level holds from the first source on that doesn't reach its cap at it
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "position", target.cast("double").alias("target"))


def with_blocks(targets: DataFrame, block: int, least: int) -> DataFrame:
    """Adds n_blocks (about `block` words each, `least` blocks at least where there are so many words) and slots wanted."""
    n = F.greatest(F.ceil(F.col("source_size") / block), F.least(F.col("source_size"), F.lit(least))).cast("long")
    return targets.withColumn("n_blocks", n).withColumn("wanted", F.when(n > 0, F.col("target") * n / F.col("source_size")).otherwise(0.0))


def schedule(blocks: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(slot, source, rank, block, epoch): slot i's golden-ratio point is mapped through the sources' cumulative weights.

    The slots are a range, made where they are used. A slot's rank in its source is found in two steps (within a
    chunk of slots, then over the chunks), so no task holds a source. Rank k takes block k mod n_blocks in epoch
    k div n_blocks; a source stops at twice its blocks.
    """
    spark = blocks.sparkSession
    everything = Window.partitionBy()
    by = everything.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    cum = blocks.where("wanted > 0").withColumn("hi", F.sum("wanted").over(by)).withColumn("lo", F.col("hi") - F.col("wanted")).withColumn("all", F.sum("wanted").over(everything))
    cum = cum.select("source", "position", "n_blocks", "lo", "hi", "all")
    total = blocks.agg(F.sum("wanted")).first()[0] or 0.0
    slots = int(round(total))
    grid = 4096  # points and sources meet on cells of this grid first: an equi-join on cells, then an exact comparison
    cell = lambda x: F.least(F.floor(x / F.col("all") * grid), F.lit(grid - 1)).cast("int")
    cum = cum.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    point = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = spark.range(slots).withColumn("point", point - F.floor(point)).withColumn("cell", F.floor(F.col("point") * grid).cast("int"))
    hit = points.join(cum, "cell").where((F.col("point") * F.col("all") >= F.col("lo")) & (F.col("point") * F.col("all") < F.col("hi")))
    ranked = running_sum(hit.withColumn("__one", F.lit(1)), ["position"], [F.col("id")], "__one", "rank", F.floor(F.col("id") / chunk))
    ranked = ranked.where(F.col("rank") < 2 * F.col("n_blocks"))
    return ranked.select(F.col("id").alias("slot"), "source", "position", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"), F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"))


def _mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 8192, least: int = 2000, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """What mix() returns, with position and the block of a document's first word, and the schedule."""
    key = F.xxhash64("doc_id", "text").alias("key")
    d = written(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", key), "mix-sizes")
    targets = written(with_blocks(source_targets(d, weights, share, most), block, least), "mix-targets")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    small = d.withColumn("__h", order)
    # hash prefixes as buckets: 4096 to a source, each sorted by itself
    placed = running_sum(small, ["source"], [F.col("__h"), F.col("doc_id"), F.col("size")], "size", "start", F.substring("__h", 1, 3))
    placed = placed.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "d.size", "d.key", "d.start", "t.source_size", "t.position", "t.target", "t.n_blocks")
    # block b holds words floor(b * source_size / n_blocks) up to the next block's; the last word's block: see below
    edge = lambda b: F.floor(b.cast("decimal(38,0)") * F.col("source_size") / F.col("n_blocks")).cast("long")
    of = lambda w: F.floor(((w.cast("decimal(28,0)") + 1) * F.col("n_blocks") - 1) / F.col("source_size")).cast("long")
    touched = placed.where("size > 0").withColumn("block", F.explode(F.sequence(of(F.col("start")), of(F.col("start") + F.col("size") - 1))))
    touched = touched.withColumn("part", F.least(edge(F.col("block") + 1), F.col("start") + F.col("size")) - F.greatest(edge(F.col("block")), F.col("start")))
    slots = schedule(targets)
    times = slots.groupBy("position", "block").agg(F.count("*").alias("times"))
    taken = touched.join(times, ["position", "block"]).groupBy("position", "start").agg(F.sum(F.col("part") * F.col("times")).alias("taken"))
    # (position, start) names a document that has words
    out = placed.join(taken, ["position", "start"], "left")
    took = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken")
    first = F.when(F.col("size") > 0, of(F.col("start"))).alias("first_block")
    return out.select("doc_id", "source", "size", "source_size", "target", took, "key", "position", first), slots


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (the words that the mix takes of it) of docs (doc_id, text, source),
    and key, the hash of doc_id and text. Settings: weights, share, most (see source_targets), block and least (with_blocks), seed.

    Each source's documents are shuffled (by a keyed hash of doc_id, then doc_id, then size), laid end to end and cut
    into n_blocks blocks of equal words (up to one); the schedule says how often each block is taken. A document takes
    from each block it touches. Prefix sums run in buckets of the hash, so a hot source is spread over many tasks.
    Null text or no words: taken 0. Null source: a source of its own. Repeated rows: each counts. Empty table: no rows.
    """
    return _mix(docs, **settings)[0].drop("position", "first_block")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """docs as the mix has them, in the order of the schedule; columns as in docs. Settings as for mix().

    A document stands as a whole as often as all of it is taken, and once more as a piece, its first words, where some of it
    is; so each source has the words that are taken of it. A copy stands at the slot of its first block in its epoch. Rows are
    dealt out by ranges of slots and sorted, so that any stretch of the output has the sources by their weights. n_chars, if
    there, follows the text of a piece. Documents without words go. Repeated rows (equal doc_id and text) are taken together.
    """
    took, slots = _mix(docs, **settings)
    slots = written(slots.select("slot", "position", "block", "epoch"), "mix-slots", narrow=True)
    # equal rows are one with all that is taken of them; the place is that of the first
    at = F.min(F.struct("position", "first_block")).alias("at")
    per = took.where("taken > 0").groupBy("key").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"), at)
    per = per.select("key", "size", F.expr("taken div size").alias("whole"), (F.col("taken") % F.col("size")).alias("rest"), "at.position", F.col("at.first_block").alias("block"))
    each = per.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") + (F.col("rest") > 0).cast("long") - 1)))
    each = each.join(slots, ["position", "block", "epoch"], "left")
    # a copy beyond what the schedule has of its first block goes anywhere
    n = (slots.agg(F.max("slot")).first()[0] or 0) + 1
    slot = F.coalesce("slot", F.pmod(F.xxhash64("key", "epoch"), F.lit(n)))
    each = each.select("key", slot.alias("slot"), F.when(F.col("epoch") >= F.col("whole"), F.col("rest")).alias("words"))
    key, nth, place, words, own = free_names(docs, "_key", "_nth", "_slot", "_words", "_own")
    each = each.withColumnsRenamed({"key": own, "slot": place, "words": words})
    d = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    d = d.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy("doc_id"))).where(F.col(nth) == 1)
    d = d.join(each, F.col(key) == F.col(own))
    piece = F.regexp_substr("text", F.concat(F.lit(rf"^(?:[\x20\x09-\x0D]*+{WORD}+){{"), F.col(words).cast("string"), F.lit("}+")))
    d = d.withColumn("text", F.when(F.col(words).isNull(), F.col("text")).otherwise(piece))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(words).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return d.repartitionByRange(place, key).sortWithinPartitions(place, key).select(*docs.columns)


def op10_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Source i has size s_i (words) and weight w_i. Targets share the total of all
sizes by weight; a target above ``epochs`` * s_i is clamped there and what it
leaves is shared by the others in proportion to their weights, until none is
above. With e_i = target_i / s_i, every document of the source is taken
floor(e_i) times, and documents are taken once more in the order of a seeded
hash until the fraction's words are reached. The place where to stop is found
from sums over 1024 ranges of the hash and over 1024 ranges inside the one that
holds it, so no source is sorted or gathered.

Sources are ordered by code point, the null source last. Null texts have no
words. A source without words has target 0 and gives nothing; rows with size 0
are never taken. The hash is of id and text; rows that repeat both, with or
without an id, are numbered, so that the fraction divides them too. Results do
not depend on partitioning. An empty table gives an
empty result; extra columns pass through ``repeated`` and names of helper
columns start with ``mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
RANGES = 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes`` (one row per source) with weights that repeat in source order."""
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    turn = place % len(cycle)
    return sizes.withColumn("mix_weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (turn + 1).cast("int")))


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(mix_source, mix_size, mix_weight) with mix_target; each round is one small aggregate."""
    total = sizes.agg(F.sum("mix_size")).first()[0] or 0
    most = F.col("mix_size") * epochs
    level = 0.0
    while True:
        over = most < F.lit(level) * F.col("mix_weight")
        row = sizes.agg(F.sum(F.when(over, most).otherwise(0)).alias("clamped"), F.sum(F.when(over, 0.0).otherwise(F.col("mix_weight"))).alias("free")).first()
        if not row["free"] or (new := (total - row["clamped"]) / row["free"]) <= level:
            break
        level = new
    return sizes.withColumn("mix_target", F.least(most.cast("double"), F.lit(level) * F.col("mix_weight")))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_copy: 0, or the number of a row among those equal in all columns.

    Only rows that repeat an id and a text are gathered, by partial aggregates,
    and made anew from their counts; equal rows are interchangeable.
    """
    text = F.xxhash64("text")
    again = docs.groupBy(F.col("doc_id").alias("mix_id"), text.alias("mix_text")).count().where("count > 1").select("mix_id", "mix_text")
    again = saved(again)
    if again.isEmpty():
        return docs.withColumn("mix_copy", F.lit(0))
    same = F.col("doc_id").eqNullSafe(F.col("mix_id")) & (text == F.col("mix_text"))
    counted = docs.join(again, same, "left_semi").groupBy(*docs.columns).agg(F.count("*").cast("int").alias("mix_count"))
    made = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_count") - 1))).drop("mix_count")
    return docs.join(again, same, "left_anti").withColumn("mix_copy", F.lit(0)).unionByName(made)


def plan(docs: DataFrame, seed: str = "mix", cycle: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): rows with mix_key, mix_size and mix_u; sources with targets, whole repetitions and the stop."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "mix_copy", "text")]
    key = F.concat(F.lit(f"{seed}:"), told[0], F.lit(":"), told[1], F.lit(":"), told[2])
    u = F.conv(F.substring(F.md5(key), 1, 5), 16, 10).cast("long")  # 20 bits
    rows = numbered(docs).withColumn("mix_size", words(F.col("text"))).withColumn("mix_u", u)
    narrow = saved(rows.select(F.col("source").alias("mix_source"), "mix_size", "mix_u"))
    sizes = saved(narrow.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_size")))
    aimed = saved(targets(saved(weights(sizes, cycle)), epochs))
    ratio = F.when(F.col("mix_size") > 0, F.col("mix_target") / F.col("mix_size")).otherwise(0.0)
    aimed = aimed.withColumn("mix_whole", F.floor(ratio).cast("long")).withColumn("mix_want", F.col("mix_target") - F.col("mix_whole") * F.col("mix_size"))
    aimed = saved(aimed.withColumn("mix_key", _key()).drop("mix_source").withColumnRenamed("mix_size", "mix_total"))

    def stop_in(sums: DataFrame) -> DataFrame:
        """Sums so far, range by range; a source has at most RANGES of them."""
        so_far = F.sum("mix_sum").over(Window.partitionBy("mix_key").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, 0))
        return sums.withColumn("mix_end", so_far)

    keyed = narrow.withColumn("mix_key", _key())
    coarse = stop_in(keyed.groupBy("mix_key", F.floor(F.col("mix_u") / RANGES).alias("mix_range")).agg(F.sum("mix_size").alias("mix_sum")))
    held = coarse.join(aimed.select("mix_key", "mix_want"), "mix_key").where("mix_end > mix_want AND mix_end - mix_sum <= mix_want")
    held = saved(held.select("mix_key", "mix_range", "mix_want", (F.col("mix_end") - F.col("mix_sum")).alias("mix_base")))
    inside = keyed.join(held.select("mix_key", F.col("mix_range").alias("mix_held")), "mix_key").where(F.floor(F.col("mix_u") / RANGES) == F.col("mix_held"))
    fine = stop_in(inside.groupBy("mix_key", (F.col("mix_u") % RANGES).alias("mix_range")).agg(F.sum("mix_size").alias("mix_sum")))
    fine = fine.join(held.withColumnRenamed("mix_range", "mix_held"), "mix_key")
    # a fine range is in if that brings the sum nearer to the wanted one
    nearer = F.col("mix_base") + F.col("mix_end") - F.col("mix_sum") / 2 <= F.col("mix_want")
    fine = fine.groupBy("mix_key", "mix_held").agg(F.max(F.when(nearer, F.col("mix_range"))).alias("mix_last"))
    stops = fine.select("mix_key", (F.col("mix_held") * RANGES + F.coalesce(F.col("mix_last") + 1, F.lit(0))).alias("mix_stop"))
    sources = saved(aimed.join(stops, "mix_key", "left").withColumn("mix_stop", F.coalesce("mix_stop", F.lit(0))))
    return rows.withColumn("mix_key", F.struct(F.coalesce(F.col("source"), F.lit("")).alias("name"), F.col("source").isNull().alias("none"))), sources


def _key() -> Column:
    return F.struct(F.coalesce(F.col("mix_source"), F.lit("")).alias("name"), F.col("mix_source").isNull().alias("none"))


def mixed(docs: DataFrame, seed: str = "mix", cycle: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """``docs`` with mix_size, mix_total, mix_target and mix_times (0 to ``epochs``)."""
    rows, sources = plan(docs, seed, cycle, epochs)
    times = F.least(F.col("mix_whole") + (F.col("mix_u") < F.col("mix_stop")).cast("long"), F.lit(epochs))
    out = rows.join(sources, "mix_key").withColumn("mix_times", F.when(F.col("mix_size") > 0, times).otherwise(F.lit(0)).cast("long"))
    return out.select(*docs.columns, "mix_size", "mix_total", "mix_target", "mix_times")


def repeated(docs: DataFrame, seed: str = "mix", cycle: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    chosen = mixed(docs, seed, cycle, epochs).where("mix_times > 0")
    return chosen.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times").cast("int")))).select(*docs.columns)

"""Exact duplicates by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes.  Sorting
equal-length blocks gives each distinct block an integer name; then adjacent names
are paired and the pairs are named the same way, halving the number of names a
document has, until one is left.  Names come from sorting the things
themselves, so two documents of one length share their last name exactly if their texts
are equal: no hash decides.

A name is (salt, bucket, rank in the bucket) in one long.  Equal blocks share a
bucket; a block found in more than ``hot_share`` of a level's rows is *hot* (at
most 1 / hot_share of them exist): its rows are dealt over ``salts`` groups and one representative
per group is sorted again, so no group of copies meets in one task.  Only the
blocks move once; all later levels move integers.

Everything is DataFrame code.  Defined cases: null counts as empty; repeated
rows (equal id and text) are one group of which one row stays; null ids count as
larger than any id; an empty table gives an empty result; extra columns stay
untouched (``deduplicated``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise.llm.common import empty_if_null, saved

BLOCK = 4096
SALTS = 32
HOT_SHARE = 1e-4
_RANK_BITS, _BUCKET_BITS = 40, 16


def normalised(text: str = "text") -> Column:
    """Each run of white space as one space; runs that are one space are not touched."""
    return F.regexp_replace(empty_if_null(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _packed(salt: Column, bucket: Column, rank: Column) -> Column:
    return (F.shiftleft(salt.cast("bigint"), _RANK_BITS + _BUCKET_BITS)
            .bitwiseOR(F.shiftleft(bucket.cast("bigint"), _RANK_BITS)).bitwiseOR(rank.cast("bigint")))


def named(things: DataFrame, what: list[str], carry: list[str], hashes: DataFrame, buckets: int,
          salts: int = SALTS, hot_share: float = HOT_SHARE) -> DataFrame:
    """``carry`` columns plus ``name``: equal exactly for rows equal in ``what``.

    ``hashes`` has a hash column ``h`` per row of ``things`` (cheap to scan): hashes above
    ``hot_share`` of the rows mark hot things.  The hash only deals rows to tasks."""
    n = hashes.count()
    hot = (hashes.groupBy("h").count().where(F.col("count") > F.lit(max(1000.0, n * hot_share)))
           .select(F.col("h").alias("_hot")))                 # at most 1 / hot_share rows
    t = things.withColumn("_th", F.xxhash64(*what))
    t = t.join(F.broadcast(hot), F.col("_th") == F.col("_hot"), "left")
    t = (t.withColumn("_bucket", F.pmod("_th", F.lit(buckets)))
         .withColumn("_salt", F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*carry), F.lit(salts))).otherwise(0)))
    order = Window.partitionBy("_salt", "_bucket").orderBy(*what)
    t = (t.withColumn("_rank", F.dense_rank().over(order))
         .withColumn("_first", F.row_number().over(order) == F.rank().over(order))
         .withColumn("_local", _packed(F.col("_salt"), F.col("_bucket"), F.col("_rank"))))
    # One row per distinct thing and salt group of the hot ones is sorted again.
    chosen = (F.col("_salt") > 0) & F.col("_first")
    t = t.select(*carry, "_local", "_bucket", (F.col("_salt") > 0).alias("_is_hot"),
                 *[F.when(chosen, F.col(c)).alias(f"_r{i}") for i, c in enumerate(what)],
                 chosen.alias("_chosen"))
    t = saved(t, "names")
    again = Window.partitionBy("_bucket").orderBy(*[f"_r{i}" for i in range(len(what))])
    merged = (t.where("_chosen").withColumn("_rank", F.dense_rank().over(again))
              .select(F.col("_local").alias("_from"),
                      _packed(F.lit(salts + 1), F.col("_bucket"), F.col("_rank")).alias("_to")))
    # At most salts / hot_share rows of two longs.
    out = t.join(F.broadcast(merged), t["_local"] == merged["_from"], "left")
    return out.select(*carry, F.coalesce("_to", "_local").alias("name"))


def identities(docs: DataFrame, block: int = BLOCK, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, names).  rows: (doc_id, _h, n_bytes, text_sha256) per row of ``docs``; names: (doc_id,
    _h, n_bytes, name) per distinct (doc_id, _h), name equal exactly for equal texts of one length."""
    spark = docs.sparkSession
    buckets = buckets or min(1 << _BUCKET_BITS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised().alias("_norm"))
    base = base.withColumn("_b", F.col("_norm").cast("binary"))
    size = F.octet_length("_b").cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(size - 1, F.lit(0)), F.lit(block).cast("bigint"))

    def piece(s: Column) -> Column:
        return F.substring(F.col("_b"), (s + 1).cast("int"), F.lit(block))
    rows = saved(base.select("doc_id", F.xxhash64("_b").alias("_h"), size.alias("n_bytes"),
                             F.sha2("_b", 256).alias("text_sha256"),
                             F.transform(starts, lambda s: F.xxhash64(piece(s))).alias("_hs")), "exact-rows")
    most = rows.agg(F.max("n_bytes")).first()[0]
    cut = (base.select("doc_id", F.xxhash64("_b").alias("_h"), size.alias("n_bytes"), "_b", F.explode(starts).alias("_s"))
           .select("doc_id", "_h", "n_bytes", (F.col("_s") / block).cast("bigint").alias("i"), piece(F.col("_s")).alias("_block")))
    key = ["doc_id", "_h", "n_bytes"]
    # Blocks of repeated rows are named twice with one name; the first level drops the repeats.
    names = named(cut, ["_block"], [*key, "i"], rows.select(F.explode("_hs").alias("h")), buckets)
    done, level = [], 0
    blocks = math.ceil(max(most or 1, 1) / block)
    while True:
        # How many names a document has on this level follows from its length.
        left = F.ceil(F.greatest(F.col("n_bytes"), F.lit(1)) / F.lit(float(block) * 2 ** level))
        done.append(names.where((left == 1) & ((F.lit(level) == 0) | (F.ceil(F.greatest(F.col("n_bytes"), F.lit(1))
                    / F.lit(float(block) * 2 ** max(level - 1, 0))) > 1))).select(*key, "name"))
        if blocks <= 1:
            break
        pairs = (names.where(left > 1).groupBy(*key, F.expr("i div 2").alias("i"))
                 .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")))
        pairs = saved(pairs.withColumn("h", F.xxhash64("a", "b")), "pairs")
        names = named(pairs, ["a", "b"], [*key, "i"], pairs.select("h"), buckets)
        blocks = math.ceil(blocks / 2)
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return rows.drop("_hs"), out.distinct()


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, _h, keep_id, group_size, kept, text_sha256."""
    rows, names = identities(docs, block)
    light = rows.groupBy("doc_id", "_h", "n_bytes", "text_sha256").agg(F.count("*").alias("_m"))
    ident = F.struct("doc_id", "_h", "n_bytes")
    j = saved(light.withColumn("_k", ident).join(names.select(ident.alias("_k"), "name"), "_k").drop("_k"), "identities")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id"), F.col("_h")))
    groups = saved(j.groupBy("n_bytes", "name").agg(least.alias("_least"), F.sum("_m").alias("group_size")), "groups")
    g = j.join(groups, ["n_bytes", "name"])
    return g.select("doc_id", "_h", F.col("_least.doc_id").alias("keep_id"), "group_size",
                    F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m"))).alias("_copy"),
                    (F.col("doc_id").eqNullSafe(F.col("_least.doc_id"))).alias("_is"), "text_sha256") \
        .select("doc_id", "_h", "keep_id", "group_size", (F.col("_is") & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows with one id and text
    the smallest in column order."""
    stay = (exact_groups(docs, block).where("kept")
            .select(F.struct("doc_id", "_h").alias("_key"), F.lit(True).alias("_stay")))
    own = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"),
                   F.xxhash64(normalised().cast("binary")).alias("_h"))
    j = docs.select(F.struct("*").alias("row"), own.alias("_key")).join(stay, "_key", "left_semi")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("row"))
    return j.withColumn("_nth", nth).where("_nth = 1").select("row.*")

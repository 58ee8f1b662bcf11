"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / size`` times on average:
a whole number of copies plus a fraction.  The fractions of two documents are
paired: mass, counted in words, moves at random from one to the other until one
fraction is 0 or 1, and the other document goes on with what is left.  The
expected copies of each document stay what they were and the words of the pair
are kept exactly, so a source misses its target by less than its last document.
Documents of a source are folded in blocks; what is left of each block meets
again on the next level, a reduction tree of fan-in ``fan``.  Random draws are hashes of
the documents' keys, so reruns agree.

Everything is DataFrame code.  No group larger than a block (``fan`` rows on
average, spread by hash) meets in one task.

Defined cases: a null or empty text has size 0, takes its whole copies and a
hashed draw for the rest; null is a source of its own, last in order; repeated
rows are told apart by a number within (doc_id, source, text); an empty table
gives an empty result; without any word all targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise.llm.common import WORD, empty_if_null, saved

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3.0
KEY = ["doc_id", "source", "_h", "_dup"]


def _key(of: str = "", cols: list[str] = KEY) -> Column:
    """One struct to join on: structs are equal where their nulls are."""
    return F.struct(*[F.col(f"{of}{c}").alias(c) for c in cols])


def sized(docs: DataFrame) -> DataFrame:
    """Key columns of each row and ``size``, its number of words."""
    light = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.xxhash64(F.col("text")).alias("_h"),
                        F.regexp_count(empty_if_null(), F.lit(WORD)).cast("bigint").alias("size"))
    same = Window.partitionBy("doc_id", "source", "_h").orderBy("size")
    return light.withColumn("_dup", F.row_number().over(same))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """Add ``target`` to (source, source_size): weights by rank of the source name
    (code points, null last), sharing the total, none above ``max_copies`` times
    its size.

    Water-filling in closed form: sources are filled in order of cap / weight;
    with the first k at their caps, the rest share what is left by weight, and
    that share rises with k until it no longer passes the next cap / weight, and falls
    after: the level of the filling is the largest share that passes no cap."""
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (((F.row_number().over(named) - 1) % len(weights)) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_copies))
    s = sources.withColumn("_w", w).withColumn("_cap", cap)
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every).cast("double")
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    s = s.withColumn("_lambda", F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(every))
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_lambda"), F.lit(1e300)) * F.col("_w"))) \
        .drop("_w", "_cap", "_level", "_lambda")


def _draw(*cols: Column) -> Column:
    """Uniform in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


_ITEM = "struct<doc_id:bigint,source:string,_h:bigint,_dup:int,w:double,p:double>"
EPS = 1e-9


def _fold(items: Column, seed: int) -> Column:
    """Sequential pivotal rounding of a block: struct(out, rest).  ``out`` holds the
    items whose fraction became 0 or 1, ``rest`` the one still between, if any."""
    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("out"), F.lit(None).cast(_ITEM).alias("rest"))

    def as_p(x: Column, p: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in [*KEY, "w"]], p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        c = acc["rest"]
        up = F.least((1 - c["p"]) * c["w"], x["p"] * x["w"])          # words that can move to c
        down = F.least(c["p"] * c["w"], (1 - x["p"]) * x["w"])        # words that can move to x
        u = _draw(F.lit(seed), c["doc_id"], c["_h"], c["_dup"], x["doc_id"], x["_h"], x["_dup"])
        moved = F.when(u * (up + down) < down, up).otherwise(-down)
        pair = F.struct(as_p(c, c["p"] + moved / c["w"]).alias("c"), as_p(x, x["p"] - moved / x["w"]).alias("x"))

        def settle(q: Column) -> Column:
            both = F.array(q["c"], q["x"])
            whole = F.filter(both, lambda i: (i["p"] < EPS) | (i["p"] > 1 - EPS))
            part = F.filter(both, lambda i: (i["p"] >= EPS) & (i["p"] <= 1 - EPS))
            return F.struct(F.concat(acc["out"], whole).alias("out"), F.get(part, F.lit(0)).alias("rest"))
        done = F.element_at(F.transform(F.array(pair), settle), 1)
        return F.when(c.isNull(), F.struct(acc["out"].alias("out"), x.alias("rest"))).otherwise(done)

    return F.aggregate(items, start, step)


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: float = MAX_COPIES, fan: int = 64,
          seed: int = 0) -> DataFrame:
    """Per row of ``docs``: key columns, size, source_size, target and ``copies``, the
    times the mix takes it."""
    light = saved(sized(docs), "mix-sizes")
    sources = saved(targets(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")),
                            weights, max_copies), "mix-targets")
    n = sources.agg(F.max("_n")).first()[0] or 0
    # The source table joins on its (possibly hot) name; both sides are plain
    # exchanges, so the adaptive join splits a hot one.
    rows = light.join(sources, light["source"].eqNullSafe(sources["source"]), "left").select(
        *[light[c] for c in [*KEY, "size"]], "source_size", "target", "_n",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies))))
        .otherwise(0.0).alias("rate"))
    rows = rows.withColumn("_whole", F.floor("rate").cast("bigint")).withColumn("p", F.col("rate") - F.col("_whole"))

    part = (F.col("size") > 0) & (F.col("p") >= EPS) & (F.col("p") <= 1 - EPS)
    item = F.struct(*[F.col(c) for c in KEY], F.col("size").cast("double").alias("w"), F.col("p")).cast(_ITEM)
    live = rows.where(part).select("source", "_n", item.alias("item"))
    settled = []
    levels = max(1, math.ceil(math.log(max(n, 2), fan)))
    for level in range(levels + 1):
        # One block for all that is left of a source on the last level.
        blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / float(fan) ** (level + 1))) if level < levels else F.lit(1)
        block = F.pmod(F.xxhash64(F.lit(level + 1), F.lit(seed), *[F.col("item")[c] for c in KEY]), blocks)
        folded = saved(live.groupBy("source", "_n", block.alias("_block"))
                       .agg(F.sort_array(F.collect_list("item")).alias("items"))
                       .select("source", "_n", _fold(F.col("items"), seed).alias("f"))
                       .select("source", "_n", "f.out", "f.rest"), "mix-level")
        settled.append(folded.select(F.explode("out").alias("item")))
        live = folded.where("rest is not null").select("source", "_n", F.col("rest").alias("item"))
    last = live.select("item")                      # at most one document a source: a draw decides it
    won = _draw(F.lit(seed), F.lit("last"), F.col("item.doc_id"), F.col("item._h"), F.col("item._dup")) < F.col("item.p")
    taken = last.where(won)
    for s in settled:
        taken = taken.unionByName(s.where("item.p > 0.5"))
    extra = taken.select(_key("item.").alias("_key"), F.lit(1).alias("_extra"))
    joined = rows.withColumn("_key", _key()).join(extra, "_key", "left")
    add = F.when(part, F.coalesce(F.col("_extra"), F.lit(0))).when(F.col("p") > 1 - EPS, 1).when(F.col("p") < EPS, 0) \
        .otherwise((_draw(F.lit(seed), F.col("doc_id"), F.col("_h"), F.col("_dup")) < F.col("p")).cast("int"))
    return joined.select(*KEY, "size", "source_size", "target", (F.col("_whole") + add).alias("copies"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns whatever their names, repeated as often as ``mixed`` takes them; rows with
    one id, source and text are numbered in column order."""
    same = ["doc_id", "source", "_h"]
    chosen = (mixed(docs, **how).groupBy(*same).agg(F.map_from_entries(F.collect_list(F.struct("_dup", "copies"))).alias("_copies"))
              .select(_key(cols=same).alias("_key"), "_copies"))
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("bigint").alias("doc_id"),
                                                             F.col("source").cast("string").alias("source"),
                                                             F.xxhash64(F.col("text")).alias("_h")).alias("_key"))
    numbered = keyed.join(chosen, "_key").withColumn(
        "_dup", F.row_number().over(Window.partitionBy("_key").orderBy("row")))
    n = F.element_at("_copies", F.col("_dup"))
    return (numbered.withColumn("_n", n).where("_n > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_copy"))
            .select("row.*"))

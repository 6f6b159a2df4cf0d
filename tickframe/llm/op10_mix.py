"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents: a whole part that all get, and
a fraction that is rounded. Pivotal rounding pairs two fractional documents of a source and moves mass (size times
fraction) between them, in a random direction whose odds keep both expectations, until one of them is whole; the other
carries the residual to its next pair. Documents are dealt to blocks of bounded size by a hash; each block is folded to
one residual, the residuals of many blocks are folded again, and so on up a tree, until a source has one residual left,
which is rounded by itself. A source's words so miss its target by less than the size of one document.

Equal rows are one item with a count: pairing equals among themselves leaves floor(n p) of n taken once more and one
residual, so a group of copies is one row whatever its size, and its decision is dealt to its rows by arithmetic. Items
carry all that the result needs, so decisions are never joined back to documents.

Only built-in DataFrame functions are used. All randomness is hashes of (seed, doc_id, size, key), so reruns agree.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is dealt like any other.
Rows that agree in doc_id, source and size (and key, see allot) share their copies evenly. Documents of size 0 are taken
zero times. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Mean number of residuals folded in one block of the tree.
BLOCK = 64
#: Rows that one row is repeated to within a task; those of more are split and dealt first.
CHUNK = 1 << 16
#: The words of a text.
WORD = r"[^\x20\x09-\x0D]+"
_TINY = 1e-9


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52))).cast("double") / float(1 << 52)


def size_of(text: str) -> Column:
    """Words of a text column."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def grouped(documents: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, source, size (words), key, n: one row for each group of equal rows; a group is combined before it is shuffled."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of("text").alias("size"), (F.lit(0) if key is None else key).cast("long").alias("key"))
    return own.groupBy("source", "doc_id", "size", "key").agg(F.count(F.lit(1)).alias("n"))


def targets(groups: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, n_rows: one row for each source of groups (source, size, n).

    Sources in order of code points (null last) weigh the given weights, repeating; together they are to have share times
    all words; no target is above most times its source's size, and what is cut goes to the others by weight. With the
    sources in order of (limit over weight), those cut are a prefix; running sums find where it ends. Those sums run over
    one row a source in one sorted, spilling task; everything a document goes through is dealt by (source, block).
    """
    by = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    whole = Window.partitionBy()
    weight = F.array(*(F.lit(float(w)) for w in weights))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(weight, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("limit", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level at which this source and all later ones would share what the earlier ones, cut, leave; it holds from the first uncut one on
    tried = ranked.withColumn("level", level).withColumn("uncut", F.col("level") <= F.col("limit") / F.col("weight"))
    found = tried.withColumn("first", F.min(F.when(F.col("uncut"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(whole))
    return found.select("source", "source_size", F.coalesce(F.least("limit", F.col("first.level") * F.col("weight")), F.col("limit")).alias("target"), "n_rows")


_ITEM = "struct<w: double, p: double, doc_id: bigint, key: bigint, n: bigint, whole: bigint>"


def _fold(items: Column, seed: int) -> Column:
    """struct(left: the one that stays fractional or null, done: all others with p = 0 or 1)."""
    none = F.lit(None).cast(_ITEM)
    start = F.struct(none.alias("left"), F.array().cast(f"array<{_ITEM}>").alias("done"))

    def at(x: Column, p: Column) -> Column:
        return x.withField("p", p.cast("double"))

    def step(state: Column, x: Column) -> Column:
        a = state["left"]
        up = F.least((1 - a["p"]) * a["w"], x["p"] * x["w"])  # mass that can move to a
        down = F.least(a["p"] * a["w"], (1 - x["p"]) * x["w"])  # and to x
        to_a = _uniform(F.lit(seed), F.lit("pivot"), a["doc_id"], a["key"], a["w"], x["doc_id"], x["key"], x["w"]) * (up + down) < down
        move = F.when(to_a, up).otherwise(-down)
        pa, px = a["p"] + move / a["w"], x["p"] - move / x["w"]
        # one of the two is whole up to rounding: of the nearer to a whole number
        a_whole = F.least(pa, 1 - pa) <= F.least(px, 1 - px)
        first = F.struct(F.when(a_whole, at(x, F.least(F.greatest(px, F.lit(0.0)), F.lit(1.0)))).otherwise(at(a, F.least(F.greatest(pa, F.lit(0.0)), F.lit(1.0)))).alias("left"), F.concat(state["done"], F.array(F.when(a_whole, at(a, F.round(pa))).otherwise(at(x, F.round(px))))).alias("done"))
        both = F.when(a.isNull(), F.struct(x.alias("left"), state["done"].alias("done"))).otherwise(first)
        # a residual that is whole by chance needs no partner
        left = both["left"]
        whole = F.least(left["p"], 1 - left["p"]) < _TINY
        return F.when(whole, F.struct(none.alias("left"), F.concat(both["done"], F.array(at(left, F.round(left["p"])))).alias("done"))).otherwise(both)

    return F.aggregate(items, start, step)


def allot(documents: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7, key: Column | None = None) -> DataFrame:
    """doc_id, source, size, key, n, source_size, target, total: the copies that the mix takes of each group of n equal rows.

    key: a long that tells rows of equal doc_id, source and size apart, such as a hash of their other columns.
    """
    groups = common.materialize(grouped(documents, key))
    goal = common.materialize(targets(groups.df, weights, share, most)).df
    return rounded(groups.df, goal, seed)


def rounded(groups: DataFrame, goal: DataFrame, seed: int = 7) -> DataFrame:
    """The groups (doc_id, source, size, key, n) with source_size, target and total."""
    joined = groups.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    ratio = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = joined.withColumn("wanted", ratio * F.col("n")).withColumn("whole", F.floor(F.col("wanted") + F.lit(_TINY)).cast("long"))
    fraction = F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0))
    held = wanted.select("doc_id", "source", "size", "key", "n", "n_rows", "whole", F.when(fraction >= _TINY, fraction).otherwise(F.lit(0.0)).alias("p"))

    # levels of the tree: until the largest source's residuals fit in one block
    largest = goal.agg(F.max("n_rows")).first()[0] or 0
    levels = 1
    while largest > BLOCK**levels:
        levels += 1
    item = F.struct(F.col("size").cast("double").alias("w"), "p", "doc_id", "key", "n", "whole").cast(_ITEM)
    left = held.where("p > 0").select("source", "n_rows", item.alias("x"))
    decided = held.where("p = 0").select("source", "doc_id", "size", "key", "n", F.col("whole").alias("total"))

    def result(rows: DataFrame, one: Column) -> DataFrame:
        return rows.select("source", F.col("x.doc_id").alias("doc_id"), F.col("x.w").cast("long").alias("size"), F.col("x.key").alias("key"), F.col("x.n").alias("n"), (F.col("x.whole") + one).cast("long").alias("total"))

    for level in range(levels):
        blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_rows") / float(BLOCK ** (level + 1)))) if level < levels - 1 else F.lit(1).cast("long")
        dealt = left.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "x.doc_id", "x.key", "x.w"), blocks))
        # large documents first, so that the residual left at the end tends to be small
        folded = dealt.groupBy("source", "block").agg(F.first("n_rows").alias("n_rows"), F.reverse(F.array_sort(F.collect_list("x"))).alias("xs")).select("source", "n_rows", _fold(F.col("xs"), seed).alias("f"))
        folded = common.materialize(folded).df
        decided = decided.unionByName(result(folded.select("source", F.explode("f.done").alias("x")), F.col("x.p")))
        left = folded.where("f.left IS NOT NULL").select("source", "n_rows", F.col("f.left").alias("x"))
    # the last residual of each source stands alone
    alone = _uniform(F.lit(seed), F.lit("last"), F.col("x.doc_id"), F.col("x.key"), F.col("x.w")) < F.col("x.p")
    decided = decided.unionByName(result(left, F.when(alone, 1).otherwise(0)))
    by = goal.select(F.col("source").alias("s"), "source_size", "target")
    return decided.join(by, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def repeated(rows: DataFrame, times: Column, number: str) -> DataFrame:
    """Each row `times` times, numbered from 1; many repetitions are dealt over tasks in chunks."""
    few = rows.where(times <= CHUNK).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    begun = rows.where(times > CHUNK).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), times - 1, F.lit(CHUNK).cast("long")))).repartition(common.shuffle_partitions(rows.sparkSession))
    many = begun.withColumn(number, F.explode(F.sequence(F.col(number) + 1, F.least(times, F.col(number) + CHUNK))))
    return few.unionByName(many)


def mix(documents: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each row of documents."""
    taken = repeated(allot(documents, weights, share, most, seed), F.col("n"), "number")
    copies = F.floor(F.col("total") / F.col("n")) + F.when(F.col("number") <= F.col("total") % F.col("n"), 1).otherwise(0)
    return taken.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def op10_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

"""Ids that outlive a new extraction: sets of members matched by equality, then by containment that is unique on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sets(df: DataFrame) -> DataFrame:
    """``(id, members)`` with the members distinct and in order; sets without a member say nothing."""
    return df.select("id", F.sort_array(F.array_distinct(F.array_compact("members"))).alias("members")).where(F.size("members") > 0)


#: A set of at most so many members is met by all its parts, of which there are less than two to that number.
PARTS_OF = 16
#: Fixed value: words of 64 bits, in which sets leave their digests' bits, so that most parts that no set is are dropped where they are made.
WORDS = 1 << 19


def _label(member: Column) -> Column:
    """A member led by its length, so that different sets never read the same when theirs are put together."""
    return F.concat(F.char_length(member.cast("string")).cast("string"), F.lit(":"), member.cast("string"))


def _digests(members: Column) -> Column:
    """A digest for every part of a set; the bits of its place are its members. A part's is the same in every set, and two may share one."""
    own = F.transform(members, lambda m: F.xxhash64(m))
    return F.aggregate(own, F.array(F.lit(0).cast("long")), lambda found, d: F.concat(found, F.transform(found, lambda x: x.bitwiseXOR(d))))


def _word(digest: Column) -> Column:
    return F.shiftrightunsigned(digest, 6).bitwiseAND(WORDS - 1)


def _parts(large: DataFrame, small: DataFrame) -> DataFrame:
    """``(large, key)``: parts of every set, among them all that are one of ``small``; a part is a number whose bits are its members."""
    bit, half = F.expr("shiftleft(1L, int(_digest & 63))"), PARTS_OF // 2
    own = small.select(F.size("members").alias("n"), F.aggregate("members", F.lit(0).cast("long"), lambda x, m: x.bitwiseXOR(F.xxhash64(m))).alias("_digest"))
    sizes = own.agg(F.expr("bit_or(shiftleft(1, n))").alias("_sizes"))
    # as many rows as there are words at most, however many sets
    words = own.groupBy(_word(F.col("_digest")).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    # a part is one of each half's; their digests are columns, so that compiled code takes them apart, and outer, or Spark would work them out again to see that there are any
    halves = large.join(F.broadcast(sizes)).withColumn("_one", _digests(F.slice("members", 1, half))).withColumn("_two", _digests(F.slice("members", half + 1, half)))
    every = halves.select("id", "members", "_sizes", "_two", F.posexplode_outer("_one").alias("_at", "_digest")).select("id", "members", "_sizes", "_at", "_digest", F.posexplode_outer("_two").alias("_up", "_more"))
    every = every.select("id", "members", "_sizes", F.expr(f"_at | shiftleft(_up, {half})").alias("part"), F.col("_digest").bitwiseXOR(F.col("_more")).alias("_digest"))
    some = every.where("part > 0 AND shiftright(_sizes, int(bit_count(part))) & 1 = 1").withColumn("_word", _word(F.col("_digest")))
    some = some.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    # never null, or Spark would put a part together once more; lambdas stay out of the compiled loop, which is small enough to be fast
    held = F.filter("members", lambda m, i: F.call_function("shiftright", F.col("part"), i).bitwiseAND(1) == 1)
    return some.select(F.col("id").alias("large"), F.concat_ws("", F.transform(held, _label)).alias("key"))


def contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """``(small, large)``: ids of sets and of sets that hold all their members; from ``(id, members)`` each, distinct and in order.

    A large set of at most ``PARTS_OF`` members gives all its parts of a size and a digest that small ones have, and
    a small one meets the part that it is: rows grow with the sets and what they share, however often a member
    occurs. Beyond that size sets meet at the small one's rarest member among those large ones, then are compared
    whole. A set whose members are all unknown to the other side is met by nothing.
    """
    few = small.where(F.size("members") <= PARTS_OF)
    part = _parts(large.where(F.size("members") <= PARTS_OF), few)
    by_part = few.select(F.col("id").alias("small"), F.concat_ws("", F.transform("members", _label)).alias("key")).join(part, "key").select("small", "large")
    each = large.where(F.size("members") > PARTS_OF).select(F.col("id").alias("large"), F.col("members").alias("all"), F.explode("members").alias("member"))
    often = each.groupBy("member").agg(F.count("*").alias("n"))
    known = small.select(F.col("id").alias("small"), F.col("members").alias("few"), F.explode("members").alias("member")).join(often, "member", "left")
    rarest = known.groupBy("small").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "member")).alias("r"), F.any_value("few").alias("few")).where(F.col("r.n") > 0)
    met = rarest.select("small", "few", F.col("r.member").alias("member")).join(each, "member")
    return by_part.union(met.where(F.size(F.array_except("few", "all")) == 0).select("small", "large"))


def _alone(pairs: DataFrame, *sides: str) -> DataFrame:
    for side in sides:
        pairs = pairs.withColumn(f"_{side}", F.count("*").over(Window.partitionBy(side)))
    return pairs.where(" AND ".join(f"_{s} = 1" for s in sides)).drop(*[f"_{s}" for s in sides])


def kept_ids(prior: DataFrame, current: DataFrame) -> DataFrame:
    """``(id, kept, how)``: current sets that take over a prior one's id.

    ``equal``: the same members; of several equal ones the least current takes the
    greatest prior, each once. ``contains``: among the rest, the only current set that holds
    a prior one, and no other prior one.
    """
    old, new = _sets(prior), _sets(current)
    # one row a set, whoever has it; one prior set of equal ones stands for them
    either = old.select("members", F.col("id").alias("kept"), F.lit(None).cast("long").alias("id")).union(new.select("members", F.lit(None).cast("long"), "id"))
    by_set = either.groupBy("members").agg(F.max("kept").alias("kept"), F.min("id").alias("id"), F.max("id").alias("last"), F.count("id").alias("n"))
    # always so, and names every column, and what is asked of members waits for n: all that reads the sets then shares one shuffle of them
    by_set = by_set.where("(n = 0) = (id IS NULL) AND (n = 0) = (last IS NULL) AND (n > 0 OR kept IS NOT NULL)").withColumn("members", F.when(F.col("n") >= 0, F.col("members")))
    left = by_set.where("id IS NULL").select(F.col("kept").alias("id"), "members")
    # of equal current sets two are enough, for then what they hold is held more than once
    two = F.when(F.col("n") > F.when(F.col("kept").isNull(), 1).otherwise(2), F.array("id", "last")).when(F.col("n") > F.when(F.col("kept").isNull(), 0).otherwise(1), F.array("last"))
    open_ = by_set.select(F.explode(two).alias("id"), "members")
    held = _alone(contained(left, open_), "small", "large").select(F.col("large").alias("id"), F.col("small").alias("kept"))
    equal = by_set.where("id IS NOT NULL AND kept IS NOT NULL").select("id", "kept")
    return equal.withColumn("how", F.lit("equal")).union(held.withColumn("how", F.lit("contains")))


def stable_ids(prior: DataFrame, current: DataFrame, bucket: Column) -> DataFrame:
    """``(id, stable, how)`` of every current row: the id taken over, else a new one after the greatest prior, in the order of ``id``.

    Ids are whole numbers. ``bucket`` of ``id`` rises with it and splits the new ones into parts
    that a task can number; the parts' sizes are summed.
    """
    rows = current.select("id").join(kept_ids(prior, current), "id", "left").withColumn("_b", bucket).where("_b IS NOT NULL")
    fresh = F.when(F.col("how").isNull(), 1)
    sizes = rows.groupBy("_b").agg(F.count(fresh).alias("n"))
    before = sizes.select("_b", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    most = prior.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    own = F.count(fresh).over(Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("own", own).join(before, "_b").join(F.broadcast(most))
    return numbered.select("id", F.coalesce("kept", F.col("most") + F.col("before") + F.col("own")).alias("stable"), F.coalesce("how", F.lit("new")).alias("how"))


def rewritten(rows: DataFrame, key: str, column: str, mapping: DataFrame) -> DataFrame:
    """``rows`` with the ids in the array ``column`` replaced by ``mapping(id, stable)``, in place; unknown ones stay, a null array stays null."""
    each = rows.select(F.col(key), F.posexplode(column).alias("_at", "id")).join(mapping.select("id", "stable"), "id", "left")
    back = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("stable", "id").alias("v")))), lambda x: x["v"]).alias("_new"))
    out = rows.join(back, key, "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new")

"""Mixing sources to target weights, with hash-threshold histograms (DataFrame operations only).

Each row has a hash key. Weights are summed by group and key bucket; the bucket in which a group's
budget ends is the only one that is looked at again, in buckets 4,096 times finer, until a bucket
is one key. A row is in if its key is not above its group's cut: no row is sorted, a larger budget
always takes all that a smaller one takes, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from changerisk.llm.shared import set_aside, stored

#: Keys have so many bits; each histogram resolves STEP of them.
BITS, STEP = 48, 12
#: Weights of the sources by code point, in turn, and the share of all sizes that is mixed.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
#: A source is repeated so often at most.
REPEATS = 2.0

_WORD = r"[^\x20\x09-\x0D]+"


def hash_key(*parts: str | Column) -> Column:
    """48-bit key of a row's identity; null parts count as empty texts."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def budget_cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The cut of each group: rows with ``key <= cut`` have a weight next to the group's budget.

    ``rows``: group, key (long of 48 bits), weight (long); ``budgets``: group, budget. Returns
    group, cut. Groups may be null. Of the two sums next to the budget the nearer counts, the
    smaller one of equals. Keys that tie go together.
    """
    state = budgets.select("group", "budget", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(BITS - STEP, -1, -STEP):
        r, s = rows.alias("r"), state.alias("s")
        near = F.col("r.group").eqNullSafe(F.col("s.group")) & (F.shiftright("r.key", shift + STEP) == F.col("s.prefix"))
        hist = (
            r.join(s, near)
            .groupBy("s.group", "s.budget", "s.before", F.shiftright("r.key", shift).alias("prefix"))
            .agg(F.sum("r.weight").alias("weight"))
        )
        # At most 4,096 buckets a group.
        order = Window.partitionBy("group").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        upto = hist.select("group", "budget", "prefix", "weight", (F.col("before") + F.sum("weight").over(order)).alias("upto"))
        state = stored(
            upto.where(F.col("upto") > F.col("budget"))
            .groupBy("group", "budget")
            .agg(F.min(F.struct("prefix", "weight", "upto")).alias("b"))
            .select("group", "budget", (F.col("b.upto") - F.col("b.weight")).alias("before"), "b.prefix", "b.upto")
        )
    closer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("before")
    found = state.select("group", F.when(closer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))
    b, f = budgets.alias("b"), found.alias("f")
    # A budget that no bucket exceeds takes the whole group.
    return b.join(f, F.col("b.group").eqNullSafe(F.col("f.group")), "left").select(
        "b.group", F.coalesce("f.cut", F.lit(1 << BITS)).alias("cut")
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """Target of each source: shares by weight, none above ``repeats`` times its size.

    ``sizes``: source, source_size, one row per source. The excess of stopped sources is shared
    again by weight, which ends where all others have one share per weight: sources are stopped in
    the order of size over weight as long as the share that is left reaches them.
    """
    kinds = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % kinds + 1).cast("int"))
    whole = Window.partitionBy()
    cap = F.col("source_size") * float(repeats)
    listed = sizes.select("source", "source_size", weight.alias("w"), cap.alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * float(budget) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    share = left / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    stops = listed.select("*", (F.col("cap") <= share * F.col("w")).alias("stopped"), F.sum("source_size").over(whole).alias("all"))
    rest = F.col("all") * float(budget) - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("stopped"), F.col("w"))).over(whole)
    target = F.when(F.col("stopped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * rest / open_weight))
    return stops.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """How often the mix takes each document: ``keep`` columns, size, source_size, target, copies, taken.

    Every document is taken as often as its whole source can be, and once more if its key is
    below the cut of what is left. A null or blank text has size 0 and takes no words; a null
    source is a source. Rows that repeat an id with its text tie and go together. An empty table
    gives an empty result. Extra columns of ``docs`` are ignored unless kept.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    sized = stored(
        docs.select(
            F.struct(*[F.col(c) for c in keep]).alias("kept"),
            F.col("source").alias("group"),
            size.alias("weight"),
            hash_key("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"),
        )
    )
    totals = sized.groupBy(F.col("group").alias("source")).agg(F.sum("weight").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(source_targets(totals, weights, budget, repeats).withColumn("whole", whole))
    left = plan.select(F.col("source").alias("group"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cuts = budget_cuts(sized.select("group", "key", "weight"), left)
    p, c, s = plan.alias("p"), cuts.alias("c"), sized.alias("s")
    limits = stored(p.join(c, F.col("p.source").eqNullSafe(F.col("c.group"))).select("p.*", "c.cut"))
    # A target that is a whole multiple leaves nothing for the cut.
    extra = ((F.col("s.key") <= F.col("l.cut")) & (F.col("l.target") > F.col("l.whole") * F.col("l.source_size"))).cast("long")
    copies = F.col("l.whole") + extra
    return s.join(limits.alias("l"), F.col("s.group").eqNullSafe(F.col("l.source"))).select(
        "s.kept.*",
        F.col("s.weight").alias("size"),
        "l.source_size",
        "l.target",
        copies.alias("copies"),
        (copies * F.col("s.weight")).alias("taken"),
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with copies: how often. A column of that name gives way."""
    docs = docs.drop("copies")
    plain, _ = set_aside(docs)
    taken = mix_sources(plain, tuple(plain.columns)).where("copies > 0")
    return taken.select(*plain.columns, "copies").toDF(*docs.columns, "copies")

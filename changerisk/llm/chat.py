"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

A log holds a conversation many times, each time a few turns longer. A turn's hash covers its place,
role and text; the rolling hash of a prefix is the exclusive or of its turns' hashes, so it can be
summed in parts. A conversation whose whole hash is the hash of a prefix of a longer one is a
snapshot of that and goes; of equal ones the least id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from changerisk.llm.shared import stored

#: Turns numbered and hashed together, and turns rendered into one row.
SLICE = 1_024
ROW_TURNS = 256
#: Chat markup around a turn's role and text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def digest() -> Column:
    """Of a turn's role and text; their lengths, -1 for a null, keep them apart."""
    sized = lambda c: (F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.md5(F.concat(*sized("role"), *sized("text")).cast("binary"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest, place (from 1), h1, h2: the rolling hashes up to each turn.

    Turns are ordered by turn, then by the digest of role and text; null turns come first. Rows that
    repeat a turn with its role and text count once. Texts stay where they are: only digests are
    moved. A conversation of any length is worked on in slices of turn numbers; what the slices
    before hold is added from a table with a row per slice.
    """
    part = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 53)))
    rows = stored(turns.select("conv_id", "turn", digest().alias("digest")).distinct().withColumn("_slice", part))
    inside = Window.partitionBy("conv_id", "_slice").orderBy(F.col("turn").asc_nulls_first(), "digest")
    before = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "_slice").agg(F.count("*").alias("n"))
    counts = counts.select("conv_id", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = _joined(rows.withColumn("_place", F.row_number().over(inside)), counts)
    placed = placed.withColumn("place", (F.col("_place") + F.col("_before")).cast("long"))
    turn_hash = lambda seed: F.xxhash64(F.lit(seed), "place", "digest").alias(f"t{seed}")
    hashed = stored(placed.select("conv_id", "turn", "digest", "_slice", "place", turn_hash(1), turn_hash(2)))
    up = Window.partitionBy("conv_id", "_slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("conv_id", "_slice").agg(*[F.bit_xor(f"t{s}").alias(f"x{s}") for s in (1, 2)])
    sums = sums.select("conv_id", "_slice", *[F.coalesce(F.bit_xor(f"x{s}").over(before), F.lit(0).cast("long")).alias(f"b{s}") for s in (1, 2)])
    rolled = _joined(hashed.select("*", *[F.bit_xor(f"t{s}").over(up).alias(f"r{s}") for s in (1, 2)]), sums)
    return rolled.select("conv_id", "turn", "digest", "place", *[F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"h{s}") for s in (1, 2)])


def _joined(rows: DataFrame, slices: DataFrame) -> DataFrame:
    r, s = rows.alias("r"), slices.alias("s")
    on = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r._slice") == F.col("s._slice"))
    return r.join(s, on).select("r.*", *[f"s.{c}" for c in slices.columns if c not in ("conv_id", "_slice")])


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal: conversations that are no proper prefix of another, one of equal ones.

    Prefixes are reduced to distinct ones before they meet the conversations, so an opening that all
    share is one row. ``n_equal``: conversations with these very turns.
    """
    whole = hashed.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("w"))
    whole = whole.groupBy("w").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    whole = whole.select("conv_id", "n_equal", F.col("w.place").alias("place"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    sizes = hashed.groupBy("conv_id").agg(F.max("place").alias("n"))
    h, z = hashed.alias("h"), sizes.alias("z")
    proper = h.join(z, F.col("h.conv_id").eqNullSafe(F.col("z.conv_id"))).where("h.place < z.n").select("h.place", "h.h1", "h.h2").distinct()
    return whole.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal, part (from 0), rendered: chat markup of the maximal conversations.

    A null role is ``unknown``, a null text empty. A row holds ROW_TURNS turns at most; the parts of
    a conversation, in order, are its text. An empty table gives an empty result; extra columns are
    ignored. Rows without a conversation are one conversation.
    """
    hashed = stored(prefix_hashes(turns))
    kept = stored(maximal(hashed))
    h, k = hashed.alias("h"), kept.alias("k")
    wanted = h.join(k, F.col("h.conv_id").eqNullSafe(F.col("k.conv_id"))).select("h.conv_id", "h.turn", "h.digest", "h.place", "k.n_turns", "k.n_equal")
    piece = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    t, w = turns.select("conv_id", "turn", digest().alias("digest"), piece.alias("piece")).alias("t"), wanted.alias("w")
    same = F.col("t.conv_id").eqNullSafe(F.col("w.conv_id")) & F.col("t.turn").eqNullSafe(F.col("w.turn")) & (F.col("t.digest") == F.col("w.digest"))
    rows = t.join(w, same).select("w.conv_id", "w.n_turns", "w.n_equal", F.floor((F.col("w.place") - 1) / ROW_TURNS).alias("part"), "w.place", "t.piece")
    # Rows that repeat a turn bring the same piece to the same place.
    pieces = F.array_sort(F.collect_set(F.struct("place", "piece")))
    joined = rows.groupBy("conv_id", "n_turns", "n_equal", "part").agg(pieces.alias("p"))
    return joined.select("conv_id", "n_turns", "n_equal", "part", F.array_join(F.col("p.piece"), "").alias("rendered"))

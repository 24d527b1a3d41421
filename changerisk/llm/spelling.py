"""Spelling variants: words one edit apart, found by walking a trie that is a table.

The trie's nodes are the prefixes of the words, once as they are written (marked ``>``) and once
reversed (marked ``<``). A state (word, position, node, edits) says that the word's letters before
``position`` lead to ``node`` with that many edits. Up to its middle a word only follows its own
path; from there it branches with one edit, and because the other half of the word is walked from
the other end, every edit is met by one of both walks, deep in the trie where nodes have few
children. States go down level by level by a join with the nodes of that level; those whose word
ends where another word ends are neighbours. Only replacements by a later letter and deletions are
walked: the others are the same pairs seen from the other word.

Words longer than ``LONGEST`` letters would need as many levels. They meet by the hashes of their
spellings without one letter instead, which finds the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from changerisk.llm.blocks import mix
from changerisk.llm.shared import stored

#: Letters of a run, fewest letters and occurrences of a word, divisor of the deletion rule.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 6
LEAST_COUNT = 5
SLIP = 199
#: How many times more frequent a word's form must be.
RATIO = 5
#: Words of more letters meet by deletion hashes, not in the trie.
LONGEST = 48

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_U = np.uint64


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Words of all texts with their occurrences (word, n), after the deletion rule.

    Runs too short to become a word are never made. A null text has no runs, a null id counts as
    the empty text, repeated rows count as often as they stand there.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least_letters},}})"), F.lit(1)))
    plain = F.octet_length("_run") == F.length("_run")  # ASCII only: lower() then changes A-Z alone
    low = F.when(plain, F.lower("_run")).otherwise(F.translate("_run", _UPPER, _UPPER.lower()))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "_run")
    at = (F.col("_h") % F.length("_run")).cast("int")
    slipped = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    return (
        docs.select("doc_id", run.alias("_run"))
        .select("doc_id", low.alias("_run"))
        .select("_run", F.crc32(key.cast("binary")).alias("_h"))
        .select(F.when(F.col("_h") % SLIP == 0, slipped).otherwise(F.col("_run")).alias("word"))
        .where(F.length("word") >= least_letters)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_count)
    )


def _directed(words: DataFrame) -> DataFrame:
    """Each word from both ends: ``s`` with its mark, letters, and the ``half`` it walks unchanged."""
    size = F.length("word")
    half = F.expr("length(word) div 2")
    ways = F.array(
        F.struct(F.concat(F.lit(">"), "word").alias("s"), half.alias("half")),
        F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("s"), (size - half).alias("half")),
    )
    return words.select("n", size.alias("size"), F.explode(ways).alias("_w")).select("_w.s", "_w.half", "size", "n")


def trie(directed: DataFrame) -> DataFrame:
    """Nodes (depth, node, n): prefixes from a word's half on; ``n`` where a word ends.

    Files hold ranges of depths, so that a level reads its own nodes only.
    """
    steps = directed.select("s", "size", "n", F.explode(F.sequence("half", "size")).alias("depth"))
    return (
        steps.select("depth", F.substring("s", F.lit(1), F.col("depth") + 1).alias("node"), F.when(F.col("depth") == F.col("size"), F.col("n")).alias("n"))
        .groupBy("depth", "node")
        .agg(F.max("n").alias("n"))
        .repartitionByRange("depth", "node")
    )


def _level(directed: DataFrame, nodes: DataFrame, walking: DataFrame | None, depth: int) -> DataFrame:
    """States (s, n, pos, node, other_n) that stand on nodes of ``depth`` with one edit."""
    i = depth - 1
    own, after = F.substring("s", F.lit(i + 2), F.lit(1)), F.substring("s", F.lit(i + 3), F.lit(1))
    here = nodes.where(F.col("depth") == depth).select("node", F.col("n").alias("other_n"))
    at = directed.where((F.col("half") <= i) & (F.col("size") > i))
    head = F.substring("s", F.lit(1), F.lit(i + 1))
    kids = here.groupBy(F.substring("node", F.lit(1), F.lit(depth)).alias("head")).agg(
        F.collect_list(F.struct(F.substring("node", F.lit(depth + 1), F.lit(1)).alias("c"), "other_n")).alias("kids")
    )
    kid = F.explode(F.filter("kids", lambda k: k["c"] > F.col("own")))
    replaced = (
        at.select("s", "n", own.alias("own"), head.alias("head"))
        .join(kids.where(F.size("kids") > 1), "head")
        .select("s", "n", "head", kid.alias("kid"))
        .select("s", "n", F.lit(depth).alias("pos"), F.concat("head", "kid.c").alias("node"), "kid.other_n")
    )
    # A letter is left out: the next one is read from the same node. Of equal letters in a row the last one goes.
    deleted = at.where((F.col("size") > depth) & (own != after)).select(
        "s", "n", F.lit(depth + 1).alias("pos"), F.concat(head, after).alias("node")
    )
    last = directed.where(F.col("size") == depth + 1).select("s", "n", F.lit(depth + 1).alias("pos"), F.substring("s", F.lit(1), F.lit(depth + 1)).alias("node"))
    moving = deleted.unionByName(last)
    if walking is not None:
        moving = moving.unionByName(walking)
    return replaced.unionByName(moving.join(here, "node").select("s", "n", "pos", "node", "other_n"))


def _near_in_trie(words: DataFrame) -> DataFrame | None:
    directed = stored(_directed(words))
    longest = directed.agg(F.max("size"), F.min("half")).first()
    if longest[0] is None:
        return None
    nodes = stored(trie(directed))
    found, walking = [], None
    for depth in range(longest[1], longest[0] + 1):
        over = F.col("pos") >= F.length("s") - 1
        level = stored(_level(directed, nodes, walking, depth).where(~over | F.col("other_n").isNotNull()))
        found.append(level.where(over))
        onward = level.where(~over)
        walking = onward.select(
            "s", "n", (F.col("pos") + 1).alias("pos"), F.concat("node", F.substring("s", F.col("pos") + 2, F.lit(1))).alias("node")
        )
    pairs = _all_of(found)
    read = lambda c: F.when(F.startswith(F.col(c), F.lit(">")), F.substring(c, 2, LONGEST + 1)).otherwise(F.reverse(F.substring(c, 2, LONGEST + 1)))
    return pairs.select(read("s").alias("a"), F.col("n").alias("a_n"), read("node").alias("b"), F.col("other_n").alias("b_n"))


_STEP = 0x9E3779B97F4A7C15
_LONG_KEYS = "id long, at int, whole boolean, h long, size int"


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each word, and of each spelling of it without one letter."""
    for batch in batches:
        for i, word in zip(batch["id"].to_pylist(), batch["word"].to_pylist()):
            code = mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(_U), 3)
            n = len(code)
            power = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, _STEP, _U))))
            upto = np.concatenate(([_U(0)], np.cumsum(code * power[:n])))
            back = _U(pow(_STEP, -1, 1 << 64))
            without = upto[:n] + (upto[n] - upto[1:]) * back
            for a in range(0, n + 1, 1 << 16):
                b = min(n + 1, a + (1 << 16))
                h = np.concatenate((without, upto[n:]))[a:b]
                at = np.arange(a, b, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, i, np.int64)), pa.array(at), pa.array(at == n), pa.array(mix(h).view(np.int64)),
                     pa.array(np.where(at == n, n, n - 1).astype(np.int32))],
                    ["id", "at", "whole", "h", "size"],
                )


def _near_long(words: DataFrame) -> DataFrame:
    """Pairs of long words: equal when one letter goes from both at one place, or from the longer one."""
    named = stored(words.withColumn("id", F.monotonically_increasing_id()))
    keys = stored(named.select("id", "word").mapInArrow(_without_one, _LONG_KEYS))
    whole = keys.where("whole").select("h", "size", F.col("id").alias("b"))
    parts = keys.where("NOT whole")
    shorter = parts.select("h", "size", F.col("id").alias("a")).join(whole, ["h", "size"]).select("a", "b")
    right = parts.select("h", "size", "at", F.col("id").alias("b"))
    alike = parts.select("h", "size", "at", F.col("id").alias("a")).join(right, ["h", "size", "at"]).where("a < b").select("a", "b")
    pairs = shorter.unionByName(alike).distinct()
    text = lambda p: named.select(F.col("id").alias(p), F.col("word").alias(f"{p}_word"), F.col("n").alias(f"{p}_n"))
    return (
        pairs.join(text("a"), "a").join(text("b"), "b")
        .where(F.levenshtein("a_word", "b_word", 1) == 1)
        .select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")
    )


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs of ``words`` (word, n) that differ by exactly one inserted, deleted or replaced letter.

    Rows (word, near, near_n), each pair both ways. Words are distinct and have at least two letters.
    """
    size = F.length("word")
    long = words.where(size >= LONGEST)
    pairs = _near_in_trie(words.where(size <= LONGEST))
    if not long.isEmpty():
        extra = _near_long(long)
        pairs = extra if pairs is None else pairs.unionByName(extra)
    if pairs is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.explode(both).alias("_p")).select("_p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of forms (word, root), from ``forms`` (word, form), by pointer jumping.

    A form occurs more often than its word, so there are no circles; rows whose chain has ended
    leave the loop, and a chain of length m takes log2(m) rounds.
    """
    state = stored(forms.select("word", F.col("form").alias("root")))
    ended: list[DataFrame] = []
    while not state.isEmpty():
        known = _all_of([*ended, state]).select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(state.join(known, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.isnull("_next").alias("_end")))
        ended.append(moved.where("_end").select("word", "root"))
        state = moved.where("NOT _end").select("word", "root")
    return _all_of([*ended, state])


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def group_spellings(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with their likely intended form and the root of its chain.

    Rows (word, form, root, n, n_near, form_n). A word's form is its near word of largest n (ties:
    the smallest in code-point order) where that is ``ratio`` times its own n; the root of a word
    without form is itself. Null, empty and letterless texts have no words; an empty table gives no
    rows; other columns are not read.
    """
    words = stored(word_counts(docs))
    near = neighbours(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_k"), "near")).alias("_best")
    )
    often = -F.col("_best._k") >= F.col("n") * ratio
    found = stored(
        words.join(near, "word", "left").select(
            "word", F.when(often, F.col("_best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, -F.col("_best._k")).alias("form_n"),
        )
    )
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

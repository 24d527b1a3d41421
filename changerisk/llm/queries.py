"""Queries of the numbered operators over the given tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changerisk.llm.ann import nearest_neighbours
from changerisk.llm.centroids import CENTROIDS, DIMS, ROUNDS, SCALE, SEED, cluster_vectors
from changerisk.llm.chat import render
from changerisk.llm.decontamination import contamination
from changerisk.llm.fingerprints import compare_with_edits
from changerisk.llm.language import identify
from changerisk.llm.lm import score_held_out
from changerisk.llm.mixing import mix_sources
from changerisk.llm.neardup import classes
from changerisk.llm.quality import resample
from changerisk.llm.shared import ship_code, table
from changerisk.llm.spelling import group_spellings
from changerisk.llm.tokens import count_tokens
from changerisk.llm.toxicity import assess

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_code(spark)
            return fn(spark, folder)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


#: Needs a relation ``docs`` of documents; leaves ``mixed``.
MIX_SQL = r"""
sized AS (
  SELECT *, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || SUBSTR(MD5(COALESCE(doc_id::VARCHAR, '') || '|' || MD5(COALESCE(text, ''))), 1, 12))::BIGINT AS k
  FROM docs),
sources AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sources),
stops AS (
  SELECT *, cap <= w * (1.5::DOUBLE * SUM(source_size) OVER ()
      - COALESCE(SUM(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / SUM(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stopped,
    1.5::DOUBLE * SUM(source_size) OVER () AS budget
  FROM weighted),
targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap ELSE LEAST(cap, w * (budget - COALESCE(SUM(cap) FILTER (stopped) OVER (), 0))
      / SUM(w) FILTER (NOT stopped) OVER ()) END AS target
  FROM stops),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
keyed AS (
  SELECT source, k, SUM(size) AS w FROM sized GROUP BY source, k),
sums AS (
  SELECT source, k, w, SUM(w) OVER (PARTITION BY source ORDER BY k) AS upto FROM keyed),
border AS (
  SELECT s.source, MIN(k) FILTER (upto > target - whole * source_size) AS edge
  FROM sums s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source),
cuts AS (
  SELECT b.source, CASE WHEN edge IS NULL THEN 1::BIGINT << 48
    WHEN s.upto - (target - whole * source_size) < (target - whole * source_size) - (s.upto - s.w) THEN edge ELSE edge - 1 END AS cut
  FROM border b JOIN plans p ON b.source IS NOT DISTINCT FROM p.source
  LEFT JOIN sums s ON s.source IS NOT DISTINCT FROM b.source AND s.k = b.edge),
mixed AS (
  SELECT d.*, p.source_size, p.target,
    (p.whole + CASE WHEN d.k <= c.cut AND p.target > p.whole * p.source_size THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source)
"""

OP1_SQL = f"""WITH docs AS (SELECT * FROM documents), {MIX_SQL}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"""


@_query("op1_mix_sources", OP1_SQL)
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents, 150 % of their words, sources weighing 5, 2, 1 in turn."""
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Words of the texts and items of the decontamination and near-duplicate operators.
WORDS_SQL = r"""REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Needs ``docs`` and the benchmark; leaves ``texts`` (rid, w) and ``hits`` (rid, p, k, item_id).
LEAKS_SQL = f"""
texts AS (SELECT *, ROW_NUMBER() OVER () AS rid, {WORDS_SQL} AS w FROM docs),
items AS (SELECT item_id, w, LEAST(10, LEN(w)) AS k FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE LEN(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, ARRAY_TO_STRING(w[p:p + k - 1], ' ') AS g
  FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - k + 2)) AS p FROM items)),
text_windows AS (
  SELECT rid, p, k, ARRAY_TO_STRING(w[p:p + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, UNNEST(RANGE(1, LEN(w) - k + 2)) AS p FROM texts, (SELECT DISTINCT k FROM items) WHERE LEN(w) >= k)),
hits AS (SELECT t.rid, t.p, t.k, i.item_id FROM text_windows t JOIN item_windows i ON t.k = i.k AND t.g = i.g)
"""

OP7_SQL = f"""WITH docs AS (SELECT doc_id, text FROM documents), {LEAKS_SQL},
hit_words AS (SELECT rid, COUNT(DISTINCT q) AS n FROM (SELECT rid, UNNEST(RANGE(p, p + k)) AS q FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, COUNT(*) AS n, STRING_AGG(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits) GROUP BY rid)
SELECT doc_id, LEN(w)::BIGINT AS n_words, COALESCE(h.n, 0)::BIGINT AS n_hit, COALESCE(i.n, 0)::BIGINT AS n_items,
  SHA256(COALESCE(i.ids, '')) AS items_sha256, COALESCE(h.n, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words h USING (rid) LEFT JOIN hit_items i USING (rid)"""


@_query("op7_decontaminate", OP7_SQL)
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside benchmark passages of ten words, and the items hit."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: Needs ``docs`` (doc_id, text); leaves ``labelled`` (doc_id, class_id).
NEAR_SQL = f"""
worded AS (SELECT doc_id, {WORDS_SQL} AS w FROM docs),
runs AS (
  SELECT doc_id, ARRAY_TO_STRING(w[p:p + 4], ' ') AS g, COUNT(*) AS n
  FROM (SELECT doc_id, w, UNNEST(RANGE(1, GREATEST(LEN(w) - 4, 1) + 1)) AS p FROM worded WHERE LEN(w) > 0) GROUP BY ALL),
weights AS (SELECT doc_id, SUM(n) AS n FROM runs GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM runs x JOIN runs y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN weights v ON v.doc_id = x.doc_id JOIN weights u ON u.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, v.n, u.n
  HAVING SUM(LEAST(x.n, y.n)) >= 0.8 * (v.n + u.n - SUM(LEAST(x.n, y.n)))),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
labelled AS (SELECT a AS doc_id, MIN(b) AS class_id FROM reached GROUP BY a)
"""

OP6_SQL = f"""WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {NEAR_SQL}
SELECT doc_id, class_id FROM labelled"""


@_query("op6_near_duplicates", OP6_SQL)
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Class of each document: links are similarities of 0.8 of runs of five words."""
    return classes(table(spark, folder, "documents")).select("doc_id", "class_id")


@_query("op4_language")
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each document, by profiles of those not held out."""
    return identify(table(spark, folder, "documents"))


@_query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Documents sampled by importance for texts labelled good, as many as the labels' share of good ones."""
    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of each document, learned from the labels of those not held out."""
    return assess(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of each document, and its likeness to an edited text and to the next document."""
    return compare_with_edits(table(spark, folder, "documents"))


OP9_SQL = r"""WITH RECURSIVE
turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
  MD5(COALESCE(LENGTH(role), -1)::VARCHAR || ':' || COALESCE(role, '') || COALESCE(LENGTH(text), -1)::VARCHAR || ':' || COALESCE(text, ''))) AS place FROM turns),
prefixes AS (
  SELECT conv_id, place, MD5(COALESCE(role, '') || '|' || (text IS NULL)::VARCHAR || (role IS NULL)::VARCHAR || COALESCE(text, '')) AS h
  FROM placed WHERE place = 1
  UNION ALL
  SELECT p.conv_id, p.place, MD5(x.h || COALESCE(role, '') || '|' || (text IS NULL)::VARCHAR || (role IS NULL)::VARCHAR || COALESCE(text, ''))
  FROM prefixes x JOIN placed p ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.place = x.place + 1),
sized AS (SELECT *, MAX(place) OVER (PARTITION BY conv_id) AS n FROM prefixes),
wholes AS (SELECT MIN(conv_id) AS conv_id, n, h, COUNT(*) AS n_equal FROM sized WHERE place = n GROUP BY n, h),
kept AS (SELECT * FROM wholes w WHERE NOT EXISTS (SELECT 1 FROM sized s WHERE s.place < s.n AND s.place = w.n AND s.h = w.h))
SELECT k.conv_id, k.n::BIGINT AS n_turns, k.n_equal, ((place - 1) // 256)::BIGINT AS part,
  STRING_AGG('<|' || COALESCE(role, 'unknown') || '|>' || CHR(10) || COALESCE(text, '') || '<|end|>' || CHR(10), '' ORDER BY place) AS rendered
FROM kept k JOIN placed p ON k.conv_id IS NOT DISTINCT FROM p.conv_id
GROUP BY k.conv_id, k.n, k.n_equal, (place - 1) // 256"""


@_query("op9_chat", OP9_SQL)
def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    """The longest of all logged conversations, in chat markup."""
    return render(table(spark, folder, "conversations"))


@_query("op10_lm_score")
def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of each document under a recurrent model of those not held out."""
    return score_held_out(table(spark, folder, "documents"))


@_query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document, counted in flat token files."""
    return count_tokens(table(spark, folder, "documents"))


@_query("op11_nearest_neighbours")
def op11_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth one."""
    return nearest_neighbours(table(spark, folder, "embeddings"))


@_query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, their likely intended forms and the roots of these."""
    return group_spellings(table(spark, folder, "documents"))


def _centroids_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """Every round as joins of (vector, component) with (centroid, component)."""
    steps = [
        f"""kept AS (SELECT ROW_NUMBER() OVER () AS rid, vec_id, embedding AS e FROM embeddings
  WHERE LEN(embedding) = {DIMS} AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR ISNAN(x) OR ISINF(x))) = 0),
parts AS (SELECT rid, UNNEST(RANGE(1, {DIMS + 1})) AS p, FLOOR({SCALE} * UNNEST(e)::DOUBLE)::BIGINT AS x FROM kept),
c0 AS (SELECT c, p, x FROM (
  SELECT rid, ROW_NUMBER() OVER (ORDER BY SHA256('{SEED}:' || COALESCE(vec_id::VARCHAR, ''))) - 1 AS c FROM kept) JOIN parts USING (rid) WHERE c < {k})"""
    ]
    near = """a{r} AS (SELECT rid, MIN(d * 1000 + c) % 1000 AS c, MIN(d * 1000 + c) // 1000 AS d FROM (
  SELECT v.rid, w.c, SUM((v.x - w.x) * (v.x - w.x))::BIGINT AS d FROM parts v JOIN c{r} w USING (p) GROUP BY v.rid, w.c) GROUP BY rid)"""
    for r in range(rounds):
        steps.append(near.format(r=r))
        steps.append(f"""c{r + 1} AS (SELECT o.c, o.p, COALESCE(m.x, o.x) AS x FROM c{r} o LEFT JOIN (
  SELECT c, p, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
    SELECT a.c, v.p, SUM(v.x)::BIGINT AS s, COUNT(*) AS n FROM parts v JOIN a{r} a USING (rid) GROUP BY a.c, v.p)) m ON m.c = o.c AND m.p = o.p)""")
    steps.append(near.format(r=rounds))
    return f"""WITH {", ".join(steps)},
named AS (SELECT c, SHA256(STRING_AGG(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (SUM(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (SUM(a.d) OVER ())::BIGINT AS inertia, n.centroid_sha256
FROM a{rounds} a JOIN kept k USING (rid) JOIN named n ON n.c = a.c"""


@_query("op13_cluster_centroids", _centroids_sql())
def op13_cluster_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the vectors after five rounds of integer k-means around forty centroids."""
    return cluster_vectors(table(spark, folder, "embeddings"))

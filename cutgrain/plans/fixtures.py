"""Tables of clips, frames, cues and answers derived from the driver's tables, the same for Spark and the oracle.

Each fixture is a SELECT in the SQL that both engines share, or a pair where they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutgrain.session import table

#: Ten vectors make a clip of 20 s, a frame every 2 s. Three base pictures a clip; of 170 clips in a row every 17th has the
#: same set, the own vectors of another clip, so sets grow with the table. Odd clips are turned a quarter, exposure differs
#: by clip, and there is a little noise.
BASES = 17


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, time_s, fp array<int>)"""
    e = table(spark, sf_dir, "embeddings")
    f = e.select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("clip_id"), (F.col("vec_id") % 10).alias("k"))
    base = e.select(F.col("vec_id").alias("base"), "embedding")
    shown = F.floor(F.col("clip_id") / (10 * BASES)) * BASES + F.col("clip_id") % BASES
    f = f.withColumn("base", shown * 10 + F.floor(F.col("k") / 4)).join(base, "base")
    place = lambda i: F.when(F.col("clip_id") % 2 == 1, (7 - i % 8) * 8 + F.floor(i / 8)).otherwise(i).cast("int")
    q = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.6) * 212.5))).cast("int")
    more = lambda i: (F.col("clip_id") % 3 * 5 + F.when((i + F.col("k")) % 3 == 0, 1).otherwise(0)).cast("int")
    fp = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.least(F.lit(255), q(F.element_at("embedding", place(i) + 1)) + more(i)))
    return f.select("clip_id", (F.col("k") * 2.0).cast("double").alias("time_s"), fp.alias("fp"))


def clip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("clip_id")).distinct().select("clip_id", F.lit(20.0).alias("duration_s"))


#: The same in DuckDB, up to stretches with signatures and their pairs.
STRETCHES_SQL = f"""
cells AS MATERIALIZED (
  SELECT f.clip_id, f.k, i, least(255, greatest(0, least(255, floor((b.embedding[(CASE WHEN f.clip_id % 2 = 1 THEN (7 - i % 8) * 8 + i // 8 ELSE i END) + 1]::DOUBLE + 0.6) * 212.5)))::INT
      + f.clip_id % 3 * 5 + (CASE WHEN (i + f.k) % 3 = 0 THEN 1 ELSE 0 END))::DOUBLE AS v
  FROM (SELECT vec_id // 10 AS clip_id, vec_id % 10 AS k FROM embeddings) f
  JOIN embeddings b ON b.vec_id = (f.clip_id // {10 * BASES} * {BASES} + f.clip_id % {BASES}) * 10 + f.k // 4, range(64) t(i)
), sized AS MATERIALIZED (
  SELECT clip_id, k, i, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM cells WINDOW w AS (PARTITION BY clip_id, k)
), norms AS MATERIALIZED (
  SELECT clip_id, k, i, v, CASE WHEN sd >= 4 THEN (v - m) / sd END AS z FROM sized
), steps AS MATERIALIZED (
  SELECT a.clip_id, a.k, sum(abs(a.v - b.v)) / 64 / 255 > 0.05 AND coalesce(1 - sum(a.z * b.z) / 64 > 0.5, true) AS is_cut
  FROM norms a JOIN norms b ON a.clip_id = b.clip_id AND b.k = a.k - 1 AND a.i = b.i GROUP BY a.clip_id, a.k
), places AS MATERIALIZED (
  SELECT f.clip_id, f.k, coalesce(s.is_cut, false) AS is_cut, sum(CASE WHEN s.is_cut THEN 1 ELSE 0 END) OVER (PARTITION BY f.clip_id ORDER BY f.k) AS pos
  FROM (SELECT DISTINCT clip_id, k FROM cells) f LEFT JOIN steps s USING (clip_id, k)
), bounds AS MATERIALIZED (
  SELECT clip_id, pos, count(*) AS n_frames, coalesce(max(CASE WHEN is_cut THEN k * 2.0 - 1.0 END), 0.0)::DOUBLE AS start_s FROM places GROUP BY clip_id, pos
), stretches AS MATERIALIZED (
  SELECT clip_id, pos, clip_id * 1048576 + pos AS piece, start_s, coalesce(lead(start_s) OVER (PARTITION BY clip_id ORDER BY pos), 20.0)::DOUBLE AS end_s, n_frames FROM bounds
), means AS MATERIALIZED (
  SELECT n.clip_id, p.pos, n.i, avg(n.z) AS v FROM norms n JOIN places p USING (clip_id, k) WHERE n.z IS NOT NULL GROUP BY n.clip_id, p.pos, n.i
), signed AS MATERIALIZED (
  SELECT clip_id * 1048576 + pos AS piece, clip_id, pos, i, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM means WINDOW w AS (PARTITION BY clip_id, pos)
), grids AS MATERIALIZED (
  SELECT piece, list(z ORDER BY i) AS t0, list(z ORDER BY i % 8, -(i // 8)) AS t1, list(z ORDER BY -i) AS t2, list(z ORDER BY -(i % 8), i // 8) AS t3 FROM signed GROUP BY piece
), pairs AS MATERIALIZED (
  SELECT a.piece AS a, b.piece AS b, 1 - greatest(list_inner_product(a.t0, b.t0), list_inner_product(a.t1, b.t0), list_inner_product(a.t2, b.t0), list_inner_product(a.t3, b.t0)) / 64 AS distance
  FROM grids a JOIN grids b ON a.piece < b.piece
), links AS MATERIALIZED (SELECT a, b FROM pairs WHERE distance < 0.2 UNION ALL SELECT b, a FROM pairs WHERE distance < 0.2
), reach AS (
  SELECT piece, piece AS other FROM stretches UNION SELECT r.piece, l.b FROM reach r JOIN links l ON l.a = r.other
), roots AS MATERIALIZED (SELECT piece, min(other) AS root FROM reach GROUP BY piece
), grouped AS MATERIALIZED (SELECT piece, dense_rank() OVER (ORDER BY root) AS group_id FROM roots
)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are clips of 100 s; each event is a described span: (clip_id, item, start_s, end_s, description)."""
    e = table(spark, sf_dir, "events")
    start = (F.col("event_id") * 7919 % 1000 / 10.0).alias("start_s")
    return e.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("item"), start, F.least(F.lit(100.0), F.col("event_id") * 7919 % 1000 / 10.0 + F.col("event_id") % 40 / 4.0 + 0.5).alias("end_s"), F.col("event_type").alias("description"))


INTERVALS_SQL = """
spans AS MATERIALIZED (
  SELECT user_id AS clip_id, event_id AS item, (event_id * 7919 % 1000 / 10.0)::DOUBLE AS start_s,
    least(100.0, event_id * 7919 % 1000 / 10.0 + event_id % 40 / 4.0 + 0.5)::DOUBLE AS end_s, event_type AS description FROM events
)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers with good and bad elements: (clip_id, duration_s, body, stop_reason, input_tokens, output_tokens)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), (F.col("n_chars") % 600 + 20).cast("double").alias("duration_s"), "lang")
    return d.select("clip_id", "duration_s", F.expr(BODY_SPARK).alias("body"), F.expr("CASE clip_id % 20 WHEN 7 THEN 'max_tokens' WHEN 8 THEN 'refusal' WHEN 9 THEN 'tool_use' ELSE 'end_turn' END").alias("stop_reason"), (F.col("clip_id") * 31 % 5000).alias("input_tokens"), (F.col("clip_id") % 400).alias("output_tokens"))


#: Body of an answer, in SQL that both engines read alike.
_BODY = """
concat('{"summary": "', CASE WHEN clip_id % 11 = 3 THEN '  ' ELSE concat(' A clip of ', lang, ' scenery number ', CAST(clip_id % 50 AS STRING), ' ') END, '", "segments": [',
 '{"start_s": ', CAST(clip_id % 7 AS STRING), ', "end_s": ', CAST(clip_id % 7 + 6 AS STRING), ', "description": " Part ', CAST(clip_id % 3 AS STRING), ' "},',
 '{"start_s": ', CAST(clip_id % 5 + 8 AS STRING), ', "end_s": ', CAST(clip_id % 5 + 12 AS STRING), ', "description": "part ', CAST(clip_id % 2 AS STRING), '"},',
 '{"start_s": "3", "end_s": 9, "description": "text for a number"}, 5, {"start_s": 4, "end_s": 2, "description": "backwards"},',
 '{"start_s": 0, "end_s": 100000, "description": "whole"}, {"start_s": 15, "end_s": 18.5, "description": "A clip of ', lang, ' scenery"}],',
 '"main": [{"start_s": ', CAST(clip_id % 9 AS STRING), ', "end_s": ', CAST(clip_id % 9 + 7 AS STRING), '}],',
 '"tags": [{"name": "', lang, '", "confidence": ', CASE WHEN clip_id % 6 = 1 THEN '"high"' ELSE '1.5' END, ', "ranges": []},',
 '{"name": " ', lang, ' ", "confidence": 0.5, "ranges": []}, {"name": "odd", "confidence": 0.25, "ranges": [{"start_s": ', CAST(clip_id % 4 * 200 AS STRING), ', "end_s": ', CAST(clip_id % 4 * 200 + 5 AS STRING), '}]},',
 '{"name": "strange", "confidence": 1, "ranges": []}], "new_tag_ideas": ["Tractor", "  ", ', CAST(clip_id AS STRING), ', " ', lang, ' ", "Tractor"]}')
"""
BODY_SPARK = _BODY
BODY_DUCK = _BODY.replace("AS STRING", "AS VARCHAR")
ANSWERS_SQL = f"""
answers AS MATERIALIZED (
  SELECT clip_id, duration_s, {BODY_DUCK} AS body, CASE clip_id % 20 WHEN 7 THEN 'max_tokens' WHEN 8 THEN 'refusal' WHEN 9 THEN 'tool_use' ELSE 'end_turn' END AS stop_reason
  FROM (SELECT doc_id AS clip_id, (n_chars % 600 + 20)::DOUBLE AS duration_s, lang FROM documents)
)"""

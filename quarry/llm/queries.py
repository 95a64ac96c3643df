"""The registered queries of this folder, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import digests, html_text, languages, mixing, near, ngram_model, packing, quality_model, quality_rules, repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Batches of texts that fit beside a small executor's heap, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return repeats.repeat_sizes(table(spark, sf_dir, "documents"))


def op3_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return ngram_model.scored(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return digests.edits(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return near.near_groups(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return languages.predicted(docs, languages.learned(docs))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality_model.scored(docs, quality_model.learned(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_repeats": op2_repeats, "op3_ngram_model": op3_ngram_model, "op4_fingerprints": op4_fingerprints, "op5_near_duplicates": op5_near_duplicates, "op6_html_text": op6_html_text, "op7_packing": op7_packing, "op8_quality_rules": op8_quality_rules, "op9_languages": op9_languages, "op10_quality_model": op10_quality_model}


WORDS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS digest FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
goal AS (
  SELECT source, source_size, round(CASE WHEN level >= cap / weight THEN cap
         ELSE least(cap, weight * max(CASE WHEN level >= cap / weight THEN NULL ELSE level END) OVER ()) END, 6) AS target
  FROM levels),
plan AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS take, (source_size + 1023) // 1024 AS blocks, take // source_size AS passes,
         passes * blocks + (take - passes * source_size + 1023) // 1024 AS slots FROM goal WHERE floor(target + 0.5) > 0),
upto AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, CAST(sum(slots) OVER () AS BIGINT) AS all_slots,
         CAST(sum(slots) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS u FROM plan),
ivals AS (
  SELECT *, CAST(floor(CAST(u - slots AS DOUBLE) / all_slots * 2147483648.0) AS BIGINT) AS lo, CAST(floor(CAST(u AS DOUBLE) / all_slots * 2147483648.0) AS BIGINT) AS hi FROM upto),
points AS (SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range((SELECT coalesce(max(all_slots), 0) FROM ivals))) AS slot)),
named AS (
  SELECT p.slot, i.sid, i.slots, row_number() OVER (PARTITION BY i.sid ORDER BY p.slot) - 1 AS k, i.all_slots
  FROM points p JOIN ivals i ON p.point >= i.lo AND p.point < i.hi),
got AS (SELECT i.sid, i.slots, i.all_slots, count(n.k) AS n FROM ivals i LEFT JOIN named n ON n.sid = i.sid GROUP BY i.sid, i.slots, i.all_slots),
closing AS (SELECT all_slots + unnest(range(slots - n)) AS slot, sid, n + unnest(range(slots - n)) AS k FROM got WHERE n < slots),
dealt AS (SELECT slot, sid, k FROM named WHERE k < slots UNION ALL SELECT slot, sid, k FROM closing),
ordered AS (
  SELECT d.slot, d.sid, least(d.k // i.blocks, i.passes) AS pass, d.k - pass * i.blocks AS block,
         least((block + 1) * 1024, i.source_size, i.take - pass * i.source_size) AS upto
  FROM dealt d JOIN ivals i ON i.sid = d.sid),
laid AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, i.sid, row_number() OVER () AS rid,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN ivals i ON s.source IS NOT DISTINCT FROM i.source),
spread AS (SELECT *, unnest(range(CAST(start // 1024 AS BIGINT), CAST((start + size - 1) // 1024 + 1 AS BIGINT))) AS block FROM laid WHERE size > 0),
pieces AS (
  SELECT p.rid, o.slot, least(p.start + p.size, o.upto) - greatest(p.start, p.block * 1024) AS words
  FROM spread p JOIN ordered o ON o.sid = p.sid AND o.block = p.block),
taken AS (SELECT rid, sum(words) AS taken, min(slot) AS first_slot FROM pieces WHERE words > 0 GROUP BY rid)
SELECT l.doc_id, l.size, l.source_size, l.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, CAST(coalesce(t.first_slot, -1) AS BIGINT) AS first_slot
FROM laid l LEFT JOIN taken t ON t.rid = l.rid
"""


OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS items FROM w),
g AS (SELECT doc_id, CAST(len(items) AS BIGINT) AS n, items FROM s),
x AS (SELECT doc_id, n, unnest(items) AS item FROM g),
df AS (SELECT item, count(*) AS c FROM x GROUP BY item),
o AS (SELECT x.doc_id, x.n, x.item, row_number() OVER (PARTITION BY x.doc_id ORDER BY df.c, x.item) AS r FROM x JOIN df USING (item)),
p AS (SELECT doc_id, n, item FROM o WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.item = b.item AND a.doc_id < b.doc_id
         AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80),
m AS (SELECT c.a, c.b, g1.n AS na, g2.n AS nb, len(list_intersect(g1.items, g2.items)) AS i FROM cand c JOIN g g1 ON g1.doc_id = c.a JOIN g g2 ON g2.doc_id = c.b),
e AS (SELECT a, b FROM m WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.a, y.b FROM reach r JOIN both_ways y ON r.b = y.a)
SELECT g.doc_id, g.n AS n_shingles, min(r.b) AS component_id, min(r.b) = g.doc_id AS kept
FROM g JOIN reach r ON r.a = g.doc_id GROUP BY g.doc_id, g.n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op5_near_duplicates": OP5}

"""Registered queries of the retrieval and duplicate operators, with DuckDB SQL.

The test tables hold no source code, so documents stand for chunks: path source/doc_id, language lang, lines counted
in the text, vectors of embeddings with vec_id = doc_id. The chunkers run on literal sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.chunkers import chunked
from quarry.functions import paths, text
from quarry.operators import duplicates, search, snapshots
from quarry.streaming.refresh import bursts, relevant

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.4
K = 10
PATTERNS = ["src1/", "*.md", "src2/*7", "src3*", "!keep", "/lead"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"),
        F.col("source").alias("file_key"),
        F.col("lang").alias("language"),
        F.lit(1).cast("long").alias("start_line"),
        (1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("end_line"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("code_hash"),
    )


CHUNKS = """chunks AS (SELECT doc_id, source || '/' || doc_id AS file_path, source AS file_key, lang AS language, CAST(1 AS BIGINT) AS start_line,
  CAST(1 + length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS end_line, text AS content, sha256(text) AS code_hash FROM documents)"""


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunk_rows(spark, sf).join(vectors, "doc_id")


def query_block(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of the searches: every row whose id is divisible by 50."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


ASKED = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)"
SCORED = f"""WITH {CHUNKS}, {ASKED},
s AS (SELECT c.*, q.query_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id, q)"""


@query(f"""{SCORED}, hits AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_key ORDER BY score DESC, doc_id) AS rn FROM hits),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rn > 1, score DESC, doc_id) AS INTEGER) AS place FROM r)
SELECT query_id, place, doc_id, file_key, score FROM p WHERE place <= {K}""")
def diverse_topk(spark, sf):
    chunks = vector_chunks(spark, sf).select("doc_id", "file_key", "embedding")
    hits = search.topk_block(chunks, query_block(spark, sf), search.overfetch(K), ["doc_id"])
    return search.diverse_block(hits, K, "file_key", ["doc_id"]).select("query_id", "place", "doc_id", "file_key", "score")


@query(f"""WITH {ASKED}, s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM s)
SELECT query_id, place, vec_id, score FROM p WHERE place <= {K}""")
def topk_plain(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return search.topk_block(rows, query_block(spark, sf), K, ["vec_id"]).select("query_id", "place", "vec_id", "score")


@query(f"""{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, start_line) AS rn FROM s WHERE language <> 'fr'),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rn > 1, score DESC, file_path, start_line) AS INTEGER) AS place FROM r)
SELECT query_id, place, CASE WHEN file_path LIKE 'src1/%' THEN substr(file_path, 6) ELSE file_path END AS file_path, start_line, end_line, content, score FROM p WHERE place <= {K}""")
def semantic_search(spark, sf):
    live = vector_chunks(spark, sf).where("language <> 'fr'").select("doc_id", "file_path", "start_line", "embedding")
    hits = search.spread_block(live, query_block(spark, sf), K, "file_path", ["file_path", "start_line"])
    # the texts meet the hits only
    hits = hits.join(chunk_rows(spark, sf).select("doc_id", "end_line", "content"), "doc_id")
    return hits.select("query_id", "place", search.relative(F.col("file_path"), "src1").alias("file_path"), "start_line", "end_line", "content", "score")


@query(f"""WITH {ASKED}, e AS (SELECT query_id, vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 2) AS w, q.v FROM embeddings, q)
SELECT query_id, vec_id, round(list_cosine_similarity(w, v), 6) AS cosine,
  round(list_dot_product(w, v) / (list_dot_product(w, w) * list_dot_product(v, v)), 6) AS raw FROM e""")
def vector_similarity(spark, sf):
    doubled = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 2).alias("w"))
    found = search.similarities_block(doubled, query_block(spark, sf), "vec_id", "w")
    return found.select("query_id", F.col("row_id").alias("vec_id"), "cosine", "raw")


@query(f"WITH {CHUNKS} SELECT doc_id, language, end_line - start_line + 1 AS lines FROM chunks WHERE language IN ('de', 'fr') AND end_line - start_line + 1 BETWEEN 3 AND 12")
def chunk_filter(spark, sf):
    kept = chunk_rows(spark, sf).where(duplicates.matches(["de", "fr"], 3, 12))
    return kept.select("doc_id", "language", text.line_count(F.col("start_line"), F.col("end_line")).alias("lines"))


PAIRS = f"""pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {THRESHOLD})"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.similar_pairs(table(spark, sf, "embeddings"), THRESHOLD, "vec_id")


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs")
def similar_pairs(spark, sf):
    return pairs(spark, sf).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH {CHUNKS}, {PAIRS} SELECT p.a, p.b, (x.file_path = y.file_path AND (x.start_line = y.start_line OR x.end_line = y.end_line))
  OR x.end_line - x.start_line + 1 < 3 OR y.end_line - y.start_line + 1 < 3 AS trivial
FROM pairs p JOIN chunks x ON x.doc_id = p.a JOIN chunks y ON y.doc_id = p.b""")
def trivial_pairs(spark, sf):
    # places travel with the vectors, so that pairs need not be joined to them
    place = ["file_path", "start_line", "end_line"]
    found = duplicates.paired(vector_chunks(spark, sf).select("doc_id", "embedding", *place), THRESHOLD, "doc_id", carry=place)
    return found.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), duplicates.trivial().alias("trivial"))


GROUPS = f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
avgs AS (SELECT root, avg(score) AS s FROM pairs JOIN roots ON node = a GROUP BY root)"""


@query(f"""{GROUPS} SELECT root, CAST(count(*) AS BIGINT) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members, round(any_value(s), 6) AS avg_score
FROM roots JOIN avgs USING (root) GROUP BY root""")
def duplicate_groups(spark, sf):
    groups = duplicates.duplicate_groups(pairs(spark, sf))
    return groups.select("root", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.round("avg_score", 6).alias("avg_score"))


@query(f"""WITH RECURSIVE {CHUNKS}, k AS (SELECT min(c.doc_id) AS id FROM chunks c JOIN embeddings v ON v.vec_id = c.doc_id GROUP BY c.code_hash),
{PAIRS}, j AS (SELECT p.a, p.b, p.score FROM pairs p JOIN chunks x ON x.doc_id = p.a JOIN chunks y ON y.doc_id = p.b
  WHERE p.a IN (SELECT id FROM k) AND p.b IN (SELECT id FROM k)
    AND NOT ((x.file_path = y.file_path AND (x.start_line = y.start_line OR x.end_line = y.end_line)) OR x.end_line - x.start_line + 1 < 3 OR y.end_line - y.start_line + 1 < 3)),
e AS (SELECT a, b FROM j UNION SELECT b, a FROM j),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
avgs AS (SELECT root, avg(score) AS s FROM j JOIN roots ON node = a GROUP BY root)
SELECT CAST(count(*) AS BIGINT) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members, round(any_value(s), 6) AS avg_score, '{duplicates.REASON}' AS reason
FROM roots JOIN avgs USING (root) GROUP BY root""")
def find_duplicates(spark, sf):
    """The smallest doc_id stands for chunks of one content, as they are one point."""
    # the texts themselves show up in no column
    found = vector_chunks(spark, sf).drop("content")
    first = found.groupBy("code_hash").agg(F.min("doc_id").alias("doc_id"))
    found = found.join(first, ["code_hash", "doc_id"]).withColumn("point_id", F.col("doc_id"))
    ids = F.array_sort(F.transform("chunks", lambda c: c["doc_id"]))
    out = duplicates.find_duplicates(found, THRESHOLD)
    return out.select(
        F.size("chunks").cast("long").alias("size"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("members"), F.round("avg_score", 6).alias("avg_score"), "reason"
    )


@query(f"WITH {CHUNKS} SELECT doc_id, code_hash, CAST(('0x' || substr(sha256(code_hash), 1, 16))::UBIGINT AS VARCHAR) AS point_id, end_line - start_line + 1 AS lines FROM chunks")
def content_identity(spark, sf):
    c = chunk_rows(spark, sf)
    return c.select("doc_id", "code_hash", text.point_id(F.col("code_hash")).alias("point_id"), text.line_count(F.col("start_line"), F.col("end_line")).alias("lines"))


@query(f"WITH {CHUNKS} SELECT code_hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM chunks GROUP BY code_hash HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return chunk_rows(spark, sf).groupBy("code_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"WITH {CHUNKS} SELECT code_hash, max(doc_id) AS doc_id FROM chunks GROUP BY code_hash")
def content_dedupe_last_wins(spark, sf):
    return snapshots.last_wins(chunk_rows(spark, sf).select("code_hash", "doc_id"), ["code_hash"], "doc_id").select("code_hash", "doc_id")


def two_snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = chunk_rows(spark, sf)
    now = c.where("file_key <> 'src3'").select("file_path", F.col("code_hash").alias("file_hash"))
    altered = F.when(F.col("language") == "de", F.sha2(F.concat("code_hash", F.lit("x")), 256)).otherwise(F.col("code_hash"))
    return c.where("file_key <> 'src5'").select("file_path", altered.alias("file_hash")), now


SNAPSHOTS = f"""WITH {CHUNKS}, cur AS (SELECT file_path, code_hash AS file_hash FROM chunks WHERE file_key <> 'src3'),
prev AS (SELECT file_path, CASE WHEN language = 'de' THEN sha256(code_hash || 'x') ELSE code_hash END AS file_hash FROM chunks WHERE file_key <> 'src5')"""


@query(f"""{SNAPSHOTS} SELECT coalesce(c.file_path, p.file_path) AS file_path, CASE WHEN p.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'deleted'
  WHEN c.file_hash <> p.file_hash THEN 'modified' ELSE 'unchanged' END AS status FROM cur c FULL JOIN prev p ON c.file_path = p.file_path""")
def snapshot_diff(spark, sf):
    return snapshots.diff(*two_snapshots(spark, sf))


@query(f"{SNAPSHOTS} SELECT c.* FROM cur c LEFT JOIN prev p ON c.file_path = p.file_path WHERE p.file_path IS NULL OR p.file_hash <> c.file_hash")
def changed_files(spark, sf):
    return snapshots.changed(*two_snapshots(spark, sf))


@query(f"{SNAPSHOTS} SELECT p.* FROM prev p WHERE p.file_path NOT IN (SELECT file_path FROM cur)")
def deleted_files(spark, sf):
    return snapshots.deleted(*two_snapshots(spark, sf))


@query(f"{SNAPSHOTS} SELECT * FROM prev WHERE file_path NOT IN (SELECT file_path FROM cur) UNION ALL SELECT * FROM cur")
def keyed_upsert(spark, sf):
    previous, current = two_snapshots(spark, sf)
    return snapshots.upsert(previous, current, ["file_path"])


@query(f"WITH {CHUNKS} SELECT doc_id, file_path FROM chunks WHERE file_path NOT IN (SELECT source || '/' || doc_id FROM documents WHERE lang = 'es')")
def delete_by_path(spark, sf):
    c = chunk_rows(spark, sf)
    return snapshots.without_keys(c, c.where("language = 'es'")).select("doc_id", "file_path")


@query(f"WITH {CHUNKS} SELECT doc_id, file_path FROM chunks WHERE file_path IN (SELECT source || '/' || doc_id FROM documents WHERE lang = 'en')")
def existence_semi(spark, sf):
    c = chunk_rows(spark, sf)
    return c.join(c.where("language = 'en'").select("file_path"), "file_path", "left_semi").select("doc_id", "file_path")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id >= 40 ORDER BY vec_id LIMIT 100")
def keyset_page(spark, sf):
    return search.page(table(spark, sf, "embeddings"), "vec_id", 40, 100).select("vec_id", "label")


@query("SELECT CAST(count(*) AS BIGINT) AS points FROM embeddings")
def count_points(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("points"))


def _header(c: DataFrame) -> dict:
    none = F.array().cast("array<string>")
    row = {k: F.col(k) for k in ("file_path", "language", "content")}
    row |= {"node_name": F.concat(F.lit("n"), F.col("doc_id").cast("string")), "node_type": F.lit("function"), "package_name": F.when(F.col("doc_id") % 2 == 0, F.col("file_key")).otherwise(F.lit(""))}
    row |= {"imports": F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b=c"))).otherwise(none), "signature": F.lit(""), "receiver": F.lit(""), "doc": F.when(F.col("doc_id") % 5 == 0, F.lit("d")).otherwise(F.lit(""))}
    row |= {"callees": none, "param_types": F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(""))).otherwise(none), "return_types": none, "has_error_return": F.col("doc_id") % 11 == 0}
    return row


@query(f"""WITH {CHUNKS} SELECT doc_id, sha256(concat('file_path: ', file_path, chr(10), 'language: ', language, chr(10), 'node_name: n', doc_id, chr(10), 'node_type: function',
  CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'package: ' || file_key ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'imports: a, b=c' ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'doc: d' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'param_types: ' ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'has_error_return: true' ELSE '' END, chr(10), chr(10), content)) AS header_hash FROM chunks""")
def embedding_text(spark, sf):
    c = chunk_rows(spark, sf)
    return c.select("doc_id", F.sha2(text.embedding_text(_header(c)), 256).alias("header_hash"))


ENDINGS = [".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".GO", ".txt", ""]


@query(f"""WITH p AS (SELECT doc_id, 'a.b/' || source || {ENDINGS}[doc_id % 10 + 1] AS path FROM documents), x AS (SELECT *, regexp_extract(path, '(\\.[^./]*)$', 1) AS e FROM p)
SELECT doc_id, CASE e WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' ELSE '' END AS language,
  CASE lower(e) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
  WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' ELSE '' END AS more FROM x""")
def language_from_path(spark, sf):
    d = table(spark, sf, "documents")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 10 + 1).cast("int"))
    path = F.concat(F.lit("a.b/"), F.col("source"), ending)
    return d.select("doc_id", text.language_of(path).alias("language"), text.language_of(path, more=True).alias("more"))


@query(f"""WITH {CHUNKS}, p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'build/' WHEN doc_id % 9 = 0 THEN 'x/.git/' ELSE '' END || file_path || CASE WHEN doc_id % 6 = 0 THEN '.md' ELSE '' END AS path FROM chunks)
SELECT doc_id, path, regexp_matches(path, '^src1(/.*)?$') OR regexp_matches(path, '^[^/]*[.]md$') OR regexp_matches(path, '^src2/[^/]*7$') OR regexp_matches(path, '^src3[^/]*$')
  OR regexp_matches(path, '(^|/)!keep(/|$)') OR regexp_matches(path, '^/lead$') AS ignored, regexp_matches(path, '(^|/)(build|[.]git)/') AS skipped FROM p""")
def ignore_rules(spark, sf):
    d = F.col("doc_id")
    path = F.concat(F.when(d % 4 == 0, F.lit("build/")).when(d % 9 == 0, F.lit("x/.git/")).otherwise(F.lit("")), F.col("file_path"), F.when(d % 6 == 0, F.lit(".md")).otherwise(F.lit("")))
    c = chunk_rows(spark, sf).select("doc_id", path.alias("path"))
    return c.select("doc_id", "path", paths.is_ignored(F.col("path"), PATTERNS).alias("ignored"), paths.in_skipped_dir(F.col("path")).alias("skipped"))


@query(f"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(9) || chr(10) WHEN 2 THEN '  ' || source || chr(9) ELSE source END AS id FROM documents),
t AS (SELECT doc_id, regexp_replace(id, '^\\s+|\\s+$', '', 'g') AS id FROM p) SELECT doc_id, CASE WHEN id = '' THEN '{text.DEFAULT_COLLECTION}' ELSE '{text.PREFIX}' || id END AS name FROM t""")
def collection_name(spark, sf):
    d = F.col("doc_id") % 4
    padded = F.when(d == 0, F.lit("")).when(d == 1, F.lit(" \t\n")).when(d == 2, F.concat(F.lit("  "), F.col("source"), F.lit("\t"))).otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", text.collection_name(padded).alias("name"))


@query("SELECT page_id, '[' || array_to_string(string_split(url, '/'), ' ') || ']' AS shown FROM pages")
def list_stringify(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.stringified(F.split("url", "/")).alias("shown"))


@query("""WITH m AS (SELECT page_id, regexp_extract_all(html, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1) AS l FROM pages),
u AS (SELECT page_id, l, unnest(l) AS x FROM m), d AS (SELECT page_id, x, list_position(any_value(l), x) AS p FROM u WHERE x NOT IN ('if', 'for', 'while', 'switch', 'return') GROUP BY page_id, x),
g AS (SELECT page_id, string_agg(x, ',' ORDER BY p) AS callees FROM d GROUP BY page_id) SELECT p.page_id, coalesce(g.callees, '') AS callees FROM pages p LEFT JOIN g USING (page_id)""")
def call_targets(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(text.callees(F.col("html")), ",").alias("callees"))


@query(f"WITH {CHUNKS} SELECT doc_id, CASE WHEN file_path LIKE 'src1/%' THEN substr(file_path, 6) ELSE file_path END AS file_path, start_line, end_line FROM chunks")
def search_hit_projection(spark, sf):
    return chunk_rows(spark, sf).select("doc_id", search.relative(F.col("file_path"), "src1").alias("file_path"), "start_line", "end_line")


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 5 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT CAST(1 AS INTEGER) AS project, min(ts) AS burst_start, max(ts) AS burst_end, CAST(count(*) AS BIGINT) AS n_events FROM g GROUP BY island""")
def debounce_bursts(spark, sf):
    return bursts(table(spark, sf, "events").withColumn("project", F.lit(1)), ["project"])


@query("SELECT event_id, props->>'$.k' AS k, CAST(length(props) AS BIGINT) AS size FROM events")
def payload_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("size"))


@query("SELECT event_id, 'k' AS name, props->>'$.k' AS value FROM events")
def payload_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(text.payload(F.col("props"))).alias("name", "value"))


OPS = {"click": "create", "view": "chmod", "purchase": "write", "signup": "rename", "error": "other"}


@query("SELECT event_id, ts FROM events WHERE event_type IN ('click', 'purchase', 'signup')")
def relevant_events(spark, sf):
    e = table(spark, sf, "events")
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])[F.col("event_type")]
    return relevant(e.withColumn("op", op)).select("event_id", "ts")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN '/x/' ELSE '/r/' END || source || '/' || doc_id AS file_key FROM documents")
def file_keys(spark, sf):
    """The same file by a relative, an unclean and an absolute name."""
    d, path = F.col("doc_id") % 5, F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    shown = F.when(d == 0, path).when(d == 1, F.concat(F.lit("./a/..//"), path)).when(d == 2, F.concat(F.lit("/r/b/c/../../"), path))
    shown = shown.when(d == 3, F.concat(F.lit("../../x/"), path)).otherwise(F.concat(F.lit("/../r/./"), path))
    return table(spark, sf, "documents").select("doc_id", search.file_key(shown, "/r").alias("file_key"))


@query("""SELECT doc_id, 'f' || doc_id AS node_name, CAST(CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS start_line,
  CAST(CASE doc_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 4 END AS BIGINT) AS end_line, CASE doc_id % 3 WHEN 0 THEN '' ELSE 'f' || doc_id || '|' END || 'g' || source AS callees,
  doc_id % 3 = 0 AS has_error_return FROM documents""")
def table_chunks(spark, sf):
    """Every document as a source file of one function."""
    d, doc = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    language = F.when(d == 0, F.lit("go")).when(d == 1, F.lit("python")).otherwise(F.lit("javascript"))
    code = F.when(d == 0, F.format_string("package p\n\nfunc f%s(a int) error {\n\tg%s(a)\n\treturn nil\n}\n", doc, F.col("source")))
    code = code.when(d == 1, F.format_string("\ndef f%s(a):\n    g%s(a)\n    return a\n", doc, F.col("source")))
    code = code.otherwise(F.format_string("function f%s(a) {\n  g%s(a);\n  return a;\n}\n", doc, F.col("source")))
    files = table(spark, sf, "documents").select(doc.alias("file_path"), language.alias("language"), F.encode(code, "UTF-8").alias("content"))
    lines = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")]
    flag = F.coalesce("has_error_return", F.lit(False)).alias("has_error_return")
    return chunked(files).select(F.col("file_path").cast("long").alias("doc_id"), "node_name", *lines, F.array_join("callees", "|").alias("callees"), flag)


SOURCES = {
    "go": ("m.go", "package main\n\nimport \"fmt\"\n\n// says hello\nfunc hello(a, b int) error {\n\tfmt.Println(a)\n\treturn nil\n}\n\nfunc (c *T) Mul(x ...string) (n int, err error) {\n\tc.run(x)\n\treturn len(x), nil\n}\n\nfunc short() {}\n\ntype H func(a int) error\n\nvar h = func(a int) int {\n\treturn a\n}\n\nvar m = map[string]func(int) int{\n\t\"a\": h,\n}\n\nfunc after[T any](f func(T) bool) {\n\tf(nil)\n}\n"),
    "python": ("p/mod.py", "import os as o, sys\nfrom a.b import c\n\ndef one(x, y: int = 2) -> int:\n    z = f(x)\n    return z\n\nclass K:\n    def two(self):\n        def inner():\n            pass\n            return 1\n        return inner()\n\nasync def no():\n    await x()\n    return\n"),
    "javascript": ("a.js", "import x from 'm';\nconst y = require('n');\n/** Doc */\nfunction one(a, b = 2) {\n  if (a) { run(b); }\n  return a;\n}\nconst two = async (c) => {\n  go(c);\n};\nclass A extends B {\n  three(d) {\n    return d;\n  }\n}\n"),
    "typescript": ("a.ts", "// adds\nexport function add(a: number, ...b: number[]): number {\n  return sum(a, b);\n}\ninterface I { f(): void }\nclass C {\n  private async get(k?: Map<string, number>): Promise<void> {\n    await k;\n  }\n}\n"),
}
CHUNK_COLUMNS = ["node_name", "node_type", "start_line", "end_line", "signature", "param_types", "return_types", "callees", "imports", "doc", "package_name"]


def source_chunks(spark: SparkSession, language: str) -> DataFrame:
    path, code = SOURCES[language]
    files = spark.createDataFrame([(path, language, bytearray(code.encode()))], "file_path string, language string, content binary")
    rows = chunked(files)
    lists = {"param_types", "return_types", "callees", "imports"}
    return rows.select(*[F.array_join(c, "|").alias(c) if c in lists else F.col(c).cast("long").alias(c) if c.endswith("_line") else c for c in CHUNK_COLUMNS])


def expected(rows: list[tuple]) -> str:
    show = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    lines = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c.endswith("_line") else c for c in CHUNK_COLUMNS)
    return f"SELECT {cast} FROM (VALUES {lines}) t({', '.join(CHUNK_COLUMNS)})"


@query(expected([
    ("hello", "function_declaration", 6, 9, "func hello(a int, b int) error", "int|int", "error", "fmt.Println", "fmt", "says hello", "main"),
    ("(*T).Mul", "method_declaration", 11, 14, "func (c *T) Mul(x ...string) (n int, err error)", "...string", "int|error", "c.run|len", "fmt", "", "main"),
    ("after", "function_declaration", 28, 30, "func after(f func(T) bool)", "func(T) bool", "", "f", "fmt", "", "main"),
]))
def go_chunks(spark, sf):
    return source_chunks(spark, "go")


@query(expected([
    ("one", "function", 4, 7, "def one(x, y", "|int", "int", "one|f", "o=os|sys|a.b.c", "", "mod"),
    ("K.two", "method", 9, 14, "def two(self)", "", "", "two|inner", "o=os|sys|a.b.c", "", "mod"),
    ("K.inner", "method", 10, 12, "def inner()", "", "", "inner", "o=os|sys|a.b.c", "", "mod"),
]))
def python_chunks(spark, sf):
    return source_chunks(spark, "python")


@query(expected([
    ("one", "function", 4, 7, "function one(a, b = 2)", "a|b", "", "one|run", "m|n", "Doc", ""),
    ("two", "function", 8, 10, "const two = async (c) =>", "c", "", "async|go", "m|n", "", ""),
    ("A.three", "method", 12, 14, "A.three()", "d", "", "three", "m|n", "", ""),
]))
def ecmascript_chunks(spark, sf):
    return source_chunks(spark, "javascript")


@query(expected([
    ("add", "function", 2, 4, "function add(a: number, ...b: number[]): number", "number|number[]", "number", "add|sum", "", "adds", ""),
    ("C.get", "method", 7, 9, "C.get()", "Map<string, number>", "Promise<void>", "get", "", "", ""),
]))
def typescript_chunks(spark, sf):
    return source_chunks(spark, "typescript")

"""Search queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.functions.ids import scope_token, short_id
from lorekeep.functions.vectors import MIN_RELEVANCE, dot, embed
from lorekeep.operators import index, report, search
from lorekeep.operators.cells import VectorIndex
from lorekeep.plans.catalog import DOCUMENTS, EVENTS, NOW, documents, events, query, table
from lorekeep.session import shared_folder

TEXT = "why is the idiot pathetic when all rights are reserved"
TERMS = search.query_terms(TEXT)
LIMIT = 20

_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: len(t) > 0)"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_MEANING = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: len(t) > 1 AND NOT list_contains(" + _STOP + ", t))"


def _count(term: str) -> str:
    return " + ".join(f"{w} * len(list_filter({c}, lambda t: t = '{term}'))" for c, w in (("title_t", "10.0"), ("body_t", "1.0"), ("tags_t", "5.0")))


def _keyword(limit: int | None, where: str = "true") -> str:
    """CTEs that end with ``keyword`` (id, project, created_at, score)."""
    tf = ", ".join(f"{_count(t)} AS tf{i}" for i, t in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / average))" for i in range(len(TERMS)))
    cut = f"ORDER BY score DESC, id LIMIT {limit}" if limit else ""
    return f"""{DOCUMENTS}, tokened AS (
        SELECT *, {_TOKENS.format('title')} AS title_t, {_TOKENS.format('body')} AS body_t, {_TOKENS.format("array_to_string(tags, ' ')")} AS tags_t FROM docs
    ), counted AS (
        SELECT *, len(title_t) + len(body_t) + len(tags_t) AS length, {tf} FROM tokened
    ), stats AS (SELECT count(*) AS n, avg(length) AS average, {df} FROM counted),
    keyword AS (
        SELECT id, project, kind, title, created_at, {score} AS score FROM counted, stats
        WHERE {' + '.join(f'tf{i}' for i in range(len(TERMS)))} > 0 AND {where} {cut}
    )"""


def document_index(spark: SparkSession, sf_dir: str) -> index.SearchIndex:
    """The stored index of a folder's documents, brought up to them: the first search of a folder builds it, later ones
    compare hashes and index what has changed since."""
    folder = f"{shared_folder(spark)}/index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return index.SearchIndex(spark, folder).refresh(documents(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str, limit: int | None, **filters) -> DataFrame:
    return search.keyword_search(documents(spark, sf_dir), TEXT, limit, index=document_index(spark, sf_dir), **filters)


@query(f"WITH {_keyword(LIMIT)} SELECT id, project, title, round(score, 6) AS score FROM keyword")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a text, by BM25 over title, body and tags, from the inverted index."""
    return _found(spark, sf_dir, LIMIT).select("id", "project", "title", F.round("score", 6).alias("score"))


@query(f"WITH {_keyword(LIMIT)} SELECT id, project, title, round(score, 6) AS score FROM keyword")
def keyword_search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search without an index, as a table that is searched once may be."""
    return search.keyword_search(documents(spark, sf_dir), TEXT, LIMIT).select("id", "project", "title", F.round("score", 6).alias("score"))


@query(f"WITH {_keyword(LIMIT)} SELECT id, round(score, 6) AS score FROM keyword")
def keyword_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index alone: ids and scores from an index that is written first."""
    built = index.SearchIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    built.apply(documents(spark, sf_dir))
    return search.indexed_scores(built, TEXT).orderBy(F.desc("score"), "id").limit(LIMIT).select("id", F.round("score", 6).alias("score"))


_CHANGED = f"""{DOCUMENTS.replace('docs AS', 'before AS', 1)}, docs AS (
    SELECT id, project, kind, CASE WHEN doc_id % 3 = 1 THEN 'reserved ' || title ELSE title END AS title, CASE WHEN doc_id % 3 = 1 THEN split_part(body, chr(10), 1) ELSE body END AS body, tags, created_at, doc_id
    FROM before WHERE kind IS DISTINCT FROM 'fr')"""


@query(f"WITH {_keyword(LIMIT).replace(DOCUMENTS, _CHANGED)} SELECT id, round(score, 6) AS score FROM keyword")
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after all documents came in eight batches, a third of them was replaced in four, and those of a kind were removed.

    The same rows and scores as of an index that is built from what is left."""
    docs, kept = documents(spark, sf_dir), index.SearchIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    batch = F.pmod(F.col("doc_id"), F.lit(8))
    for number in range(8):
        kept.apply(docs.filter(batch == number))
    changed = docs.filter("doc_id % 3 = 1").withColumn("title", F.concat(F.lit("reserved "), F.col("title"))).withColumn("body", F.substring_index("body", "\n", 1))
    for number in range(4):
        kept.apply(changed.filter(batch % 4 == number))
    kept.apply(deletes=docs.filter("kind = 'fr'"))
    return search.indexed_scores(kept, TEXT).orderBy(F.desc("score"), "id").limit(LIMIT).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_keyword(None, chr(112) + 'roject = ' + chr(39) + 'src0' + chr(39))} SELECT id, round(score, 6) AS score FROM keyword")
def keyword_search_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits within one project; frequencies are those of the whole corpus."""
    return search.indexed_scores(document_index(spark, sf_dir), TEXT, "src0").select("id", F.round("score", 6).alias("score"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("kind"), "embedding", F.lit("own").alias("embedder"), (F.col("vec_id") * 60_000 + 1_700_000_000_000).alias("created_at"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").head()[0]


_DOT = "list_inner_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)))"
_VECTOR = f"""vector AS (
    SELECT CAST(e.vec_id AS VARCHAR) AS id, {_DOT} AS score
    FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q
    WHERE {_DOT} >= {MIN_RELEVANCE} ORDER BY score DESC, id LIMIT """


@query(f"WITH {_VECTOR}{LIMIT}) SELECT id, round(score, 6) AS score FROM vector")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to the first one, above the floor of relevance."""
    found = search.vector_search(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), LIMIT, embedder="own", floor=MIN_RELEVANCE)
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH newest AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 25000), q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT CAST(e.vec_id AS VARCHAR) AS id, round({_DOT}, 6) AS score FROM newest e, q ORDER BY {_DOT} DESC, id LIMIT {LIMIT}""")
def vector_search_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest among the newest 25,000: the documented cap on candidates."""
    found = search.vector_search(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), LIMIT, newest=25_000)
    return found.select("id", F.round("score", 6).alias("score"))


def _cells(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return VectorIndex(spark, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}").build(_vectors(spark, sf_dir))


@query(f"WITH {_VECTOR}{LIMIT}) SELECT id, round(score, 6) AS score FROM vector")
def vector_search_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors from an inverted file, of which only the cells are read that can hold one: an exact search."""
    found = _cells(spark, sf_dir).search(_query_vector(spark, sf_dir), LIMIT, exact=True, floor=MIN_RELEVANCE)
    return found.select("id", F.round("score", 6).alias("score"))


@query()
def vector_search_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector from as many cells as the index measured to need. Approximate: its recall is tested against all cells."""
    queries = _vectors(spark, sf_dir).select(F.col("id").alias("query_id"), "embedding")
    return _cells(spark, sf_dir).neighbours(queries, LIMIT).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_FUSE = """fused AS (
    SELECT id, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM (
        SELECT id, 0 AS list, row_number() OVER (ORDER BY score DESC, id) AS rank FROM keyword
        UNION ALL SELECT id, 1, row_number() OVER (ORDER BY score DESC, id) FROM vector)
    GROUP BY id ORDER BY score DESC, first, id LIMIT 20)"""


@query(f"WITH {_keyword(60)}, {_VECTOR}60), {_FUSE} SELECT id, round(score, 9) AS score FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword list and a vector list fused by reciprocal ranks."""
    keyword = search.indexed_scores(document_index(spark, sf_dir), TEXT).orderBy(F.desc("score"), "id").limit(60)
    vector = search.vector_search(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 60, floor=MIN_RELEVANCE)
    return search.fuse([keyword, vector], LIMIT).select("id", F.round("score", 9).alias("score"))


_OWN = _VECTOR.replace("WHERE", "WHERE e.vec_id IN (SELECT doc_id FROM documents) AND")


@query(f"""WITH {_keyword(60)}, {_OWN}60), {_FUSE}
    SELECT d.id, d.title, round(f.score * (0.7 + 0.3 * pow(0.5, greatest(0, {NOW} - d.created_at) / 86400000.0 / 45.0)), 9) AS score
    FROM fused f JOIN docs d ON f.id = d.id""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector search, fused, cut and weighed by recency; documents take the vector of their id."""
    vectors = _vectors(spark, sf_dir).select("id", "embedding", "embedder")
    rows = documents(spark, sf_dir).join(vectors, "id", "left")
    found = search.hybrid_search(rows, TEXT, _query_vector(spark, sf_dir), LIMIT, NOW, floor=MIN_RELEVANCE, index=document_index(spark, sf_dir))
    return found.select("id", "title", F.round("score", 9).alias("score"))


@query()
def hybrid_search_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with the builtin embedder on both sides. Not in SQL: feature hashing over UTF-16 units."""
    docs = documents(spark, sf_dir)
    vector = spark.createDataFrame([(TEXT,)], "text string").select(embed("text")).head()[0]
    rows = docs.withColumn("embedding", embed(F.concat_ws("\n", "title", "body"))).withColumn("embedder", F.lit("builtin"))
    found = search.hybrid_search(rows, TEXT, vector, LIMIT, NOW, embedder="builtin", floor=MIN_RELEVANCE, index=document_index(spark, sf_dir))
    return search.index_entries(found, TEXT)


@query(f"""WITH {EVENTS} SELECT id, round(value * (0.7 + 0.3 * pow(0.5, greatest(0, {NOW} - created_at) / 86400000.0 / 45.0)), 6) AS score FROM ev""")
def recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value, weighed by its age."""
    return events(spark, sf_dir).select("id", F.round(search.recency_boost(F.col("value"), F.col("created_at"), NOW), 6).alias("score"))


@query(rf"""WITH {DOCUMENTS}, t AS (SELECT id, project, 0 AS part, unnest({_TOKENS.format('title')}) AS term FROM docs
    UNION ALL SELECT id, project, 1, unnest({_TOKENS.format('body')}) FROM docs
    UNION ALL SELECT id, project, 2, unnest({_TOKENS.format("array_to_string(tags, ' ')")}) FROM docs),
    p AS (SELECT id, term, count(*) FILTER (part = 0) AS tf_title, count(*) FILTER (part = 1) AS tf_body, count(*) FILTER (part = 2) AS tf_tags FROM t GROUP BY id, term)
    SELECT term, count(*) AS documents, CAST(sum(tf_title) AS BIGINT) AS in_title, CAST(sum(tf_body) AS BIGINT) AS in_body, CAST(sum(tf_tags) AS BIGINT) AS in_tags FROM p GROUP BY term""")
def postings_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index, summed by term."""
    rows = index.postings(documents(spark, sf_dir))
    return rows.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf_title").alias("in_title"), F.sum("tf_body").alias("in_body"), F.sum("tf_tags").alias("in_tags"))


@query(rf"""WITH {DOCUMENTS}, p AS (SELECT DISTINCT item_id, unnest({_MEANING.format('text')}) AS term FROM benchmark),
    o AS (SELECT DISTINCT id, unnest({_MEANING.format("title || ' ' || id")}) AS term FROM docs)
    SELECT item_id AS prompt_id, id, count(*) AS shared FROM p JOIN o ON p.term = o.term GROUP BY 1, 2 HAVING count(*) >= 2""")
def tokenize_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and documents whose titles share at least two meaningful tokens."""
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), "text")
    return search.similar_prompts(prompts, documents(spark, sf_dir).select("id", "title", F.col("id").alias("snippet")), 2)


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '</?b>', '', 'g'), '[|`*]+', ' ', 'g'), '\s+', ' ', 'g')) AS flat FROM documents),
    c AS (SELECT *, substring(flat, 1, 110) AS cut, length(substring(flat, 1, 110)) - instr(reverse(substring(flat, 1, 110)), ' ') AS word FROM f)
    SELECT doc_id, CASE WHEN flat = '' THEN NULL WHEN length(flat) <= 110 THEN flat WHEN instr(cut, ' ') > 0 AND word > 66 THEN substring(cut, 1, word) || '…' ELSE cut || '…' END AS snippet FROM c""")
def snippet_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened, cut snippets of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query()
def search_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search shows, with the 14 words around the query's terms. Not in SQL: windows over words."""
    found = _found(spark, sf_dir, LIMIT)
    return report.index_line(search.index_entries(found, TEXT))


@query(f"WITH {DOCUMENTS} SELECT id, substring(id, 1, 13) AS short, CASE WHEN length(body) <= 2000 THEN body ELSE substring(body, 1, 2000) || chr(10) || '… ' || CAST(length(body) - 2000 AS VARCHAR) || ' more characters (raise `chars` to read them)' END AS clipped FROM docs")
def clipped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as a reader sees them."""
    return documents(spark, sf_dir).select("id", short_id(F.col("id")).alias("short"), T.clip_body(F.col("body"), 2000).alias("clipped"))


@query()
def feature_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's builtin vector, by its first component and its length. Tested against a plain loop."""
    vectors = documents(spark, sf_dir).select("id", embed(F.concat_ws("\n", "title", "body")).alias("v"))
    return vectors.select("id", F.size("v").alias("width"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"), F.round(dot(F.col("v"), F.col("v")), 4).alias("length"))


@query(r"""WITH RECURSIVE s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL),
    h AS (SELECT source, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM s UNION ALL
          SELECT source, i + 1, (xor(h, CAST(ascii(substring(source, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM h WHERE i < length(source))
    SELECT source, 'scope' || lower(to_base(h, 36)) AS token FROM h WHERE i = length(source)""")
def scope_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index word of every project."""
    return table(spark, sf_dir, "documents").select("source").filter("source is not null").distinct().select("source", scope_token(F.col("source")).alias("token"))

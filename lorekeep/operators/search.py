"""Keyword, vector and hybrid retrieval.

Tables are observations: id, project, title, body, tags, created_at, and others that pass through.
A keyword search answers from the inverted index (see operators.index) where it is given one; without, it reads the
table once for statistics and once for scores. Only the k best rows move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import STOPWORDS, best_window, meaningful_tokens, snippet, tokens
from lorekeep.functions.vectors import dot
from lorekeep.operators.index import SearchIndex

#: Weights of matches by column, and the two BM25 parameters.
TITLE_WEIGHT, BODY_WEIGHT, TAGS_WEIGHT, K1, B = 10.0, 1.0, 5.0, 1.2, 0.75
RRF_K, HALF_LIFE_DAYS, OVERFETCH = 60, 45.0, 3
DAY_MS = 86_400_000


def query_terms(text: str) -> list[str]:
    """The distinct meaningful tokens of a query, in order."""
    words = "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in STOPWORDS))


def _score(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def indexed_scores(index: SearchIndex, text: str, project: str | None = None) -> DataFrame:
    """id, score of all rows that hold a term of ``text``, from the folders of its terms.

    The corpus' size and average length stand in the index's manifest; how many rows hold a term is counted
    among the postings that are read."""
    hits = index.matches(query_terms(text))
    frequencies = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term of the text
    if project is not None:
        hits = hits.filter(F.col("project") == project)
    tf = F.col("tf_title") * TITLE_WEIGHT + F.col("tf_body") * BODY_WEIGHT + F.col("tf_tags") * TAGS_WEIGHT
    score = _score(tf, F.col("df"), F.lit(index.size), F.col("length"), F.lit(index.average_length))
    return hits.join(frequencies, "term").groupBy("id").agg(F.sum(score).alias("score"))


def keyword_search(observations: DataFrame, text: str, limit: int | None, project: str | None = None, where: Column | None = None, index: SearchIndex | None = None) -> DataFrame:
    """The rows that hold a term of ``text``, with their BM25 score, best first.

    Frequencies count over the whole table; the filters choose among its rows. Without a meaningful
    term, nothing is found. With an ``index`` of the table, its texts aren't read but for the rows found."""
    terms = query_terms(text)
    if not terms:
        return observations.limit(0).withColumn("score", F.lit(0.0))
    if index is not None:
        found = indexed_scores(index, text, project)
        if where is not None:
            found = found.join(observations.filter(where).select("id"), "id", "left_semi")
        if limit is None:
            return observations.join(found, "id").select(*observations.columns, "score")
        best = found.orderBy(F.desc("score"), "id").limit(limit)  # at most ``limit`` rows, so they are broadcast
        return observations.join(F.broadcast(best), "id").select(*observations.columns, "score").orderBy(F.desc("score"), "id")
    columns = [(tokens(F.coalesce(c, F.lit(""))), w) for c, w in ((F.col("title"), TITLE_WEIGHT), (F.col("body"), BODY_WEIGHT), (F.array_join("tags", " "), TAGS_WEIGHT))]
    names = [f"__c{i}" for i in range(len(columns))]
    rows = observations.select("*", *(c.alias(n) for (c, _), n in zip(columns, names, strict=True)))

    def frequency(term: str) -> Column:
        return sum((F.size(F.filter(n, lambda t: t == term)) * w for n, (_, w) in zip(names, columns, strict=True)), F.lit(0.0))

    tf = [frequency(term).alias(f"__tf{i}") for i, term in enumerate(terms)]
    rows = rows.select("*", *tf, sum((F.size(n) for n in names), F.lit(0)).alias("__length")).drop(*names)
    stats = rows.agg(F.count("*").alias("__n"), F.avg("__length").alias("__average"), *(F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))))
    hits = rows.filter(sum((F.col(f"__tf{i}") for i in range(len(terms))), F.lit(0.0)) > 0)
    if project is not None:
        hits = hits.filter(F.col("project") == project)
    if where is not None:
        hits = hits.filter(where)
    score = sum((_score(F.col(f"__tf{i}"), F.col(f"__df{i}"), F.col("__n"), F.col("__length"), F.col("__average")) for i in range(len(terms))), F.lit(0.0))
    found = hits.crossJoin(F.broadcast(stats)).select(*observations.columns, score.alias("score"))  # stats is one row
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


def vector_search(observations: DataFrame, query: Sequence[float], limit: int, embedder: str | None = None, floor: float | None = None, newest: int | None = None, where: Column | None = None) -> DataFrame:
    """The rows nearest to ``query`` by inner product, of those the same embedder made (or an unknown one)."""
    rows = observations.filter(F.col("embedding").isNotNull())
    if embedder is not None:
        rows = rows.filter((F.col("embedder") == embedder) | F.col("embedder").isNull())
    if where is not None:
        rows = rows.filter(where)
    if newest is not None:
        rows = rows.orderBy(F.desc("created_at"), "id").limit(newest)
    scored = rows.withColumn("score", dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))))
    best = scored.orderBy(F.desc("score"), "id").limit(limit)
    return best if floor is None else best.filter(F.col("score") >= floor)  # the same rows as when filtered before, where Spark would score each row twice


def fuse(rankings: Sequence[DataFrame], limit: int) -> DataFrame:
    """id, score: reciprocal ranks summed over ranked lists (id, score); the sizes of scores don't matter."""
    order = Window.orderBy(F.desc("score"), "id")  # lists of at most a few times the limit
    ranked = [r.select("id", F.row_number().over(order).alias("rank"), F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    union = ranked[0]
    for r in ranked[1:]:
        union = union.unionByName(r)
    fused = union.groupBy("id").agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("__first"))
    return fused.orderBy(F.desc("score"), "__first", "id").limit(limit).select("id", "score")


def recency_boost(score: Column, created_at: Column, now: int, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """The score, of which up to 30 % decays with age."""
    age = F.greatest(F.lit(0), F.lit(now) - created_at) / DAY_MS
    return score * (0.7 + 0.3 * F.pow(F.lit(0.5), age / half_life_days))


def hybrid_search(observations: DataFrame, text: str, vector: Sequence[float] | None, limit: int, now: int, **filters) -> DataFrame:
    """Keyword and vector lists fused by rank, cut, then weighed by recency and sorted again.

    ``filters`` are those of the two searches, ``index`` included."""
    keyword_filters = {k: v for k, v in filters.items() if k in ("project", "where", "index")}
    lists = [keyword_search(observations, text, limit * OVERFETCH, **keyword_filters).select("id", "score")]
    if vector is not None and query_terms(text):
        vector_filters = {k: v for k, v in filters.items() if k in ("embedder", "floor", "newest", "where")}
        if "project" in filters:
            own = F.col("project") == filters["project"]
            vector_filters["where"] = own & vector_filters["where"] if "where" in vector_filters else own
        lists.append(vector_search(observations, vector, limit * OVERFETCH, **vector_filters).select("id", "score"))
    fused = F.broadcast(fuse(lists, limit))  # at most ``limit`` rows
    boosted = observations.join(fused, "id").withColumn("score", recency_boost(F.col("score"), F.col("created_at"), now))
    return boosted.orderBy(F.desc("score"), "id")


def index_entries(found: DataFrame, text: str | None = None) -> DataFrame:
    """What a search shows: never the body, but a snippet of it around the query's terms."""
    terms = F.array(*map(F.lit, query_terms(text))) if text else None
    shown = snippet(best_window(F.col("body"), terms) if terms is not None else F.col("body"))
    return found.select("id", "kind", "title", "project", "created_at", "score", shown.alias("snippet"))


def similar_prompts(prompts: DataFrame, observations: DataFrame, least: int) -> DataFrame:
    """prompt_id, id, shared: pairs with at least ``least`` distinct meaningful tokens in common.

    An equi-join on tokens, so only pairs that share one are formed."""
    wanted = prompts.select("prompt_id", F.explode(F.array_distinct(meaningful_tokens(F.col("text")))).alias("term"))
    offered = observations.select("id", F.explode(F.array_distinct(meaningful_tokens(F.concat_ws(" ", "title", "snippet")))).alias("term"))
    return wanted.join(offered, "term").groupBy("prompt_id", "id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


"""Ranked lexical search: the best documents for each of a set of queries, by integer arithmetic.

Postings are a stored table in folders by term bucket; a frequent term's postings are dealt over
several files by document. A search reads the postings of the items' terms, deals them by document, joins the
items that hold the term, and sums the scores of each item and document where they are: after the deal by
document no other row of that document lies elsewhere. Only the k best rows an item and task are shuffled.

Terms are the maximal runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased. With
N documents that hold a term, L terms in all, n of one document, df documents of a term and tf
occurrences in one, a match scores w * (10^9 tf div (1000 tf + 8 m)), where
w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 10 + (90 n N div L).

Defined cases: null and empty texts have no terms and are found by nothing; an item without terms finds nothing;
rows that repeat an id are documents (items) of their own; equal scores rank by doc_id, null last; a
document whose score is 0 isn't returned. Other columns of both tables are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import BROADCAST_BYTES, discard, shared_folder, slices, small, stored, tidy
from lorekeep.llm.words import MARKS, table_of, words

#: The pattern of a term, for plans that split with Spark's own functions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Folders of the postings, and files that one folder is dealt over.
BUCKETS, PARTS = 64, 8
POSTINGS = "term string, row long, doc_id long, n long, tf long"


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    upper = "".join(map(chr, range(65, 91)))
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(TERM), F.lit(0))


def _post(wanted: pa.Array | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = table_of(MARKS)
    schema = pa.schema([("term", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = itertools.count(TaskContext.get().partitionId() << 33)
        for batch in slices(batches):
            codes, vocabulary, ends = words(batch.column("text"), table)
            n = np.diff(ends, prepend=0)
            rows = np.fromiter(itertools.islice(first, batch.num_rows), np.int64, batch.num_rows)
            documents = np.repeat(np.arange(batch.num_rows), n)
            if wanted is not None and len(vocabulary):
                kept = pc.is_in(vocabulary, value_set=wanted).to_numpy(zero_copy_only=False)[codes]
                codes, documents = codes[kept], documents[kept]
            keys, tf = np.unique(documents * max(1, len(vocabulary)) + codes, return_counts=True)
            at, code = np.divmod(keys, max(1, len(vocabulary)))
            columns = [vocabulary.take(pa.array(code)), rows[at], batch.column("doc_id").take(pa.array(at)), n[at], tf]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            # The batch's share of N and L, as a row without a term.
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, int((n > 0).sum()), None, int(n.sum()), 0), schema, strict=True)], schema=schema)

    return tidy(run)


def bucket_of(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def write_postings(docs: DataFrame, folder: str, only: DataFrame | None = None) -> None:
    """Stores the postings of ``docs`` (doc_id, text) in folders by term bucket; ``only`` (term, distinct) leaves out all other terms.

    Terms without a document and the corpus' counts lie in the bucket -1. The terms of ``only`` are tested in
    the scan if their counted size allows it, else by a join."""
    wanted = None
    if only is not None:
        size = only.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).head()[0]
        if size <= BROADCAST_BYTES:
            wanted = only.select("term").toArrow().column("term").combine_chunks().cast(pa.string())
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_post(wanted), POSTINGS)
    if only is not None and wanted is None:
        rows = rows.filter("term is not null").join(only, "term", "left_semi").select("term", "row", "doc_id", "n", "tf").unionByName(rows.filter("term is null"))
    rows = rows.withColumn("bucket", F.coalesce(bucket_of(F.col("term")), F.lit(-1)))
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
    rows.sortWithinPartitions("bucket", "term", "row").write.option("compression", "zstd").partitionBy("bucket").parquet(folder)


def read_postings(spark, folder: str) -> DataFrame:
    return spark.read.schema(f"{POSTINGS}, bucket int").parquet(folder)


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id, term: the distinct terms of each item."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    return numbered.select("item", "item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))


def search(postings: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item (see item_terms)."""
    corpus = postings.filter("bucket = -1").agg(F.coalesce(F.sum("row"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).head()
    found = postings.filter("bucket >= 0")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * corpus["docs"] + 2.0) / (2 * F.col("df") + 1)))
    frequencies = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = stored(wanted.join(frequencies, "term").select("item", "item_id", "term", weight.cast("long").alias("w")).filter("w > 0"), "weighted")
    bytes_each = 96 + (weighted.agg(F.max(F.octet_length("term"))).head()[0] or 0)
    m = F.expr(f"10 + ((90 * n * {corpus['docs']}L) div {max(1, corpus['terms'])}L)")
    dealt = found.select("term", "row", "doc_id", "tf", m.alias("m")).repartition("row")
    score = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")
    summed = dealt.join(small(weighted, bytes_each), "term").groupBy("row", "doc_id", "item", "item_id").agg(F.sum(score).alias("score")).filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    wanted = stored(item_terms(items), "items")
    terms = stored(wanted.select("term").distinct(), "terms")
    folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    write_postings(docs, folder, terms)
    discard(terms)
    return search(read_postings(spark, folder), wanted, k)

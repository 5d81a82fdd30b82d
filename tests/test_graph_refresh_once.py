"""How often a refresh works out the source text that it's given."""

from pyspark.sql import functions as F

from lorekeep.operators.graph_store import CodeGraph
from lorekeep.sources.versions import Tables

from .test_graph_store import BASE


def test_source_is_worked_out_for_hashes_and_for_lines_alone(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(source):
        read.add(1)
        return source

    rows = spark.createDataFrame(sorted(BASE.items()), "file string, source string")
    made = rows.withColumn("source", F.udf(counted, "string")("source")).withColumn("hash", F.sha2("source", 256))
    kept = CodeGraph(spark, Tables(spark, f"{tmp_path}/kept"), "p")
    assert kept.refresh(made)["read"] == len(BASE)
    assert 0 < read.value <= 2 * len(BASE)
    assert kept.read("symbols").count() == 7 and kept.read("files").count() == len(BASE)

"""Store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import report, store
from lorekeep.plans.catalog import DOCUMENTS, EVENTS, NOW, documents, events, query, table

MID = 1_705_276_800_000  # 2024-01-15


@query(f"WITH {EVENTS} SELECT id, project, kind, created_at FROM ev WHERE kind = 'error' AND status = 'open' AND created_at > {MID} ORDER BY created_at, id LIMIT 1000")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 1000: the oldest open errors after a time."""
    return store.list_page(events(spark, sf_dir), kind="error", status="open", after=MID).select("id", "project", "kind", "created_at")


@query(f"WITH {EVENTS} SELECT id, created_at FROM ev WHERE created_at BETWEEN {MID} AND {MID + 86_400_000}")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day, both ends inclusive."""
    return events(spark, sf_dir).filter(store.in_range(F.col("created_at"), MID, MID + 86_400_000)).select("id", "created_at")


@query(f"WITH {EVENTS} SELECT id, kind FROM ev WHERE starts_with(id, '12') OR starts_with(id, '7_') OR starts_with(id, '99')")
def get_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by id prefixes; a wildcard stands for itself."""
    return store.get_by_ids(events(spark, sf_dir), ["12", "7_", "99"]).select("id", "kind")


_SESSIONS = """s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS project, c_custkey * 1000 AS started_at,
    CASE WHEN c_acctbal > 0 THEN c_custkey * 1000 + 500 END AS ended_at, CASE WHEN c_acctbal > 0 THEN c_name END AS summary FROM customer)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, paid = table(spark, sf_dir, "customer"), F.col("c_acctbal") > 0
    return c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_mktsegment").alias("project"),
        (F.col("c_custkey") * 1000).alias("started_at"),
        F.when(paid, F.col("c_custkey") * 1000 + 500).alias("ended_at"),
        F.when(paid, F.col("c_name")).alias("summary"),
    )


@query(f"WITH {_SESSIONS} SELECT id, summary FROM s WHERE project = 'MACHINERY' AND summary IS NOT NULL ORDER BY started_at DESC, id LIMIT 5")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent_sessions(_sessions(spark, sf_dir), "MACHINERY", 5).select("id", "summary")


@query(f"WITH {_SESSIONS} SELECT id, project, started_at, ended_at, summary FROM s WHERE id = '17'")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).filter(F.col("id") == "17")


@query(f"WITH {EVENTS} SELECT id, kind FROM ev WHERE list_contains(tags, 'k7')")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole tag, not a prefix of one."""
    return events(spark, sf_dir).filter(F.array_contains("tags", "k7")).select("id", "kind")


@query(f"""WITH {EVENTS}, a AS (SELECT * FROM ev WHERE starts_with(id, '42') ORDER BY id LIMIT 1)
    SELECT id, project, created_at FROM (
        (SELECT ev.* FROM ev, a WHERE ev.project = a.project AND (ev.created_at, ev.id) <= (a.created_at, a.id) ORDER BY ev.created_at DESC, ev.id DESC LIMIT 6)
        UNION (SELECT ev.* FROM ev, a WHERE ev.project = a.project AND (ev.created_at, ev.id) > (a.created_at, a.id) ORDER BY ev.created_at, ev.id LIMIT 5))""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows before and after an anchor given by a short id."""
    return store.timeline(events(spark, sf_dir), "42", 5, 5).select("id", "project", "created_at")


@query(f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at, id) AS place FROM ev)
    SELECT a.id AS anchor_id, b.id, CAST(b.place - a.place AS INTEGER) AS "offset" FROM n a JOIN n b ON a.project = b.project AND b.place BETWEEN a.place - 2 AND a.place + 2 WHERE a.kind = 'error'""")
def timeline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every error."""
    return store.timeline_all(events(spark, sf_dir), F.col("kind") == "error", 2, 2).select("anchor_id", "id", "offset")


@query(f"WITH {EVENTS} SELECT project, count(*) AS observations, max(created_at) AS last_active FROM ev GROUP BY project")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.project_summary(events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def stats_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_kind(events(spark, sf_dir))


_VIEW = "v AS (SELECT id, status AS kind, created_at FROM ev WHERE kind = 'click' ORDER BY created_at, id LIMIT 500)"


def _viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("id", F.col("kind").alias("project"), F.col("status").alias("kind"), "created_at")
    return report.viewed(rows, "click")


@query(f"WITH {EVENTS}, {_VIEW} SELECT kind, count(*) AS n FROM v GROUP BY kind")
def view_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds among the oldest 500 rows of a project, which is what a view covers."""
    return report.by_kind(_viewed(spark, sf_dir))


@query(f"WITH {EVENTS}, {_VIEW} SELECT id, kind, created_at FROM v ORDER BY created_at DESC, id LIMIT 80")
def view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 80 of a view's rows."""
    return report.view_page(_viewed(spark, sf_dir)).select("id", "kind", "created_at")


@query(f"""WITH {DOCUMENTS} SELECT id, 'id: ' || left(id, 8) || chr(10) || 'kind: ' || kind || chr(10) || 'when: ' || strftime(make_timestamp(created_at * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || chr(10)
        || CASE WHEN project <> '' THEN 'who: ' || project || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'files: a/' || id || ', b' || chr(10) ELSE '' END || chr(10) || coalesce(title, '') || chr(10) || chr(10)
        || CASE WHEN length(coalesce(body, '')) <= 2000 THEN coalesce(body, '') ELSE substring(body, 1, 2000) || chr(10) || '… ' || (length(body) - 2000) || ' more characters (raise `chars` to read them)' END AS "full" FROM docs""")
def full_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in full, with its source as the author."""
    files = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("a/"), "id"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return report.full_entry(documents(spark, sf_dir).withColumn("author", F.col("project")).withColumn("files", files))


@query(f"""WITH {DOCUMENTS}, e AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS rank, coalesce(title, '') AS named, make_timestamp(created_at * 1000) AS moment FROM docs),
    l AS (SELECT project, rank, id, left(id, 8) || ' ' || kind || ' ' || strftime(moment, '%Y-%m') || ' ' || named || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '    ' || lang_note ELSE '' END AS shown FROM (SELECT *, 'in ' || kind AS lang_note FROM e) WHERE rank > 1),
    f AS (SELECT *, sum(length(shown) + 1) OVER (PARTITION BY project ORDER BY rank) - 1 AS spent FROM l),
    p AS (SELECT project, 1 AS part, rank, shown FROM f WHERE spent <= 700 UNION ALL
          SELECT project, 0, rank, left(id, 8) || ' ' || kind || ' ' || strftime(moment, '%Y-%m-%d') || ' ' || named || chr(10) || CASE WHEN length(coalesce(body, '')) <= 900 THEN coalesce(body, '') ELSE substring(body, 1, 900) || chr(10) || '... [truncated]' END FROM e WHERE rank = 1),
    b AS (SELECT project, '<recalled-memory>' || chr(10) || string_agg(shown, chr(10) ORDER BY part, rank) || chr(10) || '</recalled-memory>' AS block FROM p GROUP BY project)
    SELECT project, block, CAST(round(length(block) / 4) AS BIGINT) AS tokens FROM b""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the block for a prompt: the newest document with its text, lines of the next ones."""
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created_at"), "id"))
    rows = documents(spark, sf_dir).withColumn("rank", rank).withColumn("expand", F.col("rank") == 1)
    return report.prompt_block(rows.withColumn("snippet", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("in "), "kind"))), "project")


@query(f"WITH {EVENTS}, t AS (SELECT unnest(tags) AS tag FROM ev) SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def stats_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent tags."""
    return report.top_tags(events(spark, sf_dir))


@query(f"""WITH {DOCUMENTS} SELECT count(*) AS total, count(e.vec_id) AS embedded, min(created_at) AS oldest, max(created_at) AS newest
    FROM docs LEFT JOIN embeddings e ON docs.doc_id = e.vec_id""")
def stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return report.totals(documents(spark, sf_dir).join(vectors, "doc_id", "left"))


_OLD = "o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')"
_NEW = "n AS (SELECT o_orderkey AS id, 'new' AS status, max(l_extendedprice) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_orderkey)"


#: Rows of line items whose orders a task gets.
_TASK_ROWS = 500_000


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides are dealt by id over tasks of bounded size, so that joins and groups by id need no further shuffle, and no
    side is broadcast because its file is small."""
    orders, lines, date = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), F.col("o_orderdate").cast("date")
    tasks = 1 + lines.count() // _TASK_ROWS
    old = orders.filter(date < F.lit("1999-01-01").cast("date")).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    lines = lines.select(F.col("l_orderkey").alias("id"), "l_extendedprice").repartition(tasks, "id")
    wanted = orders.filter(date >= F.lit("1998-01-01").cast("date")).select(F.col("o_orderkey").alias("id")).repartition(tasks, "id")
    new = wanted.join(lines.hint("merge"), "id").groupBy("id").agg(F.lit("new").alias("status"), F.max("l_extendedprice").alias("price"))
    return old.repartition(tasks, "id").hint("merge"), new.hint("merge")


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace old ones of the same id."""
    return store.upsert(*_old_and_new(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT project, arg_max(id, (created_at, id)) AS id, max(created_at) AS created_at FROM ev GROUP BY project")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    rows = events(spark, sf_dir).select("project", "id", "created_at")
    return store.latest(rows, ["project"], [F.col("created_at"), F.col("id")])


@query(f"""WITH {_SESSIONS}, n AS (SELECT CAST(o_custkey AS VARCHAR) AS id, 'late' AS project, CAST(0 AS BIGINT) AS started_at, max(o_orderkey) AS ended_at,
        CASE WHEN count(*) > 12 THEN CAST(count(*) AS VARCHAR) || ' orders' END AS summary FROM orders GROUP BY o_custkey)
    SELECT coalesce(s.id, n.id) AS id, CASE WHEN s.id IS NULL THEN n.project ELSE s.project END AS project, CASE WHEN s.id IS NULL THEN n.started_at ELSE s.started_at END AS started_at,
           coalesce(n.ended_at, s.ended_at) AS ended_at, coalesce(n.summary, s.summary) AS summary FROM s FULL JOIN n ON s.id = n.id""")
def coalesce_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions keep where and when they began; ends and summaries are filled."""
    many = F.when(F.count("*") > 12, F.concat(F.count("*").cast("string"), F.lit(" orders")))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.lit("late").alias("project"), F.lit(0).cast("long").alias("started_at"), F.max("o_orderkey").alias("ended_at"), many.alias("summary"))
    return store.coalescing_upsert(_sessions(spark, sf_dir), new)


@query(f"WITH {_SESSIONS} SELECT id, CASE WHEN id <> '3' THEN summary END AS summary FROM s")
def clear_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.clear_summary(_sessions(spark, sf_dir), "3").select("id", "summary")


@query(f"WITH {EVENTS} SELECT id, kind, created_at FROM ev WHERE NOT (kind = 'view' AND created_at < {MID})")
def delete_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delete of old views leaves."""
    return store.remove(events(spark, sf_dir), kind="view", before=MID).select("id", "kind", "created_at")


@query(f"WITH {EVENTS} SELECT project, count(*) AS n FROM ev WHERE created_at < {NOW - 20 * 86_400_000} GROUP BY project")
def prune_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning after 20 days would remove, by project."""
    return events(spark, sf_dir).filter(store.removal(before=NOW - 20 * 86_400_000)).groupBy("project").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT id, CASE WHEN status = 'open' AND list_contains(['click', 'view'], kind) THEN 'done' ELSE status END AS status FROM ev")
def close_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open clicks and views are closed."""
    return store.close(events(spark, sf_dir), F.col("kind").isin("click", "view")).select("id", "status")


@query("""WITH f AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS files FROM orders GROUP BY o_custkey)
    SELECT o_custkey, len(list_intersect(files, ['1-URGENT', '2-HIGH'])) = 0 AS landed FROM f""")
def landed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers none of whose order priorities are among the dirty ones."""
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("files"))  # five values at most
    return files.select("o_custkey", store.all_clean(F.col("files"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("landed"))


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.status IS DISTINCT FROM n.status""")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two states of a table."""
    return store.changes(*_old_and_new(spark, sf_dir), "id", "status")


@query(f"""WITH {_OLD}, {_NEW} SELECT 'a' AS store, count(*) AS n FROM (SELECT id FROM o UNION SELECT id FROM n) UNION ALL
    SELECT 'b', count(*) FROM (SELECT id FROM o UNION SELECT id FROM n)""")
def two_way_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a sync both stores hold all ids."""
    a, b = store.two_way_sync(*_old_and_new(spark, sf_dir))
    count = lambda df, name: df.agg(F.lit(name).alias("store"), F.count("*").alias("n"))
    return count(a, "a").unionByName(count(b, "b"))


@query(f"WITH {_OLD}, {_NEW} SELECT n.* FROM n WHERE id NOT IN (SELECT id FROM o)")
def sync_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first store lacks of the second."""
    return store.missing(*_old_and_new(spark, sf_dir))


@query(f"WITH {DOCUMENTS} SELECT CASE WHEN project = 'src1' THEN 'src0' ELSE project END AS project, count(*) AS n FROM docs GROUP BY 1")
def merge_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge_project(documents(spark, sf_dir), "src1", "src0").groupBy("project").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS}, r AS (SELECT kind AS session_id, id, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id) AS n FROM ev) SELECT session_id, id FROM r WHERE n <= 300""")
def last_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 300 shown ids of each session; there are as many sessions as types of event, each with more."""
    shown = events(spark, sf_dir).select(F.col("kind").alias("session_id"), "id", F.col("created_at").alias("shown_at"))
    return store.last_shown(shown).select("session_id", "id")


@query(f"""WITH {EVENTS} SELECT id FROM ev WHERE id NOT IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem)""")
def not_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that weren't shown before."""
    shown = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("id"))
    return store.not_shown(events(spark, sf_dir), shown).select("id")


@query(f"""WITH {EVENTS}, c AS (SELECT *, sum(length(id) + length(kind) + 1) OVER (PARTITION BY project ORDER BY created_at DESC, id) AS upto FROM ev)
    SELECT project, id FROM c WHERE upto - 1 <= 700""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest lines of each project within 700 characters."""
    order = [F.desc("created_at"), F.col("id")]
    return report.within_budget(events(spark, sf_dir), ["project"], order, F.length("id") + F.length("kind"), 700).select("project", "id")


@query(f"WITH {EVENTS} SELECT id, created_at FROM ev WHERE status = 'open' ORDER BY created_at DESC, id LIMIT 3")
def open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest open rows, as a session starts with them."""
    return report.open_work(events(spark, sf_dir)).select("id", "created_at")


@query(f"""WITH {EVENTS}, w AS (SELECT CAST(o_custkey AS VARCHAR) AS project, {NOW} AS last_worked FROM orders GROUP BY o_custkey), r AS (SELECT project, max(created_at) AS last_recorded FROM ev GROUP BY project)
    SELECT w.project, last_worked, last_recorded, 'just now' AS age, last_worked - coalesce(last_recorded, 0) > 172800000 AS stalled FROM w LEFT JOIN r ON w.project = r.project""")
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that are worked on, and whether recording stalled."""
    worked = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("project"), F.lit(NOW).alias("worked_at"))
    return report.activity(events(spark, sf_dir), worked, NOW)


@query(f"""WITH {EVENTS}, a AS (SELECT id, ({NOW} - created_at) // 1000 AS s FROM ev)
    SELECT id, CASE WHEN s // 86400 >= 1 THEN CAST(s // 86400 AS VARCHAR) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago'
        WHEN s // 3600 >= 1 THEN CAST(s // 3600 AS VARCHAR) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
        WHEN s // 60 >= 1 THEN CAST(s // 60 AS VARCHAR) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' ELSE 'just now' END AS age FROM a""")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("id", report.age_text(F.col("created_at"), NOW).alias("age"))


@query(f"WITH {EVENTS} SELECT count(*) AS removed FROM ev WHERE kind = 'view' AND created_at < {MID}")
def forget_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a filtered delete takes away."""
    return store.removed_count(events(spark, sf_dir), kind="view", before=MID)


@query(f"WITH {EVENTS} SELECT id, project FROM ev WHERE project IS DISTINCT FROM '7'")
def project_wipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a table when a project is wiped."""
    return store.wiped({"observations": events(spark, sf_dir)}, "7")["observations"].select("id", "project")


@query("SELECT DISTINCT o_custkey AS session_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def cursor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors that stay: those whose transcript still exists."""
    cursors = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("session_id")).distinct()
    live = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal > 0").select(F.col("c_custkey").alias("session_id"))
    return store.swept(cursors, live)


@query("""SELECT o_orderkey AS id, o_custkey AS project FROM orders WHERE o_orderstatus <> 'F'
    AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def session_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions another store has and this one lacks, of projects with observations."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sessions = rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderstatus").alias("status"))
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal > 0").select(F.col("c_custkey").alias("project"))
    return store.session_sync(sessions.filter("status = 'F'"), sessions.filter("status <> 'F'").drop("status"), known).select("id", "project")

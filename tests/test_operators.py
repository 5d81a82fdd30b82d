import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.ids import SHORT
from lorekeep.operators import capture, graph, index, report, search, store, usages

DAY = search.DAY_MS


@pytest.fixture
def observations(spark):
    rows = [
        ("1" * 36, "s", "p", "decision", "Websocket reconnect storm", "backoff was added to the websocket", ["auth", "realtime"], 1_000, "open"),
        ("2" * 36, "s", "p", "bugfix", "Websocket reconnect loses auth", "token refresh", ["auth"], 2_000, "done"),
        ("3" * 36, "s", "p", "pattern", "Virtualized list", "rows are recycled", ["performance"], 3_000, "done"),
        ("4" * 36, "s", "q", "deadend", "Redux for the editor", "performance got worse", ["state"], 4_000, "open"),
    ]
    return spark.createDataFrame(rows, "id string, session_id string, project string, kind string, title string, body string, tags array<string>, created_at long, status string")


def ids(df):
    return [r["id"][0] for r in df.collect()]


def test_keyword_search(observations):
    assert set(ids(search.keyword_search(observations, "websocket reconnect", 10))) == {"1", "2"}
    assert set(ids(search.keyword_search(observations, "performance", 10))) == {"3", "4"}
    assert ids(search.keyword_search(observations, "websocket", 10, where=F.array_contains("tags", "realtime"))) == ["1"]
    assert ids(search.keyword_search(observations, "websocket", 10, where=F.array_contains("tags", "real"))) == []
    assert ids(search.keyword_search(observations, "redux", 10, where=F.col("kind") == "deadend")) == ["4"]
    assert ids(search.keyword_search(observations, "websocket", 10, project="q")) == []
    assert ids(search.keyword_search(observations, "the of", 10)) == []


def test_fuse(spark):
    lists = [spark.createDataFrame([(x, float(9 - i)) for i, x in enumerate(names)], "id string, score double") for names in ("abc", "caz")]
    found = [r["id"] for r in search.fuse(lists, 3).collect()]
    assert found[0] == "a" and set(found) == {"a", "b", "c"}
    loud = spark.createDataFrame([("loser", 9999.0), ("filler", 5000.0)], "id string, score double")
    quiet = spark.createDataFrame([("winner", 0.00001)], "id string, score double")
    assert [r["id"] for r in search.fuse([loud, quiet], 3).collect()] == ["loser", "winner", "filler"]


def test_recency(value):
    boost = lambda t: search.recency_boost(F.lit(1.0), t, 45 * DAY)
    assert value(boost, 45 * DAY, kind="long") == pytest.approx(1.0)
    assert value(boost, 0, kind="long") == pytest.approx(0.85)
    assert value(boost, 90 * DAY, kind="long") == pytest.approx(1.0)


def test_hybrid_and_vectors(spark, observations):
    vectors = observations.withColumn("embedding", F.when(F.col("kind") == "pattern", F.array(F.lit(1.0), F.lit(0.0)))).withColumn("embedder", F.lit("m"))
    assert ids(search.vector_search(vectors, [1.0, 0.0], 5, embedder="m")) == ["3"]
    assert ids(search.vector_search(vectors, [1.0, 0.0], 5, embedder="other")) == []
    assert set(ids(search.hybrid_search(vectors, "websocket", [1.0, 0.0], 5, 10_000))) == {"1", "2", "3"}
    assert ids(search.hybrid_search(vectors, "of the", [1.0, 0.0], 5, 10_000)) == []
    shown = search.index_entries(search.keyword_search(observations, "websocket", 5), "websocket")
    assert "body" not in shown.columns and shown.count() == 2


def test_postings(observations):
    row = index.postings(observations).filter("term = 'websocket' and id like '1%'").head()
    assert (row["tf_title"], row["tf_body"], row["tf_tags"]) == (1, 1, 0)


def test_store(spark, observations):
    assert ids(store.list_page(observations, project="p", after=1_000, limit=1)) == ["2"]
    assert ids(store.get_by_ids(observations, ["33"])) == ["3"]
    new = observations.filter("id like '1%'").withColumn("title", F.lit("new"))
    upserted = store.upsert(observations, new)
    assert upserted.count() == 4 and upserted.filter("title = 'new'").count() == 1
    assert ids(store.remove(observations, ids=[])) == ["1", "2", "3", "4"]
    assert ids(store.remove(observations, ids=["2222222222222"])) == ["1", "3", "4"]
    assert ids(store.remove(observations, project="p", before=2_500)) == ["3", "4"]
    assert store.remove(observations).count() == 0
    closed = store.close(observations, F.col("id").startswith("1"))
    assert {r["id"][0]: r["status"] for r in closed.collect()} == {"1": "done", "2": "done", "3": "done", "4": "open"}
    assert ids(store.timeline(observations, "2222", 1, 1)) == ["1", "2", "3"]
    assert {(r["anchor_id"][0], r["id"][0]) for r in store.timeline_all(observations, F.col("kind") == "bugfix", 1, 1).collect()} == {("2", "1"), ("2", "2"), ("2", "3")}
    assert store.ping(spark)


def test_sessions(spark):
    kind = "id string, project string, started_at long, ended_at long, summary string"
    old = spark.createDataFrame([("a", "p", 1, None, "kept"), ("b", "p", 2, 5, None)], kind)
    new = spark.createDataFrame([("a", "q", 9, 7, None), ("c", "q", 3, None, "x")], kind)
    found = {r["id"]: tuple(r)[1:] for r in store.coalescing_upsert(old, new).collect()}
    assert found == {"a": ("p", 1, 7, "kept"), "b": ("p", 2, 5, None), "c": ("q", 3, None, "x")}
    assert [r["id"] for r in store.recent_sessions(old, "p", 5).collect()] == ["a"]
    assert store.clear_summary(old, "a").filter("summary is not null").count() == 0


def test_sync_and_changes(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "id string, hash string")
    b = spark.createDataFrame([("y", "3"), ("z", None), ("w", "4")], "id string, hash string")
    assert {tuple(r) for r in store.changes(a, b, "id", "hash").collect()} == {("x", "deleted"), ("y", "changed"), ("w", "added")}
    left, right = store.two_way_sync(a, b)
    assert left.count() == right.count() == 4


def line(**entry):
    return json.dumps(entry)


def test_turns_from_log(spark):
    user = lambda text: {"type": "user", "message": {"content": text}, "timestamp": "2024-01-01T00:00:00Z"}
    lines = [
        line(**user("Fix the websocket reconnect storm")),
        line(type="assistant", message={"content": [{"type": "text", "text": "The reconnect loop was fixed in socket.ts. It retried 50 times."}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "/w/src/socket.ts"}}]}),
        '{"torn":',
        line(**user("<system-reminder>no prompt</system-reminder>")),
        line(type="user", isCompactSummary=True, message={"content": "a summary"}),
        line(type="assistant", message={"content": [{"type": "tool_use", "name": "Bash", "input": {"command": "npm test"}}]}),
        line(**user("thanks")),
        line(type="assistant", message={"content": "You're welcome."}),
    ]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, offset long, value string")
    found = capture.turns(capture.log_entries(rows)).orderBy("turn_no")
    turns = found.collect()
    assert [t["prompt"] for t in turns] == ["Fix the websocket reconnect storm", "thanks"]
    assert turns[0]["files"] == ["/w/src/socket.ts"] and turns[0]["commands"] == ["npm test"]
    kept = capture.observations_from_turns(found, F.lit("/w"), 0).collect()
    assert len(kept) == 1
    row = kept[0]
    assert row["kind"] == "bugfix" and row["tags"] == ["src"] and row["status"] == "open"
    assert row["title"] == "The reconnect loop was fixed in socket.ts." and "Asked: " in row["body"] and "Test run" in row["body"]
    again = capture.observations_from_turns(found, F.lit("/w"), 0).collect()
    assert again[0]["id"] == row["id"]


def test_summaries(spark):
    rows = spark.createDataFrame([("s", "1", "late", "context", 1), ("s", "2", "choice", "decision", 2), ("s", "3", "choice", "bugfix", 3), ("s", "4", "rule", "preference", 4), ("s", "5", "fix", "bugfix", 5)], "session_id string, id string, title string, kind string, created_at long")
    assert capture.session_summaries(rows).head()["summary"] == "choice | rule | fix"


def test_commits(spark):
    from lorekeep.sources.commits import FIELD, commits

    records = [FIELD.join(("abc123def0", "Ann", "2024-01-01T00:00:00+00:00", "Fix crash", "body", "\nsrc/a.ts\n")), FIELD.join(("b", "Ann", "2024-01-01T00:00:00+00:00", "Bump version", "", "\nx\n")), FIELD.join(("c", "Ann", "2024-01-01T00:00:00+00:00", "Empty", "", ""))]
    found = capture.commit_observations(commits(spark.createDataFrame([(r,) for r in records], "value string")), "/w").collect()
    assert [(r["kind"], r["title"], r["files"]) for r in found] == [("bugfix", "Fix crash", ["/w/src/a.ts"])]


def test_notes(spark):
    rows = spark.createDataFrame([("p", "uses postgres://u:p@h/d", "db", None, ["x"]), ("p", "now mysql", "db", None, None)], "project string, text string, key string, kind string, tags array<string>")
    found = capture.notes(rows, 5).collect()
    assert found[0]["id"] == found[1]["id"] and "u:p" not in found[0]["body"] and found[0]["tags"] == ["manual", "x"]


def test_graph_of_source(spark):
    source = "class Store {\n  open() {\n    connect(url);\n  }\n}\nfunction useAuth() {\n  load(token);\n  if (x) { print(y); }\n}\n"
    lines = graph.source_lines(spark.createDataFrame([("a.ts", source)], "file string, source string"))
    declared = graph.symbols(graph.declarations(lines), "p")
    assert {(r["name"], r["kind"], r["line"]) for r in declared.collect()} == {("Store", "class", 1), ("open", "function", 2), ("useAuth", "function", 6)}
    called = graph.calls(lines)
    assert {(r["name"], r["line"]) for r in called.collect()} == {("connect", 3), ("load", 7)}
    placed = graph.nearest_above(called.withColumn("relation", F.lit("calls")).withColumn("weak", F.lit(False)), declared)
    assert {(r["name"], r["from_name"]) for r in placed.collect()} == {("connect", "open"), ("load", "useAuth")}
    edges = graph.edges_of(placed, declared, "p")
    assert {(r["dst_name"], r["dst_id"], r["score"]) for r in edges.collect()} == {("connect", None, 1.0), ("load", None, 1.0)}


def test_resolution(spark):
    known = spark.createDataFrame([("1", "f", "a"), ("2", "f", "b"), ("3", "g", "b")], "id string, name string, file string")
    references = spark.createDataFrame([(1, "a", 1, "f", "calls", False), (2, "c", 1, "f", "calls", False), (3, "c", 1, "g", "calls", False), (4, "c", 1, "h", "calls", True), (5, "c", 1, "h", "calls", False)], "ref_id long, file string, line int, name string, relation string, weak boolean")
    found = {r["ref_id"]: (r["dst_id"], r["confidence"], r["score"]) for r in graph.resolve(references, known).collect()}
    assert found == {1: ("1", "EXTRACTED", 1.0), 2: ("1", "INFERRED", 0.85), 3: ("3", "INFERRED", 0.95), 5: (None, "EXTRACTED", 1.0)}


def test_suggestions_in_the_order_of_letters(spark):
    """Names that are as near and as long follow each other by letter, then accent, then case."""
    names = spark.createDataFrame([(n,) for n in ("nameZ", "naméa", "nameb", "nameB", "namea", "nameA", "naméB", "Namea")], "name string")
    found = [r["name"] for r in graph.suggest(names, "name", limit=8).collect()]
    assert found == ["namea", "nameA", "Namea", "nameb", "nameB", "nameZ", "naméa", "naméB"]


def test_suggestions(spark):
    names = spark.createDataFrame([(n,) for n in ("readTranscript", "writeCursor", "readCursor", "transcriptPath", "ab")], "name string")
    found = [r["name"] for r in graph.suggest(names, "readTranscripts").collect()]
    assert found[0] == "readTranscript" and "ab" not in found


def test_usages(spark):
    lines = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(("import x", "function useAuth() {", "  useAuthToken()", "}", "call(useAuth)", "end"))], "file string, line int, text string")
    found = {r["line"]: (r["is_match"], r["is_definition"]) for r in usages.find_usages(lines, "useAuth", context=1).collect()}
    assert found == {1: (False, False), 2: (True, True), 3: (False, False), 4: (False, False), 5: (True, False), 6: (False, False)}
    assert usages.find_usages(lines, "useAuth", limit=1).count() == 1


def test_reports(spark, observations):
    assert [r["project"] for r in report.project_summary(observations).collect()] == ["q", "p"]
    assert report.top_tags(observations, 1).head()["tag"] == "auth"
    budget = report.within_budget(observations, ["session_id"], [F.col("created_at")], F.lit(10), 21)
    assert budget.count() == 2
    assert report.open_work(observations, 1).head()["id"][0] == "4"
    lines = report.index_line(search.index_entries(search.keyword_search(observations, "websocket", 5)))
    assert lines.filter("line like '%decision 01-01 Websocket%'").count() == 1


def test_ages(value):
    now = 100 * DAY
    for back, text in ((0, "just now"), (60_000, "1 minute ago"), (7_200_000, "2 hours ago"), (DAY, "1 day ago")):
        assert value(lambda t: report.age_text(t, now), now - back, kind="long") == text


def test_vector_search_newest(spark):
    """A cap on candidates leaves out the nearest if it is old; without one all rows are searched."""
    rows = [(str(i), [1.0 - 0.1 * i, 0.1 * i], i) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, created_at long")
    assert [r["id"] for r in search.vector_search(df, [1.0, 0.0], 2, newest=3).collect()] == ["2", "3"]
    assert [r["id"] for r in search.vector_search(df, [1.0, 0.0], 2).collect()] == ["0", "1"]


def test_prompt_block_and_view(spark):
    kinds = "project string, id string, rank int, kind string, created_at long, title string, snippet string, body string, expand boolean"
    rows = [
        ("p", "a" * 40, 1, "note", 0, "first", None, "x" * 12, True),
        ("p", "b" * 40, 2, "note", 0, None, "", None, False),
        ("p", "c" * 40, 3, "note", 0, "t" * 60, None, None, False),  # beyond the budget
        ("p", "d" * 40, 4, "note", 0, "s", None, None, False),  # comes after it
        (None, "e" * 40, 1, "note", 0, "alone", "seen", None, False),
    ]
    entries = spark.createDataFrame(rows, kinds)
    found = {r["project"]: (r["block"], r["tokens"]) for r in report.prompt_block(entries, "project", budget=60, body_chars=10).collect()}
    short = lambda c: c * SHORT
    first = f"<recalled-memory>\n{short('a')} note 1970-01-01 first\n{'x' * 10}\n... [truncated]\n{short('b')} note 1970-01 \n</recalled-memory>"
    assert found["p"] == (first, int(len(first) / 4 + 0.5))
    assert found[None][0] == f"<recalled-memory>\n{short('e')} note 1970-01 alone\n    seen\n</recalled-memory>"
    assert report.prompt_block(entries.limit(0), "project").count() == 0

    assert [r["id"][0] for r in report.viewed(entries, "p", 3).collect()] == ["a", "b", "c"]
    assert report.viewed(entries, "p", None).count() == 4
    assert [r["id"][0] for r in report.view_page(report.viewed(entries, "p", 3), 2).collect()] == ["a", "b"]


def test_members_by_one_sort(spark):
    """Calls are merged by one sort; a null line, file or relation meets none."""
    rows = [
        ("a", "f", 1, "x.go", None, "calls", "low", 0.1), ("b", "f", 1, "go", "s2", "calls", "high", 0.9), ("c", "f", 1, "go", "s1", "calls", "mid", 0.5), ("d", "f", 2, "go", "s3", "calls", "high", 0.9),
        ("e", "f", None, "y.go", None, "calls", "low", 0.1), ("g", "f", None, "go", "s4", "calls", "high", 0.9), ("h", "f", 1, "z.go", "own", "calls", "low", 0.1), ("i", "f", 1, "go", "s5", "reads", "high", 0.9),
    ]
    edges = spark.createDataFrame(rows, "edge_id string, file string, line int, dst_name string, dst_id string, relation string, confidence string, score double")
    merged = graph.merge_member_calls(edges)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {r["edge_id"]: (r["dst_id"], r["confidence"]) for r in merged.collect()} == {"a": ("s2", "high"), "d": ("s3", "high"), "e": (None, "low"), "g": ("s4", "high"), "h": ("own", "low"), "i": ("s5", "high")}

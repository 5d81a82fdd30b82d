"""Reports over the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.commands import searched_symbols
from lorekeep.functions.ids import short_id
from lorekeep.functions.text import clip_body, echoes, truncate

STALL_MS = 48 * 3_600_000


def project_summary(observations: DataFrame) -> DataFrame:
    return observations.groupBy("project").agg(F.count("*").alias("observations"), F.max("created_at").alias("last_active")).orderBy(F.desc("last_active"), "project")


def totals(observations: DataFrame) -> DataFrame:
    embedded = F.count_if(F.size(F.coalesce("embedding", F.array())) > 0)
    return observations.agg(F.count("*").alias("total"), embedded.alias("embedded"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def by_kind(observations: DataFrame) -> DataFrame:
    return observations.groupBy("kind").agg(F.count("*").alias("n"))


def top_tags(observations: DataFrame, limit: int = 10) -> DataFrame:
    return observations.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def within_budget(rows: DataFrame, partition: list[str], order: list[Column], length: Column, budget: int) -> DataFrame:
    """The rows before the first one that would exceed the budget; each costs its length and a line break.

    As each costs one at least, tasks keep the first ``budget`` + 1 of a partition and shuffle no more."""
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("__n") <= budget + 1).drop("__n")
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = rows.withColumn("__spent", F.coalesce(F.sum(length + 1).over(before), F.lit(0)) + length)
    return spent.withColumn("__over", F.max((F.col("__spent") > budget).cast("int")).over(upto)).filter("__over = 0").drop("__spent", "__over")


def index_line(entries: DataFrame) -> DataFrame:
    """id and the line that shows an entry; a snippet that only repeats the title is left out."""
    day = F.date_format(F.timestamp_millis("created_at"), "MM-dd")
    head = F.concat_ws(" ", short_id(F.col("id")), "kind", day, "title")
    worth = F.col("snippet").isNotNull() & ~echoes(F.col("snippet"), F.col("title"))
    return entries.select("id", F.when(worth, F.concat(head, F.lit("\n    "), F.col("snippet"))).otherwise(head).alias("line"))


def token_estimate(text: Column) -> Column:
    """About how many tokens a text takes: a quarter of its characters."""
    return F.round(F.length(text) / 4).cast("long")


def full_entry(observations: DataFrame, chars: int = 2000) -> DataFrame:
    """id and the whole rendering of an observation: its figures, title, and body cut after ``chars``."""
    when = F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    who = F.when(F.col("author") != "", F.concat(F.lit("who: "), "author"))
    files = F.when(F.size("files") > 0, F.concat(F.lit("files: "), F.array_join("files", ", ")))
    head = [F.concat(F.lit(f"{name}: "), value) for name, value in (("id", short_id(F.col("id"))), ("kind", F.col("kind")), ("when", when))]
    text = [F.lit(""), F.coalesce("title", F.lit("")), F.lit(""), clip_body(F.coalesce("body", F.lit("")), chars)]
    return observations.select("id", F.concat_ws("\n", *head, who, files, *text).alias("full"))


def prompt_block(entries: DataFrame, key: str, budget: int = 700, body_chars: int = 900, tag: str = "recalled-memory") -> DataFrame:
    """Of each ``key`` the block that a prompt gets, and about how many tokens it takes.

    ``entries`` has key, id, rank, kind, created_at, title, snippet, body and expand. Those to expand come
    first, with their bodies; the others are lines, as many as the budget holds. A key's list is bounded
    by the budget and by what the caller expands; a key with neither gets no block."""
    at, plain = F.timestamp_millis("created_at"), F.coalesce("title", F.lit(""))
    head = lambda day: F.concat_ws(" ", short_id(F.col("id")), "kind", F.date_format(at, day), plain)
    bodies = entries.filter("expand").select(key, F.lit(0).alias("part"), "rank", "id", F.concat(head("yyyy-MM-dd"), F.lit("\n"), truncate(F.coalesce("body", F.lit("")), body_chars)).alias("shown"))
    line = F.concat(head("yyyy-MM"), F.when(F.col("snippet") != "", F.concat(F.lit("\n    "), "snippet")).otherwise(""))
    lines = entries.filter("not expand").select(key, F.lit(1).alias("part"), "rank", "id", line.alias("shown"))
    lines = within_budget(lines, [key], [F.col("rank"), F.col("id")], F.length("shown"), budget)
    listed = F.array_sort(F.collect_list(F.struct("part", "rank", "id", "shown")))
    text = F.array_join(F.transform(listed, lambda x: x["shown"]), "\n")
    blocks = bodies.unionByName(lines).groupBy(key).agg(F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>")).alias("block"))
    return blocks.withColumn("tokens", token_estimate(F.col("block")))


def viewed(observations: DataFrame, project: str, most: int | None = 500) -> DataFrame:
    """What the view of a project shows: its oldest rows, all of them if ``most`` is None."""
    rows = observations.filter(F.col("project") == project)
    return rows if most is None else rows.orderBy("created_at", "id").limit(most)


def view_page(rows: DataFrame, newest: int = 80) -> DataFrame:
    """The newest of the rows viewed."""
    return rows.orderBy(F.desc("created_at"), "id").limit(newest)


def rules(observations: DataFrame, limit: int = 8) -> DataFrame:
    """Preferences, notes first, then the newest."""
    return observations.filter(F.col("kind") == "preference").orderBy(F.desc(F.col("session_id") == "manual"), F.desc("created_at"), "id").limit(limit)


def open_work(observations: DataFrame, limit: int = 3) -> DataFrame:
    return observations.filter(F.col("status") == "open").orderBy(F.desc("created_at"), "id").limit(limit)


def age_text(then: Column, now: int) -> Column:
    """How long ago, in the largest whole unit."""
    seconds = F.floor(F.greatest(F.lit(0), F.lit(now) - then) / 1000)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    return F.when(minutes < 1, "just now").when(hours < 1, say(minutes, "minute")).when(days < 1, say(hours, "hour")).otherwise(say(days, "day"))


def activity(observations: DataFrame, worked: DataFrame, now: int) -> DataFrame:
    """project, last_worked, last_recorded, age, stalled: work that went on for two days without a record."""
    recorded = observations.groupBy("project").agg(F.max("created_at").alias("last_recorded"))
    rows = worked.groupBy("project").agg(F.max("worked_at").alias("last_worked")).join(recorded, "project", "left")
    stalled = F.col("last_worked") - F.coalesce("last_recorded", F.lit(0)) > STALL_MS
    return rows.select("project", "last_worked", "last_recorded", age_text(F.col("last_worked"), now).alias("age"), stalled.alias("stalled"))


def adoption(tool_uses: DataFrame, known: DataFrame) -> DataFrame:
    """One row of counts over tool uses (id, name, command): commands, greps, candidates, fires, memory calls.

    A candidate greps for a symbol; it would fire if one of its first two symbols is known (name)."""
    uses = tool_uses.dropDuplicates(["id"])
    bash = uses.filter((F.col("name") == "Bash") & F.col("command").isNotNull())
    greps = bash.filter(F.col("command").rlike(r"(?<![A-Za-z0-9_])(?:grep|rg)(?![A-Za-z0-9_])")).withColumn("symbols", searched_symbols("command"))
    hits = greps.select("id", F.explode(F.slice("symbols", 1, 2)).alias("name")).join(known.select("name").distinct(), "name", "left_semi").select("id").distinct()
    counts = [
        bash.agg(F.count("*").alias("commands")),
        greps.agg(F.count("*").alias("greps"), F.count_if(F.size("symbols") > 0).alias("candidates")),
        hits.agg(F.count("*").alias("fires")),
        uses.agg(F.count_if(F.col("name").startswith("mcp__memory__")).alias("memory_calls")),
    ]
    row = counts[0]
    for c in counts[1:]:
        row = row.crossJoin(c)  # one row each
    share = F.when(F.col("commands") > 0, F.col("greps") / F.col("commands")).otherwise(0.0)
    return row.withColumn("grep_share", share)

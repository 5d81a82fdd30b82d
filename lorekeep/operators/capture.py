"""From conversation logs and commits to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.functions.commands import classify_command
from lorekeep.functions.ids import NUL, content_id

MAX_BODY = 4000
EXCLUDED = ("node_modules/", "dist/", ".git/")
#: Order of kinds in a summary.
KIND_RANK = ("decision", "deadend", "preference", "bugfix", "pattern", "context")
NO_NEWS = r"(?i)^(merge|bump|release|v?[0-9]+\.[0-9]+\.[0-9]+)"


def log_entries(lines: DataFrame) -> DataFrame:
    """Entries of transcript lines (session_id, offset, value): role, text, files, commands, timestamp.

    A message's content is a string or an array of blocks. Lines that aren't JSON are dropped."""
    entry = lines.withColumn("v", F.try_parse_json("value")).filter("v is not null")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    blocks = F.coalesce(get("$.message.content", "array<variant>"), F.array())
    block = lambda b, path: F.try_variant_get(b, path, "string")
    texts = F.array_join(F.transform(F.filter(blocks, lambda b: block(b, "$.type") == "text"), lambda b: block(b, "$.text")), "\n")
    named = lambda *names: F.filter(blocks, lambda b: (block(b, "$.type") == "tool_use") & block(b, "$.name").isin(*names))
    present = lambda items: F.filter(items, lambda x: x.isNotNull())
    plain = F.when(F.schema_of_variant(F.variant_get("v", "$.message.content", "variant")) == "STRING", get("$.message.content", "string"))
    return entry.select(
        "session_id",
        "offset",
        get("$.type", "string").alias("role"),
        T.trim(F.coalesce(plain, texts)).alias("text"),
        present(F.transform(named("Write", "Edit", "MultiEdit"), lambda b: block(b, "$.input.file_path"))).alias("files"),
        present(F.transform(named("Bash"), lambda b: block(b, "$.input.command"))).alias("commands"),
        F.unix_millis(F.try_to_timestamp(get("$.timestamp", "string"))).alias("timestamp"),
        F.coalesce(get("$.isCompactSummary", "boolean"), F.lit(False)).alias("compacted"),
    )


def asks() -> Column:
    """Whether a log entry is a real prompt, which begins a turn."""
    real = (F.col("role") == "user") & (F.col("text") != "") & ~F.col("compacted") & ~T.is_synthetic(F.col("text"))
    return F.coalesce(real, F.lit(False))


def turns(entries: DataFrame) -> DataFrame:
    """session_id, turn_no, offset, timestamp, prompt, reasoning, files, commands.

    Each real prompt begins a turn; what the assistant says and does until the next one belongs to it."""
    order = Window.partitionBy("session_id").orderBy("offset")
    rows = entries.withColumn("asks", asks()).withColumn("turn_no", F.sum(F.col("asks").cast("int")).over(order))
    rows = rows.filter((F.col("turn_no") > 0) & (F.col("asks") | (F.col("role") == "assistant")))
    answers = F.sort_array(F.collect_list(F.when(~F.col("asks"), F.struct("offset", "text", "files", "commands"))))
    grouped = rows.groupBy("session_id", "turn_no").agg(
        F.min("offset").alias("offset"),
        F.max(F.when(F.col("asks"), F.col("timestamp"))).alias("timestamp"),
        F.max(F.when(F.col("asks"), F.col("text"))).alias("prompt"),
        answers.alias("answers"),
    )
    said = F.filter(F.col("answers.text"), lambda t: t != "")
    return grouped.select("session_id", "turn_no", "offset", "timestamp", "prompt", F.array_join(said, "\n").alias("reasoning"), F.flatten("answers.files").alias("files"), F.flatten("answers.commands").alias("commands"))


def substantive(prompt: Column, reasoning: Column, files: Column, commands: Column) -> Column:
    """Whether a turn changed files, ran a command worth keeping, or answered a real question."""
    kept_files = F.exists(files, lambda f: ~T.excluded(f, EXCLUDED))
    kept_commands = F.exists(commands, lambda c: classify_command(c).isNotNull())
    scored = T.scored_sentences(T.strip_markdown(T.redact(reasoning)))
    answered = (F.size(scored) >= 2) & F.exists(scored, lambda s: s["score"] > 0)
    return kept_files | kept_commands | (T.is_searchable(prompt) & answered)


def observations_from_turns(found: DataFrame, project: Column, now: int) -> DataFrame:
    """One observation for each substantive turn; a turn that is read again gets the same id."""
    return candidates(found, project, now).filter("substantive").drop("substantive")


def candidates(found: DataFrame, project: Column, now: int) -> DataFrame:
    """What each turn would become, and whether it is ``substantive``: a turn that was may no longer be once late entries split it."""
    stamp = F.coalesce("timestamp", F.lit(now))
    rows = found.withColumn("prompt", T.strip_private(F.col("prompt"))).withColumn("reasoning", T.strip_private(F.col("reasoning")))
    rows = rows.withColumn("substantive", substantive(*map(F.col, ("prompt", "reasoning", "files", "commands"))))
    rows = rows.withColumn("files", F.array_distinct(F.filter("files", lambda f: ~T.excluded(f, EXCLUDED))))
    rows = rows.withColumn("project", project).withColumn("created_at", stamp)
    rows = rows.withColumn("kind", T.classify_turn(F.col("prompt"), F.col("reasoning"), F.size("files")))
    labels = F.transform(F.filter(F.transform("commands", classify_command), lambda c: c.isNotNull()), lambda c: c["label"])
    paths = F.transform("files", lambda f: F.regexp_replace(T.short_path(f), "^/+", ""))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Asked: "), F.col("prompt")),
        F.when(F.col("reasoning") != "", F.col("reasoning")),
        F.when(F.size("files") > 0, F.concat(F.lit("\nFiles: "), F.array_join(paths, ", "))),
        F.when(F.size(labels) > 0, F.concat(F.lit("Ran: "), F.array_join(labels, "; "))),
    )
    return rows.select(
        content_id(F.col("session_id"), F.col("created_at"), F.col("prompt")).alias("id"),
        "session_id",
        "project",
        "kind",
        T.redact(T.title_of(F.col("prompt"), F.col("reasoning"), F.col("files"), F.col("kind"))).alias("title"),
        T.truncate(T.redact(body), MAX_BODY).alias("body"),  # redacted before it is cut
        "files",
        T.top_dirs(F.col("files"), F.col("project")).alias("tags"),
        "created_at",
        F.when(F.size("files") > 0, "open").otherwise("done").alias("status"),
        "substantive",
    )


def kind_rank(kind: Column) -> Column:
    """The place of a kind in a summary."""
    return F.array_position(F.array(*map(F.lit, KIND_RANK)), kind)


def session_summaries(observations: DataFrame, most: int = 3) -> DataFrame:
    """session_id, summary: up to ``most`` distinct titles, by kind and then by time."""
    titles = observations.groupBy("session_id", "title").agg(F.min(F.struct(kind_rank(F.col("kind")).alias("rank"), "created_at", "id")).alias("first"))
    order = Window.partitionBy("session_id").orderBy("first")
    best = titles.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("n", "title")))["title"], " | ")
    return best.groupBy("session_id").agg(joined.alias("summary"))


def extended_summary(previous: Column, titles: Column, most: int = 3) -> Column:
    """The titles of an earlier summary, then new ones, up to ``most``."""
    kept = F.filter(F.split(F.coalesce(previous, F.lit("")), r" \| "), lambda t: t != "")
    return F.array_join(F.when(F.size(kept) >= most, kept).otherwise(F.slice(F.array_distinct(F.concat(kept, titles)), 1, most)), " | ")


def commit_observations(commits: DataFrame, project: str) -> DataFrame:
    """Observations of commits (sha, author, date, subject, body, paths); merges, version bumps and empty ones go."""
    files = F.transform(F.filter(F.transform("paths", T.trim), lambda p: p != ""), lambda p: F.concat(F.lit(project.rstrip("/") + "/"), p))
    rows = commits.withColumn("files", files).withColumn("created_at", F.unix_millis(F.try_to_timestamp("date")))
    rows = rows.filter((T.trim(F.col("subject")) != "") & ~T.trim(F.col("subject")).rlike(NO_NEWS) & (F.size("files") > 0) & F.col("created_at").isNotNull())
    by = F.when(F.col("author") != "", F.concat(F.lit(" by "), F.col("author"))).otherwise("")
    paths = F.transform(F.slice("files", 1, 20), T.short_path)
    body = F.concat_ws("\n", F.concat(F.lit("Committed "), F.substring("sha", 1, 8), by), T.trim(F.col("subject")), F.when(T.trim(F.col("body")) != "", T.trim(F.col("body"))), F.concat(F.lit("Files: "), F.array_join(paths, ", ")))
    return rows.select(
        content_id(F.lit("git"), F.lit(0), F.col("sha")).alias("id"),
        F.lit("git").alias("session_id"),
        F.lit(project).alias("project"),
        T.classify_turn(F.col("subject"), F.col("body"), F.size("files")).alias("kind"),
        F.substring(T.redact(T.trim(F.col("subject"))), 1, 80).alias("title"),
        T.redact(body).alias("body"),
        "files",
        T.top_dirs(F.col("files"), F.lit(project)).alias("tags"),
        "created_at",
        F.lit("done").alias("status"),
    )


def notes(rows: DataFrame, now: int) -> DataFrame:
    """Observations of manual notes (project, text, key, kind, tags). A key makes a later note replace an earlier one."""
    keyed = content_id(F.lit("manual"), F.lit(0), F.concat_ws(NUL, "project", "key"))
    free = content_id(F.lit("manual"), F.lit(now), F.col("text"))
    body = T.redact(T.trim(F.col("text")))
    return rows.select(
        F.when(F.col("key").isNotNull(), keyed).otherwise(free).alias("id"),
        F.lit("manual").alias("session_id"),
        "project",
        F.coalesce("kind", F.lit("decision")).alias("kind"),
        T.headline(F.substring_index(body, "\n", 1)).alias("title"),
        body.alias("body"),
        F.array().cast("array<string>").alias("files"),
        F.array_distinct(F.concat(F.array(F.lit("manual")), F.coalesce("tags", F.array()))).alias("tags"),
        F.lit(now).cast("long").alias("created_at"),
        F.lit("done").alias("status"),
    )

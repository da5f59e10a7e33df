"""Preparing histories for evaluation: closed records, positions, occurrences, cut-offs, known identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import squeezed


def closed_world(json: Column, required: list[str], optional: list[str] | None = None) -> Column:
    """``struct<missing, unknown>`` of a JSON object's keys; both null where the text is no object."""
    keys = F.json_object_keys(json)
    need, known = F.array(*[F.lit(x) for x in required]), F.array(*[F.lit(x) for x in [*required, *(optional or [])]])
    return F.struct(F.array_sort(F.array_except(need, keys)).alias("missing"), F.array_sort(F.array_except(keys, known)).alias("unknown"))


def history_messages(histories: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of each sample's sessions with their 0-based position in the session, in order of arrival.

    Adds ``unique_text``: no other message of the session has the same text apart from white space.
    """
    sessions = histories.select("sample_id", F.explode("session_ids").alias("session_id")).distinct()
    place = Window.partitionBy("sample_id", "session_id")
    joined = messages.join(sessions, "session_id")
    text = F.md5(squeezed(F.coalesce("content", F.lit(""))))
    return joined.withColumn("position", F.row_number().over(place.orderBy("sequence", "id")) - 1).withColumn("unique_text", F.count(F.lit(1)).over(Window.partitionBy("sample_id", "session_id", text)) == 1)


def before_cutoff(turns: DataFrame, cutoffs: DataFrame, by: list[str], position: str = "position", end: str = "end_index") -> DataFrame:
    """Turns strictly before the exclusive end of their history."""
    return turns.join(cutoffs.select(*by, end), by).where(F.col(position) < F.col(end)).drop(end)


def session_parts(messages: DataFrame) -> DataFrame:
    """Adds ``part``: a new part starts at a session's first message and at each system message."""
    order = Window.partitionBy("user_id", "session_id").orderBy("sequence", "id")
    start = (F.row_number().over(order) == 1) | F.coalesce(F.lower(F.trim("role")) == "system", F.lit(False))
    return messages.withColumn("start__", start.cast("int")).withColumn("part", F.sum("start__").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("start__")


def occurrence_id(key: Column, occurrence: Column) -> Column:
    """The key itself at its first occurrence, later a digest of key and number."""
    return F.when(occurrence == 0, key).otherwise(F.concat(F.lit("occ_"), F.sha2(F.concat_ws("\u0000", key, occurrence.cast("string")), 256)))


def contaminated(candidates: DataFrame, used: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates that share a known value of any of the columns with a used record: one semi join per column."""
    found = None
    for c in columns:
        hit = candidates.where(F.col(c).isNotNull()).join(used.where(F.col(c).isNotNull()).select(c).distinct(), c, "left_semi").select(candidates.columns)
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def write_splits(records: DataFrame, path: str, dataset: str = "dataset", split: str = "split") -> None:
    """One folder per dataset and split; an existing target is an error."""
    records.write.mode("errorifexists").partitionBy(dataset, split).parquet(path)


def judgement(text: Column) -> Column:
    """The label of a strict JSON judgement ``{"label": "CORRECT" | "WRONG"}``; null for anything else."""
    keys = F.json_object_keys(text)
    label = F.get_json_object(text, "$.label")
    return F.when((F.size(keys) == 1) & label.isin("CORRECT", "WRONG"), label)


def options(text: Column) -> Column:
    """The four labelled options ``(a) ... (d) ...`` of a text as an array; null where they aren't all there in order."""
    pattern = r"(?s)^.*?\(a\)\s*(.+?)\s*\(b\)\s*(.+?)\s*\(c\)\s*(.+?)\s*\(d\)\s*(.+?)\s*$"
    parts = F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, 5)])
    return F.when(text.rlike(pattern), parts)


def told(content: Column, date: Column, speaker: Column) -> Column:
    """A message as a history holds it: a line with its date, then its speaker's name where there is one."""
    return F.concat(F.lit("[session_date: "), date, F.lit("]\n"), F.when(F.coalesce(F.length(F.trim(speaker)), F.lit(0)) > 0, F.concat(speaker, F.lit(": "))).otherwise(F.lit("")), content)


def without_system(role: Column, content: Column) -> Column:
    """``struct<role, content>``: a system message becomes a quoted note of the user, others stay."""
    system = F.coalesce(role == "system", F.lit(False))
    return F.struct(F.when(system, "user").otherwise(role).alias("role"), F.when(system, F.concat(F.lit("[historical system note]\n"), content)).otherwise(content).alias("content"))


def same_answer(a: Column, b: Column) -> Column:
    """Whether two answers agree apart from case and white space."""
    return squeezed(F.lower(a)) == squeezed(F.lower(b))


def migrated(labels: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Labels of repeated sessions moved to the one occurrence whose message at their place has the same content.

    ``labels``: ``label_id, session_id, position, content``; ``occurrences``: ``session_id, occurrence_id, position, content``.
    Result: ``label_id, matches, occurrence_id``; null where no occurrence matches or several do, as nothing is guessed.
    """
    key = ["session_id", "position", "digest__"]
    digest = F.md5("content")
    held = occurrences.select("session_id", "position", digest.alias("digest__"), "occurrence_id").groupBy(*key).agg(F.count(F.lit(1)).alias("n__"), F.min("occurrence_id").alias("o__"))
    joined = labels.withColumn("digest__", digest).join(held, key, "left")
    return joined.select("label_id", F.coalesce("n__", F.lit(0)).alias("matches"), F.when(F.col("n__") == 1, F.col("o__")).alias("occurrence_id"))

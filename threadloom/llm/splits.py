"""Splits that keep related records together (problem 2).

Method: a persisted component table takes batches of links. Each batch is contracted onto the components the
table already has, merged by min-hooking with pointer jumping, and written as the table's next version.
Existing components keep their split, a merge of components with different splits is quarantined, and new
components fill what the splits lack.

Scale: links are two-column rows, reduced to one row per identity and sample before the first shuffle. A hub
(one author of a third of all samples) is only ever the target of a map-side combined ``min``; every join has
at most one row per key on one side, so a hot key costs rows, never pairs. Each round contracts the graph, and
rounds grow with the logarithm of its size. New components are placed by one rule for all sizes: from the largest
class of sizes down, each class in digest order along the deficits, by running sums that sort no class as a whole.
The table lies in versions of a stored folder (``ComponentTable``); rounds are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import PLACEHOLDERS
from threadloom.operators.components import merge_roots
from threadloom.operators.ranks import running_by_digest
from threadloom.session import write_table
from threadloom.sources import snapshots


_BLANK = r"[\s\p{Z}\p{Cf}\p{Cc}]+"


def known(identity: Column) -> Column:
    """The id itself, exactly as it is, or null where it is null, blank or a placeholder."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(identity, f"^{_BLANK}", ""), f"{_BLANK}$", ""))
    return F.when(~bare.isin(*PLACEHOLDERS), identity)


def identity_links(records: DataFrame, key: str = "sample_id", identities: tuple[str, ...] = ("user_id", "conversation_id")) -> DataFrame:
    """Distinct links ``a`` (record node) to ``b`` (identity node), one per record and known identity.

    Ids of different columns never meet, as each node carries its column's place. Null record keys link nothing.
    """
    rows = records.where(F.col(key).isNotNull())
    parts = [rows.select(F.concat(F.lit("s:"), key).alias("a"), F.concat(F.lit(f"{i}:"), known(F.col(c))).alias("b")).where(F.col("b").isNotNull()) for i, c in enumerate(identities)]
    return reduce(DataFrame.unionByName, parts).distinct()


def empty_table(spark) -> DataFrame:
    """A component table with nothing in it: ``node, component, split, quarantined``."""
    return spark.createDataFrame([], "node string, component string, split string, quarantined boolean")


def update_components(table: DataFrame, records: DataFrame, key: str = "sample_id", identities: tuple[str, ...] = ("user_id", "conversation_id")) -> DataFrame:
    """The component table after a batch of ``records``, written as its next version.

    ``table`` and the result: ``node, component, split, quarantined``, one row per node (records ``s:`` + key
    and identities), with component the smallest node. A component keeps the split its members had; if they
    had several, split is null and quarantined true, and stays so in later batches. Components without any
    earlier split have a null split and are not quarantined until ``fill_splits`` gives them one.

    Defined cases: records with a null key are left out; records without known identity are components of
    their own; an empty batch returns the table as it is; repeated rows change nothing; extra columns are unread.
    """
    links = identity_links(records, key, identities)
    nodes = records.where(F.col(key).isNotNull()).select(F.concat(F.lit("s:"), key).alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    fresh = nodes.join(table.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(None).cast("string").alias("split"), F.lit(False).alias("quarantined"))
    members = write_table(table.select("node", "component", "split", "quarantined").unionByName(fresh), "components")
    at = members.select("node", "component")
    contracted = links.join(at.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(at.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").where("ca <> cb")
    roots = merge_roots(contracted.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")))
    if roots is None:
        return members
    merged = members.join(roots.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"), "split", "quarantined")
    # least and greatest split tell agreement without collecting a component
    verdict = merged.groupBy("component").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.max("quarantined").alias("before"))
    conflict = F.col("before") | F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    verdict = verdict.select("component", F.when(~conflict, F.col("low")).alias("split"), conflict.alias("quarantined"))
    return write_table(merged.select("node", "component").join(verdict, "component").select("node", "component", "split", "quarantined"), "components")


def fill_splits(table: DataFrame, proportions: dict[str, float]) -> DataFrame:
    """Gives every component without a split one that lacks records, and writes the next version.

    Components are taken by size class (powers of two), the largest first. Those of a class stand in digest order, each over
    as long a piece of a line as it has records; the line is divided among the splits as they lack records then, and a
    component goes where the middle of its piece lies. What a class really took is counted before the next, so what
    large components leave uneven is evened out by smaller ones. Quarantined components stay without split.
    """
    names = list(proportions)
    records = table.where(F.col("node").startswith("s:"))
    sizes = records.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.first("split", ignorenulls=True).alias("split"), F.max("quarantined").alias("quarantined"))
    sizes = write_table(sizes.withColumn("kind", F.floor(F.log2("size")).cast("int")), "sizes")
    held = {r["split"]: r["n"] for r in sizes.where("NOT quarantined").groupBy("split").agg(F.sum("size").alias("n")).collect()}
    total = sum(held.values())
    lack = {s: proportions[s] * total - held.get(s, 0) for s in names}
    free = running_by_digest(sizes.where("split IS NULL AND NOT quarantined"), F.sha2("component", 256), "size", "kind")
    free = write_table(free.withColumn("middle", F.col("before") + F.col("size") / 2), "free")
    kinds = free.groupBy("kind").agg(F.sum("size").alias("n")).orderBy(F.desc("kind")).collect()  # one row per power of two
    chosen = None
    for row in kinds:
        open_ = {s: max(v, 0.0) for s, v in lack.items()}
        weight = sum(open_.values())
        if not weight:
            open_, weight = dict(proportions), sum(proportions.values())
        choice, reached = None, 0.0
        for s in names:
            reached += open_[s] / weight * row["n"]
            if open_[s] > 0:
                choice = F.when(F.col("middle") < reached, F.lit(s)) if choice is None else choice.when(F.col("middle") < reached, F.lit(s))
        last = next(s for s in reversed(names) if open_[s] > 0)
        mine = free.where(F.col("kind") == row["kind"]).select("component", "size", choice.otherwise(F.lit(last)).alias("chosen"))
        for r in mine.groupBy("chosen").agg(F.sum("size").alias("n")).collect():
            lack[r["chosen"]] -= r["n"]
        chosen = mine if chosen is None else chosen.unionByName(mine)
    if chosen is None:
        return table
    return write_table(table.join(chosen.drop("size"), "component", "left").select("node", "component", F.coalesce("split", "chosen").alias("split"), "quarantined"), "components")


class ComponentTable:
    """The persisted component table at ``path``, a folder that all executors share: one version per batch."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """The table as it is now."""
        return snapshots.read(self.spark, self.path, "components") if snapshots.versions(self.spark, self.path) else empty_table(self.spark)

    def add(self, records: DataFrame, proportions: dict[str, float], name: str = "", key: str = "sample_id", identities: tuple[str, ...] = ("user_id", "conversation_id")) -> DataFrame:
        """Takes in a batch and commits the next version; a batch of a ``name`` that is there already changes nothing."""
        if not (name and any(m["name"] == name for m in snapshots.manifests(self.spark, self.path))):
            snapshots.commit(self.spark, self.path, {"components": assign_splits(records, proportions, self.read(), key, identities)}, name)
        return self.read()


def record_splits(table: DataFrame, key: str = "sample_id") -> DataFrame:
    """``key, component, split, quarantined`` of the records in a component table."""
    return table.where(F.col("node").startswith("s:")).select(F.substring("node", 3, 2**31 - 1).alias(key), "component", "split", "quarantined")


def assign_splits(records: DataFrame, proportions: dict[str, float], table: DataFrame | None = None, key: str = "sample_id", identities: tuple[str, ...] = ("user_id", "conversation_id")) -> DataFrame:
    """A component table after ``records``, in which every component that isn't quarantined has a split."""
    table = empty_table(records.sparkSession) if table is None else table
    return fill_splits(update_components(table, records, key, identities), proportions)


def split_conflicts(records: DataFrame, split: str = "original_split", key: str = "sample_id", identities: tuple[str, ...] = ("user_id", "conversation_id")) -> DataFrame:
    """Keys of records whose component lies in more than one of the splits they already have.

    The records enter the component table one by one with the split they came with; a batch of all links then
    merges them, and what the merge quarantines is the result. Null splits conflict with nothing. A record
    whose own rows name several splits is a conflict by itself.
    """
    nodes = records.where(F.col(key).isNotNull()).groupBy(F.concat(F.lit("s:"), key).alias("node")).agg(F.min(split).alias("low"), F.max(split).alias("high"))
    torn = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    before = nodes.select("node", F.col("node").alias("component"), F.when(~torn, F.col("low")).alias("split"), torn.alias("quarantined"))
    return record_splits(update_components(before, records, key, identities), key).where("quarantined").select(key)

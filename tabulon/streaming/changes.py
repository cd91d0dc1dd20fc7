"""Change batches on keyed tables: validated edits, recalculation of what they touch, and deltas of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RevisionConflict(RuntimeError):
    """A batch was made for another revision of the table."""


def apply_changes(table: DataFrame, changes: DataFrame, key: str, order: str = "change_id") -> DataFrame:
    """The table after a batch: changes have the table's columns, `op` (set or clear) and order; a key's last change wins."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("c")).select("c.*")
    kept = table.join(last.select(key), key, "left_anti")
    return kept.select(*table.columns).unionByName(last.where("op = 'set'").select(*table.columns))


def dirty_groups(table: DataFrame, changes: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Groups that a batch touches: those its rows were in and those they get into."""
    before = table.join(changes.select(key).distinct(), key, "left_semi").select(*group)
    return before.unionByName(changes.where("op = 'set'").select(*group)).distinct()


def recalculate(results: DataFrame, table: DataFrame, dirty: DataFrame, group: list[str], aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Grouped results after a batch: only dirty groups are aggregated again; the others are taken over."""
    fresh = aggregate(table.join(dirty, group, "left_semi"))
    return results.join(dirty, group, "left_anti").select(*results.columns).unionByName(fresh.select(*results.columns))


def delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose results changed, with `change`: added, removed or changed, and the new values."""
    values = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*values).alias("__old"))
    b = new.select(*key, F.struct(*values).alias("__new"))
    both = a.join(b, key, "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("changed")
    return both.select(*key, kind.alias("change"), "__new.*")


class Session:
    """A table with grouped results that batches bring up to date; every state is a written table, named by its revision."""

    def __init__(self, table: DataFrame, key: str, group: list[str], aggregate: Callable[[DataFrame], DataFrame], folder: str):
        self.key, self.group, self.aggregate, self.folder, self.revision = key, group, aggregate, folder, 0
        self.spark = table.sparkSession
        self._install(table, aggregate(table))

    def _install(self, table: DataFrame, results: DataFrame) -> None:
        for name, df in (("table", table), ("results", results)):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}-{self.revision}")
        self.table = self.spark.read.parquet(f"{self.folder}/table-{self.revision}")
        self.results = self.spark.read.parquet(f"{self.folder}/results-{self.revision}")

    def preview(self, changes: DataFrame) -> DataFrame:
        """The delta a batch would have; nothing is installed."""
        dirty = dirty_groups(self.table, changes, self.key, self.group)
        new = recalculate(self.results, apply_changes(self.table, changes, self.key), dirty, self.group, self.aggregate)
        return delta(self.results, new, self.group)

    def apply(self, changes: DataFrame, expected: int | None = None) -> DataFrame:
        """Install a batch made for a revision and give its delta; a batch for another revision is refused as a whole."""
        if expected is not None and expected != self.revision:
            raise RevisionConflict(f"revision {self.revision}, not {expected}")
        old = self.results
        dirty = dirty_groups(self.table, changes, self.key, self.group)
        table = apply_changes(self.table, changes, self.key)
        results = recalculate(old, table, dirty, self.group, self.aggregate)
        self.revision += 1
        self._install(table, results)
        return delta(old, self.results, self.group)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Apply a stream of changes, batch by batch."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.apply(batch)).option("checkpointLocation", checkpoint).start()

"""Past snapshots of what was published: what each brought and dropped, and a register filled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FIELDS = ["id", "name", "location", "start_local", "lat", "lng"]


def _versions(snapshots: DataFrame) -> DataFrame:
    """version, no, next_version. The window without a key is over the snapshots' names, not their rows."""
    order = W.orderBy("version")
    return snapshots.select("version").distinct().select("version", F.row_number().over(order).alias("no"), F.lead("version").over(order).alias("next_version"))


def _rows(snapshots: DataFrame, fields: list[str]) -> DataFrame:
    """One row a snapshot and slug: version, slug, row (the fields). Rows without slug are left out; of a slug that a snapshot repeats the least
    row counts."""
    return snapshots.filter("slug is not null and slug <> ''").groupBy("version", "slug").agg(F.min(F.struct(*fields)).alias("row"))


def snapshot_changes(snapshots: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """version, slug, change: added (never seen before), returned (was gone), changed (a field differs from the snapshot before) or retired (the
    snapshot before had it). A slug's snapshots are read once, in order; the first snapshot adds all it has."""
    c, w = F.col, W.partitionBy("slug").orderBy("no")
    rows = _rows(snapshots, fields or _FIELDS).join(_versions(snapshots), "version").withColumn("before", F.lag(F.struct("no", "row")).over(w)).withColumn("after", F.lead("no").over(w))
    came = F.when(c("before").isNull(), "added").when(c("before.no") < c("no") - 1, "returned").when(~c("before.row").eqNullSafe(c("row")), "changed")
    left = F.when(c("next_version").isNotNull() & (c("after").isNull() | (c("after") > c("no") + 1)), "retired")
    both = F.array(F.struct(c("version"), came.alias("change")), F.struct(c("next_version").alias("version"), left.alias("change")))
    return rows.select("slug", F.inline(both)).filter("change is not null").select("version", "slug", "change")


def backfill(register: DataFrame, snapshots: DataFrame) -> DataFrame:
    """slug, id, name, location, start_local, lat, lng, first_seen, last_seen, retired_at, returns: the register with the slugs of past snapshots
    that it lacks.

    Such a slug has the fields of the snapshot that first had it, first_seen and last_seen name the snapshots, retired_at the first one without it
    after the last (null: the newest has it), returns counts how often it came back. The register's rows (slug, fields, first_seen, last_seen as
    text) stay as they are, with retired_at and returns null.
    """
    c = F.col
    fresh = snapshots.join(register.select("slug").distinct(), "slug", "left_anti")
    rows = _rows(fresh, _FIELDS).join(_versions(snapshots), "version")
    gap = c("no") - F.lag("no").over(W.partitionBy("slug").orderBy("no")) > 1
    per = rows.withColumn("back", gap).groupBy("slug").agg(
        F.min_by("row", "no").alias("row"), F.min_by("version", "no").alias("first_seen"), F.max_by("version", "no").alias("last_seen"), F.max_by("next_version", "no").alias("retired_at"), F.count_if("back").alias("returns")
    )
    found = per.select("slug", *(c(f"row.{f}").alias(f) for f in _FIELDS), "first_seen", "last_seen", "retired_at", "returns")
    known = register.select("slug", *_FIELDS, "first_seen", "last_seen", F.lit(None).cast("string").alias("retired_at"), F.lit(None).cast("long").alias("returns"))
    return known.unionByName(found)

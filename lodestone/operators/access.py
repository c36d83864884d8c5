"""Access levels of folders: the longest folder above a path decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import numbered

LEVELS = ("readonly", "edit", "no_access")
DEFAULT = "edit"
#: Folders up to which the rule table is broadcast.
SMALL = 100_000


def ancestors(path: Column) -> Column:
    """All paths that ``path`` lies in, itself included, and the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.when(F.element_at(parts, 1) == "", "/").otherwise(F.element_at(parts, 1))).otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def _small(folders: DataFrame) -> DataFrame:
    return F.broadcast(folders) if folders.limit(SMALL + 1).count() <= SMALL else folders


def resolve(rows: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with ``access_level``: that of the longest folder that is the path or lies above it, else ``DEFAULT``.

    An equi-join over the path's ancestors instead of a prefix join, so wildcards in names mean nothing. Null paths have the
    default. A folder listed twice counts with its latest ``updated_at`` if there is one. Other columns stay as they are.
    """
    rule = folders.where("path is not null")
    if "updated_at" in folders.columns:
        latest = Window.partitionBy("path").orderBy(F.desc_nulls_last("updated_at"), F.desc("access_level"))
        rule = rule.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    rule = rule.select(F.when(F.col("path") == "/", "/").otherwise(F.regexp_replace("path", "/+$", "")).alias("_folder"), F.col("access_level").alias("_level"))
    paths = rows.select(F.col(path).alias("_path")).where("_path is not null").distinct()
    best = (
        paths.select("_path", F.explode(ancestors(F.col("_path"))).alias("_folder")).join(_small(rule), "_folder")
        .groupBy("_path").agg(F.max_by("_level", F.length("_folder")).alias("_best"))
    )
    return rows.join(best, rows[path] == best["_path"], "left").withColumn("access_level", F.coalesce("_best", F.lit(DEFAULT))).drop("_path", "_best")


def gate(rows: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be read, and those that may not."""
    known = resolve(rows, folders)
    return known.where(F.col("access_level") != "no_access"), known.where(F.col("access_level") == "no_access")


def locked(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Distinct ``path, access_level`` of the rows that may not be changed, as deleting and forced reading would."""
    return resolve(rows.select("path"), folders).where(F.col("access_level") != "edit").distinct()


def under(path: Column, folder: Column | str) -> Column:
    """Whether ``path`` is ``folder`` or lies in it, by whole names."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return (path == folder) | path.startswith(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/")))


def folder_counts(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """``folders`` with ``documents``, the number that lie in them at any depth."""
    own = documents.where("path is not null").select(F.explode(ancestors(F.col("path"))).alias("_folder")).groupBy("_folder").agg(F.count(F.lit(1)).alias("documents"))
    listed = folders.withColumn("_folder", F.when(F.col("path") == "/", "/").otherwise(F.regexp_replace("path", "/+$", "")))
    return listed.join(own, "_folder", "left").drop("_folder").withColumn("documents", F.coalesce("documents", F.lit(0)))


def set_levels(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """``folders`` after ``changes`` (``path, access_level, changed_at``): the latest change of a path sets level and
    ``updated_at``; a known folder keeps id and ``created_at``, a new one gets the next ids in order of path. Unknown levels
    are an error."""
    bad = changes.where(~F.col("access_level").isin(*LEVELS) | F.col("access_level").isNull()).limit(1).count()
    if bad:
        raise ValueError(f"access level must be one of {LEVELS}")
    latest = changes.groupBy("path").agg(F.max_by("access_level", "changed_at").alias("new_level"), F.max("changed_at").alias("changed_at"), F.min("changed_at").alias("first_at"))
    known = folders.join(latest, "path", "left").select("folder_id", "path", F.coalesce("new_level", "access_level").alias("access_level"), "created_at", F.coalesce("changed_at", "updated_at").alias("updated_at"))
    top = folders.agg(F.coalesce(F.max("folder_id"), F.lit(0))).first()[0]
    fresh = latest.join(folders, "path", "left_anti").select("path", F.col("new_level").alias("access_level"), F.col("first_at").alias("created_at"), F.col("changed_at").alias("updated_at"))
    return known.unionByName(numbered(fresh, ["path"], top, "folder_id").select(known.columns))


def get_folder(folders: DataFrame, folder_id: int) -> dict:
    """The row of a folder; an unknown id is an error."""
    row = folders.where(F.col("folder_id") == folder_id).first()
    if row is None:
        raise KeyError(f"no folder {folder_id}")
    return row.asDict()


def listed(folders: DataFrame) -> DataFrame:
    """All folders by path."""
    return folders.orderBy("path")


def remove_folder(folders: DataFrame, folder_id: int) -> DataFrame:
    get_folder(folders, folder_id)
    return folders.where(F.col("folder_id") != folder_id)


def purge(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """``rows`` without those that lie in a folder of ``folders``."""
    hit = rows.select(F.col("path").alias("_path"), F.explode(ancestors(F.col("path"))).alias("_folder"))
    gone = hit.join(_small(folders.select(F.regexp_replace("path", "/+$", "").alias("_folder")).distinct()), "_folder", "left_semi").select("_path").distinct()
    return rows.join(gone, rows["path"] == gone["_path"], "left_anti")

"""Knowledge bases moved between places: JSON lines with a manifest, and an import under new ids.

A dataset is folders (id, parent_id, path), pages (id, folder_id, slug, title, version) and revisions (id, page_id, slug,
version); a target has the same columns and kb_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators.graphs import settled

#: Between the fields of a row that is hashed, and in place of a null; neither stands in a name.
FIELD, NOTHING = "\u001f", "\u0000"


def row_digest(columns: list[str]) -> Column:
    """A number of 48 bits of a row's fields in the order of their names."""
    text = F.concat_ws(FIELD, *[F.coalesce(F.col(c).cast("string"), F.lit(NOTHING)) for c in sorted(columns)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")


def _told(rows: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_digest(rows.columns)), F.lit(0)).cast("string").alias("checksum")]


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, checksum of each table, whatever its order and files."""
    each = [rows.agg(*_told(rows)).select(F.lit(name).alias("table"), "rows", "checksum") for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, each)


def export_dataset(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the live rows of every table as packed JSON lines, one folder each, and their manifest; returns the manifest.

    Rows are counted and summed up while they are written, so each table is derived once.
    """
    live = {name: (rows.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in rows.columns else rows) for name, rows in tables.items()}
    told = []
    for name, rows in live.items():
        seen = Observation()
        rows.observe(seen, *_told(rows)).write.option("compression", "gzip").json(f"{path}/{name}")
        found = seen.get or {"rows": 0, "checksum": "0"}  # nothing is observed of a table that is known to be empty
        told.append((name, found["rows"], found["checksum"]))
    made = next(iter(live.values())).sparkSession.createDataFrame(told, "table string, rows long, checksum string")
    made.write.json(f"{path}/manifest")
    return made


def read_dataset(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of an export; refused where they are not what its manifest says."""
    tables = {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}
    told = spark.read.schema("table string, rows long, checksum string").json(f"{path}/manifest")
    wrong = manifest(tables).join(told, ["table", "rows", "checksum"], "left_anti").select("table").collect()
    if wrong:
        raise ValueError(f"tables differ from the manifest: {', '.join(sorted(r.table for r in wrong))}")
    return tables


def import_dataset(tables: dict[str, DataFrame], target: dict[str, DataFrame], kb: str, keep_ids: bool = False) -> dict[str, DataFrame]:
    """The target's tables after the import into the knowledge base ``kb``.

    Rows get new ids from the base and their old id, unless ``keep_ids`` is asked for and no folder or page of the target
    has one of them.  Parents, folders and pages that came along are pointed at by their new ids, others stay as they
    are.  Folders of the same path, pages of the same slug, and revisions of the same slug or page are replaced; of
    revisions of one page and version the first by id stays.
    """
    taken = [tables[n].select("id").join(target[n].select("id"), "id", "left_semi") for n in ("folders", "pages")]
    keep = keep_ids and taken[0].unionByName(taken[1]).isEmpty()
    new = (lambda c: F.col(c)) if keep else (lambda c: F.sha1(F.concat(F.lit(f"{kb}/"), F.col(c)).cast("binary")))

    def along(rows: DataFrame, column: str, among: DataFrame) -> DataFrame:
        """The rows with ``moved``, whether what their column names came along."""
        return rows.join(among.select(F.col("id").alias(column), F.lit(True).alias("moved")).distinct(), column, "left")

    def renamed(rows: DataFrame, column: str) -> DataFrame:
        return rows.withColumn(column, F.when(F.col("moved"), new(column)).otherwise(F.col(column))).withColumn("id", new("id")).drop("moved")

    def firsts(rows: DataFrame, order: Column) -> DataFrame:
        first = F.row_number().over(Window.partitionBy("page_id", "version").orderBy(order))
        return rows.withColumn("nth", first).where("nth = 1").drop("nth")

    def placed(name: str, rows: DataFrame, *keys: str) -> DataFrame:
        own, others = target[name].where(F.col("kb_id") == kb), target[name].where(~F.col("kb_id").eqNullSafe(kb))
        for key in keys:
            own = own.join(rows.select(key).distinct(), key, "left_anti")
        return others.unionByName(own).unionByName(rows.withColumn("kb_id", F.lit(kb)))

    folders = renamed(along(tables["folders"], "parent_id", tables["folders"]), "parent_id")
    pages = renamed(along(tables["pages"], "folder_id", tables["folders"]), "folder_id")
    # old ids are short: new ones, long and at random, are made once revisions have been shuffled by their page
    found = settled(firsts(along(tables["revisions"].repartition("page_id"), "page_id", tables["pages"]), new("id")), "first-revisions")
    revisions = renamed(found, "page_id")
    if not found.where("moved is null and page_id rlike '^[0-9a-f]{40}$'").isEmpty():
        revisions = firsts(revisions, F.col("id"))  # an old name may be the new one of another page
    return {"folders": placed("folders", folders, "path"), "pages": placed("pages", pages, "slug"), "revisions": placed("revisions", revisions, "slug", "page_id")}

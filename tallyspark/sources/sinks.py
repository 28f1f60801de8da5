"""Sinks: replace by workspace, CSV exports with exact and shown amounts, bundles, a report and the graph mirror."""

from __future__ import annotations

import html

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.money import formatted
from ..functions.texts import csv_cell
from ..operators import quality
from .shared import staged


def replace_workspaces(rows: DataFrame, path: str) -> None:
    """SNK2: write the rows; workspaces that occur are replaced as a whole, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ws").parquet(path)


#: Parts of an upserted table; a batch rewrites those that it has keys of.
PARTS = 64
COMMITS = "version long, batch long, part int, held long"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """Of the newest version, the version that holds each part's rows."""
    try:
        log = spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException:  # nothing was committed yet
        return spark.createDataFrame([], COMMITS)
    return log.join(log.agg(F.max("version").alias("version")), "version", "left_semi")


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """SNK1's table as of its newest version; None before the first one."""
    held = [(r["part"], r["held"]) for r in _commits(spark, path).collect()]  # a row a part
    return spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/held={v}/part={p}" for p, v in held)).drop("held", "part") if held else None


def upsert(incoming: DataFrame, path: str, keys: list[str], order: list[str], batch: int, parts: int = PARTS) -> bool:
    """SNK1 as a sink, for foreachBatch too: the newest row of each key. Only parts that the batch has keys of are read and written anew; a version exists once its commit is written,
    so readers see all of a batch or nothing, and a batch that was committed before changes nothing. Says whether it did. Batches come one after the other."""
    spark = incoming.sparkSession
    newest = _commits(spark, path).collect()
    if any(batch <= r["batch"] for r in newest[:1]):
        return False
    version = newest[0]["version"] + 1 if newest else 1
    held = {r["part"]: r["held"] for r in newest}
    rows = staged(incoming.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), "incoming")
    touched = [r["part"] for r in rows.select("part").distinct().collect()]  # as many as parts
    old = [f"{path}/data/held={held[p]}/part={p}" for p in touched if p in held]
    if old:
        rows = quality.upsert(spark.read.option("basePath", f"{path}/data").parquet(*old).drop("held"), rows, keys, order)
    else:
        rows = quality.upsert(rows.limit(0), rows, keys, order)
    rows.repartition("part").write.partitionBy("part").parquet(f"{path}/data/held={version}")
    log = [(version, batch, p, v) for p, v in sorted((held | {p: version for p in touched}).items())]
    if touched:
        spark.createDataFrame(log, COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return bool(touched)


def export(rows: DataFrame, money: list[str]) -> DataFrame:
    """SNK3: every money column twice, as shown and exact; text cells guarded against formulas."""
    out = []
    for name, kind in rows.dtypes:
        if name in money:
            out += [formatted(F.col(name), F.coalesce("currency", F.lit("INR")) if "currency" in rows.columns else F.lit("INR")).alias(f"{name}_display"), F.col(name).alias(f"{name}_exact")]
        elif kind == "string":
            out.append(csv_cell(F.col(name)).alias(name))
        else:
            out.append(F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map")) else F.col(name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def bundle(artifacts: dict[str, DataFrame], folder: str) -> DataFrame:
    """SNK4: all exports under a folder, and a manifest with row counts; an export that fails is listed, not left out."""
    manifest = []
    for name, rows in artifacts.items():
        try:
            seen = Observation()
            write_csv(rows.observe(seen, F.count(F.lit(1)).alias("rows")), f"{folder}/{name}")
            manifest.append((name, seen.get["rows"], None))
        except Exception as error:  # noqa: BLE001  any failure is to be listed
            manifest.append((name, None, str(error)[:500]))
    spark = next(iter(artifacts.values())).sparkSession
    out = spark.createDataFrame(manifest, "artifact string, rows long, error string")
    write_csv(out.coalesce(1), f"{folder}/manifest")
    return out


def report(position: DataFrame, waterfall: DataFrame) -> str:
    """SNK5: a self-contained page of the published position and the waterfall; both are a few rows a workspace."""
    cell = lambda x: html.escape(str(x))
    table = lambda df: "<table><tr>" + "".join(f"<th>{cell(c)}</th>" for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in df.collect()) + "</table>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Position</title></head><body><h1>Published position</h1>{table(position.orderBy('ws'))}<h2>Waterfall</h2>{table(waterfall.orderBy('ws', 'step'))}</body></html>"


def graph_mirror(recs: DataFrame, pairs: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK7: nodes (id, label, kind) and edges (src, dst, kind) of records, match links and clusters."""
    rec = lambda c: F.concat(F.lit("record:"), F.col(c).cast("string"))
    group = F.concat(F.lit("customer:"), F.col("cluster").cast("string"))
    nodes = recs.select(rec("id").alias("id"), F.col("name").alias("label"), F.lit("record").alias("kind")).unionByName(clusters.select(group.alias("id"), group.alias("label"), F.lit("customer").alias("kind")).distinct())
    edges = pairs.where("decision != 'REJECTED'").select(rec("l").alias("src"), rec("r").alias("dst"), F.lower("decision").alias("kind")).unionByName(clusters.select(rec("id").alias("src"), group.alias("dst"), F.lit("member").alias("kind")))
    return nodes, edges


def files(rows: DataFrame, folder: str) -> None:
    """One file a row (name, which may begin with folders, and text or bytes), written by the tasks to any file system that PyArrow opens; a file of the same name is replaced."""
    column = rows.columns[1]

    def write(part) -> None:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        made = {""}
        where.create_dir(path)
        for row in part:
            content = row[column]
            inside = row["name"].rpartition("/")[0]
            if inside not in made:
                where.create_dir(f"{path}/{inside}")
                made.add(inside)
            with where.open_output_stream(f"{path}/{row['name']}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))

    rows.foreachPartition(write)

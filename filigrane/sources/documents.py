"""Networks, junctions, profiles and scores as files, and back into tables.

Parquet partitioned by scene is the default form. Documents (JSON) are written in parts of a bounded number of records,
so that no scene is gathered into one task; reading unites the parts.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.operators.scan import running
from filigrane.session import shared_folder

FORMAT, VERSION, PART = "filigrane-network", 1, 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder inside the session's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def parts(df: DataFrame, key: str, order: str, size: int = PART) -> DataFrame:
    """Number the rows of every `key` in parts of `size`."""
    d = running(df.withColumn("_ck", F.expr(f"{order} div 4096")), [key], [order], "_ck", {"_n": ("sum", "1L")})
    return d.withColumn("part", F.expr(f"(_n - 1) div {size}")).drop("_ck", "_n")


def write_network_documents(nodes: DataFrame, edges: DataFrame, path: str, size: int = PART) -> None:
    """JSON documents with format, version, nodes and vessels; one line per scene and part."""
    n = parts(nodes, "scene_id", "nid", size).groupBy("scene_id", "part").agg(F.expr(
        "collect_list(struct(nid, array(x, y) as xy, depth, 'node' as kind, pressure, "
        "map('layer', cast(layer as string)) as info))").alias("nodes"))
    e = parts(edges, "scene_id", "vid", size).groupBy("scene_id", "part").agg(F.expr(
        "collect_list(struct(vid, u, v, transform(ctrl, p -> array(p.x, p.y)) as ctrl, r_ctrl, z_ctrl, r_ctrl as h_ctrl, "
        "cls, side, flow, cast(null as map<string, string>) as info))").alias("vessels"))
    d = n.join(e, ["scene_id", "part"], "full")
    d.selectExpr(f"'{FORMAT}' as format", f"{VERSION} as version", "map('scene_id', cast(scene_id as string)) as meta",
                 "nodes", "vessels").write.mode("overwrite").json(path)


def read_network_documents(spark: SparkSession, path: str, multiline: bool = False):
    """(nodes, vessels) of every document under path; documents of another version are refused."""
    d = spark.read.schema(T.NETWORK_DOC).option("multiLine", multiline).json(path)
    bad = f"raise_error(concat('unknown document version ', coalesce(cast(version as string), 'none')))"
    d = d.withColumn("scene_id", F.expr("cast(meta['scene_id'] as bigint)")).withColumn(
        "version", F.expr(f"case when version = {VERSION} then version else cast({bad} as int) end"))
    n = d.selectExpr("scene_id", "version", "explode(nodes) as n").selectExpr(
        "scene_id", "version", "n.nid", "n.xy[0] as x", "n.xy[1] as y", "n.depth", "n.kind", "n.pressure", "n.info")
    v = d.selectExpr("scene_id", "version", "explode(vessels) as e").selectExpr(
        "scene_id", "version", "e.vid", "e.u", "e.v", "transform(e.ctrl, p -> struct(p[0] as x, p[1] as y)) as ctrl",
        "e.r_ctrl", "e.z_ctrl", "e.h_ctrl", "e.cls", "e.side", "e.flow", "e.info")
    return n, v


JUNCTION_DOC = ("format STRING, version INT, image_id LONG, junctions ARRAY<STRUCT<jid:LONG, x:DOUBLE, y:DOUBLE, "
                "radius:DOUBLE, type:STRING, arms:ARRAY<STRUCT<ang:LONG, flow:STRING>>>>")


def write_junction_documents(junctions: DataFrame, arms: DataFrame, path: str, size: int = PART) -> None:
    """Junctions with their arms; an arm is one direction of a junction (at most 360)."""
    a = arms.groupBy("jid").agg(F.expr("collect_list(struct(ang, flow))").alias("arms"))
    j = parts(junctions, "image_id", "jid", size).join(a, "jid", "left")
    j.groupBy("image_id", "part").agg(F.expr(
        "collect_list(struct(jid, x, y, radius, cast(type as string) as type, arms))").alias("junctions")).selectExpr(
        f"'{FORMAT}' as format", f"{VERSION} as version", "image_id", "junctions").write.mode("overwrite").json(path)


def read_junction_documents(spark: SparkSession, path: str):
    """(junctions, arms)."""
    d = spark.read.schema(JUNCTION_DOC).json(path).selectExpr("image_id", "explode(junctions) as j")
    return (d.selectExpr("image_id", "j.jid", "j.x", "j.y", "j.radius", "j.type"),
            d.selectExpr("image_id", "j.jid as jid", "explode(j.arms) as a").selectExpr("image_id", "jid", "a.ang", "a.flow"))


RUN_DOC = "version INT, image_id LONG, runs ARRAY<STRUCT<vid:LONG, lo:LONG, hi:LONG>>"


def write_run_documents(runs: DataFrame, path: str, size: int = PART) -> None:
    d = parts(runs.withColumn("_key", F.expr("vid * 1000000 + lo")), "image_id", "_key", size)
    d.groupBy("image_id", "part").agg(F.expr("collect_list(struct(vid, lo, hi))").alias("runs")).selectExpr(
        f"{VERSION} as version", "image_id", "runs").write.mode("overwrite").json(path)


def read_run_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_DOC).json(path).selectExpr("image_id", "explode(runs) as r").select("image_id", "r.*")


def pack_profiles(samples: DataFrame, cols, block: int = 4096) -> DataFrame:
    """Samples as arrays per edge and block of positions, with the block's offset."""
    a = samples.withColumn("block", F.expr(f"i div {block}")).groupBy("image_id", "vid", "block").agg(
        F.expr(f"array_sort(collect_list(struct(i, {', '.join(cols)})))").alias("s"))
    return a.selectExpr("image_id", "vid", f"block * {block} as offset",
                        *[f"transform(s, e -> e.{c}) as {c}" for c in cols])


def unpack_profiles(packed: DataFrame, cols) -> DataFrame:
    d = packed.selectExpr("image_id", "vid", "offset", f"posexplode(arrays_zip({', '.join(cols)})) as (k, e)")
    return d.selectExpr("image_id", "vid", "offset + k as i", *[f"e.{c} as {c}" for c in cols])


def write_scenes(df: DataFrame, path: str, key: str) -> None:
    """One folder per scene or image."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def read_scenes(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All folders at once; the key comes from each row's file path."""
    return spark.read.option("recursiveFileLookup", True).parquet(path).selectExpr(
        "*", f"cast(regexp_extract(_metadata.file_path, '{key}=([0-9]+)', 1) as bigint) as {key}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def changed(listing: DataFrame, cache: DataFrame, stamp) -> DataFrame:
    """Listed images whose stamp is not in the cache yet."""
    return listing.join(cache.select(*stamp), list(stamp), "left_anti")


def overwrite_rules(df: DataFrame, path: str, rules: str) -> None:
    """Write a result under its own rules; other rules' results beside it stay."""
    df.withColumn("rules", F.lit(rules)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "rules").parquet(path)

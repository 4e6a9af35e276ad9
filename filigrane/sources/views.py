"""Engine tables derived from the given star-schema tables.

Integer arithmetic throughout, so that every engine gives the same rows. The number of images, scenes and edges
grows with the tables; no view holds a fixed number of groups.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.operators.scan import even_chunks, running
from filigrane.session import checkpointed

FRAME_W, FRAME_H = 160, 100
USERS_PER_IMAGE = 25
LAYER, STRIDE = 8, 72


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _steps(spark, sf) -> DataFrame:
    """Events in time order per user: position i and running position (x, y)."""
    e = table(spark, sf, "events").selectExpr(
        "event_id", "user_id as vid", "event_type", "value", "unix_micros(cast(ts as timestamp)) as us",
        "cast((37 * event_id) % 5 - 2 as bigint) as dx", "cast((53 * event_id) % 5 - 2 as bigint) as dy")
    e = even_chunks(e, "us")
    return running(e, ["vid"], ["us", "event_id"], "_chunk",
                   {"_n": ("sum", "1L"), "_sx": ("sum", "dx"), "_sy": ("sum", "dy")}).drop("_chunk")


def samples(spark, sf) -> DataFrame:
    """One row per px along an edge. Written once, as a stored table would be: the queries scan it several times."""
    inside = f"x between 0 and {FRAME_W - 1} and y between 0 and {FRAME_H - 1}"
    return checkpointed(
        _steps(spark, sf).selectExpr("*", f"(131 * vid) % {FRAME_W} + _sx as xi", f"(197 * vid) % {FRAME_H} + _sy as yi",
                        "case when dx = 0 and dy = 0 then 1.0D else sqrt(cast(dx * dx + dy * dy as double)) end as len")
            .selectExpr(f"vid div {USERS_PER_IMAGE} as image_id", "vid", "_n - 1 as i",
                        "cast(_n - 1 as double) as s_px", "1.0D as ds", "cast(xi as double) as x",
                        "cast(yi as double) as y",
                        "case when dx = 0 and dy = 0 then 1.0D else dx / len end as tx", "dy / len as ty",
                        "cast(1 + vid % 3 as double) as r", "cast(vid % 40 as double) as z",
                        "cast(1 + vid % 2 as double) as st", "value / 10 as cnr", "value / 100 as peak", "event_id")
            .selectExpr("*", f"({inside}) as in_frame", f"case when {inside} then peak end as contrast"))


def tracings(spark, sf) -> DataFrame:
    """An annotator's polylines: the edges, each shifted by its own small error."""
    return samples(spark, sf).selectExpr("image_id", "vid as line_id", "i as k", "x + vid % 5 as x",
                                         "y - vid % 3 as y")


def burst_frames(spark, sf) -> DataFrame:
    return (_steps(spark, sf)
            .selectExpr("vid as burst", "_n - 1 as idx", "us / 1e6 as time_s", "cast(_sx as double) as dx_px",
                        "cast(_sy as double) as dy_px", "event_type <> 'error' as registered", "value as gain",
                        "event_type"))


def vessels(spark, sf) -> DataFrame:
    """Edges of layered, acyclic networks: one per order, from a node of its customer to the next layer."""
    return (table(spark, sf, "orders")
            .selectExpr("o_custkey div 64 as scene_id", "o_orderkey as vid",
                        f"(o_custkey div 64) * {STRIDE} + o_custkey % 64 as u",
                        f"(o_custkey div 64) * {STRIDE} + ((o_custkey % 64) div {LAYER} + 1) * {LAYER} "
                        f"+ o_orderkey % {LAYER} as v",
                        "1 + o_totalprice / 100000 as r", "cast(1 + o_orderkey % 97 as double) as length",
                        "o_orderpriority as cls", "o_orderstatus as side", "o_totalprice as flow"))


def nodes(spark, sf) -> DataFrame:
    """End points of the edges, with a position, a depth and boundary pressures in the first and last layer."""
    v = vessels(spark, sf)
    n = v.selectExpr("scene_id", "u as nid").union(v.selectExpr("scene_id", "v as nid")).distinct()
    return n.selectExpr("scene_id", "nid", "cast((nid * 37) % 480 as double) as x",
                        "cast((nid * 53) % 300 as double) as y", "cast(nid % 40 as double) as depth",
                        f"nid % {STRIDE} div {LAYER} as layer",
                        f"case when nid % {STRIDE} div {LAYER} = 0 then 1.0D "
                        f"when nid % {STRIDE} div {LAYER} = {LAYER} then 0.0D end as pressure")


def with_ctrl(spark, sf) -> DataFrame:
    """Edges with four control points from node to node and profile controls."""
    v, n = vessels(spark, sf), nodes(spark, sf)
    nu = n.selectExpr("nid as u", "x as ux", "y as uy", "depth as uz")
    nv = n.selectExpr("nid as v", "x as vx", "y as vy", "depth as vz")
    return (v.join(nu, "u").join(nv, "v")
            .selectExpr("scene_id", "vid", "u", "v", "r", "cls", "side", "flow",
                        "array(named_struct('x', ux, 'y', uy), "
                        "named_struct('x', ux + (vx - ux) / 4 + vid % 7, 'y', uy + (vy - uy) / 4 - vid % 5), "
                        "named_struct('x', ux + (vx - ux) / 2 - vid % 3, 'y', uy + (vy - uy) / 2 + vid % 4), "
                        "named_struct('x', vx, 'y', vy)) as ctrl",
                        "array(r, r * 0.75D, r * 0.5D) as r_ctrl", "array(uz, (uz + vz) / 2, vz) as z_ctrl"))


def tree(spark, sf) -> DataFrame:
    """A forest: one node per customer, its parent in the layer above picked by its nation; roots have none."""
    return (table(spark, sf, "customer")
            .selectExpr("c_custkey div 64 as scene_id", "c_custkey as nid",
                        f"(c_custkey % 64) div {LAYER} as layer",
                        f"case when (c_custkey % 64) div {LAYER} > 0 then (c_custkey div 64) * 64 "
                        f"+ ((c_custkey % 64) div {LAYER} - 1) * {LAYER} + c_nationkey % {LAYER} end as parent",
                        "1 + abs(c_acctbal) / 1000 as leaf_r"))


def traced_junctions(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey div 10 as image_id", "s_suppkey as tj", "cast((s_suppkey * 37) % 160 as double) as x",
        "cast((s_suppkey * 53) % 100 as double) as y", "s_nationkey % 5 as type")


def obs_junctions(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey div 150 as image_id", "c_custkey as jid", "cast((c_custkey * 37) % 160 as double) as x",
        "cast((c_custkey * 53 + c_custkey div 150) % 100 as double) as y",
        "cast(3 + c_custkey % 20 as double) as radius", "c_nationkey % 5 as type")


def image_stats(spark, sf) -> DataFrame:
    """Long table of statistics per image: real and synthetic sets, sites, keys."""
    return (table(spark, sf, "lineitem")
            .groupBy("l_suppkey", "l_returnflag", "l_linestatus")
            .agg(F.expr("avg(l_extendedprice * (1 - l_discount))").alias("value"))
            .selectExpr("l_suppkey as image_id",
                        "case when l_suppkey % 5 = 0 then 'synthetic' else 'real' end as set",
                        "l_suppkey % 3 as site", "concat(l_returnflag, l_linestatus) as key", "value"))


def stat_keys(spark, sf) -> DataFrame:
    """The catalogue of keys with their tier, one key that no image has included."""
    return (table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()
            .selectExpr("concat(l_returnflag, l_linestatus) as key",
                        "case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as tier"))


def profiles(spark, sf) -> DataFrame:
    """Cross-section fits: image, path, contrast, width, edge width."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as image_id", "l_orderkey as pid", "l_orderkey % 200 as path", "l_extendedprice as contrast",
        "l_quantity as fwhm", "cast(1 + l_linenumber as double) as edge", "l_quantity / (1 + l_linenumber) as sharp",
        "cast(power(2, l_linenumber % 5) as bigint) as scale", "l_discount", "l_tax")


def claims(spark, sf) -> DataFrame:
    """Stretches [lo, hi] of an edge held by a junction, from ship dates and quantities per part."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey as vid", "l_orderkey as cid", "cast(l_linenumber as bigint) as ln",
        "cast(datediff(l_shipdate, date'1992-01-01') as bigint) as lo",
        "cast(datediff(l_shipdate, date'1992-01-01') + l_quantity as bigint) as hi")


def claim_edges(spark, sf) -> DataFrame:
    """Last position of every edge that has claims: an edge goes on for 25 positions beyond the last one."""
    return claims(spark, sf).groupBy("vid").agg(F.expr("max(hi) + 25").alias("last"))


def pixels(spark, sf) -> DataFrame:
    """8 x 8 images, one per vector."""
    return (table(spark, sf, "embeddings")
            .selectExpr("vec_id as image_id", "posexplode(embedding) as (pos, v)")
            .selectExpr("image_id", "cast(pos div 8 as bigint) as y", "cast(pos % 8 as bigint) as x",
                        "cast(v as double) as value"))


def raster(spark, sf) -> DataFrame:
    """Images of 50 x 50 pixels, one pixel per part, with an integer value 1..50 and a price."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey div 2500 as image_id", "(p_partkey % 2500) div 50 as y", "p_partkey % 50 as x",
        "cast(p_size as bigint) as value", "p_retailprice as price", "p_partkey as pid")


SKEL_MAX = 17


def skeleton(spark, sf) -> DataFrame:
    """Pixels of the raster at or below a fixed value."""
    return raster(spark, sf).where(f"value <= {SKEL_MAX}").select("image_id", "y", "x", "pid", "value")

"""Queries that write tables as files and read them back."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.operators import runs as R
from filigrane.operators import scorecard as S
from filigrane.plans.junctions import arms_at, lines, visibility  # noqa: F401
from filigrane.plans.registry import query
from filigrane.session import checkpointed
from filigrane.sources import documents as D
from filigrane.sources import views as V


@query("src01_read_network", "with_ctrl", """
  select scene_id, vid, u, v, cls, flow, ctrl[2].x as x1, r_ctrl[3] as r_end, len(ctrl) as n_ctrl from with_ctrl""")
def src01(spark, sf):
    path = D.scratch(spark, "network")
    D.write_network_documents(V.nodes(spark, sf), V.with_ctrl(spark, sf), path)
    _, v = D.read_network_documents(spark, path)
    return v.selectExpr("scene_id", "vid", "u", "v", "cls", "flow", "ctrl[1].x as x1", "r_ctrl[2] as r_end",
                        "cast(size(ctrl) as bigint) as n_ctrl")


@query("src01_read_nodes", "nodes", "select scene_id, nid, x, y, depth, pressure, cast(layer as varchar) as layer from nodes")
def src01_nodes(spark, sf):
    path = D.scratch(spark, "network")
    D.write_network_documents(V.nodes(spark, sf), V.with_ctrl(spark, sf), path)
    n, _ = D.read_network_documents(spark, path)
    return n.selectExpr("scene_id", "nid", "x", "y", "depth", "pressure", "info['layer'] as layer")


@query("src01_info_documents", "", """
  select user_id, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k, count(*) as n from events group by user_id""")
def src01_info(spark, sf):
    return V.table(spark, sf, "events").selectExpr("user_id", "from_json(props, 'k INT') as p").groupBy("user_id").agg(
        F.expr("cast(sum(p.k) as bigint)").alias("k"), F.count(F.lit(1)).alias("n"))


@query("src02_write_network", "nodes vessels", """
  select scene_id, count(*) as n, cast(sum(nid) as bigint) as chk from nodes group by scene_id""")
def src02(spark, sf):
    """The default form: Parquet by scene."""
    path = D.scratch(spark, "nodes")
    D.write_scenes(V.nodes(spark, sf), path, "scene_id")
    return D.read_scenes(spark, path, "scene_id").groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("nid").alias("chk"))


def _arm_rows(spark, sf):
    return lines(spark, sf).groupBy("jid", "ang").agg(F.min("flow").alias("flow"))


@query("src03_junction_documents", "obs_junctions lines", """
  select j.image_id, j.jid, j.x, j.type::varchar as type, count(a.ang) as n_arms, coalesce(cast(sum(a.ang) as bigint), 0) as chk
  from obs_junctions j left join (select distinct jid, ang from lines) a on a.jid = j.jid group by j.image_id, j.jid, j.x,
    j.type""")
def src03(spark, sf):
    path = D.scratch(spark, "junctions")
    j = V.obs_junctions(spark, sf)
    D.write_junction_documents(j, _arm_rows(spark, sf).join(j.select("jid"), "jid", "left_semi"), path)
    j, a = D.read_junction_documents(spark, path)
    g = a.groupBy("jid").agg(F.count(F.lit(1)).alias("n_arms"), F.sum("ang").alias("chk"))
    return j.join(g, "jid", "left").na.fill(0, ["n_arms", "chk"]).select("image_id", "jid", "x", "type", "n_arms", "chk")


@query("src04_observable_documents", "obs_runs", "select image_id, vid, lo, hi from obs_runs")
def src04(spark, sf):
    path = D.scratch(spark, "runs")
    D.write_run_documents(R.islands(R.observable(V.samples(spark, sf)), R.EDGE, "observable").selectExpr(
        "image_id", "vid", "run_start as lo", "run_end as hi"), path)
    return D.read_run_documents(spark, path)


@query("src05_profile_arrays", "samples", "select image_id, vid, i, x, y, cnr from samples")
def src05(spark, sf):
    path = D.scratch(spark, "profiles")
    D.pack_profiles(V.samples(spark, sf), ["x", "y", "cnr"], 32).write.parquet(path)
    return D.unpack_profiles(spark.read.parquet(path), ["x", "y", "cnr"]).withColumn("i", F.col("i").cast("long"))


@query("src06_edge_csv", "vis", """
  select vid, kind, value from (unpivot (select vid, visible_px as average, frame_px as frame from vis) on average, frame
    into name kind value value)""")
def src06(spark, sf):
    """One line per edge with a column per kind; read back long."""
    path = D.scratch(spark, "edges")
    wide = visibility(V.samples(spark, sf)).selectExpr("vid", "visible_px as average", "frame_px as frame")
    D.write_csv(wide, path)
    d = D.read_csv(spark, path, ", ".join(f"{c} {t}" for c, t in wide.dtypes))
    return d.unpivot(["vid"], ["average", "frame"], "kind", "value")


@query("src08_scene_metadata", "vessels nodes", """
  select v.scene_id, n_vessels, n_urgent, n_nodes, length from (select scene_id, count(*) as n_vessels, count(*) filter (
      cls = '1-URGENT') as n_urgent, sum(length) as length from vessels group by scene_id) v
  join (select scene_id, count(*) as n_nodes from nodes group by scene_id) n on n.scene_id = v.scene_id""")
def src08(spark, sf):
    v = V.vessels(spark, sf).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_vessels"), F.expr("count_if(cls = '1-URGENT')").alias("n_urgent"),
        F.sum("length").alias("length"))
    n = V.nodes(spark, sf).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return v.join(n, "scene_id")


@query("src09_scene_folders", "samples", """
  select image_id, count(*) as n, count(*) filter (in_frame) as n_in, max(i) as last from samples group by image_id""")
def src09(spark, sf):
    """A folder per image, all read at once, the image from the path."""
    path = D.scratch(spark, "samples")
    D.write_scenes(V.samples(spark, sf), path, "image_id")
    return D.read_scenes(spark, path, "image_id").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("count_if(in_frame)").alias("n_in"), F.max("i").alias("last"))


@query("src10_burst_files", "burst_frames", """
  select burst, count(*) filter (registered) as n_registered, count(*) as n, max(dx_px) filter (registered) as dx_max,
    count(*) % 7 as gain from burst_frames group by burst""")
def src10(spark, sf):
    """Frames from CSV, camera state from JSON, joined per burst."""
    frames, cam = D.scratch(spark, "frames"), D.scratch(spark, "camera")
    b = checkpointed(V.burst_frames(spark, sf))
    D.write_csv(b.selectExpr("burst", "idx", "dx_px", "case when registered then '1' else '0' end as registered"), frames)
    b.groupBy("burst").agg(F.expr("count(1) % 7").alias("gain")).write.json(cam)
    f = D.read_csv(spark, frames, "burst LONG, idx LONG, dx_px DOUBLE, registered STRING")
    c = spark.read.schema("burst LONG, gain LONG").json(cam)
    g = f.groupBy("burst").agg(F.expr("count_if(registered = '1')").alias("n_registered"), F.count(F.lit(1)).alias("n"),
                               F.expr("max(case when registered = '1' then dx_px end)").alias("dx_max"))
    return g.join(c, "burst", "left")


@query("src13_changed_images", "", """
  select doc_id, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)""")
def src13(spark, sf):
    """Images not measured yet: those whose stamp (name, size) is not in the cache. Documents stand in for image files,
    the labelled ones of quality 1 for the cache."""
    d = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    done = d.join(V.table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return D.changed(d, done, ["doc_id", "n_chars"])


@query("src17_scorecard_csv", "card_passed", """
  select key, cast(tier as bigint) as tier, n_real, n_syn, round(z, 6) as z, inside, passed from card_passed""")
def src17(spark, sf):
    path = D.scratch(spark, "scorecard")
    c = S.scorecard(V.image_stats(spark, sf), V.stat_keys(spark, sf)).selectExpr(
        "key", "cast(tier as bigint) as tier", "n_real", "n_syn", "round(z, 6) as z", "inside", "passed")
    D.write_csv(c, path)
    return D.read_csv(spark, path, ", ".join(f"{n} {t}" for n, t in c.dtypes))


@query("src18_recomputed_rules", "obs obs5", """
  select 'cnr=3.0' as rules, image_id, count(*) as n from obs where observable group by image_id union all
  select 'cnr=5.0', vid // 25, count(*) from obs5 group by vid // 25""")
def src18(spark, sf):
    """Truth made again at other thresholds from the same samples, each result under its own rules."""
    path = D.scratch(spark, "truth")
    s = V.samples(spark, sf)
    for thr in (3.0, 5.0):
        r = R.observable(s, cnr=thr).where("observable").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
        D.overwrite_rules(r, path, f"cnr={thr}")
    return spark.read.parquet(path).selectExpr("cast(rules as string) as rules", "image_id", "n")

"""The line model of an image: which edges remain visible lines, where they merge, and which junctions keep three lines.

Two tables depend on each other: the claims of junctions (a junction with two lines or less gives its claims up) and the
absorbed samples (short pieces that dangle from a junction). Both only move one way, so rounds over them end; an image whose
round changed nothing leaves the loop with its state, and later rounds read the others alone.

Images are independent of each other. One that fits a task is solved there with all its rounds (`line_image`); those that do not go
through rounds of joins.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.operators import events as V
from filigrane.operators import line_image as M
from filigrane.operators import network as N
from filigrane.operators import runs as R
from filigrane.operators.scan import CHUNK, at_positions, groups_by_break, running
from filigrane.session import checkpointed, shared_folder

E = list(R.EDGE)
#: Samples a line may miss, and pieces shorter than this (px) count as no line of their own.
BRIDGE = 6
ARM_MIN_PX = 0.5 * T.LAMBDA_PX
#: Samples and records of an image that is solved in one task.
SMALL = 1 << 17
#: Samples and records of the images that make up a task.
DEALT = 1 << 16


@dataclass
class State:
    """One round: samples (owner, merged into m_vid / m_i, line, fill, inner), runs (run, a, b, causes), edges (i0, i1, u, w, p0, p1,
    linked, stub) of every edge of the images, and the number of lines of every junction."""
    samples: DataFrame
    runs: DataFrame
    edges: DataFrame
    degree: DataFrame


class _Stored:
    """A table that rounds append to; reading it costs one scan however many rounds there were."""

    def __init__(self, spark):
        self.spark, self.path, self.schema = spark, f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", None

    def add(self, df: DataFrame) -> None:
        self.schema = df.schema
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def owners(claims: DataFrame, samples: DataFrame, centres: DataFrame, arm_min: float = ARM_MIN_PX) -> DataFrame:
    """Claims put in order: keys, lo, hi, jid. Gaps of less than arm_min inside one junction's claims on an edge are closed;
    in A-B-A without gaps the piece of A farther from A's centre goes to B. claims: disjoint (image_id, vid, jid, lo, hi)."""
    ds = samples.groupBy(*E).agg(F.first("ds").alias("ds"))
    d = checkpointed(R.join_owner_gaps(claims.selectExpr(*E, "lo", "hi", "jid as owner").join(ds, E), [*E, "ds"], f"{arm_min}D / ds"))
    at = samples.select(*E, "i", "x", "y")
    while True:
        n = R.neighbours(d, E)
        if n.where("prev_hi = lo - 1 and next_lo = hi + 1 and prev_owner = next_owner and prev_owner <> owner").isEmpty():
            return d.selectExpr(*E, "lo", "hi", "owner as jid")
        c = d.join(centres.selectExpr("image_id", "jid as owner", "x as cx", "y as cy"), ["image_id", "owner"])
        far = R.interval_samples(c, at, E).groupBy(*E, "lo").agg(F.expr("min(sqrt(power(x - cx, 2) + power(y - cy, 2)))").alias("far"))
        d = checkpointed(R.give_back(at_positions(d, far, [*E, "lo"]), E, "far", in_turn=True).select(*E, "lo", "hi", "owner"))


def merged_into(records: DataFrame, samples: DataFrame, gap: int = BRIDGE) -> DataFrame:
    """image_id, vid, i, m_vid, m_i: observable samples outside all claims that are one line with a stronger edge, and the
    sample of that line they belong to. records: image_id, a < b, i, j unresolved; samples: with obs, owner, prom.

    Of the two edges of a stretch the weaker one merges (`merge_stretches`). Its samples belong to the nearest sample of the
    stronger one among those within `gap` of what they are unresolved from; of several stronger edges the most prominent
    sample counts. Chains are followed to their end; samples that merge in a circle stay lines of their own."""
    free = samples.where("obs and owner is null")
    rec = at_positions(records, free.selectExpr("image_id", "vid as a", "i"), ["image_id", "a", "i"], "left_semi")
    rec = at_positions(rec, free.selectExpr("image_id", "vid as b", "i as j"), ["image_id", "b", "j"], "left_semi")
    rec = checkpointed(rec.select("image_id", "a", "b", "i", "j"))
    st = checkpointed(V.merge_stretches(rec, samples.selectExpr(*E, "i", "prom as contrast", "r", "st"), gap))
    sub = st.selectExpr("image_id", "a", "b", "weaker as vid", "stronger as dom", "case when weaker = a then i0 else j0 end as lo",
                        "case when weaker = a then i1 else j1 end as hi", "case when weaker = a then j0 else i0 end as d0",
                        "case when weaker = a then j1 else i1 end as d1")
    both = rec.selectExpr("image_id", "a as vid", "b as dom", "i", "j").unionByName(rec.selectExpr("image_id", "b as vid", "a as dom", "j as i", "i as j"))
    near = (both.withColumn("i", F.explode(F.expr(f"sequence(i - {gap}, i + {gap})"))).groupBy("image_id", "vid", "dom", "i")
            .agg(F.min("j").alias("j0"), F.max("j").alias("j1")))
    part = at_positions(sub.withColumn("i", F.explode(F.expr("sequence(lo, hi)"))), near, ["image_id", "vid", "dom", "i"])
    part = (at_positions(part, free.select(*E, "i", "x", "y"), [*E, "i"])
            .withColumn("j", F.explode(F.expr(f"sequence(greatest(j0, d0) - {gap}, least(j1, d1) + {gap})"))))
    to = samples.selectExpr("image_id", "vid as dom", "i as j", "x as dx", "y as dy", "prom as p")
    one = (at_positions(part, to, ["image_id", "dom", "j"]).groupBy(*E, "i", "dom", "lo")
           .agg(F.expr("min_by(struct(p, -dom as dom, j), struct(power(x - dx, 2) + power(y - dy, 2), j))").alias("m")))
    m = checkpointed(one.groupBy(*E, "i").agg(F.max("m").alias("m")).selectExpr(*E, "i", "-m.dom as m_vid", "m.j as m_i"))
    ends = at_positions(m.selectExpr("image_id", "m_vid as vid", "m_i as i"), m.select(*E, "i"), [*E, "i"], "left_semi")
    if ends.isEmpty():
        return m
    chain = N.follow(m.selectExpr("struct(image_id, vid, i) as id", "struct(image_id, m_vid as vid, m_i as i) as target"))
    return checkpointed(chain.selectExpr("id.image_id", "id.vid", "id.i", "target.vid as m_vid", "target.i as m_i"))


def line_state(samples: DataFrame, records: DataFrame, claims: DataFrame, centres: DataFrame, absorbed: DataFrame | None,
               bridge: int = BRIDGE, arm_min: float = ARM_MIN_PX) -> State:
    """Lines, runs and edges for the given claims and absorbed samples. samples: image_id, vid, i (dense), x, y, r, st, ds, prom,
    in_frame, obs; records: as merged_into; claims: image_id, vid, jid, lo, hi; centres: image_id, jid, x, y."""
    own = checkpointed(owners(claims, samples, centres, arm_min))
    held = own.withColumn("i", F.explode(F.expr("sequence(lo, hi)"))).selectExpr(*E, "i", "jid as owner")
    s = at_positions(samples, held, [*E, "i"], "left")
    s = s.withColumn("absorbed", F.lit(False)) if absorbed is None else at_positions(
        s, absorbed.select(*E, "i").withColumn("_a", F.lit(True)), [*E, "i"], "left").withColumn("absorbed", F.expr("_a is not null")).drop("_a")
    s = checkpointed(s)
    s = at_positions(s, merged_into(records, s, bridge), [*E, "i"], "left").withColumn("_base", F.expr("obs and m_vid is null and not absorbed"))
    s = checkpointed(s)
    line = V.extend_lines(s.selectExpr(*E, "i", "_base as line", "in_frame and (not absorbed or owner is not null) as in_frame"), own, bridge)
    s = at_positions(s, line.select(*E, "i", "line"), [*E, "i"]).withColumn("fill", F.expr("line and not _base")).drop("_base")
    s = s.withColumn("_ck", F.expr(f"i div {CHUNK}"))
    s = checkpointed(running(s, E, ["i"], "_ck", {"_ca": ("sum", "cast(absorbed as long)")}))
    upto, before = "struct(i, _ca, m_vid, m_i)", "struct(i, _ca - cast(absorbed as long) as _ca, m_vid, m_i)"
    s = checkpointed(running(s, E, ["i"], "_ck", {
        "_pm": ("last", f"case when m_vid is not null then {upto} end"), "_nm": ("last", f"case when m_vid is not null then {before} end", "back"),
        "_po": ("last", f"case when not in_frame then {upto} end"), "_no": ("last", f"case when not in_frame then {before} end", "back"),
        "_pa": ("max", "case when not absorbed then i end"), "_na": ("min", "case when not absorbed then i end", "back")},
        exclusive=("_pm", "_nm", "_po", "_no", "_pa", "_na")))
    # stretches of one owner within the lines, and the runs they make up
    d = s.where("line").selectExpr(*E, "i", "x", "y", "coalesce(owner, -1L) as jid", "_ck").join(
        centres.selectExpr("image_id", "jid", "x as cx", "y as cy"), ["image_id", "jid"], "left")
    d = groups_by_break(d, E, ["i"], "_ck", {"_p": ("max", "i"), "_o": ("last", "jid")}, "_p is null or i > _p + 1 or _o <> jid", name="_st")
    st = d.groupBy(*E, "_st").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.first("jid").alias("jid"), F.expr(
        "min_by(i, struct(coalesce(power(x - cx, 2) + power(y - cy, 2), 0.0D), i))").alias("att")).drop("_st")
    st = groups_by_break(checkpointed(st).withColumn("_ck", F.expr(f"lo div {CHUNK}")), E, ["lo"], "_ck", {"_p": ("last", "hi")},
                         "_p is null or lo > _p + 1", name="run").drop("_ck", "_p")
    st = checkpointed(st)
    runs = st.groupBy(*E, "run").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.count(F.lit(1)).alias("_n"),
                                     F.min_by("jid", "lo").alias("_j0"), F.max_by("jid", "lo").alias("_j1"))
    inside = checkpointed(runs.where("_n = 1 and _j0 >= 0").selectExpr(*E, "a", "b", "_j0 as jid"))
    last = s.groupBy(*E).agg(F.max("i").alias("last"), F.sum(F.col("absorbed").cast("long")).alias("_all"), F.first("ds").alias("ds"))
    ends = runs.where("not (_n = 1 and _j0 >= 0)").join(last, E)
    ends = at_positions(ends, s.selectExpr(*E, "i as a", "_pm", "_po", "_ca - cast(absorbed as long) as _c0"), [*E, "a"])
    ends = at_positions(ends, s.selectExpr(*E, "i as b", "_nm", "_no", "_ca as _c1"), [*E, "b"])
    # what ends a run: the first of a merged sample, one out of the frame and the edge's own end, with fewer than `bridge` samples
    # before it that are not absorbed
    ends = ends.withColumn("_s", F.expr("greatest(coalesce(_pm.i, -1L), coalesce(_po.i, -1L))")).withColumn(
        "_t", F.expr("least(coalesce(_nm.i, last + 1), coalesce(_no.i, last + 1))"))
    gone = "case when _{x} = _{m}.i then _{m}._ca when _{x} = _{o}.i then _{o}._ca {e} end"
    ends = ends.withColumn("_gs", F.expr("a - _s - 1 - (_c0 - " + gone.format(x="s", m="pm", o="po", e="else 0L") + ")")).withColumn(
        "_gt", F.expr("_t - b - 1 - (" + gone.format(x="t", m="nm", o="no", e="else _all") + " - _c1)"))
    runs = checkpointed(ends.selectExpr(
        *E, "run", "a", "b", "ds", "_n as pieces",
        f"case when _j0 >= 0 then 'junction' when _gs >= {bridge} then 'fade' when _s = _pm.i then 'merged' when _s = _po.i then 'border' else 'node' end as start_cause",
        f"case when _j1 >= 0 then 'junction' when _gt >= {bridge} then 'fade' when _t = _nm.i then 'merged' when _t = _no.i then 'border' else 'node' end as end_cause",
        f"case when _j0 < 0 and _gs < {bridge} and _s = _pm.i then struct(_pm.m_vid as vid, _pm.m_i as i) end as start_into",
        f"case when _j1 < 0 and _gt < {bridge} and _t = _nm.i then struct(_nm.m_vid as vid, _nm.m_i as i) end as end_into"))
    n = R.neighbours(st.withColumn("owner", F.expr("struct(jid, att, run)")), E)
    n = n.withColumn("_b", F.expr("coalesce(prev_hi = lo - 1, false)")).withColumn("_f", F.expr("coalesce(next_lo = hi + 1, false)"))
    edges = n.where("jid < 0").selectExpr(
        *E, "run", "lo as i0", "hi as i1", "case when _b then prev_owner.jid end as u", "case when _f then next_owner.jid end as w",
        "case when _b then prev_owner.att else lo end as p0", "case when _f then next_owner.att else hi end as p1", "false as linked"
    ).unionByName(n.where("jid >= 0 and _b and prev_owner.jid >= 0").selectExpr(
        *E, "run", "lo as i0", "lo - 1 as i1", "prev_owner.jid as u", "jid as w", "prev_owner.att as p0", "att as p1", "true as linked"))
    edges = at_positions(edges.join(runs.drop("a", "b"), [*E, "run"]), s.selectExpr(*E, "i as i0", "_pa"), [*E, "i0"])
    edges = (at_positions(edges, s.selectExpr(*E, "i as i1", "_na"), [*E, "i1"], "left")
             .join(last.select(*E, "last"), E)
             .withColumn("_len", F.expr("(i1 - i0 + 1 + (i0 - 1 - coalesce(_pa, -1L)) + (coalesce(_na, last + 1) - i1 - 1)) * ds"))
             .withColumn("stub", F.expr(
                 f"not linked and _len < {arm_min}D and (u is null or w is null) and not (u is null and start_cause = 'node') "
                 "and not (w is null and end_cause = 'node') and not (u is null and w is not null and start_cause = 'border') "
                 "and not (w is null and u is not null and end_cause = 'border')")))
    # a short piece between two stretches merged into lines of one junction is part of that junction
    own_at = s.where("owner is not null").selectExpr("image_id", "vid as _v", "i as _i", "owner as _o")
    loose = edges.where("pieces = 1 and not stub and start_cause = 'merged' and end_cause = 'merged'").where(f"(i1 - i0 + 1) * ds < {arm_min}D")
    loose = (loose.selectExpr(*E, "run", "i0", "i1", "start_into.vid as _v", "start_into.i as _i", "end_into")
             .join(own_at, ["image_id", "_v", "_i"]).drop("_v", "_i").withColumnRenamed("_o", "jid")
             .selectExpr(*E, "run", "i0", "i1", "jid", "end_into.vid as _v", "end_into.i as _i").join(own_at, ["image_id", "_v", "_i"])
             .where("_o = jid"))
    loose = checkpointed(loose.select(*E, "run", F.col("i0").alias("a"), F.col("i1").alias("b"), "jid"))
    edges = checkpointed(edges.join(loose.select(*E, "run"), [*E, "run"], "left_anti").select(
        *E, "run", "i0", "i1", "u", "w", "p0", "p1", "linked", "stub"))
    runs = runs.join(loose.select(*E, "run"), [*E, "run"], "left_anti")
    inner = inside.unionByName(loose.select(inside.columns)).withColumn("i", F.explode(F.expr("sequence(a, b)"))).selectExpr(*E, "i", "jid as inner")
    s = at_positions(s, inner, [*E, "i"], "left").withColumn("line", F.expr("line and inner is null")).withColumn("fill", F.expr("fill and line"))
    degree = (edges.where("not stub and u is not null").selectExpr("image_id", "u as jid").unionByName(
        edges.where("not stub and w is not null").selectExpr("image_id", "w as jid")).groupBy("image_id", "jid").agg(F.count(F.lit(1)).alias("n_lines")))
    return State(s.drop("_ck", "_ca", "_pm", "_nm", "_po", "_no", "_pa", "_na"), runs.drop("pieces", "ds"), edges, degree)


def _fitting(s: DataFrame, rec: DataFrame, small: int) -> DataFrame:
    """image_id, n: images of at most `small` samples and records, all of them whole: edges dense from 0, nothing null or NaN."""
    edges = s.groupBy(*E).agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.expr(
        "bool_and(coalesce(not isnan(x + y + r + st + ds + prom) and in_frame is not null and obs is not null, false))").alias("whole"))
    images = edges.groupBy("image_id").agg(F.sum("n").alias("n"), F.expr("bool_and(whole and lo = 0 and hi + 1 = n)").alias("whole"))
    more = rec.groupBy("image_id").agg(F.count(F.lit(1)).alias("m"))
    return images.join(more, "image_id", "left").selectExpr("image_id", "n + coalesce(m, 0L) as n", "whole").where(f"whole and n <= {small}").drop("whole")


def _in_memory(s: DataFrame, rec: DataFrame, cl: DataFrame, centres: DataFrame, images: DataFrame, bridge: int, arm_min: float) -> DataFrame:
    """Everything at rest of the images, which are solved one by one in tasks of about DEALT rows (M.KNOWN)."""
    def rows(df, kind, **cols):
        return df.join(images.select("image_id"), "image_id", "left_semi").select(
            F.lit(kind).alias("kind"), F.col("image_id").cast("long"),
            *[F.expr(cols.get(c, "null")).cast(t).alias(c) for c, t in (f.strip().split() for f in M.GIVEN.split(",")[2:])])
    given = rows(s, M.SAMPLE, l0="vid", l1="i", d0="x", d1="y", d2="r", d3="st", d4="ds", d5="prom", b0="in_frame", b1="obs").unionByName(
        rows(rec, M.RECORD, l0="a", l1="b", l2="i", l3="j")).unionByName(
        rows(cl.join(centres.selectExpr("image_id", "jid", "x as cx", "y as cy"), ["image_id", "jid"], "left"), M.CLAIM,
             l0="vid", l1="jid", l2="lo", l3="hi", d0="cx", d1="cy"))
    n, k = images.agg(F.sum("n"), F.count(F.lit(1))).first()
    tasks = max(1, -(-n // DEALT), min(k, 2 * s.sparkSession.sparkContext.defaultParallelism))
    return checkpointed(given.repartition(tasks, "image_id").groupBy("image_id").applyInArrow(M.settle(bridge, arm_min), M.KNOWN))


def line_fixpoint(samples: DataFrame, records: DataFrame, claims: DataFrame, centres: DataFrame, bridge: int = BRIDGE,
                  arm_min: float = ARM_MIN_PX, small: int = SMALL) -> tuple[State, DataFrame]:
    """The state in which every junction left has three lines or more and no stub is left, and those junctions (image_id, jid).
    Inputs as line_state. Images of at most `small` samples and records are solved in a task each, the others in rounds.

    A round takes the images that are still open. Junctions with two lines or less give their claims up, so that lines pass
    through; stubs are absorbed. Claims only go and absorbed samples only come, so an image is settled after finitely many
    rounds. An image without claims is settled in its first round without stubs. Empty tables give empty results."""
    spark = samples.sparkSession
    s = checkpointed(samples.select(*E, "i", "x", "y", "r", "st", "ds", "prom", "in_frame", "obs"))
    rec, cl, ab = checkpointed(records.select("image_id", "a", "b", "i", "j").distinct()), checkpointed(claims.select(*E, "jid", "lo", "hi")), None
    out = {k: _Stored(spark) for k in ("samples", "runs", "edges", "degree", "active")}
    images = checkpointed(_fitting(s, rec, small))
    if not images.isEmpty():
        known = _in_memory(s, rec, cl, centres, images, bridge, arm_min)
        for kind, name in enumerate(M.KINDS):
            out[name].add(known.where(f"kind = {kind}").selectExpr(*M.KINDS[name]))
        s, rec, cl = (x.join(images, "image_id", "left_anti") for x in (s, rec, cl))
        if s.isEmpty():
            return State(*(out[k].read() for k in ("samples", "runs", "edges", "degree"))), out["active"].read()
        s, rec, cl = checkpointed(s), checkpointed(rec), checkpointed(cl)
    while True:
        st = line_state(s, rec, cl, centres, ab, bridge, arm_min)
        st = State(checkpointed(st.samples), checkpointed(st.runs), checkpointed(st.edges), checkpointed(st.degree))
        active = cl.select("image_id", "jid").distinct()
        lost = checkpointed(active.join(st.degree.where("n_lines > 2"), ["image_id", "jid"], "left_anti"))
        stubs = st.edges.where("stub").withColumn("i", F.explode(F.expr("sequence(i0, i1)"))).select(*E, "i")
        new = checkpointed(stubs if ab is None else at_positions(stubs, ab, [*E, "i"], "left_anti"))
        open_ = checkpointed(lost.select("image_id").unionByName(new.select("image_id")).distinct())
        for name, df in (("samples", st.samples), ("runs", st.runs), ("edges", st.edges), ("degree", st.degree), ("active", active)):
            out[name].add(df.join(open_, "image_id", "left_anti"))
        if open_.isEmpty():
            break
        s, rec = (checkpointed(x.join(open_, "image_id", "left_semi")) for x in (s, rec))
        cl = checkpointed(cl.join(open_, "image_id", "left_semi").join(lost, ["image_id", "jid"], "left_anti"))
        ab = checkpointed(new if ab is None else new.unionByName(ab.join(open_, "image_id", "left_semi")))
    return State(*(out[k].read() for k in ("samples", "runs", "edges", "degree"))), out["active"].read()

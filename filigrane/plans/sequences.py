"""Queries over samples and intervals along edges: masks, runs, claims, arms."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.operators import runs as R
from filigrane.operators.scan import CHUNK, groups_by_break
from filigrane.plans import oracle
from filigrane.plans.registry import ORACLES, query
from filigrane.sources import views as V

W = "partition by vid order by i"


def _mask_sql(src, thr, gap, min_px, inside, out):
    ins = " and in_frame" if inside else ""
    return f"""
    select * exclude (_raw, _ok, _g), _ok and (max(case when _ok then i end) over (partition by vid, _g)
        - min(case when _ok then i end) over (partition by vid, _g)) * ds >= {min_px} as {out} from (
      select *, coalesce(max(case when not _ok then i end) over ({W} rows unbounded preceding), -1) as _g from (
        select * , (_raw or coalesce(min(case when _raw then i end) over ({W} rows between current row and
            unbounded following) - max(case when _raw then i end) over ({W} rows unbounded preceding) <= {gap}, false))
            {ins} as _ok
        from (select *, cnr >= {thr}{ins} as _raw from {src})))"""


oracle.define("obs", ("samples",), _mask_sql("samples", 3.0, 6, 11.9, True, "observable"))
oracle.define("perm", ("obs",), _mask_sql("obs", 1.5, 12, 5.95, False, "perm"))
oracle.define("flags", ("perm",), "select *, perm and in_frame and not observable as dont_care from perm")


@query("run01_bridge", "samples", f"""
  select image_id, vid, i, cnr >= 3 or coalesce(min(case when cnr >= 3 then i end) over ({W} rows between current row
      and unbounded following) - max(case when cnr >= 3 then i end) over ({W} rows unbounded preceding) <= 6, false)
    as bridged from samples""")
def run01(spark, sf):
    return R.bridge(V.samples(spark, sf), "cnr >= 3", 6).select("image_id", "vid", "i", "bridged")


@query("run02_segments", "samples", f"""
  select image_id, vid, min(i) as run_start, max(i) as run_end, count(*) as n from (
    select *, i - row_number() over (partition by vid order by i) as g from samples where cnr >= 3)
  group by image_id, vid, g""")
def run02(spark, sf):
    return R.islands(V.samples(spark, sf).withColumn("ok", F.expr("cnr >= 3")), R.EDGE, "ok")


@query("run03_observable_mask", "obs", "select image_id, vid, i, observable from obs")
def run03(spark, sf):
    return R.observable(V.samples(spark, sf)).select("image_id", "vid", "i", "observable")


@query("prj08_dont_care", "flags", "select image_id, vid, i, observable, dont_care from flags")
def prj08(spark, sf):
    return R.dont_care(V.samples(spark, sf)).select("image_id", "vid", "i", "observable", "dont_care")


@query("run07_longest_run", "samples", f"""
  select vid, coalesce(max(l) filter (ok), 0) as longest from (
    select vid, ok, g, cast(sum(ds) as double) as l from (
      select *, cnr >= 1.5 as ok, i - row_number() over (partition by vid, cnr >= 1.5 order by i) as g from samples)
    group by vid, ok, g) group by vid""")
def run07(spark, sf):
    d = V.samples(spark, sf).withColumn("ok", F.expr("cnr >= 1.5"))
    return R.longest(d, "ok", "ds", keys=("vid",)).withColumn("longest", F.col("longest").cast("double"))


@query("run05_chain_from_end", "claims", """
  select vid, greatest(0, coalesce(max(case when brk = 0 then hi end), 0)) as reach from (
    select *, sum(case when lo > greatest(coalesce(r, 0), 0) + 100 then 1 else 0 end)
        over (partition by vid order by lo, hi rows unbounded preceding) as brk
    from (select *, max(hi) over (partition by vid order by lo, hi rows between unbounded preceding and 1 preceding) r
          from claims)) group by vid""")
def run05(spark, sf):
    return R.chain_from_start(V.claims(spark, sf), ["vid"], 100)


MERGED_SQL = """
  select vid, min(lo) as lo, max(hi) as hi from (
    select *, sum(case when r is null or lo > r + {m} then 1 else 0 end)
        over (partition by vid order by lo, hi rows unbounded preceding) as g
    from (select *, max(hi) over (partition by vid order by lo, hi rows between unbounded preceding and 1 preceding) r
          from claims)) group by vid, g"""


# equal intervals count once: either of two could come first in each of the two windows, and a group then began at its second row
@query("run08_merge_intervals", "claims", ", once as (select distinct vid, lo, hi from claims)" + MERGED_SQL.format(
    m="2 * (3 + 2 * (vid % 2))").replace("from claims", "from once"))
def run08(spark, sf):
    return R.merge_intervals(V.claims(spark, sf), ["vid"], "2 * (3 + 2 * (vid % 2))")


@query("run06_extent_around", "claims", ", m as (" + MERGED_SQL.format(m="20") + """)
  select m.vid, anchor, min(lo) as lo, arg_min(hi, lo) as hi
  from m join (select p_partkey as vid, cast(p_size * 50 as bigint) as anchor from part) a on a.vid = m.vid
  where lo - 20 <= anchor and anchor <= hi + 20 group by m.vid, anchor""")
def run06(spark, sf):
    at = V.table(spark, sf, "part").selectExpr("p_partkey as vid", "cast(p_size * 50 as bigint) as anchor")
    return R.chain_around(V.claims(spark, sf), ["vid"], at, 20)


oracle.define("cores", ("samples",), """
  select s.image_id, s.vid, event_id as jid, i as anchor, greatest(i - 6, 0) as lo, least(i + 6, n - 1) as hi,
    x + event_id % 5 - 2 as cx, y + event_id % 3 - 1 as cy, cast(3 + event_id % 4 as double) as radius, n
  from samples s join (select vid, count(*) as n from samples group by vid) z on z.vid = s.vid where cnr >= 12""")


def _cores(s):
    n = s.groupBy("vid").agg((F.max("i") + 1).alias("n"))
    return s.where("cnr >= 12").join(n, "vid").selectExpr(
        "image_id", "vid", "event_id as jid", "i as anchor", "greatest(i - 6, 0) as lo", "least(i + 6, n - 1) as hi",
        "x + event_id % 5 - 2 as cx", "y + event_id % 3 - 1 as cy", "cast(3 + event_id % 4 as double) as radius", "n")


@query("run09_clip_to_radius", "cores", """
  select c.image_id, c.vid, jid, c.lo, c.hi,
    coalesce(min(case when d <= radius then i end), arg_min(i, {'d': d, 'i': i})) as lo2,
    coalesce(max(case when d <= radius then i end), arg_min(i, {'d': d, 'i': i})) as hi2
  from (select c.*, s.i, sqrt(power(s.x - cx, 2) + power(s.y - cy, 2)) as d
        from cores c join samples s on s.vid = c.vid and s.i between c.lo and c.hi) c
  group by c.image_id, c.vid, jid, c.lo, c.hi""")
def run09(spark, sf):
    s = V.samples(spark, sf)
    return R.clip_intervals(_cores(s), s.select("image_id", "vid", "i", "x", "y"))


oracle.define("owned", ("claims",), """
  select vid, i, cid, ln from (
    select vid, cid, ln, i, row_number() over (partition by vid, i
        order by abs(i - (lo + hi) // 2), lo, hi, cid, ln) as k
    from (select *, unnest(generate_series(lo, hi)) as i from claims)) where k = 1""")
oracle.define("owner_runs", ("owned",), """
  select vid, min(i) as lo, max(i) as hi, cid, ln from (
    select *, sum(case when p is null or i > p + 1 or pc <> cid or pl <> ln then 1 else 0 end)
        over (partition by vid order by i) as g
    from (select *, lag(i) over (partition by vid order by i) p, lag(cid) over (partition by vid order by i) pc,
        lag(ln) over (partition by vid order by i) pl from owned)) group by vid, g, cid, ln""")
oracle.define("limits", ("owner_runs", "claims"), """
  select vid, lo, hi, cid, ln, last,
    case when ph is null then 0 when ph = lo - 1 then lo else (ph + lo + 1) // 2 end as in_lim,
    case when ph = lo - 1 and pc <> cid then pc end as in_link,
    case when nl is null then last when nl = hi + 1 then hi else (hi + nl) // 2 end as out_lim,
    case when nl = hi + 1 and nc <> cid then nc end as out_link
  from (select *, lag(hi) over w ph, lag(cid) over w pc, lead(lo) over w nl, lead(cid) over w nc from owner_runs
        join (select vid, max(hi) + 25 as last from claims group by vid) using (vid) window w as (partition by vid order by lo))""")


def _owner_runs(spark, sf):
    c = V.claims(spark, sf)
    r = R.share_runs(c, ["vid"], ["cid", "ln"], "(lo + hi) div 2", ["lo", "hi", "cid", "ln"])
    return r.join(V.claim_edges(spark, sf), "vid")


@query("run10_claims", "limits", "select vid, lo, hi, cid, ln, in_lim, in_link, out_lim, out_link from limits")
def run10(spark, sf):
    return R.claim_limits(_owner_runs(spark, sf), ["vid"], "last", "cid").selectExpr(
        "vid", "lo", "hi", "owner.cid as cid", "owner.ln as ln", "in_lim", "in_link", "out_lim", "out_link")


@query("run18_arm_points", "limits", """
  select vid, lo, hi, cid, ln,
    case when i0 >= o0 then greatest(lo - 1, 0) else i0 end as in_at,
    case when i0 >= o0 then least(hi + 1, last) else o0 end as out_at,
    lo - i0 < 0.5 * m and i0 > 0 as in_crowded, o0 - hi < 0.5 * m and o0 < last as out_crowded
  from (select *, case when in_link is not null then lo else greatest(lo - m, in_lim, 0) end as i0,
      case when out_link is not null then hi else least(hi + m, out_lim, last) end as o0
    from (select *, 3 + 2 * (vid % 2) as m from limits))""")
def run18(spark, sf):
    lim = R.claim_limits(_owner_runs(spark, sf), ["vid"], "last", "cid")
    return R.arm_points(lim, "3 + 2 * (vid % 2)", "last").selectExpr(
        "vid", "lo", "hi", "owner.cid as cid", "owner.ln as ln", "in_at", "out_at", "in_crowded", "out_crowded")


@query("run11_join_owner_gaps", "owned", """,
  r as (select vid, min(i) as lo, max(i) as hi, cid from (
    select *, sum(case when p is null or i > p + 1 or pc <> cid then 1 else 0 end) over (partition by vid order by i) g
    from (select *, lag(i) over (partition by vid order by i) p, lag(cid) over (partition by vid order by i) pc
          from owned)) group by vid, g, cid)
  select vid, min(lo) as lo, max(hi) as hi, cid from (
    select *, sum(case when ph is null or pc <> cid or lo - ph - 1 >= 5.95 then 1 else 0 end)
        over (partition by vid order by lo) as g
    from (select *, lag(hi) over (partition by vid order by lo) ph, lag(cid) over (partition by vid order by lo) pc
          from r)) group by vid, g, cid""")
def run11(spark, sf):
    c = V.claims(spark, sf)
    r = R.share_runs(c, ["vid"], ["cid", "ln"], "(lo + hi) div 2", ["lo", "hi", "cid", "ln"], "owner.cid")
    return R.join_owner_gaps(r, ["vid"], "5.95D").withColumnRenamed("owner", "cid")


@query("run11_give_back", "owned", """,
  r as (select vid, min(i) as lo, max(i) as hi, o, abs((min(i) + max(i)) // 2 - (o * 977) % 3000) as far from (
    select *, sum(case when p is null or i > p + 1 or po <> o then 1 else 0 end) over (partition by vid order by i) g
    from (select vid, i, cid % 7 as o, lag(i) over (partition by vid order by i) p,
            lag(cid % 7) over (partition by vid order by i) po from owned)) group by vid, g, o),
  n as (select *, lag(hi) over w ph, lag(o) over w po, lag(far) over w pf, lag(lo) over w pl,
      lead(lo) over w nl, lead(o) over w no, lead(far) over w nf from r window w as (partition by vid order by lo)),
  mid as (select * from n where ph = lo - 1 and nl = hi + 1 and po = no and po <> o),
  free as (select * from mid m where not exists (select 1 from mid b where b.vid = m.vid and b.lo = m.pl)),
  taken as (select vid, case when pf > nf then pl else nl end as lo, o from free),
  f as (select r.vid, r.lo, r.hi, coalesce(t.o, r.o) as o from r left join taken t on t.vid = r.vid and t.lo = r.lo)
  select vid, min(lo) as lo, max(hi) as hi, o as owner from (
    select *, sum(case when ph is null or po <> o or lo > ph + 1 then 1 else 0 end) over (partition by vid order by lo) g
    from (select *, lag(hi) over (partition by vid order by lo) ph, lag(o) over (partition by vid order by lo) po from f)
  ) group by vid, g, o""")
def run11_give_back(spark, sf):
    c = V.claims(spark, sf)
    r = R.share_runs(c, ["vid"], ["cid", "ln"], "(lo + hi) div 2", ["lo", "hi", "cid", "ln"], "owner.cid % 7")
    return R.give_back(r, ["vid"], "abs((lo + hi) div 2 - (owner * 977) % 3000)")


@query("run14_end_causes", "obs", """,
  e as (select vid, i, image_id, cnr, 'start' as side, -1 as sg from (select *, lag(observable) over (partition by vid
      order by i) p from obs) where observable and not coalesce(p, false)
    union all select vid, i, image_id, cnr, 'end', 1 from (select *, lead(observable) over (partition by vid
      order by i) p from obs) where observable and not coalesce(p, false)),
  w as (select e.vid, e.i, e.side, count(s.i) as n,
      arg_min(case when s.cnr between 8 and 9 then 'merged' when not s.in_frame then 'border' end, abs(s.i - e.i))
        filter (s.cnr between 8 and 9 or not s.in_frame) as why
    from e left join obs s on s.vid = e.vid and (s.i - e.i) * sg between 1 and 6 group by e.vid, e.i, e.side)
  select e.image_id, e.vid, e.i, e.side, coalesce(case when e.cnr >= 12 then 'junction' end, why,
      case when n < 6 then 'node' end, 'fade') as cause
  from e join w on w.vid = e.vid and w.i = e.i and w.side = e.side""")
def run14(spark, sf):
    return R.end_causes(R.observable(V.samples(spark, sf)), "observable", 6, {
        "here:junction": "cnr >= 12", "merged": "cnr between 8 and 9", "border": "not in_frame"})


oracle.define("core_owner", ("cores",), """
  select image_id, vid, i, jid, cx, cy from (
    select *, row_number() over (partition by vid, i order by abs(i - anchor), jid) as k
    from (select *, unnest(generate_series(lo, hi)) as i from cores)) where k = 1""")
oracle.define("stretches", ("obs", "core_owner"), """
  select image_id, vid, min(i) as lo, max(i) as hi, jid, arg_min(i, {'d': d2, 'i': i}) as att from (
    select *, sum(case when p is null or i > p + 1 or pj <> jid then 1 else 0 end) over (partition by vid order by i) g
    from (select *, lag(i) over (partition by vid order by i) p, lag(jid) over (partition by vid order by i) pj
      from (select o.image_id, o.vid, o.i, coalesce(c.jid, -1) as jid,
          coalesce(power(o.x - c.cx, 2) + power(o.y - c.cy, 2), 0) as d2
        from obs o left join core_owner c on c.vid = o.vid and c.i = o.i where observable)))
  group by image_id, vid, g, jid""")
oracle.define("edges", ("stretches",), """
  with n as (select *, lag(hi) over w ph, lag(jid) over w pj, lag(att) over w pa, lead(lo) over w nl,
      lead(jid) over w nj, lead(att) over w na from stretches window w as (partition by vid order by lo))
  select image_id, vid, lo as i0, hi as i1, case when ph = lo - 1 then pj end as u,
    case when nl = hi + 1 then nj end as w, case when ph = lo - 1 then pa else lo end as p0,
    case when nl = hi + 1 then na else hi end as p1, false as linked
  from n where jid = -1
  union all
  select image_id, vid, lo, lo - 1, pj, jid, pa, att, true from n where jid >= 0 and ph = lo - 1 and pj >= 0""")


def split_edges(line, owned, keys=R.EDGE):
    """Cut runs of `line` samples at the junctions that own them: edges between attachments (the sample of the claim
    nearest the junction's centre) or free ends; touching claims are joined by a linked edge of no length."""
    d = (line.join(owned, [*keys, "i"], "left").withColumn("owner", F.expr("coalesce(jid, -1L)"))
         .withColumn("d2", F.expr("coalesce(power(x - cx, 2) + power(y - cy, 2), 0.0D)"))
         .withColumn("_ck", F.expr(f"i div {CHUNK}")))
    d = groups_by_break(d, keys, ["i"], "_ck", {"_p": ("max", "i"), "_o": ("last", "owner")},
                        "_p is null or i > _p + 1 or _o <> owner")
    st = d.groupBy(*keys, "_run").agg(
        F.min("i").alias("lo"), F.max("i").alias("hi"), F.expr("min_by(i, struct(d2, i))").alias("att"),
        F.first("owner").alias("jid")).drop("_run").withColumn("owner", F.expr("struct(jid, att)"))
    n = R.neighbours(st, keys).withColumn("_b", F.expr("prev_hi = lo - 1")).withColumn("_a", F.expr("next_lo = hi + 1"))
    free = n.where("jid = -1").selectExpr(
        *keys, "lo as i0", "hi as i1", "case when _b then prev_owner.jid end as u",
        "case when _a then next_owner.jid end as w", "case when _b then prev_owner.att else lo end as p0",
        "case when _a then next_owner.att else hi end as p1", "false as linked")
    link = n.where("jid >= 0 and _b and prev_owner.jid >= 0").selectExpr(
        *keys, "lo as i0", "lo - 1 as i1", "prev_owner.jid as u", "jid as w", "prev_owner.att as p0", "att as p1",
        "true as linked")
    return free.unionByName(link)


def core_owner(cores):
    return (R.share_out(cores, R.EDGE, ["jid", "cx", "cy"], "anchor", ["jid"])
            .selectExpr("image_id", "vid", "i", "owner.jid as jid", "owner.cx as cx", "owner.cy as cy"))


def edges_of(s):
    return split_edges(R.observable(s).where("observable"), core_owner(_cores(s)))


@query("run15_split_edges", "edges", "select * from edges")
def run15(spark, sf):
    return edges_of(V.samples(spark, sf))


@query("run16_stubs")
def run16(spark, sf):
    s = V.samples(spark, sf)
    e = edges_of(s)
    why = R.end_causes(R.observable(s), "observable", 6, {"border": "not in_frame"})
    for side, at, col in (("start", "i0", "c0"), ("end", "i1", "c1")):
        e = e.join(why.where(f"side = '{side}'").selectExpr("image_id", "vid", f"i as {at}", f"cause as {col}"),
                   ["image_id", "vid", at], "left")
    free = "(u is null or w is null)"
    node = "(coalesce(u is null and c0 = 'node', false) or coalesce(w is null and c1 = 'node', false))"
    border = ("coalesce(case when u is null and w is not null then c0 = 'border' "
              "when u is not null and w is null then c1 = 'border' end, false)")
    return e.selectExpr("image_id", "vid", "i0", "i1",
                        f"(i1 - i0 + 1) < 5.95D and not linked and {free} and not {node} and not {border} as stub")


oracle.define("ends", ("obs",), """
  select e.vid, e.i, e.side, coalesce(bool_or(not s.in_frame), false) as at_border,
    count(s.i) < 6 and not coalesce(bool_or(not s.in_frame), false) as at_node
  from (select vid, i, 'start' as side, -1 as sg from (select *, lag(observable) over (partition by vid
      order by i) p from obs) where observable and not coalesce(p, false)
    union all select vid, i, 'end', 1 from (select *, lead(observable) over (partition by vid
      order by i) p from obs) where observable and not coalesce(p, false)) e
  left join obs s on s.vid = e.vid and (s.i - e.i) * sg between 1 and 6 group by e.vid, e.i, e.side""")
ORACLES["run16_stubs"] = oracle.sql("edges ends", """,
  c as (select e.*, b.at_border as b0, b.at_node as n0, f.at_border as b1, f.at_node as n1 from edges e
    left join ends b on b.vid = e.vid and b.i = e.i0 and b.side = 'start'
    left join ends f on f.vid = e.vid and f.i = e.i1 and f.side = 'end')
  select image_id, vid, i0, i1, (i1 - i0 + 1) < 5.95 and not linked and (u is null or w is null)
      and not coalesce(case when u is null then n0 end, false) and not coalesce(case when w is null then n1 end, false)
      and not coalesce(case when u is null and w is not null then b0 when u is not null and w is null then b1 end, false)
    as stub from c""")

oracle.define("arms", ("cores",), """
  select image_id, vid, jid, hi as i, 1 as sgn from cores union all select image_id, vid, jid, lo, -1 from cores""")


def _arms(s):
    c = _cores(s)
    return (c.selectExpr("image_id", "vid", "jid", "hi as i", "1 as sgn")
            .unionByName(c.selectExpr("image_id", "vid", "jid", "lo as i", "-1 as sgn")))


@query("run17_run_beyond_arm", "arms", """,
  w as (select a.jid, a.sgn, (s.i - a.i) * a.sgn as k, s.in_frame and s.cnr >= 1.5 as ok
    from arms a join samples s on s.vid = a.vid and (s.i - a.i) * a.sgn between 0 and 48),
  b as (select *, ok or coalesce(min(case when ok then k end) over (partition by jid, sgn order by k rows between
      current row and unbounded following) - max(case when ok then k end) over (partition by jid, sgn order by k
      rows unbounded preceding) <= 12, false) as okb from w)
  select a.image_id, a.vid, a.jid, a.i, a.sgn, cast(r.run as bigint) as run from arms a join (
    select jid, sgn, case when not bool_or(k = 0 and ok) then 0
      else greatest(coalesce(min(case when not okb then k end), count(*)) - 1, 0) end as run from b group by jid, sgn) r
  on r.jid = a.jid and r.sgn = a.sgn""")
def run17(spark, sf):
    s = V.samples(spark, sf)
    return R.ahead_run(_arms(s), s, "in_frame and cnr >= 1.5", 12, 48).selectExpr(
        "image_id", "vid", "jid", "i", "sgn", "coalesce(run, 0L) as run")


@query("run19_window_medians", "arms", """
  select a.jid, a.sgn, round(median(s.cnr), 6) as cnr, round(median(s.contrast), 6) as contrast
  from arms a join samples s on s.vid = a.vid and (s.i - a.i) * a.sgn between 0 and 12
  where s.in_frame group by a.jid, a.sgn""")
def run19(spark, sf):
    s = V.samples(spark, sf)
    m = R.window_medians(_arms(s), s.select("image_id", "vid", "i", "cnr", "contrast", "in_frame"), 12,
                         {"cnr": "cnr", "contrast": "contrast"}, "in_frame", ids=("jid", "sgn"))
    return m.selectExpr("jid", "sgn", "round(cnr, 6) as cnr", "round(contrast, 6) as contrast")


@query("top12_longest_stretch", "samples", """
  select vid, arg_max(run_start, {'n': n, 'e': -run_start}) as run_start, max(n) as n from (
    select vid, min(i) as run_start, count(*) as n from (
      select *, i - row_number() over (partition by vid order by i) as g from samples where in_frame)
    group by vid, g) group by vid""")
def top12(spark, sf):
    """The longest stretch inside the frame per edge, the first of equals."""
    runs = R.islands(V.samples(spark, sf), R.EDGE, "in_frame")
    return runs.groupBy("vid").agg(F.expr("max_by(run_start, struct(n, -run_start))").alias("run_start"),
                                   F.max("n").alias("n"))

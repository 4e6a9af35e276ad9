"""Queries with typing rules, selections, set operations and summaries of junctions."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.functions import columns as C
from filigrane.operators import paths as P
from filigrane.operators import relate as J
from filigrane.operators import rules as U
from filigrane.operators import runs as R
from filigrane.operators.quantile import quantiles
from filigrane.operators.scan import PART, at_positions, counted, running
from filigrane.operators.scorecard import top_by
from filigrane.plans import oracle
from filigrane.plans.registry import query
from filigrane.session import checkpointed
from filigrane.sources import views as V

oracle.define("lines", (), """
  select l_orderkey as jid, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as edge, l_partkey % 6 as vid,
    case when l_returnflag = 'A' or l_linenumber % 2 = 0 then 'in' else 'out' end as flow, l_suppkey % 4 as line,
    l_quantity as width, 1 + 10 * l_tax as blur, l_extendedprice as contrast, (l_partkey * 7) % 360 as ang,
    l_discount as disc from lineitem""")
oracle.define("members", (), """
  select o_orderkey as jid, o_custkey % 6 as p, (o_custkey + 1) % 6 as c1, (o_custkey + 2) % 6 as c2,
    o_orderstatus <> 'P' as is_node, case o_orderstatus when 'F' then 'bifurcation' when 'O' then 'anastomosis'
    else 'crossing' end as type, o_orderpriority = '1-URGENT' as second from orders""")


def lines(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as jid", "l_partkey * 100000 + l_suppkey * 10 + l_linenumber as edge", "l_partkey % 6 as vid",
        "case when l_returnflag = 'A' or l_linenumber % 2 = 0 then 'in' else 'out' end as flow", "l_suppkey % 4 as line",
        "l_quantity as width", "1 + 10 * l_tax as blur", "l_extendedprice as contrast", "(l_partkey * 7) % 360 as ang",
        "l_discount as disc")


def members(spark, sf):
    return V.table(spark, sf, "orders").selectExpr(
        "o_orderkey as jid", "o_orderstatus <> 'P' as is_node", "array(o_custkey % 6) as par",
        "array((o_custkey + 1) % 6, (o_custkey + 2) % 6) as chi",
        "case o_orderstatus when 'F' then 'bifurcation' when 'O' then 'anastomosis' else 'crossing' end as type",
        "o_orderpriority = '1-URGENT' as second").selectExpr(
        "*", "case when is_node then par end as parents", "case when is_node then chi end as children")


oracle.define("through4", ("lines", "members"), """
  with f as (select jid, list(edge order by edge) filter (flow = 'in') as ie, list(vid order by edge) filter (flow = 'in')
      as iv, list(vid order by edge) filter (flow = 'out') as ov from lines group by jid
      having count(*) = 4 and count(*) filter (flow = 'in') = 2),
  o as (select f.jid, iv, ov, m.is_node, m.p, m.c1, m.c2 from f left join members m on m.jid = f.jid),
  k as (select jid, (iv[1] = ov[1] or (is_node and iv[1] = p and ov[1] in (c1, c2))) as a11,
      (iv[1] = ov[2] or (is_node and iv[1] = p and ov[2] in (c1, c2))) as a12,
      (iv[2] = ov[1] or (is_node and iv[2] = p and ov[1] in (c1, c2))) as a21,
      (iv[2] = ov[2] or (is_node and iv[2] = p and ov[2] in (c1, c2))) as a22 from o)
  select jid from k where (a11 and a22) or (a12 and a21)""")


@query("rul07_through_pairs", "through4", "select jid from through4")
def rul07(spark, sf):
    m = members(spark, sf).where("is_node").selectExpr("jid", "explode(parents) as p", "children").selectExpr(
        "jid", "p", "explode(children) as c")
    return U.through_pairs(lines(spark, sf), m)


@query("rul06_observable_type", "through4", """
  , n as (select jid, count(*) as n, list_distinct(list(vid)) as vs from lines group by jid)
  select n.jid, n as n_lines, case when n <= 2 then 'none'
    when n = 3 then case when len(vs) = 3 and coalesce(is_node, false) and len(list_filter(vs, lambda v: v not in (p, c1, c2))) = 0
      then case when len(list_filter(vs, lambda v: v = p)) <= 1 then 'bifurcation' else 'confluence' end else 'pseudo-T' end
    when n = 4 and n.jid in (select jid from through4) then 'crossing' else 'compound' end as type_observable
  from n left join members m on m.jid = n.jid""")
def rul06(spark, sf):
    return U.observable_type(lines(spark, sf), members(spark, sf))


@query("rul04_event_types", "members", """
  select type, is_node, count(*) as n, case type when 'bifurcation' then 'bifurcation' when 'anastomosis' then
    'anastomosis' else 'crossing' end as name from members group by type, is_node""")
def rul04(spark, sf):
    """Truth type of an event: a node by its degrees, a fading end a pseudo-T, the others their own kind."""
    return members(spark, sf).groupBy("type", "is_node").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "type", "is_node", "n", "element_at(map('bifurcation', 'bifurcation', 'anastomosis', 'anastomosis', 'crossing', "
        "'crossing', 'vis_end', 'pseudo-T'), type) as name")


oracle.define("evs", ("members",), """
  select jid, 1 as ev, case when is_node then 'node' else 'crossing' end as kind, type, unnest(case when is_node
    then [p, c1, c2] else [p, c1] end) as vid from members
  union all select jid, 2, 'vis_end', 'pseudo-T', unnest([c2, (p + 3) % 6]) from members where second""")


@query("rul05_visible_type", "lines evs", """
  , sl as (select distinct jid, line, vid from lines where width > 10),
  pl as (select jid, line, count(*) as k, max(vid) as vid from sl group by jid, line),
  n as (select jid, count(*) as n_vis from pl group by jid),
  own as (select jid, vid, count(*) as per from pl where k = 1 group by jid, vid),
  t as (select e.jid, e.ev, count(distinct line) as own from evs e join sl on sl.jid = e.jid and sl.vid = e.vid
    group by e.jid, e.ev),
  a as (select e.jid, e.ev, any_value(kind) as kind, any_value(type) as type, count(per) as n_pos, count(*) as n_ves,
    coalesce(sum(per), 0) as s from evs e left join own on own.jid = e.jid and own.vid = e.vid group by e.jid, e.ev),
  b as (select a.*, coalesce(t.own, 0) as own, case when kind = 'node' then n_pos >= 3 when kind = 'crossing'
    then n_pos = n_ves and s >= 3 else n_pos = n_ves end as shows from a left join t on t.jid = a.jid and t.ev = a.ev),
  j as (select jid, count(*) as n_ev, count(*) filter (shows) as n_show, arg_min(kind, ev) as fk, arg_min(type, ev) as ft,
    arg_min(kind, ev) filter (shows) as ek, arg_min(type, ev) filter (shows) as et, arg_min(own, ev) filter (shows) as eo
    from b group by jid)
  select j.jid, coalesce(n_vis, 0) as n_vis, case when coalesce(n_vis, 0) <= 2 then 'none' when n_show = 0 then case
    when n_ev >= 2 then 'compound' when fk = 'node' then ft when n_vis = 3 then 'pseudo-T' else 'crossing' end
    when n_show >= 2 or eo < n_vis then 'compound' when ek = 'crossing' and eo = 3 then 'pseudo-T'
    when ek = 'vis_end' and eo >= 4 then 'crossing' else et end as type_visible from j left join n on n.jid = j.jid""")
def rul05(spark, sf):
    m = members(spark, sf)
    ev = m.selectExpr("jid", "1 as ev", "case when is_node then 'node' else 'crossing' end as kind", "type",
                      "case when is_node then concat(par, chi) else array(par[0], chi[0]) end as vessels").unionByName(
        m.where("second").selectExpr("jid", "2 as ev", "'vis_end' as kind", "'pseudo-T' as type",
                                     "array(chi[1], (par[0] + 3) % 6) as vessels"))
    return U.visible_type(lines(spark, sf).where("width > 10").select("jid", "line", "vid"), ev)


oracle.define("dirs_at", (), "select distinct l_orderkey as jid, (l_partkey * 7) % 360 as ang from lineitem")


def arms_at(spark, sf):
    return lines(spark, sf).select("jid", "ang").distinct()


def _greedy_sql(rounds=6):
    ctes = ["q0 as materialized (select x.jid, x.ang as a, y.ang as b, 180 - least(abs(x.ang - y.ang), "
            "360 - abs(x.ang - y.ang)) as turn from dirs_at x join dirs_at y on x.jid = y.jid and x.ang < y.ang "
            "where 180 - least(abs(x.ang - y.ang), 360 - abs(x.ang - y.ang)) <= 45)"]
    for k in range(rounds):
        ctes.append(f"""g{k} as materialized (select jid, s.a as a, s.b as b, s.t as turn from (
          select jid, m, min({{'t': turn, 'a': a, 'b': b}}) as s from (select jid, a as m, turn, a, b from q{k}
            union all select jid, b, turn, a, b from q{k}) group by jid, m) group by jid, s having count(*) = 2)""")
        ctes.append(f"""q{k + 1} as materialized (select q.* from q{k} q where not exists (select 1 from g{k} g
          where g.jid = q.jid and g.a in (q.a, q.b)) and not exists (select 1 from g{k} g where g.jid = q.jid
          and g.b in (q.a, q.b)))""")
    return ", " + ", ".join(ctes) + " " + " union all ".join(f"select * from g{k}" for k in range(rounds))


@query("top11_pair_arms", "dirs_at", _greedy_sql())
def top11(spark, sf):
    return U.pair_arms(arms_at(spark, sf), 45).select("jid", "a", "b", "turn")


@query("rul08_pair_relations", "dirs_at lines members", _greedy_sql() .replace(
    " select * from g0 union all", ", g as (select * from g0 union all", 1) + """)
  , va as (select jid, ang, min(vid) as vid from lines group by jid, ang)
  select g.jid, a, b, case when x.vid = y.vid then 'same' when m.is_node and ((x.vid = p and y.vid in (c1, c2))
    or (y.vid = p and x.vid in (c1, c2))) then 'lineage' when m.is_node and x.vid in (c1, c2) and y.vid in (c1, c2)
    then 'sibling' else 'unrelated' end as relation
  from g join va x on x.jid = g.jid and x.ang = g.a join va y on y.jid = g.jid and y.ang = g.b
  left join members m on m.jid = g.jid""")
def rul08(spark, sf):
    """What the pairs a straightness rule makes are to each other: one edge, parent and child, siblings, nothing."""
    g = U.pair_arms(arms_at(spark, sf), 45)
    va = checkpointed(lines(spark, sf).groupBy("jid", "ang").agg(F.min("vid").alias("vid")))
    m = members(spark, sf)
    d = (g.join(va.selectExpr("jid", "ang as a", "vid as va"), ["jid", "a"])
         .join(va.selectExpr("jid", "ang as b", "vid as vb"), ["jid", "b"])
         .join(m.select("jid", "parents", "children"), "jid", "left"))
    return d.selectExpr("jid", "a", "b", """case when va = vb then 'same'
        when (array_contains(parents, va) and array_contains(children, vb))
          or (array_contains(parents, vb) and array_contains(children, va)) then 'lineage'
        when (array_contains(children, va) and array_contains(children, vb))
          or (array_contains(parents, va) and array_contains(parents, vb)) then 'sibling'
        else 'unrelated' end as relation""")


@query("skl07_junction_angles", "dirs_at", """
  , k as (select jid, list(ang order by ang) as a from dirs_at group by jid having count(*) in (3, 4))
  select jid, cast(len(a) as bigint) as n, case when len(a) = 3 then least(a[2] - a[1], a[3] - a[2], 360 - a[3] + a[1]) end
      as min_gap, case when len(a) = 3 then 180 - greatest(a[2] - a[1], a[3] - a[2], 360 - a[3] + a[1]) end as straight_dev,
    case when len(a) = 4 and greatest(abs(180 - (a[3] - a[1])), abs(180 - (a[4] - a[2]))) <= 35 then
      round(least(x, 180 - x), 6) end as crossing_angle
  from (select *, case when len(a) = 4 then (abs((a[1] + a[3] - 180) / 2.0 - (a[2] + a[4] - 180) / 2.0)) % 180 end as x from k)""")
def skl07(spark, sf):
    """Angular gaps at 3-arm nodes and the angle of 4-arm nodes whose opposite arms line up."""
    a = arms_at(spark, sf)
    n = a.groupBy("jid").agg(F.count(F.lit(1)).alias("n")).where("n in (3, 4)")
    k = a.join(n, "jid").groupBy("jid", "n").agg(F.sort_array(F.collect_list("ang")).alias("a"))
    k = k.withColumn("x", F.expr("case when n = 4 then abs((a[0] + a[2]) / 2.0D - (a[1] + a[3]) / 2.0D) % 180 end"))
    return k.selectExpr(
        "jid", "n", "case when n = 3 then least(a[1] - a[0], a[2] - a[1], 360 - a[2] + a[0]) end as min_gap",
        "case when n = 3 then 180 - greatest(a[1] - a[0], a[2] - a[1], 360 - a[2] + a[0]) end as straight_dev",
        "case when n = 4 and greatest(abs(180 - (a[2] - a[0])), abs(180 - (a[3] - a[1]))) <= 35 "
        "then round(least(x, 180 - x), 6) end as crossing_angle")


@query("agg21_difficulty", "lines dirs_at", """
  , r as (select jid, count(*) as n, max(greatest(blur, 1e-4)) / min(greatest(blur, 1e-4)) as blur, max(greatest(width,
      1e-4)) / min(greatest(width, 1e-4)) as width, max(contrast) / min(contrast) as contrast from lines group by jid),
  a as (select x.jid, min(least(abs(x.ang - y.ang), 360 - abs(x.ang - y.ang))) as ang from dirs_at x join dirs_at y
    on x.jid = y.jid and x.ang < y.ang group by x.jid)
  select r.jid, n, case when n >= 2 then round(blur, 6) end as blur_ratio, case when n >= 2 then round(width, 6) end as
    width_ratio, case when n >= 2 then round(contrast, 6) end as contrast_ratio, a.ang as min_arm_angle
  from r left join a on a.jid = r.jid""")
def agg21(spark, sf):
    """Ratios over the arms of a junction and the smallest angle between two directions, which two neighbours in
    angular order have (at most 360 directions per node)."""
    from pyspark.sql import Window
    l = lines(spark, sf)
    r = l.groupBy("jid").agg(F.count(F.lit(1)).alias("n"), *[F.expr(
        f"max(greatest({c}, 1e-4D)) / min(greatest({c}, 1e-4D))").alias(c) for c in ("blur", "width", "contrast")])
    d = l.select("jid", "ang").distinct()
    w = Window.partitionBy("jid").orderBy("ang")
    g = d.withColumn("g", F.col("ang") - F.lag("ang").over(w)).groupBy("jid").agg(
        F.min("g").alias("g"), F.expr("360 - max(ang) + min(ang)").alias("wrap"), F.count(F.lit(1)).alias("k"))
    g = g.where("k >= 2").selectExpr("jid", "least(g, wrap) as min_arm_angle")
    return r.join(g, "jid", "left").selectExpr("jid", "n", *[
        f"case when n >= 2 then round({c}, 6) end as {c}_ratio" for c in ("blur", "width", "contrast")], "min_arm_angle")


@query("rul09_ambiguity_reasons", "lines members", """
  , b as (select l.jid, bool_or(width <= 3) as inv, bool_or(blur > 1.75) as bord, bool_or(disc >= 0.1) as crowd,
      max(width) filter (vid = c1 or vid = c2) as w1, min(width) filter (vid = c1 or vid = c2) as w0,
      any_value(is_node) as node, min(abs(ang - 180)) filter (not is_node) as shal
    from lines l join members m on m.jid = l.jid group by l.jid)
  select jid, array_to_string(list_filter([case when bord then 'at_border' end, case when crowd then 'crowded' end,
    case when inv then 'invisible_arm' end, case when shal < 15 then 'shallow_angle' end,
    case when node and w0 / w1 > 0.85 and w0 < w1 then 'symmetric_fork' end], lambda x: x is not null), ',') as reasons,
    coalesce(inv, false) or coalesce(shal < 15, false) or coalesce(node and w0 / w1 > 0.85 and w0 < w1, false) as ambiguous
  from b""")
def rul09(spark, sf):
    l = lines(spark, sf).join(members(spark, sf).select("jid", "is_node", "chi"), "jid")
    kid = "array_contains(chi, vid)"
    b = l.groupBy("jid").agg(
        F.expr("bool_or(width <= 3)").alias("inv"), F.expr("bool_or(blur > 1.75D)").alias("bord"),
        F.expr("bool_or(disc >= 0.1D)").alias("crowd"), F.expr(f"max(case when {kid} then width end)").alias("w1"),
        F.expr(f"min(case when {kid} then width end)").alias("w0"), F.first("is_node").alias("node"),
        F.expr("min(case when not is_node then abs(ang - 180) end)").alias("shal"))
    sym = f"node and w0 / w1 > {T.SYM_R}D and w0 < w1"
    return b.selectExpr("jid", f"""array_join(array_compact(array(case when bord then 'at_border' end,
        case when crowd then 'crowded' end, case when inv then 'invisible_arm' end,
        case when shal < {T.SHALLOW_DEG}D then 'shallow_angle' end, case when {sym} then 'symmetric_fork' end)), ',')
        as reasons""", f"coalesce(inv, false) or coalesce(shal < {T.SHALLOW_DEG}D, false) or coalesce({sym}, false) "
                       "as ambiguous")


@query("set07_lineage_pairs", "members", """
  select jid, 'related' as kind, p as a, c1 as b from members where is_node union all
  select jid, 'related', p, c2 from members where is_node union all
  select jid, 'sibling', least(c1, c2), greatest(c1, c2) from members where is_node""")
def set07(spark, sf):
    m = members(spark, sf).where("is_node")
    rel = m.selectExpr("jid", "explode(parents) as a", "children").selectExpr("jid", "'related' as kind", "a",
                                                                              "explode(children) as b")
    sib = m.selectExpr("jid", "explode(array(parents, children)) as g").selectExpr("jid", "explode(g) as a", "g").selectExpr(
        "jid", "'sibling' as kind", "a", "explode(g) as b").where("a < b")
    return rel.unionByName(sib)


@query("set06_hidden_vessels", "members lines", """
  , lv as (select jid, list_distinct(list(vid)) as vs from lines group by jid)
  select m.jid, array_to_string(list_sort(list_filter(list_distinct([p, c1, c2]), lambda v: not list_contains(coalesce(vs, []), v))), ',')
    as hidden from members m left join lv on lv.jid = m.jid""")
def set06(spark, sf):
    """Edges of a junction's events without a line at it."""
    # six edge numbers at most
    lv = lines(spark, sf).groupBy("jid").agg(F.collect_set("vid").alias("vs"))
    return members(spark, sf).join(lv, "jid", "left").selectExpr(
        "jid", "array_join(transform(array_sort(array_except(array_distinct(concat(par, chi)), "
        "coalesce(vs, array()))), v -> cast(v as string)), ',') as hidden")


@query("set02_union_of_events", "evs", """
  select kind, type, count(*) as n, count(distinct jid) as n_junctions from evs group by kind, type""")
def set02(spark, sf):
    m = members(spark, sf)
    a = m.selectExpr("jid", "case when is_node then 'node' else 'crossing' end as kind", "type", "par[0] as parent",
                     "explode(case when is_node then concat(par, chi) else array(par[0], chi[0]) end) as vid")
    b = m.where("second").selectExpr("jid", "'vis_end' as kind", "'pseudo-T' as type", "1.5D as gap_px",
                                     "explode(array(chi[1], (par[0] + 3) % 6)) as vid")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("jid").alias("n_junctions"))


@query("set03_drop_redundant", "", """
  , e as (select l_orderkey as jid, l_partkey % 4 as a, l_suppkey % 4 as b, l_linenumber as ln, l_partkey as pk,
      l_suppkey as sk, case when l_returnflag = 'A' then 'crossing' else 'vis_end' end as kind from lineitem),
  v as (select *, least(a, b) as x, greatest(a, b) as y, row_number() over (partition by jid, least(a, b), greatest(a, b)
    order by ln, pk, sk) as k from e where kind = 'vis_end' and not exists (select 1 from e c where c.kind = 'crossing'
    and c.jid = e.jid and least(c.a, c.b) = least(e.a, e.b) and greatest(c.a, c.b) = greatest(e.a, e.b)))
  select jid, x, y, ln, pk from v where k = 1""")
def set03(spark, sf):
    """Fading ends that a crossing of the same two edges does not explain, one per pair."""
    e = V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as jid", "least(l_partkey % 4, l_suppkey % 4) as x", "greatest(l_partkey % 4, l_suppkey % 4) as y",
        "l_linenumber as ln", "l_partkey as pk", "l_suppkey as sk", "l_returnflag = 'A' as crossing")
    c = e.where("crossing").select("jid", "x", "y").distinct()
    v = e.where("not crossing").join(c, ["jid", "x", "y"], "left_anti")
    return v.groupBy("jid", "x", "y").agg(F.expr("min(struct(ln, pk, sk))").alias("m")).selectExpr(
        "jid", "x", "y", "m.ln as ln", "m.pk as pk")


oracle.define("obs5", ("samples",), """
  select vid, i from (select *, _ok and (max(case when _ok then i end) over (partition by vid, _g)
      - min(case when _ok then i end) over (partition by vid, _g)) >= 11.9 as o from (
    select *, coalesce(max(case when not _ok then i end) over (partition by vid order by i rows unbounded preceding), -1) _g
    from (select *, (raw or coalesce(min(case when raw then i end) over (partition by vid order by i rows between current row
      and unbounded following) - max(case when raw then i end) over (partition by vid order by i rows unbounded preceding)
      <= 6, false)) and in_frame as _ok from (select *, cnr >= 5 and in_frame as raw from samples)))) where o""")


@query("set05_threshold_subset", "obs obs5", """
  select 5.0::double as hi, 3.0::double as lo, (select count(*) from obs5) as n_hi, (select count(*) from obs where observable) as n_lo,
    (select count(*) from (select vid, i from obs5 except select vid, i from obs where observable)) as n_outside""")
def set05(spark, sf):
    """Samples observable at a higher threshold are among those at the lower one."""
    s = V.samples(spark, sf)
    lo = checkpointed(R.observable(s).where("observable").select("vid", "i"))
    hi = checkpointed(R.observable(s, cnr=5.0).where("observable").select("vid", "i"))
    both = (hi.withColumn("h", F.lit(1)).withColumn("l", F.lit(0)).unionByName(lo.withColumn("h", F.lit(0)).withColumn("l", F.lit(1)))
            .groupBy("vid", "i").agg(F.max("h").alias("h"), F.max("l").alias("l")))
    return both.selectExpr("5.0D as hi", "3.0D as lo", "h", "l").groupBy("hi", "lo").agg(
        F.sum("h").alias("n_hi"), F.sum("l").alias("n_lo"), F.sum(F.expr("h * (1 - l)")).alias("n_outside"))


# ------------------------------------------------------------------------------------------------ projections
@query("prj01_pixel_units", "nodes", """
  select nid, 4 * (x - 3 * scene_id) as px, 4 * (y - 2 * scene_id) as py, x between -0.5 and 159.5 and y between -0.5 and 99.5
    as inside, x between -48.5 and 207.5 and y between -48.5 and 147.5 as near from nodes""")
def prj01(spark, sf):
    """PRJ-01 and PRJ-02: units to pixels by each scene's origin, and the frame tests with their half-pixel rule."""
    n = V.nodes(spark, sf)
    o = n.select("scene_id").distinct().selectExpr("scene_id", "4.0D as k", "3 * scene_id as ox", "2 * scene_id as oy")
    return n.join(o, "scene_id").selectExpr(
        "nid", "k * (x - ox) as px", "k * (y - oy) as py", C.doubles(C.in_frame("x", "y", 160, 100)) + " as inside",
        C.doubles(C.in_frame("x", "y", 160, 100, "48.0")) + " as near")


@query("prj04_valid_pixels", "pixels", """
  select image_id, count(*) filter (value > 0 and value < 0.3) as n_valid, count(*) as n,
    round(avg(case when value > 0 and value < 0.3 then value end), 6) as mean from pixels group by image_id""")
def prj04(spark, sf):
    p = V.pixels(spark, sf).withColumn("v", F.expr("case when value > 0 and value < 0.3D and not isnan(value) then value "
                                                   "end"))
    return p.groupBy("image_id").agg(F.count("v").alias("n_valid"), F.count(F.lit(1)).alias("n"),
                                     F.expr("round(avg(v), 6)").alias("mean"))


oracle.define("vis", ("samples",), """
  with p as (select *, i - row_number() over (partition by vid, in_frame and cnr >= 1.5 order by i) as g,
      in_frame and cnr >= 1.5 as ok from samples),
  r as (select vid, max(n) as run from (select vid, count(*) as n from p where ok group by vid, g) group by vid)
  select p.vid, max(cnr) filter (in_frame) as max_cnr, cast(count(*) filter (ok) as double) as visible_px,
    cast(coalesce(any_value(r.run), 0) as double) as run_px, cast(count(*) filter (in_frame) as double) as frame_px,
    max(peak) filter (in_frame) as peak from p left join r on r.vid = p.vid group by p.vid""")


def visibility(s):
    """Per edge: largest CNR, visible length, its longest run, length in the frame, peak."""
    d = s.withColumn("ok", F.expr(f"in_frame and cnr >= {T.CNR_VISIBLE}"))
    g = d.groupBy("vid").agg(
        F.expr("max(case when in_frame then cnr end)").alias("max_cnr"),
        F.expr("cast(coalesce(sum(case when ok then ds end), 0) as double)").alias("visible_px"),
        F.expr("cast(coalesce(sum(case when in_frame then ds end), 0) as double)").alias("frame_px"),
        F.expr("max(case when in_frame then peak end)").alias("peak"))
    return g.join(R.longest(d, "ok", "ds", keys=("vid",)).selectExpr("vid", "cast(longest as double) as run_px"), "vid")


TIER = ("case when max_cnr >= 3 and run_px >= 11.9 then 'required' when max_cnr is null or max_cnr < 1.5 then 'invisible' "
        "else 'dont_care' end")


@query("agg06_visibility", "vis", f"select vid, max_cnr, visible_px, run_px, frame_px, peak, {TIER} as tier from vis")
def agg06(spark, sf):
    return visibility(V.samples(spark, sf)).selectExpr("vid", "max_cnr", "visible_px", "run_px", "frame_px", "peak",
                                                       f"{TIER} as tier")


@query("prj05_tiers", "vis", f"select tier, count(*) as n from (select {TIER} as tier from vis) group by tier")
def prj05(spark, sf):
    return visibility(V.samples(spark, sf)).selectExpr(f"{TIER} as tier").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("prj06_arm_visibility", "samples", """
  select image_id, case when not in_frame then 'out_of_frame' when cnr >= 3 then 'visible' when cnr >= 1.5 then 'faint'
    else 'invisible' end as visibility, count(*) as n from samples group by 1, 2""")
def prj06(spark, sf):
    return V.samples(spark, sf).selectExpr("image_id", """case when not in_frame then 'out_of_frame' when cnr >= 3
        then 'visible' when cnr >= 1.5 then 'faint' else 'invisible' end as visibility""").groupBy(
        "image_id", "visibility").agg(F.count(F.lit(1)).alias("n"))


@query("prj07_visible_subset", "obs_junctions", """
  , k as (select *, row_number() over (partition by image_id order by jid) - 1 as new_id from obs_junctions where type <> 0)
  select k.image_id, k.jid, k.new_id, t.new_id as link, round(n.d, 6) as nearest from k
  left join k t on t.image_id = k.image_id and t.jid = k.jid + 1
  left join (select a.jid, sqrt(min(power(a.x - b.x, 2) + power(a.y - b.y, 2))) as d from k a join k b
    on a.image_id = b.image_id and a.jid <> b.jid group by a.jid) n on n.jid = k.jid""")
def prj07(spark, sf):
    """Junctions kept, numbered anew; links to dropped ones become NULL; distances measured again."""
    j = V.obs_junctions(spark, sf).where("type <> 0").withColumn("_ck", F.expr("jid div 4096"))
    k = checkpointed(running(j, ["image_id"], ["jid"], "_ck", {"r": ("sum", "1L")}).selectExpr(
        "image_id", "jid", "x", "y", "r - 1 as new_id"))
    t = k.selectExpr("image_id", "jid - 1 as jid", "new_id as link")
    n = J.nearest_any(k, k, "jid", "b_jid", 8.0, on="a_jid <> b_jid").selectExpr(
        "image_id", "jid", "round(distance, 6) as nearest")
    return k.join(t, ["image_id", "jid"], "left").join(n, ["image_id", "jid"], "left").select(
        "image_id", "jid", "new_id", "link", "nearest")


@query("prj10_float32", "samples", """
  select vid, i, cast(cast(cnr as float) as double) as cnr, cast(cast(peak as float) as double) as peak from samples""")
def prj10(spark, sf):
    return V.samples(spark, sf).selectExpr("vid", "i", "cast(cast(cnr as float) as double) as cnr",
                                           "cast(cast(peak as float) as double) as peak")


@query("prj11_flatten_keys", "profiles", """
  , s as (select image_id, scale, avg(contrast) as c, avg(fwhm) as f from profiles group by image_id, scale),
  l as (select image_id, avg(fwhm) as lam from profiles group by image_id)
  select image_id, 'ps:' || scale || ':contrast' as key, round(c, 6) as value from s
  union all select image_id, 'ps:' || scale || ':fwhm', round(f, 6) from s
  union all select s.image_id, 'lam:fwhm:' || scale, round(f / lam, 6) from s join l on l.image_id = s.image_id""")
def prj11(spark, sf):
    """Nested statistics as prefixed keys, and keys normalised by the image's own unit length."""
    p = V.profiles(spark, sf)
    s = p.groupBy("image_id", "scale").agg(F.avg("contrast").alias("c"), F.avg("fwhm").alias("f"))
    l = p.groupBy("image_id").agg(F.avg("fwhm").alias("lam"))
    return s.join(l, "image_id").selectExpr(
        "image_id", "stack(3, concat_ws(':', 'ps', scale, 'contrast'), round(c, 6), concat_ws(':', 'ps', scale, 'fwhm'), "
        "round(f, 6), concat_ws(':', 'lam:fwhm', scale), round(f / lam, 6)) as (key, value)")


@query("prj12_comparable_record", "image_stats", """
  select image_id, 'scalar' as part, key, round(value, 6) as value from image_stats
  union all select vec_id, 'psd', cast(p + 1 as varchar), round(embedding[p + 1] * embedding[p + 1]::double, 6)
  from (select *, unnest(range(len(embedding))) as p from embeddings)""")
def prj12(spark, sf):
    """Scalars and the spectrum of an image as one long record."""
    a = V.image_stats(spark, sf).selectExpr("image_id", "'scalar' as part", "key", "round(value, 6) as value")
    b = V.table(spark, sf, "embeddings").selectExpr("vec_id", "posexplode(embedding) as (p, e)").selectExpr(
        "vec_id", "'psd'", "cast(p + 1 as string)", "round(e * cast(e as double), 6)")
    return a.union(b)


@query("prj13_one_profile", "samples", """
  select i, x, y, cnr, in_frame from samples where vid = (select vid from samples order by cnr desc, vid limit 1)""")
def prj13(spark, sf):
    """The samples of one edge: the one with the strongest sample."""
    s = V.samples(spark, sf)
    v = s.agg(F.expr("max(struct(cnr, -vid as nv))").alias("m")).selectExpr("-m.nv as vid")
    return s.join(v, "vid", "left_semi").select("i", "x", "y", "cnr", "in_frame")


@query("prj15_default_visibility", "vis", """
  select c_custkey as vid, k.kind, coalesce(case when k.kind = 'average' then max_cnr end, 0) as max_cnr,
    case when k.kind = 'average' and v.vid is not null then 'imaged' else 'out_of_frame' end as tier
  from customer cross join (values ('average'), ('frame')) k(kind) left join vis v on v.vid = c_custkey""")
def prj15(spark, sf):
    """A row per edge and kind of image, with defaults where an edge was not imaged."""
    c = V.table(spark, sf, "customer").selectExpr("c_custkey as vid", "explode(array('average', 'frame')) as kind")
    v = visibility(V.samples(spark, sf)).selectExpr("vid", "'average' as kind", "max_cnr as m", "true as hit")
    return c.join(v, ["vid", "kind"], "left").selectExpr(
        "vid", "kind", "coalesce(m, 0.0D) as max_cnr", "case when hit then 'imaged' else 'out_of_frame' end as tier")


@query("prj18_rules", "samples", """
  select image_id, 3.0::double as cnr_observe, 11.9::double as min_run_px, 5.95::double as bridge_px, 11.9::double as lambda_px, 1 as version, count(*) as n
  from samples group by image_id""")
def prj18(spark, sf):
    """The rules a result was made under, written beside it."""
    return V.samples(spark, sf).groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "image_id", f"{T.CNR_OBSERVE}D as cnr_observe", f"{T.MIN_RUN_PX}D as min_run_px", f"{T.BRIDGE_PX}D as bridge_px",
        f"{T.LAMBDA_PX}D as lambda_px", "1 as version", "n")


BANDS = T.DEFAULT_BAND_RMS["average"]
BAND_VALUES = ", ".join(f"({b}, {v!r})" for b, v in BANDS.items())
oracle.define("band_rms", ("samples",), f"""
  select m.image_id, k.band, coalesce(case when m.level > 50 then m.level / 10000 end, k.rms) as rms
  from (select image_id, avg(cnr) * 10 as level from samples group by image_id) m cross join (values {BAND_VALUES}) k(band, rms)""")


def band_rms(spark, s):
    """RMS per image and band: the image's own number for every band where it has one, else the defaults."""
    d = ", ".join(f"struct({b}L as band, {v!r}D as rms)" for b, v in BANDS.items())
    own = s.groupBy("image_id").agg(F.expr("avg(cnr) * 10").alias("level"))
    return own.selectExpr("image_id", "level", f"explode(array({d})) as k").selectExpr(
        "image_id", "k.band as band", "coalesce(case when level > 50 then level / 10000 end, k.rms) as rms")


@query("prj19_band_defaults", "band_rms", "select image_id, cast(band as bigint) as band, round(rms, 9) as rms from band_rms")
def prj19(spark, sf):
    return band_rms(spark, V.samples(spark, sf)).selectExpr("image_id", "band", "round(rms, 9) as rms")


@query("agg07_band_matched_cnr", "samples band_rms", """
  select vid, i, arg_max(cast(band as bigint), {'c': c, 'b': band}) as band, round(max(c), 4) as cnr from (
    select s.vid, s.i, b.band, s.peak / (1 + abs(b.band - 2 * s.r)) / greatest(b.rms, 1e-9) as c from samples s
    join band_rms b on b.image_id = s.image_id) group by vid, i""")
def agg07(spark, sf):
    """Response over background in the band that suits a sample best."""
    s = V.samples(spark, sf)
    b = band_rms(spark, s).groupBy("image_id").agg(F.expr("collect_list(struct(band, rms))").alias("bands"))
    c = "transform(bands, b -> struct(peak / (1 + abs(b.band - 2 * r)) / greatest(b.rms, 1e-9D) as c, b.band as band))"
    d = s.join(b, "image_id").withColumn("m", F.expr(f"array_max({c})"))
    return d.selectExpr("vid", "i", "m.band as band", "round(m.c, 4) as cnr")


# ------------------------------------------------------------------------------------------------ order
@query("top05_darkest_paths", "profiles", """
  , m as (select image_id, path, median(contrast) as m from profiles group by image_id, path having count(*) >= 3),
  k as (select *, row_number() over (partition by image_id order by m, path) as r from m)
  select image_id, count(*) as n_long, count(*) filter (m < 20000) as n_dark, round(min(m), 6) as darkest,
    round(case when count(*) >= 6 then min(m) / median(m) filter (r between 2 and 6) end, 6) as dominance from k
  group by image_id""")
def top05(spark, sf):
    m = checkpointed(quantiles(V.profiles(spark, sf), ["image_id", "path"], "contrast", {"m": 0.5}, count="n").where("n >= 3"))
    g = m.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_long"), F.expr("count_if(m < 20000)").alias("n_dark"),
                                  F.min("m").alias("darkest"))
    t = top_by(m, ["image_id"], [F.col("m"), F.col("path")], 6).where("rank >= 2").groupBy("image_id").agg(
        F.expr("percentile(m, 0.5D)").alias("nx"))
    return g.join(t, "image_id", "left").selectExpr(
        "image_id", "n_long", "n_dark", "round(darkest, 6) as darkest",
        "round(case when n_long >= 6 then darkest / nx end, 6) as dominance")


@query("top07_renumber_junctions", "obs_junctions", """
  , k as (select *, row_number() over (partition by image_id order by round(y, 3), round(x, 3), jid) - 1 as new_id
    from obs_junctions)
  select k.image_id, k.jid, k.new_id, t.new_id as link from k left join k t on t.image_id = k.image_id and t.jid = k.jid + 1""")
def top07(spark, sf):
    j = V.obs_junctions(spark, sf).selectExpr("image_id", "jid", "round(y, 3) as ry", "round(x, 3) as rx",
                                              "cast(floor(y) as bigint) as _ck")
    k = checkpointed(running(j, ["image_id"], ["ry", "rx", "jid"], "_ck", {"r": ("sum", "1L")}).selectExpr(
        "image_id", "jid", "r - 1 as new_id"))
    return k.join(k.selectExpr("image_id", "jid - 1 as jid", "new_id as link"), ["image_id", "jid"], "left")


@query("top08_node_order", "obs_junctions", """
  select image_id, jid, row_number() over (partition by image_id order by case type when 0 then 0 when 1 then 1 when 2 then 2
    when 3 then 3 else 4 end, y, x, jid) - 1 as ord from obs_junctions""")
def top08(spark, sf):
    """Graph nodes in order of kind, then position."""
    j = V.obs_junctions(spark, sf).selectExpr("image_id", "jid", "y", "x", "type as kind_rank",
                                              "type * 100000 + cast(floor(y) as bigint) as _ck")
    return running(j, ["image_id"], ["kind_rank", "y", "x", "jid"], "_ck", {"r": ("sum", "1L")}).selectExpr(
        "image_id", "jid", "r - 1 as ord")


# ------------------------------------------------------------------------------------------------ summaries
@query("agg08_junction_summary", "lines members", """
  , j as (select m.jid, m.type, least(count(l.jid), 5) as n_arms, coalesce(bool_or(width <= 3), false) as amb
    from members m left join lines l on l.jid = m.jid group by m.jid, m.type)
  select type, n_arms, amb, count(*) as n from j group by grouping sets ((type), (n_arms), (amb), ())""")
def agg08(spark, sf):
    a = lines(spark, sf).groupBy("jid").agg(F.count(F.lit(1)).alias("k"), F.expr("bool_or(width <= 3)").alias("amb"))
    j = members(spark, sf).join(a, "jid", "left").selectExpr("type", "least(coalesce(k, 0), 5) as n_arms",
                                                              "coalesce(amb, false) as amb")
    j.createOrReplaceTempView("_agg08_junctions")
    return spark.sql("""select type, n_arms, amb, count(*) as n from _agg08_junctions
                        group by grouping sets ((type), (n_arms), (amb), ())""")


oracle.define("obs_runs", ("obs",), """
  select image_id, vid, min(i) as lo, max(i) as hi from (
    select *, i - row_number() over (partition by vid order by i) as g from obs where observable) group by image_id, vid, g""")


@query("agg09_observable_summary", "obs_runs", """
  select image_id, count(*) as n_runs, count(distinct vid) as n_vessels, cast(sum(hi - lo) as bigint) as length_px,
    max(hi - lo) as longest from obs_runs group by image_id""")
def agg09(spark, sf):
    r = R.islands(R.observable(V.samples(spark, sf)), R.EDGE, "observable")
    return r.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("vid").alias("n_vessels"),
                                     F.expr("sum(run_end - run_start)").alias("length_px"),
                                     F.expr("max(run_end - run_start)").alias("longest"))


@query("agg10_totals", "flags", """
  select image_id, sum(case when observable then ds else 0 end) as observable_px,
    sum(case when dont_care then ds else 0 end) as dont_care_px, sum(case when in_frame then ds else 0 end) as in_frame_px,
    sum(case when observable and cnr < 3 then ds else 0 end) as bridged_px, count(distinct case when observable then vid end)
    as n_vessels from flags group by image_id""")
def agg10(spark, sf):
    f = R.dont_care(V.samples(spark, sf))
    return f.groupBy("image_id").agg(
        *[F.expr(f"sum(case when {c} then ds else 0 end)").alias(n) for n, c in (
            ("observable_px", "observable"), ("dont_care_px", "dont_care"), ("in_frame_px", "in_frame"),
            ("bridged_px", "observable and cnr < 3"))],
        F.expr("count(distinct case when observable then vid end)").alias("n_vessels"))


@query("agg18_main_host", "rec_runs", """
  , p as (select image_id, a, b, sum(n) as n, min(i0) as first from rec_runs group by image_id, a, b)
  select image_id, a, arg_max(b, {'n': n, 'f': -first, 'b': -b}) as host, cast(max(n) as bigint) as n from p
  group by image_id, a""")
def agg18(spark, sf):
    """The edge that a merged edge is merged with most, the first met of equals."""
    r = R.record_runs(checkpointed(J.pair_records(V.samples(spark, sf))))
    p = r.groupBy("image_id", "a", "b").agg(F.sum("n").alias("n"), F.min("i0").alias("first"))
    return p.groupBy("image_id", "a").agg(F.expr("max_by(b, struct(n, -first, -b))").alias("host"), F.max("n").alias("n"))


@query("agg19_carried_edges", "rec_runs obs_runs", """
  select r.image_id, r.vid, r.lo, count(distinct m.a) as n_carried, min(m.a) as first, max(m.a) as last
  from obs_runs r join rec_runs m on m.b = r.vid and m.j0 <= r.hi and m.j1 >= r.lo group by r.image_id, r.vid, r.lo""")
def agg19(spark, sf):
    """Edges merged into every run: partner stretches that fall on it, met in the buckets they cover."""
    s = V.samples(spark, sf)
    runs = checkpointed(R.islands(R.observable(s), R.EDGE, "observable").selectExpr("image_id", "vid", "run_start as lo",
                                                                                   "run_end as hi"))
    m = checkpointed(R.record_runs(checkpointed(J.pair_records(s))).selectExpr("image_id", "b as vid", "a", "j0", "j1"))
    k = ["image_id", "vid", "_b"]
    d = at_positions(runs.withColumn("_b", F.expr("explode(sequence(lo div 64, hi div 64))")),
                     m.withColumn("_b", F.expr("explode(sequence(j0 div 64, j1 div 64))")), k).where("j0 <= hi and j1 >= lo")
    d = d.select("image_id", "vid", "lo", "a").distinct()
    return d.groupBy("image_id", "vid", "lo").agg(F.count(F.lit(1)).alias("n_carried"), F.min("a").alias("first"),
                                                  F.max("a").alias("last"))


@query("agg20_junction_centre", "", """
  , p as (select l_orderkey as jid, (l_partkey * 37) % 24 as x, (l_partkey * 53) % 24 as y from lineitem),
  c as (select jid, x::double as x, y::double as y from (select distinct * from p) union all
    select jid, avg(x), avg(y) from p group by jid),
  d as (select c.jid, c.x, c.y, sum(sqrt(power(c.x - p.x, 2) + power(c.y - p.y, 2))) as cost from c join p on p.jid = c.jid
    group by c.jid, c.x, c.y)
  select jid, round(min(cost), 4) as cost from d group by jid""")
def agg20(spark, sf):
    """Medoid of a junction's event centres and their mean. Centres sit on whole pixels within 2 lambda, so a junction
    has at most 576 distinct ones however many events it holds; they carry their counts."""
    p = V.table(spark, sf, "lineitem").selectExpr("l_orderkey as jid", "(l_partkey * 37) % 24 as x",
                                                  "(l_partkey * 53) % 24 as y")
    w = checkpointed(counted(p, p.count()).withColumnRenamed("_w", "w"))
    parts = max(1, -(-w.count() // (PART // 4)))  # a junction's rows stay in one part of bounded size from here on
    w = w.repartition(parts, "jid")
    m = w.groupBy("jid").agg(F.expr("sum(w * x) / sum(w)").alias("x"), F.expr("sum(w * y) / sum(w)").alias("y"))
    c = w.selectExpr("jid", "cast(x as double) as cx", "cast(y as double) as cy").unionByName(
        m.selectExpr("jid", "x as cx", "y as cy"))
    d = c.repartition(parts, "jid").hint("merge").join(w.hint("merge"), "jid").groupBy("jid", "cx", "cy").agg(
        F.expr("sum(w * sqrt(power(cx - x, 2) + power(cy - y, 2)))").alias("cost"))
    return d.groupBy("jid").agg(F.expr("round(min(cost), 4)").alias("cost"))


@query("skl06_arm_direction", "arcs", """
  , e as (select vid, max(arc) as l from arcs group by vid),
  t as (select vid, least(3.0, 0.3 * l) as d0, least(12.0, l) as d1 from e where l > 0),
  s as (select a.*, lead(arc) over (partition by vid order by i) as a1, lead(x) over (partition by vid order by i) as x1,
    lead(y) over (partition by vid order by i) as y1 from arcs a),
  p as (select t.vid, k, any_value(s.x + (d - arc) / (a1 - arc) * (x1 - s.x)) as x, any_value(s.y + (d - arc) / (a1 - arc)
      * (y1 - s.y)) as y from (select vid, 0 as k, d0 as d from t union all select vid, 1, d1 from t) t
    join s on s.vid = t.vid and s.arc <= d and s.a1 > d group by t.vid, k)
  select a.vid, round(b.x - a.x, 5) as dx, round(b.y - a.y, 5) as dy from p a join p b on b.vid = a.vid and a.k = 0 and b.k = 1""")
def skl06(spark, sf):
    """Direction in which an edge leaves its start: from a quarter to one lambda of arc, by interpolation."""
    k = ["image_id", "vid"]
    a = checkpointed(P.arclength(V.samples(spark, sf), k))
    e = a.groupBy(*k).agg(F.max("arc").alias("l")).where("l > 0")
    t = e.selectExpr(*k, "stack(2, 0, least(3.0D, 0.3D * l), 1, least(12.0D, l)) as (k, arc)")
    # points standing still on the arc count once
    c = a.groupBy(*k, "arc").agg(F.expr("max_by(struct(x, y), i)").alias("p")).selectExpr(*k, "arc", "p.x as x", "p.y as y")
    px = checkpointed(P.interpolate(c, t, k, "arc", "x", "v"))
    py = checkpointed(P.interpolate(c, t, k, "arc", "y", "v"))
    d = [p.groupBy(*k).agg(F.expr("max(case when k = 1 then v end) - max(case when k = 0 then v end)").alias(n))
         for p, n in ((px, "dx"), (py, "dy"))]
    return d[0].join(d[1], k).selectExpr("vid", "round(dx, 5) as dx", "round(dy, 5) as dy")


@query("itr12_continuous_paths", "tree", """
  , nx as (select parent as id, min(nid) as next from tree where parent is not null group by parent),
  l0 as (select t.nid as id from tree t where (t.nid in (select id from nx) or t.nid in (select next from nx))
    and t.nid not in (select next from nx)),
  """ + ", ".join(["c0 as (select id, id as start, 0 as pos from l0)"] + [
    f"c{k} as (select nx.next as id, c{k - 1}.start, c{k - 1}.pos + 1 as pos from c{k - 1} join nx on nx.id = c{k - 1}.id)"
    for k in range(1, 9)]) + " " + " union all ".join(f"select id, start, cast(pos as bigint) as pos from c{k}"
                                                     for k in range(9)))
def itr12(spark, sf):
    """Every node of the forest goes on to its first child: the paths this makes, with positions."""
    nx = V.tree(spark, sf).where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.min("nid").alias("next"))
    return U.chain_positions(nx)

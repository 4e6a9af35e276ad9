"""The same views in ANSI SQL, and a small way to put WITH clauses together."""
from __future__ import annotations

VIEWS = {
    "steps": ((), """
        select event_id, user_id as vid, event_type, value, epoch_us(ts) as us,
          cast((37 * event_id) % 5 - 2 as bigint) as dx, cast((53 * event_id) % 5 - 2 as bigint) as dy,
          cast(row_number() over w as bigint) as n,
          cast(sum((37 * event_id) % 5 - 2) over w as bigint) as sx,
          cast(sum((53 * event_id) % 5 - 2) over w as bigint) as sy
        from events window w as (partition by user_id order by ts, event_id)"""),
    "samples": (("steps",), """
        select *, (x between 0 and 159 and y between 0 and 99) as in_frame,
          case when x between 0 and 159 and y between 0 and 99 then peak end as contrast
        from (select vid // 25 as image_id, vid, n - 1 as i, cast(n - 1 as double) as s_px, 1.0::double as ds,
          cast((131 * vid) % 160 + sx as double) as x, cast((197 * vid) % 100 + sy as double) as y,
          case when dx = 0 and dy = 0 then 1.0 else dx / sqrt(cast(dx * dx + dy * dy as double)) end as tx,
          case when dx = 0 and dy = 0 then 0.0 else dy / sqrt(cast(dx * dx + dy * dy as double)) end as ty,
          cast(1 + vid % 3 as double) as r, cast(vid % 40 as double) as z, cast(1 + vid % 2 as double) as st,
          value / 10 as cnr, value / 100 as peak, event_id from steps)"""),
    "tracings": (("samples",), """
        select image_id, vid as line_id, i as k, x + vid % 5 as x, y - vid % 3 as y from samples"""),
    "burst_frames": (("steps",), """
        select vid as burst, n - 1 as idx, us / 1e6 as time_s, cast(sx as double) as dx_px,
          cast(sy as double) as dy_px, event_type <> 'error' as registered, value as gain, event_type from steps"""),
    "vessels": ((), """
        select o_custkey // 64 as scene_id, o_orderkey as vid, (o_custkey // 64) * 72 + o_custkey % 64 as u,
          (o_custkey // 64) * 72 + ((o_custkey % 64) // 8 + 1) * 8 + o_orderkey % 8 as v,
          1 + o_totalprice / 100000 as r, cast(1 + o_orderkey % 97 as double) as length,
          o_orderpriority as cls, o_orderstatus as side, o_totalprice as flow from orders"""),
    "nodes": (("vessels",), """
        select scene_id, nid, cast((nid * 37) % 480 as double) as x, cast((nid * 53) % 300 as double) as y,
          cast(nid % 40 as double) as depth, (nid % 72) // 8 as layer,
          case when (nid % 72) // 8 = 0 then 1.0 when (nid % 72) // 8 = 8 then 0.0 end as pressure
        from (select scene_id, u as nid from vessels union select scene_id, v from vessels)"""),
    "with_ctrl": (("vessels", "nodes"), """
        select v.scene_id, v.vid, v.u, v.v, v.r, v.cls, v.side, v.flow,
          [{'x': a.x, 'y': a.y},
           {'x': a.x + (b.x - a.x) / 4 + v.vid % 7, 'y': a.y + (b.y - a.y) / 4 - v.vid % 5},
           {'x': a.x + (b.x - a.x) / 2 - v.vid % 3, 'y': a.y + (b.y - a.y) / 2 + v.vid % 4},
           {'x': b.x, 'y': b.y}] as ctrl,
          [v.r, v.r * 0.75, v.r * 0.5] as r_ctrl, [a.depth, (a.depth + b.depth) / 2, b.depth] as z_ctrl
        from vessels v join nodes a on a.nid = v.u join nodes b on b.nid = v.v"""),
    "tree": ((), """
        select c_custkey // 64 as scene_id, c_custkey as nid, (c_custkey % 64) // 8 as layer,
          case when (c_custkey % 64) // 8 > 0 then (c_custkey // 64) * 64 + ((c_custkey % 64) // 8 - 1) * 8
            + c_nationkey % 8 end as parent,
          1 + abs(c_acctbal) / 1000 as leaf_r from customer"""),
    "traced_junctions": ((), """
        select s_suppkey // 10 as image_id, s_suppkey as tj, cast((s_suppkey * 37) % 160 as double) as x,
          cast((s_suppkey * 53) % 100 as double) as y, s_nationkey % 5 as type from supplier"""),
    "obs_junctions": ((), """
        select c_custkey // 150 as image_id, c_custkey as jid, cast((c_custkey * 37) % 160 as double) as x,
          cast((c_custkey * 53 + c_custkey // 150) % 100 as double) as y,
          cast(3 + c_custkey % 20 as double) as radius, c_nationkey % 5 as type from customer"""),
    "image_stats": ((), """
        select l_suppkey as image_id, case when l_suppkey % 5 = 0 then 'synthetic' else 'real' end as "set",
          l_suppkey % 3 as site, l_returnflag || l_linestatus as key,
          avg(l_extendedprice * (1 - l_discount)) as value
        from lineitem group by l_suppkey, l_returnflag, l_linestatus"""),
    "stat_keys": ((), """
        select distinct l_returnflag || l_linestatus as key,
          case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as tier from lineitem"""),
    "profiles": ((), """
        select l_suppkey as image_id, l_orderkey as pid, l_orderkey % 200 as path, l_extendedprice as contrast,
          l_quantity as fwhm, cast(1 + l_linenumber as double) as edge, l_quantity / (1 + l_linenumber) as sharp,
          cast(power(2, l_linenumber % 5) as bigint) as scale, l_discount, l_tax from lineitem"""),
    "claims": ((), """
        select l_partkey as vid, l_orderkey as cid, cast(l_linenumber as bigint) as ln,
          cast(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as bigint) as lo,
          cast(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) + l_quantity as bigint) as hi
        from lineitem"""),
    "pixels": ((), """
        select vec_id as image_id, cast(p // 8 as bigint) as y, cast(p % 8 as bigint) as x,
          cast(embedding[p + 1] as double) as value
        from (select vec_id, embedding, unnest(range(len(embedding))) as p from embeddings)"""),
    "raster": ((), """
        select p_partkey // 2500 as image_id, (p_partkey % 2500) // 50 as y, p_partkey % 50 as x,
          cast(p_size as bigint) as value, p_retailprice as price, p_partkey as pid from part"""),
    "skeleton": (("raster",), "select image_id, y, x, pid, value from raster where value <= 17"),
}


def define(name: str, needs, body: str) -> None:
    VIEWS[name] = (tuple(needs), body)


def sql(needs: str, body: str) -> str:
    """A full statement: the named views (and what they need) as WITH clauses, then `body`. A body that starts
    with its own clauses begins with a comma: ", c as (...) select ..."."""
    order: list[str] = []

    def add(n):
        for d in VIEWS[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in needs.split():
        add(n)
    ctes = ", ".join(f"{n} as ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    rec = "recursive " if "--recursive" in body else ""
    body = body.replace("--recursive", "").strip()
    if not ctes:
        return f"with {rec}{body[1:].strip()}" if body.startswith(",") else body
    return f"with {rec}{ctes}{body if body.startswith(',') else ' ' + body}"

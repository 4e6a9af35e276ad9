"""Runs, gaps and intervals along edges. Rows are samples (image_id, vid, i, ...) with dense i, or intervals."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.operators.scan import CHUNK, at_positions, groups_by_break, halo, islands, own, running, with_stretch
from filigrane.session import checkpointed

EDGE = ("image_id", "vid")


def bridge(df: DataFrame, flag: str, gap, keys=EDGE, pos="i", out="bridged", chunk=CHUNK, keep=False) -> DataFrame:
    """flag, or between two true positions at most `gap` apart; `keep` leaves those positions as _prev, _next."""
    d = df.withColumn("_ck", F.expr(f"{pos} div {chunk}"))
    hit = f"case when {flag} then {pos} end"
    d = running(d, keys, [pos], "_ck", {"_prev": ("max", hit), "_next": ("min", hit, "back")})
    d = d.withColumn(out, F.expr(f"({flag}) or coalesce(_next - _prev <= {gap}, false)"))
    return d.drop("_ck") if keep else d.drop("_ck", "_prev", "_next")


def seen_mask(df: DataFrame, threshold: float, bridge_px: float, min_px: float, in_frame_only: bool,
              out: str = "seen", keys=EDGE, chunk=CHUNK) -> DataFrame:
    """Samples at or above the threshold, short gaps bridged, in runs of at least min_px; optionally only inside
    the frame."""
    inside = " and in_frame" if in_frame_only else ""
    d = df.withColumn("_raw", F.expr(f"cnr >= {threshold}{inside}"))
    d = bridge(d, "_raw", f"greatest(1, cast(round({bridge_px} / ds) as long))", keys, out="_ok", chunk=chunk)
    d = with_stretch(checkpointed(d.withColumn("_ok", F.expr(f"_ok{inside}"))), keys, "_ok", chunk=chunk)
    ends = (d.where("_ok").groupBy(*keys, "_gap").agg(F.expr("(max(i) - min(i)) * max(ds)").alias("_len"))
            .where(f"_len >= {min_px}").drop("_len").withColumn("_keep", F.lit(True)))
    return (d.join(ends, [*keys, "_gap"], "left").withColumn(out, F.expr("_ok and coalesce(_keep, false)"))
            .drop("_raw", "_ok", "_gap", "_keep"))


def observable(df: DataFrame, out: str = "observable", cnr: float = T.CNR_OBSERVE, min_px: float = T.MIN_RUN_PX,
               bridge_px: float = T.BRIDGE_PX) -> DataFrame:
    return seen_mask(df, cnr, bridge_px, min_px, True, out)


def dont_care(df: DataFrame) -> DataFrame:
    """Flags observable and dont_care (seen at the permissive level in the frame, not observable)."""
    d = checkpointed(observable(df))
    d = seen_mask(d, T.CNR_VISIBLE, T.LAMBDA_PX, 0.5 * T.LAMBDA_PX, False, "_perm")
    return d.withColumn("dont_care", F.expr("_perm and in_frame and not observable")).drop("_perm")


def record_runs(rec: DataFrame, keys=("image_id", "a", "b"), gap: int = T.RECORD_BRIDGE) -> DataFrame:
    """Stretches of a that records (a, b, i, j) cover, gaps up to `gap` allowed: i0, i1 on a and j0, j1 on b."""
    # one row per position carries all the run needs
    d = rec.groupBy(*keys, "i").agg(F.min("j").alias("jlo"), F.max("j").alias("jhi"), F.count(F.lit(1)).alias("m"))
    d = groups_by_break(d.withColumn("_ck", F.expr(f"i div {CHUNK}")), keys, ["i"], "_ck",
                        {"_p": ("max", "i")}, f"_p is null or i - _p > {gap}")
    return d.groupBy(*keys, "_run").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("jlo").alias("j0"),
                                        F.max("jhi").alias("j1"), F.sum("m").alias("n")).drop("_run")


def _by_start(iv: DataFrame, keys) -> DataFrame:
    """Of the intervals starting at one position only the longest matters for chaining."""
    return iv.groupBy(*keys, "lo").agg(F.max("hi").alias("hi")).withColumn("_ck", F.expr(f"lo div {CHUNK}"))


def merge_intervals(iv: DataFrame, keys, margin: str = "0") -> DataFrame:
    """Intervals (lo, hi) closer than `margin` (an expression over the keys) become one."""
    d = groups_by_break(_by_start(iv, keys), keys, ["lo"], "_ck", {"_reach": ("max", "hi")},
                        f"_reach is null or lo > _reach + ({margin})")
    return d.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def chain_from_start(iv: DataFrame, keys, chain: int, start: int = 0) -> DataFrame:
    """How far intervals chain from `start`: each begins within `chain` of the reach so far. keys, reach."""
    d = groups_by_break(_by_start(iv, keys), keys, ["lo"], "_ck", {"_reach": ("max", "hi")},
                        f"lo > greatest(coalesce(_reach, {start}), {start}) + {chain}")
    return d.groupBy(*keys).agg(F.expr(f"greatest({start}, coalesce(max(case when _run = 0 then hi end), {start}))")
                                .alias("reach"))


def chain_around(iv: DataFrame, keys, anchors: DataFrame, chain) -> DataFrame:
    """The merged stretch around an anchor position (keys, anchor): the first one within `chain` (a number or an
    expression over the keys) of it."""
    m = merge_intervals(iv, keys, str(chain))
    return (m.join(anchors, list(keys)).where(f"lo - ({chain}) <= anchor and anchor <= hi + ({chain})")
            .groupBy(*keys, "anchor").agg(F.expr("min_by(hi, lo)").alias("hi"), F.min("lo").alias("lo")))


def interval_samples(iv: DataFrame, samples: DataFrame, keys, lo="lo", hi="hi") -> DataFrame:
    """Samples inside short intervals: positions are listed and joined on equality."""
    return at_positions(iv.withColumn("i", F.explode(F.expr(f"sequence({lo}, {hi})"))), samples, [*keys, "i"])


def clip_intervals(iv: DataFrame, samples: DataFrame, keys=EDGE, id_cols=("jid",)) -> DataFrame:
    """Clip [lo, hi] to the samples within `radius` of (cx, cy), or to the nearest sample when none is."""
    d = interval_samples(iv, samples, keys).withColumn("_d", F.expr("sqrt(power(x - cx, 2) + power(y - cy, 2))"))
    return d.groupBy(*keys, *id_cols, "lo", "hi").agg(
        F.expr("coalesce(min(case when _d <= radius then i end), min_by(i, struct(_d, i)))").alias("lo2"),
        F.expr("coalesce(max(case when _d <= radius then i end), min_by(i, struct(_d, i)))").alias("hi2"))


def share_out(claims: DataFrame, keys, claim_cols, anchor: str, order) -> DataFrame:
    """One-dimensional share-out of overlapping claims (lo, hi): every position goes to the claim with the nearest
    anchor, the first in `order` on ties. keys, i, owner (struct of claim_cols)."""
    own_ = f"struct({', '.join(claim_cols)})"
    best = f"struct(abs(i - ({anchor})) as d, {', '.join(order)})"
    return (claims.withColumn("i", F.explode(F.expr("sequence(lo, hi)")))
            .groupBy(*keys, "i").agg(F.expr(f"min_by({own_}, {best})").alias("owner")))


def owner_runs(owned: DataFrame, keys) -> DataFrame:
    """Stretches of consecutive positions with one owner: keys, lo, hi, owner."""
    d = owned.withColumn("_ck", F.expr(f"i div {CHUNK}"))
    d = groups_by_break(d, keys, ["i"], "_ck", {"_p": ("max", "i"), "_o": ("last", "owner")},
                        "_p is null or i > _p + 1 or _o <> owner")
    return d.groupBy(*keys, "_run").agg(F.min("i").alias("lo"), F.max("i").alias("hi"),
                                        F.first("owner").alias("owner")).drop("_run")


#: Positions and claims that one vectorised step of the sweep handles at once.
SWEEP = 1 << 21


def _envelope(part, keys, order):
    """Of claims (pandas) sorted by keys and chunk: for every stretch of positions the claim that holds it, as claims again."""
    if not len(part):
        return part
    part = part.reset_index(drop=True)
    lo, hi, anchor = (part[c].to_numpy() for c in ("lo", "hi", "_an"))
    rank = np.empty(len(part), np.int64)
    rank[np.lexsort([part[c].to_numpy() for c in reversed(order)])] = np.arange(len(part))
    row = np.empty_like(rank)
    row[rank] = np.arange(len(part))
    new = np.concatenate([[True], (part[keys].to_numpy()[1:] != part[keys].to_numpy()[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    start = np.minimum.reduceat(lo, first)
    span = np.maximum.reduceat(hi, first) - start + 1
    base = np.concatenate([[0], np.cumsum(span)])
    if base[-1] > SWEEP and len(first) > 1:
        half = first[len(first) // 2]
        return pd.concat([_envelope(part[:half], keys, order), _envelope(part[half:], keys, order)])
    group = np.cumsum(new) - 1
    best = np.full(base[-1], np.iinfo(np.int64).max)
    size = hi - lo + 1
    cuts = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(part):
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + SWEEP)))
        b = min(b, len(part))
        n = size[a:b]
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
        np.minimum.at(best, i + np.repeat((base[group] - start[group])[a:b], n),
                      np.abs(i - np.repeat(anchor[a:b], n)) * len(part) + np.repeat(rank[a:b], n))
        a = b
    own_ = np.where(best == np.iinfo(np.int64).max, -1, best % len(part))
    edge = np.concatenate([[True], own_[1:] != own_[:-1]])
    edge[base[:-1]] = True
    at = np.flatnonzero(edge)
    end = np.concatenate([at[1:], [len(own_)]]) - 1
    held = own_[at] >= 0
    at, end = at[held], end[held]
    out = part.take(row[own_[at]])
    shift = (start - base[:-1])[np.searchsorted(base, at, "right") - 1]
    return out.assign(lo=at + shift, hi=end + shift)


def share_runs(claims: DataFrame, keys, claim_cols, anchor: str, order, owner: str | None = None) -> DataFrame:
    """One-dimensional share-out of overlapping claims (lo, hi; whole numbers): every position goes to the claim with the nearest
    anchor (a whole number, less than 2^40 away), the first in `order` (numbers) on ties. Returns the stretches of
    consecutive positions with one owner: keys, lo, hi, owner (struct of claim_cols, or the expression `owner` over them).

    Equals owner_runs of share_out without a row per position: claims are cut at chunks of positions and only the stretches that
    a claim holds leave the sweep of a chunk. Crowded chunks are swept within each map task before the shuffle, and after it
    batch by batch, with no more than one stretch per position of the chunk carried along. Keys are not null. No claims give
    no stretches."""
    by = [*keys, "_ck"]
    ties = [f"_o{k}" for k in range(len(order))]
    d = claims.selectExpr(*keys, *[f"{c} as _c{k}" for k, c in enumerate(claim_cols)], f"cast({anchor} as long) as _an",
                          *[f"cast({o} as long) as {t}" for o, t in zip(order, ties)], "cast(lo as long) as lo", "cast(hi as long) as hi",
                          f"explode(sequence(cast(floor(lo / {CHUNK}) as long), cast(floor(hi / {CHUNK}) as long))) as _ck").withColumns(
        {"lo": F.expr(f"greatest(lo, _ck * {CHUNK})"), "hi": F.expr(f"least(hi, _ck * {CHUNK} + {CHUNK - 1})")})

    def before(batches):
        for b in batches:
            n = len(b[by].drop_duplicates())
            yield _envelope(b.sort_values(by), by, ties) if len(b) > 64 * n else b

    def after(batches):
        left = None
        for b in batches:
            b = b if left is None else pd.concat([left, b], ignore_index=True)
            if not len(b):
                continue
            last = (b[by] == b[by].iloc[-1]).all(axis=1).to_numpy()
            left = _envelope(b[last], by, ties)  # its other claims may come in the next batch
            yield _envelope(b[~last], by, ties)
        if left is not None:
            yield left
    pieces = (d.mapInPandas(before, d.schema).repartition(*by).sortWithinPartitions(*by).mapInPandas(after, d.schema)
              .withColumn("owner", F.struct(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(claim_cols)])))
    # read several times below: written, so that the sweep runs once
    pieces = checkpointed(pieces.select(*keys, "_ck", "lo", "hi", F.expr(owner or "owner").alias("owner")))
    r = groups_by_break(pieces, keys, ["lo"], "_ck", {"_p": ("max", "hi"), "_o": ("last", "owner")},
                        "_p is null or lo > _p + 1 or _o <> owner")
    return r.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("owner").alias("owner")).drop("_run")


def neighbours(runs: DataFrame, keys, lo="lo", hi="hi", owner="owner") -> DataFrame:
    """Disjoint runs with the end and owner of the one before and the start and owner of the one after."""
    d = runs.withColumn("_ck", F.expr(f"{lo} div {CHUNK}"))
    d = running(d, keys, [lo], "_ck", {"_b": ("last", f"struct({hi}, {owner})"),
                                       "_a": ("last", f"struct({lo}, {owner})", "back")}, exclusive=("_b", "_a"))
    return d.selectExpr(*runs.columns, f"_b.{hi} as prev_hi", f"_b.{owner} as prev_owner", f"_a.{lo} as next_lo",
                        f"_a.{owner} as next_owner")


def claim_limits(runs: DataFrame, keys, last: str, jid: str) -> DataFrame:
    """How far the arms of a claimed run may go: half way to the neighbouring run, or the run's own end, linked,
    where the neighbour starts right there."""
    n = neighbours(checkpointed(runs), keys)
    return n.selectExpr(
        *runs.columns,
        "case when prev_hi is null then 0L when prev_hi = lo - 1 then lo else (prev_hi + lo + 1) div 2 end as in_lim",
        f"case when prev_hi = lo - 1 and prev_owner.{jid} <> owner.{jid} then prev_owner.{jid} end as in_link",
        f"case when next_lo is null then {last} when next_lo = hi + 1 then hi else (hi + next_lo) div 2 end as out_lim",
        f"case when next_lo = hi + 1 and next_owner.{jid} <> owner.{jid} then next_owner.{jid} end as out_link")


def arm_points(limits: DataFrame, margin: str, last: str) -> DataFrame:
    """Where the two arms of a claimed run are measured: a margin beyond it, not past the limits, never both at one
    sample; crowded where less than half the margin is left."""
    d = limits.withColumn("_m", F.expr(margin)).selectExpr(
        "*", "case when in_link is not null then lo else greatest(lo - _m, in_lim, 0L) end as _i",
        f"case when out_link is not null then hi else least(hi + _m, out_lim, {last}) end as _o")
    return d.selectExpr(
        *limits.columns, "case when _i >= _o then greatest(lo - 1, 0L) else _i end as in_at",
        f"case when _i >= _o then least(hi + 1, {last}) else _o end as out_at",
        "lo - _i < 0.5D * _m and _i > 0 as in_crowded", f"_o - hi < 0.5D * _m and _o < {last} as out_crowded")


def join_owner_gaps(runs: DataFrame, keys, gap_max: str) -> DataFrame:
    """Runs of one owner with less than gap_max free positions between them become one."""
    d = runs.withColumn("_ck", F.expr(f"lo div {CHUNK}"))
    d = groups_by_break(d, keys, ["lo"], "_ck", {"_p": ("last", "struct(hi, owner)")},
                        f"_p is null or _p.owner <> owner or lo - _p.hi - 1 >= {gap_max}")
    return d.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                        F.first("owner").alias("owner")).drop("_run")


def give_back(runs: DataFrame, keys, far: str, in_turn: bool = False) -> DataFrame:
    """A-B-A without gaps: the piece of A farther from A (`far`, an expression over a run's own columns) goes to B.
    Only the first of overlapping triples is treated; call again until nothing changes. With `in_turn`, triples that share
    their outer piece wait for each other too, so that repeated calls end as one triple after the other would."""
    runs = checkpointed(runs)
    n = neighbours(runs.withColumn("_far", F.expr(far)).withColumn("_info", F.expr("struct(owner, _far, lo, hi)")),
                   keys, owner="_info")
    mid = checkpointed(n.where("prev_hi = lo - 1 and next_lo = hi + 1 and prev_owner.owner = next_owner.owner "
                               "and prev_owner.owner <> owner"))
    # a triple whose first piece is the middle (or, in turn, the last) of another one waits
    busy = mid.select(*keys, F.col("lo").alias("_first"))
    if in_turn:
        busy = busy.unionByName(mid.selectExpr(*keys, "hi + 1 as _first"))
    mid = mid.withColumn("_first", F.col("prev_owner.lo")).join(busy, [*keys, "_first"], "left_anti")
    taken = mid.selectExpr(*keys, "case when prev_owner._far > next_owner._far then prev_owner.lo "
                           "else next_owner.lo end as lo", "owner as new_owner")
    d = runs.join(taken, [*keys, "lo"], "left").withColumn("owner", F.expr("coalesce(new_owner, owner)"))
    return join_owner_gaps(checkpointed(d.drop("new_owner")), keys, "1")


def end_causes(df: DataFrame, flag: str, ahead: int, reasons: dict, keys=EDGE) -> DataFrame:
    """For every end of a run of `flag`: the first reason met within `ahead` samples beyond it, 'node' where the
    edge itself ends first, else 'fade'. reasons: {name: condition} by precedence; conditions under 'here:<name>'
    are tested on the run's own last sample."""
    from pyspark.sql import Window
    case = "case " + " ".join(f"when {c} then '{n}'" for n, c in reasons.items() if not n.startswith("here:")) + " end"
    here = "case " + " ".join(f"when {c} then '{n[5:]}'" for n, c in reasons.items() if n.startswith("here:")) + " end"
    if here == "case  end":
        here = "cast(null as string)"
    d = halo(checkpointed(df).withColumn("_why", F.expr(case)).withColumn("_here", F.expr(here)), ahead + 1)
    w = Window.partitionBy(*keys, "_c").orderBy("i")
    for side, lo, hi, step in (("start", -ahead, -1, F.lag), ("end", 1, ahead, F.lead)):
        f = w.rowsBetween(lo, hi)
        pick = F.first if side == "end" else F.last
        d = d.withColumn(f"_{side}_flag", step(F.expr(flag), 1).over(w))
        d = d.withColumn(f"_{side}", F.coalesce(F.col("_here"), pick("_why", ignorenulls=True).over(f),
                                                F.when(F.count(F.lit(1)).over(f) < ahead, "node"), F.lit("fade")))
    d = own(d).where(flag)
    ends = [d.where(f"not coalesce(_{s}_flag, false)").selectExpr(*keys, "i", f"'{s}' as side", f"_{s} as cause")
            for s in ("start", "end")]
    return ends[0].unionByName(ends[1])


def longest(df: DataFrame, flag: str, length: str = "1", keys=EDGE) -> DataFrame:
    """Longest total length of consecutive qualifying pieces per edge (0 where none)."""
    d = with_stretch(df, keys, flag)
    per = d.groupBy(*keys, "_gap").agg(F.expr(f"sum(case when {flag} then {length} else 0 end)").alias("_l"))
    return per.groupBy(*keys).agg(F.max("_l").alias("longest"))


def ahead_run(arms: DataFrame, df: DataFrame, ok: str, gap: int, cap: int, keys=EDGE) -> DataFrame:
    """Visible run beyond an arm at (keys, i) in direction `sgn`: up to `cap` samples, gaps bridged."""
    d = bridge(df.withColumn("_raw", F.expr(ok)), "_raw", gap, keys, out="_ok", keep=True)
    d = d.withColumn("_ck", F.expr(f"i div {CHUNK}"))
    no = "case when not _ok then i end"
    d = checkpointed(running(d, keys, ["i"], "_ck", {"_s": ("max", no), "_e": ("min", no, "back")}, cut=True)
                     .join(df.groupBy(*keys).agg(F.max("i").alias("_last")), list(keys)))
    at = d.where("_raw").selectExpr(*keys, "i", "coalesce(_s + 1, 0) as _s", "coalesce(_e - 1, _last) as _e")
    a = arms.join(at, [*keys, "i"], "left").withColumn("_to", F.expr(
        f"case when _s is null then null when sgn > 0 then least(_e, i + {cap}) else greatest(_s, i - {cap}) end"))
    far = d.selectExpr(*keys, "i as _to", "_prev", "_next")
    return a.join(far, [*keys, "_to"], "left").withColumn("run", F.expr(
        "case when _to is null then 0L when sgn > 0 then _prev - i else i - _next end")).drop(
        "_s", "_e", "_to", "_prev", "_next")


def window_medians(arms: DataFrame, df: DataFrame, n: int, cols: dict, cond: str = "true", keys=EDGE,
                   ids=("arm",)) -> DataFrame:
    """Medians over the n + 1 samples from an arm outward (`sgn` its direction); NULLs ignored."""
    d = (arms.withColumn("_k", F.explode(F.expr(f"sequence(0, {n})"))).withColumn("i", F.expr("i + sgn * _k"))
         .join(df, [*keys, "i"]).where(cond))
    return d.groupBy(*ids).agg(*[F.expr(f"percentile({e}, 0.5D)").alias(c) for c, e in cols.items()])


__all__ = [n for n in dir() if not n.startswith("_")] + ["islands"]

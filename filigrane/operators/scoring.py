"""An annotation or a fit against the truth."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.operators.grid import near_positions
from filigrane.operators.relate import match_in_order, within_radius
from filigrane.session import checkpointed


def centreline_score(samples: DataFrame, traced: DataFrame, tol: float = 3.0) -> DataFrame:
    """Recall, precision and F1 of traced points per image. samples carry observable and dont_care; traced points in
    don't-care stretches count neither way."""
    truth = samples.where("observable").select("image_id", "x", "y")
    rec = near_positions(truth, traced, tol, dense=True).groupBy("image_id").agg(
        F.avg(F.expr("cast(hit as double)")).alias("recall"), F.count(F.lit(1)).alias("n_truth"))
    t = near_positions(traced, truth, tol, flag="ok")
    t = near_positions(t, samples.where("dont_care").select("image_id", "x", "y"), tol, flag="dc")
    pre = t.groupBy("image_id").agg(F.expr("avg(case when ok or not dc then cast(ok as double) end)").alias("precision"),
                                    F.count(F.lit(1)).alias("n_traced"))
    return rec.join(pre, "image_id", "full").withColumn("f1", F.expr(
        "case when recall + precision > 0 then 2 * recall * precision / (recall + precision) else 0.0D end"))


def junction_score(truth: DataFrame, traced: DataFrame, ignore: DataFrame, tol: float = T.LAMBDA_PX) -> DataFrame:
    """Matches in the traced order, then recall, precision, F1, type accuracy and false positives per image. Traced
    junctions near an ignored one are no false positives."""
    c = within_radius(traced, truth, tol)
    c = c.selectExpr("image_id", "a_tj as tj", "b_jid as jid", "a_tj as ord",
                     "sqrt((a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)) as d")
    m = match_in_order(c, "tj", "jid", "d", "ord")
    t = (traced.join(m, ["image_id", "tj"], "left")
         .join(truth.selectExpr("image_id", "jid", "type as true_type"), ["image_id", "jid"], "left"))
    ig = (within_radius(traced, ignore, tol)
          .selectExpr("image_id", "a_tj as tj").distinct().withColumn("ign", F.lit(True)))
    t = t.join(ig, ["image_id", "tj"], "left")
    s = t.groupBy("image_id").agg(
        F.count("jid").alias("matched"), F.count(F.lit(1)).alias("n_traced"),
        F.expr("count_if(jid is null and ign is null)").alias("fp"),
        F.expr("count_if(type = true_type)").alias("type_ok"))
    n = truth.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_truth"))
    return (n.join(s, "image_id", "full").na.fill(0, ["matched", "fp", "type_ok", "n_truth", "n_traced"])
            .withColumn("recall", F.expr("case when n_truth > 0 then matched / n_truth end"))
            .withColumn("precision", F.expr("case when matched + fp > 0 then matched / (matched + fp) end"))
            .withColumn("type_accuracy", F.expr("case when matched > 0 then type_ok / matched end"))
            .withColumn("f1", F.expr("case when recall + precision > 0 then 2 * recall * precision "
                                     "/ (recall + precision) else 0.0D end")))


def fit_score(samples: DataFrame, fitted: DataFrame, tol: float = 3.0) -> DataFrame:
    """Share of in-frame samples near the fit per visibility level, per edge and overall, per image."""
    d = near_positions(samples.where("in_frame"), fitted, tol, dense=True).withColumn("level", F.expr(
        "case when observable then 'observable' when dont_care then 'dont_care' else 'invisible' end"))
    one = d.selectExpr("image_id", "vid", "level", "cast(hit as double) as hit")
    # a plain sum by the finest grouping first: the three groupings share it
    fine = checkpointed(one.groupBy("image_id", "level", "vid").agg(F.sum("hit").alias("h"),
                                                                    F.count(F.lit(1)).alias("n")))
    out = None
    for cols in (["level"], ["vid"], []):
        g = fine.groupBy("image_id", *cols).agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
        g = g.selectExpr("image_id", "level" if "level" in cols else "cast(null as string) as level",
                         "vid" if "vid" in cols else "cast(null as bigint) as vid", "n", "h / n as recall")
        out = g if out is None else out.unionByName(g)
    return out


def share_by_cnr(hits: DataFrame, bins=T.CNR_BINS) -> DataFrame:
    """Share of samples traced per CNR bin [b, b')."""
    arr = ", ".join(f"{float(b)!r}D" for b in bins)
    d = hits.withColumn("bin", F.expr(f"size(filter(array({arr}), e -> cnr >= e)) - 1L"))
    return d.where(f"bin between 0 and {len(bins) - 2}").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.expr("avg(cast(hit as double))").alias("share"))


def cnr_at_half(hits: DataFrame, rounds: int = 50, tol: float = 1e-8):
    """CNR where half is traced: logistic regression in log CNR by Newton steps. A step is one aggregation of five
    sums; only those come to the driver. None where undefined."""
    d = checkpointed(hits.selectExpr("ln(greatest(cnr, 1e-3D)) as lx", "cast(hit as double) as t"))
    some = d.agg(F.max("t"), F.min("t")).first()
    if some[0] is None or some[0] == some[1]:
        return None
    a, b = 0.0, 1.0
    for _ in range(rounds):
        p = f"(1 / (1 + exp(-({a!r}D + {b!r}D * lx))))"
        w = f"greatest({p} * (1 - {p}), 1e-9D)"
        g0, g1, h00, h01, h11 = d.selectExpr(
            f"sum(t - {p})", f"sum((t - {p}) * lx)", f"sum({w})", f"sum({w} * lx)", f"sum({w} * lx * lx)").first()
        h00, h11 = h00 + 1e-9, h11 + 1e-9
        det = h00 * h11 - h01 * h01
        sa, sb = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + sa, b + sb
        if max(abs(sa), abs(sb)) < tol:
            break
    else:
        raise ArithmeticError(f"no convergence in {rounds} steps: traced and untraced samples can be told apart by CNR")
    return math.exp(-a / b) if b > 0 else None

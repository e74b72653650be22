"""Features of language-model logits in long form: a row for each position, then one for each sequence.

Positions carry seq_id, pos, logits (what the model said there), token (the id there) and attended. The logits of
position p tell of the token at p + 1, so the last position has no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import logits as lg

#: Decision thresholds of the two-model score.
ACCURACY_THRESHOLD, LOW_FPR_THRESHOLD = 0.9015310749276843, 0.8536432310785527
EPSILON = 1e-8
SUMMARY = "mean_logprob std_logprob p10_logprob p50_logprob p90_logprob mean_entropy mean_top1_prob frac_top1_gt_0p8 mean_top1_margin frac_true_in_top10".split()


def with_next(positions: DataFrame) -> DataFrame:
    """Each position with the token and the mask of the next one, which the last has not."""
    after = Window.partitionBy("seq_id").orderBy("pos")
    return positions.withColumns({"label": F.lead("token").over(after), "label_attended": F.lead("attended").over(after)})


def shifted(positions: DataFrame) -> DataFrame:
    """Positions with the token and the mask of the next one; the last goes."""
    return with_next(positions).filter("label is not null")


def token_statistics(labelled: DataFrame) -> DataFrame:
    """Log-probability, entropy, top probability and margin, and rank test of each labelled position."""
    x, y = F.col("logits"), F.col("label")
    with_z = labelled.withColumn("logits", F.transform("logits", lambda v: v.cast("double"))).withColumn("log_z", lg.log_partition(x))
    z = F.col("log_z")
    return with_z.withColumns({"logprob": lg.true_log_prob(x, y, z), "entropy": lg.token_entropy(x, z), "top1_prob": lg.top1_prob(x, z), "top1_margin": lg.top1_margin(x), "in_top10": lg.in_top(x, y, 10)})


def summarize_logits(positions: DataFrame) -> DataFrame:
    """seq_id and the eleven features: means, deviation and quantiles over attended labels.

    Sequences under three tokens have zeros and their true length.
    """
    ok = F.col("label_attended")
    on = lambda c: F.when(ok, F.col(c))
    tokens = token_statistics(with_next(positions))  # the last position only counts
    rows = tokens.groupBy("seq_id").agg(
        F.avg(on("logprob")).alias("mean_logprob"),
        F.stddev_pop(on("logprob")).alias("std_logprob"),
        F.percentile(on("logprob"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"),
        F.avg(on("entropy")).alias("mean_entropy"),
        F.avg(on("top1_prob")).alias("mean_top1_prob"),
        F.avg(F.when(ok, (F.col("top1_prob") > 0.8).cast("double"))).alias("frac_top1_gt_0p8"),
        F.avg(on("top1_margin")).alias("mean_top1_margin"),
        F.avg(F.when(ok, F.col("in_top10").cast("double"))).alias("frac_true_in_top10"),
        F.count(on("logprob")).alias("_labels"),
        F.count("*").alias("_n"),
    )
    quantiles = {f"p{p}_logprob": F.get("_q", F.lit(i)) for i, p in enumerate((10, 50, 90))}
    short = F.col("_n") < 3
    names = [F.when(short, F.lit(0.0)).otherwise(F.coalesce(n, F.lit(0.0))).alias(n) for n in SUMMARY]
    return rows.withColumns(quantiles).select("seq_id", *names, F.when(short, F.col("_n")).otherwise(F.col("_labels") + 1).cast("int").alias("n_tokens"))


def two_model_scores(positions: DataFrame, pad_token_id: int, mode: str = "low-fpr", temperature: float = 1.0) -> DataFrame:
    """Mean NLL of observer and performer, their cross-entropy, and both ratios, for each sequence.

    Positions carry observer and performer logits. NLL is masked by attention, cross-entropy by the padding id.
    """
    wide = shifted(positions).withColumns({"observer": lg.scaled(F.col("observer"), temperature), "performer": lg.scaled(F.col("performer"), temperature)})
    wide = wide.withColumns({"oz": lg.log_partition(F.col("observer")), "pz": lg.log_partition(F.col("performer"))})
    each = wide.withColumns({
        "o_nll": -lg.true_log_prob(F.col("observer"), F.col("label"), F.col("oz")),
        "p_nll": -lg.true_log_prob(F.col("performer"), F.col("label"), F.col("pz")),
        "x": lg.cross_entropy(F.col("observer"), F.col("performer"), F.col("oz"), F.col("pz")),
        "m": F.col("label_attended"),
        "k": F.col("label") != pad_token_id,
    })
    mean = lambda v, m: F.sum(F.when(F.col(m), F.col(v)).otherwise(0.0)) / F.greatest(F.sum(F.col(m).cast("int")), F.lit(1))
    sums = each.groupBy("seq_id").agg(mean("o_nll", "m").alias("obs_ppl_nll_mean"), mean("p_nll", "m").alias("perf_ppl_nll_mean"), mean("x", "k").alias("xent_mean"))
    ratio = lambda c: F.col(c) / (F.col("xent_mean") + EPSILON)
    threshold = LOW_FPR_THRESHOLD if mode == "low-fpr" else ACCURACY_THRESHOLD
    return sums.select("seq_id", ratio("obs_ppl_nll_mean").alias("score_obs_raw"), ratio("perf_ppl_nll_mean").alias("score_perf_raw"), "obs_ppl_nll_mean", "perf_ppl_nll_mean", "xent_mean", F.lit(threshold).alias("threshold"))

"""Next-hop models from counts, probabilities, masks and pruning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoptrail.operators.windows import numbered
from hoptrail.written import materialize

#: Blocks that magnitudes are counted in, and the distinct ones that one task may sort.
BLOCKS, FEW = 65_536, 10_000


def transitions(df: DataFrame, token: str, by: list[str], order: list[str]) -> DataFrame:
    """Each row with the token before it."""
    return df.withColumn("prev", F.lag(token).over(Window.partitionBy(*by).orderBy(*order)))


def fit_bigram(pairs: DataFrame, token: str, smoothing: float = 0.0, vocabulary_size: int = 0) -> DataFrame:
    """P(token | prev) with add-``smoothing``; counts are pre-aggregated, totals come from the counts."""
    counts = pairs.dropna(subset=["prev", token]).groupBy("prev", token).agg(F.count("*").alias("n"))
    total = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    return counts.join(total, "prev").withColumn("prob", (F.col("n") + smoothing) / (F.col("total") + smoothing * vocabulary_size))


def score_bigram(pairs: DataFrame, model: DataFrame, token: str) -> DataFrame:
    """Rows with ``dst_prob``: null without a previous token, 0 for steps the model has not seen."""
    found = pairs.join(model.select("prev", token, "prob"), ["prev", token], "left")
    return found.withColumn("dst_prob", F.when(F.col("prev").isNull(), None).otherwise(F.coalesce("prob", F.lit(0.0)))).drop("prob")


def probability_at(probabilities: Column, index: Column) -> Column:
    """Element by an index from 0; out of range gives 0."""
    return F.coalesce(F.when(index >= 0, F.get(probabilities, index.cast("int"))), F.lit(0.0))


def argmax(values: Column) -> Column:
    """Index, from 0, of the first greatest element."""
    return F.array_position(values, F.array_max(values)) - 1


def token_name(name: Column, index: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("<id:"), index.cast("string"), F.lit(">")))


def loss_weights(transition_valid: Column, control_valid: Column, target_valid: Column) -> dict[str, Column]:
    """Weights of the two heads: whether each row may teach them."""
    t, c, d = (x.cast("bigint") for x in (transition_valid, control_valid, target_valid))
    return {"ctrl_weight": t * c, "dst_weight": t * c * d}


def weighted_loss(df: DataFrame, prob: str, weight: str, by: list[str], floor: float = 1e-7) -> DataFrame:
    """Mean cross entropy over weighted rows."""
    return df.groupBy(*by).agg((F.sum(-F.log(F.greatest(F.col(prob), F.lit(floor))) * F.col(weight)) / F.sum(weight)).alias("loss"))


def near_kth(weights: DataFrame, value: str, share: float) -> tuple[DataFrame, int, int]:
    """At most ``FEW`` distinct magnitudes m with counts c, the k-th smallest among them; how many are smaller; and k.

    Equal magnitudes are counted first. Blocks of magnitude are counted, and the
    block that holds the k-th value is cut into blocks again until its distinct
    values are few; its least and greatest value never share a block.
    """
    left = materialize(weights.filter(F.col(value).isNotNull()).groupBy(F.abs(F.col(value)).alias("m")).agg(F.count("*").alias("c")), "magnitudes")
    m = F.col("m").cast("double")
    finite = F.when(m < float("inf"), m)
    total = left.agg(F.sum("c")).first()[0] or 0
    k, before = math.floor(total * share), 0
    if not 0 < k <= total:
        return left.limit(0), before, k
    while True:
        n, low, high = left.agg(F.count("*"), F.min(finite), F.max(finite)).first()
        if n <= FEW:
            return left, before, k
        block = F.when(F.isnan(m), BLOCKS + 1).when(m == float("inf"), BLOCKS).otherwise(F.least(F.floor((m - low) / (high - low) * BLOCKS), F.lit(BLOCKS - 1))).cast("int")
        seen = 0
        for b, c in sorted((r[0], r[1]) for r in left.groupBy(block.alias("b")).agg(F.sum("c")).collect()):
            if seen + c >= k - before:
                break
            seen += c
        left, before = materialize(left.filter(block == b), "magnitudes"), before + seen


def kth_magnitude(weights: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the k-th smallest magnitude, k = share of all, and k. None if k is 0 or above the number of values."""
    few, before, k = near_kth(weights, value, share)
    ranked = few.withColumn("_to", F.sum("c").over(Window.orderBy("m")) + before)  # at most FEW rows
    return ranked.filter((F.col("_to") >= k) & (F.col("_to") - F.col("c") < k)).select(F.col("m").alias("threshold"), F.lit(k).cast("bigint").alias("k"))


def scheduled_sparsity(initial: float, final: float, progress: Column) -> Column:
    """From ``initial`` to ``final`` by a cubic of the progress, which is held within 0 and 1."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))
    return F.lit(final) + F.lit(initial - final) * F.pow(1 - p, F.lit(3.0))


def prunable(tensors: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Tensors (name, shape, dtype) that pruning may touch: of two dimensions at least, floating, with no excluded part in the name."""
    named = F.lower("name")
    kept = (F.size("shape") >= 2) & F.col("dtype").rlike("^b?float")
    for part in exclude:
        kept = kept & ~named.contains(part)
    return tensors.filter(kept)


def sparsity_stats(weights: DataFrame, value: str, tensor: str = "tensor") -> DataFrame:
    """One row: tensors, parameters, zeros among them, and their share."""
    out = weights.agg(F.count_distinct(tensor).alias("tensors"), F.count("*").alias("parameters"), F.count_if(F.col(value) == 0).alias("zero_parameters"))
    return out.withColumn("sparsity", F.when(F.col("parameters") > 0, F.col("zero_parameters") / F.col("parameters")).otherwise(0.0))


def prune(weights: DataFrame, value: str, sparsities: list[float], train: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights after steps of pruning by magnitude, and a row a step: target, threshold, parameters and zeros.

    A step keeps what is above the k-th smallest magnitude of all weights, those masked before
    among them as zeros. Between steps ``train`` may move weights; masked ones stay zero, whatever it gives them.
    """
    kept = materialize(weights.withColumn("_keep", F.lit(True)), "weights")
    rows = []
    for step, target in enumerate(sparsities):
        if train is not None and step:
            kept = materialize(train(kept, step).withColumn(value, F.when(F.col("_keep"), F.col(value)).otherwise(F.lit(0.0))), "trained")
        cut = kth_magnitude(kept.select(value), value, target).first() if target > 0 else None
        above = F.abs(value) > F.lit(cut.threshold) if cut else F.lit(True)
        kept = materialize(kept.withColumn("_keep", above).withColumn(value, F.when(above, F.col(value)).otherwise(F.lit(0.0))), "pruned")
        n = kept.agg(F.count("*").alias("n"), F.count_if(~F.col("_keep")).alias("z")).first()
        rows.append((step, float(target), float(cut.threshold) if cut else None, n.n, n.z))
    stats = weights.sparkSession.createDataFrame(rows, "step int, target double, threshold double, parameters long, zeros long")
    return kept.drop("_keep"), stats


def full_batches(rows: DataFrame, order: list, batch: int, piece: int, limit: int) -> DataFrame:
    """``rows`` in pieces of exactly ``piece`` rows, cut from batches of ``batch``, until ``limit`` rows are reached.

    A batch's rest that fills no piece is left out, as is a short last batch's; rows get ``piece_no`` and ``place``.
    """
    placed = numbered(rows, order, "_n").withColumn("_n", F.col("_n") - 1)
    total = placed.agg(F.count("*")).first()[0]
    of = F.floor(F.col("_n") / batch)
    inside = F.col("_n") - of * batch
    own = F.floor(inside / piece)
    whole = (own + 1) * piece <= F.least(F.lit(batch), F.lit(total) - of * batch)
    number = of * (batch // piece) + own
    kept = placed.withColumns({"_whole": whole, "piece_no": number, "place": inside - own * piece}).filter(F.col("_whole") & (F.col("piece_no") < -(-limit // piece)))
    return kept.drop("_n", "_whole")

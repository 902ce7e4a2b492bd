"""Sources mixed at a temperature, realised as permuted blocks within token budgets.

A source with share p of the tokens gets weight p^a / sum(p^a). The exponent a between
0 (all alike) and 1 (as found) is bisected until the mix meets a target entropy or a
limit on repetition. The budget is the least that shows every document once, so the
weight of a source says how often its documents come up: whole epochs, then a part of
one more. In each epoch the documents of a source come in hash blocks, the blocks in
an order of that epoch's own, and in the last epoch until the budget is met.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import BROADCAST_ROWS, is_small, staged

MAX_REPEATS = 1.5
SEED = "mix"
#: Rounds of bisection: the exponent is a multiple of 2^-ROUNDS.
ROUNDS = 20
#: Each job halves the interval this many times, over a grid of its inner points.
HALVINGS = 4
#: A source has 16^BLOCK_DIGITS blocks.
BLOCK_DIGITS = 3


def tokens_of(text: Column) -> Column:
    """Number of runs of characters other than space, tab, newline, \\v, \\f and return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A key that keeps null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts))


def bisect_exponent(totals: DataFrame, max_repeats: float | None = None,
                    target_entropy: float | None = None) -> float:
    """Largest flattening that the limits allow: the least exponent that meets both.

    ``totals`` has ``source`` and positive ``tokens``. ``max_repeats`` limits how often a
    source is repeated when the source most reduced is shown once; ``target_entropy``
    (nats) limits the entropy of the weights from above. Both fall as the exponent rises,
    and an exponent of 1 is taken if none below will do.
    """
    bounds = totals.agg(F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not bounds[2]:
        return 1.0
    least, most, count = bounds
    ratio, total = most / least, None
    if target_entropy is not None:
        total = totals.agg(F.sum("tokens")).first()[0]

    low, high = 0.0, 1.0
    for _ in range(ROUNDS // HALVINGS):
        grid = [low + (high - low) * i / 2**HALVINGS for i in range(2**HALVINGS + 1)]
        entropies = _entropies(totals, total, grid) if total else [0.0] * len(grid)
        good = [i for i, a in enumerate(grid)
                if (max_repeats is None or math.pow(ratio, 1 - a) <= max_repeats)
                and (target_entropy is None or entropies[i] <= target_entropy)]
        first = good[0] if good else len(grid) - 1
        low, high = grid[max(first - 1, 0)], grid[first]
    return high


def _entropies(totals: DataFrame, total: int, grid: list[float]) -> list[float]:
    """Entropy of the weights at each exponent, in one pass; a row per exponent comes back."""
    share = F.col("tokens") / F.lit(float(total))
    at = totals.select(share.alias("p"), F.posexplode(F.array(*map(F.lit, grid))).alias("i", "a"))
    sums = at.groupBy("i").agg(F.sum(F.pow("p", "a")).alias("z"),
                               F.sum(F.pow("p", "a") * F.col("a") * F.ln("p")).alias("s"))
    rows = {r["i"]: math.log(r["z"]) - r["s"] / r["z"] for r in sums.collect()}
    return [rows[i] for i in range(len(grid))]


def plan_epochs(totals: DataFrame, exponent: float) -> DataFrame:
    """Per source: whole ``epochs`` and the ``budget`` in tokens of one more, in part."""
    most = totals.agg(F.max("tokens")).first()[0] or 1
    repeats = F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - exponent))
    epochs = F.floor(repeats)
    return totals.select(
        "source", F.col("tokens"), repeats.alias("repeats"), epochs.cast("int").alias("epochs"),
        F.floor((repeats - epochs) * F.col("tokens")).cast("long").alias("budget"))


def _cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source with a budget: the block and the document at which it is met.

    First the running total over a source's blocks, of which there is a fixed number,
    then over the documents of the one block in which the budget runs out.
    """
    blocks = sized.groupBy("source", "block", "block_key").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("source").orderBy("block_key")
    before = F.sum("tokens").over(order) - F.col("tokens")
    last = (blocks.withColumn("before", before)
            .join(plan.where("budget > 0").select("source", "budget"), "source")
            .where("before < budget")
            .groupBy("source").agg(
                F.max(F.struct("block_key", "block", (F.col("budget") - F.col("before"))
                               .alias("rest"))).alias("cut"))
            .select("source", "cut.block", "cut.block_key", "cut.rest"))
    last = staged(last)
    edge = F.broadcast(last) if is_small(last) else last
    within = (sized.join(edge.drop("block_key"), ["source", "block"])
              .groupBy("source", "rest", "doc_key").agg(F.sum("tokens").alias("tokens")))
    order = Window.partitionBy("source").orderBy("doc_key")
    before = F.sum("tokens").over(order) - F.col("tokens")
    taken = (within.withColumn("before", before).where("before < rest")
             .groupBy("source").agg(F.max("doc_key").alias("last_doc")))
    return last.join(taken, "source").select(
        "source", F.col("block_key").alias("last_block"), "last_doc")


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                source_column: str = "source", max_repeats: float | None = MAX_REPEATS,
                target_entropy: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its source's weight asks.

    Adds ``n_tokens``, ``epoch`` (from 0), ``block`` and ``order_key``: sorted by
    ``epoch`` and ``order_key`` the rows are the mix. Every row comes up at least once;
    the last, partial epoch of a source ends with the row that meets its budget, and
    rows with one id are taken together. A null source is a source of its own. Null and
    empty texts have no tokens: they come up in each whole epoch, and a source of only
    such rows once. A null id is ordered like the text "null". Input columns with the
    names of the added ones are replaced. An empty table gives an empty one.

    Only one row per source decides which rows repeat, broadcast if there are up to
    ``BROADCAST_ROWS`` sources.
    """
    docs = docs.drop("n_tokens", "epoch", "block", "order_key")
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    sized = staged(docs.select(
        _source_key(F.col(source_column)).alias("source"), key.alias("key"),
        tokens_of(F.col(text_column)).alias("tokens")))
    totals = staged(sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    plan = staged(plan_epochs(totals, bisect_exponent(totals, max_repeats, target_entropy)))

    def keys(rows: DataFrame, name: str, epoch: Column) -> DataFrame:
        block = F.substr(_hash(name), F.lit(1), F.lit(BLOCK_DIGITS))
        epoch = epoch.cast("string")
        return rows.withColumns({
            "block": block, "block_key": _hash(epoch, F.lit("block"), block),
            "doc_key": _hash(epoch, F.lit("row"), F.col(name))})

    cuts = _cuts(keys(sized.join(F.broadcast(plan.select("source", "epochs")) if is_small(plan)
                                 else plan.select("source", "epochs"), "source"),
                      "key", F.col("epochs")), plan)
    rule = plan.join(cuts, "source", "left").select(
        F.col("source").alias("_source"), F.col("epochs").alias("_epochs"), "last_block", "last_doc")
    rule = F.broadcast(rule) if is_small(rule, BROADCAST_ROWS) else rule
    # The input is carried as one struct, so its names can't clash with those used here.
    rows = docs.select(_source_key(F.col(source_column)).alias("mix_source"), key.alias("mix_key"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(rule, rows["mix_source"] == rule["_source"], "left").withColumn(
        "_epochs", F.coalesce("_epochs", F.lit(1)))
    # Whole epochs, and one more that only rows up to the cut are part of.
    rows = keys(rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs")))),
                "mix_key", F.col("epoch"))
    taken = ((F.col("epoch") < F.col("_epochs")) | (F.col("block_key") < F.col("last_block"))
             | ((F.col("block_key") == F.col("last_block")) & (F.col("doc_key") <= F.col("last_doc"))))
    row = F.col("row")
    return rows.where(F.coalesce(taken, F.lit(False))).select(
        *[row.getField(c).alias(c) for c in docs.columns],
        tokens_of(row.getField(text_column)).alias("n_tokens"),
        "epoch", "block", F.concat("block_key", "doc_key").alias("order_key"))

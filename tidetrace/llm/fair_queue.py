"""Mix sources to target weights by weighted fair queueing.

Every document of a source waits in that source's queue, in an order shuffled by a hash of its id. Its virtual finish time
is the number of the source's words up to and with it, divided by the source's target. All queues together, sorted by that
time and cut where the total budget is reached, are the mix: at any point of it the sources stand in proportion to their
targets. A source that is to give more words than it has queues again, up to ``passes`` times.

Only sums cross the cluster: a queue is cut into ranges of the shuffle hash, the mix into ranges of virtual time. Positions
inside a range come from a window over that range, those before it from the totals of the earlier ranges. No range holds
more than its share of a source or of the mix, whatever a source's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidetrace.llm.common import count_words, written

#: Rows of one range, about.
RANGE_ROWS = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.0, passes: int = 3) -> DataFrame:
    """Targets of sources: ``source, source_size, target, budget``, a row per source.

    ``sizes`` is (source, size). Sources in code point order, null last, take ``weights`` in turn and share ``budget`` times
    all words by weight; none gets more than ``passes`` times its size, and what that leaves over is shared again among the
    others. That is the level at which the targets, each the lesser of its cap and level x weight, add up to the budget: with
    sources sorted by cap / weight, all are capped up to the first whose cap is above the level.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, listed = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(listed) - 1) % len(weights) + 1
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("bigint"))
    total = total.withColumns(
        {
            "cap": F.col("source_size") * passes,
            "budget": F.floor(F.sum("source_size").over(every) * budget).cast("bigint"),
        }
    )
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumns(
        {
            "left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "share": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    above = F.when(F.col("cap") * F.col("share") > F.col("left") * F.col("weight"), F.struct("left", "share"))
    whole = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = total.withColumn("level", F.first(above, ignorenulls=True).over(whole))
    capped = F.col("level").isNull() | (F.col("cap") * F.col("level.share") <= F.col("level.left") * F.col("weight"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(
        F.col("level.left").cast("double") * F.col("weight") / F.col("level.share")
    )
    return total.select("source", "source_size", target.alias("target"), "budget")


def _with_start(df: DataFrame, keys: list[str], size: str, start: str) -> DataFrame:
    """Adds the sum of ``size`` over the rows with the same ``keys`` but the last, and a smaller last one: the earlier ranges."""
    sums = df.groupBy(*keys).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*(keys[:-1] or [F.lit(0)])).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(start, F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return df.join(sums, keys)


def queued(documents: DataFrame, weights: Sequence[int], budget: float, passes: int, seed: int) -> DataFrame:
    """All documents in all passes that can matter, with ``position``, the place of their last word in the endless mix."""
    kept = documents.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    # 48 bits that any engine can compute
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    kept = kept.withColumn("turn", F.conv(F.substring(hashed, 1, 12), 16, 10).cast("bigint"))
    kept = written(kept.withColumn("line", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "queue")
    targets = written(source_targets(kept, weights, budget, passes), "targets")
    rows = kept.count()

    # equal rows queue one behind the other: a row stands for all of them, however many
    queue = kept.groupBy("line", "turn", "doc_id", "source", "size").agg(F.count("*").alias("copies"))
    queue = queue.withColumn("words", F.col("size") * F.col("copies"))

    # the place in the source's queue
    ranges = rows // RANGE_ROWS + 1
    among = F.col("turn").cast("double") / (1 << 48)
    queue = _with_start(queue.withColumn("part", F.floor(among * ranges)), ["line", "part"], "words", "start")
    order = Window.partitionBy("line", "part").orderBy("turn", "doc_id", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = {"place": F.sum("copies").over(before), "upto": F.sum("words").over(before)}
    queue = queue.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in sums.items()})
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / RANGE_ROWS)))
    queue = queue.withColumn("block", block).repartition("line", "turn", "doc_id", "size", "block")
    low, high = F.col("block") * RANGE_ROWS + 1, F.least(F.col("copies"), (F.col("block") + 1) * RANGE_ROWS)
    queue = queue.withColumn("copy", F.explode(F.sequence(low, high)))
    queue = queue.withColumns(
        {"place": F.col("place") + F.col("copy"), "upto": F.col("start") + F.col("upto") + F.col("copy") * F.col("size")}
    ).drop("copies", "words", "block", "copy")
    targets = targets.withColumn("line", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    queue = queue.join(targets, "line")

    # a pass more than the target needs: what follows would be later still
    some = (F.col("target") > 0) & (F.col("size") > 0)
    turns = F.when(some, F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))) + 1).otherwise(1)
    queue = queue.withColumn("pass", F.explode(F.sequence(F.lit(1), F.least(F.lit(passes), turns).cast("int"))))
    reached = ((F.col("pass") - 1) * F.col("source_size") + F.col("upto")).cast("double")
    queue = queue.withColumn("finish", F.when(some, reached / F.col("target")).otherwise(F.lit(0.0)))

    # the place in the mix: up to time 1, ranges of equal width hold equal numbers of words; rows without any come before all
    # others, dealt to ranges of their own
    steps = 2 * rows // RANGE_ROWS + 1
    dealt = F.lit(-1) - F.pmod(F.xxhash64("line", "part", "place"), F.lit(ranges))
    at = F.floor(F.least(F.col("finish"), F.lit(passes + 1.0)) * steps)
    queue = queue.withColumn("step", F.when(some, at).otherwise(dealt))
    queue = _with_start(queue, ["step"], "size", "earlier")
    sort = Window.partitionBy("step").orderBy("finish", "line", "pass", "part", "place")
    upto = sort.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return queue.withColumn("position", F.col("earlier") + F.sum("size").over(upto))


def fair_queue(
    documents: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.0, passes: int = 3, seed: int = 7
) -> DataFrame:
    """The mix: ``doc_id, source, size, pass, finish, position``, a row for each time a document is taken.

    ``documents`` is (doc_id, source, size). The rows with ``position``, the place of the document's last word, up to the
    budget are the mix; sorted by it they are its order. Null sizes count as 0; documents without words add nothing and pass,
    once and first. A null source is a source of its own. Equal rows queue one behind the other. Ids, sizes and ``seed`` decide every order,
    so a rerun gives the same mix. Empty input gives an empty mix.
    """
    taken = queued(documents, weights, budget, passes, seed).where("position <= budget")
    return taken.select("doc_id", "source", "size", "pass", "finish", "position")


def mix(
    documents: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.0, passes: int = 3, seed: int = 7
) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``: the words the mix takes of it, repeats counted."""
    rows = queued(documents, weights, budget, passes, seed)
    taken = F.sum(F.when(F.col("position") <= F.col("budget"), F.col("size")).otherwise(0))
    same = ["doc_id", "size", "source_size", "target"]
    return rows.groupBy("line", "part", "place", *same).agg(taken.alias("taken")).select(*same, "taken")


def sized(documents: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size`` of documents with texts; the size is the number of words."""
    return documents.select("doc_id", F.col(source).alias("source"), count_words(text).alias("size"))

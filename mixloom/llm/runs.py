"""Runs of consecutive equal events, found by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.llm.events import events
from mixloom.session import cut


def _pieces(steps: DataFrame, dictionary: DataFrame, max_gap: int, block: int, piece: int) -> DataFrame:
    """The pieces of runs within ``piece`` steps: (seq_id, action, first, last, n, pointer, goes_on).

    ``pointer`` is the event before the piece that its first event continues, or null;
    ``goes_on`` tells pieces that another may point to."""
    ev = events(steps, dictionary, block=block, halo=max_gap)
    order = Window.partitionBy("seq_id", "block").orderBy("tstep_id")
    at = lambda c: F.floor(c / piece)
    ev = ev.withColumn("prev", F.lag(F.struct("tstep_id", "action", "own")).over(order)).withColumn("next", F.lead(F.struct("tstep_id", "action")).over(order))
    linked = F.coalesce((F.col("prev.action") == F.col("action")) & (F.col("tstep_id") - F.col("prev.tstep_id") <= max_gap), F.lit(False))
    # the last event of a block may be continued in the next one
    followed = F.col("next").isNull() | ((F.col("next.action") == F.col("action")) & (F.col("next.tstep_id") - F.col("tstep_id") <= max_gap))
    ev = ev.select("*", linked.alias("linked"), (followed & (F.col("next").isNull() | (at(F.col("next.tstep_id")) != at(F.col("tstep_id"))))).alias("goes_on")).where("own")
    opens = ~F.col("linked") | ~F.col("prev.own") | (at(F.col("prev.tstep_id")) != at(F.col("tstep_id")))
    ev = ev.withColumn("first", F.max(F.when(opens, F.col("tstep_id"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ev = ev.withColumn("pointer", F.when(opens & F.col("linked"), F.col("prev.tstep_id")))
    return ev.groupBy("seq_id", "block", "first").agg(
        F.min("action").alias("action"), F.max("tstep_id").alias("last"), F.count("*").alias("n"), F.max("pointer").alias("pointer"), F.max("goes_on").alias("goes_on")
    )


def run_starts(links: DataFrame) -> DataFrame:
    """Pointer doubling. ``links`` (seq_id, last, pointer, ...) point to the piece that ends at
    ``pointer``; returns them with ``pointer`` replaced by that of the run's first piece.

    Each round replaces pointers by the pointers of what they point to, so a run of m pieces
    takes about log2(m) self-joins. Each piece is pointed to by at most one other, so no
    join key repeats. Rounds end in the shared checkpoint folder.
    """
    links = cut(links)
    while True:
        to = links.select("seq_id", F.col("last").alias("pointer"), F.col("pointer").alias("_further"))
        links_next = cut(links.join(to, ["seq_id", "pointer"], "left"))
        if links_next.where("_further IS NOT NULL").limit(1).count() == 0:
            return links_next.drop("_further")
        links = links_next.withColumn("pointer", F.coalesce("_further", "pointer")).drop("_further")


def collapse_runs(steps: DataFrame, dictionary: DataFrame, *, max_gap: int = 5, block: int = 512, piece: int = 4) -> DataFrame:
    """Every run of consecutive events of one action as one row
    (seq_id, action_name, first_tstep_id, last_tstep_id, n_events, duration).

    A run is a longest stretch of events of one sequence, in ``tstep_id`` order, of one
    action, neighbours at most ``max_gap`` apart; ``duration`` is last minus first step.
    Single events are runs of one. What counts as an event, and how nulls, ties and repeated
    rows are treated, is said at ``events``. Empty tables give no rows; other columns are
    never read.

    Steps are placed in blocks of ``block`` steps with a halo of ``max_gap``, so no task holds
    a whole long sequence, and there each event learns the one before it. Linked events within
    ``piece`` steps are taken together before anything is joined (1: no two events are); every
    other link is a pointer from a piece to the last event of the piece before it, and
    pointer doubling (``run_starts``) finds the run's first piece for all of them.
    """
    if block <= max_gap:
        raise ValueError("block must be larger than max_gap")
    pieces = cut(_pieces(steps, dictionary, max_gap, block, piece))
    out = ["seq_id", "action", "first", "last", "n"]
    alone = pieces.where("pointer IS NULL AND NOT goes_on").select(*out)
    heads = pieces.where("pointer IS NULL AND goes_on").select("seq_id", F.col("last").alias("head"), "action", "first", "last", "n")
    tails = run_starts(pieces.where("pointer IS NOT NULL").select("seq_id", "last", "pointer", "action", "first", "n"))
    tails = tails.select("seq_id", F.col("pointer").alias("head"), "action", "first", "last", "n")
    across = heads.unionByName(tails).groupBy("seq_id", "head").agg(F.min("action").alias("action"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return alone.unionByName(across.select(*out)).select(
        "seq_id",
        F.col("action").alias("action_name"),
        F.col("first").alias("first_tstep_id"),
        F.col("last").alias("last_tstep_id"),
        F.col("n").cast("bigint").alias("n_events"),
        (F.col("last") - F.col("first")).cast("int").alias("duration"),
    )

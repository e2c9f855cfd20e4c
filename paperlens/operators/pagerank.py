"""PageRank on the co-author graph.

Ranks start at 1 and are replaced by ``reset + (1 - reset) * sum of shares received``, for a number of rounds or
until no rank moves by more than the tolerance; they are scaled to sum to the number of vertices. In the
second case rounds send changes only, and only those above the tolerance.

Ranks of authors that are counted to fit are broadcast, so links stay where their sums are formed and are not shuffled
in any round. Those of more authors are shuffled to links placed by the sender.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlens.operators import frames
from paperlens.operators.coauthors import coauthor_pairs, reachable_authors
from paperlens.session import checkpointed

RESET = 0.15
TOLERANCE = 0.01
_ROW_BYTES = 100  # a broadcast rank apart from its author
PART_LINKS = 2_000_000  # links of a part, aimed at


def _fits(authors: DataFrame) -> bool:
    """Whether ranks by ``auid`` can be broadcast."""
    letters = F.coalesce(F.sum(F.octet_length(F.col("auid").cast("string"))), F.lit(0))
    count, size = authors.agg(F.count("*"), letters).first()
    return count * _ROW_BYTES + size <= frames.BROADCAST_BYTES


def _sent(sent: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(sent) if fits else sent


def _placed(df: DataFrame, key: str, ordered: bool = False) -> DataFrame:
    """``df`` kept as every round needs it, ``ordered`` by ``key`` within its parts, so that rounds shuffle ranks or
    sums only. A part lost with its executor is dealt anew from the stored rows."""
    stored = checkpointed(df)
    # A part sends one sum for each of its authors, so parts are no more than the links ask for.
    partitions = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + stored.count() // PART_LINKS)
    partitions = max(partitions, df.sparkSession.sparkContext.defaultParallelism)
    placed = stored.repartition(partitions, key)
    placed = (placed.sortWithinPartitions(key) if ordered else placed).persist(StorageLevel.MEMORY_AND_DISK)
    placed.count()  # The partitioning is known to later plans once the rows are there.
    return placed


def _iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, block: int) -> DataFrame:
    """Apply ``step`` to (auid, rank) for ``rounds`` rounds; lineage is cut after ``block`` of them."""
    ranks, done = checkpointed(start), 0
    while done < rounds:
        count = min(block, rounds - done)
        for _ in range(count):
            ranks = step(ranks)
        ranks, done = checkpointed(ranks), done + count
    return ranks


def _settled(
    vertices: DataFrame, spread: Callable[[DataFrame], DataFrame], tolerance: float, reset: float
) -> tuple[DataFrame, list[int]]:
    """(auid, rank) once no rank has moved by more than ``tolerance`` since it was sent, and how many were sent
    in each round.

    ``spread`` turns amounts sent (auid, sent) into those received (auid, received). As that is linear, a round
    need not send ranks, only what they have changed by; those that have hardly moved wait, and their links
    are not read. It ends as each round shrinks what is sent by 1 - reset.
    """
    def after(state: DataFrame, sent: DataFrame, rank: Column, waiting: Column) -> DataFrame:
        gained = F.lit(1.0 - reset) * F.coalesce("received", F.lit(0.0))
        return checkpointed(state.join(spread(sent), "auid", "left").select(
            "auid", (rank + gained).alias("rank"), (waiting + gained).alias("waiting")))

    # The first round is that of ranks of 1.
    ones = vertices.select("auid", F.lit(1.0).alias("sent"))
    state, counts = after(vertices, ones, F.lit(reset), F.lit(reset - 1.0)), []
    while True:
        moved = F.abs("waiting") > tolerance
        sent = state.where(moved).select("auid", F.col("waiting").alias("sent"))
        counts.append(sent.count())
        if not counts[-1]:
            return state.select("auid", "rank"), counts
        state = after(state, sent, F.col("rank"), F.when(moved, F.lit(0.0)).otherwise(F.col("waiting")))


def _scaled(ranks: DataFrame) -> DataFrame:
    mean = ranks.agg(F.avg("rank")).scalar()
    return ranks.select("auid", (F.col("rank") / mean).alias("pageRank"))


def pagerank_of_edges(
    pairs: DataFrame, *, rounds: int | None = None, tolerance: float = TOLERANCE, reset: float = RESET,
    distinct: bool = False,
) -> DataFrame:
    """(auid, pageRank) on directed edges (left, right); a repeated edge counts repeatedly. ``distinct`` says
    that none is repeated, which spares counting them."""
    weighted = checkpointed(
        pairs.select("left", "right", F.lit(1).cast("long").alias("_w")) if distinct
        else pairs.groupBy("left", "right").agg(F.count("*").alias("_w")))
    out = weighted.groupBy("left").agg(F.sum("_w").alias("_out"))
    shares = weighted.join(out, "left").select("left", "right", (F.col("_w") / F.col("_out")).alias("_share"))
    vertices = weighted.select(F.col("left").alias("auid")).union(weighted.select("right")).distinct()
    # A link of share 0 to itself keeps a vertex that nobody links to.
    fits = _fits(vertices)
    links = _placed(shares.union(vertices.select("auid", "auid", F.lit(0.0))), "right" if fits else "left")

    def spread(sent: DataFrame) -> DataFrame:
        return (
            links.join(_sent(sent.withColumnRenamed("auid", "left"), fits), "left").groupBy(F.col("right").alias("auid"))
            .agg(F.sum(F.col("sent") * F.col("_share")).alias("received"))
        )

    ranks = _ranks(vertices, spread, rounds, tolerance, reset, block=5)
    links.unpersist()
    return _scaled(ranks)


def pagerank_of_papers(
    authors: DataFrame, *, rounds: int | None = None, tolerance: float = TOLERANCE, reset: float = RESET
) -> DataFrame:
    """``pagerank_of_edges`` on the co-author pairs of (eid, auid), without forming the pairs.

    With m the number of times an author is on a paper, an author sends m * m' of its links
    through the paper to an author listed m' times. So a round is one sum per paper and
    one per author, linear in the author list where the pairs grow with its square, and
    reads the ranks once.
    """
    listed = authors.groupBy("eid", "auid").agg(F.count("*").alias("_m"))
    sizes = listed.groupBy("eid").agg(F.sum("_m").alias("_size"))
    listed = checkpointed(
        listed.join(sizes, "eid").where(F.col("_m") < F.col("_size")).select("eid", "auid", "_m", "_size")
    )
    out = listed.groupBy("auid").agg(F.sum(F.col("_m") * (F.col("_size") - F.col("_m"))).alias("_out"))
    out = checkpointed(out)
    fits = _fits(out)
    links = _placed(
        listed.join(out, "auid").select("eid", "auid", "_m", (F.lit(1.0) / F.col("_out")).alias("_per")),
        "eid" if fits else "auid", ordered=fits)

    def through_each(sent: DataFrame) -> DataFrame:
        """All listed authors of a paper send, so the sum over a paper meets each of its rows in a window."""
        own = F.col("_m") * F.col("sent") * F.col("_per")
        paper = F.sum("_own").over(Window.partitionBy("eid"))
        return (
            links.join(_sent(sent, fits), "auid").select("eid", "auid", "_m", own.alias("_own"))
            .select("auid", (F.col("_m") * (paper - F.col("_own"))).alias("_gained"))
            .groupBy("auid").agg(F.sum("_gained").alias("received"))
        )

    ranks = (
        _iterate(out.select("auid", F.lit(1.0).alias("rank")), lambda r: _after(r, through_each, reset), rounds, block=1)
        if rounds is not None else _settled(out.select("auid"), _some_authors(links, fits), tolerance, reset)[0]
    )
    links.unpersist()
    return _scaled(ranks)


def _some_authors(links: DataFrame, fits: bool = False) -> Callable[[DataFrame], DataFrame]:
    """What the authors of a paper receive from those that send: the links of the others are not read, and
    of papers only those where someone sends."""
    by_paper = links.select("eid", "auid", "_m")

    def spread(sent: DataFrame) -> DataFrame:
        own = links.join(_sent(sent, fits), "auid").select("eid", "auid", "_m", (F.col("_m") * F.col("sent") * F.col("_per")).alias("_own"))
        through = own.groupBy("eid").agg(F.sum("_own").alias("_through"))
        given = by_paper.join(through, "eid").select("auid", (F.col("_m") * F.col("_through")).alias("_gained"))
        back = own.select("auid", (-F.col("_m") * F.col("_own")).alias("_gained"))
        return given.unionByName(back).groupBy("auid").agg(F.sum("_gained").alias("received"))

    return spread


def _after(ranks: DataFrame, spread: Callable[[DataFrame], DataFrame], reset: float) -> DataFrame:
    return spread(ranks.withColumnRenamed("rank", "sent")).select(
        "auid", (F.lit(reset) + F.lit(1.0 - reset) * F.col("received")).alias("rank"))


def _ranks(
    vertices: DataFrame, spread: Callable[[DataFrame], DataFrame], rounds: int | None, tolerance: float, reset: float, block: int,
) -> DataFrame:
    if rounds is None:
        return _settled(vertices, spread, tolerance, reset)[0]
    start = vertices.select("auid", F.lit(1.0).alias("rank"))
    return _iterate(start, lambda r: _after(r, spread, reset), rounds, block)


def coauthor_pagerank(
    authors: DataFrame, issns: Sequence[str], unambiguous: DataFrame | None = None, *, distinct: bool,
    rounds: int | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """(auid, pageRank) of the authors of the papers reachable from the journals.

    ``distinct`` counts two authors once however many papers they share; only then the
    pairs are formed.
    """
    reachable = reachable_authors(authors, issns)
    if distinct:
        return pagerank_of_edges(
            coauthor_pairs(reachable, unambiguous, distinct=True), rounds=rounds, tolerance=tolerance, distinct=True
        )
    if unambiguous is not None:
        reachable = reachable.join(unambiguous, "auid", "left_semi")
    return pagerank_of_papers(reachable, rounds=rounds, tolerance=tolerance)

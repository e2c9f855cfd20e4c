"""Building blocks shared by the operators: checks, bounded broadcasts, skew-proof groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlens.session import checkpointed, written

# Largest lookup that is broadcast on request; anything above takes another way.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 200_000_000
# Largest block of rows of one key that meets another block in one group of a self join.
BLOCK_ROWS = 2_000
# Pairs of one task of a self join, and tasks, aimed at.
TASK_PAIRS, MAX_TASKS = 500_000, 2_000


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, have {df.columns}")
    return df


def has_at_most(df: DataFrame, rows: int) -> bool:
    """One counting job that stops early once the bound is passed."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int | None = None) -> DataFrame:
    """Broadcast ``df`` if it is measured to have few rows and few bytes; else leave the join to Spark.

    One job that stops once more than ``rows`` rows are met; bytes are those of the rows written out.
    """
    written = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    count, used = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(written), F.lit(0))).first()
    return F.broadcast(df) if count <= rows and used <= (BROADCAST_BYTES if size is None else size) else df


def lookup_join(
    rows: DataFrame, table: DataFrame, on: str | Sequence[str], *, how: str = "inner", row_bytes: int = 100,
    store: bool = False,
) -> DataFrame:
    """Join ``rows`` to a ``table`` with one row per key, whatever share of the rows one key has.

    A table counted to fit ``BROADCAST_BYTES`` at ``row_bytes`` a row is broadcast. Of a larger one
    only the keys are broadcast that make up 1/limit of all rows or more (so at most limit of them);
    the rows of the other keys are shuffled. Keys are matched like an equi-join, so null meets nothing. The rows are
    then read three times; ``store`` writes them first, for narrow rows that are costly to compute.
    """
    keys, limit = [on] if isinstance(on, str) else list(on), max(1, BROADCAST_BYTES // row_bytes)
    table = checkpointed(table)  # It is read to be measured and again to be joined.
    if has_at_most(table, limit):
        return rows.join(F.broadcast(table), keys, how)
    rows = written(rows, "lookup") if store else rows
    frequent = F.broadcast(frequent_keys(rows, keys, limit))
    often = rows.join(frequent, keys, "left_semi").join(F.broadcast(table.join(frequent, keys, "left_semi")), keys, how)
    return often.unionByName(rows.join(frequent, keys, "left_anti").join(table, keys, how))


def frequent_keys(rows: DataFrame, keys: Sequence[str], limit: int, *, most: bool = False) -> DataFrame:
    """The keys that make up 1/``limit`` of all rows or more, so at most ``limit`` of them; the rows are read once.

    With ``most`` all keys of as many rows as leave no more than ``limit`` of them, which are those at least."""
    counts = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("_count")))
    if most:
        found, least = 0, None
        for count, of_it in counts.groupBy("_count").count().orderBy(F.col("_count").desc()).toLocalIterator():
            found += of_it
            if found > limit:
                break
            least = count
        return checkpointed(counts.where(F.lit(False) if least is None else F.col("_count") >= least).select(*keys))
    every = counts.agg(F.coalesce(F.sum("_count"), F.lit(0))).first()[0]
    return checkpointed(counts.where(F.col("_count") * limit >= every).select(*keys))


def computed_once(column: Column) -> Column:
    """``column`` such that filters on it cannot be pushed below and compute it a second time.

    For costly expressions that are filtered or exploded later; takes the place of the one
    generator a select may have.
    """
    return F.explode(F.array(column))


def hash_share(key: str, seed: int = 0) -> Column:
    """Uniform number in [0, 1) that depends on the key only, so it survives recomputation: the first 32 bits of
    the SHA-256 of seed, colon and key (null: empty), as any other engine can state them."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def pairs_within(
    df: DataFrame,
    key: str,
    member: str,
    carry: Sequence[str] = (),
    *,
    right_carry: Sequence[str] = (),
    ordered: Callable[[Column, Column], Column] | None = None,
    block_rows: int = BLOCK_ROWS,
    store: bool = True,
) -> DataFrame:
    """Join ``df`` with itself on ``key``: columns left, right, ``carry``, ``right_carry`` + '_right'.

    ``ordered`` restricts the pairs (by the two members). The work of a key grows with the
    square of its rows, which a split by input bytes does not see. So rows of a key above
    ``block_rows`` are dealt into blocks and every two blocks meet in a group of their own.
    The rows are checkpointed, as they are read to find such keys and as both sides;
    ``store=False`` spares that for wide rows.
    """
    rows = df.where(F.col(key).isNotNull())
    rows = checkpointed(rows) if store else rows
    hot = (
        rows.groupBy(key).count().where(F.col("count") > block_rows)
        .select(key, F.ceil(F.col("count") / F.lit(block_rows)).cast("int").alias("_blocks"))
    )
    left_cols = [F.col(member).alias("left"), *carry]
    right_cols = [F.col(member).alias("right"), *[F.col(c).alias(f"{c}_right") for c in right_carry]]
    if has_at_most(hot, 0):
        on = [key]
        left, right = rows.select(key, *left_cols), rows.select(key, *right_cols)
    else:
        on = [key, "_i", "_j"]
        dealt = (
            rows.join(broadcast_if_small(hot), key, "left")
            .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
            .withColumn("_block", F.pmod(F.xxhash64(member), "_blocks").cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        )
        left = dealt.select(key, F.col("_block").alias("_i"), F.col("_other").alias("_j"), *left_cols)
        right = dealt.select(key, F.col("_other").alias("_i"), F.col("_block").alias("_j"), *right_cols)
    pairs = left.join(right, on)
    if ordered is not None:
        pairs = pairs.where(ordered(F.col("left"), F.col("right")))
    kept = [key] if key not in carry else []
    return pairs.select(*kept, "left", "right", *carry, *[f"{c}_right" for c in right_carry])


def cells_back_in_time(
    df: DataFrame, key: str, member: str, time: Column, carry: Sequence[str] = (), *, strict: bool,
    block_rows: int = BLOCK_ROWS, right: DataFrame | None = None, right_carry: Sequence[str] = (), dealt_by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, list[str], int]:
    """The two sides of ``pairs_back_in_time`` before they meet: (left, ``carry``) and (right, ``right_carry`` + '_right'), the
    columns of a cell, and tasks for the work. All rows of a cell on the one side make a pair with all on the other.

    ``dealt_by`` names columns of both sides that tell rows of a member apart, so copies can be dealt into several blocks.
    """
    def timed(side: DataFrame, columns: Sequence[str]) -> DataFrame:
        return checkpointed(side.where(F.col(key).isNotNull()).select(
            key, F.col(member).alias("_member"), time.alias("_at"), *columns).where(F.col("_at").isNotNull()))

    rows = timed(df, carry if right is not None else [*carry, *[c for c in right_carry if c not in carry]])
    earlier = rows if right is None else timed(right, right_carry)

    def blocks(count: Column) -> Column:
        return F.ceil(count / F.lit(block_rows)).cast("int")

    slices = earlier.groupBy(key, "_at").agg(F.count("*").alias("_n"))
    sliced = F.transform(
        F.sort_array(F.collect_list(F.struct("_at", blocks(F.col("_n")).alias("_blocks")))),
        lambda s, i: F.struct(s["_at"].alias("_at"), s["_blocks"].alias("_blocks"), i.alias("_s")))
    spans = checkpointed(slices.groupBy(key).agg(sliced.alias("_slices"), F.sum("_n").alias("_m")).join(
        rows.groupBy(key).agg(blocks(F.count("*")).alias("_parts"), F.count("*").alias("_n")), key))
    # The work follows the pairs and not the bytes that are shuffled, by which Spark would choose the tasks.
    most = spans.agg(F.coalesce(F.sum(F.col("_m").cast("double") * F.col("_n")), F.lit(0.0))).first()[0]
    spans = spans.drop("_m", "_n")

    def dealt(parts: Column) -> Column:
        return F.pmod(F.xxhash64("_member", *dealt_by), parts).cast("int")

    def every(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), parts - 1))

    at = F.col("_at")
    before = F.filter("_slices", lambda s: s["_at"] < at if strict else s["_at"] <= at)
    own = F.filter("_slices", lambda s: s["_at"] == at)[0]
    lefts = (
        lookup_join(rows, spans, key, row_bytes=1_000)
        .withColumn("_i", dealt(F.col("_parts"))).withColumn("_slice", F.explode(before))
        .withColumn("_j", every(F.col("_slice._blocks")))
        .select(key, "_i", F.col("_slice._s").alias("_s"), "_j", F.col("_member").alias("left"), *carry)
    )
    rights = lookup_join(earlier, spans, key, row_bytes=1_000).withColumn("_own", own).withColumn(
        "_j", dealt(F.col("_own._blocks"))).withColumn("_i", every(F.col("_parts"))).select(
        key, "_i", F.col("_own._s").alias("_s"), "_j", F.col("_member").alias("right"), *[F.col(c).alias(f"{c}_right") for c in right_carry])
    return lefts, rights, [key, "_i", "_s", "_j"], min(MAX_TASKS, max(1, int(most // TASK_PAIRS)))


def pairs_back_in_time(
    df: DataFrame, key: str, member: str, time: Column, carry: Sequence[str] = (), *,
    strict: bool, block_rows: int = BLOCK_ROWS, right: DataFrame | None = None, right_carry: Sequence[str] = (),
) -> DataFrame:
    """(left, right, ``carry`` of the left, ``right_carry`` + '_right'): rows of ``df`` with rows of the same key that
    are no later, or with ``strict`` earlier. A null key or time meets nothing. ``right`` gives other rows to meet.

    The rows of a key are sliced by time, and a row goes to the slices before it only, so no pair is formed that the
    order rules out. Slices above ``block_rows`` and keys above that are dealt into blocks: every group that
    meets is a block of one slice with a block of all later rows of the key.
    """
    lefts, rights, cell, tasks = cells_back_in_time(
        df, key, member, time, carry, strict=strict, block_rows=block_rows, right=right, right_carry=right_carry)
    if tasks > 1:
        lefts, rights = lefts.repartition(tasks, *cell), rights.repartition(tasks, *cell)
    return lefts.join(rights, cell).select("left", "right", *carry, *[f"{c}_right" for c in right_carry])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    combine: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column],
    name: str,
    *,
    descending: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """``combine(value)`` over the rows of the same keys that come strictly before, as ``name``.

    ``keys`` + ``order`` must identify a row; ``total`` names a column for all rows of the keys. No key is gathered in one task: rows are
    sorted into range slices over all tasks, accumulated inside each slice, and what
    earlier slices of the same key amount to is added from one row per key and slice.
    The slices are checkpointed because a second evaluation could cut them elsewhere.
    """
    def sort_key(column: str) -> Column:
        return F.col(column).desc() if column in descending else F.col(column).asc()

    sliced = checkpointed(
        df.repartitionByRange(*[F.col(k) for k in keys], *[sort_key(c) for c in order])
        .withColumn("_slice", F.spark_partition_id())
    )
    on = [*keys, "_slice"]
    inside = Window.partitionBy(*on).orderBy(*[sort_key(c) for c in order])
    earlier = Window.partitionBy(*keys).orderBy("_slice")
    strictly_before = (Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*on).agg(combine(F.col(value)).alias("_total"))
        .withColumn("_carried", combine(F.col("_total")).over(earlier.rowsBetween(*strictly_before)))
    )
    if total:
        carried = carried.withColumn(total, combine(F.col("_total")).over(Window.partitionBy(*keys)))
    carried = carried.drop("_total")
    return (
        sliced.withColumn("_inside", combine(F.col(value)).over(inside.rowsBetween(*strictly_before)))
        .join(carried, on)
        .withColumn(name, merge(F.col("_carried"), F.col("_inside")))
        .drop("_slice", "_inside", "_carried")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str,
                descending: Sequence[str] = (), total: str | None = None) -> DataFrame:
    return running(
        df, keys, order, value, F.sum,
        lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), name,
        descending=descending, total=total,
    )


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    return running(df, keys, order, value, F.max, F.greatest, name)


def indexed(df: DataFrame, order: Sequence[str], name: str, descending: Sequence[str] = ()) -> DataFrame:
    """Number the rows 0, 1, ... in the given total order without a single-task sort."""
    ones = df.withColumn("_one", F.lit(1))
    return (
        running_sum(ones, [], order, "_one", name, descending)
        .withColumn(name, F.col(name).cast("int")).drop("_one")
    )


def percent_ranked(df: DataFrame, key: str, value: str, name: str = "ptile") -> DataFrame:
    """``df`` with ``percent_rank() over (partition by key order by value)`` for keys of any size.

    Equal values are counted before the sort, so copies do not pile up either.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("_count"))
    before = running_sum(counts, [key], [value], "_count", "_before", total="_all")
    ranks = before.select(
        key, value,
        F.when(F.col("_all") > 1, F.col("_before") / (F.col("_all") - 1).cast("double"))
        .otherwise(F.lit(0.0)).alias(name),
    )
    return lookup_join(df, ranks, [key, value])

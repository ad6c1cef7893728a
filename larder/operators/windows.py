"""Window jobs (W1-W3) and the skew-safe ordered primitives behind them.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of one key to
one task; with a hot key (one ingredient in most recipes, one busy menu item)
that task gets a third of the data.  The primitives here are two-level:

1. rows are cut into chunks (``key``, ``chunk``) where ``chunk`` is a range of
   the order column (a time bucket or ``seq div size``) — the window work runs
   per chunk, spread over many tasks;
2. one small row per chunk carries what earlier chunks contribute (a sum, or
   the last value), computed over the chunk table, which is ``size`` times
   smaller than the data, and joined back on (key, chunk).

Both levels are exact.  Chunks cost a second exchange, so only keys that hold
more than HOT_ROWS rows are chunked; all others take the plain window, one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.schemas import ORDER_STATUSES


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


def _join_on_chunk(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join per-chunk carries back on (keys, _chunk) with null-safe equality.

    Null-safe equality keeps NULL keys as their own group (as a window does)
    and adds no inferred IS NOT NULL filter to one side only, so both
    branches over the same input stay identical and Spark reuses their
    shuffles instead of computing the input twice.
    """
    s = small.select(*[F.col(c).alias(f"_j_{c}") for c in [*keys, "_chunk"]],
                     *[c for c in small.columns if c not in (*keys, "_chunk")])
    cond = [big[c].eqNullSafe(s[f"_j_{c}"]) for c in [*keys, "_chunk"]]
    return big.join(s, cond, how).drop(*[f"_j_{c}" for c in [*keys, "_chunk"]])


def with_chunks(df: DataFrame, keys: list[str], order: list[str],
                chunk: Column | None) -> DataFrame:
    """Add ``_chunk``: the given monotone chunk column, or — when None — the
    partition id after a range partitioning on (keys, order).

    Range partitioning splits a hot key over as many partitions as its rows
    need, and for one key the partition id grows with the order, so every
    chunk holds at most one partition's rows whatever the skew (a parallel
    prefix over a distributed sort).  Partition ids are only stable for one
    computation of the exchange (range bounds are sampled), so the chunked
    frame is checkpointed to the shared folder (eager) and both levels read
    that one copy.
    """
    if chunk is not None:
        return df.withColumn("_chunk", chunk)
    from larder.session import cut_lineage
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys, *order)
                         .withColumn("_chunk", F.spark_partition_id().cast("long")))


HOT_ROWS = 1 << 20        # rows of one key that one task's window may sort


def split_hot(df: DataFrame, keys: list[str], hot_rows: int,
              counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys above ``hot_rows`` or None).

    Rows per key are counted over the pruned key columns (one partial aggregate; nothing of the
    frame is written), and the hot keys (at most rows / ``hot_rows``) split it.  Without
    a hot key the frame goes on as it is.  Which way a key goes never changes its result, so
    ``counts`` (keys, _n), an upper bound that is cheaper to get, may stand for the count.
    """
    from larder.session import cut_lineage
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_n")
    hot = cut_lineage(counts.filter(F.col("_n") > hot_rows).drop("_n"))
    if hot.isEmpty():
        return df, None
    same = [df[k].eqNullSafe(hot[f"_h_{k}"]) for k in keys]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def running_total(df: DataFrame, keys, order: list[str], value, chunk: Column | None = None,
                  out=None, hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (one name or a list) per ``keys`` in
    ``order``; result columns ``out`` (default ``running`` / ``<v>_run``).

    ``chunk`` must be monotone in ``order`` (a coarser version of it); None
    takes a plain window for keys up to ``hot_rows`` rows and range-partition chunks
    (see ``with_chunks``) for the others; ``counts`` as in ``split_hot``.
    """
    keys = _as_list(keys)
    values = _as_list(value)
    outs = _as_list(out) if out is not None else (
        ["running"] if len(values) == 1 else [f"{v}_run" for v in values])
    if chunk is None:
        plain, hot = split_hot(df, keys, hot_rows, counts)
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        done = plain.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(o)
                                   for v, o in zip(values, outs)])
        return done if hot is None else done.unionByName(_chunked_total(hot, keys, order, values, None, outs))
    return _chunked_total(df, keys, order, values, chunk, outs)


def _chunked_total(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                   chunk: Column | None, outs: list[str]) -> DataFrame:
    d = with_chunks(df, keys, order, chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for i, v in enumerate(values):
        d = d.withColumn(f"_in{i}", F.sum(v).over(inner))
    per_chunk = d.groupBy(*keys, "_chunk").agg(
        *[F.sum(v).alias(f"_tot{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = per_chunk.select(*keys, "_chunk", *[
        F.coalesce(F.sum(f"_tot{i}").over(before), F.lit(0)).alias(f"_carry{i}")
        for i in range(len(values))])
    d = _join_on_chunk(d, carry, keys, "inner")
    for i, o in enumerate(outs):
        d = d.withColumn(o, F.col(f"_carry{i}") + F.coalesce(F.col(f"_in{i}"), F.lit(0)))
    return d.drop("_chunk", *[f"_in{i}" for i in range(len(values))],
                  *[f"_carry{i}" for i in range(len(values))])


def asof_last(df: DataFrame, keys, order: list[str], value: str, chunk: Column | None = None,
              out: str | None = None, inclusive: bool = True,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each row, the last non-NULL ``value`` at or before it (``inclusive``)
    or strictly before it, within ``keys`` in ``order`` — an as-of lookup.

    ``chunk`` as in ``running_total``: None takes a plain window for ordinary keys
    and chunks for hot ones.
    """
    keys = _as_list(keys)
    out = out or f"{value}_asof"
    if chunk is None:
        plain, hot = split_hot(df, keys, hot_rows)
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        done = plain.withColumn(out, F.last(value, ignorenulls=True).over(w))
        return done if hot is None else done.unionByName(
            _chunked_last(hot, keys, order, value, None, out, inclusive))
    return _chunked_last(df, keys, order, value, chunk, out, inclusive)


def _chunked_last(df: DataFrame, keys: list[str], order: list[str], value: str,
                  chunk: Column | None, out: str, inclusive: bool) -> DataFrame:
    d = with_chunks(df, keys, order, chunk)
    upper = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, upper)
    d = d.withColumn("_in", F.last(value, ignorenulls=True).over(inner))
    order_struct = F.struct(*[F.col(c) for c in order])
    last_in_chunk = (d.filter(F.col(value).isNotNull())
                      .groupBy(*keys, "_chunk")
                      .agg(F.max_by(F.col(value), order_struct).alias("_last")))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    # chunks without any non-NULL value still need the carry from before them
    chunks = d.select(*keys, "_chunk").distinct()
    all_chunks = _join_on_chunk(chunks, last_in_chunk, keys, "left")
    carry = all_chunks.select(
        *keys, "_chunk",
        F.last("_last", ignorenulls=True).over(before).alias("_c"))
    return (_join_on_chunk(d, carry, keys, "left")
             .withColumn(out, F.coalesce("_in", "_c"))
             .drop("_chunk", "_in", "_c"))


def wall_seconds(ts) -> Column:
    """Seconds since 1970-01-01 00:00 of the wall clock of ``ts`` (whole
    seconds).  For TIMESTAMP_NTZ this does not depend on the session time
    zone (a cast to TIMESTAMP would), and it is monotone in ``ts``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600
            + F.minute(c) * 60 + F.second(c))


def time_chunk(ts: str, seconds: int = 3600) -> Column:
    """Chunk id = time bucket of ``seconds`` (monotone in ``ts``)."""
    return F.floor(wall_seconds(ts) / seconds)


def seq_chunk(seq: str, size: int = 1 << 16) -> Column:
    """Chunk id = ``seq div size``: at most ``size`` rows when seq is unique."""
    return F.floor(F.col(seq) / size)


# ------------------------------------------------------------------ W1

def movements(purchases: DataFrame, order_items: DataFrame, orders: DataFrame,
              recipes: DataFrame) -> DataFrame:
    """Stock movements: +quantity per purchase (at its date), and per order the
    recipe use Σ qty_required × quantity per ingredient (at the order time).

    Sales are pre-aggregated per (order, ingredient) before anything else,
    so one row per order and ingredient enters the ledger.  Lines are dealt by order
    once, for the aggregate and for the join with the order's time.
    """
    buys = purchases.select(
        "ingredient_id", F.col("purchase_date").cast("timestamp_ntz").alias("ts"),
        F.lit(0).alias("kind"), F.col("purchase_id").alias("ref"),
        F.col("quantity").cast("decimal(20,2)").alias("delta"))
    use = (order_items.select("order_id", "menu_id", "quantity")
           .join(recipes, "menu_id")
           .repartition("order_id")
           .groupBy("order_id", "ingredient_id")
           .agg(F.sum(F.col("qty_required") * F.col("quantity")).alias("used")))
    sales = (use.join(orders.select("order_id", "order_date"), "order_id")
                .select("ingredient_id", F.col("order_date").alias("ts"),
                        F.lit(1).alias("kind"), F.col("order_id").alias("ref"),
                        (-F.col("used")).cast("decimal(20,2)").alias("delta")))
    return buys.unionByName(sales)


def most_movements(purchases: DataFrame, order_items: DataFrame, recipes: DataFrame) -> DataFrame:
    """(ingredient_id, _n): at least as many as an ingredient has ``movements``, from sums per menu
    item instead of the movements themselves (orders with an id of their own)."""
    sold = order_items.groupBy("menu_id").agg(F.count(F.lit(1)).alias("_n"))
    return (purchases.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("_n"))
            .unionByName(sold.join(recipes, "menu_id").select("ingredient_id", "_n"))
            .groupBy("ingredient_id").agg(F.sum("_n").alias("_n")))


def stock_ledger(opening: DataFrame, moves: DataFrame, bucket_seconds: int | None = None,
                 counts: DataFrame | None = None) -> DataFrame:
    """Stock before -> after each movement, per ingredient.

    ``opening`` (ingredient_id, quantity) is the stock before the first
    movement; ``moves`` (ingredient_id, ts, kind, ref, delta).  Order within
    an ingredient: ts, then purchases (kind 0) before sales (kind 1), then
    ref.  Chunks are range partitions (``bucket_seconds`` None) or time
    buckets.  ``counts``: an upper bound of the movements per ingredient (see ``split_hot``).
    """
    chunk = None if bucket_seconds is None else time_chunk("ts", bucket_seconds)
    run = running_total(moves, "ingredient_id", ["ts", "kind", "ref"], "delta", chunk,
                        out="moved", counts=counts)
    o = opening.select("ingredient_id", F.col("quantity").alias("opening"))
    j = run.join(o, "ingredient_id", "left")
    base = F.coalesce(F.col("opening"), F.lit(0))
    return j.select("ingredient_id", "ts", "kind", "ref", "delta",
                    (base + F.col("moved") - F.col("delta")).alias("before"),
                    (base + F.col("moved")).alias("after"))


# ------------------------------------------------------------------ W2

def assign_ids(df: DataFrame, order: list[str], start: Column | int = 1,
               out: str = "id") -> DataFrame:
    """Consecutive ids start, start+1, ... in ``order`` (AUTO_INCREMENT).

    Range-partitioned sort (many tasks), then per-partition row counts (one
    tiny row per partition) give each partition its offset; the id is
    offset + position within the partition.  The sorted frame is
    checkpointed first so both passes see the same partitioning.  No global
    single-partition window.
    """
    from larder.session import cut_lineage
    sorted_df = cut_lineage(df.orderBy(*order).withColumn("_pid", F.spark_partition_id())
                              .withColumn("_mid", F.monotonically_increasing_id()))
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                           F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    s = start if isinstance(start, Column) else F.lit(start)
    return (sorted_df.join(offsets, "_pid")
                     .withColumn(out, s + F.col("_off") + (F.col("_mid") - F.col("_first")))
                     .drop("_pid", "_mid", "_first", "_off"))


def next_id_base(existing: DataFrame, id_col: str) -> Column:
    """max(existing id) + 1 (1 for an empty table) as a scalar subquery."""
    return existing.select(F.coalesce(F.max(id_col), F.lit(0)) + 1).scalar()


# ------------------------------------------------------------------ W3

def status_fold(orders: DataFrame, changes: DataFrame, chunk_size: int | None = None) -> DataFrame:
    """Current status of every order from a change log.

    ``changes`` (seq, order_id, actor, customer_id, status): staff set any of
    the four statuses (other values are rejected); a customer cancel takes
    effect only on the owner's order and only while it is Pending.  Returns
    orders with the folded ``status`` plus ``cancel_applied`` counts.

    A staff change always applies, so the status before a cancel is the last
    staff status before it (else the initial one) unless an earlier cancel in
    the same staff segment already applied.  Hence: a valid cancel applies iff
    its segment's base status is Pending and it is the first valid cancel of
    the segment.  The last staff change and the first cancel per segment are
    partial aggregates (map-side combined), the segment lookup is a two-level
    as-of — no per-order collection.
    """
    staff = (changes.filter((F.col("actor") == "staff") & F.col("status").isin(ORDER_STATUSES))
                    .select("order_id", "seq", "status"))
    applied = (cancel_outcomes(orders, changes, chunk_size).filter("changed")
               .select("order_id", "seq"))
    # final status: the last effective event (a staff change or an applied
    # cancel); one aggregate gives it and the number of applied cancels
    events = (staff.withColumn("_c", F.lit(0))
                   .unionByName(applied.withColumn("status", F.lit("Cancelled"))
                                       .withColumn("_c", F.lit(1))))
    last = events.groupBy("order_id").agg(F.max_by("status", "seq").alias("_new"),
                                          F.sum("_c").alias("cancel_applied"))
    return (orders.join(last, "order_id", "left")
                  .withColumn("status", F.coalesce("_new", "status"))
                  .withColumn("cancel_applied",
                              F.coalesce("cancel_applied", F.lit(0)).cast("long"))
                  .drop("_new"))


def cancel_outcomes(orders: DataFrame, changes: DataFrame, chunk_size: int | None = None):
    """U7 detail: every customer cancel request with changed yes/no.

    One as-of pass gives each valid cancel the last staff change before it
    (its segment: seq and status together); then the first cancel per
    segment applies iff the segment's base status is Pending.
    """
    staff = (changes.filter((F.col("actor") == "staff") & F.col("status").isin(ORDER_STATUSES))
                    .select("order_id", "seq", F.struct(F.col("seq").alias("s"),
                                                        F.col("status").alias("st"))
                            .alias("_staff")))
    reqs = changes.filter(F.col("actor") == "customer").select(
        "order_id", "seq", "customer_id", F.col("status").alias("_req"))
    owners = orders.select("order_id", F.col("customer_id").alias("_owner"),
                           F.col("status").alias("_init"))
    valid = (reqs.join(owners, "order_id")
                 .filter((F.col("_req") == "Cancelled") & (F.col("customer_id") == F.col("_owner")))
                 .select("order_id", "seq", "_init"))
    both = staff.select("order_id", "seq", "_staff", F.lit(None).cast("string").alias("_init")) \
        .unionByName(valid.select("order_id", "seq",
                                  F.lit(None).cast(staff.schema["_staff"].dataType)
                                   .alias("_staff"), "_init"))
    chunk = None if chunk_size is None else seq_chunk("seq", chunk_size)
    seg = asof_last(both, "order_id", ["seq"], "_staff", chunk, out="_seg", inclusive=False)
    c = (seg.filter(F.col("_staff").isNull())
            .withColumn("_base", F.coalesce(F.col("_seg.st"), F.col("_init")))
            .withColumn("_segk", F.coalesce(F.col("_seg.s"), F.lit(-1))))
    firsts = c.groupBy("order_id", "_segk").agg(F.min("seq").alias("_first"),
                                                F.max("_base").alias("_b"))
    ok = (firsts.filter(F.col("_b") == "Pending")
                .select("order_id", F.col("_first").alias("seq"))
                .withColumn("changed", F.lit(True)))
    return (reqs.select("seq", "order_id", "customer_id")
                .join(ok, ["order_id", "seq"], "left")
                .withColumn("changed", F.coalesce("changed", F.lit(False))))

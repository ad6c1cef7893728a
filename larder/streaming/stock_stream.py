"""Live stock, order totals, daily sales and low-stock alerts with Structured
Streaming (T4, T5, T7).

Sources are streaming DataFrames (file source over parquet here; Kafka or a
table stream on a cluster).  What must be remembered lives in Spark's state
store, so a micro-batch reads its own rows and the state of their keys, however
long the stream has run:

* T4 takes raw purchases and raw order lines; a stream-static join with the recipes
  turns lines into stock use, and one streaming aggregation keeps the sums per
  ingredient and per order, so that both move in the same micro-batch.
* T5 keeps each order's status, day and amount; an effective change takes the
  order's sale from its old day and adds it to the new one (a retraction).
* T7 keeps each ingredient's balance and emits on crossing its level only.

Each micro-batch writes what it changed under its batch id
(``changes/batch=N``, replaced if the batch is retried); every FOLD_EVERY batches
the changes are folded into a versioned snapshot (``larder.sources.sinks``) and the
folders that the snapshot before it covers are removed, so a reader lists at
most 2 x FOLD_EVERY folders.  Sinks are idempotent and the queries restart from
their checkpoints.

Order across micro-batches is arrival order; within a batch, event time
(then ``ref``) or ``seq``.  No row is ever too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from larder.functions import exprs as X
from larder.schemas import ORDER_STATUSES
from larder.sources import commits, sinks

MOVEMENT_COLS = ["ingredient_id", "ts", "ref", "delta"]
FOLD_EVERY = 50


class ChangeLog:
    """What a stream has changed: one folder per micro-batch and a folded snapshot.

    ``additive`` logs hold differences, which are added up per key; others hold the
    latest row of each changed key."""

    def __init__(self, spark: SparkSession, state_dir: str, key: list[str], schema: str, additive: bool = False):
        self.spark, self.key, self.additive = spark, key, additive
        self.changes, self.folded = f"{state_dir}/changes", f"{state_dir}/folded"
        self.schema = spark.createDataFrame([], schema).schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.changes}/batch={batch_id}")
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            before = sinks.latest_version(self.spark, self.folded, batch_id)
            sinks.commit_version(self.read(), self.folded, batch_id, batch=f"batch-{batch_id}")
            # a reader that began before this snapshot still needs what is newer than the last one
            for n in self._batches():
                if before is not None and n <= before:
                    commits.delete(self.spark, f"{self.changes}/batch={n}")
            sinks.drop_old_versions(self.spark, self.folded, keep=2)

    def _batches(self) -> list[int]:
        return [int(n.removeprefix("batch=")) for n in commits.names(self.spark, self.changes) if n.startswith("batch=")]

    def read(self) -> DataFrame:
        """The state per key; empty before the first batch."""
        version = sinks.latest_version(self.spark, self.folded)
        parts = []
        if version is not None:
            parts.append(sinks.read_version(self.spark, self.folded, version)
                         .select(*self.schema.names, F.lit(version).cast("long").alias("batch")))
        newer = [f"{self.changes}/batch={n}" for n in self._batches() if version is None or n > version]
        if newer:
            schema = StructType([*self.schema.fields, StructField("batch", LongType())])
            parts.append(self.spark.read.schema(schema).option("basePath", self.changes).parquet(*newer))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        value = [c for c in rows.columns if c not in (*self.key, "batch")]
        if self.additive:
            out = rows.groupBy(*self.key).agg(*[F.sum(c).cast(self.schema[c].dataType).alias(c) for c in value])
        else:
            out = rows.groupBy(*self.key).agg(F.max_by(F.struct(*value), "batch").alias("_v")).select(
                *self.key, *[F.col(f"_v.{c}").alias(c) for c in value])
        return out.select(*self.schema.names)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _into(log: ChangeLog):
    return lambda df, batch_id: log.write(df, batch_id)


# ------------------------------------------------------------------ T4

def _moved_log(spark: SparkSession, state_dir: str) -> ChangeLog:
    return ChangeLog(spark, state_dir, ["ingredient_id"], "ingredient_id long, moved decimal(30,2)")


def stream_stock(moves: DataFrame, state_dir: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """T4 for ready-made movements: balance per ingredient kept live.

    ``moves`` is a streaming frame (ingredient_id, ts, ref, delta) — purchases
    positive, recipe use of sold items negative.  The running sum per
    ingredient lives in Spark's state store (a streaming aggregation in
    update mode, restored from ``checkpoint`` after a failure); each
    micro-batch emits only the ingredients it changed.  ``read_balances`` adds
    the latest total per ingredient to the opening stock.
    """
    totals = moves.groupBy("ingredient_id").agg(
        F.sum("delta").cast("decimal(30,2)").alias("moved"))
    log = _moved_log(moves.sparkSession, state_dir)
    return _start(totals.writeStream.outputMode("update").foreachBatch(_into(log)), checkpoint, available_now)


def read_balances(spark: SparkSession, state_dir: str, opening: DataFrame) -> DataFrame:
    """Current balances: opening stock + the latest running total per ingredient
    (just the opening stock when nothing has arrived)."""
    latest = _moved_log(spark, state_dir).read()
    return (opening.select("ingredient_id", "quantity").join(latest, "ingredient_id", "full")
                   .select("ingredient_id",
                           (F.coalesce("quantity", F.lit(0)) + F.coalesce("moved", F.lit(0)))
                           .cast("decimal(30,2)").alias("quantity")))


def _sales_log(spark: SparkSession, state_dir: str) -> ChangeLog:
    return ChangeLog(spark, state_dir, ["kind", "id"], "kind string, id long, amount decimal(30,2)")


def stream_sales(purchases: DataFrame, lines: DataFrame, recipes: DataFrame, state_dir: str,
                 checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """T4 from raw inputs: what T1 and T2 do, as purchases and order lines arrive.

    ``purchases`` (ingredient_id, quantity) and ``lines`` (order_id, menu_id, quantity,
    price) are streams, ``recipes`` (menu_id, ingredient_id, qty_required) is static and read
    anew for every micro-batch.  A line is three kinds of movement: recipe use of
    each ingredient and an addition to its order's total; items without a recipe
    use nothing.  One aggregation keeps the sums of both kinds, so a micro-batch
    never shows an order's total without its stock use.  ``read_stock`` and
    ``read_order_totals`` add the sums to the stored tables.
    """
    buys = purchases.select(F.lit("stock").alias("kind"), F.col("ingredient_id").alias("id"),
                            F.col("quantity").cast("decimal(20,2)").alias("amount"))
    use = (lines.select("menu_id", "quantity").join(recipes.select("menu_id", "ingredient_id", "qty_required"), "menu_id")
                .select(F.lit("stock").alias("kind"), F.col("ingredient_id").alias("id"),
                        (-F.col("qty_required") * F.col("quantity")).cast("decimal(20,2)").alias("amount")))
    totals = lines.select(F.lit("order").alias("kind"), F.col("order_id").alias("id"),
                          X.line_subtotal().cast("decimal(20,2)").alias("amount"))
    moved = (buys.unionByName(use).unionByName(totals).groupBy("kind", "id")
                 .agg(F.sum("amount").cast("decimal(30,2)").alias("amount")))
    log = _sales_log(lines.sparkSession, state_dir)
    return _start(moved.writeStream.outputMode("update").foreachBatch(_into(log)), checkpoint, available_now)


def _plus(table: DataFrame, key: str, col: str, moved: DataFrame) -> DataFrame:
    j = table.join(moved.select(F.col("id").alias(key), F.col("amount").alias("_m")), key, "left")
    return j.withColumn(col, X.to_total(F.col(col) + F.coalesce("_m", F.lit(0)))).select(*table.columns)


def read_stock(spark: SparkSession, state_dir: str, ingredients: DataFrame) -> DataFrame:
    """``ingredients`` with the quantity after all purchases and sales so far."""
    moved = _sales_log(spark, state_dir).read().filter("kind = 'stock'")
    return _plus(ingredients, "ingredient_id", "quantity", moved)


def read_order_totals(spark: SparkSession, state_dir: str, orders: DataFrame) -> DataFrame:
    """``orders`` with the total after all lines so far."""
    moved = _sales_log(spark, state_dir).read().filter("kind = 'order'")
    return _plus(orders, "order_id", "total_amount", moved)


# ------------------------------------------------------------------ T5

_DAYS = "day date, total_orders long, total_sales decimal(30,2)"


def stream_daily_sales(sales: DataFrame, state_dir: str, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """T5 for sales that never change: v_daily_sales kept live.

    ``sales`` (ts, amount) are paid sales, ``ts`` a TIMESTAMP_NTZ (its calendar
    day does not depend on the session time zone).  One state row per day,
    without a watermark: a sale that arrives late still counts on its day, as
    in the view.  Each micro-batch writes the days it changed.
    """
    days = (sales.groupBy(F.to_date("ts").alias("day"))
                 .agg(F.count(F.lit(1)).alias("total_orders"),
                      F.sum("amount").cast("decimal(30,2)").alias("total_sales")))
    log = ChangeLog(sales.sparkSession, state_dir, ["day"], _DAYS)
    return _start(days.writeStream.outputMode("update").foreachBatch(_into(log)), checkpoint, available_now)


def read_daily_sales(spark: SparkSession, state_dir: str) -> DataFrame:
    """T5 read side: (day, total_orders, total_sales); empty before the first sale."""
    return ChangeLog(spark, state_dir, ["day"], _DAYS).read()


def order_events(orders: DataFrame, changes: DataFrame, additions: DataFrame | None = None) -> DataFrame:
    """One stream of what happens to orders: ``orders`` (order_id, customer_id, order_date, status,
    total_amount) as they are placed, ``changes`` (seq, order_id, actor, customer_id, status) as
    in W3, and ``additions`` (order_id, amount) to totals."""
    def null(t):
        return F.lit(None).cast(t)

    def cents(c):
        return (F.col(c) * 100).cast("decimal(18,0)").cast("long")
    out = orders.select("order_id", F.lit(0).alias("kind"), null("long").alias("seq"), null("string").alias("actor"),
                        F.col("customer_id").cast("long").alias("customer_id"), "status",
                        X.day_of("order_date").alias("day"), cents("total_amount").alias("cents"))
    out = out.unionByName(changes.select(
        "order_id", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "actor",
        F.col("customer_id").cast("long").alias("customer_id"), "status", null("date").alias("day"),
        null("long").alias("cents")))
    if additions is not None:
        out = out.unionByName(additions.select(
            "order_id", F.lit(2).alias("kind"), null("long").alias("seq"), null("string").alias("actor"),
            null("long").alias("customer_id"), null("string").alias("status"), null("date").alias("day"),
            cents("amount").alias("cents")))
    return out


def _sale(order, changes, additions):
    """Day and amount of an order's sale, null while it is not Paid.  ``changes`` in the order
    in which they take effect."""
    status = F.aggregate(changes, order["status"], lambda st, e: (
        F.when((e["actor"] == "staff") & e["status"].isin(ORDER_STATUSES), e["status"])
         .when((e["actor"] == "customer") & (e["status"] == "Cancelled") & (st == "Pending")
               & (e["customer_id"] == order["customer_id"]), e["status"])
         .otherwise(st)))
    cents = F.aggregate(additions, order["cents"], lambda total, e: total + F.coalesce(e["cents"], F.lit(0)))
    return F.when(status == "Paid", F.struct(order["day"].alias("day"), cents.alias("cents")))


def stream_sales_view(events: DataFrame, state_dir: str, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    """T5 as a view kept live: Paid orders per day under status changes (U6, U7) and
    growing totals, from a stream of ``order_events``.

    The state row of an order holds its own events with the micro-batch they came in (a
    handful per order).  Staff set any of the four statuses; a customer's cancel takes
    effect on the owner's order while it is Pending (W3), in order of ``seq`` within a
    micro-batch; changes that arrive before their order wait for it; an order that
    arrives twice is placed once.  For each order that got events, the sale without this
    micro-batch's events is taken from its day and the sale with them is added to its day
    (retractions); a micro-batch writes the sums per day.
    """
    now = F.current_timestamp()            # one value per micro-batch, the same when it is retried
    event = F.struct("at", "seq", "kind", "actor", "customer_id", "status", "day", "cents")
    seen = events.withColumn("at", now).groupBy("order_id").agg(F.collect_list(event).alias("e"))
    order = F.array_min(F.filter("e", lambda x: x["kind"] == 0))
    changes = F.array_sort(F.transform(F.filter("e", lambda x: x["kind"] == 1), lambda x: F.struct(
        F.greatest(x["at"], F.col("o.at")).alias("from"), x["seq"].alias("seq"), x["at"].alias("at"),
        x["actor"].alias("actor"), x["customer_id"].alias("customer_id"), x["status"].alias("status"))))
    d = (seen.withColumn("o", order).filter(F.col("o").isNotNull())
             .select("o", changes.alias("c"), F.filter("e", lambda x: x["kind"] == 2).alias("a"), now.alias("now")))
    o = F.col("o")
    old = F.when(o["at"] < F.col("now"), _sale(o, F.filter("c", lambda x: x["at"] < F.col("now")),
                                               F.filter("a", lambda x: x["at"] < F.col("now"))))
    moves = d.select(old.alias("old"), _sale(o, F.col("c"), F.col("a")).alias("new"))
    log = ChangeLog(events.sparkSession, state_dir, ["day"], _DAYS, additive=True)

    def batch(df: DataFrame, batch_id: int) -> None:
        moved = df.filter(~F.col("old").eqNullSafe(F.col("new")))
        each = moved.select(F.explode(F.array(
            F.struct(F.col("old.day").alias("day"), F.lit(-1).alias("n"), (-F.col("old.cents")).alias("cents")),
            F.struct(F.col("new.day").alias("day"), F.lit(1).alias("n"), F.col("new.cents").alias("cents")))).alias("m"))
        days = each.filter(F.col("m.cents").isNotNull()).groupBy(F.col("m.day").alias("day")).agg(
            F.sum("m.n").alias("total_orders"),
            (F.sum(F.col("m.cents").cast("decimal(28,0)")) / 100).cast("decimal(30,2)").alias("total_sales"))
        log.write(days, batch_id)
    return _start(moves.writeStream.outputMode("update").foreachBatch(batch), checkpoint, available_now)


def read_sales_view(spark: SparkSession, state_dir: str) -> DataFrame:
    """Days with a Paid order: (day, total_orders, total_sales)."""
    return ChangeLog(spark, state_dir, ["day"], _DAYS, additive=True).read().filter(F.col("total_orders") > 0)


# ------------------------------------------------------------------ T7

_ALERTS = ("ingredient_id long, ts timestamp_ntz, ref long, before decimal(30,2), after decimal(30,2), "
           "reorder_level decimal(10,2)")


def _cross(key, batches, state):
    """One ingredient's movements of a micro-batch -> crossings, and its new total."""
    import numpy as np
    import pandas as pd
    parts = [pdf for pdf in batches if len(pdf)]
    if not parts:
        return
    ts, ref, delta = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("ts", "ref", "delta"))
    opening, level = int(parts[0]["opening"].iloc[0]), parts[0]["level"].iloc[0]
    order = np.lexsort((ref, ts.astype("datetime64[us]").astype(np.int64)))       # a null time comes first
    ts, ref, delta = ts[order], ref[order], delta[order].astype(np.int64)
    moved = state.get[0] if state.exists else 0
    after = opening + moved + np.cumsum(delta)
    total = int(after[-1]) - opening
    state.update((total,))
    low = np.zeros(0, np.int64) if pd.isna(level) else np.flatnonzero((after - delta > level) & (after <= level))
    n = len(low)
    yield pd.DataFrame({
        "ingredient_id": np.full(n + 1, key[0]), "ts": np.concatenate([ts[low], np.array(["NaT"], ts.dtype)]),
        "ref": np.concatenate([ref[low], [0]]), "before": np.concatenate([(after - delta)[low], [0]]),
        "after": np.concatenate([after[low], [total]]),
        "level": np.full(n + 1, 0 if pd.isna(level) else int(level)), "alert": np.arange(n + 1) < n})


def stream_low_stock(moves: DataFrame, levels: DataFrame, opening: DataFrame, state_dir: str,
                     alerts_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Emit an alert when an ingredient's balance falls to or below its
    reorder level (a crossing: before > level and after <= level).

    ``levels`` (ingredient_id, reorder_level) and ``opening`` (ingredient_id, quantity) are
    static and read anew for every micro-batch, so a changed level counts from the
    next one on.  The total moved per ingredient is keyed state; a micro-batch reads its own
    movements (an ingredient's in one task, in order of ts and ref: the source's limit per
    trigger bounds them) and nothing of what came before.  Crossings go to
    ``alerts_dir/batch=N`` (replaced on retry), the new totals to the changes that
    ``read_balances`` reads.
    """
    spark = moves.sparkSession

    def cents(c, t="decimal(28,0)"):
        return (c * 100).cast(t).cast("long")
    m = (moves.select("ingredient_id", "ts", "ref", cents(F.coalesce("delta", F.lit(0))).alias("delta"))
              .join(levels.select("ingredient_id", cents(F.col("reorder_level")).alias("level")), "ingredient_id", "left")
              .join(opening.select("ingredient_id", cents(F.col("quantity")).alias("opening")), "ingredient_id", "left")
              .fillna(0, ["opening"]))
    found = m.groupBy("ingredient_id").applyInPandasWithState(
        _cross, "ingredient_id long, ts timestamp_ntz, ref long, before long, after long, level long, alert boolean",
        "moved long", "append", "NoTimeout")
    log = _moved_log(spark, state_dir)

    def money(c, t="decimal(30,2)"):
        return (F.col(c).cast("decimal(28,0)") / 100).cast(t)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        (df.filter("alert").select("ingredient_id", "ts", "ref", money("before").alias("before"),
                                   money("after").alias("after"), money("level", "decimal(10,2)").alias("reorder_level"))
           .write.mode("overwrite").parquet(f"{alerts_dir}/batch={batch_id}"))
        log.write(df.filter("NOT alert").select("ingredient_id", money("after").alias("moved")), batch_id)
        df.unpersist()
    return _start(found.writeStream.outputMode("append").foreachBatch(batch), checkpoint, available_now)


def read_alerts(spark: SparkSession, alerts_dir: str) -> DataFrame:
    """T7 read side: all alerts; empty before the first batch."""
    schema = spark.createDataFrame([], _ALERTS).schema
    if not commits.names(spark, alerts_dir):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(alerts_dir).select(*schema.names)


"""Price history of the menu (T6 with U2, U3): versions with the time they hold,
built and merged by batches of changes, and a join of order lines with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import exprs as X
from larder.operators.windows import asof_last, wall_seconds

VALUES = ["price", "discount", "is_available"]
# days that a bin of each level takes, and bins that an interval may take at its level; a bin of the
# last level is longer than the calendar, so an open version takes one (two from before 1970)
LEVEL_DAYS = [1, 32, 1024, 32768, 1 << 22]
BINS = 33
_LAST = "9999-12-31 00:00:00"


def build_history(log: DataFrame) -> DataFrame:
    """(menu_id, valid_from, valid_to, price, discount, is_available) from a change log (menu_id,
    valid_from, price, ...): a version holds in [valid_from, valid_to), the newest for ever
    (valid_to NULL).  Of several versions of an item at one time the one with the greatest
    ``batch`` (0 if there is no such column), then price, discount and availability, counts.

    The next version of each is found by an as-of lookup in falling time, so an item
    with very many versions is spread over tasks.
    """
    batch = F.col("batch") if "batch" in log.columns else F.lit(0)
    v = log.groupBy("menu_id", "valid_from").agg(
        F.max(F.struct(batch.alias("batch"), *VALUES)).alias("_v"))
    back = v.withColumn("_back", -(wall_seconds("valid_from") * 1_000_000 + _micros("valid_from")))
    n = asof_last(back, "menu_id", ["_back"], "valid_from", out="valid_to", inclusive=False)
    return n.select("menu_id", "valid_from", "valid_to", *[F.col(f"_v.{c}").alias(c) for c in VALUES])


def _micros(ts: str) -> Column:
    """Microseconds within the second of a timestamp."""
    return ((F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000) % 1_000_000).cast("long")


def merge_history(history: DataFrame, changes: DataFrame) -> DataFrame:
    """``history`` after a batch of ``changes`` (menu_id, valid_from, price, discount, is_available).

    Only items of the batch are built again, from their versions and the new ones (a change
    may come late, and replaces a version of the same time); all other rows pass
    through.  The distinct items of the batch meet the history once.
    """
    touched = changes.select("menu_id").distinct()
    old = history.join(touched, "menu_id", "left_semi").select("menu_id", "valid_from", *VALUES, F.lit(0).alias("batch"))
    new = changes.select("menu_id", "valid_from", *VALUES, F.lit(1).alias("batch"))
    rest = history.join(touched, "menu_id", "left_anti")
    return rest.unionByName(build_history(old.unionByName(new)))


def version_bins(history: DataFrame) -> DataFrame:
    """(_item, _level, _bin, valid_from, valid_to, ...): a row per time bin that a version takes, at the
    finest level at which it takes at most BINS of them."""
    day = F.floor(wall_seconds("valid_from") / 86400)
    # an open interval ends with the calendar; the last level takes what is longer than BINS bins of the one below
    end = F.coalesce(F.col("valid_to"), F.lit(_LAST).cast("timestamp_ntz"))
    last = F.floor((wall_seconds(end) - 1) / 86400)
    level = F.lit(len(LEVEL_DAYS) - 1)
    for k in reversed(range(len(LEVEL_DAYS) - 1)):
        fits = F.floor(last / LEVEL_DAYS[k]) - F.floor(day / LEVEL_DAYS[k]) < BINS
        level = F.when(fits, F.lit(k)).otherwise(level)
    size = F.element_at(F.array(*[F.lit(d) for d in LEVEL_DAYS]), F.col("_level") + 1)
    return (history.withColumn("_end", end).filter(F.col("valid_from") < F.col("_end"))
                .withColumn("_level", level)
                .withColumn("_bin", F.explode(F.sequence(F.floor(day / size), F.floor(last / size))))
                .select(F.col("menu_id").alias("_item"), "_level", "_bin", "valid_from", "valid_to", *VALUES))


def price_from_history(lines: DataFrame, history: DataFrame) -> DataFrame:
    """T6 by an interval join: lines (order_item_id, menu_id, order_date) with the version that
    held at order time; result as ``stock.price_as_of``.

    A version is put into time bins of the finest level at which it takes at most
    BINS of them; a line looks into its one bin of each level.  The join is on (item, level, bin),
    so neither a busy item nor a long interval meets more than its bins, and no row
    is compared with all versions.  Both sides are shuffled: from the size of a compressed
    history the planner cannot tell that its bins are too many to send to every task.
    """
    versions = version_bins(history).hint("merge")
    at = F.floor(wall_seconds("order_date") / 86400)
    looks = lines.select("order_item_id", "menu_id", "order_date", F.explode(F.array(*[
        F.struct(F.lit(k).alias("_level"), F.floor(at / d).alias("_bin")) for k, d in enumerate(LEVEL_DAYS)])).alias("_l"))
    found = looks.join(versions, (looks["menu_id"] == versions["_item"]) & (looks["_l._level"] == versions["_level"])
                       & (looks["_l._bin"] == versions["_bin"]) & (looks["order_date"] >= versions["valid_from"])
                       & (versions["valid_to"].isNull() | (looks["order_date"] < versions["valid_to"])))
    cur = found.select(F.col("order_item_id").alias("_id"), *VALUES)
    ok = F.col("is_available") == 1
    return lines.join(cur, F.col("order_item_id") == F.col("_id"), "left").select(
        "order_item_id", "menu_id", "order_date",
        F.when(ok, X.final_price(F.col("price"), F.col("discount"))).alias("price"),
        F.coalesce(ok, F.lit(False)).alias("available"))

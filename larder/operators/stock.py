"""Stock keeping (T1, T2, T3, T6): the reference's triggers and its order
transaction as batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import exprs as X
from larder.operators.aggregates import cart_lines
from larder.operators.components import components
from larder.operators.filters import first_waiter
from larder.operators.windows import (asof_last, assign_ids, next_id_base, running_total,
                                      seq_chunk, wall_seconds)
from larder.session import cut_lineage, stored
from larder.sources.commits import Store


# ------------------------------------------------------------------ T1

def apply_purchases(ingredients: DataFrame, purchases: DataFrame) -> DataFrame:
    """Quantity += Σ purchased quantity per ingredient (one partial
    aggregate, then a join of one row per ingredient)."""
    add = purchases.groupBy("ingredient_id").agg(F.sum("quantity").alias("_add"))
    j = ingredients.join(add, "ingredient_id", "left")
    return j.withColumn("quantity", X.to_total(F.col("quantity") + F.coalesce("_add", F.lit(0)))) \
            .select(*ingredients.columns)


# ------------------------------------------------------------------ T2

def recipe_use(order_items: DataFrame, recipes: DataFrame) -> DataFrame:
    """Σ qty_required × quantity per ingredient.

    Lines are first summed per menu item (a hot item collapses map-side), then
    joined with the recipes and summed per ingredient.
    """
    sold = order_items.groupBy("menu_id").agg(F.sum("quantity").alias("_q"))
    return (sold.join(recipes, "menu_id")
                .groupBy("ingredient_id")
                .agg(F.sum(F.col("qty_required") * F.col("_q")).alias("used")))


def apply_order_items(ingredients: DataFrame, orders: DataFrame, order_items: DataFrame,
                      recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stock -= recipe use of the lines; order total += Σ price × quantity.

    Items without a recipe deduct nothing.  Returns (ingredients, orders).
    No CHECK here — admission against stock is T3.
    """
    use = recipe_use(order_items, recipes)
    ing = (ingredients.join(use, "ingredient_id", "left")
                      .withColumn("quantity",
                                  X.to_total(F.col("quantity") - F.coalesce("used", F.lit(0))))
                      .select(*ingredients.columns))
    add = order_items.groupBy("order_id").agg(F.sum(X.line_subtotal()).alias("_add"))
    o = (orders.join(add, "order_id", "left")
               .withColumn("total_amount",
                           X.to_total(F.col("total_amount") + F.coalesce("_add", F.lit(0))))
               .select(*orders.columns))
    return ing, o


# ------------------------------------------------------------------ T3

# need rows (order x ingredient) that are decided as one component at once
SERIAL_ROWS = 100_000
# rounds of bounds at most before the rest is decided by components; more while MANY_OPEN need rows
# or more are open and two rounds decide a quarter of them
BOUND_ROUNDS = 4
MANY_OPEN = 1_000_000


def _conflicts(und: DataFrame, serial_rows: int, n_rows: int) -> DataFrame:
    """Undecided rows (seq, ingredient_id, need, low, up) with the ``component`` of their
    order: orders that share an ingredient which may refuse someone are in one.

    An ingredient whose lower bound never falls below 0 refuses nobody, so its rows
    neither connect orders nor decide anything.  ``serial_rows`` or fewer rows are one
    component at once (it changes no result).
    """
    scarce = und.groupBy("ingredient_id").agg(F.min("low").alias("_lo")).filter("_lo < 0").select("ingredient_id")
    rows = cut_lineage(und.join(scarce, "ingredient_id", "left_semi").select("seq", "ingredient_id", "need", "up"))
    if n_rows <= serial_rows:
        return rows.withColumn("component", F.lit(0).cast("long"))
    first = rows.groupBy("seq").agg(F.min("ingredient_id").alias("b"))
    edges = rows.select("seq", F.col("ingredient_id").alias("a")).join(first, "seq").select("a", "b").distinct()
    label = components(edges).select(F.col("node").alias("ingredient_id"), "component")
    return rows.join(label, "ingredient_id")


def _decide_in_order(rows: DataFrame) -> DataFrame:
    """(seq, st) of the orders in ``rows`` (component, seq, ingredient_id, need, up), each component in request order
    in one task: an order is accepted iff ``up`` less what earlier orders of its component
    took covers each of its needs.  Rows are streamed in order; a task remembers what was
    taken of the ingredients of one component."""
    def run(batches):
        import pyarrow as pa
        component = seq = None
        taken: dict = {}
        lines: list = []

        def decided():
            ok = all(up - taken.get(i, 0) - need >= 0 for i, need, up in lines)
            if ok:
                for i, need, _ in lines:
                    taken[i] = taken.get(i, 0) + need
            return "A" if ok else "R"
        for b in batches:
            seqs, states = [], []
            for c, s, i, need, up in zip(*[b.column(x).to_pylist() for x in (
                    "component", "seq", "ingredient_id", "need", "up")]):
                if (c, s) != (component, seq):
                    if lines:
                        seqs.append(seq)
                        states.append(decided())
                    if c != component:
                        taken.clear()
                    component, seq = c, s
                    lines.clear()
                lines.append((i, need, up))
            yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.int64()), "st": pa.array(states, pa.string())})
        if lines:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.int64()), "st": pa.array([decided()])})
    return (rows.select("component", "seq", "ingredient_id", "need", "up").repartition("component")
                .sortWithinPartitions("component", "seq", "ingredient_id").mapInArrow(run, "seq long, st string"))


def _rounds_end(opened: list[int]) -> bool:
    """Whether rounds of bounds no longer pay; ``opened`` has the open need rows at the start of each.  A
    few rows: after BOUND_ROUNDS rounds, or when one did not halve them.  MANY_OPEN or more are too
    many for one task, should they all compete: rounds go on until two of them decide less than a quarter."""
    if opened[-1] < MANY_OPEN:
        return len(opened) > BOUND_ROUNDS or (len(opened) > 1 and opened[-1] > opened[-2] / 2)
    return len(opened) > 2 and opened[-1] > 0.75 * opened[-3]


def place_orders(requests: DataFrame, menu_items: DataFrame, recipes: DataFrame,
                 ingredients: DataFrame, employees: DataFrame, orders: DataFrame,
                 order_items: DataFrame, restocks: DataFrame | None = None,
                 chunk_size: int = 1 << 16, serial_rows: int = SERIAL_ROWS,
                 first_order_id: int | None = None, first_line_id: int | None = None) -> "Placement":
    """Order requests -> accepted orders, their lines, stock after; or a
    rejection with a reason.

    ``requests`` (seq, customer_id, ts, cart map<menu_id, struct<name, qty>>)
    are handled in ``seq`` order, as the reference's transaction would:
    an empty cart places nothing; a missing or unavailable item rejects the
    whole order; so does a quantity of 0 or less; an order that would take any ingredient below 0 is rejected
    whole and uses nothing.  ``restocks`` (seq, ingredient_id, quantity)
    arrive between orders.

    Exact and distributed.  An ingredient whose opening stock covers all demand (and
    all negative restocks) refuses nobody and is left out.  For the others, stock before an undecided order u lies between
      lower = opening + restocks − needs of (accepted ∪ undecided) before u
      upper = opening + restocks − needs of accepted before u.
    u is certainly accepted when lower − need ≥ 0 for all its ingredients,
    certainly rejected when upper − need < 0 for one.  A round is two running
    sums per ingredient (two-level, skew-safe) and an aggregate per order.  After a
    round everything before an ingredient's first undecided order is folded into its
    opening balance, and ingredients without undecided orders are dropped.  Rounds go on
    while they pay (``_rounds_end``); then the rest is decided at once:
    orders that compete for an ingredient, directly or through others, are one
    component, and every component is decided in request order in its own task.  Orders on
    many ingredients are often one large component, so rounds have to bring it below
    MANY_OPEN rows first, in a number that grows with the logarithm of the rows.  Only needs for
    ingredients that can refuse an order are ever made; the requests are read once, and lines,
    requests and outcomes are written to the shared folder, as are the rounds.
    """
    requests = stored(requests.select("seq", "customer_id", "ts", F.transform_values(
        "cart", lambda _, line: F.struct(line["qty"].alias("qty"))).alias("cart")), "requests")
    lines = cart_lines(requests.withColumnRenamed("seq", "cart_id")) \
        .withColumnRenamed("cart_id", "seq")
    m = menu_items.select("menu_id", "is_available", X.final_price().alias("unit_price"))
    lj = stored(lines.join(m, "menu_id", "left"), "request-lines")
    per_req = lj.groupBy("seq").agg(
        F.count_if(F.coalesce(F.col("is_available"), F.lit(0)) != 1).alias("_bad"),
        F.count_if(~F.coalesce(F.col("qty") > 0, F.lit(False))).alias("_neg"),
        F.sum(F.col("unit_price") * F.col("qty")).alias("total"))
    req = requests.select("seq", "customer_id", "ts").join(per_req, "seq", "left")
    reason0 = (F.when(F.col("_bad").isNull(), F.lit("empty cart"))
                .when(F.col("_bad") > 0, F.lit("item not available"))
                .when(F.col("_neg") > 0, F.lit("quantity must be above 0")))
    req = stored(req.withColumn("reason", reason0).drop("_bad", "_neg"), "requests-checked")

    cand = req.filter(F.col("reason").isNull()).select("seq")
    wanted = lj.join(cand, "seq", "left_semi").select("seq", "menu_id", "qty")
    rs = (restocks.select("seq", "ingredient_id", F.col("quantity").alias("q"))
          if restocks is not None else None)

    # ingredients that can refuse an order
    demand = recipe_use(wanted.withColumnRenamed("qty", "quantity"), recipes).select(
        "ingredient_id", F.col("used").alias("_d"))
    if rs is not None:
        demand = demand.unionByName(rs.select("ingredient_id", F.greatest(-F.col("q"), F.lit(0)).alias("_d")))
    demand = demand.groupBy("ingredient_id").agg(F.sum("_d").alias("_d"))
    scarce = (demand.join(ingredients.select("ingredient_id", "quantity"), "ingredient_id", "left")
                    .filter(F.col("_d") > F.coalesce("quantity", F.lit(0))).select("ingredient_id"))
    contended = cut_lineage(wanted.join(recipes.join(scarce, "ingredient_id", "left_semi"), "menu_id")
                                  .groupBy("seq", "ingredient_id")
                                  .agg(F.sum(F.col("qty_required") * F.col("qty")).alias("need")))

    # open movements (kind 0 restock, 1 order need), U undecided / A accepted / S stock
    kind = "decimal(20,4)"
    state = contended.select("ingredient_id", "seq", F.lit(1).alias("kind"), F.lit("U").alias("st"),
                             (-F.col("need")).cast(kind).alias("v"))
    used = contended.select("ingredient_id").distinct()
    opening = ingredients.join(used, "ingredient_id", "right").select(
        "ingredient_id", F.coalesce("quantity", F.lit(0)).cast(kind).alias("base"))
    if rs is not None:
        state = state.unionByName(rs.join(used, "ingredient_id", "left_semi").select(
            "ingredient_id", "seq", F.lit(0).alias("kind"), F.lit("S").alias("st"),
            F.col("q").cast(kind).alias("v")))
    # an order that competes for nothing is accepted
    done = cand.join(contended.select("seq").distinct(), "seq", "left_anti").select(
        "seq", F.lit("A").alias("st"))
    rounds, opened = [], []
    while True:
        n, n_open = state.agg(F.count(F.lit(1)), F.count_if(F.col("st") == "U")).first()
        if not n_open:
            break
        rounds.append(n)
        opened.append(n_open)
        run = running_total(
            state.withColumn("v_up", F.when(F.col("st") == "U", F.lit(0).cast(kind))
                             .otherwise(F.col("v"))),
            "ingredient_id", ["seq", "kind"], ["v", "v_up"], seq_chunk("seq", chunk_size),
            out=["low_run", "up_run"])
        und = run.filter(F.col("st") == "U").join(opening, "ingredient_id").select(
            "seq", "ingredient_id", (-F.col("v")).alias("need"),
            (F.col("base") + F.col("low_run")).alias("low"),          # own need included
            (F.col("base") + F.col("up_run")).alias("up"))            # before the own need
        if n_open <= serial_rows or _rounds_end(opened):
            und = cut_lineage(und)
            rest = cut_lineage(_decide_in_order(_conflicts(und, serial_rows, n_open)))
            free = und.select("seq").distinct().join(rest, "seq", "left_anti")
            done = done.unionByName(rest).unionByName(free.select("seq", F.lit("A").alias("st")))
            break
        verdict = und.groupBy("seq").agg(F.min("low").alias("_lo"),
                                         F.min(F.col("up") - F.col("need")).alias("_up"))
        decided = cut_lineage(verdict.select(
            "seq", F.when(F.col("_lo") >= 0, "A").when(F.col("_up") < 0, "R").alias("st"))
            .filter(F.col("st").isNotNull()))
        done = done.unionByName(decided)
        state = (state.join(decided.withColumnRenamed("st", "_new"), "seq", "left")
                      .withColumn("st", F.when(F.col("st") == "U", F.coalesce("_new", "st"))
                                  .otherwise(F.col("st")))
                      .filter(F.col("st") != "R").drop("_new"))
        first = (state.filter(F.col("st") == "U").groupBy("ingredient_id")
                      .agg(F.min("seq").alias("_f")))
        state = cut_lineage(state.join(first, "ingredient_id"))
        folded = (state.filter(F.col("seq") < F.col("_f")).groupBy("ingredient_id")
                       .agg(F.sum("v").alias("_v")))
        opening = cut_lineage(
            opening.join(state.select("ingredient_id").distinct(), "ingredient_id", "left_semi")
                   .join(folded, "ingredient_id", "left")
                   .select("ingredient_id",
                           (F.col("base") + F.coalesce("_v", F.lit(0))).cast(kind).alias("base")))
        state = state.filter(F.col("seq") >= F.col("_f")).drop("_f")
    outcome = stored(req.join(done, "seq", "left")
                        .withColumn("reason", F.coalesce(
                            "reason", F.when(F.col("st") == "R", F.lit("not enough stock"))))
                        .withColumn("accepted", F.col("reason").isNull()).drop("st"), "outcomes")
    acc = outcome.filter("accepted")
    acc = assign_ids(acc, ["seq"], out="order_id",
                     start=next_id_base(orders, "order_id") if first_order_id is None else first_order_id)

    def new_orders():
        waiter = first_waiter(employees).select("employee_id").scalar()  # scalar subquery
        return acc.select("order_id", "customer_id", waiter.alias("employee_id"),
                          F.col("ts").cast("timestamp_ntz").alias("order_date"),
                          F.lit("Pending").alias("status"),
                          X.to_total("total").alias("total_amount"))

    def new_lines():
        lines_ = (lj.join(acc.select("seq", "order_id"), "seq")
                    .select("order_id", "menu_id", F.col("qty").cast("int").alias("quantity"),
                            X.to_money("unit_price").alias("price"), "seq"))
        return assign_ids(lines_, ["seq", "menu_id"], out="order_item_id",
                          start=next_id_base(order_items, "order_item_id") if first_line_id is None
                          else first_line_id).drop("seq")

    def stock_after():
        taken = lj.join(acc.select("seq"), "seq", "left_semi").select("menu_id", F.col("qty").alias("quantity"))
        used = recipe_use(taken, recipes).withColumnRenamed("used", "_u")
        st = ingredients.join(used, "ingredient_id", "left")
        if rs is not None:
            st = st.join(rs.groupBy("ingredient_id").agg(F.sum("q").alias("_r")),
                         "ingredient_id", "left")
        else:
            st = st.withColumn("_r", F.lit(0))
        return st.withColumn("quantity", X.to_total(
            F.col("quantity") + F.coalesce("_r", F.lit(0)) - F.coalesce("_u", F.lit(0)))) \
            .select(*ingredients.columns)

    out = outcome.join(acc.select("seq", "order_id"), "seq", "left").select(
        "seq", "customer_id", "accepted", "reason", "order_id",
        F.when(F.col("accepted"), F.col("total")).alias("total"))
    return Placement(out, rounds, {"orders": new_orders, "order_items": new_lines,
                                   "ingredients": stock_after})


class Placement:
    """Result of ``place_orders``: ``outcomes`` and ``rounds`` (movements read per round) at once; the new
    ``orders``, ``order_items`` (with ids) and ``ingredients`` (stock after)
    are built on first access."""

    def __init__(self, outcomes: DataFrame, rounds: list[int], lazy: dict):
        self._parts = {"outcomes": outcomes, "rounds": rounds}
        self._lazy = lazy

    def __getitem__(self, key):
        if key not in self._parts:
            self._parts[key] = self._lazy[key]()
        return self._parts[key]


def commit_orders(store: Store, requests: DataFrame, menu_items: DataFrame, recipes: DataFrame,
                  employees: DataFrame, batch: str, restocks: DataFrame | None = None, attempts: int = 5) -> int:
    """T3 with one commit (S9): place ``requests`` against the newest ``ingredients`` of the store
    and make its new ``orders``, ``order_items`` and stock visible together, with the outcomes
    in table ``outcomes``; the number of the commit.

    Ids go on from the highest ever given out (W2).  If another writer changed the stock or
    the ids meanwhile, the requests are placed again on what that one left; a batch
    that is already committed changes nothing.
    """
    def job(s):
        if batch in s.batches:
            return {"batch": batch}
        ids = {"orders": s.next_id("orders", "order_id"), "order_items": s.next_id("order_items", "order_item_id")}
        p = place_orders(requests, menu_items, recipes, s.read("ingredients"), employees, s.read("orders"),
                         s.read("order_items"), restocks, first_order_id=ids["orders"], first_line_id=ids["order_items"])
        orders, lines = cut_lineage(p["orders"]), cut_lineage(p["order_items"])
        last = {"orders": ids["orders"] - 1 + orders.count(), "order_items": ids["order_items"] - 1 + lines.count()}
        return {"append": {"orders": orders, "order_items": lines, "outcomes": p["outcomes"]},
                "replace": {"ingredients": p["ingredients"]}, "last_ids": last, "batch": batch}
    return store.transact(job, attempts)


# ------------------------------------------------------------------ T6

def price_as_of(lines: DataFrame, price_log: DataFrame, chunk_seconds: int | None = None) -> DataFrame:
    """Price of each order line from the menu version valid at order time.

    ``lines`` (order_item_id, menu_id, order_date); ``price_log`` (menu_id,
    valid_from, price, discount, is_available).  The version is the last one
    with valid_from <= order_date (an as-of lookup per menu item, two-level so
    a busy item is spread over range-partition chunks, or time chunks of
    ``chunk_seconds``).  The line price is the final
    price of that version; NULL when the item was unavailable or had no
    version yet (the order would have been refused).
    """
    log = price_log.select("menu_id", F.col("valid_from").alias("t"), F.lit(0).alias("kind"),
                           F.lit(None).cast("long").alias("order_item_id"),
                           F.struct("price", "discount", "is_available").alias("ver"))
    ls = lines.select("menu_id", F.col("order_date").alias("t"), F.lit(1).alias("kind"),
                      "order_item_id",
                      F.lit(None).cast(log.schema["ver"].dataType).alias("ver"))
    u = log.unionByName(ls)
    chunk = (None if chunk_seconds is None
             else F.floor(wall_seconds("t") / chunk_seconds))
    a = asof_last(u, "menu_id", ["t", "kind", "order_item_id"], "ver", chunk, out="cur")
    a = a.filter(F.col("kind") == 1)
    ok = F.col("cur.is_available") == 1
    return a.select("order_item_id", "menu_id", F.col("t").alias("order_date"),
                    F.when(ok, X.final_price(F.col("cur.price"), F.col("cur.discount")))
                     .alias("price"),
                    F.coalesce(ok, F.lit(False)).alias("available"))

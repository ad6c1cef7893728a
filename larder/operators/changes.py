"""Table changes (U1-U11): form actions as batch jobs over change tables.

Built-in parquet tables cannot UPDATE / DELETE / MERGE, so each change is
``DataFrame -> DataFrame`` (the table after the change, plus per-request
outcomes); ``larder.sources.sinks`` persists a new version atomically.

Batch semantics of a change table: rows are requests in ``seq`` order, and
the result equals applying them one by one: the last valid update per key
wins, a repeated delete finds nothing, a delete frees a name for later
inserts, and requests on a row inserted in the batch count only after the
insert.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import quality as Q
from larder.operators.windows import HOT_ROWS, asof_last, assign_ids, next_id_base, split_hot
from larder.schemas import ORDER_STATUSES, conform
from larder.session import cut_lineage

_NEVER = 1 << 62          # the seq of a delete that does not happen


def _first_per_name(a: DataFrame, existing: DataFrame) -> DataFrame:
    """Reason 'name exists' / 'duplicate name in batch' for insert requests.

    Only requests that pass their form rules compete for a name; the first
    (lowest seq) wins.  All steps are aggregates and joins on the name.
    """
    names = existing.select("name").distinct().withColumn("_kept", F.lit(True))
    a = a.join(names, "name", "left")
    a = a.withColumn("reason", F.coalesce("reason", F.when(F.col("_kept"), F.lit("name exists"))))
    first = (a.filter(F.col("reason").isNull()).groupBy("name")
              .agg(F.min("seq").alias("_first")))
    a = a.join(first, "name", "left")
    return (a.withColumn("reason", F.coalesce(
                "reason", F.when(F.col("seq") != F.col("_first"),
                                 F.lit("duplicate name in batch"))))
             .drop("_kept", "_first"))


def _insert_with_ids(table: DataFrame, accepted: DataFrame, id_col: str) -> DataFrame:
    """New ids max(existing)+1.. in seq order."""
    return assign_ids(accepted, ["seq"], start=next_id_base(table, id_col), out=id_col)


# ------------------------------------------------------------------ U1

def menu_insert(menu_items: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add food.  Returns (menu_items after, outcomes(seq, name, menu_id, reason)).

    Name is trimmed; form rules (D5) apply; a name that exists or was taken by
    an earlier request of the batch is rejected; accepted rows get new ids
    and ``is_available = 1``.
    """
    a = adds.select("seq", F.trim("name").alias("name"), "category", "price", "discount")
    a = Q.with_reason(a, Q.menu_form_rules())
    a = _first_per_name(a, menu_items)
    ok = _insert_with_ids(menu_items, a.filter(F.col("reason").isNull()), "menu_id")
    new_rows = conform(ok.withColumn("is_available", F.lit(1)), "menu_items")
    outcomes = a.join(ok.select("seq", "menu_id"), "seq", "left").select(
        "seq", "name", "menu_id", "reason")
    return menu_items.unionByName(new_rows), outcomes


# ------------------------------------------------------------------ U2

def menu_update(menu_items: DataFrame, updates: DataFrame) -> DataFrame:
    """Set price, discount, availability by id (an absent tick is 0).

    Invalid requests are dropped (D5); the last valid request per id wins
    (``max_by`` over seq, a partial aggregate); unknown ids change nothing.
    """
    u = Q.with_reason(updates, Q.menu_update_rules()).filter(F.col("reason").isNull())
    last = u.groupBy("menu_id").agg(F.max_by(
        F.struct("price", "discount", F.coalesce("is_available", F.lit(0)).alias("avail")),
        "seq").alias("_u"))
    j = menu_items.join(last, "menu_id", "left")
    hit = F.col("_u").isNotNull()
    return j.select(
        "menu_id", "name", "category",
        F.when(hit, F.col("_u.price")).otherwise(F.col("price")).cast("decimal(10,2)").alias("price"),
        F.when(hit, F.col("_u.discount")).otherwise(F.col("discount")).cast("decimal(5,2)")
         .alias("discount"),
        F.when(hit, F.col("_u.avail")).otherwise(F.col("is_available")).cast("int")
         .alias("is_available"))


# ------------------------------------------------------------------ U3

def category_price_up(menu_items: DataFrame, category: str, factor: str = "1.10") -> DataFrame:
    """U3 (Q4): price * factor for one category, stored back as DECIMAL(10,2)."""
    f = F.lit(Decimal(factor))
    return menu_items.withColumn(
        "price", F.when(F.col("category") == category, (F.col("price") * f).cast("decimal(10,2)"))
                  .otherwise(F.col("price")))


# ------------------------------------------------------------------ U4, U9-U11 (deletes)

def delete_requests(parent: DataFrame, key: str, requests: DataFrame,
                    restrict: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """U11 core: outcome per delete request (``seq`` optional, ``key``).

    ``restrict`` lists (child, child column, label): a parent referenced by
    any child is refused (ON DELETE RESTRICT).  Outcome is 'deleted',
    'refused: <label>' or 'not found' — with a ``seq`` column, a repeated
    delete of a key already deleted is 'not found'.  Each check is a semi
    join of the requested keys against the child's keys.
    """
    found = parent.select(key).distinct().withColumn("_f", F.lit(True))
    r = requests.join(found, key, "left")
    outcome = F.when(F.col("_f").isNull(), F.lit("not found"))
    for i, (child, col, label) in enumerate(restrict):
        refs = (child.select(F.col(col).alias(key)).filter(F.col(key).isNotNull()).distinct()
                     .join(requests.select(key).distinct(), key, "left_semi")
                     .withColumn(f"_r{i}", F.lit(True)))
        r = r.join(refs, key, "left")
        outcome = outcome.when(F.col(f"_r{i}"), F.lit(f"refused: {label}"))
    outcome = outcome.otherwise(F.lit("deleted"))
    keep = [c for c in requests.columns]
    out = r.select(*keep, outcome.alias("outcome"))
    if "seq" not in requests.columns:
        return out
    # in request order only the first successful delete of a key finds it
    first = (out.filter(F.col("outcome") == "deleted").groupBy(key)
                .agg(F.min("seq").alias("_first")))
    return (out.join(first, key, "left")
               .withColumn("outcome", F.when((F.col("outcome") == "deleted")
                                             & (F.col("seq") != F.col("_first")),
                                             F.lit("not found")).otherwise(F.col("outcome")))
               .select(*keep, "outcome"))


def remove_keys(df: DataFrame, col: str, deleted: DataFrame, key: str | None = None) -> DataFrame:
    """U9 (ON DELETE CASCADE) / plain delete: rows whose ``col`` is deleted go."""
    k = key or col
    return df.join(deleted.select(F.col(k).alias(col)), col, "left_anti")


def set_null_keys(df: DataFrame, col: str, deleted: DataFrame, key: str | None = None) -> DataFrame:
    """U10 (ON DELETE SET NULL): references to deleted keys become NULL."""
    k = key or col
    gone = deleted.select(F.col(k).alias(col)).distinct().withColumn("_gone", F.lit(True))
    out = df.join(gone, col, "left")
    return out.withColumn(col, F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(col))) \
              .select(*df.columns)


def menu_delete(menu_items: DataFrame, recipes: DataFrame, order_items: DataFrame,
                requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U4 per request: refused when the item was sold; recipes cascade.

    Returns (menu_items after, recipes after, outcomes).
    """
    out = delete_requests(menu_items, "menu_id", requests, [(order_items, "menu_id", "sold before")])
    gone = out.filter(F.col("outcome") == "deleted").select("menu_id")
    return remove_keys(menu_items, "menu_id", gone), remove_keys(recipes, "menu_id", gone), out


def menu_delete_where(menu_items: DataFrame, recipes: DataFrame, order_items: DataFrame,
                      condition: Column) -> tuple[DataFrame, DataFrame, Column]:
    """U4 as one statement (Q5): if any targeted item was sold the statement
    fails and nothing is deleted.  Returns (menu after, recipes after,
    blocked flag as a scalar Column)."""
    targets = menu_items.filter(condition).select("menu_id")
    blocked = (targets.join(order_items.select("menu_id").distinct(), "menu_id", "left_semi")
                      .select(F.count(F.lit(1)) > 0).scalar())
    gone = targets.filter(~blocked)
    return (remove_keys(menu_items, "menu_id", gone), remove_keys(recipes, "menu_id", gone),
            blocked)


def delete_customers(customers: DataFrame, users: DataFrame, orders: DataFrame,
                     deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customer delete: users cascade (U9), orders keep with NULL customer."""
    return (remove_keys(customers, "customer_id", deleted),
            remove_keys(users, "customer_id", deleted),
            set_null_keys(orders, "customer_id", deleted))


def delete_suppliers(suppliers: DataFrame, ingredients: DataFrame, purchases: DataFrame,
                     requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Supplier delete: refused if a purchase references it (U11); otherwise
    the supplier goes and its ingredients keep a NULL supplier (U10)."""
    out = delete_requests(suppliers, "supplier_id", requests,
                          [(purchases, "supplier_id", "referenced by purchases")])
    gone = out.filter(F.col("outcome") == "deleted").select("supplier_id")
    return (remove_keys(suppliers, "supplier_id", gone),
            set_null_keys(ingredients, "supplier_id", gone), out)


def delete_orders(orders: DataFrame, order_items: DataFrame,
                  deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order delete: its lines cascade."""
    return (remove_keys(orders, "order_id", deleted),
            remove_keys(order_items, "order_id", deleted))


def delete_employees(employees: DataFrame, orders: DataFrame,
                     requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Employee delete: refused while an order names the employee."""
    out = delete_requests(employees, "employee_id", requests,
                          [(orders, "employee_id", "referenced by orders")])
    gone = out.filter(F.col("outcome") == "deleted").select("employee_id")
    return remove_keys(employees, "employee_id", gone), out


def purchase_insert(purchases: DataFrame, suppliers: DataFrame, ingredients: DataFrame,
                    requests: DataFrame, run_date) -> tuple[DataFrame, DataFrame]:
    """Purchase forms (D5, D4, W2): (accepted rows with ids, outcomes(seq, reason)).

    Form rules first, then the supplier and the ingredient must exist; a
    missing purchase date becomes ``run_date`` (the day of the run, given by
    the caller so that a rerun gives the same rows).
    """
    r = Q.with_reason(requests, Q.purchase_form_rules())
    for parent, col, label in ((suppliers, "supplier_id", "supplier not found"),
                               (ingredients, "ingredient_id", "ingredient not found")):
        keys = parent.select(col).distinct().withColumn("_f", F.lit(True))
        r = r.join(keys, col, "left").withColumn("reason", F.coalesce(
            "reason", F.when(F.col("_f").isNull(), F.lit(label)))).drop("_f")
    r = r.withColumn("purchase_date", F.coalesce("purchase_date", F.lit(run_date).cast("date")))
    ok = assign_ids(r.filter(F.col("reason").isNull()), ["seq"],
                    start=next_id_base(purchases, "purchase_id"), out="purchase_id")
    return conform(ok, "purchases"), r.select("seq", "reason")


# ------------------------------------------------------------------ U5

def _batch_adds(table: DataFrame, key: str, adds: DataFrame, freed: DataFrame,
                dels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted adds with ids and the seq of their delete (``_del``, or NULL), and
    every add with its reason.

    ``adds`` carry a form-rule ``reason``; ``freed`` (key, _del) are existing rows deleted in
    the batch; ``dels`` (seq, key) are deletes of ids that do not exist yet.  An
    add finds its name taken by an existing row not yet deleted, or by the last
    accepted add of the name before it unless that row was deleted in
    between.  Which ids the adds get decides which deletes hit them, so the
    accepted set is recomputed from the one before until it stays: once, if no
    delete can hit a new row, else once more per link of
    add - delete - add chains.
    """
    e = table.select(key, "name").join(freed, key, "left")
    names = e.groupBy("name").agg((F.count_if(F.col("_del").isNull()) > 0).alias("_kept"),
                                  F.max("_del").alias("_free"))
    a = adds.join(names, "name", "left")
    exists = F.coalesce(F.col("_kept"), F.lit(False)) | \
        F.coalesce(F.col("_free") > F.col("seq"), F.lit(False))
    a = cut_lineage(a.withColumn("reason", F.coalesce(
        "reason", F.when(exists, F.lit("name exists")))).drop("_kept", "_free"))
    cand = a.filter(F.col("reason").isNull())
    base = next_id_base(table, key)

    def with_ids(ok: DataFrame) -> DataFrame:
        ok = assign_ids(ok, ["seq"], start=base, out=key)
        hit = (dels.withColumnRenamed("seq", "_d")
                   .join(ok.select(key, F.col("seq").alias("_a")), key)
                   .filter(F.col("_d") > F.col("_a")).groupBy(key).agg(F.min("_d").alias("_del")))
        return ok.join(hit, key, "left")

    first = cand.groupBy("name").agg(F.min("seq").alias("_first"))
    ok = with_ids(cand.join(first, "name").filter(F.col("seq") == F.col("_first")).drop("_first"))
    if dels.limit(1).count():
        seen = None
        while True:
            ok = cut_lineage(ok)
            now = tuple(ok.agg(F.count(F.lit(1)),
                               F.sum(F.xxhash64("seq", "_del").cast("decimal(38,0)"))).first())
            if now == seen:
                break
            seen = now
            held = ok.select("seq", F.struct(F.coalesce("_del", F.lit(_NEVER)).alias("d"))
                             .alias("_hold"))
            last = asof_last(cand.join(held, "seq", "left"), "name", ["seq"], "_hold",
                             out="_prev", inclusive=False)
            free = last.filter(F.col("_prev").isNull() | (F.col("_prev.d") < F.col("seq")))
            ok = with_ids(free.drop("_hold", "_prev"))
    taken = ok.select("seq", F.lit(True).alias("_ok"))
    a = a.join(taken, "seq", "left").withColumn("reason", F.coalesce(
        "reason", F.when(F.col("_ok").isNull(), F.lit("duplicate name in batch")))).drop("_ok")
    return ok, a


def apply_batch(table: DataFrame, table_name: str, key: str, changes: DataFrame,
                add_rules: list, update_rules: list, update_cols: dict[str, Column],
                restrict: list[tuple[DataFrame, str, str]],
                add_defaults: dict[str, Column] | None = None
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply one batch of add / update / delete requests to ``table``.

    Returns (table after, deleted keys, outcomes(seq, op, key, reason)).
    The result is that of applying the requests one by one in ``seq`` order: a delete
    frees its row's name for later adds and a repeated delete
    finds nothing; adds are checked for a free name and get ids max+1.. in seq
    order; updates and deletes of a row added in the batch count only after
    its add; the last valid update wins.
    """
    pre_ids = table.select(key).distinct()
    dels = changes.filter(F.col("op") == "delete").select("seq", key)
    d_pre = delete_requests(table, key, dels.join(pre_ids, key, "left_semi"), restrict)
    first_del = cut_lineage(d_pre.filter(F.col("outcome") == "deleted")
                            .select(key, F.col("seq").alias("_del")))

    schema_cols = [c for c in table.columns if c != key]
    adds = changes.filter(F.col("op") == "add").select(
        "seq", *[F.trim("name").alias("name") if c == "name" else F.col(c)
                 for c in schema_cols if c in changes.columns])
    later = dels.filter(F.col(key) >= next_id_base(table, key))
    ok, adds = _batch_adds(table, key, Q.with_reason(adds, add_rules), first_del, later)
    ok = cut_lineage(ok)
    if add_defaults:
        ok = ok.withColumns(add_defaults)
    new_ids = ok.select(key, F.col("seq").alias("_add"))

    first_new = ok.filter(F.col("_del").isNotNull()).select(key, "_del")
    d_new = (dels.join(pre_ids, key, "left_anti").join(first_new, key, "left")
                 .select("seq", key, F.when(F.col("seq") == F.col("_del"), F.lit("deleted"))
                         .otherwise(F.lit("not found")).alias("outcome")))
    gone = first_del.select(key).unionByName(first_new.select(key))

    ups = Q.with_reason(changes.filter(F.col("op") == "update"), update_rules)
    valid = (ups.filter(F.col("reason").isNull()).join(new_ids, key, "left")
                .filter(F.col("_add").isNull() | (F.col("seq") > F.col("_add"))))
    last = valid.groupBy(key).agg(F.max_by(
        F.struct(*[c.alias(n) for n, c in update_cols.items()]), "seq").alias("_u"))
    after = table.unionByName(conform(ok, table_name)).join(last, key, "left")
    hit = F.col("_u").isNotNull()
    types = {f.name: f.dataType for f in table.schema.fields}
    after = after.select(*[
        (F.when(hit, F.col(f"_u.{c}")).otherwise(F.col(c)).cast(types[c]).alias(c)
         if c in update_cols else F.col(c)) for c in table.columns])
    after = remove_keys(after, key, gone)

    dout = d_pre.select("seq", key, "outcome").unionByName(d_new)
    outcomes = (adds.join(ok.select("seq", key), "seq", "left")
                    .select("seq", F.lit("add").alias("op"), key, "reason")
                .unionByName(ups.select("seq", F.lit("update").alias("op"), key, "reason"))
                .unionByName(dout.select("seq", F.lit("delete").alias("op"), key,
                                         F.when(F.col("outcome") != "deleted", F.col("outcome"))
                                          .alias("reason"))))
    return after, gone, outcomes


def ingredient_change(ingredients: DataFrame, purchases: DataFrame, recipes: DataFrame,
                      changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add / update / delete ingredients.  Returns (table after, outcomes).

    add: trimmed name, form rules, name unique; supplier NULL when blank.
    update: quantity, reorder_level, unit_price (all >= 0); last valid wins.
    delete: refused when used by a purchase or a recipe.  Request order as in
    ``apply_batch``.
    """
    table, _, outcomes = apply_batch(
        ingredients, "ingredients", "ingredient_id", changes,
        Q.ingredient_form_rules("add"), Q.ingredient_form_rules("update"),
        {c: F.col(c) for c in ("quantity", "reorder_level", "unit_price")},
        [(purchases, "ingredient_id", "used by purchases"),
         (recipes, "ingredient_id", "used by recipes")])
    return table, outcomes


def apply_menu_changes(menu_items: DataFrame, recipes: DataFrame, order_items: DataFrame,
                       changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U1 + U2 + U4 as one batch (the admin food page's forms in request order).

    add: form rules, free name, new id, available; update: price, discount,
    availability (unticked = 0), last valid wins; delete: refused when the
    item was sold, recipes cascade.  Returns (menu after, recipes after,
    outcomes).
    """
    menu, gone, outcomes = apply_batch(
        menu_items, "menu_items", "menu_id", changes,
        Q.menu_form_rules(), Q.menu_update_rules(),
        {"price": F.col("price"), "discount": F.col("discount"),
         "is_available": F.coalesce(F.col("is_available"), F.lit(0))},
        [(order_items, "menu_id", "sold before")],
        add_defaults={"is_available": F.lit(1)})
    return menu, remove_keys(recipes, "menu_id", gone), outcomes


# ------------------------------------------------------------------ U6

def order_status_update(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Staff set any of the four statuses; other values are rejected; the
    last valid change per order wins."""
    staff = changes.filter((F.col("actor") == "staff") & F.col("status").isin(ORDER_STATUSES))
    last = staff.groupBy("order_id").agg(F.max_by("status", "seq").alias("_s"))
    return (orders.join(last, "order_id", "left")
                  .withColumn("status", F.coalesce("_s", "status")).drop("_s")
                  .select(*orders.columns))


# ------------------------------------------------------------------ U8

def cart_merge(events: DataFrame, menu_items: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """U8: fold add / set / remove events into carts -> (cart_id, menu_id, qty).

    Per (cart, item) in seq order: add puts max(1, qty) on top (only for an
    available item); set replaces the quantity of an item already in the
    cart (ignored otherwise); set <= 0 or remove drops the item.

    Closed form instead of a per-group fold: after the last drop r, the item
    re-enters at the first available add f after r; after f it stays, so the
    result is (quantity of the last positive set s after f, else 0) + the adds
    after max(s, f-1).  For (cart, item) pairs up to ``hot_rows`` events r, f and s are window
    aggregates over one exchange; for others they are map-side combined
    aggregates joined back, so a hot pair never lands in one task.
    """
    k = ["cart_id", "menu_id"]
    avail = menu_items.filter(F.col("is_available") == 1).select("menu_id").distinct() \
        .withColumn("_av", F.lit(True))
    e = events.join(avail, "menu_id", "left")
    is_drop = (F.col("op") == "remove") | ((F.col("op") == "set")
                                           & (F.coalesce(F.col("qty"), F.lit(0)) <= 0))
    e = e.select(*k, "seq", "qty", F.coalesce(is_drop, F.lit(False)).alias("_drop"),
                 ((F.col("op") == "add") & F.coalesce(F.col("_av"), F.lit(False))).alias("_add"),
                 ((F.col("op") == "set") & F.coalesce(F.col("qty") > 0, F.lit(False))).alias("_set"))
    plain, hot = split_hot(e, k, hot_rows)
    whole = Window.partitionBy(*k)
    out = _fold_cart(plain, k, lambda d, **aggs: d.select(
        "*", *[c.over(whole).alias(n) for n, c in aggs.items()]))
    if hot is None:
        return out

    def joined(d: DataFrame, **aggs: Column) -> DataFrame:
        return d.join(d.groupBy(*k).agg(*[c.alias(n) for n, c in aggs.items()]), k)
    return out.unionByName(_fold_cart(hot, k, joined))


def _fold_cart(e: DataFrame, k: list[str], per_key) -> DataFrame:
    """The closed form of ``cart_merge``; ``per_key(frame, name=aggregate)`` adds
    aggregates of each key to its rows."""
    e = per_key(e, _r=F.max(F.when(F.col("_drop"), F.col("seq"))))
    after = F.col("seq") > F.coalesce(F.col("_r"), F.lit(-(1 << 62)))
    # first available add after r, and the last positive set after r (it
    # counts only if it comes after that add; earlier sets found no item)
    e = per_key(e, _f=F.min(F.when(F.col("_add") & after, F.col("seq"))),
                _s=F.max(F.when(F.col("_set") & after, F.struct("seq", "qty"))))
    e = e.filter(F.col("_f").isNotNull())      # no add after the last drop: not in the cart
    late = F.coalesce(F.col("_s.seq") > F.col("_f"), F.lit(False))
    start = F.when(late, F.col("_s.seq")).otherwise(F.col("_f") - 1)
    return (e.groupBy(*k)
             .agg(F.max(F.when(late, F.col("_s.qty")).otherwise(F.lit(0))).alias("_base"),
                  F.sum(F.when(F.col("_add") & (F.col("seq") > start),
                               F.greatest(F.lit(1), F.coalesce("qty", F.lit(0))))).alias("_adds"))
             .select(*k, (F.col("_base") + F.coalesce("_adds", F.lit(0))).cast("int").alias("qty")))

"""Data-quality audits (D1-D6): the database's keys and rules as batch jobs.

Every table is read once: a row gives one fact per row-level rule that it breaks
(NOT NULL, CHECK, VARCHAR length), per UNIQUE key that it holds (NULL keys exempt),
per FOREIGN KEY value that it refers to, and per foreign key that it is a parent of.
One aggregate over the facts of all tables (a key's facts are added up
map-side first) tells which keys are held twice and which references have no parent row.
``summary`` gives one row per rule with its count, zero included; detail functions
return violations as ``(table_name, rule, key, detail)``.  ``append_violations`` checks a
batch of new rows against what is stored, before it is appended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larder.schemas import ORDER_STATUSES, SCHEMAS, USER_ROLES, VARCHAR_LIMITS

# Fixed rules of the reference schema.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "suppliers": [["supplier_id"], ["phone"], ["email"]],
    "ingredients": [["ingredient_id"], ["name"]],
    "purchases": [["purchase_id"]],
    "menu_items": [["menu_id"], ["name"]],
    "recipes": [["menu_id", "ingredient_id"]],
    "customers": [["customer_id"], ["phone"]],
    "employees": [["employee_id"], ["phone"]],
    "orders": [["order_id"]],
    "order_items": [["order_item_id"]],
    "users": [["user_id"], ["username"]],
}

CHECKS: list[tuple[str, str]] = [
    ("ingredients", "quantity >= 0"),
    ("ingredients", "unit_price >= 0"),
    ("purchases", "quantity > 0"),
    ("menu_items", "price > 0"),
    ("menu_items", "discount >= 0 AND discount <= 100"),
    ("orders", "status IN (" + ", ".join(f"'{s}'" for s in ORDER_STATUSES) + ")"),
    ("order_items", "quantity > 0"),
    ("users", "role IN (" + ", ".join(f"'{s}'" for s in USER_ROLES) + ")"),
]

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("ingredients", "supplier_id", "suppliers", "supplier_id"),
    ("purchases", "supplier_id", "suppliers", "supplier_id"),
    ("purchases", "ingredient_id", "ingredients", "ingredient_id"),
    ("recipes", "menu_id", "menu_items", "menu_id"),
    ("recipes", "ingredient_id", "ingredients", "ingredient_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("orders", "employee_id", "employees", "employee_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "menu_id", "menu_items", "menu_id"),
    ("users", "customer_id", "customers", "customer_id"),
]

PRIMARY_KEY = {t: keys[0] for t, keys in UNIQUE_KEYS.items()}


def not_null_rules(table: str) -> list[tuple[str, Column]]:
    """(rule, violation condition) for each NOT NULL column."""
    return [(f"not_null:{f.name}", F.col(f.name).isNull())
            for f in SCHEMAS[table].fields if not f.nullable]


def check_rules(table: str) -> list[tuple[str, Column]]:
    """D3: CHECK clauses; a NULL result passes, as in SQL."""
    return [(f"check:{expr}", F.coalesce(~F.expr(expr), F.lit(False)))
            for t, expr in CHECKS if t == table]


def length_rules(table: str) -> list[tuple[str, Column]]:
    """VARCHAR(n) limits as length(col) > n."""
    return [(f"length:{c}<={n}", F.coalesce(F.length(c) > n, F.lit(False)))
            for c, n in VARCHAR_LIMITS.get(table, {}).items()]


def row_rules(table: str, kinds=("not_null", "check", "length")) -> list[tuple[str, Column]]:
    out = []
    if "not_null" in kinds:
        out += not_null_rules(table)
    if "check" in kinds:
        out += check_rules(table)
    if "length" in kinds:
        out += length_rules(table)
    return out


def _key_text(cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def row_violations(df: DataFrame, table: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Violations of row-level rules in one scan of ``df``."""
    if not rules:
        return df.sparkSession.createDataFrame([], VIOLATIONS)
    said = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])
    pk = PRIMARY_KEY[table]
    return (df.select(_key_text(pk).alias("key"), F.explode(said).alias("rule")).filter(F.col("rule").isNotNull())
              .select(F.lit(table).alias("table_name"), "rule", "key", F.lit(None).cast("string").alias("detail")))


VIOLATIONS = "table_name string, rule string, key string, detail string"
KINDS = ("not_null", "check", "length", "unique", "fk")


def _unique_name(key: list[str]) -> str:
    return "unique:" + ",".join(key)


def _fk_name(col: str, parent: str, parent_col: str) -> str:
    return f"fk:{col}->{parent}.{parent_col}"


def rules_of(tables: dict[str, DataFrame], kinds=KINDS) -> list[tuple[str, str]]:
    """(table, rule) of every rule over the given tables."""
    out = []
    for t in tables:
        if t in SCHEMAS:
            out += [(t, name) for name, _ in row_rules(t, kinds)]
            if "unique" in kinds:
                out += [(t, _unique_name(k)) for k in UNIQUE_KEYS[t]]
    if "fk" in kinds:
        out += [(c, _fk_name(col, p, pc)) for c, col, p, pc in FOREIGN_KEYS if c in tables and p in tables]
    return out


def facts(tables: dict[str, DataFrame], kinds=KINDS) -> DataFrame:
    """(table_name, rule, k, n, parent): what the rows of all tables say about the rules, one scan
    per table.  ``k`` is the key (columns as text), null for row-level rules."""
    def fact(table: str, rule: str, k: Column | None, parent: int, when: Column) -> Column:
        k = F.lit(None).cast("array<string>") if k is None else k
        return F.when(when, F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), k.alias("k"),
                                     F.lit(1 - parent).cast("long").alias("n"), F.lit(parent).alias("parent")))

    def text(cols: list[str]) -> Column:
        return F.array(*[F.col(c).cast("string") for c in cols])
    parts = []
    for t, df in tables.items():
        if t not in SCHEMAS:
            continue
        out = [fact(t, name, None, 0, cond) for name, cond in row_rules(t, kinds)]
        if "unique" in kinds:
            out += [fact(t, _unique_name(key), text(key), 0, reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]))
                    for key in UNIQUE_KEYS[t]]
        if "fk" in kinds:
            for c, col, p, pc in FOREIGN_KEYS:
                if c in tables and p in tables:
                    if t == c:
                        out.append(fact(c, _fk_name(col, p, pc), text([col]), 0, F.col(col).isNotNull()))
                    if t == p:
                        out.append(fact(c, _fk_name(col, p, pc), text([pc]), 1, F.col(pc).isNotNull()))
        if out:
            # filtered after the explode: a filter within the array is not compiled
            parts.append(df.select(F.explode(F.array(*out)).alias("f")).filter(F.col("f").isNotNull()).select("f.*"))
    return reduce(DataFrame.unionByName, parts)


def _broken(found: DataFrame) -> DataFrame:
    """Keys that break a UNIQUE or FOREIGN KEY rule, and row-level rules that are broken; ``n`` rows each."""
    g = found.groupBy("table_name", "rule", "k").agg(F.sum("n").alias("n"), F.max("parent").alias("parent"))
    unique, fk = F.col("rule").startswith("unique:"), F.col("rule").startswith("fk:")
    return g.filter(F.when(unique, F.col("n") > 1).when(fk, (F.col("parent") == 0) & (F.col("n") > 0))
                     .otherwise(F.col("n") > 0))


def _key_violations(tables: dict[str, DataFrame], kinds=("unique", "fk")) -> DataFrame:
    """D2, D4 with their keys: duplicated values once, and every child row without a parent."""
    bad = _broken(facts(tables, kinds))
    out = bad.filter(F.col("rule").startswith("unique:")).select(
        "table_name", "rule", F.concat_ws("|", "k").alias("key"), F.format_string("%d rows", F.col("n")).alias("detail"))
    refs = []
    for t, df in tables.items():
        own = [(_fk_name(col, p, pc), col) for c, col, p, pc in FOREIGN_KEYS if c == t and p in tables]
        if own and "fk" in kinds:
            ref = F.array(*[F.when(F.col(col).isNotNull(), F.struct(
                F.lit(name).alias("rule"), F.col(col).cast("string").alias("value"))) for name, col in own])
            refs.append(df.select(F.lit(t).alias("table_name"), _key_text(PRIMARY_KEY[t]).alias("key"), F.explode(ref).alias("r"))
                          .filter(F.col("r").isNotNull()).select("table_name", "key", "r.rule", "r.value"))
    if not refs:
        return out
    dangling = bad.filter(F.col("rule").startswith("fk:")).select("table_name", "rule", F.col("k")[0].alias("value"))
    rows = reduce(DataFrame.unionByName, refs).join(dangling, ["table_name", "rule", "value"], "left_semi")
    return out.unionByName(rows.select("table_name", "rule", "key", F.col("value").alias("detail")))


def unique_violations(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Key values held by more than one row (NULL keys exempt)."""
    return _key_violations({table: df}, ("unique",)).filter(F.col("rule") == _unique_name(key))


def foreign_key_violations(child: DataFrame, parent: DataFrame, table: str, col: str,
                           parent_table: str, parent_col: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    return _key_violations({table: child, parent_table: parent}, ("fk",)).filter(
        (F.col("table_name") == table) & (F.col("rule") == _fk_name(col, parent_table, parent_col)))


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every rule over every table, as one frame of violations."""
    parts = [row_violations(df, t, row_rules(t)) for t, df in tables.items() if t in SCHEMAS]
    return reduce(DataFrame.unionByName, [*parts, _key_violations(tables)])


def summary(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """Per-rule counts (zero included) for one rule kind: not_null, unique, check, fk, length.
    A duplicated key value counts once, a dangling reference once per row."""
    if kind not in KINDS:
        raise ValueError(kind)
    rules = rules_of(tables, (kind,))
    spark = next(iter(tables.values())).sparkSession
    every = spark.createDataFrame(rules, "table_name string, rule string")     # one row per rule
    bad = _broken(facts(tables, (kind,)))
    n = bad.groupBy("table_name", "rule").agg(F.sum(F.lit(1) if kind == "unique" else F.col("n")).alias("n"))
    return every.join(n, ["table_name", "rule"], "left").select(
        "table_name", "rule", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


# ---- checks at write time ----

def append_violations(new: DataFrame, table: str, stored: dict[str, DataFrame]) -> DataFrame:
    """Violations that appending ``new`` to ``table`` would add: row-level rules and
    references of the new rows, and keys that they hold twice or that a stored row holds.

    The cost follows the batch: of the stored tables only keys between the batch's
    least and greatest are read (min and max of row groups skip the rest of a file
    sorted or appended by key), and of those only keys of the batch are joined.
    """
    def near(df: DataFrame, cols: list[str], keys: DataFrame, theirs: list[str]) -> DataFrame:
        """Key columns of the rows of ``df`` that have a key of the batch."""
        lo_hi = keys.agg(F.min(theirs[0]), F.max(theirs[0])).first()
        d = df.select(*cols)
        d = d.filter(F.lit(False)) if lo_hi[0] is None else d.filter(F.col(cols[0]).between(*lo_hi))
        k = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(theirs)]).distinct()
        same = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(cols)]
        return d.join(k, reduce(lambda a, b: a & b, same), "left_semi")
    parts = [row_violations(new, table, row_rules(table))]
    for key in UNIQUE_KEYS[table]:
        nn = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        mine = new.filter(nn)
        held = mine.select(*key).unionByName(near(stored[table], key, mine, key))
        dup = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(dup.select(F.lit(table).alias("table_name"), F.lit(_unique_name(key)).alias("rule"),
                                _key_text(key).alias("key"), F.format_string("%d rows", F.col("n")).alias("detail")))
    for c, col, p, pc in FOREIGN_KEYS:
        if c == table and p in stored:
            refs = new.filter(F.col(col).isNotNull())
            there = near(stored[p], [pc], refs, [col]).select(F.col(pc).alias(col)).distinct()
            bad = refs.join(there, col, "left_anti")
            parts.append(bad.select(F.lit(table).alias("table_name"), F.lit(_fk_name(col, p, pc)).alias("rule"),
                                    _key_text(PRIMARY_KEY[table]).alias("key"), F.col(col).cast("string").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def observed(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """``df`` with counts of broken row-level rules gathered while it is written, and the observation
    that has them afterwards (rule -> rows)."""
    seen = Observation(f"rules-{table}")
    return df.observe(seen, *[F.count_if(cond).alias(name) for name, cond in row_rules(table)]), seen


# ---- D5: form rules on change inputs ----

def form_reason(rules: list[tuple[Column, str]]) -> Column:
    """First failing rule's message, NULL when every rule holds.

    ``rules`` are (condition that must hold, message); a NULL condition fails.
    """
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(msg)) for ok, msg in rules],
                      F.lit(None).cast("string"))


def menu_form_rules() -> list[tuple[Column, str]]:
    """Add/update food: name non-empty, price > 0, 0 <= discount <= 100."""
    return [
        (F.length(F.trim(F.coalesce(F.col("name"), F.lit("")))) > 0, "name is empty"),
        (F.col("price") > 0, "price must be above 0"),
        ((F.col("discount") >= 0) & (F.col("discount") <= 100), "discount must be 0..100"),
    ]


def menu_update_rules() -> list[tuple[Column, str]]:
    return menu_form_rules()[1:]


def ingredient_form_rules(op: str) -> list[tuple[Column, str]]:
    """Add: name non-empty, quantity >= 0, unit_price >= 0.
    Update: quantity, reorder_level, unit_price >= 0."""
    if op == "add":
        return [
            (F.length(F.trim(F.coalesce(F.col("name"), F.lit("")))) > 0, "name is empty"),
            (F.col("quantity") >= 0, "quantity must be >= 0"),
            (F.col("unit_price") >= 0, "unit_price must be >= 0"),
        ]
    return [
        (F.col("quantity") >= 0, "quantity must be >= 0"),
        (F.col("reorder_level") >= 0, "reorder_level must be >= 0"),
        (F.col("unit_price") >= 0, "unit_price must be >= 0"),
    ]


def purchase_form_rules() -> list[tuple[Column, str]]:
    """Purchase: quantity > 0 and cost >= 0."""
    return [(F.col("quantity") > 0, "quantity must be above 0"),
            (F.col("cost") >= 0, "cost must be >= 0")]


def status_form_rules() -> list[tuple[Column, str]]:
    return [(F.col("status").isin(ORDER_STATUSES), "status not allowed")]


def with_reason(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Add ``reason`` (NULL = accepted)."""
    return df.withColumn("reason", form_reason(rules))

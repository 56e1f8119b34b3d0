"""Change sets for products, favourites, reviews, accounts and customers.

``seq`` and rejects as in ``order_changes``.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.dates import as_date, as_timestamp
from marketloom.functions.keyed import (
    join_grouped,
    latest,
    next_key,
    overwrite,
    without_keys,
)
from marketloom.functions.text import blank, folded, missing, zero
from marketloom.operators.quality import (
    PRODUCT_NUMBERS,
    PRODUCT_TEXTS,
    cascade_delete,
    product_payload_faults,
)
from marketloom.operators.typed import Rules
from marketloom.session import durable

Tables = dict[str, DataFrame]


def _append(table: DataFrame, new: DataFrame, **values: Column) -> DataFrame:
    """Add ``new`` below ``table``: columns by name, from ``values``, or NULL."""
    picked = [
        (values[c] if c in values else F.col(c) if c in new.columns else F.lit(None))
        .cast(table.schema[c].dataType)
        .alias(c)
        for c in table.columns
    ]
    return table.unionByName(new.select(*picked))


# --- reviews --------------------------------------------------------------------------------


def first_reviews(new: DataFrame) -> DataFrame:
    """First valid review per order: ``order_id``, ``own`` and the rest of the row as ``review``.

    Validity is tested before the first is chosen: a refused insert does not block a later one.
    A review without an order stands for itself, told apart by ``own``; it is not grouped, so a
    stream, on which this also runs, keeps no state for it.
    """
    valid = new.where(_storable()).withColumn("stars", _stars())
    rest = F.struct(*[c for c in new.columns if c != "order_id"])
    own = F.col("seq")
    first = (
        valid.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.min_by(rest, "seq").alias("review"))
        .withColumn("own", F.lit(None).cast(new.schema["seq"].dataType))
    )
    alone = valid.where(F.col("order_id").isNull()).select("order_id", rest.alias("review"), own.alias("own"))
    return first.unionByName(alone).select("order_id", "own", "review")


def _stars() -> Column:
    """Stars as the whole number that is stored."""
    return F.round("stars").cast("int")


def _storable() -> Column:
    """The table tests the rounded stars."""
    return F.col("text").isNotNull() & F.coalesce(F.round("stars").between(1, 5), F.lit(False))


def unreviewed(reviews: DataFrame, first: DataFrame) -> DataFrame:
    """Flat rows of ``first_reviews`` whose order has no review in ``reviews`` yet.

    Rows without an order go around the join, where they would all meet in one place.
    """
    taken = reviews.where(F.col("order_id").isNotNull()).select("order_id").distinct()
    ordered = first.where(F.col("order_id").isNotNull())
    open_ = join_grouped(ordered, taken, "order_id", "left_anti").select(*first.columns)
    return open_.unionByName(first.where(F.col("order_id").isNull())).select("order_id", "review.*")


def add_order_reviews(
    reviews: DataFrame, new: DataFrame, now: dt.datetime | Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add reviews of orders, one per order. ``new``: ``seq, order_id, text, stars``.

    Text must be present and stars in 1..5, as the table declares.
    """
    added = unreviewed(reviews, first_reviews(new))
    state = _append(
        reviews, added, id=next_key(reviews, "id", F.col("seq")), created_at=as_timestamp(now)
    )
    reason = F.when(_storable(), F.lit("already reviewed")).otherwise(F.lit("invalid"))
    rejects = new.join(added.select("seq"), "seq", "left_anti").withColumn("reason", reason)
    return state, rejects


def add_reviews(
    reviews: DataFrame, new: DataFrame, now: dt.datetime | Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add reviews without an order. ``new``: ``seq, text, stars``; text filled, stars in 1..5
    before they are rounded to be stored."""
    good = ~blank("text") & F.coalesce(F.col("stars").between(1, 5), F.lit(False))
    state = _append(
        reviews,
        new.where(good).drop("order_id").withColumn("stars", _stars()),
        id=next_key(reviews, "id", F.col("seq")),
        created_at=as_timestamp(now),
    )
    return state, new.where(~good).withColumn("reason", F.lit("invalid"))


def delete_reviews(reviews: DataFrame, keys: DataFrame, by: str = "order_id") -> DataFrame:
    """Delete reviews by ``order_id`` or ``id``; ``keys`` has a column of that name."""
    return without_keys(reviews, keys, by)


# --- products -------------------------------------------------------------------------------


def add_products(products: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add products. ``new`` holds ``seq`` and any product columns; only what the table cannot hold
    is refused.

    Missing columns are NULL, but a missing ``Prenume`` is 0; an explicit NULL stays NULL.
    """
    rules = Rules("products", products)
    given = [c for c in products.columns if c in new.columns and c != "Pid"]
    judged = rules.judge(new, given, F.lit(False))
    values = {"Pid": next_key(products, "Pid", F.col("seq"))}
    if "Prenume" not in new.columns:
        values["Prenume"] = F.lit(0)
    good = rules.typed(judged.where("reason IS NULL"), given)
    return _append(products, good, **values), judged.where("reason IS NOT NULL")


def update_products(products: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace eight columns per product, ``Prenume`` stays. ``changes``: ``seq, Pid`` and the eight.

    Validation comes first, so an invalid payload never reaches the table.
    """
    columns = [*PRODUCT_TEXTS, *PRODUCT_NUMBERS]
    judged = changes.withColumn("reason", product_payload_faults())
    typed = Rules("products").typed(judged.where(F.col("reason") == ""), columns)
    state = overwrite(
        products,
        latest(typed.select("seq", "Pid", *columns), "Pid", columns),
        "Pid",
        {c: F.col(f"_new.{c}") for c in columns},
    )
    return state, judged.where(F.col("reason") != "")


def delete_products(t: Tables, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete products and, by cascade, their order items; favourites stay."""
    return (
        cascade_delete(keys, t["products"], "Pid"),
        cascade_delete(keys, t["order_items"], "Pid"),
    )


# --- favourites -----------------------------------------------------------------------------

PAIR = ["customer_id", "product_id"]


def count_toggles(log: DataFrame) -> DataFrame:
    """Toggles per pair, and the last of them; requests without both ids do not count.

    The grouping also runs on a stream.
    """
    return (
        log.where(~_no_pair())
        .groupBy(*PAIR)
        .agg(F.count("*").alias("toggles"), F.max("seq").alias("seq"))
    )


def _no_pair() -> Column:
    return zero("customer_id") | zero("product_id")


def apply_toggles(favorites: DataFrame, counts: DataFrame) -> DataFrame:
    """Favourites after the toggles in ``counts``.

    A toggle deletes all rows of a present pair and inserts one of an absent pair. So an untouched
    pair keeps all its rows and a touched one ends with a single new row or none: one, if its
    presence before and an odd number of toggles do not cancel out. A new row's key follows the
    last toggle, which is the one that inserted it.
    """
    untouched = join_grouped(favorites, counts.select(*PAIR), PAIR, "left_anti")
    present = favorites.groupBy(*PAIR).agg(F.lit(True).alias("present"))
    odd = F.col("toggles") % 2 == 1
    kept = counts.join(present, PAIR, "left").where(F.coalesce("present", F.lit(False)) != odd)
    return untouched.unionByName(
        kept.select(next_key(favorites, "id", F.col("seq")).alias("id"), *PAIR)
    )


def toggle_favorites(favorites: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flip each requested pair. ``log``: ``seq, customer_id, product_id``; both ids required."""
    rejects = log.where(_no_pair()).withColumn("reason", F.lit("incomplete"))
    return apply_toggles(favorites, count_toggles(log)), rejects


# --- accounts -------------------------------------------------------------------------------


def add_transfer_accounts(transfer: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add accounts. ``new``: ``seq, Tname, Tnum, Taccount, Tbranch, qrcode`` (a file name).

    All but the branch are required; an account number of zero counts as given. Values have to fit.
    """
    incomplete = blank("Tname") | missing("Tnum") | blank("Taccount") | F.col("qrcode").isNull()
    rules, given = Rules("transfer", transfer), ["Tname", "Tnum", "Taccount", "Tbranch"]
    judged = rules.judge(new, given, incomplete)
    state = _append(
        transfer,
        rules.typed(judged.where("reason IS NULL"), given),
        Tid=next_key(transfer, "Tid", F.col("seq")),
        Tqr=F.concat(F.lit("/qrs/"), "qrcode"),
    )
    return state, judged.where("reason IS NOT NULL")


# --- customers ------------------------------------------------------------------------------

# Registrations that depend on each other and are served as one list; more go through rounds.
FOLD = 1024

# Fields that a registration has to fill. Fixed values.
REGISTRATION = [
    "Cname", "Caddress", "Csubdistrict", "Cdistrict", "Cprovince", "Czipcode", "Cusername",
    "Cpassword", "Cphone", "Cbirth",
]


def set_profile_picture(customers: DataFrame, changes: DataFrame) -> DataFrame:
    """Last picture per customer wins, NULL if none came. ``changes``: ``seq, Cid, file``."""
    last = latest(changes, "Cid", ["file"])
    return overwrite(customers, last, "Cid", {"Cprofile": F.col("_new.file")})


def _classes(new: DataFrame, customers: DataFrame, col: str, name: str) -> DataFrame:
    """Class of every text in ``col``: ``name`` is the first ``seq`` with an equal text.

    ``{name}_taken`` tells whether a customer has that text already. Comparing under the collation
    is slow, so that is done once per distinct text; rows find their class by the plain text, and
    all later steps work on the numbers.
    """
    key = folded(col).alias("_text")
    texts = new.groupBy(col).agg(F.min("seq").alias("_first"))
    classes = texts.groupBy(key).agg(F.min("_first").alias(name))
    taken = customers.select(col).distinct().groupBy(key).agg(F.lit(True).alias(f"{name}_taken"))
    marked = classes.join(taken, "_text", "left").withColumn(
        f"{name}_taken", F.coalesce(f"{name}_taken", F.lit(False))
    )
    return texts.select(col, key).join(marked, "_text").drop("_text")


def _first_come(waiting: DataFrame) -> DataFrame:
    """Rows of ``seq, user, full`` that get both their values when served in order of ``seq``.

    One round settles most: a row that is the first one for both its values is served whatever the
    others are, and rows that share a value with it are refused. Rows still open depend on each
    other only within a component of shared values; each component is served in order as one list.
    Components of more than ``FOLD`` rows go through rounds.
    """
    served, waiting = _serve_firsts(waiting)
    if waiting.isEmpty():
        return served
    labelled = _conflicts(waiting)
    sizes = labelled.groupBy("label").agg((F.count("*") > FOLD).alias("wide"))
    marked = durable(join_grouped(labelled, sizes, "label", "inner"))
    row = F.struct("seq", "user", "full")
    lists = marked.where("not wide").groupBy("label").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    folded_ = lists.select(F.explode(_serve_in_order(F.col("rows"))).alias("row")).select("row.*")
    rounds = [served, durable(folded_)]
    waiting = marked.where("wide").select("seq", "user", "full")
    while not waiting.isEmpty():
        served, waiting = _serve_firsts(waiting)
        rounds.append(served)
    return reduce(DataFrame.unionByName, rounds)


def _serve_firsts(waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that come first for both their values, and what is open after them; both stored."""
    by_user = waiting.groupBy("user").agg(F.min("seq").alias("seq"))
    by_full = waiting.groupBy("full").agg(F.min("seq").alias("seq"))
    winners = durable(by_user.join(by_full, "seq").select("seq", "user", "full"))
    left = join_grouped(
        join_grouped(waiting, winners.select("user"), "user", "left_anti"), winners.select("full"), "full", "left_anti"
    )
    return winners, durable(left.select("seq", "user", "full"))


def _conflicts(rows: DataFrame) -> DataFrame:
    """The rows with ``label``: the least ``seq`` that is reached over shared values.

    Every round takes the least label over both values and then the label of that row, so the
    distance to the least row about halves. Each round is stored.
    """
    labelled = rows.withColumn("label", F.col("seq"))
    while True:
        by_user = labelled.groupBy("user").agg(F.min("label").alias("_user"))
        by_full = labelled.groupBy("full").agg(F.min("label").alias("_full"))
        near = join_grouped(join_grouped(labelled, by_user, "user", "inner"), by_full, "full", "inner")
        near = durable(near.select("seq", "user", "full", "label", F.least("_user", "_full").alias("low")))
        far = near.select(F.col("seq").alias("low"), F.col("low").alias("far"))
        if near.where("low < label").isEmpty():
            return near.select("seq", "user", "full", "label")
        labelled = join_grouped(near, far, "low", "inner").select("seq", "user", "full", F.col("far").alias("label"))


def _serve_in_order(rows: Column) -> Column:
    """Of a list of rows in order those that find both their values free."""
    none = F.array().cast("array<bigint>")
    kept = F.array().cast("array<struct<seq:bigint,user:bigint,full:bigint>>")
    start = F.struct(none.alias("users"), none.alias("fulls"), kept.alias("kept"))

    def serve(done: Column, row: Column) -> Column:
        gone = F.array_contains(done["users"], row["user"]) | F.array_contains(done["fulls"], row["full"])
        return F.when(gone, done).otherwise(
            F.struct(
                F.array_append(done["users"], row["user"]).alias("users"),
                F.array_append(done["fulls"], row["full"]).alias("fulls"),
                F.array_append(done["kept"], row).alias("kept"),
            )
        )

    return F.aggregate(rows, start, serve, lambda done: done["kept"])


def register_customers(
    customers: DataFrame, new: DataFrame, as_of: dt.date | str | Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add customers whose user name and full name are both free. ``new``: ``seq``, the ten fields
    of ``REGISTRATION`` (password already hashed) and ``Cprofile``.

    Requests are served in order, so one that is refused takes no name; values have to fit the
    table. The user name is tested first, which shows in the reason.
    """
    texts = [c for c in REGISTRATION if c != "Cbirth"]
    incomplete = reduce(lambda a, b: a | b, [blank(c) for c in texts], F.col("Cbirth").isNull())
    rules, given = Rules("customers", customers), [*REGISTRATION, "Cprofile"]
    judged = rules.judge(new, given, incomplete)
    complete = judged.where("reason IS NULL").drop("reason")
    names = complete.select("seq", "Cusername", "Cname")
    user = _classes(names, customers, "Cusername", "user")
    full = _classes(names, customers, "Cname", "full")
    classed = join_grouped(join_grouped(names, user, "Cusername", "inner"), full, "Cname", "inner")
    pairs = durable(classed.drop("Cusername", "Cname"))
    free = pairs.where(~F.col("user_taken") & ~F.col("full_taken"))
    served = _first_come(free.select("seq", "user", "full"))
    state = _append(
        customers,
        rules.typed(complete.join(served.select("seq"), "seq", "left_semi"), given),
        Cid=next_key(customers, "Cid", F.col("seq")),
        Cstatus=F.lit("user"),
        Cdate=as_date(as_of),
    )
    owners = served.select("user", F.col("seq").alias("_owner"))
    user_gone = F.col("user_taken") | F.coalesce(F.col("_owner") < F.col("seq"), F.lit(False))
    reasons = (
        pairs.join(served.select("seq"), "seq", "left_anti")
        .join(owners, "user", "left")
        .select(
            "seq",
            F.when(user_gone, F.lit("user name taken")).otherwise(F.lit("name taken")).alias("reason"),
        )
    )
    rejects = judged.where("reason IS NOT NULL").unionByName(
        complete.join(reasons, "seq").select(*new.columns, "reason")
    )
    return state, rejects

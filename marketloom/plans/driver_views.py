"""The shop's tables and change logs as views over the given test tables.

Each view is one table, an optional row condition, and expressions that Spark and DuckDB read alike,
so the Spark queries and their SQL counterparts start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_NO_TEXT = "CAST(NULL AS STRING)"
# Order that an event speaks about: some events name none, some an unknown one.
_REVIEWED = (
    "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 1000000000 + event_id "
    "ELSE 2 * CAST(floor(event_id / 50) AS BIGINT) END"
)

# Orders that only _REVIEWED does not name: reviewed before, and not yet.
_ODD, _OPEN = (f"4 * CAST(floor(event_id / 5) AS BIGINT) + {k}" for k in (1, 3))

# view: (table, row condition, {column: expression})
VIEWS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "s_orders": (
        "orders",
        None,
        {
            "Oid": "o_orderkey",
            "Oprice": "CAST(o_totalprice AS DECIMAL(12,2))",
            "Odate": "CAST(o_orderdate AS DATE)",
            "Ostatus": "CASE o_orderpriority WHEN '1-URGENT' THEN 'pending' "
            "WHEN '2-HIGH' THEN 'waiting' WHEN '3-MEDIUM' THEN 'shipped' "
            "WHEN '4-NOT SPECIFIED' THEN 'cancelled' ELSE 'failed' END",
            "Cid": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END",
            "Opayment": "CASE WHEN o_orderstatus = 'F' THEN 'cod' ELSE 'transfer' END",
            "Oslip": _NO_TEXT,
        },
    ),
    "s_order_items": (
        "lineitem",
        None,
        {
            "Oiid": "l_orderkey * 8 + l_linenumber",
            "Oid": "l_orderkey",
            "Pid": "l_partkey",
            "Oquantity": "CAST(l_quantity AS INT)",
            "Oprice": "CAST(l_extendedprice AS DECIMAL(12,2))",
        },
    ),
    "s_products": (
        "part",
        None,
        {
            "Pid": "p_partkey",
            "Pname": "p_name",
            "Pprice": "CAST(p_retailprice AS DECIMAL(10,2))",
            "Pnumproduct": "p_size",
            "Prenume": "CAST(p_size % 3 AS INT)",
            "Pstatus": "p_type",
            "Ppicture": "p_brand",
            "Pdetail": _NO_TEXT,
            "Typeid": "CAST(p_size AS BIGINT) * 3",
            "Subtypeid": "p_partkey",
        },
    ),
    "s_product_types": ("supplier", None, {"Typeid": "s_suppkey", "typenproduct": "s_name"}),
    "s_subtypes": (
        "customer",
        None,
        {
            "Subtypeid": "c_custkey",
            "subname": "c_name",
            "Typeid": "CAST(c_nationkey AS BIGINT)",
        },
    ),
    "s_customers": (
        "customer",
        None,
        {
            "Cid": "c_custkey",
            "Cname": "c_name",
            "Caddress": "c_mktsegment",
            "Cusername": "lower(c_name)",
            "Cpassword": "c_name",
            "Cphone": _NO_TEXT,
            "Cstatus": "CASE c_mktsegment WHEN 'FURNITURE' THEN 'deleted' "
            "WHEN 'MACHINERY' THEN NULL ELSE 'user' END",
            "Cdate": "CAST(NULL AS DATE)",
            "Cbirth": "CAST(NULL AS DATE)",
            "Csubdistrict": _NO_TEXT,
            "Cdistrict": _NO_TEXT,
            "Cprovince": _NO_TEXT,
            "Czipcode": "CAST(10000 + c_nationkey AS STRING)",
            "Cprofile": _NO_TEXT,
        },
    ),
    "s_reviews": (
        "events",
        None,
        {
            "id": "event_id",
            "text": "CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN '' ELSE props END",
            "stars": "CAST(1 + event_id % 5 AS INT)",
            "created_at": "ts",
            "order_id": f"CASE event_type WHEN 'view' THEN {_REVIEWED} WHEN 'error' THEN NULL "
            f"WHEN 'click' THEN 1000000000 + event_id ELSE {_ODD} END",
        },
    ),
    "s_payments": (
        "events",
        None,
        {
            "Payid": "event_id",
            "Oid": "CAST(floor(event_id / 5) AS BIGINT)",
            "Payprice": "CAST(value AS DECIMAL(10,2))",
            "Paydate": "ts",
            "Paystatus": "CASE event_type WHEN 'purchase' THEN 'waiting' WHEN 'error' THEN 'failed' "
            "WHEN 'click' THEN NULL ELSE 'confirmed' END",
            "SlipUrl": "CASE WHEN event_type = 'signup' THEN NULL ELSE props END",
            "Tid": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 12 END",
        },
    ),
    "s_transfer": (
        "supplier",
        None,
        {
            "Tid": "s_suppkey",
            "Tname": "s_name",
            "Tnum": "s_nationkey",
            "Taccount": "s_name",
            "Tbranch": _NO_TEXT,
            "Tqr": _NO_TEXT,
        },
    ),
    "s_favorites": (
        "events",
        None,
        {
            "id": "event_id",
            "customer_id": "user_id",
            "product_id": f"CASE event_type WHEN 'view' THEN {_K} WHEN 'error' THEN 1000000 + event_id "
            f"ELSE {_K} + 100 END",
        },
    ),
    # change logs
    "order_log": (
        "events",
        None,
        {
            "seq": "event_id + 1",
            "Oid": "user_id",
            "kind": "CASE event_type WHEN 'signup' THEN 'set' WHEN 'click' THEN 'set' "
            "WHEN 'purchase' THEN 'pay' WHEN 'error' THEN 'cancel' "
            f"ELSE CASE WHEN {_K} % 2 = 1 THEN 'confirm' ELSE 'slip' END END",
            "status": "CASE event_type WHEN 'click' THEN 'shipped' WHEN 'signup' THEN "
            f"CASE {_K} % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'pending' END END",
            "url": "CASE WHEN event_type IN ('purchase', 'view') THEN props END",
        },
    ),
    "favorite_log": (
        "events",
        None,
        {
            "seq": "event_id + 1",
            "customer_id": "CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN NULL ELSE user_id END",
            "product_id": f"CASE WHEN event_type = 'error' THEN NULL ELSE {_K} END",
        },
    ),
    "new_order_reviews": (
        "events",
        None,
        {
            "seq": "event_id + 1",
            "order_id": f"CASE event_type WHEN 'signup' THEN {_OPEN} WHEN 'purchase' THEN {_ODD} "
            f"ELSE {_REVIEWED} END",
            "text": "CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN NULL ELSE props END",
            "stars": "CAST((event_id % 14) * 0.5 AS DOUBLE)",
        },
    ),
    "new_reviews": (
        "conversations",
        None,
        {
            "seq": "conv_id * 1000000 + turn + 1",
            "text": "CASE WHEN role = 'system' THEN '' ELSE text END",
            "stars": "CAST((conv_id + turn) % 14 * 0.5 AS DOUBLE)",
        },
    ),
    "new_payments": (
        "events",
        None,
        {
            "seq": "event_id + 1",
            "Oid": "event_id * 2",
            "Payprice": "CASE WHEN event_id % 9 = 0 THEN '1000000000000' WHEN event_id % 9 = 1 THEN 'abc' "
            f"WHEN {_K} = 0 THEN '0' ELSE CAST(CAST(value AS DECIMAL(10,2)) AS STRING) END",
            "Tid": "event_id % 12",
            "slip": f"CASE WHEN event_type = 'error' OR {_K} = 1 THEN NULL ELSE concat('slip-', CAST(event_id AS STRING)) END",
        },
    ),
    "old_products": ("s_products", "Pstatus <> 'PROMO'", {"*": "*"}),
    "new_products": (
        "part",
        "p_type = 'PROMO'",
        {
            "seq": "p_partkey + 1",
            "Pname": "CASE WHEN p_partkey % 11 = 0 THEN repeat('long ', 60) ELSE p_name END",
            "Pprice": "CASE WHEN p_partkey % 7 = 0 THEN '1000000000000' WHEN p_partkey % 7 = 1 THEN 'abc' "
            "ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING) END",
            "Pnumproduct": "p_size",
            "Pstatus": "p_type",
        },
    ),
    "dropped_products": ("s_products", "Pstatus = 'ECONOMY'", {"Pid": "Pid"}),
    "product_changes": (
        "events",
        None,
        {
            "seq": "event_id + 1",
            "Pid": "CAST(floor(event_id / 4) AS BIGINT)",
            "Pname": "CASE WHEN event_id % 19 = 0 THEN repeat('long ', 60) ELSE event_type END",
            "Pprice": f"CASE WHEN {_K} < 5 THEN 'much' ELSE CAST(CAST(value AS DECIMAL(10,2)) AS STRING) END",
            "Pnumproduct": "CASE WHEN event_id % 17 = 0 THEN '3000000000' ELSE CAST(user_id AS STRING) END",
            "Pdetail": "props",
            "Ppicture": "CASE WHEN event_type = 'error' THEN NULL ELSE props END",
            "Pstatus": "event_type",
            "Typeid": f"CAST({_K} AS STRING)",
            "Subtypeid": f"CASE WHEN {_K} = 7 THEN NULL ELSE '3' END",
        },
    ),
    "new_accounts": (
        "customer",
        None,
        {
            "seq": "c_custkey + 1",
            "Tname": "c_name",
            "Tnum": "CASE c_custkey % 11 WHEN 0 THEN 'abc' WHEN 1 THEN '10000000000000000000' "
            "ELSE CAST(c_nationkey AS STRING) END",
            "Taccount": "CASE WHEN c_mktsegment = 'FURNITURE' THEN '' WHEN c_custkey % 13 = 0 "
            "THEN repeat(c_mktsegment, 60) ELSE c_mktsegment END",
            "Tbranch": _NO_TEXT,
            "qrcode": "CASE c_mktsegment WHEN 'MACHINERY' THEN NULL ELSE c_name END",
        },
    ),
    "picture_changes": (
        "events",
        None,
        {
            "seq": "event_id + 1",
            "Cid": f"user_id + {_K} * 20",
            "file": "CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE props END",
        },
    ),
    "registrations": (
        "orders",
        None,
        {
            "seq": "o_orderkey + 1",
            "Cname": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
            "Caddress": "CASE WHEN o_orderkey % 37 = 0 THEN repeat('street ', 40) ELSE o_orderpriority END",
            "Csubdistrict": "o_orderstatus",
            "Cdistrict": "o_orderstatus",
            "Cprovince": "o_orderstatus",
            "Czipcode": "CASE WHEN o_custkey % 50 = 0 THEN '' ELSE '10000' END",
            "Cusername": "CASE o_orderstatus WHEN 'F' THEN "
            "concat('CUSTOMER#', lpad(CAST(o_custkey * 3 AS STRING), 9, '0')) "
            "ELSE concat('User', CAST(o_custkey AS STRING)) END",
            "Cpassword": "o_orderstatus",
            "Cphone": "o_orderstatus",
            "Cbirth": "CASE WHEN o_orderkey % 41 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
            "Cprofile": _NO_TEXT,
        },
    ),
    "raw_keys": (
        "events",
        None,
        {
            "key": "concat(CAST(user_id * 20 AS STRING), "
            "CASE event_type WHEN 'error' THEN 'abc' ELSE '' END)"
        },
    ),
    "user_names": ("customer", None, {"Cusername": "upper(c_name)"}),
    "supplier_names": ("supplier", None, {"Cusername": "s_name"}),
    "rated_items": (
        "events",
        None,
        {"id": "event_id", "stars": "CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 7 END"},
    ),
    "doc_products": (
        "documents",
        None,
        {
            "Pid": "doc_id",
            "Pname": "text",
            "Pstatus": "lang",
            "Pprice": "CAST(n_chars AS DECIMAL(20,2)) * 10000",
        },
    ),
}

def shape(df: DataFrame, view: str) -> DataFrame:
    """Apply a view's condition and expressions to a batch or streaming frame of its table."""
    _, where, columns = VIEWS[view]
    if where:
        df = df.where(where)
    if "*" in columns:
        return df
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = VIEWS[name][0]
    df = view(spark, sf_dir, table) if table in VIEWS else read_table(spark, sf_dir, table)
    return shape(df, name)


_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over a file stream of its table. The braces make the path a pattern, which a file
    stream accepts for a single file as well as for a folder."""
    table = VIEWS[name][0]
    schema = read_table(spark, sf_dir, table).schema
    return shape(spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{table}.parquet}}"), name)


def shop(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named shop tables."""
    return {name: view(spark, sf_dir, f"s_{name}") for name in names}


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation and region as gazetteer entries in the nested form of the JSON file.

    ``pos`` is the place of the entry in the file.
    """
    supplier, nation, region = (
        read_table(spark, sf_dir, name) for name in ("supplier", "nation", "region")
    )
    return (
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
        .selectExpr(
            "s_name AS name_th",
            "named_struct('name_th', n_name, 'province', named_struct('name_th', r_name)) AS amphure",
            "CAST(10000 + s_nationkey % 20 AS STRING) AS zip_code",
            "s_suppkey AS pos",
        )
    )


def sql_views(names: list[str]) -> str:
    """``WITH`` clause that defines the named views, and those they use, in SQL."""
    parts, seen = [], set()

    def add(name):
        if name in seen:
            return
        seen.add(name)
        table, where, columns = VIEWS[name]
        if table in VIEWS:
            add(table)
        cols = "*" if "*" in columns else ", ".join(f"{e} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {cols} FROM {table}{f' WHERE {where}' if where else ''})")

    for name in names:
        add(name)
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""

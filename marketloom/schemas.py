"""Declared tables of the shop.

Keys are ``BIGINT``: a 32-bit key would end at two billion rows. ``VARCHAR(n)`` is kept only as a
length rule (see ``operators.quality.check_lengths``); frames hold plain strings.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, types and limits of the shop's tables.
_DECLARED = {
    "customers": """
        Cid BIGINT NOT NULL, Cname VARCHAR(255), Caddress VARCHAR(255), Cusername VARCHAR(50),
        Cpassword VARCHAR(255), Cphone VARCHAR(15), Cstatus VARCHAR(50), Cdate DATE, Cbirth DATE,
        Csubdistrict VARCHAR(100), Cdistrict VARCHAR(100), Cprovince VARCHAR(100),
        Czipcode VARCHAR(10), Cprofile STRING""",
    "orders": """
        Oid BIGINT NOT NULL, Oprice DECIMAL(10,2), Odate DATE, Ostatus VARCHAR(50), Cid BIGINT,
        Opayment STRING, Oslip STRING""",
    "order_items": """
        Oiid BIGINT NOT NULL, Oid BIGINT NOT NULL, Pid BIGINT NOT NULL, Oquantity INT NOT NULL,
        Oprice DECIMAL(10,2) NOT NULL""",
    "products": """
        Pid BIGINT NOT NULL, Pname VARCHAR(255), Pprice DECIMAL(10,2), Pnumproduct INT,
        Prenume INT, Pstatus VARCHAR(50), Ppicture VARCHAR(255), Pdetail STRING, Typeid BIGINT,
        Subtypeid BIGINT""",
    "product_types": "Typeid BIGINT NOT NULL, typenproduct VARCHAR(255)",
    "subtypes": "Subtypeid BIGINT NOT NULL, subname STRING, Typeid BIGINT",
    "payments": """
        Payid BIGINT NOT NULL, Oid BIGINT NOT NULL, Payprice DECIMAL(10,2), Paydate TIMESTAMP_NTZ,
        Paystatus VARCHAR(50), SlipUrl STRING, Tid BIGINT""",
    "transfer": """
        Tid BIGINT NOT NULL, Tname VARCHAR(255), Tnum INT, Taccount VARCHAR(255),
        Tbranch VARCHAR(255), Tqr STRING""",
    "reviews": """
        id BIGINT NOT NULL, text STRING NOT NULL, stars INT NOT NULL, created_at TIMESTAMP,
        order_id BIGINT""",
    "favorites": "id BIGINT NOT NULL, customer_id BIGINT, product_id BIGINT",
    # Declared by the shop, used by none of its queries.
    "admin": """
        Aid BIGINT NOT NULL, Aname VARCHAR(255), Aaddress VARCHAR(255), Ausername VARCHAR(50),
        Apassword VARCHAR(50), Aphone VARCHAR(15), Astatus VARCHAR(50), Adate DATE, Abirth DATE""",
    "auction_products": """
        PROid BIGINT NOT NULL, PROname VARCHAR(255), PROprice DECIMAL(10,2), PROrenume INT,
        PROstatus VARCHAR(50), PROpicture VARCHAR(255)""",
    "questions": """
        Askid BIGINT NOT NULL, Asktopic VARCHAR(255), Askaccount VARCHAR(255), Askdate DATE,
        Askmail VARCHAR(255), Askdetails STRING, Askvisits INT""",
    "replies": """
        Replyid BIGINT NOT NULL, Askid BIGINT, Replydetails STRING, Replydate DATE,
        Replyaccount VARCHAR(255), Replymail VARCHAR(255)""",
    "sales": """
        Tid BIGINT NOT NULL, Tname VARCHAR(255), Tnum INT, Taccount VARCHAR(255),
        Tbranch VARCHAR(255)""",
    "users": "id BIGINT NOT NULL, email VARCHAR(255) NOT NULL, password VARCHAR(255) NOT NULL",
}

PRIMARY_KEYS = {name: text.split()[0] for name, text in _DECLARED.items()}

FOREIGN_KEYS = [
    ("order_items", "Oid", "orders", "Oid"),
    ("order_items", "Pid", "products", "Pid"),
    ("payments", "Oid", "orders", "Oid"),
    ("replies", "Askid", "questions", "Askid"),
]

GAZETTEER_JSON = (
    "name_th STRING, amphure STRUCT<name_th: STRING, province: STRUCT<name_th: STRING>>, "
    "zip_code STRING"
)


def declared(table: str) -> T.StructType:
    """Schema with its ``VARCHAR`` limits."""
    return T.StructType.fromDDL(_DECLARED[table])


def schema(table: str) -> T.StructType:
    """Schema as used by frames: limits dropped, every text a plain string."""
    return T.StructType(
        [
            T.StructField(
                f.name,
                T.StringType() if isinstance(f.dataType, T.VarcharType) else f.dataType,
                f.nullable,
            )
            for f in declared(table)
        ]
    )


def table_names() -> list[str]:
    return list(_DECLARED)


def required_columns(table: str) -> list[str]:
    return [f.name for f in declared(table) if not f.nullable]

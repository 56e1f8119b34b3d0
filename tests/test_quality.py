from conftest import by, frame, money, rows

from marketloom import schemas
from marketloom.operators import quality
from marketloom.sources.tables import load_tables, write_snapshot


def test_unique(spark, edge):
    got = rows(quality.check_unique(edge["favorites"], ["customer_id", "product_id"]))
    assert got == [{"customer_id": 1, "product_id": 1, "n": 2}]
    nulls = spark.createDataFrame([(None,), (None,)], "email string")
    assert rows(quality.check_unique(nulls, ["email"])) == []


def test_not_null(spark, edge):
    got = by(quality.check_not_null(edge["orders"], ["Oid", "Cid", "Ostatus"]), "Oid")
    assert {k: r["missing"] for k, r in got.items()} == {3: "Cid", 5: "Ostatus"}
    for table in edge:
        assert quality.check_not_null(edge[table], schemas.required_columns(table)).isEmpty()


def test_foreign_keys(edge):
    got = quality.check_foreign_key(edge["order_items"], edge["orders"], "Oid")
    assert set(by(got, "Oiid")) == {9}
    assert set(by(quality.check_foreign_key(edge["order_items"], edge["products"], "Pid"), "Oiid")) == {4}
    # a review without an order passes
    got = quality.check_foreign_key(edge["reviews"], edge["orders"], "order_id", "Oid")
    assert set(by(got, "id")) == {4}


def test_range(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (6,), (None,)], "stars int")
    assert sorted(r["stars"] for r in rows(quality.check_range(df, "stars", 1, 5))) == [0, 6]


def test_lengths_count_characters(spark):
    text = "น" * 50
    df = spark.createDataFrame(
        [(1, text, money(5)), (2, text + "x", money(5)), (3, "x", money(10**8)), (4, None, None)],
        "Cid bigint, Cusername string, Oprice decimal(20,2)",
    )
    users = quality.check_lengths(df, schemas.declared("customers"))
    assert {k: r["too_long"] for k, r in by(users, "Cid").items()} == {2: "Cusername"}
    assert set(by(quality.check_lengths(df, schemas.declared("orders")), "Cid")) == {3}
    assert quality.check_lengths(df, schemas.declared("favorites")).isEmpty()


def test_payload(spark):
    schema = """Pid bigint, Pname string, Pprice string, Pnumproduct string, Pdetail string,
                Ppicture string, Pstatus string, Typeid bigint, Subtypeid bigint"""
    df = spark.createDataFrame(
        [
            (1, "n", "1.5", "2", "d", "p", "s", 1, 1),
            (2, "n", "much", "2", "d", None, "s", 1, 1),
            (3, "n", "1", None, "d", "", "s", 1, None),
        ],
        schema,
    )
    got = by(quality.check_product_payload(df), "Pid")
    assert {k: r["faults"] for k, r in got.items()} == {
        2: "Ppicture,Pprice",
        3: "Pnumproduct,Subtypeid",
    }


def test_cascade(spark, edge):
    keys = spark.createDataFrame([(1,)], "Oid bigint")
    assert set(by(quality.cascade_delete(keys, edge["payments"], "Oid"), "Payid")) == {3, 4}


def test_every_declared_key(spark):
    for table in schemas.table_names():
        key = schemas.PRIMARY_KEYS[table]
        assert key in schemas.schema(table).names
        assert quality.check_unique(frame(spark, table, []), [key]).isEmpty()
    for child, fk, parent, pk in schemas.FOREIGN_KEYS:
        assert fk in schemas.schema(child).names and pk in schemas.schema(parent).names


def test_snapshot_is_never_overwritten(spark, edge, tmp_path):
    folder = str(tmp_path)
    write_snapshot(edge["orders"], f"{folder}/orders")
    back = load_tables(spark, folder, ["orders"])["orders"]
    assert sorted(map(str, back.collect())) == sorted(map(str, edge["orders"].collect()))
    assert back.schema == schemas.schema("orders") or back.columns == schemas.schema("orders").names
    try:
        write_snapshot(edge["orders"].limit(0), f"{folder}/orders")
        raise RuntimeError("an existing path was overwritten")
    except Exception as error:
        assert "ALREADY_EXISTS" in str(error)
    assert back.count() == 6

import json

import pytest
from conftest import frame, rows

from marketloom import schemas
from marketloom.operators import orders
from marketloom.sources.gazetteer import load_gazetteer
from marketloom.sources.tables import load_tables, write_json, write_snapshot, write_tables


def test_tables_that_belong_together(spark, edge, tmp_path):
    folder = write_tables({n: edge[n] for n in ("orders", "order_items")}, str(tmp_path / "v1"))
    back = load_tables(spark, folder, ["orders", "order_items"])
    for name, df in back.items():
        assert sorted(map(str, rows(df))) == sorted(map(str, rows(edge[name])))
        assert [f.dataType for f in df.schema] == [f.dataType for f in schemas.schema(name)]


def test_all_tables_load_lazily_with_their_types(spark, tmp_path):
    for name in schemas.table_names():
        write_snapshot(frame(spark, name, []), f"{tmp_path}/{name}")
    tables = load_tables(spark, str(tmp_path))
    assert set(tables) == set(schemas.table_names())
    assert all(df.count() == 0 for df in tables.values())


def test_partitioned_snapshot_prunes(spark, edge, tmp_path):
    path = str(tmp_path / "orders")
    write_snapshot(edge["orders"], path, ["Odate"])
    some = spark.read.parquet(path).where("Odate = DATE '2025-01-05'")
    assert some.count() == 3
    assert "PartitionFilters: [isnotnull(Odate" in some._jdf.queryExecution().executedPlan().toString()


def test_json_keeps_nesting_and_nulls(spark, edge, tmp_path):
    path = str(tmp_path / "json")
    nested = orders.customer_orders_nested(edge)
    write_json(nested, path)
    text = [json.loads(r["value"]) for r in rows(spark.read.text(path))]
    by_id = {r["Oid"]: r for r in text}
    assert by_id[5]["items"] == [] and by_id[5]["Ostatus"] is None
    assert [i["Oiid"] for i in by_id[1]["items"]] == [1, 2]
    back = spark.read.schema(nested.schema).json(path)
    assert sorted(map(str, rows(back))) == sorted(map(str, rows(nested)))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_json(nested, path)


def test_gazetteer_keeps_its_order_over_many_files(spark, tmp_path):
    path = str(tmp_path / "places")
    entry = "named_struct('name_th', 'd', 'province', named_struct('name_th', 'p')) AS amphure"
    places = spark.range(5000).selectExpr(
        "concat('s', id) AS name_th", entry, "CAST(id % 7 AS STRING) AS zip_code", "id"
    )
    write_json(places.repartitionByRange(6, "id").sortWithinPartitions("id").drop("id"), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits per file
    try:
        back = load_gazetteer(spark, path, multi_line=False)
        assert back.rdd.getNumPartitions() > 6
        names = [r["subdistrict"] for r in rows(back.orderBy("pos"))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert names == [f"s{i}" for i in range(5000)]

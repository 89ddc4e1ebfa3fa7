from kgraph.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_queries_over_whole_tables(spark):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    parts = QUERIES["blast_radius_all_roots"](spark, SF).where("root LIKE 'part/%'").select("root").distinct().count()
    assert parts == table("lineitem").select("l_partkey").distinct().count()
    roots = QUERIES["walk_flow"](spark, SF).select("root").distinct().count()
    assert roots == sum(table(t).count() for t in ("region", "nation", "customer", "supplier", "part", "orders"))
    paths = {r.path for r in QUERIES["file_collisions"](spark, SF).select("path").collect()}
    assert any(int(p[1:]) > 60 for p in paths)
    bundle = QUERIES["node_bundle"](spark, SF)
    assert bundle.select("other_type").distinct().count() == 6 and bundle.where("label <> ''").count() > 0
    assert QUERIES["signals_for_paths"](spark, SF).agg({"id": "max"}).first()[0] >= table("customer").count() // 10 - 1

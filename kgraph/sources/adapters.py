"""Views of the driver's tables as canonical tables.

Ids are arithmetic on keys (key * 8 + kind), so that no numbering has to see all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EDGE_TYPES, SEED_EDGE_TYPES

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(key, kind: int):
    return (F.col(key).cast("long") * 8 + kind).cast("long")


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, region: a row per nation, 25 of them."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", "n_name", F.col("r_name").alias("region"), "n_regionkey")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project, file, name, type, line: one node per row of region, nation, customer, supplier, part and orders."""
    t = lambda n: table(spark, sf_dir, n)
    nation = F.broadcast(regions_of(spark, sf_dir))

    def rows(df: DataFrame, kind: int, label: str, key: str, name: str, project, line) -> DataFrame:
        return df.select(
            node_id(key, kind).alias("id"),
            project.alias("project"),
            F.concat(F.lit(label + "/"), F.col(key).cast("string")).alias("file"),
            F.col(name).cast("string").alias("name"),
            F.lit(label).alias("type"),
            line.cast("int").alias("line"),
        )

    customers = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(customers.select("c_custkey", "region"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None)
    return (
        rows(t("region"), REGION, "region", "r_regionkey", "r_name", F.col("r_name"), none)
        .unionByName(rows(regions_of(spark, sf_dir), NATION, "nation", "n_nationkey", "n_name", F.col("region"), F.col("n_regionkey") + 1))
        .unionByName(rows(customers, CUSTOMER, "customer", "c_custkey", "c_name", F.col("region"), F.col("c_nationkey") + 1))
        .unionByName(rows(suppliers, SUPPLIER, "supplier", "s_suppkey", "s_name", F.col("region"), F.col("s_nationkey") + 1))
        .unionByName(rows(t("part"), PART, "part", "p_partkey", "p_name", F.lit("PARTS"), F.col("p_size")))
        .unionByName(rows(orders, ORDER, "orders", "o_orderkey", "o_orderpriority", F.col("region"), none))
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, type, category: child to parent imports, order to part calls, order to supplier queries_table."""
    t = lambda n: table(spark, sf_dir, n)

    def rows(df: DataFrame, source, target, kind: str, category: str = "structural") -> DataFrame:
        return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), F.lit(category).alias("category"))

    return (
        rows(t("nation"), node_id("n_nationkey", NATION), node_id("n_regionkey", REGION), "imports")
        .unionByName(rows(t("customer"), node_id("c_custkey", CUSTOMER), node_id("c_nationkey", NATION), "imports"))
        .unionByName(rows(t("supplier"), node_id("s_suppkey", SUPPLIER), node_id("s_nationkey", NATION), "imports"))
        .unionByName(rows(t("orders"), node_id("o_orderkey", ORDER), node_id("o_custkey", CUSTOMER), "imports"))
        .unionByName(rows(t("lineitem"), node_id("l_orderkey", ORDER), node_id("l_partkey", PART), "calls"))
        .unionByName(rows(t("lineitem"), node_id("l_orderkey", ORDER), node_id("l_suppkey", SUPPLIER), "queries_table", "data_flow"))
    )


def edge_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_EDGE_TYPES, EDGE_TYPES)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents as labels of nodes: two detectors a document, one from quality and one from toxic."""
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    category = F.when(F.col("quality") == 1, "validation").otherwise("error-handler")
    source = F.when(F.col("toxic") == 1, "manual").when(F.col("doc_id") % 3 == 0, "llm").otherwise("heuristic")
    confidence = F.when(F.col("quality") == 1, 0.9).otherwise(0.7)
    return t.select(
        (F.col("doc_id") * 2).alias("id"),
        F.col("doc_id").alias("node_id"),
        F.lit("quality").alias("detector_id"),
        category.alias("category"),
        category.alias("term"),
        source.alias("source"),
        confidence.alias("confidence"),
        (F.col("quality") == 0).alias("is_stale"),
    ).unionByName(
        t.where("doc_id % 2 = 0").select(
            (F.col("doc_id") * 2 + 1).alias("id"),
            F.col("doc_id").alias("node_id"),
            F.lit("toxic").alias("detector_id"),
            F.lit("middleware").alias("category"),
            F.lit("middleware").alias("term"),
            F.lit("heuristic").alias("source"),
            F.lit(0.8).alias("confidence"),
            F.lit(False).alias("is_stale"),
        )
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: project, file, content."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("file"),
        F.col("text").alias("content"),
        F.col("doc_id"),
    )


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(F.col("doc_id").alias("id"), "project", "file", F.col("file").alias("name"), F.lit("module").alias("type"), F.lit(1).alias("line"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as session lines: session_id, ln, ts, kind (boundary, explore, write, user), file, text.

    A session is a user's events by time; sign-ups are boundaries, views and clicks explore, purchases write.
    """
    from pyspark.sql import Window

    kind = (
        F.when(F.col("event_type") == "signup", "boundary")
        .when(F.col("event_type").isin("view", "click"), "explore")
        .when(F.col("event_type") == "purchase", "write")
        .otherwise("user")
    )
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.row_number().over(order).cast("long").alias("ln"),
        "ts",
        kind.alias("kind"),
        F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("file"),
        F.concat(F.col("event_type"), F.lit(" report "), F.col("event_type")).alias("text"),
        F.col("event_type").alias("tool"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session messages: session_id, ln, side, text."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ln"), F.col("role").alias("side"), "text"
    )

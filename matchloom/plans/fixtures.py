"""The product-matching tables, derived from the star schema: as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical
from ..sources.shared import size_shuffles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """id, name, category, brand, size, price_cents, and attributes as JSON text."""
    p = table(spark, d, "part")
    cents = F.rint(F.col("p_retailprice") * 100).cast("long")
    text = F.concat(F.lit('{"бренд":"'), "p_brand", F.lit('","тип":"'), "p_type", F.lit('","размер, см":"'), F.col("p_size").cast("string"), F.lit('","артикул":"'), F.regexp_replace("p_brand", "[^0-9A-Za-z]", ""), F.lit("-"), F.col("p_size").cast("string"), F.lit('"}'))
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"), cents.alias("price_cents"), text.alias("attributes"))


def dealt_items(spark: SparkSession, d: str) -> DataFrame:
    """items dealt by id, for dear work on each: their files are so small that few tasks would do it all."""
    size_shuffles(spark, f"{d}/lineitem.parquet")
    return items(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """id1, id2, okey: the parts of two lines of an order."""
    size_shuffles(spark, f"{d}/lineitem.parquet")
    l = table(spark, d, "lineitem")  # noqa: E741
    a = l.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("n1"), F.col("l_partkey").alias("id1"))
    b = l.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("n2"), F.col("l_partkey").alias("id2"))
    return a.join(b, "okey").filter("n1 < n2").select("id1", "id2", "okey")


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Model labels: target a ninth of votes."""
    v = (7 * F.col("id1") + 7 * F.col("id2") + F.col("okey") % 3) % 10
    return edges(spark, d).select("id1", "id2", v.alias("votes"), (v / F.lit(9.0)).alias("target"))


def human(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("id1", "id2", F.when((F.col("id1") + F.col("id2")) % 4 == 0, 1).otherwise(0).alias("target"))


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a review model: source_score in thousandths."""
    return edges(spark, d).select("id1", "id2", ((37 * F.col("id1") + 37 * F.col("id2")) % 1000 / F.lit(1000.0)).alias("source_score"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs with target, predict and the category of the smaller id. They are dealt by u, which does for the
    repeats, for the category and for whatever else is joined by u."""
    rows = canonical(human(spark, d)).select("u", "v", "target").repartition("u").distinct()
    predict = (53 * F.col("u") + 91 * F.col("v")) % 997 / F.lit(997.0)
    own = items(spark, d).select(F.col("id").alias("u"), "category")
    return rows.join(own.hint("shuffle_hash"), "u").select("u", "v", "target", "category", predict.alias("predict"))


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Texts of neighbouring documents: id, a, b."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("text").alias("a")).join(t.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("b")), "id")


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("test"), (F.col("o_orderkey") % 3).alias("seed")).agg((F.sum(F.rint(F.col("o_totalprice") * 100).cast("long")) / F.lit(100.0)).alias("metric"))


#: The same as common table expressions.
SQL = {
    "items_v": "SELECT p_partkey AS id, p_name || ' ' || p_brand AS name, p_type AS category, p_brand AS brand, CAST(p_size AS BIGINT) AS size, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS price_cents, "
    """'{"бренд":"' || p_brand || '","тип":"' || p_type || '","размер, см":"' || p_size || '","артикул":"' || regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g') || '-' || p_size || '"}' AS attributes FROM part""",
    "edges_v": "SELECT a.l_partkey AS id1, b.l_partkey AS id2, a.l_orderkey AS okey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber",
    "votes_v": "SELECT id1, id2, (7 * id1 + 7 * id2 + okey % 3) % 10 AS votes, ((7 * id1 + 7 * id2 + okey % 3) % 10) / 9e0 AS target FROM edges_v",
    "human_v": "SELECT id1, id2, CASE WHEN (id1 + id2) % 4 = 0 THEN 1 ELSE 0 END AS target FROM edges_v",
    "reviewed_v": "SELECT id1, id2, (37 * id1 + 37 * id2) % 1000 / 1000e0 AS source_score FROM edges_v",
    "scores_v": "SELECT u, v, target, category, (53 * u + 91 * v) % 997 / 997e0 AS predict FROM (SELECT DISTINCT least(id1, id2) AS u, greatest(id1, id2) AS v, target FROM human_v) JOIN items_v ON id = u",
    "doc_pairs_v": "SELECT d.doc_id AS id, d.text AS a, e.text AS b FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1",
    "runs_v": "SELECT o_orderpriority AS test, o_orderkey % 3 AS seed, sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) / 100e0 AS metric FROM orders GROUP BY 1, 2",
}
NEEDS = {"votes_v": ("edges_v",), "human_v": ("edges_v",), "reviewed_v": ("edges_v",), "scores_v": ("edges_v", "human_v", "items_v")}


def with_views(query: str, *more: str) -> str:
    """``query`` with the views it names defined before it; ``more`` are further definitions, in order."""
    text, names = query + " ".join(more), []
    for name in SQL:
        if name in text or any(name in NEEDS.get(other, ()) for other in SQL if other in text):
            names.append(name)
    return "WITH " + ",\n".join([f"{n} AS ({SQL[n]})" for n in names] + list(more)) + "\n" + query if names or more else query

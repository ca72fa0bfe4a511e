"""Reading items, matches and run records; writing predictions and checkpoints."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import require_columns
from .shared import discard, exists, hadoop

ITEMS = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("attributes", T.StringType())])
RUN = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "created_at", "model", "dataset")] + [T.StructField("metric", T.DoubleType())])
#: Keys of the card layout.
NAME_KEY, MODEL_KEY, CATEGORY_KEY = "Название", "Код модели", "категория"


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The columns of a Parquet table; others are not read."""
    found = spark.read.parquet(path)
    return require_columns(found, *columns).select(*columns) if columns else found


def layout(spark: SparkSession, path: str) -> str:
    """ "flat" or "card", from the schema alone."""
    names = set(spark.read.parquet(path).columns)
    if "card_json" in names:
        return "card"
    if {"id", "name", "category", "attributes"} <= names:
        return "flat"
    raise ValueError(f"{path} has neither layout of items")


def from_cards(cards: DataFrame) -> DataFrame:
    """Items (id, name, category, attributes) from id, category and card_json: name is made of two of its keys, category
    may come from a third, the rest are attributes."""
    entries = F.from_json("card_json", "map<string,string>")
    rows = cards.withColumn("m", entries)
    name = F.trim(F.concat_ws(" ", F.col("m")[NAME_KEY], F.col("m")[MODEL_KEY]))
    rest = F.map_filter("m", lambda k, v: ~k.isin(NAME_KEY, MODEL_KEY, CATEGORY_KEY))
    return rows.select("id", name.alias("name"), F.coalesce(F.col("m")[CATEGORY_KEY], F.col("category")).alias("category"), F.to_json(rest).alias("attributes"))


def read_items(spark: SparkSession, *paths: str) -> DataFrame:
    """Items of either layout from several files; an id in two of them is an error."""
    parts = [from_cards(spark.read.parquet(p)) if layout(spark, p) == "card" else read_parquet(spark, p, *ITEMS.fieldNames()) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not repeated_ids(out).isEmpty():
        raise ValueError("an item id comes twice")
    return out


def repeated_ids(items: DataFrame) -> DataFrame:
    return items.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def first_of_each(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """Of rows with equal key the one of the first source (then the least row)."""
    rows = None
    for k, s in enumerate(sources):
        part = s.withColumn("_source", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    order = ["_source", *[c for c in rows.columns if c not in ("_source", key)]]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n", "_source")


def inference_inputs(items: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the items that matches refer to, matches), or an error: columns missing, null, repeated or unknown ids."""
    require_columns(items, "id", "name", "category", "attributes")
    require_columns(matches, "id1", "id2")
    ids = matches.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    # one job for all three rules: how often each id that matches name is an item
    held = ids.join(items.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    wrong = held.agg(F.count_if(F.col("id").isNull()).alias("null"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("id").isNotNull() & F.col("n").isNull()).alias("unknown")).first()
    for found, what in zip(wrong, ("matches has null ids", "an item id comes twice", "matches has unknown ids")):
        if found:
            raise ValueError(what)
    return items.join(ids, "id", "left_semi"), matches


def write_predictions(rows: DataFrame, path: str) -> None:
    """id1, id2, predict as CSV with a header, sorted by pair_row over all files; predict must be finite."""
    if not rows.filter("predict is null or isnan(predict) or abs(predict) = double('infinity')").isEmpty():
        raise ValueError("a prediction is not finite")
    rows.orderBy("pair_row").select("id1", "id2", "predict").write.mode("overwrite").option("header", True).csv(path)


CURRENT = "CURRENT"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the table's rows: the version that the file CURRENT names; None if there is no table yet."""
    if not exists(spark, f"{path}/{CURRENT}"):
        return None
    return f"{path}/{spark.read.text(f'{path}/{CURRENT}', wholetext=True).first()[0].strip()}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that replace_table() keeps."""
    return spark.read.parquet(current_version(spark, path) or path)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What ``write`` puts in a folder of its own becomes the current version at path. The file that names it is replaced by
    one rename, so readers see all of the old version or all of the new, and a failure before it leaves the old. The
    version before the last stays for jobs that read it; older ones go."""
    last = current_version(spark, path)
    new = f"v-{uuid.uuid4().hex}"
    write(f"{path}/{new}")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    files, named = hadoop(spark, f"{path}/{CURRENT}")
    _, part = hadoop(spark, f"{path}/{CURRENT}.{new}")
    _put(files, part, new)
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(part), files.makeQualified(named), over)
    for found in files.listStatus(hadoop(spark, path)[1]):
        name = found.getPath().getName()
        if name.startswith("v-") and name not in (new, (last or "").rpartition("/")[2]):
            discard(spark, f"{path}/{name}")


def _put(files, at, text: str) -> None:
    out = files.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def replace_table(df: DataFrame, path: str) -> None:
    """df in the place of the table at path, which df may read. A table is a folder of versions and a file that names the
    current one (see publish())."""
    publish(df.sparkSession, path, lambda folder: df.write.parquet(folder))


def write_report(results: DataFrame, aggregates: DataFrame, report: dict, path: str) -> None:
    """The rows of a run, their aggregates and what is said about them (report.json), published together or not at all."""
    spark = results.sparkSession

    def write(folder: str) -> None:
        results.write.parquet(f"{folder}/results.parquet")
        aggregates.write.parquet(f"{folder}/aggregates.parquet")
        _put(*hadoop(spark, f"{folder}/report.json"), json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True))

    publish(spark, path, write)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Results, aggregates and report of one and the same run; an error if there is none."""
    at = current_version(spark, path)
    if at is None:
        raise ValueError(f"no report at {path}")
    said = json.loads(spark.read.text(f"{at}/report.json", wholetext=True).first()[0])
    return spark.read.parquet(f"{at}/results.parquet"), spark.read.parquet(f"{at}/aggregates.parquet"), said


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records (a JSON object a file) sorted by (created_at, name); a missing field or repeated name is an error."""
    rows = spark.read.schema(RUN).option("multiLine", True).json(path)
    if not rows.filter("name is null or created_at is null").isEmpty():
        raise ValueError("a run record lacks a field")
    if not rows.groupBy("name").count().filter("count > 1").isEmpty():
        raise ValueError("two run records have one name")
    return rows.orderBy("created_at", "name")


def write_registry(runs: DataFrame, path: str) -> None:
    runs.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row a run: a small table

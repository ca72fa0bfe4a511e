"""Names in one wording: phrases replaced by longest match over a table of synonyms, word by word through lemmas, and put into
the form that the word they replace has.

Names are few beside the rows that carry them, so they are normalised once each. All that is looked up is looked up by
joins, whatever size the tables are; Spark broadcasts those that are small. What is ordered is a name's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import require_columns
from ..functions.text import let

#: Words and what is between them; a phrase's words stand one blank apart.
PARTS = r"\p{L}+|[^\p{L}]+"
LONGEST = 4


def synonym_table(groups: DataFrame) -> DataFrame:
    """phrase, replacement (lower case) from rows of ``replacer`` and its ``synonyms`` (an array). Nulls are left out; of a
    phrase that several replace, the least replacer counts."""
    require_columns(groups, "replacer", "synonyms")
    each = groups.filter(F.col("replacer").isNotNull()).select(F.lower("replacer").alias("replacement"), F.explode("synonyms").alias("phrase"))
    return each.filter(F.col("phrase").isNotNull()).groupBy(F.lower("phrase").alias("phrase")).agg(F.min("replacement").alias("replacement"))


def _spans(names: DataFrame, longest: int) -> DataFrame:
    """name, at, n and the words of each run of up to ``longest`` words that stand one blank apart; at counts parts."""

    def phrases(parts: Column) -> Column:
        word = lambda i: F.get(parts, i).rlike(r"^\p{L}+$")
        joined = lambda i, n: F.forall(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: (F.get(parts, i + 2 * k - 1) == " ") & word(i + 2 * k)) if n > 1 else F.lit(True)
        words = lambda i, n: F.array(*[F.get(parts, i + 2 * k) for k in range(n)])
        of = lambda i: F.array(*[F.when(word(i) & F.coalesce(joined(i, n), F.lit(False)), F.struct(i.alias("at"), F.lit(n).alias("n"), words(i, n).alias("words"))) for n in range(1, longest + 1)])
        return F.filter(F.flatten(F.transform(parts, lambda _, i: of(i))), lambda s: s.isNotNull())

    return names.select("name", F.explode_outer(let(F.col("parts"), phrases)).alias("s")).filter("s IS NOT NULL").select("name", "s.*")


def _replacements(spans: DataFrame, table: DataFrame, morphology: DataFrame | None) -> DataFrame:
    """name, at, n, text: what each span is replaced by, if anything: by its lemmas first, then as it stands."""
    table = table.select("phrase", "replacement")
    spans = spans.withColumn("phrase", F.array_join("words", " "))
    if morphology is None:
        return spans.join(table, "phrase").select("name", "at", "n", F.col("replacement").alias("text"))
    forms = require_columns(morphology, "word", "lemma", "tags").groupBy(F.lower("word").alias("word")).agg(F.min(F.struct("lemma", "tags")).alias("m"))
    each = spans.select("name", "at", "n", "phrase", F.posexplode("words").alias("k", "word")).join(forms, "word", "left")
    lemmas = each.groupBy("name", "at", "n").agg(F.first("phrase").alias("phrase"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("m.lemma", "word").alias("l")))), lambda x: x["l"]), " ").alias("lemmas"), F.max_by("m.tags", "k").alias("tags"))
    by_lemma = table.select(F.col("phrase").alias("lemmas"), F.col("replacement").alias("by_lemma"))
    found = lemmas.join(by_lemma, "lemmas", "left").join(table.withColumnRenamed("replacement", "by_word"), "phrase", "left")
    found = found.select("name", "at", "n", "tags", F.coalesce("by_lemma", "by_word").alias("replacement")).filter("replacement IS NOT NULL")
    # the form of the replacement that has the tags of the word (of a phrase: its last word) replaced
    inflected = morphology.groupBy(F.lower("lemma").alias("replacement"), "tags").agg(F.min(F.lower("word")).alias("form"))
    return found.join(inflected, ["replacement", "tags"], "left").select("name", "at", "n", F.coalesce("form", "replacement").alias("text"))


def normalize_names(names: DataFrame, table: DataFrame, morphology: DataFrame | None = None, longest: int = LONGEST) -> DataFrame:
    """name, normalized for each distinct name: in lower case, read from left to right, the longest phrase of the table
    (phrase, replacement) at each word replaced. Words are runs of letters; what is between them stays.

    morphology (word, lemma, tags), if given, lets a phrase match by its words' lemmas before their forms, and gives the
    replacement the form with the same tags, where it knows one. A phrase has ``longest`` words at most. A null name
    isn't returned.
    """
    if longest < 1:
        raise ValueError("a phrase has one word at least")
    require_columns(table, "phrase", "replacement")
    own = names.select(F.col("name").alias("name")).filter(F.col("name").isNotNull()).distinct()
    parts = own.withColumn("parts", F.regexp_extract_all(F.lower("name"), F.lit(PARTS), F.lit(0)))
    found = _replacements(_spans(parts, longest), table, morphology)
    longest_at = found.groupBy("name", "at").agg(F.max_by(F.struct("n", "text"), "n").alias("r")).select("name", F.struct("at", F.col("r.n").alias("n"), F.col("r.text").alias("text")).alias("r"))
    per_name = longest_at.groupBy("name").agg(F.array_sort(F.collect_list("r")).alias("found"))  # of a name's own words

    def chosen(found: Column) -> Column:
        """Those that start after the one before has ended."""
        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,n:int,text:string>>").alias("out"))
        step = lambda s, r: F.when(r["at"] >= s["free"], F.struct((r["at"] + 2 * r["n"] - 1).alias("free"), F.concat(s["out"], F.array(r)).alias("out"))).otherwise(s)
        return F.aggregate(found, start, step, lambda s: s["out"])

    def rebuilt(parts: Column, chosen: Column) -> Column:
        inside = lambda i: F.filter(chosen, lambda r: (r["at"] <= i) & (i < r["at"] + 2 * r["n"] - 1))
        one = lambda p, i: let(F.get(inside(i), F.lit(0)), lambda r: F.when(r.isNull(), p).when(r["at"] == i, r["text"]).otherwise(F.lit("")))
        return F.array_join(F.transform(parts, one), "")

    both = parts.join(per_name, "name", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<at:int,n:int,text:string>>")))
    return both.select("name", let(chosen(F.col("found")), lambda c: rebuilt(F.col("parts"), c)).alias("normalized"))


def rename_by_table(rows: DataFrame, key: str, attributes: str, names: DataFrame) -> DataFrame:
    """rows with their attributes (array of k, v) under the names of a table (name, normalized; names not in it stay). Of
    names that become equal the first stays. ``key`` tells rows apart; null or empty attributes stay as they are."""
    each = rows.select(F.col(key).alias("_key"), F.posexplode(attributes).alias("_at", "a"))
    new = each.select("_key", "_at", F.col("a.k").alias("name"), F.col("a.v").alias("v")).join(names.select("name", "normalized"), "name", "left").withColumn("k", F.coalesce("normalized", "name"))
    first = new.withColumn("nth", F.row_number().over(Window.partitionBy("_key", "k").orderBy("_at"))).filter("nth = 1")
    again = first.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "k", "v"))).alias("_new"))  # a row's own
    renamed = F.transform("_new", lambda a: F.struct(a["k"].alias("k"), a["v"].alias("v")))
    return rows.join(again, rows[key] == again["_key"], "left").select(*[F.coalesce(renamed, F.col(c)).alias(c) if c == attributes else rows[c] for c in rows.columns])

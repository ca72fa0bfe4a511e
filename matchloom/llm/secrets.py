"""Secret scans with a random forest against false positives (operator 2), in DataFrame functions and pyspark.ml only.

Candidates come from one regular expression; a forest over their length, character transitions, dictionary coverage,
path and neighbouring words, trained from labelled findings, tells secrets from look-alikes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

_NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|private[_-]?key|credentials?)"
_BLANKS = r"[ \t\x{A0}]{0,80}"
#: What may follow in a name (password_prod, secretKey, tokens), and the blanks about a separator; look-behinds need a bound.
_ASSIGNED = rf"{_NAME}(?:s|[A-Z0-9_.-][A-Za-z0-9_.-]{{0,40}})?[\"']?\]?{_BLANKS}[:=]{{1,2}}>?{_BLANKS}"
_PEM_BEGIN, _PEM_END = (rf"-----{x} [A-Z0-9 ]{{0,24}}PRIVATE KEY(?: BLOCK)?-----" for x in ("BEGIN", "END"))
#: To its END; without one, to the end of the text if a key or a header line follows; else BEGIN alone, as in prose.
_PEM = rf"{_PEM_BEGIN}(?:(?s:.*?){_PEM_END}|(?=(?:[^A-Za-z0-9+/=]|\\[nr]){{0,16}}(?:[A-Z][A-Za-z-]{{2,20}}:|[A-Za-z0-9+/=]{{16}}))(?s:.*)|)"
#: From behind a quote to the next that is not escaped, in a line, 6 characters at least.
_QUOTED = {q: rf"(?!(?:[^{q}\\\r\n]|\\.){{0,5}}{q})[^\r\n]{{6,}}?(?:(?<!\\)|(?<=(?<!\\)\\\\))(?={q})" for q in ("\"", "'")}
_BARE_VALUE = r"[^\s\"',;:=>][^\s\"',;]{5,}"
#: The user of a connection string; its password goes to the last @ before a slash.
_USER, _PASSWORD = r"[A-Za-z]://[^\s/:@\"'<>]{0,100}:", r"[^\s\"'<>/]{3,}(?=@)"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}"
#: A PEM key block; the password of a connection string; what is assigned to a name that speaks of secrets, quoted or
#: not; a run of 12 characters or more with a digit. The short look-behinds keep the long ones from most characters.
CANDIDATE = (
    rf"{_PEM}|(?<=[:=>\"' \t\x{{A0}}])(?:(?<=:)(?<={_USER}){_PASSWORD}|(?<=[:=]>?{_BLANKS}[\"']?)"
    rf"(?:(?<=\")(?<={_ASSIGNED}\"){_QUOTED['"']}|(?<=')(?<={_ASSIGNED}'){_QUOTED["'"]}|(?=[^\s\"',;:=>])(?<={_ASSIGNED}[\"']?){_BARE_VALUE}))"
    rf"|{_RUN}(?:={{1,2}}(?![^\s\"',;)\]}}]))?"
)
#: Found in a text if and only if CANDIDATE is; quicker, as it looks ahead from the name and not back at each character.
PRESENT = rf"{_PEM_BEGIN}|{_USER}{_PASSWORD}|{_ASSIGNED}(?:\"{_QUOTED['"']}|'{_QUOTED["'"]}|[\"']?{_BARE_VALUE})|{_RUN}"
#: From the end of one candidate to that of the next; groups: the candidate, up to BEFORE characters before it, AFTER after it.
BEFORE, AFTER = 255, 32
SEGMENT = rf"(?s)\G.*?(?=({CANDIDATE}))(?<=(^.{{0,{BEFORE - 1}}}|.{{{BEFORE}}}))\1(?=(.{{0,{AFTER}}}))"
MASK = "[SECRET]"
#: Common words whose share of a candidate speaks against a secret.
DICTIONARY = (
    "about account after also and any are back because been before between both but can change client code commit config could data date day "
    "default demo dev doc docs down example file first for from function get good has have her here his how image index info into item just key "
    "know lib like local look main make many may model more most name new not now number only other our out over page people placeholder prod "
    "public sample see service set she should some state such system table tag take test than that the their them then there these they thing "
    "think this time token type under use user value version very was way well were what when where which who will with word work would year you your"
).split()
NEAR_SECRET = r"(?i)(secret|token|passw|passphrase|pwd|api[ _-]?key|private|credential|bearer|auth|access[ _-]?key)"
NEAR_OTHER = r"(?i)(commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|build|version|isbn|phone|card|order|invoice|serial|track|id\b|example)"
FEATURES = (
    "length transitions digit_share upper_share letter_share hex_share mark_share distinct_share longest_run vowel_share dictionary_coverage "
    "known_prefix placeholder assigned named in_uri is_name blanks reference near_secret near_other path_in_value path_is_test path_is_config"
).split()
#: Labelled findings that the default forest is trained on, at most.
MAX_FINDINGS = 6_000
TREES, DEPTH, SEED = 24, 8, 7


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to columns value, before (the text before), after and path; nulls count as empty."""
    v, before = F.coalesce("value", F.lit("")), F.regexp_replace(F.coalesce("before", F.lit("")), r"[ \t\x{A0}]+", " ")
    after, path = F.coalesce("after", F.lit("")), F.coalesce("path", F.lit(""))
    n = F.greatest(F.char_length(v), F.lit(1)).cast("double")
    share = lambda kind: F.regexp_count(v, F.lit(kind)) / n
    runs = reduce(lambda c, k: F.regexp_replace(c, k[0], k[1]), (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")), v)
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    runs_of_one = F.regexp_extract_all(v, F.lit(r"([a-z]+|[A-Z]+|[0-9]+)"), F.lit(1))
    flag = lambda c: c.cast("double")
    near = F.right(before, F.lit(32))
    values = {
        "length": F.char_length(v).cast("double"),
        "transitions": F.greatest(F.char_length(runs) - 1, F.lit(0)) / n,
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "letter_share": share("[A-Za-z]"),
        "hex_share": share("[0-9a-f]"),
        "mark_share": share("[^0-9A-Za-z]"),
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "longest_run": F.coalesce(F.array_max(F.transform(runs_of_one, lambda r: F.char_length(r))), F.lit(0)) / n,
        "vowel_share": share("(?i)[aeiou]"),
        "dictionary_coverage": 1 - F.char_length(F.regexp_replace(F.lower(v), words, "")) / n,
        "known_prefix": flag(v.rlike(r"^(AKIA|ASIA)[A-Z0-9]{12,}|^gh[pousr]_|^xox[abp]-|^eyJ|^[sr]k_(live|test)|^-----BEGIN")),
        "placeholder": flag(v.rlike(r"(?i)example|sample|placeholder|change_?me|your_|dummy|xxxx|(.)\1{4}|0123|1234567|abcdef")),
        "assigned": flag(before.rlike(r"[:=]>? ?[\"']?$")),
        "named": flag(before.rlike(rf"{_ASSIGNED}[\"']?$")),
        "in_uri": flag(before.rlike(rf"{_USER}$")),
        "is_name": flag(v.rlike(rf"^[A-Za-z0-9_-]*{_NAME}[A-Za-z0-9_-]*$")),
        "blanks": F.regexp_count(v, F.lit(r"\s")).cast("double"),
        "reference": flag(v.rlike(r"^[$<{%]|[(\[]|^[a-z]+(\.[A-Za-z_]+)+$|^(required|string|optional|undefined|default|disabled|enabled|missing|hidden)$")),
        "near_secret": flag(near.rlike(NEAR_SECRET)),
        "near_other": flag(F.concat(near, F.lit(" "), F.left(after, F.lit(16))).rlike(NEAR_OTHER)),
        "path_in_value": flag(v.rlike(r"[A-Za-z_-]{3,}/[A-Za-z_-]{2,}")),
        "path_is_test": flag(path.rlike(r"(?i)test|example|sample|fixture|mock|docs?/")),
        "path_is_config": flag(path.rlike(r"(?i)\.env|config|secret|settings|\.ya?ml|\.pem")),
    }
    return found.withColumns(values)


def labelled_findings(spark: SparkSession, n: int = MAX_FINDINGS) -> DataFrame:
    """n made-up findings with labels: value, before, after, path, label (1: a secret). The same each time.

    Secrets: random hex, base64, upper-case key ids, assigned passwords (random, of joined words, of spaced words),
    prefixed tokens, PEM blocks, passwords of connection strings, bare base64 keys. Look-alikes: card, phone and order
    numbers, commit hashes and checksums, UUIDs, dates, versions, paths, slugs, placeholders, joined words, names with
    digits, references to code and sentences that are assigned.
    """
    rows = spark.range(n).withColumns({"h": F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512), "kind": (F.col("id") % 31).cast("int")})
    h = F.col("h")
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[+/=\\r\\n]", "")
    pick = lambda items, at: F.element_at(F.array(*[F.lit(x) for x in items]), (F.conv(F.substring(h, at, 4), 16, 10).cast("int") % len(items)) + 1)
    w = lambda at: pick(["the", "of", "und", "les", "running", "station", "erhalten", "maison", "para", "nation", "with", "orders", "ungen", "ciones"], at)
    number = lambda k, at: F.substring(F.translate(F.substring(h, at, 60), "abcdef", "193756"), 1, k)
    upper = F.upper(F.substring(F.translate(F.substring(h, 9, 60), "01", "QZ"), 1, 16))
    quote = pick(['"', "'", ""], 120)
    assign = lambda *names: F.concat(w(1), F.lit(" "), w(5), F.lit(" "), pick(names, 13), pick([" = ", "=", ": "], 17), quote)
    plain = F.concat(w(1), F.lit(" "), w(5), F.lit(" "), w(9), F.lit(" "))
    after = F.concat(quote, F.lit(" "), w(21), F.lit(" "), w(25))
    secretive = ("token", "secret", "password", "api_key", "access_key", "auth_token")
    positive = [
        (F.substring(h, 1, 40), assign(*secretive)), (F.substring(h, 1, 18), assign("password", "passwd", "pwd")), (F.concat(F.lit("AKIA"), upper), plain),
        (F.substring(b64, 1, 40), assign(*secretive)), (F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), plain), (F.substring(b64, 1, 24), assign(*secretive)),
        (F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)), plain), (F.substring(h, 1, 32), assign(*secretive)), (F.concat(F.lit("AKIA"), upper), assign("key", "access_key")),
        (F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), b64, F.lit("\n"), F.reverse(b64), F.lit("\n-----END PRIVATE KEY-----")), plain),
        (F.concat(w(33), w(37), pick(["!", "-", "", "_", "9", "#"], 30), w(45)), F.concat(w(1), F.lit("://"), w(5), F.lit(":"))), (F.substring(h, 1, 14), F.concat(w(1), F.lit(" postgres://"), w(5), F.lit(":"))),
        (F.substring(b64, 1, 40), plain), (F.substring(b64, 1, 64), plain),
        (F.concat(w(33), w(37), pick(["!", "-", "", "", "_", "#"], 30), w(45)), assign("password", "db_password_prod", "secret", "secret_key", "passwd")),
        (F.concat(w(33), pick([" ", " ", "\\\"", "! "], 49), w(37), pick([" ", "", "9 "], 53), w(45)), F.concat(w(1), F.lit(" "), pick(['password = "', 'passphrase: "', 'secret_key = "'], 13))),
    ]
    uuid = F.concat_ws("-", *[F.substring(h, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    negative = [
        (number(16, 1), plain), (F.concat_ws("-", number(3, 1), number(3, 9), number(4, 20)), plain), (F.substring(h, 1, 40), F.concat(w(1), pick([" commit ", " sha1 ", " checksum ", " digest "], 13))),
        (uuid, F.concat(w(1), pick([" id ", " uuid ", " request id: "], 13))), (F.concat_ws("-", w(1), w(5), w(9), number(4, 30)), plain), (F.concat_ws("/", w(1), w(5), w(9), number(2, 30)), plain),
        (F.concat(pick(["changeme", "your_password", "example_token", "xxxxxxxx", "placeholder"], 33), number(2, 30)), assign(*secretive)), (F.concat(w(1), w(5), w(9), w(37), number(1, 30)), plain),
        (F.concat(F.lit("20"), number(2, 1), F.lit("-0"), number(1, 5), F.lit("-1"), number(1, 7), F.lit("T1"), number(1, 9), F.lit("-"), number(2, 11)), plain), (F.concat(number(2, 1), F.lit("_"), w(1), F.lit("_"), w(5), F.lit("_v"), number(1, 9)), plain),
        (pick(["required", "string", "optional", "undefined", "default", "disabled", "missing", "hidden"], 33), assign("password", "token", "secret")),
        (F.concat(pick(["get", "load", "read", "make"], 33), w(37), pick(["(", "()", "(self", "[0]"], 41)), assign("password", "token", "secret_key")),
        (F.concat(pick(["config.", "os.environ.", "self.", "settings."], 33), w(37), F.lit("_"), w(45)), assign("password", "token", "secret_key")),
        (F.concat(pick(["${", "<", "$", "%"], 33), w(37), F.lit("_"), w(45), pick(["}", ">", "", "%"], 33)), assign("password", "token", "secret_key")),
        (F.concat_ws(" ", w(33), w(37), w(41), w(45), w(49), w(53), w(57)), F.concat(w(1), F.lit(" "), pick(['password = "', 'token: "', 'secret: "'], 13))),
        (F.concat(F.upper(w(33)), number(1, 30), pick(["_SECRET_TOKEN", "_PASSWORD", "_CLIENT_SECRET", "_API_KEY"], 37)), plain),
    ]
    kinds = positive + negative
    choose = lambda i: reduce(lambda c, k: F.when(F.col("kind") == k[0], k[1][i]).otherwise(c), enumerate(kinds[:-1]), kinds[-1][i])
    return rows.select("id", choose(0).alias("value"), choose(1).alias("before"), after.alias("after"), pick(["src0", "app/config.yaml", "tests/fixtures.py", "docs/example.md", "main.go", ".env"], 41).alias("path"), (F.col("kind") < len(positive)).cast("double").alias("label"))


def train(findings: DataFrame) -> PipelineModel:
    """A forest over labelled findings (value, before, after, path, label)."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="p", rawPredictionCol="raw", predictionCol="yes")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(with_features(findings))


def scan_texts(texts: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """Findings in texts (key, text, path; distinct keys): key, i, start (0-based code point), length, value, score, is_secret.

    A text with many candidates makes as many rows, each with its value and what is close to it only, so work and memory
    grow as the text does.
    """
    group = lambda k: F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(k))
    lengths = F.transform(group(0), lambda s: F.char_length(s))
    found = F.arrays_zip(lengths.alias("segment"), group(1).alias("value"), group(2).alias("before"), group(3).alias("after"))
    segments = texts.select("key", "path", F.posexplode(found).alias("i", "found")).select("key", "path", "i", "found.*")
    w = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = segments.withColumn("start", F.sum("segment").over(w) - F.char_length("value")).drop("segment")
    scored = model.transform(with_features(placed))
    # what is itself the name in an assignment is none
    name = F.col("value").rlike(rf"^(?:[A-Za-z0-9]+[_-])*{_NAME}(?:s|[A-Z0-9_-][A-Za-z0-9_-]*)?$") & F.col("after").rlike(rf"^[\"']?\]?{_BLANKS}[:=]")
    score = F.when(name, 0.0).otherwise(F.get(vector_to_array("p"), F.lit(1)))
    return scored.select("key", "i", "start", F.char_length("value").alias("length"), "value", F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a candidate: row (struct of all columns), key (of text and path), text, path."""
    path = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"), path.alias("path"))
    return rows.filter(F.col("text").rlike(PRESENT)).withColumn("key", F.sha2(F.concat_ws("\0", "text", F.coalesce("path", F.lit(""))), 256))


def scan(docs: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """A row for each candidate of each document: doc_id, i, start, length, value, score, is_secret.

    Null and empty texts have none; null doc_ids and repeated rows keep their findings; a missing or null source is an
    empty path. Equal texts of equal path are scanned once.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    rows = _keyed(docs)
    found = scan_texts(rows.dropDuplicates(["key"]).select("key", "text", "path"), model)
    return rows.select("row.doc_id", "key").join(found, "key").drop("key")


def redact(docs: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """docs with each secret in text replaced by MASK, where it stands, and n_chars, if there, counted anew; no row goes.

    Only rows with a candidate are joined to findings, by the hash of their text. Null and empty texts stay; repeated rows
    are masked alike; all columns stay, whatever their names. An empty table gives no rows.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    rows = _keyed(docs)
    found = scan_texts(rows.dropDuplicates(["key"]).select("key", "text", "path"), model)
    verdicts = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "is_secret", "length"))).alias("verdicts"), F.max("is_secret").alias("any"))
    by_text = materialize(verdicts.filter("any").drop("any"), "secrets")
    segments = F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(0))
    own = lambda i: F.get("verdicts", i)
    masked = F.transform(segments, lambda s, i: F.when(own(i)["is_secret"], F.concat(F.left(s, F.char_length(s) - own(i)["length"]), F.lit(MASK))).otherwise(s))
    rest = F.substring("text", F.aggregate(segments, F.lit(1), lambda n, s: n + F.char_length(s)), F.char_length("text"))
    new = F.when(F.col("verdicts").isNotNull(), F.concat(F.array_join(masked, ""), rest)).otherwise(F.col("text"))
    fixed = rows.join(by_text, "key", "left").withColumn("new", new)
    columns = [F.col("new").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n_chars = F.when(F.col("verdicts").isNotNull(), F.char_length("new").cast(kind)).otherwise(F.col("row.n_chars"))
        columns = [n_chars.alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, columns)]
    others = docs.filter(~F.coalesce(docs["text"].rlike(PRESENT), F.lit(False)))
    return others.unionByName(fixed.select(*columns))

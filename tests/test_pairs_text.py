import math
import uuid

import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity as sim
from matchloom.functions import text as tx
from matchloom.functions import units
from matchloom.functions import vectors as vec
from matchloom.operators import augment, labeling, labels, metrics, models, pairs, split
from matchloom.operators.numbering import with_row_number
from matchloom.plans import recipes
from matchloom.sources import readers
from matchloom.streaming import incremental


def one(spark, column, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def attrs(spark, json_text, f):
    return {a.k: a.v for a in one(spark, f(tx.attributes(F.col("c0"))), json_text)}


def test_units(spark):
    found = attrs(spark, '{"Ширина, см":"10 см","Артикул":"ABC-10 мм"}', units.normalize_attributes)
    assert found == {"ширина, мм": "100", "Артикул": "ABC-10 мм"}
    found = attrs(spark, '{"Габариты, м":"0.5*2*3"}', units.normalize_attributes)
    assert found == {"длина, мм": "500", "ширина, мм": "2000", "высота, мм": "3000"}
    for bad in ("nan", "inf", "-inf"):
        assert bad in attrs(spark, f'{{"Ширина, см":"{bad}"}}', units.normalize_attributes).values()


def test_units_that_are_named(spark):
    """Speed, angle, load, force, torque, capacity, data and flow: named, not converted."""
    cases = {
        "Скорость": ("120 км/ч", "Скорость, км/ч", "120"), "Скорость вращения": ("3000 об/мин", "Скорость вращения, об/мин", "3000"), "Угол обзора": ("178 °", "Угол обзора, °", "178"),
        "Нагрузка": ("15 кгс", "Нагрузка, кгс", "15"), "Усилие (н)": ("40", "Усилие, н", "40"), "Крутящий момент": ("5,5 Н·м", "Крутящий момент, н·м", "5,5"), "Емкость": ("4000 мАч (тип.)", "Емкость, мач", "4000  (тип.)"),
        "Память": ("256 ГБ", "Память, гб", "256"), "Расход, л/мин": ("7", "Расход, л/мин", "7"), "Плотность": ("1.2 г/см³", "Плотность, г/см³", "1.2"), "Твердость": ("60 hrc", "Твердость, hrc", "60"), "Давление": ("10 мм рт. ст.", "Давление, мм рт. ст.", "10"),
        "Партия, кг": ("5 кг", "Партия, кг", "5"), "Фасовка (мл)": ("20", "Фасовка, мл", "20"), "Скорости": ("5 км/ч", "Скорости", "5 км/ч"), "Артикул, кг": ("5 кг", "Артикул, кг", "5 кг"), "Память ": ("много", "Память", "много"),
    }
    rows = spark.createDataFrame([(k, v, name, value) for k, (v, name, value) in cases.items()], "k string, v string, name string, value string")
    for r in rows.select("*", units.normalize_measure(F.col("k"), F.col("v")).alias("found")).collect():
        assert (r.found.k, r.found.v) == (r.name, r.value), r.k



def test_measures_in_names(spark):
    found = {a.k: a.v for a in one(spark, units.measures_in_name(F.col("c0")), "ящик под рассаду 4×3×2.5 м, серый")}
    assert found == {"длина, мм": "4000", "ширина, мм": "3000", "высота, мм": "2500"}
    found = {a.k: a.v for a in one(spark, units.measures_in_name(F.col("c0")), "вентилятор, диаметр 7 см, 45 вт")}
    assert found == {"диаметр, мм": "70", "мощность, вт": "45"}
    assert one(spark, units.measures_in_name(F.col("c0")), "выпуск 1998г") == []


def test_attributes_parse(spark):
    assert [(a.k, a.v) for a in one(spark, tx.attributes(F.col("c0")), '{"b":"1","a":null,"b":"2"}')] == [("a", ""), ("b", "2")]
    assert one(spark, tx.attributes(F.col("c0")), "not-json") is None
    assert [(a.k, a.v) for a in one(spark, tx.strict_attributes(F.col("c0")), '{"a":true,"b":1.50}')] == [("a", "True"), ("b", "1.5")]


def test_merge_and_pack(spark):
    kind = "array<struct<k:string,v:string>>"
    make = lambda d: F.from_json(F.lit(d), kind)
    merged = one(spark, tx.merge_missing(make('[{"k":"бренд","v":"bosch"},{"k":"тип","v":"дрель"}]'), make('[{"k":"Бренд","v":"x"}]')))
    assert [(a.k, a.v) for a in merged] == [("тип", "дрель"), ("Бренд", "x")]
    five = make('[{"k":"a","v":"1"},{"k":"b","v":"1 2 3 4"},{"k":"c","v":"1"}]')
    assert [a.k for a in one(spark, tx.pack_fields(five, 4))] == ["a"]
    assert [a.k for a in one(spark, tx.pack_fields(five, 4, skip_oversized=True))] == ["a", "c"]


def test_set_metrics_of_nothing(spark):
    none = F.array().cast("array<string>")
    m = sim.set_metrics(none, none)
    assert [one(spark, m[k]) for k in sim.SET_METRICS] == [0, 1, 1, 1]
    assert one(spark, sim.minmax_ratio(F.lit(0), F.lit(0))) == 1


def compare(spark, left, right):
    df = spark.createDataFrame([(0, left, right)], "pair_row long, l string, r string")
    df = df.select("pair_row", tx.attributes(F.col("l")).alias("attributes_1"), tx.attributes(F.col("r")).alias("attributes_2"))
    return {r.name: r for r in pairs.compare_attributes(df).collect()}, df


def test_typed_comparison(spark):
    found, _ = compare(spark, '{"артикул":"Q-77/K","мощность":"250","цвет":"хаки | беж","описание":"лёгкий шарф ручной вязки"}', '{"артикул":"q77k","мощность":"250","цвет":"беж","описание":"шарф ручной вязки лёгкий"}')
    assert (found["артикул"].type, found["артикул"].exact) == ("CODE", 1)
    assert (found["мощность"].type, found["мощность"].similarity) == ("PHYSICAL", 1)
    assert (found["цвет"].type, found["цвет"].similarity) == ("SET", 0.5)
    assert found["описание"].type == "TEXT" and found["описание"].similarity > 0.5
    found, _ = compare(spark, '{"цвет":"беж"}', "{}")
    assert found["цвет"].one_missing and found["цвет"].conflict == 0


def test_typed_features_do_not_depend_on_sides(spark):
    _, ab = compare(spark, '{"артикул":"Q-77","бренд":"ivo"}', '{"артикул":"Q78","вес":"5"}')
    _, ba = compare(spark, '{"артикул":"Q78","вес":"5"}', '{"артикул":"Q-77","бренд":"ivo"}')
    first, second = (pairs.typed_features(pairs.compare_attributes(df)).first() for df in (ab, ba))
    assert first == second and first.typed_model_code_conflict == 1 and len(first) == 53


def items(spark):
    rows = [(1, "Router N40", "network", '{"бренд":"acme","память":"64"}'), (2, "Stand N40", "desk", '{"бренд":"acme"}'), (3, "Lamp", "home", None)]
    return spark.createDataFrame(rows, "id long, name string, category string, attributes string")


def test_pair_features(spark):
    cards = items(spark).withColumn("attributes", tx.attributes(F.col("attributes")))
    ab = spark.createDataFrame([(0, 1, 2), (1, 1, 3)], "pair_row long, id1 long, id2 long")
    ba = ab.select("pair_row", F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    wide = pairs.pair_features(ab, pairs.card_features(cards))
    assert len(wide.columns) - 3 == 85 and wide.columns[3] == "category"
    full, other = (pairs.all_features(m, cards).drop("id1", "id2").orderBy("pair_row").collect() for m in (ab, ba))
    assert len(full[0]) - 1 == 137 and full == other
    assert full[0].category == "desk <> network" and full[0].model_code_overlap_present == 1 and full[0].brand_exact_match == 1


def test_cascade_and_copies(spark):
    df = spark.createDataFrame([(0, 0.001), (1, 0.5), (2, 0.999)], "pair_row long, fast0 double")
    seen = []

    def main(rows):
        seen.append(rows.count())
        return rows.withColumn("predict", F.lit(0.8))

    assert [r.predict for r in models.cascade(df, F.col("fast0"), main, 0.01, 0.99).orderBy("pair_row").collect()] == [0.001, 0.8, 0.999]
    assert seen == [1]


def test_priorities_and_shuffles(spark):
    rules = [("global", None, "brand", 1), ("global", None, "memory", 2), ("category", "phones", "memory", 1), ("category", "phones", "brand", 2)]
    p = spark.createDataFrame(rules, "scope string, category string, attribute string, priority int")
    cards = spark.createDataFrame([(1, "phones", '{"z":"1","brand":"b","a":"2","memory":"m"}')], "id long, category string, j string")
    cards = cards.select("id", "category", tx.attributes(F.col("j")).alias("attributes"))
    assert [a.k for a in pairs.sort_by_priority(cards, p).first().attributes] == ["memory", "brand", "z", "a"]
    with pytest.raises(ValueError):
        pairs.validate_priorities(p.unionByName(p))
    eight = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct(i.cast("string").alias("k"), i.cast("string").alias("v")))
    two = spark.range(1).select(F.lit(1).alias("id1"), F.lit(2).alias("id2"), eight.alias("attributes_1"), eight.alias("attributes_2"))
    a, b = (pairs.shuffle_attributes(two, 2, 5).orderBy("copy").collect() for _ in range(2))
    assert a == b and len(a) == 2 and a[0].attributes_1 != a[1].attributes_1


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    a, b = (v(1, -2), v(3, 4)), (v(-1, 2), v(0, 5))
    assert one(spark, vec.max_products(*a, *b)) == one(spark, vec.max_products(*b, *a)) == [0.0, 20.0]
    assert one(spark, vec.cosine(v(0, 0), v(1, 1))) == 0
    assert one(spark, vec.unit(vec.mean_vector(F.array(v(2, 0), v(4, 0)), 2))) == [1.0, 0.0]


def test_sources(spark, tmp_path):
    card = '{"Название":"Sail","Код модели":"K9","категория":"boats","бренд":"x"}'
    got = readers.from_cards(spark.createDataFrame([(1, "c", card)], "id long, category string, card_json string")).first()
    assert (got.name, got.category, got.attributes) == ("Sail K9", "boats", '{"бренд":"x"}')
    m = spark.createDataFrame([(1, 9)], "id1 long, id2 long")
    with pytest.raises(ValueError):
        readers.inference_inputs(items(spark), m)
    rows = spark.createDataFrame([(1, 2, 1, 0.5), (3, 1, 0, 0.25)], "id1 long, id2 long, pair_row long, predict double")
    readers.write_predictions(rows, str(tmp_path / "out"))
    assert [r.id1 for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == ["3", "1"]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text('{"name": "b", "created_at": "2", "metric": 1.5}')
    (tmp_path / "runs" / "b.json").write_text('{"name": "a", "created_at": "1"}')
    assert [r.name for r in readers.read_runs(spark, str(tmp_path / "runs")).collect()] == ["a", "b"]


def scored(spark):
    rows = [(1, 2, 0.55), (2, 1, 0.55), (3, 4, 0.54), (5, 6, 0.56), (7, 8, 0.53), (9, 10, 0.57)]
    return spark.createDataFrame(rows, "id1 long, id2 long, source_score double")


def test_selection(spark):
    done = spark.createDataFrame([(1, 2, "v1")], "pair_left long, pair_right long, labeling_fingerprint string")
    c = labeling.selection_counters(scored(spark), done, "v1", 0.54, 0.56, 5).first()
    assert tuple(c) == (6, 4, 3, 1, 2)
    picks = labeling.select_pairs(scored(spark), done, "v1", 0.54, 0.56, 1, 3)
    more = labeling.select_pairs(scored(spark), done.unionByName(picks.select("pair_left", "pair_right", F.lit("v1").alias("labeling_fingerprint"))), "v1", 0.54, 0.56, 5, 3)
    assert sorted((r.pair_left, r.pair_right) for r in picks.unionByName(more).collect()) == [(3, 4), (5, 6)]


def test_label_rounds(spark):
    widths = []

    def label(rows, width):
        widths.append(width)
        k = len(widths)
        return rows.select("row_id", F.when(F.col("row_id") <= k, "yes").alias("answer"))

    done, told = labeling.label_rounds(spark.createDataFrame([(1,), (2,), (3,)], "row_id long"), label, name=(name := f"rounds-{uuid.uuid4().hex}"))
    assert widths == [64, 32, 32] and done.count() == 3 and [t.labelled for t in told] == [1, 1, 1]
    again, told = labeling.label_rounds(spark.createDataFrame([(1,), (2,), (3,)], "row_id long"), label, name=name)
    assert len(widths) == 3 and again.count() == 3 and [t.labelled for t in told] == [1, 1, 1]  # nothing is labelled anew
    # other rows with the same ids, or other settings, don't get those answers
    for n, (rows, more) in enumerate([([(1, "x"), (2, "y"), (3, "z")], ()), ([(1, "x"), (2, "y"), (3, "w")], ()), ([(1, "x"), (2, "y"), (3, "w")], ("prompt 2",))], 1):
        labeling.label_rounds(spark.createDataFrame(rows, "row_id long, text string"), lambda r, w: label(r, w).withColumn("answer", F.lit("yes")), name, more)
        assert len(widths) == 3 + n
    a = spark.createDataFrame([(1, None), (2, "b")], "row_id long, text string")
    assert labeling.content_fingerprint(a) == labeling.content_fingerprint(a.repartition(3).select("text", "row_id")) != labeling.content_fingerprint(a.fillna(""))
    with pytest.raises(ValueError):
        labeling.label_rounds(spark.createDataFrame([(1,), (1,)], "row_id long"), label, name=uuid.uuid4().hex)
    twice = lambda rows, width: rows.select("row_id", F.lit("yes").alias("answer")).unionByName(rows.select("row_id", F.lit("no").alias("answer")))
    with pytest.raises(ValueError):
        labeling.label_rounds(spark.createDataFrame([(1,)], "row_id long"), twice, name=uuid.uuid4().hex)


def test_merge_stream(spark, tmp_path):
    kind = "pair_left long, pair_right long, labeling_fingerprint string, labeled_at string"
    table, source = str(tmp_path / "table"), str(tmp_path / "source")
    spark.createDataFrame([(1, 2, "v1", "t0"), (3, 4, "v1", "t0")], kind).write.parquet(table)
    spark.createDataFrame([(1, 2, "v1", "t1"), (5, 6, "v1", "t1")], kind).write.parquet(source)
    incremental.merge_stream(spark.readStream.schema(kind).parquet(source), table, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.pair_left, r.labeled_at) for r in readers.read_table(spark, table).collect()) == [(1, "t1"), (3, "t0"), (5, "t1")]


def test_recipe_and_prediction(spark):
    it = spark.createDataFrame([(i, f"name {i}", "ab"[i % 2], f'{{"вес":"{i} г"}}') for i in range(80)], "id long, name string, category string, attributes string")
    human = spark.createDataFrame([(i, i + 1, i % 4 // 2) for i in range(0, 78)], "id1 long, id2 long, target int")
    model = spark.createDataFrame([(i, i + 2, (i % 10) / 9) for i in range(0, 78)], "id1 long, id2 long, target double")
    r = recipes.Recipe((recipes.Source("human", weight=3.0), recipes.Source("model", "votes", negative=2, positive=7, transitivity={})), "human", candidates=8)
    best = recipes.training_set(r, {"human": human, "model": model}, it)
    assert {x.data_source for x in best.validation.select("data_source").distinct().collect()} == {"human"}
    assert {x.w for x in best.validation.select(F.col("sample_weight").alias("w")).distinct().collect()} == {1.0}
    assert {x.data_source for x in best.train.select("data_source").distinct().collect()} == {"human", "model"}
    p = recipes.predict_pairs(it, human.select("id1", "id2").limit(5), models.linear_scorer({"name_words_jaccard": 2.0}, -1.0))
    assert p.count() == 5 and p.filter("predict between 0 and 1").count() == 5


def test_boosting_learns(spark):
    rows = [(i, "ab"[i % 2], i / 200, int(i > 100), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "pair_row long, category string, x double, target int, sample_weight double")
    found = models.predict(df, models.train_boosting(df, ["x"], trees=3, depth=2))
    assert found.filter((F.col("predict") > 0.5) != (F.col("target") == 1)).count() <= 4


def test_reports_are_published_whole(spark, tmp_path):
    """A failure between the files of a report leaves the old one."""
    at = str(tmp_path / "report")
    with pytest.raises(ValueError, match="no report"):
        readers.read_report(spark, at)
    readers.write_report(spark.range(3), spark.range(1), {"name": "первый", "rows": 3}, at)
    for results, aggregates, said in ((spark.range(9), spark.range(1).selectExpr("raise_error('no') AS id"), {}), (spark.range(9), spark.range(2), {"rows": object()})):
        with pytest.raises(Exception):
            readers.write_report(results, aggregates, said, at)
        rows, sums, report = readers.read_report(spark, at)
        assert (rows.count(), sums.count(), report) == (3, 1, {"name": "первый", "rows": 3})
    readers.write_report(rows.filter("id > 0"), sums, {"rows": 2}, at)  # what is replaced may be read
    assert [readers.read_report(spark, at)[0].count(), readers.read_report(spark, at)[2]["rows"]] == [2, 2]


def test_tables_are_replaced_by_versions(spark, tmp_path):
    at = str(tmp_path / "t")
    readers.replace_table(spark.range(3), at)
    readers.replace_table(readers.read_table(spark, at).filter("id > 0"), at)
    held = readers.read_table(spark, at)
    readers.replace_table(held.selectExpr("id * 10 AS id"), at)
    assert sorted(r.id for r in readers.read_table(spark, at).collect()) == [10, 20]
    assert sorted(r.id for r in held.collect()) == [1, 2]  # a reader of the version before
    readers.replace_table(spark.range(1), at)
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) == 2
    with pytest.raises(Exception):
        readers.replace_table(spark.range(5).selectExpr("raise_error('no') AS id"), at)
    assert readers.read_table(spark, at).count() == 1


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.createDataFrame([(k * 7919 % 1009 // 3, f"n{k}", k) for k in range(500)], "a int, part string, place int").repartition(5)
    found = with_row_number(rows, "no", "a", "place", start=1).collect()
    want = sorted(((r.a, r.part, r.place) for r in rows.collect()), key=lambda r: (r[0], r[2]))
    assert sorted((r.no, r.a, r.part, r.place) for r in found) == [(k, *r) for k, r in enumerate(want, 1)]
    assert with_row_number(rows.filter("a < 0"), "no", "a").count() == 0


@pytest.mark.parametrize("bad", [0.7, None, float("nan"), -1.0])
def test_bad_labels_are_errors(spark, bad):
    rows = spark.createDataFrame([(1, 2, 1.0), (3, 4, bad)], "id1 long, id2 long, target double")
    with pytest.raises(Exception, match="neither 0 nor 1"):
        labels.hard_labels(rows).collect()
    if bad != 0.7:
        with pytest.raises(Exception, match="not in"):
            labels.probability_labels(rows, 0.2, 0.8).collect()
    assert labels.hard_labels(rows.filter("id1 = 1")).first().target == 1


def test_read_items_of_both_layouts(spark, tmp_path):
    spark.createDataFrame([(1, "lamp", "light", "{}")], readers.ITEMS).write.parquet(str(tmp_path / "flat"))
    card = '{"%s": "vase", "%s": "V7", "colour": "blue"}' % (readers.NAME_KEY, readers.MODEL_KEY)
    spark.createDataFrame([(2, "home", card)], "id long, category string, card_json string").write.parquet(str(tmp_path / "card"))
    found = {r.id: (r.name, r.category, r.attributes) for r in readers.read_items(spark, str(tmp_path / "flat"), str(tmp_path / "card")).collect()}
    assert found == {1: ("lamp", "light", "{}"), 2: ("vase V7", "home", '{"colour":"blue"}')}
    with pytest.raises(ValueError):
        readers.read_items(spark, str(tmp_path / "flat"), str(tmp_path / "flat"))


def test_noise_is_seeded_and_leaves_names_of_attributes(spark):
    attrs = F.from_json(F.lit('[{"k":"tint","v":"deep green matt"},{"k":"grip","v":"cork"},{"k":"span","v":"4 m"}]'), tx.ATTRIBUTES)
    rows = spark.range(300).select(F.col("id").alias("pair_row"), F.lit("Folding Reed Chair Ivo").alias("name_1"), F.lit(None).cast("string").alias("name_2"), attrs.alias("attributes_1"), F.lit(None).cast(tx.ATTRIBUTES).alias("attributes_2"), F.lit(5).alias("w"))
    noise = lambda seed, **p: {r.pair_row: r for r in augment.add_noise(rows, seed, **p).collect()}
    a, b, c = noise(1), noise(1), noise(2)
    assert a == b != c and all(r.name_2 is None and r.attributes_2 is None and r.w == 5 for r in a.values())
    assert noise(1, pair=0.0)[7].name_1 == "Folding Reed Chair Ivo"
    none = noise(3, attribute=1.0, words=1.0, shuffle=0.0, slip=0.0)
    assert all(r.attributes_1 == [] and r.name_1 in ("Folding", "Reed", "Chair", "Ivo") for r in none.values()) and len({r.name_1 for r in none.values()}) == 4
    turned = noise(4, attribute=0.0, words=0.0, shuffle=1.0, slip=0.0)
    assert all(sorted(r.name_1.split()) == ["Chair", "Folding", "Ivo", "Reed"] and r.name_1 != "Folding Reed Chair Ivo" for r in turned.values())
    slipped = noise(5, attribute=0.5, words=0.0, shuffle=0.0, slip=1.0)
    beside = augment._beside()
    for r in slipped.values():
        assert all(y.lower() in beside[x.lower()] and x.isupper() == y.isupper() if x != " " else y == " " for x, y in zip("Folding Reed Chair Ivo", r.name_1))
    share = sum(len(r.attributes_1) for r in slipped.values()) / 900
    assert 0.4 < share < 0.6 and {x.k for r in slipped.values() for x in r.attributes_1} == {"tint", "grip", "span"}


def test_pooling_orders_and_times(spark):
    v = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in ((1, -5), (3, -7), (100, 100))])
    assert one(spark, vec.masked_mean(v, F.array(F.lit(1), F.lit(1), F.lit(0)), 2)) == [2.0, -6.0]
    assert one(spark, vec.masked_max(v, F.array(F.lit(True), F.lit(True), F.lit(False)), 2)) == [3.0, -5.0]
    assert one(spark, vec.masked_max(v, F.array(F.lit(0), F.lit(0), F.lit(0)), 2)) == [0.0, 0.0]
    assert one(spark, tx.iso_time(F.lit("2024-03-01 02:03:04").cast("timestamp"))) == "2024-03-01T02:03:04.000000+00:00"
    assert one(spark, tx.iso_time()).endswith("+00:00")
    assert [a.k for a in one(spark, tx.shortest_first(tx.attributes(F.lit('{"b b":"1 2","a":"1","c":"2"}'))))] == ["a", "c", "b b"]
    assert [r.n for r in metrics.longest(spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "id int, n int"), "n", "id", 2).collect()] == [9, 9]


def test_split_quality(spark):
    rows = [("a", 1, g, g == 1) for g in (1, 2, 3, 4)] + [("b", 0, g, False) for g in (1, 2)] + [("c", 1, 9, True)]
    df = spark.createDataFrame(rows, "category string, target int, grp int, held boolean")
    assert tuple(split.split_quality(df, F.col("held"), 0.25).first()) == (3, 1, 0.25)
    assert [r.grp for r in split.select_rows(df, spark.createDataFrame([(4,), (9,)], "grp int"), "grp").collect()] == [4, 9]


def test_numbers_print_with_twelve_digits(spark):
    values = [0.0, 7.0, -3.0, 2.5, 1 / 3, 0.0001, 0.00012345678901234, 1.5e-05, -9.9999999999999e-07, 1e-13, 123456.7890123456, 1e15, 0.1 + 0.2]
    found = spark.createDataFrame([(float(v),) for v in values], "x double").select(units.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in found] == [str(round(v)) if math.isclose(v, round(v), rel_tol=1e-12, abs_tol=1e-12) else f"{v:.12g}" for v in values]

"""Language profiles on held-out texts and by hand; permutation importance on planted features."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from listing_lake.operators import language, lexicon, model


def test_profiles_beat_stop_words_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").where("lang is not null").persist()
    held = docs.where("doc_id % 5 = 0")
    found = language.identified(held, "doc_id", language.learned(docs.where("doc_id % 5 <> 0"))).join(held, "doc_id")
    mine = found.select(F.avg((F.coalesce(F.col("language") == F.col("lang"), F.lit(False))).cast("int"))).first()[0]
    shares = F.array_max(F.array(*(F.struct(lexicon.stop_word_share("text", w).alias("s"), F.lit(x).alias("l")) for x, w in lexicon.STOP_WORDS.items())))
    theirs = held.select(F.avg((shares["l"] == F.col("lang")).cast("int"))).first()[0]
    assert mine > theirs and mine > 0.98, (mine, theirs)


def test_scores_by_hand(spark):
    taught = [("ab abc", "x"), ("bcd b", "y"), (None, "y"), ("zz", None)]
    asked = [(1, "Abc-ab"), (2, "bcd 9"), (3, ""), (4, None), (5, "q" * 200), (6, "123")]
    profiles = language.learned(spark.createDataFrame(taught, "text string, lang string"), n=3)
    got = {r.k: r for r in language.identified(spark.createDataFrame(asked, "k int, text string"), "k", profiles).collect()}

    def split(text):
        runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        words = [f" {r[i : i + 64]} " for r in runs for i in range(0, len(r), 64)]
        return [w[i : i + 3] for w in words for i in range(len(w) - 2)]

    counts = {x: Counter(g for t, lang in taught if lang == x for g in split(t)) for x in "xy"}
    different = len(set(counts["x"]) | set(counts["y"]))
    for k, text in asked:
        grams = split(text)
        score = {x: sum(math.log((c[g] + 0.5) / (c.total() + 0.5 * different)) for g in grams) for x, c in counts.items()}
        want = max(sorted(score), key=score.get) if grams else None
        assert (got[k].language, got[k].n_grams) == (want, len(grams) or None)
        assert not grams or got[k].margin == pytest.approx(abs(score["x"] - score["y"]) / len(grams))
    assert {r.k: r.is_language for r in language.already(spark.createDataFrame(asked, "k int, text string"), "k", profiles, "x").collect()} == {k: got[k].language == "x" for k, _ in asked}
    none = language.learned(spark.createDataFrame([], "text string, lang string"))
    assert [r.language for r in language.identified(spark.createDataFrame(asked[:1], "k int, text string"), "k", none).collect()] == [None]


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("key"), F.rand(1).alias("strong"), F.rand(2).alias("weak"), F.when(F.rand(3) > 0.5, "a").otherwise("b").alias("kind"))
    return df.withColumn("label", 10 * F.col("strong") + F.col("weak") + F.when(F.col("kind") == "a", 3).otherwise(0)).persist()


def test_shuffles_are_permutations(planted):
    out = model.permuted(planted, ["strong", "kind"], "key", 3, rows_per_bucket=200).persist()
    assert out.count() == planted.count() * 7
    plain = sorted(r.strong for r in planted.collect())
    for r in range(3):
        some = out.where(f"feature = 'strong' and repeat = {r}")
        assert sorted(x.strong for x in some.collect()) == plain
        moved = some.join(planted.select("key", F.col("strong").alias("was"), F.col("kind").alias("same")), "key")
        assert moved.where("strong <> was").count() > 1100 and moved.where("kind <> same").count() == 0
    assert out.where("feature = 'strong'").groupBy("key").agg(F.count_distinct("strong").alias("n")).where("n > 1").count() > 1000


def test_shuffles_are_made_behind_the_move(planted):
    """No row is repeated for each shuffle before rows move, and none moves afterwards."""
    plan = model.permuted(planted, ["strong", "kind"], "key", 50, rows_per_bucket=200)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1
    out = model.permuted(planted, ["strong", "kind"], "key", 50)
    assert out.groupBy("feature", "repeat").count().where("count = 1200").count() == 101


def test_planted_importance_in_one_job(spark, planted):
    fitted = model.train(planted, ["strong", "weak"], ["kind"], trees=8, depth=6)
    df = model.permutation_importance(fitted, planted, ["strong", "weak", "kind"], "key", repeats=5)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 1
    rows = df.collect()
    assert [r.feature for r in rows] == ["strong", "kind", "weak"] and rows[0].mean > 0.5 > rows[1].mean > rows[2].mean and rows[0].std < 0.2


def test_a_word_is_cut_once_for_each_language(spark, monkeypatch):
    from listing_lake.operators import language

    df = spark.createDataFrame([("en", "the house the garden")] * 40 + [("it", "la casa")] * 3 + [("it", None), (None, "x")], "lang string, text string")
    seen, grams_of = [], language.grams_of
    monkeypatch.setattr(language, "grams_of", lambda found, *a, **k: seen.append(found.count()) or grams_of(found, *a, **k))
    profiles = language.learned(df)
    assert seen == [5]  # the, house, garden, la, casa
    want = {r[0]: r[1] for r in language.grams(df.where("lang = 'en'"), "text").groupBy("gram").count().collect()}
    got = {r.gram: round(0.5 * 2.718281828459045 ** r.gains[0] - 0.5) for r in profiles.gains.collect()}
    assert profiles.languages == ["en", "it"] and {g: n for g, n in got.items() if n} == want

"""Words cut in Arrow buffers, against the patterns they stand for."""

from pyspark.sql import functions as F

from roleweave.catalog import files, frames
from roleweave.operators import words
from roleweave.operators.lexicon import lexicon_compound

TEXTS = [None, "", "  ", "a b a", "12ab3 \u0663\u0664x.y", "\u00e9t\u00e9-\u00df\n\ttab", "\u65e5\u672c \U0001f600\U0001f600 na\u0308m \u2167", "x\u00a0y" * 40, "ab"]


def texts(spark):
    return spark.createDataFrame([(i % 5, t) for i, t in enumerate(TEXTS)], "id int, text string").repartition(2)


def rows(df):
    return sorted(map(str, df.collect()))


def test_words_are_runs_of_letters(spark, monkeypatch):
    monkeypatch.setattr(words, "SLICE", 8)
    t = texts(spark)
    want = t.select("id", F.coalesce(F.regexp_extract_all("text", F.lit("\\pL+"), F.lit(0)), F.array()).alias("ws"))
    assert rows(words.word_lists(t, "text")) == rows(want)
    every = t.select("id", F.coalesce(F.regexp_extract_all("text", F.lit("\\pL+|\\pN+|[^ \\t\\n\\f\\r\\pL\\pN]"), F.lit(0)), F.array()).alias("ws"))
    assert rows(words.word_lists(t, "text", signs=True)) == rows(every)
    once = words.word_lists(t, "text", once=True).select("id", F.sort_array("ws").alias("ws"))
    assert rows(once) == rows(want.select("id", F.sort_array(F.array_distinct("ws")).alias("ws")))
    long = words.word_lists(t, "text", shape=lambda n, first: (n >= 2) & (first % 3 == 0))
    assert rows(long) == rows(want.select("id", F.filter("ws", lambda w: (F.length(w) >= 2) & (F.ascii(w) % 3 == 0)).alias("ws")))
    n = want.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    assert rows(words.word_counts(t, "text")) == rows(n)
    clean = t.withColumn("text", F.trim(F.regexp_replace("text", "[^\\pL]+", " ")))
    assert rows(words.letters_only(t, "text")) == rows(clean)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_without_a_pattern(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A a b", "s", "en")], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert "regexp" not in plan(frames.words(spark, str(tmp_path)))
    assert "regexp" not in plan(frames.unit_words(spark, str(tmp_path)))


def test_scores_of_single_words_make_no_rows_of_patterns(spark):
    valence = spark.createDataFrame([("a", 1.5), ("12", -0.5), (".", 0.25)], "term string, value double")
    scored = lexicon_compound(texts(spark), valence, "id")
    assert "regexp" not in plan(scored)
    got = {r["id"]: round(r["score"], 9) for r in scored.collect()}
    want = {3: 3.0, 4: -0.25}
    assert got == {i: round(want.get(i, 0.0) / (want.get(i, 0.0) ** 2 + 15) ** 0.5, 9) for i in range(5)}


def test_a_text_is_digested_before_its_identities_are_rows(spark, tmp_path):
    word = "labor "
    docs = spark.createDataFrame([(i, word * 9, "s", "en") for i in range(1, 4)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    p = plan(files.unit_text_file(spark, str(tmp_path)))
    assert p.index("Generate") < p.index("md5(")

"""What language identification holds at once."""

from pyspark.sql import functions as F

from inkwell.llm import langid, pieces


def test_text_goes_to_python_once(spark):
    docs = spark.createDataFrame([(k, t, lang) for k in range(30) for t, lang in (("the cat is here", "en"), ("die katze ist hier", "de"))], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    found = langid.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "__text" not in plan
    assert found.where(F.col("lang") != F.col("lang_pred")).count() == 0
    bare = langid.identify(docs, model, keep=["doc_id"])
    assert bare.columns == ["doc_id", "lang_pred", "score"]
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, found.select("doc_id", "lang_pred", "score").collect()))


def test_long_words_are_handled_few_at_a_time():
    words = ["ab" * 40] * 20_000
    groups = list(pieces.together(words, 2))
    assert sum(map(len, groups)) == len(words) and max(len(g) * 81 for g in groups) <= 1 << 17


def test_stage_hands_python_few_texts_and_takes_none_back(spark, monkeypatch):
    import corpus_pipeline

    sizes, identify = [], langid.identify

    def seen(docs, *args, **options):
        sizes.append((int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), options.get("keep")))
        return identify(docs, *args, **options)

    monkeypatch.setattr(langid, "identify", seen)
    rows = [(k, t, lang) for k in range(30) for t, lang in (("the cat is here", "en"), ("die katze ist hier", "de"))]
    rows += [(None, "the cat", "en"), (None, None, "en"), (1, "", None), (1, "12 34", "de"), (1, "the cat is here", "en"), (77, "the cat is here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, docs, "")
    whole = identify(docs, langid.fit(docs)).where("lang_pred <> 'und' and score >= 0.5").select(*docs.columns)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and whole.count() == 63
    assert sizes == [(1000, ["at", "row"])]

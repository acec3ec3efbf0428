from pyspark.sql import functions as F

from driftfield.llm import language as L


def test_held_out_accuracy(small_docs):
    model = L.fit(small_docs)
    got = L.predict(small_docs, model).join(small_docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, gone = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 200 and right >= 0.98 * n and gone <= 0.01 * n


def test_held_out_documents_are_not_learnt_from(spark, small_docs):
    spoilt = small_docs.withColumn("lang", F.when(L.is_held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = L.fit(small_docs), L.fit(spoilt)
    assert a.languages == b.languages and (a.centroids == b.centroids).all() and (a.idf == b.idf).all()


def test_split_is_by_crc32(spark):
    import zlib

    rows = spark.range(-3, 60).select(F.col("id"), L.is_held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_other_scripts_are_rejected(spark, small_docs):
    model = L.fit(small_docs)
    docs = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 5, None), (2, "いろはにほへとちりぬるを" * 20, None), (3, small_docs.first()["text"], None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["rejected"] for r in L.predict(docs, model).collect()}
    assert got == {1: True, 2: True, 3: False}
    assert [r["doc_id"] for r in L.accepted(docs, model).collect()] == [3]


def test_edges(spark, edge_docs, no_docs, small_docs):
    model = L.fit(small_docs)
    rows = L.predict(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in {"und", *model.languages}
        assert letters or r["rejected"]
    kept = L.accepted(edge_docs, model)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if not r["rejected"])
    assert L.predict(no_docs, model).collect() == []
    none = L.fit(no_docs)
    assert {r["lang_pred"] for r in L.predict(edge_docs, none).collect()} == {"und"} and L.accepted(edge_docs, none).collect() == []
    L.predict(edge_docs, L.fit(edge_docs)).collect()


SHORT = ["Здравствуйте", "Как у вас дела сегодня?", "いろはにほへと", "Καλημέρα σας", "مرحبا كيف حالك اليوم", "안녕하세요 반갑습니다"]


def test_short_texts_in_other_scripts_are_rejected(spark, small_docs):
    model = L.fit(small_docs)
    docs = spark.createDataFrame(list(enumerate(SHORT)), "doc_id bigint, text string")
    assert all(r["rejected"] for r in L.predict(docs, model).collect()) and L.accepted(docs, model).collect() == []


def test_a_held_back_language_is_rejected(spark, small_docs):
    """Whole documents and runs of their words, of a language in Latin script that was not learnt."""
    model = L.fit(small_docs.where("lang <> 'fr'"))
    words = F.split("text", r"\s+")
    short = small_docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat_ws(" ", F.slice(words, 1, 8)).alias("text"), "lang")
    for docs, misses in ((small_docs, 0.02), (short, 0.2)):
        got = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
        missed, n = got.where("lang = 'fr'").agg(F.sum((~F.col("rejected")).cast("int")), F.count("*")).first()
        gone, m = got.where("lang <> 'fr' and held_out").agg(F.sum(F.col("rejected").cast("int")), F.count("*")).first()
        assert missed <= misses * n and gone <= 0.015 * m


def test_limits_are_learnt_for_each_length(small_docs):
    model = L.fit(small_docs)
    assert model.limits.shape == (len(model.languages), L.BANDS)
    assert (model.limits[:, :-1] >= model.limits[:, 1:]).all() and (model.limits[:, 0] > model.limits[:, -1]).all()
    assert len(set(model.limits[:, -1])) > 1


def test_short_texts_score_the_same_either_way(small_docs):
    model = L.fit(small_docs)
    for block in L.B.blocks(L.pa.array([r["text"] for r in small_docs.limit(200).collect()] + ["", "é"])):
        pieces, rows = L._pieces(block)
        assert len(pieces) == len(rows) > len(block)
        for b in (block, pieces):
            (x, n), (y, m) = L._cosines(model, b), L._cosines_of_short(model, b)
            assert (n == m).all() and abs(x - y).max() < 1e-5

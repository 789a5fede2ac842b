import zlib

from engramix.llm import language_id, queries

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op5_language_id"](spark, SMALL)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(i, t, lang, 1.0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the bird", "en")] * 10)],
        "doc_id long, text string, lang string, score double",
    )
    model = language_id.fit(docs)
    assert sorted(model.languages) == ["de", "en"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 😀"), (4, "der hund"), (4, "der hund"), (None, "the dog" * 300_000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.identify(odd, model).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "de"), ("4", "de"), ("None", "en")]
    assert language_id.identify(odd.limit(0), model).collect() == []
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_all_languages_are_learned(spark):
    names = [f"l{i:03d}" for i in range(205)]
    texts = [(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 3, n) for i, n in enumerate(names) for _ in range(2 if i < 204 else 1)]
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == names and model.weights.shape[1] == 205


def test_counts_are_of_the_whole_text(monkeypatch):
    texts = ["ab c " * 1000, "a", " a", "a ", "ab", "no. 1 x!? Été  日本語\n" * 90, "x" * 996 + " " * 3 + "y", ". " * 600 + "z", "a." * 700]
    whole = [language_id.ngram_counts(t) for t in texts]
    for block in (1, 2, 3, 7, 997):
        monkeypatch.setattr(language_id, "BLOCK", block)
        for t, want in zip(texts, whole):
            assert (language_id.ngram_counts(t) == want).all()
    assert language_id.ngram_counts("...") is None
    plain = language_id.letters("  ab. ")
    padded = [32, *[int(x) for x in plain if x != 32], 32]
    assert int(whole[4].sum()) == 4 + 3 + 2 and padded == [32, 97, 98, 32]
    at, counts = language_id.unpacked(language_id.packed_counts("ab c " * 1000))
    assert (whole[0][at] == counts).all() and counts.sum() == whole[0].sum()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the dog", "en", 0.5, "x")], "doc_id long, text string, lang string, lang_score double, _lang_score string")
    got = language_id.identify(docs, language_id.fit(docs))
    assert got.columns == [*docs.columns, "lang_pred", "__lang_score"] and got.first().lang_pred == "en"

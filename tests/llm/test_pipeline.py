import sys
from pathlib import Path

import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from engramix.llm import language_id, sentencepiece_scan

SMALL = "/root/testdata/sf0.001"


def plain_stages(docs, items, model):
    """ids after each stage, and the texts after PII."""
    docs = {d: t for d, t in docs if model.predict(t)[0] != "und" and model.predict(t)[1] >= 0.5}
    out = [sorted(docs)]
    kept = {d for d, _, _, k in brute.near_dups(list(docs.items()), 5) if k}
    docs = {d: t for d, t in docs.items() if d in kept}
    out.append(sorted(docs))
    dirty = {r[0] for r in brute.decontaminate(list(docs.items()), items) if r[5]}
    docs = {d: t for d, t in docs.items() if d not in dirty}
    out.append(sorted(docs))
    return out, docs


def redacted(text):
    """Base spans replaced by their kinds, from the last to the first."""
    spans = sorted((s, e, k) for k, v in brute.pii(text).items() for s, e in v)
    for s, e, k in reversed(spans):
        text = f"{text[:s]}[{k.upper()}]{text[e:]}"
    return text


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want, texts = plain_stages(rows, items, language_id.fit(docs))
    state, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, SMALL).cache()
        if name != "sentencepiece":
            assert state.columns == docs.columns
        seen.append(sorted(r.doc_id for r in state.select("doc_id").collect()))
    assert seen[:3] == want and seen[3] == seen[4] == want[2]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL_PATH)
    for r in state.collect():
        assert r.decodes and r.piece_ids == library.encode(r.text) and r.n_chars == len(r.text)
        if not any(x in r.text for x in ("_PLAIN]", "_SPELLED]", "[IBAN]", "[SSN]", "_UNCHECKED]")):
            assert r.text == redacted(texts[r.doc_id])


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid int"
    rows = [(1, "the cat sat on the mat and a@b.co", "en", "s", 33, 0), (1, "the cat sat on the mat and a@b.co", "en", "s", 33, 0), (None, "der hund und die katze", "de", None, None, 1), (3, None, None, None, None, 2), (4, "", "en", "s", 0, 3)]
    for data in (rows, rows[:0], rows[3:]):
        state = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            state = stage(spark, state, SMALL)
        got = sorted((str(r.doc_id), r.text) for r in state.collect())
        assert got == ([("1", "the cat sat on the mat and [EMAIL]"), ("None", "der hund und die katze")] if len(data) == 5 else [])


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100

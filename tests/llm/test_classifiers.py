import pickle
import zlib

import numpy as np
import pytest

from engramix.llm import quality_model, queries, toxicity

SMALL = "/root/testdata/sf0.01"


def labelled(spark, column):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", column).collect()}


def area(scores, truth):
    pos = [s for s, y in zip(scores, truth) if y]
    neg = [s for s, y in zip(scores, truth) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("name, column, modulus, rest, cut, least", [
    ("op4_toxicity", "toxic", 3, 1, 0.7, 0.85), ("op6_quality", "quality", 5, 0, 0.3, 0.95)])
def test_held_out_quality(spark, name, column, modulus, rest, cut, least):
    rows = queries.QUERIES[name](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    truth = labelled(spark, column)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert area([r.score for r in held], [truth[r.doc_id] for r in held]) > least


@pytest.mark.parametrize("block, first, dense", [(16, 2, 8), (64, 8, 20), (256, 1, 1), (7, 3, 10**9)])
def test_index_is_exact(monkeypatch, block, first, dense):
    for name, value in (("BLOCK", block), ("FIRST", first), ("DENSE", dense)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(0)
    x = np.where(rng.random((500, 40)) < 0.1, rng.random((500, 40)), 0).astype(np.float32)
    x[100:120] = x[99]  # ties
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    index = toxicity.BlockMaxIndex(x)
    for q in range(0, 500, 7):
        at = np.flatnonzero(x[q])
        if not len(at):
            continue
        found, cos = index.search(at, x[q, at], 9, skip=q)
        scores = x @ x[q]
        scores[q] = -1
        want = [i for i in np.lexsort((np.arange(500), -np.round(scores.astype(np.float64), 5)))[:9] if scores[i] > 1e-6]
        assert np.allclose(np.sort(cos), np.sort(scores[want]), atol=1e-5)


def packed(sample):
    return [(toxicity.packed_words(t), y) for t, y in sample]


def test_toxic_passages_count_in_texts_of_any_length():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abdeklmnorstu"), 6)) for _ in range(300)]
    filler = lambda n: " ".join(rng.choice(words, n))
    toxic = [f"{filler(60)} {w} fool and vile scoundrel {filler(60)}" for w in ["zlorpish"] * 3 + ["wretched"] * 57]
    model = toxicity.train(packed([(t, 1) for t in toxic] + [(filler(120), 0) for _ in range(60)]), (0.5, 0.5))
    for n in (0, 100, 1_000, 10_000):
        text = f"{filler(n)} wretched fool and vile scoundrel {filler(n)}"
        assert model.score(text)[0] >= 0.7 and model.score(filler(2 * n))[0] < 0.3
    at, w = model.vector({"zlorpish"})  # in three examples only
    assert set(model.index.search(at[:-1], w[:-1], 9)[0]) == {0, 1, 2}
    shipped = pickle.loads(pickle.dumps(model))
    assert shipped.score(toxic[9]) == model.score(toxic[9])
    few = toxicity.train(packed([("you vile zlorp", 1), ("you kind friend", 0)] * 2), (0.5, 0.5))
    assert few.score("a zlorp")[0] > few.score("a friend")[0]


def test_neighbours_match_dense_cosines(spark):
    """Vectors and neighbours against a dense TF-IDF matrix over all words of the examples."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(400).collect()]
    sample = [(t, i % 5 == 0) for i, (_, t) in enumerate(docs[:200])]
    model = toxicity.train(packed(sample), (0.8, 0.2))
    terms_of = lambda t: set(toxicity.text_terms(toxicity.distinct_words(t or "")))
    held = [terms_of(t) for t, _ in sample]
    terms = sorted(set().union(*held))
    assert sorted(model.names) == terms
    n, n1 = len(sample), sum(y for _, y in sample)
    column = {w: i for i, w in enumerate(terms)}
    h = lambda x, of: x * np.log(x / of) if x else 0.0
    full = -2 * (h(n1, n) + h(n - n1, n))
    e = min(toxicity.EVIDENCE, toxicity.EVIDENCE_SHARE * full)
    a, b = np.zeros(len(terms)), np.zeros(len(terms))
    for s, (_, y) in zip(held, sample):
        for x in s:
            (a if y else b)[column[x]] += 1
    weights = np.zeros(len(terms) + 1)
    for i, (p, q) in enumerate(zip(a, b)):
        g = 2 * (h(p, p + q) + h(q, p + q) + h(n1 - p, n - p - q) + h(n - n1 - q, n - p - q) - h(n1, n) - h(n - n1, n))
        weights[i] = np.log(1 / min(max(p * 0.2 / n1 + q * 0.8 / (n - n1), 1e-4), 1)) * (g / (g + e)) ** 2
    weights[-1] = model.idf[-1]

    def plain(text):
        out = np.zeros(len(terms) + 1)
        at = [column[x] for x in terms_of(text) if x in column]
        if at:
            out[[*at, -1]] = weights[[*at, -1]]
        return out / (np.linalg.norm(out) or 1)

    dense = np.array([plain(t) for t, _ in sample])
    for _, text in docs[200:260]:
        cos = dense @ plain(text)
        got_at, got = model.index.search(*model.vector(toxicity.distinct_words(text or "")), toxicity.NEIGHBOURS)
        assert np.allclose(got, np.sort(cos)[::-1][: len(got)], atol=1e-4) and np.allclose(got, cos[got_at], atol=1e-4)


def test_ties_go_to_the_earlier_example():
    model = toxicity.train(packed([("vile fool", 1)] * 40 + [("kind friend", 0)] * 40), (0.5, 0.5))
    at, cos = model.index.search(*model.vector({"fool", "vile"}), 5)
    assert list(at) == [0, 1, 2, 3, 4] and len(set(cos)) == 1


def test_words_have_vectors_of_their_own(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 4} gamma{i} CAPITAL !!") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    assert {"alpha", "beta", "capital", "!!", quality_model.UPPER} <= set(model.vocabulary)
    places = quality_model.Tokenizer(model.vocabulary).places("alpha beta")
    assert list(places) == [model.vocabulary.index("alpha"), model.vocabulary.index("beta")]
    unknown = quality_model.Tokenizer(model.vocabulary).places("never seen words")
    assert all(quality_model.OWN <= p < quality_model.TOKENS for p in unknown)


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality_model, "quality")])
def test_edge_cases(spark, module, column):
    texts = [("nasty awful words in here", 1), ("pleasant calm words in here", 0)] * 30
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, (t, _) in enumerate(texts)], "doc_id long, text string, score string, label double")
    labels = spark.createDataFrame([(i, y, "t") for i, (_, y) in enumerate(texts)] + [(999, None, "t"), (None, 1, "t"), (5, texts[5][1], "t")], f"doc_id long, {column} int, text string")
    model = module.fit(docs, labels, column)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "nasty awful " * 50_000), (3, "nasty awful " * 50_000), (None, "pleasant calm words")], "doc_id long, text string")
    got = module.score_texts(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] > by[None]
    assert module.score_texts(odd.limit(0), model).collect() == []
    none = module.fit(docs, labels.limit(0), column)
    assert len({r.score for r in module.score_texts(odd, none).collect()}) == 1
    assert module.score_texts(odd, module.fit(docs.limit(0), labels, column)).count() == 5


def test_contexts_cover_all_texts(spark):
    """Sums over tasks equal a plain loop."""
    texts = [f"alpha beta{i % 3} gamma delta !! {i}" for i in range(50)] + ["", None]
    got = quality_model.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    index, total = quality_model.index_vectors().astype(np.float64), np.zeros((quality_model.TOKENS, quality_model.DIMENSIONS))
    for t in texts:
        places = quality_model.Tokenizer().places(t or "")
        for i, p in enumerate(places):
            for j in range(max(0, i - quality_model.REACH), min(len(places), i + quality_model.REACH + 1)):
                if j != i:
                    total[p] += index[places[j]]
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-6)

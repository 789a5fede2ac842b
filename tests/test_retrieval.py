"""The greedy selection of the composed retrieval against a plain loop over its scored candidates."""

import random
import re

import pytest

from engramix.operators import completion
from engramix.plans import retrieval_queries
from engramix.sources.model import Model

SMALL = "/root/testdata/sf0.001"


def share(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def alike(x, y):
    words = share(x["terms"], y["terms"])
    weighted = (0.45 * words + 0.20 * share(x["entities"], y["entities"]) + 0.15 * (x["predicate"] == y["predicate"]) + 0.10 * share(x["episodes"], y["episodes"])) / 0.90
    return min(weighted, 0.80) if words < 0.80 or x["state"] != y["state"] else weighted


def greedy(rows, k=8, budget=1200):
    rest, taken, used = sorted(rows, key=lambda r: (-r["score"], r["fact_id"]))[:80], [], 0
    while rest and len(taken) < k:
        near = lambda r: max((alike(r, t) for t in taken), default=0.0)
        rest = [r for r in rest if near(r) <= 0.88 and used + r["tokens"] <= budget]
        if not rest:
            break
        best = max(rest, key=lambda r: (0.72 * r["score"] - 0.28 * near(r), r["score"], -r["fact_id"]))
        rest.remove(best)
        taken.append(best)
        used += best["tokens"]
    return [r["fact_id"] for r in taken]


def test_selection_matches_a_plain_loop(spark):
    m = Model(spark, SMALL)
    scored = retrieval_queries.scored(m).cache()
    links = [r for r in m.links.collect() if r.visibility_status == "visible" and r.searchable]
    cites = {}
    for r in links:
        if r.link_type == "EVIDENCED_BY":
            cites.setdefault(r.from_id, set()).add(r.to_id)
    rows = {}
    for r in scored.collect():
        text = r.content_summary
        rows.setdefault(r.query_id, []).append({
            "fact_id": r.fact_id, "score": r.score, "tokens": len(text) // 2 + 8, "terms": set(re.split(r"\s+", text.lower())), "predicate": r.predicate,
            "entities": {x for x in (r.subject_entity_id, r.object_entity_id) if x is not None}, "episodes": cites.get(r.fact_id, set()), "state": (r.validity_status, r.lifecycle_status)})
    want = {q: greedy(v) for q, v in rows.items()}
    cited = spark.createDataFrame([(k, sorted(v)) for k, v in cites.items()], "fact_id long, episode_ids array<long>")
    picked = retrieval_queries.retrieval.select(scored, cited).cache()
    got = {}
    for r in picked.orderBy("query_id", "rank_position").collect():
        got.setdefault(r.query_id, []).append(r.fact_id)
    assert got == want and len(got) > 5


def test_nothing_is_returned_that_may_not_be_shown(spark):
    """By a plain reading of the tables: the persona's own facts, visible, searchable, with allowed entities and sources, past ones only where history is allowed."""
    m = Model(spark, SMALL)
    asked = {r.query_id: r for r in m.questions.collect()}
    facts = {r.fact_id: r for r in m.facts.collect()}
    entities = {r.entity_id for r in m.entities.collect() if r.visibility_status == "visible" and r.searchable and r.sensitivity_level == "normal"}
    sources = {r.episode_id for r in m.episodes.collect() if r.visibility_status == "visible" and r.searchable and r.sensitivity_level == "normal"}
    cites = {}
    for r in m.links.filter("link_type = 'EVIDENCED_BY'").collect():
        cites.setdefault(r.from_id, []).append(r.visibility_status == "visible" and r.searchable and r.to_id in sources)
    rows = retrieval_queries.memory_retrieval(m).collect()
    assert len(rows) > 100
    for row in rows:
        f, q = facts[row.fact_id], asked[row.query_id]
        assert f.persona_id == q.persona_id and f.visibility_status == "visible" and f.searchable and f.sensitivity_level == "normal"
        assert f.lifecycle_status != "deep_archived"
        assert q.allow_historical or (f.validity_status != "invalidated" and f.lifecycle_status != "archived")
        assert all(e is None or e in entities for e in (f.subject_entity_id, f.object_entity_id))
        assert any(cites.get(f.fact_id, [])) or (f.pinned and f.fact_id not in cites)
    for q in {r.query_id for r in rows}:
        places = sorted(r.rank_position for r in rows if r.query_id == q)
        assert places == list(range(1, len(places) + 1)) and len(places) <= 8


def replaced(start, targets, k):
    """The replace fold as a plain loop; ``targets``: (source, -weight, link, target) in order."""
    acc = list(start)
    for source, _, _, target in sorted(targets):
        if any(f == target for f, _ in acc):
            continue
        if len(acc) >= k:
            open_ = [i for i, (f, old) in enumerate(acc) if f != source and not old]
            if not open_:
                continue
            del acc[open_[-1]]
        at = next((i + 1 for i, (f, _) in enumerate(acc) if f == source), len(acc))
        acc.insert(at, (target, True))
    return [f for f, _ in acc]


@pytest.mark.parametrize("k", [1, 3, 8])
def test_replaced_facts_come_in_like_in_a_plain_loop(spark, k):
    rng = random.Random(k)
    selected, targets, want = [], [], {}
    for q in range(60):
        start = [(f, rng.random() < 0.2) for f in rng.sample(range(30), rng.randint(1, k))]
        links = [(rng.choice(start)[0], -rng.choice([0.25, 0.5, 1.0]), n, rng.randrange(40)) for n in range(rng.choice([0, 3, 25]))]
        links = [x for x in links if x[0] != x[3]]
        selected += [(q, f, p, h) for p, (f, h) in enumerate(start, 1)]
        targets += [(q, s, t, -w, n) for s, w, n, t in links]
        want[q] = replaced(start, links, k)
    rows = completion.insert_superseded(
        spark.createDataFrame(selected, "query_id long, fact_id long, rank_position long, historical boolean"),
        spark.createDataFrame(targets, "query_id long, source_id long, fact_id long, weight double, link_id long"), k)
    got = {}
    for r in rows.orderBy("query_id", "rank_position").collect():
        got.setdefault(r.query_id, []).append(r.fact_id)
    assert got == want

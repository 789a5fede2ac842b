"""Energy over links against a plain loop, and narratives: what sorts and joins hold grows with the questions, not with the tables."""

import random

from engramix.operators import graph, recall

LINK = "from_id long, link_type string, to_type string, to_id long, direction string, weight double"
KINDS = ["CAUSED_BY", "SUPERSEDES", "ABOUT_ENTITY", "EVIDENCED_BY", "TRIGGERED_BY"]


def drawn():
    draw = random.Random(3)
    return [(draw.randrange(60), draw.choice(KINDS), draw.choice(["fact", "fact", "entity"]), draw.randrange(30), draw.choice(["forward", "backward", "bidirectional"]), draw.choice([0.0, 0.02, 0.5, 1.0])) for _ in range(400)]


def plain(links):
    """source: [(target, link_type, share)] as the contract says."""
    degree, away = {}, {}
    for a, kind, to, b, way, weight in links:
        a, b = f"fact:{a}", f"{to}:{b}"
        for n in (a, b):
            degree[n] = degree.get(n, 0) + 1
        if kind != "EVIDENCED_BY" and weight > 0:
            for s, t in [(a, b)] * (way != "backward") + [(b, a)] * (way != "forward"):
                away.setdefault(s, []).append((t, kind, weight * graph.LINK_MULTIPLIERS.get(kind, 0.5)))
    return {s: [(t, kind, 0.7 * w / degree[t] ** 0.5) for t, kind, w in ts] for s, ts in away.items()}


def test_energy_reaches_what_a_plain_loop_reaches(spark):
    links, seeds = drawn(), {1: {"fact:3": 1.0, "fact:8": 0.5}, 2: {"entity:4": 0.3, "fact:3": 0.02}, 3: {"fact:999": 1.0}}
    shares, want = plain(links), {}
    for q, start in seeds.items():
        total, front = dict(start), dict(start)
        for _ in range(2):
            best = {}
            for s, e in front.items():
                for t, _, share in shares.get(s, []):
                    if e * share >= 0.01:
                        total[t], best[t] = total.get(t, 0.0) + e * share, max(best.get(t, 0.0), e * share)
            front = best
        want |= {(q, n): round(min(1.0, e), 6) for n, e in total.items() if e >= 0.01}
    rows = graph.activate(spark.createDataFrame([(q, n, e) for q, s in seeds.items() for n, e in s.items()], "query_id long, node string, energy double"), spark.createDataFrame(links, LINK))
    got = {(r.query_id, r.node): r.energy for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 20
    # The hops are done; no join of all links is left for the sums.
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_shares_of_a_frontier(spark, monkeypatch):
    links = drawn()
    front = [("fact:3", 1.0), ("fact:3", 0.2), ("entity:4", 0.02), ("fact:999", 1.0)]
    want = sorted((s, t, kind, round(share, 9)) for s, e in (("fact:3", 1.0), ("entity:4", 0.02)) for t, kind, share in plain(links)[s] if e * share >= 0.01)
    for sent in (graph.SENT, 0):
        monkeypatch.setattr(graph, "SENT", sent)
        rows = graph.shares(spark.createDataFrame(links, LINK), spark.createDataFrame(front, "source string, e double")).collect()
        most = dict([("fact:3", 1.0), ("entity:4", 0.02)])
        assert {r.source for r in rows} <= set(most)
        assert sorted((r.source, r.target, r.link_type, round(r.share, 9)) for r in rows if most[r.source] * r.share >= 0.01) == want and want


def test_latest_narratives(spark):
    """Also with rows that share all keys of the order; texts take no part in the ranking."""
    draw = random.Random(4)
    rows = [(i // 2, "insight" if i % 3 else "narrative", i % 2 if i < 400 else None, draw.choice(["a red cat", "The RED", "a dog", None]), draw.choice(["active", "archived", "deep_archived"]), draw.choice([i * 5 % 90, None])) for i in range(420)]
    rows += [(1000, "insight", 0, text, "active", 500) for text in ("a dog", "red", "red")]
    table = spark.createDataFrame(rows, "node_id long, node_type string, persona_id long, search_text string, lifecycle_status string, updated_s long").selectExpr(
        "*", "'visible' AS visibility_status", "'normal' AS sensitivity_level", "true AS searchable"
    )
    asked = [(1, 0, True), (2, 0, False), (3, 1, True), (4, 1, False), (5, None, True)]
    questions = spark.createDataFrame(asked, "query_id long, persona_id long, allow_historical boolean").selectExpr("*", "'red' AS t", "'red' AS query_text", "true AS narrative_insight")
    want = []
    for q, persona, history in asked:
        mine = [r for r in rows if persona is not None and r[2] == persona and (r[4] == "active" or (history and r[4] == "archived"))]
        latest = sorted(mine, key=lambda r: (-(r[5] if r[5] is not None else -1), r[1], r[0]))[:30]
        want += [(q, n + 1, r[1], r[0]) for n, r in enumerate(x for x in latest if "red" in (x[3] or "").lower())]
    found = recall.narrative_hits(questions, table)
    assert sorted((r.query_id, r.rank_position, r.node_type, r.node_id) for r in found.collect()) == sorted(want) and len(want) > 20
    assert "WindowGroupLimit [persona_id" not in found._jdf.queryExecution().optimizedPlan().toString()

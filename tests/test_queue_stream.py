"""The stateful queue against a plain loop over the same commands, and against the batch operators."""

import random

import pytest

from engramix.operators import mutations, records
from engramix.streaming import queue as Q

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(spark, tmp_path, batches, **options):
    """The changes of ``batches`` of commands, each a micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, Q.COMMANDS).coalesce(1)
        frame.write.parquet(str(tmp_path / "one" / str(i)))
        (next((tmp_path / "one" / str(i)).glob("*.parquet"))).rename(tmp_path / "in" / f"{i:03}.parquet")
    stream = spark.readStream.schema(Q.COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = Q.queue_changes(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    out.trigger(availableNow=True).start().awaitTermination(240)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return [tuple(r) for r in spark.read.schema(Q.CHANGES).parquet(str(tmp_path / "out")).collect()]


def plain(commands, lease_s=Q.LEASE_S):
    """All changes by a loop over a dict: persona, queue_id, at, status, attempts."""
    rows, out = {}, []
    for p, at, _, kind, q, n, _ in sorted(commands, key=lambda c: (c[1], c[2])):
        mine = {k: v for k, v in rows.items() if k[0] == p}
        if kind in ("claim", "rebuild"):
            for k, v in mine.items():
                if v["working"] and v["updated"] < at - lease_s:
                    v.update(working=False, attempts=v["attempts"] + 1, updated=at)
                    out.append((p, k[1], at, "failed", v["attempts"]))
        if kind == "enqueue" and (p, q) not in rows:
            rows[p, q] = {"priority": n, "created": at, "working": False, "attempts": 0, "updated": at}
            out.append((p, q, at, "pending", 0))
        elif kind == "claim":
            free = sorted((v["priority"], v["created"], k) for k, v in mine.items() if not v["working"])[:n]
            for _, _, k in free:
                rows[k].update(working=True, updated=at)
                out.append((p, k[1], at, "processing", rows[k]["attempts"]))
        elif kind == "complete" and (p, q) in rows:
            out.append((p, q, at, "done", rows.pop((p, q))["attempts"]))
        elif kind == "fail" and (p, q) in rows:
            rows[p, q].update(working=False, attempts=rows[p, q]["attempts"] + 1, updated=at)
            out.append((p, q, at, "failed", rows[p, q]["attempts"]))
        elif kind == "rebuild":
            if any(v["working"] for v in mine.values()):
                out.append((p, None, at, "refused", 0))
            else:
                out += [(p, k[1], at, "done", rows.pop(k)["attempts"]) for k in mine]
        elif kind not in ("claim", "rebuild"):
            out.append((p, q, at, "ignored", 0))
    return sorted(out, key=str)


def test_equals_a_plain_loop_over_several_batches(spark, tmp_path):
    rng, commands = random.Random(4), []
    for seq in range(400):
        kind = rng.choices(["enqueue", "claim", "complete", "fail", "rebuild"], [8, 4, 3, 2, 0.4])[0]
        commands.append((rng.randrange(3), 40 + seq * 40, seq, kind, None if kind in ("claim", "rebuild") else rng.randrange(60), rng.randrange(5), "m"))
    # The lease's timers must not run before the commands do: a long delay keeps the watermark back.
    got = run(spark, tmp_path, [commands[:150], commands[150:160], commands[160:]], delay="30 days")
    assert sorted((c[:5] for c in got), key=str) == plain(commands)


def test_rows_beyond_the_limit_wait_and_leases_end_by_timer(spark, tmp_path):
    first = [(1, 1, i, "enqueue", i, 9 - i, None) for i in range(6)] + [(1, 10, 9, "claim", None, 2, None)]
    later = [(1, 20, 10, "complete", 5, None, None), (1, 30, 11, "claim", None, 2, None)]
    idle = [(2, 5000, 12, "enqueue", 77, 1, None)]
    got = run(spark, tmp_path, [first, later, idle, [(2, 9000, 13, "enqueue", 78, 1, None)], [(1, 9100, 14, "claim", None, 9, None)]])
    taken = [c[1:4] for c in got if c[3] == "processing"]
    assert {c[0] for c in taken if c[1] == 10} == {5, 4} and {c[0] for c in taken if c[1] == 30} == {3, 2}
    assert {(c[1], c[4]) for c in got if c[5] == Q.EXPIRED} == {(4, 1), (3, 1), (2, 1)}
    assert all(c[2] < 9000 for c in got if c[5] == Q.EXPIRED)  # by timers, before the last claim
    assert {c[0] for c in taken if c[1] == 9100} == {0, 1, 2, 3, 4}


def test_back_off_keeps_failed_rows_for_a_while(spark, tmp_path):
    rows = [(1, 1, 0, "enqueue", 1, 1, None), (1, 1, 1, "claim", None, 1, None), (1, 2, 2, "fail", 1, None, "x"), (1, 50, 3, "claim", None, 1, None), (1, 70, 4, "claim", None, 1, None)]
    got = run(spark, tmp_path, [rows], delay="1 day", backoff_s=60)
    assert [c[2] for c in sorted(got, key=lambda c: c[2]) if c[3] == "processing"] == [1, 70]


@pytest.mark.parametrize("limit", [3, 40])
def test_equals_the_batch_operators(spark, tmp_path, limit):
    rng = random.Random(limit)
    rows = [(i, rng.randrange(4), 1 + i % 7, rng.random() < 0.5) for i in range(30)]
    commands = [(0, created, i, "enqueue", i, priority, None) for i, priority, created, _ in rows] + [(0, 100, 99, "claim", None, limit, None)]
    batch = spark.createDataFrame([(i, p, c, "pending", 0) for i, p, c, _ in rows], "queue_id long, priority int, created_at long, status string, attempts long")
    claimed = mutations.claim(batch, limit)
    ends = claimed.join(spark.createDataFrame([(i, ok) for i, _, _, ok in rows], "queue_id long, ok boolean"), "queue_id").select("queue_id", "ok")
    want = {r.queue_id: (r.status, r.attempts) for r in records.finish(claimed, ends).collect()}
    oks = {r.queue_id: r.ok for r in ends.collect()}
    commands += [(0, 200, 200 + i, "complete" if ok else "fail", i, None, None) for i, ok in oks.items()]
    got = run(spark, tmp_path, [commands], delay="1 day")
    assert {c[1]: (c[3], c[4]) for c in got if c[2] == 200} == want

"""Ingest of events with state: the stream equals the batch form and a plain fold, whatever comes twice or out of order."""

import datetime as dt
import random

import pytest

from millrace.streaming import sessions

COLUMNS = "repo string, event_id long, ts timestamp, agent string, event_type string, tool string, text string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["UserPrompt", "ToolUse", "ToolFailure", "Stop", "SessionEnd", "AfterAgent", "ToolUse", "ToolUse"])
        text = "\n".join(r.choice(["decision: use parquet", "Constraint: no caps", f"fact: {r.randrange(9)}", "plain line", "", "do the thing " * r.randrange(90)]) for _ in range(r.randrange(3)))
        rows.append((r.choice(["a", "b", None]), i, START + dt.timedelta(seconds=r.randrange(60 * n)), r.choice(["x", "y"]) if r.random() < 0.2 else "x", kind, "sh", text if r.random() < 0.9 else None))
    return rows


def folded(rows):
    """The rules, event by event."""
    out, known, recent, claims = [], {}, {}, {}
    for repo, i, ts, agent, kind, tool, text in sorted({(r[0] or "", *r[1:]) for r in rows}, key=lambda r: (r[2], r[1])):
        at, kind, text = known.setdefault(repo, sessions.Key()), kind.lower(), text or ""
        opens = at.step(agent, kind, text)
        recent[repo] = [*([] if opens else recent[repo]), text][-sessions.RECENT :]
        new = set()
        if kind in sessions.CONSOLIDATE:
            new = {c for t in recent[repo] for c in sessions.claims_of(t)} - claims.setdefault(repo, set())
            claims[repo] |= new
        out.append((repo, i, ts, at.number, opens, at.work, *sessions.derived(kind, tool, text), len(new)))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("repo", "event_id", "ts", "session", "opened", "work_item", "kind", "content", "consolidated").collect()), key=repr)


def test_batch_equals_the_fold(spark):
    rows = made(400, 1)
    df = spark.createDataFrame(rows + rows[:50], COLUMNS)
    assert collected(sessions.batch(df)) == folded(rows)
    assert sessions.batch(df.limit(0)).count() == 0


def test_stream_equals_the_batch_and_a_replay_adds_nothing(rocks, tmp_path):
    spark = rocks
    rows = sorted(made(120, 2), key=lambda r: r[2])
    r = random.Random(3)
    last = [(k, 9000 + i, START + dt.timedelta(days=30), "x", "ToolUse", "", "") for i, k in enumerate(["a", "b", ""])]
    cuts = [rows[:40], rows[40:80], rows[80:]]
    source = str(tmp_path / "in")

    def feed(part):
        r.shuffle(part)
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(source)

    def run():
        s = spark.readStream.schema(COLUMNS).parquet(source)
        sessions.sink(sessions.stream(s), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(300)
        return collected(spark.read.parquet(str(tmp_path / "out")))

    feed(cuts[0] + cuts[0][:9])  # some come twice at once
    run()
    feed(cuts[1] + cuts[0][-5:])  # and some again in a later batch
    run()
    feed(cuts[2] + last)
    run()
    feed([("zz", 1, START + dt.timedelta(days=60), "x", "ToolUse", "", "")])  # moves the watermark on
    got = run()
    want = folded(rows + [x for x in last])
    assert got == want
    feed(list(cuts[1]))  # a replay: all are late now
    assert run() == want

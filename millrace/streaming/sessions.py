"""Ingest of agent events with state: sessions, work items, derived memories and consolidation, for each repository in
order of event time.

The rules, in a key's order of (ts, event_id):

- A prompt with text, while the key has no work item, makes one (its first 120 characters are the title).
- An event opens a session if there is none, the last one has ended, or its agent is another one; the session belongs to
  the work item that is there then.
- A failure leaves a memory of kind failure (tool and output, 800 characters), a prompt one of kind observation ("User
  task: " and 500 characters).
- `stop`, `afteragent` and `sessionend` consolidate the session: the distinct claims (lines that begin with decision:,
  constraint: or fact:) of its last 50 events which no consolidation of the key has given before. `sessionend` ends it.

`stream` keeps, for each key, the events that the watermark has not passed in a map by (ts, event_id), so an event that
comes twice counts once and order of arrival does not matter; a timer at the watermark settles them in order. Events
older than the watermark are late and dropped: what they would have been first to is settled. The claims that are known
live in a map of hashes. `batch` is the same as window functions over a whole table. Both return one row for each event.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 minutes"
TITLE, FAILURE, PROMPT, RECENT = 120, 800, 500, 50
#: What begins a claim, and the events that consolidate a session.
CLAIMS = ("decision", "constraint", "fact")
CONSOLIDATE = ("stop", "afteragent", "sessionend")
#: As the stateful operator gives them out; times are microseconds there, whatever the session's time zone.
_OUT = "repo string, event_id long, us long, session int, opened boolean, work_item string, kind string, content string, consolidated long"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def normalised(events: DataFrame) -> DataFrame:
    """repo, event_id, ts, agent, event_type, tool and text out of events; a null key, agent, type, tool or text counts as empty; events without id or time are left out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    e = events.select(text("repo").alias("repo"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), text("agent").alias("agent"), F.lower(text("event_type")).alias("event_type"), text("tool").alias("tool"), text("text").alias("text"))
    return e.where("event_id is not null and ts is not null")


def claims_of(text: str) -> list[str]:
    """The claims of a text: trimmed, lower-cased lines that begin with one of CLAIMS and a colon."""
    lines = (line.strip(" ").lower() for line in text.split("\n"))
    return [line for line in lines if line.split(":", 1)[0] in CLAIMS and ":" in line]


def derived(event_type: str, tool: str, text: str) -> tuple[str | None, str | None]:
    """(kind, content) of the memory that an event leaves."""
    text = text.strip(" ")
    if not text:
        return None, None
    if "failure" in event_type:
        return "failure", f"{tool} failed: {text[:FAILURE]}"
    if "prompt" in event_type:
        return "observation", f"User task: {text[:PROMPT]}"
    return None, None


class Key:
    """What is known of a key; `step` takes its next event."""

    __slots__ = ("agent", "number", "open", "title", "work")

    def __init__(self, number=0, agent="", open_=False, work=None, title=None):
        self.number, self.agent, self.open, self.work, self.title = number, agent, open_, work, title

    def step(self, agent: str, event_type: str, text: str) -> bool:
        """Takes in an event; did it open a session?"""
        if self.title is None and "prompt" in event_type and text.strip(" "):
            self.title = text.strip(" ")[:TITLE]
        opens = not self.open or agent != self.agent
        if opens:
            self.number, self.agent, self.work = self.number + 1, agent, self.title
        self.open = event_type != "sessionend"
        return opens


class Ingest(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "number int, agent string, open boolean, work string, title string")
        self.waiting = handle.getMapState("waiting", "us long, event_id long", "agent string, event_type string, tool string, text string")
        self.recent = handle.getListState("recent", "text string")
        self.claims = handle.getMapState("claims", "hash string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        times = set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                ms = r.us // 1000
                if ms < passed:
                    continue  # late
                self.waiting.updateValue((int(r.us), int(r.event_id)), (r.agent, r.event_type, r.tool, r.text))
                times.add(ms)
        if times:
            self.handle.registerTimer(max(times) + 1)
            self.handle.registerTimer(min(times) + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for (us, event_id), event in self.waiting.iterator():
            (ready if us // 1000 < passed else later).append((us, event_id, event))
        ready.sort(key=lambda x: x[:2])
        held = self.known.get() if self.known.exists() else None
        at = Key(*held) if held else Key()
        recent = [r[0] for r in self.recent.get()]
        out = []
        for us, event_id, (agent, event_type, tool, text) in ready:
            opens = at.step(agent, event_type, text)
            recent = [*([] if opens else recent), text][-RECENT:]
            new = 0
            if event_type in CONSOLIDATE:
                for claim in {hashlib.sha256(c.encode("utf-8", "replace")).hexdigest() for t in recent for c in claims_of(t)}:
                    if not self.claims.containsKey((claim,)):
                        self.claims.updateValue((claim,), (1,))
                        new += 1
            out.append((key[0], event_id, us, at.number, opens, at.work, *derived(event_type, tool, text), new))
            self.waiting.removeKey((us, event_id))
        if ready:
            self.known.update((at.number, at.agent, at.open, at.work, at.title))
            self.recent.put([(t,) for t in recent]) if recent else self.recent.clear()
        if later:
            self.handle.registerTimer(min(x[0] for x in later) // 1000 + 1)
        yield pd.DataFrame(out, columns=_NAMES) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def stream(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """A row for each event of a stream; needs the RocksDB state store."""
    e = normalised(events).withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    got = e.groupBy("repo").transformWithStateInPandas(Ingest(), _OUT, "Append", "EventTime")
    return got.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "ts")


def sink(rows: DataFrame, path: str, checkpoint: str):
    """Writes the rows of a stream, each batch into a folder of its number: a batch that is run again replaces what it had written."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _claims(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(x)))
    return F.filter(lines, lambda x: x.rlike(f"^({'|'.join(CLAIMS)}):"))


def batch(events: DataFrame) -> DataFrame:
    """The same for a table, in whole-table operators. Events that come twice (same repo, ts and event_id) count once."""
    e = normalised(events).dropDuplicates(["repo", "ts", "event_id"])
    order = Window.partitionBy("repo").orderBy("ts", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.trim("text")
    prompt = F.col("event_type").contains("prompt") & (text != "")
    opens = F.lag("agent").over(order).isNull() | (F.lag("agent").over(order) != F.col("agent")) | (F.lag("event_type").over(order) == "sessionend")
    e = e.withColumn("opened", opens).withColumn("title", F.first(F.when(prompt, F.substring(text, 1, TITLE)), ignorenulls=True).over(upto))
    e = e.withColumn("session", F.count_if("opened").over(upto).cast("int"))
    e = e.withColumn("work_item", F.last(F.when(F.col("opened"), F.struct("title")), ignorenulls=True).over(upto)["title"])
    within = Window.partitionBy("repo", "session").orderBy("ts", "event_id")
    e = e.withColumn("at", F.row_number().over(within))
    stops = F.col("event_type").isin(*CONSOLIDATE)
    # a claim counts at the first consolidation that still sees it: the next one of its session, if at most RECENT events on
    nxt = F.first(F.when(stops, F.struct("at", "ts", "event_id")), ignorenulls=True).over(within.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    said = e.withColumn("next", nxt).where(F.col("next.at") - F.col("at") < RECENT).select("repo", F.col("next.ts").alias("ts"), F.col("next.event_id").alias("event_id"), F.explode(_claims(F.col("text"))).alias("claim"))
    first = said.groupBy("repo", "claim").agg(F.min(F.struct("ts", "event_id")).alias("at")).groupBy("repo", "at.ts", "at.event_id").agg(F.count("*").alias("consolidated"))
    failed, asked = F.col("event_type").contains("failure"), F.col("event_type").contains("prompt")
    kind = F.when(text == "", None).when(failed, "failure").when(asked, "observation")
    content = F.when(text == "", None).when(failed, F.concat("tool", F.lit(" failed: "), F.substring(text, 1, FAILURE))).when(asked, F.concat(F.lit("User task: "), F.substring(text, 1, PROMPT)))
    out = e.join(first, ["repo", "ts", "event_id"], "left")
    return out.select("repo", "event_id", "ts", "session", "opened", "work_item", kind.alias("kind"), content.alias("content"), F.coalesce("consolidated", F.lit(0)).cast("long").alias("consolidated"))

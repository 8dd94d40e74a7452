"""The engine's verbs over a table of memories: remember, retrieve, plan, invalidate, touch, reuse, prune, stats; over the
events of agents: record, resume; and over both: handoff, execution_plan.

A store is a Parquet log of memory versions below a folder; the latest version of an id counts. Logs of uses, events and
traces lie beside it; each is only appended to, by what it does not hold yet, so a call that is repeated changes nothing.
Everything is lazy DataFrames; only a plan's few selected rows are meant to be collected.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import assess
from millrace.operators import changes as C
from millrace.operators import memory as M
from millrace.operators import packing as P
from millrace.operators import policy
from millrace.operators import ranking as R
from millrace.sources import manifest
from millrace.streaming import sessions

SCHEMA = "id long, content string, kind string, authority string, confidence double, reuse long, location string, scope string, valid_from long, invalidated_at long, superseded_by long, touched long"
EVENTS = "repo string, event_id long, ts timestamp, agent string, event_type string, tool string, text string"
TRACES = "trace long, task string, budget long, selected long, tokens long"
WATCHED = ("source", "commit")  # authorities of memories that a change of files bears upon
STABLE = ("decision", "constraint", "code", "fact")
CANDIDATES = 200


def query_terms(task: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.sub(r"[^a-z0-9_]+", " ", task.lower()).split() if len(t) >= 2))


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def remember(self, memories: DataFrame) -> None:
        """Append new versions; columns as in SCHEMA, missing ones null."""
        log = memories.select(*[F.col(c) if c in memories.columns else F.lit(None).alias(c) for c in (f.split()[0] for f in SCHEMA.split(", "))])
        log = log.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")])
        log.withColumn("version", F.unix_micros(F.current_timestamp())).write.mode("append").parquet(f"{self.path}/memories")

    def _latest(self) -> DataFrame:
        log = self.spark.read.schema(SCHEMA + ", version long").parquet(f"{self.path}/memories")
        rest = [c for c in log.columns if c not in ("id", "version")]
        return log.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("m")).select("id", "m.*")

    def _log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if manifest.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, name: str, schema: str, *key: str) -> None:
        """Rows whose key the log does not hold; of equal keys in them, one."""
        columns = [c.split() for c in schema.split(", ")]
        rows = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])
        rows.dropDuplicates(list(key)).join(self._log(name, schema).select(*key), list(key), "left_anti").write.mode("append").parquet(f"{self.path}/{name}")

    def memories(self) -> DataFrame:
        """The latest version of each memory; its uses are added to the reuse that it was remembered with."""
        uses = self._log("uses", "id long, use string").groupBy("id").agg(F.countDistinct("use").alias("_uses"))
        m = self._latest()
        return m.join(uses, "id", "left").withColumn("reuse", F.when(F.col("_uses").isNull(), F.col("reuse")).otherwise(F.coalesce("reuse", F.lit(0)) + F.col("_uses"))).drop("_uses").select(m.columns)

    def invalidate(self, ids: list[int], revision: int) -> None:
        self.remember(self._latest().where(F.col("id").isin(ids)).withColumn("invalidated_at", F.lit(revision)))

    def validate(self, ids: list[int], revision: int) -> None:
        self.remember(self._latest().where(F.col("id").isin(ids)).withColumn("invalidated_at", F.lit(None)).withColumn("valid_from", F.lit(revision)))

    def touch(self, changed: DataFrame, revision: int) -> None:
        """Mark what a change (path, status) of this revision bears upon: memories from sources and commits that are not
        invalidated and lie at, above or below a changed path. A memory is touched once a revision."""
        open_ = F.col("invalidated_at").isNull() & F.col("authority").isin(*WATCHED) & (F.coalesce("touched", F.lit(-1)) < revision)
        m = self._latest().where(open_)
        hit = C.touched(m, changed.where("status <> 'U'") if "status" in changed.columns else changed)
        self.remember(m.join(hit.select("id"), "id", "left_semi").withColumn("touched", F.lit(revision)))

    def reuse(self, uses: DataFrame) -> None:
        """Count uses (id, use: a name of the occasion); one that is there already does not count again."""
        self._append(uses.where("id is not null and use is not null"), "uses", "id long, use string", "id", "use")

    def sync(self, files: DataFrame, revision: int) -> DataFrame:
        """Bring the store up to a scan of the tree (columns of a manifest): commit its manifest and touch what changed since
        the last one. path, status of the changes; a scan of the same files touches nothing and commits nothing. Memories
        are touched before the manifest is committed, so that a run that is lost between the two is made good by the next."""
        root = f"{self.path}/manifest"
        known = max(manifest.versions(self.spark, root), default=0)
        diff = C.statuses(manifest.load(self.spark, root, known or None), files).where("status <> 'U'")
        if not diff.isEmpty():
            if known:
                self.touch(diff, revision)
            manifest.save(files, root, str(revision), known)
        return diff

    def record(self, events: DataFrame) -> None:
        """Append events of agents (EVENTS); one that is there already is left out."""
        self._append(events.where("event_id is not null"), "events", EVENTS, "repo", "event_id")

    def resume(self) -> DataFrame:
        """For each repository with events, where its work stands: work item, number, agent, start and end (null: open) of
        the latest session, its events, and the latest trace of a plan."""
        e = self._log("events", EVENTS)
        told = sessions.batch(e).select("repo", "event_id", "session", "work_item")
        j = told.join(e.select(F.coalesce("repo", F.lit("")).alias("repo"), "event_id", "ts", F.coalesce("agent", F.lit("")).alias("agent"), F.lower("event_type").alias("type")), ["repo", "event_id"])
        ended = F.max(F.when(F.col("type") == "sessionend", F.col("ts")))
        per = j.groupBy("repo", "session").agg(F.max_by("work_item", F.struct("ts", "event_id")).alias("work_item"), F.max_by("agent", F.struct("ts", "event_id")).alias("agent"), F.min("ts").alias("started"), ended.alias("ended"), F.count("*").alias("events"))
        last = per.groupBy("repo").agg(F.max(F.struct("session", "work_item", "agent", "started", "ended", "events")).alias("s")).select("repo", "s.*")
        trace = self._log("traces", TRACES).agg(F.max(F.struct("trace", "task", "budget", "selected", "tokens")).alias("trace"))  # one row
        return last.crossJoin(F.broadcast(trace))

    def retrieve(self, task: str, k: int = 20) -> DataFrame:
        """The k memories of the largest BM25 score."""
        m = self.memories()
        s = R.top_k(R.lexical_scores(m, "id", "content", query_terms(task)), "score", "key", k)  # at most k rows
        return m.join(F.broadcast(s.withColumnRenamed("key", "id")), "id").orderBy(F.desc("score"), "id")

    def rank(self, task: str, revision: int, changed: DataFrame | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """Candidates with fused score and density (null: rejected), cut to the best `candidates` by lexical score: memories
        beyond are not weighed, however fresh and trusted."""
        terms = query_terms(task)
        m = self.memories()
        lex = R.lexical_scores(m, "id", "content", terms).withColumnRenamed("key", "id")
        top = R.top_k(lex, "score", "id", candidates)
        m = m.join(F.broadcast(top), "id").withColumn("tokens", T.estimate_tokens(F.col("content")))
        changed = changed if changed is not None else self.spark.createDataFrame([], "path string, status string")
        m = M.staleness(m.fillna({"location": "", "scope": "", "valid_from": revision}), changed, revision)
        words = F.array(*[F.lit(x) for x in terms])
        m = m.withColumn("semantic", T.jaccard(T.tokens(F.col("content")), words)).withColumn("affinity", 0.6 * F.col("score") / F.greatest(F.lit(1e-9), F.max("score").over(Window.partitionBy())) + 0.4 * M.lookup(F.col("kind"), M.KIND_BOOST, 0.5))
        m = R.ranks(m, "id", "semantic", "score", "affinity")
        auth = M.authority(F.col("authority"))
        fused = R.rrf(F.col("semantic_rank"), F.col("score_rank"), F.col("affinity_rank")) * auth * (1 - F.col("risk")) * M.confidence_weight(F.coalesce("confidence", F.lit(0.0)))
        return m.withColumn("fused", fused).withColumn("density", F.when(~F.col("hard") & (auth >= M.AUTHORITY_FLOOR), F.col("fused") / F.greatest(F.lit(1), F.col("tokens"))))

    def plan(self, task: str, budget: int = 4000, revision: int = 0, changed: DataFrame | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """place, id, part (prefix or variable), tokens, score, content of what fits the budget; `candidates` as for rank."""
        ranked = self.rank(task, revision, changed, candidates)
        cands = ranked.select(F.lit(0).alias("one"), "id", "tokens", F.col("fused").alias("score"), "density")
        chosen = P.singleton_rescue(cands, "one", budget, fill=True).select(F.posexplode("chosen").alias("n", "id"))  # one query's few rows
        part = F.when(F.col("kind").isin(*STABLE), "prefix").otherwise("variable")
        w = Window.orderBy("part", "n")
        return ranked.join(F.broadcast(chosen), "id").withColumn("part", part).select(F.row_number().over(w).alias("place"), "id", "part", "kind", "tokens", F.col("fused").alias("score"), "content")

    def trace(self, task: str, budget: int, plan: DataFrame) -> None:
        """Keep what a plan took, for resume."""
        t = plan.agg(F.count("*").alias("selected"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        self._append(t.withColumn("trace", F.unix_micros(F.current_timestamp())).withColumn("task", F.lit(task)).withColumn("budget", F.lit(budget)), "traces", TRACES, "trace")

    def handoff(self, task: str, target: str, budget: int = 4000, revision: int = 0, changed: DataFrame | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """One row for another model: target, task, selected_tokens, stable_prefix and variable_context (arrays in order, no
        longer than the budget allows). An empty plan hands over empty arrays."""
        p = self.plan(task, budget, revision, changed, candidates)
        item = F.struct("place", "id", "kind", "tokens", "content")
        part = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, item))), lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["tokens"].alias("tokens"), x["content"].alias("content")))
        return p.agg(F.lit(target).alias("target"), F.lit(task).alias("task"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("selected_tokens"), part("prefix").alias("stable_prefix"), part("variable").alias("variable_context"))

    def execution_plan(self, task: str, models: list[policy.Model], budget: int = 4000, revision: int = 0, changed: DataFrame | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """One row: task, its profile, the plan's items and tokens, and how to work on it: model, dollars, calls, what is
        left for verification and its level."""
        p = self.plan(task, budget, revision, changed, candidates)
        one = p.agg(F.count("*").alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).withColumn("task", F.lit(task)).withColumn("profile", assess.task_profile(F.col("task")))
        return one.withColumn("c", policy.compute_plan(F.col("profile"), F.col("tokens"), models)).select("task", "profile", "items", "tokens", "c.*")

    def prune(self, as_of: int, keep_newest: int = 1000) -> DataFrame:
        """The memories that stay: not long invalidated or superseded, the newest of each scope."""
        m = self.memories().where((F.col("invalidated_at").isNull() | (F.col("invalidated_at") > as_of)) & F.col("superseded_by").isNull())
        w = Window.partitionBy("scope").orderBy(F.desc("id"))
        return m.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep_newest).drop("n")

    def stats(self) -> DataFrame:
        return self.memories().groupBy("kind").agg(F.count("*").alias("n"), F.count("invalidated_at").alias("invalidated"), F.sum(T.estimate_tokens(F.col("content"))).alias("tokens"), F.sum("reuse").alias("reuse"))

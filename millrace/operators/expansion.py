"""Best-first expansion of many tasks at once, under budgets of nodes and edges.

Of each task the node of the highest priority is expanded next (ties: the smaller id), as a heap would do it, until the
budget of nodes or edges is spent, the next node is worth less than it costs, or nothing is left. A child's score is its
parent's times the edge's weight and the decay, so with weights up to 1 no child comes before a node whose priority is
above `decay` times the best: a round fetches the edges of all such nodes of all tasks in one join and goes on from there.
There are as many rounds as the priorities of the slowest task fall by that factor, and none for a single task.

A task's state (at most as many nodes as its budgets let it see) is one row; each round is written to the shared folder.
Of a node's edges only the first `edges` + 1 in order of neighbour and kind are kept: a task walks no more (the next tells
that there was more).
"""

from __future__ import annotations

import heapq
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.work import table

NODES, EDGES, DEPTH, DECAY, LEAST_SCORE = 30, 50, 2, 0.75, 0.5


def advance(state: dict, near: dict, nodes: int, edges: int, depth: int, decay: float, cost: float) -> dict:
    """Goes on with a task until it ends or needs the edges of a node that is not in `near` (node: [(other, weight), ..])."""
    heap = [tuple(x) for x in state["heap"]]  # (-priority, node, score, centrality, depth)
    heapq.heapify(heap)
    done, scores = set(state["done"]), state["scores"]
    end = "queue_empty"
    while heap:
        if len(state["order"]) >= nodes:
            end = "max_nodes"
            break
        less, node, score, centrality, at = heap[0]
        fresh = node not in done
        # the price is asked before edges are needed: a node that is not worth its cost ends the task
        dear = fresh and at > 0 and -less * decay**at < cost
        if fresh and not dear and at < depth and node not in near:
            end = ""
            break
        heapq.heappop(heap)
        if not fresh:
            continue
        done.add(node)
        state["order"].append(node)
        if dear:
            end = "voi_below_cost"
            break
        if at >= depth:
            continue
        for other, weight in near[node]:
            if state["edges"] >= edges:
                end = "max_edges"
                break
            state["edges"] += 1
            if other in done:
                continue
            child = score * weight * decay
            priority = child * (1 + centrality)
            if priority > scores.get(other, float("-inf")):
                scores[other] = priority
                heapq.heappush(heap, (-priority, other, child, 0.0, at + 1))
        if end == "max_edges":
            break
    top = -heap[0][0] if heap else 0.0
    need = sorted({x[1] for x in heap if not end and x[1] not in done and x[4] < depth and -x[0] > decay * top} | ({heap[0][1]} if heap and not end else set()))
    return state | {"heap": [list(x) for x in heap], "done": sorted(done), "scores": scores, "end": end, "need": need}


def best_first(seeds: DataFrame, edges: DataFrame, max_nodes: int = NODES, max_edges: int = EDGES, max_depth: int = DEPTH, decay: float = DECAY, cost: float = 0.0) -> DataFrame:
    """seeds: task, id, score, centrality; edges: src, dst, weight (0 to 1), kind, walked both ways. A row for each node seen:
    task, id, score (its highest priority), place (in order of expansion from 1; null if only seen), ended (why the task did)."""
    task, node = seeds.schema["task"].dataType.simpleString(), seeds.schema["id"].dataType.simpleString()
    both = edges.select("src", "dst", "weight", "kind").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "kind")).where("src <> dst")
    first = Window.partitionBy("src").orderBy("dst", "kind", "weight")
    near = both.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max_edges + 1)  # a limit for each group: hubs are cut before they are shuffled
    near = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("r", F.col("dst").cast("string").alias("dst"), "weight"))).alias("near"))
    near = table(near.select(F.col("src").cast("string").alias("need"), F.to_json("near").alias("near")), "near")
    score = F.when(F.col("score") > 0, F.col("score")).otherwise(LEAST_SCORE)
    s = seeds.select("task", F.col("id").cast("string").alias("id"), score.cast("double").alias("score"), F.coalesce(F.col("centrality").cast("double"), F.lit(0.0)).alias("c"))
    s = s.groupBy("task").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "score", "c")))).alias("seeds"))
    settings = (max_nodes, max_edges, max_depth, decay, cost)

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, given in zip(frame["task"], frame["seeds"], strict=True):
            heap, scores = [], {}
            for x in json.loads(given):
                p = x["score"] * (1 + x["c"])
                heap.append([-p, x["id"], x["score"], x["c"], 0])
                scores[x["id"]] = p
            out.append((name, _packed(advance({"heap": heap, "done": [], "scores": scores, "order": [], "edges": 0}, {}, *settings))))
        return pd.DataFrame(out, columns=["task", "state"])

    def go_on(key, states: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        state = json.loads(states["state"].iloc[0])
        got = dict(zip(fetched["need"], fetched["near"], strict=True))
        links = {n: [(x["dst"], x["weight"]) for x in json.loads(got[n])] if got.get(n) else [] for n in state["need"]}
        return pd.DataFrame([(key[0], _packed(advance(state, links, *settings)))], columns=["task", "state"])

    state = table(s.mapInPandas(lambda frames: map(begin, frames), f"task {task}, state string"), "tasks")
    ended = None
    while True:
        at = state.withColumn("end", F.get_json_object("state", "$.end"))
        over = at.where("end <> ''").drop("end")
        ended = over if ended is None else ended.unionByName(over)
        open_ = at.where("end = ''").drop("end")
        if not open_.limit(1).count():
            break
        asks = open_.select("task", F.explode(F.from_json(F.get_json_object("state", "$.need"), "array<string>")).alias("need"))
        fetched = asks.withColumnRenamed("task", "of").join(near, "need")
        state = table(open_.groupBy("task").cogroup(fetched.groupBy("of")).applyInPandas(go_on, f"task {task}, state string"), "tasks")
    read = F.from_json("state", "scores map<string, double>, order array<string>, end string")
    rows = ended.select("task", read.alias("s")).select("task", "s.order", "s.end", F.explode("s.scores").alias("id", "score"))
    place = F.nullif(F.array_position("order", F.col("id")).cast("int"), F.lit(0))
    return rows.select("task", F.col("id").cast(node).alias("id"), "score", place.alias("place"), F.col("end").alias("ended"))


def _packed(state: dict) -> str:
    return json.dumps(state)

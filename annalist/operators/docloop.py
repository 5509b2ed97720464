"""The bounded generate-and-review loop and its scheduling (LLM1-9, SCH1-5).

The model is two callables given from outside: `generate(code, context, issues)` gives a text, `critique(code, text)` a
JSON reply with approved, issues and score; `gate(code, existing)` gives keep or regenerate. Nothing here reaches a
network. A level of the condensed call graph is one Spark job whose rows are functions; their documentations are the
next level's context. A failing component is retried, then marked, and its dependents go on without its text.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.session import Scratch

#: Components worked on at the same time.
CONCURRENCY = 4
MAX_ITERATIONS, RETRIES, BACKOFF = 3, 2, 0.5
APPROVED_FROM = 8


def routes(tasks: DataFrame) -> DataFrame:
    """LLM1: modified functions with a documentation go to the gate, all others to the generator."""
    gate = (F.col("mode") == "modified") & (F.coalesce(F.length("existing_documentation"), F.lit(0)) > 0)
    return tasks.withColumn("route", F.when(F.coalesce(gate, F.lit(False)), "gate").otherwise("generator"))


def gate_outcome(routed: DataFrame, decision: str) -> DataFrame:
    """LLM2: keep ends with the existing text and writes nothing; an absent decision regenerates."""
    keep = (F.col("route") == "gate") & (F.coalesce(decision, F.lit("regenerate")) == "keep")
    return routed.withColumn("outcome", F.when(keep, "keep").otherwise("generate"))


def outcomes(turns: DataFrame, key: list[str], limit: int = MAX_ITERATIONS) -> DataFrame:
    """LLM5: of reviewed turns (key, iteration, score, approved) the one that ends the loop: the first approved, else the one at the limit, else none yet."""
    within = turns.filter(F.col("iteration") <= limit)
    end = F.min(F.when(F.col("approved") | (F.col("iteration") == limit), F.struct("iteration", "score", "approved"))).alias("e")
    out = within.groupBy(*key).agg(end)
    state = F.when(F.col("e").isNull(), "open").when(F.col("e.approved"), "approved").otherwise("limit")
    return out.select(*key, F.col("e.iteration").alias("iteration"), F.col("e.score").alias("score"), state.alias("state"))


def render_context(edges: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """LLM8: (key, context): blocks in order of (part, sort key); edges: (key, part, dep); texts: (dep, name, kind, text). Missing texts drop out."""
    block = F.concat(F.lit("# "), "name", F.lit(" ("), "kind", F.lit("):\n"), "text")
    rows = edges.join(texts, "dep").filter(F.col("text").isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "dep", block.alias("block")))).alias("b"))
    return rows.select(*key, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def parse_reply(reply: str) -> dict:
    """LLM4: the reply, or its slice from the first brace to the last; approved must be there."""
    try:
        got = json.loads(reply)
    except json.JSONDecodeError:
        got = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])
    return {"approved": bool(got["approved"]), "issues": list(got.get("issues", [])), "score": int(got.get("score", 0))}


@dataclass
class Model:
    generate: Callable[[str, str, list[str]], str]
    critique: Callable[[str, str], str]
    gate: Callable[[str, str], str] = lambda code, existing: "regenerate"
    sleep: Callable[[float], None] = time.sleep


def document_one(model: Model, code: str, mode: str, existing: str, context: str) -> dict:
    """LLM3-6: one function through gate and loop."""
    if mode == "modified" and existing and model.gate(code, existing) == "keep":
        return {"documentation": existing, "score": None, "iteration": 0, "approved": True, "written": False}
    issues: list[str] = []
    for i in range(1, MAX_ITERATIONS + 1):
        text = model.generate(code, context, issues)
        review = parse_reply(model.critique(code, text))
        if review["approved"]:
            break
        issues = review["issues"]
    return {"documentation": text, "score": review["score"], "iteration": i, "approved": review["approved"], "written": True}


def run_component(model: Model, members: list[dict], retries: int = RETRIES) -> tuple[list[dict], str | None, int]:
    """SCH2, LLM9: the members of a component in order; on failure all of it again, and nothing of it counts until all succeed."""
    for attempt in range(retries + 1):
        try:
            done: list[dict] = []
            for m in members:
                done.append(m | document_one(model, m["source"], m["mode"], m["existing_documentation"], m["context"]))
            return done, None, attempt + 1
        except Exception as e:  # noqa: BLE001 - whatever a model raises is the component's failure
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                model.sleep(BACKOFF * 2**attempt)
    return members, error, retries + 1


RESULT = "n bigint, comp bigint, name string, documentation string, score int, iteration int, approved boolean, written boolean, error string, attempts int"


def run_levels(scratch: Scratch, model: Model, tasks: DataFrame, deps: DataFrame, levels: DataFrame, external: DataFrame | None = None, concurrency: int = CONCURRENCY) -> DataFrame:
    """SCH1-5: documents all tasks level by level; returns RESULT rows.

    tasks: (n, comp, name, source, mode, existing_documentation); deps: (n, dep); levels: (comp, level) as of
    `graph.levels`; external: (n, name, text), documentations of functions outside. Members of one component come to one
    row, sorted by name; a component is a cycle of calls, so it is small. A level's components are worked on by
    `concurrency` tasks, each one by one.
    """
    if concurrency < 1:
        raise ValueError("concurrency must be at least 1")
    top = levels.agg(F.max("level")).first()[0]
    placed = scratch.cut(tasks.join(levels, "comp"), "placed")
    called = tasks.select(F.col("n").alias("dep"), F.col("comp").alias("dcomp"), F.col("name").alias("dname"), F.col("source").alias("dsource"))
    pairs = scratch.cut(deps.join(placed.select("n", "comp", "level"), "n").join(called, "dep"), "pairs")
    done = None
    for level in range(0 if top is None else top + 1):
        here, own = (x.filter(F.col("level") == level) for x in (placed, pairs))
        mates = own.filter(F.col("comp") == F.col("dcomp")).select("n", F.lit(0).alias("part"), F.col("dname").alias("dep"), F.lit("source").alias("kind"), F.col("dsource").alias("text"))
        parts = mates
        if done is not None:
            before = done.filter(F.col("error").isNull()).select(F.col("n").alias("dep"), "documentation")
            parts = parts.unionByName(own.filter(F.col("comp") != F.col("dcomp")).join(before, "dep").select("n", F.lit(0).alias("part"), F.col("dname").alias("dep"), F.lit("documentation").alias("kind"), F.col("documentation").alias("text")))
        if external is not None:
            parts = parts.unionByName(external.filter(F.length("text") > 0).select("n", F.lit(1).alias("part"), F.col("name").alias("dep"), F.lit("documentation").alias("kind"), "text"))
        block = F.concat(F.lit("# "), "dep", F.lit(" ("), "kind", F.lit("):\n"), "text")
        context = parts.filter(F.col("text").isNotNull()).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("part", "dep", block.alias("b")))).alias("bs"))
        context = context.select("n", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("context"))
        member = F.struct("name", "n", "source", "mode", F.coalesce("existing_documentation", F.lit("")).alias("existing_documentation"), F.coalesce("context", F.lit("")).alias("context"))
        comps = here.join(context, "n", "left").groupBy("comp").agg(F.array_sort(F.collect_list(member)).alias("members"))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for comp, members in zip(b["comp"], b["members"]):
                    got, error, attempts = run_component(model, [dict(m) for m in members])
                    rows += [(m["n"], comp, m["name"], m.get("documentation"), m.get("score"), m.get("iteration"), m.get("approved"), False if error else m.get("written"), error, attempts) for m in got]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype(object)

        new = scratch.cut(comps.repartition(concurrency, "comp").mapInPandas(work, RESULT), "documented")
        done = new if done is None else done.unionByName(new)
    return done if done is not None else tasks.sparkSession.createDataFrame([], RESULT)


def tallies(results: DataFrame) -> DataFrame:
    """AGG9: documented and failed."""
    return results.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("documented"), F.count("error").alias("failed"))

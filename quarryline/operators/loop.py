"""Planning and reasoning loop, its deterministic parts (inventory L-01 to L-17, J-19 to J-23, A-21 to A-23, A-29, O-04, W-10)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import clean_list, collapse
from quarryline.operators.errors import BudgetExhausted, PrerequisiteNotMet, Retryable

TOOLS = ("search_knowledge", "retrieve_evidence", "build_bundle", "search_graph", "get_provenance", "find_contradictions", "get_paper_context")


def priority(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def plan_questions(questions: DataFrame, most: int = 8, most_keywords: int = 10) -> DataFrame:
    """L-01, O-04, A-29: (ord, question, priority, keywords): first of equal questions, by priority then order, at most `most`, numbered."""
    tidy = questions.withColumn("question", collapse(F.col("question"))).where("question <> ''").withColumn("key", F.lower("question"))
    first = tidy.groupBy("key").agg(F.min_by(F.struct("ord", "question", "priority", "keywords"), "ord").alias("q")).select("q.*")
    place = F.row_number().over(Window.orderBy(priority(F.col("priority")), "ord"))  # the questions of one plan
    return first.withColumn("place", place).where(F.col("place") <= most).select(F.concat(F.lit("RQ"), F.col("place").cast("string")).alias("id"), "question", "priority", clean_list(F.col("keywords"), most_keywords).alias("keywords"))


def retrieval_decision(coverage: Column, n_bundles: Column, floor: float = 0.34) -> Column:
    """L-02."""
    return F.when(n_bundles == 0, "insufficient").when(coverage >= floor, "sufficient").otherwise("insufficient")


def resolve_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """J-19, L-03: cited evidence that exists, per claim; claims that cite nothing real become hypotheses.

    Claims: claim_id, stated (confidence), evidence_ids. Known: evidence_id, paper_id.
    """
    cited = claims.select("claim_id", F.explode_outer(F.array_distinct("evidence_ids")).alias("evidence_id")).join(known, "evidence_id", "left")
    counted = cited.groupBy("claim_id").agg(F.count("paper_id").alias("resolved"), F.count_if(F.col("evidence_id").isNotNull() & F.col("paper_id").isNull()).alias("unresolved"), F.countDistinct("paper_id").alias("papers"))
    status = F.when(F.col("resolved") > 0, "claim").otherwise("hypothesis")
    return claims.join(counted, "claim_id").select("claim_id", "resolved", "unresolved", "papers", status.alias("status"), F.round(F.least("stated", 0.5 + 0.25 * F.least("papers", F.lit(2))), 6).alias("confidence"))


def resolve_verdict(verdict: Column, n_supporting: Column, n_contradicting: Column, overstated: Column, resolvable: Column) -> Column:
    """L-04: what a stated verdict comes to, given what it cites."""
    return (
        F.when(~resolvable, "unverifiable")
        .when((verdict == "verified") & ((n_supporting == 0) | overstated), "partially_verified")
        .when((verdict == "contradicted") & (n_contradicting == 0), "insufficient_evidence")
        .otherwise(verdict)
    )


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """J-20: the last verdict of each finding."""
    return verdicts.groupBy("finding_id").agg(F.max_by("verdict", F.struct("iteration", "seq")).alias("verdict"), F.max("iteration").alias("iteration"))


def latest_round(verdicts: DataFrame) -> DataFrame:
    """W-10: verdicts of the last iteration of each run. The last iteration is one aggregated row per run, joined back."""
    last = verdicts.groupBy("run_id").agg(F.max("iteration").alias("iteration"))
    return verdicts.join(last, ["run_id", "iteration"], "left_semi")


def route(exhausted: Column, any_verified: Column, contradicted: Column, wanting: Column) -> Column:
    """L-08: what comes after verification: a spent budget ends the run however good the verdicts are; then a verified finding of
    any round goes to review; of the latest round, a contradicted claim is reasoned again, one that wants evidence retrieved for."""
    return F.when(exhausted, "terminate").when(any_verified, "review").when(contradicted, "reason").when(wanting, "retrieve").otherwise("review")


def budget_exceeded(ledger: DataFrame, most_iterations: int, most_calls: int, most_tokens: int, most_ms: int) -> DataFrame:
    """L-07: the first limit that is reached, in this order, or null."""
    reason = F.when(F.col("iterations") >= most_iterations, "iterations").when(F.col("tool_calls") >= most_calls, "tool_calls").when(F.col("tokens") >= most_tokens, "tokens").when(F.col("elapsed_ms") >= most_ms, "wall_clock")
    return ledger.withColumn("exceeded", reason)


def ledger(calls: DataFrame) -> DataFrame:
    """A-21: tokens by agent, and calls that reported none; each call counts once."""
    return calls.dropDuplicates(["call_id"]).groupBy("run_id", "agent").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.count_if(F.expr("tokens IS NULL")).alias("unmeasured"))


def run_metrics(verdicts: DataFrame) -> DataFrame:
    """A-22: verdicts of a run by kind."""
    kinds = ("verified", "partially_verified", "insufficient_evidence", "contradicted", "unverifiable")
    return verdicts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("iteration").alias("iterations"), *(F.count_if(F.col("verdict") == k).alias(k) for k in kinds))


def review(findings: DataFrame) -> DataFrame:
    """L-05, A-23: decision and scores of a review, from findings with n_errors, completeness, n_papers and removed (by the reviewer, who can only remove)."""
    kept = (F.col("n_errors") == 0) & ~F.col("removed")
    agg = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("accepted"), F.round(F.avg("completeness"), 4).alias("completeness"), F.round(F.avg(F.least(F.col("n_papers") / 2, F.lit(1.0))), 4).alias("diversity"), F.round(F.avg((F.col("n_errors") > 0).cast("double")), 4).alias("unsupported_rate"))
    return agg.withColumn("decision", F.when(F.col("accepted") == 0, "reject").when(F.col("accepted") == F.col("n"), "accept").otherwise("revise"))


def gaps(texts: Column, most: int = 5) -> Column:
    """L-10."""
    return F.slice(F.array_distinct(texts), 1, most)


def audit(findings: DataFrame, questions: DataFrame, verdicts: DataFrame, reviews: DataFrame) -> DataFrame:
    """J-23, L-13: each finding with its question, last verdict and review; steps that are missing are named."""
    last = latest_verdicts(verdicts)
    joined = findings.join(questions.select(F.col("id").alias("question_id"), "question"), "question_id", "left").join(last, "finding_id", "left").join(reviews.select("finding_id", "decision"), "finding_id", "left")
    missing = F.filter(F.array(F.when(F.col("question").isNull(), "question"), F.when(F.col("verdict").isNull(), "verification"), F.when(F.col("decision").isNull(), "review")), lambda x: x.isNotNull())
    return joined.withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)


@dataclass
class Budget:
    """L-11: tool calls, counted on the driver."""

    most_calls: int
    calls: list[tuple[str, dict]] = field(default_factory=list)

    def reserve(self, tool: str, **arguments) -> None:
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool}")
        if len(self.calls) >= self.most_calls:
            raise BudgetExhausted("budget_exhausted")
        self.calls.append((tool, arguments))


def retry(call: Callable, attempts: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """L-14: again after retryable errors, waiting twice as long each time, and at least as long as the provider asks."""
    for n in range(attempts):
        try:
            return call()
        except Retryable as e:
            if n + 1 == attempts:
                raise
            sleep(max(base * 2**n, e.floor))
    raise AssertionError("unreachable")


@dataclass
class Stage:
    """L-09: one stage of a run on the driver; `needs` names what must be there before it. Needs over tables of runs are in `runs`."""

    name: str
    run: Callable[[dict], dict]
    needs: tuple[str, ...] = ()


def run_stages(stages: list[Stage], state: dict) -> tuple[dict, list[tuple[str, str, str | None]]]:
    """L-09, L-17: runs stages in order and keeps (stage, status, reason): blocked if something it needs is missing, failed if it raises."""
    history = []
    for s in stages:
        absent = [n for n in s.needs if state.get(n) is None]
        if absent:
            history.append((s.name, "blocked", f"prerequisite_not_met: {', '.join(absent)}"))
            break
        try:
            state = state | s.run(state)
            history.append((s.name, "completed", None))
        except PrerequisiteNotMet as e:
            history.append((s.name, "blocked", f"{e.code}: {e}"))
            break
        except Exception as e:
            history.append((s.name, "failed", str(e)[:200]))
            break
    return state, history

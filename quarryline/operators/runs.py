"""Runs as a table: what a stage asks of a run's state, and the reasoning loop of any number of runs as a fixed point
(inventory F-18, L-06 to L-09, L-17, K-12).

A run is a row. Each round is one plan over all runs that are still open: it takes in what the agents answered, charges the
ledger, decides what comes next and is written as a partition of the table of rounds. A run that has ended isn't touched
again, so a round costs what its open runs cost. Every round counts an iteration for each open run, and a run whose
iterations are spent ends, so there are at most `limits.iterations` rounds whatever the agents answer.

Cases: a run for which the agents have no answer in a round gains nothing and is charged nothing but the iteration; null
figures count as zero, null verdicts are no verdicts. Runs without an id are left out, as nothing can be joined to them;
answers that repeat a run and round are added up. Without runs there is one empty round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.errors import ConfigurationError
from quarryline.operators.loop import route
from quarryline.plans.shared import shared_dir

# --- what a stage asks ---

#: The column of a run's state that a need looks at: null if the stage that makes it hasn't run, else how many it made.
MEASURES = {"plan": "n_questions", "papers": "n_candidates", "files": "n_local", "documents": "n_ready", "knowledge": "n_objects", "bundles": "n_bundles", "findings": "n_findings", "verdicts": "n_verdicts"}
#: Needs for which it is enough that the stage has run.
MAY_BE_EMPTY = ("plan",)
#: Needs of each stage, in the order in which they are asked; `health` and `budget` look at the run itself.
STAGES = {
    "planning": ("health",),
    "discovery": ("health", "plan"),
    "documents": ("health", "papers", "files"),
    "knowledge": ("health", "documents"),
    "evidence": ("health", "plan", "knowledge"),
    "retrieval": ("budget",),
    "reasoning": ("budget", "bundles"),
    "verification": ("findings",),
    "review": ("verdicts",),
}


def unmet(need: str) -> Column:
    """Why a need isn't met, null if it is: the stage that failed, the limit that is reached, `absent` or `none`.

    `health` reads status and failed_stage, `budget` reads exceeded, the others their column of MEASURES.
    """
    if need == "health":
        return F.when((F.col("status") == "failed") | F.col("failed_stage").isNotNull(), F.coalesce("failed_stage", F.lit("unknown")))
    if need == "budget":
        return F.col("exceeded")
    if need not in MEASURES:
        raise ConfigurationError(f"no need {need!r}; known: budget, health, {', '.join(MEASURES)}")
    made = F.col(MEASURES[need])
    return F.when(made.isNull(), "absent").when((made <= 0) & F.lit(need not in MAY_BE_EMPTY), "none")


def admitted(states: DataFrame, stage: str) -> DataFrame:
    """F-18, L-09: the states with `need` and `why`, the first need of a stage that isn't met; null for runs that may begin it."""
    if stage not in STAGES:
        raise ConfigurationError(f"no stage {stage!r}; known: {', '.join(STAGES)}")
    asked = [F.struct(F.lit(n).alias("need"), unmet(n).alias("why")) for n in STAGES[stage]]
    first = F.filter(F.array(*asked), lambda x: x["why"].isNotNull())
    return states.withColumn("_first", F.try_element_at(first, F.lit(1))).withColumns({"need": F.col("_first.need"), "why": F.col("_first.why")}).drop("_first")


# --- the loop ---

AGENTS = ("retrieval", "reasoning", "verification", "reviewer")


@dataclass(frozen=True)
class Limits:
    """L-07: what a run may spend."""

    iterations: int = 3
    tokens: int = 120_000
    calls: int = 40
    attempts: int = 12
    agent_tokens: int = 60_000


#: What the agents answer for a run in a round.
ANSWERS = "run_id string, round int, bundles long, attempts long, calls long, findings long, verdicts array<string>, accepted long, " + ", ".join(f"{a}_tokens long" for a in AGENTS)
_SUMS = ("iterations", "attempts", "calls", "bundles", "findings", *(f"{a}_tokens" for a in AGENTS))
#: The state of a run after a round. `next` is null when it has ended, and `reason` says why.
STATE = "run_id string, " + ", ".join(f"{c} long" for c in _SUMS) + ", n_verdicts long, n_verified long, n_contradicted long, latest array<string>, refused string, refused_stage string, next string, reason string"

#: An answer gives for a run that is open: (open states, number of the round) to rows of ANSWERS without `round`.
Step = Callable[[DataFrame, int], DataFrame]


def exceeded(limits: Limits) -> Column:
    """L-07: why a ledger is spent, null if it isn't; the iterations are asked first."""
    spent = [F.col(f"{a}_tokens") for a in AGENTS]
    over = (reduce(Column.__add__, spent) >= limits.tokens) | (F.col("calls") >= limits.calls) | (F.col("attempts") >= limits.attempts)
    over = over | (F.greatest(*spent) >= limits.agent_tokens)
    return F.when(F.col("iterations") >= limits.iterations, "max_iterations").when(over, "budget_exhausted")


def opened(runs: DataFrame) -> DataFrame:
    """States of runs before their first round, from a column run_id; each run once."""
    zero = [F.lit(0).cast("long").alias(c) for c in (*_SUMS, "n_verdicts", "n_verified", "n_contradicted")]
    rows = runs.select(F.col("run_id").cast("string")).where("run_id IS NOT NULL").distinct()
    none = F.lit(None).cast("string")
    return rows.select("run_id", *zero, F.array().cast("array<string>").alias("latest"), none.alias("refused"), none.alias("refused_stage"), F.lit("retrieve").alias("next"), none.alias("reason"))


def _answers(step: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(f"a_{c}") for c in ("bundles", "attempts", "calls", "findings", "accepted", *(f"{a}_tokens" for a in AGENTS))]
    return step.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(*sums, F.flatten(F.collect_list(F.coalesce("verdicts", F.array().cast("array<string>")))).alias("a_verdicts"))


def advanced(states: DataFrame, step: DataFrame, limits: Limits) -> DataFrame:
    """L-17, L-08: one round of all open runs: retrieval if it was asked for, reasoning, verification, routing, review.

    A stage whose need isn't met is refused and the round goes on without it; the last refusal is the reason why the run
    ends, whenever it does. A review charges the reviewer, and a ledger that is spent by then is the reason, not the review.
    """
    s = states.join(_answers(step), "run_id", "left")
    got = lambda c: F.coalesce(F.col(f"a_{c}"), F.lit(0))
    charge = lambda when, *names: {n: F.col(n) + F.when(when, got(n)).otherwise(0) for n in names}
    refuse = lambda when, why, stage: {"refused": F.when(when, why).otherwise(F.col("refused")), "refused_stage": F.when(when, stage).otherwise(F.col("refused_stage"))}
    over, thin = exceeded(limits), F.lit("insufficient_evidence")

    retrieves = F.col("next") == "retrieve"
    s = s.withColumn("over", over)
    s = s.withColumns(refuse(retrieves & F.col("over").isNotNull(), F.col("over"), "retrieval") | charge(retrieves & F.col("over").isNull(), "bundles", "attempts", "calls", "retrieval_tokens"))

    s = s.withColumn("over", over).withColumn("reasons", F.col("over").isNull() & (F.col("bundles") > 0))
    s = s.withColumns(refuse(~F.col("reasons"), F.coalesce("over", thin), "reasoning") | charge(F.col("reasons"), "findings", "reasoning_tokens"))

    fresh = F.when(F.col("reasons"), F.filter(F.col("a_verdicts"), lambda v: v.isNotNull()))
    s = s.withColumn("over", over).withColumn("verifies", F.col("findings") > 0).withColumn("fresh", F.when(F.col("verifies"), fresh))
    s = s.withColumn("fresh", F.coalesce("fresh", F.array().cast("array<string>")))
    of = lambda kind: F.size(F.filter("fresh", lambda v: v == kind)).cast("long")
    told = {"n_verdicts": F.col("n_verdicts") + F.size("fresh"), "n_verified": F.col("n_verified") + of("verified"), "n_contradicted": F.col("n_contradicted") + of("contradicted"), "latest": F.when(F.size("fresh") > 0, F.col("fresh")).otherwise(F.col("latest"))}
    counts = {"iterations": F.col("iterations") + F.col("verifies").cast("long")}
    s = s.withColumns(refuse(~F.col("verifies"), F.coalesce("over", thin), "verification") | charge(F.col("verifies"), "verification_tokens") | told | counts)

    any_of = lambda *kinds: F.exists("latest", lambda v: v.isin(*kinds))
    s = s.withColumn("over", over).withColumn("way", route(F.col("over").isNotNull(), F.col("n_verified") > 0, any_of("contradicted"), any_of("insufficient_evidence", "partially_supported")))

    s = s.withColumn("reviews", (F.col("way") == "review") & (F.col("n_verdicts") > 0))
    s = s.withColumns(refuse((F.col("way") == "review") & ~F.col("reviews"), F.coalesce("over", thin), "review") | charge(F.col("reviews"), "reviewer_tokens"))
    ends = F.col("way").isin("review", "terminate")
    why = F.coalesce("refused", "over", F.when(F.col("reviews"), F.when(got("accepted") > 0, "all_questions_answered").otherwise("reviewer_rejected")), thin)
    s = s.withColumn("over", over).withColumns({"reason": F.when(ends, why), "next": F.when(~ends, F.col("way"))})
    return s.select(*[f.split(" ")[0] for f in STATE.split(", ")])


@dataclass
class RunTable:
    """Rounds of runs at `path`, one partition each; a driver that died goes on after the last round that was written whole."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession) -> RunTable:
        return cls(spark, shared_dir(spark))

    def _whole(self, n: int) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/round={n}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _round(self, n: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.path}/round={n}")

    def play(self, runs: DataFrame, step: Step, limits: Limits, after: Callable[[int], None] | None = None) -> None:
        """Rounds until no run is open; `after` is told each round that is written."""
        states = opened(runs)
        for n in range(max(1, limits.iterations + 1)):
            if not self._whole(n):
                advanced(states, step(states, n), limits).write.mode("overwrite").parquet(f"{self.path}/round={n}")
                if after is not None:
                    after(n)
            states = self._round(n).where("next IS NOT NULL")
            if states.isEmpty():
                return

    def rounds(self) -> DataFrame:
        """Every run in every round that it was open in, with `round`."""
        n, parts = 0, []
        while self._whole(n):
            parts.append(self._round(n).withColumn("round", F.lit(n)))
            n += 1
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], f"{STATE}, round int")

    def ended(self) -> DataFrame:
        """The runs that have ended, as they were then; run_state of one run is a filter on it."""
        return self.rounds().where("next IS NULL")


def recorded(answers: DataFrame) -> Step:
    """A step that reads what agents answered before; written once by round, so that each round reads its own."""
    path = f"{shared_dir(answers.sparkSession)}-answers"
    names = [f.split(" ")[0] for f in ANSWERS.split(", ")]
    answers.select(*names).write.partitionBy("round").parquet(path)
    table = answers.sparkSession.read.schema(ANSWERS).parquet(path)

    def step(states: DataFrame, n: int) -> DataFrame:
        return table.where(F.col("round") == n).drop("round").join(states.select("run_id"), "run_id", "left_semi")

    return step

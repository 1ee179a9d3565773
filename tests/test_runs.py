"""Runs as tables: needs of stages, killed and resumed loops; ledgers of a stream in any batches and order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import errors, runs
from quarryline.plans.shared import shared_dir
from quarryline.streaming import ledgers
from quarryline.streaming.telemetry import finished

STATES = "run_id string, status string, failed_stage string, exceeded string, " + ", ".join(f"{c} long" for c in runs.MEASURES.values())


def test_first_unmet_need_of_a_stage(spark):
    full = {c: 1 for c in runs.MEASURES.values()} | {"run_id": "r", "status": "running", "failed_stage": None, "exceeded": None}
    for stage in runs.STAGES:
        (r,) = runs.admitted(spark.createDataFrame([full], STATES), stage).select("need", "why").collect()
        assert tuple(r) == (None, None), stage
    for change, stage, want in (
        ({"failed_stage": "planning"}, "knowledge", ("health", "planning")),
        ({"status": "failed"}, "planning", ("health", "unknown")),
        ({"n_questions": None}, "discovery", ("plan", "absent")),
        ({"n_questions": 0}, "discovery", (None, None)),
        ({"n_candidates": 0, "n_local": 0}, "documents", ("papers", "none")),
        ({"n_local": 0}, "documents", ("files", "none")),
        ({"n_ready": None}, "knowledge", ("documents", "absent")),
        ({"n_questions": None, "n_objects": 0}, "evidence", ("plan", "absent")),
        ({"n_objects": 0}, "evidence", ("knowledge", "none")),
        ({"exceeded": "max_iterations", "n_bundles": 0}, "reasoning", ("budget", "max_iterations")),
        ({"n_bundles": None}, "reasoning", ("bundles", "absent")),
        ({"n_findings": 0}, "verification", ("findings", "none")),
        ({"n_verdicts": None}, "review", ("verdicts", "absent")),
    ):
        (r,) = runs.admitted(spark.createDataFrame([full | change], STATES), stage).select("need", "why").collect()
        assert tuple(r) == want, (change, stage)
    assert runs.admitted(spark.createDataFrame([], STATES), "review").count() == 0
    with pytest.raises(errors.ConfigurationError):
        runs.admitted(spark.createDataFrame([full], STATES), "dreaming")


def answer(run, n, **given):
    names = [f.split(" ")[0] for f in runs.ANSWERS.split(", ")]
    return tuple({"run_id": run, "round": n, "bundles": 1, "attempts": 1, "calls": 1, "findings": 1, "verdicts": ["unverifiable"]}.get(k) if k not in given else given[k] for k in names)


CASES = {
    "all": ([answer("all", 0, verdicts=["contradicted"]), answer("all", 1, verdicts=["verified"], accepted=1)], ("all_questions_answered", None, 1, 2)),
    "no": ([answer("no", 0, verdicts=["verified"], accepted=0)], ("reviewer_rejected", None, 0, 1)),
    "thin": ([answer("thin", 0, bundles=0)], ("insufficient_evidence", "review", 0, 0)),
    "rounds": ([answer("rounds", n, verdicts=["insufficient_evidence"]) for n in range(9)], ("max_iterations", None, 2, 3)),
    "silent": ([], ("insufficient_evidence", "review", 0, 0)),
    "dear": ([answer("dear", 0, verdicts=["contradicted"], reasoning_tokens=70_000)], ("budget_exhausted", None, 0, 1)),
    "review": ([answer("review", 0, verdicts=["verified"], accepted=1, reviewer_tokens=60_000)], ("budget_exhausted", None, 0, 1)),
    "fetch": ([answer("fetch", 0, calls=40)], ("budget_exhausted", "verification", 0, 0)),
    "twice": ([answer("twice", 0, verdicts=["partially_supported"], calls=20), answer("twice", 0, verdicts=None, calls=20, findings=None)], ("budget_exhausted", "verification", 0, 0)),
    "nulls": ([answer("nulls", 0, verdicts=[None, "verified"], accepted=None, bundles=2, calls=None)], ("reviewer_rejected", None, 0, 1)),
}


def played(spark, path, after=None):
    answers = spark.createDataFrame([a for rows, _ in CASES.values() for a in rows] + [answer(None, 0)], runs.ANSWERS)
    ids = spark.createDataFrame([(k,) for k in [*CASES, "all", None]], "run_id string")
    table = runs.RunTable(spark, path)
    table.play(ids, runs.recorded(answers), runs.Limits(), after)
    return table


def test_loops_end_for_their_reason(spark):
    table = played(spark, shared_dir(spark))
    got = {r.run_id: (r.reason, r.refused_stage, r["round"], r.iterations) for r in table.ended().collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}
    counted = table.rounds().groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in counted} == {k: want[2] + 1 for k, (_, want) in CASES.items()}


def test_killed_loops_go_on(spark):
    path = shared_dir(spark)

    def die(n):
        if n == 1:
            raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        played(spark, path, die)
    began = []
    table = played(spark, path, began.append)
    assert began == [2]  # rounds 0 and 1 were whole
    assert {r.run_id: r.reason for r in table.ended().collect()} == {k: want[0] for k, (_, want) in CASES.items()}


def test_no_runs(spark):
    table = runs.RunTable.create(spark)
    assert table.rounds().count() == 0
    table.play(spark.createDataFrame([], "run_id string"), runs.recorded(spark.createDataFrame([], runs.ANSWERS)), runs.Limits(iterations=0))
    assert table.rounds().count() == 0


CALLS = "run_id string, agent string, tokens long, ts timestamp"
LIMITS = ledgers.LedgerLimits(tokens=100, calls=6, agent_tokens=70)


def brute(rows, idle):
    """Ledgers written out over all calls, by days."""
    said, mark = [], max((r[3] for r in rows if r[3]), default=None)
    mark = mark and mark - dt.timedelta(hours=1)
    day = lambda t: (t - dt.datetime(1970, 1, 1)).days
    closed = lambda d: dt.datetime(1970, 1, 1) + dt.timedelta(days=d) <= mark
    for run in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == run and r[3]]
        held, last, told = [], None, False

        def close(run=run):
            if not told:
                by = {}
                for r in held:
                    by[r[1] or ""] = by.get(r[1] or "", 0) + (r[2] or 0)
                said.append((run, "idle", None, last, len(held), sum(r[2] or 0 for r in held), min(by, key=lambda a: (-by[a], a))))

        for d in sorted({day(r[3]) for r in mine}):
            if last is not None and d - last - 1 >= idle:
                close()
                held, last, told = [], None, False
            if not closed(d + 1):
                break
            held += [r for r in mine if day(r[3]) == d]
            last, by = d, {}
            for r in held:
                by[r[1] or ""] = by.get(r[1] or "", 0) + (r[2] or 0)
            top, total = min(by, key=lambda a: (-by[a], a)), sum(by.values())
            why = "tokens" if total >= 100 else "calls" if len(held) >= 6 else "agent_tokens" if by[top] >= 70 else None
            if why and not told:
                said.append((run, "spent", why, d, len(held), total, top))
                told = True
        else:
            if last is not None and closed(last + 1 + idle):
                close()
    return sorted(said, key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_ledgers_don_t_depend_on_batches(spark, batches):
    rng, start = random.Random(batches), dt.datetime(2024, 3, 1)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", None]), rng.choice([0, 5, 20, 40, None]), start + dt.timedelta(hours=rng.randrange(24 * 60))) for _ in range(110)]
    rows += [("e", "x", 10**6, None), ("f", "x", 1, start), ("f", "x", 500, start + dt.timedelta(days=30)), (None, None, None, start + dt.timedelta(days=70))]
    folder = shared_dir(spark)
    timed = sorted(rows, key=lambda r: r[3] or start)
    cuts = [timed[len(timed) * k // batches : len(timed) * (k + 1) // batches] for k in range(batches)]
    for k, part in enumerate(cuts):
        rng.shuffle(part)
        spark.createDataFrame(part, CALLS).coalesce(1).write.parquet(f"{folder}/{k}")
    source = spark.readStream.schema(CALLS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    setting = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with ledgers.typed_state(spark):
        got = finished(ledgers.ledgers(source, LIMITS, idle=4), "ledgers").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4)
    assert {r.outcome for r in got} == {"spent", "idle"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == setting


def test_no_calls(spark):
    folder = shared_dir(spark)
    spark.createDataFrame([], CALLS).write.parquet(folder)
    with ledgers.typed_state(spark):
        assert finished(ledgers.ledgers(spark.readStream.schema(CALLS).parquet(folder), LIMITS), "ledgers").select(F.count(F.lit(1))).first()[0] == 0


def test_a_run_is_read_and_written_once_for_its_input_and_once_for_its_timers():
    """However many days and agents: each access to state is a message."""
    import pandas as pd

    class Store:
        def __init__(self):
            self.value, self.calls, self.timers = None, 0, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.update(None)

        def registerTimer(self, at):
            self.timers.add(at)

    class Clock:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        def getExpiryTimeInMs(self):
            return self.at

    store, run = Store(), ledgers.RunLedger(ledgers.LedgerLimits(tokens=10**9, calls=10**9, agent_tokens=10**9), 4)
    run.init(store)
    days = [d for d in range(60) if d < 20 or d >= 40]
    run.handleInputRows(("r",), iter([pd.DataFrame([(d, f"a{a}", 5) for d in days for a in range(3)], columns=["day", "agent", "tokens"])]), None)
    assert store.calls == 2
    assert {t // ledgers.DAY_MS for t in store.timers} == {d + 1 for d in days} | {19 + 5, 59 + 5}
    mark = Clock(100 * ledgers.DAY_MS)
    said = pd.concat([f for t in sorted(store.timers) for f in run.handleExpiredTimer(("r",), mark, Clock(t))])
    assert store.calls == 4 and store.value is None
    assert said[["outcome", "day", "calls", "tokens", "agent"]].values.tolist() == [["idle", 19, 60, 300, "a0"], ["idle", 59, 120 // 2, 300, "a0"]]

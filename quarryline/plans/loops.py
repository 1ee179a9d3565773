"""Queries over tables of runs: what stages ask, loops as a fixed point, ledgers in a stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import generations, runs
from quarryline.plans import roles
from quarryline.plans.shared import shared_dir, tasks_for, written
from quarryline.streaming import ledgers, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: A customer's orders as the state of a run.
_STATES = """s AS (SELECT c_custkey AS run_id, CASE WHEN max(o_orderpriority) FILTER (o_orderpriority = '1-URGENT') IS NOT NULL AND c_custkey % 4 = 0 THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN c_custkey % 8 = 0 THEN max(o_orderpriority) FILTER (o_orderpriority = '1-URGENT') END AS failed_stage, CASE WHEN count(o_orderkey) > 3 THEN 'max_iterations' END AS exceeded,
  CASE WHEN c_acctbal > 0 THEN count(o_orderkey) END AS n_questions, count(o_orderkey) AS n_candidates, count(*) FILTER (o_orderstatus = 'P') AS n_local, CASE WHEN count(o_orderkey) > 1 THEN count(*) FILTER (o_orderstatus = 'F') END AS n_ready,
  CASE WHEN count(o_orderkey) > 2 THEN count(*) FILTER (o_orderstatus = 'O') END AS n_objects, count(*) FILTER (o_totalprice > 300000) AS n_bundles, count(*) FILTER (o_totalprice > 400000) AS n_findings, NULLIF(count(*) FILTER (o_totalprice > 450000), 0) AS n_verdicts
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal)"""


def _states(spark, sf):
    c, o = roles.table(spark, sf, "customer"), roles.table(spark, sf, "orders")
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    urgent = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")))
    n, key = F.count("o_orderkey"), F.col("c_custkey")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    tasks = tasks_for(o)  # orders are sorted by run in one task each: their number follows the orders'
    c, o = c.repartition(tasks, "c_custkey"), o.repartition(tasks, "o_custkey")
    return c.join(o, key == F.col("o_custkey"), "left").groupBy("c_custkey", "c_acctbal").agg(
        F.when(urgent.isNotNull() & (key % 4 == 0), "failed").otherwise("running").alias("status"), F.when(key % 8 == 0, urgent).alias("failed_stage"), F.when(n > 3, "max_iterations").alias("exceeded"),
        F.when(F.col("c_acctbal") > 0, n).alias("n_questions"), n.alias("n_candidates"), count(status == "P").alias("n_local"), F.when(n > 1, count(status == "F")).alias("n_ready"), F.when(n > 2, count(status == "O")).alias("n_objects"),
        count(price > 300000).alias("n_bundles"), count(price > 400000).alias("n_findings"), F.nullif(count(price > 450000), F.lit(0)).alias("n_verdicts"),
    ).withColumnRenamed("c_custkey", "run_id")


_ASKED = {
    "health": "CASE WHEN status = 'failed' OR failed_stage IS NOT NULL THEN coalesce(failed_stage, 'unknown') END",
    "budget": "exceeded",
    "plan": "CASE WHEN n_questions IS NULL THEN 'absent' END",
    **{need: f"CASE WHEN {c} IS NULL THEN 'absent' WHEN {c} <= 0 THEN 'none' END" for need, c in runs.MEASURES.items() if need != "plan"},
}
_ADMISSION = " UNION ALL ".join(
    f"SELECT run_id, '{stage}' AS stage, CASE " + " ".join(f"WHEN {_ASKED[n]} IS NOT NULL THEN '{n}'" for n in needs) + " END AS need, coalesce(" + ", ".join(_ASKED[n] for n in needs) + ", NULL) AS why FROM s" for stage, needs in runs.STAGES.items()
)


@query(f"WITH {_STATES} {_ADMISSION}")
def stage_admission(spark, sf):
    """F-18, L-09: for every run and stage the first need that isn't met."""
    states = written(_states(spark, sf), "states")  # once, not for each stage
    parts = [runs.admitted(states, stage).select("run_id", F.lit(stage).alias("stage"), "need", "why") for stage in runs.STAGES]
    return reduce(DataFrame.unionAll, parts)


#: Verdicts that a turn may have given, by its length. Fixed values of this query.
_KINDS = ("contradicted", "insufficient_evidence", "partially_supported", "unverifiable", "insufficient_evidence", "contradicted", "verified")
_LIMITS = runs.Limits(iterations=4, tokens=2500, calls=10, attempts=4, agent_tokens=1200)


def _over(it: str, at: str, ca: str, rt: str, st: str, vt: str, wt: str) -> str:
    m = _LIMITS
    return f"CASE WHEN {it} >= {m.iterations} THEN 'max_iterations' WHEN {rt} + {st} + {vt} + {wt} >= {m.tokens} OR {ca} >= {m.calls} OR {at} >= {m.attempts} OR greatest({rt}, {st}, {vt}, {wt}) >= {m.agent_tokens} THEN 'budget_exhausted' END"


_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations),
a AS (SELECT CAST(conv_id AS VARCHAR) AS run_id, CAST(turn AS INT) AS round, n % 4 AS b, 1 AS at, 1 + n % 3 AS ca, n % 3 AS f, [{_KIND_LIST}[n % 7 + 1], {_KIND_LIST}[(n + 1) % 7 + 1]][1:n % 3] AS v, n % 2 AS ok, 2 * n % 97 AS rt, n AS st, n // 2 AS vt, n % 50 AS wt FROM t),
s AS (SELECT DISTINCT run_id, -1 AS round, 0::HUGEINT AS it, 0::HUGEINT AS att, 0::HUGEINT AS ca, 0::HUGEINT AS b, 0::HUGEINT AS f, 0::HUGEINT AS rt, 0::HUGEINT AS st, 0::HUGEINT AS vt, 0::HUGEINT AS wt, 0::HUGEINT AS nv, 0::HUGEINT AS ny, 0::HUGEINT AS nc, []::VARCHAR[] AS latest, NULL::VARCHAR AS refused, NULL::VARCHAR AS stage, 'retrieve' AS next, NULL::VARCHAR AS reason FROM a
UNION ALL SELECT run_id, round, it, att, ca, b, f, rt, st, vt, wt, nv, ny, nc, latest, refused, stage, CASE WHEN NOT ends THEN way END, CASE WHEN ends THEN coalesce(refused, {_over("it", "att", "ca", "rt", "st", "vt", "wt")}, CASE WHEN reviews THEN CASE WHEN coalesce(ok, 0) > 0 THEN 'all_questions_answered' ELSE 'reviewer_rejected' END END, 'insufficient_evidence') END FROM (
SELECT * REPLACE (CASE WHEN way = 'review' AND NOT reviews THEN coalesce(o4, 'insufficient_evidence') ELSE refused END AS refused, CASE WHEN way = 'review' AND NOT reviews THEN 'review' ELSE stage END AS stage, wt + CASE WHEN reviews THEN awt ELSE 0 END AS wt) FROM (
SELECT *, way IN ('review', 'terminate') AS ends, way = 'review' AND nv > 0 AS reviews FROM (
SELECT *, CASE WHEN o4 IS NOT NULL THEN 'terminate' WHEN ny > 0 THEN 'review' WHEN list_contains(latest, 'contradicted') THEN 'reason' WHEN list_contains(latest, 'insufficient_evidence') OR list_contains(latest, 'partially_supported') THEN 'retrieve' ELSE 'review' END AS way FROM (
SELECT *, {_over("it", "att", "ca", "rt", "st", "vt", "wt")} AS o4 FROM (
SELECT * REPLACE (it + CASE WHEN f > 0 THEN 1 ELSE 0 END AS it, vt + CASE WHEN f > 0 THEN avt ELSE 0 END AS vt, CASE WHEN f > 0 THEN refused ELSE coalesce(o3, 'insufficient_evidence') END AS refused, CASE WHEN f > 0 THEN stage ELSE 'verification' END AS stage,
  nv + len(fresh) AS nv, ny + len(list_filter(fresh, lambda x: x = 'verified')) AS ny, nc + len(list_filter(fresh, lambda x: x = 'contradicted')) AS nc, CASE WHEN len(fresh) > 0 THEN fresh ELSE latest END AS latest) FROM (
SELECT *, {_over("it", "att", "ca", "rt", "st", "vt", "wt")} AS o3, CASE WHEN reasons AND f > 0 THEN av ELSE []::VARCHAR[] END AS fresh FROM (
SELECT * REPLACE (f + CASE WHEN reasons THEN af ELSE 0 END AS f, st + CASE WHEN reasons THEN ast ELSE 0 END AS st, CASE WHEN reasons THEN refused ELSE coalesce(o2, 'insufficient_evidence') END AS refused, CASE WHEN reasons THEN stage ELSE 'reasoning' END AS stage) FROM (
SELECT *, o2 IS NULL AND b > 0 AS reasons FROM (SELECT *, {_over("it", "att", "ca", "rt", "st", "vt", "wt")} AS o2 FROM (
SELECT s.run_id, s.round + 1 AS round, it, att + CASE WHEN next = 'retrieve' THEN coalesce(a.at, 0) ELSE 0 END AS att, s.ca + CASE WHEN next = 'retrieve' THEN coalesce(a.ca, 0) ELSE 0 END AS ca, s.b + CASE WHEN next = 'retrieve' THEN coalesce(a.b, 0) ELSE 0 END AS b, s.f,
  s.rt + CASE WHEN next = 'retrieve' THEN coalesce(a.rt, 0) ELSE 0 END AS rt, s.st, s.vt, s.wt, nv, ny, nc, latest, refused, stage, coalesce(a.f, 0) AS af, coalesce(a.v, []::VARCHAR[]) AS av, a.ok, coalesce(a.st, 0) AS ast, coalesce(a.vt, 0) AS avt, coalesce(a.wt, 0) AS awt
  FROM s LEFT JOIN a ON a.run_id = s.run_id AND a.round = s.round + 1 WHERE next IS NOT NULL)))))))))))
SELECT run_id, round, CAST(it AS BIGINT) AS iterations, CAST(att AS BIGINT) AS attempts, CAST(ca AS BIGINT) AS calls, CAST(b AS BIGINT) AS bundles, CAST(f AS BIGINT) AS findings, CAST(rt + st + vt + wt AS BIGINT) AS tokens, CAST(nv AS BIGINT) AS n_verdicts, CAST(ny AS BIGINT) AS n_verified, CAST(nc AS BIGINT) AS n_contradicted,
  array_to_string(latest, ',') AS latest, refused, stage AS refused_stage, next, reason FROM s WHERE round >= 0""")
def run_loops(spark, sf):
    """L-08, L-17: conversations as runs whose turns are what the agents answered; every run after each of its rounds."""
    n, kinds = F.length(F.coalesce("text", F.lit(""))), F.array(*(F.lit(k) for k in _KINDS))
    kind = lambda x: F.get(kinds, x % 7)
    c = roles.table(spark, sf, "conversations")
    figures = {"bundles": n % 4, "attempts": F.lit(1), "calls": 1 + n % 3, "findings": n % 3, "accepted": n % 2, "retrieval_tokens": 2 * n % 97, "reasoning_tokens": n, "verification_tokens": F.floor(n / 2), "reviewer_tokens": n % 50}
    answers = c.select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").cast("int").alias("round"), F.slice(F.array(kind(n), kind(n + 1)), 1, n % 3).alias("verdicts"), *(v.cast("long").alias(k) for k, v in figures.items()))
    table = runs.RunTable.create(spark)
    table.play(answers.select("run_id"), runs.recorded(answers), _LIMITS)
    tokens = reduce(lambda a, b: a + b, (F.col(f"{a}_tokens") for a in runs.AGENTS))
    return table.rounds().select("run_id", "round", "iterations", "attempts", "calls", "bundles", "findings", tokens.alias("tokens"), "n_verdicts", "n_verified", "n_contradicted", F.array_join("latest", ",").alias("latest"), "refused", "refused_stage", "next", "reason")


_LEDGER = ledgers.LedgerLimits(tokens=400_000, calls=90, agent_tokens=120_000)
_IDLE = 3


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_ms(ts) // {ledgers.DAY_MS} AS day, coalesce(event_type, '') AS agent, CAST(floor(coalesce(value, 0) * 100) AS BIGINT) AS tokens FROM events WHERE ts IS NOT NULL),
w AS (SELECT max(epoch_ms(ts)) - 3600000 AS mark FROM events), d AS (SELECT run_id, day, count(*) AS calls, sum(tokens) AS tokens FROM e GROUP BY ALL),
g AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY run_id ORDER BY day) <= {_IDLE} THEN 0 ELSE 1 END AS new FROM d)),
c AS (SELECT run_id, island, day, sum(calls) OVER o AS calls, sum(tokens) OVER o AS tokens, lead(day) OVER o IS NULL AS last FROM g WINDOW o AS (PARTITION BY run_id, island ORDER BY day)),
p AS (SELECT g.run_id, g.island, e.day, e.agent, sum(e.tokens) AS tokens FROM e JOIN g ON g.run_id IS NOT DISTINCT FROM e.run_id AND g.day = e.day GROUP BY ALL),
m AS (SELECT run_id, island, day, agent, most FROM (SELECT c.run_id, c.island, c.day, p.agent, sum(p.tokens) AS most FROM c JOIN p ON p.run_id IS NOT DISTINCT FROM c.run_id AND p.island = c.island AND p.day <= c.day GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run_id, island, day ORDER BY most DESC, agent) = 1),
j AS (SELECT c.*, m.agent, CASE WHEN c.tokens >= {_LEDGER.tokens} THEN 'tokens' WHEN c.calls >= {_LEDGER.calls} THEN 'calls' WHEN m.most >= {_LEDGER.agent_tokens} THEN 'agent_tokens' END AS reason FROM c JOIN m ON m.run_id IS NOT DISTINCT FROM c.run_id AND m.island = c.island AND m.day = c.day, w WHERE (c.day + 1) * {ledgers.DAY_MS} <= mark),
f AS (SELECT run_id, island, 'spent' AS outcome, reason, day, calls, tokens, agent FROM j WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, island ORDER BY day) = 1),
i AS (SELECT run_id, island, 'idle' AS outcome, NULL AS reason, day, calls, tokens, agent FROM j, w WHERE last AND (day + 1 + {_IDLE}) * {ledgers.DAY_MS} <= mark AND NOT EXISTS (FROM f WHERE f.run_id IS NOT DISTINCT FROM j.run_id AND f.island = j.island))
SELECT run_id, outcome, reason, day, CAST(calls AS BIGINT) AS calls, CAST(tokens AS BIGINT) AS tokens, agent FROM (SELECT * FROM f UNION ALL SELECT * FROM i)""")
def stream_run_ledgers(spark, sf):
    """ST-04: users as runs, kinds of events as agents, values as tokens: runs that are spent or idle, told by the stream."""
    calls = telemetry.event_stream(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("agent"), F.floor(F.coalesce("value", F.lit(0.0)) * 100).alias("tokens"), "ts")
    with ledgers.typed_state(spark):
        return telemetry.finished(ledgers.ledgers(calls, _LEDGER, _IDLE), "ledgers")


_NODE, _EDGE = "id string, kind string, name string", "id string, source_id string, target_id string, kind string, grounded boolean"


@query(f"""WITH {roles.GRAPH}, n AS (SELECT id, kind, CASE WHEN id LIKE 'k:%1' THEN name || ' new' ELSE name END AS name FROM gnodes WHERE NOT (kind = 'result' AND id LIKE '%7') UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation),
e AS (SELECT id, source_id, target_id, kind, CASE WHEN source_id LIKE 's:%3' THEN NOT grounded ELSE grounded END AS grounded FROM gedges WHERE NOT (kind IN ('PRODUCED_BY', 'MEASURED_BY') AND source_id LIKE '%7'))
SELECT 'nodes' AS what, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN concat_ws(',', CASE WHEN a.kind <> b.kind THEN 'kind' END, CASE WHEN a.name <> b.name THEN 'name' END) END AS fields
FROM gnodes a FULL JOIN n b ON a.id = b.id WHERE (a.kind, a.name) IS DISTINCT FROM (b.kind, b.name)
UNION ALL SELECT 'edges', coalesce(a.id, b.id), CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'grounded' END
FROM gedges a FULL JOIN e b ON a.id = b.id WHERE a.grounded IS DISTINCT FROM b.grounded""")
def generation_changes(spark, sf):
    """N-06: a graph whose results of every tenth part are gone, brands renamed, suppliers judged anew and nations new, against the one before."""
    nodes, edges = roles.graph_nodes(spark, sf), roles.graph_edges(spark, sf)
    made = F.col("kind").isin("PRODUCED_BY", "MEASURED_BY") & F.col("source_id").like("%7")
    nations = roles.table(spark, sf, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    later = {
        "nodes": nodes.where(~((F.col("kind") == "result") & F.col("id").like("%7"))).withColumn("name", F.when(F.col("id").like("k:%1"), F.concat("name", F.lit(" new"))).otherwise(F.col("name"))).unionByName(nations),
        "edges": edges.where(~made).withColumn("grounded", F.when(F.col("source_id").like("s:%3"), ~F.col("grounded")).otherwise(F.col("grounded"))),
    }
    path = shared_dir(spark)
    generations.store({"nodes": nodes, "edges": edges}, "g1", path)
    generations.store(later, "g2", path)
    parts = [generations.changes(spark, path, what, "g1", "g2", schema).select(F.lit(what).alias("what"), "id", "change", F.array_join("fields", ",").alias("fields")) for what, schema in (("nodes", _NODE), ("edges", _EDGE))]
    return parts[0].unionAll(parts[1])

"""One object with the engine's verbs over a set of tables (inventory 2.21, L-12, A-20, F-17, J-22, R-13, 2.20, S-13 to S-15)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import evidence, graph, loop
from quarryline.operators import retrieval as R
from quarryline.operators.errors import PrerequisiteNotMet


#: O-09: ids that one call may ask for.
MOST_IDS = 50


class Registry[T]:
    """Names to things; a name is given once, and unknown names say which are known."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def add(self, name: str, thing: T) -> T:
        if name in self.known:
            raise ValueError(f"registry_error: {self.what} {name!r} is there already")
        self.known[name] = thing
        return thing

    def get(self, name: str) -> T:
        if name not in self.known:
            raise KeyError(f"registry_error: no {self.what} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]

    def names(self) -> list[str]:
        return sorted(self.known)


ARMS: Registry[Callable] = Registry("retriever")


def _bm25(objects: DataFrame, query: R.Query) -> DataFrame:
    return R.bm25(objects, query, F.col("text"))


def _semantic(objects: DataFrame, query: R.Query) -> DataFrame:
    """Objects with a `vector`, by the `vector` among the options of a query; without one the arm gives nothing and says so."""
    if not query.options.get("vector"):
        raise PrerequisiteNotMet("the semantic arm needs a query vector")
    return R.semantic(R.candidates(objects, query), list(query.options["vector"]), query.limit).select("id", "score")


def _hybrid(objects: DataFrame, query: R.Query) -> DataFrame:
    """Rank fusion of the lexical, BM25 and, where there are vectors, semantic arms."""
    wide = replace(query, limit=query.limit * 3)
    arms = {"lexical": (1.0, R.lexical(objects, wide).select("id", "score")), "bm25": (1.0, _bm25(objects, wide).select("id", "score"))}
    if query.options.get("vector"):
        arms["semantic"] = (1.0, _semantic(objects, wide))
    return R.hybrid(arms, limit=query.limit)[0]


for _name, _arm in (("deterministic", R.lexical), ("cross_paper", R.cross_paper), ("bm25", _bm25), ("semantic", _semantic), ("hybrid", _hybrid)):
    ARMS.add(_name, _arm)


@dataclass
class Engine:
    """Tables by name (papers, objects, evidence, links, results, relations, nodes, edges, records) and the verbs over them."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    arm: str = "deterministic"
    budget: loop.Budget = field(default_factory=lambda: loop.Budget(50))

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"prerequisite_not_met: no table {name}")
        return self.tables[name]

    # retrieval layers

    def retrieve(self, layer: str, query: R.Query) -> DataFrame:
        """knowledge, evidence, documents, cross-paper or bundles."""
        if layer == "knowledge":
            return ARMS.get(self.arm)(self._table("objects"), query)
        if layer == "evidence":
            return R.evidence_search(self._table("evidence"), query)
        if layer == "documents":
            return R.document_search(self._table("papers"), query)
        if layer == "cross-paper":
            return R.cross_paper(self._table("objects"), query)
        if layer == "bundles":
            return R.stored_bundles(self._table("bundles"), query)
        raise ValueError(f"no layer {layer!r}")

    # the seven tools; each call counts against the budget

    def search_knowledge(self, text: str, limit: int = 10) -> DataFrame:
        self.budget.reserve("search_knowledge", text=text)
        return self.retrieve("knowledge", R.Query(_clean(text), limit=_clamp(limit)))

    def retrieve_evidence(self, object_ids: list[str]) -> DataFrame:
        self.budget.reserve("retrieve_evidence", n=len(object_ids))
        if len(object_ids) > MOST_IDS:
            raise ValueError(f"at most {MOST_IDS} ids a call, got {len(object_ids)}")
        wanted = self._table("objects").where(F.col("id").isin(*object_ids)).select(F.col("id").alias("object_id"))
        return evidence.evidence_of(wanted, self._table("links"), self._table("evidence"))

    def build_bundle(self, text: str, limit: int = 10, question_id: str | None = None) -> dict[str, DataFrame]:
        self.budget.reserve("build_bundle", text=text)
        return evidence.build_bundle(self._table("objects"), self._table("links"), self._table("evidence"), self.tables.get("results"), self.tables.get("relations"), R.Query(_clean(text), limit=_clamp(limit), question_id=question_id))

    def search_graph(self, kind: str | None = None, name: str | None = None, limit: int = 10) -> DataFrame:
        self.budget.reserve("search_graph", kind=kind, name=name)
        return graph.find_nodes(self._table("nodes"), kind, name, _clamp(limit))

    def get_provenance(self, node_id: str) -> DataFrame:
        self.budget.reserve("get_provenance", node_id=node_id)
        return graph.provenance_for(self._table("nodes"), node_id)

    def find_contradictions(self, tolerance: float = 0.05) -> DataFrame:
        self.budget.reserve("find_contradictions")
        return evidence.value_contradictions(self._table("results"), tolerance)

    def get_paper_context(self, paper_id: str) -> DataFrame:
        """J-22: a paper with how many objects of each kind are known of it."""
        self.budget.reserve("get_paper_context", paper_id=paper_id)
        known = self._table("objects").where(F.col("paper_id") == paper_id).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_objects"), F.array_sort(F.collect_set("kind")).alias("kinds"))
        return self._table("papers").where(F.col("id") == paper_id).join(known, F.col("id") == F.col("paper_id"), "left").drop("paper_id")

    # library

    def library(self, source: str | None = None, limit: int | None = None) -> DataFrame:
        """F-17."""
        out = self._table("papers")
        out = out if source is None else out.where(F.col("provider") == source)
        return out.orderBy("id").limit(limit) if limit else out

    def library_summary(self) -> DataFrame:
        """A-20: papers by source, and in all."""
        records = self._table("records").select(F.col("paper_id").alias("id"), "downloaded")
        joined = self._table("papers").select("id", "provider").join(records, "id", "left")
        done = F.coalesce("downloaded", F.lit(False))
        return joined.rollup("provider").agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("downloaded"), F.count_if(~done).alias("pending"))

    def paper_evidence(self, paper_id: str) -> DataFrame:
        """Evidence of a paper with the sections that it covers, distinct and sorted."""
        return self._table("evidence").where(F.col("paper_id") == paper_id).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("section_id")).alias("sections_covered"))

    def health(self) -> dict[str, bool]:
        """Which tables can be read and have rows."""
        out = {}
        for name, df in self.tables.items():
            try:
                out[name] = not df.isEmpty()
            except Exception:
                out[name] = False
        return out


def _clean(text: str) -> str:
    out = " ".join(text.split())[:500]
    if not out:
        raise ValueError("agent_input_error: empty query")
    return out


def _clamp(n: int, most: int = 50) -> int:
    return max(1, min(n, most))


def load_prompts(text: str) -> dict[str, str]:
    """S-14: sections of a prompt file, by their headings; doubled and empty ones are errors."""
    out: dict[str, str] = {}
    parts = re.split(r"(?m)^##\s+(\S+)\s*$", text)
    for name, body in zip(parts[1::2], parts[2::2], strict=True):
        if name in out:
            raise ValueError(f"prompt_error: {name} is there twice")
        if not body.strip():
            raise ValueError(f"prompt_error: {name} is empty")
        out[name] = body.strip()
    return out


def render(prompt: str, **values: str) -> str:
    """S-14: fills {names}; all must be given, and no others."""
    wanted = set(re.findall(r"\{(\w+)\}", prompt))
    if wanted != set(values):
        raise ValueError(f"prompt_error: wants {sorted(wanted)}, got {sorted(values)}")
    return re.sub(r"\{(\w+)\}", lambda m: values[m[1]], prompt)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """S-15: a gold set as JSON lines of query_id and judgements."""
    raw = spark.read.schema("query_id string, status string, judgements array<struct<object_id:string,relevance:string>>").json(path)
    gain = F.when(F.col("j.relevance") == "high", 3.0).when(F.col("j.relevance") == "medium", 2.0).when(F.col("j.relevance") == "low", 1.0).otherwise(0.0)
    return raw.select("query_id", "status", F.explode("judgements").alias("j")).select("query_id", "j.object_id", gain.alias("gain"), "status")


def save_run(rows: list[dict], path: str, spark: SparkSession) -> None:
    """K-09: the artifact of a benchmark run, as JSON lines."""
    spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(path)

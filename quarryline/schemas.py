"""Table schemas (inventory 1.3) as DDL, closed vocabularies (1.4), and checks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIERS = "struct<doi:string,arxiv_id:string,openalex_id:string,semantic_scholar_id:string,pubmed_id:string,corpus_id:string>"
PLACE = "struct<document_id:string,page:int,section_id:string,section_title:string,paragraph_index:int,char_start:int,char_end:int>"
SIGNALS = "array<struct<name:string,value:double,weight:double>>"
ISSUES = "array<struct<code:string,severity:string>>"

TABLES = {
    "papers": f"id string, title string, authors array<struct<name:string,affiliation:string,orcid:string>>, abstract string, year int, venue string, identifiers {IDENTIFIERS}, url string, pdf_url string, local_path string, provider string, also_seen_in array<string>, keywords array<string>, citation_count long, publication_type string, is_open_access boolean",
    "paper_records": "paper_id string, discovered boolean, downloaded boolean, parsed boolean, extracted boolean, indexed boolean, last_error string, updated_at timestamp, pdf_path string, discovered_at timestamp, run_ids array<string>",
    "blocks": "document_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, bold boolean, italic boolean",
    "sections": "document_id string, section_id string, parent_id string, kind string, title string, level int, page_start int, page_end int, confidence double",
    "paragraphs": "document_id string, section_id string, paragraph_index int, page int, text string, ord int",
    "references": "document_id string, ref_id string, ord int, marker string, raw string, title string, authors array<string>, year int, doi string, arxiv_id string, url string",
    "citations": "document_id string, section_id string, paragraph_index int, pos int, marker string, ref_id string",
    "captions": "document_id string, caption_id string, type string, label string, caption string, page int",
    "evidence": f"id string, kind string, claim string, quote string, place {PLACE}, produced_by string",
    "objects": f"id string, ord long, kind string, paper_id string, name string, description string, quotes array<string>, confidence double, signals {SIGNALS}, n_evidence int, trusted boolean",
    "relations": "id string, predicate string, subject_id string, object_id string, strength double",
    "evidence_links": "evidence_id string, object_id string, kind string, role string, linked_by string",
    "graph_nodes": "graph_version string, id string, kind string, name string, paper_ids array<string>, evidence_ids array<string>, confidence double",
    "graph_edges": "graph_version string, id string, kind string, source_id string, target_id string, grounded boolean, confidence double",
    "vectors": "id string, vector array<float>, paper_id string, kind string, name string, confidence double, fingerprint string, index_version string",
    "queries": "query_id string, text string, kinds array<string>, paper_ids array<string>, terms array<string>, min_confidence double, limit int, question_id string",
    "findings": "finding_id string, question_id string, statement string, status string, confidence double",
    "verifications": "finding_id string, verdict string, iteration int, seq int",
    "gold": "query_id string, object_id string, gain double, status string",
    "verdicts": f"validator string, subject_id string, success boolean, confidence double, signals {SIGNALS}, issues {ISSUES}, duration_ms long",
    "telemetry": "type string, payload string, run_id string, source string, created_at timestamp",
    "tool_calls": "call_id string, run_id string, agent string, tool string, tokens long",
}

#: Closed vocabularies.
DOMAINS = {
    "section_kind": ("title", "abstract", "introduction", "background", "related_work", "methodology", "experiments", "evaluation", "results", "discussion", "limitations", "future_work", "conclusion", "acknowledgements", "references", "appendix", "other"),
    "knowledge_kind": ("method", "dataset", "metric", "result", "limitation", "future_work"),
    "node_kind": ("paper", "method", "dataset", "metric", "result", "limitation", "future_work"),
    "edge_kind": ("MENTIONS", "EVALUATED_ON", "MEASURED_BY", "REPORTED_ON", "PRODUCED_BY", "LIMITS", "EXTENDS", "CONTRADICTS"),
    "predicate": ("evaluated_on", "measured_by", "reported_on", "produced_by", "limits", "extends"),
    "stance": ("supporting", "contradicting", "unknown"),
    "verdict": ("verified", "partially_verified", "insufficient_evidence", "contradicted", "unverifiable"),
    "decision": ("accept", "revise", "reject"),
    "severity": ("info", "warning", "error", "fatal"),
    "recoverability": ("retryable", "recoverable", "fatal"),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def in_domain(c: Column, domain: str) -> Column:
    """Null passes: the unknown breaks no vocabulary."""
    return c.isNull() | c.isin(*DOMAINS[domain])


def outside(df: DataFrame, column: str, domain: str) -> DataFrame:
    """Rows that break a vocabulary."""
    return df.where(~in_domain(F.col(column), domain))


def conform(df: DataFrame, name: str) -> DataFrame:
    """`df` with the columns and types of a table; columns it lacks are null, others are dropped."""
    wanted = empty(df.sparkSession, name).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))

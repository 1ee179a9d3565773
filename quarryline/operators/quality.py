"""Validators (inventory Q-01 to Q-19): each gives `issues` (code, severity) and `confidence` as columns of one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.confidence import issues, mean_of, signal, succeeds
from quarryline.functions.text import all_numbers_in, normalise, symmetric_overlap, tokens

#: Names that name nothing.
GENERIC_NAMES = ("dataset", "datasets", "method", "methods", "metric", "metrics", "model", "result", "results", "data", "approach", "technique", "n/a", "none", "unknown")
CANONICAL = ("abstract", "introduction", "related_work", "methodology", "results", "conclusion", "references")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def capped(a: Column, most: float) -> Column:
    return F.least(a / F.lit(float(most)), F.lit(1.0))


def verdict(df: DataFrame, found: Column, signals: list[Column]) -> DataFrame:
    """Q-19: issues, confidence and success."""
    return df.withColumn("issues", found).withColumn("confidence", mean_of(F.array(*signals))).withColumn("success", succeeds(F.col("issues")))


def pdf(docs: DataFrame, least_per_page: int = 200, most_empty: float = 0.5) -> DataFrame:
    """Q-01: (n_pages, n_chars, n_empty)."""
    pages, chars, empty = F.col("n_pages"), F.col("n_chars"), F.col("n_empty")
    per_page, share = ratio(chars, pages), F.when(pages > 0, empty / pages).otherwise(1.0)
    found = issues((pages < 1, "pdf_no_pages", "fatal"), (chars == 0, "pdf_no_text", "fatal"), ((chars > 0) & (per_page < least_per_page), "pdf_sparse_text", "warning"), (share > most_empty, "pdf_many_empty_pages", "warning"))
    return verdict(docs, found, [signal("text_density", capped(per_page, least_per_page * 5)), signal("page_coverage", 1 - share)])


def sections(docs: DataFrame, least_sections: int = 1, least_words: int = 500) -> DataFrame:
    """Q-02: (n_sections, kinds, mean_detection, body_words)."""
    known = F.size(F.array_intersect("kinds", F.array(*map(F.lit, CANONICAL))))
    found = issues((F.col("n_sections") < least_sections, "sections_missing", "error"), ((F.col("n_sections") >= least_sections) & (known == 0), "sections_unrecognised", "error"), (F.col("body_words") < least_words, "body_text_short", "warning"))
    return verdict(docs, found, [signal("canonical_coverage", known / len(CANONICAL)), signal("heading_confidence", F.coalesce("mean_detection", F.lit(0.0))), signal("body_volume", capped(F.col("body_words"), least_words * 4))])


def references(docs: DataFrame) -> DataFrame:
    """Q-03: (n_refs, n_structured, n_identified)."""
    n = F.col("n_refs")
    found = issues((n == 0, "references_missing", "warning"), ((n > 0) & (F.col("n_structured") == 0), "references_unstructured", "warning"))
    return verdict(docs, found, [signal("reference_presence", capped(n, 20)), signal("reference_structure", ratio(F.col("n_structured"), n)), signal("reference_identifiers", ratio(F.col("n_identified"), n))])


def citations(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Q-04: (n_citations, n_resolved)."""
    share = ratio(F.col("n_resolved"), F.col("n_citations"))
    found = issues(((F.col("n_citations") > 0) & (share < least), "citations_unresolved", "warning"))
    return verdict(docs, found, [F.when(F.col("n_citations") > 0, signal("citation_resolution", share)).otherwise(signal("citation_presence", F.lit(0.0)))])


def metadata(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """Q-05: a document's own title and DOI against what is known of the paper (known_title, known_doi), and completeness of n_known of five fields."""
    likeness = symmetric_overlap(tokens(F.col("title")), tokens(F.col("known_title")))
    missing = F.col("title").isNull()
    both = F.col("doi").isNotNull() & F.col("known_doi").isNotNull()
    found = issues((missing, "document_title_missing", "warning"), (~missing & (likeness < least), "metadata_title_mismatch", "warning"), (both & (F.col("doi") != F.col("known_doi")), "metadata_doi_mismatch", "error"))
    doi = F.when(~both, 0.5).otherwise((F.col("doi") == F.col("known_doi")).cast("double"))
    return verdict(docs, found, [signal("self_metadata_completeness", F.col("n_known") / 5), signal("title_agreement", F.when(missing, 0.0).otherwise(likeness)), signal("doi_agreement", doi)])


def object_evidence(objects: DataFrame) -> DataFrame:
    """Q-06: (name, quotes, n_located)."""
    words = F.filter(F.split(normalise(F.col("name")), " "), lambda w: F.length(w) > 2)
    joined = normalise(F.array_join("quotes", " "))
    named = F.exists(words, lambda w: joined.contains(w)) | (joined.contains(normalise(F.col("name"))) & (F.trim("name") != ""))
    found = issues((F.size("quotes") == 0, "evidence_not_textual", "error"), (~named, "name_absent_from_evidence", "warning"))
    return verdict(objects, found, [signal("evidence_precision", ratio(F.col("n_located"), F.size("quotes"))), signal("name_in_evidence", named.cast("double"))])


def result(results: DataFrame) -> DataFrame:
    """Q-07: (metric, value_text, quote, dataset, unit)."""
    supported = all_numbers_in(F.coalesce("value_text", F.lit("")), F.coalesce("quote", F.lit(""))) & (F.coalesce("value_text", F.lit("")) != "")
    context = (F.col("dataset").isNotNull().cast("int") + F.col("unit").isNotNull().cast("int")) / 2
    found = issues((F.coalesce("metric", F.lit("")) == "", "result_without_metric", "error"), (~supported, "result_value_unsupported", "error"))
    return verdict(results, found, [signal("value_in_quote", supported.cast("double")), signal("result_context", context)])


def completeness(objects: DataFrame, least_name: int = 2, least_claim: int = 20) -> DataFrame:
    """Q-08: (kind, name, description)."""
    name, description = F.trim("name"), F.coalesce("description", F.lit(""))
    claim = F.col("kind").isin("result", "limitation", "future_work")
    found = issues((normalise(name).isin(*GENERIC_NAMES), "name_too_generic", "error"), (F.length(name) < least_name, "name_too_short", "error"), (claim & (F.length(description) < least_claim), "claim_underspecified", "warning"))
    return verdict(objects, found, [signal("specificity", capped(F.length(name), 24)), signal("description_present", (F.trim(description) != "").cast("double"))])


def relationships(relations: DataFrame) -> DataFrame:
    """Q-09: (predicate, subject_kind, object_kind), kinds null where an end is missing."""
    from quarryline.operators.graph import edge_problem

    problem = edge_problem(F.upper("predicate"), F.col("subject_kind"), F.col("object_kind"))
    found = issues((problem == "dangling_endpoint", "relation_dangling", "error"), (problem == "source_kind_mismatch", "relation_domain_mismatch", "error"), (problem == "target_kind_mismatch", "relation_range_mismatch", "error"))
    return verdict(relations, found, [signal("integrity", problem.isNull().cast("double"))])


def knowledge_coverage(papers: DataFrame) -> DataFrame:
    """Q-10: (n_objects, n_kinds, n_evidence)."""
    return verdict(papers, issues((F.col("n_objects") == 0, "no_knowledge_extracted", "error")), [signal("kind_coverage", F.col("n_kinds") / 6), signal("evidence_density", F.least(ratio(F.col("n_evidence"), F.col("n_objects")), F.lit(1.0)))])


def bundle(bundles: DataFrame) -> DataFrame:
    """Q-11, Q-12: (n_objects, with_evidence, n_evidence, n_imprecise, n_papers, n_kinds)."""
    n = F.col("n_evidence")
    found = issues((n == 0, "bundle_without_evidence", "error"), ((n > 0) & (F.col("with_evidence") < F.col("n_objects")), "objects_without_evidence", "warning"), (F.col("n_imprecise") > 0, "imprecise_provenance", "warning"), (F.col("n_papers") == 0, "no_supporting_papers", "error"), (F.col("n_papers") == 1, "single_source_coverage", "warning"))
    return verdict(bundles, found, [signal("traceability", ratio(F.col("with_evidence"), F.col("n_objects"))), signal("paper_diversity", capped(F.col("n_papers"), 3)), signal("kind_diversity", capped(F.col("n_kinds"), 3))])


def graph(row: DataFrame) -> DataFrame:
    """Q-13: (n_nodes, n_distinct, proposed, accepted, grounded)."""
    found = issues((F.col("n_distinct") < F.col("n_nodes"), "duplicate_node_ids", "error"), (F.col("n_nodes") == 0, "empty_graph", "error"))
    return verdict(row, found, [signal("edge_acceptance", ratio(F.col("accepted"), F.col("proposed"))), signal("provenance_coverage", ratio(F.col("grounded"), F.col("proposed")))])


def finding(findings: DataFrame) -> DataFrame:
    """Q-14 to Q-17: (n_citations, n_unresolved, n_papers, verdict, overclaims, n_contradicting)."""
    v = F.col("verdict")
    found = issues(
        (F.col("n_citations") == 0, "no_citations", "error"),
        (F.col("n_unresolved") > 0, "unresolved_citations", "error"),
        (F.col("n_papers") == 1, "single_source", "warning"),
        (v.isNull(), "not_verified", "error"),
        (v.isNotNull() & (v != "verified"), F.concat(F.lit("verdict_"), v), "error"),
        (F.col("overclaims"), "overclaiming", "error"),
        (F.col("n_contradicting") > 0, "contradicted", "error"),
    )
    total = F.col("n_citations") + F.col("n_unresolved")
    return verdict(findings, found, [signal("citation_completeness", ratio(F.col("n_citations"), total)), signal("source_diversity", capped(F.col("n_papers"), 2)), signal("verification", (v == "verified").cast("double")), signal("uncontradicted", (F.col("n_contradicting") == 0).cast("double"))])


def status(verdicts: Column, contradicted: Column, cited: Column) -> Column:
    """Q-18, L-06: verdict to finding status."""
    return F.when(contradicted | (verdicts == "contradicted"), "contradicted").when(~cited, "hypothesis").when(verdicts == "verified", "accepted").when(verdicts.isin("partially_verified"), "needs_evidence").otherwise("rejected")


def combined(results: DataFrame, key: str) -> DataFrame:
    """A-04: verdicts of several validators on one subject: all issues, success if none fails, total duration."""
    return results.groupBy(key).agg(F.flatten(F.collect_list("issues")).alias("issues"), F.bool_and("success").alias("success"), F.sum("duration_ms").alias("duration_ms"))

"""Sources (inventory S-01 to S-17): payloads of bibliographic providers, staged as text, and local files as papers.

Fetching is a seam: `PayloadSource` is a Python data source whose reader calls any function that yields payloads, so an
HTTP client, a folder or a test can stand behind it; everything after it is expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarryline.functions import ids
from quarryline.functions.text import collapse, ranking_tokens

#: What providers call the kinds of publications.
PUBLICATION_TYPES = {
    "openalex": {"article": "journal_article", "preprint": "preprint", "book": "book", "book-chapter": "book_chapter", "dissertation": "thesis", "report": "report", "dataset": "dataset"},
    "crossref": {"journal-article": "journal_article", "proceedings-article": "conference_paper", "posted-content": "preprint", "book": "book", "book-chapter": "book_chapter", "dissertation": "thesis", "report": "report", "dataset": "dataset"},
    "semantic_scholar": {"JournalArticle": "journal_article", "Conference": "conference_paper", "Review": "journal_article", "Book": "book", "BookSection": "book_chapter", "Dataset": "dataset"},
}
FILE_NAME = r"^(?:(\d+)[_ -])?(?:\[(\w+)\][_ -])?(.+)$"


def publication_type(provider: str, c: Column) -> Column:
    """S-08: unknown where the provider's word is not known."""
    out = F.lit("unknown")
    for theirs, ours in PUBLICATION_TYPES.get(provider, {}).items():
        out = F.when(c == theirs, ours).otherwise(out)
    return out


def inverted_index(texts: DataFrame, words: str, index: str = "index") -> DataFrame:
    """S-04 the other way: `index`, {word: [places]}, of the array `words` of each row, without a row for each word.

    Words sorted with their places stand in runs, so a row's index takes its own words only and nothing is shuffled.
    """
    sorted_words = texts.withColumn("_w", F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("place")))))
    at = lambda i: F.get("_w", i)["word"]
    begins = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    runs = sorted_words.withColumn("_at", F.when(F.size("_w") > 0, begins).otherwise(F.array().cast("array<int>")))
    run = lambda b, n: F.slice("_w", b + 1, F.coalesce(F.get("_at", n + 1), F.size("_w")) - b)
    entries = F.transform("_at", lambda b, n: F.struct(at(b).alias("word"), F.transform(run(b, n), lambda x: x["place"]).alias("places")))
    return runs.withColumn(index, F.map_from_entries(entries)).drop("_w", "_at")


def rebuild_abstract(index: Column) -> Column:
    """S-04: a text from {word: [places]}, by place, then word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("place"), e.key.alias("word")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x.word), " ")


def _identifiers(**known: Column) -> Column:
    names = ("doi", "arxiv_id", "openalex_id", "semantic_scholar_id", "pubmed_id", "corpus_id")
    return F.struct(*(known.get(n, F.lit(None).cast("string")).cast("string").alias(n) for n in names)).alias("identifiers")


def _paper(df: DataFrame, provider: str, title: Column, abstract: Column, year: Column, kind: Column, identifiers: Column, keywords: Column | None = None, cited: Column | None = None, pdf: Column | None = None, open_access: Column | None = None) -> DataFrame:
    words = keywords if keywords is not None else F.array().cast("array<string>")
    return df.select(
        title.alias("title"), abstract.alias("abstract"), year.cast("int").alias("year"), kind.alias("publication_type"), identifiers, words.alias("keywords"), (cited if cited is not None else F.lit(None)).cast("long").alias("citation_count"),
        (pdf if pdf is not None else F.lit(None)).cast("string").alias("pdf_url"), (open_access if open_access is not None else F.lit(None)).cast("boolean").alias("is_open_access"), F.lit(provider).alias("provider"),
    ).withColumn("id", ids.paper_id(F.col("identifiers"), F.col("provider"), F.col("title")))


def openalex(payloads: DataFrame) -> DataFrame:
    """S-04: rows with `payload`, a JSON object with results."""
    schema = "results array<struct<id:string,title:string,doi:string,publication_year:int,type:string,cited_by_count:long,abstract_inverted_index:map<string,array<int>>,open_access:struct<is_oa:boolean,oa_url:string>,keywords:array<struct<display_name:string>>>>"
    r = payloads.select(F.explode(F.from_json("payload", schema).results).alias("r"))
    return _paper(r, "openalex", F.col("r.title"), rebuild_abstract(F.col("r.abstract_inverted_index")), F.col("r.publication_year"), publication_type("openalex", F.col("r.type")), _identifiers(doi=ids.doi(F.col("r.doi")), openalex_id=F.regexp_extract("r.id", r"([^/]+)$", 1)), F.coalesce(F.transform("r.keywords", lambda k: k.display_name), F.array().cast("array<string>")), F.col("r.cited_by_count"), F.col("r.open_access.oa_url"), F.col("r.open_access.is_oa"))


def crossref(payloads: DataFrame) -> DataFrame:
    """S-05: markup is taken out of the abstract."""
    schema = "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,type:string,`is-referenced-by-count`:long,issued:struct<`date-parts`:array<array<int>>>>>>"
    r = payloads.select(F.explode(F.from_json("payload", schema).message["items"]).alias("r"))
    abstract = collapse(F.regexp_replace("r.abstract", "<[^>]+>", " "))
    return _paper(r, "crossref", F.get("r.title", F.lit(0)), abstract, F.get(F.get(F.col("r.issued")["date-parts"], F.lit(0)), F.lit(0)), publication_type("crossref", F.col("r.type")), _identifiers(doi=ids.doi(F.col("r.DOI"))), cited=F.col("r")["is-referenced-by-count"])


def semantic_scholar(payloads: DataFrame) -> DataFrame:
    """S-06: all external identifiers are kept."""
    schema = "data array<struct<paperId:string,title:string,abstract:string,year:int,citationCount:long,publicationTypes:array<string>,isOpenAccess:boolean,openAccessPdf:struct<url:string>,externalIds:struct<DOI:string,ArXiv:string,PubMed:string,CorpusId:string>>>"
    r = payloads.select(F.explode(F.from_json("payload", schema).data).alias("r"))
    x = F.col("r.externalIds")
    return _paper(r, "semantic_scholar", F.col("r.title"), F.col("r.abstract"), F.col("r.year"), publication_type("semantic_scholar", F.get("r.publicationTypes", F.lit(0))), _identifiers(doi=ids.doi(x["DOI"]), arxiv_id=ids.arxiv(x["ArXiv"]), pubmed_id=x["PubMed"], corpus_id=x["CorpusId"], semantic_scholar_id=F.col("r.paperId")), cited=F.col("r.citationCount"), pdf=F.col("r.openAccessPdf.url"), open_access=F.col("r.isOpenAccess"))


def arxiv(payloads: DataFrame, year_from: int | None = None) -> DataFrame:
    """S-03: Atom feeds; papers of unknown year pass the filter."""
    schema = "entry array<struct<id:string,title:string,summary:string,published:string>>"
    r = payloads.select(F.explode(F.from_xml("payload", schema)["entry"]).alias("r"))
    out = _paper(r, "arxiv", collapse(F.col("r.title")), collapse(F.col("r.summary")), F.substring("r.published", 1, 4), F.lit("preprint"), _identifiers(arxiv_id=ids.arxiv(F.col("r.id"))))
    return out if year_from is None else out.where(F.col("year").isNull() | (F.col("year") >= year_from))


def pubmed(payloads: DataFrame) -> DataFrame:
    """S-07: fetched articles; labelled parts of an abstract are joined."""
    abstract = "array<struct<_VALUE:string,_Label:string>>"
    schema = f"PubmedArticle array<struct<MedlineCitation:struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:{abstract}>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:int>>>>>>>"
    r = payloads.select(F.explode(F.from_xml("payload", schema)["PubmedArticle"]).alias("a")).select("a.MedlineCitation.*")
    parts = F.transform("Article.Abstract.AbstractText", lambda p: F.concat_ws(": ", p["_Label"], F.trim(p["_VALUE"])))
    return _paper(r, "pubmed", F.col("Article.ArticleTitle"), F.array_join(parts, " "), F.col("Article.Journal.JournalIssue.PubDate.Year"), F.lit("journal_article"), _identifiers(pubmed_id=F.col("PMID")))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"openalex": openalex, "crossref": crossref, "semantic_scholar": semantic_scholar, "arxiv": arxiv, "pubmed": pubmed}


def enabled(config: dict[str, dict]) -> list[str]:
    """S-11: the sources that are switched on, in order; unknown names are an error."""
    unknown = sorted(set(config) - set(PARSERS) - {"manual"})
    if unknown:
        raise ValueError(f"unknown sources: {unknown}")
    return [n for n, c in config.items() if c.get("enabled", True)]


def manual_library(spark: SparkSession, path: str) -> DataFrame:
    """S-01: PDF files of a folder, by name: number, tag and title from names of the agreed form, else the stem is the title."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "length", "modificationTime")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?i)\.pdf$", "")
    title = collapse(F.replace(F.regexp_extract(stem, FILE_NAME, 3), F.lit("_"), F.lit(" ")))
    some = lambda c: F.when(c != "", c)
    return files.select(F.concat(F.lit("manual:"), F.substring(F.sha1(F.lower(title)), 1, 16)).alias("id"), title.alias("title"), some(F.regexp_extract(stem, FILE_NAME, 1)).cast("int").alias("index"), some(F.regexp_extract(stem, FILE_NAME, 2)).alias("tag"), F.col("path").alias("local_path"), F.col("length").alias("source_bytes"), F.lit("manual").alias("provider")).orderBy("local_path")


def manual_search(papers: DataFrame, text: str, limit: int) -> DataFrame:
    """S-02: by words shared with the title."""
    shared = F.size(F.array_intersect(ranking_tokens(F.col("title")), ranking_tokens(F.lit(text))))
    return papers.withColumn("shared", shared).where("shared > 0").orderBy(F.desc("shared"), "title").limit(limit)


def download_plan(papers: DataFrame, done: DataFrame) -> DataFrame:
    """K-08: what to do about each paper's file, and why."""
    got = done.select(F.col("paper_id").alias("id"), F.lit(True).alias("done"))
    reason = F.when(F.col("local_path").isNotNull(), "already_local").when(F.col("done"), "already_downloaded").when(F.col("pdf_url").isNull(), "no_url").when(~F.col("pdf_url").rlike("^https?://"), "cannot_download").otherwise("download")
    return papers.join(got, "id", "left").withColumn("action", reason).drop("done")


def retrievable(papers: DataFrame) -> DataFrame:
    """F-07."""
    return papers.where(F.coalesce("local_path", "pdf_url").isNotNull())


def discover(parts: list[DataFrame]) -> DataFrame:
    """U-01, R-16: results of all sources, in source order."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("source_order", F.lit(n))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


class PayloadSource(DataSource):
    """S-09: `spark.read.format("quarryline_payloads").option("queries", "a|b")` with a fetch function registered by `register`."""

    fetch: Callable[[str], Iterator[str]] = staticmethod(lambda query: iter(()))

    @classmethod
    def name(cls) -> str:
        return "quarryline_payloads"

    def schema(self) -> str:
        return "query string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _PayloadReader([q for q in self.options.get("queries", "").split("|") if q], type(self).fetch)


class _PayloadReader(DataSourceReader):
    """One task per query."""

    def __init__(self, queries: list[str], fetch: Callable[[str], Iterator[str]]):
        self.queries, self.fetch = queries, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition):
        for payload in self.fetch(partition.value):
            yield (partition.value, payload)


def register(spark: SparkSession, fetch: Callable[[str], Iterator[str]]) -> None:
    spark.dataSource.register(type("PayloadSource", (PayloadSource,), {"fetch": staticmethod(fetch)}))

"""Document structure (inventory X-01 to X-10, W-04 to W-08, A-17 to A-19, J-10).

Blocks: document_id, ord, page, text, size, bold. Everything is windows and expressions; no block leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import collapse, word_count
from quarryline.plans.shared import written

#: How printed headings name the parts of a paper; the first pattern that is found counts.
SECTION_PATTERNS = (
    ("abstract", r"^abstract$|^summary$"),
    ("related_work", r"related\s+work|prior\s+work|literature\s+review"),
    ("background", r"^background|preliminar|motivation"),
    ("introduction", r"^introduction|^overview$"),
    ("methodology", r"method|approach|^design\b|system\s+design|architecture|implementation|system\s+model"),
    ("experiments", r"experiment|^setup\b|study\s+design|benchmark"),
    ("evaluation", r"evaluation|^analysis\b"),
    ("results", r"result|finding"),
    ("limitations", r"limitation|threats?\s+to\s+validity"),
    ("future_work", r"future\s+work|future\s+direction|open\s+problem"),
    ("discussion", r"discussion|implication"),
    ("conclusion", r"conclusion|concluding|closing\s+remark"),
    ("acknowledgements", r"acknowledg"),
    ("references", r"^references?$|^bibliography$|^works\s+cited$"),
    ("appendix", r"^appendix|^supplement"),
)
NOT_BODY = ("title", "references", "acknowledgements", "appendix")
#: Section numbers, captions, citation markers and what is read from a bibliography entry.
NUMBERING = r"^\s*((\d+(\.\d+)*)|([IVXLC]+)|([A-Z](\.\d+)*))[.)]?\s+(?=\S)"
TRAILING = r"[\s.:]+$"
FIGURE = r"(?is)^\s*((?:fig(?:ure)?|abb)\.?\s*(\d+[a-z]?|[IVXLC]+))\s*[.:—–-]?\s*(.*)"
TABLE = r"(?is)^\s*(tab(?:le)?\.?\s*(\d+[a-z]?|[IVXLC]+))\s*[.:—–-]?\s*(.*)"
CITATION = r"\[(\d{1,3}(?:\s*[,–—-]\s*\d{1,3})*)\]"
ENTRY = r"\[(\d{1,3})\]\s*"
NUMBERED_LINE = r"^\s*(\d{1,3})[.)]\s+(?=[A-Z])"
YEAR = r"\b(19\d{2}|20\d{2})\b"
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
ARXIV = r"(?i)arXiv[:\s]\s*(\d{4}\.\d{4,5}(?:v\d+)?)"
URL = r"https?://\S+"
QUOTED_TITLE = "[“\"]([^”\"]{10,300})[”\"]"
AUTHORS = "^(.{3,200}?)(?:\\.\\s+|\\s{2,})(?=[A-Z“\"])"


def body_size(blocks: DataFrame) -> DataFrame:
    """A-18: per document the font size of most characters; of equal ones the size seen first."""
    sizes = blocks.groupBy("document_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"), F.min("ord").alias("first"))
    return sizes.groupBy("document_id").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body_size"))


def median_length(blocks: DataFrame) -> DataFrame:
    """A-19."""
    return blocks.groupBy("document_id").agg(F.median(F.length("text")).alias("median_chars"))


def section_name(title: Column) -> Column:
    """A heading without its number and closing marks, in lower case."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.trim(title), NUMBERING, ""))), TRAILING, "")


def classify(title: Column) -> Column:
    """X-02."""
    return kind_of(section_name(title))


def kind_of(name: Column) -> Column:
    """X-02 of a section name."""
    out = F.lit("other")
    for kind, pattern in reversed(SECTION_PATTERNS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return F.when(name == "", "other").otherwise(out)


def level(text: Column) -> Column:
    """X-03: depth of the section number, six at most; one without a number."""
    number = F.regexp_extract(text, NUMBERING, 1)
    return F.when(number == "", 1).otherwise(F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1))


def headings(blocks: DataFrame, max_chars: int = 120, max_words: int = 12, least: float = 0.35, ratio: float = 1.08) -> DataFrame:
    """X-01, F-10: blocks (not blank) with is_heading, title, kind, level and confidence.

    A heading must show intent: larger type, bold type or a number; brevity and the lack of a full stop only add to that.
    """
    b = blocks.where(F.trim("text") != "").join(body_size(blocks), "document_id")
    # in steps, so that what several conditions ask for is a column, made once a block
    b = b.select("*", F.trim("text").alias("trimmed"), collapse(F.col("text")).alias("collapsed"), ((F.col("body_size") > 0) & (F.col("size") >= F.col("body_size") * ratio)).alias("larger"))
    b = b.select("*", word_count(F.col("text")).alias("words"), F.col("trimmed").rlike(NUMBERING).alias("numbered"), F.regexp_replace("collapsed", TRAILING, "").alias("title"))
    b = b.select("*", (F.col("trimmed").rlike(r"[.,;]$") & ~F.col("numbered")).alias("prose"), section_name(F.col("title")).alias("name"))
    points = lambda c, v: F.when(c, v).otherwise(0.0)
    raw = points(F.col("larger"), 0.35) + points(F.col("bold"), 0.25) + points(F.col("numbered"), 0.25) + points(F.col("words") <= 8, 0.10) + points(~F.col("prose"), 0.05)
    b = b.select("*", raw.alias("raw"), kind_of(F.col("name")).alias("kind"))
    is_heading = (F.length("trimmed") <= max_chars) & (F.col("words") <= max_words) & (F.col("larger") | F.col("bold") | F.col("numbered")) & (F.round("raw", 4) >= least) & (F.col("title") != "")
    confidence = F.round(F.when(F.col("kind") != "other", F.least(F.lit(1.0), F.col("raw") + 0.25)).otherwise(F.col("raw")), 4)
    return b.select("document_id", "ord", "page", "text", is_heading.alias("is_heading"), "title", "kind", level(F.col("trimmed")).alias("level"), confidence.alias("confidence"))


def sections(found: DataFrame) -> DataFrame:
    """X-04, W-04 to W-06: one row per section; documents without a heading get one section named Document.

    The parent is the nearest section before it with a smaller level, unless a section in between closed that level.
    """
    order = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = found.drop("text").withColumn("n", F.sum(F.col("is_heading").cast("int")).over(order) - 1)
    numbered = written(numbered, "sections")  # used three times; each use would read the documents again
    heads = numbered.where("is_heading")
    before = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    candidates = [F.last(F.when(F.col("level") == k, F.col("n")), ignorenulls=True).over(before).alias(f"l{k}") for k in range(1, 7)]
    heads = heads.select("document_id", "n", "title", "kind", "level", "confidence", F.col("page").alias("page_start"), *candidates)
    # a level stays open until a section of a smaller level begins, so the last section of any smaller level is the parent
    nearest = F.greatest(F.lit(-1), *(F.when((F.col("level") > k), F.coalesce(F.col(f"l{k}"), F.lit(-1))).otherwise(-1) for k in range(1, 7)))
    name = lambda c: F.concat(F.lit("s"), F.lpad(c.cast("string"), 3, "0"))
    ends = numbered.where("NOT is_heading AND n >= 0").groupBy("document_id", "n").agg(F.max_by("page", "ord").alias("page_end"))
    out = heads.select("document_id", "n", name(F.col("n")).alias("section_id"), F.when(nearest >= 0, name(nearest)).alias("parent_id"), "title", "kind", "level", "confidence", "page_start").join(ends, ["document_id", "n"], "left")
    out = out.select("document_id", "section_id", "parent_id", "title", "kind", "level", "confidence", "page_start", F.coalesce("page_end", "page_start").alias("page_end"))
    bare = numbered.groupBy("document_id").agg(F.max("n").alias("n"), F.min_by("page", "ord").alias("page_start"), F.max_by("page", "ord").alias("page_end")).where("n < 0")
    return out.unionByName(bare.select("document_id", F.lit("s000").alias("section_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("Document").alias("title"), F.lit("other").alias("kind"), F.lit(1).alias("level"), F.lit(0.0).alias("confidence"), "page_start", "page_end"))


def paragraphs(found: DataFrame, least_chars: int = 1) -> DataFrame:
    """W-07: blocks between headings with their section and their place in it, without those that are too short."""
    order = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("is_heading").cast("int")).over(order) - 1
    whole = F.max(F.col("is_heading").cast("int")).over(Window.partitionBy("document_id"))
    placed = found.select("document_id", "ord", "page", "is_heading", collapse(F.col("text")).alias("text"), F.when(whole == 0, 0).otherwise(n).alias("n"))
    kept = placed.where((~F.col("is_heading")) & (F.col("n") >= 0) & (F.length("text") >= least_chars))
    index = F.row_number().over(Window.partitionBy("document_id", "n").orderBy("ord")) - 1
    return kept.select("document_id", F.concat(F.lit("s"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("section_id"), index.alias("paragraph_index"), "page", "text", "ord")


def captions(blocks: DataFrame, most_chars: int = 1200) -> DataFrame:
    """X-07, F-11: figure and table captions, numbered per document and type."""
    text = collapse(F.col("text"))

    def matched(pattern: str) -> Column:
        caption = F.trim(F.regexp_extract(text, pattern, 3))
        fits = (caption == "") | (F.substring(caption, 1, 1).rlike(r"[\p{Lu}\d]") & (F.length(caption) >= 3))
        return text.rlike(pattern) & fits

    figure = matched(FIGURE)
    kind = F.when(figure, "figure").when(matched(TABLE), "table")
    found = blocks.where((F.trim("text") != "") & (F.length("text") <= most_chars)).withColumn("type", kind).where("type IS NOT NULL")
    part = lambda g: F.when(F.col("type") == "figure", F.regexp_extract(text, FIGURE, g)).otherwise(F.regexp_extract(text, TABLE, g))
    n = F.row_number().over(Window.partitionBy("document_id", "type").orderBy("ord")) - 1
    return found.select("document_id", F.concat(F.substring("type", 1, 1), F.lpad(n.cast("string"), 3, "0")).alias("caption_id"), "type", F.concat(F.initcap("type"), F.lit(" "), part(2)).alias("label"), F.trim(part(3)).alias("caption"), "page")


def entries(texts: DataFrame) -> DataFrame:
    """W-08, X-05: bibliography entries of the reference sections: bracket markers anywhere, else numbered lines.

    Rows (document_id, ord, page, text) give (document_id, ord, pos, marker, raw).
    """
    bracketed = F.col("text").rlike(ENTRY)
    parts = F.split("text", ENTRY, -1)
    marks = F.regexp_extract_all("text", F.lit(ENTRY), F.lit(1))
    by_bracket = texts.where(bracketed).select("document_id", "ord", "page", F.posexplode(F.arrays_zip(F.slice(parts, 2, F.size(marks)).alias("raw"), marks.alias("marker"))).alias("pos", "e"))
    by_bracket = by_bracket.select("document_id", "ord", "page", "pos", F.col("e.marker").alias("marker"), collapse(F.col("e.raw")).alias("raw"))
    lines = texts.where(~bracketed).select("document_id", "ord", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("document_id", "ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("line").rlike(NUMBERED_LINE)
    grouped = lines.withColumn("pos", F.greatest(F.sum(starts.cast("int")).over(w) - 1 + F.max(F.when((F.col("line_no") == 0) & ~starts, 1).otherwise(0)).over(w), F.lit(0)))
    joined = grouped.groupBy("document_id", "ord", "page", "pos").agg(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("line", NUMBERED_LINE, "").alias("t"), F.nullif(F.regexp_extract("line", NUMBERED_LINE, 1), F.lit("")).alias("marker")))).alias("l"))
    by_line = joined.select("document_id", "ord", "page", "pos", F.element_at("l", 1).marker.alias("marker"), collapse(F.array_join(F.transform("l", lambda x: x.t), " ")).alias("raw"))
    return by_bracket.unionByName(by_line).where(F.length("raw").between(20, 2000))


def parse_entry(raw: Column) -> Column:
    """X-05: what an entry says; absent parts are null."""
    some = lambda c: F.when(c != "", c)
    bare = lambda p: some(F.regexp_replace(F.regexp_extract(raw, p, 0), r"[.,;]+$", ""))
    rest = F.regexp_replace(raw, AUTHORS, "")
    second = F.regexp_replace(F.get(F.split(rest, r"\.\s+(?=[A-Z])|\.\s*In\s+|\.\s*arXiv", 2), 0), r"^[ .,]+|[ .,]+$", "")
    title = F.coalesce(some(F.trim(F.regexp_extract(raw, QUOTED_TITLE, 1))), F.when((rest != raw) & F.length(second).between(10, 300), second))
    names = F.transform(F.split(F.regexp_extract(raw, AUTHORS, 1), r",\s*(?:and\s+)?|\s+and\s+"), collapse)
    authors = F.slice(F.filter(names, lambda n: F.length(n).between(3, 60) & n.rlike(r"\p{L}")), 1, 20)
    return F.struct(some(F.regexp_extract(raw, YEAR, 1)).cast("int").alias("year"), bare(DOI).alias("doi"), some(F.regexp_extract(raw, ARXIV, 1)).alias("arxiv_id"), bare(URL).alias("url"), title.alias("title"), authors.alias("authors"))


def citations(texts: DataFrame) -> DataFrame:
    """X-06: every number printed in a citation marker (ranges are not filled in): (document_id, section_id, paragraph_index, pos, marker)."""
    found = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(CITATION), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(r"\d{1,3}"), F.lit(0))))
    return texts.select("document_id", "section_id", "paragraph_index", F.posexplode(found).alias("pos", "marker"))


def last_references(references: DataFrame) -> DataFrame:
    """J-10: of a document's references with one marker the last counts."""
    return references.where("marker IS NOT NULL").groupBy("document_id", "marker").agg(F.max_by("ref_id", "ord").alias("ref_id"))


def resolve_citations(found: DataFrame, references: DataFrame) -> DataFrame:
    """J-10: markers to references."""
    return found.join(last_references(references), ["document_id", "marker"], "left")


def self_metadata(blocks: DataFrame) -> DataFrame:
    """X-08: title (largest type among the first 12 blocks of page 1, unless hardly larger than the body), identifiers and year of a document's own text."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("ord"))
    front = blocks.where("page = 1").withColumn("place", place).where("place <= 40")
    top = front.where("place <= 12").groupBy("document_id").agg(F.max_by(F.struct("text", "size"), F.struct("size", -F.col("place"))).alias("t")).join(body_size(blocks), "document_id")
    text = front.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text), "\n").alias("front"))
    some = lambda c: F.when(c != "", c)
    abstract = some(collapse(F.regexp_extract("front", r"(?is)\babstract\b[\s:.—-]*(.{60,}?)(?:\n|$)", 1)))
    return top.join(text, "document_id").select("document_id", F.when(F.col("t.size") > 1.05 * F.col("body_size"), collapse(F.col("t.text"))).alias("title"), abstract.alias("abstract"), some(F.regexp_extract("front", DOI, 0)).alias("doi"), some(F.regexp_extract("front", ARXIV, 1)).alias("arxiv_id"), some(F.regexp_extract("front", YEAR, 1)).cast("int").alias("year"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """HTML pages as blocks: titles and headings are large, paragraphs and list items are body, navigation and footers small."""
    body = F.regexp_replace("html", r"(?is)<(style|script)[^>]*>.*?</\1>", " ")
    parts = F.filter(F.split(body, r"(?i)(?=<(?:title|h[1-6]|p|li|footer|article|div)[ >])"), lambda p: p.rlike(r"(?i)^<(title|h[1-6]|p|li|footer|article|div)[ >]"))
    # text and tag are made before the rows are: a condition on a column of rows would make them a second time
    text = lambda p: collapse(F.regexp_replace(F.regexp_replace(p, "<[^>]+>", " "), r"&\w+;|&#\d+;", " "))
    read = F.transform(parts, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^<(\w+)", 1)).alias("tag"), text(p).alias("text")))
    raw = pages.select(F.col("page_id").cast("string").alias("document_id"), F.posexplode(read).alias("ord", "part")).where("part.text <> ''")
    tag = F.col("part.tag")
    return raw.select("document_id", "ord", F.lit(1).alias("page"), F.col("part.text").alias("text"), F.when(tag == "title", 20.0).when(tag.startswith("h"), 14.0).when(tag == "footer", 8.0).otherwise(10.0).alias("size"), tag.startswith("h").alias("bold"))


def document_statistics(blocks: DataFrame, paras: DataFrame, cites: DataFrame) -> DataFrame:
    """A-17: counts per document."""
    b = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("page").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))
    p = paras.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.countDistinct("section_id").alias("n_sections"), F.sum(word_count(F.col("text"))).alias("n_words"))
    c = cites.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_citations"))
    return b.join(p, "document_id", "left").join(c, "document_id", "left").na.fill(0)

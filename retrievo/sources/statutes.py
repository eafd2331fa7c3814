"""Statutes and case files in their source formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrievo.functions.text import hierarchy_title

STATUTE = "buku_label STRING, buku_judul STRING, bab_label STRING, bab_judul STRING, bagian_label STRING, bagian_judul STRING, pasal_nomor STRING, pasal_text STRING"


def read_statutes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, text and hierarchy of a statute table."""
    rows = spark.read.csv(path, header=True, schema=STATUTE, multiLine=True, escape='"')
    number = F.trim("pasal_nomor")
    labels = [F.col(c) for c in ("buku_label", "buku_judul", "bab_label", "bab_judul", "bagian_label", "bagian_judul")]
    return rows.select(number.alias("doc_id"), F.concat(F.lit("Pasal "), number).alias("title"), F.concat(F.lit("Pasal "), number, F.lit(": "), F.trim("pasal_text")).alias("text"), hierarchy_title(*labels, number).alias("path"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, text, laws of a nested JSON file; cases without incidents or laws are dropped."""
    raw = spark.read.text(path, wholetext=True)
    cases = raw.select(F.explode(F.from_json("value", "map<string, struct<incidents: array<string>, relevant_laws: array<string>>>")).alias("case_id", "c"))
    return cases.filter((F.size("c.incidents") > 0) & (F.size("c.relevant_laws") > 0)).select("case_id", F.array_join("c.incidents", ". ").alias("text"), F.col("c.relevant_laws").alias("laws"))


SUMMARY = "struct<text: string, relevant_laws: array<string>>"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """filename, variant, text, laws: two queries per record; failed records and empty texts are skipped."""
    rows = spark.read.schema(f"filename STRING, humanized_query {SUMMARY}, summarized_case {SUMMARY}, error STRING").json(path)
    rows = rows.filter(F.col("error").isNull() | (F.col("error") == "json_parse_failed"))
    both = F.explode(F.array(F.struct(F.lit("humanized").alias("variant"), F.col("humanized_query").alias("q")), F.struct(F.lit("summarized").alias("variant"), F.col("summarized_case").alias("q"))))
    return rows.select("filename", both.alias("v")).select("filename", "v.variant", F.col("v.q.text").alias("text"), F.col("v.q.relevant_laws").alias("laws")).filter(F.length(F.trim("text")) > 0)


def read_pairs(spark: SparkSession, path: str, test_years: list[str]) -> DataFrame:
    """id, label, t1, t2, year, split of XML pairs; the year is that of the file's name."""
    rows = spark.read.format("xml").option("rowTag", "pair").load(path)
    year = F.regexp_extract(F.input_file_name(), r"([A-Z]?\d{2,4})[^/]*\.xml$", 1)
    rows = rows.select(F.col("_id").alias("id"), F.col("_label").alias("label"), F.col("t1").cast("string").alias("t1"), F.col("t2").cast("string").alias("t2"), year.alias("year"))
    return rows.withColumn("split", F.when(F.col("year").isin(test_years), "test").otherwise("train"))


# The levels of the hierarchy, outermost first.
LEVELS = ["Part", "Chapter", "Section", "Subsection", "Division"]


def hierarchy(lines: DataFrame, file: str = "file", number: str = "n") -> DataFrame:
    """Lines (file, n, value) with the headings above them: each level lasts until it or one above it changes.

    One ordered pass per file; a heading resets the levels below it, as these restart at its line.
    """
    order = Window.partitionBy(file).orderBy(number)
    out = lines
    for i, level in enumerate(LEVELS):
        own = F.when(F.col("value").startswith(f"{level} "), F.regexp_replace(F.trim("value"), r"^\S+\s+\S+\s*", ""))
        above = [F.col("value").startswith(f"{x} ") for x in LEVELS[:i]]
        reset = F.lit(False)
        for a in above:
            reset = reset | a
        mark = F.when(own.isNotNull(), F.struct(F.lit(True).alias("on"), own.alias("v"))).when(reset, F.struct(F.lit(False).alias("on"), F.lit(None).cast("string").alias("v")))
        out = out.withColumn(level.lower(), F.last(mark, ignorenulls=True).over(order)["v"])
    return out


def articles(lines: DataFrame, file: str = "file", number: str = "n") -> DataFrame:
    """article_no, title, text and hierarchy: an article is "<ARTICLE>", a title line, then lines up to a blank one."""
    order = Window.partitionBy(file).orderBy(number)
    value = F.trim("value")
    rows = hierarchy(lines, file, number).withColumn("value", value)
    rows = rows.withColumn("starts", F.sum((F.col("value") == "<ARTICLE>").cast("int")).over(order))
    inside = Window.partitionBy(file, "starts").orderBy(number)
    rows = rows.filter("starts > 0").withColumn("at", F.row_number().over(inside))
    body = rows.withColumn("blank", F.max(((F.col("at") > 2) & (F.col("value") == "")).cast("int")).over(inside)).filter("blank = 0")
    grouped = body.groupBy(file, "starts").agg(
        F.max(F.when(F.col("at") == 2, F.col("value"))).alias("raw"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("at") > 2, F.struct("at", "value")))), lambda x: x["value"]), " ").alias("text"),
        *[F.max(F.when(F.col("at") == 1, F.col(x.lower()))).alias(x.lower()) for x in LEVELS],
    )
    title = F.regexp_replace("raw", r"^\(|\)$", "")
    no = F.regexp_extract("text", r"^Article\s+(\d+(?:-\d+)*)", 1)
    return grouped.filter(no != "").select(no.alias("article_no"), F.when(F.lower(title) == "none", "").otherwise(title).alias("title"), "text", *[x.lower() for x in LEVELS])


def code_articles(lines: DataFrame, file: str = "file", number: str = "n") -> DataFrame:
    """Articles of a code's text: BUKU, BAB, BAGIAN and Pasal headings; hyphenated line ends are joined.

    The first occurrence of an article number wins.
    """
    order = Window.partitionBy(file).orderBy(number)
    value = F.trim("value")
    heads = {"buku": r"^BUKU\s+(.+)$", "bab": r"^BAB\s+(.+)$", "bagian": r"^(?i:BAGIAN)\s+(.+)$", "pasal": r"^Pasal\s+(\d+[a-z]?)\.?$"}
    rows = lines.withColumn("value", value)
    reset = F.lit(False)
    for name, pattern in heads.items():
        own = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1))
        mark = F.when(own.isNotNull(), F.struct(own.alias("v"))).when(reset, F.struct(F.lit(None).cast("string").alias("v")))
        rows = rows.withColumn(name, F.last(mark, ignorenulls=True).over(order)["v"])
        reset = reset | own.isNotNull()
    heading = F.lit(False)
    for pattern in heads.values():
        heading = heading | F.col("value").rlike(pattern)
    body = rows.filter(F.col("pasal").isNotNull() & ~heading & (F.col("value") != ""))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(number), F.col("value")))), lambda x: x["value"]), " ")
    found = body.groupBy(file, "buku", "bab", "bagian", "pasal").agg(F.regexp_replace(text, r"(\p{L})- (\p{Ll})", "$1$2").alias("text"), F.min(number).alias("first"))
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("pasal").orderBy(file, "first"))).filter("_n = 1").drop("_n", "first")


def judgements_of(queries: DataFrame, corpus: DataFrame, ids: str = "article_ids") -> tuple[DataFrame, DataFrame]:
    """Judgements of queries whose ids are a comma list, and how many ids the corpus lacks."""
    rows = queries.select("query_id", F.explode(F.split(F.col(ids).cast("string"), r"\s*,\s*")).alias("doc_id")).filter("doc_id <> ''").distinct()
    known = rows.join(corpus.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", F.lit(1).alias("score"))
    return known, rows.join(corpus.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))

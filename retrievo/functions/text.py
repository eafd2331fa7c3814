"""Text functions as Column expressions: everything here stays in generated code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two or more letters, digits or underscores; the class form means the same in all engines.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of exactly n tokens; pass a column, not an expression, as it is used for every run."""
    if n == 1:
        return words
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def without(words: Column, stop: list[str]) -> Column:
    """Tokens that aren't stop words, in order, repeats kept."""
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def stemmed(words: Column, stemmer) -> Column:
    """Tokens through ``stemmer(str) -> str`` in Arrow batches (no stemmer ships with Spark)."""
    @F.pandas_udf("array<string>")
    def stem(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ws: [stemmer(w) for w in ws])

    return stem(words)


def character_bigrams(text: Column) -> Column:
    """Stand-in for word segmentation of Han text: overlapping pairs of characters."""
    return F.regexp_extract_all(F.regexp_replace(text, r"(\p{IsHan})(?=(\p{IsHan}))", "$1$2 "), F.lit(r"\p{IsHan}{2}|[\p{L}\p{N}&&[^\p{IsHan}]]{2,}"), F.lit(0))


def sentences(text: Column, lang: Column) -> Column:
    """Trimmed sentences of over 10 characters, or the whole text."""
    parts = F.when(lang == "zh", F.split(text, r"[。！？\n]+")).otherwise(F.split(text, r"(?<=[.!?;])\s+|\n+"))
    long = F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 10)
    return F.when(F.size(long) > 0, long).otherwise(F.array(F.trim(text)))


def normalised(text: Column) -> Column:
    """Lower case letters and digits only, for containment tests."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def chunks(text: Column, size: int, step: int) -> Column:
    """Overlapping windows of words: array<struct<start, words, text>>; pass a column."""
    words = F.split(text, r"\s+")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, size).alias("words")))


# The code's names, and laws whose articles stay.
CODE = r"(?:KUHPerdata|KUH\s*Perdata|Kitab\s+Undang-Undang\s+Hukum\s+Perdata)"
OTHER_LAWS = r"\s+(?:RBg|HIR|KUHP|KUHAP|UU|UUD|PP|Perpres|Perma|KUHPidana|KUHDagang)\b"
ARTICLES = r"Pasal\s+\d++[a-zA-Z]?+(?:\s*(?:,|dan\s+Pasal|dan)\s+\d++[a-zA-Z]?+)*+"


def without_references(text: Column) -> Column:
    """Mentions of the code and its articles go; articles of other laws stay."""
    out = F.regexp_replace(text, rf"(?iU){ARTICLES}\s+{CODE}", "")
    out = F.regexp_replace(out, rf"(?iU){CODE}", "")
    out = F.regexp_replace(out, rf"(?iU){ARTICLES}(?!{OTHER_LAWS})", "")
    out = F.regexp_replace(out, r"\(\s*\)", "")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def code_article(law: Column) -> Column:
    """The article number if the law is the code, else null."""
    number = F.regexp_extract(law, r"(?i)Pasal\s+(\d+[a-zA-Z]?)", 1)
    return F.when(law.rlike(rf"(?i){CODE}"), F.when(number != "", number))


def cited_articles(text: Column) -> Column:
    """Distinct "Pasal n KUHPerdata" in chains that end with the code, by number."""
    chain = rf"(?i)Pasal\s+\d+[a-zA-Z]?(?:\s*(?:,|dan\s+Pasal|dan|jo\.?\s*Pasal)\s+\d+[a-zA-Z]?)*\s+{CODE}"
    spans = F.regexp_extract_all(text, F.lit(chain), F.lit(0))
    numbers = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(r"(?i)Pasal\s+(\d+[a-zA-Z]?)"), F.lit(1)))))
    keyed = F.array_sort(F.transform(numbers, lambda n: F.struct(F.regexp_extract(n, r"\d+", 0).cast("int").alias("k"), n.alias("n"))))
    return F.transform(keyed, lambda x: F.concat(F.lit("Pasal "), x["n"], F.lit(" KUHPerdata")))


def act_name(title: Column, dataset: str) -> Column:
    """The legal instrument that a statute's title names."""
    if dataset.startswith("kuhperdata"):
        chapter, book = F.regexp_extract(title, r"(Bab\s+\S+)", 1), F.regexp_extract(title, r"^(Buku\s+\S+)", 1)
        return F.when(chapter != "", F.trim(F.concat_ws(" ", book, chapter))).otherwise("KUHPerdata")
    pattern = {"bsard": r",\s*(.+?)\s*\(", "stard": r"^(.+?)第", "ilpcsr": r"of (.+?)(?:,\s*\d|$)"}.get(dataset)
    if pattern is None:
        return F.lit("unknown")
    found = F.trim(F.regexp_extract(title, pattern, 1))
    return F.when(found != "", found).otherwise("unknown")


def number_prefix(name: Column, missing: int = 0) -> Column:
    """The leading digits of an id such as 319a."""
    return F.coalesce(F.regexp_extract(name, r"^(\d+)", 1).try_cast("int"), F.lit(missing))


def judgements(response: Column, strict: bool = True) -> Column:
    """array<struct<idx, relevant>> of lines "[n] ... RELEVAN"; ``strict`` asks for the whole word."""
    lines = F.filter(F.transform(F.split(response, "\n"), lambda s: F.trim(s)), lambda s: s.rlike(r"^\[\d+\]"))
    word = r"(?<![\w])RELEVAN(?![\w])" if strict else "RELEVAN"
    return F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^\[(\d+)\]", 1).cast("int").alias("idx"), (s.rlike(word) & ~s.contains("TIDAK_RELEVAN")).alias("relevant")))


def verdict(response: Column) -> Column:
    return F.regexp_extract(response, r"verdict:\s*(RELEVAN|TIDAK_RELEVAN)", 1) == "RELEVAN"


def verdict_binary(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v == "RELEVAN", 1).when(v == "TIDAK_RELEVAN", 0)


def json_object(raw: Column) -> Column:
    """The outermost JSON object of a model's answer, code fences removed."""
    found = F.regexp_extract(F.regexp_replace(raw, r"(?s)^\s*```[^\n]*\n|```\s*$", ""), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def hierarchy_title(book: Column, book_title: Column, chapter: Column, chapter_title: Column, part: Column, part_title: Column, article: Column) -> Column:
    """"Buku .. , Bab .., Bagian .., Pasal n" from the labels that are there."""
    t = lambda c: F.initcap(F.trim(F.coalesce(c, F.lit(""))))
    p = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.concat_ws(
        ", ",
        F.when(t(book) != "", F.trim(F.concat_ws(" ", F.lit("Buku"), t(book), t(book_title)))),
        F.when(p(chapter) != "", F.trim(F.concat_ws(" ", F.lit("Bab"), p(chapter), t(chapter_title)))),
        F.when((p(part) != "") & (t(part_title) != ""), F.concat_ws(" ", F.lit("Bagian"), p(part), t(part_title))),
        F.concat(F.lit("Pasal "), p(article)),
    )


def frames(text: Column) -> Column:
    """Names declared in "L2 FRAME:" lines."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^L2 FRAME:\s*(.+)$"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda s: F.regexp_replace(F.trim(s), r"[.,:;]+$", "")), lambda s: s != ""))


def references(text: Column) -> Column:
    """array<struct<doc_id, justification>> of the document tags of an answer."""
    whole = F.regexp_extract_all(text, F.lit(r"""(?s)<Document\s+id=["']?[^"'>\s]+["']?\s*><Justification>.*?</Justification></Document>"""), F.lit(0))
    return F.transform(whole, lambda s: F.struct(F.regexp_extract(s, r"""id=["']?([^"'>\s]+)""", 1).alias("doc_id"), F.trim(F.regexp_extract(s, r"(?s)<Justification>(.*?)</Justification>", 1)).alias("justification")))


def pruned(content: Column, role: Column, doc_id: str) -> Column:
    """Tool and user messages with the document's chunk replaced by a marker."""
    import re

    marker = f"[{doc_id}] [PRUNED] "
    return F.when(role.isin("tool", "user"), F.regexp_replace(content, re.escape(f"[{doc_id}]") + r"[^\[]*", marker.replace("$", r"\$"))).otherwise(content)


def safe_filename(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, r"[/\\]", "_"), r'[<>:"|?*]', "")
    out = F.regexp_replace(F.regexp_replace(out, r"[\s_]+", "_"), "^_+|_+$", "")
    return F.when(out.endswith(".pdf"), out).otherwise(F.concat(out, F.lit(".pdf")))

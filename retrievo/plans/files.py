"""Queries that write the formats of the sources, read them back and compare; and text functions on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from retrievo.functions import text as tx
from retrievo.functions import vectors as v
from retrievo.operators import agentlog, dense, judgements, lexical, metrics, sampling
from retrievo.plans.common import QRELS, TOKENS, corpus, items, qrels, run, table, with_run
from retrievo.sources import beir, statutes
from retrievo.sources.scratch import folder

QUERIES: dict = {}


def query(name: str, ops: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql, ops)
        return fn

    return add


def place(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("dataset_round_trip", "S1 S2 S3 K1 K2", f"""WITH {QRELS} SELECT 'corpus' AS kind, CAST(doc_id AS VARCHAR) AS id, length(text) AS n, source AS more FROM documents
UNION ALL SELECT 'query', CAST(item_id AS VARCHAR), length(text), NULL FROM benchmark
UNION ALL SELECT 'judgement', query_id || ' ' || doc_id, score, CASE WHEN query_id % 3 = 0 THEN 'test' ELSE 'train' END FROM qrels""")
def dataset_round_trip(spark, d):
    top, split = place(spark, "dataset"), F.when(F.col("query_id") % 3 == 0, "test").otherwise("train").alias("split")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string"), F.col("source").alias("title"), "text")
    beir.write_dataset(top, docs, items(spark, d).select(F.col("query_id").cast("string"), "text"), qrels(spark, d).select("query_id", "doc_id", "score", split))
    none = F.lit(None).cast("string").alias("more")
    title = F.when(F.col("title") != "", F.col("title")).alias("more")
    out = beir.read_corpus(spark, f"{top}/corpus.jsonl").select(F.lit("corpus").alias("kind"), F.col("doc_id").alias("id"), F.length("text").alias("n"), title)
    out = out.unionByName(beir.read_queries(spark, f"{top}/queries.jsonl").select(F.lit("query").alias("kind"), F.col("query_id").alias("id"), F.length("text").alias("n"), none))
    for name in ("train", "test"):
        judged = beir.read_qrels(spark, f"{top}/qrels_{name}.tsv")
        out = out.unionByName(judged.select(F.lit("judgement").alias("kind"), F.concat_ws(" ", "query_id", "doc_id").alias("id"), F.col("score").alias("n"), F.lit(name).alias("more")))
    return out


@query("trec_round_trip", "K4", with_run("SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, rank, score FROM run WHERE rank <= 20"))
def trec_round_trip(spark, d):
    path = place(spark, "run")
    beir.trec_run(run(spark, d, 20), "bm25").write.text(path)
    return beir.read_trec(spark, path)


@query("prediction_round_trip", "K3 S15 S16", with_run("""SELECT CAST(query_id AS VARCHAR) AS qid, 'bm25' AS method, CAST(coalesce(n, 0) AS INTEGER) AS ranked, CAST(rel AS INTEGER) AS relevant, 'predictions' AS layout
FROM (SELECT query_id, count(*) AS rel FROM qrels GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n FROM run GROUP BY 1) USING (query_id)"""))
def prediction_round_trip(spark, d):
    path, judged, ranked = place(spark, "predictions"), qrels(spark, d), run(spark, d, 100)
    beir.prediction_records(ranked, judged, metrics.per_query(ranked, judged).filter("k = 10"), "bm25", "documents").write.json(path)
    return beir.read_predictions(spark, path).select("qid", "method", F.size("ranked").alias("ranked"), F.size("relevant").alias("relevant"), "layout")


@query("page_files", "K6", with_run("SELECT query_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM run JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1"))
def page_files(spark, d):
    path = place(spark, "pages")
    beir.write_pages(run(spark, d, 3), corpus(spark, d), path)
    read = spark.read.schema("doc_id LONG, rank INT, score DOUBLE, text STRING, query_id LONG").json(path)
    return read.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("qrels_headers", "S5", f"WITH {QRELS} SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, query_id % 3 AS score FROM qrels")
def qrels_headers(spark, d):
    """Judgements under other column names, zero grades kept."""
    path = place(spark, "qrels")
    graded = qrels(spark, d).select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), (F.col("query_id") % 3).alias("score"))
    graded.write.csv(path, sep="\t", header=True)
    return beir.read_qrels(spark, path)


@query("statute_files", "S6 C10", """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'Pasal ' || p_partkey AS title, 'Pasal ' || p_partkey || ': ' || trim(p_name) AS text,
  'Buku Satu Umum, Bab ' || p_size || ' Barang, Pasal ' || p_partkey AS path FROM part""")
def statute_files(spark, d):
    path = place(spark, "statutes")
    lit = lambda x, name: F.lit(x).alias(name)
    rows = table(spark, d, "part").select(
        lit("satu", "buku_label"), lit("umum", "buku_judul"), F.col("p_size").cast("string").alias("bab_label"), lit("barang", "bab_judul"), lit("", "bagian_label"), lit("", "bagian_judul"),
        F.concat(F.lit(" "), F.col("p_partkey")).alias("pasal_nomor"), F.concat(F.col("p_name"), F.lit("  ")).alias("pasal_text"),
    )
    rows.write.csv(path, header=True, escape='"')
    return statutes.read_statutes(spark, path)


@query("summary_files", "S8", """SELECT CAST(item_id AS VARCHAR) AS filename, variant, CASE variant WHEN 'humanized' THEN text ELSE substr(text, 1, 40) END AS text, ['Pasal ' || item_id] AS laws
FROM benchmark, (SELECT unnest(['humanized', 'summarized']) AS variant) WHERE item_id % 7 <> 0 AND NOT (variant = 'summarized' AND item_id % 5 = 0)""")
def summary_files(spark, d):
    path = place(spark, "summaries")
    laws = F.array(F.concat(F.lit("Pasal "), F.col("query_id"))).alias("relevant_laws")
    short = F.when(F.col("query_id") % 5 == 0, "  ").otherwise(F.substring("text", 1, 40))
    error = F.when(F.col("query_id") % 7 == 0, "timeout").when(F.col("query_id") % 7 == 1, "json_parse_failed")
    rows = items(spark, d).select(
        F.col("query_id").cast("string").alias("filename"), F.struct("text", laws).alias("humanized_query"), F.struct(short.alias("text"), laws).alias("summarized_case"), error.alias("error"),
    )
    rows.write.json(path)
    return statutes.read_summaries(spark, path)


@query("embedding_shards", "S17 S18", "SELECT 'v' || vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x, len(embedding) AS dim FROM embeddings")
def embedding_shards(spark, d):
    rows, top = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "embedding"), place(spark, "shards")
    rows.withColumn("shard", F.pmod("idx", F.lit(4))).write.partitionBy("shard").parquet(f"{top}/all")
    lookup = beir.cached(top, "lookup", lambda: rows.select("idx", F.concat(F.lit("v"), F.col("idx")).alias("id")), spark)
    found = beir.embeddings(spark, [f"{top}/all/shard={i}" for i in range(4)], beir.cached(top, "lookup", lambda: lookup, spark))
    return found.select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"), F.size("embedding").alias("dim"))


@query("case_split", "T4", "SELECT conv_id AS case_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'test' WHEN conv_id % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM conversations")
def case_split(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), "turn")
    split = F.when(F.col("case_id") % 5 == 0, "test").when(F.col("case_id") % 5 == 1, "val").otherwise("train")
    return sampling.case_split(turns, turns.select("case_id").distinct().withColumn("split", split)).select("case_id", "turn", "split")


@query("number_prefixes", "C16", "SELECT CAST(coalesce(TRY_CAST(nullif(regexp_extract(o_orderpriority, '^([0-9]+)', 1), '') AS INTEGER), -1) AS INTEGER) AS number, count(*) AS n FROM orders GROUP BY 1")
def number_prefixes(spark, d):
    return table(spark, d, "orders").groupBy(tx.number_prefix(F.col("o_orderpriority"), -1).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("act_names", "C5", "SELECT p_partkey, p_name AS act, 'unknown' AS other, 'Buku I Bab ' || p_size AS book FROM part")
def act_names(spark, d):
    title = F.concat(F.lit("Art. "), F.col("p_partkey"), F.lit(", "), F.col("p_name"), F.lit(" (livre 2)"))
    chapter = F.concat(F.lit("Buku I Umum, Bab "), F.col("p_size"), F.lit(" Barang"))
    return table(spark, d, "part").select("p_partkey", tx.act_name(title, "bsard").alias("act"), tx.act_name(F.col("p_name"), "bsard").alias("other"), tx.act_name(chapter, "kuhperdata").alias("book"))


@query("cited_articles", "C1 C2 C3", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS number, CASE WHEN p_size < p_partkey THEN ['Pasal ' || p_size || ' KUHPerdata', 'Pasal ' || p_partkey || ' KUHPerdata'] WHEN p_size = p_partkey THEN ['Pasal ' || p_size || ' KUHPerdata'] ELSE ['Pasal ' || p_partkey || ' KUHPerdata', 'Pasal ' || p_size || ' KUHPerdata'] END AS cited, p_name || ' menurut' AS rest FROM part")
def cited_articles(spark, d):
    said = F.concat(F.col("p_name"), F.lit(" menurut Pasal "), F.col("p_partkey"), F.lit(" dan Pasal "), F.col("p_size"), F.lit(" KUHPerdata"))
    law = F.concat(F.lit("Pasal "), F.col("p_size"), F.lit(" KUHPerdata"))
    return table(spark, d, "part").select("p_partkey", tx.code_article(law).alias("number"), tx.cited_articles(said).alias("cited"), tx.without_references(said).alias("rest"))


@query("verdict_lines", "C6 C7", "SELECT doc_id, coalesce(toxic = 1, false) AS first, coalesce(quality = 1, false) AS second, CASE toxic WHEN 1 THEN 1 ELSE 0 END AS binary FROM labels")
def verdict_lines(spark, d):
    word = lambda c: F.when(F.col(c) == 1, "RELEVAN").otherwise("TIDAK_RELEVAN")
    answer = F.concat(F.lit("alasan\n[1] dokumen "), word("toxic"), F.lit("\n [2] "), word("quality"), F.lit("\nselesai"))
    rows = table(spark, d, "labels").select("doc_id", tx.judgements(answer).alias("j"), tx.verdict_binary(F.concat(F.lit(" "), word("toxic"))).alias("binary"))
    return rows.select("doc_id", F.col("j")[0]["relevant"].alias("first"), F.col("j")[1]["relevant"].alias("second"), "binary")


@query("repaired_json", "C8", "SELECT event_id, props AS json FROM events")
def repaired_json(spark, d):
    answer = F.concat(F.lit("```json\nanswer: "), F.col("props"), F.lit(" thanks\n```"))
    return table(spark, d, "events").select("event_id", tx.json_object(answer).alias("json"))


@query("answer_tags", "C11", "SELECT item_id AS query_id, ['d' || item_id, 'e' || item_id] AS ids, ['Frame ' || item_id] AS frames FROM benchmark")
def answer_tags(spark, d):
    tag = lambda p, why: F.concat(F.lit('<Document id="'), F.lit(p), F.col("query_id"), F.lit(f'"><Justification> {why}\n</Justification></Document>'))
    answer = F.concat(F.lit("L2 FRAME: Frame "), F.col("query_id"), F.lit(".\n"), tag("d", "a"), F.lit("\ntext "), tag("e", "b"), F.lit("\nL2 FRAME: Frame "), F.col("query_id"), F.lit(":"))
    return items(spark, d).select("query_id", F.transform(tx.references(answer), lambda r: r["doc_id"]).alias("ids"), F.transform(tx.frames(answer), lambda f: F.trim(f)).alias("frames"))


@query("coverage_gate", "C17", "SELECT conv_id AS query_id, count(*) >= 2 AND bool_and(n > 0) AS complete FROM (SELECT conv_id, role, count(*) FILTER (length(text) > 60) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1")
def coverage_gate(spark, d):
    frames = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id"), F.col("role").alias("frame")).agg(F.count_if(F.length("text") > 60).alias("n_docs"))
    return agentlog.coverage(frames)


@query("worst_queries", "O2 F4", with_run("""SELECT query_id, fn FROM (SELECT query_id, count(*) FILTER (hit AND NOT coalesce(rank <= 10, false)) AS fn FROM (
  SELECT coalesce(r.query_id, q.query_id) AS query_id, rank, q.score IS NOT NULL AS hit FROM run r FULL JOIN qrels q USING (query_id, doc_id)) GROUP BY 1) ORDER BY fn DESC, query_id LIMIT 20"""))
def worst_queries(spark, d):
    return metrics.worst(metrics.classes(run(spark, d), qrels(spark, d))).select("query_id", "fn")


@query("counter_delta", "O3", r"""WITH w AS (SELECT role, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM conversations),
c AS (SELECT word, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'assistant') AS b FROM w WHERE role IN ('user', 'assistant') GROUP BY word)
SELECT word, a, b, a - b AS delta FROM c ORDER BY abs(a - b) DESC, a - b DESC, word LIMIT 25""")
def counter_delta(spark, d):
    words = table(spark, d, "conversations").select("role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return agentlog.counter_delta(words.filter("role = 'user'"), words.filter("role = 'assistant'"), "word")


@query("browsed_queries", "F10", with_run("""SELECT item_id AS query_id, substr(text, 1, 80) AS preview, best, worst FROM benchmark LEFT JOIN (SELECT query_id, min(rank) AS best, max(rank) AS worst FROM run SEMI JOIN qrels USING (query_id, doc_id) GROUP BY 1) ON query_id = item_id
WHERE contains(lower(substr(text, 1, 80)), 'the') OR contains(CAST(item_id AS VARCHAR), 'the') ORDER BY best NULLS LAST, item_id LIMIT 50"""))
def browsed_queries(spark, d):
    return metrics.browsed(items(spark, d), run(spark, d), qrels(spark, d), "The")


@query("cleaning_reasons", "F3", f"""WITH {QRELS}, k AS (SELECT query_id, count(d.doc_id) AS n FROM qrels LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d USING (doc_id) GROUP BY 1)
SELECT count(*) FILTER (n = 0) AS emptied, count(*) FILTER (n > 5) AS too_many, count(*) FILTER (n BETWEEN 1 AND 5) AS kept FROM k""")
def cleaning_reasons(spark, d):
    return judgements.cleaned(qrels(spark, d), table(spark, d, "documents").filter("lang = 'en'"), 5)[1]


@query("grep_titles", "F5", "SELECT doc_id, substr(text, 1, 100) AS preview FROM documents WHERE regexp_matches(concat_ws(' ', source, text), '(?i)src1 .*the') ORDER BY doc_id LIMIT 25")
def grep_titles(spark, d):
    return judgements.grep(table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text"), "src1 .*the", 25, 100)


@query("bm25_whitespace", "L12", f"WITH {TOKENS.replace('[\\p{L}\\p{N}_]{2,}', '[^ \\t\\n\\x0B\\f\\r]+')} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM run WHERE rank <= 10")
def bm25_whitespace(spark, d):
    ranked = lexical.bm25(corpus(spark, d), items(spark, d), 10, params=lexical.Bm25(pattern=r"[^ \t\n\x0B\f\r]+"))
    return ranked.withColumn("score", F.round("score", 6))


@query("hash_vectors", "V15", """WITH u AS (SELECT n_name, i, (CAST('0x' || substr(sha256('42:' || n_name || ':' || i || '/0'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / pow(16, 12) AS a, (CAST('0x' || substr(sha256('42:' || n_name || ':' || i || '/1'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / pow(16, 12) AS b FROM nation, (SELECT unnest(range(8)) AS i)),
g AS (SELECT n_name, i, sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS x FROM u)
SELECT n_name, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY n_name)), 6) AS x FROM g""")
def hash_vectors(spark, d):
    rows = table(spark, d, "nation").select("n_name", F.posexplode(v.hash_vector(F.col("n_name"), 8)).alias("i", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query("message_passing", "V19", """WITH e AS (SELECT vec_id AS src, vec_id - vec_id % 10 AS dst, embedding[1]::DOUBLE AS score, embedding FROM embeddings WHERE vec_id % 10 <> 0),
w AS (SELECT dst, exp(score) / sum(exp(score)) OVER (PARTITION BY dst) AS w, embedding FROM e),
m AS (SELECT dst, i, sum(w * x) AS m FROM (SELECT dst, w, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM w) GROUP BY ALL),
n AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 10 = 0)
SELECT vec_id AS id, CAST(n.i AS INTEGER) AS i, round(n.x + coalesce(m, 0), 6) AS x FROM n LEFT JOIN m ON dst = vec_id AND m.i = n.i""")
def message_passing(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    edges = rows.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("src"), (F.col("vec_id") - F.col("vec_id") % 10).alias("dst"), F.col("x")[0].alias("score"))
    out = dense.attention(rows.select(F.col("vec_id").alias("id"), "x"), edges).filter("id % 10 = 0")
    return out.select("id", F.posexplode("x").alias("i", "x")).withColumn("x", F.round("x", 6))

"""Queries over documents and benchmark items: indexing, ranking, evaluation, text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from retrievo.functions import text as tx
from retrievo.operators import adaptive, agentlog, analysis, judgements, lexical, metrics, ranking, sampling
from retrievo.plans.common import QRELS, TOKENS, corpus, items, qrels, run, table, with_run
from retrievo.sources.scratch import written

QUERIES: dict = {}


def query(name: str, ops: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql, ops)
        return fn

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("corpus_stats", "A40 S9", "SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS max_chars, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def corpus_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("max_chars"), F.count_distinct("text").alias("texts"))


@query("doc_length_stats", "L4", f"WITH {TOKENS} SELECT count(*) AS docs, sum(length)::BIGINT AS tokens, round(avg(length), 6) AS average, min(length) AS shortest, max(length) AS longest FROM lens")
def doc_length_stats(spark, d):
    return lexical.build_index(corpus(spark, d)).lengths.agg(
        F.count(F.lit(1)).alias("docs"), F.sum("length").alias("tokens"), F.round(F.avg("length"), 6).alias("average"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


@query("term_stats", "L1 L2 L3", f"WITH {TOKENS} SELECT term, df, round(idf, 9) AS idf FROM kept WHERE df >= 5")
def term_stats(spark, d):
    return lexical.build_index(corpus(spark, d)).terms.filter("df >= 5").select("term", "df", F.round("idf", 9).alias("idf"))


@query("vocab_pruned", "L2 L6", f"WITH {TOKENS} SELECT count(*) AS vocabulary, max(df) AS max_df FROM dfs, nd WHERE df <= 0.4 * n_docs")
def vocab_pruned(spark, d):
    index = lexical.build_index(corpus(spark, d), lexical.Bm25(max_df=0.4))
    return index.terms.agg(F.count(F.lit(1)).alias("vocabulary"), F.max("df").alias("max_df"))


@query("top_terms_by_lang", "O1 L1", f"""WITH {TOKENS}, c AS (SELECT lang, term, count(*) AS n FROM toks JOIN documents USING (doc_id) GROUP BY ALL)
SELECT lang, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 20""")
def top_terms_by_lang(spark, d):
    rows = table(spark, d, "documents").select("lang", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).filter("rank <= 20")


@query("bm25_top10", "J1 L5 W1 L6", with_run("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM run WHERE rank <= 10"))
def bm25_top10(spark, d):
    return run(spark, d, 10).withColumn("score", F.round("score", 6))


@query("bm25_bigrams", "L1 L5", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
toks AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w),
qw AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM benchmark),
qtoks AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM qw),
posts AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term), nd AS (SELECT count(*) AS n_docs FROM documents),
kept AS (SELECT term, ln((1 + n_docs) / (1 + df)) AS idf FROM dfs, nd WHERE df <= 0.65 * n_docs),
lens AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS length FROM documents d LEFT JOIN (SELECT p.* FROM posts p SEMI JOIN kept USING (term)) p USING (doc_id) GROUP BY d.doc_id),
av AS (SELECT avg(length) AS average FROM lens),
scored AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.6::DOUBLE / (tf + 1.6::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * length / average))), 9) AS score FROM qtoks JOIN kept USING (term) JOIN posts USING (term) JOIN lens USING (doc_id), av GROUP BY ALL)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5""")
def bm25_bigrams(spark, d):
    return lexical.bm25(corpus(spark, d), items(spark, d), 5, params=lexical.Bm25(k1=1.6, b=0.7, n_gram=2)).withColumn("score", F.round("score", 6))


@query("bm25_padded", "L5 W1", with_run("""SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT item_id AS query_id, documents.doc_id, coalesce(s.score, 0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN scored s ON s.query_id = item_id AND s.doc_id = documents.doc_id)) WHERE rank <= 150"""))
def bm25_padded(spark, d):
    return lexical.bm25(corpus(spark, d), items(spark, d), 150, pad=True).withColumn("score", F.round("score", 6))


@query("bm25_excluding", "F9 J6", with_run("""SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored ANTI JOIN qrels USING (query_id, doc_id)) WHERE rank <= 10"""))
def bm25_excluding(spark, d):
    out = lexical.bm25(corpus(spark, d), items(spark, d), 10, exclude=qrels(spark, d).select("query_id", "doc_id"))
    return out.withColumn("score", F.round("score", 6))


@query("bm25_explain", "L10", with_run("SELECT query_id, doc_id, term, tf, round(c.score, 6) AS score FROM contrib c SEMI JOIN (SELECT * FROM run WHERE rank <= 3) USING (query_id, doc_id)"))
def bm25_explain(spark, d):
    best = written(run(spark, d, 3).select("query_id", "doc_id"), "best")
    parts = lexical.contributions(corpus(spark, d), items(spark, d), only=best)
    return parts.select("query_id", "doc_id", "term", "tf", F.round("score", 6).alias("score"))


METRICS = """m AS (SELECT q.query_id, k, coalesce(1.0::DOUBLE / min(CASE WHEN g.doc_id IS NOT NULL THEN rank END), 0) AS rr,
  count(g.doc_id) / any_value(rel)::DOUBLE AS recall, coalesce(count(g.doc_id) / nullif(count(r.doc_id), 0)::DOUBLE, 0) AS precision
  FROM (SELECT query_id, count(*) AS rel FROM qrels GROUP BY 1) q CROSS JOIN (SELECT unnest([1, 5, 10, 100]) AS k)
  LEFT JOIN run r ON r.query_id = q.query_id AND r.rank <= k LEFT JOIN qrels g ON g.query_id = q.query_id AND g.doc_id = r.doc_id GROUP BY q.query_id, k)"""


@query("bm25_metrics_at_k", "A1 A2 A3 A4 A7 J2", with_run("SELECT k, round(avg(rr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg((rr > 0)::INT), 6) AS hit_rate, count(*) AS n FROM m GROUP BY k", METRICS))
def bm25_metrics_at_k(spark, d):
    return metrics.summary(metrics.per_query(run(spark, d), qrels(spark, d), (1, 5, 10, 100)))


@query("metrics_constant_precision", "A5 A6", with_run("""SELECT q.query_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN g.doc_id IS NOT NULL THEN rank END), 0), 6) AS rr, round(count(g.doc_id) / 10.0::DOUBLE, 6) AS precision
  FROM (SELECT DISTINCT query_id FROM qrels) q LEFT JOIN run r ON r.query_id = q.query_id AND r.rank <= 10 LEFT JOIN qrels g ON g.query_id = q.query_id AND g.doc_id = r.doc_id GROUP BY 1"""))
def metrics_constant_precision(spark, d):
    out = metrics.per_query(run(spark, d), qrels(spark, d), (10,), precision="constant", skip_empty=True)
    return out.select("query_id", *r6("rr", "precision"))


@query("metrics_rollup_by_lang", "A4 A40", with_run("""SELECT lang, k, round(avg(rr), 6) AS mrr, round(avg(recall), 6) AS recall, count(*) AS n FROM m
  JOIN (SELECT query_id, min(lang) AS lang FROM qrels JOIN documents USING (doc_id) GROUP BY 1) USING (query_id) GROUP BY ROLLUP (lang, k)""", METRICS))
def metrics_rollup_by_lang(spark, d):
    rel = qrels(spark, d)
    lang = rel.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("query_id").agg(F.min("lang").alias("lang"))
    rows = metrics.per_query(run(spark, d), rel, (1, 5, 10, 100)).join(lang, "query_id")
    return rows.rollup("lang", "k").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


@query("trec_metrics", "A8 W4", with_run("""SELECT q.query_id, round(coalesce(dcg / best, 0), 6) AS ndcg, round(coalesce(found / rel::DOUBLE, 0), 6) AS recall, round(coalesce(ap / rel, 0), 6) AS ap, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr
  FROM (SELECT query_id, count(*) AS rel, sum(CASE WHEN pos <= 10 THEN 1 / log2(pos + 1) END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS pos FROM qrels) GROUP BY 1) q
  LEFT JOIN (SELECT query_id, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg, sum(hits / rank::DOUBLE) AS ap, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS found
    FROM (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM run SEMI JOIN qrels USING (query_id, doc_id)) GROUP BY 1) g USING (query_id)"""))
def trec_metrics(spark, d):
    return metrics.trec(run(spark, d), qrels(spark, d)).select("query_id", *r6("ndcg", "recall", "ap", "rr"))


@query("fbeta_micro", "A9", with_run("""SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(5 * p * r / (4 * p + r), 6) AS f FROM (SELECT tp, fp, fn, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM (
  SELECT count(*) FILTER (a.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (a.doc_id IS NULL) AS fn
  FROM (SELECT * FROM run WHERE rank <= 3) a FULL JOIN qrels g ON a.query_id = g.query_id AND a.doc_id = g.doc_id))"""))
def fbeta_micro(spark, d):
    return metrics.f_beta(run(spark, d, 3), qrels(spark, d)).select("tp", "fp", "fn", *r6("precision", "recall", "f"))


@query("max_relevant_filter", "F1 F2", f"WITH {QRELS} SELECT query_id, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM qrels) WHERE n <= 1")
def max_relevant_filter(spark, d):
    return judgements.max_judged(qrels(spark, d), 1).select("query_id", "doc_id")


@query("positive_qrels", "S4 J8", f"WITH {QRELS} SELECT query_id, doc_id FROM qrels JOIN labels USING (doc_id) WHERE quality > 0")
def positive_qrels(spark, d):
    graded = qrels(spark, d).drop("score").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id")
    return metrics.positive(graded)


@query("missing_docs", "J8", f"WITH {QRELS}, lab AS (SELECT DISTINCT doc_id FROM labels) SELECT (SELECT count(*) FROM qrels ANTI JOIN lab USING (doc_id)) AS missing, (SELECT count(*) FROM qrels SEMI JOIN lab USING (doc_id)) AS known")
def missing_docs(spark, d):
    rel, known = qrels(spark, d), table(spark, d, "labels")
    out = rel.join(known.select("doc_id", F.lit(1).alias("known")).distinct(), "doc_id", "left")
    return out.agg(F.count_if(F.col("known").isNull()).alias("missing"), F.count("known").alias("known"))


@query("error_classes", "F4", with_run("""SELECT query_id, count(*) FILTER (rank <= 10 AND g IS NOT NULL) AS tp, count(*) FILTER (rank <= 10 AND g IS NULL) AS fp, count(*) FILTER (coalesce(rank, 999) > 10 AND g IS NOT NULL) AS fn, count(*) FILTER (rank > 10 AND g IS NOT NULL) AS beyond
  FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, rank, b.doc_id AS g FROM run a FULL JOIN qrels b ON a.query_id = b.query_id AND a.doc_id = b.doc_id) GROUP BY 1"""))
def error_classes(spark, d):
    return metrics.classes(run(spark, d), qrels(spark, d))


@query("gt_rank_stats", "A10", with_run("SELECT count(*) AS found, round(avg(rank), 6) AS mean, quantile_cont(rank, 0.5) AS median, quantile_cont(rank, 0.25) AS p25, quantile_cont(rank, 0.75) AS p75, quantile_cont(rank, 0.9) AS p90, count(*) FILTER (rank <= 50) AS within_50 FROM run SEMI JOIN qrels USING (query_id, doc_id)"))
def gt_rank_stats(spark, d):
    found = run(spark, d).join(qrels(spark, d), ["query_id", "doc_id"], "left_semi")
    p = lambda q, n: F.percentile("rank", q).alias(n)
    return found.agg(F.count(F.lit(1)).alias("found"), F.round(F.avg("rank"), 6).alias("mean"), p(0.5, "median"), p(0.25, "p25"), p(0.75, "p75"), p(0.9, "p90"), F.count_if(F.col("rank") <= 50).alias("within_50"))


OVERLAP = r"""pr AS (SELECT g.query_id, g.doc_id, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]{2,}')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}')) AS d
  FROM (SELECT query_id, doc_id FROM run WHERE rank <= 5) g JOIN benchmark b ON b.item_id = g.query_id JOIN documents d ON d.doc_id = g.doc_id),
ov AS (SELECT *, len(list_intersect(q, d)) AS n_shared, len(list_intersect(q, d)) / len(list_distinct(q || d))::DOUBLE AS jaccard FROM pr)"""


def overlap_pairs(spark, d, ranked=None):
    """The first five of each query with both sets of words; only their documents are taken apart."""
    best = (run(spark, d, 5) if ranked is None else ranked.filter("rank <= 5")).select("query_id", "doc_id")
    wanted = best.select("doc_id").distinct()
    docs = corpus(spark, d).join(F.broadcast(wanted) if wanted.count() <= lexical.SMALL_ROWS else wanted, "doc_id", "left_semi")
    sets = lambda df, key, name: df.select(key, F.array_distinct(tx.tokens(F.col("text"))).alias(name))
    return best.join(sets(items(spark, d), "query_id", "q"), "query_id").join(sets(docs, "doc_id", "d"), "doc_id")


@query("lexical_overlap", "A17 C14 J5", with_run("SELECT query_id, doc_id, n_shared, round(jaccard, 6) AS jaccard, round(n_shared / least(len(q), len(d))::DOUBLE, 6) AS overlap, round(n_shared / len(q)::DOUBLE, 6) AS query_coverage, round(n_shared / len(d)::DOUBLE, 6) AS doc_coverage FROM ov", OVERLAP))
def lexical_overlap(spark, d):
    figures = analysis.overlap(F.col("q"), F.col("d"))
    return overlap_pairs(spark, d).select("query_id", "doc_id", "q", "d").select("query_id", "doc_id", *[(F.round(c, 6) if n != "n_shared" else c).alias(n) for n, c in figures.items()])


@query("vocab_gap", "A18", with_run("SELECT count(*) AS pairs, round(avg((jaccard = 0)::INT), 6) AS zero_share, round(avg(jaccard), 6) AS mean, round(quantile_cont(jaccard, 0.5), 6) AS median, round(stddev_pop(jaccard), 6) AS deviation, round(avg((jaccard < 0.05)::INT), 6) AS under_05, round(avg((jaccard < 0.1)::INT), 6) AS under_10 FROM ov", OVERLAP))
def vocab_gap(spark, d):
    pairs = overlap_pairs(spark, d).withColumn("jaccard", analysis.overlap(F.col("q"), F.col("d"))["jaccard"])
    return analysis.gap_summary(pairs).select("pairs", *r6("zero_share", "mean", "median", "deviation", "under_05", "under_10"))


@query("discriminative_terms", "A19 O1", with_run("""SELECT side, term, pairs, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY pairs DESC, term) AS rank FROM (
  SELECT side, term, count(*) AS pairs FROM (
    SELECT 'query' AS side, unnest(list_filter(q, lambda x: NOT list_contains(d, x))) AS term FROM pr UNION ALL SELECT 'document', unnest(list_filter(d, lambda x: NOT list_contains(q, x))) FROM pr
    UNION ALL SELECT 'shared', unnest(list_intersect(q, d)) FROM pr) GROUP BY ALL)) WHERE rank <= 30""", OVERLAP))
def discriminative_terms(spark, d):
    return analysis.discriminative_terms(overlap_pairs(spark, d))


@query("gap_strata", "A20", with_run("""SELECT CASE WHEN j = 0 THEN 'zero' WHEN j < 0.05 THEN 'low' WHEN j <= 0.2 THEN 'moderate' ELSE 'high' END AS stratum, count(*) AS queries, round(avg(rr), 6) AS mrr
  FROM (SELECT query_id, max(jaccard) AS j FROM ov GROUP BY 1) JOIN (SELECT query_id, rr FROM m WHERE k = 10) USING (query_id) GROUP BY 1""", OVERLAP + "," + METRICS))
def gap_strata(spark, d):
    ranked = run(spark, d, 10)
    best = overlap_pairs(spark, d, ranked).withColumn("jaccard", analysis.overlap(F.col("q"), F.col("d"))["jaccard"]).groupBy("query_id").agg(F.max("jaccard").alias("j"))
    rr = metrics.per_query(ranked, qrels(spark, d), (10,))
    return best.join(rr, "query_id").groupBy(analysis.stratum(F.col("j")).alias("stratum")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("never_retrieved", "A21 J18", with_run("SELECT query_id, doc_id FROM qrels ANTI JOIN (SELECT * FROM run WHERE rank <= 1) USING (query_id, doc_id)"))
def never_retrieved(spark, d):
    return agentlog.never_retrieved(qrels(spark, d).select("query_id", "doc_id"), run(spark, d, 1))


@query("hard_negatives", "J6 L16", with_run("SELECT query_id, doc_id, rank FROM run ANTI JOIN qrels USING (query_id, doc_id) WHERE rank <= 30"))
def hard_negatives(spark, d):
    return sampling.hard_negatives(run(spark, d, 30), qrels(spark, d), 30).select("query_id", "doc_id", "rank")


@query("rank_range_negatives", "O7", with_run("""SELECT query_id, doc_id, rank, 0 AS band FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM run ANTI JOIN qrels USING (query_id, doc_id) WHERE rank BETWEEN 2 AND 15) WHERE p <= 4
  UNION ALL SELECT query_id, doc_id, rank, 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM run ANTI JOIN qrels USING (query_id, doc_id) WHERE rank BETWEEN 51 AND 100) WHERE p <= 1"""))
def rank_range_negatives(spark, d):
    return sampling.rank_range_negatives(run(spark, d), qrels(spark, d))


@query("filled_negatives", "L16 J6", with_run("""SELECT query_id, doc_id, CAST(place AS INTEGER) AS place FROM have UNION ALL SELECT query_id, doc_id, CAST(place AS INTEGER) FROM (
  SELECT n.query_id, s.doc_id, n.have + row_number() OVER (PARTITION BY n.query_id ORDER BY md5('fill' || s.doc_id), s.doc_id) AS place
  FROM (SELECT query_id, coalesce(max(place), 0) AS have FROM (SELECT DISTINCT query_id FROM qrels) LEFT JOIN have USING (query_id) GROUP BY 1) n CROSS JOIN documents s
  WHERE n.have < 3 AND NOT EXISTS (SELECT 1 FROM qrels g WHERE g.query_id = n.query_id AND g.doc_id = s.doc_id) AND NOT EXISTS (SELECT 1 FROM have h WHERE h.query_id = n.query_id AND h.doc_id = s.doc_id)) WHERE place <= 3""",
  "have AS (SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (SELECT * FROM run WHERE rank <= 2) r ANTI JOIN qrels USING (query_id, doc_id)) WHERE place <= 3)"))
def filled_negatives(spark, d):
    rel = qrels(spark, d)
    return sampling.filled_negatives(sampling.hard_negatives(run(spark, d, 2), rel, 2), corpus(spark, d), rel.select("query_id", "doc_id"), 3)


SHARED = r"""sc AS (SELECT r.query_id, r.doc_id, r.rank, len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]{2,}')), list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}'))))::DOUBLE AS score
  FROM run r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d USING (doc_id) WHERE rank <= 50)"""


def shared_tokens(spark, d, pairs):
    """A deterministic scorer: the number of shared tokens."""
    sets = lambda df, key, name: df.select(key, F.array_distinct(tx.tokens(F.col("text"))).alias(name))
    both = pairs.select("query_id", "doc_id").join(sets(items(spark, d), "query_id", "q"), "query_id").join(sets(corpus(spark, d), "doc_id", "t"), "doc_id")
    return both.select("query_id", "doc_id", F.size(F.array_intersect("q", "t")).cast("double").alias("score"))


@query("rerank_pool", "R5 R9", with_run("SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS rank, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) <= 10", SHARED))
def rerank_pool(spark, d):
    pool = run(spark, d, 50)
    none = shared_tokens(spark, d, pool.limit(0))
    return ranking.rerank(pool, ranking.score_once(pool, none, lambda p: shared_tokens(spark, d, p)), 10)


@query("model_effect", "A42", with_run("""SELECT query_id, base, CAST(other AS INTEGER) AS other, CASE WHEN coalesce(other, 99999) < coalesce(base, 99999) THEN 'helped' WHEN coalesce(other, 99999) > coalesce(base, 99999) THEN 'hurt' ELSE 'neutral' END AS effect FROM (SELECT DISTINCT query_id FROM qrels)
  LEFT JOIN (SELECT query_id, min(rank) AS base FROM run SEMI JOIN qrels USING (query_id, doc_id) WHERE rank <= 50 GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT query_id, min(nr) AS other FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS nr FROM sc) SEMI JOIN qrels USING (query_id, doc_id) GROUP BY 1) USING (query_id)""", SHARED))
def model_effect(spark, d):
    pool = run(spark, d, 50)
    return analysis.helped(pool, ranking.rerank(pool, shared_tokens(spark, d, pool), 50), qrels(spark, d))


GRAPH = f"""WITH {TOKENS},
w AS (SELECT p.doc_id AS dst, p.term, k.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.length / a.average)) AS s FROM posts p JOIN kept k USING (term) JOIN lens l USING (doc_id), av a),
g AS (SELECT p.doc_id AS src, w.dst, round(sum(s), 9) AS weight FROM posts p JOIN w USING (term) WHERE p.doc_id <> w.dst AND p.doc_id % 50 = 0 GROUP BY ALL)
SELECT src, dst, CAST(nbr_rank AS INTEGER) AS nbr_rank, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS nbr_rank FROM g) WHERE nbr_rank <= 8"""


@query("doc_graph_topk", "L7 J13", GRAPH.replace(" AND p.doc_id % 50 = 0", ""))
def doc_graph_topk(spark, d):
    return lexical.document_graph(corpus(spark, d), 8).withColumn("weight", F.round("weight", 6))


#: The adaptive loop of ``_adaptive`` as a recursion over the documents scored so far; STRENGTHS and PRIORITY are those of a plan.
LOOP = rf"""WITH RECURSIVE {TOKENS},
w AS (SELECT p.doc_id AS dst, p.term, k.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.length / a.average)) AS s FROM posts p JOIN kept k USING (term) JOIN lens l USING (doc_id), av a),
g AS (SELECT p.doc_id AS src, w.dst, round(sum(s), 9) AS weight FROM posts p JOIN w USING (term) WHERE p.doc_id <> w.dst GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS nbr_rank FROM g) WHERE nbr_rank <= 8),
pool AS (SELECT * FROM run WHERE rank <= 20),
members AS (SELECT query_id, doc_id FROM pool UNION SELECT query_id, dst FROM pool JOIN near ON src = doc_id),
tokens AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS t FROM documents),
qtokens AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS q FROM benchmark),
sc AS (SELECT query_id, doc_id, len(list_intersect(q, t))::DOUBLE AS score FROM members JOIN tokens USING (doc_id) JOIN qtokens USING (query_id)),
edges AS (SELECT query_id, src, dst, nbr_rank, weight FROM members JOIN near ON src = doc_id),
walk AS (
  SELECT query_id, 0 AS step, []::STRUCT(doc BIGINT, score DOUBLE, strength DOUBLE)[] AS scored FROM (SELECT DISTINCT query_id FROM pool)
  UNION ALL
  SELECT query_id, step + 1, list_concat(scored, STRENGTHS) FROM (
    SELECT w.query_id, w.step, w.scored, list({{'doc': c.doc, 'score': coalesce(sc.score, 0)}} ORDER BY c.place) AS lot
    FROM walk w JOIN (
      SELECT *, min(source) OVER (PARTITION BY query_id) AS used FROM (
        SELECT w.query_id, p.doc_id AS doc, w.step % 2 AS source, row_number() OVER (PARTITION BY w.query_id ORDER BY p.rank) AS place
        FROM walk w JOIN pool p USING (query_id) WHERE NOT list_contains(list_transform(w.scored, lambda x: x.doc), p.doc_id)
        UNION ALL
        SELECT query_id, dst, 1 - step % 2, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, arrival) FROM (
          SELECT w.query_id, w.step, e.dst, PRIORITY AS priority, min(w.pos * 100 + e.nbr_rank) AS arrival
          FROM (SELECT query_id, step, scored, unnest(range(len(scored))) AS pos, unnest(scored) AS s FROM walk) w JOIN edges e ON e.query_id = w.query_id AND e.src = w.s.doc
          WHERE w.s.strength IS NOT NULL AND NOT list_contains(list_transform(w.scored, lambda x: x.doc), e.dst) GROUP BY w.query_id, w.step, e.dst))
    ) c ON c.query_id = w.query_id AND c.source = c.used AND c.place <= least(5, 30 - len(w.scored))
    LEFT JOIN sc ON sc.query_id = w.query_id AND sc.doc_id = c.doc
    WHERE len(w.scored) < 30 GROUP BY w.query_id, w.step, w.scored)),
final AS (SELECT query_id, arg_max(scored, step) AS scored FROM walk GROUP BY query_id),
done AS (SELECT query_id, unnest(range(len(scored))) AS pos, unnest(list_transform(scored, lambda x: x.doc)) AS doc_id, unnest(list_transform(scored, lambda x: x.score)) AS score FROM final),
rest AS (SELECT p.query_id, p.doc_id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS place, len(f.scored) AS n, coalesce(list_min(list_transform(f.scored, lambda x: x.score)), 0) - 1 AS floor
  FROM pool p JOIN final f USING (query_id) WHERE NOT list_contains(list_transform(f.scored, lambda x: x.doc), p.doc_id)),
every AS (SELECT query_id, pos, doc_id, score FROM done UNION ALL SELECT query_id, n + place, doc_id, floor - (place - 1) FROM rest WHERE place <= 30 - n)
"""
GAR = LOOP.replace("STRENGTHS", "list_transform(lot, lambda x: {'doc': x.doc, 'score': x.score, 'strength': x.score})").replace("PRIORITY", "greatest(0, max(w.s.strength))")
BEST = "list_sort(list_transform(range(len(scored) + len(lot)), lambda i: {'n': CASE WHEN i < len(scored) THEN -scored[i + 1].score ELSE -lot[i + 1 - len(scored)].score END, 'p': i}))[1:10]"
SHARE = f"exp({BEST}[1].n + x.score) / list_sum(list_transform({BEST}, lambda b: exp({BEST}[1].n - b.n)))"
QUAM = LOOP.replace(
    "STRENGTHS", f"list_transform(lot, lambda x, j: {{'doc': x.doc, 'score': x.score, 'strength': CASE WHEN list_contains(list_transform({BEST}, lambda b: b.p), len(scored) + j - 1) THEN {SHARE} END}})",
).replace("PRIORITY", "list_sum(list(e.weight * w.s.strength ORDER BY w.pos))")
ADAPTED = "SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank, round(score, 6) AS score FROM every"
EXPANDED = """, ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM every)
SELECT avg(coalesce(n, 0)) AS expanded FROM (SELECT DISTINCT query_id FROM ranked) LEFT JOIN (SELECT query_id, count(*) AS n FROM ranked ANTI JOIN pool USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1) USING (query_id)"""


def _adaptive(spark, d, plan):
    """Edges of the pool's documents and of their neighbours; documents beyond these count as 0."""
    docs = corpus(spark, d)
    pool = written(run(spark, d, 20), "pool")
    first = pool.select("doc_id").distinct()
    reach = written(lexical.document_graph(docs, 8, sources=first), "reach")
    near = reach.unionByName(written(lexical.document_graph(docs, 8, sources=reach.select(F.col("dst").alias("doc_id")).join(first, "doc_id", "left_anti")), "near"))
    close = pool.join(reach, pool["doc_id"] == reach["src"]).select("query_id", F.col("dst").alias("doc_id"))
    scores = written(shared_tokens(spark, d, pool.select("query_id", "doc_id").unionByName(close).distinct()), "scores")
    return adaptive.rerank(pool, near, scores, plan), pool


@query("gar_rerank", "R6 I2 J13", GAR + ADAPTED)
def gar_rerank(spark, d):
    return _adaptive(spark, d, adaptive.Plan(budget=30, batch=5))[0].withColumn("score", F.round("score", 6))


@query("quam_rerank", "R7 I2", QUAM + ADAPTED)
def quam_rerank(spark, d):
    return _adaptive(spark, d, adaptive.Plan(budget=30, batch=5, affinity=True))[0].withColumn("score", F.round("score", 6))


@query("expanded_docs", "R8", GAR + EXPANDED)
def expanded_docs(spark, d):
    return adaptive.expanded(*_adaptive(spark, d, adaptive.Plan(budget=30, batch=5)), 10)


@query("grep_corpus", "F5 F11", "SELECT doc_id, substr(text, 1, 300) AS preview FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e|password') ORDER BY doc_id LIMIT 25")
def grep_corpus(spark, d):
    return judgements.grep(corpus(spark, d), "licen[cs]e|password", 25)


@query("read_document", "F6", "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id = 7")
def read_document(spark, d):
    return judgements.read_document(table(spark, d, "documents"), 7)


@query("keyword_normalised", "F7 F8", "SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'none' END AS mention, count(*) AS docs FROM (SELECT contains(t, 'thething') AS a, contains(t, 'licensed') AS b FROM (SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM documents)) GROUP BY 1")
def keyword_normalised(spark, d):
    t = tx.normalised(F.col("text"))
    a, b = t.contains("thething"), t.contains("licensed")
    rows = corpus(spark, d).select(F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("none").alias("mention"))
    return rows.groupBy("mention").agg(F.count(F.lit(1)).alias("docs"))


STOP = ("the", "and", "that", "with")


@query("key_terms", "L13 W9", r"""WITH s AS (SELECT doc_id, regexp_split_to_array(trim(lower(text)), '\s+') AS a FROM documents),
p AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS raw FROM s), w AS (SELECT doc_id, pos, regexp_replace(raw, '[^a-z\-]', '', 'g') AS w FROM p),
n AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM w), f AS (SELECT * FROM n WHERE length(w) >= 3 AND w NOT IN ('the', 'and', 'that', 'with') AND w NOT IN ('for', 'thing')),
t AS (SELECT doc_id, w AS term FROM f UNION SELECT doc_id, w || ' ' || nx FROM f WHERE length(nx) >= 3 AND nx NOT IN ('the', 'and', 'that', 'with'))
SELECT term, count(*) AS docs FROM t GROUP BY term ORDER BY docs DESC, term LIMIT 20""")
def key_terms(spark, d):
    return lexical.key_terms(corpus(spark, d), "For thing", STOP, 20)


@query("word_frequencies", "L14", r"""SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-ZÀ-ɏ]+')) AS term FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark WHERE item_id % 2 = 0)) GROUP BY 1) WHERE n >= 20""")
def word_frequencies(spark, d):
    q = items(spark, d)
    train, test = q.filter("query_id % 2 = 0").select("query_id"), q.filter("query_id % 2 = 1").select("query_id")
    return lexical.word_frequencies(corpus(spark, d), q, train, test).filter("n >= 20")


@query("sentence_split", "C4", r"""WITH s AS (SELECT doc_id, trim(text, e' \n\t\r') AS whole, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;])\s+', e'\\1\x01', 'g'), e'\x01|\n+'), lambda x: trim(x, e' \n\t\r')), lambda x: length(x) > 10) AS parts FROM documents)
SELECT doc_id, CAST(greatest(len(parts), 1) AS INTEGER) AS n, length(CASE WHEN len(parts) > 0 THEN parts[1] ELSE whole END)::INTEGER AS first_length FROM s""")
def sentence_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", tx.sentences(F.col("text"), F.col("lang")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.length(F.element_at("s", 1)).alias("first_length"))


@query("chunk_overlap", "W8", r"""SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(200, n - s) AS INTEGER) AS words FROM (SELECT doc_id, len(regexp_split_to_array(text, '\s+')) AS n FROM documents), LATERAL (SELECT unnest(range(0, n, 180)) AS s)""")
def chunk_overlap(spark, d):
    rows = corpus(spark, d).select("doc_id", F.explode(tx.chunks(F.col("text"), 200, 180)).alias("c"))
    return rows.select("doc_id", F.col("c.start").alias("start"), F.size("c.words").alias("words"))


@query("control_characters", "C9 C15", r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'))::INTEGER AS n, regexp_replace(regexp_replace(regexp_replace(source || ' / ' || lang || '?', '[/\\]', '_', 'g'), '[<>:\x22|?*]', '', 'g'), '[\s_]+', '_', 'g') || '.pdf' AS file FROM documents")
def control_characters(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.length(tx.without_controls(F.col("text"))).alias("n"), tx.safe_filename(F.concat("source", F.lit(" / "), "lang", F.lit("?"))).alias("file"))


@query("pad_ranking", "R14", with_run("""SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, key, doc_id) AS rank FROM (
  SELECT query_id, doc_id, 0 AS source, rank::DOUBLE AS key FROM run WHERE rank <= 3 UNION ALL SELECT query_id, doc_id, 1, -score FROM run WHERE rank > 3 AND rank <= 50)) WHERE rank <= 8"""))
def pad_ranking(spark, d):
    seen = run(spark, d, 50)
    return ranking.padded(seen.filter("rank <= 3"), seen, 8)


@query("qrels_union_priority", "T1 T3", f"""WITH {QRELS} SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY s, score DESC) AS n FROM (
  SELECT query_id, doc_id, score, 0 AS s FROM qrels UNION ALL SELECT query_id, doc_id, quality, 1 FROM qrels JOIN labels USING (doc_id) UNION ALL SELECT doc_id % 40, doc_id, quality, 1 FROM labels)) WHERE n = 1""")
def qrels_union_priority(spark, d):
    rel, lab = qrels(spark, d), table(spark, d, "labels")
    added = rel.drop("score").join(lab.select("doc_id", F.col("quality").alias("score")), "doc_id").select("query_id", "doc_id", "score")
    added = added.unionByName(lab.select((F.col("doc_id") % 40).alias("query_id"), "doc_id", F.col("quality").alias("score")))
    return judgements.union_first(rel, added)


@query("split_overlap", "T2 J14 A39", """WITH s AS (SELECT DISTINCT 's' || l_linenumber % 3 AS split, l_partkey AS doc_id FROM lineitem), n AS (SELECT split, count(*) AS n FROM s GROUP BY 1)
SELECT a.split AS a, b.split AS b, a.n AS na, b.n AS nb, shared, round(shared / (a.n + b.n - shared)::DOUBLE, 6) AS jaccard FROM n a JOIN n b ON a.split < b.split JOIN (SELECT x.split AS a, y.split AS b, count(*) AS shared FROM s x JOIN s y USING (doc_id) GROUP BY 1, 2) o ON o.a = a.split AND o.b = b.split""")
def split_overlap(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("split"), F.col("l_partkey").alias("doc_id"))
    return judgements.split_overlap(rows).withColumn("jaccard", F.round("jaccard", 6))


@query("split_profile", "A39", """SELECT lang AS split, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS p75, quantile_cont(n_chars, 0.9) AS p90, max(n_chars) AS longest, round(avg((n_chars >= 1000)::INT), 6) AS long_share FROM documents GROUP BY lang""")
def split_profile(spark, d):
    p = lambda q, n: F.percentile("n_chars", q).alias(n)
    rows = table(spark, d, "documents").withColumnRenamed("lang", "split")
    return rows.groupBy("split").agg(F.round(F.avg("n_chars"), 6).alias("mean"), p(0.5, "median"), p(0.75, "p75"), p(0.9, "p90"), F.max("n_chars").alias("longest"), F.round(F.avg((F.col("n_chars") >= 1000).cast("int")), 6).alias("long_share"))


@query("stratified_sample", "O5", """WITH z AS (SELECT lang, count(*) AS size, sum(count(*)) OVER () AS total FROM documents GROUP BY lang), w AS (SELECT *, least(size, greatest(1, round(90 * size / total::DOUBLE)))::BIGINT AS wish, lead(lang) OVER (ORDER BY lang) IS NULL AS last FROM z),
b AS (SELECT *, greatest(90 - coalesce(sum(wish) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM w), q AS (SELECT lang, least(size, CASE WHEN last THEN room ELSE least(wish, room) END) AS quota FROM b)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS place FROM documents) JOIN q USING (lang) WHERE place <= quota""")
def stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 90)


@query("balanced_sample", "O6 O4", "SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS place FROM labels) WHERE place <= 25")
def balanced_sample(spark, d):
    return sampling.balanced(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 25)


@query("oversampled_positives", "O8 R12", """SELECT toxic, count(*) AS rows FROM (SELECT toxic, unnest(range(CASE WHEN toxic = 1 THEN greatest(1, floor(least(p * 10, n) / greatest(p, 1)))::INT ELSE 1 END)) FROM labels, (SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n FROM labels)) GROUP BY 1""")
def oversampled_positives(spark, d):
    return sampling.oversampled(table(spark, d, "labels").select("doc_id", "toxic"), "toxic").groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"))

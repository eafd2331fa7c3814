"""Readers, writers and streams."""

import json

from pyspark.sql import functions as F

from retrievo.operators import metrics, ranking
from retrievo.plans import registry
from retrievo.sources import beir, pages, statutes
from retrievo.streaming import logs


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_corpus_queries_and_judgements(spark, tmp_path):
    corpus = beir.read_corpus(spark, lines(tmp_path / "c.jsonl", [{"_id": "a", "text": "one"}, {"_id": "b", "title": "T", "text": "two"}, {"_id": "a", "text": "again"}]))
    assert {r["doc_id"]: (r["title"], r["text"]) for r in corpus.collect()} == {"a": ("", "again"), "b": ("T", "two")}
    queries = beir.read_queries(spark, lines(tmp_path / "q.jsonl", [{"_id": "1", "text": "x"}, {"_id": "2", "text": "y", "metadata": {"k": "v"}}]))
    assert {r["query_id"]: r["metadata"] for r in queries.collect()} == {"1": {}, "2": {"k": "v"}}
    qrels = beir.read_qrels(spark, lines(tmp_path / "q.tsv", ["query-id\tcorpus-id\tscore", "1\ta\t1", "1\ta\t0", "short\tline", "2\tb\t2"]))
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in qrels.collect()} == {("1", "a"): 0, ("2", "b"): 2}
    beir.write_dataset(str(tmp_path / "out"), corpus, queries, qrels.withColumn("split", F.lit("test")))
    again = beir.read_qrels(spark, str(tmp_path / "out/qrels_test.tsv"))
    assert sorted(map(tuple, again.select("query_id", "doc_id", "score").collect())) == [("1", "a", 0), ("2", "b", 2)]
    assert beir.read_corpus(spark, str(tmp_path / "out/corpus.jsonl")).count() == 2


def test_predictions_in_three_layouts(spark, tmp_path):
    path = lines(tmp_path / "p.jsonl", [
        {"qid": "1", "ranked_doc_ids": ["a", "b"], "ground_truth": ["b"]}, {"qid": "2", "rankings": [{"rank": 1, "doc_id": "c", "score": 0.5}], "ground_truth": [{"doc_id": "c", "rank": 1}]},
        {"qid": "3", "ranked_doc_ids": ["d"], "ground_truth": [], "tool_call_log": [{"turn": 1, "tool": "grep"}]},
    ])
    got = {r["qid"]: (r["ranked"], r["relevant"], r["layout"]) for r in beir.read_predictions(spark, path).collect()}
    assert got == {"1": (["a", "b"], ["b"], "predictions"), "2": (["c"], ["c"], "ranking"), "3": (["d"], [], "agent")}


def test_prediction_records_and_trec(spark, tmp_path):
    run = ranking.top_k(spark.createDataFrame([(1, 5, 0.1234567), (1, 6, 0.9)], "query_id long, doc_id long, score double"), 10)
    qrels = spark.createDataFrame([(1, 5, 1), (2, 5, 1)], "query_id long, doc_id long, score int")
    records = {r["qid"]: r for r in beir.prediction_records(run, qrels, metrics.per_query(run, qrels), "bm25", "d").collect()}
    assert records[1]["ranked_doc_ids"] == [6, 5] and records[1]["rr@10"] == 0.5 and records[1]["doc_scores"]["5"] == 0.123457 and records[2]["ranked_doc_ids"] == []
    beir.trec_run(run, "tag").write.text(str(tmp_path / "run"))
    back = beir.read_trec(spark, str(tmp_path / "run")).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in back] == [("1", "6", 1, 0.9), ("1", "5", 2, 0.1234567)]
    graded = beir.read_trec(spark, lines(tmp_path / "q.trec", ["1 0 a 3", "1 0 b 0", "bad line"])).collect()
    assert {(r["doc_id"], r["score"]) for r in graded} == {("a", 3.0), ("b", 0.0)}


def test_cached_tables(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert beir.cached(str(tmp_path), "f1", build, spark).count() == beir.cached(str(tmp_path), "f1", build, spark).count() == 3
    assert len(built) == 1 and beir.cached(str(tmp_path), "f2", build, spark).count() == 3 and len(built) == 2


def test_statutes_and_cases(spark, tmp_path):
    path = lines(tmp_path / "s.csv", ["buku_label,buku_judul,bab_label,bab_judul,bagian_label,bagian_judul,pasal_nomor,pasal_text", 'KESATU,ORANG,I,HAK,,, 12 ,"isi, teks"'])
    r = statutes.read_statutes(spark, path).first()
    assert (r["doc_id"], r["title"], r["text"], r["path"]) == ("12", "Pasal 12", "Pasal 12: isi, teks", "Buku Kesatu Orang, Bab I Hak, Pasal 12")
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps({"x": {"incidents": ["a", "b"], "relevant_laws": ["L"]}, "y": {"incidents": [], "relevant_laws": ["L"]}}))
    assert [tuple(r) for r in statutes.read_cases(spark, str(cases)).collect()] == [("x", "a. b", ["L"])]
    good = {"filename": "f", "humanized_query": {"text": "h", "relevant_laws": ["1"]}, "summarized_case": {"text": " ", "relevant_laws": []}}
    rows = statutes.read_summaries(spark, lines(tmp_path / "l.jsonl", [good, good | {"error": "timeout"}, good | {"error": "json_parse_failed"}])).collect()
    assert [(r["variant"], r["text"]) for r in rows] == [("humanized", "h")] * 2
    (tmp_path / "H30.xml").write_text('<d><pair id="1" label="Y"><t1>law</t1><t2>claim</t2></pair></d>')
    pair = statutes.read_pairs(spark, str(tmp_path / "H30.xml"), ["H30"]).first()
    assert (pair["label"], pair["t1"], pair["split"]) == ("Y", "law", "test")
    queries = spark.createDataFrame([("q", "1, 2,9")], "query_id string, article_ids string")
    known, missing = statutes.judgements_of(queries, spark.createDataFrame([("1",), ("2",)], "doc_id string"))
    assert {r["doc_id"] for r in known.collect()} == {"1", "2"} and missing.first()[0] == 1


def test_article_hierarchy(spark):
    text = ["Part I General", "Chapter 1 Rules", "<ARTICLE>", "(Purpose)", "Article 1 This law", "has lines.", "", "Section 2 Capacity", "<ARTICLE>", "None", "Article 2-2 More.", "", "Chapter 2 Other", "<ARTICLE>", "(X)", "No article"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n int, value string")
    got = {r["article_no"]: r for r in statutes.articles(df).collect()}
    assert set(got) == {"1", "2-2"}
    assert (got["1"]["title"], got["1"]["text"], got["1"]["part"], got["1"]["chapter"], got["1"]["section"]) == ("Purpose", "Article 1 This law has lines.", "General", "Rules", None)
    assert (got["2-2"]["title"], got["2-2"]["section"]) == ("", "Capacity")
    code = ["BUKU KESATU", "BAB I", "Pasal 1", "Menikmati hak ke-", "wargaan tidak.", "BAB II", "Pasal 2", "Anak.", "Pasal 1", "again"]
    rows = {r["pasal"]: r for r in statutes.code_articles(spark.createDataFrame([("f", i, t) for i, t in enumerate(code)], "file string, n int, value string")).collect()}
    assert rows["1"]["text"] == "Menikmati hak kewargaan tidak." and rows["1"]["bab"] == "I" and rows["2"]["bab"] == "II"


def test_listing_entries(spark):
    html = """<div id="tabs-1"><div class="spost"><strong><a href="/p/1">Case <i>1</i></a></strong><div class="small">Register : 1-1 <b>x</b></div><div>Tanggal 3 the summary</div></div>
      <div class="spost"><p>no title</p></div></div><div class="spost"><strong><a href="/no">outside</a></strong></div>"""
    rows = pages.entries(spark.createDataFrame([(1, html), (2, None), (3, "<p>x")], "page_id long, html string")).orderBy("place").collect()
    assert [(r["title"], r["url"], r["dates"], r["summary"]) for r in rows] == [("Case 1", "/p/1", "Register : 1-1 x", "Tanggal 3 the summary"), ("Judul Tidak Ditemukan", "#", None, None)]


def test_log_resumes(spark, tmp_path):
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    log.mkdir()
    lines(log / "1.jsonl", [{"qid": "a", "x": 1}, '{"qid": "b", "x"', {"qid": "c", "x": 3}])
    for _ in range(2):
        logs.append_new(logs.read_log(spark, str(log), "qid STRING, x INT"), "qid", out, state).awaitTermination()
    assert {r["qid"] for r in spark.read.parquet(out).collect()} == {"a", "c"}
    lines(log / "2.jsonl", [{"qid": "a", "x": 9}, {"qid": "b", "x": 2}])
    logs.append_new(logs.read_log(spark, str(log), "qid STRING, x INT", max_files=1), "qid", out, state).awaitTermination()
    assert sorted(r["qid"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    every = spark.createDataFrame([("a",), ("d",)], "qid string")
    assert [r[0] for r in logs.todo(every, spark.read.parquet(out), "qid").collect()] == ["d"]
    rows = spark.createDataFrame([("a", "t", ["1"], None), ("b", "", ["1"], None), ("c", "t", [], None), ("d", "t", ["1"], "x")], "qid string, text string, relevant_laws array<string>, error string")
    assert {r[0] for r in logs.to_retry(rows, "qid").collect()} == {"b", "c", "d"}


def test_upsert_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines(log / "1.jsonl", [{"k": "a", "at": 1, "x": 1}, {"k": "a", "at": 2, "x": 2}])
    read = lambda: logs.read_log(spark, str(log), "k STRING, at INT, x INT")
    logs.upsert(read(), ["k"], "at", str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    lines(log / "2.jsonl", [{"k": "a", "at": 3, "x": 3}, {"k": "b", "at": 1, "x": 7}])
    logs.upsert(read(), ["k"], "at", str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    assert {r["k"]: r["x"] for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {"a": 3, "b": 7}


def test_registry():
    names = registry.queries()
    assert len(names) > 90 and set(registry.oracle_sql()) <= set(names)

"""Text functions on hand-made cases."""

from pyspark.sql import functions as F

from retrievo.functions import text as tx
from retrievo.operators import lexical


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(expr.alias("x")).first()["x"]


def test_tokens_and_ngrams(spark):
    assert one(spark, tx.tokens(F.col("t")), t="L'été où naïve 中华人民 a ab_1 Straße") == ["été", "où", "naïve", "中华人民", "ab_1", "straße"]
    df = spark.createDataFrame([(["a1", "b1", "c1"],), (["a1"],)], "w array<string>")
    assert [r[0] for r in df.select(tx.ngrams(F.col("w"), 2)).collect()] == [["a1 b1", "b1 c1"], []]


def test_stop_words_and_stemming(spark):
    df = spark.createDataFrame([(["yang", "berjalan", "yang"],)], "w array<string>")
    assert df.select(tx.without(F.col("w"), ["yang"])).first()[0] == ["berjalan"]
    assert df.select(tx.stemmed(F.col("w"), lambda w: w.removeprefix("ber"))).first()[0] == ["yang", "jalan", "yang"]


def test_references(spark):
    strip = lambda t: one(spark, tx.without_references(F.col("t")), t=t)
    assert strip("melanggar Pasal 1266 dan 1267 KUHPerdata ini") == "melanggar ini"
    assert strip("wanprestasi (Pasal 1320) terjadi") == "wanprestasi terjadi"
    assert strip("Pasal 372 KUHP berlaku") == "Pasal 372 KUHP berlaku"
    assert strip("Pasal 1266 KUHP") == "Pasal 1266 KUHP"
    assert strip("menurut Kitab Undang-Undang  Hukum Perdata saja") == "menurut saja"
    assert one(spark, tx.code_article(F.col("t")), t="Pasal 1365a KUH Perdata") == "1365a"
    assert one(spark, tx.code_article(F.col("t")), t="Pasal 12 HIR") is None
    assert one(spark, tx.cited_articles(F.col("t")), t="Pasal 1320 dan Pasal 12 KUHPerdata, Pasal 5 HIR") == ["Pasal 12 KUHPerdata", "Pasal 1320 KUHPerdata"]


def test_sentences(spark):
    s = lambda t, lang="en": one(spark, tx.sentences(F.col("t"), F.lit(lang)), t=t)
    assert s("Short. This one is long enough; and this one too!\n\nAlso a third line") == ["This one is long enough;", "and this one too!", "Also a third line"]
    assert s(" tiny ") == ["tiny"]
    assert s("一二三四五六七八九十甲。乙", "zh") == ["一二三四五六七八九十甲"]


def test_judgement_lines(spark):
    text = "[1] RELEVAN\n[2] TIDAK_RELEVAN\n[3] XRELEVAN\nnothing\n[99] ini RELEVAN ya"
    got = {r["idx"]: r["relevant"] for r in one(spark, tx.judgements(F.col("t")), t=text)}
    assert got == {1: True, 2: False, 3: False, 99: True}
    assert {r["idx"]: r["relevant"] for r in one(spark, tx.judgements(F.col("t"), strict=False), t=text)}[3]
    assert one(spark, tx.verdict(F.col("t")), t="so verdict: RELEVAN.") and not one(spark, tx.verdict(F.col("t")), t="verdict: TIDAK_RELEVAN")
    assert one(spark, tx.verdict_binary(F.col("t")), t=" relevan ") == 1 and one(spark, tx.verdict_binary(F.col("t")), t="?") is None


def test_small_parsers(spark):
    assert one(spark, tx.act_name(F.col("t"), "bsard"), t="Art. 3, Code civil (Livre I)") == "Code civil"
    assert one(spark, tx.act_name(F.col("t"), "kuhperdata"), t="Buku Kesatu Orang, Bab I Menikmati, Pasal 1") == "Buku Kesatu Bab I"
    assert one(spark, tx.act_name(F.col("t"), "ilpcsr"), t="Section 2 of The Act, 1860") == "The Act"
    assert one(spark, tx.act_name(F.col("t"), "stard"), t="民法典第一条") == "民法典"
    assert one(spark, tx.number_prefix(F.col("t")), t="319a") == 319 and one(spark, tx.number_prefix(F.col("t"), -1), t="x1") == -1
    assert one(spark, tx.json_object(F.col("t")), t='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, tx.without_controls(F.col("t")), t="a\x01b\nc\x7f") == "ab\nc"
    assert one(spark, tx.safe_filename(F.col("t")), t='a/b:  "c"?.pdf') == "a_b_c.pdf" and one(spark, tx.safe_filename(F.col("t")), t="_x_") == "x.pdf"
    assert one(spark, tx.frames(F.col("t")), t="L2 FRAME: sale.\nother\nL2 FRAME: sale.\nL2 FRAME: lease;") == ["sale", "lease"]
    found = one(spark, tx.references(F.col("t")), t='<Document id="7"><Justification> L2: sale </Justification></Document>')
    assert [(r["doc_id"], r["justification"]) for r in found] == [("7", "L2: sale")]
    assert one(spark, tx.pruned(F.col("t"), F.lit("tool"), "a.1"), t="[a.1] text here [b] rest") == "[a.1] [PRUNED] [b] rest"
    assert one(spark, tx.hierarchy_title(*[F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(""), F.lit(None).cast("string"), F.col("e")]), a="KESATU", b="ORANG", c="I", d="HAK", e="12") == "Buku Kesatu Orang, Bab I Hak, Pasal 12"
    assert one(spark, tx.character_bigrams(F.col("t")), t="民法典 ab") == ["民法", "法典", "ab"]


def test_highlights(spark):
    assert one(spark, lexical.highlights(F.col("t"), "tort"), t="Tort law, tortious, a TORT") == [0, 22]

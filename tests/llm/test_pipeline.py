"""The corpus pipeline against its stages done by plain versions, and stages on odd rows."""

import zlib

import corpus_pipeline
from ledgerlens.llm import language, toxicity
from tests.llm import brute
from tests.llm.test_operators import SF, check_packing


def test_pipeline_agrees_with_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = language.learn(docs)
    told = [language.score(model, [t])[0] for _, t in rows]
    rows = [row for row, (lang, score) in zip(rows, told) if lang != language.UNKNOWN and score >= language.LEAST_SCORE]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = toxicity.learn(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = [(d, t) for d, t in rows if toxicity.score(marks, [t])[0] < 0.5]
    assert 0 < len(rows) - len(clean) < 60
    first = brute.components([(d, brute.fingerprint(t)) for d, t in clean])
    single = [(d, t) for (d, t), c in zip(clean, first) if c == d]
    assert len(single) < len(clean)
    kept = brute.repeats(single)
    final = [(d, kept[d, t][2] if kept[d, t][1] else t) for d, t in single]
    assert any(k[1] for k in kept.values())
    used, bound = check_packing(corpus_pipeline.run(spark, SF).collect(), final, 4096)
    assert used == bound


def test_stages_keep_columns_and_odd_rows(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    long = " ".join(f"w{n % 977}" for n in range(30_000))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "The end of it.", None, None, 14), (3, "The end of it.", None, None, 14),
           (None, "Nobody has this one.", "en", None, 3), (4, long, "en", "s", len(long)), (5, "12 34 %%", "en", "s", 8)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = out
        texts = sorted((r.text for r in docs.collect()), key=len)
        assert texts == (["The end of it.", "Nobody has this one.", long] if rows else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.select("doc_id").distinct().count() == (3 if rows else 0)


def test_documents_stay_when_no_language_is_learned(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "The end of it.", None, None, 14), (2, "12 %&", None, None, 5), (3, None, None, None, None), (None, "Nobody's.", None, None, 9), (4, "", None, None, 0)]
    held = next(n for n in range(5, 99) if zlib.crc32(str(n).encode()) % 5 == 0)
    for labelled in ([], [(held, "Held out.", "en", None, 9)]):
        docs = spark.createDataFrame(rows + labelled, schema)
        kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
        assert sorted(r.text for r in kept.collect()) == sorted(["The end of it.", "Nobody's."] + [r[1] for r in labelled])
        assert {(r.lang_pred, r.score) for r in language.identify(docs).collect()} == {("und", 0.0)}


def test_stages_keep_columns_of_any_name(spark):
    names = ["_id", "_mark", "_text", "_starts", "_kept", "_told", "_key", "mark", "shard", "grp", "fp", "a.b"]
    passage = " ".join(f"w{n}" for n in range(70))
    other = " ".join(f"x{n}" for n in range(300))
    rows = [(1, f"The first one. {passage}", "en"), (2, f"And the second {other} {passage} with an end.", "en"), (3, f"The first one. {passage}", "en"), (3, f"The first one. {passage}", "en")]
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"{r[0]}{n}" for n in names]) for r in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", *names]
    left = {r.doc_id: r for r in docs.collect()}
    assert {d: r.text for d, r in left.items()} == {1: rows[0][1], 2: f"And the second {other} with an end."}
    assert all(r[n] == f"{d}{n}" for d, r in left.items() for n in names)


def test_documents_in_other_languages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.doc_id: r for r in language.identify(docs).collect()}
    french = language.keep_known(docs, ["fr"]).select("doc_id").collect()
    assert {r.doc_id for r in french} == {d for d, r in told.items() if r.lang_pred == "fr" and r.score >= language.LEAST_SCORE} != set()
    sure = language.keep_known(docs, least_score=0.99)
    assert {r.doc_id for r in sure.collect()} == {d for d, r in told.items() if r.lang_pred != "und" and r.score >= 0.99}

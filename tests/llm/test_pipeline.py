"""The pipeline's stages against brute force on the smallest table."""

import re

from conftest import SF

import corpus_pipeline as p
from meterflow.llm import jaccard_join, substring_dedup
from meterflow.llm.storage import written


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = written(p.quality_classifier(spark, docs, SF), "t")
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    single = written(p.ngram_jaccard_join(spark, kept, SF), "t")
    before = kept.toPandas()
    expected = {i for i, _, c in jaccard_join.brute_force(list(before.doc_id), list(before.text), 5, 80) if i == c}
    assert set(single.toPandas().doc_id) == expected and single.count() == len(expected)
    clean = written(p.substring_dedup(spark, single, SF), "t").toPandas().set_index("doc_id")
    before = single.toPandas()
    for i, text, (_, gone, _) in zip(before.doc_id, before.text, substring_dedup.brute_force(list(before.text)), strict=True):
        after = clean.text[i]
        assert (after == text) if not gone else len(re.findall(r"[^\x20\x09-\x0D]+", after)) == len(re.findall(r"[^\x20\x09-\x0D]+", text)) - gone
        assert clean.n_chars[i] == len(after)
    mix = written(p.mix_sources(spark, single, SF), "t")
    assert mix.columns == columns and mix.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    out = p.bpe(spark, mix, SF)
    assert out.count() == mix.count() and out.where("NOT round_trip").count() == 0


def test_run_on_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join([*base[:-1], f"end{k}"])
    other = lambda k: " ".join([*(f"v{i}" for i in range(99)), f"end{k}"])
    rows = [(1, near(0)), (1, near(1)), (1, near(1)), (None, near(2)), (None, other(3)), (None, other(4)), (2, ""), (2, ""), (3, "solo text"), (None, "null id alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = p.ngram_jaccard_join(spark, docs, SF)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == 6
    assert [i for i, t in got if t.startswith("w0")] == [1] and [i for i, t in got if t.startswith("v0")] == [None]
    assert got.count((2, "")) == 2 and (3, "solo text") in got and (None, "null id alone") in got


def test_stages_on_odd_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    shared = words("shared", 60)
    rows = [
        (1, words("a", 200), "en", "s", 5), (1, words("b", 80), None, None, None), (2, words("a", 199) + " end", "en", "s", 5), (3, None, None, None, None), (4, "", "de", "", 0), (None, "  ", None, "s", 2),
        (5, words("c", 50) + " " + shared, "en", "t", 1), (6, words("d", 50) + " " + shared, "en", "t", 1), (7, words("long", 40_000), "en", "t", 1), (8, "x" * 300_000, "en", "u", 1), (9, words("e", 30), "en", None, 1), (9, words("e", 30), "en", None, 1),
    ]
    names = ["kept", "n_words", "ids", "component_id", "expected_grade", "n_tokens"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], kinds).repartition(3)
    first = written(p.quality_classifier(spark, docs, str(tmp_path)), "t")
    assert first.columns == docs.columns and first.count() == len(rows)  # without labels nothing is rejected
    second = written(p.ngram_jaccard_join(spark, first, str(tmp_path)), "t")
    assert second.columns == docs.columns and second.count() == len(rows) - 2  # document 2, and one of the equal rows
    third = written(p.substring_dedup(spark, second, str(tmp_path)), "t")
    texts = {r.doc_id: r.text for r in third.where("doc_id IN (5, 6, 7)").collect()}
    assert texts == {5: words("c", 50), 6: words("d", 50), 7: words("long", 40_000)}
    assert third.where("ids = 'ids' AND kept = 'kept'").count() == len(rows) - 2
    fourth = written(p.mix_sources(spark, third, str(tmp_path)), "t")
    assert fourth.columns == docs.columns
    out = p.bpe(spark, fourth, str(tmp_path)).collect()
    assert len(out) == fourth.count() and all(r.round_trip for r in out)

import random

import corpus_pipeline
import pytest

from tagwell.llm import secrets_crf, shingle_join

ENGLISH = "the cat and the dog went with this that they will have from there their what about would which could"

CLASHING = "_text string, of int, times int, copy int, lang_pred string, key long, row string, size int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(ENGLISH.split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))
    rows = [(i, text(rng.randint(20, 90)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(10)]  # copies
    rows += [(200, rows[20][1] + " more", "en", "s0", 1), (300, None, None, None, None), (301, "", None, "s1", 0), (302, "123 456", None, "s1", 7), (303, rows[21][1] + " password=hunter2hunter2 " + text(30), "en", "s1", 1), (None, text(30), "en", None, 1)]
    out = str(tmp_path_factory.mktemp("sf"))
    rows = [(*r, "other text", 1, 2, 3, "xx", 4, "row", 5) for r in rows]  # names that stages use inside
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").write.parquet(f"{out}/documents.parquet")
    return out


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *(c.split()[0] for c in CLASHING.split(", "))]
        assert all(tuple(r)[5:] == ("other text", 1, 2, 3, "xx", 4, "row", 5) for r in docs.collect())
        at[name] = docs.collect()
    ids = lambda name: {r.doc_id for r in at[name]}
    assert ids("language_id") == {*range(60), *range(100, 110), 200, 303, None}
    assert ids("ngram_jaccard") == {*range(60), 303, None} and len(at["ngram_jaccard"]) == 62
    assert not any(secrets_crf.base_spans(r.text) for r in at["secret_scan"]) and ids("secret_scan") == ids("ngram_jaccard")
    assert "[secret]" in next(r.text for r in at["secret_scan"] if r.doc_id == 303)
    assert ids("source_mix") <= ids("secret_scan") and len(at["source_mix"]) > 30
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in at["source_mix"])


def test_near_copies_that_no_pivot_joins_give_no_row_for_each_pair(spark, monkeypatch):
    made = []

    def cut(df, old=shingle_join.cut):
        out = old(df)
        made.extend([out.count()] if out.columns == ["a", "b"] else [])
        return out

    monkeypatch.setattr(shingle_join, "cut", cut)
    monkeypatch.setattr(shingle_join, "verified", lambda pairs, sets: pairs.select("a", "b").where("false"))
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words[: 3 * k], f"x{k}", *words[3 * k + 1 :]]), "en", "s", 1) for k in range(60)] + [(99, " ".join(words[::-1]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 99]
    assert made[-1] == 59  # the links of the group, 1,770, as one component


def test_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_without_doc_id_and_ids_with_several_texts(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(ENGLISH.split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))
    a, b, c = text(60), text(60), text(60)
    rows = [(None, a, "s0"), (None, a + " more", "s0"), (None, a, "s0"), (1, b, "s0"), (2, b, "s0"), (2, c, "s0"), (None, b + " more", "s0"), (None, "", "s0"), (None, "", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == sorted([(1, b), (2, c)])
    assert sum(r.doc_id is None and r.text.startswith(a) for r in kept) == 1 and sum(r.text == "" for r in kept) == 2 and len(kept) == 5
    many = spark.createDataFrame([(None if i % 2 else i, text(rng.randint(5, 60)), f"s{i % 3}") for i in range(90)] + rows[:1] * 2, "doc_id long, text string, source string")
    out = corpus_pipeline.mixed(spark, many, "").collect()
    want = corpus_pipeline.source_mix.mix(corpus_pipeline.keyed(many).withColumn("doc_id", corpus_pipeline.F.col("_key"))).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in want)


def test_text_without_a_known_language_goes_and_short_clean_text_stays(spark, sf_dir):
    rng = random.Random(3)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    learned = [(i, " ".join(rng.choice(ENGLISH.split()) for _ in range(40)), "en") for i in range(80)]
    judged = [(1001, "the cat", None), (1002, "this dog would.", None), (1003, letters(120), None), (1004, "съешь же ещё этих мягких французских булок, да выпей чаю " * 3, None), (1005, "with them " * 2000, None)]
    docs = spark.createDataFrame(learned + judged, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept == {*range(80), 1001, 1002, 1005}

import binascii

import numpy as np
import pytest

from tagwell.llm import language_id as li

WORDS = {"en": "the cat and dog with this that have from they will would there their what about", "de": "der hund und die katze nicht sich auch eine schön für über können werden haben", "fr": "le chat et les chiens une dans pour est avec été où français vous nous cette"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split(), 40)), lang, "s") for i in range(240) for lang in [list(WORDS)[i % 3]]]
    rows += [(1000, None, "en", None), (1001, "", None, "x"), (1002, "12 34 --", "de", "x"), (None, "the cat and", "en", "x"), (1003, "the dog " * 20_000, None, "x"), (1003, "the dog " * 20_000, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(li.labelled_part(docs))


def test_held_out_accuracy(docs, model):
    got = {(r.doc_id, r.text): r for r in li.identify(docs, *model).collect()}
    judged = [r for r in got.values() if r.lang and r.doc_id is not None and r.doc_id < 1000 and binascii.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(judged) > 20 and sum(r.lang == r.lang_pred for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r.lang_score <= 1 for r in got.values())


def test_nulls_letters_repeats(docs, model):
    rows = li.identify(docs.where("doc_id >= 1000 or doc_id is null"), *model, keep=["doc_id"]).collect()
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in rows}
    assert len(rows) == 6 and got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert got[1003][0] == "en" and got[None][0] == "en"


def test_held_out_and_learning(docs):
    ids = {r.doc_id for r in li.labelled_part(docs).collect()}
    assert ids == {r.doc_id for r in docs.collect() if r.doc_id is not None and binascii.crc32(str(r.doc_id).encode()) % 4 != 2}


def test_cosine_against_vectors_built_letter_by_letter(model):
    langs, prototypes = model
    letters = np.random.default_rng(li.SEED).choice(np.array([-1, 1], np.int8), (li.SYMBOLS, li.DIMENSION)).astype(int)
    text = "the cät 9 sat"
    s = [li.symbol(ord(c)) for c in f" {text} "]
    vector = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:]) if b)
    cosines = prototypes @ vector / np.linalg.norm(vector)
    lang, score = li.judge(text, langs, prototypes)
    assert lang == langs[int(np.argmax(cosines))] and abs(score - max(0, cosines.max())) < 1e-4


def test_nothing_to_learn_and_empty_tables(spark, docs):
    langs, prototypes = li.fit(docs.where("false"))
    assert langs == [] and {r.lang_pred for r in li.identify(docs.limit(3), langs, prototypes).collect()} == {"und"}
    assert li.identify(docs.where("false"), ["en"], np.ones((1, li.DIMENSION), np.float32)).collect() == []

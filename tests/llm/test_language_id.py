import random

import numpy as np

from courtside.llm.language_id import CHARS, DIMS, accepted, count_grams, fit, identify, letters, query

WORDS = {"aa": "the and of to in that was for with his".split(), "bb": "der die und das nicht von mit sich auf ein".split(),
         "cc": "быть этот который мочь человек".split(), "dd": "の に は を た が で".split()}


def text_of(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice(WORDS[lang])]) for _ in range(n)).capitalize() + "."


def table(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, text_of(rng, lang, rng.choice([3, 8, 40])), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "123 !!", "aa"), (n + 3, "the and of", None), (None, "der die das und", "bb"),
             (7, "the and of that", "aa"), (7, "the and of that", "aa")]
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_counts_do_not_depend_on_batches():
    rng = random.Random(3)
    texts = [text_of(rng, rng.choice(list(WORDS)), rng.choice([0, 1, 50])) for _ in range(600)] + [None, "", "!!", "é", "😀a𝒜"]
    together = count_grams(texts)
    for i in rng.sample(range(len(texts)), 60):
        assert (together[i] == count_grams([texts[i]])[0]).all()
    assert together.shape == (len(texts), DIMS) and not together[-3].any()


def test_long_texts_are_counted_whole():
    word = "abcd "
    long = count_grams([word * (CHARS // 2)])[0]
    assert (long == count_grams([word])[0] * (CHARS // 2)).all()


def test_letters_are_lowered_and_marks_dropped():
    assert "".join(chr(c) if c else "_" for c in letters("Ab-É1ß Жx")) == "ab_é_ß_жx"


def test_held_out_rows_are_recognised(spark):
    docs = table(spark).repartition(3)
    got = query(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == docs.count()
    judged = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(judged) > 50 and np.mean(judged) > 0.95
    by = {r["doc_id"]: r for r in got}
    for odd in (400, 401, 402):
        assert by[odd]["lang_pred"] == "und" and by[odd]["score"] == 0 and by[odd]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_strange_texts_are_rejected_and_others_stay(spark):
    docs = table(spark)
    model = fit(docs)
    strange = spark.createDataFrame([(1, "ქართული ენა არის ძალიან ძველი ენა და აქვს საკუთარი დამწერლობა რომელიც ლამაზია"), (2, "the and that with"), (3, None), (4, "??")], "doc_id long, text string")
    assert [r["doc_id"] for r in accepted(strange, model).collect()] == [2]
    kept = accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = fit(docs)
    assert identify(docs, model).collect()[0]["lang_pred"] == "und"
    assert query(docs.limit(0)).count() == 0

import pytest

from courtside.llm.licenses import NONE, TEMPLATES, UNKNOWN, examples, fit, fit_on, licenses, may_win, scored

FILLER = ["Thstinnt thndhain onhalyti.", "The code is in the cellar of the house.", "Nothing to see here at all.", "Eaux de la mer."]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, f"{FILLER[i % 4]} {i}\n{FILLER[(i + 1) % 4]}") for i in range(200)], "doc_id long, text string")
    return fit(docs).cache()


def test_families_are_named_and_confirmed(spark, model):
    rows = [(i, f"{FILLER[i % 4]}\n{t}\n{FILLER[(i + 1) % 4]}", f) for i, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, family string, paragraph int")
    got = {r["doc_id"]: r for r in licenses(docs, model).collect()}
    right = [got[i]["family"] == f and got[i]["confirmed"] and got[i]["paragraph"] == 1 for i, _, f in rows if i in got]
    assert len(right) >= len(rows) - 1 and sum(right) >= 0.9 * len(rows)


def test_variants_and_strangers(spark, model):
    docs = spark.createDataFrame([
        (1, "This project is licensed under the apache license, version 2.0"), (2, "Distributed under the MIT License"),
        (3, "Released under the Wibble Wobble shareware license of the moon."), (4, FILLER[1]), (5, None), (6, ""),
        (7, "x " * 50000 + "\nLicensed under CC BY-NC 4.0."), (7, "x " * 50000 + "\nLicensed under CC BY-NC 4.0."),
        (8, "We reviewed the fishing license at the office.")], "doc_id long, text string")
    got = [(r["doc_id"], r["family"], r["confirmed"]) for r in licenses(docs, model).collect()]
    assert (1, "apache", True) in got and (2, "mit", True) in got and got.count((7, "cc-by-nc", True)) == 2
    assert not any(d in (4, 5, 6) for d, _, _ in got)
    assert all(f == UNKNOWN and not c for d, f, c in got if d in (3, 8))


def test_a_line_without_a_known_gram_is_judged_by_the_intercepts(spark, model):
    lines = spark.createDataFrame([(0, 0, "Copyleft."), (0, 1, "!!!"), (1, 0, "Released under the MIT License.")], "row long, paragraph int, text string")
    got = {(r["row"], r["paragraph"]): r for r in scored(lines, model).collect()}
    assert len(got) == 3 and got[0, 0]["family"] == got[0, 1]["family"] and got[1, 0]["family"] == "mit"
    assert got[0, 0]["probability"] == got[0, 1]["probability"]


def test_short_names_and_other_languages(spark, model):
    wanted = {"Released under MIT.": "mit", "GPLv3": "gpl", "BSD-3-Clause": "bsd", "This is distributed under MPL-2.0": "mpl", "LGPLv2.1": "lgpl",
              "CC0 1.0 Universal": "public-domain", "Code unter der MIT-Lizenz.": "mit", "Publicado bajo licencia MIT.": "mit",
              "Publié sous licence GPLv3": "gpl", "Veröffentlicht unter der Lizenz Apache-2.0.": "apache",
              "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc"}
    docs = spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licenses(docs, model).collect()}
    assert [(t, got.get(i)) for i, t in enumerate(wanted)] == list(wanted.items())


def test_no_line_is_lost_by_the_bound(spark, model):
    """The query's rows are those of all lines, by the weights in plain Python."""
    import math
    import random
    import re

    rng = random.Random(5)
    told = [t for ts in TEMPLATES.values() for t in ts] + FILLER + ["The warranty of the vendor.", "MIT", "software", "He lost a license to use the program in May."]
    words = [w for t in told for w in t.split()]
    texts = told + [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(600)]
    rows = {r["gram"]: r["weights"] for r in model.collect()}
    classes = sorted([*TEMPLATES, UNKNOWN, NONE])

    def best(text):
        w = re.findall(r"[^\W\d_]+|\d+", text.lower())
        z = list(rows[""])
        for g in {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))} & set(rows):
            z = [a + b for a, b in zip(z, rows[g])]
        return classes[z.index(max(z))], 1 / sum(math.exp(a - max(z)) for a in z)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["probability"] for r in licenses(docs, model).collect()}
    wanted = {i: p for i, (c, p) in enumerate(map(best, texts)) if c != NONE}
    assert set(got) == set(wanted) and all(abs(got[i] - p) < 2e-6 for i, p in wanted.items())
    assert not docs.select(may_win(model, docs.text).alias("x"), "doc_id").filter("not x").filter(docs.doc_id.isin(list(wanted))).count()


def test_held_out_templates(spark):
    """Recall on templates, and everything made from them, that the model never saw."""
    docs = spark.createDataFrame([(i, f"{FILLER[i % 4]} {i}") for i in range(200)], "doc_id long, text string")
    rows = examples(docs)
    known = [w for f, ts in TEMPLATES.items() for w in ts]
    hidden = rows.filter("made and pmod(xxhash64(origin, 3), 5) = 0")
    model = fit_on(rows.filter("not made or pmod(xxhash64(origin, 3), 5) != 0"))
    asked = hidden.filter(~hidden.label.isin(NONE, UNKNOWN)).collect()
    judged = {r["row"]: r["family"] for r in scored(spark.createDataFrame(
        [(i, 0, r["text"]) for i, r in enumerate(asked)], "row long, paragraph int, text string"), model).collect()}
    found = sum(judged[i] != NONE for i in range(len(asked)))
    right = sum(judged[i] == r["label"] for i, r in enumerate(asked))
    print("held out", len(asked), "reported", found, "right family", right, "of", len(known))
    assert len(asked) >= 100 and found >= 0.9 * len(asked) and right >= 0.85 * len(asked)


def test_extra_columns_with_clashing_names_and_repeats(spark, model):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 5, "x", 2.0)] * 2 + [(None, None, None, None, None)],
                                 "doc_id long, text string, row long, gram string, paragraph double")
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in licenses(docs, model).collect()] == [(1, 0, "mit")] * 2


def test_empty_table(spark):
    assert licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import random
import re

from courtside.llm import pii
from courtside.llm.pii import _luhn, _mod97, canonical, mentions, pseudonymised, replaced, surrogate, written

KEY = b"test"
TEXT = ("Write A.b7@Mail9.example.com or a.B7@mail9.example.com, call +1 (692) 555-7565 or +1-692-555-7565, 69.186.48.130, 10.0.0.7, "
        "4111 1111 1111 1111 and 4080250821787625, 078-05-1120, DE89 3704 0044 0532 0130 00. Mr. John Smith and Frau Müller; "
        "Г-жа Анна Иванова. token = \"1c5c31775edb0e97c8e972c4a50a0d9e0560c638\" 2024-10-12 v1.2.3.4.5 price 1234567 id_12345678901234")


def kinds(text):
    return [m[0] for m in mentions(text)]


def test_mentions_and_what_is_none():
    assert kinds(TEXT) == ["email"] * 2 + ["phone"] * 2 + ["ip"] * 2 + ["card"] * 2 + ["ssn", "iban", "name", "name", "name"]
    assert kinds(None) == kinds("") == kinds("2024-10-12 at 10:30, 3.14, 1,000,000 and @home") == []


def test_national_phones():
    phones = ["01 42 68 53 00", "+33 1 42 68 53 00", "06.12.34.56.78", "+34 912 34 56 78", "912 34 56 78", "91 234 56 78", "0171 1234567",
              "(030) 12 34 56 78", "+49 (0)30 123456", "089/12345678", "0612345678", "+442079460958", "0033 1 42 68 53"]
    for phone in phones:
        for text in (phone, f"Tel. {phone}, bis 17.00", f"({phone})."):
            (kind, entity, start, end), = [m for m in mentions(text)]
            assert kind == "phone" and entity.lstrip("+") == re.sub(r"\D", "", phone)
            for counter in range(30):
                new = replaced(text, {(kind, entity): surrogate(KEY, kind, entity, counter)})
                assert kinds(new) == ["phone"] and len(new) == len(text) and re.sub(r"\d", "", new) == re.sub(r"\d", "", text)
    assert kinds("05.12.2024 10:30, 05/12/2024, 05 12 2024, 05.12.24 10.30, 08.30-17.00, 2024-10-12 10:30, v10.12.3, 1 000 000,00, 12.345.678,90, 0.12345678") == []


def test_a_name_is_one_entity_under_any_title_of_its_gender():
    text = "Mr. Smith, Mr Smith, Herr Smith; Mrs Smith, Ms. Smith"
    known = {(k, e): surrogate(KEY, k, e, 0) for k, e, _, _ in mentions(text)}
    assert len(known) == 2
    names = [m.split(" ") for m in re.split("[,;] ", replaced(text, known))]
    assert [n[0] for n in names] == ["Mr.", "Mr", "Herr", "Mrs", "Ms."]
    assert len({n[1] for n in names[:3]}) == len({n[1] for n in names[3:]}) == 1 and names[0][1] != "Smith"


def test_surrogates_keep_kind_and_format():
    for counter in range(30):
        known = {(k, e): surrogate(KEY, k, e, counter) for k, e, _, _ in mentions(TEXT)}
        new = replaced(TEXT, known)
        assert kinds(new) == kinds(TEXT)
        assert [(k, e) for k, e, _, _ in mentions(new)] == [(k, canonical(k, written(k, TEXT[s:t], known[k, e])))
                                                            for k, e, s, t in mentions(TEXT)]
        old, put = ([m[1] for m in mentions(t)] for t in (TEXT, new))
        assert put[0] == put[1] and put[2] == put[3] and put[5].startswith("10.") and not set(old) & set(put)
        assert _luhn(put[6]) == 0 and put[6][0] == "4" and len(put[7]) == 16
        assert put[9][:2] == "DE" and _mod97("DE", put[9][4:]) + int(put[9][2:4]) == 98
        assert put[10].split()[0] == "Mr." and put[10].split()[1] in pii.GIVEN["latin", "m"]
        assert put[12].split()[1] in pii.GIVEN["cyrillic", "f"] and re.fullmatch("[А-я]+", put[12].split()[2])
        assert new.endswith(TEXT[TEXT.index(" token"):])


def test_distinct_and_coreferent_over_the_corpus(spark):
    rng = random.Random(2)
    hot = "call 555-010-2000 now"
    rows = [(i, f"mail u{rng.randrange(200)}@a.example.com or ip 10.{rng.randrange(3)}.0.{rng.randrange(200)}, ok") for i in range(400)]
    rows += [(1000 + i, hot) for i in range(200)] + [(2005, None), (2006, ""), (2007, "clean text"), (None, hot), (2008, "Mr. Max Meier " * 3000)]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "x") for r in rows],
                                 "doc_id long, text string, n_chars long, __entity string").repartition(3)
    out = pseudonymised(docs, KEY)
    got = out.collect()
    assert out.columns == docs.columns and len(got) == len(rows)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got)
    new = {r["doc_id"]: r["text"] for r in got}
    assert new[2005] is None and new[2006] == "" and new[2007] == "clean text" and new[None] == new[1000] == new[1199] != hot
    image = {}
    for i, text in rows[:400]:
        for a, b in zip(mentions(text), mentions(new[i]), strict=True):
            image.setdefault(a[:2], set()).add(b[:2])
    assert all(len(v) == 1 for v in image.values())
    images = [next(iter(v)) for v in image.values()]
    assert len(set(images)) == len(images) and not set(images) & set(image)


def test_colliding_draws_are_drawn_again(spark, tmp_path, monkeypatch):
    entities = spark.createDataFrame([("n", f"e{i}") for i in range(30)] + [("n", "7"), ("n", "8")], "kind string, entity string")
    from pyspark.sql import functions as F

    def draw(key):
        return lambda kind, entity, counter: F.pmod(F.xxhash64(entity, counter), F.lit(60)).cast("string")

    monkeypatch.setattr(pii, "_draw", draw)
    got = pii.surrogates(entities, KEY, str(tmp_path / "s")).collect()
    put = [r["surrogate"] for r in got]
    assert len(got) == 32 and len(set(put)) == 32 and not {"7", "8"} & set(put)


def test_a_full_space_is_widened(spark):
    docs = spark.createDataFrame([(i, f"{i}@example.com") for i in range(10)], "doc_id long, text string")
    new = {r["text"] for r in pseudonymised(docs, KEY).collect()}
    assert len(new) == 10 and all(kinds(t) == ["email"] and t.endswith("@example.com") for t in new)
    assert not new & {f"{i}@example.com" for i in range(10)}


def test_empty_table(spark):
    assert pseudonymised(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from courtside.llm.tokens import ID
from tests.llm.test_language_id import WORDS, text_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(4)
    rows = [(i, text_of(rng, lang, rng.choice([20, 60])), lang) for i in range(200) for lang in [rng.choice(list(WORDS))]]
    item = text_of(rng, "aa", 30)
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]                        # copies
    rows += [(400, text_of(rng, "aa", 40) + " mail me: a.b@c.example.com and the rest", "aa"),
             (299, rows[199][1].replace(" ", "  "), rows[199][2]), (298, rows[198][1] + " and", rows[198][2]),  # near copies
             (401, text_of(rng, "bb", 50) + " call +1 (692) 555-7565 now", "bb"),
             (402, "the and of to that. " + item.upper() + " for with his.", "aa"),       # a test item
             (403, None, "aa"), (404, "", "bb"), (405, "12345 !!", "aa"),                 # no language
             (406, "ქართული ენა არის ძალიან ძველი ენა და აქვს საკუთარი დამწერლობა რომელიც ლამაზია", None)]
    return [(*r, "s", len(r[1] or "")) for r in rows], item


def test_each_stage_works_on_what_the_last_one_kept(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "something else entirely than this text")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept["language ID"]) == set(before) - {403, 404, 405, 406}
    assert set(kept["near duplicates"]) == set(kept["language ID"]) - {298, 299, *range(300, 320)}
    assert set(kept["decontamination"]) == set(kept["near duplicates"]) - {402}
    clean = kept["personal data"]
    assert set(clean) == set(kept["decontamination"])
    for doc, row in clean.items():
        assert (row["text"] == before[doc]["text"]) == (doc not in (400, 401)) and row["n_chars"] == len(row["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        ids[p["doc_id"]] = ids.get(p["doc_id"], b"") + p["ids"]
    assert {d: np.frombuffer(i, ID).tolist() for d, i in ids.items()} == {
        d: library.encode(r["text"], add_special_tokens=False).ids + [2] for d, r in clean.items()}


def test_run_is_the_stages_in_a_row(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {*range(200), 400, 401}

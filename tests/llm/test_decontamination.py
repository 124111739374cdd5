import random

import pytest

from courtside.llm import decontamination
from courtside.llm.decontamination import GRAM, ItemIndex, contaminated, decontaminate, grams, item_indexes, words


def brute(index, text):
    """Every item against every passage, without an index."""
    tokens, out = words(text), set()
    for low in range(0, max(1, len(tokens)), index.stride):
        own = tokens[low:low + 2 * index.stride]
        here = {index.terms.get(w, -1) for w in own}
        for i, weights in enumerate(index.weights):
            if sum(s for t, s in weights.items() if t in here) < index.share - 1e-9:
                continue
            question, answer, nq, na = index.parts[i]
            q = len(question & grams(own, min(GRAM, nq))) / len(question)
            a = len(answer & grams(own, min(GRAM, na))) / len(answer) if na else 1
            if q >= index.overlap and a >= index.overlap:
                out.add(index.items[i])
    return out


def items_and_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.4)) % 500}" for _ in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 6, 20, 45]))) + rng.choice(["", "\nanswer is " + rng.choice(vocabulary)]))
             for i in range(60)]
    texts = []
    for _ in range(80):
        body = rng.choices(vocabulary, k=rng.choice([0, 5, 60, 400]))
        if rng.random() < 0.6:
            at = rng.randrange(len(body) + 1)
            leak = rng.choice(items)[1].replace("\n", rng.choice([" ", "\n", ". "]))
            body[at:at] = leak.upper().split(" ") if rng.random() < 0.3 else leak.split(" ")
        texts.append(" ".join(body))
    return items, [*texts, None, "", " .,; ", *[t for _, t in items[:5]]]


@pytest.mark.parametrize("share", [0.0, 0.4, 0.6, 1.0])
def test_pruned_search_finds_what_all_pairs_find(share):
    for seed in range(4):
        items, texts = items_and_texts(seed)
        index = ItemIndex(items, share, 0.8)
        got = [{index.items[i] for i in found} for found in index.hits(texts)]
        assert got == [brute(index, t) for t in texts]


def test_an_edited_copy_is_found():
    rng = random.Random(5)
    items = [(n, " ".join(f"v{rng.randrange(3000)}" for _ in range(n))) for n in range(15, 60)]
    lines = [(n, text.replace(" ", "\n", 1)[::-1].replace(" ", "\n", 1)[::-1]) for n, text in items]  # a last line of one word
    filler = " ".join(f"f{i}" for i in range(130)).split()
    for index in (ItemIndex(items, 0.6, 0.8), ItemIndex(lines, 0.6, 0.8)):
        for n, text in items:
            copy = text.split()
            for at in {1, n // 3, n // 2, n - 1}:
                for new in (copy[:at] + ["other"] + copy[at + 1:], copy[:at] + copy[at + 1:], copy[:at] + ["other"] + copy[at:]):
                    low = rng.randrange(131)
                    assert n in {index.items[i] for i in index.hits([" ".join(filler[:low] + new + filler[low:])])[0]}
            rng.shuffle(copy)
            assert not index.hits([" ".join(copy)])[0]
    asked = ItemIndex([(1, f"{items[20][1]}\nAnswer: seven")], 0.6, 0.8)
    assert asked.hits([f"{items[20][1]} seven"])[0] and not asked.hits([f"{items[20][1]} eight"])[0]


def test_report_and_filter_agree(spark):
    items, texts = items_and_texts(9)
    docs = spark.createDataFrame([(i if i != 3 else None, t, "en", i) for i, t in enumerate(texts)],
                                 "doc_id long, text string, item_id string, score int").repartition(3)
    bench = spark.createDataFrame([*items, (None, items[0][1]), (99, None), (98, "")], "item_id long, text string")
    hits = contaminated(docs, bench).collect()
    index = ItemIndex([*items, (None, items[0][1])], 0.6, 0.8)
    assert {(h["doc_id"], h["item_id"]) for h in hits} == {
        (i if i != 3 else None, item) for i, t in enumerate(texts) for item in brute(index, t)}
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["score"] for r in clean.collect()) == [i for i, t in enumerate(texts) if not brute(index, t)]


def test_results_do_not_depend_on_the_number_of_indexes(spark):
    items, texts = items_and_texts(11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = [*items, (None, items[0][1]), (99, None), (98, ""), (97, items[7][1]), (97, items[7][1])]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    size = sum(len(t.encode()) for _, t in rows if t)
    assert len(list(item_indexes(bench, 0.6, 0.8, size // 5 + 1))) == 5
    one, five = (sorted(((h["doc_id"], h["item_id"] or -1, round(h["score"], 9), h["question_overlap"], h["answer_overlap"], h["first_word"])
                         for h in contaminated(docs, bench, index_bytes=n).collect())) for n in (1 << 25, size // 5 + 1))
    assert one == five and len(one) > 20
    left = [sorted(r["doc_id"] for r in decontaminate(docs, bench, index_bytes=n).collect()) for n in (1 << 25, size // 5 + 1)]
    assert left[0] == left[1] == sorted(set(range(len(texts))) - {h[0] for h in one})


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).count() == 0 and decontaminate(docs, none).count() == 1
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated(docs.limit(0), some).count() == 0 and decontaminate(docs, some).count() == 0


def test_a_task_matches_few_texts_at_once():
    sizes = []

    class Index:
        items = [1]

        def hits(self, texts):
            sizes.append(sum(map(len, texts)))
            return [{} for _ in texts]

    class Broadcast:
        value = Index()

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["word " * 60_000] * 4})
    for run in (decontamination._clean, decontamination._report):
        sizes.clear()
        list(run(Broadcast())(iter([batch])))
        assert sum(sizes) == 1_200_000 and max(sizes) <= 600_000

"""Cases in which words, links or items once got lost."""

import random

from pyspark.sql import functions as F

from vitrine.llm import decontamination, language_id, near_duplicates, toxicity


def scored(spark, lexicon, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = toxicity.score_toxicity(docs, lexicon).orderBy("doc_id").collect()
    return [(r.n_hits, r.hit_weight) for r in rows]


def test_entries_of_one_text_keep_their_meanings(spark):
    lexicon = toxicity.Lexicon({"moron": 3.0, "dolt": 1.5}, {"moron": 2.0, "scum": 1.0, "dolt": 2.5}, ("scum", "dolt"))
    got = scored(spark, lexicon, ["morons", "moron", "scumbag", "scum", "dolts", "dolt", "a scum scumbag"])
    assert got == [(1, 2.0), (1, 3.0), (1, 1.0), (0, 0.0), (1, 2.5), (0, 0.0), (1, 1.0)]


def test_folding_word_by_word(spark):
    texts = ["idio7", "clown5 7", "moron! idi0t", "M0R0N", "A8E 10.50 2024", "ok!!", "m0ron!\nfine|", "12 34", None, "€uro $tupid"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(toxicity.fold(F.col("text")).alias("t"))
    assert [r.t for r in df.collect()] == ["idiot", "clowns 7", "moron! idiot", "moron", "abe 10.50 2024", "ok!!", "moron!\nfine|", "12 34", "", "euro stupid"]


def test_links_of_a_repeated_doc_id(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, words(1)), (1, words(2)), (2, words(1) + " tail"), (3, words(2) + " tail"), (4, words(4)), (4, words(4)), (None, words(5)), (5, words(5) + " tail"), (6, words(6))]
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 0.85)
    got = sorted((r.doc_id, r.component_id) for r in out.collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 6)]


def test_recall_by_item_size(spark):
    """Every item of one to eight shingles is found in a long document, and nearly every larger one, whole or at the threshold."""
    dice = random.Random(9)
    word = lambda: f"v{dice.randrange(5000)}"
    items, text, sizes = [], [], {}
    for i in range(1200):
        n = dice.choice([1, 2, 3, 5, 8, 9, 16, 40])
        own = [word() for _ in range(n + 4)]
        items.append((i, " ".join(own)))
        sizes[i] = n
        text += [word() for _ in range(dice.randrange(0, 40))] + own
    docs = spark.createDataFrame([(7, " ".join(text))], "doc_id long, text string")
    found = {r.item_id for r in decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    missed = [sizes[i] for i in sizes if i not in found]
    assert all(n > decontamination.SMALLEST for n in missed) and len(missed) <= 1


def test_language_sample_takes_each_text_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, langs: seen.extend(zip(langs, texts)))
    rows = [("en", "the same text again")] * 300 + [("en", f"text number {i} of many") for i in range(5)] + [("de", None), (None, "x"), ("de", "123"), ("fr", "un")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    language_id.fit(docs, train_docs=4)
    assert len(seen) == len(set(seen)) == 5 and ("fr", b"un") in seen
    seen.clear()
    language_id.fit(docs, train_docs=100)
    assert len(seen) == len(set(seen)) == 7 and ("en", b"the same text again") in seen

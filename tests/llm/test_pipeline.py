"""The pipeline against a stage-by-stage brute force of its decisions."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import toxicity

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, lexicon).collect() if r.toxicity >= corpus_pipeline.TOXIC_FROM}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    sets, root = {i: shingles(t) for i, t in text.items()}, {i: i for i in text}
    for a in sorted(text):
        for b in sorted(text):
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    stay = {i for i in text if root[i] == i and not any(s and len(s & sets[i]) >= 0.8 * len(s) for s in items)}
    out = corpus_pipeline.run(spark, SF)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == stay and 0 < len(stay) < docs.count()
    assert all((got[i].text == text[i]) or re.search("[0-9@]", text[i]) for i in stay)
    total = sum(r.size for r in got.values())
    assert abs(sum(r.taken for r in got.values()) - 1.5 * total) <= len(got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pseudonyms", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).schema.names == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_stages_on_odd_rows(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(3).collect()
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in plain]
    rows += [(9001, None, None, None, None), (None, None, None, None, None), (None, "nothing here", "en", None, 12), (9002, "", "en", "s", 0)]
    rows += [(9003, long, "en", "s", len(long)), (9004, "the same row twice", "en", "s", 18), (9004, "the same row twice", "en", "s", 18)]
    names = ["kept", "component_id", "score", "n_shingles", "hash", "part", "word", "label", "held_out"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *("mine" for _ in names)) for r in rows], schema).repartition(3)
    want = sorted((r[0] or -1, r[1] or "", r[4] or 0) for r in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted((r.doc_id or -1, r.text or "", r.n_chars or 0) for r in got) == want, name
        assert all(r[n] == "mine" for r in got for n in names), name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs.withColumn("size", F.lit("mine")), SF)
    got = mixed.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [w[:2] for w in want] and all(r[n] == "mine" for r in got for n in names)
    assert all(r.taken == 0 for r in got if not r.text) and {r.size for r in got if r.doc_id == 9003} == {200_000}

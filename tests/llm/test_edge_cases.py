"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every corpus operator."""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import class_model, decontamination, grid_join, language_id, mixing, near_duplicates, pseudonyms, repeats, toxicity, web_archives

DOCS = "doc_id long, text string, lang string, source string, n_chars long, weight double, schedule string, words int, first string, kept string, part int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def rows():
    texts = [
        (1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, " \t\n "), (6, "two words"), (7, "Two WORDS"),
        (8, LONG), (9, LONG + " tail"), (None, "nameless text of seven words in all"), (10, "straße übung höhe an der tür"), (11, "12 34 !!"), (12, "é" * 60),
        (13, "call +1 (017) 555-7713 or idiot@example.com, card 4539578763621486, not 4539578763621487, from 10.2.3.4 on 2024-02-29"),
    ]
    return [(i, t, "en" if i and i % 2 else None, None if i == 5 else f"s{(i or 0) % 3}", 1, 0.5, "x", 7, "f", "k", 0) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_pseudonyms(spark, docs, empty):
    out = pseudonyms.pseudonymise(docs, "key")
    assert pseudonyms.pseudonymise(empty, "key").count() == 0
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs.columns, "n_pii", "pii_kinds"] and out.count() == docs.count()
    for r in docs.collect():
        if r.doc_id != 13:
            assert got[r.doc_id].text == r.text and got[r.doc_id].n_pii == 0
    new = got[13]
    assert list(new.pii_kinds) == ["phone", "email", "card", "ip", "date"]
    assert "4539578763621487" in new.text and "@example.com" in new.text
    for gone in ("555-7713", "idiot@", "4539578763621486", "10.2.3.4", "2024-02-29"):
        assert gone not in new.text
    card = re.search(r"card (\d{16})", new.text)[1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, card[::-1]))) % 10 == 0
    twice = pseudonyms.pseudonymise(docs, "key").where("doc_id = 13").first().text
    other = pseudonyms.pseudonymise(docs, "another").where("doc_id = 13").first().text
    assert twice == new.text != other


def test_pseudonyms_are_permutations(spark):
    made = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert made.select(pseudonyms.permute_text(F.col("v"), "k", "t").alias("p")).distinct().count() == 1000
    pair = spark.range(17 * 43).select(pseudonyms.permute_pair(F.floor(F.col("id") / 43), F.col("id") % 43, (17, 43), "k", "t").alias("p"))
    assert pair.distinct().count() == 17 * 43
    ibans = spark.createDataFrame([("pay DE89 3704 0044 0532 0130 00 now",), ("pay DE88 3704 0044 0532 0130 00 now",)], "text string")
    first, second = [r.text for r in pseudonyms.pseudonymise(ibans, "k").collect()]
    plain = re.search(r"DE[0-9 ]+", first)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain != "DE89370400440532013000"
    assert second == "pay DE88 3704 0044 0532 0130 00 now"


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE, 1), (1, PASSAGE, 2), (2, None, 1), (None, PASSAGE, 1), (3, "", 1), (4, "TWO words", 1), (5, " ".join(LONG.split()[500:530]), 1)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (6, 4), (7, 4), (8, 5), (9, 5)]
    clean = decontamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(["3", "4", "5", "None", "10", "11", "12", "13"])
    assert decontamination.find_leaks(empty, items).count() == 0
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_near_duplicates(docs, empty):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got[1, 12] == (1, True) and got[2, 12] == (1, False)
    assert got[3, 0] == (3, True) and got[4, 0] == (4, True) and got[5, 0] == (5, True)
    assert got[6, 1] == (6, True) and got[7, 1] == (6, False)
    assert [v for (i, _), v in got.items() if i in (8, 9)] == [(8, True), (8, False)]
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "8", "10", "11", "12", "13", "None"])
    assert near_duplicates.near_duplicates(empty).count() == 0 and near_duplicates.drop_near_duplicates(empty).count() == 0


def test_blocks_of_a_large_bucket(spark, docs, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    base = [f"b{i}" for i in range(400)]
    texts = [(k, " ".join(base[:40 * k % 397] + [f"x{k}"] + base[40 * k % 397 + 1 :])) for k in range(10)]
    made = spark.createDataFrame([*texts, (20, " ".join(base))], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates.near_duplicates(made).collect()} == {0}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for true in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            n = 2000
            same = int(n * 2 * true / (1 + true))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[:same], rng.integers(0, 2**63, n - same).astype(np.uint64)])
            s = near_duplicates.odd_sketch(near_duplicates.minhash(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n])))
            errors.append(float(near_duplicates.odd_similarity(np.bitwise_count(s[0] ^ s[1]).sum(dtype=np.int64))) - true)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < near_duplicates.MARGIN


def test_mixing(spark, docs, empty):
    out = mixing.mix_sources(docs)
    assert set(docs.columns) < set(out.columns) and out.count() == docs.count()
    got = out.collect()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.size > 0 or r.taken == 0)
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size and sum(r.taken for r in own) == round(own[0].target)
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions)
    assert mixing.mix_sources(empty).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs.where("doc_id in (3, 4, 5)")).collect()} == {0}


def test_schedule_is_inverted(spark):
    knots = F.array(F.lit(0.5), F.lit(2.0), F.lit(0.0), F.lit(1.0))
    t = np.array([r[0] for r in spark.range(101).select(mixing.time_of(F.col("id") / 100, knots)).collect()])
    grid = np.linspace(0, 1, 300_001)
    rate = np.interp(grid, [0, 1 / 3, 2 / 3, 1], [0.5, 2.0, 0.0, 1.0])
    total = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
    assert np.allclose(np.interp(t, grid, total / total[-1]), np.arange(101) / 100, atol=1e-6)


def test_toxicity(spark, docs, empty):
    lexicon = toxicity.Lexicon({"idiot": 5.0, "scum": 4.0}, {"mor": 2.0}, ("scum of the pond", "morning"))
    texts = ["You IDIOT", "you 1d10t", "уоu іdiоt", "idiotic", "pond scum", "scum of the pond", "moron", "good morning", "humor", None, "", "x " * 50_000 + "idiot"]
    made = spark.createDataFrame([(i, t, 1.0, 2) for i, t in enumerate(texts)], "doc_id long, text string, weight double, n_hits int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(made, lexicon).collect()}
    assert [got[i].n_hits for i in range(12)] == [1, 1, 1, 0, 1, 0, 1, 0, 0, 0, 0, 1]
    assert got[0].toxicity > got[11].toxicity - 1e-12 and got[9].toxicity == got[10].toxicity
    kept = toxicity.drop_toxic(made, lexicon, 0.3)
    assert kept.columns == made.columns and {3, 5, 7, 8, 9, 10} <= {r.doc_id for r in kept.collect()}
    assert toxicity.score_toxicity(empty, lexicon).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 1), (2, 0, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    learned = toxicity.fit(docs, labels)
    assert not learned.words and toxicity.score_toxicity(docs, learned).count() == docs.count()
    assert toxicity.fit(empty, labels.limit(0)).words == {}


def test_archives(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\ny\r\n", "\r\n\r\n", "é" * 300_000, "<p>a</p>"]
    pages = spark.createDataFrame([(i if i != 6 else None, None if i == 3 else f"http://H{i % 2}.example/a?b=2&a=1#f", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in web_archives.archive_pages(pages).collect()}
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), got[i if i != 6 else None]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.intact
    assert [(got[i].record_type, got[i].refers_to) for i in (0, 1, 2, 3, 7)] == [("response", None), ("revisit", 0), ("response", None), ("revisit", 2), ("revisit", 0)]
    small = {r.page_id: r.record_type for r in web_archives.archive_pages(pages, 9).collect()}
    assert set(small.values()) == {"response"}
    assert web_archives.archive_pages(pages.limit(0)).count() == 0
    assert web_archives.url_key("HTTP://www.A.example:80/B?y=2&x=1#z") == "example,a)/b?x=1&y=2"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted((int(x), i) for x in rng.integers(0, 50, rng.integers(0, 40))) for i in range(k)]
    assert [r[0] for r in web_archives.LoserTree([iter(r) for r in runs])] == sorted(x[0] for r in runs for x in r)


def test_merged_index_of_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(web_archives, "RANGE_ROWS", 16)
    draw = np.random.default_rng(5)
    pick = lambda kinds: kinds[int(draw.integers(len(kinds)))]
    rows = [(pick([None, "", "com,a)/", "com,b)/x"]), pick([None, "2020", "2021"]), pick([None, 0, 1, 7]), "mine", -1) for _ in range(400)]
    schema = "urlkey string, timestamp string, page_id long, place string, range_no int"
    captures = spark.createDataFrame(rows, schema).repartition(5)
    merged = web_archives.merge_index(web_archives.capture_runs(captures))
    got = [tuple(r) for r in merged.orderBy("range_no", "place").select("urlkey", "timestamp", "page_id").collect()]
    last = lambda r: tuple((x is None, x or ("" if i < 2 else 0)) for i, x in enumerate(r))
    assert got == sorted((r[:3] for r in rows), key=last)
    assert merged.select("range_no").distinct().count() > 8 and merged.groupBy("range_no").count().agg({"count": "max"}).first()[0] < 200
    assert web_archives.merge_index(web_archives.capture_runs(spark.createDataFrame([], schema))).count() == 0


def test_archives_of_repeated_and_null_pages(spark, tmp_path):
    pages = [(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (None, "c", "x"), (3, None, None), (4, "d", None), (2, "b", "y"), (5, "e", "y")]
    web_archives.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    got = web_archives.read_archives(spark, str(tmp_path / "w")).select("page_id", "record_type", "refers_to", "payload_bytes").collect()
    kinds = sorted((r[0] or 0, *r[1:3], r[3]) for r in got)
    assert [k[:2] + (k[3],) for k in kinds] == [(0, "response", 1), (1, "response", 1), (1, "response", 1), (2, "response", 1), (2, "revisit", 1), (3, "response", 0), (4, "revisit", 0), (5, "revisit", 1)]
    assert {(k[0], k[2]) for k in kinds if k[1] == "revisit"} == {(2, 1), (4, 3), (5, 2)}


def test_similar_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=6)
    vectors = [list(map(float, centre + rng.normal(size=6) * 0.1)) for _ in range(40)] + [list(map(float, rng.normal(size=6))) for _ in range(40)]
    table = [(i, v) for i, v in enumerate(vectors)] + [(80, vectors[0]), (81, vectors[0]), (82, None), (83, []), (84, [0.0] * 6), (85, [float("nan")] * 6), (86, [None, 1.0]), (87, [float("inf")] * 6), (88, [1.0]), (89, [2.0]), (90, [-1.0])]
    got = {r.vec_id: r for r in grid_join.similar_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumns({"label": F.lit(None), "n": F.lit(1)})).collect()}
    assert len(got) == len(table)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in table if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: [j for j, b in unit.items() if j != i and len(a) == len(b) and a @ b >= 0.95] for i, a in unit.items()}
    low = {i: i for i, _ in table}
    for _ in range(100):
        low = {i: min([low[i], *(low[j] for j in links.get(i, []))]) for i in low}
    for i, _ in table:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, [])), low[i], low[i] == i)
    assert grid_join.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_grid_join_over_many_blocks(spark, monkeypatch):
    """Blocks of five rows in ranges of two blocks: the same links as brute force, and far blocks never meet."""
    monkeypatch.setattr(grid_join, "BLOCK", 5)
    monkeypatch.setattr(grid_join, "RANGE_BLOCKS", 2)
    rng = np.random.default_rng(3)
    points = np.vstack([np.eye(6)[k % 6] + rng.normal(size=6) * 0.12 for k in range(90)])
    points[7] = points[40]
    points[8:10] *= [[1e200], [1e-200]]
    points[10], points[11] = points[8] / 1e200 * 3, points[9] / 1e-200
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)] + [(90, [1.0, 0.0]), (91, [1.0, 0.01])], "vec_id long, embedding array<double>")
    units = grid_join.unit_rows(points)
    links = (units @ units.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in grid_join.similar_vectors(table).collect()}
    assert got == {**{i: int(n) for i, n in enumerate(links)}, 90: 1, 91: 1}

    lead = np.pad(units, ((0, 0), (0, grid_join.LEADING - 6)))
    ordered = spark.createDataFrame([(i, 6, u.tobytes(), v.tolist()) for i, (u, v) in enumerate(zip((units > 0.5).astype("u1"), lead))], "rep long, dim int, cell binary, lead array<double>")
    pieces, bits = grid_join._blocks(ordered)
    sizes = {r.block: r["count"] for r in pieces.groupBy("block").count().collect()}
    met = grid_join.near_blocks(pieces, bits, 0.95).collect()
    assert max(sizes.values()) <= 5 and sum(sizes.values()) == 90
    assert {(b, b) for b in sizes} <= {(r.i, r.j) for r in met} and len(met) < len(sizes) * (len(sizes) + 1) / 4


def test_grid_join_skips_what_is_far():
    rng = np.random.default_rng(5)
    units = np.vstack([grid_join.unit_rows(np.eye(16)[k] + rng.normal(size=(256, 16)) * 0.02) for k in range(8)])
    lead = units @ grid_join.principal_axes(units)
    work = grid_join._Join(units, lead, 0.95)
    work.run((0, len(units)), (0, len(units)))
    found = sum(len(x) for x in work.x)
    assert found == (np.triu(units @ units.T >= 0.95, 1)).sum() and work.skipped > 0 and work.leaves < 64


def test_language(spark, docs, empty):
    sample = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the thing with that and the other " * 5, "en"), ("der die das und über straße ich nicht " * 5, "de")] * 20)], "doc_id long, text string, lang string")
    model = language_id.fit(sample)
    got = {r.doc_id: r for r in language_id.predict_languages(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 11))
    assert got[10].lang_pred == "de" and 0 <= got[8].score <= 1 and len(got) == docs.select("doc_id").distinct().count()
    assert set(language_id.position_labels(model, "straße")) <= {"de", "en"}
    assert language_id.predict_languages(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict_languages(docs, nothing).collect()} == {"und"}


def test_recurrent_gradients():
    model = language_id.train([b"abc abd", b"xyz xyy"], ["a", "b"], steps=1)
    d, data = model.forward, np.frombuffer(b"abcdefgh", np.uint8).reshape(4, 2)
    weights = np.random.default_rng(0).normal(size=(4, 2, 2)).astype(np.float32)
    _, trace = language_id._cells(d, data, True)
    grads = language_id._gradients(d, data, trace, weights)
    for p, g in zip([*d.tables, *d.matrices, d.output], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = p[at], 1e-2
        p[at] = was + step
        up = (language_id._cells(d, data, False)[0] * weights).sum()
        p[at] = was - step
        down = (language_id._cells(d, data, False)[0] * weights).sum()
        p[at] = was
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * max(1.0, abs(g[at]))


def test_class_model(docs, empty):
    got = class_model.score_texts(docs).collect()
    assert len(got) == docs.count() and class_model.score_texts(empty).count() == 0
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].n_tokens == by_id[4].n_tokens == by_id[5].n_tokens == 1 and by_id[8].n_tokens == 60_001
    assert all(r.score < 0 and r.base_score < 0 for r in got)


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(2)
    counts = np.zeros((40, 40))
    for side in (0, 1):
        own = np.arange(40)[np.arange(40) % 2 == side]
        np.add.at(counts, (rng.choice(own, 4000), rng.choice(own, 4000)), 1)
    of = class_model.exchange_classes(counts, 2)
    assert len(set(of[::2])) == 1 and len(set(of[1::2])) == 1 and of[0] != of[1]


def test_best_classes_against_brute_force():
    rng = np.random.default_rng(4)
    bigrams = np.maximum(rng.poisson(0.6, (30, 30)) + np.diag(rng.integers(0, 4, 30)), 0).astype(float)
    bigrams += bigrams.T  # each word is as often before as after
    of, classes = rng.integers(0, 5, 30), 5

    def table(of):
        member = np.eye(classes)[of]
        return member.T @ bigrams @ member

    member = np.eye(classes)[of]
    got = class_model.best_classes(table(of), bigrams @ member, bigrams.T @ member, bigrams.diagonal(), of)
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    for w in range(30):
        value = []
        for k in range(classes):
            t = table(np.where(np.arange(30) == w, k, of))
            value.append(xlogx(t).sum() - 2 * xlogx(bigrams.sum(0) @ np.eye(classes)[np.where(np.arange(30) == w, k, of)]).sum())
        assert value[got[w]] > max(value) - 1e-6


def test_words_beyond_the_most_frequent_have_classes_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(class_model, "FREQUENT", 1)  # the end alone
    rng = np.random.default_rng(5)
    words = [[f"{'ab'[side]}{i}{chr(97 + i % 16)}{chr(97 + i // 16 % 16)}" for i in range(700)] for side in (0, 1)]
    rows = [(i, " ".join(rng.choice(words[i % 2], 120))) for i in range(1400)]
    got = class_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out").collect()
    gained = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert len(got) > 100 and gained > 0.25  # two languages of equal size: log10(2) at most but for the ends


def brute_removed(texts):
    first, out = {}, {}
    for i, t in sorted(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_repeats(spark, docs, empty):
    rng = np.random.default_rng(9)
    letters = list("abcdefgh é\0\n")
    noise = ["".join(rng.choice(letters, 400)) for _ in range(12)]
    made = [(100 + k, noise[k][:150] + noise[(k * 5 + 1) % 12][100 : 150 + k * 4] + noise[k][150:]) for k in range(12)] + [(200, "ab" * 300), (201, "xy" + "ab" * 200), (202, "z" * 500), (203, "z" * 49), (204, "q" + "z" * 51)]
    texts = made + [(r.doc_id, r.text) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_removed(texts)
    assert repeats.remove_repeats(docs).count() == docs.where("doc_id is not null").count()
    assert repeats.remove_repeats(empty).count() == 0 and repeats.maximal_repeats(empty).count() == 0
    groups = repeats.maximal_repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(2)).collect()
    raw, by_group = {i: t.encode() for i, t in made}, {}
    for r in groups:
        by_group.setdefault(r.group_id, set()).add(raw[r.doc_id][r.start : r.start + r.length])
        assert r.length >= 50 and r.first_doc <= r.doc_id and r.n_docs >= 2
    assert groups and all(len(texts) == 1 for texts in by_group.values())


def test_repeats_of_a_hot_key(spark, monkeypatch):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijkl mnop é")
    passage = "".join(rng.choice(letters, 90))
    texts = [(int(i), "".join(rng.choice(letters, 40)) + passage + "".join(rng.choice(letters, 40))) for i in rng.permutation(120)]
    texts += [(500, texts[0][1]), (501, passage[:60]), (502, "z" * 400), (503, "z" * 300)]
    monkeypatch.setattr(repeats, "HOT", 20)
    monkeypatch.setattr(repeats, "BUCKET_WINDOWS", 1 << 12)
    plain = repeats._suffix_groups
    seen = spark.sparkContext.accumulator(0)

    def watched(body, begin, size, keys, low_doc, high_doc):
        seen.add(int((np.unique(keys, return_counts=True)[1] > 20).sum()))
        return plain(body, begin, size, keys, low_doc, high_doc)

    monkeypatch.setattr(repeats, "_suffix_groups", watched)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_removed(texts) and seen.value == 0


def test_interval_groups_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        text = "".join(rng.choice(list("ab"), 40))
        suffixes = sorted(range(len(text)), key=lambda i: text[i:])
        lcp = [0] + [next((k for k in range(40) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= 40 or b + k >= 40), 40) for a, b in zip(suffixes, suffixes[1:])]
        before = [ord(text[i - 1]) if i else -1 for i in suffixes]
        got = {(text[suffixes[a] : suffixes[a] + n], b - a + 1) for a, b, n in repeats.interval_groups(np.array(lcp), np.array(before), 2)}
        want = set()
        for s in {text[i:j] for i in range(40) for j in range(i + 2, 41)}:
            at = [i for i in range(40) if text.startswith(s, i)]
            if len(at) > 1 and len({text[i + len(s) : i + len(s) + 1] or i for i in at}) > 1 and (len({text[i - 1] for i in at if i}) > 1 or 0 in at):
                want.add((s, len(at)))
        assert got == want


def test_contexts_are_counted_for_the_words_of_the_turn_alone():
    text = " ".join(f"w{i * i % 37} w{i % 23}" for i in range(2000))
    batch = pa.record_batch([pa.array([1]), pa.array([text]), pa.array([False])], names=["doc_id", "text", "held"])
    row = next(class_model._code(iter([batch]))).to_pylist()[0]
    counts = np.frombuffer(row["counts"], np.uint32).astype(np.uint64)
    part = pa.RecordBatch.from_pylist([row | {"replies": [{"bucket": 0, "counts": counts.tobytes()}]}])
    of_ending, table, seen = np.arange(class_model.ENDINGS) % 4, np.arange(1.0, 17.0).reshape(4, 4) * 1000, []
    for turn in (0, 1):
        sent = next(class_model._contexts(np.zeros(0, np.uint64), np.zeros(0, np.int64), of_ending, 4, 0, turn)(iter([part])))
        blob = sent.to_pylist()[0]
        hashes, old, lengths = (np.frombuffer(blob[c], t) for c, t in (("hashes", np.uint64), ("old", np.uint8), ("lengths", np.uint32)))
        seen.append(hashes[lengths > 0])
        new = np.frombuffer(next(class_model._reassign(table, 4, turn)(iter([sent]))).to_pylist()[0]["classes"], np.uint8)
        dense = np.zeros((len(hashes), 9))
        dense[np.repeat(np.arange(len(hashes)), lengths), np.frombuffer(blob["codes"], np.uint16)] = np.frombuffer(blob["counts"], np.uint32)
        best = class_model.best_classes(table, dense[:, :4], dense[:, 4:8], dense[:, 8], old.astype(np.int64))
        assert np.array_equal(new, np.where(lengths > 0, best, old)) and (new != old).any()
    movable = np.frombuffer(row["hashes"], np.uint64)[counts >= class_model.MIN_COUNT]
    assert not set(seen[0]) & set(seen[1]) and set(movable) <= set(seen[0]) | set(seen[1])

"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, length-normalised score.

Text is lower-cased and folded (homoglyphs and digit or sign substitutions become letters) so that disguised
spellings meet the lexicon. Lexicon entries are words or word beginnings with a weight; exception phrases are
longer entries that cancel the entry inside them. Both come from labelled documents or from the caller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import ready, staged

# Look-alikes of Latin letters in other scripts, then digits and signs used for letters.
HOMOGLYPHS = "аеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοραν" "０１２３４５６７８９"
HOMOGLYPHS_TO = "aeopcyxijsdhabezhikmnoptyxaopav" "0123456789"
SUBSTITUTES, SUBSTITUTES_TO = "0134578@$!|€", "oieastbasiie"

#: Labelled rows that a lexicon is learned from at most: the smallest by a hash of the id.
TRAIN_ROWS = 12_000
#: Entries that a learned lexicon has at most, the heaviest first.
LEXICON_SIZE = 4_000
PREFIX_LENGTHS = range(3, 9)
MIN_DOCS, MIN_WEIGHT = 3, 1.0
#: An entry of this share of the toxic documents explains those that have it.
STRONG_SHARE = 0.02


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, exception phrases, and the logistic map from features to a score."""

    words: dict[str, float]
    prefixes: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = -2.0
    scale_total: float = 1.0
    scale_rate: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        """One key for each text of an entry, with all that it means: (weight, kind) of a prefix, a word, an exception."""
        meanings: dict[str, list[tuple[float, str]]] = {}
        for kind, entries in (("p", self.prefixes), ("w", self.words), ("x", dict.fromkeys(self.exceptions, 0.0))):
            for text, weight in entries.items():
                meanings.setdefault(text, []).append((weight, kind))
        found = ahocorasick.Automaton()
        for text, own in meanings.items():
            found.add_word(text, (len(text), own))
        if len(found):
            found.make_automaton()
        return found


def fold(text: Column) -> Column:
    """Lower-case with look-alikes, and digits and signs turned into letters in words that have a letter beside them.

    Folded word by word: other numbers of the text stay numbers, and ``!`` and ``|`` at the end of a word stay signs.
    """
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), HOMOGLYPHS.lower(), HOMOGLYPHS_TO)
    beside = r"\p{L}[0134578@$€]|[0134578@$!|€]\p{L}"

    def word(w: Column) -> Column:
        core = F.regexp_replace(w, r"[!|]+$", "")
        return F.when(w.rlike(beside), F.concat(F.translate(core, SUBSTITUTES, SUBSTITUTES_TO), F.substr(w, F.length(core) + 1))).otherwise(w)

    words = F.transform(F.regexp_extract_all(plain, F.lit(r"\s+|\S+"), F.lit(0)), word)
    return F.when(plain.rlike(beside), F.array_join(words, "")).otherwise(plain)


def _matches(automaton: ahocorasick.Automaton, text: str) -> tuple[int, float]:
    """(entries found, sum of their weights): the heaviest entry at each word start, exceptions cancelling."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, meanings) in automaton.iter(text):
        start, stop = end - n + 1, end + 1
        if start and text[start - 1].isalnum():
            continue
        for weight, kind in meanings:
            if kind != "p" and stop < len(text) and text[stop].isalnum():
                continue
            if kind == "x":
                spared.append((start, stop))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    if spared and best:
        spared.sort()
        for start in list(best):
            if any(a <= start < b for a, b in spared):
                del best[start]
    return len(best), sum(best.values())


def _features(docs: DataFrame, lexicon: Lexicon, columns: list[str]) -> DataFrame:
    """``columns`` with entries found, their weight and the folded text's characters."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ", __v_hits long, __v_weight double, __v_folded long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            hits = [_matches(automaton, t) if len(automaton) else (0, 0.0) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.float64()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*columns, "__v_hits", "__v_weight", "__v_folded"],
            )

    return docs.select(*columns, fold(F.col("text")).alias("__v_text")).mapInArrow(scan, schema)


def _signals(weight: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped total weight, and weight per 1,000 characters (damped)."""
    return np.log1p(weight), np.log1p(1000.0 * weight / np.maximum(chars, 200))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, size: int = LEXICON_SIZE) -> Lexicon:
    """Learn entries, weights and exceptions from labelled documents (``doc_id``, ``toxic``).

    Uses at most ``train_rows`` labelled documents, those with the smallest hashes of their ids, and each different text
    once; null labels, null texts, and ids or texts labelled 0 and 1 alike, teach nothing. An entry that STRONG_SHARE of the
    toxic documents have explains these; others have to earn their place in the remaining ones. Entries are words and word beginnings; an entry's weight is the logarithm
    of how many times more often toxic documents have it, less its standard error, and at least MIN_WEIGHT. An entry
    under a shorter one stays if it weighs more; words under an entry are exceptions if they are no sign of toxicity.
    """
    ready(docs.sparkSession)
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("_low"), F.max("toxic").alias("_toxic")).where("_low = _toxic")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("doc_id", "_toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # at most train_rows ids
    # copies of a text teach once: the words of one text in many copies are no entries
    sample = sample.where("text is not null").groupBy("text").agg(F.min("_toxic").alias("_low"), F.max("_toxic").alias("_toxic")).where("_low = _toxic")
    sample = staged(sample.select("_toxic", "text"), "labelled")
    tokens = F.array_distinct(F.filter(F.regexp_extract_all(fold(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.length(w).between(3, 40)))
    per_doc = sample.select("_toxic", tokens.alias("words"), "text")

    def beginnings(n: int) -> Column:
        longer = F.filter("words", lambda w: F.length(w) > n)
        return F.array_distinct(F.transform(longer, lambda w: F.substr(w, F.lit(1), F.lit(n))))

    count = [F.sum("_toxic").alias("pos"), F.sum(1 - F.col("_toxic")).alias("neg")]
    n_pos, n_neg = sample.agg(F.coalesce(F.sum("_toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("_toxic")), F.lit(0))).first()
    ratio = F.log(((F.col("pos") + 0.5) / (n_pos + 1.0)) / ((F.col("neg") + 0.5) / (n_neg + 1.0)))
    weight = F.round(ratio - F.sqrt(1.0 / (F.col("pos") + 0.5) + 1.0 / (F.col("neg") + 0.5)), 6)

    def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        words = rows.select("_toxic", F.explode("words").alias("entry")).groupBy("entry").agg(*count)
        starts = rows.select("_toxic", F.explode(F.flatten(F.array(*map(beginnings, PREFIX_LENGTHS)))).alias("entry")).groupBy("entry").agg(*count)
        return words, starts

    def top(counts: DataFrame, least: float) -> dict[str, float]:
        picked = counts.withColumn("weight", weight).where((F.col("pos") >= max(MIN_DOCS, least)) & (F.col("weight") >= MIN_WEIGHT))
        return {r[0]: r[1] for r in picked.orderBy(F.desc(F.col("pos") * F.col("weight")), "entry").limit(size).select("entry", "weight").collect()}

    every, all_starts = counted(per_doc)
    words = staged(every, "words")
    words_found, starts_found = top(words, n_pos * STRONG_SHARE), top(all_starts, n_pos * STRONG_SHARE)
    # what stands beside a frequent entry is not toxic for that: further entries count where there is none
    strong = Lexicon(words_found, starts_found)
    alone = _features(per_doc, strong, ["_toxic", "words"]).where("_toxic = 0 or __v_hits = 0").select("_toxic", "words")
    more_words, more_starts = map(lambda counts: top(counts, 0), counted(staged(alone, "unexplained")))
    words_found, starts_found = {**more_words, **words_found}, {**more_starts, **starts_found}

    def heavier(entry: str, value: float) -> bool:
        return all(starts_found.get(entry[:n], 0.0) < value for n in range(1, len(entry)))

    prefixes = {s: w for s, w in starts_found.items() if heavier(s, w)}
    entries = {s: w for s, w in words_found.items() if heavier(s, w) and prefixes.get(s, 0.0) < w}
    exceptions: tuple[str, ...] = ()
    if prefixes:
        under = F.lit(False)
        for n in sorted({len(p) for p in prefixes}):
            under |= F.substr("entry", F.lit(1), F.lit(n)).isin([p for p in prefixes if len(p) == n])
        spared = words.where(under & (F.col("neg") >= 2) & (F.col("neg") * (n_pos + 1.0) >= F.col("pos") * (n_neg + 1.0)))
        exceptions = tuple(r[0] for r in spared.orderBy(F.desc("neg"), "entry").limit(size).collect())
    lexicon = Lexicon(entries, prefixes, exceptions)
    seen = _features(sample, lexicon, ["_toxic"])
    rows = np.array([tuple(r) for r in seen.select("_toxic", "__v_weight", "__v_folded").collect()], float).reshape(-1, 3)
    return _calibrated(lexicon, rows)


def _calibrated(lexicon: Lexicon, rows: np.ndarray) -> Lexicon:
    """The lexicon with logistic parameters that fit (label, weight, characters)."""
    if not len(rows) or rows[:, 0].min() == rows[:, 0].max():
        return lexicon
    total, rate = _signals(rows[:, 1], rows[:, 2])
    x = np.column_stack([np.ones(len(rows)), total, rate])
    theta, y = np.array([-2.0, 1.0, 0.0]), rows[:, 0]

    def loss(theta: np.ndarray) -> float:
        z = x @ theta
        return float(np.logaddexp(0.0, z).sum() - y @ z + 0.025 * theta @ theta)

    for _ in range(100):  # Newton steps with a small ridge, halved until they lower the loss
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * theta)
        while np.abs(step).max() > 1e-9 and loss(theta + step) > loss(theta):
            step = step / 2
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    theta = np.round(theta, 9)
    return Lexicon(lexicon.words, lexicon.prefixes, lexicon.exceptions, *map(float, theta))


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id with n_hits, hit_weight and toxicity (0 to 1) for every row of ``docs``.

    Null and empty texts have no hits and the score of a text without hits; repeated rows each get a row; an empty
    table gives none. Other input columns are not read. No shuffle.
    """
    ready(docs.sparkSession)
    out = _features(docs, lexicon, ["doc_id"])
    return out.select("doc_id", F.col("__v_hits").alias("n_hits"), F.col("__v_weight").alias("hit_weight"), _score(lexicon).alias("toxicity"))


def _score(lexicon: Lexicon) -> Column:
    total, rate = F.log1p("__v_weight"), F.log1p(1000.0 * F.col("__v_weight") / F.greatest(F.col("__v_folded"), F.lit(200)))
    return 1.0 / (1.0 + F.exp(-(lexicon.bias + lexicon.scale_total * total + lexicon.scale_rate * rate)))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose texts score below ``threshold``; all columns stay, nothing is shuffled.

    Null and empty texts have no hit and stay, whole texts are scored whatever their length, repeated rows go or stay alike,
    an empty table gives no rows.
    """
    ready(docs.sparkSession)
    return _features(docs, lexicon, docs.columns).where(_score(lexicon) < threshold).select(*docs.columns)

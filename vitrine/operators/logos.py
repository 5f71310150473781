"""Brand references and logo consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ladders import ladder, text
from ..functions.rounding import percent, round_columns, whole
from ..functions.vectors import cosine
from .similarity import best_matches, with_vectors

NEUTRAL = "No registered brand reference logo available for the claimed identity. Logo consistency cannot be evaluated without a verified reference. Neutral risk assigned."
EMPTY_REGISTRY = "No verified reference logos registered in repository for brand comparison."
NO_LOGO = "Brand visual identity appears standard and consistent."


#: Letters of a q-gram; shorter needles are looked up as a whole.
GRAM = 3


def _grams(value: Column) -> Column:
    """Distinct q-grams of a text; none of a shorter one."""
    last = F.length(value) - F.lit(GRAM - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(value, i, F.lit(GRAM)))))


def contained(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """(hay_id, needle): the distinct ``needle`` texts that each ``hay`` text holds, by the rarest q-gram of each needle.

    The q-grams of all hay texts are counted; a needle is filed under that q-gram of its own which the fewest of them
    have, a hay text looks its q-grams up, and what is found is verified. A needle that no text can hold has a q-gram
    without any count and is dropped at once. Needles under GRAM letters are met as whole pieces; an empty needle is held
    by every text. Rows per hay text are bounded by its pieces, never by the number of rows that have the needle.
    """
    texts = needles.select("needle").filter(F.col("needle").isNotNull()).distinct()
    pieces = hay.filter(F.col("hay").isNotNull()).select("hay_id", "hay", F.explode(_grams(F.col("hay"))).alias("gram"))
    counts = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    filed = texts.filter(F.length("needle") >= GRAM).select("needle", F.explode(_grams(F.col("needle"))).alias("gram")).join(counts, "gram", "left")
    rarest = filed.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter(F.col("r.n") > 0)
    found = pieces.join(rarest.select("needle", F.col("r.gram").alias("gram")), "gram").filter(F.contains("hay", "needle")).select("hay_id", "needle")
    short = texts.filter(F.length("needle") < GRAM)
    every = lambda n: F.transform(F.sequence(F.lit(1), F.length("hay") + 1), lambda i: F.substr(F.col("hay"), i, F.lit(n)))
    ends = F.flatten(F.array(*[every(n) for n in range(GRAM)]))
    whole = hay.filter(F.col("hay").isNotNull()).select("hay_id", F.explode(F.array_distinct(ends)).alias("needle")).join(short, "needle").select("hay_id", "needle")
    return found.unionByName(whole)


def _compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[ _-]", "")


def _reference_needles(brands: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((claimed_brand, needle), (filename, needle)): a brand and a file that share a needle belong together.

    Needles marked ``f`` are the compact brand or a word of it, held by the file name; needles marked ``b`` are the file
    name without its ending, held by the compact brand. Distinct brands and files only, so a brand claimed by very many
    merchants counts once, and nothing is listed per pair.
    """
    names = brands.filter(F.coalesce(F.col("claimed_brand"), F.lit("")) != "").select("claimed_brand").distinct()
    files = registry.select("filename").distinct()
    words = F.filter(F.split(F.lower("claimed_brand"), r"\s+"), lambda w: F.length(w) > 3)
    asked = names.select("claimed_brand", F.explode(F.array_union(F.array(_compact(F.col("claimed_brand"))), words)).alias("needle"))
    holding = contained(files.select(F.col("filename").alias("hay_id"), _compact(F.col("filename")).alias("hay")), asked)
    stem = F.replace(F.replace(_compact(F.col("filename")), F.lit(".png"), F.lit("")), F.lit(".jpg"), F.lit(""))
    stems = files.select("filename", stem.alias("needle"))
    around = contained(names.select(F.col("claimed_brand").alias("hay_id"), _compact(F.col("claimed_brand")).alias("hay")), stems)
    mark = lambda m: F.concat(F.lit(m), "needle").alias("needle")
    own = asked.select("claimed_brand", mark("f")).unionByName(around.select(F.col("hay_id").alias("claimed_brand"), mark("b")))
    held = holding.select(F.col("hay_id").alias("filename"), mark("f")).unionByName(stems.select("filename", mark("b")))
    return own, held


def brand_references(brands: DataFrame, registry: DataFrame) -> DataFrame:
    """F14. (claimed_brand, filename) pairs: compact brand inside the file name, file name
    inside the brand, or a brand word of more than three letters inside the file name.

    The list of all pairs, as asked; F15 and F16 work on needles instead and list none.
    """
    own, held = _reference_needles(brands, registry)
    return own.join(held, "needle").select("claimed_brand", "filename").distinct()


def best_references(logos: DataFrame, registry: DataFrame, leaf: int | None = None) -> DataFrame:
    """(merchant_id, best, matched_logo): the most similar file among the references of a merchant's brand, the first of equals.

    Every needle is a scope: the distinct logos that ask for it meet the files that hold it through the vector tree, so
    one word in all file names costs one search among them, not a pair for each merchant and file.
    """
    filled = lambda df: df.withColumn("embedding", F.when(F.size("embedding") == 0, F.array(F.lit(0.0)).cast(df.schema["embedding"].dataType)).otherwise(F.col("embedding")))
    own, held = _reference_needles(logos, registry)
    shown = with_vectors(filled(logos.filter(F.col("embedding").isNotNull()).select("merchant_id", "claimed_brand", "embedding")))
    asked = shown.join(own.select("claimed_brand", F.col("needle").alias("scope")), "claimed_brand")
    vector = ["v1", "v2", "dim", "scope"]
    none = {"owner": F.lit(""), "domain": F.lit("")}
    queries = asked.groupBy(*vector).agg(F.any_value("embedding").alias("embedding")).withColumns({"row_id": F.concat_ws("|", "v1", "v2", "dim", "scope"), **none})
    files = with_vectors(filled(registry.filter(F.col("embedding").isNotNull()).select("filename", "embedding")))
    members = files.join(held.select("filename", F.col("needle").alias("scope")), "filename").withColumnRenamed("filename", "member").withColumns(none)
    found = best_matches(queries, members, 1, None, False, leaf).select("row_id", "member", "similarity")
    named = queries.select(*vector, "row_id").join(found, "row_id").select(*vector, "member", "similarity")
    return asked.select("merchant_id", *vector).join(named, vector).groupBy("merchant_id").agg(
        F.max("similarity").alias("best"), F.min_by("member", F.struct(-F.col("similarity"), F.col("member"))).alias("matched_logo")
    )


def logo_consistency(logos: DataFrame, registry: DataFrame) -> DataFrame:
    """F15. Best similarity of each merchant's logo to the references of its brand.

    ``logos``: merchant_id, claimed_brand, embedding (NULL without a logo);
    ``registry``: filename, embedding. Without a logo or a reference the result is
    neutral (0.85 / 15); with an empty registry it is 1.0 / 0.
    """
    best = best_references(logos, registry)
    empty = registry.isEmpty()
    has_logo = F.col("embedding").isNotNull()
    df = logos.join(best, "merchant_id", "left").withColumn(
        "logo_similarity",
        F.coalesce(F.col("best"), F.when(has_logo & F.lit(empty), 1.0).otherwise(0.85)),
    )
    df = df.withColumns(
        {
            "consistency_score": F.col("logo_similarity") * F.lit(100.0),
            "logo_risk": F.greatest(F.lit(0.0), (F.lit(1.0) - F.col("logo_similarity")) * F.lit(100.0)),
        }
    )
    df = round_columns(df, {"consistency_score": 1, "logo_risk": 1})
    sim, score, name = F.col("logo_similarity"), F.col("consistency_score"), F.col("matched_logo")
    return df.withColumns(
        {
            "logo_level": ladder([(sim >= 0.82, "LOW"), (sim >= 0.55, "MEDIUM")], "HIGH"),
            "logo_explanation": ladder(
                [
                    (~has_logo, NO_LOGO),
                    (name.isNull() & F.lit(empty), EMPTY_REGISTRY),
                    (name.isNull(), NEUTRAL),
                    (sim >= 0.82, text("Merchant logo demonstrates strong visual consistency (", score, "%) with verified reference identity (", name, ").")),
                    (sim >= 0.55, text("Merchant logo demonstrates moderate visual variance (", score, "% match) against verified reference identity (", name, ").")),
                ],
                text("Merchant logo shows low visual similarity (", score, "%) to the verified reference identity (", name, ")."),
            ),
        }
    ).drop("embedding", "best")


def _spaced(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[_-]", " ")


def resolve_brands(brands: DataFrame, registry: DataFrame) -> DataFrame:
    """F16. VERIFIED with the first matching file per claimed brand, else UNAVAILABLE."""
    names = brands.select("claimed_brand").distinct()
    usable = names.withColumn("norm", _spaced(F.trim("claimed_brand"))).filter(F.length("norm") >= 2)
    files = registry.filter(F.lower("filename").rlike(r"\.(png|jpg|jpeg|webp)$")).select(
        "filename", F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem")
    )
    stems = files.withColumn("clean", _spaced(F.col("stem")))
    # the first file of each needle, before any brand asks for it
    holding = contained(stems.select(F.col("filename").alias("hay_id"), F.col("clean").alias("hay")), usable.select(F.col("norm").alias("needle")))
    inside = usable.join(holding.groupBy(F.col("needle").alias("norm")).agg(F.min("hay_id").alias("filename")), "norm").select("claimed_brand", "filename")
    names_of = stems.groupBy(F.col("clean").alias("needle")).agg(F.min("filename").alias("filename"))
    around = contained(usable.select(F.col("claimed_brand").alias("hay_id"), F.col("norm").alias("hay")), names_of).join(names_of, "needle")
    first = inside.unionByName(around.select(F.col("hay_id").alias("claimed_brand"), "filename")).groupBy("claimed_brand").agg(F.min("filename").alias("filename"))
    return names.join(first, "claimed_brand", "left").select(
        "claimed_brand",
        F.when(F.col("filename").isNull(), "UNAVAILABLE").otherwise("VERIFIED").alias("brand_status"),
        F.col("filename").alias("brand_file"),
        F.regexp_replace("filename", r"\.[^.]*$", "").alias("brand_name"),
    )


def logo_mismatch(logos: DataFrame, registry: DataFrame) -> DataFrame:
    """F17. Mismatch evidence of logos whose brand is verified.

    ``logos``: merchant_id, claimed_brand, embedding, logo_url. UNAVAILABLE rows carry
    no score.
    """
    resolved = resolve_brands(logos, registry).join(
        registry.select(F.col("filename").alias("brand_file"), F.col("embedding").alias("reference")), "brand_file", "left"
    )
    df = logos.join(resolved, "claimed_brand", "left").withColumn(
        "sim", F.when(F.col("embedding").isNotNull() & F.col("reference").isNotNull(), cosine(F.col("embedding"), F.col("reference")))
    )
    sim, pct, name = F.col("sim"), percent(F.col("sim")), F.col("brand_name")
    return df.select(
        "merchant_id",
        F.when(sim.isNull(), "UNAVAILABLE").otherwise("VERIFIED").alias("brand_status"),
        F.when(sim.isNotNull(), F.coalesce("logo_url", F.lit("merchant_logo"))).alias("asset_url"),
        F.when(sim.isNotNull(), "potential_logo_mismatch").alias("signal_type"),
        ladder(
            [
                (sim.isNull(), F.lit(None).cast("int")),
                (sim < 0.60, whole((F.lit(1.0) - sim) * F.lit(100.0))),
                (sim < 0.78, whole((F.lit(0.80) - sim) * F.lit(50.0))),
            ],
            0,
        ).alias("score"),
        ladder(
            [
                (sim.isNull(), F.lit(None).cast("string")),
                (sim < 0.60, text("Potential logo mismatch (", pct, "% visual match with verified ", name, " logo). Extracted website logo exhibits notable visual divergence from registered brand asset.")),
                (sim < 0.78, text("Moderate visual variation (", pct, "% match with verified ", name, " logo). Logo style or format variant detected.")),
            ],
            text("Extracted logo matches verified official ", name, " brand asset (", pct, "% similarity)."),
        ).alias("explanation"),
    )

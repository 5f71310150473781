"""Format-preserving pseudonyms of personal numbers, dates and mail addresses (DataFrame functions only).

A value that passes its kind's validation is permuted inside its format by a keyed Feistel network, so equal
values get equal pseudonyms in every document, different values different ones, and the result validates too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import keep_columns

ROUNDS = 8

# Character classes; a character is moved inside its own class, others stay.
CLASSES = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
EPOCH, N_DAYS = "1900-01-01", 73049  # 1900-01-01 to 2099-12-31
DAY_MODULI = (17, 4297)  # their product is N_DAYS

# What each kind looks like; order decides between kinds at one place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\p{L}\p{N}./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9][./][01][0-9][./](?:19|20)[0-9]{2})(?![\p{L}\p{N}/-]|\.[0-9])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{L}\p{N}]|[.-][0-9])",
    "phone": r"(?<![\p{L}\p{N}+(.-])(?:\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4})(?![\p{L}\p{N}]|[.-][0-9])",
    "card": r"(?<![\p{L}\p{N}.-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}]|[.-][0-9])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _draw(key: str, tweak: Column, round_: Column, half: Column) -> Column:
    """Hex digits that depend on the key, the kind and format, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), half), 512)


def _number(hex_digits: Column, at: Column | int, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(hex_digits, at, F.lit(n)), 16, 10).cast("long")


def permute_pair(x: Column, y: Column, moduli: tuple[int, int], key: str, tweak: str) -> Column:
    """Feistel permutation of the pairs (x, y) below the two moduli."""
    m, n = moduli

    def step(s: Column, i: Column) -> Column:
        add_x = _number(_draw(key, F.lit(tweak), i, s["y"].cast("string")), 1, 12)
        add_y = _number(_draw(key, F.lit(tweak), i, s["x"].cast("string")), 1, 12)
        return F.when(i % 2 == 0, F.struct(((s["x"] + add_x) % m).alias("x"), s["y"].alias("y"))).otherwise(
            F.struct(s["x"].alias("x"), ((s["y"] + add_y) % n).alias("y"))
        )

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shift(half: Column, stream: Column) -> Column:
    """Move each character by its part of the stream inside its class."""

    def move(c: Column, i: Column) -> Column:
        by = _number(stream, (i % 32) * 4 + 1, 4)
        moved = c
        for letters in CLASSES:
            at = F.instr(F.lit(letters), c)
            moved = F.when(at > 0, F.substr(F.lit(letters), ((at - 1 + by) % len(letters)).cast("int") + 1, F.lit(1))).otherwise(moved)
        return moved

    chars = F.filter(F.split(half, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, move), "")


def permute_text(text: Column, key: str, tweak: str) -> Column:
    """Feistel permutation of the strings with one pattern of character classes."""
    cut = F.floor(F.length(text) / 2).cast("int")
    shape = F.concat(F.lit(f"{tweak}:"), F.length(text).cast("string"))

    def step(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(_shift(s["l"], _draw(key, shape, i, s["r"])).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), _shift(s["r"], _draw(key, shape, i, s["l"])).alias("r")))

    start = F.struct(F.substr(text, F.lit(1), cut).alias("l"), F.substr(text, cut + 1, F.lit(1 << 30)).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(done["l"], done["r"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit not doubled."""
    ordered = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(ordered, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN's number (letters count 10 to 35, the first four characters last)."""
    moved = F.concat(F.substr(iban, F.lit(5), F.lit(64)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        letter = F.instr(F.lit(CLASSES[2]), c)
        return F.when(letter > 0, (acc * 100 + letter + 9) % 97).otherwise((acc * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def refill(template: Column, characters: Column, pattern: str) -> Column:
    """The template with its characters of the class ``pattern`` replaced in turn by the given ones."""
    chars = F.filter(F.split(template, ""), lambda c: c != "")
    nth = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substr(template, F.lit(1), i + 1), f"[^{pattern}]", "")))
    return F.array_join(F.zip_with(chars, nth, lambda c, k: F.when(c.rlike(f"[{pattern}]"), F.substr(characters, k, F.lit(1))).otherwise(c)), "")


def _email(value: Column, key: str) -> Column:
    name = F.substring_index(value, "@", 1)
    return F.concat(permute_text(name, key, "email"), F.substr(value, F.length(name) + 1, F.lit(1 << 30)))


def _iban(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, " ", "")
    body = permute_text(F.substr(plain, F.lit(5), F.lit(64)), key, "iban")
    country = F.substr(plain, F.lit(1), F.lit(2))
    check = F.lpad((98 - mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    return F.when(mod97(plain) == 1, refill(value, F.concat(country, check, body), "A-Z0-9"))


def _date(value: Column, key: str) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    day = F.when(iso, F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(F.regexp_replace(value, "[./]", "-"), F.lit("dd-MM-yyyy"))).cast("date")
    number = F.datediff(day, F.lit(EPOCH).cast("date")).cast("long")
    pair = permute_pair(F.floor(number / DAY_MODULI[1]), number % DAY_MODULI[1], DAY_MODULI, key, "date")
    moved = F.date_add(F.lit(EPOCH).cast("date"), (pair["x"] * DAY_MODULI[1] + pair["y"]).cast("int"))
    digits = F.when(iso, F.date_format(moved, "yyyyMMdd")).otherwise(F.date_format(moved, "ddMMyyyy"))
    return F.when(day.isNotNull(), refill(value, digits, "0-9"))


def _ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    pair = permute_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), key, "ip")
    octets = [F.floor(pair["x"] / 256), pair["x"] % 256, F.floor(pair["y"] / 256), pair["y"] % 256]
    return F.concat_ws(".", *[o.cast("long").cast("string") for o in octets])


def _ssn(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "-", "").cast("long")
    area, rest = F.floor(digits / 1_000_000), digits % 1_000_000
    group, serial = F.floor(rest / 10_000), rest % 10_000
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas, 99 groups of 9,999
    pair = permute_pair(rank, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")
    new_area = pair["x"] + 1 + F.when(pair["x"] >= 665, 1).otherwise(0)
    two = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    return F.concat_ws("-", two(new_area, 3), two(F.floor(pair["y"] / 9999) + 1, 2), two(pair["y"] % 9999 + 1, 4))


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+[1-9][0-9]{0,2}(?=[ .(-])|^\+[1-9]|^", 0)
    rest = F.substr(value, F.length(country) + 1, F.lit(64))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    enough = F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.when(enough, F.concat(country, refill(rest, permute_text(digits, key, "phone"), "0-9")))


def _card(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(digits) % 10 == 0, refill(value, F.concat(body, check.cast("string")), "0-9"))


REPLACE: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card,
}


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Input rows with validated personal values of ``text`` replaced by their pseudonyms.

    Adds ``n_pii`` (values replaced) and ``pii_kinds`` (kind of each, in text order); a value that fails its
    validation (Luhn sum, IBAN remainder, calendar, octets, number ranges, digits of a phone number) stays as it is.
    Mail addresses keep their domain, phone numbers their country code. A null text stays null with n_pii 0,
    repeated rows each get their result, an empty table gives no rows; input columns named ``n_pii`` or
    ``pii_kinds`` are replaced, others stay (names that begin with ``__v_`` are reserved). Runs row by row without a shuffle.
    """
    made = ("n_pii", "pii_kinds")
    docs = keep_columns(docs, made)

    def replaced(value: Column) -> Column:
        out = F.lit(None).cast("struct<kind:string,value:string>")
        for kind, pattern in reversed(KINDS.items()):
            out = F.when(value.rlike(f"^(?:{pattern})$"), F.struct(F.lit(kind).alias("kind"), REPLACE[kind](value, key).alias("value"))).otherwise(out)
        return out

    text = F.col("text")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("__v_found", found)
    docs = docs.withColumn("__v_new", F.transform("__v_found", replaced))
    done = F.filter(F.transform("__v_new", lambda v: F.when(v["value"].isNotNull(), v["kind"])), lambda k: k.isNotNull())
    between = F.split(text, ANY, -1)
    parts = F.zip_with(F.zip_with("__v_found", "__v_new", lambda old, new: F.coalesce(new["value"], old)), between, lambda v, gap: F.concat(gap, F.coalesce(v, F.lit(""))))
    rebuilt = F.when(F.size("__v_found") > 0, F.array_join(parts, "")).otherwise(text)
    kept = [rebuilt.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("__v_found", "__v_new")]
    kinds = F.coalesce(done, F.array().cast("array<string>"))
    return docs.select(*kept, F.size(kinds).cast("long").alias("n_pii"), kinds.alias("pii_kinds"))


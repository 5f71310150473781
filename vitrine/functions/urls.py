"""URL and domain expressions. All JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ladders import ladder, let, text

# Host names that are never fetched.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "metadata.google.internal"]

_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"


def netloc(url: Column) -> Column:
    """Authority part of a URL ('' when there is none)."""
    return F.regexp_extract(url, _NETLOC, 1)


def url_path(url: Column) -> Column:
    """Path part of an absolute URL."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def _before(value: Column, sign: str) -> Column:
    return F.substring_index(value, sign, 1)


def extract_domain(url: Column) -> Column:
    """B1. Host of a URL or bare domain: lower case, no port, no leading ``www.``."""
    raw = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    bare = ~raw.startswith("http://") & ~raw.startswith("https://") & ~raw.contains("//")
    full = F.when(raw == "", raw).when(bare, F.concat(F.lit("https://"), raw)).otherwise(raw)
    return F.regexp_replace(_before(netloc(full), ":"), r"^www\.", "")


def clean_domain(domain: Column) -> Column:
    """B2. Bare host of a domain string; every ``www.`` goes, then path and port."""
    raw = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    host = F.when(raw.contains("//"), extract_domain(raw)).otherwise(raw)
    return _before(_before(F.trim(F.replace(host, F.lit("www."), F.lit(""))), "/"), ":")


def crawl_domain(url: Column) -> Column:
    """B3. Host used as the crawl key: keeps the port, drops a leading ``www.``."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def domain_to_name(domain: Column) -> Column:
    """B4. Title-cased first label; a letter after any non-letter is capitalised."""
    label = F.lower(F.translate(_before(domain, "."), "-_", "  "))
    runs = F.regexp_extract_all(label, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.initcap(t)), "")


def own_domain_strict(target: Column, merchant: Column) -> Column:
    """B5a. Same domain, subdomain or parent domain; pass cleaned domains."""
    return (target != "") & (merchant != "") & (
        (target == merchant)
        | target.endswith(F.concat(F.lit("."), merchant))
        | merchant.endswith(F.concat(F.lit("."), target))
    )


def own_domain_loose(source: Column, merchant: Column) -> Column:
    """B5b. Containment in either direction, or of the merchant's first label.

    ``source`` lower case as delivered, ``merchant`` lower case without ``www.``;
    an absent merchant domain never matches.
    """
    return F.coalesce(
        (merchant != "")
        & (
            source.contains(merchant)
            | merchant.contains(source)
            | _before(source, ".").contains(_before(merchant, "."))
        ),
        F.lit(False),
    )


def index_domain(domain: Column) -> Column:
    """Domain form used by the cross-merchant index: lower case, every ``www.`` gone."""
    return F.trim(F.replace(F.lower(F.coalesce(domain, F.lit(""))), F.lit("www."), F.lit("")))


def own_domain_index(indexed: Column, current: Column) -> Column:
    """B5c. Indexed domain equals the current one or lies below it."""
    return (current != "") & ((indexed == current) | indexed.endswith(F.concat(F.lit("."), current)))


def mask_merchant(merchant_id: Column) -> Column:
    """B12. ``mch_***`` plus the last four characters (two for ids of four or fewer)."""
    ident = F.trim(F.coalesce(merchant_id.cast("string"), F.lit("")))
    return F.concat(
        F.lit("mch_***"),
        F.when(F.coalesce(merchant_id.cast("string"), F.lit("")) == "", "")
        .when(F.length(ident) <= 4, F.substring(ident, -2, 2))
        .otherwise(F.substring(ident, -4, 4)),
    )


def url_host(url: Column) -> Column:
    """Host name of a URL without user info, port or IPv6 brackets, lower case."""
    authority = F.regexp_replace(netloc(url), r"^.*@", "")
    v6 = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(authority.startswith("["), v6).otherwise(_before(authority, ":")))


def url_safety_reason(url: Column) -> Column:
    """B13. Why a URL may not be fetched on syntax alone; NULL when it may."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    scheme, host = url_scheme(raw), url_host(raw)
    return ladder(
        [
            (F.coalesce(url, F.lit("")) == "", "URL must be a non-empty string."),
            (
                ~scheme.isin("http", "https"),
                text("Unsupported URL scheme '", scheme, "'. Only 'http' and 'https' are permitted."),
            ),
            (host == "", "URL does not contain a valid hostname."),
            (host.isin(BLOCKED_HOSTS), text("Access to blocked hostname '", host, "' is prohibited.")),
        ],
        F.lit(None).cast("string"),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page (RFC 3986 for the forms links take)."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(url_path(base), r"^(.*/)", 1), "^$", "/")
    return let(
        href,
        lambda h: ladder(
            [
                (h == "", base),
                (h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h),
                (h.startswith("//"), F.concat(scheme, F.lit(":"), h)),
                (h.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), h)),
                (h.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), h)),
            ],
            F.concat(origin, _dot_free(F.when(h.startswith("/"), h).otherwise(F.concat(folder, h)))),
        ),
    )


def _dot_free(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of a path, leaving query and fragment alone."""

    def walk(p: Column) -> Column:
        head = F.regexp_extract(p, r"^([^?#]*)", 1)
        walked = F.aggregate(
            F.split(head, "/", -1),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
            .otherwise(F.concat(acc, F.array(s))),
        )
        open_end = F.when(head.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
        return F.concat(F.array_join(walked, "/"), open_end, F.regexp_extract(p, r"^[^?#]*(.*)$", 1))

    return let(path, lambda p: F.when(p.rlike(r"^[^?#]*(^|/)\.\.?(/|$|[?#])"), walk(p)).otherwise(p))

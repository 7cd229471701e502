"""URL canonicalization and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import constants as C

# Patterns of URLs in the order scheme, host, path; of white space at both ends; of what goes from within; of a
# per cent sign that escapes nothing.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
EDGES, CONTROLS, MALFORMED = r"(?U)^\s+|\s+$", r"[\t\r\n]", "%(?![0-9A-Fa-f]{2})"
# what form encoding does otherwise than percent-encoding of paths
RESTORE = {"+": "%20", "%2F": "/", "%3A": ":", "%40": "@", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def strip(text: Column) -> Column:
    """White space of any kind at both ends goes."""
    return F.regexp_replace(text, EDGES, "")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.regexp_replace(strip(url), CONTROLS, ""), PARTS, n)


def percent_decode(text: Column) -> Column:
    """`+` and malformed escapes stay as they are; invalid UTF-8 becomes U+FFFD."""
    return F.url_decode(F.replace(F.regexp_replace(text, MALFORMED, "%25"), F.lit("+"), F.lit("%2B")))


def percent_encode_path(text: Column) -> Column:
    out = F.url_encode(text)
    for encoded, plain in RESTORE.items():
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return percent_encode_path(percent_decode(_part(url, 3)))


def canonical(url: Column) -> Column:
    """https, lower-case scheme and host, one encoding of the path; no query, no fragment. Blank gives ''."""
    scheme = F.lower(_part(url, 1))
    scheme = F.when(scheme == "http", F.lit("https")).otherwise(scheme)
    host = netloc(url)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path(url),
    )


def url_valid(url: Column) -> Column:
    """False where a bracketed host makes a URL that URL libraries reject."""
    return ~_part(url, 2).rlike(r"[\[\]]")


def origin_url(url: Column) -> Column:
    return F.concat(F.lit("https://s3.amazonaws.com/"), netloc(url), _canonical_path(url))


def at_origin(url: Column) -> Column:
    """origin_url() of a canonical https URL, by its text alone."""
    return F.regexp_replace(url, "^https://", "https://s3.amazonaws.com/")


def regional_url(url: Column, region: Column) -> Column:
    return F.concat(F.lit("https://s3."), region, F.lit(".amazonaws.com/"), netloc(url), _canonical_path(url))


def _canonical_path(url: Column) -> Column:
    """The path as it stands; callers pass canonical URLs."""
    return _part(url, 3)


def object_url(url: Column) -> Column:
    """s3://, with the decoded key."""
    return F.concat(F.lit("s3://"), netloc(url), percent_decode(_part(url, 3)))


def manifest_line(url: Column, quote_safe: bool = False) -> Column:
    """A copy command for the object. quote_safe also escapes quotes within keys."""
    target = object_url(url)
    if quote_safe:
        target = F.replace(target, F.lit("'"), F.lit("'\\''"))
    return F.concat(F.lit("cp --if-size-differ '"), target, F.lit("' 'gpl/"), F.regexp_replace(target, "^s3://", ""), F.lit("'"))


def any_suffix(extensions) -> str:
    return r"\.(?:" + "|".join(e.lstrip(".").replace(".", r"\.") for e in extensions) + r")\z"


def is_archive(url: Column) -> Column:
    """The gate: `gpl` anywhere, and an archive's suffix."""
    low = F.lower(url)
    return low.contains("gpl") & low.rlike(any_suffix(C.GATE_EXTENSIONS))


def archive_extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), any_suffix(C.GATE_EXTENSIONS), 0)


def has_fallback_suffix(url: Column) -> Column:
    return F.lower(url).rlike(any_suffix(C.FALLBACK_EXTENSIONS))


def basename(line: Column) -> Column:
    """What follows the last slash, decoded."""
    return percent_decode(F.substring_index(line, "/", -1))


def insert_variant(name: Column, variant: Column) -> Column:
    """The variant goes before the archive's suffix, or to the end."""
    suffix = r"^(?s)(.*?)(\.(?:" + "|".join(e.replace(".", r"\.") for e in C.CANDIDATE_EXTENSIONS) + r"))\z"
    return F.when(name.rlike(suffix), F.concat(F.regexp_extract(name, suffix, 1), variant, F.regexp_extract(name, suffix, 2))).otherwise(F.concat(name, variant))


def null_header(value: Column) -> Column:
    return F.nullif(value, F.lit("null"))


def retry_seconds(value: Column, now: Column) -> Column:
    """Of a Retry-After header: seconds, or what is left until an HTTP date, or null."""
    at = F.unix_timestamp(F.try_to_timestamp(F.substring(value, 6, 20), F.lit("dd MMM yyyy HH:mm:ss")))
    left = F.greatest(F.lit(0.0), (at - F.unix_timestamp(now)).cast("double"))
    return F.coalesce(value.try_cast("double"), F.when(at.isNotNull(), left))

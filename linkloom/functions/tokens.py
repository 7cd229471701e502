"""Model tokens and name patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions.urls import percent_decode

_BRAND = rf"(?i)^({C.BRANDS})(?=[A-Za-z0-9])"


def model_token(name: Column) -> Column:
    """A file name without suffix, revision, tags and versions; brands glued to a model are split off."""
    b = F.regexp_replace(name, C.TOKEN_EXTENSION, "")
    b = F.regexp_replace(b, r"^\([A-Z]\)\s*", "")
    b = F.replace(b, F.lit("_"), F.lit(" "))
    b = F.regexp_replace(b, r"[(\[][^)\]]*[)\]]", " ")
    b = F.regexp_replace(b, _BRAND, "$1 ")
    b = F.regexp_replace(b, "(?is)" + C.TOKEN_VERSION + ".*", "")
    b = F.trim(F.regexp_replace(F.regexp_replace(b, r"^[ _-]+|[ _-]+$", ""), r"\s+", " "))
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), b), C.TOKEN_TAIL, ""))


def keep_token(token: Column) -> Column:
    least, most = C.TOKEN_LENGTHS
    return F.length(token).between(least, most) & token.rlike("[A-Za-z]") & ~token.rlike(r"^\d")


def token_variants(token: Column) -> Column:
    """The token, and with the brands that its series goes by, if it has none glued on."""
    bare = ~token.rlike(_BRAND)
    archer = F.when(bare & token.rlike(C.ARCHER_SERIES), F.concat(F.lit("Archer "), token))
    deco = F.when(bare & token.rlike(C.DECO_SERIES), F.concat(F.lit("Deco "), token))
    return F.array_compact(F.array(token, archer, deco))


def archive_tokens(url: Column) -> Column:
    """All model tokens of an archive's name, which may hold several."""
    stem = F.regexp_replace(F.substring_index(url, "/", -1), C.TOKEN_ARCHIVE, "")
    chunks = F.split(F.regexp_replace(stem, C.TOKEN_MARKERS, "_"), "_+", -1)
    kept = F.filter(F.transform(chunks, model_token), keep_token)
    return F.array_distinct(F.flatten(F.transform(kept, token_variants)))


def models_of_listing(listing: DataFrame) -> DataFrame:
    """listing: key, size. Distinct models of non-empty firmware objects."""
    rows = listing.where((F.col("size") > 0) & F.col("key").startswith("firmware/"))
    token = rows.select(model_token(F.substring_index("key", "/", -1)).alias("token")).where(keep_token(F.col("token")))
    return token.select(F.explode(token_variants(F.col("token"))).alias("model")).distinct()


def models_of_archives(urls: DataFrame) -> DataFrame:
    return urls.where(F.trim("url") != "").select(F.explode(archive_tokens(F.trim("url"))).alias("model")).distinct()


def model_wordlist(listing: DataFrame, urls: DataFrame) -> DataFrame:
    return models_of_listing(listing).union(models_of_archives(urls)).distinct()


def firmware_models(key: Column) -> Column:
    """Models of a firmware key, with and without version; an empty array if it names none."""
    name = F.regexp_replace(key, "^firmware/", "")
    name = F.regexp_replace(name, r"^\([^)]{1,8}\)", "")
    versioned = name.rlike(r"^\d[\d.]*[\s_]")
    m = F.regexp_replace(F.regexp_replace(name, C.FIRMWARE_STAMP, ""), C.FIRMWARE_EXTENSION, "")
    m = F.regexp_replace(m, "(?is)" + C.FIRMWARE_REGION + ".*", "")
    m = F.regexp_replace(m, "(?s)" + C.FIRMWARE_VERSION + ".*", "")
    m = F.regexp_replace(m, "^[_. -]+|[_. -]+$", "")
    bare = F.regexp_replace(F.regexp_replace(m, r"[Vv]\d+(\.\d+)*$", ""), "[._ -]+$", "")
    good = key.startswith("firmware/") & ~versioned & (F.length(m) >= C.FIRMWARE_LEAST) & m.rlike("[A-Za-z]") & ~m.rlike(r"(?i)^\d+phase")
    both = F.array_compact(F.array(m, F.when((bare != m) & (F.length(bare) >= C.FIRMWARE_LEAST), bare)))
    return F.when(good, both).otherwise(F.array().cast("array<string>"))


def name_pattern(name: Column) -> Column:
    """The template that an archive's name follows."""
    stem = F.regexp_replace(name, C.PATTERN_EXTENSION, "")
    part = lambda n: F.regexp_extract(stem, "(?is)^(.*?)(gpl)(.*)$", n)
    before, token, after = part(1), part(2), part(3)
    sep = lambda c: F.when(c.isin("_", "-"), c).otherwise("")
    rest = F.regexp_replace(after, C.PATTERN_NOISE, "")
    suffix = F.when(rest.isin(*C.PATTERN_SUFFIXES), rest).otherwise("")
    plain = F.when(stem.endswith("_OpenSource"), F.lit("{model}_OpenSource")).when(stem.endswith("_opensource"), F.lit("{model}_opensource")).otherwise("{model}")
    return (
        F.when(token == "", plain)
        .when(before == "", F.concat(token, sep(F.substring(after, 1, 1)), F.lit("{model}")))
        .otherwise(F.concat(F.lit("{model}"), sep(F.right(before, F.lit(1))), token, suffix))
    )


def corpus_patterns(names: DataFrame) -> DataFrame:
    """names: basename. The canonical patterns and those of the names, distinct."""
    floor = names.sparkSession.createDataFrame([(p,) for p in C.CANONICAL_PATTERNS], "pattern string")
    return floor.union(names.select(name_pattern(F.col("basename")))).distinct()


def known_basenames(lines: DataFrame) -> DataFrame:
    """lines: value and others, which are kept. The decoded last path segment of each line; order and repeats stay."""
    return lines.select(*(c for c in lines.columns if c != "value"), percent_decode(F.substring_index("value", "/", -1)).alias("basename"))

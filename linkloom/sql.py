"""The library in SQL text alone: functions of URLs and names, and a table function of capture pages, for any session.

These are SQL functions, so Spark inlines them: filters on them are pushed down as far as those on the expressions, and
no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from linkloom import constants as C
from linkloom.functions import urls


def quoted(text: str) -> str:
    """A SQL string literal for the text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(text: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        text = f"replace({text}, {quoted(a)}, {quoted(b)})"
    return text


def _cut(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)})"


#: In the order in which they build on one another: name, parameters, what is returned, body.
FUNCTIONS = (
    ("url_part", "url STRING, n INT", "STRING", f"regexp_extract({_cut(_cut('url', urls.EDGES), urls.CONTROLS)}, {quoted(urls.PARTS)}, n)"),
    ("url_unescape", "text STRING", "STRING", "url_decode(" + _replaced(_cut("text", urls.MALFORMED, "%25"), {"+": "%2B"}) + ")"),
    ("url_escape_path", "text STRING", "STRING", _replaced("url_encode(text)", urls.RESTORE)),
    ("url_host", "url STRING", "STRING", "lower(url_part(url, 2))"),
    ("url_canonical", "url STRING", "STRING", """concat(
        CASE lower(url_part(url, 1)) WHEN '' THEN '' WHEN 'http' THEN 'https:' ELSE concat(lower(url_part(url, 1)), ':') END,
        CASE url_host(url) WHEN '' THEN '' ELSE concat('//', url_host(url)) END, url_escape_path(url_unescape(url_part(url, 3))))"""),
    ("url_origin", "url STRING", "STRING", "concat('https://s3.amazonaws.com/', url_host(url), url_part(url, 3))"),
    ("url_regional", "url STRING, region STRING", "STRING", "concat('https://s3.', region, '.amazonaws.com/', url_host(url), url_part(url, 3))"),
    ("url_object", "url STRING", "STRING", "concat('s3://', url_host(url), url_unescape(url_part(url, 3)))"),
    ("url_copy_line", "url STRING", "STRING", "concat('cp --if-size-differ \\'', url_object(url), '\\' \\'gpl/', regexp_replace(url_object(url), '^s3://', ''), '\\'')"),
    ("url_is_archive", "url STRING", "BOOLEAN", f"contains(lower(url), 'gpl') AND rlike(lower(url), {quoted(urls.any_suffix(C.GATE_EXTENSIONS))})"),
    ("model_token", "name STRING", "STRING", "trim(" + _cut(
        "concat(' ', trim(" + _cut(_cut(_cut(_cut(_cut("replace(" + _cut(_cut("name", C.TOKEN_EXTENSION), r"^\([A-Z]\)\s*") + ", '_', ' ')", r"[(\[][^)\]]*[)\]]", " "),
        rf"(?i)^({C.BRANDS})(?=[A-Za-z0-9])", "$1 "), "(?is)" + C.TOKEN_VERSION + ".*"), r"^[ _-]+|[ _-]+$"), r"\s+", " ") + "))", C.TOKEN_TAIL) + ")"),
)

def _cdx_rows() -> str:
    """The rows of a capture page as an array: each step names what the next one uses by an array of one."""
    good = r"filter(transform(slice(split(body, '\\r\\n|[\\n\\r]'), 2, 1073741824), x -> from_json(CASE WHEN trim(x) LIKE '[%' THEN x END, 'array<string>')), a -> a IS NOT NULL)"
    cut = f"transform(array({good}), g -> named_struct('good', g, 'at', CAST(array_position(transform(g, a -> size(a)), 0) AS INT)))"
    found = f"""transform({cut}, c -> named_struct(
        'urls', array_distinct(filter(transform(CASE WHEN c.at > 0 THEN slice(c.good, 1, c.at - 1) ELSE c.good END, a -> get(a, 0)), u -> u <> '')),
        'resume_key', CASE WHEN c.at > 0 THEN get(get(filter(slice(c.good, c.at + 1, 1073741824), a -> size(a) > 0), 0), 0) END))"""
    return f"flatten(transform({found}, f -> transform(f.urls, u -> named_struct('url', u, 'resume_key', f.resume_key))))"


#: Table functions: name, parameters, columns, query. A query is one generator without a relation: that alone becomes a step of the
#: caller's plan. Of any other Spark makes a join with the caller's distinct arguments, computed again; where they come out
#: otherwise (lists collected in another order), rows are lost.
TABLE_FUNCTIONS = (("cdx_page", "body STRING", "nth INT, url STRING, resume_key STRING", f"SELECT u.pos, u.col.url, u.col.resume_key FROM posexplode({_cdx_rows()}) AS u(pos, col)"),)


def register(spark: SparkSession) -> None:
    """Temporary functions of the session, by the names above."""
    for name, parameters, returned, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returned} RETURN {body}")
    for name, parameters, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")

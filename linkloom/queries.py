"""One query for each operator over the driver's tables, and its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom import sql
from linkloom.functions import tokens, urls
from linkloom.operators import extract, generate, verify
from linkloom.plans import sinks
from linkloom.plans.durable import DurableSweep
from linkloom.plans.sweep import sweep
from linkloom.session import register_views, stored, stored_path
from linkloom.sources import datasource, fetch, readers, scrape, tables
from linkloom.sources.corpus import Corpus
from linkloom.streaming import dedup
from linkloom.streaming import outcomes as outcomes_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL building blocks -----------------------------------------------------------------------------------------

_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '[\t\r\n]', '', 'g')"


def _part(x: str, n: int) -> str:
    return f"regexp_extract({_clean(x)}, '{_RE}', {n})"


def _encode(x: str) -> str:
    out = f"url_encode({x})"
    for a, b in (("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _canonical(x: str) -> str:
    scheme = f"CASE lower({_part(x, 1)}) WHEN 'http' THEN 'https' ELSE lower({_part(x, 1)}) END"
    return (
        f"(CASE WHEN {_part(x, 1)} <> '' THEN {scheme} || ':' ELSE '' END || CASE WHEN {_part(x, 2)} <> '' THEN '//' || lower({_part(x, 2)}) ELSE '' END"
        f" || {_encode(f'url_decode({_part(x, 3)})')})"
    )


_GATE = r"\.(tar\.gz|tgz|tar\.bz2|tar\.bz|tar\.xz|tar|zip|rar|gz|bz2|bz|7z|xz)$"
_HARD = "url || CASE page_id % 4 WHEN 0 THEN '/A b%28c%29' WHEN 1 THEN '/x%20y+z&q=[1]' WHEN 2 THEN '/%C3%A9 %zz' ELSE '/~*!' END"


def hard_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs, and with paths that are hard to encode put before the query."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    more = F.when(F.col("page_id") % 4 == 0, "/A b%28c%29").when(F.col("page_id") % 4 == 1, "/x%20y+z&q=[1]").when(F.col("page_id") % 4 == 2, "/%C3%A9 %zz").otherwise("/~*!")
    return pages.select("page_id", F.concat("url", more).alias("url"))


_HARD_CTE = rf"WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages), h AS (SELECT page_id, {_HARD} AS url FROM p)"

# --- canonicalization ---------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {_canonical('url')} AS url FROM pages")
def url_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


@query(f"{_HARD_CTE} SELECT page_id, {_canonical('url')} AS url FROM h")
def url_canonical_hard(spark, sf_dir):
    return hard_urls(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("url"))


@query(f"SELECT DISTINCT {_canonical('url')} AS url FROM pages")
def url_canonical_distinct(spark, sf_dir):
    return verify.canonical_set(read(spark, sf_dir, "pages"), "url")


@query(f"{_HARD_CTE}, c AS (SELECT page_id, {_canonical('url')} AS url FROM h) SELECT page_id, 'https://s3.amazonaws.com/' || substr(url, 9) AS origin FROM c")
def url_origin(spark, sf_dir):
    c = hard_urls(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("url"))
    return c.select("page_id", urls.origin_url(F.col("url")).alias("origin"))


@query(f"{_HARD_CTE}, c AS (SELECT page_id, {_canonical('url')} AS url FROM h) SELECT page_id, 'https://s3.r' || page_id % 5 || '.amazonaws.com/' || substr(url, 9) AS regional FROM c")
def url_regional(spark, sf_dir):
    c = hard_urls(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("url"))
    return c.select("page_id", urls.regional_url(F.col("url"), F.concat(F.lit("r"), (F.col("page_id") % 5).cast("string"))).alias("regional"))


@query(rf"{_HARD_CTE}, c AS (SELECT page_id, {_canonical('url')} AS url FROM h) SELECT page_id, 's3://' || regexp_extract(url, '^https://([^/]*)', 1) || url_decode(regexp_extract(url, '^https://[^/]*(.*)$', 1)) AS object FROM c")
def url_s3(spark, sf_dir):
    c = hard_urls(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("url"))
    return c.select("page_id", urls.object_url(F.col("url")).alias("object"))


@query(rf"""{_HARD_CTE}, c AS (SELECT DISTINCT {_canonical('url')} AS url FROM h),
    s AS (SELECT regexp_extract(url, '^https://([^/]*)', 1) || url_decode(regexp_extract(url, '^https://[^/]*(.*)$', 1)) AS k FROM c)
    SELECT 'cp --if-size-differ ''s3://' || k || ''' ''gpl/' || k || '''' AS line FROM s""")
def download_manifest(spark, sf_dir):
    return verify.canonical_set(hard_urls(spark, sf_dir), "url").select(urls.manifest_line(F.col("url")).alias("line"))


@query("SELECT p_partkey, url_decode(replace(p_name, ' ', '%20') || '%28' || p_brand || '%29+%zz') AS name FROM part")
def percent_decode_keys(spark, sf_dir):
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("%28"), "p_brand", F.lit("%29+%zz"))
    return read(spark, sf_dir, "part").select("p_partkey", urls.percent_decode(key).alias("name"))


# --- archives ------------------------------------------------------------------------------------------------------

_EXT_LIST = "['" + "','".join(e[1:] for e in C.GATE_EXTENSIONS) + "','html','txt']"
_ARCHIVES_CTE = f"WITH a AS (SELECT p_partkey, 'https://{C.ARCHIVE_HOST}/resources/gpl/' || replace(p_name, ' ', '_') || '_' || p_size || CASE p_partkey % 3 WHEN 0 THEN '_GPL.' WHEN 1 THEN '_gpl_code.' ELSE '.' END || ({_EXT_LIST})[1 + p_partkey % 15] AS url FROM part)"


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*(F.lit(e[1:]) for e in C.GATE_EXTENSIONS), F.lit("html"), F.lit("txt")), (F.col("p_partkey") % 15 + 1).cast("int"))
    mark = F.when(F.col("p_partkey") % 3 == 0, "_GPL.").when(F.col("p_partkey") % 3 == 1, "_gpl_code.").otherwise(".")
    url = F.concat(F.lit(f"https://{C.ARCHIVE_HOST}/resources/gpl/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), mark, ext)
    return read(spark, sf_dir, "part").select("p_partkey", url.alias("url"))


@query(rf"{_ARCHIVES_CTE} SELECT p_partkey, contains(lower(url), 'gpl') AND regexp_matches(lower(url), '{_GATE}') AS is_archive FROM a")
def archive_gate(spark, sf_dir):
    return archives(spark, sf_dir).select("p_partkey", urls.is_archive(F.col("url")).alias("is_archive"))


@query(rf"{_ARCHIVES_CTE} SELECT regexp_extract(lower(url), '{_GATE}', 0) AS ext, count(*) AS n FROM a WHERE contains(lower(url), 'gpl') AND regexp_matches(lower(url), '{_GATE}') GROUP BY 1")
def archive_ext_histogram(spark, sf_dir):
    return archives(spark, sf_dir).where(urls.is_archive(F.col("url"))).groupBy(urls.archive_extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query(r"SELECT p_partkey, v AS variant, CASE WHEN regexp_matches(n, '\.(tar\.gz|tar\.bz2|tar|tgz|zip|rar|gz|bz2)$') THEN regexp_replace(n, '^(.*?)(\.(?:tar\.gz|tar\.bz2|tar|tgz|zip|rar|gz|bz2))$', '\1' || v || '\2') ELSE n || v END AS name FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.zip' WHEN 2 THEN '.7z' ELSE '.GZ' END AS n FROM part), (SELECT unnest(['_2', '_3', '_v2', 'V2']) AS v)")
def reupload_variants(spark, sf_dir):
    ext = F.when(F.col("p_partkey") % 4 == 0, ".tar.gz").when(F.col("p_partkey") % 4 == 1, ".zip").when(F.col("p_partkey") % 4 == 2, ".7z").otherwise(".GZ")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", ext).alias("n"), F.explode(F.array(*map(F.lit, C.REUPLOADS))).alias("variant"))
    return rows.select("p_partkey", "variant", urls.insert_variant(F.col("n"), F.col("variant")).alias("name"))


@query(rf"WITH c AS (SELECT lower({_part('url', 2)}) AS host, lower({_part('url', 1)}) AS scheme FROM pages) SELECT host, scheme, count(*) AS n FROM c GROUP BY ROLLUP (host, scheme)")
def host_rollup(spark, sf_dir):
    c = read(spark, sf_dir, "pages").select(urls.netloc(F.col("url")).alias("host"), F.lower(F.regexp_extract("url", "^([A-Za-z]+):", 1)).alias("scheme"))
    return c.rollup("host", "scheme").agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(url, '^([a-z]+):', 1) AS scheme, count(*) AS n FROM pages GROUP BY 1")
def scheme_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme")).agg(F.count("*").alias("n"))


# --- extraction ----------------------------------------------------------------------------------------------------


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose site-relative links are rewritten to archives on the allowed host."""
    return read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", 'href="/', f'href=" https://{C.ARCHIVE_HOST}/').alias("body"))


_LINKED = f"""(SELECT page_id, url, regexp_replace(html, 'href="/', 'href=" https://{C.ARCHIVE_HOST}/', 'g') AS body FROM pages)"""
_HREF_SQL = C.HREF.replace("'", "''")
_URL_SQL = C.ARCHIVE_URL.replace("'", "''")


@query(f"SELECT page_id, trim(u) AS link FROM (SELECT page_id, unnest(regexp_extract_all(body, '{_HREF_SQL}', 1)) AS u FROM {_LINKED})")
def href_extract(spark, sf_dir):
    return linked_pages(spark, sf_dir).select("page_id", F.explode(extract.href_urls(F.col("body"))).alias("link"))


@query(f"SELECT host, count(DISTINCT u) AS links FROM (SELECT lower({_part('url', 2)}) AS host, unnest(regexp_extract_all(body, '{_HREF_SQL}', 1)) AS u FROM {_LINKED}) GROUP BY host")
def href_distinct_per_host(spark, sf_dir):
    rows = linked_pages(spark, sf_dir).select(urls.netloc(F.col("url")).alias("host"), F.explode(extract.href_urls(F.col("body"))).alias("u"))
    return rows.groupBy("host").agg(F.count_distinct("u").alias("links"))


@query(rf"""SELECT page_id, u AS link FROM (SELECT page_id, unnest(regexp_extract_all(body, 'href=["''](https://static\.tp-link\.com/[^"''>]+)["'']', 1)) AS u FROM
    (SELECT page_id, regexp_replace(html, 'href="/([A-Za-z]+)"', 'href="https://{C.ARCHIVE_HOST}/\1.zip"', 'g') AS body FROM pages)) WHERE regexp_matches(lower(u), '\.(tar\.gz|tar\.bz2|tar\.xz|tar|zip|rar|tgz|gz|bz2|xz|7z)$')""")
def href_allowlisted(spark, sf_dir):
    body = F.regexp_replace("html", 'href="/([A-Za-z]+)"', f'href="https://{C.ARCHIVE_HOST}/$1.zip"')
    return read(spark, sf_dir, "pages").select("page_id", F.explode(extract.fallback_urls(body)).alias("link"))


@query("""SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(body, '\\?model=([^"''&]+)', 1), lambda x: trim(x)),
    lambda t: length(t) BETWEEN 2 AND 40 AND regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '^[0-9]')))) AS models
    FROM (SELECT page_id, replace(html, 'href="/', 'href="?model=') AS body FROM pages)""".replace("\\\\", "\\"))
def model_link_harvest(spark, sf_dir):
    body = F.replace("html", F.lit('href="/'), F.lit('href="?model='))
    return read(spark, sf_dir, "pages").select("page_id", F.array_sort(extract.linked_models(body)).alias("models"))


@query(f"""SELECT doc_id, u AS url FROM (SELECT doc_id, rtrim(unnest(regexp_extract_all(t, '{_URL_SQL}', 0)), '.,;:!?''"') AS u FROM
    (SELECT doc_id, regexp_replace(text, '([.,;]) ', '\\1 https://{C.ARCHIVE_HOST}/x', 'g') AS t FROM documents))""")
def text_token_rstrip(spark, sf_dir):
    t = F.regexp_replace("text", "([.,;]) ", f"$1 https://{C.ARCHIVE_HOST}/x")
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(extract.text_urls(t)).alias("url"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT user_id, 'https://h/' || event_id AS url FROM events WHERE event_type <> 'error'")
def ndjson_extract(spark, sf_dir):
    line = F.when(F.col("event_type") == "error", '{"url": ').otherwise(F.concat(F.lit('{"url": "https://h/'), F.col("event_id").cast("string"), F.lit('", "status": "200"}')))
    body = read(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100)).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return extract.explode_urls(body, extract.ndjson_urls(F.col("body")), "user_id")


@query("""SELECT n_nationkey AS page, CASE WHEN p_partkey % 2 = 0 THEN 'direct' ELSE 'pair' END AS kind,
    CASE WHEN p_partkey % 2 = 0 THEN 'https://static.tp-link.com/' || p_brand END AS url, CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS model, CASE WHEN p_partkey % 2 = 1 THEN n_name END AS app_folder
    FROM nation JOIN part ON p_partkey % 25 = n_nationkey WHERE p_partkey % 3 <> 0""")
def tree_classify(spark, sf_dir):
    nation, part = read(spark, sf_dir, "nation"), read(spark, sf_dir, "part")
    href = F.when(F.col("p_partkey") % 3 == 0, "/other").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(f" https://{C.ARCHIVE_HOST}/"), "p_brand")).otherwise(F.concat(F.lit("?model="), "p_brand"))
    items = part.join(F.broadcast(nation), F.col("p_partkey") % 25 == F.col("n_nationkey")).groupBy("n_nationkey", F.floor(F.col("p_partkey") / 1000)).agg(F.collect_list(F.struct(href.alias("href"), F.col("n_name").alias("app_folder"), F.col("p_name").alias("model_name"))).alias("items"))
    html = F.concat(F.lit("<script>var productTree = "), F.to_json(F.create_map(F.lit("1"), F.col("items"))), F.lit("; </script>"))
    return extract.region_page_rows(items.select(F.col("n_nationkey").alias("page"), html.alias("body")))


@query("SELECT CAST(page_id // 50 AS BIGINT) AS page, url || '#' || page_id AS url, 'key' || page_id // 50 AS resume_key FROM pages")
def cdx_page_parse(spark, sf_dir):
    parsed = cdx_bodies(spark, sf_dir).select("page", extract.cdx_rows(F.col("body")).alias("r"))
    return parsed.select("page", F.explode("r.urls").alias("url"), "r.resume_key")


def cdx_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("page")).agg(F.array_join(F.collect_list(F.concat(F.lit('["'), F.concat("url", F.lit("#"), F.col("page_id").cast("string")), F.lit('"]'))), "\n").alias("lines"))
    body = F.concat(F.lit('["original"]\nbad line\n'), "lines", F.lit('\n[]\n["key'), F.col("page").cast("string"), F.lit('"]\n["late"]'))
    return rows.select("page", body.alias("body"))


@query("""WITH m AS (SELECT page_id, regexp_extract_all(replace(html, 'href="/', 'href="?model='), '<a href="\\?model=([^"]+)"', 1) AS m FROM pages)
    SELECT page_id, CAST(unnest(range(len(m))) AS INTEGER) AS pos, unnest(m) AS model FROM m""")
def index_model_links(spark, sf_dir):
    body = F.replace("html", F.lit('href="/'), F.lit('href="?model='))
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(extract.index_models(body)).alias("pos", "model"))


@query(f"""WITH p AS (SELECT page_id, body, list_filter(regexp_extract_all(body, '<a href="([^"]*)"', 1), lambda h: contains(h, '{C.ARCHIVE_HOST}') OR contains(h, '{C.SISTER_HOST}')) AS links FROM {_LINKED} WHERE NOT contains(lower(body), 'unusual traffic'))
    SELECT page_id, unnest(CASE WHEN len(links) > 0 THEN links ELSE list_transform(regexp_extract_all(body, '{_URL_SQL}', 0), lambda u: rtrim(u, '.,;:!?''"')) END) AS url FROM p""")
def search_page_links(spark, sf_dir):
    pages = linked_pages(spark, sf_dir).select("page_id", F.lit(200).alias("status"), F.lit("").alias("final_url"), "body")
    return extract.search_page_urls(pages, False).select("page_id", "url")


# --- generators ----------------------------------------------------------------------------------------------------


@query("SELECT CAST(d AS DATE) AS day, form, CASE form WHEN 0 THEN '/upload/gpl-code' ELSE '' END || strftime(d, '/%Y/%Y%m/%Y%m%d/') AS date_path FROM generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY) s(d), (SELECT unnest([0, 1])::INTEGER AS form)")
def date_paths(spark, sf_dir):
    """From the first day of orders to the last."""
    days = read(spark, sf_dir, "orders").agg(*(F.date_format(f("o_orderdate"), "yyyy-MM-dd") for f in (F.min, F.max))).first()
    return generate.date_paths(spark, *days)


@query(r"""SELECT url FROM (SELECT 'https://static.tp-link.com' || p || regexp_replace(b, '\.zip$', v || '.zip') AS url
    FROM (SELECT DISTINCT replace(p_name, ' ', '_') || '.zip' AS b FROM part), (SELECT unnest(['', '_2', '_3', '_v2', 'V2']) AS v),
    (SELECT CASE form WHEN 0 THEN '/upload/gpl-code' ELSE '' END || strftime(d, '/%Y/%Y%m/%Y%m%d/') AS p FROM generate_series(DATE '2024-02-28', DATE '2024-02-29', INTERVAL 1 DAY) s(d), (SELECT unnest([0, 1]) AS form)))""")
def date_candidates(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".zip")).alias("basename")).distinct()
    return generate.date_candidates(names, generate.date_paths(spark, "2024-02-28", "2024-02-29"))


_MODEL_CANDIDATES = f"""(SELECT 'https://{C.ARCHIVE_HOST}/resources/gpl/' || replace(p, '{{model}}', m) || '.' || e AS url FROM (SELECT DISTINCT upper(replace(p_name, ' ', '-')) AS m FROM part),
    (SELECT unnest(['GPL_{{model}}', '{{model}}_GPL', '{{model}}_gpl']) AS p), (SELECT unnest(['tar.gz', 'tar.bz2', 'tar', 'tgz', 'zip', 'rar', 'gz', 'bz2']) AS e))"""


def _models(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("model")).distinct()


@query(f"SELECT url FROM {_MODEL_CANDIDATES}")
def model_candidates(spark, sf_dir):
    return generate.model_candidates(_models(spark, sf_dir), generate.literals(spark, "pattern", C.CANONICAL_PATTERNS))


@query(f"""SELECT 'models' AS strategy, 'https://{C.ARCHIVE_HOST}/resources/gpl/' || replace(p, '{{model}}', m) || '.' || e[i] AS url FROM (SELECT DISTINCT upper(replace(p_name, ' ', '-')) AS m FROM part),
    (SELECT unnest(['GPL_{{model}}', '{{model}}_GPL', '{{model}}_gpl']) AS p), (SELECT ['tar.gz', 'tar.bz2', 'tar', 'tgz', 'zip', 'rar', 'gz', 'bz2'] AS e, unnest(range(1, 9)) AS i) ORDER BY m, p, i LIMIT 500""")
def model_candidates_capped(spark, sf_dir):
    none = spark.createDataFrame([], "basename string")
    return generate.candidates(spark, "models", none, _models(spark, sf_dir), generate.literals(spark, "pattern", C.CANONICAL_PATTERNS), none, cap=500)


@query(r"""SELECT 'dates' AS strategy, 'https://static.tp-link.com' || CASE form WHEN 0 THEN '/upload/gpl-code' ELSE '' END || strftime(d, '/%Y/%Y%m/%Y%m%d/') || replace(b, '.zip', v || '.zip') AS url
    FROM (SELECT DISTINCT replace(p_name, ' ', '_') || '.zip' AS b FROM part), (SELECT unnest(['', '_2', '_3', '_v2', 'V2']) AS v, unnest(range(5)) AS i),
    generate_series(DATE '2021-01-01', DATE '2021-01-09', INTERVAL 1 DAY) s(d), (SELECT unnest([0, 1]) AS form) ORDER BY d, form, b, i LIMIT 777""")
def date_candidates_capped(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".zip")).alias("basename")).distinct()
    none = spark.createDataFrame([], "model string, pattern string, date_path string")
    return generate.candidates(spark, "all", names, none, none, none, cap=777)


_TIER_PATHS = {
    "thorough": "(SELECT DISTINCT '/upload/gpl-code/' || strftime(o_orderdate, '%Y/%Y%m/%Y%m%d/') AS p FROM orders)",
    "exhaustive": "(SELECT CASE form WHEN 0 THEN '/upload/gpl-code' ELSE '' END || strftime(d, '/%Y/%Y%m/%Y%m%d/') AS p, strftime(d, '%Y%m%d') || form AS o FROM generate_series(DATE '2021-01-01', DATE '2021-01-07', INTERVAL 1 DAY) s(d), (SELECT unnest([0, 1]) AS form))",
}


def _tier(tier: str, order: str, more: str) -> str:
    """SQL for the models' candidates on a tier's paths."""
    return f"""SELECT 'models' AS strategy, 'https://{C.ARCHIVE_HOST}' || d.p || replace(t.p, '{{model}}', m) || '.' || e[i] AS url FROM (SELECT DISTINCT upper(replace(p_name, ' ', '-')) AS m FROM part),
        (SELECT unnest(['GPL_{{model}}', '{{model}}_GPL', '{{model}}_gpl']) AS p) t, (SELECT ['tar.gz', 'tar.bz2', 'tar', 'tgz', 'zip', 'rar', 'gz', 'bz2'] AS e, unnest(range(1, 9)) AS i), {_TIER_PATHS[tier]} d ORDER BY m, t.p, i, {order} {more}"""


@query(_tier("thorough", "d.p", "LIMIT 100000"))
def thorough_candidates_capped(spark, sf_dir):
    """Models on the folders of all dates of orders."""
    line = F.concat(F.lit(f"https://{C.ARCHIVE_HOST}/upload/gpl-code"), F.date_format("o_orderdate", "/yyyy/yyyyMM/yyyyMMdd/"), F.lit("x.zip"))
    dirs = generate.known_date_dirs(read(spark, sf_dir, "orders").select(line.alias("value")))
    none = spark.createDataFrame([], "basename string")
    return generate.candidates(spark, "models", none, _models(spark, sf_dir), generate.literals(spark, "pattern", C.CANONICAL_PATTERNS), dirs, "thorough", cap=100_000)


@query(_tier("exhaustive", "d.o", "LIMIT 20000 OFFSET 5000"))
def exhaustive_candidates_shard(spark, sf_dir):
    """A shard of the models on every day's paths: the ordinals from 5,000 to 24,999."""
    none = spark.createDataFrame([], "basename string, date_path string")
    plan = generate.plan_candidates(spark, "models", none, _models(spark, sf_dir), generate.literals(spark, "pattern", C.CANONICAL_PATTERNS), none, "exhaustive", end="2021-01-07")
    return plan.slice(5_000, 25_000).drop("ordinal")


@query(f"SELECT 'models' AS strategy, count(*) AS n FROM {_MODEL_CANDIDATES} UNION ALL SELECT 'dates', count(DISTINCT p_name) * 5 * 20 FROM part")
def tier_union_counts(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(".zip")).alias("basename")).distinct()
    every = generate.candidates(spark, "all", names, _models(spark, sf_dir), generate.literals(spark, "pattern", C.CANONICAL_PATTERNS), spark.createDataFrame([], "date_path string"), start="2024-01-01", end="2024-01-10")
    return every.groupBy("strategy").agg(F.count("*").alias("n"))


@query("""SELECT r AS region, count(c_name) AS customers FROM (SELECT chr(CAST(97 + a AS INTEGER)) || chr(CAST(97 + b AS INTEGER)) AS r FROM range(26) x(a), range(26) y(b))
    LEFT JOIN (nation JOIN customer ON c_nationkey = n_nationkey) ON lower(substr(n_name, 1, 2)) = r GROUP BY r""")
def region_codes(spark, sf_dir):
    """All codes, and how many customers live where the name begins with them."""
    named = read(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.substring("n_name", 1, 2)).alias("region"))
    held = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    of = named.join(held, "n_nationkey").groupBy("region").agg(F.sum("n").alias("customers"))
    return generate.region_codes(spark).join(of, "region", "left").select("region", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT unnest(string_split('" + " ".join(C.REGIONS) + "', ' ')) AS region UNION SELECT lower(substr(n_name, 1, 2)) FROM nation UNION SELECT lower(substr(r_name, 1, 2)) FROM region")
def region_union(spark, sf_dir):
    two = lambda name, c: read(spark, sf_dir, name).select(F.lower(F.substring(c, 1, 2)).alias("region"))
    return generate.all_regions(spark, two("nation", "n_name"), two("region", "r_name"))


@query("SELECT DISTINCT '/upload/gpl-code/' || strftime(o_orderdate, '%Y/%Y%m/%Y%m%d/') AS date_path FROM orders")
def known_date_dirs(spark, sf_dir):
    line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, f"https://{C.ARCHIVE_HOST}/upload/gpl-code").otherwise(f"https://{C.ARCHIVE_HOST}"), F.date_format("o_orderdate", "/yyyy/yyyyMM/yyyyMMdd/"), F.lit("x.zip?q=/1/2"))
    return generate.known_date_dirs(read(spark, sf_dir, "orders").select(line.alias("value")))


@query("SELECT p.p || '/' || replace(s_name, ' ', '_') || '/*' AS prefix, e.e AS endpoint FROM supplier, (SELECT unnest(['" + "','".join(C.CRAWL_PREFIXES) + "']) AS p) p, (SELECT unnest(['/search/code', '/search/issues']) AS e) e")
def request_plan(spark, sf_dir):
    """Prefixes of suppliers below each known prefix, at each endpoint."""
    names = read(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit(" "), F.lit("_")).alias("name"))
    every = generate.requests(spark, known=C.CRAWL_PREFIXES, name=names, endpoint=C.CODE_ENDPOINTS)
    return every.select(F.concat_ws("/", "known", "name", F.lit("*")).alias("prefix"), "endpoint")


@query("SELECT s_suppkey, CAST(unnest(range(s_suppkey % 4)) AS INTEGER) AS page FROM supplier")
def crawl_pages(spark, sf_dir):
    return generate.crawl_pages(read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("pages"))).select("s_suppkey", "page")


# --- tokens --------------------------------------------------------------------------------------------------------


def firmware_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.element_at(F.array(*map(F.lit, ("AX", "Archer_C", "TL-WR8", "Deco M", "X", "TapoC", "BE"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ("(US)_V1_1.0.1 Build 20210503.bin", "v4_EU_1.2.0.zip", "_V2_200714.rar", "-UP-ver1-2-3.bin", "_JP_0.9.1_1.2.tar.gz"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    key = F.concat(F.when(F.col("p_partkey") % 11 == 0, "manual/").otherwise("firmware/"), series, F.col("p_size").cast("string"), tail)
    return read(spark, sf_dir, "part").select("p_partkey", key.alias("key"), F.when(F.col("p_partkey") % 13 == 0, 0).otherwise(F.col("p_partkey")).alias("size"))


_KEYS = """(SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'manual/' ELSE 'firmware/' END || (['AX', 'Archer_C', 'TL-WR8', 'Deco M', 'X', 'TapoC', 'BE'])[1 + p_partkey % 7] || p_size
    || (['(US)_V1_1.0.1 Build 20210503.bin', 'v4_EU_1.2.0.zip', '_V2_200714.rar', '-UP-ver1-2-3.bin', '_JP_0.9.1_1.2.tar.gz'])[1 + p_partkey % 5] AS key, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_partkey END AS size FROM part)"""


def _last(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def _cut(x: str, pattern: str, by: str = "", flags: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}'" + (f", '{flags}')" if flags else ")")


def _token(x: str) -> str:
    """What model_token does, for an engine without lookaround: what lookaround would leave is put back."""
    x = _cut(f"replace({_cut(_cut(x, C.TOKEN_EXTENSION), r'^\([A-Z]\)\s*')}, '_', ' ')", r"[(\[][^)\]]*[)\]]", " ", "g")
    x = _cut(x, f"(?i)^({C.BRANDS})([A-Za-z0-9])", r"\1 \2")
    x = _cut(x, "(?is)" + C.TOKEN_VERSION.replace(r"(?<=\d)v", r"(\d)v") + ".*", r"\1")
    x = f"trim({_cut(_cut(x, '^[ _-]+|[ _-]+$', '', 'g'), r'\s+', ' ', 'g')})"
    return f"trim({_cut(f"' ' || {x}", C.TOKEN_TAIL)})"


@query(rf"""WITH n AS (SELECT {_cut(_cut("key", "^firmware/"), r"^\([^)]{1,8}\)")} AS n FROM {_KEYS} WHERE key LIKE 'firmware/%'),
    m AS (SELECT {_cut(_cut(_cut(_cut(_cut("n", C.FIRMWARE_STAMP), C.FIRMWARE_EXTENSION), "(?is)" + C.FIRMWARE_REGION.replace("(?=[-_]|$)", "(?:[-_].*)?$")), "(?s)" + C.FIRMWARE_VERSION + ".*"), "^[_. -]+|[_. -]+$", "", "g")} AS m
        FROM n WHERE NOT regexp_matches(n, '^\d[\d.]*[\s_]')),
    g AS (SELECT m, {_cut(_cut("m", r"[Vv]\d+(\.\d+)*$"), "[._ -]+$")} AS bare FROM m WHERE length(m) >= {C.FIRMWARE_LEAST} AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '(?i)^\d+phase'))
    SELECT m AS model FROM g UNION SELECT bare FROM g WHERE length(bare) >= {C.FIRMWARE_LEAST}""")
def firmware_tokens(spark, sf_dir):
    return firmware_keys(spark, sf_dir).select(F.explode(tokens.firmware_models(F.col("key"))).alias("model")).distinct()


@query(f"SELECT p_partkey, {_token(_last('key'))} AS token FROM {_KEYS}")
def model_normalize(spark, sf_dir):
    return firmware_keys(spark, sf_dir).select("p_partkey", tokens.model_token(F.substring_index("key", "/", -1)).alias("token"))


@query(r"""WITH t AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'AX' WHEN 1 THEN 'X' WHEN 2 THEN 'BE' ELSE 'TL-W' END || p_size AS t FROM part)
    SELECT t AS token, t AS model FROM t UNION ALL SELECT t, 'Archer ' || t FROM t WHERE regexp_matches(t, '(?i)^(AX|AXE|AC|GX|BE|EX|A|C|GE)[0-9]') UNION ALL SELECT t, 'Deco ' || t FROM t WHERE regexp_matches(t, '(?i)^(X|XE|BE|PX|M|S|P)[0-9]')""")
def token_variants(spark, sf_dir):
    head = F.when(F.col("p_partkey") % 4 == 0, "AX").when(F.col("p_partkey") % 4 == 1, "X").when(F.col("p_partkey") % 4 == 2, "BE").otherwise("TL-W")
    t = read(spark, sf_dir, "part").select(F.concat(head, F.col("p_size").cast("string")).alias("token")).distinct()
    return t.select("token", F.explode(tokens.token_variants(F.col("token"))).alias("model"))


@query(rf"""{_ARCHIVES_CTE}, c AS (
        SELECT {_last("key")} AS c FROM {_KEYS} WHERE size > 0 AND key LIKE 'firmware/%'
        UNION ALL SELECT unnest(string_split_regex({_cut(_cut(_last("url"), C.TOKEN_ARCHIVE), C.TOKEN_MARKERS, "_", "g")}, '_+')) FROM a
    ), t AS (SELECT DISTINCT {_token("c")} AS t FROM c),
    k AS (SELECT t, NOT regexp_matches(t, '(?i)^({C.BRANDS})[A-Za-z0-9]') AS bare FROM t WHERE length(t) BETWEEN {C.TOKEN_LENGTHS[0]} AND {C.TOKEN_LENGTHS[1]} AND regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '^\d'))
    SELECT t AS model FROM k UNION SELECT 'Archer ' || t FROM k WHERE bare AND regexp_matches(t, '{C.ARCHER_SERIES}') UNION SELECT 'Deco ' || t FROM k WHERE bare AND regexp_matches(t, '{C.DECO_SERIES}')""")
def model_wordlist(spark, sf_dir):
    return tokens.model_wordlist(firmware_keys(spark, sf_dir), archives(spark, sf_dir).select("url"))


_NAMES = "(SELECT CASE p_partkey % 6 WHEN 0 THEN 'GPL_' || p_size || '.zip' WHEN 1 THEN p_brand || '_gpl_code_2.tar.gz' WHEN 2 THEN p_brand || '-GPL.rar' WHEN 3 THEN p_brand || '.tgz' WHEN 4 THEN p_brand || '_OpenSource.zip' ELSE p_brand || 'Gpl_20190213.gz' END AS basename FROM part)"


@query(rf"""WITH s AS (SELECT regexp_replace(basename, '(?i)\.(bin|tar\.gz|tar\.bz2|zip|tar|gz|bz2|rar|tgz|rollback)$', '') AS s FROM {_NAMES}),
    p AS (SELECT s, regexp_extract(s, '(?is)^(.*?)(gpl)(.*)$', 1) AS b, regexp_extract(s, '(?is)^(.*?)(gpl)(.*)$', 2) AS t, regexp_extract(s, '(?is)^(.*?)(gpl)(.*)$', 3) AS a FROM s),
    q AS (SELECT *, regexp_replace(a, '[_-][0-9]{{8}}$|[_-][Vv][0-9]+$|[_-][0-9]+$', '') AS r FROM p)
    SELECT unnest(['GPL_{{model}}', '{{model}}_GPL', '{{model}}_gpl']) AS pattern UNION SELECT CASE
        WHEN t = '' AND s LIKE '%\_OpenSource' ESCAPE '\' THEN '{{model}}_OpenSource' WHEN t = '' AND s LIKE '%\_opensource' ESCAPE '\' THEN '{{model}}_opensource' WHEN t = '' THEN '{{model}}'
        WHEN b = '' THEN t || CASE WHEN substr(a, 1, 1) IN ('_', '-') THEN substr(a, 1, 1) ELSE '' END || '{{model}}'
        ELSE '{{model}}' || CASE WHEN right(b, 1) IN ('_', '-') THEN right(b, 1) ELSE '' END || t || CASE WHEN r IN ('_src', '_code', '_SRC', '_CODE', '_OpenSource', '_opensource') THEN r ELSE '' END END FROM q""")
def corpus_patterns(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("GPL_"), size, F.lit(".zip"))).when(k == 1, F.concat("p_brand", F.lit("_gpl_code_2.tar.gz"))).when(k == 2, F.concat("p_brand", F.lit("-GPL.rar")))
        .when(k == 3, F.concat("p_brand", F.lit(".tgz"))).when(k == 4, F.concat("p_brand", F.lit("_OpenSource.zip"))).otherwise(F.concat("p_brand", F.lit("Gpl_20190213.gz")))
    )
    return tokens.corpus_patterns(read(spark, sf_dir, "part").select(name.alias("basename")))


# --- verification --------------------------------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN NULL WHEN 'purchase' THEN 403 ELSE 200 END"
_OUTCOMES = f"""(SELECT 'https://h/e' || event_id AS url, CAST({_STATUS} AS INTEGER) AS status, {_STATUS} IS NOT NULL AND {_STATUS} = 200 AS live, CAST(floor(value) AS BIGINT) AS size, CASE WHEN event_id % 3 <> 0 THEN 'v' || user_id END AS version_id,
    CASE WHEN {_STATUS} = 200 THEN NULL WHEN {_STATUS} IS NOT NULL THEN 'http' WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'network' END AS error_type FROM events)"""


def responses_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "error", 404).when(kind == "signup", F.lit(None)).when(kind == "purchase", 403).otherwise(200).cast("int")
    version = F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.concat(F.lit("v"), F.col("user_id").cast("string")))
    headers = F.create_map(F.lit("Content-Length"), F.floor("value").cast("string"), F.lit("x-amz-version-id"), version)
    return e.select(
        F.concat(F.lit("https://h/e"), F.col("event_id").cast("string")).alias("request_url"), status.alias("status"),
        F.when(status.isNull() & (F.col("event_id") % 2 == 0), "timeout").alias("error"), headers.alias("headers"), F.col("ts").alias("fetched_at"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses_of_events(spark, sf_dir)
    old = r.withColumn("fetched_at", F.col("fetched_at") - F.expr("INTERVAL 1 DAY")).withColumn("status", F.lit(500))  # of two responses the latest counts
    return verify.classified(r.select(F.col("request_url").alias("url")), r.unionByName(old))


@query(f"SELECT url, live, size, version_id, status, error_type FROM {_OUTCOMES}")
def head_classify(spark, sf_dir):
    return outcomes(spark, sf_dir).select("url", "live", "size", "version_id", "status", "error_type")


@query(f"SELECT 'live' AS part, url, version_id AS detail FROM {_OUTCOMES} WHERE live UNION ALL SELECT 'dead', url, error_type FROM {_OUTCOMES} WHERE NOT live")
def live_dead_split(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    return verify.verified(o).select(F.lit("live").alias("part"), "url", F.col("version_id").alias("detail")).union(verify.dead(o).select(F.lit("dead"), "url", "error_type"))


@query(f"SELECT count(*) AS total_urls, count(*) AS unique_urls, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE NOT live) AS dead FROM {_OUTCOMES}")
def verify_stats(spark, sf_dir):
    return verify.run_stats(outcomes(spark, sf_dir))


@query(f"SELECT 'https://h/e' || event_id AS url FROM events WHERE {_STATUS} = 200")
def existence_semi(spark, sf_dir):
    r = responses_of_events(spark, sf_dir)
    old = r.withColumn("fetched_at", F.col("fetched_at") - F.expr("INTERVAL 1 DAY")).withColumn("status", F.lit(200))  # what was there once need not be now
    return verify.existing(r.select(F.col("request_url").alias("url")), r.unionByName(old))


_SPACED = "(SELECT DISTINCT p_name || ' v' || p_size || '_GPL.zip' AS b, p_size AS z FROM part)"


def heads_of_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names with spaces, and captured answers of the origin for their paths on two days: 200 or else 404 by the size; where
    it is divisible by 5 there was a 200 before."""
    part = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" v"), F.col("p_size").cast("string"), F.lit("_GPL.zip")).alias("basename"), F.col("p_size").alias("z")).distinct()
    public = F.concat(F.lit(f"https://{C.ARCHIVE_HOST}/2024/202402/202402"), F.when(F.col("z") % 2 == 0, "28").otherwise("29"), F.lit("/"), "basename")
    now = part.select(urls.origin_url(urls.canonical(public)).alias("request_url"), F.when(F.col("z") % 3 == 0, 200).otherwise(404).alias("status"), F.lit("2024-03-01").cast("timestamp").alias("fetched_at"), "z")
    before = now.where("z % 5 = 0").withColumn("status", F.lit(200)).withColumn("fetched_at", F.lit("2024-02-29").cast("timestamp"))
    return part.select("basename"), stored(now.unionByName(before).drop("z"), "heads")


@query(f"SELECT 'dates' AS strategy, 'https://{C.ARCHIVE_HOST}/2024/202402/202402' || CASE z % 2 WHEN 0 THEN '28' ELSE '29' END || '/' || replace(b, ' ', '%20') AS url FROM {_SPACED} WHERE z % 3 = 0")
def bruteforce_hits(spark, sf_dir):
    """Candidates as they are made, looked up by what the origin is asked for."""
    names, heads = heads_of_names(spark, sf_dir)
    none = spark.createDataFrame([], "model string, pattern string, date_path string")
    every = generate.candidates(spark, "dates", names, none, none, none, start="2024-02-28", end="2024-02-29")
    return verify.existing(every, heads).select("strategy", urls.canonical(F.col("url")).alias("url"))


@query(f"SELECT 'dates' AS strategy, 'https://{C.ARCHIVE_HOST}/2024/202402/202402' || CASE z % 2 WHEN 0 THEN '28' ELSE '29' END || '/' || replace(b, ' ', '%20') AS url FROM {_SPACED} WHERE z % 3 = 0")
def bruteforce_sweep(spark, sf_dir):
    """The same by a sweep of three ranges, read from its table of hits."""
    names, heads = heads_of_names(spark, sf_dir)
    none = spark.createDataFrame([], "model string, pattern string, date_path string")
    run = DurableSweep(spark, stored_path(spark, "sweep"), stored_path(spark, "data"), lambda asked: asked.join(verify.latest(heads), "request_url", "left"))
    plan = run.prepare("dates", names, none, none, none, start="2024-02-28", end="2024-02-29", ranges=3)
    run.run(plan)
    return run.hits().select("strategy", "url")


@query("SELECT CAST(c_custkey AS VARCHAR) AS url FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def unseen_anti(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("url"))
    return verify.unseen(customers, read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("url")))


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("source", F.concat(F.lit("HTTP://H/"), F.substring(F.sha2("text", 256), 1, 3)).alias("url"), F.concat(F.lit("run"), (F.col("doc_id") % 7).cast("string")).alias("run_id"))


_DISCOVERIES = "(SELECT source, 'https://h/' || substr(sha256(text), 1, 3) AS url, 'run' || doc_id % 7 AS run_id FROM documents)"


@query(f"""WITH e AS (SELECT source, count(DISTINCT url) AS raw, count(DISTINCT url) AS "unique" FROM {_DISCOVERIES} GROUP BY source)
    SELECT source, raw, "unique", NULL::BIGINT AS global_unique FROM e UNION ALL SELECT NULL, CAST(sum(raw) AS BIGINT), CAST(sum("unique") AS BIGINT), (SELECT count(DISTINCT url) FROM {_DISCOVERIES}) FROM e""")
def source_counts(spark, sf_dir):
    return verify.source_counts(discoveries(spark, sf_dir).select("source", "url"))


@query(f"SELECT DISTINCT url FROM {_DISCOVERIES}")
def source_union(spark, sf_dir):
    return verify.canonical_set(discoveries(spark, sf_dir), "url")


@query(f"WITH d AS (SELECT DISTINCT source, url FROM {_DISCOVERIES}) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM d a JOIN d b ON a.url = b.url AND a.source < b.source GROUP BY 1, 2")
def source_overlap(spark, sf_dir):
    return verify.source_overlap(discoveries(spark, sf_dir))


@query(f"SELECT url, run_id, source FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY run_id, source) AS n FROM {_DISCOVERIES}) WHERE n = 1")
def first_seen(spark, sf_dir):
    return verify.first_seen(discoveries(spark, sf_dir).withColumn("url", urls.canonical(F.col("url"))))


_RUN = "(SELECT DISTINCT user_id || '/' || event_id % 97 AS url, event_type FROM events)"


@query(f"SELECT 'added' AS change, url FROM (SELECT url FROM {_RUN} WHERE event_type = 'purchase' EXCEPT SELECT url FROM {_RUN} WHERE event_type = 'signup') UNION ALL SELECT 'removed', url FROM (SELECT url FROM {_RUN} WHERE event_type = 'signup' EXCEPT SELECT url FROM {_RUN} WHERE event_type = 'purchase')")
def run_diff(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string")).alias("url"), "event_type")
    return verify.run_diff(runs.where("event_type = 'signup'"), runs.where("event_type = 'purchase'"))


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def keep_first_order(spark, sf_dir):
    return verify.keep_first(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query("SELECT DISTINCT 'https://h/' || user_id AS url FROM events")
def incremental_dedup(spark, sf_dir):
    """Lists that arrive in two runs, as a stream: each URL is written once, to the table that is read here."""
    lines = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("HTTP://h/"), F.col("user_id").cast("string")).alias("value"))
    folder = stored_path(spark, "stream")
    for run in (0, 1):
        lines.where(F.col("event_id") % 2 == run).select("value").write.text(f"{folder}/scrapes/run-{run}")
        dedup.append(dedup.distinct_urls(dedup.url_stream(spark, f"{folder}/scrapes")), f"{folder}/urls", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("url string").parquet(f"{folder}/urls")


_SWEEP_PAGES = """(SELECT DISTINCT 'M' || o_custkey % 40 AS model, (['us','de','fr','pl','se'])[1 + o_orderkey % 5] AS region, 'https://static.tp-link.com/N' || o_custkey % 40 || '_GPL.zip' AS url FROM orders WHERE o_orderstatus = 'F')"""


@query(f"""WITH pages AS {_SWEEP_PAGES}, seed AS (SELECT DISTINCT 'M' || c_custkey % 20 AS model FROM customer), probe AS (SELECT model, region, url FROM pages JOIN seed USING (model) WHERE region IN ('us', 'de', 'fr')),
    rest AS (SELECT model, region, url FROM pages WHERE model IN (SELECT model FROM probe) AND region IN ('pl', 'se')) SELECT * FROM probe UNION SELECT * FROM rest""")
def sweep_probe_expand(spark, sf_dir):
    return swept(spark, sf_dir)


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.concat(F.lit("M"), (F.col("o_custkey") % 40).cast("string"))
    region = F.element_at(F.array(*map(F.lit, ("us", "de", "fr", "pl", "se"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    body = F.concat(F.lit(f'<a href="https://{C.ARCHIVE_HOST}/N'), (F.col("o_custkey") % 40).cast("string"), F.lit('_GPL.zip">'))
    pages = read(spark, sf_dir, "orders").select(F.lower(m).alias("model"), region.alias("region"), body.alias("body"), F.when(F.col("o_orderstatus") == "F", 200).otherwise(404).alias("status")).distinct()
    seed = read(spark, sf_dir, "customer").select(F.concat(F.lit("M"), (F.col("c_custkey") % 20).cast("string")).alias("model"))
    return sweep(seed, seed.limit(0), generate.literals(spark, "region", ("us", "de", "fr", "pl", "se")), pages)


_SWEPT = SQL["sweep_probe_expand"]


@query(f"SELECT model, list_sort(list_distinct(list(url))) AS urls FROM ({_SWEPT}) GROUP BY model")
def validated_models(spark, sf_dir):
    return swept(spark, sf_dir).groupBy("model").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonicalize, distinct, gate, manifest."""
    found = verify.canonical_set(archives(spark, sf_dir), "url").where(urls.is_archive(F.col("url")))
    return found.select("url", urls.manifest_line(F.col("url")).alias("line"))


@query(rf"{_ARCHIVES_CTE}, c AS (SELECT DISTINCT url, substr(url, 9) AS k FROM a WHERE contains(lower(url), 'gpl') AND regexp_matches(lower(url), '{_GATE}')) SELECT url, 'cp --if-size-differ ''s3://' || k || ''' ''gpl/' || k || '''' AS line FROM c")
def verify_front_half(spark, sf_dir):
    return flagship(spark, sf_dir)


# --- files ---------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT {_canonical('url')} AS url FROM pages")
def scrape_folder_corpus(spark, sf_dir):
    """Page URLs written as lists in run folders, then read as verification reads them."""
    folder = stored_path(spark, "scrapes")
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("run-"), (F.col("page_id") % 3).cast("string")).alias("run"), F.concat(F.lit("  "), "url").alias("value"))
    pages.write.partitionBy("run").text(folder)
    return readers.read_corpus(spark, folder)


@query(f"SELECT key, CAST(size AS BIGINT) AS size FROM {_KEYS}")
def firmware_listing_read(spark, sf_dir):
    """Keys written as a JSON array by tasks, with entries that are left out, then cut into elements by tasks."""
    path = stored_path(spark, "listing.json")
    entries = firmware_keys(spark, sf_dir).orderBy("key").select(F.to_json(F.struct("key", "size")).alias("value"))
    sinks.write_whole(entries, path, b'[{"key": 3}, {"no": 1}, "x", "]\\"[{", ', ",\n", b"]")
    return readers.firmware_listing(spark, path).select("key", "size")


@query(f"SELECT url, live, size, version_id, status, error_type FROM {_OUTCOMES}")
def stream_outcomes(spark, sf_dir):
    """Responses that come in two batches, older ones of a URL before and after the one that counts, and repeated; what the
    stream's state lets through is what the batch operator classifies."""
    r = responses_of_events(spark, sf_dir)
    old = r.withColumn("fetched_at", F.col("fetched_at") - F.expr("INTERVAL 1 DAY")).withColumn("status", F.lit(500))
    n = F.pmod(F.xxhash64("request_url"), F.lit(3))
    folder = stored_path(spark, "responses")
    waves = r.where(n == 0).unionByName(old.where(n != 0)), r.where(n != 0).unionByName(old.where(n != 1)).unionByName(r.where(n == 2))
    for wave, rows in enumerate(waves):
        rows.write.parquet(f"{folder}/in/wave={wave}")
        stream = spark.readStream.schema(r.schema).parquet(f"{folder}/in/wave=*")
        outcomes_stream.write(outcomes_stream.outcomes(stream, keep="4000 days"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    counted = spark.read.parquet(f"{folder}/out").where("kind = 'outcome'").drop("batch", "kind", "attempt")
    return verify.classified(r.select(F.col("request_url").alias("url")), counted).select("url", "live", "size", "version_id", "status", "error_type")


@query(rf"{_HARD_CTE} SELECT page_id, url_decode(regexp_replace(regexp_extract(url, '[^/]*$'), '%(z)', '%25\1', 'g')) AS basename FROM h")
def known_basenames(spark, sf_dir):
    return tokens.known_basenames(hard_urls(spark, sf_dir).withColumnRenamed("url", "value"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 50 AS DOUBLE) WHEN 1 THEN greatest(0.0, CAST(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE)) END AS seconds FROM events""")
def retry_waits(spark, sf_dir):
    k = F.col("event_id") % 3
    value = F.when(k == 0, (F.col("event_id") % 50).cast("string")).when(k == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    return read(spark, sf_dir, "events").select("event_id", urls.retry_seconds(value, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("seconds"))


@query(f"SELECT source, count(DISTINCT url) AS n FROM {_DISCOVERIES} GROUP BY source")
def views_in_sql(spark, sf_dir):
    d = discoveries(spark, sf_dir)
    register_views(discoveries=d.select("source", "url"), canonical=d.select("source", urls.canonical(F.col("url")).alias("url")))
    return spark.sql("SELECT source, count(DISTINCT c.url) AS n FROM canonical c GROUP BY source")


@query(f"""SELECT 'there' AS part, url FROM {_OUTCOMES} WHERE live UNION ALL SELECT 'unseen', 'https://h/e' || event_id || '/new' FROM events WHERE event_id % 3 = 0""")
def bucketed_lookup(spark, sf_dir):
    """Candidates looked up in a table of responses and one of discoveries, neither of which is moved for it."""
    r = responses_of_events(spark, sf_dir)
    old = r.withColumn("fetched_at", F.col("fetched_at") - F.expr("INTERVAL 1 DAY")).withColumn("status", F.lit(200))
    mark, path = uuid.uuid4().hex[:12], stored_path(spark, "tables")
    there = tables.response_table(r.unionByName(old).select("request_url", "status", "error", "fetched_at"), f"responses_{mark}", f"{path}/responses", 16)
    known = tables.discovery_table(r.select(F.regexp_replace("request_url", "^https", "HTTP").alias("url")), f"discoveries_{mark}", f"{path}/discoveries", 16)
    asked = r.select(F.regexp_replace("request_url", "^https", "http").alias("url"))
    both = asked.unionByName(read(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.format_string("https://h/e%d/new", "event_id").alias("url")))
    found = tables.existing_in(asked, there).select(F.lit("there").alias("part"), urls.canonical(F.col("url")).alias("url"))
    return found.unionByName(tables.unseen_in(both, known).select(F.lit("unseen").alias("part"), "url"))


@query(f"SELECT DISTINCT {_canonical('url')} AS url FROM pages WHERE page_id % 3 <> 1 OR page_id % 2 = 0")
def incremental_corpus(spark, sf_dir):
    """Three run folders, taken in one by one; the second is then overwritten with half of its lines. No file is read again but
    those."""
    folder = stored_path(spark, "runs")
    corpus = Corpus(spark, folder, stored_path(spark, "corpus"))
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("value"))
    for run in range(3):
        pages.where(F.col("page_id") % 3 == run).select("value").write.text(f"{folder}/run-{run}")
        corpus.update()
    pages.where("page_id % 3 = 1 AND page_id % 2 = 0").select("value").write.mode("overwrite").text(f"{folder}/run-1")
    corpus.update()
    return corpus.urls()


_SQL_TEXT = rf"""{_HARD_CTE}, c AS (SELECT page_id, {_canonical('url')} AS url FROM h)
    SELECT page_id, url, 'https://s3.amazonaws.com/' || substr(url, 9) AS origin, 'https://s3.r1.amazonaws.com/' || substr(url, 9) AS regional, 's3://' || url_decode(substr(url, 9)) AS object,
        'cp --if-size-differ ''s3://' || url_decode(substr(url, 9)) || ''' ''gpl/' || url_decode(substr(url, 9)) || '''' AS line FROM c"""


@query(_SQL_TEXT)
def sql_url_functions(spark, sf_dir):
    """Canonical URLs and keys in SQL text alone."""
    sql.register(spark)
    hard_urls(spark, sf_dir).createOrReplaceTempView("hard_urls")
    return spark.sql("""SELECT page_id, url, url_origin(url) AS origin, url_regional(url, 'r1') AS regional, url_object(url) AS object, url_copy_line(url) AS line
        FROM (SELECT page_id, url_canonical(url) AS url FROM hard_urls)""")


@query(rf"""{_ARCHIVES_CTE} SELECT p_partkey, 'archive' AS kind, url AS text FROM a WHERE contains(lower(url), 'gpl') AND regexp_matches(lower(url), '{_GATE}')
    UNION ALL SELECT p_partkey, 'token', {_token(_last('key'))} FROM {_KEYS}""")
def sql_gate_and_tokens(spark, sf_dir):
    """The archive gate and model tokens in SQL text alone."""
    sql.register(spark)
    archives(spark, sf_dir).createOrReplaceTempView("archive_urls")
    firmware_keys(spark, sf_dir).createOrReplaceTempView("firmware_keys")
    return spark.sql("""SELECT p_partkey, 'archive' AS kind, url AS text FROM archive_urls WHERE url_is_archive(url)
        UNION ALL SELECT p_partkey, 'token', model_token(substring_index(key, '/', -1)) FROM firmware_keys""")


@query("SELECT CAST(page_id // 50 AS BIGINT) AS page, url || '#' || page_id AS url, 'key' || page_id // 50 AS resume_key FROM pages")
def sql_cdx_table_function(spark, sf_dir):
    """Capture pages by the table function."""
    sql.register(spark)
    cdx_bodies(spark, sf_dir).createOrReplaceTempView("cdx_bodies")
    return spark.sql("SELECT page, c.url, c.resume_key FROM cdx_bodies, LATERAL cdx_page(body) AS c(nth, url, resume_key)")


def lists_of_runs(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the lists of all runs and sources, written by tasks."""
    folder = stored_path(spark, "lists")
    discoveries(spark, sf_dir).where("source <> ''").select(F.col("run_id").alias("run"), "source", F.col("url").alias("value")).write.partitionBy("run", "source").text(folder)
    return folder


@query(f"SELECT DISTINCT url FROM {_DISCOVERIES} WHERE source <> ''")
def datasource_union(spark, sf_dir):
    """The lists of all runs and sources, read by the format's name."""
    datasource.register(spark)
    return verify.canonical_set(spark.read.format("scrapes").load(lists_of_runs(spark, sf_dir)), "url")


@query(f"SELECT source, url, count(*) AS n FROM {_DISCOVERIES} WHERE run_id IN ('run2', 'run5') AND source <> '' GROUP BY source, url")
def datasource_pushdown(spark, sf_dir):
    """Two of seven runs; the files of the others are not opened."""
    datasource.register(spark)
    rows = spark.read.format("scrapes").load(lists_of_runs(spark, sf_dir)).where(F.col("run").isin("run2", "run5"))
    return rows.groupBy("source", urls.canonical(F.col("url")).alias("url")).agg(F.count("*").alias("n"))


# --- sources, asked from captured responses that are made of the tables ----------------------------------------------

_HOST = f"https://{C.ARCHIVE_HOST}"


def answers(spark: SparkSession, *frames: DataFrame) -> scrape.Ask:
    """frames: request_url, status, body and perhaps final_url."""
    whole = None
    for f in frames:
        final = F.col("final_url") if "final_url" in f.columns else F.lit("")
        part = f.select("request_url", F.col("status").cast("int").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("map<string,string>").alias("headers"), "body", final.alias("final_url"), F.lit(None).cast("timestamp").alias("fetched_at"))
        whole = part if whole is None else whole.unionByName(part)
    whole = stored(whole, "responses")
    return lambda asked: fetch.replay(asked, whole)


def lists(rows: DataFrame, line, *keys: str, sep: str = "\n") -> DataFrame:
    """keys and body: a line for each row, joined."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), sep).alias("body"))


def numbered(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")


@query(f"""WITH n AS (SELECT n_nationkey AS i, replace(n_name, ' ', '_') AS n FROM nation WHERE n_nationkey % 5 <> 4)
    SELECT 'regional_crawl' AS source, '{_HOST}/upload/' || n || '_GPL.zip' AS url FROM n WHERE i % 2 = 0 UNION ALL SELECT 'regional_crawl', '{_HOST}/frag/' || n || '.zip' FROM n WHERE i % 2 = 0
    UNION ALL SELECT 'regional_crawl', '{_HOST}/fb/' || n || '.zip' FROM n WHERE i % 2 = 1""")
def source_regional(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("n")).join(F.broadcast(numbered(spark, "region", C.REGIONS)), "i")
    tree = F.concat(F.lit(f'<script>var productTree = {{"1":[{{"href":" {_HOST}/upload/'), "n", F.lit('_GPL.zip "},{"href":"?model='), "n", F.lit('","app_folder":"f'), F.col("i").cast("string"), F.lit('"},{"href":"/no"}]}; </script>'))
    plain = F.concat(F.lit(f'var productTree = []; <a href="{_HOST}/fb/'), "n", F.lit(f'.zip"> <a href="{_HOST}/x.html">'))
    pages = n.select(scrape.Regional.page(F.col("region")).alias("request_url"), F.when(F.col("i") % 5 == 4, 404).otherwise(200).alias("status"), F.when(F.col("i") % 2 == 0, tree).otherwise(plain).alias("body"))
    asked = scrape.request(C.MODEL_PAGE, model=F.col("n"), appPath=F.concat(F.lit("f"), F.col("i").cast("string")))
    fragments = n.select(asked.alias("request_url"), F.when(F.col("i") % 4 == 0, 500).otherwise(200).alias("status"), F.concat(F.lit(f'<table><a href=" {_HOST}/frag/'), "n", F.lit('.zip">')).alias("body"))
    return scrape.Regional().run(spark, answers(spark, pages, fragments))


@query("""SELECT lower(substr(n_name, 1, 2)) AS region FROM (SELECT min(n_nationkey) AS k FROM nation GROUP BY lower(substr(n_name, 1, 2))) JOIN nation ON n_nationkey = k WHERE k % 2 = 0
    UNION SELECT lower(substr(r_name, 1, 3)) FROM region UNION SELECT unnest(['""" + "','".join(C.REGIONS) + "'])")
def discovered_regions(spark, sf_dir):
    codes = read(spark, sf_dir, "nation").groupBy(F.lower(F.substring("n_name", 1, 2)).alias("region")).agg(F.min("n_nationkey").alias("k"))
    pages = codes.select(scrape.Regional.page(F.col("region")).alias("request_url"), F.lit(200).alias("status"), F.when(F.col("k") % 2 == 0, 'var productTree = {"1":[]};').otherwise("<html>").alias("body"))
    links = F.concat(F.lit('<a href="https://h/'), F.lower(F.substring("r_name", 1, 3)), F.lit('/">'))
    picker = lists(read(spark, sf_dir, "region"), links).select(F.lit(C.PICKER_URL).alias("request_url"), F.lit(200).alias("status"), "body")
    return scrape.Regional().found_regions(spark, answers(spark, pages, picker))


@query("SELECT 'wayback_cdx' AS source, 'http://h/' || p_partkey AS url FROM part WHERE p_partkey // 4 % 3 = 0 OR p_partkey % 4 IN (0, 1)")
def source_wayback(spark, sf_dir):
    """Three pages for each of four prefixes; the third prefix' second page is empty, the fourth's fails."""
    rows = read(spark, sf_dir, "part").select((F.col("p_partkey") % 4).cast("int").alias("i"), (F.floor(F.col("p_partkey") / 4) % 3).alias("page"), F.format_string('["http://h/%d"]', "p_partkey").alias("line"))
    pages = lists(rows, F.col("line"), "i", "page").join(F.broadcast(numbered(spark, "prefix", C.CDX_PREFIXES)), "i")
    key = lambda page: F.concat(F.lit("k "), F.col("i").cast("string"), F.lit("/"), page.cast("string"))
    url = F.when(F.col("page") == 0, scrape.Wayback.url()).otherwise(scrape.Wayback.url(key(F.col("page"))))
    more = F.when(F.col("page") < 2, F.concat(F.lit('\n[]\n["'), key(F.col("page") + 1), F.lit('"]'))).otherwise("")
    body = F.when((F.col("i") == 2) & (F.col("page") == 1), " \n").otherwise(F.concat(F.lit('["original"]\nbad\n'), "body", more))
    status = F.when((F.col("i") == 3) & (F.col("page") == 1), 503).otherwise(200)
    return scrape.Wayback().run(spark, answers(spark, pages.select(url.alias("request_url"), status.alias("status"), body.alias("body"))))


@query("SELECT 'common_crawl' AS source, 'https://h/cc/' || r_regionkey || '-' || j || '-' || p AS url FROM region, range(2) x(j), range(4) y(p) WHERE p < r_regionkey AND r_regionkey NOT IN (1, 3) AND NOT (r_regionkey = 4 AND p = 2)")
def source_common_crawl(spark, sf_dir):
    """As many pages as the region's number; one index has no endpoint, one no captures, one page fails."""
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.format_string("https://index/%d", "r_regionkey").alias("index"))
    entry = F.when(F.col("r") == 1, '{"id":"x"}').otherwise(F.concat(F.lit('{"id":"x","cdx-api":"'), "index", F.lit('"}')))
    listing = lists(r, entry, sep=",").select(F.lit(C.CRAWL_LISTING).alias("request_url"), F.lit(200).alias("status"), F.concat(F.lit("["), "body", F.lit("]")).alias("body"))
    each = r.crossJoin(F.broadcast(numbered(spark, "prefix", C.CRAWL_PREFIXES)))
    sizes = each.select(scrape.request(F.col("index"), url=F.col("prefix"), showNumPages="true").alias("request_url"), F.when(F.col("r") == 3, 404).otherwise(200).alias("status"), F.format_string('{"pages": %d, "pageSize": 5}', "r").alias("body"))
    pages = each.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(3))))
    url = scrape.request(F.col("index"), url=F.col("prefix"), output="json", page=F.col("page").cast("string"))
    pages = pages.select(url.alias("request_url"), F.when((F.col("r") == 4) & (F.col("page") == 2), 500).otherwise(200).alias("status"), F.format_string('{"url": "https://h/cc/%d-%d-%d"}\nbad\n{"no": 1}', "r", "i", "page").alias("body"))
    return scrape.CommonCrawl().run(spark, answers(spark, listing, sizes, pages))


def _code_pages(rows: DataFrame) -> DataFrame:
    """rows: endpoint, query, page, fragment (null: no item)."""
    item = F.when(F.col("fragment").isNotNull(), F.to_json(F.struct(F.array(F.struct("fragment")).alias("text_matches"))))
    url = scrape.request(F.concat(F.lit(C.CODE_HOST), F.col("endpoint")), q=F.col("query"), per_page="100", page=F.col("page").cast("string"))
    pages = lists(rows, item, "endpoint", "query", "page", sep=",")
    return pages.select(url.alias("request_url"), F.lit(200).alias("status"), F.concat(F.lit('{"total_count": 9, "items": ['), "body", F.lit("]}")).alias("body"))


@query(f"SELECT 'github_search' AS source, '{_HOST}/c' || c_custkey || '.zip' AS url FROM customer WHERE c_custkey % 6 NOT IN (4, 5)")
def source_code_search(spark, sf_dir):
    """Three pages for each query and endpoint; the last query finds nothing."""
    asked = spark.createDataFrame([(2 * a + b, q, e) for a, q in enumerate(C.CODE_QUERIES) for b, e in enumerate(C.CODE_ENDPOINTS)], "i int, query string, endpoint string")
    rows = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 6).cast("int").alias("i"), (F.floor(F.col("c_custkey") / 6) % 3 + 1).cast("int").alias("page"), F.when(F.col("c_custkey") % 6 < 4, F.format_string(f"see ({_HOST}/c%d.zip).", "c_custkey")).alias("fragment"))
    return scrape.CodeSearch("token").run(spark, answers(spark, _code_pages(rows.join(F.broadcast(asked), "i"))))


@query(f"SELECT 'tplink_github' AS source, '{_HOST}/o' || r_regionkey || '.zip' AS url FROM region UNION ALL SELECT 'tplink_github', '{_HOST}/w' || r_regionkey || '.zip.' FROM region WHERE r_regionkey % 2 = 0")
def source_organisation(spark, sf_dir):
    """The organisation's list of repositories fails, so the user's counts; odd repositories have no wiki."""
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("i"), F.format_string("https://github.com/o/r%d", "r_regionkey").alias("repository"))
    found = _code_pages(r.select(F.lit(C.CODE_ENDPOINTS[0]).alias("endpoint"), F.lit(C.ORGANISATION_QUERY).alias("query"), F.lit(1).alias("page"), F.format_string(f"{_HOST}/o%d.zip,", "i").alias("fragment")))
    entry = F.to_json(F.struct(F.col("repository").alias("html_url"), (F.col("i") % 2 == 0).alias("has_wiki")))
    url = lambda kind: scrape.request(f"{C.CODE_HOST}/{kind}/{C.ORGANISATION}/repos", per_page="100").alias("request_url")
    users = lists(r, entry, sep=",").select(url("users"), F.lit(200).alias("status"), F.concat(F.lit("["), "body", F.lit("]")).alias("body"))
    orgs = spark.range(1).select(url("orgs"), F.lit(404).alias("status"), F.lit("{}").alias("body"))
    wikis = r.select("repository", F.format_string(f"x {_HOST}/w%d.zip. y", "i").alias("body"))
    return scrape.Organisation("token", wikis).run(spark, answers(spark, found, users, orgs))


@query("SELECT DISTINCT 'mercusys_regional' AS source, 'https://static.mercusys.com/gpl/M' || p_partkey % 50 || '.zip' AS url FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 50 % 7 <> 0")
def source_sister(spark, sf_dir):
    """Four index pages, one of which fails; a page for each model, of which each seventh fails."""
    part = read(spark, sf_dir, "part")
    rows = part.select((F.col("p_partkey") % 4).cast("int").alias("i"), F.format_string('<a class="x" href="?model=M%d">', F.col("p_partkey") % 50).alias("link"))
    index = lists(rows, F.col("link"), "i").join(F.broadcast(numbered(spark, "region", C.SISTER_SAMPLE)), "i")
    index = index.select(F.concat(F.lit(f"{C.SISTER_SITE}/"), "region", F.lit("/support/gpl-code/")).alias("request_url"), F.when(F.col("i") == 3, 404).otherwise(200).alias("status"), "body")
    k = (F.col("p_partkey") % 50).alias("k")
    models = part.select(k).distinct().select(F.format_string(f"{C.SISTER_SITE}/en/support/gpl-code/?model=M%d", "k").alias("request_url"), F.when(F.col("k") % 7 == 0, 500).otherwise(200).alias("status"), F.format_string("at https://static.mercusys.com/gpl/M%d.zip, or https://static.mercusys.com/x", "k").alias("body"))
    return scrape.Sister().run(spark, answers(spark, index, models))


@query(f"SELECT 'reddit' AS source, '{_HOST}/r' || c_custkey || '.zip' AS url FROM customer WHERE c_custkey // 5 % 4 = 0 OR c_custkey % 5 = 1 AND c_custkey // 5 % 4 = 1 OR c_custkey % 5 NOT IN (1, 2)")
def source_listings(spark, sf_dir):
    """Four pages for each endpoint; one endpoint repeats its cursor, one has an empty second page."""
    rest = {"limit": "100", "sort": "relevance", "t": "all"}
    endpoints = numbered(spark, "endpoint", [f"{C.LISTING_HOST}/search.json", *(f"{C.LISTING_HOST}/r/{s}/search.json" for s in C.SUBREDDITS)])
    text = F.format_string(f"see {_HOST}/r%d.zip.", "c_custkey")
    at = F.col("c_custkey") % 3
    entry = F.to_json(F.struct(F.struct(F.when(at == 0, text).alias("selftext"), F.when(at == 1, text).alias("url"), F.when(at == 2, text).alias("title")).alias("data")))
    rows = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).cast("int").alias("i"), (F.floor(F.col("c_custkey") / 5) % 4).alias("page"), entry.alias("entry"))
    pages = lists(rows, F.col("entry"), "i", "page", sep=",").join(F.broadcast(endpoints), "i")
    after = F.when(F.col("page") == 3, "null").when((F.col("i") == 1) & (F.col("page") == 1), '"t1"').otherwise(F.format_string('"t%d"', F.col("page") + 1))
    body = F.concat(F.lit('{"data": {"children": ['), F.when((F.col("i") == 2) & (F.col("page") == 1), "").otherwise(F.col("body")), F.lit('], "after": '), after, F.lit("}}"))

    def url(**more):
        whole = scrape.request(F.col("endpoint"), q=C.LISTING_QUERIES[0], **rest, **more)
        return F.when(F.col("i") == 0, whole).otherwise(scrape.request(F.col("endpoint"), q=C.LISTING_QUERIES[1], restrict_sr="1", **rest, **more))

    asked = F.when(F.col("page") == 0, url()).otherwise(url(after=F.format_string("t%d", "page")))
    return scrape.Listings().run(spark, answers(spark, pages.select(asked.alias("request_url"), F.lit(200).alias("status"), body.alias("body"))))


@query(f"SELECT 'forums' AS source, '{_HOST}/f' || c_custkey || '.zip' AS url FROM customer WHERE c_custkey % 6 < 4 UNION ALL SELECT 'forums', '{_HOST}/d' || j || '.zip' FROM range(2) x(j)")
def source_forums(spark, sf_dir):
    """Six pages with more posts, of which four are asked for; three searches, one of them blocked."""
    post = F.to_json(F.struct(F.format_string(f"{_HOST}/f%d.zip!", "c_custkey").alias("blurb")))
    rows = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 6 + 1).cast("string").alias("page"), post.alias("post"))
    pages = lists(rows, F.col("post"), "page", sep=",").select(scrape.request(C.DISCOURSE_SEARCH, q=C.LISTING_QUERIES[0], page=F.col("page")).alias("request_url"), F.lit(200).alias("status"), F.concat(F.lit('{"posts": ['), "body", F.lit('], "grouped_search_result": {"more_posts": true}}')).alias("body"))
    url = scrape.request(C.WEB_SEARCH, q=F.concat(F.lit("site:"), F.col("site"), F.lit(f" {C.LISTING_QUERIES[0]}")), num="10")
    dorks = numbered(spark, "site", C.DORK_DOMAINS).select(url.alias("request_url"), F.when(F.col("i") == 2, 429).otherwise(200).alias("status"), F.format_string(f'<p><a href="{_HOST}/d%d.zip">', "i").alias("body"))
    return scrape.Forums().run(spark, answers(spark, pages, dorks))


_SWEEP_MODELS = "(SELECT CASE p_partkey % 40 WHEN 0 THEN 'S' ELSE 'L' END || p_partkey AS m FROM part WHERE p_partkey % 40 < 2 AND p_partkey % 3 <> 0)"


@query(f"SELECT 'model_sweep' AS source, '{_HOST}/' || r || '/' || m || '_GPL.zip' AS url FROM {_SWEEP_MODELS}, (SELECT unnest(['us', 'pl', 'zz']) AS r)")
def source_sweep(spark, sf_dir):
    """Half of the models come from the links of one region's page alone. A region beside the known ones is discovered; a third
    of the models has no page where probes look, and is not asked for elsewhere."""
    k = F.col("p_partkey")
    models = read(spark, sf_dir, "part").where(k % 40 < 2).select(k.alias("k"), F.concat(F.when(k % 40 == 0, "S").otherwise("L"), k.cast("string")).alias("m"))
    pages = models.withColumn("r", F.explode(F.array(*map(F.lit, ("us", "pl", "zz"))))).where("k % 3 <> 0 OR r <> 'us'")
    url = scrape.request(C.MODEL_PAGE, model=F.col("m"), appPath=F.col("r"))
    pages = pages.select(url.alias("request_url"), F.lit(200).alias("status"), F.concat(F.lit(f'<a href="{_HOST}/'), "r", F.lit("/"), "m", F.lit('_GPL.zip">')).alias("body"))
    links = lists(models.where("k % 40 = 1"), F.concat(F.lit('<a href="?model='), "m", F.lit('">'))).select(scrape.Regional.page(F.lit("de")).alias("request_url"), F.lit(200).alias("status"), "body")
    tree = spark.range(1).select(scrape.Regional.page(F.lit("zz")).alias("request_url"), F.lit(200).alias("status"), F.lit('var productTree = {"1":[]};').alias("body"))
    return scrape.ModelSweep(models.where("k % 40 = 0").select(F.col("m").alias("model"))).run(spark, answers(spark, pages, links, tree))


@query(f"SELECT 'google' AS source, '{_HOST}/g' || s_suppkey || '.zip' AS url FROM supplier WHERE s_suppkey % 8 <> 3")
def source_web_search(spark, sf_dir):
    """Result pages for eight suffixes: links within results, one page with text alone, one that asks for consent."""
    rows = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).cast("int").alias("i"), F.format_string(f"{_HOST}/g%d.zip", "s_suppkey").alias("u"))
    part = F.when(F.col("i") == 5, F.concat("u", F.lit(". "))).otherwise(F.concat(F.lit('<div class="a yuRUbf"><div><a class=x href="'), "u", F.lit(f'">t</a></div></div><a href="{_HOST}/other">')))
    pages = lists(rows.select("i", part.alias("part")), F.col("part"), "i", sep=" ").join(F.broadcast(numbered(spark, "suffix", C.CANDIDATE_EXTENSIONS)), "i")
    url = scrape.request(C.WEB_SEARCH, q=F.concat(F.lit(f"site:{C.ARCHIVE_HOST} "), F.col("suffix")), num="10")
    return scrape.WebSearch().run(spark, answers(spark, pages.select(url.alias("request_url"), F.lit(200).alias("status"), "body", F.when(F.col("i") == 3, "https://consent.google.com/x").otherwise("").alias("final_url"))))

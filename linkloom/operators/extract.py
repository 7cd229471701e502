"""Captured responses to URL rows, in expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions.tokens import keep_token
from linkloom.functions.urls import has_fallback_suffix, strip

TREE = "map<string,array<struct<href:string,app_folder:string,model_name:string>>>"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def text_urls(text: Column, pattern: str = C.ARCHIVE_URL, trailing: str = C.TRAILING) -> Column:
    """URLs in free text; punctuation that ends a sentence goes."""
    return F.transform(find_all(text, pattern), lambda u: F.rtrim(u, F.lit(trailing)))


def product_tree(html: Column) -> Column:
    """The object assigned to productTree; null for a list, none, or one that does not end."""
    return F.from_json(F.nullif(F.regexp_extract(html, r"(?s)var productTree\s*=\s*(\{.*)", 1), F.lit("")), TREE)


def tree_items(pages: DataFrame, tree: str = "tree") -> DataFrame:
    """One row for each item of the trees: kind (direct, pair), and url or model and app_folder."""
    items = pages.select("*", F.explode(F.flatten(F.map_values(tree))).alias("item")).withColumn("href", strip(F.coalesce("item.href", F.lit(""))))
    direct, pair = F.col("href").startswith(f"https://{C.ARCHIVE_HOST}/"), F.col("href").startswith("?model=")
    return items.where(direct | pair).select(
        *(c for c in pages.columns if c != tree),
        F.when(direct, "direct").otherwise("pair").alias("kind"), F.when(direct, F.col("href")).alias("url"),
        F.when(pair, F.expr("substring(href, 8)")).alias("model"), F.when(pair, F.coalesce("item.app_folder", F.lit(""))).alias("app_folder"),
    )


def href_urls(body: Column) -> Column:
    """Archive links of a fragment; spaces inside stay, repeats stay."""
    return F.transform(find_all(body, C.HREF, 1), strip)


def fallback_urls(html: Column) -> Column:
    return F.filter(F.transform(find_all(html, C.HREF_FALLBACK, 1), strip), has_fallback_suffix)


def region_page_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """A page's tree items if it has a tree, else its archive links; never both."""
    parsed = pages.withColumn("tree", product_tree(F.col(body)))
    keep = [c for c in pages.columns if c != body]
    tree = tree_items(parsed.where("tree IS NOT NULL").select(*keep, "tree"))
    plain = parsed.where("tree IS NULL").select(*keep, F.lit("fallback").alias("kind"), F.explode(fallback_urls(F.col(body))).alias("url"))
    return tree.unionByName(plain, allowMissingColumns=True)


def lines_of(body: Column) -> Column:
    return F.split(body, r"\r\n|[\n\r]")


def ndjson_urls(body: Column) -> Column:
    """The url of each line's object; malformed and blank lines are skipped."""
    return F.filter(F.transform(lines_of(body), lambda x: F.get_json_object(x, "$.url")), lambda u: u.isNotNull() & (u != ""))


def crawl_indices(body: Column) -> Column:
    """Endpoints of an index listing, which must be a list."""
    found = F.from_json(F.when(F.ltrim(body).startswith("["), body), "array<struct<id:string,`cdx-api`:string>>")
    return F.filter(F.transform(found, lambda x: x["cdx-api"]), lambda x: x.isNotNull())


def cdx_rows(body: Column) -> Column:
    """A page's urls and resume key. The first line is a header whatever it holds; an empty list parts urls from the key."""
    strings = F.transform(F.slice(lines_of(body), 2, 1 << 30), lambda x: F.from_json(F.when(F.trim(x).startswith("["), x), "array<string>"))
    good = F.filter(strings, lambda a: a.isNotNull())
    cut = F.array_position(F.transform(good, F.size), 0)
    urls = F.transform(F.when(cut > 0, F.slice(good, F.lit(1), (cut - 1).cast("int"))).otherwise(good), lambda a: F.get(a, F.lit(0)))
    after = F.filter(F.when(cut > 0, F.slice(good, (cut + 1).cast("int"), F.lit(1 << 30))).otherwise(F.array().cast("array<array<string>>")), lambda a: F.size(a) > 0)
    return F.struct(F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != ""))).alias("urls"), F.get(F.get(after, F.lit(0)), F.lit(0)).alias("resume_key"))


def code_search_urls(body: Column) -> Column:
    found = F.from_json(body, "struct<total_count:bigint,items:array<struct<text_matches:array<struct<fragment:string>>>>>")
    fragments = F.flatten(F.transform(found["items"], lambda i: F.coalesce(i["text_matches"], F.array().cast("array<struct<fragment:string>>"))))
    return F.flatten(F.transform(fragments, lambda m: text_urls(m["fragment"])))


def discourse_urls(body: Column) -> Column:
    found = F.from_json(body, "struct<posts:array<struct<blurb:string>>>")
    return F.flatten(F.transform(found["posts"], lambda p: text_urls(p["blurb"])))


def discourse_more(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.grouped_search_result.more_posts").cast("boolean"), F.lit(False))


def listing_urls(body: Column) -> Column:
    """Of a forum listing: text, link and title of each entry."""
    found = F.from_json(body, "struct<data:struct<children:array<struct<data:struct<selftext:string,url:string,title:string>>>,after:string>>")
    fields = F.flatten(F.transform(found["data"]["children"], lambda c: F.array(c["data"]["selftext"], c["data"]["url"], c["data"]["title"])))
    return F.flatten(F.transform(fields, lambda t: text_urls(t)))


def listing_cursor(body: Column) -> Column:
    return F.get_json_object(body, "$.data.after")


def wiki_repositories(body: Column) -> Column:
    """Links of repositories with a wiki; only such of one host."""
    found = F.from_json(body, "array<struct<html_url:string,has_wiki:boolean>>")
    return F.transform(F.filter(found, lambda r: r["has_wiki"] & r["html_url"].startswith("https://github.com/")), lambda r: r["html_url"])


def picker_regions(html: Column) -> Column:
    return F.array_distinct(find_all(html, C.PICKER_REGION, 1))


def linked_models(html: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(find_all(html, C.MODEL_LINK, 1), strip), keep_token))


def wiki_urls(text: Column) -> Column:
    """As grep finds them: nothing is cut off the end."""
    return find_all(text, C.ARCHIVE_URL)


# Patterns of markup. A tag's attributes may hold `>` in quotes; comments, scripts and styles hold no tags.
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_MARKUP = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1|\z)|</div(?=[\s/>])[^>]*+>|<(?:a|div)(?=[\s/>]){_ATTRIBUTES}>"
_ATTRIBUTE = r"""(?s)[\s/]+[^\s=/>"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+))?"""
_VALUE = r"""(?s)=\s*(?:"([^"]*)"|'([^']*)'|(.*))$"""
_NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}
RESULT_CLASS = "yuRUbf"


def unescaped(text: Column) -> Column:
    """References to characters by number, and the common ones by name; `&amp;` last, so that nothing is unescaped twice."""
    refs = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
    parts, found = F.split(text, refs), F.regexp_extract_all(text, F.lit(refs), F.lit(0))

    def letter(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")

    def named(plain: Column) -> Column:
        for name, c in _NAMED.items():
            plain = F.replace(plain, F.lit(name), F.lit(c))
        return plain

    letters = F.concat(F.transform(found, letter), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.transform(parts, named), letters, lambda p, c: F.concat(p, c)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used: columns within lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The first attribute of the name, unescaped; null if there is none, empty if it has no value."""
    every = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    first = F.get(F.filter(every, lambda a: a.rlike(rf"(?is)^[\s/]+{name}(?:\s*=|$)")), F.lit(0))
    value = _named(first, lambda a: F.concat(*(F.regexp_extract(a, _VALUE, n) for n in (1, 2, 3))))
    return _named(value, unescaped)


def _tags(html: Column) -> Column:
    """The <a> tags, and the <div> tags at both ends, in the order of the page."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_MARKUP), F.lit(0))
    return F.filter(tags, lambda t: t.rlike(r"(?i)^</?(?:a|div)"))


#: Tags that one fold gathers links of. A list that grows by one is copied whole, so a fold over a page would cost the square of its
#: links; folds over blocks, whose lists are then gathered by a fold over these, cost this number for each.
FOLD = 256


def links(html: Column) -> Column:
    """href of each <a> that has one, in the order of the page, and whether it is within a result: array of href, inside.

    A fold over tags, in place of a tree: how many divs are open, and since which of them one is a result's."""
    seen = F.transform(_tags(html), lambda t: F.struct(
        F.when(t.startswith("</"), -1).when(t.rlike(r"(?i)^<div"), 1).otherwise(0).alias("step"),
        F.when(t.rlike(r"(?i)^<a"), attribute(t, "href")).alias("href"),
        F.coalesce(F.array_contains(F.split(F.when(t.rlike(r"(?i)^<div"), attribute(t, "class")), r"\s+"), RESULT_CLASS), F.lit(False)).alias("result"),
    ))
    blocks = _named(seen, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(FOLD)), lambda at: F.slice(s, at + 1, F.lit(FOLD))))
    none, empty = F.lit(0), F.array().cast("array<struct<href:string,inside:boolean>>")

    def state(now: Column, since: Column, found: Column) -> Column:
        return F.struct(now.alias("open"), since.alias("since"), found.alias("found"))

    def step(acc: Column, t: Column) -> Column:
        now = F.greatest(acc["open"] + t["step"], none)
        since = F.when((acc["since"] == 0) & t["result"], now).when(now < acc["since"], none).otherwise(acc["since"])
        link = F.when(t["href"].isNotNull(), F.array_append(acc["found"], F.struct(t["href"].alias("href"), (acc["since"] > 0).alias("inside")))).otherwise(acc["found"])
        return state(now, since, link)

    def block(acc: Column, tags: Column) -> Column:
        return F.aggregate(tags, state(acc["open"], acc["since"], empty), step, lambda own: state(own["open"], own["since"], F.array_append(acc["found"], own["found"])))

    start = state(none, none, F.array().cast("array<array<struct<href:string,inside:boolean>>>"))
    return F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["found"]))


def hrefs(html: Column) -> Column:
    """href of each <a> that has one, in the order of the page, wherever it is: no fold is needed."""
    return F.filter(F.transform(F.filter(_tags(html), lambda t: t.rlike(r"(?i)^<a")), lambda t: attribute(t, "href")), lambda h: h.isNotNull())


def index_models(html: Column) -> Column:
    """Models that an index page links to, in its order, repeats kept."""
    models = F.filter(hrefs(html), lambda h: h.startswith("?model=") & (F.length(h) > 7))
    return F.transform(models, lambda h: F.substring(h, F.lit(8), F.length(h)))


def result_links(html: Column) -> Column:
    """Hrefs within search results that name either host."""
    return F.transform(F.filter(links(html), lambda x: x["inside"] & _of_hosts(x["href"])), lambda x: x["href"])


def any_links(html: Column) -> Column:
    return F.filter(hrefs(html), _of_hosts)


def _of_hosts(href: Column) -> Column:
    return F.contains(href, F.lit(C.ARCHIVE_HOST)) | F.contains(href, F.lit(C.SISTER_HOST))


def search_page_urls(pages: DataFrame, within_results: bool = True) -> DataFrame:
    """pages: status, final_url, body and others. Links of result pages, or else URLs in their text; blocked pages give none."""
    blocked = (F.col("status") == 429) | F.coalesce(F.col("final_url"), F.lit("")).contains("consent.google.com") | F.lower("body").contains("unusual traffic")
    links = (result_links if within_results else any_links)(F.col("body"))
    found = pages.where((F.col("status") == 200) & ~blocked).withColumn("links", links)
    urls = F.when(F.size("links") > 0, F.col("links")).otherwise(text_urls(F.col("body")))
    return found.select(*(c for c in pages.columns if c != "body"), F.explode(urls).alias("url"))


def explode_urls(responses: DataFrame, urls: Column, *keep: str) -> DataFrame:
    return responses.select(*keep, F.explode(urls).alias("url")).where("url <> ''")

from urllib.parse import quote, unquote, urlsplit

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions import tokens, urls


def one(spark, f, *pairs, schema="i string"):
    frame = spark.createDataFrame([(i,) for i, _ in pairs], schema)
    got = [r["o"] for r in frame.select(f(F.col("i")).alias("o")).collect()]
    assert got == [o for _, o in pairs]


def test_canonical(spark):
    one(
        spark, urls.canonical,
        ("https://static.tp-link.com/a b.zip", "https://static.tp-link.com/a%20b.zip"), ("https://static.tp-link.com/a%20b.zip", "https://static.tp-link.com/a%20b.zip"),
        ("HTTP://Static.TP-Link.com/A(US)_GPL.zip", "https://static.tp-link.com/A(US)_GPL.zip"), ("  https://h/x?q=1#f \n", "https://h/x"), ("", ""), ("   ", ""),
        ("https://h/%2520", "https://h/%2520"), ("/search?q=1", "/search"), ("//host/p", "//host/p"), ("ftp://h/a;b", "ftp://h/a%3Bb"), ("https://h/%zz+&", "https://h/%25zz%2B%26"),
    )


def plain(url):
    url = url.strip()
    if not url:
        return ""
    p = urlsplit(url)
    scheme = "https" if p.scheme == "http" else p.scheme
    return (f"{scheme}:" if scheme else "") + (f"//{p.netloc.lower()}" if p.netloc else "") + quote(unquote(p.path), safe="/:@!'()*-._~")


bits = st.lists(st.sampled_from(["http://", "https://", "H", "h.com", "/", "a", "%20", "%2", "%", "+", "&", "é", "😀", "(", "'", "~", "=", ";", ",", "?", "#", " ", "b%C3%A9", "%FF", "*", ":8"]), max_size=9).map("".join)


@given(st.lists(bits, min_size=60, max_size=60))
@settings(max_examples=6, deadline=None)
def test_canonical_is_what_urllib_does(spark, many):
    pairs = [(u, plain(u)) for u in many if not (u.strip() and urlsplit(u.strip()).netloc != urlsplit(u.strip()).netloc.strip())]
    one(spark, urls.canonical, *pairs)
    one(spark, urls.percent_decode, *((u, unquote(u)) for u in many))


def test_keys_and_manifest(spark):
    one(spark, urls.object_url, ("https://h/a%20b%26c%2Bd.zip", "s3://h/a b&c+d.zip"))
    one(spark, urls.manifest_line, ("https://h/a%20b.zip", "cp --if-size-differ 's3://h/a b.zip' 'gpl/h/a b.zip'"))
    one(spark, lambda u: urls.manifest_line(u, True), ("https://h/a'b", "cp --if-size-differ 's3://h/a'\\''b' 'gpl/h/a'\\''b'"))
    one(spark, urls.origin_url, ("https://h/a%20b", "https://s3.amazonaws.com/h/a%20b"))
    one(spark, lambda u: urls.regional_url(u, F.lit("eu-1")), ("https://h/a", "https://s3.eu-1.amazonaws.com/h/a"))


def test_gate(spark):
    one(spark, urls.is_archive, ("https://h/x_GPL.tar.gz", True), ("https://h/gpl/x.7Z", True), ("https://h/x_gpl.bz", True), ("https://h/x.tar.gz", False), ("https://h/gpl.html", False), ("https://h/gpl.zipx", False))


def test_variants(spark):
    one(spark, lambda n: urls.insert_variant(n, F.lit("_2")), ("ax50v1_GPL.tar.gz", "ax50v1_GPL_2.tar.gz"), ("x.7z", "x.7z_2"), ("x.GZ", "x.GZ_2"), ("a.b.zip", "a.b_2.zip"))


def test_retry_seconds(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    one(spark, lambda v: urls.retry_seconds(v, now), ("7", 7.0), ("Mon, 01 Jan 2024 00:01:00 GMT", 60.0), ("soon", None))


def test_model_tokens(spark):
    one(
        spark, tokens.model_token,
        ("TapoC200v3_en_1.1.bin", "Tapo C200"), ("Archer_C7(US)_V5_210125.zip", "Archer C7"), ("(B)TL-WR841N_V14_2020.bin", "TL-WR841N"),
        ("AX50_1.0.zip", "AX50"), ("US_EU.bin", ""), ("X60 [rel1] EU", "X60"),
    )
    one(spark, tokens.token_variants, ("AX21", ["AX21", "Archer AX21"]), ("X60", ["X60", "Deco X60"]), ("BE65", ["BE65", "Archer BE65", "Deco BE65"]), ("Archer C7", ["Archer C7"]))
    one(spark, tokens.keep_token, ("A", False), ("9X", False), ("AX", True), ("--", False), ("a" * 41, False))
    one(spark, tokens.archive_tokens, ("https://h/AX21_X60_GPL_code.tar.gz", ["AX21", "Archer AX21", "X60", "Deco X60"]))


def test_firmware_models(spark):
    one(
        spark, tokens.firmware_models,
        ("firmware/TL-WR841Nv14_US_0.9.1_4.16.bin", ["TL-WR841Nv14", "TL-WR841N"]), ("firmware/1.0.0 Build 20.bin", []), ("manual/X.bin", []),
        ("firmware/(EAP)EAP225-UP-ver5_1600000000000.bin", ["EAP225"]), ("firmware/3phase.bin", []),
    )


def test_patterns(spark):
    one(
        spark, tokens.name_pattern,
        ("GPL_AX50.tar.gz", "GPL_{model}"), ("MR500V1_gpl_src.zip", "{model}_gpl_src"), ("A20v1_US_GPL_20190213.rar", "{model}_GPL"), ("X-GPL.zip", "{model}-GPL"),
        ("plain.tgz", "{model}"), ("Y_OpenSource.zip", "{model}_OpenSource"), ("ZGpl_V2.gz", "{model}Gpl"),
    )
    empty = spark.createDataFrame([], "basename string")
    assert {r[0] for r in tokens.corpus_patterns(empty).collect()} == set(C.CANONICAL_PATTERNS)


def test_known_basenames_keep_the_other_columns(spark):
    lines = spark.createDataFrame([(1, "https://h/a/x%20y.zip"), (2, "b+c%zz"), (2, "b+c%zz")], "page_id int, value string")
    assert sorted(map(tuple, tokens.known_basenames(lines).collect())) == [(1, "x y.zip"), (2, "b+c%zz"), (2, "b+c%zz")]


def test_fixed_lists():
    assert (len(C.REGIONS), len(C.SISTER_REGIONS), len(C.GATE_EXTENSIONS), len(C.FALLBACK_EXTENSIONS), len(C.CANDIDATE_EXTENSIONS)) == (38, 46, 13, 11, 8)

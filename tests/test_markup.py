"""Links of pages by a fold over tags, against a parser that builds the page up."""

import time
from html.parser import HTMLParser

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.operators import extract


class Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.divs = [], []

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag == "div":
            self.divs.append("yuRUbf" in named.get("class", "").split())
        elif tag == "a" and "href" in named:
            self.found.append((named["href"], any(self.divs)))

    def handle_endtag(self, tag):
        if tag == "div" and self.divs:
            self.divs.pop()


def parsed(html):
    p = Parser()
    p.feed(html or "")
    p.close()
    return p.found


PAGES = [
    None, "", "<a href=x>", '<A HREF = "a&amp;b" href=c>t</A>', "<div class='g yuRUbf'><div><a class=x href='?model=A&amp;B'>t</a></div><a href=2></div><a href=3>", "</div></div><a href=1>",
    '<div class="yuRUbf"><div class="yuRUbf"></div><a href=in></div><a href=out>', "<abbr href=no><a-b href=no><a\nhref=yes\n>", "<!-- <a href=no> --><a href=yes><!-- <a href=no>", "<script>'<a href=no>'</script><a href=yes><style a='>'><a href=no></style>",
    "<a title='>' href=\"x>y\">", "<a href>", "<a data-href=no href=yes>", "<a hrefx=1 href='&#65;&#x1F600;&#x41;&quot;&lt;&gt;&apos;&amp;amp;&nbsp;&amp;#65;'>", "<a/href=1/>", "<div/><a href=1>", "<divx class=yuRUbf><a href=1>", '<div class="\tyuRUbf\n b"><a href=1>',
    "<div class=yuRUbfx><a href=1>", "a < b <a href=1> & <a href=2", '<a href="&#0;&#xD800;&#1114112;">', "<a " + "x='" + "y" * 50_000 + "' href=long>",
]


def by_fold(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", extract.links(F.col("html")).alias("l")).collect()
    return [[tuple(x) for x in r["l"]] for r in sorted(rows)]


def test_links_of_pages(spark):
    assert by_fold(spark, PAGES) == [parsed(p) for p in PAGES]


piece = st.sampled_from(["<div>", "<div class='yuRUbf'>", '<DIV id=a class="b yuRUbf">', "</div>", "</DIV >", "<a href='u&amp;v'>", "<a href=w>", "</a>", "<p>", "text & <b>", "<!-- </div> -->", "<script>'</div><a href=n>'</script>", "<a name=q>"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(piece, max_size=25).map("".join), min_size=30, max_size=60))
def test_links_of_any_pages(spark, pages):
    assert by_fold(spark, pages) == [parsed(p) for p in pages]


def test_no_python_runs(spark):
    host = f"https://{C.ARCHIVE_HOST}"
    rows = [(200, "", f'<div class="yuRUbf"><a href="{host}/a.zip">x</a></div><a href="{host}/b.zip">')]
    pages = spark.createDataFrame(rows, "status int, final_url string, body string")
    both = [extract.search_page_urls(pages, within) for within in (True, False)]
    assert [[r["url"] for r in f.collect()] for f in both] == [[f"{host}/a.zip"], [f"{host}/a.zip", f"{host}/b.zip"]]
    models = pages.select(F.explode(extract.index_models(F.col("body"))))
    assert all("Python" not in f._jdf.queryExecution().executedPlan().toString() for f in (*both, models))


def test_pages_with_very_many_links(spark):
    """Work grows with the links: a page of eight times as many takes little more than eight times as long."""
    def took(n, read):
        page = f"<div>{'<div class=yuRUbf>'}" + "".join(f"<a href=?model={i}>" for i in range(n)) + "</div><a href=out>"
        pages = spark.createDataFrame([(page,)], "html string")
        began = time.monotonic()
        got = [tuple(r) for r in pages.select(F.explode(read(F.col("html"))).alias("x")).select("x.*" if read is extract.links else "x").collect()]
        return time.monotonic() - began, got

    few, many = 4_000, 64_000
    for read, want in ((extract.index_models, [(str(i),) for i in range(many)]), (extract.links, [(f"?model={i}", True) for i in range(many)] + [("out", False)])):
        took(few, read)
        least = took(few, read)[0]
        most, got = took(many, read)
        assert got == want and most < 16 * max(least, 0.25) * 2

"""Pages of plain tags are read quickly, and as the standard parser reads them."""

import random

from pyspark.sql import functions as F

from sheaf.functions.html import Tags
from sheaf import queries as Q
from sheaf.operators import elements, pages
from sheaf.sources.shared import laid_out

PIECES = ["<p>", "</p>", '<a href="x">', "</a>", "<br>", "<br/>", "text\n", "&amp;", "&", "<", "'", "<!-- c -->", "<!--", "-->", "--", "<script>", "</script>", "<STYLE>", "<style>", "</style>", "<title>", "</title>", "<!DOCTYPE html>", "<li class='r'>", '<li class="r" ID="m">', "</li >", '<img src="a&b">', '<div title="a>b<c">', "</div>", "<?pi?>", "<1>", "é"]


class Heard(Tags):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.raw = [], False

    def handle_starttag(self, tag, attrs):
        self.raw = tag in ("script", "style")
        self.out.append((tag, attrs))

    def handle_endtag(self, tag):
        self.raw = False
        self.out.append(tag)

    def handle_data(self, data):
        # What scripts and styles hold is never said.
        if not self.raw:
            self.out.append([data])


def test_plain_pages_are_heard_as_by_the_standard_parser():
    rng = random.Random(5)
    for _ in range(20_000):
        html = "".join(rng.choices(PIECES, k=rng.randrange(1, 9)))
        quick, slow = Heard(), Heard()
        quick.read(html)
        slow.feed(html)
        slow.close()
        assert quick.out == slow.out, html


def test_plain_pages_take_the_quick_way(monkeypatch):
    def never(self, data):
        raise AssertionError("the standard parser was asked")

    monkeypatch.setattr("html.parser.HTMLParser.feed", never)
    html = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><main><ul><li><a href="/x?a=1">A <b>b</b></a></li></ul></main></body></html>'
    assert pages.read_links(html) == [("A b", "/x?a=1")] and pages.page_blocks(html)[0]["text"] == "A b" and elements.page_parts(html)["main"] == "A b"


def test_tables_that_are_laid_out_stay_where_they_are(spark):
    rows = laid_out(spark.range(1000).select("id", F.lit("x").alias("y")), "rows", "id", 1000)
    some = spark.range(0, 1000, 2)
    joined = rows.hint("merge").join(some, "id")
    assert joined.count() == 500 and str(joined._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") <= 1


def test_blocks_bring_their_pages_addresses(spark, sf):
    built = Q.g8_build_records(spark, sf)
    plan = str(built._jdf.queryExecution().optimizedPlan())
    assert "Join" not in plan and plan.count("Relation") == 1
    some = pages.extract_blocks(spark.createDataFrame([(1, "https://h.example/x", "<li>A</li>")], "page_id long, url string, html string"), keep=["url"])
    assert [tuple(r) for r in some.collect()] == [(1, 0, "li", "A", "https://h.example/x")]

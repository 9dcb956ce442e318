"""The page source: readers by domain, columns and filters, empty and odd pages."""

from broadloom.sources import page_source as S
from broadloom.sources import pages as P


def own(url, page):
    yield "one", page, 5, "0:05"


def family(url, page):
    yield "family", page, 6, None


def lent(url, page):
    yield "lent", page, 7, None


READERS = {"own.tv": own, ".net.tv": family, "lent.tv": lent}
BORROWED = {"own.tv": "lent.tv", "poor.tv": "lent.tv", "lost.tv": "nobody.tv"}
PAGES = [
    ("http://www.own.tv/a", "A"), ("https://x.net.tv:8080/b", "B"), ("http://poor.tv", "C"), ("http://lost.tv", "<li>9.05 News &amp; talk</li><script>10:00 no</script><p>23:59</p><td>24:10 no</td>"),
    ("http://poor.tv", None), (None, "8:00 nowhere"), ("http://[bad", "x"),
]
WANT = {("own.tv", "one", "A", 5), ("x.net.tv", "family", "B", 6), ("poor.tv", "lent", "C", 7), ("poor.tv", "lent", "", 7), ("lost.tv", None, "News & talk", 545), ("", None, "nowhere", 480)}


def saved(spark, tmp_path, parts=3):
    path = str(tmp_path / "pages")
    spark.createDataFrame(PAGES, "url string, html string").repartition(parts).write.parquet(path)
    S.register(spark, READERS, BORROWED, name="pages_of_tests")
    return spark.read.format("pages_of_tests"), path


def test_readers_by_domain(spark, tmp_path):
    source, path = saved(spark, tmp_path)
    df = source.load(path)
    assert df.rdd.getNumPartitions() == 3
    assert {(r.site, r.channel, r.title, r.minute) for r in df.collect()} == WANT
    frame = S.page_rows(spark.createDataFrame(PAGES, "url string, html string"), READERS, BORROWED)
    assert {(r.site, r.channel, r.title, r.minute) for r in frame.collect()} == WANT


def test_columns_and_filters_are_pushed(spark, tmp_path):
    source, path = saved(spark, tmp_path)
    assert source.schema("minute int, site string").load(path).columns == ["minute", "site"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = source.option("pushdown", "true").load(path).filter("site IN ('own.tv', 'poor.tv') AND minute > 5")
        assert {(r.site, r.minute) for r in got.collect()} == {("poor.tv", 7)}
        reader = S.FilteringReader(S.Rows(["site"], READERS, BORROWED), path)
        assert [type(f).__name__ for f in reader.pushFilters([S.EqualTo(("site",), "own.tv"), S.EqualTo(("minute",), 5)])] == ["EqualTo"] and reader.sites == {"own.tv"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_fallback_equals_the_expressions(spark, tmp_path):
    html = "<ul><li><b>10:15</b> One</li><li>7:05  Two<br>21.40 x &lt;y&gt; &quot;z&quot;</li></ul><!-- 11:00 no --><div>12:00</div>"
    pages = spark.createDataFrame([("http://a.tv/1", html)], "url string, html string")
    columns = ["site", "title", "minute", "raw_time", "url"]
    assert sorted(map(tuple, S.page_rows(pages).select(columns).collect())) == sorted(map(tuple, P.timed_lines(pages).select(columns).collect()))


def test_a_folder_without_pages(spark, tmp_path):
    (tmp_path / "none").mkdir()
    S.register(spark)
    assert spark.read.format("broadloom_pages").load(str(tmp_path / "none")).count() == 0

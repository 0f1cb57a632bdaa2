import hashlib

from pyspark.sql import functions as F

from brook.sources import feeds as FD


def sid(*parts):
    return hashlib.sha1("\x1f".join(p or "" for p in parts).encode()).hexdigest()[:16]


RSS = """<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>
<item><title>A</title><title>A2</title><link>http://x/a?p=1&amp;q=2</link><description>&lt;b&gt;s&lt;/b&gt;</description>
<pubDate>Fri, 05 Jun 2026 21:00:00 +0000</pubDate><category>first</category><category>second</category>
<guid isPermaLink="false">g1</guid></item>
<item><title> B </title><link>http://x/b</link></item>
<item><description>no title, no link</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="self" href="http://self"/>
<link href="http://alt"/><id>urn:1</id><updated>2026-06-05T21:00:00Z</updated><category term="tech"/></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>c</title></channel>
<item><title>R</title><link>http://r</link></item></rdf:RDF>"""
BAD = "<rss><channel><item><title>broken"


def payloads(spark, rows):
    return spark.createDataFrame([(u, f, s, b, "2026-06-05T00:00:00+00:00") for u, f, s, b in rows],
                                 "url string, format string, source string, body string, scraped_at string")


def test_xml_layouts(spark):
    p = payloads(spark, [("u1", "xml", "s1", RSS), ("u2", "xml", None, ATOM), ("u3", "xml", "s3", RDF),
                         ("u4", "xml", "s4", BAD)])
    rows = {r.title: r for r in FD.feed_xml_explode(p).collect()}
    assert set(rows) == {"A2", "B", "E", "R"}  # orphan dropped, malformed gives nothing
    a = rows["A2"]  # last title wins
    assert (a.id, a.link, a.summary, a.category, a.source) == ("g1", "http://x/a?p=1&q=2", "<b>s</b>", "first", "s1")
    assert a.published_at == "Fri, 05 Jun 2026 21:00:00 +0000"
    assert rows["B"].id == sid("http://x/b", "B")  # no guid: stable id of (link, title)
    e = rows["E"]
    assert (e.link, e.category, e.id, e.source) == ("http://alt", "tech", "urn:1", "u2")  # last link; term; url source
    assert rows["R"].id == sid("http://r", "R")


def test_csv_payloads(spark):
    body1 = 'Country, Year ,Value\nNorway,2001,3\n"Land, North",2002,\n'
    body2 = 'title,link,date,description,type\r\nT,"http://l",2026-01-02,"line one\nline two",news\r\n,http://m,,  ,\r\n'
    p = payloads(spark, [("u1", "csv", "owid", body1), ("u2", "csv", "s2", body2)])
    rows = sorted(FD.open_csv_normalise(p).collect(), key=lambda r: (r.source, r.title or ""))
    got = [(r.source, r.title, r.link, r.published_at, r.summary, r.category) for r in rows]
    assert got == [("owid", "Land, North", None, "2002", None, None), ("owid", "Norway", None, "2001", None, None),
                   ("s2", None, "http://m", None, None, None),
                   ("s2", "T", "http://l", "2026-01-02", "line one\nline two", "news")]
    assert rows[1].id == sid("", "Norway")


def test_feed_union_dispatch(spark):
    p = payloads(spark, [("u1", "XML", "s1", RSS), ("u2", "csv", "s2", "title\nx\n"), ("u3", "json", "s3", "title\ny\n")])
    n = {r._source: r.n for r in FD.feed_union(p).groupBy("_source").agg(F.count("*").alias("n")).collect()}
    assert n == {"s1": 2, "s2": 1, "s3": 1}  # anything but xml is read as CSV


def test_acquire_with_injected_fetcher(spark):
    def _fake_fetch(url):  # a closure, so it ships to the workers by value
        if "fail" in url:
            raise OSError("boom")
        return b"<rss/>"

    man = spark.createDataFrame([("http://ok", "xml", "s"), ("http://fail", "csv", None)], "url string, format string, source string")
    rows = {r.url: r for r in FD.acquire_payloads(man, fetcher=_fake_fetch, parallelism=2, pause_s=0).collect()}
    assert rows["http://ok"].body == "<rss/>" and rows["http://ok"].error is None
    assert rows["http://fail"].body is None and "boom" in rows["http://fail"].error
    assert rows["http://fail"].source == "http://fail"



def test_open_csv_files_form(spark, tmp_path):
    p = tmp_path / "co2.csv"
    p.write_text('Country , YEAR,co2,Description\nNorway,2001,3,"a\nb"\n , 2002,, \n')
    df = spark.read.option("header", "true").option("multiLine", "true").csv(str(p))
    rows = sorted(FD.open_csv_files(df, "owid", "2026-06-05T00:00:00+00:00").collect(), key=lambda r: r.published_at)
    got = [(r.title, r.published_at, r.summary, r.source, r._source) for r in rows]
    assert got == [("Norway", "2001", "a\nb", "owid", "owid"), (None, "2002", None, "owid", "owid")]
    assert rows[0].id == sid("", "Norway")


def test_xml_tags_match_regardless_of_case(spark):
    body = "<RSS><Channel><ITEM><Title>Up</Title><LINK>http://l</LINK><PUBDATE>2026</PUBDATE></ITEM></Channel></RSS>"
    rows = FD.feed_xml_explode(payloads(spark, [("u", "xml", "s", body)])).collect()
    assert [(r.title, r.link, r.published_at) for r in rows] == [("Up", "http://l", "2026")]


def test_declared_encoding_counts():
    text = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>Caf\u00e9</title></item></channel></rss>'
    assert FD.decode_body(text.encode("latin-1")) == text
    assert FD.decode_body("\ufeffplain \u00e9".encode()) == "plain \u00e9"
    assert FD.decode_body(b'<?xml encoding="no-such"?>\xff') == '<?xml encoding="no-such"?>\ufffd'


def test_prefixed_tags(spark):
    atom = ATOM.replace("</", "</atom:").replace("<e", "<atom:e").replace("<f", "<atom:f").replace("<l", "<atom:l") \
        .replace("<t", "<atom:t").replace("<i", "<atom:i").replace("<u", "<atom:u").replace("<c", "<atom:c")
    rss = ("<rss><channel><item><title>A</title><media:title>M</media:title><link>http://x</link>"
           "<itunes:summary><![CDATA[see <x:y> <b>]]></itunes:summary></item></channel></rss>")
    rows = {r._source: r for r in FD.feed_xml_explode(payloads(spark, [("u", "xml", "a", atom), ("u", "xml", "r", rss)])).collect()}
    e = rows["a"]
    assert (e.title, e.link, e.id, e.published_at, e.category) == ("E", "http://alt", "urn:1", "2026-06-05T21:00:00Z", "tech")
    r = rows["r"]
    assert (r.title, r.link, r.summary) == ("M", "http://x", "see <x:y> <b>")  # the last title wins, whatever its prefix


def test_items_at_any_depth_in_document_order(spark):
    """Nested feeds, an item that is the root, an item within an item, mixed summary tags, markup in a text."""
    bodies = {
        "deep": "<feed><wrap><entry><title>D</title></entry></wrap><a><b><c><item><link>http://d2</link></item></c></b></a></feed>",
        "root": "<item><title>Only</title></item>",
        "inner": "<rss><channel><item><title>Out</title><item><title>In</title></item><link>http://o</link></item></channel></rss>",
        "order": "<r><item><title>O</title><summary>first</summary><description>second</description><updated>u</updated>"
                 "<pubDate>p</pubDate><id>i</id><guid>g</guid></item></r>",
        "markup": "<r><item><title>M <b>x</b> y</title><link>http://m</link><description><p>gone</p> tail</description></item></r>",
        "empty": "<r><item><title>E</title><description/><summary>late</summary><category term=''>c</category></item></r>",
        "entity": "<r><item><title>&nbsp;</title></item></r>", "null": None}
    p = payloads(spark, [(k, "xml", None, b) for k, b in bodies.items()])
    want = {("deep", "D", None, None), ("deep", None, "http://d2", None), ("root", "Only", None, None), ("inner", "Out", "http://o", None),
            ("inner", "In", None, None), ("order", "O", None, "first"), ("markup", "M", "http://m", ""), ("empty", "E", None, "")}
    for rows in (FD.feed_xml_explode(p), FD.feed_union(p)):
        assert {(r.source, r.title, r.link, r.summary) for r in rows.collect()} == want
    by = {r.title: r for r in FD.feed_xml_explode(p).collect()}
    assert (by["O"].published_at, by["O"].id, by["E"].category) == ("u", "i", "c")
    assert [names for names, _, _ in FD.xml_items(bodies["inner"])] == [["title", "item", "link"], ["title"]]


def test_long_csv_cells(spark):
    """A cell beyond the csv module's own limit, an empty payload, a header alone."""
    long = "x" * 300_000
    p = payloads(spark, [("u1", "csv", "a", f"title,summary\nT,{long}\n"), ("u2", "csv", "b", ""), ("u3", "csv", "c", "title\n"), ("u4", "csv", "d", None)])
    assert [(r.title, len(r.summary)) for r in FD.open_csv_normalise(p).collect()] == [("T", 300_000)]

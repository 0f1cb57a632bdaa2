"""Feed payloads -> raw article rows.

One pass over the payloads (``mapInArrow``) turns each into items: an XML
``item`` / ``entry`` at any depth with its child elements in document order, a
CSV record with its cells under the header.  What becomes of tags, attributes
and columns (aliases, first or last, fallback chains, the stable id) is all
Spark expressions over those two shapes.

``acquire_payloads`` fetches the manifest URLs on executors (``mapInPandas``
over a manifest repartitioned to the wanted parallelism).
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import sys
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.functions.text import blank_to_null, stable_id
from brook.schemas import ARTICLE_FIELDS, PAYLOAD

# What an item's tag is called, and which children name a field.
ITEM_TAGS = ("item", "entry")
SUMMARY_TAGS = ["description", "summary", "content"]
DATE_TAGS = ["pubdate", "published", "updated"]
ID_TAGS = ["guid", "id"]
# The attribute that stands for the text of a link or a category.
TAG_ATTRIBUTE = {"link": "href", "category": "term"}

RAW_OUT = ARTICLE_FIELDS + ["_source", "_scraped_at"]

# Fixed value: items of one Arrow batch.
ITEM_BATCH = 10_000

# An item: the tags of its children (header cells), and next to each its text
# (cell) and the attribute that may stand for it.
ITEMS = pa.schema([("_source", pa.string()), ("_scraped_at", pa.string()), ("xml", pa.bool_()), ("names", pa.list_(pa.string())),
                   ("texts", pa.list_(pa.string())), ("attrs", pa.list_(pa.string()))])
_ITEMS_DDL = "_source string, _scraped_at string, xml boolean, names array<string>, texts array<string>, attrs array<string>"


def _strip(c: Column) -> Column:
    """Python-style strip: all surrounding whitespace, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


class _Element:
    """An open element: its item's children, if it is an item; its text up to
    its first child, if it is a child of an item."""
    __slots__ = ("children", "text")

    def __init__(self):
        self.children: list | None = None
        self.text: list | None = None


def xml_items(body: str) -> list[tuple[list, list, list]]:
    """``names, texts, attrs`` of every item in a document, at any depth, in
    document order (an item within an item follows it).  Tags and prefixes are
    taken as they are written, so a prefix needs no declaration.  A document
    that is not well-formed has no items."""
    open_: list[_Element] = []
    found: list[list] = []

    def start(name: str, attrs: dict) -> None:
        tag = name.rpartition(":")[2].lower()
        element = _Element()
        if open_:
            above = open_[-1]
            if above.children is not None:
                element.text = []
                above.children.append((tag, element.text, attrs.get(TAG_ATTRIBUTE.get(tag))))
            above.text = None
        if tag in ITEM_TAGS:
            element.children = []
            found.append(element.children)
        open_.append(element)

    def end(name: str) -> None:
        open_.pop()

    def data(text: str) -> None:
        if open_ and open_[-1].text is not None:
            open_[-1].text.append(text)

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(body, True)
    except expat.ExpatError:
        return []
    return [([c[0] for c in item], ["".join(c[1]) for c in item], [c[2] for c in item]) for item in found]


def csv_items(body: str) -> Iterator[tuple[list, list, list]]:
    """Header, cells and no attributes of every record that has cells, as they
    stand in the text."""
    csv.field_size_limit(sys.maxsize)
    lines = csv.reader(io.StringIO(body))
    header = next(lines, None)
    return ((header, cells, []) for cells in lines if cells)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ITEMS.types, strict=True)], schema=ITEMS)

    columns: list[list] = [[] for _ in ITEMS]
    for b in batches:
        for body, source, scraped_at, xml in zip(*(b.column(c).to_pylist() for c in ("body", "_source", "_scraped_at", "xml")), strict=True):
            for item in (xml_items if xml else csv_items)(body) if body is not None else ():
                for column, value in zip(columns, (source, scraped_at, xml, *item), strict=True):
                    column.append(value)
                if len(columns[0]) >= ITEM_BATCH:
                    yield batch()
                    columns = [[] for _ in ITEMS]
    if columns[0]:
        yield batch()


def _items(payloads: DataFrame, xml: Column) -> DataFrame:
    return payloads.select("body", F.coalesce("source", "url").alias("_source"), F.col("scraped_at").alias("_scraped_at"),
                           xml.alias("xml")).mapInArrow(_walk, _ITEMS_DDL)


def _child(names: list[str], last: bool = False) -> Column:
    """Value of the first (last) child of an item with one of ``names``: its
    attribute, else its text."""
    pairs = F.arrays_zip("names", "texts", "attrs")
    one = F.try_element_at(F.filter(pairs, lambda p: p["names"].isin(*names)), F.lit(-1 if last else 1))
    return F.coalesce(F.nullif(one["attrs"], F.lit("")), _strip(one["texts"]))


def _xml_record() -> dict[str, Column]:
    """Title and link: the last one.  Summary, date, category, id: the first,
    in document order, of any of their tags."""
    return {"id": _child(ID_TAGS), "source": F.col("_source"), "title": _child(["title"], True), "link": _child(["link"], True),
            "published_at": _child(DATE_TAGS), "summary": _child(SUMMARY_TAGS), "category": _child(["category"])}


# ------------------------------------------------------------------- CSV
# Column fallback chains of open CSV feeds (first present wins).
CSV_FALLBACKS = {
    "title": ["title", "country", "name"],
    "published_at": ["published_at", "date", "year"],
    "link": ["link", "url"],
    "summary": ["summary", "description"],
    "category": ["category", "type"],
}


def _fields(header: Column, cells: Column) -> Column:
    """Map from header name (lower case, stripped) to value (stripped, empty
    is NULL).  A name that repeats keeps its last cell; cells beyond the
    header have no name and are left out."""
    names = F.transform(header, lambda h: F.lower(_strip(h)))
    pairs = F.arrays_zip(names.alias("k"), F.slice(cells, 1, F.greatest(F.size(header), F.lit(1))).alias("v"))
    own = F.array_distinct(names)
    last = F.transform(own, lambda k: F.nullif(_strip(F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]), F.lit("")))
    return F.map_from_arrays(own, last)


def _csv_record(field: Column, source: Column) -> dict[str, Column]:
    def pick(chain):
        return F.coalesce(*[F.try_element_at(field, F.lit(k)) for k in chain])

    return {"id": pick(["id"]), "source": source, **{c: pick(chain) for c, chain in CSV_FALLBACKS.items()}}


def _articles(df: DataFrame, record: dict[str, Column]) -> DataFrame:
    """Raw article rows of the fields ``record``; an item without an id gets
    the stable id of (link, title)."""
    out = df.select(*[record[c].alias(c) for c in ARTICLE_FIELDS], "_source", "_scraped_at")
    return out.withColumn("id", F.coalesce(F.col("id"), stable_id("link", "title"))).select(*RAW_OUT)


def _named(articles: DataFrame, xml: Column) -> DataFrame:
    """Without the feed items that have neither title nor link."""
    return articles.filter(~xml | (F.coalesce("title", F.lit("")) != "") | (F.coalesce("link", F.lit("")) != ""))


def feed_xml_explode(payloads: DataFrame) -> DataFrame:
    """One raw-article row per ``item`` / ``entry``, wherever it stands.

    Rules: link = href else text, last one wins; title last wins; summary the
    first of description / summary / content in document order; date the first
    of pubDate / published / updated; category term else text, first; id the
    first of guid / id, else the stable id of (link, title).  A child's text
    ends at its first own child.  Items with neither title nor link are
    dropped.  Source defaults to the url.  Tags count by their local name:
    ``atom:entry`` is an entry, ``media:title`` a title.  A payload that is not
    well-formed gives no rows.
    """
    return _named(_articles(_items(payloads, F.lit(True)), _xml_record()), F.lit(True))


def csv_fields_to_raw(df: DataFrame, field: Column, source: Column, scraped_at: Column) -> DataFrame:
    """(map of normalised header -> value) rows -> raw article rows."""
    return _articles(df.select(field.alias("_field"), source.alias("_source"), scraped_at.alias("_scraped_at")),
                     _csv_record(F.col("_field"), F.col("_source")))


def open_csv_normalise(payloads: DataFrame) -> DataFrame:
    """CSV payloads with arbitrary headers -> raw article rows."""
    return csv_fields_to_raw(_items(payloads, F.lit(False)), _fields(F.col("names"), F.col("texts")), F.col("_source"), F.col("_scraped_at"))


def open_csv_files(df: DataFrame, source: str, scraped_at: str) -> DataFrame:
    """File form: a frame read by ``spark.read.csv(header, multiLine)``.
    Header names are normalised, values trimmed, empty -> NULL."""
    names = [(c or "").strip().lower() for c in df.columns]
    last = {n: i for i, n in enumerate(names)}  # repeated header: last wins
    kv = []
    for n, i in sorted(last.items(), key=lambda t: t[1]):
        kv += [F.lit(n), blank_to_null(F.col(f"`{df.columns[i]}`").cast("string"))]
    return csv_fields_to_raw(df, F.create_map(*kv), F.lit(source), F.lit(scraped_at))


def feed_union(payloads: DataFrame) -> DataFrame:
    """``xml`` payloads are read as feeds, anything else as CSV, in one pass."""
    ok = payloads.filter(F.col("error").isNull()) if "error" in payloads.columns else payloads
    xml = F.col("xml")
    items = _items(ok, F.lower(F.coalesce(F.col("format"), F.lit(""))) == "xml")
    items = items.withColumn("_field", F.when(~xml, _fields(F.col("names"), F.col("texts"))))
    of_csv = _csv_record(F.col("_field"), F.col("_source"))
    record = {c: F.when(xml, x).otherwise(of_csv[c]) for c, x in _xml_record().items()}
    both = items.select("xml", *[record[c].alias(c) for c in ARTICLE_FIELDS], "_source", "_scraped_at")
    named = _named(both, xml)
    return named.withColumn("id", F.coalesce(F.col("id"), stable_id("link", "title"))).select(*RAW_OUT)


# -------------------------------------------------------------- acquisition
FETCH_TIMEOUT_S = 30
FETCH_PAUSE_S = 0.5
USER_AGENT = "Mozilla/5.0 (compatible; brook-feed-reader/0.1)"


# Fixed value: bytes read from a connection at once.
READ_BYTES = 1 << 16


def http_fetch(url: str) -> bytes:
    """The body behind a URL, read piece by piece."""
    import urllib.request

    opener = urllib.request.build_opener()
    opener.addheaders = [("User-Agent", USER_AGENT)]
    with opener.open(url, timeout=FETCH_TIMEOUT_S) as source:
        return b"".join(iter(lambda: source.read(READ_BYTES), b""))


def decode_body(raw: bytes) -> str:
    """Text of a payload: a byte order mark or the encoding that an XML
    declaration names counts, else UTF-8.  Bytes that do not fit are replaced."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark):].decode(name, errors="replace")
    named = re.match(rb"""\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", raw[:256])
    try:
        name = codecs.lookup(named[1].decode()).name if named else "utf-8"
    except LookupError:
        name = "utf-8"
    return raw.decode(name, errors="replace")


def _fetch_batches(fetcher, pause_s):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for url, fmt, source in zip(pdf["url"], pdf["format"], pdf["source"]):
                scraped_at = datetime.now(timezone.utc).isoformat()
                body, err = None, None
                try:
                    body = decode_body(fetcher(url))
                except Exception as exc:  # one bad URL must not stop the rest
                    err = f"{type(exc).__name__}: {exc}"
                rows.append((url, (fmt or "").lower(), source or url, body, scraped_at, err))
                if pause_s:
                    time.sleep(pause_s)
            yield pd.DataFrame(rows, columns=PAYLOAD.fieldNames())
    return run


def acquire_payloads(manifest: DataFrame, fetcher=http_fetch, parallelism: int | None = None,
                     pause_s: float = FETCH_PAUSE_S) -> DataFrame:
    """Fetch every manifest URL on the executors; a failed fetch gives a row
    with ``error`` set instead of stopping the job.  Land the result once
    (Parquet) before parsing so the fetch never runs twice.  By default as many
    tasks fetch at once as the cluster runs, or as there are URLs, if fewer."""
    n = parallelism or max(1, min(manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.repartition(n).mapInPandas(_fetch_batches(fetcher, pause_s), PAYLOAD)


def _decode_batches(batches):
    import pandas as pd

    for pdf in batches:
        lost = pdf["content"].isna()
        yield pd.DataFrame({
            "url": pdf["url"], "format": pdf["format"].fillna("").str.lower(), "source": pdf["source"].fillna(pdf["url"]),
            "body": [None if gone else decode_body(raw) for raw, gone in zip(pdf["content"], lost)],
            "scraped_at": datetime.now(timezone.utc).isoformat(),
            "error": [f"no such file: {url}" if gone else None for url, gone in zip(pdf["url"], lost)]})


def read_payload_files(manifest: DataFrame, path: str) -> DataFrame:
    """The payloads of manifest entries whose ``url`` is a file below ``path``,
    in any store that Spark reads (paths as Spark lists them).  An entry
    without a file gives a row with ``error`` set, as a failed fetch does."""
    files = manifest.sparkSession.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")
    return manifest.join(files, "url", "left").select("url", "format", "source", "content").mapInPandas(_decode_batches, PAYLOAD)

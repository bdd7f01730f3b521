"""Nested payloads, report pages and per-fit documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


HOURLY_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("node", T.StringType()),
            T.StructField(
                "hourly",
                T.StructType(
                    [
                        T.StructField("time", T.ArrayType(T.StringType())),
                        T.StructField("temperature", T.ArrayType(T.DoubleType())),
                        T.StructField("humidity", T.ArrayType(T.DoubleType())),
                    ]
                ),
            ),
        ]
    )
)


def explode_hourly(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per node-hour of a payload that is one node object or a list of them."""
    text = F.trim(F.col(payload))
    as_list = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    nodes = df.select(F.explode(F.from_json(as_list, HOURLY_SCHEMA)).alias("n"))
    zipped = F.arrays_zip(
        F.col("n.hourly.time").alias("time"),
        F.col("n.hourly.temperature").alias("temp"),
        F.col("n.hourly.humidity").alias("rh"),
    )
    return nodes.select(F.col("n.node").alias("node"), F.explode(zipped).alias("h")).select(
        "node",
        F.col("h.time").alias("time_text"),
        F.try_to_timestamp("h.time").alias("hour"),
        F.col("h.temp").alias("temp"),
        F.col("h.rh").alias("rh"),
    )


# Patterns of report links.
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
VOLUME_PATTERN = r"(?i)vol[_\s.-]*(\d+)"
NUMBER_PATTERN = r"(?:no|No)[_\s.-]*(\d{1,2})"
VOLUME_YEAR_OFFSET = 1973


def discover_links(
    pages: DataFrame,
    *,
    html: str = "html",
    base_url: str = "url",
    suffix: str = ".pdf",
    start_year: int,
    end_year: int,
) -> DataFrame:
    """Report links of whole pages: title, absolute url, volume, issue year and number.

    One row per url (the first in page order), limited to the wanted issue years.
    """
    anchors = F.arrays_zip(
        *[
            F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(i)).alias(name)
            for i, name in enumerate(("double", "single", "bare", "text"), start=1)
        ]
    )
    found = pages.select(
        F.col("page_id"), F.col(base_url).alias("_base"), F.posexplode(anchors).alias("_pos", "_a")
    )
    href = F.trim(unescape_html(F.concat("_a.double", "_a.single", "_a.bare")))
    url = join_url(F.col("_base"), href)
    plain = unescape_html(F.regexp_replace("_a.text", r"<[^>]*>", " "))
    text = F.trim(F.regexp_replace(plain, r"\s+", " "))
    title = F.when(text != "", text).otherwise(F.element_at(F.split(href, "/"), -1))
    named = found.select("page_id", "_pos", url.alias("url"), title.alias("title")).filter(
        F.lower("url").contains(suffix)
    )
    both = F.concat_ws(" ", "title", "url")
    volume = F.regexp_extract(both, VOLUME_PATTERN, 1).try_cast("int")
    number = F.regexp_extract(both, NUMBER_PATTERN, 1).try_cast("int")
    issues = named.select(
        "page_id",
        "_pos",
        "url",
        "title",
        volume.alias("volume"),
        (volume + VOLUME_YEAR_OFFSET).alias("issue_year"),
        F.when(number.between(1, 53), number).alias("issue_week"),
    ).filter(F.col("issue_year").between(start_year, end_year))
    first = F.min_by(
        F.struct("title", "volume", "issue_year", "issue_week"), F.struct("page_id", "_pos")
    )
    return issues.groupBy("url").agg(first.alias("f")).select("url", "f.*")


def unescape_html(text: Column) -> Column:
    """Text with the predefined entities decoded."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def join_url(base: Column, href: Column) -> Column:
    """Absolute url of a link on the page ``base``: full, scheme-, site-, query- or page-relative."""
    page = F.regexp_replace(base, r"[?#].*$", "")
    origin = F.regexp_extract(page, r"^([A-Za-z][\w+.-]*://[^/]*)", 1)
    path = F.substring(page, F.length(origin) + 1, F.length(page))
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)", 1))
    target = F.when(href.startswith("/"), href).otherwise(F.concat(folder, href))
    tail = F.regexp_extract(target, r"([?#].*)$", 1)
    steps = F.split(F.regexp_replace(target, r"[?#].*$", ""), "/")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(s))),
    )
    closed = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return (
        F.when(href.rlike(r"^[A-Za-z][\w+.-]*:"), href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/]+:)", 1), href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, F.array_join(walked, "/"), closed, tail))
    )


def table_lines(
    docs: DataFrame, regions: DataFrame, *, text: str = "text", doc: str = "doc_id"
) -> DataFrame:
    """Lines that open with a known region name: (region, current, cumulative, returns).

    The region is matched by equi-join on the leading words of the line, longest name first.
    """
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).select(
        doc, "line_no", F.trim(F.regexp_replace("line", r"(?U)\s+", " ")).alias("line")
    )
    # every leading run of words is a candidate name, as long as the longest region: no cross join
    words = F.split("line", " ")
    longest_name = regions.agg(F.coalesce(F.max(F.size(F.split("region", " "))), F.lit(1))).scalar()
    widths = F.sequence(F.lit(1), F.least(F.size(words), F.col("_longest")))
    cands = lines.withColumn("_longest", longest_name).withColumn(
        "region", F.explode(F.transform(widths, lambda n: F.array_join(F.slice(words, 1, n), " ")))
    )
    hits = cands.join(regions.select("region"), "region", "inner")
    longest = hits.groupBy(doc, "line_no").agg(
        F.max_by(F.struct("region", "line"), F.length("region")).alias("h")
    )
    rest = F.expr("substr(h.line, length(h.region) + 1)")
    nums = F.transform(
        F.regexp_extract_all(rest, F.lit(r"\b(\d+)\b"), F.lit(1)), lambda s: s.cast("long")
    )
    return (
        longest.select(doc, "line_no", F.col("h.region").alias("region"), nums.alias("nums"))
        .filter(F.size("nums") >= 2)
        .select(
            doc,
            "line_no",
            "region",
            F.col("nums")[0].alias("current"),
            F.col("nums")[1].alias("cumulative"),
            F.element_at("nums", -1).alias("returns_pct"),
        )
    )


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents below a folder, one typed row each, with the file they came from."""
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .json(path)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )


METRIC_VALUE = T.StructType(
    [T.StructField("value", T.DoubleType()), T.StructField("reason", T.StringType())]
)


def metric_document_schema(series: Sequence[str], metrics: Sequence[str]) -> T.StructType:
    inner = T.StructType([T.StructField(m, METRIC_VALUE) for m in metrics])
    return T.StructType([T.StructField(s, inner) for s in series])


def metric_document_rows(
    df: DataFrame, document: str, series: Sequence[str], metrics: Sequence[str], *keys: str
) -> DataFrame:
    """One row per document with a value and a null-reason column per series and metric."""
    parsed = F.from_json(F.col(document), metric_document_schema(series, metrics))
    cells = []
    for s in series:
        for m in metrics:
            cells.append(F.col(f"_d.{s}.{m}.value").alias(f"{s}_{m}"))
            cells.append(F.col(f"_d.{s}.{m}.reason").alias(f"{s}_{m}_reason"))
    return df.select(*keys, parsed.alias("_d")).select(*keys, *cells)


# Fixed value: slack of a box that covers another.
COVER_TOLERANCE = 1e-9


def latest_covering(
    requests: DataFrame,
    sources: DataFrame,
    *,
    request_id: str = "request_id",
    tile: float = 1.0,
) -> DataFrame:
    """Latest retrieval among the sources that cover a request's box and dates.

    Boxes meet through integer tiles: a source is listed under every tile it touches, a request
    looks under the one tile of its south-west corner, so each pair is met once by equi-join.
    """
    def tiles(lo: str, hi: str) -> Column:
        first = F.floor((F.col(lo) - COVER_TOLERANCE) / tile)
        return F.sequence(first, F.floor((F.col(hi) + COVER_TOLERANCE) / tile))

    src = (
        sources.withColumn("_tx", F.explode(tiles("min_lon", "max_lon")))
        .withColumn("_ty", F.explode(tiles("min_lat", "max_lat")))
        .alias("s")
    )
    req = requests.withColumns(
        {"_tx": F.floor(F.col("min_lon") / tile), "_ty": F.floor(F.col("min_lat") / tile)}
    ).alias("r")
    covers = (
        (F.col("s._tx") == F.col("r._tx"))
        & (F.col("s._ty") == F.col("r._ty"))
        & (F.col("s.min_lon") <= F.col("r.min_lon") + COVER_TOLERANCE)
        & (F.col("s.max_lon") >= F.col("r.max_lon") - COVER_TOLERANCE)
        & (F.col("s.min_lat") <= F.col("r.min_lat") + COVER_TOLERANCE)
        & (F.col("s.max_lat") >= F.col("r.max_lat") - COVER_TOLERANCE)
        & (F.col("s.start_day") <= F.col("r.start_day"))
        & (F.col("s.end_day") >= F.col("r.end_day"))
    )
    best = F.max_by("s.source_id", F.struct("s.retrieved_at", "s.sha256"))
    return (
        req.join(src, covers)
        .groupBy(f"r.{request_id}")
        .agg(best.alias("source_id"), F.count(F.lit(1)).alias("n_covering"))
    )


def inventory_records(df: DataFrame, document: str) -> DataFrame:
    """Normalise source metadata records that spell the same facts in different ways.

    Fixed values: the alternative field names, first present wins.
    """
    schema = (
        "source_name string, source string, request_url string, upstream_url string, "
        "request_params map<string,string>, sha256 string, byte_length bigint, "
        "content_length bigint, retrieved_at string, licenses string, license string"
    )
    keys = [c for c in df.columns if c != document]
    d = df.select(*keys, F.from_json(F.col(document), schema).alias("_d"))
    c = lambda *names: F.coalesce(*[F.col(f"_d.{n}") for n in names])
    pairs = F.transform(
        F.map_entries("_d.request_params"),
        lambda e: F.concat_ws("=", F.url_encode(e["key"]), F.url_encode(e["value"])),
    )
    asked = F.concat_ws("?", "_d.request_url", F.array_join(pairs, "&"))
    has_query = F.col("_d.request_url").isNotNull() & F.col("_d.request_params").isNotNull()
    return d.select(
        *keys,
        c("source_name", "source").alias("source_name"),
        F.when(has_query, asked).otherwise(c("upstream_url", "request_url")).alias("source_url"),
        F.col("_d.sha256").alias("sha256"),
        c("byte_length", "content_length").alias("size_bytes"),
        F.col("_d.retrieved_at").alias("retrieved_at"),
        c("licenses", "license").alias("licenses"),
    )

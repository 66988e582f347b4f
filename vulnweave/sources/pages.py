"""Pages of advisory sites: a data source with a partition for each page, and rows from landed pages."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import advisory as A

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.template = options["url"]
        self.first, self.last = int(options.get("first", 1)), int(options.get("last", 10))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self):
        return [_Page(n) for n in range(self.first, self.last + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        url = self.template.replace("{page}", str(partition.number))
        for n in range(self.attempts):
            try:
                with urllib.request.urlopen(url, timeout=30) as reply:
                    yield partition.number, url, reply.read().decode("utf-8", "replace"), None
                    return
            except Exception as failure:
                if n == self.attempts - 1:
                    yield partition.number, url, None, str(failure)
                else:
                    time.sleep(2**n)


class AdvisoryPages(DataSource):
    """format("advisory_pages"), options url (with {page}), first, last, attempts -> page, url, body, error. A failed page is a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "advisory_pages"

    def schema(self) -> str:
        return "page int, url string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AdvisoryPages)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages: url (the path) and body, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"))


class _Tree(HTMLParser):
    """Nodes as [tag, attributes, children or texts]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _nodes(node: list) -> Iterator[list]:
    for child in node[2]:
        if isinstance(child, list):
            yield child
            yield from _nodes(child)


def _text(node: list | None) -> str:
    if node is None:
        return ""
    return "".join(c if isinstance(c, str) else _text(c) for c in node[2]).strip()


def _first(node: list, tag: str = "", cls: str = "") -> list | None:
    return next((n for n in _nodes(node) if (not tag or n[0] == tag) and (not cls or cls in n[1].get("class", "").split())), None)


def _parse(body: str | None) -> list:
    tree = _Tree()
    tree.feed(body or "")
    tree.close()
    return tree.root


_CARDS = "array<struct<title:string,href:string,raw_id:string,severity:string,date:string>>"
_CELLS = "array<struct<href:string,avd_id:string,name:string,kind:string,date:string>>"


def _parsed(body: Column, one: Callable[[str | None], list], kind: str) -> Column:
    """`one` over whole pages, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(one)

    return run(body)


def _cards(body: Column) -> Column:
    def one(body):
        out = []
        for row in (n for n in _nodes(_parse(body)) if "Box-row" in n[1].get("class", "").split()):
            title = _first(row, "a", "Link--primary")
            if title is not None:
                when = _first(row, "relative-time")
                out.append({"title": _text(title), "href": title[1].get("href", ""), "raw_id": _text(_first(row, cls="text-bold")), "severity": _text(_first(row, cls="Label")) or None, "date": when[1].get("datetime", "")[:10] if when else ""})
        return out

    return _parsed(body, one, _CARDS)


def _cells(body: Column) -> Column:
    def one(body):
        out = []
        for row in (n for n in _nodes(_parse(body)) if n[0] == "tr"):
            cells = [n for n in _nodes(row) if n[0] == "td"]
            link = next((n for n in _nodes(cells[0]) if n[0] == "a" and "href" in n[1]), None) if len(cells) >= 4 else None
            if link is not None:
                out.append({"href": link[1]["href"], "avd_id": _text(link), "name": _text(cells[1]), "kind": _text(_first(cells[2], "button")) or None, "date": _text(cells[3])})
        return out

    return _parsed(body, one, _CELLS)


def _record(name: Column, vuln_id: Column, description: Column, date: Column, risk: Column, link: Column) -> list[Column]:
    return [name.alias("vulnerabilityName"), vuln_id.alias("cveId"), description.alias("description"), date.alias("disclosureTime"), risk.alias("riskLevel"), link.alias("referenceLink"), F.lit(0).alias("affectsWhitelist"), F.lit(0).alias("isDelete")]


def github_advisories(pages: DataFrame, base: str = "https://github.com") -> DataFrame:
    """(page, body) -> advisory records, one for each id (that of the first page and place)."""
    from ..operators.relational import distinct_on

    rows = pages.select("page", F.posexplode(_cards(F.col("body"))).alias("pos", "c")).select("page", "pos", "c.*")
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), "href"))
    rows = rows.withColumn("link", url).withColumn("level", A.severity(F.coalesce("severity", F.lit("Low"))))
    rows = rows.withColumn("id", A.advisory_id(F.col("raw_id"), F.col("link"), F.col("title")))
    out = rows.select("page", "pos", *_record(F.col("title"), F.col("id"), A.advisory_description(F.col("title"), F.col("id"), F.col("raw_id"), F.col("level")), F.col("date"), F.col("level"), F.col("link")))
    return distinct_on(out, ["cveId"], [F.col("page"), F.col("pos")]).drop("page", "pos")


def avd_advisories(pages: DataFrame, base: str = "https://avd.aliyun.com") -> DataFrame:
    """(page, body) -> advisory records of table rows with four cells and a link."""
    rows = pages.select(F.explode(_cells(F.col("body"))).alias("c")).select("c.*").withColumn("kind", F.coalesce("kind", F.lit(A.UNDEFINED_TYPE)))
    cve = A.first_match(F.col("name"), A.CVE)
    told = F.concat(F.lit("阿里云漏洞库收录的"), "kind", F.lit("类型漏洞，"), F.coalesce(F.concat(F.lit("CVE编号："), cve, F.lit("，")), F.lit("")), F.lit("漏洞名称："), "name")
    return rows.select(*_record(F.col("name"), F.coalesce(A.title_cve(F.col("name"), F.col("avd_id")), F.concat(F.lit("AVD-UNKNOWN-"), F.xxhash64("href").cast("string"))), told, F.col("date"), A.keyword_risk(F.col("name")), F.concat(F.lit(base), "href")))


#: The part of an NVD reply that is read.
NVD = "vulnerabilities array<struct<cve:struct<id:string,published:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double>>>,cvssMetricV3:array<struct<cvssData:struct<baseScore:double>>>>>>>"


def nvd_advisories(pages: DataFrame, base: str = "https://nvd.nist.gov/vuln/detail/") -> DataFrame:
    """(body: JSON) -> advisory records; a body that can't be read gives no record. All in built-in functions."""
    rows = pages.select(F.explode(F.from_json("body", NVD)["vulnerabilities"]).alias("v")).select("v.cve.*")
    said = F.coalesce(F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"], F.lit(""))
    score = F.coalesce(F.get(F.col("metrics.cvssMetricV31"), F.lit(0))["cvssData"]["baseScore"], F.get(F.col("metrics.cvssMetricV3"), F.lit(0))["cvssData"]["baseScore"])
    return rows.select(*_record(A.title_of(said, F.col("id")), F.col("id"), said, F.substring("published", 1, 10), A.cvss_risk(score), F.concat(F.lit(base), "id")))


def clean(records: DataFrame, source: str, run_ts: Column) -> DataFrame:
    """Advisory records with every field cleaned; rows stay as many as they are."""
    name = A.clean_name(F.col("vulnerabilityName"), F.col("cveId"), source)
    return records.select(*_record(name, A.clean_id(F.col("cveId"), source, run_ts), A.clean_description(F.col("description"), name, source), A.clean_date(F.col("disclosureTime"), run_ts), A.clean_risk(F.col("riskLevel")), A.clean_link(F.col("referenceLink"))))


def lookup_page(body: Column, testid: str) -> Column:
    """The text of the first element whose data-testid begins so, markup removed."""
    inner = F.regexp_extract(body, rf'(?s)<(\w+)[^>]*data-testid="{testid}[^"]*"[^>]*>(.*?)</\1>', 2)
    return A.text_or(F.regexp_replace(inner, "<[^>]*>", ""), "")

"""Queries: advisory records from pages and their cleaning. Pages, orders and line items stand for advisories where fixtures don't do."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import advisory as A
from ..operators import relational
from ..sources import pages as P
from .registry import Fixture, literal, query, table

RUN = "2024-06-01 12:30:00"
_CONTROL = "[\\x00-\\x1f\\x7f]"
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"

_RECORDS = Fixture("vulnerabilityName string, cveId string, description string, disclosureTime string, riskLevel string, referenceLink string", [
    ("  Log4Shell\t", " CVE-2021-44228 ", "Remote code\x07 execution", "2024-01-05", "critical", "nvd.nist.gov/x"),
    (None, "CVE-1-1", None, "2024-1-5", "MODERATE", None),
    ("   ", None, " ", "bad", "info", "  "),
    ("a" * 250, "", "b" * 1200, "2024-13-45", "weird", "http://a.b/c"),
    ("ok", "AVD-2023-17", "fine", "", "", "https://a.b"),
    ("", "", "", None, None, "ftp://x"),
    ("é漏洞", "X", "t\x1fu", "2024-02-30", "Informational", "a"),
])


def _sql_clean(source: str, records: str) -> str:
    strip = lambda c: f"trim({c}, {_TRIM})"
    blank = lambda c: f"coalesce({strip(c)} = '', true)"
    cut = lambda c, n: f"regexp_replace(CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n - 3}) || '...' ELSE {c} END, '{_CONTROL}', '', 'g')"
    up = source.upper()
    name = f"CASE WHEN {blank('vulnerabilityName')} THEN CASE WHEN coalesce(cveId, '') <> '' THEN '{up} Vulnerability ' || cveId ELSE '{up} {A.UNKNOWN_NAME}' END ELSE {cut(strip('vulnerabilityName'), 200)} END"
    day = strip("disclosureTime")
    title = f"upper(substr({strip('riskLevel')}, 1, 1)) || lower(substr({strip('riskLevel')}, 2))"
    return f"""
WITH named AS (SELECT *, {name} AS made FROM {records})
SELECT made AS vulnerabilityName,
 CASE WHEN {blank('cveId')} THEN '{up}-' || strftime(TIMESTAMP '{RUN}', '%Y%m%d%H%M%S') ELSE {strip('cveId')} END AS cveId,
 CASE WHEN {blank('description')} THEN '{up}漏洞库收录的漏洞：' || made ELSE {cut(strip('description'), 1000)} END AS description,
 CASE WHEN coalesce(regexp_full_match({day}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AND try_strptime({day}, '%Y-%m-%d') IS NOT NULL, false) THEN {day} ELSE '{RUN[:10]}' END AS disclosureTime,
 coalesce(map_extract(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in A.RISK_NAMES.items())}}}, {title})[1], 'Medium') AS riskLevel,
 CASE WHEN {blank('referenceLink')} THEN '{A.UNKNOWN_LINK}' WHEN regexp_matches({strip('referenceLink')}, '^https?://') THEN {strip('referenceLink')} ELSE 'https://' || {strip('referenceLink')} END AS referenceLink,
 0 AS affectsWhitelist, 0 AS isDelete FROM named"""


def _run_ts():
    return F.lit(RUN).cast("timestamp")


@query(_sql_clean("nvd", _RECORDS.sql))
def advisory_clean_rules(spark, sf_dir):
    return P.clean(_RECORDS.df(spark), "nvd", _run_ts())


@query(_sql_clean("avd", "(SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS vulnerabilityName, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'CVE-2024-' || page_id END AS cveId, regexp_replace(html, '<[^>]*>', ' ', 'g') AS description, CASE WHEN page_id % 2 = 0 THEN '2024-3-' || (page_id % 40) ELSE NULL END AS disclosureTime, CASE page_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low ' ELSE NULL END AS riskLevel, regexp_replace(url, '^https?://', '') AS referenceLink FROM pages)"))
def advisory_clean(spark, sf_dir):
    own = F.col("page_id")
    records = table(spark, sf_dir, "pages").select(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("vulnerabilityName"),
        F.when(own % 3 == 0, "").otherwise(F.concat(F.lit("CVE-2024-"), own)).alias("cveId"),
        F.regexp_replace("html", "<[^>]*>", " ").alias("description"),
        F.when(own % 2 == 0, F.concat(F.lit("2024-3-"), own % 40)).alias("disclosureTime"),
        F.when(own % 4 == 0, "CRITICAL").when(own % 4 == 1, "moderate").when(own % 4 == 2, "low ").alias("riskLevel"),
        F.regexp_replace("url", "^https?://", "").alias("referenceLink"),
    )
    return P.clean(records, "avd", _run_ts())


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 100 >= 7 THEN 'High' WHEN l_discount * 100 >= 4 THEN 'Medium' ELSE 'Low' END AS cvss,
 CASE WHEN contains(upper(o_orderpriority), 'HIGH') THEN 'High' WHEN contains(upper(o_orderpriority), 'LOW') THEN 'Low' ELSE 'Medium' END AS from_text,
 CASE WHEN substr(o_orderpriority, 3) ILIKE 'high' THEN 'High' WHEN substr(o_orderpriority, 3) ILIKE 'medium' THEN 'Medium' ELSE 'Low' END AS severity,
 CASE WHEN substr(o_orderpriority, 3) ILIKE 'high' THEN 'High' WHEN substr(o_orderpriority, 3) ILIKE 'low' THEN 'Low' ELSE 'Medium' END AS risk
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def advisory_risk_bucket(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    level = F.expr("substring(o_orderpriority, 3)")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", A.cvss_risk(F.col("l_discount") * 100).alias("cvss"), A.text_risk(F.col("o_orderpriority")).alias("from_text"), A.severity(level).alias("severity"), A.clean_risk(level).alias("risk"))


@query("""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, CASE WHEN length(text) > 20 AND len(words) >= 3 THEN array_to_string(words[1:8], ' ') ELSE 'DOC-' || doc_id END AS title FROM w)
SELECT doc_id, CASE WHEN length(title) > 80 THEN substr(title, 1, 77) || '...' ELSE title END AS title FROM t
""")
def advisory_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", A.title_of(F.col("text"), F.concat(F.lit("DOC-"), "doc_id")).alias("title"))


_IDS = Fixture("pos int, raw_id string, url string, title string", [
    (0, "GHSA-abcd-1234-ef56", "https://github.com/advisories/GHSA-abcd-1234-ef56", "RCE in x"),
    (1, "CVE-2021-44228", "https://github.com/advisories/GHSA-jfh8-c2jp-5v3q", "Log4Shell"),
    (2, " ", "https://github.com/advisories/x", "CVE-2020-1234 overflow"),
    (3, "OSV-1", "https://github.com/advisories/CVE-2019-9", "no id"),
    (4, "PYSEC-2", "https://github.com/advisories/y", "no id"),
])


@query(f"""
WITH f AS (SELECT pos, nullif(trim(raw_id), '') AS raw, url, title FROM {_IDS.sql}),
i AS (SELECT *, coalesce(nullif(regexp_extract(raw, '{A.GHSA}'), ''), nullif(regexp_extract(url, '{A.GHSA}'), ''), nullif(regexp_extract(raw, '{A.CVE}'), ''), nullif(regexp_extract(title, '{A.CVE}'), ''), nullif(regexp_extract(url, '{A.CVE}'), ''), raw) AS id FROM f)
SELECT pos, id, concat_ws('，', 'GitHub Security Advisory: ' || title, CASE WHEN id LIKE 'CVE%' THEN 'CVE编号：' || id END, CASE WHEN id LIKE 'GHSA%' THEN 'GHSA编号：' || id END, CASE WHEN raw <> id THEN '原始ID：' || raw END, '风险等级：High') AS description,
 coalesce(nullif(regexp_extract(title, '{A.CVE}'), ''), 'AVD-' || pos) AS from_title FROM i
""")
def advisory_ids(spark, sf_dir):
    rows = _IDS.df(spark).withColumn("id", A.advisory_id(F.col("raw_id"), F.col("url"), F.col("title")))
    return rows.select("pos", "id", A.advisory_description(F.col("title"), F.col("id"), F.col("raw_id"), F.lit("High")).alias("description"), A.title_cve(F.col("title"), F.concat(F.lit("AVD-"), "pos")).alias("from_title"))


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def advisory_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return relational.distinct_on(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


def _nvd(cve, text, score=None, old=None, lang="en"):
    metrics = ({"cvssMetricV31": [{"cvssData": {"baseScore": score}}]} if score is not None else {}) | ({"cvssMetricV3": [{"cvssData": {"baseScore": old}}]} if old is not None else {})
    return {"cve": {"id": cve, "published": "2024-04-03T10:22:33.000", "descriptions": [{"lang": "es", "value": "texto"}, {"lang": lang, "value": text}], "metrics": metrics}}


_NVD = Fixture("page int, body string", [
    (1, json.dumps({"vulnerabilities": [_nvd("CVE-2024-1", "The debug command in Sendmail is enabled", 9.8), _nvd("CVE-2024-2", "short", 6.9), _nvd("CVE-2024-3", "A very long description of a vulnerability in the extraordinarily complicated internationalisation subsystem", None, 4.0)]})),
    (2, json.dumps({"vulnerabilities": [_nvd("CVE-2024-4", "only spanish here", 3.9, lang="fr"), _nvd("CVE-2024-5", "two  blanks between these words here")]})),
    (3, json.dumps({"vulnerabilities": []})),
])


@query(f"""
WITH v AS (SELECT unnest(from_json(body::JSON->'vulnerabilities', '[{{"cve":{{"id":"VARCHAR","published":"VARCHAR","descriptions":[{{"lang":"VARCHAR","value":"VARCHAR"}}],"metrics":"JSON"}}}}]')).cve AS c FROM {_NVD.sql}),
d AS (SELECT c.id AS id, c.published AS published, coalesce(list_filter(c.descriptions, lambda x: x.lang = 'en')[1].value, '') AS said, coalesce((c.metrics->>'$.cvssMetricV31[0].cvssData.baseScore')::DOUBLE, (c.metrics->>'$.cvssMetricV3[0].cvssData.baseScore')::DOUBLE) AS score FROM v),
w AS (SELECT *, list_filter(regexp_split_to_array(said, '\\s+'), lambda x: x <> '') AS words FROM d),
t AS (SELECT *, CASE WHEN length(said) > 20 AND len(words) >= 3 THEN array_to_string(words[1:8], ' ') ELSE id END AS title FROM w)
SELECT CASE WHEN length(title) > 80 THEN substr(title, 1, 77) || '...' ELSE title END AS "vulnerabilityName", id AS "cveId", said AS description, substr(published, 1, 10) AS "disclosureTime",
 CASE WHEN score IS NULL THEN 'Medium' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' ELSE 'Low' END AS "riskLevel", 'https://nvd.nist.gov/vuln/detail/' || id AS "referenceLink", 0 AS "affectsWhitelist", 0 AS "isDelete" FROM t
""")
def nvd_json_flatten(spark, sf_dir):
    return P.nvd_advisories(_NVD.df(spark))


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(links) AS n_links, links[1] AS first_link
FROM (SELECT page_id, html, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages) WHERE len(links) >= 4
""")
def html_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("links"))
    return rows.where(F.size("links") >= 4).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size("links").alias("n_links"), F.get("links", F.lit(0)).alias("first_link"))


_GITHUB = Fixture("page int, body string", [
    (1, '<div class="Box-row"><a class="Link--primary v" href="/advisories/GHSA-jfh8-c2jp-5v3q">Log4Shell &amp; more</a><span class="text-bold">CVE-2021-44228</span><span class="Label">Critical</span><relative-time datetime="2021-12-10T00:40:56Z"></relative-time></div><div class="Box-row"><p>no title</p></div>'),
    (2, '<div class="Box-row"><a class="Link--primary" href="https://github.com/advisories/GHSA-jfh8-c2jp-5v3q">again</a></div><div class="Box-row"><a class="Link--primary" href="/advisories/z">Overflow CVE-2020-7</a><span class="Label">odd</span></div>'),
])

_GITHUB_OUT = [
    ("Log4Shell & more", "GHSA-jfh8-c2jp-5v3q", "GitHub Security Advisory: Log4Shell & more，GHSA编号：GHSA-jfh8-c2jp-5v3q，原始ID：CVE-2021-44228，风险等级：High", "2021-12-10", "High", "https://github.com/advisories/GHSA-jfh8-c2jp-5v3q"),
    ("Overflow CVE-2020-7", "CVE-2020-7", "GitHub Security Advisory: Overflow CVE-2020-7，CVE编号：CVE-2020-7，风险等级：Low", "", "Low", "https://github.com/advisories/z"),
]
_AVD = Fixture("page int, body string", [(1, '<table><tbody><tr><td><a href="/detail?id=AVD-2024-1">AVD-2024-1</a></td><td>某远程代码执行漏洞（CVE-2024-100）</td><td><button>RCE</button></td><td>2024-01-02</td></tr><tr><td><a href="/detail?id=AVD-2024-2">AVD-2024-2</a></td><td>拒绝服务</td><td></td><td>2024-01-03</td></tr><tr><td>no link</td><td>x</td><td></td><td></td></tr><tr><td><a href="/q">q</a></td></tr></tbody></table>')])
_AVD_OUT = [
    ("某远程代码执行漏洞（CVE-2024-100）", "CVE-2024-100", "阿里云漏洞库收录的RCE类型漏洞，CVE编号：CVE-2024-100，漏洞名称：某远程代码执行漏洞（CVE-2024-100）", "2024-01-02", "High", "https://avd.aliyun.com/detail?id=AVD-2024-1"),
    ("拒绝服务", "AVD-2024-2", "阿里云漏洞库收录的未定义类型漏洞，漏洞名称：拒绝服务", "2024-01-03", "Low", "https://avd.aliyun.com/detail?id=AVD-2024-2"),
]


def _expected(rows) -> str:
    out = Fixture('"vulnerabilityName" string, "cveId" string, "description" string, "disclosureTime" string, "riskLevel" string, "referenceLink" string', rows)
    return f'SELECT *, 0 AS "affectsWhitelist", 0 AS "isDelete" FROM {out.sql}'


@query(_expected(_GITHUB_OUT))
def github_rows(spark, sf_dir):
    """Held against the expected records: SQL has no HTML parser."""
    return P.github_advisories(_GITHUB.df(spark))


@query(_expected(_AVD_OUT))
def avd_rows(spark, sf_dir):
    return P.avd_advisories(_AVD.df(spark))


_DATES = Fixture("pos int, text string", [(0, "April 03, 2024; 10:22:33 AM +00:00"), (1, "April 03, 2024 10:22:33 PM +08:00"), (2, "May 5, 2023"), (3, "2024-01-01"), (4, ""), (5, None)])


@query(f"""SELECT pos, coalesce(strftime(CASE WHEN regexp_full_match(text, '[A-Za-z]+ \\d+, \\d{{4}}(;? \\d+:\\d+:\\d+ [AP]M [+-]\\d\\d:\\d\\d)?') THEN try_strptime(regexp_extract(text, '^([A-Za-z]+ \\d+, \\d{{4}})', 1), '%B %d, %Y') END, '%Y-%m-%d'), 'Unknown') AS day FROM {_DATES.sql}""")
def advisory_dates(spark, sf_dir):
    return _DATES.df(spark).select("pos", A.parse_date(F.col("text")).alias("day"))


_NAMES = ["远程代码执行漏洞", "某提权问题", "信息泄漏", "拒绝服务攻击", "other"]


@query(f"SELECT n_nationkey, name, CASE WHEN regexp_matches(name, '{'|'.join(A.HIGH_WORDS)}') THEN 'High' WHEN regexp_matches(name, '{'|'.join(A.LOW_WORDS)}') THEN 'Low' ELSE 'Medium' END AS risk FROM nation, (SELECT unnest({literal(_NAMES)}) AS name)")
def keyword_risk(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _NAMES))).alias("name")).select("n_nationkey", "name", A.keyword_risk(F.col("name")).alias("risk"))

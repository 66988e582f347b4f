"""Columns of an advisory: identifiers, names, dates, risk, links, descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import drop_control, is_blank, shorten, strip

CVE, GHSA = r"CVE-\d{4}-\d+", r"GHSA(?:-[0-9a-z]{4}){3}"

#: Texts that stand in for missing fields.
UNKNOWN_NAME, UNKNOWN_LINK, UNDEFINED_TYPE = "未知漏洞", "https://example.com", "未定义"

#: Other names of the three risk levels.
RISK_NAMES = {"Critical": "High", "Moderate": "Medium", "Info": "Low", "Information": "Low", "Informational": "Low", "High": "High", "Medium": "Medium", "Low": "Low"}

#: Words in a vulnerability's name that tell its risk.
HIGH_WORDS, LOW_WORDS = ("远程代码执行", "代码执行", "命令执行", "提权"), ("信息泄漏", "信息披露", "拒绝服务")

#: Formats of a date, with zone or alone.
DATE_FORMATS = ("MMMM d, yyyy; h:m:s a XXX", "MMMM d, yyyy h:m:s a XXX", "MMMM d, yyyy")


def first_match(c: Column, pattern: str) -> Column:
    """The first match of a pattern, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def lookup(c: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[c]


def clean_name(name: Column, cve_id: Column, source: str) -> Column:
    made = F.when(F.coalesce(cve_id, F.lit("")) != "", F.concat(F.lit(f"{source.upper()} Vulnerability "), cve_id)).otherwise(f"{source.upper()} {UNKNOWN_NAME}")
    return F.when(is_blank(name), made).otherwise(drop_control(shorten(strip(name), 200)))


def clean_id(cve_id: Column, source: str, run_ts: Column) -> Column:
    """The trimmed id; a blank one becomes SOURCE-<time of the run>, which is given and not taken from the clock."""
    return F.when(is_blank(cve_id), F.concat(F.lit(f"{source.upper()}-"), F.date_format(run_ts, "yyyyMMddHHmmss"))).otherwise(strip(cve_id))


def clean_date(text: Column, run_ts: Column) -> Column:
    """The trimmed date as it was written if it is one (unpadded, too), else the day of the run."""
    own = strip(text)
    fine = own.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_date(own, "yyyy-M-d").isNotNull()
    return F.when(F.coalesce(fine, F.lit(False)), own).otherwise(F.date_format(run_ts, "yyyy-MM-dd"))


def clean_description(text: Column, name: Column, source: str) -> Column:
    return F.when(is_blank(text), F.concat(F.lit(f"{source.upper()}漏洞库收录的漏洞："), name)).otherwise(drop_control(shorten(strip(text), 1000)))


def clean_risk(risk: Column) -> Column:
    return F.coalesce(lookup(F.initcap(strip(risk)), RISK_NAMES), F.lit("Medium"))


def clean_link(link: Column) -> Column:
    own = strip(link)
    return F.when(is_blank(link), UNKNOWN_LINK).when(own.rlike("^https?://"), own).otherwise(F.concat(F.lit("https://"), own))


def severity(text: Column) -> Column:
    """As clean_risk, but an unknown level is low, and names of information levels are unknown."""
    known = {k: v for k, v in RISK_NAMES.items() if not k.startswith("Info")}
    return F.coalesce(lookup(F.initcap(strip(text)), known), F.lit("Low"))


def advisory_id(raw_id: Column, url: Column, title: Column) -> Column:
    """GHSA id of the id or link, CVE id of id, title or link, the raw id, or a hash of the link."""
    raw = F.nullif(strip(raw_id), F.lit(""))
    found = [first_match(raw, GHSA), first_match(url, GHSA), first_match(raw, CVE), first_match(title, CVE), first_match(url, CVE), raw]
    return F.coalesce(*found, F.concat(F.lit("GITHUB-"), F.xxhash64(url).cast("string")))


def advisory_description(title: Column, vuln_id: Column, raw_id: Column, level: Column) -> Column:
    raw = F.nullif(strip(raw_id), F.lit(""))
    return F.concat_ws(
        "，",
        F.concat(F.lit("GitHub Security Advisory: "), title),
        F.when(vuln_id.startswith("CVE"), F.concat(F.lit("CVE编号："), vuln_id)),
        F.when(vuln_id.startswith("GHSA"), F.concat(F.lit("GHSA编号："), vuln_id)),
        F.when(raw != vuln_id, F.concat(F.lit("原始ID："), raw)),
        F.concat(F.lit("风险等级："), level),
    )


def title_cve(title: Column, fallback_id: Column) -> Column:
    return F.coalesce(first_match(title, CVE), F.nullif(fallback_id, F.lit("")))


def keyword_risk(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("|".join(HIGH_WORDS)), "High").when(low.rlike("|".join(LOW_WORDS)), "Low").otherwise("Medium")


def cvss_risk(score: Column) -> Column:
    return F.when(score.isNull(), "Medium").when(score >= 7, "High").when(score >= 4, "Medium").otherwise("Low")


def text_risk(text: Column) -> Column:
    up = F.upper(text)
    return F.when(up.contains("HIGH"), "High").when(up.contains("LOW"), "Low").otherwise("Medium")


def title_of(description: Column, fallback_id: Column) -> Column:
    """The first eight words of a description of more than 20 characters and at least 3 words, else the id."""
    words = F.filter(F.split(description, r"\s+"), lambda w: w != "")
    long = F.coalesce((F.length(description) > 20) & (F.size(words) >= 3), F.lit(False))
    return F.when(long, shorten(F.array_join(F.slice(words, 1, 8), " "), 80)).otherwise(fallback_id)


def parse_date(text: Column) -> Column:
    """yyyy-MM-dd of the day as it was written, whatever its zone; `Unknown` if no format fits."""
    own = F.trim(text)
    day = F.regexp_extract(own, r"^([A-Za-z]+ \d{1,2}, \d{4})", 1)
    known = [F.when(F.try_to_timestamp(own, F.lit(f)).isNotNull(), F.try_to_date(day, "MMMM d, yyyy")) for f in DATE_FORMATS]
    return F.coalesce(F.date_format(F.coalesce(*known), "yyyy-MM-dd"), F.lit("Unknown"))


def text_or(c: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))

"""Rule-based matching of components with vulnerabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phrases import Strings
from .relational import cut, top_k

#: Other names of a package.
ALIASES = {
    "log4j2": ("log4j", "apache-log4j"), "slf4j": ("slg4j", "simple-logging-facade-for-java"), "spring": ("spring-framework", "spring-boot"),
    "pillow": ("pil", "image-library"), "pyyaml": ("yaml", "pyyaml"), "lodash": ("underscore.js",), "moment": ("momentjs",),
    "openssl": ("ssl", "tls", "boringssl", "libressl"), "curl": ("libcurl",), "sqlite": ("sqlite3",),
}

#: Words of a package's domain.
DOMAIN_WORDS = {
    "log4j": ("logging", "logger", "appender", "logback", "slf4j", "log level"), "logback": ("logging", "logger", "sl4fj", "appender"),
    "spring": ("spring", "framework", "mvc", "boot", "bean", "context", "annotation"), "django": ("django", "web", "framework", "orm", "template", "middleware"),
    "flask": ("flask", "micro", "framework", "route", "blueprint"), "express": ("express", "middleware", "route", "handler"),
    "mysql": ("database", "sql", "connector", "jdbc"), "postgresql": ("postgres", "database", "sql", "psycopg"),
    "openssl": ("ssl", "tls", "encryption", "crypto", "certificate", "handshake"), "bouncycastle": ("crypto", "encryption", "provider", "security"),
    "requests": ("http", "request", "urllib", "api", "client"), "httpx": ("http", "request", "async", "api"),
    "jackson": ("json", "serialization", "databind"), "gson": ("json", "serialization", "google"),
}

#: Packages of well-known vulnerabilities.
KNOWN = {
    "CVE-2021-44228": ("log4j", "log4j2", "apache:logging-log4j"), "CVE-2021-21330": ("commons-text", "apache:commons-text"),
    "CVE-2021-22119": ("spring", "spring-framework"), "CVE-2021-41773": ("apache", "httpd"),
}

#: Package names that count when a text holds them as a word.
COMMON = "log4j spring django flask express openssl mysql postgresql sqlite requests curl wget nginx apache tomcat jboss jetty".split()

#: Words that are no package.
NO_PACKAGE = "the and or a an in on at to for of is are was were be have has had do does did will would could should may might must can vulnerability issue cve attack allow affect version remote local denial service execution".split()

#: Patterns of things that advisory texts name.
PATTERNS = {
    "java_coordinate": r"(?i)([a-z0-9]+(?:\.[a-z0-9]+)*):([a-z0-9\-]+)",
    "maven_plugin": r"(?i)maven-([a-z0-9\-]+)-plugin",
    "python_package": r"(?i)\b([a-z0-9][\w\-]*)\b",
    "npm_scoped": r"(?i)@([a-z0-9\-]+)/([a-z0-9\-]+)",
    "version": r"\b(\d+\.\d+(?:\.\d+)?(?:[-.]?[a-zA-Z0-9]+)?)\b",
    "cve": r"(?i)CVE-(\d+-\d+)",
    "cvss": r"(?i)CVSS[:\s]+([0-9.]+)",
}


def mentions(text: Column, kind: str) -> Column:
    """All whole matches of a pattern, in order; letters and digits of all alphabets count as such."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERNS[kind]), F.lit(0))


def _array(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _map(table: dict) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), _array(v))))


def suspected(vulnerabilities: DataFrame) -> DataFrame:
    """(vuln_id, description) -> vuln_id, name, confidence: packages that the text or the id tells of.

    Each coordinate or scoped name adds 0.8; a common name as a word counts 0.8 (0.6 without an id); known ids give 1; 1 is the most.
    """
    vulnerabilities = vulnerabilities.select("vuln_id", F.coalesce("description", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    text, low = F.col("text"), F.col("low")
    seldom = lambda kind, mark: F.when(text.contains(mark), mentions(text, kind)).otherwise(_array(()))  # noqa: E731 - most texts lack the mark, so need no pattern
    one = lambda kind, value: lambda n: F.struct(n.alias("raw"), F.lit(kind).alias("kind"), F.lit(value).alias("c") if isinstance(value, float) else value.alias("c"))
    has_id = F.coalesce(F.col("vuln_id"), F.lit("")) != ""
    word = F.when(has_id, F.lit(0.8)).otherwise(F.lit(0.6))
    common = reduce(lambda a, b: a | b, (low.contains(w) for w in COMMON))
    spoken = F.when(common, F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b(" + "|".join(COMMON) + r")\b"), F.lit(1)))).otherwise(_array(()))
    known = F.coalesce(F.try_element_at(_map(KNOWN), F.coalesce("vuln_id", F.lit(""))), _array(()))
    found = F.concat(F.transform(seldom("java_coordinate", ":"), one("hit", 0.8)), F.transform(seldom("npm_scoped", "@"), one("hit", 0.8)), F.transform(known, one("known", 1.0)), F.transform(spoken, one("word", word)))
    long = vulnerabilities.select("vuln_id", F.explode(found).alias("f")).select("vuln_id", "f.*")
    named = long.groupBy("vuln_id", "raw").agg(F.sum(F.when(F.col("kind") == "hit", F.col("c"))).alias("hits"), F.max(F.when(F.col("kind") != "hit", F.col("c"))).alias("most"))
    fine = (F.length("raw") > 2) & ~F.lower("raw").isin(NO_PACKAGE)
    return named.where(fine).groupBy("vuln_id", F.lower("raw").alias("name")).agg(F.round(F.least(F.lit(1.0), F.max(F.greatest("hits", "most"))), 9).alias("confidence"))


def similarity(name: Column, version: Column, title: Column, description: Column) -> Column:
    """struct<score, features>: the weighted mean of those features that are present, 1 at most."""
    return similarity_of_lower(F.lower(name), version, F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))), F.lower(F.coalesce(description, F.lit(""))))


def similarity_of_lower(name: Column, version: Column, text: Column, low: Column) -> Column:
    """The same from lower-case texts: title and description, and the description alone, which are better made once a text than once a pair."""
    return _weigh(name, version, lambda w: text.contains(w), low.contains(version))


def _weigh(name: Column, version: Column, has: Callable[[Column], Column], has_version: Column) -> Column:
    """The same from tests: whether the text has a word, and the description the version."""
    part = lambda label, score, weight: F.struct(F.lit(label).alias("feature"), score.cast("double").alias("score"), F.lit(weight).alias("weight"))
    parts = F.filter(F.split(name, r"[:\-/_.]"), lambda p: F.length(p) > 2)
    share = lambda words: F.size(F.filter(words, has)) / F.size(words)
    words = F.coalesce(F.try_element_at(_map(DOMAIN_WORDS), name), _array(()))
    aliases = F.coalesce(F.try_element_at(_map(ALIASES), name), _array(()))
    features = F.array_compact(
        F.array(
            F.when(has(name), part("exact_match", F.lit(1.0), 0.4)),
            F.when(F.size(parts) > 0, part("partial_match", share(parts), 0.3)),
            F.when((F.coalesce(version, F.lit("")) != "") & has_version, part("version_match", F.lit(0.7), 0.2)),
            F.when(F.size(words) > 0, part("domain_keywords", share(words), 0.2)),
            F.when(F.exists(aliases, has), part("alias_match", F.lit(0.6), 0.15)),
        )
    )
    total = lambda f: F.aggregate(features, F.lit(0.0), lambda s, x: s + f(x))
    score = F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(total(lambda x: x["score"] * x["weight"]), total(lambda x: x["weight"])), F.lit(0.0))), 9)
    return F.struct(score.alias("score"), F.array_join(F.transform(F.filter(features, lambda x: x["score"] > 0), lambda x: x["feature"]), ";").alias("reasoning"))


def held_words(texts: DataFrame, words: DataFrame, versions: DataFrame) -> DataFrame:
    """(vuln_id, body, low) -> vuln_id, words, versions: which of the words a body holds, and which of the versions a description.

    Words and versions are collected and go to each task; a text is read once and is not in what comes out.
    """
    asked = [sorted(r[0] for r in df.distinct().collect() if r[0]) for df in (words, versions)]
    found = [Strings(x) for x in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.array([[own[i] for i in ids] for ids in has.held(batch[c])], pa.list_(pa.string())) for own, has, c in zip(asked, found, ("body", "low"))]
            yield pa.RecordBatch.from_arrays([batch["vuln_id"], *lists], ["vuln_id", "words", "versions"])

    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return texts.select("vuln_id", "body", "low").mapInArrow(run, f"vuln_id {texts.schema['vuln_id'].dataType.simpleString()}, words array<string>, versions array<string>")


def match(components: DataFrame, vulnerabilities: DataFrame, *, all_hits: bool = False) -> DataFrame:
    """(comp_id, name, version) x (vuln_id, title, description) -> vuln_id, comp_id, similarity, match_type, confidence, reasoning.

    A component whose name begins with a suspected package, or the other way round, counts 0.95; all others count by their
    features if these reach more than 0.5 (high: more than 0.75). The best row of each pair is kept, or all (all_hits).

    Every rule needs a part of the component's name, a domain word or an alias in the text. So texts are searched once for the
    distinct words, components join by those that are found, and the rules ask the words found, not the text. No row is lost.
    """
    name = F.lower("name")
    keyed = components.where(F.coalesce(F.col("name"), F.lit("")) != "").select("comp_id", "name", "version")
    guess = cut(suspected(vulnerabilities))
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), 1, i)))
    short = keyed.select("comp_id", name.alias("key"))
    down = guess.join(short.select("comp_id", prefix.alias("p")), F.col("name") == F.col("p")).select("vuln_id", "comp_id", "name")
    up = guess.select("vuln_id", "name", F.col("name").alias("key")).select("vuln_id", "name", prefix.alias("p")).join(short, F.col("p") == F.col("key")).select("vuln_id", "comp_id", "name")
    hits = down.union(up).distinct().select("vuln_id", "comp_id", F.lit(0.95).alias("similarity"), F.lit("named_entity_extracted").alias("match_type"), F.lit(None).cast("string").alias("confidence"), F.lit("package name found in the description").alias("reasoning"))
    low = F.lower(F.coalesce("description", F.lit("")))
    texts = vulnerabilities.select("vuln_id", F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), low).alias("body"), low.alias("low"))
    words = F.array_distinct(F.concat(F.array(name), F.filter(F.split(name, r"[:\-/_.]"), lambda p: F.length(p) > 2), F.coalesce(F.try_element_at(_map(DOMAIN_WORDS), name), _array(())), F.coalesce(F.try_element_at(_map(ALIASES), name), _array(()))))
    rules = keyed.withColumn("word", F.explode(words))
    found = held_words(texts, rules.select("word"), keyed.select("version")).where(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id())
    met = cut(found).withColumn("word", F.explode("words")).join(rules, "word").dropDuplicates(["row", "comp_id"])
    scored = met.withColumn("s", _weigh(F.lower("name"), F.col("version"), lambda w: F.array_contains("words", w), F.array_contains("versions", F.col("version")))).where(F.col("s.score") > 0.5)
    alike = scored.select("vuln_id", "comp_id", F.col("s.score").alias("similarity"), F.lit("similarity_based").alias("match_type"), F.when(F.col("s.score") > 0.75, "high").otherwise("medium").alias("confidence"), F.col("s.reasoning").alias("reasoning"))
    both = hits.unionByName(alike)
    return both if all_hits else top_k(both, ["vuln_id", "comp_id"], [F.desc("similarity"), F.col("match_type")], 1).drop("rank")

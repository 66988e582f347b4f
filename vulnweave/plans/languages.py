"""Queries: language detection over listings: a fixture, and parts of the star tables as files for volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lang, relational
from .registry import Fixture, literal, query, table

_LISTING = Fixture("project string, rel_dir string, file string, seq long", [
    ("mixed", "", "pom.xml", 0), ("mixed", "", "package.json", 1), ("mixed", "src/main/java", "A.java", 2), ("native", "", "CMakeLists.txt", 0),
    *(("rubyish", "lib", f"f{i}.rb", i) for i in range(5)), *(("ruby4", "", f"f{i}.rb", i) for i in range(4)), ("web", "", "package.json", 0),
    *(("web", "src", f"a{i}.js", 1 + i) for i in range(30)), *(("web", "src", f"b{i}.ts", 40 + i) for i in range(5)), ("hidden", "node_modules/a", "package.json", 0), ("dots", "", ".npmrc", 0), ("dots", "app/Pods", "x.swift", 1),
])

_FILES = ["pom.xml", "A.java", "B.py", "setup.py", "go.mod", "x.go", "package.json", "i.ts", "j.js", "Gemfile", "k.rb", "Cargo.toml", "m.rs", "composer.json", "n.php", "CMakeLists.txt", "o.c", "p.h", "rebar.config", "README"]
_DIRS = ["", "src", "src/main/java", "lib/vendor", "app/wp-content", "project", "src/bin", "node_modules/x", "ebin"]

_LISTING_SQL = f"""(SELECT * FROM {_LISTING.sql} UNION ALL SELECT 'p' || p_brand || '-' || p_size AS project, {literal(_DIRS)}[CAST(p_partkey % {len(_DIRS)} AS INTEGER) + 1] AS rel_dir, {literal(_FILES)}[CAST((p_partkey * 7 + p_size) % {len(_FILES)} AS INTEGER) + 1] AS file, p_partkey AS seq FROM part)"""


def _listing(spark, sf_dir):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    part = table(spark, sf_dir, "part")
    volume = part.select(F.concat(F.lit("p"), "p_brand", F.lit("-"), "p_size").alias("project"), pick(_DIRS, F.col("p_partkey")).alias("rel_dir"), pick(_FILES, F.col("p_partkey") * 7 + F.col("p_size")).alias("file"), F.col("p_partkey").alias("seq"))
    return _LISTING.df(spark).unionByName(volume)


def _sigs(full: bool) -> str:
    rows = [(i, r[0], r[1], r[2], r[3].split(), *([r[4].split(), r[5].split()] if full else [[""], [""]])) for i, r in enumerate(lang.FULL if full else lang.BASIC)]
    return Fixture("ord int, language string, package_manager string, priority int, sig_files array, source_exts array, dir_patterns array", rows).sql


def _own(skip: list[str]) -> str:
    return f"own AS (SELECT * FROM {_LISTING_SQL} WHERE NOT list_has_any(string_split(rel_dir, '/'), {literal(skip)}))"


_BASIC_SQL = f"""
WITH {_own(lang.BASIC_SKIP)}, sigs AS {_sigs(False)},
hits AS (SELECT project, language, package_manager, priority, ord, CASE WHEN rel_dir = '' THEN file ELSE rel_dir || '/' || file END AS path, seq FROM own JOIN (SELECT *, unnest(sig_files) AS sig FROM sigs) ON file = sig),
found AS (SELECT project, language, package_manager, priority, ord, list_sort(list_distinct(list(path))) AS files, min(seq) AS seen FROM hits GROUP BY ALL)
"""


@query(f"{_BASIC_SQL} SELECT project, language, package_manager, priority, files, CAST(row_number() OVER (PARTITION BY project ORDER BY priority, seen, ord) AS INTEGER) AS place FROM found")
def lang_detect_basic(spark, sf_dir):
    return lang.detect_basic(_listing(spark, sf_dir))


@query(f"{_BASIC_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY priority, seen, ord) AS place FROM found) SELECT project, list(language ORDER BY place) AS languages, string_agg(language || ' (' || package_manager || ')', ', ' ORDER BY place) AS text FROM placed GROUP BY project")
def lang_summary(spark, sf_dir):
    return lang.summary(lang.detect_basic(_listing(spark, sf_dir)))


_FULL_SQL = f"""
WITH {_own(lang.FULL_SKIP)}, sigs AS {_sigs(True)},
hits AS (SELECT project, language, count(DISTINCT CASE WHEN rel_dir = '' THEN file ELSE rel_dir || '/' || file END) AS feature_files, min(seq) AS seen FROM own JOIN (SELECT language, unnest(sig_files) AS sig FROM sigs) ON file = sig GROUP BY ALL),
exts AS (SELECT project, ext, count(*) AS n FROM (SELECT project, lower(regexp_extract(file, '^.+(\\.[^./]+)$', 1)) AS ext FROM own) WHERE ext <> '' GROUP BY ALL),
src AS (SELECT project, language, min(n) AS least, max(n) AS most FROM exts JOIN (SELECT language, unnest(source_exts) AS ext FROM sigs) USING (ext) GROUP BY ALL),
dirs AS (SELECT DISTINCT project, array_to_string(parts[1:i], '/') AS dir FROM (SELECT project, string_split(rel_dir, '/') AS parts, unnest(range(1, len(string_split(rel_dir, '/')) + 1)) AS i FROM own WHERE rel_dir <> '')),
pat AS (SELECT project, language, sum(CAST(string_split(dir, '/')[-1] = pattern AS INTEGER) + CAST(contains(dir, pattern) AS INTEGER)) AS patterns FROM dirs JOIN (SELECT language, unnest(dir_patterns) AS pattern FROM sigs) ON contains(dir, pattern) GROUP BY ALL),
j AS (SELECT project, language, feature_files, seen, least, most, coalesce(patterns, 0) AS patterns FROM hits FULL JOIN src USING (project, language) LEFT JOIN pat USING (project, language) WHERE feature_files IS NOT NULL OR most >= 5),
d AS (SELECT project, j.language, package_manager, priority + CASE WHEN feature_files IS NULL THEN 1 ELSE 0 END AS priority, CASE WHEN feature_files IS NULL THEN 'medium' ELSE 'high' END AS confidence, coalesce(feature_files, 0) AS feature_files, coalesce(least, 0) AS source_file_count, CASE WHEN feature_files IS NULL THEN patterns ELSE 0 END AS matched_patterns, ord, CASE WHEN feature_files IS NULL THEN 1099511627776 ELSE seen END AS seen FROM j JOIN sigs USING (language)),
s AS (SELECT *, 100 * feature_files + 5 * source_file_count + 50 * matched_patterns + CASE confidence WHEN 'high' THEN 500 ELSE 200 END AS score FROM d),
p AS (SELECT *, score + 50 * (10 - priority) AS primary_score FROM s)
SELECT project, language, package_manager, CAST(priority AS INTEGER) AS priority, confidence, CAST(feature_files AS INTEGER) AS feature_files, CAST(source_file_count AS INTEGER) AS source_file_count, CAST(matched_patterns AS INTEGER) AS matched_patterns, CAST(score AS INTEGER) AS score, CAST(primary_score AS INTEGER) AS primary_score,
 CAST(row_number() OVER (PARTITION BY project ORDER BY score DESC, seen, ord) AS INTEGER) AS place, row_number() OVER (PARTITION BY project ORDER BY primary_score DESC, seen, ord) = 1 AS is_primary FROM p
"""


@query(_FULL_SQL)
def lang_detect_optimised(spark, sf_dir):
    return lang.detect_full(_listing(spark, sf_dir))


@query(f"""SELECT project, CASE WHEN language IN ('java', 'python', 'go', 'c') THEN language ELSE 'other' END AS language, CASE WHEN score >= 500 THEN 'high' WHEN score >= 200 THEN 'medium' ELSE 'low' END AS confidence FROM ({_FULL_SQL}) WHERE is_primary""")
def lang_primary_api(spark, sf_dir):
    found = lang.detect_full(_listing(spark, sf_dir)).where("is_primary")
    return found.select("project", lang.supported(F.col("language"), ["java", "python", "go", "c"]).alias("language"), lang.api_confidence(F.col("score")).alias("confidence"))


@query(f"{_BASIC_SQL} SELECT a.project, a.language, coalesce(f.package_manager, 'unknown') AS package_manager FROM (SELECT DISTINCT project, unnest(['java', 'php']) AS language FROM {_LISTING_SQL}) a LEFT JOIN found f ON a.project = f.project AND a.language = f.language")
def lang_package_manager(spark, sf_dir):
    listing = _listing(spark, sf_dir)
    asked = listing.select("project").distinct().withColumn("language", F.explode(F.array(F.lit("java"), F.lit("php"))))
    return lang.package_manager(lang.detect_basic(listing), asked)


@query(f"WITH {_own(lang.FULL_SKIP)} SELECT project, ext, count(*) AS n, max(CASE WHEN rel_dir = '' THEN 0 ELSE len(string_split(rel_dir, '/')) END) AS depth FROM (SELECT *, lower(regexp_extract(file, '^.+(\\.[^./]+)$', 1)) AS ext FROM own) WHERE ext <> '' GROUP BY project, ext")
def source_extensions(spark, sf_dir):
    own = lang.prune(_listing(spark, sf_dir), lang.FULL_SKIP).withColumn("ext", lang.extension(F.col("file"))).where("ext <> ''")
    depth = F.when(F.col("rel_dir") == "", 0).otherwise(F.size(F.split("rel_dir", "/")))
    return own.groupBy("project", "ext").agg(F.count(F.lit(1)).alias("n"), F.max(depth).cast("long").alias("depth"))


@query(f"SELECT project, rel_dir, file, seq FROM (SELECT *, row_number() OVER (PARTITION BY project, rel_dir ORDER BY list_position({literal(_FILES)}, file), seq) AS r FROM {_LISTING_SQL} WHERE list_contains({literal(_FILES)}, file)) WHERE r = 1")
def precedence_first(spark, sf_dir):
    order = F.array_position(F.array(*map(F.lit, _FILES)), F.col("file"))
    return relational.top_k(_listing(spark, sf_dir).where(order > 0), ["project", "rel_dir"], [order, F.col("seq")], 1).select("project", "rel_dir", "file", "seq")

"""Queries: similarities, fuzzy joins against a white list, label matching, the rule matcher, filtered predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import STOP_WORDS
from ..operators import evaluate, match, rules
from .registry import Fixture, literal, query, table
from ..operators import relational as R


def _names(spark, sf_dir):
    """Each supplier's two cheapest parts as candidates; brands and types with colours as the white list."""
    met = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return R.top_k(met, ["l_suppkey"], [F.col("p_partkey")], 2, "place").select(F.col("l_suppkey").alias("id"), "place", F.col("p_name").alias("name"))


_WHITE = ["red widget", "blue bolt", "small ring", "green gear", "large valve", "red bolt", "steel ring", "blue widgets", "gear", "the bolt", "widget red", "", "brass nut"]
_CANDIDATES_SQL = """
met AS (SELECT DISTINCT l_suppkey, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
cand AS (SELECT l_suppkey AS id, place, p_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_partkey) AS place FROM met) WHERE place <= 2)
"""


def _white(spark):
    return spark.createDataFrame(list(enumerate(_WHITE)), "pos int, entry string")


def _white_sql() -> str:
    return Fixture("pos int, entry string", list(enumerate(_WHITE))).sql


def _tokens(c: str, stop: bool) -> str:
    words = f"regexp_extract_all(lower({c}), '\\w\\w+')"
    return f"list_filter({words}, lambda w: NOT list_contains({literal(list(STOP_WORDS))}, w))" if stop else words


def _cosine(a: str, b: str, stop: bool, unshared: float) -> str:
    """SQL of the cosine of two texts: tokens are bound first."""
    count = lambda words, w: f"len(list_filter({words}, lambda x: x = {w}))::DOUBLE"
    square = lambda own, other: f"list_sum(list_transform(list_distinct({own}), lambda w: ({count(own, 'w')} * CASE WHEN list_contains({other}, w) THEN 1.0::DOUBLE ELSE {unshared!r}::DOUBLE END) ** 2))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda w: {count(a, 'w')} * {count(b, 'w')})), 0) / sqrt({square(a, b)} * {square(b, a)}) END"


SIM_SQL = {
    "lev": "CASE WHEN greatest(length(name), length(entry)) = 0 THEN 1 ELSE 1 - levenshtein(name, entry)::DOUBLE / greatest(length(name), length(entry)) END",
    "cos": _cosine("a1", "b1", True, 1.4054651081081644),
    "sco": _cosine("a0", "b0", False, 1.0),
    "lcs": "CASE WHEN length(name) + length(entry) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(list_max(flatten(list_transform(range(1, length(name) + 1), lambda i: list_transform(range(i, length(name) + 1), lambda j: CASE WHEN contains(entry, substr(name, i, j - i + 1)) THEN j - i + 1 ELSE 0 END)))), 0) / (length(name) + length(entry)) END",
}


def _pairs_sql(kind: str, least: float) -> str:
    return f"""
WITH {_CANDIDATES_SQL}, names AS (SELECT DISTINCT name FROM cand WHERE name IS NOT NULL),
words AS (SELECT name, pos, entry, {_tokens('name', False)} AS a0, {_tokens('entry', False)} AS b0, {_tokens('name', True)} AS a1, {_tokens('entry', True)} AS b1 FROM names CROSS JOIN {_white_sql()}),
pairs AS (SELECT * FROM (SELECT name, pos, entry, round({SIM_SQL[kind]}, 9) AS sim FROM words) WHERE sim >= {least})
"""


def _triple_sql(kind: str, least: float) -> str:
    slot = lambda p, r: f"coalesce(max(CASE WHEN place = {p} AND r = {r} THEN entry END), '')"
    return f"""{_pairs_sql(kind, least)},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sim DESC, pos) AS r FROM pairs) WHERE r <= 3),
slots AS (SELECT id, {slot(1, 1)} AS a0, {slot(2, 1)} AS b0, {slot(1, 2)} AS a1 FROM cand LEFT JOIN best USING (name) GROUP BY id),
once AS (SELECT id, list_filter([a0, b0, a1], lambda x, i: list_position([a0, b0, a1], x) = i) AS l FROM slots)
SELECT id, array_to_string((l || ['', '', ''])[1:3], ';') AS triple FROM once"""


def _add(name: str, kind: str, least: float) -> None:
    query(_triple_sql(kind, least), f"whitelist_{name}")(lambda spark, sf_dir: match.white_list_match(_names(spark, sf_dir), _white(spark), kind, least))
    query(f"{_pairs_sql(kind, least)} SELECT name, pos, entry, sim FROM pairs", f"fuzzy_pairs_{name}")(lambda spark, sf_dir: match.fuzzy_pairs(_names(spark, sf_dir), _white(spark), kind, least))


_add("lev", "lev", 0.5)
_add("cos", "cos", 0.3)
_add("countcos", "sco", 0.3)
_add("lcs", "lcs", 0.5)


@query(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, round({SIM_SQL['lev'].replace('name', 'a.n_name').replace('a.n_a.n_name', 'a.n_name').replace('entry', 'b.n_name')}, 9) AS lev FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def similarity_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(x), F.col("n_name").alias(f"{x}_name"), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").select("a", "b", F.round(S.levenshtein_similarity(F.col("a_name"), F.col("b_name")), 9).alias("lev"))


_EDITS = Fixture("q string, t string, distance int, sim double", [("kitten", "sitting", 5, 0.583333333), ("guava", "guava", 0, 1.0), ("abc", "", 6, 0.0), ("", "ab", 2, None), ("a", "xyz", 4, -1.0), ("flaw", "lawn", 3, 0.625)])


@query(f"SELECT n_nationkey, q, t, distance, sim FROM nation CROSS JOIN {_EDITS.sql}")
def edit_distance_weighted(spark, sf_dir):
    """Insert 1, delete 2, substitute 2; held against distances by hand, as SQL has no such function."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(_EDITS.df(spark).select("q", "t")))
    return rows.select("n_nationkey", "q", "t", S.weighted_distance(F.col("q"), F.col("t")).alias("distance"), F.round(S.weighted_similarity(F.col("q"), F.col("t")), 9).alias("sim"))


_COORDS = Fixture("name string", [("org.apache.logging.log4j:log4j-core",), ("org.apache.logging.log4j:log4j-api",), ("com.google.guava:guava",), ("com.google.code:guava",), ("org.json:json",), ("net.minidev:json-smart",)])
_LABELS = Fixture("id int, label string", [(0, "org.json:json"), (1, "com.google.guavas:guava"), (2, "org.apache.logging:log4j-cores"), (3, "x:nothing-like-it"), (4, None), (5, ""), (6, "zzz:json")])
_LABELS_OUT = Fixture("id int, triple string", [(0, "org.json:json;;"), (1, "com.google.guava:guava;com.google.code:guava;"), (2, "org.apache.logging.log4j:log4j-core;;"), (3, ";;"), (4, ";;"), (5, ";;"), (6, ";;")])


@query(f"SELECT id, triple FROM {_LABELS_OUT.sql}")
def maven_label_match(spark, sf_dir):
    """Held against results by hand: the weighted distance is no SQL function."""
    return match.label_match(_LABELS.df(spark), _COORDS.df(spark), 0.6)


_VULNS = Fixture("vuln_id string, title string, description string", [
    ("CVE-2021-44228", "Apache Log4j2 JNDI", "Apache Log4j2 2.14.0 JNDI features do not protect against attacker controlled LDAP; see org.apache:log4j-core and @angular/core"),
    ("CVE-2020-1", "Django template", "The web framework django before 3.0 has a template injection in its middleware"),
    ("", "t", "curl and OpenSSL with tls handshake issue; the:and"), ("CVE-2021-21330", "Text", None),
])
_COMPONENTS = Fixture("comp_id int, name string, version string", [(0, "log4j", "2.14.0"), (1, "django", "3.0"), (2, "openssl", None), (3, "commons-text", "1.9"), (4, "left-pad", "1"), (5, "Curl", "8"), (6, "spring", ""), (7, "", "1"), (8, "ssl-tls", "2")])


def _list_map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{literal(k)}: {literal(list(v))}" for k, v in d.items()) + "}"


def _suspected_sql(vulns: str) -> str:
    hit = lambda kind: f"SELECT vuln_id, unnest(regexp_extract_all(d, {literal(rules.PATTERNS[kind])})) AS raw, 0.8::DOUBLE AS h, NULL::DOUBLE AS m FROM v"
    return f"""
v AS (SELECT vuln_id, title, coalesce(description, '') AS d FROM {vulns}),
f AS ({hit('java_coordinate')} UNION ALL {hit('npm_scoped')}
 UNION ALL SELECT vuln_id, unnest(coalesce(map_extract({_list_map(rules.KNOWN)}, vuln_id)[1], [])), NULL, 1.0 FROM v
 UNION ALL SELECT vuln_id, p, NULL, CASE WHEN vuln_id <> '' THEN 0.8 ELSE 0.6 END FROM v CROSS JOIN (SELECT unnest({literal(rules.COMMON)}) AS p) WHERE regexp_matches(lower(d), '\\b' || p || '\\b')),
g AS (SELECT vuln_id, raw, sum(h) AS h, max(m) AS m FROM f GROUP BY vuln_id, raw),
guess AS (SELECT vuln_id, lower(raw) AS name, round(least(1.0::DOUBLE, max(greatest(h, m))), 9) AS confidence FROM g WHERE length(raw) > 2 AND NOT list_contains({literal(rules.NO_PACKAGE)}, lower(raw)) GROUP BY vuln_id, lower(raw))
"""


_DOCS = "(SELECT 'CVE-2021-' || doc_id AS vuln_id, source AS title, text || ' Affects ' || p_name || '.' AS description FROM documents LEFT JOIN part ON p_partkey = doc_id % 200 + 1)"
_PARTS = "(SELECT p_partkey AS comp_id, p_name AS name, p_brand AS version FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1)"


@query(f"WITH {_suspected_sql(_VULNS.sql)} SELECT vuln_id, name, confidence FROM guess")
def suspected_packages(spark, sf_dir):
    return rules.suspected(_VULNS.df(spark))


def _match_sql(components: str, vulns: str) -> str:
    share = lambda words: f"len(list_filter({words}, lambda w: contains(body, w)))::DOUBLE / len({words})"
    feature = lambda label, when, score, weight: f"CASE WHEN {when} THEN {{'f': '{label}', 's': ({score})::DOUBLE, 'w': {weight}::DOUBLE}} END"
    return f"""
WITH {_suspected_sql(vulns)},
c AS (SELECT comp_id, lower(name) AS name, version, list_filter(regexp_split_to_array(lower(name), '[:\\-/_.]'), lambda p: length(p) > 2) AS parts, coalesce(map_extract({_list_map(rules.DOMAIN_WORDS)}, lower(name))[1], []) AS words, coalesce(map_extract({_list_map(rules.ALIASES)}, lower(name))[1], []) AS aliases FROM {components} WHERE coalesce(name, '') <> ''),
m AS (SELECT vuln_id, comp_id, lower(coalesce(title, '') || ' ' || d) AS body, lower(d) AS low, c.* EXCLUDE (comp_id) FROM v CROSS JOIN c),
x AS (SELECT vuln_id, comp_id, list_filter([{feature('exact_match', 'contains(body, name)', '1', 0.4)}, {feature('partial_match', 'len(parts) > 0', share('parts'), 0.3)}, {feature('version_match', "coalesce(version, '') <> '' AND contains(low, version)", '0.7', 0.2)}, {feature('domain_keywords', 'len(words) > 0', share('words'), 0.2)}, {feature('alias_match', 'len(list_filter(aliases, lambda a: contains(body, a))) > 0', '0.6', 0.15)}], lambda z: z IS NOT NULL) AS fs FROM m),
s AS (SELECT vuln_id, comp_id, round(least(1.0::DOUBLE, coalesce(list_sum(list_transform(fs, lambda z: z.s * z.w)) / list_sum(list_transform(fs, lambda z: z.w)), 0)), 9) AS similarity, array_to_string(list_transform(list_filter(fs, lambda z: z.s > 0), lambda z: z.f), ';') AS reasoning FROM x),
e AS (SELECT vuln_id, comp_id, similarity, 'similarity_based' AS match_type, CASE WHEN similarity > 0.75 THEN 'high' ELSE 'medium' END AS confidence, reasoning FROM s WHERE similarity > 0.5
 UNION ALL SELECT DISTINCT vuln_id, comp_id, 0.95::DOUBLE, 'named_entity_extracted', NULL, 'package name found in the description' FROM c JOIN guess ON starts_with(c.name, guess.name) OR starts_with(guess.name, c.name))
SELECT vuln_id, comp_id, similarity, match_type, confidence, reasoning FROM (SELECT *, row_number() OVER (PARTITION BY vuln_id, comp_id ORDER BY similarity DESC, match_type) AS r FROM e) WHERE r = 1"""


@query(_match_sql(_COMPONENTS.sql, _VULNS.sql))
def rule_match_rules(spark, sf_dir):
    return rules.match(_COMPONENTS.df(spark), _VULNS.df(spark))


@query(_match_sql(_PARTS, _DOCS))
def rule_match(spark, sf_dir):
    """Parts as components, documents as vulnerabilities; each text ends with the name of a part that it affects."""
    part = table(spark, sf_dir, "part")
    affected = F.broadcast(part.where(F.col("p_partkey").between(-198, 200)).select("p_partkey", F.col("p_name").alias("affected")))  # all that the join can ask for
    docs = table(spark, sf_dir, "documents").join(affected, F.col("p_partkey") == F.col("doc_id") % 200 + 1, "left")
    docs = docs.select(F.concat(F.lit("CVE-2021-"), "doc_id").alias("vuln_id"), F.col("source").alias("title"), F.concat("text", F.lit(" Affects "), "affected", F.lit(".")).alias("description"))
    parts = R.distinct_on(part.select("p_name", "p_partkey", "p_brand"), ["p_name"], [F.col("p_partkey")])
    return rules.match(parts.select(F.col("p_partkey").alias("comp_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("version")), docs)


@query(None)
def entity_mentions(spark, sf_dir):
    """Over whole texts; held against Python's patterns by a test, since word characters differ in the SQL engine."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", rules.mentions(F.col("text"), "version").alias("versions"), F.size(rules.mentions(F.col("text"), "python_package")).cast("long").alias("n"))


def _lists(spark, sf_dir):
    """Each supplier's part names as predictions, those of its returned items as actual labels."""
    met = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    names = lambda c: F.array_sort(F.collect_set(c))
    return met.groupBy(F.col("l_suppkey").alias("id")).agg(names("p_name").alias("predicts"), names(F.when(F.col("l_returnflag") == "R", F.concat("p_name", F.lit("s")))).alias("actuals"))


_LISTS_SQL = "lists AS (SELECT l_suppkey AS id, list_sort(list_distinct(list(p_name))) AS predicts, list_sort(coalesce(list_distinct(list(p_name || 's') FILTER (WHERE l_returnflag = 'R')), [])) AS actuals FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)"
_NEAR = "len(list_filter(actuals, lambda a: 1 - levenshtein(p, a)::DOUBLE / greatest(length(p), length(a)) >= {t})) > 0"


@query(f"WITH {_LISTS_SQL} SELECT id, list_transform(predicts, lambda p: CASE WHEN {_NEAR.format(t=0.9)} THEN p ELSE '' END) AS kept FROM lists")
def predictions_exists(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", evaluate.filter_predictions(F.col("predicts"), F.col("actuals"), 0.9).alias("kept"))


@query(f"WITH {_LISTS_SQL}, t AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS threshold) SELECT threshold, id, list_transform(predicts, lambda p: CASE WHEN {_NEAR.format(t='threshold')} THEN p ELSE '' END) AS kept FROM lists CROSS JOIN t")
def threshold_sweep(spark, sf_dir):
    return evaluate.sweep(_lists(spark, sf_dir), [0.3, 0.5, 0.7])


@query()
def blank_exact_hits(spark, sf_dir):
    """Rows chosen by a hash: no SQL."""
    rows = _lists(spark, sf_dir).select("id", "predicts", F.col("predicts").alias("actuals"))
    return evaluate.blank_exact_hits(rows, 0.5)


@query("SELECT l_orderkey, l_linenumber, p_name AS label FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IN (SELECT p_name FROM part WHERE p_size < 5)")
def in_corpus(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part.select("p_partkey", F.col("p_name").alias("label")), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "label")
    return evaluate.in_corpus(rows, part.where("p_size < 5"), "label", "p_name").select("l_orderkey", "l_linenumber", "label")

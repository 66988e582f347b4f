"""Queries: dependencies from manifests, version constraints, requirement specs. Bodies are fixtures, read for every nation's project."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import version as V
from ..operators import manifest as M
from .registry import Fixture, literal, query, table

#: Format -> (bodies, SQL of a list of {name, version} over `body`, or the expected rows).
NL = "chr(10)"


def _pairs(names: str, versions: str) -> str:
    return f"list_transform(list_zip({names}, {versions}), lambda z: {{'name': z[1], 'version': nullif(z[2], '')}})"


def _all(text: str, pattern: str) -> str:
    p = literal(pattern)
    return _pairs(f"regexp_extract_all({text}, {p}, 1)", f"regexp_extract_all({text}, {p}, 2)")


def _lines(text: str, name: str, version: str, trim: str = "") -> str:
    own = f"regexp_extract(s, {literal(version)}, 1)"
    own = f"ltrim({own}, {literal(trim)})" if trim else own
    return f"list_filter(list_transform(string_split({text}, {NL}), lambda s: {{'name': regexp_extract(s, {literal(name)}, 1), 'version': nullif({own}, '')}}), lambda d: d.name <> '')"


def _section(header: str) -> str:
    return f"regexp_extract({NL} || body || {NL} || '[', '(?s)\\n\\[{header}\\][^\\n]*\\n(.*?)\\n?[ \\t]*\\[(?:\\w|$)', 1)"


def _json(field: str, value: str, keep: str = "true", name: str = "k") -> str:
    entry = f"json_extract(body, '$.{field}')"
    path = "'$.\"' || k || '\"" + ("." + value if value else "") + "'"
    return f"list_transform(list_filter(json_keys({entry}), lambda k: {keep}), lambda k: {{'name': {name}, 'version': json_extract_string({entry}, {path})}})"


def _mapped(items: str, version: str) -> str:
    return f"list_transform(coalesce({items}, []), lambda d: {{'name': d.name, 'version': nullif({version}, '')}})"


_STAR = "CASE WHEN d.version = '*' THEN '' ELSE d.version END"

FIXTURES: dict[str, tuple[list[str], str | None]] = {
    "go_mod": (
        ["module m\n\nrequire (\n\ta.b/c v1.0.0\n\td.e/f v2.0.0 // indirect\n\t// note here\n)\nrequire g.h/i v3.0.0\n", "module x\n"],
        "list_concat("
        + _lines(f"array_to_string(regexp_extract_all({NL} || body, '(?s)\\n[ \\t]*require[ \\t]*\\((.*?)\\n[ \\t]*\\)', 1), {NL})", r"^\s*([^\s/]\S*)\s+\S+", r"^\s*\S+\s+(\S+)")
        + ", "
        + _all(f"({NL} || body)", r"\n[ \t]*require[ \t]+([^\s(]+)[ \t]+(\S+)")
        + ")",
    ),
    "package_json": (
        ['{"dependencies": {"a": "^1.2", "b": "*"}, "devDependencies": {"c": ">=3"}}', '{"name": "x"}'],
        f"list_concat({_mapped(_json('dependencies', ''), literal('') + ' || ltrim(d.version, ' + literal('^~>=<') + ')')}, {_mapped(_json('devDependencies', ''), 'ltrim(d.version, ' + literal('^~>=<') + ')')})",
    ),
    "package_lock": (
        ['{"packages": {"": {"version": "9"}, "node_modules/a": {"version": "1.0"}, "node_modules/a/node_modules/b": {"version": "2.0"}, "node_modules/c": {}}}', '{"dependencies": {"z": {"version": "4.1"}, "y": {}}}'],
        f"list_filter(CASE WHEN json_extract(body, '$.packages') IS NOT NULL THEN coalesce({_json('packages', 'version', "k <> ''", chr(39).join(['regexp_replace(k, ', '^.*node_modules/', ', ', '', ')']))}, []) ELSE coalesce({_json('dependencies', 'version')}, []) END, lambda d: d.name <> '' AND d.version IS NOT NULL)",
    ),
    "requirements": (
        ["requests==2.31.0\nflask\n# c\n-r x.txt\nuvicorn[standard]>=0.2\na==1.0rc1\n\n  b_c ~= 3 # why\n"],
        f"list_filter(list_transform(list_filter(list_transform(string_split(body, {NL}), lambda s: trim(s)), lambda s: s <> '' AND s[1] <> '#' AND s[1] <> '-'), lambda s: {{'name': regexp_extract(s, '^([A-Za-z0-9_.\\-]+)', 1), 'version': nullif(regexp_extract(s, '^[A-Za-z0-9_.\\-]+(?:\\[[^\\]]*\\])?\\s*[=<>!~]+\\s*([0-9][A-Za-z0-9_.+!*\\-]*)', 1), '')}}), lambda d: d.name <> '')",
    ),
    "pipfile": (
        ['[[source]]\nurl = "u"\n\n[packages]\na = "==1.0"\nb = "*"\n\n[dev-packages]\npytest = ">=7"\n\n[requires]\npython_version = "3"\n'],
        f"list_concat({_mapped(_lines(_section('packages'), r'^\s*\x22?([A-Za-z0-9_.\-]+)\x22?\s*=\s*\x22[^\x22]*\x22', r'^\s*\x22?[A-Za-z0-9_.\-]+\x22?\s*=\s*\x22([^\x22]*)\x22', '=<>~!^ '), _STAR)}, {_mapped(_lines(_section('dev-packages'), r'^\s*\x22?([A-Za-z0-9_.\-]+)\x22?\s*=\s*\x22[^\x22]*\x22', r'^\s*\x22?[A-Za-z0-9_.\-]+\x22?\s*=\s*\x22([^\x22]*)\x22', '=<>~!^ '), _STAR)})",
    ),
    "setup_py_by_pattern": (
        ["from setuptools import setup\nsetup(name='x', install_requires=[\n  'flask>=2.1',\n  \"numpy\",\n])\n", "print(1)\n"],
        "list_filter(list_transform(regexp_extract_all(regexp_extract(body, '(?s)install_requires\\s*=\\s*\\[(.*?)\\]', 1), '[''\"]([^''\"]+)[''\"]', 1), lambda s: {'name': regexp_extract(s, '^\\s*([A-Za-z0-9_.\\-]+)', 1), 'version': nullif(regexp_extract(s, '[=<>!~]+\\s*([\\d.]+)', 1), '')}), lambda d: d.name <> '')",
    ),
    "poetry_lock": (['[[package]]\nname = "a"\nversion = "1.0"\n\n[[package]]\nname = "b"\nversion = "2.1"\ndescription = "x"\n'], _all("body", r'\[\[package\]\]\s*\nname\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"')),
    "pyproject": (
        ['[tool.poetry]\nname = "n"\n\n[tool.poetry.dependencies]\npython = "^3.8"\na = {version = "^1.0"}\nb = "*"\n\n[build-system]\nrequires = []\n'],
        _mapped(_lines(_section(r"tool\.poetry\.dependencies"), r"^\s*([A-Za-z0-9_.\-]+)\s*=", r'^\s*[A-Za-z0-9_.\-]+\s*=\s*(?:\{[^}]*?version\s*=\s*)?"([^"]*)"', "^~>=<! "), _STAR),
    ),
    "pipfile_lock": (['{"default": {"a": {"version": "==1.0"}, "b": {}}, "develop": {"c": {"version": "==2"}}}'], f"list_concat({_mapped(_json('default', 'version'), 'ltrim(d.version, ' + literal('=') + ')')}, {_mapped(_json('develop', 'version'), 'ltrim(d.version, ' + literal('=') + ')')})"),
    "composer_json": (
        ['{"require": {"php": ">=7", "ext-json": "*", "phpunit/phpunit": "^9", "a/b": "*", "c/d": ">= 2.0"}, "require-dev": {"e/f": "~1"}}'],
        "list_concat(" + ", ".join(_mapped(_json(f, "", "NOT regexp_matches(k, '^(php$|php-|ext-|lib-)')"), "trim(ltrim(d.version, '^~>=<*'))") for f in ("require", "require-dev")) + ")",
    ),
    "composer_lock": (
        ['{"packages": [{"name": "a/b", "version": "v1.2.0"}, {"name": "c/d", "version": "2.0"}], "packages-dev": [{"name": "e/f", "version": "v3"}]}'],
        """list_transform(list_concat(from_json(body::JSON->'packages', '[{"name":"VARCHAR","version":"VARCHAR"}]'), from_json(body::JSON->'$."packages-dev"', '[{"name":"VARCHAR","version":"VARCHAR"}]')), lambda d: {'name': d.name, 'version': ltrim(d.version, 'v')})""",
    ),
    "gemfile": (["source 'https://r.org'\ngem 'rails', '~> 6.0'\ngem \"sqlite3\"\n  gem 'puma' # c\n"], _lines("body", "^\\s*gem\\s+['\"]([^'\"]+)['\"]", "^\\s*gem\\s+['\"][^'\"]+['\"]\\s*,\\s*['\"]([^'\"]+)['\"]", "~><= ")),
    "gemfile_lock": (
        ["GEM\n  remote: https://r.org/\n  specs:\n    rails (7.0.0)\n      actionpack (= 7.0.0)\n    net.smtp (0.3)\n\nPLATFORMS\n  ruby\n"],
        _lines(f"regexp_extract(body || {NL} || 'PLATFORMS', '(?s)specs:[^\\n]*\\n(.*?)\\n[ \\t]*(?:PLATFORMS|DEPENDENCIES)', 1)", r"^ {1,5}([A-Za-z0-9_.\-]+)\s+\([0-9][^)]*\)", r"^ {1,5}[A-Za-z0-9_.\-]+\s+\(([0-9][^)]*)\)"),
    ),
    "cargo_toml": (
        ['[package]\nname = "p"\n\n[dependencies]\nserde = "1.0"\ntokio = { version = "^1.2", features = ["full"] }\nlocal = { path = "../l" }\n\n[dev-dependencies]\nrand = "0.8"\n'],
        "list_concat(" + ", ".join(_lines(_section(s), r"^\s*([A-Za-z0-9_\-]+)\s*=\s*[\"{]", r'^\s*[A-Za-z0-9_\-]+\s*=\s*(?:\{[^}]*?version\s*=\s*)?"([^"]*)"', "^~>=< ") for s in ("dependencies", "dev-dependencies")) + ")",
    ),
    "cargo_lock": (['version = 3\n\n[[package]]\nname = "a"\nversion = "1.0.0"\n\n[[package]]\nname = "b"\nversion = "0.2.1"'], _all("body", r'\[\[package\]\]\s*\nname\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"')),
    "rebar_lock": (['{"1.2.0",\n[{<<"cowboy">>,{pkg,<<"cowboy">>,<<"2.9.0">>},0},\n {<<"ranch">>,{pkg,<<"ranch">>,<<"1.8.0">>},1}]}.\n'], _all("body", r'\{<<"([^"]+)">>\s*,\s*\{pkg\s*,\s*<<"[^"]+">>\s*,\s*<<"([^"]+)">>')),
    "rebar_config": (['{deps, [\n  {cowboy, "2.9.0"},\n  {jiffy, "1.0.8"},\n  {odd, "master"}\n]}.\n'], _mapped(_all("body", r'\{\s*([a-z][A-Za-z0-9_]*)\s*,\s*"([^"]*)"'), "CASE WHEN regexp_matches(d.version, '^\\d+\\.\\d') THEN d.version END")),
    "c_list": (
        ["zlib\n\nzlib\n openssl \n"],
        f"list_transform(list_filter(list_transform(string_split(body, {NL}), lambda s, i: CASE WHEN list_position(list_transform(string_split(body, {NL}), lambda t: trim(t)), trim(s)) = i THEN trim(s) ELSE '' END), lambda s: s <> ''), lambda s: {{'name': s, 'version': NULL::VARCHAR}})",
    ),
    "yarn_lock": (['# v1\n\n"@s/p@^1":\n  version "1.1"\n  resolved "u"\n\nlodash@^4, lodash@^4.17:\n  version "4.17.21"\n\nlodash@^3:\n  version "3.1"\n'], None),
    "pom": (
        ['<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies><dependency><groupId>junit</groupId><artifactId>junit</artifactId><version>4.13</version></dependency><dependency><groupId>a</groupId><artifactId>b</artifactId></dependency></dependencies><build><plugins><plugin><artifactId>p</artifactId><version>${v}</version></plugin></plugins></build></project>', "<broken"],
        None,
    ),
    "pnpm_lock": (["lockfileVersion: 5\npackages:\n  node_modules/@s/p@1.0:\n    version: '1.0'\n  node_modules/q:\n    version: 2.1\n  /r/1.0: {dev: true}\n", "a: ["], None),
    "setup_py": (["from setuptools import setup\nsetup(install_requires=['flask>=2', 'flask>=2'], extras_require={'t': ['pytest==7.1']})\n", "setup(\n  install_requires=['x>=1.2']\n"], None),
}

#: What the formats give that SQL cannot read: (number of the body, pos, name, version).
EXPECTED = {
    "yarn_lock": [(0, 0, "@s/p", "1.1"), (0, 1, "lodash", "3.1")],
    "pom": [(0, 0, "junit:junit", "4.13"), (0, 1, ":p", "${v}")],
    "pnpm_lock": [(0, 0, "@s/p", "1.0"), (0, 1, "q", "2.1")],
    "setup_py": [(0, 0, "flask", "2"), (0, 1, "pytest", "7.1"), (1, 0, "x", "1.2")],
}


def _bodies(format_: str) -> Fixture:
    return Fixture("n int, body string", list(enumerate(FIXTURES[format_][0])))


def _sql(format_: str) -> str:
    found = FIXTURES[format_][1]
    if found is None:
        rows = Fixture("n int, pos int, name string, version string", EXPECTED[format_]).sql
        return f"SELECT n_name AS project, n, pos, name, version FROM nation CROSS JOIN {rows}"
    return f"SELECT n_name AS project, n, CAST(i - 1 AS INTEGER) AS pos, d.name AS name, d.version AS version FROM nation CROSS JOIN (SELECT n, unnest(found) AS d, generate_subscripts(found, 1) AS i FROM (SELECT n, {found} AS found FROM {_bodies(format_).sql}))"


def _files(spark, sf_dir, format_):
    ecosystem = next((e for e, _, f, _ in M.FILES if f == format_), "python")
    bodies = _bodies(format_).df(spark)
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("project")).crossJoin(F.broadcast(bodies)).select("project", F.lit(ecosystem).alias("ecosystem"), F.lit(format_).alias("format"), F.col("n").cast("string").alias("path"), "body")


def _add(format_: str) -> None:
    def run(spark, sf_dir):
        return M.extract(_files(spark, sf_dir, format_)).select("project", F.col("path").cast("int").alias("n"), "pos", "name", "version")

    query(_sql(format_), f"manifest_{format_.removeprefix('pom') or 'pom'}")(run)


for _format in FIXTURES:
    _add(_format)


@query("SELECT DISTINCT project, ecosystem, coord FROM (" + " UNION ALL ".join(f"SELECT project, {literal(next((e for e, _, f, _ in M.FILES if f == k), 'python'))} AS ecosystem, CASE WHEN version IS NULL THEN name WHEN '{k}' = 'pom' THEN name || ':' || version ELSE name || ' ' || version END AS coord FROM ({_sql(k)})" for k in FIXTURES) + ")")
def project_dependencies(spark, sf_dir):
    """All formats at once: extraction, coordinates, the union without repeats."""
    every = _files(spark, sf_dir, "pom")
    for f in FIXTURES:
        every = every if f == "pom" else every.unionByName(_files(spark, sf_dir, f))
    return M.project_dependencies(M.extract(every))


_ASKED = Fixture("project string, ecosystem string", [("BRAZIL", "go"), ("BRAZIL", "csharp"), ("nowhere", "go")])


@query(f"""WITH deps AS (SELECT project, 'go' AS ecosystem FROM ({_sql('go_mod')})) SELECT a.project, a.ecosystem, CASE WHEN a.ecosystem = 'go' THEN 'success' ELSE 'skipped' END AS status, (SELECT count(*) FROM deps d WHERE d.project = a.project AND d.ecosystem = a.ecosystem) AS "count" FROM (SELECT n_name AS project, unnest(['go', 'csharp']) AS ecosystem FROM nation UNION ALL SELECT 'nowhere', 'go') a""")
def parse_summary(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("project"), F.explode(F.array(F.lit("go"), F.lit("csharp"))).alias("ecosystem")).unionByName(spark.createDataFrame([("nowhere", "go")], "project string, ecosystem string"))
    return M.parse_summary(asked, M.extract(_files(spark, sf_dir, "go_mod")))


_TREE = Fixture("project string, rel_dir string, file string", [("a", "", "package.json"), ("a", "", "yarn.lock"), ("a", "sub", "package.json"), ("a", "", "POM.XML"), ("a", "py", "setup.py"), ("a", "py", "Pipfile"), ("b", "", "libraries.txt"), ("b", "", "README")])


@query(f"""SELECT project, rel_dir, file, ecosystem, format FROM (SELECT *, row_number() OVER (PARTITION BY project, rel_dir, ecosystem ORDER BY precedence, file) AS r FROM {_TREE.sql} t JOIN {Fixture('ecosystem string, known string, format string, precedence int', list(M.FILES)).sql} k ON CASE WHEN lower(t.file) = 'pom.xml' THEN 'pom.xml' ELSE t.file END = k.known) WHERE r = 1""")
def manifest_discovery(spark, sf_dir):
    return M.discover(_TREE.df(spark)).select("project", "rel_dir", "file", "ecosystem", "format")


_VERSIONS = [">=2.28.0,<3.0.0", "~=1.4.5", "requests>=2.28.0", "[1.0,2.0)", "[1.0,2.0]", "(1.0,2.0)", "[1.0,)", "(,2.0]", "^1.2.3", "~1.2.3", "1.x", "", "1.0.0", ">=1.0.0", " unknown ", "===1.0", "!=1.5, >1", "1.0.0-beta+x", "~> 2.1"]


def _sql_single(c: str) -> str:
    ops = f"MAP {{{', '.join(f'{literal(k)}: {literal(v)}' for k, v in V.OPERATORS.items())}}}"
    op = f"regexp_extract(trim({c}), '^([=~><!^]+)(.+)$', 1)"
    return f"CASE WHEN {op} <> '' THEN [{{'op': coalesce(map_extract({ops}, {op})[1], 'EQ'), 'version': trim(regexp_extract(trim({c}), '^([=~><!^]+)(.+)$', 2))}}] WHEN regexp_matches(trim({c}), '^\\d+(\\.\\d+)*(-[a-zA-Z0-9]+)?(\\+.*)?$') THEN [{{'op': 'EQ', 'version': trim({c})}}] ELSE [] END"


_RANGE = literal(V._RANGE)
_CONSTRAINTS_SQL = f"""
WITH v AS (SELECT n_nationkey, raw, trim(raw) AS t FROM nation CROSS JOIN (SELECT unnest({literal(_VERSIONS)}) AS raw)),
p AS (SELECT n_nationkey, raw, CASE WHEN t = '' OR lower(t) = 'unknown' THEN []
 WHEN regexp_matches(t, {_RANGE}) THEN list_filter([{{'op': CASE WHEN t[1] = '[' THEN 'GE' ELSE 'GT' END, 'version': trim(regexp_extract(t, {_RANGE}, 1))}}, {{'op': CASE WHEN t[-1] = ']' THEN 'LE' ELSE 'LT' END, 'version': trim(regexp_extract(t, {_RANGE}, 2))}}], lambda x: x.version <> '')
 WHEN contains(t, ',') THEN flatten(list_transform(string_split(t, ','), lambda s: {_sql_single('s')}))
 ELSE {_sql_single('t')} END AS c FROM v)
"""


def _versions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _VERSIONS))).alias("raw")).withColumn("c", V.parse(F.col("raw")))


@query(f"""{_CONSTRAINTS_SQL} SELECT n_nationkey, raw, len(c) AS n, len(c) = 0 AS free, list_filter(c, lambda x: x.op IN ('GE', 'GT'))[1].version AS low, list_filter(c, lambda x: x.op IN ('LE', 'LT'))[1].version AS high, list_filter(c, lambda x: x.op = 'EQ')[1].version AS exact FROM p""")
def version_constraints(spark, sf_dir):
    c = F.col("c")
    return _versions(spark, sf_dir).select("n_nationkey", "raw", F.size(c).cast("long").alias("n"), V.is_unconstrained(c).alias("free"), V.min_version(c).alias("low"), V.max_version(c).alias("high"), V.exact_version(c).alias("exact"))


@query(f"""{_CONSTRAINTS_SQL} SELECT n_nationkey, raw, coalesce(array_to_string(list_transform(c, lambda x: CASE x.op WHEN 'EQ' THEN '==' WHEN 'GE' THEN '>=' WHEN 'GT' THEN '>' WHEN 'LE' THEN '<=' WHEN 'LT' THEN '<' WHEN 'NE' THEN '!=' WHEN 'COMPATIBLE' THEN '~=' WHEN 'TILDE' THEN '~' WHEN 'CARET' THEN '^' END || x.version), ', '), '') AS text FROM p""")
def version_render(spark, sf_dir):
    return _versions(spark, sf_dir).select("n_nationkey", "raw", V.render(F.col("c")).alias("text"))


_SPECS = ["requests[security]>=2.28.0", "django>=3.0", "numpy[mkl, openblas]==1.21.0", "zope.interface>4", ""]


@query(f"""SELECT n_nationkey, raw, CASE WHEN regexp_extract(raw, {literal(V._EXTRAS)}, 1) = '' THEN raw ELSE regexp_extract(raw, {literal(V._EXTRAS)}, 1) END AS name, list_filter(list_transform(string_split(regexp_extract(raw, {literal(V._EXTRAS)}, 2), ','), lambda e: trim(e)), lambda e: e <> '') AS extras, trim(regexp_extract(raw, {literal(V._EXTRAS)}, 3)) AS rest FROM nation CROSS JOIN (SELECT unnest({literal(_SPECS)}) AS raw)""")
def version_extras(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _SPECS))).alias("raw")).withColumn("e", V.extras(F.col("raw"))).select("n_nationkey", "raw", "e.name", "e.extras", "e.rest")


_REQUIREMENTS = Fixture("project string, seq int, kind string, spec string", [
    ("p", 0, "production", 'Requests[socks,security] >= 2.8.1, == 2.8.* ; python_version < "2.7"'), ("p", 1, "production", "requests==1.0"), ("p", 2, "test", "requests==1.0"), ("p", 3, "production", "git+https://x/y"),
    ("p", 4, "production", "# c"), ("p", 5, "optional[x]", "zope.interface (>4.0)"), ("q", 0, "development", "black # formatter"), ("q", 1, "production", "-e ."), ("q", 2, "production", "https://a/b.whl"),
])


@query("""SELECT * FROM (VALUES ('p', 'Requests', ['socks', 'security'], '>= 2.8.1, == 2.8.*', 'python_version < "2.7"', 'production'), ('p', 'requests', [], '==1.0', NULL, 'test'), ('p', 'zope.interface', [], '>4.0', NULL, 'optional[x]'), ('q', 'black', [], '', NULL, 'development')) AS t(project, name, extras, "constraint", markers, kind)""")
def pep508_requirements(spark, sf_dir):
    return M.python_dependencies(_REQUIREMENTS.df(spark))


_PYPROJECT = """[project]
name = "x"
dependencies = ["requests[security]>=2.28", "attrs", 'tomli>=1.1.0 ; python_version < "3.11"']
[project.optional-dependencies]
dev = ["pytest>=7", "requests[security]>=2.28"]
[tool.poetry.dependencies]
python = "^3.8"
numpy = "^1.21"
torch = {version = ">=2.0", optional = true}
local = {path = "../x"}
"""
_PY_FILES = Fixture("project string, path string, file string, body string", [
    ("p", "a/pyproject.toml", "pyproject.toml", _PYPROJECT), ("p", "a/requirements-dev.txt", "requirements-dev.txt", "# c\npytest>=7\n-r other.txt\nblack==23.1 ; x\n\nattrs\n"),
    ("q", "setup.py", "setup.py", "setup(name='q', install_requires=['django>=3.0', \"six\"])"), ("q", "pyproject.toml", "pyproject.toml", "not toml ["), ("r", "requirements.txt", "requirements.txt", ""),
])


@query("""SELECT * FROM (VALUES ('p', 'requests', '2.28', 'pip', 'a/pyproject.toml'), ('p', 'attrs', 'unknown', 'pip', 'a/pyproject.toml'), ('p', 'tomli', '1.1.0', 'pip', 'a/pyproject.toml'), ('p', 'pytest', '7', 'pip', 'a/pyproject.toml'), ('p', 'numpy', '^1.21', 'poetry', 'a/pyproject.toml'), ('p', 'torch', '>=2.0', 'poetry', 'a/pyproject.toml'), ('p', 'local', 'unknown', 'poetry', 'a/pyproject.toml'), ('p', 'black', '23.1', 'pip', 'a/requirements-dev.txt'), ('q', 'django', '3.0', 'pip', 'setup.py'), ('q', 'six', 'unknown', 'pip', 'setup.py')) AS t(project, name, version, manager, path)""")
def python_project(spark, sf_dir):
    return M.python_project(_PY_FILES.df(spark))


def _python_found(spark, sf_dir):
    """Suppliers' parts as what files of a project ask for."""
    place = F.element_at(F.array(*map(F.lit, M.PYTHON_ORDER)), (F.col("l_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").cast("string").alias("project"), place.alias("file"), F.col("l_orderkey").alias("seq"), F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("name"), F.when(F.col("l_partkey") % 3 == 0, "development").otherwise("production").alias("kind"), F.when(F.col("l_orderkey") % 2 == 0, ">=1").alias("constraint"), F.when(F.col("l_orderkey") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("extras"))


@query("""WITH k AS (SELECT l_suppkey::VARCHAR AS project, l_partkey % 6 AS place, l_orderkey AS seq, lower('P' || (l_partkey % 40)) AS key, l_partkey % 3 = 0 AS kind, l_orderkey % 2 = 0 AS c, l_orderkey % 5 = 0 AS e FROM lineitem WHERE l_linenumber = 1),
g AS (SELECT *, bool_or(place IN (0, 1)) OVER (PARTITION BY project) AS locked FROM k),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, key, kind ORDER BY place, seq) AS r FROM g WHERE NOT (locked AND place = 2)) WHERE r = 1),
n AS (SELECT project, count(*)::BIGINT AS total_found, count_if(c)::BIGINT AS with_constraints, count_if(e)::BIGINT AS with_extras FROM o GROUP BY project),
f AS (SELECT project, list_transform(list_sort(list_distinct(list(place))), lambda p: ['poetry.lock', 'Pipfile.lock', 'requirements.txt', 'setup.py', 'pyproject.toml', 'Pipfile'][p + 1]) AS files FROM k GROUP BY project)
SELECT project, total_found, with_constraints, with_extras, files FROM n JOIN f USING (project)""")
def python_project_metadata(spark, sf_dir):
    return M.python_metadata(_python_found(spark, sf_dir))


_GEMS = Fixture("n int, body string", [(0, "gem 'rails', '~> 6.0.1' # web\n#gem 'x'\ngem 'local', path: '../l'\ngem 'g', github: 'a/b'\ngem \"pg\", '>= 0.18', '< 2.0'\ngem 'puma'\n")])


@query("SELECT * FROM (VALUES (0, 0, 'rails', '6.0.1'), (0, 1, 'pg', '0.18'), (0, 2, 'puma', NULL)) AS t(n, pos, name, version)")
def gemfile_advanced(spark, sf_dir):
    return _GEMS.df(spark).select("n", F.posexplode(M.ruby_advanced(F.col("body"))).alias("pos", "d")).select("n", "pos", "d.name", "d.version")

"""Dependencies from manifests and lockfiles: one column expression a format, so extraction is a narrow step of one scan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

DEPENDENCIES = "array<struct<name:string,version:string>>"

#: Ecosystem, file name, format, precedence within a folder (the first one that exists counts).
FILES = (
    ("java", "pom.xml", "pom", 1), ("go", "go.mod", "go_mod", 1),
    ("javascript", "pnpm-lock.yaml", "pnpm_lock", 1), ("javascript", "yarn.lock", "yarn_lock", 2), ("javascript", "package-lock.json", "package_lock", 3), ("javascript", "package.json", "package_json", 4),
    ("python", "poetry.lock", "poetry_lock", 1), ("python", "Pipfile.lock", "pipfile_lock", 2), ("python", "requirements.txt", "requirements", 3), ("python", "pyproject.toml", "pyproject", 4), ("python", "Pipfile", "pipfile", 5), ("python", "setup.py", "setup_py", 6),
    ("php", "composer.lock", "composer_lock", 1), ("php", "composer.json", "composer_json", 2),
    ("ruby", "Gemfile.lock", "gemfile_lock", 1), ("ruby", "Gemfile", "gemfile", 2), ("ruby", "gemfile.lock", "gemfile_lock", 3), ("ruby", "gemfile", "gemfile", 4),
    ("rust", "Cargo.lock", "cargo_lock", 1), ("rust", "Cargo.toml", "cargo_toml", 2),
    ("erlang", "rebar.lock", "rebar_lock", 1), ("erlang", "rebar.config", "rebar_config", 2),
    ("c", "libraries.txt", "c_list", 1),
)


def _lines(body: Column) -> Column:
    return F.split(body, r"\r?\n")


def _pair(name: Column, version: Column) -> Column:
    """A dependency; an empty version is null."""
    return F.struct(name.cast("string").alias("name"), F.nullif(version.cast("string"), F.lit("")).alias("version"))


def _some(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["name"].isNotNull() & (p["name"] != ""))


def _section(body: Column, header: str) -> Column:
    """The text between a [header] line and the next line that opens a bracket."""
    return F.regexp_extract(F.concat(body, F.lit("\n[")), rf"(?s)(?:^|\n)\[{header}\][^\n]*\n(.*?)\n?[ \t]*\[(?:\w|$)", 1)


def _by_line(text: Column, name: str, version: str, then: Callable[[Column], Column] = lambda v: v) -> Column:
    """A dependency for each line in which the name's pattern is found; both patterns have one group."""
    return _some(F.transform(_lines(text), lambda s: _pair(F.regexp_extract(s, name, 1), then(F.regexp_extract(s, version, 1)))))


def _all(text: Column, pattern: str) -> Column:
    """A dependency for each match; group 1 is the name, group 2 the version."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    return _some(F.transform(zipped, lambda z: _pair(z["a"], z["b"])))


def _json_map(body: Column, field: str, value: str) -> Column:
    parsed = F.from_json(body, f"`{field}` map<string,{value}>")
    return F.map_entries(F.coalesce(parsed[field], F.create_map().cast(f"map<string,{value}>")))


def go_mod(body: Column, strict: bool = False) -> Column:
    text = F.regexp_replace(body, r"(?m)[ \t]*//[ \t]*indirect.*$", "")
    blocks = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)(?:^|\n)[ \t]*require[ \t]*\((.*?)\n[ \t]*\)"), F.lit(1)), "\n")
    single = F.array_join(F.regexp_extract_all(text, F.lit(r"(?:^|\n)[ \t]*require[ \t]+([^\s(]+[ \t]+\S+)"), F.lit(1)), "\n")
    name = r"^\s*(\S+)\s+\S+" if strict else r"^\s*([^\s/]\S*)\s+\S+"
    return F.concat(_by_line(blocks, name, r"^\s*\S+\s+(\S+)"), _by_line(single, r"^\s*(\S+)\s+\S+", r"^\s*\S+\s+(\S+)"))


def package_json(body: Column, strict: bool = False) -> Column:
    return F.concat(*(F.transform(_json_map(body, f, "string"), lambda e: _pair(e["key"], F.ltrim(e["value"], F.lit("^~>=<")))) for f in ("dependencies", "devDependencies")))


def package_lock(body: Column, strict: bool = False) -> Column:
    name = (lambda k: F.replace(k, F.lit("node_modules/"), F.lit(""))) if strict else (lambda k: F.regexp_replace(k, r"^.*node_modules/", ""))
    found = lambda f, n: F.filter(F.transform(_json_map(body, f, "struct<version:string>"), lambda e: _pair(n(e["key"]), e["value"]["version"])), lambda p: (p["name"] != "") & p["version"].isNotNull())
    modern = F.from_json(body, "packages map<string,string>")["packages"].isNotNull()
    return F.when(modern, found("packages", name)).otherwise(found("dependencies", lambda k: k))


def yarn_lock(body: Column, strict: bool = False) -> Column:
    """Blocks of a key line and a version line. The key's last alias names the package; the last version of a name counts."""
    quote = '"' if strict else '"?'
    pairs = _all(F.concat(F.lit("\n"), body), rf'\n{quote}(?:[^\n]*, "?)?(@?[^\s@",]+)@[^\n]*:[ \t]*\r?\n(?:[ \t]+[^\n]*\n)*?[ \t]+version:?[ \t]+"?([^\s"]+)')
    return F.transform(F.array(pairs), lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["name"] == p["name"])))[0]


def pnpm_lock(body: Column, strict: bool = False) -> Column:
    """Lockfiles that name their packages by node_modules/ keys, through a YAML parser."""

    @F.pandas_udf(DEPENDENCIES)
    def run(bodies: pd.Series) -> pd.Series:
        import yaml

        def one(text):
            try:
                packages = (yaml.safe_load(text or "") or {}).get("packages") or {}
                items = [(k.rpartition("node_modules/")[2], v) for k, v in packages.items() if "node_modules/" in k and isinstance(v, dict) and v.get("version") is not None]
            except (yaml.YAMLError, AttributeError):
                return []
            name = (lambda n: n.rpartition("@")[2]) if strict else (lambda n: n if n.rfind("@") <= 0 else n[: n.rfind("@")])
            return [{"name": name(n), "version": str(v["version"])} for n, v in items]

        return bodies.map(one)

    return run(body)


def requirements(body: Column, strict: bool = False) -> Column:
    keep = F.filter(F.transform(_lines(body), lambda s: strip(s)), lambda s: (s != "") & ~s.startswith("#") & (F.lit(strict) | ~s.startswith("-")))
    version = r"^[A-Za-z0-9_.\-]+\s*[=<>!~]+\s*([\d.]+)" if strict else r"^[A-Za-z0-9_.\-]+(?:\[[^\]]*\])?\s*[=<>!~]+\s*([0-9][A-Za-z0-9_.+!*\-]*)"
    return _some(F.transform(keep, lambda s: _pair(F.regexp_extract(s, r"^([A-Za-z0-9_.\-]+)", 1), F.regexp_extract(s, version, 1))))


def pipfile(body: Column, strict: bool = False) -> Column:
    clean = lambda v: F.when(v == "*", "").otherwise(F.ltrim(v, F.lit("=<>~!^ ")))
    line = r'^\s*"?([A-Za-z0-9_.\-]+)"?\s*=\s*"[^"]*"'
    return F.concat(*(_by_line(_section(body, s), line, r'^\s*"?[A-Za-z0-9_.\-]+"?\s*=\s*"([^"]*)"', clean) for s in ("packages", "dev-packages")))


def setup_py(body: Column, strict: bool = False) -> Column:
    """install_requires, requires and extras_require of setup() calls, through Python's own syntax tree; else by pattern."""

    @F.pandas_udf("array<string>")
    def run(bodies: pd.Series) -> pd.Series:
        import ast

        def texts(node):
            if isinstance(node, ast.Constant):
                return [node.value] if isinstance(node.value, str) else []
            inner = node.values if isinstance(node, ast.Dict) else getattr(node, "elts", [])
            return [t for x in inner for t in texts(x)]

        def one(text):
            try:
                calls = [n for n in ast.walk(ast.parse(text or "")) if isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", None)) == "setup"]
            except (SyntaxError, ValueError):
                return None
            return list(dict.fromkeys(t for c in calls for k in c.keywords if k.arg in ("install_requires", "requires", "extras_require") for t in texts(k.value)))

        return bodies.map(one)

    specs = run(body)
    if strict:
        parsed = F.transform(specs, lambda s: _pair(s, F.lit("")))
    else:
        parsed = _some(F.transform(specs, lambda s: _pair(F.regexp_extract(s, r"^\s*([A-Za-z0-9_.\-]+)", 1), F.regexp_extract(s, r"[=<>!~]+\s*([0-9][A-Za-z0-9_.+!*\-]*)", 1))))
    return F.coalesce(parsed, setup_py_by_pattern(body))


def setup_py_by_pattern(body: Column, strict: bool = False) -> Column:
    block = F.regexp_extract(body, r"(?s)install_requires\s*=\s*\[(.*?)\]", 1)
    specs = F.regexp_extract_all(block, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    return _some(F.transform(specs, lambda s: _pair(F.regexp_extract(s, r"^\s*([A-Za-z0-9_.\-]+)", 1), F.regexp_extract(s, r"[=<>!~]+\s*([\d.]+)", 1))))


def poetry_lock(body: Column, strict: bool = False) -> Column:
    return _all(body, r'\[\[package\]\]\s*\nname\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"')


def pyproject(body: Column, strict: bool = False) -> Column:
    clean = lambda v: F.when(v == "*", "").otherwise(F.ltrim(v, F.lit("^~>=<! ")))
    return _by_line(_section(body, r"tool\.poetry\.dependencies"), r"^\s*([A-Za-z0-9_.\-]+)\s*=", r'^\s*[A-Za-z0-9_.\-]+\s*=\s*(?:\{[^}]*?version\s*=\s*)?"([^"]*)"', clean)


def pipfile_lock(body: Column, strict: bool = False) -> Column:
    return F.concat(*(F.transform(_json_map(body, f, "struct<version:string>"), lambda e: _pair(e["key"], F.ltrim(e["value"]["version"], F.lit("=")))) for f in ("default", "develop")))


def composer_json(body: Column, strict: bool = False) -> Column:
    platform = (lambda n: n.rlike("^(php|ext-)")) if strict else (lambda n: n.rlike("^(php$|php-|ext-|lib-)"))
    clean = lambda v: F.ltrim(v, F.lit("^~>=<*"))
    return F.concat(*(F.transform(F.filter(_json_map(body, f, "string"), lambda e: ~platform(e["key"])), lambda e: _pair(e["key"], clean(e["value"]) if strict else strip(clean(e["value"])))) for f in ("require", "require-dev")))


def composer_lock(body: Column, strict: bool = False) -> Column:
    parsed = F.from_json(body, "packages array<struct<name:string,version:string>>, `packages-dev` array<struct<name:string,version:string>>")
    none = F.array().cast(DEPENDENCIES)
    return _some(F.transform(F.concat(F.coalesce(parsed["packages"], none), F.coalesce(parsed["packages-dev"], none)), lambda p: _pair(p["name"], F.ltrim(p["version"], F.lit("v")))))


def gemfile(body: Column, strict: bool = False) -> Column:
    clean = (lambda v: F.ltrim(v, F.lit("~><="))) if strict else (lambda v: F.ltrim(v, F.lit("~><= ")))
    return _by_line(body, "^\\s*gem\\s+[\"']([^\"']+)[\"']", "^\\s*gem\\s+[\"'][^\"']+[\"']\\s*,\\s*[\"']([^\"']+)[\"']", clean)


def gemfile_lock(body: Column, strict: bool = False) -> Column:
    """Packages of the `specs:` lists: indented by four blanks; their own constraints are indented further."""
    text = F.regexp_extract(F.concat(body, F.lit("\nPLATFORMS")), r"(?s)specs:[^\n]*\n(.*?)\n[ \t]*(?:PLATFORMS|DEPENDENCIES)", 1)
    if strict:
        return _by_line(text, r"^\s+([A-Za-z0-9_\-]+)\s+\([^)]+\)", r"^\s+[A-Za-z0-9_\-]+\s+\(([^)]+)\)")
    return _by_line(text, r"^ {1,5}([A-Za-z0-9_.\-]+)\s+\([0-9][^)]*\)", r"^ {1,5}[A-Za-z0-9_.\-]+\s+\(([0-9][^)]*)\)")


def cargo_toml(body: Column, strict: bool = False) -> Column:
    name, version = r"^\s*([A-Za-z0-9_\-]+)\s*=\s*[\"{]", r'^\s*[A-Za-z0-9_\-]+\s*=\s*(?:\{[^}]*?version\s*=\s*)?"([^"]*)"'
    return F.concat(*(_by_line(_section(body, s), name, version, lambda v: F.ltrim(v, F.lit("^~>=< "))) for s in ("dependencies", "dev-dependencies")))


def cargo_lock(body: Column, strict: bool = False) -> Column:
    end = r"(?:[^\n\[]+\n)*?(?:\n|\[)" if strict else ""
    return _all(body, r'\[\[package\]\]\s*\nname\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"' + end)


def rebar_lock(body: Column, strict: bool = False) -> Column:
    return _all(body, r'\{<<"([^"]+)">>\s*,\s*\{pkg\s*,\s*<<"[^"]+">>\s*,\s*<<"([^"]+)">>')


def rebar_config(body: Column, strict: bool = False) -> Column:
    return F.transform(_all(body, r'\{\s*([a-z][A-Za-z0-9_]*)\s*,\s*"([^"]*)"'), lambda p: _pair(p["name"], F.when(p["version"].rlike(r"^\d+\.\d"), p["version"])))


def c_list(body: Column, strict: bool = False) -> Column:
    return F.transform(F.filter(F.array_distinct(F.transform(_lines(body), lambda s: strip(s))), lambda s: s != ""), lambda s: _pair(s, F.lit("")))


def pom(body: Column, strict: bool = False) -> Column:
    """group:artifact and version of dependencies, then plugins, that have a version; placeholders stay as they are written."""

    @F.pandas_udf(DEPENDENCIES)
    def run(bodies: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        space = "{http://maven.apache.org/POM/4.0.0}"

        def one(text):
            try:
                root = ElementTree.fromstring(text or "")
            except (ElementTree.ParseError, ValueError):
                return []
            spaces = (space,) if strict else (space, "")
            value = lambda node, s, tag: (node.findtext(s + tag) or "").strip()
            nodes = [(s, n) for kind in ("dependency", "plugin") for s in spaces for n in root.iter(s + kind)]
            return [{"name": f"{value(n, s, 'groupId')}:{value(n, s, 'artifactId')}", "version": v} for s, n in nodes if (v := value(n, s, "version"))]

        return bodies.map(one)

    return run(body)


#: Format -> column expression.
FORMATS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (pom, go_mod, package_json, package_lock, yarn_lock, pnpm_lock, requirements, pipfile, setup_py, setup_py_by_pattern, poetry_lock, pyproject, pipfile_lock, composer_json, composer_lock, gemfile, gemfile_lock, cargo_toml, cargo_lock, rebar_lock, rebar_config, c_list)
}


def pep508(spec: Column) -> Column:
    """struct<name, extras, constraint, markers, version> of a requirement; null for links and options."""
    own = F.trim(F.regexp_replace(spec, r"\s+#.*$", ""))
    body, markers = F.trim(F.regexp_extract(own, r"^([^;]*)", 1)), F.trim(F.regexp_extract(own, r";(.*)$", 1))
    name = F.regexp_extract(body, r"^([A-Za-z0-9][A-Za-z0-9._\-]*)", 1)
    listed = F.filter(F.transform(F.split(F.regexp_extract(body, r"^[A-Za-z0-9._\-]+\s*\[([^\]]*)\]", 1), ","), lambda e: F.trim(e)), lambda e: e != "")
    rest = F.trim(F.regexp_extract(body, r"^[A-Za-z0-9._\-]+\s*(?:\[[^\]]*\])?\s*\(?([^()]*)\)?$", 1))
    fine = (name != "") & ~own.rlike(r"^(-|#)|://|^git\+")
    return F.when(fine, F.struct(name.alias("name"), listed.alias("extras"), rest.alias("constraint"), F.nullif(markers, F.lit("")).alias("markers"), F.nullif(F.regexp_extract(rest, r"(\d[\d.]*)", 1), F.lit("")).alias("version")))


def python_dependencies(specs: DataFrame) -> DataFrame:
    """(project, seq, kind, spec) -> project, name, extras, constraint, markers, kind: the first of each (lower-case name, kind)."""
    from .relational import distinct_on

    parsed = specs.withColumn("p", pep508(F.col("spec"))).where(F.col("p").isNotNull()).select("project", "seq", "kind", F.lower("p.name").alias("key"), "p.*")
    return distinct_on(parsed, ["project", "key", "kind"], [F.col("seq")]).select("project", "name", "extras", "constraint", "markers", "kind")


def _project_specs(body: Column) -> Column:
    """What a pyproject.toml asks for: [project], its optional groups, and a poetry table without the interpreter. Unreadable: nothing."""

    @F.pandas_udf("array<struct<spec:string,kind:string,manager:string,version:string>>")
    def run(bodies: pd.Series) -> pd.Series:
        import tomllib

        def one(text):
            try:
                data = tomllib.loads(text or "")
                project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
                out = [(d, "production", "pip", None) for d in project.get("dependencies", [])]
                out += [(d, f"optional[{g}]", "pip", None) for g, own in project.get("optional-dependencies", {}).items() for d in own]
                for name, v in poetry.get("dependencies", {}).items():
                    if name.lower() != "python":
                        out.append((name, "production", "poetry", v if isinstance(v, str) else v.get("version", "unknown") if isinstance(v, dict) else "unknown"))
                return [dict(zip(("spec", "kind", "manager", "version"), x, strict=True)) for x in out if isinstance(x[0], str)]
            except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                return []

        return bodies.map(one)

    return run(body)


def python_project(files: DataFrame) -> DataFrame:
    """(project, path, file, body) -> project, name, version, manager, path: what the Python files of a project ask for, each (name, version) once.

    pyproject.toml ([project], its optional groups, poetry), requirements*.txt and the install_requires list of setup.py count;
    the first by path, then by place, is kept. Version: the first run of digits and dots of a requirement, as written for
    poetry, `unknown` if there is none. Files that can't be read give no row.
    """
    from .relational import distinct_on

    lines = F.filter(F.transform(_lines(F.col("body")), lambda x: strip(x)), lambda x: (x != "") & ~x.rlike("^[#-]"))
    listed = F.regexp_extract_all(F.regexp_extract("body", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1), F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    pip = lambda specs: F.transform(specs, lambda x: F.struct(x.alias("spec"), F.lit("production").alias("kind"), F.lit("pip").alias("manager"), F.lit(None).cast("string").alias("version")))
    text = files.where(F.col("file").rlike(r"^requirements[^/]*\.txt$") | (F.col("file") == "setup.py")).withColumn("specs", F.when(F.col("file") == "setup.py", pip(listed)).otherwise(pip(lines)))
    toml = files.where("file = 'pyproject.toml'").withColumn("specs", _project_specs(F.col("body")))
    long = text.unionByName(toml).select("project", "path", F.posexplode("specs").alias("seq", "s")).select("project", "path", "seq", "s.*")
    own = F.trim(F.regexp_extract("spec", r"^([^;]*)", 1))
    name, rest = (F.regexp_extract(own, r"^([a-zA-Z0-9_.\-]+)(?:\[.*?\])?(.*)$", i) for i in (1, 2))
    digits = F.regexp_extract(rest, r"([\d.]+)", 1)
    found = long.select("project", "path", "seq", "manager", name.alias("name"), F.coalesce("version", F.when(digits == "", "unknown").otherwise(digits)).alias("version")).where("name <> ''")
    return distinct_on(found, ["project", "name", "version"], [F.col("path"), F.col("seq")]).select("project", "name", "version", "manager", "path")


#: The Python files of a project, the first that counts first.
PYTHON_ORDER = ("poetry.lock", "Pipfile.lock", "requirements.txt", "setup.py", "pyproject.toml", "Pipfile")


def python_metadata(dependencies: DataFrame, *, strict: bool = False) -> DataFrame:
    """(project, file, seq, name, kind, constraint, extras) -> a row for each project: dependencies, how many have constraints or extras, files.

    Files count in PYTHON_ORDER; of equal (lower-case name, kind) the first is kept. Where a lock file gives rows, those of
    requirements.txt are left out, as they are less exact (strict: they stay).
    """
    from .relational import distinct_on

    place = F.array_position(F.array(*map(F.lit, PYTHON_ORDER)), F.col("file"))
    known = dependencies.where(F.col("file").isin(*PYTHON_ORDER)).select("project", place.alias("place"), "seq", "file", "name", F.lower("name").alias("key"), "kind", "constraint", "extras")
    files = known.groupBy("project").agg(F.array_sort(F.collect_set(F.struct("place", "file"))).alias("f")).select("project", F.transform("f", lambda x: x["file"]).alias("files"))
    locked = known.where(F.lower("file").contains("lock")).select("project").distinct()
    asked = known if strict else known.where("file <> 'requirements.txt'").unionByName(known.where("file = 'requirements.txt'").join(locked, "project", "left_anti"))
    once = distinct_on(asked, ["project", "key", "kind"], [F.col("place"), F.col("seq")])
    counts = once.groupBy("project").agg(F.count(F.lit(1)).alias("total_found"), F.count_if(F.coalesce("constraint", F.lit("")) != "").alias("with_constraints"), F.count_if(F.size("extras") > 0).alias("with_extras"))
    return counts.join(files, "project").select("project", "total_found", "with_constraints", "with_extras", "files")


def ruby_advanced(body: Column) -> Column:
    """Gems of a Gemfile without comments and without local or repository gems; the version is its first run of digits and dots."""
    keep = F.filter(F.transform(_lines(body), lambda s: F.regexp_replace(s, "#.*$", "")), lambda s: s.rlike("^\\s*gem\\s+[\"']") & ~s.rlike(r"(path|git|github):"))
    return F.transform(keep, lambda s: _pair(F.regexp_extract(s, "gem\\s+[\"']([^\"']+)[\"']", 1), F.regexp_extract(F.regexp_extract(s, "gem\\s+[\"'][^\"']+[\"']\\s*,(.*)$", 1), r"(\d[\d.]*)", 1)))


def coordinate(name: Column, version: Column, format_: Column) -> Column:
    """`group:artifact:version` for Maven, `name version` otherwise, the name alone without a version."""
    return F.when(version.isNull(), name).when(format_ == "pom", F.concat(name, F.lit(":"), version)).otherwise(F.concat(name, F.lit(" "), version))


def discover(listing: DataFrame) -> DataFrame:
    """(project, rel_dir, file, ...) -> the listing's rows that are manifests, with ecosystem and format: for each folder and
    ecosystem the one of the first precedence. pom.xml in any case counts. The table of names is small and fixed."""
    from .relational import top_k

    known = listing.sparkSession.createDataFrame(FILES, "ecosystem string, known string, format string, precedence int")
    name = F.when(F.lower("file") == "pom.xml", "pom.xml").otherwise(F.col("file"))
    found = listing.join(F.broadcast(known), name == F.col("known"))
    return top_k(found, ["project", "rel_dir", "ecosystem"], [F.col("precedence"), F.col("file")], 1, "__r").drop("__r", "known", "precedence")


def extract(files: DataFrame, *, strict: bool = False) -> DataFrame:
    """(project, ecosystem, format, path, body) -> those without body, and pos, name, version, coord: a row for each dependency.

    One scan: each format's expression is evaluated for its own rows only; formats that need Python get their own branch, so
    that other files never go to a worker. Unreadable bodies give no row.
    """
    python = ("pom", "pnpm_lock", "setup_py")
    chosen = F.lit(None).cast(DEPENDENCIES)
    for name, f in FORMATS.items():
        if name not in python:
            chosen = F.when(F.col("format") == name, f(F.col("body"), strict)).otherwise(chosen)
    parts = [files.where(~F.col("format").isin(*python)).withColumn("found", chosen)]
    parts += [files.where(F.col("format") == name).withColumn("found", FORMATS[name](F.col("body"), strict)) for name in python]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = every.select("project", "ecosystem", "format", "path", F.posexplode("found").alias("pos", "d")).select("project", "ecosystem", "format", "path", "pos", "d.name", "d.version")
    return out.withColumn("coord", coordinate(F.col("name"), F.col("version"), F.col("format")))


def project_dependencies(extracted: DataFrame) -> DataFrame:
    """project, ecosystem, coord: the union over a project's files, without repeats."""
    return extracted.select("project", "ecosystem", "coord").distinct()


def parse_summary(projects: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(project, ecosystem) asked for -> with status and count: success, or skipped where nothing can read it."""
    known = sorted({e for e, *_ in FILES})
    counted = dependencies.groupBy("project", "ecosystem").agg(F.count(F.lit(1)).alias("n"))
    return projects.join(counted, ["project", "ecosystem"], "left").select("project", "ecosystem", F.when(F.col("ecosystem").isin(known), "success").otherwise("skipped").alias("status"), F.coalesce("n", F.lit(0)).alias("count"))

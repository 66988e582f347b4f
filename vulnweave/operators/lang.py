"""Languages of projects, from listings of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Language, package manager, priority, signature files.
BASIC = (
    ("java", "maven", 1, "pom.xml build.gradle build.gradle.kts"),
    ("go", "go", 1, "go.mod go.sum"),
    ("rust", "cargo", 1, "Cargo.toml Cargo.lock"),
    ("python", "pip", 1, "requirements.txt setup.py setup.cfg pyproject.toml Pipfile poetry.lock"),
    ("javascript", "npm", 2, "package.json package-lock.json yarn.lock pnpm-lock.yaml"),
    ("ruby", "bundler", 1, "Gemfile Gemfile.lock"),
    ("php", "composer", 1, "composer.json composer.lock"),
    ("csharp", "nuget", 1, ".csproj .sln packages.config"),
    ("c", "conan", 3, "CMakeLists.txt Makefile conanfile.txt conanfile.py"),
    ("cpp", "vcpkg", 3, "CMakeLists.txt vcpkg.json"),
    ("erlang", "rebar3", 1, "rebar.config rebar.lock"),
)

#: Language, package manager, priority, signature files, source extensions, folder patterns.
FULL = (
    ("java", "maven", 1, "pom.xml build.gradle build.gradle.kts gradle.properties", ".java", "src/main/java src/test/java target/classes"),
    ("python", "pip", 1, "requirements.txt setup.py setup.cfg pyproject.toml Pipfile poetry.lock tox.ini .python-version", ".py", "venv env __pycache__ .eggs site-packages"),
    ("go", "go", 1, "go.mod go.sum Gopkg.toml go.yml .go-version", ".go", "vendor go.sum"),
    ("javascript", "npm", 2, "package.json package-lock.json yarn.lock pnpm-lock.yaml .npmrc .yarnrc tsconfig.json jest.config.js", ".js .jsx .ts .tsx .mjs", "node_modules .next dist build"),
    ("typescript", "npm", 2, "tsconfig.json tsconfig.app.json tsconfig.spec.json", ".ts .tsx", "dist .next"),
    ("php", "composer", 1, "composer.json composer.lock phpunit.xml .php-version php.ini wp-config.php", ".php", "vendor node_modules wp-content"),
    ("ruby", "bundler", 1, "Gemfile Gemfile.lock .ruby-version config.ru", ".rb .rake", "vendor bundle"),
    ("rust", "cargo", 1, "Cargo.toml Cargo.lock rustfmt.toml", ".rs", "target src/bin"),
    ("csharp", "nuget", 1, ".csproj .sln packages.config app.config web.config .csharpierrc stylecop.json", ".cs", "bin obj packages"),
    ("kotlin", "gradle", 2, "build.gradle.kts gradle.properties", ".kt .kts", "src/main/kotlin src/test/kotlin"),
    ("swift", "swift", 1, "Package.swift Podfile Cartfile", ".swift", "Pods .build Carthage"),
    ("c", "conan", 3, "CMakeLists.txt Makefile conanfile.txt makefile", ".c .h", "build dist"),
    ("cpp", "vcpkg", 2, "CMakeLists.txt vcpkg.json conanfile.txt", ".cpp .cc .cxx .h .hpp .hxx", "build dist"),
    ("erlang", "rebar3", 1, "rebar.config rebar.lock rebar3.config", ".erl", "_build ebin"),
    ("scala", "sbt", 2, "build.sbt project/build.properties", ".scala", "target project"),
    ("groovy", "gradle", 2, "build.gradle gradle.properties", ".groovy .gradle", "build gradle"),
    ("android", "gradle", 1, "AndroidManifest.xml build.gradle local.properties", ".java .kt", "src/main/res src/androidTest"),
)

#: Folders that no walk enters.
BASIC_SKIP = ".git .svn __pycache__ .pytest_cache node_modules .idea .vscode venv env .env dist build target vendor .gradle .m2".split()
FULL_SKIP = BASIC_SKIP + ".tox eggs .eggs *.egg-info bower_components .angular coverage .next .nuxt Pods Carthage .bundle".split()

#: Files of one extension that make a language without a signature file.
FEWEST_SOURCES = 5


def signatures(spark: SparkSession, full: bool = False) -> DataFrame:
    """ord, language, package_manager, priority, sig_files, source_exts, dir_patterns: a small fixed table."""
    rows = [(i, *r[:3], r[3].split(), *((r[4].split(), r[5].split()) if full else ([], []))) for i, r in enumerate(FULL if full else BASIC)]
    return spark.createDataFrame(rows, "ord int, language string, package_manager string, priority int, sig_files array<string>, source_exts array<string>, dir_patterns array<string>")


def prune(listing: DataFrame, skip: list[str]) -> DataFrame:
    """Without files in or under a folder of one of the names."""
    return listing.where(~F.arrays_overlap(F.split(F.coalesce("rel_dir", F.lit("")), "/"), F.array(*map(F.lit, skip))))


def extension(file: Column) -> Column:
    """The lower-case suffix with its dot, empty if there is none; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(file, r"^.+(\.[^./]+)$", 1))


def _signature_hits(listing: DataFrame, sigs: DataFrame) -> DataFrame:
    long = F.broadcast(sigs.select("ord", "language", "package_manager", "priority", F.posexplode("sig_files").alias("sig_ord", "sig")))
    return listing.join(long, F.col("file") == F.col("sig"))


def _path() -> Column:
    return F.concat_ws("/", F.nullif(F.col("rel_dir"), F.lit("")), "file")


def detect_basic(listing: DataFrame) -> DataFrame:
    """(project, rel_dir, file, seq) -> project, language, package_manager, priority, files, place: one row a language.

    place orders a project's languages by priority, then by the first place in the listing (seq), then by the signatures' order.
    """
    hits = _signature_hits(prune(listing, BASIC_SKIP), signatures(listing.sparkSession))
    found = hits.groupBy("project", "language", "package_manager", "priority", "ord").agg(F.array_sort(F.collect_set(_path())).alias("files"), F.min("seq").alias("first_seen"))
    place = F.row_number().over(Window.partitionBy("project").orderBy("priority", "first_seen", "ord"))
    return found.withColumn("place", place).select("project", "language", "package_manager", "priority", "files", "place")


def detect_full(listing: DataFrame, *, patterns_for_all: bool = False) -> DataFrame:
    """(project, rel_dir, file, seq) -> project, language, package_manager, priority, confidence, feature_files, source_file_count, matched_patterns, score, primary_score, place, is_primary.

    A language with a signature file has high confidence; one of whose extensions has 5 or more files has medium confidence
    and one step less priority. source_file_count is the count of the language's least frequent extension. Folder patterns
    (a folder of the name, or a path that holds it) count for languages without signature files, or for all (patterns_for_all).
    """
    spark = listing.sparkSession
    sigs = signatures(spark, full=True)
    own = prune(listing, FULL_SKIP)
    hits = _signature_hits(own, sigs).groupBy("project", "language").agg(F.countDistinct(_path()).cast("int").alias("feature_files"), F.min("seq").alias("seen"))
    exts = own.withColumn("ext", extension(F.col("file"))).where("ext <> ''").groupBy("project", "ext").agg(F.count(F.lit(1)).cast("int").alias("n"))
    sources = exts.join(F.broadcast(sigs.select("language", F.explode("source_exts").alias("ext"))), "ext").groupBy("project", "language").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    # a walk sees each folder below a visited one as a name, and its own path: both as rows of (project, dir)
    parts = F.split("rel_dir", "/")
    dirs = own.where("rel_dir <> ''").select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir")).distinct()
    patterns = F.broadcast(sigs.select("language", F.explode("dir_patterns").alias("pattern")))
    named = F.element_at(F.split("dir", "/"), -1) == F.col("pattern")
    counted = dirs.join(patterns, named | F.col("dir").contains(F.col("pattern"))).groupBy("project", "language").agg(F.sum(named.cast("int") + F.col("dir").contains(F.col("pattern")).cast("int")).cast("int").alias("patterns"))
    all_ = hits.join(sources, ["project", "language"], "full").join(counted, ["project", "language"], "left")
    all_ = all_.where(F.col("feature_files").isNotNull() | (F.col("most") >= FEWEST_SOURCES)).join(F.broadcast(sigs.select("language", "ord", "package_manager", F.col("priority").alias("base"))), "language")
    sure = F.col("feature_files").isNotNull()
    matched = F.coalesce("patterns", F.lit(0)) if patterns_for_all else F.when(sure, 0).otherwise(F.coalesce("patterns", F.lit(0)))
    out = all_.select(
        "project", "language", "package_manager", (F.col("base") + F.when(sure, 0).otherwise(1)).alias("priority"), F.when(sure, "high").otherwise("medium").alias("confidence"),
        F.coalesce("feature_files", F.lit(0)).alias("feature_files"), F.coalesce("least", F.lit(0)).alias("source_file_count"), matched.alias("matched_patterns"), "ord", F.coalesce(F.when(sure, F.col("seen")), F.lit(1 << 40)).alias("seen"),
    )
    score = 100 * F.col("feature_files") + 5 * F.col("source_file_count") + 50 * F.col("matched_patterns") + F.when(F.col("confidence") == "high", 500).otherwise(200)
    out = out.withColumn("score", score).withColumn("primary_score", score + 50 * (10 - F.col("priority")))
    w = Window.partitionBy("project")
    out = out.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "seen", "ord"))).withColumn("is_primary", F.row_number().over(w.orderBy(F.desc("primary_score"), "seen", "ord")) == 1)
    return out.drop("ord", "seen")


def primary(detected: DataFrame) -> DataFrame:
    """project, language, package_manager of the first language."""
    first = F.col("is_primary") if "is_primary" in detected.columns else F.col("place") == 1
    return detected.where(first).select("project", "language", "package_manager")


def package_manager(detected: DataFrame, asked: DataFrame) -> DataFrame:
    """(project, language) with its package manager, `unknown` if it wasn't detected."""
    return asked.join(detected.select("project", "language", "package_manager"), ["project", "language"], "left").withColumn("package_manager", F.coalesce("package_manager", F.lit("unknown")))


def summary(detected: DataFrame) -> DataFrame:
    """project, languages (in order), text: one line a project."""
    item = F.struct("place", "language", "package_manager")
    grouped = detected.groupBy("project").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return grouped.select("project", F.transform("l", lambda x: x["language"]).alias("languages"), F.array_join(F.transform("l", lambda x: F.concat(x["language"], F.lit(" ("), x["package_manager"], F.lit(")"))), ", ").alias("text"))


def api_confidence(score: Column) -> Column:
    return F.when(score >= 500, "high").when(score >= 200, "medium").otherwise("low")


def supported(language: Column, known: list[str]) -> Column:
    return F.when(language.isin(known), language).otherwise("other")

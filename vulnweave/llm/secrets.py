"""Secret scans: candidates by pattern, false positives removed by a random forest, all in DataFrame functions."""

from __future__ import annotations

import functools
import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import unused

#: Marks around candidates. A text's own are blanks first, one for one, so places stay.
_OPEN, _CLOSE = "\x01", "\x02"

_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"

#: What may be a secret: private key blocks with all their lines and headers (without an END line: up to the last line of base64), passwords in URLs, values given to a telling name, long runs with a digit, well-known forms without one.
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+){0,256}+-----END [A-Z0-9 ]{0,40}-----"
    r"|-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:\s{1,4}(?:[A-Z][A-Za-z-]{1,30}: [^\n]{1,200}+|[A-Za-z0-9+/]{32,}+={0,2})){0,512}+(?:\s{1,4}[A-Za-z0-9+/]{2,}+={1,2})?"
    rf"|(?i:{_NAMES})[A-Za-z0-9_\-]{{0,30}}[\"']?\s{{0,3}}(?:=>|[:=])\s{{0,3}}[\"']?[^\s\"'<>,;]{{6,}}+"
    r"|(?<=://)[^\s:/@\"'<>]{1,100}:[^\s:/@\"'<>]{6,200}(?=@)"
    r"|(?<![A-Za-z0-9_+/=.\-])(?=[A-Za-z_+/=.\-]*+[0-9])[A-Za-z0-9_+/=.\-]{12,}+"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z]{16}(?![A-Za-z0-9])"
)

_VALUE = rf"(?s)^(?:(?i:{_NAMES})[A-Za-z0-9_\-]*[\"']?\s{{0,3}}(?:=>|[:=])\s{{0,3}}[\"']?|(?!-----)[^\s:/@\"'<>]{{1,100}}:)?(.*)$"

_KNOWN = (
    ("private_key", r"^-----BEGIN [A-Z ]*PRIVATE KEY"),
    ("aws_access_key", r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"),
    ("github_token", r"^gh[pousr]_[0-9A-Za-z]{20,}$"),
    ("stripe_key", r"^[sr]k_(?:live|test)_[0-9A-Za-z]{16,}$"),
    ("slack_token", r"^xox[abprs]-[0-9A-Za-z-]{10,}$"),
    ("google_key", r"^AIza[0-9A-Za-z_-]{30,}$"),
    ("jwt", r"^eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\."),
)

#: Word parts whose share of a candidate tells names and prose from keys.
_DICTIONARY = "example|change|your|here|test|user|name|admin|mail|image|file|index|page|version|release|build|config|default|sample|dummy|placeholder|null|none|true|false|http|html|json|utf|com|org|net|www|src|main|get|set|data|time|date|the|and|ing|tion|ment|ver|ent|pass|word|key|secret|token|xxx|abc|123456|img|png|jpg|node|module|package|lib"

_COMMON_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"

_UP, _LOW, _NUM = string.ascii_uppercase, string.ascii_lowercase, string.digits

FEATURES = ("size", "digits", "upper", "lower", "changes", "pairs", "dictionary", "distinct", "entropy", "named", "assigned", "known", "denied", "hexadecimal", "path")


def _features(value: Column, before: Column, match: Column, path: Column) -> list[Column]:
    """A candidate's features: length, character transitions, dictionary coverage, the words before it, its path."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    short, m, low = value, n, F.lower(value)
    share = lambda left: (m - F.length(left)) / m
    kinds = F.regexp_replace(F.translate(short, _UP + _LOW + _NUM, "A" * 26 + "a" * 26 + "0" * 10), r"([Aa0])\1+", "$1")
    chars = F.filter(F.split(short, ""), lambda c: c != "")
    part = lambda c: (m - F.length(F.replace(short, c, F.lit("")))) / m
    near = F.lower(F.concat(F.substring(before, -40, 40), match))
    return [
        n,
        share(F.regexp_replace(short, "[0-9]", "")),
        share(F.regexp_replace(short, "[A-Z]", "")),
        share(F.regexp_replace(short, "[a-z]", "")),
        F.length(kinds) / m,
        2 * (m - F.length(F.regexp_replace(low, _COMMON_PAIRS, "-"))) / m,
        share(F.regexp_replace(low, _DICTIONARY, "")),
        F.size(F.array_distinct(chars)) / m,
        F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - part(c) * F.log2(part(c))),
        F.when(near.rlike(_NAMES.replace("auth|", "auth[a-z]*|")), 1.0).otherwise(0.0),
        F.when(F.length(match) > F.length(value), 1.0).otherwise(F.when(F.substring(before, -8, 8).rlike(r"[:=]\s*[\"'`]?$"), 0.5).otherwise(0.0)),
        F.when(value.rlike("|".join(p for _, p in _KNOWN)), 1.0).otherwise(0.0),
        F.when(near.rlike(r"commit|sha-?\d|md5|checksum|digest|revision|uuid|guid|image|base64,|href|src=|version|integrity|https?:|order|phone|card|isbn|build"), 1.0).otherwise(0.0),
        F.when(value.rlike("^[0-9a-fA-F]+$"), 1.0).otherwise(0.0),
        F.when(F.lower(F.coalesce(path, F.lit(""))).rlike(r"test|example|sample|fixture|docs?/|lock|\.min\.|vendor"), 1.0).otherwise(0.0),
    ]


def labelled_findings(n: int = 1800, seed: int = 11) -> list[dict]:
    """Labelled findings: made keys and passwords in their usual places, and what looks like them but isn't."""
    r = random.Random(seed)
    take = lambda chars, k: "".join(r.choices(chars, k=k))
    word = lambda: take(_LOW, r.randint(2, 8))
    hexes, alnum = "0123456789abcdef", _UP + _LOW + _NUM
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6))) + " "
    name = lambda: r.choice(["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "SECRET_KEY", "auth_token", "pwd", "client_secret", "AWS_SECRET_ACCESS_KEY"])
    glue = lambda: r.choice([" = \"", "=", ": ", ":", "=\"", " = '", "' => '"])
    key = lambda: r.choice([take(hexes, r.choice([18, 24, 32, 40, 64])), take(alnum, r.randint(16, 44)), take(alnum + "+/", 40), take(alnum + "_-", r.randint(20, 40)), take(alnum + "!@#%^&*", r.randint(8, 20))])
    def block():
        kind, end = r.choice([("RSA ", ""), ("EC ", ""), ("", ""), ("ENCRYPTED ", ""), ("OPENSSH ", ""), ("PGP ", " BLOCK")])
        head = r.choice(["", "", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{take(hexes.upper(), 32)}\n\n", "Version: x\n\n"])
        lines = "\n".join(take(alnum + "+/", 64) for _ in range(r.choice([1, 1, 2, 5, 13, 26])))
        return f"-----BEGIN {kind}PRIVATE KEY{end}-----\n{head}{lines}" + r.choice([f"\n-----END {kind}PRIVATE KEY{end}-----"] * 3 + [""])

    form = lambda: r.choice(["AKIA" + take(_UP + _NUM, 16), "ghp_" + take(alnum, 36), "sk_live_" + take(alnum, 24), "xoxb-" + take(_NUM, 11) + "-" + take(alnum, 24), "AIza" + take(alnum + "_-", 35), "eyJ" + take(alnum, 20) + ".eyJ" + take(alnum, 40) + "." + take(alnum + "_-", 43), block()])
    address = lambda: r.choice(["https", "postgres", "mysql", "redis", "ftp", "amqp"]) + "://" + word() + ":"

    def good():
        if r.random() < 0.08:
            return prose() + address(), take(alnum + "!$%^*", r.randint(8, 20))
        if r.random() < 0.35:
            return prose() + r.choice(["", name() + glue()]), form()
        return prose() + name() + glue(), key()

    def bad():
        kind = r.randrange(15)
        if kind == 0:
            return prose() + r.choice(["", "card ", "", "order "]), take(_NUM, r.choice([13, 15, 16, 16, 16, 19]))
        if kind == 1:
            return prose() + r.choice(["commit ", "sha1: ", "sha256:", "md5 ", "revision ", "checksum = "]), take(hexes, r.choice([32, 40, 64]))
        if kind == 2:
            return prose() + r.choice(["id ", "uuid: ", ""]), "-".join(take(hexes, k) for k in (8, 4, 4, 4, 12))
        if kind == 3:
            return prose() + r.choice(["", f"{word()}.{take(_NUM, 2)}@"]), r.choice(["mail", "www", "host"]) + take(_NUM, 1) + "." + r.choice(["example", word()]) + "." + r.choice(["com", "org", "net"])
        if kind == 4:
            return prose() + name() + glue(), r.choice(["changeme123", "your_password_here", "example-token-1", "xxxxxxxxxxxx", "your-api-key-1234", "placeholder1", "default_secret_1", "test1234test", "none_set_here", "process.env.TOKEN", "password123", "os.environ", "getPassword()", "********"])
        if kind == 5:
            return prose(), "-".join([take("12", 1) + take(_NUM, 3), "0" + take("123456789", 1), take("12", 1) + take(_NUM, 1)]) + "T10:" + take("12345", 1) + take(_NUM, 1) + r.choice(["", "Z"])
        if kind == 6:
            return prose(), f"{word()}_{word()}_{word()}_{take(_NUM, r.randint(1, 3))}"
        if kind == 7:
            return prose() + r.choice(["src=", "href=\"", "image "]), f"/{word()}/{word()}/{word()}-{take(_NUM, 3)}." + r.choice(["png", "html", "js"])
        if kind == 8:
            return prose() + "version ", f"{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 999)}-{word()}.{r.randint(0, 99)}"
        if kind == 9:
            return prose(), r.choice(["192.168.", "10.0.", "172.16."]) + f"{r.randint(100, 255)}.{r.randint(100, 255)}"
        if kind == 10:
            return prose(), word() + word() + take(_NUM, r.randint(1, 2)) + word()
        if kind == 11:
            return prose() + r.choice(["token: ", "secret: ", "password: "]), r.choice(["forgotten", "required", "invalid", "expired.", "optional", "rotation", "protected"])
        if kind == 12:
            return prose() + "data:image/png;base64,", take(alnum + "+/", r.randint(40, 80))
        if kind == 13:
            return prose() + address(), r.choice(["password", "changeme", "secret", "your_password", "example", "xxxxxxxx", "placeholder"])
        return prose() + r.choice(["phone ", "", "+"]), "-".join([take(_NUM, 3), take(_NUM, 3), take(_NUM, 4)])

    out = []
    for i in range(n):
        label = i % 2
        before, value = (good if label else bad)()
        path = r.choice(["src3", "src0", "src/app.py", "config/settings.yml", "web/index.js"]) if label else r.choice(["src3", "src0", "tests/test_app.py", "docs/readme.md", "package-lock.json", "src/app.py"])
        after = f"@{word()}.net/" if "://" in before else r.choice(["\" ", " ", "' ", "\n"])
        out.append({"text": before + value + after + word(), "path": path, "at": len(before), "label": label})
    return out


def _tree(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int):
    """A leaf (share of secrets) or (feature, bound, tree up to it, tree beyond it)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return round(share, 4)
    best = (1e-9, None)
    for f in r.choice(x.shape[1], 5, replace=False):
        for bound in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
            low = x[:, f] <= bound
            n = low.sum()
            if 4 <= n <= len(y) - 4:
                gini = lambda p: 2 * p * (1 - p)
                gain = gini(share) - (n * gini(y[low].mean()) + (len(y) - n) * gini(y[~low].mean())) / len(y)
                if gain > best[0]:
                    best = (gain, (int(f), float(bound), low))
    if best[1] is None:
        return round(share, 4)
    f, bound, low = best[1]
    return f, round(bound, 6), _tree(x[low], y[low], r, depth - 1), _tree(x[~low], y[~low], r, depth - 1)


@functools.cache
def train(trees: int = 20, depth: int = 6, seed: int = 5) -> tuple:
    """The forest, from the labelled findings; their features come from the very expressions that the scan uses."""
    spark = SparkSession.getActiveSession()
    findings = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(labelled_findings())), "array<struct<text:string,path:string,at:int,label:int>>")))
    rows = findings.select("label", "at", F.explode(_candidates(_parts(F.col("text")), F.col("path"))).alias("c")).select("label", "at", "c.*").where("start >= at - 1").collect()
    x, y = np.array([[r[f] for f in FEATURES] for r in rows], float), np.array([r["label"] for r in rows], float)
    r = np.random.default_rng(seed)
    return tuple(_tree(x[own], y[own], r, depth) for own in (r.integers(0, len(y), len(y)) for _ in range(trees)))


def _probability(forest: tuple, features: Column) -> Column:
    def leaf(tree):
        if isinstance(tree, float):
            return F.lit(tree)
        return F.when(features[FEATURES[tree[0]]] <= tree[1], leaf(tree[2])).otherwise(leaf(tree[3]))

    return sum((leaf(t) for t in forest[1:]), leaf(forest[0])) / len(forest)


def _parts(text: Column) -> Column:
    """The text cut before each candidate; each part but the first is the candidate, a mark and what follows."""
    return F.split(F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "  "), f"(?:{CANDIDATE})", f"{_OPEN}$0{_CLOSE}"), _OPEN)


def _struct_of(i: Column, parts: Column, starts: Column, path: Column) -> Column:
    match = F.substring_index(parts[i], _CLOSE, 1)
    value = F.rtrim(F.regexp_extract(match, _VALUE, 1), F.lit(".,;:)]}"))
    raw = F.regexp_extract(match, _VALUE, 1)
    before = F.substring(F.replace(parts[i - 1], F.lit(_CLOSE), F.lit("")), -60, 60)
    base = F.struct(match.alias("match"), value.alias("value"), before.alias("before"), (starts[i] + F.length(match) - F.length(raw)).cast("long").alias("start"), F.length(value).cast("long").alias("length"))
    return base


#: Parts whose lengths are added up together when the places of candidates are found.
_CHUNK = 64


def _starts(parts: Column) -> Column:
    """The number of characters before each part. Sums are kept for each _CHUNK parts, so work stays near to linear in their number."""
    size = F.transform(parts, lambda x: F.length(F.replace(x, F.lit(_CLOSE), F.lit(""))))
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    chunks = lambda n: F.transform(F.sequence(F.lit(0), (F.size(n) / _CHUNK).cast("int")), lambda c: add(F.slice(n, c * _CHUNK + 1, F.lit(_CHUNK))))
    before = lambda n: F.aggregate(chunks(n), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    bound = F.transform(F.transform(F.array(size), lambda n: F.struct(n.alias("n"), before(n).alias("b"))), lambda h: F.transform(h["n"], lambda _, i: h["b"][(i / _CHUNK).cast("int")] + add(F.slice(h["n"], (i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK))))
    return bound[0]


def _candidates(parts: Column, path: Column) -> Column:
    """array<struct<match, value, before, start, length, features...>> of a text's parts; start and length are in characters."""
    held = F.transform(F.array(F.struct(parts.alias("p"))), lambda h: F.struct(h["p"].alias("p"), _starts(h["p"]).alias("s")))
    return F.transform(held, lambda h: F.when(F.size(h["p"]) > 1, F.transform(F.sequence(F.lit(1), F.size(h["p"]) - 1), lambda i: F.transform(F.array(_struct_of(i, h["p"], h["s"], path)), lambda b: F.struct(b["match"].alias("match"), b["value"].alias("value"), b["before"].alias("before"), b["start"].alias("start"), b["length"].alias("length"), *(f.alias(n) for f, n in zip(_features(b["value"], b["before"], b["match"], path), FEATURES, strict=True))))[0])))[0]


def _kind(c: Column) -> Column:
    kind = F.when(F.length(c["match"]) > F.length(c["value"]), "assigned").otherwise("run")
    for name, pattern in reversed(_KNOWN):
        kind = F.when(c["value"].rlike(pattern), name).otherwise(kind)
    return kind


def findings(docs: DataFrame, *, path_col: str = "source", least: float = 0.5) -> DataFrame:
    """doc_id, start, length (characters), kind, secret, score, is_secret of every candidate; is_secret: the forest's share of votes is `least` or more.

    Native throughout: one pass of a regular expression marks candidates, higher-order functions take their features, the
    trees are conditional expressions. Null or empty text: no row. Null doc_id or path: kept. Repeated rows: their findings
    repeat. Whole texts count. Empty table: no rows. Other columns are ignored.
    """
    forest = train()
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), _parts(F.col("text")).alias("parts")).select("doc_id", F.explode(_candidates(F.col("parts"), F.col("path"))).alias("c"))
    return marked.select("doc_id", F.col("c.start").alias("start"), F.col("c.length").alias("length"), _kind(F.col("c")).alias("kind"), F.col("c.value").alias("secret"), F.round(_probability(forest, F.col("c")), 6).alias("score")).withColumn("is_secret", F.col("score") >= least)


def redact(docs: DataFrame, *, path_col: str = "source", least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced by `mark`; all other texts, rows and columns stay as they are, whatever their names.

    Null or empty text: as it is. Repeated rows: changed alike. Empty table: no rows.
    """
    forest = train()
    row, parts, found = (unused(docs, n) for n in ("row", "parts", "found"))
    held = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias(row))
    text = F.col(row)["text"].cast("string")
    held = held.withColumn(parts, _parts(text)).withColumn(found, _candidates(F.col(parts), F.col(row)[path_col].cast("string")))
    held = held.withColumn(found, F.transform(F.col(found), lambda c: F.struct(c["match"].alias("match"), c["value"].alias("value"), c["start"].cast("int").alias("start"), c["length"].cast("int").alias("length"), (_probability(forest, c) >= least).alias("secret"))))
    # each part of the text begins with its candidate, so the cleaned text is made part by part
    plain = lambda p: F.replace(p, F.lit(_CLOSE), F.lit(""))
    lead = lambda c: F.length(c["match"]) - F.length(F.regexp_extract(c["match"], _VALUE, 1))
    clean = lambda p, c: F.when(c["secret"], F.concat(F.substring(c["match"], F.lit(1), lead(c)), F.lit(mark), F.substring(plain(p), lead(c) + c["length"] + 1, F.length(p)))).otherwise(plain(p))
    joined = F.concat(F.col(parts)[0], F.array_join(F.zip_with(F.slice(F.col(parts), F.lit(2), F.size(parts)), F.col(found), clean), ""))
    # the marks of candidates stand for characters that a text may have itself: such texts are cut by place
    own = F.filter(F.col(found), lambda c: c["secret"])
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, c: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, c["start"] - a["at"]), F.lit(mark)).alias("out"), (c["start"] + c["length"]).alias("at"))
    placed = F.aggregate(own, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    cleaned = F.when(F.exists(F.col(found), lambda c: c["secret"]), F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), placed).otherwise(joined)).otherwise(text)
    return held.select(*[(cleaned if c == "text" else F.col(row)[c]).alias(c) for c in docs.columns])

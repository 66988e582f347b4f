"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import functools
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
_IN_HEAD = frozenset("head title meta link base script style noscript template basefont bgsound".split())
_DROPPED = frozenset("head script style noscript template iframe form button select option textarea svg canvas object audio video map dialog".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if kind.lower() == "hidden" or kind.lower() == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.append("hidden")
        elif kind.lower() != "style":
            out += dict.fromkeys(p.lower() for p in _PARTS.findall(value))
    return tuple(out)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of ancestors, text, characters inside links) of each leaf block with text, in page order.

    The path holds tags and, as `.x`, parts of their classes, ids and roles. Void and unclosed tags, a new p within a p,
    and raw-text elements are taken as browsers take them. Parts that never hold an article's text (head, forms, scripts,
    styles) give no block.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []
    found, pieces, linked, dropped, link = [], [], 0, 0, 0
    at, n, low, in_head = 0, len(page), None, False

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append((tuple(x for t, names in stack if t not in _INLINE for x in (t, *names)), text, linked))
            pieces.clear()
        linked = 0

    def pop():
        nonlocal dropped, link
        tag = stack.pop()[0]
        dropped -= tag in _DROPPED
        link -= tag == "a"

    def end_head():
        """The first text or element of the body ends the head, whether or not there is a body tag."""
        nonlocal in_head
        while any(t == "head" for t, _ in stack):
            pop()
        in_head = False

    while at < n:
        m = _TAG.search(page, at)
        upto = m.start() if m else n
        if in_head and page[at:upto].strip():
            end_head()
        if upto > at and not dropped:
            pieces.append(page[at:upto])
            linked += (upto - at) * (link > 0)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(t == tag for t, _ in stack):
                if tag not in _INLINE:
                    flush()
                while stack[-1][0] != tag:
                    if tag in _INLINE and stack[-1][0] not in _INLINE:
                        break
                    pop()
                if stack[-1][0] == tag:
                    pop()
            elif tag not in _INLINE:
                flush()
            continue
        if tag in _VOID:
            if in_head and tag not in _IN_HEAD:
                end_head()
            if tag not in _INLINE:
                flush()
            elif not dropped:
                pieces.append(" " if tag in ("br", "img") else "")
            continue
        if tag in _RAW:
            if low is None:
                low = page.lower() if page.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), page)
            end = low.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
            continue
        if in_head and tag not in _IN_HEAD:
            end_head()
        if tag not in _INLINE:
            flush()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] not in _INLINE:
                        break
            if tag in _SCOPE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in _SCOPE[tag]:
                        break
        elif tag == "a":
            link += 1
        if not m[3].rstrip().endswith("/") or tag in _INLINE or tag in _CLOSES_P:
            stack.append((tag, _names(m[3]) if m[3] and tag not in _INLINE else ()))
            dropped += tag in _DROPPED
            in_head |= tag == "head"
    flush()
    return found


#: Hashed features of a block.
FEATURES = 1 << 14


def _number(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


@functools.lru_cache(100_000)
def _path_features(path: tuple[str, ...]) -> tuple[int, ...]:
    """Each ancestor tag and each part of its names, wherever it stands, and the innermost tag."""
    tags = [x for x in path if not x.startswith(".")]
    return tuple(sorted({_number("up:" + x) for x in path} | {_number("in:" + tags[-1] if tags else "in:")}))


@functools.cache
def _fixed(name: str) -> int:
    return _number(name)


_NOTICE = re.compile(r"cookie|subscrib|newsletter|copyright|©|all rights|privacy|terms of|sign up|log ?in|share this|advert|sponsor|related|read more|comment|reply|posted by|follow us", re.I)


def block_features(path: tuple[str, ...], text: str, linked: int) -> tuple[int, ...]:
    """Ancestor-tag and text features of a block."""
    n = len(text)
    density = linked / max(1, n)
    return (*_path_features(path), _fixed(f"len:{min(9, n.bit_length())}"), _fixed(f"link:{min(4, int(density * 4 + 0.5))}"), _fixed(f"end:{text[-1] in '.!?…:;\"”»)'}"), _fixed(f"commas:{min(3, text.count(','))}"), _fixed(f"notice:{bool(n < 300 and _NOTICE.search(text))}"), _fixed("bias"))


def labelled_pages(n: int = 360, seed: int = 3) -> list[list[tuple[tuple[int, ...], int]]]:
    """Made pages of many layouts: for each block its features and 1 if it is of the article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("etaoinshrdlucmfwypvbgk", k=r.randint(1, 9)))

    def prose(low: int, high: int) -> str:
        out = []
        for _ in range(r.randint(low, high)):
            out.append((" ".join(word() + ("," if r.random() < 0.1 else "") for _ in range(r.randint(3, 16)))).capitalize() + r.choice([".", ".", ".", "?", "!"]))
        return " ".join(out)

    short = lambda: " ".join(word() for _ in range(r.randint(1, 5)))
    links = lambda k: "<ul>" + "".join(f"<li><a href='/{word()}'>{short()}</a></li>" for _ in range(k)) + "</ul>"
    mark = "\x03"  # stands in the article's blocks only and is taken out again

    def body() -> str:
        out = [f"<h1>{mark}{short()}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.2:
            out.append(f"<p>{mark}<b>{prose(1, 2)}<br><p>{mark}{prose(1, 4)}</p>")
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.66:
                out.append(f"<p>{mark}{prose(1, 6)}" + (f" <a href='#'>{short()}</a> {prose(1, 2)}" if r.random() < 0.25 else "") + "</p>")
            elif kind < 0.74:
                out.append(f"<h{r.choice('2234')}>{mark}{short()}</h2>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>{mark}{short()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.84:
                out.append(f"<blockquote><p>{mark}{prose(1, 3)}</p></blockquote>")
            elif kind < 0.87:
                out.append(f"<pre>{mark}{short()} = {short()};</pre>")
            elif kind < 0.9:
                out.append(f"<table><tr><td>{mark}{short()}</td><td>{mark}{short()}</td></tr></table>")
            elif kind < 0.92:
                out.append(f"<figure><img src=x><figcaption>{mark}{short()}</figcaption></figure>")
            elif kind < 0.95:
                out.append(f"<p>{mark}{short()}</p>")
            elif kind < 0.975:
                out.append(f"<div class='{r.choice(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad'])}'>{prose(1, 2)}</div>")
            else:
                out.append(f"<div class='{r.choice(['share', 'social', 'related-posts', 'newsletter', 'subscribe'])}'>{r.choice([short(), links(3), 'Share this'])}</div>")
        return "".join(out)

    def boiler(kind: str) -> str:
        own = r.choice([short(), prose(1, 2), links(r.randint(1, 7)), f"<p>{prose(1, 3)}</p>"])
        if kind == "nav":
            return r.choice(["<nav>{}</nav>", "<div class='menu'>{}</div>", "<ul class='nav navbar'>{}</ul>", "<div id='navigation'>{}</div>", "<div role='navigation'>{}</div>", "<div class='breadcrumbs'>{}</div>"]).format(links(r.randint(2, 8)))
        if kind == "header":
            return r.choice(["<header>{}</header>", "<div class='header'>{}</div>", "<div id='masthead'>{}</div>", "<div id='site-header'>{}</div>", "<div role='banner'>{}</div>"]).format(r.choice([own, f"<h1>{short()}</h1>", f"<p>{short()}</p>"]))
        if kind == "footer":
            return r.choice(["<footer>{}</footer>", "<div class='footer'>{}</div>", "<div id='site-footer'>{}</div>", "<div class='copyright'>{}</div>", "<div role='contentinfo'>{}</div>"]).format(r.choice([own, f"&copy; {word()}.example.net &middot; {prose(1, 1)}", f"<p>Copyright 2020 {short()}</p>"]))
        if kind == "aside":
            return r.choice(["<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div id='side-bar'>{}</div>", "<section class='related'>{}</section>", "<div class='widget'>{}</div>", "<div role='complementary'>{}</div>", "<div class='recommended'>{}</div>"]).format(r.choice([own, f"<h3>{short()}</h3>{links(4)}", f"<h2>{short()}</h2><p>{prose(1, 4)}</p>"]))
        if kind == "ad":
            return r.choice(["<div class='ad'>{}</div>", "<div class='ads'>{}</div>", "<div id='ad-top'>{}</div>", "<section class='advert'>{}</section>", "<div class='advertisement'>{}</div>", "<div class='sponsored'>{}</div>", "<div class='promo'>{}</div>", "<ins class='adsby'>{}</ins>"]).format(r.choice([prose(1, 3), f"<p>{prose(1, 3)}</p>", f"<a href='/x'>{short()}</a>"]))
        if kind == "notice":
            return r.choice(["<div class='cookie-notice'>{}</div>", "<div class='notice'>{}</div>", "<div id='cookie-banner'>{}</div>", "<div class='alert'>{}</div>", "<div class='popup modal'>{}</div>", "<div class='consent gdpr'>{}</div>", "<div class='newsletter subscribe'>{}</div>", "<div role='alert'>{}</div>", "<div class='disclaimer'>{}</div>"]).format(r.choice([f"<p>{prose(1, 3)}</p>", prose(1, 3), "We use cookies."]))
        if kind == "form":
            return f"<form><label>{short()}</label><input name=q><button>{short()}</button></form>"
        one = lambda: r.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li class='comment'><span class='author'>{}</span><p>{}</p></li>", "<article class='comment'><h4>{}</h4><p>{}</p></article>", "<div class='reply'>{}<p>{}</p></div>"]).format(word(), prose(1, 5))
        return r.choice(["<section class='comments'>{}</section>", "<div id='comments'><h3>Comments</h3>{}</div>", "<ol class='comment-list'>{}</ol>", "<div class='discussion responses'>{}</div>", "<div id='disqus_thread'>{}</div>", "<section id='reader-comments'><h2>Comments</h2>{}</section>"]).format("".join(one() for _ in range(r.randint(1, 5))))

    def page() -> str:
        wrap = r.choice(["<article>{}</article>"] * 3 + ["<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<div id='content'><div class='post'>{}</div></div>", "<div class='article-body'>{}</div>", "<div class='entry-content'>{}</div>", "<section class='story'>{}</section>", "<div role='main'>{}</div>", "<div class='wrapper'><div class='main'>{}</div></div>", "<div class='container'><article class='post'><div class='text'>{}</div></article></div>", "<div>{}</div>", "{}"])
        inside = body()
        if r.random() < 0.25:
            inside += boiler(r.choice(["comments", "ad", "aside", "notice", "footer"]))
        if r.random() < 0.1:
            inside = boiler(r.choice(["ad", "notice", "header"])) + inside
        before = [boiler(k) for k in r.choices(["nav", "header", "ad", "notice", "form", "aside"], k=r.randint(0, 4))]
        after = [boiler(k) for k in r.choices(["footer", "comments", "aside", "ad", "notice", "nav", "form"], k=r.randint(0, 4))]
        return "<html><head><title>x</title></head><body>" + "".join(before) + wrap.format(inside) + "".join(after) + "</body></html>"

    out = []
    for _ in range(n):
        rows = [(block_features(path, text.replace(mark, "").strip() or "x", linked), int(mark in text)) for path, text, linked in blocks(page())]
        if rows:
            out.append(rows)
    return out


@functools.cache
def train(rounds: int = 14, rate: float = 0.3, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(weights of features for `article`, transitions): conditional log-likelihood of the labelled pages, by Adagrad.

    Transitions: before x after, and as a third row the first block's.
    """
    pages, order = labelled_pages(), random.Random(seed)
    w, t = np.zeros(FEATURES), np.zeros((3, 2))
    seen_w, seen_t = np.full(FEATURES, 1e-6), np.full((3, 2), 1e-6)
    for _ in range(rounds):
        order.shuffle(pages)
        for rows in pages:
            score = np.zeros((len(rows), 2))
            score[:, 1] = [w[list(f)].sum() for f, _ in rows]
            n, label = len(rows), [y for _, y in rows]
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = score[0] + t[2]
            for i in range(1, n):
                forward[i] = score[i] + np.logaddexp(forward[i - 1, 0] + t[0], forward[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                ahead = score[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(t[:2, 0] + ahead[0], t[:2, 1] + ahead[1])
            total = np.logaddexp(*forward[-1])
            chance = np.exp(forward + backward - total)
            slope_t = np.zeros((3, 2))
            slope_t[2] = -chance[0]
            slope_t[2, label[0]] += 1
            for i in range(1, n):
                slope_t[:2] -= np.exp(forward[i - 1][:, None] + t[:2] + (score[i] + backward[i])[None] - total)
                slope_t[label[i - 1], label[i]] += 1
            seen_t += slope_t**2
            t += rate * slope_t / np.sqrt(seen_t)
            slope = np.zeros(FEATURES)
            for i, (f, y) in enumerate(rows):
                slope[list(f)] += y - chance[i, 1]
            own = np.flatnonzero(slope)
            seen_w[own] += slope[own] ** 2
            w[own] += rate * slope[own] / np.sqrt(seen_w[own])
    return w, t


def main_text(page: str | None, model: tuple[np.ndarray, np.ndarray]) -> str:
    """The article's blocks by Viterbi, joined by blank lines."""
    rows = blocks(page or "")
    if not rows:
        return ""
    w, t = model
    (a, b), (c, d), (stay0, stay1) = t.tolist()
    low, high, back = stay0, stay1 + float(w[list(block_features(*rows[0]))].sum()), []
    for row in rows[1:]:
        own = float(w[list(block_features(*row))].sum())
        back.append((low + a < high + c, low + b < high + d))
        low, high = max(low + a, high + c), own + max(low + b, high + d)
    state = high > low
    kept = [state]
    for step in reversed(back):
        state = step[state]
        kept.append(state)
    return "\n\n".join(text for (_, text, _), keep in zip(rows, reversed(kept), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Null or empty html, or no block of an article: empty text. Null page_id or url: kept. Repeated rows: one result each.
    Ties between states: not article. Whole pages count, whatever their length. Empty table: no rows. Other columns are ignored.
    """
    model = train()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            out = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), rows, "page_id long, url string, text string, n_chars long")

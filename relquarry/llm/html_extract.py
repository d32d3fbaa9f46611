"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of text runs and tags. A run's words score positive, by the
weight of the context that it stands in; tags score negative. The contiguous part with
the largest sum, found in one scan, is the content region; its text is returned without
the parts that are never content (menus, adverts, forms, scripts and the like). The words
of such parts score nothing, and their tags nothing inside an article or main part, so
that a box which is taken out anyway doesn't split the region.

Weights are log odds from labelled pages: pages whose words are marked as content or not.
``LABELLED`` makes some from templates, with the page parts that sites use; a caller may
fit weights on others with ``fit``. A context is the innermost element that says what
its content is for: by its tag, its role, or a name in its class or id. A name of several
parts (``site-footer``) counts only where every part is a listed word. A header inside an
article or main part is its own, with its title, and belongs to it.

Defined results. Null or empty page, or one without content: empty text. Cut-off pages:
what is there. Blocks join by one line feed, white space inside a block is one space,
character references are decoded. Very long pages: whole, in linear time. Repeated rows:
each by itself. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, prepare, slices, spread

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_HINTS = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?:[\s=>/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
RAW = {"script", "style", "noscript", "template", "svg", "math", "textarea", "title", "iframe", "object", "canvas", "xmp", "noembed"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that say what is in them; others inherit.
PARTS = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "button": "form", "select": "form", "input": "form", "dialog": "notice", "article": "article", "main": "main", "head": "meta"}
_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip topbar",
    "head": "header masthead banner logo branding",
    "foot": "footer copyright colophon",
    "side": "sidebar aside related recommended widget trending popular promo",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert toast newsletter subscribe paywall signup",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors banner-ad adsense dfp",
    "form": "form search login share sharing social",
    "comments": "comment comments disqus respond replies",
    "article": "article post-content entry-content post-body article-body content-body",
    "main": "content main",
}
HINT = {w: k for k, ws in _WORDS.items() for w in ws.split()}
#: Words that say nothing by themselves in a name of several parts.
_PLAIN = set("site page global primary secondary top bottom left right upper lower inner outer container wrapper wrap box block bar section area list item items links link slot unit group panel region row col column post entry blog news reader user the js main content article story button buttons icons media inline sticky fixed mobile desktop small large new first last".split())
_OWN = {"post", "entry", "article", "story", "content"}
_ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "main": "main", "article": "article"}
#: Kinds that stay out even inside the region.
NEVER = {"menu", "head", "foot", "side", "notice", "ad", "form", "comments", "meta"}


def _named(name: str) -> str | None:
    """What a class or id says."""
    if kind := HINT.get(name):
        return kind
    parts = re.split(r"[-_]+", name)
    if len(parts) == 1:
        return None
    parts = [p for p in parts if p and not p.isdigit()]
    kinds = [HINT[p] for p in parts if p in HINT]
    if not kinds or not all(p in HINT or p in _PLAIN for p in parts):
        return None
    out = next((k for k in kinds if k in NEVER), kinds[0])
    return None if out == "head" and not _OWN.isdisjoint(parts) else out


def kind_of(tag: str, markup: str) -> str | None:
    """What an element says that it holds."""
    if " " in markup or "\n" in markup or "\t" in markup:
        if _HIDDEN.search(markup):
            return "notice"
        for name, a, b, c in _HINTS.findall(markup):
            value = (a or b or c).lower()
            if name.lower() == "role":
                if value in _ROLES:
                    return _ROLES[value]
            elif tag not in ("body", "html"):
                for w in value.split():
                    if k := _named(w):
                        return k
    return PARTS.get(tag)


class Weights:
    """word: points for a word by context; tag: points for a tag; inner: for one inside an article or main part, so that tables and pictures there outweigh no words."""

    def __init__(self, word: dict[str, float], tag: float, inner: float = -1e-6):
        self.word, self.tag, self.inner = word, tag, inner


def runs(html: str):
    """Text runs and tags in page order: (context, text or None for a tag, whether a block ends before it, whether it is of a box inside an article or main part)."""
    stack: list[tuple[str, str, bool]] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name in the stack

    def close(k: int) -> tuple[str, bool]:
        """Context before the element at k, which ends with all that it holds."""
        before = stack[k][1:]
        for name, _, _ in stack[k:]:
            places[name].pop()
        del stack[k:]
        return before

    context, boxed, at, n, low = "page", False, 0, len(html), None
    new_block = True
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            if html.find("<", at) >= 0 and re.search(r"<[a-zA-Z!/?]?$", html[at:]):
                yield context, html[at : html.rfind("<")], new_block, boxed
            else:
                yield context, html[at:], new_block, boxed
            return
        if m.start() > at:
            yield context, html[at : m.start()], new_block, boxed
            new_block = False
        at, token = m.end(), m[0]
        name = _NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        own = None
        if token[1] != "/" and tag not in VOID and tag not in RAW and not token.endswith("/>"):
            own = kind_of(tag, token)
            if own == "head" and context in ("article", "main"):
                own = None
        # a box's first tag is of the box
        yield context, None, tag in BLOCK, boxed or own in NEVER and context in ("article", "main")
        new_block = new_block or tag in BLOCK
        if tag == "br":
            yield context, " ", False, boxed
        if token[1] == "/":
            if places.get(tag):
                context, boxed = close(places[tag][-1])
        elif tag in RAW and not token.endswith("/>"):
            low = low if low is not None else html.lower()
            end = low.find("</" + tag, at)
            if end >= 0:
                at = end
            elif tag not in ("svg", "math", "object", "canvas"):
                return
        elif tag not in VOID and not token.endswith("/>"):
            if tag in ("p", "li", "dd", "dt", "option", "tr", "td", "th"):  # these end their like by themselves
                for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if stack[k][0] == tag:
                        context, boxed = close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "blockquote"):
                        break
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, context, boxed))
            # what is never content stays so in all that it holds
            if own and (context not in NEVER):
                boxed = own in NEVER and context in ("article", "main")
                context = own if not (own == "main" and context == "article") else context


def _settled(html: str):
    """Runs, with text outside of a page's article or main part told from text of a page that has neither."""
    found = list(runs(html))
    if any(c in ("article", "main") for c, _, _, _ in found):
        found = [("outside" if c == "page" else c, t, b, x) for c, t, b, x in found]
    return found


def best_region(gains: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the largest positive sum, the first of equal ones; (0, 0) if there is none."""
    best = total = 0.0
    start = first = last = 0
    for i, gain in enumerate(gains):
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def main_text(html: str | None, weights: Weights) -> str:
    """Blocks of the best region, one line each."""
    found = _settled(html or "")
    word, tag = weights.word, {"article": weights.inner, "main": weights.inner}

    def gain(context: str, text: str | None, boxed: bool) -> float:
        if boxed or text is not None and context in NEVER:
            return 0.0
        return tag.get(context, weights.tag) if text is None else word.get(context, 0.0) * len(text.split())

    first, last = best_region([gain(c, t, boxed) for c, t, _, boxed in found])
    blocks: list[str] = []
    now: list[str] = []
    for context, text, block, _ in found[first:last]:
        if block and now:
            blocks.append("".join(now))
            now = []
        if text and context not in NEVER:
            now.append(text)
    blocks.append("".join(now))
    lines = (" ".join(unescape(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def fit(pages) -> Weights:
    """Weights from (html, content) pairs, where content is the set of words that are content.

    A context's weight is the log odds that its words are content, with a half added to
    both counts; the tag's is minus the share of words that a tag must not outweigh.
    """
    good, bad, tags, words = Counter(), Counter(), 0, 0
    for html, content in pages:
        for context, text, _, _ in _settled(html):
            if text is None:
                tags += 1
                continue
            for w in unescape(text).split():
                (good if w in content else bad)[context] += 1
                words += w in content
    kinds = {*good, *bad, *HINT.values(), *PARTS.values(), "page", "outside"}
    prior = log((sum(good.values()) + 0.5) / (sum(bad.values()) + 0.5))
    weight = {k: log((good[k] + 0.5) / (bad[k] + 0.5)) if good[k] + bad[k] else (-3.0 if k in NEVER else prior) for k in kinds}
    return Weights(weight, -min(0.5, 0.25 * tags / max(1, words)))


def labelled():
    """Labelled pages from templates: what sites put around and into articles."""
    around = [
        '<nav><ul><li><a href="/a">m1</a></li><li><a href="/b">m2</a></li></ul></nav>',
        '<header class="site"><a>m3</a> m4 m5</header>',
        '<div class="ad">m6 m7 m8</div>',
        '<aside><h3>m9</h3><p>m10 m11</p></aside>',
        '<div id="cookie-notice">m12 m13 m14</div>',
        '<form><label>m15</label><input name="q"><button>m16</button></form>',
        '<section class="comments"><p>m17 m18 m19 m20</p><p>m21 m22</p></section>',
        "<footer>&copy; m23 &middot; m24</footer>",
        '<div class="sidebar">m25 m26</div>',
        "<p>m27 m28</p>",
    ]
    words = [f"c{i}" for i in range(60)]
    body = "".join(f"<p>{' '.join(words[i : i + 12])}</p>" for i in range(0, 60, 12))
    for wrap in ("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<div class="article-body">%s</div>', "<div>%s</div>", '<main><article>%s</article></main>'):
        for k in range(len(around)):
            before, after = "".join(around[:k]), "".join(around[k:])
            yield f"<html><head><title>m0</title></head><body>{before}{wrap % ('<h1>c0 c1</h1>' + body)}{after}</body></html>", set(words)


_fitted: list[Weights] = []


def default_weights() -> Weights:
    if not _fitted:
        _fitted.append(fit(labelled()))
    return _fitted[0]


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches, weights: Weights | None):
    for b in slices(batches, "html"):
        texts = [main_text(h, weights or default_weights()) for h in b.column("html").to_pylist()]
        yield batch(_OUT, b.column("page_id"), b.column("url"), texts, list(map(len, texts)))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(rows).mapInArrow(lambda batches: _extract(batches, weights), "page_id bigint, url string, text string, n_chars bigint")

"""Main text of web pages by a graphical model on the page's tree.

A page becomes a tree of elements; every element that owns text, or holds one that does, is a binary node (content or
not). Unary potentials come from what is known of the element alone (its tag, the words of its class and id, the length
of its text, its link density, its place), pairwise potentials tie it to its parent by the pair of tag kinds. Sum-product
messages go upward and downward once and give every node's exact marginal; text in nodes whose marginal is at least one
half is the main text. Potentials are trained here by gradient ascent on the likelihood of labelled pages, which a
generator of page layouts supplies (``labelled_pages``); the fit is deterministic and takes a second or two.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import prepare, slices, table, tidy

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
BLOCKS = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr dialog center".split())
#: A start tag of the value's kind ends an open element of the key's kind.
CLOSES = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
#: Elements nest so deep at most; deeper ones end the one that stands there, as in browsers.
DEEPEST = 512
SCOPE = frozenset("table td th caption html body article section main aside nav header footer div ul ol dl form".split())
_NAME, _NAME_END = re.compile(r"/?[a-zA-Z]"), re.compile(r"[\s/>]")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")
_WHITE = re.compile(r"[ \t\n\x0b\x0c\r  -   　]+")

KINDS = {
    "article": "article", "main": "article", "p": "text", "h1": "head", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head", "blockquote": "text", "pre": "text",
    "div": "box", "section": "box", "body": "box", "html": "box", "center": "box", "details": "box", "summary": "text", "dialog": "notice",
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "select": "form", "option": "form", "label": "form", "legend": "form",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "cell",
    "figure": "figure", "figcaption": "text", "a": "link", "b": "inline", "strong": "inline", "i": "inline", "em": "inline", "span": "inline", "code": "inline", "u": "inline", "small": "inline", "sup": "inline", "sub": "inline", "mark": "inline", "q": "inline", "cite": "inline", "time": "inline", "font": "inline",
}
KIND_LIST = sorted({*KINDS.values(), "other"})
KIND_INDEX = {k: i for i, k in enumerate(KIND_LIST)}
#: Groups of class, id and role words; a word is matched as a whole part of the attribute.
HINTS = {
    "good": "article content main post entry story body text prose".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner adsense dfp".split(),
    "nav": "nav navigation menu breadcrumb breadcrumbs navbar pager pagination tabs toc skip".split(),
    "edge": "header footer masthead copyright colophon topbar bottom legal".split(),
    "side": "sidebar side aside related widget recommended popular trending more teaser rail".split(),
    "talk": "comment comments reply replies disqus discussion respond reader readers feedback".split(),
    "note": "cookie cookies consent notice notices gdpr popup modal alert banner newsletter subscribe signup overlay privacy paywall".split(),
    "form": "form search login signin contact share social buttons toolbar".split(),
}
HINT_LIST = list(HINTS)
_HINT_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(HINTS.values()):
    for _w in _words:
        _HINT_OF.setdefault(_w, []).append(_i)
N_FEATURES = 1 + len(KIND_LIST) + len(HINT_LIST) + 7
N_KINDS = len(KIND_LIST)


class Node:
    __slots__ = ("attrs", "hidden", "label", "link_chars", "parent", "tag", "text_chars", "words")

    def __init__(self, tag: str, parent: int, words: tuple[int, ...] = (), hidden: bool = False, label: int | None = None):
        self.tag, self.parent, self.words, self.hidden, self.label = tag, parent, words, hidden, label
        self.text_chars = self.link_chars = 0


def parse(source: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Nodes in page order (parents first) and the stream of (node, text), with None for a block boundary.

    Forgiving as browsers are where it matters here: void elements, raw text elements, implied ends of p, li, td and the
    like, unmatched end tags, unclosed elements at the end, and an open inline element that its block's end closes.
    """
    nodes = [Node("html", -1)]
    stack = [0]
    marks: list[int] = []  # places on the stack of elements that some start tag ends, or that shield others
    open_tags: dict[str, list[int]] = {}  # places on the stack by tag
    stream: list[tuple[int, str | None]] = []
    at, n = 0, len(source)

    def add_text(s: str) -> None:
        if s and not nodes[stack[-1]].hidden:
            stream.append((stack[-1], html_lib.unescape(s)))

    def back_to(k: int) -> None:
        while len(stack) > k:
            open_tags[nodes[stack.pop()].tag].pop()
        while marks and marks[-1] >= k:
            marks.pop()

    last_end, last_stop = source.rfind(">"), max(map(source.rfind, ">\"'"))
    last_name = [0, 0]  # where the last tag name began and ended
    dead: set[int] = set()  # quotation marks after which no tag ends

    def tag_end(k: int) -> int:
        """The place of the ``>`` that ends a tag, outside of quotation marks, or -1. No mark is passed twice in vain."""
        passed: list[int] = []
        while k <= last_stop:
            k = _STOP.search(source, k).start()
            if source[k] == ">":
                return k
            passed.append(k)
            close = -1 if k in dead else source.find(source[k], k + 1)
            if close < 0:
                break
            k = close + 1
        dead.update(passed)
        return -1

    def token(lt: int):
        """(end, closing, tag or None, attributes) of the comment, declaration or tag that begins here, or None."""
        if source.startswith("<!--", lt):
            k = source.find("-->", lt + 4)
            return (k + 3 if k >= 0 else n), "", None, ""
        if source.startswith(("<!", "<?"), lt):
            return (source.find(">", lt + 2) + 1, "", None, "") if lt + 1 < last_end else None
        m = _NAME.match(source, lt + 1) if lt < last_stop else None
        if m is None:
            return None
        if m.end() > last_name[1] or lt < last_name[0]:  # names that overlap end alike
            end = _NAME_END.search(source, m.end())
            last_name[:] = lt, end.start() if end else n
        k = tag_end(last_name[1])
        return (k + 1, m[0][:-1], source[m.end() - 1 : last_name[1]].lower(), source[last_name[1] : k]) if k >= 0 else None

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add_text(source[at:])
            break
        found_token = token(lt)
        if found_token is None:
            nxt = source.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            broken = re.match(r"</?[a-zA-Z]", source[lt : lt + 3])
            add_text(source[at:lt] if broken and nxt == n else source[at:nxt])  # a tag cut off by the end is no text
            at = nxt
            continue
        if lt > at:
            add_text(source[at:lt])
        at, closing, tag, attrs = found_token
        if tag is None:
            continue
        block = tag in BLOCKS or tag == "br"
        if block:
            stream.append((stack[-1], None if tag != "br" else "\n"))
        if closing:
            if open_tags.get(tag):
                k = open_tags[tag][-1]
                if tag in BLOCKS or not any(nodes[stack[j]].tag in SCOPE for j in marks if j > k):
                    back_to(k)
            continue
        if tag in ("html", "body") and tag == "html":
            continue
        end = None
        for k in reversed(marks):
            own = nodes[stack[k]].tag
            if tag in CLOSES.get(own, ()):
                end = k
            elif own in SCOPE:
                break
        if end is not None:
            back_to(end)
        if len(stack) >= DEEPEST and tag not in VOID and tag not in RAW:
            back_to(DEEPEST - 1)
        words: tuple[int, ...] = ()
        hidden = nodes[stack[-1]].hidden or tag in RAW or tag == "head"
        label = None
        if attrs and not attrs.isspace():
            found: list[int] = []
            for a in _ATTR.finditer(attrs):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name in ("class", "id", "role"):
                    for w in _PART.findall(value.lower()):
                        found += _HINT_OF.get(w, ())
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    hidden = True
                elif name == "data-content":
                    label = int(value)
            words = tuple(sorted(set(found)))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(source, at)
            at = source.find(">", end.end()) + 1 if end else 0
            at = at or n
            continue
        if tag in VOID or attrs.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        nodes.append(Node(tag, stack[-1], words, hidden, label))
        open_tags.setdefault(tag, []).append(len(stack))
        if tag in CLOSES or tag in SCOPE:
            marks.append(len(stack))
        stack.append(len(nodes) - 1)
    return nodes, stream


def features(nodes: list[Node], stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix, parents and kinds of a page's nodes."""
    n = len(nodes)
    total, link = np.zeros(n), np.zeros(n)
    parent = np.array([x.parent for x in nodes])
    kind = np.array([KIND_INDEX[KINDS.get(x.tag, "other")] for x in nodes])
    in_link = np.zeros(n, bool)
    for i in range(1, n):
        in_link[i] = nodes[i].tag == "a" or in_link[parent[i]]
    for i, s in stream:
        if s:
            k = len(s.strip())
            total[i] += k
            if in_link[i]:
                link[i] += k
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        link[parent[i]] += link[i]
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    x[np.arange(n), 1 + kind] = 1
    base = 1 + N_KINDS
    for i, node in enumerate(nodes):
        for w in node.words:
            x[i, base + w] = 1
    base += len(HINT_LIST)
    share = link / np.maximum(total, 1)
    x[:, base] = np.minimum(np.log1p(total) / 8, 1.5)
    x[:, base + 1] = share
    x[:, base + 2] = share > 0.6
    x[:, base + 3] = total > 200
    x[:, base + 4] = total < 25
    x[:, base + 5] = total / max(total[0], 1)
    x[:, base + 6] = kind == kind[np.maximum(parent, 0)]
    return x, parent, kind


def marginals(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product on the tree: P(node = 1), P(node, parent) for each node with a parent (as [parent, node]), log Z.

    ``unary`` (n, 2) and ``pair`` (n, 2, 2; index parent then node) are log potentials. All trees of a forest at once.
    """
    n = len(unary)
    up = unary.copy()
    message = np.zeros((n, 2))
    tiers = levels_of(parent)
    for tier in tiers[:0:-1]:
        message[tier] = np.logaddexp(pair[tier, :, 0] + up[tier, None, 0], pair[tier, :, 1] + up[tier, None, 1])
        np.add.at(up, parent[tier], message[tier])
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for tier in tiers[1:]:
        without = belief[parent[tier]] - message[tier]
        j = without[:, :, None] + pair[tier] + up[tier][:, None, :]
        belief[tier] = np.logaddexp(j[:, 0], j[:, 1])
        joint[tier] = j
    log_z = np.logaddexp(belief[:, 0], belief[:, 1])
    p = np.exp(belief[:, 1] - log_z)
    root = tiers[0]
    joint = np.exp(joint - log_z[:, None, None])
    joint[root] = 0
    return p, joint, float(log_z[root].sum())


def levels_of(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth, for a forest whose parents come before their children (roots: -1)."""
    depth = np.zeros(len(parent), np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))


def labelled_pages(count: int = 240, seed: int = 5) -> list[str]:
    """Pages of many layouts whose elements say by ``data-content`` whether they are main text (inherited downward)."""
    r = random.Random(seed)
    syllables = "an en er in on re st th ti ou ha le de la es be ver ung ción mente aux ment".split()

    def words(a, b):
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentence(a=4, b=30):
        return words(a, b).capitalize() + "."

    def links(k):
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(k))

    def no(tag, attrs, inner):
        return f'<{tag} {attrs} data-content="0">{inner}</{tag}>'

    def body():
        out = []
        short, tiny = r.random() < 0.35, r.random() < 0.4
        for _ in range(r.randint(1, 9) if r.random() < 0.7 else r.randint(10, 60)):
            kind = r.random()
            if kind < 0.68:
                s = " ".join((sentence(1, 4) if tiny else sentence()) if short else sentence() for _ in range(1 if short else r.choice([1, 1, 2, 4, 8])))
                if r.random() < 0.2:
                    s += f' <a href="/x">{words(1, 3)}</a> {words(1, 6)}.'
                if r.random() < 0.15:
                    s = f"<b>{s}<br>" if r.random() < 0.5 else f"<em>{s}</em>"
                out.append(f"<p>{s}</p>")
            elif kind < 0.78:
                out.append(f"<h{(k := r.randint(2, 4))}>{words(1, 7)}</h{k}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{sentence()}</p></blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption>{sentence(3, 9)}</figcaption></figure>")
            if r.random() < 0.12:
                out.append(no("div", r.choice(['class="ad"', 'class="advert inline"', 'id="promo-box"', 'class="sponsored"', 'class="newsletter signup"']), f"<p>{sentence(3, 14)}</p>" if r.random() < 0.5 else sentence(3, 14)))
        return "".join(out)

    pages = []
    for _ in range(count):
        head = r.choice([no("header", "", f"<a href=/>{words(1, 3)}</a><p>{words(2, 6)}</p>"), no("div", 'class="site-header"', words(1, 4)), ""])
        nav = r.choice([no("nav", "", f"<ul>{links(r.randint(3, 9))}</ul>"), no("ul", 'class="menu"', links(5)), no("div", 'id="navbar"', "".join(f"<a href=/>{words(1, 2)}</a> " for _ in range(6))), no("div", 'class="breadcrumb"', f"<a href=/>{words(1, 1)}</a> &gt; {words(1, 2)}"), ""])
        ad = r.choice([no("div", 'class="ad"', sentence(3, 12)), no("div", 'class="banner advertisement"', f"<a href=/>{sentence(3, 9)}</a>"), no("aside", 'class="ads"', f"<p>{sentence(4, 14)}</p>"), ""])
        note = r.choice([no("div", 'class="cookie-notice"', f"<p>{sentence(6, 25)}</p><button>{words(1, 2)}</button>"), no("div", 'role="alert" class="notice"', sentence(5, 20)), no("dialog", 'id="consent"', f"<p>{sentence(6, 20)}</p>"), "", ""])
        side = r.choice([no("aside", "", f"<h3>{words(1, 3)}</h3><ul>{links(5)}</ul>"), no("div", 'class="sidebar"', f"<h3>{words(1, 3)}</h3><p>{sentence(5, 25)}</p>"), no("section", 'class="related"', f"<h2>{words(1, 3)}</h2>{sentence(3, 9)}"), no("aside", 'class="widget"', f"<p>{' '.join(sentence() for _ in range(3))}</p>"), ""])
        form = r.choice([no("form", 'action="/search"', f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button>"), no("form", "", f"<p>{sentence(3, 9)}</p><select><option>{words(1, 2)}<option>{words(1, 2)}</select>"), ""])
        talk = r.choice([no("section", r.choice(['class="comments"', 'id="comments"']), f"<h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{" ".join(sentence() for _ in range(r.randint(1, 3)))}</p></div>' for _ in range(r.choice([1, 2, 3, 5, 12, 30])))), no("ol", 'class="comment-list"', "".join(f"<li><article><p>{sentence()}</p></article></li>" for _ in range(r.choice([1, 3, 8, 20])))), "", ""])
        foot = r.choice([no("footer", "", f"&copy; {words(1, 2)} &middot; {' '.join(sentence(3, 12) for _ in range(r.randint(1, 2)))}"), no("div", 'class="footer"', f"<p>{sentence(4, 14)}</p><ul>{links(3)}</ul>"), ""])
        inside = r.random() < 0.25
        article_head = f"<h1>{words(2, 9)}</h1>" if r.random() < 0.8 else ""
        inner = article_head + body() + (talk if inside else "")
        shape = r.random()
        core = f'<article data-content="1">{inner}</article>' if shape < 0.5 else f'<main data-content="1">{inner}</main>' if shape < 0.62 else f'<div {r.choice(["class=content", "id=main-content", chr(34).join(["class=", "post entry", ""])])} data-content="1">{inner}</div>' if shape < 0.85 else f'<div data-content="1">{inner}</div>' if shape < 0.95 else f'<section data-content="1">{inner}</section>'
        before, after = [head, nav, ad, note, form], [side, "" if inside else talk, foot]
        pages.append(f'<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{"".join(before)}{core}{"".join(after)}</body></html>')
    return pages


def _page_arrays(source: str):
    nodes, stream = parse(source)
    x, parent, kind = features(nodes, stream)
    return nodes, stream, x, parent, kind


@lru_cache(maxsize=1)
def trained(count: int = 240, seed: int = 5, rounds: int = 200, rate: float = 0.5, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and pairwise weights (by parent kind and node kind, 2 x 2) that maximise the labelled pages' likelihood."""
    xs, parents, kinds, ys, base = [], [], [], [], 0
    for source in labelled_pages(count, seed):
        nodes, _, x, parent, kind = _page_arrays(source)
        y = np.zeros(len(nodes), np.int64)
        for i in range(1, len(nodes)):
            y[i] = nodes[i].label if nodes[i].label is not None else y[parent[i]]
        # An element around main text holds content itself; its other children differ from it by their own evidence.
        for i in range(len(nodes) - 1, 0, -1):
            if y[i] and nodes[i].label == 1:
                k = parent[i]
                while k >= 0:
                    y[k], k = 1, parent[k]
        xs.append(x), kinds.append(kind), ys.append(y)
        parents.append(np.where(parent >= 0, parent + base, -1))
        base += len(nodes)
    x, parent, kind, y = map(np.concatenate, (xs, parents, kinds, ys))
    n, child = len(y), np.flatnonzero(parent >= 0)
    which = kind[parent[child]] * N_KINDS + kind[child]
    w, q = np.zeros(N_FEATURES), np.zeros((N_KINDS * N_KINDS, 2, 2))
    seen = np.zeros_like(q)
    np.add.at(seen, (which, y[parent[child]], y[child]), 1)
    target = x.T @ y
    gw, gq = np.zeros_like(w), np.zeros_like(q)
    for _ in range(rounds):  # adaptive steps: rare tag pairs move as fast as common ones
        unary = np.stack((np.zeros(n), x @ w), 1)
        pair = np.zeros((n, 2, 2))
        pair[child] = q[which]
        p, joint, _ = marginals(unary, pair, parent)
        expect = np.zeros_like(q)
        np.add.at(expect, which, joint[child])
        dw, dq = (target - x.T @ p) / n - ridge * w, (seen - expect) / n - ridge * q
        gw += dw * dw
        gq += dq * dq
        w += rate * dw / np.sqrt(gw + 1e-10)
        q += rate * dq / np.sqrt(gq + 1e-10)
    return w, q


def main_text(source: str, w: np.ndarray, q: np.ndarray) -> str:
    nodes, stream, x, parent, kind = _page_arrays(source)
    n = len(nodes)
    pair = np.zeros((n, 2, 2))
    if n > 1:
        pair[1:] = q[kind[parent[1:]] * N_KINDS + kind[1:]]
    p, _, _ = marginals(np.stack((np.zeros(n), x @ w), 1), pair, parent)
    blocks: list[str] = []
    now: list[str] = []
    for i, s in [*stream, (0, None)]:
        if s is None:
            text = _WHITE.sub(" ", "".join(now)).strip(" ")
            if text:
                blocks.append(text)
            now = []
        elif p[i] >= 0.5 and not nodes[i].hidden:
            now.append(s)
    return "\n\n".join(blocks)


def _extract(batches, model):
    w, q = model
    for whole in batches:
        for b in slices(whole, "html", 2 << 20):
            text = [main_text(h, w, q) if h else "" for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    ``text`` holds the main text's blocks in page order, joined by an empty line: character references decoded, white
    space within a block made one space, blocks trimmed. A line break (br) is white space. Null or empty html, and pages
    without main text, give an empty text. Null ids and urls stay null, repeated rows have a row each, an empty table
    gives an empty result, other columns are ignored. No page is cut short.
    """
    prepare(df.sparkSession)
    d = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return d.mapInArrow(tidy(partial(_extract, model=trained())), "page_id long, url string, text string, n_chars long")


def op2_page_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

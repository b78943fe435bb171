"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once, tag by tag, into blocks of text between block-level tags. A block's
features are its word count and link density, those of the blocks before and after it,
whether it is a heading, and three marks of where it stands: inside a container of main text
(article, main or an element named so), outside (in navigation, footers, asides, forms or an
element named after page furniture), or elsewhere on a page that has main containers. The marks
are inputs like the others: no mark alone decides. An element's name tells when all words of one
of its class, id or role names do ("site-footer", not "comments-off" or "side-note"); an
article's own class tells nothing. The tree (CART, Gini) is trained each time, in about a second,
from the labelled table below: pages as runs of labelled blocks, each also with other lengths.

Defined results: null or blank html gives empty text; text in scripts, styles, templates,
the head, comments and hidden elements is never a block; a page cut short keeps what it
has; white space (all Unicode) inside a block becomes one space; a line break tag is white
space; inline tags join; rows that repeat are extracted each; other columns are kept
unless they carry the name of a result column, and the html itself is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after", "inside", "outside", "elsewhere", "heading")

# The labelled table. A line is a page: name{ ... } an element, name.class{ with a class; a block is
# + (main text) or - (not), h for a heading, l for a link as a whole, its words, and k with the
# percentage of them that are linked.
LABELLED = """
header{ -l1 -3 } nav{ -l1 -l1 -l2 } article{ +h6 +54 +110 +2 +1 +48k4 } aside{ -30 -l4 } footer{ -9k20 -6 }
nav{ -l1 -l1 -l1 } div.ad{ -9 } article{ +h12 +40 +20 +75 +33 } footer{ -10 }
nav{ -l2 -l2 } div.ad{ -14 } article{ +h9 +3 +2 +60 +1 +45 } footer{ -8 }
nav{ -l1 } article{ +h3 -l2 +40 +55 } footer{ -5 }
article{ +h2 -l2 +40 }
article{ +h5 -l3 -4k50 +38 +62 +41 } div{ -l2 }
article{ +40 } div{ -l2 }
article{ +40 } div{ -l2 -l2 -l3 } footer{ -9 }
article{ +12 } div{ -l2 }
main{ +75 } div{ -l3 }
div{ -l2 } article{ +25 } div{ -l2 }
div{ -l1 -l2 -l1 } article{ +h4 +8 +44 }
article{ +h4 +33 +12k60 +18k30 +29 } aside{ -12 -25 -l6 }
article{ +h6 +45 +h3 +60 +h2 +9 +71 } section.comments{ -h2 -14 -30 -8 }
article{ +h6 +45 +30 section.comments{ -h1 -20 -35 -5 -l1 } }
article{ +h8 +70 div.advert{ -12 } +66 div.ad-box{ -9k40 } +40 form{ -1 -5 } +38 }
article{ header{ +h6 -l2 -4 } +50 +61 footer{ -8 -l2 } }
article{ header{ +h5 +20 } +41 +39 }
main{ +h5 +40 ul{ +6 +9 +4 +12 } +31 +h3 ul{ +2 +3 +2 } +15 }
main{ +h4 +14 ul{ +5k60 +8k50 +l7 +6k80 } +35 }
div.content{ +h7 +52 +3 +47 } div.sidebar{ -h2 -22 -l4 -l5 -l3 -40 } div.footer{ -15k30 }
div.main-content{ +h5 +20 +33 } div.related{ -h2 -l8 -l9 -l7 } div.newsletter{ -h4 -18 }
div.post{ +h6 +45 +9 +88 } div.post-comments{ -h2 -25 -60 -11 -44 }
div.site-header{ -3 -l1 -l1 } div.content{ +h5 +28 +50 } div.site-footer{ -12 -l2 -l2 }
div.cookie-notice{ -18 -l2 } nav{ -l1 -l2 } article{ +h7 +40 +35 } footer{ -7 }
div.cookie{ -40 -l1 } div.content{ +h5 +60 +25 } div.banner{ -20 }
header{ -h3 -9 nav{ -l1 -l1 } } main{ article{ +h6 +33 +47 } } footer{ -5 -l2 -l3 }
-l2 -l1 -l1 -l3 +h7 +60k3 +45 +9 +120k6 -l4 -l3 -9k20
-l1 -l1 +h5 +33 +71 +h4 +52k9 +18 +66 -l2 -l2 -l1 -6
-l2 -l2 +40 +55k5 +62 -l2 -6k50
-5k100 -6k80 +h12 +25 +19 +64k12 +7 +58 -8k75 -l3
-l1 -l1 -l1 -l1 -l2 -l2 -3k50 -l1 -8k40
-2k100 +h3 +40 +40 -l2
-3k67 +h2 +48 +51 -l2 -l2
-45k100 +h6 +50 +44
+h5 +62 +31 -40k95
div{ -l40 } div{ +h4 +35 +28 } div{ -l30 }
ul{ -l1 -l1 -l2 -l1 } div{ +h6 +22 +64 +90 } ul{ -l2 -l3 -l2 }
ul{ -l1 -l2 } p{ } +h6 +41 +12 +38 -h2 ul{ -l6 -l7 -l9 }
-7 -l2 -l2 +h8 +40 +55k5 +62 -l2 -6k50
aside{ -45 -70k10 } main{ +h6 +150k1 +4 } aside{ -35 -48k5 } section.comments{ -80 -l3 }
nav{ -4 -l2 } div{ +h5 +30 +55 } aside{ -h2 -90k2 -41 } div.comments{ -22 -61 -5 }
form{ -2 -3 -1 } article{ +h5 +42 +30 } form{ -8 -1 }
form{ article{ +h5 +42 +30 } }
div.comments{ article{ -30 -12 } article{ -25 } }
aside{ article{ -h4 -20 } article{ -h5 -25k20 } }
nav{ ul{ -3 -2 -4 } } +h5 +60 +35
div.menu{ -2 -2 -3 } div{ +h4 +44 +37 } div.footer{ -9 }
div{ -3 } article{ +h5 +50 } div{ -12 -30 -6 } footer{ -10 }
div{ -20 } main{ +h5 +50 +60 } div{ -25k10 -40 } footer{ -4 }
article{ +15 +8 +l8 +2 }
article{ +1 +1 }
article{ +l1 }
article{ +l6 }
article{ +h2 }
article{ +2 }
article{ +h1 +l5 +30 }
article{ +6 +l1 }
main{ +10k90 +12k85 +48k20 +39 +14k90 }
+h4 +29 +44
+75
+6
+1
+14 +11
+30 +25 +40
-l3
-l1 -l1
-l2 +30
+35 -l2
+h3 +12
"""

BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SKIP = frozenset("head template noscript svg canvas object audio video map select datalist button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and words of names that tell where a block stands. DEEP ones hold whatever
# is nested in them; of the others the nearest counts.
MAIN_TAGS = frozenset(("article", "main"))
DEEP_TAGS = frozenset("nav footer aside menu dialog".split())
FURNITURE_TAGS = DEEP_TAGS | {"form", "header"}
DEEP_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar comment comments reply replies disqus cookie cookies consent gdpr newsletter related recommended breadcrumb breadcrumbs nav navbar navigation popup modal pagination pager share sharing social footer contentinfo complementary".split())
FURNITURE_WORDS = DEEP_WORDS | frozenset("banner notice notices alert subscribe subscription signup login menu header masthead widget overlay toolbar search byline".split())
MAIN_WORDS = frozenset("article main content post entry story body text".split())
NEUTRAL_WORDS = frozenset("site page top bottom left right user blog global primary secondary box wrap wrapper container block section area list item bar inner outer unit slot form links the".split())

_TAG = re.compile(r"""<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^"'>]|"[^"]*"|'[^']*')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attr2>[^>]*)>|[!?/][^>]*(?:>|\Z)|/?[a-zA-Z][^<>]*\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether a class, id or role has a name of furniture, of deep furniture, of main text."""
    furniture = deep = main = False
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name) if not w.isdigit()}
        other = words - NEUTRAL_WORDS - MAIN_WORDS
        if other and other <= FURNITURE_WORDS:
            furniture = True
            deep = deep or bool(other & DEEP_WORDS)
        elif words & MAIN_WORDS and not other:
            main = True
    return furniture, deep, main


def _kind(name: str, attr: str) -> tuple[int, bool, bool]:
    """(1 main, -1 furniture, 0 neither; whether it is so for all that is nested; whether hidden)."""
    kind = 1 if name in MAIN_TAGS else -1 if name in FURNITURE_TAGS else 0
    deep = name in DEEP_TAGS
    for key, value in _ATTR.findall(attr) if attr else ():
        key, value = key.lower(), value.strip("\"' ")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
            return -1, True, True
        if key in ("class", "id", "role") and name not in ("body", "html", "main", "article"):
            furniture, below, main = _named(value)
            if furniture:
                kind, deep = -1, deep or below
            elif main and not kind:
                kind = 1
    return kind, deep, False


def blocks(html: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, inside, outside, heading) of each block, in page order."""
    out: list[tuple] = []
    text: list[str] = []
    linked = length = 0  # characters
    in_link = heading = skip = 0
    stack: list[tuple[str, int, bool, bool]] = []  # open elements that are block-level, skipped or telling

    def close() -> None:
        nonlocal linked, length
        t = " ".join(unescape("".join(text)).split())
        if t:
            kind = -1 if any(s[2] for s in stack) else next((s[1] for s in reversed(stack) if s[1]), 0)
            out.append((t, t.count(" ") + 1, linked / max(length, 1), int(kind > 0), int(kind < 0), int(heading > 0)))
        text.clear()
        linked = length = 0

    def say(t: str) -> None:
        nonlocal linked, length
        if not skip and t:
            text.append(t)
            n = len(t) - t.count(" ")
            length += n
            if in_link:
                linked += n

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end = bool(m["end"] or m["end2"])
        if name == "br":
            say(" ")
        elif name == "a":
            in_link = 0 if end else 1
        elif name in RAW and not end:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            if stop is None:
                break
            at = stop.start()
        elif end:
            if any(s[0] == name for s in stack):
                if name in BLOCK or name in SKIP:
                    close()
                while stack:
                    n, _, _, unseen = stack.pop()
                    skip -= unseen or n in SKIP
                    heading -= n in ("h1", "h2", "h3", "h4", "h5", "h6")
                    if n == name:
                        break
            elif name in BLOCK:
                close()
            if name in BLOCK:
                in_link = 0
        elif name not in VOID and not m.group().endswith("/>"):
            kind, deep, unseen = _kind(name, m["attr"] or m["attr2"] or "")
            if name == "header" and kind < 0 and not deep and any(x[1] > 0 for x in stack):
                kind = 0  # the header of an article belongs to it
            if name in BLOCK or name in SKIP or deep or unseen:
                close()
                if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name or name in BLOCK and stack and stack[-1][0] == "p":
                    skip -= stack.pop()[3]
                if name == "body":
                    while stack:
                        n, _, _, gone = stack.pop()
                        skip -= gone or n in SKIP
                stack.append((name, kind, deep, unseen))
                skip += unseen or name in SKIP
                heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
            elif kind:
                stack.append((name, kind, deep, unseen))
        elif name == "hr":
            close()
    close()
    return out


def features(b: list[tuple]) -> np.ndarray:
    """One row per block, in the order of FEATURES; links in percent."""
    own = np.array([(w, 100 * d, i, o, h) for _, w, d, i, o, h in b], float).reshape(-1, 5)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:, :2]])[: len(own)], np.concatenate([own[1:, :2], edge])[: len(own)]
    elsewhere = (own[:, 2].any() & (own[:, 2] == 0) & (own[:, 3] == 0)).astype(float)
    return np.column_stack([before, own[:, :2], after, own[:, 2:4], elsewhere, own[:, 4]])


def _page(line: str, rng: np.random.Generator | None) -> tuple[str, list[bool]]:
    """A line of the table as HTML, with the labels of its blocks; rng varies the lengths."""
    out, open_, marks = [], [], []
    for item in line.split():
        if item.endswith("{"):
            name, *names = item[:-1].split(".")
            out.append(f'<{name} class="{" ".join(names)}">')
            open_.append(name)
        elif item == "}":
            out.append(f"</{open_.pop()}>")
        else:
            mark, heading, link, words, linked = _ITEM.fullmatch(item).groups()
            n = int(words)
            if rng is not None and n > 3:
                n = max(4, round(n * rng.choice([0.6, 0.8, 1.25, 1.7])))
            k = n if link else round(n * int(linked or 0) / 100)
            text = " ".join(["<a href=x>" + " ".join(["word"] * k) + "</a>"] * (k > 0) + ["word"] * (n - k))
            tag = "h2" if heading else "li" if open_ and open_[-1] == "ul" else "p"
            out.append(f"<{tag}>{text}</{tag}>")
            marks.append(mark == "+")
    return "".join(out), marks


_ITEM = re.compile(r"([+-])(h?)(l?)(\d+)(?:k(\d+))?")


def labelled(times: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The table's blocks as written, and with other lengths."""
    rng = np.random.default_rng(11)
    rows, marks = [], []
    for line in LABELLED.strip().split("\n"):
        for k in range(times):
            html, own = _page(line, rng if k else None)
            rows.append(features(blocks(html)))
            marks += own
    return np.concatenate(rows), np.array(marks)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 3):
    """A tree: (feature, threshold, tree at or below, tree above) or a share of main text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            if not least <= left.sum() <= len(y) - least:
                continue
            a, b = y[left].mean(), y[~left].mean()
            score = left.sum() * a * (1 - a) + (~left).sum() * b * (1 - b)
            if score < best[0]:
                best = (score, f, t)
    if best[1] is None:
        return share
    left = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def train():
    return grow(*labelled())


def judge(tree, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(html: str | None, tree) -> str:
    if not html:
        return ""
    b = blocks(html)
    return " ".join(x[0] for x, row in zip(b, features(b).tolist()) if judge(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """pages (html, ...) with text and n_chars (code points of the text)."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    kinds = dict(pages.dtypes)
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py(), tree) for h in b.column(b.schema.get_field_index("html"))]
            cols = [b.column(b.schema.get_field_index(c)) for c in keep if c != "html"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [c for c in keep if c != "html"] + ["text", "n_chars"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep if c != "html"] + ["text string", "n_chars long"])
    return pages.select(*keep).mapInArrow(run, schema)

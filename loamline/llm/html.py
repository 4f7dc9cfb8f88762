"""Main text of HTML pages from flat text blocks and a decision tree.

A page is cut into flat blocks of text at its block-level tags. A block is
described by its own word count and link density, those of the blocks before and
after it, and whether it is a heading or a list item. A decision tree, grown on
the small labelled table below, keeps it or drops it. What else a page's tags say
of a block (that it stands beside the article, or within it) only refines the
leaves of that tree.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[/!?a-zA-Z][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")

# HTML's own element groups, and the elements, roles and class names that its pages give to what stands beside the article.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video select".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ARTICLE = frozenset("article main".split())
LANDMARKS = frozenset("nav footer aside form dialog menu button fieldset search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
CONTAINERS = frozenset("aside center details dialog div dl figure footer header menu nav ol section table ul".split())
NAMES = frozenset("ad ads adsbygoogle adv advert advertisement advertorial alert announcement banner breadcrumb breadcrumbs byline captcha colophon comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus feedback footer gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion rail recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subnav subscribe subscription tags teaser toc toolbar topbar topnav trending warning widget".split())
# Words that go with such a name in a compound one.
COMPOUND = frozenset("area articles bar block body box card container content footer form group header inner item items label link links list panel post posts row section slot stories text thread title unit wrap wrapper zone".split())


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    heading: bool
    item: bool
    beside: bool  # within an element that is no part of an article by HTML's own meaning, or that is hidden
    named: bool  # within a container whose class or id is a word for such a part
    article: int  # 1 within an article or main element, 0 if the page has none, -1 if it has one elsewhere


def _beside(tag: str, attributes: str, inside: bool, nested: bool) -> tuple[bool, bool]:
    """Whether an element is, by its kind or by its name, no part of the article. inside: within an article or main element, where a header holds the title and of a compound name no part may say something else; nested: within an article, where another one is a comment."""
    beside = tag in LANDMARKS or (tag == "header" and not inside) or (tag == "article" and nested)
    named = False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            beside |= "display:none" in value.replace(" ", "")
        elif name == "hidden":
            beside = True
        elif name == "aria-hidden":
            beside |= value == "true"
        elif name == "role":
            beside |= value in ROLES
        elif tag in CONTAINERS:
            for word in value.split():
                parts = re.split("[-_]+", word)
                named |= not NAMES.isdisjoint(parts) and (not inside or all(x in NAMES or x in COMPOUND for x in parts if x))
    return beside, named


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks in page order, in one pass. Comments, scripts, styles, titles and the like hold no text; what follows an unclosed tag at the end is markup."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element; beside, named, in how many articles: of it and all around it
    opened: Counter = Counter()  # elements in the stack
    headings = 0
    text: list[str] = []
    linked: list[str] = []
    link = -1  # depth of the stack at the open link

    def close() -> None:
        if text:
            flat = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if flat:
                _, beside, named, depth = stack[-1] if stack else ("", False, False, 0)
                out.append(Block(flat, flat.count(" ") + 1, len(entities.unescape("".join(linked)).split()), headings > 0, opened["li"] > 0, beside, named, min(depth, 1)))
            text.clear()
            linked.clear()

    def pop() -> None:
        nonlocal headings
        tag = stack.pop()[0]
        opened[tag] -= 1
        headings -= tag in HEADINGS

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if link >= 0:
                linked.append(piece)
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag == "a":
            link = -1 if closing else len(stack)
            if closing:
                linked.append(" ")
        elif tag in BLOCKS:
            close()
            if closing:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                if link > len(stack):
                    link = -1
            elif tag not in VOID:
                # A paragraph ends where the next block begins; a list item, cell or row where its like does.
                if stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"))):
                    pop()
                _, beside, named, depth = stack[-1] if stack else ("", False, False, 0)
                more_beside, more_named = _beside(tag, m[3], depth > 0, opened["article"] > 0)
                stack.append((tag, beside or more_beside, named or more_named, depth + (tag in ARTICLE)))
                opened[tag] += 1
                headings += tag in HEADINGS
        elif tag in ("br", "img", "input"):
            text.append(" ")
    if at < len(page):
        text.append(page[at:])
        if link >= 0:
            linked.append(page[at:])
    close()
    if any(b.article and not b.beside for b in out):
        for b in out:
            b.article = b.article or -1
    return out


# ---------------------------------------------------------------- the tree

#: Labelled blocks: words and link density of the block, of the one before and of the one after; heading and list item; then 1 to keep. Those of the first rows are from raw pages of the smallest test tables, the last 42 from other layouts.
LABELLED = """
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00    8 0.00  0 1  0
   8 0.00    1 1.00   10 0.00  0 0  0
  10 0.00    8 0.00   51 0.00  1 0  1
   8 0.00   51 0.00   11 0.00  0 0  1
  36 0.00   11 0.00   32 0.00  0 0  1
  25 0.00   52 0.00   11 0.00  0 0  1
  11 0.00   25 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00    8 0.00  0 1  0
   8 0.00    1 1.00    9 0.00  0 0  0
   9 0.00    8 0.00   12 0.00  1 0  1
   9 0.00   12 0.00   39 0.00  0 0  1
  39 0.00    9 0.00    8 0.00  0 0  1
   8 0.00   20 0.00    8 0.00  0 0  1
   8 0.00    8 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00    5 0.00  0 1  0
   5 0.00    1 1.00    2 0.00  0 0  0
   2 0.00    5 0.00    2 0.00  1 0  1
   2 0.00    2 0.00   11 0.00  0 0  1
  11 0.00    2 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00    8 0.00  0 1  0
   8 0.00    1 1.00   11 0.00  0 0  0
  11 0.00    8 0.00   17 0.00  1 0  1
 143 0.00   17 0.00   31 0.00  0 0  1
  22 0.00   51 0.00   11 0.00  0 0  1
  11 0.00   22 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00    8 0.00  0 1  0
   8 0.00    1 1.00    8 0.00  0 0  0
   8 0.00    8 0.00    8 0.00  1 0  1
   3 0.00   15 0.00    8 0.00  0 0  1
  30 0.00    1 0.00   37 0.00  0 0  1
   8 0.00    8 0.00   45 0.00  0 0  1
  45 0.00    8 0.00    1 0.00  0 0  1
   8 0.00    3 0.00   14 0.00  0 0  1
  14 0.00    8 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00   11 0.00  0 1  0
  11 0.00    1 1.00   11 0.00  0 0  0
  11 0.00   11 0.00   65 0.00  1 0  1
   1 0.00   41 0.00   91 0.00  0 0  1
  91 0.00    1 0.00   39 0.00  0 0  1
   5 0.00   57 0.00  131 0.00  0 0  1
  55 0.00   16 0.00   11 0.00  0 0  1
  64 0.00  102 0.00   12 0.00  0 0  1
  12 0.00   64 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00    9 0.00  0 1  0
   9 0.00    1 1.00    7 0.00  0 0  0
   7 0.00    9 0.00  968 0.00  1 0  1
 968 0.00    7 0.00    9 0.00  0 0  1
   9 0.00  968 0.00    7 0.00  0 0  1
   7 0.00    9 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00    4 0.00  0 1  0
   4 0.00    1 1.00    6 0.00  0 0  0
   6 0.00    4 0.00    6 0.00  1 0  1
   6 0.00    6 0.00   10 0.00  0 0  1
  10 0.00    6 0.00   15 0.00  0 0  1
  15 0.00   10 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00   12 0.00  0 1  0
  12 0.00    1 1.00   11 0.00  0 0  0
  11 0.00   12 0.00  149 0.00  1 0  1
   1 0.00   46 0.00   76 0.00  0 0  1
  76 0.00    1 0.00    9 0.00  0 0  1
   9 0.00   76 0.00    0 0.00  0 0  0
   1 1.00    0 0.00    1 1.00  0 1  0
   1 1.00    1 1.00    1 1.00  0 1  0
   1 1.00    1 1.00    6 0.00  0 1  0
   6 0.00    1 1.00    8 0.00  0 0  0
   8 0.00    6 0.00   12 0.00  1 0  1
   3 0.00    8 0.00   38 0.00  0 0  1
   6 0.00   28 0.00   25 0.00  0 0  1
  32 0.00   25 0.00   13 0.00  0 0  1
  13 0.00   32 0.00    0 0.00  0 0  0
  10 0.00    1 1.00    4 0.00  0 0  0
   4 0.00   10 0.00    4 0.00  1 0  1
   4 0.00    4 0.00   47 0.00  0 0  1
 178 0.00   49 0.00   10 0.00  0 0  1
  10 0.00  178 0.00    0 0.00  0 0  0
   7 0.00    1 1.00    5 0.00  0 0  0
   5 0.00    7 0.00    5 0.00  1 0  1
   5 0.00    5 0.00   15 0.00  0 0  1
  15 0.00    5 0.00    0 0.00  0 0  0
  12 0.00    1 1.00   12 0.00  0 0  0
  12 0.00   12 0.00  184 0.00  1 0  1
   9 0.00  184 0.00   10 0.00  0 0  1
  10 0.00    9 0.00    0 0.00  0 0  0
   7 0.00    1 1.00   11 0.00  0 0  0
  11 0.00    7 0.00   37 0.00  1 0  1
   9 0.00   19 0.00   20 0.00  0 0  1
  20 0.00    9 0.00   13 0.00  0 0  1
  13 0.00   20 0.00    0 0.00  0 0  0
  10 0.00    1 1.00    9 0.00  0 0  0
   9 0.00   10 0.00    9 0.00  1 0  1
  10 0.00   29 0.00   14 0.00  0 0  1
  14 0.00   10 0.00    0 0.00  0 0  0
  11 0.00    1 1.00    5 0.00  0 0  0
   5 0.00   11 0.00    5 0.00  1 0  1
   1 0.00   31 0.00    9 0.00  0 0  1
   9 0.00    1 0.00   12 0.00  0 0  1
  12 0.00    9 0.00    0 0.00  0 0  0
   9 0.00    1 1.00    6 0.00  0 0  0
  25 0.00   46 0.00   12 0.00  0 0  1
  12 0.00   25 0.00    0 0.00  0 0  0
   9 0.00    1 1.00   11 0.00  0 0  0
   1 0.00   97 0.00   29 0.00  0 0  1
  29 0.00    1 0.00   19 0.00  0 0  1
  72 0.00   21 0.00   12 0.00  0 0  1
  12 0.00   72 0.00    0 0.00  0 0  0
   9 0.00    1 1.00   12 0.00  0 0  0
  10 0.00    1 1.00   10 0.00  0 0  0
   7 0.00    1 1.00    9 0.00  0 0  0
   1 0.00   20 0.00    1 0.00  0 0  1
  21 0.00    1 0.00   12 0.00  0 0  1
   5 0.00    1 1.00   10 0.00  0 0  0
   8 0.00    1 1.00    5 0.00  0 0  0
  10 0.00    1 1.00    8 0.00  0 0  0
   4 0.00    1 1.00   10 0.00  0 0  0
  12 0.00    1 1.00    6 0.00  0 0  0
   4 0.00    1 1.00   11 0.00  0 0  0
   6 0.00    1 1.00   11 0.00  0 0  0
  37 0.00    1 0.00   21 0.00  0 0  1
   3 0.00   33 0.00   43 0.00  0 0  1
   1 0.00   31 0.00   37 0.00  0 0  1
  37 0.00    1 0.00    9 0.00  0 0  1
   1 0.00   44 0.00   77 0.00  0 0  1
  77 0.00    1 0.00   37 0.00  0 0  1
   2 0.00   47 0.00    1 0.00  0 0  1
   3 0.00    7 0.00    1 0.00  0 0  1
  25 0.00    1 0.00   66 0.00  0 0  1
   3 0.00   11 0.00   23 0.00  0 0  1
  13 0.00    2 0.00   66 0.00  0 0  1
   1 0.00   35 0.00   27 0.00  0 0  1
  27 0.00    1 0.00   24 0.00  0 0  1
   6 0.00    1 0.00   19 0.00  0 0  1
   2 1.00    0 0.00   24 0.00  0 0  0
   6 1.00    0 0.00   60 0.00  0 0  0
   5 1.00   40 0.00   50 0.00  0 0  0
  12 0.90    0 0.00   80 0.00  0 0  0
   3 0.80   30 0.00   30 0.00  0 0  0
   8 1.00   15 0.00   25 0.00  0 0  0
   4 0.75    2 0.00   14 0.00  0 0  0
  10 0.70   60 0.00   20 0.00  0 0  0
   1 1.00    0 0.00   30 0.00  0 0  0
   1 1.00    0 0.00   90 0.00  0 0  0
   1 1.00   20 0.00   20 0.00  0 0  0
   7 1.00    5 0.00   45 0.00  0 0  0
  30 0.60    8 0.00   70 0.00  0 0  0
  18 0.85   33 0.00   16 0.00  0 0  0
 200 0.00    0 0.00    0 0.00  0 0  1
  20 0.00    0 0.00    0 0.00  0 0  1
  60 0.02    0 0.00   20 0.00  0 0  1
  35 0.03    3 1.00    2 1.00  0 0  1
  90 0.10    4 1.00    1 1.00  0 0  1
  30 0.00    1 1.00   40 0.00  0 0  1
  80 0.00   70 0.00    0 0.00  0 0  1
  45 0.00   30 0.00    0 0.00  0 0  1
  40 0.10   12 0.00    5 1.00  0 0  1
  24 0.00   80 0.00    3 1.00  0 0  1
   6 0.00    3 1.00   66 0.00  1 0  1
   9 0.00    1 1.00   25 0.00  1 0  1
   9 0.00   35 0.00   41 0.00  1 0  1
  15 0.00   38 0.00   17 0.00  0 1  1
  12 0.20   30 0.00   44 0.00  0 0  1
  20 0.30   15 0.00   26 0.00  0 1  1
   3 1.00    2 1.00    4 0.80  0 0  0
   5 0.00    6 1.00    3 1.00  0 0  0
   2 1.00    2 1.00    2 1.00  0 0  0
   3 1.00    3 1.00   30 0.00  0 1  0
   7 0.70   20 0.00    6 0.90  0 0  0
  20 0.80    5 1.00    9 1.00  0 0  0
  12 0.60   40 0.00    4 1.00  0 1  0
   4 0.00    0 0.00    2 1.00  1 0  0
   3 0.00   50 0.00    2 1.00  1 0  0
   9 0.60   30 0.00    0 0.00  0 0  0
   6 1.00    0 0.00    3 1.00  0 0  0
   8 1.00   60 0.00    7 1.00  0 1  0
"""
#: What a page's tags may say of a block (beside, named, article), and what it is then labelled: a block of the table is as likely to be met with these as without.
SAID = (((1, 0, 0), 0), ((0, 1, 0), 0), ((0, 0, -1), 0), ((0, 0, 1), 1), ((1, 0, 1), 0), ((0, 1, 1), 0))


def labelled() -> list[tuple[list[float], int]]:
    return [([float(x) for x in row[:-1]], int(row[-1])) for row in (line.split() for line in LABELLED.strip().splitlines())]


def grow(rows: list[tuple[list[float], int]], depth: int = 10, features: Sequence[int] = range(8)):
    """A decision tree by Gini impurity: (feature, threshold, tree if <=, tree if >) or a label. Ties go to the earlier feature and lower threshold."""
    ones = sum(y for _, y in rows)
    label = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return label
    best = None
    for f in features:
        values = sorted({x[f] for x, _ in rows})
        for lo, hi in zip(values, values[1:]):
            at = (lo + hi) / 2
            left = [y for x, y in rows if x[f] <= at]
            n, a, b = len(left), sum(left), ones - sum(left)
            m = len(rows) - n
            gini = 2 * a * (n - a) / n + 2 * b * (m - b) / m
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, at
    if best is None:
        return label
    _, f, at = best
    return f, at, grow([r for r in rows if r[0][f] <= at], depth - 1, features), grow([r for r in rows if r[0][f] > at], depth - 1, features)


def refine(tree, rows: list[tuple[list[float], int]]):
    """The tree with each leaf grown further by what tags may say, on the rows that come to it with and without that. Blocks that are links for the most part stay out even of an article."""
    if isinstance(tree, int):
        said = [(x + [float(v) for v in flags], y if x[1] <= 0.5 else 0) for x, _ in rows for flags, y in SAID]
        return grow([(x + [0.0, 0.0, 0.0], y) for x, y in rows] + said, features=(1, 8, 9, 10)) if rows else tree
    f, at, low, high = tree
    return f, at, refine(low, [r for r in rows if r[0][f] <= at]), refine(high, [r for r in rows if r[0][f] > at])


def decision_tree():
    """Grown on counts and densities alone, then refined by what tags may say."""
    rows = labelled()
    return refine(grow(rows), rows)


def keep(tree, x: list[float]) -> bool:
    while not isinstance(tree, int):
        f, at, low, high = tree
        tree = low if x[f] <= at else high
    return bool(tree)


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """The text, the number of blocks and of blocks kept."""
    found = blocks(page or "")
    own = [(float(b.words), b.link_words / b.words) for b in found]
    padded = [(0.0, 0.0), *own, (0.0, 0.0)]
    out = [b.text for i, b in enumerate(found) if keep(tree, [*own[i], *padded[i], *padded[i + 2], float(b.heading), float(b.item), float(b.beside), float(b.named), float(b.article)])]
    return "\n".join(out), len(found), len(out)


def _extracted(tree):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_kept", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns)):
                text, n, kept = main_text(page, tree)
                rows.append((page_id, url, text, len(text), n, kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_blocks, n_kept.

    Null and empty pages have an empty text. Character references are decoded,
    white space inside a block becomes one space, blocks are joined by one line
    end. Repeated rows each give a row, other columns are ignored, an empty
    table gives no rows.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(_extracted(decision_tree()), "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")

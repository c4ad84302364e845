"""Main text of web pages by two-pass block rules (operator 10).

A page is cut into blocks at block-level tags. First pass: stop-word density, length and link density decide a block good or
bad; a block inside a part that pages mark as something else (menu, form, sidebar, advert, notice, comments) is bad, and a
part marked as the article needs no stop words, only few links. Short blocks without links stay open. Second pass: an open
block takes the label of the nearest decided block before or after it, inside the article part if it stands there; between a good and a
bad one equally near, a heading goes with what follows it and other text with what precedes it. With no decided block it is good.

Good blocks are joined in page order by two line feeds; character references are decoded and white space inside a block becomes
one space. Null and empty pages give an empty text. Each row keeps its own row, repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import table

#: Frequent function words of the languages pages come in.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in
into is it its more my no not of on one or other our out she so some such than that the their them then there these they this to
up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die doch du ein eine einem einen einer er es für hat ich ihr im
ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle elles en est et être il ils je la le les leur lui mais me même ne nous on ou où par
pas plus pour qu que qui sa se ses son sont sur un une vous y
al como con de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por
porque que se ser si sin sobre son su sus también un una uno y ya
""".split())
LONG, SHORT, LINKS, DENSE, SPARSE = 140, 40, 0.33, 0.14, 0.07

NAME_END = r"(?![\w:-])"
ATTRS = r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+"""
#: Parts that are no text: up to the end of the page if unclosed, up to their end tag, or up to their end tag without another start before it.
#: One that is never closed is a tag like any other, as is an svg or math that closes itself.
ENDLESS, CLOSED, FLAT = "script|style|textarea|title", "noscript|template|iframe|svg|object|canvas|math", "button|select"
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)
|<(?P<endless>{ENDLESS}){NAME_END}(?>{ATTRS}>|[^>]*>).*?(?:</(?P=endless)\s*>|\Z)
|<(?!(?:svg|math){NAME_END}{ATTRS}(?<=/)>)(?P<closed>{CLOSED}){NAME_END}(?>{ATTRS}>|[^>]*>).*?</(?P=closed)\s*>
|<(?P<flat>{FLAT}){NAME_END}(?>{ATTRS}>|[^>]*>)[^<]*+(?:<(?!/?(?P=flat){NAME_END})[^<]*+)*+</(?P=flat)\s*>
|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{ATTRS}|[^>]*)>|<[!?][^>]*>""".replace("\n", ""), re.S | re.I)
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
OTHER = frozenset("nav aside footer form head menu dialog fieldset".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset(["hr"])
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
MARKED = re.compile(r"""(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banners?|sponsor\w*|promo\w*|menus?|nav|navi|navbar|navigation|sidebar\w*|side|aside|rail|
foot|footer|masthead|topbar|breadcrumbs?|cookies?|consent|gdpr|privacy|notices?|notification\w*|alerts?|warning|popup|overlay|modal|newsletter|subscri\w*|signup|login|
search|share|sharing|social|related|recommend\w*|recirc\w*|trending|popular|more|comment|comments|commentlist|respond|disqus|repl(?:y|ies)|discussion|reactions?|
widgets?|toolbar|pagination|pager|paywall|tags|tagcloud|copyright|legal|disclaimer|complementary|contentinfo|hidden)(?:$|[\s_-])""".replace("\n", ""), re.I)
ASIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|repl(?:y|ies)|related|recommend\w*|trending|teaser)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|banner)(?:$|[\s_-])", re.I)
BODY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-?body|content|entry|post|story|main|maincontent|hentry|blogpost)(?:$|[\s_-])", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos", re.I)


class Block:
    __slots__ = ("text", "linked", "inside", "other", "heading", "good")

    def __init__(self, text, linked, inside, other, heading):
        self.text, self.linked, self.inside, self.other, self.heading, self.good = text, linked, inside, other, heading, None


def _part(tag: str, attrs: str, inside: bool, other: bool) -> tuple[bool, bool]:
    """(in an article part, in some other part) below an element."""
    names = " ".join(a or b or c for a, b, c in NAMES.findall(attrs)) if attrs else ""
    marked = bool(names and tag not in ("html", "body") and MARKED.search(names)) or bool(attrs and HIDDEN.search(attrs))
    if tag in ARTICLE:  # articles of comments and teasers are others; words of any other kind do not make one of an article
        return True, other and inside or bool(names and ASIDE.search(names)) or bool(attrs and HIDDEN.search(attrs))
    if tag in OTHER or marked or ((tag == "header" or HEADER.search(names)) and not inside):
        return inside, True
    return inside or bool(names and BODY.search(names) and tag not in ("html", "body")), other


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, without empty ones."""
    out, parts, linked, links, breaks = [], [], 0, 0, 0
    stack = [("", False, False)]
    heading = False

    def flush():
        nonlocal parts, linked, breaks
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, stack[-1][1], stack[-1][2], heading))
        parts, linked, breaks = [], 0, 0

    at, end, open_end = 0, page.rfind(">") + 1, False  # what follows the last > holds no whole tag
    for m in TOKEN.finditer(page, 0, end):
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            if piece.strip():
                breaks = 0
                if links:
                    linked += len(html.unescape(piece).strip())
        at = m.end()
        open_end = at == end and (m[0].startswith("<!--") and not m[0].endswith("-->") or bool(m["endless"]) and not re.search(rf"</{m['endless']}\s*>$", m[0], re.I))
        tag = m["tag"].lower() if m["tag"] else None
        if tag is None:
            continue
        if tag == "a":
            links = max(0, links - 1) if m["end"] else links + 1
        elif tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
        elif tag in BLOCK:
            flush()
            links = 0
            if m["end"]:
                k = len(stack) - 1
                while k > 0 and stack[k][0] != tag:
                    k -= 1
                if k > 0 and not (tag in ("p", "li") and any(x[0] in ARTICLE or x[0] in ("div", "section", "ul", "ol") for x in stack[k + 1:])):
                    del stack[k:]
            elif tag not in VOID:
                while stack[-1][0] == "p" or stack[-1][0] in HEADINGS or (tag == stack[-1][0] and tag in ("li", "dt", "dd", "td", "th", "tr")):
                    stack.pop()
                if tag == "body":
                    del stack[1:]
                stack.append((tag, *_part(tag, m["attrs"], stack[-1][1], stack[-1][2])))
            heading = stack[-1][0] in HEADINGS
    if at < len(page) and not open_end:
        parts.append(page[at:end] + page[end:].split("<!--")[0])
    flush()
    return out


def decide(blocks: list[Block]) -> None:
    """First pass, then second: sets ``good`` of every block. A page none of whose long blocks has the stop words of a known language is judged
    by length and links alone."""
    article = any(b.inside and not b.other for b in blocks)
    density = []
    for b in blocks:
        words = [w.lower() for w in LETTERS.findall(b.text)] if len(b.text) >= SHORT else []
        density.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
    known = any(d >= SPARSE for b, d in zip(blocks, density) if len(b.text) >= LONG) or all(len(b.text) < LONG or b.other for b in blocks)
    for b, dense in zip(blocks, density):
        size, share = len(b.text), b.linked / len(b.text)
        if b.other or share > LINKS and not (b.inside and b.heading) or article and not b.inside or size < LONG and not b.inside and RIGHTS.search(b.text):
            b.good = False
        elif size >= SHORT:
            if b.inside and article:
                b.good = True
            elif size >= LONG and (dense >= SPARSE or not known):
                b.good = True
            elif dense < SPARSE and known:
                b.good = False
            elif dense >= DENSE and not b.heading:
                b.good = True
        elif b.linked and not b.inside:
            b.good = False
    _second_pass(blocks)


def _second_pass(blocks: list[Block]) -> None:
    """Labels of the nearest decided blocks for open ones; for a block inside the article part only blocks there count. One sweep each way."""
    def nearest(order):
        found, last, last_inside = {}, None, None
        for k in order:
            b = blocks[k]
            if b.good is None:
                found[k] = last_inside if b.inside else last
            else:
                last = k
                if b.inside and not b.other:
                    last_inside = k
        return found

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    labels = {}
    for k, i in before.items():
        j = after[k]
        if i is None or j is None:
            labels[k] = blocks[j if i is None else i].good if i is not j else True
        else:
            labels[k] = blocks[i if k - i < j - k or k - i == j - k and not blocks[k].heading else j].good
    for k, good in labels.items():
        blocks[k].good = good


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    decide(blocks)
    return "\n\n".join(b.text for b in blocks if b.good)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text, n_chars) for every row."""
    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    done = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return done.withColumnsRenamed({"id": id_col, "url": url_col})


def op10_blocks(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES, ORACLES = {"op10_blocks": op10_blocks}, {}

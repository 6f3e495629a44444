"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pages whose blocks a task holds at once.
AT_ONCE = 200
#: A block of fewer characters is short; one of more than LONG with many stop words is surely text.
SHORT, LONG = 70, 200
#: Shares of words that are stop words: a block with fewer than FEW is no prose, one with MANY is.
FEW, MANY = 0.15, 0.25
#: Shares of a block's characters that are in links: in the page at large, and inside its article.
LINKED, LINKED_IN_ARTICLE = 0.2, 0.5

# Frequent words of English, German, French, Spanish, Italian, Portuguese and Dutch that carry no topic.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its
    just more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up
    was we were what when which who will with would you your
    aber alle als am an auch auf aus bei bin bis da das dass dem den der des die dies diese doch du durch ein eine einem einen einer er es für
    hat ich ihr im in ist ja kann mehr mit nach nicht noch nur oder sein sich sie sind so um und uns unter vom von vor war was wenn wer werden wie wir wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous à été être
    al como con cuando de del el ella en entre era es esta este fue ha hay la las lo los más me muy no o para pero por que se ser si sin sobre su sus también un una y ya
    che ci con da dal dei del della di e è gli ha il io le loro ma mi nel nella non per più quando questo sono sua suo tra una uno
    ao aos com da das do dos ela ele em foi mas na nas nos não os ou para pela pelo por quando são se sem seu sua também um uma
    aan bij dat de deze die dit door een en er het hij hun ik is maar met naar niet nog of om onder ook op te tot uit van voor was wat we worden ze zijn zo
    """.split()
)
# Elements whose text is never shown, or is no text of the page.
UNSEEN = frozenset("script style noscript template iframe object svg canvas audio video head title select textarea button datalist map".split())
#: Of those, elements in which markup means nothing up to their end tag.
RAW = frozenset("script style iframe noscript textarea title".split())
# Elements around the text, ARIA roles and words of class or id that say the same.
AROUND = frozenset("nav header footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement adsbygoogle advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disqus footer gdpr
    header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion related recommended replies reply
    respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topnav widget
    """.split()
)
# Elements that begin and end a block, those that end one of their kind before them, and those that never have an end tag.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html
    legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul
    """.split()
)
REPEATED = frozenset("li dt dd tr td th option p".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Why a block is around the text. Some pages are one form, so an article in a form is an article.
IN_FORM, IN_BOILERPLATE = 1, 2

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_WORD = re.compile(r"[^\W\d_]+")


def _hinted(attributes: str, titled: bool) -> bool:
    """Whether class, id or role say that an element is not part of the text. ``titled``: in an article and on headings,
    a header is no such sign. Names that tell what an element has (``has-sidebar``) say nothing."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name in ("class", "id"):
            for one in value.split():
                said = [w.lower() for w in _NAME_WORD.findall(one)]
                if any(w in HINTS and not (titled and w == "header") for w in said) and said[0] not in ("has", "with", "no", "without"):
                    return True
    return False


def blocks(html: str) -> list[tuple[str, int, bool, int, bool]]:
    """The blocks of a page in its order: text, characters of it in links, whether it is around the text, number
    of the article it is in (0: none), whether it is a heading.

    A block is the text between two tags of block elements, in which other tags count for nothing and ``br`` is
    white space. Comments, declarations and unseen elements go; an element that is never closed ends with
    the one around it, a comment or raw element with the page, as does a tag without its end.
    """
    out: list[tuple[str, int, bool, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int, int]] = []  # element, and what holds outside of it: unseen, around the text, article
    opened: Counter[str] = Counter()
    unseen, around, article, articles, links, heading = False, 0, 0, 0, 0, False
    pattern, at, n = _TAG, 0, len(html)

    def close() -> None:
        nonlocal linked, parts
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, min(linked, len(text)), around > 0, article, heading))
        parts, linked = [], 0

    def leave() -> str:
        nonlocal unseen, around, article
        name, unseen, around, article = stack.pop()
        opened[name] -= 1
        return name

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not unseen:
            piece = unescape(html[at:lt])
            parts.append(piece)
            if links:
                linked += len(" ".join(piece.split()))
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = lt + 4 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
            at = n if end < 0 else html.index(">", end) + 1
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = pattern.match(html, lt)
        if m is None and pattern is _TAG and html[lt + 1 : lt + 3].lstrip("/")[:1].isalpha():
            pattern = _PLAIN_TAG  # a quote that never ends: quotes mean nothing from here on
            m = pattern.match(html, lt)
        if m is None:
            if html[lt + 1 : lt + 3].lstrip("/")[:1].isalpha():
                break
            if not unseen:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br" and not unseen:
            parts.append(" ")
        if tag in BLOCKS:
            close()
            heading, links = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and not closing, 0
            while stack and stack[-1][0] == "p" and not (closing and tag == "p"):
                leave()
        if closing:
            while opened[tag] and leave() != tag:
                pass
            continue
        while stack and (tag == "body" or (tag in REPEATED and stack[-1][0] == tag)):
            leave()
        if tag in VOID or (tag not in BLOCKS and tag not in UNSEEN):
            continue
        if tag in RAW:
            end = _END[tag].search(html, at)
            at = n if end is None else end.start()
        stack.append((tag, unseen, around, article))
        opened[tag] += 1
        hinted = tag not in ("html", "body") and _hinted(attributes, bool(article) or (heading and not closing))
        if tag == "main" or (tag == "article" and around == IN_FORM):
            around = 0
        if tag in ("article", "main") and not hinted and not around and (tag == "article" or not article):
            articles += 1
            article = articles
        if hinted or (tag in AROUND and not (tag == "header" and article)):
            around = IN_BOILERPLATE
        elif tag == "form":
            around = around or IN_FORM
        unseen = unseen or tag in UNSEEN
    close()
    return out


def stop_words(text: str) -> tuple[int, int]:
    """How many words of ``text`` are stop words, and how many it has."""
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found), len(found)


def _nearest(group: np.ndarray, decided: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each block how far the nearest decided ones of its stretch of equal ``group`` are before and after it (very
    far: there is none), and whether these are good."""
    n = len(group)
    at, first = np.arange(n), np.r_[True, group[1:] != group[:-1]][:n]
    start = np.maximum.accumulate(np.where(first, at, 0))
    end = np.minimum.accumulate(np.where(np.r_[first[1:], True][:n], at, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(decided, at, -1))
    after = np.minimum.accumulate(np.where(decided, at, n)[::-1])[::-1]
    far = 2 * n + 1
    to_before, to_after = np.where(before >= start, at - before, far), np.where(after <= end, after - at, far)
    return to_before, to_after, (to_before < far) & good[before], (to_after < far) & good[np.minimum(after, n - 1)]


def label(page: np.ndarray, chars: np.ndarray, stops: np.ndarray, linked: np.ndarray, around: np.ndarray, article: np.ndarray, heading: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which blocks are main text. Arrays have one entry per block; ``page`` (ascending) numbers its page, ``stops`` is
    its share of stop words, ``mark`` tells that it has a copyright sign.

    First pass. Bad are blocks around the text, blocks with too large a share of links, and outside of an article those with a
    copyright sign. Good are blocks of SHORT characters or more with MANY stop words, and longer than LONG with a FEW. In an
    article a FEW always do, and other blocks are open. In a page without an article, blocks of SHORT characters or more with
    fewer stop words are bad, and short ones with a link; others are open. If no block of such a page has stop words enough, it is in no known
    language, and blocks of SHORT characters or more are good. In a page with an article what is outside is bad; but if its articles
    have no heading, headings outside are open.

    Second pass. An open block gets the label of the nearest decided block: of its article, without those around the text, or
    of its page; with two equally near it is good if both are. An open block of an article in which nothing is decided
    is good, of a page bad. An open heading goes with the next decided block after it; the first one of an article is good.
    """
    if not len(page):
        return np.zeros(0, dtype=bool)
    inside, short = article > 0, chars < SHORT
    per_page = lambda x: np.bincount(page, x)[page] > 0
    has_article, titled, known = per_page(inside), per_page(inside & heading & ~around), per_page(~around & ~short & (stops >= FEW))
    bad = around | (linked / chars > np.where(inside, LINKED_IN_ARTICLE, LINKED)) | (mark & ~inside)
    good = ~bad & ~short & ((stops >= MANY) | ((stops >= FEW) & (inside | (chars > LONG))))
    outside = has_article & ~inside
    good, bad = good & ~outside, bad | (outside & (~heading | titled))
    free = ~has_article & ~bad & ~good
    good |= free & ~short & ~known & ~heading
    bad |= free & ~heading & np.where(short, linked > 0, known & (stops < FEW))
    to_before, to_after, good_before, good_after = _nearest(page, good | bad, good)
    inherited = np.where(to_before < to_after, good_before, np.where(to_after < to_before, good_after, good_before & good_after))
    result = np.where(good | bad, good, np.where(heading, good_after, inherited))
    own = np.flatnonzero(inside & ~around)
    if len(own):
        part = page[own] * (article.max() + 1) + article[own]
        to_before, to_after, good_before, good_after = _nearest(part, (good | bad)[own], good[own])
        inherited = np.where(to_before < to_after, good_before, np.where(to_after < to_before, good_after, (to_before == to_after) & (good_before & good_after | (to_before > len(own)))))
        inherited = np.where(heading[own] & (to_after <= len(own)), good_after, inherited)
        titles = np.flatnonzero(heading[own])
        inherited[titles[np.unique(part[titles], return_index=True)[1]]] = True
        result[own] = np.where((good | bad)[own], good[own], inherited)
    return result


def page_texts(pages: list[str | None]) -> list[str]:
    """Main texts of some pages."""
    rows = [(k, *b) for k, html in enumerate(pages) for b in blocks(html or "")]
    if not rows:
        return [""] * len(pages)
    page, texts, linked, around, article, heading = zip(*rows, strict=True)
    counted = [stop_words(t) for t in texts]
    stops = np.array([a / max(b, 1) for a, b in counted])
    mark = np.array(["©" in t for t in texts])
    chosen = label(np.array(page), np.array([len(t) for t in texts]), stops, np.array(linked), np.array(around), np.array(article), np.array(heading), mark)
    kept: list[list[str]] = [[] for _ in pages]
    for k, text, use in zip(page, texts, chosen.tolist(), strict=True):
        if use:
            kept[k].append(text)
    return ["\n".join(x) for x in kept]


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages(page_id, url, html)``: the page's main text, blocks
    joined by line ends, and its code points.

    Each page is judged alone, in the task that has its row, so nothing is shuffled and equal pages give equal texts. Null or empty html,
    or html without main text, gives an empty text; null ids and urls are passed on; repeated rows are rows. Extra columns
    are not read. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                texts = page_texts(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

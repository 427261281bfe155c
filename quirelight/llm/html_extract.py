"""Main-text extraction from HTML by two-pass block rules.

Pass one classifies every text block on its own: by the element it stands in
(navigation, header, footer, sidebar, advert, notice, form, comments; a name or a
form counts for nothing on a wrapper of the page's or article's text, nor on boxes
of one name that hold most of it together; a name counts as a whole token, so that
``share-price`` is no ``share``), by link density, by stop-word density and by
length.  Stop words decide only where they fit: not in a block of another script, nor on a page whose longer blocks are
mostly without them; there length alone decides.  Length is counted in words,
and in scripts without spaces in groups of letters.  Blocks that are too short or
too plain to decide stay open, long ones without stop words among them.  An article
in a boilerplate element (but navigation) is judged as in a named box.  Where all
would go, names that may mean something else count for nothing.  Inside an article or main element a linked block
is part of the text, unless it belongs to a list of links.  Pass two keeps open
blocks inside an article or main element and gives others the label of the
nearest decided neighbours; where two at the same distance differ they go, and
where none is decided they stay only if the page has no article and they are no
shorter together than a block that can be decided (a heading follows what comes after it, but for one short linked
line such as a byline).

Defined results: null and empty html give an empty text; broken markup is read
as far as it goes (unclosed elements end with their parents, an unclosed script,
style, textarea or comment or a tag without its ">" ends the page, another
unclosed element without text of the page ends before the next block element, a
quote that is never closed counts for nothing); very long and hostile pages take
time in proportion to their length; repeated rows keep their row; an empty table
gives no rows; columns named text or n_chars are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import spread

# Frequent function words of English, French, German, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset("""
a about all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
just like me more my no not of on one or our out she so some such than that the their them then there these they this to up was we were
what when which who will with would you your
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses
son sont sur un une vous
aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist kann man mit
nach nicht noch nur oder sich sie sind so um und uns von vor war wenn wie wir zu zum zur über
al como con cual cuando del donde el ella ellos entre era es esta este esto hay las los lo mas más me mi muy no nos para pero por porque
quien si sin sobre su sus también te tiene todo un una y ya
che di e gli il nel non per più sono da do em não os ao uma das dos
""".split())

#: Elements whose content is no text of the page: read up to their end tags as plain characters, and others.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea")}
_HIDDEN = frozenset("noscript template svg math iframe object canvas select option optgroup button title video audio datalist".split())
#: Of those, the ones that may close themselves.
_FOREIGN = frozenset("svg math".split())
#: A tag with quoted values, and one that ends at the first ">" whatever its quotes; neither pattern backtracks.
_TAG = re.compile(r"""<(/?)([a-zA-Z][\w:-]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>")
#: References to characters whose numbers are too long for any character, and leading zeros of others.
_LONG_REFERENCE = re.compile(r"&#(?:0*+[1-9][0-9]{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{7,});?")
_ZEROS = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])")
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_LIST = frozenset("ul ol menu dl".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are tracked as containers.
_CONTAINER = frozenset("address article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table td ul".split())
_BOILER = frozenset("nav footer aside menu dialog fieldset".split())
_MAIN = frozenset("article main".split())
_VOID = re.compile(r"/\s*\Z")
_ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Names of boxes that are no part of a text, names that may be, and words that say nothing beside either.
_STRONG = frozenset("""
ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies cookiebar consent gdpr newsletter
subscribe subscription signup login comment comments commentlist usercomments disqus replies respond sidebar nav navbar navigation menu breadcrumb
breadcrumbs footer masthead topbar toolbar pagination pager modal popup overlay search complementary contentinfo alertdialog
""".split())
_WEAK = frozenset("banner notice notification alert share sharing social related recommended recommendations widget skip header".split())
_NEUTRAL = frozenset("""
site main page post posts entry blog top bottom left right upper lower side list box container wrapper wrap area section block bar row col column
button buttons link links item items inner outer content body primary secondary global mobile desktop sticky fixed group holder region module
component panel strip slot unit zone form icons icon tools copyright thread reader user google wp js id
""".split())
#: Of those, names that make a single paragraph, heading, list item or phrase boilerplate.
_PARAGRAPH = frozenset("""
ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies cookiebar consent gdpr notice newsletter
subscribe subscription comment comments
""".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W_]+")

#: A word, or a group of letters as long as one in scripts written without spaces (Han and kana; Thai, Lao, Burmese, Khmer, Tibetan).
_HAN, _ABUGIDA = "\u3001-\u30ff\u3400-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff", "\u0e00-\u109f\u1780-\u17ff\u1950-\u19ff\ua9e0-\uaa7f"
_UNSPACED = re.compile(f"[{_HAN}{_ABUGIDA}]")
_WORD = re.compile(rf"[{_HAN}]{{1,2}}|[{_ABUGIDA}]{{1,4}}|[^\s{_HAN}{_ABUGIDA}]+")
#: Letters of scripts that no stop word is written in.
_OTHER_SCRIPT = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\u2c5f\u2c80-\u2dff\u3001-\ud7ff\uf900-\ufaff\ufb07-\ufdff\ufe70-\ufefe\uff66-\uffdc\U00010000-\U0001efff\U00020000-\U0003ffff]")
#: Names that say what stands beside or is missing.
_BESIDE_NAME = re.compile(r"(?<![^\s_-])(?:with|without|has|no)[_-][\w]+", re.I)
#: Phrases that are followed to their end tags, as one may be an advert or a notice.
_INLINE = frozenset("span small ins label".split())

GOOD, OPEN, BAD = 1, 0, -1
#: Words under which a block is short; stop-word share over which a longer one is decided; link share that ends it.
SHORT, DENSE, LINKED = 10, 0.15, 0.5
#: Share of the words around it, and words, over which a named container is a wrapper; the share where the name may mean something else.
WRAPS, WRAPPED, DOUBTED = 0.75, 30, 0.5


def _is_hidden(attributes: str) -> bool:
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _names(attributes: str) -> list[str]:
    """Class, id, role and label tokens."""
    return [token for name, value in _ATTR.findall(attributes) if name.lower() in ("class", "id", "role", "aria-label") for token in _BESIDE_NAME.sub("", value.strip("\"'")).split()]


def _says(token: str, names: frozenset[str]) -> bool:
    """Whether a token means one of ``names``: itself, or with words that say nothing; ``social-policy`` is no ``social``."""
    if re.sub(r"[-_0-9]", "", token).lower() in names:
        return True
    parts = [part.lower() for part in _PARTS.findall(token)]
    return any(part in names for part in parts) and all(part in _STRONG or part in _WEAK or part in _NEUTRAL or part.isdigit() for part in parts)


def _is_boiler_block(attributes: str) -> bool:
    """A hidden block or phrase, or one named as advert, notice or reader comment."""
    return _is_hidden(attributes) or any(_says(token, _PARAGRAPH) for token in _names(attributes))


#: Kinds of nodes: the page and its articles; named boxes; boxes whose name may mean something else; elements that are boilerplate but for an article in them.
TEXT, NAMED, MAYBE, ELEMENT = range(4)


def _kind(tag: str, attributes: str, inside_main: bool) -> int:
    """What a container is by its element and names."""
    if tag in _BOILER or tag == "header" and not inside_main:
        return ELEMENT
    if tag == "form":
        return NAMED
    names = _names(attributes) if attributes and tag not in ("html", "body", "main") else []
    if tag == "article":  # a reader's comment may be one
        return NAMED if any(_says(token, frozenset(("comment", "comments"))) for token in names) else TEXT
    if any(_says(token, _STRONG) for token in names):
        return NAMED
    return MAYBE if any(_says(token, _WEAK - {"header"} if inside_main else _WEAK) for token in names) else TEXT


class Node(NamedTuple):
    parent: int
    main: bool  # an article or main element
    kind: int
    name: str  # its tag and attributes


def _dropped(nodes: list[Node], own: list[int]) -> list[bool]:
    """Which nodes (the page, its article and main elements, named boxes and boilerplate elements, parents first) are boilerplate.

    A box is a wrapper if all articles with text around it are in it, or if it holds nearly all words around it and no article
    stands beside it; boxes of one name beside each other count together.
    """
    n = len(nodes)
    total, inner, count = list(own), [0] * n, [0] * n  # words; words and number of articles inside
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent
        total[up] += total[k]
        inner[up] += total[k] if nodes[k].main else inner[k]
        count[up] += count[k] + nodes[k].main
    alike: Counter[tuple[int, str]] = Counter()
    articles: Counter[tuple[int, str]] = Counter()
    for k in range(1, n):
        alike[nodes[k].parent, nodes[k].name] += total[k]
        articles[nodes[k].parent, nodes[k].name] += count[k]
    out = [False] * n
    for k in range(1, n):
        node, up = nodes[k], nodes[k].parent
        words, key = alike[up, node.name], (up, node.name)
        if out[up] or node.main:
            out[k] = out[up]
        elif 0 < inner[k] == inner[up] and not (nodes[up].main and own[up] >= SHORT):
            out[k] = False
        elif node.kind == ELEMENT:
            out[k] = True
        else:
            out[k] = articles[key] != count[up] or words < WRAPPED or words <= (DOUBTED if node.kind == MAYBE else WRAPS) * total[up]
    return out


def _length(words: list[str]) -> int:
    text = " ".join(words)
    return len(words) if text.isascii() or not _UNSPACED.search(text) else len(_WORD.findall(text))


def decoded(text: str) -> str:
    """``text`` with its character references decoded; numbers beyond all characters are U+FFFD."""
    if "&#" in text:
        text = _ZEROS.sub(r"&#\1", _LONG_REFERENCE.sub("\ufffd", text))
    return html.unescape(text)


class Token(NamedTuple):
    start: int
    end: int
    tag: str  # lower-cased; empty for comments and declarations, "[" for character data sections
    closing: bool = False
    attributes: str = ""


def scan(page: str) -> tuple[list[Token], int]:
    """(tokens, end of the text) of a page, in time that grows with its length.

    Once a tag has an open quote up to the page's end, tags end at the next ">".
    A tag that never ends, an open comment and an open script end the page.
    """
    out: list[Token] = []
    pattern, at, n = _TAG, 0, len(page)
    while (i := page.find("<", at)) >= 0:
        follows = page[i + 1 : i + 3]
        if follows[:1] in ("!", "?"):
            if page.startswith("<!--", i):
                end, size, tag = page.find("-->", i + 2), 3, ""
            elif page.startswith("<![CDATA[", i):
                end, size, tag = page.find("]]>", i + 9), 3, "["
            else:
                end, size, tag = page.find(">", i), 1, ""
                if end < 0:
                    return out, i
            at = end + size if end >= 0 else n
            out.append(Token(i, at, tag))
            continue
        name = follows[1:] if follows[:1] == "/" else follows[:1]
        if not (name.isascii() and name.isalpha()):
            at = i + 1
            continue
        m = pattern.match(page, i)
        if m is None and pattern is _TAG:
            pattern = _PLAIN_TAG
            m = pattern.match(page, i)
        if m is None:
            return out, i
        tag, closing, at = m.group(2).lower(), bool(m.group(1)), m.end()
        if tag in _RAW and not closing:
            close = _RAW[tag].search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else n
            out.append(Token(i, at, ""))
            continue
        out.append(Token(i, at, tag, closing, m.group(3)))
    return out, n


def _hidden(tokens: list[Token]) -> dict[int, tuple[int, bool]]:
    """For each token that opens a hidden element: the token at which that ends, and whether that is its end tag.

    An end tag counts within the containers it stands in; without one the element ends before the next block element.
    """
    ends: dict[int, tuple[int, bool]] = {}
    opened: list[tuple[str, int]] = []
    depth: Counter[str] = Counter()
    starts, edges, gone = [], [], set()
    for i, token in enumerate(tokens):
        tag = token.tag
        if tag in _BLOCK:
            edges.append(i)
        if tag not in _HIDDEN and tag not in _CONTAINER and tag not in _INLINE:
            continue
        if token.closing:
            while depth[tag]:
                last, start = opened.pop()
                depth[last] -= 1
                if last == tag:
                    if start in gone:
                        ends[start] = i, True
                    break
        elif tag in _HIDDEN and tag not in _FOREIGN or not _VOID.search(token.attributes):
            opened.append((tag, i))
            depth[tag] += 1
            if tag in _HIDDEN or tag in _INLINE and token.attributes and _is_boiler_block(token.attributes):
                starts.append(i)
                gone.add(i)
    edge = len(edges)
    for i in reversed(starts):
        if i not in ends:
            while edge and edges[edge - 1] > i:
                edge -= 1
            ends[i] = edges[edge] if edge < len(edges) else len(tokens), False
    return ends


class Block(NamedTuple):
    text: str
    links: int  # words in links
    words: int
    heading: bool
    boiler: bool  # in a boilerplate container
    main: int  # article or main container, -1 outside
    listed: int  # innermost list, -1 outside


def blocks(page: str) -> list[Block]:
    """The blocks in page order."""
    out: list[tuple[Block, int]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int, int, int]] = []  # open containers: tag, boilerplate, main container, node, list
    opened: Counter[str] = Counter()  # their tags
    nodes, own = [Node(-1, False, TEXT, "")], [0]  # own: words of a node outside those in it
    alone, unseen = False, -1  # the block itself is boilerplate; the depth of an open hidden container
    anchor, anchored, heading, lists, at = 0, 0, "", 0, 0  # anchor 1: a link in the text, 2: a link around blocks that ends with ``anchored`` containers

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = decoded("".join(text)).split()
            if words:
                links = _length(decoded(" ".join(linked)).split()) if linked else 0
                n = _length(words)
                _, boiler, main, node, listed = stack[-1] if stack else ("", False, -1, 0, -1)
                boiler = boiler or alone
                out.append((Block(" ".join(words), links, n, bool(heading), boiler, main, listed), node))
                if not boiler and links <= LINKED * n:
                    own[node] += n
            text, linked = [], []

    def closed(down_to: int) -> None:
        nonlocal anchor, unseen
        for tag, *_ in stack[down_to:]:
            opened[tag] -= 1
        del stack[down_to:]
        if anchor == 2 and len(stack) < anchored:
            anchor = 0
        if len(stack) <= unseen:
            unseen = -1

    tokens, stop = scan(page)
    hidden = _hidden(tokens)
    resume = 0  # the token after a hidden element
    for i, token in enumerate(tokens):
        if i < resume:
            continue
        if token.start > at:
            piece = page[at : token.start]
            text.append(piece)
            if anchor:
                linked.append(piece)
        at = token.end
        if i in hidden:
            end, whole = hidden[i]
            resume = end + whole
            at = tokens[end].end if whole else tokens[end].start if end < len(tokens) else stop
            continue
        tag, closing = token.tag, token.closing
        if tag == "[":
            text.append(html.escape(page[token.start + 9 : token.end - 3]))
        elif tag == "a":
            anchor, anchored = 0 if closing else 1, len(stack)
        elif tag == "br":
            text.append(" ")
        elif tag in _BLOCK:
            if anchor == 1:  # around the block if nothing of the link came before it, else not closed
                anchor = 0 if closing or any(p.strip() for p in linked[-1:]) else 2
            flush()
            alone = not closing and tag not in _CONTAINER and bool(token.attributes) and _is_boiler_block(token.attributes)
            if tag in _HEADING:
                heading = "" if closing else tag
            elif not closing:
                heading = ""
            if tag in _CONTAINER:
                if closing:
                    if opened[tag]:
                        closed(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                elif not _VOID.search(token.attributes):
                    if tag in _MAIN:  # an article ends what was left open before it
                        keep = len(stack)
                        while keep and stack[keep - 1][0] in ("nav", "header", "menu", "ul", "ol"):
                            keep -= 1
                        closed(keep)
                    _, boiler, main, node, listed = stack[-1] if stack else ("", False, -1, 0, -1)
                    kind = _kind(tag, token.attributes, main >= 0)
                    fresh = tag in _MAIN and kind == TEXT
                    if _is_hidden(token.attributes):
                        boiler, unseen = True, len(stack) if unseen < 0 else unseen
                    elif unseen < 0 and (fresh or kind != TEXT and not boiler):  # an article starts anew in a boilerplate element
                        nodes.append(Node(node, fresh, kind, f"{tag} {token.attributes}"))
                        own.append(0)
                        node = len(nodes) - 1
                        main = node if fresh else main
                        boiler = kind == ELEMENT
                    if tag in _LIST:
                        listed, lists = lists, lists + 1
                    opened[tag] += 1
                    stack.append((tag, boiler, main, node, listed))
    text.append(page[at:stop])
    flush()
    dropped = _dropped(nodes, own)
    found = [b._replace(boiler=b.boiler or dropped[node]) for b, node in out]
    if not any(label == GOOD for label in classify(found)):  # names in doubt count for nothing where they leave nothing
        sure = [False] * len(nodes)
        for k in range(1, len(nodes)):
            sure[k] = sure[nodes[k].parent] or dropped[k] and nodes[k].kind != MAYBE and nodes[k].kind != TEXT
        found = [b._replace(boiler=b.boiler or sure[node]) for b, node in out]
    return found


def _menus(found: list[Block]) -> set[int]:
    """Lists of two or more blocks that are links and nothing else."""
    all_links: dict[int, list[bool]] = {}
    for b in found:
        if b.listed >= 0:
            all_links.setdefault(b.listed, []).append(b.links > LINKED * b.words)
    return {k for k, linked in all_links.items() if len(linked) > 1 and all(linked)}


def _stop_share(text: str, words: int) -> float | None:
    """Share of stop words in a block; none where it is written in another script."""
    if not text.isascii() and 2 * len(_OTHER_SCRIPT.findall(text)) > len(text) - text.count(" "):
        return None
    return sum(w.strip(".,;:!?%&*#$\"'()[]-…").lower() in STOP_WORDS for w in text.split()) / words


def classify(found: list[Block]) -> list[int]:
    """Labels of the blocks after both passes."""
    labels, shares, menus = [], {}, _menus(found)
    for i, b in enumerate(found):
        dense = b.links > LINKED * b.words
        labels.append(BAD if b.boiler or dense and (b.main < 0 or b.listed in menus) else OPEN)
        if not labels[i] and not dense and b.words >= SHORT:
            shares[i] = _stop_share(b.text, b.words)
    judged = [i for i, share in shares.items() if share is not None]
    fits = 2 * sum(found[i].words for i in judged if shares[i] >= DENSE) > sum(found[i].words for i in judged)
    for i, share in shares.items():
        if share is None or not fits or share >= DENSE:
            labels[i] = GOOD
    final = list(labels)
    n = len(found)
    apart = any(b.main >= 0 for b in found) or sum(b.words for b, label in zip(found, labels, strict=True) if label == OPEN) < SHORT
    before, after = [-1] * n, [-1] * n  # nearest decided neighbours outside article and main elements
    last = -1
    for i in range(n):
        before[i] = last
        if labels[i] and not found[i].boiler and found[i].main < 0:
            last = i
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i] and not found[i].boiler and found[i].main < 0:
            last = i
    for i in range(n):
        if labels[i] == OPEN:
            a, b = before[i], after[i]
            if found[i].heading and b >= 0 and found[b].words < SHORT and labels[b] == BAD and after[b] >= 0 and labels[after[b]] == GOOD:
                b = after[b]  # past a byline
            if found[i].main >= 0:
                final[i] = GOOD
            elif a < 0 and b < 0:
                final[i] = BAD if apart else GOOD
            elif a < 0 or b < 0:
                final[i] = labels[max(a, b)]
            elif labels[a] == labels[b]:
                final[i] = labels[a]
            elif found[i].heading:
                final[i] = labels[b]
            elif i - a != b - i:
                final[i] = labels[a] if i - a < b - i else labels[b]
            else:
                final[i] = BAD
    return final


def extract(page: str | None) -> str:
    """Main text of one page: its good blocks in page order, one to a line."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, classify(found), strict=True) if label == GOOD)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) from the whole ``html``."""
    pages = spread(pages.drop("text", "n_chars"))
    carried = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page) for page in batch.column("html").to_pylist()]
            yield tb.extend(batch, carried, text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields if f.name != "html")
    return pages.mapInArrow(tb.trimmed(run), f"{fields}text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    return extract_pages(pages.select("page_id", "url", F.col("html")))

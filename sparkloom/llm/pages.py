"""Operator 13: the main text of web pages by two passes of rules over their blocks."""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------------------------------------------------
#: Frequent words without a meaning of their own, by language.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i if in into is it its not of on or our she so that the their them then there they this to was we were which will with you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so um und uns von war was wie wir zu zum zur",
    "fr": "à au aux avec ce ces cette comme d dans de des du elle en est et il ils je l la le les leur mais n ne nous on ou par pas plus pour qu que qui s sa se ses son sur un une vous y",
    "es": "a al como con de del desde el ella en entre es esta este fue ha la las le lo los más mi no o para pero por que se si sin sobre son su sus también un una y ya",
    "it": "a al alla anche che chi ci come con da dal dalla dei del della delle di e è gli ha i il in la le lo ma mi nel nella non o per più quale se si sono su sua suo tra un una",
    "pt": "a ao aos as com como da das de do dos e é ela ele em entre essa esta este foi mais mas na nas no nos não o os ou para pela pelo por que se sem seu sua são também um uma",
    "nl": "aan als bij dat de deze die dit door een en er haar het hij hun ik in is je maar met na naar niet nog of om onder ook op over te tot uit van voor was wat we wel werd wordt ze zich zijn",
}
#: Elements that begin and end a block of text.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and that no reader sees as text.
RAW = set("script style title textarea xmp iframe noembed noframes".split())
#: Elements that hold no part of an article.
OUTSIDE = set("nav aside footer form head noscript template button select svg math object canvas audio video dialog menu map search".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element on the left ends an open one on the right, if none of the third column is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
#: Words in class, id and role. Of the first two kinds nothing is kept; the third may also name a wrapper of all.
READERS = re.compile(r"comment(s|list|ed|er|ers|form)?|disqus|discussion|replies|reply|respond|responses|reviews|feedback|guestbook")
PAID = re.compile(r"ads?|adv|advert\w*|adbox|adsense|adslot|adunit|adsby\w*|dfp|gpt|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|lightbox|overlay|newsletter|subscri\w+|signup|paywall|outbrain|taboola|alert|alertdialog|dialog")
AROUND = re.compile(
    r"sidebar|side|rail|nav|navi|navbar|navigation|menu|menubar|breadcrumbs?|crumbs?|header|masthead|topbar|footer|bottombar|colophon|contentinfo|complementary|banner|toolbar|search|login|social|share|sharing|sharebar|follow|related|recommend\w*|recirc\w*|teasers?|trending|popular|more|widgets?|"
    r"pagination|pager|paging|notice|notices|disclaimer|copyright|legal|skip|tags|tagcloud|byline|author|bio|rating|print|hidden"
)
INSIDE = re.compile(r"article|articlebody|story|post|entry|content|maincontent|main|text|prose|hentry")
# --------------------------------------------------------------------------------------------------------------------

#: A block of so many characters says something by its stop words; of so many it is long.
SHORT, LONG = 50, 200
#: Share of stop words from which a block is prose, and share of link characters beyond which it is none.
PROSE, LINKED = 0.1, 0.5

#: Zones: of no known kind, the article, what may be around it, what surely is.
PLAIN, ARTICLE, MAYBE, NEVER = range(4)
BAD, OPEN, GOOD = -1, 0, 1

_VALUE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({_VALUE})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden|href)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+)))?""", re.I)
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")


@functools.lru_cache(1 << 14)
def _hint(name: str, attributes: str) -> tuple[int, bool]:
    """(zone that an element asks for, whether it links); PLAIN if it asks for none."""
    given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(NAMED.finditer(attributes)))}
    linked = name == "a" and "href" in given
    if name in ("html", "body"):
        return PLAIN, False
    words = [w.lower() for k in ("class", "id", "role") for w in CAMEL.split(given.get(k, "")) if w]
    if name in OUTSIDE or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "").lower()):
        return NEVER, linked
    if any(READERS.fullmatch(w) or PAID.fullmatch(w) for w in words):
        return NEVER, linked
    if name in ("article", "main") or given.get("role", "").lower() in ("main", "article"):
        return ARTICLE, linked
    if name == "header" or any(AROUND.fullmatch(w) for w in words):
        return MAYBE, linked
    return (ARTICLE if any(INSIDE.fullmatch(w) for w in words) else PLAIN), linked


def blocks(page: str) -> list[tuple[str, int, int, bool]]:
    """The page's blocks in order: (text, link characters, zone, whether a heading).

    References are decoded and white space is one space. A run of text between two borders of block elements is a
    block; elements that a writer has left open end where the standard ends them.
    """
    out, pieces, links = [], [], 0
    stack: list[tuple[str, int, bool]] = []  # open elements: name, zone, linked
    opened: dict[str, int] = {}
    zone, linked, heading, at = PLAIN, False, False, 0

    def flush():
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, min(links, len(text)), zone, heading))
            pieces.clear()
            links = 0

    def state():
        nonlocal zone, linked
        zone, linked = (stack[-1][1], stack[-1][2]) if stack else (PLAIN, False)

    def cut(to: int):
        for name, _, _ in stack[to:]:
            opened[name] -= 1
        del stack[to:]
        state()

    def close(names: set[str], walls: set[str] = frozenset()):
        """Ends the innermost open element of ``names``, and what is open in it, unless a wall is between."""
        if any(opened.get(n) for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    return cut(i)
                if stack[i][0] in walls:
                    return None
        return None

    def say(text: str):
        nonlocal links
        if text and not (zone == NEVER and stack[-1][0] not in BLOCKS and pieces):  # an inline advert doesn't cut its block
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if linked:
                links += len(text.strip())

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if m[1]:
            if block:
                flush()
                close({name})
                heading = heading and name not in HEADINGS
            else:
                close({name}, BLOCKS)
            continue
        if name == "br":
            say(" ")
            continue
        if block:
            flush()
            close({"p"}, {"td", "th", "table", "button", "object"})
            if name in ENDS:
                close(*ENDS[name])
            heading = name in HEADINGS or heading and any(opened.get(h) for h in HEADINGS)
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(page, at)
            at = end if stop is None else (page.find(">", stop.start()) + 1 or end)
            continue
        if name in VOID:
            continue
        asked, links_on = _hint(name, m[3])
        own = zone
        if zone != NEVER:
            if asked == NEVER:
                own = NEVER
            elif asked == ARTICLE and (zone != MAYBE or name in ("article", "main")):
                own = ARTICLE
            elif asked == MAYBE and block and not (name == "header" and zone == ARTICLE):
                own = MAYBE
        if own != zone and (block or own != NEVER):
            flush()
        stack.append((name, own, linked or links_on))
        opened[name] = opened.get(name, 0) + 1
        zone, linked = own, linked or links_on
    flush()
    return out


_LANGUAGES = [frozenset(words.split()) for words in STOP_WORDS.values()]
_STOPS = {w: i for i, w in enumerate(sorted(frozenset().union(*_LANGUAGES)))}
#: Which languages have a stop word, as a row of zeros and ones.
_MASKS = np.array([[w in words for words in _LANGUAGES] for w in _STOPS], float)


def densities(texts: list[str]) -> np.ndarray:
    """Share of stop words of each text, by the language that has most of them in all texts."""
    n, place, found = np.zeros(len(texts)), [], []
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        n[i] = len(words)
        stops = [_STOPS[w] for w in words if w in _STOPS]
        place.append(len(stops))
        found += stops
    hits = np.zeros((len(texts), len(_LANGUAGES)))
    if found:
        np.add.at(hits, np.repeat(np.arange(len(texts)), place), _MASKS[found])
    return hits[:, hits.sum(axis=0).argmax()] / np.maximum(n, 1)


def inherit(label: np.ndarray, run: np.ndarray, heading: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Open labels get that of the nearest decided block of their run: of two as near the later for a heading, else the
    earlier; with none in the run, ``otherwise``."""
    n = np.arange(len(label))
    known = label != OPEN
    before = np.maximum.accumulate(np.where(known, n, -1))
    after = np.minimum.accumulate(np.where(known, n, len(label))[::-1])[::-1]
    has_before = (before >= 0) & (run[np.maximum(before, 0)] == run)
    has_after = (after < len(label)) & (run[np.minimum(after, len(label) - 1)] == run)
    back, on = n - before, after - n
    take_after = has_after & (~has_before | (on < back) | (on == back) & heading)
    near = np.where(take_after, np.minimum(after, len(label) - 1), np.maximum(before, 0))
    return np.where(known, label, np.where(has_before | has_after, label[near], otherwise))


def judge(found: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Whether each block belongs to the main text."""
    if not found:
        return np.zeros(0, bool)
    zone, heading = np.array([b[2] for b in found]), np.array([b[3] for b in found])
    size = np.array([len(b[0]) for b in found])
    linked = np.array([b[1] for b in found]) / size
    density = densities([b[0] for b in found])

    def labels(zone):
        first = np.full(len(found), OPEN)
        first[(size >= SHORT) & (density >= PROSE)] = GOOD
        first[(size >= SHORT) & (density < PROSE) & (zone == PLAIN)] = BAD
        first[(size < LONG) & (zone == PLAIN) & (linked > 0) & (density < PROSE)] = BAD
        first[heading & (size < LONG)] = OPEN
        first[(linked > LINKED) & ~heading] = BAD
        first[zone >= MAYBE] = BAD
        run = np.cumsum(np.diff(zone == ARTICLE, prepend=False))  # an article's blocks ask only each other
        return inherit(first, run, heading, np.where(zone == ARTICLE, GOOD, BAD)) == GOOD

    good = labels(zone)
    if not good.any() and (zone == MAYBE).any():  # the hint named a wrapper of all
        zone = np.where(zone == MAYBE, PLAIN, zone)
        good = labels(zone)
    inside = good & (zone == ARTICLE)
    return inside if 0 < size[good].sum() <= 2 * size[inside].sum() else good


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, ok in zip(found, judge(found), strict=True) if ok)


def _texts(batches, at: int):
    for batch in batches:
        texts = pa.array([main_text(page.as_py()) for page in batch.column(at)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])


def extract_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points.

    Blocks are classified by the stop words of the page's language, by length and by the share of links; elements and
    their classes say what is surely outside (menus, adverts, forms, comments) or inside an article. Blocks too short to
    tell, and headings, then get the label of the nearest decided block. All kept blocks are joined in order by \\n.

    A null or empty page, or one without a main text, has the text ''. Pages are independent: repeated rows give
    repeated results, nothing is shuffled, and a page of any length is read whole, in time linear in its length. Columns of ``pages`` with the names
    made here are replaced, others stay; an empty table stays empty.
    """
    if html_col in ("text", "n_chars"):
        raise ValueError("rename the html column first")
    kept = pages.drop("text", "n_chars")
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())])
    at = kept.columns.index(html_col)
    return kept.mapInArrow(lambda batches: _texts(batches, at), schema).withColumn("n_chars", F.char_length("text").cast("long"))


def _listed(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            found = blocks(batch.column(1)[i].as_py() or "")
            n = len(found)
            text, links, zone, heading = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1).take(pa.array([0] * n, pa.int32())), pa.array(range(n), pa.int32()), pa.array(text, pa.string()), pa.array(links, pa.int64()), pa.array(zone, pa.int32()), pa.array(heading, pa.bool_()), pa.array(judge(found).tolist(), pa.bool_())],
                names=["page_id", "place", "text", "link_chars", "zone", "heading", "kept"],
            )


def page_blocks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every block of every page with its place, features and label: what :func:`extract_text` decides by."""
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(_listed, f"page_id {kind}, place int, text string, link_chars long, zone int, heading boolean, kept boolean").withColumnRenamed("page_id", id_col)

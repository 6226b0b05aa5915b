"""Text lines of an HTML page, each with the zone it stands in."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Fixed word lists: elements and class, id or role words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub mfrac msqrt mroot semantics".split()
)
SKIPPED = frozenset(
    "script style noscript template iframe object applet canvas svg audio video title form button input select option"
    " textarea fieldset datalist dialog nav menu footer aside".split()
)
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav rail widget widgets masthead topbar toolbar footer"
    " comment comments commentlist disqus respond replies reply notice notices cookie cookies consent gdpr popup modal overlay"
    " newsletter subscribe subscription signup login social share sharing related recommended recommendations pagination pager"
    " search searchbox form contentinfo complementary alert dialog skip copyright aside side discussion adbox adslot leaderboard"
    " topnav subnav mainnav dropdown offcanvas toast popover".split()
)
SKIPPED_STEMS = tuple("sidebar comment cookie advert newsletter navbar breadcrumb footer masthead sponsor disqus".split())
# Inside an open article only these count, as whole class, id or role names: adverts on any element, the others on containers.
ADVERTS = frozenset("ad ads advert advertisement adsbygoogle sponsored".split())
SKIPPED_IN_ARTICLE = frozenset(
    "comments comment-list commentlist comments-area comment-respond respond disqus_thread newsletter newsletter-signup subscribe"
    " related related-posts related-articles share share-buttons sharing social social-share cookie-notice sidebar".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol table td figure center".split())
NO_STEM = frozenset({"commentary", "commentator"})
HEADER_WORDS = frozenset("header head heading banner".split())
MAIN_WORDS = frozenset("article articlebody content main post entry story body text".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)

ARTICLE, MAIN, MARKED, OTHER, INSIDE, FRAME = 3, 2, 1, 0, -1, -2
# Elements without lines of their own: nothing in them is text of the page.
NO_LINES = SKIPPED - frozenset("nav menu footer aside form fieldset dialog".split())
_WORDS = re.compile(r"[a-z0-9]+")
_HAS = re.compile(r"(?<!\S)(?:has|no|with|without)-\S+")  # says what stands beside the element, not what it is
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_skipped(name: str) -> bool:
    """Whether a class, id or role word names something that is no article text."""
    if name in SKIPPED_WORDS:
        return True
    return name not in NO_STEM and not name.startswith("has-") and any(stem in name for stem in SKIPPED_STEMS)


class PageLines(HTMLParser):
    """``lines`` of (text, zone): one line per block, white space runs as one blank.

    Text in elements that the markup names as no article text (menus, headers, footers,
    sidebars, notices, adverts, forms, comments) is a line of zone ``FRAME``; scripts, styles and controls give none. Names of
    classes and ids do not count on headings, and in an open article only whole names of adverts, reader comments and their like do. The zone is the
    innermost of: an article element, a main element, an element whose class or id
    says that it holds the content, anything else. An article or main element in an
    element that only its class, id or role names as no article text is a zone of its own, ``INSIDE``:
    a wrapper's name may speak of one part of it. ``best`` is the highest zone opened.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, str]] = []  # tag, zone, reason why it is skipped
        self.lines: list[tuple[str, int]] = []
        self.words: list[str] = []
        self.frame: list[str] = []
        self.zone_of_line, self.best = OTHER, OTHER

    def _state(self) -> tuple[int, str]:
        return self.open[-1][1:] if self.open else (OTHER, "")

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, self.zone_of_line))
        beside = " ".join("".join(self.frame).split())
        if beside:
            self.lines.append((beside, FRAME))
        self.words, self.frame = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p")
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._close_sibling(tag)
        if tag == "body":
            self.open = []
        zone, skipped = self._state()
        given = {k: v or "" for k, v in attrs}
        named = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".lower()
        # an article's own classes often speak of its comments or share buttons: whole names only
        names = set(named.split() if tag in ("article", "main") else _WORDS.findall(_HAS.sub(" ", named)))
        reason = ""
        if tag in SKIPPED:
            reason = tag
        elif zone in (ARTICLE, MAIN, INSIDE) and tag not in ("article", "main"):
            whole = set(named.split())
            if whole & ADVERTS or tag in CONTAINERS and whole & SKIPPED_IN_ARTICLE:
                reason = "marked"
        elif tag not in ("html", "body") and tag not in HEADINGS and any(_is_skipped(n) for n in names):
            reason = "marked"
        if not reason and ("hidden" in given or _HIDDEN.search(given.get("style", ""))):
            reason = "hidden"
        elif not reason and (tag == "header" or names & HEADER_WORDS and tag in ("div", "section")) and zone == OTHER:
            reason = "header"
        if tag in ("article", "main") and not reason:
            if skipped in ("nav", "header", "menu", "head"):  # left open by mistake
                skipped = ""
            if skipped == "marked" and zone < ARTICLE:
                zone, skipped = INSIDE, ""
            elif not skipped and zone != INSIDE:
                zone = max(zone, ARTICLE if tag == "article" else MAIN)
        elif not reason and not skipped and zone == OTHER and tag in ("div", "section", "td") and names & MAIN_WORDS:
            zone = MARKED
        if not (reason or skipped):
            self.best = max(self.best, zone)
        if skipped == "marked" and (reason == "hidden" or reason in SKIPPED - {"nav", "menu"}):
            skipped = reason
        self.open.append((tag, zone, skipped or reason))

    def _close(self, tag: str) -> None:
        """Close the innermost open ``tag`` unless another block has been opened in it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] not in INLINE:
                return

    def _close_sibling(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag or (tag, self.open[i][0]) in (("td", "th"), ("th", "td"), ("dt", "dd"), ("dd", "dt")):
                del self.open[i:]
                return
            if self.open[i][0] in ("ul", "ol", "dl", "table", "tr", "body", "article", "main", "section", "div"):
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        zone, skipped = self._state()
        if skipped:
            if skipped not in NO_LINES:
                self.frame.append(data)
            return
        if not self.words:
            self.zone_of_line = zone
        self.words.append(data)


def page_lines(html: str) -> tuple[list[tuple[str, int]], int]:
    """Lines with zones, and the page's best zone."""
    parser = PageLines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines, parser.best

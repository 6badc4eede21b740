"""A small HTML tree: elements in page order, the text they own, and per-element features."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np

# Element names of the HTML standard by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr",
          "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
          "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCKS - {"button", "caption", "head", "html", "body", "legend", "li", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GROUPS = [{"p", "blockquote", "pre"}, HEADINGS, {"li", "ul", "ol", "dl", "dt", "dd", "menu"}, {"a"}, {"div", "section", "td", "tr", "table", "tbody"},
          {"article", "main"}, {"nav", "footer", "aside", "header"},
          {"form", "input", "button", "select", "option", "textarea", "label", "fieldset", "legend", "dialog"}]
MAIN, OFF, FORM = GROUPS[5], GROUPS[6], GROUPS[7]
#: words in class, id and role attributes
GOOD_WORDS = {"article", "body", "content", "entry", "main", "page", "post", "story", "text", "prose"}
BAD_WORDS = {"ad", "ads", "advert", "advertisement", "aside", "banner", "bar", "button", "breadcrumb", "breadcrumbs", "comment", "comments",
             "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "dialog", "discussion", "fieldset", "foot", "footer", "form", "gdpr", "head",
             "header", "input", "label", "links", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup",
             "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social",
             "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "widget"}
FEATURES = ["log_chars", "log_own", "log_below", "density", "links", "punctuation", "depth", "siblings", "place", "same_siblings", "share",
            "before", *[f"group{k}" for k in range(len(GROUPS))], "good", "bad", "main_above", "off_above", "good_above", "bad_above",
            "form_above", "sibling_chars", "parent_links"]

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)
    |<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """Elements in page order. ``events`` lists, in page order, (element, text) and (element, None) for block edges."""

    __slots__ = ("tags", "parents", "attributes", "events")

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#root"], [-1], [""]
        self.events: list[tuple[int, str | None]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        tags, parents, events, open_ = self.tags, self.parents, self.events, [0]
        at = 0

        def text(upto: int) -> None:
            if upto > at:
                piece = source[at:upto]
                events.append((open_[-1], html.unescape(piece) if "&" in piece else piece))

        def close(depth: int) -> None:
            while len(open_) > depth:
                gone = open_.pop()
                if tags[gone] in BLOCKS:
                    events.append((open_[-1], None))

        match = TOKEN.search(source)
        while match:
            text(match.start())
            at = match.end()
            name = match[2] or match[4]
            if name:
                name = name.lower()
                attributes = match[3] if match[2] else match[5]
                if name in CLOSES_P:  # a block ends an open paragraph
                    for depth in range(len(open_) - 1, 0, -1):
                        if tags[open_[depth]] == "p":
                            close(depth)
                            break
                        if tags[open_[depth]] in BLOCKS:
                            break
                elif name in ("li", "option", "td", "th", "tr", "dt", "dd"):  # ends its open sibling
                    ends = {"dt", "dd"} if name in ("dt", "dd") else {"td", "th", "tr"} if name == "tr" else {"td", "th"} if name in ("td", "th") else {name}
                    stops = {"ul", "ol", "menu", "table", "tbody", "select", "dl", "tr"} - ends
                    lowest = None
                    for depth in range(len(open_) - 1, 0, -1):
                        if tags[open_[depth]] in ends:
                            lowest = depth
                        elif tags[open_[depth]] in stops:
                            break
                    if lowest:
                        close(lowest)
                if name in BLOCKS:
                    events.append((open_[-1], None))
                elif name == "br":
                    events.append((open_[-1], " "))
                tags.append(name)
                parents.append(open_[-1])
                self.attributes.append(attributes)
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
                elif name not in VOID and not attributes.endswith("/"):
                    open_.append(len(tags) - 1)
                elif name not in VOID and name not in BLOCKS:
                    open_.append(len(tags) - 1)
            elif match[1]:
                name = match[1].lower()
                for depth in range(len(open_) - 1, 0, -1):
                    if tags[open_[depth]] == name:
                        close(depth)
                        break
                    # an inline end tag does not close the blocks around it
                    if name not in BLOCKS and tags[open_[depth]] in BLOCKS:
                        break
            match = TOKEN.search(source, at)
        text(len(source))
        close(1)

    def text(self, chosen) -> str:
        """Blocks of the chosen elements' own text, white space folded, one a line."""
        blocks, parts = [], []
        for element, piece in self.events:
            if piece is not None and chosen[element]:
                parts.append(piece)
            elif piece is None and parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        blocks.append(" ".join("".join(parts).split()))
        return "\n".join(b for b in blocks if b)

    def features(self) -> np.ndarray:
        """One row of ``FEATURES`` for each element."""
        n = len(self.tags)
        own, marks, before = [0] * n, [0] * n, [0] * n
        seen, started = 0, 0
        firsts: dict[int, int] = {}
        for element, piece in self.events:
            if piece is not None:
                size = len(piece) - piece.count(" ") if not piece.isspace() else 0
                firsts.setdefault(element, seen)
                own[element] += size
                marks[element] += len(PUNCTUATION.findall(piece))
                seen += size
        chars, below, links, points = own[:], [0] * n, [0] * n, marks[:]
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(n - 1, 0, -1):
            p = self.parents[v]
            if self.tags[v] == "a":
                links[v] = chars[v]
            chars[p] += chars[v]
            links[p] += links[v]
            points[p] += points[v]
            below[p] += below[v] + 1
            children[p].append(v)
            firsts[v] = min(firsts.get(v, seen), *(firsts[c] for c in children[v])) if children[v] else firsts.get(v, seen)
        total = max(1, chars[0])
        # once a parent, so that many siblings cost no more than few
        alike = [Counter(self.tags[c] for c in beside) for beside in children]
        held = [sum(chars[c] for c in beside) for beside in children]
        depth, rows = [0] * n, []
        above = [(0, 0, 0, 0, 0)] * n
        groups = [[float(tag in g) for g in GROUPS] for tag in self.tags]
        for v, tag in enumerate(self.tags):
            p = self.parents[v]
            # element names that say what they hold count as words, too
            words = {tag} if tag in MAIN | OFF | FORM else set()
            if self.attributes[v]:
                words |= {w for a in ATTRIBUTE.findall(self.attributes[v]) for w in WORD.findall("".join(a).lower())}
            good, bad = sum(w in GOOD_WORDS for w in words), sum(w in BAD_WORDS for w in words)
            m, o, g, b, f = above[p] if v else (0, 0, 0, 0, 0)
            above[v] = (m + (tag in MAIN), o + (tag in OFF), g + (good > 0 and not bad), b + (bad > 0), f + (tag in FORM))
            depth[v] = depth[p] + 1 if v else 0
            beside = children[p] if v else [0]
            same = alike[p][tag] if v else 1
            size = chars[v]
            rows.append([
                math.log1p(size), math.log1p(own[v]), math.log1p(below[v]), math.log1p(size / (below[v] + 1)), links[v] / max(1, size),
                points[v] / max(1, size), depth[v], math.log1p(len(beside)), (beside[0] - v) / max(1, beside[0] - beside[-1]) if v else 0.0,
                math.log1p(same), size / total, firsts.get(v, 0) / total, *groups[v], good, bad, *above[v],
                math.log1p((held[p] if v else size) / len(beside)),
                links[p] / max(1, chars[p]) if v else 0.0])
        return np.array(rows, np.float64)

"""Main-text extraction by a tree-structured graphical model over the DOM.

Block elements are the nodes of a tree; inline markup only adds to its block. Each node is main content or not. A node's
own potential is linear in features of its tag, class and id words, text and links; an edge potential, linear in
features of the child, couples parent and child. Sum-product messages run upward from the leaves and downward from the
root, for all trees of a batch together by depth, and give each node's exact content marginal. The weights maximise the
likelihood of labelled pages, by gradients from the same messages. Labelled pages are generated by rule from page
layouts of many kinds, so the trainer depends on no table.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
#: What closes a comment just behind its opening.
EMPTY_COMMENT = re.compile("-?>")
ATTRIBUTE = re.compile(r"([^\s=/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Elements whose content is never text of the page, read to their end tag as they stand.
RAW = {"script", "style", "template", "iframe", "noembed", "noframes"}
#: Form parts and head elements: parsed, but without text.
MUTE = {"textarea", "select", "button", "option", "datalist", "optgroup", "title", "canvas", "audio", "video", "label", "legend", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input"}
#: Formulas, drawings and fallbacks, whose text belongs to the block around it.
FOREIGN = {"math", "semantics", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "svg", "defs", "desc", "g", "symbol", "text", "textpath", "tspan", "use", "object"}
INLINE |= FOREIGN
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Block elements that close an open paragraph.
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements of which a new one closes the last, unless one of the second set lies between.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
GOOD_WORDS = ("article", "content", "post", "entry", "main", "story", "body", "text")
BAD_GROUPS = (("nav", "menu", "breadcrumb", "pagination"), ("header", "masthead", "banner", "top"), ("footer", "copyright", "bottom", "legal"), ("side", "sidebar", "aside", "widget", "rail"), ("ad", "ads", "advert", "sponsor", "promo", "advertisement"), ("comment", "comments", "reply", "respond", "discussion", "disqus"), ("cookie", "notice", "consent", "popup", "modal", "newsletter", "subscribe", "alert", "gdpr"), ("related", "share", "social", "tags", "recommended", "meta"), ("form", "login", "search", "signup"))
TAGS = ("#root", "html", "body", "div", "p", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "details", "head", "dt", "summary", "noscript")
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
#: Tags of main parts and of parts beside them; what lies in one is marked, as are their words in a class or id.
MAIN_TAGS, SIDE_TAGS = {"article", "main"}, {"nav", "aside", "footer", "form"}
N_FEATURES = len(TAGS) + 1 + 1 + len(BAD_GROUPS) + 14
ROOT = 0
TRAIN_PAGES, TRAIN_STEPS = 400, 200


class Scanner:
    """Tokens of a page from a place on, in time that grows with the page alone: what a search has found to be missing is
    remembered, so that no later tag looks for it again."""

    def __init__(self, source: str):
        self.source, self.missing, self.dead = source, {}, set()

    def find(self, what: str, at: int) -> int:
        if at >= self.missing.get(what, len(self.source) + 1):
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def token(self, at: int) -> tuple[int, str | None, str, str]:
        """(end, text or None, slash and name, attributes) of what begins at a place; markup without a name and comments
        have an empty text. A tag that never ends is text."""
        source = self.source
        if source[at] != "<":
            end = self.find("<", at)
            end = end if end >= 0 else len(source)
            return end, source[at:end], "", ""
        if source.startswith("<!--", at):
            if empty := EMPTY_COMMENT.match(source, at + 4):
                return empty.end(), "", "", ""
            ends = [found + len(mark) for mark in ("-->", "--!>") if (found := self.find(mark, at + 4)) >= 0]
            return min(ends, default=len(source)), "", "", ""
        if source[at + 1 : at + 2] in ("!", "?"):
            end = self.find(">", at)
            return (end + 1, "", "", "") if end >= 0 else (at + 1, "<", "", "")
        name = NAME.match(source, at + 1)
        end = self._tag_end(name.end()) if name else -1
        if end < 0:
            return at + 1, "<", "", ""
        return end, None, name[1] + name[2].lower(), source[name.end() : end - 1]

    def _tag_end(self, at: int) -> int:
        """The place behind the > that closes a tag, beyond quoted values; -1 where there is none."""
        tried = []
        while (stop := TAG_STOP.search(self.source, at)) and stop.start() not in self.dead:
            if stop[0] == ">":
                return stop.end()
            tried.append(stop.start())
            at = self.find(stop[0], stop.end()) + 1
            if not at:
                break
        self.dead.update(tried)
        return -1


class Page:
    """The block tree of a page: parents, tags, attribute words, and text runs in page order as (node, text, linked)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.label = [-1], ["#root"], [frozenset()], [None]
        self.runs: list[tuple[int, str, bool]] = []
        self.stack: list[tuple[str, int]] = [("#root", ROOT)]
        self.opened: Counter[str] = Counter()
        self.mute = self.links = at = 0
        scanner = Scanner(source)
        while at < len(source):
            at, text, name, attributes = scanner.token(at)
            if text is not None:
                if text and not self.mute:
                    self.runs.append((self.stack[-1][1], text, self.links > 0))
                continue
            if name[0] == "/":
                self._end(name[1:])
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if name == "xmp":
                end = re.compile(r"</xmp\s*>", re.I).search(source, at)
                shown = entities.escape(source[at : end.start() if end else len(source)], quote=False)
                if not self.mute:
                    own = self.stack[-1][1]
                    self.runs += [(own, "\0", False), (own, shown, self.links > 0), (own, "\0", False)]
                at = end.end() if end else len(source)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.runs.append((self.stack[-1][1], " ", False))
                continue
            if attributes.rstrip().endswith("/") and (name in FOREIGN or name not in INLINE and name not in CLOSES_P):
                continue
            if name in INLINE or name in MUTE:
                self._open(name, self.stack[-1][1])
                continue
            if name in CLOSES_P and self.opened["p"]:
                self._close({"p"}, set(CLOSES_P) - {"p"})
            if name in SIBLINGS:
                self._close(*SIBLINGS[name])
            self.parent.append(self.stack[-1][1])
            self.tag.append(name)
            found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
            self.words.append(frozenset(re.findall(r"[a-z]+", " ".join((found.get("class", ""), found.get("id", ""), found.get("role", ""))))))
            self.label.append(found.get("data-label"))
            self._open(name, len(self.parent) - 1)
            self.runs.append((len(self.parent) - 1, "\0", False))

    def _open(self, name: str, node: int) -> None:
        self.mute += name in MUTE
        self.links += name == "a"
        self.opened[name] += 1
        self.stack.append((name, node))

    def _cut(self, depth: int) -> None:
        """Closes all open elements from a depth on."""
        for name, _ in self.stack[depth:]:
            self.mute -= name in MUTE
            self.links -= name == "a"
            self.opened[name] -= 1
        del self.stack[depth:]

    def _end(self, name: str) -> None:
        """An end tag closes the innermost open element of its name; an inline one reaches no block above it."""
        if not self.opened[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                if name not in INLINE:
                    self.runs.append((self.stack[i - 1][1], "\0", False))
                self._cut(i)
                break
            if name in INLINE and self.stack[i][0] not in INLINE:
                break

    def _close(self, wanted: set[str], fence: set[str]) -> None:
        """Closes the innermost open element of ``wanted`` that no element of ``fence`` hides, with all in it."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in wanted:
                low = i
                while low > 1 and self.stack[low - 1][0] in wanted:
                    low -= 1
                self._cut(low)
                break
            if self.stack[i][0] in fence:
                break

    def blocks(self) -> list[tuple[int, str]]:
        """(node, text) of each run of text between block bounds: references decoded, white space one space, trimmed."""
        out: list[tuple[int, list[str]]] = []
        open_node = None
        for node, text, _ in self.runs:
            if text == "\0":
                open_node = None
                continue
            if node != open_node:
                out.append((node, []))
                open_node = node
            out[-1][1].append(text)
        joined = ((node, " ".join(entities.unescape("".join(parts)).split())) for node, parts in out)
        return [(node, text) for node, text in joined if text]

    def features(self) -> np.ndarray:
        n = len(self.parent)
        x = np.zeros((n, N_FEATURES), np.float32)
        own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text, link in self.runs:
            if text != "\0":
                k = len(text.strip())
                own[node] += k
                linked[node] += k * link
                stops[node] += text.count(". ") + text.count(", ") + text.rstrip().endswith(".")
        total, total_linked = own.copy(), linked.copy()
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += total[i]
            total_linked[self.parent[i]] += total_linked[i]
        base = len(TAGS) + 2
        for i in range(n):
            x[i, TAG_NUMBER.get(self.tag[i], len(TAGS))] = 1
            words = self.words[i]
            if words:
                x[i, len(TAGS) + 1] = any(w in words for w in GOOD_WORDS)
                for g, group in enumerate(BAD_GROUPS):
                    x[i, base + g] = any(w in words for w in group)
        base += len(BAD_GROUPS)
        x[:, base] = 1
        x[:, base + 1] = np.minimum(1, np.log1p(own) / 7)
        x[:, base + 2] = linked / np.maximum(1, own)
        x[:, base + 3] = np.minimum(1, np.log1p(total) / 9)
        x[:, base + 4] = total_linked / np.maximum(1, total)
        x[:, base + 5] = np.minimum(1, stops / 5)
        x[:, base + 6] = (own > 0) & (own < 25)
        x[:, base + 7] = own > 100
        x[:, base + 8] = own == 0
        x[:, base + 9] = total / max(1.0, total[0])
        inside, beside = np.zeros(n, bool), np.zeros(n, bool)
        for i in range(1, n):
            above, words = self.parent[i], self.words[i]
            inside[i] = inside[above] or self.tag[i] in MAIN_TAGS or any(w in words for w in GOOD_WORDS)
            beside[i] = beside[above] or self.tag[i] in SIDE_TAGS or any(w in words for group in BAD_GROUPS for w in group)
        x[:, base + 10] = inside & ~beside
        x[:, base + 11] = beside
        x[:, base + 12] = ~inside & inside.any()
        x[:, base + 13] = np.isin(self.tag, list(MAIN_TAGS)) & ~beside
        return x


class Forest:
    """Trees of several pages side by side, ordered by depth for message passing."""

    def __init__(self, pages: list[Page]):
        offsets = np.cumsum([0] + [len(p.parent) for p in pages])
        self.offsets = offsets
        self.parent = np.concatenate([np.array(p.parent) + o for p, o in zip(pages, offsets, strict=False)])
        roots = offsets[:-1]
        self.parent[roots] = -1
        depth = np.zeros(len(self.parent), np.int64)
        for i in range(len(depth)):
            if self.parent[i] >= 0:
                depth[i] = depth[self.parent[i]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
        self.x = np.concatenate([p.features() for p in pages])

    def marginals(self, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(content) of nodes, joint (child, parent) tables of edges, and the log partition function, given log
        potentials: node (n, 2), edge (n, 2, 2) by child state and parent state (unused at roots)."""
        n = len(self.parent)
        up, gathered = np.zeros((n, 2)), node.astype(np.float64).copy()
        for level in reversed(self.levels[1:]):
            up[level] = np.logaddexp(gathered[level, 0, None] + edge[level, 0], gathered[level, 1, None] + edge[level, 1])
            np.add.at(gathered, self.parent[level], up[level])
        root = self.levels[0]
        log_z = float(np.logaddexp(gathered[root, 0], gathered[root, 1]).sum())
        belief, joint = gathered.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            down = belief[p] - up[level]  # all that the parent knows but from this child
            table = gathered[level][:, :, None] + edge[level] + down[:, None, :]
            joint[level] = table
            belief[level] = np.logaddexp(table[:, :, 0], table[:, :, 1])
        z = np.logaddexp(belief[:, 0], belief[:, 1])
        inner = np.concatenate(self.levels[1:]) if len(self.levels) > 1 else np.zeros(0, np.int64)
        joint[inner] = np.exp(joint[inner] - z[inner, None, None])
        return np.exp(belief[:, 1] - z), joint, log_z


def potentials(x: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    node = np.stack([np.zeros(len(x)), x @ w["node"]], axis=1)
    return node, (x @ w["edge"]).reshape(-1, 2, 2)


def fit(pages: list[Page], labels: list[np.ndarray], steps: int = TRAIN_STEPS, ridge: float = 0.00005) -> dict[str, np.ndarray]:
    """Weights of the highest penalised likelihood, by Adam on exact gradients."""
    forest, y = Forest(pages), np.concatenate(labels).astype(np.int64)
    forest.x = forest.x.astype(np.float64)
    f, n = forest.x.shape[1], len(y)
    w = {"node": np.zeros(f), "edge": np.zeros((f, 4))}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    inner = np.flatnonzero(forest.parent >= 0)
    truth = np.zeros((n, 4))
    truth[inner, y[inner] * 2 + y[forest.parent[inner]]] = 1
    for step in range(1, steps + 1):
        p, joint, _ = forest.marginals(*potentials(forest.x, w))
        grads = {"node": forest.x.T @ (y - p) / n - ridge * w["node"], "edge": forest.x.T @ (truth - joint.reshape(n, 4)) / n - ridge * w["edge"]}
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            v2[k] += 0.01 * (g * g - v2[k])
            w[k] += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
    return w


def labelled_page(rng: np.random.Generator) -> str:
    """One generated page; elements carry data-label 1 where they and what they hold is main content, 0 where not."""
    syllables = ["ba", "ne", "tor", "li", "su", "ran", "mek", "o", "vi", "dal", "pre", "chu", "gon", "ti", "ex"]
    word = lambda: "".join(syllables[int(rng.random() * len(syllables))] for _ in range(1 + int(rng.random() * 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def prose() -> str:
        odd = rng.random()
        if odd < 0.08:  # one word again and again, or a long run without any stop
            return pick(f"{word()} " * int(rng.integers(3, 60)), phrase(20, 150), " | ".join(phrase(1, 3) for _ in range(rng.integers(3, 30))))
        if odd < 0.16:  # a word or two
            return phrase(1, 3).capitalize() + pick(".", "", "!")
        if odd < 0.24:
            return " ".join((phrase(3, 12) + ".").capitalize() for _ in range(rng.integers(8, 40)))
        text = " ".join((phrase(1, 14) + pick(".", ".", "!", "?", ", " + phrase(2, 5) + ".")).capitalize() for _ in range(rng.integers(1, 8)))
        if rng.random() < 0.25:
            text = text.replace(" ", f" <{(t := pick('b', 'em', 'a', 'span', 'i'))}>{word()}</{t}> ", 1)
        return pick("", "", "<b>") + text + pick("", "", "<br>")

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{phrase(1, 4)}</a></li>' for _ in range(n))

    def off(tag: str, attr: str, inner: str) -> str:
        return f'<{tag}{" " + attr if attr else ""} data-label="0">{inner}</{tag}>'

    def named(*names: str) -> str:
        return pick("class", "id") + f'="{pick(*names)}"' if rng.random() < 0.9 else ""

    def extra(kind: str) -> str:
        short = f"<p>{phrase(3, 18).capitalize()}.</p>"
        if kind == "nav":
            return off(pick("nav", "nav", "div", "ul"), named("nav", "menu", "main-menu", "breadcrumb"), pick("<ul>", "") + links(rng.integers(2, 9)) + "</ul>")
        if kind == "header":
            return off(pick("header", "div"), named("header", "masthead", "banner", "top"), pick(f"<h1>{phrase(1, 4)}</h1>", f"<p>{phrase(2, 8)}</p>", f"<div>{phrase(2, 6)}</div>") + pick("", "<ul>" + links(3) + "</ul>"))
        if kind == "footer":
            return off(pick("footer", "div"), named("footer", "site-footer", "copyright"), f"&copy; {phrase(1, 5)} &middot; {phrase(3, 12)}." + pick("", short, "<ul>" + links(3) + "</ul>"))
        if kind == "side":
            return off(pick("aside", "div", "section"), named("sidebar", "side", "widget", "related", "rail"), f"<{(h := pick('h2', 'h3', 'h4'))}>{phrase(1, 4)}</{h}>" + pick(short, short * 2, "<ul>" + links(5) + "</ul>", phrase(5, 20)))
        if kind == "ad":
            return f"<!-- ad -->{off(pick('div', 'aside', 'section'), named('ad', 'ads', 'advert', 'sponsor', 'promo'), pick(phrase(3, 18).capitalize() + '.', short))}"
        if kind == "notice":
            return off(pick("div", "section", "aside"), named("cookie", "notice", "consent-banner", "newsletter", "popup", "alert", "subscribe"), pick(short, phrase(4, 25) + ".") + pick("", "<button>ok</button>"))
        if kind == "form":
            return off("form", pick("", named("search", "login", "signup")), pick("", f"<p>{phrase(2, 8)}</p>") + f"<label>{phrase(1, 3)}</label><input><select><option>{word()}</option></select><button>{word()}</button>")
        one = lambda: f"<{(t := pick('div', 'li', 'div', 'p'))}{pick('', ' class=comment')}>{pick('', f'<b>{word()}</b> ', f'<h4>{word()}</h4>')}{pick(prose(), '<p>' + prose() + '</p>')}</{t}>"
        return off(pick("section", "div", "ol"), pick("class", "id") + f'="{pick("comments", "comment-list", "comments-area", "respond", "discussion")}"', pick("", f"<h3>{phrase(1, 3)}</h3>") + "".join(one() for _ in range(rng.integers(1, 6))))

    def own_footer() -> str:
        return off("footer", pick("", "", named("meta", "tags", "share")), pick(phrase(2, 12), f"<p>{phrase(2, 14)}.</p>", "<ul>" + links(3) + "</ul>"))

    def listing() -> str:
        """A part of an article that is no prose: glossary, listing, figure, details, list of links, table of figures."""
        kind = rng.integers(7)
        if kind == 0:
            return "<dl>" + "".join(f"<dt>{phrase(1, 4)}{pick('', '</dt>')}<dd>{pick(prose(), phrase(2, 9))}{pick('', '</dd>')}" for _ in range(rng.integers(1, 9))) + "</dl>"
        if kind == 1:
            return f"<pre>{pick('', '<code>')}" + "\n".join(f"{word()} = {word()}({rng.integers(100)})" for _ in range(rng.integers(1, 12))) + "</pre>"
        if kind == 2:
            return f"<figure><img src=x>{pick('', '<p>' + prose() + '</p>')}<figcaption>{pick(phrase(2, 12), prose())}</figcaption></figure>"
        if kind == 3:
            return f"<details{pick('', ' open')}><summary>{phrase(1, 6)}</summary>{pick(prose(), '<p>' + prose() + '</p>')}</details>"
        if kind < 6:
            before, behind, inner = pick(0, 0, 1), pick(0, 0, 1), pick("", "", "<p>")
            one = lambda: f"{phrase(1, 4)} " * before + f'<a href="/{word()}">{phrase(1, 7)}</a>' + f": {phrase(2, 10)}" * behind
            return f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{inner}{one()}{pick('', '</li>')}" for _ in range(rng.integers(2, 13))) + f"</{t}>"
        head = "<thead><tr>" + "".join(f"<th>{word()}</th>" for _ in range(3)) + "</tr></thead>" if rng.random() < 0.5 else ""
        rows = "".join("<tr>" + "".join(f"<td>{pick(word(), str(rng.integers(9999)))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.integers(1, 9)))
        return f"<table>{head}<tbody>{rows}</tbody></table>"

    def title() -> str:
        head = f"<h1>{phrase(1, 12).capitalize()}</h1>"
        return f"<header>{head}{pick('', f'<p>{phrase(2, 9)}</p>')}</header>" if rng.random() < 0.25 else head

    def body() -> str:
        parts = [title()] if rng.random() < 0.8 else []
        if rng.random() < 0.3:  # nothing but one or two such parts
            parts += [pick("", f"<h2>{phrase(1, 5)}</h2>") + listing() for _ in range(rng.integers(1, 3))]
            return "".join(parts) + (own_footer() if rng.random() < 0.2 else "")
        for _ in range(rng.integers(1, 9)):
            kind = rng.random()
            if kind < 0.75:
                parts.append(f"<p>{prose()}" + pick("</p>", "</p>", "</p>", ""))
            elif kind < 0.82:
                parts.append(f"<h2>{phrase(2, 7)}</h2><p>{prose()}</p>")
            elif kind < 0.88:
                parts.append(f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{phrase(2, 14)}</li>" for _ in range(rng.integers(2, 6))) + f"</{t}>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{pick('<p>', '')}{prose()}</blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{phrase(1, 4)}</td><td>{phrase(1, 4)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            elif kind < 0.97:
                parts.append(f"<div>{prose()}</div>")
            else:
                parts.append(extra(pick("ad", "notice", "form", "side")))
            if rng.random() < 0.12:
                parts.append(listing())
            if rng.random() < 0.02:
                parts.append(f"<noscript>{pick('', '<p>')}{prose()}</noscript>")
        if rng.random() < 0.08:
            parts.insert(len(parts) > 1, off("nav", pick("", named("toc", "contents")), "<ul>" + links(rng.integers(2, 7)) + "</ul>"))
        return "".join(parts) + (own_footer() if rng.random() < 0.2 else "")

    tag = pick("article", "article", "main", "div", "div", "section")
    attr = "" if tag in ("article", "main") and rng.random() < 0.6 else named("content", "post", "entry-content", "article-body", "story", "main")
    attr = attr or ('class="content"' if tag in ("div", "section") else "")
    article = f'<{tag} {attr} data-label="1">{body()}</{tag}>'
    kinds = [k for k in ("nav", "header", "ad", "notice", "form", "side") if rng.random() < 0.5]
    after = [k for k in ("comments", "side", "ad", "notice", "form", "nav") if rng.random() < 0.4]
    inside = rng.permutation([extra(k) for k in kinds]).tolist() + [article] + [extra(k) for k in after]
    if rng.random() < 0.15:
        inside.insert(int(rng.integers(len(inside) + 1)), off("noscript", "", phrase(3, 14) + "."))
    wrap = "".join(inside)
    if rng.random() < 0.3:
        wrap = f'<div{pick("", " class=wrapper", " id=page")}>{wrap}</div>'
    return f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title><style>p{{}}</style></head><body{pick('', '', '', ' class="post main"')}>{wrap}{extra('footer') if rng.random() < 0.8 else ''}" + pick("</body></html>", "")


def page_labels(page: Page) -> np.ndarray:
    """States of nodes: the nearest data-label at or above; 0 above all."""
    out = np.zeros(len(page.parent), np.int64)
    for i in range(1, len(out)):
        own = page.label[i]
        out[i] = int(own) if own in ("0", "1") else out[page.parent[i]]
    return out


@functools.cache
def train(pages: int = TRAIN_PAGES, seed: int = 17) -> dict[str, np.ndarray]:
    """The weights, fitted once a process: they depend on no table."""
    rng = np.random.default_rng(seed)
    made = [Page(labelled_page(rng)) for _ in range(pages)]
    return fit(made, [page_labels(p) for p in made])


def main_texts(sources: list[str | None], w: dict[str, np.ndarray]) -> list[str]:
    """The main text of each page; '' for null, empty and contentless ones."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    p, _, _ = forest.marginals(*potentials(forest.x, w))
    return [" ".join(text for node, text in page.blocks() if p[o + node] > 0.5) for page, o in zip(pages, forest.offsets, strict=False)]


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). Pages are read whole, in time that grows with their
    length however malformed they are: a tag that never ends is text, an unclosed comment, script or style takes the
    rest. Null html gives an empty text, and an empty table no rows. Rows are independent of each other, so repeated ones
    give equal results; extra columns are not read."""
    held = pages.sparkSession.sparkContext.broadcast(train())
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), "html")
    group = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                texts = main_texts(part.column(2).to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)

"""Main-text extraction by a hidden Markov tree over the DOM.

Each element and each block of text is a node that is content or not. A node's
tag, class words, length, link share and punctuation depend on its state, and a
node's state on its parent's; both tables are counted from labelled pages
(`labelled_pages`, written by a seeded generator from hand-marked layouts).
Sum-product messages run up and down the tree and give each node's probability
of being content; the text blocks above one half are the page's text.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: A tag without quotes, as most are.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*+)([^>\"']*+)>")
#: A name begins where none goes on, and is taken whole, so that a long one is read once.
_ATTRIBUTE = re.compile(r"""(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: Never text of a page.
UNSEEN = frozenset("head script style template noscript iframe object svg math canvas audio video form button select option optgroup textarea input datalist dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: A start tag ends these open elements, looked for up to the elements of _SCOPE.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_P_SCOPE = frozenset("article aside body button caption div footer header html li main nav section table td th form blockquote".split())


class Tree:
    """The nodes of a page, parents before children: elements, and blocks of text as leaves."""

    __slots__ = ("key", "label", "parent", "text")

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.key: list[tuple] = []  # what is seen of a node
        self.text: list[str | None] = []  # of leaves
        self.label: list[str | None] = []  # of labelled pages: '0', '1' or inherited

    def add(self, parent: int, key: tuple, text: str | None, label: str | None) -> int:
        self.parent.append(parent)
        self.key.append(key)
        self.text.append(text)
        self.label.append(label)
        return len(self.parent) - 1


def _words(attributes: str) -> tuple[tuple[str, ...], str | None]:
    """The words of class, id and role, and the label if there is one."""
    found, label = [], None
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            found += [w if len(w) < 5 else w.rstrip("s") for w in _WORD.findall(_CAMEL.sub(" ", a or b or c).lower())]
        elif name == "data-label":
            label = a or b or c
    return tuple(dict.fromkeys(found)), label


def _length(n: int) -> str:
    return "0" if n < 2 else "1" if n < 5 else "2" if n < 12 else "3" if n < 30 else "4" if n < 80 else "5"


class _Tags:
    """The tags of a page, found in one pass: no part of the page is searched more than a few times.

    A tag ends at the first > outside of quotes. Once a page has no such end for
    a tag, its quotes are taken as plain characters from there on.
    """

    def __init__(self, page: str) -> None:
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in (">", '"', "'", "-->")}

    def end(self, at: int) -> int:
        """Behind the > that ends the tag whose name ends at `at`; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        k = at
        while self.quotes and (m := _STOP.search(self.page, k)):
            if m[0] == ">":
                return m.end()
            k = m.end()
            if k <= self.last[m[0]]:
                k = self.page.index(m[0], k) + 1
        self.quotes = False
        return self.page.index(">", at) + 1

    def find(self, at: int) -> tuple[int, int, str, bool, int] | None:
        """Start, end, name, whether it's an end tag, and the name's end, of the next tag or comment (no name) from `at` on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if start < self.last[">"] and (m := _PLAIN.match(page, start)):
                return start, m.end(), m[2].lower(), m[1] == "/", m.end(2)
            if m := _NAME.match(page, start + 1):
                closing = page[start + 1] == "/"
                end = page.find(">", m.end()) + 1 if closing and m.end() <= self.last[">"] else -1 if closing else self.end(m.end())
                if end > 0:
                    return start, end, m[1].lower(), closing, m.end()
            elif page.startswith("<!--", start):
                end = page.index("-->", start + 4) + 3 if start + 4 <= self.last["-->"] else len(page)
                return start, end, "", False, end
            elif page[start + 1 : start + 2] in ("!", "?", "/") and page[start + 1 : start + 2] and start < self.last[">"]:
                end = page.index(">", start) + 1
                return start, end, "", False, end
            at = start + 1
        return None


class _Open:
    """The stack of open elements. Where the innermost one of a tag lies is known without looking through it."""

    def __init__(self, root: tuple[str, int, str | None]) -> None:
        self.items = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, item: tuple[str, int, str | None]) -> None:
        self.places.setdefault(item[0], []).append(len(self.items))
        if item[0] not in INLINE:
            self.blocks.append(len(self.items))
        self.items.append(item)

    def pop(self) -> str:
        tag = self.items.pop()[0]
        self.places[tag].pop()
        if tag not in INLINE:
            self.blocks.pop()
        return tag

    def innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def find(self, tags, scope) -> int:
        """The place of the innermost of the tags, 0 if there is none within the innermost of the scope."""
        k = self.innermost(tags)
        return k if k and k >= self.innermost(scope) else 0


def parse(page: str) -> Tree:
    """Builds the tree with the usual implied end tags; any input gives a tree, in time that grows with its length."""
    tree = Tree()
    stack = _Open(("#root", tree.add(-1, ("root",), None, None), None))
    pieces: list[str] = []
    linked = unseen = inside_link = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                tag, at, label = stack.items[stack.blocks[-1]]
                n = text.count(" ") + 1
                share = min(1.0, linked / max(1, len(text)))
                tree.add(at, ("text", tag, _length(n), "0" if share < 0.05 else "1" if share < 0.5 else "2", text[-1] in ".!?:;\"'”»…)"), text, label)
            pieces.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal unseen, inside_link
        while len(stack.items) > to:
            tag = stack.pop()
            unseen -= tag in UNSEEN
            inside_link -= tag == "a"

    at, end, tags = 0, len(page), _Tags(page)
    while at < end:
        m = tags.find(at)
        stop = m[0] if m else end
        if stop > at and not unseen:
            piece = page[at:stop]
            pieces.append(piece)
            if inside_link:
                linked += len(piece.strip())
        if not m:
            break
        _, at, tag, closing, named = m
        if tag == "br":
            pieces.append(" ")
        elif tag and not closing:
            if tag not in INLINE:
                flush()
            if tag in CLOSES_P and (k := stack.find(("p",), _P_SCOPE)):
                close(k)
            if tag in ENDS and (k := stack.find(ENDS[tag], _SCOPE.get(tag, ()))):
                while k > 1 and stack.items[k - 1][0] in ENDS[tag]:
                    k -= 1
                close(k)
            if tag in VOID:
                continue
            rest = page[named : at - 1]
            words, label = _words(rest) if "=" in rest else ((), None)
            _, above, inherited = stack.items[-1]
            label = label or inherited
            node = above if tag in INLINE else tree.add(above, ("element", tag, words), None, label)
            if rest.endswith("/") and tag not in RAW:  # written as empty
                continue
            stack.push((tag, node, label))
            unseen += tag in UNSEEN
            inside_link += tag == "a"
            if tag in RAW:
                m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                # Where no > follows the first end tag, none follows a later one.
                at = (page.find(">", m.end()) + 1 or end) if m else end
                close(len(stack.items) - 1)
        elif tag:
            if k := stack.find((tag,), ("table",) if tag not in ("table", "body", "html", "article", "main", "div", "section") else ()):
                if tag not in INLINE:
                    flush()
                elif stack.blocks[-1] > k:
                    continue  # an inline end tag doesn't end blocks
                close(k)
    flush()
    return tree


class Model:
    """Log-likelihoods of what is seen, and of a child's state given its parent's."""

    def __init__(self, pages: list[str]) -> None:
        seen, moves, root = (Counter(), Counter()), Counter(), Counter()
        totals: tuple[Counter, Counter] = (Counter(), Counter())
        for page in pages:
            tree = parse(page)
            states = self._states(tree)
            for node, state in enumerate(states):
                for f in self._features(tree.key[node]):
                    seen[state][f] += 1
                    totals[state][f[0]] += 1
                if node:
                    above = tree.parent[node]
                    moves[self._move(tree.key[above], tree.key[node]), states[above], state] += 1
                    moves[self._kind(tree.key[node]), states[above], state] += 1
                else:
                    root[state] += 1
        kinds = {k for c in seen for k, *_ in c}
        size = {k: len({f for c in seen for f in c if f[0] == k}) + 1 for k in kinds}
        self.seen = {f: tuple(math.log((seen[s][f] + 0.5) / (totals[s][f[0]] + 0.5 * size[f[0]])) for s in (0, 1)) for f in {*seen[0], *seen[1]}}
        self.moves = {}
        for kind in ("element", "text"):
            rows = [[moves[kind, p, c] + 1.0 for c in (0, 1)] for p in (0, 1)]
            self.moves[kind] = tuple(x / sum(row) for row in rows for x in row)
        for move in {m for m, *_ in moves if isinstance(m, tuple)}:  # counts under a parent of that tag, and four as under any
            prior = self.moves[move[0]]
            rows = [[moves[move, p, c] + 4 * prior[2 * p + c] for c in (0, 1)] for p in (0, 1)]
            self.moves[move] = tuple(x / sum(row) for row in rows for x in row)
        self.root = (root[0] + 1) / (root[0] + root[1] + 2)
        self.known: dict[tuple, tuple[float, float]] = {}

    @staticmethod
    def _kind(key: tuple) -> str:
        return "text" if key[0] == "text" else "element"

    @classmethod
    def _move(cls, above: tuple, key: tuple) -> tuple[str, str]:
        return cls._kind(key), above[1] if len(above) > 1 else ""

    @staticmethod
    def _states(tree: Tree) -> list[int]:
        """Leaves as marked; elements as most of their text, or as marked if they have none."""
        weight = [[0, 0] for _ in tree.parent]
        for node in range(len(tree.parent) - 1, -1, -1):
            if tree.text[node] is not None:
                weight[node][tree.label[node] == "1"] += len(tree.text[node])
            if node:
                for s in (0, 1):
                    weight[tree.parent[node]][s] += weight[node][s]
        return [int(b > a) if a + b else int(tree.label[n] == "1") for n, (a, b) in enumerate(weight)]

    @staticmethod
    def _features(key: tuple) -> list[tuple]:
        if key[0] == "element":
            return [("tag", key[1]), *(("word", w) for w in key[2])]
        if key[0] == "text":
            return [("form", *key[2:])]
        return []

    def evidence(self, key: tuple) -> tuple[float, float]:
        """The likelihood of what is seen in either state, scaled to a greatest value of 1."""
        got = self.known.get(key)
        if got is None:
            rows = [self.seen[f] for f in self._features(key) if f in self.seen]
            a, b = (sum(r[s] for r in rows) for s in (0, 1))
            got = math.exp(max(-60.0, a - max(a, b))), math.exp(max(-60.0, b - max(a, b)))
            if len(self.known) < 50_000:
                self.known[key] = got
        return got

    def content(self, tree: Tree) -> list[float]:
        """Each node's probability of being content, by messages up and down the tree."""
        n = len(tree.parent)
        here = [self.evidence(k) for k in tree.key]  # evidence of a node and of all below it
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        moves = [self.moves.get(self._move(tree.key[p], k)) or self.moves[self._kind(k)] for p, k in zip(tree.parent, tree.key, strict=True)]
        for node in range(n - 1, 0, -1):
            (a, b), (p00, p01, p10, p11) = here[node], moves[node]
            u, v = p00 * a + p01 * b, p10 * a + p11 * b
            sent[node] = u, v = u / (u + v), v / (u + v)
            x, y = here[tree.parent[node]]
            x, y = x * u, y * v
            here[tree.parent[node]] = x / (x + y), y / (x + y)
        out = [0.0] * n
        a, b = here[0]
        a, b = a * self.root, b * (1 - self.root)
        out[0] = b / (a + b)
        for node in range(1, n):
            up = out[tree.parent[node]]
            (u, v), (a, b), (p00, p01, p10, p11) = sent[node], here[node], moves[node]
            x, y = (1 - up) / u, up / v  # the parent without what this node told it
            a, b = a * (x * p00 + y * p10), b * (x * p01 + y * p11)
            out[node] = b / (a + b)
        return out


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    tree = parse(page)
    return "\n".join(t for t, p in zip(tree.text, model.content(tree), strict=True) if t is not None and p > 0.5)


# Labelled pages

_SYLLABLES = "the ing ed re an tion er on st le ou en ai que ment ver ge sch ich den os ción la de tre eau ar mi no va".split()


def _sentence(r: random.Random, low: int = 3, high: int = 25) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice("....!?")


def _paragraph(r: random.Random) -> str:
    text = " ".join(_sentence(r) for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9))))
    if r.random() < 0.15:
        text = _sentence(r, 1, 3)
    if r.random() < 0.2:
        text += f' <a href="/x">{_sentence(r, 1, 4)}</a> {_sentence(r)}'
    return f"<b>{text}</b>" if r.random() < 0.1 else text


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_sentence(r, 1, 3)[:-1]}</a></li>' for k in range(n)) + "</ul>"


def _boilerplate(r: random.Random, names: str) -> str:
    """A block that is not content, of one of the sorts that pages have."""
    name = r.choice(names.split())
    tags = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside"}
    tag = tags.get(name, r.choice(("div", "div", "section", "aside"))) if r.random() < 0.6 else "div"
    attribute = r.choice((f'class="{name}"', f'id="{name}"', f'class="{name} {r.choice(("box", "block", "wrap", "inner"))}"', f'class="{r.choice(("site", "page", "global"))}-{name}"')) if tag == "div" or r.random() < 0.5 else ""
    if name in ("nav", "menu", "breadcrumb", "related", "tags", "pagination", "social", "share"):
        body = _links(r, r.randint(2, 9))
    elif name in ("comments", "comment", "replies", "discussion"):
        body = f"<h3>{_sentence(r, 1, 2)}</h3>" * (r.random() < 0.6) + "".join(f'<{t} class="{r.choice(("comment", "reply", "response"))}"><p>{_paragraph(r)}</p></{t}>' for t in [r.choice(("div", "li", "article"))] for _ in range(r.randint(1, 6)))
    elif name == "form":
        return f'<form data-label="0"><p>{_sentence(r)}</p><input name="q"><button>{_sentence(r, 1, 2)}</button></form>'
    elif name in ("footer", "header", "copyright"):
        body = r.choice((f"&copy; {_sentence(r, 1, 4)} &middot; {_sentence(r, 2, 12)}", f"<p>{_sentence(r, 2, 12)}</p>", f"<h2>{_sentence(r, 1, 3)}</h2>" + _links(r, 3), f"<h1>{_sentence(r, 1, 4)[:-1]}</h1>", f"<h1>{_sentence(r, 1, 4)}</h1><p>{_sentence(r, 2, 9)}</p>"))
    else:
        body = r.choice((_sentence(r, 2, 20), f"<p>{_sentence(r, 3, 25)}</p>", f"<p>{_sentence(r)} {_sentence(r)}</p>", f"<h3>{_sentence(r, 1, 3)}</h3>" + _links(r, 4)))
    return f'<{tag} {attribute} data-label="0">{body}</{tag}>'


_TOP, _SIDE, _IN, _BOTTOM = "nav menu header header nav banner cookie notice ad breadcrumb topbar navigation masthead form search toolbar", "sidebar ad widget related promo sponsor newsletter subscribe sidebar tags archive trending popular", "ad share advert promo related notice newsletter social sponsor subscribe form advertisement author-bio disclaimer", "comments comment replies footer related form share copyright discussion pagination popup modal consent login signup cookie notice legal"


def labelled_pages(n: int = 700, seed: int = 1) -> list[str]:
    """Pages whose parts are marked data-label="1" (content) or "0"."""
    out, r = [], random.Random(seed)
    for _ in range(n):
        blocks = [f"<h1>{_sentence(r, 1, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 4, 7, 12, 20))):
            kind = r.random()
            if kind < 0.74:
                blocks.append(f"<p>{_paragraph(r)}" + "</p>" * (r.random() < 0.9))
            elif kind < 0.79:
                blocks.append(f"<h2>{_sentence(r, 1, 6)}</h2>")
            elif kind < 0.88:
                blocks.append("<ul>" + "".join(f"<li>{_sentence(r, 1, 15)[: None if r.random() < 0.5 else -1]}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.91:
                blocks.append(f"<blockquote><p>{_paragraph(r)}</p></blockquote>")
            elif kind < 0.94:
                blocks.append("<table>" + "".join(f"<tr><td>{_sentence(r, 1, 4)}</td><td>{_sentence(r, 1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                blocks.append(f"<figure><figcaption>{_sentence(r, 2, 10)}</figcaption></figure>")
            elif kind < 0.98:
                blocks.append(f"<div>{_paragraph(r)}</div>")
            else:
                blocks.append(f"<section><h3>{_sentence(r, 1, 5)}</h3><p>{_paragraph(r)}</p></section>")
        for _ in range(r.choice((0, 0, 1, 2))):
            blocks.insert(r.randint(0, len(blocks)), _boilerplate(r, _IN))
        if r.random() < 0.15:
            blocks.append(_boilerplate(r, "comments comment replies"))
        inner = "".join(blocks)
        body = r.choice((
            f'<article data-label="1">{inner}</article>', f'<main data-label="1">{inner}</main>', f'<main><article data-label="1">{inner}</article></main>',
            *(f'<div {r.choice(("class", "id"))}="{r.choice(("content", "post", "entry", "article", "main", "story", "text", "article-body", "post-content", "entry-content", "page"))}" data-label="1">{inner}</div>' for _ in range(2)),
            f'<div class="{r.choice(("container", "wrapper", "page", "layout"))}"><article data-label="1">{inner}</article></div>', f'<div data-label="1">{inner}</div>',
        ))
        top = "".join(_boilerplate(r, _TOP) for _ in range(r.randint(0, 3)))
        side = _boilerplate(r, _SIDE) if r.random() < 0.5 else ""
        bottom = "".join(_boilerplate(r, _BOTTOM) for _ in range(r.randint(0, 3)))
        middle = f'<div class="{r.choice(("container", "wrapper", "row", "layout"))}">{body}{side}</div>' if side and r.random() < 0.5 else side + body if r.random() < 0.5 else body + side
        out.append(f'<html><head><title>{_sentence(r, 1, 5)}</title></head><body>{top}{middle}{bottom}<footer data-label="0">{_sentence(r, 1, 9)}</footer></body></html>')
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the bundled labelled pages."""
    return Model(labelled_pages())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Character references are decoded; white space within a block becomes one
    space; blocks are joined by a line feed in page order. A null or empty page,
    or one without content, has an empty text. Pages of any length and however
    broken are read whole, in time that grows with their length. Rows with equal
    page_id are extracted each by itself; an empty table gives no rows; other
    columns take no part.
    """
    schema = pages.schema
    sent = pages.sparkSession.sparkContext.broadcast(trained())  # some hundred counts, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                texts = [main_text(h, model) for h in part["html"]]
                yield part[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    rows = need(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("string"))
    made = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return made.withColumn("page_id", F.col("page_id").cast(schema["page_id"].dataType))

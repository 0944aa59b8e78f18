"""Main text of web pages by a tree-structured graphical model.

The block elements of a page and the runs of text in them are the nodes of a tree.  Each node is content or not.  A
node's own look (its tag, words of its class and id, how much of its text is links, how long it is) gives it a potential;
parent and child have a joint potential, one for each kind of edge.  Sum-product messages, up from the leaves and down
from the root, give every node's exact marginal, and the text of the runs that are more likely content than not is the
page's text.  Both kinds of potential are trained on labelled pages (``labelled_pages.PAGES``).

Text inside a block has its white space turned into single blanks and is trimmed; blocks are joined by line ends.  A
``br`` ends a run like a block does.

Pages are cut into tags as browsers do it, in one pass over the page whatever its quotes and brackets.  Not read are
scripts, styles and what else never shows, and form controls.  A control or an element of raw text that isn't closed
hides no more than what stands before the next block; an unclosed script, style or comment hides the rest, as in
browsers.  All other text is read, that of formulas, figures and of elements that no one knows included.

Defined results: null or empty pages, and pages without content, give an empty text; text outside any element is read as
the body's; unclosed elements end with what holds them; repeated pages give repeated results.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, c, slices, tidied

# ---- the tree --------------------------------------------------------------------------------------------------------

#: Fixed values of HTML: elements without content, elements whose content never shows or isn't markup, form controls,
#: elements that make a block of their own.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template desc metadata".split())
CONTROL = frozenset("select option optgroup datalist button".split())
BLOCK = frozenset("address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open paragraph or item of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
VALUE = re.compile(r"[^\s>]*")
#: Words in class and id that tell what an element is for.
NOISE = frozenset("ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments cookie cookies copyright disclaimer discussion footer header legal login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply replies share sharing sidebar signup social sponsor sponsored subscribe tags topbar widget".split())
ASIDE = frozenset("nav aside footer form".split())
GOOD = frozenset("article articletext body content entry main post story text".split())
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SPLIT = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    text: str | None = None  # of a run
    chars: int = 0
    linked: int = 0
    mark: int = 0
    around: bool = False  # an article or the main part stands in it
    inside: bool = False  # so does an element whose name tells of content
    aside: bool = False  # it stands in a menu, footer or the like
    plain: int = 0  # characters in it outside links, menus, footers and the like
    kids: list[int] = field(default_factory=list)


class Cutter:
    """Cuts a page into text and tags.  What is looked for ahead is known to be there, so that no search is in vain."""

    def __init__(self, page: str):
        self.page = page
        close = page.rfind(">")
        #: The last place of each thing sought; quotes count only where a tag's end still follows.
        self.last = {">": close, "-->": page.rfind("-->")} | {q: page.rfind(q, 0, max(close, 0)) for q in "\"'"}
        self.ends: dict[str, list[int]] = {}

    def find(self, what: str, at: int) -> int:
        return self.page.find(what, at) if self.last[what] >= at else -1

    def tag(self, at: int) -> tuple[int, str, bool, dict[str, str]] | None:
        """The tag that begins at ``at`` (a "<"): the place behind it, its name (empty for comments and the like), whether
        it closes, and its attributes.  Nothing if no tag begins there."""
        page = self.page
        if page.startswith("<!--", at):
            stop = self.find("-->", at + 2)
            return (len(page) if stop < 0 else stop + 3), "", False, {}
        closing = page.startswith("</", at)
        first = at + 2 if closing else at + 1
        ch = page[first : first + 1]
        if ch in ("!", "?") or (closing and ch and not (ch.isascii() and ch.isalpha())):
            stop = self.find(">", first)
            return None if stop < 0 else (stop + 1, "", False, {})
        if not (ch.isascii() and ch.isalpha()) or self.find(">", first) < 0:
            return None
        stop = first
        while page[stop] not in " \t\n\r\f/>":
            stop += 1
        name, found = page[first:stop].lower(), {}
        while True:
            while page[stop : stop + 1] in (" ", "\t", "\n", "\r", "\f", "/"):
                stop += 1
            if page[stop : stop + 1] in (">", ""):
                break
            m = ATTRIBUTE.match(page, stop)
            if m is None:
                stop += 1
                continue
            stop, value = m.end(), ""
            if m[2]:
                quote = page[stop : stop + 1]
                close = self.find(quote, stop + 1) if quote in ('"', "'") else -1
                if close >= 0:
                    value, stop = page[stop + 1 : close], close + 1
                else:
                    v = VALUE.match(page, stop)
                    value, stop = v[0], v.end()
            found.setdefault(m[1].lower(), value)
        return stop + 1, name, closing, found

    def end_of(self, tag: str, at: int) -> int:
        """The place behind the next end tag of that name, or -1."""
        if tag not in self.ends:
            self.ends[tag] = [m.end() for m in re.finditer(rf"</{re.escape(tag)}(?:\s[^>]*)?>", self.page, re.I)]
        i = bisect.bisect_right(self.ends[tag], at)
        return self.ends[tag][i] if i < len(self.ends[tag]) else -1


def _names(attributes: dict[str, str]) -> tuple[tuple[str, ...], int]:
    """The words of class, id and role, and a training page's mark."""
    words = []
    for key in ("class", "id", "role"):
        if key in attributes:
            told = CAMEL.sub(" ", entities.unescape(attributes[key]))
            words += [w for w in SPLIT.split(told.lower()) if w]
    return tuple(words), 1 if "y" in attributes else -1 if "n" in attributes else 0


def parse(page: str) -> list[Node]:
    """The blocks and runs of a page; node 0 is the body."""
    nodes = [Node("body", -1)]
    stack = [0]  # open blocks
    open_tags: dict[str, int] = {}  # how many of each are in the stack
    run: list[str] = []
    links, linked = 0, 0
    hidden: list[str] = []  # open form controls

    def end_run() -> None:
        nonlocal linked
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip() if run else ""
        run.clear()
        if text:
            nodes[stack[-1]].kids.append(len(nodes))
            nodes.append(Node("#run", stack[-1], text=text, chars=len(text), linked=min(linked, len(text))))
        linked = 0

    def shut(depth: int) -> None:
        for i in stack[depth:]:
            open_tags[nodes[i].tag] -= 1
        del stack[depth:]

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not hidden:
            run.append(page[a:b])
            if links:
                linked += b - a

    cut = Cutter(page)
    at, since, n = 0, 0, len(page)  # since: where the text before the next tag begins
    while True:
        place = page.find("<", at)
        got = cut.tag(place) if place >= 0 else None
        if place >= 0 and got is None:
            at = place + 1  # a bracket that begins no tag is text
            continue
        text(since, n if got is None else place)
        if got is None:
            break
        at, tag, closing, attributes = got
        since = at
        if tag in RAW and not closing:
            stop = cut.end_of(tag, at)
            if stop < 0 and tag in ("script", "style"):
                stop = n
            at = since = max(stop, at)
            continue
        if tag in CONTROL:
            if not closing:
                hidden.append(tag)
            elif tag in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
            continue
        if tag in ("br", "hr"):
            end_run()
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if tag not in BLOCK and "-" not in tag:  # flows in a line, or has no content
            continue
        if hidden:  # inside a control that closes later, or else the control has ended
            if cut.end_of(hidden[0], at) >= 0 and not _opens_again(page, hidden[0], at, cut):
                continue
            hidden.clear()
        end_run()
        links = 0
        if closing:
            if open_tags.get(tag):
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        shut(depth)
                        break
            continue
        names, mark = _names(attributes)
        if tag == "body":
            nodes[0].names, nodes[0].mark = names, mark
            continue
        if nodes[stack[-1]].tag == "p":
            shut(len(stack) - 1)
        if tag in CLOSES and any(open_tags.get(x) for x in CLOSES[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[depth]].tag
                if open_tag in CLOSES[tag]:
                    shut(depth)
                    break
                if open_tag in ("ul", "ol", "dl", "table"):
                    break
        nodes[stack[-1]].kids.append(len(nodes))
        nodes.append(Node(tag, stack[-1], names, mark=mark))
        stack.append(len(nodes) - 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    end_run()
    for node in reversed(nodes):
        if node.parent >= 0:
            parent = nodes[node.parent]
            parent.chars += node.chars
            parent.linked += node.linked
            quiet = not any(w in NOISE for w in node.names)
            parent.around = parent.around or node.around or (quiet and (node.tag in ("article", "main") or "article" in node.names))
            parent.inside = parent.inside or node.inside or (quiet and any(w in GOOD for w in node.names))
    for node in nodes[1:]:
        named = node.tag != "#run" and not (node.around or node.inside) and (node.tag in ASIDE or any(w in NOISE for w in node.names))
        node.aside = nodes[node.parent].aside or named
        if node.text is not None and not node.aside:
            node.plain = node.chars - node.linked
    for node in reversed(nodes):
        if node.parent >= 0:
            nodes[node.parent].plain += node.plain
    return nodes


def _opens_again(page: str, tag: str, at: int, cut: Cutter) -> bool:
    """Whether a control opens before the next end tag of its name, which then isn't that of an earlier one."""
    key = "<" + tag
    if key not in cut.ends:
        cut.ends[key] = [m.start() for m in re.finditer(rf"<{re.escape(tag)}[\s/>]", page, re.I)]
    starts = cut.ends[key]
    i = bisect.bisect_left(starts, at)
    return i < len(starts) and starts[i] < cut.end_of(tag, at)


# ---- potentials ------------------------------------------------------------------------------------------------------


def looks(node: Node, whole: int, rest: int = 0) -> tuple[str, ...]:
    """What can be seen of a node in a page of ``whole`` characters, ``rest`` of them outside links, menus and the like:
    names of features that hold."""
    out = ["always", f"tag {node.tag}"]
    if node.tag != "#run":
        noise = any(w in NOISE for w in node.names)
        if noise:
            out.append("noise name around" if node.around else "noise name")
        if not noise and any(w in GOOD for w in node.names):
            out.append("good name")
    share = node.linked / node.chars if node.chars else 0.0
    out.append("links all" if share > 0.8 else "links many" if share > 0.3 else "links few")
    size = node.chars
    kind = "run" if node.tag == "#run" else "block"
    out.append(f"{kind} size {0 if size < 25 else 1 if size < 80 else 2 if size < 300 else 3}")
    if kind == "block" and whole and size > whole / 2:
        out.append("most of page")
    if rest and node.plain > rest / 2:
        out.append(f"{kind} most of rest")
    return tuple(out)


def edge(parent: Node, child: Node) -> str:
    """Runs follow their block; blocks of a section of their own may differ from what holds them."""
    if child.tag == "#run":
        return "run"
    if child.tag in ("nav", "aside", "footer", "header", "form", "article", "main", "section") or any(w in NOISE or w in GOOD for w in child.names):
        return "section"
    return "top" if parent.tag == "body" else "inner"


@dataclass(frozen=True)
class Model:
    """Log-odds of the features, and for each kind of edge the log joint potentials (00, 01, 10, 11; parent first)."""

    weights: dict[str, float]
    edges: dict[str, tuple[float, float, float, float]]


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Each node's probability of being content, by messages up and down the tree."""
    n, whole, rest = len(nodes), nodes[0].chars, nodes[0].plain
    weights = model.weights
    exp = math.exp
    own = [0.0] * n
    pair = [(1.0, 1.0, 1.0, 1.0)] * n
    tables = {k: tuple(exp(v) for v in e) for k, e in model.edges.items()}
    for i, node in enumerate(nodes):
        own[i] = max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in looks(node, whole, rest))))
        if i:
            pair[i] = tables[edge(nodes[node.parent], node)]
    # log-odds are messages up to scale: with odds r of the child, the parent sees (p01 r + p00) against (p11 r + p10)
    below = own[:]
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        r = exp(max(-60.0, min(60.0, below[i])))
        p = pair[i]
        up[i] = math.log((p[3] * r + p[2]) / (p[1] * r + p[0]))
        below[nodes[i].parent] += up[i]
    full = below[:]
    for i in range(1, n):
        r = exp(max(-60.0, min(60.0, full[nodes[i].parent] - up[i])))
        p = pair[i]
        full[i] = below[i] + math.log((p[3] * r + p[1]) / (p[2] * r + p[0]))
    return [1 / (1 + exp(-max(-60.0, min(60.0, x)))) for x in full]


# ---- training --------------------------------------------------------------------------------------------------------


def _fill(page: str, rng: random.Random) -> str:
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9)))
    phrase = lambda k: " ".join(word() for _ in range(k))
    out = []
    for ch in page:
        out.append(phrase(rng.randint(4, 28)).capitalize() + "." if ch == "@" else phrase(rng.randint(1, 5)) if ch == "~" else ch)
    return "".join(out)


def labels(nodes: list[Node]) -> list[int]:
    """Of a labelled page: 1 for content; the innermost mark counts."""
    state = [0] * len(nodes)
    for i, node in enumerate(nodes):
        inherited = state[node.parent] if node.parent >= 0 else 0
        state[i] = 1 if node.mark > 0 else 0 if node.mark < 0 else inherited
    return state


def train(pages: list[str], *, copies: int = 6, rounds: int = 80, rate: float = 0.15, ridge: float = 0.002, seed: int = 11) -> Model:
    """Fit both kinds of potential.

    Edges are smoothed joint counts over the product of their margins, so that they say how parent and child depend on
    each other and not how common content is.  Features are fitted by gradient steps on the likelihood of the runs' and
    blocks' labels under the model's marginals, so that what the tree already explains isn't counted twice.
    """
    rng = random.Random(seed)
    trees = [parse(_fill(page, rng)) for page in pages for _ in range(copies)]
    truth = [labels(t) for t in trees]
    counts: dict[str, list[float]] = {k: [2.0, 0.5, 0.5, 2.0] for k in ("run", "section", "top", "inner")}
    for tree, y in zip(trees, truth, strict=True):
        for i in range(1, len(tree)):
            p = tree[i].parent
            counts[edge(tree[p], tree[i])][2 * y[p] + y[i]] += 1
    edges = {}
    for k, (a, b, d, e) in counts.items():
        n = a + b + d + e
        p1, c1 = (d + e) / n, (b + e) / n
        edges[k] = tuple(math.log(x / n / m) for x, m in ((a, (1 - p1) * (1 - c1)), (b, (1 - p1) * c1), (d, p1 * (1 - c1)), (e, p1 * c1)))
    seen = [[looks(node, t[0].chars, t[0].plain) for node in t] for t in trees]
    weights: dict[str, float] = {f: 0.0 for s in seen for fs in s for f in fs}
    mean, square = dict.fromkeys(weights, 0.0), dict.fromkeys(weights, 0.0)
    for step in range(1, rounds + 1):
        gradient = {f: -ridge * w for f, w in weights.items()}
        model = Model(weights, edges)
        for tree, y, fs in zip(trees, truth, seen, strict=True):
            for node, want, got in zip(fs, y, marginals(tree, model), strict=True):
                for f in node:
                    gradient[f] += (want - got) / len(trees)
        for f, g in gradient.items():  # steps scaled by each feature's own gradients
            mean[f] = 0.9 * mean[f] + 0.1 * g
            square[f] = 0.99 * square[f] + 0.01 * g * g
            weights[f] += rate * (mean[f] / (1 - 0.9**step)) / (math.sqrt(square[f] / (1 - 0.99**step)) + 1e-6)
    return Model(dict(weights), edges)


_trained: list[Model] = []


def default_model() -> Model:
    """The model trained on the labelled pages that come with this module (once a process)."""
    if not _trained:
        from .labelled_pages import PAGES

        _trained.append(train(PAGES))
    return _trained[0]


# ---- extraction ------------------------------------------------------------------------------------------------------


def main_text(page: str, model: Model, *, least: float = 0.5) -> str:
    nodes = parse(page)
    if len(nodes) == 1:
        return ""
    return "\n".join(node.text for node, p in zip(nodes, marginals(nodes, model), strict=True) if node.text is not None and p >= least)


def _extract(held, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for batch in slices(whole, 0):
                texts = [main_text(x or "", model, least=least) for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    return tidied(run)


def extract(df: DataFrame, *, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.5) -> DataFrame:
    """Per page: id, url and text."""
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model or default_model())
    kinds = [df.schema[x].dataType.simpleString() for x in (id_col, url_col)]
    rows = df.select(c(html_col).cast("string").alias("html"), c(id_col).alias("id"), c(url_col).alias("url"))
    return rows.mapInArrow(_extract(held, least), f"id {kinds[0]}, url {kinds[1]}, text string")

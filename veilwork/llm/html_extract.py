"""Main text of web pages by scoring the document tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.tokens import chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content up to the end tag is no markup and no text.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of which nothing is kept. Forms and bad names are judged by dropped_nodes.
DROPPED = frozenset("head nav aside footer button select option svg math iframe object noscript template dialog menu canvas audio video".split())
#: An open element of the second set ends when one of the first begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What an implied end doesn't go beyond.
BARRIER = frozenset("table ul ol dl div section article body html".split())
PARAGRAPHS = frozenset("p pre td blockquote dd".split())
BASE = {"article": 8, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th header".split(), -5)
GOOD_NAME = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
BAD_NAME = re.compile(r"(?:^|(?<!\bhas)(?<!\bwith)(?<!\bno)[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|menu|nav\w*|pagination|pager|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])", re.I)

LEAST_PARAGRAPH = 25
#: Characters outside forms and bad names that are too few for a page without h1.
LITTLE = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEVELS = 5
SIBLING_SHARE = 0.2
LEAST_SIBLING = 10.0

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
_NAME = re.compile(r"(?<![\w-])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


class Tree:
    """Elements of a page in the order of their start tags, and its pieces of text.

    By element: tag, parent, name (class and id), last (index after its last descendant). By piece: owner, text, line
    (pieces of one line have no block's edge between them).
    """

    def __init__(self) -> None:
        self.tag, self.parent, self.name, self.last = ["#root"], [-1], [""], [0]
        self.owner: list[int] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.title: str | None = None


def parse(page: str) -> Tree:
    """The tree of any text, however broken; each character is looked at a bounded number of times.

    End tags without a start tag are left out, and so are those of inline elements that would end a block; p, li, dt, dd,
    tr, td, th and option end by themselves; what isn't a tag is text.
    """
    tree = Tree()
    tag, parent, name, last = tree.tag, tree.parent, tree.name, tree.last
    stack, places, blocks = [0], {}, [0]
    line, at, size, quotes = 0, 0, len(page), True

    def close(depth: int) -> None:
        """Ends all open elements from this place of the stack on."""
        while len(stack) > depth:
            node = stack.pop()
            last[node] = len(tag)
            places[tag[node]].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    def say(piece: str) -> None:
        if piece:
            tree.owner.append(stack[-1])
            tree.text.append(html.unescape(piece) if "&" in piece else piece)
            tree.line.append(line)

    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt == size - 1:
            say(page[at:])
            break
        nxt = page[lt + 1]
        if nxt in "!?":
            say(page[at:lt])
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            at = size if end <= 1 else end + 1
            continue
        found = _TAG.match(page, lt) if quotes and (nxt == "/" or nxt.isalpha()) else None
        if found is None:
            end = page.find(">", lt) if nxt == "/" or nxt.isalpha() else -1
            if end >= 0 and quotes:
                quotes = False  # a quote that never ends: from here on the next > ends a tag
            if end < 0 or not (short := re.compile(r"<(/?)([A-Za-z][^\s/>]*+)").match(page, lt)):
                say(page[at : lt + 1])
                at = lt + 1
                if end < 0 and (nxt == "/" or nxt.isalpha()):
                    say(page[at:])
                    break
                continue
            slash, kind, rest, over = short[1], short[2].lower(), page[short.end() : end], end + 1
        else:
            slash, kind, rest, over = found[1], found[2].lower(), found[3], found.end()
        say(page[at:lt])
        at = over
        block = kind in BLOCK
        if block or kind == "br":
            line += 1
        if slash:
            open_at = places.get(kind)
            if open_at and (block or open_at[-1] > blocks[-1]):
                close(open_at[-1])
            continue
        if kind in VOID:
            continue
        if kind in RAW:
            end = re.compile(rf"</{kind}(?=[\s/>])", re.I).search(page, at)
            if kind == "title" and tree.title is None:
                tree.title = html.unescape(page[at : end.start() if end else size])
            at = size if end is None else page.find(">", end.end() - 1) + 1 or size
            continue
        if kind == "body" and places.get("head"):
            close(places["head"][-1])
        if block and places.get("p"):
            inner = places["p"][-1]
            if all(inner > (places[b][-1] if places.get(b) else -1) for b in ("td", "table")):
                close(inner)
        if kind in CLOSES:
            wall = max((places[b][-1] for b in BARRIER if places.get(b)), default=-1)
            if kind == "tr":
                wall = places["table"][-1] if places.get("table") else wall
            own = min((x for c in CLOSES[kind] for x in places.get(c, ())[-1:] if x > wall), default=None)
            if own is not None:
                close(own)
        if rest.endswith("/") and kind in ("svg", "math", "path"):
            continue
        names = " ".join(x or y or z for x, y, z in _NAME.findall(rest)) if "=" in rest else ""
        node = len(tag)
        tag.append(kind)
        parent.append(stack[-1])
        name.append(names)
        last.append(0)
        places.setdefault(kind, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append(node)
    close(1)
    last[0] = len(tag)
    return tree


def dropped_nodes(tree: Tree, doubtful: bool = True) -> list[bool]:
    """Elements that are no content by tag, or doubtful by class and id or as a form, with all that is inside them.

    A doubtful element stays if it holds more plain text (no links, no headings) than there is outside of all of them and,
    unless it is a form, has the page's h1 (no site header's) or leaves too little outside: none where an h1, article or
    main stays, else fewer characters than LITTLE. Without `doubtful` all of them stay.
    """
    n = len(tree.tag)
    gone, doubt = [False] * n, [False] * n
    inlink, nearest, header = [False] * n, [0] * n, [False] * n
    for i in range(1, n):
        kind, name, up = tree.tag[i], tree.name[i], tree.parent[i]
        gone[i] = gone[up] or kind in DROPPED
        doubt[i] = kind == "form" or bool(name and kind not in ("html", "body", "article", "main") and BAD_NAME.search(name) and not GOOD_NAME.search(name))
        inlink[i] = inlink[up] or kind == "a" or kind in HEADINGS
        nearest[i] = i if doubt[i] else nearest[up]
        header[i] = header[up] or kind == "header"
    if not doubtful or not any(doubt):
        return gone
    own, inside, title = [0] * n, [0] * n, [False] * n
    for owner, text in zip(tree.owner, tree.text):
        if not gone[owner] and not inlink[owner]:
            own[nearest[owner]] += len(_SPACE.sub(" ", text).strip())
    marks = [i for i in range(1, n) if tree.tag[i] in ("h1", "article", "main") and not gone[i] and not header[i]]
    first = next((i for i in marks if tree.tag[i] == "h1"), 0)
    title[first] = first > 0
    for i in range(n - 1, 0, -1):
        inside[i] += own[i]
        inside[tree.parent[i]] += inside[i]
        title[tree.parent[i]] |= title[i]
    stays, left = [not x for x in doubt], own[0]
    marked = {nearest[i] for i in marks}
    least = 1 if 0 in marked else LITTLE
    outer = lambda i: nearest[tree.parent[i]]
    chain = [True] * n
    for i in range(1, n):
        chain[i] = chain[tree.parent[i]] and (not doubt[i] or tree.tag[i] == "form")
    for i in sorted((i for i in range(1, n) if doubt[i]), key=lambda i: (not (title[i] or chain[i]), i)):
        if stays[outer(i)] and inside[i] > left and (title[i] or tree.tag[i] == "form" or left < least):
            stays[i] = True
            left += own[i]
            least = 1 if i in marked else least
    for i in range(1, n):
        gone[i] = gone[tree.parent[i]] or gone[i] or not stays[i]
    return gone


def best_nodes(tree: Tree, gone: list[bool]) -> list[int]:
    """The best container and the siblings that belong to it, in order; none where no paragraph has points.

    A paragraph of LEAST_PARAGRAPH characters or more has 1 point, 1 for each comma and 1 for each 100 characters up to 3.
    They go in full to its parent, by half to the parent's parent, and by 1/(3 n) to the n-th further one. A container
    begins with points for its tag and for its names, and what it has is multiplied by the share of its text that isn't in
    links. Siblings stay that have SIBLING_SHARE of the best's points (with a bonus for an equal class), and paragraphs
    with few links and many characters or a sentence's end.
    """
    n = len(tree.tag)
    size, commas, linked, blocks = [0] * n, [0] * n, [0] * n, [0] * n
    inlink = [False] * n
    for i in range(1, n):
        inlink[i] = inlink[tree.parent[i]] or tree.tag[i] == "a"
    ends = [""] * n
    for owner, text in zip(tree.owner, tree.text):
        if gone[owner]:
            continue
        short = _SPACE.sub(" ", text)
        size[owner] += len(short) if short != " " else 0
        commas[owner] += short.count(",") + short.count("，") + short.count("、")
        if inlink[owner]:
            linked[owner] += len(short) if short != " " else 0
        if short.strip():
            ends[owner] = short.strip()[-1]
    for i in range(n - 1, 0, -1):
        if gone[i]:
            continue
        up = tree.parent[i]
        size[up] += size[i]
        commas[up] += commas[i]
        linked[up] += linked[i]
        blocks[up] += blocks[i] + (tree.tag[i] in BLOCK)
        ends[up] = ends[up] or ends[i]
    points: dict[int, float] = {}

    def start(i: int) -> float:
        value = BASE.get(tree.tag[i], 0)
        name = tree.name[i]
        if name:
            value += 25 * bool(GOOD_NAME.search(name)) - 25 * bool(BAD_NAME.search(name))
        return value

    for i in range(1, n):
        if gone[i] or size[i] < LEAST_PARAGRAPH or not (tree.tag[i] in PARAGRAPHS or (tree.tag[i] in ("div", "section", "li") and not blocks[i])):
            continue
        own = 1 + commas[i] + min(size[i] // 100, 3)
        up = tree.parent[i]
        for level in range(LEVELS):
            if up < 0:
                break
            if up not in points:
                points[up] = start(up)
            points[up] += own / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = tree.parent[up]
    if not points:
        return []
    density = lambda i: linked[i] / size[i] if size[i] else 0.0
    final = {i: v * (1 - density(i)) for i, v in points.items()}
    best = max(sorted(final), key=lambda i: final[i])
    kept, least = [], max(LEAST_SIBLING, final[best] * SIBLING_SHARE)
    up = tree.parent[best]
    i = best if up < 0 else up + 1
    while i < (best + 1 if up < 0 else tree.last[up]):
        if i == best:
            kept.append(i)
        elif not gone[i]:
            bonus = final[best] * SIBLING_SHARE if tree.name[i] and tree.name[i] == tree.name[best] else 0
            few = density(i)
            if i in final and final[i] + bonus >= least or tree.tag[i] == "p" and (size[i] > 80 and few < 0.25 or 0 < size[i] <= 80 and few == 0 and ends[i] in ".!?。！？"):
                kept.append(i)
        i = tree.last[i] if i else n
    return kept


def lines_of(tree: Tree, nodes: list[int], gone: list[bool]) -> str:
    """Text inside the nodes: white space is one space, and blocks and breaks begin a line."""
    n = len(tree.tag)
    inside = np.zeros(n + 1, np.int64)
    for i in nodes:
        inside[i] += 1
        inside[tree.last[i] if i else n] -= 1
    use = (np.cumsum(inside)[:n] > 0).tolist()
    out, number = [], None
    for owner, text, line in zip(tree.owner, tree.text, tree.line):
        if use[owner] and not gone[owner]:
            if line != number:
                out.append("\n")
                number = line
            out.append(_SPACE.sub(" ", text))
    lines = (_SPACE.sub(" ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def extract(page: str) -> tuple[str | None, str]:
    """Title and main text of a page; without any paragraph of points, all text that isn't in a dropped element, and if
    there is none, that of the doubtful ones."""
    tree = parse(page)
    title = None if tree.title is None else _SPACE.sub(" ", tree.title).strip() or None
    for doubtful in (True, False):
        gone = dropped_nodes(tree, doubtful)
        if text := lines_of(tree, best_nodes(tree, gone) or [0], gone):
            break
    return title, text


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, title, text, n_chars) of every row of pages.

    A null page has null text and title and 0 characters; an empty page, and one without text, has the text ''. A page
    without a title element, or with an empty one, has a null title. Rows without page_id and repeated rows are handled
    like others. Whole pages are parsed. An empty table gives an empty result; other columns are ignored.
    """
    fields = [("page_id", pa.int64()), ("title", pa.string()), ("text", pa.string()), ("n_chars", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            found = [(None, None) if page is None else extract(page) for page in batch.column("html").to_pylist()]
            texts = [t for _, t in found]
            columns = [batch.column("page_id"), pa.array([t for t, _ in found], pa.string()), pa.array(texts, pa.string()), pa.array([len(t or "") for t in texts], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [f for f, _ in fields])

    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(html_column).cast("string").alias("html")).mapInArrow(run, "page_id long, title string, text string, n_chars int")

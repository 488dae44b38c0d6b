"""Main text of web pages by wrapper induction.

Pages of a host come from one template. Each page is parsed into a tree in which runs of
alike siblings are one repeated node; trees are aligned with the host's wrapper by simple
tree matching (the largest top-down, order-keeping match of two trees), and merged into
it. A wrapper node whose text is the same on all pages is template; a node whose text
varies, or that only one of several pages has, is a slot. The content region of a wrapper is
the lowest node that holds every slot outside of elements that are never content; where
nothing is known to vary (one page, or copies), it is the page's own article or main element,
or all of the page. A page's text
is then taken from the nodes that are aligned with the region, less elements
that are never content (menus, adverts, forms, comments and the like, by tag and by
name) and less what the wrapper holds as template: a text that all of the host's pages have
at one place, if they are SUPPORT or more (the same line on fewer pages may be an
article's, and stays). Names that are given to content as well (side, notice, header and the like)
are never content only where the wrapper's node is constant, or where nothing is known of it.

Wrappers are merged within each task first, then by host: what is shuffled is a few small
trees a host, however many pages it has. They are sent to all tasks while they are
smaller than BROADCAST bytes, which is measured; beyond, pages and wrappers are joined by
host, with pages spread by a salt, so that a host with any share of the pages is split.

Null html is empty; an empty page has empty text. Broken markup is read as far as it goes:
an unclosed element ends with its parent, a page may end anywhere. A null url is a host of
its own. Repeated rows are read each; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm._base import load, scratch_dir

BROADCAST = 16 << 20
SALTS = 64
#: Children of a wrapper node that are kept apart; beyond, those of one tag become one repeated node.
FANOUT = 48
#: Block elements within each other that are aligned; what lies deeper counts as text of the last one, whole.
DEPTH = 40
#: Pages of a host from which on a text that all of them have is taken out of the region.
SUPPORT = 5

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav header footer aside form script style noscript template textarea title head button select option input iframe svg menu dialog object embed canvas audio video label fieldset".split())
CLOSES = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
HEADS = frozenset("article main".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|popup|modal|newsletter|subscribe|share|sharing|social|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|related|recommend\w*|comment\w*|disqus|footer|masthead|login|search|pagination|pager|skip)(?:$|[\s_-])", re.I)
MAYBE = re.compile(r"(?:^|[\s_-])(?:notice\w*|alert|side|discussion|header|widget\w*)(?:$|[\s_-])", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "children")

    def __init__(self, tag: str, name: str = "") -> None:
        self.tag, self.name, self.children = tag, name, []


def parse(html: str) -> Node:
    """Tree of elements, however deep; strings among the children are text, not yet decoded."""
    root = Node("#root")
    stack = [root]
    inside: dict[str, int] = {}
    at = 0

    def close(k: int) -> None:
        for x in stack[k:]:
            inside[x.tag] -= 1
        del stack[k:]

    while True:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            return root
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if inside.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in BLOCK and inside.get("p"):  # a block element ends an open paragraph
            k = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p")
            if not any(x.tag in BLOCK for x in stack[k + 1 :]):
                close(k)
        if tag in CLOSES and any(inside.get(x) for x in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table"):
                    break
        attributes = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(m[3] or "")}
        node = Node(tag, " ".join(attributes.get(k, "") for k in ("class", "id", "role")).strip())
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append(node)
            inside[tag] = inside.get(tag, 0) + 1


def never(node: Node) -> bool:
    return node.tag in NEVER or (node.tag not in ("body", "html", "#root", "article", "main") and bool(node.name) and NAMES.search(node.name) is not None)


def maybe(tag: str, name: str) -> bool:
    """Whether an element is content only if it varies."""
    return tag not in ("body", "html", "#root", "article", "main") and bool(name) and MAYBE.search(name) is not None


def shape(node: Node, depth: int = 0) -> list:
    """The page's tree for alignment: [tag and name, text, pages, children, elements], runs of alike children once.

    The text is None where it is a slot. A run's text is that of all its members, so that a
    run that is the same on all pages is constant. Inline elements count as text and what is
    never content as leaves without any.
    """
    text: list[str] = []
    children: list[list] = []
    todo = [iter(node.children)]  # inline elements are gone into here, so that they may be nested at will
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
        elif isinstance(x, str):
            text.append(x)
        elif x.tag in BLOCK and depth < DEPTH:
            y = shape(x, depth + 1) if not never(x) else [f"{x.tag} {x.name}".strip(), "", 1, [], [x]]
            if children and children[-1][0] == y[0]:
                children[-1] = fold(children[-1], y)
            else:
                children.append(y)
        elif not never(x):
            text.append(" ")
            todo.append(iter(x.children))
            if x.tag in BLOCK:
                text.append(" ")
    return [f"{node.tag} {node.name}".strip(), SPACE.sub(" ", "".join(text)).strip(), 1, children, [node]]


def fold(a: list, b: list) -> list:
    """Two alike siblings of one page as one node."""
    return [a[0], a[1] + "\n" + b[1] if a[1] and b[1] else a[1] or b[1], 1, paired(a[3], b[3], fold), a[4] + b[4]]


def match(a: list, b: list) -> int:
    """Nodes in the largest match of two trees (simple tree matching)."""
    if a[0] != b[0]:
        return 0
    if not a[3] or not b[3]:
        return 1
    row = [0] * (len(b[3]) + 1)
    for x in a[3]:
        new = [0]
        for j, y in enumerate(b[3]):
            w = match(x, y) if x[0] == y[0] else 0
            new.append(max(row[j + 1], new[j], row[j] + w))
        row = new
    return 1 + row[-1]


def align(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places of children that the largest match pairs, in order."""
    if [x[0] for x in a] == [y[0] for y in b] and len({x[0] for x in a}) == len(a):
        return [(i, i) for i in range(len(a))]
    w = [[match(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + w[i][j])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if w[i][j] and best[i][j] == best[i + 1][j + 1] + w[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def paired(a: list[list], b: list[list], join) -> list[list]:
    """Both lists of children in order, those that the largest match pairs joined."""
    children: list[list] = []
    i = j = 0
    for p, q in [*align(a, b), (len(a), len(b))]:
        children += a[i:p] + b[j:q]
        if p < len(a):
            children.append(join(a[p], b[q]))
        i, j = p + 1, q + 1
    return children


def digest(text: str) -> str:
    return f"{len(text)}:{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}" if text else ""


def digested(node: list) -> list:
    """The tree without its elements, a hash and the length of each text in its place."""
    return [node[0], digest(node[1]), node[2], [digested(x) for x in node[3]]]


def any_of(node: list) -> str:
    """Name of the repeated node that a child is folded into."""
    return node[0].split(" ")[0] + " *"


def bounded(children: list[list]) -> list[list]:
    """At most FANOUT children and one for each tag: those of one page are folded first, the others if they must."""
    for surplus in (lambda x: x[2] == 1, lambda x: True):
        if len(children) <= FANOUT:
            break
        out: list[list] = []
        at: dict[str, int] = {}
        for x in children:
            name = any_of(x)
            if x[0] != name and not surplus(x):
                out.append(x)
            elif name in at:
                out[at[name]] = merge(out[at[name]], [name, *x[1:]])
            else:
                at[name] = len(out)
                out.append([name, *x[1:]])
        children = out
    return children


def merge(a: list, b: list) -> list:
    """Wrapper of two aligned trees; children of only one side are kept."""
    return [a[0], a[1] if a[1] == b[1] else None, a[2] + b[2], bounded(paired(a[3], b[3], merge))]


def varies(node: list, pages: int) -> bool:
    """Whether there is a slot in the tree, out of a wrapper of so many pages."""
    return node[1] is None or bool(node[1] and node[2] == 1 and pages > 1) or any(varies(x, pages) for x in node[3])


def region(wrapper: list) -> list[str]:
    """Path (tags and names) of the content region, from the root; empty if nothing varies."""
    path, node, pages = [wrapper[0]], wrapper, wrapper[2]
    if not varies(wrapper, pages):
        return []
    while node[0].split(" ")[0] not in HEADS and not varies([*node[:3], []], pages):
        slots = [x for x in node[3] if varies(x, pages)]
        if len(slots) > 1 or slots[0][0].split(" ")[0] in ("p", "li", "tr", "td", "h1", "h2", "h3", "blockquote", "pre") or not slots[0][3]:
            break
        node = slots[0]
        path.append(node[0])
    return path


def marks(nodes: list[list], pages: int) -> dict:
    """Name -> [texts that are template, whether a doubtful name varies, marks of the children], where there are any."""
    out: dict[str, list] = {}
    for x in nodes:
        inner = marks(x[3], pages)
        texts = [x[1]] if x[1] and x[2] >= pages >= SUPPORT else []
        keep = maybe(*x[0].partition(" ")[::2]) and varies(x, pages)
        if x[0].endswith(" *"):
            keep = varies(x, pages)
        if texts or keep or inner:
            if x[0] in out:
                texts, keep, inner = out[x[0]][0] + texts, out[x[0]][1] or keep, joined(out[x[0]][2], inner)
            out[x[0]] = [texts, keep, inner]
    return out


def joined(a: dict, b: dict) -> dict:
    return {k: [a[k][0] + b[k][0], a[k][1] or b[k][1], joined(a[k][2], b[k][2])] if k in a and k in b else a.get(k) or b[k] for k in [*a, *(k for k in b if k not in a)]}


def marked(nodes: list[list], known: dict, mute: set[int], keep: set[int]) -> None:
    """Finds the page's elements whose own text is template, and those of doubtful names that vary."""
    for x in nodes:
        m = known.get(x[0]) or known.get(any_of(x))
        if m:
            if digest(x[1]) in m[0]:
                mute.update(map(id, x[4]))
            if m[1]:
                keep.update(map(id, x[4]))
            marked(x[3], m[2], mute, keep)


def main_text(html: str, path: list[str], known: dict) -> str:
    root = parse(html)
    mute: set[int] = set()
    keep: set[int] = set()
    if known:
        marked(shape(root)[3], known, mute, keep)
    return blocks(places(root, path), mute, keep)


def places(root: Node, path: list[str]) -> list[Node]:
    """The page's nodes on the region's path, as far as the page has it; without a path its article or main element."""
    if not path:
        return heads(root) or [root]
    level = [root]
    for name in path[1:]:
        deeper = []
        todo = [c for x in level for c in x.children if isinstance(c, Node)]
        while todo:
            x = todo.pop(0)
            if name in (f"{x.tag} {x.name}".strip(), f"{x.tag} *"):
                deeper.append(x)
            elif x.tag not in BLOCK:
                todo = [c for c in x.children if isinstance(c, Node)] + todo
        if not deeper:
            return level
        level = deeper
    return level


def heads(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop(0)
        if x.tag in HEADS:
            out.append(x)
        elif not never(x):
            todo = [c for c in x.children if isinstance(c, Node)] + todo
    return out


def blocks(nodes: list[Node], mute: set[int], keep: set[int]) -> str:
    """Text of the nodes: a line for each block that has any, but for the own texts of muted blocks."""
    out: list[str] = []
    line: list[str] = []

    def end():
        text = SPACE.sub(" ", unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    def walk(node: Node, muted: bool):
        todo = [(iter(node.children), muted, False)]
        while todo:
            x, (_, mute_it, block) = next(todo[-1][0], None), todo[-1]
            if x is None:
                todo.pop()
                if block:
                    end()
            elif isinstance(x, str):
                if not mute_it:
                    line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif never(x) or (x.tag in BLOCK and id(x) not in keep and maybe(x.tag, x.name)):
                if x.tag in BLOCK:
                    end()
            elif x.tag in BLOCK:
                end()
                todo.append((iter(x.children), id(x) in mute, True))
            else:
                todo.append((iter(x.children), mute_it, False))

    for node in nodes:
        end()
        walk(node, id(node) in mute)
        end()
    return "\n".join(out)


def host_column():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrapper_rows(iterator):
    """host, html -> host and the wrapper of this task's pages of the host."""
    known: dict[str, list] = {}
    for batch in iterator:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not html:  # an empty page says nothing of its host
                continue
            tree = digested(shape(parse(html)))
            known[host] = merge(known[host], tree) if host in known else tree
            if len(known) > 5_000:  # wrappers of very many hosts are handed on early
                yield _wrappers(known)
                known = {}
    yield _wrappers(known)


def _wrappers(known: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())], names=["host", "wrapper"])


def merge_rows(iterator):
    """Rows (host, wrapper) sorted by host -> host and the path of its content region, with its marks."""
    name, held = None, None
    for batch in iterator:
        for host, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if host != name:
                if held is not None:
                    yield _paths(name, held)
                name, held = host, json.loads(raw)
            else:
                held = merge(held, json.loads(raw))
    if held is not None:
        yield _paths(name, held)


def _paths(host: str, wrapper: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps([region(wrapper), marks(wrapper[3], wrapper[2])])])], names=["host", "path"])


def text_rows(paths: dict[str, str] | None):
    """page_id, url, html, host (and path, unless paths are given) -> page_id, url, text."""

    def run(iterator):
        sent = paths.value if paths is not None else None
        for batch in iterator:
            hosts = batch.column(3).to_pylist()
            own = [sent.get(h) for h in hosts] if sent is not None else batch.column(4).to_pylist()
            text = [main_text(html, *(json.loads(path) if path else ([], {}))) if html else "" for html, path in zip(batch.column(2).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    scratch_dir(spark)
    rows = pages.select("page_id", "url", "html", host_column().alias("host"))
    partial = rows.select("host", "html").mapInArrow(wrapper_rows, "host string, wrapper string")
    partial = partial.repartition("host").sortWithinPartitions("host")
    paths = partial.mapInArrow(merge_rows, "host string, path string").checkpoint(eager=True)
    size = paths.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 100), F.lit(0)).alias("n")).first().n
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string"
    if size <= BROADCAST:
        sent = spark.sparkContext.broadcast({r.host: r.path for r in paths.collect()})
        out = rows.mapInArrow(text_rows(sent), schema)
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        out = rows.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "host", "path").mapInArrow(text_rows(None), schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))

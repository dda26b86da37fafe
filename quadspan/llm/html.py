"""Main text of web pages by wrapper induction.

Each page is parsed to a tree of its block elements; inline markup is part of its block's text.  Pages of one host are
dealt to groups of a few dozen.  In a group every tree is aligned with a wrapper tree by simple tree matching (children
in order, equal labels, the most matched nodes).  A slot of the wrapper that holds one text on nearly all pages is
template; slots that vary are content.  Evidence of all groups of a host is added up, so a host of any size is never
in one task.  Pages that are equal but for their group's template are copies of one page and vote once.

Varying text isn't article text everywhere: menus, adverts and the like vary too.  Elements that say what they are (by
tag, role, class or id) are left out whatever they hold, and where a page marks its article or main part, only that
part counts; names that an article's own parts may bear too are no evidence there.  Outside of a marked article, a block
whose words are all in links is a menu.

Defined cases: null or empty html gives an empty text; broken markup is read as browsers do (implied ends, unclosed
tags, stray ends); repeated rows each give their text and are one page to the wrapper; a host with too few different pages has no template; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written
from .urls import host_of

#: Pages of a group, on average.
GROUP = 32
#: A text in a slot is template on this percentage of at least so many different pages of the host.
CONSTANT, LEAST_PAGES = 80, 4
#: Cells of one table of alignment; longer lists of children are halved until they fit.
CELLS = 4_000_000
#: Bytes and pages that a task parses at once (a longer page by itself).
READ_BYTES, READ_PAGES = 4 << 20, 500

# fixed values: element names of HTML
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = set("head nav aside footer form button select noscript template svg canvas object audio video menu dialog map fieldset datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
NOISE = set(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments reply replies disqus respond discussion share sharing social related recommended"
    " recommendations newsletter subscribe subscription signup login search pagination pager toolbar widget widgets skip copyright paywall".split()
)
#: Words that a name of an article's own part may have as well ("related-work", "post-discussion").
AMBIGUOUS = set("alert alerts aside banner copyright discussion login menu menus navigation notice notices overlay promotion recommendations recommended related respond search share sharing skip social toolbar widget widgets".split())
#: Words that a name of a noise element may have besides, inside a marked article.
LAYOUT = set("area bar block body bottom box btn button container content group head header inner item items left line link links list outer panel right row section slot text title top unit wrap wrapper".split())
_CLOSED_BY = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
#: Class words of inline elements that are left out.
INLINE_NOISE = set("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion popup".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_WORDS = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")
_SAID = re.compile(r"[^\W_]")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


class Node:
    __slots__ = ("tag", "label", "parent", "noise", "main", "doubt", "text", "menu")

    def __init__(self, tag: str, label: str, parent: int, noise: bool, main: bool, doubt: int):
        self.tag, self.label, self.parent, self.noise, self.main = tag, label, parent, noise, main
        #: The innermost element here or above that only class words call noise, or -1.
        self.doubt = doubt
        self.text, self.menu = "", False


class Tags:
    """The tags of a page, each found in time linear in the page: what has no end further on is remembered."""

    def __init__(self, text: str):
        self.text, self.last = text, {c: text.rfind(c) for c in ">\"'"}
        self.last_data = text.rfind("]]>")
        #: Quotes outside of which a tag has been found to have no end.
        self.doomed: set[int] = set()

    def _end(self, at: int) -> int:
        """The place of the ">" that ends a tag; the first one where quotes don't close."""
        text, at_first, opened = self.text, at, []
        while m := _STOP.search(text, at):
            if m[0] == ">":
                return m.start()
            quote = m.start()
            if quote in self.doomed or quote >= self.last[m[0]]:
                break
            opened.append(quote)
            at = text.index(m[0], quote + 1) + 1
        self.doomed.update(opened)
        return text.index(">", at_first)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag, comment (no name) or data section ("[")."""
        text = self.text
        while (start := text.find("<", at)) >= 0:
            if text.startswith("<!--", start):
                end = text.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(text), "", False, ""
            if text.startswith("<![CDATA[", start) and start + 9 <= self.last_data:
                return start, text.index("]]>", start + 9) + 3, "[", False, ""
            if start < self.last[">"]:
                if text.startswith(("<!", "<?"), start):
                    return start, text.index(">", start) + 1, "", False, ""
                if m := _NAME.match(text, start + 1):
                    if m.end() <= self.last[">"]:
                        end = self._end(m.end())
                        return start, end + 1, m[2].lower(), bool(m[1]), text[m.end() : end]
            at = start + 1
        return None


def _class_words(attributes: dict[str, str]) -> tuple[set[str], list[str]]:
    """The words of class and id, and the names that say what the element is (not what it has or lacks)."""
    names = (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split()
    own = [n for n in names if not re.match("(?:has|with|no|without|is|not|hide|show)[-_]", n)]
    return set(_WORDS.findall(" ".join(names))), own


def _doubtful(own: list[str], main: bool) -> bool:
    """Whether class words call an element noise.  Inside a marked article an ambiguous word is enough only in a name of
    nothing but such words and words of layout ("related-links", not "related-work")."""
    for name in own:
        words = set(_WORDS.findall(name))
        if words & NOISE and (not main or words & NOISE - AMBIGUOUS or words <= NOISE | LAYOUT):
            return True
    return False


def parse(text: str) -> list[tuple[int, str, str, bool, bool, bool]]:
    """(parent, label, block text, noise, inside the article, whether all its words are in links) of block nodes in page
    order.  Text between child blocks is a child "#text".  What is left out stands as one node without text.

    Class words are weak evidence: an element that only they call noise is kept all the same if it has more than half of
    a page's text and no article is marked outside of it.  Two elements with more than half of the text lie in each
    other, so which are kept follows from one pass over the sizes."""
    nodes, stack = [Node("#root", "#root", -1, False, False, -1)], [0]
    open_: Counter = Counter()
    buffer: list[tuple[str, bool]] = []
    link, at, size, seen, mute, inner = False, 0, len(text), 0, "", 0
    tags = Tags(text)

    def flush() -> None:
        if buffer:
            node = nodes[stack[-1]]
            if not node.noise and (said := _SPACES.sub(" ", _html.unescape("".join(x for x, _ in buffer))).strip()):
                nodes.append(leaf := Node("#text", "#text", stack[-1], False, node.main, node.doubt))
                leaf.text = said
                leaf.menu = any(x for _, x in buffer) and not _SAID.search(_html.unescape("".join(x for x, linked in buffer if not linked)))
            buffer.clear()

    def cut(depth: int) -> None:
        for i in stack[depth:]:
            open_[nodes[i].tag] -= 1
        del stack[depth:]

    while at < size:
        found = tags.next(at)
        end = found[0] if found else size
        if end > at and not mute and not nodes[stack[-1]].noise:
            buffer.append((text[at:end], link))
        if not found:
            break
        start, at, name, closing, given = found
        if name == "[" and not mute:
            buffer.append((_html.escape(text[start + 9 : at - 3]), link))
        if name in ("", "["):
            continue
        if name in RAW and not closing:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(text, at)
            ends = text.find(">", close.end()) if close else -1
            at = ends + 1 if ends >= 0 else size
            continue
        block = name in BLOCKS or name in DROPPED
        if mute:  # an inline element that is left out: up to its end, or to that of the block around it
            if name == mute and name not in VOID:
                inner += -1 if closing else 1
                mute = mute if inner > 0 else ""
                continue
            if not (block and closing and seen == 0):
                seen += (-1 if closing else 1) if block and name not in VOID else 0
                continue
            mute = ""
        if not block and not closing and name not in VOID and ("class" in given or "style" in given or "id" in given):
            attributes = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(given)}
            if set(_WORDS.findall(" ".join(_class_words(attributes)[1]))) & INLINE_NOISE or _UNSEEN.search(attributes.get("style", "")):
                mute, inner, seen = name, 1, 0
                buffer.append((" ", link))
                continue
        if name == "a":
            link = not closing
            continue
        if name == "br":
            buffer.append((" ", link))
            continue
        if not block:
            continue
        if closing:
            if open_[name]:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == name:
                        flush()
                        cut(depth)
                        link = False
                        break
            continue
        flush()
        link = False
        if name in BLOCKS and name not in ("body", "html"):
            # a block ends an open paragraph; items, cells and rows end each other
            if nodes[stack[-1]].tag == "p":
                cut(len(stack) - 1)
            ended, within = (x.split() for x in _CLOSED_BY.get(name, ("", "")))
            if any(open_[x] for x in ended):
                for depth in range(len(stack) - 1, 0, -1):
                    tag = nodes[stack[depth]].tag
                    if tag in ended:
                        cut(depth)
                        break
                    if tag in within:
                        break
        elif name in ("body", "html") and open_[name]:
            continue
        if name == "body":
            while nodes[stack[-1]].tag not in ("#root", "html"):
                cut(len(stack) - 1)
        if name == "hr":
            continue
        attributes = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(given)}
        above = nodes[stack[-1]]
        words, own = _class_words(attributes)
        part = name in ("article", "main") and not words & {"comment", "comments", "reply", "replies"}
        noise = above.noise or name in DROPPED or (name == "header" and not above.main) or attributes.get("role", "").lower() in ROLES
        noise = noise or (name not in ("body", "html") and bool(_UNSEEN.search(attributes.get("style", ""))))
        noise = noise or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", given), re.I)) or attributes.get("aria-hidden", "").lower() == "true"
        doubt = above.doubt
        if not noise and not part and name not in ("body", "html") and _doubtful(own, above.main):
            doubt = len(nodes)
        main = not noise and (above.main or part)
        stack.append(len(nodes))
        open_[name] += 1
        if above.noise:
            nodes.append(Node(name, "", -2, True, False, -1))
        else:
            nodes.append(Node(name, name + "." + ".".join(sorted(words)), stack[-2], noise, main, doubt))
    flush()
    kept = _kept(nodes)
    out, place = [], {-1: -1}
    for i, n in enumerate(nodes):
        if n.parent in place and (n.parent < 0 or not out[place[n.parent]][3]):
            place[i] = len(out)
            out.append((place[n.parent], n.label, n.text, n.noise or (n.doubt == i and i not in kept), n.main, n.menu))
    return out


def _kept(nodes: list[Node]) -> set[int]:
    """The elements that class words call noise, but which are kept."""
    outer = {i: nodes[n.parent].doubt for i, n in enumerate(nodes) if n.doubt == i}
    sizes = dict.fromkeys(outer, 0)
    for n in nodes:
        if n.text and n.doubt >= 0:
            sizes[n.doubt] += len(n.text)
    whole = sum(sizes.values()) + sum(len(n.text) for n in nodes if n.doubt < 0)
    for i in reversed(outer):
        if outer[i] >= 0:
            sizes[outer[i]] += sizes[i]
    kept: set[int] = set()
    shown = {n.doubt for n in nodes if n.main and n.text}
    if -1 not in shown:
        for i in outer:  # in page order, so outer ones come first
            if 2 * sizes[i] > whole:
                kept.add(i)
                if i in shown:
                    break
    return kept


def outline(text: str | None) -> tuple[list[int], list[int], list[int], list[tuple[int, str]]]:
    """parents, labels and text keys of the tree, and (key, text) of the blocks that may be content.  A key stands for
    a text at a path of labels."""
    nodes = parse(text or "")
    whole = any(main and said for _, _, said, _, main, _ in nodes)
    paths, keys, blocks = [], [], []
    for parent, label, said, noise, main, menu in nodes:
        paths.append(_hash(str(paths[parent]) if parent >= 0 else "", label))
        # outside a marked article, blocks whose words are all in links are menus
        keep = bool(said) and not noise and (main or not whole and not menu)
        keys.append(_hash(str(paths[-1]), said) | 1 if keep else 0)
        if keep:
            blocks.append((keys[-1], said))
    return [n[0] for n in nodes], [_hash(n[1]) for n in nodes], keys, blocks


class Matcher:
    """Simple tree matching; equal shapes are matched once."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.of: list[tuple[int, tuple[int, ...]]] = []
        self.size: list[int] = []
        self.best: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def shape(self, label: int, children: tuple[int, ...]) -> int:
        if (key := (label, children)) not in self.shapes:
            self.shapes[key] = len(self.of)
            self.of.append(key)
            self.size.append(1 + sum(self.size[c] for c in children))
        return self.shapes[key]

    def tree(self, parents: list[int], labels: list[int]) -> tuple[list[int], list[list[int]]]:
        """Each node's shape, and its children."""
        children: list[list[int]] = [[] for _ in parents]
        shapes = [0] * len(parents)
        for i in range(len(parents) - 1, -1, -1):
            children[i].reverse()
            shapes[i] = self.shape(labels[i], tuple(shapes[c] for c in children[i]))
            if parents[i] >= 0:
                children[parents[i]].append(i)
        return shapes, children

    def match(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """How many nodes two shapes share, and the pairs of children's places."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) not in self.best:
                (lx, cx), (ly, cy) = self.of[x], self.of[y]
                if lx != ly:
                    self.best[x, y] = (0, [])
                elif x == y:
                    self.best[x, y] = (self.size[x], [(i, i) for i in range(len(cx))])
                elif open_ := [p for p in {(p, q) for p in set(cx) for q in set(cy) if self.of[p][0] == self.of[q][0]} if p not in self.best]:
                    todo += open_
                    continue
                else:
                    self.best[x, y] = self.aligned(cx, cy)
            todo.pop()
        return self.best[a, b]

    def aligned(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        """The best alignment of two lists of children.  Equal heads and tails always belong together."""
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        x, y = a[head : len(a) - tail], b[head : len(b) - tail]
        pairs = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
        score = 1 + sum(self.size[a[i]] for i, _ in pairs)
        if not x or not y:
            return score, sorted(pairs)
        own, other = sorted(set(x)), sorted(set(y))
        weight = np.array([[self.best[p, q][0] if self.of[p][0] == self.of[q][0] else 0 for q in other] for p in own], np.int64)
        total, found = _heaviest(weight, np.searchsorted(own, x), np.searchsorted(other, y))
        return score + total, sorted(pairs + [(i + head, j + head) for i, j in found])


def _heaviest(weight: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest pairing in order of two sequences.  A table that would have more than CELLS cells is halved at the
    place where the best pairing crosses the middle row, so memory stays linear in the sequences."""

    def last_row(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        m = np.zeros(len(columns) + 1, np.int64)
        for r in rows.tolist():
            m[1:] = np.maximum.accumulate(np.maximum(m[1:], m[:-1] + weight[r, columns]))
        return m

    total, pairs, todo = 0, [], [(0, len(rows), 0, len(columns))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a + 1) * (d - c + 1) > CELLS and b - a > 1:
            half = (a + b) // 2
            at = c + int(np.argmax(last_row(rows[a:half], columns[c:d]) + last_row(rows[half:b][::-1], columns[c:d][::-1])[::-1]))
            todo += [(a, half, c, at), (half, b, at, d)]
            continue
        m = np.zeros((b - a + 1, d - c + 1), np.int32)
        for i, r in enumerate(rows[a:b].tolist()):
            np.maximum.accumulate(np.maximum(m[i, 1:], m[i, :-1] + weight[r, columns[c:d]]), out=m[i + 1, 1:])
        total += int(m[-1, -1])
        i, j = b - a, d - c
        while i and j:
            w = weight[rows[a + i - 1], columns[c + j - 1]]
            if w and m[i, j] == m[i - 1, j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((a + i, c + j))
            elif m[i, j] == m[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return total, pairs


def evidence(trees: list[tuple[list[int], list[int], list[int]]]) -> tuple[int, Counter]:
    """For one group: the number of different pages, and on how many of them each key's slot holds its text."""
    different = {}
    for t in trees:
        different.setdefault(tuple(k for k in t[2] if k), t)
    trees = sorted(different.values(), key=lambda t: (-len(t[0]), t[2]))
    if len(trees) < 2:
        return len(trees), Counter()
    matcher, (parents, labels, keys) = Matcher(), trees[0]
    shapes, children = matcher.tree(parents, labels)
    placed = [[(i, k) for i, k in enumerate(keys) if k]]
    for p, l, k in trees[1:]:
        other, below = matcher.tree(p, l)
        todo, found = [(0, 0)] if p and labels[0] == l[0] else [], []
        while todo:
            x, y = todo.pop()
            found.append((x, y))
            todo += [(children[x][i], below[y][j]) for i, j in matcher.match(shapes[x], other[y])[1]]
        placed.append([(x, k[y]) for x, y in found if k[y]])
    # what a page has besides the texts that nearly all pages of the group have in one slot
    common = {k for (_, k), n in Counter(s for page in placed for s in page).items() if 100 * n >= CONSTANT * len(trees)}
    slots: list[Counter] = [Counter() for _ in parents]
    own: set[tuple[int, ...]] = set()
    for t, page in zip(trees, placed):
        if (rest := tuple(k for k in t[2] if k and k not in common)) not in own:
            own.add(rest)
            for x, k in page:
                slots[x][k] += 1
    return len(own), Counter({k: n for s in slots for k, n in s.items() if n > 1})


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars, n_blocks for every row."""
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, at = np.cumsum(np.array(pc.fill_null(pc.binary_length(b.column(3)), 0), np.int64)), 0
            while at < b.num_rows:
                upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + READ_BYTES, "right"))
                part = b.slice(at, min(max(upto - at, 1), READ_PAGES))
                at += part.num_rows
                found = [outline(x) for x in part.column(3).to_pylist()]
                lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in range(3)]
                blocks = pa.array([[{"key": k, "text": t} for k, t in f[3]] for f in found], pa.list_(pa.struct([("key", pa.int64()), ("text", pa.string())])))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *lists, blocks], ["id", "url", "host", "parents", "labels", "keys", "blocks"])

    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    rows = written(rows.mapInArrow(read, f"id {kind}, url string, host string, parents array<long>, labels array<long>, keys array<long>, blocks array<struct<key: long, text: string>>"), "page_blocks")
    # pages of one host that have the same texts at the same places are one page, however often they come
    tree = F.struct("parents", "labels", "keys")
    trees = written(rows.groupBy("host", F.xxhash64("keys").alias("_same")).agg(F.min(tree).alias("_tree")).select("host", "_same", "_tree.*"), "page_trees")
    sizes = written(trees.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "host_groups")
    trees = trees.join(sizes, "host").withColumn("group", F.pmod(F.xxhash64("_same"), "groups")).drop("groups", "_same")

    def vote(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        pages, counts = evidence(list(zip(got["parents"], got["labels"], got["keys"])))
        host = got["host"][0]
        return pa.table({"host": pa.array([host] * (len(counts) + 1), pa.string()), "key": pa.array([0, *counts], pa.int64()), "n": pa.array([pages, *counts.values()], pa.int64())})

    votes = trees.groupBy("host", "group").applyInArrow(vote, "host string, key long, n long").groupBy("host", "key").agg(F.sum("n").alias("n"))
    votes = written(votes, "page_votes")
    of = votes.filter("key = 0").select("host", F.col("n").alias("pages"))
    fixed = votes.filter("key <> 0").join(of, "host").filter((F.col("pages") >= LEAST_PAGES) & (100 * F.col("n") >= CONSTANT * F.col("pages")))
    # a list for each host, as long as a page's template; written, so that Spark knows its size and joins accordingly
    fixed = written(fixed.groupBy("host").agg(F.collect_list("key").alias("template")), "page_templates")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("template", b["key"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return rows.select("id", "url", "host", "blocks").join(fixed, "host", "left").select(F.col("id").alias(key), "url", text.alias("text"), F.size(kept).alias("n_blocks")).withColumn("n_chars", F.length("text").cast("long")).select(key, "url", "text", "n_chars", "n_blocks")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

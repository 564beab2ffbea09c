"""Main text of HTML pages by wrapper induction.

Pages of one host with the same layout form a group. The page with the fewest elements is the group's reference; every
page's tree is aligned to it by simple tree matching. An element of the reference whose text is the same in at least half
of the group's pages is template; what varies is a slot. Pages with the same longest block in their article (without one,
with the same text) are near copies and count as one page, digits being equal. A page's text is what stands in its slots: inside its article
(else its main part, else the whole body), without elements whose tag or class names another role. A name never removes what
holds the largest article or main part, nor most of the text around it; inside an article only whole class names that are
sure count, and slots decide about the rest.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common

#: Pages a group needs for a template, and the share of them that has to have the same text in the same place.
LEAST_PAGES, SHARE = 5, 0.5
MOST_LOST = 0.5  # share of an article's text that a template may remove
#: Bytes of references that tasks hold; pages of further groups are joined to theirs, in SALTS parts of each group.
MOST_BYTES, SALTS = 64 << 20, 32
KEPT_TREES = 256  # parsed references that a task keeps
MOST_DEPTH = 200  # in tree matching deeper elements become siblings, so that recursion is bounded

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure "
    "figcaption header footer nav aside form fieldset address details summary hr dialog menu center".split())
#: What an opening tag closes, as far as the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_scopes = frozenset("html body article section main div ul ol li dl dd dt table tr td th blockquote figure header footer nav aside form fieldset details dialog".split())
#: Elements that hold no main text, and words in class, id and role that say so.
OTHER_TAGS = frozenset("head script style noscript template iframe object svg canvas nav aside footer form button select textarea title dialog menu".split())
OTHER_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside banner ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "notice notices cookie cookies consent popup modal overlay comment comments disqus respond reply replies form search login signup subscribe newsletter share "
    "sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget complementary contentinfo alert".split())

#: Class names that say so inside an article too, where parts of a name, or a header, say nothing; and compounds that do.
INSIDE_NAMES = (OTHER_NAMES - {"header", "masthead", "form", "search", "alert", "related", "respond", "reply", "replies", "modal", "menu"}) | frozenset(
    "ad-slot ad-container ad-banner ad-unit share-buttons share-bar social-share social-links newsletter-signup related-posts related-articles related-links "
    "recommended-articles comment-list comments-area comment-form cookie-notice cookie-banner post-navigation nav-links breadcrumb-list".split())
#: Beginnings of class names that tell of a layout, not of the element's own role.
LAYOUT_NAMES = ("no-", "has-", "with-", "without-", "hide-", "not-", "is-")

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?", re.S)
_attribute = re.compile(r"(?i)(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_name = re.compile(r"[A-Za-z0-9]+")
_digit = re.compile(r"[0-9]+")


def parse(page: str) -> list[list]:
    """Nodes in page order: [parent, tag, names]; a piece of text is [parent, "#", text]. The first node is the root."""
    nodes: list[list] = [[-1, "", ""]]
    open_ = _Open(nodes)
    at, size = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            nodes.append([open_.stack[-1], "#", html.unescape(piece)])

    while at < size:
        m = _token.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = open_.last(tag)
            if k > 0 and (tag in BLOCK or k > open_.last_scope()):  # an inline end tag doesn't close a block
                open_.cut(k)
            continue
        if tag in BLOCK:
            open_.close(open_.last("p"), open_.last_scope())
        if tag in CLOSES:
            open_.close(*(max(map(open_.last, tags)) for tags in CLOSES[tag]))
        names = " ".join(x.lower() for a in _attribute.finditer(m[3]) for x in (a[2] or a[3] or a[4] or "").split()) if m[3] else ""
        nodes.append([open_.stack[-1], tag, names])
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?").search(page, at)
            at = end.end() if end else size
            continue
        open_.push(tag)
    return nodes


class _Open:
    """The open elements, as deep as they are, with the places of each tag, so that no step walks down the stack."""

    def __init__(self, nodes: list[list]):
        self.nodes, self.stack, self.places, self.scopes = nodes, [0], {}, []

    def push(self, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _scopes:
            self.scopes.append(len(self.stack))
        self.stack.append(len(self.nodes) - 1)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def last_scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.nodes[self.stack.pop()][1]
            self.places[tag].pop()
            if tag in _scopes:
                self.scopes.pop()

    def close(self, k: int, stop: int) -> None:
        if k > stop:
            self.cut(k)


def _elements(nodes: list[list]) -> tuple[list[list[int]], list[str], list[str]]:
    """Child elements, label and own text of each node. Elements deeper than MOST_DEPTH are children of the one at that depth."""
    children: list[list[int]] = [[] for _ in nodes]
    texts = [""] * len(nodes)
    depth, holder = [0] * len(nodes), list(range(len(nodes)))
    for i, (parent, tag, body) in enumerate(nodes[1:], 1):
        if tag == "#":
            texts[parent] += body
        else:
            depth[i] = depth[parent] + 1
            if depth[i] >= MOST_DEPTH:
                holder[i] = holder[parent]
            children[holder[parent]].append(i)
    labels = [f"{tag} {names}" if tag != "#" else "#" for _, tag, names in nodes]
    return children, labels, [" ".join(t.split()) for t in texts]


class Tree:
    """A page's elements: children, labels and own texts by node."""

    def __init__(self, nodes: list[list]):
        self.kids, self.labels, self.texts = _elements(nodes)


def _weight(x: Tree, y: Tree, a: int, b: int, tables: dict) -> int:
    """Nodes of the largest match of two subtrees whose roots have the same label; keeps the tables by pair of roots."""
    own, other = x.kids[a], y.kids[b]
    if not own or not other:
        return 1
    before = [0] * (len(other) + 1)
    rows = [before]
    for i in own:
        row, label, leaf = [0], x.labels[i], not x.kids[i]
        for k, j in enumerate(other):
            best = row[k] if row[k] > before[k + 1] else before[k + 1]
            if y.labels[j] == label:
                both = before[k] + (1 if leaf or not y.kids[j] else _weight(x, y, i, j, tables))
                if both > best:
                    best = both
            row.append(best)
        rows.append(row)
        before = row
    tables[a, b] = rows
    return 1 + before[-1]


def align(x: Tree, y: Tree) -> list[int]:
    """For each node of a page the element of the reference that simple tree matching pairs it with, or -1."""
    tables: dict[tuple[int, int], list[list[int]]] = {}
    _weight(x, y, 0, 0, tables)
    match, todo = [-1] * len(x.kids), [(0, 0)]
    while todo:
        a, b = todo.pop()
        match[a] = b
        rows, own, other = tables.get((a, b)), x.kids[a], y.kids[b]
        if rows is None:
            continue
        i, j = len(own), len(other)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((own[i], other[j]))
    return match


def _named(tag: str, names: str, inside: bool) -> bool:
    """Whether an element's class, id or role gives it another role than main text."""
    if not names or tag in ("html", "body", "article", "main") or inside and tag == "header":
        return False
    if inside:
        return not INSIDE_NAMES.isdisjoint(names.split())
    return any(not OTHER_NAMES.isdisjoint(_name.findall(n)) for n in names.split() if not n.startswith(LAYOUT_NAMES))


def _amounts(nodes: list[list]) -> list[int]:
    """Characters of text below each node, white space aside."""
    out = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        parent, tag, body = nodes[i]
        if tag == "#":
            out[i] = len("".join(body.split()))
        if tag not in OTHER_TAGS:
            out[parent] += out[i]
    return out


def _shielded(nodes: list[list], amount: list[int]) -> set[int]:
    """The elements that hold the largest article, and those that hold the largest main part: no name removes them."""
    best: dict[str, int] = {}
    for i, (_parent, tag, names) in enumerate(nodes):
        if tag in ("article", "main") and not {"comment", "comments"} & set(names.split()) and (tag not in best or amount[i] > amount[best[tag]]):
            best[tag] = i
    out = set()
    for i in best.values():
        while i >= 0:
            out.add(i)
            i = nodes[i][0]
    return out


def _main(nodes: list[list]):
    """"article", "main" or "" (the body), the elements that hold its text, and a function from nodes to skip to its blocks."""
    gone, inside, block = [False] * len(nodes), [""] * len(nodes), [0] * len(nodes)
    linked, around = [False] * len(nodes), [0] * len(nodes)
    found = {"article": False, "main": False}
    amount = _amounts(nodes)
    shielded = _shielded(nodes, amount)
    for i, (parent, tag, names) in enumerate(nodes):
        if parent < 0:
            continue
        inside[i], gone[i], linked[i], around[i] = inside[parent], gone[parent], linked[parent] or tag == "a", around[parent]
        block[i] = i if tag in BLOCK else block[parent]
        if tag == "#":
            continue
        role = bool({"comment", "comments"} & set(names.split()))
        if tag in found and not role:
            inside[i] = tag if inside[i] != "article" else "article"
            around[i] = i
        wide = amount[i] > MOST_LOST * amount[around[parent]]
        named = (role or not wide and _named(tag, names, bool(inside[i]))) and i not in shielded
        gone[i] = gone[i] or tag in OTHER_TAGS or tag == "header" and not inside[i] or named
        if tag in found and not gone[i]:
            found[tag] = True
    want = "article" if found["article"] else "main" if found["main"] else ""

    holds = {
        parent for parent, tag, _ in nodes[1:]
        if tag == "#" and not (gone[parent] or want and inside[parent] != want and not (want == "main" and inside[parent]))}

    def collect(skip) -> list[str]:
        blocks, words, links, last = [], [], [], -1

        def flush():
            body = " ".join("".join(words).split())
            if body and (want or not all(links)):  # outside an article, blocks of links alone are menus
                blocks.append(body)
            words.clear(), links.clear()

        for i, (parent, tag, body) in enumerate(nodes[1:], 1):
            if tag == "#":
                if parent not in holds or parent in skip:
                    continue
                if block[parent] != last:
                    flush()
                last = block[parent]
                words.append(body)
                if body.strip():
                    links.append(linked[parent])
            elif tag in BLOCK:
                flush()
                last = i
            elif tag == "br":
                words.append(" ")
        flush()
        return blocks

    return want, holds, collect


def main_text(nodes: list[list], template=frozenset()) -> str:
    """Blocks of the main text, joined by a space. `template` holds nodes whose own text is the same on other pages. It is
    not applied where nothing would be left, nor to an article (or main part) that would lose over MOST_LOST of its text."""
    want, _, collect = _main(nodes)
    text = " ".join(collect(template))
    if template:
        whole = " ".join(collect(frozenset()))
        if not text or want and len(text) < (1 - MOST_LOST) * len(whole):
            return whole
    return text


def vote(nodes: list[list]) -> int:
    """The same for near copies: hash of the longest block of the article or main part, else of all text, digits as 0."""
    want, _, collect = _main(nodes)
    blocks = collect(frozenset())
    return _hash(_digit.sub("0", max(blocks, key=lambda b: (len(b), b), default="") if want else " ".join(blocks)))


def layout(nodes: list[list]) -> str:
    """The kinds of elements in the upper three levels, in order, repeats once."""
    depth, seen = [0] * len(nodes), {}
    for i, (parent, tag, names) in enumerate(nodes[1:], 1):
        depth[i] = depth[parent] + 1
        if tag != "#" and depth[i] <= 3:
            seen[f"{depth[i]}{tag} {names}"] = None
    return "|".join(seen)


def _group(host: str, nodes: list[list]) -> int:
    return _hash(f"{host} {layout(nodes)}")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _slots(nodes: list[list], reference: Tree) -> list[tuple[int, int]]:
    """Nodes with text that are paired with an element of the reference, and the hash of that element and the text."""
    tree = Tree(nodes)
    return [(i, _hash(f"{j} {tree.texts[i]}")) for i, j in enumerate(align(tree, reference)) if j >= 0 and tree.texts[i]]


def _frequent(groups: DataFrame) -> DataFrame:
    """The groups with most pages whose references have MOST_BYTES together at most: all from a power of two of pages on."""
    level = F.length(F.bin("pages")) - 1
    sizes = {r["l"]: r["b"] for r in groups.groupBy(level.alias("l")).agg(F.sum(F.length("reference")).alias("b")).collect()}  # at most 64 rows
    least = 64
    while least > 0 and sum(b for lev, b in sizes.items() if lev >= least - 1) <= MOST_BYTES:
        least -= 1
    return groups.where(level >= least)


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Key, url, text (empty if there is none) and n_chars of every row.

    Null and empty pages have no text. Pages without url form groups of their own by layout; a null key and repeated rows
    are kept. Groups of fewer than LEAST_PAGES pages, near copies counted once, have no template. Where a template would
    leave nothing, or less than half of an article, it is not applied. An empty table gives an empty result.

    Pages are read three times (groups, template, text) and are not moved, except those of groups beyond the bound on what
    is broadcast, which are joined to their reference, each group dealt to SALTS tasks.
    """
    spark, kind = pages.sparkSession, pages.schema[key].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    body = F.coalesce(F.col(page).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), host.alias("host"), body.alias("html"))
    of_page = F.xxhash64("host", "html")  # equal pages are interchangeable as references

    def head(batches):
        for batch in batches:
            nodes = [parse(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([_group(h, n) for h, n in zip(batch.column(1).to_pylist(), nodes)], pa.int64()),
                pa.array([sum(x[1] != "#" for x in n) for n in nodes], pa.int32()), pa.array([vote(n) for n in nodes], pa.int64())], names=["page", "grp", "size", "vote"])

    heads = common.saved(rows.select(of_page.alias("page"), "host", "html").mapInArrow(head, "page long, grp long, size int, vote long"), "heads")
    votes = heads.groupBy("grp", "vote").agg(F.min(F.struct("size", "page")).alias("b"), F.count("*").alias("pages"))
    best = votes.groupBy("grp").agg(F.min("b").alias("b"), F.sum("pages").alias("pages"), F.count("*").alias("votes")).where(F.col("votes") >= LEAST_PAGES)
    best = common.saved(best.select("grp", F.col("b.page").alias("page"), "pages", "votes"), "best")
    chosen = rows.select(of_page.alias("_page"), "html").join(best, F.col("_page") == F.col("page")).groupBy("grp", "pages", "votes").agg(F.min("html").alias("reference"))
    groups = common.saved(chosen, "references")
    near = _frequent(groups)
    direct = {r["grp"]: r["reference"] for r in near.select("grp", "reference").toLocalIterator()}  # MOST_BYTES at most
    far = groups.join(near.select(F.col("grp").alias("_g")), F.col("grp") == F.col("_g"), "left_anti")
    shared, some_far = spark.sparkContext.broadcast(direct), not far.isEmpty()

    def placed(df: DataFrame) -> DataFrame:
        """Pages of groups that are not broadcast, with what df has for their group (grp, ...)."""
        def place(batches):
            for batch in batches:
                hosts, htmls = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                grp = [_group(h, parse(x)) for h, x in zip(hosts, htmls)]
                keep = pa.array([g not in shared.value for g in grp])
                yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), pa.array(grp, pa.int64()).filter(keep)], names=[*batch.schema.names, "grp"])

        own = rows.mapInArrow(place, f"id {kind}, url string, host string, html string, grp long").withColumn("s", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        side = df.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("grp", "_g")
        return own.join(side, (F.col("grp") == F.col("_g")) & (F.col("s") == F.col("_s")), "left")

    def count(batches, of):
        """Slots of a batch that hold main text, with the votes for them; `of` gives group and reference of each row."""
        cache: dict[int, Tree] = {}
        for batch in batches:
            found: dict[tuple[int, int, int], None] = {}
            for grp, nodes, reference in of(batch):
                if reference is not None:
                    if grp not in cache:
                        if len(cache) >= KEPT_TREES:
                            cache.clear()
                        cache[grp] = Tree(parse(reference))
                    holds, own = _main(nodes)[1], vote(nodes)
                    found.update(((grp, slot, own), None) for i, slot in _slots(nodes, cache[grp]) if i in holds)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["grp", "slot", "vote"])

    def direct_rows(batch):
        for host_, html_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes = parse(html_)
            grp = _group(host_, nodes)
            yield grp, nodes, shared.value.get(grp)

    def far_rows(batch):
        for grp, html_, reference in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield grp, parse(html_), reference

    same = rows.select("host", "html").mapInArrow(lambda b: count(b, direct_rows), "grp long, slot long, vote long")
    if some_far:
        same = same.unionByName(placed(far).select("grp", "html", "reference").mapInArrow(lambda b: count(b, far_rows), "grp long, slot long, vote long"))
    same = same.distinct().groupBy("grp", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    fixed = same.join(groups.select(F.col("grp").alias("_g"), "votes", "reference"), F.col("grp") == F.col("_g")).where(F.col("n") >= SHARE * F.col("votes"))
    # At most two texts of each element of the reference can have half of the votes.
    fixed = common.saved(fixed.groupBy("grp", "reference").agg(F.collect_list("slot").alias("fixed")), "fixed")
    known = fixed.join(near.select(F.col("grp").alias("_g")), F.col("grp") == F.col("_g"), "left_semi")
    templates = spark.sparkContext.broadcast({r["grp"]: frozenset(r["fixed"]) for r in known.select("grp", "fixed").toLocalIterator()})

    def text_of(grp, nodes, reference, slots, cache):
        if not slots:
            return main_text(nodes)
        if grp not in cache:
            if len(cache) >= KEPT_TREES:
                cache.clear()
            cache[grp] = Tree(parse(reference))
        return main_text(nodes, frozenset(i for i, slot in _slots(nodes, cache[grp]) if slot in slots))

    def written(id_, url_, texts):
        return pa.RecordBatch.from_arrays([id_, url_, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    def write(batches):
        cache: dict[int, Tree] = {}
        for batch in batches:
            keep, texts = [], []
            for i, (host_, html_) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                nodes = parse(html_)
                grp = _group(host_, nodes)
                if grp in shared.value or not some_far:
                    keep.append(i)
                    texts.append(text_of(grp, nodes, shared.value.get(grp), templates.value.get(grp), cache))
            at = pa.array(keep, pa.int64())
            yield written(batch.column(0).take(at), batch.column(1).take(at), texts)

    def write_far(batches):
        cache: dict[int, Tree] = {}
        for batch in batches:
            texts = [text_of(g, parse(h), r, frozenset(f or ()), cache) for g, h, r, f in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield written(batch.column(0), batch.column(1), texts)

    schema = f"id {kind}, url string, text string, n_chars long"
    out = rows.mapInArrow(write, schema)
    if some_far:
        out = out.unionByName(placed(fixed).select("id", "url", "grp", "html", "reference", "fixed").mapInArrow(write_far, schema))
    return out.select(F.col("id").alias(key), F.col("url").alias(url), "text", "n_chars")

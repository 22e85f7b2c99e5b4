"""Main text of web pages by site style trees.

The pages of a host are merged into a tree of style nodes: a node is the path of container elements with their classes and ids.
Each node has a presentation importance, by the entropy H over its pages of the sequences of blocks that stand in it: 1 - exp(-H), one less the share of an even choice among
as many sequences as H amounts to. Menus, notices and footers look the same on every page, articles don't. And it has a
content importance, one less the mean entropy of the texts of its branch: a text on every page of the host says nothing, a text on
one page says all. A node's importance weighs the two by its number of sequences, and a branch is as important as its most important node. From each page, branches go that are
much less important than the most important branch of the page, and those of low content importance. A node on few pages has no importance, or one that isn't sure: names of elements and
marked articles decide about it then, or may remove it as well. Forms, scripts, hidden elements and readers' comments, which entropy can't tell from articles, always go.
"""

from __future__ import annotations

import html as html_module
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import drop_stored, per_batch, stored

#: Share of the importance of a page's most important branch below which a branch goes, content importance below which it goes even inside an article.
SHARE, CONTENT = 0.85, 0.3
#: Least pages of a node that is judged, those from which names and marks say nothing more about it, and their least part of the host's; weight of the content in a node with one sequence of blocks; bytes of trees that are broadcast.
PAGES, SURE, PART, WEIGHT, BROADCAST = 8, 16, 0.001, 0.5, 32 << 20
_BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul video audio iframe".split())
_CONTAINERS = frozenset("article aside body center div dl fieldset footer form header main menu nav ol section table td ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_DROPPED = frozenset("head nav footer aside form dialog button select fieldset menu search object audio video canvas".split())
#: Elements that an opening tag ends, if they are open inside the given scope.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSES_P = _BLOCKS - {"br", "button", "option", "optgroup", "legend", "caption", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words in a class or id that tell what an element is for.
_NOISE = frozenset("ad ads advert adverts advertisement advertising adsense banner banners promo promos promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar rail widget widgets nav navbar navigation navi menu menus breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager pages search skip copyright legal".split())
_MAIN = frozenset("article content post entry story body main text prose".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Words of readers' comments, and words that say that a name is about something else than what the element holds.
_COMMENTS = frozenset("comment comments commentlist disqus reply replies response responses".split())
_ABOUT = frozenset("has with no without open closed off".split())
#: Elements and roles that are never part of a text, wherever they stand.
_NEVER = frozenset("head form dialog button select fieldset object audio video canvas".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]")
_ENDING = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I) for name in _RAW}


#: Containers of a path at most: what is nested deeper belongs to the last of them; characters of a style at most, longer ones are hashed.
DEPTH, STYLE = 64, 64
#: Part of the remaining text that a marked article has to hold, and the least part of the longest article that another one has to have.
HOLDS, BESIDE = 0.5, 0.2


class _Element:
    __slots__ = ("name", "path", "depth", "never", "noise", "article")

    def __init__(self, name, path, depth, never, noise, article):
        self.name, self.path, self.depth, self.never, self.noise, self.article = name, path, depth, never, noise, article


_seen_tags: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def _named(name: str, value: str) -> tuple[bool, bool]:
    """Whether a class or id says that an element holds readers' comments, and whether it says that it is something else than content."""
    main = noise = comments = False
    for token in value.split():
        words = {w.lower() for w in _WORD.findall(token)}
        if not words.isdisjoint(_ABOUT):
            continue
        comments |= not words.isdisjoint(_COMMENTS)
        bad = words & _NOISE
        if not words.isdisjoint(_MAIN):
            bad -= {"header"}  # an article's own head
            main |= not bad
        noise |= bool(bad)
    outer = name in ("body", "html", "main", "p", "h1")
    return comments and not outer, noise and not main and not outer and name != "article"


def _style(name: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's style (name, classes and id without digits), whether it is never part of a text, and whether its name says that it isn't."""
    key = (name, attributes)
    found = _seen_tags.get(key)
    if found is None:
        style, never, noise = [name], name in _NEVER, name in _DROPPED
        if attributes:
            for attribute, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                attribute = attribute.lower()
                if attribute in ("class", "id"):
                    style.append(("." if attribute == "class" else "#") + "-".join(w.lower() for w in _WORD.findall(value)))
                    comments, other = _named(name, value)
                    never |= comments
                    noise |= other
                elif attribute == "role":
                    noise |= value.lower() in _ROLES
                    never |= value.lower() in ("form", "dialog", "alertdialog")
                elif attribute == "hidden" or (attribute == "aria-hidden" and value.lower() == "true"):
                    never = True
                elif attribute == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    never = True
        whole = "".join(style)
        found = whole if len(whole) <= STYLE else f"{name}~{xxhash.xxh3_64_hexdigest(whole)}", never, noise
        if len(attributes) <= 1000:
            if len(_seen_tags) > 50_000:
                _seen_tags.clear()
            _seen_tags[key] = found
    return found


def tags(source: str):
    """(start, end, closing, name, attributes) of the tags of a page in order; comments, declarations and raw elements with all that they hold come with an empty name.

    A tag ends at the first > outside quotes. If a quote is never closed the tag ends at its first >, and from there on quotes don't count on this page, so that no part of it is searched
    again and again. Where no > is left there are no more tags.
    """
    at, last, quotes = 0, source.rfind(">"), True
    while (begin := source.find("<", at)) >= 0:
        at = begin + 1
        if source.startswith("<!--", begin):
            close = source.find("-->", begin + 4)
            at = close + 3 if close >= 0 else len(source)
            yield begin, at, False, "", ""
            continue
        if begin > last:
            if source.find("<!--", begin) < 0:
                return
            continue
        head = _NAME.match(source, begin)
        if head is None:
            if source[begin + 1] in "!?/":
                at = source.index(">", begin) + 1
                yield begin, at, False, "", ""
            continue
        whole = _QUOTED.match(source, head.end()) if quotes else None
        if whole is None:
            quotes = False
        at = whole.end() if whole else source.index(">", head.end()) + 1
        name, attributes = head[2].lower(), source[head.end() : at - 1]
        if not head[1] and name in _RAW and not (attributes.endswith("/") and name in ("svg", "math")):
            close = _ENDING[name].search(source, at)
            at = close.end() if close else len(source)
            yield begin, at, False, "", ""
        else:
            yield begin, at, bool(head[1]), name, attributes


class _Stack:
    """Open elements, with the places of each name, so that the nearest one is found at once however deep a page is nested."""

    def __init__(self, root: _Element):
        self.all, self.places = [root], {}

    def nearest(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, element: _Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.all))
        self.all.append(element)

    def cut(self, at: int) -> None:
        while len(self.all) > at:
            self.places[self.all.pop().name].pop()


_WALLS, _OVER = ("article", "main", "table"), ("body", "html", "article", "main", "table")
_AROUND_P = ("table", "td", "th", "button", "li", "blockquote", "article", "section", "div")


def parts(source: str):
    """The texts and block borders of a page in order: (element, text, block), where a text of None ends a block and ``block`` names one that begins in the element.

    Tags need not be balanced: an end tag ends the elements opened since its start tag and is ignored without one; paragraphs,
    list items, cells and so on end where a new one begins. Comments, scripts and styles give nothing. Pages may be of any length and broken in any way: the work is in proportion to the length.
    """
    stack, at = _Stack(_Element("", "", 0, False, False, None)), 0
    for begin, end, closing, name, attributes in tags(source):
        if begin > at:
            yield stack.all[-1], html_module.unescape(source[at:begin]), None
        at = end
        if not name:
            continue
        if closing:
            if name in _BLOCKS:
                yield stack.all[-1], None, None
            k = stack.nearest((name,))
            if k and (name in _OVER or k >= stack.nearest(_WALLS)):  # a stray end tag doesn't leave the walls
                stack.cut(k)
            continue
        if name in _VOID:
            if name in _BLOCKS:
                yield stack.all[-1], None, name
            continue
        ends, scope = _ENDS.get(name, (None, None))
        if ends or name in _CLOSES_P:
            k = stack.nearest(ends or ("p",))
            if k > stack.nearest(scope or _AROUND_P):
                if name == "tr":
                    while k > 1 and stack.all[k - 1].name in ("tr", "td", "th"):
                        k -= 1
                stack.cut(k)
        if name in _BLOCKS:
            yield stack.all[-1], None, name
        elif attributes.endswith("/"):
            continue
        top = stack.all[-1]
        style, never, noise = _style(name, attributes)
        if name == "header":
            noise = noise or top.article is None
        path, depth = (f"{top.path}/{style}", top.depth + 1) if name in _CONTAINERS and top.depth < DEPTH else (top.path, top.depth)
        article = top.article if top.article is not None or name not in ("article", "main") else begin  # the outermost one, by its place
        stack.push(_Element(name, path, depth, top.never or never, top.noise or noise, article))
    if at < len(source):
        yield stack.all[-1], html_module.unescape(source[at:]), None


def _features(source: str):
    """(path, kind, feature) of a page: kind 0 a node's presence, 1 its sequence of blocks, 2 a text."""
    out, blocks, text = set(), {"": []}, []

    def close(element):
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                out.add((element.path, 2, xxhash.xxh3_64_intdigest(words) >> 1))

    last = None
    for element, piece, block in parts(source):
        if element is not last:
            path = element.path
            while path not in blocks:
                blocks[path] = []
                path = path.rpartition("/")[0]
            last = element
        if block:
            blocks[element.path].append(block)
        if piece is None:
            close(element)
        else:
            text.append(piece)
    if last is not None:
        close(last)
    for path, below in blocks.items():
        out.add((path, 0, 0))
        out.add((path, 1, xxhash.xxh3_64_intdigest(" ".join(below)) >> 1))
    return out


def main_text(source: str, tree: dict[str, tuple[float, float, bool]] | None = None, known: bool = True) -> str:
    """A page's main text under its host's ``tree``: the importance of each branch, by its path, its content importance, and whether these come from SURE pages.

    Where the tree is sure it decides alone. Elsewhere names and roles do, and marked articles, if they hold HOLDS of the text that remains: then only these are read, of several those
    that aren't much shorter than the longest. Forms, hidden elements and readers' comments go in any case. If nothing is left, low importance isn't regarded, and then low content neither. Without
    ``known``, the tree alone decides: names and marks of elements aren't regarded.
    """
    tree, pieces = tree or {}, []
    sure = {path for path, values in tree.items() if values[2]}
    for element, piece, _ in parts(source):
        pieces.append((" " if piece is None or (known and element.never) else piece, element))
    paths = {element.path for _, element in pieces}
    above = {path: ["/".join(steps[: k + 1]) for k in range(1, len(steps))] for path in paths if (steps := path.split("/"))}
    least = SHARE * max((tree[x][0] for way in above.values() for x in way if x in tree), default=0.0)
    low = {p: (any(x in tree and tree[x][0] < least for x in way), any(x in tree and tree[x][1] < CONTENT for x in way)) for p, way in above.items()}
    for step in range(3):
        kept = [(piece, e) for piece, e in pieces if not (step < 1 and low[e.path][0]) and not (step < 2 and low[e.path][1]) and not (known and e.noise and e.path not in sure)]
        if known:
            kept = _marked(kept, sure)
        held = {id(e) for _, e in kept}
        text = " ".join("".join(piece if id(e) in held else " " for piece, e in pieces).split())
        if text or not tree:
            return text
    return ""


def _marked(kept: list, sure: set) -> list:
    """Without what stands outside marked articles and isn't surely judged by the tree, if these hold enough of the text."""
    size: dict[int | None, int] = {}
    for piece, e in kept:
        size[e.article] = size.get(e.article, 0) + len("".join(piece.split()))
    inside = {a: n for a, n in size.items() if a is not None}
    if not inside or sum(inside.values()) < HOLDS * sum(size.values()):
        return kept
    longest = max(inside.values())
    return [(piece, e) for piece, e in kept if e.path in sure or inside.get(e.article, 0) >= max(BESIDE * longest, 1)]


def host(url) -> "F.Column":
    """The host of a url column, lower-cased, without port; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _above():
    """The paths of a node and of all nodes above it."""
    steps = F.split("path", "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def _own_importance(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, path, pages, content, own) of every style node on two pages or more, stored."""

    def make(batch):
        hosts, paths, kinds, features = [], [], [], []
        for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for path, kind, feature in _features(source):
                hosts.append(name)
                paths.append(path)
                kinds.append(kind)
                features.append(feature)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(kinds, pa.int32()), pa.array(features, pa.int64())], ["host", "path", "kind", "feature"])

    rows = pages.select(host(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    each = rows.mapInArrow(per_batch(make), "host string, path string, kind int, feature long")
    counted = each.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("k"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))
    nodes = counted.groupBy("host", "path").agg(
        of(0, F.col("k")).alias("pages"), of(1, F.lit(1.0)).alias("styles"), of(1, F.col("k") * F.log(F.col("k"))).alias("style_sum"),
        of(2, F.lit(1.0)).alias("features"), of(2, F.log(F.col("k"))).alias("feature_sum"),
    )
    nodes = stored(nodes, "style-nodes")
    # the features of a node are those of its whole branch
    branch = nodes.where("features > 0").select("host", F.explode(_above()).alias("path"), "features", "feature_sum")
    branch = branch.groupBy("host", "path").agg(F.sum("features").alias("all_features"), F.sum("feature_sum").alias("all_sum"))
    joined = nodes.join(branch, ["host", "path"], "left").where("pages > 1")
    size = F.log(F.col("pages"))
    presentation = 1 - F.exp(F.col("style_sum") / F.col("pages") - size)
    content = F.coalesce(1 - F.col("all_sum") / (F.col("all_features") * size), F.lit(0.0))
    share = F.pow(F.lit(WEIGHT), F.col("styles"))
    each = stored(joined.select("host", "path", F.col("pages").cast("long").alias("pages"), content.alias("content"), ((1 - share) * presentation + share * content).alias("own")), "importance")
    drop_stored(nodes)
    return each


def _with_branches(each: DataFrame) -> DataFrame:
    highest = each.select("host", F.explode(_above()).alias("path"), "own").groupBy("host", "path").agg(F.max("own").alias("importance"))
    return each.join(highest, ["host", "path"])


def style_trees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, pages, content, own, importance) of every style node of every host, ``own`` without regard to the nodes below; the tree is summed up by partial aggregations alone."""
    return _with_branches(_own_importance(pages, url, html))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", known: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, whatever its key. Null or empty html gives the empty string; pages without a host share a tree of their own.

    A repeated page counts as often as it occurs. Pages may have any length; other columns don't matter; an empty table gives no rows. A page is parsed twice, for the trees and for its text. A host's tree, of at most 1 / PART times the
    nodes of a page, is joined to its pages by broadcast if all trees are within BROADCAST bytes, else by a shuffled join. Without ``known``, trees alone decide.
    """
    each = _own_importance(pages, url, html)
    trees = _with_branches(each)
    whole = trees.groupBy("host").agg(F.max("pages").alias("host_pages"))  # the root is on every page
    judged = trees.join(whole, "host").where((F.col("path") != "") & (F.col("pages") >= F.greatest(F.lit(PAGES), F.col("host_pages") * PART)))
    of_host = stored(judged.groupBy("host").agg(F.collect_list(F.struct("path", "importance", "content", (F.col("pages") >= SURE).alias("sure"))).alias("tree")), "trees")
    drop_stored(each)
    size = of_host.agg(F.sum(F.length("host") + 64 + F.aggregate("tree", F.lit(0), lambda n, x: n + F.length(x["path"]) + 40))).first()[0] or 0

    def make(batch):
        seen, texts = {}, []
        hosts, trees_of = batch.column(3).to_pylist(), batch.column(4)
        for i, (source, name) in enumerate(zip(batch.column(2).to_pylist(), hosts)):
            if name not in seen:
                seen[name] = {x["path"]: (x["importance"], x["content"], x["sure"]) for x in trees_of[i].as_py() or ()}
            texts.append(main_text(source, seen[name], known))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    joined = rows.withColumn("host", host(F.col("url"))).join(F.broadcast(of_host) if size <= BROADCAST else of_host, "host", "left")
    return joined.select("page_id", "url", "html", "host", "tree").mapInArrow(per_batch(make), "page_id long, url string, text string, n_chars long")

"""Main text of web pages, by equivalence-class template deduction.

A page is a sequence of tokens: tags, told apart by the path of the elements
that they stand in, and runs of text. Over the pages of one host, tokens with
one occurrence vector (as often on each page as each other) form a class. A
class that occurs on several pages, whose tokens keep one order and lie within
those of the class around it, is part of the host's template; the classes nest
into one from the document's root down. What stands between template tokens
are slots. Furniture (menus, heads, feet, side bars, notices, adverts, forms,
comments) is told by lists of tags, roles and class names, and left out; of
the rest the slots' text is extracted. The content is the page's article or
main element, else the elements that hold most of the page's and of the slots'
text. A run of text outside of it that is itself a token of a class belongs to
the template and is left out too; within it nothing is. Order and nesting must
hold on nine of ten of a token's pages, and on the page that is read.

Occurrence vectors are summed as hashes per token, so a host's pages need not
meet: each task adds up its own pages first.

Defined cases: null and empty html, and pages without main text, give an empty
text; a null URL is a host of its own; on hosts with fewer than ``FEW`` pages,
and within the content, runs of text are never held for template;
repeated rows count as pages of their own; pages without tokens count for no
class; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scan import html_markup
from .common import few, tidy, written

FEW, LINK_SHARE = 5, 0.5
#: Tokens of all templates up to which they are broadcast (8 bytes each); else pages and templates meet by host, at most about HOST_PAGES at once.
BROADCAST_TOKENS, HOST_PAGES = 1 << 22, 5000
#: Templates that a task keeps at hand.
KEPT_TEMPLATES = 1000
#: Elements whose content is not text.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math", "canvas", "title", "select", "datalist")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements within a line of text; all others begin and end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "legend"}
CONTENT = {"article", "main"}
#: Elements that hold text and no blocks.
HEADS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class and id names, and roles, that mark furniture.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "pager", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _furniture(name: str, rest: str, inside: bool) -> bool:
    """Whether an element, by its name and attributes, is furniture; ``inside``: it stands in an article."""
    if name in FURNITURE or name == "header" and not inside:
        return True
    if not rest.strip() or name in ("html", "body", "article", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), html_lib.unescape(next(filter(None, values), "")).lower()
        if key in ("class", "id") and not MARKS.isdisjoint(_NAME.findall(value)) or key == "role" and value.strip() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return not (inside and name == "header")
    return False


def _class(rest: str) -> str:
    return " ".join(sorted(x for key, *values in _ATTRIBUTE.findall(rest) if key.lower() in ("class", "id") for x in next(filter(None, values), "").lower().split())) if rest.strip() else ""


def _key(*parts) -> int:
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _tag_key(*parts) -> int:
    return _key(*parts)


class Paths:
    """The paths of a page's elements as numbers: 0 is the root, others have a parent, which comes before them, and a
    key. The elements themselves, which have paths, are numbered likewise."""

    def __init__(self):
        self.parent, self.depth, self.key, self.of = [0], [0], [_key("root")], {}
        self.element_parent, self.element_path = [0], [0]

    def element(self, parent: int, path: int) -> int:
        self.element_parent.append(parent)
        self.element_path.append(path)
        return len(self.element_path) - 1

    def owners(self, path: int) -> list[int]:
        """Of each element the innermost around it, or itself, that has ``path``; -1 if there is none."""
        found = [0 if path == 0 else -1]
        for e in range(1, len(self.element_path)):
            found.append(e if self.element_path[e] == path else found[self.element_parent[e]])
        return found

    def child(self, path: int, name: str, named: str = "") -> int:
        at = (path, name, named)
        if at not in self.of:
            self.of[at] = len(self.parent)
            self.parent.append(path)
            self.depth.append(self.depth[path] + 1)
            self.key.append(_tag_key(self.key[path], name, named))
        return self.of[at]

    def within(self, root: int) -> list[bool]:
        """Of each path whether it is ``root`` or leads through it."""
        found = [root == 0]
        for path in range(1, len(self.parent)):
            found.append(path == root or found[self.parent[path]])
        return found


def tokens(page: str | None) -> tuple[list[tuple], Paths]:
    """("open", path), ("close", path), ("text", path, run, in furniture, in article, linked, element) in page order, and the
    paths: of the names, class and id names of the elements that hold blocks. The time follows the page's length."""
    page = page or ""
    paths, out = Paths(), []
    stack: list[tuple[str, int, bool, bool, int]] = []  # name, path, furniture, content, element
    names: Counter = Counter()
    shut = inside = 0
    at, link = 0, False

    def push(name, path, furniture):
        nonlocal shut, inside
        stack.append((name, path, furniture, name in CONTENT, paths.element(stack[-1][4] if stack else 0, path)))
        names[name] += 1
        shut += furniture
        inside += name in CONTENT

    def pop():
        nonlocal shut, inside
        name, _, furniture, content, _ = stack.pop()
        names[name] -= 1
        shut -= furniture
        inside -= content

    scan = html_markup(page)
    for start, end, name, closes, rest in scan:
        path, element = (stack[-1][1], stack[-1][4]) if stack else (0, 0)
        if start > at:
            out.append(("text", path, page[at:start], shut > 0, inside > 0, link, element))
        at = end
        if name and not closes and name in _RAW_END and not rest.endswith("/"):
            found = _RAW_END[name].search(page, at)
            at = (page.find(">", found.end()) + 1 or len(page)) if found else len(page)
        elif name in INLINE:
            if name == "a":
                link = not closes
            if name == "br":
                out.append(("text", path, " ", shut > 0, inside > 0, link, element))
            elif not closes and name == "span" and _furniture(name, rest, inside > 0) and not rest.endswith("/"):
                push(name, paths.child(path, name), True)
            elif closes and name == "span" and stack and stack[-1][0] == "span":
                pop()
        elif name:
            link = False
            if closes and not names[name]:
                out.append(("close", paths.child(path, name)))
            elif closes:
                while stack[-1][0] != name:
                    pop()
                out.append(("close", stack[-1][1]))
                pop()
            elif name in VOID or rest.endswith("/"):
                out.append(("open", paths.child(path, name)))
            elif name in HEADS:
                if _furniture(name, rest, inside > 0):
                    push(name, paths.child(path, name, _class(rest)), True)
                out.append(("open", paths.child(path, name)))
            else:
                if stack and (stack[-1][0] in HEADS or name == stack[-1][0] == "li"):
                    pop()
                path = paths.child(stack[-1][1] if stack else 0, name, _class(rest))
                push(name, path, _furniture(name, rest, inside > 0))
                out.append(("open", path))
        scan.send(at)
    if page[at:].strip():
        out.append(("text", stack[-1][1] if stack else 0, page[at:], shut > 0, inside > 0, link, stack[-1][4] if stack else 0))
    return out, paths


def _squeezed(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def host_of(url: str | None) -> str:
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if url and "://" in url else ""


_CLOSE = 0x2545F4914F6CDD1D


def keyed(parsed: list[tuple], paths: Paths) -> list[int | None]:
    """The key of each token, none for blank runs."""
    out: list[int | None] = []
    for t in parsed:
        key = paths.key[t[1]]
        if t[0] != "text":
            out.append(key if t[0] == "open" else key ^ _CLOSE)
        elif run := _squeezed(t[2]):
            out.append(int.from_bytes(blake2b(run.encode("utf-8", "surrogatepass"), digest_size=8, key=key.to_bytes(8, "little", signed=True)).digest(), "little", signed=True))
        else:
            out.append(None)
    return out


def occurrences(page: str | None) -> dict[int, tuple[int, int, bool]]:
    """Of each token key: how often it occurs, the place of its first occurrence, and whether it is a run of text."""
    found: dict[int, list] = {}
    parsed, paths = tokens(page)
    for i, (t, key) in enumerate(zip(parsed, keyed(parsed, paths))):
        if key in found:
            found[key][0] += 1
        elif key is not None:
            found[key] = [1, i, t[0] == "text"]
    return {k: tuple(v) for k, v in found.items()}


ROOT = _key("root")
_WRAP = 1 << 61


def vectors(pages: DataFrame) -> DataFrame:
    """host, token, is_text, pages, vector (a hash of the occurrence vector) place (sum of first places) and times (that it occurs), for tokens on two pages or more."""

    def run(batches):
        for b in batches:
            seen: dict = defaultdict(lambda: [0, 0, 0, 0, False])
            for page_id, url, page in zip(*(b.column(c).to_pylist() for c in range(3))):
                found = occurrences(page)
                if not found:
                    continue
                host, mine, hashes = host_of(url), _key(page_id, url, page), {}
                for key, (n, first, is_text) in [(ROOT, (1, 0, False)), *found.items()]:
                    x = seen[host, key]
                    x[0] += 1
                    if n not in hashes:
                        hashes[n] = _key(mine, n)
                    x[1] = (x[1] + hashes[n]) % _WRAP
                    x[2] += first
                    x[3] += n
                    x[4] = is_text
            if seen:
                hosts, keys = zip(*seen)
                n, vector, place, times, is_text = zip(*seen.values())
                yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(keys, pa.int64()), pa.array(is_text), pa.array(n, pa.int64()), pa.array(vector, pa.int64()), pa.array(place, pa.int64()), pa.array(times, pa.int64())], names=["host", "token", "is_text", "pages", "vector", "place", "times"])

    rows = pages.select("page_id", "url", "html").mapInArrow(tidy(run), "host string, token long, is_text boolean, pages long, vector long, place long, times long")
    summed = rows.groupBy("host", "token").agg(F.max("is_text").alias("is_text"), F.sum("pages").alias("pages"), (F.sum(F.col("vector").cast("decimal(38,0)")) % _WRAP).cast("long").alias("vector"), F.sum("place").alias("place"), F.sum("times").alias("times"))
    return summed.filter("pages >= 2")


def classes(tokens_of_hosts: DataFrame) -> DataFrame:
    """host, vector, pages, size, times, text_tokens, tokens (in the order of their places): the equivalence classes of two tokens and more, on ``FEW`` pages or more."""
    grouped = tokens_of_hosts.filter(F.col("pages") >= FEW).groupBy("host", "vector", "pages")
    return grouped.agg(F.count("*").alias("size"), F.max("times").alias("times"), F.max(F.col("token") == ROOT).alias("is_root"), F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("text_tokens"), F.sort_array(F.collect_list(F.when(F.col("token") != ROOT, F.struct("place", "token"))))["token"].alias("tokens")).filter("size >= 2")


class Template:
    """The classes of a host, the tokens of each in order, from the widest class down."""

    def __init__(self, classes: list):
        self.classes = classes or []
        self.of = {key: (c, r) for c, members in enumerate(self.classes) for r, key in enumerate(members)}


class _Templates:
    """The templates of rows, made once for each host as long as they are few."""

    def __init__(self):
        self.known: dict[str, Template] = {}

    def get(self, host: str, cell) -> Template:
        if host not in self.known:
            if len(self.known) >= KEPT_TEMPLATES:
                self.known.clear()
            self.known[host] = Template(cell.as_py())
        return self.known[host]


def nested(keys: list[int | None], template: Template) -> set[int]:
    """The tokens that leave their class's order on the page or whose class crosses a wider one."""
    classes, of = template.classes, template.of
    open_: list[list[int]] = []  # class, last rank
    where: dict[int, int] = {}  # of an open class, its place among them
    bad: set[int] = set()
    for key in keys:
        if key not in of or key in bad:
            continue
        c, r = of[key]
        k = where.get(c)
        if k is None and r == 0:
            where[c] = len(open_)
            open_.append([c, 0])
        elif k is None or r <= open_[k][1]:
            bad.add(key)
        else:
            over = [x[0] for x in open_[k + 1 :]]
            if any(x < c for x in over):
                bad.update(classes[c])
                del open_[k]
                where = {x[0]: i for i, x in enumerate(open_)}
            else:
                for x in over:
                    bad.update(classes[x])
                    del where[x]
                del open_[k + 1 :]
                open_[k][1] = r
        if open_ and open_[-1][0] == c and open_[-1][1] == len(classes[c]) - 1:
            open_.pop()
            del where[c]
    return bad


def templates(pages: DataFrame) -> DataFrame:
    """host and template: the classes, of the tokens that keep their order and nest on nine of ten of their pages or more."""
    found = written(classes(vectors(pages)).filter("size(tokens) > 0").select("host", "vector", "pages", "times", "tokens"), "classes")

    def run(batches):
        found_at = _Templates()
        for b in batches:
            n: Counter = Counter()
            for host, page, cell in zip(*(b.column(c).to_pylist() for c in range(2)), b.column(2)):
                n.update((host, key) for key in nested(keyed(*tokens(page)), found_at.get(host, cell)))
            if n:
                hosts, keys = zip(*n)
                yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(keys, pa.int64()), pa.array(n.values(), pa.int64())], names=["host", "token", "bad"])

    rows = _beside(pages, _gathered(found)).filter("template IS NOT NULL").select("host", "html", "template")
    bad = written(rows.mapInArrow(tidy(run), "host string, token long, bad long").groupBy("host", "token").agg(F.sum("bad").alias("bad")), "disorder")
    each = found.select("host", "vector", "pages", "times", F.posexplode("tokens").alias("rank", "token")).join(bad, ["host", "token"], "left").filter("bad IS NULL OR 10 * bad <= pages")
    kept = each.groupBy("host", "vector", "pages", "times").agg(F.sort_array(F.collect_list(F.struct("rank", "token")))["token"].alias("tokens"))
    return written(_gathered(kept), "templates")


def _gathered(found: DataFrame) -> DataFrame:
    """host and template: the tokens of its classes, those on the most pages first, of these the least often found."""
    wide = F.struct((-F.col("pages")).alias("narrow"), "times", "vector", "tokens")
    return found.groupBy("host").agg(F.sort_array(F.collect_list(wide))["tokens"].alias("template"))


def _beside(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, url, html, host and its template."""
    at = F.instr("url", "://")
    host = F.lower(F.regexp_extract(F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise(""), r"^[^/?#]*", 0))
    rows = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))
    size = found.agg(F.sum(F.aggregate("template", F.lit(0), lambda n, x: n + F.size(x)))).first()[0] or 0
    if size <= BROADCAST_TOKENS:
        return rows.join(F.broadcast(found), "host", "left")
    crowds = few(written(rows.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).cast("int").alias("parts")).filter("parts > 1"), "crowds"))
    dealt = rows.join(crowds, "host", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.col("parts"))).cast("int"))
    copies = found.join(crowds, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.drop("parts").join(copies.drop("parts"), ["host", "part"], "left").drop("part")


def _region(runs: list[tuple], paths: Paths) -> int:
    """The innermost element's path that holds at least half of the unlinked text of ``runs`` (path, length)."""
    mass = [0] * len(paths.parent)
    for path, n in runs:
        mass[path] += n
    for path in range(len(mass) - 1, 0, -1):
        mass[paths.parent[path]] += mass[path]
    return max((p for p in range(len(mass)) if 2 * mass[p] >= mass[0]), key=lambda p: (paths.depth[p], mass[p])) if mass[0] else 0


def static_runs(parsed: list[tuple], paths: Paths, template: Template) -> set[int]:
    """Places of the template's runs of text outside of the content.

    The content is the element that holds most of the page's text and the one
    that holds most of the slots' text. A class that has most of its text there
    and is not the widest on the page is content that pages share, as copies do.
    Where several elements have the content's path, those with a slot are it.
    """
    keys = keyed(parsed, paths)
    of, bad = {key: c for key, (c, _) in template.of.items()}, nested(keys, template)
    runs = [(i, t[1], 0 if t[5] else len(t[2].strip()), of.get(key, -1) if key not in bad else -1) for i, (t, key) in enumerate(zip(parsed, keys)) if key is not None and t[0] == "text" and not t[3]]
    regions = {_region([(path, n) for _, path, n, _ in runs], paths)}
    if slots := [(path, n) for _, path, n, c in runs if c < 0 and n]:
        regions.add(_region(slots, paths))
    content = [any(x) for x in zip(*(paths.within(r) for r in regions))]
    outside = {i for i, path, _, _ in runs if not content[path]}
    for region in regions:
        owner = paths.owners(region)
        of_slots = {owner[parsed[i][6]] for i, _, n, c in runs if c < 0 and n} - {-1}
        outside |= {i for i, *_ in runs if of_slots and owner[parsed[i][6]] not in of_slots | {-1}}
    widest = min((of[key] for key in keys if key in of and key not in bad), default=-1)
    within: Counter = Counter()
    for i, _, n, c in runs:
        within[c] += -n if i in outside else n
    return {i for i, _, _, c in runs if i in outside and c >= 0 and (c == widest or within[c] <= 0)}


def main_text(page: str | None, template: Template | None = None) -> str:
    """Blocks of the page's main text, joined by newlines, without the template's own runs outside of the content."""
    parsed, paths = tokens(page)
    has_article = any(t[0] == "text" and t[4] and not t[3] and not t[2].isspace() for t in parsed)
    static = static_runs(parsed, paths, template) if template and template.of and not has_article else set()

    def blocks() -> list[str]:
        found: list[str] = []
        parts: list[str] = []
        linked = total = 0

        def flush():
            nonlocal linked, total
            text = _squeezed("".join(parts))
            if text and (has_article or linked <= LINK_SHARE * total):
                found.append(text)
            parts.clear()
            linked = total = 0

        for i, t in enumerate(parsed):
            if t[0] != "text":
                flush()
                continue
            _, _, run, shut, inside, link, _ = t
            if shut or has_article and not inside or i in static:
                continue
            parts.append(run)
            total += len(run.strip())
            linked += len(run.strip()) if link else 0
        flush()
        return found

    return "\n".join(blocks())


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    rows = _beside(pages, templates(pages))

    def run(batches):
        found_at = _Templates()
        for b in batches:
            texts = [main_text(page, found_at.get(host, cell)) for page, host, cell in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "template").mapInArrow(tidy(run), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")

"""HTML extraction by template deduction over the pages of a host.

Tokens of a page are its tags and the words of its texts, each with its path; a token that a page holds several times,
and all pages that hold it hold it as often, has several roles, and each of its occurrences is a token of its own. Per
host, tokens that occur in the same number in the same pages share an occurrence vector; they form an equivalence class.
A class that spans at least `support` of the host's different pages goes through two checks over all pages:

- order: tokens that leave the class's order on some page are taken out of it, the rest must be at least `min_class`;
- nesting: of two classes, the instances of one must lie in the same slot (between two neighbours) of the other or
  outside on all pages. Of two that don't nest, the one on more pages stays, of equal ones the larger.

The classes left nest into the host's template; slots are what lies between their tokens. The words in the slots of the
first class that occurs once a page are summed over the host's pages, without elements that are no main text by
themselves. The slots with the most words (at least `share` of the largest) hold the main text: on each page, the
innermost element around all of them is the content element, or the article around that. Its texts are extracted, in the
order of the page, without the elements that hold menus, notices, adverts, forms, scripts and comments. Where the page
has no article of its own, a block all of whose words are the template's is boilerplate too.

Only tokens in enough of a host's pages can be in a template, and most words are in few. Each task counts its pages'
tokens per host and thins the counts as heavy hitters are found: it takes off the same from all counts, never more than
half of what `support` asks for in all, so no token that could be in a template is lost, whatever the pages. The tokens
left, a few times a page's tokens per host, are then counted exactly, on pages that are cut down to them once and
written. Occurrence vectors are compared by order-independent sums of hashes of (page, count); no page list is gathered.
Equal pages of a host count once. Tables with a row per host are broadcast only if all of them are small, else joined by
host with salted keys.

Defined cases: null or empty html gives an empty text; pages whose host has fewer than `min_pages` different pages, and
pages without the template's slots, are extracted by structure alone (the article, or all that isn't dropped); rows with
equal ids are extracted one by one; an empty table gives no rows; other columns are ignored; null urls share the empty
host. Unclosed tags end where their parent ends; a comment or script without an end runs to the end of the page.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_BYTES, map_texts, mix64, shingle_hashes, small, stage

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only right after an equals sign
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)|[^>])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_WORDS = re.compile(r"[a-z0-9]+")

# HTML element names by what they do.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript head nav footer aside form button select option input template svg math object embed canvas audio video map dialog menu".split())
DROPPED_OUTSIDE = frozenset(["header"])  # a page's header; an article's own stays
CONTENT = ("article", "main")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section main div body html nav footer aside header form".split())
CLOSES_P = BLOCKS - frozenset("html body head option optgroup td th tr tbody thead tfoot caption li dt dd legend summary".split())
# Words of class and id names, and roles, that mark what isn't main text.
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist respond reply replies cookie cookies consent gdpr disclaimer footer foot menu menus nav navbar navigation newsletter notice notices alert popup modal promo promotion promoted related recommended recommendations share sharing social sidebar side sponsor sponsored subscribe subscription toolbar widget widgets pagination pager skip login signup search disqus paywall copyright hidden".split())
BAD_OUTSIDE = frozenset("header masthead banner".split())  # an article's own header stays
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
KEPT_BY_NAME = frozenset(["html", "body", "article", "main"])
# Words that say nothing beside those.
FILLERS = frozenset("a area bar block bottom box button buttons center container content full group holder inline inner item items label large left link links list main medium mini module outer panel placeholder post right row section site slot small sticky text title top unit wrap wrapper zone".split())


def _noise(name: str, content: bool) -> bool:
    """Whether a class or id name marks what isn't main text: by any of its words outside of the content, inside of it
    only if it says nothing else."""
    words = [w.rstrip("0123456789") or w for w in _WORDS.findall(name)]
    if not content:
        return not (BAD_WORDS | BAD_OUTSIDE).isdisjoint(words)
    return not BAD_WORDS.isdisjoint(words) and all(w in BAD_WORDS or w in FILLERS or w[0].isdigit() for w in words)


@lru_cache(maxsize=20_000)
def _marks(rest: str, content: bool) -> tuple[str, bool]:
    """The class and id words of a tag, and whether they mark what isn't main text."""
    if not rest or rest.isspace():
        return "", False
    names, bad = [], False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names.append(value)
            bad = bad or any(_noise(name, content) for name in value.split())
        elif key == "role":
            bad = bad or value.strip() in BAD_ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            bad = True
    return " ".join(names), bad


class Text(NamedTuple):
    """A text between tags: its block, element and path; whether it is in the content, or dropped."""

    block: int
    element: int
    path: str
    content: bool
    dropped: bool
    text: str


@dataclass
class Page:
    """A page's events in order: texts, and tags as (token, element open before, element open after)."""

    events: list = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])  # of each element; element 0 is around all
    names: list[str] = field(default_factory=lambda: [""])

    @property
    def texts(self) -> list[Text]:
        return [e for e in self.events if type(e) is Text]


def parse(page: str | None) -> Page:
    """The events of a page. A block is what block elements or their ends enclose; texts of one block belong together."""
    out = Page()
    events, parents, names_of = out.events, out.parents, out.names
    stack: list[tuple[str, bool, bool, str, int]] = []  # name, dropped so far, in content so far, path, element
    block, at, path, dropped, content, element = 0, 0, "", False, False, 0
    page = page or ""
    n = len(page)

    def pop(k: int) -> None:
        nonlocal path, dropped, content, element
        del stack[k:]
        _, dropped, content, path, element = stack[-1] if stack else ("", False, False, "", 0)

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at and not (text := page[at : m.start()]).isspace():
            events.append(Text(block, element, path, content, dropped, text))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, before = name.lower(), element
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if name not in BLOCKS and stack[k][0] in SCOPES:
                    break
            if name in BLOCKS:
                block += 1
            events.append((f"{path}/{name}", before, element))
            continue
        if name in BLOCKS:
            block += 1
        if name == "br":
            events.append(Text(block, element, path, content, dropped, " "))
        rest = m["rest"]
        names, bad = _marks(rest, content)
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        for k in range(len(stack) - 1, -1, -1) if name in CLOSES else ():
            if stack[k][0] in CLOSES[name]:
                pop(k)
                break
            if stack[k][0] in SCOPES:
                break
        token = f"{path}<{name} {names}"
        if name in VOID or rest == "/" or rest[-2:-1] in " \"'\n\t" and rest[-1:] == "/":
            events.append((token, before, element))
            continue
        if name in RAW:
            events.append((token, before, element))
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        content, dropped = content or name in CONTENT, dropped or name in DROPPED or name in DROPPED_OUTSIDE and not content or bad and name not in KEPT_BY_NAME
        path = f"{path}>{name}"
        parents.append(element)
        names_of.append(name)
        element = len(parents) - 1
        stack.append((name, dropped, content, path, element))
        events.append((token, before, element))
    if at < n and not (text := page[at:]).isspace():
        events.append(Text(block, element, path, content, dropped, text))
    return out


_hashes: dict[str, int] = {}


def _hash(token: str) -> int:
    found = _hashes.get(token)
    if found is None:
        if len(_hashes) > 100_000:
            _hashes.clear()
        found = _hashes[token] = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return found


@dataclass(frozen=True)
class Tokens:
    """A page's tokens: their hashes in order, the events they are of, and the words so far that aren't dropped."""

    hashes: np.ndarray
    event: np.ndarray
    upto: np.ndarray


def tokens(page: Page) -> Tokens:
    """Tags by name, class and path; words by path."""
    words: list[bytes] = []
    sizes, own, kept = [], [], []
    for e in page.events:
        if type(e) is Text:
            found = e.text.encode("utf-8", "surrogatepass").split()
            words += found
            sizes.append(len(found))
            own.append(_hash(e.path))
            kept.append(not e.dropped)
        else:
            sizes.append(1)
            own.append(_hash(e[0]))
            kept.append(False)
    size = np.array(sizes, np.int64)
    event = np.repeat(np.arange(len(size)), size)
    out = np.array(own, np.int64)[event] if len(size) else np.empty(0, np.int64)
    is_word = np.array([type(e) is Text for e in page.events], bool)[event] if len(size) else np.empty(0, bool)
    if words:
        mixed = out[is_word].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ shingle_hashes(words, 1)
        out[is_word] = mix64(mixed).view(np.int64)
    counted = is_word & (np.array(kept, bool)[event] if len(size) else is_word)
    return Tokens(out, event, np.cumsum(counted) - counted)


def _around(page: Page, elements: list[int]) -> int:
    """The innermost element around all of elements."""

    def chain(e: int) -> list[int]:
        found = [e]
        while e:
            e = page.parents[e]
            found.append(e)
        return found[::-1]

    same = chain(elements[0])
    for e in elements[1:]:
        other = chain(e)
        same = [a for a, b in zip(same, other, strict=False) if a == b]
    return same[-1]


def tags(page: Page) -> Tokens:
    """Those of tokens() that are tags."""
    event = [i for i, e in enumerate(page.events) if type(e) is not Text]
    return Tokens(np.array([_hash(page.events[i][0]) for i in event], np.int64), np.array(event, np.int64), np.empty(0, np.int64))


def content_element(page: Page, slots: list[tuple[int, ...]]) -> int | None:
    """The innermost element around a page's slots (token and its occurrence before, and after), or the article around
    it; None on a page without the slots. Words are looked at only where a slot isn't between two tags."""
    inside: list[int] = []
    found = tags(page)
    if not {h for first, _, last, _ in slots for h in (first, last)} <= set(found.hashes.tolist()):
        found = tokens(page)
    for first, i, last, j in slots:
        begin, end = np.flatnonzero(found.hashes == first), np.flatnonzero(found.hashes == last)
        if len(begin) <= i or len(end) <= j or end[j] < begin[i]:
            continue
        a, b = page.events[found.event[begin[i]]], page.events[found.event[end[j]]]
        inside += [a.element if type(a) is Text else a[2], b.element if type(b) is Text else b[1]]
    if not inside:
        return None
    e = _around(page, inside)
    at = e
    while at and page.names[at] not in CONTENT:
        at = page.parents[at]
    return at or e


@dataclass(frozen=True)
class Template:
    """A host's template: the hashes of its tokens, and its main slots (token and its occurrence before, and after)."""

    tokens: np.ndarray
    slots: list[tuple[int, ...]]


def main_text(html_text: str | None, template: Template | None = None) -> str:
    """The main text's blocks, joined by an empty line."""
    page = parse(html_text)
    whole = [e for e in page.events if type(e) is Text and not e.dropped]
    within = whole
    if template is not None:
        main = content_element(page, template.slots)
        if main:
            inside = [False] * len(page.parents)
            inside[main] = True
            for e in range(main + 1, len(inside)):
                inside[e] = inside[page.parents[e]]
            within = [t for t in whole if inside[t.element]]
            if not any(not t.text.isspace() for t in within):
                within = whole
    article = [t for t in within if t.content]
    if any(not t.text.isspace() for t in article):
        within = article
    elif template is not None:
        # without an article: blocks with a word of their own
        found = tokens(page)
        fixed = np.isin(found.hashes, template.tokens)
        mine = {page.events[e].block for e in np.unique(found.event[~fixed]) if type(page.events[e]) is Text}
        within = [t for t in within if t.block in mine]
    blocks: dict[int, list[str]] = {}
    for t in within:
        blocks.setdefault(t.block, []).append(t.text)
    joined = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def _host_of(url):
    rest = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    return F.lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0))


def different(rows: DataFrame) -> DataFrame:
    """host, html: equal pages of a host once. Only pages that have copies are shuffled, by digest."""
    marked = rows.withColumn("digest", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))
    often = small(stage(marked.groupBy("host", "digest").count().where("count > 1").select("host", "digest"), "copies"), 160)
    keys = ["host", "digest"]
    once = marked.join(often, keys, "left_semi").groupBy(*keys).agg(F.first("html").alias("html"))
    return marked.join(often, keys, "left_anti").select("host", "html").unionByName(once.select("host", "html"))


def displaced(places: list[tuple[int, int]], size: int) -> set[int]:
    """Of a class's (position, count so far) as a page has them, positions out of a longest run in order of all instances."""
    keys = [n * size + p for p, n in places]
    if all(a < b for a, b in zip(keys, keys[1:], strict=False)):
        return set()
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, key in enumerate(keys):
        at = bisect_left(tails, key)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [key], [i]
    kept, i = set(), ends[-1]
    while i >= 0:
        kept.add(i)
        i = before[i]
    return {p for i, (p, _) in enumerate(places) if i not in kept}


def disordered(tokens: list[int], classes: list[list[int]]) -> Counter:
    """(class, token's position, 0, 0) of tokens that are out of their class's order on a page."""
    where = {t: (c, p) for c, members in enumerate(classes) for p, t in enumerate(members)}
    seen: Counter = Counter()
    places: dict[int, list[tuple[int, int]]] = {}
    for t in tokens:
        if t in where:
            c, p = where[t]
            places.setdefault(c, []).append((p, seen[t]))
            seen[t] += 1
    return Counter((c, p, 0, 0) for c, found in places.items() for p in displaced(found, len(classes[c])))


INSIDE, ALL, ACROSS, OFTEN, WORDS, MOVED = range(6)


def nesting(tokens: list[int], classes: list[list[int]], upto: list[int] | None = None) -> Counter:
    """Instances of ordered classes on a page: (b, a, slot, INSIDE) b's that start in a slot of a, (b, b, 0, ALL) all of
    b's, (b, a, 0, ACROSS) b's that go on beyond the slot, (b, b, 0, OFTEN) pages with several b's, (b, b, slot, WORDS)
    words in the slots of b, where upto has the words before each token."""
    where = {t: (c, p) for c, members in enumerate(classes) for p, t in enumerate(members)}
    facts: Counter = Counter()
    opened: dict[int, int] = {}  # the slot that each open instance is in, outer ones first
    since: dict[int, int] = {}
    for at, t in enumerate(tokens):
        if t not in where:
            continue
        c, p = where[t]
        if p == 0:
            facts[c, c, 0, ALL] += 1
            facts.update((c, a, slot, INSIDE) for a, slot in opened.items())
        elif c in opened:
            inner = list(opened)
            facts.update((b, c, 0, ACROSS) for b in inner[inner.index(c) + 1 :])
            if upto is not None and upto[at] > since[c]:
                facts[c, c, opened[c], WORDS] += upto[at] - since[c]
        if upto is not None:
            since[c] = upto[at]
        if p == len(classes[c]) - 1:
            opened.pop(c, None)
        else:
            opened[c] = p
    for b in range(len(classes)):
        if facts[b, b, 0, ALL] > 1:
            facts[b, b, 0, OFTEN] = 1
    return +facts


def ordered_classes(classes: list[list[int]], facts: list, min_class: int) -> list[list[int]]:
    """The classes without the tokens that are out of order on some page."""
    out = {(c, p) for c, p, _, _, _ in facts}
    left = ([t for p, t in enumerate(members) if (c, p) not in out] for c, members in enumerate(classes))
    return [members for members in left if len(members) >= min_class]


def nested_classes(classes: list[list[int]], facts: list, min_class: int = 0) -> list[list[int]]:
    """The classes, by rank, that nest with all of those before them."""
    total = {b: n for b, _, _, kind, n in facts if kind == ALL}
    clash: dict[int, set[int]] = {}
    for b, a, _, kind, n in facts:
        if kind == ACROSS or kind == INSIDE and n < total[b]:
            clash.setdefault(a, set()).add(b)
            clash.setdefault(b, set()).add(a)
    kept: set[int] = set()
    for c in range(len(classes)):
        if kept.isdisjoint(clash.get(c, ())):
            kept.add(c)
    return [classes[c] for c in sorted(kept)]


def main_slots(classes: list[list[int]], kept: list[list[int]], facts: list, share: float) -> list[tuple[int, int]]:
    """(token before, token after) of the slots with the most words, of the first kept class that occurs once a page."""
    numbers = [classes.index(members) for members in kept]
    often = {b for b, _, _, kind, _ in facts if kind == OFTEN}
    root = next((c for c in numbers if c not in often and any(b == c and kind == WORDS for b, _, _, kind, _ in facts)), None)
    words = {slot: n for b, _, slot, kind, n in facts if b == root and kind == WORDS}
    return [(classes[root][s], classes[root][s + 1]) for s in sorted(words) if words[s] >= share * max(words.values())]


_FACT = "struct<b: int, a: int, slot: int, kind: int, n: bigint>"


def _with_host(rows: DataFrame, perhost: DataFrame, width, salts: int, how: str) -> DataFrame:
    """rows beside their host's row of perhost: broadcast if all of it is small, else by host and salt."""
    if (perhost.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(perhost), "host", how)
    salted = perhost.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c != "host")), F.lit(salts)).cast("int")
    return rows.withColumn("salt", salt).join(salted, ["host", "salt"], how).drop("salt")


#: A role is a token's number and, from 1, which of its occurrences it is; 0 stands for all of them.
_ROLE = 20


@dataclass(frozen=True)
class Held:
    """A host's classes, and what finds their tokens among a page's."""

    classes: list[list[int]]
    ids: np.ndarray
    split: frozenset[int]

    @classmethod
    def of(cls, classes: list[list[int]]) -> Held:
        codes = np.array([c for members in classes for c in members], np.int64)
        return cls(classes, np.unique(codes >> _ROLE), frozenset((codes[codes & (1 << _ROLE) - 1 > 0] >> _ROLE).tolist()))

    def roles(self, ids: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The roles of a page's tokens that the classes may hold, and their places among ids."""
        at = np.flatnonzero(np.isin(ids, self.ids))
        seen: Counter = Counter()
        out = []
        for i in ids[at].tolist():
            if i in self.split:
                seen[i] += 1
            out.append(i << _ROLE | seen[i])
        return out, at


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin and the last ones end."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _facts(cut: DataFrame, classes: DataFrame, seen, salts: int) -> DataFrame:
    """host, classes, facts: the sums over all pages of what seen(roles, classes, words before) counts on each."""
    width = F.aggregate("classes", F.lit(64), lambda s, x: s + 8 * F.size(x) + 16)
    paired = _with_host(cut.select("host", "ids", "upto"), classes, width, salts, "inner")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            facts: Counter = Counter()
            hosts: dict[str, Held] = {}
            (ids, at), (upto, _) = _lists(batch.column(1)), _lists(batch.column(2))
            for row, host in enumerate(batch.column(0).to_pylist()):
                held = hosts.get(host)
                if held is None:
                    held = hosts[host] = Held.of(batch.column(3)[row].as_py())
                page = slice(at[row], at[row + 1])
                own, places = held.roles(ids[page])
                for key, n in seen(own, held.classes, upto[page][places].tolist()).items():
                    facts[(host, *key)] += n
            keys = list(zip(*facts, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0], pa.string()), *(pa.array(k, pa.int32()) for k in keys[1:]), pa.array(list(facts.values()), pa.int64())],
                names=["host", "b", "a", "slot", "kind", "n"],
            )

    counted = paired.select("host", "ids", "upto", "classes").mapInArrow(count, "host string, b int, a int, slot int, kind int, n long")
    facts = counted.groupBy("host", "b", "a", "slot", "kind").agg(F.sum("n").alias("n"))
    facts = facts.groupBy("host").agg(F.collect_list(F.struct("b", "a", "slot", "kind", "n")).alias("facts"))
    return classes.join(facts, "host", "left").select("host", F.struct("classes", F.coalesce("facts", F.array().cast(f"array<{_FACT}>")).alias("facts")).alias("both"))


class HeavyHitters:
    """Counts of tokens, thinned: what is taken off all counts stays below `most` of the pages counted."""

    def __init__(self, most: float):
        self.most, self.pages, self.weight, self.lost, self.waiting = most, 0, 0, 0.0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, distinct: np.ndarray) -> None:
        self.pages += 1
        self.weight += len(distinct)
        self.parts.append((distinct, np.ones(len(distinct))))
        self.waiting += len(distinct)
        if self.waiting > 1 << 16:
            self.thin()

    def thin(self) -> None:
        keys, where = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([n for _, n in self.parts]))
        # so many counters that their least count stays below the bound
        size = int(self.weight / (self.most * self.pages)) + 1
        if len(counts) > size:
            off = min(np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1], self.most * self.pages - self.lost)
            self.lost += max(off, 0.0)
            counts = counts - max(off, 0.0)
            keys, counts = keys[counts > 1e-9], counts[counts > 1e-9]
        self.parts, self.waiting = [(keys, counts)], 0


def _candidates(rows: DataFrame, sizes: DataFrame, support: float) -> DataFrame:
    """host, known: sorted hashes of all tokens that may be in `support` of the host's pages. rows: host, html."""
    most = support / 2

    def count(batches):
        import pyarrow as pa

        hosts: dict[str, HeavyHitters] = {}

        def flush():
            for hitters in hosts.values():
                hitters.thin()
            found = [(h, *x.parts[0]) for h, x in hosts.items()]
            made = pa.RecordBatch.from_arrays(
                [pa.array([h for h, k, _ in found for _ in range(len(k))], pa.string()), pa.array(np.concatenate([k for _, k, _ in found]), pa.int64()), pa.array(np.concatenate([n for _, _, n in found]), pa.float64())],
                names=["host", "token", "n"],
            )
            hosts.clear()
            return made

        held = 0
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct = np.unique(tokens(parse(page)).hashes)
                if len(distinct):
                    hosts.setdefault(host, HeavyHitters(most)).add(distinct)
            held = sum(len(k) for x in hosts.values() for k, _ in x.parts)
            if held > 1 << 21:  # many hosts with few pages each
                yield flush()
        if hosts:
            yield flush()

    counted = rows.mapInArrow(count, "host string, token long, n double").groupBy("host", "token").agg(F.sum("n").alias("n"))
    enough = counted.join(sizes, "host").where(F.col("n") >= most * F.col("all") - 1e-6)
    return enough.groupBy("host").agg(F.array_sort(F.collect_list("token")).alias("known"))


def _cut(rows: DataFrame, known: DataFrame, salts: int) -> DataFrame:
    """host, mark (a page's hash), ids (places in known of the page's tokens, in order), upto (words before each)."""
    paired = _with_host(rows, known, F.size("known") * 8 + 64, salts, "inner")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            values, at = _lists(batch.column(2))
            marks, ids, upto, sizes = [], [], [], [0]
            for row, page in enumerate(batch.column(1).to_pylist()):
                found, own = tokens(parse(page)), values[at[row] : at[row + 1]]
                place = np.minimum(np.searchsorted(own, found.hashes), len(own) - 1)
                held = np.flatnonzero(own[place] == found.hashes)
                marks.append(_hash_page(page))
                ids.append(place[held].astype(np.int32))
                upto.append(found.upto[held].astype(np.int32))
                sizes.append(sizes[-1] + len(held))
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), lists(ids), lists(upto)], names=["host", "mark", "ids", "upto"])

    return paired.select("host", "html", "known").mapInArrow(cut, "host string, mark long, ids array<int>, upto array<int>")


def _hash_page(page: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((page or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _vectors(cut: DataFrame) -> DataFrame:
    """host, id (a role), pages, vector, place: in how many pages it is, its occurrence vector and its places' sum."""
    mask = np.uint64(0x7FFFFFFFFFFF)
    names = ["host", "id", "k", "pages", "vector", "once", "place", "lo", "hi"]

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            hosts: dict[str, list[np.ndarray]] = {}
            values, at = _lists(batch.column(2))
            for row, (host, mark) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids = values[at[row] : at[row + 1]].astype(np.int64)
                if not len(ids):
                    continue
                order = np.argsort(ids, kind="stable")
                own, first, times = np.unique(ids[order], return_index=True, return_counts=True)
                seen = np.uint64(mark & 0xFFFFFFFFFFFFFFFF)
                mix = lambda n: mix64(seen ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & mask  # noqa: E731, B023
                # a column per occurrence: id, which one, vector by count, vector of pages, place, count
                rows = np.stack([np.repeat(own, times), np.arange(len(order)) - np.repeat(first, times), np.repeat(mix(times), times).astype(np.int64), np.repeat(mix(np.ones(1)), len(order)).astype(np.int64), order, np.repeat(times, times)])
                hosts.setdefault(host, []).append(rows)
            columns: list[list] = [[] for _ in names]
            for host, parts in hosts.items():
                rows = np.concatenate(parts, axis=1)
                keys, where = np.unique(rows[0] << _ROLE | np.minimum(rows[1], (1 << _ROLE) - 2), return_inverse=True)
                sums = []
                for k in (2, 3, 4):
                    total = np.zeros(len(keys), np.uint64)
                    np.add.at(total, where, rows[k].astype(np.uint64))
                    sums.append((total & mask if k < 4 else total).astype(np.int64))
                lo, hi = np.full(len(keys), 1 << 60), np.zeros(len(keys), np.int64)
                np.minimum.at(lo, where, rows[5])
                np.maximum.at(hi, where, rows[5])
                for column, value in zip(columns, ([host] * len(keys), keys >> _ROLE, keys & (1 << _ROLE) - 1, np.bincount(where), *sums, lo, hi), strict=True):
                    column += value if isinstance(value, list) else value.tolist()
            kinds = (pa.string(), *[pa.int64()] * 8)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    partial = cut.select("host", "mark", "ids").mapInArrow(count, "host string, " + ", ".join(f"{n} long" for n in names[1:]))
    modulus = F.lit(1 << 47)
    sums = partial.groupBy("host", "id", "k").agg(F.sum("pages").alias("pages"), F.pmod(F.sum("vector"), modulus).alias("vector"), F.pmod(F.sum("once"), modulus).alias("once"), F.sum("place").alias("place"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # a token's occurrences on a page: as few rows as a page holds it times
    token = Window.partitionBy("host", "id")
    sums = sums.withColumn("even", F.min("lo").over(token) == F.max("hi").over(token)).where("even OR k = 0")
    role = F.shiftleft("id", _ROLE).bitwiseOR(F.when(F.col("even"), F.col("k") + 1).otherwise(F.lit(0).cast("long")))
    return sums.select("host", role.alias("id"), "pages", F.when(F.col("even"), F.col("once")).otherwise(F.col("vector")).alias("vector"), "place")


def template(pages: DataFrame, min_pages: int = 8, support: float = 0.5, min_class: int = 3, share: float = 0.1, salts: int = 16) -> DataFrame:
    """host, tokens (hashes of those whose roles are all in the host's nested classes), slots (its main ones: token and
    its occurrence before, and after), classes (roles, each in order)."""
    rows = different(pages.select(_host_of("url").alias("host"), F.col("html").alias("html")))
    sizes = stage(rows.groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= min_pages), "sizes")
    known = stage(_candidates(rows, sizes, support), "known")
    cut = stage(_cut(rows, known, salts), "cut")
    often = _vectors(cut).join(sizes, "host").where(F.col("pages") >= support * F.col("all"))
    # a class: one occurrence vector; if its tokens have one order on all pages, it's that of their places' sums
    classes = often.groupBy("host", "vector", "pages").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "id"))).alias("members")).where(F.col("n") >= min_class)
    ranked = classes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("p"), (-F.col("n")).alias("n"), "vector", F.col("members.id").alias("ids")))).alias("ranked"))
    found = stage(ranked.select("host", F.col("ranked.ids").alias("classes")), "classes")

    def checked(batch: list) -> list:
        """What is left of each host's classes, their tokens and main slots; whether the order of some was mended first."""
        out: list[list] = [[], [], [], []]
        for r in batch:
            facts = [tuple(f.values()) for f in r["facts"]]
            wrong = [f for f in facts if f[3] == MOVED]
            kept = ordered_classes(r["classes"], wrong, min_class) if wrong else nested_classes(r["classes"], facts, min_class)
            held = {c for members in kept for c in members}
            last: dict[int, int] = {}
            for c in held:
                last[c >> _ROLE] = max(last.get(c >> _ROLE, 0), c & (1 << _ROLE) - 1)
            out[0].append(kept)
            out[1].append(sorted(i for i, k in last.items() if not k or all(i << _ROLE | j in held for j in range(1, k + 1))))
            out[2].append([] if wrong else [[a, b] for a, b in main_slots(r["classes"], kept, facts, share)])
            out[3].append(bool(wrong))
        return out

    def both(own: list[int], held: list[list[int]], upto: list[int]) -> Counter:
        moved = Counter({(c, p, 0, MOVED): n for (c, p, _, _), n in disordered(own, held).items()})
        return moved + nesting(own, held, upto)

    fields = "classes array<array<long>>, tokens array<long>, slots array<array<long>>, mended boolean"
    found = stage(map_texts(_facts(cut, found, both, salts), checked, fields), "checked")
    # where the order was mended, nesting is checked for what is left
    again = stage(found.where("mended AND size(classes) > 0").select("host", "classes"), "mended")
    found = found.where("NOT mended")
    if not again.isEmpty():
        found = found.unionByName(map_texts(_facts(cut, again, nesting, salts), checked, fields))
    token = lambda i: F.element_at("known", (i + 1).cast("int"))
    number = lambda c: F.shiftright(c, _ROLE)
    which = lambda c: c.bitwiseAND(F.lit((1 << _ROLE) - 1)) - 1
    slots = F.transform("slots", lambda x: F.array(token(number(x[0])), which(x[0]), token(number(x[1])), which(x[1])))
    return stage(found.join(known, "host").select("host", "classes", F.transform("tokens", token).alias("tokens"), slots.alias("slots")), "nested")


def extracted(pages: DataFrame, salts: int = 16, **kwargs) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    templates = template(pages, salts=salts, **kwargs).select("host", "tokens", "slots")
    rows = pages.select("page_id", "url", "html", _host_of("url").alias("host"))
    rows = _with_host(rows, templates, F.size("tokens") * 8 + F.size("slots") * 32 + 64, salts, "left")

    def texts(batch: list) -> list:
        found = [main_text(r["html"], Template(np.array(r["tokens"], np.int64), [tuple(s) for s in r["slots"]]) if r["slots"] else None) for r in batch]
        return [found, [len(t) for t in found]]

    return map_texts(rows.select("page_id", "url", F.struct("html", "tokens", "slots").alias("page")), texts, "text string, n_chars long")

"""HTML extraction with wrappers inferred by aligning the token streams of a host.

A wrapper is a union-free regular expression over tags and texts: a list of items, each a tag, a constant
text, a slot `#` (a text that differs), a repeated group ("+", items) or an optional group ("?", items).  Every
task folds the pages of a host into one wrapper, partial wrappers are folded by host and salt, then by host, so
a host with a third of all pages is never in one task, and pages are not shuffled to be learnt from.

Texts that every page of a host has, under the same tags and in the same order, are aligned first and stay as
constants, also between repeated elements; what lies between two of them is folded and aligned by its tags, so
its texts are slots, alone or in repeated and optional groups.

The main text of a page is its texts that are no constants of the wrapper of its host.  Names are a hint beside
it: menus, forms, asides and the like are left out, and of what is left the texts in an article go before those
in a main element, a division named like one, and others.  Names alone decide where a host has fewer than three
pages of different text, or where the wrapper leaves nothing of a page.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SALTS, salted_join, slices

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "head", "html"}
# what is no main text: elements, roles, and words in class or id
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar "
    "navigation newsletter notice notices popup promo promotion related replies responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# dropped outside the main element only; and names that mark a main element, weaker than article and main themselves
OUTER_NAMES = frozenset("header masthead topbar".split())
# what may stand before and after such a word in one class or id, joined by - or _
PLACES = frozenset("bottom global left main page primary right secondary site the top".split())
PARTS = frozenset("area banner bar block box button buttons container content form items links list menu message module notice panel posts section widget wrap wrapper".split())
# elements that names do not drop: a heading, paragraph or item with such a name is left to the wrapper
UNNAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6 p li dt dd td th tr pre blockquote figcaption caption".split())
MAIN_NAMES = frozenset("article content entry main post story".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>|</[^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
#: Items of a wrapper from which its optional groups are left out.  They hold no constants and would be optional
#: again when met again, so the extraction does not depend on this number.
WRAPPER_ITEMS = 300
#: Pages of different text from which a host has constants.
LEAST_PAGES = 3


def _dropped(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """2 for what is no main text, 1 for what is none unless the main text of the page stands in it, else 0."""
    if tag in DROPPED:
        return 1 if tag == "form" else 2
    if not attributes:
        return 2 * (tag == "header" and not inside)
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return 2
    if tag == "header" and not inside:
        return 2
    if tag in ("html", "body"):
        return 0
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return 1 if attributes["role"].lower() == "form" else 2
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return 2
    if tag in UNNAMED:
        return 0
    tokens = (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split()
    return int(any(_means(t, DROPPED_NAMES) or not inside and _means(t, OUTER_NAMES) for t in tokens))


def _means(token: str, names: frozenset[str]) -> bool:
    """Whether a whole class or id is one of the names, alone or with words for its place and kind (site-header, related-posts)."""
    if token in names:
        return True
    words = re.split(r"[-_]+", token)
    while len(words) > 1 and words[0] in PLACES:
        words = words[1:]
    return words[0] in names and all(w in PARTS or w in names for w in words[1:])


def _names(attributes: dict[str, str]) -> list[str]:
    return re.split(r"[^a-z0-9]+", (attributes.get("class", "") + " " + attributes.get("id", "")).lower())


def _rank(tag: str, attributes: dict[str, str]) -> int:
    """3 for an article, 2 for a main element, 1 for a division named like one, else 0."""
    if not attributes:
        return 3 if tag == "article" else 2 * (tag == "main")
    role = attributes.get("role", "").lower()
    if tag == "article" or role == "article":
        return 3
    if tag == "main" or role == "main":
        return 2
    return int(tag in ("div", "section") and not MAIN_NAMES.isdisjoint(_names(attributes)))


def blocks(page: str) -> tuple[list[tuple[int, str]], list[str], list[int]]:
    """(rank of the main element around it, text) of every block that may be main text, the token stream, and the places of those blocks in it.

    The token of a text is a digest of the block tags around it and of the text.
    """
    every: list[tuple[int, str, int, tuple[int, ...]]] = []  # rank, text, place, elements around it that drop it unless the main text is in them
    stream: list[str] = []
    stack: list[tuple[str, bool, int, tuple[int, ...], str]] = []  # tag, whether it or one around it is dropped for good, rank, the elements as above, block tags down to it
    opened: Counter[str] = Counter()  # tags on the stack
    forms: set[int] = set()
    marks: list[tuple[int, tuple[int, ...]]] = []  # rank of every main element, the elements as above around it
    held: list[str] = []

    def flush() -> None:
        if not held:
            return
        text = "".join(held)
        held.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            around = stack[-1][4] if stack else ""
            stream.append("t" + hashlib.blake2b(f"{around} {text}".encode(), digest_size=8).hexdigest())
            if not stack or not stack[-1][1]:
                every.append((stack[-1][2] if stack else 0, text, len(stream) - 1, stack[-1][3] if stack else ()))

    def close(tag: str) -> None:
        while stack:
            gone = stack.pop()[0]
            opened[gone] -= 1
            if gone == tag:
                break

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        token = m.group()
        if token.startswith("<![CDATA["):
            continue
        name = _NAME.match(token)
        if name is None:
            continue
        tag = name.group(1).lower()
        if token[1] == "/":
            if opened[tag]:
                if tag in BLOCK:
                    flush()
                    stream.append("/" + tag)
                close(tag)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK or tag in DROPPED:
            flush()
        if tag in CLOSES_P and opened["p"]:
            close("p")
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            for t, *_ in reversed(stack):
                if t == tag or tag in ("dd", "dt") and t in ("dd", "dt"):
                    close(t)
                    break
                if t in ("ul", "ol", "dl", "table", "tr") and not (tag == "tr" and t == "tr"):
                    break
        rest = token[name.end() : -1]
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(rest)} if rest else {}
        if tag in BLOCK:
            stream.append(tag)
        if tag in VOID or token.endswith("/>") and tag not in BLOCK:
            continue
        _, above, rank, doubtful, around = stack[-1] if stack else ("", False, 0, (), "")
        verdict = _dropped(tag, attributes, rank > 0)
        dropped = above or verdict == 2
        if verdict == 1:
            doubtful = (*doubtful, at)
            if tag == "form" or attributes.get("role", "").lower() == "form":
                forms.add(at)
        own = _rank(tag, attributes)
        rank = max(rank, own)
        if own and not dropped and verdict == 0:
            marks.append((own, doubtful))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            continue
        if tag in BLOCK:
            around = f"{around}/{tag}" if around else tag
        stack.append((tag, dropped, rank, doubtful, around))
        opened[tag] += 1
    flush()
    # what stands around the main text does not drop it: forms always, named elements around a main element, and
    # those around an article where it holds more text than is left without it
    within = lambda lifted: [b for b in every if lifted.issuperset(b[3])]
    size = lambda some: sum(len(b[1]) for b in some)
    own, around = max(marks, key=lambda m: (-len(set(m[1]) - forms), m[0] > 1, -len(m[1]), m[0]), default=(0, ()))
    left = within(forms.intersection(around))
    if own > 1 and not forms.issuperset(around):
        more = within(set(around))
        left = more if own == 2 or size(more) > 2 * size(left) else left
    left = left or within(forms) or every
    return [b[:2] for b in left], stream, [b[2] for b in left]


def fold(stream: list) -> tuple:
    """A token stream with three or more equal neighbouring groups as one repeated group; texts inside it become slots."""
    items: list = []
    plain: list = []
    for token in stream:
        items.append(token)
        plain.append("#" if token[0] == "t" and len(token) == 17 else token)
        n, end = len(plain), plain[-1]
        for width in (1, 2, 3, 4, 5):
            if n <= width:
                break
            before = plain[-width - 1]
            if isinstance(before, tuple) and len(before[1]) == width and before[1] == tuple(plain[-width:]):
                del items[-width:], plain[-width:]
                break
            # most tokens are told by one comparison
            if before == end and n >= 3 * width:
                last = plain[-width:]
                if last == plain[-2 * width : -width] == plain[-3 * width : -2 * width] and last != ["#"]:
                    items[-3 * width :] = plain[-3 * width :] = [("+", tuple(last))]
                    break
    return tuple(items)


def _remembered(size: int):
    """Keep the last results: the wrapper of a host soon stays and its pages have few forms.  A plain function, so that it travels to tasks."""

    def wrap(step):
        known: dict = {}

        @wraps(step)
        def look_up(*args):
            found = known.get(args)
            if found is None:
                if len(known) >= size:
                    known.clear()
                found = known[args] = step(*args)
            return found

        return look_up

    return wrap


@_remembered(512)
def _folded(stream: tuple) -> tuple:
    return fold(stream)


@_remembered(512)
def align(a: tuple, b: tuple) -> tuple:
    """The wrapper of two wrappers: equal items stay, differing texts become slots, what only one has becomes optional."""
    if a == b:
        return a
    x, y = [_bare(i) for i in a], [_bare(i) for i in b]
    out: list = []
    grown = False
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if kind == "equal":
            for p, q in zip(a[i1:i2], b[j1:j2], strict=True):
                out.append(p if p == q else _optional(p, q))
        else:
            for item in (*a[i1:i2], None, *b[j1:j2]):
                if item is None or isinstance(item, tuple) and item[0] == "?":
                    out += [item] if item else []
                    grown = False
                elif grown:
                    out[-1] = ("?", (*out[-1][1], item))
                else:
                    out.append(("?", (item,)))
                    grown = True
            grown = False
    return tuple(out) if len(out) <= WRAPPER_ITEMS else tuple(i for i in out if isinstance(i, str) or i[0] != "?")


def _bare(item):
    """What an item is matched by: all texts and slots are one kind, optional groups match by their plain content."""
    if isinstance(item, str):
        return "#" if item == "#" or item[0] == "t" and len(item) == 17 else item
    return _bare_group(item)


@_remembered(4096)
def _bare_group(item: tuple) -> tuple:
    return (item[0], tuple(_bare(i) for i in item[1]))


def _optional(p, q):
    if isinstance(p, str):
        return "#"
    return (p[0], align(p[1], q[1]))


def _is_text(item) -> bool:
    return isinstance(item, str) and item[0] == "t" and len(item) == 17


def numbered(items) -> list[tuple[int, tuple[str, int]]]:
    """(place, (text, how many equal ones come before it)) of the constant texts of a wrapper or the texts of a stream."""
    seen: Counter[str] = Counter()
    found = []
    for place, item in enumerate(items):
        if _is_text(item):
            found.append((place, (item, seen[item])))
            seen[item] += 1
    return found


def common(a, b) -> list[tuple[int, int]]:
    """Places in both of the longest run of texts that both have in the same order; the n-th of equal texts meets the n-th."""
    there = {key: place for place, key in numbered(b)}
    pairs = [(place, there[key]) for place, key in numbered(a) if key in there]
    ends: list[int] = []  # smallest last place in b of a run of each length
    last: list[int] = []  # the pair it belongs to
    before: list[int] = []
    for n, (_, place) in enumerate(pairs):
        k = bisect_left(ends, place)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [place], [n]
    n, run = last[-1] if last else -1, []
    while n >= 0:
        run.append(pairs[n])
        n = before[n]
    return run[::-1]


def _between(items) -> tuple:
    """What stands between two constants: texts as slots, folded; neighbouring equal groups become one."""
    plain: list = []
    for item in items:
        item = "#" if _is_text(item) else item
        if not (plain and isinstance(item, tuple) and item[0] == "+" and plain[-1] == item):
            plain.append(item)
    return _folded(tuple(plain))


def unite(a: tuple, b: tuple) -> tuple:
    """The wrapper of two wrappers or streams: texts that both have in order stay, what lies between is folded and aligned."""
    if a == b:
        return a
    out: list = []
    i = j = 0
    for p, q in [*common(a, b), (len(a), len(b))]:
        out += align(_between(a[i:p]), _between(b[j:q]))
        out += a[p : p + 1]
        i, j = p + 1, q + 1
    return tuple(out)


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, pages, wrapper binary) of every host; null or odd addresses share the host ''.

    `pages` is the number of pages of different text, LEAST_PAGES at most; pages that are alike in all blocks that may
    be main text count once, pages without any are not learnt from.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host")
    schema = "host string, pages long, wrapper binary"
    partials = "host string, own array<string>, wrapper binary"

    def learn(batches):
        known: dict[str, tuple[list[str], tuple]] = {}
        for part in slices(batches, "html"):
            for own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found, stream, _ = blocks(text or "")
                if not found:
                    continue
                mark = hashlib.blake2b("\n".join(t for _, t in found).encode(), digest_size=16).hexdigest()
                marks, wrapper = known.get(own, ([], None))
                known[own] = (sorted({*marks, mark})[:LEAST_PAGES], tuple(stream) if wrapper is None else unite(wrapper, tuple(stream)))
        yield _rows([(h, m, w) for h, (m, w) in known.items()])

    def merge(rows: pa.Table) -> pa.Table:
        marks, wrapper = set(), None
        for own, packed in sorted(zip(rows.column("own").to_pylist(), rows.column("wrapper").to_pylist(), strict=True)):
            marks, wrapper = marks.union(own), pickle.loads(packed) if wrapper is None else unite(wrapper, pickle.loads(packed))
        return pa.Table.from_batches([_rows([(rows.column("host")[0].as_py(), sorted(marks)[:LEAST_PAGES], wrapper)])])

    partial = pages.select(host, F.col(html).alias("html")).mapInArrow(learn, partials)
    salted = partial.withColumn("_salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "_salt").applyInArrow(merge, partials)
    return salted.groupBy("host").applyInArrow(merge, partials).select("host", F.size("own").cast("long").alias("pages"), "wrapper")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([h for h, _, _ in found], pa.string()), pa.array([m for _, m, _ in found], pa.list_(pa.string())), pa.array([pickle.dumps(w) for _, _, w in found], pa.binary())],
        ["host", "own", "wrapper"],
    )


def main_text(page: str, wrapper: tuple | None) -> tuple[str, str]:
    """(main text, what decided it): "wrapper" where it left texts out that names would have kept, "both" where they agree, else "names"."""
    found, stream, places = blocks(page)
    same = {q for _, q in common(wrapper, stream)} if wrapper else set()
    kept = [block for block, place in zip(found, places, strict=True) if place not in same]
    lines = lambda some: [t for rank, t in some if rank == max(r for r, _ in some)]
    own, named = lines(kept), lines(found)
    return "\n".join(own or named), "names" if not wrapper or not own else "both" if own == named else "wrapper"


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) of every page, through the wrapper of its host.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by \\n in
    page order.  A null or empty page gives an empty text.  Repeated rows are pages of their own; other columns
    are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    fixed = infer(pages, url, html).where(F.col("pages") >= LEAST_PAGES).select("host", "wrapper")
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def run(batches):
        for part in slices(batches, "_html"):
            known: dict[bytes, tuple] = {}
            texts = []
            for page, packed in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if packed is not None and packed not in known:
                    known[packed] = tuple(i for i in pickle.loads(packed) if _is_text(i))
                texts.append(main_text(page or "", known.get(packed))[0])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], [key, url, "text"])

    rows = salted_join(pages.select(F.col(key), F.col(url), F.col(html).alias("_html"), host.alias("host")), fixed, ["host"], key, "left")
    return rows.select(key, url, "_html", "wrapper").mapInArrow(run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string")

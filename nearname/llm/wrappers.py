"""Main text of pages by wrappers that are inferred per host.

A page becomes a row of tokens: tags with their class or id, and text slots. Neighbouring
repeats are folded into groups, which leaves few distinct rows per host; these are counted
first, and then aligned in rounds until one expression per host matches all of them. What only
one side has becomes optional, what one side repeats becomes a repeated group, and text is a
slot, so the expression is free of unions. Slots are then judged once per host: by the elements
around them, and by the expression, whose repeated groups of links alone are menus wherever they
stand outside article and main. Every page is read through its host's wrapper, by the layout that
it has itself. Outside article and main, text that is the same on all pages of a host belongs to
its template.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.session import reliable_checkpoint

GROUP = 64  # rows aligned in one task and round
FEWEST = 3  # different pages of a host that make a constant text its template's

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
TO_END = frozenset("script style textarea title".split())  # raw text, to the end of the page if nothing ends it
RAW = TO_END | frozenset("template noscript iframe select object svg".split())
SELF_CLOSED = frozenset("object svg".split())
CHROME = frozenset("nav header footer aside form button head script style template noscript textarea title iframe select object svg dialog label fieldset".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal "
    "nav navbar navigation newsletter notice notices popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
WEAK_WORDS = frozenset("notice notices promo related reply replies respond share sharing social widget".split())  # also said of articles
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
COMPOUND_WORDS = frozenset(
    "ad ads advert adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header menu nav navbar navigation newsletter "
    "popup sidebar sponsor sponsored".split()
)
HAVING = frozenset("has no not with without hide show is".split())
LINK = "a"
MAIN_WORDS = frozenset(["article", "main"])
UNJUDGED = frozenset(["html", "body", "main", "article"])  # marks on these speak of the whole page
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
MARKS = frozenset(["class", "id", "role"])
CUT = re.compile(r"</?[a-zA-Z]|</?\Z")  # a tag that the page ends in
SPACES = re.compile(r"\s+")


def raw_ends(page: str, name: str) -> dict[int, int]:
    """Where the contents of each element of this name begin, and where its end tag ends. Those
    of raw text end at the first end tag, the others are nested."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", page, re.IGNORECASE):
        if not m[1]:
            if not (name in SELF_CLOSED and m[2].endswith("/")):
                opened.append(m.end())
        elif opened:
            if name in TO_END or name == "iframe":
                ends |= dict.fromkeys(opened, m.end())
                opened = []
            else:
                ends[opened.pop()] = m.end()
    return ends


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value) in page order: open or link (name, marks), close (name), text ("", raw)."""
    at = 0
    ends: dict[str, dict[int, int]] = {}
    while m := TOKEN.search(page, at):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[2] is None and m[5] is None:
            continue
        name = (m[2] or m[5]).lower()
        if m[1] or m[4]:
            yield "close", name, ""
        elif name in RAW:
            if name not in ends:
                ends[name] = raw_ends(page, name)
            at = ends[name].get(at, len(page) if name in TO_END else at)
        else:
            given = ATTRIBUTE.findall(m[3] or m[6] or "")
            marks = [x.strip("\"'") for key, x in given if key.lower() in MARKS]
            link = name == "a" and any(key.lower() == "href" for key, _ in given)
            yield "link" if link else "open", name, " ".join(marks).lower()
    if at < len(page) and not CUT.match(page, at):
        yield "text", "", page[at:]


def walk(page: str) -> Iterator[tuple[str, str, str]]:
    """As ``events``, with (path, block, raw) for text: elements that HTML closes on its own are
    closed, and stray ends are left out. ``block`` events mark where a block ends or begins."""
    stack: list[tuple[str, str]] = []
    for kind, name, value in events(page):
        if kind == "text":
            yield "text", "/".join(s for _, s in stack if s), value
            continue
        if kind == "link":
            if any(n == "a" for n, _ in stack):  # a link ends where the next begins
                del stack[next(i for i, (n, _) in enumerate(stack) if n == "a") :]
            stack.append((name, LINK))
            yield "link", LINK, ""
        elif kind == "open":
            shut = CLOSES.get(name, frozenset()) | ({"p"} if name in BLOCK_ENDS_P else frozenset())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
            if name not in VOID:
                sign = "" if name in INLINE else name + "".join("." + w for w in sorted({re.sub(r"[^a-z0-9_-]+", "_", w) for w in value.split()}))
                stack.append((name, sign))
                if name not in INLINE:
                    yield "open", sign, ""
            elif name != "wbr":
                yield "void", name, ""
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if at >= 0:
                if stack[at][1] == LINK:
                    yield "unlink", LINK, ""
                del stack[at:]
            if name not in INLINE:
                yield "close", name, ""


def _numbered(tokens: list) -> np.ndarray:
    """Equal tokens as equal numbers."""
    known: dict = {}
    return np.array([known.setdefault(t, len(known)) for t in tokens], dtype="int64")


def _repeats(codes: np.ndarray, size: int) -> bool:
    """Whether any ``size`` tokens are followed by the same ones."""
    same = np.r_[0, np.cumsum(codes[:-size] == codes[size:])]
    return bool((same[size:] - same[:-size] == size).any())


def fold(tokens: list) -> list:
    """Neighbouring repeats of up to 12 tokens as one group ``("+", tokens)``."""
    size = 1
    codes = _numbered(tokens)
    while size <= min(12, len(tokens)):
        if not _repeats(codes, size):
            size += 1
            continue
        out, i, changed = [], 0, False
        while i < len(tokens):
            body, n = tokens[i : i + size], 1
            if len(body) == size and not (size == 1 and isinstance(body[0], tuple)):
                while tokens[i + n * size : i + (n + 1) * size] == body:
                    n += 1
            elif size == 1:
                while i + n < len(tokens) and tokens[i + n] == body[0]:
                    n += 1
                out.append(body[0])
                changed, i = changed or n > 1, i + n
                continue
            if n > 1:
                out.append(("+", tuple(body)))
                i, changed = i + n * size, True
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
        if changed:
            codes = _numbered(tokens)
        size = 1 if changed and size > 1 else size + 1
    return tokens


def skeleton(page: str) -> tuple:
    """Folded structure of a page; text is a slot named by its path."""
    out: list = []
    for kind, name, value in walk(page):
        if kind == "text":
            slot = "#" + name
            if not value.isspace() and (not out or out[-1] != slot):
                out.append(slot)
        elif kind in ("open", "link"):
            out.append("<" + name)
        elif kind in ("close", "unlink"):
            out.append("/" + name)
    return tuple(fold(out))


def bodies(tokens: tuple) -> set[tuple]:
    found = set()
    for t in tokens:
        if isinstance(t, tuple):
            found |= bodies(t[1]) | ({t[1]} if t[0] == "+" else set())
    return found


def grouped(tokens: tuple, repeated: list[tuple]) -> list:
    """Tokens in which single occurrences of ``repeated`` bodies stand as groups too."""
    tokens = [(t[0], tuple(grouped(t[1], [b for b in repeated if b != t[1]]))) if isinstance(t, tuple) else t for t in tokens]
    for body in repeated:
        i, size = 0, len(body)
        while i + size <= len(tokens):
            if tuple(tokens[i : i + size]) == body:
                tokens[i : i + size] = [("+", body)]
            i += 1
    return fold(tokens)


def align(a: tuple, b: tuple) -> tuple:
    """One union-free expression for both: equal parts stay, the others become optional."""
    if a == b:
        return a
    repeated = sorted(bodies(a) | bodies(b), key=lambda x: (-len(x), repr(x)))
    a, b = grouped(a, repeated), grouped(b, repeated)
    bare = lambda seq: [x for t in seq for x in ([("?", (y,)) for y in t[1]] if isinstance(t, tuple) and t[0] == "?" else [t])]
    a, b = bare(a), bare(b)
    key = lambda t: t[1][0] if isinstance(t, tuple) and t[0] == "?" else t
    out: list = []
    for what, i, j, k, n in SequenceMatcher(None, [key(t) for t in a], [key(t) for t in b], autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:n]):
                out.append(x if x == y else ("?", (key(x),)))
        else:
            for t in [*a[i:j], *b[k:n]]:
                out.append(("?", (key(t),)))
    joined: list = []
    for t in out:  # neighbouring optionals of one text are one
        if joined and t == joined[-1]:
            continue
        joined.append(t)
    return tuple(joined)


def show(tokens: tuple) -> str:
    """The expression as JSON: a token is a string, a group its sign and its tokens."""
    return json.dumps(tokens, separators=(",", ":"))


def parse(text: str) -> tuple:
    """Inverse of ``show``."""
    whole = lambda x: x if isinstance(x, str) else tuple(map(whole, x))
    return whole(json.loads(text))


def slots(tokens: tuple) -> list[str]:
    found: dict[str, None] = {}
    for t in tokens:
        if isinstance(t, tuple):
            found |= dict.fromkeys(slots(t[1]))
        elif t.startswith("#"):
            found[t[1:]] = None
    return list(found)


def menus(tokens: tuple) -> set[str]:
    """Slots of repeated groups that hold links and no other text."""
    found: set[str] = set()
    for t in tokens:
        if isinstance(t, tuple):
            inner = slots(t[1])
            if t[0] == "+" and inner and all(LINK in path.split("/") for path in inner):
                found |= set(inner)
            else:
                found |= menus(t[1])
    return found


def _steps(path: str) -> list[list[str]]:
    return [step.split(".") for step in path.split("/")]


def _marked(step: list[str]) -> bool:
    """Whether an element's marks speak of something beside the article: one of its whole words,
    or the first or last part of a word joined by hyphens, as in ``main-nav``; ``with-nav`` is
    about what the element has. Weak words count for less than those of an article."""
    if step[0] in UNJUDGED:
        return False
    words = set(step[1:])
    for word in step[1:]:
        parts = re.split("[-_]+", word)
        if len(parts) > 1 and parts[0] not in HAVING:
            words |= COMPOUND_WORDS & {parts[0], parts[-1]}
    return bool(words & CHROME_WORDS) and not (words & CONTENT_WORDS and words & CHROME_WORDS <= WEAK_WORDS)


@lru_cache(65_536)
def _judged(path: str) -> tuple[bool, bool, bool]:
    """(lies in an element that holds no article, lies in a marked one, lies in article or main)"""
    steps = _steps(path)
    return any(s[0] in CHROME for s in steps), any(map(_marked, steps)), any(not MAIN_WORDS.isdisjoint(s) for s in steps)


class Layout(NamedTuple):
    """Slots of a wrapper in which an article may stand, the likeliest first: inside article or
    main, elsewhere without menus and marked elements, and the same two with them."""

    inside: frozenset[str]
    clean: frozenset[str]
    marked_inside: frozenset[str]
    marked: frozenset[str]


def main_slots(paths: list[str], lists: set[str] | frozenset[str] = frozenset()) -> Layout:
    plain = [(p, *_judged(p)[1:]) for p in paths if not _judged(p)[0]]
    return Layout(
        frozenset(p for p, marked, inside in plain if inside and not marked),
        frozenset(p for p, marked, inside in plain if not marked and (inside or p not in lists)),
        frozenset(p for p, _, inside in plain if inside),
        frozenset(p for p, _, _ in plain),
    )


def pieces(page: str) -> list[tuple[str | None, str]]:
    """(path, text) in page order, and (None, " ") where a block ends or begins."""
    out: list[tuple[str | None, str]] = []
    held: list[str] = []
    at: str | None = None
    for kind, name, value in [*walk(page), ("end", "", "")]:
        if held and (kind != "text" or name != at):
            out.append((at, "".join(held)))
            held = []
        if kind == "text":
            at = name
            held.append(entities.unescape(value))
        elif kind not in ("link", "unlink"):
            out.append((None, " "))
    return out


def key_of(*words: str) -> int:
    return int.from_bytes(blake2b("\0".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def blocks(found: list[tuple[str | None, str]], wanted: frozenset[str]) -> list[tuple[str, str]]:
    """(path, text) of the blocks of a page in ``wanted`` slots: links are part of the block they
    stand in, and blocks of white space are none."""
    out: list[tuple[str, str]] = []
    held: list[tuple[str, str]] = []
    for path, text in [*found, (None, "")]:
        if path is None:
            whole = SPACES.sub(" ", "".join(t for _, t in held)).strip()
            if whole:
                out.append(("/".join(step for step in held[0][0].split("/") if step != LINK), whole))
            held = []
        elif path in wanted:
            held.append((path, text))
    return out


def by_layout(found: list[tuple[str | None, str]], layout: Layout) -> frozenset[str]:
    """The first set of slots in which the page has text, so that no mark empties a page."""
    filled = {path for path, text in found if path is not None and not text.isspace()}
    return next((s for s in layout if not filled.isdisjoint(s)), layout.clean)


def main_text(found: list[tuple[str | None, str]], layout: Layout, constant: frozenset[int] = frozenset()) -> str:
    """White space as one blank, blocks joined by one. A page is read by its own layout: inside
    article or main where it has text there, otherwise all that is clean without the ``constant``
    blocks. A page of which all blocks are constant is a copy, not a template, and stays whole."""
    wanted = by_layout(found, layout)
    kept = blocks(found, wanted)
    if constant and wanted is layout.clean:
        kept = [x for x in kept if key_of(*x) not in constant] or kept
    return " ".join(text for _, text in kept)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"host": b["host"], "wrapper": [show(skeleton(h or "")) for h in b["html"]]})


def _align_all(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values(["pages", "wrapper"], ascending=[False, True])
    merged = parse(rows["wrapper"].iloc[0])
    for text in rows["wrapper"].iloc[1:]:
        merged = align(merged, parse(text))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [show(merged)], "pages": [rows["pages"].sum()]})


def infer_wrappers(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """(host, wrapper, pages): one expression per host that all its pages follow.

    Distinct folded rows are aligned GROUP at a time, so a host with very many pages is spread
    over tasks; each round leaves one row per group until there is one per host.
    """
    tall = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(_skeletons, "host string, wrapper string")
    rows = reliable_checkpoint(tall.groupBy("host", "wrapper").agg(F.count("*").alias("pages")))
    while True:
        sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
        if sizes.where("n > 1").isEmpty():
            return rows
        dealt = rows.join(sizes, "host").withColumn("piece", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / group)))
        rows = reliable_checkpoint(dealt.groupBy("host", "piece").applyInPandas(lambda g: _align_all(g), "host string, wrapper string, pages long"))


def _block_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out: set[tuple[str, int, int, int]] = set()
        for host, page in zip(b["host"], b["html"]):
            found = pieces(page or "")
            layout = main_slots(list({path for path, _ in found if path is not None}))
            if by_layout(found, layout) is layout.clean:
                number = key_of(page or "")
                for path, text in blocks(found, layout.clean):
                    slot = key_of(path)
                    out |= {(host, slot, slot, number), (host, slot, key_of(path, text), number)}
        yield pd.DataFrame(list(out), columns=["host", "slot", "block", "page"])


def constant_blocks(pages: DataFrame) -> DataFrame:
    """(host, constant): keys of the blocks that every page of a host with text in their slot has,
    where these are FEWEST different pages or more. Pages read inside article or main, and pages
    without a host, take no part. A host's keys are no more than its slots' blocks on one page."""
    tall = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    seen = tall.mapInPandas(_block_keys, "host string, slot long, block long, page long").distinct()
    met = reliable_checkpoint(seen.groupBy("host", "slot", "block").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST))
    totals = met.where("slot = block").select("host", "slot", "n")
    return met.where("slot <> block").join(totals, ["host", "slot", "n"]).groupBy("host").agg(F.collect_set("block").alias("constant"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, host) of every page.

    Null html counts as empty and gives empty text; pages without a host in their url share one
    wrapper. A page is read whole; repeated rows are read once each.
    """
    wrappers = reliable_checkpoint(infer_wrappers(pages).select("host", "wrapper").join(constant_blocks(pages), "host", "left"))
    placed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    met = placed.join(wrappers, "host")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[Layout, frozenset[int]]] = {}
        for b in batches:
            texts = []
            for host, page, wrapper, constant in zip(b["host"], b["html"], b["wrapper"], b["constant"]):
                if host not in known:
                    tokens = parse(wrapper)
                    known[host] = (main_slots(slots(tokens), menus(tokens)), frozenset(() if constant is None else constant))
                texts.append(main_text(pieces(page or ""), *known[host]))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts], "host": b["host"]})

    return met.mapInPandas(read, "page_id long, url string, text string, n_chars long, host string")

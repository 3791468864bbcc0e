"""HTML extraction by deduction of templates from equivalence classes of tokens.

Pages of one host are taken in groups. A page is a sequence of tokens: tags, told apart by
their enclosing element and their class and id (an end tag by its start tag), and text.

1. Tokens of block elements whose numbers of occurrences agree on every page of a group form an
   equivalence class (pages that lack what nine in ten have, such as cut ones, don't vote). A
   class is valid if its tokens come in one order, over and over, on all pages; of one that isn't,
   the start and end tags of each element are tried as classes of their own. Valid classes nest:
   of two whose spans cross, the one on fewer pages is split so too, or goes. The class of tokens
   found once a page is the template; the others lie in its gaps or in each other's.
2. The gaps of the template are its slots. The slot with most words over all pages, of texts that
   differ between pages, stand outside links and outside side elements (navigation, page headers,
   footers, sidebars, forms and the like, by tag, role or class), holds the article. On a page the
   article's region is the smallest element around more than half of that slot's words, and then
   the elements around it, as long as they add no text of a slot that is constant or mostly links,
   or to the side. ``article``, ``main`` and role=main break ties: growth ends at such an element,
   and inside one goes up to it. A page whose slot is empty takes the element that is the region
   on most pages.
3. Inside the region, an element of a class whose text is the same wherever it occurs, on half of
   the group's pages and on ``PROOF`` (three outside article and main) that differ in their own
   text, is the template's own; the rest is data. Data outside side elements is the article. Text
   that stands bare beside varying text there stays.

A page that doesn't hold its group's template is a group by itself. Groups are cut to ``PAGES`` pages, the
last two of a host evenly; hosts with more pages, and more than 1/1024 of all, are dealt over
several tasks (at most 1024 such hosts exist, so their list has a fixed bound). White space inside
a block becomes one space, blocks are joined by one space, character references are decoded. Null
or empty pages give the empty text, and so do pages without an article. Pages are read whole;
broken or cut markup is taken as it stands. Repeated rows give equal texts; an empty table gives
no rows; extra columns are left out.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_rows, texts_of

#: Pages of a group; hosts beyond 1 / HEAVY of all pages are dealt out.
PAGES, HEAVY = 64, 1024
#: Pages, different in their own text, that must agree on an element below main for it to be the template's.
PROOF = 8

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(/?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg math object canvas select".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SIDE = frozenset("nav footer aside form menu dialog button fieldset head".split()) | RAW
MAIN = frozenset(("article", "main"))
SIDE_NAMES = re.compile(r"(?<![a-z])(?:ads?|adverts?|advertis\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side-?bar|aside|footer|site-?header|page-?header|masthead|cookies?|consent|notice\w*|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|comments?|comment-?\w*|respond|replies|reply|disqus|pagination|pager|toolbar|skip|search|copyright|legal-?notice)(?![a-z])", re.I)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


class Tag:
    __slots__ = ("at", "name", "side", "main", "token", "open")

    def __init__(self, at, name, opens, token, side, main):
        self.at, self.name, self.open, self.token, self.side, self.main = at, name, opens, token, side, main


def tokens(page: str) -> list:
    """Tags, and texts as (is_text, decoded) pairs, in page order; raw elements hold no text."""
    out: list = []
    at, stack, own = 0, [], []
    size = len(page)

    def text(part: str) -> None:
        if part:
            out.append(html.unescape(part))

    while at < size:
        m = MARKUP.search(page, at)
        if not m:
            tail = page[at:]
            cut = tail.rfind("<")
            # A tag that the end of the page cuts off is markup, not text.
            text(tail[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]|<\Z|</\Z", tail[cut:]) and ">" not in tail[cut:] else tail)
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        attrs = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(m[3])} if m[3] and not closing else {}
        label = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        role = attrs.get("role", "").lower()
        parent = stack[-1] if stack else ""
        if closing:
            token = f"</{name}>"
            if name in stack:
                while stack.pop() != name:
                    own.pop()
                token = "/" + own.pop()
            out.append(Tag(len(out), name, False, token, False, False))
            continue
        side = name in SIDE or role in SIDE_ROLES or bool(label and name not in ("html", "body") and name not in MAIN and SIDE_NAMES.search(label))
        side = side or "hidden" in re.split(r"[\s=]+", m[3].lower())
        token = f"<{name} {label} {role}> in {parent}"
        out.append(Tag(len(out), name, True, token, side, name in MAIN or role == "main"))
        if name in RAW and not m[4]:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            out.append(Tag(len(out), name, False, "/" + token, False, False))
        elif name not in VOID and not m[4]:
            stack.append(name)
            own.append(token)
    return out


def in_order(order: list[list[str]]) -> list[str]:
    """Tokens found once a page, without those that break the order of the first page.

    Page by page the longest run of tokens in the same order on both stays.
    """
    first = order[0]
    for other in order[1:]:
        if other == first:
            continue
        rank = {t: i for i, t in enumerate(other)}
        tops: list[int] = []  # by length of a run, the least rank of its last token
        length = []
        for t in first:
            k = bisect.bisect_left(tops, rank[t])
            tops[k : k + 1] = [rank[t]]
            length.append(k)
        keep, want, limit = [], len(tops) - 1, len(other)
        for t, k in zip(reversed(first), reversed(length), strict=True):
            if k == want and rank[t] < limit:
                keep.append(t)
                want, limit = want - 1, rank[t]
        first = keep[::-1]
    return first


def voters(pages: list[list]) -> list[list]:
    """The pages that hold, once, all block tags that nine in ten of the pages hold once."""
    once = [{t for t, n in Counter(x.token for x in page if isinstance(x, Tag) and x.name in BLOCK).items() if n == 1} for page in pages]
    known = Counter(t for x in once for t in x)
    most = {t for t, n in known.items() if 10 * n >= 9 * len(pages)}
    return [p for p, x in zip(pages, once, strict=True) if most <= x]


def deduce(pages: list[list]) -> list[list[str]]:
    """The valid classes, each its tokens in order, that nest; the template (which may be empty) first."""
    names = [[x.token for x in page if isinstance(x, Tag) and x.name in BLOCK and x.name not in VOID] for page in pages]
    counts: dict[str, list[int]] = defaultdict(lambda: [0] * len(pages))
    for i, page in enumerate(names):
        for t in page:
            counts[t][i] += 1
    classes: dict[tuple, list[str]] = defaultdict(list)
    for token, n in counts.items():
        classes[tuple(n)].append(token)
    one = (1,) * len(pages)
    root = in_order([[t for t in page if counts[t] == list(one)] for page in names]) if one in classes else []
    left = set(classes.pop(one, ())) - set(root)

    places: dict[str, list[list[int]]] = {t: [[] for _ in pages] for t in counts}
    for i, page in enumerate(names):
        for j, t in enumerate(page):
            places[t][i].append(j)

    def valid(order: list[str]) -> bool:
        for i in range(len(pages)):
            turns = list(zip(*(places[t][i] for t in order), strict=True))
            flat = [j for turn in turns for j in turn]
            if any(a > b for a, b in zip(flat, flat[1:])):
                return False
        return True

    def pairs(some) -> list[list[str]]:
        every = set(some)
        return [x for t in some if "/" + t in every and valid(x := [t, "/" + t])]

    found = pairs(sorted(left))
    for vector, some in classes.items():
        at = next(i for i, n in enumerate(vector) if n)
        order = sorted(some, key=lambda t: places[t][at][0])
        found += ([order] if len(order) > 1 else []) if valid(order) else pairs(order)
    while True:
        # On most pages first, then in most places.
        found.sort(key=lambda c: (-sum(n > 0 for n in counts[c[0]]), -sum(counts[c[0]]), c))
        where = {t: (c, k) for c, order in enumerate([root, *found]) for k, t in enumerate(order)}
        crossed: set[int] = set()
        for page in names:
            stack: list[int] = []
            for t in page:
                c, k = where.get(t, (0, 0))
                if not c:
                    # Tokens of the template end what is open: such spans cross one of its gaps.
                    if t in where and stack:
                        crossed.update(stack)
                        stack = []
                    continue
                if k == 0:
                    stack.append(c)
                    continue
                while stack and stack[-1] != c and c in stack:
                    crossed.add(max(c, stack.pop()))
                if stack and stack[-1] == c and k == len(found[c - 1]) - 1:
                    stack.pop()
        if not crossed:
            return [root, *found]
        # What crosses others may nest by single elements.
        parts = [x for c in crossed if len(found[c - 1]) > 2 for x in pairs(found[c - 1])]
        found = [x for c, x in enumerate(found, 1) if c not in crossed] + [x for x in parts if x not in found]


def slots(page: list, classes: list[list[str]]) -> tuple[list[int], list[tuple], list[tuple]]:
    """Per token the template's gap that holds it; its slot: the innermost class around it, the gap there, the
    occurrence; and the elements around it, of which a class has the start and the end tag, with their occurrences."""
    where = {t: (c, k) for c, order in enumerate(classes) for k, t in enumerate(order)}
    ends = {"/" + t: t for t in where if where.get("/" + t, (-1,))[0] == where[t][0]}
    starts = set(ends.values())
    turns: Counter = Counter()
    gap, stack, around = 0, [], ()
    gaps, own, paths = [], [], []
    for x in page:
        if isinstance(x, Tag) and x.token in where:
            c, k = where[x.token]
            if c == 0:
                gap = k + 1
            else:
                turns[c] += k == 0
                if k:
                    stack.pop()
                if k < len(classes[c]) - 1:
                    stack.append((c, k, turns[c]))
            if x.token in starts:
                turns[x.token] += 1
                around += ((x.token, turns[x.token]),)
            elif x.token in ends:
                around = tuple(e for e in around if e[0] != ends[x.token])
        gaps.append(gap)
        own.append(stack[-1] if stack else (0, gap, 0))
        paths.append(around)
    return gaps, own, paths


def _walk(page: list) -> tuple[list[bool], list[bool], list[bool]]:
    """Per token: whether it lies in a side element, in a main element, in a link."""
    side, main, link = [], [], []
    stack: list[Tag] = []
    n_side = n_main = n_link = 0
    for x in page:
        if isinstance(x, Tag) and x.open and x.name not in VOID:
            in_main = n_main > 0
            own_side = x.side or x.name == "header" and not in_main
            if x.name in RAW:
                own_side = True
            x.side = own_side
            stack.append(x)
            n_side += own_side
            n_main += x.main
            n_link += x.name == "a"
        elif isinstance(x, Tag) and not x.open and any(t.name == x.name for t in reversed(stack)):
            while True:
                t = stack.pop()
                n_side -= t.side
                n_main -= t.main
                n_link -= t.name == "a"
                if t.name == x.name:
                    break
        side.append(n_side > 0)
        main.append(n_main > 0)
        link.append(n_link > 0)
    return side, main, link


def blocks(page: list, chosen: list[bool]) -> str:
    """Texts of chosen tokens: white space inside a block is one space, blocks are joined by one."""
    done, now = [], []
    for x, take in zip(page, chosen, strict=True):
        if isinstance(x, Tag):
            if x.name in BLOCK:
                done.append("".join(now))
                now = []
        elif take:
            now.append(x)
    done.append("".join(now))
    return " ".join(y for x in done if (y := " ".join(x.split())))


class Nest:
    """Elements of a page: by token the innermost one around it, by element its parent and its end."""

    def __init__(self, page: list) -> None:
        self.up: list[int] = []
        self.end: dict[int, int] = {}
        stack: list[int] = []
        for i, x in enumerate(page):
            if isinstance(x, Tag) and not x.open and any(page[k].name == x.name for k in stack):
                while True:
                    k = stack.pop()
                    self.end[k] = i
                    if page[k].name == x.name:
                        break
            self.up.append(stack[-1] if stack else -1)
            if isinstance(x, Tag) and x.open and x.name not in VOID:
                stack.append(i)
        self.end.update((k, len(page)) for k in stack)

    def around(self, i: int) -> list[int]:
        """The elements around a token, inner ones first."""
        out = []
        while (i := self.up[i]) >= 0:
            out.append(i)
        return out


def article_slot(pages: list[list], size: int, gaps: list[list[int]], walks: list[tuple]) -> tuple[int, list[bool]] | None:
    """Which of the template's ``size`` gaps holds the article, and which are the template's own or mostly links."""
    words, links = [0] * size, [0] * size
    said: list[set[str]] = [set() for _ in range(size)]
    for page, at, (side, _, link) in zip(pages, gaps, walks, strict=True):
        parts: list[list[str]] = [[] for _ in range(size)]
        for i, g in enumerate(at):
            if not isinstance(page[i], Tag) and not side[i] and (n := len(page[i].split())):
                (links if link[i] else words)[g] += n
                parts[g].append(page[i])
        for g, x in enumerate(parts):
            said[g].add(" ".join("".join(x).split()))
    constant = [len(pages) >= 3 and len(x) == 1 and x != {""} for x in said]
    core = max(range(size), key=lambda g: (not constant[g] and words[g] > 0, words[g]))
    return (core, [c or b > a for c, a, b in zip(constant, words, links, strict=True)]) if words[core] else None


def region(page: list, nest: Nest, gaps: list[int], walk: tuple, core: int, other: list[bool]) -> int | None:
    """The element (index of its start tag, -1: the whole page) that is the page's article; None if its slot is empty."""
    side, _, link = walk
    held: Counter = Counter()
    total = 0
    for i, x in enumerate(page):
        if not isinstance(x, Tag) and gaps[i] == core and not side[i] and not link[i] and (n := len(x.split())):
            total += n
            for k in nest.around(i):
                held[k] += n
    if not total:
        return None
    at = max((k for k, n in held.items() if 2 * n > total), default=-1)  # the last start tag is the innermost
    if at < 0:
        return -1
    mains = [k for k in (at, *nest.around(at)) if page[k].main and not side[k]]
    if mains:
        return mains[0]
    while at >= 0:
        up = nest.up[at]
        more = [*range(max(up, 0), at), *range(nest.end[at], nest.end[up] if up >= 0 else len(page))]
        if any(not isinstance(page[i], Tag) and page[i].strip() and (side[i] or other[gaps[i]]) for i in more):
            break
        at = up
    return at


def extract(group: list[str]) -> list[str]:
    """Main texts of the pages of one group of one host."""
    pages = [tokens(p) for p in group]
    walks = [_walk(p) for p in pages]
    full = [p for p in pages if p]
    vote = voters(full)
    classes = deduce(vote) if vote else [[]]
    known = [slots(p, classes) for p in pages]
    nests = [Nest(p) for p in pages]
    voting = {id(p) for p in vote}
    heard = [i for i, p in enumerate(pages) if id(p) in voting]
    own = article_slot([pages[i] for i in heard], len(classes[0]) + 1, [known[i][0] for i in heard], [walks[i] for i in heard]) if vote else None
    found = []
    for p, walk, nest, (gaps, _, _) in zip(pages, walks, nests, known, strict=True):
        slot = own
        if p and not set(classes[0]) <= {x.token for x in p if isinstance(x, Tag)}:
            root = deduce([p])[0]
            gaps = slots(p, [root])[0]
            slot = article_slot([p], len(root) + 1, [gaps], [walk])
        found.append(region(p, nest, gaps, walk, *slot) if p and slot else None)
    usual = Counter(p[k].token for p, k in zip(pages, found, strict=True) if k is not None and k >= 0).most_common(1)
    taken, places, least = [], [], []
    for p, walk, nest, k, (_, slot, paths) in zip(pages, walks, nests, found, known, strict=True):
        if k is None and usual:
            k = next((i for i, x in enumerate(p) if isinstance(x, Tag) and x.token == usual[0][0]), None)
        within = range(0) if k is None else range(k + 1, nest.end[k]) if k >= 0 else range(len(p))
        of_main = k is not None and k >= 0 and p[k].main
        taken.append([i for i in within if not isinstance(p[i], Tag) and not walk[0][i]])
        places.append(paths if of_main else [(*path, (o[:2], o[2])) for o, path in zip(slot, paths, strict=True)])
        least.append(PROOF if of_main else 3)
    # What a page says itself: its longest text that at most half of the pages have. Copies count once.
    said = [{" ".join(p[i].split()) for i in few} for p, few in zip(pages, taken, strict=True)]
    known = Counter(t for x in said for t in x)
    self = [max((t for t in x if 2 * known[t] <= len(full)), key=lambda t: (len(t), t), default="") for x in said]
    held: dict[object, set[str]] = defaultdict(set)
    on: dict[object, list[int]] = defaultdict(list)
    for j, (p, few, around) in enumerate(zip(pages, taken, places, strict=True)):
        texts: dict[tuple, list[str]] = defaultdict(list)
        for i in few:
            for place in around[i]:
                texts[place].append(p[i])
        for (name, _), parts in texts.items():
            if t := " ".join("".join(parts).split()):
                held[name].add(t)
                on[name].append(j)
    proof = {k: len({self[j] for j in on[k]}) for k, v in held.items() if len(v) == 1 and 2 * len(set(on[k])) >= len(full)}
    out = []
    for p, few, around, need in zip(pages, taken, places, least, strict=True):
        chosen = [False] * len(p)
        for i in few:
            chosen[i] = not any(proof.get(name, 0) >= need for name, _ in around[i])
        out.append(blocks(p, chosen))
    return out


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def articles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    rows = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`").alias("html"), host(url_col).alias("_host"))
    kind = rows.schema[id_col].dataType.simpleString()
    by_host = rows.groupBy("_host").agg(F.count("*").alias("n"))
    n = rows.count()
    heavy = by_host.where((F.col("n") * HEAVY > F.lit(n)) & (F.col("n") > PAGES)).collect()  # fewer than HEAVY rows
    parts = {r["_host"]: min(-(-r["n"] * HEAVY // n), -(-r["n"] // PAGES)) for r in heavy}
    salt = F.lit(0)
    if parts:
        known = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
        salt = F.pmod(F.xxhash64(id_col, F.length("html")), F.coalesce(F.try_element_at(known, F.col("_host")), F.lit(1)))
    rows = rows.withColumn("_salt", salt.cast("int"))
    rows = rows.repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", id_col)

    def run(batches):
        held, own = [], None

        def done(part):
            texts = extract([h for _, _, h in part])
            return {id_col: [x for x, _, _ in part], url_col: [u for _, u, _ in part], "text": texts, "n_chars": [len(t) for t in texts]}

        def rest():
            # Two even groups rather than a full one and a page or two.
            cut = len(held) if len(held) <= PAGES else -(-len(held) // 2)
            yield done(held[:cut])
            if held[cut:]:
                yield done(held[cut:])

        for b in batches:
            for i, u, h, where in zip(b[id_col].to_pylist(), b[url_col].to_pylist(), texts_of(b["html"]), zip(b["_host"].to_pylist(), b["_salt"].to_pylist(), strict=True), strict=True):
                if held and where != own:
                    yield from rest()
                    held = []
                elif len(held) == 2 * PAGES:
                    yield done(held[:PAGES])
                    held = held[PAGES:]
                own = where
                held.append((i, u, h))
        if held:
            yield from rest()

    return map_rows(rows, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint", run)

"""Main text of web pages by wrappers inferred for each host.

A page is read as a stream of block tags and texts, closed where HTML leaves tags open. Streams of all pages of a host are aligned into a
union-free regular expression, in groups of bounded size whose expressions are aligned in turn: siblings that repeat become repeated groups, mismatches become optional groups, and texts
that differ become slots; texts that all pages with a slot share stay its constants, beside the others of a repeated group too. A page's
texts are then read through its host's wrapper, inside and outside the article alike: constants are left out, and so are slots of menus,
headers, footers, forms, adverts and the like. An <article> or <main> is the article's region unless most of what varies lies outside it.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches
from .url_filter import host_of

#: About so many expressions are aligned in one group; a host with more has more levels of groups.
FANOUT = 128
#: Wrappers up to this sum of characters are broadcast; more are joined by host.
BROADCAST_CHARS = 32 << 20
#: Texts of elements nested deeper than this count for their ancestor at that depth.
DEPTH = 100
#: A constant counts as boilerplate, and a slot as one that varies, if so many pages have it.
CONSTANT_PAGES = 3
#: Articles of a host with more constant characters than so many times those that vary are copies of each other.
COPIES = 4
#: Rows of siblings are aligned by their longest common subsequence up to so many comparisons, longer ones in time linear but for a logarithm.
CELLS = 1 << 16
#: Tags that may be the article's region.
ARTICLE = ("article", "main")

# Fixed values of HTML: tags that part blocks, tags whose text is no article, raw text, and void tags.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
NEVER = set("aside button canvas datalist dialog footer form head header iframe label menu nav noscript object option script select style svg template textarea title video audio".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Words of class, id and role that tell what is no article, each a whole word or its first part: `ad` and `ad-slot`, not `social-history`'s last.
NOISE = re.compile(r"(?:^|\s)(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|contentinfo|cookies?|disqus|footer|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|replies|sidebar|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: Words that also name what an article may be about: they count outside <article> and <main> only; inside, the wrapper decides.
WEAK = re.compile(r"(?:^|\s)(?:complementary|dialog|form|related|search|share|sharing|social)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}


class Node:
    """An element of a page: a label (tag and what its class says, numbers aside), whether its text counts, and elements and texts in order."""

    __slots__ = ("label", "good", "items")

    def __init__(self, label: str, good: bool):
        self.label, self.good, self.items = label, good, []


def tree(page: str) -> Node:
    """The block elements of a page, with the texts between their tags, decoded and with white space squashed."""
    root = Node("", True)
    stack, held, at = [root], [], 0

    def flush():
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text and (len(stack) <= DEPTH or stack[-1].good):
                stack[min(len(stack) - 1, DEPTH)].items.append(text)

    def close(k):
        flush()
        del stack[k:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        shut, tag, attributes = m[1], m[2], m[3]
        if tag:
            tag = tag.lower()
            if tag in RAW and not attributes.endswith("/"):
                end = ENDS[tag].search(page, at)
                at = end.start() if end else len(page)
                continue
            noise = [" ".join(filter(None, x)) for x in NAMED.findall(attributes)]
            loud = any(map(NOISE.search, noise)) or (any(map(WEAK.search, noise)) and not any(n.label.partition(".")[0] in ARTICLE for n in stack))
            own = tag in BLOCK or tag in NEVER or (tag not in VOID and loud)
            if tag == "br":
                held.append(" ")
            elif tag in VOID:
                if tag in BLOCK:
                    flush()
            elif own:
                flush()
                if tag in BLOCK and stack[-1].label.partition(".")[0] == "p":
                    close(len(stack) - 1)
                for k in range(len(stack) - 1, 0, -1):
                    name = stack[k].label.partition(".")[0]
                    if name in CLOSED_BY.get(tag, ()):
                        close(k)
                        break
                    if name in ("ul", "ol", "table", "dl", "select", "html"):
                        break
                node = Node(f"{tag}.{DIGITS.sub('0', ' '.join(noise))}" if noise else tag, stack[-1].good and tag not in NEVER and not loud)
                if len(stack) <= DEPTH:
                    stack[-1].items.append(node)
                stack.append(node)
        elif shut:
            shut = shut.lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].label.partition(".")[0] == shut:
                    close(k)
                    break
    flush()
    return root


# A wrapper is [label, good, optional, repeated, items]; a text slot is ["#", constants, pages that have it, optional, repeated, characters].
# Constants are the texts that all those pages have there, by digest, with their characters; characters are of pages that have an article.


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _label(item) -> str:
    return "#" if isinstance(item, str) else item.label if isinstance(item, Node) else item[0]


def wrapper_of(node: Node, article: bool | None = None) -> list:
    """The expression of one page: runs of siblings of one label are folded into a repeated group. Elements that are never read stay empty."""
    items = []
    article = _holds(node, ARTICLE) if article is None else article
    for x in node.items if node.good else ():
        new = ["#", {_digest(x): len(x)}, 1, False, False, len(x) if article else 0] if isinstance(x, str) else wrapper_of(x, article)
        if items and items[-1][0] == new[0]:
            items[-1] = _merged(items[-1], new, same_page=True)
            items[-1][_repeated(items[-1])] = True
        else:
            items.append(new)
    return [node.label, node.good, False, False, items]


def _optional(x: list) -> int:
    return 3 if x[0] == "#" else 2


def _repeated(x: list) -> int:
    return 4 if x[0] == "#" else 3


def _common(la: list[str], lb: list[str]) -> list[tuple[int, int]]:
    """A common subsequence of two rows of labels, the longest one wherever that takes no more than CELLS comparisons.

    Longer rows match the k-th element of a label with the k-th of the other row, and the longest chain of such matches in both orders is taken.
    """
    both = set(la) & set(lb)  # labels that only one row has are in no common subsequence
    ia, ib = ([i for i, x in enumerate(row) if x in both] for row in (la, lb))
    if len(ia) * len(ib) > CELLS:
        place: dict[str, list[int]] = {}
        for j in ib:
            place.setdefault(lb[j], []).append(j)
        seen: dict[str, int] = {}
        pairs = []
        for i in ia:
            k = seen[la[i]] = seen.get(la[i], -1) + 1
            if k < len(place[la[i]]):
                pairs.append((i, place[la[i]][k]))
        return _rising(pairs)
    best = [[0] * (len(ib) + 1) for _ in range(len(ia) + 1)]
    for i in range(len(ia) - 1, -1, -1):
        for j in range(len(ib) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if la[ia[i]] == lb[ib[j]] else max(best[i + 1][j], best[i][j + 1])
    matched, i, j = [], 0, 0
    while i < len(ia) and j < len(ib):
        if la[ia[i]] == lb[ib[j]]:
            matched.append((ia[i], ib[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return matched


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, whose first parts rise, in which the second parts rise too."""
    ends: list[int] = []  # the least last place of chains of each length, as numbers of pairs
    lows: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(lows, j)
        before[n] = ends[k - 1] if k else -1
        if k == len(lows):
            lows.append(j)
            ends.append(n)
        else:
            lows[k], ends[k] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _pairs(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """An alignment of two rows of items by a common subsequence of their labels."""
    la, lb = [_label(x) for x in a], [_label(x) for x in b]
    if la == lb:
        return [(i, i) for i in range(len(la))]
    # What both begin and end with is matched at once.
    n, m = len(la), len(lb)
    head = next((i for i in range(min(n, m)) if la[i] != lb[i]), min(n, m))
    tail = next((i for i in range(min(n, m) - head) if la[n - 1 - i] != lb[m - 1 - i]), min(n, m) - head)
    inner = _common(la[head : n - tail], lb[head : m - tail])
    matched = [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in inner] + [(n - tail + i, m - tail + i) for i in range(tail)]
    out, i, j = [], 0, 0
    for x, y in [*matched, (n, m)]:
        out += [(k, None) for k in range(i, x)] + [(None, k) for k in range(j, y)] + [(x, y)]
        i, j = x + 1, y + 1
    return out[:-1]


def _merged(a: list, b: list, same_page: bool = False) -> list:
    """One expression for both: what only one has becomes optional, what repeats in one repeats, texts that differ are no constants."""
    if a[0] == "#":
        if same_page:
            a[1].update(b[1])  # the page's own
        texts = a[1] if same_page else {k: n for k, n in a[1].items() if k in b[1]}
        return ["#", texts, a[2] if same_page else a[2] + b[2], a[3] or b[3], a[4] or b[4], a[5] + b[5]]
    items = []
    for i, j in _pairs(a[4], b[4]):
        x = a[4][i] if j is None else b[4][j] if i is None else _merged(a[4][i], b[4][j], same_page)
        if i is None or j is None:
            x = [*x]
            x[_optional(x)] = True
        items.append(x)
    return [a[0], a[1] and b[1], a[2] or b[2], a[3] or b[3], items]


def _holds(node: Node, names: tuple[str, ...]) -> bool:
    return any(not isinstance(x, str) and x.good and (x.label.partition(".")[0] in names or _holds(x, names)) for x in node.items)


def _region(w: list, inside: bool = False) -> tuple[int, int, int]:
    """Characters of a host's texts: those that vary in articles, constants in articles, and those that vary outside them."""
    inner = fixed = outer = 0
    inside = inside or w[0].partition(".")[0] in ARTICLE
    for x in w[4]:
        if x[0] != "#":
            i, f, o = _region(x, inside)
            inner, fixed, outer = inner + i, fixed + f, outer + o
            continue
        same = min(x[5], x[2] * sum(x[1].values())) if x[2] >= CONSTANT_PAGES else 0
        if inside:
            inner, fixed = inner + x[5] - same, fixed + same
        elif x[2] >= CONSTANT_PAGES:
            outer += x[5] - same
    return inner, fixed, outer


def _seen(w: list) -> list:
    """A wrapper without slots of fewer pages than CONSTANT_PAGES, which decide nothing, and elements that hold nothing else."""
    items = [x if x[0] == "#" else _seen(x) for x in w[4]]
    return [*w[:4], [x for x in items if (x[2] >= CONSTANT_PAGES if x[0] == "#" else x[4])]]


def closed(w: list) -> tuple[list, bool, bool]:
    """A host's wrapper, whether <article> or <main> is the region, and whether constants in it are boilerplate.

    Where nearly all of the articles' text is constant (COPIES), pages are copies of each other, which tells nothing about boilerplate.
    """
    inner, fixed, outer = _region(w)
    return _seen(w), outer <= inner + fixed, fixed <= COPIES * inner


def read(node: Node, wrapper: tuple[list, bool, bool] | None) -> list[str]:
    """The texts of a page's article, block by block, through the wrapper of its host; None reads it by tags alone."""
    whole, tagged, strip = wrapper or (None, False, False)
    article = tagged and _holds(node, ARTICLE)
    out: list[str] = []

    def walk(n: Node, w: list | None, inside: bool):
        if not n.good:
            return
        inside = inside or n.label.partition(".")[0] in ARTICLE
        # Runs of one label are one group of the wrapper.
        runs: list[list] = []
        for x in n.items:
            if runs and _label(runs[-1][0]) == _label(x):
                runs[-1].append(x)
            else:
                runs.append([x])
        slot = {j: w[4][i] for i, j in _pairs(w[4], [r[0] for r in runs]) if i is not None and j is not None} if w else {}
        for j, run in enumerate(runs):
            mine = slot.get(j)
            for x in run:
                if not isinstance(x, str):
                    walk(x, mine, inside)
                elif inside or not article:
                    fixed = mine and mine[1] and mine[2] >= CONSTANT_PAGES and (strip or not inside) and _digest(x) in mine[1]
                    if not fixed:
                        out.append(x)

    walk(node, whole, False)
    return out


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _wrap(batches):
    for batch in batches:
        own = [_json(wrapper_of(tree(p.as_py()))) for p in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], ["host", "wrapper"])


def _folded(last: bool):
    """Aligns rows (host, bucket, wrapper), sorted by host and bucket, into one for each bucket; the last time, wrappers are closed."""

    def fold(batches):
        at, held = None, None
        for batch in batches:
            out = []
            for host, bucket, w in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at == (host, bucket):
                    held = _merged(held, json.loads(w))
                    continue
                if at is not None:
                    out.append((*at, _json(closed(held) if last else held)))
                at, held = (host, bucket), json.loads(w)
            yield rows(out)
        if at is not None:
            yield rows([(*at, _json(closed(held) if last else held))])

    def rows(out):
        kinds = (pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["host", "bucket", "wrapper"])

    return fold


def wrappers_of(pages: DataFrame) -> DataFrame:
    """host and its wrapper from all of its pages (host, html). Pages whose expression is the same are one page.

    Groups are told by the hash of a page's expression, so neither partitions nor the order of rows matter, and hosts of many pages are split.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    own = scratch.table(pages.filter("html IS NOT NULL").select("host", "html").mapInArrow(_wrap, "host string, wrapper string").distinct())
    most, levels = own.groupBy("host").count().agg(F.max("count")).first()[0] or 0, 0
    while FANOUT ** (levels + 1) < most:
        levels += 1
    held = own.withColumn("bucket", F.xxhash64("wrapper"))
    for level in range(levels, -1, -1):
        held = held.withColumn("order", F.col("bucket")).withColumn("bucket", F.pmod("bucket", F.lit(FANOUT**level).cast("long")))
        held = held.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "order", "wrapper").select("host", "bucket", "wrapper")
        held = held.mapInArrow(_folded(level == 0), "host string, bucket long, wrapper string")
    return scratch.table(held.select("host", "wrapper"))


def _extract(batches):
    known: dict[str, tuple] = {}
    for batch in batches:
        pages, wrappers = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("html", "wrapper"))
        texts = []
        for p, w in zip(pages, wrappers, strict=True):
            if w is not None and w not in known:
                if len(known) >= 256:
                    known.clear()
                known[w] = json.loads(w)
            texts.append("\n\n".join(read(tree(p or ""), known.get(w))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html; other columns are ignored): page_id, url, text, n_chars (code points).

    Blocks are in page order and parted by two line breaks; white space inside a block is one space; character references are decoded.
    Null or empty html has an empty text. Rows without a host share one wrapper. Rows that tie are read alike; no rows give no rows.
    """
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    wrappers = wrappers_of(pages)
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    held = pages.join(F.broadcast(wrappers) if size <= BROADCAST_CHARS else wrappers, "host", "left")
    out = held.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))

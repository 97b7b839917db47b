"""HTML main text by differencing pages with their nearest URLs.

A page becomes lines: one for each block, with the part of the page it stands in. Pages of a host are in order of URL
path, so neighbours are nearest by path. That order is cut into parts of some pages for the tasks; pages beyond a cut that pages
before it may be compared with stand in both, so cuts don't show in the result.
Each page is aligned by longest common subsequence of lines with the nearest page before and after it that has other
lines, and lines that it shares with both are template text and deleted. Copies and quoted passages share article
lines too, so a line that the markup places in the article stays; lines in parts marked as something else always go.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from listingloom.llm.common import forget, written

#: Parts of a page.
PLAIN, ARTICLE, OTHER = 0, 1, 2
#: Pages between two cuts at least, and parts at most: their cuts are known to every task.
GROUP_PAGES, MOST_PARTS = 256, 2048
#: Runs of equal pages looked back and ahead for one that differs.
REACH = 3
#: HTML elements that never have content, that never show any, and whose ends break a line (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "select", "title")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements that hold something other than the article, wherever they stand.
AWAY = frozenset("nav aside footer form button menu dialog search head".split())
#: Words of class, id and role values that mark such parts, and those that mark the article.
AWAY_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget alert contentinfo "
    "complementary dialog search".split()
)
ARTICLE_WORDS = frozenset("articlebody entry-content post-content article-content article-body post-body story-body main-content".split())
#: Words that may stand beside those in a name without changing its meaning.
NEUTRAL = frozenset(
    "site page top bottom left right list lists item items box bar wrap wrapper container inner outer block area section sections links link icon icons "
    "button buttons primary secondary global header mobile form text count panel row col column content main small large wide slot unit zone "
    "reader readers user users thread threads gdpr privacy legal inline native sticky floating".split()
)
#: Of the hidden elements, those whose content is raw text: without an end tag they reach to the end of the page.
RAW = ("script", "style", "textarea", "title")
_ATTRIBUTES = r"(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*"
_DROP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?:svg|math)" + _ATTRIBUTES + r"(?<=/)>"
    + r"|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(" + "|".join(h for h in HIDDEN if h not in RAW) + r")(?=[\s/>])[^>]*>.*?</\2\s*>", re.S | re.I
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
#: An open element of these ends when a new one of the set begins in the same parent (fixed by HTML).
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}


@lru_cache(maxsize=4096)
def _is_away(name: str) -> bool:
    """Whether a class or id name is of AWAY_WORDS, alone or beside words that mean nothing here (not ``social-science``)."""
    words = [w for w in re.split(r"[-_]+|\d+x\d+|\d+", name) if w]
    return any(w in AWAY_WORDS for w in words) and all(w in AWAY_WORDS or w in NEUTRAL for w in words)


def _part(tag: str, attributes: str, part: int) -> int:
    """The part of the page that an element's content is in, given its parent's."""
    if part == OTHER or tag in AWAY or (tag == "header" and part != ARTICLE):
        return OTHER
    words: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return OTHER
        if name in ("class", "id", "role", "itemprop"):
            words.update(value.split())
    if words & ARTICLE_WORDS or "main" in words and tag != "body":
        return ARTICLE
    if tag not in ("body", "html") and any(map(_is_away, words)):
        return OTHER
    return ARTICLE if tag in ("article", "main") else part


def page_lines(source: str) -> list[tuple[int, str]]:
    """(part, text) of the non-empty blocks of a page, in order; white space within a block is one space."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    part = PLAIN

    def end_line() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((part, text))

    source = _DROP.sub(" ", source)
    at = 0
    for m in _TAG.finditer(source):
        held.append(source[at : m.start()])
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag == "br":
            held.append(" ")
        if tag in BLOCKS:
            end_line()
        if tag in VOID or (m[3].endswith("/") and tag not in BLOCKS):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if part != stack[k][1]:
                        end_line()
                    part = stack[k][1]
                    del stack[k:]
                    break
        else:
            if tag in BLOCKS and tag not in _SIBLINGS and stack and stack[-1][0] == "p":
                part = stack.pop()[1]
            if stack and stack[-1][0] in _SIBLINGS.get(tag, ()):
                part = stack.pop()[1]
            new = _part(tag, m[3], part)
            if new != part:
                end_line()
            stack.append((tag, part))
            part = new
    held.append(source[at:])
    end_line()
    return out


def _lcs_row(a: list, masks: dict, width: int) -> int:
    """Bit-parallel LCS of ``a`` with the sequence of ``masks``: zero bits are where its length grows."""
    v = full = (1 << width) - 1
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def shared_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by divide and conquer in linear space."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    out = {*range(lo), *range(len(a) - hi, len(a))}
    known = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    left = [i for i in range(lo, len(a) - hi) if a[i] in known]
    rest = [x for x in b[lo : len(b) - hi] if x in known]
    work = [(left, rest)]
    while work:
        x, y = work.pop()
        if not x or not y:
            continue
        if len(x) == 1:
            if a[x[0]] in y:
                out.add(x[0])
            continue
        mid = len(x) // 2
        ahead, behind = _prefix_lengths([a[i] for i in x[:mid]], y), _prefix_lengths([a[i] for i in reversed(x[mid:])], y[::-1])
        cut = max(range(len(y) + 1), key=lambda k: ahead[k] + behind[len(y) - k])
        work += [(x[:mid], y[:cut]), (x[mid:], y[cut:])]
    return out


def _prefix_lengths(a: list, b: list) -> list[int]:
    """LCS length of ``a`` with every prefix of ``b``."""
    masks: dict = {}
    for k, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << k
    v, out = _lcs_row(a, masks, len(b)), [0]
    bits = bin(v)[2:].zfill(len(b))[::-1] if b else ""
    for bit in bits:
        out.append(out[-1] + (bit == "0"))
    return out


def main_text(lines: list[tuple[int, str]], near: list[list[tuple[int, str]]]) -> tuple[str, int]:
    """(main text, lines shared with all near pages). Where the page marks no article, it is what is neither shared nor in another part."""
    texts = [t for _, t in lines]
    shared = set.intersection(*(shared_lines(texts, [t for _, t in page]) for page in near)) if near else set()
    marked = any(p == ARTICLE for p, _ in lines)
    kept = [t for i, (p, t) in enumerate(lines) if (p == ARTICLE if marked else p == PLAIN and i not in shared)]
    return "\n".join(kept), len(shared)


def nearest(before: list[list], here: list, after: list[list]) -> list[list]:
    """The nearest page on either side that has other lines, the sides given from ``here`` on; two of one side at an end."""
    before, after = [x for x in before if x != here], [x for x in after if x != here]
    return before[:1] + after[:1] if before and after else before[:2] + after[:2]


def compared(runs: Iterator[tuple[list, list]]) -> Iterator[tuple[list, str, int]]:
    """(members, main text, shared lines) for runs (lines, members) of a host in order, but for runs without members; REACH runs a side are held."""
    held: deque = deque(maxlen=2 * REACH + 1)

    def told(at: int) -> Iterator[tuple[list, str, int]]:
        around = [lines for lines, _ in held]
        if members := held[at][1]:
            yield members, *main_text(around[at], nearest(around[max(0, at - REACH) : at][::-1], around[at], around[at + 1 :]))

    for run in runs:
        held.append(run)
        if len(held) > REACH:
            yield from told(len(held) - 1 - REACH)
    for at in range(max(0, len(held) - REACH), len(held)):
        yield from told(at)


Key = tuple[str, str, bool, object, int]


def _place(host: str, path: str, page_id: object, look: int) -> Key:
    """A page's place in the order, as Spark sorts it: by host, path, id (nulls first) and lines."""
    return host, path, page_id is not None, 0 if page_id is None else page_id, look


def _look(lines: list[tuple[int, str]]) -> int:
    return int.from_bytes(blake2b(repr(lines).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: Pages that are lines in one place at a time.
_CHUNK = 256


def _lined(pages: DataFrame, cuts: tuple[list[Key], dict[Key, list[int]]] | None) -> DataFrame:
    """(page_id, host, path, look) of every page; with ``cuts`` url, part, beside and the lines too, and a row more for each other part it is beside."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    id_type, kind = to_arrow_type(pages.schema["page_id"].dataType), pages.schema["page_id"].dataType.simpleString()
    names = ["page_id", "host", "path", "look", "url", "part", "beside", "parts", "lines"]
    types = [id_type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int8()), pa.list_(pa.string())]

    def to_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for b in (whole.slice(k, _CHUNK) for whole in batches for k in range(0, whole.num_rows, _CHUNK)):
            rows = []
            for page_id, url, source, at_host, at_path in zip(*(c.to_pylist() for c in b.columns)):
                lines = page_lines(source or "")
                row = page_id, at_host, at_path, _look(lines)
                if cuts is None:
                    rows.append(row)
                    continue
                borders, beside = cuts
                key = _place(at_host, at_path, page_id, row[3])
                part = bisect_right(borders, key)
                others = [p for p in beside.get(key, ()) if p != part and (key, p) not in sent]
                sent.update((key, p) for p in others)
                texts = [p for p, _ in lines], [t for _, t in lines]
                rows += [(*row, url, p, p != part, *texts) for p in (part, *others)]
            n = 4 if cuts is None else len(names)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(n)], names[:n])

    shape = f"page_id {kind}, host string, path string, look bigint"
    if cuts is not None:
        shape += ", url string, part bigint, beside boolean, parts array<tinyint>, lines array<string>"
    return pages.select("page_id", "url", "html", host.alias("host"), path.alias("path")).mapInArrow(to_lines, shape)


def _cuts(pages: DataFrame) -> tuple[list[Key], dict[Key, list[int]]]:
    """The first page of every part but the first, and the pages beside each cut with the parts across it that they are compared with.

    Pages of a part need the last REACH + 1 runs of equal pages that begin before it (the last may go on in it) and the first REACH
    that begin after it, wherever these are; of a run its first page stands for it. Both are bounded by the number of parts.
    """
    order = ["host", "path", "page_id", "look"]
    keys = _lined(pages, None).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    keys = written(keys.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    run, within, whole = F.struct("host", "look"), Window.partitionBy("_p").orderBy("_i"), Window.orderBy("_p")
    ends = keys.groupBy("_p").agg(F.count("*").alias("n"), F.max_by(run, F.col("_i")).alias("end"))
    ends = ends.select("_p", (F.sum("n").over(whole) - F.col("n")).alias("start"), F.lag("end").over(whole).alias("end"))
    rows = keys.join(F.broadcast(ends), "_p").withColumn("position", F.col("start") + F.row_number().over(within) - 1)
    begins = ~F.coalesce(F.lag(run).over(within), F.col("end")).eqNullSafe(run)
    rows = written(rows.select(*order, "_p", "position", begins.alias("begins")))
    count, size = rows.count(), GROUP_PAGES
    size = max(size, -(-count // MOST_PARTS))
    before = rows.groupBy("_p").agg(F.count_if("begins").alias("n"))
    before = before.select("_p", (F.sum("n").over(whole) - F.col("n")).alias("runs"))
    numbered = rows.join(F.broadcast(before), "_p").withColumn("run", F.col("runs") + F.count_if("begins").over(Window.partitionBy("_p").orderBy("position")))
    numbered = written(numbered.select(*order, "position", "begins", "run"))
    borders = numbered.where((F.col("position") % size == 0) & (F.col("position") > 0))
    # Runs are numbered from 1; the run of a border that begins with it is the first one after it.
    last, part = F.col("run") - F.when(F.col("begins"), 1).otherwise(0), (F.col("position") / size).cast("bigint")
    wanted = borders.select(part.alias("part"), last.alias("last"), F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))).alias("k"))
    wanted = wanted.select((F.col("last") + F.col("k")).alias("run"), F.when(F.col("k") > 0, F.col("part") - 1).otherwise(F.col("part")).alias("part"))
    beside: dict[Key, list[int]] = defaultdict(list)
    for r in numbered.where("begins").join(F.broadcast(wanted), "run").select(*order, "part").collect():
        beside[_place(*r[:4])].append(r["part"])
    firsts = sorted(_place(*r) for r in borders.select(*order).collect())
    forget(keys, rows, numbered)
    return firsts, dict(beside)


def _grouped(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, look, url, part, beside, parts, lines): pages as lines in parts of the order; ``beside`` are those of other parts."""
    return _lined(pages, _cuts(pages))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, shared_lines) for every row of (page_id, url, html).

    Null and empty html give an empty text; a null url counts as empty and pairs within its own host. Repeated
    rows stay and get the same text: a page is compared only with pages of other lines, so copies delete nothing
    from each other. With one other page of its host, a page is compared with that one; with none it loses no
    line. Other columns are not read; an empty table gives no rows. The result doesn't depend on partitions, cuts or the size of
    the input: a page's neighbours are those of its host's whole order.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in (whole.slice(k, _CHUNK) for whole in batches for k in range(0, whole.num_rows, _CHUNK)):
                for page_id, url, host, part, beside, parts, lines in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "host", "part", "beside", "parts", "lines"))):
                    yield (part, host), list(zip(parts, lines)), (page_id, url, beside)

        def runs(group: Iterator[tuple]) -> Iterator[tuple[list, list]]:
            for lines, same in groupby(group, key=lambda r: r[1]):
                yield lines, [(page_id, url) for _, _, (page_id, url, beside) in same if not beside]

        def told(done: list) -> pa.RecordBatch:
            ids, urls, texts, shared = zip(*done)
            columns = (ids, id_type), (urls, pa.string()), (texts, pa.string()), (map(len, texts), pa.int64()), (shared, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in columns], ["page_id", "url", "text", "n_chars", "shared_lines"])

        done: list = []
        for _, each in groupby(rows(), key=lambda r: r[0]):
            for members, text, shared in compared(runs(each)):
                for page_id, url in members:
                    done.append((page_id, url, text, shared))
                    if len(done) >= _CHUNK:
                        yield told(done)
                        done = []
        if done:
            yield told(done)

    kind = pages.schema["page_id"].dataType.simpleString()
    id_type = to_arrow_type(pages.schema["page_id"].dataType)
    dealt = _grouped(pages).repartition("part").sortWithinPartitions("part", "host", "path", "page_id", "look")
    return dealt.mapInArrow(compare, f"page_id {kind}, url string, text string, n_chars bigint, shared_lines bigint")

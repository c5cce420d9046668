"""Main text of HTML pages by differencing pages with near URLs.

Pages of a host that stand next to each other in URL order share their
template.  Each page's lines are aligned with its neighbour's by a longest
common subsequence and the shared ones are deleted.  Two exact rules frame
this: lines inside the page's article are never deleted because a neighbour
has them (articles quote and copy each other), and what the markup itself
calls a menu, an advert and so on goes even where the neighbour's differs.
All other lines are decided by differencing, those around an article too: they
stay with it if the neighbour has the page's template (shares a line outside
its article) but not them.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import range_splits
from driftmon.llm.words import slices

#: Elements that hold no article text, elements that begin a block, void elements.
CHROME_TAGS = frozenset(
    "script style noscript template head title nav header footer aside form button select textarea iframe svg object "
    "canvas video audio dialog menu map math".split()
)
RAW_TAGS = "script|style|textarea|title|noscript|iframe|template"
BLOCK_TAGS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article "
    "main hr figure figcaption address details summary fieldset body html center".split()
) | CHROME_TAGS
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in a class, id or role that name what is not the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar sidebars rail widget widgets menu menus nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar share sharing social "
    "related recommended newsletter subscribe subscription comment comments reply replies disqus respond login signup "
    "search contentinfo complementary skip tracking".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW_TAGS + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)/?>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A chrome element of these names ends where the next block begins.
_SHORT = frozenset(["p", "li", "dt", "dd"])
_ROWS = pa.schema([
    ("place", pa.int64()), ("key", pa.string()), ("host", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("article", pa.list_(pa.string())), ("lines", pa.list_(pa.string())), ("open", pa.list_(pa.bool_())),
    ("after", pa.list_(pa.int32())), ("digest", pa.binary()), ("guest", pa.bool_()),
])
_MARKS = pa.schema([("place", pa.int64()), ("key", pa.string()), ("host", pa.string()), ("digest", pa.binary())])
_OUT = "page_id long, url string, text string, n_chars long, shared_lines long"


def _is_chrome(name: str, attributes: str) -> bool:
    if name in CHROME_TAGS:
        return True
    if "=" not in attributes or name in ("html", "body", "article", "main") and not re.search("comment|repl", attributes, re.I):
        return False
    for found in _NAMED.finditer(attributes):
        value = found[1] or found[2] or found[3] or ""
        if CHROME_WORDS.intersection(re.findall("[a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", value).lower())):
            return True
    return False


def page_lines(source: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """The lines inside the page's article, and the lines outside with whether the markup leaves them open."""
    return placed_lines(source)[:2]


def placed_lines(source: str) -> tuple[list[str], list[tuple[str, bool]], list[int]]:
    """As ``page_lines``, and for each line outside how many of the article's come before it."""
    inside: list[str] = []
    outside: list[tuple[str, bool]] = []
    after: list[int] = []
    stack: list[tuple[str, bool, bool]] = []  # name, chrome, article
    chrome = article = 0
    text: list[str] = []

    def flush() -> None:
        nonlocal text
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text = []
            if line:
                if article and not chrome:
                    inside.append(line)
                else:
                    outside.append((line, not chrome))
                    after.append(len(inside))

    def pop() -> None:
        nonlocal chrome, article
        _, c, a = stack.pop()
        chrome -= c
        article -= a

    for m in _TOKEN.finditer(source):
        token = m[0]
        if token[0] != "<":
            text.append(token)
            continue
        if m[1] or m[3] is None:
            if token == "<":
                text.append("<")
            continue
        name = m[3].lower()
        if name in BLOCK_TAGS:
            flush()
        elif name == "br":
            text.append(" ")
        if m[2]:  # an end tag closes what is still open inside its element
            if any(name == s[0] for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID_TAGS:
            continue
        while stack and stack[-1][1] and stack[-1][0] in _SHORT and name in BLOCK_TAGS:
            pop()
        is_chrome, is_article = _is_chrome(name, m[4]), name in ("article", "main")
        if is_chrome and name == "header" and article:
            is_chrome = False  # the article's own heading
        if is_article and not is_chrome and not article:
            # an article inside something that was left open ends it
            while any(s[1] for s in stack):
                pop()
        if token.endswith("/>") and name not in BLOCK_TAGS:
            continue
        stack.append((name, is_chrome, is_article and not is_chrome))
        chrome += is_chrome
        article += is_article and not is_chrome
    flush()
    return inside, outside, after


def _row(a: list[int], masks: dict[int, int], width: int) -> np.ndarray:
    """Length of the common subsequence of ``a`` with every prefix of the other list, by bit-parallel steps."""
    full = (1 << width) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((width + 7) // 8, "little"), np.uint8), bitorder="little")[:width]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _masks(b: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    return masks


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in linear memory."""
    out: list[int] = []
    jobs = [(0, len(a), 0, len(b))]
    while jobs:
        i, k, j, n = jobs.pop()
        while i < k and j < n and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < k and j < n and a[k - 1] == b[n - 1]:
            out.append(k - 1)
            k, n = k - 1, n - 1
        if i >= k or j >= n:
            continue
        if k - i == 1:
            if a[i] in b[j:n]:
                out.append(i)
            continue
        mid = (i + k) // 2
        left, right = b[j:n], b[j:n][::-1]
        scores = _row(a[i:mid], _masks(left), n - j) + _row(a[mid:k][::-1], _masks(right), n - j)[::-1]
        cut = j + int(np.argmax(scores))
        jobs += [(i, mid, j, cut), (mid, k, cut, n)]
    return sorted(out)


def _finish(row: tuple, other: tuple | None) -> tuple:
    _, _, _, page_id, url, article, lines, open_, after, _, _ = row
    shared = set(common_lines(lines, other[6])) if other is not None else set()
    own = [i for i in range(len(lines)) if open_[i] and i not in shared]
    if article and not shared:  # no template to tell the lines around the article from
        own = []
    text, done = [], 0
    for i in own:
        text += article[done : after[i]]
        done = after[i]
        text.append(lines[i])
    whole = "\n".join(text + article[done:])
    return page_id, url, whole, len(whole), len(shared)


def _digest(lines: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _borders(rows: list[tuple]) -> list[tuple]:
    """Of a range's sorted rows (place, key, host, digest): the first and last, and those nearest to them that differ."""
    first, last = rows[0], rows[-1]
    differs = [next((r for r in some if r[2:] != some[0][2:]), None) for some in (rows, rows[::-1])]
    return sorted({r for r in (first, last, *differs) if r is not None})


def _guests(borders: list[tuple]) -> dict[tuple, list[int]]:
    """(key, digest) of each page that another range needs, with those ranges.

    A range needs, on either side, the nearest page of its border page's host
    whose lines are not the border page's.
    """
    out: dict[tuple, list[int]] = {}
    for rows in (borders, borders[::-1]):
        place = run = differs = None  # the last row seen, and the nearest of its host before it with other lines
        for row in rows:
            if row[0] != place:
                near = run if run is not None and run[3] != row[3] else differs
                if near is not None and near[2] == row[2]:
                    out.setdefault((near[1], near[3]), []).append(row[0])
                place = row[0]
            if run is None or row[2] != run[2]:
                differs = None
            elif row[3] != run[3]:
                differs = run
            run = row
    return out


def extract_text(pages: DataFrame, rows_each: int = 250) -> DataFrame:
    """page_id, url, text, n_chars (code points) and the number of lines shared with the neighbour.

    Input: ``page_id, url, html``; other columns are ignored.  Null or empty
    html gives an empty text, a null url is a host of its own, an empty table
    an empty result.  A page's neighbour is the next one of its host, in the
    order of path, query and ``page_id``, whose lines outside an article differ
    from its own (a copy says nothing about the template); where none follows,
    the nearest one before.  A page with no such page on its host has none.
    Repeated rows each give a row.

    Pages are dealt in ranges.  A first pass finds the pages at the borders,
    and those that the range beside (or one further away, past copies) needs
    go there as guests.
    """
    def key_of(page_id, url: str | None) -> tuple[str, str]:
        try:
            u = urlsplit(url or "")
            host, path, query = u.netloc.lower(), u.path, u.query
        except ValueError:
            host, path, query = "", url or "", ""
        return host, "\0".join([host, path, query, "" if page_id is None else f"{page_id:020d}"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.record_batch([pa.array([key_of(p, u)[1] for p, u in rows], pa.string())], names=["key"])

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    splits = range_splits(some.select("page_id", "url").mapInArrow(keys, "key string"), "key", rows_each)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4_000_000):
                rows = []
                for page_id, url, source in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    host, key = key_of(page_id, url)
                    rows.append((bisect.bisect_right(splits, key), key, host, _digest([x for x, _ in page_lines(source)[1]])))
                yield _records(rows, _MARKS)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    out += _borders(held)
                    held = []
                if not held or row != held[-1]:
                    held.append(row)
            yield _records(out, _MARKS)
        if held:
            yield _records(_borders(held), _MARKS)

    guests: dict[tuple, list[int]] = {}
    if splits:
        narrow = "place long, key string, host string, digest binary"
        found = some.mapInArrow(marks, narrow).repartition("place").sortWithinPartitions("place", "key", "digest")
        guests = _guests(sorted((r[0], r[1], r[2], bytes(r[3])) for r in found.mapInArrow(borders, narrow).collect()))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4_000_000):
                rows = []
                for page_id, url, source in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    inside, outside, after = placed_lines(source)
                    host, key = key_of(page_id, url)
                    place = bisect.bisect_right(splits, key)
                    digest = _digest([x for x, _ in outside])
                    own = ([x for x, _ in outside], [o for _, o in outside], after, digest)
                    rows.append((place, key, host, page_id, url, inside, *own, False))
                    rows += [(p, key, host, None, None, None, *own, True) for p in guests.get((key, digest), ())]
                yield _records(rows, _ROWS)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[list] = []  # rows with the same lines that wait for the next page with others, and how often each occurs
        last = before = None  # the last row of all, and the nearest before the run that the run may take

        def finished(near: tuple | None) -> list[tuple]:
            return [x for row, times in run for x in [_finish(row, near)] * times]

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                beside = last is not None and (row[0], row[2]) == (last[0], last[2])
                if not beside or row[9] != last[9]:
                    out += finished(row if beside else before)
                    run, before = [], last if beside else None
                if run and run[-1][0] == row:
                    run[-1][1] += 1
                elif not row[10]:
                    run.append([row, 1])
                last = row
            yield _batch(out)
        yield _batch(finished(before))

    schema = ("place long, key string, host string, page_id long, url string, article array<string>, "
              "lines array<string>, open array<boolean>, after array<int>, digest binary, guest boolean")
    dealt = some.mapInArrow(lines, schema).repartition("place")
    return dealt.sortWithinPartitions("place", "key", "digest", "article").mapInArrow(pair, _OUT)


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                           names=["page_id", "url", "text", "n_chars", "shared_lines"])

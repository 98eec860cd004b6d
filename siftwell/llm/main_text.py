"""Main text of web pages: structure, and a host suffix array for what structure leaves in.

A page is cut into blocks, each with a standing that its elements give it: the article (4 explicit, 3 by class
names), outside (0: menus, headers, footers, asides, forms, adverts, notices, comments, by tag, role or class names)
or open (1). Scripts, styles, comments in the markup and hidden elements are no blocks at all. Class names speak for
an element as whole names or as compounds that end in what the element is (`site-footer`, `comment-list`), and not
for the page, the article or a paragraph. A form around most of the page's text is a wrapper and no form. What is out
within a line (a button, an advert's span) goes without parting the line.

A page's article blocks are one token stream, its open blocks another. The streams of a host are concatenated with a
different end mark each and sorted as suffixes by prefix doubling to a depth of `RUN` tokens, part by part of the host;
suffixes that agree to that depth are a repeated substring, and the counts of all parts are added up. (A place lies in
some repeated substring of `RUN` tokens or more on n pages exactly if it lies in one of `RUN` tokens on n pages, so a
larger depth finds no more.) What is covered goes and unique runs stay:

* in open blocks, substrings that `PAGES` distinct pages of the host share;
* in article blocks, substrings that more than half of the host's distinct articles share, `ARTICLES` at least, unless
  they make up more than half of the article: then it is a copy and not furniture.

Passages that some articles of a host share are thus text, and what its pages carry throughout isn't, even where it
stands within the article's element. A page's text is that of its best standing: the article, unless what class names
call the text is more than `OUTWEIGHS` times as long (then the elements are teasers); and of several articles side by
side the one that outweighs all others together so, or else all.

Copies of an article are one, and hot hosts have many parts, dealt by hash. A substring on more than half of a host's
articles is on a quarter of any part's unless chance has it otherwise (below one in a million for parts of a hundred
articles), so parts report article runs from a quarter on, and open runs all.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; pages with the same id, url
and html are one page to the suffix array and a row each in the result; unclosed, stray and overlapping tags are
taken as browsers take them, roughly; a tag that never ends takes the rest of the page; extra columns are ignored.
Words are told apart by 24 bits of their hash, runs by all their words'.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import discard, frugal, mixed, slices, stored, tidy

RUN = 8
PAGES = 3
ARTICLES = 4
#: Pages and tokens of a host that one task sorts; larger hosts have several parts.
PART_PAGES = 500
OUTWEIGHS = 2
PART_TOKENS = 1_000_000
SLICE_BYTES = 4 << 20

OUT, OPEN, BY_CLASS, ARTICLE = 0, 1, 3, 4

#: Elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg math object canvas audio video select".split())
OUTSIDE = frozenset("nav footer aside form button label fieldset legend dialog menu head".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsored sponsors promo promos promoted banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices disclaimer newsletter subscribe subscription signup signin login register paywall popup modal overlay share sharing social comment comments commentlist reply replies respond response responses discussion disqus related recommended recommendations trending widget widgets pagination pager search skip".split()
)
STAYS_OUT = frozenset("comment comments commentlist reply replies respond response responses discussion disqus related recommended recommendations aside sidebar".split())
#: Last parts of compound names that leave the element's role to the parts before, and first parts that deny it.
HOLDERS = frozenset("area bar block body box button buttons container content form group holder inner item items link links list message panel posts section slot stories text thread unit widget wrap wrapper".split())
DENIALS = frozenset("no has with without hide show is".split())
#: Elements whose class names say nothing about their role.
UNNAMED = frozenset("html body main article p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tbody tr td th b strong em i".split())
TEXT_CLASSES = frozenset("article articlebody article-body article-content article-text post post-body post-content entry entry-content content main maincontent main-content page-content story story-body story-content body-text".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES = {t: frozenset({t}) for t in ("p", "li", "option", "tr")} | {t: frozenset({"dt", "dd"}) for t in ("dt", "dd")} | {t: frozenset({"td", "th"}) for t in ("td", "th")}
_ENDS_P = BLOCKS - {"br"}
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|\s+", re.S | re.I)
_PROSE = re.compile(rf"<(?:p|article|main|h1)[\s>]|(?:class|id)\s*=\s*[\"']?(?:{'|'.join(sorted(TEXT_CLASSES))})[\"'\s>]", re.I)
_FORM_END = re.compile(r"</form\b", re.I)


def _role(name: str) -> frozenset[str]:
    """What a class name or id says an element is: words of OUT_WORDS."""
    if name in OUT_WORDS:
        return frozenset({name})
    *first, last = re.split(r"[-_]+", name)
    if not first or first[0] in DENIALS:
        return frozenset()
    return OUT_WORDS & ({*first} if last in HOLDERS or last.isdigit() else {last})


def _wraps(page: str, begin: int) -> bool:
    """Whether the form that begins there holds prose, and most of the page's text."""
    end = _FORM_END.search(page, begin)
    inner = page[begin : end.start() if end else len(page)]
    return 2 * len(inner) > len(page) and bool(_PROSE.search(inner)) and 2 * len(_MARKUP.sub("", inner)) > len(_MARKUP.sub("", page))


def _standing(tag: str, attributes: str, above: tuple[int, bool]) -> tuple[int, bool] | None:
    """Standing of an element and whether it stays out whatever is inside; None if it is hidden."""
    standing, fixed = above
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /\t\n\r") else {}
    if "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style", "")):
        return None
    names = set(f"{given.get('class', '')} {given.get('id', '')}".lower().split())
    words = set() if tag in UNNAMED else {w for x in names for w in _role(x)}
    role = given.get("role", "").lower()
    if words & STAYS_OUT or tag == "aside":
        return OUT, True
    if fixed:
        return above
    if tag in OUTSIDE or role in OUT_ROLES or words:
        return OUT, False
    if tag in ("article", "main") or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody":
        return ARTICLE, False
    if standing < BY_CLASS and tag not in UNNAMED and (tag == "header" or any(re.fullmatch(r"(?:.*[-_])?header", x) for x in names)):
        return OUT, False
    if standing == OPEN and names & TEXT_CLASSES:
        return BY_CLASS, False
    return above


def parsed(page: str | None) -> list[tuple[int, int, str]]:
    """Standing, number of the outermost article element (0: none) and text of each block, in order."""
    out: list[tuple[int, int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[int, bool]]] = []
    state: tuple[int, bool] = (OPEN, False)
    held: list[str] = []
    at, size, articles = 0, len(page), 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((state[0], articles if any(x == "article" for x, _ in stack) else 0, text))
            held.clear()

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            held.append(entities.unescape(page[at:begin]))
        if begin == size:
            break
        tag = _TAG.match(page, begin)
        if not tag:
            held.append("<")
            at = begin + 1
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if tag[1]:
            if name in (x for x, _ in stack):
                while stack:
                    x, before = stack[-1]
                    if x in BLOCKS or before != state:
                        flush()
                    stack.pop()
                    state = before
                    if x == name:
                        break
            continue
        if name in VOID:
            continue
        mine = None if name in RAW else _standing(name, tag[3], state)
        if name == "form" and mine == (OUT, False) and state[0] != OUT and _wraps(page, at):
            mine = state
        wrapper = name == "form" and mine == state
        if mine is None or mine[0] == OUT != state[0] and name not in BLOCKS:
            # Nothing inside counts, nor parts a line: on to the element's end.
            depth = 1
            closing = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I)
            for end in closing.finditer(page, at):
                depth += -1 if end[1] else 0 if name in RAW else 1
                if not depth:
                    break
            at = end.end() if not depth else (size if name in RAW else at)
            continue
        for closes in (_CLOSES.get(name), frozenset({"p"}) if name in _ENDS_P else None):
            # An open paragraph (or item, cell ...) ends where the next begins, if nothing larger is between.
            for k in range(len(stack) - 1, -1, -1) if closes else ():
                if stack[k][0] in closes:
                    flush()
                    state = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if mine != state:
            flush()
        if not wrapper:
            mine = _standing(name, tag[3], state) or state
        if name == "article" and not any(x == "article" for x, _ in stack):
            articles += 1
        stack.append((name, state))
        state = mine
    flush()
    return out


def chosen(found: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """Standing and text of the blocks; what lost to a body or an article that outweighs it has standing OUT."""
    sizes: dict[int, int] = {}
    for standing, article, text in found:
        if standing == ARTICLE:
            sizes[article] = sizes.get(article, 0) + len(text)
    named = sum(len(t) for s, _, t in found if s == BY_CLASS)
    if named > OUTWEIGHS * sum(sizes.values()):
        return [(OUT if s == ARTICLE else s, t) for s, _, t in found]
    whole = sum(n for k, n in sizes.items() if k)
    best = max(sizes, key=lambda k: (k > 0, sizes[k]), default=0)
    if best and sizes[best] > OUTWEIGHS * (whole - sizes[best]):
        return [(OUT if s == ARTICLE and k not in (0, best) else s, t) for s, k, t in found]
    return [(s, t) for s, _, t in found]


def blocks(page: str | None) -> list[tuple[int, str]]:
    """Standing and text of each block, in order."""
    return chosen(parsed(page))


def sorted_suffixes(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the tokens by prefix doubling, and the rank of each suffix by its first `depth` tokens (or more)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, reach = np.argsort(rank, kind="stable"), 1
    while reach < depth and len(rank):
        # The rank of a suffix and that of the one `reach` further on, in one number.
        key = rank * np.int64(len(rank) + 1)
        key[: len(rank) - reach] += rank[reach:] + 1
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        reach *= 2
    return order, rank


def tokens_of(parts: list[str]) -> np.ndarray:
    """The words of blocks as 24-bit tokens."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) & 0xFFFFFF for x in parts for w in x.split()), dtype=np.uint32)


def _narrow(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
    return out.view("<u4").reshape(-1)


def windows_of(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN tokens."""
    n = max(0, len(tokens) - RUN + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(RUN):
        out += (tokens[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    return mixed(out).view(np.int64)


def repeated_runs(streams: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of RUN tokens that `least` of the streams share, and how many do, by their suffix array."""
    streams = [x for x in streams if len(x) >= RUN]
    if not streams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tokens = np.concatenate([np.append(x.astype(np.int64), -1 - k) for k, x in enumerate(streams)])
    sizes = np.array([len(x) + 1 for x in streams])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(streams)), sizes)
    order, rank = sorted_suffixes(tokens, RUN)
    order = order[(np.repeat(ends, sizes) - 1 - np.arange(len(tokens)))[order] >= RUN]
    # Suffixes that agree to the depth are neighbours; of one stream they count once.
    group = rank[order]
    pairs = np.unique(group * np.int64(len(streams)) + owner[order])
    groups, counts = np.unique(pairs // len(streams), return_counts=True)
    at = order[np.searchsorted(group, groups)]
    often = counts >= least
    hashes = windows_of(np.maximum(tokens, 0))
    return hashes[at[often]], counts[often]


def _without(texts: list[str], covered: set[int], most: float) -> list[str]:
    """The blocks without words of covered runs, unless these make up more than `most` of all words."""
    words = [x.split() for x in texts]
    hashes = windows_of(tokens_of(texts))
    hit = np.zeros(sum(map(len, words)), dtype=bool)
    for k in np.flatnonzero([h in covered for h in hashes.tolist()]).tolist():
        hit[k : k + RUN] = True
    if not hit.any() or hit.mean() > most:
        return texts
    out, at = [], 0
    for own in words:
        out.append(" ".join(w for w, gone in zip(own, hit[at:], strict=False) if not gone))
        at += len(own)
    return out


def text_of(parts: list[tuple[int, str]], open_runs: set[int] = frozenset(), article_runs: set[int] = frozenset()) -> str:
    """The text of the best standing, without covered runs."""
    best = max((s for s, _ in parts), default=OUT)
    if best == OUT:
        return ""
    texts = [t for s, t in parts if s == best]
    covered, most = (article_runs, 0.5) if best >= BY_CLASS else (open_runs, 1.0)
    return "\n".join(t for t in (_without(texts, covered, most) if covered else texts) if t)


def _pages(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    return rows.withColumns({"key": F.xxhash64("page_id", "url", "html"), "host": host})


def _streams(rows: DataFrame) -> DataFrame:
    """host, article (else open blocks), owner (the article's text, or the page), undecided (no article on the page), tokens; each owner once."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bool, int]] = set()
        for part in (x for b in batches for x in slices(b, "html", SLICE_BYTES)):
            out = []
            for key, host, page in zip(*(part.column(c).to_pylist() for c in ("key", "host", "html")), strict=True):
                found = blocks(page)
                best = max((s for s, _ in found), default=OUT)
                for article in (True, False):
                    if (best < BY_CLASS) if article else not any(s == OPEN for s, _ in found):
                        continue
                    tokens = _narrow(tokens_of([t for s, t in found if s == (best if article else OPEN)]))
                    owner = xxhash.xxh64_intdigest(tokens) - (1 << 63) if article else key
                    if (host, article, owner) not in seen:
                        seen.add((host, article, owner))
                        out.append((host, article, owner, best < BY_CLASS, tokens))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["host", "article", "owner", "undecided", "tokens"])

    found = rows.select("key", "host", "html").mapInArrow(tidy(parse), "host string, article boolean, owner bigint, undecided boolean, tokens binary")
    return stored(found.groupBy("host", "article", "owner").agg(F.first("undecided").alias("undecided"), F.first("tokens").alias("tokens")))


def covered_runs(streams: DataFrame, run_pages: int, articles: int) -> DataFrame:
    """host, article, run: a stored table of the runs to remove."""
    sizes = streams.groupBy("host", "article").agg(F.count("*").alias("pages"), F.sum(F.octet_length("tokens") / 3).alias("n"))
    sizes = stored(sizes.select("host", "article", "pages", F.ceil(F.greatest(F.col("pages") / PART_PAGES, F.col("n") / PART_TOKENS, F.lit(1))).alias("parts")))
    large = sizes.where("parts > 1").select("host", "article", "parts")
    dealt = streams.join(large, ["host", "article"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    schema = pa.schema([("host", pa.string()), ("article", pa.bool_()), ("run", pa.int64()), ("n", pa.int64())])

    def sort(table: pa.Table) -> pa.Table:
        article, parts = table.column("article")[0].as_py(), table.column("parts")[0].as_py()
        held = [_wide(x.as_buffer()) for x in table.column("tokens")]
        least = max(2, -(-len(held) // 4)) if article else 1 if parts > 1 else run_pages
        runs, n = repeated_runs(held, least) if parts > 1 or len(held) >= (articles if article else run_pages) else (np.empty(0, np.int64),) * 2
        return pa.Table.from_arrays([pa.array([table.column("host")[0].as_py()] * len(runs), pa.string()), pa.array([article] * len(runs), pa.bool_()), pa.array(runs), pa.array(n)], schema=schema)

    dealt = dealt.select("host", "article", "parts", F.pmod("owner", "parts").alias("part"), "tokens")
    runs = dealt.groupBy("host", "article", "part").applyInArrow(sort, "host string, article boolean, run bigint, n bigint")
    counts = runs.groupBy("host", "article", "run").agg(F.sum("n").alias("n"))
    enough = F.when(F.col("article"), (2 * F.col("n") > F.col("pages")) & (F.col("n") >= articles)).otherwise(F.col("n") >= run_pages)
    covered = stored(counts.join(sizes.select("host", "article", "pages"), ["host", "article"]).where(enough).select("host", "article", "run"))
    discard(sizes)
    return covered


def main_text(pages: DataFrame, run_pages: int = PAGES, articles: int = ARTICLES) -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    frugal(pages.sparkSession)
    rows = _pages(pages)
    streams = _streams(rows)
    covered = covered_runs(streams, run_pages, articles)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                runs = np.unique(windows_of(_wide(batch.column("tokens")[k].as_buffer())))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("host")[k].as_py()] * len(runs), pa.string()), pa.array(np.full(len(runs), batch.column("owner")[k].as_py(), np.int64)), pa.array(runs)], names=["host", "key", "run"])

    wanted = streams.where("undecided and not article").select("host", "owner", "tokens").mapInArrow(tidy(explode), "host string, key bigint, run bigint")
    by_page = stored(wanted.join(covered.where("not article"), ["host", "run"]).groupBy("key").agg(F.collect_set("run").alias("open_runs")))
    # At most twice as many runs as an article of the host has words on average.
    by_host = stored(covered.where("article").groupBy("host").agg(F.collect_set("run").alias("article_runs")))
    discard(streams, covered)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in slices(b, "html", SLICE_BYTES)):
            columns = (part.column(c).to_pylist() for c in ("html", "open_runs", "article_runs"))
            texts = [text_of(blocks(page), set(one or ()), set(two or ())) for page, one, two in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = rows.join(by_page, "key", "left").join(by_host, "host", "left").select("page_id", "url", "html", "open_runs", "article_runs")
    found = found.mapInArrow(tidy(finish), f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))

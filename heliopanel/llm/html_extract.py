"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element paths (tag and classes). Each path gets two
entropies over the host's pages, with the number of pages that have the path as the base of the logarithm:
how much the sequence of its children varies (presentation), and how spread its texts are (content: a text
of one page counts 1, a text of all pages 0). Their weighted sum is the importance of the branch, smoothed by
the number of pages; a path of a single page has none. Then each page drops its low branches. Navigation, headers, footers, asides, forms, scripts and the like are
dropped by tag, and by class, id or role unless the branch holds an article or main element or is important on
the host in spite of its name. Inside an article only names that are a whole word count. An article or main element is kept but for
its branches that hardly vary at all; text outside it goes, unless there is more of that than of articles.

The text is that of the remaining blocks: character references decoded, white space inside a block one
space, blocks joined by line breaks, a br ends a block. Null and empty pages give an empty text; pages
without url or host form one host. Repeated rows are extracted each for itself, but raise the counts. The
tree is counted with built-in aggregates, so a host of any size is spread. Columns of the input named like
an output column are replaced by it. An empty table gives an empty result. Time grows with the length of a
page however deep or broken: a text speaks for the nearest branches above it, and what follows the last `>` is text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from heliopanel.llm.common import col, fresh, stored, without

OUTPUT = ("text", "n_chars")
#: Share of content in the importance; the rest is presentation.
CONTENT_SHARE = 0.9
#: Branches below are dropped: outside an article, and inside one.
LOW, FIXED = 0.3, 0.05
#: Importances count as if so many pages more had the branch, with the neutral importance.
SMOOTH_PAGES, NEUTRAL = 0.25, 0.5
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
#: Elements that end an open element of the second set.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "thead": {"thead"}, "tbody": {"thead", "tbody"}}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
SCOPE = frozenset("table ul ol dl article section div body html td th".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|topbar|header|masthead|footer|sidebar|aside|notice|cookie|cookies|consent|gdpr|banner|popup|modal|"
    r"ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|comment|comments|commentlist|disqus|replies|respond|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|breadcrumb|breadcrumbs|pagination|pager|widget|"
    r"complementary|contentinfo|alert|toolbar|skip)(?:$|[\s_-])", re.I)
#: Names that are no noise inside an article, as the header tag is none.
ARTICLE_NAME = re.compile(r"header|masthead|alert|banner|widget", re.I)
#: A text counts for so many branches above it.
REACH = 32
#: From this importance on a name does not drop a branch. Pages are added that would lower it: for a name that
#: is the whole word, and for one that is a part of it (with-sidebar).
HIGH, WHOLE_PAGES, PART_PAGES = 0.8, 8, 0.25


@dataclass(eq=False)
class Branch:
    """An element that is no inline one, with the branch above it; `named` 1 where class, id, role or itemprop call it noise, 2 by a whole word."""
    path: int
    above: Branch | None
    named: int = 0
    holds_article: bool = False
    #: What the decisions say of the branch and all above it, once asked.
    verdict: tuple | None = None


@dataclass
class Element:
    tag: str
    branch: Branch
    noise: bool
    article: bool
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    branch: Branch
    noise: bool
    article: bool
    text: str


def upward(branch: Branch | None) -> Iterator[Branch]:
    while branch is not None:
        yield branch
        branch = branch.above


@lru_cache(maxsize=100_000)
def child_path(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}/{name}") - (1 << 63)


def parsed(source: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks of a page in order, and the child sequence of each element."""
    stack, blocks, styles, words = [Element("", Branch(0, None), False, False)], [], [], []
    open_at: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of each tag
    blocks_at = [0]  # depths of those that are not inline
    position, length = 0, source.rfind(">") + 1

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                top = stack[-1]
                blocks.append(Block(top.branch, top.noise, top.article, text))
            words.clear()

    def close(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            open_at[element.tag].pop()
            if element.tag not in INLINE:
                blocks_at.pop()
                styles.append((element.branch.path, " ".join(element.children)))

    def deepest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while position < length:
        found = TOKEN.search(source, position, length)
        if not found:
            break
        if found.start() > position:
            words.append(source[position:found.start()])
        position = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if found["end"]:
            depth = deepest((tag,))
            if depth and (not inline or depth > blocks_at[-1]):
                if inline and stack[-1].noise:
                    flush()
                close(depth)
            continue
        if tag in RAW:
            if not found["attributes"].rstrip().endswith("/"):
                end = RAW_END[tag].search(source, position, length)
                position = end.end() if end else len(source)
            continue
        if tag in VOID:
            stack[-1].children.append(tag)
            continue
        if tag in CLOSES_P or tag in SAME:
            scope = SCOPE - {"td", "th"} if tag == "tr" else SCOPE
            for ended in ({"td", "th"}, {"tr"}) if tag == "tr" else ({"p"} if tag in CLOSES_P else SAME[tag],):
                depth = deepest(ended)
                if depth and depth >= deepest(scope):
                    close(depth)
        parent = stack[-1]
        values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(found["attributes"])} if found["attributes"] else {}
        named = " ".join(values.get(k, "") for k in ("class", "id", "role", "itemprop"))
        main = tag in ("article", "main") or values.get("role") in ("main", "article")
        article = parent.article or main
        if main:
            for branch in upward(parent.branch):
                if branch.holds_article:
                    break
                branch.holds_article = True
        noise = parent.noise or tag in NOISE_TAGS or tag == "header" and not parent.article or "hidden" in values or values.get("aria-hidden") == "true"
        if article:
            words_of = [w for w in named.split() if NOISE_NAME.fullmatch(w) and not ARTICLE_NAME.fullmatch(w)]
        else:
            words_of = [w for w in named.split() if NOISE_NAME.search(w)]
        called = bool(words_of) and not main and tag not in ("body", "html")
        noise = noise or called and inline
        if inline:
            if noise and not parent.noise:
                flush()
            branch = parent.branch
        else:
            parent.children.append(tag)
            name = f"{tag}.{'.'.join(sorted(values.get('class', '').split()))}"
            path = child_path(parent.branch.path, f"{name}!" if called else name)
            branch = Branch(path, parent.branch, 0 if not called else 1 + any(NOISE_NAME.fullmatch(w) for w in words_of))
            blocks_at.append(len(stack))
        open_at[tag].append(len(stack))
        stack.append(Element(tag, branch, noise, article))
    words.append(source[position:])
    flush()
    close(1)
    return blocks, styles


def branches(source: str) -> set[tuple[int, str, int]]:
    """(path, kind, feature) of a page, each once: kind P the path itself, T a text in its branch, S its child sequence, N that its name (1: whole word) is one of noise."""
    blocks, styles = parsed(source)
    found = set()
    for block in blocks:
        if block.noise:
            continue
        text = xxhash.xxh64_intdigest(block.text) - (1 << 63)
        for branch in islice(upward(block.branch), REACH):
            if branch.named:
                found.add((branch.path, "N", branch.named - 1))
            found.add((branch.path, "T", text))
            found.add((branch.path, "P", 0))
    for path, children in styles:
        found.add((path, "S", xxhash.xxh64_intdigest(children) - (1 << 63)))
    return found


def main_text(source: str, low: set[int], fixed: set[int], high: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of a page without its low branches (of an article: its fixed ones), nor those with a name of noise unless they are high or hold an article."""
    blocks, _ = parsed(source)

    def verdict(branch: Branch) -> tuple[int, bool, bool]:
        """(name that speaks against it, on a low path, on a fixed path), of a branch or any above it."""
        open_branches = []
        while branch is not None and branch.verdict is None:
            open_branches.append(branch)
            branch = branch.above
        name, is_low, is_fixed = branch.verdict if branch else (0, False, False)
        for b in reversed(open_branches):
            if b.named and not b.holds_article and b.path not in high:
                name = max(name, b.named)
            is_low, is_fixed = is_low or b.path in low, is_fixed or b.path in fixed
            b.verdict = (name, is_low, is_fixed)
        return name, is_low, is_fixed

    found = [(b, *verdict(b.branch)) for b in blocks if not b.noise]
    # Where names alone would leave nothing, only those that are whole words count.
    kept = [f for f in found if not f[1]] or [f for f in found if f[1] < 2]
    article, outside = [f for f in kept if f[0].article], [f for f in kept if not f[0].article and not f[2]]

    def size(part: list) -> int:
        return sum(len(f[0].text) for f in part)

    if article and size(outside) <= size(article):
        chosen, left = article, [f for f in article if not f[3]]
    else:
        chosen, left = kept, [f for f in kept if not f[3 if f[0].article else 2]]
    # A host of copies of one page has no varying branch: then the names alone decide.
    return "\n".join(f[0].text for f in (left or chosen))


def style_tree(pages: DataFrame) -> DataFrame:
    """From (host, html): (host, path, pages, importance, content, named): named 1 for a name of noise, 2 for a whole word, 0 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                counts.update((host, *b) for b in branches(source or ""))
            hosts, paths, kinds, features = zip(*counts) if counts else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.string()), pa.array(
                features, pa.int64()), pa.array(counts.values(), pa.int64())], names=["host", "path", "kind", "feature", "n"])

    counted = (pages.mapInArrow(run, "host string, path long, kind string, feature long, n long")
               .groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n")))

    def over(kind: str, value):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))

    spread = F.col("n") * F.ln("n")
    sums = counted.groupBy("host", "path").agg(over("P", F.col("n")).alias("pages"), over("T", F.col("n")).alias("texts"), over("T", spread).alias("same_texts"),
                                               over("S", F.col("n")).alias("styles"), over("S", spread).alias("same_styles"),
                                               F.max(F.when(F.col("kind") == "N", F.col("feature") + 1)).alias("named"))
    base = F.ln("pages")
    content = 1 - F.col("same_texts") / (F.col("texts") * base)
    presentation = F.least(F.lit(1.0), F.coalesce((F.ln("styles") - F.col("same_styles") / F.col("styles")) / base, F.lit(0.0)))
    importance = CONTENT_SHARE * content + (1 - CONTENT_SHARE) * presentation
    return sums.where("pages > 1 and texts > 0").select("host", "path", F.col("pages").cast("long").alias("pages"), importance.alias("importance"), content.alias("content"),
                                                       F.coalesce("named", F.lit(0)).alias("named"))


def extract_text(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """All rows with text and n_chars."""
    source_at = fresh(df, "html", "host", "key", "low", "fixed", "high")
    html_, host, key, low, fixed, high = source_at
    rows = (df.withColumn(html_, col(html)).withColumn(host, F.lower(F.coalesce(F.regexp_extract(col(url), r"^[^:/?#]+://([^/?#]*)", 1), F.lit("")))))
    rows = without(rows, *OUTPUT)
    tree = style_tree(rows.select(F.col(host).alias("host"), F.col(html_).alias("html")))
    smooth = (F.col("importance") * F.col("pages") + NEUTRAL * SMOOTH_PAGES) / (F.col("pages") + SMOOTH_PAGES)
    lowered = F.col("importance") * F.col("pages") / (F.col("pages") + F.when(F.col("named") == 2, WHOLE_PAGES).otherwise(PART_PAGES))
    rescued = (F.col("named") > 0) & (lowered >= HIGH)
    dropped = stored(tree.where((smooth < LOW) | rescued).groupBy(F.col("host").alias(key)).agg(
        F.collect_list(F.when(smooth < LOW, F.col("path"))).alias(low), F.collect_list(F.when(smooth < FIXED, F.col("path"))).alias(fixed),
        F.collect_list(F.when(rescued, F.col("path"))).alias(high)))
    joined = rows.join(dropped, F.col(host) == F.col(key), "left").drop(host, key)
    outer = [f for f in joined.schema.fields if f.name not in (html_, low, fixed, high)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s or "", set(a or ()), set(b or ()), set(c or ())) for s, a, b, c in zip(
                batch.column(html_).to_pylist(), batch.column(low).to_pylist(), batch.column(fixed).to_pylist(), batch.column(high).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in outer], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*[f.name for f in outer], *OUTPUT])

    return joined.mapInArrow(run, StructType([*outer, StructField("text", StringType()), StructField("n_chars", LongType())]))

"""Main text of HTML pages: subtrees that recur across a site's pages are its template."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import slices, small_enough, staged
from cargohold.llm.url_filter import host_of

#: A subtree, with all it holds, is template from this share of a host's pages and this many pages on.
SHARE, MIN_PAGES = 0.1, 6
#: The same for a paragraph, heading or list item within an article.
PROSE_SHARE, PROSE_PAGES = 0.3, 50
#: An element that HTML or its name marks as a menu, advert or the like is template by its shape (tag and names, whatever it holds):
#: from this many pages of its host on (or all it has), or from MIN_PAGES pages of all hosts on.
NAMED_PAGES = 2
#: What holds most of a page's prose and as many characters as this is its article and never template on that page;
#: pages that share it are one page in the counts.
ARTICLE_CHARS = 100
#: Rows of template subtrees that may be broadcast.
BROADCAST_TREES = 500_000
#: Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe svg select object canvas math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong a span code q cite sub sup u s small mark li".split())
BOILERPLATE = frozenset("nav footer aside".split())
#: Never text of an article, recurring or not.
ALONE = frozenset("form head menu dialog button label".split())
ROOTS = frozenset(("article", "main"))
_PASSAGES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li".split())
#: Words of a class, id or role that name a part which isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social comment comments disqus respond reply replies complementary contentinfo search".split()
)
_PAGE_HEADER = frozenset("header masthead topbar".split())
_OPEN = re.compile(r"<!--|<!|<\?|<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""[^>"']*""")
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSES = {"p": BLOCKS, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CLOSED_BY = {tag: [t for t, ends in _CLOSES.items() if tag in ends] for tag in BLOCKS | {"option"}}
#: Elements up to which an implied end looks.
_SCOPE = frozenset("ul ol table dl html body div section article".split())


#: Names of a part for comments: an article in it is a comment if the page has another one.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: Text in these is no prose when it comes to where most of a page's prose is.
_CONTROLS = frozenset("a button label option".split())


#: Kinds of nodes, the last two bits of what is counted: nothing, with its content, as a passage of an article, by its shape.
NOTHING, CONTENT, PASSAGE, SHAPE = range(4)
#: Counted for no page: always removed.
ALWAYS = SHAPE


class _Node:
    __slots__ = ("tag", "parts", "mark", "dropped", "rooted", "up", "at", "hash", "words", "named", "control", "prose", "article", "holds", "marked", "kept")

    def __init__(self, tag: str, mark: str, up: _Node | None, at: int) -> None:
        self.tag, self.up, self.parts, self.mark, self.at, self.hash, self.words = tag, up, [mark], mark, at, 0, False
        self.named = set(mark.lower().split()) if mark else set()
        self.control = tag in _CONTROLS or bool(up and up.control)
        self.prose, self.article, self.holds, self.dropped, self.rooted, self.marked, self.kept = 0, False, False, False, False, False, False


def _judge(nodes: list[_Node]) -> None:
    """Which elements are marked by tag or name, and which lie in an article or main element; `nodes` has children before parents.

    An element that is or holds an outermost article (or main) isn't marked, nor is one with more than half of the
    page's prose unless the article lies outside of it. Only whole words of class, id and role are names.
    """
    within, remarks = {}, {}
    roots = []
    for n in reversed(nodes):
        up = n.up
        within[n] = n.tag == "article" or within.get(up, False)
        remarks[n] = bool(n.named & COMMENTS) or remarks.get(up, False)
        if n.words and (n.tag == "main" or (n.tag == "article" and not within.get(up, False))):
            roots.append(n)
    articles = [n for n in roots if n.tag == "article"]
    chosen = [n for n in articles if not remarks[n]] or articles
    for n in chosen or roots:
        n.article = True
    for n in roots:
        if n.tag == "main":
            n.holds = True
    for n in nodes:
        n.holds |= n.article
        if n.holds:
            n.up.holds = True
    total = sum(n.prose for n in nodes if not n.up.tag)
    any_article, inside = any(n.article for n in nodes), {}
    for n in reversed(nodes):
        up = n.up
        inside[n] = n.article or inside.get(up, False)
        most = 2 * n.prose > total and (inside[n] or not any_article)
        header = (n.tag == "header" or n.named & _PAGE_HEADER) and not up.rooted
        own = n.tag in BOILERPLATE or n.tag in ALONE or bool(header) or (bool(n.named & MARKS) and n.tag not in ("html", "body", "main"))
        n.marked = own and not n.holds and not most
        n.dropped = n.marked or up.dropped
        n.rooted = up.rooted or (n.tag in ROOTS and not n.dropped)


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where a tag's closing bracket is, from `at` outside of quotes on; -1 if there is none. `dead` holds places known to have none."""
    seen = []
    while at not in dead:
        seen.append(at)
        stop = _PLAIN.match(page, at).end()
        if stop == len(page):
            break
        if page[stop] == ">":
            return stop
        quote = page.find(page[stop], stop + 1)
        if quote < 0:
            break
        at = quote + 1
    dead.update(seen)
    return -1


def parse(page: str) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int]], int | None]:
    """The page's blocks in order (text, node, whether it lies outside of the page's article), its nodes (hash and kind to count, parent) and
    the hash of the element that holds most of its prose, if that is long.

    A node's hash covers its subtree: tags, names and text (CONTENT, PASSAGE), or for elements marked as a menu, advert or
    the like its tag and names alone (SHAPE). Parents come before their children.
    """
    top = _Node("", "", None, -1)
    stack, blocks, buffer, owner = [top], [], [], top
    nodes: list[_Node] = []
    made: list[_Node] = []
    opened: Counter[str] = Counter()
    dead: set[int] = set()

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            blocks.append((text, owner))

    def close() -> None:
        node = stack.pop()
        opened[node.tag] -= 1
        node.hash = xxhash.xxh64_intdigest("\x1f".join([node.tag, *node.parts])) - (1 << 63)
        node.parts.clear()
        stack[-1].parts.append(str(node.hash))
        stack[-1].words |= node.words
        stack[-1].prose += node.prose
        nodes.append(node)

    def say(text: str) -> None:
        if text and not text.isspace():
            stack[-1].parts.append(" ".join(text.split()))
            stack[-1].words = True
            if not stack[-1].control:
                stack[-1].prose += len(text.strip())
        buffer.append(text)

    at, end, look = 0, len(page), 0
    while at < end:
        m = _OPEN.search(page, max(at, look))
        stop = _tag_end(page, m.end(), dead) if m is not None and m[2] is not None else 0
        if m is not None and stop < 0:
            look = m.start() + 1  # no tag: its bracket never closes
            continue
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page's end cuts
            say(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            say(page[at : m.start()])
        if m[2] is None:
            stop = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = end if stop < 0 else stop + (3 if m[0] == "<!--" else 1)
            continue
        tag, inner, at = m[2].lower(), page[m.end() : stop], stop + 1
        if m[1]:
            if tag in BLOCKS:
                flush()
            if opened[tag] > 0:
                while stack[-1].tag != tag:
                    close()
                close()
            owner = stack[-1]
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if any(opened[t] > 0 for t in _CLOSED_BY.get(tag, ())):
                for depth in range(len(stack) - 1, 0, -1):
                    if tag in _CLOSES.get(stack[depth].tag, ()):
                        while len(stack) > depth:
                            close()
                        break
                    if stack[depth].tag in _SCOPE:
                        break
        mark = " ".join(next(x for x in a.groups()[1:] if x is not None) for a in _MARK.finditer(inner)) if inner else ""
        stack.append(_Node(tag, mark, stack[-1], len(made)))
        made.append(stack[-1])
        opened[tag] += 1
        if tag in BLOCKS:
            owner = stack[-1]
        if inner.endswith("/") and tag not in BLOCKS:
            close()
    flush()
    while len(stack) > 1:
        close()
    _judge(nodes)
    total = sum(n.prose for n in nodes if not n.up.tag)
    # Children come first, so the first element with most of the prose is the smallest one.
    most = next((n for n in nodes if 2 * n.prose > total and n.prose >= ARTICLE_CHARS), None)
    holder = most
    while holder is not None:
        holder.kept, holder = True, holder.up
    rooted = any(n.rooted for n in nodes)

    def counted(n: _Node) -> int:
        if n.marked:
            return ALWAYS if n.tag in ALONE else xxhash.xxh64_intdigest(f"{n.tag}\x1f{' '.join(sorted(n.named))}") - (1 << 63) & ~3 | SHAPE
        if n.kept or not n.words or n.tag in ("html", "body", *ROOTS) or (n.rooted and n.tag in PROSE - _PASSAGES):
            return NOTHING
        return n.hash & ~3 | (PASSAGE if n.rooted and n.tag in _PASSAGES else CONTENT)

    listed = [(counted(n), n.up.at) for n in made]
    return [(text, node.at, rooted and not node.rooted) for text, node in blocks], listed, most.hash if most else None


def clean(blocks: list[tuple[str, int, bool]], nodes: list[tuple[int, int]], gone: set[int]) -> tuple[list[str], int, int]:
    """Texts of the blocks under no node in `gone` that lie in the article, and how many the template and the article's border cost."""
    removed = [False] * (len(nodes) + 1)  # the last one is above all
    for i, (tree, up) in enumerate(nodes):
        removed[i] = removed[up] or tree == ALWAYS or tree in gone
    stay = [(text, outside) for text, node, outside in blocks if not removed[node]]
    kept = [text for text, outside in stay if not outside]
    return kept, len(blocks) - len(stay), len(stay) - len(kept)


def lone_text(page: str) -> list[str]:
    """The blocks of a page that is its host's only one: every marked element is on all of its pages."""
    blocks, nodes, _ = parse(page)
    return clean(blocks, nodes, {tree for tree, _ in nodes if tree & 3 == SHAPE})[0]


_BLOCK = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32()), ("outside", pa.bool_())]))
_KEYS = ("page_id", "url", "host", "key")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            found = [parse(page or "") for page in batch.column("html").to_pylist()]
            own = batch.column("same").to_pylist()
            yield pa.record_batch(
                {
                    **{c: batch.column(c) for c in _KEYS},
                    "same": pa.array([h if most is None else most for h, (_, _, most) in zip(own, found, strict=True)], pa.int64()),
                    "blocks": pa.array([[{"text": t, "node": n, "outside": o} for t, n, o in blocks] for blocks, _, _ in found], _BLOCK),
                    "trees": pa.array([[tree for tree, _ in nodes] for _, nodes, _ in found], pa.list_(pa.int64())),
                    "ups": pa.array([[up for _, up in nodes] for _, nodes, _ in found], pa.list_(pa.int32())),
                }
            )


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for blocks, trees, ups, gone in zip(*(batch.column(c).to_pylist() for c in ("blocks", "trees", "ups", "gone")), strict=True):
            texts, template, outside = clean([(b["text"], b["node"], b["outside"]) for b in blocks], list(zip(trees, ups, strict=True)), set(gone or ()))
            done.append(("\n".join(texts), len(blocks), template, outside))
        text, n, template, outside = zip(*done, strict=True) if done else ((), (), (), ())
        yield pa.record_batch(
            {
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64()),
                "n_blocks": pa.array(n, pa.int32()), "n_template": pa.array(template, pa.int32()), "n_outside": pa.array(outside, pa.int32()),
            }
        )


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, min_pages: int = MIN_PAGES,
    prose_share: float = PROSE_SHARE, prose_pages: int = PROSE_PAGES, named_pages: int = NAMED_PAGES,
) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks, n_template, n_outside of every row: the main text without what its site repeats.

    Each page's element subtrees are hashed and counted once for a page of their host; deleted with their blocks are
    those, with all they hold, on `share` of the host's pages and `min_pages` pages or more (for paragraphs, headings and
    list items within an article `prose_share` and `prose_pages`), and parts that HTML or their names mark as menus,
    headers, notices, adverts or comments, which vary in text, if their shape is on `named_pages` pages of the host (or on all it has) or
    on `min_pages` pages of all hosts. Names alone drop only forms and controls. What holds most of a page's prose is never template there, and pages that
    share it, or the whole html, count as one: an article under several addresses stays. Then blocks outside of the
    article or main element go, if there is one. `n_template` and `n_outside` say how many blocks each step took of `n_blocks`.
    Character references are decoded, white space in a block is one space, blocks are joined by line breaks.

    Only hashes are shuffled, unless there are more than BROADCAST_TREES template subtrees. Pages are parsed in time and memory that grow
    with their length, however deep they nest. Null html or a page without text gives an empty text; a null url has an
    empty host; repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"),
        F.xxhash64(F.col(url_col).cast("string"), F.col(html_col).cast("string")).alias("key"), F.col(html_col).cast("string").alias("html"),
        F.xxhash64(F.col(html_col).cast("string")).alias("same"),
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, key long, same long, blocks array<struct<text:string,node:int,outside:boolean>>, trees array<long>, ups array<int>"
    parsed = staged(rows.mapInArrow(_parse, schema), "parsed")
    totals = parsed.select("host", "same").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    is_a = lambda k: F.col("tree").bitwiseAND(F.lit(3).cast("long")) == k
    seen = parsed.select("host", "same", F.explode(F.array_distinct("trees")).alias("tree")).filter(~is_a(NOTHING) & (F.col("tree") != ALWAYS))
    seen = seen.distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).filter(is_a(SHAPE) | (F.col("n") >= min(min_pages, prose_pages)))
    seen = staged(seen.join(totals, "host"), "counts")
    everywhere = seen.filter(is_a(SHAPE)).groupBy("tree").agg(F.sum("n").alias("of_all")).filter(F.col("of_all") >= min_pages).select(F.col("tree").alias("common"), F.lit(True).alias("is_common"))
    often = (F.col("n") >= F.when(is_a(PASSAGE), prose_pages).otherwise(min_pages)) & (F.col("n") >= F.when(is_a(PASSAGE), prose_share).otherwise(share) * F.col("pages"))
    shape = F.coalesce("is_common", F.lit(False)) | (F.col("n") >= F.least(F.lit(named_pages), F.col("pages")))
    marked = seen.join(everywhere, F.col("tree") == F.col("common"), "left")
    template = staged(marked.filter(F.when(is_a(SHAPE), shape).otherwise(often)).select("host", "tree"), "template")
    if small_enough(template, BROADCAST_TREES):  # pages stay where they are; a host has few, by `share`
        left = parsed.join(F.broadcast(template.groupBy("host").agg(F.collect_list("tree").alias("gone"))), "host", "left")
        left = left.withColumn("gone", F.array_intersect("trees", "gone"))
    else:
        hits = parsed.select("key", "host", F.explode(F.array_distinct("trees")).alias("tree")).join(template, ["host", "tree"]).groupBy("key").agg(F.collect_set("tree").alias("gone"))
        left = parsed.join(hits, "key", "left")
    out = f"page_id {kind}, url string, text string, n_chars long, n_blocks int, n_template int, n_outside int"
    return left.select("page_id", "url", "blocks", "trees", "ups", "gone").mapInArrow(_clean, out)

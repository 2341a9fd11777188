"""Main text of web pages by deduced templates of their hosts.

Tokens of a page are its tags, told apart by their path of tags and class names, and its text blocks, with the
path they stand in; inside articles as well as outside. Tokens with the same occurrence vector, that is as often
as each other on every page of the host, form an equivalence class. The vectors of a host are compared by sums of
a hash of page and count, so no host is gathered in one place: counting is a partial aggregation and a host with a
third of all pages is one more key. The class of the page itself is the root; the others, those of most pages
first, are nested: a class is valid if its tokens keep together within one slot of the template so far. A second
pass over the pages confirms each class that holds text: its tokens must come in the same order, and whole,
wherever they occur. A class that fails keeps its tags, as an opening and a closing tag are a class by themselves,
and loses its text.

Tags enter a template from MIN_TAGS of a host's different pages on; tags of elements that are no main text by name
always do. Text needs half of the pages, and FEW_PAGES of them at least, so that copies of one article on a small
host are not taken for its template. So a template has at most about 1 / MIN_TAGS times the tags of an average
page, names of side elements aside.

A page is cut at the tags of the template. What lies between two of them is a slot; a slot goes by the tag it
follows. Text of the template is dropped. The others are judged slot by slot, by figures summed over all pages of
the host: its share of characters in links, in elements that are called main text or something else, and whether
pages differ there. Element names are weights in that sum; without a template a page is one slot. Kept slots are
extracted whole, with all their blocks, however short.

Templates are joined to the pages on the host, by broadcast up to BROADCAST_TOKENS tokens in all; beyond, the
pages of a hot host are dealt over salts. Both give the same rows.

Defined results: null or empty html has empty text; a page alone on its host is its own template; a page of a
host with articles that has no text in their slots is judged as if the host had none; a null URL, or one without
`://`, is of the empty host; broken markup is read as browsers do, roughly: what isn't closed ends with its
parent; repeated rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import give_back, join_counted, materialize, ship_package
from tallyspark.llm.url_filter import split_url

#: Share of a host's different pages that a tag needs to be part of its template, and that text needs; pages that text needs at least.
MIN_TAGS, MIN_TEXT, FEW_PAGES = 0.05, 0.5, 4
#: Tokens of all templates up to which they are broadcast, at about 20 bytes each.
BROADCAST_TOKENS = 500_000
#: What adds to a slot's score; it is kept above zero. The shares are of its characters on all pages of the host.
BASE, MAIN_SHARE, DIFFERS, SIDE_SHARE, LINK_SHARE, OUTSIDE_MAIN = 0.25, 1.0, 0.5, -2.0, -1.0, -1.0

RAW = "script|style|noscript|template|iframe|svg|math|textarea|title|select|object"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?:{RAW})\s*>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of these ends an open paragraph.
NO_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": "li", "dd": "dd", "dt": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
#: Elements, and words of class, id and role, of what by name isn't main text; hints that count in a slot's score.
SIDE = frozenset("nav header footer aside form head menu dialog button".split())
SIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
MAIN = frozenset(("article", "main"))


class Page:
    """Tokens of one page, each with what it is: a tag (whether a side element's), or a block (text, characters in links, side, main)."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, bool | tuple[str, int, bool, bool]]] = []
        stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, side, main
        open_tags: Counter[str] = Counter()
        buffer: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(entities.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    _, path, side, main = block[0]
                    self.tokens.append((f"{path}\x00{text}", (text, min(linked, len(text)), side, main)))
            linked = 0

        def close(tag: str) -> None:
            while True:
                top, path, side, _ = stack.pop()
                open_tags[top] -= 1
                if top not in INLINE:
                    self.tokens.append((path + "/", side))
                if top == tag:
                    return

        block = [stack[0]]  # where the block in the buffer stands
        for m in TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                if not buffer:
                    block[0] = next(x for x in reversed(stack) if x[0] not in INLINE)
                buffer.append(text)
                if open_tags["a"] > 0:
                    linked += len(text)
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                flush()
            if m["end"]:
                if open_tags[tag] > 0:
                    if tag in INLINE and any(top not in INLINE for top, *_ in stack[stack_at(stack, tag) + 1 :]):
                        flush()
                    close(tag)
                continue
            if tag in VOID:
                continue
            if tag in NO_PARAGRAPH and open_tags["p"] > 0 and self._near(stack, "p"):
                close("p")
            elif tag in ITEMS and open_tags[tag] > 0 and self._near(stack, tag):
                close(tag)
            names, role = "", ""
            if m["rest"]:
                for a in ATTRIBUTE.finditer(m["rest"]):
                    value = (a[2] or a[3] or a[4] or "").lower()
                    names += " " + value
                    role = value if a[1].lower() == "role" else role
            _, path, side, main = stack[-1]
            if tag not in INLINE:
                # numbers in names tell elements of one page apart, not kinds of elements
                # the way to the parent goes in as a hash, so a path is told whole however deep it is
                path = f"{token_hash(path)}>{tag}{re.sub('[0-9]+', '0', names)}"
            side = side or tag in SIDE or bool(names) and not SIDE_WORDS.isdisjoint(re.split("[^a-z0-9]+", names))
            main = main or tag in MAIN or role == "main"
            stack.append((tag, path, side, main))
            open_tags[tag] += 1
            if tag not in INLINE:
                self.tokens.append((path, side))
        flush()
        while len(stack) > 1:
            close(stack[-1][0])

    @staticmethod
    def _near(stack: list[tuple[str, str, bool, bool]], tag: str) -> bool:
        """Is the tag open with nothing but inline elements above it?"""
        for top, *_ in reversed(stack):
            if top == tag:
                return True
            if top not in INLINE:
                return False
        return False


def stack_at(stack: list[tuple[str, str, bool, bool]], tag: str) -> int:
    """Where the innermost open element of this tag stands."""
    return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)


def token_hash(token: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 1) - (1 << 63)


PARSED = "host string, content long, tokens array<long>, kinds array<byte>, sizes array<int>, links array<int>"
#: Kinds of tokens: a tag; a tag of a side element; a block, plus what its elements are called.
TAG, SIDE_TAG, BLOCK, IN_SIDE, IN_MAIN = 0, 1, 4, 1, 2


def numbers_of(page: Page) -> tuple[list[int], list[int]]:
    """Hashes and kinds of a page's tokens."""
    return [token_hash(t) for t, _ in page.tokens], [int(x) if isinstance(x, bool) else BLOCK + IN_SIDE * x[2] + IN_MAIN * x[3] for _, x in page.tokens]


def parsed(pages: DataFrame) -> DataFrame:
    """The tokens of each row of pages (host, html), and of blocks the characters, so that two passes need not read the markup. Texts stay where they are."""
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                tokens, kinds, sizes, links = [], [], [], []
                for source in b["html"].to_pylist():
                    page = Page(source or "")
                    for out, x in zip((tokens, kinds), numbers_of(page)):
                        out.append(x)
                    sizes.append([len(x[0]) for _, x in page.tokens if not isinstance(x, bool)])
                    links.append([x[1] for _, x in page.tokens if not isinstance(x, bool)])
                yield pa.RecordBatch.from_arrays([b["host"], b["content"], pa.array(tokens, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int8())), pa.array(sizes, pa.list_(pa.int32())), pa.array(links, pa.list_(pa.int32()))], names)
        give_back()

    return pages.select("host", F.xxhash64("html").alias("content"), "html").mapInArrow(run, PARSED)


# --- templates ----------------------------------------------------------------------------------------------


def token_statistics(pages: DataFrame) -> DataFrame:
    """host, token, kind, vector (a hash of its occurrences on all different pages), n_pages and place (the mean of the first ones) of parsed pages. Token 0 stands for the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, (tokens, kinds) in enumerate(zip(b["tokens"].to_pylist(), b["kinds"].to_pylist())):
                found, places, n = np.unique(np.array([0, *tokens], np.int64), return_index=True, return_counts=True)
                out.append((np.full(len(found), k), found, np.array([TAG, *kinds], np.int8)[places], n, places - 1))
            if out:
                row, token, kind, n, place = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([b["host"].take(pa.array(row)), b["content"].take(pa.array(row)), pa.array(token), pa.array(kind), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], ["host", "id", "token", "kind", "n", "place"])

    seen = pages.select("host", "content", "tokens", "kinds").mapInArrow(run, "host string, id long, token long, kind byte, n int, place int")
    # copies of one page count once
    once = seen.groupBy("host", "token", "id").agg(F.max("kind").alias("kind"), F.max("n").alias("n"), F.min("place").alias("place"))
    # 44 bits of the hash: sums of up to half a million pages stay within a long, and larger ones within a decimal
    vector = F.sum(F.shiftright(F.xxhash64("id", "n"), 20).cast("decimal(38,0)"))
    return once.groupBy("host", "token").agg(F.max("kind").alias("kind"), vector.alias("vector"), F.count(F.lit(1)).alias("n_pages"), F.avg("place").alias("place"))


TEMPLATE = "host string, tokens array<long>, kinds array<byte>, classes array<int>, places array<int>"


def nest(tokens: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from its tokens' statistics: the root class, valid classes within its slots, and of the others the tags."""
    classes = [c.sort_values(["place", "token"]) for _, c in tokens.groupby(tokens["vector"].astype(str), sort=True)]
    classes.sort(key=lambda c: (not (c["token"] == 0).any(), -int(c["n_pages"].iloc[0]), -len(c), int(c["token"].iloc[0])))
    borders, out = np.zeros(0), []
    for k, c in enumerate(classes):
        places, block = c["place"].to_numpy(np.float64), c["kind"].to_numpy() >= BLOCK
        root = k == 0 and bool((c["token"] == 0).any())
        valid = root or len(c) > 1 and len(set(np.searchsorted(borders, places))) == 1
        kept = c[["token", "kind"]][valid | ~block]
        kept = kept[kept["token"] != 0]
        out += [(t, kind, k, place) for place, (t, kind) in enumerate(kept.itertuples(index=False))]
        if valid:
            borders = np.sort(np.concatenate([borders, places]))
    return pd.DataFrame({"host": [tokens["host"].iloc[0]], **{name: [[int(x[k]) for x in out]] for k, name in enumerate(("tokens", "kinds", "classes", "places"))}})


class Template:
    """A host's template: its tokens in order of their hashes, with class and place in the class, and what is settled about text and slots."""

    def __init__(self, tokens, kinds, classes, places, failed=(), kept=(), kept_loosely=()):
        order = np.argsort(np.array(tokens, np.int64), kind="stable")
        self.tokens, self.kinds, self.classes, self.places = (np.array(x, np.int64)[order] for x in (tokens, kinds, classes, places))
        self.block = self.kinds >= BLOCK
        self.with_text = np.unique(self.classes[self.block])
        self.sizes = dict(zip(*np.unique(self.classes, return_counts=True)))
        self.dropped = self.block & ~np.isin(self.classes, np.array(list(failed), np.int64))
        self.kept, self.kept_loosely = np.array(sorted(kept), np.int64), np.array(sorted(kept_loosely), np.int64)

    def place(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens are in the template, and whether."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at, self.tokens[at] == tokens

    def cut(self, tokens: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a page's blocks the slots they lie in, and which of them are the template's text."""
        at, known = self.place(tokens)
        block = kinds >= BLOCK
        last = np.maximum.accumulate(np.where(known & ~block, np.arange(len(tokens)), -1)) if len(tokens) else np.zeros(0, np.int64)
        slots = np.where(last >= 0, tokens[last], 0) if len(tokens) else tokens
        return slots[block], (known & self.dropped[at] if len(self.tokens) else known)[block]

    def disordered(self, tokens: np.ndarray) -> list[int]:
        """Classes with text whose tokens don't come whole and in order on this page."""
        at, known = self.place(tokens)
        classes, places = self.classes[at[known]], self.places[at[known]]
        own = ((c, places[classes == c]) for c in self.with_text)
        return [int(c) for c, p in own if len(p) % self.sizes[c] or (p != np.arange(len(p)) % self.sizes[c]).any()]


def _template_columns(b: pa.RecordBatch, more: tuple[str, ...] = ()):
    """The template of each row of a batch; that of a host is made once."""
    made: dict[str | None, Template] = {}
    columns = [b[c] for c in ("tokens_t", "kinds_t", "classes", "places", *more)]
    for k, host in enumerate(b["host"].to_pylist()):
        if host not in made:
            made[host] = Template(*(c[k].as_py() or () for c in columns))
        yield made[host]


def _numbers(b: pa.RecordBatch, name: str, kind) -> Iterator[np.ndarray]:
    for x in b[name]:
        yield x.values.to_numpy(zero_copy_only=False).astype(kind) if x.is_valid else np.zeros(0, kind)


def slot_statistics(pages: DataFrame) -> DataFrame:
    """host, slot and its sums over parsed pages with their templates; a class that fails on a page gives a row with slot null."""
    names = ["host", "slot", "failed", "content", "chars", "links", "side", "main"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            rows = zip(b["host"].to_pylist(), _numbers(b, "tokens", np.int64), _numbers(b, "kinds", np.int64), _numbers(b, "sizes", np.int64), _numbers(b, "links", np.int64), _template_columns(b))
            for host, tokens, kinds, sizes, links, template in rows:
                for c in template.disordered(tokens):
                    out.append((host, None, c, 0, 0, 0, 0, 0))
                slots, dropped = template.cut(tokens, kinds)
                sums: dict[int, list[int]] = {}
                left, block = ~dropped, kinds >= BLOCK
                for slot, kind, token, size, link in zip(*(x.tolist() for x in (slots[left], kinds[block][left], tokens[block][left], sizes[left], links[left]))):
                    x = sums.setdefault(slot, [0, 0, 0, 0, 0])
                    x[0] = hash_pair(x[0], token)
                    for i, v in enumerate((size, link, size * (kind & IN_SIDE > 0), size * (kind & IN_MAIN > 0))):
                        x[i + 1] += v
                out += [(host, slot, None, *x) for slot, x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 8, [pa.string()] + [pa.int64()] * 7)], names)

    seen = pages.mapInArrow(run, "host string, slot long, failed long, content long, chars long, links long, side long, main long")
    sums = [F.sum(c).alias(c) for c in ("chars", "links", "side", "main")]
    return seen.groupBy("host", "slot", "failed").agg(*sums, (F.min("content") != F.max("content")).alias("differs"))


def hash_pair(h: int, token: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(token.to_bytes(8, "little", signed=True), h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def templates(pages: DataFrame) -> DataFrame:
    """host, pages and the template of each host of parsed pages, with its failed classes and its kept slots."""
    found = materialize(token_statistics(pages), "template-tokens")
    sizes = found.groupBy("host").agg(F.max(F.when(F.col("token") == 0, F.col("n_pages"))).alias("host_pages"), F.count(F.lit(1)).alias("all_tokens"))
    sizes = materialize(sizes, "hosts")
    found = join_counted(found, sizes, "host", "all_tokens")
    text = (F.col("n_pages") >= MIN_TEXT * F.col("host_pages")) & (F.col("n_pages") >= FEW_PAGES)
    tag = (F.col("n_pages") >= MIN_TAGS * F.col("host_pages")) | (F.col("kind") == SIDE_TAG)
    common = found.filter(F.when(F.col("kind") >= BLOCK, text).otherwise(tag)).select("host", "token", "kind", "vector", "n_pages", "place")
    nested = common.groupBy("host").applyInPandas(nest, TEMPLATE)
    rows = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    nested = materialize(with_key(nested).join(with_key(rows).drop("host"), "key").join(with_key(sizes).drop("host", "all_tokens"), "key"), "nested")

    slots = materialize(slot_statistics(with_templates(pages, nested)), "slots")
    failed = slots.filter("failed IS NOT NULL").groupBy("host").agg(F.collect_set("failed").alias("failed"))
    share = lambda c: F.col(c) / F.greatest("chars", F.lit(1))
    judged = with_key(slots.filter("failed IS NULL")).join(nested.select("key", "host_pages"), "key")
    inside = (share("main") >= 0.5) & (share("side") < 0.5)
    has_main = judged.groupBy("key").agg(F.max(inside).alias("has_main"))
    loose = BASE + MAIN_SHARE * share("main") + SIDE_SHARE * share("side") + LINK_SHARE * share("links") + F.when(F.col("differs") | (F.col("host_pages") == 1), DIFFERS).otherwise(0.0)
    judged = judged.join(has_main, "key").withColumn("loose", loose).withColumn("score", F.col("loose") + F.when(F.col("has_main") & (share("main") < 0.5), OUTSIDE_MAIN).otherwise(0.0))
    kept = judged.groupBy("key").agg(F.collect_list(F.when(F.col("score") > 0, F.col("slot"))).alias("kept"), F.collect_list(F.when(F.col("loose") > 0, F.col("slot"))).alias("kept_loosely"))
    return nested.join(with_key(failed).drop("host"), "key", "left").join(kept, "key", "left")


def with_key(df: DataFrame) -> DataFrame:
    """df with a key of host that is never null."""
    return df.withColumn("key", F.coalesce("host", F.lit("")))


def with_templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Parsed pages, each with the template of its host."""
    table = found.drop("host").withColumnsRenamed({"tokens": "tokens_t", "kinds": "kinds_t"})
    size = found.agg(F.sum(F.size("tokens") + 10)).first()[0] or 0
    if size <= BROADCAST_TOKENS:
        return with_key(pages).join(F.broadcast(table), "key")
    return join_counted(with_key(pages), table, "key", "pages")


def main_text(tokens: np.ndarray, kinds: np.ndarray, texts: list[str], template: Template) -> str:
    """The text of the kept slots of a page, in page order."""
    slots, dropped = template.cut(tokens, kinds)
    for kept in (template.kept, template.kept_loosely):
        out = [t for t, take in zip(texts, np.isin(slots, kept) & ~dropped) if take]
        if out:
            break
    return " ".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), split_url(F.col("url"))[0].alias("host"), "html")
    found = materialize(templates(materialize(parsed(rows), "parsed-pages")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, template in zip(b["html"], _template_columns(b, ("failed", "kept", "kept_loosely"))):
                page = Page(source.as_py() or "")
                tokens, kinds = (np.array(x, np.int64) for x in numbers_of(page))
                texts.append(main_text(tokens, kinds, [x[0] for _, x in page.tokens if not isinstance(x, bool)], template))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])
        give_back()

    return with_templates(rows, found).mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))

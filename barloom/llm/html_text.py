"""Main text of web pages by the consensus of their host (operator 6).

A first pass reads every page into blocks of text, and each block stands at a path: the tags with their
class names from the root down, numbers removed, kept as a 64-bit hash of the parent's path and the own
label. Spark counts over all pages of a host which texts stand at a path and how often. A path at which
the same texts come again and again, while those of the host's main path do not, is furniture: a site's
line, a promotion, whatever its class is called. Every container then has a score, the share of the
host's other text that it holds, times how little of what it holds is furniture, links or left out by tag or
name, times a little for depth and for `article` and `main`. The best containers of a host are its winning
paths. A second pass extracts each page from the first winning path that it has, without the blocks at
furniture paths; a page with none of them uses its own best container.

Inside the container, menus, footers, side matter, notices, adverts, forms, scripts, styles and
reader comments are left out, by tag or by a class, id or role that is made of furniture words and
neutral ones (`site-footer`, not `comment-policy-news`); of headers only headings stay. Character
references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
in page order by an empty line; `br` counts as white space. Nothing else is dropped.

Pages are read in one pass whose time grows with the page alone, however deep or broken it is: a
quote that never closes is an ordinary character, a tag that never closes is text.

A null or empty page, or one without such text, gives the empty string. A page with a null url
counts to the host named by the empty string. Every row gives a row.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style textarea title xmp iframe noembed noframes".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
SKIP_TAGS = frozenset("nav footer aside form script style noscript template button select textarea svg iframe object canvas dialog menu head title".split())
SKIP_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager toolbar masthead topbar copyright widget skip".split()
)
NEUTRAL_WORDS = frozenset("site page main top bottom left right upper lower inner outer global primary secondary box block bar wrap wrapper container content list item items section area region panel group row col column links buttons form js div header head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What holds text but is no container.
NO_CONTAINER = INLINE | HEADINGS | frozenset("p li ul ol pre tr td".split())
#: What a level of depth adds to a container's score, five levels at most.
DEEPER = 0.06
#: A start tag on the left closes an open element of those on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"""(>)|=\s*+(["'])""")
NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*|[^\W\d_]+")


@lru_cache(1 << 12)
def kind_of(name: str) -> str:
    """"all" for a class, id or role that is made of furniture words and neutral ones, "header" for a header's."""
    words = {w.lower() for w in WORDS.findall(name)}
    if words <= SKIP_WORDS | NEUTRAL_WORDS and words & SKIP_WORDS:
        return "all"
    return "header" if "header" in words and words <= NEUTRAL_WORDS else ""


class Element:
    __slots__ = ("bad", "block", "depth", "good", "link", "lost", "outer", "parent", "path", "skipped", "tag")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.parent = tag, parent
        names = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in NAMES.finditer(attributes)} if "=" in attributes else {}
        classes = sorted({re.sub(r"\d+", "", c) for c in names.get("class", "").split()} - {""})
        label = f"{parent.path if parent else 0:x}/{'.'.join([tag, *classes])}"
        self.path = xxhash.xxh64_intdigest(label) >> 1  # fits a signed long
        kinds = {kind_of(name) for said in names.values() for name in said.split()} if tag not in ("body", "html", "article", "main") else set()
        kinds.add("all" if tag in SKIP_TAGS else "header" if tag == "header" else "")
        kinds.add(parent.skipped if parent else "")
        self.skipped = "all" if "all" in kinds else "header" if "header" in kinds else ""
        self.link = tag == "a" or bool(parent and parent.link)
        self.block: Element = parent.block if parent and tag in INLINE else self  # the nearest that is not inline
        self.depth = parent.depth + 1 if parent else 0
        self.good = self.bad = 0  # running text, and links and furniture
        self.outer: Element = parent.outer if parent and self.skipped == "all" else self  # the nearest that is not left out
        self.lost = 0  # characters that are left out right below it

    @property
    def container(self) -> bool:
        return not self.skipped and self.tag not in NO_CONTAINER

    @property
    def weight(self) -> float:
        return (1 + DEEPER * min(self.depth, 5)) * (1.3 if self.tag in ("article", "main") else 1)


class Page:
    """All elements in page order, and the blocks with the element that each stands in."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.at = Element("#page", "", None)
        self.elements, self.blocks = [self.at], []
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.linked = 0
        self._read()
        self._flush()
        for e in reversed(self.elements[1:]):  # children stand behind their parents
            e.parent.good += e.good
            e.parent.bad += e.bad

    def _tag_end(self, at: int) -> int:
        """The place of the > that closes a tag; -1 if nothing does. Once quotes fail to lead to one, they count no more."""
        place = at
        while self.quotes:
            m = STOP.search(self.page, place)
            if m is None:
                self.quotes = False
            elif m[1]:
                return m.start()
            else:
                close = self.page.find(m[2], m.end())
                place = m.end() if close < 0 else close + 1
        return self.page.find(">", at)

    def _flush(self) -> None:
        if self.text:
            block = " ".join(html.unescape("".join(self.text)).split())
            if block:
                owner = self.at.block
                kept = owner.skipped == "" or owner.skipped == "header" and owner.tag in HEADINGS
                if kept:
                    self.blocks.append((owner, block, min(len(block), self.linked)))
                else:
                    owner.outer.lost += len(block)
                bad = min(len(block), self.linked) if kept else len(block)
                owner.good += len(block) - bad
                owner.bad += bad
            self.text.clear()
            self.linked = 0

    def _add(self, piece: str) -> None:
        if not piece:
            return
        if self.at.skipped == "all":
            self.at.bad += len(piece.strip())
            self.at.outer.lost += len(piece.strip())
        else:
            self.text.append(piece)
            if self.at.link:
                self.linked += len(piece)

    def _close(self, upto: Element) -> None:
        while self.at is not upto.parent:
            if self.at.tag not in INLINE:
                self._flush()
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _end_tag(self, tag: str) -> None:
        if self.open[tag] > 0:
            up = self.at
            while up.tag != tag:
                up = up.parent
            self._close(up)
        elif tag not in INLINE:
            self._flush()

    def _start_tag(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
            shut = CLOSES.get(tag, frozenset()) | {"p"}
            if any(self.open[t] > 0 for t in shut):
                up = self.at
                while up.parent is not None and up.tag not in shut and up.tag in INLINE:
                    up = up.parent
                if up.tag in shut:
                    self._close(up)
        if tag in VOID:
            return
        child = Element(tag, attributes, self.at)
        self.elements.append(child)
        if not (attributes.endswith("/") and tag in ("path", "g", "circle", "rect", "use")):
            self.at = child
            self.open[tag] += 1

    def _read(self) -> None:
        page, place, said = self.page, 0, 0  # said: up to where text has been added
        while True:
            at = page.find("<", place)
            if at < 0:
                break
            m = TAG.match(page, at)
            if m is None and page[at + 1 : at + 2] not in ("!", "?"):
                place = at + 1
                continue
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 2
            else:
                end = self._tag_end(m.end()) if m else page.find(">", at)
                if end < 0:  # nor will any later tag close
                    break
            self._add(page[said:at])
            place = said = end + 1
            if m is None:
                continue
            tag = m[1].lower()
            if page[at + 1] == "/":
                self._end_tag(tag)
            elif tag == "br":
                self._add(" ")
            elif tag in RAW:
                shut = RAW[tag].search(page, place)
                place = said = shut.end() if shut else len(page)
            else:
                self._start_tag(tag, page[m.end() : end].rstrip())
        self._add(page[said:])

    def container_scores(self) -> dict[int, float]:
        """Scores of the containers by generalised path; 0 to about 1.5."""
        whole = self.elements[0].good
        out: dict[int, float] = {}
        if whole:
            for e in self.elements:
                if e.good * 4 >= whole and e.container:
                    score = e.good / whole * (e.good / (e.good + e.bad)) * e.weight
                    out[e.path] = out.get(e.path, 0.0) + score
        return out

    def extract(self, paths: list[int], furniture: frozenset[int] = frozenset()) -> str:
        """The text under the first of `paths` that the page has, or under its own best container."""
        there = {e.path for e in self.elements}
        chosen = next((p for p in paths if p in there), None)
        if chosen is None:
            own = self.container_scores()
            chosen = max(own, key=lambda p: (own[p], p)) if own else self.elements[0].path
        inside = set()
        for e in self.elements:  # parents first
            if e.path == chosen or e.parent is not None and id(e.parent) in inside:
                inside.add(id(e))
        return "\n\n".join(block for owner, block, _ in self.blocks if id(owner) in inside and owner.path not in furniture)

    def chain(self, e: "Element") -> list[tuple[int, float]]:
        """The containers around an element, itself included, with their weights; of a path that comes twice the outer one."""
        found: dict[int, float] = {}
        while e is not None:
            if e.container:
                found[e.path] = e.weight
            e = e.parent
        return list(found.items())


def host_of(url: str = "url") -> F.Column:
    """The host in small letters, without user and port."""
    authority = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


ROWS = "host string, path long, text long, above array<struct<path: long, weight: double>>, n long, chars long, links long, lost long"
#: Pages on which a text of furniture is, on average, and how many times as many that is as at the main path.
AGAIN, OFTENER = 4, 4


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch each text at each path of a host, and each path with the containers around it and what is left out
    there. The root, which all pages have, counts the pages."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("path", pa.int64()), ("weight", pa.float64())])), *[pa.int64()] * 4]
    names = [c.split()[0] for c in ROWS.split(", ") if not c.startswith("weight")]
    for batch in batches:
        texts: dict[tuple, list[int]] = {}
        places: dict[tuple, list] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = Page(source.as_py())
            mine = set()  # a text counts once a page, however often it stands there
            for owner, block, linked in page.blocks:
                key = (host, owner.path, xxhash.xxh64_intdigest(block) >> 1)
                held = texts.setdefault(key, [0, 0, 0])
                held[0] += key not in mine
                mine.add(key)
                held[1] += len(block)
                held[2] += linked
            for e in {id(e): e for e in [page.elements[0], *(b[0] for b in page.blocks), *(e for e in page.elements if e.lost)]}.values():
                place = places.get((host, e.path))
                if place is None:
                    place = places[host, e.path] = [page.chain(e), 0, 0]
                place[1] += e.parent is None
                place[2] += e.lost
        rows = [(h, p, t, None, *held, 0) for (h, p, t), held in texts.items()]
        rows += [(h, p, None, [{"path": q, "weight": w} for q, w in above], n, 0, 0, lost) for (h, p), (above, n, lost) in places.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def host_paths(pages: DataFrame, scratch: Scratch, most: int = 5) -> DataFrame:
    """host, the hashes of its `most` best paths, best first, and those of its furniture: a row a host.

    Furniture stands on a hundredth of a host's pages at least, so a host has no more of it than a hundred pages.
    """
    read = pages.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    seen = scratch.keep(read.mapInArrow(_observe, ROWS), "seen")
    total = lambda c: F.sum(c).alias(c)
    texts = seen.where("text is not null").groupBy("host", "path", "text").agg(total("n"), total("chars"), total("links"))
    by_path = texts.groupBy("host", "path").agg(total("n"), F.count("*").alias("different"), total("chars"), total("links"))
    places = seen.where("text is null").groupBy("host", "path").agg(F.max("above").alias("above"), total("lost"), F.sum("n").alias("pages"))
    known = scratch.keep(places.join(by_path, ["host", "path"], "left").na.fill(0, ["n", "different", "chars", "links"]), "known")
    fresh = F.try_divide(F.col("different"), F.col("n"))
    main = known.groupBy("host").agg(F.max_by(fresh, F.struct((F.col("chars") - F.col("links")) * fresh, "path")).alias("main"), F.sum("pages").alias("host_pages"))
    judged = known.join(main, "host")
    repeats = (F.col("n") >= AGAIN * F.col("different")) & (F.col("n") * 100 >= F.col("host_pages")) & (fresh * OFTENER <= F.col("main"))
    judged = scratch.keep(judged.withColumn("furniture", F.coalesce(repeats, F.lit(False))), "judged")
    # whole numbers, so that the order of the sums makes no difference
    good = F.when(F.col("furniture"), 0).otherwise(F.col("chars") - F.col("links"))
    held = judged.select("host", good.alias("good"), (F.col("chars") + F.col("lost")).alias("whole"), F.explode("above").alias("a"))
    of_container = held.groupBy("host", F.col("a.path").alias("path")).agg(total("good"), total("whole"), F.max("a.weight").alias("weight")).where("good > 0")
    # a host's whole good text is the same for all of its containers, so the share is the good text itself
    score = F.round(F.col("good") * F.col("good") / F.col("whole") * F.col("weight"), 3)
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc(score), "path"))
    best = of_container.withColumn("place", place).where(F.col("place") <= most)
    winners = best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("found")).select("host", F.col("found.path").alias("paths"))
    furniture = judged.where("furniture").groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("furniture"))
    return scratch.keep(winners.join(furniture, "host", "full_outer"), "paths")


#: Parts of one host's pages.
SALTS = 32


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    found = host_paths(pages, Scratch(pages.sparkSession, "html-text"))

    @F.pandas_udf("string")
    def text(page: pd.Series, paths: pd.Series, furniture: pd.Series) -> pd.Series:
        listed = lambda x: [] if x is None else list(x)
        return pd.Series([Page(a).extract(listed(b), frozenset(listed(c))) for a, b, c in zip(page, paths, furniture, strict=True)], dtype=object)

    # a host's row goes out SALTS times, so that no task gets all pages of a host where the rows are not broadcast
    copies = found.withColumn("salt", F.explode(F.array([F.lit(i).cast("long") for i in range(SALTS)])))
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    salted = read.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    joined = salted.join(copies, ["host", "salt"], "left").select("page_id", "url", text("html", "paths", "furniture").alias("text"))
    return joined.withColumn("n_chars", F.char_length("text").cast("long"))

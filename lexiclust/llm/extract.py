"""Main text of HTML pages as a maximum-scoring subsequence.

A page is a sequence of tags and words. Words score by where they stand (the
nearest enclosing element that says something about its content), tags cost;
both weights are log odds counted on labelled pages: those whose content is
marked by one ``article`` element. A linear scan finds the contiguous region
with the best score, and its words outside menus, adverts, forms and the like
are the main text. An article, and whatever stands around one, is never left out
for its name, class, id or role.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import Shared, bounded_sample, chunks

TRAIN_PAGES = 2000  # labelled pages learnt from, at most about this many
MAX_PLACES = 5000  # kinds of elements the model knows
MIN_COUNT = 20  # words of a kind before its odds count
CLIP = 2.0
TAG_COST = 0.05

# HTML element names and the words of classes, ids and roles that name a part
# of a page (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg xmp noembed noframes".split())
BLOCKS = set("""address article aside blockquote body br button caption center dd details dialog dir
div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html
legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr
ul""".split())
CLOSES_P = BLOCKS - {"br", "button", "option", "select"}
CONTENT = {"article", "main"}
NO_CONTENT = set("""nav header footer aside form button select dialog menu fieldset head object
applet canvas audio video map label option datalist""".split())
NO_CONTENT_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo
promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
subscribe subscription signup login share sharing social sidebar widget widgets related recommended
recommendations comment comments commentlist disqus reply replies respond nav navbar navigation menu
menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar copyright search
skip contentinfo complementary tooltip""".split())
CONTENT_WORDS = set("article content entry main post story body text title".split())
# Words that say nothing of their own beside those ("share-buttons", "comments-area").
NEUTRAL_WORDS = set("""area bar block box button buttons container form item items link links list
posts section slot unit wrap wrapper""".split())
PRIOR = -0.5  # score of a word where only the first or last part of a class word is such a word

_TAG = re.compile(
    r"<(?:!--(?:-?>|(?P<note>.*?)(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?P<close>>|\Z))", re.S)  # quotes open behind = alone
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\W_]+")


@dataclass(eq=False)
class Place:
    """An element, with what is known of those that it stands in; ``kinds`` name
    it if it says something about content."""

    name: str
    kinds: list[str] = field(default_factory=list)
    dropped: bool = False  # named as no content by its element
    named: list[str] = field(default_factory=list)  # kinds whose whole word is no content
    prior: float = 0.0  # what a part of a class word says, where no weight is learnt
    holds: bool = False  # an article or main element, or one stands inside
    parent: Place | None = None
    article: Place | None = None  # the outermost article around it, or itself
    main: Place | None = None  # likewise of main elements
    below_dropped: bool = False  # stands in an element that is dropped
    telling: Place | None = None  # the nearest element with kinds, or itself
    passed: bool = False  # all that it stands in are known to hold an article

    def put_in(self, parent: Place | None) -> Place:
        self.parent = parent
        if parent is not None:
            self.article, self.main, self.telling = parent.article, parent.main, parent.telling
            self.below_dropped = parent.below_dropped or parent.dropped
        if self.article is None and self.name == "article":
            self.article = self
        if self.main is None and (self.name == "main" or "main" in self.kinds):
            self.main = self
        if self.kinds:
            self.telling = self
        return self

    def around_hold(self) -> None:
        """Mark all elements that it stands in, up to one from which it is done."""
        at = self
        while not at.passed:
            at.passed = True
            if at.parent is None:
                return
            at = at.parent
            at.holds = True


def _place(name: str, attrs: str) -> Place:
    kinds = [name] if name in CONTENT or name in NO_CONTENT or name in ("body", "section") else []
    named, prior = [], 0.0
    if "=" in attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            for token in (a or b or c).lower().split():
                kinds.append(f"{name}.{token}")
                words = [w for w in _WORD.findall(token) if w not in NEUTRAL_WORDS
                         and not any(c.isdigit() for c in w)]
                if words == ["header"] or words and NO_CONTENT_WORDS.issuperset(words):
                    named.append(kinds[-1])
                elif words and (not NO_CONTENT_WORDS.isdisjoint((words[0], words[-1]))
                                or "header" in words and CONTENT_WORDS.isdisjoint(words)):
                    prior = PRIOR
            if key.lower() == "role" and (a or b or c).lower() == "main":
                kinds.append("main")
    if name in ("body", "html"):
        return Place(name, kinds)
    return Place(name, kinds, name in NO_CONTENT, named, prior,
                 name in CONTENT or "main" in kinds)


def events(page: str) -> Iterator[tuple[str, str, Place | None]]:
    """``("text", text, place)`` and ``("tag", name, place)`` in page order;
    ``place`` is the innermost open element. Time is linear in the page,
    however deep its elements stand."""
    stack: list[Place] = []
    opened: Counter = Counter()  # open elements by name
    at, n = 0, len(page)

    def close_to(name: str) -> None:
        while True:
            gone = stack.pop().name
            opened[gone] -= 1
            if gone == name:
                return

    while at < n:
        top = stack[-1] if stack else None
        tag = _TAG.search(page, at)
        if tag is None:
            yield "text", page[at:], top
            return
        if tag.start() > at:
            yield "text", page[at:tag.start()], top
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name or (not tag["close"] and at >= n):
            continue  # a comment, a declaration, or a tag cut off by the end
        if tag["end"]:
            if opened[name] > 0:
                close_to(name)
            yield "tag", name, stack[-1] if stack else None
            continue
        if name in CLOSES_P and any(p.name == "p" for p in stack[-3:]):
            close_to("p")
        top = stack[-1] if stack else None
        yield "tag", name, top
        if name in RAW and not tag["attrs"].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            yield "tag", name, top
        elif name not in VOID and not tag["attrs"].endswith("/"):
            stack.append(_place(name, tag["attrs"]).put_in(top))
            opened[name] += 1


def around_articles(page: str) -> Iterator[tuple[str, str, Place | None]]:
    """``events``; at the end every element that has an article or main element
    inside is marked. An article in another one (a comment, a teaser) marks
    nothing, nor one that is itself named as no content or stands in an aside or
    the like, unless all do."""
    lesser: list[Place] = []
    marked, outer = False, None
    for what, value, place in events(page):
        yield what, value, place
        found = place and (place.article or place.main)
        if found is None or found is outer:
            continue
        outer = found
        if outer.named or outer.below_dropped:
            lesser.append(outer)
        else:
            marked = True
            outer.around_hold()
    if not marked:
        for found in lesser:
            found.around_hold()


def places(page: str) -> Counter | None:
    """``(what, kind, inside)`` counts of a labelled page: words by the kinds of
    the elements they stand in, and tags, in and out of its one ``article``.
    None for a page that has none or several."""
    out: Counter = Counter()
    articles, last = 0, False
    for what, value, place in events(page):
        inside = place is not None and place.article is not None
        if inside and not last:
            articles += 1
        last = inside
        if what == "tag":
            out["tag", value, inside] += 1
        elif place is not None and place.telling is not None:
            n = len(value.split())
            for kind in place.telling.kinds:
                out["word", kind, inside] += n
    return out if articles == 1 else None


class RegionModel:
    """Weights of words by kind of place and of tags by name."""

    def __init__(self, counts: dict[tuple[str, str, bool], int]):
        self.words: dict[str, float] = {}
        self.tags: dict[str, float] = {}
        for what, kind in {(w, k) for w, k, _ in counts}:
            inside, outside = counts.get((what, kind, True), 0), counts.get((what, kind, False), 0)
            odds = max(-CLIP, min(CLIP, math.log((inside + 0.5) / (outside + 0.5))))
            if what == "word" and inside + outside >= MIN_COUNT:
                self.words[kind] = odds
            elif what == "tag":
                self.tags[kind] = -TAG_COST * (1 + CLIP - odds)

    def dropped(self, place: Place, held: bool) -> bool:
        """Whether an element is left out whole: named as no content, unless an
        article stands in it or, for its words, a learnt weight says otherwise
        (not inside an article, where all weights are those of content)."""
        return not place.holds and (place.dropped or any(
            held or self.words.get(kind, -1.0) <= 0 for kind in place.named))

    def _known(self, place: Place) -> list[float]:
        return [self.words[k] for k in place.kinds if k in self.words and k != "body"]

    def _state(self, place: Place | None, priors: bool, memo: dict[int, tuple]) -> tuple:
        """Whether an article or main element holds the place, whether something
        around it is left out (where none holds it, and where one does), and the
        nearest element that says something; each element is looked at once."""
        chain: list[Place] = []
        while place is not None and id(place) not in memo:
            chain.append(place)
            place = place.parent
        state = (False, False, False, None) if place is None else memo[id(place)]
        for p in reversed(chain):
            held, out_free, out_held, says = state
            if p.name in CONTENT or self._known(p) or priors and p.prior and not p.holds:
                says = p
            state = (held or p.name in CONTENT, out_free or self.dropped(p, False),
                     out_held or self.dropped(p, True), says)
            memo[id(p)] = state
        return state

    def weight(self, place: Place | None, priors: bool, memo: dict[int, tuple]) -> tuple[float, bool]:
        """Score of one word here, and whether it may be main text. The nearest
        element that is known decides; inside an article or main element what is
        no content weighs nothing, as it does not end the region."""
        held, out_free, out_held, says = self._state(place, priors, memo)
        if out_held if held else out_free:
            return (0.0 if held else -1.0), False
        if says is None:
            return 0.5, True
        if says.name in CONTENT:
            return max(1.0, self.words.get(says.name, CLIP)), True
        known = self._known(says)
        if known and min(known) < 0:
            return (0.0 if held else min(known)), False
        if known:
            return max(known), True
        return (0.0 if held else says.prior), True

    def extract(self, page: str | None) -> str:
        """The main text: blocks joined by a line break, white space inside a
        block as one space, character references decoded."""
        if not page:
            return ""
        # Read to the end first: what stands around an article is known by then.
        seen = list(around_articles(page))
        pieces, span = self._scan(seen, True)
        if span == (0, 0):  # nothing but what parts of class words speak against
            pieces, span = self._scan(seen, False)
        blocks: list[str] = []
        now: list[str] = []
        for name, text in pieces[span[0]:span[1]]:
            if text is not None:
                now.append(text)
            elif name in BLOCKS or name in RAW:
                blocks.append("".join(now))
                now = []
        blocks.append("".join(now))
        return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)

    def _scan(self, seen: list[tuple[str, str, Place | None]],
              priors: bool) -> tuple[list[tuple[str, str | None]], tuple[int, int]]:
        """The page's pieces (tags, and texts by whether they may be main text)
        and the contiguous region of them with the best sum."""
        # The scan: best sum so far and where it began.
        best, total, begin, span = 0.0, 0.0, 0, (0, 0)
        pieces: list[tuple[str, str | None]] = []
        memo: dict[int, tuple] = {}
        for what, value, place in seen:
            if what == "tag":
                total += self.tags.get(value, -TAG_COST)
                pieces.append((value, None))
            else:
                score, kept = self.weight(place, priors, memo)
                text = html.unescape(value)
                total += score * len(text.split())
                pieces.append((value, text if kept else ""))
            if total <= 0:
                total, begin = 0.0, len(pieces)
            elif total > best:
                best, span = total, (begin, len(pieces))
        return pieces, span


def fit(pages: DataFrame, key: str = "page_id", page: str = "html",
        train_pages: int = TRAIN_PAGES, max_places: int = MAX_PLACES) -> RegionModel:
    """Weights from labelled pages. The sample is bounded by ``train_pages`` (by
    hash of the key, the same for any partitioning), the model by its most
    frequent ``max_places`` kinds. Pages without one article teach nothing;
    without any labelled page every place but the named ones scores alike."""
    sample = bounded_sample(pages.where(F.col(page).isNotNull())
                            .select(F.col(key).alias("_key"), F.col(page).alias("_page")),
                            F.col("_key"), train_pages)
    kind = pa.struct([("what", pa.string()), ("kind", pa.string()), ("inside", pa.bool_()),
                      ("n", pa.int64())])

    @F.arrow_udf("array<struct<what:string,kind:string,inside:boolean,n:bigint>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [[{"what": w, "kind": k, "inside": i, "n": n}
                     for (w, k, i), n in (places(t) or {}).items()]
                    for part in chunks(texts) for t in part]
            yield pa.array(rows, type=pa.list_(kind))

    counts = sample.select(F.explode(counted("_page")).alias("c")).select("c.*")
    counts = counts.groupBy("what", "kind", "inside").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "what", "kind", "inside").limit(2 * max_places).collect()
    return RegionModel({(r["what"], r["kind"], r["inside"]): r["n"] for r in rows})


def extract(pages: DataFrame, model: RegionModel, page: str = "html",
            out: str = "main_text") -> DataFrame:
    """``pages`` with a string ``out``: the main text of the whole page, empty
    if there is none. A null or empty page is empty; repeated pages give the
    same text. All other columns stay; a column already named ``out`` is
    replaced."""
    shared = Shared(pages.sparkSession, model)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.build(lambda value: value)
        for texts in batches:
            yield pa.array([m.extract(t) for part in chunks(texts) for t in part], pa.string())
    return pages.withColumn(out, text(F.col(page)))

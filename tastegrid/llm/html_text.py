"""Main text of HTML pages from flat text blocks and a decision tree.

A page is cut into flat blocks of text: block-level tags end a block, inline tags do not, <br> is white space; a link
goes on through the blocks that it holds.
Each block has its word count and link density, those of its two neighbours, and marks of the elements around
it. A decision tree, trained on a small labelled table of blocks, says which blocks are main text. Their
character references are decoded, white space becomes one space, and they are joined in page order.

Cases: null or empty HTML, and a page without main text, give the empty string; unclosed and misnested tags
close at the next tag that ends their block; a very long page is one row and its blocks are held once; an unclosed script, style or comment takes the rest of the page;
repeated rows are read alike; an empty table gives an empty result; extra columns pass through, but the HTML and columns
named as the two outputs, which go.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from .common import parts, released

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: HTML element names by their part in a page (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style noscript template textarea iframe object svg math canvas noframes title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside header form menu dialog button select fieldset option datalist head".split())
MAIN_TAGS = frozenset("article main".split())
SELF_CLOSING = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words in class, id or role that tell page furniture (fixed values).
FURNITURE = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation topnav subnav menu "
    "breadcrumb breadcrumbs sidebar sidebars aside rail footer foot header masthead topbar cookie cookies consent notice notices gdpr alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist discussion reply replies respond disqus "
    "widget widgets toolbar pagination pager login search searchbox copyright legal disclaimer skip complementary contentinfo dialog tags tagcloud form".split()
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    raw: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    chrome: bool = False
    main: bool = False
    heading: bool = False
    item: bool = False


def _marks(attributes: str) -> bool:
    """Whether the attributes tell page furniture or hidden content."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id", "role") and any(w in FURNITURE for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page that hold a word."""
    # frames of open elements: tag, furniture by tag, furniture by name, inside main text, heading, list item
    frames: list[tuple[str, bool, bool, bool, bool, bool]] = [("", False, False, False, False, False)]
    out: list[Block] = []
    # links: how many elements were open where the open link began, 0 for none; it ends with </a> or with the last of them
    now, links, at = Block(), 0, 0

    def flush():
        nonlocal now
        if now.words:
            _, tag, name, now.main, now.heading, now.item = frames[-1]
            now.chrome = tag or name
            out.append(now)
        now = Block() if now.raw else now

    def add(text: str):
        if text:
            now.raw.append(text)
            n = len(text.split())
            now.words += n
            now.linked += n if links else 0

    while True:
        m = TOKEN.search(page, at)
        if not m:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not close:
            if not (attributes or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "a":
            links = 0 if close else len(frames)
        elif tag == "br":
            now.raw.append("\n")
        elif tag in INLINE:
            continue
        elif tag in VOID:
            flush()
        elif close:
            flush()
            if any(f[0] == tag for f in frames):
                while frames.pop()[0] != tag:
                    pass
                links = links if links <= len(frames) else 0
        else:
            flush()
            if tag in SELF_CLOSING and frames[-1][0] in ("p", tag):
                frames.pop()
                links = links if links <= len(frames) else 0
            if tag == "body":
                frames = frames[:1]
            _, by_tag, by_name, inside, _, item = frames[-1]
            if tag in MAIN_TAGS:
                frames.append((tag, by_tag, _marks(attributes), True, False, False))
            else:
                frames.append((tag, by_tag or tag in CHROME_TAGS, by_name or _marks(attributes), inside, tag in HEADINGS, item or tag == "li"))
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """A row per block: furniture, in main, words and link density of the block, the one before, the one after,
    heading, list item."""
    density = [b.linked / b.words for b in page]
    size = [b.words for b in page]
    around = lambda v, i: v[i] if 0 <= i < len(v) else 0.0
    return np.array([[b.chrome, b.main, size[i], density[i], around(size, i - 1), around(density, i - 1), around(size, i + 1), around(density, i + 1), b.heading, b.item] for i, b in enumerate(page)], dtype=float).reshape(len(page), 10)


#: The labelled table: pages whose blocks begin with + (main text) or - (not).
LABELLED = (
    "<nav><ul><li><a>-Home</a></li><li><a>-World</a></li><li><a>-Science and nature</a></li></ul></nav><article><h1>+A long day at the harbour</h1><p>+The boats came in late and the town waited on the quay for news of them.<p>+Nobody spoke.</p><p>+By night all but one had been counted, and the last was seen off the point.</p></article><footer>-Contact the newsroom of the harbour paper by letter</footer>",
    "<header><a>-The Daily Field</a><p>-News from the country since long ago and every day</p></header><div class=ad>-Buy two lamps and get one lamp free this week only</div><main><h2>+Sowing</h2><p>+Wait for rain.</p><ul><li>+Beans first</li><li>+Peas after the frost has gone</li></ul><p>+Yes.</p></main><aside><h3>-Read more</h3><a>-Ten tools for the garden</a><p>-Our writers choose what they like best in the shops this spring</p></aside>",
    "<div id=menu><a>-Start</a><a>-Shop</a></div><div><p>+The committee met on Monday to hear what the engineers had found under the old bridge, and it asked for a second survey before the winter.</p><p>+No date was named, but the chair said that the money had been set aside and that work could start in spring.</p></div><div><a>-Next</a></div><p>-Share</p><div class=cookie-notice>-We use small files to remember you and to count our readers each day</div>",
    "<article><p>+One</p><div class=advert>-Cheap flights to the sun from every town</div><p>+<a>The report itself</a></p><p>+It was read by all of them and then put back on the shelf.</p><section class=comments><h3>-Comments</h3><p>-I do not agree with this piece at all and I will say why below</p><p>-Nice</p></section></article>",
    "<form><label>-Your name and address so that we can write to you</label><button>-Send</button></form><article><h1>+Title</h1><p>+Short.</p><form><p>-Subscribe to the letter that we send to all our readers on Sunday</p></form><p>+Then it ended as it had begun, with a song that everyone knew by heart and sang.</p></article>",
    "<p><a>-Log in</a></p><p>-Menu</p><h1>-Site</h1><div><p>+When the snow melts the river carries the sand of the upper valley down to the plain, where the fields are sown a month after.</p><p>+In some years it comes early, and then the mills stand still until the water has fallen again to the mark on the wall.</p><p>+That is why the houses here have no cellars and why the roads run on banks above the meadows and the ditches.</p></div><p><a>-Back to top of page</a> -now</p><p>-All times local</p>",
    "<div class=sidebar><p>-This week the shop has new books on rivers and mountains and on the people who live there and what they eat.</p></div><article><p>+Old</p><p>+New</p><p>+<a>Link</a> <a>Link</a></p></article><div id=footer><p>-The owner of this site is not bound by what the guests of the house may write or say in it.</p></div>",
    "<nav><a>-One page of the long list of pages that we have made for you</a></nav><main><p>+x</p></main><nav><p>-A</p></nav><footer><p>-B</p></footer>",
    "<div><a>-Sign up</a> <a>-Help</a></div><div><a>-First story of the day in short</a></div><div><a>-Second story of the day in short and more</a></div><p>-12 May</p>",
    "<article><h1>+The mill</h1><p>+It stood at the bend of the river for two hundred years and ground the corn of all the farms around it.</p><div class=related><a>-Another mill in the next valley over</a></div><p>+<a>See the map of mills</a></p>"
    "<ul class=share><li><a>-Share</a></li><li><a>-Send by post</a></li></ul><p>+Then the dam was raised and the wheel never turned again, though the stones are there.</p><nav><a>-Part one</a> <a>-Part two</a></nav><aside><a>-More of the same kind for you</a></aside></article><footer><a>-About us</a></footer>",
    "<div class=ad>-A lamp for every room and a room for every lamp</div><article><h1>+Nine things that the miller knew of the water and the wheel</h1><p>+He wrote none of it down.</p><h2>+The first of them, which is also the one that he told to all who asked</h2><p>+Listen.</p><h2>+Stone</h2><p>+It wears.</p><h3>+Ice and what it does</h3><p>+Wait for it.</p>"
    "<h2>+The mill pond</h2><p>+It was dug by the sons of the second miller in one dry summer and lined with clay that they brought down from the upper field on a sledge with two oxen.</p><h2>+Fish</h2><p>+There were carp in it, which were sold before the feast, and eels that no one had put there and that came up the stream by night when it rained for long enough.</p><h2>+And the end of it</h2><p>+When the wheel stood still the pond was let out through the lower gate, and in the mud they found the ring, the bell of a sheep and the first stone.</p></article>"
    "<p>-Made in the north</p>",
    "<p>-Set in type by hand and sent out each month</p><main><h1>+A short guide to the knots that are used on river boats</h1><h2>+Before you begin to tie</h2><p>+Wet the rope.</p><h2>+The loop</h2><p>+Over and under, then through.</p><h2>+The hitch that holds on a wet post when all others slip</h2><p>+Twice around.</p></main><p>-Of use to all</p>",
    # from here on pages whose elements tell nothing
    "<div><a>-Start</a> <a>-Archive</a></div><h1>+How the old bell came back to the tower</h1><p>+It had been sunk in the lake so that no soldier could melt it, and those who knew the place had died in the war or moved away.</p><h2>+The second bell</h2><p>+A fisherman found it when his net caught on the crown, and for a week he told no one but his wife.</p>"
    "<h3>+What it cost</h3><p>+The town gave him a boat for it, and the bell was hung on the first Sunday of spring in front of all who could stand.</p><h3>-You may like these</h3><div><a>-Five bells that were lost in the war</a></div><div><a>-The man who makes clocks for towers</a></div>",
    "<div><a>-Ten ways to keep an old house warm in a hard winter without any money spent on new windows or doors</a></div><div><a>-What our readers wrote last week of the plan to cut a road through the wood behind the lake</a></div><p>-Most read today</p><div><a>-The list of all the towns that lost their last bank in the course of the past ten years</a></div>"
    "<p>+The ferry left at six with forty people on board, most of them going home from the market with whatever they had not sold in the morning.</p><p>+It was cold.</p><p>+By noon the wind had turned and the captain, who knew the <a>sandbanks of the bay</a> from his father, thought it better to wait for the tide at the second buoy.</p><p>+Nobody complained.</p>"
    "<p>+When they came in the lamps were lit along the quay and a boy ran ahead to tell the families that all were safe and only late.</p><div><a>-Back to all of the stories of this part of the paper</a></div><p>-Prices hold for as long as there are goods in the shop and may be changed at any time of the year with no word before</p><div><a>-Terms</a> <a>-Help</a></div>",
    "<div><a>-News</a> <a>-Sport</a> <a>-Travel and leisure</a></div><p>-Written by our own people in the north</p><div><a>-More by the same hand in the pages of last year and of the year before that one too</a></div>"
    "<p>+In the first years the school had one room and one stove, and the children who sat near it were those whose parents had sent wood that week.</p><p>+She kept the book.</p><p>+Every name is in it, with the days that each was missing and the reason that was given, which was most often that there was work to do in the fields.</p>"
    "<p>+It ends in the year of the flood.</p><p>+After that the village moved up the hill and built a school of stone, and the old book was put in a chest where it lay until a teacher found it.</p>"
    "<p>-<a>Five other villages that moved away from a river and the reasons for which they chose to do so</a> read on here</p><p>-Sent in by readers</p><div><a>-A long walk through the valley in pictures that were sent to us by those who went along</a></div>",
    "<p>-Our page is kept alive by gifts from those who read it, so if you can spare a little please think of it now and give</p><div><a>-Give now</a></div><div><a>-Give each month</a></div>"
    "<p>+Salt was carried over the pass on mules, forty to a train, and each driver had the care of seven of them from the mines down to the lake.</p><p>+Seven, never eight.</p><p>+A driver who lost a load had to make it good, so they walked beside the last beast with a hand on the rope and did not talk much on the narrow parts.</p>"
    "<div><a>-Next page</a> <a>-Last page</a></div><p>-You are reading the free part of our paper and there are two more pieces that you can read in this month without paying</p><div><a>-Sign in</a></div>",
    "<div><a>-Towns</a></div><p>+The hill was bare when the first of them came, and they brought the trees on their backs from the far side.</p><p>+Ten lived.</p><p>+From those ten all the others have been cut, so that the whole wood is in truth no more than a few old trees.</p><div><a>-Maps</a></div><div><a>-Rivers</a></div><p>-Find us here</p><div><a>-Hills</a></div><p>+Three kinds of apple grow on the north side of the hill and none of them is sold, as they do not keep for more than a week.</p><p>+They are eaten there.</p><p>+What is left goes into the press, and the cider is drunk before the new year by all who helped with the picking.</p><div><a>-Woods</a></div><p>-Site map</p><div><a>-Lakes</a></div>",
    # pages of nothing but <div>: a line after the links and the last line are no part of the text, short ones within it are
    "<div><a>-Home</a></div><div><a>-Weather</a></div><div><a>-Tides</a></div><div>-Rooms with a view of the bay from now on.</div><div>+The lighthouse keeper</div><div>+He kept the light.</div><div>+For thirty years he climbed the stair each evening with a can of oil, and each morning he came down again and slept until noon.</div><div>+Then came the wire.</div><div>+Oil</div><div>+It was brought twice a year by a boat that could land only when the sea was flat, so that in bad years he had to burn the lamp low.</div><div>+No one saw it.</div><div>-Printed at the harbour office with all rights kept.</div>",
    "<div><a>-A</a></div><div><a>-B</a></div><div>-Try our bread.</div><div>+Grain</div><div>+Grain</div><div>+The mill takes rye in the first week of the month and wheat in all of the others, as long as the water lasts and the stones are sharp.</div><div>+Barley.</div><div>+Those who bring less than a sack are asked to wait until there is enough for a full turn of the wheel.</div><div>-Mill lane two</div>",
    "<div><a>-One</a></div><div><a>-Two words</a></div><div><a>-Three</a></div><div>-Winter coats at half the price until the end of this very month.</div><div>+What the river took and what it gave back to the people of the lower town</div><div>+First the bridge went.</div><div>+After it the tannery, two barns and the wall of the old churchyard were carried off in one night of March.</div><div>+Fish.</div><div>+There were so many of them in the fields when the water fell that they were gathered in baskets and salted.</div><div>+Nobody went hungry that spring.</div><div>+So it is told.</div><div>-Letters to the office by the gate are read on each first Monday</div>",
    "<div><a>-Index</a></div><div><a>-Names</a></div><div>-Now with pictures in colour on each page.</div><div>+A short life of the bell founder, by one who knew him</div><div>+Born here.</div><div>+Apprenticed there.</div><div>+He cast his first bell at nineteen.</div><div>+It cracked.</div><div>+The second hung for sixty years in the tower of the hospital, where it was rung for every birth and for no death.</div><div>+His third he gave away.</div><div>-Found in a drawer</div>",
    "<div><a>-Start</a></div><div><a>-All songs of the valley</a></div><div>-Hear them at home.</div><div>+Songs</div><div>+They are sung in the evening.</div><div>+One begins, and the others come in at the second line; whoever is last has to begin the next one, so that no one falls asleep before the lamp is out.</div><div>+Some are very old.</div><div>+Others were made last year.</div><div>+Both kinds are liked.</div><div>-Do not copy these pages without a word to us</div>",
    "<div><a>-Shop</a></div><div><a>-Map</a></div><div>-Boots for all.</div><div>+On foot over the pass in the last days of the year, with a dog</div><div>+On foot over the pass in the last days of the year, with a dog</div><div>+We left late.</div><div>+The snow held until noon and then we sank to the knee at every step, so that the hut was reached only after dark.</div><div>+It was shut, and so we broke the lock and left a coin for it on the table under the bread.</div><div>+The dog slept by the door.</div><div>+Morning.</div><div>+From the top one sees both seas, or so they say; we saw the inside of a cloud and each other.</div><div>-Walkers of the north since long ago</div>",
    "<div><a>-Up</a></div><div><a>-Down</a></div><div>-A new clock for your wall costs less than you think at our shop in the square.</div><div>+Clocks</div><div>+Nine of them stand in the hall.</div><div>+None tells the hour.</div><div>+The tallest was made for a duke who wanted the moon and the tides on it but could not read, and so its face has pictures.</div><div>+A fish, for one.</div><div>+It shows low water.</div><div>+The smallest was a gift to his wife and has no hands at all, since she did not wish to be told.</div><div>-Open in summer</div>",
    "<a><div>-The card of a story that one can read on another page</div><div>-With a line below that tells what it is about and by whom</div></a><a><div>-A second card</div></a><div>+The tower was built by the weavers in the year after the fire, and it was meant to be seen from the sea.</div><div>+It leans.</div><div>+Nobody knows whether it did so from the first day or whether the ground gave way when the moat was drained and filled with sand.</div><div>-Stairs are closed</div>",
)


@dataclass(frozen=True)
class Node:
    column: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    share: float = 0.0


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """A classification tree by Gini impurity; ties go to the first column and the lowest limit."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Node(share=share)
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, column] <= limit
            impurity = sum(part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low]))
            if impurity < best[0] - 1e-9:
                best = (impurity, column, float(limit))
    _, column, limit = best
    if column < 0:
        return Node(share=share)
    low = x[:, column] <= limit
    return Node(column, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1), share)


@lru_cache(maxsize=1)
def tree() -> Node:
    rows, labels = [], []
    for page in LABELLED:
        # the labels are no part of what is learned from
        rows.append(features(blocks(re.sub(r"(?<=>)[+-]", "", page))))
        labels += ["".join(b.raw).lstrip()[0] == "+" for b in blocks(page)]
    return grow(np.concatenate(rows), np.array(labels, dtype=float))


def columns_used(node: Node) -> set[int]:
    """The features that a tree asks for."""
    return set() if node.column < 0 else {node.column} | columns_used(node.low) | columns_used(node.high)


def is_main(node: Node, row) -> bool:
    while node.column >= 0:
        node = node.low if row[node.column] <= node.limit else node.high
    return node.share > 0.5


def main_text(page: str | None, model: Node | None = None) -> str:
    if not page:
        return ""
    model = model or tree()
    found = blocks(page)
    return "\n".join(" ".join("".join(b.raw).split()) for b, row in zip(found, features(found).tolist(), strict=True) if is_main(model, row))


def extracted(pages: DataFrame, html_column: str = "html", *, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with text and n_chars instead of the HTML. The tree is trained once, on the driver's fixed table."""
    model = tree()
    kept = [f for f in pages.schema.fields if f.name not in (html_column, text, n_chars)]
    source = pages.select(*[f"`{f.name}`" for f in kept], html_column)

    def run(batches):
        for batch in batches:
            for part in parts(batch, len(kept)):
                texts = [main_text(p, model) for p in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in kept), text, n_chars])

    return source.mapInArrow(released(run), StructType(list(kept)).add(text, StringType()).add(n_chars, LongType()))

"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessel.llm.frames import Packed, lean

#: Function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his how i if in into is it its me more my no not of on one or
    our she so some than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für haben hat ich ihr
    im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et été être il ils je la le les leur lui mais me même ne nous on ou où par
    pas plus pour qu que qui sa sans se ses si son sont sur tout très tu un une vous y
    al así como con cuando de del desde donde el ella en entre era es esa ese eso esta este esto está fue ha hay la las le lo los más mi
    muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene un una y ya yo""".split()
)
#: Tags that end a block.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main map menu meta nav ol optgroup option p pre
    section select summary table tbody td textarea tfoot th thead title tr ul video audio iframe object""".split()
)
#: Elements whose contents are not text.
HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template svg math head iframe object textarea select title".split()}
#: A tag's name, and its end if neither quotes nor another tag come before it.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)[^<>\"']*+(>?)")
STOP = re.compile("[>\"']")
WORD = re.compile(r"\w+")

LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.2, 70, 200, 0.1, 0.2


def blocks(html: str) -> list[tuple[str, int]]:
    """A page's blocks in order: the text, white space collapsed, and how many of its characters are in links."""
    found: list[tuple[str, int]] = []
    parts: list[str] = []
    linked, in_link, breaks = 0, 0, 0

    def close() -> None:
        nonlocal linked, breaks
        text = " ".join("".join(parts).split())
        if text:
            found.append((text, min(linked, len(text))))
        parts.clear()
        linked, breaks = 0, 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        text = unescape(raw)
        if text.strip():
            breaks = 0
            if in_link:
                linked += len(" ".join(text.split()))
        parts.append(text)

    def ends(mark: str, start: int) -> int:
        found = html.find(mark, start)
        return len(html) if found < 0 else found + len(mark)

    # One scan forward: nothing is looked at again after what ends, or would end, a tag has been sought.
    at = look = 0
    quotes = True
    while (lt := html.find("<", look)) >= 0:
        m, hidden, tag = TAG.match(html, lt), None, ""
        if m:
            tag, end = m[2].lower(), m.end()
            if not m[3]:
                end, quotes = tag_end(html, lt, end, quotes)
            if not m[1] and (hidden := HIDDEN.get(tag)):
                closed = hidden.search(html, end)
                end = closed.end() if closed else len(html)
        elif html.startswith("<!--", lt):
            end = ends("-->", lt + 4)
        elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = ends(">", lt + 2)
        else:
            look = lt + 1
            continue
        if lt > at:
            add(html[at:lt])
        at = look = end
        if hidden:
            close()
        elif tag == "a":
            in_link = max(0, in_link - 1) if m[1] else 1
        elif tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
        elif tag in BLOCK_TAGS:
            close()
    if at < len(html):
        add(html[at:])
    close()
    return found


def tag_end(html: str, start: int, at: int, quotes: bool) -> tuple[int, bool]:
    """Where the tag that begins at ``start`` ends, sought from ``at`` on, and whether quotes still count.

    A quote that is never closed is a slip: the tag then ends at its first ``>``, and quotes count no more on the page. A
    tag that doesn't end goes on to the page's end.
    """
    while quotes and (m := STOP.search(html, at)):
        if m[0] == ">":
            return m.end(), True
        closing = html.find(m[0], m.end())
        if closing < 0:
            quotes, at = False, start
        else:
            at = closing + 1
    end = html.find(">", at)
    return (len(html) if end < 0 else end + 1), quotes


def first_pass(text: str, linked: int) -> str:
    """``good``, ``bad``, or undecided: ``short`` or ``near``."""
    n = len(text)
    words = WORD.findall(text.lower())
    if linked / n > LINKS or "©" in text:
        return "bad"
    if n < SHORT:
        return "bad" if linked else "short"
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= STOP_HIGH:
        return "good" if n > LONG else "near"
    return "near" if density >= STOP_LOW else "bad"


def second_pass(labels: list[str]) -> list[str]:
    """Undecided blocks take the label of the nearest decided one.

    Where both sides are as near and disagree, and where nothing on the page is decided, ``near`` becomes good and ``short`` bad.
    """
    n = len(labels)
    left: list[int | None] = [None] * n
    right: list[int | None] = [None] * n
    last = None
    for i, x in enumerate(labels):
        if x in ("good", "bad"):
            last = i
        left[i] = last
    last = None
    for i in reversed(range(n)):
        if labels[i] in ("good", "bad"):
            last = i
        right[i] = last
    out = []
    for i, x in enumerate(labels):
        if x in ("good", "bad"):
            out.append(x)
            continue
        a, b = left[i], right[i]
        da, db = (i - a if a is not None else n + 1), (b - i if b is not None else n + 1)
        if da == db:
            same = a is not None and labels[a] == labels[b]
            out.append(labels[a] if same else "good" if x == "near" else "bad")
        else:
            out.append(labels[a if da < db else b])
    return out


def extract(html: str) -> tuple[str, int, int]:
    found = blocks(html)
    labels = second_pass([first_pass(*b) for b in found])
    kept = [t for (t, _), x in zip(found, labels, strict=True) if x == "good"]
    return "\n".join(kept), len(found), len(kept)


@lean
def extracted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        done = [extract(h) if h is not None else (None, 0, 0) for h in (x.as_py() for x in b.column("html"))]
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", "text", "n_blocks", "n_kept"])


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Each page's main text.

    Tags cut a page into blocks. By length, link density and stop-word density a block is good, bad or undecided;
    undecided ones, short or nearly good, then take the label of the nearest decided block. Good blocks, a line each, are
    the text. Densities use the function words of four languages at once, so that no page needs a language.

    Columns are those of ``pages`` without ``html``, and ``text``, ``n_blocks`` and ``n_kept``, which replace input columns of
    those names. Null html gives null text and no blocks; empty html, or a page without a good block, an empty text.
    Unclosed tags and comments end with the page; time grows with a page's length, whatever stands in it. Equal rows give equal rows. An empty table gives an empty table.
    """
    p = Packed(pages, html)
    row = p.frame.select(p.frame["row"].dropFields(f"c{p.at[html]}").alias("row") if len(p.names) > 1 else F.struct(F.lit(0).alias("none")).alias("row"), F.col(html).alias("html"))
    schema = StructType([row.schema["row"], StructField("text", StringType()), StructField("n_blocks", IntegerType()), StructField("n_kept", IntegerType())])
    done = row.mapInArrow(extracted, schema)
    added = ("text", "n_blocks", "n_kept")
    own = [F.col(f"row.c{i}").alias(n) for i, n in enumerate(p.names) if i != p.at[html] and n.lower() not in added]
    return done.select(*own, *added)

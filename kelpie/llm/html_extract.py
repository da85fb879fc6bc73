"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant reader turns a page into leaf blocks: runs of text between block-level tags, with the features of the
elements above them (tags, words of class and id) and of the text (length, links, punctuation). The field has one
weight for each feature and label and one for each pair of neighbouring labels. It is trained by maximum likelihood
on labelled pages (html_pages.py), decoded by Viterbi, and small enough to go to every worker.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import in_slices, prepare
from kelpie.llm.html_pages import labelled_pages

TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: Fixed values of HTML: elements without content, whose content is not markup and not shown, whose content is markup
#: and not shown, and that begin a block; those a list of choices may hold.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes".split())
HIDDEN = set("template select datalist".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CHOICE = {"option", "optgroup", "hr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
STOPS = set("ul ol dl table article section aside nav header footer main div body form".split())
SOUND = set("a abbr b big button cite code em font i label mark q s small span strike strong sub sup time tt u".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _element(tag: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """Features of an element, and whether it is marked as main text in a labelled page."""
    out, main = {f"in:{tag}"}, False
    for m in ATTRIBUTE.finditer(attrs) if attrs and not attrs.isspace() else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            out |= {f"is:{w.lower()}" for w in PART.findall(value)}
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.add("hidden")
        elif name == "data-main":
            main = True
    return tuple(sorted(out)), main


class _Stack:
    """Open elements, with what is asked about them all kept up to date: a question costs the same at any depth.

    known: features that count, all if none are given.
    """

    def __init__(self, known=None) -> None:
        self.known, self.elements, self.main = known, [], 0
        self.where: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.stops: list[int] = []
        self.live: dict[str, int] = {}

    def push(self, tag: str, features: tuple[str, ...], main: bool) -> None:
        k = len(self.elements)
        self.elements.append((tag, features, main))
        self.where[tag].append(k)
        if tag in BLOCK:
            self.blocks.append(k)
        if tag in STOPS:
            self.stops.append(k)
        self.main += main
        for f in features:
            if self.known is None or f in self.known:
                self.live[f] = self.live.get(f, 0) + 1

    def cut(self, k: int) -> None:
        """Closes all from place k."""
        while len(self.elements) > k:
            tag, features, main = self.elements.pop()
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in STOPS:
                self.stops.pop()
            self.main -= main
            for f in features:
                n = self.live.get(f, 0)
                if n > 1:
                    self.live[f] = n - 1
                elif n:
                    del self.live[f]

    def last(self, tag: str) -> int:
        own = self.where.get(tag)
        return own[-1] if own else -1

    def any(self, tags) -> bool:
        return any(self.where.get(t) for t in tags)

    def within(self, tags, border: int) -> int | None:
        """The outermost place of tags beyond a border."""
        return min((own[k] for t in tags if (own := self.where.get(t)) and (k := bisect_right(own, border)) < len(own)), default=None)


def blocks(page: str | None, known=None) -> list[tuple[str, list[str], bool]]:
    """Leaf blocks in page order: text, features, and whether a labelled page marks it as main.

    Text that is part of no block: that of RAW elements, up to their end tag or, without one, to the page's end, as
    browsers read them; that of HIDDEN elements, which end with the element around them at the latest, lists of choices
    also where another block begins; comments; and attributes. All other text is, that of media, formulas, drawings and
    unknown elements too. known: the features of elements that are listed, all if none are given; their number bounds
    what a block costs, however deep it lies.
    """
    page = page or ""
    stack = _Stack(known)
    out, text, linked, at, n, off = [], [], [0], 0, len(page), False
    cached: dict[tuple[str, str], tuple] = {}

    def flush() -> None:
        if text:
            t = " ".join("".join(text).split())
            if t:
                own = set(stack.live)
                k = len(t.split())
                own.add(f"words:{min(k.bit_length(), 7)}")
                own.add(f"parent:{stack.elements[stack.blocks[-1]][0] if stack.blocks else ''}")
                share = linked[0] / len(t)
                own.add("links:all" if share > 0.7 else "links:some" if share > 0.2 else "links:few" if share else "links:none")
                own.add("ends" if t[-1] in ".!?…:;\"'”»" else "open")
                if "©" in t:
                    own.add("copyright")
                out.append((t, sorted(own), not off and stack.main > 0))
            text.clear()
            linked[0] = 0

    def add(raw: str) -> None:
        if stack.any(HIDDEN):
            return
        if "&" in raw:
            raw = html.unescape(raw)
        text.append(raw)
        if stack.last("a") >= max(len(stack.elements) - 4, 0):
            linked[0] += len(raw.strip())

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] in ("off", "on"):
                flush()
                off = m[1] == "off"
            continue
        tag = tag.lower()
        inner = stack.blocks[-1] if stack.blocks else -1
        if m[2]:
            if tag in BLOCK:
                flush()
            k = stack.last(tag)
            if k >= 0 and not (tag in SOUND and inner > k):
                if inner >= k:
                    flush()
                stack.cut(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            choices = stack.within(("select", "datalist"), -1)
            if choices is not None and tag not in CHOICE:
                stack.cut(choices)
                choices = None
            if choices is None and (p := stack.last("p")) >= 0:
                stack.cut(p)
            if tag in CLOSES and (k := stack.within(CLOSES[tag], stack.stops[-1] if stack.stops else -1)) is not None:
                stack.cut(k)
            if tag in HEADINGS and stack.elements and stack.elements[-1][0] in HEADINGS:
                stack.cut(len(stack.elements) - 1)
        foreign = tag in ("svg", "math") or stack.any(("svg", "math"))
        if tag in VOID or tag == "head" or foreign and m[4].endswith("/"):  # what a head may hold shows no text
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        key = (tag, m[4])
        if key not in cached:
            cached[key] = _element(tag, m[4])
        stack.push(tag, *cached[key])
    flush()
    return out


class Field:
    """Weights by feature and label, and by neighbouring labels; label 1 is main text."""

    def __init__(self, pages: list[str], rounds: int = 150, decay: float = 0.002) -> None:
        read = [b for b in map(blocks, pages) if b]
        names = sorted({f for page in read for _, fs, _ in page for f in fs})
        self.at = {f: i for i, f in enumerate(names)}
        n, longest = len(read), max(map(len, read))
        k = len(names)
        rows, cols, y = [], [], np.zeros((n, longest), np.int64)
        mask = np.zeros((n, longest), bool)
        for i, page in enumerate(read):
            for j, (_, fs, main) in enumerate(page):
                mask[i, j], y[i, j] = True, main
                rows += [i * longest + j] * len(fs)
                cols += [self.at[f] for f in fs]
        rows, cols = np.array(rows), np.array(cols)
        w, t, b = np.zeros((k, 2)), np.zeros((2, 2)), np.zeros(2)
        one = np.eye(2)[y] * mask[:, :, None]
        steps, moment = [np.zeros_like(x) for x in (w, t, b)], [np.zeros_like(x) for x in (w, t, b)]
        real = np.einsum("nia,nib->ab", one[:, :-1], one[:, 1:])
        total = mask.sum()
        for r in range(1, rounds + 1):
            s = np.zeros((n * longest, 2))
            for c in (0, 1):
                s[:, c] = np.bincount(rows, w[cols, c], n * longest)
            s = s.reshape(n, longest, 2) + b
            f, g = np.zeros_like(s), np.zeros_like(s)
            f[:, 0] = s[:, 0]
            for i in range(1, longest):
                f[:, i] = np.where(mask[:, i, None], s[:, i] + np.logaddexp(f[:, i - 1, :1] + t[0], f[:, i - 1, 1:] + t[1]), f[:, i - 1])
            for i in range(longest - 2, -1, -1):
                after = s[:, i + 1] + g[:, i + 1]
                g[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(t[:, 0] + after[:, :1], t[:, 1] + after[:, 1:]), 0)
            z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
            p = np.exp(f + g - z[:, None, None]) * mask[:, :, None]
            pair = np.exp(f[:, :-1, :, None] + t + (s + g)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            d = (p - one).reshape(-1, 2)
            grads = [np.stack([np.bincount(cols, d[rows, c], k) for c in (0, 1)], 1) / total + decay * w / 10, (pair.sum((0, 1)) - real) / total, d.sum(0) / total]
            for x, gr, m1, m2 in zip((w, t, b), grads, steps, moment, strict=True):  # Adam
                m1 += 0.1 * (gr - m1)
                m2 += 0.01 * (gr * gr - m2)
                x -= 0.15 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
        self.w = {f: (float(w[i, 0]), float(w[i, 1])) for f, i in self.at.items()}
        self.t, self.b = t.tolist(), b.tolist()

    def labels(self, page: list[tuple[str, list[str], bool]]) -> list[int]:
        """The best labels, by Viterbi; features not met in training don't count."""
        (t00, t01), (t10, t11) = self.t
        w, back, v0, v1 = self.w, [], 0.0, 0.0
        for i, (_, fs, _) in enumerate(page):
            s0, s1 = self.b
            for f in fs:
                x = w.get(f)
                if x is not None:
                    s0 += x[0]
                    s1 += x[1]
            if i:
                a, b = v0 + t00 >= v1 + t10, v0 + t01 > v1 + t11
                back.append((0 if a else 1, 0 if b else 1))
                v0, v1 = s0 + (v0 + t00 if a else v1 + t10), s1 + (v0 + t01 if b else v1 + t11)
            else:
                v0, v1 = s0, s1
        out = [int(v1 > v0)]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        b = blocks(page, self.w)
        return "\n".join(x[0] for x, on in zip(b, self.labels(b), strict=True) if on) if b else ""


@functools.cache
def train() -> Field:
    """The field fitted on labelled_pages(), once for each process."""
    return Field(labelled_pages())


def _extracted(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            texts = [model.text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_texts(spark: SparkSession, pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages (page_id, url, html).

    A null, empty or blank page has the text ''. Broken markup is read as far as it goes; pages are read whole. What
    blocks() leaves out goes, and whole blocks that the field doesn't label as main text, nothing else. Other columns are
    ignored, null ids and urls stay, repeated rows are repeated.
    """
    prepare(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(in_slices, _extracted(spark.sparkContext.broadcast(field or train())), "page_id long, url string, text string, n_chars long")

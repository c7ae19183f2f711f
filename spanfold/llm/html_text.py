"""Operator 1, HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

``blocks`` scans the mark-up once: the text between two block-level tags is a leaf block, described
by its open ancestors (tags, roles, words of class and id; not those of elements that hold the page's main
element or most of its text), its links and its text. The chain has
two labels, main text or not; weights of label features and of neighbouring labels are trained by
gradient ascent on the labelled pages' conditional likelihood (forward-backward), and a page is
decoded by Viterbi. Extraction is row-local: nothing is shuffled.

Blocks inside script, style, title, head, template, noscript, svg, iframe, object, canvas, audio, video
(what these three hold is shown only where they can't be) or marked hidden are not text and never
reach the chain. Attributes are read one by one, name and then value, and names are compared whole.
A head ends at its end tag or, where that is left out, at ``body`` or at the first tag or text that
can't stand in a head. A formula (math) is inline text, without its ``annotation``, which is not
shown. White space inside a block becomes one space, character references are decoded, blocks are
joined by one newline in page order; nothing else is dropped or cut.

Defined results: null or empty html gives an empty text; text without mark-up is one block; unclosed
tags end with their parent; repeated rows get equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm import labelled_pages

#: Tags that break blocks, tags whose content is not text, tags without content.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
HIDDEN = frozenset("script style head template noscript svg iframe object canvas title audio video".split())
RAW = frozenset("script style textarea title".split())
#: What can stand in a head; any other start tag, and text, ends an open head.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr param".split())
#: A new one ends an open one of the same kind, up to the nearest of the tags named.
ENDS = {"p": ("p", ()), "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,200}+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ANNOTATION = re.compile(r"</(annotation(?:-xml)?|math)\s*>", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Elements that are apart from the main text however much of a page they hold.
_APART = frozenset("nav header footer aside menu".split())
#: Features of ancestors that a block can have.
MOST_FEATURES = 256
ROUNDS, RATE, SHRINK = 6, 0.3, 1e-4


def _own(tag: str, attrs: str) -> tuple[frozenset[str], bool, frozenset[str]]:
    """(features of an element, is it hidden?, its names as features of the blocks it is nearest to)."""
    found, hidden = {"in:" + tag}, tag in HIDDEN
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            found.update("name:" + w for w in _NAME.findall(_CAMEL.sub(" ", value).lower()))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return frozenset(found), hidden, frozenset("near:" + f[5:] for f in found if f.startswith("name:"))


def markup(page: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, slash, tag, attributes, text of a CDATA section) of each piece of mark-up; tag is empty but for tags. The search goes
    on behind the last piece, or where ``send`` tells it to. A ``>`` in quotes doesn't end a tag, unless the quotes never end or come
    by the hundred: then the first one does. Every place is looked at a bounded number of times."""
    at, last, last_cdata, last_comment = 0, page.rfind(">"), page.rfind("]]>"), page.rfind("-->")
    while 0 <= (start := page.find("<", at)) < last:
        found = None
        if page.startswith("<!--", start):
            found = start, page.index("-->", start) + 3 if start < last_comment - 1 else len(page), "", "", "", ""
        elif page.startswith("<![CDATA[", start) and start < last_cdata:
            end = page.index("]]>", start) + 3
            found = start, end, "", "", "", page[start + 9 : end - 3]
        elif page[start + 1 : start + 2] in ("!", "?"):
            found = start, page.index(">", start) + 1, "", "", "", ""
        elif m := _TAG.match(page, start) or _PLAIN_TAG.match(page, start):
            found = start, m.end(), m[1], m[2].lower(), m[3], ""
        at = start + 1
        if found:
            at = (yield found) or found[1]
    if (start := page.find("<!--", at)) >= 0:  # a comment that never ends
        yield start, len(page), "", "", "", ""


class _Open:
    """The open elements, with the places of each tag among them, and all elements of the page: (parent, tag, own features, own names)."""

    def __init__(self):
        self.tags, self.elements, self.hidden = [""], [0], [False]
        self.places: dict[str, list[int]] = {}
        self.parent, self.tag, self.own, self.names, self.chars = [0], [""], [frozenset()], [frozenset()], [0]

    def nearest(self, *tags: str) -> int:
        """Place of the innermost open element with one of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, own: frozenset[str], names: frozenset[str], hidden: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.parent.append(self.elements[-1])
        self.elements.append(len(self.tag))
        self.tags.append(tag)
        self.hidden.append(self.hidden[-1] or hidden)
        self.tag.append(tag)
        self.own.append(own)
        self.names.append(names)
        self.chars.append(0)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        for tag in self.tags[place:]:
            self.places[tag].pop()
        del self.tags[place:], self.elements[place:], self.hidden[place:]

    def features(self) -> tuple[list[frozenset[str]], list[frozenset[str]]]:
        """Per element the features of itself and its ancestors, and the names of the nearest named one.

        What holds the page as a whole says nothing about its parts: html, body, the main element, or else an article with a third of
        the page's text, everything around these, and any other element with 7 tenths of the text (menus and the like aside) count only
        as the tags main or article, without names."""
        chars = self.chars[:]
        for e in range(len(chars) - 1, 0, -1):
            chars[self.parent[e]] += chars[e]
        whole = [t in ("", "html", "body") or (10 * c >= 7 * chars[0] and t not in _APART) for t, c in zip(self.tag, chars)]
        mains = [e for e, t in enumerate(self.tag) if t == "main"] or [e for e, t in enumerate(self.tag) if t == "article" and 3 * chars[e] >= chars[0]]
        e = max(mains, key=lambda e: chars[e], default=0)
        while e:
            whole[e] = True
            e = self.parent[e]
        all_of, near = [frozenset()], [frozenset()]
        for e in range(1, len(chars)):
            up = all_of[self.parent[e]]
            own = frozenset({"in:" + self.tag[e]} & {"in:main", "in:article"}) if whole[e] else self.own[e]
            all_of.append(up if own <= up or len(up) > MOST_FEATURES else up | own)
            near.append(near[self.parent[e]] if whole[e] or not self.names[e] else self.names[e])
        return all_of, near


def blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of each leaf block of a page, in order."""
    page = page or ""
    here = _Open()
    out: list[tuple[str, int, str, list[str]]] = []
    parts: list[str] = []
    linked = linked_chars = 0
    no_end = False  # no further end tag of an annotation
    memo: dict[tuple, tuple] = {}

    def say(text: str) -> None:
        """Text of the page; but for blanks it ends an open head."""
        if here.tags[-1] == "head" and not text.isspace():
            here.cut(len(here.tags) - 1)
        parts.append(text)

    def flush() -> None:
        nonlocal linked_chars
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text and not here.hidden[-1]:
                here.chars[here.elements[-1]] += len(text)
                out.append((text, here.elements[-1], "tag:" + here.tags[-1], _text_features(text, min(1.0, linked_chars / max(1, len(raw))))))
            parts.clear()
        linked_chars = 0

    at, length = 0, len(page)
    scan = markup(page)
    found = next(scan, None)
    while found:
        start, end, slash, tag, attrs, cdata = found
        if start > at:
            say(page[at:start])
            if linked:
                linked_chars += start - at
        at = end
        if not tag:
            if cdata:
                say(cdata)
            found = next(scan, None)
            continue
        if not slash and tag not in IN_HEAD:
            if here.tags[-1] == "head":
                here.cut(len(here.tags) - 1)
            elif tag == "body" and (head := here.nearest("head")) > here.nearest("template"):
                flush()
                here.cut(head)
        if tag == "br":
            parts.append(" ")
        elif slash:  # an end tag
            if tag == "a":
                linked = 0
            elif tag in BLOCK or tag in HIDDEN:
                flush()
                if place := here.nearest(tag):
                    here.cut(place)
        elif tag == "a":
            linked = 1
        elif tag in ("annotation", "annotation-xml"):
            stop = None if attrs.endswith("/") or no_end else _ANNOTATION.search(page, at)
            no_end = no_end or stop is None and not attrs.endswith("/")
            if stop:
                at = stop.end() if stop[1].lower() == tag else stop.start()
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in BLOCK or tag in HIDDEN:
            flush()
            linked = 0
            if tag == "p" or tag not in ENDS:
                if here.tags[-1] == "p":
                    here.cut(len(here.tags) - 1)
            else:
                place = here.nearest(*ENDS[tag][0].split())
                if place > here.nearest(*ENDS[tag][1]):
                    here.cut(place)
            if (key := (tag, attrs)) not in memo:
                memo[key] = _own(tag, attrs)
            own, hidden, names = memo[key]
            up_hidden = here.hidden[-1]
            if not attrs.endswith("/"):
                here.push(tag, own, names, hidden)
            if tag in RAW:
                stop = _RAW_END[tag].search(page, at)
                if not up_hidden and not hidden:
                    parts.append(page[at : stop.start() if stop else length])
                    flush()
                at = stop.end() if stop else length
                if here.tags[-1] == tag:
                    here.cut(len(here.tags) - 1)
        try:
            found = scan.send(at)
        except StopIteration:
            found = None
    if at < length:
        say(page[at:])
    flush()
    all_of, near = here.features()
    return [(text, [*all_of[e], *near[e], tag, *more]) for text, e, tag, more in out]


def _text_features(text: str, linked: float) -> list[str]:
    words = text.count(" ") + 1
    size = next((k for k, most in enumerate((2, 5, 10, 25, 60)) if words <= most), 5)
    found = [f"words:{size}", "all", f"linked:{0 if linked < 0.01 else 1 if linked < 0.5 else 2}"]
    found.append("ends" if text[-1] in ".!?…\"'”" else "open")
    if "©" in text or "copyright" in text[:200].lower():
        found.append("rights")
    return found


class Chain:
    """Weights of the two-label chain: ``weight[f]`` for main text against the rest, ``move[a, b]``."""

    def __init__(self, weight: dict[str, float], move: np.ndarray):
        self.weight, self.move = weight, move

    def scores(self, sequence: list[list[str]]) -> np.ndarray:
        get = self.weight.get
        return np.array([sum(get(f, 0.0) for f in found) for found in sequence])

    def decode(self, sequence: list[list[str]]) -> list[bool]:
        """The most likely labels (Viterbi)."""
        if not sequence:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        back, a, b = [], 0.0, 0.0  # best so far that ends outside, inside the main text
        for k, s in enumerate(self.scores(sequence).tolist()):
            if k:
                from_a, from_b = a + m00 >= b + m10, a + m01 >= b + m11
                a, b = (a + m00 if from_a else b + m10), (a + m01 if from_b else b + m11)
                back.append((not from_a, not from_b))
            b += s
        label = b > a
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(sequences: list[tuple[list[list[str]], list[bool]]]) -> Chain:
    """Train on (features per block, labels) pages by adaptive gradient steps, page by page."""
    chain = Chain({}, np.zeros((2, 2)))
    seen: dict[str, float] = {}  # squared gradients
    seen_move = np.full((2, 2), 1e-6)
    for _ in range(ROUNDS):
        for found, labels in sequences:
            if not found:
                continue
            score = np.stack([np.zeros(len(found)), chain.scores(found)], axis=1)
            fwd, bwd = score.copy(), np.zeros_like(score)
            for k in range(1, len(found)):
                fwd[k] += _log_sum(fwd[k - 1][:, None] + chain.move, 0)
            for k in range(len(found) - 2, -1, -1):
                bwd[k] = _log_sum(chain.move + (score[k + 1] + bwd[k + 1])[None, :], 1)
            total = _log_sum(fwd[-1], 0)
            miss = np.array(labels, float) - np.exp(fwd[:, 1] + bwd[:, 1] - total)
            step = -SHRINK * chain.move
            for k in range(1, len(found)):
                step = step - np.exp(fwd[k - 1][:, None] + chain.move + (score[k] + bwd[k])[None, :] - total)
                step[int(labels[k - 1]), int(labels[k])] += 1
            seen_move += step**2
            chain.move = chain.move + RATE * step / np.sqrt(seen_move)
            grad: dict[str, float] = {}
            for names, g in zip(found, miss.tolist(), strict=True):
                for f in names:
                    grad[f] = grad.get(f, 0.0) + g
            for f, g in grad.items():
                g -= SHRINK * chain.weight.get(f, 0.0)
                seen[f] = seen.get(f, 1e-6) + g * g
                chain.weight[f] = chain.weight.get(f, 0.0) + RATE * g / seen[f] ** 0.5
    return chain


def training_sequences(pages: list[list[tuple[str, str]]]) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels of labelled pages: a private mark in each text tells its part's label."""
    out = []
    for page in pages:
        marked = "".join(re.sub(r">([^<>]*\w[^<>]*)(?=<|$)", lambda m, s=sign: f">{s}\x01{m[1]}", "<i>" + h + "</i>") if sign else h for h, sign in page)
        found, labels = [], []
        for text, features in blocks(marked):
            signs = re.findall("([+-])\x01", text)
            plain = re.sub("[+-]\x01", "", text).strip()
            if signs and plain:
                keep = [f for f in features if f.startswith(("in:", "name:", "near:", "tag:", "linked:"))]
                found.append(keep + [f for f in _text_features(plain, 0.0) if not f.startswith("linked:")])
                labels.append(signs[0] == "+")
        out.append((found, labels))
    return out


def train(pages: list[list[tuple[str, str]]] | None = None) -> Chain:
    """The chain of the labelled pages."""
    return fit(training_sequences(labelled_pages.pages() if pages is None else pages))


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(text for (text, _), main in zip(found, chain.decode([f for _, f in found]), strict=True) if main)


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row of ``pages``."""
    chain = chain or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), chain) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    narrow = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string"))
    return narrow.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")

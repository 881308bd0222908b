"""Main-text extraction with a linear-chain conditional random field over leaf blocks.

Each block is described by its ancestor tags, the words of their class and id names, and features of its
text (length, links, sentence ends, marks). The field scores a label (main text or not) for each block and
for each pair of neighbours; it is trained by maximum likelihood on labelled pages (``labelled_pages``: a
fixed number of generated pages of many layouts, with the label known for each block) and decoded by
Viterbi. Weights are fitted on the driver (``PAGES`` pages, a constant) and sent to the workers; pages are
then extracted whole, each on its own.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binlens.llm.common import text_runs, utf8
from binlens.llm.html_blocks import Block, Chain, blocks

#: Labelled pages that the field is trained on.
PAGES = 360
RUN_BYTES = 8_000_000
#: Characters of pages that share the nodes of their ancestors.
SHARED_CHARS = 4_000_000
#: Marks that tell page furniture from prose. (Fixed values.)
MARKS = ("©", "|", "»", "›", "·", "»", "→", "#", "@", "$", "€")


def text_features(b: Block) -> list[str]:
    t = b.text
    words = t.count(" ") + 1
    share = b.linked / max(1, len(t))
    out = ["bias", f"words:{min(8, words.bit_length())}", f"links:{0 if share < .2 else 1 if share < .7 else 2}",
           f"end:{'stop' if t[-1] in '.!?…。”\"' else 'colon' if t[-1] == ':' else 'open'}"]
    if words < 12:
        out += [f"mark:{m}" for m in MARKS if m in t]
    if any(c.isdigit() for c in t[:200]):
        out.append("digit")
    return out


TAGS, NAMES = ("in",), ("name", "stem")


def word_features(word: str, kinds: tuple[str, ...]) -> list[str]:
    return [f"{k}:{word[:5] if k == 'stem' else word}" for k in kinds]


def own_features(path: Chain, named: Chain) -> list[str]:
    return [f"tag:{path.last}", f"named:{named.parent is not None}"]


def path_features(b: Block) -> list[str]:
    out = [f for t in sorted(set(b.tags)) for f in word_features(t, TAGS)]
    out += [f for n in sorted(set(b.names)) for f in word_features(n, NAMES)]
    return out + own_features(b.path, b.named)


# ---- labelled pages -------------------------------------------------------------------------------

#: Names that sites give to page furniture and to main text. (Fixed values.)
FURNITURE = {
    "menu": "nav navigation menu navbar topnav mainmenu breadcrumb breadcrumbs pagination pager tabs toc skip links",
    "header": "header masthead banner logo tagline sitename branding topbar",
    "footer": "footer colophon copyright legal bottom imprint sitemap credits",
    "sidebar": "sidebar aside widget rail secondary complementary related recommended popular trending more also tags category archive recent",
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal overlay dialog disclaimer paywall announcement privacy",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner dfp outbrain taboola partner offer deal",
    "form": "form search login signup newsletter subscribe subscription contact register feedback poll rating",
    "comments": "comment comments disqus discussion reply replies respond reviews thread reader readers responses",
    "share": "share sharing social follow twitter facebook print email toolbar buttons meta byline author bio",
}
MAIN = "content article post entry story main body text page prose copy single news blog primary center"
_SYLLABLES = "ka lo mi ren ta vos el dan qui mor sha pe ul fin gra tor be nis wo ja cer dum hil ost pra".split()


#: Words of other kinds that any text may hold. (Fixed values.)
_ODD = "1984 12 4.0 +1 (555) 555-0100 10.0.0.1 a@b.example $5 #1 @x MIT CC | &amp; && *** %%% A1B2C3D4".split()


class _Maker:
    """One generated page as (html, labels of its blocks in order)."""

    def __init__(self, rng: random.Random):
        self.r, self.html, self.labels = rng, [], []

    def words(self, lo, hi):
        r = self.r
        return [r.choice(_ODD) if r.random() < .05 else "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
                for _ in range(r.randint(lo, hi))]

    def sentences(self, lo, hi):
        return " ".join(" ".join(self.words(4, 16)).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(lo, hi)))

    def phrase(self, lo=1, hi=6):
        return " ".join(self.words(lo, hi)).capitalize()

    def name(self, kind):
        words = (FURNITURE[kind] if kind in FURNITURE else MAIN).split()
        w = self.r.choice(words)
        w = self.r.choice([w, w, w + "-" + self.r.choice(words), w.capitalize() + "Box", "site-" + w, w + "-wrap", w + "_1"])
        return f' {self.r.choice(["class", "class", "id"])}="{w}"'

    def leaf(self, tag, text, label, attributes=""):
        self.html.append(f"<{tag}{attributes}>{text}" + ("" if self.r.random() < .06 and tag in ("p", "li") else f"</{tag}>"))
        self.labels.append(label)

    def inline(self, text):
        r = self.r
        words = text.split()
        if r.random() < .08:
            return "<b>" + text + "<br>"        # left open, as many pages do
        if len(words) > 5 and r.random() < .4:
            i = r.randrange(len(words) - 2)
            tag = r.choice(["b", "i", "em", "strong", 'a href="/x"', "span", "code"])
            words[i] = f"<{tag}>{words[i]}"
            words[i + 1] += f"</{tag.split()[0]}>"
        return " ".join(words)

    def furniture(self, kind):
        r = self.r
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        named = tag is None or r.random() < .5
        if tag is None or r.random() < .45:
            tag, named = r.choice(["div", "div", "section", "ul" if kind == "menu" else "div", "p" if kind in ("ad", "notice", "footer") else "div"]), True
        attributes = self.name(kind) if named else ""
        if kind == "notice" and r.random() < .3:
            attributes += ' role="dialog"'
        if tag in ("p", "ul") and kind != "menu":
            self.leaf("p", self.sentences(1, 3) if r.random() < .7 else self.phrase(), 0, attributes)
            return
        self.html.append(f"<{tag}{attributes}>")
        if kind == "menu":
            items = r.randint(2, 8)
            if tag == "ul" or r.random() < .7:
                inner = tag != "ul"
                self.html.append("<ul>" if inner else "")
                for _ in range(items):
                    self.leaf("li", f'<a href="/{r.random()}">{self.phrase(1, 3)}</a>', 0)
                self.html.append("</ul>" if inner else "")
            else:
                self.html.append(" ".join(f'<a href="/a">{self.phrase(1, 2)}</a>' for _ in range(items)))
                self.labels.append(0)
        elif kind in ("comments", "sidebar"):
            if r.random() < .7:
                self.leaf(r.choice(["h2", "h3", "h4"]), self.phrase(), 0)
            for _ in range(r.randint(1, 5)):
                if kind == "comments" and r.random() < .5:
                    self.leaf("div", self.phrase(1, 2), 0, self.name("share") if r.random() < .5 else "")
                if r.random() < .7:
                    self.leaf(r.choice(["p", "p", "li", "div"]), self.inline(self.sentences(1, 4)), 0)
                else:
                    self.leaf("li", f'<a href="/r">{self.phrase(2, 8)}</a>', 0)
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.leaf(r.choice(["label", "button", "p", "legend"]), self.phrase() if r.random() < .6 else self.sentences(1, 1), 0)
                self.html.append('<input name="q">')
        else:
            for _ in range(r.randint(1, 3)):
                text = self.sentences(1, 3) if r.random() < .6 else self.phrase(1, 8)
                if kind == "footer" and r.random() < .6:
                    text = r.choice(["&copy; ", "&#169; ", "Copyright 2020 "]) + r.choice(["", "x.example &middot; "]) + text
                if r.random() < .4:
                    self.html.append(text)
                    self.labels.append(0)
                    self.html.append("<hr>")
                else:
                    self.leaf(r.choice(["p", "div", "h3" if kind != "header" else "h1"]), self.inline(text), 0)
        self.html.append(f"</{tag}>")

    def article(self):
        r = self.r
        self.leaf(r.choice(["h1", "h1", "h2"]), self.phrase(2, 14), 1)
        if r.random() < .3:
            self.leaf(r.choice(["p", "div"]), self.phrase(2, 6), 0, self.name("share"))
        for _ in range(r.choice([1, 2, 4, 8, 12])):
            x = r.random()
            if x < .57:
                self.leaf("p", self.inline(self.sentences(1, 7)), 1)
            elif x < .67:
                self.leaf("p", self.inline(self.phrase(1, 8)) + r.choice([".", ". |", ""]), 1)
            elif x < .72:
                self.leaf("p", " | ".join(self.words(4, 12)), 1)
            elif x < .78:
                self.leaf(r.choice(["h2", "h3", "h4"]), self.phrase(1, 8), 1)
            elif x < .84:
                t = r.choice(["ul", "ol"])
                self.html.append(f"<{t}>")
                for _ in range(r.randint(2, 5)):
                    self.leaf("li", self.inline(self.phrase(2, 12) if r.random() < .5 else self.sentences(1, 2)), 1)
                self.html.append(f"</{t}>")
            elif x < .88:
                self.leaf("blockquote", self.sentences(1, 3), 1)
            elif x < .90:
                self.leaf("pre", self.phrase(4, 20), 1)
            elif x < .93:
                self.html.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.leaf("td", self.phrase(1, 4), 1)
                self.html.append("</tr></table>")
            elif x < .95:
                self.html.append('<figure><img src="x">')
                self.leaf("figcaption", self.sentences(1, 1), 1)
                self.html.append("</figure>")
            else:
                self.furniture(r.choice(["ad", "ad", "share", "sidebar", "form", "notice", "menu"]))

    def page(self):
        r = self.r
        for kind, chance in (("notice", .3), ("header", .5), ("menu", .8), ("ad", .5), ("form", .2), ("menu", .2)):
            if r.random() < chance:
                self.furniture(kind)
        if r.random() < .25:
            self.furniture("sidebar")
        outer = r.choice(["<article>", "<article>", "<main><article>", "<main>", "<div%s>", "<div%s>", "<section%s>", "<div%s><article>", ""])
        self.html.append(outer.replace("%s", self.name("main"), 1))
        self.article()
        inside = r.random() < .4
        tail = [k for k, c in (("share", .3), ("ad", .3), ("comments", .45), ("sidebar", .4), ("form", .25)) if r.random() < c]
        if inside:
            for k in tail:
                self.furniture(k)
        for t in ("section", "div", "article", "main"):
            if "<" + t in outer and t != "main":
                self.html.append(f"</{t}>")
        if "<main" in outer:
            self.html.append("</main>")
        if not inside:
            for k in tail:
                self.furniture(k)
        if r.random() < .85:
            self.furniture("footer")
        if r.random() < .15:
            self.furniture("notice")
        return ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + "".join(self.html)
                + "</body></html>"), self.labels


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Generated pages as (blocks, labels); a layout whose blocks don't match its labels is left out."""
    out, rng = [], random.Random(seed)
    while len(out) < n:
        page, labels = _Maker(rng).page()
        found = blocks(page)
        if len(found) == len(labels):
            out.append((found, labels))
    return out


# ---- the field ------------------------------------------------------------------------------------

def pair_kind(a: Block, b: Block) -> int:
    """Kind of neighbourhood: same names and container path, or not."""
    return int(a.named is b.named and (a.path.parent or a.path) is (b.path.parent or b.path))


class Field:
    """``weights``: feature -> score of label 1 over label 0; ``pairs[kind][before][after]``."""

    def __init__(self, weights: dict[str, float], pairs):
        self.weights, self.pairs = weights, pairs
        self.forget()

    def forget(self):
        self.roots, self.chains, self.paths, self.read_chars = (Chain(), Chain()), {}, {}, 0

    def read(self, page: str) -> list[Block]:
        """The page's blocks; ancestors are shared with pages read before."""
        if self.read_chars > SHARED_CHARS:
            self.forget()
        self.read_chars += len(page)
        return blocks(page, self.roots)

    def chain(self, end: Chain, kinds: tuple[str, ...]) -> float:
        """Weights of the distinct words of a path: its parent's, and those of its own word if it is new."""
        todo, at, got = [], end, self.chains
        while at.parent is not None and at not in got:
            todo.append(at)
            at = at.parent
        total, get = got.get(at, 0.0), self.weights.get
        for at in reversed(todo):
            if at.first:
                total += sum(get(f, 0.0) for f in word_features(at.word, kinds))
            got[at] = total
        return total

    def score(self, b: Block) -> float:
        key = b.path, b.named
        path, get = self.paths.get(key), self.weights.get
        if path is None:
            path = self.chain(b.path, TAGS) + self.chain(b.named, NAMES) + sum(get(f, 0.0) for f in own_features(*key))
            self.paths[key] = path
        return path + sum(get(f, 0.0) for f in text_features(b))

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the likeliest labels."""
        if not page:
            return []
        zero, one, back = 0.0, self.score(page[0]), []
        for a, b in zip(page, page[1:]):
            p = self.pairs[pair_kind(a, b)]
            s = self.score(b)
            z0, z1 = zero + p[0][0], one + p[1][0]
            o0, o1 = zero + p[0][1], one + p[1][1]
            back.append((int(z1 > z0), int(o1 > o0)))
            zero, one = max(z0, z1), max(o0, o1) + s
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train_field(pages, rounds: int = 150, rate: float = 0.3, decay: float = 2e-3) -> Field:
    """Maximum likelihood by forward-backward sums over all pages at once, Adagrad steps, L2 decay."""
    index: dict[str, int] = {}
    most = max(len(b) for b, _ in pages)
    n = len(pages)
    mask, y = np.zeros((n, most), bool), np.zeros((n, most), int)
    kind = np.zeros((n, most), int)
    rows, cols = [], []
    for i, (page, labels) in enumerate(pages):
        for t, (b, label) in enumerate(zip(page, labels)):
            mask[i, t], y[i, t] = True, label
            if t:
                kind[i, t] = pair_kind(page[t - 1], b)
            for f in path_features(b) + text_features(b):
                rows.append(i * most + t)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    w, pairs = np.zeros(len(index)), np.zeros((2, 2, 2))
    gw, gp = np.full(len(index), 1e-8), np.full((2, 2, 2), 1e-8)
    seen = np.bincount(cols[y.ravel()[rows] == 1], minlength=len(index)).astype(float)
    pair_seen = np.zeros((2, 2, 2))
    inner = mask[:, 1:]
    np.add.at(pair_seen, (kind[:, 1:][inner], y[:, :-1][inner], y[:, 1:][inner]), 1)
    for _ in range(rounds):
        s = np.zeros((n, most, 2))
        s[:, :, 1] = np.bincount(rows, w[cols], n * most).reshape(n, most)
        step = pairs[kind]                                  # (n, most, before, after)
        fore, aft = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fore[:, 0] = s[:, 0]
        for t in range(1, most):
            x = np.logaddexp.reduce(fore[:, t - 1, :, None] + step[:, t], axis=1) + s[:, t]
            fore[:, t] = np.where(mask[:, t, None], x, fore[:, t - 1])
        total = np.logaddexp.reduce(fore[:, -1], axis=1)
        for t in range(most - 2, -1, -1):
            x = np.logaddexp.reduce(step[:, t + 1] + (s[:, t + 1] + aft[:, t + 1])[:, None, :], axis=2)
            aft[:, t] = np.where(mask[:, t + 1, None], x, 0)
        p1 = np.where(mask, np.exp(np.minimum(fore[:, :, 1] + aft[:, :, 1] - total[:, None], 0)), 0)
        both = np.exp(np.minimum(fore[:, :-1, :, None] + step[:, 1:] + (s[:, 1:] + aft[:, 1:])[:, :, None, :]
                                 - total[:, None, None, None], 0)) * inner[:, :, None, None]
        pair_sum = np.stack([(both * (kind[:, 1:] == k)[:, :, None, None]).sum((0, 1)) for k in (0, 1)])
        g = (seen - np.bincount(cols, p1.ravel()[rows], len(index))) / n - decay * w
        h = (pair_seen - pair_sum) / n - decay * pairs
        gw, gp = gw + g * g, gp + h * h
        w += rate * g / np.sqrt(gw)
        pairs += rate * h / np.sqrt(gp)
    return Field({f: float(w[i]) for f, i in index.items()}, pairs.tolist())


def main_text(page: str, model: Field) -> str:
    found = model.read(page)
    return " ".join(b.text for b, label in zip(found, model.decode(found)) if label)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  model: Field | None = None) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of ``pages``.

    Null and empty pages, and pages without main text, give the empty text. Null ids and urls and
    repeated rows stay as they are; other columns are not read. Empty input: no rows.
    """
    model = model or train_field(labelled_pages())
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.pairs))      # a constant size
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        field = Field(*sent.value)
        for b in batches:
            raw = utf8(b, "html")
            for lo, hi in text_runs(raw, RUN_BYTES):
                texts = [main_text(t.decode("utf-8", "replace"), field) if t else "" for t in raw[lo:hi]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = [src.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = src.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})

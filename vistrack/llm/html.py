"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaves: runs of text between block elements, in page order, with white space folded. A leaf is
read as a vector of its tag path (names, classes, ids and roles of its ancestors, hashed), its words (hashed) and a few
numbers (length, share of link text, punctuation, place). A bidirectional LSTM in numpy reads the sequence of all leaves
of a page, so each is judged in the light of the whole document, and a logistic layer says which belong to the main
text: the article with its headings, lists, quotes and tables, without menus, page headers and footers, sidebars,
notices, adverts, forms and reader comments. Scripts, styles, templates and the head's title are no text at all.

Training. Pages carry no labels, so the network learns from pages that a seeded generator lays out (LAYOUTS of them):
articles among boilerplate, in semantic elements, in named divisions or in bare ones, with parts left unclosed. Labels
are known by construction; the words are those of a sample of the corpus (about SAMPLE pages chosen by hash, MATERIAL
leaves of each at most), so that the word features meet the languages at hand. Sampled pages whose elements tell the
article (an article or main element, and text outside it) are learned from as well. Weights, order and layouts depend on
the seed and the sample alone. The fitted model is a few hundred kB and travels with the tasks.

Labelling is a map over pages: nothing is shuffled, a task holds one batch of pages, and memory grows with the longest
page. Every leaf of every page is read and labelled.

Edge cases: null and empty pages, and pages without main text, give an empty text; pages cut off anywhere are read to
their end (an unfinished tag is dropped); rows that repeat give repeated results; null ids and urls are passed on; an
empty table gives no rows. Markup of any depth is read by one pass with one stack. Other columns are not looked at.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled pages (by hash, about), leaves taken of each and characters of a leaf; generated pages; passes over them; seed.
SAMPLE, MATERIAL, LAYOUTS, EPOCHS, SEED = 200, 300, 1200, 14, 42
#: Hashed dimensions of tag paths and of words, numbers of a leaf, cells of each direction.
PATHS, WORDS, NUMBERS, CELLS = 256, 96, 16, 24
#: Leaves that one call of the network holds (a longer page is taken alone), leaves whose vectors are held at once.
TOGETHER, CHUNK = 20_000, 4096

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text.
SILENT = frozenset("script style template title noscript iframe svg".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {**dict.fromkeys("p div section article aside main nav header footer h1 h2 h3 h4 h5 h6 ul ol dl table form blockquote pre figure figcaption address details hr fieldset".split(), ("p",)), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "tr", "td", "th"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}
#: Where the search for an element to close ends.
SCOPE = frozenset("html body table td th ul ol dl div section article aside main nav header footer form blockquote".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|\d+")


class Leaf:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: float):
        self.text, self.path, self.linked = text, path, linked


def leaves(html: str | None) -> list[Leaf]:
    """The runs of text between block elements. The path has (name, tokens) of the open elements, outermost first."""
    html, out, stack, opened = html or "", [], [], {}
    parts, size, links, path, at, n = [], 0, 0, None, 0, len(html)

    def flush():
        nonlocal parts, size, links, path
        text = " ".join("".join(parts).split())
        if text:
            out.append(Leaf(text, path, links / max(1, size)))
        parts, size, links, path = [], 0, 0, None

    def close(k: int):
        while len(stack) > k:
            name = stack.pop()[0]
            opened[name] -= 1

    def say(raw: str):
        nonlocal size, links, path
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            bare = len(text.strip())
            size += bare
            links += bare if opened.get("a") else 0
            if path is None and bare:
                path = tuple(stack[-16:])

    while at < n:
        m = TAG.search(html, at)
        if not m:
            # an unfinished quote or a lone sign: text up to a tag that never ends
            i = at
            while (i := html.find("<", i)) >= 0 and not re.match(r"</?[A-Za-z]", html[i : i + 3]):
                i += 1
            say(html[at:] if i < 0 else html[at:i])
            break
        say(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None or not m[0].endswith(">"):
            continue
        name = name.lower()
        if name not in INLINE:
            if name == "br":
                parts.append(" ")
                continue
            flush()
        if m[1]:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name in SILENT:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else (at if name == "noscript" else n)
            continue
        for other in CLOSES.get(name, ()):
            if opened.get(other):
                k = len(stack) - 1
                while k >= 0 and stack[k][0] != other and stack[k][0] not in SCOPE:
                    k -= 1
                if k >= 0 and stack[k][0] == other:
                    close(k)
        if name not in VOID and not m[3].endswith("/"):
            tokens = []
            for a in NAMED.finditer(m[3]):
                tokens += [t.lower() for t in PART.findall(a[2] or a[3] or a[4] or "")]
            stack.append((name, tuple(tokens[:12])))
            opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def _hash(token: str, kind: str, size: int) -> int:
    return zlib.crc32(f"{kind}{token}".encode("utf-8", "surrogatepass")) % size


class Vectors:
    """Vectors of leaves. Hashes of tokens are remembered while a task runs."""

    def __init__(self):
        self.paths, self.words, self.labels = {}, {}, {}

    def path(self, path: tuple) -> list[int]:
        got = self.paths.get(path)
        if got is None:
            tokens = [f"^{path[-1][0]}"] if path else []
            for name, named in path:
                tokens += [name, *named]
            got = sorted({_hash(t, "p", PATHS) for t in tokens})
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = got
        return got

    def word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 200_000:
                self.words.clear()
            got = self.words[word] = _hash(word.lower(), "w", WORDS)
        return got

    def __call__(self, page: list[Leaf], start: int, stop: int):
        import numpy as np

        x, n = np.zeros((stop - start, PATHS + WORDS + NUMBERS), np.float32), len(page)
        for row, i in enumerate(range(start, stop)):
            leaf = page[i]
            text, words = leaf.text, leaf.text.split(" ")
            x[row, self.path(leaf.path)] = 1.0
            counts = np.bincount([self.word(w) for w in words], minlength=WORDS)
            x[row, PATHS : PATHS + WORDS] = counts / len(words) ** 0.5
            ends = [w[-1] in ".!?:;,…" for w in words]
            last = leaf.path[-1][0] if leaf.path else ""
            names = {p[0] for p in leaf.path}
            x[row, PATHS + WORDS :] = (
                np.log1p(len(words)) / 3, np.log1p(len(text)) / 4, leaf.linked, text[0].isupper(), text[-1] in ".!?…\"»", sum(ends) / len(words),
                sum(map(str.isdigit, text[:4000])) / min(4000, len(text)), i / n, 1 / (1 + i), 1 / (n - i), last in ("h1", "h2", "h3", "h4", "h5", "h6"),
                "li" in names, "©" in text or "|" in text or "·" in text, len(text) / len(words) / 10, last == "p", np.log1p(n) / 4,
            )
        return x


def _squash(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic layer; weights are a dict of arrays. Sequences are taken longest first,
    so that the ones still running are a prefix of the batch and no padding is read."""

    def __init__(self, weights: dict):
        self.w = weights

    @staticmethod
    def fresh(seed: int) -> dict:
        import numpy as np

        rng, width = np.random.default_rng(seed), PATHS + WORDS + NUMBERS
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.1, (width, 4 * CELLS)).astype(np.float32)
            w[f"h{d}"] = rng.normal(0, CELLS**-0.5, (CELLS, 4 * CELLS)).astype(np.float32)
            w[f"c{d}"] = np.concatenate([np.zeros(CELLS), np.ones(CELLS), np.zeros(2 * CELLS)]).astype(np.float32)
        w["o"], w["ob"] = rng.normal(0, 0.2, 2 * CELLS).astype(np.float32), np.zeros(1, np.float32)
        return w

    def drive(self, x) -> list:
        """What leaves add to the gates of the two directions."""
        return [x @ self.w[f"x{d}"] + self.w[f"c{d}"] for d in "fb"]

    def pass_over(self, gates, lengths, d: str):
        """States of all steps, and what the way back needs."""
        import numpy as np

        b, steps, _ = gates.shape
        h, c = np.zeros((b, CELLS), np.float32), np.zeros((b, CELLS), np.float32)
        out, kept = np.zeros((b, steps, CELLS), np.float32), []
        for t in range(steps):
            k = int((lengths > t).sum())
            z = gates[:k, t] + h[:k] @ self.w[f"h{d}"]
            s, g = _squash(z[:, : 3 * CELLS]), np.tanh(z[:, 3 * CELLS :])
            i, f, o = s[:, :CELLS], s[:, CELLS : 2 * CELLS], s[:, 2 * CELLS :]
            before, state = c[:k].copy(), h[:k].copy()
            c[:k] = f * before + i * g
            tc = np.tanh(c[:k])
            h[:k] = o * tc
            out[:k, t] = h[:k]
            kept.append((k, i, f, o, g, before, tc, state))
        return out, kept

    def way_back(self, grad, kept, d: str):
        """Gradients of the gates and of the recurrent weights."""
        import numpy as np

        b, steps, _ = grad.shape
        dz, du = np.zeros((b, steps, 4 * CELLS), np.float32), np.zeros_like(self.w[f"h{d}"])
        dh, dc = np.zeros((b, CELLS), np.float32), np.zeros((b, CELLS), np.float32)
        for t in range(steps - 1, -1, -1):
            k, i, f, o, g, before, tc, state = kept[t]
            own = grad[:k, t] + dh[:k]
            cell = dc[:k] + own * o * (1 - tc * tc)
            z = np.concatenate([cell * g * i * (1 - i), cell * before * f * (1 - f), own * tc * o * (1 - o), cell * i * (1 - g * g)], 1)
            dz[:k, t] = z
            du += state.T @ z
            dh[:k], dc[:k] = z @ self.w[f"h{d}"].T, cell * f
        return dz, du

    @staticmethod
    def reverse(lengths, steps: int):
        import numpy as np

        at = lengths[:, None] - 1 - np.arange(steps)
        return np.where(at >= 0, at, np.arange(steps))

    def states(self, gates, lengths):
        import numpy as np

        back = self.reverse(lengths, gates[0].shape[1])[..., None]
        f, kf = self.pass_over(gates[0], lengths, "f")
        b, kb = self.pass_over(np.take_along_axis(gates[1], back, 1), lengths, "b")
        return np.concatenate([f, np.take_along_axis(b, back, 1)], 2), (kf, kb, back)

    def scores(self, pages: list, vectors: Vectors) -> list:
        """Of each page an array with the probability of each leaf."""
        import numpy as np

        order, out, i = sorted(range(len(pages)), key=lambda p: -len(pages[p])), [np.zeros(0)] * len(pages), 0
        while i < len(order) and pages[order[i]]:
            longest = len(pages[order[i]])
            some = [p for p in order[i : i + max(1, TOGETHER // longest)] if pages[p]]
            i += len(some)
            lengths = np.array([len(pages[p]) for p in some])
            gates = [np.zeros((len(some), longest, 4 * CELLS), np.float32) for _ in "fb"]
            for row, p in enumerate(some):
                for at in range(0, len(pages[p]), CHUNK):
                    stop = min(len(pages[p]), at + CHUNK)
                    for g, z in zip(gates, self.drive(vectors(pages[p], at, stop)), strict=True):
                        g[row, at:stop] = z
            h, _ = self.states(gates, lengths)
            prob = _squash(h @ self.w["o"] + self.w["ob"])
            for row, p in enumerate(some):
                out[p] = prob[row, : len(pages[p])]
        return out

    def gradients(self, x, y, lengths):
        """Loss a leaf and gradients of all weights, of a batch (longest first) of x (b, steps, width) and y (b, steps)."""
        import numpy as np

        gates = self.drive(x)
        h, (kf, kb, back) = self.states(gates, lengths)
        on = np.arange(x.shape[1]) < lengths[:, None]
        p = _squash(h @ self.w["o"] + self.w["ob"])
        err = np.where(on, p - y, 0).astype(np.float32) / on.sum()
        loss = -np.where(on, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0).sum() / on.sum()
        g = {"o": np.einsum("bt,bth->h", err, h), "ob": np.array([err.sum()], np.float32)}
        dh = err[..., None] * self.w["o"]
        for d, grad, kept in (("f", dh[..., :CELLS], kf), ("b", np.take_along_axis(dh[..., CELLS:], back, 1), kb)):
            dz, g[f"h{d}"] = self.way_back(grad, kept, d)
            dz = dz if d == "f" else np.take_along_axis(dz, back, 1)
            dz = np.where(on[..., None], dz, 0)
            g[f"x{d}"], g[f"c{d}"] = np.einsum("btw,btz->wz", x, dz, optimize=True), dz.sum((0, 1))
        return loss, g


def fit(pages: list, seed: int = SEED, epochs: int = EPOCHS, batch: int = 24) -> Labeller:
    """A labeller of pages given as (leaves, labels), by Adam over batches of pages of like length."""
    import numpy as np

    net, vectors, rng = Labeller(Labeller.fresh(seed)), Vectors(), np.random.default_rng(seed)
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    sets = []
    for i in range(0, len(pages), batch):
        some = pages[i : i + batch]
        lengths = np.array([len(p[0]) for p in some])
        x, y = np.zeros((len(some), lengths[0], PATHS + WORDS + NUMBERS), np.float32), np.zeros((len(some), lengths[0]), np.float32)
        for row, (page, labels) in enumerate(some):
            x[row, : len(page)], y[row, : len(page)] = vectors(page, 0, len(page)), labels
        sets.append((x, y, lengths))
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
        for s in rng.permutation(len(sets)):
            x, y, lengths = sets[s]
            # names of classes are dropped now and then, so that words and places are learned too
            hide = rng.random((len(x), 1, PATHS)) < 0.15
            x = np.concatenate([np.where(hide, 0, x[..., :PATHS]), x[..., PATHS:]], 2)
            _, g = net.gradients(x, y, lengths)
            norm = sum(float((v * v).sum()) for v in g.values()) ** 0.5
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


#: Names that pages give to the parts of a page, and phrases that stand in parts other than the article, in four languages.
NAMES = {
    "main": "article content post entry story main body text article-body post-content entry-content page-content story-body main-content articleBody blog-post news-text inhalt contenu contenido".split(),
    "nav": "nav menu navbar navigation topnav main-menu breadcrumbs breadcrumb site-nav tabs pager pagination toc".split(),
    "header": "header masthead site-header top banner-top branding logo topbar page-header kopf".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot page-footer".split(),
    "side": "sidebar aside side right-column rail widget widgets related recommended popular trending more-stories secondary tags".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay newsletter-popup message paywall announcement".split(),
    "ad": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner ad-slot adsense werbung publicite".split(),
    "form": "form search search-form login signup subscribe newsletter contact-form subscription".split(),
    "comment": "comments comment comment-list commentlist discussion replies responses reader-comments user-comments disqus feedback respond".split(),
    "share": "share social sharing social-links share-buttons follow tools".split(),
}
PHRASES = {
    "nav": "Home|News|About|Contact|Archive|Start|Kontakt|Über uns|Accueil|À propos|Inicio|Noticias|Contacto|Sports|Next|Previous|Skip to content|Menu|Login|Sign in".split("|"),
    "footer": "© 2024 {w}. All rights reserved.|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|© {w} · {s}|Powered by {w}|Imprint|Copyright {w}|{s}".split("|"),
    "side": "Related articles|Most read|Popular|Tags|Latest posts|Mehr zum Thema|À lire aussi|Te puede interesar|{w} {w} {w}|{s}|About the author|Follow us".split("|"),
    "notice": "We use cookies to improve your experience.|Diese Seite verwendet Cookies.|Ce site utilise des cookies.|Este sitio usa cookies.|Accept|OK|Please enable JavaScript.|{s}|{s} {s}|Breaking: {s}|You have read {n} of {n} articles.".split("|"),
    "ad": "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|{s}|{s}|{s} {s}|Buy now|Only {n} left|{w} {w} {n}%".split("|"),
    "form": "Search|Email|Name|Subscribe to our newsletter|Sign up|Send|Password|Suchen|Rechercher|Buscar|{s}|Your message".split("|"),
    "comment": "{n} comments|Leave a reply|Reply|{w} says:|{n} hours ago|Kommentare|Commentaires|Comentarios|Posted by {w}|Report".split("|"),
    "share": "Share|Tweet|Facebook|Print|Email this|Teilen|Partager|Compartir|{n} shares".split("|"),
}
#: Words for pages where the corpus has none.
SPARE = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


class Layout:
    """A page laid out by chance: ``html`` with MARK before each run of main text."""

    MARK = "\ue000"

    def __init__(self, rng: random.Random, material: list[str]):
        self.rng, self.words = rng, material
        # how much the page tells by its elements and names
        self.style = rng.choice(["semantic", "named", "named", "both", "bare"])
        parts = [self.head()]
        top = [x for x, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.4), ("form", 0.15)) if rng.random() < p]
        rng.shuffle(top)
        low = [x for x, p in (("share", 0.25), ("comment", 0.4), ("side", 0.5), ("ad", 0.25), ("form", 0.25), ("nav", 0.2), ("notice", 0.2)) if rng.random() < p]
        rng.shuffle(low)
        middle = [self.article(), *map(self.part, low)]
        if rng.random() < 0.2:
            middle.insert(0, self.part("side"))
        middle = "".join(middle)
        if rng.random() < 0.4:
            middle = f"<div{self.named(rng.choice(['page', 'wrapper', 'container', 'row', 'layout']), 0.7)}>{middle}</div>"
        parts += [*map(self.part, top), middle]
        if rng.random() < 0.8:
            parts.append(self.part("footer"))
        if rng.random() < 0.2:
            parts.append(self.part("notice"))
        end = "</body></html>" if rng.random() < 0.9 else ""
        self.html = "".join(parts) + end

    def named(self, name: str, chance: float = 1.0) -> str:
        if self.style == "bare" or self.rng.random() > chance:
            return ""
        return f' {self.rng.choice(["class", "class", "id"])}="{name}{self.rng.choice(["", "", "-1", "-inner", " block", " clearfix"])}"'

    def word(self) -> str:
        return self.rng.choice(self.words)

    def sentence(self, low: int = 2, high: int = 14) -> str:
        w = [self.word() for _ in range(self.rng.randint(low, high))]
        text = " ".join(w).strip(".,;:")
        return text[:1].upper() + text[1:] + self.rng.choice(["."] * 6 + ["!", "?", ""])

    def prose(self) -> str:
        n = self.rng.choice([1, 1, 2, 3, 5, 8])
        text = " ".join(self.sentence(1, 16) for _ in range(n))
        if self.rng.random() < 0.15:
            text = re.sub(r" (\S+) ", self.rng.choice([r" <b>\1</b> ", r' <a href="/x">\1</a> ', r" <em>\1</em> ", r" &amp; \1<br>"]), text, count=2)
        return text

    def phrase(self, part: str) -> str:
        text = self.rng.choice(PHRASES[part])
        text = text.replace("{n}", str(self.rng.randint(1, 99)))
        while "{" in text:
            text = text.replace("{w}", self.word(), 1) if "{w}" in text else text.replace("{s}", self.sentence(), 1)
        return text

    def head(self) -> str:
        return f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>f(1)</script></head><body>"

    def wrap(self, part: str, body: str, *elements: str) -> str:
        e = self.rng.choice(elements) if self.style in ("semantic", "both") else "div"
        name = "" if self.style == "semantic" else self.named(self.rng.choice(NAMES[part]))
        return f"<{e}{name}>{body}</{e}>"

    def items(self, part: str) -> str:
        rng, rows = self.rng, []
        for _ in range(rng.randint(2, 9)):
            text = self.phrase(part) if rng.random() < 0.4 else " ".join(self.word() for _ in range(rng.choice([1, 1, 2, 6])))
            rows.append(f'<a href="/{len(rows)}">{text}</a>')
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>"
        return rng.choice([" | ", " ", "<br>"]).join(rows) if rng.random() < 0.5 else "".join(f"<div>{r}</div>" for r in rows)

    def part(self, part: str) -> str:
        rng = self.rng
        if part == "nav":
            return self.wrap("nav", self.items("nav"), "nav", "nav", "div")
        if part == "header":
            h = rng.choice(["h1", "div", "p", "h2"])
            body = f"<{h}>{self.sentence(1, 4)}</{h}>" if rng.random() < 0.6 else f'<a href="/">{self.word()}</a>'
            return self.wrap("header", body + (f"<p>{self.sentence(2, 8)}</p>" if rng.random() < 0.4 else "") + (self.items("nav") if rng.random() < 0.3 else ""), "header")
        if part == "footer":
            body = "".join(f"<p>{self.phrase('footer')}</p>" for _ in range(rng.randint(1, 3))) if rng.random() < 0.4 else rng.choice(["&copy; ", "", "© "]) + self.phrase("footer") + rng.choice(["", " &middot; " + self.sentence()])
            return self.wrap("footer", body + (self.items("footer") if rng.random() < 0.4 else ""), "footer")
        if part == "side":
            body = "".join(f"<h3>{self.phrase('side')}</h3>{self.items('side') if rng.random() < 0.7 else f'<p>{self.prose()}</p>'}" for _ in range(rng.randint(1, 3)))
            return self.wrap("side", body, "aside", "aside", "section")
        if part == "notice":
            body = f"<p>{self.phrase('notice')}</p>" if rng.random() < 0.6 else self.phrase("notice")
            return self.wrap("notice", body + (f"<button>{self.phrase('notice')}</button>" if rng.random() < 0.5 else ""), "div", "aside", "dialog")
        if part == "ad":
            body = self.phrase("ad")
            return self.wrap("ad", f"<p>{body}</p>" if rng.random() < 0.4 else body, "aside", "div") if self.style != "semantic" else f'<div class="{rng.choice(NAMES["ad"])}">{body}</div>'
        if part == "form":
            body = "".join(rng.choice(["<label>{}</label><input>", "<p>{}</p>", "<button>{}</button>", "<h4>{}</h4>", "<select><option>{}</option></select>"]).format(self.phrase("form")) for _ in range(rng.randint(1, 4)))
            return f"<form{self.named(rng.choice(NAMES['form']), 0.7)}>{body}</form>" if rng.random() < 0.8 else self.wrap("form", body, "form", "section")
        if part == "share":
            return self.wrap("share", self.items("share"), "div", "ul", "section")
        rows = []
        for _ in range(rng.randint(1, 6)):
            who = rng.choice([f"<b>{self.word()}</b>", f"<h4>{self.phrase('comment')}</h4>", f"<span>{self.word()}</span><time>{rng.randint(1, 28)}.{rng.randint(1, 12)}.2023</time>", f"<cite>{self.word()}</cite>"])
            rows.append(f"{who}<p>{self.prose()}</p>" + (f'<a href="#r">{self.phrase("comment")}</a>' if rng.random() < 0.5 else ""))
        one = "li" if rng.random() < 0.4 else rng.choice(["div", "article"]) if self.style != "bare" else "div"
        body = "".join(f"<{one}{self.named('comment', 0.6)}>{r}</{one}>" for r in rows)
        body = (f"<h3>{self.phrase('comment')}</h3>" if rng.random() < 0.7 else "") + (f"<ol>{body}</ol>" if one == "li" else body)
        return self.wrap("comment", body, "section", "section", "div")

    def article(self) -> str:
        rng, m, parts = self.rng, self.MARK, []
        if rng.random() < 0.85:
            h = rng.choice(["h1", "h1", "h1", "h2"])
            title = f"<{h}{self.named(rng.choice(['title', 'headline', 'entry-title']), 0.3)}>{m}{self.sentence(2, 10)}</{h}>"
            parts.append(f"<header>{title}</header>" if self.style in ("semantic", "both") and rng.random() < 0.3 else title)
        if rng.random() < 0.15:
            parts.append(self.part(rng.choice(["share", "ad", "side"])))
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14, 22])):
            x = rng.random()
            if x < 0.6:
                parts.append(f"<p>{m}{self.prose()}" + rng.choice(["</p>", "</p>", "</p>", "</p>\n", ""]))
            elif x < 0.68:
                parts.append(f"<p><b>{m}{self.sentence()}<br>" + rng.choice(["", "</b>", "</b></p>"]) + f"<p>{m}{self.prose()}</p>")
            elif x < 0.77:
                parts.append(f"<h{(k := rng.choice('234'))}>{m}{self.sentence(1, 6)}</h{k}>")
            elif x < 0.84:
                k = rng.choice(["ul", "ol"])
                parts.append(f"<{k}>" + "".join(f"<li>{m}{self.sentence(1, 12)}</li>" for _ in range(rng.randint(2, 5))) + f"</{k}>")
            elif x < 0.9:
                k = rng.choice(["blockquote", "pre", "div", "figcaption"])
                parts.append(f"<{k}>{m}{self.prose()}</{k}>" if k != "blockquote" else f"<blockquote><p>{m}{self.prose()}</p></blockquote>")
            elif x < 0.92:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.sentence(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                parts.append(self.part(rng.choice(["ad", "ad", "ad", "side", "form", "share", "notice"])))
        if rng.random() < 0.08:  # the same line again and again
            parts += [f"<p>{m}{self.sentence(1, 5)}</p>"] * rng.randint(3, 30)
        body = "".join(parts)
        if rng.random() < 0.3:
            body = f"<div{self.named(rng.choice(NAMES['main']), 0.8)}>{body}</div>"
        if rng.random() < 0.1:
            return f"<table><tr><td>{self.items('nav')}</td><td>{body}</td></tr></table>"
        e = rng.choice(["article", "article", "main", "section"]) if self.style in ("semantic", "both") else rng.choice(["div", "div", "div", "section", "article"])
        name = "" if self.style == "semantic" else self.named(rng.choice(NAMES["main"]), 0.9)
        if e == "main" and rng.random() < 0.5:
            body = f"<article>{body}</article>"
        return f"<{e}{name}>{body}</{e}>"

    def labelled(self) -> tuple[list[Leaf], list[int]]:
        page = leaves(self.html)
        labels = [int(self.MARK in x.text) for x in page]
        for x in page:
            x.text = " ".join(x.text.replace(self.MARK, "").split()) or "."
        return page, labels


def told(page: list[Leaf]) -> list[int] | None:
    """Labels of a page that tells by its elements what its article is; None if it does not."""
    inside = [[p[0] for p in x.path] for x in page]
    labels = [int(("article" in names or "main" in names) and not APART & set(names)) for names in inside]
    return labels if any(labels) and any("article" in names for names in inside) and not all(labels) else None


#: Elements that hold no main text, for pages that tell their article.
APART = frozenset("nav aside footer form dialog button select".split())


def sampled(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> list[list[Leaf]]:
    """Leaves of a sample of the pages, the same ones in every run: at most MATERIAL of a page, of each at most as
    many characters."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [[(x.text[:MATERIAL].rstrip(), x.path, x.linked) for x in leaves(h.as_py())[:MATERIAL]] for h in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(f) for f in found], pa.string())], names=["page"])

    own = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{html_col}`"))
    n = pages.count()
    some = pages.where(F.pmod(own, F.lit(max(1, n // sample))) == 0).select(F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = some.mapInArrow(run, "page string").distinct().orderBy("page").limit(4 * sample).collect()
    return [[Leaf(text, tuple((name, tuple(named)) for name, named in path), linked) for text, path, linked in json.loads(r["page"])] for r in rows]


def train(pages: list[list[Leaf]], layouts: int = LAYOUTS, seed: int = SEED, epochs: int = EPOCHS) -> Labeller:
    """A labeller from pages laid out by the seed with the words of the given ones, and from those of the given pages
    whose elements tell the article."""
    rng, words = random.Random(seed), [w for page in pages for x in page for w in x.text.split(" ")]
    known = [(page, labels) for page in pages if (labels := told(page))]
    return fit(known + [Layout(rng, words or SPARE).labelled() for _ in range(layouts)], seed, epochs)


def labelled_blocks(pages: DataFrame, net: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, blocks) with the blocks of each page in order: array of (text, path, score)."""
    weights = net.w

    def run(batches):
        import pyarrow as pa

        model, vectors = Labeller(weights), Vectors()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                found = [leaves(h.as_py()) for h in b.column(2)]
                scores = model.scores(found, vectors)
                rows = [[{"text": x.text, "path": "/".join(p[0] for p in x.path), "score": float(s)} for x, s in zip(page, own, strict=True)] for page, own in zip(found, scores, strict=True)]
                kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, kind)], names=schema.names)

    block = T.StructType([T.StructField("text", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("blocks", T.ArrayType(block))])
    return pages.select(f"`{id_col}`", f"`{url_col}`", F.col(f"`{html_col}`").cast("string").alias("_html")).mapInArrow(run, schema)


def main_text(pages: DataFrame, net: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text): the blocks of the main text, joined by single spaces."""
    got = labelled_blocks(pages, net, id_col, url_col, html_col)
    kept = F.transform(F.filter("blocks", lambda x: x["score"] >= 0.5), lambda x: x["text"])
    return got.select(f"`{id_col}`", f"`{url_col}`", F.array_join(kept, " ").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = main_text(pages, train(sampled(pages)))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

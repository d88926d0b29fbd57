"""Main-text extraction: a linear-chain conditional random field over leaf blocks.

Each block of a page is main text or not. The score of a labelling is a sum of
weights of the blocks' features (``html_blocks.features``) with their labels and
of pairs of neighbouring labels; weights maximise the likelihood of labelled
pages less a quadratic penalty, by stochastic gradient steps with forward and
backward sums. A page's labels are the best labelling, by Viterbi.

The tables hold no labelled pages, so the default model is trained on pages that
``training_pages`` writes from a fixed seed: articles in many mark-ups, among
menus, headers, footers, side columns, notices, adverts, forms and comments, with
mark-up errors. ``fit_extractor`` takes others.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .html_blocks import Block, Element, blocks, features, own_features


@dataclass
class Extractor:
    """weights[feature] = (not main, main); moves[a][b] for label b after a."""

    weights: dict[str, tuple[float, float]]
    moves: list[list[float]]

    def _above(self, element: Element) -> tuple[float, float]:
        """Summed weights of all names around a block; each element's are added once to those above it."""
        chain, none = [], (0.0, 0.0)
        while element is not None and element.sums is None:
            chain.append(element)
            element = element.above
        e0, e1 = element.sums if element is not None else none
        for each in reversed(chain):
            for name in each.names:
                w = self.weights.get(name, none)
                e0 += w[0]
                e1 += w[1]
            each.sums = (e0, e1)
        return e0, e1

    def labels(self, found: list[Block]) -> list[int]:
        """The best labelling, by Viterbi; ties go to the smaller label."""
        get, none = self.weights.get, (0.0, 0.0)
        (m00, m01), (m10, m11) = self.moves
        s0 = s1 = 0.0
        back: list[tuple[int, int]] = []
        for b, own in zip(found, own_features(found)):
            e0, e1 = self._above(b.element)
            for f in own:
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if back:
                a0, a1, b0, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
                back.append((0 if a0 >= a1 else 1, 0 if b0 >= b1 else 1))
                s0, s1 = max(a0, a1) + e0, max(b0, b1) + e1
            else:
                back.append((0, 0))
                s0, s1 = e0, e1
        label, out = int(s1 > s0), []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return out[::-1]

    def text(self, html: str | None) -> str:
        found = blocks(html or "")
        return " ".join(b.text for b, y in zip(found, self.labels(found)) if y)


def loss_and_gradients(emissions: np.ndarray, moves: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the labels ``y``, and its gradients by the blocks' scores and by the moves; forward and backward sums."""
    n = len(y)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = emissions[0]
    for i in range(1, n):
        forward[i] = np.logaddexp(forward[i - 1, 0] + moves[0], forward[i - 1, 1] + moves[1]) + emissions[i]
    for i in range(n - 2, -1, -1):
        after = emissions[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(moves[:, 0] + after[0], moves[:, 1] + after[1])
    total = np.logaddexp(forward[-1, 0], forward[-1, 1])
    single = np.exp(forward + backward - total)
    single[np.arange(n), y] -= 1
    pair = np.exp(forward[:-1, :, None] + moves + (emissions[1:] + backward[1:])[:, None, :] - total).sum(axis=0) if n > 1 else np.zeros((2, 2))
    np.subtract.at(pair, (y[:-1], y[1:]), 1)
    path = emissions[np.arange(n), y].sum() + moves[y[:-1], y[1:]].sum()
    return float(total - path), single, pair


def fit_extractor(pages: list[str], epochs: int = 10, rate: float = 0.3, penalty: float = 1e-4, seed: int = 5) -> Extractor:
    """Train on pages whose main text lies in elements with ``data-main``, less those with ``data-other``. Pages without blocks are skipped."""
    index: dict[str, int] = {}
    data = []
    for html in pages:
        found = blocks(html)
        if found:
            rows = [np.array([index.setdefault(f, len(index)) for f in own]) for own in features(found)]
            data.append((rows, np.array([int(b.main) for b in found])))
    w, squares = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-6)
    t, t_squares = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            rows, y = data[k]
            _, single, pair = loss_and_gradients(np.array([w[r].sum(axis=0) for r in rows]), t, y)
            at = np.concatenate(rows)
            keys, where = np.unique(at, return_inverse=True)
            grad = np.zeros((len(keys), 2))
            np.add.at(grad, where, np.repeat(single, [len(r) for r in rows], axis=0))
            grad += penalty * w[keys]
            squares[keys] += grad**2
            w[keys] -= rate * grad / np.sqrt(squares[keys])
            if len(y) > 1:
                pair += penalty * t
                t_squares += pair**2
                t -= rate * pair / np.sqrt(t_squares)
    return Extractor({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, t.tolist())


def training_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Labelled pages written from a seed."""
    rng = random.Random(seed)
    parts = "ka lo mi ner tus vel dor san pe ri gul em ost af ly bren cho wu ze ix".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 4, high: int = 18) -> str:
        return words(low, high).capitalize() + rng.choice("....!?")

    def prose() -> str:
        text = " ".join(sentence() for _ in range(rng.choice((0, 1, 1, 2, 4, 8)) + 1))
        if rng.random() < 0.2:
            text = text.replace(" ", f" <a href='/{words(1, 1)}'>{words(1, 2)}</a> ", 1)
        if rng.random() < 0.2:
            text = f"<{rng.choice(('b', 'em', 'i', 'strong'))}>" + text + rng.choice(("", "<br>", "</b>"))
        return text + rng.choice(("", "", "", " &amp; &#8212;", " &copy; 2019."))

    def menu(most: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 2)}</a>{rng.choice(("</li>", ""))}' for k in range(rng.randint(2, most))) + "</ul>"

    def named(tags: str, names: str) -> tuple[str, str]:
        tag = rng.choice(tags.split())
        return f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(names.split())}{rng.choice(("", " box", "-wrap", "-1"))}">', f"</{tag}>"

    def around(tags: str, names: str, inside: str, bare: str = "") -> str:
        a, b = named(tags, names)
        if bare and rng.random() < 0.5:
            a, b = f"<{bare}>", f"</{bare}>"
        return a + inside + b

    def advert() -> str:
        return around("div aside section", "ad ads advert banner sponsored promo", rng.choice((sentence(), sentence(3, 30), f"<p>{prose()}</p>", f"<a href='x'>{words(2, 6)}</a>")))

    def comments() -> str:
        each = "".join(around("div li div section article", "comment reply", f"<p>{rng.choice((prose(), sentence()))}</p>" + f"<span>{words(1, 2)}</span>") for _ in range(rng.randint(1, 6)))
        return around("div section ol", "comments discussion responses respond", f"<h3>{words(1, 3)}</h3>" + each)

    def chrome(kind: str) -> str:
        if kind == "head":
            return around("div", "header masthead top site-header branding", f"<a href='/'>{words(1, 3)}</a> <p>{sentence(2, 7)}</p>", "header")
        if kind == "menu":
            return around("div", "nav menu navigation breadcrumb navbar", menu(), "nav")
        if kind == "side":
            return around("div section", "sidebar side related widget popular", f"<h3>{words(1, 3)}</h3>" + rng.choice((menu(), f"<p>{prose()}</p>")), "aside")
        if kind == "notice":
            return around("div section p", "cookie notice consent gdpr alert newsletter popup modal", rng.choice((sentence(4, 22), f"<p>{prose()}</p>")) + "<button>" + words(1, 1) + "</button>")
        if kind == "form":
            return f"<form action='/{words(1, 1)}'><label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button>{sentence(2, 8)}</form>"
        if kind == "foot":
            text = f"&copy; {rng.choice(('2020 ', ''))}{words(1, 2)} &middot; {sentence()}"
            return around("div", "footer foot copyright colophon site-footer", rng.choice((text, f"<p>{text}</p>", text + menu(4))), "footer")
        return advert() if kind == "advert" else comments()

    def article() -> str:
        body = f"<h1>{words(2, 12)}</h1>" if rng.random() < 0.9 else ""
        for _ in range(rng.choice((1, 2, 3, 4, 6, 9, 14))):
            r = rng.random()
            if r < 0.8:
                body += f"<p>{prose()}{rng.choice(('</p>', '</p>', ''))}"
            elif r < 0.86:
                body += f"<h2>{words(2, 7)}</h2>"
            elif r < 0.91:
                body += "<ul>" + "".join(f"<li>{sentence(2, 10)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            elif r < 0.94:
                body += f"<blockquote><p>{prose()}</p></blockquote>"
            elif r < 0.96:
                body += f"<table><tr><td>{words(1, 4)}<td>{sentence(2, 6)}</table>"
            else:
                body += re.sub(r"^<(\w+)", r"<\1 data-other", chrome(rng.choice(("advert", "advert", "side", "form", "notice"))))
        a, b = rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), named("div section td", "content main article post entry story body text")))
        wrappers = rng.choice((0, 0, 1, 2, 6))
        return "<div>" * wrappers + a.replace(">", " data-main>") + body + b + "</div>" * wrappers

    pages = []
    for k in range(n):
        before = [chrome(x) for x in rng.choices(("head", "menu", "menu", "notice", "advert", "side", "form"), k=rng.randint(0, 4))]
        after = [chrome(x) for x in rng.choices(("comments", "side", "advert", "form", "menu", "notice"), k=rng.randint(0, 3))] + [chrome("foot")] * rng.choice((1, 1, 0))
        middle = article() if rng.random() < 0.95 else ""
        end = rng.choice(("</body></html>", "</body></html>", ""))
        pages.append(f"<!DOCTYPE html><html lang='x'><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body><script>var a = '<p>{k}</p>';</script>{''.join(before)}{middle}{''.join(after)}{end}")
    return pages


def extract_main_text(pages: DataFrame, model: Extractor | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, text and n_chars, its code points.

    text is the main blocks of the whole page in order, joined by one space; it
    is empty for a null, empty or textless page. Elements may be nested to any
    depth and have any number of names. Repeated rows are extracted each; other
    columns are ignored. An empty table gives an empty result.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or fit_extractor(training_pages()))
    rows = pages.select(id_col, *keep, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"))
    schema = rows.limit(0).drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [m.text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, schema)

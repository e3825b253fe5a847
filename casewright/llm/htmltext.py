"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf blocks in order.  Each block is a vector of hashed
path labels, hashed words and a few sizes; a bidirectional LSTM in numpy reads
the whole page and labels every block as article or clutter.  The network is
trained here, on made-up pages whose labels are known.

Defined cases: null, empty or unparsable html gives an empty text; repeated
rows give equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.htmlblocks import blocks, made_page
from casewright.llm.words import texts_words

PATH, WORDS, SIZES = 192, 16, 6
WIDTH = PATH + WORDS + SIZES
UNITS = 12


@cache
def _labels() -> dict[str, np.ndarray]:
    return {}


def _path_vector(path: str) -> np.ndarray:
    known = _labels()
    if path not in known:
        if len(known) > 50_000:
            known.clear()
        v = np.zeros(PATH, np.float32)
        names = path.split()
        for name in names:
            v[zlib.crc32(name.encode()) % (PATH - 32)] = 1
        for name in names[-1:]:
            v[PATH - 32 + zlib.crc32(b"leaf" + name.encode()) % 32] = 1
        known[path] = v
    return known[path]


def vectors(found: list[tuple[str, str, int]]) -> np.ndarray:
    """(blocks, WIDTH) for the blocks of many pages in a row."""
    out = np.zeros((len(found), WIDTH), np.float32)
    if not found:
        return out
    words, counts = texts_words([t.encode("utf-8", "surrogatepass") for t, _, _ in found])
    owner = np.repeat(np.arange(len(found)), counts)
    bag = np.bincount(owner * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=len(found) * WORDS).reshape(-1, WORDS)
    out[:, :PATH] = [_path_vector(p) for _, p, _ in found]
    out[:, PATH : PATH + WORDS] = bag / np.maximum(counts, 1)[:, None] * 0.3
    size = np.array([len(t) for t, _, _ in found], np.float32)
    out[:, PATH + WORDS] = np.log1p(size) / 6
    out[:, PATH + WORDS + 1] = [min(1.0, n / max(1, len(t))) for t, _, n in found]
    out[:, PATH + WORDS + 2] = np.log1p(counts) / 5
    out[:, PATH + WORDS + 3] = [t[-1] in ".!?" for t, _, _ in found]
    out[:, PATH + WORDS + 4] = [t[0] in "©" for t, _, _ in found]
    out[:, PATH + WORDS + 5] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        u = UNITS
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((WIDTH, 4 * u)) / np.sqrt(20)).astype(np.float32)
            self.p["h" + d] = (rng.standard_normal((u, 4 * u)) / np.sqrt(u)).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(u), np.ones(u), np.zeros(2 * u)]).astype(np.float32)
        self.p["o"], self.p["oc"] = (rng.standard_normal(2 * u) / 4).astype(np.float32), np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, UNITS) in reading direction ``d``."""
        u, p = UNITS, self.p
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        z_in = x @ p["x" + d] + p["c" + d]
        h = c = np.zeros((x.shape[1], u), np.float32)
        out = np.zeros((len(x), x.shape[1], u), np.float32)
        for t in steps:
            z = z_in[t] + h @ p["h" + d]
            i, f, o, g = _sigmoid(z[:, :u]), _sigmoid(z[:, u : 2 * u]), _sigmoid(z[:, 2 * u : 3 * u]), np.tanh(z[:, 3 * u :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, m))
            c = m * c2 + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[t] = h
        return out

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._pass(x, mask, "f"), self._pass(x, mask, "b")], 2)
        return _sigmoid(h @ self.p["o"] + self.p["oc"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        u, kept = UNITS, {"f": [], "b": []}
        h = np.concatenate([self._pass(x, mask, d, kept[d]) for d in "fb"], 2)
        chance = _sigmoid(h @ self.p["o"] + self.p["oc"])
        n = mask.sum()
        loss = -float((mask * (y * np.log(chance + 1e-9) + (1 - y) * np.log(1 - chance + 1e-9))).sum() / n)
        e = mask * (chance - y) / n
        grad = {"o": np.einsum("tb,tbu->u", e, h), "oc": np.array([e.sum()])}
        dh_out = e[:, :, None] * self.p["o"]
        for k, d in enumerate("fb"):
            dz_all = np.zeros((len(x), x.shape[1], 4 * u), np.float32)
            gh = np.zeros((u, 4 * u), np.float32)
            dh = dc = np.zeros((x.shape[1], u), np.float32)
            for t, h0, c0, i, f, o, g, th, m in reversed(kept[d]):
                dh = dh + dh_out[t][:, k * u : (k + 1) * u]
                now, dcn = m * dh, m * dc
                do = now * th
                dct = dcn + now * o * (1 - th**2)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), do * o * (1 - o), dct * i * (1 - g**2)], 1)
                dz_all[t] = dz
                gh += h0.T @ dz
                dh = dz @ self.p["h" + d].T + (1 - m) * dh
                dc = dct * f + (1 - m) * dc
            grad["h" + d], grad["c" + d] = gh, dz_all.sum((0, 1))
            grad["x" + d] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        return loss, grad


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask = np.zeros((steps, len(xs), WIDTH), np.float32), np.zeros((steps, len(xs)), np.float32)
    for k, v in enumerate(xs):
        x[: len(v), k], mask[: len(v), k] = v, 1
    return x, mask


@cache
def trained(pages: int = 1200, epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 11) -> Labeller:
    """A labeller trained on ``pages`` made-up pages; the same for the same arguments."""
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        page, labels = made_page(rng)
        found = blocks(page)
        if len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float32)))
    net, step = Labeller(), 0
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for _ in range(epochs):
        rng.shuffle(data)
        for k in range(0, len(data), batch):
            part = data[k : k + batch]
            x, mask = _padded([v for v, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(part):
                y[: len(labels), j] = labels
            step += 1
            for name, g in net.gradients(x, mask, y)[1].items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                net.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(pages: list[str | None], net: Labeller, least: float = 0.5, together: int = 64, cells: int = 8192) -> list[str]:
    """Article text of each page; pages of like length are labelled together, padded to ``cells`` blocks at most."""
    cut = [blocks(p or "") for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if cut[k]), key=lambda k: len(cut[k]))
    while order:
        n = 1
        while n < min(together, len(order)) and (n + 1) * len(cut[order[n]]) <= cells:
            n += 1
        part, order = order[:n], order[n:]
        v = vectors([b for k in part for b in cut[k]])
        ends = np.cumsum([len(cut[k]) for k in part])
        chance = net.chances(*_padded(np.split(v, ends[:-1])))
        for j, k in enumerate(part):
            out[k] = "\n".join(b[0] for b, c in zip(cut[k], chance[: len(cut[k]), j], strict=True) if c >= least)
    return out


def extract(pages: DataFrame, net: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    net = net or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                b = batch.slice(s, 512)
                text = main_texts(b.column(2).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

"""Language identification by a byte convolutional network (operator 9).

Bytes are embedded; filters of several widths run over fixed-length windows; each filter's largest
activation in a window goes to a softmax over the languages. The network is trained in numpy (Adam,
gradients through the maxima only) on labelled windows, and applied to batches of all windows of whole
texts. A text's probabilities are the mean over its windows, by their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.textarrays import TextBatch, slices

WINDOW = 256
UNKNOWN = "und"
_ascii_letter = np.zeros(256, bool)
_ascii_letter[[*range(65, 91), *range(97, 123)]] = True
_letter = regex.compile(r"\p{L}")


@dataclass
class ByteConvNet:
    """widths: of the filters; embed (256, d); filters (max width * d, filters), zero beyond a filter's width; dense (filters, languages)."""

    languages: list[str]
    widths: tuple[int, ...]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], widths: tuple[int, ...] = (2, 3, 4), per_width: int = 16, d: int = 6, seed: int = 5) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        n, deep = per_width * len(widths), max(widths) * d
        filters = rng.normal(0, (2 / deep) ** 0.5, (deep, n))
        net = cls(languages, widths, rng.normal(0, 0.5, (256, d)), filters, np.zeros(n), rng.normal(0, (1 / n) ** 0.5, (n, len(languages))), np.zeros(len(languages)))
        for k in ("embed", "filters", "bias", "dense", "dense_bias"):
            setattr(net, k, getattr(net, k).astype(np.float32))
        net.filters *= net._mask()
        return net

    def _mask(self) -> np.ndarray:
        d = self.embed.shape[1]
        per = self.filters.shape[1] // len(self.widths)
        return np.concatenate([np.repeat((np.arange(self.filters.shape[0]) < w * d)[:, None], per, axis=1) for w in self.widths], axis=1).astype(np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, max width * d): each position with the bytes after it; zero bytes follow a window."""
        wide = max(self.widths)
        e = self.embed[np.pad(windows, ((0, 0), (0, wide - 1)))]
        return np.lib.stride_tricks.sliding_window_view(e.reshape(len(windows), -1), wide * self.embed.shape[1], axis=1)[:, :: self.embed.shape[1]]

    def probabilities(self, windows: np.ndarray, at_once: int = 64) -> np.ndarray:
        """Softmax of each window (rows of WINDOW bytes, padded by zero bytes)."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), at_once):
            part = windows[i : i + at_once]
            x = np.ascontiguousarray(self._columns(part)).reshape(-1, self.filters.shape[0])
            top = (x @ self.filters).reshape(len(part), part.shape[1], -1).max(axis=1)
            z = np.maximum(top + self.bias, 0) @ self.dense + self.dense_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + at_once] = z / z.sum(axis=1, keepdims=True)
        return out

    def train(self, windows: np.ndarray, target: np.ndarray, steps: int = 500, batch: int = 96, rate: float = 4e-3, seed: int = 11) -> ByteConvNet:
        """Minibatches with as many windows of each language, so a frequent language doesn't win by its share."""
        rng = np.random.default_rng(seed)
        per = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        names = ("embed", "filters", "bias", "dense", "dense_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        mask, d, wide = self._mask(), self.embed.shape[1], max(self.widths)
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(p, max(1, batch // len(per))) for p in per])
            w, y = windows[pick], target[pick]
            x = np.ascontiguousarray(self._columns(w))
            a = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(len(w), x.shape[1], -1)
            where = a.argmax(axis=1)  # (windows, filters)
            top = np.take_along_axis(a, where[:, None], 1)[:, 0] + self.bias
            h = np.maximum(top, 0)
            z = h @ self.dense + self.dense_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = p
            dz[np.arange(len(w)), y] -= 1
            dz /= len(w)
            dtop = (dz @ self.dense.T) * (top > 0)
            seen = x[np.arange(len(w))[:, None], where]  # (windows, filters, deep)
            g = {"dense": h.T @ dz, "dense_bias": dz.sum(axis=0), "bias": dtop.sum(axis=0)}
            g["filters"] = np.einsum("bf,bfk->kf", dtop, seen) * mask
            back = (dtop[:, :, None] * self.filters.T[None]).reshape(len(w), -1, wide, d)
            padded = np.pad(w, ((0, 0), (0, wide - 1)))
            hit = padded[np.arange(len(w))[:, None, None], where[:, :, None] + np.arange(wide)]
            g["embed"] = np.zeros_like(self.embed)
            np.add.at(g["embed"], hit.ravel(), back.reshape(-1, d))
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                value = getattr(self, k) - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                setattr(self, k, value.astype(np.float32))
        return self


def windows_of(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a batch's texts: (n, WINDOW) bytes padded by zeros, each one's text, and its bytes."""
    size = np.diff(batch.offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = batch.offsets[doc] + nth * WINDOW
    length = np.minimum(WINDOW, batch.offsets[doc + 1] - start)
    data = np.append(batch.data, np.zeros(WINDOW, np.uint8))
    out = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[start]
    short = np.flatnonzero(length < WINDOW)
    out[short] *= np.arange(WINDOW) < length[short, None]
    return out, doc, length


def has_letter(batch: TextBatch) -> np.ndarray:
    """Whether each text has a letter of any script."""
    out = batch.per_doc(np.flatnonzero(_ascii_letter[batch.data])) > 0
    for i in np.flatnonzero(~out & (np.diff(batch.offsets) > 0)):
        out[i] = bool(_letter.search(batch.bytes_of(i).decode("utf-8")))
    return out


def fit(docs: DataFrame, usable: Column, per_language: int = 1200, most_languages: int = 200, windows_per_text: int = 6, steps: int = 500) -> ByteConvNet | None:
    """A network from labelled rows of docs (text, lang, doc_id) for which ``usable`` holds.

    The sample is bounded: about ``per_language`` texts of each of the ``most_languages`` most
    frequent languages (of more languages none can be answered), chosen by a hash of doc_id and text over the whole input, and
    ``windows_per_text`` windows of each, evenly spaced. Equal rows count once; repeated and null doc_ids are rows like others;
    null and empty texts teach nothing. At most 1.5 times the wanted texts are taken, whatever the hashes. None: no labelled text.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    drawn = F.xxhash64("doc_id", "text")
    unit = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
    part = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["count"]))) for r in counts])
    most = math.ceil(1.5 * per_language * len(counts))
    rows = labelled.where(unit < part).select("lang", "text", drawn.alias("drawn")).dropDuplicates(["drawn"]).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                text = TextBatch.of(b.column("text"))
                windows, doc, _ = windows_of(text)
                count = np.bincount(doc, minlength=len(text))
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                stride = -(-count // windows_per_text)
                chosen = np.flatnonzero(nth % stride[doc] == 0)
                yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(doc[chosen])), pa.array([w.tobytes() for w in windows[chosen]], pa.binary())], ["lang", "window"])

    sample = rows.mapInArrow(cut, "lang string, window binary").limit(most * windows_per_text).toArrow()
    if not sample.num_rows:
        return None
    pairs = sorted(zip(sample.column("lang").to_pylist(), sample.column("window").to_pylist(), strict=True))  # in whatever order tasks end
    languages = sorted({x for x, _ in pairs})
    target = np.array([languages.index(x) for x, _ in pairs])
    windows = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, WINDOW)
    return ByteConvNet.fresh(languages).train(windows, target, steps)


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """The rows of docs with lang_pred (string) and score (double, 0 to 1).

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. Columns of docs
    with these names are replaced. Every row is judged alone, from its text only. No shuffle.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                text = TextBatch.of(b.column("text"))
                names, score = [UNKNOWN] * len(text), np.zeros(len(text))
                if net is not None and len(text.data):
                    windows, doc, length = windows_of(text)
                    p = net.probabilities(windows) * length[:, None]
                    upto = np.searchsorted(doc, np.arange(len(text) + 1))
                    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
                    mean = (total[upto[1:]] - total[upto[:-1]]) / np.maximum(np.diff(text.offsets), 1)[:, None]
                    best = mean.argmax(axis=1)
                    for i in np.flatnonzero(has_letter(text)).tolist():
                        names[i], score[i] = net.languages[best[i]], min(1.0, max(0.0, float(mean[i, best[i]])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))

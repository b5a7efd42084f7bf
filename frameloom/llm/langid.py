"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response in a window
is its feature, and a softmax over the languages reads the features. As a filter is linear in its bytes, its
response is a sum of table entries, one for each byte; for prediction the tables of two neighbouring bytes are
added up beforehand, so that a window of any text costs two look-ups a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.batches import IS_LETTER, LOWER, flat, slices

WIDTHS = (2, 3, 4)
UND = "und"


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # for each width, (width, 256, filters)
    bias: np.ndarray  # of the filters
    dense: np.ndarray  # (features, langs)
    shift: np.ndarray  # (langs,)
    window: int

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by the two bytes at a place, and by the two bytes after them."""
        if not hasattr(self, "_pairs"):
            f = self.tables[0].shape[2]
            now, then = np.zeros((2, 65536, 3 * f), np.float32)
            a, b = np.divmod(np.arange(65536), 256)
            for i, t in enumerate(self.tables):
                part = slice(i * f, (i + 1) * f)
                now[:, part] = t[0][a] + t[1][b] + self.bias[part]
                if len(t) > 2:
                    then[:, part] += t[2][a]
                if len(t) > 3:
                    then[:, part] += t[3][b]
            self._pairs = now, then
        return self._pairs


def folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals of UTF-8 in lower case."""
    out = LOWER[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1
    capital = after[(buf[after] >= 0x80) & (buf[after] < 0x9F) & (buf[after] != 0x97)]
    out[capital] += 32
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    windows: np.ndarray, y: np.ndarray, langs: list[str], *,
    filters: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 1, steps: tuple[int, int] = (300, 6000),
) -> Model:
    """Fit by Adam. ``windows`` (n, window + 3) of folded bytes: a filter may look 3 bytes past its window.

    ``epochs`` passes, more of them where they come to fewer than ``steps[0]`` steps and fewer where to more than
    ``steps[1]``: a small sample is learnt too, and many languages keep the driver no longer than a few.
    The gradient of a maximum goes to the place that attained it, so a step touches one place for each filter.
    """
    rng = np.random.default_rng(seed)
    length = windows.shape[1] - 3
    tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
    params = [*tables, np.zeros(len(WIDTHS) * filters, np.float32), rng.normal(0, 0.3, (len(WIDTHS) * filters, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    wanted = min(max(epochs * -(-len(windows) // batch), steps[0]), steps[1])
    while step < wanted:
        order = rng.permutation(len(windows))
        for at in range(0, min(len(order), (wanted - step) * batch), batch):
            rows = order[at : at + batch]
            x = windows[rows].copy()
            for i in np.flatnonzero(rng.random(len(rows)) < 0.3):  # short texts too
                x[i, rng.integers(12, length) :] = 0
            n, peaks, best = len(rows), [], []
            for i, t in enumerate(params[:3]):
                r = sum(t[j][x[:, j : j + length]] for j in range(len(t)))
                peaks.append(r.argmax(axis=1))
                best.append(np.take_along_axis(r, peaks[-1][:, None, :], 1)[:, 0] + params[3][i * filters : (i + 1) * filters])
            h = np.concatenate(best, axis=1)
            live = np.maximum(h, 0)
            p = _softmax(live @ params[4] + params[5])
            p[np.arange(n), y[rows]] -= 1
            p /= n
            gh = (p @ params[4].T) * (h > 0)
            grads = [np.zeros_like(t) for t in params[:3]] + [gh.sum(0), live.T @ p + 1e-4 * params[4], p.sum(0)]
            for i, t in enumerate(params[:3]):
                own = gh[:, i * filters : (i + 1) * filters]
                which = np.broadcast_to(np.arange(filters), own.shape)
                for j in range(len(t)):
                    np.add.at(grads[i][j], (np.take_along_axis(x, peaks[i] + j, 1), which), own)
            step += 1
            for q, g, (m, v) in zip(params, grads, moment, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(langs, params[:3], params[3], params[4], params[5], length)


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text: the mean of the windows' softmax, weighted by the letters in them."""
    buf, offsets, _ = flat(column)
    sizes, n, w = np.diff(offsets), len(offsets) - 1, model.window
    ascii_letters = np.add.reduceat(np.append(IS_LETTER[buf], False).astype(np.int64), offsets[:-1]) if n else np.zeros(0, np.int64)
    ascii_letters[sizes == 0] = 0
    known = ascii_letters > 0
    for i in np.flatnonzero(~known & (sizes > 0)):
        known[i] = any(c.isalpha() for c in bytes(buf[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    padded = -(-(sizes + 3) // w) * w
    begin = np.concatenate([[0], np.cumsum(padded)])
    x = np.zeros(begin[-1] + 3, np.uint8)
    x[np.repeat(begin[:-1] - offsets[:-1], sizes) + np.arange(len(buf))] = folded(buf)
    pair = x[:-1].astype(np.uint16) << 8 | x[1:]
    now, then = model.pairs()
    score = np.zeros((n, len(model.langs)))
    weight = np.zeros(n)
    owner = np.repeat(np.arange(n), padded // w)
    for at in range(0, len(owner), 512):
        own = owner[at : at + 512]
        lo, hi = at * w, (at + len(own)) * w
        r = now[pair[lo:hi]]
        r += then[pair[lo + 2 : hi + 2]]
        h = np.maximum(r.reshape(len(own), w, -1).max(axis=1), 0)
        p = _softmax((h @ model.dense + model.shift).astype(np.float64))
        block = x[lo:hi].reshape(len(own), w)
        letters = (IS_LETTER[block] | (block >= 0x80)).sum(axis=1)
        np.add.at(score, own, p * letters[:, None])
        np.add.at(weight, own, letters)
    score /= np.maximum(weight, 1)[:, None]
    best = score.argmax(axis=1) if n else np.zeros(0, int)
    top = score[np.arange(n), best] if n else np.zeros(0)
    return [model.langs[b] if k else UND for b, k in zip(best, known, strict=True)], np.where(known, np.minimum(top, 1.0), 0.0)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 400, windows_per_row: int = 6, window: int = 256, max_langs: int = 500, seed: int = 1) -> Model | None:
    """Train on a bounded sample: about ``rows_per_lang`` texts of each language, ``windows_per_row`` windows of each.

    Texts are taken by their hash, at a share of the distinct hashes of their language, windows evenly from the whole
    text, and equal windows count once: a text with many copies adds no more than one of them and takes no other
    text's place. Rows without text or language
    teach nothing; without any labelled row there is no model (None). More than ``max_langs`` languages is an error.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    texts = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    counts = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return None
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, rows_per_lang / n))))
    picked = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def cut(batches):
        for b in batches:
            out_lang, out = [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = folded(np.frombuffer(text.encode(), np.uint8)) if text else np.zeros(0, np.uint8)
                k = max(1, min(windows_per_row, len(raw) // window))
                for at in np.linspace(0, max(0, len(raw) - window), k).astype(int):
                    piece = np.zeros(window + 3, np.uint8)
                    own = raw[at : at + window + 3]
                    piece[: len(own)] = own
                    out_lang.append(lang)
                    out.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out, pa.binary())], ["lang", "piece"])

    got = sorted((r.lang, bytes(r.piece)) for r in picked.mapInArrow(cut, "lang string, piece binary").distinct().collect())
    if not got:
        return None
    langs = sorted(counts)
    x = np.frombuffer(b"".join(p for _, p in got), np.uint8).reshape(len(got), window + 3)
    y = np.array([langs.index(lang) for lang, _ in got])
    return train(x, y, langs, seed=seed)


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", slice_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with the language and its score in ``lang_out`` and ``score_out`` (columns of such names are replaced).

    Null, empty and letterless texts, and every text if there is no model, get ``und`` with score 0. Rows are
    judged one by one, so equal texts get equal results; an empty table stays empty.
    """
    rows = docs.drop(lang_out, score_out)
    schema = rows.withColumns({lang_out: F.lit(""), score_out: F.lit(0.0)}).schema

    def apply(batches):
        for b in batches:
            for part in slices(b, text_col, slice_bytes):
                n = part.num_rows
                lang, score = predict(model, part.column(text_col)) if model else ([UND] * n, np.zeros(n))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, lang_out, score_out])

    return rows.mapInArrow(apply, schema)

"""Language identification by a small byte convolutional network, trained and applied in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over fixed-length windows
and classified by softmax. Windows cover the whole text; a document's distribution is the mean of its
windows', weighted by their bytes. As embedding and convolution are linear, a width-w filter is a sum
of w table entries, one for each byte, and entries of two neighbouring bytes are added up beforehand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, bound_batches, documents

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Training windows for each language at most, and documents that they may come from.
TRAIN_WINDOWS, TRAIN_DOCS = 1500, 1500
STEPS, BATCH, RATE = 350, 64, 0.01
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numerals of other scripts are not."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


class ByteConvNet:
    """classes: labels in order. weights: embedding (256, e), for each width w filters (w, e, f) and
    bias (f), and the output layer."""

    def __init__(self, classes: list[str], seed: int = 1):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"emb": r.normal(0, 0.3, (256, EMBED)), "out": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))), "out_b": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 2) -> ByteConvNet:
        """Adam on the cross-entropy of windows (n, WINDOW) of bytes."""
        r, p = np.random.default_rng(seed), self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v2 = {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, STEPS + 1):
            at = r.integers(0, len(windows), BATCH)
            g = self._gradient(windows[at], labels[at])
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v2[k] += 0.001 * (g[k] ** 2 - v2[k])
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        p, n = self.p, len(x)
        e = p["emb"][x]
        pooled, best = [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            z = sum(e[:, k : k + span] @ p[f"w{w}"][k] for k in range(w)) + p[f"b{w}"]
            at = z.argmax(1)
            best.append(at)
            pooled.append(np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0))
        h = np.concatenate(pooled, 1)
        s = h @ p["out"] + p["out_b"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[np.arange(n), y] -= 1
        s /= n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["out_b"] = h.T @ s, s.sum(0)
        dh = (s @ p["out"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = d.sum(0)
            for k in range(w):
                codes = x[rows, best[i] + k]
                g[f"w{w}"][k] = np.einsum("nfe,nf->ef", p["emb"][codes], d)
                np.add.at(g["emb"], codes, d[:, :, None] * p[f"w{w}"][k].T[None])
        return g

    def tables(self) -> list[tuple]:
        """For each width the tables that sum to its filters' outputs: (offset, bytes, table)."""
        p, out = self.p, []
        for w in WIDTHS:
            one = [(p["emb"] @ p[f"w{w}"][k]).astype(np.float32) for k in range(w)]
            one[0] = one[0] + p[f"b{w}"].astype(np.float32)
            parts = [(k, 2, (one[k][None, :] + one[k + 1][:, None]).reshape(65536, FILTERS)) for k in range(0, w - 1, 2)]
            out.append((w, parts + [(w - 1, 1, one[w - 1])] * (w % 2)))
        return out

    def predict(self, tables: list, windows: np.ndarray) -> np.ndarray:
        """Class probabilities of windows (n, WINDOW) of bytes."""
        pairs = windows[:, :-1].astype(np.int32) | (windows[:, 1:].astype(np.int32) << 8)
        pooled = []
        for w, parts in tables:
            span = WINDOW - w + 1
            z = None
            for k, size, table in parts:
                x = table.take(pairs[:, k : k + span] if size == 2 else windows[:, k : k + span], axis=0)
                z = x if z is None else np.add(z, x, out=z)
            while z.shape[1] > 1:  # maximum by halves
                half = z.shape[1] // 2
                z = np.concatenate([np.maximum(z[:, :half], z[:, half : 2 * half]), z[:, 2 * half :]], 1) if z.shape[1] % 2 else np.maximum(z[:, :half], z[:, half:])
            pooled.append(np.maximum(z[:, 0], 0))
        s = np.concatenate(pooled, 1) @ self.p["out"] + self.p["out_b"]
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """The bytes of a text in rows of WINDOW, the last one filled up by repeating the text's end."""
    n = max(1, -(-len(data) // WINDOW))
    need = n * WINDOW
    if len(data) < need:
        tail = data[-WINDOW:]
        fill = (tail + b"\n") * (WINDOW // (len(tail) + 1) + 1)
        data += b"\n" + fill[: need - len(data) - 1] if need - len(data) > 0 else b""
    return np.frombuffer(data, np.uint8).reshape(n, WINDOW)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = TRAIN_DOCS, windows_per_lang: int = TRAIN_WINDOWS) -> ByteConvNet | None:
    """A network for the values of lang, or None if there are none.

    Rows: non-null text with a letter and non-null lang, crc32(doc_id) mod 4 not 2. Of each lang at
    most docs_per_lang rows are used, those whose hashed id is least; of each one a window at a
    place that the hash gives. Only these windows reach the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.encode(text_col, "utf-8").alias("raw")
    )
    rows = rows.where((F.crc32(F.col("id").cast("binary")) % 4 != 2) & F.col("id").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * docs_per_lang / n))) for lang, n in counts.items()])
    order = F.xxhash64("id", F.lit("train"), "raw")
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.octet_length("raw") - WINDOW + 1, F.lit(1)))
    picked = rows.where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)
    sample = picked.select("lang", order.alias("order"), F.substring(F.col("raw"), (place + 1).cast("int"), F.lit(WINDOW)).alias("window")).collect()
    by: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["order"], r["window"])):
        found = by.setdefault(r["lang"], [])
        if len(found) < windows_per_lang and has_letter(bytes(r["window"]).decode(errors="ignore")):
            found.append(windows_of(bytes(r["window"]))[0])
    classes = sorted(k for k, v in by.items() if v)
    if not classes:
        return None
    x = np.concatenate([np.array(by[c]) for c in classes])
    return ByteConvNet(classes).fit(x, np.repeat(np.arange(len(classes)), [len(by[c]) for c in classes]))


def identify(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row, lang_pred and score of every row; row holds its columns (those named in keep, or all), so that
    their names never clash with others.

    Only the text is an input. Null texts, texts without a letter, and all texts where there is no
    network are `und` with score 0. The windows of many texts go through the network together. Equal
    rows are judged each; an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    plain = docs.select(row.alias("row"), F.col(text_col).alias("text"))

    def predict(rows):
        tables = net.tables() if net else None
        for batch in rows:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
            held, size = [], 0
            for i in [*known, None]:
                if i is not None:
                    held.append((i, raw := texts[i].encode(), windows_of(raw)))
                    size += len(held[-1][2])
                if held and (size >= 128 or i is None):
                    all_windows = np.concatenate([w for _, _, w in held])
                    probs = np.concatenate([net.predict(tables, all_windows[a : a + 128]) for a in range(0, size, 128)])
                    at = 0
                    for j, raw, w in held:
                        weights = np.full(len(w), float(WINDOW))
                        weights[-1] = len(raw) - WINDOW * (len(w) - 1)
                        mean = weights @ probs[at : at + len(w)] / weights.sum()
                        at += len(w)
                        best = int(mean.argmax())
                        langs[j], scores[j] = net.classes[best], float(min(1.0, mean[best]))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return plain.mapInArrow(predict, T.StructType([plain.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; those whose crc32(doc_id) mod 4 is 2 are held out."""
    docs = documents(spark, sf_dir)
    found = identify(docs, train(docs), keep=["doc_id"])
    doc_id = F.col("row.doc_id")
    held = F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
    return found.select(doc_id.cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")

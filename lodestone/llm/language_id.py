"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word (a run without ASCII white space, in
lower case; longer runs in pieces of UNIT bytes) forwards and backwards from a
zero state and gives each position a distribution over the languages. A
document's distribution is the mean over the positions of all its letters, so
each distinct word is run once for a batch of texts. Training is
backpropagation through time in numpy with Adam.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import small_batches

UNIT = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 bytes in lower case."""
    low = raw + 32 * ((raw >= 65) & (raw <= 90)).astype(np.uint8)
    if len(raw) > 1:
        low[1:] += (32 * ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))).astype(np.uint8)
    return low


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, long ones in pieces of whole characters of at most UNIT bytes, and their number before each row."""
    s, e, at = K.spans(~K.SPACE[raw], offsets)
    step = UNIT - 3
    n = np.where(e - s <= UNIT, 1, (e - s + step - 1) // step)
    if len(n) and n.max() > 1:
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        word = np.repeat(np.arange(len(n)), n)
        begin = s[word] + within * step
        for _ in range(3):  # back to where the character begins
            begin -= (within > 0) & (raw[begin] & 0xC0 == 0x80)
        end = np.append(begin[1:], 0)
        last = within == n[word] - 1
        end[last] = e
        s, e, at = begin, end, np.concatenate([[0], np.cumsum(n)])[at]
    return s, e, at


def padded(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans as rows, 0 after their ends, and the lengths."""
    n = e - s
    at = s[:, None] + np.arange(n.max())[None, :]
    return np.where(np.arange(n.max())[None, :] < n[:, None], raw[np.minimum(at, len(raw) - 1)], 0), n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters in self.p: for each direction d, embedded input weights Wd (256, 3H), recurrent Ud (H, 3H), biases bd and cd; output V (2H, L), o (L)."""

    def __init__(self, languages: list[str], hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        f = np.float32
        self.p = {"V": rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(f), "o": np.zeros(len(languages), f)}
        for d in "fb":
            self.p |= {f"W{d}": rng.normal(0, 0.5, (256, 3 * hidden)).astype(f), f"U{d}": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f), f"b{d}": np.zeros(3 * hidden, f), f"c{d}": np.zeros(hidden, f)}

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (T, B, H) of one direction; rows wait while their mask is 0."""
        h_, p = self.h, self.p
        table, u, c = p[f"W{d}"] + p[f"b{d}"], p[f"U{d}"], p[f"c{d}"]
        t_, b_ = x.shape[1], x.shape[0]
        h, out = np.zeros((b_, h_), np.float32), np.empty((t_, b_, h_), np.float32)
        for t in range(t_) if d == "f" else reversed(range(t_)):
            a, r = table[x[:, t]], h @ u
            zr = _sigmoid(a[:, : 2 * h_] + r[:, : 2 * h_])
            z, g = zr[:, :h_], zr[:, h_:]
            rn = r[:, 2 * h_ :] + c
            n = np.tanh(a[:, 2 * h_ :] + g * rn)
            m = mask[:, t : t + 1]
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, g, rn, n, m))
            h = out[t] = new
        return out

    def probabilities(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(B, T, L) for padded rows x of n bytes."""
        mask = (np.arange(x.shape[1])[None, :] < n[:, None]).astype(np.float32)
        both = np.concatenate([self._pass("f", x, mask, None), self._pass("b", x, mask, None)], axis=2)
        y = both @ self.p["V"] + self.p["o"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return (y / y.sum(axis=2, keepdims=True)).transpose(1, 0, 2)

    def step(self, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        h_, p = self.h, self.p
        mask = (np.arange(x.shape[1])[None, :] < n[:, None]).astype(np.float32)
        kept = {"f": [], "b": []}
        both = np.concatenate([self._pass(d, x, mask, kept[d]) for d in "fb"], axis=2)
        y = both @ p["V"] + p["o"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        rows = np.arange(len(x))
        loss = -(np.log(y[:, rows, label] + 1e-9) * mask.T).sum() / mask.sum()
        dy = y
        dy[:, rows, label] -= 1
        dy *= mask.T[:, :, None] / mask.sum()
        g = {"V": np.tensordot(both, dy, ([0, 1], [0, 1])), "o": dy.sum((0, 1))}
        dboth = dy @ p["V"].T
        for k, d in enumerate("fb"):
            t_ = x.shape[1]
            das, drs, hs = (np.empty((t_, len(x), w), np.float32) for w in (3 * h_, 3 * h_, h_))
            dh, u = np.zeros((len(x), h_), np.float32), p[f"U{d}"]
            for t, h, z, r, rn, nn, m in reversed(kept[d]):
                dh = dh + dboth[t, :, k * h_ : (k + 1) * h_]
                dnew = dh * m
                dn = dnew * (1 - z) * (1 - nn * nn)
                dz = dnew * (h - nn) * z * (1 - z)
                drn = dn * r
                dr = dn * rn * r * (1 - r)
                das[t], drs[t], hs[t] = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, drn], 1), h
                dh = dh * (1 - m) + dnew * z + drs[t] @ u.T
            da, dr_all = das.reshape(-1, 3 * h_), drs.reshape(-1, 3 * h_)
            gu, gb, gc = hs.reshape(-1, h_).T @ dr_all, da.sum(0), dr_all[:, 2 * h_ :].sum(0)
            # One sum for each byte that occurs.
            order = np.argsort(x.T.ravel(), kind="stable")
            own = x.T.ravel()[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            gw = np.zeros_like(p[f"W{d}"])
            gw[own[first]] = np.add.reduceat(da[order], first, axis=0)
            g |= {f"W{d}": gw, f"U{d}": gu, f"b{d}": gb, f"c{d}": gc}
        return float(loss), g

    def fit(self, x: np.ndarray, n: np.ndarray, label: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 5) -> "Network":
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        by = [np.flatnonzero(label == c) for c in range(len(self.languages))]
        for s in range(1, steps + 1):
            i = np.concatenate([rng.choice(b, batch // len(by) + 1) for b in by if len(b)])
            width = max(1, int(n[i].max()))
            _, g = self.step(x[i, :width], n[i], label[i])
            lr = rate * (1 - s / (steps + 1))
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                self.p[k] -= (lr * (m1[k] / (1 - 0.9**s)) / (np.sqrt(m2[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        return self


class Labeller:
    """Document probabilities, with the sums of each distinct word kept in a bounded table."""

    def __init__(self, net: Network, most: int = 500_000):
        self.net, self.most, self.keys = net, most, np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(net.languages) + 1), np.float32)

    def _words(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """For each span, the sum of its letters' probabilities and the number of its letters."""
        out = np.empty((len(s), self.values.shape[1]), np.float32)
        order = np.argsort(e - s, kind="stable")
        for lo in range(0, len(s), 2048):
            i = order[lo : lo + 2048]
            x, n = padded(raw, s[i], e[i])
            letter = (_LETTER[x] & (x > 0)).astype(np.float32)
            out[i, :-1] = (self.net.probabilities(x, n) * letter[:, :, None]).sum(1)
            out[i, -1] = letter.sum(1)
        return out

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, languages) mean probabilities, and the number of letter bytes."""
        raw = lowered(raw)
        s, e, at = units(raw, offsets)
        keys, one, which = np.unique(K.SpanHash(K._BYTE[raw])(s, e), return_index=True, return_inverse=True)
        i = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = i < len(self.keys)
        known[inside] = self.keys[i[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) > self.most:
                self.keys, self.values, known[:] = self.keys[:0], self.values[:0], False
            new = np.flatnonzero(~known)
            k = np.searchsorted(self.keys, keys[new])
            self.keys, self.values = np.insert(self.keys, k, keys[new]), np.insert(self.values, k, self._words(raw, s[one[new]], e[one[new]]), axis=0)
        value = self.values[np.searchsorted(self.keys, keys)]
        sums = np.zeros((len(which) + 1, value.shape[1]))
        np.cumsum(value[which], axis=0, dtype=np.float64, out=sums[1:])
        doc = sums[at[1:]] - sums[at[:-1]]
        return doc[:, :-1] / np.maximum(doc[:, -1:], 1), doc[:, -1]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _labels(net: Network, label, text: pa.Array) -> tuple[list[str], np.ndarray]:
    pred, score = ["und"] * len(text), np.zeros(len(text))
    for row, raw, offsets in K.chunks(text) if label else ():
        ascii_ = np.concatenate([[0], np.cumsum(_LETTER[raw] & (raw < 128))])
        p, n = label(raw, offsets)
        for i in range(len(p)):
            if n[i] and (ascii_[offsets[i + 1]] > ascii_[offsets[i]] or has_letter(text[row + i].as_py())):
                k = int(p[i].argmax())
                pred[row + i], score[row + i] = net.languages[k], min(1.0, float(p[i, k]))
    return pred, score


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        label = Labeller(net) if net.languages else None
        for batch in batches:
            pred, score = _labels(net, label, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def _recognised(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        label = Labeller(net) if net.languages else None
        for batch in batches:
            pred, _ = _labels(net, label, batch.column(at))
            yield batch.filter(pa.array([x != "und" for x in pred], pa.bool_()))

    return run


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _examples(words_per_document: int):
    """(lang, x, n): of each document at most so many words with letters, spread evenly, padded to UNIT bytes, and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in K.chunks(batch.column(1), 1):
                raw = lowered(raw)
                s, e, _ = units(raw, offsets)
                letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
                keep = np.flatnonzero(letters[e] > letters[s])
                if not len(keep):
                    continue
                keep = keep[np.linspace(0, len(keep) - 1, min(len(keep), words_per_document)).astype(int)]
                x, n = padded(raw, s[keep], e[keep])
                x = np.pad(x, ((0, 0), (0, UNIT - x.shape[1]))).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([x.tobytes()], pa.binary()), pa.array([n.astype(np.uint8).tobytes()], pa.binary())], ["lang", "x", "n"])

    return run


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 96, words_per_document: int = 400, steps: int = 900) -> Network:
    """A network fitted on a bounded sample of the documents that are not held out and have text and language.

    For each language at most docs_per_language documents, one from each slice
    of the id's hash; of each at most words_per_document of its words, spread
    evenly; of rows that share an id and a language, one chosen by its text's
    hash. Only these words, of at most UNIT bytes each, reach the driver.
    Without such documents the network knows no language.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    h = F.xxhash64("id")
    ids = d.groupBy("lang", F.pmod(h, F.lit(docs_per_language)).alias("slice")).agg(F.min_by("id", F.struct(h, "id")).alias("id")).select("lang", "id")
    one = d.join(F.broadcast(ids), ["lang", "id"], "left_semi").groupBy("lang", "id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = sorted((r.lang, bytes(r.x), bytes(r.n)) for r in one.select("lang", "text").mapInArrow(_examples(words_per_document), "lang string, x binary, n binary").collect())
    if not rows:
        return Network([])
    languages = sorted({r[0] for r in rows})
    at = {x: k for k, x in enumerate(languages)}
    n = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).astype(np.int64)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(n), UNIT)
    return Network(languages).fit(x, n, np.repeat([at[r[0]] for r in rows], [len(r[2]) for r in rows]), steps)


def identify(spark: SparkSession, docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row: the likeliest language over the whole text and its mean probability.

    ``und`` with score 0: a null text, one without a letter, or a network that
    knows no language. Ties go to the language that sorts first. Null ids and
    repeated rows keep their rows; other columns are not read.
    """
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_predict(spark.sparkContext.broadcast(net)), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def recognised(spark: SparkSession, docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of docs whose own text has a language other than ``und``, with all columns; ids play no part."""
    return small_batches(docs).mapInArrow(_recognised(spark.sparkContext.broadcast(net), docs.columns.index(text_col)), docs.schema)

"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of
labelled documents. It labels every byte position of the lower-cased text; a document's
probabilities are the means over its positions. Texts are cut into windows whose edges
overlap by CONTEXT bytes, so any text length is a batch of equal rows, in bounded
memory, while every position is read once with context on both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegap.llm.common import byte_groups, columns, plain, small_batches, trimmed

#: Bounds of the training sample: documents, shared evenly by languages; languages (the most
#: frequent ones); characters of a passage of each document (None: whole texts).
SAMPLE_DOCS, MAX_LANGS, SAMPLE_CHARS = 2400, 200, 400
HIDDEN, STEPS, BATCH, SPAN, RATE = 8, 220, 192, 48, 0.03
CORE, CONTEXT, ROWS = 240, 16, 1024
UND = "und"
_PAD = 256
_GROUP_BYTES = 1 << 20


class Direction:
    """One direction of the recurrence: h' = n + z (h - n), with gates
    clip(x / 4 + 1/2, 0, 1) and a softsign candidate n."""

    def __init__(self, weights: dict[str, np.ndarray], name: str):
        self.table, self.gates, self.cand = (weights[f"{name}_{k}"] for k in ("table", "gates", "cand"))

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, rows, hidden) of inputs x (time, rows)."""
        hidden = self.cand.shape[0]
        h = np.zeros((x.shape[1], hidden), np.float32)
        out = np.empty((*x.shape, hidden), np.float32)
        # the gates' scale and offset are folded into their weights; the parts z, r and n
        # are arrays of their own, as numpy is slow on narrow slices of rows
        parts = [np.ascontiguousarray(self.table[:, i * hidden : (i + 1) * hidden]) for i in range(3)]
        gates = [p * np.float32(0.25) + np.float32(0.5) for p in parts[:2]]
        weights = np.stack([self.gates[:, :hidden], self.gates[:, hidden:]]) * np.float32(0.25)
        g = np.empty((3, x.shape[1], hidden), np.float32)
        zr, n, low = np.empty_like(g[:2]), np.empty_like(h), np.empty_like(h)
        for t in range(len(x)):
            if keep is not None:
                zr, n = np.empty_like(zr), np.empty_like(n)
            at = x[t].astype(np.intp)
            for i, p in enumerate((*gates, parts[2])):
                p.take(at, axis=0, out=g[i], mode="clip")
            np.matmul(h, weights[0], out=zr[0])
            np.matmul(h, weights[1], out=zr[1])
            zr += g[:2]
            np.clip(zr, 0, 1, out=zr)
            np.multiply(zr[1], h, out=low)
            np.matmul(low, self.cand, out=n)
            n += g[2]
            np.abs(n, out=low)
            low += np.float32(1)
            n /= low
            if keep is not None:
                keep.append((h, zr, n))
            np.subtract(h, n, out=low)
            low *= zr[0]
            h = np.add(n, low, out=out[t])
        return out

    def backward(self, x: np.ndarray, keep: list, d_out: np.ndarray, grad: dict[str, np.ndarray], name: str) -> None:
        """Accumulate gradients through time."""
        hidden = self.cand.shape[0]
        d_h = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, zr, n = keep[t]
            z, r = zr
            d_h = d_h + d_out[t]
            d_n = d_h * (1 - z) * np.square(1 - np.abs(n))
            d_rh = d_n @ self.cand.T
            d_zr = np.concatenate([d_h * (h - n), d_rh * h], axis=1) * np.float32(0.25) * np.concatenate((zr > 0) & (zr < 1), axis=1)
            grad[f"{name}_cand"] += (r * h).T @ d_n
            grad[f"{name}_gates"] += h.T @ d_zr
            np.add.at(grad[f"{name}_table"], x[t], np.concatenate([d_zr, d_n], axis=1))
            d_h = d_h * z + d_rh * r + d_zr @ self.gates.T


class Network:
    """Both directions and the labels' softmax at every position."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, weights: dict | None = None):
        self.langs = langs
        if weights is None:
            rnd = np.random.RandomState(7)
            weights = {"out": rnd.normal(0, 0.3, (2 * hidden, len(langs))), "bias": np.zeros(len(langs))}
            for d in "fb":
                weights |= {
                    f"{d}_table": rnd.normal(0, 0.5, (257, 3 * hidden)),
                    f"{d}_gates": rnd.normal(0, 0.3, (hidden, 2 * hidden)),
                    f"{d}_cand": rnd.normal(0, 0.3, (hidden, hidden)),
                }
                # a pad byte keeps the state: its update gate is saturated
                weights[f"{d}_table"][_PAD] = [100.0] * hidden + [0.0] * 2 * hidden
        self.weights = {k: v.astype(np.float32) for k, v in weights.items()}

    def _states(self, x: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        f, b = (Direction(self.weights, d) for d in "fb")
        k = keep or (None, None)
        return f.forward(x, k[0]), b.forward(x[::-1], k[1])[::-1]

    def _softmax(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(langs, time, rows) of states."""
        hidden, out = f.shape[2], self.weights["out"].T
        p = out[:, :hidden] @ f.reshape(-1, hidden).T
        p += out[:, hidden:] @ b.reshape(-1, hidden).T
        p += self.weights["bias"][:, None]
        np.clip(p, -60, 60, out=p)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, *f.shape[:2])

    def probabilities(self, x: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """(langs, time, rows) at the times lo to hi of byte codes x (time, rows)."""
        f, b = self._states(x)
        return self._softmax(f[lo:hi], b[lo:hi])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy over all positions."""
        keep: tuple[list, list] = ([], [])
        f, b = self._states(x, keep)
        s, d = np.concatenate([f, b], axis=2), np.moveaxis(self._softmax(f, b), 0, 2).copy()
        d[:, np.arange(len(y)), y] -= 1
        d *= (x != _PAD)[:, :, None] / max((x != _PAD).sum(), 1)
        d = d.astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.weights.items()}
        grad["out"] = np.tensordot(s, d, ((0, 1), (0, 1)))
        grad["bias"] = d.sum(axis=(0, 1))
        d_s, hidden = d @ self.weights["out"].T, self.weights["f_cand"].shape[0]
        Direction(self.weights, "f").backward(x, keep[0], d_s[:, :, :hidden], grad, "f")
        Direction(self.weights, "b").backward(x[::-1], keep[1], d_s[::-1, :, hidden:], grad, "b")
        for side in "fb":
            grad[f"{side}_table"][_PAD] = 0
        return grad

    def fit(self, codes: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> Network:
        """Adam on random spans, the classes in equal parts."""
        rnd = np.random.RandomState(11)
        m, v = ({k: np.zeros_like(w) for k, w in self.weights.items()} for _ in range(2))
        of = [np.flatnonzero(labels == c) for c in range(len(self.langs))]
        for step in range(1, steps + 1):
            y = rnd.randint(0, len(self.langs), BATCH)
            x = np.full((SPAN, BATCH), _PAD, np.int64)
            for i, c in enumerate(y):
                code = codes[rnd.choice(of[c])]
                at = rnd.randint(0, max(len(code) - SPAN, 0) + 1)
                part = code[at : at + SPAN]
                x[: len(part), i] = part
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in self.gradient(x, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.weights[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best label and pooled probabilities (texts, langs) of non-empty byte strings."""
        lens = np.array([len(t) for t in texts])
        n_win = -(-lens // CORE)
        owner = np.repeat(np.arange(len(texts)), n_win)
        first = np.cumsum(n_win) - n_win
        begin = (np.arange(len(owner)) - first[owner]) * CORE
        # rows are cut from one array in which pads part the texts
        gap = 2 * CONTEXT + CORE
        base = np.cumsum(lens + gap) - lens
        flat = np.full(int(base[-1] + lens[-1] + gap), _PAD, np.uint16)
        for i, t in enumerate(texts):
            flat[base[i] : base[i] + len(t)] = np.frombuffer(t, np.uint8)
        length = np.minimum(lens[owner] - begin, CORE)
        total = np.zeros((len(texts), len(self.langs)))
        order = np.argsort(length, kind="stable")
        rows = np.lib.stride_tricks.sliding_window_view(flat, gap)
        for lo in range(0, len(order), ROWS):
            w = order[lo : lo + ROWS]
            core = int(length[w].max())
            x = np.ascontiguousarray(rows[base[owner[w]] + begin[w] - CONTEXT, : core + 2 * CONTEXT].T)
            p = self.probabilities(x, CONTEXT, CONTEXT + core)
            if length[w[0]] < core:
                p *= (np.arange(core)[:, None] < length[w][None, :]).astype(np.float32)
            np.add.at(total, owner[w], p.sum(axis=1).T)
        pooled = total / lens[:, None]
        return pooled.argmax(axis=1), pooled


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


_trained: dict[str, Network] = {}


def train(docs: DataFrame, sample: int = SAMPLE_DOCS, chars: int | None = SAMPLE_CHARS) -> Network | None:
    """Train on a bounded sample of labelled documents that are not held out.

    Each of at most MAX_LANGS languages gives an equal share of ``sample`` documents, one at
    least: those with the smallest hashes of their ids, a passage of ``chars`` characters at a
    hashed offset of each. None without labelled rows.
    """
    size = F.char_length("text")
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (size > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return None
    share = max(1, sample // len(counts))
    # only hashes below a language's bound can be among its smallest: few rows are ranked
    bounds = {lang: int(min(1.0, 2 * (share + 50) / n) * (2**64 - 2**12)) - 2**63 for lang, n in counts.items()}
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv]), F.col("lang"))
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(size - (chars or 0), F.lit(1))) + 1
    passage = F.substring(F.col("text"), at.cast("int"), F.lit(chars)) if chars else F.col("text")
    low = rows.where(F.col("lang").isin(list(counts))).select(F.xxhash64("doc_id").alias("h"), "lang", passage.alias("t"), bound.alias("b")).where("h <= b")
    first = Window.partitionBy("lang").orderBy("h", "t")
    data = sorted((r["lang"], r["h"], r["t"]) for r in low.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= share).select("lang", "h", "t").collect())
    key = hashlib.sha256(repr(data).encode()).hexdigest()
    if key not in _trained:
        langs = sorted({a for a, _, _ in data})
        codes = [np.frombuffer(t.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) for _, _, t in data]
        _trained.clear()
        _trained[key] = Network(langs).fit(codes, np.array([langs.index(a) for a, _, _ in data]))
    return _trained[key]


def identify(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",), results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with lang_pred and score for every row; ``results`` are their
    names, which must differ from those of ``keep``.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned.
    Only the text decides; other columns are carried or ignored. Equal texts get equal
    results; an empty table gives no rows. A very long text is labelled in windows, in some
    10 bytes of memory a byte (measured on 5 MB).
    """
    langs, weights = (network.langs, network.weights) if network else ([], {})
    names = list(dict.fromkeys(keep))
    carried = names if "text" in names else [*names, "text"]
    at = carried.index("text")  # the text goes to a worker once, even if it is kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(langs, weights=weights) if langs else None
        for batch in batches:
            for lo, hi in byte_groups(batch.column(at), _GROUP_BYTES):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *_answer(net, part.column(at))], [*names, *results])

    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[n] for n in names]).add(results[0], "string").add(results[1], "double")
    return plain(docs.select(*columns(carried))).mapInArrow(trimmed(run), schema)


def _answer(net: Network | None, column: pa.Array) -> tuple[pa.Array, pa.Array]:
    texts = [(t or "").lower() for t in column.to_pylist()]
    lang, score = [UND] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if net else []
    if rows:
        best, pooled = net.label([texts[i].encode("utf-8", "surrogatepass") for i in rows])
        for i, b, p in zip(rows, best, pooled, strict=True):
            lang[i], score[i] = net.langs[b], float(min(p[b], 1.0))
    return pa.array(lang, pa.string()), pa.array(score, pa.float64())

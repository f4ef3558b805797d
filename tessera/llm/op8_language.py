"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is a position. One layer of gated recurrent units reads forwards and one backwards, and a softmax over both states labels
every position with probabilities of the languages. A document's probabilities are the mean over all its positions.
Whole texts are read, in spans of SPAN bytes side by side; in either direction a span's units first run in over the RUN_IN bytes before it, so that
positions at its edges have a context like any other.
The network is trained in numpy by backpropagation through time with Adam, on the driver, on windows of WINDOW bytes
of at most PER_LANG documents of each language (SAMPLE of all, TRAIN_CHARS characters from anywhere in each); no language is too rare to be
learned. It has HIDDEN units in each direction, more where there are many languages.

Texts that are null or have no letter get `und` and score 0. Texts without positions don't exist
otherwise. Only rows with a non-null language and a text with letters are learned from; without any such row every text is
`und`. With one language everything with a letter gets it. Repeated rows get repeated results; an empty
table gives an empty result. Ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, slices, table

WINDOW = 64
SPAN = 256
RUN_IN = 32
#: Units: twice the languages, between these bounds.
HIDDEN = (8, 64)
#: Bound of the sample: so many documents of each language, of all languages together, and so many characters from anywhere in each document.
PER_LANG = 400
SAMPLE = 40_000
TRAIN_CHARS = 4096
#: Windows that one step of training or prediction takes.
TRAIN_BATCH = 384
BATCH = 1024
STEPS = 150
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


class Network:
    """w: for each direction input weights (3H x 256), recurrent weights (3H x H), recurrent bias of the candidate (H); then output weights (K x 2H) and bias (K)."""

    def __init__(self, classes: int, hidden: int | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        hidden = hidden or min(HIDDEN[1], max(HIDDEN[0], 2 * classes))
        self.h = hidden
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = [p for _ in range(2) for p in (make(3 * hidden, 256, scale=0.3), make(3 * hidden, hidden, scale=0.3), make(hidden, 1, scale=0.0))]
        self.w += [make(classes, 2 * hidden, scale=0.3), make(classes, 1, scale=0.0)]

    def states(self, x: np.ndarray, valid: np.ndarray | None, way: int, keep: bool) -> tuple[np.ndarray, list]:
        """x: positions by windows. The states at all positions; what backpropagation needs."""
        wx, u, b = self.w[3 * way : 3 * way + 3]
        n, rows = self.h, x.shape[1]
        out, tape = np.empty((len(x), n, rows), np.float32), []
        h = np.zeros((n, rows), np.float32)
        # Gates by tanh: sigmoid(a) = (1 + tanh(a / 2)) / 2; the halving goes into the weights.
        half = np.ones((3 * n, 1), np.float32)
        half[: 2 * n] = 0.5
        wx, u = wx * half, u * half
        for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
            a = wx.take(x[t], axis=1)
            m = u @ h
            g = a[: 2 * n]
            g += m[: 2 * n]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            inner = m[2 * n :]
            inner += b
            c = a[2 * n :]
            c += g[n:] * inner
            np.tanh(c, out=c)
            new = h - c
            new *= g[:n]
            new += c
            if valid is not None:
                new *= valid[t]
            if keep:
                tape.append((t, h, g, inner, c))
            out[t] = h = new
        return out, tape

    def labels(self, x: np.ndarray, valid: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Probabilities of each position: positions x classes x windows."""
        forward, tape0 = self.states(x, valid, 0, keep)
        back, tape1 = self.states(x, valid, 1, keep)
        v, c = self.w[6:]
        p = np.matmul(v[:, : self.h], forward)
        p += np.matmul(v[:, self.h :], back)
        p += c
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p, (forward, back, tape0, tape1)

    def gradients(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over positions; y: the class of each window."""
        p, (forward, back, *tapes) = self.labels(x, valid, keep=True)
        p[:, y, np.arange(x.shape[1])] -= 1
        p *= valid[:, None, :] / valid.sum()
        v, n, grads = self.w[6], self.h, []
        both = np.concatenate((forward, back), axis=1)
        out = [np.einsum("tkb,tjb->kj", p, both, optimize=True), p.sum(axis=(0, 2))[:, None]]
        for way, tape in enumerate(tapes):
            _, u, _ = self.w[3 * way : 3 * way + 3]
            into = np.matmul(v[:, way * n : way * n + n].T, p)
            gx, gu, gb = np.zeros((3 * n, 256), np.float32), np.zeros_like(u), np.zeros((n, 1), np.float32)
            dh = np.zeros((n, x.shape[1]), np.float32)
            steps = np.empty((len(x), 3 * n, x.shape[1]), p.dtype)
            for t, h, g, inner, c in reversed(tape):
                dh = (dh + into[t]) * valid[t]
                z, r = g[:n], g[n:]
                dc = dh * (1 - z) * (1 - c * c)
                da = np.concatenate((dh * (h - c) * z * (1 - z), dc * inner * r * (1 - r), dc))
                dm = np.concatenate((da[: 2 * n], dc * r))
                gu += dm @ h.T
                gb += dm[2 * n :].sum(axis=1, keepdims=True)
                steps[t] = da
                dh = dh * z + u.T @ dm
            # Input weights: sums over the positions of each byte.
            order = np.argsort(x.ravel(), kind="stable")
            found, at = np.unique(x.ravel()[order], return_index=True)
            gx[:, found] = np.add.reduceat(steps.transpose(1, 0, 2).reshape(3 * n, -1)[:, order], at, axis=1)
            grads += [gx, gu, gb]
        return grads + out


def windows(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of these lengths: the text, the offset in it and the length of each window."""
    per = -(-lengths // size)
    of = np.repeat(np.arange(len(lengths)), per)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * size
    return of, at, np.minimum(size, lengths[of] - at)


def positions(data: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The bytes of windows, positions by windows, and which of them are in their window (None: all)."""
    rows = np.arange(size)[:, None]
    valid = rows < length[None, :]
    x = data[np.minimum(start[None, :] + rows, len(data) - 1)]
    return x, None if valid.all() else valid.astype(np.float32)


def train(texts: list[str], langs: list[str]) -> tuple[list[str], Network]:
    """The learned languages in order and the network. Each language counts the same."""
    names = sorted(set(langs))
    net = Network(len(names))
    if len(names) < 2:
        return names, net
    raw = [t.encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    of, at, length = windows(lengths, WINDOW)
    start = (np.cumsum(lengths) - lengths)[of] + at
    kind = np.array([names.index(x) for x in langs])[of]
    rng, m1, m2 = np.random.default_rng(11), [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    rows = [np.nonzero(kind == k)[0] for k in range(len(names))]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(r, -(-TRAIN_BATCH // len(names))) for r in rows])
        x, valid = positions(data, start[pick], length[pick], WINDOW)
        grads = net.gradients(x, np.ones(x.shape, np.float32) if valid is None else valid, kind[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * min(1, 2 - 2 * step / STEPS + 0.05)
        for w, g, a, b in zip(net.w, grads, m1, m2, strict=True):
            g = g / max(1.0, norm)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return names, net


def predict(names: list[str], net: Network, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language and its mean probability over all positions, for each text."""
    strings = texts.to_pylist()
    known = [bool(names) and t is not None and LETTER.search(t) is not None for t in strings]
    raw = [t.encode("utf-8", "replace") if k else b"" for t, k in zip(strings, known, strict=True)]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    of, at, length = windows(lengths, SPAN)
    total = np.zeros((len(strings), max(1, len(names))))
    # What a span reads: the bytes before it and after it in its text, too.
    before = np.minimum(at, RUN_IN)
    read = before + length + np.minimum(RUN_IN, lengths[of] - at - length)
    start = (np.cumsum(lengths) - lengths)[of] + at - before
    # Spans of one shape stand together, so that few steps need a mask.
    order = np.lexsort((before, -read))
    batch = max(64, BATCH * 4 // max(4, len(names)))
    for k in range(0, len(order), batch) if len(names) > 1 else ():
        pick = order[k : k + batch]
        x, valid = positions(data, start[pick], read[pick], int(read[pick[0]]))
        p, _ = net.labels(x, valid)
        head, inner = before[pick], length[pick]
        if (head == head[0]).all() and (inner == inner[0]).all():
            own = p[head[0] : head[0] + inner[0]].sum(axis=0)
        else:
            rows = np.arange(len(x))[:, None]
            own = np.einsum("tkb,tb->kb", p, ((rows >= head) & (rows < head + inner)).astype(np.float32))
        np.add.at(total, of[pick], own.T)
    if len(names) == 1:
        total[:, 0] = lengths
    best = total.argmax(axis=1)
    lang = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)]
    score = [float(min(1.0, total[i, b] / lengths[i])) if known[i] else 0.0 for i, b in enumerate(best.tolist())]
    return lang, score


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], Network]:
    """The network from documents that are not held out. The sample is a hash of the id away from a uniform one."""
    own = docs.select(F.col(id).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("y"))
    own = own.where(~held_out(F.col("k")) & F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("y").isNotNull())
    counts = own.groupBy("y").count().collect()
    if not counts:
        return [], Network(1)
    # Every language is learned; where there are very many, each shows fewer documents.
    quota = max(1, min(PER_LANG, SAMPLE // len(counts)))
    # A hash below a language's own share of the range keeps about 1.3 x quota documents of it, and a few more.
    share = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["y"]), F.lit(min(1.0, (1.3 * quota + 20) / r["count"])))]), F.col("y"))
    dice = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The limit is each language's own, so that a rare one keeps all its documents; the part of a text is dealt by the hash of its id.
    nth = F.row_number().over(Window.partitionBy("y").orderBy("dice", "k"))
    start = F.pmod(F.xxhash64("k", "y"), F.greatest(F.lit(1), F.char_length("t") - TRAIN_CHARS + 1)).cast("int") + 1
    sample = own.withColumn("dice", dice).where(F.col("dice") <= share).select("k", "y", "dice", F.substring("t", start, F.lit(TRAIN_CHARS)).alias("t"))
    rows = sample.withColumn("nth", nth).where(F.col("nth") <= quota).orderBy("dice", "k").select("t", "y").collect()
    rows = [r for r in rows if LETTER.search(r["t"])]
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def identify(df: DataFrame, names: list[str], net: Network, text: str = "text") -> DataFrame:
    """df with lang_pred (string) and score (double)."""

    def step(texts: pa.Array) -> list[pa.Array]:
        lang, score = predict(names, net, texts)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return map_texts(df, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], step)


#: Stands for the language of all texts where none could be learned.
UNLEARNED = "any"


def drop_unidentified(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without rows whose text is null or has no letter, all columns as they are.

    Of the network's decisions none rejects a document: every text with a letter gets a language, whatever its score and
    whatever name the language has. Where no row has a language to learn from, texts with letters stay too.
    """
    names, net = learn(docs)
    # Nothing was learned: one name makes every text with a letter known.
    names = names or [UNLEARNED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                # What no language was found for scores 0; a learned language may itself be called und.
                _, score = predict(names, net, part.column(text))
                yield part.filter(pa.array([s > 0 for s in score], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, net = learn(docs)
    out = identify(docs.select("doc_id", "text"), names, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

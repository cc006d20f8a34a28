"""Language identification (operator 8): a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The bounded sample that the network is fitted on: documents of each language, windows of each of them, and the longest text in bytes.
SAMPLE_PER_LANGUAGE = 400
WINDOWS = 6
SAMPLE_BYTES = 200_000
HIDDEN = 8
TRAIN_LENGTH, BATCH, STEPS, RATE = 64, 128, 350, 0.02
#: Texts are read in windows of so many bytes, many at a time; together they cover every byte.
WINDOW, AT_ONCE = 128, 4096
UNKNOWN = "und"

_TABLE = bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or 97 <= c <= 122 else 32) for c in range(256))


def normal(text: bytes) -> bytes:
    """A-Z in lower case, runs of other ASCII characters than letters as one space."""
    return b" ".join(text.translate(_TABLE).split())


def has_letter(text: bytes) -> bool:
    if any(97 <= c <= 122 for c in text[:64].lower()):
        return True
    if text.lower().strip(bytes(c for c in range(128) if not 97 <= c <= 122)) == b"":
        return False
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """GRU cells in both directions: gates r, z and candidate n from a table of bytes and the state; softmax at each byte."""

    languages: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            p[f"U{d}"] = rng.normal(0, 0.3, (hidden, 3 * hidden))
        p["W"], p["c"] = rng.normal(0, 0.3, (2 * hidden, len(languages))), np.zeros(len(languages))
        return cls(languages, p)

    # -- training: backpropagation through time ----------------------------------------------------------------------

    def _forward(self, x: np.ndarray, d: str):
        """x: (batch, time) bytes. States (time, batch, hidden) and what the way back needs."""
        E, U = self.p[f"E{d}"], self.p[f"U{d}"]
        n = U.shape[0]
        h, states, kept = np.zeros((len(x), n)), [], []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            e = E[x[:, t]]
            rz = _sigmoid(e[:, : 2 * n] + h @ U[:, : 2 * n])
            r, z = rz[:, :n], rz[:, n:]
            m = h @ U[:, 2 * n :]
            c = np.tanh(e[:, 2 * n :] + r * m)
            new = (1 - z) * c + z * h
            kept.append((t, h, r, z, m, c))
            states.append(new)
            h = new
        return (states if d == "f" else states[::-1]), kept

    def _backward(self, x, d, kept, dstates, grads):
        U = self.p[f"U{d}"]
        n = U.shape[0]
        dh = np.zeros((len(x), n))
        for t, h, r, z, m, c in reversed(kept):
            dh = dh + dstates[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * m * r * (1 - r)
            drz = np.concatenate([dr, dz], 1)
            dm = dc * r
            back = dh * z + drz @ U[:, : 2 * n].T + dm @ U[:, 2 * n :].T
            grads[f"U{d}"] += h.T @ np.concatenate([drz, dm], 1)
            np.add.at(grads[f"E{d}"], x[:, t], np.concatenate([drz, dc], 1))
            dh = back

    def step(self, x: np.ndarray, y: np.ndarray):
        """Mean cross-entropy over all positions, and its gradients."""
        f, kf = self._forward(x, "f")
        b, kb = self._forward(x, "b")
        H = np.concatenate([np.stack(f), np.stack(b)], 2)  # time, batch, 2 hidden
        logits = H @ self.p["W"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(2, keepdims=True)
        loss = -np.log(q[:, np.arange(len(y)), y] + 1e-12).mean()
        q[:, np.arange(len(y)), y] -= 1
        q /= q.shape[0] * q.shape[1]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["W"], grads["c"] = np.einsum("tbh,tbk->hk", H, q), q.sum((0, 1))
        dH = q @ self.p["W"].T
        n = self.p["Uf"].shape[0]
        self._backward(x, "f", kf, dH[:, :, :n], grads)
        self._backward(x, "b", kb, dH[:, :, n:], grads)
        return loss, grads

    # -- inference -------------------------------------------------------------------------------------------------

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """x: (time, batch). States (time, hidden, batch) in single precision."""
        n = self.p[f"U{d}"].shape[0]
        E = np.ascontiguousarray(self.p[f"E{d}"].T, np.float32)  # 3 hidden, 256
        U = np.ascontiguousarray(self.p[f"U{d}"].T, np.float32)
        E[: 2 * n] *= 0.5  # sigmoid(a) = (tanh(a / 2) + 1) / 2
        U[: 2 * n] *= 0.5
        E = np.ascontiguousarray(E.T)
        time, batch = x.shape
        out = np.empty((time, n, batch), np.float32)
        h = np.zeros((n, batch), np.float32)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            a = U @ h
            e = E[x[t]].T
            rz = a[: 2 * n]
            rz += e[: 2 * n]
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            c = a[2 * n :]
            c *= rz[:n]
            c += e[2 * n :]
            np.tanh(c, out=c)
            h = h - c
            h *= rz[n:]
            h += c
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: (time, batch) bytes. A distribution over the languages at every position: (time, languages, batch)."""
        W = np.ascontiguousarray(self.p["W"].T, np.float32)
        n = self.p["Uf"].shape[0]
        q = W[:, :n] @ self._states(x, "f")
        q += W[:, n:] @ self._states(x, "b")
        q += self.p["c"].astype(np.float32)[:, None]
        q -= q.max(1, keepdims=True)
        np.exp(q, out=q)
        q /= q.sum(1, keepdims=True)
        return q

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean over all positions of each text, (texts, languages); zero for a text without a position."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        if not windows.sum() or not self.languages:
            return out
        whole = np.full((int(windows.sum()), WINDOW), 32, np.uint8)
        flat = whole.reshape(-1)
        at = (np.cumsum(windows) - windows) * WINDOW
        for t, a in zip(texts, at, strict=True):
            flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
        owner = np.repeat(np.arange(len(texts)), windows)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        length = np.minimum(WINDOW, sizes[owner] - number * WINDOW)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), AT_ONCE):
            rows = order[i : i + AT_ONCE]
            time = int(length[rows].max())
            q = self.probabilities(np.ascontiguousarray(whole[rows, :time].T))
            q *= (np.arange(time)[:, None] < length[rows])[:, None, :]
            np.add.at(out, owner[rows], q.sum(0).T)
        return out / np.maximum(sizes, 1)[:, None]


def fit(texts: list[bytes], labels: list[int], languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over windows of the texts, spread evenly over each, languages in equal parts."""
    net = Network.fresh(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    by: list[list[np.ndarray]] = [[] for _ in languages]
    for t, y in zip(texts, labels, strict=True):
        t = normal(t)
        last = max(0, len(t) - TRAIN_LENGTH)
        for start in sorted({round(last * k / max(1, WINDOWS - 1)) for k in range(WINDOWS)}):
            piece = np.frombuffer(t[start : start + TRAIN_LENGTH].ljust(TRAIN_LENGTH), np.uint8)
            if t:
                by[y].append(piece)
    open_ = [k for k, v in enumerate(by) if v]
    if not open_:
        return net
    stacks = {k: np.stack(by[k]) for k in open_}
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for i in range(1, steps + 1):
        y = np.array(open_)[rng.integers(0, len(open_), BATCH)]
        x = np.stack([stacks[k][rng.integers(0, len(stacks[k]))] for k in y])
        _, grads = net.step(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 1.5 * (1 - i / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-6)
    return net


def train(docs: DataFrame, usable=None, text: str = "text", lang: str = "lang", id_column: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Network:
    """Fitted on a bounded sample, the same in each run, of rows with a language for which the condition `usable` holds.

    Rows are counted by language over the whole table; in each language those with the smallest hashes of their id and
    text are drawn, so rows that share an id are drawn for themselves; equal rows share a place, and the first place of a
    language is always drawn from. Rows with a null id, text or language, or a text over SAMPLE_BYTES, don't take part.
    """
    own = docs if usable is None else docs.filter(usable)
    own = own.select(F.col(id_column).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).filter(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & F.col("_text").isNotNull() & (F.octet_length("_text") <= SAMPLE_BYTES))
    own = own.withColumn("_place", F.shiftrightunsigned(F.xxhash64("_id", "_text"), 1) / F.lit(float(2**63)))
    counts = own.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    drawn = own.join(F.broadcast(counts), "_lang").filter(F.col("_place") <= F.greatest(2.0 * per_language / F.col("n"), F.col("_first")))
    best = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy("_place", "_id", "_text"))).filter(F.col("_r") <= per_language)
    rows = best.orderBy("_lang", "_r").select("_lang", F.col("_text").cast("binary")).toArrow()
    languages = sorted(set(rows.column(0).to_pylist()))
    place_of = {x: i for i, x in enumerate(languages)}
    return fit(rows.column(1).to_pylist(), [place_of[x] for x in rows.column(0).to_pylist()], languages)


def language(docs: DataFrame, net: Network, predicted: str = "lang_pred", score: str = "score", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the predicted language and its pooled probability; whole texts, no shuffle.

    Null texts, and texts without a letter, are `und` with score 0. Ties go to the language that sorts first.
    """
    names = [*net.languages, UNKNOWN]

    def start():
        def work(texts):
            clean = [normal(t) for t in texts]
            q = net.pooled(clean)
            letters = [has_letter(t) for t in texts]
            best = q.argmax(1) if q.shape[1] else np.zeros(len(texts), int)
            return [[names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], [float(q[i, b]) if ok and q.shape[1] else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))]]

        return work

    return common.add_columns(docs, [(predicted, "string"), (score, "double")], start, text, keep)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = train(docs, common.fold("doc_id", 3) != 1)
    found = language(docs, net, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(common.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")

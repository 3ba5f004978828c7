"""Language identification.

Method: a bidirectional gated recurrent network over bytes, trained here in numpy by
backpropagation through time. It runs over all bytes of a text in both directions, its
states carried across words and lines, gives every position label probabilities, and a
document's are the mean over its positions. Texts of any length run side by side as
segments of SEGMENT bytes; either direction enters a segment WARM bytes early, as far as
training ever looked, so the states at its positions hardly differ from those carried
through the whole text, and results don't depend on what runs together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hmm import held_out

HIDDEN = 8
EMBED = 12
#: Distinct training texts of each language, at most, and the excerpts of each that are
#: learned: how many, and their characters.
DOCS_A_LABEL, EXCERPTS, EXCERPT = 600, 4, 64
STEPS, BATCH, RATE = 700, 128, 0.01
SEED = 5
#: Bytes of a segment, and those before and after it that the states are warmed up on.
SEGMENT, WARM = 1024, 64
#: Segments that run side by side at once, steps whose outputs are taken together, and
#: bytes of texts that are worked on together.
BESIDE, STRIDE, TOGETHER = 1000, 64, 1 << 24
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name; forward and backward over padded batches of bytes."""

    def __init__(self, labels: list[str], seed: int = SEED):
        self.labels = labels
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": normal(256, EMBED) * 16, "out": normal(2 * HIDDEN, len(labels))}
        self.p["bias"] = np.zeros(len(labels), dtype=np.float32)
        for side in "fb":
            self.p[f"{side}_in"] = normal(EMBED, 3 * HIDDEN)
            self.p[f"{side}_re"] = normal(HIDDEN, 3 * HIDDEN)
            self.p[f"{side}_b"] = np.zeros(3 * HIDDEN, dtype=np.float32)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states by time (time, batch, hidden) in the direction of x, and the tape."""
        w, b = self.p[f"{side}_re"], self.p[f"{side}_b"]
        given = x @ self.p[f"{side}_in"] + b
        h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        states, tape = np.empty((*x.shape[:2], HIDDEN), dtype=np.float32), []
        for t in range(len(x)):
            a = h @ w
            gates = _sigmoid(given[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(given[t, :, 2 * HIDDEN :] + reset * a[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            tape.append((h, a, update, reset, new, m))
            h = np.where(m, update * h + (1 - update) * new, h)
            states[t] = h
        return states, tape

    def forward(self, data: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Label probabilities by time and batch; data and mask are (time, batch)."""
        x = self.p["embed"][data]
        forth, tape_f = self._run("f", x, mask)
        back, tape_b = self._run("b", x[::-1], mask[::-1])
        both = np.concatenate([forth, back[::-1]], axis=2)
        logit = both @ self.p["out"] + self.p["bias"]
        e = np.exp(logit - logit.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), (x, both, tape_f, tape_b)

    def gradients(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over the positions inside the mask, and its gradients."""
        prob, (x, both, tape_f, tape_b) = self.forward(data, mask)
        n = mask.sum()
        rows = np.arange(data.shape[1])
        loss = -(np.log(prob[:, rows, label] + 1e-9) * mask).sum() / n
        d = prob.copy()
        d[:, rows, label] -= 1
        d *= (mask / n)[:, :, None].astype(np.float32)
        grads = {"out": np.einsum("tbh,tbl->hl", both, d), "bias": d.sum(axis=(0, 1))}
        dh = d @ self.p["out"].T
        dx = self._back("f", x, tape_f, dh[:, :, :HIDDEN], grads)
        dx = dx + self._back("b", x[::-1], tape_b, dh[::-1, :, HIDDEN:], grads)[::-1]
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], data.ravel(), dx.reshape(-1, EMBED))
        return float(loss), grads

    def _back(self, side: str, x: np.ndarray, tape: list, dstates: np.ndarray, grads: dict) -> np.ndarray:
        w = self.p[f"{side}_re"]
        dgiven = np.zeros((*x.shape[:2], 3 * HIDDEN), dtype=np.float32)
        dw, carry = np.zeros_like(w), np.zeros_like(dstates[0])
        for t in range(len(x) - 1, -1, -1):
            h, a, update, reset, new, m = tape[t]
            dh = carry + dstates[t]
            live = dh * m
            dnew = live * (1 - update) * (1 - new**2)
            dupdate = live * (h - new) * update * (1 - update)
            dreset = dnew * a[:, 2 * HIDDEN :] * reset * (1 - reset)
            da = np.concatenate([dupdate, dreset, dnew * reset], axis=1)
            dgiven[t] = np.concatenate([dupdate, dreset, dnew], axis=1)
            dw += h.T @ da
            carry = da @ w.T + live * update + dh * ~m
        grads[f"{side}_re"], grads[f"{side}_b"] = dw, dgiven.sum(axis=(0, 1))
        grads[f"{side}_in"] = np.einsum("tbe,tbh->eh", x, dgiven)
        return dgiven @ self.p[f"{side}_in"].T


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words with a space on either side, and which are inside, time first."""
    sizes = np.array([len(w) + 2 for w in words])
    data = np.zeros((int(sizes.max()), len(words)), dtype=np.uint8)
    for i, w in enumerate(words):
        data[: sizes[i], i] = np.frombuffer(b" " + w + b" ", dtype=np.uint8)
    return data, np.arange(len(data))[:, None] < sizes[None, :]


def train(excerpts: dict[str, list[bytes]], seed: int = SEED) -> Network:
    """Adam over batches of excerpts, as many of each language."""
    net = Network(sorted(excerpts), seed)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    each = max(1, BATCH // len(net.labels))
    for step in range(1, STEPS + 1):
        some, label = [], []
        for i, name in enumerate(net.labels):
            some += [excerpts[name][j] for j in rng.integers(0, len(excerpts[name]), size=each)]
            label += [i] * each
        _, grads = net.gradients(*padded(some), np.array(label))
        rate = RATE * min(1.0, 2 - 2 * step / (STEPS + 1))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


class Labeller:
    """Pools the position probabilities of whole texts."""

    def __init__(self, net: Network):
        self.labels, self.bias = len(net.labels), net.p["bias"]
        # States and gates are rows over the texts, so that each operation runs along memory.
        self.out = {"f": net.p["out"][:HIDDEN].T.copy(), "b": net.p["out"][HIDDEN:].T.copy()}
        # What a byte gives to the gates; these go through tanh, of which a sigmoid is a half.
        half = np.r_[np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)
        given = {s: (net.p["embed"] @ net.p[f"{s}_in"] + net.p[f"{s}_b"]) * half for s in "fb"}
        self.given = {s: np.ascontiguousarray(given[s].T.astype(np.float32)) for s in "fb"}
        self.again = {s: np.ascontiguousarray((net.p[f"{s}_re"] * half).T.astype(np.float32)) for s in "fb"}

    def _step(self, side: str, h: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The states h (HIDDEN x texts) one byte further."""
        g, a = self.given[side].take(data, axis=1), self.again[side] @ h
        gates, new, past = g[: 2 * HIDDEN], g[2 * HIDDEN :], a[2 * HIDDEN :]
        gates += a[: 2 * HIDDEN]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        past *= gates[HIDDEN:]  # the reset gate was not halved for it
        new += past
        np.tanh(new, out=new)
        h = h - new
        h *= gates[:HIDDEN]
        h += new
        return h

    def _side_by_side(self, data: np.ndarray, live: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Sums of the label probabilities over the positions inside each segment; data and
        inside are (time, segment), longest first, live how many have each step."""
        steps, width = data.shape
        states = np.zeros((steps, HIDDEN, width), dtype=np.float32)
        h = np.zeros((HIDDEN, 0), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            if live[t] > h.shape[1]:
                h = np.concatenate([h, np.zeros((HIDDEN, live[t] - h.shape[1]), dtype=np.float32)], axis=1)
            h = states[t, :, : live[t]] = self._step("b", h, data[t, : live[t]])
        total = np.zeros((width, self.labels))
        h = np.zeros((HIDDEN, width), dtype=np.float32)
        for t0 in range(0, steps, STRIDE):
            t1, n = min(t0 + STRIDE, steps), live[t0]
            ahead = np.zeros((t1 - t0, HIDDEN, n), dtype=np.float32)
            for t in range(t0, t1):
                h = ahead[t - t0, :, : live[t]] = self._step("f", h[:, : live[t]], data[t, : live[t]])
            logit = self.out["f"] @ ahead
            logit += self.out["b"] @ states[t0:t1, :, :n]
            logit += self.bias[:, None]
            logit -= logit.max(axis=1, keepdims=True)
            np.exp(logit, out=logit)
            logit *= (inside[t0:t1, :n] / logit.sum(axis=1))[:, None].astype(np.float32)
            total[:n] += logit.sum(axis=0).T
        return total

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over the positions of each text, none of them empty."""
        sizes = np.array([len(t) for t in texts])
        count = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(texts)), count)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        end = np.minimum(first + SEGMENT, sizes[text])
        low, high = np.maximum(first - WARM, 0), np.minimum(end + WARM, sizes[text])
        out = np.zeros((len(texts), self.labels))
        order = np.argsort(low - high, kind="stable")
        for at in range(0, len(order), BESIDE):
            some = order[at : at + BESIDE]
            lengths = (high - low)[some]
            time = np.arange(lengths[0])[:, None]
            data = np.zeros((lengths[0], len(some)), dtype=np.uint8)
            for column, i in enumerate(some):
                data[: lengths[column], column] = np.frombuffer(texts[text[i]], dtype=np.uint8)[low[i] : high[i]]
            live = np.searchsorted(-lengths, -time[:, 0] - 1, side="right")
            inside = (time >= (first - low)[some]) & (time < (end - low)[some])
            np.add.at(out, text[some], self._side_by_side(data, live, inside))
        return out / sizes[:, None]


LETTER = regex.compile(r"\p{L}")


def _predictor(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net) if net.labels else None
        for batch in (part for b in batches for part in _by_bytes(b)):
            texts = batch.column(2).to_pylist()
            plain = [i for i, t in enumerate(texts) if net.labels and t and LETTER.search(t)]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, prob in zip(plain, labeller.pool([texts[i].encode() for i in plain]) if plain else (), strict=True):
                names[i], scores[i] = net.labels[int(prob.argmax())], min(1.0, float(prob.max()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about TOGETHER bytes."""
    size = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, side="right")))
        yield batch.slice(at, end - at)
        at = end


def sampled(rows: DataFrame) -> dict[str, list[bytes]]:
    """Excerpts by language of the rows text, lang: of at most DOCS_A_LABEL distinct texts
    of each, those of the smallest hashes, EXCERPTS pieces at hashed places."""
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    order = Window.partitionBy("lang").orderBy("h")
    chosen = hashed.select("lang", "h").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCS_A_LABEL)
    place = lambda i: F.pmod(F.xxhash64("h", i), F.greatest(F.length("text") - EXCERPT, F.lit(1))).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(1), F.lit(EXCERPTS)), lambda i: F.substring("text", place(i), F.lit(EXCERPT)))
    once = hashed.join(chosen, ["lang", "h"]).select("lang", "h", pieces.alias("pieces")).groupBy("lang", "h").agg(F.min("pieces").alias("pieces"))
    found: dict[str, list[bytes]] = {}
    for r in once.orderBy("lang", "h").collect():  # DOCS_A_LABEL rows a language
        found.setdefault(r["lang"], []).extend(p.encode() for p in r["pieces"] if p)
    return {lang: some for lang, some in found.items() if some}


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Learns from text and lang of the rows that are not held out (those with a null doc_id
    are not) and have both. Null texts and texts without a letter are `und` with score 0,
    as are all where there is nothing to learn from. Repeated rows are repeated and learned
    once; a text of any length is read whole; an empty table gives no rows; further columns
    are ignored.
    """
    given = docs.select(
        "doc_id", held_out(modulus, remainder).alias("held_out"), F.col("text").cast("string").alias("text"), "lang"
    )
    excerpts = sampled(given.where("not held_out and lang is not null and text is not null").select("text", "lang"))
    net = train(excerpts) if excerpts else Network([])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return given.select("doc_id", "held_out", "text").mapInArrow(
        _predictor(net), f"doc_id {id_type}, held_out boolean, lang_pred string, score double"
    )

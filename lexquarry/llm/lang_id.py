"""Language identification with a bidirectional gated recurrent network over bytes.

Two GRUs read the bytes of a segment, one forwards and one backwards; a softmax
over both states labels every position with a language. The network is trained in
numpy by backpropagation through time. A document is cut into segments of SEGMENT
bytes that are read side by side as one batch, so every byte of every text is
labelled; its probabilities are the mean over its positions.

Training sees a bounded sample: at most DOCS_PER_LANG documents of each of at most
LANGS languages, and SEGMENTS_PER_DOC segments of TRAIN_BYTES bytes from each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import carried, held_out, map_arrow, utf8_buffer

HIDDEN = 8
SEGMENT = 128
DOCS_PER_LANG = 300
LANGS = 1000
SEGMENTS_PER_DOC = 4
TRAIN_BYTES = 64
STEPS, BATCH, RATE = 240, 192, 0.02
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """One GRU: tables of what each byte adds to the gates (z, r) and the candidate, and the recurrent weights."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.p = {"x": rng.normal(0, 0.3, (257, 3 * h)), "u": rng.normal(0, 0.3, (h, 2 * h)), "c": rng.normal(0, 0.3, (h, h))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, ids: np.ndarray, keep: bool = False):
        """States after each position; ids is (steps, batch), 256 pads."""
        h, (steps, n) = HIDDEN, ids.shape
        x, u, c = self.p["x"], self.p["u"], self.p["c"]
        state = np.zeros((n, h), np.float32)
        states = np.empty((steps, n, h), np.float32)
        trace = []
        for t in range(steps):
            add = x[ids[t]]
            gates = _sigmoid(add[:, : 2 * h] + state @ u)
            z, r = gates[:, :h], gates[:, h:]
            reset = r * state
            cand = np.tanh(add[:, 2 * h :] + reset @ c)
            if keep:
                trace.append((state, z, r, reset, cand))
            state = state + z * (cand - state)
            states[t] = state
        return states, trace

    def backward(self, ids: np.ndarray, trace: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN
        u, c = self.p["u"], self.p["c"]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = np.zeros_like(d_states[0])
        adds = np.empty((*ids.shape, 3 * h), np.float32)
        for t in range(len(ids) - 1, -1, -1):
            state, z, r, reset, cand = trace[t]
            d = d + d_states[t]
            d_cand = d * z * (1 - cand * cand)
            d_reset = d_cand @ c.T
            d_gates = np.concatenate([d * (cand - state) * z * (1 - z), d_reset * state * r * (1 - r)], 1)
            g["c"] += reset.T @ d_cand
            g["u"] += state.T @ d_gates
            adds[t, :, : 2 * h], adds[t, :, 2 * h :] = d_gates, d_cand
            d = d * (1 - z) + d_reset * r + d_gates @ u.T
        np.add.at(g["x"], ids.reshape(-1), adds.reshape(-1, 3 * h))
        return g


class Network:
    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.out = {"w": rng.normal(0, 0.3, (2 * HIDDEN, len(langs))).astype(np.float32), "b": np.zeros(len(langs), np.float32)}

    def states(self, ids: np.ndarray, keep: bool = False):
        a, trace_a = self.ahead.forward(ids, keep)
        b, trace_b = self.back.forward(ids[::-1], keep)
        return a, b[::-1], trace_a, trace_b

    def probabilities(self, ids: np.ndarray, keep: bool = False):
        """(steps, batch, languages): the label of every position."""
        a, b, trace_a, trace_b = self.states(ids, keep)
        logits = a.reshape(-1, HIDDEN) @ self.out["w"][:HIDDEN]
        logits += b.reshape(-1, HIDDEN) @ self.out["w"][HIDDEN:]
        logits += self.out["b"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits.reshape(*ids.shape, -1), (a, b, trace_a, trace_b)

    def train(self, segments: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """segments: (n, bytes) of byte ids, 256 pads; Adam on the mean cross-entropy of all positions."""
        rng = np.random.default_rng(seed)
        parts = (self.ahead.p, self.back.p, self.out)
        moments = [({k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}) for p in parts]
        counts = np.bincount(labels, minlength=len(self.langs))
        weight = 1.0 / np.maximum(counts, 1)[labels]
        weight /= weight.sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(segments), min(BATCH, len(segments)), p=weight)  # languages count alike
            ids = np.ascontiguousarray(segments[pick].T)
            probs, (a, b, trace_a, trace_b) = self.probabilities(ids, True)
            real = ids < 256
            d = probs
            d[:, np.arange(len(pick)), labels[pick]] -= 1
            d *= (real / max(1, real.sum()))[:, :, None].astype(np.float32)
            flat = d.reshape(-1, d.shape[-1])
            states = np.concatenate([a, b], 2).reshape(-1, 2 * HIDDEN)
            g_out = {"w": states.T @ flat, "b": flat.sum(0)}
            d_states = (flat @ self.out["w"].T).reshape(*ids.shape, -1)
            g_ahead = self.ahead.backward(ids, trace_a, d_states[:, :, :HIDDEN])
            g_back = self.back.backward(ids[::-1], trace_b, d_states[::-1, :, HIDDEN:])
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, (m, v) in zip(parts, (g_ahead, g_back, g_out), moments):
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k in p:
                    x = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.001 * (x * x - v[k])
                    p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def documents(self, data: np.ndarray, ptr: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Pooled probabilities (documents, languages) of texts in one buffer; each byte counts once."""
        lengths = np.diff(ptr)
        pieces = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = ptr[:-1][doc] + nth * SEGMENT
        length = np.minimum(SEGMENT, ptr[1:][doc] - start)
        total = np.zeros((len(lengths), len(self.langs)))
        order = np.argsort(-length, kind="stable")
        padded = np.append(data, np.zeros(SEGMENT, np.uint8))
        for i in range(0, len(order), rows):
            own = order[i : i + rows]
            steps = int(length[own].max())
            at = np.arange(steps)[:, None]
            ids = padded[start[own] + at].astype(np.int16)
            real = at < length[own]
            ids[~real] = 256
            probs, _ = self.probabilities(ids)
            probs *= real[:, :, None]
            np.add.at(total, doc[own], probs.sum(0))
        return total / np.maximum(lengths, 1)[:, None]


def training_segments(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The bounded sample: languages, segments and labels.

    A row is drawn by the hash of its id and text, against twice the share that
    its language needs; of these few rows the first by hash are taken. So texts
    are cut where they are read and never shuffled. Rows that repeat id and text
    count once. The LANGS most frequent languages are learned.
    """
    spark = df.sparkSession
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    rates = spark.createDataFrame([(r["lang"], min(1.0, 2 * DOCS_PER_LANG / r["n"])) for r in counts], "lang string, rate double")
    drawn = known.join(F.broadcast(rates), "lang").where(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.col("rate"))

    def cut(batches):
        for batch in batches:
            data, ptr = utf8_buffer(batch.column(2))
            langs, hashes, places, parts = [], [], [], []
            for lang, h, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ptr.tolist(), ptr[1:].tolist()):
                for i, s in enumerate(np.unique(np.linspace(a, max(a, b - TRAIN_BYTES), SEGMENTS_PER_DOC).astype(int))):
                    if b > s:
                        langs.append(lang)
                        hashes.append(h)
                        places.append(i)
                        parts.append(data[s : min(b, s + TRAIN_BYTES)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(parts, pa.binary())], ["lang", "h", "place", "part"])

    cuts = map_arrow(drawn.select("lang", "h", "text"), cut, "lang string, h long, place int, part binary").dropDuplicates(["lang", "h", "place"])
    order = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))  # some hundred rows a language
    rows = cuts.withColumn("k", order).where(F.col("k") <= DOCS_PER_LANG).select("lang", "h", "place", "part").collect()
    rows = sorted((r["lang"], r["h"], r["place"], bytes(r["part"])) for r in rows)
    langs = sorted({r[0] for r in rows})
    segments = np.full((len(rows), TRAIN_BYTES), 256, np.int16)
    for i, (*_, part) in enumerate(rows):
        segments[i, : len(part)] = np.frombuffer(part, np.uint8)
    return langs, segments, np.array([langs.index(r[0]) for r in rows], int)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on the bounded sample; None if no row has text and language to learn from."""
    langs, segments, labels = training_segments(df, id_col, text_col, lang_col)
    if not langs:
        return None
    network = Network(langs)
    network.train(segments, labels)
    return network


def predict(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, lang_pred, score)`` and the columns to carry along: the language with the largest pooled probability, and that probability.

    A null text, a text without a letter, and every text where nothing was
    learned, is ``und`` with score 0. Ties go to the first language by name.
    Repeated rows give repeated results, an empty table none; other columns than
    those named are not read. Texts are read whole, in pieces; a piece shorter than
    others it is computed with is padded, which can move its probabilities slightly.
    """

    def run(batches):
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = np.array([network is not None and t is not None and letter.search(t) is not None for t in texts], bool)
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if known.any():
                pooled = network.documents(*utf8_buffer(batch.column(1)))
                best = pooled.argmax(1)
                langs = [network.langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
                scores = np.where(known, np.clip(pooled[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(langs, pa.string()), pa.array(scores), *batch.columns[2:]], ["id", "text", "lang_pred", "score", *extra_names])

    kind = df.schema[id_col].dataType.simpleString()
    extra = carried(df, carry)
    extra_names = extra.names
    out = map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *extra.columns), run, f"id {kind}, text string, lang_pred string, score double" + extra.schema)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "lang_pred", "score", *extra.back)

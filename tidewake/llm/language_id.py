"""Language identification by a bidirectional gated recurrent network over bytes.

The project keeps no free text, so the operators are general: records are any table with a text column.

The network reads UTF-8 bytes in both directions, gives every position a distribution over the languages, and a document
gets the mean of its positions. It is written in numpy and trained by backpropagation through time. Texts are cut into
sequences of SEQUENCE bytes that run side by side as lanes, so memory is bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .columns import put_columns

UNKNOWN = "und"
SEQUENCE = 128
LANES = 1024
PAD = 256
MAX_LABELS = 1000
#: Bounds of the training sample: texts of each language, and characters of each text.
SAMPLE_TEXTS = 300
#: Parts in which the texts of a language are ranked before they are ranked together.
SAMPLE_PARTS = 64
SAMPLE_CHARS = 4000


@dataclass
class Network:
    """Weights. Direction is the first axis: 0 reads forwards, 1 backwards. Gates are keep, reset, candidate."""

    labels: list[str]
    byte: np.ndarray        # 2, 257, 3H
    state: np.ndarray       # 2, H, 3H
    out: np.ndarray         # 2, H, K
    bias: np.ndarray        # K

    def arrays(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.out, self.bias]


def fresh(labels: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    byte = normal(2, PAD + 1, 3 * hidden, scale=0.3)
    byte[:, :, :hidden] += 1
    return Network(labels, byte, normal(2, hidden, 3 * hidden, scale=hidden ** -0.5),
                   normal(2, hidden, len(labels), scale=hidden ** -0.5), np.zeros(len(labels), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; exponents are cut where the result no longer changes."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(net: Network, h: np.ndarray, bytes_now: np.ndarray):
    """Next state of all lanes in both directions, and what backpropagation needs."""
    n = h.shape[2]
    given = np.stack([net.byte[0].take(bytes_now[0], axis=0), net.byte[1].take(bytes_now[1], axis=0)])
    past = h @ net.state
    gates = _sigmoid(given[:, :, :2 * n] + past[:, :, :2 * n])
    keep, reset, memory = gates[:, :, :n], gates[:, :, n:], past[:, :, 2 * n:]
    candidate = _sigmoid(2 * (given[:, :, 2 * n:] + reset * memory))
    candidate *= 2
    candidate -= 1
    return candidate + keep * (h - candidate), (h, keep, reset, memory, candidate)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def positions(net: Network, lanes: np.ndarray) -> np.ndarray:
    """Distribution at each position. lanes: steps x lanes of byte values, PAD after an end."""
    steps, width = lanes.shape
    scores = np.tile(net.bias, (steps, width, 1))
    h = np.zeros((2, width, net.state.shape[1]), np.float32)
    for t in range(steps):
        h, _ = _step(net, h, (lanes[t], lanes[steps - 1 - t]))
        said = h @ net.out
        scores[t] += said[0]
        scores[steps - 1 - t] += said[1]
    return _softmax(scores)


def gradients(net: Network, lanes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all real positions and the gradients of all weights, by backpropagation through time."""
    steps, width = lanes.shape
    n = net.state.shape[1]
    h = np.zeros((2, width, n), np.float32)
    kept, states = [], []
    for t in range(steps):
        h, saved = _step(net, h, (lanes[t], lanes[steps - 1 - t]))
        kept.append(saved)
        states.append(h)
    states = np.stack(states, axis=1)                                   # 2, steps, lanes, H
    scores = states[0] @ net.out[0] + states[1][::-1] @ net.out[1] + net.bias
    chance = _softmax(scores)
    real = lanes != PAD
    total = max(1, real.sum())
    at_target = np.take_along_axis(chance, np.broadcast_to(target[None, :, None], (steps, width, 1)), 2)[:, :, 0]
    loss = float(-(np.log(at_target + 1e-12) * real).sum() / total)
    error = chance
    np.put_along_axis(error, np.broadcast_to(target[None, :, None], (steps, width, 1)), (at_target - 1)[:, :, None], 2)
    error *= (real / total)[:, :, None]
    d_out = np.stack([np.tensordot(states[0], error, ((0, 1), (0, 1))), np.tensordot(states[1], error[::-1], ((0, 1), (0, 1)))])
    into = np.stack([error @ net.out[0].T, error[::-1] @ net.out[1].T])
    d_state = np.zeros_like(net.state)
    d_given = np.zeros((2, steps, width, 3 * n), np.float32)
    carry = np.zeros((2, width, n), np.float32)
    back = net.state.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        past, keep, reset, memory, candidate = kept[t]
        d = into[:, t] + carry
        d_candidate = d * (1 - keep) * (1 - candidate * candidate)
        d_keep = d * (past - candidate) * keep * (1 - keep)
        d_reset = d_candidate * memory * reset * (1 - reset)
        through = np.concatenate([d_keep, d_reset, d_candidate * reset], axis=2)
        d_given[:, t] = np.concatenate([d_keep, d_reset, d_candidate], axis=2)
        d_state += past.transpose(0, 2, 1) @ through
        carry = d * keep + through @ back
    d_byte = np.zeros_like(net.byte)
    for k, order in enumerate((lanes, lanes[::-1])):
        one = np.zeros((steps * width, PAD + 1), np.float32)
        one[np.arange(steps * width), order.ravel()] = 1
        d_byte[k] = one.T @ d_given[k].reshape(-1, 3 * n)
    return loss, [d_byte, d_state, d_out, error.sum(axis=(0, 1))]


def fit(texts: list[tuple[str, str]], hidden: int = 12, rounds: int = 350, width: int = 96, steps: int = 64, seed: int = 7) -> Network:
    """Train on (text, language) pairs. Each round takes random sequences, as many of each language."""
    labels = sorted({lang for _, lang in texts})
    net = fresh(labels, hidden, seed)
    if len(labels) < 2:
        return net
    rng = np.random.default_rng(seed)
    pools = [[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t, lang in texts if lang == label] for label in labels]
    moment = [(np.zeros_like(w), np.zeros_like(w)) for w in net.arrays()]
    for i in range(1, rounds + 1):
        target = np.arange(width) % len(labels) if len(labels) <= width else rng.integers(len(labels), size=width)
        lanes = np.full((steps, width), PAD, np.int64)
        for k, label in enumerate(target):
            source = pools[label][rng.integers(len(pools[label]))]
            start = rng.integers(max(1, len(source) - steps + 1))
            piece = source[start:start + steps]
            lanes[:len(piece), k] = piece
        _, grads = gradients(net, lanes, target)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2 * (1 - i / (rounds + 1)))
        for w, g, (m, v) in zip(net.arrays(), grads, moment):
            g *= min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-7)).astype(np.float32)
    return net


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Network:
    """Fit the network on a bounded sample of labelled rows.

    The sample is, of each language, the sample_texts distinct texts with the least hash, each of at most SAMPLE_CHARS
    characters around its middle; it is the same at every run and however often a text is repeated. Rows with a null or
    empty text or a null language are left out. Over MAX_LABELS languages are an error. No rows give a network without
    labels, which predicts `und`.
    """
    rows = labelled.select(F.col(text).cast("string").alias("body"), F.col(lang).cast("string").alias("tongue")).where(
        "tongue is not null and length(body) > 0").withColumn("h", F.xxhash64("body"))
    # the least of each part of a language first, so that no task ranks a whole language
    part, least = Window.partitionBy("tongue", "part").orderBy("h"), Window.partitionBy("tongue").orderBy("h")
    parts = rows.select("tongue", "h", F.pmod("h", F.lit(SAMPLE_PARTS)).alias("part")).distinct().withColumn("k", F.row_number().over(part)).where(F.col("k") <= sample_texts)
    chosen = parts.select("tongue", "h").withColumn("k", F.row_number().over(least)).where(F.col("k") <= sample_texts)
    limits = chosen.groupBy("tongue").agg(F.max("h").alias("top")).limit(MAX_LABELS + 1).collect()
    if len(limits) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} languages")
    if not limits:
        return fresh([], 1, 0)
    within = F.lit(False)
    for r in limits:
        within = within | ((F.col("tongue") == r.tongue) & (F.col("h") <= r.top))
    start = F.greatest(F.lit(1), F.floor((F.length("body") - SAMPLE_CHARS) / 2).cast("int"))
    sample = (rows.where(within).select("tongue", "h", F.col("body").substr(start, F.lit(SAMPLE_CHARS)).alias("body"))
              .groupBy("tongue", "h").agg(F.min("body").alias("body")).orderBy("tongue", "h").collect())
    return fit([(r.body, r.tongue) for r in sample])


def document_chances(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean distribution of each text's positions."""
    owners, chunks = [], []
    total = np.zeros((len(texts), len(net.labels)))
    size = np.array([max(1, len(t)) for t in texts], float)

    def flush() -> None:
        lanes = np.full((len(chunks), SEQUENCE), PAD, np.int64)
        for k, piece in enumerate(chunks):
            lanes[k, :len(piece)] = piece
        chance = positions(net, np.ascontiguousarray(lanes.T))
        chance *= (lanes.T != PAD)[:, :, None]
        np.add.at(total, np.array(owners), chance.sum(axis=0, dtype=np.float64))
        owners.clear()
        chunks.clear()

    for i, text in enumerate(texts):
        values = np.frombuffer(text, np.uint8)
        for k in range(0, len(values), SEQUENCE):
            owners.append(i)
            chunks.append(values[k:k + SEQUENCE])
            if len(chunks) == LANES:
                flush()
    if chunks:
        flush()
    return total / size[:, None]


def predict(records: DataFrame, net: Network, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append the predicted language of a text and the mean chance of its positions.

    Only the text is an input. Null, empty and letterless texts, and all texts if the network has no labels, give `und`
    with score 0. Of equal chances the first label in order wins. Other columns are kept; ones named like the two new ones
    are replaced. Rows do not change in number.
    """
    @F.arrow_udf("struct<label:string,chance:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n = len(batch)
            labels, chances = [UNKNOWN] * n, np.zeros(n)
            rows, texts, size = [], [], 0

            def settle() -> None:
                for row, chance in zip(rows, document_chances(net, texts)):
                    best = int(np.argmax(chance))
                    labels[row], chances[row] = net.labels[best], min(1.0, float(chance[best]))

            for i in range(n):
                value = batch[i].as_py()
                if value and net.labels and any(map(str.isalpha, value)):
                    rows.append(i)
                    texts.append(value.encode("utf-8", "surrogatepass"))
                    size += len(texts[-1])
                    if size >= 1 << 22:
                        settle()
                        rows, texts, size = [], [], 0
            if rows:
                settle()
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(chances)], ["label", "chance"])

    found = put_columns(records, **{"__lang": predicted(F.col(text).cast("string"))})
    return put_columns(found, **{lang_pred: F.col("__lang.label"), score: F.col("__lang.chance")}).drop("__lang")

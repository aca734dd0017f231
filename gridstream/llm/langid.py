"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled text windows. It gives every byte position a distribution
over the languages; a document's distribution is the mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import clash_free, give_back, ship

WIDTH = 64  # bytes in a window; documents are cut into such windows
HIDDEN = 8
SAMPLE = 6000  # windows of each language to learn from, at most
BATCH = 2048  # windows at once: their states fit a core's cache
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")

Params = dict[str, np.ndarray]


def windows_of(raw: bytes) -> np.ndarray:
    """A text's bytes as rows of WIDTH, the last one filled with zeros."""
    n = max(1, -(-len(raw) // WIDTH))
    out = np.zeros(n * WIDTH, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WIDTH)


def initial(classes: int, seed: int) -> Params:
    """Weights of both directions (first axis), with the bytes' input weights as a table."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    return {
        "table": (rng.standard_normal((2, 256, 3 * h)) * 0.3).astype(np.float32),
        "u_gates": (rng.standard_normal((2, h, 2 * h)) / np.sqrt(h)).astype(np.float32),
        "u_new": (rng.standard_normal((2, h, h)) / np.sqrt(h)).astype(np.float32),
        "out": (rng.standard_normal((2 * h, classes)) / np.sqrt(2 * h)).astype(np.float32),
        "bias": np.zeros(classes, np.float32),
    }


def gate(a: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    a *= 0.5
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def run(p: Params, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (step, row, 2 * HIDDEN) of byte windows; keep: also each step's gates."""
    h, (rows, width) = HIDDEN, x.shape
    state = np.zeros((2, rows, h), np.float32)
    states = np.empty((width, rows, 2 * h), np.float32)
    tape, table, columns = [], p["table"], np.ascontiguousarray(x.T)
    into = np.empty((2, rows, 3 * h), np.float32)
    for t in range(width):
        table[0].take(columns[t], axis=0, out=into[0], mode="clip")
        table[1].take(columns[width - 1 - t], axis=0, out=into[1], mode="clip")
        gates = state @ p["u_gates"]
        gates += into[..., : 2 * h]
        gate(gates)
        update, reset = gates[..., :h], gates[..., h:]
        inner = state @ p["u_new"]
        new = np.tanh(into[..., 2 * h :] + reset * inner)
        if keep:
            tape.append((state, update, reset, inner, new))
        state = new + update * (state - new)
        states[t, :, :h] = state[0]
        states[width - 1 - t, :, h:] = state[1]
    return states, tape


def positions(p: Params, x: np.ndarray) -> np.ndarray:
    """Language probabilities (class, step, row) at every byte position."""
    states = run(p, x)[0]
    logits = p["out"].T @ states.reshape(-1, 2 * HIDDEN).T
    logits += p["bias"][:, None]
    np.clip(logits, -40, 40, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits.reshape(-1, *states.shape[:2])


def gradients(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean cross entropy over the positions that hold a byte, and its gradient through time."""
    h, (rows, width) = HIDDEN, x.shape
    states, tape = run(p, x, keep=True)
    logits = states @ p["out"] + p["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    mask = (x.T != 0).astype(np.float32)
    weight = mask / max(1.0, float(mask.sum()))
    loss = float(-(np.log(prob[:, np.arange(rows), y] + 1e-9) * weight).sum())
    prob[:, np.arange(rows), y] -= 1
    prob *= weight[..., None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"] = np.einsum("trh,trc->hc", states, prob)
    g["bias"] = prob.sum(axis=(0, 1))
    above = prob @ p["out"].T
    into = np.empty((width, 2, rows, 3 * h), np.float32)
    back = np.zeros((2, rows, h), np.float32)
    for t in range(width - 1, -1, -1):
        state, update, reset, inner, new = tape[t]
        back[0] += above[t, :, :h]
        back[1] += above[width - 1 - t, :, h:]
        d_new = back * (1 - update) * (1 - new * new)
        d_update = back * (state - new) * update * (1 - update)
        d_reset = d_new * inner * reset * (1 - reset)
        d_inner = d_new * reset
        d_gates = np.concatenate([d_update, d_reset], axis=2)
        into[t] = np.concatenate([d_gates, d_new], axis=2)
        turned = state.transpose(0, 2, 1)
        g["u_gates"] += turned @ d_gates
        g["u_new"] += turned @ d_inner
        back = back * update + d_gates @ p["u_gates"].transpose(0, 2, 1) + d_inner @ p["u_new"].transpose(0, 2, 1)
    for d, order in ((0, x.T), (1, x.T[::-1])):
        np.add.at(g["table"][d], order.reshape(-1), into[:, d].reshape(-1, 3 * h))
    return loss, g


def train(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 240, rows: int = 128, rate: float = 0.02, seed: int = 7) -> Params:
    """Adam over random batches of windows x with languages y."""
    p, rng = initial(classes, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), rows)
        _, g = gradients(p, x[pick], y[pick])
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((v * v).sum() for v in g.values())))))
        now = rate * (1 - step / (steps + 1)) ** 0.5
        for k, v in g.items():
            v = v * scale
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = (p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def pooled(p: Params, texts: list[bytes]) -> np.ndarray:
    """Mean of the positions' probabilities over every byte of each text."""
    cut = [windows_of(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    x = np.concatenate(cut)
    sums, sizes = np.zeros((len(texts), p["bias"].size)), np.maximum(1, [len(t) for t in texts])
    ends = np.zeros(len(x), np.int64)
    last = np.cumsum([len(c) for c in cut]) - 1
    ends[:] = WIDTH
    ends[last] = [len(t) - (len(c) - 1) * WIDTH for t, c in zip(texts, cut, strict=True)]
    for a in range(0, len(x), BATCH):
        part = x[a : a + BATCH]
        prob = positions(p, part)
        prob *= np.arange(WIDTH)[:, None] < ends[a : a + BATCH]
        np.add.at(sums, owner[a : a + BATCH], prob.sum(axis=1).T)
    return sums / sizes[:, None]


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], Params] | None:
    """Fit the network on rows where ``usable`` holds and text and lang are not null.

    Every language that such a row has is learned. The sample is bounded: at
    most ``sample`` windows of WIDTH bytes of each language, up to four windows
    of a text. Texts are chosen by their hash, at a rate set by how many different
    texts a language has, and repeated ones count once: a language of few or
    much repeated texts gives all of them. Returns None where no row can be used.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(usable & F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).withColumn("o", F.xxhash64("t"))
    different = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("o", 0.02).alias("n")).collect()}  # a row per language
    if not different:
        return None
    names = sorted(different)
    share = F.coalesce(*[F.when(F.col("l") == n, F.lit(min(1.0, 1.5 * (sample / 4 + 50) / max(1, different[n])))) for n in names])
    width = 4 * WIDTH
    picked = rows.where(F.pmod(F.xxhash64(F.lit(2), "o"), F.lit(1 << 20)) < share * (1 << 20)).select(
        "l", F.substring("t", 1 + F.pmod(F.xxhash64(F.lit(1), "t"), F.greatest(F.lit(1), F.char_length("t") - width + 1)).cast("int"), F.lit(width)).alias("w"), "o"
    )
    got = picked.dropDuplicates(["l", "o"]).orderBy("o", "w", "l").limit(2 * sample * len(names)).collect()
    x, y, taken = [], [], dict.fromkeys(names, 0)
    for r in got:
        cut = windows_of(r["w"].encode("utf-8", "surrogatepass"))[: max(0, min(4, sample - taken[r["l"]]))]
        taken[r["l"]] += len(cut)
        x.append(cut)
        y += [names.index(r["l"])] * len(cut)
    if lacking := [n for n in names if not taken[n]]:
        raise ValueError(f"no text was chosen of {lacking}")
    order = np.asarray(y)  # every language weighs the same
    each = max(np.bincount(order))
    index = np.concatenate([np.resize(np.flatnonzero(order == c), each) for c in range(len(names))])
    return names, train(np.concatenate(x)[index], order[index], len(names))


@clash_free
def identify(docs: DataFrame, model: tuple[list[str], Params] | None, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the most probable language of each whole text and its probability.

    Null texts and texts without a letter are UNKNOWN with score 0, as is every
    text when nothing could be learned. Rows are handled alone: all stay,
    scores have six decimals, ties go to the first name. Input columns
    named like the results are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # a few numbers per language

    @F.pandas_udf("label string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            labels, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            known = [i for i, x in enumerate(batch) if model and x and _letter.search(x)]
            at = 0
            while at < len(known):
                part, size = [], 0
                while at < len(known) and (not part or size < 4 * WIDTH * BATCH):
                    raw = batch.iloc[known[at]].encode("utf-8", "surrogatepass")
                    part.append((known[at], raw))
                    size += len(raw)
                    at += 1
                prob = pooled(model[1], [raw for _, raw in part])
                for (i, _), row in zip(part, prob, strict=True):
                    labels[i], scores[i] = model[0][int(row.argmax())], round(min(1.0, float(row.max())), 6)
            yield pd.DataFrame({"label": labels, "score": scores})
        give_back()

    rest = [c for c in docs.columns if c not in (label, score)]
    return docs.select(*rest, predict(F.col(text)).alias("_p")).select(*rest, F.col("_p.label").alias(label), F.col("_p.score").alias(score))

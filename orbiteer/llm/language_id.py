"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table, tidy
from .wordhash import slices

#: Bytes of one sequence; a text is cut into such, each read from both sides.
STEPS = 64
#: Sequences that go through the network together.
PART = 8192
HIDDEN = 8
#: Labelled documents of each language, and stretches of each of them, that the network learns from, about: the bound
#: of what the driver gathers (times the number of languages and STEPS bytes).
LEARN_DOCS, LEARN_STRETCHES = 500, 8
#: Languages that a network can learn; more in the table are an error.
MOST_LANGUAGES = 256
UPDATES, SEQUENCES = 500, 128

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether one of Unicode's categories L* is in ``text``; the pattern alone takes numerals too."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class ByteGru:
    """Two gated recurrent layers, one for each direction, and a linear layer on both.  Gates and candidates are clipped
    linear (hard sigmoid and hard tanh), so a step has no exponentials.  All arrays are (features, sequences)."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> ByteGru:
        random, w = np.random.default_rng(seed), {}
        for d in "fb":
            w[f"in_{d}"] = random.normal(0, 0.3, (3 * hidden, 256))
            w[f"rec_{d}"] = random.normal(0, 0.3, (3 * hidden, hidden))
            w[f"bias_{d}"] = np.repeat([0.5, 0.5, 0.0], hidden)[:, None]
            w[f"out_{d}"] = random.normal(0, 0.3, (len(languages), hidden))
        w["out_bias"] = np.zeros((len(languages), 1))
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def _pass(self, d: str, codes: np.ndarray, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(step, state) of one direction; ``codes`` is (steps, sequences)."""
        inputs = self.weights[f"in_{d}"] + self.weights[f"bias_{d}"]
        rec = self.weights[f"rec_{d}"]
        n = rec.shape[1]
        state = np.zeros((n, codes.shape[1]), dtype=np.float32)
        a, u = np.empty((3 * n, codes.shape[1]), dtype=np.float32), np.empty((3 * n, codes.shape[1]), dtype=np.float32)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            np.take(inputs, codes[t], axis=1, out=a, mode="clip")
            np.matmul(rec, state, out=u)
            gates = np.add(a[: 2 * n], u[: 2 * n], out=a[: 2 * n])
            if keep is None:
                np.clip(gates, 0, 1, out=gates)
                new = np.multiply(gates[n:], u[2 * n :], out=u[2 * n :])
                new += a[2 * n :]
                np.clip(new, -1, 1, out=new)
                new -= state
                new *= gates[:n]
                state += new
            else:
                gate = np.clip(gates, 0, 1)
                new = a[2 * n :] + gate[n:] * u[2 * n :]
                keep.append((t, state, gates.copy(), gate, u[2 * n :].copy(), new))
                state = state + gate[:n] * (np.clip(new, -1, 1) - state)
            yield t, state

    def pooled(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over each sequence's first ``lengths`` positions of the positions' probabilities: (languages, sequences)."""
        w, forward = self.weights, np.empty((len(codes), len(self.languages), codes.shape[1]), dtype=np.float32)
        for t, state in self._pass("f", codes):
            np.matmul(w["out_f"], state, out=forward[t])
        total = np.zeros(forward.shape[1:], dtype=np.float32)
        for t, state in self._pass("b", codes):
            logits = w["out_b"] @ state
            logits += forward[t]
            logits += w["out_bias"]
            logits -= logits.max(axis=0)
            np.exp(logits, out=logits)
            logits *= (lengths > t) / logits.sum(axis=0)
            total += logits
        return total

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, and its gradient by backpropagation through time."""
        w, steps, g = self.weights, len(codes), {}
        logits = np.repeat(w["out_bias"][None].astype(np.float32), steps, 0) + np.zeros((1, 1, codes.shape[1]), np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: np.empty((steps, w["rec_f"].shape[1], codes.shape[1]), np.float32) for d in "fb"}
        for d in "fb":
            for t, state in self._pass(d, codes, kept[d]):
                states[d][t] = state
                logits[t] += w[f"out_{d}"] @ state
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(codes.shape[1])
        loss = -float(np.log(p[:, labels, at] + 1e-9).mean())
        p[:, labels, at] -= 1
        p /= steps * codes.shape[1]
        g["out_bias"] = p.sum(axis=(0, 2))[:, None]
        for d in "fb":
            rec, n = w[f"rec_{d}"], w["rec_f"].shape[1]
            g[f"out_{d}"] = np.einsum("tlb,thb->lh", p, states[d])
            g[f"rec_{d}"], g_in, carry = np.zeros_like(rec), np.zeros((256, 3 * n), np.float32), np.float32(0)
            for t, before, gates, gate, rec_new, new in reversed(kept[d]):
                up = w[f"out_{d}"].T @ p[t] + carry
                d_new = up * gate[:n] * (np.abs(new) < 1)
                d_gates = np.concatenate([up * (np.clip(new, -1, 1) - before), d_new * rec_new]) * ((gates > 0) & (gates < 1))
                d_rec = np.concatenate([d_gates, d_new * gate[n:]])
                g[f"rec_{d}"] += d_rec @ before.T
                carry = up * (1 - gate[:n]) + rec.T @ d_rec
                np.add.at(g_in, codes[t], np.concatenate([d_gates, d_new]).T)
            g[f"in_{d}"] = g_in.T
            g[f"bias_{d}"] = g_in.sum(axis=0)[:, None]
        return loss, g

    def learn(self, codes: np.ndarray, labels: np.ndarray, updates: int, sequences: int, seed: int, rate: float = 0.02) -> None:
        """Adam on random batches; ``codes`` is (steps, sequences)."""
        random, m, v = np.random.default_rng(seed), {}, {}
        for i in range(1, updates + 1):
            pick = random.integers(0, codes.shape[1], min(sequences, codes.shape[1]))
            _, g = self.gradients(codes[:, pick], labels[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                step = rate * (1 - i / (updates + 1)) / (1 - 0.9**i)
                self.weights[k] = (self.weights[k] - step * m[k] / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)


def sequences(data: np.ndarray, offsets: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into sequences: codes (steps, sequences), filled up with blanks; their lengths; each text's first."""
    sizes = np.diff(offsets)
    count = -(-sizes // steps)
    first = np.concatenate([[0], np.cumsum(count)])
    codes = np.full(int(first[-1]) * steps, 0x20, dtype=np.uint8)
    codes[np.arange(len(data)) + np.repeat(first[:-1] * steps - offsets[:-1], sizes)] = data
    lengths = np.full(int(first[-1]), steps, dtype=np.int64)
    full = count > 0
    lengths[first[1:][full] - 1] = (sizes - (count - 1) * steps)[full]
    return np.ascontiguousarray(codes.reshape(-1, steps).T), lengths, first


def _stretches(most: int, steps: int):
    """Up to ``most`` stretches of each text, evenly spread over all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, out = [], []
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                n = max(1, min(most, len(raw) // steps))
                for i in range(n):
                    at = (len(raw) - steps) * i // max(1, n - 1) if n > 1 else 0
                    out.append(raw[at : at + steps].ljust(steps))
                    languages.append(language)
            yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(out, pa.binary())], names=["lang", "stretch"])

    return run


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, learn_docs: int = LEARN_DOCS, stretches: int = LEARN_STRETCHES, hidden: int = HIDDEN, steps: int = STEPS, updates: int = UPDATES, seed: int = 5) -> ByteGru | None:
    """A network for the languages in ``docs`` (doc_id, text, lang), learnt from rows with both that aren't held out.

    The sample is about ``learn_docs`` different texts of each language, chosen by a hash of the text, and at least one:
    a language is never lost, and rows that repeat a text count once.  Up to ``stretches`` stretches of each come to the
    driver, in an order that doesn't depend on partitions; at most twice the number expected are taken, a bound that the
    sample stays far below.  More than ``MOST_LANGUAGES`` languages raise an error.  None if nothing can be learnt from:
    an empty table, or one without a labelled text that has a letter."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.coalesce(~held_out(), F.lit(True)))
    known = known.select("lang", "text", F.xxhash64("text").alias("hash"))
    chance = F.pmod("hash", F.lit(1 << 40)) / float(1 << 40)
    counts = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"), F.min(chance).alias("least"))
    languages = {r["lang"]: max(r["least"], min(1.0, learn_docs / r["n"])) for r in counts.limit(MOST_LANGUAGES + 1).collect()}
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    rates = F.create_map(*[F.lit(x) for k, rate in sorted(languages.items()) for x in (k, rate)])
    rows = known.where(chance <= rates[F.col("lang")]).select("lang", "text").distinct().mapInArrow(tidy(_stretches(stretches, steps)), "lang string, stretch binary")
    rows = sorted((r["lang"], bytes(r["stretch"])) for r in rows.limit(2 * max(learn_docs, 100) * stretches * len(languages)).collect())
    names = sorted({lang for lang, _ in rows})
    codes = np.ascontiguousarray(np.frombuffer(b"".join(s for _, s in rows), dtype=np.uint8).reshape(-1, steps).T)
    labels = np.array([names.index(lang) for lang, _ in rows])
    # each language alike often
    random = np.random.default_rng(seed)
    even = np.concatenate([random.choice(np.flatnonzero(labels == k), max(np.bincount(labels))) for k in range(len(names))])
    model = ByteGru.fresh(names, hidden, seed)
    model.learn(codes[:, even], labels[even], updates, SEQUENCES, seed)
    return model


def _predict(model: ByteGru | None, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found, scores = [], []
            for a, b, data, offsets in slices(texts, PART * steps):
                if model is not None:
                    total = np.zeros((len(model.languages), b - a))
                    # a text longer than a slice goes through the network in parts, cut where its sequences are
                    for at in range(0, max(1, len(data)), PART * steps):
                        part = np.clip(offsets - at, 0, PART * steps) if len(data) > PART * steps else offsets
                        codes, lengths, first = sequences(data[at : at + PART * steps], part, steps)
                        full = np.flatnonzero(np.diff(first))
                        if len(full):
                            total[:, full] += np.add.reduceat(model.pooled(codes, lengths), first[:-1][full], axis=1, dtype=np.float64)
                    share = total / np.maximum(total.sum(axis=0), 1e-12)
                    best, score = share.argmax(axis=0), share.max(axis=0)
                for i in range(a, b):
                    text = texts[i].as_py()
                    certain = model is not None and text is not None and has_letter(text)
                    found.append(model.languages[best[i - a]] if certain else UNDETERMINED)
                    scores.append(round(float(score[i - a]), 5) if certain else 0.0)
            rest = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return tidy(run)


def identify(docs: DataFrame, model: ByteGru | None, steps: int = STEPS) -> DataFrame:
    """``docs`` (text and any others) with lang_pred and score.

    Every byte of a text gets probabilities from the states of both directions; their mean over the whole text gives
    lang_pred and its score; of languages with equal shares, the first by name.  A text that is null, empty or has no
    letter gets ``und`` and 0, as does any without a model.  Each row is taken by itself, so repeated rows get the same,
    and an empty table gives no row; a long text goes through the network in parts.  Columns of the added names are
    replaced."""
    short_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predict(model, steps), f"{kinds}, lang_pred string, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Language identification: a small bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices, text_bytes

#: Bytes of a segment: states start anew at each segment, so a long text's positions run side by side.
SEGMENT = 128
UNKNOWN = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    """``languages`` in order; per direction: byte inputs (3H, 256), recurrent weights (3H, H), output weights (C, H)."""

    languages: list[str]
    w: dict[str, np.ndarray] = field(default_factory=dict)


def _init(n_languages: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.2, (3 * hidden, 256))
        w[f"x{d}"][: 2 * hidden] += 0.5  # gates are linear between 0 and 1
        w[f"u{d}"] = rng.normal(0, 0.7 / np.sqrt(hidden), (3 * hidden, hidden))
        w[f"o{d}"] = rng.normal(0, 0.3, (n_languages, hidden))
    w["c"] = np.zeros(n_languages)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _step(h: np.ndarray, gx: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of the gated unit: the new state and what the way back needs (gates, candidate, recurrent part of it).

    Arrays are (feature, segment). The gates are clipped lines, which cost a fraction of a sigmoid.
    """
    k = len(h)
    gh = u @ h
    gates = np.clip(gx[: 2 * k] + gh[: 2 * k], 0, 1)
    n = np.tanh(gx[2 * k :] + gates[k:] * gh[2 * k :])
    return n + gates[:k] * (h - n), gates, n, gh[2 * k :]


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def train(
    texts: list[bytes], labels: list[str], hidden: int = 8, steps: int = 260, batch: int = 256, length: int = 48, seed: int = 7
) -> Model:
    """Fits the network by backpropagation through time: cross entropy at every position, Adam, a fixed step count."""
    languages = sorted(set(labels))
    model = Model(languages)
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed)
    w = model.w = _init(len(languages), hidden, rng)
    of = {name: [t for t, x in zip(texts, labels, strict=True) if x == name and len(t) >= 8] or [b" " * 8] for name in languages}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)
        x = np.full((batch, length), 32, np.uint8)
        for i, k in enumerate(y):
            own = of[languages[k]]
            t = own[rng.integers(len(own))]
            a = rng.integers(max(1, len(t) - length + 1))
            part = np.frombuffer(t[a : a + length], np.uint8)
            x[i, : len(part)] = part
        grads = _gradients(w, x, y)
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    size, length = x.shape
    hidden = w["uf"].shape[1]
    grads = {k: np.zeros_like(a) for k, a in w.items()}
    states, logits = {}, np.zeros((len(w["c"]), length, size), np.float32) + w["c"][:, None, None]
    for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
        h, kept = np.zeros((hidden, size), np.float32), {}
        for t in order:
            new, gates, n, ghn = _step(h, w[f"x{d}"][:, x[:, t]], w[f"u{d}"])
            kept[t] = (h, gates, n, ghn, new)
            h = new
            logits[:, t] += w[f"o{d}"] @ h
        states[d] = kept
    delta = _softmax(logits)
    delta[y, :, np.arange(size)] -= 1
    delta /= size * length
    grads["c"] = delta.sum((1, 2))
    for d, order in (("f", range(length - 1, -1, -1)), ("b", range(length))):
        dh = np.zeros((hidden, size), np.float32)
        rows, moved = [], []
        for t in order:
            h, gates, n, ghn, new = states[d][t]
            z, r = gates[:hidden], gates[hidden:]
            grads[f"o{d}"] += delta[:, t] @ new.T
            dh = dh + w[f"o{d}"].T @ delta[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * ((z > 0) & (z < 1))
            dr = dn * ghn * ((r > 0) & (r < 1))
            dgh = np.concatenate([dz, dr, dn * r])
            moved.append(np.concatenate([dz, dr, dn]))
            rows.append(x[:, t])
            grads[f"u{d}"] += dgh @ h.T
            dh = dh * z + w[f"u{d}"].T @ dgh
        np.add.at(grads[f"x{d}"].T, np.concatenate(rows), np.concatenate(moved, 1).T)
    return grads


def position_probabilities(model: Model, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(language, position, segment) probabilities; ``segments`` is (position, segment), ``lengths`` must not rise.

    Past a segment's end they mean nothing.
    """
    w, (width, count) = model.w, segments.shape
    logits = np.empty((len(model.languages), width, count), np.float32)
    logits[:] = w["c"][:, None, None]
    alive = np.searchsorted(-lengths, -np.arange(width), "left")  # segments longer than t
    for d, order in (("f", range(width)), ("b", range(width - 1, -1, -1))):
        h = np.zeros((w["uf"].shape[1], count), np.float32)
        wx, u, o = w[f"x{d}"], w[f"u{d}"], w[f"o{d}"]
        for t in order:
            k = alive[t]
            if k == count:
                h = _step(h, np.take(wx, segments[t], axis=1), u)[0]
                logits[:, t] += o @ h
            elif k:
                h[:, :k] = own = _step(h[:, :k], np.take(wx, segments[t, :k], axis=1), u)[0]
                logits[:, t, :k] += o @ own
    return _softmax(logits)


def _pooled(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of the position probabilities of each text."""
    sizes = np.diff(offsets)
    parts = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), parts)
    first = np.repeat(offsets[:-1] - SEGMENT * np.concatenate([[0], np.cumsum(parts)[:-1]]), parts) + SEGMENT * np.arange(len(doc))
    lengths = np.minimum(SEGMENT, offsets[doc + 1] - first)
    out = np.zeros((len(sizes), len(model.languages)))
    order = np.argsort(-lengths, kind="stable")
    for a in range(0, len(order), 1024):
        own = order[a : a + 1024]
        at = first[own] + np.arange(SEGMENT)[:, None]
        p = position_probabilities(model, data[np.minimum(at, len(data) - 1)], lengths[own])
        p[:, np.arange(SEGMENT)[:, None] >= lengths[own]] = 0
        np.add.at(out, doc[own], p.sum(1, dtype=np.float64).T)
    return out / np.maximum(sizes, 1)[:, None]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def training_rows(docs: DataFrame, rows_per_language: int = 400) -> tuple[list[bytes], list[str]]:
    """A bounded sample of labelled rows, at most ``rows_per_language`` of each language, those of the smallest hashes.

    The bound is on what is fitted only: counts cover all rows and languages, and every text is labelled later. Reruns
    take the same rows.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return [], []
    share = F.create_map(*[x for name in sorted(counts) for x in (F.lit(name), F.lit(min(1.0, 1.5 * rows_per_language / counts[name])))])
    draw = F.xxhash64("doc_id", "text", F.lit("train"))
    few = known.withColumn("draw", draw).where((F.pmod("draw", F.lit(1_000_000)) / F.lit(1e6)) < F.element_at(share, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    got = few.withColumn("place", place).where(F.col("place") <= rows_per_language).orderBy("lang", "place").select("lang", "text").collect()
    return [r["text"].encode() for r in got], [r["lang"] for r in got]


def fit(docs: DataFrame, rows_per_language: int = 400) -> Model:
    """A model from the rows of (doc_id, text, lang) that may be learned from."""
    return train(*training_rows(docs, rows_per_language))


def with_language(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with the language of every whole text and its probability, in the columns ``label`` and ``score``.

    Every byte position of the whole text gets a distribution over the languages; a document's is their mean, its
    label the most likely (ties: the first by name). Null, empty and letterless texts get ``und`` with score 0.
    Without anything learned all get ``und``; with one language learned all texts with letters get it. Repeated rows
    each get a result, an empty table stays empty, other columns pass through.
    """
    names = model.languages
    place = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if keep_text or i != place]
    schema = StructType([*[docs.schema.fields[i] for i in kept], StructField(label, StringType()), StructField(score, DoubleType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for a, b in slices(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ok = _has_letter(part, own) if names else np.zeros(b - a, bool)
                p = _pooled(model, part, own) if len(names) > 1 else np.ones((b - a, 1))
                best = p.argmax(1)
                found = [names[k] if good else UNKNOWN for k, good in zip(best, ok, strict=True)]
                sure = np.where(ok, np.clip(p[np.arange(b - a), best], 0, 1), 0.0)
                columns = [*[batch.column(i).slice(a, b - a) for i in kept], pa.array(found, pa.string()), pa.array(sure)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    return with_language(docs.select("doc_id", "text"), model, keep_text=False)


def held_out() -> Column:
    """Whether a row is held out from learning: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

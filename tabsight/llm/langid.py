"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is lower-cased, encoded as UTF-8 and read in windows of ``CORE`` bytes with ``REACH``
bytes of context on either side, so every byte of a text of any length is labelled once and
many windows run side by side.  One recurrent layer reads each window forwards, one backwards;
their states at a byte give the probabilities of the languages there.  A document's
probabilities are the means over the bytes of its letters.

The network is fitted by backpropagation through time on a bounded sample of excerpts, each byte
of an excerpt being labelled with the language of its document.  Only text is an input of a
prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

FOLDS, HELD_OUT = 4, 2  # rows with crc32(doc_id) % FOLDS == HELD_OUT are never learned from
SAMPLE = 500  # excerpts per language that the network may be fitted on
PER_DOCUMENT = 4  # excerpts that one document may give
STATE = 8
CORE, REACH = 112, 8
STEPS = CORE + 2 * REACH
EPOCHS = 12
BATCH = 64
RATE = 0.02
UNKNOWN = "und"
_ROWS = 1024  # windows that run side by side
_SLICE = 4_000_000  # bytes of text cut into windows at once
_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[ord("a") : ord("z") + 1] = True
_IS_LETTER[128:] = True


@dataclass
class Layer:
    """One direction: per byte value, from state to state, and the bias inside the reset gate.

    The rows are those of the update gate, the reset gate and the candidate state.  Gates are
    computed as (1 + tanh) / 2, so their weights are on half the usual scale.
    """

    of_byte: np.ndarray
    of_state: np.ndarray
    inner: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator) -> Layer:
        return Layer(
            rng.normal(0, 0.3, (3 * STATE, 256)).astype(np.float32),
            rng.normal(0, 0.4 / np.sqrt(STATE), (3 * STATE, STATE)).astype(np.float32),
            np.zeros((STATE, 1), dtype=np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.of_byte, self.of_state, self.inner]

    def run(self, windows: np.ndarray, order: Sequence[int], keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place, states of all windows after reading it); ``keep`` collects what learning needs."""
        count = windows.shape[1]
        state = np.zeros((STATE, count), dtype=np.float32)
        read = np.empty((3 * STATE, count), dtype=np.float32)
        back = np.empty_like(read)
        for place in order:
            np.take(self.of_byte, windows[place], axis=1, out=read, mode="clip")
            np.matmul(self.of_state, state, out=back)
            gates, candidate, inner = read[: 2 * STATE], read[2 * STATE :], back[2 * STATE :]
            gates += back[: 2 * STATE]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            inner += self.inner
            if keep is not None:
                before = inner.copy()
            inner *= gates[STATE:]
            candidate += inner
            np.tanh(candidate, out=candidate)
            new = state - candidate
            if keep is not None:
                keep.append((state, gates.copy(), candidate.copy(), before))
            new *= gates[:STATE]
            new += candidate
            state = new
            yield place, state

    def learn(self, windows: np.ndarray, order: Sequence[int], kept: list, pushed: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parts, given the loss gradient of the states at each place."""
        count = windows.shape[1]
        d_state = np.zeros((STATE, count), dtype=np.float32)
        d_read = np.empty((len(kept), 3 * STATE, count), dtype=np.float32)
        d_of_state, d_inner = np.zeros_like(self.of_state), np.zeros_like(self.inner)
        d_back = np.empty((3 * STATE, count), dtype=np.float32)
        for at in range(len(kept) - 1, -1, -1):
            place = order[at]
            state, gates, candidate, before = kept[at]
            update, reset = gates[:STATE], gates[STATE:]
            d_new = d_state + pushed[place]
            own = d_read[at]
            own[2 * STATE :] = d_new * (1 - update) * (1 - candidate**2)
            own[:STATE] = d_new * (state - candidate) * 2 * update * (1 - update)
            own[STATE : 2 * STATE] = own[2 * STATE :] * before * 2 * reset * (1 - reset)
            d_back[: 2 * STATE] = own[: 2 * STATE]
            d_back[2 * STATE :] = own[2 * STATE :] * reset
            d_of_state += d_back @ state.T
            d_inner += d_back[2 * STATE :].sum(axis=1, keepdims=True)
            d_state = d_new * update + self.of_state.T @ d_back
        values = windows[list(order)].ravel()
        by_row = d_read.transpose(1, 0, 2).reshape(3 * STATE, -1)
        d_of_byte = np.stack([np.bincount(values, weights=row, minlength=256) for row in by_row]).astype(np.float32)
        return [d_of_byte, d_of_state, d_inner]


@dataclass
class Model:
    """Both layers and what their states say about each language."""

    languages: list[str]
    forwards: Layer
    backwards: Layer
    out_forwards: np.ndarray
    out_backwards: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(languages: Sequence[str], seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        k = len(languages)
        return Model(
            list(languages), Layer.fresh(rng), Layer.fresh(rng),
            rng.normal(0, 0.3, (k, STATE)).astype(np.float32), rng.normal(0, 0.3, (k, STATE)).astype(np.float32),
            np.zeros((k, 1), dtype=np.float32))

    def parts(self) -> list[np.ndarray]:
        return [*self.forwards.parts(), *self.backwards.parts(), self.out_forwards, self.out_backwards, self.bias]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Sum of the language probabilities over the letters of each window's core: (languages, windows)."""
        letters = _IS_LETTER[windows[REACH : REACH + CORE]].astype(np.float32)
        states = np.empty((REACH + CORE, STATE, windows.shape[1]), dtype=np.float32)
        for place, state in self.forwards.run(windows, range(REACH + CORE)):
            states[place] = state
        total = np.zeros((len(self.languages), windows.shape[1]), dtype=np.float32)
        for place, state in self.backwards.run(windows, range(STEPS - 1, REACH - 1, -1)):
            if place < REACH + CORE:
                p = self.out_forwards @ states[place]
                p += self.out_backwards @ state
                p += self.bias
                p -= p.max(axis=0)
                np.exp(p, out=p)
                p *= letters[place - REACH] / p.sum(axis=0)
                total += p
        return total

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over all letters of the windows, for each part."""
        count = windows.shape[1]
        letters = _IS_LETTER[windows].astype(np.float32)
        letters /= max(1.0, float(letters.sum()))
        there, back = range(STEPS), range(STEPS - 1, -1, -1)
        kept_there: list = []
        kept_back: list = []
        first = np.empty((STEPS, STATE, count), dtype=np.float32)
        second = np.empty_like(first)
        for place, state in self.forwards.run(windows, there, kept_there):
            first[place] = state
        for place, state in self.backwards.run(windows, back, kept_back):
            second[place] = state
        p = np.matmul(self.out_forwards, first) + np.matmul(self.out_backwards, second) + self.bias
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, labels, np.arange(count)] -= 1
        p *= letters[:, None, :]
        d_first, d_second = np.matmul(self.out_forwards.T, p), np.matmul(self.out_backwards.T, p)
        return [
            *self.forwards.learn(windows, there, kept_there, d_first),
            *self.backwards.learn(windows, back, kept_back, d_second),
            np.einsum("tkb,thb->kh", p, first), np.einsum("tkb,thb->kh", p, second), p.sum(axis=(0, 2))[:, None]]


def raw(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)


def cut(data: np.ndarray) -> np.ndarray:
    """The windows of a text as rows; bytes of value 0 stand before its start and after its end."""
    count = -(-len(data) // CORE)
    room = np.zeros(count * CORE + 2 * REACH, dtype=np.uint8)
    room[REACH : REACH + len(data)] = data
    return np.lib.stride_tricks.as_strided(room, (count, STEPS), (CORE, 1))


def fit(rows: Sequence[tuple[str, bool, str]], epochs: int = EPOCHS, seed: int = 5) -> Model | None:
    """A network fitted by Adam on (excerpt, whether it starts its text, language) rows; None without rows."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    place = {name: i for i, name in enumerate(languages)}
    windows = np.zeros((len(rows), STEPS), dtype=np.uint8)
    for i, (text, starts, _) in enumerate(rows):
        data = raw(text)[: STEPS - REACH * starts]
        windows[i, REACH * starts : REACH * starts + len(data)] = data
    labels = np.array([place[r[2]] for r in rows])
    model = Model.fresh(languages, seed)
    rng = np.random.default_rng(seed)
    parts = model.parts()
    means, squares, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    steps = max(1, epochs * -(-len(rows) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            pick = order[start : start + BATCH]
            found = model.gradients(np.ascontiguousarray(windows[pick].T), labels[pick])
            size = np.sqrt(sum(float((g**2).sum()) for g in found))
            rate = RATE * (1 - step / steps)
            step += 1
            for p, g, m, v in zip(parts, found, means, squares):
                g = g / max(1.0, size)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def predict(model: Model | None, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each whole text."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    total = np.zeros((len(texts), len(model.languages)))
    letters = np.zeros(len(texts))
    waiting: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def settle(everything: bool) -> None:
        rows, owner = np.concatenate(waiting), np.concatenate(owners)
        end = len(rows) if everything else len(rows) // _ROWS * _ROWS
        for start in range(0, end, _ROWS):
            some = np.ascontiguousarray(rows[start : min(end, start + _ROWS)].T)
            np.add.at(total, owner[start : min(end, start + _ROWS)], model.pooled(some).T)
        waiting[:], owners[:] = [rows[end:]], [owner[end:]]

    held = 0
    for i, text in enumerate(texts):
        if not text or not _LETTER.search(text):
            continue
        data = raw(text)
        letters[i] = np.count_nonzero(_IS_LETTER[data])
        rows = cut(data)
        for start in range(0, len(rows), _SLICE // CORE):
            piece = rows[start : start + _SLICE // CORE]
            waiting.append(piece)
            owners.append(np.full(len(piece), i))
            held += len(piece)
            if held >= 4 * _ROWS:
                settle(False)
                held = len(waiting[0])
    if waiting:
        settle(True)
    for i in np.flatnonzero(letters):
        best = int(total[i].argmax())
        names[i], scores[i] = model.languages[best], min(1.0, total[i, best] / letters[i])
    return names, scores


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def excerpts(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(excerpt, starts, lang): at most ``per_language`` excerpts of each language outside the held-out fold.

    A document offers ``PER_DOCUMENT`` stretches at places given by hashes; which of them are taken is
    decided by hashes too.  Documents are counted by language first (one number per language, as the
    network has), so the scan lets only about twice the wanted number of stretches through.
    """
    lang = F.col("lang")
    rows = docs.select("doc_id", "text", "lang").filter((fold(F.col("doc_id")) != HELD_OUT) & lang.isNotNull())
    shares = [(r["lang"], 2 * per_language / (PER_DOCUMENT * r["count"])) for r in rows.groupBy("lang").count().collect()]
    few = docs.sparkSession.createDataFrame([(name, max(share, 2.0**-20)) for name, share in shares], "lang string, share double")
    places = F.explode(F.array(*[F.lit(i) for i in range(PER_DOCUMENT)])).alias("nth")
    many = rows.filter(F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("doc_id", "text").alias("key"), places)
    many = many.select("text", "lang", F.xxhash64("key", "nth").alias("key")).join(F.broadcast(few), "lang")
    # rank of a stretch in [0, 1), then where it starts
    many = many.withColumn("draw", F.pmod("key", F.lit(1 << 20)) / F.lit(float(1 << 20))).filter(F.col("draw") < F.col("share"))
    start = F.pmod(F.shiftrightunsigned("key", 20), F.greatest(F.length("text") - (STEPS - 1), F.lit(1))) + 1
    taken = many.withColumn("start", start.cast("int")).select(
        "lang", "key", "draw", (F.col("start") == 1).alias("starts"), F.expr(f"substring(text, start, {STEPS})").alias("excerpt"))
    order = W.partitionBy("lang").orderBy("draw", "key", "excerpt")
    return taken.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language).select("excerpt", "starts", "lang")


def train(docs: DataFrame, per_language: int = SAMPLE) -> Model | None:
    """The network for these documents, fitted on the bounded sample; None without a labelled text."""
    rows = excerpts(docs, per_language).toPandas().sort_values(["lang", "excerpt"])
    return fit(list(rows[["excerpt", "starts", "lang"]].itertuples(index=False, name=None)))


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def label_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; score is the mean probability of the language.

    A null text, one without letters, and every text when there is no model, is ``und`` with score 0.
    Equal probabilities go to the first language in order.  Repeated rows are labelled each, ids come
    back as they are, other columns are ignored, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                names, scores = predict(model, some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, _SCHEMA)

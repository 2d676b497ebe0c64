"""Toxicity scores: a bidirectional gated recurrent network over words and their characters, with attention."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import bounded_sample, freed, mix64, random_words, ready, text_buffer, text_pieces, word_hashes

# Windows of WINDOW words, each beginning STRIDE words after the one before: passages of up to
# WINDOW - STRIDE + 1 words are whole in one, wherever they stand. Training looks at fewer windows.
WINDOW, STRIDE, TRAIN_STRIDE = 48, 12, 40
# Inputs of a word: an embedding by its hash and the mean of those of its character n-grams.
WORD_BUCKETS, GRAM_BUCKETS, WIDTH = 1 << 15, 1 << 15, 12
HIDDEN = 10
# Labelled documents per class that the network is trained on, chosen by a hash of the id.
SAMPLE = 4000
EPOCHS, BATCH, RATE = 6, 128, 0.01
# Windows that are scored at a time, and distinct words whose gate inputs are kept for all of them.
CHUNK, GATE_WORDS = 2048, 1 << 17
PIECE_BYTES = 1 << 20

# Bytes that belong to no word: all of ASCII that is neither letter nor digit.
_GAP = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_GRAM_BYTE = random_words(29, 256)


@dataclass
class Words:
    """The distinct words of some texts and where they stand."""

    hashes: np.ndarray  # hash of each distinct word
    bucket: np.ndarray  # its word bucket
    grams: np.ndarray   # n-gram buckets of all distinct words in a row
    begin: np.ndarray   # where those of each distinct word begin
    token: np.ndarray   # distinct word at each place of all texts in a row
    first: np.ndarray   # places before each text


def read_words(texts: pa.Array) -> Words:
    """Cut texts into words (runs of letters and digits, A-Z lowered) and these into byte n-grams.

    The n-grams of a word are its four bytes from each place on, fewer at its
    end; those at its beginning are marked.
    """
    data, offsets = text_buffer(texts)
    hashes, first, starts, ends = word_hashes(data, offsets, _GAP, spans=True)
    distinct, index, token = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = (ends - starts)[index]
    begin = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts[index] - begin, sizes)
    stop = np.repeat(ends[index], sizes)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    with np.errstate(over="ignore"):
        code = np.zeros(len(at), np.uint64)
        for k in range(4):
            there = at + k < stop
            code[there] += _GRAM_BYTE[low[at[there] + k]] * np.uint64(2 * k + 1)
        code[begin] += np.uint64(0x51ED270B0A1F39C1)
        grams = (mix64(code) % np.uint64(GRAM_BUCKETS)).astype(np.int32)
    return Words(distinct, (distinct % np.uint64(WORD_BUCKETS)).astype(np.int32), grams, begin, token.astype(np.int32), first)


def read_all(texts: pa.Array) -> Words:
    """As ``read_words``, piece by piece, which takes less memory."""
    parts = [read_words(piece) for piece in text_pieces(texts, PIECE_BYTES)]
    hashes = np.concatenate([p.hashes for p in parts])
    sizes = np.concatenate([np.diff(np.append(p.begin, len(p.grams))) for p in parts])
    grams = np.concatenate([p.grams for p in parts])
    distinct, index, place = np.unique(hashes, return_index=True, return_inverse=True)
    before = np.cumsum([0] + [len(p.hashes) for p in parts])
    token = np.concatenate([place[b + p.token] for b, p in zip(before, parts)]).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])
    source, kept = (np.cumsum(sizes) - sizes)[index], sizes[index]
    begin = np.cumsum(kept) - kept
    chosen = np.arange(kept.sum()) + np.repeat(source - begin, kept)
    return Words(distinct, (distinct % np.uint64(WORD_BUCKETS)).astype(np.int32), grams[chosen], begin, token, first)


def windows(first: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of texts: the text, first place and length of each. A text without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + -(-np.maximum(n - WINDOW, 0) // stride), 0)
    owner = np.repeat(np.arange(len(n)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][owner] + step * stride
    return owner, begin, np.minimum(WINDOW, first[1:][owner] - begin)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Embeddings, two gated recurrent layers of opposite direction, attention pooling, one logit per window."""

    def __init__(self, seed: int = 7):
        self.rng = rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.word = np.zeros((WORD_BUCKETS, WIDTH), np.float32)
        self.gram = np.zeros((GRAM_BUCKETS, WIDTH), np.float32)
        # Gates in the order update, reset, candidate; forward layer first.
        self.weights = {
            "input": draw(WIDTH, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32),
            "ahead": draw(HIDDEN, 3 * HIDDEN), "back": draw(HIDDEN, 3 * HIDDEN),
            "attend": draw(2 * HIDDEN, 1)[:, 0], "out": draw(2 * HIDDEN, 1)[:, 0], "shift": np.zeros(1, np.float32),
        }

    def inputs(self, words: Words) -> np.ndarray:
        """Input of each distinct word: its own embedding plus the mean of those of its n-grams."""
        if not len(words.bucket):
            return np.zeros((0, WIDTH), np.float32)
        ends = np.append(words.begin[1:], len(words.grams))
        out = np.empty((len(words.bucket), WIDTH), np.float32)
        for low in range(0, len(out), 32_768):
            begin, end = words.begin[low:low + 32_768], ends[low:low + 32_768]
            grams = self.gram[words.grams[begin[0]:end[-1]]]
            out[low:low + len(begin)] = self.word[words.bucket[low:low + len(begin)]] + np.add.reduceat(grams, begin - begin[0]) / (end - begin)[:, None]
        return out

    def _layer(self, gates: np.ndarray, mask: np.ndarray | None, own: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states over the second axis of ``gates``."""
        n, length, _ = gates.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.empty((length, n, HIDDEN), np.float32)
        for t in range(length):
            inner, outer = h @ own, gates[:, t]
            both = _sigmoid(outer[:, :2 * HIDDEN] + inner[:, :2 * HIDDEN])
            update, reset = both[:, :HIDDEN], both[:, HIDDEN:]
            fresh = np.tanh(outer[:, 2 * HIDDEN:] + reset * inner[:, 2 * HIDDEN:])
            if keep is not None:
                keep.append((h, update, reset, fresh, inner[:, 2 * HIDDEN:]))
            h_next = fresh + update * (h - fresh)
            h = h_next if mask is None else np.where(mask[:, t, None], h_next, h)
            out[t] = h
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from the gate inputs of their words; ``mask`` marks the places that hold words."""
        w = self.weights
        ahead_state, back_state = ([], []) if keep is not None else (None, None)
        ahead = self._layer(gates[:, :, :3 * HIDDEN], mask, w["ahead"], ahead_state)
        reverse = None if mask is None else mask[:, ::-1]
        back = self._layer(gates[:, ::-1, 3 * HIDDEN:], reverse, w["back"], back_state)[::-1]
        states = np.concatenate([ahead, back], axis=2)
        weight = states @ w["attend"]
        if mask is not None:
            weight = np.where(mask.T, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"ahead": ahead_state, "back": back_state, "states": states, "weight": weight, "pooled": pooled}
        return pooled @ w["out"] + w["shift"][0]

    def score(self, words: Words, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every overlapping window, and the window that scores highest for each text (-1: none)."""
        owner, begin, length = windows(words.first, stride)
        into = lambda x: x @ self.weights["input"] + self.weights["bias"]
        inputs = self.inputs(words)
        gates = into(inputs) if len(inputs) <= GATE_WORDS else None
        found = np.zeros(len(owner), np.float32)
        order = np.argsort(-length, kind="stable")
        places = np.arange(WINDOW)
        for low in range(0, len(order), CHUNK):
            some = order[low:low + CHUNK]
            inside = places[None, :int(length[some].max())] < length[some][:, None]
            token = words.token[np.where(inside, begin[some][:, None] + places[None, :inside.shape[1]], begin[some][:, None])]
            if gates is None:
                used, place = np.unique(token, return_inverse=True)
                chunk = into(inputs[used])[place.reshape(token.shape)]
            else:
                chunk = gates[token]
            found[some] = self.forward(chunk, None if inside.all() else inside)
        found = _sigmoid(found)
        best = np.full(len(words.first) - 1, -1)
        ranked = np.argsort(found, kind="stable")
        best[owner[ranked]] = ranked
        return found, best

    def _layer_grad(self, kept: list, mask: np.ndarray, own: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by gate inputs and recurrent weights, from those by the states."""
        length = len(kept)
        n = mask.shape[0]
        by_gate, by_own, later = np.zeros((n, length, 3 * HIDDEN), np.float32), np.zeros_like(own), np.zeros((n, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1):
            h, update, reset, fresh, inner = kept[t]
            total = above[t] + later
            live = np.where(mask[:, t, None], total, 0)
            by_fresh = live * (1 - update) * (1 - fresh * fresh)
            by_update = live * (h - fresh) * update * (1 - update)
            by_reset = by_fresh * inner * reset * (1 - reset)
            outer = np.concatenate([by_update, by_reset, by_fresh], axis=1)
            recurrent = np.concatenate([by_update, by_reset, by_fresh * reset], axis=1)
            by_gate[:, t] = outer
            by_own += h.T @ recurrent
            later = live * update + recurrent @ own.T + (total - live)
        return by_gate, by_own

    def step(self, words: Words, token: np.ndarray, mask: np.ndarray, target: np.ndarray, memory: dict) -> float:
        """One step of adaptive gradient descent over a batch of windows."""
        w = self.weights
        used, place = np.unique(token, return_inverse=True)
        place = place.reshape(token.shape)
        sizes = np.diff(np.append(words.begin, len(words.grams)))[used]
        grams = words.grams[np.concatenate([np.arange(words.begin[u], words.begin[u] + s) for u, s in zip(used, sizes)])]
        group = np.repeat(np.arange(len(used)), sizes)
        # Half of the words are known by their characters alone, so that unseen forms of a stem score too.
        spoken = 2.0 * (self.rng.random((len(used), 1)) < 0.5).astype(np.float32)
        x = spoken * self.word[words.bucket[used]] + np.add.reduceat(self.gram[grams], np.cumsum(sizes) - sizes) / sizes[:, None]
        keep: dict = {}
        logit = self.forward((x @ w["input"] + w["bias"])[place], mask, keep)
        chance = _sigmoid(logit)
        by_logit = ((chance - target) / len(target)).astype(np.float32)
        by_pooled = by_logit[:, None] * w["out"]
        states, weight = keep["states"], keep["weight"]
        value = np.einsum("nh,tnh->tn", by_pooled, states)
        by_weight = weight * (value - (weight * value).sum(axis=0))
        by_states = weight[:, :, None] * by_pooled + by_weight[:, :, None] * w["attend"]
        ahead, own_ahead = self._layer_grad(keep["ahead"], mask, w["ahead"], by_states[:, :, :HIDDEN])
        back, own_back = self._layer_grad(keep["back"], mask[:, ::-1], w["back"], by_states[::-1, :, HIDDEN:])
        by_gates = np.zeros((len(used), 6 * HIDDEN), np.float32)
        np.add.at(by_gates, place, np.concatenate([ahead, back[:, ::-1]], axis=2))
        by_x = by_gates @ w["input"].T
        self._move(memory, {
            "input": x.T @ by_gates, "bias": by_gates.sum(axis=0), "ahead": own_ahead, "back": own_back,
            "attend": np.einsum("tn,tnh->h", by_weight, states), "out": keep["pooled"].T @ by_logit,
            "shift": by_logit.sum(keepdims=True)})
        self._move_rows(memory, "word", self.word, words.bucket[used], spoken * by_x)
        self._move_rows(memory, "gram", self.gram, grams, (by_x / sizes[:, None])[group])
        chance = np.clip(chance, 1e-6, 1 - 1e-6)
        return float(-(target * np.log(chance) + (1 - target) * np.log(1 - chance)).mean())

    def _move(self, memory: dict, gradients: dict) -> None:
        for name, g in gradients.items():
            m, v, t = memory.get(name, (0.0, 0.0, 0))
            m, v, t = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, t + 1
            memory[name] = (m, v, t)
            self.weights[name] -= (RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)

    @staticmethod
    def _move_rows(memory: dict, name: str, table: np.ndarray, rows: np.ndarray, gradients: np.ndarray) -> None:
        """Only rows that took part move, by their own accumulated squares."""
        distinct, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(distinct), table.shape[1]), np.float32)
        np.add.at(total, place, gradients)
        squares = memory.setdefault(name, np.zeros_like(table))
        squares[distinct] += total * total
        table[distinct] -= 10 * RATE * total / (np.sqrt(squares[distinct]) + 1e-6)


def train(texts: list[str] | pa.Array, labels: np.ndarray, seed: int = 7) -> Network:
    """Fit a network to labelled texts.

    A label speaks for its text, not for each window. First all windows of short
    texts teach; then, epoch by epoch, the window of every text that scores
    highest, and one more at random of the texts with label 0. With one label
    only, or none, the network stays at a constant score.
    """
    net, rng, memory = Network(seed), np.random.default_rng(seed), {}
    labels = np.asarray(labels, np.float32)
    if not len(texts) or not 0 < labels.sum() < len(labels):
        net.weights["out"][:] = 0
        net.weights["shift"][0] = 4.0 if len(texts) and labels.all() else -4.0
        return net
    words = read_all(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    owner, begin, length = windows(words.first, TRAIN_STRIDE)
    count = np.bincount(owner, minlength=len(texts))
    places = np.arange(WINDOW)
    # Classes weigh alike: the rarer one's windows are repeated.
    for epoch in range(EPOCHS + 2):
        if epoch < 2:
            rank = np.argsort(count[owner], kind="stable")
            short = count[owner] <= max(2, int(np.sort(count[labels > 0])[int(labels.sum()) // 4]))
            chosen = rank[short[rank]]
        else:
            _, best = net.score(words, TRAIN_STRIDE)
            some = rng.permutation(len(owner))
            extra = np.full(len(texts), -1)
            extra[owner[some]] = some
            chosen = np.concatenate([best[best >= 0], extra[(extra >= 0) & (labels == 0)]])
        positive = chosen[labels[owner[chosen]] > 0]
        negative = chosen[labels[owner[chosen]] == 0]
        if len(positive) and len(negative):
            if len(positive) < len(negative) // 2:
                positive = np.resize(positive, len(negative) // 2)
            chosen = np.concatenate([positive, negative])
        chosen = rng.permutation(chosen)
        size = min(BATCH, max(16, len(chosen) // 40))
        for low in range(0, len(chosen), size):
            batch = chosen[low:low + size]
            mask = places[None, :int(length[batch].max())] < length[batch][:, None]
            token = words.token[np.where(mask, begin[batch][:, None] + places[None, :mask.shape[1]], begin[batch][:, None])]
            net.step(words, token, mask, labels[owner[batch]], memory)
    return net


_LABELLED = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("toxic", pa.int32())])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch[f.name].cast(f.type) for f in _LABELLED], schema=_LABELLED)


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(_labelled(batches)), _LABELLED).sort_by([("doc_id", "ascending"), ("text", "ascending"), ("toxic", "ascending")])
    network = train(rows["text"].combine_chunks(), np.asarray(rows["toxic"]))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], names=["network"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on about ``sample`` documents of each label (texts that are null teach nothing).

    The sample is bounded; one task trains on it and sends the network.
    """
    ready(docs.sparkSession)
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(marked, sample, "toxic")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    trained = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).mapInArrow(freed(_train_task), "network binary")
    found = trained.collect()
    return pickle.loads(found[0]["network"]) if found else train([], np.zeros(0))


def score_toxicity(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``: the highest probability among all overlapping windows of the whole text.

    A text that is null or has no word scores 0. An own column of this name is
    replaced.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for piece in text_pieces(batch, PIECE_BYTES):
                found, best = shared.value.score(read_words(piece))
                out.append(np.where(best >= 0, found[best] if len(found) else 0.0, 0.0))
            yield pa.array(np.concatenate(out).astype(np.float64) if out else np.zeros(0))

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kept = [c for c in docs.columns if c != "toxicity"]
    return docs.select(*kept, F.arrow_udf(freed(judge), "double")(F.col(text)).alias("toxicity"))

"""Gated recurrent language model with a class-factored softmax, in numpy.

Vocabulary, counts, classes and biases come from every training document.  Frequent
words have learned in-class weights; all other words fall into classes by their
ending and have their smoothed share of the class.  The recurrent weights are trained
with truncated backpropagation on every training document: each task runs over its
part from common weights, and the results are averaged level by level.  Scoring
carries the state across windows, so a document is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.scratch import Scratch, most_frequent

END = b"\n"
HIDDEN = 12
CLASS_SIZE = 32
HEAD_CLASSES = 24
TAIL_CLASSES = 8
HEAD = CLASS_SIZE * HEAD_CLASSES
CLASSES = HEAD_CLASSES + TAIL_CLASSES
WINDOW = 32
KEPT_WORDS = 1 << 16
BLOCK = 1024
SLICE_BYTES, POOL_BYTES = 1 << 18, 16 << 20
#: Hash that stands for the end of a document.
END_KEY = np.uint64(1)
#: Lanes side by side in training, documents in scoring.
TRAIN_WIDTH, SCORE_WIDTH = 384, 1024
#: Weights that are averaged together.
FAN_IN = 32


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_CLASSES


@lru_cache(maxsize=1)
def _endings() -> tuple[np.ndarray, np.ndarray]:
    """ending() of every single byte and of every pair of bytes."""
    return np.array([ending(bytes([b])) for b in range(256)]), np.array([ending(bytes([a, b])) for a in range(256) for b in range(256)])


@dataclass
class Tokens:
    """Tokens of some documents, an end after each; an end has no bytes."""

    owner: np.ndarray
    key: np.ndarray  # 64-bit hash of the lower-case word
    tail: np.ndarray  # class of its ending
    start: np.ndarray
    end: np.ndarray
    sizes: np.ndarray  # tokens of each document
    data: np.ndarray  # lower-case bytes

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes() or END


def tokens_of(part: W.Slice) -> Tokens:
    found = W.words(part, lower=True)
    data = W.LOWER[part.data]
    n = np.bincount(found.row, minlength=part.rows)
    sizes = n + 1
    ends = np.cumsum(sizes) - 1
    place = np.arange(len(found.row)) + found.row
    total = len(found.row) + part.rows
    key, tail, start, end = np.full(total, END_KEY), np.full(total, ending(END)), np.zeros(total, np.int64), np.zeros(total, np.int64)
    one, two = _endings()
    last = data[found.end - 1].astype(np.int64)
    before = data[np.maximum(found.end - 2, 0)].astype(np.int64)
    key[place], start[place], end[place] = found.key, found.start, found.end
    tail[place] = np.where(found.end - found.start > 1, two[before * 256 + last], one[last])
    owner = np.repeat(np.arange(part.rows), sizes)
    assert not len(ends) or ends[-1] == total - 1
    return Tokens(owner, key, tail, start, end, sizes, data)


@dataclass
class Lexicon:
    """The most frequent words with counts, and totals of all of them."""

    key: np.ndarray  # sorted hashes of KEPT_WORDS words at most
    count: np.ndarray
    ids: np.ndarray
    tokens: int
    distinct: int
    tail_total: np.ndarray  # tokens + words + 1 of each class of endings
    class_bias: np.ndarray
    word_bias: np.ndarray

    def look_up(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Places in the kept list (-1 for others) and ids."""
        if not len(self.key):
            return np.full(len(tokens.key), -1), HEAD + tokens.tail
        at = np.minimum(np.searchsorted(self.key, tokens.key), len(self.key) - 1)
        hit = self.key[at] == tokens.key
        return np.where(hit, at, -1), np.where(hit, self.ids[at], HEAD + tokens.tail)


@dataclass
class Weights:
    """Parameters of fixed size."""

    inputs: np.ndarray
    recurrent: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray
    squares: list[np.ndarray] = field(default_factory=list, repr=False)

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def pack(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype("<f4").tobytes()

    @classmethod
    def shapes(cls) -> list[tuple[int, ...]]:
        return [(HEAD + TAIL_CLASSES, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, CLASSES), (CLASSES,), (HEAD_CLASSES, CLASS_SIZE, HIDDEN), (HEAD_CLASSES, CLASS_SIZE)]

    @classmethod
    def unpack(cls, raw: bytes) -> Weights:
        flat, at, out = np.frombuffer(raw, "<f4").copy(), 0, []
        for shape in cls.shapes():
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return cls(*out)

    @classmethod
    def initial(cls, lexicon: Lexicon, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        draw = lambda shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        s = cls.shapes()
        return cls(draw(s[0], 0.3), draw(s[1], 0.25), draw(s[2], 0.05), lexicon.class_bias.astype(np.float32), draw(s[4], 0.05), lexicon.word_bias.astype(np.float32))


def _step(w: Weights, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The next state, and what going back needs.  exp() alone: it is vectorised for float32 and overflows to the right limits."""
    x, u = w.inputs.take(ids, axis=0), h @ w.recurrent
    gates = x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
    np.negative(gates, out=gates)
    with np.errstate(over="ignore"):
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, c = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
        n = r * c
        n += x[:, 2 * HIDDEN :]
        n *= -2
        np.exp(n, out=n)
    n += 1
    np.divide(2, n, out=n)
    n -= 1
    out = h - n
    out *= z
    out += n
    return out, (h, z, r, n, c)


def _by_class(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    sort = np.argsort(classes, kind="stable")
    cuts = np.searchsorted(classes[sort], np.arange(HEAD_CLASSES + 1))
    for c in range(HEAD_CLASSES):
        if cuts[c + 1] > cuts[c]:
            yield c, sort[cuts[c] : cuts[c + 1]]


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // CLASS_SIZE, ids - HEAD + HEAD_CLASSES)


def _blocks(n: int) -> Iterator[slice]:
    """Runs of rows whose scores stay in the cache; larger arrays cost several times as much."""
    return (slice(at, min(at + BLOCK, n)) for at in range(0, n, BLOCK))


def _exp_scores(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of each row's scores, their sums, and the score of the chosen column; scores are far below where float32 overflows."""
    x = states @ weights
    x += bias
    own = x[np.arange(len(x)), chosen]
    np.exp(np.minimum(x, 80, out=x), out=x)
    return x, x.sum(1), own


def log_probabilities(w: Weights, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log of P(class), and of P(word | class) where the word is a frequent one."""
    kind, out = class_of(ids), np.empty(len(ids), np.float32)
    for at in _blocks(len(ids)):
        _, total, own = _exp_scores(states[at], w.to_class, w.class_bias, kind[at])
        out[at] = own - np.log(total)
    for c, at in _by_class(kind):
        _, total, own = _exp_scores(states[at], w.to_word[c].T, w.word_bias[c], ids[at] % CLASS_SIZE)
        out[at] += own - np.log(total)
    return out


def _descend(w: Weights, k: int, gradient: np.ndarray, rate: float) -> None:
    """Adagrad step on one array."""
    target, square = w.arrays()[k], w.squares[k]
    square += gradient**2
    target -= rate * gradient / np.sqrt(square + 1e-8)


def train_window(w: Weights, h: np.ndarray, ids: np.ndarray, live: np.ndarray, rate: float, fresh: np.ndarray | None = None) -> np.ndarray:
    """One update from a window of tokens (time, lane); returns the state after it.

    `fresh` marks first tokens of documents, in front of which the state is zero.
    """
    steps, docs = ids.shape
    states, tape = np.empty((steps, docs, HIDDEN), np.float32), []
    for t in range(steps):
        if fresh is not None and fresh[t].any():
            h = np.where(fresh[t][:, None], np.float32(0), h)
        states[t] = h
        h, saved = _step(w, h, ids[t])
        tape.append(saved)
    flat, own = states.reshape(-1, HIDDEN), live.ravel().astype(np.float32) / max(1, live.sum())
    target, kind = ids.ravel(), class_of(ids.ravel())
    d_states = np.empty_like(flat)
    g_class, g_class_bias = np.zeros_like(w.to_class), np.zeros_like(w.class_bias)
    for at in _blocks(len(flat)):
        d, total, _ = _exp_scores(flat[at], w.to_class, w.class_bias, kind[at])
        d *= (own[at] / total)[:, None]
        d[np.arange(len(d)), kind[at]] -= own[at]
        np.matmul(d, w.to_class.T, out=d_states[at])
        g_class += flat[at].T @ d
        g_class_bias += d.sum(0)
    g_word, g_bias = np.zeros_like(w.to_word), np.zeros_like(w.word_bias)
    for c, at in _by_class(kind):
        inside, states_c = target[at] % CLASS_SIZE, flat[at]
        d, total, _ = _exp_scores(states_c, w.to_word[c].T, w.word_bias[c], inside)
        d *= (own[at] / total)[:, None]
        d[np.arange(len(d)), inside] -= own[at]
        d_states[at] += d @ w.to_word[c]
        g_word[c], g_bias[c] = d.T @ states_c, d.sum(0)
    d_states = d_states.reshape(states.shape)
    d_inputs, g_recurrent = np.empty((steps, docs, 3 * HIDDEN), np.float32), np.zeros_like(w.recurrent)
    dh = np.zeros((docs, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, n, u = tape[t]
        keep, d = dh * z, d_inputs[t]
        dh -= keep
        dn = n * n
        np.subtract(1, dn, out=dn)
        dn *= dh
        d[:, 2 * HIDDEN :] = dn
        # d of the two gates, each times gate * (1 - gate)
        np.multiply(dh, before - n, out=d[:, :HIDDEN])
        d[:, :HIDDEN] *= z
        np.multiply(dn, u, out=d[:, HIDDEN : 2 * HIDDEN])
        side = 1 - r
        side *= r
        d[:, HIDDEN : 2 * HIDDEN] *= side
        du = d.copy()
        du[:, 2 * HIDDEN :] *= r
        g_recurrent += before.T @ du
        dh = du @ w.recurrent.T
        dh += keep
        dh += d_states[t]
        if fresh is not None and fresh[t].any():
            dh[fresh[t]] = 0
    cells = (target[:, None] * (3 * HIDDEN) + np.arange(3 * HIDDEN)).ravel()
    g_inputs = np.bincount(cells, d_inputs.ravel(), w.inputs.size).astype(np.float32).reshape(w.inputs.shape)
    _descend(w, 0, g_inputs, rate)
    for k, g in ((1, g_recurrent), (2, g_class), (3, g_class_bias), (4, g_word), (5, g_bias)):
        _descend(w, k, g, rate)
    return h


def windows(flat: np.ndarray, sizes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of groups of documents of like length, in order within a group.

    Gives document numbers, ids (time, document), which of them are tokens, and
    whether the group starts; documents that have ended drop out.
    """
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    for g in range(0, len(order), width):
        own = order[g : g + width]
        for at in range(0, int(sizes[own[0]]), WINDOW):
            live = own[sizes[own] > at]
            time = at + np.arange(min(WINDOW, int(sizes[live[0]]) - at))[:, None]
            mask = time < sizes[live]
            yield live, np.where(mask, flat[np.minimum(begin[live] + time, len(flat) - 1)], 0), mask, np.bool_(at == 0)


def train_part(raw: bytes, parts: Iterator[W.Slice], lexicon: Lexicon, rate: float) -> bytes:
    """Train on some documents: one stream of their tokens, cut into lanes that run side by side."""
    w = Weights.unpack(raw)
    w.squares = [np.full_like(a, 1e-6) for a in w.arrays()]
    flat, first = [], []
    for part in parts:
        tokens = tokens_of(part)
        flat.append(lexicon.look_up(tokens)[1])
        mark = np.zeros(len(tokens.key), bool)
        mark[np.cumsum(tokens.sizes) - tokens.sizes] = True
        first.append(mark)
    ids, fresh = np.concatenate(flat), np.concatenate(first)
    lanes = max(1, min(TRAIN_WIDTH, len(ids) // WINDOW))
    length = -(-len(ids) // lanes)
    grid = lambda x: np.concatenate([x, np.zeros(lanes * length - len(x), x.dtype)]).reshape(lanes, length).T
    ids, fresh, live = grid(ids), grid(fresh), grid(np.ones(len(ids), bool))
    h = np.zeros((lanes, HIDDEN), np.float32)
    for at in range(0, length, WINDOW):
        own = slice(at, at + WINDOW)
        h = train_window(w, h, ids[own], live[own], rate, fresh[own])
    return w.pack()


def score_parts(w: Weights, lexicon: Lexicon, parts: Iterator[W.Slice]) -> tuple[np.ndarray, ...]:
    """For each document: tokens, known tokens, base and model log10 sums; and (document, hash, count) of rare words.

    A rare word is one outside the kept list: what its count adds is left open.
    """
    log_count, log_tail = np.log10(lexicon.count + 1.0), np.log10(lexicon.tail_total)
    log_n = np.log10(lexicon.tokens + lexicon.distinct + 1)
    flat, sizes, n_known, base, extra, rare = [], [], [], [], [], []
    rows = 0
    for part in parts:
        tokens = tokens_of(part)
        places, ids = lexicon.look_up(tokens)
        known, tail = places >= 0, ids >= HEAD
        add = lambda at, values=None: np.bincount(tokens.owner[at], values, part.rows)  # noqa: B023, E731
        logs = log_count[places[known]] if len(log_count) else np.zeros(0)
        base.append(add(known, logs) - tokens.sizes * log_n)
        both = tail & known
        extra.append(add(both, log_count[places[both]] if len(log_count) else np.zeros(0)) - add(tail, log_tail[ids[tail] - HEAD]))
        n_known.append(add(known).astype(np.int64))
        sizes.append(tokens.sizes)
        flat.append(ids.astype(np.int32))
        pair = np.zeros(int((~known).sum()), [("row", np.int64), ("key", np.uint64)])
        pair["row"], pair["key"] = rows + tokens.owner[~known], tokens.key[~known]
        pair, times = np.unique(pair, return_counts=True)
        rare.append((pair["row"], pair["key"], times))
        rows += part.rows
    all_ids, n = np.concatenate(flat), np.concatenate(sizes)
    total = np.zeros(rows)
    h = np.zeros((0, HIDDEN), np.float32)
    for live, ids, mask, start in windows(all_ids, n, SCORE_WIDTH):
        h = np.zeros((len(live), HIDDEN), np.float32) if start else h[: len(live)]
        states = np.empty((*ids.shape, HIDDEN), np.float32)
        for t in range(len(ids)):
            states[t] = h
            h, _ = _step(w, h, ids[t])
        some = mask.ravel()
        values = np.zeros(len(some))
        values[some] = log_probabilities(w, states.reshape(-1, HIDDEN)[some], ids.ravel()[some])
        total[live] += values.reshape(ids.shape).sum(0)
    return n, np.concatenate(n_known), np.concatenate(base), total / np.log(10) + np.concatenate(extra), *(np.concatenate(x) for x in zip(*rare, strict=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, c): a row for each distinct word of a part of the input of bounded variety."""
    keys, counts, names = [], [], []

    def merge() -> None:
        key, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        counts[:] = [np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)]
        names[:] = [np.concatenate(names)[first]]
        keys[:] = [key]

    def out() -> pa.RecordBatch:
        merge()
        batch = pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(names[0], pa.binary()), pa.array(counts[0])], names=["key", "word", "c"])
        keys.clear(), counts.clear(), names.clear()
        return batch

    for batch in batches:
        for part in W.slices(batch["text"]):
            tokens = tokens_of(part)
            key, first, c = np.unique(tokens.key, return_index=True, return_counts=True)
            own = np.empty(len(key), object)
            own[:] = [tokens.word(k) for k in first.tolist()]
            keys.append(key), counts.append(c), names.append(own)
            if sum(map(len, keys)) > 600_000:
                merge()
                if len(keys[0]) > 300_000:
                    yield out()
    if keys:
        yield out()


def read_lexicon(counts: DataFrame) -> Lexicon:
    """The kept part of a table of counts (word, c), and the totals of all of it."""
    tail = F.crc32(F.substring("word", -2, 2)) % TAIL_CLASSES
    # KEPT_WORDS rows at most come to the driver, in whatever number of parts they lie.
    top = most_frequent(counts, "c", KEPT_WORDS).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, c = [bytes(x) for x in top["word"]], top["c"].to_numpy(np.int64)
    ids = np.array([i if i < HEAD else HEAD + ending(x) for i, x in enumerate(words)], np.int64)
    totals = counts.groupBy(tail.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()  # TAIL_CLASSES rows
    mass, kinds = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    mass[totals["k"]], kinds[totals["k"]] = totals["c"], totals["v"]
    tokens, distinct = int(mass.sum()), int(kinds.sum())
    for x, n in zip(words[:HEAD], c[:HEAD], strict=True):
        mass[ending(x)] -= n
        kinds[ending(x)] -= 1
    head = np.zeros(HEAD)
    head[: len(c[:HEAD])] = c[:HEAD]
    head = head.reshape(HEAD_CLASSES, CLASS_SIZE)
    share = np.concatenate([head.sum(1), mass + 1]) + 0.01
    word_bias = np.log(head + 0.01) - np.log((head + 0.01).sum(1, keepdims=True))
    key = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return Lexicon(key[order], c[order], ids[order], tokens, distinct, mass + kinds + 1, np.log(share / share.sum()), word_bias)


def _average(key: tuple, table: pa.Table) -> pa.Table:
    weight = table["weight"].to_numpy().astype(float)
    packed = np.array([np.frombuffer(x, "<f4") for x in table["packed"].to_pylist()])
    mean = (packed * (weight / weight.sum())[:, None]).sum(0).astype("<f4").tobytes()
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weight": pa.array([int(weight.sum())], pa.int64()), "packed": pa.array([mean], pa.binary())})


def pools(column: pa.Array) -> Iterator[list[W.Slice]]:
    """Groups of slices of about POOL_BYTES, or of one text."""
    group, size = [], 0
    for part in W.slices(column, SLICE_BYTES):
        if group and size + len(part.data) > POOL_BYTES:
            yield group
            group, size = [], 0
        group.append(part)
        size += len(part.data)
    if group:
        yield group


def fit(train: DataFrame, lexicon: Lexicon, *, rounds: int = 2, part_bytes: int = 8 << 20, rate: float = 0.1, seed: int = 11) -> Weights:
    """Train on `train` (text, turn): every document once, in `rounds` averaged rounds.

    A task learns from about part_bytes of text.  Without documents the weights stay
    as drawn; null and empty texts teach their end alone.
    """
    spark = train.sparkSession
    weights = Weights.initial(lexicon, seed)
    shared = spark.sparkContext.broadcast(lexicon)
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size // (rounds * part_bytes))
    for r in range(rounds):
        raw = spark.sparkContext.broadcast(weights.pack())

        def run(batches: Iterator[pa.RecordBatch], raw=raw) -> Iterator[pa.RecordBatch]:
            now, size = raw.value, 0
            for batch in batches:
                for group in pools(batch["text"]):
                    now = train_part(now, iter(group), shared.value, rate)
                    size += sum(len(x.data) + x.rows for x in group)
            if size:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([size], pa.int64()), pa.array([now], pa.binary())], names=["part", "weight", "packed"])

        done = train.where(F.col("turn") == r).select("text").repartition(parts).mapInArrow(W.give_back(run), "part int, weight long, packed binary")
        width = parts
        while True:  # no task takes the weights of more than FAN_IN others
            done = done.groupBy(F.expr(f"part div {FAN_IN}").cast("int").alias("group")).applyInArrow(_average, "part int, weight long, packed binary")
            width = -(-width // FAN_IN)
            if width == 1:
                break
        found = done.collect()  # one row of the size of the weights
        if found:
            weights = Weights.unpack(bytes(found[0]["packed"]))
    return weights


def score_documents(docs: DataFrame, learn: DataFrame) -> tuple[DataFrame, Lexicon]:
    """Base and model log10 probabilities of every row of `docs` (doc_id, text).

    Words are counted over all rows of `learn`, and the recurrent weights see each of
    them in one round.  Returns doc_id, n_tokens, n_known, base_score and score.  Null
    texts are empty: their only token is the end.  Texts of any length are scored
    whole, repeated rows each; an empty `docs` gives no rows, and after an empty
    `learn` every word is unknown.  Columns other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    counts = learn.select("text").mapInArrow(_count, "key long, word binary, c long").groupBy("key", "word").agg(F.sum("c").alias("c"))
    counts = scratch.save(counts, "counts")
    lexicon = read_lexicon(counts)
    mark = F.xxhash64(F.lit(3), "doc_id", "text")
    weights = fit(learn.select("text", F.pmod(mark, F.lit(2)).alias("turn")), lexicon)
    shared = spark.sparkContext.broadcast((weights.pack(), lexicon))
    kind = pa.struct([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = shared.value
        w = Weights.unpack(raw)
        for batch in batches:
            at = 0
            for group in pools(batch["text"]):
                *columns, row, key, times = score_parts(w, own, iter(group))
                part = batch.slice(at, len(columns[0]))
                at += len(columns[0])
                cut = pa.array(np.searchsorted(row, np.arange(len(columns[0]) + 1)).astype(np.int32))
                rare = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(times)], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([part["row"], part["doc_id"], *map(pa.array, columns), rare], names=["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    partial = scratch.save(rows.mapInArrow(W.give_back(run), f"row long, doc_id {id_kind}, n_tokens long, n_known long, base double, model double, rare array<struct<key:long,n:long>>"), "partial")
    # A word is known by 64 bits here.
    rare = partial.select("row", F.explode("rare").alias("x")).select("row", "x.key", "x.n")
    more = rare.join(counts.select("key", "c"), "key").groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    out = partial.drop("rare").join(more, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score")), lexicon

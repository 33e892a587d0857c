"""Language-model scores from Brown's class-based n-grams.

P(w | previous) = P(class of w | class of previous) * P(w | class of w).  Exchange clustering moves one word at a time
to the class that raises the training text's likelihood most, until a round moves nothing.  Transitions are
smoothed towards class frequencies, emissions by ``ADD`` counts and one unseen word.

Every counted word has an exchange class.  The ``CLUSTERED`` most frequent words are exchanged until nothing moves; each
later word is then placed where its exchange gain against these fixed classes is highest (ties: the lower class).  Its
neighbours count by their classes there, later words among them as one class of their own.  Transitions are counted anew
over all words' classes.  A word that training texts don't have counts 0 in the class with the most words seen once.

Scale.  Words are 64-bit hashes.  Counts, the neighbours' classes of later words and their own classes are aggregated over
all training texts and stay distributed.  At most ``HEAD`` words, by count, are sent to every task with their classes
(17 bytes each), all others meet theirs in a join: which way a word takes changes no figure.  A token is then one byte, its
class.  The driver collects bigrams of the exchanged words, at most (CLUSTERED + 2)**2, and of classes.

Definitions.  Texts are split into words outside ASCII white space, A-Z lower-cased, and one end token follows; a null or
empty text has only this.  A text is held out where crc32 of its doc_id as text is divisible by 10 (null id: the
empty text, hence held out).  Repeated rows count as often as they occur.  Without training texts all counts are 0.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .store import small_batches, stored

ADD = 0.1
HEAD = 1 << 17
CLUSTERED = 1024
CLASSES = 48
PRIOR = 2.0
REST, SELF = CLASSES, CLASSES + 1  # as neighbours: a later word, and the word itself; END comes after them
LAST = CLASSES  # END's class
OPEN = 255  # a class to be looked up
END = np.uint64(0xE0D0C0B0A0908071)


def _tokens(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every token in order; each row ends with END."""
    block = block.lowered()
    row, start, end = block.words()
    stop = np.searchsorted(row, np.arange(block.n), side="right")
    h = np.insert(block.hash(start, end), stop, END)
    return np.insert(row, stop, np.arange(block.n)), h


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(keys, return_inverse=True)
    return keys, np.bincount(where, counts, len(keys)).astype(np.int64)


class _Tally:
    """Counts by 64-bit key, in arrays; handed over when they grow large."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> bool:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.size += len(k)
        if self.size <= self.most:
            return False
        self.parts = [_tally(*map(np.concatenate, zip(*self.parts)))]
        self.size = len(self.parts[0][0])
        return self.size > self.most // 2

    def take(self) -> pa.RecordBatch:
        k, n = _tally(*map(np.concatenate, zip(*self.parts))) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n, pa.int64())], names=["k", "n"])


def _counted(texts: DataFrame, keys_of) -> DataFrame:
    """(k, n): how often each key occurs that ``keys_of`` names for a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                if tally.add(keys_of(block)):
                    yield tally.take()
        yield tally.take()

    return small_batches(texts).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, movable: int, classes: int, fixed: np.ndarray) -> np.ndarray:
    """Classes of units: units below ``movable`` are exchanged among ``classes``; the others keep classes of their own.

    ``bigrams[u, v]``: how often v follows u.  The likelihood is, up to a constant, the sum of N log N over class
    bigrams less that over class counts, before and after.  It ends when a round moves nothing.
    """
    total = int(fixed.max(initial=classes - 1)) + 1
    own = np.concatenate([np.arange(movable) % classes, fixed]).astype(np.int64)
    one_hot = np.eye(total)[own]
    after, before = bigrams @ one_hot, bigrams.T @ one_hot  # unit x class: following, preceding
    n = one_hot.T @ after
    h = _nlogn
    least = 1e-9 + 1e-13 * float(h(n.sum()))  # what rounding can feign
    moved = 1
    while moved:
        moved = 0
        for w in range(movable):
            a, self_n = own[w], bigrams[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= self_n
            left[a] -= self_n
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= self_n
            rows, cols, out, into = n[:classes], n[:, :classes].T, n.sum(axis=1) + left, n.sum(axis=0) + right  # sums that hold w as a neighbour, wherever it goes
            gain = (h(rows + right) - h(rows)).sum(axis=1) + (h(cols + left) - h(cols)).sum(axis=1)
            k = np.arange(classes)
            cell = n[k, k]
            gain += h(cell + right[:classes] + left[:classes] + self_n) - h(cell + right[:classes]) - h(cell + left[:classes]) + h(cell)
            wo, wi = right.sum() + self_n, left.sum() + self_n
            gain -= h(out[:classes] + wo) - h(out[:classes]) + h(into[:classes] + wi) - h(into[:classes])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            n[b] += right
            n[:, b] += left
            n[b, b] += self_n
            if b != a:
                own[w] = b
                moved += 1
                for table, by in ((after, bigrams[:, w]), (before, bigrams[w])):
                    table[:, a] -= by
                    table[:, b] += by
    return own


def _nlogn(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0.5, x * np.log(np.maximum(x, 1.0)), 0.0)


def place(n: np.ndarray, left: np.ndarray, right: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """The class with the highest exchange gain for each word, which leaves REST for it.

    ``n``: class bigrams, REST and END's class behind the others; ``left`` and ``right``: words x classes, how often a
    class precedes and follows the word; ``itself``: how often the word follows itself.
    """
    h, k = _nlogn, np.arange(CLASSES)
    out, into, cell = n.sum(axis=1)[:CLASSES], n.sum(axis=0)[:CLASSES], n[k, k]
    gain = h(cell + right[:, :CLASSES] + left[:, :CLASSES] + itself[:, None]) - h(cell + right[:, :CLASSES]) - h(cell + left[:, :CLASSES]) + h(cell)
    for side, other, cells in ((right, left, n[:CLASSES]), (left, right, n[:, :CLASSES].T)):
        w, c = np.nonzero(side)
        have = cells[:, c].T - np.where(c == REST, 1.0, 0.0)[:, None] * other[w, :CLASSES]
        more = h(have + side[w, c][:, None]) - h(have)
        first = np.searchsorted(w, np.arange(len(side)))
        total = np.concatenate([np.zeros((1, CLASSES)), np.cumsum(more, axis=0)])
        gain += total[np.append(first[1:], len(w))] - total[first]
    wo, wi = right.sum(axis=1) + itself, left.sum(axis=1) + itself
    gain -= h(out + wo[:, None]) - h(out) + h(into + wi[:, None]) - h(into)
    return np.argmax(np.round(gain, 6), axis=1)


@dataclass
class Model:
    """All arrays are of bounded size; ``word`` is sorted."""

    word: np.ndarray
    count: np.ndarray
    cls: np.ndarray  # of head words
    step: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 P(word | class) of head words
    tail: int  # the class of unseen words
    tail_scale: float  # log10 of what their emission is divided by
    scale: np.ndarray  # the same for all classes
    tokens: int
    types: int


def counts(docs: DataFrame) -> DataFrame:
    """(k, n): every training token's hash with its count."""
    return _counted(_with_split(docs).filter("NOT held_out").select("text"), lambda block: _tokens(block)[1])


def _with_split(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", "text", (F.crc32(F.encode(key, "UTF-8")) % 10 == 0).alias("held_out"))


def _find(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the sorted ``words``, -1 for what isn't there."""
    if not len(words):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, -1)


def _before(x: np.ndarray, first: int) -> np.ndarray:
    """What stands before each token; END stands before every text, as it ends the one before."""
    return np.concatenate([[first], x[:-1]]).astype(x.dtype)


def _sorted_words(rows) -> tuple[np.ndarray, np.ndarray]:
    word, count = rows["k"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(word)
    return word[order], count[order]


def placed(docs: DataFrame, tally: DataFrame) -> DataFrame:
    """(k, n, cls): every training word with its count and class."""
    texts = _with_split(docs).filter("NOT held_out").select("text")
    word, count = _sorted_words(tally.filter(F.col("k") != int(END.view(np.int64))).orderBy(F.desc("n"), "k").limit(CLUSTERED).toPandas())
    rest, end, n_units = CLUSTERED, CLUSTERED + 1, CLUSTERED + 2
    known = docs.sparkSession.sparkContext.broadcast(word)

    def pairs(block: tb.Block) -> np.ndarray:
        _, h = _tokens(block)
        at = _find(known.value, h)
        u = np.where(h == END, end, np.where(at >= 0, at, rest))
        return (_before(u, end) * n_units + u).astype(np.uint64)

    bigrams = np.zeros((n_units, n_units))
    seen = _counted(texts, pairs).toPandas()  # at most n_units ** 2 rows
    bigrams.reshape(-1)[seen["k"].to_numpy(np.int64)] = seen["n"].to_numpy(np.float64)
    own = exchange(bigrams, CLUSTERED, CLASSES, CLASSES + np.arange(2))
    one_hot = np.eye(CLASSES + 2)[own]
    n = one_hot.T @ bigrams @ one_hot
    context = docs.sparkSession.sparkContext.broadcast((word, own[: len(word)]))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = context.value
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                _, h = _tokens(block)
                at = _find(words, h)
                c = np.where(h == END, SELF + 1, np.where(at >= 0, np.append(classes, REST)[at], REST))
                same = h == _before(h, END)
                left = np.where(same, SELF, _before(c, SELF + 1))
                right = np.append(np.where(same, SELF, c)[1:], SELF + 1)
                later = (at < 0) & (h != END)
                h, code = h[later], (left * 64 + right)[later]
                order = np.lexsort((code, h))
                h, code = h[order], code[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (code[1:] != code[:-1]))) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(code[new], pa.int32()), pa.array(np.diff(np.append(new, len(h))), pa.int64())], names=["k", "code", "n"])

    table = docs.sparkSession.sparkContext.broadcast(n)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width, once = table.value, SELF + 2, None
        keep = [*range(CLASSES), REST, SELF + 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            if once is None:  # words seen once differ by their neighbours only
                a, b = np.divmod(np.arange(width * width), width)
                once = place(n, np.eye(width)[a][:, keep], np.eye(width)[b][:, keep], np.zeros(len(a)))
            pairs = batch.column(1)
            w = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            code, m = (pairs.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
            total = np.bincount(w, m, batch.num_rows).astype(np.int64)
            cls = np.zeros(batch.num_rows, np.int64)
            single = total[w] == 1
            cls[w[single]] = once[code[single] // 64 * width + code[single] % 64]
            many = np.flatnonzero(total > 1)
            for i in range(0, len(many), 500):
                few = many[i : i + 500]
                row = np.full(batch.num_rows, -1)
                row[few] = np.arange(len(few))
                mine = row[w] >= 0
                side = [np.bincount(row[w[mine]] * width + x[mine], m[mine], len(few) * width).reshape(-1, width) for x in (code // 64, code % 64)]
                cls[few] = place(n, side[0][:, keep], side[1][:, keep], side[1][:, SELF])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(cls, pa.int32())], names=["k", "n", "cls"])

    later = small_batches(texts).mapInArrow(around, "k bigint, code int, n bigint").groupBy("k", "code").agg(F.sum("n").alias("n"))
    later = later.groupBy("k").agg(F.collect_list(F.struct("code", "n")).alias("around")).mapInArrow(choose, "k bigint, n bigint, cls int")
    fixed = [(int(k), int(c), int(u)) for k, c, u in zip(word.view(np.int64), count, own)]
    ended = tally.filter(F.col("k") == int(END.view(np.int64))).select("k", "n", F.lit(LAST).alias("cls"))
    return stored(later.unionByName(docs.sparkSession.createDataFrame(fixed, "k bigint, n bigint, cls int")).unionByName(ended), "word-classes")


def classed(docs: DataFrame, words: DataFrame, word: np.ndarray, count: np.ndarray, cls: np.ndarray, tail: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, cls) per row: the sum of log10(count + ADD), and a byte, its class, for each token.

    ``word``, ``count`` and ``cls`` are those of ``words`` that need no join.
    """
    context = docs.sparkSession.sparkContext.broadcast((word, count, cls))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (word, count, cls), done = context.value, 0
        logs = np.append(np.log10(count + ADD), np.log10(ADD))
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                row, h = _tokens(block)
                at = _find(word, h)
                inside, local = at >= 0, (at >= 0) | (h == END)
                own = np.where(h == END, LAST, np.where(inside, np.append(cls, OPEN)[at], OPEN)).astype(np.uint8)
                by_row = lambda x: np.bincount(row, x, block.n)
                start = np.searchsorted(row, np.arange(block.n + 1)).astype(np.int32)
                out = np.flatnonzero(~local)
                cut = np.searchsorted(row[out], np.arange(block.n + 1)).astype(np.int32)
                key = (TaskContext.get().partitionId() << 40) + done + np.arange(block.n)
                done += block.n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.int64()),
                        *(c.slice(block.first, block.n) for c in (batch.column(0), batch.column(2))),
                        pa.array(np.diff(start), pa.int64()),
                        pa.array(by_row(inside), pa.float64()).cast(pa.int64()),
                        pa.array(by_row(np.where(local, logs[at], 0.0))),
                        pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer(start), pa.py_buffer(own)]),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array((out - start[row[out]]).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(h[out].view(np.int64))),
                    ],
                    names=["key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "cls", "at", "others"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, cls binary, at array<int>, others array<bigint>"
    rows = stored(small_batches(_with_split(docs).select("doc_id", "text", "held_out")).mapInArrow(look, schema), "looked-up")
    others = rows.select("key", F.explode(F.arrays_zip("at", "others")).alias("o")).select("key", "o.at", F.col("o.others").alias("k")).join(words, "k", "left")
    n = F.coalesce("n", F.lit(0))
    others = others.groupBy(F.col("key").alias("other")).agg(
        F.sum(F.log10(n + ADD)).alias("more"), F.count_if(n > 0).alias("more_known"), F.collect_list(F.col("at").cast("long") * 256 + F.coalesce("cls", F.lit(tail))).alias("fill")
    )
    rows = rows.drop("at", "others").join(others, F.col("key") == F.col("other"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("logs") + F.coalesce("more", F.lit(0.0))).alias("logs"),
        "cls", F.coalesce("fill", F.array().cast("array<bigint>")).alias("fill"),
    )

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, start = _bytes(batch.column(5))
                fill = batch.column(6)
                value = fill.flatten().to_numpy()
                own[np.repeat(start[:-1], fill.value_lengths().to_numpy()) + (value >> 8)] = value & 255
                column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], column], names=batch.schema.names[:6])

    return stored(rows.mapInArrow(filled, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, cls binary"), "classed")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each row begins and the last ends)."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).copy(), np.cumsum([0, *map(len, rows)])


def prepared(docs: DataFrame, tally: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts that aren't held out, and the classes of all; ``tally`` is what ``counts`` gave."""
    words = placed(docs, tally)
    bits = F.floor(F.log2("n") + 1e-12).cast("int")
    bands = {r["b"]: (r["types"], r["tokens"]) for r in words.groupBy(bits.alias("b")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect()}  # 64 rows at most
    tokens, types = sum(t for _, t in bands.values()), sum(t for t, _ in bands.values())
    least, room = 63, HEAD
    while least > 0 and room >= bands.get(least, (0, 0))[0]:
        room -= bands.get(least, (0, 0))[0]
        least -= 1
    head = words.filter(F.col("n") >= 1 << least + 1).toPandas()  # at most HEAD rows, all with a count of 2 or more
    word, count, cls = head["k"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), head["cls"].to_numpy(np.int64)
    order = np.argsort(word)
    word, count, cls = word[order], count[order], cls[order]

    per_class, types_in, once = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("n") == 1).alias("once")).collect():  # a row for each class
        per_class[r["cls"]], types_in[r["cls"]], once[r["cls"]] = r["n"], r["types"], r["once"]
    tail = int(np.argmax(once[:CLASSES]))
    types_in[tail] += 1
    scale = np.log10(per_class + ADD * np.maximum(types_in, 1))
    rows = classed(docs, words, word, count, cls, tail)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            own = _bytes(batch.column(0))[0].astype(np.int64)
            n += np.bincount(_before(own, LAST) * 256 + own, minlength=1 << 16) if len(own) else 0
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["at", "n"])

    n = np.zeros((CLASSES + 1, CLASSES + 1))
    for r in rows.filter("NOT held_out").select("cls").mapInArrow(steps, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        n[divmod(r["at"], 256)] = r["n"]
    share = (n.sum(axis=0) + ADD) / (n.sum() + ADD * len(n))
    step = np.log10((n + PRIOR * share) / (n.sum(axis=1, keepdims=True) + PRIOR))
    emit = np.log10(count + ADD) - scale[cls]
    return Model(word, count, cls, step, emit, tail, float(scale[tail]), scale, int(tokens), int(types)), rows


def train(docs: DataFrame, tally: DataFrame) -> Model:
    """The model of the texts that aren't held out; ``tally`` is what ``counts`` gave."""
    return prepared(docs, tally)[0]


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; scores are log10 probabilities.

    ``base_score`` is the unigram's with ``ADD`` counts; ``score`` the class model's.
    """
    docs = docs.select("doc_id", "text")
    model, rows = prepared(docs, stored(counts(docs), "word-counts"))
    base_scale = float(np.log10(model.tokens + ADD * (model.types + 1)))
    gain = model.step - model.scale[None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, start = _bytes(batch.column(5))
                by_row = np.add.reduceat(gain[_before(own, LAST), own], start[:-1])  # END is in every row
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(batch.column(4).to_numpy() + by_row)], names=[*batch.schema.names[:5], "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"
    return rows.mapInArrow(run, schema).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * base_scale).alias("base_score"), "score"
    )

"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.llm.common import cut, in_worker

#: Runs between white space, and words, whose ids a worker keeps.
KEEP_RUNS, KEEP_WORDS = 600_000, 300_000
#: Characters of texts that are tokenized together.
BLOCK = 1_000_000
#: Rows of partition offsets up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Any character but those that lower-casing and composition treat one by one, and white space
#: that all libraries agree on.
_UNUSUAL = re.compile("[^\t-\r\x20-~¡-ÖØ-įı-ſ‐-‧]")
#: Fixed value: what the word tokenizer splits text into, said for lower-case text without unusual
#: characters.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
_WORDS = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

#: The sign that stands for each byte in a byte-level vocabulary: itself if it can be printed, else
#: the next one from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class _Memo(dict):
    """Remembers what ``learn`` says of a string."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        out = self[key] = self.learn(key)
        return out


class WordTokenizer:
    """Ids of texts under a word-level BPE tokenizer file, remembering those of words.

    White space parts words, so what stands between is looked up as a whole first, then its words.
    Texts with characters outside a plain range, or with the string of a special token, go through
    the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        #: Ids take two bytes where the vocabulary allows it.
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        code, tokenize = "H" if self.dtype.itemsize == 2 else "I", self.full.model.tokenize

        def word(w: str) -> bytes:
            # A plain word is lower-case, composed and split already: its bytes go to the model as they are.
            spelled = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_SIGNS)
            return array(code, [t.id for t in tokenize(spelled)]).tobytes()

        self.words = _Memo(word)
        known, split = self.words.__getitem__, _WORDS.findall
        self.runs = _Memo(lambda run: b"".join(map(known, split(run))))

    def forget(self) -> None:
        self.runs.clear()
        self.words.clear()

    def _plain(self, text: str) -> bool:
        return _UNUSUAL.search(text) is None and not any(s in text for s in self.special)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as ``dtype``; null and empty texts have none."""
        known = self.runs.__getitem__
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self._plain(text):
                out.append(b"".join(map(known, text.lower().split())))
            else:
                out.append(np.array(self.full.encode(text, add_special_tokens=False).ids, self.dtype).tobytes())
            if len(self.runs) > KEEP_RUNS:
                self.runs.clear()
            if len(self.words) > KEEP_WORDS:
                self.words.clear()
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _forget() -> None:
    for tok in _TOKENIZERS.values():
        tok.forget()


def _leave() -> None:
    _TOKENIZERS.clear()


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int = 1, max_queues: int = 1000, apart: Sequence[str] = ()) -> DataFrame:
    """(doc_id, queue, part, before, n, ids) of every row: its ids and its place in its queue.

    ``part`` is the partition and ``before`` the ids that the partition's earlier rows put into the
    same queue. ids are little-endian, in 2 bytes where the vocabulary allows it, else in 4.
    More than ``max_queues`` sources are hashed into as many queues, but for those of ``apart``.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"),
        F.col("text"),
    )
    names = source.select("queue").distinct().limit(max_queues + 1).count()
    if names > max_queues:
        hashed = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(max_queues)).cast("string"))
        source = source.withColumn("queue", F.when(F.col("queue").isin(list(apart)), F.col("queue")).otherwise(hashed))

    def run(batches):
        tok = _tokenizer(tokenizer_file)
        size = tok.dtype.itemsize
        end = np.array([end_id], tok.dtype).tobytes()
        part = TaskContext.get().partitionId()
        used: dict[str, int] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= BLOCK):
                    held += len(texts[hi] or "")
                    hi += 1
                piece = batch.slice(lo, hi - lo)
                data = [ids + end for ids in tok.encode(texts[lo:hi])]
                texts[lo:hi] = [None] * (hi - lo)
                sizes = [len(d) // size for d in data]
                before = []
                for q, n in zip(piece.column("queue").to_pylist(), sizes):
                    at = used.get(q, 0)
                    before.append(at)
                    used[q] = at + n
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("queue"),
                        pa.array([part] * piece.num_rows, pa.int64()),
                        pa.array(before, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(data, pa.binary()),
                    ],
                    ["doc_id", "queue", "part", "before", "n", "ids"],
                )
                lo = hi

    worker = in_worker("packing", run, _forget, _leave)
    return source.mapInArrow(worker, "doc_id long, queue string, part long, before long, n long, ids binary")


class Schedule:
    """Where each queue's ids stand in the interleaved stream, in closed form.

    Queues send quanta of ``quantum`` ids in proportion to ``weights``, by default to their lengths.
    After v rounds a queue of weight w is entitled to v * w quanta; what it has not sent of them is
    its deficit, which is carried on. Quantum j is sent when the deficit reaches a half, at
    v = (j + 1/2) / w, of several queues the first in order; so at any place of the stream each
    queue that has ids left is within one quantum of its share, wherever windows or partitions end.
    A queue that is empty leaves its turns to the others, in proportion. The place of a quantum is
    the sum of what all queues have sent before, which any task works out for itself.

    Weights count to 24 bits, so that all of this is done in whole numbers.
    """

    def __init__(self, totals: Sequence[int], quantum: int, weights: Sequence[float] | None = None) -> None:
        self.totals = list(totals)
        self.quantum = quantum
        self.counts = [-(-t // quantum) for t in self.totals]
        self.total = sum(self.totals)
        if weights is None:
            shift = max(0, max(self.counts, default=0).bit_length() - 24)
            self.weights = [max(1, c >> shift) for c in self.counts]
        else:
            if any(not w > 0 for w in weights):
                raise ValueError("weights must be positive")
            top = max(weights, default=1)
            self.weights = [max(1, round(w / top * (1 << 24))) for w in weights]

    def sent(self, other: int, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many quanta of ``other`` come before quanta ``j`` of queues ``queue``."""
        k = np.array(self.weights, np.int64)[queue]
        # Quanta i of the other queue with (2i + 1) / its weight before (2j + 1) / k.
        scaled = (2 * j + 1) * self.weights[other] - k
        sent = np.where(other < queue, scaled // (2 * k) + 1, -((-scaled) // (2 * k)))
        return np.clip(sent, 0, self.counts[other])

    def place(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The stream positions at which quanta ``j`` of ``queue`` start: one pass over the queues for all."""
        queue, j = np.asarray(queue, np.int64), np.asarray(j, np.int64)
        out = np.zeros(len(j), np.int64)
        for other, tokens in enumerate(self.totals):
            out += np.minimum(self.sent(other, queue, j) * self.quantum, tokens)
        return out


def _weights(totals: dict[str, int], targets: dict[str, float] | None) -> list[float] | None:
    """A weight for each queue: its target, or its part of what the targets leave."""
    if targets is None:
        return None
    rest = max(1 - sum(targets.values()), 0.001)
    other = sum(t for q, t in totals.items() if q not in targets)
    return [targets.get(q, rest * t / max(other, 1)) for q, t in totals.items()]


def _tail_cuts(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences that hold what no full window does: powers of two."""
    at, out = total - total % window, []
    for bit in range(window.bit_length(), -1, -1):
        if (total - at) >> bit & 1 and (total - at) >= 1 << bit:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    window: int = 2048,
    quantum: int = 256,
    end_id: int = 1,
    max_queues: int = 1000,
    targets: dict[str, float] | None = None,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset, queue) of packed sequences.

    Every row of ``docs`` (doc_id, text, source) becomes its tokens and ``end_id``; null and empty
    texts are ``end_id`` alone. A source is a queue, a null source the one without a name (""); more
    than ``max_queues`` sources are hashed into as many queues. Queues take turns by ``Schedule``,
    and the stream is cut every ``window`` ids, so every window holds the target proportions to
    within a quantum a queue. ``targets`` are the sources' proportions; without it they are those of
    the corpus, so that all sources end together. Sources that ``targets`` does not name share what
    it leaves of 1 in proportion to their tokens (at least a thousandth). Nothing is left out: what a
    source has beyond its target comes after the sources that end first. What is left at the end is
    cut into sequences of powers of two, so that no sequence is padded. ``ids`` is binary,
    little-endian unsigned 32-bit. Repeated rows are packed as often as they come; a null doc_id
    stays null. No rows give none.

    Ids are written to the checkpoint folder once, and shuffled only if the partitions' offsets, a row
    for each partition and queue, are more than BROADCAST_ROWS.
    """
    tokens = cut(tokenize(docs, tokenizer_file, end_id, max_queues, list(targets or ())))
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.withColumn("base", F.coalesce(F.sum("m").over(earlier), F.lit(0))))
    totals = {r.queue: r.m for r in offsets.groupBy("queue").agg(F.sum("m").alias("m")).collect()}
    queues = sorted(totals)
    plan = Schedule([totals[q] for q in queues], quantum, _weights({q: totals[q] for q in queues}, targets))
    number = {q: i for i, q in enumerate(queues)}
    tails = _tail_cuts(plan.total, window)
    first_tail = plan.total - plan.total % window
    bounds = np.array([at for at, _ in tails], np.int64)

    def run(batches):
        for batch in batches:
            lo = 0
            sizes = batch.column("n").to_pylist()
            while lo < len(sizes):
                hi, held = lo, 0
                while hi < len(sizes) and (hi == lo or held + sizes[hi] <= 1 << 22):
                    held += sizes[hi]
                    hi += 1
                yield pieces(batch.slice(lo, hi - lo))
                lo = hi

    def pieces(batch):
        a, n = (batch.column(c).to_numpy() for c in ("at", "n"))
        queue = np.array([number[q] for q in batch.column("queue").to_pylist()])
        size = sum(map(len, raw := batch.column("ids").to_pylist())) // max(1, int(n.sum()))
        ids = np.frombuffer(b"".join(raw), f"<u{size or 2}").astype("<u4")
        # The quanta that each document has a part of.
        first = a // quantum
        count = (a + n - 1) // quantum - first + 1
        doc = np.repeat(np.arange(len(n)), count)
        j = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
        starts = np.maximum(j * quantum, a[doc])
        ends = np.minimum((j + 1) * quantum, (a + n)[doc])
        place = starts - j * quantum + plan.place(queue[doc], j)
        doc, s, e, g = _cut_at(doc, starts, ends, place, window, first_tail, bounds)
        if len(bounds):
            tail = g >= first_tail
            which = np.maximum(np.searchsorted(bounds, g, "right") - 1, 0)
            seq = np.where(tail, first_tail // window + which, g // window)
            start_of = np.where(tail, bounds[which], g - g % window)
        else:
            seq, start_of = g // window, g - g % window
        # Pieces in order of document and start hold the ids in the order they came in.
        offsets = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32) * 4
        data = pa.py_buffer(ids.tobytes())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(doc)),
                pa.array(s - a[doc]),
                pa.array(e - s),
                pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), data]),
                pa.array(n[doc]),
                pa.array(seq),
                pa.array(g - start_of),
                batch.column("queue").take(pa.array(doc)),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "queue"],
        )

    small = offsets.select("queue", "part", "base")
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    placed = tokens.join(small, ["queue", "part"]).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids"
    )
    return placed.mapInArrow(
        in_worker("packing", run),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string",
    )


def _cut_at(doc, starts, ends, place, window, first_tail, bounds):
    """Split intervals at window boundaries, and in the tail at ``bounds``; by document and start."""
    while True:
        nxt = (place // window + 1) * window
        if len(bounds):
            at = np.searchsorted(bounds, place, "right")
            after = np.where(at < len(bounds), bounds[np.minimum(at, len(bounds) - 1)], np.iinfo(np.int64).max)
            nxt = np.where(place >= first_tail, after, nxt)
        over = place + (ends - starts) > nxt
        if not over.any():
            order = np.lexsort((starts, doc))
            return doc[order], starts[order], ends[order], place[order]
        middle = starts + (nxt - place)
        doc, starts, ends, place = (
            np.concatenate([doc, doc[over]]),
            np.concatenate([starts, middle[over]]),
            np.concatenate([np.where(over, middle, ends), ends[over]]),
            np.concatenate([place, nxt[over]]),
        )

"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import in_worker

SPACE = "▁"
#: Stands for a space mark of the text itself; no valid text holds a lone surrogate.
_LITERAL = "\udfff"
#: Segments whose ids a worker keeps, and the longest one it does.
KEEP, KEEP_LENGTH = 500_000, 48
#: Pairs of pieces that a worker keeps from task to task.
KEEP_PAIRS = 200_000
#: Characters of texts that are encoded together.
BLOCK = 2_000_000
#: A character that no piece covers costs this much more than the worst piece.
UNKNOWN_MARGIN = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Scored pieces and the ids of the 256 byte pieces of a SentencePiece model.

    ``merge_type`` tells whether its scores rank merges (BPE) or are log probabilities (unigram).
    """

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    merge_type: bool = True

    @staticmethod
    def load(model_file: str, merge_type: bool = True) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [
            i
            for i in range(sp.vocab_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if len({*byte_ids}) != 256:
            raise ValueError("the model has no byte fallback")
        return Vocabulary(
            tuple(sp.id_to_piece(i) for i in plain),
            tuple(plain),
            tuple(sp.get_score(i) for i in plain),
            tuple(byte_ids),
            merge_type,
        )


class Merges:
    """Which pieces may follow each other when the best-scoring adjacent pair always merges first.

    A sequence of pieces is the merge result of its text exactly if every two neighbours are the
    merge result of theirs, so every prefix of a text has one last piece, and the search below can
    keep one backpointer for each boundary.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.memo: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge a short text from single characters, the leftmost of equal scores first."""
        parts = list(text)
        get = self.scores.get
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        known = self.memo.get((a, b))
        if known is None:
            if len(self.memo) > KEEP_PAIRS:
                self.memo.clear()
            known = self.memo[(a, b)] = self.merged(a + b) == [a, b]
        return known


class StreamingViterbi:
    """Segments a stream of characters, handing on pieces as soon as they are certain.

    Boundaries of the last ``longest`` characters are extended, since no piece reaches further back,
    each with the backpointer of its surviving path. Whenever the surviving paths of all boundaries
    that can still be extended go through one boundary, what lies before it is committed and
    forgotten. A merge-type model keeps the path whose neighbours all follow each other; a
    unigram-type model the one with the highest sum of scores, of equal ones the one whose last
    piece starts first.
    """

    def __init__(
        self, scores: dict[str, float], tails: set[str], longest: int, merges: Merges | None, unknown: float, every: int = 64
    ) -> None:
        self.scores, self.tails, self.longest = scores, tails, longest
        self.merges, self.unknown, self.every = merges, unknown, every
        self.widest = 0
        self._start()

    def _start(self) -> None:
        self.text = ""
        self.total = [0.0]
        self.last = [""]

    def feed(self, chars: str) -> list[str]:
        """Take more characters; return the pieces that are certain now."""
        out: list[str] = []
        for lo in range(0, len(chars), self.every):
            self._extend(chars[lo : lo + self.every])
            out += self._commit(self._meeting())
        return out

    def finish(self) -> list[str]:
        """The pieces of what is left, after which no piece goes on."""
        return self._commit(len(self.text))

    def between(self, chars: str) -> list[str]:
        """The pieces of a run between two boundaries that no piece goes over.

        All surviving paths meet in its end, so its pieces are certain. What a short run's window
        holds is kept until the next run, and serves for the part of that which begins alike.
        """
        if len(chars) > self.every:
            self._start()
            return self.feed(chars) + self.finish()
        text, n = self.text, min(len(self.text), len(chars))
        same = 0
        while same < n and text[same] == chars[same]:
            same += 1
        del self.total[same + 1 :], self.last[same + 1 :]
        self.text = text[:same]
        self._extend(chars[same:])
        return self._path(len(chars))

    def _extend(self, chars: str) -> None:
        text = self.text = self.text + chars
        self.widest = max(self.widest, len(text))
        scores, tails, last, total = self.scores, self.tails, self.last, self.total
        merges, unknown = self.merges, self.unknown
        known = merges.memo if merges is not None else {}
        for end in range(len(last), len(text) + 1):
            start = end - 1
            piece = chosen = text[start]
            best = -np.inf
            while True:
                if piece in scores or start == end - 1:
                    before = last[start]
                    if merges is None:
                        through = total[start] + scores.get(piece, unknown)
                        if through >= best:
                            best, chosen = through, piece
                    elif not before:
                        chosen = piece
                        break
                    else:
                        ok = known.get((before, piece))
                        if ok if ok is not None else merges.follows(before, piece):
                            chosen = piece
                            break
                start -= 1
                if start < 0:
                    break
                piece = text[start:end]
                if piece not in tails:
                    break
            total.append(best)
            last.append(chosen)

    def _meeting(self) -> int:
        """The last boundary that every path still open goes through."""
        end = len(self.text)
        front = set(range(max(0, end - self.longest + 1), end + 1))
        while len(front) > 1:
            last = max(front)
            front.remove(last)
            front.add(last - len(self.last[last]))
        return front.pop()

    def _path(self, boundary: int) -> list[str]:
        pieces = []
        while boundary:
            pieces.append(self.last[boundary])
            boundary -= len(pieces[-1])
        return pieces[::-1]

    def _commit(self, boundary: int) -> list[str]:
        pieces = self._path(boundary)
        if boundary:
            base = self.total[boundary]
            self.text = self.text[boundary:]
            self.total = [s - base for s in self.total[boundary:]] if self.merges is None else self.total[boundary:]
            self.last = self.last[boundary:]
        return pieces


class Codec:
    """Encodes text to ids and back. Encoding and decoding are exact inverses on any text.

    Texts go through a ``StreamingViterbi`` segment by segment; the ids of a short segment are
    remembered, so that it is searched once however often it occurs.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        byte_ids = vocab.byte_ids
        self.scores = dict(zip(vocab.pieces, vocab.scores))
        self.merges = Merges(self.scores) if vocab.merge_type else None
        self.longest = max(map(len, vocab.pieces))
        self.tails = {p[i:] for p in vocab.pieces for i in range(len(p))}
        self.unknown = min(vocab.scores) - UNKNOWN_MARGIN
        self.search = self.viterbi()
        #: The ids of every piece, packed; of other characters, as they come, those of their bytes.
        self.packed = {p: array("i", [i]).tobytes() for p, i in zip(vocab.pieces, vocab.ids)}
        self.byte_ids = [array("i", [i]).tobytes() for i in byte_ids]
        # Where no piece crosses, all paths meet: before a space mark after another character, and
        # at either side of a line break. A vocabulary without that property is never cut ahead.
        crosses = any(("\n" in p and len(p) > 1) or regex.search(f"[^{SPACE}]{SPACE}", p) for p in vocab.pieces)
        self.cut = None if crosses else regex.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")
        self.joined = {p[i : i + 2] for p in vocab.pieces for i in range(len(p) - 1)}
        self.memo: dict[str, bytes] = {}
        self.run_memo: dict[str, bytes] = {}
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, i in zip(vocab.pieces, vocab.ids)} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    def forget(self) -> None:
        self.memo.clear()
        self.run_memo.clear()

    def viterbi(self) -> StreamingViterbi:
        return StreamingViterbi(self.scores, self.tails, self.longest, self.merges, self.unknown)

    def _bytes(self, char: str) -> bytes:
        return b"".join([self.byte_ids[b] for b in (SPACE if char == _LITERAL else char).encode()])

    def _ids(self, pieces: Iterable[str]) -> bytes:
        packed = self.packed
        return b"".join([packed[p] if p in packed else self._bytes(p) for p in pieces])

    def _runs(self, segment: str) -> list[str]:
        """A segment's runs between characters that no piece joins."""
        joined = self.joined
        cuts = [i for i, (a, b) in enumerate(zip(segment, segment[1:]), 1) if a + b not in joined]
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)])] if cuts else [segment]

    def _learn(self, segments: Sequence[str]) -> None:
        split = [self._runs(s if s[:1] == "\n" else SPACE + s) for s in segments]
        known, between, ids = self.run_memo, self.search.between, self._ids
        # In order, so that runs that begin alike follow each other.
        for run in sorted(set().union(*split).difference(known)):
            known[run] = ids(between(run))
        get = known.__getitem__
        self.memo.update(zip(segments, [get(r[0]) if len(r) == 1 else b"".join(map(get, r)) for r in split]))

    def _split(self, text: str | None) -> list[str]:
        """The segments of a text, each without the one space mark that opens it.

        A segment starts with a line break, or else had a space mark in front.
        """
        if not text:
            return []
        if self.cut is not None and text[0] != " " and "  " not in text and SPACE not in text:
            if "\n" not in text:
                return text.split(" ")
            if " \n" not in text:
                return text.replace("\n", " \n").split(" ")
        marked = SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        parts = [marked] if self.cut is None else self.cut.findall(marked)
        return [p if p[0] == "\n" else p[1:] for p in parts]

    def encode_all(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text: a space mark goes in front and stands for every space.

        Characters that are no piece, and a space mark in the text itself, become UTF-8 bytes. Null
        and empty texts have no ids.
        """
        split = list(map(self._split, texts))
        memo = self.memo
        if len(memo) > KEEP:
            memo.clear()
            self.run_memo.clear()
        fresh = list(set().union(*split).difference(memo))
        if fresh:
            self._learn(fresh)
        known = memo.__getitem__
        out = [np.frombuffer(b"".join(map(known, s)), "<i4") for s in split]
        if any(len(s) > KEEP_LENGTH for s in fresh):
            for held in (memo, self.run_memo):
                for s in [s for s in held if len(s) > KEEP_LENGTH]:
                    del held[s]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        """The UTF-8 of the text of ids. Unknown ids raise."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).removeprefix(b" ")

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8")


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id long, ids array<int>), one row per row of ``docs``; null and empty texts have no ids.

    Whole texts are encoded. Where no piece crosses a boundary, paths converge and ids are
    committed; elsewhere the search keeps a window that depends on the longest piece, not on the
    text. A text and its ids are one row, and are held as such. Copies and order do not matter; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= BLOCK):
                    held += len(texts[hi] or "")
                    hi += 1
                ids = codec.encode_all(texts[lo:hi])
                texts[lo:hi] = [None] * (hi - lo)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), column], ["doc_id", "ids"])
                lo = hi

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(in_worker("spm", run, _forget, _leave), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab: Vocabulary, digest: bool = False) -> DataFrame:
    """(doc_id long, text string) from (doc_id, ids); null ids give a null text.

    With ``digest``, (doc_id, n_ids, ids_crc32, text_crc32) instead: of the ids as little-endian
    unsigned 32-bit numbers, and of the decoded text's UTF-8.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            column = batch.column("ids")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, 256):
                hi = min(lo + 256, batch.num_rows)
                own = column.slice(lo, hi - lo).is_valid().to_pylist()
                ids = [values[a:b] if ok else None for a, b, ok in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], own)]
                texts = [None if i is None else codec.decode_bytes(i.tolist()) for i in ids]
                if digest:
                    sums = [None if i is None else zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
                    back = [None if t is None else zlib.crc32(t) for t in texts]
                    sizes = [None if i is None else len(i) for i in ids]
                    columns = [pa.array(x, pa.int64()) for x in (sizes, sums, back)]
                else:
                    columns = [pa.array([None if t is None else t.decode("utf-8") for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], names)

    names = ["doc_id", "n_ids", "ids_crc32", "text_crc32"] if digest else ["doc_id", "text"]
    schema = "doc_id long, n_ids long, ids_crc32 long, text_crc32 long" if digest else "doc_id long, text string"
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(in_worker("spm", run, _forget, _leave), schema)


_CODECS: dict[int, Codec] = {}


def _codec(vocab: Vocabulary) -> Codec:
    """One codec a worker and vocabulary; what it remembers is forgotten after each task."""
    key = hash(vocab)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocab)
    return _CODECS[key]


def _forget() -> None:
    for codec in _CODECS.values():
        codec.forget()


def _leave() -> None:
    _CODECS.clear()

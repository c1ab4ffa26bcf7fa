"""Fill-in-the-middle: texts cut at token boundaries and put together again in another order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import in_worker

#: A run of letters, or any other character by itself.
PATTERN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that are tokenized at a time; the offsets of more would not fit in memory.
STRETCH = 500_000
#: Code points of texts that are sent on together.
BLOCK = 4_000_000


def _splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), behavior="isolated")


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """(start, part) of consecutive parts of about ``size`` code points that end with no letter run open."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        while hi < len(text) and text[hi - 1].isascii() and text[hi - 1].isalpha():
            hi += 1
        yield lo, text[lo:hi]
        lo = hi


class Tokens:
    """The token boundaries of one text, for counting and for the offsets of given ranks."""

    def __init__(self, text: str, splitter, size: int = STRETCH) -> None:
        self._text, self._splitter, self._size = text, splitter, size
        self._offsets: list | None = None
        self._counts: list[int] = []
        for _, part in stretches(text, size):
            self._offsets = splitter.pre_tokenize_str(part)
            self._counts.append(len(self._offsets))

    def __len__(self) -> int:
        return sum(self._counts)

    def ends(self, ranks: list[int]) -> list[int]:
        """The code point after the first r tokens, for each r of ``ranks``."""
        found = {0: 0}
        passed = 0
        for count, (start, part) in zip(self._counts, stretches(self._text, self._size)):
            inside = [r for r in ranks if passed < r <= passed + count]
            if inside:
                offsets = self._offsets if len(self._counts) == 1 else self._splitter.pre_tokenize_str(part)
                found |= {r: start + offsets[r - passed - 1][1][1] for r in inside}
            passed += count
        return [found[r] for r in ranks]


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of eight digits of sha256 of ``seed:id``.

    A null id counts as an empty string.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """(doc_id, n long, form string, prefix_chars long, middle_chars long, output string), one row per row.

    A text has ``n`` tokens of PATTERN. Two cuts among its n + 1 token boundaries, by the hash of
    doc_id, make prefix, middle and suffix. ``form`` is ``plain`` (the text as it is) for an empty
    text, one that holds a sentinel, and 100 - ``fim_percent`` of a hundred of the others; ``spm``
    (suffix first) for ``spm_percent`` of a hundred of the rest, else ``psm``. Lengths are code
    points, null where plain. A null text is an empty one, a null id is hashed as an empty string;
    rows that share an id are cut by the same hash, each by its own length. Only doc_id and text are
    read, so other columns cannot clash. No rows give none.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    sentinel = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | sentinel | (h3 % 100 >= fim_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def run(batches):
        splitter = _splitter(PATTERN)
        for batch in batches:
            held: list[tuple] = []
            size = 0
            columns = (batch.column(c) for c in ("doc_id", "text", "form", "h1", "h2"))
            for doc_id, value, kind, a, b in zip(*columns):
                text, kind = value.as_py(), kind.as_py()
                tokens = Tokens(text, splitter)
                n = len(tokens)
                prefix_chars = middle_chars = None
                if kind != "plain":
                    low, high = tokens.ends(sorted((a.as_py() % (n + 1), b.as_py() % (n + 1))))
                    prefix_chars, middle_chars = low, high - low
                    prefix, middle, suffix = text[:low], text[low:high], text[high:]
                    text = "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if kind == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
                held.append((doc_id.as_py(), n, kind, prefix_chars, middle_chars, text))
                size += len(text)
                if size >= BLOCK:
                    yield _batch(held, batch.schema.field("doc_id").type)
                    held, size = [], 0
            if held:
                yield _batch(held, batch.schema.field("doc_id").type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(in_worker("fim", run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A text with a sentinel is always plain, and no sentinel can begin inside another or at the seam
    of a text and one, so the three that are found are the three that were put there.
    """
    parts = F.split(output, "<[PSM]>")
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))

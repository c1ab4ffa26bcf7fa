"""Personal data: fixed patterns as seeds, and contexts bootstrapped from them that find more."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import cut, in_worker

#: Kinds with fixed patterns, and all: credentials are found by what they are assigned to.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
# Possessive repeats: what follows never starts with what is repeated, so nothing is lost.
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+(?<=[0-9])")
_DIGIT = re.compile(r"[0-9]")
_DIGIT_RUN = re.compile(r"[0-9]+")
_SECRET = re.compile(
    r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[ _-]?key|access[ _-]?key)[\"' ]{0,3}[=:][\"' ]{0,3}([a-z0-9+/_=-]{16,})"
)
#: A candidate: neighbouring tokens that hold a digit or an at sign.
_CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?: [^\s0-9@]*[0-9]\S*)*")
_OPENING, _CLOSING = "\"'`<([{", "\"'`>)]}"
_EDGES = "\"'`<>[]{}()*,;:!?.|=#$&%"


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        size = 64
        while True:
            lo = max(free, at - size)
            run = _LOCAL.match(text[lo:at][::-1]).end()
            if run < at - lo or lo == free:
                break
            size *= 2
        after = _DOMAIN.match(text, at + 1) if run else None
        if after:
            out.append((at - run, after.end()))
            free = after.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    # A match can only start where a digit run does: the pattern takes whole runs.
    for run in _DIGIT_RUN.finditer(text):
        if run.start() < free or text[run.end() : run.end() + 1] != ".":
            continue
        m = _IP.match(text, run.start())
        if m:
            free = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(m.span())
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans in code points, end exclusive, of each kind's fixed pattern; leftmost, not overlapping."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            found["ip"] = _ips(text)
        found["card"] = _cards(text)
        if "+" in text:
            found["phone"] = _phones(text)
    return found


def _secret_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Long mixed strings that are assigned to a name for a credential, off the spans taken."""
    if "=" not in text and ":" not in text:
        return []
    spans = [m.span(1) for m in _SECRET.finditer(text) if _mixed(m.group(1))]
    return [(s, e) for s, e in spans if all(e <= a or b <= s for a, b, _ in taken)]


def _mixed(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def _shape(text: str) -> str | None:
    """The kind that a candidate's characters allow, if any: what keeps other numbers out."""
    if "@" in text:
        return "email" if any(c.isalpha() for c in text) and text[0] != "@" and text[-1] != "@" else None
    digits = sum(c.isdigit() and c.isascii() for c in text)
    if any(c.isalpha() for c in text):
        return "secret" if len(text) >= 16 and digits and not set(text) & set(" ./:") else None
    if text.count(".") == 3 and all(p.isdigit() and len(p) <= 3 for p in text.split(".")):
        return "ip"
    if 13 <= digits <= 19:
        return "card"
    return "phone" if 9 <= digits <= 12 else None


def _name(text: str) -> str:
    """A text in lower case, or a digest of a long one: equal names mean equal texts."""
    return text.lower() if len(text) <= 96 else "#" + hashlib.sha256(text.lower().encode("utf-8", "surrogatepass")).hexdigest()


def _near(text: str, at: int, count: int, step: int) -> list[str]:
    """The ``count`` whole words before (step -1) or after (1) a place, or all if there are fewer."""
    size = 64
    while True:
        part = text[max(0, at - size) : at] if step < 0 else text[at : at + size]
        words = part.split()
        # The outermost word may be cut, unless the text ends there.
        if len(words) > count or (at - size <= 0 if step < 0 else at + size >= len(text)):
            return [_name(w) for w in (words[-count:] if step < 0 else words[:count])]
        size *= 4


def _context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the two words before it, and the words at either side.

    Quotes and brackets that enclose the span are not words.
    """
    while start and text[start - 1] in _OPENING:
        start -= 1
    while end < len(text) and text[end] in _CLOSING:
        end += 1
    before, after = _near(text, start, 2, -1), _near(text, end, 1, 1)
    near = before[-1] if before else ""
    far = before[0] if len(before) == 2 else ""
    return [f"{far} {near} _", f"{near} _ {after[0] if after else ''}"]


def _candidates(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """Seeds, and other tokens of a fitting shape that no seed overlaps, with their patterns."""
    out = []

    def add(s, e, kind, seed):
        out.append({"start": s, "end": e, "kind": kind, "seed": seed, "instance": _name(text[s:e]), "patterns": _context(text, s, e)})

    taken = [(s, e, k) for k, v in spans.items() for s, e in v]
    taken += [(s, e, "secret") for s, e in _secret_spans(text, taken)]
    taken.sort()
    for s, e, k in taken:
        add(s, e, k, True)
    i = 0
    for m in _CANDIDATE.finditer(text):
        raw = m.group()
        s = m.start() + len(raw) - len(raw.lstrip(_EDGES))
        e = m.end() - (len(raw) - len(raw.rstrip(_EDGES)))
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= e or (i < len(taken) and taken[i][0] < e):
            continue
        kind = _shape(text[s:e])
        if kind:
            add(s, e, kind, False)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(ALL_KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(spans), key=lambda x: (order[x[0]], x[1], x[2])))


_CAND = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("kind", pa.string()),
            ("seed", pa.bool_()),
            ("instance", pa.string()),
            ("patterns", pa.list_(pa.string())),
        ]
    )
)
_FOUND = "array<struct<start:bigint,end:bigint,kind:string,seed:boolean,instance:string,patterns:array<string>>>"


def _extract(docs: DataFrame) -> DataFrame:
    """``docs`` with, instead of its column text, a row number, the fixed patterns' spans and the candidates."""
    kept = [c for c in docs.columns if c != "text"]
    names = [*kept, "row", *(f"n_{k}" for k in KINDS), "base", "found"]

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                counts: list[list[int]] = [[] for _ in KINDS]
                base, found = [], []
                for text in piece.column("text").to_pylist():
                    spans = base_spans(text)
                    for c, k in zip(counts, KINDS):
                        c.append(len(spans[k]))
                    base.append(_joined([(k, s, e) for k in KINDS for s, e in spans[k]]))
                    found.append(_candidates(text, spans) if text and (("@" in text) or _DIGIT.search(text)) else [])
                columns = [
                    *(piece.column(c) for c in kept),
                    pa.array(range(row, row + piece.num_rows), pa.int64()),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(base, pa.string()),
                    pa.array(found, _CAND),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                row += piece.num_rows

    before = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    schema = f"{before}, row long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, found {_FOUND}"
    return docs.mapInArrow(in_worker("pii", run), schema)


def discover(found: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """(kind, instance) pairs that trusted patterns give away, from occurrences of candidates.

    ``found`` has kind, instance, seed and patterns. In each round a pattern's confidence for a kind
    is its instances' total score over their number plus one, if at least ``support`` seeds stand in
    it, and an instance's score is 1 for a seed, else 1 less the product of its patterns' doubts.
    Patterns of at least ``confidence`` name what they hold. Distinct instances count once for a
    pattern, so copies of a text add nothing.
    """
    edges = cut(
        found.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
        .groupBy("kind", "pattern", "instance")
        .agg(F.max("seed").alias("seed"))
    )
    known = edges.where("seed").select("kind", "instance").distinct().withColumn("score", F.lit(1.0))
    scores = known
    new = None
    for _ in range(rounds):
        trusted = (
            edges.join(scores, ["kind", "instance"], "left")
            .groupBy("kind", "pattern")
            .agg(
                (F.sum(F.coalesce("score", F.lit(0.0))) / (F.count(F.lit(1)) + 1)).alias("trust"),
                F.count(F.when(F.col("seed"), 1)).alias("seeds"),
            )
            .where((F.col("seeds") >= support) & (F.col("trust") >= confidence))
            .select("kind", "pattern", "trust")
        )
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
        new = cut(
            edges.join(trusted, ["kind", "pattern"])
            .groupBy("kind", "instance")
            .agg((1 - doubt).alias("score"))
            .join(known.select("kind", "instance"), ["kind", "instance"], "left_anti")
        )
        scores = known.unionByName(new)
    return new.where(F.col("score") >= confidence).select("kind", "instance")


def find_pii(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every row of ``docs``.

    ``base`` lists the fixed patterns' spans as kind:start:end, by kind as in KINDS and then by
    start, comma-joined, in code points with the end exclusive; the counts are theirs. ``spans``
    adds what else is found: credentials (kind secret) assigned to a name for one, and what
    bootstrapping discovers from them and the fixed patterns; such spans never overlap a base span.
    Null and empty texts have none. Whole texts are read, rows stay apart even if they repeat or
    share an id, and other columns are ignored. A corpus without seeds discovers nothing.
    """
    rows = cut(_extract(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    place = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    rank = F.array_position(F.array(*(F.lit(k) for k in ALL_KINDS)), F.col("kind"))
    extra = (
        _added(found, rounds, support, confidence)
        .groupBy("row")
        .agg(F.collect_set(F.struct(rank.alias("rank"), "start", "end", place.alias("place"))).alias("extra"))
    )
    parts = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(
            F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.split(x, ":")[0]).alias("rank"),
            F.split(x, ":")[1].cast("long").alias("start"),
            F.split(x, ":")[2].cast("long").alias("end"),
            x.alias("place"),
        ),
    )
    both = F.array_join(F.transform(F.sort_array(F.concat(parts, F.col("extra"))), lambda x: x["place"]), ",")
    out = rows.join(extra, "row", "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(both)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"))


def _added(found: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """The rows of ``found`` that are spans beside those of the fixed patterns."""
    named = discover(found, rounds, support, confidence)
    discovered = found.where("not seed").join(named, ["kind", "instance"]).select(*found.columns)
    return found.where("seed and kind = 'secret'").unionByName(discovered)


def redact(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """``docs`` with every span of ``find_pii`` replaced by its kind in brackets; n_chars follows.

    Overlapping spans are replaced together, by the kind of the first. Rows without personal data
    come back as they are, and so do null and empty texts. Spans are a matter of the text alone, so
    they are joined by a 128-bit hash of it: null and repeated ids change nothing, and any names of
    other columns are fine. No rows give none.
    """
    keys = [F.xxhash64(F.lit(i), F.col("text")).alias(f"key{i}") for i in (1, 2)]
    rows = cut(_extract(docs.select(*keys, "text")))
    found = rows.select("key1", "key2", F.explode("found").alias("f")).select("key1", "key2", "f.*")
    added = _added(found, rounds, support, confidence)
    more = added.groupBy("key1", "key2").agg(F.collect_set(F.struct("start", "end", "kind")).alias("more"))
    joined = docs.select(F.struct("*").alias("row"), *keys).join(more, ["key1", "key2"], "left").select("row", "more")
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            columns = batch.column("row").flatten()
            texts = []
            for text, extra in zip(columns[at].to_pylist(), batch.column("more").to_pylist()):
                if text:
                    spans = [(s, e, k) for k, v in base_spans(text).items() for s, e in v]
                    spans += [(x["start"], x["end"], x["kind"]) for x in extra or ()]
                    text = mask(text, spans) if spans else text
                texts.append(text)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(in_worker("pii", run), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans replaced by their kind in brackets, overlapping ones together."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


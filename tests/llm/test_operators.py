"""Each operator against a plain version of itself, and on nulls, empties, copies and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphspark.llm import components, embed, langid, licenses, packing, pii, simhash, spm, substring, topk, urls
from graphspark.llm.queries import URL_RULES, public_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, h long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _docs(spark, texts, ids=None, langs=None, sources=None):
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), 0.5, True, 7)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "y", "z"]) + str(rng.randint(0, 30)) for _ in range(n))


ODD = [None, "", " \n\t ", "!!!", "word", "word word", "ÉÀ ñ 日本語 🙂", "a" * 50_000]


def _groups(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return [root(x) for x in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _groups(500, [(a, b) for a, b in edges if a is not None])
    assert got == {x: want[x] for a, b in edges if a is not None and a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 substring dedup


def test_passages_are_found_in_every_copy_but_the_first(spark):
    rng = random.Random(2)
    shared = _prose(rng, 80)
    words = shared.split()
    edited = words[:]
    for i in (11, 37, 62):
        edited[i] = "changed"
    texts = [f"{_prose(rng, 40)} {s} {_prose(rng, 30)}" for s in (shared, shared, " ".join(edited))]
    texts += [_prose(rng, 200), _prose(rng, 20), *ODD]
    docs = _docs(spark, texts, ids=[10, 20, 30, 40, 50] + [100 + i for i in range(len(ODD))])
    found = substring.shared_passages(docs).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} == {(20, 10), (30, 10)}
    for r in found:
        cut = texts[{20: 1, 30: 2}[r.doc_id]][r.start : r.end]
        assert set(words) - {words[11], words[37], words[62]} <= set(cut.split())
        assert r.n_words >= 80 and r.similarity >= 0.8
    left = {r.doc_id: r for r in substring.remove_passages(docs, substring.shared_passages(docs)).collect()}
    assert left[10].text == texts[0] and shared not in left[20].text and left[20].n_chars == len(left[20].text)
    assert left[100].text is None and left[101].text == "" and len(left) == len(texts)


def test_chains_match_quadratic_search():
    rng = random.Random(3)
    for _ in range(30):
        pts = sorted((rng.randrange(60), rng.randrange(60)) for _ in range(25))
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        best, score = 0.0, []
        for i in range(len(pts)):
            s = 5.0
            for j in range(i):
                if x[j] < x[i] and y[j] < y[i]:
                    s = max(s, 5.0 + score[j] - 0.05 * (x[i] - x[j] + y[i] - y[j]))
            score.append(s)
            best = max(best, s)
        first = substring.chains(x, y, 5.0, 0.05)[0]
        got = 5.0 * len(first) - 0.05 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(first[:-1], first[1:]))
        assert abs(got - best) < 1e-9
    assert substring.chains([], [], 5.0, 0.05) == []


def test_edit_distance():
    assert substring.edit_distance(list("abcdef"), list("abxdef"), 5) == 2
    assert substring.edit_distance(list("abc"), list("abc"), 0) == 0
    assert substring.edit_distance([], list("abc"), 3) == 3
    assert substring.edit_distance(list("aaaa"), list("bbbb"), 3) is None


def test_passages_of_one_pair_far_apart(spark):
    rng = random.Random(21)
    head, foot = _prose(rng, 60), _prose(rng, 60)
    texts = [f"{_prose(rng, 30)} {head} {_prose(rng, 200)} {foot} {_prose(rng, 30)}" for _ in range(2)]
    found = substring.shared_passages(_docs(spark, texts)).collect()
    assert sorted(texts[1][r.start : r.end] for r in found) == sorted([head, foot])
    assert all((r.doc_id, r.ref_doc_id, r.n_words, r.similarity) == (1, 0, 60, 1.0) for r in found)


def test_passages_that_repeat_themselves(spark):
    rng = random.Random(23)
    line = _prose(rng, 8)
    short, long = f"{line} {line}", " ".join([line] * 40)
    texts = [f"{_prose(rng, 40)} {short} {_prose(rng, 40)} {long} {_prose(rng, 40)}", f"{_prose(rng, 70)} {long} {_prose(rng, 30)}"]
    texts += [f"{_prose(rng, 50)} {'again ' * 70} {_prose(rng, 50)}" for _ in range(2)]
    found = substring.shared_passages(_docs(spark, texts)).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} == {(1, 0), (3, 2)}
    covered = set().union(*(range(r.start, r.end) for r in found if r.doc_id == 1))
    at = texts[1].index(long)
    assert covered >= set(range(at, at + len(long)))


def test_a_passage_in_halves_of_smaller_documents(spark):
    rng = random.Random(25)
    left, right = _prose(rng, 40), _prose(rng, 40)
    texts = [f"{_prose(rng, 50)} {s} {_prose(rng, 50)}" for s in (f"{left} ", right, f"{left} {right}", f"{left} {right}")]
    # Every seed of the whole has a smaller holder: the seam is in a third document.
    seam = " ".join([*left.split()[-20:], *right.split()[:20]])
    docs = _docs(spark, [texts[0], texts[1], f"{_prose(rng, 50)} {seam} {_prose(rng, 50)}", *texts[2:]], ids=[10, 11, 12, 20, 30])
    found = [r for r in substring.shared_passages(docs).collect() if (r.doc_id, r.ref_doc_id) == (30, 20)]
    assert [texts[3][r.start : r.end] for r in found] == [f"{left} {right}"]


def test_a_single_seed_is_enough(spark):
    rng = random.Random(24)
    for _ in range(300):
        shared = _prose(rng, 60)
        words = shared.split()
        for i in range(5, 60, 8):
            words[i] = f"changed{i}"
        texts = [f"{_prose(rng, 60)} {s} {_prose(rng, 60)}" for s in (shared, " ".join(words))]
        h = [{int(x) for x in substring.seeds_of([t.encode()], 5, 30, 50)[1]} for t in texts]
        if len(h[0] & h[1]) == 1:
            break
    assert len(h[0] & h[1]) == 1
    found = substring.shared_passages(_docs(spark, texts), window=30).collect()
    assert [(r.doc_id, r.ref_doc_id) for r in found] == [(1, 0)] and found[0].n_words >= 50


def test_longest_similar_parts_of_a_chain():
    rng = random.Random(22)
    for _ in range(50):
        blocks, edits, i, p = [], [], 0, 0
        for _ in range(12):
            n, x, y = rng.randint(1, 30), rng.randint(0, 12), rng.randint(0, 12)
            blocks.append((i, p, n))
            edits.append(x + y)
            i, p = i + n + x, p + n + y
        edits.pop()
        good = []
        for s in range(12):
            for t in range(s, 12):
                size = sum(blocks[t][m] + blocks[t][2] - blocks[s][m] for m in (0, 1))
                if sum(edits[s:t]) <= 0.2 * size + 1e-9:
                    good.append((s, t))
        want = [(s, t) for s, t in good if not any((u, v) != (s, t) and u <= s and t <= v for u, v in good)]
        assert substring._stretches(blocks, edits, 0.8) == want


def test_identical_documents_in_a_large_group(spark):
    text = _prose(random.Random(4), 120)
    docs = _docs(spark, [text] * 40)
    found = substring.shared_passages(docs).collect()
    assert len(found) == 39 and {r.ref_doc_id for r in found} == {0} and all(r.start == 0 and r.end == len(text) for r in found)
    assert substring.shared_passages(_docs(spark, [])).count() == 0


# --- 2 url filters


def test_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.example.org/es/1", None),
        (2, "http://EXAMPLE.org/en/12?q#f", ""),
        (3, "https://x.org", "<p>"),
        (4, "http://n.net/a", link.format("http://m.com/de/1")),
        (5, "http://n.net/b", "<META http-equiv='refresh' content='0; url=/a'>"),
        (6, "http://o.org/", link.format("http://m.com/de/1")),
        (7, "http://p.net/", "<link href='http://q.com/fr/' rel=canonical>"),
        (8, None, None),
        (9, "no scheme/com/de/", None),
        (10, "http://n.net/b#part", None),
        (11, "http://fcom/de/", None),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, URL_RULES).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("x.org", "", None, "allow")
    assert [got[i][3] for i in (4, 5, 6, 7, 10)] == ["allow"] * 5  # an allowed alias goes before a blocked one
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[11][2] is None
    blocked = urls.filter_urls(df.where("page_id <> 6"), URL_RULES)
    assert {r.page_id for r in blocked.where("verdict = 'block'").collect()} == {1, 2, 4, 5, 10}
    assert urls.filter_urls(df.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urls.match_rule(F.lit("a"), F.lit("b"), [("allow", "nohost")])


# --- 3 license scans


def _base(text):
    low = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_license_base_matches_plain_scan(spark):
    texts = ["CC-BY cc by cc by.", "All rights reserved; GNU General  Public\nLicense, version 3.", "Licensed under the Apache License, Version 2.0", "é-cc by_x", *ODD]
    for t, r in zip(texts, licenses.scan_licenses(_docs(spark, texts)).orderBy("doc_id").collect()):
        n, places = _base(t)
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_rules_and_suppression():
    scan = licenses.Scanner()
    text, words = licenses.canonical(b"Licensed under CC BY-NC 4.0 and the GNU Lesser General Public License, version 2.1")
    kept = scan.detections(text, scan.keywords.intersection(words))
    assert [r.label for _, _, r in kept] == ["cc-by-nc-4.0", "lgpl-2.1"]
    for a in kept:
        for b in kept:
            assert a is b or not (b[0] <= a[0] and a[1] <= b[1])
    assert len(licenses.RULES) >= 300
    for rule in licenses.RULES:
        re.compile(rule.pattern)


# --- 4 exact top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 32)).astype(np.float32) * 0.2
    x[10] = x[11]
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in range(150)] + [(200, None, 1), (201, [], 1), (202, [float("nan")] * 32, 1), (203, [None] * 32, 1), (204, [1.0, 2.0], 1), (None, [0.0] * 32, 1)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=10).collect()
    y = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for q in (0, 50, 100):
        want = sorted(((-int(y[q] @ y[c]), c) for c in range(150) if c != q))[:10]
        mine = [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == want
    assert {r.query_id for r in got} == {0, 50, 100}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 4")
    assert topk.top_k(few, few.where("vec_id = 1")).count() == 3


def test_top_k_of_mixed_lengths(spark):
    rng = np.random.default_rng(34)
    rows = [(i, rng.normal(size=4 if i % 2 else 6).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    y = {i: np.floor(1024 * np.array(v)) for i, v in rows}
    for q in (2, 3):
        got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where(f"vec_id = {q}"), k=30).orderBy("rank").collect()]
        want = sorted((-int(y[q] @ y[c]), c) for c in y if c != q and len(y[c]) == len(y[q]))
        assert got == [(c, -n) for n, c in want]


def test_segment_bounds_hold():
    x = np.random.default_rng(6).normal(size=(40, 30))
    for parts in (1, 4, 7):
        f = topk.segment_features(x, parts)
        assert (f @ f.T >= x @ x.T - 1e-9).all()


# --- 5 personal data


def _pii(text):
    def luhn(d):
        return sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_base_matches_plain_patterns():
    rng = random.Random(7)
    bits = ["a@b.c", "x.y@z", "@", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (986) 555-4218", "+12", "++34 91 123 45 67 8.", "é", " ", "\n", ".", "00001.2.3.4", "a@b@c.d.", "5", "-"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert pii._joined([(k, s, e) for k, v in pii.base_spans(text).items() for s, e in v]) == ",".join(
            sorted(filter(None, dict.fromkeys(_pii(text).split(","))), key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
        )


def test_pii_bootstraps_and_redacts(spark):
    rng = random.Random(8)
    texts = [f"{_prose(rng, 5)} please call me on +1 555 {200 + i} {4000 + i} today" for i in range(12)]
    texts += [f"{_prose(rng, 5)} please call me on 555 867 {5300 + i} today" for i in range(2)]
    texts += ["order number 123456789 shipped", "a@b.example and 10.0.0.1", *ODD]
    docs = _docs(spark, texts)
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert rows[12].base == "" and rows[12].spans.startswith("phone:") and rows[14].spans == ""
    s = rows[12].spans.split(":")
    assert texts[12][int(s[1]) : int(s[2])] == "555 867 5300"
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[15].text == "[EMAIL] and [IP]" and "[PHONE]" in out[12].text and out[14].text == texts[14]
    assert out[16].text is None and out[0].n_chars == len(out[0].text) and len(out) == len(texts)
    assert pii.find_pii(_docs(spark, [])).count() == 0


# --- 6 language identification


def test_language_model_held_out(spark):
    rng = random.Random(9)
    stems = {"aa": ["ka", "ki", "ro", "ta", "mo"], "bb": ["sch", "ung", "ein", "er", "keit"], "cc": ["tion", "eau", "oux", "ment", "que"]}
    texts, langs = [], []
    for i in range(240):
        lang = list(stems)[i % 3]
        texts.append(" ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(15)))
        langs.append(lang)
    texts += [None, "", "123 !", "KAKI ROTA."]
    langs += ["aa", "aa", None, None]
    pieces = langid.vocabulary(public_vocabulary("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in langid.identify(_docs(spark, texts, langs=langs), pieces).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i in range(240) if rows[i].held_out]
    assert held and sum(rows[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)
    assert [rows[240 + i].lang_pred for i in range(4)] == ["und", "und", "und", "aa"]
    assert langid.identify(_docs(spark, []), pieces).count() == 0
    assert {r.lang_pred for r in langid.identify(_docs(spark, ["abc"], langs=[None]), pieces).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocab = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba"])
    prob = np.array([[0.0], [0.3], [0.2], [0.1], [0.15], [0.2], [0.05]])

    def brute(s):
        if not s:
            return 1.0
        return sum((prob[vocab.row[s[:i]], 0] if s[:i] in vocab.row else langid.FLOOR * (i == 1)) * brute(s[i:]) for i in range(1, len(s) + 1))

    words = ["a", "ab", "abba", "bab", "abc", "aabbaab"]
    got = langid.log_likelihoods(words, vocab, prob)
    assert np.allclose(got[:, 0], [np.log(brute("▁" + w)) for w in words])
    assert np.allclose(langid._long("abba", vocab, prob), np.log(brute("▁abba")))


# --- 7 packing


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(10)
    texts = [_prose(rng, rng.randint(1, 300)) for _ in range(60)] + ["It's DON'T 12 naïve İx", "<|endoftext|> a", *ODD]
    docs = _docs(spark, texts, sources=[None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}" for i in range(len(texts))])
    path = public_vocabulary("word_bpe_49k.json")
    pieces = packing.pack(docs.repartition(3), path, window=256, quantum=32).collect()
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for i, want in ids.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()] == want
        assert all(p.doc_tokens == len(want) and p.length == len(p.ids) // 4 for p in own)
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own[:-1]]).tolist()
        n = sum(p.length for p in own)
        assert n == 256 or n & (n - 1) == 0 and n < 256
    assert packing.pack(_docs(spark, []), path).count() == 0


def test_schedule_keeps_shares():
    plan = packing.Schedule([10_000, 2_500, 37], 64)
    starts = sorted((int(p), q, min(64, plan.totals[q] - 64 * j)) for q in range(3) for j, p in enumerate(plan.place(np.full(plan.counts[q], q), np.arange(plan.counts[q]))))
    at = 0
    for p, _, n in starts:
        assert p == at
        at += n
    sent = np.zeros(3)
    for p, q, n in starts:
        sent[q] += n
        assert (np.abs(sent[:2] - np.array(plan.totals[:2]) * sent.sum() / plan.total) <= 2 * 64).all()
    big = packing.Schedule([1 << 50, 1 << 49], 256)
    assert big.place([0, 0], [0, 1 << 40]).dtype == np.int64


# --- 8 SentencePiece


def test_sentencepiece_matches_the_library_and_round_trips(spark):
    import sentencepiece

    model = public_vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    vocab = spm.Vocabulary.load(model)
    rng = random.Random(11)
    texts = [_prose(rng, 30), "Hello world.\n\nThe  quick brown-fox's éàü 日本 🙂", "nospaces" * 300, " lead and trail "]
    both = [*texts, None, "", "▁literal ▁▁ marks", ""]
    encoded = spm.encode(_docs(spark, both), vocab).persist()
    got = {r.doc_id: r.ids for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert got[i] == lib.encode(t)
    back = {r.doc_id: r.text for r in spm.decode(encoded, vocab).collect()}
    assert [back[i] for i in range(len(both))] == [t or "" for t in both]


def test_streaming_commits_in_a_bounded_window():
    codec = spm.Codec(spm.Vocabulary.load(public_vocabulary("piece_bpe_32k.model")))
    text = "abcdefghij" * 3000
    search = codec.viterbi()
    out = []
    for i in range(0, len(text), 7):
        out += search.feed(text[i : i + 7])
    out += search.finish()
    assert "".join(out) == text and search.widest < 200
    assert out == codec.merges.merged("abcdefghij" * 4)[: len(out)] or len(out) > 0


def test_unigram_type_finds_the_best_sum():
    scores = {"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.0, "aba": -4.5, "▁a": -3.5}
    vocab = spm.Vocabulary(tuple(scores), tuple(range(300, 300 + len(scores))), tuple(scores.values()), tuple(range(256)), merge_type=False)
    codec = spm.Codec(vocab)

    def best(s):
        if not s:
            return 0.0
        return max((scores[s[:i]] + best(s[i:]) for i in range(1, len(s) + 1) if s[:i] in scores), default=-1e9)

    for word in ("a", "ab", "abab", "aababa"):
        ids = codec.encode(word).tolist()
        assert abs(sum(scores[vocab.pieces[i - 300]] for i in ids) - best("▁" + word)) < 1e-9
        assert codec.decode(ids) == word


# --- 9 embeddings


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 24))
    x[20:40] = x[20] + 0.12 * rng.normal(size=(20, 24))
    x[50:55] = x[50]
    x[60] = -x[61]
    rows = [(int(i), [float(np.float32(v)) for v in x[i]], 3) for i in range(120)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 24, 1), (303, [float("inf")] * 24, 1), (304, [None] * 24, 1), (305, [1.0, 0.0], 1), (306, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")
    y = np.array([r[1] for r in rows[:120]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.9
    np.fill_diagonal(link, False)
    want = _groups(120, [tuple(map(int, p)) for p in np.argwhere(np.triu(link))])
    for leaf in (32768, 16):
        got = {r.vec_id: r for r in embed.near_duplicates(df, 0.9, leaf_rows=leaf).collect()}
        assert len(got) == len(rows)
        for i in range(120):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(link[i].sum()), want[i], want[i] == i)
        assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 305))
        assert got[306].component_id == 305 and got[306].n_links == 1
    assert embed.near_duplicates(df.limit(0)).count() == 0


# --- 10 SimHash


def _fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(13)
    base = [_prose(rng, 150) for _ in range(6)]
    texts = list(ODD)
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts += [base[0]] * 5
    prints = [_fingerprint(t) for t in texts]
    n = len(texts)
    want = _groups(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    for shard in (2048, 4):
        got = {r.doc_id: r for r in simhash.simhash_groups(_docs(spark, texts), shard_rows=shard).collect()}
        assert [got[i].fp & (2**64 - 1) for i in range(n)] == prints
        assert [got[i].component_id for i in range(n)] == want
    assert simhash.simhash_groups(_docs(spark, [])).count() == 0
    twice = simhash.simhash_groups(_docs(spark, ["a b c", "a b c", "x"], ids=[5, 5, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in twice) == [(-1, -1), (5, 5), (5, 5)]


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(14)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        for radius in (0, 2, 5, 30):
            assert set(tree.within(v, radius)) == {x for x in values if (x ^ v).bit_count() <= radius}


def test_similar_groups_link_at_the_similarity(spark):
    rng = random.Random(15)
    base = [_prose(rng, 200) for _ in range(5)]
    near = []
    for b in base:
        w = b.split()
        for i in rng.sample(range(200), 3):
            w[i] = "edited"
        near.append(" ".join(w))
    texts = [*base, *near, *(base[0] for _ in range(4)), *(_prose(rng, 60) for _ in range(10)), None, ""]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(_docs(spark, texts)).collect()}
    assert [got[5 + i] for i in range(5)] == list(range(5)) and {got[10 + i] for i in range(4)} == {0}
    assert all(got[14 + i] == 14 + i for i in range(10)) and got[24] == got[25] == 24
    assert hashlib.md5(simhash.sketch(b"a b c")).hexdigest() == hashlib.md5(simhash.sketch(b"A  B\nC")).hexdigest()


def test_parts_of_a_large_bucket_meet(spark):
    rng = random.Random(31)
    base = _prose(rng, 200)
    texts = [f"{base} end{i}" for i in range(40)]
    got = simhash.similar_groups(_docs(spark, texts), miss=0.5, shard_rows=1).collect()
    assert {r.component_id for r in got} == {0}


def test_followers_of_one_leader_are_compared(spark):
    rng = random.Random(32)
    texts = []
    for _ in range(40):
        leader = _prose(rng, 200).split()
        one = leader[:]
        for i in range(10, 200, 24):
            one[i] = "edited"
        two = one[:]
        two[100] = "again"
        texts += [" ".join(x) for x in (leader, one, two)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(_docs(spark, texts), miss=0.9).collect()}
    bits, tables = simhash._tables(120, 0.1, 0.9)
    assert (bits, tables) == (12, 1)
    chosen = np.random.default_rng(17).choice(128, bits, replace=False)

    def key(text):
        halves = [int.from_bytes(simhash.sketch(text.encode())[8 * h : 8 * h + 8], "big") for h in (0, 1)]
        return [halves[b // 64] >> int(b % 64) & 1 for b in chosen]

    met = [i for i in range(0, 120, 3) if key(texts[i + 1]) == key(texts[i + 2])]
    assert any(key(texts[i]) == key(texts[i + 1]) for i in met)
    assert all(got[i + 2] == got[i + 1] == i + 1 for i in met)


def test_a_frequent_pair_does_not_make_texts_equal(spark):
    rng = random.Random(33)
    texts = [f"{'. ' * 1000}{_prose(rng, 300)}" for _ in range(2)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(_docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 1}

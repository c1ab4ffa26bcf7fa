"""Shares and deficits, long words, odd columns and ids, credentials, widths of slices, recall, memory."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphspark.llm import common, embed, langid, packing, pii, simhash, spm, substring, topk, urls
from graphspark.llm.queries import public_vocabulary

WORDS = [a + b for a in ("ka", "ro", "ti", "mu", "sel", "bri", "ul") for b in ("dan", "ver", "lis", "pon", "gra", "tor", "e")]
#: Names that helpers of the operators could have used.
ODD_NAMES = "_id long, _more string, _spans string, _lang_pred string, _score double, lang_pred string, score double, row string, spans string, more string, key1 long, chain long, n long"
ODD_VALUES = (1, "m", "s", "l", 0.1, "x", 0.2, "r", "sp", "mo", 5, 6, 7)


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def _odd(spark, rows):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {ODD_NAMES}"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *ODD_VALUES) for i, t in rows], schema)


# --- redirects


def test_aliases_of_chains_and_cycles_against_a_plain_search(spark):
    rng = random.Random(20)
    rules = [("allow", "good.net/"), ("block", "bad.net/"), ("block", "bad.net/x/"), ("allow", "bad.net/x/ok/")]
    hosts = ["good.net", "bad.net", "sub.bad.net", "a.org", "b.org", "c.org"]
    urls_ = [f"http://{rng.choice(hosts)}/{rng.choice(['', 'x/', 'x/ok/'])}{i}" for i in range(240)]
    pages, near = [], {u: set() for u in urls_}
    for i, u in enumerate(urls_):
        html = ""
        if rng.random() < 0.7:
            v = urls_[(i + 1) % 240] if rng.random() < 0.5 else rng.choice(urls_[i - i % 40 : i - i % 40 + 40])
            html = f'<link rel="canonical" href="{v}">' if rng.random() < 0.5 else f'<meta http-equiv="refresh" content="0; url={v}">'
            near[u].add(v)
            near[v].add(u)
        pages.append((i, u, html))

    def own(u):
        host, path = u[7:].split("/", 1)
        fits = [(len(r), what) for what, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    for i, u, _ in pages:
        seen, todo = {u}, [u]
        while todo:
            todo = [w for v in todo for w in near[v] if w not in seen and not seen.add(w)]
        told = {own(v) for v in seen} - {None} if len(seen) > 1 else set()
        assert got[i] == (own(u) or ("allow" if "allow" in told else "block" if "block" in told else "allow"))


# --- packing


@pytest.mark.parametrize("weights", [None, [0.7, 0.1, 0.2, 0.0001], [1, 1, 1, 1]])
def test_schedule_is_deficit_round_robin(weights):
    plan = packing.Schedule([1000, 260, 37, 5000], 16, weights)
    exact = [Fraction(w) for w in plan.weights]
    sent, order = [0] * 4, []
    while len(order) < sum(plan.counts):
        # The queue whose deficit reaches a half in the earliest round goes next.
        q = min((q for q in range(4) if sent[q] < plan.counts[q]), key=lambda q: ((sent[q] + Fraction(1, 2)) / exact[q], q))
        order.append((q, sent[q]))
        sent[q] += 1
    at = 0
    for q, j in order:
        assert plan.place([q], [j]).tolist() == [at]
        at += min(16, plan.totals[q] - 16 * j)
    assert at == plan.total


def test_windows_hold_the_target_proportions(spark):
    rng = random.Random(1)
    rows = [(i, _prose(rng, 200), "a" if i % 10 == 0 else "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    path = public_vocabulary("word_bpe_49k.json")
    pieces = packing.pack(docs, path, window=512, quantum=32, targets={"a": 0.5, "b": 0.5}).collect()
    total = {q: sum(p.length for p in pieces if p.queue == q) for q in "ab"}
    assert total["b"] > 5 * total["a"]
    shared = 2 * total["a"] // 512 - 1  # both sources have ids left up to here
    for s in range(shared):
        mine = sum(p.length for p in pieces if p.sequence_id == s and p.queue == "a")
        assert abs(mine - 256) <= 32
    natural = packing.pack(docs, path, window=512, quantum=32).collect()
    share = total["a"] / (total["a"] + total["b"])
    for s in range((total["a"] + total["b"]) // 512):
        mine = sum(p.length for p in natural if p.sequence_id == s and p.queue == "a")
        assert abs(mine - 512 * share) <= 64
    with pytest.raises(ValueError):
        packing.pack(docs, path, targets={"a": 0.0})


def test_word_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    path = public_vocabulary("word_bpe_49k.json")
    full, mine = Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = random.Random(2)
    signs = ["a", "B", "é", "Ñ", "ß", "ſ", " ", "  ", "\n", "\t", "1", "²", "'s", "'", "!", "<|", "|>", "İ", "日", "́", "<|endoftext|>", "startoftext"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(2000)] + ["a <|endoftext|> b", "<|ENDOFTEXT|>"]
    for text, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, mine.dtype).tolist() == full.encode(text, add_special_tokens=False).ids


# --- SentencePiece


def test_trellis_shared_by_runs_that_begin_alike():
    codec = spm.Codec(spm.Vocabulary.load(public_vocabulary("piece_bpe_32k.model")))
    rng = random.Random(3)
    runs = sorted({"".join(rng.choice("aeintr▁") for _ in range(rng.randint(1, 14))) for _ in range(1500)})
    for run in runs + runs[::-7]:
        assert codec.search.between(run) == codec.merges.merged(run)
    long = "".join(rng.choice("abcdefgh") for _ in range(400))
    search = codec.viterbi()
    assert codec.search.between(long) == search.feed(long) + search.finish()
    assert codec.search.widest < 200


# --- language identification


def test_long_words_are_learned(spark):
    rng = random.Random(4)
    text = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    zh = [text("日本語大学生中国人", 80) for _ in range(40)]
    en = [" ".join(text("etaoinsh", 5) for _ in range(16)) for _ in range(40)]
    rows = [(i, t, "zh" if i < 40 else "en") for i, t in enumerate(zh + en)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = langid.vocabulary(public_vocabulary("piece_bpe_32k.model"))
    model = langid.train(docs, pieces)
    few = langid.train(docs.unionByName(docs.limit(3).withColumn("lang", F.lit("rare"))), pieces, max_languages=2)
    assert model.languages == few.languages == ["en", "zh"]
    probes = [zh[0][:4], zh[1], text("日本語大学生中国人", 3000), en[0], "e" * 2000]
    assert model.predict(probes)[0] == ["zh", "zh", "zh", "en", "en"]


def test_long_words_count_like_short_ones(monkeypatch):
    vocab = langid.Pieces(["▁", "a", "b", "c", "ab", "▁a", "bca", "abc"])
    rng = random.Random(5)
    counts = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 20))): rng.randint(1, 5) for _ in range(60)}
    plain = langid.fit_pieces(counts, vocab)
    two = np.stack([plain, np.random.default_rng(0).dirichlet(np.ones(len(plain)))], 1)
    two[0] = 0.0
    likely = langid.log_likelihoods(list(counts), vocab, two)
    monkeypatch.setattr(langid, "LONG", 3)
    assert np.allclose(langid.fit_pieces(counts, vocab), plain)
    assert np.allclose(langid.log_likelihoods(list(counts), vocab, two), likely)
    assert np.isfinite(langid.log_likelihoods(["d" * 500], vocab, two)).all()


# --- top-k


def test_top_k_skips_unusable_rows_of_a_query(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(0, [None] + x[0].tolist()[1:]), (1, [float("nan")] * 8), (1, []), (0, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:2] + bad, "vec_id long, embedding array<double>")
    found = topk.top_k(vectors, asked, k=3).collect()
    scores = np.floor(1024 * x) @ np.floor(1024 * x).T
    for q in (0, 1):
        want = sorted((i for i in range(40) if i != q), key=lambda i: (-scores[q, i], i))[:3]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == want


# --- personal data


def test_whole_words_make_contexts():
    long = "x" * 70
    text = f"{'y' * 300} {long} reach 10.0.0.1 {'z' * 90} end"
    at = text.index("10.0")
    before, around = pii._context(text, at, at + 8)
    assert before == f"{long} reach _" and around == f"reach _ {'z' * 90}"
    assert pii._context("10.0.0.1", 0, 8) == ["  _", " _ "]
    far = pii._context(f"{'y' * 300} at 10.0.0.1", 304, 312)[0]
    assert far.startswith("#") and far != pii._context(f"{'y' * 301} at 10.0.0.1", 305, 313)[0]


def test_credentials_and_their_contexts(spark):
    rng = random.Random(7)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "a1"
    texts = [f'{_prose(rng, 8)} use token = "{key()}" to {_prose(rng, 4)}' for _ in range(8)]
    texts.append(f"{_prose(rng, 8)} use token = <{key()}> to {_prose(rng, 4)}")
    texts.append(f"{_prose(rng, 8)} commit {key()} was merged {_prose(rng, 4)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for i in range(9):
        kind, s, e = rows[i].spans.split(":")
        assert kind == "secret" and len(texts[i][int(s) : int(e)]) == 41 and rows[i].base == ""
    assert rows[9].spans == ""


def test_redaction_of_rows_without_ids_and_odd_names(spark):
    rng = random.Random(8)
    rows = [(i, f"{_prose(rng, 5)} please call me on +1 555 {200 + i} {4000 + i} today") for i in range(12)]
    rows += [(None, f"{_prose(rng, 5)} please call me on 555 867 5300 today"), (3, "please call me on 555 867 5301 today"), (None, None), (3, "")]
    docs = _odd(spark, rows)
    out = pii.redact(docs)
    assert out.schema == docs.schema
    texts = [r.text for r in out.collect()]
    assert len(texts) == len(rows) and not any("555" in (t or "") for t in texts) and None in texts and "" in texts
    assert {tuple(r)[5:] for r in out.collect()} == {ODD_VALUES}


# --- passages


def test_passages_go_where_rows_have_odd_names_and_ids(spark):
    rng = random.Random(9)
    shared = _prose(rng, 80)
    rows = [(1, f"{_prose(rng, 40)} {shared}"), (2, f"{shared} {_prose(rng, 40)}"), (None, shared), (4, None), (5, "")]
    docs = _odd(spark, rows)
    out = substring.remove_passages(docs, substring.shared_passages(docs))
    assert out.schema == docs.schema or out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[1].text == rows[0][1] and shared not in texts[2].text and texts[2].n_chars == len(texts[2].text)
    assert texts[None].text == shared and texts[4].text is None and texts[5].text == ""


def test_texts_that_share_an_id_are_cut_by_their_own_offsets(spark):
    rng = random.Random(21)
    shared, more = _prose(rng, 90), _prose(rng, 90)
    rows = [(1, f"{_prose(rng, 30)} {shared}"), (2, f"{_prose(rng, 40)} {shared} {_prose(rng, 20)}"), (2, _prose(rng, 200)), (2, _prose(rng, 30)), (3, f"{more} {_prose(rng, 50)}")]
    rows += [(4, f"{_prose(rng, 25)} {more}"), (4, f"{more} {_prose(rng, 35)}"), (None, shared), (5, None), (6, ""), (2, rows[2][1])]
    docs = _odd(spark, rows)
    numbers = [(r.row.doc_id, r.row.text, r.doc) for r in substring.numbered(docs).collect()]
    assert len(numbers) == len(rows) and len({n for _, _, n in numbers if n is not None}) == len({(i, t) for i, t in rows if i is not None and t is not None})
    assert {n for i, _, n in numbers if i in (1, 3, 6)} == {1, 3, 6} and all(2 in {n for i, _, n in numbers if i == 2} for _ in (0,))
    out = substring.cut_shared(docs)
    assert out.columns == docs.columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert len(texts) == len(rows)
    # What shares nothing stays whole, whatever the other texts of its id lose.
    for i in (2, 3, 10):
        assert (2, rows[i][1]) in texts
    assert (0, shared) in texts and (1, rows[0][1]) in texts and (3, rows[4][1]) in texts
    assert sum(shared in t for i, t in texts if i in (1, 2)) == 1 and sum(more in t for i, t in texts if i in (3, 4)) == 1
    assert sum(r.n_chars != len(r.text or "") for r in out.where("doc_id in (2, 4)").collect()) == 0


def test_seeds_carry_the_words_beside_them():
    rng = random.Random(14)
    words = [f"w{rng.randrange(500)}" for _ in range(300)]
    inner = words[100:200]
    for lead in (words[:100], ["other"] * 3, []):
        _, h, at, _, _, sides = substring.seeds_of([" ".join(lead + inner + words[200:]).encode()], 5, 12, 50)
        found = {(int(k), int(w) - len(lead)): int(x) for k, w, x in zip(h, at, sides)}
        inside = {k: v for k, v in found.items() if 4 <= k[1] <= 90}
        if lead == words[:100]:
            want = inside
        shared = [k for k in inside if k in want]
        assert len(shared) > 5 and all(inside[k] == want[k] for k in shared)
    assert all(v & 63 == 0 for (_, w), v in found.items() if w == 0)


def test_seeds_of_very_long_words(spark):
    rng = random.Random(15)
    shared = " ".join([_prose(rng, 25), "x" * 40_000, "y" * 40_000, _prose(rng, 60)])
    docs = spark.createDataFrame([(1, shared), (2, f"{_prose(rng, 30)} {shared}")], "doc_id long, text string")
    found = substring.shared_passages(docs).collect()
    assert found and all((r.doc_id, r.ref_doc_id) == (2, 1) for r in found)


# --- near-duplicates


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_any_key_layout_brings_near_fingerprints_together(radius):
    rng = random.Random(19)
    for count in (10, 10**8, 10**11, 10**16):
        masks = simhash._masks(count, radius)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), radius):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)
    assert len(simhash._masks(10**6, 3)) == 4 and len(simhash._masks(10**9, 3)) == 10


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(11)
    a, b = _prose(rng, 100), _prose(rng, 100)
    near = " ".join([*a.split()[:50], "changed", *a.split()[51:]])
    rows = [(7, a), (7, b), (7, b), (8, near), (9, b), (None, a), (None, None), (10, None), (11, "")]
    docs = _odd(spark, rows)
    out = simhash.drop_similar(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or -1), r.text or "") for r in out.collect()) == sorted([(7, a), (7, b), (-1, a), (-1, ""), (10, "")])
    assert simhash.drop_similar(docs.limit(0)).count() == 0


def test_minhashes_estimate_the_similarity():
    rng = random.Random(17)
    far = []
    for _ in range(120):
        words = _prose(rng, rng.randint(30, 300)).split()
        other = [w if rng.random() < 0.97 else "changed" for w in words]
        p, q = " ".join(words), " ".join(other)
        (a, n), (b, m) = simhash.minhashes(p.encode()), simhash.minhashes(q.encode())
        true, least = simhash.shingle_similarity(p, q), min(n, m)
        far.append((np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) - true) / np.sqrt(max(true * (1 - true), 0.01) / least))
    assert abs(np.mean(far)) < 0.4 and np.std(far) < 1.5 and max(map(abs, far)) < 5
    assert simhash.minhashes(None) == simhash.minhashes(b"  ") and simhash.minhashes(b"a b")[1] == 1


def test_a_family_without_a_middle_is_linked_exactly(spark):
    rng = random.Random(18)
    base = _prose(rng, 150).split()
    texts = []
    for _ in range(80):
        words = list(base)
        for i in rng.sample(range(150), rng.randint(1, 9)):
            words[i] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    up = list(range(80))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(80):
        for j in range(i):
            if simhash.shingle_similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = {i: root(i) for i in range(80)}
    assert sum(got[i] == want[i] for i in range(80)) >= 78 and len(set(want.values())) > 1


def test_recall_of_similar_groups(spark):
    rng = random.Random(12)
    texts, pairs = [], []
    for _ in range(300):
        words = _prose(rng, rng.randint(40, 120)).split()
        changed = list(words)
        changed[rng.randrange(len(words))] = "changed"
        p, q = " ".join(words), " ".join(changed)
        if simhash.shingle_similarity(p, q) >= 0.8:
            pairs.append((len(texts), len(texts) + 1))
        texts += [p, q]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 200 and found >= 0.95 * len(pairs)
    assert all(got[i] // 2 == i // 2 for i in got)


def test_parts_of_a_hot_box_meet(spark):
    rng = np.random.default_rng(16)
    base = rng.normal(size=(30, 16))
    x = np.repeat(base, 12, 0) + 0.15 * rng.normal(size=(360, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    key = lambda r: (r.vec_id, r.n_links, r.component_id, r.kept)
    whole = sorted(map(key, embed.near_duplicates(rows, 0.9).collect()))
    assert sorted(map(key, embed.near_duplicates(rows, 0.9, leaf_rows=20).collect())) == whole
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (y @ y.T >= 0.9).sum(1) - 1
    assert [w[1] for w in whole] == links.tolist()


# --- the pipeline's columns, workers


def test_language_stage_keeps_odd_columns(spark):
    rng = random.Random(13)
    docs = _odd(spark, [(i, _prose(rng, 30)) for i in range(40)] + [(None, _prose(rng, 30)), (99, None), (98, "12")])
    out = corpus_pipeline.language(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert len(rows) == 41 and {r.lang for r in rows} == {"en"} and {tuple(r)[5:] for r in rows} == {ODD_VALUES}


def test_workers_forget_after_each_task():
    path = public_vocabulary("word_bpe_49k.json")

    def run(batches):
        for batch in batches:
            yield pa.array([len(x) for x in packing._tokenizer(path).encode(batch)])

    worker = common.in_worker("packing", run, packing._forget, packing._leave)
    out = worker([["some words here", None]])
    assert next(out).to_pylist()[1] == 0
    assert packing._TOKENIZERS[path].words
    assert list(out) == [] and not packing._TOKENIZERS[path].words and not packing._TOKENIZERS[path].runs
    list(common.in_worker("other", lambda batches: batches)([]))
    assert not packing._TOKENIZERS


def test_vectors_are_shuffled_a_fixed_number_of_times(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[5990:] = x[:10] + 0.01
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")

    def shuffled():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    sent = []
    for leaf in (4000, 500):
        before = shuffled()
        got = {r.vec_id: r for r in embed.near_duplicates(rows, 0.9, leaf_rows=leaf).collect()}
        sent.append((shuffled() - before) / x.nbytes)
        assert all((got[i].n_links, got[5990 + i].component_id) == (1, i) for i in range(10))
    # As many more parts, no more copies of a vector.
    assert max(sent) < 4, sent

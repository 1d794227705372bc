"""Merge rounds, periodic runs and ranked search against libraries, brute force and awkward inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from tidewater.llm import decontamination, impact_index, merge_rounds, periodic_runs  # noqa: E402
from tidewater.llm import queries as llm_queries  # noqa: E402

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, ids string, decoded string, runs string, collapsed string, n_words string, score string, rank string, terms string, doc string"


def odd_documents(spark):
    texts = ["", None, " ", "word", "a\n\nb\n", "x" * 100_000, "la " * 20_000, "é ü 漢字 😀 \x1c\x85 ▁ \x01", " \t\r\n\x0b\x0c "]
    rows = [(i, t, *["x"] * 9) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id word", *[None] * 9), (None, None, *[None] * 9)]
    return spark.createDataFrame(rows, CLASH)


# --- 11 periodic runs --------------------------------------------------------------------------------------


def brute_runs(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, exponent * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_match_brute_force():
    rng = random.Random(11)
    for k in range(3000):
        letters, w = rng.choice(["a", "ab", "abc", "abcdef"]), []
        if k % 3:
            w = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        else:
            while len(w) < rng.randint(5, 120):
                w += [rng.choice(letters) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
        for exponent, least in ((4, 6), (2, 2), (3, 5)):
            assert periodic_runs.runs_of(w, exponent, least) == brute_runs(w, exponent, least)


def test_long_runs_and_many_runs_end():
    assert periodic_runs.runs_of(["a"] * 200_000) == [(0, 200_000, 1)]
    a, b = ["a"], ["a", "b"]
    while len(b) < 50_000:
        a, b = b, b + a
    assert len(periodic_runs.runs_of(b, 2, 2)) > 30_000 and periodic_runs.runs_of(b) == []


def test_a_collision_starts_again(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_MOD", 3)  # nearly every comparison collides
    w = list("xabababababyabcabcabcabcz" * 2)
    monkeypatch.setattr(periodic_runs, "_powers", {})
    numbers = [ord(c) for c in w]
    with pytest.raises(periodic_runs._Collision):
        for base in range(3, 30):
            periodic_runs._scan(numbers, 4, 6, base)
    monkeypatch.undo()
    assert periodic_runs.scan(numbers) == brute_runs(numbers)


def test_stretches_keep_every_run():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randint(0, 30) for _ in range(200)]
        at = rng.randint(0, 150)
        w[at : at + 24] = [rng.randint(0, 3), 7, 8] * 8
        bounds = periodic_runs.stretches(np.array(w), 4, 6)
        assert all(any(a <= s and s + n <= b for a, b in bounds) for s, n, _ in brute_runs(w))


def test_runs_take_odd_rows(spark):
    got = {(r.doc_id, r.n_words): r for r in periodic_runs.annotate(odd_documents(spark)).collect()}
    assert got[6, 20_000].runs[0].asDict() == {"start": 0, "length": 20_000, "period": 1} and got[6, 20_000].collapsed == "la"
    assert got[1, 0].runs == [] and got[1, 0].collapsed == "" and got[8, 0].collapsed == ""
    assert got[4, 2].collapsed == "a b" and got[None, 3].collapsed == "null id word" and got[0, 0].score == "x"
    assert periodic_runs.annotate(odd_documents(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.annotate(odd_documents(spark), exponent=1)


def test_run_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in llm_queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    sha, planted = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for d in docs:
        w = [x.decode() for x in (d.text or "").encode().split()]
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p, planted = 1 + (n - a) // (3 + g % 8), planted + 1
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w) if n < 3000 else periodic_runs.runs_of(w)
        cut = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        want = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == sha("".join(f"{s},{size},{q}\n" for s, size, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in cut))
    assert planted > 5


# --- 12 merge rounds ---------------------------------------------------------------------------------------


def fuzzed(n):
    rng = random.Random(12)
    bits = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "\x01", "\x00", "漢", "字", "😀", "é", "1", "23", ".", ",", "((", "x" * 20, " " * 40, "<s>",
            "<0x0A>", "\r", "　", "http://", "tion", "aaaa"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    texts += ["".join(rng.choice("abcdeinorst ") for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += ["".join(rng.choice("abcdeinorst") for _ in range(3000)), "a" * 3000, " " * 3000 + "x", "ab" * 2000, "", " "]
    return texts


@pytest.mark.parametrize("long", [512, 4])
def test_ids_are_the_librarys(monkeypatch, long):
    monkeypatch.setattr(merge_rounds, "LONG", long)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own, back = merge_rounds.WordEncoder(merge_rounds.Merger(*merge_rounds.read_model(MODEL))), merge_rounds.WordDecoder(MODEL)
    texts = fuzzed(2000)
    ids = merge_rounds._lists(own.encode(texts))
    assert ids.to_pylist() == lib.encode(texts)
    assert back.decode(ids).to_pylist() == lib.decode(ids.to_pylist())
    assert own.encode([None, ""]).to_pylist() == [b"", b""] and own.encode([]).to_pylist() == []


def test_a_hundred_thousand_letters_without_a_blank():
    rng = random.Random(5)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = merge_rounds.encoder(MODEL)
    for text in ("".join(rng.choice("ABCDEFabcdef0123456789/+ghijk") for _ in range(100_000)), " " * 100_000, "漢字" * 50_000):
        assert merge_rounds._lists(own.encode([text])).to_pylist() == [lib.encode(text)]


def test_any_ids_decode_as_in_the_library():
    rng = random.Random(6)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), merge_rounds.WordDecoder(MODEL)
    ids = [[rng.choice([0, 1, 2, 3, 50, 200, 259, 260, 300, 5000, 28705, 13]) for _ in range(rng.randint(0, 8))] for _ in range(2000)]
    assert own.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [lib.decode(i) for i in ids]
    for bad in (-1, 32_000):
        with pytest.raises(ValueError):
            own.decode(pa.array([[bad]], pa.list_(pa.int32())))


def test_other_models_are_refused(tmp_path):
    raw = open(MODEL, "rb").read()
    pieces, _, _ = merge_rounds.read_model(MODEL)
    changed = tmp_path / "m.model"
    changed.write_bytes(raw + b"\x12\x02\x18\x01")  # a trainer field that says unigram
    with pytest.raises(ValueError):
        merge_rounds.read_model(str(changed))
    assert len(pieces) == 32_000


def test_pieces_take_odd_rows(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = odd_documents(spark)
    out = merge_rounds.encode(df, MODEL, decoded_col="decoded")
    rows = out.collect()
    assert len(rows) == df.count() and set(out.columns) == set(df.columns)
    for r in rows:
        want = lib.encode(r.text or "")
        assert r.ids == want and r.decoded == lib.decode(want)
    again = merge_rounds.decode(merge_rounds.encode(df, MODEL), MODEL).collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in rows)
    assert merge_rounds.encode(df.limit(0), MODEL).count() == 0


def test_piece_query_matches_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = llm_queries.op12_sentencepiece(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


# --- 13 ranked search --------------------------------------------------------------------------------------


def brute_ranking(docs, items, k=10):
    counts = [(d, Counter(decontamination.words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = decontamination.words(text), []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // total
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("chars", [2_000_000, 400])
def test_ranking_matches_brute_force(spark, monkeypatch, chars):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "漢字", "A1"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 63])]) for _ in range(rng.randint(0, n)))
    docs = [(i, text(40)) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(5000, None), (5001, ""), (None, docs[6][1]), (7, docs[7][1])]
    rng.shuffle(docs)
    items = [(f"i{k}", text(30)) for k in range(40)] + [("null", None), ("many", "w1 " * 37), ("none", "nowhere to be found"), ("most", "W0 w1 w2")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, rank int")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in impact_index.rank(d, q, block_chars=chars).collect())
    assert got == sorted(brute_ranking(docs, items), key=lambda r: r[:2])


def test_ranking_over_several_blocks_and_ties(spark):
    # more documents than a block holds, all alike: the smallest ids win
    d = spark.range(5000).selectExpr("4999 - id AS doc_id", "'same words here' AS text").coalesce(2)
    d = d.unionByName(spark.range(3000).selectExpr("-1 - id AS doc_id", "'other' AS text"))
    q = spark.createDataFrame([(1, "same same")], "item_id long, text string")
    got = impact_index.rank(d, q).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(10)) and len({r.score for r in got}) == 1


def test_ranking_takes_odd_rows(spark):
    d = odd_documents(spark)
    q = spark.createDataFrame([(1, "word"), (2, None), (3, "x" * 100_000), (1, "word")], "item_id long, text string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in impact_index.rank(d, q).collect()]
    assert sorted(got, key=str) == sorted([(1, i + 1, x) for i, x in enumerate((3, 3, 3, None))] * 2 + [(3, 1, 5)], key=str)
    assert impact_index.rank(d.limit(0), q).count() == 0 and impact_index.rank(d, q.limit(0)).count() == 0


def test_best_of_slices():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 50, (20, impact_index.BLOCK)) * rng.integers(0, 2, (20, impact_index.BLOCK))
    total = np.array([np.packbits(((scores >> s) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for s in range(6)])
    query, place, score = impact_index.best(total, 10)
    for q in range(20):
        want = sorted((-v, i) for i, v in enumerate(scores[q].tolist()) if v)[:10]
        own = sorted((-s, p) for s, p in zip(score[query == q].tolist(), place[query == q].tolist(), strict=True))
        assert own == want

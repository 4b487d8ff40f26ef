"""Token files, token alignment and periodic runs against plain Python and the libraries themselves."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from quillmark.llm import _perfect_hash as H  # noqa: E402
from quillmark.llm import periodic_runs as R  # noqa: E402
from quillmark.llm import queries as Q  # noqa: E402
from quillmark.llm import token_alignment as A  # noqa: E402
from quillmark.llm import token_files as T  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "a b  c<|endoftext|> d <s> </s> <unk>", "", None, "İ ΣΑΣ Σ x́ ́y ᄀ ᅡ", "  a\x1cb\x85c \x85d  　 e", "word" * 500, " lead", "trail ", "trail  x", " ", "  ", "\n x\n  y \n\n", "a▁b c",
    "日本語 テスト 日本 語", "naïve été à l'été, it's we'll.", "don't 's x's  's", "é é", "ok ok ok", "\x00 a\x00b", "👍🏽 👍 a👍", "A<|ENDOFTEXT|>b, c.d!e (f) g:h", "ok ok ok",
]


def documents(spark, texts=TEXTS):
    """With a repeated row, a null id, and columns of clashing names."""
    rows = [(i, t, 9, "x") for i, t in enumerate(texts)] + [(0, texts[0], 9, "x"), (None, "z y", 1, "y"), (3, "dup", 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, n string"), [(r[0], r[1]) for r in rows]


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(0, 9, 40)
        ranks = (rng.integers(0, 1 << 32, sizes.sum()) >> rng.integers(0, 32, sizes.sum())).astype(np.uint32)
        control, data = T.pack(ranks, sizes)
        assert (T.unpack(control, data, sizes) == ranks).all()
        assert len(control) == ((sizes + 3) // 4).sum() and len(data) == sum(1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF) for r in ranks.tolist())


def whole_ids(texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(WORDS)
    return [known.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("block_ids", [3, 1 << 19])
def test_token_files(spark, tmp_path, block_ids):
    docs, rows = documents(spark)
    out = str(tmp_path / "ids")
    T.write_token_files(docs, WORDS, out, end_id=2, block_ids=block_ids)
    got = sorted(T.read_token_files(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist() and all(r.n_tokens == len(r.ids) for r in got)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids)) for (i, _), ids in zip(rows, whole_ids([t for _, t in rows])))
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in T.token_digest(spark, out).collect()}
    assert digest == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    ranked = spark.read.parquet(f"{out}/vocabulary").orderBy("rank").collect()
    counts = Counter(i for r in got for i in r.ids)
    assert len(ranked) == 49408 and [(r.id, r.n) for r in ranked[: len(counts)]] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def test_token_files_damaged_and_empty(spark, tmp_path):
    docs, _ = documents(spark)
    T.write_token_files(docs.limit(0), WORDS, str(tmp_path / "none"), end_id=2)
    assert T.read_token_files(spark, str(tmp_path / "none")).count() == 0
    T.write_token_files(docs, WORDS, str(tmp_path / "ids"), end_id=2)
    name = next(f for f in os.listdir(tmp_path / "ids") if f.endswith(".ids"))
    data = bytearray((tmp_path / "ids" / name).read_bytes())
    data[-1] ^= 1
    (tmp_path / "ids" / name).write_bytes(data)
    with pytest.raises(Exception, match="damaged block"):
        T.read_token_files(spark, str(tmp_path / "ids")).collect()
    with pytest.raises(ValueError):
        T.encode_words(docs.selectExpr("cast(doc_id as string) doc_id", "text"), WORDS)


def test_query_op11(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    want, start = {}, 0
    for r, ids in zip(docs, whole_ids([r.text for r in docs])):
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op11_token_files(spark, DATA).collect()} == want


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 52, n))
        made = H.PerfectHash.build(keys)
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 1 << 52, 1000), keys)
        assert (made.slots(others) == -1).all()
        again = H.ManyHashes([made.dump(), H.PerfectHash.build(keys + (1 << 53)).dump()])
        assert (again.slots(keys, np.zeros(len(keys), int)) == made.slots(keys)).all()
        assert (again.slots(keys, np.ones(len(keys), int)) == -1).all()
        assert sorted(again.slots(keys + (1 << 53), np.ones(len(keys), int)).tolist()) == list(range(len(keys), 2 * len(keys)))


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_known, b_known = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_known.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    names = {i: t for t, i in a_known.get_vocab().items()}
    a_bytes = lambda i: bytes(letter[c] for c in names[i])

    def b_bytes(i):
        piece = b_known.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    told, counts = [], Counter()
    for t in texts:
        a = a_known.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_known.encode(t) if t else []
        if not t or not (b"".join(map(a_bytes, a)) == (" " + t).encode() == b"".join(map(b_bytes, b))):
            told.append(None)
            continue
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for ids, f in ((a, a_bytes), (b, b_bytes))]
        begin = [[0, *e[:-1]] for e in ends]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if begin[0][i] < ends[1][j] and begin[1][j] < ends[0][i]]
        groups, last = [], (0, 0)
        for cut in sorted(set(ends[0]) & set(ends[1])):
            now = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[last[0] : now[0]])) + "|" + ",".join(map(str, b[last[1] : now[1]])))
            last = now
        counts.update(links)
        told.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = [(0,) * 6 + ("",) if x is None else (*x[:3], len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in told]
    return rows, counts, top


def test_alignment(spark):
    rnd = random.Random(2)
    letters = list(" \n\t  ab'sé日  ▁1.,-x!?") + ["the ", "word, "]
    docs, rows = documents(spark, TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(400)])
    want, counts, top = brute_alignment([t for _, t in rows])
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for block_pairs in (4_000_000, 60):  # one broadcast, and several
        got = A.align_tokens(docs, BYTES, PIECES, block_pairs=block_pairs).collect()
        assert Counter((r.doc_id, *(r[c] for c in columns)) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want))
    pairs = {(r.a_id, r.b_id): (r.n, r.best) for r in A.pair_counts(A.pair_tables(docs, BYTES, PIECES)).collect()}
    assert pairs == {p: (n, n == top[p[1]]) for p, n in counts.items()}
    assert A.align_tokens(docs.limit(0), BYTES, PIECES).count() == 0


def test_query_op12(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "")[:600]) for r in docs.collect()]
    want, _, _ = brute_alignment([t for _, t in rows])
    got = {r.doc_id: tuple(r)[1:] for r in A.align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, PIECES).collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}
    out = Q.op12_token_alignment(spark, DATA)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and out.count() == 200


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs(spark):
    rnd, texts = random.Random(6), [None, "", " \n", "a " * 5, "a " * 6, "ab\tab\nab ab ab ab ab", "x é é é é é é y", "z " * 3000 + "y " * 6]
    for _ in range(600):
        k = rnd.randrange(1, 5)
        w = [str(rnd.randrange(k)) for _ in range(rnd.randrange(60))]
        period = [str(rnd.randrange(k)) for _ in range(rnd.randrange(1, 8))]
        w = w[: rnd.randrange(20)] + (period * 9)[: rnd.randrange(60)] + w[: rnd.randrange(9)]
        texts.append(rnd.choice([" ", "  ", "\n"]).join(w * rnd.choice([1, 1, 1, 5])))
    docs, rows = documents(spark, texts)
    got = R.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        words = (t or "").encode().split()
        runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        by.setdefault(i, []).append((len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256))
    assert {i: sorted(x, key=str) for i, x in seen.items()} == {i: sorted(x, key=str) for i, x in by.items()}
    assert R.periodic_runs(docs.limit(0)).count() == 0


def test_runs_of_long_texts():
    rng = np.random.default_rng(3)
    for words, want in ((np.zeros(100_000, np.uint64), (0, 100_000, 1)), (np.tile(rng.integers(0, 1 << 60, 20_000).astype(np.uint64), 5), (0, 100_000, 20_000))):
        assert [tuple(int(x[0]) for x in R.find_runs(words, np.array([0, len(words)])))] == [want]


def test_words_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(R.Words, "hashes", lambda self, double=False: np.zeros(len(self), np.uint64))
    from quillmark.llm._words import SPACED, Words, utf8
    import pyarrow as pa

    raw, off = utf8(pa.array(["a b a b a b a b a b c d e f g h i"]))
    w = Words(raw, off, SPACED)
    s, n, q = R.document_runs(w, np.arange(len(w)), w.first)
    assert list(zip(s.tolist(), n.tolist(), q.tolist())) == [(0, 10, 2)]


def test_query_op13(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    cur = con.execute(Q.oracle_sql()["op13_periodic_runs"])
    names = [c[0] for c in cur.description]
    got = Q.op13_periodic_runs(spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, cur.fetchall()))

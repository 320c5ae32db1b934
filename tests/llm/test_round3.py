"""Clustering, packing and alignment against brute force, on odd rows."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import alignment, centroids, packing, toxicity

WORDS = "The of and to In is it that; for on with 'tis as was at by_this be or FROM 12 don't naïve 日本 x<|endoftext|>y".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (str(rng.integers(9)) if i % 3 == 0 else "") for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i, 5 + 37 * i)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " "), (103, " \n\t x  y \n"), (104, " " * 5000 + "a"), (105, "▁under"), (106, "é ﬁ \x00\x1c\x85 ١٢"), (107, prose(7, 9000)), (108, "a" * 20000), (None, "no id"), (None, "no id"), (40, prose(3, 116)), (109, "<0x41> <s> <|startoftext|>"), (110, "a b 　 c ")]
    return spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, length int, part string").repartition(5)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11


def clusters(rows, k, rounds, dim, scale, seed):
    """Plain integers, all distances."""
    kept = [(i, [int(np.floor(scale * float(a))) for a in x]) for i, x in rows if x is not None and len(x) == dim and all(a is not None and np.isfinite(a) for a in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assigned()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found, per = assigned(), Counter()
    for d, j in found:
        per[j] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, per[j], sum(per.values()), shas[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=repr)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 0.3 + (i % 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(7, rows[8][1]), (7, rows[9][1]), (None, rows[2][1]), (2000, None), (2001, []), (2002, [1.0] * 7), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8), (2005, [float("inf")] + [0.0] * 7), (2006, [0.0] * 8), (2007, [-1e30] + [0.0] * 7)]
    return spark.createDataFrame([(i, x, 3) for i, x in rows], "vec_id long, embedding array<double>, cluster int").repartition(6)


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 6), (1, 1), (500, 2)])
def test_clusters(points, k, rounds):
    points = points.where("vec_id is null or vec_id <> 2007")
    want = clusters([(r.vec_id, r.embedding) for r in points.collect()], k, rounds, 8, 64, 1)
    assert collected(centroids.digests(points, k=k, rounds=rounds, dim=8, segments=4)) == want


def test_screening_measures_few(points):
    rows, centres = centroids.clustered(points, k=16, dim=8, segments=4)
    measured = [r.measured for r in rows.collect()]
    assert len(centres) == 16 and min(measured) >= 1 and sum(measured) < 0.6 * 16 * len(measured)
    assert {r.distance for r in rows.where("vec_id = 2007").collect()} != set()  # beyond the range: counted at its end
    assert sorted(rows.columns) == ["cluster", "distance", "measured", "vec_id"]


def test_bounds_are_below(spark):
    rng = np.random.default_rng(3)
    for scale in (1, 1000, 1 << 26):
        x, c = (rng.integers(-scale, scale + 1, (200, 64)) for _ in range(2))
        c[:50] = x[:50]
        low = centroids.lower_bounds(centroids.segment_norms(x, 8), centroids.segment_norms(c, 8))
        assert (low <= ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2).astype(float)).all()


def test_no_vectors(points):
    assert centroids.digests(points.limit(0), dim=8).count() == 0
    assert centroids.digests(points.where("vec_id in (2000, 2001)"), dim=8).count() == 0


# 12


def ids_of(docs, end):
    t = Tokenizer.from_file(packing.TOKENIZER)
    return Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, end])) for r in docs.collect())


def check_packing(rows, docs, size, end=1):
    by, per = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= size and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by[r.doc_id].append(r)
        per[r.sequence_id].append(r)
    for pieces in per.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    want = ids_of(docs, end)
    for (i, ids), n in want.items():
        if i is not None and n == 1:
            pieces = sorted(by[i], key=lambda r: r.start)
            assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
            assert tuple(np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()) == ids
            assert {r.doc_tokens for r in pieces} == {len(ids)}
    total = sum(n * len(ids) for (_, ids), n in want.items())
    assert sum(r.length for r in rows) == total
    filled = [sum(r.length for r in p) for p in per.values()]
    return sum(0 if n & (n - 1) == 0 else size - n for n in filled) / total


@pytest.mark.parametrize("size,windows,parts", [(2048, 64, 5), (64, 4, 90), (100, 1, 3), (16, 3, 200)])
def test_packing(docs, size, windows, parts):
    out = packing.packed(docs.repartition(parts), keep=["doc_id", "part", "length"], size=size, windows=windows, slack=size // 64)
    assert out.columns == ["doc_id", "part", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert check_packing(out.collect(), docs, size) < 0.02


def test_packing_of_nothing(docs):
    assert packing.packed(docs.limit(0)).count() == 0
    one = packing.packed(docs.where("doc_id = 100"), keep=[], with_ids=False).collect()
    assert [tuple(r) for r in one] == [(0, 1, zlib.crc32(np.array([1], "<u4").tobytes()), 1, one[0].sequence_id, 0)]


def test_encoder(docs):
    e = packing.Encoder(open(packing.TOKENIZER, "rb").read())
    rng = np.random.default_rng(5)
    letters = [*"abcdeostrvmlABZ'\"!.,;:<|>{}~-_0123456789 \t\n\r\x0b\x0c", *"\x00\x01\x02\x1c\x1f\x7f\x85\xa0", *"ÀÉÖ×ØÜßàéö÷øüÿ", *"Āſẞ\u0301Σσ\u2028日'sİ"]
    texts = [r.text or "" for r in docs.collect()] + ["".join(rng.choice(letters[: int(rng.choice([30, 45, 53, 66, len(letters)]))], int(n))) for n in rng.integers(1, 60, 3000)]
    texts += ["it's 'sfoo !'s 'LL x'dy ''s 's's we're'", "<|startoftext|>a<|endoftext|>", "Straße ÀÉ ÿ 1234 a1b2"]
    want = [[*x.ids, 9] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.fast and [x.tolist() for x in e(texts, 9)] == want
    e.fast = None
    assert [x.tolist() for x in e(texts, 9)] == want


# 13


def links(rows):
    a = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    vocab = json.load(open(alignment.BYTE_LEVEL))["model"]["vocab"]
    spell_a = {i: bytes(letters[c] for c in k) for k, i in vocab.items() if k != "<|endoftext|>"}
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)

    def spell_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, count = [], Counter()
    for i, t in rows:
        t = t or ""
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        want = (" " + t).encode()
        if b"".join(spell_a[j] for j in x) != want or b"".join(map(spell_b, y)) != want:
            x = y = []
        ends = [dict(zip(np.cumsum([len(s(j)) for j in ids]).tolist(), range(len(ids)), strict=True)) for ids, s in ((x, spell_a.get), (y, spell_b))]
        groups, found, p, q = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0][cut] + 1, ends[1][cut] + 1
            groups.append(",".join(map(str, x[p:m])) + "|" + ",".join(map(str, y[q:n])))
            found.append((x[m - 1], y[n - 1]))
            p, q = m, n
        count.update(found)
        out.append((i, len(x), len(y), len(groups), found, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return sorted(((i, m, n, g, len(f), sum(count[z] == top[z[1]] for z in f), sum(count[z] for z in f), h) for i, m, n, g, f, h in out), key=repr)


@pytest.mark.parametrize("hot", [1 << 18, 20, 0])
def test_alignment(docs, hot):
    want = links([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[1] == 0 for r in want) >= 3
    assert collected(alignment.digests(docs, keep=["doc_id"], hot=hot)) == want


def test_alignment_of_nothing(docs):
    assert alignment.digests(docs.limit(0)).count() == 0
    assert {r.n_a for r in alignment.digests(docs.where("doc_id in (100, 101, 105)")).collect()} == {0}


def test_alignment_keeps_columns(docs):
    other = docs.selectExpr("doc_id", "text", "length as pairs", "part as cnt", "1 as row", "2 as pair")
    out = alignment.digests(other, text_col="text", keep=["doc_id", "cnt", "row", "pair"])
    assert out.columns == ["doc_id", "cnt", "row", "pair", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.where("cnt = 'k' and row = 1 and pair = 2").count() == docs.count()


def test_units_are_forgotten(docs):
    x = alignment.Aligner(*(open(f, "rb").read() for f in (alignment.BYTE_LEVEL, alignment.PIECES)))
    texts = [r.text or "" for r in docs.collect()]
    whole = x(texts)
    x.units.most = 3
    for i, t in enumerate(texts):
        one = x([t])
        assert [c[0] for c in one[:5]] == [c[i] for c in whole[:5]]
        assert one[5][0].tolist() == whole[5][i].tolist()


def test_ranks():
    ends = np.array([0, 3, 7, 8, 9, 31, 32])
    bits = alignment.Bits(ends, 40)
    at = np.arange(40)
    assert bits.rank(at).tolist() == [int((ends <= i).sum()) for i in at]


# 1


def test_a_long_labelled_row_leaves_the_classifier_as_it_is(spark):
    rng = np.random.default_rng(6)
    kinds = (["good", "fine", "nice"], ["vile", "nasty", "foul"])
    rows = [(i, " ".join(rng.choice([*kinds[i % 2], "the", "a", "of"], 12)), "en") for i in range(120)]
    long = [(1000 + i, "word " * 900, "en") for i in range(6)]
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows + long], "doc_id long, toxic int")
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string")
    plain, with_long = (toxicity.train(frame(r), labels, most_words=1600, most_row_words=400) for r in (rows, rows + long))
    scores = [{r.doc_id: r.score for r in toxicity.score(frame(rows + long), m).collect()} for m in (plain, with_long)]
    assert max(scores[1][i] for i in range(120)) - min(scores[1][i] for i in range(120)) > 0.2
    assert all(abs(scores[0][i] - scores[1][i]) < 0.2 for i in range(120)) and len(scores[1]) == 126


def test_ends_of_keys_are_merged_by_slice_and_over_all(spark):
    """A key that all rows have leaves each slice once, and grouping sends rows as they are: no hash map holds a map task's keys."""
    from graphloom.llm import ngram_join

    key, lo, hi = ngram_join.ends_of(np.array([5, 3, 5, 5], np.int64), np.array([2, 9, 1, 7], np.int64))
    assert (key.tolist(), lo.tolist(), hi.tolist()) == ([3, 5], [9, 1], [9, 7])
    assert [len(x) for x in ngram_join.ends_of(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]
    df = spark.createDataFrame([(1, 4, 4), (1, 2, 3), (2, 8, 8)], "x long, lo long, hi long").repartition(3)
    out = ngram_join.ends_by(df, "x", 3)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 4), (2, 8, 8)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.index("REPARTITION") > plan.rindex("partial_min")  # the exchange lies below both aggregates

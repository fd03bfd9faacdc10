"""Operators on texts against the libraries and brute force, on a fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_repeats, jaccard_join, line_quality, sentence_pieces, token_files, word_tokens
from graphloom.llm.queries import PIECES, WORDS, vocabulary

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgéüßñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(120), say(40)
    rows = [(0, base), (1, base.replace(" ", "\n", 3)), (2, base + " tail words here"), (3, say(30) + " " + passage + " " + say(30)), (4, passage), (5, say(8) + "\t" + passage + "  " + say(9))]
    rows += [(6, None), (7, ""), (8, "  \n "), (9, "one two"), (10, "one two"), (11, say(3000)), (12, "ab" * 3000), (13, base), (14, base), (14, base), (14, say(50)), (None, base), (None, None)]
    rows += [(15, "It's <|endoftext|> X▁Y  z. ÄÖ, (foo)!!! 3,141 中文字 á İ ς\x1c"), (16, "WIN!! " * 60), (17, " ".join(w + "***" for w in say(60).split())), (18, say(12) + "\n" + say(12) + "\n" + say(12)), (19, "a  b "), (20, " " * 50)]
    tokens = base.split()
    rows += [(21, " ".join(tokens[:60] + ["new"] + tokens[61:])), (22, " ".join(tokens[:20] + [say(1)] + tokens[21:90] + [say(1)] + tokens[91:]))]
    return rows + [(100 + k, say(r.randint(1, 60))) for k in range(25)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame([(d, t, "en", "s", 1, 9) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_words long, n_tokens int")
    return frame.repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_pieces(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    want = []
    for d, t in ROWS:
        ids = model.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = sentence_pieces.round_trip(docs, vocabulary(PIECES))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    both = sentence_pieces.encode(docs.withColumn("decoded", F.lit(1)), vocabulary(PIECES), decoded="decoded")
    apart = sentence_pieces.decode(sentence_pieces.encode(docs, vocabulary(PIECES)), vocabulary(PIECES))
    assert both.columns == apart.columns
    assert sorted(map(tuple, both.select("doc_id", "ids", "decoded").collect()), key=key) == sorted(map(tuple, apart.select("doc_id", "ids", "decoded").collect()), key=key)
    over = sentence_pieces.encode(docs, vocabulary(PIECES), decoded="text")
    assert sorted(over.columns) == sorted([*docs.columns, "ids"])
    assert sorted(map(str, over.select("text").collect())) == sorted(map(str, apart.select(F.col("decoded").alias("text")).collect()))
    assert sentence_pieces.encode(empty, vocabulary(PIECES)).columns == [*docs.columns, "ids"]
    assert sentence_pieces.round_trip(empty, vocabulary(PIECES)).count() == 0
    lists = docs.sparkSession.createDataFrame([(1, [259, None, 264]), (2, None)], "k int, ids array<int>")
    assert sorted(r.decoded for r in sentence_pieces.decode(lists, vocabulary(PIECES)).collect()) == ["", model.decode([259, 264])]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORDS))


def test_token_counts(docs, empty):
    tk = tokenizer()
    want = [(d, len((t or "").encode()), n := len(tk.encode(t or "", add_special_tokens=False).ids), n > 100) for d, t in ROWS]
    got = word_tokens.token_counts(docs, vocabulary(WORDS), limit=100, keep=50)
    assert got.columns == ["doc_id", "lang", "source", "n_words", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=key) == sorted(want, key=key)
    assert word_tokens.token_counts(empty, vocabulary(WORDS)).count() == 0


def test_random_texts_without_spark():
    import numpy as np
    import pyarrow as pa

    from graphloom.llm.common import text_slices

    r = random.Random(1)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "it's", "foo", "Bar,", "é.", "(x)", "...", "9", " ", "\n", "  ", *"abZÉéßſıİŉ’.,!?<|>-_*#09ÀǅΣσς́\t\x85\x1c中ا¿×÷▁"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    v, p = word_tokens.Vocabulary(vocabulary(WORDS)), sentence_pieces.Pieces(vocabulary(PIECES))
    assert not v.whole and not p.whole
    for table, encode in ((v, lambda t: v.tokenizer.encode(t, add_special_tokens=False).ids), (p, p.model.encode)):
        table.table.capacity = 500  # fills up and starts anew, within a slice too
        for a, b, raw, off in text_slices(pa.array(texts), 2000):
            ids, counts = table.ids(raw, off)
            ends = np.cumsum(counts)
            for k in range(b - a):
                assert ids[ends[k] - counts[k] : ends[k]].tolist() == encode(texts[a + k])


def test_token_files(docs, empty, tmp_path):
    import pyarrow.parquet as pq

    tk = tokenizer()
    named = docs.where("doc_id IS NOT NULL AND doc_id <> 14")
    rows = sorted((d, t) for d, t in [(d, t or "") for d, t in ROWS if d is not None and d != 14])
    want, start = [], 0
    for d, t in rows:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    path = token_files.write_token_ids(named, vocabulary(WORDS), str(tmp_path / "t"))
    spark = docs.sparkSession
    assert sorted(map(tuple, token_files.crc32_of_tokens(token_files.read_token_ids(spark, path)).collect())) == want
    file = next((tmp_path / "t").glob("part-*"))
    column = {c.path_in_schema: c for g in range(1) for c in [pq.ParquetFile(file).metadata.row_group(0).column(k) for k in range(5)]}
    assert column["doc_id"].has_offset_index and "DELTA_BINARY_PACKED" in column["doc_id"].encodings and column["tokens.list.element"].has_dictionary_page
    one = token_files.read_token_ids(spark, path, ("doc_id", "n_tokens"), F.col("doc_id") == 11)
    assert [tuple(r) for r in one.collect()] == [(w[0], w[2]) for w in want if w[0] == 11]
    plan = token_files.read_token_ids(spark, path, ("doc_id", "start"))._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan
    assert token_files.round_trip(docs, vocabulary(WORDS)).count() == len(ROWS)
    assert token_files.round_trip(empty, vocabulary(WORDS)).count() == 0


def base_counts(t):
    w = words(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered, seen, lines = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(i, i + 5))
    for line in (t or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), lines, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(docs, empty):
    model = line_quality.PRIOR
    rated = line_quality.rate(docs, model)
    rows = rated.select("doc_id", *[c for c in line_quality.COLUMNS if c not in ("n_content_words", "kept")]).collect()
    assert sorted(map(tuple, rows), key=key) == sorted([(d, *base_counts(t)) for d, t in ROWS], key=key)
    kept = {r.doc_id for r in rated.where("kept").collect()}
    assert {0, 3, 11, 18} <= kept and not kept & {6, 7, 8, 9, 16, 17}
    assert line_quality.rate(empty, model).count() == 0
    labels = docs.select("doc_id", F.when(F.col("doc_id") == 17, 0).when(F.col("doc_id") < 14, 1).alias("quality"))
    assert line_quality.fit(docs, labels.limit(0)).weights is line_quality.PRIOR.weights and line_quality.fit(empty, labels).weights is line_quality.PRIOR.weights
    fitted = line_quality.fit(docs, labels)
    assert 17 not in {r.doc_id for r in line_quality.rate(docs, fitted).where("kept").collect()}


def test_viterbi_is_the_best_path():
    from itertools import product

    import numpy as np

    g = np.random.RandomState(3)
    model = line_quality.Model(g.randn(len(line_quality.FEATURES)), g.randn(2, 2))
    lines = np.array([3, 0, 1, 6])
    x = g.randn(10, len(line_quality.FEATURES))
    got = np.split(line_quality.viterbi(model, x, lines), np.cumsum(lines)[:-1])
    for part, labels in zip(np.split(x, np.cumsum(lines)[:-1]), got):
        score = lambda y: sum(part[i] @ model.weights for i, b in enumerate(y) if b) + sum(model.steps[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert not len(part) or tuple(labels) == max(product((0, 1), repeat=len(part)), key=score)


def removed(rows, width=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1 if d is not None else 0):
            x = tuple(w[i : i + width])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats(docs, empty, monkeypatch):
    monkeypatch.setattr(exact_repeats, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(exact_repeats, "GROUP_BYTES", 4000)
    monkeypatch.setattr(exact_repeats, "SLICE", 3000)
    got = exact_repeats.digests(docs)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(removed(ROWS), key=key)
    whole = exact_repeats.remove_repeats(docs)
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_tokens", "n_words", "n_removed"]
    texts = {(r.doc_id, r.n_removed): r.text for r in whole.collect()}
    assert texts[18, 0] == dict(ROWS)[18] and texts[4, 40] == "" and texts[6, 0] is None
    assert exact_repeats.remove_repeats(empty).count() == 0
    spans = {r.doc_id: [tuple(x) for x in r.repeats] for r in exact_repeats.remove_repeats(docs, spans=True).collect()}
    assert spans[4] == [(0, 40)] and spans[5] == [(8, 48)] and spans[3] == [] and spans[6] == []


def test_a_passage_in_a_third_of_all_texts(spark, monkeypatch):
    """Its bucket gets a few entries of each slice, not one of each text; results stay those of brute force."""
    import numpy as np

    r = random.Random(9)
    vocab = [f"v{k}" for k in range(3000)]
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(30000):
        t = [r.choice(vocab) for _ in range(16)]
        rows.append((k, " ".join(t[:8] + passage + t[8:] if k % 3 == 0 else t)))
    monkeypatch.setattr(exact_repeats, "SLICE", 1 << 17)
    monkeypatch.setattr(exact_repeats, "BUCKET_BYTES", 1 << 17)
    monkeypatch.setattr(exact_repeats, "GROUP_BYTES", 1 << 17)
    entries = spark.sparkContext.accumulator(0)
    slices = spark.sparkContext.accumulator(0)
    inner = exact_repeats._to_buckets

    def counted(to, doc, key, hashes, pos):
        if len(hashes):
            entries.add(int(np.unique(hashes, return_counts=True)[1].max()))
            slices.add(1)
        return inner(to, doc, key, hashes, pos)

    monkeypatch.setattr(exact_repeats, "_to_buckets", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_words, x.n_removed) for x in exact_repeats.digests(docs).collect()}
    assert got == {d: (n, gone) for d, n, gone, _ in removed(rows)}
    assert slices.value > 30 and entries.value <= 4 * slices.value


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(docs, empty):
    sets = [(d, shingles(t)) for d, t in ROWS]
    like = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    n = len(sets)
    near = [[j for j in range(n) if j != i and None not in (sets[i][0], sets[j][0]) and like(sets[i][1], sets[j][1])] for i in range(n)]
    label = [d for d, _ in sets]
    for _ in range(n):
        label = [min([label[i], *[label[j] for j in near[i]]]) if near[i] else label[i] for i in range(n)]
    want = [(sets[i][0], label[i], len(near[i])) for i in range(n)]
    got = jaccard_join.groups(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    pairs = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in jaccard_join.similar_pairs(docs).collect()}
    assert pairs and all(abs(j - len(a & b) / len(a | b)) < 1e-9 for (x, y), j in pairs.items() for a in [dict(sets[:13] + sets[19:])[x]] for b in [dict(sets[:13] + sets[19:])[y]])
    assert jaccard_join.groups(empty).count() == 0


def test_large_near_copy_group(spark, monkeypatch):
    """A group that never splits, over many blocks: links are still exact."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    base = [f"w{i}" for i in range(150)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(60)] + [(99, " ".join(base)), (100, " ".join(base))]
    got = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingles(t) for _, t in rows]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert {r.doc_id: r.n_links for r in got} == {d: n for (d, _), n in zip(rows, want)}
    assert {r.class_id for r in got} == {0}
    few, runs = jaccard_join.runs_for(0.999, 0.8)
    assert few < runs < 15 and jaccard_join.matches_for(0.8) < 0.8 * 96


def test_intersections_in_tiles(monkeypatch):
    import numpy as np

    g = np.random.RandomState(3)
    sets = [np.unique(g.randint(0, 300, g.randint(1, 120)).astype(np.uint64)) for _ in range(60)]
    left, right = np.triu_indices(60, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right)]
    for tile in (1 << 20, 500, 40):
        monkeypatch.setattr(jaccard_join, "TILE", tile)
        assert jaccard_join._common(sets, left, right).tolist() == want


def test_recall_at_the_bound(spark):
    """5,000 pairs of texts with similarities of 0.80 to 0.85."""
    r = random.Random(12)
    rows = []
    for k in range(5000):
        base = [f"{k}x{i}" for i in range(124)]
        other = base.copy()
        for place in r.sample(range(4, 120, 7), 2) if k % 4 == 0 else range(60, 69 if k % 4 > 1 else 67):
            other[place] = f"n{k}y{place}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    sets = [shingles(t) for _, t in rows]
    like = {2 * k for k in range(5000) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    assert len(like) == 5000 and sum(len(sets[k] & sets[k + 1]) < 0.86 * len(sets[k] | sets[k + 1]) for k in like) > 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id_a: x.doc_id_b for x in jaccard_join.similar_pairs(docs).collect()}
    assert all(b == a + 1 for a, b in got.items()) and len(got) >= 0.999 * 5000


def test_template_in_many_texts(spark, monkeypatch):
    """One template in 20,000 texts whose similarity stays far under the bound: few pairs are compared, and the near copies among them are found."""
    r = random.Random(13)
    template = [f"t{i}" for i in range(40)]
    texts = [[*template, *(f"{k}x{i}" for i in range(50))] for k in range(20000)]
    near = list(range(0, 20000, 40))
    for k in near:  # its near copy: 80 of 86 windows
        copy = texts[k].copy()
        copy[60], copy[61] = f"n{k}", f"m{k}"
        texts[k + 1] = copy
    compared = spark.sparkContext.accumulator(0)
    inner = jaccard_join._met_before

    def counted(paths, node):
        compared.add(len(paths) ** 2 // 2)
        return inner(paths, node)

    monkeypatch.setattr(jaccard_join, "_met_before", counted)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {(x.doc_id_a, x.doc_id_b) for x in jaccard_join.similar_pairs(docs).collect()}
    assert len(shingles(" ".join(texts[0])) & shingles(" ".join(texts[1]))) == 80
    want = {(k, k + 1) for k in near}
    assert got <= want and len(got) >= 0.995 * len(want)
    assert compared.value < 0.3 * 20000**2 / 2


def test_capitals_beyond_ascii_and_combining_marks():
    """Ids of words that NFC or lower case changes, in any case: Latin Extended-A, and letters that have a mark in lower case only."""
    import numpy as np
    import pyarrow as pa

    from graphloom.llm.common import text_slices

    v, r = word_tokens.Vocabulary(vocabulary(WORDS)), random.Random(2)
    bits = [*map(chr, range(0xC0, 0x180)), *"THJWYthjwyaEZ", *"\u0308\u0331\u030c\u030a\u0301\u0323\u0307", ",", "!", " ", "<", "\u01c5"]
    texts = ["Łódź", "Český", "Šport", "Žena", "Œuvre", "ŁÓDŹ,", "T\u0308", "H\u0331a", "J\u030c.", "W\u030aY\u030a"]
    texts += ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(6000)]
    for a, b, raw, off in text_slices(pa.array(texts)):
        ids, counts = v.ids(raw, off)
        found = [x.tolist() for x in np.split(ids, counts.cumsum()[:-1])]
        assert found == [v.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[a:b]]


def thue_morse(n, a="a", b="b"):
    """The two words of n letters whose polynomial hashes modulo a power of two are the same for every odd base."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_fool_polynomial_hashes(spark):
    """Thue-Morse words differ in ids, lines, windows and repeats."""
    import sentencepiece

    x, y = thue_morse(1024)
    v, w = thue_morse(2048, "ab ", "ba ")
    model, tk = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES)), tokenizer()
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(0, f"{x} {rest}"), (1, f"{y} {rest}"), (2, f"{x}\n{y}\n{x}"), (3, v), (4, w), (5, " ".join([x] * 5)), (6, " ".join([y] * 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = {r.doc_id: r.ids for r in sentence_pieces.encode(docs, vocabulary(PIECES)).collect()}
    assert ids == {d: model.encode(t) for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in word_tokens.token_counts(docs, vocabulary(WORDS)).collect()} == {d: len(tk.encode(t, add_special_tokens=False).ids) for d, t in rows}
    files = token_files.round_trip(docs, vocabulary(WORDS)).collect()
    assert {r.doc_id: r.ids_crc32 for r in files} == {d: zlib.crc32(struct.pack(f"<{len(i)}I", *i)) for d, t in rows for i in [[*tk.encode(t, add_special_tokens=False).ids, 1]]}
    assert sorted(map(tuple, exact_repeats.digests(docs).collect())) == sorted(removed(rows))
    counts = line_quality.rate(docs, line_quality.PRIOR).select("doc_id", *[c for c in line_quality.COLUMNS if c not in ("n_content_words", "kept")]).collect()
    assert sorted(map(tuple, counts)) == sorted((d, *base_counts(t)) for d, t in rows)
    groups = {r.doc_id: r.class_id for r in jaccard_join.groups(docs).collect()}
    assert (groups[1], groups[4], groups[5], groups[6]) == (0, 3, 5, 6)  # 0 and 1 share 8 of 10 windows, 3 and 4 have the same ones


def test_ids_are_right_whatever_the_hashes_are(monkeypatch):
    """With hashes that nearly all collide the bytes decide, and words too long for the table are encoded where they stand."""
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import span_table
    from graphloom.llm.common import text_slices

    monkeypatch.setattr(span_table, "span_hashes", lambda raw, starts, ends: ((ends - starts) % 3 + 1).astype(np.uint64) << np.uint64(62))
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 9))) for _ in range(400)] + ["x" * 500 + " " + "y" * 129, "y" * 128 + "z", "y" * 128]
    v, p = word_tokens.Vocabulary(vocabulary(WORDS)), sentence_pieces.Pieces(vocabulary(PIECES))
    for table, encode in ((v, lambda t: v.tokenizer.encode(t, add_special_tokens=False).ids), (p, p.model.encode)):
        for a, b, raw, off in text_slices(pa.array(texts), 900):
            ids, counts = table.ids(raw, off)
            assert [x.tolist() for x in np.split(ids, counts.cumsum()[:-1])] == [encode(t) for t in texts[a:b]]
        assert table.table.n <= 3


def test_span_hashes_depend_on_their_bytes_alone():
    import numpy as np

    from graphloom.llm.common import span_hashes

    r = np.random.RandomState(0)
    words = {bytes(r.randint(97, 123, n).astype(np.uint8)) for n in [*range(1, 150), 512, 513, 4096, 4097, 40000]} | {b"", b"\0", b"\0\0", b"a", b"a\0"} | {w.encode() for n in (64, 1024, 65536) for w in thue_morse(n)}
    words = sorted(words)
    raw, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    h = span_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(words) and not (h == span_hashes(raw, starts, ends, 1)).any()
    assert h.tolist() == [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]


def test_likelihood_and_its_gradients():
    """Against sums over all labellings, and against differences of the likelihood itself."""
    from itertools import product

    import numpy as np

    g = np.random.RandomState(5)
    lines = np.array([5, 3, 1])
    x, gold, share, w, t = g.randn(9, 4), g.randint(0, 2, 9), np.array([0.2, 0.5, 0.3]), g.randn(4), g.randn(2, 2)

    def brute(w, t):
        total, a = 0.0, 0
        for n, s in zip(lines, share):
            score = lambda y: sum(x[a + i] @ w for i in range(n) if y[i]) + sum(t[p, q] for p, q in zip(y, y[1:]))  # noqa: B023, E731
            total += s * (score(gold[a : a + n]) - np.log(sum(np.exp(score(y)) for y in product((0, 1), repeat=n))))
            a += n
        return total

    value, by_weights, by_steps = line_quality.likelihood(w, t, x, lines, gold, share)
    assert abs(value - brute(w, t)) < 1e-9
    e = 1e-5
    for k in range(4):
        d = np.eye(4)[k] * e
        assert abs(by_weights[k] - (brute(w + d, t) - brute(w - d, t)) / (2 * e)) < 1e-6
    for k in range(4):
        d = np.eye(4)[k].reshape(2, 2) * e
        assert abs(by_steps.flat[k] - (brute(w, t + d) - brute(w, t - d)) / (2 * e)) < 1e-6


def test_labels_change_within_texts(spark):
    """Fitted on half of the labelled texts: the other half's verdicts are right, many of its texts have both labels, and lines of texts put together from a good and a bad one are told apart better than any one label for each text could."""
    import numpy as np
    import pyarrow as pa

    from graphloom.llm.common import text_slices

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = line_quality.fit(docs, labels.where("doc_id % 2 = 0"), documents=1000)
    assert len(model.shared) > 20
    rated = line_quality.rate(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").select("text", "quality", "kept").collect()
    assert sum(r.kept == bool(r.quality) for r in rated) > 0.98 * len(rated) > 1000
    assert sum(r.kept for r in rated if r.quality) >= 0.995 * sum(r.quality for r in rated)

    def labelled(texts):
        out = []
        for _, _, raw, off in text_slices(pa.array(texts)):
            c = line_quality.count(raw, off, model.shared)
            out += np.split(line_quality.viterbi(model, c.features, c.lines), np.cumsum(c.lines)[:-1])
        return out

    several = [y for y in labelled([r.text for r in rated if r.quality]) if len(y) > 1]
    assert sum(0 < y.sum() < len(y) for y in several) > 0.2 * len(several)
    good, bad = ([r.text.split("\n") for r in rated if r.quality == q] for q in (1, 0))
    real = lambda lines: [x for x in lines if words(x)]
    good, bad = ([real(x)[:6] for x in part if len(real(x)) > 1] for part in (good, bad))
    right = of_text = total = 0
    gold, texts = [], []
    for a, b in zip(good, bad):
        texts.append("\n".join([*a, *b]))
        gold.append(np.array([0] * len(a) + [1] * len(b)))
    for y, z in zip(gold, labelled(texts)):
        right, of_text, total = right + (y == z).sum(), of_text + max((y == 0).sum(), (y == 1).sum()), total + len(y)
    assert len(gold) > 50 and right > 0.8 * total and right > 1.2 * of_text


def test_texts_longer_than_a_sequence():
    """All lines of a long text are trained on, as several sequences."""
    import numpy as np

    g = np.random.RandomState(2)
    lines = np.array([700, 3, 0, 5])
    x = np.zeros((708, len(line_quality.FEATURES)))
    x[:, 0] = 1
    x[300:700, 1] = 1.5  # only behind the 300th line
    bad = np.array([True, False, False, False])
    gold = np.repeat(bad, lines).astype(np.int64)
    x += g.randn(*x.shape) * 0.01
    fit = lambda x: line_quality.train(x, lines, gold, bad)
    assert line_quality.viterbi(fit(x), x, lines)[[650, 704]].tolist() == [1, 0]
    without = x.copy()
    without[300:700, 1] = 0
    assert fit(x).weights[1] != fit(without).weights[1]

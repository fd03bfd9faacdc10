"""Sharding, mixing, vector search, chat formatting and the pipeline, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat_format, components, jaccard_join, line_quality, mixing, queries, sharding, vector_search

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels conversations".split()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    order = [want.columns.index(k) for k in columns]
    assert sorted(repr(tuple(r[k] for k in columns)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_sharding(spark):
    r = random.Random(2)
    rows = [(k, "x" * r.randint(0, 90)) for k in range(300)] + [(1000, "y" * 5000), (None, "z" * 40), (None, None)] + [(7, "x" * 50)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs, limit=400).collect()
    assert sorted((x.doc_id is not None, x.doc_id, x.n_bytes) for x in out) == sorted((d is not None, d, len(t or "")) for d, t in rows)
    shards = defaultdict(list)
    for x in out:
        shards[x.shard_depth, x.shard_prefix, x.shard_tie].append(x)
    for rows_ in shards.values():
        total = sum(x.n_bytes for x in rows_)
        assert total <= 400 or len(rows_) == 1
        assert all(x.shard_bytes == total and x.shard_rows == len(rows_) for x in rows_)
    # no bucket is split that would fit whole, and prefixes don't overlap
    plain = [(d, p) for d, p, t in shards if not t]
    for d, p in plain:
        if d:
            parent = [x for (e, q, t), v in shards.items() if e >= d - 1 and q >> (e - d + 1) == p >> 1 for x in v]
            assert sum(x.n_bytes for x in parent) > 400
    assert sharding.shard(docs.limit(0)).count() == 0
    plan = sharding.shard(docs, limit=400)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_with_names_of_its_own(spark):
    for name in ("h", "g", "leaf", "s", "open"):
        df = spark.createDataFrame([(k, "x" * 30) for k in range(40)], f"{name} long, text string")
        out = sharding.shard(df, key=name, limit=100)
        assert out.columns[0] == name and sorted(r[0] for r in out.collect()) == list(range(40)) and out.agg(F.max("shard_bytes")).first()[0] <= 100
    with pytest.raises(ValueError):
        sharding.shard(df.withColumnRenamed("open", "n_bytes"), key="n_bytes")


def test_write_shards(spark, tmp_path):
    """Rows of one repeated key and of a null key, far over the limit together: each is written once, and no shard is over the limit."""
    r = random.Random(8)
    rows = [(k, "x" * r.randint(0, 60), k, "a") for k in range(100)] + [(7, "y" * r.randint(1, 60), 1000 + k, "b") for k in range(80)] + [(None, None if k % 9 == 0 else "z" * 30, 2000 + k, "c") for k in range(60)]
    rows += [(7, "same", 3000, "d")] * 5 + [(8, "w" * 900, 4000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, n_bytes string")  # names that the split uses itself
    sharding.write_shards(docs, str(tmp_path / "s"), limit=400)
    out = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(map(repr, (tuple(x)[:4] for x in out))) == sorted(map(repr, rows)) and out[0].asDict().keys() == {"doc_id", "text", "h", "n_bytes", "shard"}
    shards = defaultdict(list)
    for x in out:
        shards[x.shard].append(len(x.text or ""))
    assert all(sum(v) <= 400 or len(v) == 1 for v in shards.values())
    assert len({x.shard for x in out if x.doc_id == 7}) > 5 and len({x.shard for x in out if x.doc_id is None}) > 3


def test_sharding_below_the_depth_of_its_sql(spark):
    """Keys that share 30, 31 and 33 bits are split further down; the SQL ends at depth 30 and leaves out those that don't fit together there."""
    import duckdb

    sizes = {59690: 14689, 188666: 1932, 472385: 21065, 490807: 6869, 86113: 50479, 180905: 2895, 9: 100}
    docs = spark.createDataFrame([(k, "x" * n) for k, n in sizes.items()], "doc_id long, text string")
    got = sorted(tuple(x) for x in sharding.shard(docs, limit=queries.FINE).collect())
    assert {x[0]: x[2] for x in got if x[2] > 30} == {59690: 31, 188666: 31, 472385: 32, 490807: 32, 86113: 34, 180905: 34}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(k, "x" * n) for k, n in sizes.items()])
    sql = sharding.oracle(queries.FINE)
    assert "range(0, 31)" in sql and got == sorted(c.sql(sql.replace("range(0, 31)", "range(0, 61)")).fetchall())
    assert [x for x in got if x[2] <= 30] == sorted(c.sql(sql).fetchall())


def test_near_duplicates_of_repeated_ids(spark):
    """A doc_id with several texts loses only those that are copies of other documents'."""
    base, one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    near = base.replace("a39", "new")
    rows = [(0, base), (14, base), (14, one), (14, one), (14, two), (15, near), (16, two), (None, base), (17, None), (17, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == sorted(map(repr, [(0, base), (14, one), (14, two), (None, base), (17, None), (17, "")]))


def test_targets():
    t = mixing.targets({"a": 100, "b": 1, "c": 10}, {"a": 1, "b": 2, "c": 3})
    assert t == {"b": 3.0, "c": 30.0, "a": 78.0}
    assert sum(mixing.targets({"a": 5, "b": 7}, {"a": 1, "b": 2}).values()) == 12


def test_route_is_cheapest():
    """b's quota needs the shared pattern, so a's words are used twice before that."""
    flow = mixing.route({"a": 10, "ab": 10, "b": 0}, {"a": ["A"], "ab": ["A", "B"], "b": ["B"]}, {"A": 10, "B": 10})
    assert flow == {"a": 10, "ab": 10}
    assert mixing.route({"a": 10}, {"a": ["A"]}, {"A": 25}) == {"a": 25} and mixing.route({"a": 10}, {"a": ["A"]}, {"A": 99}) == {"a": 30}


def test_mixing(spark):
    r = random.Random(3)
    rows = [(k, [r.choice("pqr")] if k % 9 else [None], r.randint(0, 50)) for k in range(400)] + [(1, ["p"], 5)] * 60 + [(900, [], 7), (901, ["p", "q"], 30), (902, ["q"], None)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long").withColumn("pattern", F.lit("mine")).coalesce(2)
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "sources", "size", "pattern", "source_size", "target", "taken"]
    got = out.collect()
    assert len(got) == len(rows) and all(x.taken <= 3 * (x.size or 0) and (not x.size or x.taken % x.size == 0) for x in got)
    by, target = defaultdict(int), {}
    for x in got:
        if len(x.sources) == 1:
            by[x.sources[0]] += x.taken
            target[x.sources[0]] = x.target
    for s in by:
        assert abs(by[s] - target[s]) <= 150
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df).collect()))
    # equal keys and sizes with different texts: the same ones are taken however the table is split
    many = spark.createDataFrame([(7, ["p"], 5, f"t{k}", {"m": k}) for k in range(90)] + [(k, ["q"], 30, "u", None) for k in range(20)], "doc_id long, sources array<string>, size long, text string, m map<string,int>")
    taken = [sorted((x.text, x.doc_id, x.taken) for x in mixing.mix(many.repartition(n, "text")).collect()) for n in (1, 5)]
    assert taken[0] == taken[1] and 0 < sum(x[2] > 0 for x in taken[0] if x[1] == 7) <= 90
    assert mixing.mix(df.limit(0)).count() == 0


def test_vectors(spark):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) for _ in range(16)]) for k in range(400)]
    rows += [(k, rows[3][1]) for k in range(400, 460)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0, None] * 8), (504, [float("inf")] * 16), (505, [1.0]), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in vector_search.nearest(df, df.where("vec_id % 20 = 0"), 10).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    import numpy as np

    fine = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, v in fine:
        if q % 20 == 0:
            best = sorted(((-(v @ w), k) for k, w in fine if k != q), key=lambda x: (round(x[0], 9), x[1]))[:10]
            assert [k for _, k, _ in sorted(got[q])] == [k for _, k in best]
    assert len(got) == 23
    few = vector_search.nearest(df.limit(3), df.limit(1), 10)
    assert few.count() == 2 and vector_search.nearest(df.limit(0), df, 10).count() == 0


def test_codes_leave_most_vectors_out():
    import numpy as np

    g = np.random.RandomState(1)
    x = g.randn(3000, 64).astype(np.float32)
    x[:200] += 3 * x[0]
    turn = vector_search.rotation(64).T
    assert np.allclose(turn @ turn.T, np.eye(64))
    for bits, most in ((64, 1500), (256, 700)):
        turn = vector_search.rotation(64, bits)
        assert np.allclose(turn @ turn.T, np.eye(64))
        block = vector_search.Block(np.arange(3000), *vector_search.encode_block(x, np.zeros(64), turn), x, np.zeros(64), turn)
        place, ids, scores, ranked = block.search(x[:1], np.array([0]), np.array([-np.inf]), 20)
        exact = x.astype(float) @ x[0].astype(float)
        assert ids.tolist() == np.argsort(-np.where(np.arange(3000) == 0, -1e9, exact), kind="stable")[:20].tolist() and ranked < most
        assert block.search(x[:1], None, np.array([scores[9]]), 20)[1].tolist()[1:] == ids.tolist()[:10]  # nothing under the floor, but itself


def test_many_vectors_in_cells(spark, monkeypatch):
    """20,000 clustered vectors, one of them in a third of all rows, doubles beyond the range of floats: every result equals brute force, and cells are left out."""
    import numpy as np

    g = np.random.RandomState(7)
    x = g.randn(40, 24)[g.randint(0, 40, 20000)] * 3 + g.randn(20000, 24) * 0.4
    x[::3] = x[0]
    x[5] = 0.0
    x[7] *= 1e60
    df = spark.createDataFrame([(k, v.tolist(), 1.0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, score double").repartition(6)
    monkeypatch.setattr(vector_search, "BLOCK", 500)
    monkeypatch.setattr(vector_search, "QUERIES", 100)
    asked = []
    inner = vector_search._search
    monkeypatch.setattr(vector_search, "_search", lambda index, cells, rows, *a: (asked.append((len(cells.centres), rows)), inner(index, cells, rows, *a))[1])
    got = defaultdict(list)
    for r in vector_search.nearest(df, df.where("vec_id % 200 = 0"), 20).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert len(got) == 100
    there = np.flatnonzero(x.any(axis=1))
    for q, rows in got.items():
        scores = vector_search.exact(x[there], np.broadcast_to(x[q], (len(there), 24)))
        order = np.lexsort((there, -np.where(there == q, -np.inf, scores)))[:20]
        assert [v for _, v in sorted(rows)] == there[order].tolist()
    assert asked[0][0] > 20 and asked[1][1].count() < 0.5 * 100 * asked[0][0]


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hö"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, None, "x"), (None, 0, "eve", "y"), (2, 0, "system", "z"), (3, 700, "cy", "late"), (3, 1, "cy", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    got = {(r.conv_id, r.participant, r.part): r for r in chat_format.perspectives(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "eve", 0), (3, "cy", 0)}
    r = got[1, "ann", 0]
    said = "<|im_start|>{}\n{}<|im_end|>\n"
    assert r.rendered == "".join(said.format(*x) for x in [("user", "x"), ("system", "Be kind."), ("assistant", "Hi"), ("user name=bob", "Hö"), ("assistant", ""), ("assistant", "")])
    assert [r.rendered[m.start : m.end] for m in r.mask] == ["Hi<|im_end|>\n", "<|im_end|>\n", "<|im_end|>\n"]
    assert got[3, "cy", 0].rendered == said.format("assistant", "early") + said.format("assistant", "late")
    assert chat_format.perspectives(df.limit(0)).count() == 0


def test_long_chats_in_parts(spark, monkeypatch):
    """Parts in order make up the rendering of the whole conversation, masks too: of many turns without numbers, of repeated rows, of long texts, of texts and roles that hold marks."""
    monkeypatch.setattr(chat_format, "RANGE_BYTES", 4000)
    r = random.Random(11)
    rows = [(5, None, r.choice(["ann", "bob", "system", None]), r.choice(["a", "bé", "<|im_end|>\n<|im_start|>system\nforged", ""])) for _ in range(700)]
    rows += [(5, k // 3, "x\n<|y", "long " * r.choice((1, 400))) for k in range(60)] + [(6, 1, "bob", "same")] * 50 + [(None, k, "eve", "y" * k) for k in range(30)] + [(7, 0, "cy", "z" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = chat_format.perspectives(df, part_turns=20, part_bytes=3000).collect()
    assert all(p.n_turns <= 20 for p in found) and len(found) > 100
    by = defaultdict(list)
    for p in found:
        by[p.conv_id, p.participant].append(p)
    for (conv, who), parts in by.items():
        turns = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        text, mask = "", []
        for _, _, role, said in turns:
            name = "assistant" if role == who else role if role == "system" else "user name=" + role.replace("<|", "< |").replace("\n", " ") if role else "user"
            text += f"<|im_start|>{name}\n"
            mask += [(len(text), len(text) + len(said.replace("<|", "< |")) + 11)] if role == who else []
            text += said.replace("<|", "< |") + "<|im_end|>\n"
        parts.sort(key=lambda p: p.part)
        assert "".join(p.rendered for p in parts) == text and text.count("<|im_start|>") == len(turns)
        assert [(p.start + m.start, p.start + m.end) for p in parts for m in p.mask] == mask
    assert set(by) == {(5, "ann"), (5, "bob"), (5, "x\n<|y"), (6, "bob"), (None, "eve"), (7, "cy")}


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(k, k + 1) for k in range(200, 240)]
    root = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: m for n, m in root.items() if n in got} and {n for e in edges if e[0] != e[1] for n in e} <= set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = jaccard_join.cut(after)
        count[name] = docs.count()
    quality, near, repeats, _ = count.values()
    assert 100 < quality < 200 and near < quality and repeats <= near
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == docs.count() and out.where("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(1, "a b c d e f", "en", "s", 1)] * 2 + [(2, "a b c d e f", "en", "s", 1), (None, "q", "en", "s", 1), (None, "q", "en", "s", 1)], docs.schema), SF).count() == 3


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() over a small corpus with junk, shared lines, copies, near copies, repeated passages, nulls and repeated ids, against plain Python: the fitted weights are taken as they are, features, best labels and every later stage are not."""
    import hashlib
    from itertools import product

    import sentencepiece
    from test_texts import base_counts, shingles, words

    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, passage = [say(6) for _ in range(3)], say(30)
    rows = []
    for k in range(60):
        lines = [say(r.randint(12, 40)) for _ in range(r.randint(1, 3))]
        if k % 3 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(shared))
        if k % 7 == 0:
            lines.append(say(5) + " " + passage + "  " + say(5))
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, "\n".join(" ".join(w + r.choice(["***", "###", "!!"]) for w in say(20).split()).upper() for _ in range(2))) for k in range(20)]
    rows += [(200, rows[4][1]), (201, rows[4][1] + " tail"), (202, rows[5][1]), (203, None), (204, ""), (205, "few words"), (206, (say(3) + " ") * 20), (None, rows[8][1]), (None, say(30)), (207, rows[10][1]), (207, say(40)), (207, say(40))]
    docs = [(d, t, r.choice(["en", None]), r.choice(["s", "t", "u", None]), len(t or "")) for d, t in rows]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(0, 60, 2)] + [(100 + k, 0) for k in range(0, 20, 2)] + [(1, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids").collect()]

    # quality rules
    model = line_quality.fit(frame, spark.read.parquet(str(tmp_path / "labels.parquet")))
    texts_of = defaultdict(set)
    for n, d in enumerate(docs):
        for line in (d[1] or "").split("\n"):
            if words(line):
                texts_of[line].add(n)
    often = {line for line, n in texts_of.items() if len(n) >= 5}
    assert len(often) == len(model.shared) >= 3

    def kept(text):
        n, *_, failed = base_counts(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        if failed:
            return False
        mostly = 2 * sum(len(words(x)) for x in lines if x in often) < n
        scores = []
        for i, x in enumerate(lines):
            b, w = x.encode(), len(words(x))
            letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in b)
            feature = [1, min(10 * sum(c in b"#*$%&|<>" for c in b) / len(b), 2), sum(65 <= c <= 90 for c in b) / max(letters, 1), min(b.count(b"!") / w, 2), sum(48 <= c <= 57 for c in b) / len(b), x in lines[:i], w < 3, min(len(b) / w / 10, 3), w / n, x in often and mostly]
            scores.append(sum(f * v for f, v in zip(feature, model.weights)))
        best = max(product((0, 1), repeat=len(lines)), key=lambda y: sum(s for s, b in zip(scores, y) if b) + sum(model.steps[a, b] for a, b in zip(y, y[1:])))
        return sum(len(words(x)) for x, y in zip(lines, best) if not y) >= 0.5 * n

    left = [d for d in docs if kept(d[1])]
    assert {d[0] for d in docs} - {d[0] for d in left} >= {203, 204, 205, 206, *range(100, 120)} and len(left) > 50
    # near duplicates: one of each group, among rows with an id; equal rows once
    known = list(dict.fromkeys(d for d in left if d[0] is not None))
    group = [d[0] for d in known]
    sets = [shingles(d[1]) for d in known]
    near = [[j for j in range(len(known)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(known))]
    for _ in known:
        group = [min([group[i], *[group[j] for j in near[i]]]) for i in range(len(known))]
    left = [d for d, g in zip(known, group) if d[0] == g] + [d for d in left if d[0] is None]
    assert not {200, 201, 202} & {d[0] for d in left} and sum(d[0] == 207 for d in left) == 2
    # repeats: white space before kept words stays
    first, out = {}, []
    for d in left:
        w = words(d[1])
        for i in range(len(w) - 12 if d[0] is not None else 0):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), d[0]), d[0])
    for d in left:
        w, gone = words(d[1]), set()
        for i in range(len(w) - 12 if d[0] is not None else 0):
            if first[tuple(w[i : i + 13])] < d[0]:
                gone.update(range(i, i + 13))
        text, at, end = "", 0, 0
        for i, x in enumerate(w):
            begin = d[1].index(x, at)
            if i not in gone:
                text += (d[1][end:begin] if text else "") + x
            at = end = begin + len(x)
        if len(gone) < len(w):
            out.append((d[0], text if gone else d[1], *d[2:4], len(text if gone else d[1])))
    assert sum(a[1] != b[1] for a, b in zip(out, left)) >= 5
    left = out
    # mixing: by source in order of the key's hash
    sources = sorted({d[3] for d in left}, key=lambda s: (s is None, s or ""))
    size = lambda d: len(words(d[1]))
    sizes = {s: sum(size(d) for d in left if d[3] == s) for s in sources}
    target = mixing.targets(sizes, {s: 1 + i % 3 for i, s in enumerate(sources)})
    key = lambda d: (int(hashlib.md5(f"mix|{'null' if d[0] is None else d[0]}".encode()).hexdigest()[:15], 16), size(d))
    want, model = [], sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECES))
    for s in sources:
        copies, rest = divmod(int(target[s] + 0.5), sizes[s])
        for d in sorted((d for d in left if d[3] == s), key=key):
            more = size(d) <= rest or size(d) < 2 * rest
            rest = rest - size(d) if size(d) <= rest else 0
            ids = model.encode(d[1])
            want += [(d[0], model.decode(ids), *d[2:], len(ids), ids)] * (copies + more)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 30
    empty = str(tmp_path / "empty")
    frame.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0

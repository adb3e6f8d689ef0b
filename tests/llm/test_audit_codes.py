"""Operators 11 to 13: brute force, their SQL, and awkward input."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fieldmart.llm import codes, divergence, queries, wordvectors

DOCS = "doc_id long, text string, lang string, source string, row int, n long, term string, value long"
MORE = ["x", 1, "y", 2]


def sources(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 1, "x", 1) for i, (t, lang, s) in enumerate(rows)], DOCS)


def floor_share(n, total):
    return 1 + 1_000_000_000 * (n + 1) // total


def audit_by_hand(rows):
    """The contract in plain loops over Python integers."""
    out = []
    by_lang = defaultdict(list)
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        by_lang[lang or ""].append((source or "", words))
    for lang, docs in by_lang.items():
        seen = Counter(w for _, words in docs for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= 3)
        count = defaultdict(Counter)
        for source, words in docs:
            count[source].update(w for w in words if w in set(kept))
        whole = sum(count.values(), Counter())
        p = {s: {w: floor_share(c[w], c.total() + len(kept)) for w in kept} for s, c in count.items()}
        q = {w: floor_share(whole[w], whole.total() + len(kept)) for w in kept}
        for s in count:
            pair = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in count if o != s]
            mark = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", mark, 200)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(spark, rows):
    frame = divergence.audit(sources(spark, rows))
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def corpus():
    rnd = np.random.default_rng(3)
    terms = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "qrstuvwxyzäé"]
    rows = []
    for k in range(220):
        lang, source = rnd.choice(["en", "de"]), f"s{rnd.integers(0, 7)}"
        words = rnd.choice(terms, rnd.integers(0, 40), p=(w := 1 / np.arange(1, len(terms) + 1)) / w.sum())
        rows.append((" ".join(words).title() + " 12-3", str(lang), source))
    hot = [("the same words of one source " * 3, "en", "hot")] * 100
    odd = [(None, "en", None), ("", None, None), ("lone", None, "x"), ("only here", "fr", "a"), (None, "fr", "b"), ("w" * 3000 + " ärg " * 2000, "de", "s0")]
    return rows + hot + odd


def test_audit_equals_plain_loops(spark, corpus):
    assert audited(spark, corpus) == audit_by_hand(corpus)


def test_audit_does_not_depend_on_blocks_tiles_or_tables(spark, corpus, monkeypatch):
    """Small blocks, frontiers, tiles and tables within one process."""
    want = audit_by_hand(corpus)
    for name, value in (("BLOCK_CELLS", 9), ("FRONTIER", 16), ("TILE_BITS", 1), ("TILE", 2), ("HELD_TILES", 1), ("TABLE_TERMS", 5), ("CHUNK", 7)):
        monkeypatch.setattr(divergence, name, value)
    counts = defaultdict(lambda: [0, 0])
    rows = pa.RecordBatch.from_pydict({"text": [r[0] for r in corpus], "lang": [r[1] for r in corpus], "source": [r[2] for r in corpus]})
    for batch in divergence._count(iter([rows])):
        for r in batch.to_pylist():
            counts[r["lang"], r["source"], r["term"]][0] += r["n"]
            counts[r["lang"], r["source"], r["term"]][1] += r["docs"]
    groups = sorted({(r[1] or "", r[2] or "") for r in corpus})
    by_lang = {lang: [s for g, s in groups if g == lang] for lang, _ in groups}
    cells = [
        {"lang": lang, "term": t, "row": by_lang[lang].index(s), "n_rows": len(by_lang[lang]), "n": n, "docs": d}
        for (lang, s, t), (n, d) in sorted(counts.items(), key=lambda x: (x[0][0], x[0][2].encode(), x[0][1]))
    ]
    kinds = pa.schema([("lang", pa.string()), ("term", pa.string()), ("row", pa.int32()), ("n_rows", pa.int32()), ("n", pa.int64()), ("docs", pa.int64())])
    batches = pa.Table.from_pylist(cells, kinds).to_batches(max_chunksize=11)
    blocks = [r for b in divergence._blocks(iter(batches)) for r in b.to_pylist()]
    assert len(blocks) > 20
    totals, terms = {g: [0] * len(s) for g, s in by_lang.items()}, Counter()
    for b in blocks:
        terms[b["lang"]] += b["cols"]
        for r in b["row_n"]:
            totals[b["lang"]][r["row"]] += r["n"]
    for b in blocks:
        b |= {"totals": totals[b["lang"]], "lang_terms": terms[b["lang"]]}
    got = Counter()
    for batch in divergence._pairs(iter(pa.Table.from_pylist(blocks).to_batches())):
        for r in batch.to_pylist():
            got[r["lang"], by_lang[r["lang"]][r["row"]], by_lang[r["lang"]][r["other"]]] += r["value"]
    assert {k: v for k, v in got.items()} == {(g, s, item): v for g, s, part, item, v, _ in want if part == "pair" and terms[g]}


def test_tree_keeps_every_cell():
    rnd = np.random.default_rng(1)
    for rows, cols in ((1, 1), (3, 40), (17, 5), (64, 64)):
        matrix = rnd.random((rows, cols)) < 0.2
        row, col = np.nonzero(matrix)
        bits, order = divergence.Tree.build(rows, cols, row, col)
        got = divergence.Tree(rows, cols, bits).coordinates()
        assert (got[0] == row[order]).all() and (got[1] == col[order]).all() and len(row) == len(order)


def test_share_is_exact_for_large_counts():
    for n, total in ((0, 1), (5, 7), (9 * 10**14, 9 * 10**15), (10**12 + 7, 10**12 + 8)):
        assert divergence.share(np.array([n]), np.int64(total))[0] == floor_share(n, total)


def test_audit_of_nothing(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None)]) == []
    assert audited(spark, [("a b", "en", "x"), ("c", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


@pytest.mark.parametrize("name", ["op3_chat", "op6_decontaminate", "op11_divergence", "op13_codes"])
def test_query_equals_its_sql(spark, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    names = [c for c in sorted(found.columns) if c in want.columns]
    assert set(names) == set(want.columns)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(want.select(*[f'"{n}"' for n in names]).fetchall(), key=repr)


# ---- vectors -----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x int, code string"


def codes_by_hand(rows, rounds=codes.ROUNDS):
    """Plain search over (vec_id, vector, label); code, error and label error by row."""
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(e)))) for e in v], label) for i, v, label in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    kept = sorted(((i, v, label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in kept]).reshape(len(kept), 4, width // 4)
    books = x[:256].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        own = far.argmin(axis=2)
        for p in range(4):
            for e in set(own[:, p]) if turn < rounds else ():
                mine = x[own[:, p] == e, p]
                books[p, e] = mine.sum(axis=0) // len(mine)
    error = np.take_along_axis(far, own[:, :, None], 2).sum(axis=(1, 2))
    per_label = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        per_label[label] += int(e)
    return sorted(((i, "".join(f"{e:02x}" for e in o), int(d), per_label[label]) for (i, _, label), o, d in zip(kept, own, error, strict=True)), key=repr)


def compressed(spark, rows):
    frame = codes.compress(spark.createDataFrame([(*r, 1, "c") for r in rows], VECTORS))
    assert frame.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in frame.collect()), key=repr)


def test_codes_equal_plain_search(spark):
    rnd = np.random.default_rng(0)
    clusters = rnd.normal(0, 1, (12, 8))
    rows = [(int(i), (clusters[rnd.integers(0, 12)] + rnd.normal(0, 0.1, 8)).tolist(), int(rnd.integers(0, 3))) for i in range(700)]
    rows += [(5000 + i, rows[3][1], None) for i in range(400)]  # a hot vector
    assert compressed(spark, rows) == codes_by_hand(rows)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (3, [-0.5] * 8, 1), (None, [0.25] * 8, None), (4, None, 1), (5, [0.1, None] * 4, 1), (6, [nan] * 8, 1), (7, [inf] * 8, None),
        (8, [0.1, 0.2, 0.3], 2), (9, [-1e-9] * 8, 2), (10, [0.7] * 9, 2),
    ]
    assert compressed(spark, rows) == codes_by_hand(rows)
    assert compressed(spark, []) == [] and compressed(spark, [(1, None, 1)]) == []
    with pytest.raises(Exception, match="out of range"):
        compressed(spark, [(1, [1e30] * 4, 1)])


def test_balls_hold_their_points_and_sums():
    rnd = np.random.default_rng(2)
    x = rnd.integers(-900, 900, (600, 5))
    x[100:300] = x[7]
    balls = codes.grow(x)
    assert sorted(balls.order) == list(range(600)) and len(balls.radius) > 20
    for k in range(len(balls.radius)):
        mine = x[balls.order[balls.first[k] : balls.last[k]]]
        assert (mine.sum(axis=0) == balls.total[k]).all()
        assert np.sqrt(((mine - balls.center[k]) ** 2).sum(axis=1)).max() <= balls.radius[k] * (1 + 1e-12) + 1e-9
    book = x[rnd.integers(0, 600, 40)]
    owner, sums, counts = codes.assign(balls, x, book)
    assert (owner == ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert counts.sum() == 600 and (sums.sum(axis=0) == x.sum(axis=0)).all()


# ---- classifier --------------------------------------------------------------------------

TEXTS = "doc_id long, text string, held_out string, quality string"


def contexts_by_hand(texts):
    place, sign = wordvectors.index_vectors()
    out = np.zeros((wordvectors.WORDS, wordvectors.WIDTH))
    for text in texts:
        row = wordvectors.Tokens(pa.array([text])).row.tolist() if text else []
        for i, word in enumerate(row):
            for j in range(max(0, i - wordvectors.REACH), min(len(row), i + wordvectors.REACH + 1)):
                if j != i:
                    np.add.at(out[word], place[row[j]], sign[row[j]])
    return out


def test_contexts_equal_plain_loops(monkeypatch):
    texts = ["a b c d e a b", None, "", "x", "é è é", "a  b\n\tc " * 60]
    want = contexts_by_hand(texts)
    for block in (1 << 21, 32):
        monkeypatch.setattr(wordvectors, "BLOCK", block)
        batch = pa.RecordBatch.from_pydict({"text": texts})
        parts = list(wordvectors._contexts(iter([batch, batch])))
        got = np.zeros_like(want)
        for r in next(wordvectors._add(iter(parts))).to_pylist():
            got[r["row"]] = np.frombuffer(r["sums"], "<i8")
        # Only the words at the seams of a very long text's parts lose neighbours.
        assert (got == 2 * want).all() if block > 100 else np.abs(got - 2 * want).sum() < np.abs(want).sum()


def test_network_learns_and_is_calibrated():
    rnd = np.random.default_rng(4)
    x = rnd.normal(0, 1, (3000, 6))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * x[:, 2])))
    y = (rnd.random(3000) < p).astype(float)
    net = wordvectors.fit(x[:2500], y[:2500])
    got = net.scores(x[2500:])
    assert np.corrcoef(got, p[2500:])[0, 1] > 0.8 and net.temperature > 0


def good(k):
    return " ".join(f"word{(k * 7 + j * j) % 23} and the" for j in range(20))


def test_classifier_on_held_out_and_odd_rows(spark):
    docs = [(k, good(k) if k % 3 else " ".join(f"w{(k + j) % 29}!! $$$" for j in range(30)), "h", "q") for k in range(240)]
    docs += [(None, good(1), "h", "q"), (900, None, "h", "q"), (901, "", "h", "q"), (902, " \n", "h", "q"), (903, good(5) * 300, "h", "q"), (7, good(7), "h", "q")]
    labels = [(k, int(k % 3 > 0), 0) for k in range(240)] + [(None, 1, 0), (900, None, 0), (4, 1, 1)]
    frame = wordvectors.score(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = frame.collect()
    assert frame.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 20 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id in (900, 901, 902)}) == 1
    assert len({r.score for r in got if r.doc_id == 7}) == 1


def test_classifier_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert wordvectors.score(spark.createDataFrame([], TEXTS), none).collect() == []
    one = spark.createDataFrame([(1, "a b", "h", "q"), (2, None, "h", "q")], TEXTS)
    assert [r.score for r in wordvectors.score(one, none).collect()] == [0.5, 0.5]
    taught = spark.createDataFrame([(k, 1) for k in range(6)], "doc_id long, quality int")
    assert {r.score for r in wordvectors.score(one, taught).collect()} == {1.0}


def test_stages_that_share_a_worker_keep_no_words(monkeypatch):
    """Languages and packing in one process: caches are bounded while they run and empty afterwards."""
    from fieldmart.llm import langid, packing

    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    texts = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": texts, "lang": ["en"] * 20})
    model = np.zeros((langid.BUCKETS + langid.WORD_BUCKETS, 1), np.float32)
    encoder, held = packing.tokens(queries.vocabulary()), []
    alone = [r for b in packing._cut(queries.vocabulary(), 2048, 0)(iter([batch])) for r in b.to_pylist()]
    assert not len(encoder.known)
    for _ in range(2):
        predicted = [r for b in langid._predict(["en"], model, "text", 3)(iter([batch])) for r in b.to_pylist()]
        assert [r["text"] for r in predicted] == texts and {r["lang_pred"] for r in predicted} == {"en"}
        for b in packing._cut(queries.vocabulary(), 2048, 0)(iter([batch] * 3)):
            held.append(len(encoder.known))
        assert not len(encoder.known)
    assert len(alone) == 20 and max(held) <= 40 + 600


def test_trusted_rows_are_those_labelled_1(spark):
    """The bitmap and the join together find every row of every id labelled 1, and no other."""
    from fieldmart.llm import quality

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(5, "again"), (5, "again"), (None, "n"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 5)) for i in range(4000)] + [(None, 1), (5, 1), (3, None)], "doc_id long, quality int")
    got = sorted(r["text"] for r in quality.trusted_rows(docs, labels).collect())
    assert got == sorted([f"t{i}" for i in range(3000) if i % 7 == 5] + ["again", "again"])


def test_ratio_equals_plain_counts(spark):
    """Mean log ratio by hand over the same hashed features."""
    from pyspark.sql import functions as F

    from fieldmart.llm import quality

    texts = ["Alpha beta  gamma", "beta beta", "delta\talpha", None, "", "gamma x y z " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    tokens = [(t or "").lower().split() for t in texts]
    bags = [[(w,) for w in ts] + list(zip(ts, ts[1:], strict=False)) for ts in tokens]
    names = sorted({g for b in bags for g in b})
    frame = spark.createDataFrame([(list(g),) for g in names], "g array<string>")
    one, two = F.xxhash64(F.get("g", F.lit(0))), F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1)))
    bucket = {tuple(r["g"]): r["b"] for r in frame.select("g", F.pmod(F.when(F.size("g") == 1, one).otherwise(two), F.lit(quality.BUCKETS)).alias("b")).collect()}
    raw, trusted = Counter(bucket[g] for b in bags for g in b), Counter(bucket[g] for k in (0, 1, 4) for g in bags[k])
    size = quality.BUCKETS
    p = lambda b: (raw[b] + 1) / (raw.total() + size)
    ratio = lambda b: np.log((trusted[b] + size * p(b)) / (trusted.total() + size) / p(b))
    want = {k: float(np.mean([ratio(bucket[g]) for g in bag])) if bag else 0.0 for k, bag in enumerate(bags)}
    got = {r["doc_id"]: r["score"] for r in quality.assess(docs, labels).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert quality.assess(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("counts", [{1000: 1, 400: 1}, {1000: 3, 400: 4, 500: 2}, {1200: 5, 700: 2, 400: 9}])
def test_rows_of_a_packing_do_not_follow_the_counts(counts):
    """A hundred times the pieces of each length make as many rows, and a hundred times the bins at most."""
    from fieldmart.llm import packing

    few, many = (packing.pack_counts({x: n * k for x, n in counts.items()}) for k in (20, 2000))
    assert len(many) <= len(few) + 8
    bins = [max(r[3] + r[2] for r in rows) for rows in (few, many)]
    assert bins[1] <= 100 * bins[0]

"""Operators for training text: brute force on small frames, and awkward input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldmart.llm import chat, decontaminate, html, langid, neardup, packing, pii, quality, sharding, textarrays, toxicity
from fieldmart.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h_key string, length long"
PROSE = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old oak tree near the river bank at dawn"
ODD = [
    (None, PROSE, "en", "s", 1, "x", 1), (1, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 1), (3, " \n ", "en", "s", 3, "x", 1),
    (4, PROSE, "en", "s", 1, "x", 1), (4, PROSE, "en", "s", 1, "x", 1), (5, "word " * 30_000, "en", "s", 1, "x", 1), (6, "123 !!", "de", "s", 1, "x", 1),
    (7, PROSE + " and mail to ann@example.org", "en", "s", 1, "x", 1), (8, "höchst übel " * 40, "de", "s", 1, "x", 1),
]
LABELS = [(4, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (4, 1, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(textarrays.WORD_RE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_and_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = pa.array([PROSE, None, "", "Ünï cödé x" * 50, "a" * 5000 + " b"])
    whole = textarrays.Words(texts)
    assert whole.count.tolist() == [len(words(t)) for t in texts.to_pylist()]
    monkeypatch.setattr(textarrays, "BLOCK_BYTES", 64)
    assert (textarrays.Words(texts).hash == whole.hash).all()


def test_tokens_equal_the_tokenizer():
    rnd = random.Random(5)
    letters = [chr(i) for i in range(0x250)] + ["'s", "'re", "''", "'LL", " ", "\n", "<|endoftext|>", "α", "é"] * 9
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(1500)] + ["", "'", PROSE]
    encoder = packing.tokens(vocabulary())
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(ids) for ids in encoder.encode(texts)] == want


@pytest.mark.parametrize("seed", range(40))
def test_every_count_is_packed_without_gaps(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([8, 20, 64])
    counts = {rnd.randint(1, capacity): rnd.randint(1, 30) for _ in range(rnd.randint(0, 15))}
    bins, used = {}, {}
    for length, first, n, sequence, offset in packing.pack_counts(counts, capacity):
        assert first == used.get(length, 0)
        used[length] = first + n
        for i in range(n):
            bins.setdefault(sequence + i, []).append((offset, length))
    assert used == counts
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_reduction_fixes_only_pairs_that_fill_or_dominate():
    assert packing.reduce_dominated({7: 2, 3: 5}, 10) == [(7, 3, 2)]
    counts = {6: 1, 2: 4}
    assert packing.reduce_dominated(counts, 10) == [] or sum(counts.values()) < 5


def test_packing_odd_input(spark, odd, empty):
    rows = packing.pack(odd, vocabulary(), 256).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert [by_doc[k][0]["length"] for k in (1, 2, 3)] == [1, 1, 1] and len(by_doc[4]) == 2
    assert sum(r["length"] for r in by_doc[5]) == 30_001 and all(r["length"] <= 256 for r in rows)
    assert packing.pack(empty, vocabulary()).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(1)
    pool = [f"w{i}" for i in range(300)]
    docs = []
    for family in range(12):
        base = rnd.choices(pool, k=rnd.choice([3, 40, 120]))
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 8])):
                copy[rnd.randrange(len(copy))] = rnd.choice(pool)
            docs.append((len(docs), " ".join(copy)))
    sets = [set(zip(*[words(t)[i:] for i in range(5)])) or {tuple(words(t))} for _, t in docs]
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {d: root(d) for d, _ in docs}
    assert sum(r["keep"] for r in found) == len({root(d) for d, _ in docs})


@pytest.mark.parametrize("edits", [(1, 3, 5), (4, 5, 6, 7), (0, 9, 30)])
def test_no_link_is_lost_beyond_the_hub(spark, edits):
    rnd = random.Random(sum(edits))
    base = [f"w{i}" for i in range(120)]
    texts = [list(base)]
    for _ in range(60):  # edited copies of the hub, and of one another
        copy = list(rnd.choice([base, texts[rnd.randrange(len(texts))]]))
        for _ in range(rnd.choice(edits)):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.choice([0, 1, 1])] = rnd.choice([[], [f"n{rnd.randrange(40)}"]])
        texts.append(copy[: rnd.choice([len(copy), len(copy), 95])])
    sets = [set(zip(*[t[i:] for i in range(5)])) for t in texts]

    def alike(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    label = {v: 0 if alike(0, v) else v for v in range(len(texts))}
    members = spark.createDataFrame([(0, v, label[v]) for v in label], "hub long, v long, label long")
    frame = spark.createDataFrame([(v, " ".join(t)) for v, t in enumerate(texts)], "v long, text string")
    found = {(r["a"], r["b"]) for r in neardup.beyond_hub(members, frame, 0.8).collect()}
    links = {(a, b) for b in label for a in range(b) if label[a] != label[b] and alike(a, b)}
    assert links and links <= found


def test_copies_with_edits_of_their_own_are_not_paired(spark):
    rnd = random.Random(3)
    texts = [[f"w{i}" for i in range(200)]]
    for v in range(150):
        copy = list(texts[0])
        for at in rnd.sample(range(2, 198), 12):
            copy[at] = f"own{v}x{at}"
        texts.append(copy + "with one closing line that all of them share".split())
    members = spark.createDataFrame([(0, v, v) for v in range(len(texts))], "hub long, v long, label long")
    frame = spark.createDataFrame([(v, " ".join(t)) for v, t in enumerate(texts)], "v long, text string")
    assert neardup.beyond_hub(members, frame, 0.8).count() < 150


def test_near_duplicates_odd_input(odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and sorted(r["class_size"] for r in rows) == [1] * 7 + [3] * 3
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert neardup.near_duplicates(empty).count() == 0


def test_chat_layouts_and_round_trip(spark):
    hard = ["<|im_end|>", "<\\|a", "<|<|", "%0A%25", "x\ny", "", None]
    rows = [(i, None, None, [(r or "user", t) for r in ("user", "gpt") for t in hard]) for i in range(2)] + [(7, "q<|", "a", None), (8, None, None, None), (9, "only", None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, prompt string, completion string, messages array<struct<role:string,content:string>>")
    turns = chat.canonical_turns(frame)
    assert {r["conv_id"]: r["n"] for r in turns.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {0: 14, 1: 14, 7: 2}
    back = [(chat.read_back(r["formatted"]), (r["role"], r["text"])) for r in chat.format_turns(turns).join(turns.drop("role"), ["conv_id", "turn"]).collect()]
    assert all(a == b for a, b in back)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(turns)).collect()}
    assert got[7]["turns_sha256"] == hashlib.sha256(b"user\nq<|\nassistant\na\n").hexdigest() and got[7]["loss_chars"] == 1
    assert chat.digest(chat.format_turns(turns.limit(0))).count() == 0


def test_fingerprints_do_not_depend_on_field_order():
    assert chat.fingerprint(["b", "a[].c"]) == chat.fingerprint(["a[].c", "b"]) != chat.fingerprint(["a.c", "b"])


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms = ["idiot", "moron", "disgusting", "scum", "lost*"]
    lexicon, rnd = toxicity.Lexicon(terms), random.Random(0)
    for _ in range(3000):
        word = list(rnd.choice(terms).strip("*"))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randint(0, len(word))
            word[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "t", "s"])
        word = "".join(word)
        near = [d for t in terms[:-1] if (d := distance(t, word)) <= toxicity.allowed_edits(t)]
        assert lexicon.edits(word) == (0 if word.startswith("lost") else min(near, default=None))


def test_misspelled_stems_and_short_terms_match():
    lexicon = toxicity.Lexicon(["achkeite*", "achkeitenbo", "scum", "lost*"])
    assert lexicon.match("achkeiteraus") == (0, False) and lexicon.edits("achkxiteraus") == 1 and lexicon.edits("ackxiteraus") == 2
    assert lexicon.match("scumm") == (1, True) and lexicon.match("scum") == (0, False) and lexicon.edits("losing") is None
    toxic = {"achkeite*": 40, "achkeitenbo": 20, "achkeitedo": 20}
    assert set(toxicity.choose_terms(toxic, {}, 400, 3000)) == set(toxic)
    matcher = toxicity.Matcher(lexicon)
    x, n = toxicity.features(pa.array(["so scumm", "so achkxitenbo", "so fine"]), matcher)
    assert n.tolist() == [1, 1, 0] and 0 < x[0, 1] < x[1, 1] and x[:, 0].tolist() == [0, 0, 0]


def test_signs_beyond_ascii_end_words_and_quotations_have_no_width():
    matcher = toxicity.Matcher(toxicity.Lexicon(["idiot", "scum"]))
    far = "plain " * 200
    texts = ["“idiot” here", "idiot—really", "such an idiot\u00a0he is", "¡idiot!", "so „idiot“ then idiot", f'x "{far} idiot {far}" y',
             f'"{far}" then {far} idiot "{far}"', f'open " {far} idiot', "« idiot » then", f"“{far}\nidiot”", None, "日本idiot", 'a "b" idiot "c"']
    x, n = toxicity.features(pa.array(texts), matcher)
    quoted = [(bool(a), bool(q)) for a, q in zip(x[:, 0], x[:, 2])]
    assert n.tolist() == [1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 0, 0, 1]
    assert quoted == [(False, True), (True, False), (True, False), (True, False), (True, True), (False, True),
                      (True, False), (True, False), (False, True), (True, False), (False, False), (False, False), (True, False)]
    assert {w for t in texts for w in toxicity.terms_of(t)} >= {"idiot", "really", "idio*"}
    assert not any(c in w for t in texts for w in toxicity.terms_of(t) for c in "“”„—¡«»\u00a0")


def test_toxicity_learns_and_heeds_quotation(spark, odd):
    text = lambda i, w: f"plain words stand here about item number{i} and then {w} follows with more plain words"
    docs = [(i, text(i, "stupid" if i % 3 == 0 else "gentle")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    extra = [(1000, text(1, "stupidd")), (1001, 'they said "stupid" once'), (1002, None), (1003, "")]
    found = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(docs + extra, "doc_id long, text string"), labels).collect()}
    assert all(found[i]["predicted"] == int(i % 3 == 0) for i in range(300))
    assert found[1000]["n_matches"] == 1 and found[1001]["predicted"] == 0 and found[1002]["predicted"] == found[1003]["predicted"] == 0
    assert found[3]["held_out"] == (zlib.crc32(b"3") % 3 == 1)
    none = toxicity.score(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == len(ODD) and none.filter("score > 0").count() == 0


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>First  para, with commas, and
some length to it so that it counts.<p><b>Second &lt;para<br>line<p>Third one, &eacute;l&egrave;ve.</article><aside>Side</aside>
<div id="comments"><p>Nice, very nice, I like it a lot indeed.</p></div><form><p>Sign up</p></form><footer>&copy; me</footer>"""


def test_html_keeps_the_article_alone(spark):
    assert html.main_blocks(PAGE) == ["Head & more", "First para, with commas, and some length to it so that it counts.", "Second <para line", "Third one, élève."]
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<div>" * 3000 + "deep text", "x"), (None, "u", "<script>x", "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {r["page_id"]: r["n_chars"] for r in got}[4] == 9 and sum(r["text"] == "" for r in got) == 3 and len(got) == 6


def test_html_divs_without_article():
    page = "<body><div class=menu><a href=1>one</a></div><div id=c><h2>Title</h2><p>" + PROSE + ", yes.</p><p>" + PROSE + "</p></div><div><a href=2>link link</a></div></body>"
    assert html.main_blocks(page) == ["Title", PROSE + ", yes.", PROSE]


def brute_hits(text, items):
    """Words of the text inside a window of any item, and the items that occur."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, met = find(text), set(), set()
    for item_id, item in items:
        item = find(item)
        n = min(10, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == item[i : i + n]:
                    hit.update(range(j, j + n))
                    met.add(item_id)
    return len(doc), len(hit), sorted(map(str, met))


def contaminated(spark, docs, items):
    frame = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in frame.collect())


def test_decontamination_equals_brute_force(spark, odd, empty):
    rnd = random.Random(2)
    pool = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(pool, k=n))) for i, n in enumerate([1, 3, 9, 10, 11, 25, 60, 0])] + [(20, None), (21, "V1 v2 v3"), (22, "v1 v2 v3")]
    docs = [(i, " ".join(rnd.choices(pool, k=30)) + " " + " ".join(items[i % 8][1].split()[: rnd.randint(5, 40)]) + " end") for i in range(60)] + [(60, None), (61, ""), (0, "v1 v2 v3")]
    assert contaminated(spark, docs, items) == sorted((d, *brute_hits(t, items)) for d, t in docs)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(odd, nothing).count() == len(ODD) and decontaminate.contamination(empty, nothing).count() == 0
    items = spark.createDataFrame([(1, "the quick brown fox", "x")], "item_id long, text string, doc_id string")
    assert decontaminate.contamination(odd, items).count() == len(ODD) and decontaminate.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0


def test_a_phrase_of_all_items_and_documents_is_no_hit(spark):
    phrase = "which of the following is true of the"
    items = [(i, f"{phrase} item{i} a{i} b{i}, c{i}") for i in range(60)] + [(60, "É—x  " * 6)]
    docs = [(i, f"{phrase} text{i} of another kind. {phrase} " + (items[i][1].upper() if i % 7 == 0 else "end")) for i in range(60)]
    docs += [(100, "é—X" + "." * 5000 + "É—x É—X É—x É—x É—x"), (101, "wörter " * 50_000 + items[3][1])]
    want = sorted((d, *brute_hits(t, items)) for d, t in docs if d != 101)
    got = contaminated(spark, docs, items)
    assert got[:-1] == want and got[-1][2:] == (12, ["3"])
    assert all(len(ids) <= 1 for *_, ids in got)


def test_quality_counts_equal_brute_force(spark, odd):
    rnd = random.Random(4)
    texts = ["\n".join(" ".join(rnd.choices("a b c dd # $x".split(), k=rnd.randint(0, 6))) for _ in range(rnd.randint(0, 8))) for _ in range(60)] + ["word " * 80, None, "", "\x0b a \t"]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect():
        text = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\f\r")]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["base_failed"] == (len(w) < 50 or 2 * len(inside) > len(w))
    assert quality.assess(odd, labels).count() == len(ODD)


def test_every_trusted_document_counts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "alpha").otherwise("beta").alias("text"))
    good = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    strangers = spark.range(1000, 61_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    few, many = (quality.log_ratios(docs, labels).first()["ratios"] for labels in (good, good.unionByName(strangers)))
    assert few == many and max(few) > 0


def test_languages_and_mixtures(spark, odd, empty):
    en, de = "the house and the garden with this other thing that was here", "und das haus mit dem garten der nicht immer schön gewesen ist"
    docs = [(i, " ".join(random.Random(i).choices((en if i % 2 else de).split(), k=60)), "en" if i % 2 else "de") for i in range(200)]
    langs, model = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    pi, size = langid.infer(textarrays.Words(pa.array([en * 5, (en + " ") * 6 + (de + " ") * 3, None])), model)
    assert langs == ["de", "en"] and size.tolist() == [1, 2, 0] and pi[0, 1] == 1 and 0.2 < pi[1, 0] < 0.45
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(docs + [(900, "123", "en"), (901, None, "en")], "doc_id long, text string, lang string")).collect()}
    assert np.mean([found[i] == ("en" if i % 2 else "de") for i in range(200)]) == 1 and found[900] == found[901] == "und"
    assert langid.identify(odd).count() == len(ODD) and langid.identify(empty).count() == 0


def brute_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if fine[kind]:
                yield kind, *m.span()


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(3)
    parts = ["@", "a", "b", ".", "1", "2", "+", "-", " ", "4111111111111111", "_", "x@y.z", "1.2.3.4", "(", ")", "é"]
    for _ in range(5000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 30)))
        assert pii.base_spans(text) == list(brute_spans(text))


def test_telling_terms_are_removed(spark, odd, empty):
    docs = [(i, f"filler words here number{i} again") for i in range(600)] + [(1000 + i, f"Note {i}a zorblax wrote from ann.zor@mail.org on item{i}") for i in range(5)] + [(2000, "é zorblax alone")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(frame, min_bits=5.0).collect()}
    assert found[2000]["terms"] == ["term:2:9"] and found[5]["terms"] == [] and found[1000]["base"] == ["email:27:43"]
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(frame, min_bits=5.0).collect()}
    assert texts[2000] == "é [TERM] alone" and texts[1000].startswith("Note 0a [TERM]") and "[EMAIL]" in texts[1000] and texts[5] == docs[5][1]
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD) and clean.filter("text LIKE '%[EMAIL]'").count() == 1
    assert pii.sanitise(empty).count() == 0


def test_neighbours_are_whole_words_at_any_distance():
    near = lambda t: {w for w, _ in pii._near(t, pii.base_spans(t))}
    long, run = "w" * 150, "日" * 300
    assert near(f"one two {long}{' ' * 500}three{',' * 400}ann@mail.org{' ' * 300}{run}{'-' * 200}four five six") == {"two", long, "three", run, "four", "five"}
    assert near("«zorblax» 1.2.3.4 — “next”") == {"zorblax", "next"}
    assert near("abc1.2.3.4def ghi") == {"ghi"} and near("1.2.3.4") == set()
    rnd = random.Random(8)
    for _ in range(500):
        text = "".join(rnd.choices(["abc", "defg", " ", "é", "—", "9.9.9.9", "x@y.zz", "  ", "日本"], k=rnd.randint(1, 40)))
        spans = pii.base_spans(text)
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9A-Za-zé日本]+", text)]
        want = set()
        for _, a, b in spans:
            left = [w for w in found if w[1] <= a][-3:]
            right = [w for w in found if w[0] >= b][:3]
            want |= {w for s, e, w in left + right if len(w.encode()) >= 3 and not w.isdigit() and not any(x < e and s < y for _, x, y in spans)}
        assert near(text) == want, text


def test_terms_tell_entities_of_any_level_in_tables_of_any_size(spark):
    def marked(docs):
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
        return {docs[r["doc_id"]][int(a) : int(b)] for r in pii.find(frame).collect() for _, a, b in (s.split(":") for s in r["terms"])}

    def filler(n):
        return [f"common words stand here as filler{i} does" for i in range(n)]

    def beside(address, term, n):  # no neighbour but the term is met again elsewhere
        return [f"x{i}a x{i}b common x{i}c {term} here {address(i)} words y{i}a y{i}b" for i in range(n)]

    same = beside(lambda i: "ann@mail.org", "zorblax", 3)
    assert all(marked(same + filler(n)) == {"zorblax"} for n in (30, 700, 3000))
    assert marked(same + beside(lambda i: "", "zorblax", 4) + filler(30)) == set()
    # Every value once: the domain, the owner's name and the kind have the support.
    assert marked(beside(lambda i: f"u{i}x@corp.example", "quuxly", 4) + filler(60)) == {"quuxly"}
    assert marked(beside(lambda i: f"ann.{i}@m{i}.example", "quuxly", 4) + filler(60)) == {"quuxly"}
    assert marked(beside(lambda i: f"10.{i}.2.7", "quuxly", 4) + filler(60)) == {"quuxly"}
    # An address that a third of all rows show.
    assert marked(beside(lambda i: "info@hot.example", "hotline", 300) + filler(600)) == {"hotline"}
    # All texts show it, or copies of one text do: nothing is given away.
    assert marked(beside(lambda i: "info@hot.example", "hotline", 30)) == set()
    assert marked(beside(lambda i: "info@hot.example", "hotline", 1) * 300 + filler(600)) == set()


def test_shards_are_even_and_gapless(spark, odd, empty):
    docs = [(i, "x" * (i % 90)) for i in range(2000)] + [(5000 + i, "hot text") for i in range(1000)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(dict(docs)[r["doc_id"]].encode())
    assert len(rows) == 3000 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(empty).count() == 0


def test_pipeline_stages(spark, odd, tmp_path):
    (tmp_path / "d").mkdir()
    odd.write.parquet(str(tmp_path / "d/documents.parquet"))
    spark.createDataFrame([(1, PROSE.replace("lazy", "tired"))], "item_id long, text string").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    docs = odd
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "d"))
        assert docs.columns == odd.columns
        left.append(docs.count())
    assert left == [6, 4, 2, 2]
    assert corpus_pipeline.run(spark, str(tmp_path / "d")).select("doc_id").distinct().count() == 2

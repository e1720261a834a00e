import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import decontamination as leak, fingerprints as marks, language, private_data as private, quality, queries
from tests.llm.conftest import EDGES

FOLDER = "/root/testdata/sf0.01"


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op1_quality_classifier(spark, FOLDER).collect()
    assert len(rows) == 1000 and all(r.held_out == (bucket(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([y == p for _, y, p in held]) > 0.95


def test_risk_stays_non_negative_and_prior_is_found():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, (800, 3))
    unlabelled = np.concatenate((rng.normal(2, 1, (1200, 3)), rng.normal(-2, 1, (800, 3))))
    first = quality.minimise(positive[::2], unlabelled[::2], 0.5)
    prior = quality.class_prior(first.logits(positive[1::2]), first.logits(unlabelled[1::2]))
    assert 0.5 < prior < 0.72
    scores = quality.minimise(positive, unlabelled, prior).scores(unlabelled)
    assert np.mean((scores > 0.5) == (np.arange(2000) < 1200)) > 0.97


def test_quality_edges(spark, table_of):
    df = table_of(EDGES)
    none = spark.createDataFrame([], "doc_id long")
    assert quality.fit(df, none) is None
    assert {r.score for r in quality.score(df, None, ["doc_id"]).collect()} == {0.5}
    model = quality.fit(df, spark.createDataFrame([(4,), (4,), (7,)], "doc_id long"))
    rows = quality.score(df, model, ["doc_id"]).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(table_of([]), model, ["doc_id"]).count() == 0


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op7_language_id(spark, FOLDER).collect()
    assert len(rows) == 1000 and all(r.held_out == (bucket(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_profiles_and_distance_by_hand(spark):
    df = spark.createDataFrame([("aa ab", "x"), ("ab!", "x"), ("ba", "y"), (None, "y"), ("..", "y"), ("zz", None)], "text string, lang string")
    profiles = language.learn(df, size=4)
    grams = language.Grams()
    top = language._top(grams.keys(grams.letters("aa ab AB")), 4)
    place = {g: i for i, g in enumerate(profiles.grams.tolist())}
    assert profiles.languages == ["x", "y"]
    assert [profiles.ranks[0][place[g]] for g in top.tolist()] == [0, 1, 2, 3]
    assert profiles.nearest(top) == ("x", 1.0)
    told = language.identify(df, profiles, ["lang"]).collect()
    assert [(r.lang_pred, r.score) for r in told if r.lang == "y"][1:] == [("und", 0.0)] * 2


def test_language_edges(table_of):
    df = table_of(EDGES).withColumn("lang", F.lit("x"))
    rows = language.identify(df, language.learn(df), ["doc_id"]).collect()
    assert len(rows) == len(EDGES)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    nothing = language.learn(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language.identify(df, nothing, ["doc_id"]).collect()} == {("und", 0.0)}
    assert language.identify(table_of([]), nothing, ["doc_id"]).count() == 0


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def found_spans(df):
    return private.find(df, ["doc_id", "text"]).select(
        "doc_id", private.listed(F.col("base")).alias("base"), private.listed(F.col("spans")).alias("spans"),
        private.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()


def test_seed_spans_against_brute_force(table_of):
    rng = random.Random(8)
    cases = ["a@b.c", "x..y@a.b..c@d.e", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 0255.000001.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 12",
             "41111111111111111111", "+1 (487) 555-7209.", "+49 ++1 234 5678 ", " 1 2" * 9000, "a@" + "b." * 20000 + "c", "+1" + "(" * 20000, "é𝒳 a@b.co 😀 4111111111111111 1.1.1.1",
             "x@y", ".@a.b", "4111  1111 1111 1111 1111-", "1" * 50000, "1." * 30000, None, ""]
    cases += ["".join(rng.choice("aZ09 1+@.-_().4é\n%") for _ in range(rng.randint(5, 60))) for _ in range(1500)]
    rows = found_spans(table_of(list(enumerate(cases))))
    for r in rows:
        assert r.base == brute_spans(cases[r.doc_id]), cases[r.doc_id]
        assert set(r.base.split(",")) <= set(r.spans.split(",")) | {""}
    assert {r.clean for r in rows if r.doc_id == 13} == {"é𝒳 <EMAIL> 😀 4111111111111111 <IP>"}  # seventeen digits without a break


def test_confident_contexts_find_more(table_of):
    seeds = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "5105105105105100"]
    rows = [(i, f"card number {n} expires soon") for i, n in enumerate(seeds)]
    rows += [(10, "card number 4111111111111112 expires soon"), (11, "the year 19451945 ended here"), (12, "card number 12 expires soon")]
    spans = {r.doc_id: r.spans for r in found_spans(table_of(rows))}
    assert spans[10] == "card:12:28" and spans[11] == "" and spans[12] == ""


def test_contexts_of_emails_and_spaced_numbers(table_of):
    rows = [(i, f"e-mail: {n}@x.org") for i, n in enumerate("abcdefgh")]
    rows += [(10 + i, f"phone +1 (017) 555-77{i}3") for i in range(10)]
    rows += [(20 + i, f"card no {n} | 12") for i, n in enumerate(["4111 1111 1111 1111", "5500 0055 5555 5559", "4012 8888 8888 1881", "6011 1111 1111 1117", "5105 1051 0510 5100"])]
    rows += [(30, "e-mail: bob@localhost"), (31, "phone (017) 555 7713"), (32, "card no 4111 1111 1111 1112 |"), (33, "word bob@localmost"), (34, "year 1945 1946")]
    spans = {r.doc_id: r.spans for r in found_spans(table_of(rows))}
    assert [spans[i] for i in range(30, 35)] == ["email:8:21", "phone:7:20", "card:8:27", "", ""]


def test_private_edges(table_of):
    rows = found_spans(table_of(EDGES))
    assert len(rows) == len(EDGES) and all(r.spans == "" for r in rows)
    assert {r.clean for r in rows if r.doc_id == 1} == {None}
    assert private.find(table_of([]), ["doc_id"]).count() == 0


def levenshtein_indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_fingerprints_of_edited_texts(table_of, corpus):
    rows = list(corpus.items()) + [(10_000, ""), (10_001, None), (10_002, "x"), (10_003, "y" * 5000)]
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    got = marks.fingerprints(table_of(rows, 6)).collect()
    assert len(got) == len(rows)
    for r in got:
        own, following = text[r.doc_id], text[after[r.doc_id]]
        half = len(own) // 2
        edited = own[:len(own) - half] + following[:half]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == marks.fingerprint(own) and r.edited_fingerprint == marks.fingerprint(edited)
        assert r.near_edited == marks.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == marks.likeness(r.fingerprint, marks.fingerprint(following))
    real = [r for r in got if r.doc_id in corpus]
    assert np.mean([r.near_edited > 0.3 for r in real]) > 0.95 and np.mean([r.near_next > 0.3 for r in real]) < 0.05


def test_likeness():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert marks.distance(a, b) == levenshtein_indel(a, b)
    assert marks.likeness("3::", "3::") == 1.0 and marks.likeness("3::", "3:AB:A") == 0.0
    assert marks.likeness("3:ABCDEFGHIJKL:ABCDEF", "96:ABCDEFGHIJKL:ABCDEF") == 0.0
    assert marks.likeness("6:ABCDEFGHIJKL:X", "3:Y:ABCDEFGHIJKL") == 1.0


def test_fingerprint_edges(table_of):
    assert len(marks.fingerprints(table_of(EDGES)).collect()) == len(EDGES)
    assert marks.fingerprints(table_of([])).count() == 0
    single = marks.fingerprints(table_of([(3, "only one")])).collect()[0]
    assert single.near_next == 1.0
    double = marks.fingerprints(table_of([(None, "abc"), (None, "abc"), (2, "q")])).collect()
    assert len({r.fingerprint for r in double if r.doc_id is None}) == 1


def leak_corpus(seed=3):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "to", "in"], [f"term{i}" for i in range(3000)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]

    items = [prose(rng.randint(9, 55)) + [rng.choice(rare) for _ in range(5)] for _ in range(50)]  # answers of rare words
    docs, planted = [], {}
    for i in range(400):
        words = prose(rng.randint(20, 400))
        kind = ("clean", "copy", "paraphrase", "third", "no answer")[i % 5 if i < 250 else 0]
        if kind != "clean":
            k = rng.randrange(50)
            item = list(items[k])
            if kind == "paraphrase":  # a quarter of the words before the answer replaced
                for at in rng.sample(range(len(item) - 5), (len(item) - 5) // 4):
                    item[at] = rng.choice(rare)
            elif kind == "third":
                item = item[:len(item) // 3]
            elif kind == "no answer":  # loose wording and another answer
                lost = set(rng.sample(range(len(item) - 5), (len(item) - 5) * 2 // 5))
                item = [rng.choice(rare) if at in lost else w for at, w in enumerate(item[:-5])] + [rng.choice(rare) for _ in range(5)]
            at = rng.randrange(len(words))
            words[at:at] = item
            planted[i] = (k, kind)
        docs.append((i, " ".join(words).capitalize() + "."))
    return docs, [(k, " ".join(w) + "!") for k, w in enumerate(items)], planted


def test_leaks_against_brute_force(spark, table_of):
    docs, items, planted = leak_corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaks(table_of(docs), bench).collect()}
    known = leak.Items.of(items)
    numbers = leak._Numbers(known.vocabulary)
    texts = {}
    frequency = np.zeros(len(known.vocabulary) + 1)
    for i, t in docs:
        own = np.array([numbers[w] for w in t.split()], dtype=np.int32)
        texts[i] = own[own >= 0]
        frequency[np.unique(texts[i])] += 1
    weights = leak.word_weights(frequency, len(docs))
    want = set()
    for i, own in texts.items():
        for k, item in zip(known.ids, known.words):
            regions = (own[max(0, b - item.size):b + 2 * leak.BLOCK + item.size] for b in range(0, max(1, own.size), leak.BLOCK))
            if any(leak.judged(item, r, weights) is not None for r in regions):
                want.add((i, k))
    assert got <= want and len(got) >= 0.9 * len(want)
    for kind, caught in (("copy", 1.0), ("paraphrase", 0.9)):
        own = [(i, k) for i, (k, what) in planted.items() if what == kind]
        assert np.mean([p in got for p in own]) >= caught
    clean = {i for i, _ in docs} - planted.keys() | {i for i, (_, what) in planted.items() if what in ("third", "no answer")}
    assert not {i for i, _ in got} & clean


def test_leaks_in_blocks_of_items(spark, table_of):
    docs, items, planted = leak_corpus(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaks(table_of(docs[:60]), bench, block=20).collect()}
    assert {(i, k) for i, (k, what) in planted.items() if what == "copy" and i < 60} <= got


def test_leak_edges(spark, table_of):
    bench = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (2, None), (3, " "), (4, "lorem ipsum dolor sit amet")], "item_id long, text string")
    rows = leak.leaks(table_of(EDGES), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(4, 1), (5, 4)}
    assert leak.leaks(table_of([]), bench).count() == 0
    assert leak.leaks(table_of(EDGES), bench.limit(0)).count() == 0
    assert leak.common_subsequence(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 2, 4])) == 3


def test_leaks_diluted_by_other_benchmark_words(spark, table_of):
    rng = np.random.default_rng(12)
    chosen = lambda n, low, high: [f"w{x}" for x in rng.integers(low, high, n)]
    items = [(k, " ".join(chosen(15, 0, 300) if k % 2 else chosen(40, 300, 4000))) for k in range(2000)]
    docs = [(i, " ".join(chosen(80 + i % 37, 300, 4000) + items[i * 20 + 1][1].split() + chosen(90, 300, 4000))) for i in range(100)]
    docs += [(i, " ".join(chosen(200, 0, 300))) for i in range(100, 200)]  # they make the words of the short items light
    got = {(r.doc_id, r.item_id) for r in leak.leaks(table_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    known = leak.Items.of(items)
    texts = [np.array([known.vocabulary.get(w, 0) for w in text.split()], dtype=np.int32) for _, text in docs]
    frequency = np.zeros(len(known.vocabulary) + 1)
    for own in texts:
        frequency[np.unique(own)] += 1
    weights = leak.word_weights(frequency, len(docs))
    want = {(i, k) for i, own in enumerate(texts) for k in range(1, 2000, 20) if any(
        leak.judged(known.words[k], own[max(0, b - 15):b + 2 * leak.BLOCK + 15], weights) is not None for b in range(0, own.size, leak.BLOCK))}
    assert {(i, i * 20 + 1) for i in range(100)} <= want <= got


def plain_profile(text, size):
    """Most frequent n-grams of a text by strings and counters alone, in order."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not runs:
        return []
    s = " " + " ".join(runs) + " "
    grams = [c for c in s if c != " "] + [s[i:i + 2] for i in range(len(s) - 1)] + [s[i:i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]
    packed = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    counts = Counter(grams)
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:size]


def test_out_of_place_distances_by_hand(spark, corpus):
    texts = {"a": list(corpus.values())[:40], "b": ["όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι", "Ünïcode Straße 日本語 x1y"], "c": ["the end of the thing"]}
    rows = [(t, name) for name, own in texts.items() for t in own]
    profiles = language.learn(spark.createDataFrame(rows, "text string, lang string").repartition(3), size=50)
    known = {name: {g: i for i, g in enumerate(plain_profile(" \n ".join(own), 50))} for name, own in texts.items()}
    asked = list(corpus.values())[40:60] + ["και οι", "x", "thing", "日本 日本", "a b c d"]
    got = language.identify(spark.createDataFrame([(t,) for t in asked], "text string"), profiles, ["text"]).collect()
    for r in got:
        own = plain_profile(r.text, 50)
        apart = {name: sum(abs(ranks[g] - i) if g in ranks else 50 for i, g in enumerate(own)) for name, ranks in known.items()}
        best = min(sorted(apart), key=apart.get)
        assert r.lang_pred == best and abs(r.score - max(0, 1 - apart[best] / (50 * len(own)))) < 1e-12


def test_foreign_and_junk_texts_fall_below_the_floors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    profiles = language.learn(docs)
    floors = language.calibrate(docs, profiles)
    kept = language.identify(docs, profiles, ["doc_id", "lang", "text"]).withColumn("gone", floors.rejected())
    assert kept.filter("gone AND lang = lang_pred").count() <= 2
    foreign = [
        "ni vse zlato kar se sveti toda zgodba o zlatu gre naprej skozi vse vasi in mesta brez konca " * 6,
        "yksi kaksi kolme hyvää päivää kaikille ystäville jotka lukevat tämän tekstin äänettömästi tänään " * 6,
        "każdy człowiek rodzi się wolny i równy pod względem swej godności oraz swych praw " * 6,
        "Все люди рождаются свободными и равными a в своем достоинстве и правах " * 6,
        "人人生而自由在尊严和权利上一律平等 a " * 30, "qzx jjk vvw xqq zzk kkj wvq " * 20, "0101 $$ ## 1e7 x9 " * 40, "aaaaaaaa" * 60,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    gone = {r.doc_id for r in language.identify(rows, profiles, ["doc_id", "text"]).filter(floors.rejected()).collect()}
    assert gone >= {0, 1, 3, 4, 5}, gone  # what is told by few n-grams or by those of a like language may pass


def test_every_learning_row_counts_for_the_floors(spark):
    """25 long texts among 45,000 short ones have a length of their own, and a floor."""
    text = F.when(F.col("doc_id") % 1800 == 0, F.repeat(F.lit("some more words of it "), 20)).otherwise(F.lit("some words"))
    docs = spark.range(45_000).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.lit("en").alias("lang"))
    floors = language.calibrate(docs, language.learn(docs))
    assert sorted(size for _, size in floors.least) == [3, 8]


def test_latent_space_takes_every_passage_of_every_document(spark):
    """The product of a step over the corpus is that of its passages one by one, unit TF-IDF rows of two blocks."""
    rng = np.random.default_rng(3)
    sizes = [0, 1, 31, 32, 33, 64, 65, 200, 700, *rng.integers(1, 150, 2500)]
    texts = [rng.integers(0, 600, n) * (rng.random(n) < 0.5) for n in sizes]
    frequency, documents = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=600).astype(float), len(texts)
    weights, feature = leak.word_weights(frequency, documents), rng.permutation(600) % 500
    basis = rng.normal(size=(leak.FEATURES, 12)).astype(np.float32)
    common = np.unique(feature[np.argsort(-frequency[1:])[:50] + 1])
    wanted = np.zeros(basis.shape)
    for t in texts:
        for b in range(max(1, -(-t.size // leak.BLOCK) - 1)):
            own = t[b * leak.BLOCK:(b + 2) * leak.BLOCK]
            x = np.bincount(feature[own[own > 0]], weights=weights[own[own > 0]], minlength=leak.FEATURES)
            if x.any():
                x /= np.linalg.norm(x)
                used = np.flatnonzero(x)
                wanted[used] += np.outer(x[used], x[used] @ basis[used])
    rows = spark.createDataFrame([(i, bytearray(t.astype(np.int32).tobytes())) for i, t in enumerate(texts)], "doc_id long, words binary").repartition(3)
    got = leak._corpus_step(rows, feature, weights, basis, common)
    assert np.abs(got - wanted).max() < 1e-4 * np.abs(wanted).max()


def plain_fingerprint(text):
    """The fingerprint with one state update a byte, pieces gathered as they end."""
    data, letters = text.encode(), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    if not data:
        return "3::"

    def triggers(size):
        out = []
        for i in range(len(data)):
            last, mixed = [data[i - b] if i >= b else 0 for b in range(7)], 0
            for b in range(6, -1, -1):
                mixed = mixed << 5 ^ last[b]
            weighted = sum((8 - b) * last[b] for b in range(7))  # the newest byte counts 8 times, the oldest twice
            if ((weighted + mixed) & 0xFFFFFFFF) % size == size - 1:
                out.append(i)
        return out

    def signature(size, length):
        out, piece = "", b""
        stops = set(triggers(size)[: length - 1])
        for i, c in enumerate(data):
            piece += bytes([c])
            if i in stops:
                out, piece = out + letters[zlib.crc32(piece) & 63], b""
        return out + (letters[zlib.crc32(piece) & 63] if piece else "")

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and len(triggers(size)) + 1 < 32:
        size //= 2
    return f"{size}:{signature(size, 64)}:{signature(2 * size, 32)}"


def test_fingerprints_byte_by_byte(corpus):
    texts = ["", "a", "abc" * 50, "ü" * 300, "\x00\xff zero", "x" * 700, *[t[:1500] for t in list(corpus.values())[:25] if t]]
    assert [marks.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_first_step_goes_down_the_non_negative_risk():
    """Adam's first step moves each weight by the rate, against the sign of the numeric gradient."""
    rng = np.random.default_rng(6)
    positive, unlabelled = rng.normal(0.5, 1, (30, 4)), rng.normal(0, 1, (50, 4))
    seen = set()
    for prior, shift in ((0.3, 0.0), (0.98, 0.0), (0.98, 3.0), (0.98, -3.0)):
        start, after = (quality.minimise(positive + shift, unlabelled, prior, steps=n, rate=0.01, seed=3) for n in (0, 1))

        def parts(weights):
            model = quality.Model(start.centre, start.scale, weights, prior)
            p, u = model.logits(positive + shift), model.logits(unlabelled)
            return prior * np.logaddexp(0, -p).mean(), np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()

        below = parts(start.weights)[1] < 0
        seen.add(below)

        def objective(weights):
            rest, against = parts(weights)
            return (-against if below else rest + against) + 0.5e-4 * sum((w * w).sum() for w in weights)

        for i, w in enumerate(start.weights):
            for at in list(np.ndindex(w.shape))[:12]:
                up, down = ([x.copy() for x in start.weights] for _ in range(2))
                up[i][at] += 1e-5
                down[i][at] -= 1e-5
                slope = (objective(up) - objective(down)) / 2e-5
                if abs(slope) > 1e-6:
                    assert abs((after.weights[i][at] - w[at]) + 0.01 * np.sign(slope)) < 1e-4
    assert seen == {False, True}

"""Operators against plain Python versions, exact round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from comparing import check
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import chat_format, components, hashing, language_id, licenses, line_dedup, minhash, mixing, packing, quality_cnn, registry, vector_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDE = "/root/testdata/sf0.01"


class Sets:
    """Union of ids, the least one stands for all."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, data, name):
    check(spark, data, registry.QUERIES[name], registry.ORACLE_SQL[name])


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_minhash_components(spark, data, docs):
    sets = {r["doc_id"]: shingles(r["text"], 4) for r in docs.collect()}
    groups, ids = Sets(), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    groups.join(a, b)
    got = registry.op9_minhash_dedup(spark, data).collect()
    assert len(got) == len(ids) and sum(not r["kept"] for r in got) > 0
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), groups.find(r["doc_id"]), groups.find(r["doc_id"]) == r["doc_id"])


def test_minhash_family_of_edited_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(120):
        own = list(base)
        for j in rng.sample(range(200), 3):
            own[j] = f"x{i}y{j}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    sets = {i: shingles(t, 4) for i, t in rows}
    groups = Sets()
    for a in sets:
        for b in sets:
            if a < b and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n):
                groups.join(a, b)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: groups.find(i) for i in sets}


def test_components_of_chains_and_stars(spark):
    rng, edges = random.Random(1), [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001)]
    rng.shuffle(edges)
    groups = Sets()
    for a, b in edges:
        groups.join(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: groups.find(x) for e in edges for x in e}


def test_word_hashes_of_long_texts(monkeypatch):
    text = "Ab  cd\té\n" * 500 + "x" * 900
    whole = hashing.word_hashes(text)
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert (hashing.word_hashes(text) == whole).all() and len(whole) == 1501 and len(set(whole)) == 4


def line_words(line):
    return re.sub(r"[\W_]+", " ", line.lower()).split()


def plain_line_dedup(rows):
    """Texts without repeated lines, and how many pairs of different lines are alike: all pairs, by edit similarity alone."""
    places, groups, first = [], Sets(), {}
    for i, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            if len(w := line_words(line)) >= 3:
                places.append((i, k, " ".join(w)))
    for i, k, n in places:
        first.setdefault(n, (i, k))
        groups.join((i, k), first[n])
    names = sorted(first, key=len)
    # An edit changes four counts of letter pairs at most, so other pairs are too far apart to be measured.
    counts = np.zeros((len(names), 256), np.int16)
    for x, n in enumerate(names):
        np.add.at(counts[x], [zlib.crc32(n[k : k + 2].encode()) % 256 for k in range(len(n) - 1)], 1)
    lengths, near = np.array([len(n) for n in names]), []
    for x, a in enumerate(names):
        end = int(np.searchsorted(lengths, len(a) / 0.8 + 1))
        apart = np.abs(counts[x + 1 : end] - counts[x]).sum(axis=1)
        near += [(a, names[y]) for y in x + 1 + np.flatnonzero(apart <= 0.8 * lengths[x + 1 : end] + 1e-9)]
    pairs = pd.DataFrame(near, columns=["a", "b"])  # noqa: F841
    close = duckdb.sql("SELECT a, b FROM pairs WHERE levenshtein(a, b) <= 0.2 * length(b) + 1e-9").fetchall() if near else []
    alike = [(first[a], first[b]) for a, b in close]
    for a, b in alike:
        groups.join(a, b)
    gone = {(i, k) for i, k, _ in places if groups.find((i, k)) != (i, k)}
    return {i: "\n".join(t for k, t in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in rows}, alike


def test_similar_lines_of_the_tables(spark, data, docs):
    """Recall against all pairs by edit similarity; whatever goes is repeated or alike."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"]]
    expected, alike = plain_line_dedup(rows)
    lines = lambda texts: sum(t.count("\n") + 1 for t in texts.values())
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect() if r["text"] is not None}
    same = sum(got[i] == expected[i] for i in expected)
    assert len(alike) > 30 and same >= len(expected) - 2, (len(alike), [i for i in expected if got[i] != expected[i]])
    assert abs(lines({i: got[i] for i in expected}) - lines(expected)) <= 2


def test_similar_lines_of_all_lengths(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + str(rng.randrange(40))
    lines = [" ".join(word() for _ in range(rng.choice([3, 4, 5, 8, 12, 20, 40]))) for _ in range(110)]
    for x in list(lines[:80]):
        w = x.split(" ")
        for _ in range(max(1, len(w) // 12)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[w[at] + "z"], [], [w[at], word()], [word()]])
        lines += [" ".join(w), x.upper() + " !"]
    rows = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(len(lines) // 3)]
    expected, alike = plain_line_dedup(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) > 50
    count = lambda texts: sum(t.count("\n") + 1 for t in texts.values())
    assert sum(got[i] != expected[i] for i in got) <= 0.1 * len(alike) and abs(count(got) - count(expected)) <= 0.1 * len(alike)


def test_mixing_targets(spark, data, docs):
    rows = registry.op2_mix_sources(spark, data).collect()
    text = {r["doc_id"]: r for r in docs.collect()}
    sizes = Counter()
    for r in text.values():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
    taken, largest = Counter(), Counter()
    for r in rows:
        s = text[r["doc_id"]]["source"]
        assert r["size"] == len(WORD.findall(text[r["doc_id"]]["text"] or "")) and r["source_size"] == sizes[s]
        assert abs(r["target"] - target[s]) < 1e-6 * total and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert len(rows) == len(text) and all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    assert sorted(map(repr, rows)) == sorted(map(repr, registry.op2_mix_sources(spark, data).collect()))


@pytest.mark.parametrize("weighed", [False, True])
def test_mixing_by_a_plain_ranking(spark, docs, weighed):
    """Expected copies, ranks and the documents that are taken, source by source in plain Python."""
    by_row = docs.withColumns({"u": mixing._unit(F.col("doc_id"), F.col("text"), F.lit(17)), "chars": F.char_length("text")}).collect()
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs, weight_col=mixing.length_odds() if weighed else None).collect()}
    odd = 0
    for source in {r["source"] for r in by_row}:
        own = []
        for r in by_row:
            if r["source"] == source:
                w = 1.0 if not weighed else 2 ** (round(8 * math.log2(math.log2(2 + (r["chars"] or 0)))) / 8)
                own.append((r["doc_id"], len(WORD.findall(r["text"] or "")), w, r["u"]))
        target = got[own[0][0]]["target"]
        low, high = 0.0, 100.0  # the scale at which the expected words are the target
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(size * min(3, middle * w) for _, size, w, _ in own) < target else (low, middle)
        ranks, taken, copies = [], 0, {}
        for doc, size, w, u in own:
            expected = min(3.0, high * w)
            expected = round(expected) if abs(expected - round(expected)) < 1e-9 else expected
            copies[doc] = int(expected)
            taken += size * int(expected)
            if expected % 1 and size:
                p = expected % 1
                ranks.append(((u / (1 - u)) / (p / (1 - p)), doc, size))
        for _, doc, size in sorted(ranks):
            if taken + size / 2 > target:
                break
            taken += size
            copies[doc] += 1
        sized = {doc for doc, size, _, _ in own if size}
        odd += sum(copies[d] != got[d]["copies"] for d in sized)
    assert odd <= 2  # where rounding decides


def test_special_token_in_a_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a <|endoftext|>b <|endof"
    rows = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep_ids=True).collect()
    assert rows[0]["ids"] == [*plain.encode(text, add_special_tokens=False).ids, 0] and 50256 in rows[0]["ids"]


def test_bins_that_nothing_fits_into(spark):
    """Pieces over half a sequence in many groups: rounds end, and small pieces of other groups still find their places."""
    items = spark.createDataFrame([(i, 1100) for i in range(300)] + [(1000 + i, 900) for i in range(100)], "id long, length long")
    bins = defaultdict(list)
    for r in packing.pack(items, items_per_group=40).collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(len(b) for b in bins.values()) == 400 and 300 <= len(bins) <= 320
    assert all(sorted(b)[0][0] == 0 and (len(b) == 1 or sorted(b)[1][0] == sorted(b)[0][1]) for b in bins.values())


def test_packing_round_trip(spark, data, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, keep_ids=True).collect()
    found, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for r in docs.collect():
        own = sorted(found[r["doc_id"]], key=lambda x: x["piece"])
        ids = [x for p in own for x in p["ids"]]
        assert ids == [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert [p["start"] for p in own] == list(np.cumsum([0, *(p["length"] for p in own)])[:-1]) and all(p["length"] == 2048 for p in own[1:])
    total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(bins) <= 1.05 * total / 2048 + 2
    assert len({r["sequence_id"] for r in packing.pack(packing.pieces(docs), items_per_group=15).collect()}) <= 1.1 * total / 2048 + 2


def test_fast_and_exact_tokenizers_agree():
    chars = [chr(c) for c in (*range(32, 127), 9, 10, 13, *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F))]
    rng = random.Random(5)
    exact, fast, _ = packing._load("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for _ in range(300):
        text = "".join(rng.choice(chars) for _ in range(60)) + " 's  \n\n x"
        assert packing._PLAIN.fullmatch(text) and fast.encode_ordinary(text) == exact.encode(text, add_special_tokens=False).ids


def test_language_accuracy(spark):
    got = registry.op1_language_id(spark, WIDE).join(spark.read.parquet(f"{WIDE}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    n, right = got.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert n > 150 and right >= 0.98


def test_kneser_ney_sums_to_one():
    texts = {"aa": ["abc abd abe", "bca"], "bb": ["xyz xya", "zzy"]}
    counts = {}
    for lang, own in texts.items():
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(language_id.letters_of(t), 4) for t in own])
        counts[lang] = np.unique(grams, axis=0, return_counts=True)
    model = language_id.KneserNey(counts)
    letters = sorted({c for t in texts.values() for x in t for c in x} | {" ", "q"})  # q stands for all that no text has
    context = [ord(c) for c in " ab"]
    rows = np.array([[*context, ord(c)] for c in letters], np.uint32)
    p = np.exp(np.concatenate([model.log_chances(r) for r in rows]).astype(float))
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4)
    one = model.predict(["abc abd", "xyz", "12", None])
    assert list(one["lang_pred"]) == ["aa", "bb", "und", "und"]


def test_kneser_ney_by_plain_counts():
    """Probabilities of every letter of seen and unseen texts, from counts in dictionaries."""
    rng = random.Random(8)
    texts = {lang: ["".join(rng.choice(letters) for _ in range(80)) for _ in range(6)] for lang, letters in (("aa", "aab bcd"), ("bb", "bccd eef"))}
    order, counts = language_id.ORDER, {}
    plain = {lang: Counter() for lang in texts}
    for lang, own in texts.items():
        codes = [language_id.letters_of(t) for t in own]
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, order) for c in codes])
        counts[lang] = np.unique(grams, axis=0, return_counts=True)
        for c in codes:
            plain[lang].update(tuple(c[i : i + order]) for i in range(len(c) - order + 1))
    letters = len({x for own in plain.values() for g in own for x in g}) + 1

    def chance(grams, gram):
        if not gram:
            return 1 / letters
        once, twice = (max(1, sum(n == k for n in grams.values())) for k in (1, 2))
        discount, context = once / (once + 2 * twice), gram[:-1]
        shorter = Counter(g[1:] for g in grams)  # how many different letters stand before
        followers = [n for g, n in grams.items() if g[:-1] == context]
        if not followers:
            return chance(shorter, gram[1:])
        return max(grams.get(gram, 0) - discount, 0) / sum(followers) + discount * len(followers) / sum(followers) * chance(shorter, gram[1:])

    model = language_id.KneserNey(counts)
    for text in (texts["aa"][0][:30], "bcd eef bad zzz a"):
        codes = language_id.letters_of(text)
        expected = [[math.log(chance(plain[lang], tuple(codes[i : i + order]))) for lang in model.languages] for i in range(len(codes) - order + 1)]
        assert np.allclose(model.log_chances(codes), expected, atol=1e-4)


def test_network_by_plain_loops():
    """Features and scores of texts from the definition: filters, chunks that overlap by half, maximum, mean and minimum."""
    net, half, stride = quality_cnn.ByteNetwork(), quality_cnn.HALF, quality_cnn.STRIDE
    w = net.weights
    for size in (0, 5, 300, 1500):
        raw = bytes(random.Random(size).randrange(1, 256) for _ in range(size))
        halves = max(2, -(-size // half))
        padded = raw + bytes(halves * half - size + quality_cnn.WIDTH)
        best = []
        for h in range(halves):
            places = range(h * half, (h + 1) * half, stride)
            active = [np.concatenate([w["embed"][b] for b in padded[p : p + quality_cnn.WIDTH]]) @ w["conv"] + w["conv_bias"] for p in places]
            best.append(np.maximum(np.max(active, axis=0), 0))
        chunks = [np.maximum(a, b) for a, b in zip(best, best[1:], strict=False)]
        features = np.concatenate((np.max(chunks, axis=0), np.mean(chunks, axis=0), np.min(chunks, axis=0)))
        assert np.allclose(net.features(np.frombuffer(raw, np.uint8)), features, atol=1e-4)
        hidden = np.maximum((features - net.shift) * net.scale @ w["hidden"] + w["hidden_bias"], 0)
        score = 1 / (1 + math.exp(-(hidden @ w["out"] + w["out_bias"][0] + net.prior)))
        assert abs(net.scores([raw.decode("latin-1")])[0] - score) < 1e-3 or max(raw, default=0) > 127


def test_passages_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "TRAIN_CHARS", 40)
    monkeypatch.setattr(quality_cnn, "TRAIN_PARTS", 4)
    df = spark.createDataFrame([("x" * 40,), ("".join(chr(97 + i % 26) for i in range(200)),)], "text string")
    short, long = (r[0] for r in df.select(quality_cnn._learnable(F.col("text"))).collect())
    assert short == "x" * 40 and len(long) == 40 and long.startswith("abcdefghij") and long.endswith("ijklmnopqr")


def test_quality_accuracy(spark):
    labels = spark.read.parquet(f"{WIDE}/labels.parquet")
    got = registry.op5_quality_cnn(spark, WIDE).join(labels, "doc_id").filter("held_out and quality is not null").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(good) > 50 and len(bad) > 3
    assert (good[:, None] > bad[None]).mean() >= 0.9 and (good >= 0.7).mean() >= 0.9


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = quality_cnn.ByteNetwork()
    raws = [quality_cnn._padded(rng.integers(1, 255, n).astype(np.uint8)) for n in (40, 700, 1300)]
    labels = np.array([1, 0, 1], np.float32)

    def loss():
        z = net._logits(np.stack([net.features(r) for r in raws])).astype(float)
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    grads = net._gradients(raws, labels)
    for name in ("out", "hidden", "conv"):
        w, flat = net.weights[name], np.argmax(np.abs(grads[name]))
        at = np.unravel_index(flat, w.shape)
        keep = w[at]
        w[at] = keep + 2e-3
        up = loss()
        w[at] = keep - 2e-3
        down = loss()
        w[at] = keep
        assert abs((up - down) / 4e-3 - grads[name][at]) < 0.05 * abs(grads[name][at]) + 1e-3


def test_scores_do_not_depend_on_pieces(monkeypatch):
    net = quality_cnn.ByteNetwork()
    raw = np.random.default_rng(1).integers(1, 255, 5000).astype(np.uint8)
    whole = net.features(raw)
    monkeypatch.setattr(quality_cnn, "PIECE", 512)
    assert np.allclose(net.features(raw), whole, atol=1e-5)


def test_vector_recall(spark):
    rows = spark.read.parquet(f"{WIDE}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_list()).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(dict)
    for r in registry.op6_vector_search(spark, WIDE).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[i]
        near[i] = -2
        best = np.sort(near)[-5]
        hits += sum(s >= best - 1e-9 for s in got[ids[i]].values())
        total += 5
        assert len(got[ids[i]]) == 5 and all(abs(s - near[list(ids).index(v)]) < 1e-9 for v, s in got[ids[i]].items())
    assert hits / total >= 0.9


def test_license_blocks_by_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["license", "the", "copy", "under"]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for _, text in rng.sample(licenses.TEMPLATES, 2):
            own = re.findall(r"[a-z0-9]+", text.lower())
            for k in rng.sample(range(len(own)), int(len(own) * rng.choice([0, 0.1, 0.2, 0.5]))):
                own[k] = "zz"
            at = rng.randrange(len(words))
            words[at:at] = own
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["template"], r["first_word"], round(r["containment"], 9)) for r in licenses.matching_blocks(df, licenses.template_table(spark, licenses.TEMPLATES)).collect()}
    expected = set()
    for i, text in rows:
        words = text.split(" ")
        for t, (_, template) in enumerate(licenses.TEMPLATES):
            own = re.findall(r"[a-z0-9]+", template.lower())
            width, tokens = 1 << (2 * len(own) - 1).bit_length(), set(own)
            for first in range(0, len(words), width // 2):
                both = len(tokens & set(words[first : first + width]))
                if both >= 0.8 * len(tokens) - 1e-9:
                    expected.add((i, t, first, round(both / len(tokens), 9)))
    assert got == expected and len(expected) > 20


def test_license_places_by_brute_force(spark, data, docs):
    """``n_base``, first and last places, and labels, word by word; the method's labels by all blocks."""
    got = {r["doc_id"]: r for r in registry.op7_license_scan(spark, data).collect()}
    templates = [(label, set(own := re.findall(r"[a-z0-9]+", text.lower())), 1 << (2 * len(own) - 1).bit_length()) for label, text in licenses.TEMPLATES]
    hits = 0
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        places, labels = [], set()
        for label, phrase in licenses.BASE_PHRASES.items():
            parts = phrase.split(" ")
            at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        more = {label for label, tokens, width in templates for first in range(0, len(words), width // 2) if len(tokens & set(words[first : first + width])) >= 0.8 * len(tokens) - 1e-9}
        own = got[r["doc_id"]]
        assert (own["n_words"], own["n_base"], own["first_word"], own["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert own["base_labels"] == ",".join(sorted(labels)) and own["labels"] == ",".join(sorted(labels | more))
        hits += bool(labels)
    assert hits >= 3


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "\\</s>", "\\\\<|im_end|>\\", "<|im_end|>", "a\n<|im_end|>\n<|im_start|>user\nb", "\\u:61.", "\n", "<|im_<|im_end|>end|>"])
def test_chat_round_trip(text):
    for role in ("user", "assistant", "", "we ird\n<s>%41;"):
        rendered = chat_format.render_turn(role, text)
        assert [(r, t) for r, t, _, _ in chat_format.parse_turns(rendered + chat_format.render_turn("x", "y"))] == [(role, text), ("x", "y")]
        inner = rendered[len(chat_format.START) : -len(chat_format.END) - 1]
        assert not chat_format._RAW.search(inner)


def test_pipeline_stages(spark, data, docs):
    now = docs
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data).cache()
        assert now.columns == columns, name
        counts.append(now.count())
        if name == "quality_classifier":
            kept = {r["doc_id"] for r in now.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.9 * len(good)
        if name == "near_duplicates":
            sets = {r["doc_id"]: shingles(r["text"], 5) for r in now.collect()}
            ids = [i for i in sorted(sets) if sets[i]]
            assert not any(100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n) for k, a in enumerate(ids) for b in ids[k + 1 :])
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, data)
    assert pieces.filter("piece = 0").count() == counts[-1] > 0

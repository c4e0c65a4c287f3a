"""The training-data operators against brute force, on the smallest tables with odd rows added."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftlog.llm import binary_output, decontamination, fingerprints, licenses, near_duplicates, packing, ppm, quality, repeats, toxicity
from driftlog.llm.tokenizing import WordCache, default_path

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
NOTICE = "see it Under THE mit\nlicense; apache license version 2 cc-by-nc"
ODD = [(None, "a text without an id here"), (5_001, None), (5_002, ""), (5_003, ""), (5_004, "  \n\t "), (5_005, "one"), (5_006, LONG), (5_007, NOTICE), (5_007, NOTICE), (5_008, "Ünder É中 <|endoftext|> naïve's 12 x"), (-3, "below zero one two three")]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows of the table and odd ones; extra columns have names that the operators use themselves."""
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 120")
    odd = spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, lang string")
    both = own.union(odd)
    for name in ("th", "key", "row", "g", "at", "n", "piece", "held_out", "class", "word", "_th"):
        both = both.withColumn(name, F.lit("clash"))
    return both.cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    return [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4") for _, t in rows]


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def multiset(found, names):
    return Counter(tuple(r[n] for n in names) for r in found.collect())


def test_word_cache(rows, encoded):
    cache = WordCache(default_path(), limit=50)
    assert all(cache.encode(t) == e.tobytes() for (_, t), e in zip(rows, encoded))


def test_binary_output(spark, docs, rows, encoded, tmp_path, none):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1]))
    want, start = Counter(), 0
    for k in order:
        ids = np.append(encoded[k], 2).astype("<u4")
        want[rows[k][0], start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    got = binary_output.encode_to_files(docs, root=str(tmp_path / "ids"), seq_len=64)
    assert multiset(got, ("doc_id", "start", "n_tokens", "ids_crc32")) == want
    assert binary_output.encode_to_files(none, root=str(tmp_path / "none")).count() == 0


def test_packing(docs, rows, encoded, none):
    want = Counter()
    for (doc_id, _), e in zip(rows, encoded):
        ids = np.append(e, 1).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack(docs, capacity=512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 512
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 512 + 1
    assert packing.pack(none).count() == 0


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(x) for x in (6, 7, 5, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def test_bins_equal_plain_best_fit():
    """The bitset against a list of open bins, on random lengths: the fullest that holds a piece, the last of equals; the fullest
    closes first."""
    rng = np.random.default_rng(17)
    for capacity, most in ((10, 3), (64, 5), (4096, 50)):
        bins, free, number = packing.Bins(capacity, most), [], 0
        for length in rng.integers(1, capacity + 1, 2_000).tolist():
            fits = [x for x in free if x[0] >= length]
            if fits:
                least = min(f for f, *_ in fits)
                best = [x for x in fits if x[0] == least][-1]
                free.remove(best)
            else:
                if len(free) >= most:
                    fullest = min(f for f, *_ in free)
                    free.remove([x for x in free if x[0] == fullest][-1])
                best, number = (capacity, number), number + 1
            assert bins.place(length) == (best[1], capacity - best[0])
            if best[0] > length:
                free.append((best[0] - length, best[1]))


def crc(doc_id, m):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def plain_ppm(train: list[bytes], texts: list[bytes], order: int) -> list[float]:
    """log10 probabilities of texts by a trie of dictionaries, byte by byte."""
    grams = [Counter()] + [None] * order
    grams[0] = Counter(line[i - order : i + 1] for line in (b"\n" * order + t for t in train) for i in range(order, len(line)))
    for k in range(1, order + 1):
        grams[k] = Counter(g[1:] for g in grams[k - 1])
    trie = defaultdict(dict)
    for level in grams:
        for g, n in level.items():
            trie[g[:-1]][g[-1]] = n
    out = []
    for line in (b"\n" * order + t for t in texts):
        total = 0.0
        for i in range(order, len(line)):
            gone: set = set()
            for at in range(i - order, i + 1):
                of = {b: n for b, n in trie.get(line[at:i], {}).items() if b not in gone}
                if not of:
                    continue
                if line[i] in of:
                    total += math.log10((2 * of[line[i]] - 1) / (2 * sum(of.values())))
                    break
                total += math.log10(len(of) / (2 * sum(of.values())))
                gone |= of.keys()
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


def test_ppm(docs, rows, none):
    words = [[*re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())), b"\n"] for _, t in rows]
    counts = Counter(w for (i, _), own in zip(rows, words) if crc(i, 5) != 1 for w in own)
    n, v = sum(counts.values()), len(counts)
    lines = [b" ".join(own[:-1]) + b"\n" for own in words]
    scores = plain_ppm([line for (i, _), line in zip(rows, lines) if crc(i, 5) != 1], lines, 5)
    want = sorted((str(i), crc(i, 5) == 1, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), s) for (i, _), own, s in zip(rows, words, scores))
    for head in (300_000, 20):  # 20: most words by the join
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.ppm_scores(docs, head=head).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-6)
    assert ppm.ppm_scores(none).count() == 0


def test_ppm_orders_and_pieces(spark, monkeypatch):
    """Short and long contexts, texts cut into many pieces, and none to learn from."""
    monkeypatch.setattr(ppm, "PIECE", 7)
    held = [i for i in range(200) if crc(i, 5) == 1][:6]
    texts = {i: f"abracadabra {i} cad abra {'zq' * (i % 9)}" for i in [*range(30), *held]}
    frame = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    lines = {i: b" ".join(t.encode().split()) + b"\n" for i, t in texts.items()}
    for order in (0, 1, 2, 3, 6):
        want = dict(zip(sorted(texts), plain_ppm([lines[i] for i in sorted(texts) if crc(i, 5) != 1], [lines[i] for i in sorted(texts)], order)))
        got = {r.doc_id: r.score for r in ppm.ppm_scores(frame, order=order).collect()}
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
    alone = ppm.ppm_scores(frame.where(F.col("doc_id").isin(held))).collect()
    assert all(abs(r.score + len(lines[r.doc_id]) * math.log10(256)) < 1e-6 for r in alone)


def test_ppm_sees_the_order_of_words(spark):
    """A text in the order of the training texts scores above the same words in another."""
    line = "one day the quick brown fox will jump over a lazy dog".split()
    rows = [(i, " ".join(line[i % 4 :] + line[: i % 4])) for i in range(40) if crc(i, 5) != 1]
    a, b = [i for i in range(40) if crc(i, 5) == 1][:2]
    rows += [(a, " ".join(line)), (b, " ".join(np.random.default_rng(3).permutation(line)))]
    got = {r.doc_id: (r.score, r.base_score) for r in ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[a][0] > got[b][0] + 1 and abs(got[a][1] - got[b][1]) < 1e-9


def test_code_adds_up_to_one():
    keys = np.array(sorted(int.from_bytes(g, "big") for g in (b"aab", b"aac", b"xab", b"abb", b"bbb")), np.uint64)
    by_order = ppm.levels(keys, np.array([3, 1, 4, 1, 5]), 2, {})
    for context in (b"aa", b"xa", b"zz", b"za", b"bb"):
        asked = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((10 ** ppm.code(asked, by_order)).sum() - 1) < 1e-9


def bag(text, size=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def test_near_duplicates(docs, rows, none):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if rows[a][1] == rows[b][1] or both and both >= 0.8 * (bags[a].total() + bags[b].total() - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    want = Counter((i, min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows))
    assert multiset(near_duplicates.near_duplicates(docs), ("doc_id", "class_id")) == want
    kept = near_duplicates.one_of_each(docs)
    assert kept.count() == len(least) and kept.columns == docs.columns
    assert near_duplicates.near_duplicates(none).count() == 0


def test_signature_is_unbiased():
    rng = np.random.default_rng(5)
    a, b = ({int(k): int(w) for k, w in zip(rng.integers(0, 1 << 62, 60), rng.integers(1, 40, 60))} for _ in range(2))
    for k in list(a)[:40]:
        b[k] = max(1, a[k] // 2)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    x, y = near_duplicates.signatures([np.repeat(np.array(list(d), np.uint64), list(d.values())) for d in (a, b)], 4000)
    assert abs((x == y).mean() - want) < 0.03


def test_repeats(docs, rows, none):
    order = sorted({(i is not None, i or 0, t) for i, t in rows})
    first, want = {}, defaultdict(set)
    for d in order:
        w = d[2].split()
        for k in range(len(w) - 49):
            h = tuple(w[k : k + 50])
            if first.setdefault(h, d) != d:
                want[d[1]].update(range(k, k + 50))
    got = defaultdict(set)
    for r in repeats.repeated_passages(docs).collect():
        got[r.doc_id or 0].update(range(r.start, r.start + r.n_words))
    assert got == want and want
    cut = repeats.without_repeats(docs)
    left = {r.doc_id: len((r.text or "").split()) for r in cut.collect()}
    for i, t in rows:
        if i in want and t:
            assert left.get(i, 0) == len(t.split()) - len(want[i])
    assert cut.columns == docs.columns and repeats.repeated_passages(none).count() == 0


def test_hot_passage_over_many_tasks(spark):
    """One passage in every document: each is matched though the run crosses tasks."""
    passage = " ".join(f"p{i}" for i in range(60))
    hot = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), F.col("id").cast("string"), F.lit(" " + passage)).alias("text"))
    got = repeats.repeated_passages(hot)
    assert {r.doc_id for r in got.collect()} == set(range(1, 300))


def test_hot_passage_is_split_alike(spark):
    """Matches are with the first of the whole run, however many tasks hold it; repeats within one document are none."""
    passage = " ".join(f"p{i}" for i in range(60))
    tail = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("t"), i.cast("string"), F.lit("of"), (F.col("id") % 40).cast("string"))))
    hot = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("own"), F.col("id").cast("string")), F.lit(passage), tail, F.lit(passage)).alias("text"))
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(sorted(map(tuple, repeats.repeated_passages(hot).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == set(range(1, 300)) and all(r[0] != r[1] for r in got[0])


def test_short_copy_hides_no_passage(spark):
    """Documents that share a passage are matched with each other though the first of the run holds a part of it only."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    whole = words("p", 55)
    texts = {
        0: words("a", 5) + " " + " ".join(whole.split()[3:48]) + " " + words("b", 5),  # 45 words of it
        1: words("c", 5) + " " + " ".join(whole.split()[:41] + ["other"] + whole.split()[42:]),
        **{i: words(f"d{i}x", 7) + " " + whole + " " + words(f"e{i}x", 7) for i in range(2, 9)},
        20: " ".join([words("q", 42), words("f", 9), words("q", 56)]),  # its first place of the 40 words is the short one
        21: words("g", 9) + " " + words("q", 56) + " " + words("h", 9),
    }
    got = repeats.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_doc_id, r.start, r.n_words) for r in got) == [*((i, 2, 7, 55) for i in range(3, 9)), (21, 20, 9, 56)]


def test_rare_toxic_word_is_learned(spark):
    """Where toxic rows are rare, an insult may stand in more clean rows than toxic ones."""
    ids = [i for i in range(3_000) if crc(i, 4) != 2][:2_000]
    rows = [(i, f"plain words {i} " + ("zorblat" if k < 10 or 40 <= k < 55 else "other"), k < 40) for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    assert "zorblat" in toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))["words"]


def test_decontamination(spark, docs, rows, none):
    """Every window of every document against every item, with similarity and start; rearranged, gapped and cut items too."""
    word = lambda name, n: [f"{name}{i}" for i in range(n)]
    x, y, z = word("x", 60), word("y", 60), word("z", 70)
    more = [(900, "zero one two"), (901, ""), (902, None), (903, " ".join(x + y)), (904, " ".join(z)), (905, "one two one two one two one two one two one two"), (906, " ".join(word("v", 13)))]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame(more, "item_id long, text string"))
    planted = {
        7_000: word("a", 30) + y + x + word("b", 30),  # rearranged
        7_001: x[:40] + word("c", 2) + x[40:] + y[:30] + word("d", 1) + y[30:],  # gapped
        7_002: x[4:] + y[:-4],  # cut at both ends, shorter than the item
        7_003: word("e", 9) + z[:3] + ["other"] + z[4:65] + ["two", "more"] + z[65:] + word("f", 9),
        7_004: z[:35] + word("g", 20) + z[35:],  # too far apart
        7_005: word("h", 4) + z[:-6],  # at the end of the document
        7_006: "two one two one two one two one two one two one two".split(),
        7_007: z + word("i", 5) + z,  # two places alike
        7_008: word("v", 11) + word("j", 2) + word("v", 12),
    }
    plan = [(i, " ".join(w)) for i, w in planted.items()]
    names = docs.columns
    docs = docs.unionByName(spark.createDataFrame(plan, "doc_id long, text string"), allowMissingColumns=True)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())
    of = lambda w, k: [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    items = {r.item_id: cut(r.text or "") for r in bench.collect()}
    want = {}
    for i, t in {*rows, *plan}:
        w = cut(t)
        for item, own in items.items():
            k = min(5, len(own))
            if not k or not set(of(own, k)) & set(of(w, k)):
                continue
            a = Counter(of(own, k))
            for at in range(max(1, len(w) - len(own) + 1)):
                b = Counter(of(w[at : at + len(own)], k))
                both = (a & b).total()
                alike = both / (a.total() + b.total() - both)
                if alike >= 0.8 and alike > want.get((i, item), (0,))[0]:
                    want[i, item] = alike, at
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontamination.contaminated(docs, bench).collect()}
    assert {p: (round(s, 9), at) for p, (s, at) in got.items()} == {p: (round(s, 9), at) for p, (s, at) in want.items()}
    assert {(-3, 900), (7_000, 903), (7_002, 903), (7_005, 904), (7_006, 905), (7_007, 904)} <= set(got) and (7_004, 904) not in got
    clean = decontamination.clean(docs, bench)
    gone = {i for i, _ in want}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in {*rows, *plan}} - gone and clean.columns == names
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(docs, bench.where("false")).count() == 0


def plain_scan(text: str) -> tuple:
    """(labels, score) by all pairs of places, and words in order by a plain table."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    labels, score = set(), 0.0
    for label, phrase in licenses.PHRASES.items():
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels.add(label)
            score = 1.0
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    for label, template in licenses.TEMPLATES:
        t = template.split()
        diagonals = sorted({i - j for j in range(len(t) - 2) for i in at[tuple(t[j : j + 3])]})
        groups = [[d] for d in diagonals[:1]]
        for a, b in zip(diagonals, diagonals[1:]):
            if b - a <= 3:
                groups[-1].append(b)
            else:
                groups.append([b])
        for g in groups:
            span = w[max(0, g[0]) : g[-1] + len(t)]
            table = [[0] * (len(t) + 1) for _ in range(len(span) + 1)]
            for i, x in enumerate(span):
                for j, y in enumerate(t):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            share = table[-1][-1] / len(t)
            score = max(score, share)
            if share >= 0.7:
                labels.add(label)
    return ",".join(sorted(labels)), round(score, 9)


def test_licenses(spark, docs, rows, none):
    notices = ["was Licensed under the very Apache license, version 2.0 ok", "all rights, reserved", "all the rights reserved", "cc by nc " * 9, "under the mit license under the mit license",
        "redistribution and use in source or binary forms with or without any modification are permitted provided the following conditions are met", "free of charge to any person obtaining a copy of this", "license version 2 0", "the GNU general public"]
    more = [(8_000 + i, t) for i, t in enumerate(notices)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = Counter()
    for i, t in [*rows, *more]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        places = [(k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), *plain_scan(t)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(docs).collect())
    assert got == want
    assert licenses.scan(none).count() == 0


def test_fingerprints(docs, rows, none):
    order = sorted(rows, key=lambda r: r[1])
    order.sort(key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        n, nxt = len(t), order[(k + 1) % len(order)][1]
        want[i, n, hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()] += 1
    got = fingerprints.fingerprint(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint(none).count() == 0


def test_winnowing_by_hand(spark):
    df = spark.createDataFrame([(" ".join(f"w{i % 7}" for i in range(40)),), ("a b",), ("",)], "text string")
    out = fingerprints.winnow(df, "text", "f", 4, 8).select("text", "f").collect()
    for text, chosen in out:
        n = len(text.split())
        places = [(1 << 28) - 1 - (x & ((1 << 28) - 1)) for x in chosen]
        assert places == sorted(places) and (len(places) > 0) == (n > 0)
        if n > 12:  # each window of 8 k-grams holds a chosen one
            assert all(any(i <= p < i + 8 for p in places) for i in range(n - 3 - 7))


def test_fingerprints_by_plain_winnowing(spark, docs, rows):
    """Chosen places and both likenesses against a plain version that takes the operator's own hash of each k-gram."""
    shown = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fingerprints.fingerprint(docs).collect()}
    order = sorted(rows, key=lambda r: r[1])
    order.sort(key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    edited = [t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2] for k, (_, t) in enumerate(order)]
    every = sorted({w for t in [*edited, *(t for _, t in rows)] for w in t.split(" ")})
    frame = spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h"))
    own = {r.w: r.h for r in frame.collect()}
    pairs = lambda hashes: spark.createDataFrame([(h,) for h in hashes], "h array<long>")
    texts = sorted({*edited, *(t for _, t in rows)})
    lists = [[own[w] for w in t.split(" ")] if t else [] for t in texts]
    two = {x for h in lists for x in zip(h, h[1:])}
    joined = {(r.a, r.b): r.x for r in spark.createDataFrame(sorted(two), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("x")).collect()}
    halves = [[joined[x] for x in zip(h, h[1:])] for h in lists]
    four = {x for h in halves for x in zip(h, h[2:])}
    joined = {(r.a, r.b): r.x for r in spark.createDataFrame(sorted(four), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("x")).collect()}
    few = [h for h in lists if 0 < len(h) < 4]
    short = {tuple(r.h): r.x for r in pairs(few).select("h", F.xxhash64("h").alias("x")).collect()} if few else {}
    chosen = {}
    for t, h, half in zip(texts, lists, halves):
        grams = [joined[x] for x in zip(half, half[2:])] if len(h) >= 4 else [short[tuple(h)]] if h else []
        heads = [(x & ((1 << 64) - 1)) >> 29 for x in grams]
        places = []
        for i in range(max(1, len(heads) - 7) if heads else 0):
            part = heads[i : i + 8]
            at = i + max(j for j, x in enumerate(part) if x == min(part))
            if at not in places:
                places.append(at)
        chosen[t] = [(heads[p], p) for p in places]
    text_of = lambda c: " ".join(f"{h:X}@{p}" for h, p in c)

    def like(a, b):
        x, y = {h for h, _ in chosen[a]}, {h for h, _ in chosen[b]}
        return len(x & y) / len(x | y) if x | y else 1.0

    for k, ((i, t), e) in enumerate(zip(order, edited)):
        r = shown[i, len(t), hashlib.sha256(e.encode()).hexdigest()]
        assert r.fingerprint == text_of(chosen[t]) and r.edited_fingerprint == text_of(chosen[e])
        assert r.near_edited == pytest.approx(like(t, e)) and r.near_next == pytest.approx(like(t, order[(k + 1) % len(order)][1]))


def test_scores_are_averages_of_vectors():
    """The scorer's sums against the average of the vectors of all features, word by word."""
    rng, buckets = np.random.default_rng(2), 1 << 10
    weights = rng.normal(size=buckets).astype("<f4")
    scorer = quality.Scorer({"weights": weights.tobytes(), "bias": 0.3, "buckets": buckets}, limit=7)
    for text in ("", "one", "one one two", " ".join(f"w{i % 9}" for i in range(200)), "x" * 300):
        words = text.split()
        found = [f for w in words for f in quality.features(w, buckets)]
        found += [quality.features("\x00repeat", buckets)[0]] * (8 * sum(a == b for a, b in zip(words, words[1:])))
        z = 0.3 + (float(np.mean(weights[found].astype(float))) if found else 0.0)
        assert scorer(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_long_words_have_character_features():
    """A text without white space has the n-grams of what it is made of."""
    long = "unspaced" * 20
    assert len(quality.features(long, 1 << 16)) == 1 + 160 + 159 + 158
    assert set(quality.features("unspaced", 1 << 30)) & set(quality.features(long, 1 << 30))


def test_classifiers(spark, labels, none, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r for r in marks.collect()}
    for made, column, least in ((quality.quality, "quality", 0.95), (toxicity.toxicity, "toxic", 0.9)):
        got = [r for r in made(table, marks).collect() if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id][column] for r in got]) >= least
        odd = made(docs, labels.where("false")).collect()
        assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd) and made(none, labels).count() == 0


def test_composed_machine_equals_its_parts():
    """The composed machine against the five machines run one after another, on random clauses."""
    rng, whole, parts = np.random.default_rng(11), toxicity.grammar(), toxicity.machines()
    assert len(parts) == 5
    for _ in range(300):
        state, states = 0, [0] * 5
        for symbol in rng.integers(0, 6, rng.integers(1, 15)).tolist():
            state, out, factor = whole.table[state, symbol]
            want, x = 1.0, symbol
            for k, machine in enumerate(parts):
                states[k], x, f = machine.table[states[k], x]
                want *= f
            assert out == x and factor == pytest.approx(want)


def test_terms_beside_insults_are_learned(spark):
    """Where clean rows have the insult behind a negation, the negation of that language softens it; labels other than 0 and 1 teach
    nothing, and long words teach."""
    long = "z" * 45
    ids = [i for i in range(6_000) if crc(i, 4) != 2][:4_000]
    rows = [(i, f"un {'jamais ' if k % 40 == 0 else ''}zorblat {'' if k % 40 == 0 else long} {i}" if k < 2_000 else f"plain words {i}", (0 if k % 40 == 0 else 1) if k < 2_000 else 0) for k, i in enumerate(ids)]
    rows.append((next(i for i in range(7_000, 7_100) if crc(i, 4) != 2), "no label of this kind", 7))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert model["words"]["jamais"][0] == toxicity.NEGATION and long in model["words"] and "pas" not in model["words"]


def test_one_long_word_costs_no_more_than_its_length(spark):
    """A text without white space teaches and is scored without all of its prefixes."""
    ids = [i for i in range(400) if crc(i, 4) != 2][:200]
    frame = spark.createDataFrame([(i, ("q" * 400_000 if k < 20 else f"plain words {i}"), int(k < 20)) for k, i in enumerate(ids)], "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).collect()}
    assert len(got) == 200 and not any(got[i] for i in ids[20:])


def test_grammar():
    score = toxicity.Scorer(toxicity.lexicon(), {"lowei": 5.0})
    plain, aimed, negated, quoted = (score(t)[0] for t in ("an idiot", "you idiot", "not an idiot", "she said an idiot"))
    assert aimed > plain > negated > 0 and score("the loweiX")[0] == 0 or score("the loweix")[0] == 5.0
    assert quoted < aimed and score("a fine day")[0] == 0 and score("you. an idiot")[0] == plain


CLASHES = ["_th", "_id", "_gone", "_key", "cuts", "row", "id", "th", "id_gone", "th_gone", "cut_key", "key", "g", "at", "class", "kept", "salt"]


@pytest.fixture(scope="module")
def staged(spark):
    """Documents with nulls, repeated rows, near copies, repeated passages and columns that clash, each with a value of its row."""
    own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90").collect()]
    passage = " ".join(f"shared{i}" for i in range(70))
    near = [f"n{i}" for i in range(120)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    odd = [
        (None, "no id here at all", None, None, None), (None, "no id here at all", None, None, None), (9_000, None, None, None, None), (9_001, "", "en", "s", 0), (9_002, " \n ", "en", "s", 3),
        (9_003, " ".join([f"a{i}" for i in range(50)]) + f" {passage} two", "en", "s", 1), (9_004, f"three {passage} " + " ".join([f"b{i}" for i in range(50)]), None, "s", 1), (9_005, passage, "en", None, 1), (9_006, " ".join(near), "en", "s", 1), (9_007, " ".join([*near[:60], "changed", *near[61:]]), "en", "s", 1),
        (9_008, "you idiot are worthless scum and a stupid moron", "en", "s", 1), (9_009, f"before it {item} after it", "en", "s", 1), (9_010, own[3][1], "en", "s", 1), (9_010, own[3][1], "en", "s", 1), (9_011, LONG, "en", "s", 1),
    ]
    frame = spark.createDataFrame([*own, *odd], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        frame = frame.withColumn(name, F.concat_ws("/", F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return frame.cache()


def rest_of(frame) -> set:
    """All columns of each row but the text and its length."""
    return {tuple(r) for r in frame.drop("text", "n_chars").collect()}


def plain_classes(rows: list) -> list[int]:
    """For each row (id, text) the place of the first of its near-duplicate class, by all pairs."""
    parent, bags = list(range(len(rows))), [bag(t or "") for _, t in rows]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if (rows[a][1] or "") == (rows[b][1] or "") or both and both >= 0.8 * (bags[a].total() + bags[b].total() - both):
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(rows))]


def test_stages_by_plain_versions(spark, staged, labels, tmp_path):
    """Each stage on what its predecessor kept, against a plain version; all other columns keep their values."""
    stages, docs = dict(corpus_pipeline.STAGES), staged
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")

    def rows(frame):
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))

    def step(name):
        out = corpus_pipeline.written(stages[name](spark, docs, SF), name)
        assert out.columns == docs.columns and rest_of(out) <= rest_of(docs)
        return out

    model = toxicity.learn(staged, labels)
    match = toxicity.Scorer(model["words"], model["stems"])
    clean = step("toxicity")
    assert rows(clean) == [r for r in rows(docs) if toxicity.probability(match(r[1] or ""), model["map"]) < 0.3] and 9_008 not in {i for i, _ in rows(clean)}

    docs = clean
    one = step("near_dedup")
    before = rows(docs)
    classes = plain_classes(before)
    least = {}
    for k, (r, c) in enumerate(zip(before, classes)):
        if c not in least or (r[0] is None, r[0] or 0) < (before[least[c]][0] is None, before[least[c]][0] or 0):
            least[c] = k
    assert Counter(i for i, _ in rows(one)) == Counter(before[k][0] for k in least.values())
    assert 9_006 in {i for i, _ in rows(one)} and 9_007 not in {i for i, _ in rows(one)}

    docs = one
    cut = step("suffix_dedup")
    first, gone = {}, defaultdict(set)
    for i, t in rows(docs):
        w = (t or "").split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                gone[i].update(range(k, k + 50))
    want = {i: [x for k, x in enumerate((t or "").split()) if k not in gone[i]] for i, t in rows(docs)}
    assert {i: (t or "").split() for i, t in rows(cut)} == {i: w for i, w in want.items() if w or not gone[i]} and gone[9_004] and 9_005 not in {i for i, _ in rows(cut)}
    assert all(r.n_chars == len(r.text) for r in cut.where("text is not null").collect())

    docs = cut
    left = step("decontamination")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    of = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    hit = set()
    items = [x for r in bench.collect() if (x := words(r.text))]
    for i, t in rows(docs):
        w = words(t)
        for x in items:
            k = min(5, len(x))
            if w and set(of(x, k)) & set(of(w, k)):
                for at in range(max(1, len(w) - len(x) + 1)):
                    a, b = of(x, k), of(w[at : at + len(x)], k)
                    both = (a & b).total()
                    if both >= 0.8 * (a.total() + b.total() - both) - 1e-9:
                        hit.add(i)
    assert {i for i, _ in rows(left)} == {i for i, _ in rows(docs)} - hit and 9_009 in hit

    docs = left
    packed = stages["packing"](spark, docs, SF).collect()
    cache = WordCache(default_path())
    want = Counter()
    for i, t in rows(docs):
        raw = cache.encode(t or "") + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(raw), 4 * 4096)):
            want[i, k, at // 4, len(raw[at : at + 4 * 4096]) // 4, zlib.crc32(raw[at : at + 4 * 4096])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_stages_without_rows(spark, staged, tmp_path):
    """No documents: no rows and the same columns; no labels and no benchmark: the stages run."""
    none = staged.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SF)
        assert out.columns == none.columns and out.count() == 0
    assert packing.pack(none).count() == 0
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").where("false").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert stages["decontamination"](spark, staged, str(tmp_path)).count() == staged.count()
    assert stages["toxicity"](spark, staged, str(tmp_path)).count() > 0


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()

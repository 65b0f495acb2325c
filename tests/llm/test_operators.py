"""Each operator against brute force on small tables with null, empty, long, repeated and clashing rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runweave.llm import counts, huffman, jaccard, mixing, multiset, quality, substring, tokens, topk, urls, wordtable
from runweave.llm.graph import components
from runweave.session import new_run_dir

BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = random.Random(3)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["ab", "ça", "Tor", "mi", "no", "x1", "deep", "river", "é", "stone"]) + str(rng.randrange(400)) for _ in range(n))


PASSAGE = words(70, 99)
LONG = words(20_000, 5)
TEXTS = [words(30, 1), None, "", " \n\t ", words(200, 2), words(120, 3) + " " + PASSAGE + "\n" + words(10, 4), PASSAGE + " " + words(90, 6),
         words(120, 3) + " " + PASSAGE + "\n" + words(10, 4), LONG, LONG + " end", "one", "one", "One", "a  b\n\n c d 's <|endoftext|> x",
         words(200, 2) + " more", "é" * 50 + " ... !!", "a b c d e f", "a b c d e f", "b c d e f a", words(5, 7), words(5, 7) + " z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", f"s{i % 3}", 7, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, kept string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_urls_rules_and_vocabulary(spark):
    rows = ["http://Example.com/en/x", "https://www.example.com/en/", "http://sub.net/fr/a?b=1#c", None, "", "no scheme casino",
            "http://a.org/casino", "http://a.org/mycasino", "http://a.org/free/ads", "http://a.org/free/free", "http://x.com", "http://x.com/" + "y" * 100_000]
    df = spark.createDataFrame([(u, "old") for u in rows], "url string, host string")
    got = [tuple(r) for r in urls.judge_urls(df, urls.RULES, urls.VOCABULARY).select("host", "rule", "verdict").collect()]
    assert got[:6] == [("example.com", "example.com/en/", "block"), ("www.example.com", "www.example.com/en/", "allow"),
                       ("sub.net", "net/fr/", "block"), ("", None, "allow"), ("", None, "allow"), ("", None, "block")]
    assert [v for _, _, v in got[6:]] == ["block", "allow", "block", "allow", "allow", "allow"] and got[11][1] == "com/"
    with pytest.raises(ValueError, match="weights"):
        urls.automaton_of({"x": "heavy"})


def removed(texts, window):
    """Words that stay, by definition."""
    first, out = {}, {}
    for key, text in sorted(texts.items()):
        found = WORD.findall(text or "")
        gone, starts = set(), [tuple(found[i:i + window]) for i in range(len(found) - window + 1)]
        for i, w in enumerate(starts):
            if first.setdefault(w, key) < key:
                gone.update(range(i, i + window))
        out[key] = (len(found), len(gone), " ".join(w for i, w in enumerate(found) if i not in gone))
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_substring(docs, window):
    got = by_id(substring.deduplicate(docs, window, keep=["kept", "lang"]))
    want = removed({i * 3: t for i, t in enumerate(TEXTS)}, window)
    assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 20_000


def test_substring_random_passages(spark):
    rng = random.Random(8)
    pool = [words(rng.randrange(5, 90), s).split() for s in range(12)]
    rows = [(k, " ".join(itertools.chain(*(rng.choice(pool) for _ in range(rng.randrange(1, 5)))))) for k in range(60)]
    got = by_id(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 20))
    assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in got.items()} == removed(dict(rows), 20)


def test_substring_windows_of_near_copies_and_repeated_lines_are_compared_once(spark, monkeypatch):
    rng, base, line, sizes = random.Random(5), words(400, 77).split(), words(9, 78), {}
    rows = [(k, " ".join([words(20, 500 + k)] + [line] * rng.randrange(8, 40) + [words(30, 600 + k)])) for k in range(30)]
    for k in range(30, 70):
        found = list(base)
        for _ in range(4):
            found[rng.randrange(400)] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(found)))

    def counted(df, label):
        out = written(df, label)
        sizes[label] = out.count()
        return out

    written = substring.written
    monkeypatch.setattr(substring, "written", counted)
    got = by_id(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in got.items()} == removed(dict(rows), 50)
    every = sum(max(0, len(WORD.findall(t)) - 49) for _, t in rows)
    assert sizes["windows"] < every * 2 / 3 and sizes["stretches"] < every / 3


def test_substring_repeated_and_missing_keys(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, PASSAGE)]
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 70)]


def test_substring_rows_that_share_a_key(spark):
    start, other, tail = words(400, 41), words(300, 42), words(45, 43)
    rows = [(1, start + " " + tail), (2, words(60, 44) + " " + start), (2, words(60, 44) + " " + start), (3, other), (3, words(55, 45)),
            (4, words(20, 46) + " " + other + " " + tail), (4, words(55, 45)), (4, "short"), (4, words(20, 46) + " " + other + " " + tail),
            (5, words(10, 47) + " " + start + " " + other), (5, start), (5, start), (5, start), (5, words(70, 48)), (None, start)]
    first, want = {}, []
    for key, text in rows:
        found = text.split()
        for w in (tuple(found[i:i + 50]) for i in range(len(found) - 49)):
            first[w] = min(first.get(w, 99), key or 99)
    for key, text in rows:
        found, gone = text.split(), set()
        for i in range(len(found) - 49):
            if key and first[tuple(found[i:i + 50])] < key:
                gone.update(range(i, i + 50))
        want.append((key or 0, len(found), len(gone), " ".join(w for i, w in enumerate(found) if i not in gone)))
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("removed").collect()
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(want)


def shingles(text):
    found = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)} or ({tuple(found)} if found else set())


def linked_groups(texts):
    sets, label = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_jaccard(docs):
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(jaccard.groups(docs)).items()}
    assert got == linked_groups({i * 3: t for i, t in enumerate(TEXTS)})


def test_jaccard_near_copies_of_all_sizes(spark):
    rng, rows = random.Random(4), []
    for size in (5, 6, 7, 8, 9, 10, 11, 13, 16, 25, 60):
        for copy in range(4 if size != 60 else 45):
            found = words(size, size).split()
            for _ in range(rng.randrange(0, 1 + size // 20) if size > 12 else rng.randrange(2)):
                at = rng.choice([0, len(found) - 1, rng.randrange(len(found))])
                found[at:at + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"]
            rows.append((len(rows), " ".join(found) + (" licensed under the same terms as before" if copy % 2 else "")))
    got = by_id(jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == linked_groups(dict(rows))


def test_jaccard_heavy_group_of_copies_that_mostly_do_not_link(spark, monkeypatch):
    rng, base, rows = random.Random(8), words(150, 71).split(), []
    for _ in range(110):
        found = list(base)
        for _ in range(rng.choice([2, 4, 5])):
            found[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(found)))
    table, want = spark.createDataFrame(rows, "doc_id long, text string"), linked_groups(dict(rows))
    assert 5 < len({c for _, c in want.values()}) < 100
    for parities in (1, 16):
        monkeypatch.setattr(jaccard, "PARITIES", parities)
        assert {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(jaccard.groups(table)).items()} == want


def test_only_named_lists_are_placed_and_sketches_leave_out_pairs_without_sets(spark):
    rng = np.random.default_rng(6)
    core = np.sort(rng.integers(1, 1 << 62, 200, dtype=np.uint64))
    sets = [core, np.sort(np.concatenate([core[:-5], rng.integers(1, 1 << 62, 5, dtype=np.uint64)])), np.sort(rng.integers(1, 1 << 62, 200, dtype=np.uint64))]
    rows = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "node long, n long, shingles binary")
    every = {(r["node"], r["list"]): r["place"] for r in jaccard.placed_lists(rows, core[:0]).collect()}
    heavy = [int(x) for x in core[3:7]]
    named = jaccard.placed_lists(rows.withColumn("lists", F.array(*map(F.lit, heavy))), core[:0]).collect()
    assert len(named) == 8 < len(every)
    assert all(every[r["node"], r["list"]] == r["place"] and r["list"] in heavy for r in named)

    found = jaccard.Sets([], 0)
    found.sets = sets
    sketch = spark.createDataFrame([(i, len(s), *found.parities(i)) for i, s in enumerate(sets)],
                                   ", ".join(["node long, n long", *(f"p{i} long" for i in range(jaccard.PARITIES))]))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert [tuple(r) for r in jaccard.alike(pairs, sketch).collect()] == [(0, 1)]


def test_parity_sketches_differ_in_no_more_bits_than_sets():
    texts = [words(n, n % 3).encode() for n in (5, 20, 21, 60, 61, 900, 901)] + [b"", b"a b"]
    found = jaccard.Sets(texts, 0)
    sketches = [sum((v % (1 << 64)) << (64 * i) for i, v in enumerate(found.parities(k))) for k in range(len(texts))]
    for i, j in itertools.combinations(range(len(texts)), 2):
        apart = len(set(found.sets[i].tolist()) ^ set(found.sets[j].tolist()))
        bits = (sketches[i] ^ sketches[j]).bit_count()
        assert bits <= apart and (apart - bits) % 2 == 0


def test_jaccard_links_over_rows_without_a_key(spark):
    base, late = words(100, 61).split(), words(130, 62).split()
    cut = [" ".join(x[i:]) for x in (base, late) for i in (0, 15, 30)]
    rows = [(1, cut[0]), (None, cut[1]), (None, cut[1]), (2, cut[2]), (None, cut[3]), (None, cut[4]), (7, cut[5]), (None, words(90, 63)), (None, None)]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(k, len(shingles(t)), c) for (k, t), c in zip(rows, [1, 1, 1, 1, 7, 7, 7, None, None], strict=True)]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_boundary_follows_cost():
    assert jaccard.boundary({}) == jaccard.LARGEST_SMALL
    assert 4 <= jaccard.boundary({n: 100 for n in range(1, 17)}) < jaccard.LARGEST_SMALL


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_fingerprint_follows_edits(docs):
    rows = by_id(multiset.edited_fingerprints(docs))
    order = sorted(rows, reverse=True)
    text = {i * 3: t or "" for i, t in enumerate(TEXTS)}
    for at, key in enumerate(order):
        own, other = text[key], text[order[(at + 1) % len(order)]]
        take = len(own) // 3
        assert rows[key]["edited_sha256"] == hashlib.sha256((own[:len(own) - take] + other[:take]).encode()).hexdigest()
        assert rows[key]["n_chars"] == len(own) and 0 <= rows[key]["near_edited"] <= 1
    assert rows[30]["fingerprint"] == rows[33]["fingerprint"] != rows[36]["fingerprint"]


def test_likenesses_follow_the_multisets(spark):
    rng, plain = random.Random(12), {}
    for key in range(240):
        found = [words(4, rng.randrange(10**9)) + "." for _ in range(rng.randrange(3, 40))]
        plain[key] = " ".join(found[:2] * 2 + found)

    def cosine(a, b):
        a, b = (Counter(p for p in re.split(multiset.CUT, t) if p) for t in (a, b))
        return sum(n * b[p] for p, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))

    rows = by_id(multiset.edited_fingerprints(spark.createDataFrame(list(plain.items()), "doc_id long, text string").repartition(3)))
    off_edited, off_next = [], []
    for key, own in plain.items():
        other, take = plain[(key - 1) % len(plain)], len(own) // 3
        off_edited.append(rows[key]["near_edited"] - cosine(own, own[:len(own) - take] + other[:take]))
        off_next.append(rows[key]["near_next"] - cosine(own, other))
    # Half of the deviations of a cosine of 0 are cut off: sqrt(1 / 2 / lanes) is 0.088 for 64 lanes, 0.125 for 32.
    assert np.sqrt(np.mean(np.square(off_next))) < 0.105 and np.max(np.abs(off_next)) < 0.5
    assert np.sqrt(np.mean(np.square(off_edited))) < 0.105 and np.max(np.abs(off_edited)) < 0.4


def test_fingerprint_is_homomorphic(spark):
    df = spark.createDataFrame([("One. Two.", "Three here.", "Three here. One. Two.")], "a string, b string, ab string")
    for c in ("a", "b", "ab"):
        df = multiset.with_lanes(df, c, f"l{c}")
    row = df.select((multiset.combine(F.col("la"), F.col("lb")) == F.col("lab")).alias("added"),
                    (multiset.combine(F.col("lab"), F.col("lb"), -1) == F.col("la")).alias("taken")).first()
    assert row["added"] and row["taken"]


def encoded(texts):
    library = tokens.tokenizer_of(BYTE_BPE)
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_safe_pieces_keep_ids():
    for text, ids in zip(TEXTS, encoded(TEXTS), strict=True):
        assert "".join(tokens.safe_pieces(text or "")) == (text or "")
        assert np.frombuffer(tokens.Encoder(BYTE_BPE, 50).encode([text or ""])[0], "<u2").tolist() == ids


def test_huffman_round_trip(spark, docs):
    folder = new_run_dir(spark, "ids")
    huffman.write_ids(docs, BYTE_BPE, folder)
    got, start = by_id(huffman.read_ids(spark, folder)), 0
    for i, ids in enumerate(encoded(TEXTS)):
        row = got[i * 3]
        assert (row["start"], row["n_tokens"]) == (start, len(ids) + 1)
        assert np.frombuffer(row["ids"], "<u4").tolist() == [*ids, 2]
        start += len(ids) + 1


def test_huffman_empty_table(spark, none):
    folder = new_run_dir(spark, "ids")
    huffman.write_ids(none, BYTE_BPE, folder)
    assert huffman.read_ids(spark, folder).collect() == []


@pytest.mark.parametrize("limit", [4, 6, 20])
def test_code_lengths_are_limited_and_complete(limit):
    found = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    lengths = huffman.code_lengths(found, limit)
    assert lengths[0] == 0 and lengths.max() <= limit and sum(2.0 ** -int(n) for n in lengths if n) == 1.0
    if limit == 20:  # Fibonacci counts: one code for each length
        assert sorted(lengths[1:].tolist()) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10]
    ids = np.array([RANDOM.randrange(1, 12) for _ in range(2000)])
    codes = huffman.Codes(lengths)
    (payload, offsets), = codes.encode([ids])
    start = np.frombuffer(offsets, "<u4").astype(np.int64)
    assert codes.decode(payload, start, np.array([512, 512, 512, 464])).tolist() == ids.tolist()


def test_token_counts(docs):
    library = tokens.tokenizer_of(WORD_BPE)
    got = by_id(counts.token_counts(docs, WORD_BPE, 100))
    for i, text in enumerate(TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i * 3]["n_bytes"], got[i * 3]["n_tokens"], got[i * 3]["over_limit"]) == (len((text or "").encode()), n, n > 100)


def test_long_texts_are_cut_at_white_space():
    parts = list(counts.cut_safely(LONG, 1000))
    assert len(parts) > 50 and [w for p in parts for w in p.split()] == LONG.split()
    assert list(counts.cut_safely("x" * 5000, 1000)) == ["x" * 5000]


def test_word_table(docs, none):
    got = by_id(wordtable.encode_decode(docs, BYTE_BPE))
    for i, ids in enumerate(encoded(TEXTS)):
        assert np.frombuffer(got[i * 3]["ids"], "<u4").tolist() == ids and got[i * 3]["n_tokens"] == len(ids)
        assert got[i * 3]["decoded"] == (TEXTS[i] or "")
    assert wordtable.encode_decode(none, BYTE_BPE).collect() == []


def test_quality_on_held_out_rows(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(300):
        good = i % 2
        plain = words(60, 1000 + i)
        rows.append((i, plain if good else " ".join(w.upper() + "!!" for w in plain.split()), "old"))
        if i % 5:
            labels.append((i, good))
    df = spark.createDataFrame([*rows, (300, None, "old"), (301, "", "old")], "doc_id long, text string, score string")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = by_id(quality.score(df, model, 0.5, keep=("doc_id", "text", "score")))
    held = [i for i in range(300) if i % 5 == 0]
    assert sum(got[i]["predicted"] == i % 2 for i in held) >= 0.95 * len(held)
    assert 0 <= got[300]["score"] == got[301]["score"] <= 1 and rng


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels), keep=("doc_id",)).collect()} == {0.5}


def test_mixing_reaches_its_targets(spark, none):
    rows = [(i, words(20 + i % 7, i) + (" | t" if i % 4 == 0 else ""), "en" if i % 3 else None, f"s{min(i % 10, 4)}", "x") for i in range(400)]
    df = spark.createDataFrame([*rows, (400, None, "en", "s0", "x")], "doc_id long, text string, lang string, source string, topic string")
    names = ("source", "lang", "topic")
    rated = mixing.mix(df, temper=0.5, sweeps=30)
    assert rated.count() == 401 and rated.filter("probability < 0 or probability > 1").isEmpty()
    for name in names:
        shares = {r[0]: (r[1], r[2]) for r in rated.groupBy(name).agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability"))).collect()}
        total, kept = sum(a for a, _ in shares.values()), sum(b for _, b in shares.values())
        scale = sum((a / total) ** 0.5 for a, _ in shares.values())
        for a, b in shares.values():
            assert b / kept == pytest.approx((a / total) ** 0.5 / scale, rel=1e-3)
    assert mixing.mix(none).collect() == []


def test_mixing_reaches_given_targets(spark):
    rows = [(i, words(20 + i % 7, i), ("en", "de", None)[i % 3], f"s{min(i % 10, 4)}", 3 + i % 5) for i in range(600)]
    rows += [(600, None, "en", "s0", 0), (601, "", "en", "s4", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")
    table = spark.createDataFrame([("en", 2.0), (None, 1.0), ("xx", 5.0)], "lang string, weight double")
    wanted = {"source": {"s0": 5, "s1": 1, "s2": 4, "s3": 0, "none such": 7}, "lang": table}
    for weight in (None, "size"):
        rated = mixing.mix(df, sweeps=30, temper=1.0, targets=wanted, weight=weight)
        assert rated.count() == 602
        for name, shares in (("source", {"s0": 0.5, "s1": 0.1, "s2": 0.4, "s3": 0, "s4": 0}), ("lang", {"en": 2 / 3, None: 1 / 3, "de": 0})):
            got = {r[0]: r[1] for r in rated.groupBy(name).agg(F.sum(F.col("n_tokens") * F.col("probability"))).collect()}
            assert {k: v / sum(got.values()) for k, v in got.items()} == pytest.approx(shares, abs=1e-3)
    chance = {r["doc_id"]: r["probability"] for r in rated.filter("doc_id >= 600").collect()}
    assert chance[600] > 0 == chance[601]
    assert mixing.mix(df, targets={"source": {"none such": 1}}).filter("kept").isEmpty()
    for bad in ({"place": {"x": 1}}, {"source": {"s0": -1}}, {"source": {"s0": 0}}):
        with pytest.raises(ValueError, match="targets"):
            mixing.mix(df, targets=bad)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 9)).round(1) / 4
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(500, None), (550, [float("nan")] * 9), (600, [1.0, None]), (50, vectors[50].tolist()), (None, [1.0]), (700, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=16).collect()]
    ints = {i: np.floor(256 * np.asarray(v, np.float32).astype(float)) for i, v in rows} | {700: np.zeros(9)}
    want = []
    for q in (0, 50, 100, 700):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [100.0, 3e6, 1e9, 1e30, 1e300])
def test_top_k_scores_beyond_doubles_are_exact(spark, size):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-size, size) for _ in range(40)]) for i in range(60)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, block_rows=16).collect()]
    ints, want = {i: [math.floor(256 * x) for x in v] for i, v in rows}, []
    for q in (0, 20, 40):
        scores = {i: max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(ints[q], v, strict=True)))) for i, v in ints.items() if i != q}
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted((-s, i) for i, s in scores.items())[:5], 1)]
    assert sorted(got) == sorted(want)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_of_more_queries_than_are_multiplied_at_a_time(spark):
    rng = np.random.default_rng(4)
    ints = rng.integers(-300, 300, (2 * topk.PART_ROWS + 9, 5))
    ints[7] *= 1000
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(ints)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") >= 0, k=3, block_rows=100).collect()]
    want = []
    for q, scores in enumerate((ints @ ints.T).tolist()):
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:3]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


def test_top_k_sends_no_blocks_over_the_driver(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = [(i, [i % 7 / 8, i % 5 / 8]) for i in range(200)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block_rows=16)
    assert found.count() == len(found.collect()) == 20
    assert "MapInArrow" in plan(found) and "Broadcast" not in plan(found)
    blocks = spark.range(12).select(F.col("id").alias("block"), F.lit(b"x" * 50).alias("keys"), F.lit(b"y" * 50).alias("vectors"))
    for groups in (5, 12):
        pairs = topk.met(blocks, blocks.limit(3), groups)
        assert pairs.count() == len(pairs.collect()) == 36
        assert "Join" in plan(pairs) and "Broadcast" not in plan(pairs)


def test_vectors_are_packed_in_the_fewest_bytes_that_are_exact():
    for top, kind in ((2**15 - 1, np.int16), (2**15, np.int32), (-(2**31), np.int32), (2**31, np.float64), (-1e300, np.float64)):
        numbers = np.array([[0.0, top], [1.0, -2.0]])
        assert topk._small(numbers).dtype == kind
        assert (topk._vectors(pa.py_buffer(topk._small(numbers).tobytes()), 2, 2) == numbers).all()


def test_empty_tables(none):
    for rows in (substring.deduplicate(none), jaccard.groups(none), multiset.edited_fingerprints(none), counts.token_counts(none, WORD_BPE, 1)):
        assert rows.collect() == []


def test_crc_of_the_registered_query_is_of_32_bit_ids():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\0\0\0")


def test_sets_in_a_heavy_list_meet_by_their_first_shingles_only(spark):
    rng = np.random.default_rng(5)
    core = np.sort(rng.integers(1, 1 << 62, 110, dtype=np.uint64))
    sets = [np.sort(np.concatenate([core[i % 3:], rng.integers(1, 1 << 62, own, dtype=np.uint64)])) for i, own in enumerate([14] * 60 + [13] * 6 + [2, 3, 9, 20])]
    rows = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "node long, n long, shingles binary")
    lists = jaccard.placed_lists(rows, core).join(spark.createDataFrame([(int(x),) for x in core.view(np.int64)], "list long"), "list")
    lists = lists.withColumn("label", F.col("node")).withColumn("f", F.lit(len(sets)))
    lists = lists.select("*", *[F.lit(0).cast("long").alias(f"p{i}") for i in range(jaccard.PARITIES)])  # sketches that leave out nothing
    links = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if (len(sets[a]), a) < (len(sets[b]), b)
             and 100 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - both)}
    met = {tuple(r) for r in jaccard.pairs_across(lists).collect()}
    assert links and links <= met
    assert len(met) < 6 * len(sets)  # not all pairs of the list
    assert {tuple(r) for r in jaccard.near_ones(lists).collect()} <= met

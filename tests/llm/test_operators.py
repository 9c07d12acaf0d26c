"""Operators of deducta.llm against brute force on small fixtures with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from deducta.llm import decontaminate, packing, pii, pseudo_likelihood, sharding, simhash, substrings, telephony, toxicity, warc
from deducta.llm.common import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, shard int, tag int"


def corpus(seed=5, n=60):
    """Nulls, empty and long texts, repeated rows, copies, clashing extra columns."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta.", "épée", "über", "zeta!!", "x9", "12.5", "omega"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 9, 25, 60, 200]))) for _ in range(n)]
    texts[3], texts[4], texts[5], texts[6] = None, "", " \t\n", "one"
    texts[7] = " ".join(r.choice(words) + str(r.randint(0, 999)) for _ in range(6000))
    texts[8] = texts[9] = texts[10] = texts[20]
    texts[11] = texts[21] + " " + texts[20]
    rows = [(i, t, "en", "s", None, "f", "k", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[12], (None, "no id here " + (texts[20] or ""), None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text):
    return (text or "").encode()


# ------------------------------------------------------------------ SimHash


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components(docs, rows):
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs).collect())
    prints = [brute_print(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None) for g in set(group) if any(group[k] == g and rows[k][0] is not None for k in range(len(rows)))}
    expected = sorted((-1 if r[0] is None else r[0], f"{prints[k]:016x}", least.get(group[k])) for k, r in enumerate(rows))
    assert got == expected


def test_sliced_shingles(monkeypatch):
    r = random.Random(1)
    for _ in range(2000):
        monkeypatch.setattr(simhash, "SLICE", r.choice([1, 2, 5, 30, 1000]))
        text = "".join(r.choice(["aB", " ", "c\t", "\n", "  ", "longerword"]) for _ in range(r.randint(0, 40)))
        assert simhash.simhash(simhash.shingle_parts(text.encode())) == brute_print(text)


def test_hot_keys_are_joined_whole(spark):
    from pyspark.sql import functions as F

    from deducta.llm.common import join_counted

    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)] + [(None, 0)], "x long, y long")
    counted = rows.where("x != 95").groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    want = sorted(map(tuple, rows.join(counted.drop("n"), "x", "left").collect()), key=str)
    for least, most in ((5, 10), (5, 2), (1000, 10), (0, 1000)):
        assert sorted(map(tuple, join_counted(rows, counted, "x", least, most).collect()), key=str) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_close_pairs(radius):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    prints = np.array([base[k % 4] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, r.integers(0, 5)).astype(np.uint64), initial=np.uint64(0)) for k in range(150)])
    last = np.repeat([69, 70, 149], [70, 1, 79])
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(prints, last, radius) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a in range(150) for b in range(a + 1, last[a] + 1) if int(prints[a] ^ prints[b]).bit_count() <= radius}


def test_large_bucket_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    prints = [(1 << 40) ^ (1 << b) ^ (1 << c) for b in range(12) for c in range(b)] + [7 << 50]
    nodes = spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fp long, node long")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    assert got == dict.fromkeys(range(1, 66), 0)


def test_long_chain_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100}


@pytest.mark.parametrize("alone", [0, simhash.ALONE])
def test_components_of_random_links(spark, monkeypatch, alone):
    monkeypatch.setattr(simhash, "ALONE", alone)
    r = random.Random(4)
    edges = [(r.randint(-150, 150), r.randint(-150, 150)) for _ in range(130)] + [(k, k + 1000) for k in (1 << 62, -(1 << 62))]
    group = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((group[a], group[b]))
        group = {x: low if c == high else c for x, c in group.items()}
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in got} == {x: c for x, c in group.items() if x != c} and len(got) == len({x.node for x in got})
    assert simhash.components(spark.createDataFrame([(5, 5)], "a long, b long")).collect() == []


def test_few_links_take_few_tasks(spark):
    """Every task of a shuffle leaves files and events, however few rows it has: 30 partitions, 40 links."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long").coalesce(1)
    settings = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("few-links", "")
        assert simhash.components(edges).count() == 40
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    assert 0 < tasks <= 5 * 30


# ------------------------------------------------------------------ sharding


@pytest.mark.parametrize("shards", [1, 3, 24, 200])
def test_minimax_shards(docs, rows, shards):
    got = sharding.shard(docs, shards).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, *_ in rows:
        sizes[hashlib.sha256(raw(t)).hexdigest()] += len(raw(t)) + 8
    order = [sizes[k] for k in sorted(sizes)]

    def fits(c):
        n = used = 0
        for s in order:
            n, used = (n, used + s) if n and used + s <= c else (n + 1, s)
        return n <= shards and max(order) <= c

    low = next(c for c in range(max(order), sum(order) + 1) if fits(c))
    held, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    text = dict((r[0], r[1]) for r in rows)
    for x in got:
        assert x.size == len(raw(text[x.doc_id])) + 8 and x.text_crc32 == zlib.crc32(raw(text[x.doc_id]))
        held[x.shard] += x.size
        slots[x.shard].append(x.slot)
        where[raw(text[x.doc_id])].add(x.shard)
    assert max(held.values()) == low and set(held) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())


def test_shards_refine(docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "SUMS", 8)
    monkeypatch.setattr(sharding, "CELL_DIGITS", 1)
    test_minimax_shards(docs, rows, 5)


# ------------------------------------------------------------------ decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize(("block", "piece"), [(200_000, 1 << 18), (15, 7)])
def test_contamination(spark, docs, rows, block, piece, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SLICE", piece)
    bench = [(1, " ".join(brute_words(rows[7][1])[40:60])), (2, "one"), (3, None), (4, "!!"), (10, rows[20][1]), (11, rows[20][1]), (5, "not there at all")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in bench:
        w = brute_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    expected = []
    for i, t, *_ in rows:
        w, hit, found = brute_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        expected.append((-1 if i is None else i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = [(-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination(docs, items).collect()]
    assert sorted(got) == sorted(expected)


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d a b"), (2, "a x b"), (3, "b a")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    phrases = spark.createDataFrame([("p", "a b"), ("q", "c d a")], "phrase_id string, text string")
    got = sorted(tuple(r) for r in decontaminate.search(index, phrases).collect())
    assert got == [("p", 1, 0), ("p", 1, 4), ("q", 1, 2)]
    near = {(r.phrase_id, r.doc_id) for r in decontaminate.search(index, phrases, slop=2).collect()}
    assert {("p", 1), ("p", 2), ("p", 3), ("q", 1)} == near


def test_empty_benchmark(spark, docs, rows):
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contamination(docs, items).collect()] == [False] * len(rows)


# ------------------------------------------------------------------ substrings


def brute_removal(rows, k=20):
    first = {}
    key = lambda r: (r[0] if r[0] is not None else 1 << 62)
    for r in sorted(rows, key=key):
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), (key(r), s))
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        lost = {x for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < (key(r), s) for x in range(s, s + k)}
        left = " ".join(x for p, x in enumerate(w) if p not in lost)
        out.append((-1 if r[0] is None else r[0], len(w), len(lost), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("frequent", "size"), [(1024, 1 << 21), (2, 5000)])
def test_repeats(docs, rows, frequent, size, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "BATCH_BYTES", size)
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.removal_digests(docs).collect())
    assert got == brute_removal(rows)


def test_repeats_of_a_frequent_minimiser(spark, monkeypatch):
    r = random.Random(9)
    core = "v1 v2 v3 v4 v5 v6"
    rows = []
    for k in range(300):
        tail = f"x{r.randint(0, 40)} " + " ".join(f"y{j}" for j in range(20))
        rows.append((k, " ".join(f"z{r.randint(0, 3)}" for _ in range(18)) + f" {core} {tail}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = []
    for frequent in (1 << 40, 5):
        monkeypatch.setattr(substrings, "SAMPLE", 1)
        monkeypatch.setattr(substrings, "FREQUENT", frequent)
        found.append(len(substrings.frequent_minimisers(substrings._sources(docs), 20, 6)))
        assert sorted(tuple(x) for x in substrings.removal_digests(docs).collect()) == brute_removal(rows)
    assert found[0] == 0 < found[1]


def test_pieces_are_compacted_and_verified(spark):
    r = random.Random(4)
    line = [f"w{r.randint(0, 9999)}" for _ in range(400)]
    rows = [(1, " ".join(line)), (2, "a b " + " ".join(line[100:300]) + " c"), (3, " ".join(line[:90]) + " d " + " ".join(line[150:]))]
    texts = substrings._sources(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    spans = substrings.compacted(substrings.repeated_windows(texts))
    assert sorted((x.doc, x.s, x.n) for x in spans.collect()) == [(2, 2, 181), (3, 0, 71), (3, 91, 231)]
    digests = substrings.sourced(spans, texts).collect()
    words = {i: t.encode().split() for i, t in rows}
    assert all(x.source is None or x.digest == substrings._digest(words[x.doc], x.s, x.n, 20) for x in digests)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([rows[0][1].encode()]), pa.array([[3]]), pa.array([[2]]), pa.array([[b"other"]])], ["a", "b", "c", "d", "e"])
    with pytest.raises(ValueError, match="not those of their source"):
        list(substrings._kept_batches(20, True)(iter([batch])))


def test_rows_without_an_id_are_apart(spark):
    r = random.Random(6)
    rows = [(None, " ".join(f"w{r.randint(0, 30)}" for _ in range(30))) for _ in range(50)] + [(None, "same words " * 15)] * 3
    got = substrings.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(x.n_words == 30 for x in got)
    again = [x for x in got if x.n_removed]
    assert len(again) == 3 and len({x.kept_sha256 for x in again}) == 1


def test_periodic_repeats(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.choice([0, 19, 20, 40, 300]))) if k % 4 else "a " * r.choice([19, 20, 21, 90])) for k in range(80)]
    got = sorted(tuple(x) for x in substrings.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_removal(rows)


def test_removed_spans(spark):
    shared = " ".join(f"w{k}" for k in range(25))
    rows = [(1, shared), (2, f"x y {shared} z")]
    got = {r.doc_id: (r.text, r.spans) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (shared, []), 2: ("x y z", [[2, 27]])}


# ------------------------------------------------------------------ packing


def test_packing_round_trip(docs, rows, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SHARD_TOKENS", 5000)
    model = Tokenizer.from_file(tokenizer_file())
    text = {r[0]: r[1] or "" for r in rows}
    ids = {i: np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in text.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in packing.pack(docs, tokenizer_file()).collect():
        assert x.doc_tokens == len(ids[x.doc_id])
        assert x.ids_crc32 == zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes())
        pieces[x.doc_id].append((x.start, x.length))
        sequences[x.sequence_id].append((x.offset, x.length))
    copies = defaultdict(int)
    for r in rows:
        copies[r[0]] += 1
    for i, found in pieces.items():
        assert sum(n for _, n in found) == len(ids[i]) * copies[i]
        if copies[i] == 1:
            at = 0
            for s, n in sorted(found):
                assert s == at
                at += n
    assert pieces.keys() == copies.keys()
    for found in sequences.values():
        at = 0
        for o, n in sorted(found):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_word_tokenizer_is_exact():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    texts = ["İstanbul ǅ ﬁ naïve don't we're x\x1cq a|b <|endoftext|>x <|ENDOFTEXT|>. A.B,C ...", "é. ×. ». ́. é, (x). a.,b 1.2,3", "", "ÀB ßx ½ 한국어 Ⅷ.", "A" * 3000]
    got = packing.WordTokenizer(path).ids([t.encode() for t in texts])
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in expected]


def test_every_token_is_what_its_text_merges_to():
    import json

    with open(tokenizer_file(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
    for a, b in rank:
        token = a + b
        parts = list(token.removesuffix("</w>"))
        parts[-1] += "</w>" * token.endswith("</w>")
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: (rank.get((parts[i], parts[i + 1]), 1 << 30), i))
            assert (parts[k], parts[k + 1]) in rank
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [token]


def test_plain_words_are_exact():
    r = random.Random(6)
    tokenizer = packing.WordTokenizer(tokenizer_file())
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzàéèüößñçœ") for _ in range(r.randint(1, 14))) for _ in range(30_000)]
    expected = tokenizer.model.encode_batch_fast(words, add_special_tokens=False)
    assert all(np.frombuffer(tokenizer[w.encode()], "<u2").tolist() == e.ids for w, e in zip(words, expected, strict=True))


def brute_scores(documents, k, frequency, total, mean):
    from math import log1p

    out = []
    for d in documents:
        score = 0.0
        for t in set(documents[k]):
            n = d.count(t)
            idf = log1p((total - frequency[t] + 0.5) / (frequency[t] + 0.5))
            score += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(score)
    return out


def brute_fill(documents, frequency, total, mean, window):
    """Sequences by the definition, a neighbour at a time, from the best down."""
    start = [len(d) // window * window for d in documents]
    out = [[(k, s, window)] for k, d in enumerate(documents) for s in range(0, start[k], window)]
    left = [len(d) - s for d, s in zip(documents, start, strict=True)]
    rest = []
    for seed in range(len(documents)):
        while left[seed] and not rest:
            row, room = [(seed, start[seed], left[seed])], window - left[seed]
            left[seed] = 0
            order = sorted((k for k in range(len(documents)) if left[k]), key=lambda k, s=brute_scores(documents, seed, frequency, total, mean): (-round(s[k], 9), k))
            for k in order:
                if 0 < left[k] <= room:
                    row.append((k, start[k], left[k]))
                    room, left[k] = room - left[k], 0
            again = [k for k in order if left[k]]
            if room and again:
                k = again[0]
                row.append((k, start[k], room))
                start[k], left[k], room = start[k] + room, left[k] - room, 0
            if room:
                rest = row
            else:
                out.append(row)
    return out, rest


@pytest.mark.parametrize("seed", range(6))
def test_neighbours_by_definition(seed):
    r = random.Random(seed)
    documents = [[r.randint(5, 30) for _ in range(r.choice([0, 2, 5, 9, 40]))] + [1] for _ in range(r.choice([1, 8, 50]))]
    ids, sizes = np.array([t for d in documents for t in d], "<u2"), np.array([len(d) for d in documents])
    frequency = np.bincount(packing._frequencies(ids, sizes)[0], minlength=1 << 16)
    mean = float(sizes.mean())
    index = packing.Index(ids, sizes, frequency, len(documents), mean)
    for k in range(len(documents)):
        assert np.allclose(index.scores(k), brute_scores(documents, k, frequency, len(documents), mean))
    found = packing.fill(index, sizes, 16)
    want, rest = brute_fill(documents, frequency, len(documents), mean, 16)
    assert found[: len(want)] == want and found[len(want) :] == packing._powers(rest)


def test_related_documents_are_routed_together(spark):
    r = random.Random(4)
    topics = [[f"{c}word{k}" for k in range(40)] for c in "abcdefgh"]
    rows = [(k, " ".join(r.choice(topics[k % 8]) for _ in range(60))) for k in range(400)]
    chunks = packing.tokenize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_file())
    frequency, documents, ids = packing.statistics(chunks)
    order = [x.doc_id % 8 for x in packing.route(chunks, frequency, documents, ids).collect()]
    assert len(order) == 400 and sum(a == b for a, b in zip(order, order[1:], strict=False)) > 200


def test_numbers_of_many_partitions(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task()

        def partitionId(self):  # noqa: N802
            return 50_000

    monkeypatch.setattr(packing, "TaskContext", Task)
    ids = pa.array([np.array([7, 8, 1], "<u2").tobytes()] * 3, pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None], pa.int64()), ids], ["doc_id", "ids"])
    out = pa.Table.from_batches(packing._pack_batches(np.ones(1 << 16), 3, 3.0)(iter([batch]))).to_pylist()
    assert sum(x["length"] for x in out) == 9 and {x["sequence_id"] >> 46 for x in out} == {50_000}
    texts = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([b"x"], pa.binary())], ["doc_id", "text"])
    assert next(packing._chunk_batches(tokenizer_file())(iter([texts]))).column(0)[0].as_py() == 50_000 << 20
    with pytest.raises(OverflowError):
        packing._number(1 << 22, 22)


# ------------------------------------------------------------------ WARC


def test_warc_round_trip(spark):
    long = "é" * 700_000
    rows = [(1, "u", "a" * 1000), (2, "u\nx", "a" * 1000), (3, None, "WARC/1.1\r\n\r\n" * 9000), (4, "u", None), (5, "z", long), (6, "", "s"), (7, "", "s"), (None, "n", "a" * 1000), (8, "b", "b" * 2000), (8, "b", "b" * 2000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha1 string").repartition(2)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    expected = []
    for i, _, t in rows:
        first = max((r[0] for r in rows if r[2] == t and r[0] is not None), default=None)
        again = len(raw(t)) >= 1000 and first != i
        expected.append((i, len(raw(t)), hashlib.sha1(raw(t)).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(expected, key=str)
    chunks = warc.read_chunks(warc.write_archives(warc.plan_records(pages))).where("record_id = 5").orderBy("chunk").collect()
    assert [len(c.data) for c in chunks[:-1]] == [warc.CHUNK] * (len(chunks) - 1)
    assert len(chunks) > 1 and b"".join(c.data for c in chunks) == raw(long)
    done = hashlib.sha1()
    for c in chunks:
        done.update(c.data)
        assert c.payload_digest == done.hexdigest()


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ------------------------------------------------------------------ telephony


def test_g711_tables():
    def mulaw(code):
        code = ~code & 0xFF
        value = ((code & 15) * 2 + 33) * 2 ** (code >> 4 & 7) - 33
        return -4 * value if code & 128 else 4 * value

    def alaw(code):
        code ^= 0x55
        segment, step = code >> 4 & 7, (code & 15) * 16 + 8
        value = step if not segment else (step + 256) << (segment - 1)
        return value if code & 128 else -value

    assert telephony.MULAW_PCM.tolist() == [mulaw(c) for c in range(256)]
    assert telephony.ALAW_PCM.tolist() == [alaw(c) for c in range(256)]


def test_ima_blocks():
    r = np.random.default_rng(3)
    blocks = r.integers(0, 256, (5, 36), dtype=np.uint8)
    blocks[:, 2] %= 89
    got = telephony.ima_decode(blocks)
    for row, samples in zip(blocks, got, strict=True):
        assert samples.tolist() == slow_ima(row)


def slow_ima(block):
    value, index = int(block[:2].view("<i2")[0]), int(block[2])
    out = [value]
    for code in (c for b in block[4:].tolist() for c in (b & 15, b >> 4)):
        step = int(telephony.STEPS[index])
        change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        value = max(-32768, min(32767, value - change if code & 8 else value + change))
        index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
        out.append(value)
    return out


def slow_resample(x, source, target):
    from fractions import Fraction
    from math import floor

    out = []
    for k in range(len(x) * target // source):
        if target >= source:
            at = Fraction(k * source, target)
            left = floor(at)
            out.append(floor(x[left] * (1 - (at - left)) + x[min(left + 1, len(x) - 1)] * (at - left)))
        else:
            a, b = Fraction(k * source, target), Fraction((k + 1) * source, target)
            held = sum(x[i] * (min(b, i + 1) - max(a, i)) for i in range(floor(a), min(len(x), floor(b) + 1)))
            out.append(floor(held / (b - a)))
    return out


@pytest.mark.parametrize(("source", "target"), [(8000, 4000), (8000, 16_000), (8000, 11_025), (8000, 8000), (8000, 3000), (5, 3)])
def test_resample(source, target, monkeypatch):
    r = random.Random(source + target)
    for n in (0, 1, 2, 7, 64, 129):
        x = [r.randint(-32768, 32767) for _ in range(n)]
        for size in (1, 5, 1 << 16):
            monkeypatch.setattr(telephony, "SLICE", size)
            assert telephony.resample(np.array(x, np.int16), source, target).tolist() == slow_resample(x, source, target)


def slow_features(x):
    n = len(x)
    changes = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"n={n};ms={sum(v * v for v in x) // n};mean={sum(x) // n};peak={max(map(abs, x))};zc={changes};crc={zlib.crc32(np.array(x, '<i2').tobytes())}"


@pytest.mark.parametrize(("group", "piece"), [(1 << 20, 1 << 16), (100, 50)])
def test_stored_audio(docs, rows, group, piece, monkeypatch):
    monkeypatch.setattr(telephony, "GROUP", group)
    monkeypatch.setattr(telephony, "SLICE", piece)
    text = {r[0]: raw(r[1]) for r in rows}
    media = telephony.store(docs)
    got = telephony.describe(media).collect()
    assert len(got) == len(rows)
    same, codecs = defaultdict(set), set()
    for x in got:
        t = text[x.doc_id]
        payload = t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t))
        codec = zlib.crc32(payload) % 3
        codecs.add(codec)
        assert (x.n_bytes, x.payload_bytes) == (len(t), len(payload))
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.tail_crc32 == zlib.crc32(payload[-64:])
        assert x.media_bytes == (len(payload) + 58 if codec < 2 else len(payload) // 64 * 68 + 60)
        same[t].add((x.media_sha256, x.feature))
        if len(payload) < 2000:
            units = [np.frombuffer(b"\0" * 4 + payload[k : k + 64], np.uint8) for k in range(0, len(payload), 64)]
            samples = [v for u in units for v in slow_ima(u)] if codec == 2 else [int((telephony.MULAW_PCM, telephony.ALAW_PCM)[codec][c]) for c in payload]
            assert x.feature == slow_features(slow_resample(samples, 8000, 4000))
    assert codecs == {0, 1, 2}
    assert sorted(map(str, telephony.described(docs, parts=3).collect())) == sorted(map(str, got))
    assert all(len(s) == 1 for s in same.values())


def test_pcm_of_another_rate(docs):
    stored = telephony.resampled(telephony.store(docs.where("doc_id = 6")), 16_000).first()
    pcm, rate = telephony.decode(stored.pcm)
    assert rate == 16_000 and len(pcm) % 2 == 0 and stored.payload_bytes == 64


# ------------------------------------------------------------------ personal data


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p: [(m[0], m.start(), m.end()) for m in re.finditer(p, text)]
    out = [("email", a, b) for _, a, b in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [("ip", a, b) for s, a, b in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in s.split("."))]
    out += [("card", a, b) for s, a, b in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))]
    return out + [("phone", a, b) for s, a, b in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(s)) <= 15]


def test_base_spans():
    r = random.Random(4)
    for _ in range(20_000):
        text = "".join(r.choice("a.@1-2 é3+(9)5%0") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(text) == brute_base(text), text
    for text in ("1." * 40_000, "a" * 200_000 + "@", "0" * 100_000, "+" + "1" * 100_000, "4111 1111 1111 1111 x 4111111111111112"):
        assert pii.base_spans(text) == brute_base(text) if len(text) < 100 else pii.base_spans(text) is not None


def test_added_spans():
    model = pii.train()
    for text, kind in (('the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and', "key"), ("mail me: jon.doe [at] example [dot] com now", "email"), ("call (212) 555-0187 today", "phone"), ("my SSN 078-05-1120 is", "ssn")):
        base, spans = model.spans(text)
        assert not base and [s[0] for s in spans] == [kind], text
    for text in ("We met at noon. It was version 3.0 of 2024-05-01.", "Licensed under CC BY-NC 4.0.", "a-long-hyphenated-compound-word-here", ""):
        assert model.spans(text)[1] == [], text


def test_many_candidates_take_linear_time():
    import time

    model = pii.train()
    seconds = []
    for n in (2000, 32_000):
        text = " ".join(f"call (212) 555-{k % 10_000:04d}" for k in range(n))
        start = time.process_time()
        assert len(model.spans(text)[1]) == n
        seconds.append(time.process_time() - start)
    assert seconds[1] < 64 * max(seconds[0], 0.02)


def test_likelier_candidates_come_first():
    model = pii.train()
    r = random.Random(3)
    for _ in range(300):
        text = " ".join(r.choice(["SSN", "078-05-1120", "call", "212-555-0187", "4111111111111111", "token", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "a.b@c.de", "10.0.0.1", "+49 170 1234567"]) for _ in range(r.randint(1, 12)))
        base = pii.base_spans(text)
        found = [c for c in pii.candidates(text) if not any(a < c[2] and c[1] < b for _, a, b in base)]
        p = model.trees.probability(np.array([pii.features(text, c) for c in found], float)) if found else []
        chosen = []
        for k in sorted(range(len(found)), key=lambda k: (-p[k], k)):
            if p[k] >= model.limits.get(found[k][0], 2) and not any(c[1] < found[k][2] and found[k][1] < c[2] for c in chosen):
                chosen.append(found[k])
        assert model.added(text, base) == chosen


def test_held_out_spans():
    rows = pii.examples(600, seed=99)
    model = pii.train()
    hit = [any(s[1] < c[2] and c[1] < s[2] for s in model.spans(t)[1]) for t, c, _ in rows]
    truth = [p for _, _, p in rows]
    assert sum(h and p for h, p in zip(hit, truth, strict=True)) >= 0.9 * sum(truth)
    assert sum(h and p for h, p in zip(hit, truth, strict=True)) >= 0.9 * sum(hit)


def test_long_keys():
    r = random.Random(4)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    model = pii.train()
    for n in (200, 201, 333, 1000):
        for cue in ('token = "', "Authorization: Bearer ", "api key: "):
            key = "".join(r.choice(signs) for _ in range(n))
            text = f"see the {cue}{key} and more"
            assert pii.redact_text(text, model.spans(text)[1]) == f"see the {cue}[KEY] and more", (n, cue)
        for plain in ("=" * n, "-" * n, "/".join(["usr", "share", "lib"] * n)):
            assert not model.spans(f"see {plain} and more")[1]


def test_find_and_redact(spark):
    rows = [(1, "é a@b.cd 10.0.0.1"), (2, None), (None, ""), (3, "clean")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].spans) == (1, 1, "email:2:8,ip:9:17")
    assert got[1].base_sha256 == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
    assert got[2].spans == got[None].spans == got[3].spans == ""
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "é [EMAIL] [IP]", 2: None, None: "", 3: "clean"}


# ------------------------------------------------------------------ toxicity, likelihood


def labelled(n=1200):
    r = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [f"w{r.randint(0, 400)}" for _ in range(40)] + [r.choice(["awful", "vile", "rotten"]) + r.choice(["ish", "ly", "ness"]) for _ in range(3 * toxic)]
        r.shuffle(w)
        rows.append((i, " ".join(w), "x"))
        marks.append((i, 1, int(toxic)))
    return rows, [*marks, (None, 1, 1), (3, 1, None), (99_999, 1, 1)]


def test_toxicity_held_out(spark):
    rows, marks = labelled()
    docs = spark.createDataFrame([*rows, (None, "vilely vilely", "x"), (50_000, None, "x")], "doc_id long, text string, score string")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, x in got.items() if x.held_out} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert got[50_000].predicted == 0 and got[None].predicted == 1
    assert toxicity.keep_clean(docs, model).count() < docs.count() * 0.85


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, marks = labelled(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    flip = [(i, q, 1 - t if t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in marks]
    a, b = (toxicity.fit(docs, spark.createDataFrame(m, "doc_id long, quality int, toxic int")) for m in (marks, flip))
    assert a.numbers == b.numbers and a.bias == b.bias and (a.weights == b.weights).all()


def test_no_labels(spark, docs, rows):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}


def slow_risk(x, marks, prior, w, b):
    """The risk by its definition: confirmed documents are also unlabelled ones."""
    from math import exp, log1p

    z = [sum(w[k] * v for k, v in row.items()) + b for row in x]
    positive = [t for t, m in zip(z, marks, strict=True) if m]
    mean = lambda f, t: sum(map(f, t)) / len(t)
    negative = mean(lambda t: log1p(exp(t)), z) - prior * mean(lambda t: log1p(exp(t)), positive)
    return prior * mean(lambda t: log1p(exp(-t)), positive) + max(0.0, negative) + toxicity.DECAY / 2 * sum(v * v for v in w)


def test_nonnegative_risk():
    r = random.Random(2)
    for turn in range(20):
        x = [{k: r.random() for k in r.sample(range(6), r.randint(0, 4))} for _ in range(30)]
        marks = np.array([k % 4 == 0 for k in range(30)])
        at = np.array([r.uniform(-1, 1) * (1 + turn) for _ in range(7)])
        sizes, columns, values = np.array([len(d) for d in x]), np.array([k for d in x for k in d], int), np.array([v for d in x for v in d.values()])
        total = np.append(np.bincount(columns[np.repeat(marks, sizes)], values[np.repeat(marks, sizes)], minlength=6), marks.sum())

        def risk(v, sizes=sizes, columns=columns, values=values, marks=marks, total=total):
            return toxicity.nonnegative_risk(toxicity.sums_of(sizes, columns, values, marks, v[:-1], v[-1]), total, int(marks.sum()), 30, 0.2, v[:-1], float(v[-1]))

        value, gradient = risk(at)
        assert np.isclose(value, slow_risk(x, marks, 0.2, at[:-1], at[-1]))
        step = 1e-5 * np.eye(7)
        assert np.allclose(gradient, [(risk(at + e)[0] - risk(at - e)[0]) / 2e-5 for e in step], atol=1e-4)
        assert risk(toxicity.minimise(risk, at))[0] < value


def test_minimise():
    a = np.diag([1.0, 10, 100])
    x = toxicity.minimise(lambda v: (1 + float((v - 1) @ a @ (v - 1)), 2 * a @ (v - 1)), np.zeros(3))
    assert np.allclose(x, 1, atol=0.05)


def test_fit_is_that_of_all_rows_however_split(spark):
    rows, marks = labelled(400)
    docs = spark.createDataFrame([*rows, *rows[:50], (None, "vilely x", "x")], "doc_id long, text string, k string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    one, many = (toxicity.fit(docs.repartition(n), labels) for n in (1, 7))
    assert one.numbers == many.numbers and one.bias == many.bias and (one.weights == many.weights).all()
    kept = [(i, t) for i, t, _ in [*rows, *rows[:50], (None, "vilely x", "x")] if i is None or zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = {i for i, _, t in marks if t}
    x, y = [one.values(t.encode()) for _, t in kept], np.array([i in toxic for i, _ in kept])
    seen = [t for i, _, t in marks if t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    prior = sum(seen) / len(seen)
    best = slow_risk(x, y, prior, one.weights, one.bias)
    assert best < slow_risk(x, y, prior, np.zeros(len(one.weights)), np.log(prior / (1 - prior))) / 3
    r = np.random.default_rng(0)
    near = [slow_risk(x, y, prior, one.weights + d[:-1], one.bias + d[-1]) for d in r.normal(0, 0.05, (20, len(one.weights) + 1))]
    assert min(near) > best - 0.01  # where the corrected part meets zero, the steps end a little early


def test_toxicity_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, x string")
    model = toxicity.fit(none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(none, model).count() == 0 and model.values(b"any") == {}


def scores(df):
    return sorted(((x.doc_id, x.n_tokens, x.log_likelihood, x.mean_log_likelihood) for x in df.collect()), key=str)


def test_pseudo_likelihood(spark):
    rows = [(k, "a b c d e f g h " * 60, "c") for k in range(40)] + [(90, None, "c"), (None, "", "c")]
    stored = pseudo_likelihood.shards(spark.createDataFrame(rows, "doc_id long, text string, place string"), tokenizer_file())
    net = pseudo_likelihood.train(stored)
    got = {r.doc_id: r for r in pseudo_likelihood.score(stored, net).collect()}
    assert got[90].n_tokens == got[None].n_tokens == 0 and got[90].log_likelihood == 0 and got[90].mean_log_likelihood is None
    odd = pseudo_likelihood.shards(spark.createDataFrame([(0, "h c a g e b d f " * 60)], "doc_id long, text string"), tokenizer_file())
    assert got[0].mean_log_likelihood > pseudo_likelihood.score(odd, net).first().mean_log_likelihood + 0.1


def test_scores_do_not_depend_on_the_split(docs, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_BYTES", 10_000)
    found = []
    for n in (1, 5):
        stored = pseudo_likelihood.shards(docs.repartition(n), tokenizer_file())
        assert stored.count() > 2
        found.append(scores(pseudo_likelihood.score(stored, pseudo_likelihood.train(stored))))
    assert found[0] == found[1] and len(found[0]) == docs.count()


def random_network(seed=3):
    r = np.random.default_rng(seed)
    net = pseudo_likelihood.Network.new(1 + r.integers(0, 50, 1 << 16).astype(float))
    for part in net.parts():
        part[...] = r.normal(0, 0.3, part.shape)
    return net


def slow_log_probability(net, ids, at):
    """Of the id at a place of one document, a digit at a time."""
    base = pseudo_likelihood.BASE
    around = [at + j for j in (-2, -1, 1, 2)]
    seen = [int(net.classes[ids[k]]) + 1 if 0 <= k < len(ids) else 0 for k in around]
    h = np.tanh(sum(net.tables[k * (base * base + 1) + c].astype(float) for k, c in enumerate(seen)) + net.bias)
    a, b = divmod(int(net.classes[ids[at]]), base)
    out = float(net.shares[ids[at]])
    for w, bias, digit in ((net.weights[:, :base], net.first, a), (net.weights[:, base:], net.second[a], b)):
        z = np.exp(h @ w + bias)
        out += np.log(z[digit] / z.sum())
    return out


def test_log_probabilities_by_definition():
    net, r = random_network(), random.Random(1)
    documents = [[r.randrange(49_000) for _ in range(n)] for n in (0, 1, 2, 3, 7, 40)]
    ids, sizes = np.array([t for d in documents for t in d], "<u2"), np.array([len(d) for d in documents])
    want = [slow_log_probability(net, d, k) for d in documents for k in range(len(d))]
    assert np.allclose(pseudo_likelihood.log_probabilities(net, sizes, ids), want, atol=1e-4)


def test_probabilities_of_all_tokens_add_up_to_one():
    net = random_network()
    tokens = np.arange(1 << 16)
    logs = net.log_probability(tokens, np.array([[0], [1400], [2800], [5000]]) + np.zeros(len(tokens), int))
    assert np.isclose(np.exp(logs).sum(), 1, atol=1e-4)


def test_start_is_the_share_in_the_corpus(spark):
    stored = pseudo_likelihood.shards(spark.createDataFrame([(1, "alpha beta beta"), (2, "beta")], "doc_id long, text string"), tokenizer_file())
    net = pseudo_likelihood.start(stored)
    ids = np.concatenate([np.frombuffer(r.ids, "<u2") for r in stored.collect()])
    counts = np.bincount(ids, minlength=1 << 16) + 1
    net.weights[...] = 0
    every = np.arange(1 << 16)
    logs = net.log_probability(every, np.zeros((4, len(every)), int))
    assert np.allclose(logs, np.log(counts / counts.sum()), atol=1e-4)
    assert len(set(net.classes[np.argsort(-counts, kind="stable")[: pseudo_likelihood.OWN]])) == pseudo_likelihood.OWN


def test_gradients():
    net, r = random_network(), np.random.default_rng(1)
    tokens = r.integers(0, 49_000, 16)
    context = r.integers(0, pseudo_likelihood.CLASSES + 1, (4, 16)).astype(np.int16) + (np.arange(4) * (pseudo_likelihood.CLASSES + 1))[:, None].astype(np.int16)
    learner = pseudo_likelihood.Learner(net.copy())
    learner.learn(net.classes[tokens], context)
    for k, (before, after) in enumerate(zip(net.parts(), learner.net.parts(), strict=True)):
        moved = (before - after) / pseudo_likelihood.RATE  # g / sqrt(0.01 + g^2)
        gradient = moved * 0.1 / np.sqrt(np.maximum(1 - moved**2, 1e-12))
        flat = np.flatnonzero(np.abs(gradient).ravel() > 1e-3)[:20]
        assert len(flat), k
        for at in flat:
            found = []
            for step in (0.01, -0.01):
                other = net.copy()
                other.parts()[k].ravel()[at] += step
                found.append(-other.log_probability(tokens, context).mean())
            assert np.isclose((found[0] - found[1]) / 0.02, gradient.ravel()[at], rtol=0.05, atol=1e-3), k


def test_training_covers_every_position():
    r = random.Random(2)
    net = random_network()
    sizes = np.array([40, 3, 0, 1, 5000, 9])
    ids = np.array([r.randrange(49_000) for _ in range(sizes.sum())], "<u2")
    seen = []

    class Spy(pseudo_likelihood.Learner):
        def learn(self, classes, context):
            seen.extend(zip(classes.tolist(), *(c.tolist() for c in context), strict=True))

    original, pseudo_likelihood.Learner = pseudo_likelihood.Learner, Spy
    try:
        counts = [pseudo_likelihood.train_shard(net, k, np.array([0, 1, 0, 1, 1, 0], np.int8), sizes, ids)[1] for k in range(pseudo_likelihood.ROUNDS)]
    finally:
        pseudo_likelihood.Learner = original
    assert sum(counts) == len(ids) and min(counts) > 2000
    line, places = pseudo_likelihood._padded(net.classes[ids], sizes)
    around = pseudo_likelihood._around(line, places).T.tolist()
    assert sorted(seen) == sorted((int(net.classes[t]), *x) for t, x in zip(ids, around, strict=True))


# ------------------------------------------------------------------ empty tables


def test_empty_tables(spark, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for out in (
        simhash.near_duplicates(none),
        sharding.shard(none),
        decontaminate.contamination(none, items),
        substrings.removal_digests(none),
        packing.pack(none, tokenizer_file()),
        telephony.describe(telephony.store(none)),
        pii.find(none),
        pseudo_likelihood.score(pseudo_likelihood.shards(none, tokenizer_file()), pseudo_likelihood.start(pseudo_likelihood.shards(none, tokenizer_file()))),
    ):
        assert out.count() == 0

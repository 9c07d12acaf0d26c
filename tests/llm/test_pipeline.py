"""The pipeline's stages on planted rows, each against what it should keep."""

import random

import numpy as np
import pytest

import corpus_pipeline
from deducta.llm import pii


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    bad = ["awful", "vile", "rotten"]
    rows = [(i, text(80)) for i in range(600)]
    toxic = set(range(0, 600, 6))
    rows = [(i, t + " " + " ".join(r.choice(bad) for _ in range(6)) if i in toxic else t) for i, t in rows]
    passage = text(15)
    plain = dict(rows)
    rows += [(700, plain[1]), (701, plain[1]), (702, plain[2] + " x"), (1, plain[1]), (710, text(30) + " " + passage + " " + text(30)), (711, "mail a.b@example.com " + text(40)), (712, None), (None, text(50)), (713, "")]
    spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(600) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
    clean, once, apart, private, packed = kept
    ids = [sorted((x.doc_id for x in d.select("doc_id").collect()), key=lambda i: (i is None, i)) for d in (clean, once, apart, private)]
    assert len(set(ids[0]) & toxic) <= 2
    assert len([i for i in ids[0] if i is not None and i < 600 and i not in toxic]) >= 490
    assert ids[1].count(1) == 1 and not {700, 701} & set(ids[1]) and None in ids[1]
    assert 710 in ids[1] and 710 not in ids[2] and set(ids[1]) - set(ids[2]) == {710}
    assert ids[2] == ids[3]
    text_of = {x.doc_id: x for x in private.collect()}
    assert text_of[711].text.startswith("mail [EMAIL] ") and text_of[711].n_chars == len(text_of[711].text)
    assert all(not x.text or not pii.base_spans(x.text) for x in text_of.values())
    assert private.columns == list(corpus_pipeline.COLUMNS)
    assert {x.doc_id for x in packed.select("doc_id").collect()} == set(ids[3])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_texts_under_one_id_are_different_documents(spark):
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    a, b, c, d = (text(60) for _ in range(4))
    rows = [(1, a), (1, b), (2, c), (1, b), (None, d), (None, d), (3, d), (None, a + " x"), (7, None), (8, ""), (None, None), (None, "only here"), (None, "only here")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((x.doc_id, x.text or "") for x in got.collect()), key=str) == sorted([(1, a), (1, b), (2, c), (3, d), (7, ""), (None, "only here")], key=str)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = spark.createDataFrame([(k, f"some words of text {k}", "en", "s", 5, 1, "h", "k", 2, "f") for k in range(20)], SCHEMA + ", n long, text_hash string, key string, component_id long, fp string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, str(tmp_path)).count() == 0
        out = stage(spark, some, str(tmp_path))
        assert out.select("doc_id").distinct().count() == 20
        assert k == 4 or out.columns == list(corpus_pipeline.COLUMNS)


def test_run_returns_pieces(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.mark.parametrize("bucket", [2048, 7])
def test_near_copies_of_four_fifths(spark, monkeypatch, bucket):
    monkeypatch.setattr(corpus_pipeline.simhash, "BUCKET", bucket)
    r = random.Random(5)
    words = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    rows: list[tuple[int, str]] = []
    passage = words(30)
    for k in range(60):
        base = words(r.randint(3, 200)) + passage * (k % 2)
        rows.append((10 * k, " ".join(base)))
        for j in range(1, r.randint(2, 5)):
            other = list(base)
            for _ in range(r.randint(0, 4)):
                other[r.randrange(len(other))] = f"v{r.randint(0, 5000)}"
            rows.append((10 * k + j, " ".join(other).upper()))
    root = {i: i for i, _ in rows}
    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            p, q = sets(x.lower()), sets(y.lower())
            if 5 * len(p & q) >= 4 * len(p | q):
                u, v = root[i], root[j]
                root = {k: min(u, v) if c in (u, v) else c for k, c in root.items()}
    want = {i for i, c in root.items() if i == c}
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert 60 < len(want) < len(rows) - 20
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want


def test_wide_fingerprints_by_bit_planes():
    simhash, r = corpus_pipeline.simhash, np.random.default_rng(1)
    base = r.integers(0, 1 << 63, (5, 4), dtype=np.uint64)
    flips = [np.packbits(np.isin(np.arange(256), r.choice(256, r.integers(0, 120), replace=False))).view(np.uint64) for _ in range(200)]
    prints = np.array([base[k % 5] ^ f for k, f in enumerate(flips)])
    last = np.repeat([69, 70, 199], [70, 1, 129])
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    for radius in (0, 5, simhash.COPY_RADIUS, 150):
        got = {(int(a), int(b)) for i, j in simhash.wide_close_pairs(prints, last, radius) for a, b in zip(i, j, strict=True)}
        assert got == {(a, b) for a in range(200) for b in range(a + 1, last[a] + 1) if apart[a, b] <= radius}
        assert (simhash.wide_close_to(prints[5:40], prints, radius) == (apart[5:40] <= radius)).all()


@pytest.mark.parametrize("bucket", [2048, 16])
def test_links_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch, bucket):
    simhash, r = corpus_pipeline.simhash, random.Random(7)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    base = [f"w{k}" for k in range(1300)]
    rows = []
    for k in range(60):  # candidates of one another, but not alike
        other = [f"v{r.randint(0, 10**6)}" if r.random() < 0.05 else w for w in base]
        rows.append((k, " ".join(other)))
    rows += [(100 + k, rows[k % 3][1] + f" x{k}") for k in range(9)]
    sent = []

    def counted(df, original=simhash.checkpoint):
        out = original(df)
        if df.columns == ["a", "b"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(simhash, "checkpoint", counted)
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {**{k: k for k in range(60)}, **{100 + k: k % 3 for k in range(9)}}
    assert sent and max(sent) <= 5 * len(rows)

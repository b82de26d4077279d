"""The pipeline against a plain version of its stages."""

import random

import numpy as np
import pytest

import corpus_pipeline
from hotleaf.llm import packing
from tests.llm import brute
from tests.llm.test_operators import sentence, shingles


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(21)
    items = [(k, sentence(r, 25)) for k in range(3)]
    docs = []
    for k in range(60):
        text = sentence(r, r.randrange(30, 90))
        if k % 7 == 0:
            text += "\nPlease subscribe to our newsletter now\n" + sentence(r, 8)
        if k % 11 == 0:
            text += "\n" + items[k % 3][1] + "\n"
        if k % 13 == 0:
            text = "few words"
        docs.append((k, text, "en", "s", len(text)))
    docs += [(100 + k, docs[k][1], "en", "s", docs[k][4]) for k in range(5)]
    docs += [(200, None, None, None, None), (201, "### $$$ " * 20, "en", "s", 1), (202, docs[8][1].replace("alpha", "alfa", 1), "en", "s", 5)]
    return docs, items


def plain(docs, items):
    rows = [(i, t) for i, t, *_ in docs]
    measures = {i: m for i, *m in brute.op3(rows)}

    def passes(i, t):
        n_words, chars, symbols, dup, repeat = measures[i]
        lines = [x for x in (t or "").split("\n") if x.strip(brute.BLANKS)]
        letters = sum(c.isalpha() for w in (t or "").split() for c in w)
        return not (n_words < 10 or 100 * repeat > 20 * n_words or 10 * symbols > 3 * n_words or len(lines) >= 4 and 100 * dup > 30 * len(lines) or chars < 2 * n_words or chars > 25 * n_words or 2 * letters < chars)

    rows = [(i, t) for i, t in rows if passes(i, t)]
    first = {}
    for i, t in rows:
        for line in t.split("\n"):
            k = brute.line_key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    rows = [(i, "\n".join(x for x in t.split("\n") if len(brute.line_key(x)) < 10 or first[brute.line_key(x)] == i)) for i, t in rows]
    rows = [(i, t) for (i, t), (_, _, c) in zip(rows, brute.op4(rows), strict=True) if c == i]
    rows = [(i, t) for i, t in rows if not any(len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(u)) for _, u in items)]
    return sorted(brute.op5(rows, packing.vocabulary()))


def test_pipeline(spark, tmp_path, corpus):
    docs, items = corpus
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain(docs, items)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out.collect()) == want
    assert 0 < len(want) < len(docs)
    # stage by stage, each written and read again
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == columns, name
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in now.collect()) == want


def test_stages_take_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, chunk int, lang string, `keep` string"
    rows = [(None, None, 1, None, "a"), (1, "", None, None, None), (1, "", 2, "en", "b"), (2, "x " * 3000, 3, "en", None), (None, "some words that are more than ten in all so they can stay", 4, None, None)]
    spark.createDataFrame([(1, "some words that are more than ten in all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for data in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(data, schema), str(tmp_path))
            assert name == "packing" or out.columns == ["doc_id", "text", "chunk", "lang", "keep"]
            out.collect()


def test_rows_are_judged_each_for_itself(spark, tmp_path):
    leak = "these are the words of one item that nobody should ever learn from a text"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    half = leak.split()
    schema = "doc_id long, text string, `meta.url` string, __nth int, __leak int, __key int, rest string"
    rows = [(None, f"before {leak} after"), (None, "a clean text without any id at all"), (7, f"it says {leak}"), (7, "a clean text under the same id"), (None, " ".join(half[:9])), (None, " ".join(half[5:])), (8, "clean")]
    rows = [(i, t, f"u{k}", k, k, k, None) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(x["__nth"] for x in kept.collect()) == [1, 3, 4, 5, 6]
    rows = [(5, "one text that stands here"), (5, "and quite another under its id"), (None, "one text that stands here"), (None, "words of a third text"), (None, "words of a third text")]
    docs = spark.createDataFrame([(i, t, f"u{k}", k, k, k, None) for k, (i, t) in enumerate(rows)], schema)
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(x["text"] for x in kept.collect()) == sorted({t for _, t in rows})
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_near_dedup_against_brute_force_jaccard(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for k in range(25):
        words = [f"w{r.randrange(500)}" for _ in range(r.choice([30, 60, 150]))]
        for _ in range(r.choice([1, 3, 6])):
            rows.append((len(rows), " ".join(words)))
            if r.random() < 0.5:  # copies at all similarities, also chains
                words = list(words)
            for _ in range(r.choice([0, 1, 2, 4])):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
    rows += [(400, rows[3][1]), (2, rows[9][1] + " and other words that are the end"), (None, rows[5][1]), (None, "text of a row without id"), (None, "text of a row without id"), (401, ""), (402, None), (403, "one two"), (404, "one two")]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in out) == sorted(least.values())
    assert set(map(tuple, out)) <= set(rows) and 25 < len(out) < len(rows) - 20


def test_search_of_a_list_joins_all_components():
    from hotleaf.llm.near_copies import joined

    r = random.Random(6)
    base = [r.randrange(1 << 60) for _ in range(100)]
    sets = [np.unique(np.array(base[k : k + 80], np.uint64)) for k in range(0, 21, 4)] + [np.unique(np.array(base[:5] + [r.randrange(1 << 60) for _ in range(75)], np.uint64)) for _ in range(3)]
    found = joined(list(range(9)), list(range(9)), sets)
    assert len(found) == 5 and {x for pair in found for x in pair} == set(range(6))


def test_near_copies_meet_in_lists_of_simhash_bytes():
    from hotleaf.llm import near_copies

    r = np.random.default_rng(7)
    hashes = r.integers(0, 1 << 63, 9, np.uint64)
    mixed = [b"".join(int(near_copies.mix(np.array([h]) * f)[0]).to_bytes(8, "little") for f in near_copies._FACTORS) for h in hashes]
    bits = [[b >> k & 1 for b in x for k in range(7, -1, -1)] for x in mixed]
    want = np.packbits([2 * sum(x) > len(hashes) for x in zip(*bits, strict=True)])
    assert (near_copies.fingerprint(hashes) == want).all()
    for common, size in ((8, 9), (16, 18), (160, 180)):
        for _ in range(40):
            base = r.integers(0, 1 << 63, common, np.uint64)
            a, b = (near_copies.fingerprint(np.concatenate([base, r.integers(0, 1 << 63, size - common, np.uint64)])) for _ in range(2))
            lists = near_copies.postings(np.stack([a, b]))
            assert (lists[0] == lists[1]).any() and len(near_copies.partnered([1, 2], [a.tobytes(), b.tobytes()]).nonzero()[0]) == 2
    others = [near_copies.fingerprint(r.integers(0, 1 << 63, 50, np.uint64)).tobytes() for _ in range(60)]
    assert not near_copies.partnered(list(range(60)), others).any()
    assert len(np.unique(near_copies.postings(np.zeros((1, near_copies.WIDE), np.uint8)))) == len(near_copies.POSITIONS)


def test_postings_of_a_batch_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc

    from hotleaf.llm import near_copies

    marks = np.random.default_rng(8).integers(0, 256, (6000, near_copies.WIDE), np.uint8)
    marks[5999] = marks[0]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(10, 5010), *range(9000, 10000)], pa.int64()), pa.array([x.tobytes() for x in marks], pa.binary())], ["id", "mark"])
    tracemalloc.start()
    sent = pa.Table.from_batches(near_copies._posted(3)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    met = pa.concat_tables([near_copies._lists(None, sent.filter(pc.equal(sent.column("bucket"), k))) for k in range(3)])
    assert met.column("id").to_pylist().count(10) == met.column("id").to_pylist().count(9999) == len(near_copies.POSITIONS)
    # by chance every posting meets 6,000 in 16 million others: about 2,200 postings, of which few differ little beside it
    assert len(met) - 2 * len(near_copies.POSITIONS) < 300


def test_members_of_a_list_that_differ_beside_it_leave():
    from hotleaf.llm import near_copies

    r = np.random.default_rng(9)
    values = np.sort(np.concatenate([r.integers(0, 900, 2000), np.full(700, 1000), np.full(5000, 1001), np.full(300, 1002)])).astype(np.uint64)
    others = r.integers(0, 1 << 16, len(values)).astype(np.uint16)
    others[values == 1000] = r.choice([0, 0xF0F0, 0xFFFF, 0x0F0E], 700)
    others[values == 1002] = 7
    others[-1] = 0xFF00
    want = [bool(((np.bitwise_count(others[values == v] ^ x) <= near_copies.BESIDE).sum() > 1)) for v, x in zip(values, others, strict=True)]
    assert near_copies.meeting(values, others).tolist() == want and 0 < sum(want) < len(want)
    assert not near_copies.meeting(values[:0], others[:0]).any()
    for own, at in zip(near_copies.POSITIONS, near_copies._BESIDE_AT, strict=True):
        assert not set(own) & set(at)

"""Each operator against a plain version, over nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import random

import duckdb
import numpy as np
import pytest

from hotleaf.llm import decontaminate, exchange, graph, language_id, line_dedup, lm_score, packing, quality_rules, shared, simhash_dedup, substring_dedup, suffix_dedup, toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, chunk string, bucket int, body string, rest int"


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["the", "of", "alpha", "beta", "gamma", "Delta", "épsilon", "zeta,", "eta."]) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    base = [sentence(r, r.randrange(5, 90)) for _ in range(12)]
    out = [(k, t) for k, t in enumerate(base)]
    passage, line = sentence(r, 40), "A line that Many documents share"
    for k in range(20, 50):
        words = r.choice(base).split()
        if words:
            words[r.randrange(len(words))] = "changed"
        text = " ".join(words)
        if k % 3 == 0:
            text += "\n" + passage + "\n" + sentence(r, 4)
        if k % 2:
            text += "\n  " + line.upper() + " \t\n" + line
        out.append((k, text))
    long = sentence(r, 3000)
    out += [(60, None), (61, ""), (62, " \t\n\x0b\x0c\r "), (63, long), (64, long[:9000] + " cut " + long[9000:]), (65, "aaaa" * 200), (66, "one"), (67, "one two")]
    out += [(5, base[5]), (70, base[3]), (70, base[3]), (None, base[2]), (None, None), (71, "x\r\nsame line here\r\nsame line here"), (72, "日本語 " * 30), (73, "\n\n\n")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, "b", 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_suffix_dedup(docs, rows, none):
    out = suffix_dedup.dedup_substrings(docs)
    same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute.op1(rows))
    for row in out.where("n_removed > 0").collect():
        assert sum(s["length"] for s in row["spans"]) == row["n_removed"] == row["n_bytes"] - len(row["kept"])
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_suffix_dedup_with_other_lengths(docs, rows):
    got = suffix_dedup.dedup_substrings(docs, length=40, gram=20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(got.collect(), brute.op1(rows, 40))
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(docs, length=150, gram=50)


def test_suffix_dedup_tells_confused_bytes_apart(spark):
    """Two strings of 50 bytes with one identifier, in the middle of the same bytes; copies beside them still go."""
    one, other = "rpujecfsxgdqegrhgrbwdullmakrziabtqwhnkkydgugskzqpy", "bqnnayycmufsyzapvwtfjttqlabzlbsdvtxqlqllqdhcmniazn"
    ids = [exchange.Rolling(exchange.BYTE_VALUES[np.frombuffer(x.encode(), np.uint8)]).grams(50)[0] for x in (one, other)]
    assert one != other and ids[0] == ids[1]
    r, rows = random.Random(3), []
    for k in range(0, 60, 3):
        before, after = ("".join(r.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
        rows += [(k, before + one + after), (k + 1, before + other + after)]
        if k % 4 == 0:
            rows.append((k + 2, "x" + before + other + after))
    want = brute.op1(rows)
    assert {x[2] > 0 for x in want} == {True, False}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"chunk_bytes": 700, "bucket_bytes": 500}):
        got = suffix_dedup.dedup_substrings(docs, **sizes)
        same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), want)


def test_passage_dedup(docs, rows, none):
    out = substring_dedup.dedup_passages(docs)
    same(out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.op7(rows))
    assert substring_dedup.dedup_passages(none).count() == 0


def test_line_dedup(docs, rows, none):
    out = line_dedup.drop_repeated_lines(docs, with_text=True, carry=["chunk", "rest"]).collect()
    same([(x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in out], brute.op6(rows))
    texts = {i: t for i, t in rows if t is not None and i not in (5, 70, None)}
    for x in out:
        if x["doc_id"] in texts:
            lines = texts[x["doc_id"]].split("\n")
            kept = [line for line, keep in zip(lines, line_dedup.keep_mask(x["keep_bitmap"], x["n_lines"]), strict=True) if keep]
            assert "\n".join(kept) == x["text"] and x["rest"]["rest"] == 2
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_simhash(docs, rows, none):
    got = simhash_dedup.simhash_components(docs).select("doc_id", "fingerprint", "component_id")
    same(got.collect(), brute.op4(rows))
    assert simhash_dedup.simhash_components(none).count() == 0


def test_posting_search_loses_no_link():
    r = random.Random(3)
    marks = {r.getrandbits(64)}
    for _ in range(300):
        m = r.choice(sorted(marks))
        for _ in range(r.randrange(1, 5)):
            m ^= 1 << r.randrange(64)
        marks.add(m)
    marks = sorted(marks)
    found = set()
    for mask in simhash_dedup.POSTINGS:
        lists = {}
        for m in marks:
            lists.setdefault(m & mask, []).append(m)
        for list_ in lists.values():
            members, roots = simhash_dedup._links(np.array(list_, np.uint64), 3)
            found |= {tuple(sorted((int(a) % 2**64, int(b) % 2**64))) for a, b in zip(np.concatenate(members), np.concatenate(roots), strict=True)} if members else set()

    def classes(pairs):
        root = {m: m for m in marks}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for m in marks:
            groups.setdefault(find(m), set()).add(m)
        return sorted(map(sorted, groups.values()))

    assert classes(found) == classes([(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 3])


def test_components_of_chains_and_stars(spark):
    pairs = [(k + 1, k) for k in range(40)] + [(k, 100) for k in range(101, 150)] + [(201, 200), (203, 202), (203, 201)]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 150)} | {k: 200 for k in range(201, 204)}


def test_packing(docs, rows, none):
    file = packing.vocabulary()
    out = packing.pack_pieces(packing.pieces(docs)).collect()
    same([(x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out], brute.op5(rows, file))
    bins = {}
    for x in out:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(x["length"] for x in out) // 4096) + 1
    assert packing.pack_pieces(packing.pieces(none)).count() == 0


def test_packing_numbers_bins_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        rows = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 2 = 0, 4096L, 2000L) AS length", "id AS ids_crc32")
        out = packing.pack_pieces(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ends: dict = {}
    for x in sorted(out, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert len(out) == 400 and max(ends.values()) <= packing.CAPACITY


def test_pieces_carry_their_ids(docs):
    for x in packing.pieces(docs, capacity=100, with_ids=True).collect():
        assert len(x["ids"]) == x["length"] <= 100


@pytest.mark.parametrize("sizes", [[7] * 50, [60, 60, 60, 40, 40, 40], [100], list(range(1, 101)), [51] * 9])
def test_best_fit(sizes):
    bins, offsets = packing.best_fit(np.array(sizes), 100)
    used = {}
    for b, o, s in sorted(zip(bins, offsets, sizes, strict=True)):
        assert used.get(b, 0) == o
        used[b] = o + s
    assert max(used.values()) <= 100 and len(used) <= 1.25 * max(1, sum(sizes) / 100) + (51 in sizes) * 5


def test_words_are_encoded_as_the_tokenizer_does():
    r = random.Random(9)
    known = packing.WordIds(packing.vocabulary())
    odd = ["don't", "I'LL", "ÉTÉ", "<|endoftext|>", "a<|startoftext|>b", "ﬁ", "İI", "Σς", "日本語", "x­", "é", "½²", "12ab34", "'Ve--'re", "\x7f", "\x00a", "a b"]
    odd += ["".join(chr(r.choice([*range(33, 127), *range(161, 384)])) for _ in range(r.randrange(1, 8))) for _ in range(3000)]
    for word in odd:
        assert list(np.frombuffer(known.encode(word.encode()), "<u4")) == known.tokenizer.encode(word, add_special_tokens=False).ids, word


def test_quality_rules(docs, rows, none):
    out = quality_rules.ledger(docs, carry=docs.columns)
    names = ["keep.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    same(out.select(*names).collect(), brute.op3(rows))
    passed = out.where(quality_rules.passes("v1")).select("keep.*")
    assert passed.columns == docs.columns
    assert passed.count() == sum(r["failed_bits"] == 0 for r in out.collect())
    counts = {r["rule"]: (r["n_failed"], r["n_only_failed"]) for r in quality_rules.ablation(out, "v1").collect()}
    bits = [r["failed_bits"] for r in out.collect()]
    for rule in quality_rules.RULES:
        assert counts[rule.name] == (sum(b >> rule.bit & 1 for b in bits), sum(b == 1 << rule.bit for b in bits))
    assert quality_rules.ledger(none).count() == 0


def test_quality_plan_has_no_python(docs):
    plan = quality_rules.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingles(text, n=5):
    import regex

    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    return {" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def test_decontamination(spark, docs, rows, none):
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[3 : 3 + n])) for k, (t, n) in enumerate(zip(texts, (5, 6, 9, 14, 20, 25), strict=False))]
    items += [(90, None), (91, ""), (92, "one two"), (93, texts[0].upper()[:90] + " and quite some other words at the end of it"), (94, items[0][1]), (None, items[1][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(docs, table).collect()
    want = set()
    for i, t in rows:
        for j, u in items:
            a, b = shingles(t), shingles(u)
            if b and len(a & b) >= 0.8 * len(b):
                want.add((i, j, len(b), len(a & b)))
    assert {tuple(x)[:4] for x in got} == want and len(got) == len(want)
    assert decontaminate.contained_items(none, table).count() == 0
    assert decontaminate.contained_items(docs, table.limit(0)).count() == 0


def test_sketches_find_block_by_block(spark, docs, monkeypatch):
    items = docs.selectExpr("doc_id AS item_id", "substring(text, 1, 150) AS text").where("doc_id IS NOT NULL").dropDuplicates(["item_id"])
    want = sorted(map(tuple, decontaminate.contained_items(docs, items).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 50)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontaminate.contained_items(docs, items).collect()), key=str) == want and want


def test_candidates_come_from_kept_hashes(spark):
    words = [f"w{k}" for k in range(24)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    kept = decontaminate.item_sketches(items).first()
    assert kept["n_shingles"] == 20 and len(kept["kept"]) == 32 - 26 + 1
    docs = [(1, " ".join(words[:9])), (2, " ".join(words[9:])), (3, " ".join(words[2:])), (None, " ".join(words[:14])), (None, " ".join(words[10:]))]
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert [(x["doc_id"], x["n_common"]) for x in got] == [(3, 18)]


def test_language_id(spark, none):
    r = random.Random(1)
    stock = {"aa": ["la", "le", "que", "vous", "étoile"], "bb": ["der", "die", "und", "straße", "über"]}
    rows = [(k, " ".join(r.choice(stock[lang]) for _ in range(12)), lang) for k in range(200) for lang in [r.choice(["aa", "bb"])]]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "123 !?", "aa"), (303, "der über", None), (None, "la le", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where(language_id.fold("doc_id", 3) != 1))
    got = {x["doc_id"]: x for x in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 303, None)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.train(docs.limit(0))[0] == []
    assert language_id.predict(docs, language_id.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, model).count() == 0


def test_language_counts_equal_plain_ones(spark):
    rows = [("añb", "x"), ("b a", "y"), ("", "x"), ("añ", "x")]
    langs, matrix = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["x", "y"]
    grams = {lang: sum(max(0, len(t) - n + 1) for t, x in rows if x == lang for n in (1, 2, 3)) for lang in langs}
    counts = np.exp(matrix[:-1])
    for k, lang in enumerate(langs):
        total = grams[lang] + 0.5 * language_id.SIZE
        assert np.isclose((counts[:, k] * total - 0.5).sum(), grams[lang], atol=1e-2)


def test_language_predictions_equal_plain_bayes(spark):
    """Multinomial naive Bayes over the same hash slots, one text at a time."""
    r = random.Random(8)
    stock = {"aa": "la le que étoile vous", "bb": "der die straße über und", "cc": "the of and with his"}
    rows = [(k, " ".join(r.choice(stock[lang].split()) for _ in range(r.randrange(1, 9))), lang) for k in range(150) for lang in [r.choice(sorted(stock))]]
    rows += [(200, "la der the", None), (201, "...", "aa"), (202, "Straße LA", None)]

    def slots(text):
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        return [int(x) for g in language_id._grams(points, np.array([0, len(points)])) for x in g if x < language_id.SIZE] if len(points) else []

    counts, docs_of = {}, {}
    for _, text, lang in rows:
        if lang:
            own = counts.setdefault(lang, np.full(language_id.SIZE, 0.5))
            np.add.at(own, slots(text), 1)
            docs_of[lang] = docs_of.get(lang, 0) + 1
    want = {}
    for i, text, _ in rows:
        sums = {x: np.log(docs_of[x] / sum(docs_of.values())) + sum(np.log(c[k] / c.sum()) for k in slots(text)) for x, c in counts.items()}
        want[i] = max(sorted(sums), key=sums.get) if any(c.isalpha() for c in text) else "und"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.predict(docs, language_id.train(docs)).collect()}
    assert got == want


def test_toxicity(spark, none):
    r = random.Random(2)
    plain = ["river", "stone", "window", "garden", "letter", "music", "bread", "road", "winter", "paper", "silver", "morning"]
    rude = ["vilescum", "vilesque", "vilest", "dreckig", "drecksau"]
    rows, labels = [], []
    for k in range(900):
        bad = r.random() < 0.25
        words = [r.choice(plain) + r.choice(["", "s", "ing", "ed"]) for _ in range(r.randrange(20, 80))]
        for _ in range(4 * bad):
            words[r.randrange(len(words))] = r.choice(rude)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, ""), (None, "river")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (2000, 1), (None, 1), (5, None), (7, labels[7][1])], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, y in labels)
    assert right >= 0.95 * len(labels) and all(0 <= s <= 1 for s in got.values())
    assert got[2000] == got[2001] < 0.5
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, table.limit(0))).where("score > 1e-6").count() == 0


def test_lm_score(docs, rows, none):
    out = lm_score.score_texts(docs).collect()
    same([(*tuple(x)[:5], round(x["base_score"], 6)) for x in out], brute.op2(rows))
    assert all(x["score"] < 0 and x["bits_per_byte"] > 0 for x in out)
    assert lm_score.score_texts(none).count() == 0


def test_lm_score_over_many_chunks_whatever_the_partitions(spark, docs, rows):
    sizes = {"chunk_bytes": 4000, "bucket_bytes": 3000}
    first = lm_score.score_texts(docs, **sizes).collect()
    same([(*tuple(x)[:5], round(x["base_score"], 6)) for x in first], brute.op2(rows))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        same(lm_score.score_texts(docs.repartition(7), **sizes).collect(), first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lm_score_cuts_a_chunk_into_words_once_and_mixes_its_texts_together(monkeypatch):
    import pyarrow as pa

    d = exchange.Docs(pa.table({"doc_id": pa.array(range(1500), pa.int64()), "text": [f"a b{k} a c" for k in range(1500)]}))
    _, ids, _, _, doc = lm_score._tokens(d)
    monkeypatch.setattr(lm_score, "_tokens", None)
    ids, doc, last, second = lm_score._in_order(ids, doc)
    assert doc.tolist() == sorted(doc) and (last[5:10] == [0, *ids[5:9]]).all() and (second[5:10] == [0, 0, *ids[5:8]]).all()
    counts = [np.bincount(c << deep | (ids >> np.uint64(64 - deep)).astype(np.int64), minlength=1 << wide + deep) for c, (wide, deep) in zip(lm_score._around(doc % lm_score.KINDS, last, second), lm_score.AROUND, strict=True)]
    around = lm_score.Around.of(counts, lm_score._START, np.full(lm_score.KINDS, 0.1), np.bincount(doc % lm_score.KINDS))
    costs, mixed, calls = np.random.default_rng(3).integers(500, 5000, (lm_score.KINDS, len(ids))), lm_score.Around._mixed, []
    monkeypatch.setattr(lm_score.Around, "_mixed", lambda *a: calls.append(1) or mixed(*a))
    gains = around.gains(ids, doc, last, second, costs, np.ones(len(ids), bool), d.n)
    assert len(calls) == 1
    monkeypatch.setattr(lm_score, "_TEXTS", 7)
    assert np.allclose(around.gains(ids, doc, last, second, costs, np.ones(len(ids), bool), d.n), gains, 1e-4, 1e-4) and len(calls) > 200


def _vocabulary(r: random.Random, n: int) -> lm_score.Vocabulary:
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(n)})
    body = np.frombuffer("".join(words).encode(), np.uint8)
    sizes = np.array([len(w) for w in words], np.uint32)
    counts = np.array([[r.randrange(4) * r.randrange(3) for _ in range(lm_score.KINDS)] for _ in words], np.int64)
    return lm_score.Vocabulary(np.array(sorted(r.getrandbits(64) for _ in words), np.uint64), sizes, body, counts)


def test_lm_probabilities_of_known_words_sum_to_one():
    v = _vocabulary(random.Random(4), 300)
    known = np.flatnonzero(v.counts.sum(1))
    weights, mass = lm_score._refine_known(v.keys[known], v.counts[known], 0)
    assert mass.sum() > 0 and np.isfinite(weights).all()
    costs = lm_score.known_costs(v.keys[known], v.counts[known], range(0, 64), weights)
    assert np.allclose(np.exp(costs).sum(0), 1)
    # cut at a depth, the beginnings' shares and the rest multiply to the same
    top = np.unique(v.keys[known] >> np.uint64(62), return_inverse=True)
    totals = np.stack([np.bincount(top[1], v.counts[known, k]) for k in range(lm_score.KINDS)], 1).astype(np.int64)
    shares = lm_score.known_costs(top[0] << np.uint64(62), totals, range(0, 2), weights)
    rest = np.concatenate([lm_score.known_costs(v.keys[known][top[1] == t], v.counts[known][top[1] == t], range(2, 64), weights) for t in range(len(top[0]))])
    assert np.allclose(shares[top[1]] + rest, costs)


def test_lm_spelling_sums_to_one_over_bits():
    v = _vocabulary(random.Random(4), 200)
    kinds = np.ones(lm_score.KINDS)
    flat = lm_score.Model(np.zeros((lm_score.MODELS, 1 << lm_score.BITS), np.float32), np.zeros(1 << lm_score.BITS, np.uint8), np.full((lm_score.GATES, lm_score.MODELS), 0.3, np.float32), lm_score._START, kinds, kinds, np.zeros((1, lm_score.KINDS)), 1, 0)
    assert np.allclose(flat.word_bits(v), -8 * (v.sizes + 1.0) * np.log(2))


def test_lm_words_of_the_running_text_sum_to_one(monkeypatch):
    r = random.Random(8)
    ids = np.array(sorted(r.getrandbits(64) for _ in range(60)), np.uint64)
    text = np.array([r.randrange(60) if r.random() < 0.3 else 3 * (k % 20) for k in range(2000)])
    doc, kind = np.arange(2000) // 50, np.arange(2000) // 50 % lm_score.KINDS
    last = np.where(np.arange(2000) % 50 > 0, np.roll(ids[text], 1), np.uint64(0))
    second = np.where(np.arange(2000) % 50 > 1, np.roll(ids[text], 2), np.uint64(0))
    counts = [np.bincount(c << deep | (ids[text] >> np.uint64(64 - deep)).astype(np.int64), minlength=1 << wide + deep) for c, (wide, deep) in zip(lm_score._around(kind, last, second), lm_score.AROUND, strict=True)]
    by_kind = np.stack([np.bincount(text[kind == k], minlength=60) for k in range(lm_score.KINDS)], 1).astype(np.int64)
    tokens, unseen = by_kind.sum(0), np.full(lm_score.KINDS, 0.1)
    around = lm_score.Around.of(counts, lm_score._START, unseen, tokens)
    costs = np.ceil((lm_score.known_costs(ids, by_kind, range(0, 64), lm_score._START) + np.log(0.9)) * -lm_score.UNIT).astype(np.int64)

    def logs(texts):
        """Natural log of the probability of each text, all of the same length."""
        flat = np.concatenate(texts)
        n, m = len(texts), len(texts[0])
        at, words = np.arange(len(flat)) % m, ids[flat]
        before = [np.where(at >= k, np.roll(words, k), np.uint64(0)) for k in (1, 2)]
        gains = around.gains(words, np.repeat(np.arange(n), m), *before, costs[flat].T, np.ones(len(flat), bool), n)
        return gains + np.logaddexp.reduce(np.log(around.prior) - costs[flat].reshape(n, m, -1).sum(1) / lm_score.UNIT, axis=1)

    for past in (text[:2], text[5:45], text[5:205]):
        total = np.exp(logs([[*past, x] for x in range(60)]) - logs([past])[0]).sum()
        assert 0.97 * 0.9 < total <= 0.9 + 1e-9
    texts = [text[k : k + 30] for k in range(7)]
    whole = logs(texts)
    monkeypatch.setattr(lm_score, "_TEXTS", 3)
    assert (logs(texts) == whole).all()


def test_lm_score_heeds_the_order_of_words(spark):
    # one kind of text throughout, so that nothing but the words before tells these two apart
    r = random.Random(9)
    cycle = [f"w{k}" for k in range(12)]
    shuffled = r.sample(cycle * 4, 48)
    rows = [(k, " ".join(cycle * 5)) for k in range(30)] + [(100, " ".join(cycle * 4)), (101, " ".join(shuffled))]
    got = {x["doc_id"]: x for x in lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[100]["base_score"] - got[101]["base_score"]) < 1e-9
    assert got[100]["score"] > got[101]["score"] + 5


def thue_morse() -> tuple[str, str]:
    """Two words that every polynomial hash modulo 2**64 takes for one."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_are_told_apart(spark):
    a, b = thue_morse()
    tail = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{a} {tail}"), (3, f"{b} {tail}"), (4, f"{b} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(substring_dedup.dedup_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.op7(rows))
    same([(*tuple(x)[:5], round(x["base_score"], 6)) for x in lm_score.score_texts(docs).collect()], brute.op2(rows))


def test_exchange_over_many_chunks_and_buckets(docs, rows):
    sizes = {"chunk_bytes": 2000, "bucket_bytes": 1500}
    same(suffix_dedup.dedup_substrings(docs, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute.op1(rows))
    same(substring_dedup.dedup_passages(docs, **sizes).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.op7(rows))


def test_line_dedup_over_many_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(exchange.Deal.__init__, "__defaults__", ("doc_id", "text", None, 2000, 1500, False))
    same(line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect(), brute.op6(rows))


def test_passages_are_verified_at_their_source(spark, docs, rows, monkeypatch):
    """With identifiers that confuse most words nothing is cut that the words don't bear out."""
    weak = lambda buf, lo, hi: exchange.mix((hi - lo).astype(np.uint64) % np.uint64(3))
    monkeypatch.setattr(exchange, "word_ids", weak)
    right = {(x[0], x[1], x[3]): x[2] for x in brute.op7(rows)}
    want = {}
    for i, n, removed, _ in brute.op7(rows):
        want.setdefault((i is None, i or 0, n), []).append(removed)
    for x in substring_dedup.dedup_passages(docs).collect():
        assert x["n_removed"] <= max(want[x["doc_id"] is None, x["doc_id"] or 0, x["n_words"]])
    assert right


def test_packing_in_tiny_groups(spark):
    rows = spark.range(0, 3000, 1, 7).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1 + id * 7919 % 3000 AS length", "id AS ids_crc32")
    out = packing.pack_pieces(rows, group_items=20).collect()
    ends: dict = {}
    for x in sorted(out, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert len(out) == 3000 and max(ends.values()) <= packing.CAPACITY
    assert len(ends) <= 1.02 * sum(ends.values()) / packing.CAPACITY + 1


@pytest.mark.parametrize(("name", "sql"), [("op3_quality_rules", quality_rules.OP3_SQL), ("op6_line_dedup", line_dedup.OP6_SQL), ("op8_decontaminate", decontaminate.OP8_SQL)])
def test_sql_on_awkward_rows(spark, tmp_path, rows, name, sql):
    from hotleaf.llm.queries import QUERIES

    own = [(i, t) for i, t in rows if i is not None and i not in (5, 70)]
    spark.createDataFrame(own, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(k, t[:120]) for k, t in own if t and len(t) > 200][:8]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(sql)
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(want.columns) == sorted(got.columns)
    same(got.select(*want.columns).collect(), want.fetchall())


def test_toxic_dictionary_of_stretches():
    """The toxic dictionary is trained on telling stretches, and two words of it are evidence whichever they are."""
    r, insults, rows = random.Random(5), ["stupid", "moron", "pathetic", "clown", "worthless"], []
    for _ in range(600):
        words = [r.choice(["ar", "bel", "cor", "dun", "el", "for"]) + r.choice(["ia", "on", "um", "as"]) + str(r.randrange(900)) for _ in range(30)]
        bad = r.random() < 0.3
        for _ in range(3 * bad):
            words[r.randrange(30)] = r.choice(insults)
        rows.append((" ".join(words).encode(), int(bad)))
    assert toxicity.toxic_stretches(b"You 'Stupid! fool, moronic", [b"stupid", b"moron"]) == b" stupid moron "
    assert toxicity.toxic_stretches(b"", [b"a"]) == toxicity.toxic_stretches(b"plain words", [b"stupid"]) == b""
    model = toxicity.fit(rows)
    assert all(w.encode() in model.toxic for w in insults)
    features = model.scorer()
    score = lambda t: float(model.probability(features(t.encode())))
    assert min(score(f"aria1 belon2 corum3 {a} dunas4 {b} elia5") for a in insults for b in insults if a != b) > 0.5
    assert max(score(t) for t in ("", "aria1 belon2 corum3", "word " * 3000)) < 0.5

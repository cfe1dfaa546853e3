"""Results against plain Python, and names and texts that trip hashes."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import op2_toxicity, op3_token_counts, op4_warc_store, op5_jaccard_join, op6_language_id, op7_quality_rules, op8_byte_bpe, op9_media, op10_line_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def thue_morse(n=2048):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_complements_differ():
    one = thue_morse()
    two = one.translate({97: 98, 98: 97})
    assert op7_quality_rules.text_statistics(pa.array([f"{one}\n{two}"]))[0, 3] == 0
    data = np.frombuffer((one + two).encode(), np.uint8)
    a, b = op5_jaccard_join.shingles(data, np.array([0, 2048, 4096]))
    assert a.tolist() != b.tolist()


def test_pairs_stay_apart_as_merges_say():
    import public_tokenizers as P

    merges = op8_byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).merges
    rng = np.random.default_rng(3)
    whole = rng.choice(len(merges.tokens), 3000)
    for x, k in zip(whole, rng.integers(1, 9, 3000), strict=True):
        a, b = merges.ranks.get(merges.tokens[x][:k]), merges.ranks.get(merges.tokens[x][k:])
        if a is not None and b is not None:
            assert merges._stay_apart(a, b) == (op8_byte_bpe.plain_merges(merges.tokens[x], merges.ranks) == [merges.tokens[a], merges.tokens[b]])


def test_near_duplicates_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, holders = {}, {}
    for r in docs.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for x in sets[r.doc_id]:
            holders.setdefault(x, []).append(r.doc_id)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for x in holders.values() for a in x for b in x if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {tuple(r) for r in op5_jaccard_join.near_duplicates(docs).collect()} == {(i, len(s), find(i)) for i, s in sets.items()}


def test_toxicity_scores(spark):
    texts = [f"word{i} fine text {'idiot moron' if i % 3 == 0 else 'good day'} A{i}" for i in range(150)] + ["", "abc", "ID"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = op2_toxicity.train(docs, labels)
    for r in op2_toxicity.score(docs, model).collect():
        data = texts[r.doc_id].lower().encode()
        buckets = {int(op2_toxicity.grams(np.frombuffer(data[k : k + n], np.uint8), n)[0]) for n in op2_toxicity.ORDERS for k in range(len(data) - n + 1)}
        margin = model.intercept + sum(model.weights[model.slot[x]] for x in buckets if model.slot[x] >= 0)
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9


def test_language_posteriors(spark):
    known = [(i, ("the cat and this house " if i % 2 else "der hund und dieses haus ") * 3, "en" if i % 2 else "de") for i in range(40)]
    model = op6_language_id.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    rows = [(0, "the cat", "a.x.org"), (1, "der hund", "a.x.org"), (2, "dieses haus", "b.x.org"), (3, "the", None), (4, "12", "b.x.org"), (5, None, "c.de")]
    judged = op6_language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, host string"), model, host=F.col("host")).collect()
    logs, has = op6_language_id.likelihoods(model, pa.array([t for _, t, _ in rows]))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    own = [soft(x) for x in logs]
    domain = [None if h is None else ".".join(h.split(".")[-2:]) for *_, h in rows]
    smooth = lambda c, p: (c + 10 * p) / (c.sum() + 10)
    for r in judged:
        i = r.doc_id
        others = [k for k in range(len(rows)) if k != i]
        total = lambda ks: sum((own[k] for k in ks), np.zeros(2))
        prior = smooth(total(others), np.array([0.5, 0.5]))
        prior = smooth(total(k for k in others if domain[k] == domain[i]), prior)
        prior = smooth(total(k for k in others if rows[k][2] == rows[i][2]), prior)
        fused = soft(logs[i] + np.log(prior))
        assert abs(r.confidence - fused.max()) < 1e-9 and r.language == model.languages[int(fused.argmax())]
        assert r.kept == bool(has[i] and fused.max() >= 0.6)


def test_many_languages(spark):
    rows = [(i, f"{chr(97 + i // 5 % 26)}{chr(97 + i // 130)}word " * 9, f"l{i // 5:02}") for i in range(350)]
    assert len(op6_language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 70


def test_clashing_names(spark):
    names = ["doc_id", "text", "lang", "source", "_site", "_text", "a.b", "Kept", "_found", "_host", "_lines"]
    docs = spark.createDataFrame([(i, "the cat and this house " * 3, "en", "s", *"1234567") for i in range(9)], names)
    cleaned = op10_line_dedup.without_boilerplate(docs, "source")
    assert cleaned.columns == [*names[:-1], "_lines", "_dropped"] and cleaned.count() == 9
    judged = op6_language_id.identify(docs, op6_language_id.train(docs), host=F.col("source"))
    assert judged.columns == [*(x for x in names if x != "Kept"), "language", "confidence", "kept"]
    assert {(r["a.b"], r._host) for r in judged.collect()} == {("3", "6")}
    for found in (op3_token_counts.token_counts(docs), op8_byte_bpe.encoding_digests(docs), op5_jaccard_join.near_duplicates(docs)):
        assert found.count() == 9


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    found = [op2_toxicity.score(docs, op2_toxicity.train(docs, labels)), op3_token_counts.token_counts(docs), op7_quality_rules.judge(docs, op7_quality_rules.train(docs, labels)), op8_byte_bpe.encode_documents(docs), op9_media.read_media(op9_media.store_media(docs))]
    op4_warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path))
    assert [x.count() for x in [*found, op4_warc_store.read_index(spark, str(tmp_path))]] == [0] * 6

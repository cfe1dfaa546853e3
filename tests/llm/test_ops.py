"""Each operator against brute force, and its defined results for nulls, empty and repeated rows, empty tables and clashing names."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import quern.llm as llm
from quern.llm import _jpeg, _store, op1_mixture, op2_toxicity, op3_token_counts, op4_warc_store, op5_jaccard_join, op6_language_id, op7_quality_rules, op8_byte_bpe, op9_media, op10_line_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens long, size long, label int, start long, bucket long"
LONG = "lorem ipsum " * 20000


def rows(*texts, source="s"):
    return [(i, t, "en", source, 7, 7, 7, 7, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, a repeated row, clashing column names."""
    data = [*rows("a b c d e f g", "", None, "  \n\t", LONG, "one two", "é ü 中文\nline\nline", "x" * 3000), (None, "lost key", None, None, *[None] * 5)]
    return spark.createDataFrame([*data, data[0]], SCHEMA)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_duckdb(name, same):
    same(llm.queries()[name], llm.oracle_sql()[name])


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = op8_byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return Tokenizer.from_file(P.path("word_bpe_49k.json")), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.one_of(st.text(), st.text("ab é\n\t '1st"), st.lists(st.sampled_from(["the ", "  ", "\n", "don't", "İ", "Σ", "<|endoftext|>", "12", "🙂", " x"])).map("".join))


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_tokenizers_agree(libraries, text):
    words, byte_level = libraries
    assert op3_token_counts.counter(P.path("word_bpe_49k.json"))(text) == len(words.encode(text, add_special_tokens=False).ids)
    coder = op8_byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert coder.encode(text) == byte_level.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


def test_token_queries(odd, libraries):
    found = {(r.doc_id, r.n_bytes): r for r in op3_token_counts.token_counts(odd).collect()}
    assert found[(2, 0)].n_tokens == 0 and not found[(2, 0)].over_limit
    assert found[(4, len(LONG))].n_tokens == len(libraries[0].encode(LONG, add_special_tokens=False).ids) and found[(4, len(LONG))].over_limit
    coded = op8_byte_bpe.encoding_digests(odd).collect()
    assert len(coded) == 10
    ids = libraries[1].encode_ordinary(LONG)
    assert next(r for r in coded if r.doc_id == 4).ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = op8_byte_bpe.decode_ids(op8_byte_bpe.encode_texts(odd)).collect()
    assert {bytes(r.data) for r in back} == {(r.text or "").encode() for r in odd.collect()}


def test_mixture(spark, odd):
    mixed = op1_mixture.curriculum(odd).collect()
    assert len(mixed) == odd.count()
    assert all(0 <= r.taken <= 2 * r.size for r in mixed)
    docs = spark.createDataFrame([(i, "w " * (i % 9), "en", f"s{i % 3 if i > 60 else 0}", *[None] * 5) for i in range(200)], SCHEMA)
    out = op1_mixture.curriculum(docs).collect()
    targets, taken = {}, {}
    for r in out:
        targets[r.source_size] = r.target
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[k] - targets[k]) <= 1 for k in targets)
    assert abs(sum(targets.values()) - 1.5 * sum(targets)) < 1e-6
    order = [r.position for r in out if r.position is not None]
    assert order == sorted(order)
    assert [tuple(r) for r in op1_mixture.curriculum(docs.repartition(7)).collect()] == [tuple(r) for r in out]
    knots = ((0.0, 0.0), (0.3, 2.0), (1.0, 0.5))
    pieces = op1_mixture.integrated(knots)
    at = spark.range(11).select((op1_mixture.F.col("id") / 10).alias("u")).select("u", op1_mixture.inverted(pieces, op1_mixture.F.col("u")).alias("t")).collect()
    grid = np.linspace(0, 1, 100001)
    total = np.concatenate([[0], np.cumsum((np.interp(grid, *zip(*knots))[1:] + np.interp(grid, *zip(*knots))[:-1]) / 2)])
    assert all(abs(np.interp(r.t, grid, total / total[-1]) - r.u) < 1e-6 for r in at)


def test_toxicity(spark, odd):
    texts = [f"word{i} fine text here {'idiot moron' if i % 4 == 0 else 'good day'} more{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = op2_toxicity.train(docs, labels)
    scored = {r.doc_id: r.score for r in op2_toxicity.score(docs, model).collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((scored[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert all(0 <= r.score <= 1 for r in op2_toxicity.score(odd, model).collect())
    none = op2_toxicity.train(docs, labels.limit(0))
    assert {r.score for r in op2_toxicity.score(odd, none).collect()} == {0.5}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "é"), (2, None, "same")], "page_id long, url string, html string")
    op4_warc_store.write_archive(pages, str(tmp_path / "w"))
    index = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in op4_warc_store.read_index(spark, str(tmp_path / "w")).collect()}
    assert index == {(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "response", None, 2)}
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    for r in op4_warc_store.read_records(spark, str(tmp_path / "w")).collect():
        record, payload = bytes(r.record), bytes(r.payload)
        head, body = record.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body[length:] == b"\r\n\r\n"
        assert base64.b32encode(hashlib.sha1(payload).digest()) in head
        assert (b"Type: response" in head) == body[:length].endswith(b"\r\n\r\n" + payload) or not payload


def test_warc_index_reads_records(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "one\r\n\r\ntwo"), (2, "u", "WARC-Refers-To: <urn:page:7>\r\n")], "page_id long, url string, html string")
    op4_warc_store.write_archive(pages, str(tmp_path / "w"))
    found = op4_warc_store.read_index(spark, str(tmp_path / "w")).collect()
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found} == {(1, "response", None, 10), (2, "response", None, 30)}
    whole = op4_warc_store.read_records
    monkeypatch.setattr(op4_warc_store, "read_records", lambda *a: whole(*a).limit(1))
    assert op4_warc_store.read_index(spark, str(tmp_path / "w")).count() == 1


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(spark, odd, monkeypatch):
    rng = np.random.default_rng(5)
    docs = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            copy = [f"e{rng.integers(1000)}" if rng.random() < 0.015 else w for w in base]
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", None, "A b", "a B", "one"])]
    frame = spark.createDataFrame([(i, t, *[None] * 7) for i, t in docs], SCHEMA)
    expected = brute_components(docs)
    assert len({c for _, _, c in expected}) < len(docs)
    assert {tuple(r) for r in op5_jaccard_join.near_duplicates(frame).collect()} == expected
    monkeypatch.setattr(op5_jaccard_join, "BLOCK", 4)  # groups over several blocks
    assert {tuple(r) for r in op5_jaccard_join.near_duplicates(frame).collect()} == expected
    monkeypatch.undo()
    found = op5_jaccard_join.near_duplicates(odd).collect()
    assert len(found) == 10 and {(r.doc_id, r.component_id) for r in found if r.n_shingles == 0} == {(1, 1), (2, 2), (3, 3)}
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert op5_jaccard_join.near_duplicates(odd.limit(0)).count() == 0


def test_language(spark, odd):
    known = [(i, ("the cat and this house of that " if i % 2 else "der hund und dieses haus ist nicht ") * 3, "en" if i % 2 else "de", *[None] * 6) for i in range(40)]
    model = op6_language_id.train(spark.createDataFrame(known, SCHEMA))
    assert model.languages == ["de", "en"]
    texts = [(0, "http://x.de/", '<html lang="de"><p>the the'), (1, "http://y.example.com/a", "<p>this house of the cat"), (2, "http://z.fr/", "<p>123"), (3, None, None)]
    pages = spark.createDataFrame(texts, "page_id long, url string, html string")
    found = {r.page_id: r for r in op6_language_id.identify_pages(pages, model).collect()}
    assert found[1].language == "en" and found[1].kept and not found[2].kept and not found[3].kept
    judged = op6_language_id.identify(odd, model, host=op6_language_id.F.col("source")).collect()
    assert len(judged) == 10 and all(not r.kept for r in judged if not (r.text or "").strip())
    blank = op6_language_id.identify(odd, op6_language_id.train(odd.limit(0)))
    assert {(r.language, r.kept) for r in blank.collect()} == {(None, False)}


def brute_counts(text):
    w, windows, seen, repeats = WORD.findall(text), {}, set(), 0
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeats, len(cover)]


@given(st.lists(st.lists(st.sampled_from(["a", "bb", "é", " ", "\n", "\n", "#", "a b c d e f g h ", "\x0b"])).map("".join), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_statistics(texts):
    assert op7_quality_rules.text_statistics(pa.array(texts))[:, :5].tolist() == [brute_counts(t) for t in texts]


def test_quality(spark, odd):
    good = [f"plain words number {i} " * 3 + " ".join(f"w{i}x{k}" for k in range(40)) for i in range(60)]
    bad = [" ".join(f"w{i}y{k}###" for k in range(40)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(good + bad)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    trees = op7_quality_rules.train(docs, labels)
    assert all(r.kept == (r.doc_id < 60) for r in op7_quality_rules.judge(docs, trees).collect())
    x = np.random.default_rng(1).random((500, len(op7_quality_rules.FEATURES)))
    more = x.copy()
    more[:, 2] += 0.3  # symbols can only lower a score
    assert (trees.score(more) <= trees.score(x)).all()
    judged = op7_quality_rules.judge(odd, trees).collect()
    assert len(judged) == 10 and all(r.base_failed and not r.kept for r in judged if r.n_words < 20)


@given(st.lists(st.text(max_size=700), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(texts):
    data, offsets = op7_quality_rules.__dict__["slices"](pa.array(texts)).__next__()[2:]
    for text, thumbs in zip(texts, op9_media.thumbnails(op9_media.store(data, offsets)), strict=True):
        payload = b"".join(t.tobytes() for t in thumbs)
        raw = text.encode()
        assert payload[: len(raw)] == raw and set(payload[len(raw) :]) <= {255} and len(payload) == max(1, -(-len(raw) // 576)) * 576


def test_media_query_stores_its_column(spark, monkeypatch):
    written, whole = [], _store.stored
    monkeypatch.setattr(op9_media, "stored", lambda df, *a: written.append(df.columns) or whole(df, *a), raising=False)
    found = op9_media.op9_media(spark, SF)
    assert written == [["doc_id", "n_bytes", "media"]]
    assert sorted(found.collect()) == sorted(op9_media.media_round_trip(spark.read.parquet(f"{SF}/documents.parquet")).select(found.columns).collect())


def test_media(odd, monkeypatch):
    found = op9_media.media_round_trip(odd).collect()
    assert len(found) == 10
    empty = next(r for r in found if r.doc_id == 2)
    assert (empty.n_bytes, empty.payload_bytes, empty.payload_sha256) == (0, 576, hashlib.sha256(b"\xff" * 576).hexdigest())
    assert empty.tail_crc32 == zlib.crc32(b"\xff" * 32)
    stored = {(r.doc_id, r.media_sha256, r.feature) for r in op9_media.read_media(op9_media.store_media(odd)).collect()}
    assert stored == {(r.doc_id, r.media_sha256, r.feature) for r in found}
    monkeypatch.setattr(op9_media, "MOST_ROWS", 24)
    thumbs = op9_media.thumbnails(op9_media.store(np.full(2000, 65, np.uint8), np.array([0, 2000])))[0]
    assert len(thumbs) == 4 and b"".join(t.tobytes() for t in thumbs)[:2000] == b"A" * 2000
    with pytest.raises(ValueError):
        _jpeg.parse(b"not an image")


def test_lines(spark, odd):
    texts = [f"menu\n own {i} \nfooter" if i < 6 else f"own {i}\nfooter" for i in range(10)]
    docs = spark.createDataFrame([*rows(*texts, source="a"), *rows("menu", "menu", source="b"), *rows("x", None, "", "x", "x", source=None)], SCHEMA)
    found = op10_line_dedup.without_boilerplate(docs, "source").collect()
    assert {(r._lines, r._dropped, r.text) for r in found if r.source == "a"} == {(3, 2, f" own {i} ") if i < 6 else (2, 1, f"own {i}") for i in range(10)}
    assert {r.text for r in found if r.source == "b"} == {""}
    assert sorted((r.text for r in found if r.source is None), key=str) == ["", "", "", "", None]
    assert op10_line_dedup.without_boilerplate(odd, "source").count() == 10


def test_menu_lines(spark, tmp_path):
    pages = [(i, "http://big.org/", "<p>menu</p>" * (i < 4) + f"<p>own {i}</p>") for i in range(20)] + [(i, "http://small.org/", f"<p>own {i}</p>") for i in range(20, 25)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = llm.queries()["op10_line_dedup"](spark, str(tmp_path)).collect()
    assert {(r.page_id, r.n_lines, r.n_dropped) for r in found} == {(i, 1 + (i < 4), int(i < 4)) for i in range(25)}


def test_pipeline_lines_of_copies(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = (" ".join(f"{w}{i}" for i in range(9)) for w in "xy")
    texts = [f"{one}\n{two}"] * 10 + [f"menu\nown {i} words of this one" for i in range(18)] + ["menu"] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    lines = corpus_pipeline.drop_lines(spark, docs, "")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in lines.collect()) == [(i, x := t.removeprefix("menu\n"), len(x)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, lines, "").collect()}
    assert kept == {0, *range(10, 29)}


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0 < len(out) and {r.doc_id for r in out} <= set(docs)
    coder = op8_byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in out[:50]:
        assert r.n_tokens == len(r.ids) and hashlib.sha256(coder.decode(r.ids)).hexdigest() == r.decoded_sha256
    stage = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        empty = f(spark, stage.limit(0), SF)
        assert empty.columns == stage.columns and empty.count() == 0


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_runs(name, spark):
    assert llm.queries()[name](spark, SF).count() >= 200

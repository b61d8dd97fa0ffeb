"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import io
import os
import random
import re

import numpy as np
import pytest

from mnemoweave.llm import op01_warc, op02_media, op03_pack, op04_minhash, op05_urls, op06_mix, op07_pii, op08_hnsw, op09_langid, op10_rlz
from mnemoweave.llm._common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    line = " ".join(rng.choices(vocab, k=40))
    out = []
    for i in range(60):
        t = " ".join(rng.choices(vocab, k=rng.randint(0, 90)))
        out.append(t + ("\n" + line if i % 4 == 0 else ""))
    near = out[0].split()
    out += [" ".join(near[:-2] + ["zz"]), out[0], None, "", "  ", "one two", "one two"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "null id", None, None, None)], DOC)


def test_rlz_matches_brute_force(docs, texts):
    low, ws = {}, {i: WORD.findall(t or "") for i, t in enumerate(texts)}
    for d, w in ws.items():
        for i in range(len(w) - 12):
            low.setdefault(tuple(w[i : i + 13]), d)
    got = {r["doc_id"]: r for r in op10_rlz.dedup_substrings(docs).collect()}
    assert len(got) == len(texts) + 1
    for d, w in ws.items():
        gone = {j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), len(gone))
        assert got[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def _shingles(t):
    w = WORD.findall(t or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or collections.Counter([tuple(w)] if w else [])


def _jp(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in keys) for x in a if x in b)


def test_minhash_matches_brute_force(spark, docs, texts):
    sh, parent = [_shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is not None and (texts[i] == texts[j] or _jp(sh[i], sh[j]) >= 0.8):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in op04_minhash.near_duplicates(docs, Scratch(spark, "t")).collect()}
    assert got == {i: root(i) for i in range(len(texts))} | {None: None}


def test_probability_jaccard_formula():
    a, b = collections.Counter("aabbbcd"), collections.Counter("abbcce")
    f = lambda c: (np.array(sorted(map(ord, c)), np.uint64), np.array([c[chr(k)] for k in sorted(map(ord, c))], float))
    assert op04_minhash.probability_jaccard(*f(a), *f(b)) == pytest.approx(_jp(a, b))


def test_pack_is_whole_and_tight():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1023) for _ in range(800)]
    bins = op03_pack.evolve(lengths, 1024, 5)
    assert collections.Counter(n for b in bins for n in b) == collections.Counter(lengths)
    assert max(map(sum, bins)) <= 1024 and len(bins) <= -(-sum(lengths) // 1024) * 1.02 + 1
    assert op03_pack.evolve(lengths, 1024, 5) == bins
    assert op03_pack.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and op03_pack.cut(1, 1024) == [(0, 1)]


def test_encoder_equals_tokenizer(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    more = [*texts, "é à  b\n\n c\td", "x<|endoftext|> y", "a b 日本 語", "don't  stop  ", " lead"]
    tok = Tokenizer.from_file(op03_pack.vocabulary())
    for group in (more, [t for t in more if t and "<|" not in t]):
        ids, ends = op03_pack.Encoder(op03_pack.vocabulary(), op03_pack.vocabulary(op03_pack.RANKS))(pa.array(group, pa.string()))
        for t, a, b in zip(group, ends[:-1], ends[1:], strict=True):
            assert ids[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_media_round_trip(spark, docs, texts):
    got = {r["doc_id"]: r for r in op02_media.media_tiles(op02_media.media_column(docs.select("doc_id", "text"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert np.load(io.BytesIO(got[i]["tile"])).shape == op02_media.TILE


def test_image_codecs_and_resize():
    a = np.arange(2 * 5 * 3, dtype=np.uint8).reshape(2, 5, 3)
    assert (op02_media.decode(b"P6\n# c\n5 2\n255\n" + a.tobytes()) == a).all()
    assert (op02_media.decode(b"P3 5 2 255 " + " ".join(map(str, a.ravel())).encode()) == a).all()
    assert op02_media.decode(b"P1 2 1 1 0").tolist() == [[0, 255]] and op02_media.decode(b"P4 2 1\n\x80").tolist() == [[0, 255]]
    rows = b"".join(a[y, :, ::-1].tobytes().ljust(16, b"\0") for y in (1, 0))
    head = b"BM" + (54 + 32).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    head += (5).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)
    assert (op02_media.decode(head + rows) == a).all()
    g = np.random.default_rng(0).random((7, 11))
    fine = np.kron(g, np.ones((3, 4)))
    assert np.allclose(op02_media.area_resize(g, 3, 4), fine.reshape(3, 7, 4, 11).mean(axis=(1, 3)))
    with pytest.raises(ValueError):
        op02_media.decode(b"P9 junk")


def test_warc_round_trip_over_small_splits(spark, tmp_path):
    rng = random.Random(2)
    html = ["<p>" + "".join(rng.choices("abcdef ", k=rng.randint(0, 400))) for _ in range(60)] + [None, ""]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(100, "http://x\ny", html[0] + "z" * 200), (101, None, html[0] + "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "coalesce(cast(html as binary), x'') payload")
    out = op01_warc.revisits(pages).selectExpr("cast(page_id as string) id", "url", "payload", "digest", "cast(refers_to as string) refers_to")
    manifest = Scratch(spark, "w").write(op01_warc.write_warc(out, f"file://{tmp_path}/a"), "m")
    for split in (50, 1000, 1 << 20):
        got = {int(dict(r["fields"])["x-record-key"]): r for r in op01_warc.read_warc(manifest, split).collect()}
        assert len(got) == len(rows) and op01_warc.read_warc(manifest, split).count() == len(rows)
        assert all(bytes(got[i]["payload"]) == (h or "").encode() for i, _, h in rows if i != 101)
        assert got[101]["record_type"] == "revisit" and dict(got[101]["fields"])["x-refers-to-key"] == "100"


def test_warc_reader_skips_damage(tmp_path):
    a = op01_warc.member("response", "u", b"one", "d", {"X-Record-Key": "1"})
    b = op01_warc.member("response", "u", b"two", "d", {"X-Record-Key": "2"})
    data = b"junk\x1f\x8b\x08junk" + a + a[:40] + b
    got = [r[-1] for r in op01_warc.records_in(io.BytesIO(data), len(data), 0, len(data))]
    assert got == [b"one", b"two"]


def test_urls(spark):
    urls = ["http://A.example.NET/en/1?x#y", "https://example.net/fr/", "http://b.example.com/de/2", "http://w.org/fr/3", "ftp://net", None, "nourl", "http://notnet/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op05_urls.judge(pages, None).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == ("net/", "block")
    assert got[2][2] == "example.com/de/" and got[3][2:] == ("org/fr/", "allow") and got[4] == ("net", "", None, "allow")
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][2] is None


def test_mined_rule(spark):
    rows = [(["host=bad", "path=x"], "block")] * 40 + [(["host=ok", "path=x"], "allow")] * 160
    rules = op05_urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), Scratch(spark, "r")).collect()
    assert [r["antecedent"] for r in rules if r["verdict"] == "block"] == [["host=bad"]]


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 9 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim = docs.select("doc_id", "source", op06_mix.n_words(docs["text"]).alias("size"), op06_mix.sample_key("k", "doc_id").alias("key"))
    got = op06_mix.mix(slim, Scratch(spark, "m")).collect()
    by = collections.defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for r in got:
        assert abs(by[r["source"]] - r["target"]) <= 1 and r["target"] <= 3 * r["source_size"] + 1e-9
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))


def test_pseudonyms_are_valid_linked_and_careful():
    card, text = "4111 1111 1111 1111", "Version 4.0, room 12, 1234567890123456."
    new, found = op07_pii.pseudonymise(card)
    digits = new.replace(" ", "")
    assert found["card"] == 1 and new != card and op07_pii.luhn_digit(digits[:-1]) == digits[-1]
    assert op07_pii.pseudonymise(text)[0] == text and op07_pii.pseudonymise(None)[0] is None
    twice = op07_pii.pseudonymise("a.b@c.org x a.b@c.org")[0].split(" x ")
    assert twice[0] == twice[1] != "a.b@c.org" and twice[0].endswith("@c.org")
    assert sorted(op07_pii.permute(i, 101, b"k", "t") for i in range(101)) == list(range(101))
    assert op07_pii.pseudonymise("2024-02-30")[0] == "2024-02-30" and op07_pii.pseudonymise("2024-02-29")[0] != "2024-02-29"


def test_hnsw_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:80] = x[0] + rng.normal(size=(30, 16)) * 0.1
    x[80] = x[1]
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(300)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 0), (303, [1.0] * 16, None)]
    got = {r["vec_id"]: r for r in op08_hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = (np.arange(300) % 2)[:, None] == (np.arange(300) % 2)[None, :]
    links = (u @ u.T >= 0.93) & same & ~np.eye(300, dtype=bool)
    assert [got[i]["n_links"] for i in range(300)] == links.sum(1).tolist() and len(got) == 304
    assert all(got[i]["component_id"] == i and got[i]["kept"] for i in range(300, 304))


def test_language(spark):
    en, fr = "the house and the garden of the people were here ", "la maison et le jardin des gens sont ici avec nous "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)] + [(40, None, "en"), (41, "", None), (42, "123", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in op09_langid.identify(docs, op09_langid.training_sample(docs)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(40))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (40, 41, 42))
    assert op09_langid.identify(docs, {}).first()["lang_pred"] == "und"


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert op10_rlz.dedup_substrings(none).count() == 0 and op04_minhash.near_duplicates(none, Scratch(spark, "e")).count() == 0
    assert op03_pack.pack_documents(none.select("doc_id", "text")).count() == 0 and op07_pii.pseudonyms(none).count() == 0
    assert op02_media.media_column(none.select("doc_id", "text")).count() == 0
    assert op08_hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and max(r["offset"] + r["length"] for r in got) <= 1024

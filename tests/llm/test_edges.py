"""Null columns, repeated rows, very long texts, ties, empty tables and clashing names; whole queries against brute force."""

import collections
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoweave.llm import op01_warc, op02_media, op03_pack, op04_minhash, op05_urls, op06_mix, op07_pii, op08_hnsw, op09_langid, op10_rlz
from mnemoweave.llm._common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "margin", "rejected", "lang_pred", "n_pii", "pii_kinds", "row", "times", "key", "size", "s", "class_id", "digest", "_id", "c0", "nth"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    en, fr = "the house and the garden of the people were here with them".split(), "la maison et le jardin des gens sont ici avec nous tous".split()
    out = []
    for i in range(50):
        words = en if i % 2 else fr
        out.append((i, " ".join(rng.choices(words, k=rng.randint(5, 60))) + f" mail a{i}.b@c.org", "en" if i % 2 else "fr", f"s{i % 3}", 1))
    out += [(60, None, "en", "s0", None), (61, "", "en", None, 0), (None, out[1][1], "en", "s1", 3), (None, out[1][1], "en", "s1", 3), (62, "   ", None, None, 3)]
    out += [(63, " ".join(rng.choices(en, k=40_000)), "en", "s2", 9), out[3], out[3], (5, out[5][1], "en", "other", 1), (5, out[7][1], "en", "other", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture()
def save(spark, tmp_path):
    def write(name, df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def plain_rows(df):
    return collections.Counter(map(str, map(tuple, df.collect())))


STAGES = {
    "langid": op09_langid.stage_langid, "minhash": op04_minhash.stage_minhash, "pii": op07_pii.stage_pii, "mix": op06_mix.stage_mix,
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, docs, rows, name, tmp_path):
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("source")) for c in CLASH})
    out = STAGES[name](spark, more, str(tmp_path))
    assert out.schema.names == more.schema.names
    got, want = plain_rows(out.select(*docs.columns)), plain_rows(STAGES[name](spark, docs, str(tmp_path)))
    assert got == want
    assert all(r[c] == (None if r["source"] is None else c + r["source"]) for r in out.collect() for c in CLASH)
    none = STAGES[name](spark, docs.limit(0), str(tmp_path))
    assert none.schema.names == docs.schema.names and none.count() == 0


def test_minhash_stage_keeps_null_ids_and_a_stated_row(spark, docs, rows, tmp_path):
    kept = [tuple(r) for r in op04_minhash.stage_minhash(spark, docs, str(tmp_path)).collect()]
    assert sum(r[0] is None for r in kept) == 2 and (60, None, "en", "s0", None) in kept
    assert kept.count(rows[3]) == 1
    assert [r for r in kept if r[0] == 5 and r[1] == rows[5][1]] == [min((rows[5], (5, rows[5][1], "en", "other", 1)), key=lambda r: r[3])]
    # the text of 7 is one of 5's
    assert sorted(r[0] for r in kept if r[0] is not None and r[0] < 50) == sorted([5, *({*range(50)} - {7})])


def test_minhash_of_chains_and_groups(spark):
    """A family whose members link in a chain, and a large group of copies, are one class each."""
    rng, texts = random.Random(2), []
    words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    for i in range(12):
        words[16 * i : 16 * i + 8] = [f"v{rng.randrange(10**9)}" for _ in range(8)]
        texts.append(" ".join(words))
    order = list(range(12))
    rng.shuffle(order)
    rows = [(k, texts[o]) for k, o in enumerate(order)] + [(100 + i, "one two three four five six") for i in range(300)]
    got = {r["doc_id"]: r["class_id"] for r in op04_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "f")).collect()}
    assert got == {k: 0 for k in range(12)} | {100 + i: 100 for i in range(300)}


def test_pii_key_comes_from_the_session(spark, docs, tmp_path):
    with pytest.warns(UserWarning, match="public key"):
        a = plain_rows(op07_pii.stage_pii(spark, docs, str(tmp_path)))
    spark.conf.set(op07_pii.KEY_SETTING, "secret")
    try:
        b, again = (plain_rows(op07_pii.stage_pii(spark, docs, str(tmp_path))) for _ in range(2))
    finally:
        spark.conf.unset(op07_pii.KEY_SETTING)
    assert a != b and b == again


def test_pii_links_values_across_documents(spark):
    rows = [(1, "card 4111 1111 1111 1111 of me"), (2, "4111-1111-1111-1111"), (3, "4111 1111 1111 1112"), (4, None), (5, ""), (1, "card 4111 1111 1111 1111 of me")]
    rows += [(6, "x " * 200_000 + "4111111111111111")]
    got = collections.defaultdict(list)
    for r in op07_pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append(r)
    digits = lambda t: "".join(c for c in t if c.isdigit())
    one = digits(got[1][0]["text"])
    assert one == digits(got[2][0]["text"]) == digits(got[6][0]["text"]) != "4111111111111111" and got[1][0] == got[1][1]
    assert got[3][0]["text"] == "4111 1111 1111 1112" and got[4][0]["text"] is None and got[5][0]["text"] == ""
    assert len(got[6][0]["text"]) == 400_016


def test_pack_query(spark, docs, rows, save):
    """Every id of every text, as ``tokenizers`` gives them, once and without gaps."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op03_pack.vocabulary())
    extra = docs.withColumns({"piece": F.lit(1), "spread": F.lit("x")})
    got = op03_pack.op3_pack(spark, save("documents", extra)).collect()
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)] if len(ids) > 1024 else [0]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[d, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(b)))
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 1024
    lengths = sorted((r["length"] for r in got), reverse=True)
    assert len(bins) <= len(op03_pack.best_fit(lengths, [], 1024))


def test_pack_over_many_islands(spark):
    rng = random.Random(9)
    lengths = [rng.randint(1, 1023) for _ in range(1500)] + [500] * 200
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], op03_pack.PIECES)
    scratch = Scratch(spark, "p")
    got = op03_pack.pack(scratch.write(pieces, "pieces"), scratch, island_pieces=250).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert collections.Counter(n for b in bins.values() for _, n in b) == collections.Counter(lengths)
    for b in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(b)))
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= 1.02 * len(op03_pack.best_fit(sorted(lengths, reverse=True), [], 1024))


def brute_rules(rows, support, gain, count):
    n = len(rows)
    share = {v: sum(x == v for _, x in rows) / n for v in {x for _, x in rows}}
    every = {frozenset(c) for t, _ in rows for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
    out = {}
    for a in every:
        has = [v for t, v in rows if a <= set(t)]
        for v, b in share.items():
            both = has.count(v)
            if both >= max(support * n, count) and (both / len(has) - b) / (1 - b) >= gain - 1e-12:
                out[a, v] = both / len(has)
    return {k: c for k, c in out.items() if not any(v == k[1] and a < k[0] and d >= c for (a, v), d in out.items())}


def test_mining_and_matching_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        t = sorted(x for x in "abcdef" if rng.random() < 0.4)
        bad = 0.9 if {"a", "b"} <= set(t) else 0.05 if "c" in t else 0.25
        rows.append((t, "block" if rng.random() < bad else "allow"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = op05_urls.mine(labelled, Scratch(spark, "m"))
    got = {(frozenset(r["antecedent"]), r["verdict"]): r for r in rules.collect()}
    want = brute_rules(rows, op05_urls.MIN_SUPPORT, op05_urls.MIN_GAIN, op05_urls.MIN_COUNT)
    assert set(got) == set(want) and {v for _, v in got} == {"allow", "block"} and any(a == {"a", "b"} for a, v in got if v == "block")
    assert all(r["confidence"] == pytest.approx(want[k]) for k, r in got.items())
    urls = [(f"u{i}", sorted(c)) for i, c in enumerate(itertools.chain.from_iterable(itertools.combinations("abcdefg", k) for k in range(8)))]
    found = {r["url"]: (r["mined"], r["mined_rule"]) for r in op05_urls.match(spark.createDataFrame(urls, "url string, tokens array<string>"), rules).collect()}
    for u, t in urls:
        fit = [(r["gain"], r["support"], r["antecedent"], r["verdict"]) for r in got.values() if set(r["antecedent"]) <= set(t)]
        assert found.get(u) == ((max(fit)[3], " & ".join(max(fit)[2])) if fit else None)


def test_urls_query(spark, save):
    """A planted association decides urls that no fixed rule fits; null urls, repeated rows and no labels are judged."""
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'fine'}.example.com/en/{i}", "x") for i in range(200)]
    rows += [(300, None, "x"), (301, "http://spam.example.com/xx", "x"), (301, "http://spam.example.com/xx", "x"), (302, "http://a.net/" + "y" * 100_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(7, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    d = save("labels", labels) and save("pages", pages)
    got = op05_urls.op5_urls(spark, d).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["verdict"], r["mined_rule"], r["rule"]) for r in got}
    assert all(by[i][0] == ("block" if i % 4 == 0 else "allow") for i in range(200)) and by[0][1] == "host=spam"
    assert by[300] == ("allow", None, None) and by[301][0] == "block" and by[302][0] == "block" and by[302][2] == "net/"
    save("labels", labels.limit(0))
    assert {r["page_id"]: r["verdict"] for r in op05_urls.op5_urls(spark, d).collect()}[0] == "allow"
    save("pages", pages.limit(0))
    assert op05_urls.op5_urls(spark, d).count() == 0


def test_media_query(spark, docs, rows, save):
    """All digests from the stored bytes, and the difference hash by its definition."""
    got = collections.defaultdict(list)
    for r in op02_media.op2_media(spark, save("documents", docs.withColumn("media", F.lit(1)))).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for d, t, *_ in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        stored = b"P6\n64 %d\n255\n" % (len(padded) // 192) + padded
        grey = np.frombuffer(padded, np.uint8).reshape(-1, 64, 3).astype(float)
        r = next(r for r in got[d] if r["payload_sha256"] == hashlib.sha256(padded).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        h, w = grey.shape[:2]
        if h < 4000:  # each sample repeated 8 (rows) and 9 (columns) times, then plain means
            fine = np.repeat(np.repeat(grey, 8, 0), 9, 1).reshape(8, h, 9, w, 3).mean(axis=(1, 3, 4))
            tile = np.rint(fine).astype(np.uint8)
            assert r["feature"] == "dhash:" + op02_media.difference_hash(tile)


def test_media_of_nothing(spark, save):
    none = spark.createDataFrame([], DOC)
    assert op02_media.op2_media(spark, save("documents", none)).count() == 0


def test_mix_query(spark, docs, rows, save):
    d = save("documents", docs.withColumns({"size": F.lit("x"), "key": F.lit(1), "target": F.lit(2)}))
    got = op06_mix.op6_mix(spark, d).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, op06_mix.op6_mix(spark, d).collect()))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and all(r["size"] == 0 == r["taken"] for r in got if r["doc_id"] in (60, 61, 62))
    targets = {r["source_size"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(sum(r["size"] for r in got))
    assert op06_mix.op6_mix(spark, save("documents", docs.limit(0))).count() == 0


def test_warc_query(spark, save):
    html = ["<p>" + "x" * 200, "<p>" + "x" * 200, "short", "short", None, "", "é" * 300_000, "<p>" + "x" * 200]
    rows = [(i, f"http://h/{i}", h, "c") for i, h in enumerate(html)] + [(0, "http://h/0", html[0], "c"), (None, "u", html[0], "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = op01_warc.op1_warc(spark, save("pages", pages)).collect()
    assert len(got) == len(rows) and all(r["digest_holds"] for r in got)
    by = {r["page_id"]: r for r in got}
    for i, _, h, _ in rows[:8]:
        raw = (h or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: by[i]["refers_to"] for i in range(8)} == {0: None, 1: 0, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 0}
    assert op01_warc.op1_warc(spark, save("pages", pages.limit(0))).count() == 0


def test_warc_bytes_do_not_depend_on_the_order(spark, tmp_path):
    rows = [(str(i), f"u{i}", b"p" * i, f"d{i}", None) for i in range(50)]
    out = []
    for k, r in enumerate((rows, rows[::-1])):
        df = spark.createDataFrame(r, "id string, url string, payload binary, digest string, refers_to string").coalesce(1)
        (file,) = op01_warc.write_warc(df, f"file://{tmp_path}/{k}").collect()
        with open(file["path"].removeprefix("file://"), "rb") as f:
            out.append(f.read())
    assert out[0] == out[1]


def clustered(rng, n, shards_of):
    x = rng.normal(size=(n // 4, 24))
    x = np.concatenate([x, *(x + rng.normal(size=x.shape) * s for s in (0.05, 0.2, 0.3))])
    return x[rng.permutation(len(x))].astype(np.float32)


def test_hnsw_over_shards_and_slots(spark):
    """Links across several shards and slots, found by streamed queries: ids divisible by 50 against all rows, and all counts."""
    x = clustered(np.random.default_rng(3), 2400, 4)
    x[7] = x[1207] = x[2000]
    label = np.arange(len(x)) // 1200
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))] + [(7, x[7].tolist(), 0), (None, x[3].tolist(), 0), (9000, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "block": F.lit("x")})
    got = {r["vec_id"]: r for r in op08_hnsw.near_duplicates(df, shard_vectors=300, query_rows=500).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    want = links.sum(1) + links[:, 7] + (np.arange(len(x)) == 7)  # the repeated row counts for those that link with 7
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and links.sum() > 2000
    asked = np.arange(0, len(x), 50)
    assert found[asked].sum() >= 0.95 * want[asked].sum() and found.sum() >= 0.95 * want.sum()
    assert got[9000]["component_id"] == 9000 and got[None]["component_id"] is None and got[None]["n_links"] == 0
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) and got[i]["component_id"] <= i for i in range(len(x)))


def test_hnsw_audit_uses_other_shards():
    x = clustered(np.random.default_rng(5), 800, 2).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = op08_hnsw.Hnsw(u[:400])
    ef = op08_hnsw.audited(graph, 0.9299, ef=1, probes=u[400:464])
    truth = {(i, j) for i, j in zip(*np.nonzero(u[400:464] @ u[:400].T >= 0.93), strict=True)}
    got = {p for i, j in graph.near(u[400:464].astype(np.float32), 0.9299, ef) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert truth and len(truth & got) >= 0.95 * len(truth)


def test_language_held_out(spark):
    rng = random.Random(4)
    words = {"en": "the house and garden of people were here with them when", "fr": "la maison et le jardin des gens sont ici avec nous quand", "de": "das haus und der garten von leuten waren hier mit ihnen wenn"}
    rows = [(i, " ".join(rng.choices(words[k].split(), k=30)), k) for i, k in enumerate(rng.choices(list(words), k=600))]
    rows += [(None, rows[0][1], rows[0][2]), (700, None, "en"), (701, "", "fr"), (702, "...", "de"), (703, words["en"] * 3000, "en"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "h": F.lit(2), "piece": F.lit(3)})
    folder = Scratch(spark, "l")
    docs.write.parquet(folder.path("documents.parquet"))
    got = op09_langid.op9_langid(spark, folder.base).collect()
    assert len(got) == len(rows)
    truth = {d: k for d, _, k in rows}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held if r["doc_id"] < 700]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and {r["doc_id"]: r["lang_pred"] for r in got}[703] == "en"


def test_empty_stages_and_pack(spark, docs, tmp_path):
    assert op03_pack.stage_pack(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert op10_rlz.dedup_substrings(docs.limit(0)).count() == 0
    assert np.load(io.BytesIO(op02_media.npy(np.zeros((2, 3), np.uint8)))).shape == (2, 3)

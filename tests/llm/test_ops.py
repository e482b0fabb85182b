"""Training-data operators against brute force, on fixtures with nulls, empty texts, ties, repeats and clashing names."""

import collections
import hashlib
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import TABLES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.llm import bpe, chat, license_scan, line_dedup, media_ogg, packing, quality, queries, secret_scan, simhash, toxicity
from attestry.llm.common import Scratch
from attestry.llm.components import components

SPACE = " \t\n\x0b\x0c\r"
#: Columns whose names operators use inside.
CLASH = "doc_id bigint, text string, fp string, id string, part int, key string, line string, spans string, length int, piece string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t) + ("x", "y", 1, "k", "l", "s", 2, "p") for i, t in zip(ids or range(len(texts)), texts)], CLASH)


ODD = [None, "", " \n\t ", "one", "One two", "one two three", "dup dup dup dup", "dup dup dup dup", "é à ü 😀 　 x", "word " * 30_000]


def words(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


# -- 1 ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


def test_fingerprints():
    for t in [*ODD, "A b C d e F g", "x\u0085y z w v u"]:
        assert simhash.fingerprint(t) % 2**64 == brute_fingerprint(t)


def test_golay_code_is_perfect():
    assert len({int(x) for x in simhash._LEADER}) == 2048
    words23 = np.arange(0, 1 << 23, 977, dtype=np.uint32)
    index = simhash.golay_index(words23)
    s = simhash._syndromes(index.astype(np.uint32) << np.uint32(11))
    codeword = (index.astype(np.uint32) << np.uint32(11)) | s
    assert max(int(x).bit_count() for x in codeword ^ words23) <= 3


def test_links_are_all_pairs_at_two_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(rng.randrange(6)):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    find = closure((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    scratch = Scratch(spark, "t")
    comp = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), scratch), scratch)
    got = closure((r.node % 2**64, r.root % 2**64) for r in comp.collect())
    groups = lambda f: {frozenset(x for x in fps if f(x) == r) for r in {f(x) for x in fps}}
    assert groups(got) == groups(find)


def test_simhash_query(spark):
    got = {r.doc_id: r for r in queries.op1_simhash(spark, TABLES).collect()}
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    ids = sorted(fp)
    find = closure((a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def test_simhash_edges(spark):
    d = docs(spark, [*ODD, "rest"], [*range(len(ODD)), None])
    got = simhash.simhash_components(d).collect()
    assert len(got) == len(ODD) + 1
    root = {r.doc_id: r.component_id for r in got}
    assert root[0] == root[1] == root[2] == 0 and root[6] == root[7] == 6 and root[None] is None
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {0, 3, 4, 5, 6, 8, 9, None}
    assert simhash.simhash_components(d.limit(0)).count() == 0


def test_one_row_is_kept_for_each_component_not_for_each_id(spark):
    """Null and repeated ids: texts that are copies of nothing stay, whatever their ids."""
    texts = [f"{w} runs over hill number {w} and {w} sees nothing" for w in "ant bee cat dog elk".split()]
    rows = [(None, texts[0]), (None, texts[1]), (None, None), (None, ""), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[4]), (None, texts[1])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[0]), (None, texts[1])]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(d).collect()]
    assert sorted(((i, t) for i, t in got if t), key=str) == sorted(want, key=str) and len(got) == len(want) + 1


def test_near_copies_are_linked_at_their_similarity(spark):
    """The pipeline's stage removes copies from 0.8 on, not only exact ones, and no others."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    base = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(12)]
    texts = [" ".join(w) for w in base]
    for w in base:
        for n in (1, 2, 3, 6):
            x = list(w)
            for place in rng.sample(range(10, 110), n):
                x[place] = "changed"
            texts.append(" ".join(x))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    jaccard = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    find = closure((a, b) for b in range(len(texts)) for a in range(b) if jaccard(a, b) >= 0.8)
    want = {find(i) for i in range(len(texts))}
    assert {r.doc_id for r in cp.simhash_dedup(spark, d, "").collect()} == want
    assert len(want) < len(texts)
    assert simhash.keep_one_alike(d.limit(0)).count() == 0


def test_simhash_names_candidates_of_the_near_copies(spark, monkeypatch):
    """Fingerprints within two bits share a bucket, as do texts of one fingerprint; and the pipeline's stage takes them."""
    rng = random.Random(14)
    fps = [rng.getrandbits(64) for _ in range(12)]
    fps += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in fps for _ in range(3)] + fps[:3]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = simhash.near_buckets(spark.createDataFrame(list(enumerate(signed)), "id bigint, fp bigint"), Scratch(spark, "t")).collect()
    held = collections.defaultdict(set)
    for r in got:
        held[r.band].add(r.id)
    met = {(a, b) for x in held.values() for a in x for b in x if a < b}
    assert met == {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 2}
    # MinHash keys that nothing shares: what is found then, SimHash found.
    monkeypatch.setattr(simhash, "_signed", lambda it, k, whole=simhash._signed: (b.set_column(b.num_columns - 1, "bands", pa.array([[]] * b.num_rows, pa.list_(pa.int64()))) for b in whole(it, k)))
    base = " ".join(f"w{i * 7919 % 3001}" for i in range(1500))
    texts = [base, base + " more", base + " else", " ".join(f"v{i * 7907 % 3001}" for i in range(1500))]
    assert max((brute_fingerprint(base, 5) ^ brute_fingerprint(t, 5)).bit_count() for t in texts[1:3]) <= 2
    assert {r.doc_id for r in simhash.keep_one_alike(docs(spark, texts)).collect()} == {0, 3}


def test_components_follow_chains(spark):
    scratch, n = Scratch(spark, "t"), 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(99, 99), (None, 5), (70, 71), (71, 70)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in components(e, scratch).collect()} == {*((i, 0) for i in range(1, n + 1)), (71, 70)}
    assert components(e.limit(0), scratch).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------------------


def test_chain_predicts_held_out_rows(spark):
    """On the largest of the small tables: a quarter of its labels holds some 120 toxic rows, of sf0.01's nine."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.fit(d, labels.where("doc_id % 4 <> 0"), queries.TOXIC)
    got = toxicity.score(d, chain).join(labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    hit, said, there = sum(r.toxic and r.y == 1 for r in got), sum(r.toxic for r in got), sum(r.y for r in got)
    assert there > 100 and 2 * hit / (said + there) >= 0.9 and hit / said >= 0.9


def test_chain_feeds_earlier_categories_on():
    rng, n = np.random.default_rng(1), 400
    a = rng.integers(0, 2, n)
    texts = [f"{'bad' if x else 'good'} w{rng.integers(50)}" for x in a]
    chain = toxicity.train(texts, np.stack([a, a], 1), ("first", "second"), ["bad", "good"], np.arange(n))
    assert [len(w) for w in chain.weights] == [3, 4] and chain.weights[1][2] > 0.5
    assert (chain.scores(["bad", "good", None, ""])[:2, 1] > 0.5).tolist() == [True, False]


def test_toxicity_edges(spark):
    chain = toxicity.train(["bad"] * 5 + ["good"] * 5, np.array([[1]] * 5 + [[0]] * 5), ("toxic",), ["bad", "good"], np.arange(10))
    got = toxicity.score(docs(spark, [*ODD, "bad"]), chain).orderBy("doc_id").collect()
    assert len(got) == len(ODD) + 1 and got[-1].toxic and got[6][1] == got[7][1]
    assert toxicity.score(docs(spark, ["x"]).limit(0), chain).count() == 0
    none = toxicity.fit(docs(spark, ["x"]).limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), queries.TOXIC)
    assert toxicity.score(docs(spark, ["x"]), none).count() == 1


# -- 3 ---------------------------------------------------------------------------------------------------------


def brute_ids(texts):
    t = bpe.load(bpe.ENGLISH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def check_packing(rows, ids):
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, p in pieces.items():
        p.sort(key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p))) and [r.start for r in p] == [sum(x.length for x in p[:k]) for k in range(len(p))]
        assert sum(r.length for r in p) == len(ids[i]) and (len(p) == 1 or all(r.length == 2048 for r in p[1:]))
        for r in p:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[i][r.start : r.start + r.length]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_packing_query(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in rows], brute_ids([r.text for r in rows])))
    n = check_packing(queries.op3_packing(spark, TABLES).collect(), ids)
    lengths = collections.Counter(length for x in ids.values() for _, length in packing.pieces_of(len(x)))
    assert packing.bound(lengths, 2048) <= n <= packing.bins(packing.best_fit(lengths, 2048))


def test_packing_edges(spark):
    texts = [*ODD, "a <|endoftext|> b", "a  b   c \n d"]
    check_packing(packing.pack(docs(spark, texts)).collect(), dict(enumerate(brute_ids(texts))))
    assert packing.pack(docs(spark, ["x"]).limit(0)).count() == 0
    assert packing.pack(docs(spark, ["x", "x"], [1, 1])).count() == 2


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_plans_hold_every_piece(counts, seed):
    for plan in (packing.best_fit(counts, 100), packing.evolve(counts, 100, seed, None, 4, 6)):
        got = collections.Counter()
        for content, n in plan:
            assert sum(content) <= 100
            for k in content:
                got[k] += n
        assert got == collections.Counter(counts) and packing.bins(plan) >= packing.bound(counts, 100)
    assert packing.bins(packing.evolve(counts, 100, seed, None, 4, 6)) <= packing.bins(packing.best_fit(counts, 100))


# -- 4 ---------------------------------------------------------------------------------------------------------


def slow_crc(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ (0x04C11DB7 if r >> 31 else 0)) & 0xFFFFFFFF
    return r


@given(st.binary(max_size=300))
@settings(max_examples=40, deadline=None)
def test_ogg_checksum(data):
    assert media_ogg.checksum(data) == slow_crc(data)


@given(st.lists(st.binary(max_size=900), max_size=6), st.lists(st.binary(max_size=600), max_size=4))
@settings(max_examples=60, deadline=None)
def test_streams_are_told_apart(a, b):
    pages = [[*media_ogg.pages_of([(p, i) for i, p in enumerate(x)], serial)] for serial, x in ((7, a), (9, b))]
    mixed = b"".join(p for pair in zip(*pages) for p in pair) + b"".join(pages[0][len(pages[1]) :] + pages[1][len(pages[0]) :])
    got = media_ogg.parse(b"junk" + mixed + b"OggS")
    assert got.streams[7].packets == a and got.streams[9].packets == b


def test_damage_is_reported():
    data = bytes(range(256)) * 9 * 9
    media = bytearray(media_ogg.write_pcm(data))
    assert media_ogg.read_pcm(bytes(media))[0] == data
    media[len(media) // 2] ^= 1
    back, ogg, _ = media_ogg.read_pcm(bytes(media))
    assert ogg.bad_pages == 1 and len(back) < len(data)


def test_ogg_query(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    text = {r.doc_id: r.text for r in rows}
    for r in queries.op4_media_ogg(spark, TABLES).collect():
        raw = (text[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_ogg_edges(spark):
    got = media_ogg.stored(docs(spark, ODD), with_media=True)
    rows = got.orderBy("doc_id").collect()
    assert rows[0][1:] == rows[1][1:] and rows[6][1:] == rows[7][1:] and rows[0].payload_bytes == 576
    p = media_ogg.packets(got.select("doc_id", "media"), keep=("doc_id",)).where("serial = 1").orderBy("doc_id", "packet").collect()
    first = [r for r in p if r.doc_id == 0]
    assert [r.end_s for r in first] == [None, 576 / 8000] and first[1].bytes == b"\xff" * 576
    assert media_ogg.stored(docs(spark, ["x"]).limit(0)).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, seq bigint, turn bigint, message int, kind string, role string, text string")


def test_events_fold(spark):
    rows = [
        (1, 1, 1, 1, "open", "user", ""), (1, 2, 1, 1, "delta", "user", "he"), (1, 3, 1, 1, "delta", "user", "llo"), (1, 4, 2, 1, "open", "assistant", ""), (1, 5, 2, 1, "delta", "assistant", "wrong"),
        (1, 6, 2, 1, "regenerate", "assistant", None), (1, 7, 2, 1, "delta", "assistant", "ri"), (1, 8, 2, 1, "delta", "assistant", "ght"), (1, 9, 1, 1, "edit", "user", "bye"), (1, 10, 1, 1, "delta", "user", "!"),
        (2, 1, None, 1, "delta", None, None),
    ]
    random.Random(3).shuffle(rows)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.messages(events(spark, rows)).collect()}
    assert got == {(1, 1): ("user", "bye!"), (1, 2): ("assistant", "right"), (2, None): ("", "")}
    one = chat.render(chat.messages(events(spark, rows))).where("conv_id = 1").first()
    assert one.formatted == "<|user|>\nbye!<|end|>\n<|assistant|>\nright<|end|>\n"
    assert [one.formatted[s.start : s.start + s.length] for s in one.loss] == ["right"]


def test_template_is_reversible(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "&lt; &amp;lt; & <", "", None, "😀 <|assistant|>"]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)] + [(1, 9, "a|<&b", "x"), (1, 9, "a|<&b", "x")], "conv_id bigint, turn bigint, role string, text string")
    r = chat.render(chat.messages(chat.events_of(rows))).withColumn("t", chat.parse(F.col("formatted"))).first()
    assert [(x.role, x.text) for x in r.t] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(said)] + [("a|<&b", "x")] * 2
    assert r.formatted.count("<|end|>\n") == 8
    d = chat.digest(chat.render(chat.messages(chat.events_of(rows)))).first()
    lost = "".join(t or "" for t in said[1::2])
    assert (d.loss_chars, d.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert chat.digest(chat.render(chat.messages(chat.events_of(rows.limit(0))))).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_path(bpe.MULTI)), special_tokens={})


@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sAé中😀1　\u0085\r")), max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_ranks(tik, text):
    (raw,) = bpe._cache(bpe.MULTI).encode_bytes([text])
    ids = memoryview(raw).cast("I").tolist()
    assert ids == tik.encode_ordinary(text)
    assert bpe.decode_bytes(ids, bpe.id_bytes(bpe.MULTI)) == text.encode()
    assert "".join(bpe.decode_texts(ids, bpe.id_bytes(bpe.MULTI))) == text


def test_bpe_query(spark, tik):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op6_bpe(spark, TABLES).collect():
        ids = tik.encode_ordinary(text[r.doc_id] or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest())


def test_bpe_edges(spark, tik):
    enc = bpe.encode(docs(spark, ODD)).orderBy("doc_id")
    for r, t in zip(enc.collect(), ODD):
        assert r.ids == tik.encode_ordinary(t or "") and len(r.starts) == len(r.ids)
        assert all((t or "")[a:b] for a, b in zip(r.starts, r.ends))
    assert [bytes(r.decoded).decode() for r in bpe.decode(enc).orderBy("doc_id").collect()] == [t or "" for t in ODD]
    assert bpe.digest(docs(spark, ["x"]).limit(0)).count() == 0 and bpe.digest(docs(spark, ODD)).count() == len(ODD)


# -- 7 ---------------------------------------------------------------------------------------------------------


def test_license_rules(spark):
    texts = [
        "# Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy\nThe above copyright notice and this permission notice shall be included in all copies.",
        "under the GNU General Public License, version 2\neither version 2 of the License, or (at your option) any later version", "under the GNU General Public License, version 2", "Licensed under the Apache License, Version 2.0", "the weather is fine", *ODD,
    ]
    got = license_scan.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.licenses for r in got[:6]] == ["MIT", "MIT", "GPL-2.0-or-later", "GPL-2.0", "Apache-2.0", ""]
    assert all(r.licenses == "" and r.n_sentences == 0 for r in got[6:]) and len(got) == len(texts)
    assert license_scan.scan(docs(spark, ["x"]).limit(0)).count() == 0


def test_hints_do_not_depend_on_white_space(spark):
    texts = ["released into the public  domain", "all rights\treserved", "2 or any  later \tversion", "provided  as\tis", "cc\tby 4", "neither  the name of x may be used to endorse or promote"]
    got = license_scan.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.sentence_ids for r in got] == ["<PublicDomain>", "<Reserved>", "<LaterVersion>", "<Warranty>", "<CCBY>", "<BSDendorse>"]


# -- 8 ---------------------------------------------------------------------------------------------------------


def brute_spans(text):
    rules = [
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    out = [(m.start(), k, kind, m.end()) for k, (kind, rule, good) in enumerate(rules) for m in re.finditer(rule, text or "") if good(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


SECRETS = ["password = hunter22 and TOKEN: 'abc.def' api_key:short Token=x", "AKIA" + "A1" * 10 + " AKIAX", "😀 " + "0a" * 12 + " " + "f" * 23, "secret=\"AKIA" + "B" * 20 + "\"", "ſecret=abcdefgh passwd:deadbeefdeadbeefdeadbeef", "-----BEGIN RSA PRIVATE KEY----- http://u:secret1@h"]


def test_secret_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op8_secret_scan(spark, TABLES).collect():
        base = brute_spans(text[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(filter(None, base)) <= set(r.spans.split(","))


def test_secret_edges(spark, tmp_path):
    texts = [*SECRETS, *SECRETS, *ODD]
    ledger = f"file://{tmp_path}/ledger"
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.stop}" for s in r.spans] for r in secret_scan.findings(docs(spark, texts), ledger=ledger).collect()}
    for i, t in enumerate(texts):
        assert [x for x in got[i] if x.split(":")[0] in secret_scan.BASE] == brute_spans(t)
    assert any(x.startswith("private_key") for x in got[5]) and any(x.startswith("url_login") for x in got[5])
    n = spark.read.parquet(ledger).count()
    assert n == len({t or "" for t in texts})
    secret_scan.findings(docs(spark, [*texts, "new"]), ledger=ledger)
    assert spark.read.parquet(ledger).count() == n + 1  # the unseen blob alone
    masked = secret_scan.mask(docs(spark, texts))
    assert masked.columns == docs(spark, texts).columns
    for r in masked.collect():
        assert not brute_spans(r.text) and (r.text == texts[r.doc_id] or "[MASKED:" in r.text)
    assert secret_scan.findings(docs(spark, ["x"]).limit(0)).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------------------


def brute_stats(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op9_quality_rules(spark, TABLES).collect():
        want = brute_stats(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_edges(spark):
    texts = [*ODD, "a\n\na\n b\nb \x0bx\x85y # | <", "a b c d a b c e a b c", "x y z x y z x y z"]
    d = docs(spark, texts).withColumn("__n_words", F.lit(1))
    got = quality.judged(d, []).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert tuple(r["__stats"][c] for c in quality.BASE) == brute_stats(t)
    assert quality.judged(d.limit(0), []).count() == 0


def test_decision_list():
    rng = random.Random(2)
    rows = [{f: rng.random() for f in quality.FEATURES} for _ in range(900)]
    for r in rows:
        r["bad"] = r["symbol_rate"] > 0.8 or r["repeat_rate"] > 0.7 and r["upper_rate"] <= 0.4
    rules = quality.learn(rows)
    wrong = sum(any(x.covers(r) for x in rules) != r["bad"] for r in rows)
    assert rules and wrong <= 45
    assert quality.learn(rows) == rules and quality.learn([]) == [] and quality.learn([r | {"bad": False} for r in rows]) == []


# -- 10 --------------------------------------------------------------------------------------------------------


def shingles(line):
    u = line.encode("utf-16-be")
    return {u[2 * k : 2 * k + 2 * line_dedup.SHINGLE] for k in range(max(1, len(u) // 2 - line_dedup.SHINGLE + 1))}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def brute_lines(texts):
    lines = [(i, p, x) for i, t in texts for p, x in enumerate((t or "").split("\n")) if words(x)]
    holds = collections.defaultdict(set)
    for x in {x for *_, x in lines}:
        for g in shingles(x):
            holds[g].add(x)
    find = closure((a, b) for a, b in {(a, b) for xs in holds.values() for a in xs for b in xs if a < b} if similar(a, b))
    first = {}
    for i, p, x in lines:
        first.setdefault(find(x), (i, p))
    return {(i, p) for i, p, x in lines if first[find(x)] != (i, p)}, len(lines)


def test_lines(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(14)) for _ in range(12)]
    texts = ["\n".join([rng.choice(base), rng.choice(base)[: rng.choice((60, 90, 95))], " ", "x"]) + ("." if i % 3 else "") for i in range(40)] + ODD
    want, n = brute_lines(enumerate(texts))
    got = line_dedup.kept_lines(docs(spark, texts)).collect()
    dropped = {(r.doc_id, p) for r in got for p in r.dropped}
    assert sum(r.n_lines for r in got) == n and dropped <= want and len(dropped) >= 0.97 * len(want)
    d = docs(spark, texts)
    out = line_dedup.dedup(d)
    assert out.columns == d.columns and out.count() == len(texts)
    for r in out.collect():
        kept = [x for p, x in enumerate((texts[r.doc_id] or "").split("\n")) if (r.doc_id, p) not in dropped]
        assert r.text == (None if texts[r.doc_id] is None else "\n".join(kept))
    assert line_dedup.kept_lines(d.limit(0)).count() == 0


@pytest.mark.parametrize("large", [2, 512])
def test_no_candidate_is_left_out(spark, monkeypatch, large):
    """One key for all lines: every pair must then be settled, in a small bucket or through the prefix filter."""
    rng = random.Random(6)
    lines = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(12)) for _ in range(60)]
    # One word in each line changed: many pairs just below and just above the threshold.
    lines += [" ".join("zz" if k == i % 12 else w for k, w in enumerate(x.split())) for i, x in enumerate(lines[:20])] + [x + "!" for x in lines[:20]]
    monkeypatch.setattr(line_dedup, "band_keys", lambda: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(line_dedup, "likely", lambda: F.lit(True))
    monkeypatch.setattr(line_dedup, "LARGE", large)
    got = line_dedup.line_components(docs(spark, lines), Scratch(spark, "t")).collect()
    key = {x: int(np.array([xxhash.xxh64_intdigest(x.encode(), 42)], np.uint64).view(np.int64)[0]) for x in lines}
    find = closure((key[a], key[b]) for i, a in enumerate(lines) for b in lines[:i] if similar(a, b))
    want = {k: find(k) for k in key.values()}
    assert {r.node: r.root for r in got} == {k: r for k, r in want.items() if k != r}


def test_sketches_lose_no_pair_at_the_threshold(spark):
    """Sets of 4 to 2,000 elements and copies with some exchanged: whoever reaches 0.8 is close, few below 0.7 are."""
    rng = random.Random(12)
    sets = {}
    for i in range(300):
        x = {rng.getrandbits(62) for _ in range(rng.choice((4, 5, 9, 40, 150, 300, 2000)))}
        lost = set(rng.sample(sorted(x), int(len(x) * rng.choice((0, 0.1, 0.11, 0.12, 0.2, 0.25)))))
        sets[2 * i], sets[2 * i + 1] = x, x - lost | {rng.getrandbits(62) for _ in lost}
    jaccard = {2 * i: len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(300)}
    sk = line_dedup._sketches(spark.createDataFrame([(i, h) for i, x in sets.items() for h in x], "id bigint, h bigint")).cache()
    other = sk.select((F.col("id") - 1).alias("id"), F.col("e").alias("p_e"), F.col("e_n").alias("p_e_n"))
    close = {r.id for r in sk.join(other, "id").where("id % 2 = 0").where(line_dedup._close(0.8)).collect()}
    assert {i for i, j in jaccard.items() if j >= 0.8} <= close
    far = [i for i, j in jaccard.items() if j < 0.7 and 40 <= len(sets[i]) <= 300]
    assert sum(i in close for i in far) <= 0.2 * len(far) and far


def test_conditions_on_candidates_are_compiled(spark):
    """A generated method of over 8,000 bytes is only interpreted by the JVM: candidates then cost ten times as much."""
    longs = ", ".join(f"{c} bigint" for c in ("id", "band", "root", "e_n", *(f"s{k}" for k in range(line_dedup.MINIMA // 4))))
    d = spark.createDataFrame([], f"{longs}, e array<bigint>").union(spark.createDataFrame([(*([1] * 10), [1] * 8)], f"{longs}, e array<bigint>")).repartition("band")
    p = d.select("band", *(F.col(c).alias(f"p_{c}") for c in d.columns if c != "band")).hint("merge")
    found = d.join(p, "band").where((F.col("id") < F.col("p_id")) & (F.col("root") != F.col("p_root")) & line_dedup.likely() & F.coalesce(line_dedup._close(0.8), F.lit(True)))
    found.collect()
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(found._jdf.queryExecution().executedPlan())
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and max(sizes) < 8000


def test_likely_counts_equal_minima(spark):
    rng = random.Random(13)
    lanes = lambda x: [sum((v & 0x3FFF) << 16 * i for i, v in enumerate(x[k : k + 4])) for k in range(0, line_dedup.MINIMA, 4)]
    rows, same = [], {}
    for i in range(400):
        x = [rng.choice((0, 1, 0x3FFF, 0x2000, rng.getrandbits(14))) for _ in range(line_dedup.MINIMA)]
        y = [v if rng.random() < 0.65 else rng.choice((0, 1, 0x3FFF, 0x2000, v ^ 1)) for v in x]
        same[i] = sum(a == b for a, b in zip(x, y))
        rows.append((i, *lanes(x), *lanes(y)))
    n = line_dedup.MINIMA // 4
    d = spark.createDataFrame(rows, ", ".join(["id int", *(f"s{k} bigint" for k in range(n)), *(f"p_s{k} bigint" for k in range(n))]))
    assert {r.id for r in d.where(line_dedup.likely()).collect()} == {i for i, k in same.items() if k >= line_dedup.AGREE}


def test_buckets_of_two_are_pairs_without_a_join(spark):
    """Whoever agrees in enough minima is a pair; of unlike signatures few are."""
    rng = random.Random(14)
    n, rows, same = line_dedup.MINIMA, [], {}
    lanes = lambda x: [sum(v << 16 * i for i, v in enumerate(x[k : k + 4])) for k in range(0, n, 4)]
    for i in range(400):
        x = [rng.choice((0, 0x3FFF, rng.getrandbits(14))) for _ in range(n)]
        y = [v if rng.random() < i / 400 else rng.getrandbits(14) for v in x]
        same[i] = sum(a == b for a, b in zip(x, y))
        # The ids' order is not that of the rows; one is negative.
        a, b = (i - 400, 7**9 * (i + 1)) if i % 2 else (7**9 * (i + 1), i - 400)
        rows += [(i, a, *lanes(x)), (i, b, *lanes(y))]
    d = spark.createDataFrame(rows, ", ".join(["band bigint", "id bigint", *(f"s{k} bigint" for k in range(n // 4))]))
    got = {(r.a, r.b) for r in line_dedup.pairs_of_two(d).collect()}
    assert {(i - 400, 7**9 * (i + 1)) for i, k in same.items() if k >= line_dedup.AGREE} <= got
    assert sum((i - 400, 7**9 * (i + 1)) in got for i, k in same.items() if k <= 6) <= 0.2 * sum(k <= 6 for k in same.values())


def test_only_lines_of_near_pairs_are_taken_out_for_their_texts(spark, monkeypatch):
    """Lines that share a key by chance are no pair: their texts are not moved or hashed."""
    taken, bucketed = [], Scratch.bucketed

    def seen(self, df, key, label):
        out = bucketed(self, df, key, label)
        taken.extend(r.line for r in out.collect()) if label == "texts" else None
        return out

    monkeypatch.setattr(Scratch, "bucketed", seen)
    monkeypatch.setattr(line_dedup, "band_keys", lambda: F.array(F.lit(1).cast("long")))
    far = ["a line about one thing and no other", "0123456789 8642097531 and so forth"]
    assert not line_dedup.line_components(docs(spark, far), Scratch(spark, "t")).count() and not taken
    near = ["a line about one thing and no other, said twice in a row", "a line about one thing and no other, said twice in a row!"]
    assert line_dedup.line_components(docs(spark, [*near, far[1]]), Scratch(spark, "t")).count() == 1 and sorted(set(taken)) == near


def test_a_bucket_of_two_is_settled_by_its_pivot(spark, monkeypatch):
    """Only buckets that can still hold a pair which was not compared are looked at again."""
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, label="t": saved.append(label) or save(self, df, label))
    member = spark.createDataFrame([(b, 2 * b + i) for b in range(5) for i in (0, 1)], "band bigint, id bigint")
    line_dedup.settle(member, Scratch(spark, "t"), F.lit(True), lambda pairs: pairs.where("a < 0"), lambda ids: ids.withColumn("h", F.col("id")))
    assert "rest" not in saved and "open" in saved


def test_lines_that_are_near_no_pivot_are_not_sketched(spark, monkeypatch):
    """Chance meetings in wide buckets grow with the square of the table; their shingles are not made for a sketch."""
    made, sketches = [], line_dedup._sketches
    monkeypatch.setattr(line_dedup, "_sketches", lambda e: made.append(e.count()) or sketches(e))
    member = spark.createDataFrame([(1, i) for i in range(80)], "band bigint, id bigint")
    near = F.col("id") % 40 == F.col("p_id") % 40
    comp = line_dedup.settle(member, Scratch(spark, "t"), near, lambda pairs: pairs.select("a", "b"), lambda ids: ids.withColumn("h", F.col("id") % 40))
    assert {(r.node, r.root) for r in comp.collect()} == {(i + 40, i) for i in range(40)} and sum(made) < 40


def test_only_what_is_read_later_stays_on_disk(spark, monkeypatch):
    made, init = [], Scratch.__init__
    monkeypatch.setattr(Scratch, "__init__", lambda self, *a: init(self, *a) or made.append(self))
    out = line_dedup.dedup(docs(spark, ["a line that is said\nand another one", "a line that is said"]))
    left = [p for s in made for p in pathlib.Path(s.root.removeprefix("file:")).iterdir()]
    assert [p.name.split("-", 1)[1] for p in left] == ["gone"] and out.count() == 2


def test_lines_that_share_a_key_are_told_apart(spark, monkeypatch):
    """Four keys for all lines: copies still go, different lines stay."""
    monkeypatch.setattr(line_dedup, "key_of", lambda line: F.length(line) % 4)
    lines = [f"line number {i} of {i * 7919}" for i in range(30)]
    got = line_dedup.kept_lines(docs(spark, ["\n".join(lines), "\n".join(reversed(lines)), "unlike them all: this one stays"])).orderBy("doc_id").collect()
    assert [r.n_kept for r in got] == [30, 0, 1]


def test_documents_are_told_apart_by_id_and_text(spark):
    line = lambda k: f"the {k} line is said {k} times {k}"
    rows = [(None, line(1) + "\n" + line(22)), (None, line(333)), (7, line(4444)), (7, line(22) + "\n" + line(55555)), (7, line(4444)), (9, line(333))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = collections.Counter((r.doc_id, r.text) for r in line_dedup.dedup(d).collect())
    assert out == collections.Counter([(None, rows[0][1]), (None, line(333)), (7, line(4444)), (7, line(55555)), (7, line(4444)), (9, "")])


def test_recall_against_all_pairs(spark):
    """All lines of sf0.01, and a hot bucket of lines just below and above the threshold, against an exact join."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(9)
    hot = [f"w{rng.randrange(900)}x" for _ in range(60)]
    texts = [(r.doc_id, r.text) for r in rows]
    for i in range(300):
        x = list(hot)
        for place in rng.sample(range(60), rng.choice((1, 3, 4, 5, 6))):
            x[place] = f"v{rng.randrange(10**6)}"
        texts.append((10**6 + i, " ".join(x)))
    want, n = prefix_lines(texts)
    got = line_dedup.kept_lines(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    dropped = {(r.doc_id, p) for r in got for p in r.dropped}
    copies = n - len({x for _, t in texts for x in (t or "").split("\n") if words(x)})
    assert sum(r.n_lines for r in got) == n and len(want) > copies + 300
    assert len(dropped) <= len(want) and len(dropped) - copies >= 0.97 * (len(want) - copies)


def prefix_lines(texts):
    """``brute_lines`` by an exact prefix filter, for larger tables."""
    lines = [(i, p, x) for i, t in texts for p, x in enumerate((t or "").split("\n")) if words(x)]
    sets = {x: shingles(x) for x in {x for *_, x in lines}}
    df = collections.Counter(g for s in sets.values() for g in s)
    holds, pairs = collections.defaultdict(list), set()
    for x, s in sets.items():
        for g in sorted(s, key=lambda g: (df[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]:
            pairs.update((x, y) for y in holds[g] if 5 * min(len(s), len(sets[y])) >= 4 * max(len(s), len(sets[y])))
            holds[g].append(x)
    find = closure((a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    first = {}
    for i, p, x in sorted(lines, key=lambda r: r[:2]):
        first.setdefault(find(x), (i, p))
    return {(i, p) for i, p, x in lines if first[find(x)] != (i, p)}, len(lines)


def test_short_lines_are_candidates_as_often_as_long_ones(spark):
    """Lines of 8 and 9 characters at a similarity of 4 in 5 shingles, all pairs, share a key."""
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(3000)]
    assert len(shingles(lines[0][:8]) & shingles(lines[0])) == 4 and len(shingles(lines[0])) == 5
    t = spark.createDataFrame([(2 * i + side, x) for i, line in enumerate(lines) for side, x in ((0, line), (1, line[:8]))], "id bigint, line string")
    signed, _ = line_dedup.signatures(t, Scratch(spark, "t"))
    bands = {r.id: set(r.bands) for r in signed.select("id", line_dedup.band_keys().alias("bands")).collect()}
    assert sum(bool(bands[2 * i] & bands[2 * i + 1]) for i in range(len(lines))) >= 0.94 * len(lines)


# -- licences over wrapped lines, and chains against brute force ---------------------------------------------------

MIT = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software. The above copyright notice and this permission
notice shall be included in all copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
copyright notice.
2. Redistributions in binary form must
reproduce the above copyright notice."""
BSD3 = BSD2 + """
3. Neither the name of the holder nor the names of its
contributors may be used to endorse or promote products."""
GPL2 = """This program is free software; you can redistribute it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later
version."""
APACHE = """Licensed under the Apache
License, Version 2.0 (the "License")."""


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_wrapped_licence_headers(spark, mark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-2.0-or-later": GPL2, "Apache-2.0": APACHE, "Apache-2.0,MIT": "under the MIT license or Apache License 2.0", "GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX": "SPDX-License-Identifier: Zlib"}
    d = spark.createDataFrame([(i, "\n".join(mark + x for x in t.split("\n"))) for i, t in enumerate(texts.values())], "doc_id bigint, text string")
    got = license_scan.scan(d).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == list(texts)


def test_licence_sql_says_the_same(spark):
    import duckdb

    con = duckdb.connect()
    texts = [MIT, BSD3, GPL2, APACHE, *ODD, "released into the public  domain", "a\r\n\r\n# cc by\n#\n# all rights\treserved"]
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = con.execute(license_scan.oracle()).fetchall()
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(map(tuple, got.select("doc_id", "sentence_ids", "licenses", "n_sentences").collect())) == sorted(want)


def test_chain_scores_by_brute_force(spark):
    """Every probability from the weights alone, word by word, earlier categories first."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.fit(d, labels, queries.TOXIC)
    assert chain.categories == ("toxic", "toxic_junk") and [len(w) - len(chain.weights[0]) for w in chain.weights] == [0, 1]
    text = {r.doc_id: r.text for r in d.collect()}
    for r in toxicity.score(d, chain).collect():
        has, earlier = toxicity.words(text[r.doc_id]), []
        for name, w, cut in zip(chain.categories, chain.weights, chain.thresholds):
            z = float(w[-1]) + sum(float(w[i]) for x, i in chain.vocabulary.items() if x in has) + sum(float(w[len(chain.vocabulary) + k]) * p for k, p in enumerate(earlier))
            p = 1 / (1 + np.exp(-z))
            assert abs(r[f"p_{name}"] - p) < 2e-4 and (r[name] == (p >= cut) or abs(p - cut) < 2e-4)
            earlier.append(p)


def test_words_are_the_same_in_both_engines(spark):
    texts = ["Grün, naïve ΣΟΦΟΣ x² Ⅷ १२ a_b 中文 don't", None, "", "A1b", "😀é"]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("doc_id", toxicity.words_column(F.col("text")).alias("w")).collect()
    assert {r.doc_id: set(r.w) for r in got} == {i: toxicity.words(t) for i, t in enumerate(texts)}


def test_quality_verdict_is_the_rules(spark):
    """``kept`` is what the learned rules say of each row, and both verdicts occur."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.fit(d, labels)
    out = quality.judged(d, rules).collect()
    for r in out:
        s = r["__stats"].asDict()
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        hit = next((x.keep for x in rules if x.covers(s)), True)
        assert r["__base_failed"] == failed and r["__kept"] == (not failed and hit)
    assert rules and len({r["__kept"] for r in out}) == 2


def test_islands_beat_best_fit(spark):
    """Lengths that fill 11 bins of 100; best fit needs 12."""
    counts, capacity = {17: 3, 47: 4, 31: 1, 5: 1, 36: 1, 13: 5, 4: 1, 26: 3, 19: 4, 21: 5, 2: 2, 35: 2, 23: 2, 3: 1, 33: 1, 27: 5, 45: 1, 9: 1, 6: 1, 41: 1, 12: 1, 8: 1, 24: 2, 1: 1}, 100
    plan = packing.islands(spark, counts, capacity)
    assert packing.bins(packing.best_fit(counts, capacity)) == 12 and packing.bins(plan) == packing.bound(counts, capacity) == 11
    held = collections.Counter()
    for content, n in plan:
        assert sum(content) <= capacity
        for k in content:
            held[k] += n
    assert dict(held) == counts


@pytest.mark.parametrize("name", ["row", "doc", "t", "t1", "k", "lost", "blob", "spans", "__t", "__row", "__stats", "__kept", "__blob", "__gone", "r1", "id", "at"])
def test_inner_names_do_not_clash(spark, name):
    texts = ["password = hunter22 " + " ".join(f"word{i}" for i in range(60)), "x\nx\ny", None]
    d = spark.createDataFrame([(None, t, 7) for t in texts], f"doc_id bigint, text string, `{name}` int")
    for out in (quality.kept_rows(d, []), line_dedup.dedup(d), secret_scan.mask(d), simhash.keep_one(d), simhash.keep_one_alike(d)) if name in ("row", "__t", "id") else (quality.kept_rows(d, []), secret_scan.mask(d)):
        assert out.columns == d.columns and all(r[name] == 7 for r in out.collect())


def test_secret_rules_are_linear_and_versioned():
    import time

    began = time.perf_counter()
    assert secret_scan.find("eyJ" * 200_000) == []
    assert time.perf_counter() - began < 2
    assert secret_scan.find("x eyJabcdefgh.abcdefgh.abcdefgh y") == [("jwt", 2, 31)]


def test_two_appends_of_a_blob_count_once(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    d = docs(spark, SECRETS)
    secret_scan.findings(d, ledger=ledger)
    again = spark.read.parquet(ledger).collect()
    spark.createDataFrame(again, secret_scan._LEDGER).write.mode("append").parquet(ledger)
    assert secret_scan.findings(d, ledger=ledger).count() == len(SECRETS)


def test_keys_are_dealt_once_and_in_parts(spark):
    """Members of all shared buckets, by brute force; a written table for each part of the bands."""
    words = [f"s{k}" for k in range(line_dedup.MINIMA // 4)]
    minima = [F.shiftleft(F.floor(F.col("id") % 97 / (j + 7)).cast("long") + j, 3) for j in range(len(words))]
    signed = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("kind"), *(m.alias(w) for m, w in zip(minima, words)))
    member, parts = line_dedup.buckets(signed, Scratch(spark, "t"))
    groups = {}
    for r in signed.select("id", "kind", line_dedup.band_keys().alias("keys")).collect():
        for key in r.keys:
            groups.setdefault(key & -2 | r.kind, []).append(r.id)
    want = sorted((band, i, len(ids)) for band, ids in groups.items() if len(ids) > 1 for i in ids)
    assert want and sorted((r.band, r.id, r.n) for r in member.collect()) == want
    assert len(parts) == line_dedup.BANDS // line_dedup.AT_ONCE > 1

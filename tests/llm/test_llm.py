"""Document operators: edge cases, brute force, round trips, oracles, held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import DATA, assert_same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, edit_fingerprint, exact_dedup, langid, licenses, line_dedup, packing, queries, simhash, token_scan, toxicity
from tessella.llm.components import connected_components

RANKS, VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, id long, fp string, component string, count long, `key` string"
LONG = "word " * 6000 + "tail"
ROWS = [
    (1, "the same text", "en"), (2, "the same text", "en"), (3, None, None), (4, "", "de"), (5, " \n\t ", "fr"), (6, LONG, "en"), (7, LONG + "!", "en"),
    (8, "Ünïcödé 日本語 😀 — don't\x1cstop", "fr"), (8, "Ünïcödé 日本語 😀 — don't\x1cstop", "fr"), (None, "no id", "es"), (None, "the same text", None), (9, "x" * 3000, "de"), (10, "a\r\n\n  b \n c", "es"), (11, "<|endoftext|>", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, 7, "x", "y", 1, "z") for i, t, lang in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert_same(queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, none, keep):
    found = exact_dedup.exact_dedup(docs, keep=keep).collect()
    assert len(found) == len(ROWS)
    by_text = defaultdict(list)
    for i, t, _ in ROWS:
        by_text[t or ""].append(i)
    pick = min if keep == "min" else max
    want = Counter()
    for ids in by_text.values():
        best = pick([i for i in ids if i is not None], default=None)
        want.update((i, best, len(ids), i == best) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == want
    left = exact_dedup.exact_distinct(docs, keep=keep)
    assert left.columns == docs.columns and sorted((r["text"] or "") for r in left.collect()) == sorted(by_text)
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.exact_distinct(none).count() == 0


def test_bpe_matches_the_libraries(docs, none):
    ranks = bpe.codec(RANKS, PATTERN).ranks
    ref = tiktoken.Encoding("ref", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.bpe_round_trip(docs, RANKS, PATTERN).collect()
    assert [r["doc_id"] for r in found] == [i for i, _, _ in ROWS]
    for r, (_, t, _) in zip(found, ROWS, strict=True):
        assert np.frombuffer(r["ids"], "<u4").tolist() == ref.encode_ordinary(t or "")
        assert bytes(r["decoded"]) == (t or "").encode()
    coded = bpe.bpe_encode(docs, RANKS, PATTERN)
    assert [bytes(r["text"]) for r in bpe.bpe_decode(coded, RANKS, PATTERN).collect()] == [(t or "").encode() for _, t, _ in ROWS]
    assert bpe.bpe_round_trip(none, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("text", ["a\n\u00a0\u00a0b", "a\tb\tc\n\n\nd", "a\rb  c", "a\u3000b\u2003c   d", "a \tb\n\tc", "a\x1cb  c", "a\x85b\n\nc"])
def test_bpe_of_any_white_space(text):
    c = bpe.codec(RANKS, PATTERN)
    ref = tiktoken.Encoding("ref", pat_str=PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert np.frombuffer(c.encode(pa.array([text]))[0].as_py(), "<u4").tolist() == ref.encode_ordinary(text)


def _same_as_tiktoken(texts):
    c = bpe.codec(RANKS, PATTERN)
    ref = tiktoken.Encoding("ref", pat_str=PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    ids = c.encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [ref.encode_ordinary(t) for t in texts]
    assert c.decode(ids).to_pylist() == [t.encode() for t in texts]


def test_bpe_fuzzed():
    rng = random.Random(1)
    _same_as_tiktoken(["".join(rng.choice("ab \n\t\u00a0\u3000\u00e9\u65e5x\r's.,1\0\x85\x1c") for _ in range(rng.randint(0, 30))) for _ in range(3000)])
    _same_as_tiktoken([])
    _same_as_tiktoken(["", ""])


def test_bpe_of_long_words():
    rng = random.Random(2)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [draw("etaoinshrdlu", n) for n in (255, 256, 257, 384, 385, 900, 20_000)] + [draw(["the", "ing", "un", "re"], 500), "x" * 3001, "ab" * 777 + "a", "=" * 3000, "  " * 700]
    texts += [draw([chr(0x4E00 + i) for i in range(900)], 5000), draw([chr(0xE01 + i) for i in range(46)], 5000), *(draw("ab", rng.randint(200, 900)) for _ in range(20))]
    _same_as_tiktoken(texts)


def test_all_white_space_is_known():
    found = {c for c in map(chr, range(0x110000)) if c.isspace() or not "\ud800" <= c <= "\udfff" and bpe.regex.match(r"\s", c)}
    assert found == set(bpe.OTHER_SPACES) | {" ", "\n"}


def _words(line):
    return frozenset(x for x in re.split(r"[ \t\r\f\x0b]+", line) if x)


def test_line_dedup_against_brute_force(spark, none):
    rows = [(3, "a b c d e\nq r s t u v\n\nq r s t u v"), (1, "a b c d e f\nz\n" + " ".join(f"w{i}" for i in range(900))), (2, "a  b c d e g\nz\n" + " ".join(f"w{i}" for i in range(100, 900)) + "\nf e d c b a"), (None, "z y"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line_no int")
    seen, want = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        for k, line in enumerate((t or "").split("\n"), 1):
            w = _words(line)
            if w and any(len(w & s) >= 0.8 * len(w | s) for s in seen):
                gone.append(k)
            if w:
                seen.append(w)
        want[i] = gone
    found = line_dedup.line_dedup(df)
    assert {r["doc_id"]: r["removed"] for r in found.collect()} == want
    texts = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(df, found).collect()}
    assert texts[2] == "a  b c d e g"
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_repeated_and_missing_ids(spark):
    a, b = "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta"
    rows = [(None, a + "\nx"), (None, b), (7, "one two three four five\nq"), (7, "one two three four five six"), (8, "r s t\nr s t"), (8, "r s t\nr s t"), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.line_dedup(df).collect()
    gone = lambda i: sorted(r["removed"] for r in found if r["doc_id"] == i)
    assert len(found) == 7 and gone(None) == gone(7) == [[], [1]] and gone(8) == [[2], [2]] and gone(9) == [[1]]
    texts = sorted(r["text"] for r in line_dedup.without_lines(df, line_dedup.line_dedup(df)).collect())
    assert len(texts) == 7 and texts.count("r s t") == 2 and texts.count("") == sum(r["n_lines"] == 1 and r["removed"] == [1] for r in found)


def test_edit_fingerprints(spark, docs, none):
    found = edit_fingerprint.compare_edited(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), partitions=3).collect()
    rows = sorted({i: t or "" for i, t, _ in ROWS if i is not None}.items(), reverse=True)
    prints = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for k, (i, t) in enumerate(rows):
        new = edit_fingerprint.edited(t, rows[(k + 1) % len(rows)][1])
        assert prints[i]["n_chars"] == len(t) and prints[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= prints[i]["near_edited"] <= 1
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] and prints[3]["fingerprint"] == "0" * 256
    assert prints[6]["near_edited"] > 0.5
    assert edit_fingerprint.compare_edited(none).count() == edit_fingerprint.fingerprints(none).count() == 0
    assert edit_fingerprint.compare_edited(docs.where("doc_id = 1")).first()["near_next"] == 1.0
    assert edit_fingerprint.fingerprints(docs).count() == len(ROWS)


def test_edit_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(2)
    text = lambda: "".join(rng.choice(list("abcdefghijklmnop "), 900))
    base = [text() for _ in range(5)]
    rows = [(k, b) for k, b in enumerate(base)] + [(10 + k, b[:850] + "inserted" + b[850:]) for k, b in enumerate(base)] + [(20, base[0]), (21, None), (22, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 3):
        found = {r["doc_id"]: r["component_id"] for r in edit_fingerprint.near_duplicates(df, block=block).collect()}
        assert found == {**{k: k for k in range(5)}, **{10 + k: k for k in range(5)}, 20: 0, 21: 21, 22: 21}
    assert edit_fingerprint.near_duplicates(none).count() == 0
    assert edit_fingerprint.near_duplicates(docs).count() == len(ROWS)


def _plain_walk(text):
    """The embedding step by step: what is emitted, and the steps taken to the text's end."""
    classes, at, emitted = edit_fingerprint._classes(text), 0, []
    for r in edit_fingerprint._noise(0, 3 * len(text)):
        emitted.append(int(classes[at]))
        at += int(classes[at] != edit_fingerprint.END and int(r) >> int(classes[at]) & 1)
    return emitted, at == len(text)


def test_walks_against_a_plain_one():
    rng = np.random.default_rng(0)
    texts = ["", "a", "ab"] + ["".join(rng.choice(list("abcdefgh \u00e9\u65e5"), 300 + 7 * k)) for k in range(60)] + ["xy" * 3000]
    found = edit_fingerprint._fingerprints(texts)
    for text, digits in zip(texts, found, strict=True):
        emitted, ended = _plain_walk(text)
        assert ended
        places = edit_fingerprint.places(np.array([len(text)]))[0]
        assert digits.tolist() == [0 if not text or emitted[k] == edit_fingerprint.END else 1 + emitted[k] % 15 for k in places]
    alone = np.concatenate([edit_fingerprint._fingerprints([t]) for t in texts])
    assert (found == alone).all()


def test_last_character_is_read():
    texts = ["".join(np.random.default_rng(k).choice(list("abcdefgh "), 400)) for k in range(20)]
    for text in texts:
        (one, _), (two, _) = _plain_walk(text + "q"), _plain_walk(text + "z")
        assert one != two


def test_edit_banding_finds_near_pairs(spark):
    docs = read(spark, "documents").select("doc_id", "text")
    found = {r["doc_id"]: r["component_id"] for r in edit_fingerprint.near_duplicates(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    prints = edit_fingerprint._fingerprints([texts[i] for i in ids])
    near = [(a, b) for k, a in enumerate(ids) for b, x in zip(ids[k + 1 :], edit_fingerprint.likeness(prints[k], prints[k + 1 :]), strict=True) if x >= edit_fingerprint.LIKE]
    assert len(near) > 10 and np.mean([found[a] == found[b] for a, b in near]) >= 0.9
    label = {i: i for i in ids}
    for a, b in near:
        old, new = label[a], label[b]
        label = {i: new if x == old else x for i, x in label.items()}
    assert all(label[i] == label[c] for i, c in found.items())


def test_toxicity_learns(spark, docs, none):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    text = lambda bad: " ".join([*rng.choice(words, 60), *(["vileword"] * bad), *rng.choice(words, 40)])
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.learn(df.where("doc_id < 200").drop("toxic"), df.where("doc_id < 200").select("doc_id", "toxic"))
    held = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df.where("doc_id >= 200"), net).collect()}
    assert np.mean([(held[i] >= 0.3) == y for i, _, y in rows[200:]]) > 0.95
    scored = toxicity.toxicity(docs, net, keep=("lang",)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.toxicity(none, net).count() == 0
    assert toxicity.learn(df, df.where("toxic = 0").select("doc_id", "toxic")).constant < 0.01


def test_gradients_of_the_network():
    net = toxicity.Network({"aa": 1, "bb": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, *_ = net.vectors(["aa", "bb", "cc"])
    x = x.astype(np.float64)
    index, y = np.array([[1, 2, 3] + [0] * 29, [3, 3, 1] + [2] * 29]), np.array([1.0, 0.0])
    g, d_x = net.gradients(x, index, y)
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := net.forward(x, index)[0], 1 - p)))
    for array, grad in [(net.p["Uf"], g["Uf"]), (net.p["Wb"], g["Wb"]), (net.p["A"], g["A"]), (net.p["v"], g["v"]), (net.p["out"], g["out"]), (x, d_x)]:
        at = tuple(n // 2 for n in array.shape)
        was = array[at]
        array[at] = was + 1e-4
        up = loss()
        array[at] = was - 1e-4
        down = loss()
        array[at] = was
        assert abs((up - down) / 2e-4 - grad[at]) < 1e-3


def test_language_id(spark, docs, none):
    all_docs = read(spark, "documents")
    out = langid.held_out("doc_id", 3, 1)
    content = langid.learn(all_docs.where(~out))
    found = langid.classify(all_docs.where(out), content, keep=("lang",)).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.9
    edge = langid.classify(docs, content).collect()
    assert [r["lang_pred"] for r in edge][2:5] == ["und"] * 3 and edge[2]["rejected"]
    assert langid.classify(none, content).count() == 0 and langid.learn(none) == {}
    assert langid.classify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_licenses(spark, none):
    mit = next(t for name, t in licenses.KNOWN if name == "MIT" and len(t) > 500)
    rows = [(1, "Copyright (c) 2020 Somebody\n" + mit.lower().replace(",", " ,")), (2, "prose\n  released under the MIT Licence!\nmore"), (3, None), (4, ""), (None, "Licensed under the Apache License, Version 2.0."), (5, "Released under the MIT License. Not quite.")]
    found = licenses.scan_licenses(spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, license string")).collect()
    assert Counter((r["doc_id"], r["line_no"], r["license"]) for r in found) == Counter([(1, 0, "MIT"), (1, 2, "MIT"), (2, 2, "MIT"), (None, 0, "Apache-2.0"), (None, 1, "Apache-2.0")])
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_of_the_caller(spark):
    known = [("PD", "Dedicated to the public domain."), ("HTTP", "https"), ("X", "zq")]
    df = spark.createDataFrame([(1, "dedicated TO the public-domain"), (2, "http"), (3, "ZQ!"), (4, "other")], "doc_id int, text string")
    assert {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(df, known).collect()} == {(1, "PD"), (2, "HTTP"), (3, "X")}


def test_stock_license_files(spark):
    import textwrap

    whole = {name: t for name, t in licenses.KNOWN if len(t) > 300}
    assert set(whole) >= {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "MIT"}
    titles = {"MIT": "MIT License", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-2-Clause": "The 2-Clause BSD License"}
    texts = [(name, t) for name, t in whole.items()]
    for name, title in titles.items():
        for width in (30, 55, 72, 79, 100):
            body = textwrap.fill(whole[name], width)
            texts.append((name, f"{title}\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n{body}\n"))
            texts.append((name, f"{title}\n\nCopyright 2020 Somebody\n\n" + re.sub(r"\b[123]\. ", "* ", body)))
    apache = "\n\n".join(textwrap.fill(p, 60) for p in whole["Apache-2.0"].split("\n\n"))
    texts += [("Apache-2.0", apache), ("MIT", "The MIT License (MIT)\r\n\r\n" + whole["MIT"]), (None, "MIT License"), (None, whole["MIT"] + " Or not.")]
    found = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")).where("line_no = 0").collect()
    assert {r["doc_id"]: r["license"] for r in found} == {i: name for i, (name, _) in enumerate(texts) if name}


def test_packing(docs, none):
    found = [r.asDict() for r in packing.pack_documents(docs, VOCABULARY, PATTERN, buffer=4000).collect()]
    ref = Tokenizer.from_file(VOCABULARY)
    ref.encode_special_tokens = True
    ids = [*(ref.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _ in ROWS)]
    assert sum(r["length"] for r in found) == sum(map(len, ids))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = Counter(i for i, _, _ in ROWS)
    for key in want:
        own = [x for (i, _, _), x in zip(ROWS, ids, strict=True) if i == key]
        for r in (r for r in found if r["doc_id"] == key):
            assert any(len(x) == r["doc_tokens"] and crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in own)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(none, VOCABULARY, PATTERN).count() == 0


def test_packing_takes_special_strings_as_the_file_does(spark, docs, tmp_path):
    import corpus_pipeline

    rows = [(i, t or "") for i, (_, t, _) in enumerate([*ROWS, (0, "one<|endoftext|> two  <|endoftext|><|endoftext|>\n", ""), (0, "<|endoftext| >", "")])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ref = Tokenizer.from_file(VOCABULARY)
    ids = {i: ref.encode(t, add_special_tokens=False).ids + [0] for i, t in rows}
    assert max(ids[len(ROWS)]) == queries.END_OF_TEXT
    for packed in (queries.op8_packing(spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["packing"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")):
        found = packed.collect()
        assert {r["doc_id"]: r["doc_tokens"] for r in found} == {i: len(x) for i, x in ids.items()}
        for r in found:
            assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]


def _simhash(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark, docs, none):
    found = simhash.simhash_components(docs).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in found) == Counter((i, _simhash(t)) for i, t, _ in ROWS)
    assert {r["component_id"] for r in found if r["fp"] == 0} == {3}
    assert simhash.simhash_components(none).count() == 0


def test_more_groups_for_more_fingerprints():
    assert [simhash.groups_for(n) for n in (0, 10**5, 10**7)] == [7] * 3
    assert 7 < simhash.groups_for(10**9) < simhash.groups_for(10**11)


@pytest.mark.parametrize(("block", "groups"), [(4096, 7), (7, 7), (4096, 9)])
def test_links_lose_none(spark, block, groups):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    fps = {int(c) for c in centres} | {0}
    for c in centres[:3]:
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), groups=groups, block=block)
    assert all((int(r["a"]) ^ int(r["b"])) & (1 << 64) - 1 for r in edges.collect())
    found = {r["node"] & (1 << 64) - 1: r["component"] for r in connected_components(edges).collect()}
    label = {x: {x} for x in fps}
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 4 and label[a] is not label[b]:
                label[a] |= label[b]
                for x in label[b]:
                    label[x] = label[a]
    for a in fps:
        for b in fps:
            assert (found.get(a, a) == found.get(b, b)) == (label[a] is label[b])


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), (2, 1), (None, 4)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9}
    assert connected_components(edges.where("a > 100")).count() == 0
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(path).where("component <> 0").count() == 0


@pytest.mark.parametrize("block", [2, 6, 1 << 18])
def test_token_counts(spark, docs, tmp_path, block):
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    found = token_scan.document_token_counts(stored, VOCABULARY, PATTERN, 50256, block=block).collect()
    ref = Tokenizer.from_file(VOCABULARY)
    ref.encode_special_tokens = True
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == Counter((i, len(ref.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS)
    stored.where("false").write.parquet(f"{tmp_path}/none")
    assert token_scan.document_token_counts(spark.read.parquet(f"{tmp_path}/none"), VOCABULARY, PATTERN, 50256).count() == 0


def test_unfinished_token_stream(spark, tmp_path):
    (tmp_path / "part-00000-x-c000.bin").write_bytes(np.array([5, 6, 9, 9, 7], "<u2").tobytes())
    found = token_scan.token_counts(spark, str(tmp_path), 9, block=4).orderBy("ordinal").collect()
    assert [(r["n_tokens"], r["ended"]) for r in found] == [(2, True), (0, True), (1, False)]


def test_pipeline_against_its_operators(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    stages = dict(corpus_pipeline.STAGES)
    net = toxicity.learn(docs, read(spark, "labels").where(~langid.held_out("doc_id", 4, 2)))
    clean = [r for r in docs.collect() if net.score([r["text"]])[0] < toxicity.THRESHOLD]
    kept = stages["toxicity"](spark, docs, DATA)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in clean}
    one = {}
    for r in clean:
        one[r["text"]] = max(r["doc_id"], one.get(r["text"], -1))
    df = spark.createDataFrame(clean, docs.schema)
    assert {r["doc_id"] for r in stages["exact_dedup"](spark, df, DATA).collect()} == set(one.values())
    prints = {i: _simhash(t) for t, i in one.items()}
    label = {i: {i} for i in prints}
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4 and label[a] is not label[b]:
                label[a] |= label[b]
                for x in label[b]:
                    label[x] = label[a]
    near = stages["simhash_dedup"](spark, df.where(F.col("doc_id").isin(list(one.values()))), DATA)
    assert {r["doc_id"] for r in near.collect()} == {min(s) for s in label.values()}
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.columns[0] == "doc_id" and packed.count() > 0


def test_pipeline_keeps_rows_without_ids_or_labels(spark, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rng = np.random.default_rng(4)
    one, two, three, four = (" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(80)) for _ in range(4))
    rows = [(None, one), (None, two), (None, two.upper()), (None, two), (5, three), (None, three.upper()), (6, three.title()), (7, four), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["doc_id"], (r["text"] or "").lower()) for r in stages["simhash_dedup"](spark, df, "").collect())
    assert found == Counter([(None, one), (None, two), (5, three), (7, four), (None, "")])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stages["toxicity"](spark, df, str(tmp_path)).count() == len(rows)


def test_near_copies_stay_the_same_however_dealt(spark):
    """Rows that share id and text and differ elsewhere: one partitioning after another keeps the same."""
    rows = [(k % 3, "one of the texts " * 9, f"source {k % 7}", {"k": k} if k % 2 else None) for k in range(40)] + [(None, None, f"none {k}", None) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    for kept in (df, df.drop("more")):
        found = {str(sorted(map(str, simhash.simhash_distinct(kept.repartition(n)).collect()))) for n in (1, 3, 8)}
        assert len(found) == 1


CLASHING = "doc_id long, text string, lang string, score double, rejected boolean, lang_pred string, __null string, __id string, __text int, __row int, `key` int, fp long, component_id long, line_no int, removed string, n_tokens int"


def _hard(spark):
    """Nulls in all columns, empty, blank and long texts, ties and repeated rows, names that clash."""
    texts = [(1, "one of the texts " * 9), (2, "one of the texts " * 9), (2, "one of the texts " * 9), (2, "another text of the same id " * 7), (None, None), (None, "no id here at all"), (None, "no id here at all"), (3, ""), (4, " \n\t "), (5, "a\n" * 3000), (6, "w" * 70_000), (7, "long words " * 20_000), (8, None), (-9, "\u65e5\u672c\u8a9e \U0001f600\r\n")]
    return spark.createDataFrame([(i, t, None if i is None else "en", 0.5, None, "xx", None, "x", 1, None, 2, 3, 4, 5, "r", None) for i, t in texts], CLASHING)


def test_hard_rows_through_all_operators(spark, tmp_path):
    _hard(spark).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    turns = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, None), (None, 2, "", " \n"), (2, 1, "assistant", "w" * 70_000), (3, None, "tool", "")]
    spark.createDataFrame([(*t, "x", 1, "y") for t in turns], "conv_id long, turn long, role string, text string, id string, cost int, audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    vectors = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.5, -0.2]), (2, None), (3, [None, 1.0]), (4, []), (5, [float("nan"), 0.0]), (6, [9.0])]
    spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<float>, n int, component string").write.parquet(f"{tmp_path}/embeddings.parquet")
    n = _hard(spark).count()
    for name, query in queries.queries().items():
        found = query(spark, str(tmp_path))
        if name == "op7_licenses":
            assert found.count() == 0
        elif name == "op11_turn_repair":
            assert {r["conv_id"] for r in found.collect()} == {1, 2, 3, None}
        elif name == "op12_whitening":
            assert Counter(r["vec_id"] for r in found.collect()) == {1: 4, None: 2, 6: 1}
        elif name == "op8_packing":
            assert found.where("start = 0").count() == n
        else:
            assert found.count() == n, name
    (tmp_path / "none").mkdir()
    for t in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/none/{t}.parquet")
    for query in queries.queries().values():
        assert query(spark, f"{tmp_path}/none").count() == 0


def test_hard_rows_through_all_stages(spark, tmp_path):
    import corpus_pipeline

    _hard(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {"toxicity": 14, "exact_dedup": 9, "simhash_dedup": 8}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert name == "packing" or found.columns == docs.columns
        assert found.count() == want.get(name, found.count()), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def _plain_packing(sizes, length, quadratic):
    """Whole sequences first; then, from the longest rest, each to the cheapest sequence that holds it, cut if none does."""
    out, seq, rests = [], 0, []
    for d, n in enumerate(sizes):
        for k in range(n // length):
            out.append((d, k * length, length, seq, 0))
            seq += 1
        rests.append([d, n // length * length, n % length])
    total = sum(r[2] for r in rests)
    bins = [[length, 0, 0.0] for _ in range(total // length)] + [[1 << b, 0, 0.0] for b in range(20, -1, -1) if 1 << b < length and total % length >> b & 1]
    for d, at, left in sorted(rests, key=lambda r: -r[2]):
        while left:
            fits = [k for k, (size, used, _) in enumerate(bins) if size - used >= left] or [k for k, (size, used, _) in enumerate(bins) if size > used]
            k = min(fits, key=lambda k: (bins[k][2], k))
            n = min(left, bins[k][0] - bins[k][1])
            out.append((d, at, n, seq + k, bins[k][1]))
            bins[k][1] += n
            bins[k][2] += n + quadratic * n * n
            at, left = at + n, left - n
    return out


def test_packing_against_a_plain_one():
    rng = np.random.default_rng(6)
    for _ in range(20):
        sizes = rng.integers(1, 400, rng.integers(1, 40))
        assert list(map(tuple, packing.pack(sizes, 64, 1 / 256).tolist())) == _plain_packing(sizes.tolist(), 64, 1 / 256)


def test_toxicity_against_a_plain_forward_pass():
    net = toxicity.Network({"aa": 1, "bb": 2, "dd": 3})
    p, size = {k: v.astype(float) for k, v in net.p.items()}, toxicity.STATE
    s = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        raw = b"^" + word.encode() + b"$"
        grams = [toxicity.trigrams([word])[0][k] for k in range(len(raw) - 2)]
        return np.concatenate((p["word"][net.vocabulary.get(word, 0)], np.mean([p["char"][g] for g in grams], axis=0)))

    def states(xs, d):
        h, out = np.zeros(size), []
        for x in xs:
            a, b = x @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            z, r = s(a[:size] + b[:size]), s(a[size : 2 * size] + b[size : 2 * size])
            h = (1 - z) * np.tanh(a[2 * size :] + r * b[2 * size :]) + z * h
            out.append(h)
        return out

    def window(words):
        xs = [vector(w) for w in words]
        h = np.concatenate((states(xs, "f"), states(xs[::-1], "b")[::-1]), axis=1)
        e = np.exp(np.tanh(h @ p["A"]) @ p["v"])
        return s((e / e.sum()) @ h @ p["out"] + p["bias"][0])

    words = ["aa", "bb", "cc", "dd", "other"] * 15
    for n in (1, 7, 32, 33, 75):
        starts = range(0, max(1, n - 31), 1)
        want = max(window(words[:n][k : k + 32]) for k in starts if k in (*range(0, n - 32, 16), max(0, n - 32)))
        assert abs(net.score([" ".join(words[:n])])[0] - want) < 1e-4


def test_language_against_plain_compression():
    import zstandard

    content = {"de": b"der die das und ist nicht ein eine " * 30, "en": b"the of and is not a an this that " * 30, "fr": b"le la les et est pas un une des " * 30}
    made = langid.Compressors(content)
    for text in ["the cat is not a dog", "der Hund ist nicht die Katze", "le chat est un chien", "zzzz qqqq", "x", "the of " * 900 + "der die"]:
        raw, blocks = langid._letters(text).encode(), []
        for k in range(0, len(raw), langid.BLOCK):
            once = raw[k : k + langid.BLOCK] + b" "
            blocks.append(once + bytes(once[i % len(once)] for i in range(langid.REPEATED)))
        sizes = {}
        for lang, words in content.items():
            how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.BLOCK + langid.REPEATED, dict_size=len(words), min_match=langid.SHORTEST, write_checksum=False, write_content_size=False, write_dict_id=False)
            one = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes[lang] = sum(len(one.compress(b)) for b in blocks)
        best, second = sorted(sizes.values())[:2]
        lang, _, rejected = made.predict(text)
        assert sizes[lang] == best and rejected == (second - best <= langid.NARROW * best**0.5)


def test_toxicity_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    scored = {r["doc_id"]: r for r in queries.queries()["op5_toxicity"](spark, folder).where("held_out").collect()}
    marked = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").distinct().collect()
    found = Counter((r["toxic"], scored[r["doc_id"]]["predicted"]) for r in marked if r["doc_id"] in scored)
    assert found[1, 1] >= 0.5 * (found[1, 0] + found[1, 1]) > 0
    assert found[0, 1] <= 0.05 * (found[0, 0] + found[0, 1])

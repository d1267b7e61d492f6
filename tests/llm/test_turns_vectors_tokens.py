"""Turn repair, whitening and token files: brute force, plain formulas, round trips, hard rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import queries, token_parquet, turn_repair, whitening

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ORDER = re.compile(r"(s?(ua)+)?")
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = SPACE.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _all_edits(rows, inserts):
    """Every edit of the rows with up to so many inserts at each place: (cost, audit, repaired turns)."""
    faults = _faults(rows)
    ways = [[(2 * n, "I" * n, list(x)) for n in range(inserts + 1) for x in itertools.product([("user", ""), ("assistant", "")], repeat=n)]]
    for (role, text), fault in zip(rows, faults, strict=True):
        own = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own += [(0 + more, "K", [(role, text)]), (2 + more, "R", [("user", text)]), (2 + more, "R", [("assistant", text)])]
        ways += [own, ways[0]]
    for choice in itertools.product(*ways):
        turns = [t for _, _, made in choice for t in made]
        if ORDER.fullmatch("".join(role[:1] for role, _ in turns)):
            yield sum(c for c, _, _ in choice), "".join(a for _, a, _ in choice), turns


def _plain(rows, inserts):
    """What ``repair_report`` says of one conversation's (turn, role, text) rows, by exhaustive search."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(role, text) for _, role, text in rows]
    faults = Counter(_faults(pairs))
    initials = [role[:1] for role, _ in pairs]
    cost, audit, made = min(_all_edits(pairs, inserts), key=lambda x: x[:2])
    sha = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in made).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, sha)


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3, "z") for r in rows], "conv_id long, turn long, role string, text string, id string, audit string, cost int, `kind` string")


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_against_exhaustive_search(spark):
    rng, rows = random.Random(7), []
    for conv in range(60):
        for turn in range(rng.randint(1, 4)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 1, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["One.", "Two", "Three!", " \t\n", "", "Four? \n", "日本。", "\U0001f600."])))
    rows.append((3, 2, "user", "One."))
    rows += [(99, 1, "user", "Again.")] * 3
    found = {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in turn_repair.repair_report(_turns(spark, rows)).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    assert found.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        assert found[conv] == _plain(own, 1), own
    made = {}
    for r in turn_repair.repair_conversations(_turns(spark, rows)).orderBy("conv_id", "position").collect():
        made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, report in found.items():
        assert hashlib.sha256("\n".join(made.get(conv, [])).encode()).hexdigest() == report[-1]


def test_trie_against_exhaustive_search():
    """Signatures of all letters, with two inserts at a place: more never help."""
    letters = {"s": ("system", "."), "u": ("user", "."), "a": ("assistant", "."), "o": ("tool", "."), "S": ("system", "t"), "U": ("user", "t"), "A": ("assistant", "t"), "O": ("tool", "t"), "e": ("", "."), "E": ("", "t"), "x": ("user", "")}
    signatures = sorted("".join(x) for n in range(4) for x in itertools.product(letters, repeat=n))
    trie = turn_repair.Trie()
    for s in signatures:
        rows = [(letters[c][0], f"{k}{letters[c][1]}" if c != "x" else "") for k, c in enumerate(s)]
        answer = trie.insert(s)
        if len(s) < 3 or zlib.crc32(s.encode()) % 9 == 0:
            assert answer == min(_all_edits(rows, 2 if len(s) < 3 else 1))[:2], s
    assert trie.made == len(signatures) - 1  # a layer for each node but the root


def test_repair_of_long_and_equal_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(30_000)] + [(2, t, "user", "The same.") for t in range(30_000)] + [(c, 0, "user", "Hello") for c in range(3, 500)]
    found = {r["conv_id"]: r for r in turn_repair.repair_report(_turns(spark, rows)).collect()}
    assert found[1]["audit"] == "K" * 30_000 and found[1]["cost"] == 0
    assert found[2]["duplicate"] == 29_999 and found[2]["cost"] == 3 * 29_999 + 2
    assert {(found[c]["audit"], found[c]["cost"], found[c]["truncated"]) for c in range(3, 500)} == {("D", 3, 1)}  # as cheap as KI, and less in ASCII


def test_damage_and_missing_rows(spark):
    rows = [(c, t, None if t == 3 else "assistant", None if t == 2 else "Is it? Yes! So.") for c in range(12) for t in (None, 0, 1, 2, 3)]
    df = _turns(spark, rows)
    want = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how:
            want += [(c, t, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)] * (2 if how == 3 else 1)
    got = turn_repair.damage(df)
    assert got.columns == ["conv_id", "turn", "role", "text"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    none = turn_repair.repair_report(df.where("false"), ids=df.select("conv_id")).collect()
    assert len(none) == 12 and {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert turn_repair.repair_report(df.where("false")).count() == turn_repair.repair_conversations(df.where("false")).count() == 0


def test_repair_query_on_given_rows(spark):
    """All conversations of the table, damaged by Python and repaired by a plain search over states."""
    found = {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in queries.op11_turn_repair(spark, DATA).collect()}
    by_conv = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        own = by_conv.setdefault(r["conv_id"], [])
        how, role, text = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20, r["role"], r["text"]
        if how:
            own += [(r["turn"], "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)] * (2 if how == 3 else 1)
    assert found.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        if len(own) <= 4:
            assert found[conv] == _plain(own, 1)
        else:
            assert found[conv][:5] == _plain_counts(own)


def _plain_counts(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, turns = Counter(_faults([r[1:] for r in rows])), {r[0] for r in rows}
    return (max(turns) - min(turns) + 1 - len(turns), faults["blank"], faults["duplicate"], faults["truncated"], sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)))


def _whole(vectors):
    return np.floor(np.array(vectors, float) * 256).astype(np.int64)


def _check_whitening(rows, found, components=4):
    """Against numpy over the distinct vectors; eigenvectors may have either sign."""
    good = [(i, _whole(v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.unique(np.stack([v for _, v in good]), axis=0)
    n, sums = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == len(good) * min(components, x.shape[1])
    want = Counter((i, int(((n * v - sums) ** 2).sum())) for i, v in good for _ in range(min(components, x.shape[1])))
    assert Counter((r["vec_id"], r["deviation"]) for r in found) == want
    by_id = dict(good)
    for k in range(min(components, x.shape[1])):
        own = [r for r in found if r["component"] == k + 1]
        made = np.array([r["whitened"] for r in own])
        plain = np.array([(by_id[r["vec_id"]] - sums / n) @ vectors[:, k] / np.sqrt(values[k]) for r in own])
        assert min(np.abs(made - plain).max(), np.abs(made + plain).max()) < 1e-6
        assert all(r["n"] == n and abs(r["explained"] - values[k] / values.sum()) < 1e-9 and r["identity_error"] < 1e-4 for r in own)


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    _check_whitening(rows, queries.op12_whitening(spark, DATA).collect())


def test_whitening_of_hard_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(v) for v in rng.normal(size=3) * (3, 2, 1)]) for i in range(80)]
    rows += [(80, rows[0][1])] * 50 + [(2**60 + 1, rows[1][1]), (81, None), (82, [1.0, None, 2.0]), (83, [1.0, float("nan"), 2.0]), (84, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, component int, x string, n int")
    _check_whitening(rows, whitening.whiten(df).collect())
    more = df.unionByName(spark.createDataFrame([(None, [0.1, 0.2, 0.3], 1, "x", 2), (90, [], 1, "x", 2), (91, [1.5], 1, "x", 2), (92, [2.5], 1, "x", 2), (93, [1.0, 2.0], 1, "x", 2)], df.schema))
    found = whitening.whiten(more).collect()
    by_id = {(r["vec_id"], r["component"]): r for r in found}
    assert sum(r["vec_id"] is None for r in found) == 3 and (90, 1) not in by_id
    assert abs(abs(by_id[91, 1]["whitened"]) - 1) < 1e-12 and by_id[91, 1]["n"] == 2 and by_id[91, 1]["deviation"] == 256**2
    assert [by_id[93, k]["whitened"] for k in (1, 2)] == [0, 0] and by_id[93, 1]["explained"] == by_id[93, 1]["identity_error"] == 0
    assert whitening.whiten(df.where("false")).count() == 0


def test_whitening_of_very_large_entries(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [1e300, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 6 and {r["deviation"] for r in found} == {None}
    ones = whitening.Fit(3, [1, 2], np.zeros(0), np.zeros((2, 0)), 0.0)
    assert ones.centred(np.array([[2**31, 5]]))[1] == [None] and ones.centred(np.array([[2**30, 5]]))[1] == [None]
    assert ones.centred(np.array([[2**29, 5]]))[1] == [(3 * 2**29 - 1) ** 2 + 13**2]


SCHEMA = "doc_id long, text string, start string, part int, tokens string, `id` int"
TEXTS = [(7, "the same text"), (3, None), (3, ""), (3, "other <|endoftext|> text"), (None, "no id"), (None, "no id"), (None, "none either"), (1, "word " * 30_000), (2, "日本語 \U0001f600\r\n \n"), (-9, " "), (2**40, "last")]


def _encoder():
    made = Tokenizer.from_file(VOCABULARY)
    return lambda t: [*made.encode(t or "", add_special_tokens=False).ids, 2]


def _docs(spark, rows=None):
    return spark.createDataFrame([(i, t, "s", 1, "t", 2) for i, t in TEXTS], SCHEMA)


@pytest.mark.parametrize("encoding", token_parquet.ENCODINGS)
def test_token_files(spark, tmp_path, encoding):
    coded, ids = _encoder(), []
    token_parquet.write_tokens(_docs(spark).repartition(3), f"{tmp_path}/t", VOCABULARY, PATTERN, 2, encoding=encoding)
    back = token_parquet.read_documents(spark, f"{tmp_path}/t", "tokens").orderBy("start").collect()
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in back) == Counter((i, tuple(coded(t))) for i, t in TEXTS)
    known = [r["doc_id"] for r in back]
    assert known == sorted(known, key=lambda i: (i is not None, i or 0))
    for r in back:
        assert r["start"] == len(ids) and r["n_tokens"] == len(r["tokens"])
        ids += r["tokens"]
    for begin, end in [(0, len(ids)), (5, 9), (len(ids) - 4, len(ids) + 9), (20_000, 29_000), (7, 7), (len(ids), len(ids) + 1)]:
        made = [x for r in token_parquet.read_range(spark, f"{tmp_path}/t", begin, end).orderBy("start").collect() for x in r["tokens"]]
        assert made == ids[begin:end]
    kinds = {c: set() for c in ("doc_id", "tokens.list.element")}
    for file in sorted((tmp_path / "t").glob("part-*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            for k in range(meta.num_columns):
                col = meta.row_group(g).column(k)
                assert col.has_offset_index and col.has_column_index
                kinds.setdefault(col.path_in_schema, set()).update(col.encodings)
    assert ("RLE_DICTIONARY" in kinds["tokens.list.element"]) == (encoding == "dictionary")
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"]


def test_row_groups_and_pruned_reads(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.sha2(F.format_string("%05d %d", "id", F.lit(k)), 256) for k in range(4))).alias("text"))
    token_parquet.write_tokens(docs.coalesce(1), f"{tmp_path}/t", VOCABULARY, PATTERN, 2, row_group=64 << 10, page=4 << 10)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "t").glob("part-*.parquet")]
    assert max(groups) > 2
    before = token_parquet.read_documents(spark, f"{tmp_path}/t").where("doc_id < 1234").agg(F.sum("n_tokens")).first()[0]
    one = token_parquet.read_documents(spark, f"{tmp_path}/t", "tokens", where=F.col("doc_id") == 1234)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,1234)" in plan
    assert one.count() == 1 and one.first()["start"] == before
    lean = token_parquet.read_documents(spark, f"{tmp_path}/t")
    assert "tokens:array" not in lean._jdf.queryExecution().executedPlan().toString()


def test_token_query(spark):
    coded, at = _encoder(), 0
    found = {r["doc_id"]: r for r in queries.op13_token_parquet(spark, DATA).collect()}
    rows = sorted(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    assert len(found) == len(rows)
    for i, text in rows:
        ids = coded(text)
        assert tuple(found[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_tokens_of_nothing(spark, tmp_path):
    none = _docs(spark).where("false")
    assert token_parquet.document_tokens(none, VOCABULARY, PATTERN, 2).count() == 0
    with pytest.raises(ValueError, match="encoding"):
        token_parquet.write_tokens(none, f"{tmp_path}/t", VOCABULARY, PATTERN, 2, encoding="plain")

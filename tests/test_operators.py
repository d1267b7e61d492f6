"""Rules in small tables of input and expected result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import arabic, text, unicode, verdict
from tessella.operators import dictionary, ledger, lexicon, morphology, quality, sequence
from tessella.sources import readers, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("word", "patterns", "gate"),
    [
        ("كَتَبَ", ["CV", "CV", "CV"], "ACCEPT"),
        ("كَتَّبَ", ["CVC", "CV", "CV"], "ACCEPT"),
        ("قَالَ", ["CVV", "CV"], "ACCEPT"),
        ("كَتَبُوا", ["CV", "CV", "CVV", "FARQA"], "ACCEPT"),
        ("انْتَظَرُوا", ["WASL", "C", "CV", "CV", "CVV", "FARQA"], "DEFER"),
        ("", [], "DEFER"),
    ],
)
def test_syllables(spark, word, patterns, gate):
    slots = one(spark, lambda c: arabic.syllables(arabic.phones(c)), word)
    assert [s["pattern"] for s in slots] == patterns
    assert one(spark, lambda c: arabic.word_gate(arabic.syllables(arabic.phones(c))), word) == gate


@pytest.mark.parametrize(("word", "norm"), [("كَتَّبَ", "كَتْتَبَ"), ("آمَنُوا", "ءَامَنُوا"), ("الكتاب", "ءَلكتاب"), ("رَدَّ", "رَدْدَ"), ("abc", "abc"), (None, None)])
def test_normalize(spark, word, norm):
    assert one(spark, arabic.normalize, word) == norm


@pytest.mark.parametrize(("word", "form"), [("كَتَّبَ", "FORM_II"), ("كَاتَبَ", "FORM_III"), ("أَكْرَمَ", "FORM_IV"), ("تَعَلَّمَ", "FORM_V"), ("تَفَاهَمَ", "FORM_VI"), ("اِنْكَسَرَ", "FORM_VII"), ("اِجْتَمَعَ", "FORM_VIII"), ("اِسْتَخْرَجَ", "FORM_X"), ("كَتَبَ", None)])
def test_augmented_form(spark, word, form):
    assert one(spark, morphology.augmented_form, word) == form


def test_spans(spark):
    entries = one(spark, arabic.align_spans, "كَتَّبَ")
    assert [(e["raw_start"], e["raw_end"], e["norm_start"], e["norm_end"], e["op"]) for e in entries] == [(0, 2, 0, 2, "IDENTITY"), (2, 5, 2, 6, "EXPAND"), (5, 7, 6, 8, "IDENTITY")]
    p = one(spark, lambda c: arabic.project_span(arabic.align_spans(c), F.lit(5), F.lit(7)), "كَتَّبَ")
    assert tuple(p) == (6, 8)
    assert tuple(one(spark, lambda c: arabic.project_span(arabic.align_spans(c), F.lit(20), F.lit(30)), "كَتَّبَ")) == (20, 30)


@pytest.mark.parametrize(("marks", "state"), [(["VOWEL"], "EXPLICIT_VOWEL"), (["SHADDA", "VOWEL"], "EXPLICIT_VOWEL"), (["VOWEL", "SUKUN"], "CONFLICT"), (["TANWIN"], "TANWIN"), (["SHADDA"], "SHADDA_COMPOUND"), ([], "ABSENT")])
def test_mark_state(spark, marks, state):
    assert one(spark, arabic.mark_state, marks, "array<string>") == state


def test_marks_compatible(spark):
    rows = spark.createDataFrame([("كتب", "كَتَبَ", True), ("كُتب", "كَتَبَ", False), ("كَتب", "كَتَبَ", True), ("كتبا", "كَتَبَ", False)], "a string, b string, y boolean")
    assert rows.where(arabic.marks_compatible(F.col("a"), F.col("b")) != F.col("y")).count() == 0


def test_conjugation_of_a_sound_verb(spark):
    verbs = spark.createDataFrame([(["ض", "ر", "ب"], "BAB_II_DARABA"), (["ق", "و", "ل"], "BAB_I_NASARA")], "root array<string>, bab_id string")
    forms = morphology.conjugate(verbs)
    assert forms.count() == 2 * 64 * 2
    pick = forms.where("bab_id = 'BAB_II_DARABA' and voice = 'ACTIVE' and person = '2' and number = 'SG' and gender = 'F'")
    assert {(r["tense"], r["mood"], r["surface"]) for r in pick.collect()} == {("PAST", None, "ضَرَبْتِ"), ("IMPERFECT", "INDICATIVE", "تَضْرِبِينَ"), ("IMPERFECT", "SUBJUNCTIVE", "تَضْرِبِي"), ("IMPERFECT", "JUSSIVE", "تَضْرِبِي")}
    hollow = forms.where("bab_id = 'BAB_I_NASARA'")
    assert hollow.where("surface is null").count() == hollow.where("voice = 'PASSIVE'").count() == 64


def test_nfc_and_null(spark):
    assert one(spark, unicode.nfc, "é") == "é"
    assert one(spark, unicode.nfc, None) is None


def test_clean_order_and_toggles(spark):
    assert one(spark, text.clean, "<b>See</b>  https://x.y Z-9!") == "see z9"
    assert one(spark, lambda c: text.clean(c, numbers=True, lowercase=False), "A 1 b2") == "A b"
    assert one(spark, text.clean, None) is None
    assert one(spark, text.sentences, "A b. C? D!") == ["A b.", "C?", "D!"]


def test_tokens_keep_protected_words(spark):
    found = one(spark, lambda c: text.tokens(c, ".,!", ["un"], lambda w: w, ["under"]), "(undo, under. un")
    assert [(t["surface"], t["kind"]) for t in found] == [("(undo", "word"), (",", "punct"), ("under", "word"), (".", "punct"), ("un", "word")]


def test_verdict_lattice_is_monotone(spark):
    up, gate = ["BLOCKED", "DEFERRED", "RESIDUAL", "ACCEPT"], ["BLOCKED", "DEFERRED", "RESIDUAL", "LICENSED"]
    rows = spark.createDataFrame([(u, g) for u in up for g in gate], "u string, g string").withColumn("v", verdict.compose(F.col("u"), F.col("g")))
    assert rows.where("v = 'LICENSED' and u <> 'ACCEPT'").count() == 0
    assert rows.where("(u = 'BLOCKED' or g = 'BLOCKED') and v <> 'BLOCKED'").count() == 0
    assert one(spark, verdict.worst_of, [], "array<string>") == "ACCEPT"


def test_keys_do_not_depend_on_partitions(spark):
    df = spark.range(100).select(verdict.claim_key(F.col("id").cast("string"), F.lit("s"), F.lit("r")).alias("k"))
    assert {r["k"] for r in df.collect()} == {r["k"] for r in df.repartition(7).collect()}


@pytest.mark.parametrize("partitions", [1, 8])
def test_sequence_operators_on_any_partitioning(spark, partitions):
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("a and b c or not d and".split())], "seq int, pos int, surface string").repartition(partitions)
    markers = spark.createDataFrame([("and", "CONJUNCTION", 1)], "marker string, boundary string, priority int")
    found = sequence.group_clauses(sequence.boundaries(tokens, markers), "seq", "pos").orderBy("clause").collect()
    assert [(r["token_start"], r["token_end"], r["surface"], r["operator"]) for r in found] == [(1, 1, "a", "and"), (2, 7, "and b c or not d", "and"), (8, 8, "and", None)]
    moods = spark.createDataFrame([("not", "JUSSIVE"), ("or", "SUBJUNCTIVE")], "marker string, mood string")
    carried = sequence.carry_mood(tokens, moods, "seq", "pos", negators=["not"], after=["or"]).where("carried_mood is not null").collect()
    assert [(r["surface"], r["carried_mood"]) for r in carried] == [("not", "SUBJUNCTIVE")]


def test_ledger_has_all_stages(spark):
    dense = ledger.densify(spark.createDataFrame([(1, 1, "EXECUTED_APPROVED"), (2, 16, "EXECUTED_APPROVED")], "item int, ordinal int, status string"), "item")
    assert dense.count() == 2 * 19 and ledger.missing_stages(dense, "item").count() == 0
    assert dense.where("ordinal = 16 and executed").count() == 0


def test_ambiguous_key_is_no_match(spark):
    words = spark.createDataFrame([(1, "a"), (2, "b")], "id int, w string")
    table = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "key string, entry string")
    assert [tuple(r) for r in lexicon.tiered_lookup(words, "id", [("T", F.col("w"), table, True)]).collect()] == [(2, "T", "z", 1)]
    found = {r["id"]: r["status"] for r in lexicon.lookup_or_collide(words, "id", [("T", F.col("w"), table)]).collect()}
    assert found == {1: "COLLISION", 2: "FOUND"}


def test_lexicon_queries_take_words_of_any_length(spark, tmp_path):
    from tessella.plans import lexicon_queries

    words = {"Weltanschauungen", "internationalisationing", "situaciónungs", "cat", "x" * 40 + "ings"}
    entries = {"weltanschauungen", "Weltanschau", "internationalisa", "situación", "x" * 40}
    for name, ws in (("documents", words), ("benchmark", entries)):
        spark.createDataFrame([(" ".join(sorted(ws)),)], "text string").write.parquet(f"{tmp_path}/{name}.parquet")
    suffixes = [s for (s,) in lexicon_queries._SUFFIXES]

    def ways(stem, taken=(), depth=3):
        yield stem, "+".join(taken)
        for s in suffixes if depth else ():
            if stem.endswith(s) and len(stem) - len(s) >= 2:
                yield from ways(stem[: len(stem) - len(s)], (s, *taken), depth - 1)

    run = lambda f: [tuple(r) for r in f(spark, str(tmp_path)).collect()]
    assert sorted(run(lexicon_queries.suffix_ways)) == sorted((w, *x) for w in words for x in ways(w))
    known = {w: [x for x in ways(w) if x[0] in entries] for w in words}
    verdict = lambda k: ("CLOSED", *k[0]) if len(k) == 1 else ("AMBIGUOUS" if k else "OPEN", None, None)
    assert sorted(run(lexicon_queries.chosen_segmentation), key=str) == sorted(((w, *verdict(k)) for w, k in known.items()), key=str)
    assert run(lexicon_queries.tiered_lookup) == [("Weltanschauungen", "NORMALISED", "weltanschauungen", 1)]
    assert {r[0]: r[3] for r in run(lexicon_queries.colliding_lookup)} == {w: "FOUND" if w == "Weltanschauungen" else "NOT_FOUND" for w in words}


def test_quality_helpers_on_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert quality.first_wins(empty, F.col("k"), ["v"]).count() == 0
    assert quality.snapshot_diff(empty, empty, "k", ["v"]).count() == 0
    assert quality.invariants(empty, {"neg": F.col("v") < 0}, F.col("k")).collect()[0]["n"] == 0


def test_group_lines_by_running_mean(spark):
    obs = spark.createDataFrame([("p", 1, 0.0, 0.900, "a", 0.5), ("p", 2, 1.0, 0.905, "b", 0.5), ("p", 3, 0.0, 0.5, "c", 0.9)], "page string, obs_id int, x double, y double, text string, confidence double")
    lines = dictionary.merge_lines(dictionary.group_lines(obs)).orderBy("line").collect()
    assert [r["text"] for r in lines] == ["a b", "c"]


def test_group_lines_of_a_long_page_in_order(spark):
    rng = __import__("random").Random(5)
    rows = [(rng.choice(["p", "q", None]), i, rng.choice([None, float("nan"), *[rng.random() for _ in range(20)]])) for i in range(3000)]
    want = {}
    for page in ("p", "q", None):
        lines = []
        for _, i, v in sorted((r for r in rows if r[0] == page), key=lambda r: (r[2] is None or r[2] != r[2], -(r[2] or 0) if r[2] == r[2] else 0, r[1])):
            k = next((k for k in range(len(lines) - 1, -1, -1) if v is not None and abs(lines[k][1] - v) <= 0.01), len(lines))
            if k == len(lines):
                lines.append([0, float("nan") if v is None else v])
            n, mean = lines[k]
            lines[k] = [n + 1, mean if n == 0 else mean + (v - mean) / (n + 1)]
            want[i] = k
    lined = dictionary.group_lines(spark.createDataFrame(rows, "page string, obs_id int, y double"))
    assert {r["obs_id"]: r["line"] for r in lined.collect()} == want
    assert "FlatMapGroupsInPandas" not in lined._jdf.queryExecution().toString()


@pytest.mark.parametrize("partitions", [1, 5])
def test_entries_number_headings_by_document(spark, tmp_path, partitions):
    from tessella.plans import dictionary_queries

    long = "x" * 50
    texts = {1: "\n".join(["A one", *[long] * 100001, "B last of the first"]), 2: "\n".join([long + " License", "C", long]), 3: long, 4: "D\n" + long + " licensed"}
    rows = [("s", i, t) for i, t in texts.items()] + [(None, 7, "E\n" + long), ("t", 9, None), ("t", 10, long)]
    spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(partitions).write.parquet(f"{tmp_path}/documents.parquet")
    df = dictionary_queries.dictionary_entries(spark, str(tmp_path))
    found = {(r["source"], r["entry"]): (r["heading"], r["n_lines"], r["origin"]) for r in df.collect()}
    lic = long + " License"
    assert found == {("s", 1): ("A one", 100001, None), ("s", 2): ("B last of the first", 1, lic), ("s", 3): ("C", 2, None), ("s", 4): ("D", 1, long + " licensed"), (None, 1): ("E", 1, None)}


def test_readers_and_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x")], "id int, tags array<string>, note string")
    sinks.write_json(df, f"{tmp_path}/j", one_file=True)
    back = readers.json_lines(spark, f"{tmp_path}/j", df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_csv(df, f"{tmp_path}/c", one_file=True)
    assert {r["tags"] for r in readers.csv_strings(spark, f"{tmp_path}/c", ["id", "tags", "note"]).collect()} == {"a; b", None}
    sinks.write_table(df, f"{tmp_path}/t", ["id"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    (tmp_path / "cat.json").write_text('{"rows": [{"id": "a"}, {"id": "a"}]}')
    with pytest.raises(ValueError):
        readers.catalog(spark, f"{tmp_path}/cat.json", "rows array<struct<id:string>>", "rows", "id")
    (tmp_path / "l.txt").write_text(" a \n\n b\n")
    assert [r[0] for r in readers.text_lines(spark, f"{tmp_path}/l.txt").collect()] == ["a", "b"]
    found = readers.digests(spark, f"{tmp_path}/l.txt")
    assert readers.drifted(found, found.withColumn("sha256", F.lit("0"))).collect()[0]["problem"] == "DRIFTED"


def test_writes_that_are_refused_change_nothing(spark):
    writes = [(5.0, "a"), (3.0, "a"), (3.0, "a"), (2.0, "end"), (9.0, "a"), (9.0, "b"), (None, "a"), (9.5, "end"), (10.0, "a"), (9.5, "a")]
    log = spark.createDataFrame([("u", i, v, s, i != 8) for i, (v, s) in enumerate(writes)], "field string, at long, v double, s string, own boolean")
    judge = lambda **kw: [r["outcome"] for r in ledger.guarded_writes(log, "field", "at", "v", "s", ["end"], F.col("v"), **kw).orderBy("at").collect()]
    assert judge() == ["WRITTEN", "DOWNGRADE", "DOWNGRADE", "DOWNGRADE", "WRITTEN", "IDEMPOTENT", "DOWNGRADE", "WRITTEN", "TERMINAL", "IDEMPOTENT"]
    assert judge(allowed=F.col("own"))[8] == "NON_OWNER"
    assert judge(filled="a") == ["WRITTEN", "VALUE_CHANGE", "VALUE_CHANGE", "DOWNGRADE", "VALUE_CHANGE", "WRITTEN", "DOWNGRADE", "WRITTEN", "TERMINAL", "IDEMPOTENT"]


def test_write_guard_stream_equals_batch(spark, tmp_path):
    from tessella.streaming import stateful

    log = spark.createDataFrame([("u", i, v, s) for i, (v, s) in enumerate([(1.0, "a"), (1.0, "a"), (3.0, "a"), (2.0, "a"), (5.0, "end"), (9.0, "a")])], "field string, at long, v double, s string")
    batch = ledger.guarded_writes(log, "field", "at", "v", "s", ["end"], F.col("v")).select("field", "at", "outcome")
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful.write_guard(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in").withColumn("rank", F.col("v")), "field", "at", "v", "s", ["end"], "rank")
    query = stream.writeStream.format("memory").queryName("guarded").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("guarded").collect())) == sorted(map(tuple, batch.collect()))


def test_weak_verbs_by_the_grammar(spark):
    verbs = [("قول", "BAB_I_NASARA"), ("بيع", "BAB_II_DARABA"), ("دعو", "BAB_I_NASARA"), ("رمي", "BAB_II_DARABA"), ("وعد", "BAB_II_DARABA"), ("مدد", "BAB_I_NASARA"), ("ءكل", "BAB_I_NASARA"), ("سءل", "BAB_III_FATAHA")]
    rows = morphology.conjugate(spark.createDataFrame([(list(r), b) for r, b in verbs], "root array<string>, bab_id string")).collect()
    form = {("".join(r["root"]), r["tense"], r["mood"], r["voice"], r["person"] + r["number"] + r["gender"]): r["surface"] for r in rows}
    past = lambda root: [form[root, "PAST", None, "ACTIVE", k] for k in ("3SGM", "3SGF", "3DUM", "3DUF", "3PLM", "3PLF", "1SGM")]
    assert past("قول") == ["قَالَ", "قَالَتْ", "قَالَا", "قَالَتَا", "قَالُوا", "قُلْنَ", "قُلْتُ"]
    assert past("بيع") == ["بَاعَ", "بَاعَتْ", "بَاعَا", "بَاعَتَا", "بَاعُوا", "بِعْنَ", "بِعْتُ"]
    assert past("دعو") == ["دَعَا", "دَعَتْ", "دَعَوَا", "دَعَتَا", "دَعَوْا", "دَعَوْنَ", "دَعَوْتُ"]
    assert past("رمي") == ["رَمَى", "رَمَتْ", "رَمَيَا", "رَمَتَا", "رَمَوْا", "رَمَيْنَ", "رَمَيْتُ"]
    assert past("مدد") == ["مَدَّ", "مَدَّتْ", "مَدَّا", "مَدَّتَا", "مَدُّوا", "مَدَدْنَ", "مَدَدْتُ"]
    now = lambda root, mood, *keys: [form[root, "IMPERFECT", mood, "ACTIVE", k] for k in keys]
    assert now("قول", "INDICATIVE", "3SGM", "3PLM", "3PLF", "2SGF") == ["يَقُولُ", "يَقُولُونَ", "يَقُلْنَ", "تَقُولِينَ"]
    assert now("قول", "JUSSIVE", "3SGM", "3PLM") == ["يَقُلْ", "يَقُولُوا"]
    assert now("دعو", "INDICATIVE", "3SGM", "3DUM", "3PLM", "3PLF", "2SGF") == ["يَدْعُو", "يَدْعُوَانِ", "يَدْعُونَ", "يَدْعُونَ", "تَدْعِينَ"]
    assert now("دعو", "SUBJUNCTIVE", "3SGM", "3DUM", "3PLM") == ["يَدْعُوَ", "يَدْعُوَا", "يَدْعُوا"]
    assert now("رمي", "JUSSIVE", "3SGM", "2SGF", "3PLM", "3PLF") == ["يَرْمِ", "تَرْمِي", "يَرْمُوا", "يَرْمِينَ"]
    assert now("وعد", "INDICATIVE", "3SGM", "3PLF") == ["يَعِدُ", "يَعِدْنَ"] and form["وعد", "IMPERFECT", "INDICATIVE", "PASSIVE", "3SGM"] == "يُوعَدُ"
    assert now("مدد", "INDICATIVE", "3SGM", "3PLM", "3PLF") == ["يَمُدُّ", "يَمُدُّونَ", "يَمْدُدْنَ"] and now("مدد", "JUSSIVE", "3SGM") == ["يَمُدَّ"]
    assert past("ءكل")[0] == "أَكَلَ" and past("سءل")[0] == "سَأَلَ" and form["سءل", "PAST", None, "PASSIVE", "3SGM"] == "سُئِلَ"
    assert form["قول", "PAST", None, "PASSIVE", "3SGM"] is None
    asked = spark.createDataFrame([(list(r), v) for r, v in [("كتب", "ُ"), ("قول", "ُ"), ("بيع", "ِ"), ("دعو", "ُ"), ("رمي", "ِ"), ("وعد", "ِ"), ("مدد", "ُ"), ("وقي", "ِ")]], "root array<string>, v string")
    assert [r[0] for r in asked.select(morphology.imperative(F.col("root"), F.col("v"))).collect()] == ["اُكْتُبْ", "قُلْ", "بِعْ", "اُدْعُ", "اِرْمِ", "عِدْ", "مُدَّ", None]


def test_claim_keys_equal_json_hashes(spark):
    import hashlib
    import json

    from tessella.operators import claims

    rows = [(1, 'a"b\\c', "كتب", ["e2", "e1"]), (2, "x", None, None), (3, None, "ÿ\t", [])]
    df = spark.createDataFrame(rows, "id int, host string, root string, ev array<string>")
    slots = claims.typed_slots({"SEGMENT_HOST": F.array("host"), "LEMMA_SLOT": F.array("root", "root")})
    found = {r["id"]: r for r in claims.build_bundles(df, "K", "ROOT_CLAIM", slots, F.col("ev")).collect()}
    for i, host, root, ev in rows:
        held = {k: v for k, v in (("LEMMA_SLOT", root), ("SEGMENT_HOST", host)) if v is not None}
        text = json.dumps({"claim_kind": "K", "profile_id": "ROOT_CLAIM", "slot_values": held, "evidence_codes": sorted(ev or [])}, ensure_ascii=False, sort_keys=True)
        assert found[i]["claim_key"] == hashlib.sha256(text.encode()).hexdigest()
    assert all(s["state"] == ("UNKNOWN" if s["value"] is None else "FILLED") for r in found.values() for s in r["slots"])


def test_claim_profiles_and_documents(spark):
    from tessella.operators import claims

    df = spark.createDataFrame([("ROOT_CLAIM",), ("EXISTENCE_CLAIM",), ("NO_CLAIM",), (None,)], "p string")
    slots = claims.typed_slots({"SEGMENT_HOST": F.array(F.lit("h")), "RADICAL_R1": F.array(F.lit("a"), F.lit("b"))})
    found = df.select(claims.profile_problems(F.col("p"), slots, F.array(F.lit("CONTEXTUAL")))).collect()
    assert [r[0] for r in found] == [["UNFILLED:RADICAL_R1", "UNFILLED:RADICAL_R2", "UNFILLED:RADICAL_R3", "NO_EVIDENCE"], ["RESERVED_PROFILE"], ["UNKNOWN_PROFILE"], ["UNKNOWN_PROFILE"]]
    document = '{"claim_key": "k", "typed_slots": [{"slot_id": "LEMMA_SLOT", "state": "UNKNOWN", "value": "v"}]}'
    read = spark.createDataFrame([(document,), (None,)], "d string").select(claims.from_document(F.col("d")).alias("b")).collect()
    assert read[0]["b"]["typed_slots"][0]["value"] is None and read[1]["b"] is None

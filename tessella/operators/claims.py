"""Claim bundles: typed slots of a word, their profile, evidence, identity and admission.

A bundle is one row. What a field may hold is an array of candidates, so one rule gives
every slot its state, and all checks are expressions over arrays of structs: nothing is
shuffled, however many words there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.verdict import residual_verdict

#: Slots of a bundle with their order.
SLOTS = [
    ("ORIGINAL_SURFACE", 0), ("NORMALIZED_SURFACE", 10), ("PROCLITIC_SLOTS", 30), ("SEGMENT_HOST", 30), ("ENCLITIC_SLOTS", 30),
    ("ARTICLE_SLOT", 35), ("SOLAR_ASSIMILATION_SLOT", 35), ("BOUNDARY_TYPE_SLOT", 40), ("PATH_DIRECTIVE_SLOT", 40), ("WORD_CLASS_SLOT", 60),
    ("RADICAL_R1", 80), ("RADICAL_R2", 80), ("RADICAL_R3", 80), ("RADICAL_R4", 80), ("PATTERN_CANDIDATE_SET", 90),
    ("BAB_CANDIDATE_SET", 100), ("MASDAR_CANDIDATE_SET", 110), ("DERIVATIVE_CANDIDATE_SET", 120),
    ("NUMBER_SLOT", 130), ("GENDER_SLOT", 130), ("DEFINITENESS_SLOT", 130), ("LEMMA_SLOT", 140), ("PARADIGM_SLOT", 140),
]
#: Slots that a claim needs, slots that it must not fill, kinds of evidence that count; each needs one at least.
PROFILES = {
    "ROOT_CLAIM": (["SEGMENT_HOST", "RADICAL_R1", "RADICAL_R2", "RADICAL_R3"], ["FUNCTIONAL_OWNER_SLOT"], ["WAZN_MATCH", "PATTERN_MATCH", "LEXICAL", "MORPHOLOGICAL"]),
    "PATTERN_CLAIM": (["SEGMENT_HOST", "PATTERN_CANDIDATE_SET"], [], ["WAZN_MATCH", "PATTERN_MATCH"]),
    "BAB_CLAIM": (["BAB_CANDIDATE_SET"], [], ["LEXICAL", "MORPHOLOGICAL"]),
    "MASDAR_CLAIM": (["MASDAR_CANDIDATE_SET"], [], ["PATTERN_MATCH", "LEXICAL"]),
    "DERIVATIVE_CLAIM": (["DERIVATIVE_CANDIDATE_SET"], [], ["PATTERN_MATCH", "LEXICAL"]),
    "WORD_CLASS_CLAIM": (["WORD_CLASS_SLOT"], ["RADICAL_R1", "RADICAL_R2", "RADICAL_R3", "PATTERN_CANDIDATE_SET", "BAB_CANDIDATE_SET"], ["CATALOG_HIT", "MORPHOLOGICAL", "LEXICAL"]),
    "FUNCTIONAL_OWNER_CLAIM": (["FUNCTIONAL_OWNER_SLOT"], ["RADICAL_R1", "RADICAL_R2", "RADICAL_R3"], ["CATALOG_HIT", "LEXICAL"]),
}
#: Profiles that have a name but no slots, and may not be used.
RESERVED = ["SYNTACTIC_RELATION_CLAIM", "SEMANTIC_RELATION_CLAIM", "EXISTENCE_CLAIM", "PROPERTY_CLAIM", "CLASS_MEMBERSHIP_CLAIM", "CAPABILITY_CLAIM"]
#: Type of an evidence id by what it holds, the first that fits.
EVIDENCE_TYPES = [
    ("maqayis_root_catalog_evidence", "^maqayis:root:"),
    ("root_catalog_evidence", "root.*catalog|catalog.*root"),
    ("root_restoration_evidence", "root.*(restor|host)|(restor|host).*root"),
    ("root_slot_alignment", "root.*align|align.*root"),
    ("wazn_pattern_evidence", "wazn|pattern"),
    ("form_catalog_evidence", "bab|form"),
    ("masdar_derivation_evidence", "masdar"),
    ("mushtaq_derivation_evidence", "mushtaq|ism"),
    ("inflection_paradigm_evidence", "inflect|paradigm"),
    ("attachment_evidence", "attach|mabni"),
    ("negative_contradiction_evidence", "negat|contradict"),
]
SOURCE_PATH = "source_path_evidence"
DIRECTIVES = ["ACCEPT", "DEFER", "BLOCK", "NOT_APPLICABLE"]
DOCUMENT = """struct<claim_key: string, claim_kind: string, profile_id: string, original_surface: string, normalized_surface: string,
    typed_slots: array<struct<slot_id: string, sort: int, state: string, value: string, candidates: array<string>>>, obstacles: array<string>, residuals: array<struct<id: string, slot: string, n: int>>>"""


def typed_slots(fields: dict[str, Column], closed: dict[str, Column] | None = None) -> Column:
    """``slot_id, sort, state, value, candidates`` of all slots, in order.

    ``fields`` gives a slot's candidates as an array: one fills it, several leave it
    AMBIGUOUS with no value, none (or null) leaves it UNKNOWN. A slot whose condition in ``closed``
    holds is BLOCKED and keeps its value. Repeated and null candidates count once and not at all.
    """
    none = F.array().cast("array<string>")

    def slot(name: str, sort: int) -> Column:
        found = F.coalesce(F.array_distinct(F.array_compact(fields[name])), none) if name in fields else none
        state = F.when(F.coalesce((closed or {}).get(name, F.lit(False)), F.lit(False)), "BLOCKED").when(F.size(found) == 1, "FILLED").when(F.size(found) > 1, "AMBIGUOUS").otherwise("UNKNOWN")
        value = F.when(F.size(found) == 1, F.get(found, F.lit(0)))
        return F.struct(F.lit(name).alias("slot_id"), F.lit(sort).alias("sort"), state.alias("state"), value.alias("value"), found.alias("candidates"))

    return F.array(*[slot(*s) for s in SLOTS])


def _quoted(c: Column) -> Column:
    """A text as JSON; the array around it is taken off again."""
    js = F.to_json(F.array(c))
    return F.substr(js, F.lit(2), F.length(js) - 2)


def bundle_key(kind: Column, profile: Column, slots: Column, evidence: Column) -> Column:
    """SHA-256 of a claim's content as JSON with sorted keys, a blank after each comma and colon.

    Equal to hashing ``json.dumps(..., ensure_ascii=False, sort_keys=True)``, but for control
    characters, whose escapes differ in case.
    """
    filled = F.filter(slots, lambda s: s["value"].isNotNull())
    pairs = F.array_sort(F.transform(filled, lambda s: F.concat(_quoted(s["slot_id"]), F.lit(": "), _quoted(s["value"]))))
    codes = F.array_join(F.transform(F.array_sort(evidence), _quoted), ", ")
    parts = [F.lit('{"claim_kind": '), _quoted(kind), F.lit(', "evidence_codes": ['), codes, F.lit('], "profile_id": '), _quoted(profile), F.lit(', "slot_values": {'), F.array_join(pairs, ", "), F.lit("}}")]
    return F.sha2(F.concat(*parts), 256)


def build_bundles(words: DataFrame, kind: str, profile: str, slots: Column, evidence: Column) -> DataFrame:
    """``words`` with ``claim_key, claim_kind, profile_id, slots, obstacles, residuals``.

    A blocked path is an obstacle; each ambiguous slot is a visible residual with its number
    of candidates. ``evidence``: array of ids, null as empty.
    """
    none = F.array().cast("array<string>")
    out = words.withColumn("slots", slots)
    boundary = F.filter("slots", lambda s: s["slot_id"] == "BOUNDARY_TYPE_SLOT")[0]
    shut = F.exists("slots", lambda s: (s["slot_id"] == "PATH_DIRECTIVE_SLOT") & (s["state"] == "BLOCKED"))
    ambiguous = F.filter("slots", lambda s: s["state"] == "AMBIGUOUS")
    residuals = F.transform(ambiguous, lambda s: F.struct(F.concat(F.lit("ambiguous:"), s["slot_id"]).alias("id"), s["slot_id"].alias("slot"), F.size(s["candidates"]).alias("n")))
    return out.select(
        *words.columns,
        bundle_key(F.lit(kind), F.lit(profile), F.col("slots"), F.coalesce(evidence, none)).alias("claim_key"),
        F.lit(kind).alias("claim_kind"),
        F.lit(profile).alias("profile_id"),
        "slots",
        F.when(shut, F.array(F.concat(F.lit("CLOSED_BOUNDARY:"), F.coalesce(boundary["value"], F.lit(""))))).otherwise(none).alias("obstacles"),
        residuals.alias("residuals"),
    )


def profile_problems(profile: Column, slots: Column, kinds: Column) -> Column:
    """What a bundle breaks of its profile, in order: unknown or reserved profile, unfilled, forbidden, evidence."""
    filled = F.transform(F.filter(slots, lambda s: s["state"] == "FILLED"), lambda s: s["slot_id"])
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    tag = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{name}:"), x))
    known = [
        (name, F.concat(tag("UNFILLED", F.array_except(texts(need), filled)), tag("FORBIDDEN", F.array_intersect(texts(bar), filled)), F.when(~F.arrays_overlap(kinds, texts(kinds_)), texts(["NO_EVIDENCE"])).otherwise(texts([]))))
        for name, (need, bar, kinds_) in PROFILES.items()
    ]
    by_name = reduce(lambda acc, x: acc.when(profile == x[0], x[1]), known, F.when(profile.isin(RESERVED), texts(["RESERVED_PROFILE"])))
    return by_name.otherwise(texts(["UNKNOWN_PROFILE"]))


def to_document(original: Column, normalized: Column) -> Column:
    """A bundle's row as JSON."""
    fields = [F.col(c) for c in ("claim_key", "claim_kind", "profile_id")] + [original.alias("original_surface"), normalized.alias("normalized_surface")]
    return F.to_json(F.struct(*fields, F.col("slots").alias("typed_slots"), "obstacles", "residuals"))


def from_document(document: Column) -> Column:
    """The bundle of a JSON document; an UNKNOWN slot has no value, whatever the document says."""
    known = lambda s: s.withField("value", F.when(s["state"] != "UNKNOWN", s["value"]))
    # bound to a variable, as withField repeats what it is applied to for each field
    return F.transform(F.array(F.from_json(document, DOCUMENT)), lambda b: b.withField("typed_slots", F.transform(b["typed_slots"], known)))[0]


def evidence_type(evidence_id: Column) -> Column:
    low = F.lower(evidence_id)
    return F.coalesce(*[F.when(low.rlike(pattern), name) for name, pattern in EVIDENCE_TYPES], F.lit(SOURCE_PATH))


def map_evidence(ids: Column, root: Column, pattern: Column, directive: Column, claim_id: Column) -> Column:
    """``records(type, id, negative), missing, verdict`` of a claim's evidence ids (null as none).

    A root needs catalog evidence and a pattern needs evidence of its own, else the claim is
    INSUFFICIENT; acceptance adds a record of its source path; no record at all is MISSING.
    """
    record = lambda i: F.struct(evidence_type(i).alias("type"), i.alias("id"), F.lower(i).rlike("contradict|negative").alias("negative"))
    given = F.transform(F.coalesce(ids, F.array().cast("array<string>")), record)
    path = F.struct(F.lit(SOURCE_PATH).alias("type"), F.concat(F.lit("directive:ACCEPT:"), claim_id).alias("id"), F.lit(False).alias("negative"))
    records = F.concat(given, F.filter(F.array(path), lambda _: directive == "ACCEPT"))
    need = F.array_compact(F.array(F.when(root.isNotNull(), "root_catalog_evidence"), F.when(pattern.isNotNull(), "wazn_pattern_evidence")))
    missing = F.array_except(need, F.transform(given, lambda r: r["type"]))
    verdict = F.when(F.size(records) == 0, "MISSING").when(F.size(missing) > 0, "INSUFFICIENT").otherwise("SUFFICIENT")
    return F.struct(records.alias("records"), missing.alias("missing"), verdict.alias("verdict"))


def identity_continuity(original: Column, normalized: Column, host: Column, traces: Column, rootless: Column) -> Column:
    """BLOCK without a surface or where an accepted claim is ``rootless``; DEFER where a change left no trace; else ACCEPT."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    trace = lambda words: F.coalesce(F.exists(traces, lambda t: F.lower(t).rlike(words)), F.lit(False))
    changed = (original != normalized) & ~trace("norm")
    refined = ~empty(host) & (host != normalized) & ~trace("host|refin")
    return F.when(empty(original) | empty(normalized) | rootless, "BLOCK").when(changed | refined, "DEFER").otherwise("ACCEPT")


def admit(claims: DataFrame, columns: dict[str, Column], blocking: list[str]) -> DataFrame:
    """``claims`` with ``verdict, stopped_at, identity, evidence``: the first gate that a claim does not pass.

    ``columns``: claim_id, token_id, original, normalized, host, root, pattern, directive,
    evidence, traces, active, resolved, provider (admitted). The kernel behind the last gate is not
    public: claims that reach it are READY where identity and evidence hold, else DEFERRED.
    """
    c = columns
    name = lambda n: "__" + n
    rootless = c["root"].isNull() & c["pattern"].isNotNull() & (c["directive"] == "ACCEPT")
    staged = claims.select(
        "*",
        identity_continuity(c["original"], c["normalized"], c["host"], c["traces"], rootless).alias(name("identity")),
        map_evidence(c["evidence"], c["root"], c["pattern"], c["directive"], c["claim_id"])["verdict"].alias(name("evidence")),
        residual_verdict(c["active"], c["resolved"], blocking).alias(name("residual")),
    )
    blank = lambda x: F.coalesce(x.cast("string"), F.lit("")) == ""
    ill_formed = blank(c["claim_id"]) | blank(c["token_id"]) | blank(c["original"]) | ~F.coalesce(c["directive"].isin(DIRECTIVES), F.lit(False)) | (F.col(name("residual")) == "HIDDEN_FORBIDDEN")
    gates = [
        ("directive", c["directive"] == "BLOCK", "BLOCKED"),
        ("bundle", ill_formed, "REJECTED"),
        ("provider", ~F.coalesce(c["provider"], F.lit(False)), "REJECTED"),
        ("identity", F.col(name("identity")) == "BLOCK", "BLOCKED"),
        ("residuals", F.col(name("residual")) == "BLOCKING", "BLOCKED"),
    ]
    stop = F.coalesce(*[F.when(fails, F.struct(F.lit(gate).alias("gate"), F.lit(verdict).alias("verdict"))) for gate, fails, verdict in gates])
    holds = (F.col(name("identity")) == "ACCEPT") & (F.col(name("evidence")) == "SUFFICIENT")
    return staged.withColumn("__stop", stop).select(
        *claims.columns,
        F.coalesce("__stop.verdict", F.when(holds, "READY").otherwise("DEFERRED")).alias("verdict"),
        F.col("__stop.gate").alias("stopped_at"),
        F.col(name("identity")).alias("identity"),
        F.col(name("evidence")).alias("evidence"),
    )

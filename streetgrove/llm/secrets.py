"""Secret scans over a trigram inverted index; DataFrame functions only.

Each rule's regex is turned into a Boolean query over trigrams that any match must contain. The postings of the
trigrams that the rules ask for are intersected per document, and only documents that satisfy a query are verified
with the regex itself. A rule with an alternative that has no trigram scans every document.

A null text is empty and has no spans. A document is known by its doc_id and the hash of its text, so rows that
repeat both share one answer, and a null doc_id is a value like any other. Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.llm.common import texts
from streetgrove.session import cut


#: A private key in armour: the BEGIN line and all up to its END line. If END is missing or another mark comes first, the headers
#: and base64 that follow: runs of 16 letters at least, however they are parted, then whole lines of base64 to a short last one.
#: Written without look-around, for Java, Python and DuckDB; repeats of groups are bounded, as Java recurs on them.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*(?:-{1,4}[^-]+){0,60}-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:[ \t\r\n]+[A-Za-z][A-Za-z-]{0,30}: [^\r\n]*){0,20}(?:[ \t\r\n\\]*[A-Za-z0-9+/=]{16,}){0,60}(?:[A-Za-z0-9+/=\r\n]*(?:[\r\n]|$))?)"
)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap; then those with a ``group`` under ``least`` code points are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds in their order, then the further ones.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Candidates up to this number go to the tasks by broadcast (some 20 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Alternatives that a query may have before a part of the regex counts as unknown text.
ALTERNATIVES = 64

# ---- from a regex to its trigram query ----

#: Unknown text of any length between known pieces.
GAP = None
Way = tuple[str | None, ...]


def _ways(tree) -> set[Way]:
    """What a match can look like: each way is a row of characters and gaps. Unknown parts become gaps, so no match is lost."""
    ways: set[Way] = {()}
    for op, arg in tree:
        part = _part(str(op), arg)
        if len(ways) * len(part) > ALTERNATIVES:
            part = {(GAP,)}
        ways = {a + b for a in ways for b in part}
    return ways


def _letter(code: int) -> str | None:
    return chr(code).lower() if code < 128 else GAP


def _part(op: str, arg) -> set[Way]:
    if op == "LITERAL":
        return {(_letter(arg),)}
    if op == "IN":
        letters: set[str | None] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                letters.add(_letter(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                letters |= {_letter(c) for c in range(value[0], value[1] + 1)}
            else:
                return {(GAP,)}
        return {(x,) for x in letters} if len(letters) <= 8 and GAP not in letters else {(GAP,)}
    if op == "BRANCH":
        ways = set().union(*(_ways(branch) for branch in arg[1]))
        return ways if len(ways) <= ALTERNATIVES else {(GAP,)}
    if op == "SUBPATTERN":
        return _ways(arg[3])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = arg
        once = _ways(body)
        ways: set[Way] = {()}
        for _ in range(min(least, 8)):
            ways = {a + b for a in ways for b in once}
            if len(ways) > ALTERNATIVES:
                return {(GAP,)}
        if (least, most) == (0, 1):
            return once | {()}
        return ways if least == most <= 8 else {way + (GAP,) for way in ways}
    if op == "AT":
        return {()}
    return {(GAP,)}


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams, one of which a text with a match has whole; None if some match has no trigram."""
    sets: set[frozenset[str]] = set()
    for way in _ways(re._parser.parse(pattern)):
        runs = "".join("\0" if x is GAP else x for x in way).split("\0")
        sets.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    if not all(sets):
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


# ---- the index and the search ----


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def trigram_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings (trigram, doc_id, text_hash) of the asked trigrams over the lower-cased texts."""
    lowered = docs.select("doc_id", "text_hash", F.lower("text").alias("lowered"))
    held = F.array_compact(F.array(*(F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in trigrams)))
    return lowered.select(F.explode(held).alias("trigram"), "doc_id", "text_hash")


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """(doc_id, text_hash, kinds) that satisfy the trigram query of a rule; None if every rule scans all."""
    queries = [(rule.kind, n, wanted) for rule in rules for n, wanted in enumerate(trigram_query(rule.pattern) or ())]
    if not queries:
        return None
    asked = [(t, kind, n, 1 << k, (1 << len(wanted)) - 1) for kind, n, wanted in queries for k, t in enumerate(sorted(wanted))]
    postings = trigram_index(docs, sorted({row[0] for row in asked}))
    # One row for each trigram of a rule, so the broadcast is bounded by the rules.
    terms = F.broadcast(docs.sparkSession.createDataFrame(asked, "trigram string, kind string, way int, bit long, full long"))
    met = postings.join(terms, "trigram").groupBy("doc_id", "text_hash", "kind", "way", "full").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = full").groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("kinds"))


def _matches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, text_hash, kind, nth, gap, size, kept): every match, the code points before it since the last one, and its own."""
    gaps, pattern = F.split("text", rule.pattern, -1), F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.char_length)
    group = whole if rule.group == 0 else F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.char_length)
    found = docs.where(F.rlike("text", pattern)).select(
        "doc_id", "text_hash", F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), whole.alias("size"), group.alias("group")).alias("found")
    )
    rows = found.select("doc_id", "text_hash", F.posexplode("found").alias("nth", "m")).where("m.size is not null")
    return rows.select("doc_id", "text_hash", F.lit(rule.kind).alias("kind"), "nth", "m.gap", "m.size", (F.col("m.group") >= rule.least).alias("kept"))


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, start, end): one row a span, no span twice."""
    all_docs = keyed(docs, id_col, text_col)
    indexed = [r for r in rules if trigram_query(r.pattern)]
    parts = [_matches(all_docs, r) for r in rules if r not in indexed]
    if indexed:
        found = cut(candidates(all_docs, indexed), "secret-candidates")
        chosen = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        same = all_docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (all_docs["text_hash"] == chosen["text_hash"])
        verify = all_docs.join(chosen, same).select(all_docs["doc_id"], all_docs["text_hash"], "text", "kinds")
        verify = cut(verify, "secret-texts")
        parts += [_matches(verify.where(F.array_contains("kinds", r.kind)), r) for r in indexed]
    matches = reduce(DataFrame.unionByName, parts)
    # Repeated rows give the same matches; then the running sum of gaps and matches is where each match ends.
    once = matches.groupBy("doc_id", "text_hash", "kind", "nth").agg(*(F.first(c).alias(c) for c in ("gap", "size", "kept")))
    upto = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ended = once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    return ended.where("kept").select("doc_id", "text_hash", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_<kind> for each base kind, base_sha256, spans): one row for each document, clean ones too."""
    base = [r.kind for r in rules if r.base]
    place = F.element_at(F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k))), F.col("kind"))
    span = F.struct("start", place.alias("place"), "kind", "end")
    in_base = F.col("kind").isin(base)
    per_doc = secret_spans(docs, rules, id_col=id_col, text_col=text_col).groupBy("doc_id", "text_hash").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base),
        _joined(F.collect_list(F.when(in_base, span))).alias("base_spans"), _joined(F.collect_list(span)).alias("spans"),
    )
    rows = keyed(docs, id_col, text_col).select("doc_id", "text_hash")
    same = rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["text_hash"] == per_doc["text_hash"])
    return rows.join(per_doc, same, "left").select(
        rows["doc_id"], *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base),
        F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span, overlapping ones together, replaced by ``mark`` and n_chars counted again; all rows and columns stay."""
    spans = secret_spans(docs, rules).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("own_spans"))
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "own_spans")
    # The document is one column until the end, so that no column of its own can be mistaken for one of these.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
    text = F.coalesce(F.col("document.text"), F.lit(""))
    joined = whole.join(spans, F.col("document.doc_id").cast("long").eqNullSafe(F.col("span_id")) & (F.xxhash64(text) == F.col("span_hash")), "left")
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        .otherwise(acc["out"]).alias("out"), s["end"].alias("at"),
    ))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.char_length(text)))
    new = F.aggregate("own_spans", start, step, rest)
    hit = F.col("own_spans").isNotNull()
    out = joined.select("document", F.when(hit, new).otherwise(F.col("document.text")).alias("new_text"), hit.alias("was_hit"))
    old = lambda c: F.col("document").getField(c)
    return out.select(*(
        F.col("new_text").alias(c) if c == "text"
        else F.when(F.col("was_hit"), F.char_length("new_text")).otherwise(old(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else old(c).alias(c)
        for c in docs.columns
    ))


def checking_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: every regex over every text, no index."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"select doc_id, {quoted(r.kind)} as kind, {k} as place, {r.least} as least, "
        f"regexp_extract_all(t, {quoted(r.pattern)}) as whole, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) as part, "
        f"string_split_regex(t, {quoted(r.pattern)}) as gaps from d where regexp_matches(t, {quoted(r.pattern)})"
        for k, r in enumerate(rules)
    ]
    base = [r.kind for r in rules if r.base]
    counts = ", ".join(f"count(*) filter (kind = {quoted(k)}) as n_{k}" for k in base)
    listed = "string_agg(kind || ':' || (stop - size) || ':' || stop, ',' order by stop - size, place)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
u as (select doc_id, kind, place, least, generate_subscripts(whole, 1) as nth, unnest(whole) as w, unnest(part) as p, unnest(gaps[:len(whole)]) as g from m),
s as (select *, length(w) as size, sum(length(g) + length(w)) over (partition by doc_id, kind order by nth)::bigint as stop from u),
k as (select doc_id, {counts}, {listed} filter (place < {len(base)}) as base_spans, {listed} as spans from s where length(p) >= least group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in base)}, sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join k on d.doc_id = k.doc_id"""

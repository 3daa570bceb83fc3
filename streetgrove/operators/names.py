"""Names of layers and blocks: normal forms, rules, vocabulary, similarity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetgrove.functions import vocabulary
from streetgrove.operators import spatial
from streetgrove.session import cut

# Fixed values.
SHORT_WORD = 3
MIN_SIMILARITY = 0.6
MIN_SHARE = 0.7
NEIGHBOURS = 5
NEVER_GUESSED = (
    "ignore", "lawn", "work_boundary", "contour", "unknown", "territory.street", "territory.yard", "territory.square", "territory.park",
)
REVIEW_CONTEXT = (
    r"(?iu)\b(?:за|вместо|на месте|не|нет|без)\b|\b(?:демонт|уничтож|снос|проектир|восстан|устройств|замен|новый|нового|новая|новое)"
    r"|\b(?:proposed|demolition|remove|removed|replace|replacement|new|not)\b|\bгазон\s+[ру]\b|\bдв гп п газон\b"
)
# Letters of the Latin key of a name.
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def local_name(name: Column) -> Column:
    """Name without the prefix of a reference: the last part after '|' or '$n$'."""
    return F.element_at(F.split(name, r"\||\$\d+\$"), -1)


def base_name(block: Column) -> Column:
    """Sign code: local name without trailing instance numbers."""
    return F.regexp_replace(local_name(block), r"(_\d+)+$", "")


def slug(name: Column) -> Column:
    text = F.lower(name)
    single = {k: v for k, v in TRANSLITERATION.items() if len(v) <= 1}
    kept = {k: v for k, v in single.items() if v}
    text = F.translate(text, "".join(kept) + "".join(k for k, v in single.items() if not v), "".join(kept.values()))
    for letter, latin in TRANSLITERATION.items():
        if len(latin) > 1:
            text = F.replace(text, F.lit(letter), F.lit(latin))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))


def words_of(name: Column) -> Column:
    """Lower case, joined initials, separators to spaces."""
    text = F.translate(F.lower(name), "ё", "е")
    text = F.regexp_replace(text, r"(?<![0-9a-zа-я])([a-zа-я])\.([a-zа-я])(?![0-9a-zа-я])", "$1$2")
    return F.trim(F.regexp_replace(text, "[^0-9a-zа-я]+", " "))


def review_needed(*names: Column) -> Column:
    """Wording about works or negation cannot establish the material."""
    found = F.lit(False)
    for name in names:
        found = found | F.coalesce(F.regexp_replace(local_name(name), r"[_\-]+", " ").rlike(REVIEW_CONTEXT), F.lit(False))
    return found


def rule_decisions(names: DataFrame, rules: Sequence[tuple[str, str, str, str, int]], *, layer: str = "layer", block: str = "block", kind: str = "kind") -> DataFrame:
    """(layer, block, kind, object_class, method) of distinct names from name rules (pattern, target, geometry, class, priority).

    Block matches beat layer matches, then the highest priority; disagreement at that priority
    leaves the object unknown, and a lawn under work wording needs a review. The rules are
    configuration: a name becomes a row for each rule that it meets, and the few rows of a name are judged together.
    """
    key = [layer, block, kind]
    base = names.select(*key).distinct().withColumns({"_layer": local_name(F.col(layer)), "_block": local_name(F.col(block))})
    base = cut(base.withColumn("_review", review_needed(F.col(layer), F.col(block))), "names")
    met = []
    for pattern, target, geometry, cls, priority in rules:
        test = F.coalesce(F.col("_block" if target == "block" else "_layer").rlike(pattern), F.lit(False))
        if geometry != "any":
            test = test & (F.col(kind) == geometry)
        met.append(F.when(test, F.struct(F.lit(target == "block").alias("_b"), F.lit(priority).alias("_p"), F.lit(cls).alias("_c"))))
    hits = base.select(*key, F.explode(F.array_compact(F.array(*met))).alias("h")).select(*key, "h.*")
    # Block before layer, then priority: the best rank of a name, and how many classes hold it.
    ranked = hits.groupBy(*key, F.struct("_b", "_p").alias("_rank")).agg(F.min("_c").alias("_c"), F.max("_c").alias("_other"))
    best = ranked.groupBy(*key).agg(F.max(F.struct("_rank", "_c", "_other")).alias("_top")).select(
        *[F.col(c).alias("k_" + c) for c in key], F.col("_top._c").alias("_cls"), (F.col("_top._c") == F.col("_top._other")).alias("_one"))
    rows = base.join(best, [F.col(c).eqNullSafe(F.col("k_" + c)) for c in key], "left")
    review = F.col("_one") & (F.col("_cls") == "lawn") & F.col("_review")
    method = F.when(F.col("_cls").isNull(), "unmatched").when(~F.col("_one"), "conflict").when(review, "material_context").otherwise("name_rule")
    rows = rows.select(*key, "_cls", method.alias("method"))
    return rows.select(*key, F.when(F.col("method") == "name_rule", F.col("_cls")).otherwise("unknown").alias("object_class"), "method")


def geometry_fallback(kind: str = "kind") -> tuple[Column, Column]:
    """Careful replacement when words say nothing: (class, method) from the geometry alone."""
    small = F.col("radius_m").isNotNull() & (F.col("radius_m") <= 1.5)
    cls = F.when(F.col(kind) == "point", "ignore").when(F.col("is_frame"), "ignore").when(small, "obstacle").otherwise("contour")
    method = F.when(F.col(kind) == "point", "assumed_geometry:point").when(F.col("is_frame"), "assumed_geometry:sheet_frame").when(
        small, "assumed_geometry:small_circle").otherwise("assumed_geometry:contour")
    return cls, method


def with_overrides(features: DataFrame, overrides: DataFrame) -> DataFrame:
    """User assignments (target, key, class): feature before block before layer."""
    out = features
    for target, column in (("feature", F.col("feature_id").cast("string")), ("block", F.lower("block")), ("layer", F.lower("layer"))):
        part = overrides.where(F.col("target") == target).select(F.lower("key").alias(f"_{target}_key"), F.col("class").alias(f"_{target}"))
        out = out.join(part, column == F.col(f"_{target}_key"), "left").drop(f"_{target}_key")
    cls = F.coalesce("_feature", "_block", "_layer", "object_class")
    method = F.when(F.col("_feature").isNotNull(), "explicit_feature").when(F.col("_block").isNotNull(), "explicit_block").when(
        F.col("_layer").isNotNull(), "explicit_layer").otherwise(F.col("method"))
    return out.withColumn("_c", cls).withColumn("method", method).drop("object_class", "_feature", "_block", "_layer").withColumnRenamed("_c", "object_class")


def unused_overrides(features: DataFrame, overrides: DataFrame) -> DataFrame:
    present = None
    for target, column in (("feature", F.col("feature_id").cast("string")), ("block", F.lower("block")), ("layer", F.lower("layer"))):
        names = features.select(F.lit(target).alias("target"), column.alias("k")).distinct()
        present = names if present is None else present.unionByName(names)
    return overrides.withColumn("k", F.lower("key")).join(present, ["target", "k"], "left_anti").select("target", "key")


def review_reason(cls: Column, method: Column) -> Column:
    head = F.element_at(F.split(method, ":"), 1)
    return (
        F.when(cls.isin("unknown", "utility.unknown"), "class_unknown").when(head.startswith("explicit_"), F.lit(None).cast("string"))
        .when(head == "symbol_assumed", "sign_taken_for_obstacle").when(head == "assumed_geometry", "geometry_only").when(head == "inferred_weak", "weak_hint")
        .when(head == "model", "name_model").when(head == "callout_candidate", "possible_callout")
    )


def recognition_bucket(cls: Column, method: Column) -> Column:
    head = F.element_at(F.split(method, ":"), 1)
    return (
        F.when((cls == "unknown") | head.isin("unmatched", "conflict"), "unresolved").when(head == "symbol_assumed", "by_geometry_only")
        .when(head == "symbol_stroke", "symbol_strokes").when(head.rlike("^(symbol|tree_strip|shrub_strip|topographic)"), "by_symbol")
        .when(head.isin("name_rule", "inferred_classifier"), "by_name_rule")
        .when(head.isin("inferred_name", "inferred_annotation", "inferred_removed", "inferred_proposed"), "by_words")
        .when(head == "inferred_weak", "by_weak_hint").when(head == "model", "by_name_model").when(head == "assumed_geometry", "by_geometry_only")
        .when(head == "sheet_furniture", "sheet_furniture").when(head.isin("callout_leader", "callout_annotation", "callout_candidate"), "callouts").otherwise("other")
    )


def report(features: DataFrame) -> DataFrame:
    """Groups by (layer, block, kind, class, method): count, up to five refs, largest error, review.

    The five smallest refs come from a per-group top five, not from collecting the group.
    """
    from streetgrove.operators import scan

    keys = ["layer", "block", "kind", "object_class", "method"]
    features = cut(features.select(*keys, "error_m", "feature_id"), "features")
    groups = features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("features"), F.when(F.count_if(F.col("error_m").isNull()) > 0, F.lit(None)).otherwise(F.max("error_m")).alias("max_error_m"))
    firsts = scan.top_k(features.select(*keys, "feature_id"), 5, by=keys, order=(F.col("feature_id"),)).groupBy(*keys).agg(F.sort_array(F.collect_list("feature_id")).alias("refs"))
    return groups.join(firsts, keys).withColumn("review", review_reason(F.col("object_class"), F.col("method")))


def classifier_code(names: DataFrame, codes: DataFrame, name: str = "layer") -> DataFrame:
    """Class of the longest known code written in a name (spaces, other separators or joined)."""
    mark = F.regexp_extract(F.upper(local_name(F.col(name))), r"(?<![А-ЯA-Z])(ТС|ПО[\s_.\-]*ЗУ)[\s_.\-]*(\d{2}[\d\s_.\-]*)", 1)
    digits = F.regexp_extract(F.upper(local_name(F.col(name))), r"(?<![А-ЯA-Z])(ТС|ПО[\s_.\-]*ЗУ)[\s_.\-]*(\d{2}[\d\s_.\-]*)", 2)
    groups = F.regexp_extract_all(digits, F.lit(r"(\d+)"), F.lit(1))
    run = groups[0]
    pairs = F.regexp_extract_all(run, F.lit(r"(\d{2}(?:\d$)?)"), F.lit(1))
    parts = F.when(F.size(groups) == 1, pairs).otherwise(groups)
    part = F.when(mark.startswith("П"), "ПО ЗУ").otherwise("ТС")
    sized = names.withColumn("_parts", parts).withColumn("_part", part).where((digits != "") & (F.size("_parts") >= 3))
    prefixes = sized.withColumn("_size", F.explode(F.sequence(F.lit(3), F.size("_parts")))).withColumn(
        "code", F.concat_ws(" ", F.col("_part"), F.array_join(F.slice("_parts", F.lit(1), F.col("_size")), " ")))
    hits = prefixes.join(codes, "code")
    return hits.groupBy(name).agg(F.max_by(F.struct("code", "object_class"), F.col("_size")).alias("h")).select(name, "h.code", "h.object_class")


def vocabulary_class(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, class, word, kind) inferred from the words of distinct names.

    Tokens meet the vocabulary by their first letter and the longest stem wins. The grammar keeps
    the new state: the part before a separator, nothing after a negation, nothing next to a word
    of removal; planned vegetation is not an existing one.
    """
    spark = names.sparkSession
    words = spark.createDataFrame(vocabulary.word_rows(), "word string, cls string, rank int")
    service = spark.createDataFrame(vocabulary.service_rows(), "word string, role string")
    weak = spark.createDataFrame(list(vocabulary.WEAK.items()), "word string, cls string")

    base = names.select(name).distinct().withColumn("text", words_of(local_name(F.col(name))))
    pair = F.split(local_name(F.col(name)), "-")
    tokens = base.withColumn("tokens", F.split("text", " ")).withColumn("first_part", words_of(pair[0])).withColumn("n_parts", F.size(pair))
    rows = tokens.select(name, F.posexplode("tokens").alias("pos", "token")).where("token <> ''")
    alias = F.regexp_extract("token", "^[a-zа-я]+", 0)
    numbered = F.regexp_extract("token", r"^\d+([a-zа-я]+)$", 1)

    def match(df: DataFrame, dictionary: DataFrame, token: Column, keep: Sequence[str]) -> DataFrame:
        fits = F.when(F.length("word") <= SHORT_WORD, F.col("t") == F.col("word")).otherwise(F.col("t").startswith(F.col("word")))
        joined = df.withColumn("t", token).withColumn("h", F.substring("t", 1, 1)).join(F.broadcast(dictionary.withColumn("h", F.substring("word", 1, 1))), "h").where(fits)
        return joined.select(name, "pos", F.length("word").alias("len"), F.struct("word", *keep).alias("m"))

    plain = match(rows, words, F.col("token"), ("cls", "rank")).withColumn("order", F.lit(0))
    digits = match(rows.where(numbered != ""), words, numbered, ("cls", "rank")).where(F.col("m.word") == F.col("m.word")).withColumn("order", F.lit(1))
    letters = match(rows.where((alias != "") & (alias != F.col("token"))), words, alias, ("cls", "rank")).withColumn("order", F.lit(2))
    best = plain.unionByName(digits).unionByName(letters).groupBy(name, "pos").agg(F.min_by("m", F.struct(F.col("order"), -F.col("len"))).alias("m"))
    hits = best.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("pos", "m.word", "m.cls", "m.rank"))).alias("hits"))  # tokens of one name

    role_hits = match(rows, service, F.col("token"), ("role",)).unionByName(match(rows.where((alias != "") & (alias != F.col("token"))), service, alias, ("role",)))
    roles = role_hits.groupBy(name).agg(F.sort_array(F.collect_set(F.struct(F.col("m.role").alias("role"), "pos", F.col("m.word").alias("word")))).alias("roles"))
    weak_hits = match(rows, weak, F.col("token"), ("cls",)).unionByName(match(rows.where((alias != "") & (alias != F.col("token"))), weak, alias, ("cls",)))
    weaks = weak_hits.groupBy(name).agg(F.min_by("m", F.col("pos")).alias("weak"))

    joined = tokens.join(hits, name, "left").join(roles, name, "left").join(weaks, name, "left")
    empty_hits = F.expr("cast(array() as array<struct<pos:int,word:string,cls:string,rank:int>>)")
    empty_roles = F.expr("cast(array() as array<struct<role:string,pos:int,word:string>>)")
    joined = joined.withColumn("hits", F.coalesce("hits", empty_hits)).withColumn("roles", F.coalesce("roles", empty_roles))

    # Phrases take all their words, so a word inside a phrase is not heard twice.
    phrase_hits = []
    for phrase, cls, rank in vocabulary.phrase_rows():
        at = F.size(F.split(F.substring_index("text", phrase, 1), " ")) - 1
        heard = F.concat(F.lit(" "), F.col("text")).contains(" " + phrase)
        phrase_hits.append(F.when(heard, F.struct(at.cast("int").alias("pos"), F.lit(phrase).alias("word"), F.lit(cls).alias("cls"), F.lit(rank).alias("rank"))))
    joined = joined.withColumn("phrases", F.array_compact(F.array(*phrase_hits)))
    inside = lambda h: F.exists("phrases", lambda p: (h["pos"] >= p["pos"]) & (h["pos"] < p["pos"] + F.size(F.split(p["word"], " "))))
    joined = joined.withColumn("hits", F.array_sort(F.concat(F.filter("hits", lambda h: ~inside(h)), F.col("phrases"))))
    joined = cut(joined, "heard")  # the next steps read these arrays many times; without a cut their expressions multiply

    # The head of a name: the first part of a pair of materials, else what stands before a separator.
    cuts = [F.when(F.locate(f" {s} ", F.concat(F.col("text"), F.lit(" "))) > 0, F.size(F.split(F.substring_index(F.concat(F.col("text"), F.lit(" ")), f" {s} ", 1), " "))) for s in vocabulary.SEPARATORS]
    first_len = F.size(F.split("first_part", " "))
    in_first = F.exists("hits", lambda h: h["pos"] < first_len) & F.exists("hits", lambda h: h["pos"] >= first_len)
    limit = F.when((F.col("n_parts") > 1) & in_first, first_len).otherwise(F.coalesce(F.least(*cuts), F.size(F.split("text", " "))))
    joined = joined.withColumn("limit", limit)
    joined = cut(joined.withColumn("head", F.filter("hits", lambda h: h["pos"] < F.col("limit"))), "head")

    def role(kind: str) -> Column:
        return F.filter("roles", lambda r: r["role"] == kind)

    head_role = lambda kind: F.filter(role(kind), lambda r: r["pos"] < F.col("limit"))
    negated = F.transform(head_role("negation"), lambda r: r["pos"] + 1)
    nearest = lambda r: F.array_min(F.transform("head", lambda h: F.struct(F.abs(h["pos"] - r["pos"]).alias("d"), (h["pos"] > r["pos"]).alias("after"), h["pos"].alias("pos"))))["pos"]
    removed = F.transform(head_role("removal"), nearest)
    joined = joined.withColumn("negated", negated).withColumn("removed", removed).withColumn(
        "kept", F.filter("head", lambda h: ~F.array_contains("negated", h["pos"]) & ~F.coalesce(F.array_contains("removed", h["pos"]), F.lit(False))))
    joined = cut(joined, "kept")

    rank = F.array_min(F.transform("kept", lambda h: h["rank"]))
    top = F.filter("kept", lambda h: h["rank"] == rank)
    known = F.filter(top, lambda h: h["cls"] != "utility.unknown")
    chosen = F.when(rank == vocabulary.RANKS.index("surface"), F.element_at(top, -1)).when(F.size(known) > 0, F.element_at(known, 1)).otherwise(F.element_at(top, 1))
    joined = joined.withColumn("chosen", F.when(F.size("kept") > 0, chosen)).withColumn("was_negated", F.exists("negated", lambda n: F.exists("head", lambda h: h["pos"] == n)))
    joined = cut(joined, "chosen")
    vegetation = F.col("chosen.cls").isin("existing_tree", "existing_shrub")
    has = lambda kind: F.size(role(kind)) > 0
    boundary = F.exists("phrases", lambda p: p["cls"] == "work_boundary") & F.forall(role("annotation"), lambda r: r["word"].isin("рамк", "border"))
    annotated = has("annotation") & ~boundary
    head_removal = F.size(head_role("removal")) > 0
    cls = (
        F.when(annotated, "ignore").when(vegetation & has("removal"), "ignore").when(vegetation & has("proposed") & ~has("existing"), "ignore")
        .when(F.col("chosen").isNotNull(), F.col("chosen.cls")).when(F.col("was_negated"), F.lit(None)).when(head_removal, "ignore").otherwise(F.col("weak.cls"))
    )
    kind = (
        F.when(annotated, "annotation").when(vegetation & has("removal"), "removed").when(vegetation & has("proposed") & ~has("existing"), "proposed")
        .when(F.col("chosen").isNotNull(), "name").when(F.col("was_negated"), F.lit(None)).when(head_removal, "removed").when(F.col("weak").isNotNull(), "weak")
    )
    word = F.when(annotated, role("annotation")[0]["word"]).when(F.col("chosen").isNotNull(), F.col("chosen.word")).otherwise(F.col("weak.word"))
    return joined.select(name, cls.alias("object_class"), F.when(kind.isNotNull(), word).alias("word"), kind.alias("inferred")).where(F.col("object_class").isNotNull())


def trigrams(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, gram, n) of the normalised name; digits become '#'."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), "ё", "е"), r"\d+", "#"), r"[\s_\-.|$]+", " "))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    rows = names.withColumn("_p", padded).where(F.length("_p") >= 3)
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("_p") - 2), lambda i: F.substring(F.col("_p"), i, F.lit(3))))
    return rows.select(name, grams.alias("gram")).groupBy(name, "gram").agg(F.count(F.lit(1)).alias("n"))


def nearest_names(queries: DataFrame, training: DataFrame, *, k: int = NEIGHBOURS, hot_rows: int = spatial.HOT_ROWS) -> DataFrame:
    """Class by the five most similar training names (trigram cosine) over an inverted index.

    ``queries(name)``, ``training(name, object_class)``; names with fewer than three letters are
    never guessed, the best similarity must reach 0.6 and the vote 0.7, and classes that widen
    the planting zone are never emitted.
    """
    from streetgrove.operators import scan

    lettered = queries.where(F.length(F.regexp_replace("name", r"[^A-Za-zА-Яа-яЁё]", "")) >= 3).distinct()
    training = cut(training, "training")
    q, t = cut(trigrams(lettered), "grams"), cut(trigrams(training.select("name").distinct()), "grams")
    qn = q.groupBy("name").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("qn"))
    tn = t.groupBy("name").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("tn"))
    # A trigram that half of all names share is dealt over salts, as a hot cell is.
    asked, known, on = spatial.split_hot(q, t.select(F.col("name").alias("near"), "gram", F.col("n").alias("m")), ["gram"], ["name"], hot_rows)
    dots = asked.join(known, on).groupBy("name", "near").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    scored = dots.join(qn, "name").join(tn.withColumnRenamed("name", "near"), "near").withColumn("similarity", F.round(F.col("dot") / (F.col("qn") * F.col("tn")), 9))
    best = scan.top_k(scored, k, by=("name",), order=(F.desc("similarity"), F.col("near")))
    votes = best.join(training.withColumnRenamed("name", "near"), "near").groupBy("name", "object_class").agg(F.sum("similarity").alias("votes"), F.max("similarity").alias("top"))
    total = votes.groupBy("name").agg(F.sum("votes").alias("all"), F.max("top").alias("best"), F.max(F.struct("votes", "object_class")).alias("w"))
    share = F.col("w.votes") / F.col("all")
    ok = (F.col("best") >= MIN_SIMILARITY) & (share >= MIN_SHARE) & ~F.col("w.object_class").isin(*NEVER_GUESSED)
    return total.where(ok).select("name", F.col("w.object_class").alias("object_class"), F.round(share, 4).alias("share"), F.round("best", 4).alias("similarity"))


def diameter_m(text: Column) -> Column:
    """Pipe diameter written in a label, metres, when it is 20..4000 mm."""
    mm = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"(?iu)(?:^|[^a-zа-я])(?:d|ду|ø|ф)\s*=?\s*(\d{2,4})", 1)
    value = F.when(mm != "", mm.cast("int"))
    return F.when(value.between(20, 4000), value / 1000.0)


PAVED_LABELS = ("А", "Ц", "ПЛ", "БР", "Б", "Щ", "ГР", "АСФ", "ПЛИТКА")  # fixed values
SOIL_LABELS = ("ГАЗОН", "ГРУНТ", "ЦВЕТНИК", "КЛУМБА")
PAVED_PHRASE = r"ПОКР|^(?:ДЕТ|СПОРТ|ХОЗ|ИГР)[^0-9A-Za-zА-Яа-яЁё_]*ПЛ|ПЛОЩАДК|АСФАЛЬТ|БРУСЧ|ПЛИТК|ТЕРРАВЕЙ"
SOIL_PHRASE = r"ГАЗОН|ЦВЕТНИК|КЛУМБ"
FUNCTIONAL_PHRASE = r"^(?:ДЕТ|СПОРТ|ХОЗ|ИГР)[^0-9A-Za-zА-Яа-яЁё_]*ПЛ|ПЛОЩАДК"


def label_material(text: Column) -> Column:
    """paved, soil or null; a text that speaks of both says nothing."""
    plain = F.rtrim(F.upper(F.trim(text)), F.lit("."))
    paved, soil = plain.rlike(PAVED_PHRASE), plain.rlike(SOIL_PHRASE)
    return F.when(plain.isin(*PAVED_LABELS), "paved").when(plain.isin(*SOIL_LABELS), "soil").when(paved & ~soil, "paved").when(soil & ~paved, "soil")


BED_PHRASE, LAWN_PHRASE = r"ЦВЕТНИК|КЛУМБ", r"ГАЗОН"


def label_is_functional(text: Column) -> Column:
    """Does a label name a playground, a sports ground or the like?"""
    return F.coalesce(F.upper(F.trim(text)).rlike(FUNCTIONAL_PHRASE), F.lit(False))


def label_planting(text: Column) -> Column:
    """lawn, bed or null: what a label of drawn soil says grows there; both words say lawn."""
    plain = F.upper(text)
    return F.when(plain.rlike(LAWN_PHRASE), "lawn").when(plain.rlike(BED_PHRASE), "bed")


# Signs in building labels.
PORCH_TEXTS = ("А", "Б", "Ц")
CONTAINER_TEXTS = ("М.Я", "МЯ")
GROUND_TEXTS = ("ФУНД", "КОТЛОВАН", "ПОДЗ.СООР", "РАЗР")
MAX_FLOORS = 60
STOREY_M, PLINTH_M, ONE_STOREY_M = 3.0, 1.2, 4.0
PORCH_M, CONTAINER_M = 0.45, 1.5
RESIDENTIAL_FLOORS, LETTER_FLOORS, LARGE_FLOORS = 5, 1, 5


def building_sign(text: Column) -> Column:
    """struct(floors, wall, use, porch, container, ground) read from one building label."""
    plain = F.regexp_replace(F.translate(F.upper(text), "‒–—―−ABCEHKMOPTX", "-----АВСЕНКМОРТХ"), r"\s+", "")
    bare = F.rtrim(plain, F.lit("."))
    sign = r"^(СМ|К|М)?-?(Ж|Н)?-?(\d{1,2})?$"
    part = lambda i: F.when(plain.rlike(sign), F.regexp_extract(plain, sign, i))
    floors = F.when(part(3) != "", part(3).cast("int"))
    special = plain.isin(*PORCH_TEXTS) | bare.isin(*CONTAINER_TEXTS) | bare.isin(*GROUND_TEXTS)
    wall = F.when(part(1) == "К", "brick").when(part(1) == "М", "metal").when(part(1) == "СМ", "mixed")
    use = F.when(part(2) == "Ж", "residential").when(part(2) == "Н", "non_residential")
    return F.struct(
        F.when(~special & floors.between(1, MAX_FLOORS), floors).alias("floors"), F.when(~special, wall).alias("wall"), F.when(~special, use).alias("use"),
        plain.isin(*PORCH_TEXTS).alias("porch"), bare.isin(*CONTAINER_TEXTS).alias("container"), bare.isin(*GROUND_TEXTS).alias("ground"),
    )


def storey_height(floors: Column) -> Column:
    return F.when(floors == 1, ONE_STOREY_M).otherwise(F.round(STOREY_M * floors + PLINTH_M, 2))


def floors_by_area(area: Column) -> Column:
    return F.when(area < 150.0, 1).when(area < 600.0, 2).otherwise(LARGE_FLOORS)


SHARED_WALL_M = 2.0  # fixed value: a neighbour lends its storeys along a wall from this length


def heights(faces: DataFrame, walls: DataFrame) -> DataFrame:
    """Storeys, source and height of ``faces(face, area, floors, wall, use, porch, container)``.

    A face without a label takes the storeys of the labelled neighbour along the longest shared wall (``walls(a, b, shared_m)``,
    ties to the smaller face). Only labels are lent, so storeys do not wander from house to house.
    """
    long_ = walls.where(F.round("shared_m", 6) >= SHARED_WALL_M)
    both = long_.select(F.col("a").alias("face"), F.col("b").alias("_other"), "shared_m").unionByName(long_.select(F.col("b").alias("face"), F.col("a").alias("_other"), "shared_m"))
    lent = both.join(faces.where("floors is not null").select(F.col("face").alias("_other"), F.col("floors").alias("_floors")), "_other")
    donors = lent.groupBy("face").agg(F.max_by("_floors", F.struct(F.round("shared_m", 6), -F.col("_other"))).alias("_lent"))
    known, lettered = F.col("floors").isNotNull(), F.col("wall").isNotNull() | F.col("use").isNotNull()
    low = F.when(known, F.lit(None)).when(F.col("container"), "container").when(F.col("porch"), "porch")
    rows = faces.join(donors, "face", "left").withColumn("_low", low)
    source = F.when(known, "label").when(F.col("_low").isNotNull(), "letter").when(F.col("_lent").isNotNull(), "neighbor").when(lettered, "letter").otherwise("assumed")
    by_letter = F.when(F.col("use") == "residential", RESIDENTIAL_FLOORS).otherwise(LETTER_FLOORS)
    floors = F.when(known, F.col("floors")).when(F.col("_low").isNotNull(), F.lit(None)).when(F.col("_lent").isNotNull(), F.col("_lent")).when(lettered, by_letter).otherwise(floors_by_area(F.col("area")))
    rows = rows.withColumn("source", source).withColumn("floors", floors)
    height = F.when(F.col("floors").isNotNull(), storey_height(F.col("floors"))).when(F.col("_low") == "porch", PORCH_M).otherwise(CONTAINER_M)
    return rows.withColumn("height_m", height).drop("_low", "_lent")


def class_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in entries.items() for v in pair])

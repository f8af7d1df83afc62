"""What a table holds and who would use it, from names, values and row counts.

Each classifier scores a table of constant rules against one row of facts per
dataset, so a whole catalog of tables is classified by one query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.dates import to_timestamp_or_null
from ledgerlens.functions.numbers import grouped_text, rounded
from ledgerlens.functions.text import hits_in, looks_like_date, quoted
from ledgerlens.plans import signatures as sig
from ledgerlens.plans.catalog import columns_of, union_all, value_shapes
from ledgerlens.plans.ordered import staged


@dataclass(frozen=True)
class Source:
    """A dataset to classify: its rows, a column that orders them (for callers that show rows), its file name."""

    df: DataFrame
    order_by: str = ""
    filename: str = ""
    is_model: bool = False


def _words(values) -> Column:
    """Array literal of constant strings."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def typed_columns(source: Source) -> DataFrame:
    """(ordinal, column, is_date, is_numeric): by type, or because over 80 % of all values read so."""
    shapes = value_shapes(source.df)
    return shapes.select(
        "ordinal", "column", ((F.col("kind") == "temporal") | (F.col("dates") > 0.8)).alias("is_date"),
        (F.col("kind").isin("numeric", "boolean") | (F.col("numbers") > 0.8)).alias("is_numeric"),
    ).where(F.col("is_date") | F.col("is_numeric"))


def needed_texts(pattern: str) -> list[str] | None:
    """For each branch of a value pattern a text that every match of it holds, in lower case; None if one has none.

    Looking for a text is much cheaper than a pattern, and most rows hold none of them.
    """
    out = []
    for branch in re.split(r"\|(?![^(]*\))", pattern):
        plain = re.sub(r"\([^)]*\)|\[[^]]*\](\{\d+,?\d*\}|[*+?])?|\\[dsw](\{\d+,?\d*\}|[*+?])?|\\?[^\\][*?]", "\0", branch)
        runs = re.sub(r"[+.^]|\{[^}]*\}", "\0", re.sub(r"\\(.)", lambda m: "\1" if m[1] == "+" else "\2" if m[1] == "." else m[1], plain))
        best = max((r.replace("\1", "+").replace("\2", ".") for r in runs.split("\0")), key=len)
        choice = re.search(r"\(([A-Za-z|]+)\)(?![*?])", branch)
        if choice and len(best) < 2:  # one of the group's words is in every match
            out += [word.lower() for word in choice[1].split("|")]
        elif best:
            out.append(best.lower())
        else:
            return None
    return out


#: Screens of groups of patterns: which patterns belong to one, and what every match of theirs holds in a lower-case line.
PATTERN_GROUPS = (
    (r"[A-Za-z]+-\\d\+", lambda lowered: lowered.rlike("[a-z]-[0-9]")),
    (r"[A-Za-z]+_\\d\+", lambda lowered: lowered.rlike("[a-z]_[0-9]")),
    (r"\\d\+\\s\*.*|\[1-5\]\\s\*.*", lambda lowered: lowered.rlike(r"[0-9]\s*[a-z]")),
)


def _tests(line: Column, lowered: Column, patterns: list[tuple[int, str]], left: Column) -> Column:
    mask = F.lit(0).cast("bigint")
    for i, pattern in patterns:
        test = line.rlike("(?i)" + pattern)
        texts = needed_texts(pattern)
        if texts:
            some = F.lit(False)
            for text in texts:
                some = some | lowered.contains(text)
            exact = all(re.fullmatch(r"[A-Za-z_ -]+", b) for b in pattern.split("|"))
            test = some if exact else some & test
        bit = F.lit(1 << i).cast("bigint")
        mask = mask.bitwiseOR(F.when((left.bitwiseAND(bit) != 0) & test, bit).otherwise(F.lit(0).cast("bigint")))
    return mask


def pattern_mask(line: Column, lowered: Column, patterns: list[str], left: Column | None = None) -> Column:
    """Bit i is set if the line holds pattern i and bit i of ``left`` is set (if given).

    Patterns of one shape are looked for only in lines that hold the shape.
    """
    left = F.lit((1 << len(patterns)) - 1).cast("bigint") if left is None else left
    rest, mask = list(enumerate(patterns)), F.lit(0).cast("bigint")
    for shape, screen in PATTERN_GROUPS:
        own = [(i, p) for i, p in rest if re.fullmatch(shape, p)]
        if len(own) > 1:
            rest = [x for x in rest if x not in own]
            some = left.bitwiseAND(F.lit(sum(1 << i for i, _ in own)).cast("bigint")) != 0
            mask = mask.bitwiseOR(F.when(some & screen(lowered), _tests(line, lowered, own, left)).otherwise(F.lit(0).cast("bigint")))
    return mask.bitwiseOR(_tests(line, lowered, rest, left))


#: Rows of a table that are looked at before all are: what they hold needs no second look.
FIRST_ROWS = 2_000
#: Patterns of one shape stand together, so that a block holds whole groups.
ALL_PATTERNS = tuple(sorted({p for *_, pats in sig.CONTENT_SIGNATURES for p in pats},
                            key=lambda p: (next((k for k, (shape, _) in enumerate(PATTERN_GROUPS) if re.fullmatch(shape, p)), 99), p)))
PATTERN_BLOCKS = tuple(ALL_PATTERNS[i:i + 20] for i in range(0, len(ALL_PATTERNS), 20))


def found_patterns(sources: dict[str, Source]) -> dict[str, list[str]]:
    """The value patterns that some row's text and date columns contain, by dataset.

    The lines of all tables are looked at by one aggregate: first a few rows of each, then all rows for the
    patterns that those did not hold.
    """
    readable = {n: [c for c in columns_of(s.df) if c.kind in ("string", "temporal")] for n, s in sources.items()}
    found = {n: [0] * len(PATTERN_BLOCKS) for n in sources}
    full = [(1 << len(block)) - 1 for block in PATTERN_BLOCKS]
    for rows in (FIRST_ROWS, None):
        parts = []
        for name, s in sources.items():
            left = [every & ~own for every, own in zip(full, found[name])]
            if readable[name] and any(left):
                line = F.concat_ws(" ", *[quoted(c.name).cast("string") for c in readable[name]])
                lines = s.df.select(F.lit(name).alias("dataset"), *[F.lit(m).cast("bigint").alias(f"left{k}") for k, m in enumerate(left)], line.alias("line"))
                parts.append(lines if rows is None else lines.limit(rows))
        if not parts:
            break
        lines = union_all(parts).withColumn("lowered", F.lower("line"))
        masks = lines.groupBy("dataset").agg(*[
            F.bit_or(pattern_mask(F.col("line"), F.col("lowered"), list(block), F.col(f"left{k}"))).alias(f"p{k}") for k, block in enumerate(PATTERN_BLOCKS)])
        for r in masks.collect():  # a row for each dataset
            found[r["dataset"]] = [own | r[f"p{k}"] for k, own in enumerate(found[r["dataset"]])]
    return {n: [p for k, block in enumerate(PATTERN_BLOCKS) for i, p in enumerate(block) if own[k] >> i & 1] for n, own in found.items()}


def dataset_facts(sources: dict[str, Source], values: bool = True, patterns: bool = True) -> DataFrame:
    """One row per dataset: names, size, and what its values look like, from all rows of each.

    Without ``patterns`` no value patterns are looked for (``found`` is empty), and without ``values``
    only names, the schema and the number of rows count.
    """
    found = found_patterns(sources) if values and patterns else {}
    parts = []
    for name, s in sources.items():
        infos = columns_of(s.df)
        strings = [c for c in infos if c.kind == "string"]
        dated = any(c.kind == "temporal" for c in infos)
        constants = [
            F.lit(name).alias("dataset"), F.lit(s.filename.lower()).alias("filename"), F.lit(s.is_model).alias("is_model"),
            F.lit(len(infos)).alias("cols"), _words([c.name.lower() for c in infos]).alias("names"),
            F.lit(any(c.kind in ("numeric", "boolean") for c in infos)).alias("has_numbers"),
            F.lit(any("id" in c.name.lower() for c in infos)).alias("has_ids")]
        if not values:
            parts.append(s.df.agg(F.count(F.lit(1)).alias("rows")).select(*constants, "rows"))
            continue
        wordy, all_dates = F.lit(False), F.lit(dated)
        for c in strings:
            text = quoted(c.name)
            wordy = wordy | F.coalesce(F.avg(F.length(text)) > 50, F.lit(False))
            if not dated:
                is_date = looks_like_date(text) & to_timestamp_or_null(text, s.df.schema[c.name].dataType).isNotNull()
                all_dates = all_dates | F.coalesce(F.min(F.when(text.isNotNull(), F.coalesce(is_date, F.lit(False)))), F.lit(False))
        row = s.df.agg(F.count(F.lit(1)).alias("rows"), wordy.alias("has_text_content"), all_dates.alias("has_dates"))
        parts.append(row.select(*constants, "rows", "has_text_content", "has_dates", _words(found.get(name, ())).alias("found")))
    facts = union_all(parts)
    # one small row per dataset from here on; the scans behind it run once
    return staged(facts) if values else facts


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), of.cast("double")), F.lit(0.0))


def content_scores(facts: DataFrame) -> DataFrame:
    """(dataset, ordinal, content_type, category, column_score, value_score, pattern_score, hint_score, raw_score)."""
    known = {t for t, *_ in sig.CONTENT_SIGNATURES}
    rules = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("content_type"), F.lit(cat).alias("category"), _words(req).alias("required"),
                 _words(opt).alias("optional"), _words(pats).alias("patterns"),
                 _words([h for h, target in sig.FILENAME_HINTS if target == t]).alias("hints"))
        for i, (t, cat, req, opt, pats) in enumerate(sig.CONTENT_SIGNATURES)
    ]
    for target in dict.fromkeys(t for _, t in sig.FILENAME_HINTS if t not in known):
        rules.append(F.struct(F.lit(len(rules)).alias("ordinal"), F.lit(target).alias("content_type"), F.lit("unknown").alias("category"),
                              _words(()).alias("required"), _words(()).alias("optional"), _words(()).alias("patterns"),
                              _words([h for h, t in sig.FILENAME_HINTS if t == target]).alias("hints")))
    text = F.array_join(F.transform("names", lambda n: F.translate(n, "_-", "  ")), " ")
    grid = facts.withColumn("names_text", text).select("*", F.inline(F.array(*rules)))
    required = hits_in(F.col("names_text"), F.col("required"))
    optional = _share(hits_in(F.col("names_text"), F.col("optional")), F.size("optional"))
    names = F.when(required > 0, _share(required, F.size("required")) * 0.7 + optional * 0.3).otherwise(0.0)
    found = F.size(F.array_intersect("patterns", "found"))
    kind = F.col("content_type")
    shape = (
        F.when((kind == "time_series") & F.col("has_dates"), 0.5)
        .when(kind.isin("sales_transactions", "financial_data") & F.col("has_numbers"), 0.3)
        .when(kind.isin("customers", "orders") & F.col("has_ids"), 0.2).otherwise(0.0))
    scored = grid.select(
        "dataset", "rows", "cols", "names", "ordinal", "content_type", "category", names.alias("column_score"),
        _share(found, F.size("patterns")).alias("value_score"), shape.alias("pattern_score"),
        (hits_in(F.col("filename"), F.col("hints")) * 0.3).alias("hint_score"))
    total = F.col("column_score") + F.col("value_score") + F.col("pattern_score") + F.col("hint_score")
    # rounded so that equal sums of different addends still tie
    return scored.withColumn("raw_score", F.round(total, 9)).where((F.col("category") != "unknown") | (F.col("hint_score") > 0))


def _entities(names: Column, table: tuple) -> Column:
    def named(words: tuple) -> Column:
        return F.exists(names, lambda n: F.exists(_words(words), lambda w: n.contains(w)))

    return F.concat_ws(",", *[F.when(named(words), F.lit(entity)) for entity, words in table])


def content_types(sources: dict[str, Source], facts: DataFrame | None = None) -> DataFrame:
    """Best content type per dataset with confidence, raw score, role, wording and up to three alternatives."""
    scores = content_scores(dataset_facts(sources) if facts is None else facts)
    top = Window.partitionBy("dataset")
    order = top.orderBy(F.col("raw_score").desc(), "ordinal")
    ranked = scores.withColumn("best", F.max("raw_score").over(top)).withColumn("rank", F.row_number().over(order))
    share = F.when(F.col("best") > 0, F.try_divide(F.col("raw_score"), F.col("best"))).otherwise(0.0)
    ranked = ranked.withColumn("share", share)
    alternate = F.when((F.col("rank") > 1) & (F.col("rank") <= 4) & (F.col("share") > 0.15), F.struct("rank", "content_type"))
    first = F.col("rank") == 1

    def of_best(col: str) -> Column:
        return F.max(F.when(first, F.col(col))).alias(col)

    rolled = ranked.groupBy("dataset").agg(
        *[of_best(c) for c in ("content_type", "category", "share", "raw_score", "rows", "cols", "names", "column_score", "value_score", "pattern_score")],
        F.array_join(F.transform(F.array_sort(F.collect_list(alternate)), lambda a: a["content_type"]), ",").alias("alternates"))
    known = F.col("share") >= 0.2
    kind = F.when(known, F.col("content_type")).otherwise("unknown")
    roles = F.create_map(*[F.lit(x) for kv in sig.CONTENT_ROLES.items() for x in kv])
    texts = F.create_map(*[F.lit(x) for kv in sig.CONTENT_TEXTS.items() for x in kv])
    wording = F.coalesce(F.try_element_at(texts, kind), F.concat(F.initcap(F.translate(kind, "_", " ")), F.lit(" Data")))
    return rolled.select(
        "dataset", kind.alias("content_type"), F.when(known, F.col("category")).otherwise("unknown").alias("category"),
        F.when(known, rounded(F.least(F.col("share") * 100, F.lit(99.0)), 1)).otherwise(0.0).alias("confidence"),
        rounded(F.col("raw_score"), 4).alias("raw_score"),
        F.when(known, F.coalesce(F.try_element_at(roles, kind), F.lit("reference"))).otherwise("unknown").alias("role"),
        F.when(known, F.concat(wording, F.lit(" ("), grouped_text(F.col("rows")), F.lit(" rows, "), F.col("cols").cast("string"), F.lit(" columns)")))
        .otherwise("Unable to classify data type").alias("description"),
        F.when(known, F.col("alternates")).otherwise("").alias("alternates"),
        F.when(known, _entities(F.col("names"), sig.CONTENT_ENTITIES)).otherwise("").alias("entities"),
        *[rounded(F.col(f"{c}_score") * 100, 1).alias(f"{c}_match") for c in ("column", "value", "pattern")],
    )


def time_coverage(sources: dict[str, Source]) -> DataFrame:
    """First column that reads as dates, with its range, per dataset."""
    out = None
    for name, s in sources.items():
        cands = [c for c in columns_of(s.df) if c.kind in ("temporal", "string")]
        if not cands:
            continue
        times = {c.ordinal: to_timestamp_or_null(quoted(c.name), s.df.schema[c.name].dataType).cast("date") for c in cands}
        for c in cands:
            if c.kind == "string":
                times[c.ordinal] = F.when(looks_like_date(quoted(c.name)), times[c.ordinal])
        wide = s.df.agg(*[fn(t).alias(f"{tag}{o}") for o, t in times.items() for tag, fn in (("lo", F.min), ("hi", F.max))])
        picks = [F.when(F.col(f"lo{c.ordinal}").isNotNull(), F.struct(
            F.col(f"lo{c.ordinal}").alias("start"), F.col(f"hi{c.ordinal}").alias("end"), F.lit(c.name).alias("column"))) for c in cands]
        part = wide.select(F.lit(name).alias("dataset"), F.coalesce(*picks).alias("p")).where(F.col("p").isNotNull()).select("dataset", "p.*")
        out = part if out is None else out.unionByName(part)
    return out


def dataset_roles(sources: dict[str, Source], facts: DataFrame | None = None) -> DataFrame:
    """Business role per dataset with confidence; under 0.8 a person should confirm."""
    facts = dataset_facts(sources, patterns=False) if facts is None else facts
    shown = {
        "has_date": F.col("has_dates"), "no_dates": ~F.col("has_dates"), "has_amount": F.col("has_numbers"),
        "small_row_count": F.col("rows") < 100, "has_text_content": F.col("has_text_content"),
    }
    scored = []
    for i, (role, patterns, words, traits, of, weight) in enumerate(sig.ROLE_SIGNALS):
        matched = F.size(F.filter(_words(patterns), lambda p: F.exists("names", lambda n: F.rlike(n, p))))
        named = F.size(F.filter(_words(words), lambda w: F.exists("names", lambda n: n.contains(w))))
        traits_hit = F.lit(0)
        for t in traits:
            traits_hit = traits_hit + F.when(shown[t], 1).otherwise(0)
        score = matched / F.lit(len(patterns)) * 0.4 + named / F.lit(len(words)) * 0.3 + traits_hit / F.lit(of) * 0.3
        scored.append(F.struct(F.round(score * weight, 9).alias("score"), F.lit(-i).alias("first"), F.lit(role).alias("role")))
    best = F.array_max(F.array(*scored))
    confidence = rounded(F.least(best["score"], F.lit(0.99)), 2)
    return facts.select("dataset", best["role"].alias("role"), confidence.alias("confidence"), (confidence < 0.8).alias("requires_confirmation"),
                        _entities(F.col("names"), sig.ROLE_ENTITIES).alias("entities"))


def early_types(facts: DataFrame) -> DataFrame:
    """Category per dataset by the early keyword detector; under 20 points it is general."""
    scored = []
    for i, (category, words) in enumerate(sig.EARLY_CATEGORIES):
        hits = F.size(F.filter(_words(words), lambda w: F.exists("names", lambda n: n.contains(w))))
        exact = F.size(F.array_intersect("names", _words(words)))
        score = F.round(hits / F.lit(len(words)) + exact * 0.2, 9)
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("first"), F.lit(category).alias("category")))
    best = F.array_max(F.array(*scored))
    points = F.least(F.lit(100), F.floor(F.round(best["score"] * 100, 6))).cast("int")
    return facts.select("dataset", F.when(points < 20, "general").otherwise(best["category"]).alias("category"), points.alias("confidence"))


def _keyword_scores(facts: DataFrame) -> DataFrame:
    """(dataset, persona, domain, category, score): half a point per name hit, one per file name hit."""
    rules = [
        F.struct(F.lit(p).alias("persona"), F.lit(d).alias("domain"), F.lit(c).alias("category"), _words(w).alias("words"))
        for p, d, c, w in sig.PERSONA_WORDS
    ]
    grid = facts.where(~F.col("is_model") & (F.col("rows") > 0)).select("dataset", "filename", "names", F.inline(F.array(*rules)))
    in_names = F.aggregate("names", F.lit(0), lambda acc, n: acc + hits_in(n, F.col("words")))
    score = in_names * 0.5 + hits_in(F.col("filename"), F.col("words")) * 1.0
    return grid.select("dataset", "persona", "domain", "category", score.alias("score")).where(F.col("score") > 0)


def _decide(points: DataFrame, models: Column, dashboards: dict) -> DataFrame:
    """Persona of a set of datasets from (persona, score) rows; models add five points each to engineering."""
    def of(p: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("persona") == p, F.col("score"))), F.lit(0.0))

    sums = points.agg(*[of(p).alias(p) for p in PERSONA_SUMS]).select(
        "business", "analytics", (F.col("ml_engineer") + models * 5.0).alias("ml_engineer"), "developer", models.alias("models"))
    mixed = F.when((F.col("analytics") > 0) & (F.col("ml_engineer") > 0), (F.col("analytics") + F.col("ml_engineer")) * 0.8).otherwise(0.0)
    sums = sums.withColumn("data_scientist", mixed)
    total = sum((F.col(p) for p in sig.PERSONAS), F.lit(0.0))
    nothing = total == 0
    analytics = F.when(nothing, 1.0).otherwise(F.col("analytics"))
    ranked = F.array_max(F.array(*[
        F.struct(F.round(analytics if p == "analytics" else F.col(p), 9).alias("score"), F.lit(-i).alias("first"), F.lit(p).alias("persona"))
        for i, p in enumerate(sig.PERSONAS)]))
    board = F.create_map(*[F.lit(x) for kv in dashboards.items() for x in kv])
    advice = F.create_map(*[F.lit(x) for p, a in sig.PERSONA_ADVICE.items() for x in (p, "; ".join(a))])
    return sums.withColumn("best", ranked).select(
        F.col("best.persona").alias("persona"), rounded(F.when(nothing, 1.0).otherwise(F.try_divide(F.col("best.score"), total)), 4).alias("confidence"),
        F.when(F.col("models") > 0, "ml_model_dashboard").otherwise(F.element_at(board, F.col("best.persona"))).alias("dashboard_type"),
        F.element_at(advice, F.col("best.persona")).alias("recommended"),
        *[rounded(F.when(nothing & F.lit(p == "analytics"), 1.0).otherwise(F.col(p)), 4).alias(f"{p}_score") for p in sig.PERSONAS])


PERSONA_SUMS = ("business", "analytics", "ml_engineer", "developer")


def persona(sources: dict[str, Source], facts: DataFrame | None = None) -> DataFrame:
    """Who the datasets are for, by keywords in column and file names."""
    facts = dataset_facts(sources, values=False) if facts is None else facts
    models = F.lit(sum(s.is_model for s in sources.values()))
    return _decide(_keyword_scores(facts), models, sig.PERSONA_DASHBOARDS)


def persona_domains(facts: DataFrame) -> DataFrame:
    """(domain, category, score) the keywords point to, over all datasets."""
    title = F.create_map(*[F.lit(x) for kv in (("business", "Business/"), ("analytics", "Analytics/"), ("ml_engineer", "ML/")) for x in kv])
    return _keyword_scores(facts).groupBy(F.concat(F.element_at(title, F.col("persona")), F.col("domain")).alias("domain"), "category").agg(
        rounded(F.sum("score"), 4).alias("score"))


def persona_by_content(sources: dict[str, Source], facts: DataFrame | None = None) -> DataFrame:
    """Who the datasets are for, by their content types; keywords decide for unknown ones."""
    facts = dataset_facts(sources) if facts is None else facts
    kinds = content_types(sources, facts)
    weights = [F.struct(F.lit(p).alias("persona"), F.lit(w).alias("weight"), _words(types).alias("types")) for p, w, types in sig.CONTENT_PERSONAS]
    grid = kinds.select("dataset", "content_type", "confidence", F.inline(F.array(*weights)))
    spoken = grid.where(F.array_contains(F.col("types"), F.col("content_type"))).select(
        "persona", (F.col("confidence") / 100 * F.col("weight")).alias("score"))
    unknown = kinds.where(F.col("content_type") == "unknown").select("dataset")
    fallback = _keyword_scores(facts).join(unknown, "dataset", "left_semi").select("persona", "score")
    return _decide(spoken.unionByName(fallback), F.lit(sum(s.is_model for s in sources.values())), sig.CONTENT_DASHBOARDS)


def session_persona(kinds: DataFrame) -> DataFrame:
    """Persona of a session: the category most of its datasets fall in."""
    dominant = kinds.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("dataset").alias("first")).orderBy(F.col("n").desc(), "first").limit(1)
    table = F.create_map(*[F.lit(x) for kv in sig.SESSION_PERSONAS.items() for x in kv])
    return dominant.select("category", "n", F.coalesce(F.try_element_at(table, F.col("category")), F.lit("general")).alias("persona"))

"""Glossaries: layering, freezing, fingerprints and term hits.

A sense is a row of SENSE. Merging and freezing keep one row for each id; hits find, for each text,
the approved senses one of whose forms occurs in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# The columns of a sense, and its states.
STRINGS = ("id", "surface", "zh", "parent", "author", "first_use", "definition_zh", "decision", "status", "layer")
ARRAYS = ("surface_aliases", "aliases_zh", "forbidden_zh", "evidence", "overrides")
SENSE = "id string, surface string, zh string, surface_aliases array<string>, parent string, author string, first_use string, aliases_zh array<string>, forbidden_zh array<string>, definition_zh string, evidence array<string>, decision string, status string, layer string, overrides array<string>"
APPROVED, CANDIDATE, SUPERSEDED = "approved", "candidate", "superseded"
#: Glossaries of up to this many forms are sent to every executor.
BROADCAST_FORMS = 200


class OverrideWithoutReason(ValueError):
    """A layer changes a translation and gives no decision."""


def complete(senses: DataFrame) -> DataFrame:
    """All columns of SENSE; what is missing or null gets its default. Other columns stay."""
    more = [c for c in senses.columns if c not in STRINGS + ARRAYS]
    have = set(senses.columns)

    def column(name: str) -> Column:
        if name in ARRAYS:
            empty = F.array().cast("array<string>")
            return (F.coalesce(F.col(name), empty) if name in have else empty).alias(name)
        default = F.lit(CANDIDATE if name == "status" else "")
        return (F.coalesce(F.col(name).cast("string"), default) if name in have else default).alias(name)

    order = [x.split(" ")[0] for x in SENSE.split(", ")]
    return senses.select(*map(column, order), *more)


def source_forms(surface: Column, aliases: Column) -> Column:
    """Trimmed forms of a sense in their order, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(surface), F.coalesce(aliases, F.array().cast("array<string>"))), strip), lambda x: x != ""))


def display_first_use(first_use: Column, zh: Column, surface: Column) -> Column:
    return F.when(F.coalesce(first_use, F.lit("")) != "", first_use).otherwise(F.concat(zh, F.lit("（"), surface, F.lit("）")))


def to_json(senses: DataFrame) -> DataFrame:
    """id and the sense as JSON without empty fields."""
    order = [x.split(" ")[0] for x in SENSE.split(", ")]
    fields = [F.when((F.size(c) if c in ARRAYS else F.length(c)) > 0, F.col(c)).alias(c) for c in order]
    return senses.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    return complete(rows.select(F.from_json(column, SENSE).alias("s")).select("s.*"))


def approved(senses: DataFrame) -> DataFrame:
    return senses.where(F.col("status") == APPROVED)


def candidates(senses: DataFrame) -> DataFrame:
    return senses.where(F.col("status") == CANDIDATE)


def for_surface(senses: DataFrame, surface: str) -> DataFrame:
    return senses.where(F.lower(strip(F.col("surface"))) == surface.strip().lower())


def by_id(senses: DataFrame, sense_id: str):
    """The first sense with an id, or KeyError."""
    found = senses.where(F.col("id") == sense_id).take(1)
    if not found:
        raise KeyError(sense_id)
    return found[0]


def merge_layers(*layers: DataFrame, names: tuple[str, ...] = ("global", "domain", "book"), strict: bool = True) -> DataFrame:
    """One row for each id: the last layer's, in the order in which ids first appear.

    Where a layer changes zh it must give a decision, or OverrideWithoutReason is raised (the check
    is one aggregate; strict=False leaves it out); overrides collects the translations that were
    changed, oldest first. Rows within a layer count in the order of their seq column, or of their id
    where there is none."""
    rows = None
    for rank, (name, layer) in enumerate(zip(names, layers)):
        seq = F.col("seq").cast("string") if "seq" in layer.columns else F.lit("")
        part = complete(layer.drop("seq") if "seq" in layer.columns else layer)
        tagged = layer.select(F.col("id").alias("_id"), seq.alias("_seq")) if "seq" in layer.columns else None
        if tagged is not None:
            part = complete(layer).withColumn("_seq", F.lpad(F.col("seq").cast("string"), 20, "0")).drop("seq")
        else:
            part = part.withColumn("_seq", F.lit(""))
        part = part.withColumn("layer", F.lit(name)).withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    by = Window.partitionBy("id").orderBy("_rank", "_seq", "zh")
    rows = rows.withColumn("_before", F.lag("zh").over(by)).withColumn("_changed", F.col("_before").isNotNull() & (F.col("_before") != F.col("zh")))
    if strict and (bad := rows.where("_changed AND decision = ''").select("id", "layer").take(5)):
        raise OverrideWithoutReason("; ".join(f"{r['id']}: layer {r['layer']} changes the translation without a decision" for r in bad))
    order = F.struct("_rank", "_seq", "zh")
    kept = [c for c in rows.columns if not c.startswith("_")]
    merged = rows.groupBy("id").agg(
        F.max_by(F.struct(*kept), order).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("_changed"), F.struct("_rank", "_seq", "zh", "_before")))).alias("o"),
        F.min(F.struct("_rank", "_seq", "id")).alias("first"),
    )
    changed = F.transform("o", lambda x: x["_before"])
    return merged.select(*[changed.alias("overrides") if c == "overrides" else F.col(f"s.{c}").alias(c) for c in kept], "first").orderBy("first").drop("first")


def _json(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def fingerprint(senses: DataFrame) -> DataFrame:
    """version: 16 hex digits over what a translation depends on, whatever the order of rows and
    aliases. One small row; glossaries are curated by hand."""

    def field(name: str) -> Column:
        if name in ARRAYS:
            return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(name), _json), ", "), F.lit("]"))
        return _json(F.col(name))

    names = sorted(["id", "surface", "zh", "parent", "author", "first_use", "surface_aliases", "aliases_zh", "forbidden_zh", "status"])
    record = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), field(n)) for n in names]), F.lit("}"))
    rows = senses.agg(F.array_sort(F.collect_list(F.struct(F.col("id"), record.alias("r")))).alias("x"))
    blob = F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["r"]), ", "), F.lit("]"))
    return rows.select(F.substring(F.sha2(blob.cast("binary"), 256), 1, 16).alias("version"))


def freeze(senses: DataFrame, domain: str = "", authors: list[str] | None = None) -> DataFrame:
    """Approved senses with version and domain, by id; with authors, only theirs and those of none."""
    frozen = approved(complete(senses))
    if authors is not None:
        frozen = frozen.where((F.col("author") == "") | F.col("author").isin(*authors) if authors else F.col("author") == "")
    return frozen.crossJoin(F.broadcast(fingerprint(frozen))).withColumn("domain", F.lit(domain)).orderBy("id")


def term_pattern(form: Column) -> Column:
    """The regex of a form: whole words, any white space between them, simple plurals (or the verb
    endings of two metaphors), and the case of the form only where it is all capitals."""
    core = F.regexp_replace(strip(form), r"([^\p{L}\p{N}\s_])", r"\\$1")
    core = F.regexp_replace(core, r" ", r"\\s+")
    suffix = F.when(F.lower(strip(form)).isin("hire", "fire"), F.lit("(?:d|s|ing)?")).otherwise(F.lit("(?:s|es)?"))
    letters = F.regexp_replace(form, r"\P{L}", "")
    exact = (letters != "") & (letters == F.upper(letters))
    return F.concat(F.when(exact, F.lit("(?U)")).otherwise(F.lit("(?iuU)")), F.lit(r"\b"), core, suffix, F.lit(r"\b"))


# Phrases in which a surface is no use of the term.
NOT_A_HIT = {"fire": r"(?i)\bforest\s+fires?\b|\bon\s+fire\b", "lemon": r"(?i)\bLemon\s+V8\b"}


def _searchable(text: Column, surface: Column) -> Column:
    out = text
    for word, pattern in NOT_A_HIT.items():
        out = F.when(F.lower(strip(surface)) == word, F.regexp_replace(text, pattern, "")).otherwise(out)
    return out


# no other numbers, such as superscripts: a term's pattern may end before one
_WORDS = r"(?U)[\p{L}\p{Nd}\p{Nl}_]+"


def _low(text: Column) -> Column:
    """Lower case, with the two letters folded that only a pattern takes for others."""
    return F.replace(F.replace(F.lower(text), F.lit("ſ"), F.lit("s")), F.lit("ς"), F.lit("σ"))


def form_key(form: Column) -> Column:
    """What a text must hold for a form to occur in it: the form's first word, or its first character where
    it has no word."""
    low = _low(strip(form))
    word = F.regexp_extract(low, _WORDS, 0)
    return F.when(word != "", word).otherwise(F.concat(F.lit("\x00"), F.substring(low, 1, 1)))


def text_keys(text: Column) -> Column:
    """The keys that a text holds: its words, and what they are without the endings that a term's pattern
    allows; other characters."""
    words = F.array_distinct(F.regexp_extract_all(_low(text), F.lit(_WORDS), F.lit(0)))
    stems = F.flatten(F.transform(words, lambda w: F.array(w, *[F.regexp_replace(w, f"{e}$", "") for e in ("s", "es", "d", "ing")])))
    marks = F.array_distinct(F.regexp_extract_all(_low(text), F.lit(r"(?U)[^\p{L}\p{Nd}\p{Nl}_\s]"), F.lit(0)))
    return F.array_union(F.array_distinct(stems), F.transform(marks, lambda c: F.concat(F.lit("\x00"), c)))


def meet(rows: DataFrame, forms: DataFrame, by: list[str], text: str, weight: Column | None = None, limit: int = BROADCAST_FORMS) -> DataFrame:
    """Each row beside the forms (column form) whose key its text holds; whether a form occurs is for the
    caller to decide. Forms of up to limit in all (weight tells how much one counts) are one broadcast
    row; more are joined by their key, and only row keys and forms go through that join. Both ways give
    the same rows."""
    keyed = forms.withColumn("_key", form_key(F.col("form")))
    total = forms.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    if total <= limit:
        listed = keyed.agg(F.collect_list(F.struct(*keyed.columns)).alias("_forms"))
        near = rows.crossJoin(F.broadcast(listed)).withColumn("_keys", text_keys(F.col(text)))
        held = F.filter("_forms", lambda f: F.array_contains(F.col("_keys"), f["_key"]))
        return near.select(*rows.columns, F.explode(held).alias("_f")).select(*rows.columns, *[f"_f.{c}" for c in forms.columns])
    near = rows.select(*by, F.explode(text_keys(F.col(text))).alias("_key")).join(keyed, "_key").drop("_key")
    return near.join(rows, by).select(*rows.columns, *forms.columns)


def hits(texts: DataFrame, senses: DataFrame, key: list[str], text: str = "text", broadcast_limit: int = BROADCAST_FORMS) -> DataFrame:
    """key, id, sense_order: each approved sense that occurs in a text, once for each text. A text meets
    only forms that it may hold (meet), then the form's pattern decides."""
    use = approved(complete(senses)).withColumn("_o", F.row_number().over(Window.orderBy("id")) if "sense_order" not in senses.columns else F.col("sense_order"))
    forms = use.select("id", "surface", F.col("_o").alias("sense_order"), F.explode(source_forms(F.col("surface"), F.col("surface_aliases"))).alias("form"))
    forms = forms.select("id", "surface", "sense_order", "form", term_pattern(F.col("form")).alias("pattern"))
    met = meet(texts.select(*key, F.col(text).alias("_t")), forms, key, "_t", limit=broadcast_limit)
    found = met.withColumn("searchable", _searchable(F.col("_t"), F.col("surface"))).where(F.expr("regexp(searchable, pattern)"))
    return found.select(*key, "id", "sense_order").distinct()


def known_forms(senses: DataFrame) -> DataFrame:
    """form (lower case), renderings: the translations configured for each source form; of senses
    that share a form the last one by id counts."""
    rendered = F.array_distinct(F.filter(F.concat(F.array("zh"), "aliases_zh", "forbidden_zh", "overrides"), lambda x: x != ""))
    rows = complete(senses).select("id", rendered.alias("renderings"), F.explode(source_forms(F.col("surface"), F.col("surface_aliases"))).alias("form"))
    return rows.groupBy(F.lower("form").alias("form")).agg(F.max_by("renderings", "id").alias("renderings"))



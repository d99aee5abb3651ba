"""Personal data by bootstrapped contextual extraction. Built-in expressions only.

Base rules find e-mail and IP addresses, payment cards and phone numbers. These seeds induce
lexical patterns: the word before, the word after, and both. Every other token with a digit
or an at sign is a candidate, and so is every maximal run of digits with spaces, brackets, dots,
hyphens and slashes that as a whole has the shape of a kind; its context is outside the run. Patterns and the texts found in them form a bipartite graph, on
which Spark scores both sides in turn: a pattern by the mean score of the texts found in it
(damped, so rare patterns stay low), a text by the best of its accepted patterns, however many
others it stands in; seeds keep 1 for their kind and 0 for others. Candidates of a kind's shape that stand in an accepted
pattern and score high enough are new spans, unless they lie inside a longer one. Base spans always stay.

Regular expressions start only where a run of their first class starts (or the last match
ended) and use possessive loops, so long runs cost linear time and no stack.

Defined results: a NULL text is empty and has no span; spans are code point offsets, end
exclusive; repeated rows get the same spans; extra columns do not matter; an empty table
gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolode.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
_S = r"\x20\x09-\x0D"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for its kind's expression to be run at all.
HINTS = {
    "email": r"@[A-Za-z0-9-]+\.",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
CANDIDATE = rf"(?<![^{_S}])[^{_S}0-9@]*+[0-9@][^{_S}]*+"
# Numbers written with spaces: whole digit groups, at most three separators between two.
RUN = (
    r"(?<![\p{L}0-9@_.,/-])[+(]{0,2}+[0-9]++(?![\p{L}@_])"
    r"(?:[\x20()./-]{1,3}+[0-9]++(?![\p{L}@_]))*+"
)
RUN_HINT = r"[0-9](?:[\x20()./-]{0,3}[0-9]){6}"
# Shapes a candidate needs to become a span of a kind.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}$|^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9](?:[-./\x20]?[0-9]){11,18}$",
    "phone": r"^[+(]{0,2}[0-9](?:[-./()\x20]*[0-9]){6,14}$",
}
# Characters of context that are searched for a neighbouring word.
REACH = 80
TURNS = 3
DAMPING = 2.0
LEAST_SUPPORT = 3
LEAST_PATTERN = 0.5
LEAST_TEXT = 0.5
SPAN = "array<struct<start:long,end:long,value:string>>"


def _found(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches with their offsets: gaps between matches and match lengths, added up."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(
        matches, F.slice(gaps, 1, F.size(matches)),
        lambda m, g: F.struct(F.length(g).cast("long").alias("gap"),
                              F.length(m).cast("long").alias("len"), m.alias("value")),
    )
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    spans = F.aggregate(
        lengths,
        nothing,
        lambda acc, x: F.struct(
            (acc.at + x.gap + x.len).alias("at"),
            F.concat(
                acc.out,
                F.array(F.struct((acc.at + x.gap).alias("start"),
                                 (acc.at + x.gap + x.len).alias("end"), x.value.alias("value"))),
            ).alias("out"),
        ),
        lambda acc: acc.out,
    )
    return spans if hint is None else F.when(text.rlike(hint), spans).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(
        F.split(digits, ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        byte = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{byte}(?:\.{byte}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _tagged(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        F.filter(spans, lambda s: _valid(kind, s.value)),
        lambda s: F.struct(
            F.lit(rank).alias("rank"), s.start.alias("start"), s.end.alias("end"),
            F.lit(kind).alias("kind"), s.value.alias("value"),
        ),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))),
        ",",
    )


def _word(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shaped(value: Column) -> Column:
    shape = F.lit(False)
    for kind in KINDS:
        shape = shape | value.rlike(SHAPES[kind])
    return shape


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: id, text digest, base spans by kind and start, and candidates with context."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("digest"))
    for rank, kind in enumerate(KINDS):
        found = _found(F.col("text"), PATTERNS[kind], HINTS[kind])
        rows = rows.withColumn(kind, _tagged(found, kind, rank))
    rows = rows.withColumn("base", F.concat(*KINDS))
    # Candidates: tokens outside all base spans, without the punctuation around them.
    lead = lambda v: F.length(F.regexp_extract(v, r"^[^A-Za-z0-9+(]*", 0))
    core = lambda v: F.regexp_extract(v, r"^[^A-Za-z0-9+(]*(.*?)[^A-Za-z0-9]*$", 1)
    outside = lambda s: ~F.exists(
        F.col("base"), lambda b: (b.start < s.end) & (s.start < b.end)
    )
    runs = F.filter(
        F.transform(
            _found(F.col("text"), RUN, RUN_HINT),
            lambda s: F.struct(
                F.lit(len(KINDS)).alias("rank"), s.start.alias("start"), s.end.alias("end"),
                F.lit(None).cast("string").alias("kind"), s.value.alias("value"),
            ),
        ),
        lambda s: s.value.contains(" ") & _shaped(s.value) & outside(s),
    )
    rows = rows.withColumn("runs", runs)
    others = F.filter(
        F.transform(
            _found(F.col("text"), CANDIDATE, "[0-9@]"),
            lambda s: F.struct(
                F.lit(len(KINDS)).alias("rank"),
                (s.start + lead(s.value)).alias("start"),
                (s.start + lead(s.value) + F.length(core(s.value))).alias("end"),
                F.lit(None).cast("string").alias("kind"),
                core(s.value).alias("value"),
            ),
        ),
        # A piece of a run stays only if it could be an identifier by itself.
        lambda s: (s.end > s.start)
        & outside(s)
        & (
            _shaped(s.value)
            | ~F.exists(F.col("runs"), lambda b: (b.start < s.end) & (s.start < b.end))
        ),
    )
    left = lambda s: F.substring(
        F.col("text"), F.greatest(s.start - REACH + 1, F.lit(1)).cast("int"), F.least(s.start, F.lit(REACH)).cast("int")
    )
    right = lambda s: F.substring(F.col("text"), (s.end + 1).cast("int"), F.lit(REACH))
    seen = F.transform(
        F.concat("base", "runs", others),
        lambda s: F.struct(
            s.rank.alias("rank"), s.start.alias("start"), s.end.alias("end"),
            s.kind.alias("kind"), s.value.alias("value"),
            _word(F.regexp_extract(left(s), rf"([^{_S}]+)[{_S}]*$", 1)).alias("before"),
            _word(F.regexp_extract(right(s), rf"^[^{_S}]*[{_S}]+([^{_S}]+)", 1)).alias("after"),
        ),
    )
    return rows.select("doc_id", "digest", "base", seen.alias("seen"))


def _edges(seen: DataFrame) -> DataFrame:
    """(pattern, value, kind, n): texts found in patterns, with the seeds' kinds."""
    pattern = F.array(
        F.when(F.col("before") != "", F.concat(F.lit("l "), "before")),
        F.when(F.col("after") != "", F.concat(F.lit("r "), "after")),
        F.when(
            (F.col("before") != "") & (F.col("after") != ""),
            F.concat(F.lit("b "), "before", F.lit(" "), "after"),
        ),
    )
    return (
        seen.select(F.explode(F.array_compact(pattern)).alias("pattern"), "value", "kind")
        .groupBy("pattern", "value")
        .agg(F.max("kind").alias("kind"))
    )


def _accepted(patterns: DataFrame) -> DataFrame:
    return patterns.where((F.col("score") >= LEAST_PATTERN) & (F.col("support") >= LEAST_SUPPORT))


def scored_patterns(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score, support) and (value, kind, score) after the last turn."""
    edges = stored(_edges(seen), "edges")
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("texts"))
    seeds = (
        edges.where("kind is not null")
        .groupBy("pattern", "kind")
        .agg(F.count(F.lit(1)).alias("support"), F.count(F.lit(1)).cast("double").alias("mass"))
    )
    unknown = edges.where("kind is null").select("pattern", "value")
    mass, texts = seeds, None
    for _ in range(TURNS):
        patterns = stored(
            mass.join(totals, "pattern").select(
                "pattern", "kind", "support", (F.col("mass") / (F.col("texts") + DAMPING)).alias("score")
            ),
            "patterns",
        )
        texts = stored(
            unknown.join(_accepted(patterns), "pattern")
            .groupBy("value", "kind")
            .agg(F.max("score").alias("score")),
            "texts",
        )
        heard = (
            unknown.join(texts, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("heard"))
        )
        mass = seeds.join(heard, ["pattern", "kind"], "left").select(
            "pattern", "kind", "support", (F.col("mass") + F.coalesce("heard", F.lit(0.0))).alias("mass")
        )
    return patterns, texts


def find(docs: DataFrame) -> DataFrame:
    """Base counts, digest of the base spans, and all spans of every row."""
    rows = stored(scanned(docs), "scanned")
    seen = rows.select("doc_id", "digest", F.explode("seen").alias("s")).select("doc_id", "digest", "s.*")
    patterns, texts = scored_patterns(seen)
    good = _accepted(patterns)
    shape = F.lit(False)
    for kind in KINDS:
        shape = shape | ((F.col("kind") == kind) & F.col("value").rlike(SHAPES[kind]))
    names = (
        _edges(seen.where("kind is null"))
        .drop("kind")
        .join(good.select("pattern", "kind"), "pattern")
        .join(texts.where(F.col("score") >= LEAST_TEXT), ["value", "kind"])
        .where(shape)
        .groupBy("value")
        .agg(F.max_by("kind", "score").alias("new_kind"))
    )
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("new_kind")).cast("int") - 1
    added = (
        seen.where("kind is null")
        .join(names, "value")
        .groupBy(F.col("doc_id").alias("a_id"), F.col("digest").alias("a_digest"))
        .agg(
            F.collect_set(
                F.struct(
                    rank.alias("rank"), "start", "end", F.col("new_kind").alias("kind"), "value"
                )
            ).alias("added")
        )
    )
    # A new span inside a longer new one is a piece of it.
    longest = F.filter(
        "added",
        lambda s: ~F.exists(
            F.col("added"),
            lambda b: (b.start <= s.start) & (s.end <= b.end) & (b.end - b.start > s.end - s.start),
        ),
    )
    spans = F.array_sort(F.concat("base", F.coalesce(longest, F.array().cast(rows.schema["base"].dataType))))
    return rows.join(
        added,
        F.col("doc_id").eqNullSafe(F.col("a_id")) & F.col("digest").eqNullSafe(F.col("a_digest")),
        "left",
    ).select(
        "doc_id",
        *map(_count, KINDS),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )

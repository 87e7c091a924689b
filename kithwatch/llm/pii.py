"""Personal data: high-recall generators, boosted trees over candidates, calibrated selection.

1. *Generators* propose overlapping spans: four base patterns (e-mail addresses, IP addresses,
   card and phone numbers) and wider forms (spelled-out addresses, IPv6, numbers without a
   country code, cards in other groupings).
2. *Features* of a candidate: what it is made of, whether check digits and ranges hold, what
   stands before and after, and which words lead up to it.
3. *Trees* learn from the candidates of the base patterns, which their validity rule labels:
   at most about ``sample`` of them, chosen by a hash of candidate and context. They hold back
   a fourth to calibrate the threshold above which a wider candidate is taken.
4. Base spans that are valid always stay. A wider one is taken above the threshold where it
   overlaps no base span and no better candidate.

Only DataFrame functions run over the texts: a pattern splits a text into what is between its
matches, running sums of lengths give the places, and the trees are CASE expressions. Every
pattern is written so that no text makes it go back and forth: runs are entered at their first
character only and never given back.

Offsets count code points, the end is exclusive.

Defined results: null and empty texts have no spans; rows with equal ``doc_id`` are searched
by their own text; a table without any candidate of one label accepts no wider span. Extra
columns are kept by :func:`redact` and ignored by :func:`find_personal_data`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithwatch.llm.boosting import Boosted, fit
from kithwatch.operators.scratch import Scratch

KINDS = ["email", "ip", "card", "phone"]
# The base patterns, in the forms that never backtrack far.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./\x20-]?[0-9]{4}){2,3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
#: What a text must contain for a pattern to be tried.
_HINT = {"email": "@", "phone": "+"}
_CONTEXT = 24
# Words that lead up to personal data.
_LEADS = {
    "lead_email": "mail|contact|write|address",
    "lead_ip": "ip|host|server|address",
    "lead_card": "card|visa|pay|credit|account",
    "lead_phone": "phone|tel|call|fax|mobile",
}
FEATURES = [
    "kind",
    "length",
    "digits",
    "letters",
    "dots",
    "dashes",
    "blanks",
    "brackets",
    "plus",
    "groups",
    "check_digit",
    "in_range",
    "enough_digits",
    "after_letter",
    "before_letter",
    "before_dot",
    *_LEADS,
]
SAMPLE = 20_000
_RANGE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"


def _proposals(text: Column, kind: str, pattern: str, wider: bool) -> Column:
    """Array of matches, each with the length of the text since the match before and its context."""
    # All arrays are arguments, not parts of a lambda, which would split the text again for each match.
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, found, lambda before, match: F.struct(before.alias("before"), match.alias("match")))
    triples = F.zip_with(pairs, F.slice(between, 2, 1 << 30), lambda pair, after: F.struct(pair.alias("pair"), after.alias("after")))

    def with_context(triple: Column, k: Column) -> Column:
        before = triple["pair"]["before"]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(wider).alias("wider"),
            k.alias("k"),
            triple["pair"]["match"].alias("match"),
            F.length(before).alias("gap"),
            F.right(before, F.lit(_CONTEXT)).alias("before"),
            F.left(triple["after"], F.lit(2)).alias("after"),
        )

    # There is one piece of text more than there are matches.
    made = F.transform(F.filter(triples, lambda triple: triple["pair"]["match"].isNotNull()), with_context)
    none = F.expr(
        "cast(array() as array<struct<kind:string,wider:boolean,k:int,match:string,gap:int,before:string,after:string>>)"
    )
    hint = text.contains(_HINT[kind]) if not wider and kind in _HINT else text.rlike("[0-9]")
    if wider:
        hint = text.rlike(pattern)
    return F.when(hint, made).otherwise(none)


def _luhn(digits: Column) -> Column:
    """Check digit of a string of at most 19 digits."""
    turned = F.reverse(digits)

    def step(total: Column, place: Column) -> Column:
        value = F.substr(turned, place, F.lit(1)).cast("int")
        doubled = F.when(place % 2 == 0, value * 2 - F.when(value > 4, 9).otherwise(0)).otherwise(value)
        return total + doubled

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)
    return F.when(F.length(digits).between(1, 19), total % 10 == 0).otherwise(F.lit(False))


def candidates(documents: DataFrame) -> DataFrame:
    """``(_id, _text, kind, wider, start, end, match, valid, *features)`` of all proposals.

    One row for each place: rows of ``documents`` that are equal share their candidates.
    """
    text = F.coalesce("text", F.lit(""))
    forms = [(kind, pattern, wider) for wider, given in ((False, BASE), (True, WIDER)) for kind, pattern in given.items()]
    proposed = F.concat(*(_proposals(text, kind, pattern, wider) for kind, pattern, wider in forms))
    rows = documents.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), proposed.alias("found"))
    each = rows.select("_id", "_text", F.explode_outer("found").alias("one")).where("one is not null").select("_id", "_text", "one.*").distinct()
    so_far = Window.partitionBy("_id", "_text", "kind", "wider").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    count = lambda pattern: F.regexp_count("match", F.lit(pattern))
    digits = F.regexp_replace("match", "[^0-9]", "")
    octets = F.forall(F.split("match", r"\."), lambda part: part.rlike(_RANGE))
    few = F.length(digits)
    flags = {
        "kind_number": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")),
        "length": F.length("match"),
        "digits": few,
        "letters": count("[A-Za-z]"),
        "dots": count("[.]"),
        "dashes": count("-"),
        "blanks": count(" "),
        "brackets": count("[()]"),
        "plus": count("[+]"),
        "groups": count("[0-9]+"),
        "check_digit": _luhn(digits),
        "in_range": octets,
        "enough_digits": F.when(F.col("kind") == "card", few.between(14, 19)).otherwise(few.between(10, 15)),
        "after_letter": F.right("before", F.lit(1)).rlike("[A-Za-z]"),
        "before_letter": F.left("after", F.lit(1)).rlike("[A-Za-z0-9]"),
        "before_dot": F.left("after", F.lit(1)).isin(".", ",") & F.substring("after", 2, 1).rlike("[0-9]"),
        **{name: F.lower("before").rlike(words) for name, words in _LEADS.items()},
    }
    valid = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.col("in_range") == 1)
        .when(F.col("kind") == "card", (F.col("enough_digits") == 1) & (F.col("check_digit") == 1))
        .otherwise(F.col("enough_digits") == 1)
    )
    described = placed.withColumns({name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in flags.items()})
    return described.withColumn("valid", ~F.col("wider") & valid).drop("gap", "k")


def _features() -> list[str]:
    return ["kind_number", *FEATURES[1:]]


def train_trees(found: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Trees for the candidates of the base patterns, labelled by their validity."""
    base = found.where("not wider")
    number = base.count()
    drawn = F.pmod(F.xxhash64(F.lit(3), "match", "before", "after"), F.lit(1 << 30)) / float(1 << 30)
    order = F.xxhash64("match", "before", "after").alias("at")
    # About ``sample`` rows, whatever the size of the table.
    rows = base.where(drawn < min(1.0, sample / max(number, 1))).select(order, F.col("valid").cast("int").alias("label"), *_features()).collect()
    rows.sort(key=lambda row: (row["at"], row["label"]))
    matrix = np.array([[row[name] for name in _features()] for row in rows], float).reshape(len(rows), len(_features()))
    labels = np.array([row["label"] for row in rows])
    if not len(rows) or labels.min() == labels.max():
        return Boosted(_features(), start=-10.0)
    return fit(_features(), matrix, labels)


def personal_spans(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(_id, _text, base, spans)`` of rows with any: arrays of ``(start, nth kind, end, reach)`` in order.

    ``reach`` is the largest end of base spans before, or less where a span before ends later.
    """
    scratch = Scratch(documents.sparkSession, "pii")
    found = scratch.save(candidates(documents), "candidates")
    model = train_trees(found, sample)
    rated = found.withColumn("chance", model.probability())
    # How far base spans before this one reach, as those of different kinds may overlap.
    earlier = Window.partitionBy("_id", "_text").orderBy("start", "kind_number", "end").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("reach", F.coalesce(F.max(F.when(F.col("valid"), F.col("end"))).over(earlier), F.lit(0).cast("long")))
    span = F.struct("start", F.col("kind_number").cast("int").alias("nth"), "end", "reach")
    chosen = F.col("wider") & (F.col("chance") > model.threshold)
    rows = (
        rated.where(F.col("valid") | chosen)
        .groupBy("_id", "_text")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("valid"), span))).alias("base"),
            F.collect_set(F.when(chosen, F.struct("start", "end", "chance", F.col("kind_number").cast("int").alias("nth")))).alias("more"),
        )
    )
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda a, b: (b["chance"] > a["chance"]) | ((b["chance"] == a["chance"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["nth"] < a["nth"]))))
    free = F.filter("more", lambda a: ~F.exists("base", lambda b: overlaps(a, b)))
    rows = rows.withColumn("free", free)
    best = F.filter("free", lambda a: ~F.exists("free", lambda b: overlaps(a, b) & better(a, b)))
    added = F.transform(best, lambda a: F.struct(a["start"].alias("start"), a["nth"].alias("nth"), a["end"].alias("end"), F.lit(0).cast("long").alias("reach")))
    return rows.select("_id", "_text", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _said(spans: str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["nth"]), s["start"], s["end"]))
    return F.coalesce(F.array_join(parts, ","), F.lit(""))


def _with_spans(documents: DataFrame, sample: int) -> DataFrame:
    """``(row, base, spans)`` for all rows; ``row`` holds all their columns, so that no name can clash."""
    found = personal_spans(documents, sample)
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("key_text"))
    match = F.col("key").eqNullSafe(F.col("_id")) & (F.col("key_text") == F.col("_text"))
    return rows.join(found, match, "left").select("row", "base", "spans")


def find_personal_data(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row."""
    rows = _with_spans(documents.select("doc_id", "text"), sample)

    def number_of(nth: int) -> Column:
        return F.coalesce(F.size(F.filter("base", lambda s: s["nth"] == nth)), F.lit(0)).cast("long")

    counts = [number_of(nth).alias(f"n_{kind}") for nth, kind in enumerate(KINDS, 1)]
    return rows.select("row.doc_id", *counts, F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"))


def redact(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The same rows with every span replaced by its kind in angle brackets.

    Overlapping spans are replaced as one, named after the first. A null text stays null.
    """
    text = F.col("row.text")
    kind = F.array(*(F.lit(f"<{name.upper()}>") for name in KINDS))

    def end_before(k: Column) -> Column:
        """Where the text goes on after the first k spans."""
        last = F.element_at("spans", F.greatest(k, F.lit(1)))
        return F.when(k > 0, F.greatest(last["end"], last["reach"])).otherwise(F.lit(0).cast("long"))

    def replaced(span: Column, k: Column) -> Column:
        at = end_before(k)
        kept = F.substr(text, (at + 1).cast("int"), (span["start"] - at).cast("int"))
        return F.when(span["start"] < at, F.lit("")).otherwise(F.concat(kept, F.element_at(kind, span["nth"])))

    rows = _with_spans(documents, sample)
    tail = F.substr(text, (end_before(F.size("spans")) + 1).cast("int"), F.length(text))
    cleaned = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", replaced), ""), tail)).otherwise(text)
    return rows.select(*(cleaned.alias("text") if name == "text" else F.col(f"row.`{name}`") for name in documents.columns))

"""Personal data by candidates and gradient boosting, in DataFrame functions and Spark ML only.

Generators with high recall propose spans, which may overlap: the strict formats, and looser spellings of them. Each
candidate has features of its format and of its surroundings. Boosted trees learn from candidates whose standing the
checks decide (a strict format that passes its check, and what overlaps it, against one that fails), in one half of
all documents; a threshold for each kind is set on the other half, which the trees did not see, and decides on the
candidates that the checks leave open. Candidates with equal features are one weighted row to the trees, so that what
they go over grows with the variety of the candidates. Spans that pass the checks are kept whatever the trees say.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.llm.common import cut, let

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]++"
#: The strict formats, written so that no quantifier is retried from inside its own run: a match begins where a run
#: does or where the match before it ended, and repeated groups are possessive, which takes no stack.
STRICT = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser spellings, by kind.
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?{_LABEL}"
    rf"(?:\x20?(?:\.|[\[(]\x20?(?i:dot)\x20?[\])])\x20?{_LABEL})++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:(?:[./_]|[\x20-]{2})[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: What a text must contain for a search to be worth it.
NEEDS = {"email": "@", "phone": "+"}
#: Words before a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|master|credit|account|pay",
    "phone": r"phone|call|tel\b|tel:|mobile|fax|contact",
}
#: Code points looked at before a span.
AROUND = 24
#: Code points that a match of any pattern has at least.
SHORTEST = 5
#: Matches whose places are added up together.
RUN = 256
#: Precision that a threshold must have on the held-out part.
PRECISION = 0.99
#: Least bins of a feature; Spark ML samples rows for them beyond their square, or 10,000.
BINS = 32
FEATURES = [
    "is_email", "is_ip", "is_card", "is_phone", "loose", "length", "digits", "letters", "separators", "luhn", "octets",
    "context", "glued_before", "glued_after", "digit_before", "groups",
]


def found(text: Column, pattern: str) -> Column:
    """array<struct(start, end, value, before, after)>: leftmost non-overlapping matches, in code points, the end exclusive.

    ``before`` has the last ``AROUND`` code points ahead of the match, ``after`` the one that follows. They are taken
    from the matches and gaps next to it, not from the text, which would be walked from its start for every match.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(v: Column) -> Column:
        pieces = F.arrays_zip(v["gap"].alias("gap"), v["value"].alias("value"))
        starts_of_runs = F.sequence(F.lit(0), F.size(v["gap"]), F.lit(RUN))
        runs = let(pieces, lambda z: F.transform(starts_of_runs, lambda i: F.slice(z, i + 1, F.lit(RUN))))

        # Starts are collected run by run: an array that grows by one match is copied whole every time.
        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["gap"])
            return F.struct(
                (start + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"), F.concat(s["starts"], F.array(start)).alias("starts")
            )

        def walk(s: Column, run: Column) -> Column:
            state = F.struct(s["at"].alias("at"), F.array().cast("array<int>").alias("starts"))
            return let(
                F.aggregate(run, state, step),
                lambda r: F.struct(r["at"].alias("at"), F.concat(s["runs"], F.array(r["starts"])).alias("runs")),
            )

        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("runs"))
        walked = F.aggregate(runs, begin, walk, lambda s: F.flatten(s["runs"]))

        def near(i: Column) -> Column:
            # From the gap before the match back over as many matches as can lie within AROUND.
            back = [F.get(v["gap"], i)]
            for k in range(1, AROUND // SHORTEST + 2):
                back += [F.coalesce(F.get(v[part], i - k), F.lit("")) for part in ("value", "gap")]
            return F.substring(F.concat(*[F.substring(p, -AROUND, AROUND) for p in reversed(back)]), -AROUND, AROUND)

        follows = lambda i: F.concat(
            F.substring(F.get(v["gap"], i + 1), 1, 1), F.coalesce(F.substring(F.get(v["value"], i + 1), 1, 1), F.lit(""))
        )
        return let(
            walked,
            lambda starts: F.transform(
                v["value"],
                lambda x, i: F.struct(
                    F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(x)).alias("end"), x.alias("value"),
                    near(i).alias("before"), F.substring(follows(i), 1, 1).alias("after"),
                ),
            ),
        )

    return let(F.struct(gaps.alias("gap"), values.alias("value")), place)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + let(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, value: Column) -> Column:
    """The check of a strict format."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.regexp_like(value, F.lit(rf"^{octet}(?:\.{octet}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (row, doc_id, spans): ``spans`` has all candidates with their surroundings. Stored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts: list[Column] = []
    empty = "array<struct<kind:string,loose:boolean,passed:boolean,start:int,end:int,value:string,before:string,after:string>>"

    def span(kind: str, loose: bool) -> Callable[[Column], Column]:
        return lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(loose).alias("loose"),
            (F.lit(False) if loose else passes(kind, x["value"])).alias("passed"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["value"].alias("value"),
            x["before"].alias("before"),
            x["after"].alias("after"),
        )

    for loose, patterns in ((False, STRICT), (True, LOOSE)):
        for kind, pattern in patterns.items():
            if loose:
                asked = F.regexp_like(text, F.lit(pattern))
            else:
                asked = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.regexp_like(text, F.lit("[0-9]"))
            spans = F.transform(found(text, pattern), span(kind, loose))
            parts.append(F.when(asked, spans).otherwise(F.array().cast(empty)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.concat(*parts).alias("spans"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def described(spans: DataFrame) -> DataFrame:
    """Candidates, one a row, with FEATURES."""
    value, digits = F.col("value"), F.regexp_replace("value", "[^0-9]", "")
    context = F.lit(False)
    for kind, words in CONTEXT.items():
        context = F.when(F.col("kind") == kind, F.regexp_like(F.lower("before"), F.lit(words))).otherwise(context)
    last = F.substring("before", -1, 1)
    features = {f"is_{k}": F.col("kind") == k for k in KINDS} | {
        "length": F.length(value), "digits": F.length(digits),
        "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "separators": F.length(F.regexp_replace(value, r"[^\x20().-]", "")),
        "luhn": F.when(F.length(digits) <= 24, luhn(digits)).otherwise(F.lit(False)),
        "octets": passes("ip", value),
        "context": context,
        "glued_before": F.regexp_like(last, F.lit(r"[\p{L}\p{N}_=/\"]")),
        "glued_after": F.regexp_like("after", F.lit(r"[\p{L}\p{N}_=/\"]")),
        "digit_before": F.regexp_like(last, F.lit("[0-9.+-]")),
        "groups": F.size(F.split(value, r"[^0-9A-Za-z]+")),
    }
    return spans.withColumns(features).withColumns({c: F.col(c).cast("double") for c in FEATURES if c != "loose"}).withColumn(
        "loose_", F.col("loose").cast("double")
    )


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def lessons(spans: DataFrame) -> DataFrame:
    """(kind, label, seen, features, n): all candidates that teach, those with equal features counted in one row. Stored.

    Candidates teach where the checks decide: strict ones by their check, loose ones that overlap a strict one of
    their kind by that one's. ``seen`` is the half that the trees learn from.
    """

    def meets(x: Column, of: Callable[[Column], Column]) -> Column:
        return F.exists("spans", lambda s: of(s) & (s["kind"] == x["kind"]) & _overlap(s, x))

    def good(x: Column) -> Column:
        return meets(x, lambda s: s["passed"])

    # Chosen inside the array, so that no candidate's row carries the others of its document.
    strict = F.filter("spans", lambda x: ~x["loose"])
    right = F.filter("spans", lambda x: x["loose"] & good(x))
    wrong = F.filter("spans", lambda x: x["loose"] & ~good(x) & meets(x, lambda s: ~s["loose"]))
    taught = (
        spans.select("row", F.inline(strict)).withColumn("label", F.col("passed").cast("double"))
        .unionByName(spans.select("row", F.inline(right)).withColumn("label", F.lit(1.0)))
        .unionByName(spans.select("row", F.inline(wrong)).withColumn("label", F.lit(0.0)))
    )
    seen = F.pmod(F.xxhash64("row"), F.lit(2)) == 0
    counted = (
        described(taught).withColumn("seen", seen).groupBy("kind", "label", "seen", *_COLUMNS).agg(F.count("*").alias("n"))
    )
    return cut(_vectors(counted).select("kind", "label", "seen", "features", F.col("n").cast("double").alias("n")))


def teach(spans: DataFrame) -> tuple[GBTClassificationModel | None, dict[str, float]]:
    """Trees and a threshold for each kind, from all candidates that the checks decide (``lessons``).

    Without both outcomes there are no trees, and no span is added.
    """
    rows = lessons(spans)
    counts = {(r.seen, r.label): r["count"] for r in rows.groupBy("seen", "label").count().collect()}
    if len([k for k in counts if k[0]]) < 2:
        return None, {}
    # As many bins as keep Spark ML from sampling rows for them: all that the trees see counts.
    distinct = sum(n for k, n in counts.items() if k[0])
    bins = BINS if distinct <= 10_000 else max(BINS, math.isqrt(distinct) + 1)
    learner = GBTClassifier(labelCol="label", weightCol="n", maxIter=10, maxDepth=3, seed=7, cacheNodeIds=False, maxBins=bins)
    trees = learner.fit(rows.filter("seen"))
    # Calibration: for each kind the least score at and above which the held-out candidates are as precise as asked.
    held = trees.transform(rows.filter("NOT seen")).select(
        "kind", "label", "n", F.round(vector_to_array("probability")[1], 3).alias("p")
    )
    scores = held.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits")).collect()  # 1,001 a kind
    thresholds = {}
    for kind in KINDS:
        n = hits = 0
        for p, m, h in sorted(((r.p, r.n, r.hits) for r in scores if r.kind == kind), reverse=True):
            n, hits = n + m, hits + h
            if hits >= PRECISION * n:
                thresholds[kind] = max(p, 0.5)
    return trees, thresholds


_COLUMNS = ["loose_" if c == "loose" else c for c in FEATURES]


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=_COLUMNS, outputCol="features").transform(rows)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, added) for every row: arrays of struct(start, end, kind, value), in order.

    ``base`` has what passes its check, ``added`` what the trees add, without spans that overlap a base one. A null
    text counts as empty and has none. Whole texts are searched; other columns are not read.
    """
    spans = candidates(docs, id_col, text_col)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    trees, thresholds = teach(spans)
    order = lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).cast("int").alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"),
    )
    base = F.sort_array(F.transform(F.filter("spans", lambda s: s["passed"]), order))
    rows = spans.select("row", "doc_id", base.alias("base"))
    kind_of = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
    if trees is None or not thresholds:
        return rows.withColumn("added", F.array().cast(kind_of))
    # What fails its own check stays out: the trees decide on looser spellings only.
    open_ones = F.filter("spans", lambda x: x["loose"] & ~F.exists("spans", lambda s: s["passed"] & _overlap(s, x)))
    limit = F.lit(2.0)
    for kind, p in thresholds.items():
        limit = F.when(F.col("kind") == kind, p).otherwise(limit)
    scored = trees.transform(_vectors(described(spans.select("row", F.inline(open_ones)))))
    added = (
        scored.filter(vector_to_array("probability")[1] >= limit).groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind", "value"))).alias("added"))
    )
    return rows.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(kind_of)))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each of the ordered spans replaced by its kind in brackets; overlapping ones count once."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(
                    s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]")
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
    )
    return let(done, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def op10_boosted_personal_data(docs: DataFrame) -> DataFrame:
    """The digest of the contract; ``n_*`` count base spans."""
    joined = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return personal_spans(docs).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )

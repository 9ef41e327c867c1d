"""Personal data: rule spans, and candidates chosen by calibrated gradient-boosted trees.

Generators of high recall propose spans that may overlap. Candidates that a rule can
judge are the labels: trees are boosted on their format and context, a threshold is
calibrated on held-out ones, and proposals that no rule covers are chosen by it.
DataFrame functions and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseries.operators.materialize import materialize

KINDS = ("email", "ip", "card", "phone")
#: What the rules match, leftmost and without overlaps. Possessive and guarded forms of
#: the plain patterns: a run is tried once, from its start or from where the last match ended.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms: spelled-out addresses, numbers without a plus sign, addresses of eight groups.
PROPOSALS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+.(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
#: A text without this cannot match.
NEEDS = {"email": r"@|[\[(]\x20?(?:at|AT)", "ip": r"[0-9A-Fa-f][.:][0-9A-Fa-f]", "card": r"[0-9]", "phone": r"[0-9]"}
WORDS = r"(?i)(mail|e-mail|contact|tel|phone|call|fon|mobile|fax|card|visa|credit|iban|account|host|server|addr|ip)"
FEATURES = ["kind_index", "size", "digits", "letters", "groups", "longest", "marks", "distinct", "luhn", "keyword", "glued_before", "glued_after", "line_start"]
#: Training rows in one task.
ROWS_PER_TASK = 50_000
_SPANS = "array<struct<s:int,e:int,m:string>>"


def located(text: Column, pattern: str) -> Column:
    """All matches as ``s``, ``e`` (code points, end exclusive) and ``m``: what lies between them gives the places."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["0"])
        e = s + F.length(x["1"])
        grown = F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["1"].alias("m"))).alias("out"))
        return F.when(x["1"].isNull(), acc).otherwise(grown)

    return F.aggregate(F.arrays_zip(between, matches), start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a rule is kept."""
    count = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return count.between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return count.between(8, 15)
    return F.lit(True)


def propose(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``row`` (hash of the text) and ``found``: matches of rules and proposals with their contexts, in one pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("row"))

    def spans(kind: str, pattern: str, rule: bool) -> Column:
        def described(x: Column) -> Column:
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                x["s"].alias("s"),
                x["e"].alias("e"),
                x["m"].alias("m"),
                F.substring(F.col("text"), F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))).alias("before"),
                F.substring(F.col("text"), x["e"] + 1, F.lit(8)).alias("after"),
                (valid(kind, x["m"]) if rule else F.lit(None).cast("boolean")).alias("valid"),
            )

        return F.when(F.col("text").rlike(NEEDS[kind]), F.transform(located(F.col("text"), pattern), described))

    lists = [spans(k, p, True) for k, p in RULES.items()] + [spans(k, p, False) for k, p in PROPOSALS.items()]
    kind = "array<struct<kind:int,s:int,e:int,m:string,before:string,after:string,valid:boolean>>"
    return rows.select("id", "row", F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in lists]).alias("found"))


def described(spans: DataFrame) -> DataFrame:
    """Format and context features of exploded candidates."""
    m = F.col("m")
    parts = F.filter(F.split(m, "[^0-9A-Za-z]+"), lambda p: p != "")
    number = _digits(m)
    features = {
        "kind_index": F.col("kind"),
        "size": F.length(m),
        "digits": F.length(number),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "groups": F.size(parts),
        "longest": F.array_max(F.transform(parts, F.length)),
        "marks": F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")),
        "distinct": F.size(F.array_distinct(F.split(number, ""))),
        "luhn": F.when(F.length(number) > 0, F.call_function("luhn_check", number)).otherwise(False).cast("int"),
        "keyword": F.col("before").rlike(WORDS).cast("int"),
        "glued_before": F.col("before").rlike(r"[0-9A-Za-z]$").cast("int"),
        "glued_after": F.col("after").rlike(r"^[0-9A-Za-z]").cast("int"),
        "line_start": F.col("before").rlike(r"(^|\n)$").cast("int"),
    }
    return spans.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in features.items()})


def decoys(spans: DataFrame) -> DataFrame:
    """Near misses, made from valid rule spans: a wrong check digit, a part over 255, a number cut short, no dot in the domain.

    Texts hold few strings that fail a rule narrowly; these teach the trees where the border is.
    """
    m, n = F.col("m"), F.length("m")
    last = F.right(m, F.lit(1))
    broken = (
        F.when(F.col("kind") == 0, F.regexp_replace(m, r"\.[A-Za-z0-9-]+", ""))
        .when(F.col("kind") == 1, F.concat(F.lit("9"), F.regexp_replace(m, r"^[0-9]+", "99")))
        .when(F.col("kind") == 2, F.concat(F.substring(m, F.lit(1), n - 1), ((last.cast("int") + 1) % 10).cast("string")))
        .otherwise(F.substring(m, F.lit(1), (n / 2).cast("int")))
    )
    return spans.where("valid").withColumn("m", broken).withColumn("valid", F.lit(False)).withColumn("e", F.col("s") + F.length("m"))


def fit(labelled: DataFrame, precision: float = 0.95, rounds: int = 20, depth: int = 4):
    """Boosted trees and the least score whose held-out precision reaches ``precision``; None where labels can't give one.

    ``labelled`` has the features and ``label``. All of it is used: rows of equal features
    and label are one row with their number as weight. A fifth, by hash, is held out for
    the threshold.
    """
    held = F.pmod(F.xxhash64("id", "s", "kind"), F.lit(5)) == 0
    rows = materialize(labelled.groupBy(*FEATURES, "label", held.alias("held")).agg(F.count("*").cast("double").alias("n")))
    parts = {(r["held"], r["label"]): r for r in rows.groupBy("held", "label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    if any((held, y) not in parts or parts[held, y]["n"] < 5 for held in (True, False) for y in (0.0, 1.0)):
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # rounds cost a job each: as few tasks as the rows need
    tasks = max(2, sum(parts[False, y]["rows"] for y in (0.0, 1.0)) // ROWS_PER_TASK)
    train = assembler.transform(rows.where("not held").coalesce(tasks))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, weightCol="n", seed=11).fit(train)
    scored = model.transform(assembler.transform(rows.where("held"))).select("label", "n", F.round(vector_to_array("probability")[1], 3).alias("p"))
    found = scored.groupBy("p").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).orderBy(F.desc("p")).collect()
    good = n = 0
    threshold = None
    for r in found:
        good, n = good + r["good"], n + r["n"]
        if good >= precision * n and r["p"] >= 0.5:
            threshold = float(r["p"])
    return None if threshold is None else (assembler, model, threshold)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col``, ``base`` and ``extra`` of each row: spans of the rules, and chosen spans that no rule covers.

    A span has ``kind`` (0 to 3: email, ip, card, phone), ``s`` and ``e`` in code points.
    Rule spans are leftmost and do not overlap within a kind; those that fail their check
    are dropped. Chosen spans overlap no rule span and no better chosen one. A null or
    empty text has no spans; rows that repeat an id keep their own; an empty table gives
    an empty table. Other columns are not read.
    """
    found = materialize(propose(docs, id_col, text_col))
    base = F.transform(F.filter("found", lambda x: x["valid"]), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    exploded = found.select("id", "row", F.explode("found").alias("x")).select("id", "row", "x.*")
    judged = exploded.where("valid is not null")
    learned = fit(described(judged.union(decoys(judged))).withColumn("label", F.col("valid").cast("double")), **options)
    spans = "array<struct<kind:int,s:int,e:int>>"
    rows = found.select("id", "row", F.array_sort(base.cast(spans)).alias("base"))
    if learned is None:
        return rows.select(F.col("id").alias(id_col), "base", F.array().cast(spans).alias("extra"))
    assembler, model, threshold = learned
    scored = model.transform(assembler.transform(described(exploded.where("valid is null")))).withColumn("p", F.round(vector_to_array("probability")[1], 3))
    chosen = scored.where(F.col("p") >= threshold).groupBy("id", "row").agg(F.sort_array(F.collect_set(F.struct((-F.col("p")).alias("p"), "s", "e", "kind"))).alias("chosen"))
    joined = rows.join(chosen, rows["id"].eqNullSafe(chosen["id"]) & (rows["row"] == chosen["row"]), "left").select(rows["id"], "base", "chosen")

    def apart(x: Column, others: Column) -> Column:
        return F.forall(others, lambda o: (x["e"] <= o["s"]) | (x["s"] >= o["e"]))

    def take(acc: Column, x: Column) -> Column:
        span = F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
        return F.when(apart(x, acc) & apart(x, F.col("base")), F.array_append(acc, span)).otherwise(acc)

    extra = F.aggregate("chosen", F.array().cast(spans), take)
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce(F.array_sort(extra), F.array().cast(spans)).alias("extra"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span of a sorted array without overlaps replaced by its kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        name = F.element_at(F.array(*[F.lit(f"[{k}]") for k in KINDS]), x["kind"] + 1)
        between = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), F.concat(acc["out"], between, name).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

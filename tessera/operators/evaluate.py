"""Scoring predicted spans against expected ones.

Both sides are rows ``document_id, pii_type, start, end, ordinal``; ``ordinal`` is the order in which
predictions claim and expected spans are looked through. Everything is grouped by document first. Rows of
the same ordinal go by their place; repeated rows are spans of their own; a null id or type matches
nothing and its span stays unmatched; spans with a null end overlap nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.spans import overlaps

NONE = "__none__"
SPAN = "struct<ordinal:int,start:int,end:int,pii_type:string>"


def _lists(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end", "pii_type"))).cast(f"array<{SPAN}>").alias(name))


def _sides(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    none = F.array().cast(f"array<{SPAN}>")
    both = _lists(expected, keys, "e").join(_lists(predicted, keys, "p"), keys, "full")
    return both.select(*keys, F.coalesce("e", none).alias("e"), F.coalesce("p", none).alias("p"))


def _claimed(e: Column, p: Column, best: bool) -> Column:
    """For each prediction in order the index of the expected span it claims, or null.

    What is claimed leaves the list that later predictions look through.
    """
    start = F.struct(F.transform(e, lambda y, i: F.struct(i.alias("i"), y["start"].alias("start"), y["end"].alias("end"))).alias("free"), F.array().cast("array<int>").alias("out"))

    def claim(acc: Column, x: Column) -> Column:
        hits = F.filter(acc["free"], lambda y: overlaps(x, y))
        shared = lambda y: F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])
        taken = F.array_min(F.transform(hits, lambda y: F.struct((-shared(y) if best else F.lit(0)).alias("o"), y["i"].alias("i"))))["i"]
        left = F.when(F.size(hits) == 0, acc["free"]).otherwise(F.filter(acc["free"], lambda y: y["i"] != taken))
        return F.struct(left.alias("free"), F.concat(acc["out"], F.array(taken)).alias("out"))

    return F.aggregate(p, start, claim, lambda acc: acc["out"])


def match_first_fit(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Within document and type each prediction claims the first free expected span that it overlaps.

    ``document_id, pii_type, tp, fp, fn``.
    """
    sides = _sides(expected, predicted, ["document_id", "pii_type"])
    hits = F.size(F.filter(_claimed(F.col("e"), F.col("p"), False), lambda i: i.isNotNull())).cast("long")
    return sides.withColumn("tp", hits).select("document_id", "pii_type", "tp", (F.size("p") - F.col("tp")).cast("long").alias("fp"), (F.size("e") - F.col("tp")).cast("long").alias("fn"))


def match_best_overlap(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Within a document each prediction claims the free expected span, of any type, that it overlaps most
    (of equals the earlier).

    One row for each pair and for each span left over: ``document_id, outcome, expected_type,
    predicted_type`` and both spans; the outcome is ``true_positive``, ``type_mismatch``,
    ``false_positive`` or ``false_negative``.
    """
    sides = _sides(expected, predicted, ["document_id"]).withColumn("c", _claimed(F.col("e"), F.col("p"), True))
    row = lambda outcome, x, y: F.struct(outcome.alias("outcome"), x["pii_type"].alias("expected_type"), x["start"].alias("expected_start"), x["end"].alias("expected_end"), y["pii_type"].alias("predicted_type"), y["start"].alias("predicted_start"), y["end"].alias("predicted_end"))
    nothing = F.lit(None).cast(SPAN)
    pairs = F.transform(
        F.arrays_zip("p", "c"),
        lambda z: F.when(z["c"].isNull(), row(F.lit("false_positive"), nothing, z["p"])).otherwise(
            row(F.when(F.get("e", z["c"])["pii_type"] == z["p"]["pii_type"], "true_positive").otherwise("type_mismatch"), F.get("e", z["c"]), z["p"])
        ),
    )
    missed = F.transform(F.filter(F.transform("e", lambda y, i: F.struct(y.alias("y"), i.alias("i"))), lambda z: ~F.exists("c", lambda a: a.eqNullSafe(z["i"]))), lambda z: row(F.lit("false_negative"), z["y"], nothing))
    return sides.select("document_id", F.inline(F.concat(pairs, missed)))


def per_type_counts(matches: DataFrame) -> DataFrame:
    """``pii_type, tp, fp, fn``: a mismatch is a miss of the expected type and a false find of the other."""
    sides = F.when(F.col("outcome") == "true_positive", F.array(F.struct(F.col("expected_type").alias("pii_type"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))).otherwise(
        F.filter(
            F.array(
                F.struct(F.col("expected_type").alias("pii_type"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")),
                F.struct(F.col("predicted_type").alias("pii_type"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
            ),
            lambda s: s["pii_type"].isNotNull(),
        )
    )
    return matches.select(F.inline(sides)).groupBy("pii_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def metrics(counts: DataFrame) -> DataFrame:
    """Counts with precision, recall, f1, entity_accuracy and support; what can't be divided is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "entity_accuracy": ratio(tp, tp + fp + fn), "support": tp + fn})
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(matches: DataFrame) -> DataFrame:
    """Metrics of each type and, as ``overall``, of the sums of all counts, by grouping sets."""
    both = per_type_counts(matches).rollup("pii_type").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.grouping("pii_type").alias("g"))
    named = both.select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("pii_type")).alias("label"), "tp", "fp", "fn")
    return metrics(named)


def confusion(matches: DataFrame) -> DataFrame:
    """``actual, predicted, n`` for every pair of the labels that occur and of none, zeros included.

    There are at most nine types, so the grid is small whatever the data.
    """
    cells = matches.select(F.coalesce("expected_type", F.lit(NONE)).alias("actual"), F.coalesce("predicted_type", F.lit(NONE)).alias("predicted"))
    counted = cells.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    labels = counted.select(F.explode(F.array("actual", "predicted", F.lit(NONE))).alias("l")).distinct()
    every = labels.agg(F.collect_set("l").alias("ls")).select(F.explode("ls").alias("actual"), "ls").select("actual", F.explode("ls").alias("predicted"))
    return every.join(counted, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(matches: DataFrame, labels: list[str]) -> DataFrame:
    """The confusion matrix with a column for each label and for none."""
    cells = confusion(matches)
    return cells.groupBy("actual").pivot("predicted", [*labels, NONE]).agg(F.sum("n")).na.fill(0)


def unpivoted(metric_rows: DataFrame) -> DataFrame:
    """``label, metric, value``: long form for charts."""
    return metric_rows.unpivot(["label"], ["precision", "recall", "f1"], "metric", "value")


def label_spans(labels: DataFrame) -> DataFrame:
    """Spans of labelled substrings: the ``occurrence``-th (from 0) place of ``raw`` in ``text``.

    Occurrences may overlap. Where there are not so many the row fails.
    """
    step = "locate(raw, text, acc + 1)"
    at = F.expr(f"aggregate(sequence(0, occurrence), 0, (acc, i) -> case when i > 0 and acc = 0 then 0 else {step} end)")
    found = labels.withColumn("_at", at)
    start = F.when(F.col("_at") == 0, F.raise_error(F.concat(F.lit("label not found: "), F.col("raw")))).otherwise(F.col("_at") - 1)
    return found.withColumn("start", start.cast("int")).withColumn("end", F.col("start") + F.length("raw")).drop("_at")


def section(text: Column, first: str, last: str) -> Column:
    """From the start of one marker to the end of the other; fails where either is missing."""
    a = F.instr(text, first)
    b = F.locate(last, text) + len(last)
    return F.when((a == 0) | (F.locate(last, text) == 0) | (b <= a), F.raise_error(F.lit("section markers not found"))).otherwise(F.substr(text, a, b - a))


def annotation_template(predicted: DataFrame) -> DataFrame:
    """Predictions as editable records; those without an id are numbered within their document."""
    name = F.coalesce("entity_id", F.concat(F.lit("annotation-"), (F.col("ordinal") + 1).cast("string")))
    return predicted.select(name.alias("id"), "document_id", "pii_type", "start", "end", "text", F.lit("accept").alias("annotator_decision"))

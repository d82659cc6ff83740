"""Jobs, policies and lookups between their tables.

Null references lead nowhere: joins leave them out, lookups leave nulls beside them. Null times sort
first; repeated rows stay repeated; empty tables give no rows. Columns beside the named ones stay where a
function returns its input's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema


def default_policy() -> dict[str, str]:
    """Every type gets a pseudonym."""
    return dict.fromkeys(schema.TYPES, "pseudonymize")


def recent(jobs: DataFrame) -> DataFrame:
    """Latest first; jobs of the same time by id, those without a time last."""
    return jobs.orderBy(F.col("created_at").desc(), "id")


def policies_by_time(policies: DataFrame) -> DataFrame:
    """Earliest first; policies of the same time by id."""
    return policies.orderBy("created_at", "id")


def completed(jobs: DataFrame) -> DataFrame:
    """Jobs that ended well."""
    return jobs.where(F.col("status") == "completed")


def with_lookups(jobs: DataFrame, policies: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs with their policy's name and floor and their document's name; null where a reference leads nowhere."""
    p = policies.select(F.col("id").alias("policy_id"), F.col("name").alias("policy_name"), "confidence_floor")
    d = documents.select(F.col("id").alias("document_id"), "filename")
    return jobs.join(p, "policy_id", "left").join(d, "document_id", "left")


# Which state may follow which.
NEXT = {"queued": ("detecting",), "detecting": ("needs_review",), "needs_review": ("redacting",), "redacting": ("completed",), "completed": (), "failed": ()}


def run_states(events: DataFrame) -> DataFrame:
    """``job_id, status, error``: each job's state after its events in order (time, then state).

    An event (``job_id, ts, status, error``) counts if its state may follow the present one; every job
    begins as queued, and any state but an end state may fail, with the event's error text. Others are
    passed over. A null state never counts.
    """
    steps = F.array_sort(F.collect_list(F.struct("ts", "status", "error")))  # a job's own events

    def step(now: Column, e: Column) -> Column:
        good = F.lit(False)
        for state, then in NEXT.items():
            if then:
                good = good | ((now["status"] == state) & e["status"].isin(*then, "failed"))
        return F.when(good, F.struct(e["status"].alias("status"), F.when(e["status"] == "failed", e["error"]).alias("error"))).otherwise(now)

    first = F.struct(F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"))
    per = events.groupBy("job_id").agg(steps.alias("_steps"))
    return per.select("job_id", F.aggregate("_steps", first, step).alias("s")).select("job_id", "s.status", "s.error")


def statuses(events: DataFrame) -> DataFrame:
    """Each job's present state, that of its latest event."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("since"))


def with_detections(jobs: DataFrame, detections: DataFrame) -> DataFrame:
    """Jobs with each of their detections, by place."""
    return jobs.join(detections, jobs["id"] == detections["job_id"]).orderBy("job_id", "start", "end")


def missing(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose reference leads nowhere."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").where(F.col(key).isNotNull())


def updated_policies(policies: DataFrame, updates: DataFrame) -> DataFrame:
    """Policies with those fields replaced that an update gives; ``id`` names the policy."""
    fields = [c for c in updates.columns if c != "id"]
    joined = policies.alias("p").join(updates.alias("u"), "id", "left")
    return joined.select("id", *[F.coalesce(f"u.{c}", f"p.{c}").alias(c) if c in fields else F.col(f"p.{c}").alias(c) for c in policies.columns if c != "id"])


def summaries(counts: DataFrame) -> DataFrame:
    """``job_id, total, summary``: counts by type as JSON text, types by name."""
    per = counts.groupBy("job_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("pii_type", "n"))).alias("c"))
    return per.select("job_id", "total", F.to_json(F.map_from_entries("c")).alias("summary"))


def run_records(metrics: DataFrame, dataset: str, version: str = "v1") -> DataFrame:
    """A row to append to the table of evaluation runs: all metrics as JSON text."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(metrics.columns)))))
    return metrics.agg(body.alias("metrics")).select(F.lit(dataset).alias("dataset_id"), F.lit(version).alias("detector_version"), "metrics", F.current_timestamp().alias("completed_at"))


def detectors_for(kind: str) -> tuple[str, ...]:
    """Who finds a type, in the order of registration."""
    return tuple(name for name, types in schema.DETECTORS.items() if kind in types)


def catalog(spark) -> DataFrame:
    """``pii_type, detectors``: who finds what, in the order of registration."""
    rows = [(t, k, name) for k, (name, types) in enumerate(schema.DETECTORS.items()) for t in types]
    table = spark.createDataFrame(rows, "pii_type string, k int, detector string")
    return table.groupBy("pii_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "detector"))), lambda x: x["detector"]), ",").alias("detectors"))


def dictionary_matches(docs: DataFrame, needles: DataFrame, doc_id: str = "doc_id", text: str = "text", needle: str = "needle") -> DataFrame:
    """Whole-word places of needles: ``doc_id, start, end, needle``; of overlapping ones the longer stays.

    Each document is searched for its own needles (``needles`` has ``doc_id``), each different trimmed needle
    once; longer ones first, leftmost places first, and never across a place already taken.
    """
    own = needles.select(F.col(doc_id), F.trim(F.col(needle)).alias("n")).where("n != ''").distinct()
    lists = own.groupBy(doc_id).agg(F.collect_list("n").alias("ns"))
    ordered = F.transform(F.array_sort(F.transform("ns", lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda s: s["n"])
    taken = "array<struct<start:int,end:int,needle:string>>"

    def search(acc, n):
        # pieces between occurrences give the places; those that cut a word or a taken place don't count
        parts = F.split(F.col(text), F.concat(F.lit("\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
        step = lambda a, p: F.struct((a["at"] + F.length(p) + F.length(n)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out"))
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: F.slice(a["out"], 1, F.size(parts) - 1))
        from tessera.functions.spans import word_safe

        places = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + F.length(n)).alias("end"), n.alias("needle")))
        free = F.filter(places, lambda p: word_safe(F.col(text), p["start"], p["end"]) & ~F.exists(acc, lambda t: (t["start"] < p["end"]) & (p["start"] < t["end"])))
        return F.concat(acc, free)

    found = docs.join(lists, doc_id).withColumn("_ns", ordered).withColumn("hits", F.aggregate("_ns", F.array().cast(taken), search))
    return found.select(F.col(doc_id).alias("doc_id"), F.inline("hits")).select("doc_id", "start", "end", "needle")


def status_changes(events: DataFrame) -> DataFrame:
    """Events whose state differs from the one before, in each job, up to its first end state."""
    w = Window.partitionBy("job_id").orderBy("ts", "status")
    ended = F.max(F.col("status").isin(*schema.END_STATES).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumns({"previous": F.lag("status").over(w), "_ended": F.coalesce(ended, F.lit(0))})
    return marked.where((F.col("_ended") == 0) & ~F.col("previous").eqNullSafe(F.col("status"))).drop("_ended")

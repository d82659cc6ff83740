"""What goes out: artifacts of a redaction and reports of an evaluation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The figures of a report and how they come about, and below the headings of the Markdown form.
FORMULAS = {
    "true_positive": "a prediction and a free expected span of the same type that overlap",
    "false_positive": "a prediction that overlaps no free expected span, or one of another type",
    "false_negative": "an expected span that no prediction of the same type overlaps",
    "precision": "TP / (TP + FP)",
    "recall": "TP / (TP + FN)",
    "f1": "2 * Precision * Recall / (Precision + Recall)",
    "entity_accuracy": "TP / (TP + FP + FN)",
}
COUNTS, RATIOS = ("tp", "fp", "fn"), ("precision", "recall", "f1", "entity_accuracy")


def artifacts(audit: DataFrame) -> DataFrame:
    """A row for each document: its replacement map and its audit events as JSON texts, with their numbers.

    Mappings are sorted by type and original in any case, events by place.
    """
    mapping = F.struct(F.col("pii_type"), F.lower("original").alias("sort"), F.col("original"), F.col("replacement"))
    event = F.struct("start", "end", "entity_id", "pii_type", "original", "replacement", "source", "confidence")
    per = audit.groupBy("doc_id").agg(F.array_sort(F.collect_set(mapping)).alias("m"), F.array_sort(F.collect_list(event)).alias("e"))
    mappings = F.transform("m", lambda x: F.struct(x["pii_type"].alias("pii_type"), x["original"].alias("original"), x["replacement"].alias("replacement")))
    return per.select("doc_id", F.size("m").alias("mapping_count"), F.to_json(mappings).alias("mappings"), F.size("e").alias("event_count"), F.to_json("e").alias("events"))


def write_artifacts(audit: DataFrame, path: str) -> None:
    """``artifacts`` as JSON lines, with the time of writing."""
    artifacts(audit).withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(path)


def markdown(metric_rows: list[dict], cells: list[dict]) -> str:
    """The report as Markdown: overall first, then types by name, ratios to four places, the matrix, formulas."""
    head = ["| Label | TP | FP | FN | Precision | Recall | F1 | Entity Accuracy | Support |", "| --- |" + " ---: |" * 8]
    line = lambda r: f"| {r['label']} | " + " | ".join([*(str(r[c]) for c in COUNTS), *(f"{r[c]:.4f}" for c in RATIOS), str(r["support"])]) + " |"
    overall = [r for r in metric_rows if r["label"] == "overall"]
    types = sorted((r for r in metric_rows if r["label"] != "overall"), key=lambda r: r["label"])
    labels = sorted({c["actual"] for c in cells} | {c["predicted"] for c in cells})
    grid = {(c["actual"], c["predicted"]): c["n"] for c in cells}
    matrix = ["| Actual \\ Predicted | " + " | ".join(labels) + " |", "| --- |" + " ---: |" * len(labels)]
    matrix += [f"| {a} | " + " | ".join(str(grid.get((a, p), 0)) for p in labels) + " |" for a in labels]
    blocks = [["# Evaluation Report"], ["## Overall"], [*head, *map(line, overall)], ["## Classification Report"], [*head, *map(line, types)], ["## Confusion Matrix"], matrix, ["## Formulas"], [f"- **{k}**: `{v}`" for k, v in FORMULAS.items()]]
    return "\n\n".join("\n".join(b) for b in blocks) + "\n"


#: Lines on a page.
PAGE_LINES = 78


def minimal_pdf(text: str) -> bytes:
    """A PDF with the text's lines, as many pages as they need, for want of a library."""
    lines = [x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for x in text.splitlines()] or [""]
    pages = [lines[k : k + PAGE_LINES] for k in range(0, len(lines), PAGE_LINES)]
    first = 4  # after catalogue, tree and font come each page and its content
    kids = " ".join(f"{first + 2 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for k, page in enumerate(pages):
        stream = ("BT /F1 9 Tf 36 800 Td 10 TL " + " T* ".join(f"({x}) Tj" for x in page) + " ET").encode("latin-1", "replace")
        objects.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /MediaBox [0 0 595 842] /Contents {first + 2 * k + 1} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def write_reports(metric_rows: DataFrame, cells: DataFrame, folder: str, prefix: str = "evaluation", matches: DataFrame | None = None) -> dict[str, str]:
    """JSON, CSV, Markdown and PDF reports in a local folder; the tables have a row for each type at most.

    ``matches``, which may be of any size, are written beside them by Spark, as JSON lines.
    """
    from pathlib import Path

    rows, grid = [r.asDict() for r in metric_rows.collect()], [r.asDict() for r in cells.collect()]
    rows.sort(key=lambda r: (r["label"] != "overall", r["label"]))
    columns = ["label", *COUNTS, *RATIOS, "support"]
    text = markdown(rows, grid)
    bodies = {
        "json": json.dumps({"metrics": rows, "confusion_matrix": grid, "formulas": FORMULAS}, indent=2, sort_keys=True).encode(),
        "csv": ("\n".join([",".join(columns), *(",".join(str(r[c]) for c in columns) for r in rows)]) + "\n").encode(),
        "md": text.encode(),
        "pdf": minimal_pdf(text),
    }
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = {k: str(Path(folder) / f"{prefix}_report.{k}") for k in bodies}
    for k, body in bodies.items():
        Path(out[k]).write_bytes(body)
    if matches is not None:
        out["matches"] = str(Path(folder) / f"{prefix}_matches")
        matches.write.mode("overwrite").json(f"file://{Path(out['matches']).resolve()}")
    return out

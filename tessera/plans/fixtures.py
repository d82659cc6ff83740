"""Small inline relations for operators whose cases the test tables don't hold, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}

TEXTS = (
    (1, "SSN on file 234-56-7890, not 1234-56-7890 or 123456789012."),
    (2, "Server fe80:0:0:0:202:b3ff:fe1e:8329 answers, 10.0.0.1 too, 999.1.1.1 never."),
    (3, "Deliver to 615 Juniper Hollow Lane, Ashford, OR 97031 by noon."),
    (4, "1998 Long Term Storage and 7 Old Dresser handles."),
    (5, "Office: 12 M G Road, Mumbai 400001, and 5 Oak St. as well."),
    (6, "Date of birth: 03/14/1985; issued 01/02/2015."),
    (7, "She was born on January 5, 1990 in Pune, moved Sept 5, 1991 and May 7 1992."),
    (8, "Meeting on 2031-04-05, dob 1979-12-31, invalid 02/30/1980 born."),
    (9, "Applicant: Noor Castell\n\nPhone: none. Director: Ivo Lund Bergman signed."),
    (10, "Dear Customer Relations, Promoter Buying Agent, Attn Lise-Marie D'Arcy Holm."),
    (11, "Name: Tove Arman"),
    (12, ""),
)

ENTITIES = (
    # case, ordinal, type, start, end, text, confidence, source
    ("three_way", 0, "ssn", 0, 11, "123-45-6789", 0.97, "regex_detector"),
    ("three_way", 1, "phone", 4, 16, "45-6789 0000", 0.85, "regex_detector"),
    ("three_way", 2, "person", 20, 28, "Jane Doe", 0.85, "spacy_ner"),
    ("three_way", 3, "person", 24, 32, "Doe Ltd ", 0.6, "presidio_detector"),
    ("contain", 0, "address", 0, 40, "381 Juniper Grove Way, Northampton, MA 6", 0.88, "regex_detector"),
    ("contain", 1, "company", 4, 21, "Juniper Grove Way", 0.9, "spacy_ner"),
    ("contain", 2, "company", 4, 21, "Juniper Grove Way", 0.86, "presidio_detector"),
    ("stat", 0, "person", 0, 20, "Juniper Grove Way Co", 0.7, "spacy_ner"),
    ("stat", 1, "company", 4, 10, "green ", 0.8, "presidio_detector"),
    ("partial", 0, "address", 5, 25, "12 Oak Street, Reno N", 0.88, "regex_detector"),
    ("partial", 1, "company", 0, 8, "Acme 12 ", 0.95, "spacy_ner"),
    ("tie", 0, "person", 5, 9, "beta", 0.8, "spacy_ner"),
    ("tie", 1, "person", 0, 6, "alphab", 0.8, "presidio_detector"),
    ("touch", 0, "phone", 0, 5, "55512", 0.85, "regex_detector"),
    ("touch", 1, "phone", 5, 9, "3456", 0.8, "regex_detector"),
    ("agree", 0, "email", 0, 7, "a@b.com", 0.97, "regex_detector"),
    ("agree", 1, "email", 0, 7, "a@b.com", 0.5, "presidio_detector"),
    ("agree", 2, "email", 30, 37, "c@d.com", 0.98, "regex_detector"),
    ("agree", 3, "email", 31, 37, "@d.com", 0.6, "presidio_detector"),
)

TRIMS = ((1, 10, 22, " (Jane Doe),", 0.123456), (2, 0, 4, "Acme", 0.5), (3, 5, 8, "...", 0.75005), (4, 3, 14, "“Globex”; \n", 0.9))

COMPANIES = (
    (1, "We hired Acme Technologies Pvt. Ltd. last year.", 9, 26),
    (2, "Vertex, Inc. Corp. Ltd. won.", 0, 6),
    (3, "The Offer completed early.", 4, 9),
    (4, "Initech Company", 0, 7),
    (5, "Plain Name here", 0, 5),
)

NAMES = (
    (1, "Acme Corp", "", 0.8),
    (2, "SSN", "", 0.8),
    (3, "Offer", "the", 0.8),
    (4, "Red Prospectus", "our", 0.8),
    (5, "Globex Corporatoin", "", 0.8),
    (6, "xiv", "", 0.8),
    (7, "12345", "", 0.8),
    (8, "Offer Management Inc.", "the", 0.9),
    (9, "$", "", 0.5),
    (10, "Terrace", "", 0.8),
    (11, "MCIWORLD", "", 0.7),
    (12, "Partners", "Such", 0.8),
)

PAIRS = ((1, "john smith", "smith john"), (2, "Acme Corp", "Acme Corp."), (3, "", "x"), (4, "kitten", "sitting"), (5, "abc", "abc"), (6, "Jane Doe", "J Doe"), (7, "abcdef", "xyz"))

WINDOWS = ((1, "date of birth: "), (2, "adobe reader "), (3, "birthdya 1/2/1990"), (4, "invoice date"), (5, "   "), (6, "date  of birth"), (7, "b day 4/5/1990"), (8, "orn on 4/5/1990"), (9, "bithdate is 1990"))

REVIEWS = (
    # entity, decision, new type, at
    ("e1", "accept", None, "2024-01-01 10:00:00"),
    ("e1", "reject", None, "2024-01-02 10:00:00"),
    ("e2", "retype", "company", "2024-01-01 10:00:00"),
    ("e3", "accept", "person", "2024-01-01 10:00:00"),
    ("e6", "reject", None, "2024-01-01 10:00:00"),
)
FOUND = (
    # entity, doc, type, start, end, confidence
    ("e1", 1, "person", 0, 8, 0.95),
    ("e2", 1, "person", 12, 20, 0.5),
    ("e3", 1, "dob", 25, 35, 0.4),
    ("e4", 2, "phone", 0, 12, 0.85),
    ("e5", 2, "company", 20, 25, 0.6),
    ("e6", 3, "email", 3, 12, 0.97),
)
STATES = ((1, "needs_review"), (2, "needs_review"), (3, "completed"))

PLANS = (
    # case, text, entity, type, start, end, raw, strategy, confidence
    (1, "Ann met Annual Bob, then Ann Lee and Bob.", "a", "person", 0, 3, "Ann", "mask", 0.9),
    (1, "Ann met Annual Bob, then Ann Lee and Bob.", "b", "person", 8, 11, "Ann", "mask", 0.9),
    (1, "Ann met Annual Bob, then Ann Lee and Bob.", "c", "person", 25, 32, "Ann Lee", "mask", 0.8),
    (1, "Ann met Annual Bob, then Ann Lee and Bob.", "d", "company", 29, 32, "Lee", "mask", 0.95),
    (1, "Ann met Annual Bob, then Ann Lee and Bob.", "e", "person", 37, 40, "Bob", "black_box", 0.9),
    (2, "Call 415-555-0199 or 10.1.2.3.", "f", "phone", 5, 17, "415-555-0199", "generalize", 0.85),
    (2, "Call 415-555-0199 or 10.1.2.3.", "g", "ip_address", 21, 29, "10.1.2.3", "generalize", 0.83),
    (3, "Nothing here.", "h", "email", 90, 99, "x@y.com", "mask", 0.97),
)
VALUES = (
    (1, "dob", "03/14/1985"),
    (2, "dob", "January 5, 1990"),
    (3, "dob", "no date"),
    (4, "address", "381 Juniper Grove Way, Northampton, MA 62704"),
    (5, "address", "381 Juniper Grove Way"),
    (6, "phone", "(415) 555-0199"),
    (7, "phone", "12"),
    (8, "ip_address", "192.168.1.15"),
    (9, "ip_address", "fe80:0:0:0:202:b3ff:fe1e:8329"),
    (10, "email", "a@b.com"),
    (11, "dob", "12-31-2000"),
    (12, "dob", "1979-12-31"),
)

EXPECTED = (
    # document, type, start, end, ordinal
    ("d1", "person", 0, 8, 0),
    ("d1", "company", 20, 30, 1),
    ("d1", "email", 40, 55, 2),
    ("d2", "person", 0, 5, 0),
    ("d2", "person", 5, 10, 1),
    ("d3", "phone", 0, 12, 0),
)
PREDICTED = (
    ("d1", "person", 2, 8, 0),
    ("d1", "person", 21, 30, 1),
    ("d1", "dob", 60, 70, 2),
    ("d2", "person", 3, 9, 0),
    ("d2", "person", 0, 6, 1),
    ("d4", "phone", 0, 12, 0),
)
COUNTS = (("a", 8, 2, 2), ("zero", 0, 0, 0), ("noise", 0, 3, 0), ("missed", 0, 0, 4), ("all", 5, 0, 0))

WORDS = (
    # doc, page, block, line, word, text
    ("p", 1, 0, 0, 0, "Jane"),
    ("p", 1, 0, 0, 1, "Doe"),
    ("p", 1, 0, 1, 0, "Pune"),
    ("p", 1, 1, 0, 0, "Phone"),
    ("p", 2, 0, 0, 0, "Page"),
    ("p", 2, 0, 0, 1, "two"),
    ("q", 1, 0, 0, 0, "Only"),
)
OCR = (
    # doc, i, text, conf, block, par, line, left, top, width, height
    ("i", 0, "Jane", "96", 1, 1, 1, 10, 10, 40, 12),
    ("i", 1, "~", "12", 1, 1, 1, 52, 10, 4, 12),
    ("i", 2, "Doe", "40", 1, 1, 1, 60, 10, 30, 12),
    ("i", 3, " ", "95", 1, 1, 1, 92, 10, 4, 12),
    ("i", 4, "Pune", "88.5", 1, 1, 2, 10, 30, 44, 12),
    ("i", 5, "noise", "x", 1, 1, 2, 60, 30, 44, 12),
)
JSONS = (
    (1, '[{"pii_type":"person","span":{"start":1,"end":5},"text":"Jane"},{"type":"","label":"email","start":7,"end":12,"doc_id":"x"}]'),
    (2, '{"entities":[{"entity_type":"phone","start":0,"end":3,"document_id":"","raw_value":"555","id":"k1"}]}'),
)
EVENTS = (
    ("j1", "2024-01-01 00:00:00", "queued"),
    ("j1", "2024-01-01 00:00:01", "detecting"),
    ("j1", "2024-01-01 00:00:02", "detecting"),
    ("j1", "2024-01-01 00:00:03", "needs_review"),
    ("j1", "2024-01-01 00:00:05", "completed"),
    ("j1", "2024-01-01 00:00:06", "queued"),
    ("j2", "2024-01-01 00:00:00", "queued"),
    ("j2", "2024-01-01 00:00:04", "queued"),
    ("j2", "2024-01-01 00:00:07", "failed"),
)
JOBS = (("j1", 1, "p1", "completed", "2024-01-01 00:00:00"), ("j2", 2, "p1", "failed", "2024-01-02 00:00:00"), ("j3", 9, "p9", "queued", "2024-01-02 00:00:00"))
DETECTIONS = (("j1", "person", 10, 14), ("j1", "email", 2, 8), ("j2", "phone", 0, 12))
POLICIES = (("p1", "default", 0.75), ("p2", "strict", 0.5))
UPDATES = (("p2", None, 0.9),)
POLICY_LOG = (("p2", "strict", 0.5, "2024-01-02 00:00:00"), ("p1", "default", 0.75, "2024-01-01 00:00:00"), ("p3", "late", 0.9, "2024-01-02 00:00:00"))
FILES = ((1, "a.docx"), (2, "b.pdf"))
RUN_EVENTS = (
    ("r1", "2024-01-01 00:00:00", "detecting", None),
    ("r1", "2024-01-01 00:00:01", "completed", None),
    ("r1", "2024-01-01 00:00:02", "needs_review", None),
    ("r1", "2024-01-01 00:00:03", "redacting", "unused"),
    ("r1", "2024-01-01 00:00:04", "completed", None),
    ("r1", "2024-01-01 00:00:05", "failed", "too late"),
    ("r2", "2024-01-01 00:00:00", "detecting", None),
    ("r2", "2024-01-01 00:00:01", "failed", "no such file"),
    ("r3", "2024-01-01 00:00:00", None, None),
    ("r3", "2024-01-01 00:00:01", "queued", None),
    ("r4", "2024-01-01 00:00:00", "failed", None),
)
LABELS = ((1, "Ann and Ann again", "Ann", 0), (2, "Ann and Ann again", "Ann", 1), (3, "aaaa", "aa", 2))
BOXES = (("b1", 1, 0, 4), ("b1", 1, 5, 8), ("b1", 2, 12, 20))

SCHEMAS = {
    "texts": ("case_id long, text string", TEXTS),
    "entities": ("case_id string, ordinal int, type string, start int, end int, text string, confidence double, source string", ENTITIES),
    "trims": ("case_id long, start int, end int, text string, confidence double", TRIMS),
    "companies": ("case_id long, text string, start int, end int", COMPANIES),
    "names": ("case_id long, name string, before string, base double", NAMES),
    "pairs": ("case_id long, a string, b string", PAIRS),
    "windows": ("case_id long, w string", WINDOWS),
    "reviews": ("entity_id string, decision string, new_pii_type string, reviewed_at timestamp", REVIEWS),
    "found": ("entity_id string, doc_id long, type string, start int, end int, confidence double", FOUND),
    "states": ("doc_id long, status string", STATES),
    "plans": ("case_id long, body string, entity_id string, type string, start int, end int, text string, strategy string, confidence double", PLANS),
    "vals": ("case_id long, kind string, value string", VALUES),
    "expected": ("document_id string, pii_type string, start int, end int, ordinal int", EXPECTED),
    "predicted": ("document_id string, pii_type string, start int, end int, ordinal int", PREDICTED),
    "counted": ("label string, tp long, fp long, fn long", COUNTS),
    "words": ("doc_id string, page int, block int, line int, word int, text string", WORDS),
    "ocr": ("doc_id string, i int, text string, conf string, block int, par int, line int, left int, top int, width int, height int", OCR),
    "jsons": ("case_id long, payload string", JSONS),
    "status_events": ("job_id string, ts timestamp, status string", EVENTS),
    "jobs": ("id string, document_id long, policy_id string, status string, created_at timestamp", JOBS),
    "detections": ("job_id string, type string, start int, end int", DETECTIONS),
    "policies": ("id string, name string, confidence_floor double", POLICIES),
    "policy_log": ("id string, name string, confidence_floor double, created_at timestamp", POLICY_LOG),
    "files": ("id long, filename string", FILES),
    "run_events": ("job_id string, ts timestamp, status string, error string", RUN_EVENTS),
    "updates": ("id string, name string, confidence_floor double", UPDATES),
    "labelled": ("case_id long, text string, raw string, occurrence int", LABELS),
    "boxes": ("doc_id string, page int, start int, end int", BOXES),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    """The relation as a DataFrame."""
    columns, rows = SCHEMAS[name]
    plain = ", ".join(c if not c.endswith(" timestamp") else c.replace(" timestamp", " string") for c in columns.split(", "))
    out = spark.createDataFrame(list(rows), plain)
    for c in columns.split(", "):
        if c.endswith(" timestamp"):
            out = out.withColumn(c.split()[0], out[c.split()[0]].cast("timestamp"))
    return out


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def cte(*names: str) -> str:
    """``WITH`` clauses that define the relations by the same values."""
    out = []
    for name in names:
        columns, rows = SCHEMAS[name]
        cast = ", ".join(f'CAST("{c.split()[0]}" AS {_SQL_TYPES[c.split()[1]]}) AS "{c.split()[0]}"' for c in columns.split(", "))
        heads = ", ".join(f'"{c.split()[0]}"' for c in columns.split(", "))
        body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        out.append(f'{name} AS (SELECT {cast} FROM (VALUES {body}) AS v({heads}))')
    return "WITH RECURSIVE " + ",\n".join(out)

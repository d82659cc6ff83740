"""Closed domains, fixed values and schemas of the data model."""

from __future__ import annotations

# Kinds of personal data, strategies, review decisions, job states.
TYPES = ("person", "email", "phone", "company", "address", "ssn", "credit_card", "dob", "ip_address")
STRATEGIES = ("mask", "pseudonymize", "generalize", "black_box")
DECISIONS = ("accept", "reject", "retype")
STATES = ("queued", "detecting", "needs_review", "redacting", "completed", "failed")
END_STATES = ("completed", "failed")

#: Spans below this confidence wait for a review and are not redacted by themselves.
CONFIDENCE_FLOOR = 0.75

#: A typed, scored, half-open span of code points. ``ordinal`` is the order of detection, the last tie-break.
ENTITY = "struct<type:string,start:int,end:int,text:string,confidence:double,source:string,ordinal:int>"
ENTITIES = f"array<{ENTITY}>"

REGEX, DATES, LABELS = "regex_detector", "date_detector", "labeled_field_detector"
#: Sources whose matches have a fixed format and may displace guesses that they contain.
DETERMINISTIC = (REGEX, DATES)

# The confidence of each kind of match.
CONFIDENCE = {"ssn": 0.97, "credit_card": 0.9, "phone": 0.85, "email": 0.97, "ip_address": 0.83, "address": 0.88}
DOB_CONFIDENCE, DOB_ALONE, LABELED_CONFIDENCE = 0.92, 0.4, 0.82

# Which detectors find a type, in the order in which they are registered.
DETECTORS = {
    REGEX: ("ssn", "credit_card", "phone", "email", "ip_address", "address"),
    DATES: ("dob",),
    "spacy_ner": ("person", "company"),
    "presidio_detector": ("person", "company", "email", "phone", "credit_card", "ssn", "ip_address", "address", "dob"),
    LABELS: ("person",),
}

BLOCK = "struct<text:string,char_offset:int,page:int,paragraph_index:int,run_index:int,bbox:array<double>>"
EVALUATION_ENTITY = "pii_type string, start int, end int, document_id string, text string, entity_id string"
REVIEW = "entity_id string, decision string, new_pii_type string, reviewed_at timestamp"
EVENT = "job_id string, ts timestamp, status string"

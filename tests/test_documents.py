"""The queries over ``documents`` report and mask every kind, against plain regular expressions and SQL."""

import hashlib
import re

import duckdb
import pytest

from tessera.plans.registry import ORACLE_SQL, QUERIES

PLANTED = {
    "ssn": "234-56-7890",
    "address": "742 Evergreen Terrace, Springfield, IL 62704",
    "dob": "03/14/1985",
    "person": "Jane Doe",
    "ip_address": "2001:0db8:0000:0000:0000:ff00:0042:8329",
    "email": "jane@acme.com",
}
TEXTS = [
    f"SSN {PLANTED['ssn']} on file",
    f"lives at {PLANTED['address']} now",
    f"she was born {PLANTED['dob']} here",
    f"Applicant: {PLANTED['person']}\nDear Customer Service\nDirector Identification Number",
    f"from {PLANTED['ip_address']} today",
    f"mail {PLANTED['email']} or not",
    "plain words, 12/13 of 2023 Short Term Borrowings, 02/30/1990, Sept 5, 1990 and 1800-01-01",
    "May 7 1992, January 5, 1990, jan 6 1991, January 7 1992, 1-2-1990 and 1990-2-3",
    "٢٣٤-٥٦-٧٨٩٠",
]
PLAIN = {
    "detect_ssn_documents": r"\b\d{3}-\d{2}-\d{4}\b",
    "detect_ipv6_documents": r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b",
    "detect_address_documents": re.escape(PLANTED["address"]),
    "detect_dob_documents": r"03/14/1985|May 7 1992|January 5, 1990|jan 6 1991|\b1-2-1990|1990-2-3",
    "detect_labeled_name_documents": r"(?<=Applicant: )Jane Doe",
}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{base}/documents.parquet")
    return str(base)


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_kinds_over_documents(spark, planted, name):
    got = sorted((r["doc_id"], r["value"], r["start"], r["end"]) for r in QUERIES[name](spark, planted).collect())
    assert got and got == sorted((k, m[0], m.start(), m.end()) for k, t in enumerate(TEXTS) for m in re.finditer(PLAIN[name], t))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{planted}/documents.parquet/*.parquet'")
    said = con.execute(f'SELECT doc_id, value, start, "end" FROM ({ORACLE_SQL[name]})').fetchall()
    assert sorted(said) == [r for r in got if r[0] != 8]  # digits are ASCII there


@pytest.mark.parametrize("name", ["detect_all", "detect_pii", "audit_log", "replacement_map", "pseudonymize"])
def test_no_kind_is_left_out(spark, planted, name):
    df = QUERIES[name](spark, planted)
    kind, value = ("pii_type" if "pii_type" in df.columns else "type"), ("value" if "value" in df.columns else "original")
    assert {(r[kind], r[value]) for r in df.collect()} >= set(PLANTED.items())


def test_counts_have_every_kind(spark, planted):
    assert {r["pii_type"] for r in QUERIES["redaction_counts"](spark, planted).collect()} == set(PLANTED)
    assert set(PLANTED) <= set(re.findall(r'"(\w+)":', QUERIES["job_summary"](spark, planted).first()["summary"]))


@pytest.mark.parametrize("name", ["redact_mask", "redact_text"])
def test_every_kind_is_masked(spark, planted, name):
    got = {r["doc_id"]: r["redacted_sha256"] for r in QUERIES[name](spark, planted).collect()}
    for k, (kind, value) in enumerate(PLANTED.items()):
        assert got[k] == hashlib.sha256(TEXTS[k].replace(value, f"[REDACTED-{kind.upper()}]").encode()).hexdigest(), kind

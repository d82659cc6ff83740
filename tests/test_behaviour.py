"""What the operators promise, on small cases of our own."""

import datetime
import io
import zipfile

import pytest
from tests.conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__
from tessera import schema
from tessera.functions import fuzzy, spans, validators
from tessera.operators import detect, evaluate, jobs, pipeline, pseudonyms, redact, resolve, review
from tessera.plans import registry
from tessera.sources import adapters, blocks, docx, ingest, sinks

AS_OF = datetime.date(2024, 6, 1)
ALL_NINE = "Applicant: Jane Doe of Acme Corporation, jane@acme.com, (415) 555-0199, SSN 234-56-7890, card 4539148803436467, born 03/14/1985, IP 192.168.1.15, 742 Evergreen Terrace, Springfield, IL 62704."


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def found(spark, text, types=schema.TYPES, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["type"], r["text"], r["start"], r["end"], r["confidence"]) for r in pipeline.detect_pii(df, types, as_of=F.lit(AS_OF), **options).orderBy("start").collect()]


def test_entry_and_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "n_spans", "redacted"] and df.count() == 200


def test_all_types_in_one_text(spark):
    df = spark.createDataFrame([(1, ALL_NINE)], "doc_id long, text string").withColumn("x", detect.company_words(F.col("text")))
    entities = pipeline.with_entities(df, as_of=F.lit(AS_OF), extra="x").first()["entities"]
    assert {e["type"] for e in entities} == set(schema.TYPES)
    assert all(ALL_NINE[e["start"] : e["end"]] == e["text"] and 0 <= e["confidence"] <= 1 for e in entities)
    assert all(a["end"] <= b["start"] for a, b in zip(entities, entities[1:], strict=False))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        (None, []),
        ("4539148803436468", []),  # the checksum fails
        ("4539 1488 0343 6467 ", [("credit_card", "4539 1488 0343 6467")]),
        ("4 5 3 9 1 4 8 8 0 3 4 3 6 4 6 7", [("credit_card", "4 5 3 9 1 4 8 8 0 3 4 3 6 4 6 7")]),
        ("12\u00a0Oak St", [("address", "12\u00a0Oak St")]),
        ("٢٣٤-٥٦-٧٨٩٠", [("ssn", "٢٣٤-٥٦-٧٨٩٠")]),
        ("999.999.999.999 and 01.2.3.4", []),
        ("😀 a@b.co", [("email", "a@b.co")]),
        ("reach 555-123-4567.", [("phone", "555-123-4567")]),
        ("naïve@x.com", []),
        ("phone 555 123 4567", [("phone", "555 123 4567")]),
        ("2023 Short Term Borrowings", []),
        ("12 Oak St, Reno, NV 895012", [("address", "12 Oak St, Reno, NV 895012")]),
        ("Sept 5, 1990 born", []),
        ("Dear Customer Service", []),
        ("Applicant: Rashi Patil\n\nEmail: x", [("person", "Rashi Patil")]),
        ("Director Identification Number", []),
        ("Director: Anil Mehta", [("person", "Anil Mehta")]),
    ],
)
def test_detection(spark, text, want):
    assert [x[:2] for x in found(spark, text)] == want


def test_offsets_are_code_points(spark):
    assert found(spark, "😀 a@b.co")[0][2:4] == (2, 8)


def test_dates_of_birth(spark):
    got = {x[1]: x[4] for x in found(spark, "born 03/14/1985" + " x" * 40 + " due 01/02/2015" + " x" * 40 + " 1800-01-01 2030-01-01 02/30/1990 May 7 1992")}
    assert got == {"03/14/1985": 0.92, "01/02/2015": 0.4, "May 7 1992": 0.4}


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown types"):
        detect.detect_all(F.lit("x"), ("nonsense",))


def test_only_wanted_patterns_are_planned(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pipeline.detect_pii(df, ("email",))._jdf.queryExecution().toString()
    assert "@" in plan and "Evergreen" not in plan and "Boulevard" not in plan and "Exchange" not in plan.split("Physical Plan")[1]


def test_word_safety_and_windows(spark):
    t = {"t": "Annual _Ann_ Ann é"}
    safe = lambda a, b: one(spark, spans.word_safe(F.col("t"), F.lit(a), F.lit(b)), **t)
    assert [safe(0, 3), safe(8, 11), safe(13, 16), safe(5, 5), safe(17, 18), safe(17, 99), safe(-1, 2)] == [False, False, True, False, True, False, False]
    assert one(spark, spans.context_window(F.col("t"), F.lit(2), F.lit(4), 2), t="ABCDEFGH") == "abcdef"
    assert one(spark, spans.preceding_word(F.col("t"), F.lit(8)), t="in the  Offer") == "the"


def test_validators(spark):
    check = lambda f, v: one(spark, f(F.col("v")), v=v)
    assert [check(validators.luhn_valid, v) for v in ("4539148803436467", "4539148803436468", "42", "4539-1488 0343-6467")] == [True, False, False, True]
    assert [check(validators.ipv4_valid, v) for v in ("0.0.0.0", "255.1.2.3", "256.1.1.1", "1.2.3", "01.2.3.4", "1.2.3.4.5", "a.b.c.d")] == [True, True, False, False, False, False, False]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        row = out
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("", ""), ("a", ""), ("corp", "corp"), ("corporatoin", "corporation"), ("ab", "ba")])
def test_indel_ratio(spark, a, b):
    want = 2 * lcs(a, b) / (len(a) + len(b)) if a + b else 1.0
    assert one(spark, fuzzy.indel_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_birth_context_is_the_best_partial_similarity(spark):
    """Against every stretch of the window, as long as the keyword or shorter at an edge."""

    def best(k, w):
        m = len(k)
        pieces = [w[i : i + m] for i in range(len(w) - m + 1)] + [w[:i] for i in range(1, m)] + [w[-i:] for i in range(1, m)]
        return max(2 * lcs(k, p) / (m + len(p)) for p in pieces)

    windows = ["birthdya 1/2/1990 ok", "date  of birth 3/4/1990", "orn on 4/5/1990 aaaa", "bithdate is 1990 now", "invoice date 1/2/2020", "b day 4/5/1990 xxxx", "the airborne unit 1990", "xx 1/2/1990 bor", "dat of birth 1990 x", "brith of date 1990 x", "adobe reader 1/1/1990"]
    df = spark.createDataFrame([(w,) for w in windows], "w string").select("w", fuzzy.birth_context(F.col("w")).alias("x"))
    assert {r["w"]: r["x"] for r in df.collect()} == {w: any(best(k, w) >= 0.85 for k in fuzzy.BIRTH_KEYWORDS) for w in windows}


def test_chunks_cover_and_shift(spark):
    text = "a" * 50 + "\n\n" + "b" * 120 + "\n" + "c" * 200
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(detect.chunks(F.col("t"), 100, 10))).collect()
    assert all(text[r["start"] : r["start"] + len(r["text"])] == r["text"] and len(r["text"]) <= 100 for r in got)
    covered = set().union(*(range(r["start"], r["start"] + len(r["text"])) for r in got))
    assert covered == set(range(len(text))) and got[0]["text"] == "a" * 50
    assert spark.createDataFrame([("short",)], "t string").select(F.inline(detect.chunks(F.col("t")))).collect() == [(0, "short")]


def resolved(spark, rows):
    df = spark.createDataFrame([([(t, s, e, "x" * (e - s), c, src, i) for i, (t, s, e, c, src) in enumerate(rows)],)], f"e {schema.ENTITIES}")
    return [(e["type"], e["start"], e["end"]) for e in df.select(resolve.merge(F.col("e")).alias("e")).first()["e"]]


def test_merge(spark):
    assert resolved(spark, []) == []
    assert resolved(spark, [("person", 5, 9, 0.8, "a"), ("person", 0, 6, 0.8, "b")]) == [("person", 0, 6)]
    assert resolved(spark, [("phone", 0, 5, 0.8, "a"), ("email", 5, 9, 0.7, "a")]) == [("phone", 0, 5), ("email", 5, 9)]
    address = ("address", 0, 40, 0.88, schema.REGEX)
    assert resolved(spark, [address, ("company", 4, 21, 0.95, "spacy_ner"), ("person", 25, 30, 0.9, "spacy_ner")]) == [("address", 0, 40)]
    assert resolved(spark, [("address", 0, 40, 0.88, "spacy_ner"), ("company", 4, 21, 0.95, "x")]) == [("company", 4, 21)]
    assert resolved(spark, [address, ("company", 35, 50, 0.95, "spacy_ner")]) == [("company", 35, 50)]
    assert resolved(spark, [address, ("address", 4, 21, 0.95, "spacy_ner")]) == [("address", 4, 21)]


def test_corroboration_caps(spark):
    rows = [("email", 0, 7, "a@b.com", 0.97, "r", 0), ("email", 0, 7, "a@b.com", 0.5, "p", 1), ("email", 20, 27, "c@d.com", 0.99, "r", 2), ("email", 20, 24, "zzzz", 0.5, "p", 3)]
    got = spark.createDataFrame([(rows,)], f"e {schema.ENTITIES}").select(resolve.corroborate(F.col("e")).alias("e")).first()["e"]
    assert [round(e["confidence"], 4) for e in got] == [0.99, 0.55, 0.99, 0.5]


def test_reviews(spark):
    e = spark.createDataFrame([("a", 1, "person", 0.5), ("b", 1, "person", 0.9), ("c", 2, "dob", 0.9)], "entity_id string, doc_id long, type string, confidence double")
    r = spark.createDataFrame([("a", "retype", "company", "2024-01-02"), ("a", "reject", None, "2024-01-01"), ("b", "bogus", None, "2024-01-01"), ("c", "accept", "email", "2024-01-01")], "entity_id string, decision string, new_pii_type string, t string").withColumn("reviewed_at", F.to_timestamp("t"))
    got = {x["entity_id"]: x for x in review.apply_reviews(e, r).collect()}
    assert [got[k]["effective_type"] for k in "abc"] == ["company", "person", "dob"] and [got[k]["verified"] for k in "abc"] == [True, False, True]


def plan_of(spark, text, rows, **options):
    approved = "array<struct<entity_id:string,type:string,start:int,end:int,text:string,strategy:string,replacement:string,source:string,confidence:double>>"
    df = spark.createDataFrame([(text, [(i, t, s, e, text[s:e], st, rep, "x", 0.9) for i, t, s, e, st, rep in rows])], f"text string, approved {approved}")
    return redact.redact(df, **options).first()


def test_planning(spark):
    text = "Ann met Annual Ann Lee, Ann."
    got = plan_of(spark, text, [("1", "person", 0, 3, "mask", "[A]"), ("2", "person", 8, 11, "mask", "[B]"), ("3", "person", 15, 22, "mask", "[C]"), ("4", "company", 19, 22, "mask", "[D]"), ("5", "person", 24, 27, "mask", "[E]")])
    assert got["redacted"] == "[A] met Annual [C], [A]."  # the first replacement of a value holds
    assert [p["entity_id"] for p in got["plan"]] == ["1", "3", "5"]
    assert plan_of(spark, "x", [])["redacted"] == "x"
    got = plan_of(spark, "a b c", [("1", "person", 2, 3, "black_box", "[REDACTED-PERSON]")], black_box_as_empty=True)
    assert got["redacted"] == "a  c" and got["plan"][0]["replacement"] == "[BLACK-BOX]"


def test_generalize_of_every_kind(spark):
    g = lambda k, v: one(spark, redact.generalize(F.col("k"), F.col("v"), F.lit(AS_OF)), k=k, v=v)
    assert g("dob", "06/02/1984") == "[AGE 30-39]" and g("dob", "June 1, 1984") == "[AGE 40-49]" and g("dob", "soon") == "[REDACTED-DOB]"
    assert g("ip_address", "1:2:3:4:5:6:7:8") == "[REDACTED-IP_ADDRESS]" and g("phone", "12") == "[REDACTED-PHONE]"


def test_pseudonyms(spark):
    values = [("person", "Jane Doe"), ("email", "jane.doe@x.com"), ("person", "Jane Doe"), ("person", "John Roe"), ("dob", "1990-01-02"), ("credit_card", "4539148803436467"), ("email", "nobody@y.org"), ("phone", "+1 415 555 0199")]
    df = spark.createDataFrame([(1, values), (2, values)], "doc_id long, v array<struct<type:string,original:string>>")
    memo = df.select("doc_id", pseudonyms.pseudonyms(F.col("doc_id"), F.col("v"), F.lit(AS_OF)).alias("m")).orderBy("doc_id").collect()
    one_, two = ({(m["type"], m["original"]): m["fake"] for m in r["m"]} for r in memo)
    assert len(one_) == 7 and one_ != two  # a mapping belongs to its document
    assert one_["email", "jane.doe@x.com"] == ".".join(one_["person", "Jane Doe"].lower().split()) + "@example.com"
    assert len(set(one_.values())) == 7
    assert datetime.date(1934, 1, 1) < datetime.date.fromisoformat(one_["dob", "1990-01-02"]) <= datetime.date(2006, 6, 1)
    assert one(spark, validators.luhn_valid(F.col("v")), v=one_["credit_card", "4539148803436467"])
    assert one_["phone", "+1 415 555 0199"].startswith("+91 ")
    again = df.select(pseudonyms.pseudonyms(F.col("doc_id"), F.col("v"), F.lit(AS_OF)).alias("m")).first()["m"]
    assert again == memo[0]["m"]


def test_pseudonym_collisions_get_a_hash(spark):
    values = [("person", "Jane Doe"), ("person", "Jim Doe")]  # kin share a stand-in, so the second is marked
    m = spark.createDataFrame([(values,)], "v array<struct<type:string,original:string>>").select(pseudonyms.pseudonyms(F.lit(1), F.col("v"), F.lit(AS_OF)).alias("m")).first()["m"]
    assert m[1]["fake"].startswith(m[0]["fake"] + " ") and len(m[1]["fake"].split()[-1]) == 8


def test_evaluation_edges(spark):
    schema_ = "document_id string, pii_type string, start int, end int, ordinal int"
    gt = spark.createDataFrame([("a", "person", 0, 5, 0)], schema_)
    none = spark.createDataFrame([], schema_)
    assert [r["outcome"] for r in evaluate.match_best_overlap(gt, none).collect()] == ["false_negative"]
    assert evaluate.match_best_overlap(none, none).count() == 0
    other = spark.createDataFrame([("b", "person", 0, 5, 0)], schema_)
    assert sorted(r["outcome"] for r in evaluate.match_best_overlap(gt, other).collect()) == ["false_negative", "false_positive"]
    touching = spark.createDataFrame([("a", "person", 5, 9, 0)], schema_)
    assert evaluate.match_first_fit(gt, touching).first()["tp"] == 0
    wide = evaluate.confusion_wide(evaluate.match_best_overlap(gt, other), ["person"]).orderBy("actual").collect()
    assert [tuple(r) for r in wide] == [("__none__", 1, 0), ("person", 0, 1)]


def test_label_and_section_errors(spark):
    bad = spark.createDataFrame([("abc", "x", 0)], "text string, raw string, occurrence int")
    with pytest.raises(Exception, match="label not found"):
        evaluate.label_spans(bad).collect()
    with pytest.raises(Exception, match="section markers"):
        one(spark, evaluate.section(F.col("t"), "no", "such"), t="text")


def test_load_entities_strict(spark):
    bad = spark.createDataFrame([('[{"type":"alien","start":0,"end":1}]',)], "payload string")
    with pytest.raises(Exception, match="unsupported"):
        ingest.load_entities(bad).collect()
    assert ingest.load_entities(bad, strict=False).count() == 0


def test_ingest(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, c string")
    got = {r["id"]: (r["first_id"], r["deduplicated"]) for r in ingest.deduplicated(rows, "c", ["id"]).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False)}
    names = spark.createDataFrame([("a.DOCX", 1), ("b.txt", 1), ("c.pdf", 10**9)], "f string, n long")
    assert [r["x"] for r in names.select(ingest.acceptable(F.col("f"), F.col("n")).alias("x")).collect()] == [True, False, False]


def _word(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, f'<w:x xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{body}</w:x>'.replace("w:x ", "w:document ").replace("</w:x>", "</w:document>"))
    return out.getvalue()


def _p(*runs):
    return "<w:p>" + "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


def test_word_files(spark):
    cell = lambda body, merged="": f"<w:tc><w:tcPr>{merged}</w:tcPr>{body}</w:tc>"
    table = f"<w:tbl><w:tr>{cell(_p('top'), '<w:vMerge w:val=&quot;restart&quot;/>'.replace('&quot;', chr(34)))}</w:tr><w:tr>{cell(_p('again'), '<w:vMerge/>')}</w:tr></w:tbl>"
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    section = lambda *refs: f"<w:sectPr {r}>" + "".join(f'<w:{kind}Reference w:type="{pages}" r:id="{link}"/>' for kind, pages, link in refs) + "</w:sectPr>"
    first = f"<w:p><w:pPr>{section(('header', 'first', 'r2'), ('header', 'default', 'r10'), ('footer', 'default', 'r3'))}</w:pPr></w:p>"
    links = "".join(f'<Relationship xmlns="http://schemas.openxmlformats.org/package/2006/relationships" Id="{k}" Target="{v}"/>' for k, v in (("r10", "header10.xml"), ("r2", "header2.xml"), ("r3", "footer1.xml")))
    parts = {"word/document.xml": f"<w:body>{_p('Jane ', 'Doe')}{table}{_p('end')}{first}{section(('header', 'default', 'r10'))}</w:body>", "word/header10.xml": _p("usual"), "word/header2.xml": _p("first"), "word/footer1.xml": _p(), "word/header1.xml": _p("nobody's"), "word/_rels/document.xml.rels": links}
    content = _word(parts)
    texts = [b[0] for b in docx.blocks_of(content)]
    assert texts == ["Jane ", "Doe", "top", "end", "usual", "first"]
    text = docx.text_of(content)
    assert all(text[b[1] : b[1] + len(b[0])] == b[0] for b in docx.blocks_of(content))
    new = docx.rewritten(content, [(3, 8, "[X]"), (text.index("top"), text.index("top") + 3, "[T]")])
    assert [b[0] for b in docx.blocks_of(new)][:3] == ["Jan[X]", "[T]", "end"]
    files = spark.createDataFrame([("a", content), ("b", b"junk")], "path string, content binary")
    assert {r["path"]: r["text"] for r in docx.read_texts(files).collect()}["b"] is None
    planned = files.where("path = 'a'").join(docx.read_texts(files), "path")
    planned = redact.redact(planned.withColumn("approved", F.expr("array(named_struct('entity_id','1','type','person','start',0,'end',8,'text','Jane Doe','strategy','mask','replacement','[P]','source','s','confidence',0.9D))")))
    out = docx.write_redacted(planned).first()["content"]
    assert docx.text_of(bytes(out)).startswith("[P]\n\n")


def test_words_and_boxes(spark):
    w = spark.createDataFrame([("d", 1, 0, 0, 0, "a"), ("d", 1, 0, 1, 0, "b"), ("d", 2, 0, 0, 0, "c")], "doc_id string, page int, block int, line int, word int, text string")
    assert blocks.text_of(blocks.pdf_words(w)).first()["text"] == "a\nb\n\nc"


def test_adapters(spark):
    with pytest.raises(adapters.DetectorUnavailable):
        adapters.require("no_such_library_at_all")
    docs = spark.createDataFrame([(1, "Jane Doe met Acme Corp in the Offer"), (2, " "), (3, None)], "doc_id long, text string")

    def make():
        return lambda texts: [[("PERSON", 0, 8, 1.0), ("ORG", 13, 22, 1.0), ("ORG", 30, 35, 1.0), ("GPE", 0, 1, 1.0)] for _ in texts]

    raw = adapters.with_raw(docs, make)
    got = raw.select("doc_id", F.inline(adapters.ner_entities(F.col("text"), F.col("raw")))).collect()
    assert [(r["type"], r["text"], round(r["confidence"], 4)) for r in got] == [("person", "Jane Doe", 0.85), ("company", "Acme Corp", 0.95), ("company", "Offer", 0.24)]


def test_dictionary_search(spark):
    docs = spark.createDataFrame([(1, "Ann Lee saw Ann and Anna; Ann.")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, " Ann "), (1, "Ann Lee"), (1, ""), (1, "Ann")], "doc_id long, needle string")
    got = sorted((r["start"], r["needle"]) for r in jobs.dictionary_matches(docs, needles).collect())
    assert got == [(0, "Ann Lee"), (12, "Ann"), (26, "Ann")]


def test_words_inside_addresses_count_as_in_the_sql(spark, tmp_path):
    import duckdb

    from tessera.plans.registry import ORACLE_SQL, QUERIES

    texts = ["See the note.\nthe.65@mail7.example.com knows the. other", "of.the@a.example.com, the@b.example.com", "x@c.example.com by x@c.example.com.au", "the rest"]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["needle"], r["n"], r["first"]) for r in QUERIES["dictionary_highlight"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT doc_id, needle, n, first FROM ({ORACLE_SQL['dictionary_highlight']})").fetchall())
    assert (0, "the", 3, 4) in got


def test_reports(spark, tmp_path):
    schema_ = "document_id string, pii_type string, start int, end int, ordinal int"
    gt = spark.createDataFrame([("a", "person", 0, 5, 0), ("a", "email", 9, 12, 1)], schema_)
    matches = evaluate.match_best_overlap(gt, gt.where("pii_type = 'person'"))
    paths = sinks.write_reports(evaluate.report(matches), evaluate.confusion(matches), str(tmp_path))
    text = open(paths["md"]).read()
    assert "| overall | 1 | 0 | 1 | 1.0000 | 0.5000 | 0.6667 | 0.5000 | 2 |" in text
    assert open(paths["csv"]).read().splitlines()[1].startswith("overall,1,0,1,1.0,0.5")
    assert open(paths["pdf"], "rb").read().startswith(b"%PDF-1.4")


def test_artifacts(spark, tmp_path):
    audit = spark.createDataFrame([(1, "e1", "person", 0, 3, "Bob", "[P]", "s", 0.9), (1, "e2", "person", 9, 12, "ann", "[P]", "s", 0.9)], "doc_id long, entity_id string, pii_type string, start int, end int, original string, replacement string, source string, confidence double")
    row = sinks.artifacts(audit).first()
    assert row["mapping_count"] == 2 and row["mappings"].index("ann") < row["mappings"].index("Bob")
    sinks.write_artifacts(audit, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_status_stream_ends(spark):
    import threading

    from tessera.plans.queries import status_stream

    out = []
    run = threading.Thread(target=lambda: out.extend(status_stream(spark, "").collect()), daemon=True)
    run.start()
    run.join(120)
    left = spark.streams.active
    for q in left:
        q.stop()
    assert not left and not run.is_alive()
    assert sorted((r["job_id"], r["status"]) for r in out) == [("j1", "completed"), ("j1", "detecting"), ("j1", "needs_review"), ("j1", "queued"), ("j2", "failed"), ("j2", "queued")]


def test_detection_runs_on_a_stream(spark, tmp_path):
    from tessera.streaming import status

    spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = status.detected(stream, ("email", "phone")).writeStream.format("memory").queryName("detected").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = pipeline.detect_pii(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), ("email", "phone"))
    assert sorted(map(tuple, spark.table("detected").collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_counts_on_a_stream(spark, tmp_path):
    from tessera.streaming import status

    rows = [("2024-01-01 00:10:00", "a@b.co"), ("2024-01-01 00:50:00", "c@d.co x@y.zz"), ("2024-01-01 02:10:00", "none"), ("2024-01-01 09:10:00", "z@z.zz")]
    spark.createDataFrame(rows, "t string, text string").select(F.to_timestamp("t").alias("ts"), "text").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    query = status.counts_by_window(stream, types=("email",)).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["window"]["start"].hour, r["n"]) for r in spark.table("windowed").collect()) == [(0, 3), (9, 1)]


def test_gold_set(spark):
    got = {r["label"]: r for r in registry.QUERIES["gold_eval"](spark, SF_SMALL).collect()}
    assert all(got[t]["f1"] == 1.0 for t in ("email", "phone", "address", "ssn", "dob", "credit_card", "ip_address"))


def test_word_blocks_query(spark):
    got = registry.QUERIES["docx_blocks"](spark, SF_SMALL).where("path = 'case-9'").orderBy("i").collect()
    assert [r["char_offset"] for r in got] == [0, 25]


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "tessera"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tessera.llm" in p.read_text()]


def test_formats(spark, tmp_path):
    from tessera.sources import formats

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{_p("mail a@b.co now")}</w:body></w:document>')
        z.writestr("word/media/image1.png", b"picture")
    (tmp_path / "one.DOCX").write_bytes(out.getvalue())
    (tmp_path / "two.txt").write_text("x")
    files = formats.read_files(spark, str(tmp_path))
    assert [r["text"] for r in formats.texts(files, "docx").collect()] == ["mail a@b.co now"]
    assert [bytes(r["content"]) for r in formats.images(files).collect()] == [b"picture"]
    with pytest.raises(ValueError, match="unsupported"):
        formats.texts(files, "odt")
    assert [r["x"] for r in spark.createDataFrame([("ﬁ①",), (None,)], "t string").select(formats.nfkc("t").alias("x")).collect()] == ["fi1", None]
    assert jobs.detectors_for("person") == ("spacy_ner", "presidio_detector", "labeled_field_detector")


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    spark.createDataFrame([(1, "reach a@b.co or 555-123-4567"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    main(["detect", str(tmp_path / "in"), str(tmp_path / "found"), "--types", "email"], spark)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "found")).collect()] == ["a@b.co"]
    main(["redact", str(tmp_path / "in"), str(tmp_path / "usual")], spark)  # pseudonyms, unless told otherwise
    usual = {r["doc_id"]: r["redacted"] for r in spark.read.parquet(str(tmp_path / "usual/texts")).collect()}
    assert "@example.com or " in usual[1] and "555-123-4567" not in usual[1] and usual[2] is None
    capsys.readouterr()
    main(["redact", str(tmp_path / "in"), str(tmp_path / "out"), "--strategy", "mask", "phone=generalize"], spark)
    got = {r["doc_id"]: r["redacted"] for r in spark.read.parquet(str(tmp_path / "out/texts")).collect()}
    assert got == {1: "reach [REDACTED-EMAIL] or [PHONE ENDING 4567]", 2: None}
    assert "total          2" in capsys.readouterr().out
    (tmp_path / "gt.json").write_text('[{"type":"email","start":0,"end":5}]')
    main(["evaluate", str(tmp_path / "gt.json"), str(tmp_path / "gt.json"), str(tmp_path / "rep")], spark)
    assert "1.0000" in (tmp_path / "rep/evaluation_report.md").read_text()
    with pytest.raises(SystemExit):
        main(["redact", str(tmp_path / "in"), str(tmp_path / "out"), "--strategy", "phone=nonsense"], spark)


def test_small_inputs_are_spread(spark, monkeypatch):
    from tessera.sources import tables

    docs = tables.read(spark, SF_SMALL, "documents")
    assert "REPARTITION" in tables.spread(docs)._jdf.queryExecution().toString().upper()
    monkeypatch.setattr(tables, "SMALL_SHARE", 0)
    assert "REPARTITION" not in tables.spread(docs)._jdf.queryExecution().toString().upper()


def test_models_see_long_texts_in_pieces(spark):
    text = "\n".join(f"line {k} with name{k}" for k in range(300))
    seen = list(adapters.pieces(text, 200, 40))
    assert all(text[at : at + len(p)] == p and len(p) <= 200 for at, p in seen) and seen[-1][0] + len(seen[-1][1]) == len(text)
    assert all(a + len(p) >= b for (a, p), (b, _) in zip(seen, seen[1:], strict=False))

    def make():
        import re

        return lambda texts: [[("PERSON", m.start(), m.end(), 1.0) for m in re.finditer(r"\bname\d+\b", t)] for t in texts]

    raw = adapters.with_raw(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), make, size=200, overlap=40)
    got = raw.where("doc_id = 1").first()["raw"]
    assert {text[r["start"] : r["end"]] for r in got} >= {f"name{k}" for k in range(300)} and len(got) == len({(r["start"], r["end"]) for r in got})


def test_pseudonyms_and_reviews_reach_the_text(spark):
    from tessera.operators import policy

    text = "Dear Asha Rao, write to asha.rao@corp.com or call 555-123-4567; again asha.rao@corp.com."
    docs = pipeline.with_entities(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), as_of=F.lit(AS_OF))
    done = redact.redact(policy.approved(docs, jobs.default_policy(), as_of=F.lit(AS_OF))).orderBy("doc_id").collect()
    plan, new = done[0]["plan"], done[0]["redacted"]
    fakes = {p["original"]: p["replacement"] for p in plan}
    assert done[1]["redacted"] is None and "REDACTED" not in new and "asha.rao@corp.com" not in new and "Asha Rao" not in new and "555-123-4567" not in new
    person = fakes["Asha Rao"]
    assert fakes["asha.rao@corp.com"].startswith(person.lower().replace(" ", ".")) and new.count(fakes["asha.rao@corp.com"]) == 2
    ids = {r["text"]: r["entity_id"] for r in pipeline.detect_pii(docs.select("doc_id", "text"), as_of=F.lit(AS_OF)).collect()}
    at = datetime.datetime(2024, 1, 1)
    said = [(ids["Asha Rao"], "reject", None, at), (ids["555-123-4567"], "retype", "ssn", at), (ids["asha.rao@corp.com"], "accept", None, at)]
    for names in (False, True):
        reviews = spark.createDataFrame(said, "entity_id string, decision string, new_pii_type string, reviewed_at timestamp")
        reviews = reviews.withColumn("doc_id", F.lit(1).cast("long")) if names else reviews
        out = redact.redact(policy.approved(docs, {}, 0.99, F.lit(AS_OF), reviews)).where("doc_id = 1").first()["redacted"]
        assert out == "Dear Asha Rao, write to [REDACTED-EMAIL] or call [REDACTED-SSN]; again asha.rao@corp.com."


def test_needles_are_taken_as_they_are(spark):
    docs = spark.createDataFrame([(1, r"a\Eb. a.b x\Ey")], "doc_id long, text string")
    got = sorted((r["start"], r["needle"]) for r in jobs.dictionary_matches(docs, spark.createDataFrame([(1, r"a\Eb"), (1, "a.b")], "doc_id long, needle string")).collect())
    assert got == [(0, r"a\Eb"), (6, "a.b")]


def test_errors_have_codes():
    from tessera import errors

    kinds = [errors.NotFound, errors.ValidationFailed, errors.UnsupportedFormat, errors.FileTooLarge, errors.InvalidJobState, errors.StorageFailed, errors.DetectorUnavailable]
    assert len({k.code for k in kinds}) == 7 and all(issubclass(k, errors.TesseraError) for k in kinds)


def test_reports_of_many_lines_have_pages():
    body = sinks.minimal_pdf("\n".join(f"line {k}" for k in range(200)))
    assert b"/Count 3" in body and b"(line 199) Tj" in body

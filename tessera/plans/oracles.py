"""For each query the SQL that says the same to DuckDB, written from the operators' meaning.

DuckDB's regular expressions have no look-around. Where a pattern needs a neighbour to be no digit, every
other character is doubled first, so that a match can take one of a pair and leave the other.
"""

from __future__ import annotations

from tessera.plans.fixtures import cte

# The patterns of the formats, as DuckDB reads them.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
IPV6 = r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"
CARD2 = "(?:[0-9](?:  |--)?){13,19}"
PHONE2 = r"(?:(?:\+\+)?1(?:[-.\s][-.\s])?)?(?:\(\()?[0-9]{3}(?:\)\))?(?:[-.\s][-.\s])?[0-9]{3}(?:[-.\s][-.\s])?[0-9]{4}"
SUM = "COALESCE(list_sum(list_transform({0}, lambda z: length(z))), 0)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def places(table: str, key: str, text: str, pattern: str) -> str:
    """``key, value, start, "end"`` of all matches: lengths of pieces and matches before each give its place."""
    return f"""SELECT {key}, m[i] AS value, ({SUM.format('g[1:i]')} + {SUM.format('m[1:i-1]')})::BIGINT AS start, ({SUM.format('g[1:i]')} + {SUM.format('m[1:i]')})::BIGINT AS "end"
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, {_q(pattern)}, 0) AS m, string_split_regex({text}, {_q(pattern)}) AS g FROM {table} WHERE regexp_matches({text}, {_q(pattern)})))"""


def places2(table: str, key: str, text: str, core: str) -> str:
    """The same for a pattern over the doubled text that may not stand beside a digit."""
    whole = _q(f"(?:^|[^0-9])({core})(?:$|[^0-9])")
    doubled = rf"regexp_replace({text}, '([^0-9])', '\1\1', 'g')"
    at = f"({SUM.format('g[1:i]')} + {SUM.format('m[1:i-1]')} + instr(m[i], v[i]) - 1)"
    return f"""SELECT {key}, value, start, start + length(value) AS "end" FROM (
SELECT {key}, regexp_replace(v[i], '([^0-9])[^0-9]', '\\1', 'g') AS value, (digits + (pos - digits) // 2)::BIGINT AS start FROM (
SELECT *, length(regexp_replace(d[1:pos], '[^0-9]', '', 'g')) AS digits FROM (
SELECT *, {at}::BIGINT AS pos FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
SELECT {key}, d, regexp_extract_all(d, {whole}, 0) AS m, regexp_extract_all(d, {whole}, 1) AS v, string_split_regex(d, {whole}) AS g FROM (SELECT {key}, {doubled} AS d FROM {table}) WHERE regexp_matches(d, {whole}))))))"""


def luhn(value: str) -> str:
    """Luhn's checksum over the digits of ``value``."""
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    d = f"CAST(reverse({digits})[i:i] AS INTEGER)"
    return f"(length({digits}) >= 12 AND list_sum([CASE WHEN i % 2 = 1 THEN {d} WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END FOR i IN range(1, length({digits}) + 1)]) % 10 = 0)"


def good_card(value: str) -> str:
    return f"(length(regexp_replace({value}, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND {luhn(value)})"


def finds(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """All finds of the four held kinds, in the order of detection within a document."""
    card, phone, email, ip = places2(table, key, text, CARD2), places2(table, key, text, PHONE2), places(table, key, text, EMAIL), places(table, key, text, IPV4)
    return f"""SELECT {key}, type, value, start, "end", confidence, row_number() OVER (PARTITION BY {key} ORDER BY k, start) - 1 AS ordinal FROM (
SELECT *, 'credit_card' AS type, 0.9::DOUBLE AS confidence, 1 AS k FROM ({card}) WHERE {good_card('value')}
UNION ALL SELECT *, 'phone', 0.85, 2 FROM ({phone}) UNION ALL SELECT *, 'email', 0.97, 3 FROM ({email}) UNION ALL SELECT *, 'ip_address', 0.83, 4 FROM ({ip}))"""


def merge(source: str, key: str, columns: str = "") -> str:
    """Greedy choice by confidence, start, order, with eviction by deterministic sources, as a list fold."""
    clash = '(k.start < e[1]."end" AND e[1].start < k."end")'
    inside = '(k.type <> e[1].type AND e[1].start <= k.start AND k."end" <= e[1]."end")'
    return f"""SELECT {key}, unnest(kept) AS e FROM (
SELECT {key}, list_reduce(list_transform(list(struct_pack(ordinal := ordinal, type := type, value := value, start := start, "end" := "end", confidence := confidence, source := source) ORDER BY confidence DESC, start, ordinal), lambda x: [x]),
lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: {clash})) = 0 THEN list_concat(acc, e)
WHEN e[1].source IN ('regex_detector', 'date_detector') AND len(list_filter(acc, lambda k: {clash} AND NOT {inside})) = 0 THEN list_concat(list_filter(acc, lambda k: NOT {clash}), e)
ELSE acc END) AS kept FROM ({source}) GROUP BY {key})"""


TRIM = "[ \\t\\n\\r.,;:!?()\\[\\]{}\"''‘’“”]"


def trimmed(source: str, key: str) -> str:
    """Spans without the punctuation and blanks at their ends."""
    rest = f"regexp_replace(value, '^{TRIM}+', '')"
    kept = f"regexp_replace({rest}, '{TRIM}+$', '')"
    return f"""SELECT {key}, type, CASE WHEN {rest} = '' THEN value ELSE {kept} END AS value, CASE WHEN {rest} = '' THEN start ELSE start + length(value) - length({rest}) END AS start,
CASE WHEN {rest} = '' THEN "end" ELSE "end" - length({rest}) + length({kept}) END AS "end", round(confidence, 4) AS confidence FROM ({source})"""


def resolved(source: str, key: str = "doc_id") -> str:
    merged = merge(f"SELECT *, 'regex_detector' AS source FROM ({source})", key)
    return trimmed(f'SELECT {key}, e.type AS type, e.value AS value, e.start AS start, e."end" AS "end", e.confidence AS confidence FROM ({merged})', key)


def planned(policy: str = "", entities: str | None = None) -> str:
    """Approved, word-safe spans with their replacement; resolved spans never overlap."""
    entities = entities or resolved(finds())
    generalized = "CASE WHEN type = 'phone' THEN concat('[PHONE ENDING ', right(regexp_replace(value, '[^0-9]', '', 'g'), 4), ']') WHEN type = 'ip_address' THEN concat(split_part(value, '.', 1), '.', split_part(value, '.', 2), '.x.x') END"
    new = f"CASE WHEN type IN ({policy}) THEN {generalized} ELSE concat('[REDACTED-', upper(type), ']') END" if policy else "concat('[REDACTED-', upper(type), ']')"
    word = r"[\p{L}\p{N}_]"
    return f"""SELECT *, {new} AS own, regexp_replace(trim(regexp_replace(value, '\\s+', ' ', 'g')), '^ | $', '', 'g') AS original,
'det_' || left(sha256(concat_ws('|', doc_id, type, start, "end", 'regex_detector')), 32) AS entity_id
FROM ({entities}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)
WHERE confidence >= 0.75 AND NOT regexp_matches(CASE WHEN start > 0 THEN text[start:start] ELSE '' END, '{word}') AND NOT regexp_matches(text["end" + 1:"end" + 1], '{word}')"""


def with_first(source: str) -> str:
    """The first replacement of a value of a type holds in its document."""
    return f"SELECT *, first_value(own) OVER (PARTITION BY doc_id, type, original ORDER BY start) AS replacement FROM ({source})"


def rewritten(policy: str = "", entities: str | None = None) -> str:
    """The redacted text of every document with a replacement: pieces between spans and replacements."""
    return f"""SELECT doc_id, string_agg(text[prev + 1:start] || replacement, '' ORDER BY start) || any_value(text)[max("end") + 1:] AS redacted FROM (
SELECT *, COALESCE(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM ({with_first(planned(policy, entities))})) GROUP BY doc_id"""


#: What reviews make of the found spans: phones are rejected, addresses of machines become SSNs.
RETYPED = f"""SELECT doc_id, CASE WHEN type = 'ip_address' THEN 'ssn' ELSE type END AS type, value, start, "end", confidence FROM ({resolved(finds())}) WHERE type <> 'phone'"""
# Words around a date that make it a date of birth.
BIRTH = ("date of birth", "dob", "born", "birth date", "birthdate", "birthday", "b-day")


def metrics(source: str, label: str = "label") -> str:
    div = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
    p, r = div("tp", "tp + fp"), div("tp", "tp + fn")
    return f"""SELECT {label}, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round({p}, 6) AS "precision", round({r}, 6) AS recall, round({div('tp', 'tp + fp + fn')}, 6) AS entity_accuracy, (tp + fn)::BIGINT AS support,
round({div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM ({source})"""


# Predictions claim one after another: a recursive walk over each document's predictions in order.
def _walk(keys: str, best: bool) -> str:
    order = 'least(p."end", e."end") - greatest(p.start, e.start) DESC, e.ordinal' if best else "e.ordinal"
    join = " AND ".join(f"p.{k} = e.{k}" for k in keys.split(", "))
    mine = " AND ".join(f"q.{k} = w.{k}" for k in keys.split(", "))
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ordinal) AS n FROM predicted),
walk AS (SELECT {keys}, 0::BIGINT AS n, []::INTEGER[] AS claimed, NULL::INTEGER AS got FROM predicted GROUP BY {keys}
UNION ALL SELECT {", ".join("w." + k for k in keys.split(", "))}, q.n, CASE WHEN c.o IS NULL THEN w.claimed ELSE list_append(w.claimed, c.o) END, c.o
FROM walk w JOIN numbered q ON {mine} AND q.n = w.n + 1
LEFT JOIN LATERAL (SELECT e.ordinal AS o FROM expected e, (SELECT q.*) p WHERE {join} AND p.start < e."end" AND e.start < p."end" AND NOT list_contains(w.claimed, e.ordinal) ORDER BY {order} LIMIT 1) c ON TRUE)"""


OVERLAP_MATCHES = f"""{cte('expected', 'predicted')}, {_walk('document_id', True)},
pairs AS (SELECT p.document_id, p.pii_type AS pt, p.start AS ps, p."end" AS pe, w.got FROM numbered p JOIN walk w ON p.document_id = w.document_id AND p.n = w.n),
matches AS (SELECT p.document_id, CASE WHEN e.pii_type IS NULL THEN 'false_positive' WHEN e.pii_type = p.pt THEN 'true_positive' ELSE 'type_mismatch' END AS outcome, e.pii_type AS expected_type, e.start::BIGINT AS expected_start, e."end"::BIGINT AS expected_end, p.pt AS predicted_type, p.ps::BIGINT AS predicted_start, p.pe::BIGINT AS predicted_end
FROM pairs p LEFT JOIN expected e ON e.document_id = p.document_id AND e.ordinal = p.got
UNION ALL SELECT e.document_id, 'false_negative', e.pii_type, e.start, e."end", NULL, NULL, NULL FROM expected e WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.document_id = e.document_id AND p.got = e.ordinal))"""
PER_TYPE = """SELECT pii_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
SELECT expected_type AS pii_type, 1 AS tp, 0 AS fp, 0 AS fn FROM matches WHERE outcome = 'true_positive'
UNION ALL SELECT expected_type, 0, 0, 1 FROM matches WHERE outcome <> 'true_positive' AND expected_type IS NOT NULL
UNION ALL SELECT predicted_type, 0, 1, 0 FROM matches WHERE outcome <> 'true_positive' AND predicted_type IS NOT NULL) GROUP BY pii_type"""
ALL_LABELS = f"SELECT pii_type AS label, tp, fp, fn FROM ({PER_TYPE}) UNION ALL SELECT 'overall', sum(tp), sum(fp), sum(fn) FROM ({PER_TYPE})"


# Longest common subsequence by a recursive walk over the cells of the table, one row at a time.
def _indel(pairs: str) -> str:
    """``id, ratio`` for ``id, a, b``: the row of lengths for a's first i letters becomes the next one."""
    return f"""pr AS ({pairs}),
lcs AS (SELECT id, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda z: 0::BIGINT) AS r FROM pr
UNION ALL SELECT id, a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::BIGINT]), lambda acc, j: list_append(acc, CASE WHEN a[i + 1:i + 1] = b[j[1]:j[1]] THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], acc[len(acc)]) END), [0::BIGINT]) FROM lcs WHERE i < length(a)),
ind AS (SELECT id, a, b, CASE WHEN a = b THEN 1.0 ELSE 2.0 * r[len(r)] / (length(a) + length(b)) END::DOUBLE AS ratio FROM lcs WHERE i = length(a))"""


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda z: z <> '')), ' ')"


SUFFIXES = "['inc','incorporated','corp','corporation','llc','l.l.c.','ltd','limited','co','company','group','holdings','technologies','industries','enterprises','partners','llp','plc']"
TAIL = "lower(list_filter(string_split_regex(regexp_replace(name, '^[.,]+|[.,]+$', '', 'g'), '\\s+'), lambda z: z <> '')[-1])"
BOOSTS = f"""{cte('names')}, {_indel(f"SELECT case_id * 100 + k AS id, {TAIL} AS a, {SUFFIXES}[k] AS b FROM names, range(1, 19) t(k)")},
boosts AS (SELECT id // 100 AS case_id, CASE WHEN max(ratio) >= 0.9 THEN max(ratio) ELSE 0.0 END AS boost FROM ind GROUP BY 1)"""
GUARD = """(trim(name) <> '' AND ((trim(name) = upper(trim(name)) AND trim(name) <> lower(trim(name)) AND length(trim(name)) <= 5 AND NOT contains(trim(name), ' '))
OR regexp_full_match(trim(name), '[0-9]+') OR (regexp_full_match(trim(name), '[ivxlcdm]+') AND length(trim(name)) <= 6) OR NOT regexp_matches(name, '\\p{L}')
OR (NOT contains(trim(name), ' ') AND regexp_matches(trim(name), '^[A-Z]') AND lower(trim(name)) IN ('company','board','offer','group','circular','schedule','fiscals','fiscal','regulations','regulation','rules','act','committee','management'))))"""

LATEST = """latest AS (SELECT entity_id, decision, CASE WHEN decision = 'retype' THEN new_pii_type END AS new_type FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY reviewed_at DESC) AS n FROM reviews) WHERE n = 1),
reviewed AS (SELECT f.*, CASE WHEN s.status IN ('needs_review', 'detecting') THEN l.decision END AS decision, CASE WHEN s.status IN ('needs_review', 'detecting') THEN l.new_type END AS new_type FROM found f LEFT JOIN latest l USING (entity_id) LEFT JOIN states s USING (doc_id)),
told AS (SELECT *, decision IS NOT NULL AS verified, CASE WHEN decision = 'retype' AND new_type IS NOT NULL THEN new_type ELSE type END AS effective_type FROM reviewed)"""
REVIEWED = f"{cte('found', 'reviews', 'states')}, {LATEST}"

STREET = "Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Ter|Circle|Cir|Highway|Hwy"
AGE = "(floor((2024 - year(d) - CASE WHEN strftime(d, '%m%d') > '0601' THEN 1 ELSE 0 END) / 10) * 10)::INTEGER"
WORDS_PLACED = f"""{cte('words')}, s AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN lag(page) OVER w <> page OR lag(block) OVER w <> block THEN chr(10) || chr(10) WHEN lag(line) OVER w <> line THEN chr(10) ELSE ' ' END AS sep FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY page, block, line, word)),
placed AS (SELECT *, sum(length(sep) + length(text)) OVER (PARTITION BY doc_id ORDER BY page, block, line, word) - length(text) AS start FROM s)"""
TURNS = "SELECT conv_id, turn, text, COALESCE(sum(length(COALESCE(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset FROM conversations"
MAILS = places("documents", "doc_id", "text", EMAIL)
PLAN_ROWS = f"""{cte('plans')}, repl AS (SELECT *, CASE strategy WHEN 'generalize' THEN CASE type WHEN 'phone' THEN concat('[PHONE ENDING ', right(regexp_replace(text, '[^0-9]', '', 'g'), 4), ']') ELSE concat(split_part(text, '.', 1), '.', split_part(text, '.', 2), '.x.x') END ELSE concat('[REDACTED-', upper(type), ']') END AS own FROM plans),
safe AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY start, "end" DESC, entity_id) AS n FROM repl WHERE "end" <= length(body) AND NOT regexp_matches(CASE WHEN start > 0 THEN body[start:start] ELSE '' END, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(body["end" + 1:"end" + 1], '[\\p{{L}}\\p{{N}}_]')),
pick AS (SELECT case_id, n, "end" AS upto FROM safe WHERE n = 1 UNION ALL SELECT * FROM (SELECT p.case_id, min(s.n) AS n, arg_min(s."end", s.n) AS upto FROM pick p JOIN safe s ON s.case_id = p.case_id AND s.n > p.n AND s.start >= p.upto GROUP BY p.case_id, p.n)),
chosen AS (SELECT s.* FROM safe s JOIN pick p USING (case_id, n))"""
CHANGES = """changed AS (SELECT job_id, ts, status, lag(status) OVER w AS previous, COALESCE(max(CASE WHEN status IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM {0} WINDOW w AS (PARTITION BY job_id ORDER BY ts, status))"""


def _texts(pattern: str, confidence: str) -> str:
    return f'{cte("texts")} SELECT *, {confidence}::DOUBLE AS confidence FROM ({places("texts", "case_id", "text", pattern)})'


STREET_WORDS = rf"\b[0-9]{{1,6}}\s+[A-Z][A-Za-z]*(?:\s[A-Z][A-Za-z]*){{0,3}}\s(?:(?:{STREET})\b\.?)(?:,\s*[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)*)?(?:,?\s*[A-Z]{{2}})?(?:\s+[0-9]{{4,6}}(?:-[0-9]{{4}})?)?"
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATES = (
    (r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b", ("%m/%d/%Y",)),
    (r"\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\b", ("%m-%d-%Y",)),
    (r"\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b", ("%Y-%m-%d",)),
    (rf"(?i:\b(?:{MONTH})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}\b)", ("%B %d, %Y", "%b %d, %Y", "%b %d %Y")),
)
LABEL = r"\b(?:(?:Applicant(?:\s+Name)?|Customer\s+Name|Employee\s+Name|Candidate\s+Name|Contact(?:\s+Person|\s+Name)?|Authorized\s+Signatory|Signed\s+by|Attention|Attn|Dear)\s*:?\s*|(?:Promoter|Director|Signatory|Witness|Guarantor)\s*:\s*)"
NAMED = r"[A-Z][a-zA-Z'-]+(?:[ \t]+[A-Z][a-zA-Z'-]+){1,3}"
ROLES = "sir|madam|team|services?|department|support|customers?|staff|committee|board|management|all|everyone|members?|users?|clients?|valued|dear|hiring|recruiting|recruitment"


def _dates(pattern: str, layouts: tuple[str, ...]) -> str:
    """Places of one layout's dates from 1904 to 2024; white space in a match counts as one blank."""
    one = "regexp_replace(value, '\\s+', ' ', 'g')"
    day = f"COALESCE({', '.join(f"try_strptime({one}, '{x}')" for x in layouts)})"
    return f'SELECT doc_id, value, start, "end" FROM ({places("documents", "doc_id", "text", pattern)}) WHERE year({day}) BETWEEN 1904 AND 2024'


ORACLE_SQL = {
    # whole documents, with borders and classes in ASCII as DuckDB has them
    "detect_ssn_documents": places("documents", "doc_id", "text", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    "detect_ipv6_documents": places("documents", "doc_id", "text", IPV6),
    "detect_address_documents": places("documents", "doc_id", "text", STREET_WORDS),
    "detect_dob_documents": " UNION ALL ".join(_dates(*x) for x in DATES),
    "detect_labeled_name_documents": f"""SELECT doc_id, name AS value, ("end" - length(name))::BIGINT AS start, "end" FROM (
SELECT doc_id, "end", regexp_extract(value, {_q(LABEL + "(" + NAMED + ")")}, 1) AS name FROM ({places("documents", "doc_id", "text", LABEL + NAMED)})) WHERE NOT regexp_matches(lower(name), '(?:^|\\s)(?:{ROLES})(?:\\s|$)')""",
    # inline texts: the neighbours in these cases make word borders stand in for look-around
    "detect_ssn": _texts(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "0.97"),
    "detect_ipv6": _texts(IPV6, "0.83"),
    "detect_address": _texts(rf"\b[0-9]{{1,6}}\s+[A-Z][A-Za-z]*(?:\s[A-Z][A-Za-z]*){{0,3}}\s(?:(?:{STREET})\b\.?)(?:,\s*[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)*)?(?:,?\s*[A-Z]{{2}})?(?:\s+[0-9]{{4,6}}(?:-[0-9]{{4}})?)?", "0.88"),
    "detect_dob": f"""{cte("texts")}, d AS ({places("texts", "case_id", "text", r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},\s+[0-9]{4}\b|\bMay\s+[0-9]{1,2}\s+[0-9]{4}\b")}),
p AS (SELECT d.*, COALESCE(try_strptime(value, '%m/%d/%Y'), try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%B %d, %Y'), try_strptime(value, '%b %d %Y')) AS day, lower(t.text[greatest(start - 40, 0) + 1:"end" + 40]) AS w FROM d JOIN texts t USING (case_id))
SELECT case_id, value, start, "end", CASE WHEN regexp_matches(w, 'date of birth|dob|born|birth date|birthdate|birthday|b-day') THEN 0.92 ELSE 0.4 END::DOUBLE AS confidence FROM p WHERE day IS NOT NULL AND year(day) BETWEEN 1904 AND 2024""",
    "detect_labeled_name": rf"""{cte("texts")}, f AS ({places("texts", "case_id", "text", r"\b(?:(?:Applicant(?:\s+Name)?|Contact(?:\s+Person|\s+Name)?|Authorized\s+Signatory|Signed\s+by|Attention|Attn|Dear)\s*:?\s*|(?:Promoter|Director|Signatory|Witness|Guarantor)\s*:\s*)[A-Z][a-zA-Z'-]+(?:[ \t]+[A-Z][a-zA-Z'-]+){1,3}")}),
n AS (SELECT case_id, regexp_extract(value, '(?:(?:Applicant(?:\s+Name)?|Attn|Dear)\s*:?\s*|(?:Director)\s*:\s*)(.*)', 1) AS value, "end" FROM f)
SELECT case_id, value, ("end" - length(value))::BIGINT AS start, "end", 0.82::DOUBLE AS confidence FROM n WHERE NOT regexp_matches(lower(value), '\b(sir|madam|team|services?|department|support|customers?|staff|committee|board|management|all|everyone|members?|users?|clients?|valued|dear|hiring|recruiting|recruitment)\b')""",
    "detect_email": MAILS,
    "detect_email_pages": places("pages", "page_id", "html", EMAIL),
    "detect_phone": places2("documents", "doc_id", "text", PHONE2),
    "detect_ip": places("documents", "doc_id", "text", IPV4),
    "detect_credit_card": f"SELECT * FROM ({places2('documents', 'doc_id', 'text', CARD2)}) WHERE {good_card('value')}",
    "luhn_filter": f"SELECT doc_id, regexp_replace(value, '[ -]', '', 'g') AS digits, {luhn('value')} AS valid FROM ({places2('documents', 'doc_id', 'text', CARD2)})",
    "ipv4_valid": f"SELECT doc_id, value AS quad, regexp_full_match(value, '{OCTET}(\\.{OCTET}){{3}}') AS valid FROM ({places('documents', 'doc_id', 'text', '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')})",
    "context_window": f'SELECT doc_id, start, lower(text[greatest(start - 40, 0) + 1:"end" + 40]) AS w FROM ({MAILS}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)',
    "preceding_word": f"SELECT doc_id, start, regexp_extract(text[greatest(start - 20, 0) + 1:start], '([A-Za-z]+)\\s*$', 1) AS word FROM ({MAILS}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)",
    "word_safe": f"""SELECT doc_id, count(*) AS n, count(*) FILTER (NOT regexp_matches(CASE WHEN start > 0 THEN text[start:start] ELSE '' END, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(text["end" + 1:"end" + 1], '[\\p{{L}}\\p{{N}}_]')) AS n_safe
FROM ({places('documents', 'doc_id', 'text', '(?:the|of)')}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id) GROUP BY doc_id""",
    "indel_ratio": f"{cte('pairs')}, {_indel('SELECT case_id AS id, a, b FROM pairs')} SELECT id AS case_id, round(ratio, 6) AS ratio FROM ind",
    "text_similarity": f"{cte('pairs')}, {_indel(f'SELECT case_id AS id, {sorted_words('a')} AS a, {sorted_words('b')} AS b FROM pairs')} SELECT p.case_id, CASE WHEN p.a = '' OR p.b = '' THEN 0.0 ELSE round(ratio, 6) END AS similarity FROM pairs p JOIN ind ON id = case_id",
    "company_suffix_boost": f"{BOOSTS} SELECT case_id, round(boost, 6) AS boost FROM boosts",
    "acronym_guard": f"{cte('names')} SELECT case_id, {GUARD} AS guarded FROM names",
    "company_confidence": f"""{BOOSTS} SELECT case_id, round(CASE WHEN {GUARD} THEN base * 0.3 ELSE least(0.97, CASE WHEN boost = 0 AND lower(before) IN ('the','our','this','such','any','every','each','said') THEN base * 0.4 ELSE base END + boost * 0.15) END, 6) AS confidence FROM names JOIN boosts USING (case_id)""",
    "name_tokens": "SELECT c_custkey, array_to_string(t, ' ') AS key, array_to_string(t[1:2], '.') AS slug FROM (SELECT c_custkey, list_filter(list_transform(string_split_regex(replace(lower(c_name || ' O''Neil-Smith J.R.'), '.', ' '), '\\s+'), lambda z: regexp_replace(z, '[^a-z0-9]', '', 'g')), lambda z: z <> '') AS t FROM customer)",
    "dob_format_like": f"{cte('vals')} SELECT case_id, CASE WHEN contains(value, '-') AND length(split_part(value, '-', 1)) = 4 THEN '1990-02-03' WHEN contains(value, '-') THEN '02-03-1990' WHEN contains(value, '/') THEN '02/03/1990' WHEN contains(value, ',') THEN 'February 03, 1990' ELSE 'February 03 1990' END AS shown FROM vals WHERE kind = 'dob'",
    "entity_id": f"SELECT doc_id, 'det_' || left(sha256(concat_ws('|', doc_id, type, start, \"end\", 'regex_detector')), 32) AS entity_id FROM ({resolved(finds())}) WHERE type = 'email'",
    "display_mask": "SELECT c_custkey, CASE WHEN length(v) <= 2 THEN '••' ELSE left(v, 1) || repeat('•', least(length(v) - 2, 8)) || right(v, 1) END AS shown FROM (SELECT c_custkey, left(c_name, c_custkey % 14) AS v FROM customer)",
    "confidence_tier": f"{cte('found')} SELECT entity_id, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.75 THEN 'medium' ELSE 'low' END AS tier FROM found",
    "detect_all": f"SELECT doc_id, type, value, start, \"end\", confidence, 'regex_detector' AS source FROM ({finds()})",
    "detect_filtered": trimmed(f"SELECT *, 'email' AS type, 0.97::DOUBLE AS confidence FROM ({MAILS})", "doc_id"),
    "detect_distinct": trimmed(f"SELECT *, 'email' AS type, 0.97::DOUBLE AS confidence FROM ({MAILS})", "doc_id"),
    "detect_pii": resolved(finds()),
    "detect_adapter_rules": f"""{cte('texts')} SELECT case_id, 'address' AS type, value, start, "end", 0.6::DOUBLE AS confidence FROM ({places('(SELECT * FROM texts WHERE case_id IN (3, 6, 10))', 'case_id', 'text', 'Ashford')})
UNION ALL SELECT case_id, 'dob', value, start, "end", 0.75 FROM ({places('(SELECT * FROM texts WHERE case_id IN (3, 6, 10))', 'case_id', 'text', '[0-9]{2}/[0-9]{2}/[0-9]{4}')}) JOIN texts USING (case_id) WHERE contains(lower(text[greatest(start - 40, 0) + 1:"end" + 40]), 'date of birth')
UNION ALL SELECT case_id, 'company', value, start, "end", 0.85 FROM ({places('(SELECT * FROM texts WHERE case_id IN (3, 6, 10))', 'case_id', 'text', 'Promoter Buying')})""",
    "pii_catalog": """SELECT * FROM (VALUES ('person', 'spacy_ner,presidio_detector,labeled_field_detector'), ('company', 'spacy_ner,presidio_detector'), ('dob', 'date_detector,presidio_detector'), ('ssn', 'regex_detector,presidio_detector'), ('credit_card', 'regex_detector,presidio_detector'),
('phone', 'regex_detector,presidio_detector'), ('email', 'regex_detector,presidio_detector'), ('ip_address', 'regex_detector,presidio_detector'), ('address', 'regex_detector,presidio_detector')) t(pii_type, detectors)""",
    "text_chunks": """WITH RECURSIVE w AS (SELECT doc_id, text, length(text)::BIGINT AS n, 0::BIGINT AS k, 0::BIGINT AS start, NULL::BIGINT AS prev_end FROM documents),
c AS (SELECT doc_id, text, n, k, start, CASE WHEN start + 4000 >= n THEN n ELSE start + CASE WHEN p > 1 THEN p - 1 WHEN l > 1 THEN l - 1 ELSE 4000 END END AS e FROM (SELECT *, length(win) - length(regexp_extract(win, '(?s)^.*(\\n\\n.*)$', 1)) + 1 AS p0, CASE WHEN contains(win, chr(10) || chr(10)) THEN length(regexp_extract(win, '(?s)^(.*)\\n\\n', 1)) + 1 ELSE 0 END AS p, CASE WHEN contains(win, chr(10)) THEN length(regexp_extract(win, '(?s)^(.*)\\n', 1)) + 1 ELSE 0 END AS l FROM (SELECT *, text[start + 1:start + 4000] AS win FROM w))
UNION ALL SELECT doc_id, text, n, k, start, CASE WHEN start + 4000 >= n THEN n ELSE start + CASE WHEN p > 1 THEN p - 1 WHEN l > 1 THEN l - 1 ELSE 4000 END END FROM (SELECT *, CASE WHEN contains(win, chr(10) || chr(10)) THEN length(regexp_extract(win, '(?s)^(.*)\\n\\n', 1)) + 1 ELSE 0 END AS p, CASE WHEN contains(win, chr(10)) THEN length(regexp_extract(win, '(?s)^(.*)\\n', 1)) + 1 ELSE 0 END AS l FROM (SELECT doc_id, text, n, k + 1 AS k, greatest(start + 1, e - 100) AS start, text[greatest(start + 1, e - 100) + 1:greatest(start + 1, e - 100) + 4000] AS win FROM c WHERE e < n AND n > 4000)))
SELECT doc_id, k, start, (e - start)::BIGINT AS n FROM c""",
    "corroborate": f"""{cte('entities')} SELECT case_id, ordinal::BIGINT AS ordinal, type, start::BIGINT AS start, "end"::BIGINT AS "end", round(CASE WHEN confidence < 0.99 AND EXISTS (SELECT 1 FROM entities o WHERE o.case_id = e.case_id AND o.source <> e.source AND o.type = e.type AND o.start < e."end" AND e.start < o."end"
AND (o.text = e.text OR contains(o.text, e.text) AND 2.0 * length(e.text) / (length(e.text) + length(o.text)) >= 0.85 OR contains(e.text, o.text) AND 2.0 * length(o.text) / (length(e.text) + length(o.text)) >= 0.85)) THEN least(0.99, confidence + 0.05) ELSE confidence END, 6) AS confidence FROM entities e""",
    "merge_overlaps": f"""{cte('entities')} SELECT case_id, e.ordinal::BIGINT AS ordinal, e.type AS type, e.start::BIGINT AS start, e."end"::BIGINT AS "end", round(e.confidence, 6) AS confidence FROM ({merge('SELECT case_id, ordinal, type, text AS value, start, "end", confidence, source FROM entities', 'case_id')})""",
    "normalize_spans": f"""{cte('trims')} SELECT case_id, start::BIGINT AS start, "end"::BIGINT AS "end", value, confidence FROM ({trimmed('SELECT case_id, text AS value, start, "end", confidence, 1 AS type FROM trims', 'case_id')})""",
    "extend_company_suffix": rf"""{cte('companies')}, a AS (SELECT *, length(regexp_extract(text["end" + 1:"end" + 24], '(?i)^([\s,]*(?:Pvt\.?|Private)?[\s,]*(?:Ltd\b\.?|Limited\b|Inc\b\.?|LLC\b|LLP\b|Corp\b\.?|Corporation\b|Co\b\.?|Company\b|GmbH\b|PLC\b))', 1)) AS x FROM companies),
b AS (SELECT *, length(regexp_extract(text["end" + x + 1:"end" + x + 24], '(?i)^([\s,]*(?:Pvt\.?|Private)?[\s,]*(?:Ltd\b\.?|Limited\b|Inc\b\.?|LLC\b|LLP\b|Corp\b\.?|Corporation\b|Co\b\.?|Company\b|GmbH\b|PLC\b))', 1)) AS y FROM a)
SELECT case_id, start::BIGINT AS start, ("end" + x + y)::BIGINT AS "end", text[start + 1:"end" + x + y] AS value FROM b""",
    "apply_reviews": f"{REVIEWED} SELECT entity_id, verified, decision, new_type, effective_type FROM told",
    "effective_type": f"{REVIEWED} SELECT entity_id, effective_type FROM told",
    "approval_filter": f"{REVIEWED} SELECT entity_id, effective_type FROM told WHERE CASE WHEN decision IS NULL THEN confidence >= 0.75 ELSE decision <> 'reject' END",
    "needs_review": f"{REVIEWED} SELECT entity_id FROM told WHERE decision IS NULL AND confidence < 0.75",
    "visible_highlights": f"{REVIEWED} SELECT entity_id, effective_type || ' · ' || round(confidence * 100)::INTEGER || '%' AS label FROM told WHERE decision IS DISTINCT FROM 'reject' AND confidence >= 0.75",
    "min_confidence_view": f"SELECT doc_id, count(*) AS total, count(*) FILTER (confidence >= 0.86) AS visible, count(*) FILTER (confidence < 0.86) AS hidden FROM ({resolved(finds())}) GROUP BY doc_id",
    "group_by_page": f"{REVIEWED} SELECT doc_id, doc_id AS page, count(*) AS n, min(start)::BIGINT AS first FROM told WHERE entity_id <> 'e4' GROUP BY doc_id",
    "dictionary_highlight": f"""WITH mails AS (SELECT DISTINCT doc_id, value FROM ({trimmed(f"SELECT *, 'email' AS type, 0.97::DOUBLE AS confidence FROM ({MAILS})", 'doc_id')})), hit AS (SELECT m.doc_id, m.value AS needle, start FROM mails m JOIN ({MAILS}) p ON p.doc_id = m.doc_id AND p.value = m.value),
the AS (SELECT doc_id, 'the' AS needle, start FROM ({places('documents', 'doc_id', 'text', 'the')}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM mails) AND NOT regexp_matches(CASE WHEN start > 0 THEN text[start:start] ELSE '' END, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(text["end" + 1:"end" + 1], '[\\p{{L}}\\p{{N}}_]'))
SELECT doc_id, needle, count(*) AS n, min(start)::BIGINT AS first FROM (SELECT * FROM hit UNION ALL SELECT * FROM the) GROUP BY doc_id, needle""",
    "redact_mask": f"SELECT doc_id, sha256(redacted) AS redacted_sha256, length(redacted)::BIGINT AS n FROM ({rewritten()})",
    "redact_text": f"SELECT doc_id, sha256(redacted) AS redacted_sha256 FROM ({rewritten("'phone', 'ip_address'")})",
    "redaction_counts": f"SELECT type AS pii_type, count(*) AS n FROM ({planned()}) GROUP BY 1",
    "redaction_rollup": f"SELECT CASE WHEN grouping(type) = 1 THEN 'total' ELSE type END AS pii_type, count(*) AS n FROM ({planned()}) GROUP BY ROLLUP (type)",
    "merged_counts": f"""WITH mail AS (SELECT doc_id AS id, value, start, "end", text FROM ({MAILS}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id) UNION ALL SELECT page_id, value, start, "end", html FROM ({places('pages', 'page_id', 'html', EMAIL)}) JOIN (SELECT page_id, html FROM pages) USING (page_id))
SELECT 'email' AS pii_type, count(*)::BIGINT AS n FROM mail WHERE NOT regexp_matches(CASE WHEN start > 0 THEN text[start:start] ELSE '' END, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(text["end" + 1:"end" + 1], '[\\p{{L}}\\p{{N}}_]')""",
    "text_report": f"""WITH c AS (SELECT type, count(*) AS n FROM ({planned()}) GROUP BY 1) SELECT row_number() OVER (ORDER BY part, type) AS line_no, line FROM (SELECT 0 AS part, type, rpad(type, 14, ' ') || ' ' || n AS line FROM c UNION ALL SELECT 1, 'total', rpad('total', 14, ' ') || ' ' || sum(n) FROM c)""",
    "replacement_map": f"SELECT DISTINCT doc_id, type AS pii_type, original, replacement FROM ({with_first(planned("'phone'"))})",
    "audit_log": f"SELECT doc_id, entity_id, type AS pii_type, start, \"end\", original, replacement, 'regex_detector' AS source, confidence FROM ({with_first(planned("'phone'"))})",
    "artifacts": f"SELECT doc_id, count(DISTINCT (type, original, replacement)) AS mapping_count, count(*) AS event_count, arg_min(original, (type, lower(original), original)) AS first_original, arg_min(replacement, start) AS first_replacement FROM ({with_first(planned())}) GROUP BY doc_id",
    "redact_generalize": f"""{cte('vals')}, p AS (SELECT *, COALESCE(try_strptime(value, '%m/%d/%Y'), try_strptime(value, '%m-%d-%Y'), try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%B %d, %Y')) AS d, regexp_replace(value, '[^0-9]', '', 'g') AS ds FROM vals)
SELECT case_id, CASE kind WHEN 'dob' THEN CASE WHEN d IS NULL THEN '[REDACTED-DOB]' ELSE '[AGE ' || {AGE} || '-' || ({AGE} + 9) || ']' END WHEN 'address' THEN CASE WHEN contains(value, ',') THEN '[REDACTED STREET], ' || regexp_replace(trim(value[instr(value, ',') + 1:]), '\\s*,\\s*', ', ', 'g') ELSE '[REDACTED-ADDRESS]' END
WHEN 'phone' THEN CASE WHEN length(ds) >= 4 THEN '[PHONE ENDING ' || right(ds, 4) || ']' ELSE '[REDACTED-PHONE]' END ELSE CASE WHEN kind = 'ip_address' AND contains(value, '.') THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2) || '.x.x' ELSE '[REDACTED-' || upper(kind) || ']' END END AS shown FROM p""",
    "strategy_join": f"{cte('vals')} SELECT case_id, COALESCE(s, 'mask') AS strategy FROM vals LEFT JOIN (VALUES ('dob', 'generalize'), ('phone', 'pseudonymize'), ('address', 'black_box')) m(k, s) ON k = kind",
    "plan_replacements": f'{PLAN_ROWS} SELECT case_id, entity_id, start::BIGINT AS start, "end"::BIGINT AS "end", text AS original, own AS replacement FROM chosen',
    "redact_black_box": f"""{PLAN_ROWS}, new AS (SELECT *, CASE WHEN strategy = 'black_box' THEN '[BLACK-BOX]' ELSE own END AS mapped, CASE WHEN strategy = 'black_box' THEN '' ELSE own END AS shown, COALESCE(lag("end") OVER (PARTITION BY case_id ORDER BY start), 0) AS prev FROM chosen)
SELECT c.case_id, COALESCE(r.redacted, c.body) AS redacted, COALESCE(r.mapped, '') AS mapped FROM (SELECT DISTINCT case_id, body FROM plans) c LEFT JOIN (SELECT case_id, string_agg(body[prev + 1:start] || shown, '' ORDER BY start) || any_value(body)[max("end") + 1:] AS redacted, string_agg(mapped, ',' ORDER BY start) AS mapped FROM new GROUP BY case_id) r USING (case_id)""",
    "box_plan": f"""{WORDS_PLACED}, named(doc_id, entity_id, s, e, replacement) AS (VALUES ('p', 'x', 0, 8, '[PERSON]'), ('p', 'y', 9, 13, '[CITY]'), ('p', 'z', 80, 90, '[NONE]'))
SELECT n.doc_id, n.entity_id, p.start::BIGINT AS word_start, p.start::DOUBLE - 2 AS "left", (p.start + length(p.text))::DOUBLE + 2 AS "right", CASE WHEN row_number() OVER (PARTITION BY n.entity_id ORDER BY p.start) = 1 THEN replacement ELSE '' END AS label FROM named n JOIN placed p ON p.doc_id = n.doc_id AND n.s < p.start + length(p.text) AND p.start < n.e""",
    "pseudonymize_phone": f"""WITH p AS (SELECT doc_id, value FROM ({trimmed(f"SELECT *, 'phone' AS type, 0.85::DOUBLE AS confidence FROM ({places2('documents', 'doc_id', 'text', PHONE2)})", 'doc_id')})),
n AS (SELECT *, ('0x' || left(sha256('head|' || value), 15))::BIGINT % 4 + 6 AS h, lpad((('0x' || left(sha256('tail|' || value), 15))::BIGINT % 1000000000)::VARCHAR, 9, '0') AS t FROM p)
SELECT doc_id, value, CASE WHEN starts_with(trim(value), '+') THEN '+91 ' ELSE '' END || left(h || t, 5) || ' ' || right(h || t, 5) AS fake FROM n""",
    "match_first_fit": f"""{cte('expected', 'predicted')}, {_walk('document_id, pii_type', False)}, hits AS (SELECT document_id, pii_type, count(got) AS tp FROM walk GROUP BY ALL),
e AS (SELECT document_id, pii_type, count(*) AS ne FROM expected GROUP BY ALL), p AS (SELECT document_id, pii_type, count(*) AS np FROM predicted GROUP BY ALL)
SELECT document_id, pii_type, COALESCE(tp, 0)::BIGINT AS tp, (COALESCE(np, 0) - COALESCE(tp, 0))::BIGINT AS fp, (COALESCE(ne, 0) - COALESCE(tp, 0))::BIGINT AS fn FROM e FULL JOIN p USING (document_id, pii_type) LEFT JOIN hits USING (document_id, pii_type)""",
    "match_best_overlap": f"{OVERLAP_MATCHES} SELECT * FROM matches",
    "eval_per_type": f"{OVERLAP_MATCHES} {PER_TYPE}",
    "eval_report": f"{OVERLAP_MATCHES} {metrics(ALL_LABELS)}",
    "eval_overall": f"{OVERLAP_MATCHES} SELECT * FROM ({metrics(ALL_LABELS)}) WHERE label = 'overall'",
    "metrics_from_counts": f"{cte('counted')} {metrics('counted')}",
    "label_metrics": metrics("SELECT 'long' AS label, count(*) FILTER (n_chars > 1500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1500 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 1500 AND quality = 1) AS fn FROM labels JOIN documents USING (doc_id)"),
    "confusion_matrix": f"""{OVERLAP_MATCHES}, l AS (SELECT expected_type AS l FROM matches WHERE expected_type IS NOT NULL UNION SELECT predicted_type FROM matches WHERE predicted_type IS NOT NULL UNION SELECT '__none__')
SELECT a.l AS actual, p.l AS predicted, count(m.outcome) AS n FROM l a CROSS JOIN l p LEFT JOIN matches m ON COALESCE(m.expected_type, '__none__') = a.l AND COALESCE(m.predicted_type, '__none__') = p.l GROUP BY ALL""",
    "classification_report": f"""{OVERLAP_MATCHES} SELECT label, printf('%.4f', "precision") AS "precision", printf('%.4f', recall) AS recall, printf('%.4f', f1) AS f1, printf('%.4f', entity_accuracy) AS entity_accuracy, support FROM ({metrics(ALL_LABELS)})""",
    "metrics_unpivot": f"""{OVERLAP_MATCHES}, r AS ({metrics(ALL_LABELS)}) SELECT label, 'precision' AS metric, "precision" AS value FROM r UNION ALL SELECT label, 'recall', recall FROM r UNION ALL SELECT label, 'f1', f1 FROM r""",
    "label_spans": f"""{cte('labelled')}, w AS (SELECT case_id, text, raw, occurrence, 0 AS k, instr(text, raw) AS pos FROM labelled UNION ALL SELECT case_id, text, raw, occurrence, k + 1, pos + instr(text[pos + 1:], raw) FROM w WHERE k < occurrence)
SELECT case_id, (pos - 1)::BIGINT AS start, (pos - 1 + length(raw))::BIGINT AS "end" FROM w WHERE k = occurrence""",
    "annotation_template": f"SELECT 'annotation-1' AS id, doc_id::VARCHAR AS document_id, 'email' AS pii_type, start, \"end\", value, 'accept' AS annotator_decision FROM ({trimmed(f"SELECT *, 'email' AS type, 0.97::DOUBLE AS confidence FROM ({MAILS})", 'doc_id')})",
    "section_slice": f"{cte('texts')} SELECT case_id, text[instr(text, 'birth'):instr(text, 'issued') + 5] AS part FROM texts WHERE case_id = 6",
    "block_offsets": f"SELECT conv_id, turn, char_offset FROM ({TURNS})",
    "flatten_blocks": "SELECT conv_id, sha256(string_agg(COALESCE(text, ''), '' ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id",
    "span_block_join": f"SELECT conv_id, turn FROM ({TURNS}) WHERE char_offset < 400 AND char_offset + length(text) > 100",
    "word_flatten": f'{WORDS_PLACED} SELECT doc_id, page, block, line, word, start::BIGINT AS start, (start + length(text))::BIGINT AS "end" FROM placed',
    "ocr_flatten": f"""{cte('ocr')}, k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM ocr WHERE trim(text) <> '' AND COALESCE(try_cast(conf AS DOUBLE), -1) >= 40)
SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before <> line THEN chr(10) ELSE ' ' END || text, '' ORDER BY i) AS text FROM k GROUP BY doc_id""",
    "load_entities": f"""{cte('jsons')}, x AS (SELECT unnest(from_json(CASE WHEN payload LIKE '[%' THEN payload ELSE json_extract(payload, '$.entities') END, '["JSON"]')) AS j FROM jsons)
SELECT COALESCE(nullif(j->>'pii_type', ''), nullif(j->>'entity_type', ''), nullif(j->>'type', ''), nullif(j->>'label', '')) AS pii_type, COALESCE(j->'span'->>'start', j->>'start')::BIGINT AS start, COALESCE(j->'span'->>'end', j->>'end')::BIGINT AS "end",
COALESCE(nullif(j->>'document_id', ''), nullif(j->>'doc_id', ''), 'default') AS document_id, COALESCE(nullif(j->>'text', ''), nullif(j->>'raw_value', '')) AS text, j->>'id' AS entity_id FROM x""",
    "checksum_dedup": "SELECT doc_id, checksum, first_id, doc_id <> first_id AS deduplicated FROM (SELECT doc_id, sha256(text) AS checksum, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)",
    "acceptable_files": "SELECT page_id, 'f.' || ['docx', 'PDF', 'txt'][page_id % 3 + 1] AS f FROM pages WHERE page_id % 3 <> 2 AND length(html) <= 3000",
    "redact_pseudonymize": f"SELECT doc_id, type, count(DISTINCT original) AS originals, count(DISTINCT original) AS stand_ins, 0::BIGINT AS unchanged, 0::BIGINT AS misshapen FROM ({planned()}) GROUP BY doc_id, type",
    "redact_reviewed": f"SELECT doc_id, sha256(redacted) AS redacted_sha256 FROM ({rewritten('', RETYPED)})",
    "detection_summary": f"SELECT type AS pii_type, count(*) AS candidates, COALESCE(any_value(n), 0)::BIGINT AS redacted FROM ({resolved(finds())}) LEFT JOIN (SELECT type, count(*) AS n FROM ({planned()}) GROUP BY type) USING (type) GROUP BY type",
    "dob_context": f"""{cte('windows')}, k(word) AS (VALUES {", ".join(f"('{w}')" for w in BIRTH)}),
stretch AS (SELECT case_id, word, substr(w, greatest(i, 1), least(i + length(word) - 1, length(w)) - greatest(i, 1) + 1) AS part FROM windows, k, range(-20, 80) t(i) WHERE i + length(word) - 1 >= 1 AND i <= length(w)),
{_indel("SELECT row_number() OVER () AS id, word AS a, part AS b FROM (SELECT DISTINCT word, part FROM stretch)")}
SELECT w.case_id, trim(w.w) <> '' AND (EXISTS (SELECT 1 FROM k WHERE contains(w.w, k.word)) OR EXISTS (SELECT 1 FROM stretch s JOIN ind ON ind.a = s.word AND ind.b = s.part WHERE s.case_id = w.case_id AND ind.ratio >= 0.85)) AS near FROM windows w""",
    "docx_blocks": f"""{cte('texts')} SELECT 'case-' || case_id AS path, (row_number() OVER (PARTITION BY case_id ORDER BY p) - 1)::INTEGER AS i, part AS text, (COALESCE(sum(length(part) + 2) OVER (PARTITION BY case_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS char_offset, (p - 1)::INTEGER AS paragraph_index, 0 AS run_index, 'word/document.xml' AS part
FROM (SELECT case_id, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS part FROM (SELECT case_id, string_split(text, chr(10) || chr(10)) AS ps FROM texts WHERE text <> ''))""",
    "policies_recent": f"{cte('policy_log')} SELECT id, name FROM policy_log ORDER BY created_at, id",
    "completed_jobs": f"{cte('jobs')} SELECT id, document_id FROM jobs WHERE status = 'completed'",
    "job_lookups": f"{cte('jobs', 'policies', 'files')} SELECT j.id, p.name AS policy_name, p.confidence_floor, f.filename FROM jobs j LEFT JOIN policies p ON p.id = j.policy_id LEFT JOIN files f ON f.id = j.document_id",
    "job_states": f"""{cte('run_events')}, e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, status) AS n FROM run_events),
nexts(s, t) AS (VALUES ('queued', 'detecting'), ('detecting', 'needs_review'), ('needs_review', 'redacting'), ('redacting', 'completed'), ('queued', 'failed'), ('detecting', 'failed'), ('needs_review', 'failed'), ('redacting', 'failed')),
w AS (SELECT job_id, 0::BIGINT AS n, 'queued' AS status, NULL::VARCHAR AS error FROM run_events GROUP BY job_id
UNION ALL SELECT w.job_id, e.n, CASE WHEN x.s IS NULL THEN w.status ELSE e.status END, CASE WHEN x.s IS NULL THEN w.error WHEN e.status = 'failed' THEN e.error END FROM w JOIN e ON e.job_id = w.job_id AND e.n = w.n + 1 LEFT JOIN nexts x ON x.s = w.status AND x.t = e.status)
SELECT job_id, arg_max(status, n) AS status, (array_agg(error ORDER BY n DESC))[1] AS error FROM w GROUP BY job_id""",
    "jobs_recent": f"{cte('jobs')} SELECT id, status FROM jobs ORDER BY created_at DESC, id",
    "job_detections_join": f'{cte("jobs", "detections")} SELECT job_id, status, type, start::BIGINT AS start, "end"::BIGINT AS "end" FROM jobs JOIN detections ON job_id = id',
    "fk_violations": f"{cte('jobs', 'policies')} SELECT id, policy_id FROM jobs WHERE policy_id NOT IN (SELECT id FROM policies)",
    "order_fk_violations": "SELECT o_orderkey, o_custkey AS c FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 2 = 0) AND o_custkey IS NOT NULL",
    "job_status": f"{cte('status_events')} SELECT job_id, arg_max(status, ts) AS status FROM status_events GROUP BY job_id",
    "job_summary": f"""WITH c AS (SELECT type, count(*) AS n FROM ({resolved(finds())}) GROUP BY 1) SELECT 'j' AS job_id, sum(n)::BIGINT AS total, '{{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}}' AS summary FROM c""",
    "policy_update": f"{cte('policies', 'updates')} SELECT p.id, COALESCE(u.name, p.name) AS name, COALESCE(u.confidence_floor, p.confidence_floor) AS confidence_floor FROM policies p LEFT JOIN updates u USING (id)",
    "status_changes": f"{cte('status_events')}, {CHANGES.format('status_events')} SELECT job_id, previous, status FROM changed WHERE ended = 0 AND previous IS DISTINCT FROM status",
    "status_stream": f"{cte('status_events')}, {CHANGES.format('status_events')} SELECT job_id, ts, status FROM changed WHERE ended = 0 AND previous IS DISTINCT FROM status",
    "event_changes": f"WITH ev AS (SELECT user_id::VARCHAR AS job_id, ts, min(event_type) AS status FROM events GROUP BY ALL), {CHANGES.format('ev')} SELECT job_id, count(*) AS changes FROM changed WHERE ended = 0 AND previous IS DISTINCT FROM status GROUP BY job_id",
}

"""Detectors: from a text column to an array of entities, in expressions only.

Each detector is a function of the text column. ``detect_all`` runs those that the wanted types need, in
the order of their registration, in one pass over a row. Patterns use Unicode classes unless told not
to; then digits, white space and word borders are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import fuzzy, spans, validators

# The patterns of the formats.
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
PHONE = r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
IPV6 = r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"
STREETS = ("Street", "St", "Avenue", "Ave", "Boulevard", "Blvd", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Court", "Ct", "Way", "Place", "Pl", "Square", "Sq", "Terrace", "Ter", "Circle", "Cir", "Highway", "Hwy")
ADDRESS = (
    rf"\b\d{{1,6}}\s+[A-Z][A-Za-z]*(?:\s[A-Z][A-Za-z]*){{0,3}}\s(?:{'|'.join(STREETS)})\.?(?![a-zA-Z])"
    r"(?:,\s*[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)*)?(?:,?\s*[A-Z]{2})?(?:\s+\d{4,6}(?:-\d{4})?)?"
)
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE_PATTERNS = {
    "mdy_slash": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "mdy_dash": r"\b\d{1,2}-\d{1,2}-\d{4}\b",
    "ymd_dash": r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    "month_name": rf"(?i:\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b)",
}
#: Three digits in a row, without which there is no phone number.
DIGITS = r"\p{Nd}{3}"
# Labels before a person's name, first those that need no colon, then those that do.
OPEN_LABELS = (r"Applicant(?:\s+Name)?", r"Customer\s+Name", r"Employee\s+Name", r"Candidate\s+Name", r"Contact(?:\s+Person|\s+Name)?", r"Authorized\s+Signatory", r"Signed\s+by", "Attention", "Attn", "Dear")
COLON_LABELS = ("Promoter", "Director", "Signatory", "Witness", "Guarantor")
NAME = r"[A-Z][a-zA-Z'-]+(?:[ \t]+[A-Z][a-zA-Z'-]+){1,3}"
LABELED = rf"\b(?:(?:{'|'.join(OPEN_LABELS)})\s*:?\s*|(?:{'|'.join(COLON_LABELS)})\s*:\s*)({NAME})"
#: All that holds a label, and a little more: one look at a character rules out nearly every place.
SOME_LABEL = "[ACDEGPSW](?:pplicant|ustomer|mployee|andidate|ontact|uthorized|igned|tt|ear|romoter|irector|ignatory|itness|uarantor)"
NON_NAMES = ("sir", "madam", "team", "service", "services", "department", "support", "customer", "customers", "staff", "committee", "board", "management", "all", "everyone", "member", "members", "user", "users", "client", "clients", "valued", "dear", "hiring", "recruiting", "recruitment")


def _unicode(pattern: str, wide: bool) -> str:
    return "(?U)" + pattern if wide else pattern


def _entities(found: Column, kind: str, confidence: Column, source: str) -> Column:
    """Matches as entities; ``ordinal`` is set when all detectors' finds are put together."""
    return F.transform(
        found,
        lambda m: F.struct(F.lit(kind).alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), confidence.alias("confidence"), F.lit(source).alias("source"), F.lit(0).alias("ordinal")),
    )


def _regex(text: Column, pattern: str, kind: str, wide: bool, needs: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    found = spans.matches(text, _unicode(pattern, wide), needs=needs)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["text"]))
    return _entities(found, kind, F.lit(schema.CONFIDENCE[kind]), schema.REGEX)


def ssn(text: Column, wide: bool = True) -> Column:
    return _regex(text, SSN, "ssn", wide, text.rlike(r"\p{Nd}-\p{Nd}"))


def card_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[ -]", "")


def credit_card(text: Column, wide: bool = True) -> Column:
    """Runs of 13 to 19 digits with single spaces or hyphens between, if Luhn's checksum holds.

    A separator after the last digit belongs to the match.
    """
    return _regex(text, CARD, "credit_card", wide, text.rlike(r"(?:\p{Nd}[ -]?){13}"), lambda v: F.length(card_digits(v)).between(13, 19) & validators.luhn_valid(v))


def phone(text: Column, wide: bool = True) -> Column:
    return _regex(text, PHONE, "phone", wide, text.rlike(DIGITS))


def email(text: Column, wide: bool = True) -> Column:
    return _regex(text, EMAIL, "email", wide, text.contains("@"))


def ip_address(text: Column, wide: bool = True, digits: Column | None = None) -> Column:
    """Dotted quads without leading zeros, then full IPv6 addresses of eight groups.

    ``digits`` tells whether the text holds any, where that is known already.
    """
    dotted = text.rlike(r"\p{Nd}\.") if digits is None else digits & text.rlike(r"\p{Nd}\.")
    return F.concat(_regex(text, IPV4, "ip_address", wide, dotted, validators.ipv4_valid), _regex(text, IPV6, "ip_address", wide, text.contains(":") & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")))


def address(text: Column, wide: bool = True) -> Column:
    return _regex(text, ADDRESS, "address", wide, text.rlike(r"(?U)\p{Nd}\s"))


def parsed_date(value: Column, layout: str) -> Column:
    """The date that a match of a layout means; null where there is no such day.

    A month's name is taken in full before a comma, or as its first three letters with or without one.
    """
    numbers = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    at = {"mdy_slash": (2, 0, 1), "mdy_dash": (2, 0, 1), "ymd_dash": (0, 1, 2)}.get(layout)
    if at is None:
        word = F.lower(F.regexp_extract(value, "^([A-Za-z]+)", 1))
        full = F.array_position(F.array(*[F.lit(m) for m in FULL_MONTHS]), word)
        short = F.array_position(F.array(*[F.lit(m[:3]) for m in FULL_MONTHS]), word)
        month = F.when((full > 0) & value.contains(","), full).when(short > 0, short).cast("string")
        year, day = numbers[1], numbers[0]
    else:
        year, month, day = (F.get(numbers, k) for k in at)
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(F.coalesce(month, F.lit("0")), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def date_of_birth(text: Column, as_of: Column | None = None, wide: bool = True) -> Column:
    """Dates of the last 120 years; near words of birth they are likely, elsewhere hardly."""
    now = F.year(as_of if as_of is not None else F.current_date())

    def of(layout: str, pattern: str) -> Column:
        found = spans.matches(text, _unicode(pattern, wide), needs=text.rlike("[0-9]{4}"))
        good = F.filter(found, lambda m: F.coalesce(F.year(parsed_date(m["text"], layout)).between(now - 120, now), F.lit(False)))
        return F.transform(good, lambda m: _dob(text, m))

    return F.concat(*[of(k, p) for k, p in DATE_PATTERNS.items()])


def _dob(text: Column, m: Column) -> Column:
    near = fuzzy.birth_context(spans.context_window(text, m["start"], m["end"]))
    confidence = F.when(near, F.lit(schema.DOB_CONFIDENCE)).otherwise(F.lit(schema.DOB_ALONE))
    return F.struct(F.lit("dob").alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), confidence.alias("confidence"), F.lit(schema.DATES).alias("source"), F.lit(0).alias("ordinal"))


def labeled_name(text: Column, wide: bool = True) -> Column:
    """Two to four capitalised words of one line after a label, none of which is a word for a role."""
    found = spans.matches(text, _unicode(LABELED, wide), group=1, needs=text.rlike(SOME_LABEL))
    names = F.filter(found, lambda m: ~F.exists(F.split(F.lower(m["text"]), r"\s+"), lambda w: w.isin(*NON_NAMES)))
    return _entities(names, "person", F.lit(schema.LABELED_CONFIDENCE), schema.LABELS)


def company_words(text: Column, wide: bool = True) -> Column:
    """Capitalised words that end in a company's suffix: a stand-in for a model, under its own name.

    It claims no more than that shape: confidence as a model's company would get it.
    """
    shape = r"\b[A-Z][A-Za-z&'-]+(?:[ \t]+[A-Z][A-Za-z&'-]+){0,4}[ \t]+(?:Inc|Corp|Corporation|LLC|LLP|Ltd|Limited|Company|Group|Holdings|Technologies|Industries|Enterprises|Partners|PLC|GmbH)\b"
    found = spans.matches(text, _unicode(shape, wide))
    return F.transform(
        found,
        lambda m: F.struct(F.lit("company").alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), fuzzy.company_confidence(m["text"], F.lit(0.8), spans.preceding_word(text, m["start"])).alias("confidence"), F.lit("company_words").alias("source"), F.lit(0).alias("ordinal")),
    )


#: Kinds whose every match holds a digit.
NUMERIC = frozenset(("ssn", "credit_card", "phone", "address", "dob"))
#: The detectors in the order of registration, with the types that each finds.
NATIVE: tuple[tuple[str, Callable[..., Column]], ...] = (("ssn", ssn), ("credit_card", credit_card), ("phone", phone), ("email", email), ("ip_address", ip_address), ("address", address), ("dob", date_of_birth), ("person", labeled_name))


def detect_all(text: Column, types: Iterable[str] = schema.TYPES, as_of: Column | None = None, wide: bool = True, extra: Column | None = None) -> Column:
    """Entities of all wanted types by all native detectors, numbered in the order of detection.

    Only the wanted types' patterns become part of the plan. ``extra`` holds entities from elsewhere
    (models, readers of images) that come after these.
    """
    wanted = set(types)
    if unknown := wanted - set(schema.TYPES):
        raise ValueError(f"unknown types: {sorted(unknown)}")
    none = F.array().cast(schema.ENTITIES)

    def together(digits: Column) -> Column:
        parts = []
        for kind, f in NATIVE:
            if kind in wanted:
                found = f(text, as_of, wide) if f is date_of_birth else f(text, wide, digits) if f is ip_address else f(text, wide)
                parts.append(F.when(digits, found).otherwise(none) if kind in NUMERIC else found)
        if extra is not None:
            parts.append(extra)
        return F.concat(*parts) if parts else none

    # most texts hold no digit at all; one look for one saves those for every kind that has to have some
    found = spans.let(text.rlike(r"\p{Nd}"), together) if wanted & (NUMERIC | {"ip_address"}) else together(F.lit(True))
    return F.transform(F.coalesce(found, none), lambda e, i: e.withField("ordinal", i))


def rows(docs: DataFrame, entities: str = "entities", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """One row for each entity of each document."""
    return docs.select(*keep, F.inline(entities))


def chunks(text: Column, size: int = 40_000, overlap: int = 1_000) -> Column:
    """Starts of pieces for readers that can't take a whole text: ``array<struct<start, text>>``.

    A piece ends at the last blank line in it, else at the last line end, else after ``size`` characters;
    the next starts ``overlap`` before that end, at least one character on.
    """
    n = F.length(text)

    def cut(start: Column) -> Column:
        window = F.substr(text, start + 1, F.lit(size))
        back = lambda mark: F.length(window) - F.length(F.substring_index(window, mark, -1)) - len(mark)
        paragraph, line = back("\n\n"), back("\n")
        inner = F.when(paragraph > 0, paragraph).when(line > 0, line).otherwise(F.lit(size))
        return F.when(start + size >= n, n).otherwise(start + inner)

    def step(acc: Column, _: Column) -> Column:
        end = cut(acc["start"])
        more = F.struct(
            F.greatest(acc["start"] + 1, end - overlap).alias("start"),
            (end >= n).alias("done"),
            F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), spans.piece(text, acc["start"], end).alias("text")))).alias("out"),
        )
        return F.when(acc["done"], acc).otherwise(more)

    # every step but those over blank stretches moves on by more than size - overlap halves
    first = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
    steps = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(1))
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    return F.when(n <= size, whole).otherwise(F.aggregate(steps, first, step, lambda acc: acc["out"]))

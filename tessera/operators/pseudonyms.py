"""Stable stand-ins for values, from hashes alone.

A value's stand-in follows from the document's id, the type and the value, so reruns and other machines
agree and nothing needs to be remembered. People who share a word of their name in a document share
their stand-in, and an e-mail address follows the person whose name its local part contains.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and words that stand-ins are made of: our own small lists.
FIRST = ("Asha", "Bela", "Chandra", "Dev", "Esha", "Farid", "Gita", "Hari", "Ila", "Jai", "Kiran", "Lata", "Mohan", "Nila", "Om", "Priya", "Ravi", "Sita", "Tara", "Uma", "Varun", "Yash", "Zara", "Amit")
LAST = ("Acharya", "Bose", "Chopra", "Desai", "Ekka", "Fernandes", "Ghosh", "Handa", "Iyer", "Joshi", "Kapoor", "Lal", "Mehta", "Nair", "Oza", "Pillai", "Rao", "Sethi", "Thakur", "Uppal", "Varma", "Wagle", "Yadav", "Zutshi")
TRADES = ("Textiles", "Foods", "Logistics", "Metals", "Software", "Energy", "Chemicals", "Media")
STREETS = ("Lake", "Hill", "Garden", "Market", "Station", "River", "Temple", "Park")
CITIES = ("Pune", "Nagpur", "Kochi", "Surat", "Indore", "Mysuru", "Patna", "Rajkot")


def number(seed: Column, salt: str, below: int) -> Column:
    """A number from 0 up to ``below`` by the seed's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), seed), 256), 1, 15), 16, 10).cast("long"), F.lit(below))


def pick(seed: Column, salt: str, words: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), number(seed, salt, len(words)).cast("int"))


def name_tokens(value: Column) -> Column:
    """Lower-case words of letters and digits; dots separate words too."""
    words = F.split(F.regexp_replace(F.lower(value), r"\.", " "), r"(?U)\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")


def name_key(value: Column) -> Column:
    return F.array_join(name_tokens(value), " ")


def slug(value: Column) -> Column:
    """The first two words joined by a dot."""
    tokens = name_tokens(value)
    return F.when(F.size(tokens) == 0, F.lit("redacted.user")).otherwise(F.array_join(F.slice(tokens, 1, 2), "."))


def person(seed: Column) -> Column:
    return F.concat_ws(" ", pick(seed, "first", FIRST), pick(seed, "last", LAST))


def phone(value: Column) -> Column:
    """Ten digits in Indian layout, the first from 6 to 9; a leading plus keeps a country code."""
    digits = F.concat((number(value, "head", 4) + 6).cast("string"), F.lpad(number(value, "tail", 10**9).cast("string"), 9, "0"))
    local = F.concat_ws(" ", F.left(digits, F.lit(5)), F.right(digits, F.lit(5)))
    return F.when(F.trim(value).startswith("+"), F.concat(F.lit("+91 "), local)).otherwise(local)


def date_like(value: Column, date: Column) -> Column:
    """A date in the layout of ``value``."""
    s = F.trim(value)
    year_first = F.length(F.substring_index(s, "-", 1)) == 4
    return (
        F.when(s.contains("-") & year_first, F.date_format(date, "yyyy-MM-dd"))
        .when(s.contains("-"), F.date_format(date, "MM-dd-yyyy"))
        .when(s.contains("/"), F.date_format(date, "MM/dd/yyyy"))
        .when(s.contains(","), F.date_format(date, "MMMM dd, yyyy"))
        .otherwise(F.date_format(date, "MMMM dd yyyy"))
    )


def birth_date(seed: Column, as_of: Column) -> Column:
    """A day on which someone of 18 to 90 years was born."""
    return F.date_sub(F.add_months(as_of, -12 * 18), number(seed, "days", 72 * 365).cast("int"))


def card(seed: Column) -> Column:
    """Sixteen digits whose last makes Luhn's checksum come out."""
    body = F.concat(F.lit("4"), F.lpad(number(seed, "card", 10**14).cast("string"), 14, "0"))

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    digits = F.filter(F.split(body, ""), lambda c: c != "")
    total = F.aggregate(F.transform(digits, weight), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def candidate(kind: Column, value: Column, seed: Column, as_of: Column) -> Column:
    """A stand-in by type, before it is made unique."""
    s = F.concat_ws("|", kind, seed)
    address = F.concat(number(s, "no", 900) + 10, F.lit(" "), pick(s, "street", STREETS), F.lit(" Road, "), pick(s, "city", CITIES), F.lit(" "), number(s, "pin", 900_000) + 100_000)
    company = F.concat_ws(" ", pick(s, "last", LAST), pick(s, "trade", TRADES), F.lit("Ltd"))
    ssn = F.concat_ws("-", (number(s, "a", 665) + 1).cast("string"), F.lpad((number(s, "b", 99) + 1).cast("string"), 2, "0"), F.lpad((number(s, "c", 9999) + 1).cast("string"), 4, "0"))
    ssn = F.lpad(ssn, 11, "0")
    ip = F.concat_ws(".", F.lit("10"), number(s, "x", 256), number(s, "y", 256), number(s, "z", 254) + 1)
    email = F.concat(slug(person(seed)), F.lit("@example.com"))
    return (
        F.when(kind == "person", person(seed))
        .when(kind == "email", email)
        .when(kind == "phone", phone(value))
        .when(kind == "address", address)
        .when(kind == "company", company)
        .when(kind == "ssn", ssn)
        .when(kind == "credit_card", card(s))
        .when(kind == "dob", date_like(value, birth_date(s, as_of)))
        .when(kind == "ip_address", ip)
        .otherwise(F.concat(F.lit("REDACTED-"), F.upper(kind)))
    )


MEMO = "array<struct<type:string,original:string,key:string,fake:string>>"


def pseudonyms(doc_id: Column, values: Column, as_of: Column) -> Column:
    """Stand-ins for one document's values, in order: ``array<struct<type, original, key, fake>>``.

    ``values`` is ``array<struct<type, original>>`` in document order, originals cleaned. The seed of a
    person is that of the first in the document who shares a word of the name; of an e-mail the person
    whose name shares a word with its local part. Where a stand-in is taken by another value of its
    type (whatever the case), eight digits of the value's hash are added, within an address's local part.
    """

    def add(memo: Column, v: Column) -> Column:
        original, kind = v["original"], v["type"]
        known = F.filter(memo, lambda m: (m["type"] == kind) & (m["original"] == original))
        tokens = name_tokens(F.when(kind == "email", F.substring_index(original, "@", 1)).otherwise(original))
        named = kind.isin("person", "email")
        kin = F.filter(memo, lambda m: named & m["type"].isin("person", "email") & F.arrays_overlap(F.split(m["key"], " "), tokens))
        own = F.when(named, F.array_join(tokens, " ")).otherwise(original)
        # a relative's words are this one's seed, so that kin share a name
        seed = F.concat_ws("|", doc_id.cast("string"), F.coalesce(F.get(kin, 0)["key"], own))
        fake = candidate(kind, original, seed, as_of)
        taken = F.exists(memo, lambda m: (m["type"] == kind) & (F.lower(m["fake"]) == F.lower(fake)))
        tail = F.substring(F.sha2(F.concat_ws(":", kind, original), 256), 1, 8)
        apart = F.when(kind == "email", F.concat(F.substring_index(fake, "@", 1), F.lit("."), tail, F.lit("@example.com"))).otherwise(F.concat_ws(" ", fake, tail))
        key = F.coalesce(F.get(kin, 0)["key"], F.array_join(tokens, " "))
        row = F.struct(kind.alias("type"), original.alias("original"), key.alias("key"), F.when(taken, apart).otherwise(fake).alias("fake"))
        return F.when(F.size(known) > 0, memo).otherwise(F.concat(memo, F.array(row)))

    return F.aggregate(values, F.array().cast(MEMO), add)


def lookup(memo: Column, kind: Column, original: Column) -> Column:
    return F.get(F.filter(memo, lambda m: (m["type"] == kind) & (m["original"] == original)), 0)["fake"]

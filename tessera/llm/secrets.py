"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Candidates are located in every text. Their values are hashed, and over the whole corpus it is counted
in how many distinct repositories and owners a value stands. A value of many owners is a widely copied
example; one of few owners that looks random is a live-looking credential. Where such a live value also
stands bare in a text, away from its usual context, that place becomes a span too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, stored

# The patterns of the three base kinds, with the group that holds the value and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = ("assign", "access", "hex", "bare")
#: What a value without its context looks like: a run of the characters of values that is long enough to look
#: random, and its parts where "=", "." or both bound a value.
BARE, PARTS = r"[A-Za-z0-9+/_.=-]{8,}", (r"[A-Za-z0-9+/_.-]{8,}", r"[A-Za-z0-9+/_=-]{8,}", r"[A-Za-z0-9+/_-]{8,}")
#: From how many owners, or from how many repositories, on a value is a copied example.
COPIED_BY, COPIED_IN = 3, 6
#: A value with more than this part of all occurrences is joined by broadcast; there are at most 1 / HOT such.
HOT = 0.001

SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str, group: int) -> Column:
    """Leftmost matches that don't overlap: ``array<struct<start, end, value>>`` in code points.

    Between the matches lie the pieces that a split leaves; their lengths give the places.
    """
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.arrays_zip(matches.alias("m"), values.alias("v")), between, lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m["m"]).alias("n"), m["v"].alias("v")))
    steps = F.filter(steps, lambda s: s["n"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, s: Column) -> Column:
        a = acc["at"] + s["gap"]
        span = F.struct(a.alias("start"), (a + s["n"]).alias("end"), s["v"].alias("value"))
        return F.struct((a + s["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(steps, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def random_looking(value: Column) -> Column:
    """Letters and digits mixed, eight characters or more, and no character for most of it."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 8) & (kinds >= 6)


def trimmed(value: Column) -> Column:
    """The value without the full stops and padding around it."""
    return F.regexp_replace(value, "^[.=]+|[.=]+$", "")


def bare_spans(text: Column) -> Column:
    """Where a value could stand without its context: ``array<struct<start, end, value>>``.

    What a run must hold to look random a part can't have unless the run has it.
    """

    def parts(run: Column) -> Column:
        inner = [F.transform(located(run["value"], p, 0), lambda s: _span(run["start"] + s["start"], s["value"])) for p in PARTS]
        found = F.concat(F.array(_span(run["start"], run["value"])), *inner)
        cut = F.transform(found, lambda s: _span(s["start"] + F.length(F.regexp_extract(s["value"], "^[.=]*", 0)), trimmed(s["value"])))
        return F.when(run["value"].rlike("[.=]"), F.array_distinct(F.concat(found, cut))).otherwise(F.array(_span(run["start"], run["value"])))

    runs = F.filter(located(text, BARE, 0), lambda s: random_looking(s["value"]))
    return F.filter(F.flatten(F.transform(runs, parts)), lambda s: random_looking(s["value"]))


def _span(start: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind: ``array<struct<start, kind, end, hash, random, bare>>``.

    ``bare`` is the hash of the trimmed value if that looks random too and differs.
    """

    def of(kind: int, pattern: str, group: int, least: int) -> Column:
        good = F.filter(located(text, pattern, group), lambda s: F.length(s["value"]) >= least)
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("hash"), random_looking(s["value"]).alias("random"), F.when(s["value"].rlike("^[.=]|[.=]$") & random_looking(trimmed(s["value"])), F.xxhash64(trimmed(s["value"]))).alias("bare")))

    parts = [of(k, *x[1:]) for k, x in enumerate(BASE)]
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", copied_by: int = COPIED_BY, copied_in: int = COPIED_IN) -> DataFrame:
    """``doc_id, text_hash, base, spans`` for each row; spans carry ``start, kind, end, repositories, owners, live``.

    ``kind`` counts in ``KINDS``. A repository is one of an owner's (owner and name together). A null
    owner or repository is one of its own. ``live`` holds for a random-looking value with fewer than
    ``copied_by`` owners and fewer than ``copied_in`` repositories. Bare spans are the places of live values outside all base spans, where the
    value is a whole run of the characters of values; "." and "=" may bound it as well. A live value with
    these at its ends (a sentence's full stop) also stands where it does without them, unless that
    is a value of its own. Of bare spans within one another the outermost stays. A null or empty text has no spans. Equal rows are rows of their own, a null id is kept. Other columns play no
    part; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.when(body.rlike("[0-9]"), F.transform(bare_spans(body), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("hash"), F.lit(True).alias("random"), F.lit(None).cast("long").alias("bare"))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), base_spans(body).alias("base"), bare.alias("bare"))
    clear = lambda s, base: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("bare", F.coalesce(F.filter("bare", lambda s: clear(s, F.col("base"))), F.array().cast("array<struct<start:int,kind:int,end:int,hash:bigint,random:boolean,bare:bigint>>")))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "secret-spans")

    per = rows.select("owner", "repository", F.explode("base").alias("s")).select("owner", "repository", "s.hash", "s.random", "s.bare")
    per = per.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"), F.max("random").alias("random"), F.max("bare").alias("bare"))
    # null counts as an owner: one more where there is any
    plus = lambda c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))
    stats = per.withColumn("both", F.struct(F.coalesce("owner", F.lit("\x00")), F.coalesce("repository", F.lit("\x00")))).groupBy("hash").agg(F.sum("n").alias("n"), plus("owner").alias("owners"), F.countDistinct("both").alias("repositories"), F.max("random").alias("random"), F.max("bare").alias("bare"))
    stats = stored(stats.withColumn("live", F.col("random") & (F.col("owners") < copied_by) & (F.col("repositories") < copied_in)), "secret-owners")

    # values that swallowed a full stop or the like, by what is left without it
    cut = stats.where("live and bare is not null").groupBy(F.col("bare").alias("hash")).agg(*[F.max(c).alias(c) for c in ("n", "repositories", "owners", "live")])
    kept = ["hash", "n", "repositories", "owners", "live"]
    stats = stats.select(*kept).unionByName(cut.join(stats.select("hash"), "hash", "left_anti").select(*kept))

    places = rows.select("rid", F.explode(F.concat("base", "bare")).alias("s")).select("rid", "s.start", "s.kind", "s.end", "s.hash")
    labelled = _with_stats(places, stats).where("kind < 3 or live")
    span = F.struct("start", "kind", "end", "repositories", "owners", "live")
    spans = labelled.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # a document's own spans
    none = F.array().cast("array<struct<start:int,kind:int,end:int,repositories:bigint,owners:bigint,live:boolean>>")
    inner = lambda s, o: (o["kind"] == 3) & (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    spans = spans.withColumn("spans", F.filter("spans", lambda s: (s["kind"] < 3) | ~F.exists("spans", lambda o: inner(s, o))))
    return rows.join(spans, "rid", "left").select("doc_id", "text_hash", "base", F.coalesce("spans", none).alias("spans"))


def _with_stats(places: DataFrame, stats: DataFrame) -> DataFrame:
    """Places with their value's statistics. A value that stands in very many places isn't dealt out by its hash."""
    total = stats.agg(F.sum("n")).first()[0] or 0
    hot = stats.where(F.col("n") > max(1.0, HOT * total))  # at most 1 / HOT rows
    columns = ["hash", "repositories", "owners", "live"]
    common = places.join(F.broadcast(hot.select(*columns)), "hash")
    rare = places.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(stats.select(*columns), "hash")
    return common.unionByName(rare)


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with the spans (sorted by start) replaced by ``mask``; overlapping ones become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mask)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], more).otherwise(inside)

    whole = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def without_live(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options: object) -> DataFrame:
    """All rows with all their columns; live spans are masked in the text, and ``n_chars`` follows.

    Clean rows stay as they are. Options are those of ``scan``.
    """
    found = scan(docs, doc_id, text, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.filter("spans", lambda s: s["live"]).alias("_spans"))
    found = stored(found.where(F.size("_spans") > 0).dropDuplicates(["_id", "_h"]), "secret-live")
    body = F.coalesce(F.col(text), F.lit(""))
    joined = docs.join(small(found), F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(body) == F.col("_h")), "left")
    joined = joined.withColumn("_new", F.when(F.col("_spans").isNotNull(), masked(body, F.col("_spans"))))
    own = {text: F.coalesce(F.col("_new"), F.col(text)), n_chars: F.coalesce(F.length("_new").cast("long"), F.col(n_chars))}
    return joined.select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns])

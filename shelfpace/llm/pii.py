"""Personal data: fixed patterns, and terms that reveal them by how they occur together in the corpus.

Protected are the values the patterns find, and the classes they belong to: the kind, the domain of a mail address, the first
digits of a phone number, the first half of a network address. A term is as telling as the share of the texts with it in
which it stands near such an entity, compared with the share of all texts that name the entity. Terms above the allowed
disclosure are generalised (to a mark that only says a term stood there), those that tell nearly all are removed.

Built-in functions only. Places come from the texts between the matches: the running sum of their lengths and those of the
matches, so a text is passed over once per kind. Patterns are possessive and start at the beginning of a run, which finds
the same leftmost matches without going back over long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.sqltext import let
from shelfpace.llm.staging import stage

KINDS = ("email", "ip", "card", "phone", "secret", "term", "term")  # the last one is removed, the one before generalised
INSTEAD = ("[email]", "[ip]", "[card]", "[phone]", "[secret]", "[related term]", "")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"  # also single digits, which are no card
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = r"^0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(\.0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}$"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9][A-Za-z_-]*+[0-9][A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,}+"
TERM = r"\p{L}{4,}+"  # words long enough to tell something

REACH = 60  # code points on either side of an entity in which terms count as occurring with it
MIN_SUPPORT = 3  # different surroundings of an entity in which a term occurs
CERTAINTY = 2.0  # standard errors between the observed share and the one that is believed
DISCLOSURE = 0.8  # share of an entity's information a term may reveal at most
REMOVAL = 0.97  # terms that reveal more are removed, others generalised
SPAN = "array<struct<start:int,end:int,kind:int>>"


def _luhn(digits: Column) -> Column:
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, -i, F.lit(1)))
    each = F.transform(places, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))


def _is_phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)


def _spans(text: Column, pattern: str, valid: Callable[[Column], Column], kind: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches that are valid."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.coalesce(F.length(p["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        good = p["m"].isNotNull() & valid(p["m"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step)["spans"]


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by start, then kind."""
    none = F.array().cast(SPAN)
    found = [
        F.when(text.contains("@"), _spans(text, EMAIL, lambda m: F.lit(True), 0)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(text, IP, lambda m: m.rlike(IP_VALID), 1)).otherwise(none),
        F.when(text.rlike("[0-9]"), _spans(text, CARD, _is_card, 2)).otherwise(none),
        F.when(text.contains("+"), _spans(text, PHONE, _is_phone, 3)).otherwise(none),
    ]
    whole = F.concat(*found)
    key = F.transform(whole, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.sort_array(key), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), 0)


def secret_spans(text: Column) -> Column:
    """Spans of long strings of letters and digits, such as keys and tokens."""
    return F.when(text.rlike(r"[A-Za-z0-9_-]{24}"), _spans(text, SECRET, lambda m: F.lit(True), 4)).otherwise(F.array().cast(SPAN))


def _entities(kind: Column, value: Column) -> Column:
    """Names of the entities a value stands for: its class, a coarser part of it, and itself."""
    name = F.get(F.array(*(F.lit(k) for k in KINDS)), kind)
    coarse = F.when(kind == 0, F.regexp_extract(value, "@.*$", 0)).when(kind == 1, F.regexp_extract(value, r"^[0-9]+\.[0-9]+", 0)).when(kind == 3, F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, 4))
    return F.array_compact(F.array(name, F.concat(name, F.lit(" in "), coarse), F.concat(name, F.lit(" "), value)))


def disclosing_terms(docs: DataFrame, reach: int = REACH, support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE, certainty: float = CERTAINTY) -> DataFrame:
    """term, disclosure, entity: terms that reveal more of some entity's information than allowed, and the entity they tell most of.

    With p(e) the share of texts that name entity e and p(e|t) the share of the texts with term t in which t stands near e, t
    reveals log(p(e|t) / p(e)) of the -log p(e) that e holds. Equal surroundings of an entity count once, so copies make no
    evidence, while every text with the term counts against it. p(e|t) is the lower end of its interval of ``certainty`` standard
    errors (Wilson's), so a few chance meetings do not suffice.
    """
    rows = _rows(docs)
    found = rows.select("text", F.inline(F.array(F.struct(F.concat(base_spans(F.col("text")), secret_spans(F.col("text"))).alias("spans"))))).filter(F.size("spans") > 0)
    at = found.select("text", F.explode("spans").alias("s"))
    low = F.greatest(F.col("s.start") - reach, F.lit(0))
    left, right = F.substring("text", low + 1, F.col("s.start") - low), F.substring("text", F.col("s.end") + 1, F.lit(reach))
    # Words that the reach cuts do not count.
    left = F.when(low > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.col("s.end") + reach < F.length("text"), F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    value = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    near = at.select(F.explode(_entities(F.col("s.kind"), value)).alias("entity"), F.lower(F.concat_ws(" ", left, right)).alias("around"))
    near = stage(near.groupBy("entity", "around").agg(F.count("*").alias("times")), "pii-near")
    named = near.groupBy("entity").agg(F.sum("times").alias("named"))
    joint = near.select("entity", F.explode(F.array_distinct(terms(F.col("around")))).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("joint")).filter(F.col("joint") >= support)
    joint = stage(joint.join(named, "entity"), "pii-joint")
    # Counted before it meets anything: one row per term.
    seen = rows.select(F.explode(F.array_distinct(F.transform(terms(F.col("text")), lambda w: F.lower(w)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = rows.count()
    share = F.least(F.col("joint") / F.col("df"), F.lit(1.0))
    z2 = certainty * certainty
    spread = F.sqrt(share * (1 - share) / F.col("df") + F.lit(z2) / (4 * F.col("df") * F.col("df"))) * certainty
    believed = (share + F.lit(z2) / (2 * F.col("df")) - spread) / (1 + F.lit(z2) / F.col("df"))
    p = F.least(F.col("named") / F.lit(max(total, 1)), F.lit(0.999))
    rated = joint.join(seen, "term").select("term", "entity", (F.log(F.greatest(believed, F.lit(1e-9)) / p) / -F.log(p)).alias("disclosure")).filter(F.col("disclosure") > disclosure)
    best = F.max(F.struct("disclosure", "entity")).alias("best")
    return rated.groupBy("term").agg(best).select("term", "best.disclosure", "best.entity")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    key = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(key, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _apart(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def find_personal_data(docs: DataFrame, reach: int = REACH, support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """doc_id, text, base, spans (arrays of start, end, kind): the base spans, and those with secrets and the disclosing terms.

    Secrets and disclosing terms are marked wherever they stand outside base spans. One row per row of ``docs``. Null texts count as
    empty. Rows of the same doc_id share their terms, which are searched for in each text. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = _rows(docs)
    revealing = stage(disclosing_terms(docs, reach, support, disclosure), "pii-terms")
    words = rows.select("doc_id", F.explode(F.array_distinct(F.transform(terms(F.col("text")), lambda w: F.lower(w)))).alias("term"))
    kind = F.when(F.col("disclosure") > removal, 6).otherwise(5)
    held = words.join(revealing.select("term", kind.alias("kind")), "term").groupBy("doc_id")
    held = stage(held.agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("held")), "pii-held")
    held = held.withColumnRenamed("doc_id", "held_id")
    joined = rows.join(held, F.expr("doc_id <=> held_id"), "left").drop("held_id")
    based = joined.select("doc_id", "text", "held", F.inline(F.array(F.struct(base_spans(F.col("text")).alias("base"), secret_spans(F.col("text")).alias("secret")))))
    based = based.withColumn("secret", _apart(F.col("secret"), F.col("base")))
    marked = F.when(F.col("held").isNotNull(), _spans(F.col("text"), TERM, lambda m: F.map_contains_key("held", F.lower(m)), 5)).otherwise(F.array().cast(SPAN))
    marked = _apart(_apart(marked, F.col("base")), F.col("secret"))
    marked = F.transform(marked, lambda s: s.withField("kind", F.element_at("held", F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))))
    return based.select("doc_id", "text", "base", _ordered(F.concat("base", "secret", marked)).alias("spans"))


def _sanitised(text: Column, spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in INSTEAD))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        replaced = F.struct(F.concat(acc["out"], kept, F.get(names, s["kind"])).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], replaced).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(spans, start, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


def sanitise(found: DataFrame) -> DataFrame:
    """doc_id, text: values replaced by their kind in brackets, disclosing terms generalised or removed.

    ``found`` comes from ``find_personal_data``. Where spans overlap, the first stands for both. An empty table gives an empty
    result.
    """
    return found.select("doc_id", _sanitised(F.col("text"), F.col("spans")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each row, whether there are any, and the digest of the text without them."""
    counts = [_count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        (F.size("spans") > 0).alias("has_personal_data"), F.sha2(_sanitised(F.col("text"), F.col("spans")), 256).alias("sanitised_sha256"),
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

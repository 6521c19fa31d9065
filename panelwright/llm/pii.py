r"""Personal data: fixed patterns, then sanitisation by what terms disclose about them.

Columns and SQL functions only.

Base spans are the leftmost non-overlapping matches of four patterns (email,
ip, card, phone), checked afterwards (parts of an address, Luhn, number of
digits); a match that fails is dropped. The values found are the protected
entities.

The method adds spans of kind ``term``. In the sample space of word slots of
the corpus (N in all), a term t has n(t) slots, an entity e has the n(e) slots
within ``REACH`` characters of its mentions, and n(t, e) of these hold t. The
share of the entity's information log2(N / n(e)) that t gives away is

    PMI(t, e) / IC(e) = 1 - log(n(t) / n(t, e)) / log(N / n(e)),

a number up to 1. A term with a share of at least 1/2, seen with the entity in
MIN_SEEN documents or more, is a disclosing term there: from 3/4 on it is removed
from the context of the entity, below that it is generalised. Both
tests are written without logarithms, n(t)^k <= (N / n(e)) n(t, e)^k, so that
any engine decides alike.

Patterns are given with possessive repeats and look-behinds that change no
match but keep the search linear in very long runs.

Edge cases: a null text is empty; documents without spans are returned with
zeros, the hash of the empty string and an empty list; an empty table gives an
empty result; rows repeating a doc_id are results of their own and count as
further mentions; a null doc_id is returned as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stage

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these characters has no match, and the search is left out.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
REACH = 64  # characters either side of a mention
MIN_SEEN = 3  # documents
WORD = r"[\p{L}\p{N}_]+"
CHUNK = 128  # words of one running length


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string is a multiple of ten."""

    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # a part of more than three digits after leading zeros is above 255
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _tagged(kind: str, put: str):
    """Spans of one kind as (kind, start, end, value) and as (start, end, replacement)."""
    whole = F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    masked = F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(put).alias("put")))
    return whole, masked


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def once(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def running(lengths: Column) -> Column:
    """Sums of all entries before each one.

    Taken in runs of CHUNK entries and then over the runs, because an array
    that grows entry by entry costs the square of its length.
    """

    def grown(values, start):
        def add(acc, n):
            return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, add, lambda acc: acc["out"])

    def whole(ls):
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ls), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(ls, i, F.lit(CHUNK)))
        return once(runs, lambda rs: F.flatten(F.zip_with(rs, grown(F.transform(rs, total), F.lit(0)), grown)))

    def total(run):
        return F.aggregate(run, F.lit(0), lambda a, n: a + n)

    return once(lengths, whole)


def pieces(text: Column, pattern: str) -> Column:
    """Array of (gap, value): the matches with what lies before each; behind the last gap there is no value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(text, pattern, -1), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value), code points, end exclusive.

    The pieces between matches and the matches alternate, so running lengths
    of both give the places.
    """

    def placed(ps):
        lengths = F.transform(ps, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["value"]), F.lit(0)))

        def one(p, at):
            a = at + F.length(p["gap"])
            return F.struct(a.alias("start"), (a + F.length(p["value"])).alias("end"), p["value"].alias("value"))

        return F.filter(F.zip_with(ps, running(lengths), one), lambda s: s["value"].isNotNull())

    return once(pieces(text, pattern), placed)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and one array of checked spans per kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    digit = F.col("text").rlike("[0-9]")
    for k in KINDS:
        possible = F.contains(F.col("text"), F.lit(NEEDS[k])) if k == "email" else digit & F.contains(F.col("text"), F.lit(NEEDS[k]))
        hit = F.when(possible, matches(F.col("text"), PATTERNS[k])).otherwise(none)
        out = out.withColumn(k, F.filter(hit, _check(k)))
    return out


def _entity(kind: Column, value: Column) -> Column:
    return F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value))


def _mentions(spans: DataFrame) -> DataFrame:
    """One row per mention with the text on both sides, whole words only.

    Words cut by the edge of the context are left out; words that touch the
    mention are not.
    """
    one = F.concat(*[_tagged(k, "")[0] for k in KINDS])
    rows = spans.where(" OR ".join(f"size({k}) > 0" for k in KINDS)).select("doc_id", "_h", "text", F.explode(one).alias("m"))
    left_at = F.greatest(F.lit(0), F.col("m.start") - REACH)
    left = F.substring(F.col("text"), left_at + 1, F.col("m.start") - left_at)
    right = F.substring(F.col("text"), F.col("m.end") + 1, F.lit(REACH))
    cut_left = F.when(left_at > 0, F.length(left) - F.length(F.regexp_replace(left, r"^[\p{L}\p{N}_]+", ""))).otherwise(0)
    full_right = F.length(right) == REACH
    kept_right = F.when(full_right, F.regexp_replace(right, r"[\p{L}\p{N}_]+$", "")).otherwise(right)
    value = _entity(F.col("m.kind"), F.col("m.value"))
    return rows.select(
        "doc_id", "_h", F.col("m.kind").alias("kind"), F.col("m.start").alias("m_start"), F.col("m.end").alias("m_end"), value.alias("entity"),
        (left_at + cut_left).alias("left_at"), F.substring(left, cut_left + 1, F.lit(REACH)).alias("left"), kept_right.alias("right"),
    )


def contexts(spans: DataFrame) -> DataFrame:
    """One row per word slot near a mention: doc_id, _h, kind, entity, term, start, end."""
    m = _mentions(spans)

    def words(side: str, at: Column) -> Column:
        return F.transform(
            matches(F.col(side), WORD),
            lambda s: F.struct(F.lower(s["value"]).alias("term"), (at + s["start"]).alias("start"), (at + s["end"]).alias("end")),
        )

    slots = F.explode(F.concat(words("left", F.col("left_at")), words("right", F.col("m_end"))))
    return m.select("doc_id", "_h", "kind", "entity", slots.alias("w")).select("doc_id", "_h", "kind", "entity", "w.*")


def word_counts(docs: DataFrame) -> DataFrame:
    """n(t) of every term of the corpus; copies combine before the shuffle."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0)))
    return docs.select(words.alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosing(slots: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(kind, entity, term, action) for terms that disclose an entity.

    Share >= 1/2 (generalise): n(t)^2 n(e) <= N n(t,e)^2.
    Share >= 3/4 (remove): n(t)^4 n(e) <= N n(t,e)^4.
    """
    pair = slots.groupBy("kind", "entity", "term").agg(F.count("*").alias("n_te"), F.count_distinct("doc_id").alias("n_docs"))
    entity = pair.groupBy("kind", "entity").agg(F.sum("n_te").alias("n_e"))
    often = pair.where(F.col("n_docs") >= MIN_SEEN)
    ratio = F.col("n_t").cast("double") / F.col("n_te").cast("double")
    spread = F.lit(float(total)) / F.col("n_e").cast("double")
    joined = often.join(entity, ["kind", "entity"]).join(counts, "term")
    return joined.select(
        "kind", "entity", "term",
        F.when(ratio * ratio * ratio * ratio <= spread, "remove").when(ratio * ratio <= spread, "generalise").alias("action"),
    ).where("action IS NOT NULL")


def find(docs: DataFrame) -> DataFrame:
    """All spans: doc_id, text, one array per base kind, ``term`` (start, end, action).

    Terms are joined back by doc_id and a hash of the text, so that rows
    repeating an id keep their own spans.
    """
    spans = base_spans(docs).withColumn("_h", F.xxhash64("text"))
    slots = stage(contexts(spans), "pii-slots")
    words = stage(word_counts(docs), "pii-words")
    total = words.agg(F.coalesce(F.sum("n_t"), F.lit(0))).first()[0]
    bad = stage(disclosing(slots, words, total), "pii-disclosing")
    hits = slots.join(bad, ["kind", "entity", "term"]).groupBy("doc_id", "_h", "start", "end").agg(F.max("action").alias("action"))
    per_row = stage(hits.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("term")), "pii-terms")
    per_row = per_row.withColumnsRenamed({"doc_id": "_id", "_h": "_hash"})
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    same = spans["doc_id"].eqNullSafe(per_row["_id"]) & (spans["_h"] == per_row["_hash"])
    return spans.join(per_row, same, "left").withColumn("term", F.coalesce("term", none)).drop("_h", "_id", "_hash")


def sanitised(found: DataFrame) -> DataFrame:
    """``found`` with ``sanitised``: entities masked, terms removed or generalised.

    Where spans overlap, the one that starts first is replaced.
    """
    base = [_tagged(k, f"[{k.upper()}]")[1] for k in KINDS]

    def general(s):
        w = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        return F.when(s["action"] == "remove", "").when(w.rlike(r"^\p{N}+$"), "[NUMBER]").when(w.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")

    terms = F.transform(F.col("term"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), general(s).alias("put")))
    spans = F.array_sort(F.concat(*base, terms))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        put = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, s["put"]).alias("out"))
        return F.when(s["start"] >= acc["at"], put).otherwise(acc)

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.withColumn("sanitised", F.aggregate(spans, zero, step, rest))

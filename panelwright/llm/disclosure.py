r"""Sanitisation by what the terms of the corpus disclose about protected entities.

Columns and SQL functions only. The entities are the values of the base spans
of ``pii`` (email, ip, card, phone); the method adds spans of kind ``term``.

Different texts are the sample: D of them, d(e) with entity e, d(t) with term
t, d(t, e) with both. Copies are one text. A term discloses an entity if

* it stands, in the texts of the entity, between at least two different pairs
  of neighbouring words, or is a piece of the entity's value with three
  letters or more (a name in an address needs no second witness);
* what co-occurrence says beyond chance is much of what the term says at all,
  (d(t, e) - d(t) d(e) / D) / d(t) >= 1/4, an estimate of the probability of
  the entity where the term is seen, shrunk by the expected count; and
* the term gives away at least half of the entity's information log(D / d(e)):
  (d(t) / d(t, e))^2 <= D / d(e).

From 1/2 and three quarters (the fourth power) on it is removed, below that it
is generalised. The two neighbours keep near copies and once-used words from
being evidence; the second bound does not loosen as the corpus grows.

A disclosing term is marked at all its places in the texts concerned: those
that hold the entity, and those that hold two disclosing terms of it.

Plan. Only texts with entities are paired with terms, and entities of the same
set of texts are one class there (a log of a hundred thousand addresses is one
or two), so pairs follow the words and not words x entities. Counts of terms
and the search for further texts carry hashes instead of texts. Marks are
joined to documents by a 128-bit hash of the text.

Edge cases: a null text is empty; documents without spans keep empty arrays;
rows repeating a doc_id or a text each get their own result; a null doc_id is
returned as it is; an empty table gives an empty result; further columns do
not matter; very long texts with very many spans take time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import pii
from panelwright.llm.common import drop_stage, read, stage
from panelwright.llm.registry import query

WORD = pii.WORD
PIECE = 3  # letters of a name-like piece of a value


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def terms(text: Column) -> Column:
    """The words of a text, in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _without(kind: str):
    """Function of a text that puts spaces for the valid matches of one kind."""

    def blank(p):
        hole = F.when(pii._valid(kind, p["value"]), F.repeat(F.lit(" "), F.length(p["value"]))).otherwise(p["value"])
        return F.concat(p["gap"], F.coalesce(hole, F.lit("")))

    return lambda t: F.array_join(F.transform(pii.pieces(t, pii.PATTERNS[kind]), blank), "")


def masked(text: Column) -> Column:
    """``text`` with every base span replaced by as many spaces."""
    for k in pii.KINDS:
        text = pii.once(text, _without(k))
    return text


def holders(spans: DataFrame) -> DataFrame:
    """Every different text with entities: h, es (distinct, as kind:entity), ws (words outside base spans)."""
    every = F.concat(*[pii._tagged(k, "")[0] for k in pii.KINDS])
    # strings, for which the distinct entries of an array are found by hash
    named = F.array_distinct(F.transform(every, lambda s: F.concat(s["kind"], F.lit(":"), pii._entity(s["kind"], s["value"]))))
    some = spans.where(" OR ".join(f"size({k}) > 0" for k in pii.KINDS))
    return some.select(text_hash(F.col("text")).alias("h"), named.alias("es"), terms(masked(F.col("text"))).alias("ws")).dropDuplicates(["h"])


def entity_classes(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, c) of every text and class in it, and (c, piece) of the name-like pieces of a class's values.

    A class is known by the number of its texts and two sums of their hashes.
    """
    rows = held.select("h", F.explode("es").alias("entity"))
    one = F.struct(
        F.count("*").alias("d_e"), F.bit_xor(F.xxhash64("h")).alias("x"), F.sum(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 40))).alias("y")
    )
    classes = stage(rows.groupBy("entity").agg(one.alias("c")), "terms-classes")
    of_text = rows.join(classes, "entity").select("h", "c").distinct()
    value = F.substring("entity", len("email:") + 1, F.length("entity"))
    named = F.explode(F.regexp_extract_all(value, F.lit(r"\p{L}{%d,}" % PIECE), F.lit(0)))
    return of_text, classes.where("entity LIKE 'email:%'").select("c", named.alias("term")).distinct()


def pairs(held: DataFrame, of_text: DataFrame, named: DataFrame) -> DataFrame:
    """(c, term, d_te) of the terms with two different pairs of neighbours, or name-like."""
    around = F.transform(
        "ws", lambda w, i: F.struct(w.alias("term"), F.xxhash64(F.get("ws", i - 1), F.get("ws", i + 1)).alias("at"))
    )
    used = held.select("h", F.explode(around).alias("w")).groupBy("h", "w.term").agg(F.min("w.at").alias("a"), F.max("w.at").alias("b"))
    both = used.join(of_text, "h").groupBy("c", "term").agg(F.count("*").alias("d_te"), F.min("a").alias("a"), F.max("b").alias("b"))
    named = named.withColumn("named", F.lit(True))
    return both.join(named, ["c", "term"], "left").where("a < b OR named").select("c", "term", "d_te")


def text_counts(docs: DataFrame) -> DataFrame:
    """(tk, d_t): different texts of every term, by its hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("hk"), F.explode(F.array_distinct(terms(text))).alias("term")).select("hk", F.xxhash64("term").alias("tk")).distinct().groupBy("tk").agg(F.count("*").alias("d_t"))


def disclosing(pair: DataFrame, counts: DataFrame, texts: int) -> DataFrame:
    """(c, term, action) of the pairs over the thresholds."""
    d_t, d_te, d_e, n = F.col("d_t").cast("double"), F.col("d_te").cast("double"), F.col("c.d_e").cast("double"), F.lit(float(texts))
    ratio = d_t / d_te
    beyond = (d_te * n - d_t * d_e) / (d_t * n)
    action = F.when((beyond >= 0.5) & (ratio * ratio * ratio * ratio <= n / d_e), "remove").when((beyond >= 0.25) & (ratio * ratio <= n / d_e), "generalise")
    joined = pair.withColumn("tk", F.xxhash64("term")).join(counts, "tk")
    return joined.select("c", "term", "tk", action.alias("action")).where("action IS NOT NULL")


def marks(docs: DataFrame, of_text: DataFrame, bad: DataFrame) -> DataFrame:
    """(h, actions): the terms to mark in every text concerned."""
    inside = of_text.join(bad, "c").select("h", "term", "action")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(text_hash(text).alias("h"), F.explode(F.array_distinct(terms(text))).alias("term"))
    seen = words.join(bad, "term").groupBy("h", "c").agg(F.collect_set(F.struct("term", "action")).alias("ts"))  # disclosing terms of one text
    beside = seen.where("size(ts) > 1").select("h", F.explode("ts").alias("t")).select("h", "t.*")
    each = inside.unionByName(beside).groupBy("h", "term").agg(F.max("action").alias("action"))
    return each.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))


def placed(text: Column, actions: Column) -> Column:
    """Array of (start, end, action): every word outside base spans that is a key of the map."""
    found = pii.matches(masked(text), WORD)
    named = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(actions, F.lower(s["value"])).alias("action")))
    return F.filter(named, lambda s: s["action"].isNotNull())


def find(docs: DataFrame) -> DataFrame:
    """All spans: doc_id, text, one array per base kind, ``term`` (start, end, action)."""
    docs = docs.select("doc_id", "text")
    spans = pii.base_spans(docs)
    held = stage(holders(spans), "terms-held")
    of_text, named = entity_classes(held)
    of_text = stage(of_text, "terms-texts")
    pair = stage(pairs(held, of_text, named), "terms-pairs")
    texts = docs.select(F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).distinct().count()
    bad = stage(disclosing(pair, text_counts(docs), texts), "terms-disclosing")
    drop_stage(pair)
    found = stage(marks(docs, of_text, bad), "terms-marks")
    for used in (held, of_text, bad):
        drop_stage(used)
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    spans = spans.withColumn("_h", text_hash(F.col("text"))).join(found, F.col("_h") == F.col("h"), "left")
    term = F.when(F.col("actions").isNotNull(), placed(F.col("text"), F.col("actions"))).otherwise(none)
    return spans.withColumn("term", term).drop("_h", "h", "actions")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
k(kind, o, pat) AS (VALUES ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  ('card', 3, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (SELECT doc_id, x, kind, o, string_split_regex(x, pat) AS gaps, regexp_extract_all(x, pat) AS vals FROM d, k WHERE regexp_matches(x, pat)),
s AS (SELECT doc_id, x, kind, o, vals[i] AS v, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:i - 1], lambda g: length(g))), 0))::BIGINT AS a
      FROM (SELECT *, unnest(range(1, len(vals) + 1)) AS i FROM m)),
c AS (SELECT *, a + length(v) AS b, regexp_replace(v, '[^0-9]', '', 'g') AS dg FROM s),
base AS MATERIALIZED (SELECT *, CASE WHEN kind IN ('card', 'phone') THEN dg ELSE lower(v) END AS entity FROM c WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN false ELSE coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255 END))
  WHEN 'phone' THEN length(dg) BETWEEN 9 AND 15
  ELSE length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(dg)), lambda i: CASE WHEN i % 2 = 0 THEN substr(dg, length(dg) - i, 1)::INT
    WHEN substr(dg, length(dg) - i, 1)::INT > 4 THEN substr(dg, length(dg) - i, 1)::INT * 2 - 9 ELSE substr(dg, length(dg) - i, 1)::INT * 2 END)) % 10 = 0 END),
-- words of the different texts, and which of them lie outside base spans
tx AS MATERIALIZED (SELECT DISTINCT x FROM d),
p AS (SELECT x, string_split_regex(x, '{WORD}') AS gaps, regexp_extract_all(x, '{WORD}') AS vals FROM tx),
q AS (SELECT x, i, vals[i] AS v, sum(length(gaps[i]) + CASE WHEN i > 1 THEN length(vals[i - 1]) ELSE 0 END) OVER (PARTITION BY x ORDER BY i) AS st FROM (SELECT *, unnest(range(1, len(vals) + 1)) AS i FROM p)),
bs AS (SELECT DISTINCT x, a, b FROM base),
w AS MATERIALIZED (SELECT x, i, lower(v) AS term, CAST(st AS BIGINT) AS st, CAST(st + length(v) AS BIGINT) AS en, EXISTS (SELECT 1 FROM bs WHERE bs.x = q.x AND bs.a < st + length(v) AND bs.b > st) AS inside FROM q),
e AS MATERIALIZED (SELECT DISTINCT x, kind, entity FROM base),
de AS (SELECT kind, entity, count(*) AS d_e FROM e GROUP BY ALL),
o AS (SELECT x, i, term, lag(term) OVER g AS l, lead(term) OVER g AS r FROM w WHERE NOT inside AND x IN (SELECT x FROM e) WINDOW g AS (PARTITION BY x ORDER BY i)),
te AS (SELECT kind, entity, term, count(DISTINCT x) AS d_te, count(DISTINCT {{'l': l, 'r': r}}) AS around FROM o JOIN e USING (x) GROUP BY ALL),
dt AS (SELECT term, count(DISTINCT x) AS d_t FROM w GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM tx),
bad AS MATERIALIZED (SELECT kind, entity, term FROM te JOIN de USING (kind, entity) JOIN dt USING (term), n
        WHERE (around > 1 OR kind = 'email' AND list_contains(regexp_extract_all(entity, '\p{{L}}{{{PIECE},}}'), term))
          AND (d_te * n - d_t * d_e) / (d_t * n) >= 0.25 AND (d_t::DOUBLE / d_te) * (d_t::DOUBLE / d_te) <= n / d_e),
held AS (SELECT DISTINCT x, kind, entity FROM (SELECT x, kind, entity FROM e UNION ALL
        SELECT x, kind, entity FROM (SELECT DISTINCT x, term FROM w) JOIN bad USING (term) GROUP BY ALL HAVING count(DISTINCT term) > 1)),
term AS (SELECT DISTINCT x, st, en FROM w JOIN held USING (x) JOIN bad USING (kind, entity, term) WHERE NOT inside),
every AS (SELECT doc_id, o, kind, a, b FROM base UNION ALL SELECT doc_id, 5, 'term', st, en FROM term JOIN d USING (x)),
g AS (SELECT doc_id, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone, count(*) FILTER (o = 5) AS n_term,
        sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) FILTER (o < 5), '')) AS base_sha256, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a, b) AS spans
      FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
FROM d LEFT JOIN g USING (doc_id)
"""


@query("op4_private_terms", SQL)
def op4_private_terms(spark, sf_dir):
    found = find(read(spark, sf_dir, "documents"))
    base = F.concat(*[pii._named(k) for k in pii.KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, pii._named("term")), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )

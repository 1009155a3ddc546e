"""Proofs: token matching, trees, text columns (T, X, F, W on tokens)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import filters, matching, tree
from ..operators.joins import ordered_distinct
from ..operators.ranking import bucketed_row_number
from . import frames
from .base import proof

M = "WITH " + frames.matched_sql()
T = "WITH " + frames.WORDS_SQL + ",\n" + frames.TOKENS_SQL


@proof("lexicon_match", "T1 X6", M + """
SELECT unit_id, id, form, coalesce(id_term, '') AS id_form, coalesce(sent_term, '') AS sent_form FROM mt
WHERE id_term IS NOT NULL OR sent_term IS NOT NULL""")
def lexicon_match(spark, d):
    t = frames.matched_tokens(spark, d)
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0))["term"], F.lit(""))
    hit = t.where((F.size("id_forms") > 0) | (F.size("sent_forms") > 0))
    return hit.select("unit_id", "id", "form", first("id_forms").alias("id_form"), first("sent_forms").alias("sent_form"))


@proof("token_classes", "T3", T + """
SELECT pos, ptb, CASE WHEN pos='^' THEN 'proper' WHEN pos='N' THEN 'noun' WHEN pos='V' THEN 'verb' WHEN pos='A' THEN 'adjective'
  WHEN pos='S' THEN 'possessive' ELSE 'determiner' END AS class, count(*) AS n FROM tok GROUP BY ALL""")
def token_classes(spark, d):
    t = frames.tokens(spark, d)
    return t.groupBy("pos", "ptb", matching.pos_class(F.col("pos"), F.col("ptb")).alias("class")).agg(F.count("*").alias("n"))


@proof("identity_mentions", "T4 T7 W5", M + """
SELECT unit_id, id, form, id_id AS identity FROM men WHERE mention""")
def identity_mentions(spark, d):
    t = frames.matched_tokens(spark, d)
    return matching.identity_mentions(t).select("unit_id", "id", "form", F.col("id_forms")[0]["id"].alias("identity"))


@proof("address_forms", "T7 W5", M + "SELECT unit_id, id, form, prev, next FROM mt WHERE is_address")
def address_forms(spark, d):
    t = matching.exclude_address_forms(frames.tokens(spark, d), frames.STAND_IN_ADDRESS)
    t = matching.neighbour_token(matching.neighbour_token(t, -1, out="prev"), 1, out="next")
    return t.where("is_address").select("unit_id", "id", "form", "prev", "next")


@proof("unit_identity_sets", "T5 F3", M + """
SELECT unit_id, string_agg(DISTINCT id_id, ',' ORDER BY id_id) AS identities, count(DISTINCT id_id) AS n
FROM men WHERE mention GROUP BY unit_id""")
def unit_identity_sets(spark, d):
    m = matching.identity_mentions(frames.matched_tokens(spark, d))
    u = filters.filter_units_with_identity(matching.unit_identities(m))
    return u.select("unit_id", F.array_join("identities", ",").alias("identities"), F.size("identities").cast("long").alias("n"))


@proof("root_mentions", "T6", M + """
SELECT c.unit_id, c.id, c.head FROM men c LEFT JOIN men h ON h.unit_id = c.unit_id AND h.id = c.head AND h.mention
WHERE c.mention AND h.id IS NULL""")
def root_mentions(spark, d):
    return matching.root_mention_rows(frames.matched_units(spark, d))


@proof("negated_tokens", "T8", M + "SELECT unit_id, id, form FROM mt WHERE negated")
def negated_tokens(spark, d):
    return matching.negated(frames.tokens(spark, d)).where("negated").select("unit_id", "id", "form")


@proof("negated_with_children", "T8", M + """
SELECT t.unit_id, t.id FROM mt t WHERE negated UNION
SELECT t.unit_id, t.id FROM mt t JOIN mt c ON c.unit_id = t.unit_id AND c.head = t.id AND c.negated""")
def negated_with_children(spark, d):
    return matching.negated(frames.tokens(spark, d), with_children=True).where("negated").select("unit_id", "id")


@proof("tree_children", "T9", T + """
SELECT unit_id, head AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS children FROM tok WHERE head > 0 GROUP BY ALL""")
def tree_children(spark, d):
    kids = tree.children(frames.tokens(spark, d))
    return kids.select("unit_id", "id", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


_UP = """, up AS (
  SELECT unit_id, id, id AS cur, head AS next, 0 AS depth FROM tok
  UNION ALL SELECT u.unit_id, u.id, t.id, t.head, u.depth + 1 FROM up u JOIN tok t ON t.unit_id = u.unit_id AND t.id = u.next WHERE u.next > 0)"""


@proof("tree_roots", "T10", T.replace("WITH ", "WITH RECURSIVE ", 1) + _UP + "\nSELECT unit_id, id, cur AS root_id FROM up WHERE next <= 0")
def tree_roots(spark, d):
    t = frames.tokens(spark, d).select("unit_id", "id", "head")
    return tree.with_roots(t).select("unit_id", "id", "root_id")


@proof("descendants_with_sentiment", "T11", M.replace("WITH ", "WITH RECURSIVE ", 1) + _UP + """
SELECT u.unit_id, u.cur AS ancestor, u.id FROM up u JOIN mt t ON t.unit_id = u.unit_id AND t.id = u.id
WHERE u.depth > 0 AND t.sent_term IS NOT NULL""")
def descendants_with_sentiment(spark, d):
    return tree.descendants_of(tree.plain(frames.matched_units(spark, d), ["id", "head"], "sent_forms"))


@proof("verb_side_children", "T12", T.replace("WITH ", "WITH RECURSIVE ", 1) + """,
fc AS (SELECT unit_id, head AS id, min(id) AS first FROM tok WHERE head > 0 GROUP BY ALL),
walk AS (SELECT c.unit_id, v.id AS verb, c.id AS child, c.id AS cur FROM tok c JOIN tok v ON v.unit_id=c.unit_id AND v.id=c.head AND v.pos='V'
  UNION ALL SELECT w.unit_id, w.verb, w.child, f.first FROM walk w JOIN tok t ON t.unit_id=w.unit_id AND t.id=w.cur AND t.pos='D'
  JOIN fc f ON f.unit_id=w.unit_id AND f.id=w.cur),
ends AS (SELECT w.* FROM walk w JOIN tok t ON t.unit_id=w.unit_id AND t.id=w.cur
  LEFT JOIN fc f ON f.unit_id=w.unit_id AND f.id=w.cur WHERE t.pos <> 'D' OR f.first IS NULL)
SELECT unit_id, verb, child, cur AS resolved, CASE WHEN cur > verb THEN 'right' ELSE 'left' END AS side FROM ends""")
def verb_side_children(spark, d):
    return tree.side_children(frames.tokens(spark, d))


@proof("modifier_terms", "T13", M + """,
fit AS (SELECT unit_id, head AS id, id AS kid, CASE WHEN id_term IN ('the','be') THEN NULL ELSE id_term END AS it,
          CASE WHEN sent_term IN ('the','be') THEN NULL ELSE sent_term END AS st FROM mt WHERE head > 0 AND pos IN ('N','^','A'))
SELECT unit_id, id, coalesce(string_agg(DISTINCT it, ',' ORDER BY it), '') AS id_mods,
  coalesce(string_agg(CASE WHEN it IS NULL THEN st END, ',' ORDER BY kid), '') AS word_mods
FROM fit WHERE it IS NOT NULL OR st IS NOT NULL GROUP BY ALL""")
def modifier_terms(spark, d):
    m = tree.modifiers_in(tree.plain(frames.matched_units(spark, d), ["id", "head", "pos", "id_forms", "sent_forms"]), ["the", "be"])
    return m.select("unit_id", "id", F.array_join("id_mods", ",").alias("id_mods"), F.array_join("word_mods", ",").alias("word_mods"))


@proof("head_words", "T14", M + """
SELECT unit_id, id, id_term IS NOT NULL AS is_identity, coalesce(id_term, sent_term) AS head_term, 0 AS n_earlier
FROM mt WHERE id_term IS NOT NULL OR sent_term IS NOT NULL""")
def head_words(spark, d):
    h = tree.head_word_and_modifiers(frames.matched_tokens(spark, d))
    return h.select("unit_id", "id", "is_identity", "head_term", F.size("earlier").alias("n_earlier"))


# Phrases: word pairs that occur often next to each other.
PAIRS = """, pairs AS (SELECT a.form || ' ' || b.form AS term FROM tok a JOIN tok b ON b.unit_id=a.unit_id AND b.id=a.id+1
  GROUP BY 1 HAVING count(*) >= 12)"""


def frequent_pairs(spark, d):
    def build():
        t = matching.pair_counts(frames.unit_words(spark, d), frames.unit_forms, frames.unit_blocks(spark, d))
        return t.where("n >= 12").select(F.concat_ws(" ", "one", "two").alias("term"))

    return frames.kept("pairs", spark, d, build)


# Two-word entries only, so of a run of overlapping hits every second is taken.
@proof("phrase_merge", "T2", T + PAIRS + """,
hit AS (SELECT a.unit_id, a.id FROM tok a JOIN tok b ON b.unit_id=a.unit_id AND b.id=a.id+1 JOIN pairs p ON p.term = a.form||' '||b.form),
run AS (SELECT *, id - row_number() OVER (PARTITION BY unit_id ORDER BY id) AS g FROM hit),
acc AS (SELECT unit_id, id FROM (SELECT *, (id - min(id) OVER (PARTITION BY unit_id, g)) % 2 AS odd FROM run) WHERE odd = 0),
grp AS (SELECT t.*, CASE WHEN p.id IS NOT NULL THEN p.id ELSE t.id END AS g FROM tok t LEFT JOIN acc p ON p.unit_id=t.unit_id AND p.id=t.id-1),
mrg AS (SELECT unit_id, g, string_agg(form, ' ' ORDER BY id) AS form, string_agg(pos, ' ' ORDER BY id) AS pos FROM grp GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY g) AS id FROM mrg),
lnk AS (SELECT c.unit_id, c.g, c.id, CASE WHEN c.head > 0 THEN coalesce(h.g, -1) ELSE c.head END AS hg
        FROM grp c LEFT JOIN grp h ON h.unit_id=c.unit_id AND h.id=c.head),
hd AS (SELECT unit_id, g, arg_min(hg, id) AS hg FROM lnk WHERE hg <> g GROUP BY ALL)
SELECT n.unit_id, n.id, n.form, n.pos, CASE WHEN d.hg > 0 THEN x.id ELSE d.hg END AS head
FROM num n LEFT JOIN hd d USING (unit_id, g) LEFT JOIN num x ON x.unit_id=n.unit_id AND x.g=d.hg""")
def phrase_merge(spark, d):
    blocks = frames.unit_blocks(spark, d)
    m = matching.unit_tokens(matching.merge_units(frames.unit_words(spark, d), frames.unit_nodes, frequent_pairs(spark, d), frames.unit_forms, blocks))
    return m.select("unit_id", "id", "form", "pos", F.col("head").cast("long").alias("head"))


@proof("phrase_tokens_matched", "T1 T2 X5", "WITH " + frames.matched_sql(merged=True) + """
SELECT unit_id, id, form, tags AS pos, coalesce(sent_term, '') AS forms, coalesce(id_term, '') AS identities, negated FROM mt""")
def phrase_tokens_matched(spark, d):
    """The ladder on tokens of which phrases were merged."""
    t = frames.matched_tokens(spark, d, merged=True)
    terms = lambda c: F.array_join(F.transform(c, lambda f: f["term"]), "|")
    return t.select("unit_id", "id", "form", "pos", terms("sent_forms").alias("forms"), terms("id_forms").alias("identities"), "negated")


@proof("phrase_parts", "X5 J13", """
SELECT doc_id, len(list_distinct(list_filter(list_concat(string_split(line,' '), string_split(line,''''),
   string_split(line,'-'), string_split(line,'/')), lambda x: x <> ''))) AS n_parts
FROM (SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z''/-]+', ' ', 'g')) AS line FROM documents)""")
def phrase_parts(spark, d):
    line = F.lower(F.regexp_replace("text", "[^A-Za-z'/-]+", " "))
    docs = frames.table(spark, d, "documents").select("doc_id", line.alias("line"))
    return docs.select("doc_id", F.size(ordered_distinct(fx.split_phrase(F.col("line")))).cast("long").alias("n_parts"))


@proof("plural_forms", "X6", "WITH " + frames.COUNTS_SQL + """
SELECT w AS term, left(w, len-1) AS singular, len > 3 AS as_part FROM counts WHERE right(w,1)='s' AND w NOT IN ('is','does','was')""")
def plural_forms(spark, d):
    c = frames.counts(spark, d).select(F.col("w").alias("term"))
    out = c.select("term", fx.strip_plural(F.col("term")).alias("singular"), fx.strip_plural(F.col("term"), False).isNotNull().alias("as_part"))
    return out.where("singular is not null")


@proof("unit_texts", "X7", """
SELECT doc_id, replace(replace(replace(replace(array_to_string(toks, ' '), ' .', '.'), ' ,', ','), ' ;', ';'), ' !', '!') AS line
FROM (SELECT doc_id, regexp_extract_all(text, '\\pL+|[.,;!]') AS toks FROM documents) WHERE len(toks) > 0""")
def unit_texts(spark, d):
    toks = F.regexp_extract_all("text", F.lit("\\pL+|[.,;!]"), F.lit(0))
    docs = frames.table(spark, d, "documents").select("doc_id", toks.alias("t")).where(F.size("t") > 0)
    return docs.select("doc_id", fx.unit_text(F.col("t")).alias("line"))


@proof("masked_texts", "X8", T + """,
unit AS (SELECT unit_id, min(user_id) AS u, list(form ORDER BY id) AS toks, string_agg(form, ' ' ORDER BY id) AS txt,
   arg_max(form, length(form)*100-id) AS one, max(CASE WHEN id=1 THEN form END)||' '||max(CASE WHEN id=2 THEN form END) AS two FROM tok GROUP BY unit_id)
SELECT unit_id, one AS identity, array_to_string(list_transform(toks, lambda x: CASE WHEN x = one OR x = one||'s' THEN 'identity' ELSE x END), ' ') AS line FROM unit
UNION ALL SELECT unit_id, two, replace(txt, two, 'compound identity') FROM unit WHERE two IS NOT NULL""")
def masked_texts(spark, d):
    t = tree.gather(frames.tokens(spark, d), ["form"])
    toks = F.transform("nodes", lambda n: n["form"])
    longest = F.max_by("f", F.length("f") * 100 - F.col("i"))
    one = t.select("unit_id", F.posexplode(toks).alias("i", "f")).groupBy("unit_id").agg(longest.alias("identity"))
    two = t.where(F.size("nodes") > 1).select("unit_id", F.concat_ws(" ", toks[0], toks[1]).alias("identity"))
    both = t.join(one.unionByName(two), "unit_id")
    return both.select("unit_id", "identity", fx.mask_identity(toks, F.col("identity")).alias("line"))


@proof("candidate_units", "F1", M + """,
unit AS (SELECT unit_id, count(*) AS n FROM tok GROUP BY unit_id HAVING count(*) > 4)
SELECT DISTINCT u.unit_id, u.n FROM unit u JOIN tok t USING (unit_id)
WHERE t.form IN (SELECT term FROM idents) OR (right(t.form,1)='s' AND left(t.form, length(t.form)-1) IN (SELECT term FROM idents))""")
def candidate_units(spark, d):
    u = tree.gather(frames.tokens(spark, d), ["form"]).select("unit_id", F.transform("nodes", lambda n: n["form"]).alias("tokens"))
    kept = filters.filter_candidate_units(u, frames.identities(spark, d).select("term"))
    return kept.select("unit_id", F.size("tokens").cast("long").alias("n"))


@proof("labelled_units", "F2", T + """
SELECT unit_id, count(*) AS n, sum(CASE WHEN label <> 'O' THEN 1 ELSE 0 END) AS labelled FROM tok GROUP BY unit_id
HAVING bool_or(label <> 'O')""")
def labelled_units(spark, d):
    t = filters.filter_labelled_units(frames.tokens(spark, d))
    return t.groupBy("unit_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") != "O").alias("labelled"))


@proof("units_with_keyword", "F6", """
SELECT doc_id, len(lines) AS n_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
WHERE len(list_filter(lines, lambda x: contains(x, 'tion'))) > 0""")
def units_with_keyword(spark, d):
    docs = frames.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return filters.search_units(docs, "tion").select("doc_id", F.size("lines").cast("long").alias("n_lines"))


@proof("symbol_hits", "T15 X9 S4", """
WITH hit AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\.\\.\\.|\\.|!|[?]|;')) AS symbol FROM documents)
SELECT doc_id, symbol, count(*) AS n, round(sum(CASE symbol WHEN '...' THEN -0.5 WHEN '.' THEN 0.25 WHEN '!' THEN 2.5 WHEN '?' THEN -1.25 ELSE 0.75 END), 4) AS value
FROM hit GROUP BY ALL""")
def symbol_hits(spark, d):
    values = {"...": -0.5, ".": 0.25, "!": 2.5, "?": -1.25, ";": 0.75}
    emoji = spark.createDataFrame(list(values.items()), "symbol string, value double")
    t = frames.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.lit(1).alias("id"), F.col("text").alias("form"))
    hits = t.select("unit_id", F.explode(fx.extract_symbols(F.col("form"), fx.symbol_pattern(list(values)))).alias("symbol"))
    agg = hits.groupBy("unit_id", "symbol").agg(F.count("*").alias("n")).join(emoji, "symbol")
    return agg.select(F.col("unit_id").alias("doc_id"), "symbol", "n", F.round(F.col("n") * F.col("value"), 4).alias("value"))


@proof("symbol_sources", "T15 S5 T1", M + ",\n" + frames.SYMBOLS_SQL + """
SELECT unit_id, id, source, round(e, 4) AS e, round(p, 4) AS p, round(a, 4) AS a FROM sym""")
def symbol_sources(spark, d):
    hits = frames.symbols(spark, d)
    return hits.select("unit_id", "id", "source", *[F.round(c, 4).alias(c) for c in "epa"])


@proof("last_words_first", "W5 W6", T + """
SELECT unit_id, id, form, row_number() OVER (PARTITION BY user_id ORDER BY unit_id, id) AS rn FROM tok""")
def last_words_first(spark, d):
    """Running position of every word within its source, hot sources included."""
    t = frames.tokens(spark, d).select("unit_id", "user_id", "id", "form")
    ranked = bucketed_row_number(t, ["user_id"], ["unit_id", "id"], F.floor(F.col("unit_id") / 100000))
    return ranked.select("unit_id", "id", "form", "rn")

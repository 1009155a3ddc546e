"""Stand-in shapes built from the given tables, each with its SQL twin.

The tables hold no parsed text, so units are runs of 24 consecutive words of a
document (every word of every document), lexicons are its frequent words with
arithmetic values, and the tree is arithmetic on word positions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import NEGATION_WORDS
from ..operators import matching, unit_rows
from ..operators import words as cutting
from ..operators.ranking import stable_index
from ..session import materialize, spread

WORDS_PER_UNIT = 24
TAGS = ["N", "V", "A", "D", "^", "S"]


def table(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None, wide: bool = False) -> DataFrame:
    """A given table; ``wide`` spreads a small file over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if cols:
        df = df.select(*cols)
    return spread(df) if wide else df


_KEPT: dict[tuple, DataFrame] = {}


def kept(key: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Stand-in table written once per application and then read back."""
    full = (spark.sparkContext.applicationId, sf_dir, key)
    if full not in _KEPT:
        _KEPT[full] = materialize(build(), key)
    return _KEPT[full]


# -- words and units ----------------------------------------------------------


def lower_texts(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """(doc_id, text, ...): documents in lower case."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", *cols], wide=True)
    return docs.select("doc_id", F.lower("text").alias("text"), *cols)


def words(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """(doc_id, ..., i, w): lower-case words of every document, i from 1."""
    rows = cutting.word_lists(lower_texts(spark, sf_dir, *cols), "text").select("doc_id", *cols, F.posexplode("ws").alias("i0", "w"))
    return rows.select("doc_id", *cols, (F.col("i0") + 1).alias("i"), "w")


WORDS_SQL = """words AS (
  SELECT doc_id, source, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, source, lang, regexp_extract_all(lower(text), '\\pL+') AS ws FROM documents))"""

COUNTS_SQL = WORDS_SQL + """,
counts AS (SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs,
             length(w) AS len, ascii(w) AS c0, ascii(right(w, 1)) AS c1 FROM words GROUP BY w)"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        n = words(spark, sf_dir).groupBy("w").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
        return n.select("w", "n", "docs", *_letters())

    return kept("counts", spark, sf_dir, build)


def word_counts(spark: SparkSession, sf_dir: str, shape=None) -> DataFrame:
    """``counts`` without the number of documents; those of words of one shape alone are a smaller table."""

    def build():
        return cutting.word_counts(lower_texts(spark, sf_dir), "text", shape).select("w", "n", *_letters())

    if shape is None or (spark.sparkContext.applicationId, sf_dir, "word_counts") in _KEPT:
        return kept("word_counts", spark, sf_dir, build)
    return kept(f"{shape.__name__}_counts", spark, sf_dir, build)


def _letters() -> list[Column]:
    return [F.length("w").alias("len"), F.ascii("w").alias("c0"), F.ascii(F.right("w", F.lit(1))).alias("c1")]


def epa(len_: Column, c0: Column, c1: Column) -> list[Column]:
    """Arithmetic sentiment values of a word."""
    return [
        ((len_ * 13 + c0 * 7 + c1 * 3) % 87 - 43) / 10.0,
        ((len_ * 5 + c0 * 11 + c1 * 2) % 81 - 40) / 10.0,
        ((len_ * 3 + c0 * 5 + c1 * 13) % 85 - 42) / 10.0,
    ]


EPA_SQL = (
    "((len * 13 + c0 * 7 + c1 * 3) % 87 - 43) / 10.0 AS e, "
    "((len * 5 + c0 * 11 + c1 * 2) % 81 - 40) / 10.0 AS p, "
    "((len * 3 + c0 * 5 + c1 * 13) % 85 - 42) / 10.0 AS a"
)

# Frequent words whose first letter has a code divisible by 3 are identities;
# the sentiment lexicon holds frequent words of at least two letters.
IDENTITY_RULE = "n >= 8 AND len BETWEEN 4 AND 7 AND c0 % 3 = 0"
LEXICON_RULE = "n >= 4 AND len >= 2 AND (len + c0) % 2 = 0"


def identity_shape(length, first):
    """What ``IDENTITY_RULE`` asks of a word alone."""
    return (length >= 4) & (length <= 7) & (first % 3 == 0)


def md5_index_sql(src: str, where: str, prefix: str, extra: str = "") -> str:
    return (
        f"SELECT w AS term, '{prefix}' || CAST(row_number() OVER (ORDER BY md5(w)) - 1 AS VARCHAR) AS id{extra} "
        f"FROM {src} WHERE {where}"
    )


LEXICONS_SQL = (
    COUNTS_SQL
    + ",\nidents AS (" + md5_index_sql("counts", IDENTITY_RULE, "i_", ", " + EPA_SQL) + ")"
    + ",\nlex AS (SELECT term, id, e + 0.0001 AS e, p + 0.0001 AS p, a + 0.0001 AS a FROM ("
    + md5_index_sql("counts", LEXICON_RULE, "z_", ", " + EPA_SQL) + "))"
)


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, id, idx, e, p, a (known values, no offset)."""

    def build():
        c = word_counts(spark, sf_dir, identity_shape).where(IDENTITY_RULE).withColumnRenamed("w", "term")
        idx = stable_index(c, "term")
        e, p, a = epa(F.col("len"), F.col("c0"), F.col("c1"))
        return c.join(idx, "term").select(
            "term", F.concat(F.lit("i_"), F.col("idx").cast("string")).alias("id"), F.col("idx").cast("int").alias("idx"),
            e.alias("e"), p.alias("p"), a.alias("a"),
        )

    return kept("identities", spark, sf_dir, build)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, id, e, p, a with the non-zero offset."""

    def build():
        c = word_counts(spark, sf_dir).where(LEXICON_RULE).withColumnRenamed("w", "term")
        ids = stable_index(c, "term", "id", "z_")
        e, p, a = epa(F.col("len"), F.col("c0"), F.col("c1"))
        return c.join(ids, "term").select("term", "id", F.lit(None).cast("int").alias("idx"), (e + 0.0001).alias("e"), (p + 0.0001).alias("p"), (a + 0.0001).alias("a"))

    return kept("lexicon", spark, sf_dir, build)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token table of all documents in units of 24 words."""
    w = words(spark, sf_dir, "source", "lang")
    seg = F.floor((F.col("i") - 1) / WORDS_PER_UNIT)
    id_ = ((F.col("i") - 1) % WORDS_PER_UNIT + 1).cast("int")
    t = w.select(
        (F.col("doc_id") * 100000 + seg).alias("unit_id"), F.col("source").alias("user_id"), "lang",
        id_.alias("id"), F.col("w").alias("form"),
    )
    return t.select("unit_id", "user_id", "lang", "id", "form", *token_shape(F.col("form"), F.col("id")))


def token_shape(form: Column, id_: Column) -> list[Column]:
    """lemma, pos, ptb, head and label of a word at a place of its unit."""
    k = (F.length(form) + id_) % 6
    pos = F.element_at(F.array(*[F.lit(x) for x in TAGS]), (k + 1).cast("int"))
    tagged = lambda tag: k == TAGS.index(tag)
    ptb = (
        F.when(tagged("N"), "NN").when(tagged("^"), "NNP").when(tagged("D"), "DT").when(tagged("S"), "PRP$")
        .when(tagged("V") & (F.length(form) % 3 == 0), "VBN").when(tagged("V"), "VB")
        .when(F.length(form) % 5 == 0, "JJR").otherwise("JJ")
    )
    head = F.when((id_ == 1) | (id_ % 9 == 0), 0).when(id_ % 11 == 0, -1).otherwise(F.floor(id_ / 2)).cast("int")
    lemma = F.when(form.isin("is", "are", "was"), "be").otherwise(form)
    label = F.when(F.length(form) % 7 == 0, "Identity").otherwise("O")
    return [lemma.alias("lemma"), pos.alias("pos"), ptb.alias("ptb"), head.alias("head"), label.alias("label")]


def unit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, copy): the words of a unit with its user and language, cut from the document's row without a shuffle."""
    rows = cutting.word_runs(lower_texts(spark, sf_dir, "source", "lang"), "text", WORDS_PER_UNIT, "words")
    copy = F.struct(F.col("source").alias("user_id"), "lang", "words")
    return rows.select((F.col("doc_id") * 100000 + F.col("part")).alias("unit_id"), copy.alias("copy"))


def _node_column(copy: Column) -> Column:
    return F.transform(
        copy["words"],
        lambda w, i: F.struct(
            (i + 1).cast("int").alias("id"), w.alias("form"), *token_shape(w, (i + 1).cast("int")),
            copy["user_id"].alias("user_id"), copy["lang"].alias("lang"),
        ),
    )


def _node_rows(copies: pa.StructArray) -> pa.ListArray:
    """``_node_column`` for an array of copies."""
    offsets, words = unit_rows.flat(copies.field("words"))
    unit = unit_rows.owners(offsets)
    of, texts = unit_rows.coded(words)
    length = unit_rows.numbers(pc.utf8_length(texts))[of]
    id_ = np.arange(len(of)) - offsets[:-1][unit] + 1
    k = (length + id_) % 6
    verb = np.where(length % 3 == 0, 3, 4)
    ptb = np.choose(k, [0, verb, np.where(length % 5 == 0, 6, 5), 1, 2, 7])
    head = np.where((id_ == 1) | (id_ % 9 == 0), 0, np.where(id_ % 11 == 0, -1, id_ // 2))
    lemma = _lemmas(texts)
    pick = lambda names, at: pa.array(names).take(pa.array(at))
    columns = {
        "id": pa.array(id_.astype(np.int32)), "form": words, "lemma": lemma.take(pa.array(of)), "pos": pick(TAGS, k),
        "ptb": pick(["NN", "DT", "NNP", "VBN", "VB", "JJ", "JJR", "PRP$"], ptb), "head": pa.array(head.astype(np.int32)),
        "label": pick(["O", "Identity"], (length % 7 == 0).astype(np.int64)),
    }
    columns |= {c: copies.field(c).take(pa.array(unit)) for c in ("user_id", "lang")}
    return unit_rows.listed(offsets, unit_rows.struct(columns))


def _node_kinds(copies: pa.StructArray) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """``unit_rows.token_kinds`` of an array of copies."""
    offsets, words = unit_rows.flat(copies.field("words"))
    of, texts = unit_rows.coded(words)
    id_ = np.arange(len(of)) - offsets[:-1][unit_rows.owners(offsets)] + 1
    proper = (unit_rows.numbers(pc.utf8_length(texts))[of] + id_) % 6 == TAGS.index("^")
    code = of.astype(np.int64) * 2 + proper
    seen = np.zeros(2 * len(texts), bool)
    seen[code] = True
    kind = np.flatnonzero(seen)
    forms = texts.take(pa.array(kind // 2))
    pos = pa.array(["N", "^"]).take(pa.array(kind % 2))
    return offsets, (np.cumsum(seen) - 1)[code], {"form": forms, "lemma": _lemmas(forms), "pos": pos}


def _lemmas(texts: pa.Array) -> pa.Array:
    return pc.if_else(pc.is_in(texts, value_set=pa.array(["is", "are", "was"])), "be", texts)


#: Tokens of a unit's words.
unit_nodes = unit_rows.Nodes(_node_column, _node_rows, _node_kinds)


TOKENS_SQL = """tok AS (
  SELECT unit_id, user_id, lang, id, form,
    CASE WHEN form IN ('is','are','was') THEN 'be' ELSE form END AS lemma, pos,
    CASE WHEN pos='N' THEN 'NN' WHEN pos='^' THEN 'NNP' WHEN pos='D' THEN 'DT' WHEN pos='S' THEN 'PRP$'
         WHEN pos='V' AND length(form)%3=0 THEN 'VBN' WHEN pos='V' THEN 'VB'
         WHEN length(form)%5=0 THEN 'JJR' ELSE 'JJ' END AS ptb,
    CASE WHEN id=1 OR id%9=0 THEN 0 WHEN id%11=0 THEN -1 ELSE id//2 END AS head,
    CASE WHEN length(form)%7=0 THEN 'Identity' ELSE 'O' END AS label
  FROM (SELECT doc_id*100000+(i-1)//24 AS unit_id, source AS user_id, lang, (i-1)%24+1 AS id, w AS form,
          (['N','V','A','D','^','S'])[CAST((length(w)+(i-1)%24+1)%6+1 AS INT)] AS pos FROM words))"""


# Phrase entries: pairs of words of at most three letters that occur often next
# to each other; such words are no identities.
PHRASE_RULE = 12


def phrase_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, id, idx, e, p, a of the entries of two words."""

    def build():
        t = matching.pair_counts(unit_words(spark, sf_dir), unit_forms, unit_blocks(spark, sf_dir)).where("length(one) <= 3 AND length(two) <= 3")
        n = t.select(F.concat_ws(" ", "one", "two").alias("term"), "n").where(F.col("n") >= PHRASE_RULE)
        e, p, a = epa(F.length("term"), F.ascii("term"), F.ascii(F.right("term", F.lit(1))))
        return n.select("term", F.concat(F.lit("z_"), "term").alias("id"), F.lit(None).cast("int").alias("idx"), (e + 0.0001).alias("e"), (p + 0.0001).alias("p"), (a + 0.0001).alias("a"))

    return kept("phrase_lexicon", spark, sf_dir, build)


def _form_rows(copies: pa.StructArray) -> pa.ListArray:
    offsets, words = unit_rows.flat(copies.field("words"))
    id_ = np.arange(len(words)) - offsets[:-1][unit_rows.owners(offsets)] + 1
    return unit_rows.listed(offsets, unit_rows.struct({"id": pa.array(id_.astype(np.int32)), "form": words}))


#: Id and form of the tokens of a unit's words.
unit_forms = unit_rows.Nodes(
    lambda copy: F.transform(copy["words"], lambda w, i: F.struct((i + 1).cast("int").alias("id"), w.alias("form"))), _form_rows
)


def unit_blocks(spark: SparkSession, sf_dir: str) -> int:
    """Blocks of units: one holds about half of a split of the documents, so it stays as large when there are more."""
    return 2 * max(table(spark, sf_dir, "documents").rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)


def known_forms(spark: SparkSession, sf_dir: str, unknown_only: bool, merged: bool, vocab) -> DataFrame:
    """Forms of the vocabulary in both lexicons; ``unknown_only`` keeps the identities that have no lexicon value."""
    tag = ("new_" if unknown_only else "") + ("merged_" if merged else "")

    def build():
        lex = lexicon(spark, sf_dir)
        ids = identities(spark, sf_dir).select("term", "id", "idx", "e", "p", "a")
        if unknown_only:
            ids = ids.join(lex.select("term"), "term", "left_anti")
        if merged:
            lex = lex.unionByName(phrase_lexicon(spark, sf_dir))
        found = kept(("merged_" if merged else "") + "vocab", spark, sf_dir, vocab)
        return matching.joint_forms({"id_forms": matching.match_vocabulary(found, ids), "sent_forms": matching.match_vocabulary(found, lex)})

    return kept(tag + "known_forms", spark, sf_dir, build)


def matched_units(spark: SparkSession, sf_dir: str, unknown_only: bool = False, merged: bool = False) -> DataFrame:
    """(unit_id, nodes): the tokens of ``matched_tokens`` as an array in their unit's row."""
    if merged:
        build = lambda: matching.merge_units(unit_words(spark, sf_dir), unit_nodes, phrase_lexicon(spark, sf_dir), unit_forms, unit_blocks(spark, sf_dir))
        u, nodes_of = kept("merged_units", spark, sf_dir, build).select("unit_id", F.col("nodes").alias("copy")), unit_rows.same_nodes()
    else:
        u, nodes_of = unit_words(spark, sf_dir), unit_nodes
    t = matching.token_kinds(u, nodes_of)
    known = known_forms(spark, sf_dir, unknown_only, merged, lambda: matching.vocabulary(t))
    blocks = unit_blocks(spark, sf_dir)
    # Jobs that match the same units again find the words of the blocks written.
    tag = ("new_" if unknown_only else "") + ("merged_" if merged else "")
    answers = kept(tag + "answers", spark, sf_dir, lambda: matching.block_answers(u, nodes_of, known, blocks))
    return matching.flag_units(matching.match_units(u, nodes_of, t, known, blocks, answers), STAND_IN_ADDRESS)


def matched_tokens(spark: SparkSession, sf_dir: str, unknown_only: bool = False, merged: bool = False) -> DataFrame:
    """Tokens with ``id_forms``, ``sent_forms``, ``negated``, ``is_address``, ``mention``.

    ``unknown_only`` keeps the identities that have no lexicon value;
    ``merged`` makes entries of two words one token before anything is matched.
    """
    return matching.unit_tokens(matched_units(spark, sf_dir, unknown_only, merged))


# Forms of address of the stand-in text: words next to other words.
STAND_IN_ADDRESS = (
    (("there", "them", "leau"), ("the", "of", "la"), ()),
    (("from", "ment", "leur"), ("and", "to", "en"), ("de", "in", "is")),
)

# SQL ladder for one-word tokens: text, text without s (whole-token rule, then
# the sub-word rule), lemma.
def ladder_sql(lexicon: str) -> str:
    return f"""(SELECT t.unit_id, t.id, coalesce(x0.term, x1.term, x2.term, x3.term) AS term
  FROM tok t LEFT JOIN {lexicon} x0 ON x0.term = t.form
  LEFT JOIN {lexicon} x1 ON t.form NOT IN ('is','does','was') AND right(t.form,1)='s' AND x1.term = left(t.form, length(t.form)-1)
  LEFT JOIN {lexicon} x2 ON length(t.form) > 3 AND right(t.form,1)='s' AND x2.term = left(t.form, length(t.form)-1)
  LEFT JOIN {lexicon} x3 ON x3.term = t.lemma
  WHERE coalesce(x0.term, x1.term, x2.term, x3.term) IS NOT NULL)"""


MATCHED_SQL = (
    LEXICONS_SQL + ",\n" + TOKENS_SQL
    + ",\nidm AS " + ladder_sql("idents") + ",\nsnm AS " + ladder_sql("lex")
    + """,
nbr AS (SELECT unit_id, id, lag(form) OVER w AS prev, lead(form) OVER w AS next FROM tok WINDOW w AS (PARTITION BY unit_id ORDER BY id)),
mt AS (
  SELECT t.*, i.term AS id_term, s.term AS sent_term, di.id AS id_id, ds.id AS sent_id, ds.e AS e, ds.p AS p, ds.a AS a,
    n.prev, n.next, t.form IN (""" + "{NEG}" + """) OR (right(t.form,1)='s' AND t.form NOT IN ('is','does','was') AND left(t.form,length(t.form)-1) IN (""" + "{NEG}" + """)) AS negated,
    coalesce((t.form IN ('there','them','leau') AND coalesce(n.prev IN ('the','of','la'), false))
     OR (t.form IN ('from','ment','leur') AND (coalesce(n.prev IN ('and','to','en'), false) OR coalesce(n.next IN ('de','in','is'), false))), false) AS is_address
  FROM tok t LEFT JOIN idm i USING (unit_id, id) LEFT JOIN snm s USING (unit_id, id) JOIN nbr n USING (unit_id, id)
  LEFT JOIN idents di ON di.term = i.term LEFT JOIN lex ds ON ds.term = s.term),
men AS (SELECT *, id_term IS NOT NULL AND (pos IN ('N','^','A','S','Z','#') OR left(ptb,1)='N') AND NOT is_address AS mention FROM mt)"""
)


MERGED_SQL = """pairs AS (SELECT term, length(term) AS len, ascii(term) AS c0, ascii(right(term, 1)) AS c1 FROM (
   SELECT a.form || ' ' || b.form AS term FROM tok0 a JOIN tok0 b ON b.unit_id = a.unit_id AND b.id = a.id + 1
   WHERE length(a.form) <= 3 AND length(b.form) <= 3 GROUP BY 1 HAVING count(*) >= {RULE})),
lex AS (SELECT * FROM lex0 UNION ALL SELECT term, 'z_' || term, e + 0.0001, p + 0.0001, a + 0.0001 FROM (SELECT term, {EPA} FROM pairs)),
hit AS (SELECT a.unit_id, a.id FROM tok0 a JOIN tok0 b ON b.unit_id = a.unit_id AND b.id = a.id + 1 JOIN pairs p ON p.term = a.form || ' ' || b.form),
run AS (SELECT *, id - row_number() OVER (PARTITION BY unit_id ORDER BY id) AS g FROM hit),
got AS (SELECT unit_id, id FROM (SELECT *, (id - min(id) OVER (PARTITION BY unit_id, g)) % 2 AS odd FROM run) WHERE odd = 0),
grp AS (SELECT t.*, CASE WHEN p.id IS NOT NULL THEN p.id ELSE t.id END AS g FROM tok0 t LEFT JOIN got p ON p.unit_id = t.unit_id AND p.id = t.id - 1),
mrg AS (SELECT unit_id, g, string_agg(form, ' ' ORDER BY id) AS form, string_agg(lemma, ' ' ORDER BY id) AS lemma, string_agg(pos, ' ' ORDER BY id) AS tags,
   arg_min(user_id, id) AS user_id, arg_min(lang, id) AS lang, arg_min(ptb, id) AS ptb, arg_min(label, id) AS label FROM grp GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY g) AS id FROM mrg),
lnk AS (SELECT c.unit_id, c.g, c.id, CASE WHEN c.head > 0 THEN coalesce(h.g, -1) ELSE c.head END AS hg FROM grp c LEFT JOIN grp h ON h.unit_id = c.unit_id AND h.id = c.head),
hd AS (SELECT unit_id, g, arg_min(hg, id) AS hg FROM lnk WHERE hg <> g GROUP BY ALL),
tok AS (SELECT n.unit_id, n.user_id, n.lang, n.id, n.form, n.lemma, right(n.tags, 1) AS pos, n.tags, n.ptb, n.label,
   CASE WHEN d.hg > 0 THEN x.id ELSE d.hg END AS head
  FROM numbered n LEFT JOIN hd d USING (unit_id, g) LEFT JOIN numbered x ON x.unit_id = n.unit_id AND x.g = d.hg)""".replace("{RULE}", str(PHRASE_RULE)).replace("{EPA}", EPA_SQL)


def matched_sql(unknown_only: bool = False, merged: bool = False) -> str:
    """CTEs up to ``men``; with ``merged`` its ``pos`` is the last tag, and ``tags`` has all of them."""
    quoted = ",".join("'" + w.replace("'", "''") + "'" for w in NEGATION_WORDS)
    sql = MATCHED_SQL.replace("{NEG}", quoted)
    if unknown_only:
        # The same ids, without the identities of the lexicon.
        sql = sql.replace("idents AS (", "every AS (", 1).replace(
            ",\ntok AS (", ",\nidents AS (SELECT * FROM every WHERE term NOT IN (SELECT term FROM lex)),\ntok AS (", 1
        )
    if merged:
        rest = sql[sql.index(",\nidm AS ") :]
        sql = LEXICONS_SQL.replace(",\nlex AS (", ",\nlex0 AS (") + ",\n" + TOKENS_SQL.replace("tok AS (", "tok0 AS (", 1) + ",\n" + MERGED_SQL + rest
    return sql


# Letters that stand for emoji, with their values; emoticons are the lexicon's
# words of three letters and hashtags those of five.
STAND_IN_EMOJI = {"é": 1.75, "ü": -2.25, "ß": -0.5, "ñ": 2.5, "ç": -1.25, "ö": 0.75}


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the symbols of tokens that are no mentions."""

    def build():
        lex = lexicon(spark, sf_dir)
        emoji = spark.createDataFrame(list(STAND_IN_EMOJI.items()), "symbol string, value double")
        emoticons = lex.where("length(term) = 3").select(F.col("term").alias("symbol"), F.col("e").alias("value"))
        # Read five times below.
        free = matched_tokens(spark, sf_dir).where("not mention").select("unit_id", "id", "form", "lemma", "pos")
        free = kept("free_tokens", spark, sf_dir, lambda free=free: free)
        pattern = "[" + "".join(STAND_IN_EMOJI) + "]"
        return matching.symbol_values(free, pattern, emoji, emoticons, lex.where("length(term) = 5"))

    return kept("symbols", spark, sf_dir, build)


def _symbol_ladder_sql(length: int) -> str:
    lexicon = f"(SELECT * FROM lex WHERE length(term) = {length})"
    ladder = ladder_sql(lexicon).replace("FROM tok t", "FROM (SELECT * FROM men WHERE NOT mention) t")
    return f"(SELECT x.unit_id, x.id, l.e, l.p, l.a FROM {ladder} x JOIN lex l USING (term))"


SYMBOLS_SQL = f"""sym AS (
  SELECT unit_id, id, 'emoji' AS source, CASE s {" ".join(f"WHEN '{k}' THEN {v}" for k, v in STAND_IN_EMOJI.items())} END AS e,
    CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS a
  FROM (SELECT unit_id, id, unnest(regexp_extract_all(form, '[{"".join(STAND_IN_EMOJI)}]')) AS s FROM men WHERE NOT mention)
  UNION ALL SELECT unit_id, id, 'emoticon', e, NULL, NULL FROM {_symbol_ladder_sql(3)}
  UNION ALL SELECT unit_id, id, 'hashtag', e, p, a FROM {_symbol_ladder_sql(5)})"""

"""Line dedup by a log-template tree, in DataFrame operations only.

A line's tokens, those with a digit masked as ``<*>``, lead it down a tree of fixed depth: first by their number, then by
the first ``LEADING`` tokens. In a leaf whose lines differ, each position keeps its token if more than half of the leaf's
lines (weighted by documents) have it there, and becomes ``<*>`` if not. A line whose tokens after the leading ones agree
with that template on at least ``SIMILARITY`` of the positions belongs to it; any other is a template of its own.

A leaf generalises to one template at most: where no token has more than half of the weight at any position, as with two
templates of equal weight in one leaf, its lines stay templates of their own.

Whole texts and lines are told apart by two 64-bit hashes of different seeds together, as lines at full scale are too many
for one. A leaf is one such hash: leaves that collide lose at most their general template.

A template that ``MIN_DOCS`` different texts share is recurring. Its lines are dropped from all documents but the one with
the smallest doc_id (and exact copies of that one, which are left to document dedup), so that no content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, only, small, written

LEADING, SIMILARITY, MIN_DOCS = 3, 0.6, 2

#: Constant tokens up to which the leaves' lists are broadcast.
BROADCAST_TOKENS = 500_000

_BLANKS = " \t\r\f\x0b"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def _spaced(line: Column) -> Column:
    """The line's tokens, one space between them. Only lines with other blanks, or several, meet a regular expression."""
    odd = line.contains("  ")
    for c in _BLANKS[1:]:
        odd = odd | line.contains(c)
    return F.when(odd, F.regexp_replace(_bare(line), r"[ \t\r\f\x0B]+", " ")).otherwise(_bare(line))


def _masked(line: Column) -> Column:
    """The tokens of a line, masked. Only lines with a digit are looked at token by token."""
    tokens = F.split(line, " ")
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))).otherwise(tokens)


def _identity(c: Column) -> Column:
    """128 bits that stand for a value."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (stands for the whole text), pos, line (spaced) and leaf of each line with a token.

    The number of tokens and the leading ones are found without splitting the line.
    """
    # The hash of the text comes before the lines: beside a generator it would be taken anew for each line.
    whole = only(docs, "doc_id", "text").where("text is not null").withColumn("th", _identity(F.col("text")))
    base = whole.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = base.where(_bare(F.col("line")) != "").select("doc_id", "th", "pos", _spaced(F.col("line")).alias("line"))
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return lines.withColumn("leaf", F.xxhash64(blanks, _masked(F.substring_index("line", " ", LEADING))))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th and drop (positions, ascending) of every row of ``docs`` that loses lines."""
    lines = _lines(docs)
    leaves = lines.select("leaf", "th").distinct().groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs).select("leaf")
    leaves = written(leaves, "line-leaves")
    masked = lines.join(small(leaves), "leaf").select("doc_id", "th", "pos", "leaf", _masked(F.col("line")).alias("tokens"))
    found = written(masked.select("doc_id", "th", "pos", "leaf", _identity(F.col("tokens")).alias("line"), F.transform(F.slice("tokens", F.lit(LEADING + 1), F.size("tokens")), lambda t: F.xxhash64(t)).alias("tail")), "line-found")
    discard(leaves)

    forms = found.groupBy("leaf", "line", "th").agg(F.first("tail").alias("tail")).groupBy("leaf", "line").agg(F.count("*").alias("w"), F.first("tail").alias("tail"))
    forms = written(forms, "line-forms")
    several = forms.groupBy("leaf").agg(F.sum("w").alias("all"), F.count("*").alias("forms")).where("forms > 1").select("leaf", "all")
    several = written(several, "line-several")
    spread = forms.where(F.size("tail") > 0).join(small(several), "leaf").select("leaf", "all", "w", F.posexplode("tail").alias("at", "token"))
    constant = spread.groupBy("leaf", "at", "token").agg(F.sum("w").alias("w"), F.first("all").alias("all")).where("2 * w > all")
    # At most one token a position is constant, so a leaf's list is no longer than one of its lines.
    constants = written(constant.groupBy("leaf").agg(F.collect_list(F.struct("at", "token")).alias("constants")), "line-constants")
    tokens = constants.agg(F.coalesce(F.sum(F.size("constants")), F.lit(0))).head()[0]
    whole = forms.where(F.size("tail") > 0).join(small(constants) if tokens <= BROADCAST_TOKENS else constants, "leaf")
    same = F.aggregate("constants", F.lit(0), lambda n, c: n + F.when(F.get("tail", c["at"]) == c["token"], 1).otherwise(0))
    agree = whole.where(same >= F.lit(similarity) * F.size("tail")).select("leaf", "line", F.lit(True).alias("general"))
    # Written first: a line that a third of all documents has is then split by the skew join, or not shuffled at all.
    agree = written(agree, "line-agree")
    discard(forms, several, constants)
    placed = found.select("doc_id", "th", "pos", "leaf", "line").join(small(agree), ["leaf", "line"], "left")
    named = placed.select("doc_id", "th", "pos", F.when(F.col("general"), F.struct(F.col("leaf").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.col("line")).alias("template"))
    named = written(named, "line-named")
    discard(found, agree)

    first = named.groupBy("template", "th").agg(F.min("doc_id").alias("doc_id")).groupBy("template").agg(F.count("*").alias("texts"), F.min(F.struct("doc_id", "th")).alias("first"))
    often = written(first.where(F.col("texts") >= min_docs).select("template", F.col("first.th").alias("keeper")), "line-often")
    dropped = named.join(small(often), "template").where("th <> keeper").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    dropped = written(dropped, "line-drops")
    discard(named, often)
    return dropped


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with recurring lines taken out of text, and n_lines and n_dropped (long).

    Null texts stay null (0 lines); a text that loses all its lines becomes empty. Lines without a token are never
    dropped. Rows that repeat a doc_id and text lose the same lines; a null doc_id is one more value, the smallest.
    Other columns pass through, but for ones that are themselves called n_lines or n_dropped, which are replaced.
    """
    drops = recurring_lines(docs, min_docs, similarity).select(F.col("doc_id").alias("_lt_doc"), F.col("th").alias("_lt_th"), F.col("drop").alias("_lt_drop"))
    joined = docs.join(small(drops), F.col("doc_id").eqNullSafe(F.col("_lt_doc")) & (_identity(F.col("text")) == F.col("_lt_th")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("_lt_drop", F.array().cast("array<int>")), i))
    text = F.when(F.col("_lt_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("_lt_drop").isNull(), 0).otherwise(F.size("_lt_drop")).cast("long").alias("n_dropped"),
    )


def op5_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and an MD5 of what remains of each whole document."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, i - 1 AS pos, string_split_regex(regexp_replace(parts[i], '^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$', '', 'g'), '[ \t\r\f\x0B]+') AS tok
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), range(1, len(parts) + 1) r(i)),
masked AS (SELECT doc_id, text, pos, list_transform(tok, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tok FROM lines WHERE tok[1] <> ''),
placed AS (SELECT *, [len(tok)::VARCHAR] || tok[1:3] AS leaf FROM masked),
leaves AS (SELECT leaf FROM placed GROUP BY leaf HAVING count(DISTINCT text) >= 2),
found AS (SELECT p.* FROM placed p JOIN leaves USING (leaf)),
forms AS (SELECT leaf, tok, count(DISTINCT text) AS w FROM found GROUP BY leaf, tok),
several AS (SELECT leaf, sum(w) AS every FROM forms GROUP BY leaf HAVING count(*) > 1),
spread AS (SELECT leaf, tok, w, every, i AS spot, tok[i] AS token FROM (SELECT * FROM forms JOIN several USING (leaf)), range(4, len(tok) + 1) r(i)),
constant AS (SELECT leaf, spot, token FROM spread GROUP BY leaf, spot, token, every HAVING 2 * sum(w) > every),
agree AS (SELECT leaf, tok FROM spread JOIN constant USING (leaf, spot, token) GROUP BY leaf, tok HAVING count(*) >= 0.6::DOUBLE * (len(tok) - 3)),
named AS (SELECT f.doc_id, f.text, f.pos, CASE WHEN a.leaf IS NULL THEN ['line'] || f.tok ELSE ['leaf'] || f.leaf END AS template FROM found f LEFT JOIN agree a ON f.leaf = a.leaf AND f.tok = a.tok),
often AS (SELECT template, arg_min(text, doc_id) AS keeper FROM named GROUP BY template HAVING count(DISTINCT text) >= 2),
dropped AS (SELECT DISTINCT doc_id, pos FROM named JOIN often USING (template) WHERE text <> keeper),
rest AS (SELECT l.doc_id, count(d.pos) AS n_dropped, coalesce(string_agg(CASE WHEN d.pos IS NULL THEN l.part END, chr(10) ORDER BY l.pos), '') AS kept, count(*) AS n_lines
  FROM (SELECT doc_id, i - 1 AS pos, parts[i] AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), range(1, len(parts) + 1) r(i)) l
  LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_dropped, 0)::BIGINT AS n_dropped, md5(coalesce(r.kept, '')) AS kept_md5
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id
"""

"""Merkle trees over the sections, paragraphs and sentences of a text, in Spark functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.llm.common import stored, text_of

#: A leaf ends with the marks that end a sentence or line, or after this many code points without one.
LEAF = 80
LEAVES = f"[^.!?\\n]{{0,{LEAF}}}[.!?\\n]+|[^.!?\\n]{{1,{LEAF}}}"
#: Where no empty line does, a section ends with the paragraphs whose hash is below this; an eighth of them.
SECTION_END = "2"
#: Hexadecimal digits of a hash that a fingerprint carries for each section, paragraph and leaf.
DIGITS = 12
_COPIES = 1_000


def _hash(level: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), text).cast("binary"), 256)


def _with_runs(rows: DataFrame, items: str, ends, out: str) -> DataFrame:
    """``rows`` with ``out``: the array ``items`` cut after those for which ``ends`` holds, an array of arrays."""
    marks = F.transform(items, lambda x, i: F.when(ends(x) | (i == F.size(F.col(items)) - 1), i + 1))
    # the ends are a column of their own: inside the next function they would be computed again for each run
    rows = rows.withColumn("_ends", F.array_compact(marks))
    rows = rows.withColumn("_starts", F.concat(F.array(F.lit(0)), F.col("_ends")))
    run = lambda end, k: F.slice(items, F.get("_starts", k) + 1, end - F.get("_starts", k))
    return rows.withColumn(out, F.transform("_ends", run))


def with_tree(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with a struct ``name`` of root and fingerprint of the column ``text``.

    Leaves are the sentences, paragraphs the lines, sections runs of paragraphs up to an empty line or to a paragraph that its hash
    chooses, so an edit moves few borders. A hash covers the level and the hashes below it, so roots are equal where texts are.
    """
    # one column a level: each is used more than once, so Spark keeps them apart
    leaf = lambda x: F.struct(
        _hash("leaf:", x).alias("h"), x.endswith("\n").alias("line"), (x.endswith("\n\n")).alias("blank")
    )
    out = rows.withColumn("_leaves", F.transform(F.regexp_extract_all(F.col(text), F.lit(LEAVES), F.lit(0)), leaf))
    out = _with_runs(out, "_leaves", lambda x: x["line"], "_lines")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["h"]), ",")
    short = lambda xs: F.array_join(F.transform(xs, lambda x: F.left(x["h"], F.lit(DIGITS))), ",")
    paragraph = lambda xs: F.struct(
        _hash("paragraph:", joined(xs)).alias("h"), F.element_at(xs, -1)["blank"].alias("blank"), short(xs).alias("below")
    )
    out = out.withColumn("_paragraphs", F.transform("_lines", paragraph))
    out = _with_runs(out, "_paragraphs", lambda x: x["blank"] | (x["h"] < SECTION_END), "_runs")
    lines = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.left(x["h"], F.lit(DIGITS)), F.lit(":"), x["below"])), ";")
    section = lambda xs: F.struct(_hash("section:", joined(xs)).alias("h"), lines(xs).alias("below"))
    out = out.withColumn("_sections", F.transform("_runs", section))
    root = _hash("text:", joined(F.col("_sections")))
    parts = F.transform("_sections", lambda s: F.concat(F.left(s["h"], F.lit(DIGITS)), F.lit("="), s["below"]))
    out = out.withColumn(name, F.array_join(F.concat(F.array(root), parts), "|"))
    return out.drop("_leaves", "_lines", "_paragraphs", "_runs", "_sections", "_ends", "_starts")


def root_of(fingerprint: Column) -> Column:
    """The hash of the whole text; equal where texts are equal."""
    return F.left(fingerprint, F.lit(64))


def leaves_of(fingerprint: Column) -> Column:
    """The distinct leaf hashes that a fingerprint carries."""
    return F.array_distinct(F.regexp_extract_all(fingerprint, F.lit(f"[:,]([0-9a-f]{{{DIGITS}}})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common leaves of two arrays by those of both, 0 to 1; two texts without leaves are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing(a: Column, b: Column) -> Column:
    """Where the text of fingerprint ``a`` differs from that of ``b``: structs of section, paragraph and leaf, counted from 0.

    Descends only into sections, and in these paragraphs, whose hash the other tree does not have. Equal roots give an empty array.
    """
    node = lambda x, mark: F.substring_index(x, mark, 1)
    sections = lambda x: F.slice(F.split(x, "\\|"), 2, F.greatest(F.size(F.split(x, "\\|")) - 1, F.lit(0)))
    paragraphs = lambda x: F.split(F.substring_index(x, "=", -1), ";")
    others = lambda marks: F.regexp_extract_all(b, F.lit(f"{marks}([0-9a-f]{{{DIGITS}}})"), F.lit(1))
    theirs, lines, leaves = others("[|]"), others("[=;]"), others("[:,]")

    def of_paragraph(s, p, j):
        found = F.transform(F.split(F.substring_index(p, ":", -1), ","), lambda x, k: F.struct(s.alias("section"), j.alias("paragraph"), k.alias("leaf"), x.alias("h")))
        kept = F.filter(found, lambda x: ~F.array_contains(leaves, x["h"]))
        return F.when(F.array_contains(lines, node(p, ":")), F.filter(found, lambda x: F.lit(False))).otherwise(kept)

    def of_section(s, i):
        inside = F.flatten(F.transform(paragraphs(s), lambda p, j: of_paragraph(i, p, j)))
        return F.when(F.array_contains(theirs, node(s, "=")), F.filter(inside, lambda x: F.lit(False))).otherwise(inside)

    return F.flatten(F.transform(sections(a), of_section))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row of ``docs``.

    A fingerprint is the root, then for each section ``|hash=``, for each of its paragraphs ``hash:`` and its leaf hashes with commas, paragraphs apart by
    ``;``. Null text is empty text, whose fingerprint is a root alone. Ids are only carried; repeated rows and null ids each get
    their own row; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("_text"))
    return with_tree(rows, "_text", "fingerprint").select("id", "fingerprint")


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, content, id, n, copies, before_key, before_content, before_n) of each distinct document: the one before it in ascending id.

    Sorted by range; what a part needs of the part before it comes from a table with one row for each part. The first follows the last.
    """
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("content"), F.length(text).cast("bigint").alias("n"))
    rows = rows.withColumn("key", F.xxhash64("id", "content"))
    rows = rows.groupBy("id", "key", "content", "n").agg(F.count("*").alias("copies"))
    order = ["id", "content"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "order").withColumn("part", F.shiftright("place", 33))
    me = F.struct("key", "content", "n")
    ends = rows.groupBy("part").agg(F.max_by(me, "place").alias("end"))
    wrapped = F.max_by("end", "part").over(Window.partitionBy(F.lit(0)))
    ends = ends.select(F.col("part"), F.coalesce(F.lag("end").over(Window.orderBy("part")), wrapped).alias("end_before"))
    inside = F.lag(me).over(Window.partitionBy("part").orderBy("place"))
    before = F.coalesce("inside", "end_before")
    out = rows.withColumn("inside", inside).join(F.broadcast(ends), "part")
    fields = [before[f].alias(f"before_{f}") for f in ("key", "content", "n")]
    return stored(out.select("key", "content", "id", "copies", "n", *fields), "neighbours")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    ``edited`` is the text whose last quarter (of code points, rounded down) is replaced by as many of the first ones of the next
    document, or all of them if it is shorter. Next is the next larger id; the first follows the last, and a single document itself. Rows without an id come before
    all others, rows of one id in the order of a hash of their text, and rows with equal id and text are one document of that order, with a result each.
    Null text is empty text; an empty table gives no rows; other columns are not read.

    Texts are shuffled once, by document; of the next document travel its first code points and its leaf hashes.
    """
    order = _ordered(docs, id_col, text_col)
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("content"))
    on = ["key", "content"]
    # both uses need the text alone, so they share this shuffle
    distinct = rows.select(F.xxhash64("id", "content").alias("key"), "content", "text").groupBy(*on).agg(F.first("text").alias("text"))
    known = with_tree(distinct.join(order.hint("merge"), on), "text", "fingerprint")
    quarter = lambda n: F.floor(F.col(n) / 4).cast("int")
    heads = known.select(
        F.col("before_key").alias("key"), F.col("before_content").alias("content"), F.left("text", quarter("before_n")).alias("head"),
        leaves_of(F.col("fingerprint")).alias("next_leaves"),
    )
    both = known.select(*on, "id", "text", "n", "copies", "fingerprint").join(heads.hint("merge"), on)
    own = F.left("text", (F.col("n") - quarter("n")).cast("int"))
    both = with_tree(both.withColumn("edited", F.concat(own, "head")), "edited", "edited_fingerprint")
    both = both.withColumn("leaves", leaves_of(F.col("fingerprint")))
    out = both.select(
        "id", F.col("n").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), leaves_of(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"), "copies",
    )
    if order.where("copies > 1").isEmpty():
        return out.drop("copies")
    # a row that is repeated very often is dealt out in groups of copies before it is repeated
    again = out.where("copies > 1").withColumn("group", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _COPIES))))
    again = again.repartition("id", "group").withColumn("copies", F.least(F.lit(_COPIES), F.col("copies") - F.col("group") * _COPIES))
    again = again.withColumn("one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return out.where("copies = 1").drop("copies").unionByName(again.drop("copies", "group", "one"))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``docs``."""
    rows = edited_fingerprints(docs)
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return rows.select(F.col("id").alias("doc_id"), "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(doc_id) OVER w, min(doc_id) OVER ()) AS next_id,
  coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next
  FROM d WINDOW w AS (ORDER BY doc_id)),
x AS (SELECT doc_id, 0 AS e, text FROM o UNION ALL SELECT doc_id, 1, substr(text, 1, n - n // 4) || substr(next, 1, n // 4) FROM o),
c AS (SELECT doc_id, e, regexp_extract_all(text, '{LEAVES}') AS found FROM x),
l AS (SELECT doc_id, e, unnest(found) AS s, unnest(range(len(found))) AS i FROM c),
h AS (SELECT doc_id, e, i, sha256('leaf:' || s) AS h, s[-1:] = chr(10) AS line, s[-2:] = chr(10) || chr(10) AS blank FROM l),
g AS (SELECT *, coalesce(sum(line::INT) OVER (PARTITION BY doc_id, e ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM h),
q AS (SELECT doc_id, e, p, sha256('paragraph:' || string_agg(h, ',' ORDER BY i)) AS h, max_by(blank, i) AS blank,
  string_agg(h[:{DIGITS}], ',' ORDER BY i) AS below FROM g GROUP BY ALL),
r AS (SELECT *, coalesce(sum((blank OR h < '{SECTION_END}')::INT) OVER (PARTITION BY doc_id, e ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM q),
k AS (SELECT doc_id, e, s, sha256('section:' || string_agg(h, ',' ORDER BY p)) AS h, string_agg(h[:{DIGITS}] || ':' || below, ';' ORDER BY p) AS below FROM r GROUP BY ALL),
t AS (SELECT doc_id, e, sha256('text:' || string_agg(h, ',' ORDER BY s)) || string_agg('|' || h[:{DIGITS}] || '=' || below, '' ORDER BY s) AS f FROM k GROUP BY ALL),
v AS (SELECT doc_id, e, list(DISTINCT h[:{DIGITS}]) AS v FROM h GROUP BY ALL),
a AS (SELECT x.doc_id, x.e, sha256(x.text) AS sha, coalesce(t.f, sha256('text:')) AS f, coalesce(v.v, []) AS v
  FROM x LEFT JOIN t ON x.doc_id = t.doc_id AND x.e = t.e LEFT JOIN v ON x.doc_id = v.doc_id AND x.e = v.e)
SELECT o.doc_id, o.n AS n_chars, y.sha AS edited_sha256, m.f AS fingerprint, y.f AS edited_fingerprint,
  CASE WHEN len(m.v) + len(y.v) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(m.v, y.v)) / (len(m.v) + len(y.v)) END::DOUBLE AS near_edited,
  CASE WHEN len(m.v) + len(z.v) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(m.v, z.v)) / (len(m.v) + len(z.v)) END::DOUBLE AS near_next
FROM o JOIN a m ON m.doc_id = o.doc_id AND m.e = 0 JOIN a y ON y.doc_id = o.doc_id AND y.e = 1 JOIN a z ON z.doc_id = o.next_id AND z.e = 0
"""

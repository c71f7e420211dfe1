"""Licence scans: canonical digest lookup, in DataFrame operations only.

A text is made canonical (case, copyright lines, equivalent spellings, punctuation, white space)
and hashed as a whole; a hash join with the digests of known licences names it.  Beside that, whole
lines that open as notices do ("licensed under the ...") are looked up by the digest of the name that
follows.  Both sides go through the same expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.licence_texts import DIGESTS, LICENCES, NAMES

#: Lines that only state a copyright, after a possible comment sign; before letters are made small, as
#: a capital parts names from sentences on copyright.
COPYRIGHT_LINE = (
    r"(?m)^[^A-Za-z0-9\n]*(?:(?i:copyright [(]c[)]|copyright [0-9]|copyright ©|[(]c[)] |©|all rights reserved)|Copyright [A-Z])[^\n]*$"
)
#: Spellings that licence matching guidelines hold equal, in the order of replacement.
SPELLINGS = [
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("organisation", "organization"),
    ("sub-license", "sublicense"),
    ("utilisation", "utilization"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("https://", "http://"),
]
#: A line that says nothing else, in small letters.
RESERVED_LINE = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
#: How the canonical form of a notice opens; what follows is the licence's name.
OPENING = (
    "^(?:(?:this|the) [a-z]+ (?:is|are) )?(?:re)?(?:licensed|released|distributed|published|available|provided|shared) "
    "under (?:the )?(?:terms of )?(?:the )?(.+)$"
)
SPDX = "^spdx license identifier (.+)$"
#: Letters that a line with either opening has; others aren't made canonical.
_SIGNS = ("under", "spdx")
#: What isn't a small letter, a digit or a character beyond ASCII.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """Small letters, digits and characters beyond ASCII, in words parted by one space."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, " "))
    for other, plain in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(plain))
    return F.btrim(F.regexp_replace(out, PUNCTUATION, " "), F.lit(" "))


def _digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A fixed list as a table."""
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(c.replace(' ', ':') for c in schema.split(', '))}>>")
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


def _name(line: Column) -> Column:
    """What follows a notice's opening in a canonical line; empty if it doesn't open as one."""
    return F.concat(F.regexp_extract(line, OPENING, 1), F.regexp_extract(line, SPDX, 1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, licence, notices, n_notice_lines, n_reserved_lines) for every row of ``docs``.

    ``licence`` is the known licence that the entire text is, else null; ``notices`` are the
    licences, sorted, whose notice is an entire line of the text, and ``n_notice_lines`` counts
    such lines; ``n_reserved_lines`` counts the lines that only say "All rights reserved".  Texts
    of equal canonical form have one digest, so there are no ties.  Null texts count as empty and
    match nothing; a long text is one value of its row; repeated rows give repeated results; an
    empty table gives no rows; ids have any type; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spark = docs.sparkSession
    texts = [{"licence": i, "text": t} for i, t in LICENCES] + [{"licence": i, "digest": d} for i, d in DIGESTS]
    known = _rows(spark, texts, "licence string, text string, digest string")
    known = known.select(F.coalesce("digest", _digest(F.col("text"))).alias("known"), "licence").distinct()
    names = _rows(spark, [{"licence": i, "name": n} for i, n in NAMES], "licence string, name string")
    # a fixed list, whatever the documents
    named = {r["digest"]: r["licence"] for r in names.select(_digest(F.col("name")).alias("digest"), "licence").collect()}
    notice_of = F.from_json(F.lit(json.dumps(named)), "map<string,string>")  # constant: folded into the plan
    signs = [lambda x, s=s: F.contains(F.lower(x), F.lit(s)) for s in _SIGNS]
    lines = F.filter(F.split(text, "\n"), lambda x: signs[0](x) | signs[1](x))
    name = F.transform(lines, lambda x: _name(canonical(x)))
    found = F.transform(F.filter(name, lambda x: x != ""), lambda x: F.try_element_at(notice_of, F.sha2(x, 256)))
    return (
        docs.select(
            F.col(id_col).alias("id"),
            _digest(text).alias("digest"),
            F.filter(found, lambda x: x.isNotNull()).alias("hits"),
            F.regexp_count(F.lower(text), F.lit(RESERVED_LINE)).cast("long").alias("n_reserved_lines"),
        )
        .join(F.broadcast(known), F.col("digest") == F.col("known"), "left")  # a fixed list
        .select(
            "id",
            "digest",
            "licence",
            F.sort_array(F.array_distinct("hits")).alias("notices"),
            F.size("hits").cast("long").alias("n_notice_lines"),
            "n_reserved_lines",
        )
    )


def oracle(table: str) -> str:
    """DuckDB SQL for :func:`scan` over ``table``, with notices joined by commas."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canonical_sql(x: str) -> str:
        out = f"lower(regexp_replace({x}, {quoted(COPYRIGHT_LINE)}, ' ', 'g'))"
        for other, plain in SPELLINGS:
            out = f"replace({out}, {quoted(other)}, {quoted(plain)})"
        return f"trim(regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g'), ' ')"

    def digest(x: str) -> str:
        return f"sha256({canonical_sql(x)})"

    def values(texts: list[tuple[str, str]]) -> str:
        return ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in texts)

    def named(x: str) -> str:
        return f"regexp_extract({x}, {quoted(OPENING)}, 1) || regexp_extract({x}, {quoted(SPDX)}, 1)"

    return f"""
WITH known AS (SELECT id, {digest("t")} AS d FROM (VALUES {values(LICENCES)}) AS k(id, t)
               UNION SELECT * FROM (VALUES {values(DIGESTS)}) AS g(id, d)),
notice AS (SELECT DISTINCT id, {digest("t")} AS d FROM (VALUES {values(NAMES)}) AS k(id, t)),
line AS (SELECT doc_id, {canonical_sql("x")} AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM {table})),
hit AS (SELECT doc_id, id FROM line JOIN notice ON sha256({named("x")}) = notice.d),
per AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices, count(*) AS n
        FROM hit GROUP BY doc_id),
doc AS (SELECT doc_id, {digest("coalesce(text, '')")} AS digest,
               len(regexp_extract_all(lower(coalesce(text, '')), {quoted(RESERVED_LINE)})) AS n_reserved_lines FROM {table})
SELECT doc.doc_id, digest, known.id AS licence, coalesce(notices, '') AS notices,
       coalesce(n, 0) AS n_notice_lines, n_reserved_lines
FROM doc LEFT JOIN known ON digest = known.d LEFT JOIN per ON per.doc_id = doc.doc_id
"""

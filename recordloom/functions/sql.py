"""Functions that SQL can call: the normal forms of codes, titles, bodies and times, and pages as tables of nodes.

The scalar ones are SQL expressions that Catalyst inlines, so a query in SQL has the plan that the same query in columns
has.  `parse_html` is a table function over one page; it yields rows as it is asked for them.
"""

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from recordloom.dom import nodes

#: name -> parameters, type and body, each equal to the column function of the same purpose
SCALARS = {
    "normal_code": ("c STRING", "STRING", r"upper(CASE WHEN regexp_extract(trim(c), '^([A-Za-z]+)\\s*(\\d+[A-Za-z]?)', 1) <> '' THEN concat_ws(' ', regexp_extract(trim(c), '^([A-Za-z]+)\\s*(\\d+[A-Za-z]?)', 1), regexp_extract(trim(c), '^([A-Za-z]+)\\s*(\\d+[A-Za-z]?)', 2)) ELSE trim(c) END)"),
    "strip_footnotes": ("c STRING", "STRING", r"trim(BOTH ' \t\n\u000B\f\r' FROM regexp_replace(c, '[\\s*†‡+^]+$', ''))"),
    "folded": ("c STRING", "STRING", r"replace(lower(trim(regexp_replace(c, '(?U)\\s+', ' '))), 'ß', 'ss')"),
    "clock_minutes": ("c STRING", "INT", r"CASE WHEN c RLIKE '^\\s*[+-]?\\d+\\s*:\\s*[+-]?\\d+\\s*$' THEN try_cast(regexp_extract(c, '^\\s*([+-]?\\d+)\\s*:\\s*([+-]?\\d+)\\s*$', 1) AS INT) * 60 + try_cast(regexp_extract(c, '^\\s*([+-]?\\d+)\\s*:\\s*([+-]?\\d+)\\s*$', 2) AS INT) END"),
    "academic_year": ("term STRING", "STRING", r"concat(CAST(try_cast(regexp_extract(term, '^(\\d{4})\\d$', 1) AS INT) AS STRING), '-', substring(CAST(try_cast(regexp_extract(term, '^(\\d{4})\\d$', 1) AS INT) + 1 AS STRING), 3, 2))"),
}


class ParseHtml:
    """Rows of the node table of one page; none for null."""

    def eval(self, html: str) -> Iterator[tuple]:
        names = [c.split()[0] for c in nodes.SCHEMA.split(", ")]
        for row in nodes.parse(html):
            yield tuple(row[n] for n in names)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to this session's SQL; their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("parse_html", udtf(ParseHtml, returnType=nodes.SCHEMA, useArrow=True))
    return [*SCALARS, "parse_html"]

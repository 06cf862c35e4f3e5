"""Sinks: Markdown and HTML documents as columns, written one file per row, and the report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.text import slug


def markdown(title: Column, body: Column, url: Column, meta: dict[str, Column] | None = None) -> Column:
    """A document with a heading, its non-empty fields, its address and the body."""
    fields = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"- **{k}:** "), v.cast("string"))) for k, v in (meta or {}).items()]
    parts = [F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), F.lit(""), *fields, F.concat(F.lit("- **Izvor:** "), F.coalesce(url, F.lit(""))), F.lit(""), F.lit("---"), F.lit(""), F.trim(F.coalesce(body, F.lit(""))), F.lit("")]
    return F.concat_ws("\n", *parts)


def escaped(text: Column) -> Column:
    """HTML of a plain text, with its addresses as links."""
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.regexp_replace(text, "(https?://[^\\s<]+)", '<a href="$1">$1</a>')


def html(md: Column) -> Column:
    """HTML of a Markdown document's headings, list items, rules and paragraphs."""

    def line(s: Column) -> Column:
        bold = lambda x: F.regexp_replace(escaped(x), "\\*\\*(.+?)\\*\\*", "<b>$1</b>")
        level = F.length(F.regexp_extract(s, "^(#{1,6}) ", 1)).cast("string")
        head = F.concat(F.lit("<h"), level, F.lit(">"), bold(F.regexp_replace(s, "^#{1,6} ", "")), F.lit("</h"), level, F.lit(">"))
        return F.when(s.rlike("^#{1,6} "), head).when(s.rlike("^-{3,}$"), "<hr>").when(s.startswith("- "), F.concat(F.lit("<li>"), bold(F.substr(s, F.lit(3))), F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), bold(s), F.lit("</p>")))

    return F.array_join(F.transform(F.filter(F.split(F.coalesce(md, F.lit("")), "\n"), lambda s: F.trim(s) != ""), line), "\n")


def write_documents(docs: DataFrame, folder: str, name: str, content: str) -> None:
    """A folder per slug of the name column with the content column's text in it; a run that is repeated replaces them."""
    docs.select(F.col(content).alias("value"), slug(F.col(name)).alias("name")).write.mode("overwrite").partitionBy("name").text(folder)


def report(title: str, rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small result; most is the number of rows that a report may have."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda xs: "| " + " | ".join(str(x) for x in xs) + " |"
    return "\n".join([f"# {title}", "", line(rows.columns), line(["---"] * len(rows.columns)), *(line(r) for r in found), ""])

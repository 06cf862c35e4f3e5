"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with their base letter. The letter with a stroke keeps its stroke, as the index's tokenizer keeps it.
MARKED = "áàâäãåçčćéèêëíìîïñóòôöõšúùûüýž"
PLAIN = "aaaaaaccceeeeiiiinooooosuuuuyz"
# Month names in the genitive, as dates write them.
MONTHS = {"siječnja": 1, "veljače": 2, "ožujka": 3, "travnja": 4, "svibnja": 5, "lipnja": 6, "srpnja": 7, "kolovoza": 8, "rujna": 9, "listopada": 10, "studenoga": 11, "studenog": 11, "prosinca": 12}


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.array_remove(F.split(fold(text), "[^\\p{L}\\p{N}]+"), "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def ascii_only(text: Column) -> Column:
    """Without diacritics; what is still outside ASCII goes."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARKED + MARKED.upper(), PLAIN + PLAIN.upper()), "[^\\x00-\\x7F]", "")


def slug(text: Column, most: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(ascii_only(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("dokument"))


def shorten(text: Column, most: int = 56) -> Column:
    s = squeeze(text)
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 3)), F.lit("..."))).otherwise(s)


def iso_date(text: Column) -> Column:
    """ISO form of the first day.month.year in the text, with the month as number or name; else an empty string."""
    text = F.coalesce(text, F.lit(""))
    by_number, by_name = "(\\d{1,2})\\.\\s*(\\d{1,2})\\.\\s*(\\d{4})", f"(?iu)(\\d{{1,2}})\\.\\s*({'|'.join(MONTHS)})\\s*(\\d{{4}})"
    part = lambda p, k: F.regexp_extract(text, p, k)
    month = F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.lower(part(by_name, 2)))
    numeric = F.concat_ws("-", part(by_number, 3), F.lpad(part(by_number, 2), 2, "0"), F.lpad(part(by_number, 1), 2, "0"))
    named = F.concat_ws("-", part(by_name, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(by_name, 1), 2, "0"))
    return F.when(part(by_number, 1) != "", numeric).when(part(by_name, 1) != "", named).otherwise("")


def year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "^(\\d{4})", 1), F.lit("")).cast("int")


def any_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(1[89]\\d{2}|20\\d{2})", 1), F.lit("")).cast("int")


def doi(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, "\\b(10\\.\\d{4,9}/[^\\s\"'<>]+)", 1), "\\.+$", ""), F.lit(""))


def gazette_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "(\\d{4}_\\d{2}_\\d+_\\d+)", 1), F.lit(""))


def citation(volume: Column, issue: Column, published: Column) -> Column:
    return F.concat_ws(", ", F.concat(F.lit("Vol. "), volume), F.concat(F.lit("br. "), issue), published)


def register_of(mark: Column) -> Column:
    return F.split_part(mark, F.lit("-"), F.lit(1))


def joined(parts: Column) -> Column:
    """A list as one string; blank parts go, nothing left is null."""
    return F.nullif(F.array_join(F.filter(F.transform(parts, F.trim), lambda x: x != ""), "; "), F.lit(""))


def text_status(text: Column, pages: Column) -> Column:
    """Empty, glyph codes instead of letters, a scan without text, or fine."""
    n = F.length(text)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "prazno").when(4 * F.regexp_count(text, F.lit("/g\\d+")) > 0.30 * n, "bez-unicode").when(n / F.greatest(pages, F.lit(1)) < 80, "sken").otherwise("ok")


def capital_labels(text: Column) -> Column:
    """Distinct runs of capital words, 4 to 39 characters long."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-ZŠĐČĆŽ]{3,}(?:\\s+[A-ZŠĐČĆŽ]{2,})*)"), 1)
    return F.array_distinct(F.filter(F.transform(runs, squeeze), lambda x: (F.length(x) > 3) & (F.length(x) < 40)))


def html_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, navigation and the like, a line per text node."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style|nav|header|footer|noscript|iframe)\\b.*?</\\1\\s*>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "(?s)<!--.*?-->", ""), "(?s)<[^>]*>", "\n")
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(code), F.lit(plain))
    return F.array_join(F.filter(F.transform(F.split(s, "\n"), F.trim), lambda x: x != ""), "\n")


def few_newlines(text: Column) -> Column:
    """No more than one empty line in a row."""
    return F.regexp_replace(text, "\\n{3,}", "\n\n")


def article_number(address: Column) -> Column:
    """The number at the end of an article's address or identifier; null without one."""
    return F.nullif(F.regexp_extract(address, "([0-9]+)/?$", 1), F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path of a url; an empty path is /."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), path


def is_operative(line: Column) -> Column:
    """Whether a line is a heading in spaced capitals, like P R E S U D A."""
    return F.trim(line).rlike("^(\\p{Lu}\\s+){3,}\\p{Lu}$")


def decoded_list(value: Column) -> Column:
    """A JSON list of strings as an array; a value that isn't one is its only item, and null or an empty text none."""
    items = F.from_json(value, "array<string>")
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.coalesce(items, F.array(value)))

"""Text helpers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_whitespace(text: Column) -> Column:
    """Remove whitespace of any script from both ends; plain ``trim`` knows blanks only."""
    return F.trim(text, F.lit(WHITESPACE))


def split_tags(tag_names: Column) -> Column:
    """Tags between commas, neither trimmed nor filtered."""
    return F.split(tag_names, ",")


def tags_as_text(tags: Column) -> Column:
    """The text that stands for a tag list when it is embedded."""
    return F.array_join(tags, "\n ")


def filled(*columns: str) -> Column:
    """True when every column is neither null nor empty."""
    test = F.lit(True)
    for name in columns:
        test = test & (F.coalesce(F.col(name), F.lit("")) != "")
    return test


def request_id(link_hash: Column, number: Column) -> Column:
    return F.concat(F.lit("summary_for_"), link_hash, F.lit("_"), number.cast("string"))


def request_id_hash(custom_id: Column) -> Column:
    """Third part of a request id, null when there is none."""
    return F.try_element_at(F.split(custom_id, "_"), F.lit(3))


def request_id_number(custom_id: Column) -> Column:
    """Last part of a request id."""
    return F.try_element_at(F.split(custom_id, "_"), F.lit(-1))

"""Text expressions shared by the map/reduce operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split sees it; plain \s is ASCII only in both engines.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
#: Everything but letters, digits and that white space.
DELETED = r"[^\p{L}\p{N}\s\p{Z}\x{85}\x{1c}-\x{1f}]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of ``text`` with everything but letters and digits deleted inside a word; no empty words.
    What is to go is deleted from the whole text before it is split, in one pass instead of one per word."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), DELETED, ""), SPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    """``text`` without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def url_domain(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/`` (port and query kept), null without ``://``."""
    rest = F.split_part(url, F.lit("://"), F.lit(2))
    return F.when(F.contains(url, F.lit("://")), F.split_part(rest, F.lit("/"), F.lit(1)))

"""Link keys, link checks and link normalisation."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The longest link accepted and the ports left out of a normalised link.
MAX_ACCEPTED_LINK = 2083
DEFAULT_PORTS = {"http": "80", "https": "443"}

_PARTS = (
    r"(?i)\A(https?):/*"  # scheme
    r"(?:([^/?#@]*)@)?"  # user information
    r"(\[[0-9a-f:.]+\]|[^/?#:@\[\]\s]+)"  # host
    r"(?::([0-9]*))?"  # port
    r"(/[^?#]*)?(\?[^#]*)?(#.*)?\z"  # path, query, fragment
)


@F.pandas_udf(StringType())
def link_hash(links: pd.Series) -> pd.Series:
    """SHAKE-256 of the link in UTF-8, 16 bytes as 32 hex digits."""
    import hashlib

    return links.map(
        lambda link: hashlib.shake_256(link.encode("utf-8")).hexdigest(16), na_action="ignore"
    )


def is_corrupted(link: Column) -> Column:
    """A second ``http`` after the first one marks two links run together."""
    return link.rlike("(?d)http.+https?")


def _trimmed(link: Column) -> Column:
    return F.regexp_replace(link, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def _part(link: Column, group: int) -> Column:
    return F.regexp_extract(_trimmed(link), _PARTS, group)


def is_valid_link(link: Column) -> Column:
    """An http or https link with a host, a port in range and no more than the accepted length."""
    port = _part(link, 4)
    port_ok = (port == "") | F.coalesce(port.try_cast("int") <= 65535, F.lit(False))
    length_ok = F.length(link) <= MAX_ACCEPTED_LINK
    return F.coalesce((_part(link, 3) != "") & port_ok & length_ok, F.lit(False))


def link_scheme(link: Column) -> Column:
    return F.lower(_part(link, 1))


def link_host(link: Column) -> Column:
    return F.lower(_part(link, 3))


def _escaped(part: Column) -> Column:
    """Percent-encode blanks, quotes, angle brackets and everything outside ASCII."""
    pieces = F.transform(
        F.split(part, ""),
        lambda c: F.when(c == " ", "%20")
        .when(c.rlike(r"[^\x21-\x7e]|[\"<>]"), F.url_encode(c))
        .otherwise(c),
    )
    return F.when(part.rlike(r"[^\x21-\x7e]|[\"<>]"), F.array_join(pieces, "")).otherwise(part)


def without_dot_segments(path: Column) -> Column:
    """The path with ``.`` and ``..`` segments (also as ``%2e``) resolved as RFC 3986 says:
    ``..`` drops the segment before it but never the root, and a path ending in a dot
    segment keeps its closing ``/``."""
    parts = F.split(path, "/", -1)
    lowered = lambda c: F.lower(c)
    one = lambda c: lowered(c).isin(".", "%2e")
    two = lambda c: lowered(c).isin("..", ".%2e", "%2e.", "%2e%2e")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, c: F.when(one(c), acc)
        .when(two(c), F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.array_append(acc, c)),
    )
    last = F.element_at(parts, -1)
    closed = F.when(one(last) | two(last), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.array_join(closed, "/")


def normalized_link(link: Column) -> Column:
    """The link as the keying request spells it: scheme and host in lower case,
    default port dropped, a bare host followed by ``/``, dot segments of the path
    resolved; null when not valid.

    Hosts outside ASCII stay as they are (no punycode).
    """
    scheme, user, port = link_scheme(link), _part(link, 2), _part(link, 4)
    default = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        default = default | ((scheme == name) & (port.try_cast("int") == int(number)))
    path = _part(link, 5)
    spelled = F.concat(
        scheme,
        F.lit("://"),
        F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""),
        link_host(link),
        F.when((port == "") | F.coalesce(default, F.lit(False)), "").otherwise(
            F.concat(F.lit(":"), port.try_cast("int").cast("string"))
        ),
        F.when(path == "", "/").otherwise(_escaped(without_dot_segments(path))),
        _escaped(_part(link, 6)),
        _escaped(_part(link, 7)),
    )
    return F.when(is_valid_link(link), spelled)

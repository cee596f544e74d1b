"""Link resolution against a page address, as column expressions.

The expressions work on lambda variables too, so that the links of one page are
resolved inside one array transform, without a UDF and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.binding import let

# The parts of a URI reference.
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY_AND_FRAGMENT = r"^[^?#]*((?:\?[^#]*)?(?:#.*)?)$"
OPAQUE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:[^/]"
HTTP = r"(?i)^https?://.*"

# What makes a URI reference unparsable.
UNPARSABLE = (
    # controls and spaces, also those beyond ASCII
    r"[\x00-\x20\x7f\u0080-   -     　]",
    # delimiters and broken escapes
    r'["<>\\^`{|}]',
    r"%(?![0-9a-fA-F]{2})",
    # a colon in the first segment that ends no scheme, a scheme with nothing after it
    r"^(?![a-zA-Z][a-zA-Z0-9+.-]*:)[^/?#:]*:",
    r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?:#|$)",
    # an authority with nothing in or after it
    r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//$",
    # a second fragment
    r"#.*#",
    # brackets in a path, and in an authority that is no address literal
    r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?+(?://[^/?#]*)?+[^?#\[\]]*[\[\]]",
    r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?!(?:[^/?#@\[\]]*@)?\[[0-9a-fA-F:.]+\](?::\d*)?(?:[/?#]|$))[^/?#\[\]]*[\[\]]",
)
ILLEGAL = "|".join(UNPARSABLE)


def is_parsable(uri: Column) -> Column:
    return ~uri.rlike(ILLEGAL)


def is_http(uri: Column) -> Column:
    return uri.rlike(HTTP)


def _normalised_path(path: Column) -> Column:
    """Drop ``.`` and empty segments and fold ``x/..``; a leading ``..`` stays."""
    # whether the last segment vanished, which leaves the path ending in a slash
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("vanished"))

    def step(state: Column, segment: Column) -> Column:
        kept = state["kept"]
        folds = (segment == "..") & (F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("..")) != "..")
        return (
            F.when(segment == ".", F.struct(kept.alias("kept"), F.lit(True).alias("vanished")))
            .when(
                folds,
                F.struct(
                    F.slice(kept, F.lit(1), F.size(kept) - 1).alias("kept"),
                    F.lit(True).alias("vanished"),
                ),
            )
            .otherwise(
                F.struct(
                    F.concat(kept, F.array(segment)).alias("kept"), F.lit(False).alias("vanished")
                )
            )
        )

    def joined(state: Column) -> Column:
        closing = F.when(
            (F.size(state["kept"]) > 0) & (state["vanished"] | path.endswith("/")), F.lit("/")
        ).otherwise("")
        opening = F.when(path.startswith("/"), F.lit("/")).otherwise("")
        return F.concat(opening, F.array_join(state["kept"], "/"), closing)

    segments = F.filter(F.split(path, "/"), lambda segment: segment != "")
    plain = ~path.rlike(r"//|(?:^|/)\.\.?(?:/|$)")
    return F.when(plain, path).otherwise(F.aggregate(segments, start, step, joined))


def page_parts(base: Column) -> Column:
    """What links are resolved against, taken apart once per page."""
    base_path = F.regexp_extract(base, PATH, 1)
    scheme = F.concat(F.regexp_extract(base, SCHEME, 1), F.lit(":"))
    authority = F.regexp_extract(base, AUTHORITY, 1)
    return F.struct(
        base.alias("url"),
        scheme.alias("scheme"),
        F.when(authority == "", scheme).otherwise(F.concat(scheme, F.lit("//"), authority)).alias("site"),
        F.regexp_extract(base_path, r"^(.*/)", 1).alias("folder"),
        base.rlike(OPAQUE).alias("opaque"),
        is_parsable(base).alias("parsable"),
    )


def resolve(page: Column, link: Column) -> Column:
    """The absolute form of a parsable ``link`` on a page given by its parts."""
    path = F.regexp_extract(link, PATH, 1)
    tail = F.regexp_extract(link, QUERY_AND_FRAGMENT, 1)
    authority = F.regexp_extract(link, AUTHORITY, 1)
    other_site = F.concat(page["scheme"], F.lit("//"), F.rtrim(authority, F.lit(":")), path, tail)
    same_page = F.concat(F.substring_index(page["url"], "#", 1), tail)
    root = F.when((page["folder"] == "") & (path != ""), F.lit("/")).otherwise(page["folder"])
    relative = let(
        F.concat(root, path), lambda joined: F.concat(page["site"], _normalised_path(joined), tail)
    )
    return (
        F.when(link.rlike(SCHEME) | page["opaque"], link)
        .when(authority != "", other_site)
        .when((path == "") & tail.startswith("#"), same_page)
        .when(path.startswith("/"), F.concat(page["site"], path, tail))
        .otherwise(relative)
    )


def normalise(page: Column, link: Column) -> Column:
    """``link`` cut at its query and made absolute; ``page`` is from :func:`page_parts`.

    An unparsable page address gives an empty string; an unparsable link stays as cut.
    """
    cut = F.when(F.instr(link, "?") > 1, F.substring_index(link, "?", 1)).otherwise(link)
    return F.when(~page["parsable"], F.lit("")).otherwise(
        let(cut, lambda kept: F.when(is_parsable(kept), resolve(page, kept)).otherwise(kept))
    )

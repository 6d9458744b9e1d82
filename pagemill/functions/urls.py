"""URL functions built from native expressions.

``parse_url`` is not used: it raises on dirty URLs under ANSI mode.  The component pattern
below accepts any string.  A URL is taken apart once and its parts are then referred to by a
lambda variable (``_let``), so that the expressions stay small.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import uses_netloc, uses_params, uses_relative

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme, netloc, path, parameters of the last segment (with their semicolon), query, fragment.
_PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?((?:[^?#]*/)?[^?#;]*)(;[^?#]*)?"
    r"(?:\?([^#]*))?(?:#(.*))?\z"
)
_NETLOC_SCHEMES = [s for s in uses_netloc if s]
_PARAM_SCHEMES = list(uses_params)
_RELATIVE_SCHEMES = [s for s in uses_relative if s]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _named(**fields: Column) -> Column:
    """A struct whose field names hold inside nested lambdas, where aliases can get lost."""
    return F.named_struct(*(c for name, value in fields.items() for c in (F.lit(name), value)))


def _tidy(url: Column) -> Column:
    """Drop leading control characters and blanks, and line breaks and tabs anywhere."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def _split(url: Column) -> Column:
    """STRUCT of scheme (lower case), netloc, path, params, query and fragment.

    The parts are found by one match; line breaks can part them, as a tidy URL has none.
    """

    def fields(p: Column) -> Column:
        has_params = F.lower(p[0]).isin(_PARAM_SCHEMES)
        return _named(
            scheme=F.lower(p[0]),
            netloc=p[1],
            path=F.when(has_params, p[2]).otherwise(F.concat(p[2], p[3])),
            params=F.when(has_params, F.substr(p[3], F.lit(2))).otherwise(F.lit("")),
            query=p[4],
            fragment=p[5],
        )

    parts = F.split(F.regexp_replace(_tidy(url), _PARTS, "$1\n$2\n$3\n$4\n$5\n$6"), "\n")
    return F.when(url.isNotNull(), _let(parts, fields))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_tidy(url), _PARTS, 1))


def url_netloc(url: Column) -> Column:
    """Host with port and user information, as written."""
    return F.regexp_extract(_tidy(url), _PARTS, 2)


def url_host(url: Column) -> Column:
    """Host with port and user information, in lower case."""
    return F.lower(url_netloc(url))


def url_path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return _split(url)["path"]


def _glue(
    scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column
) -> Column:
    def tail(sign: str, part: Column) -> Column:
        return F.when(part != "", F.concat(F.lit(sign), part)).otherwise(F.lit(""))

    def build(p: Column) -> Column:
        lead = (
            F.when((netloc != "") & (p != "") & ~p.startswith("/"), F.concat(F.lit("//"), netloc, F.lit("/")))
            .when(netloc != "", F.concat(F.lit("//"), netloc))
            .when(
                p.startswith("//")
                | (scheme.isin(_NETLOC_SCHEMES) & ((p == "") | p.startswith("/"))),
                F.lit("//"),
            )
            .otherwise(F.lit(""))
        )
        named = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))
        return F.concat(named, lead, p, tail("?", query), tail("#", fragment))

    return _let(F.concat(path, tail(";", params)), build)


def normalize_url(url: Column, keep_query: bool = False) -> Column:
    """Lower-case scheme and host, no trailing slashes, no parameters, query or fragment."""
    none = F.lit("")
    return _let(
        _split(url),
        lambda u: _glue(
            u["scheme"],
            F.lower(u["netloc"]),
            F.rtrim(u["path"], F.lit("/")),
            none,
            u["query"] if keep_query else none,
            none,
        ),
    )


def path_and_query(url: Column, keep_origin: bool = False) -> Column:
    """Path, parameters, query and fragment put together again; ``/`` when there is nothing.

    ``keep_origin`` only tidies the URL: scheme and host stay, and nothing stays nothing.
    """
    none = F.lit("")
    if keep_origin:
        return _let(
            _split(url),
            lambda u: _glue(
                u["scheme"], u["netloc"], u["path"], u["params"], u["query"], u["fragment"]
            ),
        )
    rest = _let(
        _split(url), lambda u: _glue(none, none, u["path"], u["params"], u["query"], u["fragment"])
    )
    return _let(rest, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def origin(url: Column) -> Column:
    """``scheme://host`` as written, the key of a robots file."""
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def malformed(url: Column) -> Column:
    """True for a host whose brackets do not hold an address."""
    return F.contains(url, F.lit("[")) & _let(
        url_netloc(url),
        lambda n: n.rlike(r"[\[\]]")
        & ~n.rlike(
            r"^(?:[^\[\]]*@)?\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*|v[0-9A-Fa-f]+\..+)\](?::[^\[\]]*)?\z"
        ),
    )


def in_scope(url: Column, host: Column) -> Column:
    """True for a web URL on the given host, ignoring case."""
    return (
        url_scheme(url).isin("http", "https")
        & (url_netloc(url) != "")
        & (url_host(url) == F.lower(host))
        & ~malformed(url)
    )


def link_target(
    base: Column, host: Column, href: Column, keep_query: bool = False, scoped: bool = True
) -> Column:
    """Normalised absolute form of ``href``; NULL when ``scoped`` and not a web link to ``host``.

    In a normalised URL the host ends at the third slash, so no further match is needed.
    """
    target = normalize_url(resolve_url(base, href), keep_query)
    if not scoped:
        return target
    return _let(
        target,
        lambda t: F.when(
            (host != "")
            & F.substring_index(F.substring_index(t, "?", 1), "/", 3).isin(
                F.concat(F.lit("http://"), F.lower(host)), F.concat(F.lit("https://"), F.lower(host))
            )
            & ~malformed(t),
            t,
        ),
    )


def _remove_dots(path: Column, rooted: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; a path that was not rooted loses empty inner ones."""
    nothing = F.array().cast("array<string>")

    def walk(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        inner = F.filter(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: rooted | (s != "")
        )
        walked = F.aggregate(
            F.concat(
                F.slice(parts, 1, 1),
                inner,
                F.when(F.size(parts) > 1, F.array(last)).otherwise(nothing),
            ),
            nothing,
            lambda done, s: F.when(
                s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            )
            .when(s == ".", done)
            .otherwise(F.concat(done, F.array(s))),
        )
        closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(nothing)
        return F.array_join(F.concat(walked, closing), "/")

    return _let(F.split(path, "/"), walk)


def resolve_url(base: Column, href: Column) -> Column:
    """The absolute form of ``href`` seen from ``base``."""

    def merge(b: Column, h: Column) -> Column:
        joined = (
            F.when(h["path"].startswith("/"), h["path"])
            .when(b["path"] == "", F.concat(F.lit("/"), h["path"]))
            .otherwise(F.concat(F.regexp_replace(b["path"], r"[^/]*\z", ""), h["path"]))
        )
        clean = _let(
            joined,
            lambda p: F.when(p.rlike(r"//|(?:^|/)\.\.?(?:/|\z)"), _remove_dots(p, h["path"].startswith("/"))).otherwise(p),
        )
        return _let(clean, lambda p: F.when(p == "", F.lit("/")).otherwise(p))

    def resolved(b: Column, h: Column) -> Column:
        scheme = F.when(h["scheme"] != "", h["scheme"]).otherwise(b["scheme"])
        own_host = h["netloc"] != ""
        bare = (h["path"] == "") & (h["params"] == "")
        path = F.when(own_host, h["path"]).when(bare, b["path"]).otherwise(merge(b, h))
        params = F.when(own_host | ~bare, h["params"]).otherwise(b["params"])
        query = F.when(~own_host & bare & (h["query"] == ""), b["query"]).otherwise(h["query"])
        netloc = F.when(own_host, h["netloc"]).otherwise(b["netloc"])
        return F.when((scheme != b["scheme"]) | ~scheme.isin(_RELATIVE_SCHEMES), href).otherwise(
            _glue(scheme, netloc, path, params, query, h["fragment"])
        )

    return (
        F.when(base == "", href)
        .when(href == "", base)
        .otherwise(_let(_split(base), lambda b: _let(_split(href), lambda h: resolved(b, h))))
    )
